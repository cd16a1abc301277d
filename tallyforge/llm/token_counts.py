"""Token counts of whole texts (sentencepiece models), lengths only.

A text is cut at safe boundaries, each distinct piece of a batch is encoded once, and the
lengths are summed. A boundary before a space is safe when no vocabulary piece holds the
space mark behind another character, the model puts one mark before each input and keeps
white space: then no merge crosses it, and the mark that the library adds stands for the
space that was cut off. Models for which that does not hold get whole texts.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _buffers

#: The library's mark for a space. A text that holds it literally is encoded whole.
MARK = "▁"
#: Bytes of distinct pieces in one call of the library.
BATCH_BYTES = 1 << 20
#: Pieces whose length a task remembers, and the longest of them.
MEMO_PIECES, MEMO_CHARS = 400_000, 48


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_safe(model) -> bool:
    """Whether texts may be cut before a space that follows another character."""
    mark = MARK
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return (
        not any(re.search(f"[^{mark}]{mark}", p) or " " in p for p in pieces)
        and model.encode(" a") != model.encode("a")
        and model.encode("a ") != model.encode("a")
        and model.id_to_piece(model.encode("a"))[0].startswith(mark)
    )


def pieces_of(text: str) -> tuple[list[str], int]:
    """The pieces to encode and the tokens that stand outside of them (a last lone space)."""
    cut = text.split(" ")
    if "" not in cut:
        return cut, 0
    out, held = [], 0
    for k, word in enumerate(cut):
        if word or not k:
            if word or len(cut) == 1:
                out.append(" " * held + word)
                held = 0
            else:
                held = 0  # a leading space: the next piece starts after it
                out.append("")
        else:
            held += 1
    # A text that starts with spaces keeps them in its first piece.
    if out and out[0] == "" and len(cut) > 1:
        lead = len(text) - len(text.lstrip(" "))
        rest = text[lead:]
        if not rest:
            return [text], 0
        inner, lone = pieces_of(rest)
        return [" " * lead + inner[0], *inner[1:]], lone
    if held == 1:
        return out, 1
    if held:
        out.append(" " * (held - 1))
    return out, 0


class Counter:
    """Counts for batches of texts; keeps a bounded memo of short pieces."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.safe = is_safe(self.model)
        self.memo: dict[str, int] = {}

    def lengths(self, pieces: list[str]) -> Iterator[int]:
        """Batches of about BATCH_BYTES, so that one long piece does not sit with many others."""
        batch, held = [], 0
        for p in pieces:
            batch.append(p)
            held += len(p)
            if held >= BATCH_BYTES:
                yield from map(len, self.model.encode(batch, num_threads=1))
                batch, held = [], 0
        if batch:
            yield from map(len, self.model.encode(batch, num_threads=1))

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return list(self.lengths(texts))
        cut = [([t], 0) if MARK in t else pieces_of(t) for t in texts]
        seen: set[str] = set().union(*(p for p, _ in cut)) if cut else set()
        fresh = sorted(seen.difference(self.memo), key=len)
        self.memo.update(zip(fresh, self.lengths(fresh), strict=True))
        out = [sum(map(self.memo.__getitem__, p)) + lone for p, lone in cut]
        for p in reversed(fresh):  # sorted by length: long ones are last
            if len(p) <= MEMO_CHARS:
                break
            del self.memo[p]
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        return out


@lru_cache(maxsize=4)
def counter(model_file: str) -> Counter:
    """One for each Python worker, which Spark uses for many tasks."""
    return Counter(model_file)


def count_tokens(docs: DataFrame, model_file: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    Null text counts as empty (0, 0, false); an empty text has 0 tokens; a null id stays null;
    repeated rows each give a row; columns beside id and text are ignored; an empty table gives
    an empty result. Texts are never truncated.
    """
    model_file = model_file or public_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file)
        for batch in batches:
            n, at = [], 0
            texts = batch.column(2)
            while at < batch.num_rows:  # about 4 MB of texts at a time
                to, held = at, 0
                sizes = batch.column(1)
                while to < batch.num_rows and held < 4 * BATCH_BYTES:
                    held += sizes[to].as_py()
                    to += 1
                n += count([t or "" for t in texts.slice(at, to - at).to_pylist()])
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    out = texts.mapInArrow(_buffers.tidy(run), f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
