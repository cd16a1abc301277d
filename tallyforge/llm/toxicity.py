"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of whole texts are densities and rates: a fixed lexicon, words and word beginnings that
the labels show to be telling, second-person words near them, capitals, punctuation, obfuscated
spellings. Words and trees are learned from the labelled rows outside fold 0, the calibration
from what such trees, learned without a part of those rows, say of that part. Where a label has
fewer than two ids, the fixed lexicon alone scores.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm import _buffers, _scratch

#: Labelled rows that are learned from, in expectation: a share of them by a hash of the id.
TRAINING_ROWS = 20_000
#: Telling units that are kept, documents a unit needs, and its least ratio of frequencies.
UNITS, UNIT_ROWS, UNIT_RATIO = 4096, 4, 6.0
TREES, DEPTH, STEP = 24, 4, 0.2
FOLDS, HELD_OUT = 5, 0
#: Parts of the labelled rows, each with its share of either label, for the calibration.
PARTS = 3
#: Words among which one of the lexicon makes a score of a half, where nothing is learned.
LEXICON_WORDS = 100
#: Columns that this module adds to a caller's, under names that a caller's won't have.
X, SCORE = "_tf_x", "_tf_score"
#: Words on either side of a telling word in which second-person words count.
NEAR = 5

#: Common insults of four languages.
LEXICON = (
    "idiot idiots moron morons stupid scum trash loser losers worthless pathetic disgusting clown clowns dumb fool jerk ugly hate filth vermin bastard crap "
    "idiote imbécile stupide crétin connard débile ordure minable "
    "dumm dummkopf trottel idiotisch abschaum arschloch wertlos "
    "idiota estúpido imbécil basura asqueroso tonto inútil"
).split()
#: Second-person words of the same languages.
SECOND_PERSON = "you your yours yourself u ur ya tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros".split()

WORD, BEGINNINGS = 0, (4, 5, 6)
NAMES = [
    "log_words", "fixed_density", "fixed_count", "word_density", "word_count", "word_most", "start_density", "start_count", "start_most", "second_density",
    "second_near", "capitals", "loud_words", "exclaims", "asks", "marks", "digits", "mixed_words", "stretched", "hidden_count", "masked",
]

_mark = np.zeros(256, bool)
_mark[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_upper = np.zeros(256, bool)
_upper[65:91] = True
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
#: Characters that stand for letters, and those put between letters.
_plain = np.arange(256, dtype=np.uint8)
for _a, _b in zip("013457@$!|", "oieastasil", strict=True):
    _plain[ord(_a)] = ord(_b)
_between = np.zeros(256, bool)
_between[[ord(c) for c in ".*-_'"]] = True


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(_buffers.run_hashes(_buffers._byte_values[data], np.array([0]), np.array([len(data)]))[0])


def hashes_of(words: list[str]) -> np.ndarray:
    return np.unique(np.array([word_hash(w) for w in words], np.uint64))


@dataclass
class Units:
    """Telling units by kind (whole words, beginnings): sorted hashes and their log ratios."""

    hashes: dict[int, np.ndarray] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)

    def weigh(self, kind: int, h: np.ndarray) -> np.ndarray:
        held = self.hashes.get(kind, np.zeros(0, np.uint64))
        if not len(held):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(held, h), len(held) - 1)
        return np.where(held[at] == h, self.weights[kind][at], 0.0)


def contains(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(held, h), len(held) - 1)
    return held[at] == h


def trimmed(words: _buffers.Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words without the marks around them (three at either end)."""
    a, b = words.starts.copy(), words.ends.copy()
    for _ in range(3):
        b -= (b - a > 1) & _mark[words.data[b - 1]]
        a += (b - a > 1) & _mark[words.data[np.minimum(a, len(words.data) - 1)]]
    return a, b


def unit_hashes(words: _buffers.Words) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    a, b = trimmed(words)
    values = _buffers._byte_values[words.data]
    out = {WORD: _buffers.run_hashes(values, a, b)}
    for size in BEGINNINGS:
        out[size] = np.where(b - a > size, _buffers.run_hashes(values, a, np.minimum(b, a + size)), np.uint64(0))
    return out, a, b


def features(data: np.ndarray, offsets: np.ndarray, units: Units) -> np.ndarray:
    """A row of NAMES for each text; zeros for an empty one."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    if not len(data):
        return out
    fixed, second = hashes_of(LEXICON), hashes_of(SECOND_PERSON)
    words = _buffers.Words(data, offsets, lower=True)
    row = np.repeat(np.arange(n), words.counts)
    by_row = lambda x: np.bincount(row, x, minlength=n)
    total = np.maximum(words.counts, 1)
    size = np.maximum(np.diff(offsets), 1)
    h, a, b = unit_hashes(words)
    told, weight = contains(fixed, h[WORD]), units.weigh(WORD, h[WORD])
    start = np.max([units.weigh(k, h[k]) for k in BEGINNINGS], axis=0)
    you = contains(second, h[WORD])
    col = {"log_words": np.log1p(words.counts), "fixed_density": by_row(told) / total, "fixed_count": np.log1p(by_row(told))}
    for name, w in (("word", weight), ("start", start)):
        most = np.zeros(n)
        np.maximum.at(most, row, w)
        col |= {f"{name}_density": by_row(w) / total, f"{name}_count": np.log1p(by_row(w > 0)), f"{name}_most": most}
    near = np.zeros(len(row), bool)
    telling = told | (weight > 0) | (start > 0)
    for d in range(1, NEAR + 1):
        same = row[d:] == row[:-d]
        near[d:] |= telling[:-d] & same
        near[:-d] |= telling[d:] & same
    col |= {"second_density": by_row(you) / total, "second_near": by_row(you & near) / total}

    def counted(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x)])
        return c[offsets[1:]] - c[offsets[:-1]]

    def inside(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x)])
        return c[b] - c[a]

    caps, letters, digits = _upper[data], _letter[data], _digit[data]
    col |= {"capitals": counted(caps) / size, "exclaims": counted(data == 33) / size, "asks": counted(data == 63) / size, "marks": counted(_mark[data]) / size, "digits": counted(digits) / size}
    in_word, cap_in, odd = inside(letters), inside(caps), inside(digits | _mark[data])
    col |= {"loud_words": by_row((cap_in >= 3) & (cap_in == b - a)) / total, "mixed_words": by_row((in_word > 0) & (odd > 0)) / total}
    thrice = np.zeros(len(data), bool)
    thrice[2:] = letters[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    masked = np.zeros(len(data), bool)
    masked[1:] = (data[1:] == 42) & letters[:-1]
    col |= {"stretched": by_row(inside(thrice) > 0) / total, "masked": counted(masked) / size}
    # The same texts without the characters put between letters, and with those that stand for letters undone.
    stay = ~_between[data]
    moved = np.concatenate([[0], np.cumsum(stay)])[offsets]
    shown = _buffers.Words(_plain[_buffers._lower[data[stay]]], moved, lower=False) if stay.any() else None
    if shown is not None:
        again, _, _ = unit_hashes(shown)
        found = contains(fixed, again[WORD]) | (units.weigh(WORD, again[WORD]) > 0)
        seen = np.bincount(np.repeat(np.arange(n), shown.counts), found, minlength=n)
        col["hidden_count"] = np.log1p(np.maximum(0, seen - by_row(told | (weight > 0))))
    for k, name in enumerate(NAMES):
        out[:, k] = col.get(name, 0.0)
    return out


def learn_units(labelled: DataFrame) -> Units:
    """Units that are UNIT_RATIO times as frequent among toxic documents. labelled: text, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = _buffers.raw(batch.column(0))
            for a, b in _buffers.steps(offsets):
                at = offsets[a : b + 1]
                words = _buffers.Words(data[at[0] : at[-1]], at - at[0], lower=True)
                if not len(words.starts):
                    continue
                row = np.repeat(np.arange(b - a), words.counts)
                for kind, h in unit_hashes(words)[0].items():
                    pairs = np.unique(np.stack([h.view(np.int64), row], 1)[h != 0], axis=0)
                    unit, which = np.unique(pairs[:, 0], return_inverse=True)
                    hit = toxic[a + pairs[:, 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(unit), kind, np.int32)), pa.array(unit), pa.array(np.bincount(which, hit, len(unit)).astype(np.int64)), pa.array(np.bincount(which, 1 - hit, len(unit)).astype(np.int64))],
                        names=["kind", "unit", "bad", "good"],
                    )

    total = labelled.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    counted = labelled.select("text", "toxic").mapInArrow(_buffers.tidy(run), "kind int, unit long, bad long, good long").groupBy("kind", "unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = ((F.col("bad") + 0.5) / (total.bad + 1.0)) / ((F.col("good") + 0.5) / (total.good + 1.0))
    best = counted.where(F.col("bad") >= UNIT_ROWS).withColumn("w", F.log(ratio)).where(F.col("w") >= float(np.log(UNIT_RATIO))).orderBy((F.col("w") * F.col("bad")).desc(), "kind", "unit").limit(UNITS)
    units = Units()
    rows = best.collect()
    for kind in {r.kind for r in rows}:
        h = np.array([r.unit for r in rows if r.kind == kind], np.int64).view(np.uint64)
        order = np.argsort(h)
        units.hashes[kind], units.weights[kind] = h[order], np.array([r.w for r in rows if r.kind == kind])[order]
    return units


def with_features(rows: DataFrame, units: Units, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns to keep and X, an array of NAMES of the text."""
    shared = rows.sparkSession.sparkContext.broadcast(units)
    at_text = keep.index(text_col) if text_col in keep else len(keep)
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField(X, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _buffers.raw(batch.column(at_text))
            for a, b in _buffers.steps(offsets):
                at = offsets[a : b + 1]
                x = features(data[at[0] : at[-1]], at - at[0], shared.value)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), lists], names=[*keep, X])

    return rows.select(*keep, *([] if text_col in keep else [text_col])).mapInArrow(_buffers.tidy(run), schema)


@dataclass
class Model:
    units: Units
    trees: object = None
    calibration: object = None
    lexicon: bool = False

    def score(self, rows: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
        """keep and SCORE of rows."""
        if self.trees is None and not self.lexicon:
            return rows.select(*keep, F.lit(0.0).alias(SCORE))
        made = with_features(rows, self.units, keep, text_col)
        if self.trees is None:
            fixed, hidden, size = (F.expm1(F.get(X, F.lit(NAMES.index(c)))) for c in ("fixed_count", "hidden_count", "log_words"))
            rate = (fixed + hidden) * F.least(F.lit(1.0), LEXICON_WORDS / F.greatest(F.lit(1.0), size))
            return made.select(*keep, F.round(1 - F.pow(F.lit(0.5), rate), 9).alias(SCORE))
        out = self.calibration.transform(margin(self.trees, made, keep))
        return out.select(*keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), SCORE)).alias(SCORE))


def margin(trees, made: DataFrame, keep: list[str]) -> DataFrame:
    """keep and _tf_margin (the trees' probability) of rows with X."""
    judged = trees.transform(made.withColumn("_tf_vector", array_to_vector(X)))
    return judged.select(*keep, vector_to_array("_tf_probability")[1].alias("_tf_margin"))


def fold(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS, F.lit(-1))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the labelled documents outside fold 0. Null ids and labels are left out, the
    largest of several labels counts. With fewer than two ids of either label the model scores
    by the fixed lexicon; without a toxic one, which leaves open what is meant by toxic, with 0."""
    _scratch.small_batches(docs)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxic"))
    known = known.where(fold(id_col) != HELD_OUT)
    share = min(1.0, TRAINING_ROWS / max(1, known.count()))
    taken = known.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col(id_col).alias("label_id"), "toxic")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(taken), F.col("id") == F.col("label_id"))
    rows = _scratch.written(rows.select("id", "text", "toxic").dropDuplicates(["id", "text"]).repartition(8), "labelled")
    ids = rows.select("id", "toxic").distinct()
    seen = {r.toxic: r["count"] for r in ids.groupBy("toxic").count().collect()}
    if any(seen.get(toxic, 0) < 2 for toxic in (0, 1)):
        return Model(Units(), lexicon=seen.get(1, 0) > 0)
    part = (F.row_number().over(W.partitionBy("toxic").orderBy(F.xxhash64("id"), "id")) % PARTS).alias("part")
    rows = _scratch.written(rows.join(F.broadcast(ids.select("id", part)), "id"), "parts")
    judged = [grown(rows.where(F.col("part") != k), rows.where(F.col("part") == k))[2] for k in range(PARTS)]
    units, trees, _ = grown(rows)
    return Model(units, trees, IsotonicRegression(labelCol="toxic", featuresCol="_tf_margin", predictionCol=SCORE).fit(reduce(DataFrame.union, judged)))


def grown(learned: DataFrame, others: DataFrame | None = None) -> tuple[Units, object, DataFrame | None]:
    """Units and trees from the rows learned, and toxic and the margin of the others."""
    units = learn_units(learned)
    ready = with_features(learned, units, ["toxic"]).select("toxic", array_to_vector(X).alias("_tf_vector"))
    grower = GBTClassifier(labelCol="toxic", featuresCol="_tf_vector", predictionCol="_tf_prediction", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, subsamplingRate=1.0, checkpointInterval=-1)
    trees = grower.setRawPredictionCol("_tf_raw").setProbabilityCol("_tf_probability").fit(_scratch.written(ready, "features"))
    if others is None:
        return units, trees, None
    return units, trees, _scratch.written(margin(trees, with_features(others, units, ["toxic"]), ["toxic"]), "judged")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null texts score as empty ones; rows with a null id are scored and aren't held out; repeated
    rows each give a row; other columns are ignored; an empty table gives an empty result.
    """
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = model.score(rows, ["id"])
    return out.select(F.col("id").alias(id_col), (fold("id") == HELD_OUT).alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score below 0.5, all their columns unchanged, whatever their names (but for
    those that begin with _tf_). Nulls, repeated rows and empty tables: as score() has them."""
    model = fit(docs, labels, id_col, text_col)
    return model.score(docs, docs.columns, text_col).where(F.col(SCORE) < 0.5).select(*docs.columns)
