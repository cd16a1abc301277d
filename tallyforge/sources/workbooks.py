"""Workbooks as Spark tables: a data source with one task a file, the same over files that Spark has
read, and a writer of deliveries in parts.

After register(spark), `spark.read.format("workbooks").load(root)` gives CELLS. Options: sheets, names of sheets (any case,
split by |) of which a workbook's first is read; else that with most cells in its first rows; sheets=*
reads all. Filters on path and sheet keep files and sheets from being read. A file that can't be read is a row of its own with its error.
"""

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tallyforge.operators import facts
from tallyforge.sources import tables, xlsx

CELLS = "path string, sheet string, sheet_index int, row int, col int, kind string, s string, n double, d date, is_formula boolean, cached boolean, error string, content_hash string, note string"
ARROW = pa.schema(
    [("path", pa.string()), ("sheet", pa.string()), ("sheet_index", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("kind", pa.string()), ("s", pa.string()), ("n", pa.float64()), ("d", pa.date32()), ("is_formula", pa.bool_()), ("cached", pa.bool_()), ("error", pa.string()), ("content_hash", pa.string()), ("note", pa.string())]
)
#: Cells of an Arrow batch.
BATCH = 16_384
NAMES = r"(?i)^(?!~\$|\.).*\.(xlsx|xlsm|xls)$"
OLD_NOTE = "old .xls format: save the workbook as .xlsx"


def find(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path (and content, content_hash) of the workbooks under root; hidden and lock files don't count.

    Without content only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    books = files.where(F.element_at(F.split("path", "/"), -1).rlike(NAMES))
    if not content:
        return books.select("path")
    return books.select("path", "content", content_hash().alias("content_hash"))


def content_hash() -> Column:
    return F.substring(F.sha2("content", 256), 1, 32)


def cells_of(path: str, content: bytes, wanted: list[str], sheets: set[str] | None = None) -> Iterator[pa.RecordBatch]:
    """CELLS of one workbook in batches. wanted: names to choose a sheet by, ["*"] for all; sheets: the
    only ones that matter."""
    digest = hashlib.sha256(content).hexdigest()[:32]
    note = OLD_NOTE if path.lower().endswith(".xls") else None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)

    any_ = False
    try:
        book = xlsx.Book(content)
        chosen = book.sheets if wanted == ["*"] else [s for s in [book.choose(wanted)] if s]
        for index, name, target in chosen:
            if sheets is not None and name not in sheets:
                any_ = True
                continue
            rows = []
            for cell in book.cells(target):
                rows.append((path, name, index, *cell, None, digest, note))
                if len(rows) == BATCH:
                    any_ = True
                    yield batch(rows)
                    rows = []
            if rows:
                any_ = True
                yield batch(rows)
        error = None if any_ else "no cells"
    except Exception as e:  # any damage to a file is that file's error
        error = f"unreadable workbook: {type(e).__name__}"
    if error:
        yield batch([(path, *[None] * 10, error, digest, note)])


def read(books: DataFrame, wanted: str = "*") -> DataFrame:
    """CELLS of workbooks (path, content) that Spark has read; wanted as the option sheets."""
    names = split(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from cells_of(path.as_py(), content.as_py(), names)

    return books.select("path", "content").mapInArrow(run, CELLS)


def split(wanted: str) -> list[str]:
    return [x.strip().lower() for x in wanted.split("|") if x.strip()]


@dataclass
class File(InputPartition):
    path: str


class Workbooks(DataSource):
    """The format "workbooks"; files are opened where their task runs, by PyArrow's file systems."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> "WorkbookReader":
        return WorkbookReader(self.options["path"], split(self.options.get("sheets", "")))


class WorkbookReader(DataSourceReader):
    def __init__(self, root: str, wanted: list[str]):
        self.root, self.wanted = root, wanted
        self.paths: set[str] | None = None
        self.sheets: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what names paths and sheets; Spark applies all others, and these too for rows of errors."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("path",):
                self.paths = values if self.paths is None else self.paths & values
            elif values is not None and f.attribute == ("sheet",):
                self.sheets = values if self.sheets is None else self.sheets & values
            yield f

    def partitions(self) -> list[File]:
        system, at = open_system(self.root)
        scheme = self.root[: len(self.root) - len(at)] if self.root.endswith(at) else ""
        info = system.get_file_info(at)
        found = system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
        names = sorted(f"{scheme}{f.path}" for f in found if f.type == fs.FileType.File and re.match(NAMES, f.base_name))
        return [File(p) for p in names if self.paths is None or p in self.paths] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition.path:
            system, at = open_system(partition.path)
            with system.open_input_stream(at) as f:
                content = f.read()
            yield from cells_of(partition.path, content, self.wanted, self.sheets)


def open_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def uncached_formulas(cells: DataFrame) -> DataFrame:
    """path, sheet, col of columns that hold formulas without a value."""
    return cells.where(F.col("is_formula") & ~F.col("cached")).select("path", "sheet", "col").distinct()


# Deliveries


@dataclass
class Parts(WriterCommitMessage):
    drafts: list[tuple[str, int, str]]


class Delivery(DataSource):
    """The format "delivery": rows with stem and part become folder/<stem>.xlsx, or <stem>_part001.xlsx
    and so on where a stem has several parts. A part's rows must come to one task, in order."""

    @classmethod
    def name(cls) -> str:
        return "delivery"

    def writer(self, schema: StructType, overwrite: bool) -> "DeliveryWriter":
        return DeliveryWriter(self.options["path"], schema.names, [x for x in self.options.get("stems", "").split("|") if x])


class DeliveryWriter(DataSourceArrowWriter):
    """Parts are written as drafts; only once all are there they get their names, one by one, and parts
    of an earlier delivery of the same stems go."""

    def __init__(self, folder: str, columns: list[str], stems: list[str]):
        self.folder, self.columns, self.stems = folder.rstrip("/"), columns, stems
        self.drafts = f"{self.folder}/.draft-{uuid.uuid4().hex}"

    def _draft(self, rows: Iterator[tuple]) -> str:
        system, at = open_system(self.drafts)
        system.create_dir(at)
        name = f"{at}/{uuid.uuid4().hex}.xlsx"  # an attempt of a task has names of its own
        with system.open_output_stream(name) as out:
            xlsx.save({"Données": rows}, out)
        return name

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        import itertools

        stem, part = self.columns.index("stem"), self.columns.index("part")
        shown = [k for k in range(len(self.columns)) if k not in (stem, part)]
        names = [self.columns[k] for k in shown]
        rows = (row for b in iterator for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        done = []
        for (s, p), own in itertools.groupby(rows, lambda r: (r[stem], r[part])):
            done.append((s, p, self._draft(itertools.chain([names], ([r[k] for k in shown] for r in own)))))
        return Parts(done)

    def commit(self, messages: list[Parts | None]) -> None:
        system, at = open_system(self.folder)
        drafts = [d for m in messages if m for d in m.drafts]
        missing = set(self.stems) - {s for s, _, _ in drafts}
        shown = [c for c in self.columns if c not in ("stem", "part")]
        drafts += [(s, 1, self._draft(iter([shown]))) for s in missing]  # without a row: the header alone
        parts: dict[str, int] = {}
        for s, p, _ in drafts:
            parts[s] = max(p, parts.get(s, 0))
        kept = set()
        for s, p, draft in drafts:
            kept.add(name := f"{s}.xlsx" if parts[s] == 1 else f"{s}_part{p:03d}.xlsx")
            system.move(draft, f"{at}/{name}")
        earlier = re.compile("(" + "|".join(map(re.escape, parts)) + r")(_part[0-9]{3,})?\.xlsx")
        for f in system.get_file_info(fs.FileSelector(at)):
            if earlier.fullmatch(f.base_name) and f.base_name not in kept:
                system.delete_file(f.path)
        self._clear()

    def abort(self, messages: list[Parts | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, at = open_system(self.drafts)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session, and lets it push filters to the reader, which Spark
    refuses to open otherwise."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Workbooks)
    spark.dataSource.register(Delivery)


def deliver(frame: DataFrame, folder: str, stem: str, order: list[str], limit: int = 1_000_000, by: str | None = None, labels: dict[str, str] | None = None) -> None:
    """Writes frame as workbooks of `limit` rows at most, in order: <stem>.xlsx or its parts, and for
    each value of `by` (null ones are left out) <value>_<stem>.xlsx. labels: names to show for columns.

    Each part is one task's; a group of any size is dealt by ranges of the order."""
    if not 1 <= limit < xlsx.MOST_ROWS:
        raise ValueError(f"a part has 1 to {xlsx.MOST_ROWS - 1} rows")
    register(frame.sparkSession)
    keys = [F.col(by), *(F.col(c) for c in order)] if by else [F.col(c) for c in order]
    own = frame.where(F.col(by).isNotNull()) if by else frame
    ranged = tables.written(facts.ranged(own, *keys), "delivery")  # written: numbers and rows must come from the same ranges
    named = facts.numbered(ranged, limit, *keys, by=by).withColumn("stem", F.concat(F.col(by).cast("string"), F.lit(f"_{stem}")) if by else F.lit(stem))
    shown = [c for c in frame.columns]
    parts = named.repartition("stem", "part").sortWithinPartitions("stem", "part", *keys)
    out = parts.select("stem", "part", *(F.col(c).alias((labels or {}).get(c, c)) for c in shown))
    out.write.format("delivery").mode("append").option("stems", "" if by else stem).save(folder)
    tables.free(ranged)


def write(sheets: dict[str, list[list]], out) -> None:
    """A plain workbook for tests: text that begins with = is a formula without a value."""
    xlsx.save(sheets, str(out), formulas=True)
