"""Deliveries as they arrive: a stream of workbooks into the warehouse, each file's rows exactly once.

A micro-batch is cut to the files whose bytes the warehouse doesn't have, their tables become facts, and
each product gets one versioned commit that also records the batch and the files' hashes. A batch that
dies half way is run again by the stream: products that had committed it skip it, the others take it.
"""

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyforge.operators import detect, formats, paths, products
from tallyforge.plans import consolidate
from tallyforge.plans.warehouse import Warehouse
from tallyforge.sources import tables, workbooks

#: The columns of the source of whole files.
BINARY = "path string, modificationTime timestamp, length long, content binary"


@dataclass
class Product:
    """A product's fields (name, type), how they derive, and which of them every row must have."""

    fields: list[tuple[str, str]]
    rules: products.Rules = field(default_factory=dict)
    required: list[str] = field(default_factory=list)


@dataclass
class Setup:
    """Configuration as small tables: banks (token, code), keywords (token, produit, partners), words,
    products by code, patterns (produit, format, pattern; None: no named formats)."""

    banks: DataFrame
    keywords: DataFrame
    words: consolidate.Words
    products: dict[str, Product]
    patterns: DataFrame | None = None
    settings: detect.Settings = detect.Settings()


def now() -> str:
    return dt.datetime.now(dt.UTC).isoformat(timespec="seconds")


class Ingest:
    """Brings workbooks into a warehouse. name: under which the warehouse remembers the stream's batches."""

    def __init__(self, spark: SparkSession, warehouse: Warehouse, setup: Setup, name: str = "deliveries", clock: Callable[[], str] = now):
        self.spark, self.warehouse, self.setup, self.name, self.clock = spark, warehouse, setup, name, clock

    def described(self, files: DataFrame) -> DataFrame:
        """files (path) with bank, produit, period, source_format and the first error that keeps a file out."""
        known = F.col("produit").isin(*self.setup.products)
        found = paths.describe(files.select("path"), self.setup.banks, self.setup.keywords)
        error = F.coalesce("error", F.when(~F.coalesce(known, F.lit(False)), "no known product in the path"))
        if self.setup.patterns is None:
            return found.select("path", "bank", "produit", "period", F.lit(None).cast("string").alias("source_format"), error.alias("error"))
        named = formats.detect(found, self.setup.patterns).withColumnRenamed("error", "format_error")
        return found.join(named, "path", "left").select("path", "bank", "produit", "period", "source_format", F.coalesce(error, "format_error").alias("error"))

    def batch(self, books: DataFrame, number: int | None = None) -> dict[str, dict[str, int]]:
        """Takes workbooks (path, content) in; returns the counts of each product that got some.

        Files whose bytes are known are skipped, files that can't be placed or read are written to
        <warehouse>/problems with their error, and are tried again when they are given again."""
        hashed = books.where(F.element_at(F.split("path", "/"), -1).rlike(workbooks.NAMES)).withColumn("content_hash", workbooks.content_hash())
        status = self.warehouse.pending(hashed.select("path", "content_hash"))
        todo = tables.written(self.described(status.where("status <> 'unchanged'")).join(status.select("path", "content_hash"), "path"), "todo")
        placed = todo.where("error is null")
        cells = tables.written(workbooks.read(hashed.join(placed.select("path"), "path", "left_semi"), wanted="").withColumn("file_id", F.col("path")), "book-cells")
        unread = cells.where("error is not null").select("path", "error", "note")
        self._tell(todo.where("error is not null").select("path", "error", F.lit(None).cast("string").alias("note")).unionByName(unread), number)
        good = cells.where("error is null")
        read = placed.join(good.select("path").distinct(), "path", "left_semi")
        named = good.groupBy("path").agg(F.first("sheet").alias("sheet"))  # one sheet was chosen
        counts = {}
        for code in sorted(r.produit for r in read.select("produit").distinct().collect()):  # products are configuration
            own = read.where(F.col("produit") == code)
            files = own.join(named, "path").select(F.col("path").alias("file_id"), "path", "sheet", "bank", "produit", "period", "source_format")
            product = self.setup.products[code]
            run = consolidate.consolidate(good.join(own.select("path"), "path", "left_semi").drop("path", "error"), files, self.setup.words, product.fields, product.rules, self.clock(), self.setup.settings)
            counts[code] = self.warehouse.append(code, run.facts, hashes=own.select("path", "content_hash"), batch=None if number is None else (self.name, number))
        tables.free(todo, cells)
        return counts

    def _tell(self, problems: DataFrame, number: int | None) -> None:
        at = f"{self.warehouse.root}/problems/batch={self.name}-{'once' if number is None else number}"
        problems.write.mode("overwrite").parquet(at)  # by batch: one that runs again writes the same

    def stream(self, folder: str, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
        """Starts a query that takes all files that folder (with those below) has and ends; run it again,
        or without the trigger, for what comes later. A file overwritten in place keeps its name and
        isn't seen again by a stream: catch_up() finds it by its bytes."""
        source = self.spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
        books = source.load(folder).select("path", "content")
        return books.writeStream.foreachBatch(lambda df, n: self._each(df, n)).option("checkpointLocation", checkpoint).queryName(self.name).trigger(availableNow=True).start()

    def _each(self, df: DataFrame, number: int) -> None:
        self.batch(df.persist(), number)  # read once: for hashes and for cells
        df.unpersist()

    def catch_up(self, folder: str) -> dict[str, dict[str, int]]:
        """All of folder at once: new files, and those whose bytes changed."""
        return self.batch(workbooks.find(self.spark, folder, content=True).select("path", "content"))
