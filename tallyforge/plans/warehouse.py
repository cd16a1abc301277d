"""The warehouse: one table of facts for each product, in versions that appear whole or not at all.

root/fact_<product>/data/commit=<id>/   rows of one delivery, clustered by bank, month and file
                   /snapshots/<id>/     source_file, commit, rows, content_hash, recorded_at: which commit holds a file's rows
                   /versions/<number>   JSON: snapshot, commits with their sizes, columns, rows

A delivery writes its rows and a new snapshot aside, then its version file by one rename. Whoever dies
before that leaves the last version as it was; readers take the highest number. A file delivered again
is not rewritten in place: the new snapshot points to the new commit, and its old rows no longer count.
Older versions stay as backups until vacuum().
"""

import json
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import dates
from tallyforge.operators import facts, metrics
from tallyforge.sources.files import Files

ORDER = ["banque", "mois_reception", "source_file", "source_row"]
#: Times that a delivery is put onto a newer version before it gives up.
RETRIES = 5


class WarehouseCorrupt(RuntimeError):
    """A table is there but can't be read."""


class Conflict(RuntimeError):
    """Another delivery of the same files came first."""


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def _at(self, product: str) -> str:
        return f"{self.root}/fact_{product}"

    def products(self) -> list[str]:
        """Products with a version; deliveries that never ended don't count."""
        return sorted(n[5:] for n in self.files.names(self.root) if n.startswith("fact_") and self.versions(n[5:]))

    # Versions

    def versions(self, product: str) -> list[int]:
        return sorted(int(n) for n in self.files.names(f"{self._at(product)}/versions") if n.isdigit())

    def version(self, product: str, number: int | None = None) -> dict | None:
        """What a version file says, by default the last one; None where there is none yet."""
        known = self.versions(product)
        if not known or number is not None and number not in known:
            return None
        return json.loads(self.files.read(f"{self._at(product)}/versions/{number or known[-1]:012d}"))

    def _publish(self, product: str, meta: dict) -> bool:
        return self.files.put_new(f"{self._at(product)}/versions/{meta['number']:012d}", json.dumps(meta))

    def snapshot(self, product: str, meta: dict) -> DataFrame:
        """source_file, commit, rows, content_hash, recorded_at of the files that a version holds."""
        return self.spark.read.schema(SNAPSHOT).parquet(f"{self._at(product)}/snapshots/{meta['snapshot']}")

    def _damage(self, product: str, meta: dict) -> str | None:
        """What the listing says is missing or cut short; no data is read."""
        for commit, due in meta["commits"].items():
            if self.files.size(f"{self._at(product)}/data/commit={commit}") != (due["files"], due["bytes"]):
                return f"files of commit {commit} are missing or cut short"
        if meta["rows"] and not self.files.exists(f"{self._at(product)}/snapshots/{meta['snapshot']}"):
            return "its snapshot is missing"
        return None

    def _rows(self, product: str, meta: dict) -> DataFrame:
        schema = T.StructType.fromJson(meta["schema"])
        data = f"{self._at(product)}/data"
        if not meta["commits"]:
            return self.spark.createDataFrame([], schema)
        full = T.StructType([*schema.fields, T.StructField("commit", T.StringType())])
        rows = self.spark.read.schema(full).option("basePath", data).parquet(*(f"{data}/commit={c}" for c in meta["commits"]))
        if any(c["live"] != c["rows"] for c in meta["commits"].values()):
            rows = rows.join(self.snapshot(product, meta).select("source_file", "commit"), ["source_file", "commit"], "left_semi")
        return rows.select(*schema.names)

    def _older(self, product: str, number: int) -> Iterator[dict]:
        for n in reversed([v for v in self.versions(product) if v < number]):
            yield self.version(product, n)

    def _corrupt(self, product: str, meta: dict, why: str) -> WarehouseCorrupt:
        """The error with the newest older version that is whole, and how many rows it has."""
        for old in self._older(product, meta["number"]):
            if self._damage(product, old) is None:
                return WarehouseCorrupt(f"version {meta['number']} of {product} can't be read ({why}); version {old['number']} with {old['rows']} rows is whole: restore() it, then deliver again what came since")
        return WarehouseCorrupt(f"version {meta['number']} of {product} can't be read ({why}), and no older version is whole: deliver the source files again")

    def read(self, product: str, version: int | None = None) -> DataFrame | None:
        """The product's facts; None where there are none yet. Missing or cut files are found at once, by the listing."""
        meta = self.version(product, version)
        if meta is None:
            return None
        if why := self._damage(product, meta):
            raise self._corrupt(product, meta, why)
        return self._rows(product, meta)

    def verify(self, product: str, version: int | None = None) -> int:
        """Reads a version whole and returns its rows; damage within files is found here."""
        meta = self.version(product, version)
        try:
            digest = F.bit_xor(F.xxhash64(*T.StructType.fromJson(meta["schema"]).names))  # so that every column is read
            n = self.read(product, meta["number"]).agg(F.count("*").alias("n"), digest).first().n
        except WarehouseCorrupt:
            raise
        except Exception as e:
            raise self._corrupt(product, meta, type(e).__name__) from e
        if n != meta["rows"]:
            raise self._corrupt(product, meta, f"{n} rows for {meta['rows']}")
        return n

    def restore(self, product: str, version: int) -> int:
        """Makes an older version the last one again; returns its new number."""
        meta = self.version(product, version)
        if why := self._damage(product, meta):
            raise self._corrupt(product, meta, why)
        meta |= {"number": self.versions(product)[-1] + 1}
        if not self._publish(product, meta):
            raise Conflict(f"{product} has a newer version")
        return meta["number"]

    # Deliveries

    def append(self, product: str, incoming: DataFrame, expected: list[str] | None = None, dry_run: bool = False, hashes: DataFrame | None = None, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """Replaces the files of incoming and adds new ones; other files and products stay untouched.

        The columns must be the table's (or expected, for a first write), in order. Rows of equal
        hash within the delivery count once. hashes: path, content_hash of the delivered files; one
        without rows is recorded too, and loses its old ones. batch: (stream, number); what a stream has
        delivered is not taken twice. A delivery of other files that came first is built upon, one of
        the same files is a Conflict. Returns written and replaced counts.
        """
        head = self.version(product)
        if batch and head and head["batches"].get(batch[0], -1) >= batch[1]:
            return {"written": 0, "replaced": 0}
        facts.check_contract(incoming, head["columns"] if head else expected or incoming.columns)
        rows = (facts.replace_files(incoming.limit(0), incoming) if "row_hash" in incoming.columns else incoming).select(*incoming.columns)
        if dry_run:
            touched = self._touched(rows.groupBy("source_file").agg(F.count("*").alias("rows")), hashes).persist()
            try:
                return {"written": touched.agg(F.sum("rows")).first()[0] or 0, "replaced": self._replaced(product, head, touched)}
            finally:
                touched.unpersist()
        commit = uuid.uuid4().hex
        data, snapshots = f"{self._at(product)}/data/commit={commit}", f"{self._at(product)}/snapshots"
        try:
            seen, order = Observation(), [c for c in ORDER if c in rows.columns]
            clustered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
            clustered.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("source_file").isNull()).alias("unnamed")).write.parquet(data)
            if seen.get["unnamed"]:
                raise facts.ContractError(f"{seen.get['unnamed']} rows have no source_file")
            back = self.spark.read.schema(rows.schema).parquet(data)
            self._touched(back.groupBy("source_file").agg(F.count("*").alias("rows")), hashes).select("source_file", F.lit(commit).alias("commit"), "rows", "content_hash", F.current_timestamp().alias("recorded_at")).write.parquet(f"{snapshots}/{commit}-own")
            own = self.spark.read.schema(SNAPSHOT).parquet(f"{snapshots}/{commit}-own")
            written = own.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
            if written != seen.get["rows"]:
                raise WarehouseCorrupt(f"fact_{product}: {written} rows read back, {seen.get['rows']} written")
            for attempt in range(RETRIES):
                replaced = self._replaced(product, head, own)
                name = f"{commit}-{attempt}"
                others = self.snapshot(product, head).join(own.select("source_file"), "source_file", "left_anti") if head else own.limit(0)
                others.select(*own.columns).unionByName(own).write.parquet(f"{snapshots}/{name}")
                meta = self._meta(product, head, name, rows.schema, {commit: dict(zip(("files", "bytes"), self.files.size(data), strict=True)) | {"rows": written}}, batch)
                if self._publish(product, meta):
                    return {"written": written, "replaced": replaced}
                newer = self.version(product)
                if not self._apart(product, head, newer, own):
                    raise Conflict(f"{product}: version {newer['number']} brought some of the same files")
                facts.check_contract(incoming, newer["columns"])
                head = newer
            raise Conflict(f"{product}: {RETRIES} other deliveries came first")
        except BaseException:
            self.files.delete(data)
            raise

    @staticmethod
    def _touched(counts: DataFrame, hashes: DataFrame | None) -> DataFrame:
        """source_file, rows, content_hash of the files of a delivery."""
        if hashes is None:
            return counts.withColumn("content_hash", F.lit(None).cast("string"))
        own = hashes.groupBy(F.col("path").alias("source_file")).agg(F.max("content_hash").alias("content_hash"))
        return counts.join(own, "source_file", "full").select("source_file", F.coalesce("rows", F.lit(0)).alias("rows"), "content_hash")

    def _replaced(self, product: str, head: dict | None, touched: DataFrame) -> int:
        if head is None:
            return 0
        return self.snapshot(product, head).join(touched.select("source_file"), "source_file", "left_semi").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def _meta(self, product: str, head: dict | None, name: str, schema: T.StructType, commits: dict, batch: tuple[str, int] | None) -> dict:
        """A version file for a written snapshot; commits without a live row are left out."""
        meta = {"number": head["number"] + 1 if head else 1, "snapshot": name, "columns": schema.names, "schema": schema.jsonValue(), "batches": dict(head["batches"]) if head else {}}
        if batch:
            meta["batches"][batch[0]] = batch[1]
        live = {r["commit"]: r["n"] for r in self.snapshot(product, meta).groupBy("commit").agg(F.sum("rows").alias("n")).where("n > 0").collect()}  # a row for each commit
        known = (head["commits"] if head else {}) | commits
        return meta | {"commits": {c: known[c] | {"live": n} for c, n in live.items()}, "rows": sum(live.values())}

    def _apart(self, product: str, old: dict | None, new: dict, own: DataFrame) -> bool:
        """Whether none of own's files changed between two versions."""
        keys = ["source_file", "commit"]
        mine = lambda meta: self.snapshot(product, meta).join(own.select("source_file"), "source_file", "left_semi").select(*keys)
        before, after = mine(old) if old else own.select(*keys).limit(0), mine(new)
        return before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()

    def compact(self, product: str) -> None:
        """Rewrites the live rows as one commit, so that reading needs no snapshot."""
        head = self.version(product)
        rows = self.read(product)
        commit = uuid.uuid4().hex
        data, order = f"{self._at(product)}/data/commit={commit}", [c for c in ORDER if c in rows.columns]
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(data)
        self.snapshot(product, head).withColumn("commit", F.lit(commit)).write.parquet(f"{self._at(product)}/snapshots/{commit}")
        size = dict(zip(("files", "bytes"), self.files.size(data), strict=True))
        meta = self._meta(product, head, commit, rows.schema, {commit: size | {"rows": head["rows"]}}, None)
        if not self._publish(product, meta):
            self.files.delete(data)
            raise Conflict(f"{product} got a newer version meanwhile")

    def vacuum(self, product: str, keep: int = 2, hours: float = 24.0) -> list[str]:
        """Deletes what only versions before the last `keep` use, and what dead deliveries left, if it is
        older than `hours` (a delivery may be under way). Returns what went."""
        at, known = self._at(product), self.versions(product)
        metas = [self.version(product, n) for n in known[-keep:]]
        used = {f"data/commit={c}" for m in metas for c in m["commits"]} | {f"snapshots/{m['snapshot']}" for m in metas}
        there = [f"{d}/{n}" for d in ("data", "snapshots") for n in self.files.names(f"{at}/{d}")]
        gone = [x for x in there if x not in used and time.time() - self.files.modified(f"{at}/{x}") >= 3600 * hours]
        gone = [f"versions/{n:012d}" for n in known[:-keep]] + gone  # a version goes before its files do
        for x in gone:
            self.files.delete(f"{at}/{x}")
        return gone

    # What was delivered, and what follows from the facts

    def pending(self, files: DataFrame) -> DataFrame:
        """path, content_hash, status of files against what was recorded or delivered last."""
        known = self.spark.createDataFrame([], "path string, content_hash string, recorded_at timestamp")
        if self.files.exists(f"{self.root}/manifest"):
            known = known.unionByName(self.spark.read.schema(known.schema).parquet(f"{self.root}/manifest"))
        for p in self.products():
            known = known.unionByName(self.snapshot(p, self.version(p)).where("content_hash is not null").select(F.col("source_file").alias("path"), "content_hash", "recorded_at"))
        return facts.file_status(files, known.groupBy("path").agg(F.max_by("content_hash", "recorded_at").alias("content_hash")))

    def record(self, files: DataFrame) -> None:
        """Adds files (path, content_hash) that no product has rows of to the manifest; the latest entry of a path counts."""
        files.select("path", "content_hash", F.current_timestamp().alias("recorded_at")).write.mode("append").parquet(f"{self.root}/manifest")

    def extracts(self, product: str) -> None:
        """The product's rows by bank; rows without one are left out."""
        frame = self.read(product)
        frame.where(F.col("banque").isNotNull()).write.mode("overwrite").partitionBy("banque").parquet(f"{self.root}/by_bank/{product}")

    def dimensions(self, labels: dict[str, str], products: list[tuple[str, str]]) -> None:
        """dim_date over all facts, dim_bank from the facts with labels, dim_product from the catalogue."""
        all_ = [self.read(p) for p in self.products()]
        every = facts.sparse_union(*all_)
        bounds = metrics.date_bounds(every)
        dates.calendar(F.col("first"), F.col("last"), bounds.where("first is not null")).write.mode("overwrite").parquet(f"{self.root}/dim_date")
        names = self.spark.createDataFrame(list(labels.items()) or [("", "")], "code string, label string")
        every.select(F.col("banque").alias("code")).distinct().join(names, "code", "left").select("code", F.coalesce("label", "code").alias("label")).write.mode("overwrite").parquet(f"{self.root}/dim_bank")
        self.spark.createDataFrame(products, "code string, label string").write.mode("overwrite").parquet(f"{self.root}/dim_product")


SNAPSHOT = "source_file string, commit string, rows long, content_hash string, recorded_at timestamp"
