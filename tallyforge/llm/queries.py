"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe_codec, decontaminate, fill_in_middle, license_scan, media, ngram_join, stream_dedup, substring_dedup, token_counts, toxicity, url_filters, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


#: The rules of op2's contract.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(table(spark, sf_dir, "documents"), digests=True)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write(table(spark, sf_dir, "pages"), folder)
    back = warc.read(index, folder, payloads=False)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda x: x["at"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op10_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edited crops of every image whose id is divisible by 20, against all images: a row for each
    class of near-equal images that one is found in, and, without a query, a row for each image with
    the representative of its class."""
    vectors = table(spark, sf_dir, "embeddings")
    found, members = media.search(media.render(vectors.where("vec_id % 20 = 0"), edited=True), media.render(vectors))
    return found.withColumn("representative", F.col("image")).unionByName(members, allowMissingColumns=True)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.rearrange(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_in_middle.restored()).alias("restored_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filters": op2_url_filters,
    "op3_toxicity": op3_toxicity,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_decontaminate": op5_decontaminate,
    "op6_ngram_join": op6_ngram_join,
    "op7_warc": op7_warc,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_image_copies": op10_image_copies,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_whitening": op12_whitening,
    "op13_stream_dedup": op13_stream_dedup,
}

#: Words between blanks, in DuckDB; replaces {w} with the text.
SQL_RUNS = r"regexp_extract_all({w}, '[^\x20\x09-\x0D]+')"
SQL_LOWER = "translate(coalesce({w}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Words of a text once A-Z are lower case, in DuckDB; replaces {w} with the text.
SQL_WORDS = r"regexp_extract_all(translate(coalesce({w}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": f"""
        WITH docs AS (SELECT doc_id, {SQL_WORDS.format(w="text")} AS w FROM documents),
        item AS (SELECT item_id, {SQL_WORDS.format(w="text")} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS size, list_slice(w, p0, p0 + least(len(w), 10) - 1) AS win
            FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p0 FROM item WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT size FROM windows),
        places AS (
            SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p0 FROM docs, sizes WHERE len(w) >= size),
        hits AS (
            SELECT doc_id, p0, p.size, item_id
            FROM (SELECT doc_id, p0, size, list_slice(w, p0, p0 + size - 1) AS win FROM places) p
            JOIN windows b ON b.size = p.size AND b.win = p.win),
        covered AS (
            SELECT doc_id, count(DISTINCT pos) AS n
            FROM (SELECT doc_id, unnest(range(p0, p0 + size)) AS pos FROM hits) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
        FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)""",
    "op6_ngram_join": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, {SQL_RUNS.format(w=SQL_LOWER.format(w="text"))} AS w FROM documents),
        sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                              ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM docs),
        item AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
            FROM item a JOIN item b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (na + nb - common)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id AS d, doc_id AS r FROM sets UNION SELECT reach.d, edges.b FROM reach JOIN edges ON reach.r = edges.a)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, low AS component_id
        FROM sets JOIN (SELECT d, min(r) AS low FROM reach GROUP BY d) ON d = doc_id""",
    "op7_warc": """
        WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        named AS (
            SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS last FROM bodies),
        bits AS (
            SELECT *, list_reduce(list_transform(range(0, 8), lambda k: list_reduce(list_transform(range(0, 4), lambda j:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 5 * k + 1, 5) AS BIGINT) >> CAST(15 - 5 * j AS BIGINT)) & 31 AS BIGINT) + 1, 1)), lambda x, y: x || y)), lambda x, y: x || y) AS digest FROM named)
        SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to FROM bits""",
    "op8_substring_dedup": f"""
        WITH docs AS (SELECT doc_id, {SQL_RUNS.format(w="coalesce(text, '')")} AS w FROM documents),
        places AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM docs WHERE len(w) >= 50),
        windows AS (SELECT doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) AS win FROM places),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS pos
            FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS low FROM windows) WHERE doc_id > low),
        lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM docs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM docs LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op11_fill_in_middle": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
        drawn AS (
            SELECT *, len(w) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(w) + 1) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
                        WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM docs),
        parts AS (
            SELECT doc_id, t, n, form, array_to_string(list_slice(w, 1, least(a, b)), '') AS p, array_to_string(list_slice(w, least(a, b) + 1, greatest(a, b)), '') AS m,
                   array_to_string(list_slice(w, greatest(a, b) + 1, n), '') AS s FROM drawn)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
        FROM parts""",
    "op13_stream_dedup": r"""
        WITH docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM docs WINDOW w AS (PARTITION BY t)""",
}
