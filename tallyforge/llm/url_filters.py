"""URL filters by a path-template tree for each host, in DataFrame functions.

Nodes are rows (host, path so far, segment) with counts. Segments that are numbers, hashes or long
mixed ids stand for their kind from the start. From the root down, segments that are rare within
their node become a wildcard, unless their labels set them apart from their siblings. From the
leaves up, branches of a node are merged that a chi-square test can't tell from the pooled
distribution of their family (the siblings with the same most frequent child) and whose labels don't
differ from the family's. A template is rejected by its smoothed share of blocked labels. Labels of
others weigh in only where a test ties the template to them: those of its host if the host's labelled
templates don't differ, those of the same path on other hosts if these don't; a template without
labels of its own is rejected only if the lower bound of such a pool's share says so, and allowed
where there is none. Each level is one written table, so plans stay as small for deep urls as for
short, and levels end where no node has enough urls left to keep a segment.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _buffers, _scratch
from tallyforge.llm.decontaminate import LOWER, UPPER

#: Share of a node's urls, and urls, that a segment needs to stay, and the z value of its labels
#: against its siblings' from which on it stays with a smaller share.
SHARE, SUPPORT, APART = 0.02, 3, 3.0
#: Labels that a prior share weighs, the z value beyond which branches or parts of a pool differ (by a
#: normal approximation of chi-square) and that a pool's lower bound takes, and the share of blocked
#: labels from which a template is rejected.
WEIGHT, DIFFERENT, REJECT = 2.0, 1.96, 0.5
#: Rules that a call takes: they become one expression.
RULES = 1000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as the module's callers define them; both empty for null or without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), null if none does. rules: {"host/path": "allow" or "block"}."""
    if len(rules) > RULES:
        raise ValueError(f"{len(rules)} rules; {RULES} at most")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda x: (len(x), x)):  # longer ones come last and win
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """The path's segments, variable ones by their kind."""

    def kind(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^[0-9]+$"), "<number>")
            .when(s.rlike(r"^[0-9]+\.[A-Za-z]{1,5}$"), F.concat(F.lit("<number>"), F.regexp_extract(s, r"\.[A-Za-z]+$", 0)))
            .when(s.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "<date>")
            .when(s.rlike(r"^[0-9a-fA-F-]{12,}$"), "<hash>")
            .when((F.length(s) >= 16) & s.rlike("[0-9]"), "<id>")
            .otherwise(s)
        )

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), kind)


def label_gap(a: Column, b: Column, all_a: Column, all_b: Column) -> Column:
    """z value of a part's blocked share against that of the rest; 0 where one has no labels."""
    own, rest_b = a + b, all_b - b
    rest = all_a + all_b - own
    pool = all_b / (own + rest)
    error = F.sqrt(pool * (1 - pool) * (1 / own + 1 / rest))
    return F.when((own > 0) & (rest > 0), F.when(error > 0, F.abs(b / own - rest_b / rest) / error)).otherwise(0.0)


def at_level(tree: DataFrame, k: int, among: Column) -> DataFrame:
    """tree with up (the path above level k, null for shorter paths and rows not among these) and segment."""
    deep = among & (F.size("t") >= k)
    return tree.withColumn("up", F.when(deep, F.array_join(F.slice("t", 1, k - 1), "/"))).withColumn("segment", F.when(deep, F.get("t", F.lit(k - 1))))


def renamed(tree: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """tree (of at_level) with segments of level k as names (host, up, segment, name, ends) has them;
    where it ends, that name stands for all deeper segments too and open becomes false."""
    named = tree.join(names, ["host", "up", "segment"], "left")
    head, rest = F.slice("t", 1, k - 1), F.size("t") - k
    below = F.when(F.col("ends"), F.array_repeat("name", rest)).otherwise(F.slice("t", F.lit(k + 1), rest))
    swap = F.when(F.col("name").isNotNull(), F.concat(head, F.array("name"), below)).otherwise(F.col("t"))
    still = F.col("open") & ~F.coalesce("ends", F.lit(False))
    return named.withColumns({"t": swap, "open": still}).drop("up", "segment", "name", "ends")


def generalised(tree: DataFrame, k: int) -> DataFrame:
    """tree with the variable segments of level k as *. Below a node with fewer than SUPPORT urls no
    segment can stay, so all its levels become * at once."""
    cut = at_level(tree, k, F.col("open"))
    own = cut.where("up is not null").groupBy("host", "up", "segment").agg(*(F.sum(c).alias(c) for c in "nab"))
    node = own.groupBy("host", "up").agg(*(F.sum(c).alias(f"all_{c}") for c in "nab"))
    z = F.coalesce(label_gap(F.col("a"), F.col("b"), F.col("all_a"), F.col("all_b")), F.lit(0.0))
    stays = (F.col("n") >= SUPPORT) & ((F.col("n") >= SHARE * F.col("all_n")) | (z >= APART))
    names = own.join(node, ["host", "up"]).where(~stays).select("host", "up", "segment", F.lit("*").alias("name"), (F.col("all_n") < SUPPORT).alias("ends"))
    return renamed(cut, names, k)


def merged(tree: DataFrame, k: int) -> DataFrame:
    """tree with the mergeable segments of level k under one name, {their family}."""
    cut = at_level(tree, k, F.lit(True))
    below = F.coalesce(F.get("t", F.lit(k)), F.lit("."))
    node, of_family = ["host", "up"], ["host", "up", "family"]
    child = cut.where("up is not null").groupBy(*node, "segment", below.alias("below")).agg(*(F.sum(c).alias(c) for c in "nab"))
    branch = child.groupBy(*node, "segment").agg(*(F.sum(c).alias(c) for c in "nab"), F.min_by("below", F.struct(-F.col("n"), "below")).alias("family"))
    family = branch.groupBy(*of_family).agg(F.count("*").alias("branches"), *(F.sum(c).alias(f"all_{c}") for c in "nab"))
    told = branch.join(family, of_family).where("branches > 1")
    parts = child.select(*node, "segment", "below", F.col("n").alias("part")).join(told, [*node, "segment"])
    pooled = parts.groupBy(*of_family, "below").agg(F.sum("part").alias("pooled"))
    expected = F.col("n") * F.col("pooled") / F.col("all_n")
    # Children that a branch lacks add what is expected of them: n in total, less those it has.
    cell = (F.col("part") - expected) * (F.col("part") - expected) / expected - expected
    tested = parts.join(pooled, [*of_family, "below"]).groupBy(*of_family, "segment", "n", "a", "b", "all_a", "all_b").agg((F.sum(cell) + F.col("n")).alias("chi"))
    kinds = pooled.groupBy(*of_family).agg((F.count("*") - 1).alias("free"))
    alike = F.col("chi") <= F.col("free") + DIFFERENT * F.sqrt(2 * F.col("free")) + 1e-9
    gap = F.coalesce(label_gap(F.col("a"), F.col("b"), F.col("all_a"), F.col("all_b")), F.lit(0.0))
    names = tested.join(kinds, of_family).where(alike & (gap < DIFFERENT)).select(*node, "segment", F.concat(F.lit("{"), "family", F.lit("}")).alias("name"), F.lit(False).alias("ends"))
    return renamed(cut, names, k)


def pool(labelled: DataFrame, key: str, part: str) -> DataFrame:
    """key, its labels ({key}_a, {key}_b) and {key}_tied: whether two or more of its parts have labels
    and a chi-square test finds no difference between their shares. labelled: a, b (labels) of key and part."""
    parts = labelled.where("a + b > 0").groupBy(key, part).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    own = F.col("a") + F.col("b")
    summed = parts.groupBy(key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("parts"), F.sum(F.col("b") * F.col("b") / own).alias("squares"))
    share, free = F.col("b") / own, F.col("parts") - 1
    chi = F.when(F.col("a") * F.col("b") > 0, (F.col("squares") - F.col("b") * share) / (share * (1 - share))).otherwise(0.0)
    alike = chi <= free + DIFFERENT * F.sqrt(2 * free) + 1e-9
    return summed.select(key, F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"), ((free > 0) & alike).alias(f"{key}_tied"))


def smoothed(b: Column, n: Column, prior: Column) -> Column:
    return (b + WEIGHT * prior) / (n + WEIGHT)


def templates(labelled: DataFrame) -> DataFrame:
    """host, shape, template, n_allow, n_block (of the template), share (blocked, drawn towards that of
    its host and paths), told (the labels that tell: its own, else those of the pools that it is tied
    to) and sure (the blocked share that these show: smoothed, or the lower bound of the pools').

    labelled: host, shape (array<string>), label ("allow", "block" or null), one row for each url.
    """
    paths = labelled.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count_if(F.col("label") == "allow").alias("a"), F.count_if(F.col("label") == "block").alias("b"))
    tree = _scratch.written(paths.withColumns({"t": F.col("shape"), "open": F.lit(True)}), "paths")
    every = tree.agg(F.max(F.size("t")).alias("depth"), F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    depth, left = 0, every.depth or 0
    while depth < left:
        depth += 1
        tree, old = _scratch.written(generalised(tree, depth), "level"), tree
        _scratch.free(old)
        left = tree.where("open").agg(F.max(F.size("t"))).first()[0] or 0
    tree = tree.withColumn("path", F.concat(F.lit("/"), F.array_join("t", "/")))
    for k in range(depth, 0, -1):
        tree = _scratch.written(merged(tree, k), "level")
    tree = tree.withColumn("template", F.concat(F.lit("/"), F.array_join("t", "/")))
    overall = F.lit(((every.b or 0) + WEIGHT * 0.5) / ((every.a or 0) + (every.b or 0) + WEIGHT))
    of_path, of_host = pool(tree, "path", "host"), pool(tree, "host", "template")
    # A template may have several paths: their labels count if all that have labels are tied.
    pathed = tree.groupBy("host", "template", "path").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).join(of_path, "path", "left")
    sums = (F.sum(x).alias(y) for x, y in {"a": "n_allow", "b": "n_block", "path_a": "path_a", "path_b": "path_b"}.items())
    near = pathed.groupBy("host", "template").agg(*sums, F.min("path_tied").alias("path_tied")).join(of_host, "host", "left")
    own = F.col("n_allow") + F.col("n_block")

    def pooled(key: str, tied: bool) -> tuple[Column, Column]:
        """Blocked and all labels of a pool; none of those that the template isn't tied to, if tied."""
        there = F.coalesce(f"{key}_tied", F.lit(False)) if tied else F.lit(True)
        a, b = (F.when(there, F.coalesce(f"{key}_{x}", F.lit(0))).otherwise(0) for x in "ab")
        return b, a + b

    near = near.withColumn("share", smoothed(F.col("n_block"), own, smoothed(*pooled("host", False), smoothed(*pooled("path", False), overall))))
    prior = smoothed(*pooled("host", True), smoothed(*pooled("path", True), overall))
    near = near.withColumns({"prior": prior, "told": F.when(own > 0, own).otherwise(pooled("host", True)[1] + pooled("path", True)[1])})
    bound = F.col("prior") - DIFFERENT * F.sqrt(F.col("prior") * (1 - F.col("prior")) / (F.col("told") + WEIGHT))
    sure = F.when(own > 0, smoothed(F.col("n_block"), own, F.col("prior"))).when(F.col("told") > 0, F.greatest(bound, F.lit(0.0))).otherwise(0.0)
    judged = near.select("host", "template", "n_allow", "n_block", "share", "told", sure.alias("sure"))
    return tree.select("host", "shape", "template").join(judged, ["host", "template"]).select("host", "shape", *judged.columns[1:])


def judge(pages: DataFrame, rules: dict[str, str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, n_allow, n_block, blocked_share, told of every row.

    A rule's verdict holds where one fits; other urls get their template's: block if blocked_share is REJECT or more.
    Urls of any length and depth are read whole.
    Null urls and urls without :// have an empty host and path; repeated rows each give a row; a
    null id stays null; other columns are ignored; an empty table gives an empty result.
    """
    host, path = split_url(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, label = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("id", "host", "path", rule.alias("rule"), label.alias("label"), shape(F.col("path")).alias("shape"))
    found = _scratch.written(templates(ruled), "templates")
    out = ruled.join(found, ["host", "shape"], "left")
    verdict = F.coalesce("label", F.when(F.col("sure") >= REJECT, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "n_allow", "n_block", F.col("sure").alias("blocked_share"), "told")
