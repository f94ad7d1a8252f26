"""Exact and near duplicates of files, clones of bodies, and the leanness report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.text import line_count, shingles, union_all
from strandweave.runtime import cut, join_hot

MAX_BYTES, BINARY_PREFIX = 2_000_000, 8192


def file_facts(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(rel, subrepo, size, is_binary, lines, hash) from (rel, subrepo, content binary).

    Empty files and those over the cap have no hash, so they never count as copies of one another.
    """
    text = F.col("content").cast("string")
    size = F.octet_length("content").cast("long")
    binary = F.contains(F.substring("content", 1, BINARY_PREFIX), F.lit(b"\0")) | ~F.expr("is_valid_utf8(cast(content AS string))")
    hashed = (size > 0) & (size <= max_bytes)
    return files.select("rel", "subrepo", size.alias("size"), binary.alias("is_binary"), line_count(text).alias("lines"), F.when(hashed, F.sha2("content", 256)).alias("hash"))


def scan_counts(facts: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    return facts.agg(
        F.count("*").alias("files"),
        F.count_if(F.col("size").isNull()).alias("unreadable"),
        F.sum("size").alias("bytes"),
        F.count_if(F.col("size") > max_bytes).alias("over_cap"),
        F.count_if("is_binary").alias("binaries"),
        F.count_if(F.col("size") == 0).alias("empty"),
    )


def exact_dup_groups(facts: DataFrame) -> DataFrame:
    """(subrepo, hash, first, n, loc): contents that several files of one sub-repository have; loc is the first file's."""
    own = facts.where("hash IS NOT NULL").groupBy("subrepo", "hash")
    return own.agg(F.min("rel").alias("first"), F.count("*").alias("n"), F.min_by("lines", "rel").alias("loc")).where("n > 1")


def dup_members(facts: DataFrame) -> DataFrame:
    """(subrepo, hash, rel, first, n, loc): a row for each file of each group, in report order if sorted by waste_order().

    A content that a third of all files have meets its files by broadcast, so no group lies in one task.
    """
    rows = cut(facts.where("hash IS NOT NULL").select("subrepo", "hash", "rel", "lines"))
    groups = cut(exact_dup_groups(rows))
    joined = join_hot(rows.drop("lines"), groups.withColumn("_n", F.col("n")), ["subrepo", "hash"], "_n", max(1, rows.count()))
    return joined.where("first IS NOT NULL").select("subrepo", "hash", "rel", "first", "n", "loc")


def waste_order() -> list[Column]:
    """The order of a report's groups: the most wasted lines first, then by place and first file."""
    return [F.desc((F.col("n") - 1) * F.col("loc")), F.asc("subrepo"), F.asc("first")]


def dup_counts(facts: DataFrame) -> DataFrame:
    """(subrepo, hash, n, loc): the groups without their members, by an aggregate of fixed size."""
    return facts.where("hash IS NOT NULL").groupBy("subrepo", "hash").agg(F.count("*").alias("n"), F.min_by("lines", "rel").alias("loc")).where("n > 1")


def mirrors(facts: DataFrame) -> DataFrame:
    """(hash, subrepos): contents that more than one sub-repository has."""
    own = facts.where("hash IS NOT NULL").select("hash", "subrepo").distinct()
    return own.groupBy("hash").agg(F.count("*").alias("subrepos")).where("subrepos > 1")


def dup_waste(facts: DataFrame) -> DataFrame:
    return dup_counts(facts).agg(
        F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dup_files"), F.coalesce(F.sum((F.col("n") - 1) * F.col("loc")), F.lit(0)).alias("wasted_loc")
    )


def near_dup_pairs(files: DataFrame, threshold: float = 0.85, splitter: str = "\n", least: int = 8, most_common: int = 40, least_shared: int = 5) -> DataFrame:
    """(a, b, similarity) for files (rel, subrepo, text) of one sub-repository with threshold <= Jaccard < 1.

    Candidates share `least_shared` shingles that at most `most_common` files have, which bounds the pairs that
    a shingle gives; the similarity is that of the full sets. The set sizes travel with the pairs and the
    intersection is counted by joining shingles, so no set is looked up on the driver or broadcast.
    """
    sets = files.select("rel", "subrepo", shingles(F.col("text"), splitter).alias("s")).where(F.size("s") >= least)
    rows = sets.select("rel", "subrepo", F.size("s").alias("n"), F.explode("s").alias("shingle"))
    common = rows.groupBy("shingle").agg(F.count("*").alias("df"))
    kept = rows.join(common.where(F.col("df").between(2, most_common)), "shingle")
    x, y = kept.alias("x"), kept.alias("y")
    same = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.subrepo") == F.col("y.subrepo")) & (F.col("x.rel") < F.col("y.rel"))
    pairs = x.join(y, same).groupBy(F.col("x.rel").alias("a"), F.col("y.rel").alias("b")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared)
    arrays = sets.select("rel", "s")
    full = pairs.join(arrays.withColumnsRenamed({"rel": "a", "s": "sa"}), "a").join(arrays.withColumnsRenamed({"rel": "b", "s": "sb"}), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    out = full.withColumn("similarity", both / (F.size("sa") + F.size("sb") - both))
    return out.where((F.col("similarity") >= threshold) & (F.col("similarity") < 1)).select("a", "b", "similarity")


def clone_groups(bodies: DataFrame, least_lines: int = 6) -> DataFrame:
    """(body_hash, sites, lines, first) of bodies (file, name, line, body, lines) that occur at two places or more; first is the least place."""
    own = bodies.where(F.col("lines") >= least_lines).withColumn("body_hash", F.sha2(F.col("body").cast("binary"), 256))
    return own.groupBy("body_hash").agg(F.count("*").alias("sites"), F.first("lines").alias("lines"), F.min(F.struct("file", "name", "line")).alias("first")).where("sites > 1")


def clone_sites(bodies: DataFrame, least_lines: int = 6) -> DataFrame:
    """(body_hash, file, name, line, sites, lines): a row for each place of each clone; hot bodies are broadcast to their places."""
    own = cut(bodies.where(F.col("lines") >= least_lines).select(F.sha2(F.col("body").cast("binary"), 256).alias("body_hash"), "file", "name", "line", "lines"))
    groups = cut(own.groupBy("body_hash").agg(F.count("*").alias("sites")).where("sites > 1").withColumn("_n", F.col("sites")))
    return join_hot(own, groups, ["body_hash"], "_n", max(1, own.count())).where("sites IS NOT NULL").select("body_hash", "file", "name", "line", "sites", "lines")


def lean_metrics(tree_counts: DataFrame, facts: DataFrame, dead: DataFrame | None = None, misplaced: DataFrame | None = None) -> DataFrame:
    """One row: files, composites, empty composites (from the tree's (kind, files, is_root)), duplicates and the score.

    `dead` and `misplaced` are counted where a graph gives them; what wasn't measured is null, not 0.
    """
    tree = tree_counts.agg(
        F.count_if(F.col("kind") == "atom").alias("files"),
        F.count_if(F.col("kind") == "composite").alias("composites"),
        F.count_if((F.col("kind") == "composite") & (F.col("files") == 0) & ~F.col("is_root")).alias("empty"),
    )
    counted = lambda df, name: tree.select(F.lit(None).cast("long").alias(name)) if df is None else df.agg(F.count("*").alias(name))
    # five tables of one row
    both = tree.crossJoin(dup_waste(facts)).crossJoin(mirrors(facts).agg(F.count("*").alias("mirrors"))).crossJoin(counted(dead, "dead")).crossJoin(counted(misplaced, "misplaced"))
    ratio = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (0.7 * ratio("dup_files", "files") + 0.3 * ratio("empty", "composites"))))
    return both.select("files", "composites", "empty", "groups", "dup_files", "wasted_loc", "mirrors", score.alias("score"), "dead", "misplaced")


def regressions(report: DataFrame, baseline: dict[str, float | None]) -> DataFrame:
    """(metric, was, now) for what got worse than the baseline; unmeasured sides never regress."""
    checks = []
    for name in ("score", "dup_files", "empty", "dead", "misplaced"):
        was = F.lit(baseline.get(name)).cast("double")
        now = F.col(name).cast("double")
        worse = now < was - 1e-9 if name == "score" else now > was
        checks.append(report.where(worse).select(F.lit(name).alias("metric"), was.alias("was"), now.alias("now")))
    return union_all(checks)
