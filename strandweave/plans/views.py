"""The driver's tables seen as files, trees, graphs, facts and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions.text import union_all
from strandweave.plans.facts import fact
from strandweave.runtime import table


def files(spark: SparkSession, sf_dir: str, subrepo: str = "source") -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rel = F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(rel.alias("rel"), F.col(subrepo).alias("subrepo"), F.col("text").cast("binary").alias("content"), "text")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandweave.functions.text import lines_table

    return lines_table(files(spark, sf_dir), "rel")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation, customer, order as composites; the distinct lines of orders as atoms, their quantity as size."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    node = lambda df, i, p, kind="composite", loc=None: df.select(i.alias("id"), p.cast("string").alias("parent"), F.lit(kind).alias("kind"), (F.lit(None) if loc is None else loc).cast("long").alias("loc"))
    # the lines of an order lie together, so that what is summed or looked up by order is so before it is shuffled
    items = t("lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    return union_all(
        [
            node(spark.range(1), F.lit("root"), F.lit(None)),
            node(t("region"), name("r", "r_regionkey"), F.lit("root")),
            node(t("nation"), name("n", "n_nationkey"), name("r", "n_regionkey")),
            node(t("customer"), name("c", "c_custkey"), name("n", "c_nationkey")),
            node(t("orders"), name("o", "o_orderkey"), name("c", "o_custkey")),
            node(items, F.concat(name("o", "l_orderkey"), F.lit("/"), F.col("l_linenumber").cast("string")), name("o", "l_orderkey"), "atom", F.col("q")),
        ]
    )


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, file), each once."""
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("file")).distinct()


def part_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): keys of parts on consecutive lines of an order, each pair once."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").where("l_partkey IS NOT NULL")
    after = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b"))
    return rows.withColumnRenamed("l_partkey", "a").join(after, ["l_orderkey", "l_linenumber"]).select("a", "b").distinct()


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): parts on consecutive lines of an order; a file's directory is its brand."""
    parts = part_files(spark, sf_dir)
    # pairs of keys before the names, which hold the key and so differ with it
    named = lambda c: parts.select(F.col("p_partkey").alias(c), F.col("file").alias("src" if c == "a" else "dst"))
    return part_pairs(spark, sf_dir).join(named("b"), "b").join(named("a"), "a").where("src != dst").select("src", "dst")


def key_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as depends-on facts, and names as texts that a traversal passes over."""
    t = lambda n: table(spark, sf_dir, n)
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    return union_all(
        [
            fact(t("orders"), name("order", "o_orderkey"), "depends-on", name("customer", "o_custkey")),
            fact(t("customer"), name("customer", "c_custkey"), "depends-on", name("nation", "c_nationkey")),
            fact(t("nation"), name("nation", "n_nationkey"), "depends-on", name("region", "n_regionkey")),
            fact(t("supplier"), name("supplier", "s_suppkey"), "depends-on", name("nation", "s_nationkey")),
            fact(t("nation"), name("nation", "n_nationkey"), "depends-on", text=F.col("n_name")),
            fact(t("region"), name("region", "r_regionkey"), "named", text=F.col("r_name")),
        ]
    )


def ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(references, enclosers): errors of a user, and the spans from a signup to the second one after."""
    e = table(spark, sf_dir, "events")
    ups = Window.partitionBy("user_id").orderBy("ts", "event_id")
    spans = e.where("event_type = 'signup'").withColumn("end", F.lead("ts", 2).over(ups)).where("end IS NOT NULL")
    owners = spans.select(F.col("user_id").alias("file"), F.col("event_id").alias("owner"), F.col("ts").alias("start"), "end", F.col("event_id").alias("ord"))
    refs = e.where("event_type = 'error'").select(F.col("user_id").alias("file"), F.col("event_id").alias("ref"), F.col("ts").alias("at"))
    return refs, owners
