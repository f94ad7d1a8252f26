"""Mixing sources to target weights by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.columns import only, place, placed
from strandweave.runtime import cut, join_hot

#: Sources up to which their rates are broadcast: some 100 bytes each.
FEW = 100_000


def word_count(text: Column) -> Column:
    """The number of `[^\\x20\\x09-\\x0D]+` in `text`; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of `sizes` (source, source_size, and what else it has), one for each source, with its target.

    Sources by code point, null last, take `weights` in turn. They share `share` times all sizes by weight;
    none gets over `most` times its size, and what is over goes to the others by weight. The level at which
    the last ones share follows from the sources in order of size by weight, so no iteration is needed.
    The windows hold one narrow row for each source.
    """
    others = sizes.columns
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("level", F.col("cap") / F.col("weight"))
    before = Window.orderBy("level", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("weight_left", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    rows = rows.withColumn("asked", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    # rises while sources below their fair share fill up and falls after, so its greatest value is the level
    own = (F.col("asked") - F.col("full")) / F.col("weight_left")
    rows = rows.withColumn("common", F.max(own).over(Window.partitionBy()))
    return rows.select(*others, F.least(F.col("cap"), F.coalesce(F.col("common") * F.col("weight"), F.col("cap"))).alias("target"))


def uniform(id_col: str) -> Column:
    """A number in [0, 1) that follows from the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def _rated(rows: DataFrame, few: int) -> DataFrame:
    """`rows` (_source, _size and others) with source_size and target of its source."""
    sizes = rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"), F.count("*").alias("_n"))
    plan = cut(targets(sizes).withColumnRenamed("source", "_source"))
    if plan.count() <= few:
        plan = F.broadcast(plan.drop("_n").withColumnRenamed("_source", "_s"))
        return rows.join(plan, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    return join_hot(rows, plan, ["_source"], "_n", max(1, plan.agg(F.sum("_n")).first()[0] or 0))


def _copies() -> Column:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    return (whole + F.when(uniform("_id") < rate - whole, 1).otherwise(0)).cast("long")


def planned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", few: int = FEW) -> DataFrame:
    """(doc_id, size, source_size, target, copies): a row for each row of `docs`.

    copies is floor(target / source_size), and one more where the id's number falls under the fraction. A null
    text has size 0; so has an empty one. A source of size 0 has target 0 and no copies. The null source is a
    source like any other, last in order. Rows of equal or null id share their number; repeated rows keep
    their rows. Columns of other names play no part. Words are counted once, where a text is read, and kept
    in narrow rows. Sizes are summed before the shuffle. The rates of up to `few` sources, counted first, are
    broadcast, so that no document moves; of more, those of sources with over a thousandth of all rows are,
    and the other sources meet in a shuffle. An empty table gives an empty result.
    """
    own = only(docs, id_col, text_col, source_col).toDF("_id", "_text", "_source")
    rows = _rated(cut(own.select("_id", F.col("_source").cast("string").alias("_source"), word_count(F.col("_text")).alias("_size"))), few)
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", _copies().alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", few: int = FEW) -> DataFrame:
    """The rows of `docs`, each as often as its source's rate says; the columns stay as they are.

    Nulls, ties and repeated rows count as in planned(). The texts are read twice, once for the sizes and once
    for the copies, whose rates don't depend on the row's own size.
    """
    own = placed(docs)
    named = {place(docs, id_col): "_id", place(docs, source_col): "_source", place(docs, text_col): "_text"}
    rows = own.select(*own.columns, *[F.col(c).cast("string").alias(n) if n == "_source" else F.col(c).alias(n) for c, n in named.items()])
    rows = _rated(rows.withColumn("_size", word_count(F.col("_text"))).drop("_text"), few)
    rows = rows.withColumn("_copies", _copies())
    return rows.select(*own.columns, F.explode(F.expr("array_repeat(0, int(_copies))")).alias("_copy")).select(*own.columns).toDF(*docs.columns)
