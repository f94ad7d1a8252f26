"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.runtime import cut

_BLOCK = 4096


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, docs): how many rows of `lengths` have each length; null lengths are left out."""
    return lengths.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count("*").alias("docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """(n_tokens, docs, docs_longer, tokens_longer, docs_upto, tokens_upto, tokens_kept): a row for each length that occurs.

    With n_tokens taken as a context limit, docs_longer documents are cut and tokens_kept = tokens_upto +
    n_tokens * docs_longer is the corpus's total after truncation. Lengths are summed within blocks of 4096
    lengths and blocks among themselves, so no task holds all lengths. An empty histogram gives no rows.
    """
    # read for the blocks and for the rows: without the cut the corpus would be encoded for each
    rows = cut(hist).withColumn("block", F.expr(f"n_tokens div {_BLOCK}")).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t0"),
        F.sum("bd").over(Window.partitionBy()).alias("d1"),
        F.sum("bt").over(Window.partitionBy()).alias("t1"),
    )
    upto = Window.partitionBy("block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(blocks, "block").withColumn("docs_upto", F.col("d0") + F.sum("docs").over(upto)).withColumn("tokens_upto", F.col("t0") + F.sum("tokens").over(upto))
    rows = rows.withColumn("docs_longer", F.col("d1") - F.col("docs_upto")).withColumn("tokens_longer", F.col("t1") - F.col("tokens_upto"))
    return rows.select(
        "n_tokens", "docs", "docs_longer", "tokens_longer", "docs_upto", "tokens_upto", (F.col("tokens_upto") + F.col("n_tokens") * F.col("docs_longer")).alias("tokens_kept")
    )


class LengthTable:
    """Answers about every limit from one table of suffix sums, kept in the shared folder; the corpus isn't read again."""

    def __init__(self, lengths: DataFrame, length_col: str = "n_tokens"):
        self.sums = cut(suffix_sums(histogram(lengths, length_col)))

    def totals(self) -> tuple[int, int]:
        """Documents and tokens in all."""
        row = self.sums.agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n_tokens")).alias("t")).first()
        return row["d"] or 0, row["t"] or 0

    def truncated(self, limit: int) -> int:
        """Tokens that remain if each document is cut to `limit` tokens."""
        row = self.sums.where(F.col("n_tokens") <= limit).orderBy(F.desc("n_tokens")).select("tokens_upto", "docs_longer").first()
        return row["tokens_upto"] + limit * row["docs_longer"] if row else max(0, limit) * self.totals()[0]

    def quantile(self, q: float) -> int | None:
        """The least length that a share `q` of the documents does not exceed; None for an empty table."""
        row = self.sums.where((F.col("docs_upto") >= q * (F.col("docs_upto") + F.col("docs_longer")))).orderBy("n_tokens").select("n_tokens").first()
        return row["n_tokens"] if row else None
