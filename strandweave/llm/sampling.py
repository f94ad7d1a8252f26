"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.runtime import cut


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def sample_by_class(rows: DataFrame, klass: str, id_col: str, most: int, seed: str = "fit", in_all: int | None = None) -> DataFrame:
    """About `most` rows of each class at most, and about `in_all` of all classes, picked by a hash of the id, so that reruns agree.

    The share that each class gives follows from its count; what comes back is bounded by `most` times the
    number of classes and by `in_all` (or one row a class, where there are more classes than that), whatever
    the size of `rows`. Rows of a null class are left out.
    """
    counts = cut(rows.where(F.col(klass).isNotNull()).groupBy(F.col(klass).alias("_class")).agg(F.count("*").alias("_rows")))
    classes = counts.count()
    if in_all is not None and classes:
        most = max(1, min(most, in_all // classes))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    # a class and its count take some 50 bytes
    side = F.broadcast(counts) if classes <= 100_000 else counts
    return rows.join(side, F.col(klass) == F.col("_class")).where(u * F.col("_rows") < most).drop("_class", "_rows")
