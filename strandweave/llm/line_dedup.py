"""Removal of passages that repeat, found by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.columns import only, place, placed
from strandweave.runtime import cut, join_hot

WINDOW = 3


_BLANK = "concat(' ', char(9), char(10), char(11), char(12), char(13))"
#: Documents with repeats, and lines that go from them, up to which these are broadcast: 32 and 4 bytes each.
FEW = 1_000_000


def _worded(lines: str) -> str:
    """The places of the lines that have a word, as SQL."""
    return f"filter(sequence(0, size({lines}) - 1), i -> trim(BOTH {_BLANK} FROM {lines}[i]) != '')"


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _h, at): where a window of three lines begins that an earlier place has too.

    Lines without a word are passed over, so a window is three lines with words that follow one another. Places
    are ordered by id (nulls first), the text's hash and the line; `at` counts lines with words from 0.
    Windows are compared by two 64-bit hashes. Only hashes and places are shuffled. The first place of each
    repeated window is found by aggregation before the shuffle, so a window that a third of all documents hold
    reaches the reducer as one row a task; on the way back such windows are broadcast (under a thousand of
    them, as each has over a thousandth of all places) and their places stay where they are.
    """
    rows = only(docs, id_col, text_col).toDF("_id", "_text").where("_text IS NOT NULL")
    rows = rows.select("_id", F.xxhash64("_text").alias("_h"), F.split("_text", "\n").alias("lines")).withColumn("worded", F.expr(_worded("lines")))
    rows = rows.where(F.size("worded") >= WINDOW)
    rows = rows.withColumn("a", F.expr("transform(worded, i -> xxhash64(lines[i]))")).withColumn("b", F.expr("transform(worded, i -> xxhash64('~', lines[i]))"))
    rows = rows.select("_id", "_h", "a", "b", F.explode(F.expr(f"sequence(0, size(a) - {WINDOW})")).alias("at"))
    at = lambda c: [F.expr(f"{c}[at + {k}]") for k in range(WINDOW)]
    places = rows.select("_id", "_h", "at", F.xxhash64(*at("a"), F.lit(1)).alias("w1"), F.xxhash64(*at("b"), F.lit(2)).alias("w2"))
    # read twice below: hashing again would cost more than these narrow rows in the shared folder
    places = cut(places)
    spot = F.struct("_id", "_h", "at")
    firsts = places.groupBy("w1", "w2").agg(F.min(spot).alias("first"), F.max(spot).alias("last"), F.count("*").alias("n")).where("first != last").drop("last")
    firsts = cut(firsts)
    found = join_hot(places, firsts, ["w1", "w2"], "n", max(1, places.count())).where("first IS NOT NULL")
    return found.where(~spot.eqNullSafe(F.col("first"))).select("_id", "_h", "at")


def _bit(bits: int) -> Column:
    return F.pmod(F.xxhash64("_id", "_h"), F.lit(bits))


def _bitmap(keys: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(_page, _bits): a bitmap over the hashes of (_id, _h) in pages of 32,768 bits, and how many bits there are.

    There are 16 bits for each of the `n` keys or more, 2**27 (16 MB) at most: with more keys than that more
    rows pass the test, and none that should fails it.
    """
    bits = 1 << min(27, max(15, (16 * n).bit_length()))
    rows = keys.select(_bit(bits).alias("_bit")).select(F.expr("_bit div 32768").alias("_page"), F.expr("_bit % 32768").alias("_at"))
    return rows.groupBy("_page").agg(F.bitmap_construct_agg("_at").alias("_bits")), bits


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """`docs` with its text rid of later occurrences, and the columns n_lines, n_removed; a row for each row.

    Of each window of three lines the first occurrence stays; the lines that any later one covers go, and what
    is left is joined by line feeds again. So each line's text stays somewhere, and a document that repeats
    another whole is left with an empty text. A null text stays null with 0 lines; texts of fewer than three
    lines with words stay as they are. Rows of one id and text are one document and keep their rows; rows of
    one id (or null) and different texts are different documents. Other columns are passed on, whatever their
    names, but for any named n_lines or n_removed in any case, which are replaced. An empty table gives an
    empty result.

    If no more than `few` documents have repeats and no more than `few` lines go, both counted first, they are
    broadcast. Else a bitmap of at most 16 MB picks the documents that may have some; only their texts are shuffled to meet them, all others stay.
    """
    own = placed(docs)
    ident, text = place(docs, id_col), place(docs, text_col)
    spots = repeated_windows(docs, id_col, text_col)
    covered = spots.groupBy("_id", "_h").agg(F.sort_array(F.collect_set("at")).alias("_at"))
    covered = cut(covered.select("_id", "_h", F.expr(f"array_distinct(flatten(transform(_at, s -> sequence(s, s + {WINDOW - 1}))))").alias("_gone")))
    size = covered.agg(F.count("*").alias("n"), F.sum(F.size("_gone")).alias("lines")).first()
    n, most = size["n"], max(size["n"], size["lines"] or 0)
    side = covered.select(F.col("_id").alias("_rid"), F.col("_h").alias("_rh"), "_gone")
    same = F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_h") == F.col("_rh"))
    rows = own.withColumns({"_id": F.col(ident), "_h": F.xxhash64(text)})
    if most <= few:
        joined = rows.join(F.broadcast(side), same, "left")
    else:
        pages, bits = _bitmap(covered, n)
        paged = rows.withColumn("_b", _bit(bits)).join(F.broadcast(pages), F.expr("_b div 32768 = _page"), "left")
        byte = "cast(conv(hex(substring(_bits, int(_b % 32768 div 8) + 1, 1)), 16, 10) AS int)"
        paged = paged.withColumn("_maybe", F.expr(f"_bits IS NOT NULL AND shiftright({byte}, int(_b % 8)) % 2 = 1"))
        maybe = paged.where("_maybe").select(*rows.columns).join(side, same, "left")
        joined = maybe.unionByName(paged.where("NOT _maybe").select(*rows.columns), allowMissingColumns=True)
    # only texts that lose lines are split
    joined = joined.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split(F.col(text), "\n")))
    feeds = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    joined = joined.withColumn("_worded", F.when(F.col("_gone").isNotNull(), F.expr(_worded("_lines"))))
    left = F.expr("array_except(sequence(0, size(_lines) - 1), transform(_gone, j -> _worded[j]))")
    joined = joined.withColumn("_left", F.when(F.col("_gone").isNotNull(), left))
    new = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.expr("array_join(transform(_left, i -> _lines[i]), '\n')"))
    kept = [(c, name) for c, name in zip(own.columns, docs.columns) if name.lower() not in ("n_lines", "n_removed")]
    counts = [F.coalesce(feeds + 1, F.lit(0)), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone"))]
    out = joined.select(*[new.alias(c) if c == text else F.col(c) for c, _ in kept], *[c.cast("long").alias(f"_n{i}") for i, c in enumerate(counts)])
    return out.toDF(*[name for _, name in kept], "n_lines", "n_removed")
