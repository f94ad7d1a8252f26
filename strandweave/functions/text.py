"""Column expressions over paths and source text."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIM = r"(?U)^\s+|\s+$"


def dir_of(path: Column) -> Column:
    """The directory part; '' at top level."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def leaf_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def ancestors_of(path: Column) -> Column:
    """All proper directory prefixes, the nearest last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def split_lines(text: Column) -> Column:
    """Lines without terminators; no empty line after a final line feed, and none at all in an empty text."""
    raw = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(raw, -1) == "", F.slice(raw, F.lit(1), F.size(raw) - 1)).otherwise(raw)


def line_count(text: Column) -> Column:
    """Line feeds, and one more for an unterminated last line."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (feeds + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)).cast("long")


def lines_table(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_no from 1, line)."""
    at = F.posexplode(split_lines(F.col(text))).alias("k", "line")
    return files.select(F.col(path).alias("path"), at).select("path", (F.col("k") + 1).alias("line_no"), "line")


def shingles(text: Column, splitter: str = "\n", least_bytes: int = 4) -> Column:
    """Distinct trimmed pieces of at least `least_bytes` bytes."""
    pieces = F.transform(F.split(text, splitter), lambda x: F.regexp_replace(x, TRIM, ""))
    return F.array_distinct(F.filter(pieces, lambda x: F.octet_length(x) >= least_bytes))


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), TRIM, "")


def normalize_line(line: Column, marker: str = "//") -> Column:
    """The line with white space collapsed and a trailing comment cut, if an even number of quotes stands before it."""
    at = F.instr(line, marker)
    before = F.substring(line, F.lit(1), at - 1)
    quotes = F.length(before) - F.length(F.replace(before, F.lit('"'), F.lit("")))
    return collapse(F.when((at > 0) & (quotes % 2 == 0), before).otherwise(line))


def glob_holds(value: Column, glob: Column) -> Column:
    """`*` and `**` match all, `dir/**` the prefix `dir`, `pre*` and `*suf` prefix and suffix, else the whole."""
    cut = lambda c, n: F.substring(c, F.lit(1), F.length(c) - n)
    return (
        F.when(glob.isin("*", "**"), True)
        .when(glob.endswith("/**"), value.startswith(cut(glob, 3)))
        .when(glob.endswith("*"), value.startswith(cut(glob, 1)))
        .when(glob.startswith("*"), value.endswith(F.substring(glob, 2, 1 << 20)))
        .otherwise(value == glob)
    )


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_"))


def pascal(name: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(name, r"[^A-Za-z0-9]+"), lambda x: x != ""), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), "")


def fnv1a(data: bytes) -> int:
    """The 64-bit FNV-1a hash as an unsigned number."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a_of(text: Column) -> Column:
    """fnv1a() of a text's UTF-8 bytes, signed as a long; its products don't fit Spark's own arithmetic, so it is an Arrow function."""

    @F.pandas_udf("long")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            h = fnv1a(v.encode())
            return h - (1 << 64) if h >> 63 else h

        return values.map(one, na_action="ignore").astype("Int64")

    return run(text)


def hash_to_hex(value: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def hex_to_hash(text: Column) -> Column:
    """The long that 16 hex digits stand for; null for anything else."""
    unsigned = F.conv(text, 16, 10).cast("decimal(20,0)")
    signed = F.when(unsigned >= F.lit(str(1 << 63)).cast("decimal(20,0)"), unsigned - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(unsigned)
    return F.when(text.rlike("^[0-9a-fA-F]{16}$"), signed.cast("long"))


LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "js": "javascript", "c": "c", "h": "c", "cpp": "cpp", "go": "go", "java": "java", "md": "markdown", "toml": "toml", "txt": "text"}


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(table, extension_of(path))


def plane_of(path: Column) -> Column:
    return F.when(F.array_contains(F.split(path, "/"), "docs"), "docs").otherwise("code")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
