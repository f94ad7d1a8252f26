"""Per-document statistics over whole texts, for the quality operators."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.arrow import mapper, texts

BLANK = b" \t\n\x0b\x0c\r"
_SYMBOLS, _UPPER = b"#*$%&|<>", bytes(range(65, 91))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_distinct", "n_lines")
#: Ratios that the quality models read; nulls never occur in them.
RATIOS = {
    "r_words": "double(n_words)",
    "r_length": "word_chars / greatest(n_words, 1)",
    "r_symbols": "n_symbols / greatest(n_words, 1)",
    "r_dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "r_repeat": "n_repeat_words / greatest(n_words, 1)",
    "r_upper": "n_upper / greatest(word_chars, 1)",
    "r_marks": "n_marks / greatest(word_chars, 1)",
    "r_distinct": "n_distinct / greatest(n_words, 1)",
}


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """The words that lie in some window of `size` words found twice or more in the text, first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, to = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + size - max(i, to)
            to = i + size
    return covered


def describe(text: bytes | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(NAMES)
    words, lines = text.split(), Counter(line for line in text.split(b"\n") if line.split(None, 1))
    without = text.translate(None, BLANK)
    chars = len(without.decode("utf-8", "replace"))
    gone = lambda chars: len(without) - len(without.translate(None, chars))
    return (
        len(words),
        chars,
        gone(_SYMBOLS),
        sum(lines.values()) - len(lines),
        repeated_words(words),
        gone(_UPPER),
        gone(_MARKS),
        len(set(words)),
        sum(lines.values()),
    )


def text_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of `docs` and the statistics of its text: zero for a null or empty one."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [describe(t) for t in texts(batch.column(batch.num_columns - 1))]
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(NAMES))]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*keep, *NAMES])

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join([*(f"`{k}` {dict(rows.dtypes)[k]}" for k in keep), *(f"{n} long" for n in NAMES)])
    return rows.mapInArrow(mapper(one), schema)


def with_ratios(stats: DataFrame) -> DataFrame:
    return stats.withColumns({k: F.expr(v) for k, v in RATIOS.items()})
