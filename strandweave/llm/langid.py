"""Language identification: known words first, then character n-grams from long to short."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.arrow import mapper, texts
from strandweave.llm.columns import only
from strandweave.llm.sampling import fold, sample_by_class

_RUN = re.compile(r"[^\W\d_]+")
#: Words whose scores a worker keeps; when it is full it starts anew.
_ROWS = 1 << 17


def words_of(text: str) -> list[str]:
    return _RUN.findall(text.lower())


def _lettered(words: Counter) -> bool:
    return any(any(c.isalpha() for c in w) for w in words)


def grams_of(word: str, size: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


@dataclass
class Model:
    """Log frequencies by language: a row of `table` for each known word and n-gram. The sample it was fitted on bounds its size."""

    langs: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]  # by size - 1
    table: np.ndarray
    unseen: np.ndarray
    _row: dict[str, int] = field(default_factory=dict)
    _cache: np.ndarray | None = None

    @classmethod
    def of(cls, langs: list[str], words: dict[str, np.ndarray], grams: list[dict[str, np.ndarray]], unseen: np.ndarray) -> Model:
        rows: list[np.ndarray] = []

        def placed(known: dict[str, np.ndarray]) -> dict[str, int]:
            at = {k: len(rows) + i for i, k in enumerate(known)}
            rows.extend(known.values())
            return at

        return cls(langs, placed(words), [placed(g) for g in grams], np.array(rows, dtype=float).reshape(-1, len(langs)), unseen)

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "words": self.words, "grams": self.grams, "table": self.table, "unseen": self.unseen}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _row={}, _cache=None)

    def word_score(self, word: str) -> np.ndarray:
        """The word's log frequencies; for an unseen word the mean over its places, each by the longest known n-gram there."""
        known = self.words.get(word)
        if known is not None:
            return self.table[known]
        marked, rows, missed, longest = f"^{word}$", [], 0, len(self.grams)
        for i in range(len(marked)):
            for size in range(min(longest, len(marked) - i), 0, -1):
                hit = self.grams[size - 1].get(marked[i : i + size])
                if hit is not None:
                    rows.append(hit)
                    break
            else:
                missed += 1
        return (self.table[rows].sum(axis=0) + missed * self.unseen) / len(marked)

    def _index(self, word: str) -> int:
        at = self._row[word] = len(self._row)
        self._cache[at] = self.word_score(word)
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the greatest sum over the words, and its share by the mean over the words: one average word's posterior."""
        if not text:
            return "und", 0.0
        counts = Counter(words_of(text))
        if not self.langs or not _lettered(counts):
            return "und", 0.0
        total, items = np.zeros(len(self.langs)), list(counts.items())
        block = min(4096, _ROWS)
        for at in range(0, len(items), block):
            some = items[at : at + block]
            # rows and table start anew together, and only between blocks, as a block's rows point into the table
            if self._cache is None or len(self._row) + len(some) > _ROWS:
                self._row, self._cache = {}, np.empty((_ROWS, len(self.langs)))
            get, index = self._row.get, self._index
            rows = [index(w) if (r := get(w)) is None else r for w, _ in some]
            total += np.array([c for _, c in some], dtype=float) @ self._cache[rows]
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp((total - total[best]) / sum(counts.values())).sum())


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_lang: int = 1500,
    docs_in_all: int = 30_000,
    longest_gram: int = 5,
) -> Model:
    """A model from about `docs_per_lang` whole documents of each language and `docs_in_all` of all, those with text and language.

    Every word and every n-gram of up to `longest_gram` characters in them is learned, so the tables that reach
    the driver are bounded by the sample alone.
    """
    have = only(docs, id_col, text_col, lang_col).toDF("id", "text", "lang").withColumn("lang", F.col("lang").cast("string"))
    have = have.where("lang IS NOT NULL AND text IS NOT NULL AND id IS NOT NULL")
    picked = sample_by_class(have, "lang", "id", docs_per_lang, in_all=docs_in_all)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for text, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                seen[lang].update(words_of(text.decode("utf-8", "replace")))
        # n-grams come from each distinct word once, with its count
        counts: dict[tuple[str, int], Counter] = defaultdict(Counter)
        for lang, words in seen.items():
            counts[lang, 0] = words
            for word, n in words.items():
                for size in range(1, longest_gram + 1):
                    own = counts[lang, size]
                    for gram in grams_of(word, size):
                        own[gram] += n
        for (lang, size), own in counts.items():
            if own:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own)), pa.array([size] * len(own), pa.int32()), pa.array(list(own)), pa.array(list(own.values()))],
                    ["lang", "size", "gram", "n"],
                )

    # the sample is small and may lie in a few files: spread over all cores
    spread = picked.select("text", "lang").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    rows = spread.mapInArrow(run, "lang string, size int, gram string, n long")
    got = rows.groupBy("size", "gram", "lang").agg(F.sum("n").alias("n")).toArrow()
    return _model(*(got[c].combine_chunks() for c in ("size", "gram", "lang", "n")), longest_gram)


def _model(size: pa.Array, gram: pa.Array, lang: pa.Array, n: pa.Array, longest_gram: int) -> Model:
    """Counts as log((count + 0.1) / (all of that size in the language + 1))."""
    lang, n, size = lang.dictionary_encode(), n.to_numpy(zero_copy_only=False).astype(float), size.to_numpy(zero_copy_only=False)
    langs = sorted(lang.dictionary.to_pylist())
    column = np.array([langs.index(name) for name in lang.dictionary.to_pylist()], dtype=int)[lang.indices.to_numpy()] if langs else np.zeros(0, int)
    parts, tables, at = [], [], 0
    for s in range(longest_gram + 1):
        own = np.flatnonzero(size == s)
        names = gram.take(pa.array(own)).dictionary_encode()
        counts = np.zeros((len(names.dictionary), len(langs)))
        np.add.at(counts, (names.indices.to_numpy(), column[own]), n[own])
        tables.append(np.log((counts + 0.1) / (counts.sum(axis=0) + 1.0)))
        parts.append({name: at + i for i, name in enumerate(names.dictionary.to_pylist())})
        at += len(counts)
    return Model(langs, parts[0], parts[1:], np.concatenate(tables), np.full(len(langs), -20.0))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): a row for each row of `docs`.

    A null text, an empty one and one without letters give `und` with score 0; so does a model that learned
    no language. The score is the language's posterior for one average word of the text, all languages being
    as likely beforehand; a text of two languages has about a half. Ties go to the language that sorts first. held_out is crc32(id) mod 4 = 2, false for a null id. Repeated
    rows each keep their row; columns of other names play no part. Long texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(None if t is None else t.decode("utf-8", "replace")) for t in texts(batch.column(2))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            ["doc_id", "held_out", "lang_pred", "score"],
        )

    rows = only(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(mapper(one), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def held_in(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What a model may learn from: the documents outside the held-out fold."""
    return docs.where(fold(id_col) != 2)
