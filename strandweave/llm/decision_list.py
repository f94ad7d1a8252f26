"""Quality rules: an ordered list of threshold conjunctions learned by sequential covering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.columns import only, place, placed
from strandweave.llm.sampling import fold, sample_by_class
from strandweave.llm.stats import NAMES, RATIOS, text_stats, with_ratios


#: Documents that fail whatever the learned list says.
BASE_FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


@dataclass(frozen=True)
class Test:
    name: str
    above: bool
    limit: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.name] > self.limit if self.above else rows[self.name] <= self.limit

    def sql(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.limit!r}D"


@dataclass(frozen=True)
class Rule:
    tests: tuple[Test, ...]
    precision: float
    covers: int

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([t.holds(rows) for t in self.tests])

    def sql(self) -> str:
        return " AND ".join(t.sql() for t in self.tests)


def _gain(before: tuple[int, int], p: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(before[0] / sum(before))), -np.inf)


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, most_tests: int) -> list[Test]:
    """Adds the test of greatest information gain until only bad rows are covered."""
    inside, tests = np.ones(len(bad), dtype=bool), []
    while len(tests) < most_tests:
        here = (int(bad[inside].sum()), int((~bad[inside]).sum()))
        if not here[0] or not here[1]:
            break
        best: tuple[float, Test | None] = (1e-9, None)
        for name, all_values in rows.items():
            values, own = all_values[inside], bad[inside]
            order = np.argsort(values, kind="stable")
            values, own = values[order], own[order]
            cuts = np.flatnonzero(values[1:] > values[:-1])
            if not len(cuts):
                continue
            p = np.cumsum(own)[cuts].astype(float)
            n = (cuts + 1) - p
            for above, g in ((False, _gain(here, p, n)), (True, _gain(here, here[0] - p, here[1] - n))):
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    limit = float((values[cuts[k]] + values[cuts[k] + 1]) / 2)
                    best = (float(g[k]), Test(name, above, limit))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= best[1].holds(rows)
    return tests


def _score(tests: list[Test], rows: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int, int]:
    inside = Rule(tuple(tests), 0, 0).holds(rows)
    p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p, n


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 16, most_tests: int = 3, least_precision: float = 0.97, least_covered: int = 3) -> list[Rule]:
    """Rules for bad rows, each grown on two thirds of the rows that are left and pruned on the rest.

    A rule whose precision on the rows it was pruned on, or on all rows left, is under `least_precision` ends
    the list: documents that no rule is sure about are kept.
    """
    rng, rules = np.random.default_rng(7), []
    while len(bad) and bad.any() and len(rules) < most_rules:
        part = rng.random(len(bad)) < 2 / 3
        first, second = ({k: v[m] for k, v in rows.items()} for m in (part, ~part))
        tests = _grow(first, bad[part], most_tests)
        if not tests:
            break
        scored = [(_score(tests[:k], second, bad[~part])[0], -k) for k in range(1, len(tests) + 1)]
        tests = tests[: -max(scored)[1]]
        _, p, n = _score(tests, rows, bad)
        _, p2, n2 = _score(tests, second, bad[~part])
        if p < least_covered or p < least_precision * (p + n) or p2 < least_precision * (p2 + n2):
            break
        rules.append(Rule(tuple(tests), p / (p + n), p + n))
        left = ~rules[-1].holds(rows)
        rows, bad = {k: v[left] for k, v in rows.items()}, bad[left]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for documents to keep: the first rule that holds rejects, the default keeps."""
    out = None
    for r in rules:
        out = F.when(F.expr(r.sql()), F.lit(False)) if out is None else out.when(F.expr(r.sql()), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fired(rules: list[Rule]) -> Column:
    """The number of the rule that rejects, from 1; null where none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(F.expr(rules[k - 1].sql()), F.lit(k)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 6000, held_out: int | None = 2) -> list[Rule]:
    """Rules from the statistics of about `most` labelled documents of each class outside the fold `held_out`.

    Documents that fail the base teach nothing, as the list never judges them. A document with several labels counts as bad if any of them is 0; null labels, null ids and ids without a
    document are passed over. Without labels of both classes the list is empty and keeps everything.
    """
    own = only(labels, id_col, label_col).toDF("id", "label").withColumn("label", F.col("label").cast("int")).where("id IS NOT NULL AND label IS NOT NULL")
    if held_out is not None:
        own = own.where(fold("id") != held_out)
    own = sample_by_class(own.groupBy("id").agg(F.min("label").alias("label")), "label", "id", most, "rules")
    texts = only(docs, id_col, text_col).toDF("id", "text").join(F.broadcast(own), "id")
    seen = with_ratios(text_stats(texts, ["id", "label"]).where(f"NOT {BASE_FAILED}")).groupBy("id").agg(*[F.first(c).alias(c) for c in ("label", *RATIOS)])
    # one row per sampled label at most: bounded by `most` times the number of label values
    got = seen.orderBy("id").toPandas()
    if got.empty:
        return []
    return learn({k: got[k].to_numpy(float) for k in RATIOS}, got["label"].to_numpy() == 0)


def apply_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the statistics, base_failed, rule, kept): a row for each row of `docs`.

    A null or empty text has no words and fails the base. Null and repeated ids keep their rows, as do repeated
    rows; columns of other names play no part. Texts are read whole.
    """
    rows = with_ratios(text_stats(only(docs, id_col, text_col).toDF("doc_id", "text"), ["doc_id"]))
    rows = rows.withColumn("base_failed", F.expr(BASE_FAILED))
    return rows.select("doc_id", *NAMES, "base_failed", fired(rules).alias("rule"), (~F.col("base_failed") & verdict(rules)).alias("kept"))


def kept_rows(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the base and the list keep, with their own columns, in one pass and without a join."""
    own = placed(docs)
    rows = with_ratios(text_stats(own, own.columns, place(docs, text_col)))
    rows = rows.where(~F.expr(BASE_FAILED) & verdict(rules))
    return rows.select(*own.columns).toDF(*docs.columns)
