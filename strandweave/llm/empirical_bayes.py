"""Quality classifier: a document's own evidence over the posterior of its site."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.columns import only, place, placed
from strandweave.llm.sampling import fold, sample_by_class
from strandweave.llm.stats import RATIOS, text_stats, with_ratios
from strandweave.runtime import cut, join_hot

_EDGE = 1e-4


@dataclass(frozen=True)
class Evidence:
    """A logistic model over document statistics: P(good) where good documents have the share `prior`."""

    names: tuple[str, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    prior: float = 0.5

    def column(self) -> Column:
        z = F.lit(self.bias)
        for name, c, s, w in zip(self.names, self.center, self.scale, self.weights):
            x = F.least(F.lit(6.0), F.greatest(F.lit(-6.0), (F.log1p(F.col(name)) - c) / s))
            z = z + x * w
        return F.least(F.lit(1 - _EDGE), F.greatest(F.lit(_EDGE), 1 / (1 + F.exp(-z))))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 6000, held_out: int | None = 2) -> Evidence:
    """The document classifier from about `most` labelled documents of each class outside the fold `held_out`.

    Classes that are thinned out to `most` come back to their share of all labels in the intercept, so scores
    don't shift with the number of labels. Null labels and ids are passed over. With no labels of one class the
    evidence is the same for all documents.
    """
    own = only(labels, id_col, label_col).toDF("id", "label").withColumn("label", F.col("label").cast("int")).where("id IS NOT NULL AND label IS NOT NULL")
    if held_out is not None:
        own = own.where(fold("id") != held_out)
    own = own.groupBy("id").agg(F.min("label").alias("label"))
    share = own.agg(F.avg((F.col("label") > 0).cast("double"))).first()[0]
    own = sample_by_class(own, "label", "id", most, "evidence")
    texts = only(docs, id_col, text_col).toDF("id", "text").join(F.broadcast(own), "id")
    seen = with_ratios(text_stats(texts, ["id", "label"])).groupBy("id").agg(*[F.first(c).alias(c) for c in ("label", *RATIOS)])
    got = seen.orderBy("id").toPandas()  # bounded by the sample
    names = tuple(RATIOS)
    y = (got["label"].to_numpy() > 0).astype(float) if len(got) else np.zeros(0)
    if not len(y) or y.min() == y.max():
        flat = float(np.clip(y.mean() if len(y) else 0.5, _EDGE, 1 - _EDGE))
        return Evidence((), (), (), (), _logit(flat), flat)
    x = np.log1p(got[list(names)].to_numpy(float))
    center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    w = _logistic(np.clip((x - center) / scale, -6, 6), y)
    prior = float(np.clip(share, _EDGE, 1 - _EDGE))
    return Evidence(names, tuple(map(float, center)), tuple(map(float, scale)), tuple(map(float, w[:-1])), float(w[-1]) + _logit(prior) - _logit(float(y.mean())), prior)


def _strength(between: float, prior: float) -> float:
    """The weight of a Beta prior, in documents, by the method of moments: large where sites hardly differ."""
    return float(np.clip(prior * (1 - prior) / max(between, 1e-6) - 1, 1.0, 1e4))


def _between(groups: DataFrame, mean: Column, n: str, k: str) -> float:
    """Variance of the sites' true rates around `mean`: that observed less what the documents' own spread gives."""
    row = groups.agg(
        F.sum(F.col(n) * F.pow(F.col(k) / F.col(n) - mean, 2)).alias("seen"),
        F.sum(mean * (1 - mean)).alias("noise"),
        F.sum(n).alias("n"),
    ).first()
    return max(0.0, ((row["seen"] or 0.0) - (row["noise"] or 0.0)) / row["n"]) if row["n"] else 0.0


def classify(docs: DataFrame, evidence: Evidence, id_col: str, text_col: str, host: Column, path: Column, cutoff: float = 0.5) -> DataFrame:
    """(doc_id, host, path, p_doc, host_rate, path_rate, p_quality, kept): a row for each row of `docs`.

    p_doc is the document's own probability at the labels' share of good documents, which is taken out again
    where the site's rate stands in for it. Summed by site it gives soft counts; a host's rate shrinks toward
    the global rate, a path's toward its host's, each by the strength that the spread between sites bears out.
    A document's own share is left out of the site rates it is judged by, so a site with one document falls
    back to its host and a host with one to the global rate. Null hosts and paths are sites of their own. Null
    and empty texts have p_doc of a document without words; null or repeated ids and repeated rows keep their
    rows; an empty table gives an empty result; other columns play no part.
    """
    own = placed(docs.select("*", host.cast("string"), path.cast("string")))
    rows = own.select(*[F.col(c).alias(n) for c, n in zip([place(docs, id_col), *own.columns[-2:], place(docs, text_col)], ["doc_id", "host", "path", "text"])])
    scored = cut(with_ratios(text_stats(rows, ["doc_id", "host", "path"])).select("doc_id", "host", "path", evidence.column().alias("p_doc")))
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("k")))
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk")))
    whole = hosts.agg(F.sum("hn").alias("n"), F.sum("hk").alias("k")).first()
    total = whole["n"] or 0
    prior = float(np.clip((whole["k"] or 0) / total, _EDGE, 1 - _EDGE)) if total else 0.5
    host_s = _strength(_between(hosts, F.lit(prior), "hn", "hk"), prior)
    sites = paths.withColumn("m", F.col("n")).join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    rate = (F.col("hk") + host_s * prior) / (F.col("hn") + host_s)
    path_s = _strength(_between(sites, rate, "n", "k"), prior)
    joined = join_hot(scored, sites, ["host", "path"], "n", max(1, total))
    return _posterior(joined, evidence.prior, prior, host_s, path_s, cutoff)


def _posterior(rows: DataFrame, fitted: float, prior: float, host_s: float, path_s: float, cutoff: float) -> DataFrame:
    p = F.col("p_doc")
    host_rate = (F.col("hk") - p + host_s * prior) / (F.col("hn") - 1 + host_s)
    rows = rows.withColumn("host_rate", F.least(F.lit(1 - _EDGE), F.greatest(F.lit(_EDGE), host_rate)))
    path_rate = (F.col("k") - p + path_s * F.col("host_rate")) / (F.col("m") - 1 + path_s)
    rows = rows.withColumn("path_rate", F.least(F.lit(1 - _EDGE), F.greatest(F.lit(_EDGE), path_rate)))
    odds = lambda c: F.log(c / (1 - c))
    z = odds(p) - _logit(fitted) + odds(F.col("path_rate"))
    rows = rows.withColumn("p_quality", 1 / (1 + F.exp(-z)))
    return rows.select("doc_id", "host", "path", "p_doc", "host_rate", "path_rate", "p_quality", (F.col("p_quality") >= cutoff).alias("kept"))
