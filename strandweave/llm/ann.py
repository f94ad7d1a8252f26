"""Approximate nearest neighbours: an inverted file over coarse centroids, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.llm.columns import only
from strandweave.runtime import cut

#: Rows and queries that meet in one task's group at most, about.
ROWS_A_GROUP, QUERIES_A_GROUP = 4096, 1024
#: How far a quantised cosine may be off, in standard deviations of the part that quantising lost.
DEVIATIONS = 3.0


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """At most `k` centroids, each the mean of its rows; rows that repeat don't start two of them."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centers = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        sums, counts = np.zeros_like(centers), np.bincount(own, minlength=len(centers))
        np.add.at(sums, own, x)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[at : at + 4096] @ centers.T - half, axis=1) for at in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def grown(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """About `k` centroids trained in two steps, sqrt(k) wide ones and some within each by its share of the rows, so that neighbours follow one another."""
    if k <= 16:
        return kmeans(x, k, seed)
    wide = kmeans(x, int(np.sqrt(k)), seed)
    own, out = nearest(x, wide), []
    for i in range(len(wide)):
        rows = x[own == i]
        if len(rows):
            out.append(kmeans(rows, max(1, round(k * len(rows) / len(x))), seed + 1 + i))
    return np.concatenate(out)


@dataclass
class Index:
    """Centroids, one codebook for each slice of the dimensions, and how far to look; of a size that the sample bounds."""

    dim: int
    centers: np.ndarray
    slices: list[np.ndarray]
    books: list[np.ndarray]
    #: lists are looked into whose closeness to the query is less than the nearest one's by this much or less
    reach: float

    def encode(self, unit: np.ndarray, own: np.ndarray) -> np.ndarray:
        rest = unit - self.centers[own]
        return np.stack([nearest(rest[:, s], b) for s, b in zip(self.slices, self.books)], axis=1).astype(np.uint8)

    def closeness(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.centers.T - (self.centers**2).sum(axis=1) / 2

    def lists(self, unit: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """For each row the lists within reach, nearest first, and further ones until they hold `least` rows by `sizes`."""
        close = self.closeness(unit)
        order = np.argsort(-close, axis=1)
        near = (close >= close.max(axis=1, keepdims=True) - self.reach).sum(axis=1)
        enough = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
        return [o[: max(a, b)].astype(np.int32) for o, a, b in zip(order, near, enough)]


def usable(vec: str) -> Column:
    """True for vectors with a direction: no null or non-finite part, and not all zero."""
    return F.expr(f"{vec} IS NOT NULL AND size({vec}) > 0 AND NOT exists({vec}, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists({vec}, x -> x != 0)")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors as doubles, each divided by a power of two, so that squares stay finite and cosines as they are."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) + 0.0


def fit(rows: DataFrame, dim: int, n: int, sample: int = 20_000, recall: float = 0.94, k: int = 5, seed: int = 3) -> Index:
    """An index's centroids and codebooks from about `sample` of the `n` rows (vec_id, vec), picked by a hash of the id.

    There are about sqrt(n) lists, and a sixteenth of the sample at most: for more than (sample / 16)**2 rows
    the sample should grow with sqrt(n). The reach is the least that finds the share `recall` of the `k`
    nearest in the sample, where neighbours lie further apart than among all rows.
    """
    share = min(1.0, sample / max(n, 1))
    u = F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    some = rows.where(u < share).select("vec_id", "vec").orderBy("vec_id").toArrow()
    x = _unit(_matrix(some["vec"].combine_chunks(), dim)) if some.num_rows else np.zeros((1, dim))
    centers = grown(x, int(np.clip(np.sqrt(n), 1, max(1, sample // 16))), seed)
    own = nearest(x, centers)
    slices = np.array_split(np.arange(dim), min(dim, 16))
    coded = np.linspace(0, len(x) - 1, min(8192, len(x))).astype(int)
    books = [kmeans((x - centers[own])[coded][:, s], 256, seed + 1 + i) for i, s in enumerate(slices)]
    index = Index(dim, centers, slices, books, 0.0)
    tests = np.linspace(0, len(x) - 1, min(400, len(x))).astype(int)
    score = x[tests] @ x.T
    score[np.arange(len(tests)), tests] = -np.inf
    best = np.argsort(-score, axis=1)[:, : min(k, len(x) - 1)]
    if best.size:
        close = index.closeness(x[tests])
        needed = np.sort((close.max(axis=1, keepdims=True) - np.take_along_axis(close, own[best], axis=1)).ravel())
        index.reach = float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])
    return index


def _classes(x: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The place of one row of each distinct vector, and the `most` least ids of its rows."""
    _, first, own = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, own))
    ends = np.cumsum(np.bincount(own))
    return first, [ids[order[a : min(b, a + most)]] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]


def _grouped(index: Index, k: int, rerank: int):
    """For one shard: the `k` nearest of its rows in the lists that each query looks into."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "query_key": [], "vec_id": [], "score": [], "exact": []}
        if left.num_rows and right.num_rows:
            x, q = (_matrix(t["vec"].combine_chunks(), index.dim) for t in (left, right))
            # rows with equal vectors are one candidate with its least ids, however many they are
            at, members = _classes(np.ascontiguousarray(x), left["vec_id"].to_numpy(), k + 1)
            x, own = x[at], left["list"].to_numpy()[at]
            codes = np.frombuffer(b"".join(left["codes"].to_pylist()), dtype=np.uint8).reshape(left.num_rows, -1)[at]
            sizes, lost = np.sqrt((x * x).sum(axis=1)), _unit(x) - index.centers[own]
            for s, book, code in zip(index.slices, index.books, codes.T):
                lost[:, s] -= book[code]
            # what quantising lost points anywhere, so it counts in a cosine by its length over sqrt(dim)
            off = np.sqrt((lost * lost).sum(axis=1)) * min(1.0, DEVIATIONS / np.sqrt(index.dim)) + 1e-9
            places = {int(i): np.flatnonzero(own == i) for i in np.unique(own)}
            unit = _unit(q)
            # one table a query and slice: the products with a book's entries hold for the residuals of every list
            tables = [unit[:, s] @ book.T for s, book in zip(index.slices, index.books)]
            bases = unit @ index.centers.T
            for i, (qid, qkey, lists) in enumerate(zip(*(right[c].to_pylist() for c in ("query_id", "query_key", "lists")))):
                rows = np.concatenate([places[j] for j in lists if j in places] or [np.zeros(0, int)])
                if not len(rows):
                    continue
                near = bases[i][own[rows]]
                for table, code in zip(tables, codes.T):
                    near += table[i][code[rows]]
                cosine = lambda r: (x[r] * q[i]).sum(axis=1) / (sizes[r] * np.sqrt((q[i] * q[i]).sum()))  # noqa: B023, E731
                top = np.flatnonzero(near >= np.partition(near, len(rows) - rerank)[len(rows) - rerank]) if rerank < len(rows) else np.arange(len(rows))
                score = cosine(rows[top])
                if rerank < len(rows):
                    # the query's own vector may be among them
                    floor = np.partition(score, len(top) - k - 1)[len(top) - k - 1] if len(top) > k else -np.inf
                    more = np.flatnonzero(near + off[rows] >= floor)
                    top = np.union1d(top, more)
                    score = cosine(rows[top])
                keep = np.argsort(-score, kind="stable")[: k + 1]
                keep = np.flatnonzero(score >= score[keep[-1]])
                found, scores = [], []
                for c, s in zip(rows[top[keep]].tolist(), score[keep].tolist()):
                    ids = members[c].tolist()
                    if qid in ids and np.array_equal(x[c], q[i]):
                        ids.remove(qid)
                    found += ids[:k]
                    scores += [s] * len(ids[:k])
                order = np.lexsort((found, -np.array(scores)))[:k]
                out["query_id"] += [qid] * len(order)
                out["query_key"] += [qkey] * len(order)
                out["vec_id"] += [found[j] for j in order]
                out["score"] += [scores[j] for j in order]
                out["exact"] += [len(top)] * len(order)
        return pa.table({c: pa.array(v, pa.float64() if c == "score" else pa.int64()) for c, v in out.items()})

    return run


_FOUND = "query_id long, query_key long, vec_id long, score double, exact long"


def _small(k: int):
    """Groups of one length each, few enough to be compared whole."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        index = Index(dim, np.zeros((1, dim)), [], [], 0.0)
        left = left.append_column("list", pa.array([0] * left.num_rows, pa.int32())).append_column("codes", pa.array([b""] * left.num_rows, pa.binary()))
        right = right.append_column("lists", pa.array([[0]] * right.num_rows, pa.list_(pa.int32())))
        return _grouped(index, k, max(1, left.num_rows))(key, left, right)

    return run


def _shards(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list of `held` rows its first shard and its number of shards: long lists are split, short neighbours share one."""
    parts = np.maximum(1, -(-held // ROWS_A_GROUP))
    first, shard, room = np.zeros(len(held), int), 0, ROWS_A_GROUP
    for i, (n, p) in enumerate(zip(held.tolist(), parts.tolist())):
        if p > 1 or n > room:
            shard, room = shard + 1, ROWS_A_GROUP
        first[i] = shard
        room -= n
        if p > 1:
            shard, room = shard + p - 1, 0
    return first, parts


def _search_length(rows: DataFrame, queries: DataFrame, index: Index, k: int, rerank: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)
    vec = dict(rows.dtypes)["vec"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(1), shared.value.dim))
                own = nearest(unit, shared.value.centers)
                codes = [c.tobytes() for c in shared.value.encode(unit, own)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(codes, pa.binary())], ["vec_id", "vec", "list", "codes"])

    indexed = cut(rows.select("vec_id", "vec").mapInArrow(place, f"vec_id long, vec {vec}, list int, codes binary"))
    # one number for each list, of which the index has a bounded number
    held = np.zeros(len(index.centers), int)
    for r in indexed.groupBy("list").count().collect():
        held[r["list"]] = r["count"]
    first, parts = _shards(held)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"at": [], "shard": [], "lists": []}
            if batch.num_rows:
                # a query is in one of the lists itself
                for i, lists in enumerate(shared.value.lists(_unit(_matrix(batch.column(1), shared.value.dim)), held, k + 1)):
                    for shard in np.unique(first[lists]).tolist():
                        own = lists[first[lists] == shard]
                        for part in range(int(parts[own].max())):
                            out["at"].append(i)
                            out["shard"].append(shard + part)
                            out["lists"].append(own)
            taken = batch.take(pa.array(out["at"], pa.int32()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(out["shard"], pa.int32()), pa.array(out["lists"], pa.list_(pa.int32()))], ["query_id", "vec", "query_key", "shard", "lists"])

    asked = cut(queries.select("query_id", "vec", "query_key").mapInArrow(ask, f"query_id long, vec {vec}, query_key long, shard int, lists array<int>"))
    # a shard that more queries ask than fit in a group meets them in several
    blocks = asked.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES_A_GROUP).cast("int").alias("blocks"))
    lookup = rows.sparkSession.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(first, parts))], "list int, first int, parts int")
    placed = indexed.join(F.broadcast(lookup), "list").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")).drop("first", "parts")
    placed = placed.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = blocks.select(F.col("shard").alias("_shard"), F.col("blocks").alias("_blocks"))
    asked = asked.join(blocks, F.col("shard") == F.col("_shard")).withColumn("block", F.pmod(F.col("query_key"), F.col("_blocks")).cast("int"))
    placed, asked = placed.select("shard", "block", "vec_id", "vec", "list", "codes"), asked.select("shard", "block", "query_id", "vec", "query_key", "lists")
    return placed.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_grouped(index, k, rerank), _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 5,
    rerank: int = 48,
    sample: int = 20_000,
    exact: bool = False,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` nearest found for each query, all rows being candidates but its own.

    `is_query` is a condition over vec_id. Vectors that are null, zero or hold nulls or non-finite numbers take
    no part, nor do rows with a null id. Every other row is a candidate, rows that repeat an id included. The
    cosine of vectors of different lengths isn't defined, so each query sees the vectors of its own length.
    Query rows of one id and different vectors are queries of their own; equal query rows are one query, and
    the other such rows its candidates. Ties go to the smaller id; fewer candidates than `k` give fewer rows; an
    empty table gives none; other columns play no part.

    The commonest length and each with over 4096 rows has an index, the others are compared whole. An index's short lists that
    follow one another share a shard of about 4096 rows, a long list has several, and queries meet a shard in
    groups of 1024. So a list that holds a third of all rows still makes bounded groups. A query looks into the lists
    within the index's reach and into further ones until they hold `k` other rows. In a shard the quantised codes
    pick `rerank` vectors a query, ties included, and every vector whose quantised cosine, with three deviations of
    what its code lost, comes up to the k-th of these; their cosines are then computed in double precision
    from the vectors themselves. Equal vectors are one candidate. With `exact` all lists are looked into and all
    vectors compared; no other cut stands between a query and the rows of the lists it looks into.
    """
    spark = vectors.sparkSession
    own = only(vectors, id_col, vec_col).toDF("vec_id", "vec")
    kind = "array<float>" if dict(own.dtypes)["vec"] == "array<float>" else "array<double>"
    own = own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast(kind).alias("vec"))
    rows = own.where(F.col("vec_id").isNotNull() & usable("vec")).withColumn("dim", F.size("vec"))
    # one number for each length that occurs
    lengths = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}
    return _ranked(_found(spark, rows, lengths, is_query, k, rerank, sample, exact), k)


def _found(spark: SparkSession, rows: DataFrame, lengths: dict[int, int], is_query: Column, k: int, rerank: int, sample: int, exact: bool) -> DataFrame:
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vec", "dim", F.xxhash64("vec").alias("query_key")).dropDuplicates(["query_id", "vec"])
    large = [d for d, n in lengths.items() if n > ROWS_A_GROUP or d == max(lengths, key=lambda d: (lengths[d], -d))]
    out = spark.createDataFrame([], _FOUND)
    if len(large) < len(lengths):
        some = ~F.col("dim").isin(large) if large else F.lit(True)
        few = queries.where(some).select(*[F.col(c).alias(c) for c in ("dim", "query_id", "query_key", "vec")])
        out = rows.where(some).select("dim", "vec_id", "vec").groupBy("dim").cogroup(few.groupBy("dim")).applyInArrow(_small(k), _FOUND)
    for dim in large:
        mine = rows.where(F.col("dim") == dim)
        index = fit(mine, dim, lengths[dim], sample, k=k)
        if exact:
            index.reach, rerank = np.inf, 1 << 40
        out = out.unionByName(_search_length(mine, queries.where(F.col("dim") == dim), index, k, rerank))
    return out
