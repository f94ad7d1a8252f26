"""Links between texts whose sets of shingles have at least a given Jaccard similarity, found exactly.

A text with a partner at similarity t shares t of its shingles at least. So first the shingles that no other
text has are counted for each text, in one shuffle of packed hashes, and texts with too many of them are done
with: what merely contains a common passage goes here. For the few others, shingles are put in order from the rarest
on; two texts of similarity t share one among the first n - ceil(t n) + 1 of each. Texts that meet there are compared
by their whole sets. Each bucket has a pivot, its least text, and two texts that are both linked to it need no
link of their own, so a bucket of texts that are all alike gives as many links as members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.arrow import sliced, texts
from strandweave.runtime import cut

#: Shingles that one task counts at a time, about, and those that are packed together.
A_PART, A_PACK = 1 << 19, 1 << 17
#: Packs that meet in one task.
MEET = 1024
#: Texts up to which the marks of those to compare are broadcast: 16 bytes each.
FEW = 1_000_000


def hashes_of(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the lower-cased text's shingles in order, repeats included; a shorter text is one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip((ends - sizes).tolist(), ends[shingle - 1 :].tolist())], dtype=np.uint64)


def set_id(distinct: np.ndarray) -> int:
    """A signed 64-bit name of a sorted set of hashes."""
    return int(np.uint64(xxhash.xxh64_intdigest(distinct.tobytes(), 7)).astype(np.int64))


def _pack(sets: dict[int, np.ndarray], parts: int) -> pa.RecordBatch:
    """Rows (part, low, owner, owners, shared): the lower halves of the sets' hashes by part, whose they are, and those of several sets."""
    keys = np.concatenate(list(sets.values()))
    owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets.values()])
    part = ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((keys, part))
    keys, owner, part = keys[order], owner[order], part[order]
    twice = np.zeros(len(keys) + 1, dtype=bool)
    twice[1:-1] = keys[1:] == keys[:-1]
    several = twice[1:] | twice[:-1]
    names, low = np.fromiter(sets, dtype=np.int64, count=len(sets)), keys.astype(np.uint32)
    present = np.unique(part)
    rows: list[tuple] = []
    for p, start, end in zip(present.tolist(), np.searchsorted(part, present), np.searchsorted(part, present, side="right")):
        own = slice(start, end)
        alone = ~several[own]
        used, at = np.unique(owner[own][alone], return_inverse=True)
        rows.append((p, low[own][alone].tobytes(), at.astype(np.uint32).tobytes(), names[used].tobytes(), np.unique(low[own][~alone]).tobytes()))
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["part", "low", "owner", "owners", "shared"])


def _packed(parts: int, shingle: int):
    """Packs what some texts hold at a time, bounded by hashes and by texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = {}, 0
        for batch in sliced(batches, 64):
            for text in texts(batch.column(0)):
                own = np.unique(hashes_of(text, shingle))
                if len(own) and (name := set_id(own)) not in sets:
                    sets[name] = own
                    held += len(own)
                if held >= A_PACK or len(sets) >= 1 << 15:
                    yield _pack(sets, parts)
                    sets, held = {}, 0
        if sets:
            yield _pack(sets, parts)

    return run


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The halves that one set alone has, whose they are, and those that several have, from packed rows of one part."""
    read = lambda column, kind: [np.frombuffer(b, dtype=kind) for b in table[column].to_pylist()]
    low = np.concatenate(read("low", np.uint32))
    owner = np.concatenate([names[at] for names, at in zip(read("owners", np.int64), read("owner", np.uint32))])
    shared = np.unique(np.concatenate(read("shared", np.uint32)))
    order = np.lexsort((owner, low))
    low, owner = low[order], owner[order]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    low, owner = low[new], owner[new]
    twice = np.zeros(len(low) + 1, dtype=bool)
    twice[1:-1] = low[1:] == low[:-1]
    several = twice[1:] | twice[:-1]
    single = ~several & ~np.isin(low, shared)
    return low[single], owner[single], np.union1d(shared, low[several])


def _repacked(table: pa.Table) -> pa.Table:
    low, owner, shared = _merged(table)
    names, at = np.unique(owner, return_inverse=True)
    row = {"part": table["part"].slice(0, 1).combine_chunks(), "salt": table["salt"].slice(0, 1).combine_chunks()}
    return pa.table({**row, **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (("low", low), ("owner", at.astype(np.uint32)), ("owners", names), ("shared", shared))}})


def _alone(table: pa.Table) -> pa.Table:
    """(set, alone): how many shingles of one part only this set of shingles has. Equal halves of hashes count as shared."""
    names, n = np.unique(_merged(table)[1], return_counts=True)
    return pa.table({"set": pa.array(names, pa.int64()), "alone": pa.array(n, pa.int64())})


def with_partners(docs: DataFrame, sets: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The rows of `sets` (set, n) at least the share `similarity` of whose shingles occur in another set of `docs`.

    A shingle that most texts have comes once from each pack. Packs are merged some at a time until few enough are
    left to meet in one task, so that such a shingle doesn't fill it.
    """
    total = sets.agg(F.sum("n")).first()[0] or 0
    kind, packs = "low binary, owner binary, owners binary, shared binary", -(-total // A_PACK)
    packed = docs.select(text_col).mapInArrow(_packed(max(1, -(-total // A_PART)), shingle), f"part int, {kind}")
    while packs > MEET:
        packs = -(-packs // MEET)
        salted = packed.withColumn("salt", F.pmod(F.xxhash64("low", "shared"), F.lit(packs)).cast("int"))
        packed = salted.groupBy("part", "salt").applyInArrow(_repacked, f"part int, salt int, {kind}").drop("salt")
    alone = packed.groupBy("part").applyInArrow(_alone, "set long, alone long").groupBy(F.col("set").alias("_set")).agg(F.sum("alone").alias("alone"))
    joined = sets.join(alone, F.col("set") == F.col("_set"), "left")
    return joined.where(F.col("n") - F.coalesce("alone", F.lit(0)) >= F.lit(similarity) * F.col("n") - 1e-9).where("n > 0").select(*sets.columns)


def _alike(pairs: DataFrame, arrays: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""
    one = lambda e: arrays.select(F.col("set").alias(e), F.col("n").alias(f"n{e}"), F.col("s").alias(f"s{e}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").where(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb") - 1e-9)
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * (1 + similarity) >= F.lit(similarity) * (F.col("na") + F.col("nb")) - 1e-9).select("a", "b")


def set_links(arrays: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between sets (set, n, s array<long>) that leave their components as all links of the similarity would."""
    least = F.ceil(F.lit(similarity) * F.col("n") - 1e-9)
    rows = arrays.select("set", "n", F.explode("s").alias("h"))
    common = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ranked = rows.join(common, "h", "left").groupBy("set", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "h"))).alias("hs"))
    first = ranked.select("set", F.explode(F.slice("hs", F.lit(1), (F.col("n") - least + 1).cast("int"))).alias("x")).where("x.df > 1")
    entries = cut(first.select("set", F.col("x.h").alias("h")))
    pivots = entries.groupBy("h").agg(F.min("set").alias("pivot"))
    held = cut(entries.join(pivots, "h"))
    stars = cut(_alike(held.where("set != pivot").select(F.col("set").alias("a"), F.col("pivot").alias("b")).distinct(), arrays, similarity))
    near = stars.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    far = held.where("set != pivot").join(near, (F.col("set") == F.col("_a")) & (F.col("pivot") == F.col("_b")), "left_anti").select("h", F.col("set").alias("x"))
    pairs = far.join(held.where("set != pivot").select("h", F.col("set").alias("y")), "h").where("x != y")
    # aliased anew: Spark 4.1 fails to carry a checkpoint's own constraints through a union
    return stars.select(F.col("a").alias("a"), F.col("b").alias("b")).union(_alike(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), arrays, similarity))


def arrays_of(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(set, n, s): each set of shingles once, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256):
            own = [np.unique(hashes_of(t, shingle)) for t in texts(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_id(s) for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int64()), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], ["set", "n", "s"]
            )

    return docs.select(text_col).mapInArrow(run, "set long, n long, s array<long>").dropDuplicates(["set"])


def chosen(docs: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """The rows of `docs` whose columns `names` are in `keys`, which are broadcast if they are few; they are counted first."""
    keys = keys.select(*names)
    return docs.join(F.broadcast(keys) if keys.count() <= FEW else keys, names, "left_semi")

