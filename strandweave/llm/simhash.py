"""Near duplicates by SimHash, linked by the generalised pigeonhole principle.

Fingerprints within `threshold` bits are found without comparing all pairs. The 64 bits are grouped into
partitions of correlated bits. A fingerprint q gives each partition i its own threshold t_i >= -1 with
sum(t_i + 1) = threshold + 1; whatever is within `threshold` of q then lies within t_i of it in some
partition i, as else each would differ in t_i + 1 bits at least, `threshold` + 1 in all. The t_i are chosen
per fingerprint by dynamic programming over estimated candidate counts, so a partition in which q's value is
common gets -1 and isn't looked into at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.arrow import mapper, texts
from strandweave.llm.columns import only, place, placed
from strandweave.llm.components import components
from strandweave.llm.shared_shingles import FEW, arrays_of, chosen, hashes_of, set_id, set_links, with_partners
from strandweave.runtime import cut, join_hot

BITS = 64
#: A candidate's cost in units of one probe: candidates are compared where they lie, probes are shuffled.
CANDIDATE_COST = 0.07
#: Bits of a block whose values are counted for the estimates: at most 2**11 counts each.
BLOCK = 11
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_OFFSETS = (np.arange(8) * 256)[None, :]


def print_of(hashes: np.ndarray) -> int:
    """The SimHash of shingles' hashes: a bit is 1 if it is set in over half of them."""
    if not len(hashes):
        return 0
    cells = hashes.view(np.uint8).reshape(-1, 8) + _OFFSETS
    counts = np.einsum("bv,bvk->bk", np.bincount(cells.ravel(), minlength=2048).reshape(8, 256), np.broadcast_to(_BYTE_BITS, (8, 256, 8)))
    return int(np.packbits((counts * 2 > len(hashes)).ravel(), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The SimHash of one text as an unsigned 64-bit number; 0 where there are no words."""
    return print_of(hashes_of(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): a row for each row of `docs`, fp being the signed form of the fingerprint."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, shingle) for t in texts(batch.column(1))], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    rows = only(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(mapper(one), "doc_id long, fp long")


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, r) for r in range(radius + 1)) if radius >= 0 else 0


def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)], dtype=np.int64)


def _values(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(prints), dtype=np.int64)
    for k, b in enumerate(bits):
        out |= ((prints >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def _summed(prints: DataFrame, cells: int, count) -> np.ndarray:
    """`count` of each batch, an array of `cells` numbers, summed over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=np.int64)
        for batch in batches:
            total += count(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(cells, dtype=np.int64)
    for row in prints.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out


def _together(prints: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    out = np.zeros((BITS, BITS))
    for at in range(0, len(bits), 1 << 20):
        out += bits[at : at + (1 << 20)].T @ bits[at : at + (1 << 20)]
    return out.astype(np.int64).ravel()


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size; each group grows by the bit that is most correlated with it."""
    share = np.diag(together) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    corr = np.abs((together / n - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for i in range(parts):
        width = BITS // parts + (i < BITS % parts)
        rest = sorted(left)
        group = [rest[int(np.argmax(corr[np.ix_(rest, rest)].sum(axis=1)))]]
        left.discard(group[0])
        while len(group) < width:
            rest = sorted(left)
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(axis=1)))])
            left.discard(group[-1])
        out.append(group)
    return out


def part_count(n: int, threshold: int) -> int:
    """The number of partitions that costs least for `n` evenly spread fingerprints."""

    def cost(m: int) -> float:
        spare = threshold - m + 1
        total = 0.0
        for i in range(m):
            width, t = BITS // m + (i < BITS % m), spare // m + (i < spare % m)
            total += _ball(width, t) * (1 + CANDIDATE_COST * n / 2.0**width)
        return total

    return min(range(2, threshold + 2), key=cost)


class Allocator:
    """Partitions with the tables from which a fingerprint's thresholds are found; its size is fixed."""

    def __init__(self, groups: list[list[int]], n: int, threshold: int, counts: np.ndarray):
        self.groups, self.threshold = groups, threshold
        self.blocks = blocks_of(groups)
        t, at, self.tables = threshold, 0, []
        for part in self.blocks:
            tables = []
            for block in part:
                size = 1 << len(block)
                seen, at = counts[at : at + size] / max(n, 1), at + size
                values = np.arange(size, dtype=np.uint16)
                apart = np.unpackbits((values[:, None] ^ values[None, :]).view(np.uint8).reshape(size, size, 2), axis=2).sum(axis=2)
                tables.append(np.stack([(apart == d) @ seen for d in range(t + 1)], axis=1))
            self.tables.append(tables)
        self.n = n

    def thresholds(self, prints: np.ndarray) -> np.ndarray:
        """For each fingerprint its threshold in each partition, -1 for none."""
        t, rows, m = self.threshold, len(prints), len(self.groups)
        best = np.full((rows, t + 2), np.inf)
        best[:, 0] = 0
        picks = []
        for part, blocks, tables in zip(self.groups, self.blocks, self.tables):
            spread = np.zeros((rows, t + 1))
            spread[:, 0] = 1
            for block, table in zip(blocks, tables):
                own, out = table[_values(prints, block)], np.zeros_like(spread)
                for d in range(t + 1):
                    out[:, d:] += own[:, d : d + 1] * spread[:, : t + 1 - d]
                spread = out
            within = np.cumsum(spread, axis=1) * self.n
            after, pick = np.full_like(best, np.inf), np.zeros((rows, t + 2), dtype=np.int8)
            for s in range(t + 2):
                for used in range(s + 1):  # used = threshold + 1
                    c = best[:, s - used] + (_ball(len(part), used - 1) + CANDIDATE_COST * within[:, used - 1] if used else 0)
                    better = c < after[:, s]
                    after[better, s], pick[better, s] = c[better], used
            best = after
            picks.append(pick)
        out, s = np.empty((rows, m), dtype=np.int64), np.full(rows, t + 1)
        for i in range(m - 1, -1, -1):
            used = picks[i][np.arange(rows), s]
            out[:, i], s = used - 1, s - used
        return out


def blocks_of(groups: list[list[int]]) -> list[list[list[int]]]:
    out = []
    for g in groups:
        k = -(-len(g) // BLOCK)
        out.append([g[len(g) * j // k : len(g) * (j + 1) // k] for j in range(k)])
    return out


def _key(part: int, values: np.ndarray) -> np.ndarray:
    return (part << 48) | values


def links(prints: DataFrame, threshold: int = 4) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column fp that leave their components as all links would.

    Probes meet the fingerprints that share a partition's value. Each such bucket has a pivot, its least
    fingerprint. Two members that are both linked to the pivot need no link of their own, so a bucket of
    mutually near fingerprints yields as many links as members, not all its pairs; any other pair is compared.
    """
    n = prints.count()
    if n < 2:
        return prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    together = _summed(prints, BITS * BITS, _together).reshape(BITS, BITS)
    groups = group_bits(together, n, part_count(n, threshold))
    blocks = [b for part in blocks_of(groups) for b in part]
    starts = np.cumsum([0] + [1 << len(b) for b in blocks])

    def count(values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(_values(values, b), minlength=1 << len(b)) for b in blocks])

    chooser = Allocator(groups, n, threshold, _summed(prints, int(starts[-1]), count))
    return _linked(prints, chooser, threshold)


def _linked(prints: DataFrame, chooser: Allocator, threshold: int) -> DataFrame:
    groups = chooser.groups
    shared = prints.sparkSession.sparkContext.broadcast(chooser)

    def index(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        keys = np.concatenate([_key(i, _values(own.view(np.uint64), g)) for i, g in enumerate(groups)])
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(own, len(groups)))], ["key", "fp"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            limits = shared.value.thresholds(own.view(np.uint64))
            for i, g in enumerate(groups):
                values = _values(own.view(np.uint64), g)
                for t in range(threshold + 1):
                    rows = np.flatnonzero(limits[:, i] == t)
                    if len(rows):
                        masks = _masks(len(g), t)
                        step = max(1, (1 << 20) // len(masks))
                        for at in range(0, len(rows), step):
                            some = rows[at : at + step]
                            keys = _key(i, (values[some][:, None] ^ masks[None, :]).ravel())
                            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(own[some], len(masks)))], ["key", "q"])

    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= threshold
    entries = prints.mapInArrow(mapper(index, 1 << 16), "key long, fp long")
    pivots = entries.groupBy("key").agg(F.min("fp").alias("pivot"))
    held = entries.join(pivots, "key").withColumn("close", near("fp", "pivot"))
    asked = prints.mapInArrow(probe, "key long, q long").join(pivots, "key").withColumn("close", near("q", "pivot"))
    stars = held.where("close").select(F.col("fp").alias("a"), F.col("pivot").alias("b")).union(asked.where("close").select("q", "pivot"))
    wanted = asked.withColumn("close", F.explode(F.when(F.col("close"), F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))))
    pairs = held.select("key", "close", "fp").join(wanted.select("key", "close", "q"), ["key", "close"]).where(near("fp", "q"))
    both = stars.union(pairs.select("fp", "q")).where("a != b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, threshold: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, class_rows): a row for each row of `docs`.

    A null or empty text, or one of white space, has fingerprint 0, which links like any other. Repeated rows
    and repeated ids each keep their row. A null id keeps its row too and is passed over when a component's
    least id is sought (null if it has none). Other columns of `docs`, whatever their names, play no part.
    An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links(classes.select("fp"), threshold))
    classes = cut(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")))
    heads = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    side = classes.join(heads, "root").select("fp", "component_id", "n", F.col("n").alias("class_rows"))
    out = join_hot(rows, side, ["fp"], "n", max(1, rows.count()))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "class_rows")


def _described(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, _k1, _k2, fp, set, n): each row's fingerprint, the name of its set of shingles and their number."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, names, sizes = [], [], []
        for text in texts(batch.column(3)):
            hashes = hashes_of(text, shingle)
            distinct = np.unique(hashes)
            prints.append(print_of(hashes))
            names.append(set_id(distinct))
            sizes.append(len(distinct))
        columns = [np.array(prints, dtype=np.uint64).view(np.int64), np.array(names, dtype=np.int64), np.array(sizes, dtype=np.int64)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, columns)], ["doc_id", "_k1", "_k2", "fp", "set", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), "_k1", "_k2", F.col(text_col).alias("text"))
    return rows.mapInArrow(mapper(one), "doc_id long, _k1 long, _k2 long, fp long, set long, n long")


def _roots(classes: DataFrame, set_pairs: DataFrame, threshold: int) -> DataFrame:
    """(node, root) from classes (node, fp, set): nodes of one fingerprint or set are one, as are those of linked ones."""
    edges = []
    for column, pairs in (("fp", None), ("set", set_pairs)):
        heads = cut(classes.groupBy(F.col(column).alias("value")).agg(F.min("node").alias("head")))
        pairs = links(heads.select(F.col("value").alias("fp")), threshold) if pairs is None else pairs
        edges.append(classes.join(heads, F.col(column) == F.col("value")).where("node != head").select("node", "head"))
        ends = [heads.select(F.col("value").alias(e), F.col("head").alias(f"h{e}")) for e in "ab"]
        edges.append(pairs.join(ends[0], "a").join(ends[1], "b").select("ha", "hb"))
    whole = edges[0]
    for e in edges[1:]:
        whole = whole.union(e)
    return components(whole.toDF("a", "b"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: int = 4, similarity: float = 0.8) -> DataFrame:
    """One row of `docs` for each component of near duplicates, with its own columns: that of the least id, nulls last.

    Two texts are linked if their fingerprints differ in `threshold` bits or fewer, or if their sets of
    `shingle` words have the Jaccard similarity `similarity` or more. At 0.8 that is 5 to 13 bits of 64, too wide for
    any partition of them, so these links come from shared shingles and are exact. Rows of one id with
    different texts are told apart by a hash of the text, and of equal rows one stays. Null and empty texts and
    those of white space are one component; a shorter text is one shingle. A component whose ids are all null
    keeps one row, that of the least hash. Columns keep their names, whatever these are; an empty table gives
    an empty result.
    """
    own, names = placed(docs), docs.columns
    ident, text = place(docs, id_col), place(docs, text_col)
    marks = {f"_k{i}": F.xxhash64(F.lit(i), F.coalesce(F.col(ident).cast("string"), F.lit("null")), F.col(text)) for i in (1, 2)}
    marked = own.withColumns(marks)
    rows = cut(_described(marked, ident, text, shingle))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *marks)).alias("least")
    classes = cut(rows.groupBy("fp", "set", "n").agg(least).withColumn("node", F.xxhash64("fp", "set")))
    sets = classes.groupBy("set", "n").agg(F.min("least").alias("least"))
    some = cut(with_partners(marked, sets, text, shingle, similarity))
    arrays = cut(arrays_of(chosen(marked, some.select("least._k1", "least._k2"), list(marks)), text, shingle))
    roots = _roots(classes, cut(set_links(arrays, similarity)), threshold)
    rooted = classes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least._k1", "least._k2")
    return _only_kept(marked, rows, kept, list(marks)).select(*own.columns).toDF(*names)


def _only_kept(docs: DataFrame, rows: DataFrame, kept: DataFrame, marks: list[str], few: int = FEW) -> DataFrame:
    """One row of `docs` for each of the marks in `kept`; `rows` has the marks of all rows of `docs`.

    Marks that go, and those that several rows have, are few as a rule. Up to `few` of them, counted first, are
    broadcast, so that no text moves but those of equal rows; of more, all rows are shuffled by their marks.
    """
    counts = rows.groupBy(*marks).agg(F.count("*").alias("_rows"))
    todo = cut(counts.join(kept.withColumn("_kept", F.lit(True)), marks, "left").where("_kept IS NULL OR _rows > 1").select(*marks, F.col("_kept").isNull().alias("_gone")))
    if todo.count() > few:
        return docs.join(kept, marks, "left_semi").dropDuplicates(marks)
    single = docs.join(F.broadcast(todo.select(*marks)), marks, "left_anti")
    return single.unionByName(docs.join(F.broadcast(todo.where("NOT _gone").select(*marks)), marks, "left_semi").dropDuplicates(marks))
