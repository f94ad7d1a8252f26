"""Byte-level BPE: overlapping chunks are pre-tokenised apart, stitched where they agree, then encoded.

Texts are cut every `chunk` code points; each chunk also holds the first `overlap` code points of the next, and
a text that is no longer is one chunk. Each is pre-tokenised alone, from wherever it begins.
A boundary that the chunk before and the chunk itself both find in their overlap is a true one, and from
there on both cut alike, as the pattern looks ahead only. The text between two such places is a piece that
can be encoded by itself. Where a seam has no common boundary (one run of letters without end), the chunks on
both sides are joined and encoded as one piece, so ids never depend on where chunks lie. The chunks of a text of up
to `spread` code points are handled by the task that reads it; those of longer texts are spread over tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.llm.arrow import mapper, sliced, texts
from strandweave.llm.columns import only

CHUNK, OVERLAP, SPREAD = 1 << 11, 1 << 8, 1 << 17
_made: dict[tuple[int, str], tuple[tiktoken.Encoding, list[bytes]]] = {}


def load(spark: SparkSession, path: str) -> Broadcast:
    """The rank file's bytes for all executors; its size is that of the vocabulary, whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _vocabulary(raw: bytes, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    key = (hash(raw), pattern)
    if key not in _made:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        _made[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), pieces
    return _made[key]


def seams(text: str, pattern: str, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Where pre-tokens begin in the first `overlap` places of a chunk's text, and in those past `chunk`.

    Left out are places after white space, where a cut would change the match before it, and the last pre-token,
    which more text might change.
    """
    head, tail, end = [], [], len(text)
    for m in regex.compile(pattern).finditer(text):
        at, to = m.span()
        if overlap <= at < chunk or not at or to == end or text[at - 1].isspace():
            continue
        if at < overlap:
            head.append(at)
        if at >= chunk:
            tail.append(at)
    return head, tail


def pieces_of(text: str, pattern: str, chunk: int, overlap: int) -> list[str]:
    """The text in pieces that can be encoded by themselves: cut at the first place of each seam that both its chunks find."""
    cuts, before = [0], []
    for at in range(0, len(text) if len(text) > chunk else 0, chunk):
        head, tail = seams(text[at : at + chunk + overlap], pattern, chunk, overlap)
        both = set(before).intersection(head)
        if at and both:
            cuts.append(at + min(both))
        before = [t - chunk for t in tail]
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], None])]


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def _unpacked(ids: bytes, pieces: list[bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode(docs: DataFrame, ranks: Broadcast, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): a row for each row of `docs`; ids are little-endian unsigned 32-bit numbers.

    With `decoded` there is also a column of that name, what the ids give when they are decoded again; for all but
    the longest texts the worker that made the ids does it, so that no second one is needed.

    A null text counts as empty and has no ids. Bytes that aren't UTF-8 count as U+FFFD. Null and repeated ids
    and repeated rows keep their rows; columns of other names play no part. No text is cut short: every one is
    encoded piece by piece, those of over `spread` code points in several tasks.
    """
    rows = only(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    kind = dict(rows.dtypes)["doc_id"]

    names = ["doc_id", "n_tokens", "ids", *(["decoded"] if decoded else [])]

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, pieces = _vocabulary(ranks.value, pattern)
        sizes, packed = [], []
        for text in texts(batch.column(1)):
            parts = [encoder.encode_ordinary(p) for p in pieces_of(text.decode("utf-8", "replace"), pattern, chunk, overlap)]
            sizes.append(sum(map(len, parts)))
            packed.append(b"".join(map(_packed, parts)))
        more = [pa.array([_unpacked(i, pieces) for i in packed], pa.binary())] if decoded else []
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), *more], names)

    schema = f"doc_id {kind}, n_tokens long, ids binary" + (", decoded binary" if decoded else "")
    short = rows.where(F.length("text") <= spread).mapInArrow(mapper(whole, 64), schema)
    long = _encode_long(rows.where(F.length("text") > spread), ranks, pattern, chunk, overlap, kind)
    if decoded:
        long = decode(long.withColumn("_own", F.col("ids")), ranks, pattern, ["doc_id", "n_tokens", "_own"]).withColumnRenamed("_own", "ids")
    return short.unionByName(long)


def _encode_long(rows: DataFrame, ranks: Broadcast, pattern: str, chunk: int, overlap: int, kind: str) -> DataFrame:
    # equal rows are encoded once and put out as often as they came
    rows = rows.groupBy("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("2"), "text").alias("h2")).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    cuts = rows.withColumn("k", F.explode(F.expr(f"sequence(0, (char_length(text) - 1) div {chunk})")))
    cuts = cuts.withColumn("chunk", F.expr(f"substring(text, int(k * {chunk} + 1), {chunk + overlap})")).drop("text")
    key = ["doc_id", "h1", "h2"]
    cuts = cuts.select(*key, "copies", F.col("k").cast("long").alias("k"), "chunk").repartition(*key, "k")

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        heads, tails = [], []
        for k, text in zip(batch.column(4).to_pylist(), texts(batch.column(5))):
            head, tail = seams(text.decode("utf-8", "replace"), pattern, chunk, overlap)
            heads.append([k * chunk + b for b in head] if k else [])
            tails.append([k * chunk + b for b in tail])
        places = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, places), pa.array(tails, places)], [*batch.schema.names, "head", "tail"])

    schema = f"doc_id {kind}, h1 long, h2 long, copies long, k long, chunk string, head array<long>, tail array<long>"
    found = cuts.mapInArrow(mapper(scan, 64), schema)
    ordered = Window.partitionBy(*key).orderBy("k")
    found = found.withColumn("sync", F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(ordered), "head"))))
    found = found.withColumn("part", F.count("sync").over(ordered)).select(*key, "copies", "k", "chunk", "sync", "part")
    ends = Window.partitionBy(*key).orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    found = found.withColumn("until", F.min("sync").over(ends))
    parts = found.groupBy(*key, "part", "copies").agg(
        F.max("sync").alias("start"), F.min_by("until", F.struct(-F.col("k"))).alias("until"), F.array_sort(F.collect_list(F.struct("k", "chunk"))).alias("chunks")
    )
    parts = parts.repartition(*key, "part")

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _vocabulary(ranks.value, pattern)
        for batch in sliced(batches, 16):
            out = []
            for start, until, chunks in zip(*(batch.column(c).to_pylist() for c in ("start", "until", "chunks"))):
                first = chunks[0]["k"] * chunk
                text = "".join(c["chunk"] if i == len(chunks) - 1 else c["chunk"][:chunk] for i, c in enumerate(chunks))
                out.append(_packed(encoder.encode_ordinary(text[start - first : None if until is None else until - first])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*key, "copies", "part")), pa.array(out, pa.binary())], [*key, "copies", "part", "ids"])

    pieces = parts.mapInArrow(piece, f"doc_id {kind}, h1 long, h2 long, copies long, part long, ids binary")
    docs = pieces.groupBy(*key, "copies").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))

    def joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [b"".join(p["ids"] for p in parts) for parts in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "copies", "n_tokens", "ids"])

    out = docs.select("doc_id", "copies", "parts").mapInArrow(mapper(joined, 16), f"doc_id {kind}, copies long, n_tokens long, ids binary")
    return out.select("doc_id", "n_tokens", "ids", F.explode(F.expr("array_repeat(0, int(copies))"))).select("doc_id", "n_tokens", "ids")


def decode(encoded: DataFrame, ranks: Broadcast, pattern: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns `keep` of `encoded` and `decoded`, the bytes of the ids strung together; null ids give none."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, pieces = _vocabulary(ranks.value, pattern)
        out = [_unpacked(i or b"", pieces) for i in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*keep, "decoded"])

    rows = encoded.select(*keep, F.col(ids_col).alias("_ids"))
    schema = ", ".join([*(f"`{k}` {dict(rows.dtypes)[k]}" for k in keep), "decoded binary"])
    return rows.mapInArrow(mapper(one, 64), schema)


def count_tokens(docs: DataFrame, ranks: Broadcast, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) by the same encoder."""
    return encode(docs, ranks, pattern, id_col, text_col).select("doc_id", "n_tokens")
