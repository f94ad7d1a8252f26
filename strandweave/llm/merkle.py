"""WARC records and their fixity: hash trees over ordered offset ranges, compared from the root down."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.columns import only
from strandweave.runtime import cut

#: Records to an archive file, and children to a tree node as a power of two.
PER_ARCHIVE, FAN_BITS = 1000, 4


def record_bytes(record_id: Column, uri: Column, payload: Column) -> Column:
    """One WARC resource record; a null payload is empty and a null address is left blank."""
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit(b"\r\n\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", per_archive: int = PER_ARCHIVE) -> DataFrame:
    """(slot, archive, record): a row for each row of `pages`.

    A slot is the record's place in the order of all records: its id, or for a null id a negative number from
    the record's own hash. per_archive slots that follow one another make an archive.
    """
    own = only(pages, id_col, uri_col, payload_col).toDF("id", "uri", "payload")
    rows = own.select(F.col("id").cast("long").alias("_id"), record_bytes(F.col("id"), F.col("uri"), F.col("payload")).alias("record"))
    slot = F.coalesce("_id", -1 - F.pmod(F.xxhash64("record"), F.lit(1 << 40)))
    return rows.select(slot.alias("slot"), F.floor(slot / per_archive).alias("archive"), "record")


def leaves(recs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(slot, archive, record, first, last, digest): a row for each slot, with its range of bytes [first, last) in its archive.

    The range is where the record lies, or what a stored `index` (slot, first, last) says, null if it has no such
    slot. `record` is the digest of the bytes, `digest` that of slot, range and record, so a damaged offset is as
    plain as a damaged byte. Records of one slot (repeated rows or ids) lie side by side and are hashed in the
    order of their digests. Records are hashed where they are read; only digests and lengths are shuffled. An
    archive's offsets add up in one task, over per_archive narrow rows if ids are distinct.
    """
    hashed = recs.select("slot", "archive", F.sha2("record", 256).alias("d"), F.octet_length("record").cast("long").alias("size"))
    by_slot = hashed.groupBy("archive", "slot").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("d").alias("d"), F.sort_array(F.collect_list("d")).alias("ds"))
    by_slot = by_slot.withColumn("record", F.when(F.col("n") == 1, F.col("d")).otherwise(F.sha2(F.array_join("ds", ""), 256)))
    if index is None:
        last = F.expr("sum(size) OVER (PARTITION BY archive ORDER BY slot ROWS UNBOUNDED PRECEDING)")
        rows = by_slot.select("slot", "archive", "record", (last - F.col("size")).alias("first"), last.alias("last"))
    else:
        stored = index.groupBy(F.col("slot").alias("_slot")).agg(F.min(F.struct("first", "last")).alias("at"))
        rows = by_slot.join(stored, F.col("slot") == F.col("_slot"), "left").select("slot", "archive", "record", "at.first", "at.last")
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("slot", "first", "last", "record")]
    return rows.withColumn("digest", F.sha2(F.concat_ws(":", *said), 256))


def tree(leaf: DataFrame, fan_bits: int = FAN_BITS) -> list[DataFrame]:
    """The levels of the hash tree from the leaves up, each (node, digest) and kept in the shared folder.

    A node stands for 2**fan_bits neighbouring nodes below it, those that exist, and hashes their numbers and
    digests in order. The top level has at most two nodes: one for slots from 0 on and one for those below.
    """
    levels = [leaf]
    span = leaf.agg(F.min("slot").alias("a"), F.max("slot").alias("b")).first()
    if span["a"] is None:
        return levels
    nodes, widest = leaf.select(F.col("slot").alias("node"), "digest"), max(abs(span["a"]), abs(span["b"]))
    levels = [nodes]
    while widest:
        widest >>= fan_bits
        child = F.concat(F.col("node").cast("string"), F.lit(":"), F.col("digest"))
        nodes = nodes.groupBy(F.shiftright("node", fan_bits).alias("up")).agg(F.sort_array(F.collect_list(F.struct("node", child.alias("c")))).alias("cs"))
        nodes = cut(nodes.select(F.col("up").alias("node"), F.sha2(F.array_join("cs.c", ";"), 256).alias("digest")))
        levels.append(nodes)
    return levels


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select(F.col("node").alias("node_b"), F.col("digest").alias("digest_b"))
    joined = a.join(b, F.col("node") == F.col("node_b"), "full_outer")
    return joined.where(~F.col("digest").eqNullSafe(F.col("digest_b"))).select(F.coalesce("node", "node_b").alias("node"))


def audit(ours: DataFrame, theirs: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """What audit_leaves() finds between the leaves of two replicas' records, as records() makes them."""
    return audit_leaves(cut(leaves(ours)), cut(leaves(theirs)), fan_bits)


def audit_leaves(leaf_a: DataFrame, leaf_b: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """(slot, archive, first, last, status): a row for each slot at which two replicas differ, from cut leaves() of each.

    status is `changed`, `missing` (the first only), `extra` (the second only) or `moved`: the same bytes at
    another range, as where a stored offset is damaged or a record before it in the archive has another length.
    The range is the first's, or the second's for an extra. Roots are compared first, then only the children
    of nodes that differ; equal replicas, two empty ones included, end at the root. The comparison below a
    level reads that level's digests and the nodes that differ above it, never records.
    """
    tree_a, tree_b = tree(leaf_a, fan_bits), tree(leaf_b, fan_bits)
    out = "slot long, archive long, first long, last long, status string"
    if len(tree_a) == 1 and "slot" in tree_a[0].columns or len(tree_b) == 1 and "slot" in tree_b[0].columns:
        bad = _differ(leaf_a.select(F.col("slot").alias("node"), "digest"), leaf_b.select(F.col("slot").alias("node"), "digest"))
    else:
        depth = max(len(tree_a), len(tree_b))
        for t in (tree_a, tree_b):
            while len(t) < depth:
                child = F.concat(F.col("node").cast("string"), F.lit(":"), F.col("digest"))
                t.append(t[-1].select(F.shiftright("node", fan_bits).alias("node"), F.sha2(child, 256).alias("digest")))
        bad = cut(_differ(tree_a[-1], tree_b[-1]))
        for k in range(depth - 2, -1, -1):
            if bad.isEmpty():
                break
            # the nodes that differ may be most of a level, so Spark may broadcast them only if they prove small
            above = bad.withColumnRenamed("node", "up")
            some = [t[k].join(above, F.shiftright("node", fan_bits) == F.col("up"), "left_semi") for t in (tree_a, tree_b)]
            bad = cut(_differ(*some))
    if bad.isEmpty():
        return leaf_a.sparkSession.createDataFrame([], out)
    bad = bad.withColumnRenamed("node", "slot")
    a = leaf_a.join(bad, "slot", "left_semi").select("slot", F.struct("archive", "first", "last", "record").alias("a"))
    b = leaf_b.join(bad, "slot", "left_semi").select("slot", F.struct("archive", "first", "last", "record").alias("b"))
    both = a.join(b, "slot", "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a.record") == F.col("b.record"), "moved").otherwise("changed")
    return both.select("slot", F.coalesce("a", "b").alias("at"), status.alias("status")).select("slot", "at.*", "status").select("slot", "archive", "first", "last", "status")


def archives(recs: DataFrame) -> DataFrame:
    """(archive, content): each archive's records in order, as one file's bytes."""
    rows = recs.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("slot", F.sha2("record", 256).alias("d"), "record"))).alias("rs"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [b"".join(r["record"] for r in rs) for rs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole, pa.binary())], ["archive", "content"])

    return rows.select("archive", "rs").mapInArrow(join, "archive long, content binary")


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)


def parse(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each record; a damaged stretch is passed over up to the next record."""
    at = 0
    while (m := _HEAD.search(content, at)) is not None:
        heads = {}
        for line in m[1].decode("utf-8", "replace").split("\r\n"):
            name, _, value = line.partition(":")
            heads[name.strip().lower()] = value.strip()
        size = heads.get("content-length", "")
        if not size.isdigit() or m.end() + int(size) > len(content):
            at = m.start() + 1
            continue
        end = m.end() + int(size)
        yield m.start(), end + 4 - m.start(), heads, content[m.end() : end]
        at = end


def members(content: bytes, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member; a damaged one is passed over up to the next that begins like one."""
    at = content.find(b"\x1f\x8b\x08")
    while at >= 0:
        inflate, out, to = zlib.decompressobj(31), [], at
        try:
            while not inflate.eof and to < len(content):
                out.append(inflate.decompress(content[to : to + step]))
                to += step
        except zlib.error:
            pass
        if inflate.eof:
            end = min(to, len(content)) - len(inflate.unused_data)
            yield at, end - at, b"".join(out)
            at = end - 1
        at = content.find(b"\x1f\x8b\x08", at + 1)


def _spots(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    if content[:2] != b"\x1f\x8b":
        yield from parse(content)
        return
    for at, size, whole in members(content):
        for _, _, heads, payload in parse(whole):
            yield at, size, heads, payload


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, uri, payload) of the records in the files *.warc and *.warc.gz under `path`.

    In a compressed file a record's place is that of its gzip member. A file is read whole by one task and may
    have 2 GB, as Spark's binary files have; a damaged stretch is passed over.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = list(_spots(content or b""))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2].get("warc-target-uri") for f in found], pa.string()), pa.array([f[3] for f in found], pa.binary())],
                    ["file", "offset", "length", "uri", "payload"],
                )

    return files.select("path", "content").mapInArrow(run, "file string, offset long, length long, uri string, payload binary")
