"""File facts kept up to date: only files whose size or time changed are read again."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from strandweave.functions.text import shingles
from strandweave.operators.dups import MAX_BYTES, file_facts
from strandweave.runtime import cut, replace_table
from strandweave.sources import repo

VERSION = 1
CACHE = "version int, rel string, subrepo string, size long, modified timestamp, is_binary boolean, lines long, hash string"


@dataclass(frozen=True)
class ScanConfig:
    """How a repository is scanned; each method gives a changed copy."""

    cap: int = MAX_BYTES
    skip: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    shingles: bool = False
    cache: str | None = None

    @classmethod
    def gate(cls) -> ScanConfig:
        """What a check needs: facts alone."""
        return cls()

    def with_shingles(self) -> ScanConfig:
        return replace(self, shingles=True)

    def skipping(self, *names: str) -> ScanConfig:
        return replace(self, skip=(*self.skip, *names))

    def max_bytes(self, cap: int) -> ScanConfig:
        return replace(self, cap=cap)

    def with_cache(self, path: str | None = None) -> ScanConfig:
        """Facts are kept at `path`, or in the scanned repository's own folder."""
        return replace(self, cache=path or "")


def scan(spark: SparkSession, root: str, config: ScanConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, counts) of the files under `root`; with shingles the facts have an array of them. A cache is read first and written after."""
    config = config or ScanConfig.gate()
    files = repo.contents(spark, root, config.cap, config.suffixes, config.skip).withColumn("subrepo", F.lit("")).persist()
    path = None if config.cache is None else config.cache or "file:" + os.path.join(os.path.abspath(root), ".strandweave", "cache")
    facts, counts = refresh(files, load_cache(spark, path) if path else spark.createDataFrame([], CACHE).drop("version"))
    facts, counts = cut(facts), cut(counts)
    if path:
        save_cache(facts, path)
    if config.shingles:
        sets = repo.texts(files).select(F.col("path").alias("_path"), shingles(F.col("text")).alias("shingles"))
        facts = facts.join(sets, F.col("rel") == F.col("_path"), "left").drop("_path")
    return facts, counts


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cached facts; none if the cache is missing, broken or of another version."""
    try:
        return spark.read.schema(CACHE).parquet(path).where(F.col("version") == VERSION).drop("version")
    except AnalysisException:
        return spark.createDataFrame([], CACHE).drop("version")


def refresh(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, counts) for files (rel, subrepo, size, modified, content): cached where size and time agree, else computed anew."""
    known = cache.select("rel", "size", "modified", "is_binary", "lines", "hash")
    meta = files.select("rel", "subrepo", "size", "modified")
    hits = meta.join(known, ["rel", "size", "modified"]).select("rel", "subrepo", "size", "modified", "is_binary", "lines", "hash")
    cold = files.join(known.select("rel", "size", "modified"), ["rel", "size", "modified"], "left_anti")
    # the size is the listing's: content over the cap isn't read
    fresh = file_facts(cold).drop("size").join(cold.select("rel", "size", "modified"), "rel").select("rel", "subrepo", "size", "modified", "is_binary", "lines", "hash")
    facts = hits.withColumn("hit", F.lit(True)).unionByName(fresh.withColumn("hit", F.lit(False)))
    return facts.drop("hit"), facts.agg(F.count("*").alias("files"), F.count_if("hit").alias("cache_hits"))


def save_cache(facts: DataFrame, path: str) -> None:
    """Writes a new version of the cache beside the old one, from which `facts` may be read, and then puts it in its place."""
    rows = facts.select(F.lit(VERSION).alias("version"), *[c for c in CACHE.replace(" ", ",").split(",") if c in facts.columns])
    replace_table(rows, path)


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """A stream over `folder`: facts of files that arrive are appended to `out`, each file once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)
    rows = files.select(F.col("path").alias("rel"), F.lit("").alias("subrepo"), "content")
    return file_facts(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
