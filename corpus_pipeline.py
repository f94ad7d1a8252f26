"""A corpus from raw documents to token ids: five stages, each an operator of strandweave.llm."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import bpe, decision_list, line_dedup, mixing, simhash
from strandweave.llm.queries import RANKS
from strandweave.runtime import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _only(docs: DataFrame, keys: DataFrame, key: dict[str, str]) -> DataFrame:
    """Rows of `docs` with a row in `keys`, nulls being equal to nulls."""
    on = F.lit(True)
    for mine, other in key.items():
        on = on & docs[mine].eqNullSafe(keys[other])
    return docs.join(keys, on, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep; their columns are unchanged.

    The list is learned from the labels of documents in `docs` outside the held-out fold. A null or empty text is
    rejected. Null and repeated ids and repeated rows are judged by their own text and keep their rows; no rows
    give none.
    """
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    return decision_list.kept_rows(docs, rules).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, rid of later occurrences of windows of three lines; n_chars follows the text.

    A null text stays null, an empty one empty. Ties go by id (nulls first), then by a hash of the text: the
    first place keeps its lines. Rows of one id and text are one document and all stay; no rows give none.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id.

    Five words a shingle; texts are linked within 4 bits of their fingerprints, and at a similarity of 0.8 or
    more of their shingles. Rows with that id but another text (or the same row repeated) come down to one by
    the text's hash. A group whose ids are all null keeps one row, that of the least hash. Null and empty texts
    are one group; no rows give none.
    """
    rows = docs.select(*COLUMNS)
    return simhash.representatives(rows, shingle=5, threshold=4, similarity=0.8).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says.

    A null text has size 0, an empty one too; the null source is a source. Rows of equal or null id share their
    number and so their copies, and repeated rows count one by one. No rows give none.
    """
    return mixing.mix(docs.select(*COLUMNS))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row, copies and rows of null or repeated id included.

    A null or empty text has no tokens; no rows give none.
    """
    both = bpe.encode(docs, bpe.load(spark, RANKS), public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("simhash near-dedup", simhash_dedup),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode_tokens),
]
#: Learned rules, 64-bit hashes and BPE merges aren't SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; each result but the last is written as Parquet to the shared folder and read again.

    A stage's result goes once the next one's is written; the last of them stays, as the rows given read it.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return STAGES[-1][1](spark, docs, sf_dir)
