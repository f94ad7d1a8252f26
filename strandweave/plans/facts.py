"""The fact store: canonical snapshots on Parquet, refs, adapters, and the two small query languages."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from strandweave.operators.graph import bfs
from strandweave.runtime import cut

FACT = (
    "subject string, predicate string, object struct<kind:string,text:string,int:bigint,bool:boolean>, "
    "attributes map<string,string>, source struct<adapter:string,locator:string,digest:string>"
)
_NAME = re.compile(r"[A-Za-z0-9._-]+")
MOST_DEPTH = 64


@dataclass(frozen=True)
class Traversal:
    """`DEPENDENCIES <entity> DEPTH <n>` or `IMPACT <entity> DEPTH <n>`."""

    impact: bool
    entity: str
    depth: int


def parse(text: str) -> Traversal:
    parts = text.split()
    if len(parts) != 4 or parts[0].upper() not in ("DEPENDENCIES", "IMPACT") or parts[2].upper() != "DEPTH":
        raise ValueError("expected: DEPENDENCIES|IMPACT <entity> DEPTH <n>")
    if not parts[3].isdigit() or not 1 <= int(parts[3]) <= MOST_DEPTH:
        raise ValueError(f"the depth must be a number from 1 to {MOST_DEPTH}")
    return Traversal(parts[0].upper() == "IMPACT", parts[1], int(parts[3]))


def edges(facts: DataFrame, impact: bool) -> DataFrame:
    """(src, dst) in the direction of travel: depends-on facts between entities."""
    rows = facts.where("predicate = 'depends-on' AND object.kind = 'entity'")
    a, b = F.col("subject"), F.col("object.text")
    return rows.select((b if impact else a).alias("src"), (a if impact else b).alias("dst"))


def traverse(facts: DataFrame, query: Traversal | str, ordered: bool = False) -> DataFrame:
    """(entity, depth): what the start leads to, without the start itself; an unknown entity gives nothing."""
    q = parse(query) if isinstance(query, str) else query
    start = facts.sparkSession.createDataFrame([(q.entity,)], "node string")
    return bfs(edges(facts, q.impact).distinct(), start, q.depth, ordered=ordered).withColumnRenamed("node", "entity")


def support(facts: DataFrame, query: Traversal | str) -> DataFrame:
    """The facts behind a traversal: every edge out of a node that was expanded, those to known nodes included."""
    q = parse(query) if isinstance(query, str) else query
    start = facts.sparkSession.createDataFrame([(q.entity,)], "node string")
    seen = bfs(edges(facts, q.impact).distinct(), start, q.depth, keep_start=True).where(F.col("depth") < q.depth)
    rows = facts.where("predicate = 'depends-on' AND object.kind = 'entity'")
    return rows.join(seen, (F.col("object.text") if q.impact else F.col("subject")) == F.col("node"), "left_semi")


def canonical(facts: DataFrame) -> DataFrame:
    """Facts as JSON payloads, each once; map entries in order, so equal facts have equal payloads."""
    entries = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    kind = F.col("object.kind")
    rank = F.when(kind == "entity", 0).when(kind == "text", 1).when(kind == "integer", 2).otherwise(3)
    payload = F.to_json(F.struct("subject", "predicate", "object", entries.alias("attributes"), "source"))
    own = facts.select("subject", "predicate", rank.alias("rank"), F.col("object.text").alias("otext"), F.col("object.int").alias("oint"), F.col("object.bool").alias("obool"), payload.alias("payload"))
    return own.groupBy("payload").agg(*[F.first(c).alias(c) for c in ("subject", "predicate", "rank", "otext", "oint", "obool")])


def ordinals(facts: DataFrame) -> DataFrame:
    """(ordinal, payload): the canonical total order. Facts are sorted in ranges of it, and each range's numbers begin where those before end."""
    order = ["subject", "predicate", "rank", "otext", "oint", "obool", "payload"]
    rows = canonical(facts).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(rows.select("payload", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("k")))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("part").alias("_part"), before.alias("start"))
    return rows.join(starts, F.col("part") == F.col("_part")).select((F.col("start") + F.col("k")).alias("ordinal"), "payload")


def digest(facts: DataFrame, parent: str | None = None) -> str:
    """A snapshot's id: the hash of its parent and of a tree over its payloads' hashes.

    Hashes meet by their first digits, two digits fewer at each step, so about 256 of them meet in one row however
    many facts there are.
    """
    nodes = cut(canonical(facts).select(F.sha2(F.col("payload").cast("binary"), 256).alias("h")))  # counted, then hashed
    n, digits = nodes.count(), 0
    while n > 256 << (4 * digits):
        digits += 2
    nodes = nodes.select(F.substring("h", 1, digits).alias("at"), "h")
    while True:
        nodes = nodes.groupBy("at").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("at", F.lit(":"), "h"))), "").cast("binary"), 256).alias("h"))
        if not digits:
            break
        digits -= 2
        nodes = nodes.select(F.substring("at", 1, digits).alias("at"), "h")
    top = nodes.first()
    own = facts.sparkSession.range(1).select(F.sha2(F.concat_ws("|", F.lit(parent or ""), F.lit(top["h"] if top else "")).cast("binary"), 256).alias("h"))
    return "sha256:" + own.first()["h"]


class FactStore(Protocol):
    """What a store of facts must offer; another one may stand in for ParquetFactStore."""

    def create_snapshot(self, parent: str | None, facts: DataFrame) -> str: ...
    def facts(self, snapshot: str) -> DataFrame: ...
    def query(self, snapshot: str, text: str) -> DataFrame: ...
    def set_ref(self, name: str, snapshot: str) -> None: ...
    def resolve(self, name_or_id: str) -> str: ...


class ParquetFactStore:
    """Immutable snapshots under `root`, a folder of facts for each id; adding one that is there already changes nothing.

    A snapshot is there once its row is: its facts are written first, under their id and over what a broken
    attempt may have left, so a writer that fails or two that race leave nothing twice.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _folder(self, snapshot: str) -> str:
        return f"facts/{snapshot.replace(':', '-')}"

    def snapshots(self) -> DataFrame:
        return self._read("snapshots", "id string, parent_id string, fact_count long").dropDuplicates(["id"])

    def create_snapshot(self, parent: str | None, facts: DataFrame) -> str:
        own = digest(facts, parent)
        if self.snapshots().where(F.col("id") == own).isEmpty():
            ordinals(facts).write.mode("overwrite").parquet(f"{self.root}/{self._folder(own)}")
            n = self.spark.read.parquet(f"{self.root}/{self._folder(own)}").count()
            self.spark.createDataFrame([(own, parent, n)], "id string, parent_id string, fact_count long").write.mode("append").parquet(f"{self.root}/snapshots")
        return own

    def facts(self, snapshot: str) -> DataFrame:
        if self.snapshots().where(F.col("id") == snapshot).isEmpty():
            raise KeyError(f"no snapshot {snapshot}")
        rows = self._read(self._folder(snapshot), "ordinal long, payload string")
        stored = FACT.replace("attributes map<string,string>", "attributes array<struct<key:string,value:string>>")
        out = rows.select("ordinal", F.from_json("payload", stored).alias("f")).select("ordinal", "f.*")
        return out.withColumn("attributes", F.map_from_entries("attributes"))

    def query(self, snapshot: str, text: str) -> DataFrame:
        return traverse(self.facts(self.resolve(snapshot)), text)

    def set_ref(self, name: str, snapshot: str) -> None:
        if not _NAME.fullmatch(name):
            raise ValueError("a ref's name has letters, digits, dots, dashes and underscores")
        self.facts(snapshot)
        rows = self._read("refs", "name string, snapshot_id string, version long")
        version = (rows.agg(F.max("version")).first()[0] or 0) + 1
        self.spark.createDataFrame([(name, snapshot, version)], "name string, snapshot_id string, version long").write.mode("append").parquet(f"{self.root}/refs")

    def refs(self) -> DataFrame:
        rows = self._read("refs", "name string, snapshot_id string, version long")
        # of two writers that took the same version one wins for all readers
        return rows.groupBy("name").agg(F.max_by("snapshot_id", F.struct("version", "snapshot_id")).alias("snapshot_id"))

    def resolve(self, name_or_id: str) -> str:
        row = self.refs().where(F.col("name") == name_or_id).first()
        if row:
            return row["snapshot_id"]
        if self.snapshots().where(F.col("id") == name_or_id).isEmpty():
            raise KeyError(f"no ref or snapshot {name_or_id}")
        return name_or_id


def fact(df: DataFrame, subject, predicate: str, entity=None, text=None, attributes=None, source=None) -> DataFrame:
    """Rows of FACT from columns; the object is an entity or a text."""
    none = F.lit(None)
    kind = F.lit("entity" if entity is not None else "text")
    obj = F.struct(kind.alias("kind"), (entity if entity is not None else text).cast("string").alias("text"), none.cast("long").alias("int"), none.cast("boolean").alias("bool"))
    src = source if source is not None else F.struct(F.lit("table").alias("adapter"), F.lit("").alias("locator"), F.lit("").alias("digest"))
    attrs = attributes if attributes is not None else F.create_map().cast("map<string,string>")
    return df.select(subject.cast("string").alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"), attrs.alias("attributes"), src.alias("source"))


def facts_from_graph(symbols: DataFrame, refs: DataFrame, file_deps: DataFrame, locator: str, digest_of: str) -> DataFrame:
    """The facts of an index; symbols and files have name spaces of their own, so a symbol named like a file is another entity."""
    symbol = lambda c: F.concat(F.lit("scip:symbol/"), F.col(c))
    file = lambda c: F.concat(F.lit("scip:file/"), F.col(c))
    src = F.struct(F.lit("code-index").alias("adapter"), F.lit(locator).alias("locator"), F.lit(digest_of).alias("digest"))
    attrs = F.create_map(F.lit("display"), F.col("display"), F.lit("kind"), F.col("kind").cast("string"), F.lit("line"), (F.col("def.sl") + 1).cast("string"), F.lit("implementation"), F.col("is_impl").cast("string"))
    own = fact(symbols, symbol("symbol"), "defined-in", file("file"), attributes=attrs, source=src)
    return own.unionByName(fact(refs, symbol("src"), "depends-on", symbol("dst"), source=src)).unionByName(fact(file_deps, file("src"), "depends-on", file("dst"), source=src))


def facts_from_blueprint(rows: DataFrame, locator: str, digest_of: str) -> DataFrame:
    """Facts of a document's (subject, predicate, object), with where they come from."""
    src = F.struct(F.lit("blueprint").alias("adapter"), F.lit(locator).alias("locator"), F.lit(digest_of).alias("digest"))
    obj = F.struct(F.lit("entity").alias("kind"), F.col("object").alias("text"), F.lit(None).cast("long").alias("int"), F.lit(None).cast("boolean").alias("bool"))
    return rows.select("subject", "predicate", obj.alias("object"), F.create_map().cast("map<string,string>").alias("attributes"), src.alias("source"))


_FIELD = re.compile(r"^\s*(?:query\s*)?\{\s*(dependencies|impact)\s*\(([^)]*)\)\s*\{([^}]*)\}\s*\}\s*$")
_ARG = re.compile(r'(\w+)\s*:\s*("(?:[^"\\]|\\.)*"|\d+)')


def graphql(store: FactStore, document: str) -> dict:
    """A read-only document with one of the fields `dependencies` and `impact`; errors are part of the answer."""
    m = _FIELD.match(document)
    if not m:
        return {"data": None, "errors": [{"message": "only dependencies(...) and impact(...) can be asked for"}]}
    args = {k: json.loads(v) for k, v in _ARG.findall(m[2])}
    try:
        text = f"{m[1].upper()} {args['entity']} DEPTH {args['depth']}"
        parse(text)
        facts = store.facts(store.resolve(args.get("snapshot", "main")))
        out: dict = {}
        for name in m[3].split():
            if name == "entities":
                out[name] = [r["entity"] for r in traverse(facts, text, ordered=True).orderBy("depth", "ord").collect()]
            elif name == "factCount":
                out[name] = support(facts, text).count()
            else:
                raise ValueError(f"no field {name}")
        return {"data": {m[1]: out}}
    except (KeyError, ValueError) as e:
        return {"data": None, "errors": [{"message": str(e)}]}
