"""Queries of the code rules, blueprints, clones, graphs and reports, over code and documents made from the driver's tables.

Each part is a source file, each supplier a script, each nation a slot, and so on; the SQL says from the same
columns what the rules must find.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import text as tx
from strandweave.functions.extract import bodies
from strandweave.operators import blueprint, dups, graph, moves, rules
from strandweave.operators import tree as trees
from strandweave.plans import facts as store
from strandweave.plans import report, views
from strandweave.plans.catalog import _FINDINGS, _order_findings, query
from strandweave.runtime import shared_folder, table
from strandweave.sources import repo
from strandweave.streaming import incremental


def _s(c: str) -> Column:
    return F.col(c).cast("string")


# source files from parts and suppliers


def _rust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a file for each part, and for three of four a file that declares it."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").withColumn("dir", F.concat(F.lit("c"), F.substring("p_brand", 7, 9), F.lit("/src/")))
    lines = [
        F.when(k % 3 == 0, "/// A part.").when(k % 3 == 1, "").otherwise("// a note"),
        F.when(k % 2 == 0, "#[derive(Debug)]").otherwise(""),
        F.concat(F.lit("pub struct Part"), _s("p_partkey"), F.lit(";")),
        F.when(k % 5 == 0, F.concat(F.lit("impl Codec for Part"), _s("p_partkey"), F.lit(" {}"))).otherwise(""),
        F.when(k % 7 == 0, F.concat(F.lit('#[pyclass(name = "P'), _s("p_partkey"), F.lit('")]'))).otherwise(""),
        F.concat(F.lit("struct Bound"), _s("p_partkey"), F.lit(";")),
        F.when(k % 11 == 0, "#[pymodule]").otherwise(""),
        F.concat(F.lit("fn module"), _s("p_partkey"), F.lit("() {}")),
        F.concat(F.lit("mod wire"), _s("p_partkey"), F.lit(";")),
        F.when(k % 9 == 0, F.concat(F.lit("impl T"), _s("p_size"), F.lit("x for Part"), _s("p_partkey"), F.lit(" {}"))).otherwise(""),
    ]
    own = p.select(F.concat("dir", F.lit("part"), _s("p_partkey"), F.lit(".rs")).alias("path"), F.concat_ws("\n", *lines).alias("text"))
    wires = p.where(k % 4 != 0).select(F.concat("dir", F.lit("wire"), _s("p_partkey"), F.lit(".rs")).alias("path"), F.concat(F.lit("mod part"), _s("p_partkey"), F.lit(";")).alias("text"))
    return own.unionByName(wires)


_PART = "r AS (SELECT *, p_partkey AS k, 'c' || substr(p_brand, 7) || '/src/part' || p_partkey || '.rs' AS file FROM part)"


@query(f"WITH {_PART} SELECT file, 3 AS line, 'struct Part' || k AS message FROM r WHERE NOT (k % 2 = 0 AND k % 3 = 0)")
def undocumented_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.undocumented(tx.lines_table(_rust(spark, sf_dir))).select("file", "line", "message")


@query(f"WITH {_PART} SELECT file, 'no declaration of part' || k AS message FROM r WHERE k % 4 = 0")
def unwired_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.unwired(tx.lines_table(_rust(spark, sf_dir))).select("file", "message")


@query(f"WITH {_PART} SELECT 'P' || k AS py_name, 'class' AS kind, file, 6 AS line FROM r WHERE k % 7 = 0 UNION ALL SELECT 'module' || k, 'module', file, 8 FROM r WHERE k % 11 = 0")
def ffi_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.exports(tx.lines_table(_rust(spark, sf_dir)))


@query(f"WITH {_PART} SELECT file AS path, 3 AS line_no, 'struct' AS kind, 'Part' || k AS name FROM r UNION ALL SELECT file, 6, 'struct', 'Bound' || k FROM r")
def code_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.definitions(tx.lines_table(_rust(spark, sf_dir)))


@query(f"WITH {_PART} SELECT file AS path, 4 AS line_no, 'Codec' AS trait, 'Part' || k AS type FROM r WHERE k % 5 = 0 UNION ALL SELECT file, 10, 'T' || p_size || 'x', 'Part' || k FROM r WHERE k % 9 = 0")
def code_implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.implementations(tx.lines_table(_rust(spark, sf_dir)))


@query(f"WITH {_PART} SELECT 'class' AS kind, count(*) AS n FROM r WHERE k % 7 = 0 UNION ALL SELECT 'module', count(*) FROM r WHERE k % 11 = 0")
def ffi_export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.export_counts(tx.lines_table(_rust(spark, sf_dir)))


def _python(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a script for each supplier that imports the module of one part."""
    s = table(spark, sf_dir, "supplier")
    module = (F.col("s_suppkey") * 3).cast("string")
    text = F.concat(F.lit("import os\nfrom pkg.module"), module, F.lit(" import fetch"), _s("s_suppkey"), F.lit(", other as o\n"))
    return s.select(F.concat(F.lit("py/s"), _s("s_suppkey"), F.lit(".py")).alias("path"), text.alias("text"))


@query(f"WITH {_PART} SELECT 'pkg.module' || k AS module, file AS rust_file, 'py/s' || s_suppkey || '.py' AS py_file, 2 AS py_line, 'fetch' || s_suppkey || ',other' AS names FROM r JOIN supplier ON k = s_suppkey * 3 WHERE k % 11 = 0")
def ffi_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.ffi_edges(tx.lines_table(_rust(spark, sf_dir)), tx.lines_table(_python(spark, sf_dir)))
    return out.withColumn("names", F.array_join("names", ","))


@query(f"WITH {_PART} SELECT 'pkg.module' || k AS module, file AS rust_file, count(*) AS importers, 2 * count(*) AS names FROM r JOIN supplier ON k = s_suppkey * 3 WHERE k % 11 = 0 GROUP BY ALL")
def ffi_by_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ffi_modules(rules.ffi_edges(tx.lines_table(_rust(spark, sf_dir)), tx.lines_table(_python(spark, sf_dir))))


@query(f"WITH {_PART} SELECT file, 3 AS line, 'Part' || k || ' lacks Codec' AS message FROM r WHERE starts_with(file, 'c1') AND k % 5 != 0 UNION ALL SELECT file, 6, 'Bound' || k || ' lacks Codec' FROM r WHERE starts_with(file, 'c1')")
def contract_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracts = spark.createDataFrame([("codec", "c1", "Codec")], "contract string, path string, trait string")
    return rules.anchors(tx.lines_table(_rust(spark, sf_dir)), contracts).select("file", "line", "message")


@query(f"WITH {_PART}, t AS (SELECT i, count(k) AS n FROM generate_series(1, 60) g(i) LEFT JOIN r ON p_size = i AND k % 9 = 0 GROUP BY i) SELECT 'T' || i || 'x has implementations: ' || n AS message FROM t WHERE n < 2")
def sealed_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracts = spark.range(1, 61).select(F.concat(F.lit("seal"), _s("id")).alias("contract"), F.concat(F.lit("T"), _s("id"), F.lit("x")).alias("trait"))
    return rules.sealed(tx.lines_table(_rust(spark, sf_dir)), contracts).select("message")


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a function for each part whose body follows from its size and type, spaced and commented in its own way."""
    p = table(spark, sf_dir, "part")
    line = lambda i: F.concat(F.repeat(F.lit(" "), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit(f"let v{i} = "), _s("p_size"), F.lit("; // "), "p_name")
    last = F.concat(F.lit("  use_it("), F.lower("p_type"), F.lit(");"))
    text = F.concat_ws("\n", F.concat(F.lit("pub fn f"), _s("p_partkey"), F.lit("(x: u8) {")), *[line(i) for i in range(5)], last, F.lit("}\n"))
    return p.select(F.concat(F.lit("fn/p"), _s("p_partkey"), F.lit(".rs")).alias("path"), text.alias("text"))


_BODY = "b AS (SELECT p_partkey, " + " || chr(10) || ".join([f"'let v{i} = ' || p_size || ';'" for i in range(5)] + ["'use_it(' || lower(p_type) || ');'"]) + " AS body FROM part)"


@query(f"WITH {_BODY} SELECT sha256(body) AS body_hash, count(*) AS sites, 6 AS lines FROM b GROUP BY body HAVING count(*) > 1")
def function_clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dups.clone_groups(bodies(_functions(spark, sf_dir))).select("body_hash", "sites", "lines")


@query(f"WITH {_BODY}, g AS (SELECT body, count(*) AS sites FROM b GROUP BY body HAVING count(*) > 1) SELECT sha256(body) AS body_hash, 'fn/p' || p_partkey || '.rs' AS file, 'f' || p_partkey AS name, 1 AS line, sites FROM b JOIN g USING (body)")
def clone_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dups.clone_sites(bodies(_functions(spark, sf_dir))).select("body_hash", "file", "name", "line", "sites")


@query("SELECT p_partkey AS id, lower(regexp_replace(p_type || p_name, '[^A-Za-z0-9]+', '_', 'g')) AS snake, 'class ' || p_name AS normal FROM part")
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as a scaffold writes them, and lines without their comments and extra spaces."""
    p = table(spark, sf_dir, "part")
    line = F.concat(F.lit("  class   "), "p_name", F.lit("  // size "), _s("p_size"))
    return p.select(F.col("p_partkey").alias("id"), tx.snake(F.concat("p_type", "p_name")).alias("snake"), tx.normalize_line(line).alias("normal"))


@query("SELECT p_partkey AS id, lpad(lower(to_hex(h)), 16, '0') AS hex, true AS back FROM (SELECT p_partkey, CAST(list_reduce(list_prepend(CAST('14695981039346656037' AS HUGEINT), list_transform(range(1, length(p_brand) + 1), lambda i: CAST(ascii(substr(p_brand, CAST(i AS INT), 1)) AS HUGEINT))), lambda a, b: (xor(a, b) * 1099511628211) % CAST('18446744073709551616' AS HUGEINT)) AS UBIGINT) AS h FROM part)")
def name_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of each part's brand, written as hex and read again."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.fnv1a_of(F.col("p_brand")).alias("h"))
    hexed = p.select("id", "h", tx.hash_to_hex(F.col("h")).alias("hex"))
    return hexed.select("id", "hex", (tx.hex_to_hash(F.col("hex")) == F.col("h")).alias("back"))


# graphs


def _occurrences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An index of parts, defined ten lines apart in their brand's file, each used by the part on the line before it in an order."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("file"), F.concat(F.lit("part "), _s("p_partkey")).alias("symbol"))
    at = (F.col("k") * 10).cast("int")
    span = lambda *c: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    defs = parts.select("file", F.col("k").cast("int").alias("ord"), "symbol", F.lit(1).alias("roles"), span(at, 0, 4).alias("range"), span(at, 0, at + 9, 0).alias("enclosing"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("used"))
    pairs = items.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("k"), "used", F.col("l_partkey").cast("int").alias("ord")).distinct()
    line = (F.col("k") * 10 + 1 + F.col("used") % 8).cast("int")
    used = parts.select(F.col("k").alias("used"), "symbol")
    uses = pairs.join(parts.select("k", "file"), "k").join(used, "used").select("file", "ord", "symbol", F.lit(0).alias("roles"), span(line, 2, 6).alias("range"), F.lit(None).cast("array<int>").alias("enclosing"))
    symbols = parts.select("file", "symbol", F.col("symbol").alias("display"), F.when(F.col("k") % 17 == 0, 29).otherwise(7).alias("kind"), (F.col("k") % 2 == 0).alias("is_impl"))
    return defs.unionByName(uses), symbols


_USES = """i AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS k, p_brand AS file FROM lineitem JOIN part ON l_partkey = p_partkey),
u AS (SELECT a.k AS a, b.k AS b, a.file AS fa, b.file AS fb FROM i a JOIN i b ON a.o = b.o AND a.n + 1 = b.n)"""


@query(f"WITH {_USES} SELECT DISTINCT 'part ' || a AS src, 'part ' || b AS dst FROM u WHERE a != b")
def code_graph_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.code_graph(*_occurrences(spark, sf_dir))["refs"]


@query(f"WITH {_USES} SELECT DISTINCT fa AS src, fb AS dst FROM u WHERE fa != fb AND b % 17 != 0")
def code_graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.code_graph(*_occurrences(spark, sf_dir))["file_deps"]


@query("SELECT 'part ' || p_partkey AS symbol, p_brand AS file, CASE WHEN p_partkey % 17 = 0 THEN 29 ELSE 7 END AS kind, p_partkey % 2 = 0 AS is_impl FROM part")
def code_graph_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.code_graph(*_occurrences(spark, sf_dir))["symbols"].select("symbol", "file", "kind", "is_impl")


@query(f"WITH {_USES}, f AS (SELECT 'scip:symbol/part ' || p_partkey AS subject, 'defined-in' AS predicate, 'scip:file/' || p_brand AS object FROM part UNION SELECT DISTINCT 'scip:symbol/part ' || a, 'depends-on', 'scip:symbol/part ' || b FROM u WHERE a != b UNION SELECT DISTINCT 'scip:file/' || fa, 'depends-on', 'scip:file/' || fb FROM u WHERE fa != fb AND b % 17 != 0) SELECT subject, predicate, object, 'code-index' AS adapter, 'all.scip' AS locator FROM f")
def graph_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of an index, symbols and files in name spaces of their own."""
    g = graph.code_graph(*_occurrences(spark, sf_dir))
    rows = store.facts_from_graph(g["symbols"], g["refs"], g["file_deps"], "all.scip", "sha256:0")
    return rows.select("subject", "predicate", F.col("object.text").alias("object"), "source.adapter", "source.locator")


@query("WITH m AS (SELECT 'n' || s_nationkey AS dir, s_suppkey AS k FROM supplier), i AS (SELECT l_orderkey AS file, l_suppkey AS k FROM lineitem), c AS (SELECT file, dir, count(*) AS n FROM i JOIN m USING (k) GROUP BY file, dir) SELECT 'o' || file AS file, dir, n, CAST(row_number() OVER (PARTITION BY file ORDER BY n DESC, dir) AS INTEGER) AS rank FROM c")
def place_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as new files, placed by the nations of the suppliers they name."""
    imports = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), _s("l_orderkey")).alias("file"), _s("l_suppkey").alias("module"))
    modules = table(spark, sf_dir, "supplier").select(_s("s_suppkey").alias("module"), F.concat(F.lit("n"), _s("s_nationkey")).alias("dir"))
    return graph.place_new(imports, modules)


def _supplied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols of customers and orders (public ones are roots), references from orders to customers, and their lines."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    symbol = lambda df, kind, key, pub: df.select(F.concat(F.lit(kind), _s(key)).alias("symbol"), F.concat(F.lit(f"{kind}/"), _s(key), F.lit(".rs")).alias("file"), pub.alias("pub"))
    rows = symbol(c, "c", "c_custkey", F.lit(False)).unionByName(symbol(o, "o", "o_orderkey", F.col("o_orderstatus") == "P"))
    symbols = rows.select("symbol", "file", F.col("symbol").alias("display"), F.lit(12).alias("kind"), F.lit(False).alias("is_impl"), F.struct(F.lit(0).alias("sl")).alias("def"))
    lines = rows.select(F.col("file").alias("path"), F.lit(1).alias("line_no"), F.concat(F.when(F.col("pub"), "pub fn ").otherwise("fn "), "symbol", F.lit("() {}")).alias("line"))
    refs = o.select(F.concat(F.lit("o"), _s("o_orderkey")).alias("src"), F.concat(F.lit("c"), _s("o_custkey")).alias("dst"))
    return symbols, refs, lines


@query("SELECT 'o' || o_orderkey AS symbol FROM orders WHERE o_orderstatus = 'P'")
def liveness_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, _, lines = _supplied(spark, sf_dir)
    return rules.public_roots(symbols, lines)


@query("SELECT 'o' || o_orderkey AS symbol, 'o/' || o_orderkey || '.rs' AS file, 1 AS line FROM orders WHERE o_orderstatus != 'P' UNION ALL SELECT 'c' || c_custkey, 'c/' || c_custkey || '.rs', 1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def dead_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.dead_symbols(*_supplied(spark, sf_dir))


@query("SELECT 'c' || c_custkey AS id, 'r' || (n_regionkey % 3) AS layer FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey, 'r' || (n_regionkey % 3) FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || (r_regionkey % 3) FROM region")
def inherited_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer of every node down to the customers, declared at the regions."""
    nodes = views.tree(spark, sf_dir).where("id RLIKE '^[rnc][0-9]'")
    nodes = nodes.withColumn("parent", F.when(F.col("id").startswith("r"), None).otherwise(F.col("parent"))).withColumn("layer", F.when(F.col("id").startswith("r"), F.concat(F.lit("r"), (F.substring("id", 2, 9).try_cast("int") % 3).cast("string"))))
    layers = spark.createDataFrame([("r0", 0), ("r1", 1), ("r2", 2)], "layer string, idx int")
    return trees.layer_of(nodes, layers)


# facts


@query("SELECT 'main' AS name, count(DISTINCT o_orderkey) + 1 AS facts, 1 AS snapshots_more FROM orders")
def refs_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of all orders, a second one with one fact more, the same one again; the ref ends at the second."""
    rows = store.fact(table(spark, sf_dir, "orders"), F.concat(F.lit("order:"), _s("o_orderkey")), "depends-on", F.concat(F.lit("customer:"), _s("o_custkey")))
    more = rows.unionByName(store.fact(spark.range(1), F.lit("order:new"), "depends-on", F.lit("customer:new")))
    db = store.ParquetFactStore(spark, f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}")
    first = db.create_snapshot(None, rows)
    db.set_ref("main", first)
    second = db.create_snapshot(first, more)
    db.set_ref("main", second)
    db.create_snapshot(first, more)
    counts = db.facts(db.resolve("main")).agg(F.count("*").alias("facts"))
    return counts.select(F.lit("main").alias("name"), "facts", F.lit(db.snapshots().count() - 1).alias("snapshots_more"))


@query("SELECT count(*) AS files, count(*) FILTER (WHERE doc_id % 3 != 0) AS cache_hits FROM documents")
def scan_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scanned, of which the cache knows two thirds; the others are of another size there."""
    files = views.files(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.lit("/doc_"), _s("doc_id"), F.lit(".txt")).alias("rel"), "doc_id"), "rel")
    files = files.withColumn("size", F.octet_length("content").cast("long")).withColumn("modified", F.lit("2024-01-01").cast("timestamp"))
    known = dups.file_facts(files).join(files.select("rel", "doc_id", "modified"), "rel").withColumn("size", F.when(F.col("doc_id") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return incremental.refresh(files, known)[1]


@query("SELECT 'src/a/f' || (s_suppkey) || '.rs' AS id, 'src/a' AS parent, 'atom' AS kind, 'rust' AS language FROM supplier UNION ALL SELECT * FROM (VALUES ('src/a', 'src', 'composite', 'rust'), ('src', '.', 'composite', NULL), ('.', NULL, 'composite', NULL)) v(id, parent, kind, language)")
def derived_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/a/f"), _s("s_suppkey"), F.lit(".rs")).alias("rel"))
    return repo.derived_tree(files).select("id", "parent", "kind", "language")


# reports


_ALL = f"WITH {_FINDINGS.replace(' AS file FROM orders)', ' AS file, o_custkey AS line, o_orderpriority AS message FROM orders)')}"


@query(f"{_ALL} SELECT '{{\"ruleId\":\"' || rule || '\",\"level\":\"' || severity || '\",\"message\":{{\"text\":\"' || message || '\"}},\"locations\":[{{\"physicalLocation\":{{\"artifactLocation\":{{\"uri\":\"' || file || '\"}},\"region\":{{\"startLine\":' || greatest(line, 1) || '}}}}}}]}}' AS json FROM f")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_results(_order_findings(spark, sf_dir))


@query(f"{_ALL} SELECT CASE severity WHEN 'error' THEN '✗' WHEN 'warning' THEN '!' ELSE '·' END || ' [' || rule || '] ' || file || ':' || line || ' — ' || message AS line FROM f")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rendered(_order_findings(spark, sf_dir))


@query(f"{_ALL} SELECT '{{\"rule\":\"' || rule || '\",\"severity\":\"' || severity || '\",\"message\":\"' || message || '\",\"location\":{{\"file\":\"' || file || '\",\"line\":' || line || '}}}}' AS json FROM f")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.to_json(_order_findings(spark, sf_dir))


# blueprints: a document for each region, a slot for each nation


def _blueprints(spark: SparkSession, sf_dir: str, whole: bool = False) -> blueprint.Tables:
    """Ports are customers (out) and suppliers (in); an order flows from its customer to its first line's supplier. With `whole` all is one document."""
    t = lambda n: table(spark, sf_dir, n)
    name = F.when(F.col("n_nationkey") % 9 == 0, F.replace("n_name", F.lit("_"), F.lit(" "))).otherwise(F.col("n_name"))
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(F.lit("world").alias("b") if whole else F.col("r_name").alias("b"), "n_nationkey", name.alias("slot"))
    c = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    first = t("lineitem").groupBy("l_orderkey").agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("to"))
    o = t("orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).join(c.select("c_custkey", "b"), F.col("o_custkey") == F.col("c_custkey"))
    none, key = F.array().cast("array<string>"), lambda p, k: F.concat(F.lit(p), _s(k))
    port = lambda df, p, k, way, kind, permanent: df.select(F.col("b").alias("blueprint_id"), key(p, k).alias("id"), "slot", F.lit(way).alias("direction"), kind.alias("type"), F.lit(permanent).alias("permanent"))
    slots = F.when(F.col("s_suppkey") % 10 == 0, F.array("slot", F.lit("nowhere"))).otherwise(F.array("slot"))
    meta = n.select("b").distinct().select(F.col("b").alias("blueprint_id"), F.col("b").alias("title"), F.lit("draft").alias("lifecycle"), F.lit(None).cast("string").alias("supersedes"))
    covers = F.when(F.col("c_custkey") % 3 == 0, F.array("slot", F.lit("moon"))).otherwise(F.array("slot", key("c", "c_custkey")))
    return {
        "meta": meta,
        "slot": n.select(F.col("b").alias("blueprint_id"), F.col("slot").alias("id"), F.col("slot").alias("purpose"), none.alias("invariants"), (F.col("n_nationkey") % 2 == 0).alias("allow_fusion")),
        "port": port(c, "c", "c_custkey", "output", F.col("c_mktsegment"), False).unionByName(port(s, "s", "s_suppkey", "input", F.lit("rows"), True)),
        "flow": o.select(F.col("b").alias("blueprint_id"), key("f", "o_orderkey").alias("id"), key("c", "o_custkey").alias("from"), key("s", "to").alias("to"), F.col("o_orderpriority").startswith("1").alias("stateful")),
        "implementation": s.select(F.col("b").alias("blueprint_id"), key("i", "s_suppkey").alias("id"), slots.alias("slots"), F.when(F.col("s_suppkey") % 7 == 0, " ").otherwise("a.rs#b").alias("binding")),
        "adapter": s.where("s_suppkey % 25 = 0").select(F.col("b").alias("blueprint_id"), key("a", "s_suppkey").alias("id"), key("s", "s_suppkey").alias("from_port"), F.lit("gone").alias("to_port"), F.lit("a.rs#c").alias("binding"), F.lit("w").alias("witness")),
        "witness": c.select(F.col("b").alias("blueprint_id"), key("w", "c_custkey").alias("id"), F.lit("unit").alias("kind"), covers.alias("covers"), F.lit("true").alias("command")),
    }


_BLUE = """n AS (SELECT r_name AS b, n_nationkey AS nk, CASE WHEN n_nationkey % 9 = 0 THEN replace(n_name, '_', ' ') ELSE n_name END AS slot FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT b, c_custkey AS k, slot FROM customer JOIN n ON c_nationkey = nk), s AS (SELECT b, s_suppkey AS k, slot, nk FROM supplier JOIN n ON s_nationkey = nk),
o AS (SELECT c.b, o_orderkey AS k, c.k AS ck, c.slot AS src, s.k AS sk, s.b AS sb, s.slot AS dst, starts_with(o_orderpriority, '1') AS stateful
  FROM orders JOIN c ON o_custkey = c.k JOIN (SELECT l_orderkey, arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS sk FROM lineitem GROUP BY l_orderkey) f ON l_orderkey = o_orderkey JOIN s ON s.k = f.sk),
e AS (SELECT DISTINCT b, src, dst FROM o WHERE b = sb AND NOT stateful),
w AS (SELECT * FROM e UNION SELECT w.b, w.src, e.dst FROM w JOIN e ON w.b = e.b AND w.dst = e.src)"""


@query(f"""WITH RECURSIVE {_BLUE}
SELECT b AS blueprint_id, 'bad slot id' AS problem, slot AS id FROM n WHERE contains(slot, ' ')
UNION ALL SELECT b, 'flow to no port', 'f' || k FROM o WHERE b != sb
UNION ALL SELECT b, 'implementation of no slot', 'i' || k FROM s WHERE k % 10 = 0
UNION ALL SELECT b, 'implementation without binding', 'i' || k FROM s WHERE k % 7 = 0
UNION ALL SELECT b, 'fusion of a slot that forbids it', 'i' || k FROM s WHERE k % 10 = 0 AND nk % 2 != 0
UNION ALL SELECT b, 'fusion without a differential witness', 'i' || k FROM s WHERE k % 10 = 0
UNION ALL SELECT b, 'adapter to_port is no port', 'a' || k FROM s WHERE k % 25 = 0
UNION ALL SELECT b, 'adapter without witness', 'a' || k FROM s WHERE k % 25 = 0
UNION ALL SELECT b, 'witness of nothing', 'w' || k FROM c WHERE k % 3 = 0
UNION ALL SELECT DISTINCT b, 'cycle without a stateful flow', src FROM w WHERE src = dst""")
def blueprint_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blueprint.validate(_blueprints(spark, sf_dir))


@query(f"WITH RECURSIVE {_BLUE} SELECT DISTINCT b AS blueprint_id, src AS id FROM w WHERE src = dst")
def slot_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blueprint.unmarked_cycles(_blueprints(spark, sf_dir))


@query(f"""WITH RECURSIVE {_BLUE}
SELECT b || '#slot/' || slot AS subject, 'member-of' AS predicate, b AS object FROM n UNION SELECT b || '#port/c' || k, 'member-of', b || '#slot/' || slot FROM c
UNION SELECT b || '#port/s' || k, 'member-of', b || '#slot/' || slot FROM s UNION SELECT b || '#slot/' || dst, 'depends-on', b || '#slot/' || src FROM o WHERE b = sb
UNION SELECT b || '#implementation/i' || k, 'realizes', b || '#slot/' || slot FROM s UNION SELECT b || '#implementation/i' || k, 'realizes', b || '#slot/nowhere' FROM s WHERE k % 10 = 0""")
def blueprint_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blueprint.fact_rows(_blueprints(spark, sf_dir))


@query("""SELECT 'does not name its predecessor' AS problem, 'later' AS id UNION ALL SELECT 'permanent port is missing', 's' || s_suppkey FROM supplier WHERE s_suppkey % 11 = 0
UNION ALL SELECT 'permanent port has changed', 's' || s_suppkey FROM supplier WHERE s_suppkey % 11 != 0 AND s_suppkey % 5 = 0
UNION ALL SELECT 'permanent port without witness', 's' || s_suppkey FROM supplier WHERE s_suppkey % 11 != 0 AND s_suppkey % 2 = 0""")
def blueprint_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of all nations, and a later one in which ports are gone, changed or uncovered."""
    old = _blueprints(spark, sf_dir, whole=True)
    key = F.substring("id", 2, 20).cast("long")
    supplied = F.col("id").startswith("s")
    ports = old["port"].where(~supplied | (key % 11 != 0)).withColumn("type", F.when(supplied & (key % 5 == 0), "bytes").otherwise(F.col("type")))
    covered = old["port"].where(supplied & (key % 2 != 0)).select(F.lit("later").alias("blueprint_id"), F.concat(F.lit("w"), "id").alias("id"), F.lit("unit").alias("kind"), F.array("id").alias("covers"), F.lit("true").alias("command"))
    new = {**old, "meta": old["meta"].withColumn("blueprint_id", F.lit("later")).withColumn("supersedes", F.lit("other")), "port": ports, "witness": covered}
    return blueprint.evolution(old, new)


@query()
def blueprint_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blueprint.shape_digests(_blueprints(spark, sf_dir))


@query()
def move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits of moving a module that the file of each supplier uses."""
    uses = table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/s"), _s("s_suppkey"), F.lit(".rs")).alias("path"), F.concat(F.lit("use crate::a::b::f;\nuse crate::a::bc;\n// "), "s_name", F.lit("\n")).alias("text"))
    rest = spark.createDataFrame([("src/lib.rs", "mod a;\nmod util;\n"), ("src/a.rs", "pub mod b;\n"), ("src/a/b.rs", "pub fn f() {}\n"), ("src/util.rs", "")], "path string, text string")
    return moves.plan_move(uses.unionByName(rest), "src/a/b.rs", "src/util/b.rs")[0]
