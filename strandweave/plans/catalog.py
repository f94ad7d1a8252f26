"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import text as tx
from strandweave.operators import dups, graph, rules
from strandweave.operators import tree as trees
from strandweave.plans import facts as store
from strandweave.plans import views
from strandweave.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.traverse(views.key_facts(spark, sf_dir), "IMPACT nation:3 DEPTH 3").select("depth", "entity")


_FILES = "files AS (SELECT source || '/doc_' || doc_id || '.txt' AS rel, source, lang, text, strlen(text) AS size, len(text) - len(replace(text, chr(10), '')) + CASE WHEN text != '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines, CASE WHEN text != '' AND strlen(text) <= 2000000 THEN sha256(text) END AS hash FROM documents)"
_TREE = """nodes AS (
  SELECT 'root' AS id, NULL AS parent, 'composite' AS kind, CAST(NULL AS BIGINT) AS loc
  UNION ALL SELECT 'r' || r_regionkey, 'root', 'composite', NULL FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'composite', NULL FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'composite', NULL FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'composite', NULL FROM orders
  UNION ALL SELECT 'o' || l_orderkey || '/' || l_linenumber, 'o' || l_orderkey, 'atom', CAST(sum(l_quantity) AS BIGINT) FROM lineitem GROUP BY l_orderkey, l_linenumber),
reach AS (SELECT id, 0 AS level FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, r.level + 1 FROM nodes n JOIN reach r ON n.parent = r.id),
live AS (SELECT n.*, r.level FROM nodes n JOIN reach r USING (id)),
up AS (SELECT id, id AS anc, 0 AS distance FROM live UNION ALL SELECT u.id, n.parent, u.distance + 1 FROM up u JOIN live n ON u.anc = n.id WHERE n.parent IS NOT NULL)"""
_EDGES = """items AS (SELECT l_orderkey, l_linenumber, p_brand || '/' || p_partkey AS file FROM lineitem JOIN part ON l_partkey = p_partkey),
edges AS (SELECT DISTINCT a.file AS src, b.file AS dst FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.file != b.file)"""
_DIR = "regexp_extract({}, '^(.*)/[^/]*$', 1)"
_KEYS = """links AS (
  SELECT 'order:' || o_orderkey AS subject, 'customer:' || o_custkey AS object FROM orders
  UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation
  UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier)"""
_WALK = """walk AS (
  SELECT '{start}' AS entity, 0 AS depth
  UNION SELECT l.{to}, w.depth + 1 FROM walk w JOIN links l ON l.{frm} = w.entity WHERE w.depth < {depth})"""


# files and duplicates


@query(f"WITH {_FILES} SELECT rel, source AS subrepo, CAST(size AS BIGINT) AS size, contains(left(text, 8192), chr(0)) AS is_binary, CAST(lines AS BIGINT) AS lines, hash FROM files")
def file_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dups.file_facts(views.files(spark, sf_dir))


@query(f"WITH {_FILES} SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE size > 5000) AS over_cap, count(*) FILTER (WHERE contains(left(text, 8192), chr(0))) AS binaries, 0 AS unreadable, count(*) FILTER (WHERE size = 0) AS empty FROM files")
def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dups.scan_counts(dups.file_facts(views.files(spark, sf_dir)), 5000)


@query("SELECT source || '/doc_' || doc_id || '.txt' AS path, CAST(count(*) AS BIGINT) AS lines, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM (SELECT source, doc_id, unnest(CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN list_slice(string_split(text, chr(10)), 1, -2) ELSE string_split(text, chr(10)) END) AS line FROM documents) GROUP BY 1")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.lines(spark, sf_dir).groupBy("path").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line")).alias("bytes"))


@query(f"WITH {_FILES}, g AS (SELECT lang, hash, min(rel) AS first, count(*) AS n, CAST(arg_min(lines, rel) AS BIGINT) AS loc FROM files WHERE hash IS NOT NULL GROUP BY lang, hash HAVING count(*) > 1) SELECT f.lang AS subrepo, rel, first, n, loc FROM files f JOIN g ON f.lang = g.lang AND f.hash = g.hash")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dups.dup_members(dups.file_facts(views.files(spark, sf_dir, "lang"))).drop("hash")


@query(f"WITH {_FILES} SELECT hash, count(DISTINCT source) AS subrepos FROM files WHERE hash IS NOT NULL GROUP BY hash HAVING count(DISTINCT source) > 1")
def cross_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dups.mirrors(dups.file_facts(views.files(spark, sf_dir)))


_GROUPS = "g AS (SELECT lang, hash, count(*) AS n, arg_min(lines, rel) AS loc FROM files WHERE hash IS NOT NULL GROUP BY lang, hash HAVING count(*) > 1)"


@query(f"WITH {_FILES}, {_GROUPS} SELECT count(*) AS \"groups\", CAST(sum(n - 1) AS BIGINT) AS dup_files, CAST(sum((n - 1) * loc) AS BIGINT) AS wasted_loc FROM g")
def dup_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dups.dup_waste(dups.file_facts(views.files(spark, sf_dir, "lang")))


@query(r"""WITH d AS (SELECT source || '/doc_' || doc_id || '.txt' AS rel, lang, list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[.\n]'), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: strlen(x) >= 4)) AS s FROM documents),
f AS (SELECT * FROM d WHERE len(s) >= 8), r AS (SELECT rel, lang, unnest(s) AS x FROM f), k AS (SELECT x FROM r GROUP BY x HAVING count(*) BETWEEN 2 AND 40),
p AS (SELECT a.rel AS a, b.rel AS b FROM r a JOIN r b ON a.x = b.x AND a.lang = b.lang AND a.rel < b.rel WHERE a.x IN (SELECT x FROM k) GROUP BY 1, 2 HAVING count(*) >= 5),
j AS (SELECT p.a, p.b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS n FROM p JOIN f x ON x.rel = p.a JOIN f y ON y.rel = p.b)
SELECT a, b, round(i / CAST(n - i AS DOUBLE), 6) AS similarity FROM j WHERE i < n - i AND i / CAST(n - i AS DOUBLE) >= 0.5""")
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dups.near_dup_pairs(views.files(spark, sf_dir, "lang"), 0.5, r"[.\n]").withColumn("similarity", F.round("similarity", 6))


@query("""SELECT sha256(body) AS body_hash, count(*) AS sites FROM (SELECT trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \\t\\n\\r]+', ' ', 'g')) AS body FROM documents) WHERE body != '' GROUP BY body HAVING count(*) > 1""")
def clone_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = tx.collapse(F.col("line"))
    rows = views.lines(spark, sf_dir).select(F.col("path").alias("file"), F.lit("line").alias("name"), F.col("line_no").alias("line"), body.alias("body"), F.lit(9).alias("lines"))
    return dups.clone_groups(rows.where("body != ''")).select("body_hash", "sites")


# trees


@query(f"WITH RECURSIVE {_TREE} SELECT u.anc AS id, count(*) FILTER (WHERE n.kind = 'atom') AS files, CAST(coalesce(sum(n.loc), 0) AS BIGINT) AS loc FROM up u JOIN live n USING (id) GROUP BY u.anc")
def tree_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.subtree(views.tree(spark, sf_dir)).select("id", "files", "loc")


@query(f"WITH RECURSIVE {_TREE} SELECT u.anc AS id, CAST(max(u.distance + CASE WHEN n.kind = 'atom' THEN 1 ELSE 1 END) AS BIGINT) AS depth FROM up u JOIN live n USING (id) GROUP BY u.anc")
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.subtree(views.tree(spark, sf_dir)).select("id", "depth")


@query(f"""WITH RECURSIVE {_TREE}, kids AS (SELECT parent AS id, count(*) AS n FROM live WHERE parent IS NOT NULL GROUP BY parent),
w AS (SELECT l.id, 1 + ln(greatest(k.n, 1)) / 10 AS f FROM live l LEFT JOIN kids k USING (id) WHERE l.kind = 'composite'),
climb AS (SELECT id, id AS anc, CAST(loc AS DOUBLE) AS score FROM live WHERE kind = 'atom' UNION ALL SELECT c.id, n.parent, c.score * w.f FROM climb c JOIN live n ON c.anc = n.id JOIN w ON w.id = n.parent)
SELECT anc AS id, round(sum(score), 3) AS score FROM climb GROUP BY anc ORDER BY sum(score) DESC, anc LIMIT 15""")
def tree_complexity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trees.subtree(views.tree(spark, sf_dir))
    return rows.orderBy(F.desc("score"), "id").limit(15).select("id", F.round("score", 3).alias("score"))


@query("SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_custkey IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)")
def empty_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.subtree(views.tree(spark, sf_dir)).where("kind = 'composite' AND files = 0 AND parent IS NOT NULL").select("id")


def _broken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tree with a nation and an order gone, and lists of children and dependencies that no longer fit."""
    nodes = views.tree(spark, sf_dir)
    children = nodes.where("parent IS NOT NULL AND id NOT LIKE 'c%7' AND id NOT LIKE 'o%7'").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    return nodes.where("id NOT IN ('n3', 'o1')"), children, spark.createDataFrame([("r0", "r1"), ("r0", "r99")], "id string, target string")


@query(f"""WITH RECURSIVE {_TREE}, k AS (SELECT * FROM nodes WHERE id NOT IN ('n3', 'o1')),
ch AS (SELECT parent AS id, id AS child FROM nodes WHERE parent IS NOT NULL AND id NOT LIKE 'c%7' AND id NOT LIKE 'o%7'), dep AS (SELECT * FROM (VALUES ('r0', 'r1'), ('r0', 'r99')) v(id, target))
SELECT 'parent missing' AS problem, id, parent AS other FROM k WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM k)
UNION ALL SELECT 'not listed by parent', id, parent FROM k WHERE parent IN (SELECT id FROM k) AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.id = k.parent AND ch.child = k.id)
UNION ALL SELECT 'names another parent', child, ch.id FROM ch WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.id = ch.child AND k.parent = ch.id)
UNION ALL SELECT 'dependency missing', id, target FROM dep WHERE target NOT IN (SELECT id FROM k)""")
def tree_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.invariants(*_broken(spark, sf_dir))


@query("SELECT 'o' || l_orderkey AS parent, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1 HAVING count(*) > 5")
def bounded_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.growth(views.tree(spark, sf_dir), 5)


_HOMES = "homes AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS home FROM pages UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[^/]+)/', 1) FROM pages)"


@query(f"WITH {_HOMES} SELECT p.path, coalesce(arg_max(h.home, len(h.home)), '') AS home FROM (SELECT DISTINCT url AS path FROM pages) p LEFT JOIN homes h ON starts_with(p.path, h.home || '/') AND h.home != '' GROUP BY p.path")
def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    hosts = p.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("home"))
    sections = p.select(F.regexp_extract("url", "^(https?://[^/]+/[^/]+)/", 1).alias("home"))
    return trees.nearest_ancestor(p.select(F.col("url").alias("path")), hosts.union(sections).where("home != ''"))


@query("SELECT source AS dir, arg_max(lang, (n, lang)) AS language FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang) GROUP BY source")
def dominant_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return d.groupBy(F.col("source").alias("dir")).agg(F.max(F.struct("n", "lang")).getField("lang").alias("language"))


_LAYERS = "(VALUES ('low', 0), ('mid', 1), ('high', 2)) v(layer, idx)"


@query(f"WITH {_EDGES}, l AS (SELECT DISTINCT file, CASE WHEN file < 'Brand#23' THEN 'low' WHEN file < 'Brand#4' THEN 'mid' WHEN file < 'Brand#53' THEN 'high' END AS layer FROM items), x AS (SELECT file, layer, idx FROM l JOIN {_LAYERS} USING (layer)) SELECT src, dst, a.layer AS from_layer, b.layer AS to_layer FROM edges JOIN x a ON a.file = src JOIN x b ON b.file = dst WHERE b.idx > a.idx")
def layer_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.part_edges(spark, sf_dir)
    nodes = views.part_files(spark, sf_dir).select(F.col("file").alias("id")).distinct()
    layer = F.when(F.col("id") < "Brand#23", "low").when(F.col("id") < "Brand#4", "mid").when(F.col("id") < "Brand#53", "high")
    levels = spark.createDataFrame([("low", 0), ("mid", 1), ("high", 2)], "layer string, idx int")
    return trees.layer_violations(edges, nodes.withColumn("layer", layer), levels)


# graphs


@query(f"WITH RECURSIVE {_KEYS}, {_WALK.format(start='nation:3', frm='object', to='subject', depth=3)} SELECT CAST(min(depth) AS INTEGER) AS depth, entity FROM walk GROUP BY entity HAVING entity != 'nation:3'")
def bql_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@query(f"WITH RECURSIVE {_KEYS}, {_WALK.format(start='order:7', frm='subject', to='object', depth=64)} SELECT CAST(min(depth) AS INTEGER) AS depth, entity FROM walk GROUP BY entity HAVING entity != 'order:7'")
def bql_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.traverse(views.key_facts(spark, sf_dir), "dependencies order:7 depth 64").select("depth", "entity")


@query(f"WITH RECURSIVE {_KEYS}, {_WALK.format(start='region:1', frm='object', to='subject', depth=2)} SELECT subject, object FROM links WHERE object IN (SELECT entity FROM walk GROUP BY entity HAVING min(depth) < 2)")
def bql_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.support(views.key_facts(spark, sf_dir), "IMPACT region:1 DEPTH 2")
    return rows.select("subject", F.col("object.text").alias("object"))


_REACH = f"WITH RECURSIVE {_EDGES}, reached AS (SELECT DISTINCT src AS node FROM edges WHERE src LIKE 'Brand#1%' UNION SELECT e.dst FROM reached r JOIN edges e ON e.src = r.node)"


def _entry(edges: DataFrame) -> DataFrame:
    return edges.where("src LIKE 'Brand#1%'").select(F.col("src").alias("node"))


@query(f"{_REACH} SELECT node FROM reached")
def reachable_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.part_edges(spark, sf_dir)
    return graph.reachable(edges, _entry(edges))


@query(f"WITH RECURSIVE {_KEYS}, reached AS (SELECT subject AS node FROM links WHERE subject LIKE 'order:%' UNION SELECT l.object FROM reached r JOIN links l ON l.subject = r.node) SELECT node FROM (SELECT subject AS node FROM links UNION SELECT object FROM links) WHERE node NOT IN (SELECT node FROM reached)")
def dead_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no order leads to: customers without orders, and suppliers."""
    edges = store.edges(views.key_facts(spark, sf_dir), impact=False)
    return graph.dead(edges, edges.where("src LIKE 'order:%'").select(F.col("src").alias("node")))


@query()
def dependency_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of part files, found on their keys."""
    names = views.part_files(spark, sf_dir)
    has = lambda c: names.select(F.col("p_partkey").alias(c)).distinct()
    pairs = views.part_pairs(spark, sf_dir).join(has("a"), "a", "left_semi").join(has("b"), "b", "left_semi")
    return graph.cycles(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), names.withColumnsRenamed({"p_partkey": "key", "file": "node"}))


_HELD = "edges AS (SELECT 'n' || c_nationkey || '/c' || c_custkey AS src, 'n' || (o_orderkey % 25) || '/o' || o_orderkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"WITH {_HELD} SELECT dst AS file, {_DIR.format('dst')} AS current_dir, min({_DIR.format('src')}) AS suggested_dir, count(DISTINCT src) AS dependents FROM edges GROUP BY dst HAVING count(DISTINCT {_DIR.format('src')}) = 1 AND min({_DIR.format('src')}) != {_DIR.format('dst')}")
def misplaced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, each in one of 25 places, that belong with the nation of their customer."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    src = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string"))
    dst = F.concat(F.lit("n"), (F.col("o_orderkey") % 25).cast("string"), F.lit("/o"), F.col("o_orderkey").cast("string"))
    return graph.misplaced(o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(src.alias("src"), dst.alias("dst")))


@query(f"WITH {_EDGES}, w AS (SELECT src AS file, {_DIR.format('dst')} AS dir FROM edges UNION ALL SELECT dst, {_DIR.format('src')} FROM edges), c AS (SELECT file, dir, count(*) AS n FROM w GROUP BY file, dir) SELECT file, dir, n, CAST(row_number() OVER (PARTITION BY file ORDER BY n DESC, dir) AS INTEGER) AS rank FROM c")
def placement_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.placement(views.part_edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT dst AS node, count(*) AS n FROM edges GROUP BY dst ORDER BY n DESC, node LIMIT 8")
def fan_in_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fan_in(views.part_edges(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT src, dst FROM edges UNION SELECT dst, src FROM edges")
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph and the one of all its edges turned round."""
    edges = views.part_edges(spark, sf_dir)
    return graph.merge_graphs(edges, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query(f"WITH {_EDGES} SELECT count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(views.part_edges(spark, sf_dir))


@query("""WITH s AS (SELECT user_id, event_id, ts, lead(ts, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM events WHERE event_type = 'signup'),
h AS (SELECT e.user_id AS file, e.event_id AS ref, s.event_id AS owner, row_number() OVER (PARTITION BY e.event_id ORDER BY s.until - s.ts, s.event_id) AS k FROM events e JOIN s ON s.user_id = e.user_id AND e.ts BETWEEN s.ts AND s.until WHERE e.event_type = 'error' AND s.until IS NOT NULL)
SELECT file, ref, owner FROM h WHERE k = 1""")
def range_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, owners = views.ranges(spark, sf_dir)
    return graph.innermost(refs, owners, [(F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))).alias("span")], lambda place: F.unix_micros(place.cast("timestamp")))


# facts


@query("""SELECT CAST(row_number() OVER (ORDER BY subject, predicate, rank, object) - 1 AS BIGINT) AS ordinal, subject, predicate, object FROM (
  SELECT DISTINCT 'nation:' || n_nationkey AS subject, 'depends-on' AS predicate, 0 AS rank, 'region:' || n_regionkey AS object FROM nation
  UNION SELECT 'customer:' || c_custkey, 'depends-on', 0, 'nation:' || c_nationkey FROM customer
  UNION SELECT 'order:' || o_orderkey, 'depends-on', 0, 'customer:' || o_custkey FROM orders
  UNION SELECT 'supplier:' || s_suppkey, 'depends-on', 0, 'nation:' || s_nationkey FROM supplier
  UNION SELECT 'nation:' || n_nationkey, 'depends-on', 1, n_name FROM nation UNION SELECT 'region:' || r_regionkey, 'named', 1, r_name FROM region)""")
def snapshot_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = views.key_facts(spark, sf_dir)
    rows = store.ordinals(facts.union(facts))
    return rows.select("ordinal", F.from_json("payload", "subject string, predicate string, object struct<text:string>").alias("f")).select("ordinal", "f.subject", "f.predicate", F.col("f.object.text").alias("object"))


@query("SELECT predicate, kind, count(*) AS n FROM (SELECT 'depends-on' AS predicate, 'entity' AS kind FROM orders UNION ALL SELECT 'depends-on', 'entity' FROM customer UNION ALL SELECT 'depends-on', 'entity' FROM nation UNION ALL SELECT 'depends-on', 'entity' FROM supplier UNION ALL SELECT 'depends-on', 'text' FROM nation UNION ALL SELECT 'named', 'text' FROM region) GROUP BY predicate, kind")
def fact_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.key_facts(spark, sf_dir).groupBy("predicate", F.col("object.kind").alias("kind")).agg(F.count("*").alias("n"))


# findings


def _order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rule = F.when(F.col("o_totalprice") > 300000, "layer-cycle").when(F.col("o_orderstatus") == "F", "contract-forbidden").when(F.col("o_orderstatus") == "O", "growth").otherwise("unwired")
    severity = F.when(F.col("o_totalprice") > 300000, "error").when(F.col("o_orderpriority").startswith("1"), "warning").otherwise("note")
    file = F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string"), F.lit("/o"), F.col("o_orderkey").cast("string"))
    return o.select(rule.alias("rule"), severity.alias("severity"), F.col("o_orderpriority").alias("message"), file.alias("file"), F.col("o_custkey").cast("int").alias("line"), F.lit(None).cast("string").alias("fix"))


_FINDINGS = "f AS (SELECT CASE WHEN o_totalprice > 300000 THEN 'layer-cycle' WHEN o_orderstatus = 'F' THEN 'contract-forbidden' WHEN o_orderstatus = 'O' THEN 'growth' ELSE 'unwired' END AS rule, CASE WHEN o_totalprice > 300000 THEN 'error' WHEN o_orderpriority LIKE '1%' THEN 'warning' ELSE 'note' END AS severity, 'c' || (o_custkey % 50) || '/o' || o_orderkey AS file FROM orders)"


@query(f"WITH {_FINDINGS} SELECT severity, count(*) AS n FROM f GROUP BY severity")
def finding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.counts(_order_findings(spark, sf_dir))


@query(f"WITH {_FINDINGS} SELECT rule, severity, file FROM f WHERE NOT (rule = 'unwired' OR rule = 'contract' OR starts_with(rule, 'contract-') AND starts_with(file, 'c1') OR starts_with(file, 'c7/'))")
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = rules.partition_allowed(_order_findings(spark, sf_dir), ["unwired", "contract:c1/**", "*:c7/*"])
    return kept.select("rule", "severity", "file")


@query(f"WITH {_FINDINGS} SELECT rule, severity, file FROM f WHERE rule = 'unwired' OR starts_with(rule, 'contract-') AND starts_with(file, 'c1') OR starts_with(file, 'c7/')")
def allow_list_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, exempt = rules.partition_allowed(_order_findings(spark, sf_dir), ["unwired", "contract:c1/**", "*:c7/*"])
    return exempt.select("rule", "severity", "file")


@query(f"WITH {_FINDINGS} SELECT rule, severity, file FROM f WHERE rule IN ('layer-cycle', 'growth') OR file IN (SELECT 'c' || (o_custkey % 50) || '/o' || o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')")
def diff_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp '1997-01-01'")
    changed = changed.select(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string"), F.lit("/o"), F.col("o_orderkey").cast("string")).alias("file"))
    return rules.scoped(_order_findings(spark, sf_dir), changed).select("rule", "severity", "file")


_LINES = "l AS (SELECT rel AS path, line, k AS line_no FROM (SELECT rel, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM (SELECT source || '/doc_' || doc_id || '.txt' AS rel, text FROM documents)))"


def _forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    contracts = spark.createDataFrame([("words", "src1", "worthless"), ("words", "src1", "pathetic"), ("rights", "src", "icense")], "contract string, path string, pattern string")
    return rules.forbidden(views.lines(spark, sf_dir), contracts)


_HITS = f"{_LINES}, p AS (SELECT * FROM (VALUES ('words', 'src1', 'worthless'), ('words', 'src1', 'pathetic'), ('rights', 'src', 'icense')) v(contract, prefix, pattern)), h AS (SELECT contract, pattern, path AS file, CAST(min(line_no) AS INTEGER) AS line FROM l JOIN p ON starts_with(path, prefix) AND contains(line, pattern) GROUP BY contract, pattern, path)"


@query(f"WITH {_HITS} SELECT 'forbidden by ' || contract || ' : ' || pattern AS message, file, line FROM h")
def forbid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forbidden(spark, sf_dir).select("message", "file", "line")


@query(f"WITH {_HITS} SELECT 'forbidden by ' || contract || ' : ' || pattern AS message, file, line FROM h WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.path = h.file AND contains(l.line, 'the of') AND l.line_no IN (h.line, h.line - 1))")
def inline_waivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = rules.waived(_forbidden(spark, sf_dir), views.lines(spark, sf_dir), "the of")
    return kept.select("message", "file", "line")


# reports


_LEAN = f"""{_FILES}, {_GROUPS}, d AS (SELECT count(*) AS "groups", sum(n - 1) AS dup_files, sum((n - 1) * loc) AS wasted_loc FROM g),
m AS (SELECT count(*) AS mirrors FROM (SELECT hash FROM files WHERE hash IS NOT NULL GROUP BY hash HAVING count(DISTINCT lang) > 1)),
t AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS files, 1 + (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS composites,
  (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) + (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)) AS empty),
r AS (SELECT t.*, d.*, m.*, 1 - (0.7 * CAST(dup_files AS DOUBLE) / files + 0.3 * CAST(empty AS DOUBLE) / composites) AS score FROM t, d, m)"""


def _lean(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = trees.subtree(views.tree(spark, sf_dir)).select("kind", "files", F.col("parent").isNull().alias("is_root"))
    return dups.lean_metrics(nodes, dups.file_facts(views.files(spark, sf_dir, "lang")))


@query(f'WITH {_LEAN} SELECT files, composites, empty, "groups", CAST(dup_files AS BIGINT) AS dup_files, CAST(wasted_loc AS BIGINT) AS wasted_loc, mirrors, round(score, 6) AS score, CAST(NULL AS BIGINT) AS dead, CAST(NULL AS BIGINT) AS misplaced FROM r')
def lean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lean(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f"WITH {_LEAN} SELECT 'dup_files' AS metric, CAST(2 AS DOUBLE) AS was, CAST(dup_files AS DOUBLE) AS now FROM r WHERE dup_files > 2 UNION ALL SELECT 'score', CAST(1 AS DOUBLE), round(score, 6) FROM r WHERE score < 1 - 1e-9")
def ratchet_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = {"score": 1.0, "dup_files": 2, "empty": 1_000_000_000, "dead": 0, "misplaced": None}
    return dups.regressions(_lean(spark, sf_dir), base).withColumn("now", F.round("now", 6))
