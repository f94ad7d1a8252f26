"""Small inputs with known answers for each family of operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions import extract
from strandweave.functions import text as tx
from strandweave.operators import blueprint, dups, graph, moves, rules
from strandweave.operators import tree as trees
from strandweave.plans import facts as store
from strandweave.plans import gate, report
from strandweave.sources import repo
from strandweave.streaming import incremental


BLUEPRINT = {
    "meta": [("bp", "Pipeline", "draft", None)],
    "slot": [("bp", "ingest", "reads", ["ordered"], False), ("bp", "process", "works", [], True), ("bp", "bad id", "x", [], False)],
    "port": [("bp", "out", "ingest", "output", "rows", True), ("bp", "in", "process", "input", "rows", True), ("bp", "back", "process", "output", "rows", False), ("bp", "again", "ingest", "input", "rows", False), ("bp", "stray", "nowhere", "input", "rows", False)],
    "flow": [("bp", "f1", "out", "in", False), ("bp", "f2", "back", "again", False), ("bp", "f3", "in", "missing", True)],
    "implementation": [("bp", "one", ["ingest", "process"], "a.rs#one"), ("bp", "two", ["gone"], "")],
    "adapter": [("bp", "ad", "out", "in", "a.rs#ad", "w9")],
    "witness": [("bp", "w1", "unit", ["ingest", "moon"], "true")],
}


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_search_order_and_depth(spark):
    e = edges(spark, ("a", "c"), ("a", "b"), ("b", "e"), ("c", "d"), ("d", "a"))
    start = spark.createDataFrame([("a",)], "node string")
    out = graph.bfs(e, start, 2, ordered=True).orderBy("depth", "ord").collect()
    assert [(r.node, r.depth) for r in out] == [("b", 1), ("c", 1), ("e", 2), ("d", 2)]
    assert {r.node for r in graph.reachable(e, start).collect()} == set("abcde")
    assert graph.bfs(e, spark.createDataFrame([("zz",)], "node string"), 3).count() == 0


def test_cycles_against_plain_search(spark):
    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(40)} | {("x", "x")}
    to = {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)

    def seen(a):
        out, todo = set(), [a]
        while todo:
            for b in to.get(todo.pop(), ()):
                if b not in out:
                    out.add(b)
                    todo.append(b)
        return out

    reach = {a: seen(a) for a in {x for p in pairs for x in p}}
    want = {a: min(b for b in reach if b == a or b in reach[a] and a in reach[b]) for a in reach if any(b != a and a in reach[b] for b in reach[a])}
    assert {r.node: r.component for r in graph.cycles(edges(spark, *pairs)).collect()} == want


def test_misplacement_and_placement(spark):
    e = [("feature/a.rs", "util/helper.rs"), ("feature/b.rs", "util/helper.rs")]
    row = graph.misplaced(edges(spark, *e)).first()
    assert (row.file, row.current_dir, row.suggested_dir, row.dependents) == ("util/helper.rs", "util", "feature", 2)
    assert graph.misplaced(edges(spark, *e, ("util/other.rs", "util/helper.rs"))).count() == 0
    best = graph.placement(edges(spark, *e, ("util/helper.rs", "core/x.rs"))).where("file = 'util/helper.rs' AND rank = 1").first()
    assert (best.dir, best.n) == ("feature", 2)


def test_code_graph_attributes_to_the_innermost(spark):
    occ = [
        ("a.rs", 0, "foo", 1, [0, 3, 6], [0, 0, 5, 0]),
        ("b.rs", 0, "bar", 1, [0, 3, 6], [0, 0, 9, 0]),
        ("b.rs", 1, "foo", 0, [2, 8, 11], None),
        ("b.rs", 2, "mod", 0, [3, 0, 3], None),
        ("b.rs", 3, "bar", 0, [4, 0, 3], None),
        ("b.rs", 4, "local 1", 1, [5, 0, 3], None),
        ("m.rs", 0, "mod", 1, [0, 0, 3], None),
    ]
    rows = spark.createDataFrame(occ, "file string, ord int, symbol string, roles int, range array<int>, enclosing array<int>")
    info = spark.createDataFrame([("m.rs", "mod", "mod", 29, False)], "file string, symbol string, display string, kind int, is_impl boolean")
    g = graph.code_graph(rows, info)
    assert {(r.src, r.dst) for r in g["refs"].collect()} == {("bar", "foo"), ("bar", "mod")}
    assert {(r.src, r.dst) for r in g["file_deps"].collect()} == {("b.rs", "a.rs")}
    assert {r.symbol for r in g["symbols"].collect()} == {"foo", "bar", "mod"}


def test_dead_symbols(spark):
    text = [("a.rs", "fn gone() {}\npub fn kept() {}\nfn called() {}\nimpl Show for X {\n    fn show() {}\n}\n#[cfg(test)]\nfn late() {}\n")]
    sym = [(n, n, 12, "a.rs", (k,), False) for n, k in (("gone", 0), ("kept", 1), ("called", 2), ("show", 4), ("late", 7))]
    symbols = spark.createDataFrame(sym, "symbol string, display string, kind int, file string, def struct<sl:int>, is_impl boolean")
    out = rules.dead_symbols(symbols, edges(spark, ("kept", "called")), tx.lines_table(spark.createDataFrame(text, "path string, text string")))
    assert [(r.symbol, r.line) for r in out.collect()] == [("gone", 1)]


def test_tree_folds_and_layers(spark):
    rows = [("root", None, "composite", None, "low"), ("a", "root", "composite", None, "high"), ("a1", "a", "atom", 10, None), ("a2", "a", "atom", 5, "unknown"), ("b", "root", "composite", None, None)]
    nodes = spark.createDataFrame(rows, "id string, parent string, kind string, loc long, layer string")
    got = {r.id: (r.files, r.loc, r.depth) for r in trees.subtree(nodes.drop("layer")).collect()}
    assert got == {"root": (2, 15, 3), "a": (2, 15, 2), "a1": (1, 10, 1), "a2": (1, 5, 1), "b": (0, 0, 1)}
    layers = spark.createDataFrame([("low", 0), ("high", 1)], "layer string, idx int")
    assert {r.id: r.layer for r in trees.layer_of(nodes, layers).collect()} == {"root": "low", "a": "high", "a1": "high", "a2": "high", "b": "low"}
    paths = spark.createDataFrame([("x/y/z.rs",), ("xy/z.rs",), ("top.rs",)], "path string")
    homes = spark.createDataFrame([("x",), ("x/y",)], "home string")
    assert {r.path: r.home for r in trees.nearest_ancestor(paths, homes).collect()} == {"x/y/z.rs": "x/y", "xy/z.rs": "", "top.rs": ""}


def test_near_duplicates_at_the_usual_threshold(spark):
    shared = "\n".join(f"a line of text number {i}" for i in range(20))
    rows = [("a", "", shared + "\none more line"), ("b", "", shared + "\nand another one"), ("c", "s", shared + "\nelsewhere it is"), ("d", "", shared + "\none more line")]
    pairs = dups.near_dup_pairs(spark.createDataFrame(rows, "rel string, subrepo string, text string"), 0.85).collect()
    assert {(r.a, r.b) for r in pairs} == {("a", "b"), ("b", "d")} and all(0.9 < r.similarity < 1 for r in pairs)


def test_lines_and_names(spark):
    rows = spark.createDataFrame([("a\r\nb\n",), ("",), ("x",), ("\n\n",)], "t string")
    got = [(r.l, r.n) for r in rows.select(tx.split_lines(F.col("t")).alias("l"), tx.line_count(F.col("t")).alias("n")).collect()]
    assert got == [(["a", "b"], 2), ([], 0), (["x"], 1), (["", ""], 2)]
    row = spark.range(1).select(tx.snake(F.lit("MyName here")).alias("s"), tx.pascal(F.lit("my-name here")).alias("p"), tx.normalize_line(F.lit('a  "x // y"')).alias("n"), tx.normalize_line(F.lit("b  // z")).alias("c")).first()
    assert tuple(row) == ("my_name_here", "MyNameHere", 'a "x // y"', "b")
    globs = spark.createDataFrame([("dirx", "dir/**", True), ("a/b", "a*", True), ("a/b", "*b", True), ("a/b", "b", False), ("q", "**", True)], "v string, g string, want boolean")
    assert globs.where(tx.glob_holds(F.col("v"), F.col("g")) != F.col("want")).count() == 0


def test_clones(spark):
    body = "".join(f"    step_{i}();  // say {i}\n" for i in range(6))
    rows = [("a.rs", f"fn one() {{\n{body}}}\n"), ("b.rs", f"pub fn two() {{\n{body}}}\n#[cfg(test)]\nfn three() {{\n{body}}}\n"), ("c.py", "def f():\n" + "    x = 1\n" * 6 + "def test_f():\n" + "    x = 1\n" * 6 + "def g(a,\n      b):\n" + "    x = 1  # y\n" * 6)]
    bodies = extract.bodies(spark.createDataFrame(rows, "path string, text string"))
    out = dups.clone_groups(bodies).collect()
    assert sorted((r.first.file, r.first.name, r.sites) for r in out) == [("a.rs", "one", 2), ("c.py", "f", 2)]
    assert sorted((r.file, r.name, r.sites) for r in dups.clone_sites(bodies).collect()) == [("a.rs", "one", 2), ("b.rs", "two", 2), ("c.py", "f", 2), ("c.py", "g", 2)]
    assert list(extract.brace_functions('fn a() {\n  let s = "}";\n  b();\n}\n'))[0][2] == 'let s = "}";\nb();'


FACTS = [("api", "service"), ("service", "database"), ("api", "service")]


def facts_of(spark, rows):
    return store.fact(spark.createDataFrame(rows, "a string, b string"), F.col("a"), "depends-on", F.col("b"))


def test_fact_store(spark, tmp_path):
    own = store.ParquetFactStore(spark, str(tmp_path))
    first = own.create_snapshot(None, facts_of(spark, FACTS))
    assert own.facts(first).count() == 2 and own.create_snapshot(None, facts_of(spark, FACTS[::-1])) == first
    second = own.create_snapshot(first, facts_of(spark, [*FACTS, ("web", "api")]))
    assert second != first and own.snapshots().count() == 2
    own.set_ref("main", first)
    own.set_ref("main", second)
    assert own.resolve("main") == second and own.resolve(first) == first
    assert {(r.entity, r.depth) for r in own.query("main", "impact database depth 2").collect()} == {("service", 1), ("api", 2)}
    answer = store.graphql(own, '{ dependencies(entity: "web", depth: 3) { entities factCount } }')
    assert answer == {"data": {"dependencies": {"entities": ["api", "service", "database"], "factCount": 3}}}
    assert "errors" in store.graphql(own, '{ impact(entity: "web", depth: 99) { entities } }') and "errors" in store.graphql(own, "{ all }")
    for wrong in ("no-such", "b d"):
        with pytest.raises((KeyError, ValueError)):
            own.set_ref(wrong, "sha256:0") if " " in wrong else own.resolve(wrong)


@pytest.mark.parametrize("text", ["IMPACT x", "IMPACT x DEPTH 0", "IMPACT x DEPTH 65", "WALK x DEPTH 1", "IMPACT x y DEPTH 1"])
def test_queries_that_are_refused(text):
    with pytest.raises(ValueError):
        store.parse(text)


def test_gate_and_reports(spark):
    f = [("contract-seal", "warning", "m", "a.rs", 3, None), ("contract-seal", "warning", "m", "a.rs", 9, "do it"), ("growth", "error", "g", None, None, None), ("unwired", "note", "u", "legacy/x.rs", None, None)]
    found = spark.createDataFrame(f, "rule string, severity string, message string, file string, line int, fix string")
    lines = spark.createDataFrame([("a.rs", 2, "// lint:allow(contract)"), ("a.rs", 9, "x // lint:allow(other, growth)")], "path string, line_no int, line string")
    changed = spark.createDataFrame([("b.rs",)], "file string")
    out = gate.check(found, lines, gate.Options(allow=["unwired:legacy/**"]))
    assert (out["kept"].count(), out["exempt"].count(), out["waived"].count()) == (2, 1, 1)
    assert [r.rule for r in gate.check(found, lines, gate.Options(), changed=changed)["kept"].collect()] == ["growth"]
    assert {r.severity: r.n for r in rules.counts(found).collect()} == {"warning": 2, "error": 1, "note": 1} and report.has_errors(found)
    doc = json.loads(report.sarif(found))
    assert len(doc["runs"][0]["results"]) == 4 and any("Fix: do it" in r["message"]["text"] for r in doc["runs"][0]["results"])
    assert '"file":"a.rs"' in report.to_json(found).where("json LIKE '%seal%'").first().json
    assert report.rendered(found).where("line LIKE '%a.rs:9 — m (fix: do it)'").count() == 1


def test_lean_gate_over_files(spark):
    text = "\n".join(f"line number {i} of the text" for i in range(20))
    files = spark.createDataFrame([("a.rs", "", text), ("b.rs", "", text), ("c.rs", "", text + "\nmore of it")], "path string, subrepo string, text string")
    facts = dups.file_facts(files.select(F.col("path").alias("rel"), "subrepo", F.col("text").cast("binary").alias("content")))
    got = gate.lean_findings(facts, files, edges(spark, ("x/a", "y/b"))).groupBy("rule").count().collect()
    assert {r.rule: r["count"] for r in got} == {"lean-duplicate": 1, "lean-near-duplicate": 2, "lean-misplaced": 1}


def test_blueprints(spark):
    good = {
        "meta": [("p", "Pipe", "locked", None)],
        "slot": [("p", "in", "reads", [], False), ("p", "out", "writes", [], False)],
        "port": [("p", "a", "in", "output", "rows", True), ("p", "b", "out", "input", "rows", True)],
        "flow": [("p", "f", "a", "b", False)],
        "implementation": [("p", "i", ["in"], "x.rs#i")],
        "witness": [("p", "w", "unit", ["a", "b"], "true")],
    }
    t = blueprint.tables(spark, good)
    assert blueprint.validate(t).count() == 0
    text = blueprint.lock(t, {"w"})
    assert blueprint.check_lock(t, text) == []
    with pytest.raises(ValueError):
        blueprint.lock(t, set())
    rebound = blueprint.tables(spark, {**good, "implementation": [("p", "i", ["in"], "y.rs#i")]})
    reshaped = blueprint.tables(spark, {**good, "flow": [("p", "f", "a", "b", True)]})
    assert [blueprint.shape_change(t, x) for x in (t, rebound, reshaped)] == ["none", "implementation-only", "new-shape"]
    assert blueprint.check_lock(reshaped, text) == ["digest"]
    nextone = blueprint.tables(spark, {k: [("q", *r[1:]) for r in v] for k, v in good.items()} | {"meta": [("q", "Pipe", "draft", "p")]})
    assert blueprint.evolution(t, nextone).count() == 0
    for language, name in (("rust", "in.rs"), ("python", "in.py"), ("c", "in.h"), ("typescript", "in.ts")):
        made = dict(blueprint.scaffold(t, language))
        assert len(made) == 2 and "rows" in made[name]
    compile(dict(blueprint.scaffold(t, "python"))["in.py"], "in.py", "exec")
    doc = blueprint.from_toml(spark, 'id = "p"\ntitle = "Pipe"\n[[slot]]\nid = "in"\npurpose = "reads"\n[[flow]]\nid = "f"\nfrom = "a"\nto = "b"\n')
    assert doc["slot"].first().id == "in" and doc["flow"].first().stateful is False
    assert blueprint.validate(blueprint.tables(spark, BLUEPRINT)).count() > 5


def test_moves(spark):
    rows = [("src/lib.rs", "mod a;\r\nmod util;\r\n"), ("src/a.rs", "pub mod b;\nuse super::x;\n"), ("src/a/b.rs", "use self::q;\n"), ("src/util.rs", "mod last;\nuse crate::a::b::f; use crate::a::bc;\n")]
    files = spark.createDataFrame(rows, "path string, text string")
    plan, warnings = moves.plan_move(files, "src/a/b.rs", "src/util/b.rs")
    assert warnings == ["src/a/b.rs:1 has a relative path"]
    done = {r.path: (r.text, r.error) for r in moves.apply_edits(files, plan).collect()}
    assert done == {"src/a.rs": ("use super::x;\n", None), "src/util.rs": ("mod last;\npub mod b;\nuse crate::util::b::f; use crate::a::bc;\n", None)}
    stale = spark.createDataFrame([("src/lib.rs", 1, "mod z;", "mod y;", "replace", "")], moves.EDITS)
    assert moves.apply_edits(files, stale).first().error is not None
    crlf = spark.createDataFrame([("src/lib.rs", 1, "mod a;", "mod c;", "replace", ""), ("src/lib.rs", 2, None, "mod d;", "insert", "")], moves.EDITS)
    assert moves.apply_edits(files, crlf).first().text == "mod c;\r\nmod util;\r\nmod d;\r\n"
    assert "no parent module" in moves.plan_move(files, "src/a/b.rs", "src/none/b.rs")[1][0]
    assert moves.plan_move(files, "src/lib.rs", "src/x.rs")[1] and moves.plan_move(files, "a.txt", "b.txt")[0].count() == 0
    assert next(moves.render_diff(plan, "src/a/b.rs", "src/util/b.rs")) == "rename src/a/b.rs => src/util/b.rs"


def _message(*fields):
    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += bytes([number << 3, value])
        else:
            out += bytes([number << 3 | 2, len(value)]) + value
    return out


def test_repository_sources(spark, tmp_path):
    for path, text in {"src/a.rs": "x\n", "src/b.py": "y\n", "src/c.py": "z", "docs/r.md": "# t\n", "sub/.git": "gitdir", "sub/f.rs": "q", "target/o.rs": "no", "skip.log": "l", ".hidden": "h", "big.txt": "b" * 100}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / path).write_text(text)
    (tmp_path / ".gitignore").write_text("*.log\n")
    assert [p for p, d in repo.walk(str(tmp_path)) if not d] == ["big.txt", "docs/r.md", "src/a.rs", "src/b.py", "src/c.py", "sub/f.rs"]
    assert repo.subrepo_roots(str(tmp_path)) == ["sub"]
    files = repo.contents(spark, str(tmp_path), max_bytes=50)
    assert {r.rel: r.content is None for r in files.where("rel LIKE '%.txt' OR rel LIKE 's%b.py'").collect()} == {"big.txt": True, "src/b.py": False}
    assert repo.texts(files).where("path = 'src/c.py'").first().text == "z"
    nodes = {r.id: r for r in repo.derived_tree(files.where("rel LIKE 'src%' OR rel LIKE 'docs%'").select("rel")).collect()}
    assert nodes["src"].language == "python" and nodes["docs"].plane == "docs" and nodes["src/a.rs"].parent == "src" and nodes["."].parent is None
    authored = spark.createDataFrame([("src", "mine")], "id string, parent string")
    both = repo.overlay(authored, repo.derived_tree(files.select("rel")).select("id", "parent"))
    assert both.where("id = 'src'").first().parent == "mine"
    occurrence = _message((1, bytes([0, 3, 6])), (2, b"foo"), (3, 1), (7, bytes([0, 0, 5, 0])))
    symbol = _message((1, b"foo"), (4, _message((1, b"t"), (2, 1))), (5, 12), (6, b"Foo"))
    (tmp_path / "index.scip").write_bytes(_message((2, _message((1, b"a.rs"), (2, occurrence), (3, symbol)))))
    occ, sym = repo.read_index(spark, str(tmp_path / "index.scip"))
    assert tuple(occ.first())[1:] == ("a.rs", 0, "foo", 1, [0, 3, 6], [0, 0, 5, 0]) and tuple(sym.first())[1:] == ("a.rs", "foo", "Foo", 12, True)
    assert graph.code_graph(occ.drop("index"), sym.drop("index"))["symbols"].first().display == "Foo"
    repo.require_fresh(files.where("rel = 'src/a.rs'"), files.where("rel = 'src/a.rs'"))
    with pytest.raises(RuntimeError):
        repo.require_fresh(files, files.limit(0))
    assert repo.config('allow = ["x"]')["root"] == "."


def test_incremental_scan(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.txt").write_text(name)
    def files():
        return repo.contents(spark, str(tmp_path)).select("rel", F.lit("").alias("subrepo"), "size", "modified", "content")
    cache = str(tmp_path.parent / "facts-cache")
    facts, counts = incremental.refresh(files(), incremental.load_cache(spark, cache))
    assert counts.first().cache_hits == 0
    incremental.save_cache(facts, cache)
    (tmp_path / "b.txt").write_text("changed")
    facts, counts = incremental.refresh(files(), incremental.load_cache(spark, cache))
    assert tuple(counts.first()) == (3, 2) and facts.where("hash IS NULL").count() == 0
    out, marks = str(tmp_path.parent / "stream-out"), str(tmp_path.parent / "stream-marks")
    incremental.watch(spark, str(tmp_path), out, marks).awaitTermination()
    incremental.watch(spark, str(tmp_path), out, marks).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_the_rest_stands_without_the_training_data_subpackage():
    import ast
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "strandweave"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("strandweave.llm") for n in names), path
