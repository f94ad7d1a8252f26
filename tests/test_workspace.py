"""A repository as a whole: ignore rules, configuration, the check's stages, snapshots, documents, writing back."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from strandweave import cli
from strandweave.functions import text as tx
from strandweave.operators import blueprint, rules
from strandweave.operators import tree as trees
from strandweave.plans import facts, gate, workspace
from strandweave.sources import repo
from strandweave.streaming import incremental
from tests.test_scenarios import BLUEPRINT

DOCUMENT = """
id = "p"
title = "Pipe"
lifecycle = "locked"
[[slot]]
id = "a"
[[slot]]
id = "b"
[[port]]
id = "out"
slot = "a"
direction = "output"
type = "rows"
permanent = true
[[port]]
id = "in"
slot = "b"
direction = "input"
type = "rows"
[[flow]]
id = "f"
from = "out"
to = "in"
[[witness]]
id = "w"
kind = "unit"
covers = ["out"]
command = "true"
"""


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_DOT_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_ignore_rules(tmp_path):
    names = ["a.log", "keep.log", "sub/a.log", "sub/deep/x.tmp", "sub/only/y", "docs/a/b/z.md", "docs/z.md", "other/q1.c", "other/q12.c", "priv/s", "out/o", "t/[x].c", "up.bak"]
    root = tmp_path / "root"
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text("x")
    (root / ".gitignore").write_text("*.log\n!keep.log\n/sub/*/x.tmp\nonly/\ndocs/**/z.md\nq?.c\n# no\n\\[x\\].c\n")
    (root / ".git" / "info").mkdir(parents=True)
    (root / ".git" / "info" / "exclude").write_text("priv\n")
    (tmp_path / ".gitignore").write_text("*.bak\n")
    left = [p for p, is_dir in repo.walk(str(root), ("out",)) if not is_dir]
    assert left == ["keep.log", "other/q12.c"]
    git = subprocess.run(["git", "init", "-q", str(tmp_path)], capture_output=True)
    assert git.returncode == 0 and [p for p, d in repo.walk(str(root), ("out",)) if not d] == left


def test_scan_leaves_ignored_files_out(spark, tmp_path):
    write(tmp_path, a_DOT_rs="x", b_DOT_rs="y", _DOT_gitignore="b.rs\n")
    assert [r.rel for r in repo.contents(spark, str(tmp_path)).collect()] == ["a.rs"]


def test_scan_configuration_and_cache(spark, tmp_path):
    write(tmp_path, a_DOT_txt="one long line\n", b_DOT_txt="two", gen__c_DOT_txt="three")
    config = incremental.ScanConfig.gate().skipping("gen").with_shingles().with_cache().max_bytes(8)
    for hits in (0, 2):
        facts, counts = incremental.scan(spark, str(tmp_path), config)
        assert counts.first() == (2, hits)
    assert {(r.rel, r.hash is None, tuple(r.shingles or ())) for r in facts.collect()} == {("a.txt", True, ()), ("b.txt", False, ())}
    (tmp_path / "b.txt").write_text("changed")
    assert incremental.scan(spark, str(tmp_path), config)[1].first() == (2, 1)


def test_toml_round_trips(spark):
    doc = {"root": ".", "version": 1, "skip": ["a", 'q"u'], "on": True, "rules": {"most_depth": 3, "odd key": "x"}, "contracts": [{"id": "c", "forbid": ["p.q"]}, {"id": "d", "forbid": []}], "empty": []}
    assert repo.config(repo.to_toml(doc)) == repo.config("") | doc
    t = blueprint.tables(spark, BLUEPRINT)
    back = blueprint.from_toml(spark, blueprint.to_toml(t))
    assert {k: sorted(map(repr, v)) for k, v in blueprint.to_rows(back).items()} == {k: sorted(map(repr, v)) for k, v in blueprint.to_rows(t).items()}


def test_check_runs_every_stage(spark, tmp_path, capsys):
    root = str(tmp_path)
    config = """
allow = ["unwired"]
layers = ["low", "high"]
skip = ["gen"]
[layer_dirs]
src = "low"
[rules]
most_children = 2
most_depth = 2
forbid_cycles = true
layering = true
placement = true
[[contracts]]
id = "c"
path = "src"
trait = "Codec"
forbid = ["unwrap()"]
seal = true
[[nodes]]
id = "ghost"
parent = "nowhere"
"""
    write(tmp_path, strandweave_DOT_toml=config, src__lib_DOT_rs="pub struct A;\nlet x = y.unwrap();\nlet z = y.unwrap(); // lint:allow\n", src__b_DOT_rs="fn f() {}\n", src__c_DOT_rs="fn f() {}\n", gen__bad_DOT_rs="unwrap()\n", _DOT_strandweave__blueprints__p_DOT_toml=DOCUMENT)
    w = workspace.Workspace(spark, root)
    w.__dict__["graph"] = {"file_deps": spark.createDataFrame([("src/b.rs", "src/c.rs"), ("src/c.rs", "src/b.rs")], "src string, dst string")}
    w.__dict__["edges"] = w.graph["file_deps"]
    out = gate.check_workspace(w)
    found = {r.rule for r in out["kept"].collect()}
    assert {"growth", "abstraction-depth", "layer-cycle", "contract-forbidden", "contract-anchor", "contract-seal", "blueprint-lock", "tree-invariant", "undocumented", "lean-duplicate"} <= found
    assert "unwired" not in found and {r.rule for r in out["exempt"].collect()} == {"unwired"}
    assert not any("gen/" in (r.file or "") for r in out["kept"].collect())
    only = gate.check_workspace(w, ["src/lib.rs"])["kept"].collect()
    assert {r.file for r in only if r.rule not in rules.GLOBAL_RULES} == {"src/lib.rs"}
    assert cli.main(["check", root]) == 1 and "contract-forbidden" in capsys.readouterr().out
    with pytest.raises(ValueError):
        gate.Options.of(repo.config("[rules]\nunheard = 1\n"))


def test_layering_and_ratchet(spark, tmp_path):
    nodes = spark.createDataFrame([(".", None, "composite", None, None), ("a", ".", "composite", None, "low"), ("b", ".", "composite", None, "high"), ("a/x", "a", "atom", 1, None), ("b/y", "b", "atom", 1, None)], "id string, parent string, kind string, loc long, layer string")
    edges = spark.createDataFrame([("a/x", "b/y"), ("b/y", "a/x")], "src string, dst string")
    out = gate.structure_findings(nodes, edges, gate.Options(layering=True, layers=["low", "high"])).collect()
    assert [(r.rule, r.file, r.message) for r in out] == [("layer-order", "a/x", "low uses high in b/y")]
    write(tmp_path, one_DOT_txt="same text", two_DOT_txt="other")
    root = str(tmp_path)
    assert cli.main(["lean", root, "--save"]) == 0
    assert json.load(open(tmp_path / ".strandweave" / "lean.json"))["dup_files"] == 0 and cli.main(["check", root]) == 0
    (tmp_path / "two.txt").write_text("same text")
    w = workspace.Workspace(spark, root)
    assert "lean-regression" in {r.rule for r in gate.check_workspace(w)["kept"].collect()} and cli.main(["check", root]) == 1
    assert w.lean().first().dead is None


def test_snapshots_of_documents(spark, tmp_path, capsys):
    root = str(tmp_path)
    with pytest.raises(ValueError):
        workspace.snapshot(workspace.Workspace(spark, root), facts.ParquetFactStore(spark, f"{tmp_path}/none"))
    write(tmp_path, _DOT_strandweave__blueprints__p_DOT_toml=DOCUMENT)
    assert cli.main(["graph", root, "snapshot"]) == 0
    own = capsys.readouterr().out.strip()
    assert own.startswith("sha256:") and cli.main(["graph", root, "snapshot"]) == 0 and capsys.readouterr().out.strip() == own
    assert cli.main(["graph", root, "query", "main", "IMPACT", "p#slot/a", "DEPTH", "2"]) == 0 and capsys.readouterr().out.split() == ["1", "p#slot/b"]
    assert cli.main(["graph", root, "graphql", '{ impact(entity: "p#slot/a", depth: 1) { entities factCount } }']) == 0
    assert json.loads(capsys.readouterr().out)["data"]["impact"] == {"entities": ["p#slot/b"], "factCount": 1}
    assert cli.main(["graph", root, "export", "main", f"{tmp_path}/out"]) == 0
    rows = spark.read.json(f"{tmp_path}/out").collect()
    assert {r.source.adapter for r in rows} == {"blueprint"} and {r.source.locator for r in rows} == {".strandweave/blueprints/p.toml"} and all(r.source.digest.startswith("sha256:") for r in rows)
    assert cli.main(["graph", root, "blueprint", ".strandweave/blueprints/p.toml"]) == 0 and "p#port/in member-of p#slot/b" in capsys.readouterr().out
    (tmp_path / "index.scip").write_bytes(b"")
    os.utime(tmp_path / "index.scip", (1, 1))
    write(tmp_path, a_DOT_rs="fn f() {}\n")
    with pytest.raises(RuntimeError):
        workspace.snapshot(workspace.Workspace(spark, root), facts.ParquetFactStore(spark, f"{tmp_path}/none"))


def test_blueprint_commands(spark, tmp_path, capsys):
    root, file = str(tmp_path), ".strandweave/blueprints/p.toml"
    write(tmp_path, _DOT_strandweave__blueprints__p_DOT_toml=DOCUMENT)
    assert cli.main(["blueprint", root, "validate", file]) == 0
    assert cli.main(["blueprint", root, "check"]) == 1 and "no lock" in capsys.readouterr().out
    with pytest.raises(PermissionError):
        cli.main(["blueprint", root, "verify", file])
    assert cli.main(["blueprint", root, "lock", file, "--allow-commands"]) == 0
    assert cli.main(["blueprint", root, "check"]) == 0
    (tmp_path / "q.toml").write_text(DOCUMENT.replace('id = "p"', 'id = "q"\nsupersedes = "p"').replace('type = "rows"', 'type = "bytes"'))
    capsys.readouterr()
    assert cli.main(["blueprint", root, "diff", file, "q.toml", "--evolution"]) == 1
    assert capsys.readouterr().out.splitlines() == ["new-shape", "permanent port has changed: out"]
    assert cli.main(["blueprint", root, "scaffold", file, "python", "gen"]) == 0 and "class A" in (tmp_path / "gen" / "a.py").read_text()
    assert cli.main(["blueprint", root, "scaffold", file, "python", "gen"]) == 1


def test_nothing_is_written_by_halves(tmp_path):
    root = str(tmp_path)
    write(tmp_path, a="one", b="two")
    with pytest.raises(RuntimeError):
        workspace.write_files(root, {"a": "new"}, {"a": "another"})
    with pytest.raises(RuntimeError):
        workspace.write_files(root, {"a": "new"}, moves=[("a", "b")])
    (tmp_path / "dir" / "inner").mkdir(parents=True)
    with pytest.raises(OSError):
        workspace.write_files(root, {"a": "new", "c": "made", "dir": "is a folder"})
    assert (tmp_path / "a").read_text() == "one" and not (tmp_path / "c").exists() and not list(tmp_path.glob("*.new"))
    workspace.write_files(root, {"a": "new"}, {"a": "one"}, [("b", "x/y")])
    assert (tmp_path / "a").read_text() == "new" and (tmp_path / "x" / "y").read_text() == "two"


def test_init_docs_and_changes(tmp_path, capsys):
    root = str(tmp_path)
    (tmp_path / "src").mkdir()
    assert cli.main(["init", root]) == 0 and cli.main(["init", root]) == 1
    assert repo.config((tmp_path / "strandweave.toml").read_text())["nodes"] == [{"id": "src", "parent": "."}]
    assert cli.main(["docs", root]) == 2
    with open(tmp_path / "strandweave.toml", "a") as f:
        f.write('\n[docs]\ncommand = "echo made > docs.txt"\n')
    assert cli.main(["docs", root]) == 0 and (tmp_path / "docs.txt").read_text() == "made\n"
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "strandweave.toml")
    git("commit", "-qm", "one")
    git("add", "docs.txt")
    (tmp_path / "new.txt").write_text("x")
    assert repo.changed_files(root, staged=True) == ["docs.txt"] and repo.changed_files(root) == ["docs.txt", "new.txt"]


def test_any_fold_and_the_whole_tree_check(spark):
    nodes = spark.createDataFrame([("r", None, "composite", None), ("a", "r", "composite", None), ("a/x", "a", "atom", 3), ("a/y", "a", "atom", 4), ("lost", "gone", "atom", 1), ("u", "v", "composite", None), ("v", "u", "composite", None)], "id string, parent string, kind string, loc long")
    say = {r.id: r.value for r in trees.fold(nodes, lambda n, kids: f"{n['id']}({','.join(kids)})", "string").collect()}
    assert say == {"r": "r(a(a/x(),a/y()))", "a": "a(a/x(),a/y())", "a/x": "a/x()", "a/y": "a/y()"}
    children = spark.createDataFrame([("r", "a"), ("a", "a/x"), ("a", "a/y"), ("r", "a/y"), ("u", "v"), ("v", "u")], "id string, child string")
    depends = spark.createDataFrame([("a/x", "a/y"), ("a/y", "a/x"), ("a", "a"), ("r", "zz")], "id string, target string")
    got = {(r.problem, r.id) for r in trees.check(nodes, children, depends).collect()}
    assert {("two homes", "a/y"), ("not below a root", "lost"), ("not below a root", "u"), ("not below a root", "v"), ("depends on itself", "a"), ("dependency cycle", "a/x"), ("dependency missing", "r"), ("parent missing", "lost")} <= got


def test_hashes_and_contract_blocks(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "t string").select("t", tx.fnv1a_of(F.col("t")).alias("h"))
    hexed = {r.t: (r.x, r.back == r.h) for r in rows.select("t", "h", tx.hash_to_hex(F.col("h")).alias("x"), tx.hex_to_hash(tx.hash_to_hex(F.col("h"))).alias("back")).collect() if r.t is not None}
    assert hexed == {"": ("cbf29ce484222325", True), "a": ("af63dc4c8601ec8c", True), "foobar": ("85944171f73967e8", True)}
    assert spark.range(1).select(tx.hex_to_hash(F.lit("xyz")).alias("h")).first().h is None
    lines = spark.createDataFrame([("src/a.rs", 1, "p7 here"), ("lib/a.rs", 1, "p7"), ("src/a.rs", 2, "pub enum Q"), ("src/a.rs", 3, "impl<T> Codec<T> for Q {}"), ("src/a.rs", 4, "pub(crate) struct R;")], "path string, line_no int, line string")
    many = spark.createDataFrame([(f"c{i}", "src", f"p{i} ") for i in range(2500)], "contract string, path string, pattern string")
    assert [r.message for r in rules.forbidden(lines, many).collect()] == ["forbidden by c7 : p7 "]
    assert [(r.kind, r.name) for r in rules.definitions(lines).collect()] == [("enum", "Q")]
    assert [(r.trait, r.type) for r in rules.implementations(lines).collect()] == [("Codec", "Q")]


def test_order_and_place_of_findings(spark):
    rows = [("b", "note", "m", "f", 1, None), ("a", "warning", "m", "f", 2, None), ("z", "error", "m", None, None, None), ("a", "warning", "m", "f", 1, None)]
    found = spark.createDataFrame(rows, "rule string, severity string, message string, file string, line int, fix string")
    assert [(r.rule, r.line) for r in rules.ordered(found).collect()] == [("z", None), ("a", 1), ("a", 2), ("b", 1)]
    edges = spark.createDataFrame([("x/a", "y/b"), ("x/c", "y/b")], "src string, dst string")
    assert workspace.recommended(edges, "y/b") == ("x", False) and workspace.recommended(edges, "q") == (None, True)
    again = rules.ffi_modules(spark.createDataFrame([("m", "r", "p", 1, ["a", "b"]), ("m", "r", "q", 2, ["a"])], "module string, rust_file string, py_file string, py_line int, names array<string>"))
    assert again.collect() == [("m", "r", 2, 3)]
