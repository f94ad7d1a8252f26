"""Rendering, composing, bindings, tidying and the command line."""

import json

import pytest

from strandweave import cli
from strandweave.operators import blueprint, compose, moves
from strandweave.operators import tree as trees
from strandweave.sources import repo


def test_rendered_tree_and_cycle_path(spark):
    rows = [("root", None, "composite", None), ("a", "root", "composite", None), ("a/y", "a", "atom", 1), ("a/x", "a", "atom", 1), ("b", "root", "composite", None)]
    nodes = spark.createDataFrame(rows, "id string, parent string, kind string, loc long")
    assert [r.line for r in trees.rendered(nodes).orderBy("path").collect()] == ["root (2)", "  a (2)", "    x", "    y", "  b (0)"]
    assert trees.rendered(nodes, 1).count() == 3
    pairs = lambda *p: spark.createDataFrame(list(p), "id string, target string")
    assert trees.dependency_path(pairs(("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))) == ["a", "b", "c", "a"]
    assert trees.dependency_path(pairs(("q", "q"), ("a", "b"))) == ["q", "q"] and trees.dependency_path(pairs(("a", "b"))) == []


def test_composed_documents(spark):
    rows = [("top", None, 0, "composite", "Top", None, ["t"], False), ("one", "top", 1, "atom", None, "first", ["z"], False), ("two", "top", 3, "composite", "Two", None, [], False), ("old", "top", 2, "atom", None, "gone", ["o"], True), ("in", "two", 1, "atom", None, "inner", ["a"], None)]
    schema = "id string, parent string, ord int, kind string, title string, body string, topics array<string>, deprecated boolean"
    out = {r.id: (r.text, r.topics) for r in compose.compose(spark.createDataFrame(rows, schema)).collect()}
    assert out == {"top": ("## Top\n\nfirst\n\n## Two\n\ninner", ["a", "t", "z"]), "two": ("## Two\n\ninner", ["a"])}
    with pytest.raises(ValueError):
        compose.compose(spark.createDataFrame([("x", "y", 0, "composite", "X", None, [], False), ("y", "x", 0, "composite", "Y", None, [], False)], schema))


def test_bindings_and_locks(spark):
    rows = {"meta": [("p", "Pipe", "locked", "gone")], "slot": [("p", "s", "x", [], False)], "implementation": [("p", "i", ["s"], "a.rs#f"), ("p", "j", ["s"], "a.rs"), ("p", "k", ["s"], "b.rs#f")], "witness": [("p", "w", "unit", ["s"], "true"), ("p", "v", "unit", ["s"], " ")]}
    t = blueprint.tables(spark, rows)
    files = spark.createDataFrame([("a.rs",)], "rel string")
    assert {(r.id, r.problem) for r in blueprint.binding_errors(t, files).collect()} == {("j", "not a path and a symbol"), ("k", "no such file")}
    found = blueprint.lock_findings([(t, None)], files)
    assert "p: no lock" in found and "p: predecessor gone is missing" in found and "p: no such file (k)" in found
    with pytest.raises(PermissionError):
        blueprint.run_witnesses(t, ".")
    assert blueprint.run_witnesses(t, ".", allowed=True) == {"w": True, "v": False}


def test_tidy_and_imports(spark):
    files = spark.createDataFrame([("src/lib.rs", "mod a;\nmod util;\n"), ("src/a/mod.rs", "use crate::util::h; use crate::util::k;\n"), ("src/util/mod.rs", "pub mod h;\n"), ("src/util/h.rs", "")], "path string, text string")
    plans = list(moves.tidy(files, spark.createDataFrame([("src/a/mod.rs", "src/util/h.rs")], "src string, dst string")))
    assert [(p[0], p[1]) for p in plans] == [("src/util/h.rs", "src/a/h.rs")]
    assert sorted(r.kind for r in plans[0][2].collect()) == ["delete", "insert", "replace"]
    assert [r.module for r in moves.imported_modules(files).collect()] == ["util", "util"]
    assert {r.module: r.dir for r in moves.module_dirs(files).collect()}["util"] == "src/util"


def test_merged_symbols_and_discovery(spark, tmp_path):
    a, b = (spark.createDataFrame([("s", d)], "symbol string, display string") for d in ("old", "new"))
    assert repo.merge_symbols([a, b]).first().display == "new"
    (tmp_path / "b.scip").write_bytes(b"")
    (tmp_path / "index.scip").write_bytes(b"")
    (tmp_path / ".strandweave" / "blueprints").mkdir(parents=True)
    (tmp_path / ".strandweave" / "blueprints" / "x.toml").write_text("")
    assert [p.rsplit("/", 1)[1] for p in repo.discover_indices(str(tmp_path))] == ["b.scip", "index.scip"]
    assert [p.rsplit("/", 1)[1] for p in repo.discover_graph_inputs(str(tmp_path))] == ["index.scip", "x.toml"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src" / "a").mkdir(parents=True)
    (tmp_path / "src/lib.rs").write_text("mod a;\nmod c;\n")
    (tmp_path / "src/a.rs").write_text("pub mod b;\n")
    (tmp_path / "src/c.rs").write_text("use crate::a::b::f;\n")
    (tmp_path / "src/a/b.rs").write_text("pub fn f() {}\n")
    root = str(tmp_path)
    for args in (["tree", root], ["stat", root, "--top", "3"], ["check", root, "--format", "json"], ["ffi", root], ["place", root, "src/c.rs"]):
        assert cli.main(args) == 0
    said = capsys.readouterr().out
    assert ". (4)" in said and '"rule":"undocumented"' in said and "src/a" in said
    assert cli.main(["check", root, "--format", "sarif"]) == 0 and json.loads(capsys.readouterr().out)["version"] == "2.1.0"
    assert cli.main(["index", root]) == 2
    assert cli.main(["move", root, "src/a/b.rs", "src/c/b.rs", "--apply"]) == 0
    assert (tmp_path / "src/c.rs").read_text() == "pub mod b;\nuse crate::c::b::f;\n" and (tmp_path / "src/c/b.rs").exists() and not (tmp_path / "src/a/b.rs").exists()
    (tmp_path / ".git/hooks").mkdir(parents=True)
    for action in ("install", "status", "uninstall"):
        cli.main(["hook", root, action])
    assert "installed" in capsys.readouterr().out and not (tmp_path / ".git/hooks/pre-commit").exists()
