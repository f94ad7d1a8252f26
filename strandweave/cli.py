"""A thin command line over a repository: `python -m strandweave.cli <command> <root> ...`."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.text import lines_table
from strandweave.operators import blueprint, graph, moves, rules
from strandweave.operators import tree as trees
from strandweave.plans import facts, gate, report, workspace
from strandweave.plans.workspace import Workspace
from strandweave.runtime import session
from strandweave.sources import repo

HOOK = "# strandweave check\npython -m strandweave.cli check . --staged || exit 1\n# end strandweave\n"
COMMANDS = ["init", "tree", "stat", "lean", "check", "index", "place", "ffi", "move", "tidy", "docs", "graph", "query", "hook", "blueprint"]


def _hook(root: str, action: str) -> str:
    path = os.path.join(root, ".git", "hooks", "pre-commit")
    text = open(path).read() if os.path.exists(path) else ""
    if action == "status":
        return "installed" if HOOK in text else "not installed"
    kept = text.replace(HOOK, "")
    if action == "install":
        kept = (kept or "#!/bin/sh\n") + HOOK
    if kept.strip() in ("", "#!/bin/sh"):
        if os.path.exists(path):
            os.remove(path)
    else:
        with open(path, "w") as f:
            f.write(kept)
        os.chmod(path, 0o755)
    return action


def _show(kept: DataFrame, form: str) -> None:
    if form == "sarif":
        print(report.sarif(rules.ordered(kept)))
    elif form == "json":
        print(report.document(rules.ordered(kept)))
    else:
        for r in report.rendered(rules.ordered(kept)).toLocalIterator():
            print(r[0])


def _apply(w: Workspace, old: str, new: str, edits: DataFrame) -> bool:
    """Writes a plan's edits and makes its move; False, with nothing changed, if a line is not what the plan saw."""
    done = moves.apply_edits(w.texts, edits).collect()
    bad = [f"{r['path']}: {r['error']}" for r in done if r["error"]]
    if bad:
        print("\n".join(bad), file=sys.stderr)
        return False
    seen = {r["path"]: r["text"] for r in w.texts.join(edits.select("path").distinct(), "path", "left_semi").collect()}
    workspace.write_files(w.root, {r["path"]: r["text"] for r in done}, seen, [(old, new)])
    return True


def _store(w: Workspace, path: str | None) -> facts.ParquetFactStore:
    return facts.ParquetFactStore(w.spark, path or "file:" + os.path.abspath(w.path("facts")))


def _graph(w: Workspace, args: list[str], o: argparse.Namespace) -> int:
    store, action = _store(w, o.store), args[0]
    if action == "snapshot":
        print(workspace.snapshot(w, store, *args[1:2], allow_stale=o.allow_stale))
    elif action == "query":
        for r in store.query(args[1], " ".join(args[2:])).orderBy("depth", "entity").collect():
            print(r["depth"], r["entity"])
    elif action == "graphql":
        print(json.dumps(facts.graphql(store, " ".join(args[1:]))))
    elif action == "export":
        workspace.export(store, args[1], args[2])
    elif action == "blueprint":
        t = blueprint.from_toml(w.spark, open(os.path.join(w.root, args[1])).read())
        for r in blueprint.fact_rows(t).orderBy("subject", "predicate", "object").collect():
            print(r["subject"], r["predicate"], r["object"])
    else:
        print(f"no action {action}", file=sys.stderr)
        return 2
    return 0


def _blueprint(w: Workspace, args: list[str], o: argparse.Namespace) -> int:
    action, read = args[0], lambda p: blueprint.from_toml(w.spark, open(os.path.join(w.root, p)).read())
    if action == "check":
        said = [r["message"] for r in gate.lock_findings(w).collect()]
    elif action == "validate":
        said = [f"{r['problem']}: {r['id']}" for r in blueprint.validate(read(args[1])).orderBy("problem", "id").collect()]
    elif action == "diff":
        old, new = read(args[1]), read(args[2])
        print(blueprint.shape_change(old, new))
        said = [f"{r['problem']}: {r['id']}" for r in blueprint.evolution(old, new).orderBy("problem", "id").collect()] if o.evolution else []
    elif action in ("verify", "lock"):
        t = read(args[1])
        passed = blueprint.run_witnesses(t, w.root, o.allow_commands)
        said = [f"witness {i} fails" for i, ok in passed.items() if not ok]
        if action == "lock" and not said:
            workspace.write_files(w.root, {args[1].removesuffix(".toml") + ".lock.json": blueprint.lock(t, set(passed))})
    elif action == "scaffold":
        texts = {os.path.join(args[3], p): text for p, text in blueprint.scaffold(read(args[1]), args[2])}
        said = [f"{p} is there already" for p in texts if os.path.exists(os.path.join(w.root, p))]
        if not said:
            workspace.write_files(w.root, texts)
    else:
        said = [f"no action {action}"]
    print("\n".join(said) or "valid")
    return int(bool(said))


def _place(w: Workspace, file: str) -> None:
    """Where a file belongs, by the graph or else by its imports, and a hint if that is elsewhere."""
    if w.graph is not None and not w.edges.where((F.col("src") == file) | (F.col("dst") == file)).isEmpty():
        ranked = graph.placement(w.edges)
    else:
        ranked = graph.place_new(moves.imported_modules(w.texts), moves.module_dirs(w.texts.select("path")))
    rows = ranked.where(F.col("file") == file).orderBy("rank").limit(6).collect()
    for r in rows:
        print(r["n"], r["dir"] or ".")
    own = os.path.dirname(file)
    if rows and rows[0]["dir"] != own:
        print(f"hint: move {file} {'/'.join(p for p in (rows[0]['dir'], os.path.basename(file)) if p)}")


def _tidy(w: Workspace, spark: SparkSession, write: bool, most: int) -> int:
    if w.graph is None:
        print("no index", file=sys.stderr)
        return 2
    for old, new, edits, warnings in moves.tidy(w.texts, w.edges, most):
        if write:
            # each plan is made anew against the files as the one before left them
            own = Workspace(spark, w.root)
            edits, warnings = moves.plan_move(own.texts, old, new)
            if not _apply(own, old, new, edits):
                return 1
        print("\n".join([*moves.render_diff(edits, old, new), *warnings]) if not write else f"moved {old} => {new}")
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="strandweave")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("root")
    p.add_argument("args", nargs="*")
    p.add_argument("--apply", "--write", action="store_true", help="make the changes that move and tidy plan")
    p.add_argument("--save", action="store_true", help="keep the lean report as the baseline")
    p.add_argument("--staged", action="store_true", help="check only what is staged")
    p.add_argument("--since", help="check only what differs from this commit")
    p.add_argument("--allow-stale", action="store_true")
    p.add_argument("--allow-commands", action="store_true", help="run the witnesses' shell commands")
    p.add_argument("--evolution", action="store_true", help="with blueprint diff: what keeps the second from following the first")
    p.add_argument("--format", choices=["text", "json", "sarif"], default="text")
    p.add_argument("--top", type=int, default=15)
    p.add_argument("--store", help="where snapshots are kept")
    o = p.parse_args(argv)
    if o.command == "hook":
        print(_hook(o.root, o.args[0]))
        return 0
    if o.command == "init":
        try:
            workspace.init(o.root)
        except FileExistsError as e:
            print(f"{e} is there already", file=sys.stderr)
            return 1
        return 0
    spark = session("cli")
    w = Workspace(spark, o.root)
    if o.command == "query":
        return _graph(w, ["query", *o.args], o)
    if o.command == "graph":
        return _graph(w, o.args, o)
    if o.command == "blueprint":
        return _blueprint(w, o.args, o)
    if o.command == "docs":
        return workspace.run_configured(w, "docs")
    if o.command == "tree":
        for r in trees.rendered(w.nodes.drop("layer"), int(o.args[0]) if o.args else None).orderBy("path").toLocalIterator():
            print(r["line"])
    elif o.command == "stat":
        for r in trees.subtree(w.nodes).orderBy(F.desc("score"), "id").limit(o.top).collect():
            print(f"{r['score']:.1f} {r['files']} {r['id']}")
    elif o.command == "lean":
        if o.save:
            print(w.save_baseline())
            return 0
        texts = w.texts.join(w.owned.select(F.col("rel").alias("path"), "subrepo"), "path")
        print(json.dumps(w.lean().first().asDict()))
        _show(gate.lean_findings(w.facts, texts, w.edges if w.graph else None), o.format)
    elif o.command == "check":
        changed = repo.changed_files(o.root, o.since, o.staged) if o.staged or o.since else None
        kept = gate.check_workspace(w, changed)["kept"]
        _show(kept, o.format)
        return int(report.has_errors(kept))
    elif o.command == "ffi":
        lines = lines_table(w.texts)
        for r in rules.ffi_edges(lines.where("path LIKE '%.rs'"), lines.where("path LIKE '%.py'")).collect():
            print(json.dumps(r.asDict()))
    elif o.command == "index":
        if o.args[:1] == ["generate"]:
            return workspace.run_configured(w, "index")
        if w.graph is None:
            print("no index", file=sys.stderr)
            return 2
        print(json.dumps(graph.stats(w.graph["refs"]).first().asDict()))
        for r in graph.fan_in(w.graph["refs"]).collect():
            print(r["n"], r["node"])
    elif o.command == "place":
        _place(w, o.args[0])
    elif o.command == "tidy":
        return _tidy(w, spark, o.apply, o.top)
    elif o.command == "move":
        old, new = o.args
        edits, warnings = moves.plan_move(w.texts, old, new)
        print("\n".join([*moves.render_diff(edits, old, new), *warnings]))
        if o.apply and not _apply(w, old, new, edits):
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
