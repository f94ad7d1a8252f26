"""A repository on disk as one workspace: its configuration, tables, snapshots, documents, and changes written back."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.text import dir_of
from strandweave.operators import blueprint, dups, graph
from strandweave.operators import tree as trees
from strandweave.plans import facts
from strandweave.sources import repo

FOLDER, CONFIG, BASELINE = ".strandweave", "strandweave.toml", "lean.json"


@dataclass
class Workspace:
    """The tables of the repository at `root`, made when they are asked for."""

    spark: SparkSession
    root: str
    more: dict = field(default_factory=dict)

    @cached_property
    def config(self) -> dict:
        """The configuration file, or the defaults where there is none."""
        path = os.path.join(self.root, CONFIG)
        return repo.config(open(path).read() if os.path.exists(path) else "") | self.more

    @cached_property
    def files(self) -> DataFrame:
        return repo.contents(self.spark, self.root, extra_skip=tuple(self.config["skip"])).persist()

    @cached_property
    def owned(self) -> DataFrame:
        """The files with the sub-repository each lies in."""
        roots = self.spark.createDataFrame([(r,) for r in repo.subrepo_roots(self.root, tuple(self.config["skip"]))], "home string")
        homes = repo.subrepo_of(self.files.select(F.col("rel").alias("path")), roots).withColumnRenamed("path", "rel").withColumnRenamed("home", "subrepo")
        return self.files.join(homes, "rel")

    @cached_property
    def facts(self) -> DataFrame:
        return dups.file_facts(self.owned).persist()

    @cached_property
    def texts(self) -> DataFrame:
        return repo.texts(self.files)

    @cached_property
    def nodes(self) -> DataFrame:
        """Authored nodes of the configuration over those that the folders give, with lines and declared layers."""
        derived = repo.derived_tree(self.files.select("rel"))
        authored = self.spark.createDataFrame([(n["id"], n.get("parent"), n.get("kind", "composite")) for n in self.config["nodes"]], "id string, parent string, kind string")
        rows = repo.overlay(authored.select("id", "parent", "kind"), derived.select("id", "parent", "kind"))
        layers = self.spark.createDataFrame(sorted(self.config["layer_dirs"].items()), "_dir string, layer string")
        lines = self.facts.select(F.col("rel").alias("_rel"), F.col("lines").alias("loc"))
        return rows.join(lines, F.col("id") == F.col("_rel"), "left").join(layers, F.col("id") == F.col("_dir"), "left").select("id", "parent", "kind", "loc", "layer")

    @cached_property
    def graph(self) -> dict[str, DataFrame] | None:
        """The code graph of the indices at the root; None without any."""
        found = repo.discover_indices(self.root)
        if not found:
            return None
        parts = [graph.code_graph(*(t.drop("index") for t in repo.read_index(self.spark, f))) for f in found]
        return {"symbols": repo.merge_symbols([p["symbols"] for p in parts]), **{k: graph.merge_graphs(*[p[k] for p in parts]) for k in ("refs", "file_deps")}}

    @cached_property
    def edges(self) -> DataFrame:
        return self.graph["file_deps"] if self.graph else self.spark.createDataFrame([], "src string, dst string")

    def lean(self) -> DataFrame:
        """The one-row report; dead and misplaced are counted only where there is an index."""
        from strandweave.functions.text import lines_table
        from strandweave.operators.rules import dead_symbols

        counts = trees.subtree(self.nodes).select("kind", "files", F.col("parent").isNull().alias("is_root"))
        own = self.graph
        dead = dead_symbols(own["symbols"], own["refs"], lines_table(self.texts)) if own else None
        return dups.lean_metrics(counts, self.facts, dead, graph.misplaced(own["file_deps"]) if own else None)

    def path(self, *parts: str) -> str:
        return os.path.join(self.root, FOLDER, *parts)

    def save_baseline(self) -> str:
        """Keeps the report as what later checks are held against."""
        row = self.lean().first()
        text = json.dumps(baseline_of(row.asDict()), sort_keys=True)
        write_files(self.root, {f"{FOLDER}/{BASELINE}": text})
        return text

    def baseline(self) -> dict | None:
        path = self.path(BASELINE)
        return json.load(open(path)) if os.path.exists(path) else None

    def blueprints(self) -> list[tuple[str, blueprint.Tables, str | None]]:
        """(file, tables, text of the lock) of the documents in the folder, by name."""
        here = self.path("blueprints")
        out = []
        for name in sorted(os.listdir(here)) if os.path.isdir(here) else []:
            if name.endswith(".toml"):
                lock = os.path.join(here, name[:-5] + ".lock.json")
                out.append((name, blueprint.from_toml(self.spark, open(os.path.join(here, name)).read()), open(lock).read() if os.path.exists(lock) else None))
        return out


def baseline_of(report: dict) -> dict:
    """The measures of a lean report that a ratchet watches; unmeasured ones stay null."""
    return {k: report.get(k) for k in ("score", "dup_files", "empty", "dead", "misplaced")}


def digest_of(path: str) -> str:
    with open(path, "rb") as f:
        return "sha256:" + hashlib.file_digest(f, "sha256").hexdigest()


def input_facts(spark: SparkSession, path: str, root: str) -> DataFrame:
    """The facts of one input, an index or a document, with its place and digest as their source."""
    locator = os.path.relpath(path, root)
    if path.endswith(".toml"):
        t = blueprint.from_toml(spark, open(path).read())
        problems = [r["problem"] for r in blueprint.validate(t).collect()]
        if problems:
            raise ValueError(f"{locator}: {'; '.join(sorted(problems))}")
        return facts.facts_from_blueprint(blueprint.fact_rows(t), locator, digest_of(path))
    g = graph.code_graph(*(t.drop("index") for t in repo.read_index(spark, path)))
    return facts.facts_from_graph(g["symbols"], g["refs"], g["file_deps"], locator, digest_of(path))


def snapshot(w: Workspace, store: facts.FactStore, ref: str = "main", allow_stale: bool = False) -> str:
    """Finds the inputs, refuses stale indices, turns all into facts, and moves `ref` to the snapshot of them.

    The snapshot's parent is what the ref named before. Without inputs it raises ValueError.
    """
    inputs = sorted({os.path.realpath(p) for p in repo.discover_graph_inputs(w.root)})
    if not inputs:
        raise ValueError("nothing to take a snapshot of: no index and no blueprint")
    indices = [p for p in inputs if not p.endswith(".toml")]
    if indices and not allow_stale:
        times = w.spark.createDataFrame([(os.path.getmtime(p),) for p in indices], "t double").select(F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("modified"))
        repo.require_fresh(w.files.where(F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1)).isin(*repo.TRACKED)), times)
    rows = [input_facts(w.spark, p, os.path.realpath(w.root)) for p in inputs]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    try:
        before = store.resolve(ref)
    except KeyError:
        before = None
    own = store.create_snapshot(before, whole) if before is None or not _same(store, before, whole) else before
    store.set_ref(ref, own)
    return own


def _same(store: facts.FactStore, snapshot_id: str, rows: DataFrame) -> bool:
    """True if the snapshot holds just these facts: taking it again changes nothing."""
    return facts.digest(store.facts(snapshot_id).drop("ordinal")) == facts.digest(rows)


def export(store: facts.FactStore, name: str, out: str) -> None:
    """All facts of a snapshot, in order, as files of JSON lines."""
    store.facts(store.resolve(name)).orderBy("ordinal").write.mode("overwrite").json(out)


def write_files(root: str, texts: dict[str, str], seen: dict[str, str] | None = None, moves: list[tuple[str, str]] | None = None) -> None:
    """Writes all of `texts` (path: text) and makes the `moves`, or changes nothing.

    With `seen` each file must still hold the text that the plan saw. New texts go beside their files first; then
    each is put in place by a rename, and if one fails those before it are put back.
    """
    at = lambda p: os.path.join(root, p)
    for p, text in (seen or {}).items():
        with open(at(p), newline="") as f:
            if f.read() != text:
                raise RuntimeError(f"{p} has changed since the plan was made")
    for old, new in moves or []:
        if not os.path.exists(at(old)) or os.path.exists(at(new)):
            raise RuntimeError(f"{old} can't move to {new}: one is missing or the other is there")
    undo: list[tuple[str, bytes | None]] = []
    moved: list[tuple[str, str]] = []
    try:
        for p, text in texts.items():
            os.makedirs(os.path.dirname(at(p)) or ".", exist_ok=True)
            with open(at(p) + ".new", "w", newline="") as f:
                f.write(text)
        for p in texts:
            undo.append((p, open(at(p), "rb").read() if os.path.exists(at(p)) else None))
            os.replace(at(p) + ".new", at(p))
        for old, new in moves or []:
            os.makedirs(os.path.dirname(at(new)) or ".", exist_ok=True)
            os.replace(at(old), at(new))
            moved.append((old, new))
    except OSError:
        for old, new in reversed(moved):
            os.replace(at(new), at(old))
        for p, was in reversed(undo):
            if was is None:
                os.remove(at(p))
            else:
                with open(at(p), "wb") as f:
                    f.write(was)
        raise
    finally:
        for p in texts:
            if os.path.exists(at(p) + ".new"):
                os.remove(at(p) + ".new")


def init(root: str) -> str:
    """A first configuration with what lies at the top level; raises FileExistsError if there is one."""
    path = os.path.join(root, CONFIG)
    if os.path.exists(path):
        raise FileExistsError(path)
    tops = [rel for rel, is_dir in repo.walk(root) if is_dir and "/" not in rel]
    text = repo.to_toml({"root": ".", "version": 1, "skip": [], "allow": [], "layers": [], "rules": {"most_children": 0, "most_depth": 0, "forbid_cycles": False, "layering": False, "placement": False}, "nodes": [{"id": t, "parent": "."} for t in tops]})
    write_files(root, {CONFIG: text})
    return text


def run_configured(w: Workspace, name: str) -> int:
    """Runs the command that the configuration's table `name` gives, under the root, and gives its exit code; 2 without one."""
    command = (w.config.get(name) or {}).get("command")
    return subprocess.run(command if isinstance(command, list) else ["sh", "-c", command], cwd=w.root).returncode if command else 2


def recommended(edges: DataFrame, file: str) -> tuple[str | None, bool]:
    """(directory, well placed) of a file by its edges: None without any; well placed if it lies there already."""
    row = graph.placement(edges).where((F.col("file") == file) & (F.col("rank") == 1)).select("dir", dir_of(F.col("file")).alias("own")).first()
    return (None, True) if row is None else (row["dir"], row["dir"] == row["own"])
