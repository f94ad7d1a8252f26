"""A source repository as tables: listing, content, occurrence indices, configuration."""

from __future__ import annotations

import json
import os
import re
import subprocess
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.text import ancestors_of, dir_of, language_of, leaf_of, plane_of

DEFAULT_SKIP = (".git", "target", "node_modules", "__pycache__", ".venv", "dist", "build", ".idea")


#: Suffixes of sources that an index may be out of date with.
TRACKED = ("rs", "py", "ts", "tsx", "js", "jsx", "go", "java", "kt", "c", "h", "cc", "cpp", "hpp", "rb")


def ignore_regex(body: str) -> str:
    """An ignore pattern as a regular expression over a path: `*` and `?` stay within a component, `**` crosses them."""
    out, i = "", 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.+", i + 3
        elif c == "*":
            out, i = out + "[^/]*", i + (2 if body.startswith("**", i) else 1)
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def _ignore_rules(path: str) -> list[tuple[re.Pattern, bool, bool, bool]]:
    """(pattern, negated, directories only, anchored) of an ignore file; none if it can't be read."""
    rules = []
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            for line in f:
                line = line.rstrip("\n").rstrip("\r")
                line = line if line.endswith("\\ ") else line.rstrip(" ")
                if line and not line.startswith("#"):
                    negated = line.startswith("!")
                    body = line[negated:]
                    only = body.endswith("/")
                    body = body.rstrip("/")
                    if body:
                        rules.append((re.compile(ignore_regex(body.lstrip("/"))), negated, only, "/" in body))
    except OSError:
        pass
    return rules


def _ignored(stack: list[tuple[str, list]], path: str, is_dir: bool) -> bool:
    """The last rule that fits decides; nearer ignore files come later."""
    verdict = False
    for base, rules in stack:
        rel = os.path.relpath(path, base)
        for pattern, negated, only, anchored in rules:
            if (is_dir or not only) and pattern.fullmatch(rel if anchored else os.path.basename(rel)):
                verdict = not negated
    return verdict


def _outer_rules(root: str) -> list[tuple[str, list]]:
    """The rules from above the root: ignore files of the folders around it and the excludes of its git repository."""
    here, stack = os.path.abspath(root), []
    while True:
        excludes = _ignore_rules(os.path.join(here, ".git", "info", "exclude"))
        if excludes:
            stack.append((here, excludes))
        up = os.path.dirname(here)
        if up == here:
            return stack[::-1]
        rules = _ignore_rules(os.path.join(up, ".gitignore"))
        if rules:
            stack.append((up, rules))
        here = up


def walk(root: str, extra_skip: tuple[str, ...] = ()) -> Iterator[tuple[str, bool]]:
    """(relative path, is directory) in order of name; hidden, ignored and skipped entries are left out, unreadable ones passed over.

    Ignore files count in their folder and below, those around the root and the repository's own excludes too.
    """
    skip, root = {*DEFAULT_SKIP, *extra_skip}, os.path.abspath(root)

    def visit(folder: str, stack: list) -> Iterator[tuple[str, bool]]:
        rules = _ignore_rules(os.path.join(folder, ".gitignore"))
        stack = [*stack, (folder, rules)] if rules else stack
        try:
            names = sorted(os.listdir(folder))
        except OSError:
            return
        for name in names:
            path = os.path.join(folder, name)
            is_dir = os.path.isdir(path) and not os.path.islink(path)
            if name.startswith(".") or name in skip or _ignored(stack, path, is_dir):
                continue
            yield os.path.relpath(path, root), is_dir
            if is_dir:
                yield from visit(path, stack)

    yield from visit(root, _outer_rules(root))


def subrepo_roots(root: str, extra_skip: tuple[str, ...] = ()) -> list[str]:
    """Directories below the root that hold a `.git` folder or file."""
    return [rel for rel, is_dir in walk(root, extra_skip) if is_dir and os.path.exists(os.path.join(root, rel, ".git"))]


def subrepo_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, home): the deepest sub-repository (home) around each path, by whole components."""
    from strandweave.operators.tree import nearest_ancestor

    return nearest_ancestor(paths, roots)


def listing(spark: SparkSession, root: str, extra_skip: tuple[str, ...] = ()) -> DataFrame:
    return spark.createDataFrame(list(walk(root, extra_skip)), "rel string, is_dir boolean")


def contents(spark: SparkSession, root: str, max_bytes: int = 2_000_000, suffixes: tuple[str, ...] = (), extra_skip: tuple[str, ...] = ()) -> DataFrame:
    """(rel, size, modified, content) of the files that walk() lists under `root`; content is null over the cap, which the listing decides without reading."""
    listed = listing(spark, root, extra_skip).where("NOT is_dir").select("rel")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = "file:" + os.path.abspath(root).rstrip("/") + "/"
    rel = F.expr(f"substring(replace(path, 'file:///', 'file:/'), {len(prefix) + 1})")
    rows = files.select(rel.alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))
    if suffixes:
        listed = listed.where(F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1)).isin(*[s.lower() for s in suffixes]))
    return rows.join(listed, "rel", "left_semi")


def texts(files: DataFrame) -> DataFrame:
    """(path, text) of the readable ones: content there and valid UTF-8."""
    return files.where("content IS NOT NULL AND is_valid_utf8(cast(content AS string))").select(F.col("rel").alias("path"), F.col("content").cast("string").alias("text"))


def derived_tree(files: DataFrame) -> DataFrame:
    """(id, parent, kind, plane, language) from paths (rel): a composite for each directory, the root being `.`.

    A directory's language is the most frequent of its own files, the greatest name on ties.
    """
    dirs = files.select(F.explode(ancestors_of(F.col("rel"))).alias("id")).where("id != rel" if "id" in files.columns else "true").distinct()
    dirs = dirs.join(files.select(F.col("rel").alias("id")), "id", "left_anti")
    home = lambda c: F.when(dir_of(c) == "", ".").otherwise(dir_of(c))
    counts = files.select(home(F.col("rel")).alias("dir"), language_of(F.col("rel")).alias("language")).where("language IS NOT NULL").groupBy("dir", "language").agg(F.count("*").alias("n"))
    main = counts.groupBy("dir").agg(F.max(F.struct("n", "language")).getField("language").alias("language"))
    root = files.sparkSession.createDataFrame([(".",)], "id string").select("id", F.lit(None).cast("string").alias("parent"))
    folders = root.unionByName(dirs.select("id", home(F.col("id")).alias("parent"))).join(main, F.col("id") == F.col("dir"), "left").drop("dir")
    composites = folders.select("id", "parent", F.lit("composite").alias("kind"), plane_of(F.col("id")).alias("plane"), "language")
    atoms = files.select(F.col("rel").alias("id"), home(F.col("rel")).alias("parent"), F.lit("atom").alias("kind"), plane_of(F.col("rel")).alias("plane"), language_of(F.col("rel")).alias("language"))
    return composites.unionByName(atoms)


def overlay(authored: DataFrame, derived: DataFrame) -> DataFrame:
    """Authored nodes, and the derived ones whose id no authored node has."""
    return authored.unionByName(derived.join(authored.select("id"), "id", "left_anti").select(*authored.columns), allowMissingColumns=True)


def config(text: str) -> dict:
    """A configuration with its defaults filled in."""
    doc = tomllib.loads(text)
    blank = {"root": ".", "version": 1, "skip": [], "allow": [], "layers": [], "layer_dirs": {}, "rules": {}, "contracts": [], "nodes": []}
    return {**blank, **doc}


def to_toml(doc: dict) -> str:
    """A document of scalars, lists, tables and arrays of tables as TOML, which reads back equal; nulls are left out."""

    def value(v) -> str:
        if isinstance(v, list):
            return "[" + ", ".join(map(value, v)) + "]"
        return json.dumps(v, ensure_ascii=False) if isinstance(v, (str, bool)) else repr(v)

    def key(k: str) -> str:
        return k if re.fullmatch(r"[A-Za-z0-9_-]+", k) else json.dumps(k)

    own = [f"{key(k)} = {value(v)}" for k, v in doc.items() if v is not None and not isinstance(v, dict) and not (isinstance(v, list) and v and isinstance(v[0], dict))]
    for k, v in doc.items():
        for head, rows in ((f"[{key(k)}]", [v] if isinstance(v, dict) else []), (f"[[{key(k)}]]", v if isinstance(v, list) and v and isinstance(v[0], dict) else [])):
            for row in rows:
                own += ["", head, *[f"{key(a)} = {value(b)}" for a, b in row.items() if b is not None]]
    return "\n".join(own) + "\n"


def changed_files(root: str, since: str | None = None, staged: bool = False) -> list[str]:
    """Paths that differ from `since` or are staged. A failing git raises: an empty answer would hide every finding."""
    out: set[str] = set()
    for args in ([["diff", "--name-only", "--cached"]] if staged else []) + ([["diff", "--name-only", since]] if since else [["diff", "--name-only", "HEAD"]]) + ([] if staged else [["ls-files", "--others", "--exclude-standard"]]):
        # files that git doesn't know yet count as changed
        out |= set(subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, text=True).stdout.split("\n")) - {""}
    return sorted(out)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields: numbers and byte strings as they come."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
            yield tag >> 3, value
        elif tag & 7 == 2:
            size, at = _varint(data, at)
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            at += 8 if tag & 7 == 1 else 4


def _numbers(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = _varint(data, at)
        out.append(value)
    return out


def _occurrence(data: bytes) -> tuple[str, int, list[int], list[int] | None]:
    symbol, roles, span, around = "", 0, [], []
    for n, v in _fields(data):
        if n == 1:
            span += _numbers(v) if isinstance(v, bytes) else [v]
        elif n == 2:
            symbol = v.decode()
        elif n == 3:
            roles = v
        elif n == 7:
            around += _numbers(v) if isinstance(v, bytes) else [v]
    return symbol, roles, span, around or None


def _symbol(data: bytes) -> tuple[str, str, int, bool]:
    name, display, kind, impl = "", "", 0, False
    for n, v in _fields(data):
        if n == 1:
            name = v.decode()
        elif n == 4:
            impl = impl or any(k == 2 and x for k, x in _fields(v))
        elif n == 5:
            kind = v
        elif n == 6:
            display = v.decode()
    return name, display, kind, impl


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(occurrences, symbols) of the occurrence indices at `path`, shaped for code_graph; index names the file they come from."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def occurrences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                for number, doc in _fields(bytes(content)):
                    if number == 2:
                        parts = list(_fields(doc))
                        rel = next((v.decode() for n, v in parts if n == 1), "")
                        rows = [(name, rel, k, *_occurrence(v)) for k, v in enumerate(v for n, v in parts if n == 2)]
                        yield pd.DataFrame(rows, columns=["index", "file", "ord", "symbol", "roles", "range", "enclosing"])

    def symbols(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                for number, doc in _fields(bytes(content)):
                    if number == 2:
                        parts = list(_fields(doc))
                        rel = next((v.decode() for n, v in parts if n == 1), "")
                        yield pd.DataFrame([(name, rel, *_symbol(v)) for n, v in parts if n == 3], columns=["index", "file", "symbol", "display", "kind", "is_impl"])

    return (
        files.mapInPandas(occurrences, "index string, file string, ord int, symbol string, roles int, range array<int>, enclosing array<int>"),
        files.mapInPandas(symbols, "index string, file string, symbol string, display string, kind int, is_impl boolean"),
    )


def require_fresh(files: DataFrame, indices: DataFrame) -> None:
    """Raises if any source (modified) is younger than any index (modified), or if there is no index."""
    newest, oldest = files.agg(F.max("modified")).first()[0], indices.agg(F.min("modified")).first()[0]
    if oldest is None or newest is not None and newest > oldest:
        raise RuntimeError("the index is stale: a source is newer, or there is none")


def leaf_tag(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", leaf_of(F.col("id")).alias("name"))


def discover_indices(root: str) -> list[str]:
    """The occurrence indices right under `root`, by name."""
    return sorted(os.path.join(root, n) for n in os.listdir(root) if n.endswith(".scip"))


def discover_graph_inputs(root: str, folder: str = ".strandweave") -> list[str]:
    """The inputs of a snapshot: the index at the root, those in `folder`, and the architecture documents there."""
    found = [os.path.join(root, "index.scip"), os.path.join(root, folder, "index.scip")]
    for sub, end in (("indexes", ".scip"), ("blueprints", ".toml")):
        here = os.path.join(root, folder, sub)
        found += [os.path.join(here, n) for n in sorted(os.listdir(here)) if n.endswith(end)] if os.path.isdir(here) else []
    return [f for f in found if os.path.exists(f)]


def merge_symbols(parts: list[DataFrame]) -> DataFrame:
    """Symbols of several indices; where two define one symbol the later index wins."""
    ranked = [p.withColumn("_index", F.lit(k)) for k, p in enumerate(parts)]
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    columns = parts[0].columns
    best = rows.groupBy("symbol").agg(F.max_by(F.struct(*columns), "_index").alias("s"))
    return best.select("s.*")
