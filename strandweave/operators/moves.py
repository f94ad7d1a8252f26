"""Planning and applying the text edits that a moved source file needs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.text import lines_table

EDITS = "path string, line_no int, before string, after string, kind string, reason string"


class ReferenceResolver(Protocol):
    """Plans the moves of one language."""

    def claims(self, path: str) -> bool: ...
    def plan(self, files: DataFrame, old: str, new: str) -> tuple[DataFrame, list[str]]: ...


def module_path(path: str) -> list[str] | None:
    """The segments under `src`; None for a crate root or a file elsewhere."""
    m = re.fullmatch(r"(?:.*/)?src/(.+)\.rs", path)
    if not m:
        return None
    parts = m[1].split("/")
    if parts[-1] == "mod":
        parts.pop()
    return None if not parts or parts in (["lib"], ["main"]) else parts


def _owner(paths: set[str], old: str, segments: list[str]) -> str | None:
    """The file that must declare the module: the crate root, else `parent.rs`, else `parent/mod.rs`."""
    base = old[: old.rindex("src/") + 4]
    above = "/".join(segments[:-1])
    tries = [f"{base}lib.rs", f"{base}main.rs"] if not above else [f"{base}{above}.rs", f"{base}{above}/mod.rs"]
    return next((t for t in tries if t in paths), None)


class RustModules:
    """Moves of modules: the declaration goes from one parent to the other and full paths are rewritten everywhere."""

    def claims(self, path: str) -> bool:
        return path.endswith(".rs")

    def plan(self, files: DataFrame, old: str, new: str) -> tuple[DataFrame, list[str]]:
        spark = files.sparkSession
        a, b = module_path(old), module_path(new)
        if a is None or b is None:
            return spark.createDataFrame([], EDITS), ["a crate root, or a file outside src, can't be moved as a module"]
        warnings: list[str] = []
        base = F.lit(True)
        candidates = {x for segs in (a, b) for stem in ("/".join(segs[:-1]),) for x in ([f"{stem}.rs", f"{stem}/mod.rs"] if stem else ["lib.rs", "main.rs"])}
        root = old[: old.rindex("src/") + 4]
        paths = {r["path"] for r in files.where(F.col("path").isin(*[root + c for c in candidates]) & base).select("path").collect()}
        lines = lines_table(files)
        before, after = "::".join(["crate", *a]), "::".join(["crate", *b])
        boundary = rf"(?<![A-Za-z0-9_]){re.escape(before)}(?![A-Za-z0-9_])"
        hits = lines.where(F.contains("line", F.lit(before)))
        rewrite = hits.select("path", "line_no", F.col("line").alias("before"), F.regexp_replace("line", boundary, after).alias("after"), F.lit("replace").alias("kind"), F.lit("path rewritten").alias("reason"))
        edits = rewrite.where("before != after")
        giver, taker = _owner(paths, old, a), _owner(paths, new, b)
        declaration = r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+{}\s*;"
        kept = f"mod {b[-1]};"
        if giver is None:
            warnings.append("no file declares the module now")
        else:
            own = lines.where((F.col("path") == giver) & F.col("line").rlike(declaration.format(re.escape(a[-1])))).orderBy("line_no").limit(1)
            first = own.first()
            if first is None:
                warnings.append(f"{giver} has no declaration of {a[-1]}")
            else:
                kept = re.sub(rf"\bmod\s+{re.escape(a[-1])}\b", f"mod {b[-1]}", first["line"].strip())
                edits = edits.unionByName(own.select("path", "line_no", F.col("line").alias("before"), F.lit(None).cast("string").alias("after"), F.lit("delete").alias("kind"), F.lit("declaration leaves").alias("reason")))
        if taker is None:
            warnings.append(f"no parent module for {new}; it must be made first")
        else:
            last = lines.where((F.col("path") == taker) & F.col("line").rlike(declaration.format(r"\w+"))).agg(F.max("line_no")).first()[0] or 0
            edits = edits.unionByName(spark.createDataFrame([(taker, last, None, kept, "insert", "declaration arrives")], EDITS))
        relative = lines.where((F.col("path") == old) & F.col("line").rlike(r"(?<![A-Za-z0-9_])(super|self)::"))
        warnings += [f"{old}:{r['line_no']} has a relative path" for r in relative.orderBy("line_no").collect()]
        return edits, warnings


RESOLVERS: list[ReferenceResolver] = [RustModules()]


def plan_move(files: DataFrame, old: str, new: str) -> tuple[DataFrame, list[str]]:
    """(edits, warnings) of the first resolver that claims the file; else a bare rename."""
    for r in RESOLVERS:
        if r.claims(old):
            return r.plan(files, old, new)
    return files.sparkSession.createDataFrame([], EDITS), [f"nothing knows the references to {old}; it is only renamed"]


def split_ends(text: str) -> list[tuple[str, str]]:
    """(line, terminator) with terminators as they are."""
    return [(m[1], m[2]) for m in re.finditer(r"([^\r\n]*(?:\r(?!\n)[^\r\n]*)*)(\r\n|\n|$)", text) if m[0]]


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, text, error): each edited file's new text; with a stale line there is an error and the old text.

    Lines are changed from the bottom up, so their numbers hold; inserted lines take the file's usual terminator.
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame([], columns=["path", "text", "error"])
        text = left["text"].iloc[0]
        lines = split_ends(text)
        ends = [e for _, e in lines if e]
        usual = max(("\n", "\r\n"), key=ends.count) if ends else "\n"
        for e in right.sort_values(["line_no", "kind"], ascending=[False, True]).itertuples():
            at = int(e.line_no) - 1
            if e.kind == "insert":
                if at >= 0 and not lines[at][1]:
                    lines[at] = (lines[at][0], usual)
                lines.insert(at + 1, (e.after, usual))
            elif at >= len(lines) or lines[at][0] != e.before:
                return pd.DataFrame([(key[0], text, f"line {e.line_no} is not what the plan saw")], columns=["path", "text", "error"])
            elif e.kind == "delete":
                del lines[at]
            else:
                lines[at] = (e.after, lines[at][1])
        return pd.DataFrame([(key[0], "".join(a + b for a, b in lines), None)], columns=["path", "text", "error"])

    left, right = files.select("path", "text").groupBy("path"), edits.groupBy("path")
    return left.cogroup(right).applyInPandas(run, "path string, text string, error string")


def render_diff(edits: DataFrame, old: str, new: str) -> Iterator[str]:
    """The plan as text: the rename, then each file's changes in order."""
    yield f"rename {old} => {new}"
    path = None
    for e in edits.orderBy("path", "line_no").toLocalIterator():
        if e["path"] != path:
            path = e["path"]
            yield f"--- {path}"
        if e["before"] is not None:
            yield f"-{e['line_no']}: {e['before']}"
        if e["after"] is not None:
            yield f"+{e['line_no']}: {e['after']}"


def tidy(files: DataFrame, file_edges: DataFrame, most: int = 20) -> Iterator[tuple[str, str, DataFrame, list[str]]]:
    """(old, new, edits, warnings) for the first `most` misplaced files by name, a report to be worked off one by one.

    Each plan is made against `files` as given; whoever applies one should read the files again before the next.
    """
    from strandweave.operators.graph import misplaced

    for r in misplaced(file_edges).orderBy("file").limit(most).collect():
        new = "/".join(p for p in (r["suggested_dir"], r["file"].rsplit("/", 1)[-1]) if p)
        yield (r["file"], new, *plan_move(files, r["file"], new))


def imported_modules(files: DataFrame) -> DataFrame:
    """(file, module): every `crate::segment` in the text, repeats kept."""
    found = F.expr(r"regexp_extract_all(text, 'crate::([\\p{Alnum}_]+)', 1)")
    return files.select(F.col("path").alias("file"), F.explode(found).alias("module"))


def module_dirs(paths: DataFrame) -> DataFrame:
    """(module, dir) for source files (path): a file's stem and each folder but `src` name a module; the least path wins."""
    rows = paths.where(F.col("path").endswith(".rs")).select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]+)\.rs$", 1).alias("stem"))
    parts = F.filter(F.split("dir", "/"), lambda x: (x != "src") & (x != ""))
    named = rows.select("path", "dir", F.explode(F.concat(F.array("stem"), parts)).alias("module"))
    return named.where("module != 'mod'").groupBy("module").agg(F.min_by("dir", F.struct("path", "dir")).alias("dir"))
