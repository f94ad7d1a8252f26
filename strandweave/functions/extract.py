"""Function bodies of source files, for clone detection; whole-file state needs Python."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_FN = re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+([A-Za-z0-9_]+)")
_DEF = re.compile(r"^(\s*)(?:async\s+)?def\s+([A-Za-z0-9_]+)\s*\(")
_HEADER_LINES = 40


def strip_code(line: str) -> str:
    """The line without string contents and trailing comment; both quote marks delimit strings."""
    out, quote, i = [], "", 0
    while i < len(line):
        c = line[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif line.startswith("//", i):
            break
        else:
            out.append(c)
        i += 1
    return "".join(out)


def _tidy(line: str, marker: str) -> str:
    at = line.find(marker)
    if at >= 0 and line[:at].count('"') % 2 == 0:
        line = line[:at]
    return " ".join(line.split())


def brace_functions(text: str) -> Iterator[tuple[str, int, str, int]]:
    """(name, line, normalised body, body lines) of functions ahead of the test region; inner ones belong to the outer."""
    lines, i = text.splitlines(), 0
    while i < len(lines):
        if "#[cfg(test)]" in lines[i]:
            return
        m = _FN.match(lines[i])
        start = next((k for k in range(i, min(i + _HEADER_LINES, len(lines))) if m and "{" in strip_code(lines[k])), None) if m else None
        if start is None:
            i += 1
            continue
        level, end = 0, None
        for k in range(start, len(lines)):
            code = strip_code(lines[k])
            level += code.count("{") - code.count("}")
            if level <= 0:
                end = k
                break
        if end is None:
            i += 1
            continue
        body = [x for x in (_tidy(line, "//") for line in lines[start + 1 : end]) if x]
        yield m[1], i + 1, "\n".join(body), len(body)
        i = end + 1


def indent_functions(text: str) -> Iterator[tuple[str, int, str, int]]:
    lines, i = text.splitlines(), 0
    while i < len(lines):
        m = _DEF.match(lines[i])
        if not m:
            i += 1
            continue
        depth, k = len(m[1]), i
        while k < len(lines) and not strip_code(lines[k].split("#")[0]).rstrip().endswith(":"):
            k += 1
        end = k + 1
        while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > depth):
            end += 1
        body = [x for x in (_tidy(line, "#") for line in lines[k + 1 : end]) if x]
        if not m[2].startswith("test_"):
            yield m[2], i + 1, "\n".join(body), len(body)
        i = max(end, i + 1)


def bodies(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(file, name, line, body, lines) of the functions in `.rs` and `.py` files; other files give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, t in zip(frame.iloc[:, 0], frame.iloc[:, 1]):
                scan = brace_functions if p and p.endswith(".rs") else indent_functions if p and p.endswith(".py") else None
                rows += [(p, *f) for f in scan(t or "")] if scan else []
            yield pd.DataFrame(rows, columns=["file", "name", "line", "body", "lines"])

    return files.select(path, text).mapInPandas(run, "file string, name string, line int, body string, lines int")
