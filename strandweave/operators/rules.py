"""Findings: the rules that make them, what exempts them, and their counts.

A finding is (rule, severity, message, file, line, fix); line and fix may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.text import glob_holds, union_all

COLUMNS = ["rule", "severity", "message", "file", "line", "fix"]
GLOBAL_RULES = ("lean-regression", "tree-invariant", "layer-cycle", "growth", "abstraction-depth", "blueprint-lock")
MARKER = "lint:allow"


def finding(df: DataFrame, rule: str, severity: str, message: Column, file: Column | None = None, line: Column | None = None, fix: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.lit(rule).alias("rule"),
        F.lit(severity).alias("severity"),
        message.cast("string").alias("message"),
        (none if file is None else file).cast("string").alias("file"),
        (none if line is None else line).cast("int").alias("line"),
        (none if fix is None else fix).cast("string").alias("fix"),
    )


def _allowed(rule: Column, entry: Column) -> Column:
    """An entry names the rule, its family (`layer` for `layer-cycle`), or all with `*`."""
    return (entry == "*") | (rule == entry) | rule.startswith(F.concat(entry, F.lit("-")))


def partition_allowed(findings: DataFrame, allow: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, exempt) by entries `rule[:glob]`; an empty list keeps all."""
    hit = F.lit(False)
    for entry in allow:
        rule, colon, glob = entry.partition(":")
        own = _allowed(F.col("rule"), F.lit(rule))
        hit = hit | (own & glob_holds(F.coalesce("file", F.lit("")), F.lit(glob)) if colon else own)
    return findings.where(~hit), findings.where(hit)


def waivers(lines: DataFrame, marker: str = MARKER) -> DataFrame:
    """(path, line_no, rules) where a line carries the marker; rules is empty for a bare one."""
    named = F.regexp_extract("line", rf"{marker}\(([^)]*)\)", 1)
    rules = F.filter(F.transform(F.split(named, ","), lambda x: F.trim(x)), lambda x: x != "")
    return lines.where(F.contains("line", F.lit(marker))).select("path", "line_no", rules.alias("rules"))


def waived(findings: DataFrame, lines: DataFrame, marker: str = MARKER) -> tuple[DataFrame, DataFrame]:
    """(kept, waived): a marker on the finding's line or on the line above waives it, if it is bare or names the rule or its family."""
    marks = waivers(lines, marker).withColumn("at", F.explode(F.array(F.col("line_no"), F.col("line_no") + 1)))
    hit = (findings["file"] == marks["path"]) & (findings["line"] == marks["at"])
    hit = hit & ((F.size("rules") == 0) | F.exists("rules", lambda r: _allowed(findings["rule"], r)))
    return findings.join(marks, hit, "left_anti"), findings.join(marks, hit, "left_semi")


def scoped(findings: DataFrame, changed: DataFrame) -> DataFrame:
    """Findings of whole-repository rules, and those in changed files (file)."""
    everywhere = F.col("rule").isin(*GLOBAL_RULES)
    return findings.where(everywhere).unionByName(findings.where(~everywhere).join(changed.select("file").distinct(), "file", "left_semi").select(*findings.columns))


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def _blocks(contracts: DataFrame, most: int = 1000) -> list[DataFrame]:
    """Contracts in blocks of about `most`, each fit to be broadcast; they are declared by hand, so there is one as a rule."""
    n = contracts.count()
    parts = max(1, -(-n // most))
    return [F.broadcast(contracts.where(F.pmod(F.xxhash64(*contracts.columns), F.lit(parts)) == k)) for k in range(parts)] if parts > 1 else [F.broadcast(contracts)]


def forbidden(lines: DataFrame, contracts: DataFrame) -> DataFrame:
    """The first line of each file under a contract's path that holds one of its patterns; contracts (contract, path, pattern)."""
    blocks = _blocks(contracts.select("contract", F.col("path").alias("prefix"), "pattern"))
    hits = union_all([lines.join(c, F.col("path").startswith(F.col("prefix")) & F.contains(F.col("line"), F.col("pattern"))) for c in blocks])
    first = hits.groupBy("contract", "pattern", F.col("path").alias("file")).agg(F.min("line_no").alias("line"))
    return finding(first, "contract-forbidden", "error", F.concat_ws(" ", F.lit("forbidden by"), "contract", F.lit(":"), "pattern"), F.col("file"), F.col("line"))


def anchors(lines: DataFrame, contracts: DataFrame) -> DataFrame:
    """Public types under a contract's path without an `impl` of its trait anywhere; contracts (contract, path, trait).

    The trait is matched as a prefix of the implemented name, the type by whole word.
    """
    blocks = _blocks(contracts.select("contract", F.col("path").alias("prefix"), "trait"))
    kinds = F.regexp_extract("line", r"^\s*(?:pub\s+)?(?:struct|enum)\s+([A-Za-z0-9_]+)", 1)
    named = lines.withColumn("type", kinds).where("type != ''")
    types = union_all([named.join(c, F.col("path").startswith(F.col("prefix"))) for c in blocks])
    impls = lines.select(F.regexp_extract("line", r"^\s*impl(?:<[^>]*>)?\s+([A-Za-z0-9_:]+)(?:<[^>]*>)?\s+for\s+([A-Za-z0-9_]+)", 1).alias("impl"), F.regexp_extract("line", r"\s+for\s+([A-Za-z0-9_]+)", 1).alias("type")).where("impl != ''")
    missing = types.join(impls.withColumnRenamed("type", "t"), (F.col("type") == F.col("t")) & F.col("impl").startswith(F.col("trait")), "left_anti")
    return finding(missing, "contract-anchor", "error", F.concat_ws(" ", "type", F.lit("lacks"), "trait"), F.col("path"), F.col("line_no"))


def sealed(lines: DataFrame, contracts: DataFrame) -> DataFrame:
    """Traits of contracts (contract, trait) by their implementations anywhere: fewer than two make a warning."""
    impls = lines.select(F.regexp_extract("line", r"^\s*impl(?:<[^>]*>)?\s+([A-Za-z0-9_:]+)", 1).alias("impl")).where("impl != ''")
    joined = contracts.select("contract", "trait").distinct().join(impls, F.col("impl").startswith(F.col("trait")), "left")
    few = joined.groupBy("contract", "trait").agg(F.count("impl").alias("n")).where("n < 2")
    return finding(few, "contract-seal", "warning", F.concat_ws(" ", "trait", F.lit("has implementations:"), F.col("n").cast("string")))


def definitions(lines: DataFrame) -> DataFrame:
    """(path, line_no, kind, name): structs, enums and traits defined, plainly public or not."""
    item = r"^\s*(?:pub\s+)?(struct|enum|trait)\s+([A-Za-z0-9_]+)"
    rows = lines.select("path", "line_no", F.regexp_extract("line", item, 1).alias("kind"), F.regexp_extract("line", item, 2).alias("name"))
    return rows.where("name != ''")


def implementations(lines: DataFrame) -> DataFrame:
    """(path, line_no, trait, type): `impl` headers; an inherent one has no trait. A trait is meant if the name begins with it."""
    head = r"^\s*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+([A-Za-z0-9_:]+)(?:<[^>]*>)?(?:\s+for\s+([A-Za-z0-9_:]+))?"
    rows = lines.select("path", "line_no", F.regexp_extract("line", head, 1).alias("a"), F.regexp_extract("line", head, 2).alias("b")).where("a != ''")
    return rows.select("path", "line_no", F.when(F.col("b") != "", F.col("a")).alias("trait"), F.when(F.col("b") != "", F.col("b")).otherwise(F.col("a")).alias("type"))


def test_start(lines: DataFrame) -> DataFrame:
    """(path, tests_at): the first line of each file's test region."""
    return lines.where(F.contains("line", F.lit("#[cfg(test)]"))).groupBy("path").agg(F.min("line_no").alias("tests_at"))


def undocumented(lines: DataFrame) -> DataFrame:
    """Public items at column 0, before the test region, whose nearest line above that isn't an attribute is no doc comment."""
    above = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    plain = F.when(~F.col("line").rlike(r"^\s*#!?\["), F.trim("line"))
    item = r"^pub (?:async )?(?:unsafe )?(fn|struct|enum|trait|type|const|static|mod)\s+([A-Za-z0-9_]+)"
    rows = lines.join(test_start(lines), "path", "left").withColumn("before", F.last(plain, ignorenulls=True).over(above))
    bare = rows.where(F.col("line").rlike(item) & (F.col("tests_at").isNull() | (F.col("line_no") < F.col("tests_at"))) & ~F.coalesce("before", F.lit("")).rlike(r"^(///|/\*\*|//!)"))
    return finding(bare, "undocumented", "note", F.concat_ws(" ", F.regexp_extract("line", item, 1), F.regexp_extract("line", item, 2)), F.col("path"), F.col("line_no"))


def unwired(lines: DataFrame) -> DataFrame:
    """Source files under `src` whose stem no `mod` declaration names."""
    declared = lines.select(F.regexp_extract("line", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+([A-Za-z0-9_]+)", 1).alias("stem")).where("stem != ''").distinct()
    files = lines.select("path").distinct().where(F.col("path").rlike(r"(^|/)src/.*\.rs$") & ~F.col("path").rlike(r"(^|/)(bin|examples|benches|tests)/"))
    files = files.withColumn("stem", F.regexp_extract("path", r"([^/]+)\.rs$", 1)).where(~F.col("stem").isin("lib", "main", "mod", "build"))
    return finding(files.join(declared, "stem", "left_anti"), "unwired", "warning", F.concat_ws(" ", F.lit("no declaration of"), "stem"), F.col("path"))


def exports(lines: DataFrame) -> DataFrame:
    """(py_name, kind, file, line) of items that an extension attribute exports, renamed by `name = "..."` where given."""
    arm = F.regexp_extract("line", r"^\s*#\[py(function|class|module)\b", 1)
    named = F.regexp_extract("line", r'name\s*=\s*"([^"]+)"', 1)
    item = F.regexp_extract("line", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:fn|struct|enum)\s+([A-Za-z0-9_]+)", 1)
    rows = lines.select("path", "line_no", F.when(arm != "", arm).alias("arm"), F.when(named != "", named).alias("named"), F.when(item != "", item).alias("item"))
    # an attribute holds until the next item takes it
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("items", F.coalesce(F.count("item").over(upto), F.lit(0)))
    group = Window.partitionBy("path", "items").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("kind", F.last("arm", ignorenulls=True).over(group)).withColumn("other", F.last("named", ignorenulls=True).over(group))
    return rows.where("item IS NOT NULL AND kind IS NOT NULL").select(F.coalesce("other", "item").alias("py_name"), "kind", F.col("path").alias("file"), F.col("line_no").alias("line"))


def imports(lines: DataFrame) -> DataFrame:
    """(module, names, file, line) of single-line imports; aliases and `*` are dropped."""
    frm, what = F.regexp_extract("line", r"^\s*from\s+([\w.]+)\s+import\s+(.+)$", 1), F.regexp_extract("line", r"^\s*from\s+([\w.]+)\s+import\s+(.+)$", 2)
    plain = F.regexp_extract("line", r"^\s*import\s+(.+)$", 1)
    clean = lambda c: F.filter(F.transform(F.split(F.regexp_replace(c, r"[()#].*", ""), ","), lambda x: F.trim(F.regexp_replace(x, r"\s+as\s+.*", ""))), lambda x: (x != "") & (x != "*"))
    a = lines.where(frm != "").select(frm.alias("module"), clean(what).alias("names"), F.col("path").alias("file"), F.col("line_no").alias("line"))
    b = lines.where(plain != "").select(F.explode(clean(plain)).alias("module"), F.array().cast("array<string>").alias("names"), F.col("path").alias("file"), F.col("line_no").alias("line"))
    return a.unionByName(b)


def ffi_edges(rust_lines: DataFrame, py_lines: DataFrame) -> DataFrame:
    """(module, rust_file, py_file, py_line, names): imports whose last segment is an exported module's name."""
    modules = exports(rust_lines).where("kind = 'module'").groupBy("py_name").agg(F.min("file").alias("rust_file"))
    used = imports(py_lines).withColumn("py_name", F.substring_index("module", ".", -1))
    return used.join(modules, "py_name").select("module", "rust_file", F.col("file").alias("py_file"), F.col("line").alias("py_line"), "names")


def export_counts(lines: DataFrame) -> DataFrame:
    """(kind, n): how many items each kind of attribute exports."""
    return exports(lines).groupBy("kind").agg(F.count("*").alias("n"))


def ffi_modules(edges: DataFrame) -> DataFrame:
    """(module, rust_file, importers, names): the edges of ffi_edges() by module."""
    return edges.groupBy("module", "rust_file").agg(F.count_distinct("py_file").alias("importers"), F.sum(F.size("names")).alias("names"))


def ordered(findings: DataFrame) -> DataFrame:
    """Findings in the order of a report: the worst first, then by rule, place and message."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return findings.orderBy(rank, "rule", "file", "line", "message")


def dead_symbols(symbols: DataFrame, refs: DataFrame, lines: DataFrame, kinds: list[int] | None = None) -> DataFrame:
    """(symbol, file, line) of symbols that no liveness root leads to, in `.rs` files, ahead of their test region."""
    from strandweave.operators.graph import reachable

    roots = public_roots(symbols, lines)
    live = reachable(refs, roots.select(F.col("symbol").alias("node")))
    dead = symbols.where(F.col("file").endswith(".rs")).join(live.withColumnRenamed("node", "symbol"), "symbol", "left_anti")
    if kinds:
        dead = dead.where(F.col("kind").isin(*kinds))
    rows = dead.withColumn("line", F.col("def.sl") + 1).join(test_start(lines).withColumnRenamed("path", "file"), "file", "left")
    return rows.where("tests_at IS NULL OR line < tests_at").select("symbol", "file", "line")


def public_roots(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """Symbols alive by themselves: implementations, `main`, public definitions, and those under a trait's `impl` header."""
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    header = F.when(F.col("line").rlike(r"^\s*(unsafe\s+)?impl\b"), F.col("line"))
    rows = lines.select(F.col("path").alias("file"), "line_no", "line", F.last(header, ignorenulls=True).over(upto).alias("impl"))
    at = symbols.withColumn("line_no", F.col("def.sl") + 1).join(rows, ["file", "line_no"], "left")
    alive = F.col("is_impl") | (F.col("display") == "main") | F.coalesce(F.ltrim("line"), F.lit("")).rlike(r"^pub[ (]") | F.coalesce(F.contains("impl", F.lit(" for ")), F.lit(False))
    return at.where(alive).select("symbol")


def findings_union(*parts: DataFrame) -> DataFrame:
    return union_all([p.select(*COLUMNS) for p in parts])
