"""Findings as text, JSON and SARIF."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS, GLYPHS = {"error": "error", "warning": "warning", "note": "note"}, {"error": "✗", "warning": "!", "note": "·"}


def rendered(findings: DataFrame) -> DataFrame:
    """(line): each finding as a line of text, built by the executors."""
    glyph = F.element_at(F.create_map(*[F.lit(x) for p in GLYPHS.items() for x in p]), F.col("severity"))
    spot = F.concat(F.coalesce("file", F.lit("")), F.when(F.col("line").isNotNull(), F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise(""))
    fix = F.when(F.col("fix").isNotNull(), F.concat(F.lit(" (fix: "), F.col("fix"), F.lit(")"))).otherwise("")
    return findings.select(F.concat(glyph, F.lit(" ["), "rule", F.lit("] "), spot, F.lit(" — "), "message", fix).alias("line"))


def to_json(findings: DataFrame) -> DataFrame:
    """(json): one object a finding; null fields are left out."""
    return findings.select(F.to_json(F.struct("rule", "severity", "message", F.struct("file", "line").alias("location"), "fix")).alias("json"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(json): one SARIF result a finding; lines start at 1 and a fix follows the message."""
    text = F.concat("message", F.when(F.col("fix").isNotNull(), F.concat(F.lit(" Fix: "), F.col("fix"))).otherwise(""))
    region = F.when(F.col("line").isNotNull(), F.struct(F.greatest(F.col("line"), F.lit(1)).alias("startLine")))
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    places = F.when(F.col("file").isNotNull(), F.array(place))
    level = F.element_at(F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p]), F.col("severity"))
    return findings.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), places.alias("locations"))).alias("json"))


def sarif(findings: DataFrame, version: str = "1") -> str:
    """The whole document, for a report's findings; they are few beside the data they come from, and it is written by the caller."""
    results = [json.loads(r["json"]) for r in sarif_results(findings).toLocalIterator()]
    rules = sorted({r["ruleId"] for r in results})
    driver = {"name": "strandweave", "version": version, "rules": [{"id": r} for r in rules]}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results}]})


def document(findings: DataFrame, version: str = "1") -> str:
    """A report's findings and their counts by severity as one JSON object, written by the caller."""
    counts = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    rows = [json.loads(r["json"]) for r in to_json(findings).toLocalIterator()]
    return json.dumps({"tool": "strandweave", "version": version, "counts": {k: counts.get(k, 0) for k in LEVELS}, "findings": rows}, ensure_ascii=False, separators=(",", ":"))


def has_errors(findings: DataFrame) -> bool:
    return not findings.where("severity = 'error'").isEmpty()
