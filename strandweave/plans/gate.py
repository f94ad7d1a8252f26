"""The whole check: findings of all rules, less what is allowed, waived or out of scope."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.extract import bodies
from strandweave.functions.text import lines_table
from strandweave.operators import blueprint, dups, rules
from strandweave.operators.graph import cycles, misplaced
from strandweave.operators.tree import check as tree_check
from strandweave.operators.tree import growth, layer_of, layer_violations, subtree
from strandweave.plans.workspace import Workspace

NEAR, CLONE_LINES = 0.85, 6


@dataclass
class Options:
    """What a repository's configuration says; each rule is off unless it is set."""

    most_children: int = 0
    most_depth: int = 0
    forbid_cycles: bool = False
    layering: bool = False
    placement: bool = False
    layers: list[str] = field(default_factory=list)
    allow: list[str] = field(default_factory=list)
    contracts: list[dict] = field(default_factory=list)
    baseline: dict | None = None

    @classmethod
    def of(cls, config: dict, baseline: dict | None = None) -> Options:
        """The options of a configuration; a rule that it doesn't know raises ValueError."""
        known = {"most_children", "most_depth", "forbid_cycles", "layering", "placement"}
        unknown = sorted(set(config["rules"]) - known)
        if unknown:
            raise ValueError(f"no rule {', '.join(unknown)}")
        return cls(**config["rules"], layers=list(config["layers"]), allow=list(config["allow"]), contracts=list(config["contracts"]), baseline=baseline)


def lean_findings(facts: DataFrame, texts: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Duplicates, near duplicates, clones and, with a graph, misplaced files as findings."""
    groups = dups.exact_dup_groups(facts)
    near = dups.near_dup_pairs(texts.select(F.col("path").alias("rel"), "subrepo", "text"), NEAR)
    clones = dups.clone_groups(bodies(texts), CLONE_LINES)
    parts = [
        rules.finding(groups, "lean-duplicate", "warning", F.concat_ws(" ", F.col("n").cast("string"), F.lit("equal files")), F.col("first")),
        rules.finding(near, "lean-near-duplicate", "note", F.concat_ws(" ", F.lit("much like"), "b"), F.col("a")),
        rules.finding(clones, "lean-clone", "warning", F.concat_ws(" ", F.col("sites").cast("string"), F.lit("equal bodies")), F.col("first.file"), F.col("first.line")),
    ]
    if edges is not None:
        m = misplaced(edges)
        parts.append(rules.finding(m, "lean-misplaced", "note", F.concat_ws(" ", F.lit("belongs in"), "suggested_dir"), F.col("file")))
    return rules.findings_union(*parts)


def structure_findings(nodes: DataFrame, edges: DataFrame, options: Options) -> DataFrame:
    """Growth, depth, cycles, layering and placement, each if the options ask for it; nodes have a facet `layer` for layering."""
    parts = [rules.finding(growth(nodes, options.most_children), "growth", "error", F.concat_ws(" ", F.col("n").cast("string"), F.lit("files in one place")), F.col("parent"))]
    if options.most_depth:
        top = subtree(nodes).where(F.col("parent").isNull() & (F.col("depth") > options.most_depth))
        parts.append(rules.finding(top, "abstraction-depth", "error", F.concat_ws(" ", F.lit("depth"), F.col("depth").cast("string")), F.col("id")))
    if options.forbid_cycles:
        parts.append(rules.finding(cycles(edges), "layer-cycle", "error", F.concat_ws(" ", F.lit("on a cycle with"), "component"), F.col("node")))
    if options.layering and options.layers:
        layers = nodes.sparkSession.createDataFrame(list(zip(options.layers, range(len(options.layers)))), "layer string, idx int")
        up = layer_violations(edges, layer_of(nodes, layers), layers)
        parts.append(rules.finding(up, "layer-order", "error", F.concat_ws(" ", "from_layer", F.lit("uses"), "to_layer", F.lit("in"), "dst"), F.col("src")))
    if options.placement:
        parts.append(rules.finding(misplaced(edges), "placement", "error", F.concat_ws(" ", F.lit("belongs in"), "suggested_dir"), F.col("file")))
    return rules.findings_union(*parts)


def invariant_findings(nodes: DataFrame, depends: DataFrame | None = None) -> DataFrame:
    """What is wrong with the tree as it stands; children are listed by their parents here."""
    spark = nodes.sparkSession
    depends = depends if depends is not None else spark.createDataFrame([], "id string, target string")
    children = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    bad = tree_check(nodes.select("id", "parent", "kind", "loc"), children, depends)
    return rules.finding(bad, "tree-invariant", "error", F.concat_ws(" ", "problem", "other"), F.col("id"))


def contract_findings(lines: DataFrame, contracts: list[dict]) -> DataFrame:
    """Forbidden patterns, missing implementations and unsealed traits of contracts {id, path, trait, forbid, seal}."""
    spark = lines.sparkSession
    forbid = [(c["id"], c.get("path", ""), p) for c in contracts for p in c.get("forbid", [])]
    anchor = [(c["id"], c.get("path", ""), c["trait"]) for c in contracts if c.get("trait") and c.get("path")]
    seal = [(c["id"], c["trait"]) for c in contracts if c.get("trait") and c.get("seal")]
    return rules.findings_union(
        rules.forbidden(lines, spark.createDataFrame(forbid, "contract string, path string, pattern string")),
        rules.anchors(lines, spark.createDataFrame(anchor, "contract string, path string, trait string")),
        rules.sealed(lines, spark.createDataFrame(seal, "contract string, trait string")),
    )


def lock_findings(w: Workspace) -> DataFrame:
    documents = w.blueprints()
    said = blueprint.lock_findings([(t, lock) for _, t, lock in documents], w.files.select("rel")) if documents else []
    return rules.finding(w.spark.createDataFrame([(s,) for s in said], "said string"), "blueprint-lock", "error", F.col("said"))


def check(findings: DataFrame, lines: DataFrame, options: Options, report: DataFrame | None = None, changed: DataFrame | None = None) -> dict[str, DataFrame]:
    """The last stages in order: ratchet, allow-list, waivers, scope; `kept`, `exempt` and `waived` findings."""
    if options.baseline is not None and report is not None:
        worse = dups.regressions(report, options.baseline)
        findings = rules.findings_union(findings, rules.finding(worse, "lean-regression", "error", F.concat_ws(" ", "metric", F.col("was").cast("string"), F.lit("->"), F.col("now").cast("string"))))
    kept, exempt = rules.partition_allowed(findings, options.allow)
    kept, waived = rules.waived(kept, lines)
    if changed is not None:
        kept = rules.scoped(kept, changed)
    return {"kept": kept, "exempt": exempt, "waived": waived}


def check_workspace(w: Workspace, changed: list[str] | None = None) -> dict[str, DataFrame]:
    """All stages over a repository by its configuration: invariants, ratchet where a baseline was saved, rules,
    contracts, blueprint locks, allow-list, waivers and, if `changed` lists files, scope."""
    options, lines = Options.of(w.config, w.baseline()), lines_table(w.texts)
    texts = w.texts.join(w.owned.select(F.col("rel").alias("path"), "subrepo"), "path")
    found = rules.findings_union(
        invariant_findings(w.nodes),
        structure_findings(w.nodes, w.edges, options),
        contract_findings(lines, options.contracts),
        rules.undocumented(lines),
        rules.unwired(lines),
        lock_findings(w),
        lean_findings(w.facts, texts, w.edges if w.graph else None),
    )
    scope = None if changed is None else w.spark.createDataFrame([(c,) for c in changed], "file string")
    return check(found, lines, options, w.lean() if options.baseline is not None else None, scope)
