"""Architecture documents as tables: validation, evolution, digests, locks and scaffolds.

A blueprint is a dict of DataFrames, each with blueprint_id:
meta (title, lifecycle, supersedes), slot (id, purpose, invariants array, allow_fusion), port (id, slot, direction,
type, permanent), flow (id, from, to, stateful), implementation (id, slots array, binding), adapter (id, from_port,
to_port, binding, witness), witness (id, kind, covers array, command).
"""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.text import union_all
from strandweave.operators.graph import cycles
from strandweave.runtime import cut

SCHEMAS = {
    "meta": "blueprint_id string, title string, lifecycle string, supersedes string",
    "slot": "blueprint_id string, id string, purpose string, invariants array<string>, allow_fusion boolean",
    "port": "blueprint_id string, id string, slot string, direction string, type string, permanent boolean",
    "flow": "blueprint_id string, id string, from string, to string, stateful boolean",
    "implementation": "blueprint_id string, id string, slots array<string>, binding string",
    "adapter": "blueprint_id string, id string, from_port string, to_port string, binding string, witness string",
    "witness": "blueprint_id string, id string, kind string, covers array<string>, command string",
}
Tables = dict[str, DataFrame]


def tables(spark: SparkSession, rows: dict[str, list[tuple]]) -> Tables:
    return {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}


def from_toml(spark: SparkSession, text: str) -> Tables:
    """The tables of one document; arrays of tables are named like the tables, and missing fields are null or empty."""
    doc = tomllib.loads(text)
    own, rows = doc["id"], {"meta": [(doc["id"], doc.get("title"), doc.get("lifecycle", "draft"), doc.get("supersedes"))]}
    blank = {"string": None, "array<string>": [], "boolean": False}
    for name, schema in SCHEMAS.items():
        if name != "meta":
            fields = [f.split(" ") for f in schema.split(", ")[1:]]
            rows[name] = [(own, *(r.get(f, blank[t]) for f, t in fields)) for r in doc.get(name, [])]
    return tables(spark, rows)


def to_rows(t: Tables) -> dict[str, list[tuple]]:
    return {name: [tuple(r) for r in t[name].collect()] for name in SCHEMAS}


def to_toml(t: Tables) -> str:
    """One document as TOML that from_toml() reads back; nulls and empty lists are left out."""
    from strandweave.sources.repo import to_toml as write

    meta = t["meta"].first().asDict()
    doc = {"id": meta["blueprint_id"], "title": meta["title"], "lifecycle": meta["lifecycle"], "supersedes": meta["supersedes"]}
    for name in SCHEMAS:
        if name != "meta":
            doc[name] = [{k: v for k, v in r.asDict().items() if k != "blueprint_id" and v not in (None, [])} for r in t[name].collect()]
    return write({k: v for k, v in doc.items() if v not in (None, [])})


def _say(df: DataFrame, problem: str, at: str = "id") -> DataFrame:
    return df.select("blueprint_id", F.lit(problem).alias("problem"), F.col(at).cast("string").alias("id"))


def _without(rows: DataFrame, column: str, targets: DataFrame) -> DataFrame:
    """Rows whose `column` names nothing in `targets` (blueprint_id, id)."""
    t = targets.select(F.col("blueprint_id").alias("_b"), F.col("id").alias("_t"))
    return rows.join(t, (F.col("blueprint_id") == F.col("_b")) & (F.col(column) == F.col("_t")), "left_anti")


def slot_edges(t: Tables, stateless_only: bool = False) -> DataFrame:
    """(blueprint_id, src, dst): flows lifted from ports to their slots."""
    f = t["flow"].where("NOT stateful") if stateless_only else t["flow"]
    p = t["port"].select("blueprint_id", "id", "slot")
    a = p.withColumnsRenamed({"id": "from", "slot": "src"})
    b = p.withColumnsRenamed({"id": "to", "slot": "dst"})
    return f.join(a, ["blueprint_id", "from"]).join(b, ["blueprint_id", "to"]).select("blueprint_id", "src", "dst")


def unmarked_cycles(t: Tables) -> DataFrame:
    """(blueprint_id, id): slots on a cycle of flows of which none is stateful; a flow back into its own slot is one."""
    return _cyclic(cut(slot_edges(t, True).distinct()))


def _cyclic(e: DataFrame) -> DataFrame:
    """(blueprint_id, id): the slots on a cycle of edges (blueprint_id, src, dst)."""
    name = lambda c: F.concat_ws("\x1f", "blueprint_id", c)
    loops = e.where("src = dst").select("blueprint_id", F.col("src").alias("id"))
    found = cycles(e.select(name("src").alias("src"), name("dst").alias("dst")))
    return loops.union(found.select(F.substring_index("node", "\x1f", 1), F.substring_index("node", "\x1f", -1))).distinct()


def _flow_findings(flow: DataFrame, port: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Problems of flows' ends, each once, and the edges (blueprint_id, src, dst) of stateless ones; a flow meets the ports twice, once an end."""
    rows, found = flow, []
    for end, want in (("from", "output"), ("to", "input")):
        p = port.select(F.col("blueprint_id").alias(f"_{end}"), F.col("id").alias(f"{end}_id"), F.col("slot").alias(f"{end}_slot"), F.col("direction").alias(f"{end}_way"))
        rows = rows.join(p, (F.col("blueprint_id") == F.col(f"_{end}")) & (F.col(end) == F.col(f"{end}_id")), "left")
        none = F.col(f"_{end}").isNull()
        found.append(F.when(none, f"flow {end} no port").when(F.col(f"{end}_way") != want, f"flow {end} a wrong way"))
    text, no = F.col("id").cast("string"), F.lit(None).cast("string")
    says = [F.struct(problem.alias("problem"), text.alias("id"), no.alias("src"), no.alias("dst")) for problem in found]
    edge = F.when(F.expr("NOT stateful AND _from IS NOT NULL AND _to IS NOT NULL"), "edge")
    says.append(F.struct(edge.alias("problem"), no.alias("id"), F.col("from_slot").alias("src"), F.col("to_slot").alias("dst")))
    out = cut(rows.select("blueprint_id", F.inline(F.filter(F.array(*says), lambda x: x["problem"].isNotNull()))).distinct())
    return out.where("problem != 'edge'").select("blueprint_id", "problem", "id"), out.where("problem = 'edge'").select("blueprint_id", "src", "dst")


def validate(t: Tables) -> DataFrame:
    """(blueprint_id, problem, id): every rule that a document breaks, each once."""
    t = {**t, "flow": cut(t["flow"])}  # read for its ids and for its ends
    slot, port, flow, impl, adapter, witness = (t[k] for k in ("slot", "port", "flow", "implementation", "adapter", "witness"))
    out = []
    for kind in ("slot", "port", "flow", "implementation", "adapter", "witness"):
        out.append(_say(t[kind].groupBy("blueprint_id", "id").count().where("count > 1"), f"duplicate {kind}"))
        out.append(_say(t[kind].where(F.trim(F.coalesce("id", F.lit(""))) == ""), f"blank {kind} id"))
    for kind in ("slot", "port"):
        out.append(_say(t[kind].where(~F.col("id").rlike(r"^[A-Za-z0-9._-]+$") & (F.trim("id") != "")), f"bad {kind} id"))
    out.append(_say(t["meta"].where(F.trim(F.coalesce("title", F.lit(""))) == ""), "blank title", "blueprint_id"))
    out.append(_say(_without(port, "slot", slot), "port of no slot"))
    pairs = impl.select("blueprint_id", "id", F.size("slots").alias("n"), F.explode("slots").alias("s"))
    out.append(_say(_without(pairs, "s", slot), "implementation of no slot"))
    out.append(_say(impl.where(F.trim(F.coalesce("binding", F.lit(""))) == ""), "implementation without binding"))
    free = slot.select("blueprint_id", F.col("id").alias("s"), "allow_fusion")
    out.append(_say(pairs.where("n > 1").join(free, ["blueprint_id", "s"]).where("NOT allow_fusion"), "fusion of a slot that forbids it"))
    proof = witness.where("kind = 'differential'").select(F.col("blueprint_id").alias("b"), "covers")
    fused = impl.where(F.size("slots") > 1)
    covered = (F.col("blueprint_id") == F.col("b")) & (F.size(F.array_except("slots", "covers")) == 0)
    out.append(_say(fused.join(proof, covered, "left_anti"), "fusion without a differential witness"))
    for end in ("from_port", "to_port"):
        out.append(_say(_without(adapter, end, port), f"adapter {end} is no port"))
    out.append(_say(_without(adapter, "witness", witness), "adapter without witness"))
    out.append(_say(adapter.where(F.trim(F.coalesce("binding", F.lit(""))) == ""), "adapter without binding"))
    starts = adapter.select(F.col("blueprint_id").alias("b"), F.col("from_port").alias("next"))
    out.append(_say(adapter.join(starts, (F.col("blueprint_id") == F.col("b")) & (F.col("to_port") == F.col("next")), "left_semi"), "adapter chain"))
    known = slot.select("blueprint_id", "id").union(port.select("blueprint_id", "id"))
    out.append(_say(_without(witness.select("blueprint_id", "id", F.explode("covers").alias("c")), "c", known), "witness of nothing"))
    ends, edges = _flow_findings(flow, port)
    out.append(_say(_cyclic(edges), "cycle without a stateful flow"))
    return union_all(out).distinct().unionByName(ends)


#: Characters of sorted rows that go into one piece of a document's text.
PIECE = 4096
_SHAPE = ("slot", "port", "flow")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (blueprint_id, kind, row, ord) as pieces of neighbours of one kind, each with the ord of its first row."""
    for batch in batches:
        ids, kinds, rows, ords = (c.to_pylist() for c in batch.columns)
        out, i = [], 0
        while i < len(rows):
            j, size = i, 0
            while j < len(rows) and size < PIECE and ids[j] == ids[i] and kinds[j] == kinds[i]:
                size += len(rows[j])
                j += 1
            out.append((ids[i], kinds[i], ords[i], ",".join(rows[i:j])))
            i = j
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.string()))], ["blueprint_id", "kind", "ord", "piece"])


class _Shape:
    """The hash of `{"slot":[...],"port":[...],"flow":[...]}`, whose rows come in order."""

    def __init__(self) -> None:
        self.hash, self.kind, self.any = hashlib.sha256(f'{{"{_SHAPE[0]}":['.encode()), 0, False

    def add(self, kind: int, piece: str) -> None:
        for k in range(self.kind + 1, kind + 1):
            self.hash.update(f'],"{_SHAPE[k]}":['.encode())
            self.kind, self.any = k, False
        self.hash.update(("," if self.any else "").encode() + piece.encode())
        self.any = True

    def end(self) -> str:
        tail = "".join(f'],"{k}":[' for k in _SHAPE[self.kind + 1 :])
        self.hash.update(f"{tail}]}}".encode())
        return "sha256:" + self.hash.hexdigest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blueprint_id, digest) from pieces sorted by document and ord."""
    own, shape, done = None, None, []
    for batch in batches:
        for i, kind, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if i != own:
                if shape is not None:
                    done.append((own, shape.end()))
                own, shape = i, _Shape()
            shape.add(kind, piece)
    if shape is not None:
        done.append((own, shape.end()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], ["blueprint_id", "digest"])


def shape_digests(t: Tables) -> DataFrame:
    """(blueprint_id, digest) over slots, ports and flows in order; prose, bindings, adapters and witnesses don't count.

    The rows of all documents are sorted by ranges. The text that is hashed is put together piece by piece and never
    lies in memory as a whole, so a document may be larger than a task; only its bytes pass through one.
    """
    c = F.col
    fields = {
        "slot": [c("id"), F.array_sort("invariants").alias("invariants"), c("allow_fusion")],
        "port": [c("id"), c("slot"), c("direction"), c("type"), c("permanent")],
        "flow": [c("id"), c("from"), c("to"), c("stateful")],
    }
    order = ["blueprint_id", "kind", "row"]
    rows = union_all([t[name].where("blueprint_id IS NOT NULL").select("blueprint_id", F.lit(k).alias("kind"), F.to_json(F.struct(*fields[name])).alias("row")) for k, name in enumerate(_SHAPE)])
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    quoted = F.to_json(F.array("row"))
    rows = rows.select("blueprint_id", "kind", F.substring(quoted, F.lit(2), F.length(quoted) - 2).alias("row"), F.monotonically_increasing_id().alias("ord"))
    pieces = rows.mapInArrow(_packed, "blueprint_id string, kind int, ord long, piece string")
    digests = pieces.repartition("blueprint_id").sortWithinPartitions("blueprint_id", "ord").mapInArrow(_hashed, "blueprint_id string, digest string")
    return t["meta"].select("blueprint_id").distinct().join(digests, "blueprint_id", "left").select("blueprint_id", F.coalesce("digest", F.lit(_Shape().end())).alias("digest"))


def shape_change(old: Tables, new: Tables) -> str:
    """`new-shape`, `implementation-only` or `none`; the order of implementations and adapters counts, witnesses don't."""
    shape = lambda t: [r["digest"] for r in shape_digests(t).collect()]
    inner = lambda t: [tuple(r) for k in ("implementation", "adapter") for r in t[k].drop("blueprint_id").collect()]
    return "new-shape" if shape(old) != shape(new) else "implementation-only" if inner(old) != inner(new) else "none"


def evolution(old: Tables, new: Tables) -> DataFrame:
    """(problem, id) that keep `new` from following `old`: identity, and its permanent ports, which must stay as they are and be covered."""
    a, b = old["meta"].select(F.col("blueprint_id").alias("was")), new["meta"].select(F.col("blueprint_id").alias("now"), "supersedes")
    both = a.crossJoin(b)  # one row each
    say = lambda df, problem, at: df.select(F.lit(problem).alias("problem"), F.col(at).alias("id"))
    fields = ["slot", "direction", "type", "permanent"]
    kept = old["port"].where("permanent").select("id", F.struct(*fields).alias("was"))
    joined = kept.join(new["port"].select("id", F.struct(*fields).alias("now")), "id", "left")
    cover = new["witness"].select(F.explode("covers").alias("id")).distinct()
    return union_all(
        [
            say(both.where("was = now"), "identity is not new", "now"),
            say(both.where(~F.col("supersedes").eqNullSafe(F.col("was"))), "does not name its predecessor", "now"),
            say(joined.where("now IS NULL"), "permanent port is missing", "id"),
            say(joined.where("now IS NOT NULL AND was != now"), "permanent port has changed", "id"),
            say(joined.where("now IS NOT NULL").join(cover, "id", "left_anti"), "permanent port without witness", "id"),
        ]
    ).distinct()


def lock(t: Tables, passed: set[str]) -> str:
    """The lock of a valid, locked document whose witnesses all passed, as JSON; raises ValueError otherwise."""
    meta = t["meta"].first()
    witnesses = sorted(r["id"] for r in t["witness"].collect())
    if meta["lifecycle"] != "locked" or not validate(t).isEmpty() or not set(witnesses) <= passed:
        raise ValueError("only a valid, locked blueprint whose witnesses passed can be locked")
    permanent = sorted(r["id"] for r in t["port"].where("permanent").collect())
    return json.dumps({"schema": 2, "id": meta["blueprint_id"], "digest": shape_digests(t).first()["digest"], "permanent": permanent, "witnesses": witnesses}, sort_keys=True)


def check_lock(t: Tables, text: str) -> list[str]:
    """What in the document no longer agrees with its lock."""
    was = json.loads(text)
    now = {
        "schema": 2,
        "id": t["meta"].first()["blueprint_id"],
        "digest": shape_digests(t).first()["digest"],
        "permanent": sorted(r["id"] for r in t["port"].where("permanent").collect()),
        "witnesses": sorted(r["id"] for r in t["witness"].collect()),
    }
    return [k for k in now if was.get(k) != now[k]]


def fact_rows(t: Tables) -> DataFrame:
    """(subject, predicate, object): membership, dependencies and realisation, as entities `<blueprint>#<kind>/<id>`."""
    name = lambda kind, c: F.concat(F.col("blueprint_id"), F.lit(f"#{kind}/"), F.col(c))
    row = lambda df, a, p, b: df.select(a.alias("subject"), F.lit(p).alias("predicate"), b.alias("object"))
    made = t["implementation"].select("blueprint_id", "id", F.explode("slots").alias("s"))
    return union_all(
        [
            row(t["slot"], name("slot", "id"), "member-of", F.col("blueprint_id")),
            row(t["port"], name("port", "id"), "member-of", name("slot", "slot")),
            row(slot_edges(t), name("slot", "dst"), "depends-on", name("slot", "src")),
            row(made, name("implementation", "id"), "realizes", name("slot", "s")),
        ]
    ).distinct()


_TEMPLATES = {
    "rust": ("{snake}.rs", "/// {purpose}\npub struct {pascal};\n\nimpl {pascal} {{\n{ports}}}\n", "    /// {direction}: {type}\n    pub fn {snake}(&self) {{\n        todo!()\n    }}\n"),
    "python": ("{snake}.py", '"""{purpose}"""\n\n\nclass {pascal}:\n{ports}', '    def {snake}(self):\n        """{direction}: {type}"""\n        raise NotImplementedError\n'),
    "c": ("{snake}.h", "/* {purpose} */\n#pragma once\n\n{ports}", "/* {direction}: {type} */\nvoid {snake}(void);\n"),
    "typescript": ("{snake}.ts", "/** {purpose} */\nexport interface {pascal} {{\n{ports}}}\n", "  /** {direction}: {type} */\n  {snake}(): unknown;\n"),
}


def _names(text: str) -> dict[str, str]:
    parts = [p for p in re.split(r"[^A-Za-z0-9]+", text) if p]
    return {"snake": "_".join(p.lower() for p in parts), "pascal": "".join(p[:1].upper() + p[1:] for p in parts)}


def scaffold(t: Tables, language: str) -> list[tuple[str, str]]:
    """(relative path, content) of a stub for each slot, in order of id; the caller decides what to write."""
    file, whole, part = _TEMPLATES[language]
    ports: dict[str, list] = {}
    for p in t["port"].orderBy("id").collect():
        ports.setdefault(p["slot"], []).append(p)
    out = []
    for s in t["slot"].orderBy("id").collect():
        body = "".join(part.format(direction=p["direction"], type=p["type"], **_names(p["id"])) for p in ports.get(s["id"], []))
        body = body or ("    pass\n" if language == "python" else "")
        out.append((file.format(**_names(s["id"])), whole.format(purpose=s["purpose"] or s["id"], ports=body, **_names(s["id"]))))
    return out


def binding_errors(t: Tables, files: DataFrame) -> DataFrame:
    """(id, problem) of bindings that aren't `<path>#<symbol>` with both parts, or whose path is none of `files` (rel)."""
    rows = t["implementation"].select("id", "binding").union(t["adapter"].select("id", "binding"))
    parts = rows.withColumn("path", F.trim(F.substring_index("binding", "#", 1))).withColumn("name", F.trim(F.regexp_extract("binding", "#(.*)$", 1)))
    shaped = (F.col("path") != "") & (F.col("name") != "")
    bad = parts.where(~F.coalesce(shaped, F.lit(False))).select("id", F.lit("not a path and a symbol").alias("problem"))
    lost = parts.where(shaped).join(files.select(F.col("rel").alias("path")), "path", "left_anti")
    return bad.unionByName(lost.select("id", F.lit("no such file").alias("problem")))


def run_witnesses(t: Tables, root: str, allowed: bool = False) -> dict[str, bool]:
    """Whether each witness's command succeeds under `root`. They are shell commands that the document's author
    wrote, so nothing runs unless the caller allows it; a blank command fails."""
    if not allowed:
        raise PermissionError("witness commands are not run unless allowed")
    out = {}
    for w in t["witness"].orderBy("id").collect():
        command = (w["command"] or "").strip()
        out[w["id"]] = bool(command) and subprocess.run(["sh", "-c", command], cwd=root, capture_output=True).returncode == 0
    return out


def lock_findings(documents: list[tuple[Tables, str | None]], files: DataFrame) -> list[str]:
    """Problems of blueprints with their locks: broken rules, lost bindings, drift from the lock, predecessors that aren't there."""
    ids = [t["meta"].first()["blueprint_id"] for t, _ in documents]
    by_id = dict(zip(ids, (t for t, _ in documents)))
    out = [f"{i}: identity is used twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    for i, (t, text) in zip(ids, documents):
        out += [f"{i}: {r['problem']} ({r['id']})" for r in validate(t).orderBy("problem", "id").collect()]
        out += [f"{i}: {r['problem']} ({r['id']})" for r in binding_errors(t, files).orderBy("id").collect()]
        meta = t["meta"].first()
        if meta["lifecycle"] == "locked":
            out += [f"{i}: no lock"] if text is None else [f"{i}: {k} differs from the lock" for k in check_lock(t, text)]
        before = meta["supersedes"]
        if before is not None:
            old = by_id.get(before)
            out += [f"{i}: predecessor {before} is missing"] if old is None else [f"{i}: {r['problem']} ({r['id']})" for r in evolution(old, t).orderBy("problem", "id").collect()]
    return out
