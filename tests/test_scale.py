"""What keeps queries within memory and time on large tables, and their results on odd rows."""

import contextlib
import hashlib
import io
import json
import math
import random

from pyspark.sql import functions as F

from strandweave.operators import blueprint
from strandweave.operators import tree as trees


def planned(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain("simple")
    return out.getvalue()


def kept(monkeypatch, module):
    """The tables that `module` keeps in the shared folder from now on."""
    out, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: out.append(cut(df)) or out[-1])
    return out


def test_digests_gather_no_document(spark):
    rng = random.Random(4)
    rows = {"meta": [(b, b, "draft", None) for b in ("a", "b", "c", "d")], "slot": [("a", f's"{i}', "x", ["v", 'u"é'], i % 2 == 0) for i in range(40)], "port": [("b", "p", "s", None, "t", True)]}
    rows["flow"] = [(rng.choice("acx"), f"f{i}\\", f"p{i % 7}", "q" * (i % 90), i % 3 == 0) for i in range(900)]
    t = blueprint.tables(spark, {k: v[:] for k, v in rows.items()})
    names = {"slot": ["id", "invariants", "allow_fusion"], "port": ["id", "slot", "direction", "type", "permanent"], "flow": ["id", "from", "to", "stateful"]}
    pick = {"slot": lambda r: (r[1], sorted(r[3]), r[4]), "port": lambda r: r[1:], "flow": lambda r: r[1:]}
    dump = lambda x: json.dumps(x, separators=(",", ":"), ensure_ascii=False)
    own = lambda b, k: sorted(dump({n: v for n, v in zip(names[k], pick[k](r)) if v is not None}) for r in rows[k] if r[0] == b)
    want = {b: "sha256:" + hashlib.sha256(dump({k: own(b, k) for k in names}).encode()).hexdigest() for b in "abcd"}
    out = blueprint.shape_digests(t)
    assert {r.blueprint_id: r.digest for r in out.collect()} == want
    assert "collect_list" not in planned(out)


def test_fold_keeps_leaves_out_of_its_rounds(spark, monkeypatch):
    rng = random.Random(8)
    rows = [("root", None, "composite", None), ("other", None, "atom", 4), ("x", "y", "composite", None), ("y", "x", "composite", None), ("x1", "x", "atom", 5), ("lost", "nowhere", "composite", None), ("l1", "lost", "atom", 3), ("l2", "nowhere", "atom", 3)]
    rows += [("odd", "root", "atom", 7), ("o1", "odd", "atom", 2), ("o2", "odd", "composite", None), ("o3", "o2", "atom", 1), ("none", "root", "composite", None)]
    rows += [(f"d{i}", f"d{i - 1}" if i else "root", "composite", None) for i in range(5)] + [(f"a{i}", f"d{rng.randint(0, 4)}", "atom", rng.choice([None, i])) for i in range(600)]
    up, kids = {r[0]: r for r in rows}, {}
    for r in rows:
        kids.setdefault(r[1], []).append(r[0])

    def fold(i):
        below = [fold(k) for k in kids.get(i, [])]
        want.update(dict(zip(kids.get(i, []), below)))
        if up[i][2] == "atom":
            return 1, up[i][3] or 0, 1, float(up[i][3] or 0)
        return sum(b[0] for b in below), sum(b[1] for b in below), 1 + max((b[2] for b in below), default=0), sum(b[3] for b in below) * (1 + math.log(max(1, len(below))) / 10)

    want = {}
    want.update({i: fold(i) for i in ("root", "other")})
    cuts = kept(monkeypatch, trees)
    got = {r.id: r for r in trees.subtree(spark.createDataFrame(rows, "id string, parent string, kind string, loc long")).collect()}
    assert got.keys() == want.keys() and all((got[i].files, got[i].loc, got[i].depth) == w[:3] and abs(got[i].score - w[3]) < 1e-9 for i, w in want.items())
    assert sum(c.count() for c in cuts) < 200


def test_invariants_meet_nodes_twice(spark):
    rng = random.Random(5)
    rows = [("root", None)] + [(f"n{i}", rng.choice(["root", "gone", f"n{i // 3}"])) for i in range(1, 200)] + [("n5", "n1"), ("n5", "n1")]
    listed = [(p, i) for i, p in rows[1:] if rng.random() < 0.9] + [("n1", "n9"), ("n1", "n9"), (None, "n4"), ("n2", None)]
    depends = [("n1", "n2"), ("n1", "nothing"), ("n3", None)]
    ids, links = {i for i, _ in rows}, [(p, i) for i, p in rows if p]
    want = [("parent missing", i, p) for p, i in links if p not in ids] + [("not listed by parent", i, p) for p, i in links if p in ids and (p, i) not in listed]
    want += [("names another parent", i, p) for p, i in listed if (p, i) not in links] + [("dependency missing", i, t) for i, t in depends if t not in ids]
    nodes = spark.createDataFrame(rows, "id string, parent string")
    out = trees.invariants(nodes, spark.createDataFrame(listed, "id string, child string"), spark.createDataFrame(depends, "id string, target string"))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert planned(out).count("Exchange hashpartitioning") == 0


def test_lines_meet_by_number_before_they_are_named(spark, tmp_path):
    from strandweave.plans import views

    lines = [(1, 1, 5), (1, 2, 6), (1, 2, 6), (1, 3, 5), (1, 4, None), (2, 1, 5), (2, 2, 6), (2, 3, 7), (3, 1, 9), (3, 2, 5), (4, 1, 5), (4, 2, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(5, "x"), (6, None), (6, "y"), (7, "z"), (7, "z")], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    out = views.part_edges(spark, str(tmp_path))
    want = [(a, b) for a, b in (("x/5", "6"), ("x/5", "y/6"), ("6", "x/5"), ("y/6", "x/5"), ("6", "z/7"), ("y/6", "z/7"))]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert "hashpartitioning(src" not in planned(out)


def test_digest_makes_its_payloads_once(spark, monkeypatch):
    from strandweave.plans import facts

    rows = facts.fact(spark.range(9), F.col("id"), "depends-on", F.lit("x"))
    cuts = kept(monkeypatch, facts)
    assert facts.digest(rows) == facts.digest(rows.union(rows)) and [c.count() for c in cuts] == [9, 9]


def test_cycles_contract_many_components_at_once(spark, monkeypatch):
    from strandweave.operators import graph

    rng, pairs = random.Random(11), set()
    for c in range(8):
        pairs |= {(100 * c + rng.randrange(60), 100 * c + rng.randrange(60)) for _ in range(300)} | {(100 * c + 70 + i, 100 * c + 70 + (i + 1) % 5) for i in range(4 + c % 2)}
    pairs |= {(100 * c + rng.randrange(80), 100 * (c + 1) + rng.randrange(80)) for c in range(7)} | {(5, 5)}
    table = spark.createDataFrame(sorted(pairs), "src long, dst long")
    want = {r.node: r.component for r in graph.cycles(table).collect()}  # few edges: in one place
    to, far = {}, {}
    for a, b in pairs:
        to.setdefault(a, set()).add(b)
    for a in to:
        seen, todo = set(), [a]
        while todo:
            new = to.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        far[a] = seen
    assert want == {a: min(b for b in far[a] if a in far.get(b, ())) for a in far if any(b != a and a in far.get(b, ()) for b in far[a])}
    # of many edges, what is left once seeds have claimed their nodes
    walked, left = graph._walked, []
    monkeypatch.setattr(graph, "SMALL", len(pairs) // 2)
    monkeypatch.setattr(graph, "ONE_IN", 8)
    monkeypatch.setattr(graph, "_walked", lambda edges: left.append(edges.count()) or walked(edges))
    assert {r.node: r.component for r in graph.cycles(table).collect()} == want and left
    # and all by colour
    monkeypatch.setattr(graph, "SMALL", 0)
    monkeypatch.setattr(graph, "ONE_IN", 10**6)
    assert {r.node: r.component for r in graph.cycles(table.where("src < 300")).collect()} == {n: c for n, c in want.items() if n < 300}


def test_cycles_of_keys_with_several_names(spark):
    from strandweave.operators import graph

    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3), (4, 4), (5, 1)], "src long, dst long")
    names = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (3, "x"), (3, "y"), (4, "z"), (5, "q")], "key long, node string")
    assert {r.node: r.component for r in graph.cycles(edges, names).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_references_look_into_few_blocks(spark):
    from strandweave.operators import graph

    rng, top = random.Random(2), 2**63 - 1
    even = spark.createDataFrame([(10 * i, 10 * i + 9) for i in range(500)], "start long, end long")
    blocks = graph._in_blocks(even, lambda c: c)
    assert blocks.select("_k").distinct().count() == 1 and blocks.count() <= 1000
    spans = [(a, a + rng.choice([0, 1, 2, 3, 8, 40, 200])) for a in (rng.randint(-300, 300) for _ in range(120))]
    spans += [(-top - 1, top), (-top, 5), (0, top), (top - 1, top), (7, 6), (None, 4), (4, None)]
    held = [("f", f"o{k}", a, b, k) for k, (a, b) in enumerate(spans)]
    refs = [("f", f"r{k}", at) for k, at in enumerate([*range(-320, 520, 3), top, -top, -top - 1, None])] + [("g", "r", 0)]
    out = graph.innermost(spark.createDataFrame(refs, "file string, ref string, at long"), spark.createDataFrame(held, "file string, owner string, start long, end long, ord long"), [(F.col("end").cast("decimal(38,0)") - F.col("start")).alias("w")], lambda c: c)
    want = {}
    for f, r, at in refs:
        around = [(b - a, k, o) for g, o, a, b, k in held if g == f and None not in (a, b, at) and a <= at <= b]
        want |= {r: min(around)[2]} if around else {}
    assert {r.ref: r.owner for r in out.collect()} == want


def test_validation_makes_flows_once(spark, monkeypatch):
    ports = [("b", "o1", "s", "output"), ("b", "o1", "t", "input"), ("b", "i1", "t", "input"), ("b", "i2", "s", "input"), ("c", "o1", "s", None), ("b", "o2", "t", "output")]
    flows = [("b", "f1", "o1", "i1", False), ("b", "f2", "o2", "i2", False), ("b", "f3", "i1", "o2", True), ("b", "f4", None, "zz", False), ("c", "f5", "o1", "o1", None), (None, "f6", "o1", "i1", False), ("b", "f4", "o1", "i2", True), ("b", " ", "o2", "i1", True)]
    rows = {"meta": [("b", "b", "draft", None), ("c", "c", "draft", None)], "slot": [("b", s, "x", [], True) for s in "st"] + [("c", "s", "x", [], True)], "port": [(b, p, s, way, "t", True) for b, p, s, way in ports]}
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: made.add(1) or x, "boolean").asNondeterministic()
    t = blueprint.tables(spark, rows)
    t["flow"] = spark.createDataFrame(flows, blueprint.SCHEMAS["flow"]).withColumn("stateful", seen("stateful"))
    got = sorted(map(tuple, blueprint.validate(t).collect()), key=repr)
    want = [("b", "duplicate port", "o1"), ("b", "duplicate flow", "f4"), ("b", "blank flow id", " "), ("b", "flow from no port", "f4"), (None, "flow from no port", "f6"), (None, "flow to no port", "f6"), ("b", "flow to no port", "f4")]
    want += [("b", "flow from a wrong way", f) for f in ("f1", "f3", "f4")] + [("b", "flow to a wrong way", "f3")]
    want += [("b", "cycle without a stateful flow", s) for s in "st"]
    assert got == sorted(want, key=repr) and made.value == len(flows)
