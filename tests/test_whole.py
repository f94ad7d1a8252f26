"""The queries over all rows against brute force on small tables."""

import math
import random
from collections import Counter, defaultdict

import pytest

from strandweave.operators import graph
from strandweave.operators import tree as trees
from strandweave.plans import catalog, views


def rows(spark, name, folder):
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, folder).collect())


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """(folder, edges): sparse orders of parts in any quantity, with cycles through lines of small ones."""
    rng, folder = random.Random(3), str(tmp_path_factory.mktemp("parts"))
    brand = {p: f"Brand#{rng.randint(1, 5)}{rng.randint(1, 5)}" for p in range(90)}
    lines = [(o, k + 1, p, float(rng.randint(1, 50))) for o in range(56) for k, p in enumerate(rng.choices(range(90), k=3))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(list(brand.items()), "p_partkey long, p_brand string").write.parquet(f"{folder}/part.parquet")
    at = {(o, k): f"{brand[p]}/{p}" for o, k, p, _ in lines}
    return folder, {(a, at[o, k + 1]) for (o, k), a in at.items() if (o, k + 1) in at and a != at[o, k + 1]}


def reach(edges, starts):
    to, seen, todo = defaultdict(set), set(starts), list(starts)
    for a, b in edges:
        to[a].add(b)
    while todo:
        new = to[todo.pop()] - seen
        seen |= new
        todo += new
    return seen


def test_graphs_over_all_edges(spark, parts):
    folder, edges = parts
    nodes, home = {n for e in edges for n in e}, lambda n: n.split("/")[0]
    assert rows(spark, "graph_merge", folder) == sorted(edges | {(b, a) for a, b in edges})
    assert rows(spark, "index_stats", folder) == [(len(edges), len({a for a, _ in edges}), len({b for _, b in edges}))]
    live = reach(edges, {a for a, _ in edges if a.startswith("Brand#1")})
    assert rows(spark, "reachable_set", folder) == sorted((n,) for n in live)
    entry = spark.createDataFrame([(a,) for a, _ in edges if a.startswith("Brand#1")], "node string")
    table = spark.createDataFrame(sorted(edges), "src string, dst string")
    assert sorted(r.node for r in graph.dead(table, entry).collect()) == sorted(nodes - live) != []
    far = {n: reach(edges, {n}) for n in nodes}
    loops = {n: min(m for m in far[n] if n in far[m]) for n in nodes if any(m != n and n in far[m] for m in far[n])}
    assert rows(spark, "dependency_cycles", folder) == sorted(loops.items()) and max(Counter(loops.values()).values()) > 2
    into = Counter(b for _, b in edges)
    assert catalog.QUERIES["fan_in_top"](spark, folder).count() == 8
    assert rows(spark, "fan_in_top", folder) == sorted(sorted(into.items(), key=lambda x: (-x[1], x[0]))[:8])
    level = lambda n: 0 if n < "Brand#23" else 1 if n < "Brand#4" else 2 if n < "Brand#53" else None
    up = [(a, b, ("low", "mid", "high")[level(a)], ("low", "mid", "high")[level(b)]) for a, b in edges if None not in (level(a), level(b)) and level(b) > level(a)]
    assert rows(spark, "layer_violations", folder) == sorted(up)
    users = defaultdict(list)
    for a, b in edges:
        users[b].append(home(a))
    assert sorted(map(tuple, graph.misplaced(table).collect())) == sorted((b, home(b), d[0], len(d)) for b, d in users.items() if len(set(d)) == 1 and d[0] != home(b))
    near = defaultdict(Counter)
    for a, b in edges:
        near[a][home(b)] += 1
        near[b][home(a)] += 1
    ranked = [(f, d, n, k + 1) for f, c in near.items() for k, (d, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0])))]
    assert rows(spark, "placement_rank", folder) == sorted(ranked)


def test_trees_with_orders_and_lines(spark, tmp_path):
    rng, keep = random.Random(6), lambda name, rows, kind: spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    nations, customers = [(n, n % 2) for n in range(5)], [(c, c % 5) for c in range(12)]
    orders = [(o, rng.randint(0, 9)) for o in range(30)]
    lines = [(o, k + 1, float(rng.randint(1, 50))) for o in range(27) for k in range(rng.randint(1, 8))]
    keep("region", [(0,), (1,)], "r_regionkey int")
    keep("nation", nations, "n_nationkey int, n_regionkey int")
    keep("customer", customers, "c_custkey long, c_nationkey int")
    keep("orders", orders, "o_orderkey long, o_custkey long")
    keep("lineitem", lines, "l_orderkey long, l_linenumber int, l_quantity double")
    up = {"root": None, "r0": "root", "r1": "root"} | {f"n{n}": f"r{r}" for n, r in nations} | {f"c{c}": f"n{n}" for c, n in customers}
    up |= {f"o{o}": f"c{c}" for o, c in orders} | {f"o{o}/{k}": f"o{o}" for o, k, _ in lines}
    size, kids = {f"o{o}/{k}": int(q) for o, k, q in lines}, defaultdict(list)
    for i, p in up.items():
        kids[p].append(i)

    def fold(i):
        if i in size:
            return 1, size[i], 1, float(size[i])
        below = [fold(k) for k in kids[i]]
        return sum(b[0] for b in below), sum(b[1] for b in below), 1 + max((b[2] for b in below), default=0), sum(b[3] for b in below) * (1 + math.log(max(1, len(below))) / 10)

    want, folder = {i: fold(i) for i in up}, str(tmp_path)
    assert rows(spark, "tree_file_counts", folder) == sorted((i, w[0], w[1]) for i, w in want.items())
    assert rows(spark, "tree_depth", folder) == sorted((i, w[2]) for i, w in want.items())
    scores = {r.id: r.score for r in trees.subtree(views.tree(spark, folder)).collect()}
    assert scores.keys() == want.keys() and all(abs(scores[i] - w[3]) < 1e-9 for i, w in want.items())
    top = sorted(want, key=lambda i: (-want[i][3], i))[:15]
    assert [i for i, _ in sorted(rows(spark, "tree_complexity_top", folder), key=lambda r: (-r[1], r[0]))] == top
    left, listed = set(up) - {"n3", "o1"}, {i: p for i, p in up.items() if p and not (i[0] in "co" and i.endswith("7"))}
    bad = [("parent missing", i, up[i]) for i in left if up[i] and up[i] not in left]
    bad += [("not listed by parent", i, up[i]) for i in left if up[i] in left and i not in listed]
    bad += [("names another parent", i, p) for i, p in listed.items() if i not in left] + [("dependency missing", "r0", "r99")]
    assert rows(spark, "tree_invariants", folder) == sorted(bad)


def test_sections_of_odd_pages_are_homes(spark, tmp_path):
    pages = [(1, "http://a.b/odd/x/y"), (2, "http://a.b/even/x"), (3, "http://a.b/top"), (5, "ftp://a.b/odd/x")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    want = {pages[0][1]: "http://a.b/odd", pages[1][1]: "http://a.b/even", pages[2][1]: "http://a.b", pages[3][1]: ""}
    assert rows(spark, "nearest_ancestor", str(tmp_path)) == sorted(want.items())
