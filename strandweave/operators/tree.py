"""Folds and checks over a containment tree: nodes (id, parent, kind, loc)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.text import ancestors_of, union_all
from strandweave.runtime import cut


#: Rows of a counted side up to which it is broadcast.
FEW = 10_000


def closure(nodes: DataFrame) -> DataFrame:
    """(node, ancestor, distance), each node its own ancestor at 0; one join a level.

    Raises ValueError if the relation has a cycle: then some node comes back to itself, however long the cycle is.
    """
    nodes = cut(nodes.select("id", "parent"))
    parents = nodes.select(F.col("id").alias("child"), F.col("parent").alias("up")).where("up IS NOT NULL")
    front = nodes.select(F.col("id").alias("node"), F.col("id").alias("ancestor"))
    levels = [front.withColumn("distance", F.lit(0))]
    while True:
        front = cut(front.join(parents, front["ancestor"] == parents["child"]).select("node", F.col("up").alias("ancestor")))
        if front.isEmpty():
            return union_all(levels)
        if not front.where("node = ancestor").isEmpty():
            raise ValueError("the containment relation has a cycle")
        levels.append(front.withColumn("distance", F.lit(len(levels))))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The nodes under the root by level, each level in the shared folder with the columns of `nodes`.

    Every level reads all nodes, so what makes them is computed once and they lie by parent from then on: only
    the level above is shuffled to meet them.
    """
    nodes = cut(nodes.repartition("parent"))
    out = [cut(nodes.where("parent IS NULL"))]
    while True:
        up = out[-1].select(F.col("id").alias("up"))
        level = cut(nodes.join(up, nodes["parent"] == up["up"]).drop("up"))
        if level.isEmpty():
            return out
        out.append(level)


def levels_down(nodes: DataFrame) -> DataFrame:
    """The nodes under the root with their level."""
    # the level is added after each cut: Spark 4.1 fails to carry a checkpoint's own constraints through a union
    return union_all([rows.withColumn("level", F.lit(k)) for k, rows in enumerate(levels(nodes))])


def subtree(nodes: DataFrame) -> DataFrame:
    """(id, parent, kind, files, loc, depth, score): all folds of the nodes under the root, from the leaves up.

    An atom has its own lines as score; a composite the sum over its children times 1 + ln(children)/10. An empty
    composite has depth 1. Atoms without children, most of a tree, are summed into their parents at once. Of the other
    nodes a round takes those that have no child left, and adds them to their parents. So each round reads only what
    the rounds before have left, where a walk over levels would read all nodes for each. What hangs below a missing
    parent or on a cycle is found from there down, and costs nothing where there is none.
    """
    nodes = nodes.select("id", "parent", "kind", "loc")
    is_atom = F.coalesce(F.col("kind") == "atom", F.lit(False))
    own_loc = F.coalesce("loc", F.lit(0))
    sums = ["f", "l", "d", "n", "s"]

    def first(inner: DataFrame, leaves: DataFrame) -> DataFrame:
        """`inner` with what its leaves sum up to and the number of its inner children; a missing parent is a row without id."""
        rows = leaves.select("parent", own_loc.alias("loc"), F.lit(True).alias("leaf")).unionByName(inner.select("parent", F.lit(0).cast("long").alias("loc"), F.lit(False).alias("leaf")))
        each = rows.where("parent IS NOT NULL").groupBy(F.col("parent").alias("up")).agg(F.count_if(~F.col("leaf")).alias("kids"), F.count_if("leaf").alias("f"), F.sum("loc").alias("l"), F.sum(F.col("loc").cast("double")).alias("s"))
        joined = inner.join(each.withColumn("d", F.when(F.col("f") > 0, 1).otherwise(0).cast("long")).withColumn("n", F.col("f")), F.col("id") == F.col("up"), "full_outer")
        return cut(joined.na.fill(0, ["kids", *sums]))

    def tally(rows: DataFrame) -> tuple[int, int, int]:
        here = F.col("id").isNotNull()
        return tuple(rows.agg(F.count_if(~here), F.count_if(here & (F.col("kids") == 0)), F.count_if(here & (F.col("kids") > 0))).first())

    def valued(rows: DataFrame) -> DataFrame:
        return rows.where("id IS NOT NULL AND kids = 0").select(
            "id",
            "parent",
            "kind",
            F.when(is_atom, 1).otherwise(F.col("f")).cast("long").alias("files"),
            F.when(is_atom, own_loc).otherwise(F.col("l")).cast("long").alias("loc"),
            F.when(is_atom, 1).otherwise(F.col("d") + 1).cast("long").alias("depth"),
            F.when(is_atom, own_loc.cast("double")).otherwise(F.col("s") * (1 + F.log(F.greatest("n", F.lit(1))) / 10)).alias("score"),
        )

    inner, leaves = nodes.where(~is_atom), nodes.where(is_atom)
    rows = first(inner, leaves)
    missing, ready, left = tally(rows)
    if missing:
        # parents that are no composites: atoms with children, or nothing
        odd = cut(rows.where("id IS NULL").select("up"))
        more = cut(leaves.join(odd, F.col("id") == F.col("up"), "left_semi"))
        if not more.isEmpty():
            inner, leaves = inner.unionByName(more.withColumn("loc", F.col("loc") + 0)), leaves.join(odd, F.col("id") == F.col("up"), "left_anti")
            rows = first(inner, leaves)
            missing, ready, left = tally(rows)
    gone = [rows.where("id IS NULL").select("up")] if missing else []
    done: list[DataFrame] = []
    while ready:
        done.append(valued(rows))
        if not left:
            break
        below = done[-1].where("parent IS NOT NULL").groupBy(F.col("parent").alias("_up"))
        below = below.agg(F.sum("files").alias("_f"), F.sum("loc").alias("_l"), F.max("depth").alias("_d"), F.count("*").alias("_n"), F.sum("score").alias("_s"))
        joined = rows.where("id IS NOT NULL AND kids > 0").join(below, F.col("id") == F.col("_up"), "left").na.fill(0, [f"_{c}" for c in sums])
        added = [(F.greatest(c, f"_{c}") if c == "d" else F.col(c) + F.col(f"_{c}")).alias(c) for c in sums]
        rows = cut(joined.select("id", "parent", "kind", "loc", (F.col("kids") - F.col("_n")).alias("kids"), *added))
        _, ready, left = tally(rows)
    if left:
        gone.append(rows.where("id IS NOT NULL AND kids > 0").select(F.col("id").alias("up")))
    # aliased anew: Spark 4.1 fails to carry a checkpoint's own constraints through a union
    fresh = lambda df, *c: df.select(*[F.concat(F.col(x), F.lit("")).alias(x) for x in c])
    if gone:
        lost = union_all([fresh(g, "up") for g in gone])
        for k in reversed(range(len(done))):
            dead = cut(done[k].join(lost, F.col("parent") == F.col("up"), "left_semi").select(F.col("id").alias("up")))
            done[k] = done[k].join(lost, F.col("parent") == F.col("up"), "left_anti")
            lost = lost.unionByName(fresh(dead, "up"))
        leaves = leaves.join(lost, F.col("parent") == F.col("up"), "left_anti")
    one = F.lit(1).cast("long")
    done.append(leaves.select("id", "parent", "kind", one.alias("files"), own_loc.alias("loc"), one.alias("depth"), own_loc.cast("double").alias("score")))
    return union_all([d.withColumns({c: F.concat(F.col(c), F.lit("")) for c in ("id", "parent", "kind")}) for d in done])


def growth(nodes: DataFrame, most: int) -> DataFrame:
    """(parent, n): composites with more than `most` atoms right below; 0 switches the rule off."""
    return nodes.where("kind = 'atom'").groupBy("parent").agg(F.count("*").alias("n")).where((F.col("n") > most) & F.lit(most > 0))


def invariants(nodes: DataFrame, children: DataFrame, depends: DataFrame) -> DataFrame:
    """(problem, id, other) for nodes, listed children (id, child) and dependencies (id, target) that don't fit together.

    Two shuffles of all nodes: by name, for the parents that aren't there, and by link, for the lists.
    """
    say = lambda df, problem, a, b: df.select(F.lit(problem).alias("problem"), F.col(a).alias("id"), F.col(b).alias("other"))
    ids = nodes.select(F.col("id").alias("known"))
    links = nodes.where("parent IS NOT NULL").select("id", "parent")
    listed = children.select(F.col("id").alias("parent"), F.col("child").alias("id"))
    named = links.select(F.col("parent").alias("up")).union(depends.select("target")).distinct()
    none = cut(named.join(ids, F.col("up") == F.col("known"), "left_anti").select("up", F.lit(True).alias("gone")))
    few = none.limit(FEW + 1).count() <= FEW
    none = F.broadcast(none) if few else none
    # each link meets its list once; only what doesn't fit goes on
    both = links.withColumn("by", F.lit(True)).unionByName(listed.withColumn("by", F.lit(False))).repartition("parent", "id")
    pairs = both.groupBy("parent", "id").agg(F.count_if("by").alias("links"), F.count_if(~F.col("by")).alias("listed"))
    null = F.col("parent").isNull() | F.col("id").isNull()
    flagged = pairs.join(none, F.col("parent") == F.col("up"), "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    odd = cut(flagged.select("parent", "id", "links", "listed", "gone", null.alias("blank")).where("gone OR blank OR links = 0 OR listed = 0"))
    times = lambda where, n: odd.where(where).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col(n))))
    return union_all(
        [
            say(times("gone AND links > 0", "links"), "parent missing", "id", "parent"),
            say(times("NOT gone AND links > 0 AND (blank OR listed = 0)", "links"), "not listed by parent", "id", "parent"),
            say(times("listed > 0 AND (blank OR links = 0)", "listed"), "names another parent", "id", "parent"),
            say(depends.where("target IS NULL").union(depends.join(none, F.col("target") == F.col("up"), "left_semi")), "dependency missing", "id", "target"),
        ]
    )


def check(nodes: DataFrame, children: DataFrame, depends: DataFrame) -> DataFrame:
    """(problem, id, other): what invariants() finds, nodes with two homes, nodes that the root doesn't reach, and dependency cycles."""
    ids = nodes.select("id").distinct()
    homes = children.groupBy(F.col("child").alias("id")).agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b")
    twice = nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    live = levels_down(nodes).select(F.col("id").alias("_live"))
    lost = ids.join(live, F.col("id") == F.col("_live"), "left_anti").join(nodes.select("id", "parent"), "id")
    from strandweave.operators.graph import cycles

    found = cycles(depends.where("id != target").select(F.col("id").alias("src"), F.col("target").alias("dst")))
    say = lambda df, problem, a, b: df.select(F.lit(problem).alias("problem"), F.col(a).alias("id"), F.col(b).alias("other"))
    roots = nodes.where("parent IS NULL").agg(F.count("*").alias("n")).where("n != 1")
    return union_all(
        [
            invariants(nodes, children, depends),
            say(homes, "two homes", "id", "b"),
            say(twice, "named twice", "id", "id"),
            say(lost, "not below a root", "id", "parent"),
            say(depends.where("id = target"), "depends on itself", "id", "target"),
            say(found, "dependency cycle", "node", "component"),
            roots.select(F.lit("not one root").alias("problem"), F.col("n").cast("string").alias("id"), F.lit(None).cast("string").alias("other")),
        ]
    ).distinct()


def fold(nodes: DataFrame, f: Callable[[dict, list], object], kind: str) -> DataFrame:
    """(id, value) of every node under the root by any function: f(node, values of its children in order of id) from the lowest level up.

    `nodes` has id, parent and whatever `f` reads; `kind` is the value's SQL type. One pass over each level. The
    children's values of one node meet in one task, so a fold that can be an aggregate is better written as subtree().
    """
    names = nodes.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kids = [[k["value"] for k in (sorted(ks, key=lambda k: k["id"]) if ks is not None else [])] for ks in frame["kids"]]
            own = frame[names].to_dict("records")
            yield pd.DataFrame({"id": frame["id"], "parent": frame["parent"], "value": [f(n, k) for n, k in zip(own, kids)]})

    done, below = [], None
    for here in reversed(levels(nodes)):
        if below is None:
            joined = here.withColumn("kids", F.lit(None).cast(f"array<struct<id:string,value:{kind}>>"))
        else:
            kids = below.groupBy(F.col("parent").alias("_up")).agg(F.collect_list(F.struct("id", "value")).alias("kids"))
            joined = here.join(kids, F.col("id") == F.col("_up"), "left").drop("_up")
        below = cut(joined.mapInPandas(run, f"id string, parent string, value {kind}"))
        done.append(below.select("id", F.col("value").alias("v")))
    return union_all(done).withColumnRenamed("v", "value")


def nearest_ancestor(paths: DataFrame, homes: DataFrame) -> DataFrame:
    """(path, home): the deepest of `homes` (home) that is a directory prefix of each path by whole components; '' if none."""
    ups = paths.select("path", F.posexplode(ancestors_of(F.col("path"))).alias("depth", "home"))
    hits = ups.join(homes.select("home").distinct(), "home").groupBy("path").agg(F.max_by("home", "depth").alias("home"))
    return paths.select("path").distinct().join(hits, "path", "left").select("path", F.coalesce("home", F.lit("")).alias("home"))


def layer_of(nodes: DataFrame, layers: DataFrame) -> DataFrame:
    """(id, layer): for each node the layer named nearest at or above it that `layers` (layer, idx) declares; nodes have a facet `layer`."""
    named = nodes.select(F.col("id").alias("ancestor"), "layer").join(layers.select("layer"), "layer")
    return closure(nodes).join(named, "ancestor").groupBy(F.col("node").alias("id")).agg(F.min_by("layer", "distance").alias("layer"))


def layer_violations(edges: DataFrame, file_layers: DataFrame, layers: DataFrame) -> DataFrame:
    """(src, dst, from_layer, to_layer) for edges from a lower layer into a higher one; files without a layer are free."""
    ranked = file_layers.join(layers, "layer").select("id", "layer", "idx")
    a = ranked.select(F.col("id").alias("src"), F.col("layer").alias("from_layer"), F.col("idx").alias("i"))
    b = ranked.select(F.col("id").alias("dst"), F.col("layer").alias("to_layer"), F.col("idx").alias("j"))
    return edges.join(a, "src").join(b, "dst").where("j > i").select("src", "dst", "from_layer", "to_layer")


def rendered(nodes: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(path, line): the tree as indented lines; sorting by path gives depth-first order, children by id.

    Composites carry the number of files below them; with `most_depth` deeper nodes are left out.
    """
    counted = subtree(nodes).select("id", "parent", "kind", "files")
    level = cut(counted.where("parent IS NULL").select("id", "kind", "files", F.array("id").alias("path")))
    out, k = [level], 0
    while most_depth is None or k < most_depth:
        k += 1
        up = level.select(F.col("id").alias("up"), "path")
        level = cut(counted.join(up, counted["parent"] == up["up"]).select("id", "kind", "files", F.concat("path", F.array("id")).alias("path")))
        if level.isEmpty():
            break
        out.append(level)
    name = F.substring_index("id", "/", -1)
    count = F.when(F.col("kind") == "composite", F.concat(F.lit(" ("), F.col("files").cast("string"), F.lit(")"))).otherwise("")
    return union_all([o.select("path", F.concat(F.repeat(F.lit("  "), F.lit(i)), name, count).alias("line")) for i, o in enumerate(out)])


def dependency_path(depends: DataFrame) -> list[str]:
    """One cycle of dependencies (id, target) as a path that ends where it began, [] if there is none.

    Spark finds the nodes on cycles; only the component of least name comes to the driver, to be walked.
    """
    from strandweave.operators.graph import cycles

    loop = depends.where("id = target").agg(F.min("id")).first()[0]
    if loop is not None:
        return [loop, loop]
    edges = depends.select(F.col("id").alias("src"), F.col("target").alias("dst"))
    found = cut(cycles(edges))
    least = found.agg(F.min("component")).first()[0]
    if least is None:
        return []
    own = found.where(F.col("component") == least).select(F.col("node").alias("src"))
    to: dict[str, list[str]] = {}
    for r in edges.join(own, "src", "left_semi").join(own.withColumnRenamed("src", "dst"), "dst", "left_semi").orderBy("src", "dst").collect():
        to.setdefault(r["src"], []).append(r["dst"])
    paths, seen = [[least]], {least}
    for path in paths:
        for b in to.get(path[-1], []):
            if b == least:
                return [*path, b]
            if b not in seen:
                seen.add(b)
                paths.append([*path, b])
    return []
