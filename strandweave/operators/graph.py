"""Traversals, cycles and placement over edge tables; attribution of references to enclosing ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.text import dir_of
from strandweave.runtime import cut, laid


#: Rounds of a search after which the nodes seen so far are written as one table again.
COMPACT = 8
#: Edges up to which cycles are found in one place; of more, one node in so many is a seed, and seeds claim nodes for
#: so many rounds at most, or until a round adds less than that part of all claimed. Contracting is exact wherever it stops.
SMALL, ONE_IN, ROUNDS, TAIL = 100_000, 256, 16, 1000


def bfs(edges: DataFrame, start: DataFrame, depth: int | None, keep_start: bool = False, ordered: bool = False) -> DataFrame:
    """(node, depth) reached from `start` (node) along `edges` (src, dst); each node once, at its least depth.

    The edges are computed once and lie by src from then on, so that a round shuffles only what is new. One join a round, kept in the shared folder; `depth` None goes on until nothing
    is new. With `ordered` there is also ord: numbers that rise, with gaps, in the order of a queue-based search
    within a depth, by the parent's place, then by name. They are given range by range, not in one task.
    """
    edges = cut(edges.select("src", "dst").repartition("src"))
    extra = [F.lit(0).cast("long").alias("ord")] if ordered else []
    # the depth is added after each cut: Spark 4.1 fails to carry a checkpoint's own constraints through a union
    front = cut(start.select("node").distinct().select("node", *extra))
    rounds, seen, k = [front.withColumn("depth", F.lit(0))], front.select(F.col("node").alias("known")), 0
    while depth is None or k < depth:
        k += 1
        step = edges.join(front, edges["src"] == front["node"])
        step = step.groupBy("dst").agg(F.min("ord").alias("parent")) if ordered else step.select("dst").distinct()
        new = step.join(seen, F.col("dst") == F.col("known"), "left_anti").withColumnRenamed("dst", "node")
        if ordered:
            new = new.repartitionByRange("parent", "node").sortWithinPartitions("parent", "node").select("node", F.monotonically_increasing_id().alias("ord"))
        front = cut(new)
        if front.isEmpty():
            break
        rounds.append(front.withColumn("depth", F.lit(k)))
        seen = seen.union(front.select(F.col("node").alias("known")))
        if k % COMPACT == 0:
            seen = cut(seen).select(F.col("known").alias("known"))
    columns = ["node", "depth", *(["ord"] if ordered else [])]
    out = rounds[0].select(*columns) if keep_start else rounds[0].select(*columns).limit(0)
    for r in rounds[1:]:
        out = out.unionByName(r.select(*columns))
    return out


def reachable(edges: DataFrame, entry: DataFrame) -> DataFrame:
    """The entry set and all it leads to."""
    return bfs(edges, entry, None, keep_start=True).select("node")


def dead(edges: DataFrame, entry: DataFrame) -> DataFrame:
    """(node): ends of `edges` (src, dst) that nothing in the entry set (node) leads to."""
    edges = cut(edges.select("src", "dst"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return nodes.join(reachable(edges, entry), "node", "left_anti")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges left once nodes without a way in or without a way out have gone, again and again."""
    edges = cut(edges.where("src != dst").select("src", "dst").distinct())
    n = edges.count()
    while n:
        both = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
        edges = cut(edges.join(both.withColumnRenamed("node", "src"), "src", "left_semi").join(both.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
        left = edges.count()
        if left == n:
            break
        n = left
    return edges


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with neither end in `gone` (node)."""
    ends = [gone.select(F.col("node").alias(c)) for c in ("src", "dst")]
    return edges.join(ends[0], "src", "left_anti").join(ends[1], "dst", "left_anti").select("src", "dst")


def _around(edges: DataFrame) -> DataFrame:
    """(node, color): the component of the node with the most ways in times ways out, found by going forward and back from it."""
    out, into = (edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias(c)) for c in ("src", "dst"))
    pivot = cut(out.join(into, "node").orderBy(F.desc(F.col("src") * F.col("dst")), "node").limit(1).select("node"))
    forward = reachable(edges, pivot)
    back = reachable(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), pivot)
    return cut(forward.join(back, "node", "left_semi").crossJoin(pivot.withColumnRenamed("node", "color")))  # the pivot is one row


def _colored(edges: DataFrame) -> DataFrame:
    """(node, color): the strongly connected components of `edges`, some of one node, by rounds over all edges.

    What can't lie on a cycle is trimmed first. The component of the best connected node, the giant one of most
    graphs, is found from that node. Of the rest each node takes the greatest name that reaches it; a name that
    its own node keeps marks a component, made of the nodes of that colour that lead back to it. Those are removed and
    what is left is coloured again. A colouring takes as many rounds as its longest shortest way has steps.
    """
    edges = _trimmed(edges)
    if edges.isEmpty():
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("color"))
    found = _around(edges)
    edges = _trimmed(_without(edges, found))
    while not edges.isEmpty():
        color = cut(edges.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("color")))
        while True:
            sent = edges.join(color, edges["src"] == color["node"]).select(F.col("dst").alias("node"), "color")
            after = cut(color.union(sent).groupBy("node").agg(F.max("color").alias("color")))
            if after.join(color, ["node", "color"], "left_anti").isEmpty():
                break
            color = after
        c1, c2 = color.withColumnsRenamed({"node": "src", "color": "cs"}), color.withColumnsRenamed({"node": "dst", "color": "cd"})
        inside = cut(edges.join(c1, "src").join(c2, "dst").where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        back = reachable(inside, color.where("node = color").select("node")).join(color, "node")
        part = cut(back.select("node", "color"))
        found = found.union(part)
        edges = _trimmed(_without(edges, part))
    return found


def _walked(edges: DataFrame) -> DataFrame:
    """(node, color): the strongly connected components of more than one node of a few edges, by a search in depth (Tarjan)."""
    to: dict = {}
    for a, b in edges.collect():
        to.setdefault(a, []).append(b)
    index, low, stack, out = {}, {}, [], []
    for root in to:
        path = [] if root in index else [(root, iter(to[root]))]
        while path:
            node, rest = path[-1]
            if node not in index:
                index[node] = low[node] = len(index)
                stack.append(node)
            for b in rest:
                if b not in index:
                    path.append((b, iter(to.get(b, ()))))
                    break
                low[node] = min(low[node], low.get(b, low[node]))
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == index[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(stack.pop())
                        del low[group[-1]]
                    out += [(n, node) for n in group] if len(group) > 1 else []
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame(out, f"node {kind}, color {kind}")


def _claimed(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, owner): the seeds (node) and most nodes they lead to along laid `edges`, each with one of the seeds nearest to it."""
    front = seeds.select("node", F.col("node").alias("owner"))
    claimed, total = front, seeds.count()
    for _ in range(ROUNDS):
        sent = edges.join(front.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.min("owner").alias("owner"))
        front = cut(sent.join(claimed.select(F.col("node").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("node"), "owner"))
        new = front.count()
        if new:
            claimed, total = claimed.union(front), total + new
        if new * TAIL < total:
            break
    return claimed


def _components(edges: DataFrame) -> DataFrame:
    """(node, color): the strongly connected components of `edges` (src, dst), some of one node.

    Many edges are contracted first. Seeds claim the nodes they lead to, and, going back, those that lead to them. A
    node claimed by p and leading to q is a way from p to q; where such ways make a circle, their seeds and nodes are
    of one component. All edges between the classes so made, or nodes outside them, are then a graph of their own. Each
    edge is followed once forward and once back, whether there is one giant component or there are many.
    """
    edges = cut(edges.where("src != dst").select("src", "dst").distinct())
    n = edges.count()
    if n <= SMALL:
        return _walked(edges)
    some = lambda c: edges.select(F.col(c).alias("node")).where(F.pmod(F.xxhash64(c), F.lit(ONE_IN)) == 0)
    seeds = cut(some("src").intersect(some("dst")))
    if seeds.isEmpty():
        return _colored(edges)
    out = laid(edges, "src")
    first = _claimed(out, seeds).withColumnRenamed("owner", "by")
    last = _claimed(laid(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "src"), seeds).withColumnRenamed("owner", "to")
    both = cut(first.join(last, "node").select("node", "by", "to"))
    joined = cut(_components(both.select(F.col("by").alias("src"), F.col("to").alias("dst"))))
    own = lambda c: joined.select(F.col("node").alias(c), F.col("color").alias(f"{c}_color"))
    both = both.join(own("by"), "by", "left").join(own("to"), "to", "left").select("node", F.coalesce("by_color", "by").alias("color"), F.coalesce("to_color", "to").alias("other"))
    classes = cut(both.where("color = other").select("node", "color"))
    end = lambda c: classes.select(F.col("node").alias(c), F.col("color").alias(f"{c}_class"))
    left = out.join(end("src"), "src", "left").select(F.coalesce("src_class", "src").alias("src"), "dst")
    left = left.join(end("dst"), "dst", "left").select("src", F.coalesce("dst_class", "dst").alias("dst"))
    left = cut(left.where("src != dst").distinct())
    rest = cut(_components(left) if 2 * left.count() < n else _colored(left))
    # a class bears the name of one of its own nodes
    more = rest.select(F.col("node").alias("color"), F.col("color").alias("whole"))
    inside = classes.join(more, "color", "left").select("node", F.coalesce("whole", "color").alias("color"))
    return inside.union(rest.join(classes.select("node"), "node", "left_anti").select("node", "color"))


def cycles(edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(node, component): strongly connected components of more than one node, named by their least member.

    With `names` (key, node) the edges are between keys. Each name of a key is a node, with all its key's edges, those
    from the key to itself among its other names.
    """
    if names is None:
        found = _components(edges)
    else:
        edges = cut(edges.select("src", "dst"))
        found = cut(_components(edges))
        loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(found, "node", "left_anti")
        found = found.union(loops.select("node", F.col("node").alias("color"))).withColumnRenamed("node", "key").join(names, "key").select("node", "color")
    found = cut(found)
    named = found.groupBy("color").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    return found.join(named, "color").select("node", "component")


def misplaced(edges: DataFrame) -> DataFrame:
    """(file, current_dir, suggested_dir, dependents): files whose dependents all lie in one other directory; from edges (src, dst)."""
    rows = edges.select("src", "dst").distinct().withColumn("d", dir_of(F.col("src")))
    own = rows.groupBy("dst").agg(F.min("d").alias("suggested_dir"), F.max("d").alias("last"), F.count("*").alias("dependents"))
    out = own.where("suggested_dir = last").withColumn("current_dir", dir_of(F.col("dst"))).where("current_dir != suggested_dir")
    return out.select(F.col("dst").alias("file"), "current_dir", "suggested_dir", "dependents")


def placement(edges: DataFrame) -> DataFrame:
    """(file, dir, n, rank): directories by edges to and from each file; the own one counts too."""
    rows = edges.select("src", "dst").distinct()
    ways = rows.select(F.col("src").alias("file"), dir_of(F.col("dst")).alias("dir")).union(rows.select(F.col("dst").alias("file"), dir_of(F.col("src")).alias("dir")))
    counts = ways.groupBy("file", "dir").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "dir")))


def place_new(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(file, dir, n, rank) for new files from their imports (file, module), repeats counted, and (module, dir)."""
    counts = imports.join(modules, "module").groupBy("file", "dir").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "dir")))


def fan_in(edges: DataFrame, top: int = 8) -> DataFrame:
    """(node, n): the report of the `top` nodes by distinct edges in, ties by name."""
    return edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(top)


def _in_blocks(ranges: DataFrame, number: Callable[[Column], Column]) -> DataFrame:
    """`ranges` (start, end) with _k and _block: a range of up to 2**_k numbers meets at most two aligned blocks of so many, and lies in each."""
    lo, hi = number(F.col("start")).cast("long"), number(F.col("end")).cast("long")
    # past 2**62 numbers, or where their count overflows, all is one block
    held = ranges.withColumn("_lo", lo).withColumn("_hi", hi).where("start <= end AND _lo IS NOT NULL AND _hi IS NOT NULL")
    held = held.withColumn("_k", F.expr("CASE WHEN _hi = _lo THEN 0 WHEN try_subtract(_hi, _lo) IS NULL THEN 63 ELSE length(bin(_hi - _lo)) END").cast("int"))
    return held.withColumn("_block", F.explode(F.expr("CASE WHEN _k > 62 THEN array(0L) ELSE array_distinct(array(shiftright(_lo, _k), shiftright(_hi, _k))) END"))).drop("_lo", "_hi")


def innermost(refs: DataFrame, ranges: DataFrame, span: list[Column], number: Callable[[Column], Column]) -> DataFrame:
    """Each reference (file, ref, at) with the narrowest of `ranges` (file, owner, start, end, ord) that holds it, ends included.

    `span` orders ranges by width; ties go to the first by ord. `number` gives a place's whole number, which rises
    with places. A reference looks into its block of each size that occurs, 64 at most and one where all ranges are about
    as wide. So a file's references and ranges meet by block, not all with all.
    """
    held = _in_blocks(ranges, number)
    # a row for each size that occurs
    sizes = held.select(F.col("_k").alias("_size")).distinct()
    asked = refs.withColumn("_at", number(F.col("at")).cast("long")).crossJoin(F.broadcast(sizes))
    asked = asked.select(F.col("file").alias("_file"), "ref", "at", "_size", F.expr("CASE WHEN _size > 62 THEN 0 ELSE shiftright(_at, _size) END").alias("_own"))
    same = (F.col("_file") == F.col("file")) & (F.col("_size") == F.col("_k")) & (F.col("_own") == F.col("_block"))
    hits = asked.join(held, same & (F.col("at") >= F.col("start")) & (F.col("at") <= F.col("end"))).select("file", "ref", "owner", F.struct(*span, "ord").alias("width"))
    return hits.groupBy("file", "ref").agg(F.min_by("owner", "width").alias("owner"))


def code_graph(occurrences: DataFrame, symbols: DataFrame) -> dict[str, DataFrame]:
    """symbols, refs and file_deps from occurrences (file, ord, symbol, roles, range array, enclosing array) and symbol rows.

    A definition has the first role bit set; local symbols don't count. A reference belongs to the innermost
    definition around it; if that is the symbol itself no edge is made. File edges skip module symbols (kind 29).
    """

    def spread(r: str) -> Column:
        c = F.col(r)
        return F.when(F.size(c) == 3, F.struct(c[0].alias("sl"), c[1].alias("sc"), c[0].alias("el"), c[2].alias("ec"))).when(
            F.size(c) >= 4, F.struct(c[0].alias("sl"), c[1].alias("sc"), c[2].alias("el"), c[3].alias("ec"))
        )

    rows = occurrences.withColumn("r", spread("range")).withColumn("e", F.coalesce(spread("enclosing"), spread("range")))
    is_def = F.col("roles").bitwiseAND(1) == 1
    defs = rows.where(is_def & ~F.col("symbol").startswith("local ") & (F.col("symbol") != "") & F.col("r").isNotNull())
    latest = Window.partitionBy("symbol").orderBy(F.desc("file"), F.desc("ord"))
    info = symbols.select("file", "symbol", "display", "kind", "is_impl")
    known = defs.withColumn("k", F.row_number().over(latest)).where("k = 1").join(info, ["file", "symbol"], "left")
    known = known.select("symbol", F.coalesce("display", F.lit("")).alias("display"), F.coalesce("kind", F.lit(0)).alias("kind"), "file", F.col("r").alias("def"), F.col("e").alias("enclosing"), F.coalesce("is_impl", F.lit(False)).alias("is_impl"))
    uses = rows.where(~is_def & F.col("r").isNotNull()).join(known.select("symbol", "kind", F.col("file").alias("target_file")), "symbol")
    refs = uses.select("file", F.struct("ord", "symbol").alias("ref"), F.struct(F.col("r.sl"), F.col("r.sc")).alias("at"))
    ranges = defs.select("file", F.col("symbol").alias("owner"), F.struct(F.col("e.sl"), F.col("e.sc")).alias("start"), F.struct(F.col("e.el").alias("sl"), F.col("e.ec").alias("sc")).alias("end"), "ord")
    width = [(F.col("end.sl") - F.col("start.sl")).alias("dl"), (F.col("end.sc") - F.col("start.sc")).alias("dc")]
    owned = innermost(refs, ranges, width, lambda place: place["sl"])
    edges = owned.select(F.col("owner").alias("src"), F.col("ref.symbol").alias("dst")).where("src != dst").distinct()
    deps = uses.where("kind != 29 AND file != target_file").select(F.col("file").alias("src"), F.col("target_file").alias("dst")).distinct()
    return {"symbols": known, "refs": edges, "file_deps": deps}


def merge_graphs(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Edges of all graphs, each once."""
    out = first
    for m in more:
        out = out.unionByName(m)
    return out.distinct()


def stats(edges: DataFrame) -> DataFrame:
    """(edges, sources, targets): one row about an edge table."""
    return edges.agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))
