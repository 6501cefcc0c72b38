"""Reachability, cycles and components over edge tables that may hold cycles and dangling ends.

Rounds are Spark jobs over tables in the shared folder; what a round no longer needs is deleted. Long paths don't cost a
round a step: chains (nodes with one edge in and one out) are folded into one weighted edge by pointer doubling, and nodes that
lead nowhere are taken off first, so trees and chains shrink in a logarithmic number of rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import release, small_broadcasts, written

#: Hops that are followed one by one before a graph is folded, and rounds after which tables are put together.
HOPS, TOGETHER = 8, 8
#: Rounds of trimming before chains are folded.
TRIMS = 3


def _links(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst, w): each edge once, with its length."""
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).dropna().distinct().withColumn("w", F.lit(1).cast("long"))


def doubled(table: DataFrame, tag: str) -> DataFrame:
    """table (node, to, w) with every `to` that is a node replaced by where that leads, until none is; w adds up. What runs in a circle has no `to` in the end."""
    now = written(table, tag)
    longest, n = now.agg(F.coalesce(F.max("w"), F.lit(0)), F.count(F.lit(1))).first()
    while True:
        ahead = now.select(F.col("node").alias("to"), F.col("to").alias("__on"), F.col("w").alias("__more"))
        open_ = F.col("__on").isNotNull()
        step = now.join(ahead, "to", "left").select("node", F.coalesce("__on", "to").alias("to"), (F.col("w") + F.coalesce("__more", F.lit(0))).alias("w"), open_.alias("__open"))
        new = written(step, tag)
        release(now)
        now = new
        n_open, far = now.agg(F.count_if("__open"), F.max("w")).first()
        if not n_open:
            return now.drop("__open")
        #: No way without a circle is that long.
        if far > longest * n:
            return written(now.drop("__open").join(now.select(F.col("node").alias("to")), "to", "left_anti").select("node", "to", "w"), tag)


def fold(links: DataFrame, fixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains of links (src, dst, w) as one link each: (links between the other nodes, (node, to, w): the node before its chain for each
    chain's node, and how far it is). fixed (node) are never part of a chain. Circles that nothing leads into vanish."""
    into = links.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("before"), F.min("w").alias("w"))
    out = links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    single = into.filter("n_in = 1").join(out.filter("n_out = 1"), "node").join(fixed.select("node"), "node", "left_anti").filter("before <> node")
    heads = doubled(single.select("node", F.col("before").alias("to"), "w"), "chains")
    kept = links.join(heads.select(F.col("node").alias("dst")), "dst", "left_anti")
    at = heads.select(F.col("node").alias("src"), F.col("to").alias("__head"), F.col("w").alias("__way"))
    circles = single.select(F.col("node").alias("src")).join(heads.select(F.col("node").alias("src")), "src", "left_anti")
    joined = kept.join(circles, "src", "left_anti").join(at, "src", "left")
    new = joined.select(F.coalesce("__head", "src").alias("src"), "dst", (F.col("w") + F.coalesce("__way", F.lit(0))).alias("w"))
    return written(new.filter("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")), "folded"), heads


def _depths(links: DataFrame, start: DataFrame, hops: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(node, depth) of what start (node, depth) reaches over links (src, dst, w), and, where hops ran out, what was new then (else None)."""
    known, new, round_ = written(start, "reached"), start, 0
    tables = [known]
    new = known
    while hops is None or round_ < hops:
        step = new.select(F.col("node").alias("src"), "depth").join(links, "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        seen = reduce(DataFrame.unionByName, tables).groupBy("node").agg(F.min("depth").alias("__d"))
        better = step.join(seen, "node", "left").filter(F.col("__d").isNull() | (F.col("depth") < F.col("__d"))).select("node", "depth")
        new, round_ = written(better, "reached"), round_ + 1
        if new.isEmpty():
            release(new)
            new = None
            break
        tables.append(new)
        if len(tables) > TOGETHER:
            whole = written(reduce(DataFrame.unionByName, tables).groupBy("node").agg(F.min("depth").alias("depth")), "reached")
            release(*tables[:-1])
            tables = [whole, new]
    found = written(reduce(DataFrame.unionByName, tables).groupBy("node").agg(F.min("depth").alias("depth")), "reached")
    newest = None if new is None else written(new, "reached")
    release(*tables)
    return found, newest


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, depth) for all that roots (node) reach, roots at depth 0; depth is the fewest steps.

    HOPS steps are followed one by one, from the newest nodes only. If there is more, the rest of the graph (what isn't reached
    yet, and the newest nodes) is folded: nodes that lead nowhere are put aside, chains become one link, as long as that
    takes a tenth of the links; what is left is followed link by link; and what was folded gets its depth backwards. Null ends and
    null roots count as no node.
    """
    links = written(_links(edges, src, dst), "links")
    start = roots.select("node").dropna().distinct().withColumn("depth", F.lit(0).cast("long"))
    found, newest = _depths(links, start, HOPS)
    if newest is None:
        release(links)
        return found.withColumn("depth", F.col("depth").cast("int"))
    known = found.select("node").join(newest.select("node"), "node", "left_anti")
    rest = written(links.join(known.select(F.col("node").alias("src")), "src", "left_anti").join(found.select(F.col("node").alias("dst")), "dst", "left_anti"), "rest")
    release(links)
    more = _folded_depths(rest, newest)
    both = found.unionByName(more.join(newest.select("node"), "node", "left_anti"))
    return both.withColumn("depth", F.col("depth").cast("int"))


def _folded_depths(links: DataFrame, start: DataFrame) -> DataFrame:
    """(node, depth) of what start (node, depth) reaches over links (src, dst, w), start too."""
    n, aside = links.count(), []
    while n:
        leads = links.select(F.col("src").alias("dst")).unionByName(start.select(F.col("node").alias("dst"))).distinct()
        ends = written(links.join(leads, "dst", "left_anti"), "ends")
        inner = written(links.join(leads, "dst", "left_semi"), "inner")
        folded, chains = fold(inner, start)
        release(inner)
        #: Opened again in the order opposite to that in which they were put aside.
        aside += [ends, chains.select(F.col("to").alias("src"), F.col("node").alias("dst"), "w")]
        links, before, n = folded, n, folded.count()
        if n > 0.9 * before:
            break
    depths, _ = _depths(links, start)
    for table in reversed(aside):
        opened = depths.select(F.col("node").alias("src"), "depth").join(table, "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        depths = written(depths.unionByName(opened).groupBy("node").agg(F.min("depth").alias("depth")), "opened")
    return depths


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for each node that a link holds the smallest node that links lead to, in either direction.

    Every round hangs each node's neighbours on the smallest of them (larger ones first, then smaller), which halves
    paths; rounds end when nothing changes. Both steps aggregate map-side.
    """
    own = links.select(F.col(a).alias("node"), F.col(b).alias("to")).dropna()
    every = own.select("node").unionByName(own.select(F.col("to").alias("node"))).distinct()
    now = written(own.filter("node <> to").select(F.greatest("node", "to").alias("node"), F.least("node", "to").alias("to")).distinct(), "hooks")
    while True:
        both = now.unionByName(now.select(F.col("to").alias("node"), F.col("node").alias("to")))
        least = both.groupBy("node").agg(F.min("to").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = both.filter("to > node").join(least, "node").select(F.col("to").alias("node"), F.col("m").alias("to")).filter("node <> to").distinct()
        least = large.groupBy("node").agg(F.min("to").alias("m"))
        small = large.join(least, "node")
        hung = small.select("node", F.col("m").alias("to")).unionByName(small.filter("to <> m").select(F.col("to").alias("node"), F.col("m").alias("to"))).distinct()
        new = written(hung, "hooks")
        with small_broadcasts(links.sparkSession):
            same = new.join(now, ["node", "to"], "left_anti").isEmpty() and now.join(new, ["node", "to"], "left_anti").isEmpty()
        release(now)
        now = new
        if same:
            break
    labels = now.groupBy("node").agg(F.min("to").alias("label"))
    return every.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _handed_on(arcs: DataFrame) -> DataFrame:
    """(node, colour) for the ends of arcs: the largest node that reaches each. What a node has been given is handed on with it, so ways double."""
    colour = written(arcs.select(F.col("src").alias("node")).unionByName(arcs.select(F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node")), "colours")
    while True:
        given = arcs.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("given")), "src").select(F.col("dst").alias("node"), "given")
        further = colour.select("node", "colour").join(colour.select(F.col("node").alias("colour"), F.col("colour").alias("given")), "colour").select("node", "given")
        most = given.unionByName(further).groupBy("node").agg(F.max("given").alias("given"))
        new = written(colour.select("node", F.col("colour").alias("__old")).join(most, "node").select("node", F.greatest("__old", "given").alias("colour"), "__old"), "colours")
        release(colour)
        colour = new
        if colour.filter("colour <> __old").isEmpty():
            return colour


def _trimmed(arcs: DataFrame) -> DataFrame:
    """arcs whose ends both have arcs in and out."""
    inner = arcs.select(F.col("src").alias("node")).distinct().join(arcs.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")
    return written(arcs.join(inner.select(F.col("node").alias("src")), "src", "left_semi").join(inner.select(F.col("node").alias("dst")), "dst", "left_semi"), "arcs")


def cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, cycle): the nodes that lead back to themselves, each with the smallest node of those it shares circles with (its strongly
    connected component).

    What has no edge in or none out is trimmed off; where TRIMS rounds don't end that, chains are folded first, so long tails go
    in a few rounds, too. Then the largest node that reaches each is handed on along edges, and back along those whose ends have
    got the same: nodes that get it both ways are one component. They are taken off, and the rest, without edges between nodes
    that have got different ones, goes through the same again.
    """
    links = written(_links(edges, src, dst), "arcs")
    loops = written(links.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle")), "loops")
    arcs = written(links.filter("src <> dst").select("src", "dst"), "arcs")
    release(links)
    found, chains, n = [loops], [], arcs.count()
    while n:
        for k in range(TRIMS + 1):
            less = _trimmed(arcs)
            release(arcs)
            arcs, before, n = less, n, less.count()
            if n == before or not n:
                break
            if k == TRIMS:
                folded, inside, circles = _fold_arcs(arcs)
                release(arcs)
                arcs, n = folded, folded.count()
                found.append(circles)
                chains.append(inside)
        if not n:
            break
        colour = _handed_on(arcs)
        at = lambda c, k: colour.select(F.col("node").alias(c), F.col("colour").alias(k))
        same = written(arcs.join(at("src", "c1"), "src").join(at("dst", "c2"), "dst").filter("c1 = c2").select("src", "dst"), "arcs")
        back = _handed_on(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        own = back.select("node", F.col("colour").alias("__back")).join(colour, "node").filter("__back = colour").select("node", "colour")
        #: A node alone in its component, which has no edge to itself, is done with but on no circle.
        members = own.groupBy("colour").agg(F.min("node").alias("cycle"), F.count(F.lit(1)).alias("n"))
        circle = written(own.join(members, "colour").select("node", "cycle", "n"), "circles")
        rest = written(same.join(circle.select(F.col("node").alias("src")), "src", "left_anti").join(circle.select(F.col("node").alias("dst")), "dst", "left_anti"), "arcs")
        release(arcs, same, colour, back)
        found.append(circle.filter("n > 1").select("node", "cycle"))
        arcs, n = rest, rest.count()
    whole = reduce(DataFrame.unionByName, found)
    #: A chain is in the component that both its ends are in; one that leads back to its head makes one with it. The last folded opens first.
    for inside in reversed(chains):
        label = whole.groupBy("node").agg(F.min("cycle").alias("cycle"))
        ends = inside.join(label.select(F.col("node").alias("head"), F.col("cycle").alias("c1")), "head", "left").join(label.select(F.col("node").alias("tail"), F.col("cycle").alias("c2")), "tail", "left")
        opened = ends.filter("head = tail OR c1 = c2").select("node", F.coalesce("c1", "head").alias("cycle"))
        heads = ends.filter("head = tail").select(F.col("head").alias("node"), F.coalesce("c1", "head").alias("cycle"))
        whole = written(whole.unionByName(opened).unionByName(heads), "circles")
    if chains:
        names = whole.select(F.col("cycle").alias("of"), "node").groupBy("of").agg(F.min("node").alias("cycle"))
        return whole.withColumnRenamed("cycle", "of").join(names, "of").groupBy("node").agg(F.min("cycle").alias("cycle"))
    return whole.groupBy("node").agg(F.min("cycle").alias("cycle"))


def _fold_arcs(arcs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(arcs between nodes of more than one way, (node, head, tail) for nodes on chains: where they come from and lead to, (node, cycle) for circles that nothing joins)."""
    into = arcs.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("before"))
    out = arcs.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("after"))
    single = written(into.filter("n_in = 1").join(out.filter("n_out = 1"), "node").select("node", "before", "after", F.lit(1).cast("long").alias("w")), "single")
    heads = doubled(single.select("node", F.col("before").alias("to"), "w"), "heads").select("node", F.col("to").alias("head"))
    tails = doubled(single.select("node", F.col("after").alias("to"), "w"), "tails").select("node", F.col("to").alias("tail"))
    inside = written(heads.join(tails, "node"), "inside")
    rings = single.join(inside.select("node"), "node", "left_anti")
    circles = written(components(rings.select(F.col("node").alias("a"), F.col("after").alias("b"))).select("node", F.col("label").alias("cycle")), "circles")
    chained = single.select(F.col("node").alias("src"))
    direct = arcs.join(chained, "src", "left_anti").join(chained.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst")
    folded = direct.unionByName(inside.select(F.col("head").alias("src"), F.col("tail").alias("dst"))).filter("src <> dst").distinct()
    return written(folded, "arcs"), inside, circles


def cycle_findings(members: DataFrame) -> DataFrame:
    """One finding per circle that `cycles` found: key, severity, subject (its smallest node), text."""
    sizes = members.groupBy("cycle").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select(F.lit("cycle").alias("key"), F.lit("note").alias("severity"), F.col("cycle").cast("string").alias("subject"), F.format_string("%s nodes lead back to themselves", "n").alias("text"))


def dangling(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges whose end is no node."""
    return edges.filter(F.col(dst).isNotNull()).join(nodes.select(F.col("node").alias(dst)).distinct(), dst, "left_anti")


def reachable_glyphs(glyphs: DataFrame, sources: list[DataFrame], unknown: DataFrame) -> DataFrame:
    """(font, gid) that any of the sources gives. Of fonts (font) whose code map nobody can read, all their glyphs count."""
    fonts = unknown.select("font").distinct()
    given = reduce(DataFrame.unionByName, [s.select("font", "gid") for s in sources]).join(fonts, "font", "left_anti")
    return given.unionByName(glyphs.select("font", "gid").join(fonts, "font", "left_semi")).distinct()
