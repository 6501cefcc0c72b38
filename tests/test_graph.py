"""Reachability, components, cycles and revision chains against plain walks over the same edges."""

import random
import threading

from pyspark.sql import functions as F

from quillon.operators import graph, versions


def values(df):
    return [tuple(r) for r in df.collect()]




def brute_depths(edges, roots):
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    out, ring, d = {}, set(roots), 0
    while ring:
        out |= dict.fromkeys(ring, d)
        ring, d = {b for a in ring for b in after.get(a, ())} - out.keys(), d + 1
    return out


def shapes():
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    comb = chain + [(i, 1000 + i) for i in range(0, 60, 3)]
    ladder = chain + [(i, i + 7) for i in range(0, 50, 5)] + [(40, 2), (58, 0)]
    wild = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(120)]
    two = [*chain, *((100 + i, 101 + i) for i in range(40)), (20, 120), (139, 30), (300, 301), (301, 302), (302, 300)]
    return {"chain": (chain, [0]), "comb": (comb, [0]), "ladder": (ladder, [0]), "wild": (wild, [0, 5]), "two": (two, [0, 100]), "circle": ([*chain, (60, 0), (30, 70)], [15])}


def test_depths_are_the_fewest_steps(spark):
    edges = [(f"{k} {a}", f"{k} {b}") for k, (own, _) in shapes().items() for a, b in own]
    roots = [f"{k} {r}" for k, (_, own) in shapes().items() for r in own]
    got = graph.reachable(spark.createDataFrame([*edges, ("chain 0", None), (None, "wild 1")], "src string, dst string"), spark.createDataFrame([(r,) for r in [*roots, None]], "node string"))
    assert dict(values(got.select("node", "depth"))) == brute_depths(edges, roots)


def test_a_thousand_steps_take_tens_of_rounds(spark, monkeypatch):
    calls = []
    kept = graph.written
    monkeypatch.setattr(graph, "written", lambda df, tag: calls.append(tag) or kept(df, tag))
    edges = spark.range(1000).selectExpr("id AS src", "id + 1 AS dst").union(spark.range(0, 1000, 7).selectExpr("id", "-id - 1"))
    got = dict(values(graph.reachable(edges, spark.range(1).withColumnRenamed("id", "node"))))
    assert got == {**{i: i for i in range(1001)}, **{-i - 1: i + 1 for i in range(0, 1000, 7)}} and len(calls) < 100


def test_components_are_those_of_any_direction(spark):
    rng = random.Random(5)
    links = [*((i, i + 1) for i in range(90)), *((rng.randint(200, 350), rng.randint(200, 350)) for _ in range(90)), (401, 401), (402, 403), (405, 403), (409, 409)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame([*links, (None, 4)], "a int, b int"))
    assert dict(values(got)) == {x: find(x) for x in list(root)}
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_cycles_are_strong_components(spark):
    rng = random.Random(7)
    graphs = [[(i, (i + 1) % 40) for i in range(40)] + [(5, 100), (100, 101), (101, 102), (102, 101), (200, 5)], [*((i, i + 1) for i in range(70)), (70, 60), (30, 10), (71, 0), (25, 80), *((80 + i, 81 + i) for i in range(10)), (90, 26), *((300 + i, 300 + (i + 1) % 9) for i in range(9)), *((400 + i, 401 + i) for i in range(20)), (420, 400)], [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(80)], [(1, 1), (1, 2), (2, 3)], [(1, 2)]]
    graphs.append([(1, 2), (2, 1), (2, 50), (50, 3), (3, 4), (4, 3)])
    edges = [(1000 * k + a, 1000 * k + b) for k, own in enumerate(graphs) for a, b in own]
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    reach = {x: set() for e in edges for x in e}
    for x in reach:
        ring = list(after.get(x, ()))
        while ring:
            y = ring.pop()
            if y not in reach[x]:
                reach[x].add(y)
                ring += after.get(y, ())
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in reach if x in reach[x]}
    table = spark.createDataFrame([*edges, (None, 1), (3, None)], "src int, dst int")
    members = graph.cycles(table)
    assert dict(values(members.select("node", "cycle"))) == want and 5050 not in want
    found = values(graph.cycle_findings(members).select("subject", "text"))
    assert {(s, int(t.split()[0])) for s, t in found} == {(str(c), sum(v == c for v in want.values())) for c in set(want.values())}


def test_chains_of_revisions_and_what_each_sees(spark):
    rows = [(i, i - 1 if i else None) for i in range(300)] + [(500, 120), (501, 500), (600, -7), (601, 600), (700, 702), (701, 700), (702, 701), (703, 702)]
    table = spark.createDataFrame(rows, "revision long, prev long")
    prev = dict(rows)
    want = {}
    for r in prev:
        path, x = [r], r
        while prev.get(x) is not None and prev[x] in prev and prev[x] not in path:
            x = prev[x]
            path.append(x)
        circle = prev.get(x) is not None and prev[x] in path
        lost = prev.get(x) if not circle and prev.get(x) is not None else None
        want[r] = (None, None, None) if circle else (None, None, lost) if lost is not None else (x, len(path) - 1, None)
    assert {r: (a, b, c) for r, a, b, c in values(versions.chains(table))} == want
    tips = spark.createDataFrame([(501,), (299,), (601,), (703,), (9999,)], "tip long")
    seen = {}
    for tip, r, steps in values(versions.history(table, tips)):
        seen.setdefault(tip, {})[r] = steps
    assert seen == {501: {501: 0, 500: 1, **{i: 122 - i for i in range(121)}}, 299: {i: 299 - i for i in range(300)}, 601: {601: 0, 600: 1}, 703: {703: 0, 702: 1, 701: 2, 700: 3}}
    data = spark.createDataFrame([(0, "a", "a0"), (0, "b", "b0"), (100, "a", "a100"), (200, "a", "a200"), (150, "b", None), (500, "b", "b500")], "revision long, k string, v string")
    got = versions.as_of(data, table, tips, ["k"], deleted=data.v.isNull())
    assert sorted(values(got.select("tip", "k", "v"))) == [(299, "a", "a200"), (501, "a", "a100"), (501, "b", "b500")]


def test_two_writers_of_one_revision_and_reads_as_of_any(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v string"
    first = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    assert versions.commit_revision(path, first, 1, None) == 2
    results = []

    def write(name):
        try:
            results.append((name, versions.commit_revision(path, spark.createDataFrame([(2, name), (3, name)], schema), 2, 1)))
        except FileExistsError:
            results.append((name, None))

    writers = [threading.Thread(target=write, args=(n,)) for n in ("x", "y", "z")]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    won = [n for n, rows in results if rows]
    assert len(results) == 3 and len(won) == 1
    versions.commit_revision(path, spark.createDataFrame([(1, None)], schema), 3, 2)
    versions.commit_revision(path, spark.createDataFrame([(1, "other")], schema), 4, 1)
    read = lambda r: sorted(values(versions.read_as_of(spark, path, r, ["k"], schema, deleted=F.col("v").isNull()).select("k", "v")))
    assert read(1) == [(1, "a"), (2, "b")] and read(2) == [(1, "a"), (2, won[0]), (3, won[0])]
    assert read(3) == [(2, won[0]), (3, won[0])] and read(4) == [(1, "other"), (2, "b")]
    assert len(list((tmp_path / "t" / "rows").glob("part=*"))) == 4 and len(list((tmp_path / "t" / "manifests").glob("[0-9]*.json"))) == 4
