"""Alignment of sequences, running values, nested documents, tables of keys, replacement and guarded rules against plain constructions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import diff, layout, match, rules, search


def values(df):
    return [tuple(r) for r in df.collect()]


def longest(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(p[j] + 1 if x == y else max(p[j + 1], q[-1]))
        p = q
    return p[-1]


def applied(a, b, ops):
    out, at = [], 0
    for _, os, oe, ns, ne in sorted(ops, key=lambda o: (o[1], o[3])):
        out += a[at:os] + b[ns:ne]
        at = oe
    return out + a[at:]


def test_alignment_turns_one_sequence_into_the_other_at_the_least_cost(spark):
    rng, pairs = random.Random(2), []
    for kind in range(12):
        items = [f"i{rng.randint(0, [3, 1000][kind % 2])}" for _ in range(rng.randint(0, 60))]
        new = [x for x in items if rng.random() > 0.15]
        for _ in range(rng.randint(0, 6)):
            new.insert(rng.randint(0, len(new)), rng.choice(["i1", "i2", None, f"n{rng.randint(0, 9)}"]))
        pairs.append((items, new))
    pairs += [([], ["x"]), (["x"], []), (["u", "x", "y"], ["x", "y", "u"]), ([None, "a", None], ["a", None])]
    sides = [spark.createDataFrame([(k, i, x) for k, pair in enumerate(pairs) for i, x in enumerate(pair[s])], "k int, at int, item string").repartition(3) for s in (0, 1)]
    found = values(diff.alignment(*sides, ["k"], "at", "item"))
    for k, (a, b) in enumerate(pairs):
        ops = [r[1:] for r in found if r[0] == k]
        assert applied(a, b, ops) == b
        assert all((op == "replace") == (oe > os and ne > ns) and (op == "delete") == (ne == ns) for op, os, oe, ns, ne in ops)
        cost, least = sum(oe - os + ne - ns for _, os, oe, ns, ne in ops), len(a) + len(b) - 2 * longest(a, b)
        once = [x for x in set(a) if a.count(x) == 1 and b.count(x) == 1]
        assert cost == least if not once else cost >= least
    assert sum(oe - os + ne - ns for k, _, os, oe, ns, ne in found if k < 12) <= 1.05 * sum(len(a) + len(b) - 2 * longest(a, b) for a, b in pairs[:12])


def test_one_long_pair_is_cut_at_its_anchors(spark):
    """200,000 items with edits whose cost is known, in stretches of a few items each."""
    left = spark.range(200_000).select(F.lit(1).alias("k"), F.col("id").alias("at"), F.when(F.col("id") % 3 == 0, "again").otherwise(F.concat(F.lit("i"), "id")).alias("item"))
    kept = left.filter("at % 1000 <> 500").select("k", F.col("at").alias("old"), F.lit(0).alias("sub"), "item").unionByName(left.filter("at % 5000 = 7").select("k", F.col("at").alias("old"), F.lit(1).alias("sub"), F.concat(F.lit("n"), "at").alias("item")))
    right = spark.createDataFrame([(1, i, r["item"]) for i, r in enumerate(kept.orderBy("old", "sub").collect())], "k int, at long, item string")
    ops = diff.alignment(left, right, ["k"], "at", "item")
    assert values(ops.groupBy("op").agg(F.sum(F.col("old_end") - F.col("old_start") + F.col("new_end") - F.col("new_start")).alias("n")).orderBy("op")) == [("delete", 200), ("insert", 40)]


def test_running_values_over_cells(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([None, rng.randint(0, 99)])) for g in (1, 2) for i in rng.sample(range(500), 120)]
    table = spark.createDataFrame(rows, "g int, at int, v int").repartition(3)
    got = {(g, i): (hi, lo, v) for g, i, hi, lo, v in values(layout.in_effect(layout.running(layout.running(table, ["g"], "at", F.max, "v", "hi", 16), ["g"], "at", F.min, "v", "lo", 7), ["g"], "at", "v", "now", 32).select("g", "at", "hi", "lo", "now"))}
    for g, i, v in rows:
        before = [(j, w) for h, j, w in rows if h == g and j < i and w is not None]
        last = v if v is not None else max(before)[1] if before else None
        assert got[(g, i)] == (max((w for _, w in before), default=None), min((w for _, w in before), default=None), last)


def flat(path, x, by, out):
    import re
    import hashlib
    from collections import Counter

    if isinstance(x, dict):
        out[path] = ("object", str(len(x)))
        for k, v in x.items():
            flat(path + (f".{k}" if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", k) else '["' + re.sub(r'([\\"])', r"\\\1", k) + '"]'), v, by, out)
    elif isinstance(x, list):
        out[path], seen = ("array", str(len(x))), Counter()
        for i, v in enumerate(x):
            digest = hashlib.md5(json.dumps(v, separators=(",", ":"), ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:16]
            seen[digest] += 1
            flat(f"{path}[{digest}#{seen[digest]}]" if by == "content" else f"{path}[{i}]", v, by, out)
    else:
        kind = {str: "string", int: "bigint", bool: "boolean", type(None): "void"}[type(x)]
        out[path] = (kind, None if x is None else json.dumps(x, ensure_ascii=False))
    return out


@pytest.mark.parametrize("by", ["position", "content"])
def test_nested_documents_to_nodes(spark, by):
    rng = random.Random(8)

    def made(depth):
        roll = rng.random()
        if depth == 0 or roll < 0.4:
            return rng.choice([1, -7, "té", "", True, None, 'q"'])
        if roll < 0.7:
            return [made(depth - 1) for _ in range(rng.randint(0, 4))]
        return {k: made(depth - 1) for k in rng.sample(["a", "b_1", "o dd", 'q"', "é"], rng.randint(0, 4))}

    docs = [made(rng.randint(0, 6)) for _ in range(60)]
    rows = [(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)] + [(900, None), (901, "{broken"), (902, "")]
    got = {}
    for i, path, kind, value in values(diff.variant_nodes(spark.createDataFrame(rows, "id int, doc string"), ["id"], "doc", by)):
        got.setdefault(i, {})[path] = (kind, value)
    assert got.pop(901) == {"$": ("malformed", "{broken")} and got.pop(902)["$"][0] == "malformed"
    assert got == {i: flat("$", d, by, {}) for i, d in enumerate(docs)}


def test_an_element_put_in_moves_no_other(spark):
    nodes = lambda doc: diff.variant_nodes(spark.createDataFrame([(1, doc)], "id int, doc string"), ["id"], "doc", "content")
    found = values(diff.structure_diff(nodes('[{"a":1},{"a":1},2]'), nodes('["new",{"a":1},{"a":1},2]'), ["id"]).select("status", "before", "after"))
    assert sorted(found, key=str) == [("added", None, '"new"'), ("value", "3", "4")]


@pytest.mark.parametrize("limit", [1 << 20, 700])
def test_greedy_codes_of_a_large_table(spark, limit):
    rng = random.Random(5)
    keys = list({"".join(rng.choices("abcé文😀", k=rng.randint(1, 6))) for _ in range([100_000, 400][limit < 1000])})
    texts = [(i, "".join(rng.choices("abcé文😀xy", k=rng.randint(0, 80)))) for i in range(60)] + [(900, None), (901, "")]
    held, want = set(keys), []
    for i, t in texts:
        at = no = 0
        while at < len(t or ""):
            n = next((n for n in range(6, 0, -1) if len(t[at : at + n]) == n and t[at : at + n] in held), 0)
            want.append((i, no, t[at : at + max(n, 1)], n > 0))
            at, no = at + max(n, 1), no + 1
    table = spark.createDataFrame([(k,) for k in [*keys, *keys[:5], "", None]], "k string")
    got = match.longest_match_table(spark.createDataFrame(texts, "id int, t string"), "id", "t", table, "k", limit)
    assert sorted(values(got)) == sorted(want)


def test_replacement_outside_python_is_the_same(spark):
    nbsp, hyphen, ff, ffi = " ", "‑", "ﬀ", "ﬃ"
    texts = ["of the", f"of{nbsp}the end", f"off-{ff}", f"o{ffi}ce office", f"a{hyphen}b a-b", None, "", "the the", "OF THE", "$1 \\ .", "“q” 'q'"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    patterns = [(search.Pattern("of the"), "X"), (search.Pattern("a-b"), "$1\\"), (search.Pattern("ffi"), "-"), (search.Pattern("the", whole_word=True), ""), (search.Pattern("OF the", ignore_case=True), "y"), (search.Pattern('"q"'), "z"), (search.Pattern("(o)f", regex=True), r"<\1>"), (search.Pattern("x*", regex=True), "n"), (search.Pattern(""), "n"), (search.Pattern("."), "!")]
    for p, to in patterns:
        want = {i: t for i, t in values(rows.select("id", search.replace_matches(F.col("t"), p, to)))}
        made = search.replace_all(rows, "t", p, to)
        assert dict(values(made)) == want and made.columns == rows.columns


def test_guarded_checks_fail_alone(spark):
    rows = spark.createDataFrame([(1, 0, "4"), (2, 5, "x"), (3, 10, "9")], "id int, v int, s string")
    Check = rules.Check
    checks = [Check("zero", "trace", F.col("v") == 0, "is zero"), Check("share", "note", F.try_divide(F.lit(10), F.col("v")) > 1, "large"), Check("gone", "note", F.col("nothing") > 1, "x"), Check("number", "note", F.col("s").try_cast("int") > 5, "more")]
    found = sorted((k, s, i, None if i == "gone" else t) for k, s, i, t in values(rules.guarded(rows, "id", checks)))
    want = [("check-failed", "note", "gone", None), ("check-failed", "note", "number", "can't be told of 1 rows"), ("check-failed", "note", "share", "can't be told of 1 rows"), ("number", "note", "3", "more"), ("share", "note", "2", "large"), ("zero", "trace", "1", "is zero")]
    assert found == want
    fails = Check("fails", "note", F.raise_error(F.lit("stop")).cast("boolean"), "x")
    again = sorted((k, i) for k, _, i, _ in values(rules.guarded(rows, "id", [*checks, fails])))
    assert again == sorted([*((k, i) for k, _, i, _ in want), ("check-failed", "fails")])
    assert rules.guarded(rows.limit(0), "id", checks[:2]).count() == 0 and rules.guarded(rows, "id", []).count() == 0
