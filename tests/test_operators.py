"""Operators on inline rows: fixed examples, edges, and properties."""

import difflib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from quillon.functions import dates, text
from quillon.operators import detect, diff, graph, layout, match, rules, search, versions


def values(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(column).first()[0]


def test_normalised_search_text(spark):
    for source, plain, at in (("а б", "а б", [0, 1, 2]), ("17­A", "17-A", [0, 1, 2, 3]), ("oﬃce", "office", [0, 1, 1, 1, 2, 3]), ("", "", [])):
        got = spark.createDataFrame([(source,)], "s string").select(text.normalise(F.col("s")), text.source_positions(F.col("s"))).first()
        assert got[0] == plain
        assert list(got[1]) == at


def test_name_parts(spark):
    for name, weight in (("Regular", 400), ("Medium", 500), ("SemiBold", 600), ("Bold", 700), ("Light", 300), ("unknown", 400), ("ExtraLight", 200), ("UltraBlack", 950)):
        assert one(spark, text.weight_of(F.col("n")), n=name) == weight
    assert one(spark, text.strip_subset_prefix(F.col("n")), n="//ABCDEF+Times") == "Times"
    assert one(spark, text.strip_subset_prefix(F.col("n")), n="ABCDE+Times") == "ABCDE+Times"
    assert one(spark, text.is_subset_name(F.col("n")), n="AB1CDE+x") is True
    assert one(spark, text.is_subset_name(F.col("n")), n="ABCDEf+x") is False
    assert one(spark, text.safe_name(F.col("n")), n="__") == "font"
    assert one(spark, text.field_key(F.col("n"), text.FIELD_NAMES), n="Mod_Date") == "/ModDate"
    assert one(spark, text.field_key(F.col("n"), text.FIELD_NAMES), n="custom") == "/Custom"


def test_page_lists(spark):
    cases = [("1,3-5", [0, 2, 3, 4]), ("", None), (None, None), (" 2 , 2-3,,", [1, 2]), ("5-3", []), ("9", "9"), ("3-11", "3-11"), ("abc", "abc"), ("1-x", "1-x"), ("1,a,2", "a"), ("0", "0"), (",", [])]
    for spec, want in cases:
        got = spark.createDataFrame([(spec,)], "s string").select(text.page_list(F.col("s"), F.lit(8)).alias("l")).select("l.*").first()
        if isinstance(want, str):
            assert got["pages"] is None and got["error"].endswith(f": {want}")
        else:
            assert got["error"] is None and got["pages"] == want
    asked = spark.createDataFrame([(2, None), (2, []), (2, [1, 2])], "p int, l array<int>").select(text.on_pages(F.col("p"), F.col("l"))).collect()
    assert [r[0] for r in asked] == [True, False, True]


def test_assignments(spark):
    got = spark.range(1).select(text.assignments(F.array(F.lit("a=1=2"), F.lit("b="), F.lit("a=3"), F.lit("x")))).first()[0]
    assert got == {"a": "3", "b": ""}


def test_minimal_edit_reproduces_the_new_text(spark):
    rng = random.Random(4)
    pairs = [("договор 2021", "договор 2022"), ("abc", "abXc"), ("same", "same"), ("", "x"), ("x", ""), ("aa", "aaa")]
    pairs += [("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 6)))) for _ in range(60)]
    for (old, new), (e,) in zip(pairs, values(spark.createDataFrame(pairs, "o string, n string").coalesce(1).select(text.minimal_edit(F.col("o"), F.col("n")))), strict=True):
        if old == new:
            assert e is None
        else:
            assert old[: e.start] + e.replacement + old[e.end :] == new
            assert e.start < e.end or not old
    first = spark.createDataFrame(pairs[:1], "o string, n string").select(text.minimal_edit(F.col("o"), F.col("n"))).first()[0]
    assert tuple(first) == (11, 12, "2")


def test_dates(spark):
    cases = {
        "D:20210305120000+03'00'": ("D:20210305120000+03'00'", "2021-03-05T12:00:00+03:00"),
        "D:2021": ("D:20210101000000", "2021-01-01T00:00:00"),
        "2021-03-05T12:00:00Z": ("D:20210305120000+00'00'", "2021-03-05T12:00:00+00:00"),
        "2021-03-05 12:00:00-0230": ("D:20210305120000-02'30'", "2021-03-05T12:00:00-02:30"),
        "2021/03/05": ("D:20210305000000", "2021-03-05T00:00:00"),
        "05-03-2021": ("D:20210305000000", "2021-03-05T00:00:00"),
        "2021-03-05 12:00": ("D:20210305120000", "2021-03-05T12:00:00"),
        "free text": (None, None),
    }
    d = spark.createDataFrame([(k,) for k in cases], "s string").withColumn("d", dates.parse_date(F.col("s")))
    got = d.select("s", dates.packed_date(F.col("d.moment"), F.col("d.offset_min")), dates.iso_date(F.col("d.moment"), F.col("d.offset_min")))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == cases


def test_zlib_headers_and_utf16(spark):
    import zlib

    data = [(bytearray(zlib.compress(b"x", level)),) for level in (1, 6, 9)] + [(bytearray(b"\x78"),), (bytearray(b"ab"),)]
    got = values(spark.createDataFrame(data, "b binary").coalesce(1).select(text.zlib_header(F.col("b"))))
    assert [tuple(x[0]) for x in got] == [(True, 0), (True, 2), (True, 3), (False, None), (False, None)]
    assert spark.createDataFrame([(bytearray("Яa".encode("utf-16-be")),)], "b binary").select(text.utf16be_text(F.col("b"))).first()[0] == "Яa"


def test_offsets_go_back_through_normalisation(spark):
    rows = spark.createDataFrame([(1, "oﬃce o ffice"), (2, None), (3, "")], "id long, t string")
    found = values(search.find_offsets(rows, search.Pattern("ffi"), "id", "t").orderBy("match_no"))
    assert [(i, n, s, e) for i, n, s, e, _ in found] == [(1, 0, 1, 2), (1, 1, 7, 10)]
    assert search.find_offsets(rows, search.Pattern("OFF", ignore_case=True), "id", "t").count() == 1
    assert rows.select(search.match_count(F.col("t"), search.Pattern("office", whole_word=True))).collect()[0][0] == 1
    assert rows.select(search.match_count(F.col("t"), search.Pattern(""))).collect()[0][0] == 0


def test_edits_are_atomic_and_spliced_from_the_end(spark):
    edits = spark.createDataFrame([(1, 7, True), (2, 7, False), (3, 0, True), (4, 0, False), (5, 8, None), (6, None, True)], "id int, g int, bad boolean")
    assert sorted(values(search.atomic(edits, F.col("bad"), "g").select("id", "applied"))) == [(1, False), (2, False), (3, False), (4, True), (5, True), (6, False)]
    made = spark.range(1).select(search.splice(F.lit("abcdef"), F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("Z").alias("text")), F.struct(F.lit(4).alias("start"), F.lit(4).alias("end"), F.lit("--").alias("text")))))
    assert made.first()[0] == "Zcd--ef"


def test_pieces_of_a_match(spark):
    chars = spark.createDataFrame([(1, 10, 3, 0), (1, 10, -1, 1), (1, 11, 0, 2), (1, 11, 1, 3)], "m int, run int, at int, pos int")
    got = sorted(values(search.edits_of(search.pieces(chars, ["m"], "run", "at", "pos"), ["m"], F.lit("new"), F.lit("old")).select("run", "start", "end", "piece_no", "new_text", "continuation")))
    assert got == [(10, 3, 4, 0, "new", False), (11, 0, 2, 1, "", True)]


def _run(i, x0, x1, text_="a", y0=0.0, size=10.0):
    return (1, i, x0, x1, y0, y0 + size, size, text_)


def test_lines_break_just_beyond_the_limits(spark):
    schema = "page int, run_id int, x0 double, x1 double, y0 double, y1 double, size double, text string"
    rows = [_run(1, 0.0, 10.0, "a"), _run(2, 35.0, 40.0, "b"), _run(3, 65.1, 70.0, "c"), _run(4, 71.9, 80.0, "d"), _run(5, 75.0, 90.0, "e"), _run(6, 84.9, 95.0, "f"), _run(7, 0.0, 5.0, "g", y0=50.0), _run(8, 5.0, 9.0, "h", y0=50.0)]
    made = layout.line_texts(layout.visual_lines(spark.createDataFrame(rows, schema), ["page"]), ["page"])
    assert sorted(r["text"] for r in made.collect()) == ["a b", "c de", "f", "gh"]


def test_consecutive_and_alignment(spark):
    keys = spark.createDataFrame([(1, k) for k in (5, 3, 4, 4, 9, 10)], "g int, k long")
    assert sorted(values(layout.consecutive(keys, ["g"], "k"))) == [(1, 3, 5, 3), (1, 9, 10, 2)]
    lines = [(1, b, i, float(x0), float(x1)) for b, rows in (("l", [(10, 90), (10, 70), (10, 80)]), ("r", [(50, 200), (70, 200), (60, 200)]), ("c", [(80, 120), (60, 140), (70, 130)])) for i, (x0, x1) in enumerate(rows)]
    got = layout.block_alignment(spark.createDataFrame(lines, "p int, b string, i int, x0 double, x1 double"), ["b"], "x0", "x1")
    assert dict(values(got.select("b", "alignment"))) == {"l": "left", "r": "right", "c": "center"}
    lone = spark.createDataFrame([(1, "a", 0, 40.0, 200.0, 400.0), (1, "n", 1, 300.0, 360.0, 400.0)], "p int, b string, i int, x0 double, x1 double, w double")
    assert dict(values(layout.line_alignment(lone, ["p"], "b", "i", "w").select("b", "alignment")))["n"] == "right"


def test_record_diff_has_every_kind_and_none_with_itself(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "x"), (4, "a", "x"), (5, "a", None)], "k int, h string, b string")
    right = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "a", "y"), (6, "a", "x"), (5, "b", "y")], "k int, h string, b string")
    got = dict(values(diff.record_diff(left, right, ["k"], {"head": "h", "body": "b"})))
    assert got == {1: "identical", 2: "changed head", 3: "changed body", 4: "removed", 5: "changed both", 6: "added"}
    assert {s for _, s in values(diff.record_diff(left, left, ["k"], {"head": "h", "body": "b"}))} == {"identical"}
    assert diff.value_diff(left, left, ["k"], "b").count() == 0
    assert sorted(values(diff.changed_records(left, right, ["k"], "b").select("k", "change"))) == [(3, "rewritten"), (5, "rewritten"), (6, "added")]
    assert sorted(values(diff.set_changes(left, right, ["k"]))) == [(4, "vanished"), (6, "new")]


def test_fingerprints_keep_columns_and_nulls_apart(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("abc", None), ("abc", "")], "a string, b string")
    assert rows.select(diff.fingerprint(F.col("a"), F.col("b")).alias("f")).distinct().count() == 4


def test_structures(spark):
    left = spark.createDataFrame([(1, '{"a": {"b": [1, 2]}, "c": "x"}'), (2, None)], "k int, d string")
    right = spark.createDataFrame([(1, '{"a": {"b": [1, 3, 4]}, "c": 5}')], "k int, d string")
    got = {(p, s) for _, p, s, _, _ in values(diff.structure_diff(diff.map_nodes(left, ["k"], "d"), diff.map_nodes(right, ["k"], "d"), ["k"]))}
    assert got == {("$.a.b", "value"), ("$.a.b[1]", "value"), ("$.a.b[2]", "added"), ("$.c", "type")}


def test_sequence_diff_is_that_of_the_library(spark):
    rows = [(i, " ".join(random.Random(i).choices("abcd", k=8)), " ".join(random.Random(i + 50).choices("abcd", k=8))) for i in range(10)]
    got = sorted(values(diff.sequence_diff(spark.createDataFrame(rows, "k int, a string, b string"), ["k"], "a", "b", " ")))
    want = sorted((i, *o) for i, a, b in rows for o in difflib.SequenceMatcher(None, a.split(" "), b.split(" "), autojunk=False).get_opcodes() if o[0] != "equal")
    assert got == want


def test_band_nearest_equals_brute_force(spark):
    rng = random.Random(2)
    points = [(i, 1, rng.randint(0, 1000)) for i in range(50)]
    bands = [(i, 1, a, a + rng.randint(0, 300)) for i, a in enumerate(rng.randint(-100, 1000) for _ in range(40))]
    near = match.band_nearest(spark.createDataFrame(points, "p int, g int, at int"), spark.createDataFrame(bands, "b int, g int, low int, high int"), "p", ["g"], "at", "low", "high", 64.0, F.abs(F.col("at") - F.col("low")), F.col("b"))
    want = {}
    for p, _, at in points:
        inside = [(abs(at - low), b) for b, _, low, high in bands if low <= at <= high]
        if inside:
            want[p] = min(inside)[1]
    assert dict(values(near.select("p", "b"))) == want


def test_majority_tie_goes_to_the_default(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "d"), (2, "x"), (2, "x"), (2, "d"), (3, "b"), (3, "a")], "g int, v string")
    got = dict(values(match.majority(rows, ["g"], "v", F.lit("d"), F.col("v")).select("g", "v")))
    assert got == {1: "d", 2: "x", 3: "a"}


def test_minority_counts_no_more_than_there_is(spark):
    rows = [(1, i, i < 1) for i in range(5)] + [(2, i, i < 1) for i in range(3)] + [(3, i, i < 2) for i in range(4)]
    got = sorted(values(match.minority(spark.createDataFrame(rows, "g int, i int, k boolean"), ["g"], F.col("k")).select("g", "i")))
    assert got == [(1, 0), (3, 2), (3, 3)]


def test_reachability_with_a_cycle_and_a_dangling_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "x"), ("z", "y"), ("b", None)], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert sorted(values(graph.reachable(edges, roots))) == [("a", 0), ("b", 1), ("c", 2), ("x", 3)]
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert sorted(values(graph.dangling(edges, nodes).select("src", "dst"))) == [("c", "x"), ("z", "y")]


def test_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, None), (1, 2, "b"), (2, 1, "c")], "k int, rev int, v string")
    assert sorted(values(versions.latest(rows, ["k"], ["rev"]).select("k", "v"))) == [(1, None), (2, "c")]
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(1, None), (3, "n")], "k int, v string")
    assert sorted(values(versions.merge(base, updates, ["k"], "v"))) == [(2, "b"), (3, "n")]
    assert versions.append_revision(str(tmp_path / "t"), base, updates, ["k"], 2) == 2
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect()), key=str) == [(1, None, 2), (3, "n", 2)]
    with pytest.raises(OSError, match="there already"):
        versions.append_revision(str(tmp_path / "t"), base, updates, ["k"], 2)
    uneven = base.withColumn("v", F.udf(lambda: str(uuid.uuid4())).asNondeterministic()())
    with pytest.raises(OSError, match="did not arrive"):
        versions.append_revision(str(tmp_path / "t"), base, uneven, ["k"], 3)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    routed = versions.routed(base, [(F.col("k") == 1, "first"), (F.col("v") == "a", "second")])
    assert sorted(values(routed.select("k", "route", "reason"))) == [(1, "deferred", "first"), (2, "in_place", None)]


def test_rules_tell_passed_from_not_run(spark):
    data = spark.createDataFrame([(1, -5), (2, 5), (3, -1)], "id int, v int")
    own = [rules.Rule("negative", "trace", lambda: data.filter("v < 0"), "id", "below zero"), rules.Rule("huge", "note", lambda: data.filter("v > 100"), "id", "too much")]
    assert sorted(values(rules.outcome(own))) == [("huge", "note", 0, True), ("negative", "trace", 2, False)]
    assert values(rules.report(rules.findings(own), 1).select("key", "subject", "total")) == [("negative", "1", 2)]
    fails = F.raise_error(F.lit("broken input")).cast("boolean")
    broken = [rules.Rule("planned", "trace", lambda: data.filter("no_such_column > 1"), "id", "x"), rules.Rule("running", "trace", lambda: data.filter((F.col("v") > 0) & fails), "id", "x")]
    found = sorted(values(rules.checked([broken[0], own[0], broken[1]]).select("key", "severity", "subject")))
    assert found == [("check-failed", "note", "planned"), ("check-failed", "note", "running"), ("negative", "trace", "1"), ("negative", "trace", "3")]
    assert values(rules.overall(rules.outcome(own))) == [(2, 2, True, False)]
    notes = spark.createDataFrame([("stream data is invalid", 1), ("loose", 2), ("loose", 3)], "t string, n int")
    assert sorted(values(rules.distinct_notes(notes.withColumn("s", rules.note_severity(F.col("t"))), ["s"], "t", "n"))) == [("error", "stream data is invalid", 1), ("warning", "loose", 2)]


def test_greedy_parts(spark):
    got = match.longest_match_parts(spark.createDataFrame([(1, "office.\n"), (2, None)], "id int, t string"), "id", "t", ["ff", "ffi", "of"])
    assert [(r["part"], r["known"]) for r in got.orderBy("id", "part_no").collect()] == [("of", True), ("f", False), ("i", False), ("c", False), ("e", False), (".", False), ("\n", False)]


@pytest.mark.parametrize("mode,old,new,want", [("auto", 10.0, 10.5, "squeeze"), ("auto", 10.0, 12.0, "natural"), ("auto", 10.0, 0.0, "natural"), ("squeeze", 1.0, 9.0, "squeeze")])
def test_fit_modes(spark, mode, old, new, want):
    assert one(spark, text.fit_mode(F.col("m"), F.col("o"), F.col("n")), m=mode, o=old, n=new) == want


def test_replacing_changes_what_matched_and_nothing_else(spark):
    """Hard spaces, dashes, ligatures and quotes around a match stay; only the match goes."""
    kept = "caf\u00a0– ﬁx MIT “q”"
    rows = [(1, kept), (2, "oﬃce, oﬃ"), (3, "plain MIT MIT"), (4, None), (5, "a$1\\\\b")]
    docs = spark.createDataFrame(rows, "id long, t string")
    swap = lambda p, to: {r[0]: r[1] for r in docs.select("id", search.replace_matches(F.col("t"), p, to)).collect()}
    assert swap(search.Pattern("MIT"), "X$1") == {1: kept.replace("MIT", "X$1"), 2: rows[1][1], 3: "plain X$1 X$1", 4: None, 5: rows[4][1]}
    assert swap(search.Pattern("caf - fi"), "Y")[1] == "Yx MIT “q”"
    assert swap(search.Pattern("f(.)c", regex=True), r"<\1>")[2] == "o<i>e, oﬃ"
    assert swap(search.Pattern("M*", regex=True), "-")[3] == "plain -IT -IT"
    assert swap(search.Pattern(""), "-")[3] == "plain MIT MIT"


def test_the_first_matches_of_all_are_replaced(spark):
    docs = spark.createDataFrame([(2, "x x x"), (1, "no “x” x"), (3, "x"), (4, None)], "id long, t string").repartition(3)
    for count, want in ((4, {1: ("no “y” y", 2), 2: ("y y x", 2), 3: ("x", 0), 4: (None, 0)}), (0, {1: ("no “y” y", 2), 2: ("y y y", 3), 3: ("y", 1), 4: (None, 0)})):
        got = search.replace_first(docs, search.Pattern("x"), "y", "id", "t", count)
        assert {r["id"]: (r["t"], r["n_replaced"]) for r in got.collect()} == want
        plan = search.replacement_plan(docs, search.Pattern("x"), "y", "id", "t", count)
        assert plan.count() == sum(n for _, n in want.values())
    pages = spark.createDataFrame([(1, "two\nlines"), (2, "two lines"), (3, "else")], "id long, t string")
    assert [r["id"] for r in search.not_found_hints(pages, search.Pattern("two lines"), "id", "t").collect()] == [1]


def test_a_match_over_several_runs_is_found_and_edited_as_one(spark):
    """A number of seven runs of one character, a word beside it, and the same number in another stream of the page."""
    digits = [(1, s, 10 * s + i, 10.0, 5.0 * i, 5.0 * i + 5, 0.0, 10.0, c) for s in (1, 2) for i, c in enumerate("1234567")]
    rows = [*digits, (1, 1, 50, 10.0, 38.0, 60.0, 0.0, 10.0, "oﬃce")]
    runs = spark.createDataFrame(rows, "page int, stream int, run_id int, size double, x0 double, x1 double, y0 double, y1 double, text string")
    lines = layout.visual_lines(runs, ["page", "stream"])
    find = lambda p: search.find_grouped(lines, ["page", "stream"], p, layout.SPACE_GAP)
    found = find(search.Pattern("345"))
    pieces = sorted((r["stream"], r["piece_no"], r["run_id"], r["start"], r["end"]) for r in found.collect())
    assert pieces == [(s, k, 10 * s + 2 + k, 0, 1) for s in (1, 2) for k in range(3)]
    edits = search.edits_of(found.filter("stream = 1"), ["page", "stream", "line_no", "match_no"], F.lit("9"), F.col("matched"))
    assert sorted((r["run_id"], r["new_text"], r["old_text"], r["continuation"]) for r in edits.collect()) == [(12, "9", "345", False), (13, "", "", True), (14, "", "", True)]
    assert edits.select("group").distinct().count() == 1 and edits.first()["group"] != 0
    across = sorted((r["matched"], r["run_id"], r["start"], r["end"]) for r in find(search.Pattern("7 offi")).collect())
    assert across == [("7 offi", 16, 0, 1), ("7 offi", 50, 0, 2)]
    assert find(search.Pattern("")).count() == 0


def test_top_rows_keep_totals(spark):
    rows = spark.createDataFrame([(None, i) for i in range(7)] + [("a", i) for i in range(3)], "g string, n int")
    got = sorted(values(search.top_rows(rows, ["g"], [F.desc("n")], 2).select("g", "n", "rank", "total")), key=str)
    assert got == sorted([(None, 6, 1, 7), (None, 5, 2, 7), ("a", 2, 1, 3), ("a", 1, 2, 3)], key=str)


def test_nearest_by_buckets_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.choice("xyz"), rng.randint(0, 30)) for i in range(120)] + [(500, "c", "x", 5), (501, None, "x", 5)]
    buckets = [["g", "h"], ["g"]]
    got = match.nearest_by_buckets(spark.createDataFrame(rows, "i long, g string, h string, v long").repartition(3), "i", buckets, "v")
    want = {}
    for i, g, h, v in rows:
        if g is not None:
            for no, same in enumerate((lambda r: (r[1], r[2]) == (g, h), lambda r: r[1] == g)):  # noqa: B023
                others = [(abs(r[3] - v), r[0]) for r in rows if r[0] != i and same(r)]
                if others and i not in want:
                    want[i] = (min(others)[1], no)
    assert {r["i"]: (r["candidate"], r["bucket"]) for r in got.collect()} == want


def test_detectors_find_what_is_planted_and_nothing_else(spark):
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    said = lambda df: sorted((r["key"], r["subject"]) for r in df.collect())
    assert said(detect.stream_tails(frame("path string, num int, gen int, tail int", ("a", 1, 0, 3), ("b", 1, 0, 0)))) == [("stream-tail", "a")]
    assert said(detect.extra_revisions(frame("path string, n_eof int", ("a", 1), ("b", 3)))) == [("revisions", "b")]
    widths = frame("font string, code int, program_width double, stated_width double", ("f", 1, 500.0, 501.0), ("g", 2, 500.0, 501.5), ("h", 3, 0.0, 600.0))
    assert said(detect.width_mismatches(widths)) == [("width-mismatch", "g")]
    glyphs = frame("font string, gid int, n_bytes int", ("f", 0, 9), ("f", 1, 9), ("f", 2, 9), ("f", 3, 0), ("f", 4, 9))
    parts = frame("font string, gid int, part int", ("f", 1, 2), ("f", 9, 4))
    assert [r["text"] for r in detect.orphan_glyphs(glyphs, frame("font string, gid int", ("f", 1)), parts).collect()] == ["glyph 4 is reached by nothing"]
    fonts = "font string, modified long, tables array<string>, hinted boolean"
    before = frame(fonts, ("a", 1, ["x", "y", "z"], True), ("b", 1, ["x", "y"], True), ("gone", 1, ["x"], True))
    after = frame(fonts, ("a", 2, ["z", "x"], False), ("b", 1, ["x", "new", "y"], True))
    assert said(detect.font_changes(before, after, ["font"])) == [("font-date", "a"), ("hinting", "a"), ("table-order", "a")]
    levels = "path string, level int"
    assert said(detect.recompressed(frame(levels, ("a", 1), ("b", 2), ("c", None)), frame(levels, ("a", 2), ("b", 2), ("c", 1)), ["path"])) == [("compression-level", "a")]
    signed = frame("path string, field string, byte_range array<long>, size long", ("a", "s", [0, 10, 20, 80], 100), ("b", "s", [0, 100, 200, 100], 301), ("c", "s", [], 5), ("d", "s", None, 5))
    assert said(detect.uncovered_signatures(signed)) == [("signature-coverage", x) for x in "bcd"]
    changes = frame("doc string, key string, before string, after string", ("a", "/ModDate", "1", "2"), ("a", "/Producer", None, "x"))
    assert said(detect.identity_changes(changes, "doc", ["/ModDate", "/CreationDate"])) == [("date-changed", "a"), ("metadata-changed", "a")]
    maps = frame("l map<string,string>, r map<string,string>", ({"/Length": "1", "/A": "x"}, {"/A": "x"}), ({"/A": "x"}, {"/A": "y"}))
    assert [r[0] for r in maps.select(detect.same_dictionary(F.col("l"), F.col("r"))).collect()] == [True, False]


def test_small_operators_over_runs_and_fonts(spark):
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    runs = frame("p int, run_id int, x0 double, y1 double, text string", (1, 1, 50.0, 700.04, "b"), (1, 2, 10.0, 700.0, "a"), (1, 3, 10.0, 650.0, "c"), (2, 4, 0.0, 1.0, "d"))
    assert dict(values(layout.reading_text(runs, ["p"]))) == {1: "a\nb\nc", 2: "d"}
    widths = frame("p int, line int, old double, new double", (1, 1, 10.0, 12.0), (1, 1, 5.0, 4.0), (1, 2, 3.0, 3.0))
    assert sorted(values(layout.line_shifts(widths, ["p"], "line", "old", "new"))) == [(1, 1, 1.0), (1, 2, 0.0)]
    assert [r["i"] for r in match.editable(frame("i int, n int, d boolean", (1, 2, False), (2, 0, False), (3, 2, True)), "n", "d").collect()] == [1]
    assert values(match.codes_in_use(frame("f string, code int", ("a", 7), ("a", 3), ("a", 7)), ["f"], "code")) == [("a", [3, 7])]
    codes = frame("f string, code int", ("a", 1), ("a", 2), ("a", 3), ("b", 1))
    got = match.with_glyphs(codes, frame("f string, code int, gid int", ("a", 1, 10), ("a", 2, 20), ("b", 1, 5)), frame("f string, gid int", ("a", 10)), ["f"])
    assert sorted(values(got.select("f", "code", "has_glyph"))) == [("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, True)]
    changes = frame("key string, before string", ("/Title", "x"), ("{http://purl.org/dc/elements/1.1/}title", "x"), ("xmp:ModifyDate", "y"))
    assert [r["key"] for r in diff.undeclared(changes, frame("field string", ("/Title",))).collect()] == ["xmp:ModifyDate"]
    parts = frame("g int, a string, b int", (1, "x", 1), (1, "y", None), (2, "y", None), (2, "x", 1), (3, "x", 2))
    digests = dict(values(diff.summary_digest(parts, ["g"], [F.col("a"), F.col("b")])))
    assert digests[1] == digests[2] != digests[3]
    need = match.required_characters(frame("f string, t string", ("a", "ba"), ("a", "cb"), ("b", "")), ["f"], "t")
    assert values(need) == [("a", ["a", "b", "c"])]
    assert spark.range(1).select(match.missing_characters(F.lit("xaxyz"), F.array(F.lit("a"), F.lit("z")))).first()[0] == ["x", "y"]
    e = spark.createDataFrame([("abcdef", "abXdef"), ("same", "same"), ("", "new"), ("aaa", "aa"), ("ab", "axb")], "o string, n string")
    for o, n, edit in e.select("o", "n", text.minimal_edit(F.col("o"), F.col("n"))).collect():
        assert (edit is None) == (o == n)
        if edit:
            assert o[: edit["start"]] + edit["replacement"] + o[edit["end"] :] == n
