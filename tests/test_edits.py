"""Edits, containment and donors against plain constructions over the same rows."""

import random

from quillon.operators import contain, edits, match, rules


def values(df):
    return [tuple(r) for r in df.collect()]


def brute_apply(asked, runs):
    """(texts that changed, {edit_id: (reason, cause)})."""
    held, told = {r[0]: r for r in runs}, {}
    for e, run, a, z, new, _ in asked:
        if run not in held:
            told[e] = "no such run"
            continue
        _, text, editable, _, characters = held[run]
        lacks = "".join(c for c in dict.fromkeys(new or "") if c not in characters) if characters is not None else ""
        if not editable:
            told[e] = "the run can't be edited"
        elif a is None or z is None or a < 0 or a >= z or z > len(text):
            told[e] = "range outside the run"
        elif lacks:
            told[e] = f"no glyphs for: {lacks}"
    good = sorted((run, a, e, z) for e, run, a, z, *_ in asked if e not in told)
    reach = {}
    for run, a, e, z in good:
        if reach.get(run, 0) > a:
            told[e] = "overlaps an earlier edit"
        reach[run] = max(reach.get(run, 0), z)
    cause = {e: e for e in told}
    while True:
        new = dict(cause)
        for e, run, *_, g in asked:
            near = [x[0] for x in asked if (g and x[5] == g) or (run in held and held[run][3] and x[1] == run) or x[0] == e]
            least = [new[x] for x in near if x in new]
            if least:
                tied = g or (run in held and held[run][3])
                new[e] = min(least) if tied else new[e]
        if new == cause:
            break
        cause = new
    texts = {}
    for run, text, *_ in runs:
        own = sorted((a, z, new or "") for e, r, a, z, new, _ in asked if r == run and e not in cause)
        if own:
            made, at = "", 0
            for a, z, new in own:
                made, at = made + text[at:a] + new, z
            texts[run] = (made + text[at:], len(own))
    return texts, {e: (told.get(e), cause.get(e)) for e, *_ in asked}


def test_apply_edits(spark, monkeypatch):
    monkeypatch.setattr(edits, "CELL", 4)
    rng = random.Random(1)
    runs = [(i, "".join(rng.choice("abÉ文 ") for _ in range(rng.randint(15, 60))), rng.random() > 0.05, rng.random() < 0.2, list("abcxyz") if rng.random() < 0.2 else None) for i in range(80)]
    asked = []
    for e in range(220):
        a = rng.randint(0, 30)
        asked.append((e, rng.randint(0, 81), a, a + rng.choice([0, 1, 1, 1, 2, 2, 3]), rng.choice(["xyz", "x", "", None, "É"]), rng.choice([0, None]) if e % 3 else rng.randint(1, 60)))
    asked += [(500, 1, None, 2, "x", 0), (501, 2, -1, 2, "x", 0), (502, None, 0, 1, "x", 7)]
    table = spark.createDataFrame(asked, "edit_id int, run_id int, start int, end int, new_text string, group int").repartition(3)
    changed, report = edits.apply_edits(table, spark.createDataFrame(runs, "run_id int, text string, editable boolean, whole boolean, characters array<string>"))
    texts, told = brute_apply(asked, runs)
    assert {e: (reason, cause) for e, reason, cause in values(report.select("edit_id", "reason", "cause"))} == told
    assert all(applied == (cause is None) for applied, cause in values(report.select("applied", "cause")))
    assert {r: (t, n) for r, t, n in values(changed)} == texts and len(texts) > 20


def test_a_refusal_goes_through_a_long_chain_of_groups_and_runs(spark):
    asked = [(k, k // 2, 2 * (k % 2), 2 * (k % 2) + 1, "x", (k + 1) // 2 + 1) for k in range(200)] + [(900, 300, 0, 1, "x", 0), (901, 301, 9, 10, "x", 0)]
    runs = [(i, "abcd", True, True, None) for i in range(100)] + [(300, "abcd", True, True, None), (301, "abcd", True, False, None)]
    table, held = spark.createDataFrame([*asked, (1000, 99, 50, 51, "x", 0)], "edit_id int, run_id int, start int, end int, new_text string, group int"), spark.createDataFrame(runs, "run_id int, text string, editable boolean, whole boolean, characters array<string>")
    changed, report = edits.apply_edits(table, held)
    assert {c for e, c in values(report.select("edit_id", "cause")) if e < 200 or e == 1000} == {1000}
    assert values(changed) == [(300, "xbcd", 1)]


def test_containment_equals_a_search_of_every_text(spark):
    rng = random.Random(4)
    words = ["the", "of", "Lïcense", "a_b", "x1", "文字", "rare", "-", "..", "THE"]
    texts = [(i, rng.choice(["", " "]).join(rng.choices(words, [9, 9, 3, 2, 2, 2, 1, 3, 2, 2], k=rng.randint(0, 12)))) for i in range(150)] + [(900, None), (901, ""), (902, "the of " * 20_000 + "rare the")]
    patterns = [(0, "the of the"), (1, "the"), (2, "h"), (3, "he of th"), (4, ""), (5, None), (6, "rare the"), (7, "no such words here"), (8, "x1 x1"), (9, ".."), (10, "文"), (11, "Lïc"), (12, " rare "), (13, "the of the")]
    got = contain.contained(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame(patterns, "p int, old string"), "p", "old")
    assert sorted(values(got)) == sorted((i, p) for i, t in texts for p, s in patterns if t and s and s in t)
    same = rules.stale_copies_of(spark.createDataFrame(texts, "id int, text string"), "id", "text", spark.createDataFrame([], "p int, old string"), "p", "old")
    assert same.columns == ["id", "p"] and same.count() == 0


def key(name):
    import re

    return re.sub("[^a-z0-9]", "", re.sub(r"^[A-Z]{6}\+", "", (name or "").lstrip("/")).lower())


def brute_donor(request, fonts, only_priority):
    import re

    _, name, bold, italic, weight, need = request
    target, stem = key(name), key(re.split("[-,]", re.sub(r"^[A-Z]{6}\+", "", (name or "").lstrip("/")))[0])
    best = None
    for ord_, ps, family, b, i, w, priority, has in fonts:
        if only_priority and not priority or any(c not in has for c in need or []):
            continue
        style, ps, family = (b, i) == (bold, italic), key(ps), key(family)
        if target and ps == target:
            bucket = 0
        elif stem and family == stem:
            bucket = 1 if style else 2
        elif target and (target in ps or family and family in target):
            bucket = 3 if style else 4
        else:
            continue
        best = min(best or (True, 9, 0, 0), (not priority, bucket, abs(w - weight), ord_))
    return best and (best[3], best[1])


def test_donors(spark):
    rng = random.Random(6)
    stems = ["Arial", "Times New", "Min-ion", "Arial Narrow", "Bold", "", "Ar"]
    letters = "abcdéż文\U0001f600"
    fonts = [(k, rng.choice(stems) + rng.choice(["", "-Bold", "MT"]), rng.choice(stems), rng.random() < 0.5, rng.random() < 0.5, rng.choice([300, 400, 700]), rng.random() < 0.2, rng.sample(list(letters), rng.randint(0, 8))) for k in range(120)]
    asked = [(k, rng.choice(["", "ABCDEF+", "/"]) + rng.choice([*stems, "Unknown", "XArialX"]) + rng.choice(["", "-Bold", ",Italic"]), rng.random() < 0.5, rng.random() < 0.5, rng.choice([300, 400, 650]), rng.choice([None, [], ["a"], ["é", "文"], list("abcd"), ["\U0001f600", "ż"], ["Q"], [""]])) for k in range(150)]
    f = spark.createDataFrame(fonts, "ord int, ps_name string, family string, bold boolean, italic boolean, weight int, priority boolean, characters array<string>")
    q = spark.createDataFrame(asked, "request_id int, name string, bold boolean, italic boolean, weight int, characters array<string>")
    for only in (False, True):
        want = {r[0]: brute_donor((*r[:5], [c for c in r[5] or [] if c]), fonts, only) for r in asked}
        got = {r: (o, b) for r, o, b in values(match.donor_choice(q, f, only))}
        assert got == {r: w for r, w in want.items() if w} and len(got) > 20
