"""Queries over whole texts and all rows, on small tables against what they must hold."""

import re

from quillon.operators.search import plain_normalise
from quillon.plans import queries

TURNS = "conv_id long, turn int, role string, text string"


def stored(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_line_texts_hold_whole_turns(spark, tmp_path):
    first, second = "a turn of many words " * 30 + "end", "another turn, longer than twelve characters"
    sf = stored(spark, tmp_path, "conversations", [(1, 0, "user", first), (1, 1, "bot", second)], TURNS)
    rows = queries.line_texts(spark, sf).orderBy("line_no").collect()
    assert [t for r in rows for t in re.findall(f"{first}|{second}", r["text"])] == [first, second]


def test_whole_words_of_every_document(spark, tmp_path):
    texts = ["the end", "éthe theé the", "naïvethe, the_ the2 «the»", "жthe theж the–the", None, "THE the"]
    langs = ["en", "fr", None, "de", "es", "fr"]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs))]
    sf = stored(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string")
    expected = {i: len(re.findall(r"(?<!\w)the(?!\w)", plain_normalise(t or ""))) for i, t, _ in rows}
    assert dict(queries.find_whole_word(spark, sf).collect()) == expected == {0: 1, 1: 1, 2: 1, 3: 2, 4: 0, 5: 1}


def test_nearest_band_of_any_other_order(spark, tmp_path):
    orders = [(1, 7, 50_000.0), (2, 7, 51_000.0), (3, 7, 50_100.0), (4, 7, 65_000.0), (5, 7, 200_000.0), (6, 8, 50_000.0), (7, 8, 50_000.0)]
    sf = stored(spark, tmp_path, "orders", orders, "o_orderkey long, o_custkey long, o_totalprice double")
    expected = {}
    for key, cust, price in orders:
        near = [(abs(price - p), k) for k, c, p in orders if c == cust and k != key and abs(price - p) <= 20_000]
        if near:
            expected[key] = min(near)[1]
    assert dict(queries.nearest_line(spark, sf).collect()) == expected == {1: 3, 2: 3, 3: 1, 4: 2, 6: 7, 7: 6}


def test_hidden_copies_differ_after_their_first_characters(spark, tmp_path):
    shown = "The price is 100 euros."
    copies = ["The price is 900 euros.", " price is 100 ", shown, "Th", "", "Another text"]
    rows = [(i, t, "user", text) for i, c in enumerate(copies) for t, text in ((0, shown), (2, c))]
    sf = stored(spark, tmp_path, "conversations", rows, TURNS)
    expected = {i for i, c in enumerate(copies) if c.strip(" ") and c.strip(" ") not in shown}
    assert {r["conv_id"] for r in queries.hidden_copies(spark, sf).collect()} == expected == {0, 5}
