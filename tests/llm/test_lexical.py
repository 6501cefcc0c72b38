"""Ranked lexical search against brute force over every document, with ties, odd rows and trees of several heights."""

import math
import random
import re

import numpy as np
import pytest

from quillon.llm import lexical, registry

SCHEMA = "doc_id long, text string, item_id long, score long, term string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """(item, rank, id, score) as the contract defines them."""
    held = [(i, words(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, n_terms, df = len(held), sum(len(w) for _, w in held), {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(words(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, w in held:
            m = 100 - 50 + (50 * len(w) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * w.count(t)) // (1000 * w.count(t) + 20 * m)) for t in terms if t in df and t in w)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def corpus(n, seed=2):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "a", "É", "é", "中文", "x1", "ﬀ", *(f"w{k}" for k in range(40))]
    weight = [1 / (k + 1) for k in range(len(vocabulary))]
    return [(i, " ".join(rng.choices(vocabulary, weight, k=rng.choice([1, 3, 8, 40])))) for i in range(n)]


@pytest.mark.parametrize("block,fan,k", [(7, 2, 5), (64, 4, 50), (1000, 32, 3)])
def test_equal_to_brute_force_with_ties(spark, block, fan, k):
    docs = corpus(300) + [(1000 + i, "w3 w5 same text") for i in range(40)] + [(None, "w3 w5 same text"), (5, "w7 repeated id"), (5, "w7 repeated id"), (2000, None), (2001, ""), (2002, " .,- "), (2003, "the " * 60_000 + "w39")]
    items = [(1, "w3 w5"), (2, "THE the The"), (3, "É é ﬀ"), (4, None), (5, "unknown words"), (6, "w39-w38_w37"), (6, "w1"), (None, "中文 x1"), (7, ""), (8, "same w7")]
    table = spark.createDataFrame([(i, t, None, 3, "z") for i, t in docs], SCHEMA).repartition(3)
    asked = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = lexical.top_documents(table, asked, k, block=block, fan=fan)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, k)


def test_items_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", 3)
    docs, items = corpus(60), [(i, f"w{i} w{i + 9} the") for i in range(12)]
    got = lexical.top_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items, 4)


def test_few_nodes_are_opened_where_few_documents_can_win():
    rng = np.random.default_rng(4)
    n, n_terms = 20_000, 2_000
    terms = np.sort(rng.integers(0, n_terms - 1, (n, 5)), axis=1)
    terms[777, 4], terms[15_000, 4] = n_terms - 1, n_terms - 1
    values = rng.integers(1, 100, terms.size)
    tree = lexical.MaxTree(np.arange(n + 1) * 5, terms.ravel(), values, n_terms)
    weight = np.zeros(n_terms, np.int64)
    weight[n_terms - 1], weight[3] = 100_000, 1
    best: list = []
    tree.search(weight, best, 2, list(range(n)))
    assert {-d for _, d in best} == {777, 15_000} and tree.opened <= 8 and tree.scored <= 2


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.top_documents(none, some).collect() == []
    made = lexical.top_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), some.limit(0))
    assert made.columns == ["item_id", "rank", "doc_id", "score"] and made.collect() == []


def test_query_equals_its_sql(spark):
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    made = registry.op11_lexical_search(spark, "/root/testdata/sf0.001")
    own = duck.sql(registry.ORACLES["op11_lexical_search"])
    assert sorted(map(tuple, made.collect())) == sorted(own.select(*made.columns).fetchall())
