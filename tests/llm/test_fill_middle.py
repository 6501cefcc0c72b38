"""Fill-in-middle against a plain construction over code points, exact round trips, and the cases its docstring defines."""

import hashlib
import random
import re

import pytest

from quillon.llm import fill_middle as fim
from quillon.llm import registry

SCHEMA = "doc_id long, text string, n long, form string, output string, draw string"


def plain(text, row_id, plan):
    """The same by regular expressions over the whole text."""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if plan.unit == fim.LINE else list(text)
    n, h = len(units), [int(hashlib.sha256(f"{plan.seed}:{row_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in (plan.prefix, plan.suffix, plan.middle)) or h[2] % 100 >= plan.fim_percent:
        return n, "plain", None, None, text
    low, high = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < plan.spm_percent:
        return n, "spm", len(a), len(b), plan.suffix + c + plan.prefix + a + plan.middle + b
    return n, "psm", len(a), len(b), plan.prefix + a + plan.suffix + c + plan.middle + b


def texts(n, seed=5):
    rng = random.Random(seed)
    alphabet = ["a", "é", "\U0001f600", "\n", "\n\n", "<", "P>", "<S", " ", "\r\n", "\x85", "中文 line\n"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 3, 30, 400]))) for _ in range(n)]


@pytest.mark.parametrize("unit", [fim.LINE, fim.CHARACTER])
def test_checkpoints_locate_every_cut_whatever_the_step_and_window(unit):
    for text in texts(60):
        data = text.encode()
        units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == fim.LINE else list(text)
        for step, window in ((1, 7), (3, 16), (64, 1 << 16), (5, 1)):
            index = fim.Checkpoints(data, unit, step, window)
            assert index.n == len(units) and index.chars == len(text)
            assert index.units == list(range(0, max(1, len(units)), step))
            for cut in range(len(units) + 1):
                head = "".join(units[:cut])
                assert index.locate(cut) == (len(head.encode()), len(head))


@pytest.mark.parametrize("plan", [fim.Plan(), fim.Plan(unit=fim.CHARACTER, fim_percent=60, spm_percent=30, seed=1), fim.Plan(prefix="<|pre|>", suffix="<|suf|>", middle="<|mid|>", spm_percent=100)])
def test_rows_equal_the_plain_construction_and_come_back(spark, plan):
    rows = [(i, t, 1, "x", "y", None) for i, t in enumerate([None, "", "no line end", "one\n", "<P> stays", "\n", "x" * 300_000 + "\n" + "é\n" * 50_000, *texts(80, 9)])]
    rows += [rows[7], rows[7], (None, "a\nb\nc\n", None, None, None, None), (7, "another\ntext\n", None, None, None, None)]
    made = fim.fill_in_middle(spark.createDataFrame(rows, SCHEMA).repartition(3), plan)
    got = sorted(made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(made.output, made.form, plan)).collect(), key=repr)
    expected = sorted(((i, *plain(t or "", "" if i is None else i, plan), t or "") for i, t, *_ in rows), key=repr)
    assert [tuple(r) for r in got] == expected
    assert {"psm", "spm", "plain"} - {r["form"] for r in got} == ({"psm"} if plan.spm_percent == 100 else set())


def test_an_empty_table_gives_an_empty_one(spark):
    made = fim.fill_in_middle(spark.createDataFrame([], SCHEMA))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and made.count() == 0


def test_query_equals_its_sql(spark):
    import duckdb

    duck = duckdb.connect()
    duck.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    made = registry.op13_fill_in_middle(spark, "/root/testdata/sf0.001")
    own = duck.sql(registry.ORACLES["op13_fill_in_middle"])
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(own.select(*made.columns).fetchall(), key=repr)
