"""Comparing snapshots: keyed records, long key-value rows, sets, flattened structures, and sequences."""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.session import release, written

from .layout import running


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns' texts, each led by its length, so no two lists of values give one string; null differs from empty."""
    one = lambda c: F.when(c.isNull(), F.lit("n;")).otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"), F.lit(";")))
    return F.sha2(F.concat(*[one(c) for c in columns]), 256)


def record_diff(left: DataFrame, right: DataFrame, keys: list[str], parts: dict[str, str]) -> DataFrame:
    """Full outer join on keys (unique on either side): `status` is identical, removed, added, or 'changed' with what changed.

    parts: name to the column that holds that part's fingerprint; one that changed alone gives its name, several 'both'.
    """
    a = left.select(*keys, F.struct(*parts.values()).alias("l"))
    b = right.select(*keys, F.struct(*parts.values()).alias("r"))
    changed = F.filter(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(name)) for name, c in parts.items()]), lambda x: x.isNotNull())
    status = F.when(F.col("r").isNull(), "removed").when(F.col("l").isNull(), "added").when(F.size(changed) == 0, "identical").when(F.size(changed) == 1, F.concat(F.lit("changed "), F.element_at(changed, 1))).otherwise("changed both")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def value_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Long rows (keys, value): those that differ, with before, after, and whether each side has the key. An absent key differs from a null value."""
    a = left.select(*keys, F.col(value).alias("before"), F.lit(True).alias("in_left"))
    b = right.select(*keys, F.col(value).alias("after"), F.lit(True).alias("in_right"))
    both = a.join(b, keys, "full_outer").withColumns({"in_left": F.coalesce("in_left", F.lit(False)), "in_right": F.coalesce("in_right", F.lit(False))})
    return both.filter(~F.col("before").eqNullSafe(F.col("after")) | (F.col("in_left") != F.col("in_right")))


def unpivot(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows to (keys, key, value) with values as text."""
    return rows.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(keys, columns, "key", "value")


def structure_diff(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Flattened nodes (keys, path, type, value): vanished, added, another type or another value."""
    a = left.select(*keys, "path", F.struct("type", "value").alias("l"))
    b = right.select(*keys, "path", F.struct("type", "value").alias("r"))
    status = F.when(F.col("r").isNull(), "vanished").when(F.col("l").isNull(), "added").when(~F.col("l.type").eqNullSafe(F.col("r.type")), "type").when(~F.col("l.value").eqNullSafe(F.col("r.value")), "value")
    return a.join(b, [*keys, "path"], "full_outer").select(*keys, "path", status.alias("status"), F.col("l.value").alias("before"), F.col("r.value").alias("after")).filter(F.col("status").isNotNull())


def map_nodes(rows: DataFrame, keys: list[str], document: str) -> DataFrame:
    """A JSON text column to its nodes, one row per path ($ is the root), objects and arrays with their size as value. Depth follows the data."""

    def run(batches):
        import json

        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                stack = [("$", json.loads(text))] if text else []
                while stack:
                    path, node = stack.pop()
                    if isinstance(node, dict):
                        stack += [(f"{path}.{k}", v) for k, v in node.items()]
                        kind, value = "object", str(len(node))
                    elif isinstance(node, list):
                        stack += [(f"{path}[{k}]", v) for k, v in enumerate(node)]
                        kind, value = "array", str(len(node))
                    else:
                        kind, value = type(node).__name__, None if node is None else json.dumps(node, ensure_ascii=False)
                    for column, x in zip(out, (i, path, kind, value), strict=True):
                        column.append(x)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), *(pa.array(x, pa.string()) for x in out[1:])], [*batch.schema.names[:-1], "path", "type", "value"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, F.col(document).cast("string").alias("document")).mapInArrow(run, f"{kinds}, path string, type string, value string")


def variant_nodes(rows: DataFrame, keys: list[str], document: str, by: str = "position") -> DataFrame:
    """map_nodes without a worker: a JSON text to its nodes (keys, path, type, value), level by level, as many as the data have.

    Types are object, array, void and those of Spark's variants (precisions left out); objects and arrays have their number of children as
    value, others their JSON. Names that aren't plain stand in brackets. by="content" names an array's elements by a digest of what they hold
    and the how-manyth of its like each is, so that an element put in before them moves none; by="position" by place. A text that
    is no JSON is one node `malformed`; a null text has none.
    """
    said = F.col(document).cast("string")
    level = written(rows.filter(said.isNotNull()).select(*keys, F.lit("$").alias("path"), F.try_parse_json(said).alias("v"), said.alias("said")), "nodes")
    out = level.filter("v IS NULL").select(*keys, "path", F.lit("malformed").alias("type"), F.col("said").alias("value"))
    while True:
        kind = F.schema_of_variant("v")
        told = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise(F.regexp_replace(F.lower(kind), r"\(.*", ""))
        named, listed = F.try_variant_get("v", "$", "map<string,variant>"), F.try_variant_get("v", "$", "array<variant>")
        nodes = level.filter("v IS NOT NULL").select(*keys, "path", told.alias("type"), "v")
        value = F.when(F.col("type") == "object", F.size(named).cast("string")).when(F.col("type") == "array", F.size(listed).cast("string")).when(F.col("type") != "void", F.to_json("v"))
        out = out.unionByName(nodes.select(*keys, "path", "type", value.alias("value")))
        plain = F.col("key").rlike("^[A-Za-z_][A-Za-z0-9_]*$")
        own = nodes.filter("type = 'object'").select(*keys, "path", F.explode(named).alias("key", "v")).select(*keys, F.when(plain, F.concat("path", F.lit("."), "key")).otherwise(F.concat("path", F.lit('["'), F.regexp_replace("key", r'([\\"])', r"\\$1"), F.lit('"]'))).alias("path"), "v")
        items = nodes.filter("type = 'array'").select(*keys, "path", F.posexplode(listed).alias("at", "v"))
        if by == "content":
            items = items.withColumn("digest", F.substring(F.md5(F.to_json("v")), 1, 16))
            items = items.withColumn("name", F.concat("digest", F.lit("#"), F.row_number().over(Window.partitionBy(*keys, "path", "digest").orderBy("at"))))
        else:
            items = items.withColumn("name", F.col("at").cast("string"))
        below = own.unionByName(items.select(*keys, F.concat("path", F.lit("["), "name", F.lit("]")).alias("path"), "v"))
        level = written(below, "nodes")
        if level.isEmpty():
            return out


def expected_path(path: Column, expected_keys: list[str], added: Column | None = None, may_grow: tuple[str, ...] = ("/Font/",)) -> Column:
    """Whether a difference is one that an edit brings with it: its last key (without an index) is among expected_keys, or it is an addition (`added`) under one of the places that may_grow."""
    known = F.regexp_extract(path, r"([^./\[\]]+)(?:\[\d+\])?$", 1).isin(expected_keys)
    if added is None:
        return known
    return known | (F.coalesce(added, F.lit(False)) & F.exists(F.array(*map(F.lit, may_grow)), lambda x: F.contains(path, x)))


def inherited_and_introduced(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of after, `origin` inherited where before has the same keys, else introduced."""
    seen = before.select(*keys).distinct().withColumn("__seen", F.lit(True))
    return after.join(seen, keys, "left").withColumn("origin", F.when(F.col("__seen"), "inherited").otherwise("introduced")).drop("__seen")


def changed_records(before: DataFrame, after: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """What a later revision must write: rows of after that are new or whose mark differs. A mark that couldn't be made (null) counts as changed."""
    old = before.select(*keys, F.struct(F.col(mark).alias("mark")).alias("__old"))
    state = F.when(F.col("__old").isNull(), "added").when(F.col(mark).isNull() | ~F.coalesce(F.col(mark) == F.col("__old.mark"), F.lit(False)), "rewritten")
    return after.join(old, keys, "left").withColumn("change", state).filter(F.col("change").isNotNull()).drop("__old")


def set_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only: `side` is vanished or new."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("vanished")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("new")))


def common_order(left: Column, right: Column) -> Column:
    """Whether what two lists share stands in the same order in both."""
    return F.filter(left, lambda x: F.array_contains(right, x)) == F.filter(right, lambda x: F.array_contains(left, x))


def _opcodes(a: str, b: str, by: str) -> tuple:
    x, y = (list(a), list(b)) if by == "" else (a.split(by), b.split(by))
    return tuple(difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes())


def sequence_diff(rows: DataFrame, keys: list[str], old: str, new: str, by: str = "\n") -> DataFrame:
    """Sequence alignment of two texts cut at `by`: one row per difference: op (replace, insert, delete), old_start, old_end, new_start, new_end."""

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            n = batch.num_columns
            for i, (a, b) in enumerate(zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist(), strict=True)):
                for op, *at in _opcodes(a or "", b or "", by):
                    if op != "equal":
                        for column, value in zip(out, (i, op, *at), strict=True):
                            column.append(value)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-2]), pa.array(out[1], pa.string()), *(pa.array(x, pa.int32()) for x in out[2:])], [*batch.schema.names[:-2], "op", "old_start", "old_end", "new_start", "new_end"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, F.col(old).alias("__old"), F.col(new).alias("__new")).mapInArrow(run, f"{kinds}, op string, old_start int, old_end int, new_start int, new_end int")


def _matches(a: list, b: list) -> list[tuple[int, int, int]]:
    """Runs (start in a, start in b, length) of a longest common subsequence, by the greedy O(ND) search from both ends: linear memory."""
    found, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        low, high, start, end = stack.pop()
        head = 0
        while low + head < high and start + head < end and a[low + head] == b[start + head]:
            head += 1
        tail = 0
        while high - tail > low + head and end - tail > start + head and a[high - tail - 1] == b[end - tail - 1]:
            tail += 1
        found += [(x, y, n) for x, y, n in ((low, start, head), (high - tail, end - tail, tail)) if n]
        low, high, start, end = low + head, high - tail, start + head, end - tail
        if low < high and start < end:
            x, y, n = _middle(a, low, high, b, start, end)
            found += [(x, y, n)] if n else []
            stack += [(low, x, start, y), (x + n, high, y + n, end)]
    return sorted(found)


def _middle(a: list, low: int, high: int, b: list, start: int, end: int) -> tuple[int, int, int]:
    """A run in the middle of a shortest edit path between two stretches that share neither their first nor their last item."""
    n, m = high - low, end - start
    ahead, back, delta = {1: 0}, {1: 0}, n - m
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            at = x
            while x < n and 0 <= x - k < m and a[low + x] == b[start + x - k]:
                x += 1
            ahead[k] = x
            if delta % 2 and -d < delta - k < d and x + back[delta - k] >= n:
                return low + at, start + at - k, x - at
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            at = x
            while x < n and 0 <= x - k < m and a[high - 1 - x] == b[end - 1 - x + k]:
                x += 1
            back[k] = x
            if not delta % 2 and -d <= delta - k <= d and x + ahead[delta - k] >= n:
                return high - x, end - x + k, x - at
    raise AssertionError("two paths always meet")


def alignment(left: DataFrame, right: DataFrame, keys: list[str], at: str, item: str) -> DataFrame:
    """What turns one sequence into another: keys, op (replace, insert, delete), old_start, old_end, new_start, new_end, as sequence_diff has it, but
    for sequences that are rows (keys, at: places from 0 without gaps, item), so that one long pair is the work of many tasks.

    Items that each side has once, and that stand in the same order as all others of their kind, are anchors: the sequences are cut
    there, and only the stretches between anchors come together, each aligned by itself with the fewest insertions and deletions. With the anchors
    kept that is the fewest of all; a pair without an anchor is one stretch. Null items are equal to each other.
    """
    mark = F.coalesce(F.concat(F.lit("="), F.col(item).cast("string")), F.lit(""))
    a, b = (df.select(*keys, F.col(at).cast("long").alias("at"), mark.alias("item")) for df in (left, right))
    once = lambda df, name: df.groupBy(*keys, F.xxhash64("item").alias("h"), "item").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias(name)).filter("n = 1").drop("n")
    both = written(once(a, "a").join(once(b, "b"), [*keys, "h", "item"]).select(*keys, "a", "b"), "pairs")
    #: An anchor has all pairs before it in one sequence before it in the other, too.
    highest = running(both, keys, "a", F.max, "b", "high")
    lowest = running(both.withColumn("__back", -F.col("a")), keys, "__back", F.min, "b", "low").drop("__back")
    anchors = written(highest.join(lowest, [*keys, "a", "b"]).filter("(high IS NULL OR high < b) AND (low IS NULL OR low > b)").select(*keys, "a", "b"), "anchors")
    release(both)

    def parted(df: DataFrame, side: str) -> DataFrame:
        """Each row with the anchor that its stretch begins with, by that anchor's place in the left sequence."""
        marked = df.join(anchors.select(*keys, F.col(side).alias("at"), F.col("a").alias("anchor")), [*keys, "at"], "left")
        known = running(marked, keys, "at", F.max, "anchor", "before")
        return known.filter("anchor IS NULL").select(*keys, F.coalesce("before", F.lit(-1).cast("long")).alias("part"), F.lit(side == "b").alias("new"), "at", "item")

    rows = parted(a, "a").unionByName(parted(b, "b"))
    stretches = rows.groupBy(*keys, "part").agg(*[F.array_sort(F.collect_list(F.when(F.col("new") == side, F.struct("at", "item")))).alias(name) for side, name in ((False, "old"), (True, "fresh"))])
    placed = stretches.join(anchors.select(*keys, F.col("a").alias("part"), (F.col("a") + 1).alias("old_at"), (F.col("b") + 1).alias("new_at")), [*keys, "part"], "left")
    items = lambda c: F.transform(c, lambda x: x["item"])

    def run(batches):
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            n = batch.num_columns
            olds, news, low, start = (batch.column(k).to_pylist() for k in range(n - 4, n))
            for i, (x, y, p, q) in enumerate(zip(olds, news, low, start, strict=True)):
                i0 = j0 = 0
                for i1, j1, length in [*_matches(x, y), (len(x), len(y), 0)]:
                    if i1 > i0 or j1 > j0:
                        op = "replace" if i1 > i0 and j1 > j0 else "delete" if i1 > i0 else "insert"
                        for column, value in zip(out, (i, op, p + i0, p + i1, q + j0, q + j1), strict=True):
                            column.append(value)
                    i0, j0 = i1 + length, j1 + length
            taken = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in batch.columns[:-4]), pa.array(out[1], pa.string()), *(pa.array(x, pa.int64()) for x in out[2:])], [*batch.schema.names[:-4], "op", "old_start", "old_end", "new_start", "new_end"])

    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    kinds = ", ".join(f"`{k}` {left.schema[k].dataType.simpleString()}" for k in keys)
    return placed.select(*keys, items("old").alias("__old"), items("fresh").alias("__new"), zero(F.col("old_at")).alias("__low"), zero(F.col("new_at")).alias("__start")).mapInArrow(run, f"{kinds}, op string, old_start long, old_end long, new_start long, new_end long")


def undeclared(changes: DataFrame, declared: DataFrame, key: str = "key") -> DataFrame:
    """Metadata changes whose field nobody declared (declared: field, '/Title'). A namespaced key counts by its last part, whatever the case."""
    last = F.lower(F.regexp_extract(F.col(key), r"([^/}:#]+)$", 1))
    named = declared.select(F.lower(F.ltrim(F.col("field"), F.lit("/"))).alias("__field")).distinct()
    return changes.withColumn("__last", last).join(named, F.col("__last") == F.col("__field"), "left_anti").drop("__last")


def summary_digest(rows: DataFrame, per: list[str], parts: list[Column], name: str = "digest") -> DataFrame:
    """One digest per group over its rows' parts, whatever the order of the rows."""
    line = F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])
    return rows.groupBy(*per).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(line, 256))), ""), 256).alias(name))
