"""Which texts hold which patterns, both as tables: candidates meet by the rarest piece of a pattern, and are then compared exactly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import release, written

_WORD = r"[\p{L}\p{M}\p{N}_]"
#: Words with something else on either side inside the pattern: wherever the pattern stands, they are whole words there.
INNER = rf"(?<=[^\p{{L}}\p{{M}}\p{{N}}_]){_WORD}+(?=[^\p{{L}}\p{{M}}\p{{N}}_])"
GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """All stretches of n characters, led by n so that they differ from words: what a look ahead sees from every place, in one pass."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.concat(F.lit(f"{n}:"), g))


def _words(found: Column) -> Column:
    return F.transform(found, lambda w: F.concat(F.lit("w:"), w))


def contained(texts: DataFrame, text_id: str, text: str, patterns: DataFrame, pattern_id: str, pattern: str) -> DataFrame:
    """(text_id, pattern_id) for each text that holds a pattern; ids are distinct in their tables, null and empty patterns stand nowhere.

    Of each pattern the words that stand whole in it (where it has none, its stretches of up to GRAM characters) are looked up in
    the texts; the one that the fewest texts hold is its anchor, and only texts with that anchor are searched. One with a
    word that no text holds is dropped at once. Neither table is broadcast unless Spark finds it small, texts are cut into
    words once, and only words that some pattern has are kept.
    """
    asked = patterns.select(F.col(pattern_id).alias("__p"), F.col(pattern).cast("string").alias("__s")).filter("length(__s) > 0")
    inner = F.array_distinct(F.regexp_extract_all("__s", F.lit(INNER), F.lit(0)))
    short = reduce(lambda rest, n: F.when(F.length("__s") >= n, _grams(F.col("__s"), n)).otherwise(rest), range(2, GRAM + 1), _grams(F.col("__s"), 1))
    pieces = written(asked.select("__p", F.explode(F.when(F.size(inner) > 0, _words(inner)).otherwise(F.array_distinct(short))).alias("__piece")), "pieces")
    #: At most the lengths 1 to GRAM.
    lengths = [int(r[0]) for r in pieces.filter("__piece NOT LIKE 'w:%'").select(F.substring("__piece", 1, 1)).distinct().collect()]
    body = F.col(text).cast("string")
    cut = [_words(F.array_distinct(F.regexp_extract_all(body, F.lit(rf"{_WORD}+"), F.lit(0)))), *[F.array_distinct(_grams(body, n)) for n in lengths]]
    every = texts.filter(body.isNotNull()).select(F.col(text_id).alias("__t"), F.explode(F.concat(*cut)).alias("__piece"))
    held = written(every.join(pieces.select("__piece").distinct(), "__piece", "left_semi"), "held-pieces")
    counts = held.groupBy("__piece").agg(F.count(F.lit(1)).alias("__n"))
    ranked = pieces.join(counts, "__piece", "left").groupBy("__p").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), (-F.length("__piece")).alias("size"), F.col("__piece").alias("piece"))).alias("best"))
    anchors = written(ranked.filter("best.n > 0").select("__p", F.col("best.piece").alias("__piece")), "anchors")
    pairs = held.join(anchors, "__piece").select("__t", "__p")
    near = pairs.join(texts.select(F.col(text_id).alias("__t"), body.alias("__text")), "__t").join(asked, "__p").filter(F.contains("__text", "__s"))
    found = written(near.select(F.col("__t").alias(text_id), F.col("__p").alias(pattern_id)), "contained")
    release(pieces, held, anchors)
    return found
