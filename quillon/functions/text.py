"""String and number scalars as Column expressions; none leaves the JVM.

Fixed values that results depend on stand together at the top, as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What normalised search treats as equal.
SPACES = "".join(map(chr, [0x00A0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
HYPHENS = "".join(map(chr, [*range(0x2010, 0x2016), 0x2212, 0x00AD]))
APOSTROPHES = "".join(map(chr, [0x2018, 0x2019, 0x201A, 0x2032]))
QUOTES = "".join(map(chr, [0x201C, 0x201D, 0x201E, 0x2033]))
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}

# Name parts and the weight they stand for, first hit wins.
WEIGHT_NAMES = [
    ("extrablack", 950), ("ultrablack", 950), ("extrabold", 800), ("ultrabold", 800), ("semibold", 600), ("demibold", 600),
    ("extralight", 200), ("ultralight", 200), ("hairline", 100), ("black", 900), ("heavy", 900), ("bold", 700), ("medium", 500),
    ("light", 300), ("thin", 100), ("book", 400), ("normal", 400), ("regular", 400),
]

# Name parts of serif families.
SERIF_NAMES = [
    "times", "serif", "georgia", "garamond", "roman", "book", "minion", "cambria", "constantia", "palatino", "baskerville", "caslon",
    "charter", "didot", "utopia", "century", "schoolbook", "academy", "pt serif",
]

# Names of metadata fields, lower case without spaces and underscores, and the field they stand for.
FIELD_NAMES = {
    "title": "/Title", "author": "/Author", "subject": "/Subject", "keywords": "/Keywords", "creator": "/Creator", "producer": "/Producer",
    "creationdate": "/CreationDate", "created": "/CreationDate", "moddate": "/ModDate", "modified": "/ModDate", "trapped": "/Trapped",
}

# Names of metadata fields as people write them, in two languages, and the field they stand for.
METADATA_NAMES = {
    "author": "/Author", "title": "/Title", "subject": "/Subject", "keywords": "/Keywords", "creator": "/Creator", "producer": "/Producer",
    "created": "/CreationDate", "modified": "/ModDate",
    "автор": "/Author", "заголовок": "/Title", "тема": "/Subject", "ключевые слова": "/Keywords", "создано": "/CreationDate", "изменено": "/ModDate",
}

FROM = SPACES + HYPHENS + APOSTROPHES + QUOTES
TO = " " * len(SPACES) + "-" * len(HYPHENS) + "'" * len(APOSTROPHES) + '"' * len(QUOTES)


def normalise(text: Column) -> Column:
    """Spaces, hyphens, apostrophes and quotes to their plain forms, ligatures to letters. Case stays."""
    out = F.translate(text, FROM, TO)
    for one, letters in LIGATURES.items():
        out = F.replace(out, F.lit(one), F.lit(letters))
    return out


def source_positions(text: Column) -> Column:
    """For each character of normalise(text), the position (from 0) of the character of text it came from."""
    spread = F.transform(F.split(text, ""), lambda c, i: F.array_repeat(i, F.when(c.isin("ﬃ", "ﬄ"), 3).when(c.isin(*LIGATURES), 2).otherwise(F.length(c))))
    return F.flatten(spread)


def strip_subset_prefix(name: Column) -> Column:
    """Without leading slashes and a prefix of six capitals and a plus sign."""
    return F.regexp_replace(F.ltrim(name, F.lit("/")), r"^[A-Z]{6}\+", "")


def name_key(name: Column) -> Column:
    """strip_subset_prefix, lower-cased, letters a-z and digits only."""
    return F.regexp_replace(F.lower(strip_subset_prefix(name)), "[^a-z0-9]", "")


def is_subset_name(name: Column) -> Column:
    """Looser than the prefix that is stripped: six characters of which none is a small letter and one is capital, then a plus."""
    head = F.substring(name, 1, 6)
    return (F.length(name) > 7) & (F.substring(name, 7, 1) == "+") & (head == F.upper(head)) & (head != F.lower(head))


def weight_of(name: Column) -> Column:
    """The weight that a name's parts tell, 400 if none does."""
    low = F.lower(name)
    out = F.when(low.contains(WEIGHT_NAMES[0][0]), WEIGHT_NAMES[0][1])
    for part, weight in WEIGHT_NAMES[1:]:
        out = out.when(low.contains(part), weight)
    return out.otherwise(400)


def style_of(name: Column, flags: Column) -> Column:
    """struct<bold, italic> from a name and its flags (bit 0x40: italic)."""
    low = F.lower(name)
    bold = low.contains("bold") | low.contains("black") | low.contains("heavy")
    italic = low.contains("italic") | low.contains("oblique") | (flags.bitwiseAND(0x40) != 0)
    return F.struct(bold.alias("bold"), italic.alias("italic"))


def contains_any(text: Column, marks: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: text.contains(m))


def field_key(name: Column, aliases: dict[str, str]) -> Column:
    """A field as its canonical name: names with a slash stay, aliases apply without spaces and underscores, others get a slash and a capital."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    plain = F.regexp_replace(F.lower(F.trim(name)), "[ _]", "")
    other = F.concat(F.lit("/"), F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 20))
    return F.when(name.startswith("/"), name).otherwise(F.coalesce(F.element_at(table, plain), other))


def metadata_key(name: Column) -> Column:
    """A metadata field by the name people write: METADATA_NAMES whatever the case, names with a slash stay, others get a slash and one capital, the rest small."""
    table = F.create_map(*[F.lit(x) for kv in METADATA_NAMES.items() for x in kv])
    plain = F.trim(name)
    other = F.concat(F.lit("/"), F.upper(F.substring(plain, 1, 1)), F.lower(F.substring(plain, 2, 1 << 20)))
    return F.coalesce(F.element_at(table, F.lower(plain)), F.when(plain.startswith("/"), plain).otherwise(other))


def page_list(spec: Column, n_pages: Column) -> Column:
    """'1,3-5' to struct<pages, error>: sorted distinct pages from 0. Blank: both null, which stands for all pages.

    A reversed range is empty, and so may the list be: that is no pages. What is no number or range, or out of range, is an
    error, and pages is null then; error never comes with pages, so a bad list can't pass for all pages.
    """
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    strange = F.filter(parts, lambda p: ~p.rlike(r"^\d{1,9}(\s*-\s*\d{1,9})?$"))
    low = lambda p: F.trim(F.split_part(p, F.lit("-"), F.lit(1))).try_cast("int")
    high = lambda p: F.trim(F.split_part(p, F.lit("-"), F.when(p.contains("-"), 2).otherwise(1))).try_cast("int")
    ranges = F.filter(parts, lambda p: low(p) <= high(p))
    outside = F.filter(ranges, lambda p: (low(p) < 1) | (high(p) > n_pages))
    error = F.when(F.size(strange) > 0, F.concat(F.lit("no page or range: "), F.get(strange, F.lit(0)))).when(F.size(outside) > 0, F.concat(F.lit("out of range: "), F.get(outside, F.lit(0))))
    pages = F.flatten(F.transform(ranges, lambda p: F.sequence(low(p) - 1, high(p) - 1)))
    blank = F.coalesce(F.trim(spec) == "", F.lit(True))
    return F.struct(F.when(~blank & error.isNull(), F.array_sort(F.array_distinct(pages))).alias("pages"), F.when(~blank, error).alias("error"))


def on_pages(page: Column, pages: Column) -> Column:
    """Whether a page is asked for: null asks for all, an empty array for none."""
    return pages.isNull() | F.array_contains(pages, page)


def assignments(items: Column, key: Callable[[Column], Column] = lambda k: k) -> Column:
    """['k=v', ...] to a map: split at the first equals sign, key says what a name stands for, the last of equal keys wins."""
    pairs = F.transform(F.filter(items, lambda x: x.contains("=")), lambda x: F.struct(key(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), F.regexp_replace(x, "(?s)^[^=]*=", "").alias("v")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.map_from_arrays(F.array(p["k"]), F.array(p["v"]))))


def replace_pairs(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements one after another, longest first and then by text; null where nothing changes."""
    out = text
    for old, new in sorted(pairs, key=lambda p: (-len(p[0]), p[0])):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.nullif(out, text)


def minimal_edit(old: Column, new: Column) -> Column:
    """The smallest span to replace: struct<start, end, replacement>, null if equal. A pure insertion takes a neighbour in."""
    n, m = F.length(old), F.length(new)
    least = F.least(n, m)

    def same(a: Column, b: Column) -> Column:
        """How many first characters agree, by halving: each step compares two prefixes whole."""
        start = F.struct(F.lit(0).alias("low"), least.alias("high"))

        def halve(span: Column, _: Column) -> Column:
            middle = F.ceil((span["low"] + span["high"]) / 2).cast("int")
            agree = F.substr(a, F.lit(1), middle) == F.substr(b, F.lit(1), middle)
            return F.struct(F.when(agree, middle).otherwise(span["low"]).alias("low"), F.when(agree, span["high"]).otherwise(F.greatest(middle - 1, span["low"])).alias("high"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve)["low"]

    head = same(old, new)
    tail = F.least(same(F.reverse(old), F.reverse(new)), least - head)
    insertion = (n - tail == head) & (n > 0)
    start = F.when(insertion & (head > 0), head - 1).otherwise(head)
    end = F.when(insertion & (head == 0), n - tail + 1).otherwise(n - tail)
    kept = F.when(insertion & (head == 0), tail - 1).otherwise(tail)
    text = F.substr(new, start + 1, m - kept - start)
    return F.when(old != new, F.struct(start.alias("start"), end.alias("end"), text.alias("replacement")))


def shortened(text: Column, limit: int) -> Column:
    """At most limit characters, the last three dots where text is longer; runs of white space become one space."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))).otherwise(flat)


def safe_name(name: Column) -> Column:
    """A file name part: at most 60 of [A-Za-z0-9._-], no underscores or dots at the ends, 'font' if nothing is left."""
    kept = F.btrim(F.substring(F.regexp_replace(strip_subset_prefix(name), "[^A-Za-z0-9._-]", "_"), 1, 60), F.lit("_."))
    return F.when(F.length(kept) > 0, kept).otherwise("font")


def clean_number(x: Column) -> Column:
    """Rounded to three places, halves to even."""
    return F.bround(x, 3)


def per_thousand(advance: Column, per_em: Column) -> Column:
    return F.when(per_em == 0, F.lit(0.0)).otherwise(F.bround(advance * 1000.0 / per_em, 2))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    return F.struct(((1 - c) * (1 - k)).alias("r"), ((1 - m) * (1 - k)).alias("g"), ((1 - y) * (1 - k)).alias("b"))


def affine_product(a: list[Column], b: list[Column]) -> list[Column]:
    """a then b, as row vectors: (a, b, c, d, e, f)."""
    return [
        a[0] * b[0] + a[1] * b[2],
        a[0] * b[1] + a[1] * b[3],
        a[2] * b[0] + a[3] * b[2],
        a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4],
        a[4] * b[1] + a[5] * b[3] + b[5],
    ]


def affine_point(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def fit_mode(mode: Column, old: Column, new: Column, tolerance: float = 0.08) -> Column:
    """What 'auto' comes to: squeeze where the widths differ by no more than tolerance, else natural."""
    close = F.abs(old / F.nullif(new, F.lit(0.0)) - 1) <= tolerance
    return F.when(mode != "auto", mode).when((new > 0) & close, "squeeze").otherwise("natural")


def alignment_shift(alignment: Column, delta: Column) -> Column:
    return F.when(alignment == "right", delta).when(alignment == "center", delta / 2).otherwise(0.0)


def filter_chain(filters: Column, aliases: dict[str, str]) -> Column:
    """Filter names in order, short forms written out."""
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.transform(filters, lambda f: F.coalesce(F.element_at(table, f), f))


# Filters whose data stay as they are, pictures and encrypted data.
OPAQUE_FILTERS = ["/DCTDecode", "/DCT", "/JPXDecode", "/CCITTFaxDecode", "/CCF", "/JBIG2Decode", "/Crypt"]


def is_opaque(filters: Column) -> Column:
    """Whether a stream's data are read raw."""
    return F.coalesce(F.arrays_overlap(filters, F.array(*map(F.lit, OPAQUE_FILTERS))), F.lit(False))


def zlib_header(data: Column) -> Column:
    """struct<valid, level> of the first two bytes: compression method 8 and a multiple of 31; level is the hint 0 to 3."""
    number = lambda at: F.conv(F.hex(F.substring(data, at, 1)), 16, 10).cast("int")
    first, second = number(1), number(2)
    valid = (F.octet_length(data) >= 2) & (first.bitwiseAND(15) == 8) & (F.pmod(first * 256 + second, F.lit(31)) == 0)
    return F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), F.when(valid, F.shiftright(second, 6)).alias("level"))


def is_serif(name: Column, flags: Column) -> Column:
    """Flag bit 2, or a serif family's name part in name_key."""
    return (flags.bitwiseAND(2) != 0) | contains_any(name_key(name), SERIF_NAMES)


def utf16be_text(data: Column) -> Column:
    """UTF-16BE bytes as text; an odd number of bytes gets a zero byte at its end."""
    return F.decode(F.when(F.octet_length(data) % 2 == 1, F.concat(data, F.lit(b"\0"))).otherwise(data), "UTF-16BE")
