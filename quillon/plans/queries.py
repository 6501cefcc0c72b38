"""The registered queries: each operator on the driver's tables, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import dates, text
from quillon.operators import detect, diff, edits, graph, layout, match, rules, search, versions
from quillon.session import read_table as table
from quillon.sources import files, text_state

from . import file_queries

NBSP, FF = chr(0x00A0), chr(0xFB00)


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


# Search and text


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_top_docs(spark, sf_dir)


def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.replace(F.replace(F.col("text"), F.lit(" "), F.lit(NBSP)), F.lit("ff"), F.lit(FF))
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise(marked).alias("plain"), F.length(marked).alias("n_source"))


def norm_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.replace(F.col("text"), F.lit("ff"), F.lit(FF))
    at = text.source_positions(marked)
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(at).alias("n"), F.element_at(at, -1).alias("last"), F.aggregate(at, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def find_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", search.match_count(F.col("text"), search.Pattern("the")).cast("long").alias("n"))


def find_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", search.match_count(F.col("text"), search.Pattern("license", ignore_case=True)).cast("long").alias("n"))


def find_whole_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", search.match_count(F.col("text"), search.Pattern("the", whole_word=True)).cast("long").alias("n"))


def find_page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter(F.col("turn").isin(0, 2))
    return turns.select("conv_id", "turn", search.match_count(F.col("text"), search.Pattern("th")).cast("long").alias("n"))


def find_top_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("lang", "doc_id", search.match_count(F.col("text"), search.Pattern("e")).cast("long").alias("n")).filter("n > 0")
    return search.top_rows(found, ["lang"], [F.desc("n"), F.col("doc_id")], 10).select("lang", "doc_id", "n", F.col("rank").cast("long").alias("rank"), "total")


def find_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.find_offsets(table(spark, sf_dir, "documents"), search.Pattern("license", ignore_case=True), "doc_id", "text")


def replace_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return search.replace_all(turns, "text", search.Pattern("([a-z]+) ([a-z]+)", regex=True), r"\2 \1").select("conv_id", "turn", F.md5("text").alias("changed"))


def replace_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 matches of all, whichever documents they stand in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = search.replace_first(docs, search.Pattern("License"), "Licence", "doc_id", "text", 20)
    return changed.select("doc_id", F.md5("text").alias("changed"), F.col("n_replaced").cast("long").alias("n_replaced"))


def replace_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with hard spaces and ligatures, of which only what is matched may change."""
    docs = table(spark, sf_dir, "documents")
    marked = F.replace(F.replace(F.col("text"), F.lit(" "), F.lit(NBSP)), F.lit("ff"), F.lit(FF))
    return search.replace_all(docs.select("doc_id", marked.alias("text")), "text", search.Pattern("of the"), "OF-THE").select("doc_id", F.md5("text").alias("changed"))


def find_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in whole lines of several runs, as edits of their runs."""
    lines = layout.visual_lines(_runs(spark, sf_dir), ["conv_id"])
    found = search.find_grouped(lines, ["conv_id"], search.Pattern(r"\. ?[A-Z]", regex=True), layout.SPACE_GAP)
    keys = ["conv_id", "baseline", "line_no", "match_no"]
    edits = search.edits_of(found, keys, F.lit("x"), F.col("matched"))
    return edits.groupBy("conv_id", "baseline", F.col("line_no").cast("long").alias("line_no")).agg(F.count_if(~F.col("continuation")).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list(F.when(~F.col("continuation"), F.col("old_text")))), "|")).alias("matched"))


def replace_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(text.replace_pairs(F.col("text"), [("the", "THE"), ("there", "HERE"), ("License", "Licence")])).alias("changed"))


def splice_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the fifth character of each item replaced at once."""
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("<<").alias("text")), F.struct(F.lit(4).alias("start"), F.lit(5).alias("end"), F.lit("").alias("text")))
    return table(spark, sf_dir, "benchmark").select("item_id", search.splice(F.col("text"), edits).alias("changed"))


def minimal_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each turn to the next but one: what has to be replaced."""
    turns = table(spark, sf_dir, "conversations")
    pairs = turns.join(turns.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("later")), ["conv_id", "turn"])
    e = text.minimal_edit(F.col("text"), F.col("later"))
    return pairs.select("conv_id", "turn", e["start"].cast("long").alias("start"), e["end"].cast("long").alias("stop"), F.md5(e["replacement"]).alias("replacement"))


def greedy_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("at", F.concat_ws(" ", "conv_id", "turn"))
    parts = match.longest_match_parts(turns, "at", "text", ["th", "the", "tion", "ing", "and", "er", "in"])
    return parts.groupBy("at").agg(F.count(F.lit(1)).alias("n_parts"), F.count_if("known").alias("n_known"))


def glyph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of glyphs that hold two characters each, those that some characters of each text stand on; where they start depends on the text's length."""
    glyphs = F.transform(F.sequence(F.lit(0), F.length("text") - 1), lambda i: F.floor(i / 2).cast("int"))
    start = F.pmod(F.length("text"), F.lit(17))
    span = search.glyph_span(glyphs, start, start + 4)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", span["start"].cast("long").alias("first"), span["end"].cast("long").alias("after"), span["expanded"].alias("expanded"))


# Scalars


def name_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("ABCDEF+Arial-Bold", "Times SemiBold Italic", "Light Sans", "XYZABC+Georgia Black", "Plain Oblique", "Some ExtraLight")]), (F.pmod("p_partkey", F.lit(6)) + 1).cast("int")), F.lit(" "), F.col("p_name"))
    named = part.select("p_partkey", "p_size", name.alias("name"))
    style = text.style_of(F.col("name"), F.col("p_size"))
    return named.select(
        "p_partkey",
        text.strip_subset_prefix(F.col("name")).alias("stripped"),
        text.name_key(F.col("name")).alias("name_key"),
        text.is_subset_name(F.col("name")).alias("subset"),
        text.weight_of(F.col("name")).cast("long").alias("weight"),
        style["bold"].alias("bold"),
        style["italic"].alias("italic"),
        text.safe_name(F.col("name")).alias("file_name"),
        text.is_serif(F.col("name"), F.col("p_size")).alias("serif"),
    )


def field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(x) for x in ("Title", "mod date", "creation_date", "/Custom", "segment", "AUTHOR")]), (F.pmod("c_custkey", F.lit(6)) + 1).cast("int")).alias("name"))
    return named.select("c_custkey", text.field_key(F.col("name"), text.FIELD_NAMES).alias("field"))


def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = F.pmod("p_partkey", F.lit(7)) + 1, F.pmod("p_partkey", F.lit(11)) + 1
    spec = F.concat(low.cast("string"), F.lit(", "), high.cast("string"), F.lit("-"), (high + 3).cast("string"), F.lit(",,"), high.cast("string"), F.lit("-"), low.cast("string"))
    pages = text.page_list(spec, F.lit(14))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(pages["pages"], lambda x: x.cast("string")), " ").alias("pages"))


def page_list_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that ask for all pages, for none, for some, and such as can't be read; what a page filter makes of each."""
    spec = F.element_at(F.array(*[F.lit(x) for x in ("", "5-3", "1,a,2", "99", "2, 1-3", "1-x", " , ")]), (F.pmod("p_partkey", F.lit(7)) + 1).cast("int"))
    listed = table(spark, sf_dir, "part").select("p_partkey", (F.pmod("p_size", F.lit(5))).alias("page"), text.page_list(spec, F.lit(14)).alias("l"))
    return listed.select("p_partkey", F.array_join(F.transform(F.col("l.pages"), lambda x: x.cast("string")), " ").alias("pages"), F.col("l.error").alias("error"), (F.col("l.error").isNull() & text.on_pages(F.col("page"), F.col("l.pages"))).alias("asked_for"))


def metadata_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*[F.lit(x) for x in ("Title", " автор ", "CREATED", "/Custom", "market SEGMENT", "Ключевые слова")]), (F.pmod("c_custkey", F.lit(6)) + 1).cast("int")).alias("name"))
    return named.select("c_custkey", text.metadata_key(F.col("name")).alias("field"))


def short_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortened notes, cleaned numbers and widths of an em's thousandths, over parts."""
    part = table(spark, sf_dir, "part")
    return part.select(
        "p_partkey", text.shortened(F.concat_ws("  ", "p_name", "p_type", "p_brand"), 20).alias("note"), text.clean_number(F.col("p_retailprice") / 8).alias("clean"), text.per_thousand(F.col("p_size").cast("double"), F.pmod("p_partkey", F.lit(3)) * 1024.0).alias("width")
    )


def assignment_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments under names that stand for one field; the last wins."""
    items = F.array(F.concat(F.lit("title="), "n_name"), F.concat(F.lit("mod date="), F.col("n_regionkey").cast("string"), F.lit("=x")), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Title=last "), "n_name")).otherwise(F.lit("none")))
    made = text.assignments(items, lambda k: text.field_key(k, text.FIELD_NAMES))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(made, "/Title").alias("title"), F.element_at(made, "/ModDate").alias("changed"), F.size(made).cast("long").alias("n"))


def dates_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in five spellings, parsed, and written back in two."""
    day = F.col("o_orderdate")
    spelled = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.date_format(day, "'D:'yyyyMMddHHmmss"), F.lit("+03'30'"))).when(F.col("o_orderkey") % 5 == 1, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(F.col("o_orderkey") % 5 == 2, F.date_format(day, "yyyy/MM/dd")).when(F.col("o_orderkey") % 5 == 3, F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise("no date")
    made = table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(spelled).alias("d"))
    return made.select("o_orderkey", dates.packed_date(F.col("d.moment"), F.col("d.offset_min")).alias("packed"), dates.iso_date(F.col("d.moment"), F.col("d.offset_min")).alias("iso"))


def number_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count(F.lit(1)).alias("n"))
    a = [F.col("q"), F.lit(0), F.lit(0), F.col("n"), F.lit(1), F.lit(2)]
    m = text.affine_product(a, [F.lit(2), F.lit(0), F.lit(0), F.lit(3), F.col("n"), F.lit(0)])
    x, y = text.affine_point(m, F.lit(10), F.lit(1))
    rgb = text.cmyk_to_rgb(F.pmod("n", F.lit(2)), F.lit(0), F.lit(1), F.pmod("q", F.lit(2)))
    return li.select(
        "l_orderkey", x.cast("long").alias("x"), y.cast("long").alias("y"), rgb["r"].cast("long").alias("red"), rgb["b"].cast("long").alias("blue"),
        text.fit_mode(F.lit("auto"), F.col("q").cast("double"), (F.col("n") * 25).cast("double")).alias("fit"),
        text.alignment_shift(F.element_at(F.array(F.lit("left"), F.lit("center"), F.lit("right")), (F.pmod("n", F.lit(3)) + 1).cast("int")), F.col("q").cast("double") * 2).cast("long").alias("shift"),
    )


# Ordered rows


def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", _micros("ts"))
    return layout.gap_islands(events, ["user_id"], ["at", "event_id"], F.col("at"), 6 * 3600 * 1_000_000).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min("event_id").alias("first_event"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text runs laid out from conversations: one page each, words on baselines of four turns, with gaps of several kinds."""
    turns = table(spark, sf_dir, "conversations")
    width = F.length("text").cast("double")
    x0 = (F.pmod("turn", F.lit(4)) * 40).cast("double")
    return turns.select("conv_id", F.col("turn").alias("run_id"), F.lit(10.0).alias("size"), x0.alias("x0"), (x0 + F.pmod(width, F.lit(41.0))).alias("x1"), (F.floor(F.col("turn") / 4) * 20).cast("double").alias("y0"), (F.floor(F.col("turn") / 4) * 20 + 10).cast("double").alias("y1"), "text")


def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.line_texts(layout.visual_lines(_runs(spark, sf_dir), ["conv_id"]), ["conv_id"])
    return lines.select("conv_id", "baseline", F.col("line_no").cast("long").alias("line_no"), "text", F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1"), F.col("y0").cast("long").alias("y0"), F.col("y1").cast("long").alias("y1"))


def consecutive_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.consecutive(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey").withColumnsRenamed({"first": "first_key", "last": "last_key"})


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", _micros("ts"))
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return events.select("event_id", F.coalesce(layout.carried(bought, ["user_id"], ["at", "event_id"]), F.lit(-1)).alias("last_purchase"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = layout.ordered_text(table(spark, sf_dir, "conversations"), ["conv_id"], [F.col("turn"), F.col("role")], F.col("text"), "\n")
    return made.select("conv_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


def block_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's supply as a block of lines: left edge by supplier, right edge by quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", (F.pmod("l_suppkey", F.lit(2)) * F.pmod("l_partkey", F.lit(3))).cast("double").alias("x0"), (F.lit(100.0) + F.pmod(F.col("l_linenumber"), F.lit(2)) * F.pmod("l_partkey", F.lit(2))).alias("x1"))
    made = layout.block_alignment(lines, ["l_partkey"], "x0", "x1")
    return made.select("l_partkey", "n", "alignment")


def line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _runs(spark, sf_dir).withColumn("block", F.floor(F.col("run_id") / 2))
    return layout.line_alignment(lines, ["conv_id"], "block", "run_id")


# Comparing


def _orders_after(before: DataFrame) -> DataFrame:
    kept = before.filter(F.col("o_orderkey") % 13 != 0)
    bumped = kept.withColumns({"o_totalprice": F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderstatus": F.when(F.col("o_orderkey") % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))})
    return bumped.unionByName(before.filter(F.col("o_orderkey") % 11 == 0).withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000))


def _orders_marked(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", diff.fingerprint(F.col("o_orderstatus"), F.col("o_custkey")).alias("head"), diff.fingerprint((F.col("o_totalprice") * 100).cast("long")).alias("body"))


def object_hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "orders")
    return diff.record_diff(_orders_marked(before), _orders_marked(_orders_after(before)), ["o_orderkey"], {"head": "head", "body": "body"})


def changed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "orders")
    return diff.changed_records(_orders_marked(before), _orders_marked(_orders_after(before)), ["o_orderkey"], "body").select("o_orderkey", "change")


def set_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "orders")
    return diff.set_changes(before, _orders_after(before), ["o_orderkey"])


def _customer_after(c: DataFrame) -> DataFrame:
    return c.filter(F.col("c_custkey") % 17 != 0).withColumns({"c_mktsegment": F.when(F.col("c_custkey") % 6 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")), "c_nationkey": F.when(F.col("c_custkey") % 9 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))})


def meta_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    long = lambda x: diff.unpivot(x, ["c_custkey"], ["c_name", "c_nationkey", "c_mktsegment"])
    return diff.value_diff(long(c), long(_customer_after(c)), ["c_custkey", "key"], "value")


def expected_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = meta_diff(spark, sf_dir).withColumn("path", F.concat(F.lit("/customer/"), "key", F.lit("[0]")))
    return d.groupBy("key", diff.expected_path(F.col("path"), ["c_nationkey", "c_acctbal"]).alias("expected")).agg(F.count(F.lit(1)).alias("n"))


def inherited_introduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "orders")
    risky = lambda o: o.filter(F.col("o_totalprice") > 200_000).select("o_custkey", "o_orderstatus").distinct()
    return diff.inherited_and_introduced(risky(before), risky(_orders_after(before)), ["o_custkey", "o_orderstatus"])


def structure_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    left = diff.map_nodes(events, ["event_id"], "props")
    changed = F.when(F.col("event_id") % 10 == 0, F.replace(F.col("props"), F.lit('"k"'), F.lit('"other"'))).otherwise(F.col("props"))
    right = diff.map_nodes(events.withColumn("props", changed), ["event_id"], "props")
    return diff.structure_diff(left, right, ["event_id"])


def sequence_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    later = turns.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("later"))
    return diff.sequence_diff(turns.join(later, ["conv_id", "turn"]), ["conv_id", "turn"], "text", "later", by=" ")


# Choosing


def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part the part of its brand that fits best: same type and size, same type, same size; then the nearest price."""
    part = table(spark, sf_dir, "part").withColumn("cents", F.round(F.col("p_retailprice") * 100).cast("long"))
    best = match.nearest_by_buckets(part, "p_partkey", [["p_brand", "p_type", "p_size"], ["p_brand", "p_type"], ["p_brand", "p_size"]], "cents")
    return best.select("p_partkey", "candidate", F.col("bucket").cast("long").alias("bucket"))


def required_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters that each language's texts need, and those that plain letters lack."""
    need = match.required_characters(table(spark, sf_dir, "documents"), ["lang"], "text")
    letters = F.split(F.lit("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), "")
    lacks = match.missing_characters(F.array_join("characters", ""), letters)
    return need.select("lang", F.size("characters").cast("long").alias("n"), F.size(lacks).cast("long").alias("n_lacking"))


def code_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths by chained lookups: the supplier's own, else its nation's, else a default."""
    codes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    supplier = table(spark, sf_dir, "supplier")
    own = supplier.filter("s_acctbal > 5000").select("s_suppkey", F.floor("s_acctbal").alias("w"))
    keyed = codes.join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey", "left")
    nations = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select("n_nationkey", F.col("n_regionkey").cast("long").alias("w"))
    made = match.with_lookups(keyed.withColumnsRenamed({"l_suppkey": "s_suppkey"}).withColumn("n_nationkey", F.col("s_nationkey")), [(own, "s_suppkey", "w"), (nations, "n_nationkey", "w")], F.lit(500).cast("long"), "width")
    return made.select("s_suppkey", "n", "width")


def object_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first role of each key: debtor, customer with an order, customer."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return match.first_role([(customer.filter("c_acctbal < 0"), "debtor"), (orders.select(F.col("o_custkey").alias("c_custkey")), "buyer"), (customer, "customer")], ["c_custkey"])


def charset_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    charset = F.split(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ_0123456789"), "")
    return table(spark, sf_dir, "nation").select("n_nationkey", match.covers(charset, F.col("n_name")).alias("covered"))


def nearest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the price band around its customer's other orders that is nearest to it."""
    orders = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
    points = orders.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("point"), F.col("cents").alias("at"))
    bands = orders.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("band"), (F.col("cents") - 2_000_000).alias("low"), (F.col("cents") + 2_000_000).alias("high"), F.col("cents").alias("middle"))
    near = match.band_nearest(points, bands, "point", ["cust"], "at", "low", "high", 4_000_000.0, F.abs(F.col("at") - F.col("middle")), F.col("band"), F.col("band") != F.col("point"))
    return near.select("point", "band")


def majority_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.majority(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag", F.lit("N"), F.col("l_returnflag"))


def reverse_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "customer")
    return match.inverse_map(codes, ["c_nationkey"], "c_custkey", "c_mktsegment", F.col("c_acctbal") < 0)


def free_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "supplier").select("s_nationkey", (F.pmod("s_suppkey", F.lit(60)) + 32).alias("code"))
    wanted = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("s_nationkey"), "c_custkey")
    return match.free_codes(used, wanted, ["s_nationkey"], "code", ["c_custkey"]).select("s_nationkey", "c_custkey", F.col("code").cast("long").alias("code"))


def minority_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.minority(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")


# Rules, edits, versions, graph


def _rules(spark: SparkSession, sf_dir: str) -> list[rules.Rule]:
    customer, docs, orders = (table(spark, sf_dir, t) for t in ("customer", "documents", "orders"))
    return [
        rules.Rule("negative-balance", "divergence", lambda: customer.filter("c_acctbal < 0"), "c_custkey", "balance below zero"),
        rules.Rule("length-mismatch", "trace", lambda: docs.filter("length(text) <> n_chars"), "doc_id", "stored length differs from the text's"),
        rules.Rule("short-text", "note", lambda: docs.filter("length(text) < 100"), "doc_id", "text of fewer than 100 characters"),
        rules.Rule("no-customer", "divergence", lambda: orders.join(customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti"), "o_orderkey", "order without a customer"),
    ]


def top_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(rules.findings(_rules(spark, sf_dir)), 12).select("key", "severity", "subject", "text", F.col("rank").cast("long").alias("rank"), "total")


def rule_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.outcome(_rules(spark, sf_dir))


def atomic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("group", F.when(F.col("l_orderkey") % 4 == 0, 0).otherwise(F.col("l_orderkey")))
    made = search.atomic(li, F.col("l_quantity") > 45, "group")
    return made.groupBy("l_orderkey").agg(F.count_if("applied").alias("applied"), F.count_if(~F.col("applied")).alias("refused"))


def edit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    reason = search.refusal(F.col("l_linenumber"), F.pmod("l_partkey", F.lit(9)), F.lit(7), F.col("l_suppkey") % 50 != 0)
    return li.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def edit_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches over several runs as edits: order lines are the characters of a match, suppliers modulo 5 its runs."""
    chars = table(spark, sf_dir, "lineitem").select("l_orderkey", F.pmod("l_suppkey", F.lit(5)).alias("run"), (F.col("l_linenumber") - 2).alias("at"), "l_linenumber")
    made = search.edits_of(search.pieces(chars, ["l_orderkey"], "run", "at", "l_linenumber").withColumn("first_run", F.lit(0)), ["l_orderkey"], F.lit("new"), F.lit("old"))
    return made.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_pieces"), F.min("start").alias("first_at"), F.max("end").alias("after"), F.count_if("continuation").alias("n_later"), F.count_if(F.col("group") == 0).alias("n_alone"))


def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", _micros("ts").alias("at"))
    return versions.latest(events, ["user_id"], ["at", "event_id"])


def merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("value"))
    changed = base.filter(F.col("c_custkey") % 3 == 0).withColumn("value", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("new "), "value")))
    added = base.filter(F.col("c_custkey") % 50 == 0).select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.lit("added").alias("value"))
    return versions.merge(base, changed.unionByName(added), ["c_custkey"], "value")


def in_place_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    made = versions.routed(li, [(F.col("l_returnflag") == "R", "not in the original"), (F.col("l_quantity") > 40, "does not fit"), (F.col("l_linestatus") == "F", "filter not supported")])
    return made.groupBy("route", "reason").agg(F.count(F.lit(1)).alias("n"))


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From region 1 over nations to suppliers, with an edge back that makes a cycle."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    region_nation = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    back = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    nation_supplier = supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    roots = spark.range(1).select(F.lit("r1").alias("node"))
    return graph.reachable(region_nation.unionByName(back).unionByName(nation_supplier), roots).select("node", F.col("depth").cast("long").alias("depth"))


def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    nodes = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 10 != 0).select(F.col("c_custkey").alias("node"))
    return graph.dangling(edges, nodes).select("src", "dst")


def stale_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = [(i, t) for i, t in enumerate(["License, Version", "MIT License", "Public License", "no such text", "the the"])]
    return rules.stale_copies(table(spark, sf_dir, "documents"), "doc_id", "text", edits, "edit_id")


def hidden_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose later copy, the next but one turn, is not found in them."""
    turns = table(spark, sf_dir, "conversations")
    other = turns.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("copy"))
    return turns.join(other, ["conv_id", "turn"]).filter(rules.hidden_copy_mismatch(F.col("copy"), F.col("text"))).select("conv_id", "turn")


def planted_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose copy is not found in them: of every third conversation that is a stretch of the turn itself between spaces, of every fifth one with its case changed, else the turn before."""
    turns = table(spark, sf_dir, "conversations")
    own = F.substring("text", 5, 40)
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    copy = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("  "), own, F.lit(" "))).when(F.col("conv_id") % 5 == 0, F.upper(own)).otherwise(before)
    return turns.withColumn("copy", copy).filter(F.coalesce(rules.hidden_copy_mismatch(F.col("copy"), F.col("text")), F.lit(False))).select("conv_id", "turn")


# Operators on runs, codes and notes


def editable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as runs: those that show glyphs and whose glyphs aren't drawings, by order."""
    runs = table(spark, sf_dir, "lineitem").select("l_orderkey", F.pmod("l_linenumber", F.lit(3)).alias("n_glyphs"), (F.col("l_returnflag") == "R").alias("is_drawn"))
    return match.editable(runs, "n_glyphs", "is_drawn").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


def codes_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.codes_in_use(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber")
    return found.select("l_suppkey", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


def known_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as codes of their brand's font: some codes have no glyph, some fonts no list of glyphs."""
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("font"), F.col("p_partkey").alias("code"), F.col("p_size").alias("gid"))
    usable = part.filter((F.col("code") % 3 == 0) & ~F.col("font").endswith("5"))
    return match.with_glyphs(part.select("font", "code"), part.filter(F.col("code") % 5 != 0), usable, ["font"]).select("font", "code", "has_glyph")


def missing_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of each document that plain letters, space and line feed lack: the first met, and all in order of code points."""
    plain = F.split(F.lit("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ \n"), "")
    missing = match.missing_characters(F.coalesce("text", F.lit("")), plain)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.get(missing, F.lit(0)), F.lit("")).alias("first"), F.array_join(F.array_sort(missing), "").alias("missing"))


def note_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a parser's notes on their customers: each note once, where it first came, shortened and rated."""
    key = F.col("o_orderkey") % 4
    note = F.when(key == 0, F.lit("file is damaged")).when(key == 1, F.concat(F.lit("expected   endstream, "), "o_orderpriority")).otherwise(F.concat(F.lit("odd  spacing "), "o_orderstatus"))
    notes = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", text.shortened(note, 30).alias("note"))
    found = rules.distinct_notes(notes, ["o_custkey"], "note", "o_orderkey")
    return found.select("o_custkey", "note", "o_orderkey", rules.note_severity(F.col("note")).alias("severity"))


def overall_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.overall(rules.outcome(_rules(spark, sf_dir)))


def line_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("wider", F.col("l_quantity") + F.col("l_partkey") % 3)
    return layout.line_shifts(li, ["l_suppkey"], "l_linenumber", "l_quantity", "wider")


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as runs of their order's page, with heights that round to even."""
    li = table(spark, sf_dir, "lineitem")
    runs = li.select("l_orderkey", (F.floor("l_quantity") + F.col("l_linenumber") * 0.25).alias("y1"), (F.col("l_linenumber") * 0.25).alias("x0"), F.col("l_suppkey").alias("run_id"), F.col("l_partkey").cast("string").alias("text"))
    return layout.reading_text(runs, ["l_orderkey"])


def line_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that have two words only over a line's end: every fourth space of a turn becomes a line feed first."""
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(" ", "conv_id", "turn").alias("at"), F.regexp_replace("text", "( [^ ]* [^ ]* [^ ]*) ", "$1\n").alias("text"))
    return search.not_found_hints(turns, search.Pattern("of the"), "at", "text").unionByName(search.not_found_hints(turns, search.Pattern("e s"), "at", "text")).groupBy("at").agg(F.count(F.lit(1)).alias("n"))


def replacement_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 edits that replacing would make, none of them made."""
    return search.replacement_plan(table(spark, sf_dir, "documents"), search.Pattern("License"), "Licence", "doc_id", "text", 50)


def summary_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.summary_digest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")])


def common_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by whether the priorities that the first and the last year's orders share came in the same order."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 2).alias("half"), "o_orderpriority").agg(F.min("o_orderkey").alias("at"))
    lists = orders.groupBy("o_custkey", "half").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("names"))
    left, right = (lists.filter(F.col("half") == h).select("o_custkey", F.col("names").alias(n)) for h, n in ((0, "a"), (1, "b")))
    return left.join(right, "o_custkey").select("o_custkey", diff.common_order(F.col("a"), F.col("b")).alias("same"))


def fallback_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as fonts, none of them both bold and italic, and suppliers' styles."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    fonts = part.select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("family"), (F.col("p_size") % 2 == 0).alias("bold"), (F.col("p_partkey") % 3 == 0).alias("italic"), ((F.col("p_size") % 9 + 1) * 100).alias("weight"))
    styles = supplier.select("s_suppkey", (F.col("s_nationkey") % 2 == 0).alias("bold"), (F.col("s_suppkey") % 3 == 0).alias("italic"), ((F.col("s_suppkey") % 9 + 1) * 100).alias("weight"))
    return match.fallback_choice(styles, fonts.filter("NOT (bold AND italic)"), ["Brand#7", "Brand#3"]).select("s_suppkey", "ord")


def reachable_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as glyphs of their brand's font: sizes and keys reach some, and of some fonts nobody can read the map."""
    glyphs = table(spark, sf_dir, "part").select(F.col("p_brand").alias("font"), F.col("p_partkey").alias("gid"), "p_size")
    return graph.reachable_glyphs(glyphs, [glyphs.filter("p_size < 10"), glyphs.filter("gid % 7 = 0")], glyphs.filter("font LIKE '%5'"))


def composite_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as glyphs: each is made of the ones at twice and thrice its number, down to those that have no parts."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))
    parts = s.select(F.col("node").alias("src"), F.explode(F.array(F.col("node") * 2, F.col("node") * 3)).alias("dst")).join(s.select(F.col("node").alias("dst")), "dst", "left_semi")
    return graph.reachable(parts, s.filter("node IN (1, 7)")).select("node", F.col("depth").cast("long").alias("depth"))


# Detectors


def _container(orders: DataFrame) -> DataFrame:
    """Orders as files: their size, version and style."""
    return orders.select(F.col("o_orderkey").cast("string").alias("path"), (F.col("o_totalprice") * 100).cast("long").alias("size"), F.col("o_orderstatus").alias("version"), (F.col("o_orderstatus") == "F").alias("object_streams"))


def container_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "orders")
    found = detect.container_changes(_container(before), _container(_orders_after(before)), ["path"])
    return found.groupBy("key", "severity").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("text")), "|")).alias("texts"))


def external_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files, their orders as fonts and their priorities as graphics states."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    is_ = lambda c, n: F.col(c) % n == 0
    profiles = customer.select(F.col("c_custkey").cast("string").alias("path"), is_("c_custkey", 50).alias("encrypted"), (~is_("c_custkey", 3)).alias("has_metadata"), is_("c_custkey", 5).alias("has_pdfa_id"), is_("c_custkey", 7).alias("has_output_intent"), (F.col("c_acctbal") > 0).alias("has_id"), F.pmod("c_nationkey", F.lit(3)).alias("n_eof"))
    fonts = orders.select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderpriority").alias("font"), (F.col("o_orderstatus") != "P").alias("embedded"), (~is_("o_orderkey", 4)).alias("has_unicode_map"))
    states = orders.select(F.col("o_custkey").cast("string").alias("path"), F.when(is_("o_orderkey", 9), 0.5).otherwise(1.0).alias("alpha"), F.lit(None).cast("string").alias("soft_mask"), F.lit("None").alias("group"))
    return detect.external_risks(profiles, fonts, states)


def signature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").cast("string").alias("field"), F.array(F.lit(0).cast("long"), F.lit(100).cast("long"), F.col("l_partkey"), F.col("l_suppkey")).alias("byte_range"), F.lit(1500).alias("size"))
    return detect.uncovered_signatures(li).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("first"))


def width_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as codes of their brand's font: the stated width is the program's but for some."""
    part = table(spark, sf_dir, "part")
    own = F.pmod("p_size", F.lit(10)) * 50.0
    glyphs = part.select(F.col("p_brand").alias("font"), F.col("p_partkey").alias("code"), own.alias("program_width"), (own + F.pmod("p_partkey", F.lit(4)) * 0.5).alias("stated_width"))
    return detect.width_mismatches(glyphs).select("subject", "text")


def orphan_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as glyphs of their brand's font, some without outline: those that sold fifty in a line are reached, and through them the one ten above."""
    part = table(spark, sf_dir, "part")
    font = F.col("p_brand").alias("font")
    glyphs = part.select(font, F.col("p_partkey").alias("gid"), F.when(F.col("p_size") % 5 > 0, F.col("p_size")).otherwise(0).alias("n_bytes"))
    sold = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 AND l_linenumber < 4").select(F.col("l_partkey").alias("p_partkey")).distinct()
    reached = sold.join(part, "p_partkey").select(font, F.col("p_partkey").alias("gid"))
    parts = part.select(font, F.col("p_partkey").alias("gid"), (F.col("p_partkey") + 10).alias("part"))
    return detect.orphan_glyphs(glyphs, reached, parts).select("subject", "text")


def dictionary_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    entries = lambda x: x.select("c_custkey", F.map_filter(F.create_map(F.lit("/Name"), F.col("c_name"), F.lit("/Nation"), F.col("c_nationkey").cast("string"), F.lit("/Length"), F.col("c_acctbal").cast("string"), F.lit("/Segment"), F.col("c_mktsegment")), lambda _, v: v.isNotNull()).alias("entries"))
    later = _customer_after(c).withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return detect.dictionary_changes(entries(c), entries(later), ["c_custkey"], "entries", ("/Length",))


# Codecs: bytes made of columns, and what the readers find in them


def code_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code map per part: one code, one range and one list."""
    code = lambda c: F.lpad(F.hex(c), 4, F.lit("0"))
    said = F.concat(F.lit("1 beginbfchar <"), code(F.col("p_size")), F.lit("> <"), code(F.pmod("p_partkey", F.lit(26)) + 65), F.lit("> endbfchar 2 beginbfrange <"), code(F.col("p_size") + 100), F.lit("> <"), code(F.col("p_size") + 102), F.lit("> <0041> <"), code(F.col("p_size") + 200), F.lit("> <"), code(F.col("p_size") + 201), F.lit("> [<0061> <0062>] endbfrange"))
    maps = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), said.cast("binary").alias("decoded"))
    return files.code_map_rows(maps).select("path", "code", "text")


def instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content stream per part: operators, where each ends, and their operands."""
    said = F.concat(F.lit("BT /F1 "), F.col("p_size").cast("string"), F.lit(" Tf % note\n(a\\)"), F.col("p_brand"), F.lit(") Tj [(x) -20 <41>] TJ ET"))
    streams = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), said.cast("binary").alias("decoded"))
    return files.instruction_rows(streams).select("path", F.col("op_index").cast("long").alias("op_index"), "operator", "operands", F.col("end").alias("stop"))


def raw_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per part: two objects, one with a stream and one that is written twice; the last counts."""
    said = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Length 9 >> stream\n"), F.col("p_name"), F.lit("\nendstream endobj\n2 0 obj << >> stream\nold\nendstream endobj\n2 0 obj << /Next 1 0 R >> stream\n"), F.col("p_brand"), F.lit("\nendstream endobj\n%%EOF"))
    made = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), said.cast("binary").alias("content"))
    return files.stream_rows(made).select("path", "num", "length", "digest")


def shown_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A content stream per part: what is shown on two baselines, as runs, by the text state."""
    font = text_state.Font(1, {c: chr(c) for c in range(32, 127)}, {c: 500.0 for c in range(32, 127)})
    said = F.concat(F.lit("BT /F1 10 Tf 1 0 0 1 "), F.col("p_size").cast("string"), F.lit(" 700 Tm ("), F.col("p_brand"), F.lit(") Tj 0 -20 Td [(a) -300 (b) -3000 (c)] TJ ET"))
    streams = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), said.cast("binary").alias("decoded"))
    runs = files.runs_of_glyphs(files.glyph_rows(streams, {"/F1": font}), ["path"])
    return runs.select("path", "run_id", "text", F.round("x0").cast("long").alias("x0"), F.round("x1").cast("long").alias("x1"), F.round("y0").cast("long").alias("y0"), "n_glyphs")


# Edits over several runs, copies of passages, donors, chains and circles


def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as edits of their order's text: some have no run, some runs can't be edited or lack letters, ranges leave the text or overlap; every fourth part's lines are groups over orders, every sixth order stands or falls as a whole."""
    orders = table(spark, sf_dir, "orders")
    said = F.concat_ws(" ", "o_orderpriority", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderstatus")
    letters = F.split(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXY abcdefghijklmnopqrstuvwxyz0123456789-"), "")
    runs = orders.select(F.col("o_orderkey").alias("run_id"), said.alias("text"), (F.col("o_orderstatus") != "P").alias("editable"), (F.col("o_orderkey") % 6 == 0).alias("whole"), F.when(F.col("o_orderkey") % 3 == 0, letters).alias("characters"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"))
    start = F.col("l_linenumber") * 3 + F.col("p") % 3 - 1
    asked = lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edit_id"), F.when(F.col("l_orderkey") % 97 == 0, -F.col("l_orderkey") - 1).otherwise(F.col("l_orderkey")).alias("run_id"),
        start.cast("int").alias("start"), (start + 1 + F.col("s") % 3).cast("int").alias("end"), F.when(F.col("q") > 48, F.lit("Zürich")).otherwise(F.concat(F.lit("n"), (F.col("p") % 100).cast("string"))).alias("new_text"),
        F.when(F.col("p") % 4 == 0, F.col("p") * 10 + F.col("l_linenumber")).otherwise(0).alias("group"),
    )
    changed, report = edits.apply_edits(asked, runs)
    return report.join(changed.hint("merge"), "run_id", "left")


def stale_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that still hold a passage of the benchmark, as a table of old texts."""
    return rules.stale_copies_of(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def donor_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as fonts whose letters are those of their name and type, customers as requests that need the letters of their segment."""
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    letters = lambda c: F.array_distinct(F.split(F.lower(c), ""))
    fonts = part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("ps_name"), F.col("p_brand").alias("family"), (F.col("p_size") % 2 == 0).alias("bold"), (F.col("p_partkey") % 3 == 0).alias("italic"), ((F.col("p_size") % 9 + 1) * 100).alias("weight"), (F.col("p_partkey") % 7 == 0).alias("priority"), letters(F.concat("p_name", "p_type")).alias("characters"))
    key = F.col("c_custkey")
    named = F.when(key % 4 == 0, "Small-Ring").when(key % 4 == 1, F.concat(F.lit("ABCDEF+Brand#"), (key % 25).cast("string"), F.lit("-Bold"))).when(key % 4 == 2, F.element_at(F.array(*[F.lit(x) for x in ("ring", "WIDGET", "red", "zzz", "")]), (F.pmod(key, F.lit(5)) + 1).cast("int"))).otherwise(F.concat(F.lit("The Brand#"), (key % 30).cast("string"), F.lit(" Extra")))
    asked = customer.select(key.alias("request_id"), named.alias("name"), (F.col("c_nationkey") % 2 == 0).alias("bold"), (key % 3 == 0).alias("italic"), ((key % 9 + 1) * 100).alias("weight"), letters(F.substring("c_mktsegment", 1, 3)).alias("characters"))
    return match.donor_choice(asked, fonts).select("request_id", "ord", F.col("bucket").cast("long").alias("bucket"))


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as revisions: each follows its user's event before, some the one before that; some name one that is not there."""
    events = table(spark, sf_dir, "events")
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.when(F.col("event_id") % 10 == 3, F.coalesce(F.lag("event_id", 2).over(at), F.lag("event_id").over(at))).otherwise(F.lag("event_id").over(at))
    return events.select("event_id", "event_type", F.when(F.col("event_id") % 997 == 7, -F.col("event_id")).otherwise(before).alias("prev"))


def revision_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.chains(_revisions(spark, sf_dir), "event_id")


def as_of_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every hundredth event sees of its chain: of each type the newest event, unless that one deletes the type."""
    revisions = _revisions(spark, sf_dir)
    tips = revisions.filter(F.col("event_id") % 100 == 99).select(F.col("event_id").alias("tip"))
    return versions.as_of(revisions.select("event_id", "event_type"), revisions, tips, ["event_type"], "event_id", deleted=F.col("event_id") % 9 == 0).select("tip", "event_type", "event_id")


def _circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that lead to others of their ten by their customer, some also by their price."""
    orders, ten = table(spark, sf_dir, "orders"), F.floor(F.col("o_orderkey") / 10) * 10
    one = orders.select(F.col("o_orderkey").alias("src"), (ten + F.col("o_custkey") % 10).alias("dst"))
    return one.unionByName(orders.filter(F.col("o_orderkey") % 4 == 0).select(F.col("o_orderkey").alias("src"), (ten + F.floor("o_totalprice") % 10).alias("dst")))


def cycle_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order on a circle, and the finding about that circle."""
    members = graph.cycles(_circular(spark, sf_dir))
    found = graph.cycle_findings(members).select(F.col("subject").cast("long").alias("cycle"), "text")
    return members.join(found, "cycle").select("node", "cycle", "text")


def guarded_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five checks of orders in one pass; one can't be told of some orders, one names a column that isn't there."""
    orders = table(spark, sf_dir, "orders")
    checks = [
        rules.Check("dear", "divergence", F.col("o_totalprice") > 490_000, "dearer than any"),
        rules.Check("open", "trace", (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), "urgent and not done"),
        rules.Check("share", "note", F.try_divide(F.col("o_orderkey"), F.col("o_custkey") % 50) > 10_000, "a share that is too large"),
        rules.Check("priority", "note", F.try_element_at(F.split("o_orderpriority", "-"), F.lit(1)).try_cast("int") > 4, "low"),
        rules.Check("absent", "note", F.col("no_such_column") > 1, "never said"),
    ]
    found = rules.guarded(orders, "o_orderkey", checks)
    return found.select("key", "severity", "subject", F.when(F.col("subject") != "absent", F.col("text")).alias("text"))


def metadata_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' metadata with changes in people's spelling, dates among them, and the mirrors of those that have one."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = lambda *pairs: c.select(key, F.explode(F.create_map(*[x for f, v in pairs for x in (F.lit(f), v)])).alias("field", "value"))
    info = rows(("/Title", F.col("c_name")), ("/Author", F.col("c_mktsegment")), ("/ModDate", F.lit("D:20200102030405Z")))
    mirror = rows(("dc:title", F.col("c_name")), ("xmp:ModifyDate", F.lit("2020-01-02T03:04:05+00:00")), ("own:key", F.lit("stays"))).withColumnRenamed("field", "key").filter(key % 2 == 0)
    said = rows(("author", F.when(key % 4 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("by "), "c_mktsegment"))), ("Modified", F.when(key % 3 == 0, F.lit("2021/05/06")).when(key % 3 == 1, F.lit("now")).otherwise(F.lit("some day"))), ("own name", F.col("c_nationkey").cast("string"))).filter(key % 5 > 0)
    new, mirrored = versions.set_metadata(info, said, ["c_custkey"], F.lit("2024-02-03T04:05:06+01:00"), mirror)
    return new.select("c_custkey", F.col("field").alias("name"), "value").unionByName(mirrored.select("c_custkey", F.col("key").alias("name"), "value"))


def date_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a comparison says of customers' metadata before and after an update: dates apart from the rest, declared fields left out."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = lambda date, title, author: c.select(key, F.explode(F.create_map(F.lit("/ModDate"), date, F.lit("/Title"), title, F.lit("/Author"), author)).alias("key", "value"))
    before = rows(F.lit("D:2020"), F.col("c_name"), F.lit("nobody"))
    after = rows(F.when(key % 3 == 0, F.lit("D:2021")).otherwise(F.lit("D:2020")), F.when(key % 7 == 0, F.lit("new")).otherwise(F.col("c_name")), F.col("c_mktsegment"))
    changes = diff.undeclared(diff.value_diff(before, after, ["c_custkey", "key"], "value"), spark.range(1).select(F.lit("/author").alias("field")))
    return detect.identity_changes(changes, "c_custkey", versions.DATE_FIELDS).select("key", "subject", "text")


def nested_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as nested documents, before and after some names, values, types and lists of theirs change."""
    events, key = table(spark, sf_dir, "events"), F.col("event_id")
    who = lambda kind: F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"who":{"user":'), F.col("user_id").cast("string"), F.lit(',"type":"'), kind, F.lit('","odd name":[]},"tags":['))
    before = F.concat(who(F.col("event_type")), F.lit('"a","b",{"v":'), (key % 4).cast("string"), F.lit('}],"none":null}'))
    tags = F.when(key % 7 == 0, F.lit('"new","a","b",{"v":"')).when(key % 7 == 1, F.lit('"a","b",{"v":"')).otherwise(F.lit('"a","b",{"w":"'))
    after = F.when(key % 3 > 0, before).otherwise(F.concat(who(F.when(key % 2 == 0, F.lit("other")).otherwise(F.col("event_type"))), tags, (key % 4).cast("string"), F.when(key % 5 == 0, F.lit('"}]}')).otherwise(F.lit('"}],"none":[null]}'))))
    left, right = (diff.variant_nodes(events.select(key, said.alias("doc")), ["event_id"], "doc") for said in (before, after))
    return diff.structure_diff(left, right, ["event_id"])


def sequence_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in runs of a thousand as sequences, against the same with some left out, some changed and some put in."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    said = F.concat_ws(" ", key.cast("string"), F.col("o_custkey").cast("string"))
    left = orders.select(F.floor(key / 1000).alias("run"), F.lit(0).alias("sub"), key.alias("k"), said.alias("item"))
    changed = orders.filter(key % 13 > 0).select(F.floor(key / 1000).alias("run"), F.lit(0).alias("sub"), key.alias("k"), F.when(key % 29 == 0, F.concat(F.lit("new "), said)).otherwise(said).alias("item"))
    added = orders.filter(key % 17 == 0).select(F.floor(key / 1000).alias("run"), F.lit(1).alias("sub"), key.alias("k"), F.concat(F.lit("put in "), said).alias("item"))
    placed = lambda df: df.withColumn("at", F.row_number().over(Window.partitionBy("run").orderBy("k", "sub")) - 1)
    return diff.alignment(placed(left), placed(changed.unionByName(added)), ["run"], "at", "item")


def same_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether customers' entries stay the same but for those that say how data are stored."""
    c = table(spark, sf_dir, "customer")
    entries = lambda x, length: x.select("c_custkey", F.map_filter(F.create_map(F.lit("/Name"), F.col("c_name"), F.lit("/Segment"), F.col("c_mktsegment"), F.lit("/Length"), length, F.lit("/Filter"), F.lit("/Flate")), lambda _, v: v.isNotNull()).alias("m"))
    both = entries(c, F.col("c_acctbal").cast("string")).join(entries(_customer_after(c), F.lit("1")).withColumnRenamed("m", "later"), "c_custkey", "left")
    return both.select("c_custkey", detect.same_dictionary(F.col("m"), F.col("later")).alias("same"))


def expected_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of customers' entries under resources: known keys and new fonts are what an edit brings with it."""
    c = table(spark, sf_dir, "customer")
    place = F.when(F.col("c_custkey") % 2 == 0, F.lit("/Resources/Font/")).otherwise(F.lit("/Resources/XObject/"))
    rows = lambda x: x.select("c_custkey", F.map_filter(F.create_map(F.concat(place, F.lit("F1")), F.col("c_mktsegment"), F.concat(place, F.lit("W[0]")), F.col("c_nationkey").cast("string")), lambda _, v: v.isNotNull()).alias("entries"))
    changes = detect.dictionary_changes(rows(_customer_after(c)), rows(c), ["c_custkey"], "entries")
    return changes.select("c_custkey", F.col("entry").alias("path"), "change", diff.expected_path(F.col("entry"), ["W", "Widths"], F.col("change") == "added").alias("expected"))


def greedy_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns cut into the words of the benchmark, the longest first, and single characters."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]{2,12}"), F.lit(0))).alias("word"))
    turns = table(spark, sf_dir, "conversations").withColumn("at", F.concat_ws(" ", "conv_id", "turn"))
    parts = match.longest_match_table(turns, "at", "text", words, "word")
    return parts.groupBy("at").agg(F.count(F.lit(1)).alias("n_parts"), F.count_if("known").alias("n_known"))


def deep_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to 999 orders with branches that lead nowhere."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"))
    on = orders.filter(F.col("src") % 1000 != 999).withColumn("dst", F.col("src") + 1)
    off = orders.filter(F.col("src") % 7 == 0).withColumn("dst", -F.col("src") - 1)
    roots = orders.filter(F.col("src") % 1000 == 0).select(F.col("src").alias("node"))
    return graph.reachable(on.unionByName(off), roots).select("node", F.col("depth").cast("long").alias("depth"))


NAMES = """norm_text norm_positions find_count find_ignore_case find_whole_word find_page_filter find_top_docs find_offsets find_grouped replace_swap
replace_first_n replace_marked replace_pairs splice_edits minimal_edit greedy_encode glyph_spans name_styles field_names metadata_names short_numbers page_lists page_list_errors assignment_maps
dates_round_trip number_scalars visual_lines line_texts consecutive_ranges carry_forward page_text block_alignment line_alignment
object_hash_diff changed_objects set_changes meta_diff expected_partition inherited_introduced structure_diff sequence_diff
ranked_candidates charset_covers required_characters code_widths object_roles nearest_line majority_style reverse_map free_codes minority_rows top_findings rule_outcomes
atomic_groups edit_reasons edit_pieces latest_revision merge_metadata in_place_routes reachability dangling_edges stale_copies
hidden_copies container_changes external_risks signature_coverage width_mismatches orphan_glyphs dictionary_changes
code_maps instructions raw_streams shown_runs
editable_runs codes_in_use known_glyphs missing_characters note_severities overall_outcome line_shifts reading_order line_hints replacement_plan
summary_digests common_order fallback_choice reachable_glyphs composite_glyphs
apply_edits stale_passages donor_choice revision_chains as_of_revision cycle_members deep_reachability planted_copies same_dictionaries expected_additions nested_diff sequence_alignment greedy_codes guarded_rules metadata_update date_findings""".split()
QUERIES = {name: globals()[name] for name in NAMES} | file_queries.QUERIES
