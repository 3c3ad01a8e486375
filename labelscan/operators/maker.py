"""Manufacturer name and address (EXT-03).

Tier 1 reads sections: a header block, then the blocks up to the next boundary.  The
lower tiers look at single labelled lines, address lines and anchored company names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscan.functions import labels as L
from labelscan.functions import text as X
from labelscan.functions import vocab as V
from labelscan.functions.similarity import first_statutory_word
from labelscan.operators import spatial as SP
from labelscan.operators.rows import row_texts, rows_of_images
from labelscan.operators.spatial import IMAGE, reading_key
from labelscan.operators.texts import distinct_rows, once_per_text
from labelscan.session import staged

POS_BAND = 32
# fixed value: reach of a boundary row around its centre, in heights of the row
BAND_CENTRE = 0.75


def _excluded(c: Column) -> Column:
    low = F.lower(c)
    return X.contains_any(low, V.ALLERGEN_WORDS) | X.contains_any(low, V.TRADEMARK_WORDS)


def _company(c: Column) -> Column:
    return X.has_company_suffix(c) & X.is_company(c)


def with_corrupted(blocks: DataFrame, headers: bool = False) -> DataFrame:
    """SCA-26: word and rest of a damaged statutory label.

    Adds ``c_word`` and ``c_rest``, null without such a label, and unless ``headers`` also
    for the texts that hold a proper section header.
    """
    t = F.col("t")
    known = F.lit(False) if headers else X.has(t, V.SECTION_HEADER)
    words = F.regexp_extract_all(F.lower(t), F.lit(V.CORRUPTED_LABEL), F.lit(1))
    scored = blocks.withColumn("_at", first_statutory_word(F.when(~known & (F.size(words) > 0), words)))
    # text up to and including the n-th candidate, then an optional second "by" or colon
    whole = F.regexp_extract_all(t, F.lit(r"(?s)(.*?" + V.CORRUPTED_LABEL.replace("(?iU)", "(?iU:") + "))"), F.lit(1))
    head = F.array_join(F.slice(whole, F.lit(1), F.col("_at") + 1), "")
    rest = F.expr("substring(t, length(_head) + 1)")
    word = F.try_element_at(words, F.col("_at") + 1)
    tail_free = F.regexp_replace(F.col("_rest"), V.CORRUPTED_LABEL_TAIL, "")
    return (
        scored.withColumn("_word", word).withColumn("_head", F.when(F.col("_at").isNotNull(), head))
        .withColumn("_rest", F.when(F.col("_at").isNotNull(), rest))
        .withColumn("c_rest", F.when(F.col("_rest").isNotNull(), X.strip(tail_free)))
        .withColumn("c_word", F.col("_word")).drop("_at", "_word", "_head", "_rest")
    )


def _first_company(start: Column, parts: Column, front: bool = False) -> Column:
    """Parts are put behind (or in front of) ``start`` one by one until the text names a company.

    A struct of the number of parts used and that text; its text is null if no part completes a company.
    """
    none = F.lit(None).cast("string")
    begin = F.struct(start.alias("all"), F.lit(0).alias("i"), none.alias("s"))

    def step(acc, part):
        more = F.concat_ws(" ", part, acc["all"]) if front else F.concat_ws(" ", acc["all"], part)
        grown = F.struct(more.alias("all"), (acc["i"] + 1).alias("i"), F.when(_company(more), more).alias("s"))
        return F.when(acc["s"].isNotNull(), acc).otherwise(grown)

    return F.aggregate(parts, begin, step, lambda acc: F.struct(acc["i"].alias("i"), acc["s"].alias("s")))


def _joined_without_end(parts: Column, pattern: str) -> Column:
    """The parts joined by a blank, without those at the end that hold the pattern."""
    last_good = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), F.lit(0),
        lambda a, i: F.when(~F.coalesce(F.try_element_at(parts, i).rlike(pattern), F.lit(True)), i).otherwise(a),
    )
    return X.null_if_empty(F.array_join(F.slice(parts, F.lit(1), last_good), " "))


def _clean_name(c: Column) -> Column:
    c = X.strip(F.regexp_replace(c, r"(?U)^[^\w\s]+", ""))
    return X.strip(F.regexp_replace(c, r"(?U)^\d+\s+(?=[A-Za-z])", ""))


def _row_boundaries(ordered: DataFrame) -> DataFrame:
    """WIN-6: blocks at the height of a visual row that holds a boundary text, as ``row_bnd``.

    Rows are the greedy ones with running geometry (WIN-4). A row counts by its joined text or by
    one of its blocks; its band then covers every block that overlaps it or whose centre is near
    its own, in whatever row that block stands. Bands and blocks meet by stripes of the image.
    """
    # the rows are read four times below
    rows = staged(rows_of_images(ordered, ordered.columns))
    texts = row_texts(rows).filter(F.col("n") > 1)
    texts = staged(texts.select(*IMAGE, "row_id", "row_text"))
    found = lambda once: once.withColumn("concept", L.canonical_label(F.col("row_text"))).filter(
        L.is_section_boundary(F.col("row_text"), F.col("concept"))).select("row_text")
    by_text = once_per_text(texts, ["row_text"], found).select(*IMAGE, "row_id", F.lit(True).alias("by_text"))
    bands = rows.join(by_text, [*IMAGE, "row_id"], "left").groupBy(*IMAGE, "row_id").agg(
        F.min("y_min").alias("top"), F.max("y_max").alias("bottom"), F.max(F.col("bnd_self") | F.coalesce("by_text", F.lit(False))).alias("marked")
    ).filter("marked AND top IS NOT NULL")
    centre, height = (F.col("top") + F.col("bottom")) / 2.0, F.greatest(F.col("bottom") - F.col("top"), F.lit(1))
    reach = height * BAND_CENTRE
    stripes = lambda low, high: F.explode(F.sequence(F.floor(low / SP.BAND), F.floor(high / SP.BAND))).alias("stripe")
    spread = bands.select(*IMAGE, "top", "bottom", centre.alias("centre"), reach.alias("reach"), stripes(centre - reach, centre + reach))
    places = rows.filter("y_min IS NOT NULL").select(*IMAGE, "pos", "y_min", "y_max", stripes(F.col("y_min"), F.col("y_max")))
    overlap = F.least("bottom", "y_max") > F.greatest("top", "y_min")
    near = F.abs((F.col("y_min") + F.col("y_max")) / 2.0 - F.col("centre")) <= F.col("reach")
    both = [F.col(f"p.{c}") == F.col(f"b.{c}") for c in (*IMAGE, "stripe")]
    hit = places.alias("p").join(spread.alias("b"), [*both, overlap | near], "left_semi").select(*IMAGE, "pos").distinct()
    return rows.join(hit.withColumn("row_bnd", F.lit(True)), [*IMAGE, "pos"], "left").select(
        *ordered.columns, F.coalesce("row_bnd", F.lit(False)).alias("row_bnd")
    )


def _line_facts(texts: DataFrame) -> DataFrame:
    """What sections ask of a text ``t`` with its concept, whatever stands around it."""
    t = F.col("t")
    bnd = L.is_section_boundary(t, F.col("concept"))
    return with_corrupted(texts).select(
        "t", "c_rest", "c_word", bnd.alias("bnd_self"), _company(t).alias("comp"),
        (bnd | X.has(t, V.SECTION_HEADER) | X.contains_any(F.lower(t), V.TRADEMARK_WORDS)).alias("stop_self"),
        X.label_form(t).alias("form"), L.compact(t).alias("short"),
    )


def _header_facts(facts: DataFrame) -> DataFrame:
    """Of the texts that are section headers: role, what follows in the block, and how many companies may follow."""
    t = F.col("t")
    known = X.has(t, V.SECTION_HEADER)
    targets = F.create_map(*[F.lit(x) for kv in V.STATUTORY_TARGETS for x in kv])
    header_text = F.concat(F.regexp_extract(t, r"^((?s:.*?))" + V.SECTION_HEADER, 1), F.regexp_extract(t, V.SECTION_HEADER, 0))
    rest = F.when(known, F.regexp_replace(t, r"^(?s:.*?)" + V.SECTION_HEADER, "")).otherwise(F.col("c_rest"))
    inline = X.strip(F.regexp_replace(X.strip(rest), V.INLINE_LEFTOVER, ""))
    headers = facts.filter((known | F.col("c_word").isNotNull()) & ~_excluded(t)).select(
        "t", (~known).alias("damaged"),
        F.when(known, X.role_score(header_text)).otherwise(F.coalesce(_target_score(F.col("c_word"), targets), F.lit(2))).alias("score"),
        inline.alias("inline"),
    )
    return headers.withColumn("allowed", F.when(_company(F.col("inline")), F.lit(0)).otherwise(F.lit(1)))


def sections(tagged: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """Headers with the lines that follow them up to the next boundary; ``once``: the distinct texts with their concept."""
    w = Window.partitionBy(*IMAGE).orderBy(*reading_key())
    t = F.col("t")
    slope = F.col("slope") if "slope" in tagged.columns else F.lit(0.0)
    # the concept belongs to the text
    facts = staged(_line_facts(distinct_rows(tagged.select("t", "concept")) if once is None else once.select("t", "concept")))
    heads = staged(_header_facts(facts))
    # images without a header have no section
    images = tagged.join(heads, "t", "left_semi").select(*IMAGE).distinct()
    blocks = tagged.join(images, IMAGE, "left_semi").select(*IMAGE, "block_idx", *SP.GEOMETRY, "t", slope.cast("double").alias("sl"))
    ordered = blocks.join(facts, "t").select(
        "*", F.row_number().over(w).alias("pos"),
        *[F.lead(c, n).over(w).alias(f"{c}{n}") for c in ("form", "short") for n in (1, 2)],
    )

    def ahead(n):
        whole = F.concat_ws(" ", "form", f"form{n}")
        concept = L.exact_compact(F.concat("short", f"short{n}"))
        return F.coalesce(F.col(f"form{n}").isNotNull() & L.is_section_boundary(whole, concept), F.lit(False))

    marked = ordered.withColumn("stop", F.col("stop_self") | ahead(1) | ahead(2)).select(
        *blocks.columns, "pos", "stop", "bnd_self", "comp"
    )
    flagged = _row_boundaries(marked).withColumn("stop", F.col("stop") | F.col("row_bnd"))
    later = w.rowsBetween(1, Window.unboundedFollowing)
    flagged = flagged.withColumn("next_stop", F.min(F.when(F.col("stop"), F.col("pos"))).over(later))
    # three branches read the flagged blocks below
    flagged = staged(flagged.select(*IMAGE, "pos", "t", "sl", "comp", "next_stop"))
    headers = flagged.join(heads, "t").select(
        *IMAGE, F.col("pos").alias("h_pos"), "damaged", "score", "inline", "allowed",
        F.coalesce("next_stop", F.lit(2**31 - 1)).alias("until"), F.col("sl").alias("h_sl"),
    )
    # range join header -> following blocks, banded on the position
    bands = F.sequence(
        F.floor(F.col("h_pos") / POS_BAND), F.floor(F.least(F.col("until"), F.col("last_pos") + 1) / POS_BAND)
    )
    last = flagged.groupBy(*IMAGE).agg(F.max("pos").alias("last_pos"))
    spread = headers.join(last, IMAGE).select("*", F.explode(bands).alias("band"))
    lines = flagged.select(
        *IMAGE, F.col("pos"), F.col("t").alias("line"), "comp", F.col("sl"), F.floor(F.col("pos") / POS_BAND).alias("band")
    )
    span = spread.join(lines, [*IMAGE, "band"]).filter((F.col("pos") > F.col("h_pos")) & (F.col("pos") < F.col("until")))
    hw = Window.partitionBy(*IMAGE, "h_pos").orderBy("pos")
    kept = span.withColumn("n_comp", F.sum(F.col("comp").cast("int")).over(hw)).filter("n_comp <= allowed")
    listed = kept.groupBy(*IMAGE, "h_pos").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line", "sl"))).alias("span")
    )
    return headers.join(listed, [*IMAGE, "h_pos"], "left").withColumn("lines", _straight_lines())


def _target_score(word: Column, targets: Column) -> Column:
    return F.try_element_at(targets, word)


def plausible_slope(slope: Column, previous: Column) -> Column:
    """SCA-18: level, or about as slanted as the previous block; true without a box."""
    return F.coalesce((slope <= 0.12) | (F.abs(slope - previous) <= 0.04), F.lit(True))


def _straight_lines() -> Column:
    """SCA-18: lines that are level, or as slanted as the last accepted one."""
    start = F.struct(F.col("h_sl").alias("prev"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        ok = plausible_slope(x["sl"], acc["prev"])
        return F.when(
            ok, F.struct(x["sl"].alias("prev"), F.concat(acc["out"], F.array(x["line"])).alias("out"))
        ).otherwise(acc)

    return F.coalesce(
        F.aggregate(F.coalesce("span", F.array().cast("array<struct<pos:int,line:string,sl:double>>")), start, step)["out"],
        F.array().cast("array<string>"),
    )


def section_names(found: DataFrame) -> DataFrame:
    """Company and address of every section that names one; read once from sections of the same text."""
    found = staged(found.select(*IMAGE, "h_pos", "score", "damaged", "inline", "lines"))
    named = once_per_text(found, ["damaged", "inline", "lines"], _names_of_sections)
    return named.select(*IMAGE, "h_pos", "score", "name", "address")


def _names_of_sections(found: DataFrame) -> DataFrame:
    """Company and address by (damaged, inline, lines)."""
    inline, lines = F.col("inline"), F.col("lines")
    n = F.size(lines)
    none = F.array().cast("array<string>")
    opt = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    tail = lambda k: F.slice(lines, k + 1, F.greatest(n - k, F.lit(0)))
    given = inline != ""
    open_inline = given & ~_company(inline) & ~X.is_address(inline)
    opened = found.select(
        "*", F.when(open_inline, _first_company(inline, lines)).alias("cont"),
        F.try_element_at(F.filter(lines, lambda s: _company(s)), F.lit(1)).alias("own_line"),
    )
    cont, own = F.col("cont"), F.col("own_line")
    by_inline, by_cont = given & _company(inline), cont["s"].isNotNull()
    bare = open_inline & ~by_cont & X.is_company(inline)
    name = (
        F.when(by_inline, X.company_name(inline)).when(by_cont, X.company_name(cont["s"]))
        .when(bare, inline).when(own.isNotNull(), X.company_name(own))
    )
    first = (
        F.when(by_inline, opt(X.company_rest(inline)))
        .when(by_cont, F.concat(opt(X.company_rest(cont["s"])), tail(cont["i"])))
        .when(bare, none).when(own.isNotNull(), opt(X.company_rest(own))).otherwise(none)
    )
    named = opened.select("*", name.alias("raw_name"), first.alias("addr1")).filter("raw_name IS NOT NULL")
    valid = named.filter(~F.col("damaged") | _company(F.col("raw_name"))).withColumn("name", _clean_name(F.col("raw_name")))
    at = F.array_position(F.transform(lines, lambda s: s.contains(F.col("name"))), F.lit(True)).cast("int")
    more = (
        F.when(at > 0, tail(at)).when(given & ~by_cont, lines).otherwise(none)
    )
    parts = F.filter(F.concat("addr1", more), lambda s: s != "")
    # licence lines at the end are no address
    address = _joined_without_end(parts, V.LICENCE_LINE)
    return valid.select("damaged", "inline", "lines", "name", address.alias("address"))


def best_section(named: DataFrame) -> DataFrame:
    """SRT-7: best role first, then reading order; a missing address is borrowed from
    the next section of the same company."""
    order = F.struct((-F.col("score")).alias("s"), F.col("h_pos").alias("h"))
    best = named.groupBy(*IMAGE).agg(F.min_by(F.struct("name", "address"), order).alias("b"))
    other = named.filter("address IS NOT NULL").join(best, IMAGE).filter(
        F.lower("b.name").contains(F.lower("name")) | F.lower("name").contains(F.lower("b.name"))
    ).groupBy(*IMAGE).agg(F.min_by("address", order).alias("borrowed"))
    return best.join(other, IMAGE, "left").select(
        *IMAGE, F.col("b.name").alias("name"), F.coalesce("b.address", "borrowed").alias("address")
    )


def labelled_lines(tagged: DataFrame) -> DataFrame:
    """Tiers 2 and 3: the first maker line, completed by the first address line."""
    w = Window.partitionBy(*IMAGE).orderBy("block_idx")
    rows = tagged.filter(F.col("t") != "").select(
        *IMAGE, "block_idx", "t", F.lead("t").over(w).alias("nt")
    ).filter(~_excluded(F.col("t")))
    nt = F.col("nt")
    body = X.strip(F.regexp_extract("t", V.MAKER_LINE, 1))
    lines = rows.filter(X.has(F.col("t"), V.MAKER_LINE) & ~_excluded(body)).withColumn("x", X.cut_at_boundary(body))
    lines = lines.withColumn("co", _company(F.col("x")))
    x, co = F.col("x"), F.col("co")
    name0 = F.when(co, X.company_name(x)).when((x != "") & X.is_company(x), x).otherwise(nt)
    rest = X.company_rest(x)
    addr0 = F.when(co & X.is_address(rest), rest)
    begun = lines.select(*IMAGE, "block_idx", "nt", name0.alias("n0"), addr0.alias("a0"))
    n0 = F.col("n0")
    both = F.concat_ws(" ", n0, nt)
    open_name = (
        n0.isNotNull() & nt.isNotNull() & ~X.is_address(nt)
        & ((F.length(n0) < 5) | ~n0.rlike(r"(?:Ltd|Limited|Inc|LLP)$"))
    )
    begun = begun.withColumn("grows", open_name & _company(both))
    grows = F.col("grows")
    follows = open_name & ~grows & X.contains_any(F.lower(nt), V.NAME_CONTINUATION_WORDS)
    n1 = F.when(grows, X.company_name(both)).when(follows, both).otherwise(n0)
    a1 = F.when(grows & X.is_address(X.company_rest(both)), X.company_rest(both)).otherwise(F.col("a0"))
    done = begun.withColumn("n1", n1).withColumn("a1", a1)
    a2 = F.coalesce(
        "a1", F.when((nt != F.col("n1")) & X.is_address(nt) & ~_excluded(nt), nt)
    )
    maker = done.select(*IMAGE, "block_idx", "n1", a2.alias("a2")).groupBy(*IMAGE).agg(
        F.min_by(F.struct("n1", "a2"), "block_idx").alias("m")
    )
    raw = X.cut_at_boundary(X.strip(F.regexp_extract("t", V.ADDRESS_LINE, 1)))
    addr_rows = rows.filter(X.has(F.col("t"), V.ADDRESS_LINE)).withColumn("r", raw)
    addr_rows = addr_rows.withColumn("comp", _company(F.col("r"))).withColumn("nxt", X.cut_at_boundary(nt))
    r, nxt, comp = F.col("r"), F.col("nxt"), F.col("comp")
    next_addr = F.when(X.is_address(nxt), nxt)
    a_name = F.when(comp, X.company_name(r)).when(~X.is_address(r) & (r != "") & X.is_company(r), r)
    a_addr = (
        F.when(comp & X.is_address(X.company_rest(r)), X.company_rest(r)).when(comp, next_addr)
        .when(X.is_address(r), r).otherwise(next_addr)
    )
    addresses = addr_rows.select(*IMAGE, "block_idx", a_name.alias("an"), a_addr.alias("aa")).groupBy(*IMAGE).agg(
        F.min_by(F.struct("an", "aa"), "block_idx").alias("a")
    )
    both_sides = maker.join(addresses, IMAGE, "full")
    lacking = F.col("m.n1").isNull() | F.col("m.a2").isNull()
    return both_sides.select(
        *IMAGE, F.coalesce("m.n1", "a.an").alias("name"),
        F.when(lacking, F.coalesce("a.aa", "m.a2")).otherwise(F.col("m.a2")).alias("address"),
    )


def anchored_companies(tagged: DataFrame) -> DataFrame:
    """Tier 4: an unlabelled company with a maker label in its block or within 60 px.

    A company of one word takes its neighbours in front, nearest first, until the text names a
    company. An address that does not stand in the block is read from the blocks that follow.
    """
    t = F.col("t")
    slope = F.col("slope") if "slope" in tagged.columns else F.lit(0.0)
    w = Window.partitionBy(*IMAGE).orderBy(*reading_key())
    marked = staged(with_corrupted(tagged, headers=True).select(
        *IMAGE, "block_idx", *SP.GEOMETRY, "t", F.row_number().over(w).alias("pos"), slope.cast("double").alias("sl"),
        (X.has(t, V.MAKER_ANCHOR) | F.col("c_word").isNotNull()).alias("anchor"),
        (X.contains_any(F.lower(t), V.TRADEMARK_WORDS) | L.is_section_boundary(t, F.col("concept"))).alias("stop"),
    ))
    companies = marked.filter(_company(t) & ~_excluded(t))
    as_labels = lambda rows, gap: rows.withColumns({"field": F.lit("block"), "rel": F.lit("near"), "dist": F.lit(gap)})
    anchors = marked.filter("anchor").withColumn("field", F.lit("block"))
    near = SP.pairs(as_labels(companies.filter("NOT anchor"), V.ANCHOR_GAP), anchors, [], [])
    near = near.select(*IMAGE, F.col("l_block_idx").alias("block_idx")).distinct()
    own = companies.filter("anchor").select(*IMAGE, "block_idx")
    good = companies.join(own.unionByName(near), [*IMAGE, "block_idx"], "left_semi")
    head, rest = X.company_name(t), X.company_rest(t)
    words = F.size(F.regexp_extract_all(head, F.lit("([A-Za-z]+)"), F.lit(1)))
    good = staged(good.select(
        "*", F.coalesce((words >= 2) & X.is_company(head), F.lit(False)).alias("whole"),
        head.alias("head"), F.when(X.is_address(rest), rest).alias("rest"),
    ))
    whole = good.filter("whole").select(*IMAGE, "block_idx", "pos", "sl", F.col("head").alias("name"), F.col("rest").alias("address"))
    values = marked.filter((t != "") & ~_excluded(t)).withColumn("field", F.lit("block"))
    around = SP.pairs(as_labels(good.filter("NOT whole"), V.NEARBY_GAP), values, ["t", "pos", "sl"], ["t"])
    nearest = F.array_sort(F.collect_list(F.struct("n1", "n2", "n3", "n4", "n5", "v_t")))
    parts = around.groupBy(*IMAGE, "l_block_idx", "l_pos", "l_sl", "l_t").agg(F.transform(nearest, lambda x: x["v_t"]).alias("parts"))
    grown = parts.select(
        *IMAGE, F.col("l_block_idx").alias("block_idx"), F.col("l_pos").alias("pos"), F.col("l_sl").alias("sl"),
        X.company_name(_first_company(F.col("l_t"), F.col("parts"), front=True)["s"]).alias("name"), F.lit(None).cast("string").alias("address"),
    ).filter("name IS NOT NULL")
    first = whole.unionByName(grown).groupBy(*IMAGE).agg(
        F.min_by(F.struct("name", "address", "pos", "sl"), "block_idx").alias("c")
    ).select(*IMAGE, "c.*")
    return _with_following_address(first, marked)


def _with_following_address(first: DataFrame, marked: DataFrame) -> DataFrame:
    """Companies without an address take the blocks behind them in reading order.

    The lines end at a boundary or a trademark owner; a line counts only if it is about as level as
    the last one that did; lines with a maker label are passed over; licence lines at the end go.
    """
    places = first.filter("address IS NULL").select(*IMAGE, F.col("pos").alias("c_pos"), F.col("sl").alias("c_sl"))
    behind = marked.join(places, IMAGE).filter(F.col("pos") > F.col("c_pos"))
    lines = behind.groupBy(*IMAGE, "c_sl").agg(F.array_sort(F.collect_list(F.struct("pos", "t", "sl", "anchor", "stop"))).alias("lines"))
    none = F.array().cast("array<string>")
    begin = F.struct(F.col("c_sl").alias("prev"), none.alias("out"), F.lit(True).alias("open"))

    def step(acc, x):
        kept = F.struct(
            x["sl"].alias("prev"), F.when(x["anchor"], acc["out"]).otherwise(F.concat(acc["out"], F.array(x["t"]))).alias("out"), F.lit(True).alias("open")
        )
        ended = F.struct(acc["prev"].alias("prev"), acc["out"].alias("out"), F.lit(False).alias("open"))
        return F.when(~acc["open"], acc).when(x["stop"], ended).when(plausible_slope(x["sl"], acc["prev"]), kept).otherwise(acc)

    read = lines.select(*IMAGE, F.aggregate("lines", begin, step, lambda acc: acc["out"]).alias("parts"))
    found = read.select(*IMAGE, _joined_without_end(F.col("parts"), V.LICENCE_OR_ARTICLE).alias("following"))
    return first.join(found, IMAGE, "left").select(*IMAGE, "name", F.coalesce("address", "following").alias("address"))


def raw_companies(raw: DataFrame) -> DataFrame:
    """Tier 5: a company in a block of any confidence that carries a maker label itself."""
    t = F.col("t")

    def named(texts):
        marked = with_corrupted(texts).filter((X.has(t, V.MAKER_ANCHOR) | F.col("c_word").isNotNull()) & ~_excluded(t))
        words = F.size(F.regexp_extract_all("t", F.lit("([A-Za-z]+)"), F.lit(1)))
        return marked.filter(_company(t) & (words >= 2)).select("t", X.company_name(t).alias("name"))

    rows = staged(raw.select(*IMAGE, "block_idx", "t"))
    return once_per_text(rows, ["t"], named).groupBy(*IMAGE).agg(F.min_by("name", "block_idx").alias("name"))


def extract_maker(tagged: DataFrame, raw: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """EXT-03: manufacturerName and manufacturerAddress per image; the best tier wins.

    The lower tiers look only at images whose name is still open. ``once``: as of ``sections``.
    """
    one = best_section(staged(section_names(sections(tagged, once)))).withColumn("by_section", F.lit(True))
    one = staged(one)
    open_ = lambda blocks, *named: reduce(lambda rows, x: rows.join(x, IMAGE, "left_anti"), named, blocks)
    two = labelled_lines(open_(tagged, one.select(*IMAGE))).select(*IMAGE, F.col("name").alias("n2"), F.col("address").alias("a2"))
    upper = staged(one.join(two, IMAGE, "full"))
    settled = upper.filter("name IS NOT NULL OR n2 IS NOT NULL").select(*IMAGE)
    four = staged(anchored_companies(open_(tagged, settled))).select(*IMAGE, F.col("name").alias("n4"), F.col("address").alias("a4"))
    five = raw_companies(open_(raw, settled, four.select(*IMAGE))).select(*IMAGE, F.col("name").alias("n5"))
    both = upper.join(four, IMAGE, "full").join(five, IMAGE, "full")
    name = F.coalesce("name", "n2", "n4", "n5")
    address = F.when(F.col("by_section"), F.col("address")).when(F.col("n2").isNotNull(), F.col("a2")).otherwise(F.coalesce("a2", "a4"))
    return both.select(
        *IMAGE, X.tail_trim(_clean_name(name)).alias("manufacturerName"), X.tail_trim(address).alias("manufacturerAddress")
    )
