"""Field extraction from OCR blocks.

Every extractor emits matches ``(scan, image, field, key, value)`` where ``key`` says
how early the match would be found: pass, position of the label block, branch, rank of
the neighbour.  The smallest key wins (first match wins), as one grouped aggregate
with map-side combine.  Labels and values meet in one shared spatial join.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscan.functions import labels as L
from labelscan.functions import text as X
from labelscan.functions import vocab as V
from labelscan.functions.similarity import any_header_word, fuzzy_country, fuzzy_label
from labelscan.operators.spatial import GEOMETRY, IMAGE, pairs, reading_key
from labelscan.operators.texts import distinct_rows, once_per_text
from labelscan.session import staged

KEY_TYPE = "struct<p:int,o1:double,o2:double,o3:int,br:int,n1:int,n2:double,n3:double,n4:double,n5:int>"


# --- first match wins ---------------------------------------------------------------------
def match_key(p: int | Column, order: list[Column], branch: int | Column, rank: list[Column] | None = None) -> Column:
    zero = [F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0)]
    return F.struct(F.lit(p), *order, F.lit(branch), *(rank or zero)).cast(KEY_TYPE)


def by_index(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}block_idx").cast("double"), F.lit(0.0), F.lit(0)]


def no_order() -> list[Column]:
    return [F.lit(0.0), F.lit(0.0), F.lit(0)]


def _emit(rows: DataFrame, found: list[tuple[str, Column, Column]]) -> DataFrame:
    """Long matches from (field, key, value) columns of each row; a null value emits nothing."""
    # the values are columns first: each is computed once and not for its test again
    cut = rows.select(*IMAGE, *[key.alias(f"k_{i}") for i, (_, key, _) in enumerate(found)], *[v.alias(f"v_{i}") for i, (_, _, v) in enumerate(found)])
    items = F.array(
        *[
            F.when(F.col(f"v_{i}").isNotNull(), F.struct(F.lit(field).alias("field"), F.col(f"k_{i}").alias("key"), F.col(f"v_{i}").alias("value")))
            for i, (field, _, _) in enumerate(found)
        ]
    )
    # the array is a column of its own, so that it is compiled and not interpreted
    listed = cut.select(*IMAGE, items.alias("ms"))
    return listed.select(*IMAGE, F.explode_outer("ms").alias("m")).filter("m IS NOT NULL").select(*IMAGE, "m.*")


def first_match_wins(matches: DataFrame) -> DataFrame:
    """WIN-3: the match with the smallest key per image and field."""
    best = matches.groupBy(*IMAGE, "field").agg(F.min(F.struct("key", "value")).alias("m"))
    return best.select(*IMAGE, "field", "m.key", "m.value")


# --- blocks ----------------------------------------------------------------------------------
def prepare(blocks: DataFrame, min_confidence: float | None = V.MIN_BLOCK_CONFIDENCE) -> DataFrame:
    """FLT-1 and SCA-1: ASCII digits, and blocks of at least the minimum confidence.

    A missing confidence counts as 1 in ``conf`` and as 0 in ``sure``, the measure of a price
    that stands beside its label."""
    conf = F.coalesce("confidence", F.lit(1.0))
    rows = blocks if min_confidence is None else blocks.filter(conf >= min_confidence)
    raw = X.ascii_digits(F.coalesce("text", F.lit("")))
    extra = [c for c in ("slope",) if c in blocks.columns]
    return rows.select(
        *IMAGE, "block_idx", raw.alias("raw"), X.strip(raw).alias("t"), conf.alias("conf"),
        F.coalesce("confidence", F.lit(0.0)).alias("sure"), *GEOMETRY, *extra,
    )


def image_text(kept: DataFrame) -> DataFrame:
    """FLT-1: the kept texts of an image in block order, joined by a blank."""
    parts = F.array_sort(F.collect_list(F.struct("block_idx", "raw")))
    return kept.filter(F.col("raw") != "").groupBy(*IMAGE).agg(
        F.array_join(F.transform(parts, lambda p: p["raw"]), " ").alias("full_text"),
        F.max(F.col("x_min").isNotNull()).alias("has_geometry"),
        F.max(_flag(kept, "says_origin")).alias("inline_origin"),
    )


def given_text(kept: DataFrame, images: DataFrame | None) -> DataFrame | None:
    """The full texts that come with ``images``, for images whose kept blocks have no text; as of ``image_text``."""
    if images is None or "full_text" not in images.columns:
        return None
    raw = X.ascii_digits(F.col("full_text"))
    read = kept.filter(F.col("raw") != "").select(*IMAGE).distinct()
    one = images.groupBy(*IMAGE).agg(F.max("full_text").alias("full_text")).filter(X.strip(F.col("full_text")) != "")
    return one.join(read, IMAGE, "left_anti").select(
        *IMAGE, raw.alias("full_text"), F.lit(False).alias("has_geometry"), X.has(X.strip(raw), V.ORIGIN_INLINE).alias("inline_origin")
    )


def texts_of_images(kept: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """``image_text``, and where the blocks give none the text that comes with the image."""
    texts, given = image_text(kept), given_text(kept, images)
    return texts if given is None else texts.unionByName(given)


def text_lines(given: DataFrame, kept: DataFrame) -> DataFrame:
    """The lines of given texts in the form of ``kept`` blocks, without boxes."""
    lines = given.select(*IMAGE, F.posexplode(F.split("full_text", r"\r\n|\r|\n")).alias("block_idx", "raw")).filter(X.strip(F.col("raw")) != "")
    full = lines.withColumn("t", X.strip(F.col("raw"))).withColumn("conf", F.lit(1.0))
    types = dict(kept.dtypes)
    return full.select(*[(F.col(c) if c in full.columns else F.lit(None)).cast(types[c]).alias(c) for c in kept.columns])


def after(c: Column, pattern: str) -> Column:
    """Text behind the first match of ``pattern``."""
    return F.regexp_replace(c, r"^(?s:.*?)" + pattern + r"(?s:(.*))$", "$" + str(_groups(pattern) + 1))


def before(c: Column, pattern: str) -> Column:
    """Text ahead of the first match of ``pattern``."""
    return F.regexp_extract(c, r"^((?s:.*?))" + pattern, 1)


def _groups(pattern: str) -> int:
    """Number of capturing groups of a pattern."""
    return re.compile(re.sub(r"\(\?[a-zA-Z]+\)", "", pattern)).groups


def _date(c: Column, pattern: str) -> Column:
    """``MM/YYYY`` of the first match of a date pattern (groups day, month, year)."""
    month = X.month_number(F.regexp_extract(c, pattern, 2))
    year = X.null_if_empty(X.year_number(F.regexp_extract(c, pattern, 3)))
    return F.concat(month, F.lit("/"), year)


def made_value(t: Column) -> Column:
    return F.when(~X.has(t, V.EXPIRY_OR_BATCH), _date(t, V.DATE_VALUE))


def expiry_value(t: Column) -> Column:
    foreign = X.has(t, V.MADE_ONLY_CONTEXT) & ~X.has(t, V.EXPIRY_CONTEXT)
    return F.when(~X.has(t, V.BATCH_ONLY_LINE) & ~foreign, _date(t, V.DATE_VALUE))


def importer_value(c: Column) -> Column:
    return importer_name(X.cut_at_boundary(c))


def importer_name(cut: Column) -> Column:
    """Company part of a text that is already cut at the boundary words."""
    cand = F.regexp_replace(cut, V.COMPANY_SUFFIX, "$1")
    ok = (F.length(cand) >= 2) & ~X.has(cand, V.IMPORTER_REJECT) & X.has(cand, "[A-Za-z]{2,}")
    return F.when(ok, cand)


def count_value(c: Column) -> Column:
    return X.null_if_empty(F.upper(F.regexp_replace(F.regexp_extract(c, V.COUNT_VALUE, 1), r"(?U)\s+", "")))


def promo_value(c: Column) -> Column:
    return X.null_if_blank(F.regexp_extract(c, V.NET_PROMO_VALUE, 1))


def labelled_quantity(c: Column) -> Column:
    return X.null_if_blank(F.regexp_extract(c, V.NET_LABELLED_VALUE, 1))


def generic_quantity(c: Column) -> Column:
    return X.null_if_blank(F.regexp_extract(c, V.NET_GENERIC_VALUE, 1))


def unit_price_piece(c: Column) -> Column:
    """The price text at the start of ``c``; null for a bare quantity."""
    return F.when(~X.has(c, V.QUANTITY_ONLY), X.null_if_empty(F.regexp_extract(c, V.UNIT_PRICE_VALUE, 0)))


def mrp_neighbour(t: Column, sure: Column) -> Column:
    """Price text of a block next to an MRP label."""
    ok = ~X.has(t, V.MRP_SKIP_NEIGHBOUR) & ~X.is_quantity_context(t) & (sure >= V.MRP_MIN_CONFIDENCE)
    plain = X.null_if_empty(F.regexp_extract(t, V.MRP_PRICE_TWO_DIGITS, 1))
    glued = X.null_if_empty(F.regexp_extract(t, V.MRP_GLUED_PRICE, 1))
    return F.when(ok, F.coalesce(plain, F.concat_ws(" ", glued, F.when(glued.isNotNull(), after(t, V.MRP_GLUED_PRICE)))))


def block_phone(t: Column) -> Column:
    """SCA-9: phone of one block: toll-free, labelled, mobile, landline."""
    toll = F.regexp_extract(t, V.TOLL_FREE, 0)
    labelled = X.strip(F.regexp_extract(t, V.CARE_PHONE_BLOCK, 1))
    regulated = X.has(t, V.REGULATORY_CONTEXT)
    pick = lambda p: F.regexp_extract(t, p, 0)
    good = lambda c: (c != "") & X.phone_ok(c, t)
    return (
        F.when(toll != "", F.when(~X.has(before(t, V.TOLL_FREE), V.REGULATORY_CONTEXT), toll))
        .when(good(labelled), labelled)
        .when(~regulated & good(pick(V.MOBILE)), pick(V.MOBILE))
        .when(~regulated & good(pick(V.LANDLINE)), pick(V.LANDLINE))
    )


def is_country_label(t: Column) -> Column:
    form = X.label_form(t)
    return (
        form.contains("country of origin") | form.contains("country oi origin") | X.looks_like_country_label(t)
    )


def unglue(c: Column) -> Column:
    return F.regexp_replace(c, V.ORIGIN_GLUED, "$1 $2 ")


# --- product name tests ------------------------------------------------------------------------
def name_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z]+)"), F.lit(1))


def is_header(v: Column, concept: Column, header_word: Column) -> Column:
    """SCA-19: declaration, header, step, claim or contact text."""
    return (
        L.is_field_label(v, concept) | L.is_section_boundary(v, concept) | concept.isNotNull()
        | X.has(v, V.NAME_STEPS) | X.has(v, V.NAME_DANGLING) | X.has(v, V.NAME_LEADING)
        | X.has(v, V.NAME_CLAIMS) | X.has(v, V.NAME_CARE_TEXT) | F.coalesce(header_word, F.lit(False))
    )


def valid_explicit_name(v: Column, concept: Column, header_word: Column) -> Column:
    """SCA-19: acceptable value of an explicit name label."""
    n = X.squeeze(v)
    return (
        (F.length(n) >= 2) & ~is_header(n, concept, header_word) & ~X.is_address(n)
        & ~X.has_company_suffix(n) & ~X.has(n, V.NAME_EXPLICIT_REJECT) & ~X.has(n, V.NAME_STOP_EXPLICIT)
    )


def plausible_plain_name(v: Column, conf: Column) -> Column:
    """SCA-19: the tests of an unlabelled name that need neither dictionary nor image."""
    n = X.squeeze(v)
    words = F.size(F.regexp_extract_all(n, F.lit("([A-Za-z]{2,})"), F.lit(1)))
    return (
        (F.length(n) >= 3) & ~n.contains("?") & ~n.contains("!") & ~n.endswith(".") & words.between(2, 5)
        & (conf >= V.NAME_MIN_CONFIDENCE) & (X.letters_share(n) >= V.NAME_MIN_LETTERS)
        & ~X.has(n, V.NAME_QUESTION) & ~X.has(n, V.NAME_PROMO) & ~X.has(n, V.NAME_PRICE_WORDS)
        & ~X.has(n, V.NAME_INSTRUCTION) & ~X.has(n, V.NAME_STEPS) & ~X.has(n, V.NAME_DANGLING)
        & ~X.has(n, V.NAME_LEADING) & ~X.has(n, V.NAME_CLAIMS) & ~X.has(n, V.NAME_PLAIN_REJECT)
        & ~X.has(n, V.NAME_PRICE_CODE) & ~X.has(n, V.NAME_STOP_PLAIN) & ~X.is_address(n)
        & ~X.has_company_suffix(n)
    )


#: The tags that labels and values of pairs need; no other field than those of ``NEEDS_TAGS`` asks for them.
TAGS = ["concept", "header_word", "country"]
NEEDS_TAGS = ["batchNumber", "countryOfOrigin", "name"]
#: Tests of a text that blocks may bring along; where they do not, the text is tested on every block.
FLAGS = {
    "statutory": X.is_statutory, "says_origin": lambda t: X.has(t, V.ORIGIN_INLINE), "begins_origin": lambda t: X.has(t, V.ORIGIN_PREFIX_WORD),
}


def _flag(blocks: DataFrame, name: str) -> Column:
    return F.col(name) if name in blocks.columns else FLAGS[name](F.col("t"))


def tag(kept: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Dictionary tags of every block: concept (JN-8), header word, country (SCA-14); ``only`` names some of ``TAGS``."""
    tags = only or ["concept", "header_word", "plain_text", "country"]
    plain = F.col("plain_text") & (F.col("conf") >= V.NAME_MIN_CONFIDENCE)
    return once_per_text(kept, ["t"], lambda texts: tag_texts(texts).select("t", *tags)).select(
        *kept.columns, *[plain.alias("plain_name") if c == "plain_text" else c for c in tags]
    )


def tag_texts(texts: DataFrame) -> DataFrame:
    """The tags that depend on the text ``t`` alone.

    The similarity UDFs see only texts that no exact test settles, and share one
    Arrow exchange.
    """
    t = F.col("t")
    exact, short = L.exact_label(t), L.compact(t)
    low = L.country_candidate(t)
    plain = plausible_plain_name(t, F.lit(1.0))
    # a value next to an explicit label needs the header test as well, whatever its length
    open_texts = texts.select(
        "t", exact.alias("exact"), low.alias("country_low"), plain.alias("plain_text"),
        F.when(exact.isNull() & (F.length(short) >= V.LABEL_FUZZY_LENGTH), short).alias("open_label"),
        F.when(~low.isin(V.COUNTRIES), low).alias("open_country"),
        F.when(exact.isNull(), name_tokens(t)).alias("name_tokens"),
    )
    scored = open_texts.select(
        "t", "exact", "country_low", "plain_text",
        fuzzy_label("open_label").alias("near_label"), fuzzy_country("open_country").alias("near_country"),
        any_header_word("name_tokens").alias("header_word"),
    )
    found = F.coalesce(F.when(F.col("country_low").isin(V.COUNTRIES), F.col("country_low")), F.col("near_country"))
    return scored.select(
        "t", F.coalesce("exact", "near_label").alias("concept"), "header_word", "plain_text",
        F.initcap(F.split(found, " ")[0]).alias("country"),
    )


# --- matches ------------------------------------------------------------------------------------
def _texts_once(tagged: DataFrame) -> DataFrame:
    """The distinct texts of the blocks, with the tags that they carry; the tags depend on the text alone."""
    return distinct_rows(tagged.select("t", *[c for c in TAGS if c in tagged.columns]))


def own_matches(tagged: DataFrame, fields: list[str] | None = None, once: DataFrame | None = None) -> DataFrame:
    """Branches that need nothing but the label block itself; ``once``: its distinct texts, if they are there already."""

    def said(texts):
        parts = [own_values(texts, fields)] if fields is None or set(fields) & OWN_FIELDS else []
        if _asked("countryOfOrigin", fields):
            parts.append(country_values(texts))
        if _asked("name", fields):
            parts.append(explicit_names(texts))
        return reduce(DataFrame.unionByName, parts)

    found = once_per_text(tagged.select(*IMAGE, "block_idx", *GEOMETRY, "t"), ["t"], said, once)
    at = lambda order: match_key(F.col("p"), order, F.col("branch"))
    key = F.when(F.col("by_place"), at(reading_key())).otherwise(at(by_index()))
    return found.select(*IMAGE, "field", key.alias("key"), "value")


#: Fields of ``own_values``.
OWN_FIELDS = {"mrp", "netQuantity", "made", "expiry", "unitSalePrice", "batchNumber", "importerName", "phone"}


def own_values(texts: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(t, field, p, branch, value, by_place): what a label text says of itself, with pass and branch of the match."""
    t = F.col("t")
    # shared pieces become columns first, so that each is computed once per text
    cut = texts.select(
        "t", X.first_match(t, V.MRP_LABEL).alias("mrp_label"),
        after(t, V.MRP_LABEL).alias("mrp_rest"), before(t, V.EXPIRY_INLINE).alias("exp_lead"),
        X.has(t, V.EXPIRY_INLINE).alias("exp_hit"), labelled_quantity(t).alias("labelled_qty"),
        F.when(X.has(t, V.BATCH_LABEL), X.strip(after(t, V.BATCH_LABEL))).alias("batch_rest"),
        F.when(X.has(t, V.UNIT_PRICE_LABEL), unit_price_piece(X.strip(after(t, V.UNIT_PRICE_LABEL)))).alias("usp_piece"),
        F.when(
            X.has(t, V.IMPORTER_INLINE), X.cut_at_boundary(X.strip(F.regexp_extract(t, V.IMPORTER_INLINE, 1)))
        ).alias("importer_rest"),
    ).withColumn("mrp_inline", F.regexp_extract("mrp_rest", V.MRP_INLINE_VALUE, 0))
    label, rest, inline = F.col("mrp_label"), F.col("mrp_rest"), F.col("mrp_inline")
    glued = X.null_if_empty(F.regexp_extract(rest, V.MRP_GLUED_PRICE, 1))
    mrp = (
        F.when(label.isNull(), F.lit(None).cast("string"))
        .when(X.has(inline, V.MRP_PRICE_TWO_DIGITS), X.normalise_mrp(F.concat(label, inline), t))
        .when(glued.isNotNull(), X.normalise_mrp(F.concat_ws(" ", label, glued), t))
    )
    net_block = F.when(X.has(t, V.NET_LABEL), F.col("labelled_qty"))
    exclude = X.contains_any(F.lower(t), V.NET_EXCLUDE_WORDS) | X.has(t, V.NET_EXCLUDE_UNIT_PRICE)
    made = F.when(X.has(t, V.MADE_DATE) & ~X.has(before(t, V.MADE_DATE), V.EXPIRY_OR_BATCH), _date(t, V.MADE_DATE))
    lead_text = F.col("exp_lead")
    foreign = X.has(lead_text, V.MADE_ONLY_CONTEXT) & ~X.has(lead_text, V.EXPIRY_CONTEXT)
    expiry = F.when(F.col("exp_hit") & ~X.has(t, V.BATCH_ONLY_LINE) & ~foreign, _date(t, V.EXPIRY_INLINE))
    usp = F.when(F.col("usp_piece").isNotNull(), X.normalise_unit_price(F.col("usp_piece"), t))
    batch, importer = X.clean_batch(F.col("batch_rest")), importer_name(F.col("importer_rest"))
    found = [
        ("mrp", 0, 0, mrp), ("netQuantity", 0, 0, F.when(X.has(t, V.COUNT_LABEL), count_value(after(t, V.COUNT_LABEL)))),
        ("netQuantity", 0, 2, net_block), ("netQuantity", 0, 4, promo_value(t)), ("netQuantity", 0, 5, F.col("labelled_qty")),
        ("netQuantity", 3, 0, F.when(~exclude, generic_quantity(t))),
        ("made", 0, 0, made), ("expiry", 0, 0, expiry), ("unitSalePrice", 0, 0, usp),
        ("batchNumber", 0, 0, batch), ("importerName", 0, 0, importer), ("phone", 0, 0, block_phone(t)),
    ]
    items = F.array(*[
        F.struct(F.lit(field).alias("field"), F.lit(p).alias("p"), F.lit(branch).alias("branch"), value.alias("value"))
        for field, p, branch, value in found if _asked(field, fields)
    ])
    listed = cut.select("t", items.alias("ms"))
    # the outer form: for the inner one Spark would test the whole array on every row ahead of the distinct texts
    return _said(listed)


def _said(listed: DataFrame, by_place: bool = False) -> DataFrame:
    """The values that are there, out of the lists ``ms``; ``by_place``: blocks are in reading order, not by index."""
    rows = listed.select("t", F.explode_outer("ms").alias("m")).select("t", "m.*").filter("value IS NOT NULL")
    return rows.withColumn("by_place", F.lit(by_place))


def country_values(texts: DataFrame) -> DataFrame:
    """Country branches on single blocks, as of ``own_values``: inline label value, and "In X (by)"."""
    t = F.col("t")
    inline = F.when(is_country_label(t), X.null_if_empty(F.regexp_extract(t, V.COUNTRY_LABEL_INLINE, 1)))
    alone = X.null_if_empty(F.regexp_extract(t, V.ORIGIN_IN, 1))
    few = texts.select("t", inline.alias("a"), alone.alias("b")).filter("a IS NOT NULL OR b IS NOT NULL")
    named = few.select("t", L.valid_country(F.col("a")).alias("va"), L.valid_country(F.col("b")).alias("vb"))
    row = lambda p, value, by_place: named.select(
        "t", F.lit("countryOfOrigin").alias("field"), F.lit(p).alias("p"), F.lit(0).alias("branch"), F.col(value).alias("value"), F.lit(by_place).alias("by_place")
    ).filter("value IS NOT NULL")
    return row(0, "va", True).unionByName(row(5, "vb", False))


#: what a label looks for beside it -> the field that it is found for
SOUGHT = {
    "mrp": "mrp", "count": "netQuantity", "near": "netQuantity", "made": "made", "expiry": "expiry", "batch": "batchNumber",
    "usp": "unitSalePrice", "importer": "importerName", "country": "countryOfOrigin", "fragment": "countryOfOrigin", "name": "name",
}


def _asked(field: str, fields: list[str] | None) -> bool:
    return fields is None or field in fields


def label_fields(texts: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(t, field, rel, dist, x): the fields whose value the label text ``t`` looks for in its neighbours."""
    t = F.col("t")
    far, dates = V.MAX_DISTANCE, V.MAX_DATE_DISTANCE
    exp_lead = before(t, V.EXPIRY_INLINE)
    exp_stop = X.has(t, V.EXPIRY_INLINE) & X.has(exp_lead, V.MADE_ONLY_CONTEXT) & ~X.has(exp_lead, V.EXPIRY_CONTEXT)
    batch_rest = X.strip(after(t, V.BATCH_LABEL))
    usp_rest = X.strip(after(t, V.UNIT_PRICE_LABEL))
    # a label that carries its own value always beats its neighbours: it needs no partner
    lacks = lambda value: value.isNull()
    priced = X.has(F.regexp_extract(after(t, V.MRP_LABEL), V.MRP_INLINE_VALUE, 0), V.MRP_PRICE_TWO_DIGITS)
    labels = [
        ("mrp", "row", far, X.has(t, V.MRP_LABEL) & ~priced),
        ("count", "row_below", far, X.has(t, V.COUNT_LABEL) & lacks(count_value(after(t, V.COUNT_LABEL)))),
        ("near", "near", V.NEARBY_GAP, X.has(t, V.NET_LABEL) & lacks(labelled_quantity(t))),
        ("made", "row_below", dates,
         X.has(t, V.MADE_LABEL) & ~X.has(t, V.MADE_DATE) & ~X.has(t, V.EXPIRY_OR_BATCH)),
        ("expiry", "row_below", dates,
         X.has(t, V.EXPIRY_CONTEXT) & ~X.has(t, V.BATCH_ONLY_LINE) & ~exp_stop & lacks(_date(t, V.EXPIRY_INLINE))),
        ("batch", "row_below", dates, X.has(t, V.BATCH_LABEL) & lacks(X.clean_batch(batch_rest))),
        ("usp", "row", far,
         X.has(t, V.UNIT_PRICE_LABEL) & ~X.has(usp_rest, V.QUANTITY_ONLY) & lacks(unit_price_piece(usp_rest))),
        ("importer", "row", far, X.has(t, V.IMPORTER_INLINE)
         & lacks(importer_value(X.strip(F.regexp_extract(t, V.IMPORTER_INLINE, 1))))),
        ("country", "row", far, is_country_label(t)),
        ("fragment", "right_of", V.RIGHT_GAP, X.has(t, V.ORIGIN_PREFIX)),
        ("name", "row_below", far, X.has(t, V.NAME_LABEL)),
    ]
    items = F.array(*[
        F.when(cond, F.struct(F.lit(f).alias("field"), F.lit(rel).alias("rel"), F.lit(dist).alias("dist"), t.alias("x")))
        for f, rel, dist, cond in labels if _asked(SOUGHT[f], fields)
    ])
    listed = texts.select("t", items.alias("ss"))
    return listed.select("t", F.explode_outer("ss").alias("s")).filter("s IS NOT NULL").select("t", "s.*")


def value_lists(texts: DataFrame, sought: list[str]) -> DataFrame:
    """(t, ss): the values, as (field, x), that a text gives to labels that look for one of ``sought``, if it has any;
    a price needs a sure block too."""
    t = F.col("t")
    name_ok = lambda: valid_explicit_name(t, F.col("concept"), F.col("header_word"))
    values = {
        "mrp": lambda: mrp_neighbour(t, F.lit(1.0)), "count": lambda: count_value(t),
        "near": lambda: F.when(~X.has(t, V.NET_SKIP_UNIT_PRICE), F.coalesce(promo_value(t), generic_quantity(t))),
        "made": lambda: made_value(t), "expiry": lambda: expiry_value(t),
        "batch": lambda: F.when(~L.is_field_label(t, F.col("concept")), X.clean_batch(t)),
        "usp": lambda: unit_price_piece(t), "importer": lambda: importer_value(t), "country": lambda: F.col("country"),
        "fragment": lambda: t, "name": lambda: F.when((t != "") & name_ok(), t),
    }
    # the values are columns first: each is computed once and not for its test again
    cut = texts.select("t", *[values[f]().alias(f"v_{f}") for f in sought])
    items = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"v_{f}").alias("x")) for f in sought])
    listed = cut.select("t", items.alias("ss"))
    # in one list: the blocks of a text are joined once, not once for each of its values
    return listed.select("t", F.filter("ss", lambda s: s["x"] != "").alias("ss")).filter("size(ss) > 0")


def _sides(tagged: DataFrame, fields: list[str] | None = None, once: DataFrame | None = None) -> tuple[DataFrame, DataFrame, list[str]] | None:
    """Label rows and value rows of the shared spatial join, long by field, and what labels look for; None: no label does."""
    place = [*IMAGE, "block_idx", *GEOMETRY]
    once = _texts_once(tagged) if once is None else once
    asks = staged(label_fields(once, fields))
    if _asked("name", fields):
        # a text that says the name itself beats its neighbours
        asks = asks.join(explicit_names(once.filter(X.has(F.col("t"), V.NAME_LABEL))).select("t", F.lit("name").alias("field")), ["t", "field"], "left_anti")
    labels = staged(tagged.select(*place, "t").join(asks, "t").select(*place, "field", "rel", "dist", "x", F.col("t").alias("ctx")))
    # values are looked for only in images, and for fields, that still have such a label
    sought = [f for f, in sorted(labels.select("field").distinct().collect())]
    if not sought:
        return None
    wanted = labels.groupBy(*IMAGE).agg(F.collect_set("field").alias("wanted"))
    given = staged(value_lists(once, sought))
    both = tagged.select(*place, "t", "sure").join(given, "t").join(wanted, IMAGE)
    meant = F.filter("ss", lambda s: F.array_contains("wanted", s["field"]) & ((s["field"] != "mrp") | (F.col("sure") >= V.MRP_MIN_CONFIDENCE)))
    values = both.select(*place, "t", F.explode(meant).alias("s")).select(*place, "s.field", "s.x", F.col("t").alias("ctx"))
    # bands, nearest values and their texts are read from it
    return labels, staged(values), sought


def pair_matches(tagged: DataFrame, fields: list[str] | None = None, once: DataFrame | None = None) -> DataFrame | None:
    """Branches where a label block is paired with a neighbouring value block; None if there is no such label."""
    sides = _sides(tagged, fields, once) if fields is None or set(fields) & set(SOUGHT.values()) else None
    if sides is None:
        return None
    labels, values, sought = sides
    # any value below serves (values are valid ones), so the nearest settles its label
    p = pairs(labels, values, ["x"], ["x", "ctx"], nearest=True)
    label, value, field = F.col("l_x"), F.col("v_x"), F.col("field")
    rank = [F.col(c) for c in ("n1", "n2", "n3", "n4", "n5")]
    k = lambda branch, order=None, pass_no=0: match_key(pass_no, order or by_index("l_"), branch, rank)
    read = reading_key("l_")
    # the long expressions are left out where no label asks for them, so that the rest is compiled
    made = {
        "mrp": lambda: X.normalise_mrp(F.concat_ws(" ", label, value), F.concat_ws(" ", label, F.col("v_ctx"))),
        "usp": lambda: X.normalise_unit_price(value, label),
        "fragment": lambda: F.regexp_extract(unglue(F.concat_ws(" ", label, value)), V.ORIGIN_FRAGMENT, 1),
    }
    text = reduce(lambda rest, f: F.when(field == f, made[f]()).otherwise(rest), [f for f in made if f in sought], value)
    out = F.struct(
        F.when(field.isin("count", "near"), F.lit("netQuantity")).when(field == "batch", F.lit("batchNumber"))
        .when(field == "usp", F.lit("unitSalePrice")).when(field == "importer", F.lit("importerName"))
        .when(field.isin("country", "fragment"), F.lit("countryOfOrigin")).when(field == "name", F.lit("name"))
        .otherwise(field).alias("field"),
        F.when(field == "near", k(3)).when(field == "country", k(1, read)).when(field == "fragment", k(0, None, 2))
        .when(field == "name", k(1, read)).otherwise(k(1)).alias("key"),
        text.alias("value"),
        (field == "fragment").alias("fragment"),
    )
    rows = p.select(*IMAGE, out.alias("m")).select(*IMAGE, "m.*")
    plain = rows.filter("NOT fragment").drop("fragment")
    if "fragment" not in sought:
        return plain
    split = rows.filter("fragment AND value <> ''").select(
        *IMAGE, "field", "key", L.valid_country(F.col("value")).alias("value")
    ).filter("value IS NOT NULL")
    return plain.unionByName(split)


def text_matches(texts: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Fall-backs on the whole text of an image."""
    t = F.col("full_text")
    k = lambda p, branch=0: match_key(p, no_order(), branch)
    # fields that a block has settled already are not searched in the text
    wanted = lambda f: ~F.coalesce(F.array_contains("settled", f), F.lit(False)) if "settled" in texts.columns else F.lit(True)
    guard = lambda c, pat: F.substring(before(c, pat), -V.LOOK_BACK, V.LOOK_BACK)
    behind_usp = after(t, V.UNIT_PRICE_LABEL)
    batch_line = lambda s: F.when(X.has(s, V.BATCH_LABEL), X.clean_batch(X.strip(after(s, V.BATCH_LABEL))))
    fixed, care = F.col("fixed"), F.col("care")
    # (fields, name, column), each step a projection of its own: what a value uses more than once is computed once
    # per text, and only for fields that are looked for
    steps = [
        [(["made"], "fixed", X.repair_digits(t)), (["phone", "email", "website"], "care", X.repair_contact(t))],
        [
            (["netQuantity"], "promo", F.regexp_extract(t, V.NET_PROMO_VALUE, 1)),
            (["netQuantity"], "labelled_qty", F.regexp_extract(t, V.NET_LABELLED_VALUE, 1)),
            (["netQuantity"], "generic_qty", F.regexp_extract(t, V.NET_GENERIC_VALUE, 1)),
            (["made"], "made_lead", guard(fixed, V.MADE_DATE)),
            (["made"], "made_month", F.regexp_extract(fixed, V.MADE_DATE, 2)), (["made"], "made_year", F.regexp_extract(fixed, V.MADE_DATE, 3)),
            (["expiry"], "exp_lead", guard(t, V.EXPIRY_INLINE)),
            (["expiry"], "exp_month", F.regexp_extract(t, V.EXPIRY_INLINE, 2)), (["expiry"], "exp_year", F.regexp_extract(t, V.EXPIRY_INLINE, 3)),
            (["unitSalePrice"], "usp_label", F.when(X.has(t, V.UNIT_PRICE_LABEL), F.regexp_extract(t, V.UNIT_PRICE_LABEL, 0))),
            (["unitSalePrice"], "usp_behind", F.when(X.has(t, V.UNIT_PRICE_LABEL), behind_usp)),
            (["batchNumber"], "batch_rest", F.when(X.has(t, V.BATCH_LABEL), X.strip(after(t, V.BATCH_LABEL)))),
            (["batchNumber"], "batch_lines", F.filter(F.transform(F.split(t, r"\r\n|[\n\r]"), batch_line), lambda s: s.isNotNull())),
            (["phone"], "toll", F.regexp_extract(care, V.TOLL_FREE, 0)),
            (["phone"], "labelled", X.strip(F.regexp_extract(care, V.CARE_PHONE_TEXT, 1))),
            (["email"], "email", F.regexp_extract(care, V.EMAIL, 0)),
            (["website"], "website", F.when(X.has(care, V.CARE_LABEL), F.regexp_extract(care, V.WEBSITE, 0))),
        ],
    ]
    rows = texts
    for step in steps:
        made = [
            F.when(reduce(lambda a, b: a | b, [wanted(f) for f in of if _asked(f, fields)]), value).alias(name)
            for of, name, value in step if any(_asked(f, fields) for f in of)
        ]
        rows = rows.select("*", *made)
    date = lambda m, y: F.concat(X.month_number(F.col(m)), F.lit("/"), X.null_if_empty(X.year_number(F.col(y))))
    lead, labelled, usp_rest = F.col("exp_lead"), F.col("labelled"), X.strip(F.col("usp_behind"))
    foreign = X.has(lead, V.MADE_ONLY_CONTEXT) & ~X.has(lead, V.EXPIRY_CONTEXT)
    phone = F.coalesce(X.null_if_empty(F.col("toll")), F.when((labelled != "") & X.phone_ok(labelled, care), labelled))
    found = [
        ("netQuantity", k(1), X.null_if_blank(F.col("promo"))), ("netQuantity", k(2), X.null_if_blank(F.col("labelled_qty"))),
        ("netQuantity", k(4), X.null_if_blank(F.col("generic_qty"))),
        ("made", k(1), F.when(~X.has(F.col("made_lead"), V.EXPIRY_OR_BATCH), date("made_month", "made_year"))),
        ("expiry", k(1), F.when(~foreign, date("exp_month", "exp_year"))),
        ("unitSalePrice", k(1), X.normalise_unit_price(unit_price_piece(usp_rest), F.concat("usp_label", "usp_behind"))),
        ("batchNumber", k(1), F.try_element_at("batch_lines", F.lit(1))), ("batchNumber", k(2), X.clean_batch(F.col("batch_rest"))),
        ("phone", k(1), phone), ("email", k(0), X.null_if_empty(F.col("email"))), ("website", k(0), X.null_if_empty(F.col("website"))),
    ]
    found = [x for x in found if _asked(x[0], fields)]
    return _emit(rows, [(f, key, F.when(wanted(f), value)) for f, key, value in found])


def _with_countries(rows: DataFrame) -> DataFrame:
    """Rows with the country that their ``phrase`` names; phrases are few and told once each, empty ones are left out."""
    own = staged(rows).filter("phrase <> ''")
    return once_per_text(own, ["phrase"], lambda p: p.select("phrase", L.valid_country(F.col("phrase")).alias("value"))).drop("phrase")


def country_text(texts: DataFrame) -> DataFrame:
    """Country phrases in the whole text (only when they are on one block, or without boxes)."""
    usable = ~F.col("has_geometry") | F.col("inline_origin")
    if "settled" in texts.columns:
        # a block's own match (pass 0) is ahead of both phrases
        usable = usable & ~F.coalesce(F.array_contains("settled", "countryOfOrigin"), F.lit(False))
    f, t = F.lit("countryOfOrigin").alias("field"), F.col("full_text")
    phrases = texts.filter(usable).select(
        *IMAGE, F.array(F.regexp_extract(t, V.ORIGIN_TEXT, 1), F.regexp_extract(t, V.ORIGIN_STANDALONE, 1)).alias("ps")
    ).select(*IMAGE, F.posexplode("ps").alias("at", "phrase"))
    key = F.when(F.col("at") == 0, match_key(1, no_order(), 0)).otherwise(match_key(4, no_order(), 0))
    # a standalone phrase ends the search even when its country is not valid
    return _with_countries(phrases).filter("at = 1 OR value IS NOT NULL").select(*IMAGE, f, key.alias("key"), "value")


def country_rows(row_texts: DataFrame) -> DataFrame:
    """Country phrases broken over the blocks of one visual row (see ``rows``)."""
    phrase = F.regexp_extract(unglue(F.col("row_text")), V.ORIGIN_FRAGMENT, 1)
    few = row_texts.select(
        *IMAGE, "row_id", F.when(X.has(F.col("row_text"), V.ORIGIN_PREFIX_WORD), phrase).alias("phrase")
    )
    order = [F.col("row_id").cast("double"), F.lit(0.0), F.lit(0)]
    return _emit(_with_countries(few), [("countryOfOrigin", match_key(3, order, 0), F.col("value"))])


def importer_next(tagged: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """Importer label whose value is the next block in reading order."""
    w = Window.partitionBy(*IMAGE).orderBy(*reading_key())
    t = F.col("t")
    # a label that names the importer itself always beats the next block; the blocks in order are needed
    # of those images alone that have another such label
    named = importer_value(X.strip(F.regexp_extract(t, V.IMPORTER_INLINE, 1))).isNotNull()
    texts = _texts_once(tagged) if once is None else once
    asks = staged(texts.select("t").filter(X.has(t, V.IMPORTER_LABEL) & ~(X.has(t, V.IMPORTER_INLINE) & named)))
    images = tagged.join(asks, "t", "left_semi").select(*IMAGE).distinct()
    marked = tagged.join(images, IMAGE, "left_semi").join(asks.withColumn("asks", F.lit(True)), "t", "left")
    nxt = staged(marked.select(*IMAGE, "block_idx", *GEOMETRY, "asks", F.lead("t").over(w).alias("nt")).filter("asks AND nt IS NOT NULL"))

    def given(texts):
        tags = tag_texts(texts.withColumnRenamed("nt", "t")).select("t", "concept")
        value = F.when(~L.is_section_boundary(t, F.col("concept")), importer_value(t))
        return tags.select(t.alias("nt"), value.alias("value")).filter("value IS NOT NULL")

    return once_per_text(nxt, ["nt"], given).select(
        *IMAGE, F.lit("importerName").alias("field"), match_key(1, reading_key(), 0).alias("key"), "value"
    )


# --- fonts ---------------------------------------------------------------------------------------
def font_heights(kept: DataFrame, calibration: float | None = None) -> DataFrame:
    """EXT-11: AGG-6 pixel statistics and AGG-7 millimetres of statutory blocks, per image."""
    height = F.col("y_max") - F.col("y_min")
    rows = kept.filter(_flag(kept, "statutory") & (height > 0)).select(
        *IMAGE, "block_idx", "t", height.alias("h"), F.bround(height, 0).cast("int").alias("px")
    )
    measured = F.transform(
        F.array_sort(F.collect_list(F.struct("block_idx", "t", "px"))),
        lambda b: F.struct(b["block_idx"].alias("block_index"), b["t"].alias("text"), b["px"].alias("height_px")),
    )
    usable = calibration is not None and 0 < calibration < float("inf")
    mm = F.bround(F.min("h") / F.lit(float(calibration)), 2) if usable else F.lit(None).cast("double")
    return rows.groupBy(*IMAGE).agg(
        measured.alias("measured_blocks"), F.min("px").alias("smallest_height_px"),
        F.max("px").alias("largest_height_px"), F.median("px").alias("median_height_px"), mm.alias("fontHeightMm"),
    )


# --- product name ------------------------------------------------------------------------------
def explicit_names(texts: DataFrame) -> DataFrame:
    """EXT-12, first choice, as of ``own_values``: value inside the block of an explicit name label."""
    inline = X.null_if_blank(F.regexp_extract("t", V.NAME_LABEL, 1))
    few = texts.select("t", inline.alias("v")).filter("v IS NOT NULL")
    scored = few.select("*", L.canonical_label(F.col("v")).alias("c"), any_header_word(name_tokens(F.col("v"))).alias("h"))
    ok = valid_explicit_name(F.col("v"), F.col("c"), F.col("h"))
    return scored.filter(ok).select(
        "t", F.lit("name").alias("field"), F.lit(0).alias("p"), F.lit(0).alias("branch"), F.col("v").alias("value"), F.lit(True).alias("by_place")
    )


#: What an unlabelled name must not repeat.
USED = ["mrp", "netQuantity", "manufacturerName", "manufacturerAddress", "consumerCare"]


def plain_names(kept: DataFrame, known: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """EXT-12, second choice: first plausible block ahead of the maker's label (WIN-7)
    that repeats no value extracted already (SET-4). ``once``: the distinct texts with their tags (``tag_texts``)."""
    read, t = F.struct(*reading_key()), F.col("t")
    n = X.squeeze(t)

    def told(texts):
        plain = F.col("plain_text") & ~is_header(n, F.col("concept"), F.col("header_word"))
        tagged = tag_texts(texts) if once is None else once
        facts = tagged.select("t", plain.alias("plain"), X.has(t, V.NAME_ENTITY).alias("entity"))
        return facts.filter("plain OR entity")

    found = staged(once_per_text(kept.select(*IMAGE, "block_idx", *GEOMETRY, "t", "conf"), ["t"], told, once))
    start = found.filter("entity").groupBy(*IMAGE).agg(F.min(read).alias("start"))
    cands = found.filter(F.col("plain") & (F.col("conf") >= V.NAME_MIN_CONFIDENCE))
    low = F.lower(n)
    repeated = reduce(
        lambda a, b: a | b,
        [
            F.coalesce(
                (F.length(c) > 2) & (F.lower(c).contains(low) | low.contains(F.lower(c))), F.lit(False)
            )
            for c in (F.col(u) for u in USED)
        ],
    )
    rows = cands.join(start, IMAGE, "left").join(known.select(*IMAGE, *USED), IMAGE, "left").filter(
        F.coalesce(read < F.col("start"), F.lit(True)) & ~repeated
    )
    return _emit(rows, [("name", match_key(1, reading_key(), 0), t)])


# --- suite ---------------------------------------------------------------------------------------
def block_matches(tagged: DataFrame, fields: list[str] | None = None, once: DataFrame | None = None) -> DataFrame:
    """All matches that start from a block; ``once``: the distinct texts with their tags, if they are there already."""
    once = _texts_once(tagged) if once is None else once
    parts = [own_matches(tagged, fields, once), pair_matches(tagged, fields, once)]
    if _asked("importerName", fields):
        parts.append(importer_next(tagged, once))
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def winning_matches(
    tagged: DataFrame, images: DataFrame | None = None, fields: list[str] | None = None, whole: DataFrame | None = None,
    once: DataFrame | None = None,
) -> DataFrame:
    """Best match per image and field; ``images`` may give texts of images without usable blocks.
    ``whole``: the texts of the images (``texts_of_images``), if they are there already; ``once``: the texts of blocks, too.

    The whole text is searched only for fields no block has settled, and visual rows
    are built only for images whose country is still open. ``fields`` names the fields that are
    looked for, all by default; one field's matches do not depend on another's. Blocks need tags
    (``tag``) only for the fields of ``NEEDS_TAGS``.
    """
    from labelscan.operators.rows import visual_row_texts

    by_block = staged(first_match_wins(block_matches(tagged, fields, once)))
    if fields is not None and not set(fields) & TEXT_FIELDS:
        return by_block
    settled = by_block.filter("key.p = 0").groupBy(*IMAGE).agg(F.collect_set("field").alias("settled"))
    texts = (texts_of_images(tagged, images) if whole is None else whole).join(settled, IMAGE, "left")
    texts = staged(texts) if whole is None else texts
    found = by_block
    if fields is None or set(fields) & TEXT_FIELDS - {"countryOfOrigin"}:
        found = found.unionByName(text_matches(texts, fields))
    if not _asked("countryOfOrigin", fields):
        return first_match_wins(found)
    best = staged(first_match_wins(found.unionByName(country_text(texts))))
    placed = best.filter("field = 'countryOfOrigin' AND key.p <= 2").select(*IMAGE)
    broken = (
        tagged.filter(_flag(tagged, "begins_origin")).select(*IMAGE).distinct()
        .join(placed, IMAGE, "left_anti")
    )
    rows = country_rows(visual_row_texts(tagged.join(broken, IMAGE, "left_semi")))
    return first_match_wins(best.unionByName(rows))


#: Fields that are looked for in the whole text too.
TEXT_FIELDS = {
    "netQuantity", "made", "expiry", "unitSalePrice", "batchNumber", "phone", "email", "website", "countryOfOrigin",
}
LONG_FIELDS = [
    "mrp", "netQuantity", "made", "expiry", "unitSalePrice", "batchNumber", "importerName",
    "countryOfOrigin", "phone", "email", "website", "name",
]


def widen(winners: DataFrame) -> DataFrame:
    """One row per image from the winning matches."""
    wide = winners.groupBy(*IMAGE).agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in LONG_FIELDS]
    )
    half = lambda c, i: F.split(F.col(c), "/")[i]
    care = F.concat_ws(
        ", ", "phone", "email",
        F.when(
            ~F.coalesce(F.col("phone").contains(F.col("website")), F.lit(False))
            & ~F.coalesce(F.col("email").contains(F.col("website")), F.lit(False)),
            F.col("website"),
        ),
    )
    return wide.select(
        *IMAGE, "mrp", "netQuantity", half("made", 0).alias("monthOfPacking"), half("made", 1).alias("yearOfPacking"),
        half("expiry", 0).alias("expiryMonth"), half("expiry", 1).alias("expiryYear"), "unitSalePrice",
        "batchNumber", "importerName", "countryOfOrigin", X.null_if_empty(care).alias("consumerCare"),
        F.col("name").alias("labelledName"),
    )


def completeness(fields: DataFrame) -> DataFrame:
    """AGG-4: completeness score and grade; needs mean_conf and quality_status."""
    one = lambda c, pts=1.0: F.when(c, F.lit(pts)).otherwise(F.lit(0.0))
    given = lambda c: F.col(c).isNotNull()
    maker = given("manufacturerName") | given("manufacturerAddress")
    month, year = given("monthOfPacking"), given("yearOfPacking")
    score = (
        one(given("mrp")) + one(given("netQuantity")) + one(maker)
        + F.when(month & year, F.lit(1.0)).when(month | year, F.lit(0.5)).otherwise(F.lit(0.0))
        + one(given("consumerCare"), 0.5) + one(given("productName"), 0.5)
    )
    quality = F.coalesce("quality_status", F.lit("ACCEPTABLE"))
    grade = (
        F.when(quality.isin("POOR", "UNREADABLE") | (score < 2.0), F.lit("LOW"))
        .when(
            (quality == "ACCEPTABLE") & (score >= 3.5) & (F.coalesce("mean_conf", F.lit(0.0)) >= 0.5)
            & given("mrp") & given("netQuantity") & maker & (month | year),
            F.lit("HIGH"),
        )
        .otherwise(F.lit("MEDIUM"))
    )
    return fields.select("*", score.alias("completeness"), grade.alias("extraction_confidence"))


def alike(raw: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Every image with the first one, ``same``, that has the same blocks and the same given text, and its mean confidence.

    ``raw`` are blocks of any confidence (``prepare``). Confidences may differ, as long as they lie on the same side of
    the limits that extraction knows; only unlabelled names ask for more of a block. Equal blocks are told by two
    64-bit hashes of every block, added up over the image: no text is sent through the shuffle.
    """
    usable, null = F.col("conf") >= V.MIN_BLOCK_CONFIDENCE, F.lit(None)
    parts = ["block_idx", *GEOMETRY, *[c for c in ("slope",) if c in raw.columns]]
    # a hash passes over nulls, so that they are told by a flag of their own
    said = [F.col("raw"), usable, F.col("sure") >= V.MRP_MIN_CONFIDENCE, *[x for c in parts for x in (F.isnull(c), F.col(c))]]
    rows = raw.select(*IMAGE, F.when(usable, F.col("conf")).alias("conf"), F.xxhash64(*said).alias("h0"), F.xxhash64(F.lit(1), *said).alias("h1"))
    halves = {f"{h}_{i}": half for h in ("h0", "h1") for i, half in enumerate((F.shiftright(h, 32), F.col(h).bitwiseAND(F.lit(0xFFFFFFFF))))}
    each = rows.groupBy(*IMAGE).agg(F.count("*").alias("n"), *[F.sum(half).alias(name) for name, half in halves.items()], F.avg("conf").alias("mean_conf"))
    content = ["n", *halves]
    if images is not None:
        text = F.max("full_text") if "full_text" in images.columns else F.max(null.cast("string"))
        each = each.join(images.groupBy(*IMAGE).agg(text.alias("given")), IMAGE, "full")
        each = each.fillna(0, content).withColumns({"texted": F.col("given").isNotNull(), "given": F.coalesce("given", F.lit(""))})
        content += ["texted", "given"]
    each = staged(each)
    first = each.groupBy(*content).agg(F.min(F.struct(*IMAGE)).alias("same"))
    return each.join(first, content).select(*IMAGE, "same", F.coalesce("mean_conf", F.lit(0.0)).alias("mean_conf"))


def extract_fields(
    blocks: DataFrame, quality: DataFrame | None = None, calibration: float | None = None, images: DataFrame | None = None
) -> DataFrame:
    """EXT-13: all fields of every image, one row per image.

    Images are those of ``blocks``, however unsure their text is, and those of ``images`` (scan_id, image_idx),
    which may have no block at all; without a usable block the mean confidence is 0, and the whole text is that of
    the optional column full_text of ``images``, whose lines are searched for the manufacturer.

    ``quality`` (scan_id, image_idx, quality_status) is optional and left-joined. Images of the same content are
    read once (``alike``); the column full_text is the text of the image (``texts_of_images``), plainName its
    unlabelled name.
    """
    every = staged(prepare(blocks, None))
    usable = F.col("conf") >= V.MIN_BLOCK_CONFIDENCE
    like = staged(alike(every, images))
    firsts = like.select("same.*").distinct()
    some = None if images is None else images.join(firsts, IMAGE, "left_semi")
    base, once = read_images(every.join(firsts, IMAGE, "left_semi"), calibration, some)
    base = firsts.join(base, IMAGE, "left").select(F.struct(*IMAGE).alias("same"), *[c for c in base.columns if c not in IMAGE])
    base = staged(base)
    known = like.join(base.select("same", *USED), "same")
    plain = first_match_wins(plain_names(every.filter(usable), known, once)).select(*IMAGE, F.col("value").alias("plainName"))
    full = like.join(base, "same").drop("same").join(plain, IMAGE, "left")
    if quality is not None:
        full = full.join(quality.select(*IMAGE, "quality_status"), IMAGE, "left")
    else:
        full = full.withColumn("quality_status", F.lit("ACCEPTABLE"))
    named = full.withColumn("productName", F.coalesce("labelledName", "plainName"))
    return completeness(named).drop("labelledName").withColumn("isImported", F.lit(False))


def read_images(raw: DataFrame, calibration: float | None = None, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All fields of images but for their unlabelled names, with the whole text, and the tagged texts of usable blocks.

    ``raw`` as of ``prepare``, of any confidence.
    """
    from labelscan.operators.maker import extract_maker

    raw = staged(raw)
    kept = raw.filter(F.col("conf") >= V.MIN_BLOCK_CONFIDENCE)
    # every step below reads this one list of texts
    texts = staged(tag_texts(distinct_rows(kept.select("t"))).select("*", *[test(F.col("t")).alias(f) for f, test in FLAGS.items()]))
    once = texts.select("t", *TAGS)
    tagged = staged(kept.join(texts.drop("plain_text"), "t"))
    whole = staged(texts_of_images(tagged, images))
    wide = widen(winning_matches(tagged, images, whole=whole, once=once))
    read, given = tagged, given_text(tagged, images)
    if given is not None:
        lines = staged(text_lines(given, raw))
        # blocks below the confidence floor give way to the text
        raw = raw.join(given.select(*IMAGE), IMAGE, "left_anti").unionByName(lines)
        read, once = tagged.drop(*FLAGS).unionByName(tag(lines, TAGS)), None
    maker, fonts = extract_maker(read, raw, once), font_heights(tagged, calibration)
    return reduce(lambda a, b: a.join(b, IMAGE, "full"), [whole.select(*IMAGE, "full_text"), wide, maker, fonts]), texts
