"""Text helpers as pure Column expressions (no Python UDFs).

Java regular expressions are ASCII-only by default, so patterns carry the
``(?U)`` flag wherever Unicode digits, letters or word boundaries count.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelscan.functions import vocab as V


def strip(c: Column) -> Column:
    """Trim every Unicode white-space character from both ends."""
    return F.btrim(c, F.lit(V.WHITESPACE))


def blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(strip(c) == "", F.lit(True))


def empty(c: Column) -> Column:
    """Null or the empty string (a white-space string is *not* empty)."""
    return F.coalesce(c == "", F.lit(True))


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def null_if_blank(c: Column) -> Column:
    """The stripped text, or null when nothing is left."""
    s = strip(c)
    return F.when(s != "", s)


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """First regex match (or group) of ``pattern``; null when there is none."""
    return null_if_empty(F.regexp_extract(c, pattern, group))


def has(c: Column, pattern: str) -> Column:
    """Null-safe ``rlike``."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def has_digit(c: Column) -> Column:
    return has(c, V.DIGIT_CLASS)


def has_letter(c: Column) -> Column:
    return has(c, r"\p{L}")


def contains_any(c: Column, words) -> Column:
    """True when any of the literal ``words`` occurs in ``c``."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return F.coalesce(out, F.lit(False))


def ascii_digits(c: Column) -> Column:
    """SCA-1: Devanagari digits become ASCII digits."""
    return F.translate(c, V.DEVANAGARI_DIGITS, "0123456789")


def label_form(c: Column) -> Column:
    """SCA-2: lower case, runs of non-alphanumerics become one space."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def squeeze(c: Column) -> Column:
    """Strip, then collapse inner white space."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def letters_share(c: Column) -> Column:
    """Share of letters among all characters."""
    return F.try_divide(
        F.length(F.regexp_replace(c, r"\P{L}", "")).cast("double"),
        F.greatest(F.length(c), F.lit(1)).cast("double"),
    )


def repair_digits(c: Column) -> Column:
    """SCA-7: OCR look-alikes between two digits (bar, I, l -> 1; O -> 0)."""
    ones = F.regexp_replace(c, r"(?i)(?<=\d)[|Il](?=\d)", "1")
    return F.regexp_replace(ones, r"(?i)(?<=\d)[Oo](?=\d)", "0")


def repair_contact(c: Column) -> Column:
    """SCA-8: undo typical OCR damage of e-mail addresses."""
    for pattern, repl in V.CONTACT_REPAIRS:
        c = F.regexp_replace(c, pattern, repl)
    return c


def tokens3(c: Column) -> Column:
    """SCA-27: tokens of at least three characters."""
    parts = F.split(F.lower(strip(c)), r"(?U)[\s:,\-/]+")
    return F.filter(parts, lambda t: F.length(t) >= 3)


#: every prefix of at least three letters of a month name -> its number
MONTH_PREFIXES = {
    name[:n]: f"{i:02d}" for i, name in enumerate(V.MONTH_NAMES, start=1) for n in range(3, len(name) + 1)
}


def month_number(raw: Column) -> Column:
    """SCA-6: month name, its prefix (>= 3 letters) or a number -> ``MM``.

    Anything else gives null. Numeric months are not range checked.
    """
    m = F.lower(strip(raw))
    number_of = F.create_map(*[F.lit(x) for kv in MONTH_PREFIXES.items() for x in kv])
    # anything that is neither a known prefix nor digits has no number
    digits = F.lpad(F.regexp_extract(m, r"^0*(\d+)$", 1), 2, "0")
    return F.coalesce(F.try_element_at(number_of, m), F.when(m.rlike(r"^\d+$"), digits))


def year_number(raw: Column) -> Column:
    y = strip(raw)
    return F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)


def two_decimals(c: Column) -> Column:
    """Price digits with a decimal point: ``899 00``, ``899,5`` and ``899`` -> ``899.00`` etc."""
    c = F.regexp_replace(c, r"(?U)^(\d+)\s+(\d{2})$", "$1.$2")
    c = F.regexp_replace(F.translate(c, ",", "."), r"(?U)^(\d+)$", "$1.00")
    return F.regexp_replace(c, r"(?U)^(\d+)\.(\d)$", "$1.$20")


def normalise_mrp(raw: Column, context: Column) -> Column:
    """SCA-4: the first price of ``raw`` in the standard MRP form."""
    text = strip(raw)
    found = F.regexp_extract(text, V.MRP_PRICE, 1)
    around = F.concat_ws(" ", text, context)
    prefix = F.when(around.contains(V.RUPEE), F.lit(f"MRP {V.RUPEE} ")).otherwise(F.lit("MRP Rs. "))
    taxed = F.translate(around, "()", "  ").rlike(V.MRP_TAX_WORDS)
    tail = F.when(taxed, F.lit(V.MRP_TAX_SUFFIX)).otherwise(F.lit(""))
    return F.when(found == "", text).otherwise(F.concat(prefix, two_decimals(found), tail))


def normalise_unit_price(value: Column, context: Column) -> Column:
    """SCA-5: ``Rs. 40.00/100g`` form of a unit price."""
    ctx = F.when(F.coalesce(context, F.lit("")) != "", context).otherwise(value)
    prefix = F.when(ctx.contains(V.RUPEE), F.lit(f"{V.RUPEE} ")).otherwise(F.lit("Rs. "))
    amount = F.regexp_extract(value, V.UNIT_PRICE_NUMBER, 1)
    # one decimal stays as it is; only whole amounts are padded
    full = F.regexp_replace(F.translate(amount, ",", "."), r"(?U)^(\d+)$", "$1.00")
    tail = F.regexp_replace(F.concat(F.lit("/"), strip(F.regexp_extract(ctx, V.UNIT_PRICE_UNIT, 1))), "^/$", "")
    return F.when(amount == "", strip(value)).otherwise(F.concat(prefix, full, tail))


def quantity_category(c: Column) -> Column:
    """SCA-17: AREA, WEIGHT, VOLUME, LENGTH, NUMBER_OR_UNIT in that order."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(V.QUANTITY_CATEGORIES):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def cut_at_boundary(c: Column) -> Column:
    """SCA-25: drop everything from the first boundary keyword on."""
    return strip(F.regexp_replace(c, V.BOUNDARY_KEYWORDS + r"(?s:.*)$", ""))


def is_company(c: Column) -> Column:
    """SCA-12: may the text be a company name?"""
    n = squeeze(c)
    ok = (
        (n != "")
        & ~contains_any(F.lower(n), V.TRADEMARK_WORDS)
        & ~n.contains("@")
        & ~n.rlike(V.COMPANY_REJECT)
        & ~n.rlike(V.COMPANY_REJECT_START)
    )
    return F.coalesce(ok, F.lit(False))


def has_company_suffix(c: Column) -> Column:
    return has(c, V.COMPANY_WORDS) & ~c.contains("\n")


def company_name(c: Column) -> Column:
    """SCA-11: text up to and including the company suffix, else null."""
    return null_if_empty(strip(F.regexp_extract(c, V.COMPANY_SUFFIX, 1)))


def company_rest(c: Column) -> Column:
    """SCA-11: what follows the company suffix, else null."""
    return null_if_empty(strip(F.regexp_extract(c, V.COMPANY_SUFFIX, 2)))


def is_address(c: Column) -> Column:
    """SCA-13."""
    return has(F.lower(c), V.ADDRESS_PATTERN)


def role_score(header: Column) -> Column:
    """SCA-21: 4 maker, 3 marketer or packer, 2 registered office, else 0."""
    h = F.lower(header)
    return (
        F.when(contains_any(h, V.ROLE_MAKER), F.lit(4))
        .when(contains_any(h, V.ROLE_MARKETER), F.lit(3))
        .when(contains_any(h, V.ROLE_OFFICE), F.lit(2))
        .otherwise(F.lit(0))
    )


def is_statutory(c: Column) -> Column:
    """FLT-9: the block carries a statutory declaration."""
    t = strip(c)
    return (
        (F.length(t) >= 3) & has_letter(t) & ~has(t, V.NON_STATUTORY) & has(t, V.STATUTORY)
    )


def is_quantity_context(c: Column) -> Column:
    """FLT-10: text that is about net quantity, so never a price."""
    return has(c, V.NET_CONTEXT) | has(strip(c), V.BARE_QUANTITY)


def looks_like_country_label(c: Column) -> Column:
    return has(label_form(c), V.COUNTRY_LABEL_LOOSE)


def clean_batch(c: Column) -> Column:
    """SCA-15: a usable batch code, else null."""
    cut = F.regexp_replace(c, V.BATCH_STOP + r"(?s:.*)$", "")
    code = F.btrim(cut, F.lit(V.BATCH_TRIM))
    bad = code.rlike("|".join([V.BATCH_INSTRUCTION, V.BATCH_DATE, V.BATCH_PRICE, V.BATCH_QUANTITY]))
    ok = code.rlike(r"^(?s:.{2,50})$") & code.rlike("[A-Za-z0-9]") & ~bad
    # a code glued to a following label ends before it
    head = F.btrim(F.split(code, V.BATCH_FUSED_SPLIT, 2)[0], F.lit(V.BATCH_TRIM))
    glued = code.rlike(V.BATCH_FUSED_WORD)
    return F.when(ok, F.when(~glued, code).when(F.length(head) >= 2, head))


def phone_ok(phone: Column, context: Column) -> Column:
    """SCA-9: plausible length, and not part of a licence or code."""
    n = F.length(F.regexp_replace(phone, r"(?U)\D", ""))
    return (
        n.between(7, 13)
        & ((n < 12) | phone.startswith("+"))
        & ~has(context, V.REGULATORY_CONTEXT)
    )


def tail_trim(c: Column) -> Column:
    return null_if_empty(F.btrim(c, F.lit(" ,;:-")))
