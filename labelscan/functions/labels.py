"""Label vocabulary: canonical concepts, boundaries and countries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscan.functions import vocab as V
from labelscan.functions.similarity import VARIANTS, fuzzy_country, fuzzy_label
from labelscan.functions.text import has, label_form, looks_like_country_label, null_if_empty, squeeze, strip

# An ordered alternation picks the first dictionary entry that is a prefix.
_PREFIX = "^(" + "|".join(re.escape(v) for _, v in VARIANTS) + ")"
_CONCEPT_OF: dict[str, str] = {}
for _concept, _variant in VARIANTS:
    _CONCEPT_OF.setdefault(_variant, _concept)


_LABEL_FORMS = [
    f"{name}|" + " ".join(re.findall("[a-z0-9]+", v.lower()))
    for name, variants in V.CANONICAL_LABELS.items() for v in variants
]


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def exact_label(c: Column) -> Column:
    """JN-8, exact and prefix tier: first concept of the dictionary, else null."""
    return exact_compact(compact(c))


def exact_compact(short: Column) -> Column:
    """``exact_label`` of a text in its compact form."""
    concept_of = F.create_map(*[F.lit(x) for kv in _CONCEPT_OF.items() for x in kv])
    return F.try_element_at(concept_of, F.regexp_extract(short, _PREFIX, 1))


def canonical_label(c: Column) -> Column:
    """JN-8: exact or prefix tier, then the similarity tier for long unresolved texts."""
    exact, short = exact_label(c), compact(c)
    open_text = F.when(exact.isNull() & (F.length(short) >= V.LABEL_FUZZY_LENGTH), short)
    return F.coalesce(exact, fuzzy_label(open_text))


def is_section_boundary(c: Column, concept: Column) -> Column:
    """SCA-16: header pattern, or a concept that is no entity; ``concept`` from JN-8."""
    return has(c, V.SECTION_BOUNDARY) | F.coalesce(concept.isin(V.BOUNDARY_CONCEPTS), F.lit(False))


def is_field_label(c: Column, concept: Column) -> Column:
    """SCA-16: the text is nothing but a field label."""
    text = squeeze(c)
    form = label_form(text)
    exact = F.concat_ws("|", concept, form).isin(_LABEL_FORMS)
    return has(text, V.FIELD_LABEL) | F.coalesce(exact, F.lit(False))


def country_candidate(c: Column) -> Column:
    """SCA-14, first half: cleaned value in country shape, else null."""
    text = F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(V.COUNTRY_TRIM))
    head = strip(F.split(text, r"(?iU)\b(?:by|for|from)\b", 2)[0])
    low = F.lower(head)
    ok = head.rlike(V.COUNTRY_SHAPE) & ~low.isin(V.COUNTRY_INVALID)
    return F.when(ok & ~is_field_label(head, exact_label(head)), low)


def valid_country(c: Column) -> Column:
    """SCA-14: first word of the known (or nearly known) country, capitalised."""
    low = country_candidate(c)
    known = F.when(low.isin(V.COUNTRIES), low)
    near = fuzzy_country(F.when(known.isNull(), low))
    found = F.coalesce(known, near)
    return F.initcap(F.split(found, " ")[0])


__all__ = [
    "compact", "exact_label", "canonical_label", "is_section_boundary",
    "is_field_label", "country_candidate", "valid_country", "looks_like_country_label", "null_if_empty",
]
