"""One field's matches, found without the others."""

import pytest
from pyspark.sql import functions as F

from labelscan.operators import extract as X
from labelscan.session import staged
from tests.test_extract import COLS, LABELS


@pytest.fixture(scope="module")
def kept(spark):
    return staged(X.prepare(spark.createDataFrame([b for i in LABELS for b in i], COLS)))


@pytest.fixture(scope="module")
def whole(kept):
    return staged(X.winning_matches(staged(X.tag(kept))).select("scan_id", "field", "value")).collect()


ALONE = [["mrp"], ["netQuantity"], ["made"], ["expiry"], ["importerName"], ["phone", "email", "website"], ["countryOfOrigin"], ["batchNumber"]]


@pytest.mark.parametrize("fields", ALONE, ids=lambda f: f[0])
def test_a_field_alone_is_the_field_of_the_whole(kept, whole, fields):
    """The matches of the named fields only, and blocks need tags for some fields only."""
    blocks = X.tag(kept) if set(fields) & set(X.NEEDS_TAGS) else kept
    got = X.winning_matches(blocks, fields=fields).select("scan_id", "field", "value").collect()
    want = [r for r in whole if r.field in fields]
    assert want and sorted(got, key=str) == sorted(want, key=str)


def test_values_are_listed_for_sought_fields_only(kept):
    """Nearly every text could be an importer; it is no value where no label looks for one."""
    tagged = X.tag(kept.filter("scan_id IN ('beside', 'importer', 'question')"))
    _, values, sought = X._sides(tagged)
    assert sought == ["mrp"] and {r.field for r in values.select("field").distinct().collect()} == {"mrp"}
    assert X._sides(tagged.filter("scan_id = 'importer'")) is None
    assert X.importer_next(tagged).count() == 0


def test_values_of_a_text_are_one_row(kept):
    texts = X.tag(kept).select("t", "concept", "header_word", "country").distinct()
    rows = X.value_lists(texts, ["mrp", "importer", "fragment"])
    assert rows.count() == rows.select("t").distinct().count() and rows.filter(F.size("ss") > 1).count() > 0


def test_lower_tiers_see_open_images_only(kept, monkeypatch):
    """Maker lines are read where no section names a company; sections of one text are read once."""
    from labelscan.operators import maker as MK

    seen, read = [], []
    lines, names = MK.labelled_lines, MK._names_of_sections
    monkeypatch.setattr(MK, "labelled_lines", lambda rows: (seen.append(rows), lines(rows))[1])
    monkeypatch.setattr(MK, "_names_of_sections", lambda rows: (read.append(rows), names(rows))[1])
    few = kept.filter("scan_id IN ('full', 'beside')")
    twice = staged(X.tag(few.unionByName(few.withColumn("image_idx", F.lit(1)))))
    got = {(r.scan_id, r.image_idx): r.manufacturerName for r in MK.extract_maker(twice, twice).collect()}
    assert got["full", 0] == got["full", 1] == "ABC Foods Pvt Ltd"
    assert {r.scan_id for r in seen[0].select("scan_id").distinct().collect()} == {"beside"}
    assert read[0].count() == 1
