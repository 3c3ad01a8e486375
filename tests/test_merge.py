"""Merge of several images: consensus, conflict, ties."""

import pytest

from labelscan.operators import merge as M

COLS = "scan_id string, image_idx int, file_name string, field string, value string, full_text string, mean_conf double"
TEXT = "MRP Net Qty"


@pytest.fixture(scope="module")
def merged(spark):
    rows = [
        ("same", 0, "a.jpg", "mrp", "MRP Rs. 45.00", TEXT, 0.9), ("same", 1, "b.jpg", "mrp", " mrp rs. 45.00 ", TEXT, 0.7),
        ("same", 0, "a.jpg", "netQuantity", "200 g", TEXT, 0.9),
        ("higher", 0, "a.jpg", "mrp", "MRP Rs. 45.00", TEXT, 0.65), ("higher", 1, "b.jpg", "mrp", "MRP Rs. 54.00", TEXT, 0.95),
        ("tie", 0, "a.jpg", "mrp", "MRP Rs. 45.00", TEXT, 0.9), ("tie", 1, "b.jpg", "mrp", "MRP Rs. 54.00", TEXT, 0.9),
        ("stronger", 0, "a.jpg", "mrp", "45", "plain", 0.99), ("stronger", 1, "b.jpg", "mrp", "MRP Rs. 54.00", TEXT, 0.5),
        ("weak", 0, "a.jpg", "netQuantity", "200", "plain", 0.9), ("weak", 1, "b.jpg", "netQuantity", "300", "plain", 0.5),
        ("invalid", 0, "a.jpg", "mrp", "200 g", "plain", 0.9),
    ]
    fields, conflicts = M.merge_images(spark.createDataFrame(rows, COLS))
    return ({r.scan_id: r for r in fields.collect()}, {r.scan_id: r for r in conflicts.collect()})


@pytest.mark.parametrize(
    "scan,mrp,grade,conflict",
    [
        ("same", "MRP Rs. 45.00", "HIGH", False), ("higher", "MRP Rs. 54.00", "MEDIUM", True), ("tie", None, "LOW", True),
        ("stronger", "MRP Rs. 54.00", "MEDIUM", True), ("weak", None, "LOW", True), ("invalid", None, "LOW", False),
    ],
)
def test_merge(merged, scan, mrp, grade, conflict):
    fields, conflicts = merged
    assert (fields[scan].mrp, fields[scan].extraction_confidence, scan in conflicts) == (mrp, grade, conflict)


def test_reasons(merged):
    conflicts = merged[1]
    assert conflicts["higher"].resolution_reason == (
        "Selected value 'MRP Rs. 54.00' from image 'b.jpg' due to higher OCR confidence (0.950 vs 0.650)."
    )
    assert "stronger statutory evidence (strength=3 vs 1" in conflicts["stronger"].resolution_reason
    assert [c.value for c in conflicts["tie"].competing_values] == ["MRP Rs. 45.00", "MRP Rs. 54.00"]
