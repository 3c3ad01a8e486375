"""Jobs over images without blocks, and with a flat text only."""

import pytest

from labelscan.operators import jobs as J

COLS = "scan_id string, image_idx int, block_idx int, text string, confidence double, x_min int, y_min int, x_max int, y_max int"
TEXT = "MRP Rs. 45.00\nNet Quantity: 500 g\nManufactured by: Acme Foods Pvt Ltd\nBatch No: LK-901"


@pytest.fixture(scope="module")
def inputs(spark):
    blocks = spark.createDataFrame([("full", 0, 0, "MRP Rs. 99.00", 0.9, 10, 0, 300, 20), ("faint", 0, 0, "zzz", 0.01, 10, 0, 300, 20)], COLS)
    images = spark.createDataFrame([("full", 0, "MRP Rs. 11.00"), ("none", 0, None), ("text", 0, TEXT), ("faint", 0, TEXT)], "scan_id string, image_idx int, full_text string")
    return blocks, images


@pytest.mark.parametrize("job", [lambda b, i: J.scan_single_images(b, images=i), lambda b, i: J.scan_image_sets(b, images=i)[0]], ids=["job_1", "job_2"])
def test_every_image_has_a_scan(inputs, job):
    found = {r.scan_id.split("/")[0]: r for r in job(*inputs).collect()}
    assert set(found) == {"full", "none", "text", "faint"}
    assert "99" in found["full"].mrp
    assert found["none"].mrp is None and found["none"].compliance_status == "NON_COMPLIANT"
    for name in ("text", "faint"):
        # a price is read from blocks only, as in the reference
        assert "500" in found[name].net_quantity
        assert "Acme Foods" in found[name].manufacturer and found[name].batch_number == "LK-901"


@pytest.mark.parametrize("job", [J.scan_single_images, J.scan_image_sets], ids=["job_1", "job_2"])
def test_blocks_are_worked_out_once(inputs, job, monkeypatch):
    """the branches of a job read written blocks and not what the blocks are made from."""
    seen = []

    def extract(blocks, *more):
        seen.extend(blocks.inputFiles())
        raise StopIteration

    monkeypatch.setattr(J.X, "extract_fields", extract)
    with pytest.raises(StopIteration):
        job(inputs[0])
    assert seen and all("/stage-" in f for f in seen)
