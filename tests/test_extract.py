"""Extraction on hand-made labels."""

import pytest

from labelscan.operators import extract as X

COLS = "scan_id string, image_idx int, block_idx int, text string, confidence double, x_min int, y_min int, x_max int, y_max int"


def image(name, *lines):
    """Blocks of one image: text, or (text, confidence), or (text, conf, x, y, x2, y2)."""
    out = []
    for i, line in enumerate(lines):
        if isinstance(line, str):
            line = (line,)
        text, conf = line[0], line[1] if len(line) > 1 else 0.9
        box = line[2:] if len(line) > 2 else (10, 40 * i, 300, 40 * i + 20)
        out.append((name, 0, i, text, conf, *box))
    return out


LABELS = [
    image("full", "Golden Wheat Biscuits", "MRP Rs. 45.00 (incl. of all taxes)", "Net Qty: 200 g", "Manufactured by: ABC Foods Pvt Ltd",
          "Plot 12, Industrial Area, Noida - 201301", "Mfg Date: 01/2026", "Best Before 07/2026", "Batch No: B1234",
          "Customer Care: 1800-123-4567, care@abc.com"),
    image("quantity", "MRP", "250ml"),
    image("glued", "MRP 175.0007/25"),
    image("beside", ("MRP", 0.9, 10, 0, 60, 20), ("Rs. 99.50", 0.9, 80, 2, 160, 20)),
    image("faint", ("MRP", 0.9, 10, 0, 60, 20), ("Rs. 99.50", 0.2, 80, 2, 160, 20)),
    image("hindi", "MRP Rs. १२५.००", "Net Wt: ५०० g"),
    image("promo", "100 g + 20 g free = 120 g"),
    image("count", ("Number of Units", 0.9, 10, 0, 100, 20), ("12 N", 0.9, 120, 0, 160, 20)),
    image("month", "Pkd: Sept 2025"),
    image("expiry", "Use Before: 12/27"),
    image("batch", ("Batch No", 0.9, 10, 0, 90, 20), ("See below", 0.9, 120, 0, 200, 20), ("LK-901", 0.9, 10, 40, 90, 60)),
    image("usp", "Unit Sale Price: Rs. 0.50/g"),
    image("origin", "Country of Origin: Germany"),
    image("origin_typo", "Country of Origin: Germony"),
    image("split_origin", ("Product", 0.9, 10, 0, 60, 20), ("of India", 0.9, 70, 0, 130, 20)),
    image("importer", "Imported by: Global Trade Pvt Ltd, Mumbai"),
    image("importer_next", "Importer:", "Acme Traders Pvt Ltd"),
    image("licence", "FSSAI Lic No 12345678901234"),
    image("name", "Generic Name: Green Tea"),
    image("question", "What is inside?", "MRP Rs. 10"),
    image("continued", "Marketed by: Sunrise", "Consumer Products Pvt Ltd", "Sector 5, New Delhi - 110001"),
    image("damaged", "Manufacturcd by Acme Foods Pvt Ltd"),
    image("allergen", "Manufactured in a facility that processes nuts Foods Pvt Ltd"),
    image("noise", ("MRP Rs. 77.00", 0.05)),
    image("unsure", ("MRP", 0.9, 10, 0, 60, 20), ("Rs. 99.50", None, 80, 2, 160, 20)),
    # a company without a label of its own, and the address behind it
    image("behind", "in Bengal by", "Acme Foods Pvt Ltd", "Plot 4", "under licence 7", "Sector 9", "Art. 55", "Net Qty: 5 g", "Sector 11"),
    image("behind_mark", "in Bengal by", "Acme Foods Pvt Ltd", "Plot 4", "in Bihar by hand", "Sector 9", "TM Owner: Acme", "Sector 11"),
    image("far", "in Bengal by", ("Acme Foods Pvt Ltd", 0.9, 10, 200, 300, 220), ("Plot 4", 0.9, 10, 230, 300, 250)),
    image("own_address", "in Bengal by", "Acme Foods Pvt Ltd Plot 4, Sector 63, Noida - 201301", "Sector 9"),
    # a company of one word grows by its neighbours, nearest first
    image("one_word", ("Golden Wheat", 0.9, 10, 0, 120, 20), ("Foods", 0.9, 10, 25, 70, 45), ("ofce", 0.9, 10, 70, 50, 90), ("Plot 4", 0.9, 10, 100, 90, 120)),
    image("one_word_far", ("Foods", 0.9, 10, 0, 70, 20), ("Phone 12", 0.9, 10, 25, 90, 45), ("ofce", 0.9, 10, 60, 50, 80), ("Golden", 0.9, 10, 300, 80, 320)),
    image("two_steps", ("Foods", 0.9, 10, 0, 70, 20), ("Phone 12", 0.9, 10, 25, 90, 45), ("Sunrise", 0.9, 10, 50, 90, 70), ("ofce", 0.9, 10, 72, 50, 92)),
    image("allergen_near", ("Golden", 0.9, 10, 60, 90, 80), ("may contain nuts", 0.9, 10, 22, 90, 40), ("Foods", 0.9, 10, 0, 70, 20), ("ofce", 0.9, 400, 30, 450, 50)),
]
EXPECTED = {
    "full": {
        "mrp": "MRP Rs. 45.00 (inclusive of all taxes)", "netQuantity": "200 g", "manufacturerName": "ABC Foods Pvt Ltd",
        "manufacturerAddress": "Plot 12, Industrial Area, Noida - 201301", "monthOfPacking": "01", "yearOfPacking": "2026",
        "expiryMonth": "07", "expiryYear": "2026", "batchNumber": "B1234", "consumerCare": "1800-123-4567, care@abc.com",
        "productName": "Golden Wheat Biscuits", "extraction_confidence": "HIGH",
    },
    "quantity": {"mrp": None, "extraction_confidence": "LOW"},
    "glued": {"mrp": "MRP Rs. 175.00"}, "beside": {"mrp": "MRP Rs. 99.50"}, "faint": {"mrp": None},
    "hindi": {"mrp": "MRP Rs. 125.00", "netQuantity": "500 g"}, "promo": {"netQuantity": "120 g"},
    "count": {"netQuantity": "12N"}, "month": {"monthOfPacking": "09", "yearOfPacking": "2025"},
    "expiry": {"expiryMonth": "12", "expiryYear": "2027", "monthOfPacking": None}, "batch": {"batchNumber": "LK-901"},
    "usp": {"unitSalePrice": "Rs. 0.50/g"}, "origin": {"countryOfOrigin": "Germany"}, "origin_typo": {"countryOfOrigin": "Germany"},
    "split_origin": {"countryOfOrigin": "India"}, "importer": {"importerName": "Global Trade Pvt Ltd"},
    "importer_next": {"importerName": "Acme Traders Pvt Ltd"}, "licence": {"consumerCare": None},
    "name": {"productName": "Green Tea"}, "question": {"productName": None},
    "continued": {"manufacturerName": "Sunrise Consumer Products Pvt Ltd", "manufacturerAddress": "Sector 5, New Delhi - 110001"},
    "damaged": {"manufacturerName": "Acme Foods Pvt Ltd"}, "allergen": {"manufacturerName": None}, "unsure": {"mrp": None},
    "behind": {"manufacturerName": "Acme Foods Pvt Ltd", "manufacturerAddress": "Plot 4 under licence 7 Sector 9"},
    "behind_mark": {"manufacturerName": "Acme Foods Pvt Ltd", "manufacturerAddress": "Plot 4 Sector 9"},
    "far": {"manufacturerName": None, "manufacturerAddress": None},
    "own_address": {"manufacturerName": "Acme Foods Pvt Ltd", "manufacturerAddress": "Plot 4, Sector 63, Noida - 201301"},
    "one_word": {"manufacturerName": "Golden Wheat Foods", "manufacturerAddress": "Plot 4"},
    "one_word_far": {"manufacturerName": "ofce Phone 12 Foods", "manufacturerAddress": None},
    "two_steps": {"manufacturerName": "Sunrise Phone 12 Foods"},
    "allergen_near": {"manufacturerName": "ofce Foods"},
}


@pytest.fixture(scope="module")
def found(spark):
    blocks = spark.createDataFrame([b for label in LABELS for b in label], COLS)
    return {r.scan_id: r.asDict() for r in X.extract_fields(blocks).collect()}


@pytest.mark.parametrize("label", list(EXPECTED))
def test_label(found, label):
    got = found[label]
    assert {k: got[k] for k in EXPECTED[label]} == EXPECTED[label]


def test_faint_blocks_are_left_out(found):
    # an image without a usable block keeps its row
    assert found["noise"]["extraction_confidence"] == "LOW" and found["noise"]["mrp"] is None


def test_address_behind_a_company_keeps_to_its_slant(spark):
    """Lines as level as the last accepted one; a steep block between them is left out."""
    from labelscan.operators.maker import anchored_companies

    lines = [("in Bengal by", 0.0), ("Acme Foods Pvt Ltd", 0.2), ("Plot 4", 0.23), ("Village", 9.0), ("Sector 9", 0.26), ("Phase 2", 0.05), ("Lane 3", 0.2)]
    rows = [("s", 0, i, t, 10, 30 * i, 200, 30 * i + 20, sl, None) for i, (t, sl) in enumerate(lines)]
    tagged = spark.createDataFrame(rows, "scan_id string, image_idx int, block_idx int, t string, x_min int, y_min int, x_max int, y_max int, slope double, concept string")
    # 0.05 is level; 0.2 after it is neither level nor as slanted
    assert [tuple(r) for r in anchored_companies(tagged).collect()] == [("s", 0, "Acme Foods Pvt Ltd", "Plot 4 Sector 9 Phase 2")]


def marks(blocks, boundary):
    """Places at the height of a row with a boundary, straight from the rules; blocks are (top, bottom, left, text)."""
    rows = []
    for i, (top, bottom, _, _) in enumerate(blocks):
        for row in rows:
            tops, ends = [blocks[k][0] for k in row], [blocks[k][1] for k in row]
            height = sum(e - t for t, e in zip(tops, ends, strict=True)) / len(row)
            centre = sum((t + e) / 2 for t, e in zip(tops, ends, strict=True)) / len(row)
            shared = max(0, min(bottom, max(ends)) - max(top, min(tops)))
            if shared / min(max(bottom - top, 1), height) >= 0.45 and abs((top + bottom) / 2 - centre) <= 0.75 * height:
                row.append(i)
                break
        else:
            rows.append([i])
    out = set()
    for row in rows:
        text = " ".join(blocks[k][3] for k in sorted(row, key=lambda k: blocks[k][2]))
        if any(boundary(x) for x in [text, *(blocks[k][3] for k in row)]):
            top, bottom = min(blocks[k][0] for k in row), max(blocks[k][1] for k in row)
            for i, (t, b, _, _) in enumerate(blocks):
                if min(bottom, b) > max(top, t) or abs((t + b) / 2 - (top + bottom) / 2) <= 0.75 * max(bottom - top, 1):
                    out.add(i)
    return out


def test_boundary_rows_follow_running_rows_and_bands(spark):
    import random

    from pyspark.sql import functions as F

    from labelscan.functions import labels as L
    from labelscan.operators import maker as MK
    from labelscan.operators.rows import visual_rows_by_gap
    from labelscan.operators.spatial import reading_order

    r = random.Random(11)
    images, rows = {}, []
    for k in range(60):
        scale = r.choice([1, 1, 40])  # some images are taller than a stripe
        blocks = []
        for i in range(r.randint(1, 14)):
            top = r.randint(0, 150)
            blocks.append((top * scale, (top + r.randint(10, 30)) * scale, r.randrange(0, 10_000) , r.choice(["Plot", "Road", "Area", "Mocel", "Number", "MRP 10", "Couniyo"])))
        blocks.sort(key=lambda b: (b[0], b[2]))
        images[f"i{k}"] = blocks
        rows += [(f"i{k}", 0, i, t, x, a, x + 50, b) for i, (a, b, x, t) in enumerate(blocks)]
    frame = spark.createDataFrame(rows, "scan_id string, image_idx int, block_idx int, t string, x_min int, y_min int, x_max int, y_max int")
    frame = reading_order(frame).withColumn("bnd_self", L.is_section_boundary(F.col("t"), L.canonical_label(F.col("t"))))
    got = {}
    for x in MK._row_boundaries(frame).filter("row_bnd").collect():
        got.setdefault(x.scan_id, set()).add(x.block_idx)
    boundary = lambda x: x in known
    asked = set()
    for v in images.values():
        marks(v, lambda x: bool(asked.add(x)))
    known = {x.x for x in spark.createDataFrame([(x,) for x in asked], "x string").filter(L.is_section_boundary(F.col("x"), L.canonical_label(F.col("x")))).collect()}
    assert got == {k: m for k, v in images.items() if (m := marks(v, boundary))}
    # the images are such that rows by gaps alone would differ
    by_gap = {(x.scan_id, x.block_idx): x.row_id for x in visual_rows_by_gap(frame).collect()}
    exact = {(x.scan_id, x.block_idx): x.row_id for x in MK.rows_of_images(frame, ["block_idx"]).collect()}
    assert by_gap != exact
