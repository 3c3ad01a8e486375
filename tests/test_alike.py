"""Images of the same content are read once, and every image has its row."""

from labelscan.operators import extract as X

COLS = "scan_id string, image_idx int, block_idx int, text string, confidence double, x_min int, y_min int, x_max int, y_max int"


def _image(scan, image, conf=0.9, name="Gold Bolt", left=10):
    lines = [name, "MRP Rs. 45.00", "Net Quantity: 500 g", "Mfg by Acme Foods Pvt Ltd"]
    return [(scan, image, i, t, conf, left, 30 * i, 300, 30 * i + 20) for i, t in enumerate(lines)]


def test_alike(spark):
    """Confidences may differ between the limits; texts, boxes and what lacks may not."""
    rows = _image("a", 0) + _image("a", 1, 0.5) + _image("a", 2, 0.05) + _image("b", 0, left=11) + _image("b", 1, name="Gold Nut")
    rows += [("c", 0, 0, "x", 0.9, None, 5, 5, 5), ("c", 1, 0, "x", 0.9, 5, None, 5, 5), ("c", 2, 0, "x", 0.9, 5, None, 5, 5)]
    rows += [("d", 0, 0, "x", 0.9, 1, 1, 2, 2), ("d", 1, 0, "x", 0.9, 1, 1, 2, 2), ("d", 1, 0, "x", 0.9, 1, 1, 2, 2)]
    got = {(r.scan_id, r.image_idx): tuple(r.same) for r in X.alike(X.prepare(spark.createDataFrame(rows, COLS), None)).collect()}
    assert len(got) == 10
    assert [k for k, same in sorted(got.items()) if same != k] == [("a", 1), ("c", 2)]
    assert got["a", 1] == ("a", 0) and got["c", 2] == ("c", 1)


def test_given_texts_tell_images_apart(spark):
    blocks = spark.createDataFrame(_image("a", 0) + _image("b", 0), COLS)
    images = spark.createDataFrame([("n", 0, None), ("n", 1, None), ("t", 0, "x"), ("t", 1, "x"), ("t", 2, ""), ("b", 0, "y")], "scan_id string, image_idx int, full_text string")
    got = {(r.scan_id, r.image_idx): tuple(r.same) for r in X.alike(X.prepare(blocks, None), images).collect()}
    assert got == {("a", 0): ("a", 0), ("b", 0): ("b", 0), ("n", 0): ("n", 0), ("n", 1): ("n", 0), ("t", 0): ("t", 0), ("t", 1): ("t", 0), ("t", 2): ("t", 2)}


def test_same_images_are_read_once(spark, monkeypatch):
    """F1 to F5: thirty images of one content are one image to read; an unlabelled name still asks for each one's confidence."""
    read = []
    real = X.read_images

    def counted(raw, *more):
        read.append(raw.select("scan_id", "image_idx").distinct().count())
        return real(raw, *more)

    monkeypatch.setattr(X, "read_images", counted)
    rows = [b for i in range(30) for b in _image("s", i, 0.9 if i % 2 else 0.5)]
    found = X.extract_fields(spark.createDataFrame(rows, COLS)).collect()
    assert read == [1] and len(found) == 30
    for r in found:
        assert "45" in r.mrp and "500" in r.netQuantity and "Acme Foods" in r.manufacturerName
        assert r.productName == ("Gold Bolt" if r.image_idx % 2 else None)
        assert r.full_text.startswith("Gold Bolt MRP") and abs(r.mean_conf - (0.9 if r.image_idx % 2 else 0.5)) < 1e-9
