"""File sources and sinks, text repairs and similarity."""

import difflib
import json

import pytest
from pyspark.sql import functions as F

from labelscan.functions import text as T
from labelscan.functions.similarity import similarity
from labelscan.sources import images as SI
from labelscan.sources import scans as SC


def test_image_files(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8\xff\xe0 data")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n data")
    (tmp_path / "c.jpg").write_bytes(b"BM bitmap")
    (tmp_path / "e.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * (10 * 1024 * 1024))
    (tmp_path / "f.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * (10 * 1024 * 1024 - 8))
    got = {r.file_name: (r.accepted, r.reason) for r in SI.read_images(spark, str(tmp_path)).drop("content").collect()}
    assert got == {
        "a.jpg": (True, None), "b.png": (True, None), "c.jpg": (False, "invalid_image"),
        "e.png": (False, "file_too_large"), "f.png": (True, None),
    }


def test_empty_upload(spark):
    # the file source lists no empty files, so an empty upload is checked as a row
    row = SI.check_images(spark.createDataFrame([(bytearray(),)], "content binary")).first()
    assert (row.accepted, row.reason, row.detail) == (False, "invalid_image", "Uploaded file is empty.")


def test_image_groups(spark):
    rows = [("ok", True)] * 4 + [("many", True)] * 5 + [("bad", True), ("bad", False)]
    kept = SI.check_groups(spark.createDataFrame(rows, "scan_id string, accepted boolean"))
    assert {r.scan_id for r in kept.collect()} == {"ok"}


def test_ocr_lines(spark):
    lines = [{"box": [[0.0, 0.0], [9.0, 0.0], [9.0, 5.0], [0.0, 5.0]], "text": " MRP ", "confidence": "0.9"}, {"box": [[0.0, 0.0]], "text": "x", "confidence": "0.9"},
             {"box": [[0.0, 0.0], [9.0, 0.0], [9.0, 5.0], [0.0, 5.0]], "text": " ", "confidence": "0.9"}, {"box": [[0.0, 0.0], [9.0, 0.0], [9.0, 5.0], [0.0, 5.0]], "text": "y", "confidence": "high"}]
    df = spark.createDataFrame([("s", 0, lines)], f"scan_id string, image_idx int, lines {SI.RAW_LINES}")
    done = SI.normalise_ocr(df)
    assert done.first().full_text == "MRP" and done.first().success
    block = SI.to_blocks(done).first()
    assert (block.block_idx, block.x_min, block.x_max, block.y_max, block.slope) == (0, 0, 9, 5, 0.0)


def test_labelled_sample(spark, tmp_path):
    path = tmp_path / "sample.csv"
    path.write_text('﻿"product_id","image_id","violation"\n"P1","1","NONE"\n"P2","2","A; B"\n', encoding="utf-8")
    rows = SI.sample_violations(SI.read_sample(spark, str(path))).collect()
    assert sorted((r.product_id, r.violation or "") for r in rows) == [("P1", ""), ("P2", "A"), ("P2", "B")]


def test_payload_files(spark, tmp_path):
    lines = [{"productId": "A", "mrp": "Rs. 5", "other": 1}, {"mrp": "no id"},
             {"productId": "B", "fieldEvidence": {"mrp": {"field": "mrp", "source": "GUESS", "confidence": 0.5}}}]
    (tmp_path / "p.json").write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    good, bad = SC.split_payloads(SC.read_payloads(spark, str(tmp_path)))
    assert [r.product_id for r in good.collect()] == ["A"]
    kinds = sorted(e.type for r in bad.collect() for e in r.errors)
    assert kinds == ["enum", "json_invalid", "missing"]


def test_scan_table(spark, tmp_path):
    path = str(tmp_path / "scans")
    incoming = spark.createDataFrame(
        [("s1", "u1", "2026-01-05T10:00:00Z"), (None, "u1", "bad"), ("s3", "", None)], "scan_id string, user_id string, timestamp string"
    )
    accepted, rejected = SC.prepare_scans(incoming, now="2026-02-01 00:00:00")
    SC.append_scans(accepted, path)
    SC.append_scans(SC.only_new(accepted.filter("scan_id = 's1'"), SC.read_scans(spark, path)), path)
    stored = SC.read_scans(spark, path)
    assert stored.count() == 2 and rejected.count() == 1
    assert {str(r.scan_date) for r in stored.collect()} == {"2026-01-05", "2026-02-01"}
    none = spark.createDataFrame([], "user_id string")
    filled = SC.backfill_user(stored.drop("user_id"), none)
    assert {r.user_id for r in filled.collect()} == {SC.LEGACY_USER}


@pytest.mark.parametrize(
    "fn,raw,want",
    [
        (T.repair_digits, "O5 2|3 1O2 I", "O5 213 102 I"), (T.repair_contact, "care @ abc com", "care@abc.com"),
        (T.repair_contact, "mail care at abc . in", "mail care@abc.in"), (T.strip, "  x\n", "x"),
        (T.month_number, "Sept", "09"), (T.month_number, "x", None), (T.clean_batch, "B12345/Mfg Date", "B12345"),
        (T.cut_at_boundary, "Acme Traders Net Wt 5 g", "Acme Traders"), (T.company_name, "Acme Pvt. Ltd. Delhi", "Acme Pvt. Ltd."),
    ],
)
def test_text_functions(spark, fn, raw, want):
    assert spark.createDataFrame([(raw,)], "c string").select(fn(F.col("c"))).first()[0] == want


def test_similarity_against_brute_force(spark):
    pairs = [("germony", "germany"), ("a", ""), ("manufacturcd", "manufactured"), ("abc", None)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity("a", "b").alias("r")).collect()
    for r in rows:
        want = None if r.b is None else difflib.SequenceMatcher(None, r.a, r.b).ratio()
        assert r.r == want
