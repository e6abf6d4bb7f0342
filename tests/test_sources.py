"""Readers: archives by day, worksheets by encoding, ground truth of both forms, keyword maps and reports."""

import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from augury.sources import archives, io


def line(day, url, n=61):
    c = [""] * n
    c[1] = day
    if n > 60:
        c[60] = url
    return "\t".join(c)


@pytest.fixture
def exports(spark, tmp_path):
    zipped, plain = tmp_path / "zipped", tmp_path / "plain"
    zipped.mkdir()
    plain.mkdir()
    for i, day in enumerate(("20210301", "20210302", "20210303")):
        text = "\n".join([line(day, f"https://x/{i}-{j}é") for j in range(25)] + ["", line(day, "", 60), line("nonsense", "https://x/odd")]) + "\n"
        (plain / f"{day}.csv").write_text(text, encoding="utf-8")
        with zipfile.ZipFile(zipped / f"{day}000000.export.CSV.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("export.csv", text.encode() + (b"\xff broken\n" if i == 0 else b""))
    return zipped, plain


def test_archives_hold_the_rows_of_the_unpacked_files(spark, exports):
    zipped, plain = exports
    archives.exports(spark, str(zipped))
    got = spark.read.format("zipped_exports").option("batch", 7).load(str(zipped))
    assert got.count() == 78
    assert {(r["day"], r["url"]) for r in got.collect()} >= {(date(2021, 3, 2), "https://x/1-3é"), (None, "https://x/odd")}
    assert sorted(map(str, io.export_rows(spark, str(plain)).collect())) == sorted(map(str, got.select("day", "url").collect()))


def test_archives_of_other_days_are_never_opened(spark, exports):
    zipped, _ = exports
    broken = zipped / "20210301000000.export.CSV.zip"
    data = bytearray(broken.read_bytes())
    data[60:70] = b"\xff" * 10  # its directory is whole, its rows are not, so that reading it fails
    broken.write_bytes(data)
    (zipped / "20210304000000.export.CSV.zip").write_bytes(b"not a zip file")
    (zipped / "readme.txt").write_text("x")
    read = lambda *days: archives.exports(spark, str(zipped), *days)
    assert read(date(2021, 3, 2)).count() == 52 and read(date(2021, 3, 2), date(2021, 3, 2)).where("day = date'2021-03-02'").count() == 25
    assert read(date(2021, 3, 4)).count() == 0 and read(date(2030, 1, 1)).count() == 0
    frame = read(date(2021, 3, 2), date(2021, 3, 3))
    assert (frame.where("day = date'2021-03-02'").count(), frame.count()) == (25, 52)  # a filter leaves the frame whole
    with pytest.raises(Exception, match="(?i)crc|decompress|invalid"):
        read(None, date(2021, 3, 2)).collect()


@pytest.mark.parametrize(("encoding", "found"), [("utf-8-sig", "utf-8-sig"), ("utf-8", "utf-8-sig"), ("gb18030", "gb18030"), ("gbk", "gb18030"), ("ascii", "utf-8-sig")])
def test_worksheets_are_decoded_strictly_in_order(spark, tmp_path, encoding, found):
    word = "plain" if encoding == "ascii" else "红海危机"
    (tmp_path / "sheet.csv").write_bytes(f'signal_id,human_label,note\r\ns1,1,"two\r\nlines, {word}"\r\ns2,,\r\n'.encode(encoding))
    got = [tuple(r) for r in io.worksheets(spark, str(tmp_path), ["signal_id", "human_label", "note", "absent"]).orderBy("row").collect()]
    assert got == [("sheet.csv", found, 0, "s1", "1", f"two\r\nlines, {word}", None), ("sheet.csv", found, 1, "s2", "", "", None)]


def test_a_worksheet_in_no_known_encoding_fails(spark, tmp_path):
    (tmp_path / "sheet.csv").write_bytes(b"a\n\xff\xff\xff\n")
    with pytest.raises(Exception, match="no encoding"):
        io.worksheets(spark, str(tmp_path), ["a"]).collect()


def test_ground_truth_of_both_forms(spark, tmp_path):
    events = [{"event_id": "a", "onset": "2021-01-01"}, {"event_id": "b", "onset": None}]
    (tmp_path / "object.json").write_text(json.dumps({"note": "x", "events": events}))
    (tmp_path / "list.json").write_text(json.dumps(events))
    for name in ("object.json", "list.json"):
        assert {(r["event_id"], r["onset"]) for r in io.ground_truth(spark, str(tmp_path / name)).collect()} == {("a", "2021-01-01"), ("b", None)}


def test_keyword_map(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"_meta": "a note", "_more": {"url_keywords": ["x"]}, "one": {"url_keywords": ["Red-Sea", "", "suez"], "rationale": "红海"}, "two": {"url_keywords": []}, "three": {}}))
    got = {r["event"]: (r["keywords"], r["rationale"]) for r in io.keyword_map(spark, str(tmp_path / "k.json")).collect()}
    assert got == {"one": (["red-sea", "suez"], "红海"), "two": ([], None), "three": ([], None)}


def test_report_metrics(spark, tmp_path):
    (tmp_path / "a_metrics.json").write_text(json.dumps({"fwgs": {"fwgs": 0.5, "n_signals": 4}}))
    (tmp_path / "b_metrics.json").write_text(json.dumps({"fwgs": {"fwgs": None}}))
    (tmp_path / "c_metrics.json").write_text("{broken")
    got = {r["file"]: (r["readable"], r["fwgs"], r["n"]) for r in io.report_metrics(spark, str(tmp_path / "*_metrics.json"), {"fwgs": "$.fwgs.fwgs", "n": "$.fwgs.n_signals"}).collect()}
    assert got == {"a_metrics.json": (True, 0.5, 4.0), "b_metrics.json": (True, None, None), "c_metrics.json": (False, None, None)}
