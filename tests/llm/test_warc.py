import base64
import hashlib

import pytest

from corpusloom.llm import warc
from corpusloom.llm.scratch import Scratch

SCHEMA = "page_id long, url string, html string, kind string"
FALSE = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nrest"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    last = {}
    for i, _, html, _ in rows:
        if i is not None:
            last[html or ""] = max(last.get(html or "", i), i)
    out = []
    for i, _, html, _ in rows:
        owner = last.get(html or "")
        again = i is not None and i < owner
        out.append((i, len((html or "").encode()), digest(html), "revisit" if again else "response", owner if again else None))
    return sorted(out, key=repr)


def pages():
    rows = [(i, f"http://a.org/{i}", f"<p>{i % 7} é" + "z" * (i * 13 % 400), "k") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "", None), (102, "a\r\nb: c", "same", None), (103, "u", "same", None), (None, "u", "same", None)]
    rows += [(200, "u", FALSE, None), (201, "u", "WARC/1.1\r\n", None), (202, "u", "WARC/1.1\r\n" * 50, None), (203, "u", FALSE * 3, None), (204, "u", FALSE, None)]
    rows += [(300, "u", "line\r\n\r\nend\r\n\r\n", None), (301, "u", "y" * 300_000, None)]
    return rows


def seen(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.mark.parametrize("split", ["128m", "700"])
def test_round_trip(spark, split):
    rows = pages()
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if split == "700" else "4m")
    try:
        assert seen(warc.round_trip(spark.createDataFrame(rows, SCHEMA).coalesce(2))) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_broken_files(spark, tmp_path):
    rows = [(i, "u", f"page {i}", None) for i in range(5)]
    whole = b"".join(r.value.encode() + b"\r\n\r\n" for r in warc.records(spark.createDataFrame(rows, SCHEMA)).collect())
    (tmp_path / "cut.txt").write_bytes(whole[:-20])
    (tmp_path / "late.txt").write_bytes(b"junk" + whole)
    got = warc.read(spark, str(tmp_path))
    assert got.count() == 4  # the chain of the cut file without its last record; none from a file that starts otherwise


def test_large_table_paths(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = pages()
    assert seen(warc.round_trip(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_base32(spark):
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(50)]
    got = spark.createDataFrame([(h,) for h in hexes], "h string").select("h", warc.base32(warc.F.col("h")).alias("b")).collect()
    assert all(r.b == base64.b32encode(bytes.fromhex(r.h)).decode() for r in got)


def test_scratch_lies_in_the_shared_folder(spark):
    assert Scratch(spark, "t").root.startswith(spark.conf.get("spark.checkpoint.dir"))
