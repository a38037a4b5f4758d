"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing is one Spark text write whose line separator is the record separator, so every
executor writes its own archive with nothing collected. Of records with equal payloads
the one with the largest page_id is a response and the others revisit it. Only payloads
that occur more than once are looked up; that list is broadcast if it is short, and
joined by a shuffle if not.

Reading trusts no magic string. Spark's text reader splits the archives at the magic
(``WARC/1.1`` and a line end), so each task meets every place that looks like a record.
It emits the candidate's offset within the task's block and the offset of its successor
by the declared lengths, followed as far as the block reaches. Sums over the blocks of
a file give offsets in the file. Pointer jumping over the few places where chains enter
a block finds those that the chain from the file's start enters; a walk inside each
block then keeps reachable records only. Magic inside a payload is never reachable: its
record spans it. Payloads cut up by such magic are put together again in a second read
of the files that hold any.

Null html is an empty payload, null urls write no target. Rows with a null page_id are
responses that nobody revisits; rows that repeat a page_id with the largest payload
owner's id are all responses. An empty table writes and reads nothing.
Texts of any length are written whole; equal payloads (ties) go by the largest page_id. A truncated last
record is left out. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
ID = "urn:x-page:"
#: Rows up to which the list of repeated payloads is broadcast (under 20 MB).
BROADCAST_ROWS = 200_000
_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_M = len(MAGIC)
CANDIDATE = "file string, size long, block long, rel long, length long, succ long, exit long, kind string, page_id long, refers_to long, payload_bytes long, payload_digest string, whole boolean"


def base32(hex_digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: 40 bits, that is 8 digits, at a time."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _HEX, _B32)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """value: the text of each page's record, without the separator that ends it."""
    spark = pages.sparkSession
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    page = page.withColumn("sha", F.sha1(F.encode("payload", "UTF-8"))).withColumn("bytes", F.octet_length("payload"))
    twice = page.where(F.col("bytes") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("owner"), F.count("*").alias("k")).where("k > 1").select("sha", "owner")
    twice = Scratch(spark, "warc").save(twice, "twice")
    owner = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    page = page.join(owner, "sha", "left")
    again = F.col("page_id") < F.col("owner")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(again, "").otherwise(F.col("payload")))
    digest = F.concat(F.lit("sha1:"), base32(F.col("sha")))
    clean = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    line = lambda name, x: F.concat(F.lit(f"{name}: "), x, F.lit("\r\n"))
    uri = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    value = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", clean), F.lit("")),
        line("WARC-Payload-Digest", digest),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", uri(F.col("owner"))))).otherwise(""),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    return page.select(value.alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    records(pages, min_bytes).write.option("lineSep", END).text(path)


def _headers(raw: bytes) -> dict[str, str] | None:
    got = {}
    for x in raw.split(b"\r\n"):
        name, colon, value = x.partition(b":")
        if not colon:
            return None
        got[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return got


def _page(uri: str | None) -> int | None:
    uri = (uri or "").strip("<>")
    return int(uri[len(ID) :]) if uri.startswith(ID) and uri[len(ID) :].lstrip("-").isdigit() else None


def parse(after_magic: bytes) -> dict | None:
    """What a candidate declares; ``stop`` is the length, after the magic, of its record with the separator."""
    head = after_magic.find(b"\r\n\r\n")
    fields = _headers(after_magic[:head]) if head >= 0 else None
    if not fields or not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
        return None
    return {"kind": fields["warc-type"], "page_id": _page(fields.get("warc-record-id")), "refers_to": _page(fields.get("warc-refers-to")), "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "body": head + 4, "stop": head + 4 + int(fields["content-length"]) + 4}


def payload_of(record: bytes, declared: dict) -> bytes:
    """The HTTP body in a whole record's block."""
    block = record[declared["body"] : declared["stop"] - 4]
    return block[block.find(b"\r\n\r\n") + 4 :] if block.startswith(b"HTTP/") else block


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of CANDIDATE for each piece between magics; offsets are relative to the block's first piece.

    Pieces of a block come in order. A piece starts a record unless it is the first of
    its file. What a block keeps is some numbers a piece, never payloads."""
    schema = pa.schema([("file", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("rel", pa.int64()), ("length", pa.int64()), ("succ", pa.int64()), ("exit", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("whole", pa.bool_())])
    key, rel, held = None, 0, []

    def closed() -> pa.RecordBatch:
        ends: dict[int, int] = {}
        for row in reversed(held):
            if row["succ"] is not None:
                row["exit"] = ends[row["rel"]] = ends.get(row["succ"], row["succ"])
        return pa.RecordBatch.from_pylist(held, schema)

    for b in batches:
        files, sizes, starts, values = (b.column(i) for i in range(4))
        for i in range(b.num_rows):
            at = files[i].as_py(), starts[i].as_py()
            if at != key:
                if held:
                    yield closed()
                key, rel, held = at, 0, []
            value = values[i].as_py()
            row = {"file": at[0], "size": sizes[i].as_py(), "block": at[1], "rel": rel, "length": len(value), "succ": None, "exit": None, "kind": None, "page_id": None, "refers_to": None, "payload_bytes": None, "payload_digest": None, "whole": False}
            if (at[1] > 0 or rel > 0) and (got := parse(value)):
                row |= {"succ": rel + got["stop"] + _M, "kind": got["kind"], "page_id": got["page_id"], "refers_to": got["refers_to"], "payload_digest": got["digest"]}
                if len(value) == got["stop"] and value.endswith(b"\r\n\r\n"):
                    payload = payload_of(value, got)
                    row |= {"whole": True, "payload_bytes": len(payload)}
                    if got["kind"] != "revisit":
                        row["payload_digest"] = _digest(payload)
            held.append(row)
            rel += len(value) + _M
    if held:
        yield closed()


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a block's candidates those on the chain from its entry."""
    succ = dict(zip(pdf["off"], pdf["succ"], strict=True))
    at, on = int(pdf["entry"].iloc[0]), set()
    while at in succ:
        on.add(at)
        at = succ[at]
    return pdf[pdf["off"].isin(on)][["file", "off"]]


def read(spark: SparkSession, path: str) -> DataFrame:
    """kind, page_id, refers_to, payload_bytes, payload_digest of each record on the chains of the archives under path.

    The digest of responses is of the bytes read, the one of revisits is the declared one."""
    sc = Scratch(spark, "warc")
    pieces = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    found = sc.save(pieces.mapInArrow(_candidates, CANDIDATE), "candidates")
    blocks = found.groupBy("file", "block").agg(F.max(F.col("rel") + F.col("length") + _M).alias("long"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sc.save(blocks.withColumn("base", F.coalesce(F.sum("long").over(before), F.lit(0))), "bases")
    # A record starts at the magic before its piece.
    placed = found.join(bases.select("file", "block", "base"), ["file", "block"])
    shift = lambda c: (F.col(c) + F.col("base") - _M).alias(c)
    placed = sc.save(placed.select("file", "size", "block", shift("rel"), "length", shift("succ"), shift("exit"), "kind", "page_id", "refers_to", "payload_bytes", "payload_digest", "whole").withColumnRenamed("rel", "off"), "placed")
    entries = _entries(sc, placed.where("succ is not null").select("file", "block", "off", F.col("exit").alias("to")))
    on = placed.where("succ is not null").select("file", "block", "off", "succ").join(entries, ["file", "block"]).groupBy("file", "block").applyInPandas(_walk, "file string, off long")
    chain = sc.save(placed.join(on, ["file", "off"], "left_semi").where("succ <= size"), "chain")
    cut = chain.where("not whole").select("file", "off", "succ")
    out = chain.where("whole").select("kind", "page_id", "refers_to", "payload_bytes", "payload_digest")
    if cut.isEmpty():
        return out
    return out.unionByName(_mend(sc, pieces, placed, bases, cut))


def _entries(sc: Scratch, nodes: DataFrame) -> DataFrame:
    """file, block, entry: where the chain from each file's start enters its blocks.

    Only places where some chain enters a block are nodes of the jumping, a few a block;
    the rounds are the logarithm of the blocks of a file."""
    landing = nodes.select("file", F.col("to").alias("off")).unionByName(nodes.where("off = 0").select("file", "off")).distinct()
    jump = sc.save(nodes.join(landing, ["file", "off"], "left_semi").select("file", "off", "to"), "jump")
    reached = sc.save(jump.where("off = 0").select("file", "off"), "reached")
    n = reached.count()
    while True:
        ahead = reached.join(jump, ["file", "off"]).select("file", F.col("to").alias("off")).join(jump.select("file", "off"), ["file", "off"], "left_semi")
        more = sc.save(reached.unionByName(ahead).distinct(), "reached")
        if (m := more.count()) == n:
            break
        further = jump.select("file", "off", F.col("to").alias("via")).join(jump.select("file", F.col("off").alias("via"), "to"), ["file", "via"])
        jump2 = sc.save(further.select("file", "off", "to").unionByName(jump.select("file", F.col("off"), "to").join(further.select("file", "off"), ["file", "off"], "left_anti")), "jump")
        sc.drop(reached)
        reached, jump, n = more, jump2, m
    return nodes.select("file", "block", "off").join(reached, ["file", "off"]).groupBy("file", "block").agg(F.min("off").alias("entry"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, rel = None, 0
    for b in batches:
        rels = []
        for f, s, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            if (f, s) != key:
                key, rel = (f, s), 0
            rels.append(rel)
            rel += len(v.as_buffer()) + _M
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rels, pa.int64()), b.column(3)], ["file", "block", "rel", "value"])


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """A record from its pieces; no row if the separator isn't where the record must end."""
    pdf = pdf.sort_values("off")
    raw = MAGIC.encode().join(pdf["value"])
    got = parse(raw)
    if got is None or raw[got["stop"] - 4 : got["stop"]] != b"\r\n\r\n":
        return pd.DataFrame({"kind": [], "page_id": [], "refers_to": [], "payload_bytes": [], "payload_digest": []})
    payload = payload_of(raw, got)
    return pd.DataFrame({"kind": [got["kind"]], "page_id": pd.array([got["page_id"]], "Int64"), "refers_to": pd.array([got["refers_to"]], "Int64"), "payload_bytes": [len(payload)], "payload_digest": [got["digest"] if got["kind"] == "revisit" else _digest(payload)]})


def _mend(sc: Scratch, pieces: DataFrame, placed: DataFrame, bases: DataFrame, cut: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: the pieces up to the next record, joined again."""
    files = cut.select("file").distinct()
    order = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    marked = placed.join(files, "file", "left_semi").join(cut.select("file", "off", F.col("off").alias("owner"), F.col("succ").alias("stop")), ["file", "off"], "left")
    last = F.last("owner", ignorenulls=True).over(order), F.last("stop", ignorenulls=True).over(order)
    inside = sc.save(marked.select("file", "off", last[0].alias("owner"), last[1].alias("stop")).where("off < stop").select("file", "off", "owner"), "inside")
    # A shuffle would lose the order of pieces: beyond the bound all files are read again.
    numbered = pieces.join(F.broadcast(files), "file", "left_semi").select(*pieces.columns) if files.count() <= BROADCAST_ROWS else pieces
    bytes_ = numbered.mapInArrow(_numbered, "file string, block long, rel long, value binary").join(bases.select("file", "block", "base"), ["file", "block"])
    bytes_ = bytes_.select("file", (F.col("rel") + F.col("base") - _M).alias("off"), "value").join(inside, ["file", "off"])
    return bytes_.groupBy("file", "owner").applyInPandas(_joined, "kind string, page_id long, refers_to long, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes archives into the shared folder, reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = Scratch(spark, "warc").path("archives")
    write(pages, path, min_bytes)
    got = Scratch(spark, "warc").save(read(spark, path), "records")
    full = got.where("kind = 'response'").select(F.col("page_id").alias("o_id"), F.col("payload_bytes").alias("o_bytes"), F.col("payload_digest").alias("o_digest")).dropDuplicates(["o_id", "o_digest"])
    again = got.where("kind = 'revisit'").join(full, (F.col("refers_to") == F.col("o_id")) & (F.col("payload_digest") == F.col("o_digest")), "left")
    rows = got.where("kind = 'response'").select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return rows.unionByName(again.select("page_id", F.col("o_bytes").alias("payload_bytes"), "payload_digest", F.col("kind").alias("record_type"), "refers_to"))
