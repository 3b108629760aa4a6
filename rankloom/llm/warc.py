"""WARC archives: written with revisits for equal payloads, read back by boundary chains.

Writing: a response record holds an HTTP head and the payload; of equal payloads of at least LEAST_REVISIT
bytes only the record of the smallest page_id holds it, the others are revisits that name it. A file ends before
the record that would take it beyond its bytes, so only a record that is larger by itself makes a larger file.

Reading: each file is scanned for the record magic. Every place that looks like a record gives a link to
its successor (its end by its own Content-Length); within a block the links are followed on the spot, so
each candidate knows where its chain leaves the block. Pointer jumping over blocks from offset 0 finds the
blocks' true entries, and only records on the chain from an entry are kept: magic inside payloads is not.

Defined cases: null html is an empty payload; null url is an empty one; rows of a null page_id are
responses; repeated rows give a record each, all of the smallest page_id being responses; an empty table
gives no records; other columns are ignored; a file whose chain does not end at its last byte raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"WARC/1.0\r\n"
LEAST_REVISIT = 100
FILE_BYTES = 16 << 20
BLOCK = 1 << 20
#: Rows of the table of repeated payloads up to which it is broadcast (about 60 bytes a row).
BROADCAST_ROWS = 50_000


def _in_files(file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record, n in zip(batch.column(0), pc.binary_length(batch.column(0)).to_pylist()):
                if held and size + n + 2 > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(["\r\n".join(held)])], names=["value"])
                    held, size = [], 0
                held.append(record.as_py())
                size += n + 2
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(["\r\n".join(held)])], names=["value"])

    return run


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Writes a record for each row of pages (page_id, url, html) to text files of whole records below path."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "%0A").alias("url"), html.alias("html")).withColumns({"n": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    firsts = rows.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    firsts = common.written(firsts.select(F.col("digest").alias("_digest"), "first"), "firsts")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    marked = rows.join(firsts, (F.col("digest") == F.col("_digest")) & (F.col("n") >= LEAST_REVISIT), "left")
    revisit = F.coalesce(F.col("first") != F.col("page_id"), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat("http", F.when(revisit, "").otherwise(F.col("html")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">\r\n"))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name("page_id"),
        F.lit(f"WARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("first"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("n"))).cast("string"), F.lit("\r\n\r\n"),
    )
    records = marked.withColumn("http", http).select(F.concat(head, block, F.lit("\r\n")).alias("value"))
    # A row holds the records of a file.
    records.mapInArrow(_in_files(file_bytes), "value string").write.option("lineSep", "\r\n").option("maxRecordsPerFile", 1).text(path)


def head_of(content: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """Header fields, start of the block and offset of the successor, if what stands at `at` is framed as a record."""
    end = content.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = {}
    for line in content[at + len(MAGIC) : end].decode("utf-8", "replace").split("\r\n"):
        key, colon, value = line.partition(":")
        if not colon:
            return None
        fields[key.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    after = end + 4 + int(length)
    return (fields, end + 4, after + 4) if content[after : after + 4] == b"\r\n\r\n" else None


def candidates(content: bytes, block: int = BLOCK) -> list[tuple[int, int, int, dict[str, str], int]]:
    """(offset, successor, exit, fields, start of block) of whatever is framed as a record; exit: where its chain leaves its block.

    A record stands at 0 or after the blank line of the one before, so no two headers overlap, and together they are
    searched once however long they are.
    """
    found, at = [], 0 if content.startswith(MAGIC) else content.find(b"\r\n\r\n" + MAGIC) + 4
    while at != 3:
        if head := head_of(content, at):
            found.append((at, head[2], head[0], head[1]))
        at = content.find(b"\r\n\r\n" + MAGIC, at) + 4
    exits: dict[int, int] = {}
    for at, succ, _, _ in reversed(found):
        exits[at] = exits.get(succ, succ) if succ // block == at // block else succ
    return [(at, succ, exits[at], fields, start) for at, succ, fields, start in found]


CANDIDATES = pa.schema([("file", pa.string()), ("size", pa.int64()), ("at", pa.int64()), ("succ", pa.int64()), ("exit", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("sound", pa.bool_()), ("url", pa.string()), ("payload", pa.binary())])
SCHEMA = "file string, size long, at long, succ long, exit long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, sound boolean, url string, payload binary"


def _number(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def _scan(block: int, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                content = content.as_py()
                for at, succ, leave, fields, start in candidates(content, block):
                    head_end = content.find(b"\r\n\r\n", start, succ - 4)
                    http = content[start:head_end].decode("utf-8", "replace").lower() if head_end >= 0 else ""
                    said = next((int(v) for k, _, v in (x.partition(":") for x in http.split("\r\n")) if k == "content-length" and v.strip().isdigit()), None)
                    payload = content[head_end + 4 : succ - 4]
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    kind = fields.get("warc-type", "")
                    sound = head_end >= 0 and (kind == "revisit" or kind == "response" and len(payload) == said and hashlib.sha256(payload).hexdigest() == digest)
                    rows.append((path, len(content), at, succ, leave, _number(fields.get("warc-record-id")), said, digest, kind, _number(fields.get("warc-refers-to")), sound, fields.get("warc-target-uri"), payload if payloads and kind == "response" else None))
                if not rows or rows[-1][0] != path:
                    rows.append((path, len(content), None, None, None, None, None, None, None, None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), CANDIDATES)] if rows else [pa.array([], t.type) for t in CANDIDATES], schema=CANDIDATES)

    return run


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block's sorted links, those on the chain from its entry. Rows come as (file, block, entry, links)."""
    for batch in batches:
        files, places = [], []
        for file, entry, ats, succs in zip(*(batch.column(c).to_pylist() for c in ("file", "entry", "ats", "succs"))):
            link = dict(zip(ats, succs))
            while entry in link:
                files.append(file)
                places.append(entry)
                entry = link[entry]
        yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(places, pa.int64())], names=["file", "at"])


def read_warc(spark: SparkSession, path: str, payloads: bool = False, block: int = BLOCK) -> DataFrame:
    """The records of the archives below path: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    found = common.written(files.mapInArrow(_scan(block, payloads), SCHEMA), "candidates")
    links = found.where("at is not null").select("file", "at", "succ", "exit")
    sizes = found.groupBy("file").agg(F.max("size").alias("size"))
    reached = common.written(sizes.select("file", F.lit(0).cast("long").alias("at")), "reached")
    jump = common.written(links.select("file", "at", F.col("exit").alias("to")), "jump")
    n = reached.count()
    while True:  # after k rounds a pointer spans 2**k blocks
        more = common.written(reached.unionByName(reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct(), "reached")
        m = more.count()
        if m == n:
            break
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = common.written(jump.join(far, ["file", "to"], "left").select("file", "at", F.coalesce("beyond", "to").alias("to")), "jump")
        reached, n = more, m
    open_ends = sizes.join(reached, (reached["file"] == sizes["file"]) & (reached["at"] == sizes["size"]), "left_anti").limit(1).collect()
    if open_ends:
        raise ValueError(f"the records of {open_ends[0]['file']} do not end at its last byte")
    part = F.expr(f"at div {block}").alias("block")
    entries = reached.select("file", part, F.col("at").alias("entry"))
    held = links.groupBy("file", part).agg(F.collect_list("at").alias("ats"), F.collect_list("succ").alias("succs"))
    kept = entries.join(held, ["file", "block"]).select("file", "entry", "ats", "succs").mapInArrow(_walk, "file string, at long")
    records = found.join(kept.distinct(), ["file", "at"])
    sound = F.coalesce(F.col("sound"), F.lit(False))
    checked = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a record does not hold its payload at "), "file", F.lit(" "), F.col("at").cast("string"))))
    out = records.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to", "url", "payload")
    return out if payloads else out.drop("payload")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    path = common.new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).drop("url")


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""
