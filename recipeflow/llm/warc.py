"""WARC archives: write pages as records, read them back by boundary-chain verification.

Writing.  One record per page; records with equal payloads become revisits of the
one with the largest page id.  Roles are decided on digests alone; the revisit list
is a narrow stage that a join broadcasts only when Spark sees it small.  A record
ends in CR LF CR LF, which is the line separator given to Spark's text writer, so
files come out as plain WARC through the ordinary commit protocol, on any file
system that Spark writes.

Reading.  The magic ``WARC/1.0`` may also stand inside a payload, so a split of
a file cannot tell records from look-alikes.  Spark's splittable text reader cuts
at every magic; each task emits, for every candidate, its offset and the offset its
own header claims for its successor (the candidate's place in the file is its place in
the split plus the bytes of the splits before it).  Pointer jumping from the start of
each file then keeps the candidates that a chain of successors reaches: after k rounds
the first 2^k records of a file are known.  A record whose payload contains the magic was cut into
several candidates; the unreachable pieces are put back to the reachable record they
lie in.  Only such pieces keep their bytes; all other payloads are digested where
they are read.

Defined results: NULL html is an empty payload; a NULL page id is written without a
number and read back as NULL; rows repeated in whole are all ``response`` if they hold the
largest id of their payload, else all ``revisit``.  An empty table gives no files and no rows.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recipeflow.session import stage, work_dir

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Values 0-31 as conv(..., 32) writes them, and as RFC 4648 base32 does.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 hex digits, 5 at a time, as 4 base32 digits."""
    hexed = F.sha1(payload)
    parts = [
        F.lpad(F.upper(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32)), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def page_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that revisit another record."""
    keyed = stage(
        pages.select("page_id", base32_sha1(F.col("html")).alias("digest"), F.octet_length("html").alias("bytes")),
        "warc-digests",
    ).where(F.col("bytes") >= min_bytes)
    best = stage(
        keyed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1"),
        "warc-shared",
    )
    return stage(
        keyed.join(best, "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select("page_id", "digest", "refers_to")
        .distinct(),
        "warc-revisits",
    )


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``.

    Pages with equal payloads of at least ``min_bytes`` bytes: the largest page id is
    the response, others revisit it.
    """
    pages = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    revisits = page_roles(pages, min_bytes).select(
        F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to"
    )
    rows = pages.withColumn("digest", base32_sha1(F.col("html"))).join(
        revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left"
    )
    revisit = F.col("_digest").isNotNull()
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    # a header value must stay on its line
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]+", " ")
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), page, F.lit(">"))),
        line("WARC-Target-URI", url),
        F.when(
            revisit,
            line(
                "WARC-Refers-To",
                F.concat(F.lit("<urn:page:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(">")),
            ),
        ).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.octet_length("html").cast("string")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(header, body).alias("value")).write.option("lineSep", END).text(path)


CANDIDATES = pa.schema(
    [
        ("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()),
        ("length", pa.int64()), ("head", pa.int64()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
        ("type", pa.string()), ("uri", pa.string()), ("stated_bytes", pa.int64()), ("stated_digest", pa.string()),
        ("whole", pa.bool_()), ("payload_sha1", pa.string()),
    ]
)
CANDIDATES_DDL = (
    "file string, block long, at long, size long, length long, head long, page_id long, refers_to long, type string, "
    "uri string, stated_bytes long, stated_digest string, whole boolean, payload_sha1 string"
)


def parse_header(piece: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields of what follows a magic, and where its content starts; None if there is no whole header."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b": ")
        if not colon:
            return None
        fields[name.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", fields.get("Content-Length", "")):
        return None
    return fields, end + 4


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _number(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def _placed_pieces(batches):
    """(file, block, place in the block, bytes) of each piece, in file order; the place counts
    from the first piece that this split owns."""
    place: dict[tuple[str, int], int] = {}
    for batch in batches:
        out = []
        for value, file, block in zip(*(batch.column(i) for i in range(3)), strict=True):
            piece, key = value.as_py() or b"", (file.as_py(), block.as_py())
            at = place.get(key, 0)
            # the reader drops the separator: every piece but the first of a file had one before it
            place[key] = at + len(piece) + len(MAGIC)
            out.append((*key, at, piece))
        yield out


def _emit_candidates(batches):
    """One row per piece: what its header says, and its payload's digest if the piece is a whole record."""
    for placed in _placed_pieces(batches):
        cols: dict[str, list] = {f.name: [] for f in CANDIDATES}
        for file, block, at, piece in placed:
            row: dict = dict.fromkeys(cols) | {
                "file": file, "block": block, "at": at, "size": len(piece), "whole": False,
            }
            parsed = parse_header(piece)
            if parsed:
                fields, head = parsed
                n = int(fields["Content-Length"])
                row |= {
                    "length": head + n + len(END),
                    "head": head,
                    "page_id": _number(fields.get("WARC-Record-ID")),
                    "refers_to": _number(fields.get("WARC-Refers-To")),
                    "type": fields.get("WARC-Type"),
                    "uri": fields.get("WARC-Target-URI"),
                    "stated_digest": fields.get("WARC-Payload-Digest", "").removeprefix("sha1:"),
                }
                stated = fields.get("X-Payload-Length", "")
                row["stated_bytes"] = int(stated) if re.fullmatch(r"\d{1,18}", stated) else n
                if row["length"] == len(piece):
                    row |= {"whole": True, "payload_sha1": sha1_base32(piece[head : head + n])}
            for k, v in row.items():
                cols[k].append(v)
        yield pa.RecordBatch.from_pydict(cols, schema=CANDIDATES)


PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("bytes", pa.binary())])


def _emit_pieces(batches):
    for placed in _placed_pieces(batches):
        cols = list(zip(*placed, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PIECES, strict=True)], schema=PIECES)


def _read_pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("value"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def scan_candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, block bases).  Candidates have ``offset`` (of their magic in the file) and
    ``next`` (what their header claims for the successor); a base is the bytes before a block's first piece."""
    found = stage(_read_pieces(spark, path).mapInArrow(_emit_candidates, CANDIDATES_DDL), "warc-candidates")
    # a file starts with the magic, so its first piece is empty and stands before offset 0; pieces of a
    # file follow each other without gap, each a magic and ``size`` bytes
    sizes = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = stage(
        sizes.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "warc-blocks"
    )
    offset = F.col("base") + F.col("at") - len(MAGIC)
    placed = found.join(bases, ["file", "block"]).select(
        "*", offset.alias("offset"), (offset + len(MAGIC) + F.col("length")).alias("next")
    )
    return stage(placed.where("offset >= 0").drop("block", "at", "base"), "warc-placed"), bases


def reachable(links: DataFrame) -> DataFrame:
    """Pointer jumping: the (file, offset) that the chain from offset 0 of each file reaches.

    ``links`` is (file, offset, next).  Each round adds the jump of every known record and
    squares the jumps, so the number of rounds is the logarithm of the most records in a file.
    """
    known = stage(links.where("offset = 0").select("file", "offset"), "warc-known")
    jumps = links.where("next is not null").select("file", "offset", "next")
    while True:
        step = known.join(jumps, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        step = stage(step.join(links.select("file", "offset"), ["file", "offset"], "left_semi"), "warc-step")
        if step.isEmpty():
            return known
        known = stage(known.unionByName(step), "warc-known")
        onward = jumps.select("file", F.col("offset").alias("next"), F.col("next").alias("after"))
        jumps = stage(
            jumps.join(onward, ["file", "next"]).select("file", "offset", F.col("after").alias("next")), "warc-jumps"
        )


JOINED = "file string, offset long, joined_sha1 string"
JOINED_SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("joined_sha1", pa.string())])


def _digest_joined(batches):
    """Puts the pieces of each split record together again, magics between them, and digests the payload."""
    for batch in batches:
        cols: dict[str, list] = {f.name: [] for f in JOINED_SCHEMA}
        for r in batch.to_pylist():
            whole = MAGIC.encode().join(p["bytes"] for p in r["pieces"])
            content = whole[r["head"] : r["length"] - len(END)]
            complete = len(whole) == r["length"]
            cols["file"].append(r["file"])
            cols["offset"].append(r["owner"])
            cols["joined_sha1"].append(sha1_base32(content) if complete else None)
        yield pa.RecordBatch.from_pydict(cols, schema=JOINED_SCHEMA)


def _split_digests(spark: SparkSession, path: str, bases: DataFrame, found: DataFrame, known: DataFrame) -> DataFrame:
    """(file, offset, joined_sha1) of the reachable records that look-alikes cut into pieces."""
    heads = found.join(known, ["file", "offset"]).select("file", "offset", "head", "length", "whole")
    alike = found.join(known, ["file", "offset"], "left_anti").select("file", "offset")
    marked = heads.unionByName(alike, allowMissingColumns=True)
    # narrow rows (about 40 bytes) of one file at a time, in order: the last real record is the owner
    before = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    own = F.struct(F.col("offset").alias("owner"), "head", "length", "whole")
    owned = marked.select("file", "offset", F.last(F.when(F.col("whole").isNotNull(), own), True).over(before).alias("o"))
    owned = stage(owned.where("not o.whole").select("file", "offset", "o.owner", "o.head", "o.length"), "warc-split")
    pieces = _read_pieces(spark, path).mapInArrow(_emit_pieces, "file string, block long, at long, bytes binary")
    pieces = pieces.join(bases, ["file", "block"]).select(
        "file", (F.col("base") + F.col("at") - len(MAGIC)).alias("offset"), "bytes"
    )
    joined = pieces.join(owned, ["file", "offset"]).groupBy("file", "owner").agg(
        F.first("head").alias("head"),
        F.first("length").alias("length"),
        F.sort_array(F.collect_list(F.struct("offset", "bytes"))).alias("pieces"),  # of one record
    )
    return joined.mapInArrow(_digest_joined, JOINED)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``: file, offset, page_id, uri, payload_bytes,
    payload_digest, record_type, refers_to, digest_ok.

    A response's digest is that of the payload as read, and ``digest_ok`` tells whether the
    header agrees; a revisit has no payload of its own and carries what its header states.
    """
    found, bases = scan_candidates(spark, path)
    known = reachable(found.select("file", "offset", "next"))
    records = found.join(known, ["file", "offset"])
    if not records.where("not whole").isEmpty():
        joined = _split_digests(spark, path, bases, found, known)
        records = records.join(joined, ["file", "offset"], "left").withColumn(
            "payload_sha1", F.coalesce("payload_sha1", "joined_sha1")
        )
    revisit = F.col("type") == "revisit"
    return records.select(
        "file",
        "offset",
        "page_id",
        "uri",
        F.when(revisit, F.col("stated_bytes")).otherwise(F.col("length") - F.col("head") - len(END)).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
        (revisit | F.col("payload_sha1").eqNullSafe(F.col("stated_digest"))).alias("digest_ok"),
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = work_dir(spark, "warc")
    write_warc(pages, path, min_bytes)
    return read_warc(spark, path)
