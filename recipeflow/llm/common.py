"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text that a Python task turns into numpy arrays at a time.
SEGMENT_CHARS = 1 << 18
#: Bits of a key bitmap: 4 MB whatever the number of keys.
SLOTS = 1 << 25


def id_bucket(doc_id: Column | str, buckets: int) -> Column:
    """``crc32(doc_id as text) mod buckets`` (NULL for a NULL id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(buckets))


@dataclass
class Segment:
    """A piece of one row's text: ``text`` starts at character ``start`` of the
    row, and what begins in ``[core, core_end)`` belongs to this piece alone."""

    row: int
    start: int
    core: int
    core_end: int
    text: str


def segments(texts: list[str | None], overlap: int = 0, size: int = SEGMENT_CHARS) -> Iterator[list[Segment]]:
    """Groups of segments that cover every text, each group of about ``size`` characters.

    A text longer than ``size`` is cut into cores that join without gap or
    overlap, with ``overlap`` more characters of context on both sides; memory
    is thus bounded whatever the length of a text.  NULL reads as empty.
    """
    group: list[Segment] = []
    held = 0
    for row, text in enumerate(texts):
        text = text or ""
        at = 0
        while True:
            end = min(len(text), at + size)
            piece = Segment(row, max(0, at - overlap), at, end, text[max(0, at - overlap) : end + overlap])
            if group and held + len(piece.text) > size:
                yield group
                group, held = [], 0
            group.append(piece)
            held += len(piece.text)
            at = end
            if at >= len(text):
                break
    if group:
        yield group


def code_points(pieces: list[str], sep: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """All pieces as one array of code points, each followed by ``sep``, and where each starts."""
    joined = sep.join(pieces) + sep
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter((len(p) + 1 for p in pieces), dtype=np.int64, count=len(pieces))
    return codes, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def batch_of(schema: pa.Schema, **cols) -> pa.RecordBatch:
    """A record batch with ``schema``'s columns, in its order."""
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)


def give_back() -> None:
    """Return freed memory of this Python worker to the system: Spark keeps workers for later tasks, and an idle one
    would otherwise hold the most that any of its tasks needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, with :func:`give_back` at the end of each task."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def letter_table() -> np.ndarray:
    """For each code point of the basic plane: 1 if it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(1 << 16)), dtype=np.uint8, count=1 << 16)


def lower_table() -> np.ndarray:
    """Code point -> its lower case where that is one character, else itself."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for i in range(1 << 16):
        low = chr(i).lower()
        if len(low) == 1 and ord(low) < 1 << 16:
            out[i] = ord(low)
    return out


def basic_plane(codes: np.ndarray) -> np.ndarray:
    """Code points with those beyond the basic plane mapped to U+FFFD, fit for the tables above."""
    return np.where(codes < 1 << 16, codes, 0xFFFD)


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """Whole rows as one struct ``_doc`` beside working columns, so that no column
    of ``docs`` can clash with them; ``select("_doc.*")`` undoes it."""
    whole = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("_doc")
    return docs.select(whole, *[c.alias(n) for n, c in more.items()])


def _slot(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS)) + 1


def key_bitmap(rows: DataFrame, *key: str) -> DataFrame:
    """(bucket, bits): one bit for the hash of each ``key`` of ``rows``; at most ``SLOTS`` bits in all, so fit to broadcast."""
    slot = _slot(*[F.col(c) for c in key])
    return rows.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))


def with_maybe(rows: DataFrame, bitmap: DataFrame, *key: Column) -> DataFrame:
    """``rows`` with ``_maybe``: false where the key is surely none of the bitmap's.  Hashes may clash, so a join decides the others;
    only they are shuffled."""
    marked = rows.withColumn("_slot", _slot(*key))
    marked = marked.withColumn("bucket", F.bitmap_bucket_number("_slot")).join(F.broadcast(bitmap), "bucket", "left")
    marked = marked.withColumn("_bit", F.bitmap_bit_position("_slot"))
    byte = F.expr("cast(conv(hex(substring(bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0, F.lit(False))
    return marked.withColumn("_maybe", hit).drop("_slot", "bucket", "bits", "_bit")
