"""Fill-in-middle transformation with content-defined chunk memoization.

A text's units are ``[white]*[^white]+|[white]+``, matched left to right, so a unit ends where a run of other characters is
followed by white space, and at the end of the text.

1. A rolling hash over the last ``WINDOW`` code points cuts the text into chunks (``LEAST`` to ``MOST`` code points). The
   places of the cuts depend on the characters around them alone, so a passage that many documents share gives the same chunks.
2. A chunk's boundary summary - the unit ends inside it, whether it begins with white space, whether it ends in a unit - is
   kept in a cache of ``CACHE_CHARS`` code points (least recently used go). The hash only finds the entry: it counts when
   the whole content is equal.
3. Combining summaries gives the running count of unit ends at each chunk; the chunk that holds a wanted unit's end is found
   in the running counts, and that chunk alone is read again. No list of a document's units is ever built.

Each document is transformed by itself, in one narrow pass; nothing is shuffled and a hot source or group of copies is no group here.

Defined results: a NULL text is empty; an empty text has no units and stays plain; the cuts are seeded by the id alone, so repeated
rows give repeated results and a NULL id seeds as an empty string; a text that holds a marker stays plain, as does any whose
pieces could not be told apart in the output; long texts are hashed ``SEGMENT`` code points at a time; an empty table
gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recipeflow.llm.common import batch_of, column, lean

#: Code points that the rolling hash sees (a power of two), and the bits that must be zero at a cut: chunks of about 512 + LEAST.
WINDOW, CUT_BITS = 32, 9
LEAST, MOST = 128, 4096
#: Code points of chunks that a Python task remembers, and that it hashes at a time.
CACHE_CHARS, SEGMENT = 8 << 20, 1 << 18
WHITE = frozenset("\x20\t\n\x0b\x0c\r")
MARKERS = ("<P>", "<S>", "<M>")


def rolling_hash(codes: np.ndarray) -> np.ndarray:
    """For each place the hash of the ``WINDOW`` code points that end there (fewer at the beginning)."""
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    width = 1
    while width < WINDOW:  # the hash of twice the width from two halves
        wider = x.copy()
        wider[width:] += x[:-width] * np.uint64(pow(0x100000001B3, width, 1 << 64))
        x, width = wider, width * 2
    return x ^ (x >> np.uint64(32))


def chunk_ends(text: str) -> Iterator[int]:
    """Where the chunks of ``text`` end; the last is its length."""
    begin, mask = 0, np.uint64((1 << CUT_BITS) - 1)
    for at in range(0, len(text), SEGMENT):
        before = min(at, WINDOW)
        codes = np.frombuffer(text[at - before : at + SEGMENT].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        for place in (np.flatnonzero((rolling_hash(codes)[before:] & mask) == 0) + (at + 1)).tolist():
            while place - begin > MOST:
                begin += MOST
                yield begin
            if place - begin >= LEAST:
                begin = place
                yield begin
    while begin < len(text):
        begin = min(len(text), begin + MOST)
        yield begin


def summary_of(chunk: str) -> tuple[int, bool, bool]:
    """(unit ends inside the chunk, whether it begins with white space, whether it ends in a unit)."""
    inside = chunk[-1] not in WHITE
    return len(chunk.encode("utf-8", "surrogatepass").split()) - inside, chunk[0] in WHITE, inside


class Summaries:
    """Boundary summaries of chunks by content, as many as hold ``most`` code points."""

    def __init__(self, most: int = CACHE_CHARS):
        self.most, self.held, self.hits, self.misses = most, 0, 0, 0
        self.known: OrderedDict[str, tuple[int, bool, bool]] = OrderedDict()

    def of(self, chunk: str) -> tuple[int, bool, bool]:
        found = self.known.get(chunk)  # a dict compares the content of what the hash finds
        if found is not None:
            self.hits += 1
            self.known.move_to_end(chunk)
            return found
        self.misses += 1
        found = self.known[chunk] = summary_of(chunk)
        self.held += len(chunk)
        while self.held > self.most:
            self.held -= len(self.known.popitem(last=False)[0])
        return found


class Units:
    """The units of one text, from its chunks' summaries."""

    def __init__(self, text: str, summaries: Summaries):
        self.text, self.begins, self.upto, self.across = text, [], [], []
        begin = ends = 0
        inside = False
        for end in chunk_ends(text):
            within, white, last = summaries.of(text[begin:end])
            across = inside and white  # a unit ends between the chunks
            ends += within + across
            self.begins.append(begin)
            self.upto.append(ends)
            self.across.append(across)
            begin, inside = end, last
        self.count = ends + bool(text)

    def end(self, unit: int) -> int:
        """Code points up to the end of the ``unit``-th unit (from 1; 0 for none)."""
        if unit <= 0:
            return 0
        if unit >= self.count:
            return len(self.text)
        c = bisect_left(self.upto, unit)
        begin = self.begins[c]
        left = unit - (self.upto[c - 1] if c else 0) - self.across[c]
        if left == 0:
            return begin
        end = self.begins[c + 1] if c + 1 < len(self.begins) else len(self.text)
        for at in range(begin + 1, end):
            if self.text[at] in WHITE and self.text[at - 1] not in WHITE:
                left -= 1
                if left == 0:
                    return at
        raise AssertionError("the chunk's summary doesn't fit its content")


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2 ** 32 that depend on the seed and the id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def fim_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    fim_percent: int = 50,
    spm_percent: int = 80,
    markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """One row per row of ``docs``: id, n (units), form (plain, psm or spm), output, prefix_chars and middle_chars (NULL if plain)."""
    prefix_mark, suffix_mark, middle_mark = markers
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n", pa.int64()),
            ("form", pa.string()),
            ("output", pa.string()),
            ("prefix_chars", pa.int64()),
            ("middle_chars", pa.int64()),
        ]
    )

    def transform(text: str, doc_id: int | None, summaries: Summaries) -> tuple:
        units = Units(text, summaries)
        h1, h2, h3, h4 = draws(seed, doc_id)
        plain = units.count, "plain", text, None, None
        if not text or h3 % 100 >= fim_percent or any(m in text for m in markers):
            return plain
        first, second = sorted((h1 % (units.count + 1), h2 % (units.count + 1)))
        a, b = units.end(first), units.end(second)
        form = "spm" if h4 % 100 < spm_percent else "psm"
        if form == "psm":
            output = "".join((prefix_mark, text[:a], suffix_mark, text[b:], middle_mark, text[a:b]))
        else:
            output = "".join((suffix_mark, text[b:], prefix_mark, text[:a], middle_mark, text[a:b]))
        if any(output.count(m) != 1 for m in markers):  # a piece and a marker together make another one
            return plain
        return units.count, form, output, a, b - a

    def run(batches):
        summaries = Summaries()
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "_text")
            for at in range(0, len(ids), 256):
                part = slice(at, at + 256)
                rows = [transform(t or "", i, summaries) for i, t in zip(ids[part], texts[part], strict=True)]
                done = dict(zip(schema.names[1:], map(list, zip(*rows, strict=True)), strict=True))
                yield batch_of(schema, doc_id=ids[part], **done)

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    out = read.mapInArrow(
        lean(run), "doc_id long, n long, form string, output string, prefix_chars long, middle_chars long"
    )
    return out.withColumnRenamed("doc_id", id_col)


def restored_text(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``output`` was made of: the pieces between its markers, put back in order."""
    pieces = F.split(output, "|".join(r"\Q" + m + r"\E" for m in markers), -1)
    return (
        F.when(form == "psm", F.concat(pieces[1], pieces[3], pieces[2]))
        .when(form == "spm", F.concat(pieces[2], pieces[3], pieces[1]))
        .otherwise(output)
    )
