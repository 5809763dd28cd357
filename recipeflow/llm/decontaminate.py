"""Benchmark decontamination by the q-gram lemma.

If a passage of a document equals a benchmark item of m characters but for at most k edits, the two share at least
``m + 1 - q (k + 1)`` q-grams, all of them within k + 1 neighbouring diagonals (text place less item place).  So:

1. every q-gram of a document is looked up among the items' (a bitmap first, then the sorted q-grams);
2. shared q-grams are counted per item and diagonal band; bands are 2 (k + 1) wide and overlap by half, so that any
   k + 1 neighbouring diagonals lie in one of them;
3. bands that reach the bound are verified by a banded alignment of the whole item against that region; it is a leak
   if its edit distance is at most k, which is ``rate`` of the item's length.

Characters are compared in lower case, runs of white space as one space.  Items go to the tasks in blocks of a bounded
size; more items mean more blocks, each a pass of all documents.

Defined results: NULL and empty texts hold no leak; NULL, empty and blank items match nothing; items too short for the lemma get
fewer edits, those shorter than q must occur exactly; repeated rows (documents or items) each give their own results; an
empty table on either side gives an empty result.  Other columns are not read or kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recipeflow.llm.common import boxed, code_points, column, lean, lower_table, segments
from recipeflow.session import stage

#: Characters of items in one block (the tasks hold about 30 bytes for each).
BLOCK_CHARS = 1 << 21
PRIME = np.uint64(0x100000001B3)


class Normal:
    """Texts as lower-cased code points with runs of white space made one space, and where each came from."""

    def __init__(self):
        self.lower = lower_table()
        self.space = np.fromiter((chr(i).isspace() for i in range(1 << 16)), dtype=bool, count=1 << 16)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = codes >= 1 << 16
        plane = np.where(wide, 0, codes)
        space = self.space[plane] & (codes != 10)  # the newline between texts stays
        end = codes == 10
        low = np.where(wide, codes, self.lower[plane]).astype(np.uint64)
        low[space] = 32
        before = np.concatenate([[True], (space | end)[:-1]])
        after = np.concatenate([end[1:], [True]])
        del after
        keep = ~(space & before)
        return low[keep], np.flatnonzero(keep)


def normal_text(text: str | None) -> str:
    return " ".join((text or "").split())


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of each q-gram (64 bits, wrapping)."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = codes[:n].copy()
    for j in range(1, q):
        out *= PRIME
        out += codes[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0x9E3779B97F4A7C15)
    return out


@dataclass
class Index:
    """The items of a block: q-grams sorted, with the items and places that hold each."""

    ids: list[int | None]
    codes: list[np.ndarray]
    edits: np.ndarray
    bound: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    q: int
    reach: int
    short: list[tuple[int | None, str]]


BITS = 22


def build_index(items: list[tuple[int | None, str]], q: int, rate: float) -> Index:
    normal = Normal()
    ids, codes, edits, short = [], [], [], []
    for item_id, text in items:
        own = normal_text(text)
        if not own:
            continue
        c = normal.of(code_points([own])[0][:-1])[0]
        m = len(c)
        if m < q:
            short.append((item_id, "".join(map(chr, c.tolist()))))
            continue
        ids.append(item_id)
        codes.append(c)
        edits.append(max(0, min(int(rate * m), m // q - 1)))  # the bound stays positive
    edits = np.array(edits, dtype=np.int64)
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    hashes = [gram_hashes(c, q) for c in codes]
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(codes)), [len(h) for h in hashes]).astype(np.int32)
    place = np.concatenate([np.arange(len(h)) for h in hashes]).astype(np.int32) if hashes else np.zeros(0, np.int32)
    order = np.argsort(flat, kind="stable")
    grams, first = np.unique(flat[order], return_index=True)
    bitmap = np.zeros(1 << BITS, dtype=bool)
    bitmap[(grams >> np.uint64(64 - BITS)).astype(np.int64)] = True
    bound = sizes + 1 - q * (edits + 1)
    reach = int((sizes + 4 * (edits + 1)).max()) if len(sizes) else 0
    return Index(
        ids, codes, edits, np.maximum(bound, 1), grams, np.append(first, len(flat)), item[order], place[order], bitmap, q,
        max(reach, max((len(s) for _, s in short), default=0)), short,
    )


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int, anchored: bool = False) -> tuple[int, int]:
    """(edits, end) of the best alignment of the whole item with a stretch of ``text`` whose diagonals stay within k of
    ``low`` to ``high``; the stretch may begin anywhere in the band, or if ``anchored`` at place ``low`` only."""
    left, width = low - k, high - low + 2 * k + 1
    lane = np.arange(width)
    big = len(item) + len(text) + 1
    padded = np.concatenate([np.full(max(0, -left), 1 << 40, np.uint64), text])
    shift = max(0, -left)
    need = left + shift + len(item) + width
    if need > len(padded):
        padded = np.concatenate([padded, np.full(need - len(padded), 1 << 40, np.uint64)])
    start = left + lane
    cost = np.where((start >= 0) & (start <= len(text)), 0, big)
    if anchored:
        cost = np.where(start < low, big, start - low)
    for r in range(len(item)):
        at = left + shift + r
        new = cost + (padded[at : at + width] != item[r])
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(new - lane) + lane
        if r % 16 == 15 and cost.min() > k:
            return k + 1, -1
    ends = left + len(item) + lane
    cost = np.where((ends >= 0) & (ends <= len(text)), cost, big)
    best = int(np.argmin(cost))
    return int(cost[best]), int(ends[best])


def regions(index: Index, codes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(owner, item, lowest, highest diagonal) of the bands whose shared q-grams reach the bound."""
    h = gram_hashes(codes, index.q)
    maybe = np.flatnonzero(index.bitmap[(h >> np.uint64(64 - BITS)).astype(np.int64)])
    if not len(maybe):
        return []
    at = np.searchsorted(index.grams, h[maybe])
    at[at == len(index.grams)] = 0
    hit = index.grams[at] == h[maybe]
    place, at = maybe[hit], at[hit]
    count = index.first[at + 1] - index.first[at]
    ends = np.cumsum(count)
    if not len(ends):
        return []
    take = np.repeat(index.first[at] - (ends - count), count) + np.arange(ends[-1])
    item, place = index.item[take].astype(np.int64), np.repeat(place, count)
    diagonal = place - index.place[take]
    step = index.edits[item] + 1
    band = diagonal // step
    span = int(len(codes) + index.reach) + 2
    key = (owner[place].astype(np.int64) * len(index.ids) + item) * span + band + index.reach
    kinds, n = np.unique(np.concatenate([key, key - 1]), return_counts=True)
    who, number = np.divmod(kinds, span)
    number -= index.reach
    who, item = np.divmod(who, len(index.ids))
    good = n >= index.bound[item]
    who, item, number = who[good], item[good], number[good]
    if not len(who):
        return []
    step = index.edits[item] + 1
    alone = np.flatnonzero(np.diff(who, prepend=-1) | np.diff(item, prepend=-1) | (np.diff(number, prepend=-9) > 1))
    last = np.append(alone[1:], len(who)) - 1  # bands side by side are verified as one
    return list(
        zip(
            who[alone].tolist(), item[alone].tolist(), (number * step)[alone].tolist(),
            ((number + 2) * step - 1)[last].tolist(), strict=True,
        )
    )


def _places(text, part) -> list[int]:
    found, at = [], text.find(part)
    while at >= 0:
        found.append(at)
        at = text.find(part, at + 1)
    return found


def find_leaks(index: Index, normal: Normal, texts: list[str | None]) -> list[list[tuple]]:
    """Per text, its leaks (item id, start, end, edits); places are characters of the text as given."""
    out: list[dict] = [{} for _ in texts]
    clean = [t.replace("\n", " ") if t else t for t in texts]
    for group in segments(clean, overlap=4 * index.reach):
        raw, begins = code_points([s.text for s in group])
        codes, origin = normal.of(raw)
        owner = np.searchsorted(begins, origin, "right") - 1
        low = np.searchsorted(owner, np.arange(len(group)), "left")
        high = np.searchsorted(owner, np.arange(len(group)), "right") - 1  # without the newline

        def note(g: int, item_id, a: int, b: int, edits: int) -> None:
            s = group[g]
            start = s.start + int(origin[a] - begins[g])
            end = s.start + int(origin[b - 1] - begins[g]) + 1
            if s.core <= start < max(s.core_end, s.core + 1):
                key = (item_id, start)
                old = out[s.row].get(key)
                if old is None or edits < old[3]:
                    out[s.row][key] = (item_id, start, end, edits)

        for g, j, d0, d1 in regions(index, codes, owner) if index.ids else []:
            item, k = index.codes[j], int(index.edits[j])
            a = max(int(low[g]), d0 - k)
            text = codes[a : min(int(high[g]), d1 + len(item) + k + 1)]
            copies = [p for p in _places(text.tobytes(), item.tobytes()) if p % 8 == 0]
            if copies:  # the banded alignment without edits, for every copy in the region
                for p in copies:
                    note(g, index.ids[j], a + p // 8, a + p // 8 + len(item), 0)
                continue
            edits, end = align(item, text, d0 - a, d1 - a, k)
            if edits > k or end <= 0:
                continue
            # backwards from the end, for where it starts
            back = text[:end][::-1]
            _, length = align(item[::-1], back, 0, k, k, anchored=True) if edits else (0, len(item))
            begin = max(0, end - (length if length > 0 else len(item)))
            note(g, index.ids[j], a + begin, a + end, edits)
        if index.short:
            whole = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            for item_id, s in index.short:
                for at in _places(whole, s):
                    note(int(owner[at]), item_id, at, at + len(s), 0)
    return [sorted(found.values(), key=lambda x: (x[1], str(x[0]))) for found in out]


LEAKS = "_id long, item_id long, start long, end long, edits int"


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    q: int = 8,
    rate: float = 0.1,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, start, end, edits): the places of ``docs`` that equal a benchmark item within ``rate`` edits."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text"))
    asked = stage(items.where("text is not null").distinct(), "benchmark-rows")
    # each text is indexed once, however many items hold it
    items = stage(asked.select("text").distinct().withColumn("id", F.monotonically_increasing_id()), "benchmark-items")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    result = None
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("id", "text").collect()  # one block
        shared = spark.sparkContext.broadcast(build_index([(r["id"], r["text"]) for r in own], q, rate))

        def run(batches, shared=shared):
            normal = Normal()
            for batch in batches:
                ids = column(batch, "_id")
                found = find_leaks(shared.value, normal, column(batch, "_text"))
                flat = [(ids[i], *leak) for i, own in enumerate(found) for leak in own]
                cols = list(zip(*flat, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["_id", "item_id", "start", "end", "edits"]
                )

        part = rows.mapInArrow(lean(run), LEAKS)
        result = part if result is None else result.unionByName(part)
    holders = asked.withColumnRenamed("id", "item_id").join(items.withColumnRenamed("id", "_item"), "text").select("_item", "item_id")
    named = result.withColumnRenamed("item_id", "_item").join(holders, "_item")
    return named.select(F.col("_id").alias(id_col), "item_id", "start", "end", "edits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that hold a leak (NULL ids are compared as equal)."""
    bad = stage(leaks(docs, benchmark, id_col, text_col, **how).select(F.col(id_col).alias("_bad")).distinct(), "leaking")
    return boxed(docs, _id=F.col(id_col)).join(bad, F.col("_id").eqNullSafe(F.col("_bad")), "left_anti").select("_doc.*")
