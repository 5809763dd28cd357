"""Best-fit packing by patterns fitted with non-negative least squares.

Tokenised documents, cut into pieces of at most ``capacity`` tokens, are packed into
as few sequences as possible without cutting further:

1. Pieces are counted by length.  The histogram has at most ``capacity`` rows, however many
   documents there are; all planning happens on it alone.
2. Lengths are rounded up to ``width`` tokens and every pattern of up to ``most`` documents that fills a
   sequence to within ``waste`` steps is enumerated.  Non-negative least squares finds how often to use each
   so that the patterns together use up the histogram; counts are rounded down.
3. Patterns are filled with true lengths (longest of a bin first), the residual is packed best-fit decreasing
   into what room is left, runs of equal lengths at a time.
4. The plan is a table of runs: the r-th to s-th piece of length L go to sequences t, t+1, ... at an offset.  Pieces are
   numbered within their length over salted groups (a length shared by a third of all pieces is spread over many tasks)
   and look their run up in the plan, whose size depends on ``capacity``, not on the corpus.

Defined results: a NULL text is empty; an empty text is one piece that holds only the end id; an empty table gives an
empty result; repeated rows are packed as often as they stand, NULL ids included.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recipeflow.llm.common import batch_of, column, lean
from recipeflow.llm.word_ids import WordIds
from recipeflow.session import stage

# ---------------------------------------------------------------- tokenising


PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
PIECES_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ]
)


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    schema = PIECES_SCHEMA.append(pa.field("ids", pa.binary())) if with_ids else PIECES_SCHEMA
    closing = np.array([end_id], dtype="<u4")

    def run(batches):
        words = WordIds.of(path)
        for batch in batches:
            ids_of, rows, texts = column(batch, "_id"), column(batch, "_row"), column(batch, "_text")
            at = 0
            while at < len(texts):  # some megabytes of text at a time
                upto, held = at, 0
                while upto < len(texts) and (upto == at or held < 1 << 18):
                    held += len(texts[upto] or "")
                    upto += 1
                out = defaultdict(list)
                for i, found in enumerate(words.texts([t or "" for t in texts[at:upto]]), at):
                    ids = np.concatenate([found, closing]).tobytes()
                    for p, b in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[b : b + 4 * capacity]
                        for name, v in (
                            ("doc_id", ids_of[i]), ("row", rows[i]), ("piece", p), ("start", b // 4),
                            ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part)), ("ids", part),
                        ):
                            if name != "ids" or with_ids:
                                out[name].append(v)
                if out:
                    yield batch_of(schema, **out)
                at = upto

    return run


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32[, ids]): each document's ids and ``end_id``, cut at ``capacity``.

    ``tokenizer`` is the path of a ``tokenizers`` file on every executor; ``row`` tells repeated rows apart; ``ids`` are
    little-endian unsigned 32-bit.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
        F.col(text_col).cast("string").alias("_text"),
    )
    return rows.mapInArrow(lean(_cut(tokenizer, capacity, end_id, with_ids)), PIECES + (", ids binary" if with_ids else ""))


# ---------------------------------------------------------------- planning on the histogram


def patterns(sizes: list[int], total: int, most: int, waste: int) -> list[tuple[int, ...]]:
    """Multisets of 1 to ``most`` of ``sizes`` (descending) that sum to ``total`` less at most ``waste``."""
    found = []

    def grow(picked: tuple[int, ...], room: int, start: int) -> None:
        if picked and room <= waste:
            found.append(picked)
        if len(picked) < most:
            for i in range(start, len(sizes)):
                if sizes[i] <= room:
                    grow((*picked, sizes[i]), room - sizes[i], i)

    grow((), total, 0)
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises ``|a x - b|`` (active sets after Lawson and Hanson)."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], dtype=bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[j] = True
        while True:
            cols = np.flatnonzero(active)
            s = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (s > 1e-12).all():
                x[:] = 0
                x[cols] = s
                break
            bad = s <= 1e-12
            step = x[cols][bad] / np.maximum(x[cols][bad] - s[bad], 1e-300)
            x[cols] += step.min() * (s - x[cols])
            active[cols[(x[cols] <= 1e-12) & bad]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan_packing(
    histogram: dict[int, int], capacity: int, width: int = 16, most: int = 3, waste: int = 0
) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a sequence, how many such sequences)] that use up ``histogram`` (length -> count)."""
    left = {n: c for n, c in histogram.items() if c}
    plan: list[tuple[tuple[int, ...], int]] = []
    if left.get(capacity):
        plan.append(((capacity,), left.pop(capacity)))
    bins: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left, reverse=True):
        bins[-(-n // width)].append(n)
    sizes, total = sorted(bins, reverse=True), capacity // width
    longest = sorted(left, reverse=True)
    options = patterns(sizes, total, most, waste) if sizes else []
    if options:
        place = {s: i for i, s in enumerate(sizes)}
        a = np.zeros((len(sizes), len(options)))
        for j, p in enumerate(options):
            for s in p:
                a[place[s], j] += 1
        target = np.array([float(sum(left[n] for n in bins[s])) for s in sizes])
        # long pieces are the hard ones to place later: their bins count more
        weight = np.sqrt(np.array(sizes, dtype=float))
        counts = np.floor(nnls(a * weight[:, None], target * weight) + 1e-6).astype(np.int64)
        for j in np.argsort(-counts):
            want = int(counts[j])
            while want > 0:  # fill the pattern with runs of true lengths
                picked: list[int] = []
                need: dict[int, int] = defaultdict(int)
                for i, s in enumerate(options[j]):
                    if i + 1 < len(options[j]):
                        n = next((n for n in bins[s] if left[n] > need.get(n, 0)), None)
                    else:  # the last one also takes up what rounding left over: the longest that fits
                        room = capacity - sum(picked)
                        n = next((n for n in longest if room >= n > (s - 1) * width and left[n] > need.get(n, 0)), None)
                    if n is None:
                        break
                    need[n] += 1
                    picked.append(n)
                if len(picked) < len(options[j]):
                    break
                times = min([want, *(left[n] // k for n, k in need.items())])
                for n, k in need.items():
                    left[n] -= k * times
                plan.append((tuple(picked), times))
                want -= times
    # the residual, best fit, longest first; sequences of the plan still have room from rounding
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for p, times in plan:
        rooms[capacity - sum(p)].append((p, times))
    for n in sorted(left, reverse=True):
        todo = left[n]
        while todo > 0:
            room = min((r for r, have in rooms.items() if r >= n and have), default=None)
            if room is None:
                k = capacity // n
                if todo >= k:
                    rooms[capacity - k * n].append(((n,) * k, todo // k))
                    todo %= k
                if todo:
                    rooms[capacity - todo * n].append(((n,) * todo, 1))
                todo = 0
                continue
            p, times = rooms[room].pop()
            used = min(times, todo)
            if times > used:
                rooms[room].append((p, times - used))
            rooms[room - n].append(((*p, n), used))
            todo -= used
    return [x for have in rooms.values() for x in have]


def plan_runs(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) for each place in a pattern."""
    runs, used, sequence = [], defaultdict(int), 0
    for p, times in plan:
        offset = 0
        for n in p:
            runs.append((n, used[n], used[n] + times, sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return runs


# ---------------------------------------------------------------- packing


def pack_pieces(pieces: DataFrame, capacity: int = 2048, width: int = 16, most: int = 3, salts: int = 64) -> DataFrame:
    """``pieces`` (with row, piece, length <= capacity; read several times, so give a stage) with sequence_id and offset."""
    spark = pieces.sparkSession
    salt = F.pmod(F.xxhash64("row", "piece"), F.lit(salts)).cast("int")
    salted = pieces.select("row", "piece", "length", salt.alias("salt"))
    counts = stage(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan_runs(plan_packing(histogram, capacity, width, most))
    table = spark.createDataFrame(
        runs or [(0, 0, 0, 0, 0)], "length long, first long, last long, sequence long, offset long"
    )
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "piece")) - 1
    # at most capacity * salts rows of 24 bytes, and runs whose number follows from the capacity
    ranked = pieces.withColumn("salt", salt).withColumn("_n", within).join(F.broadcast(bases), ["length", "salt"])
    ranked = ranked.withColumn("_rank", F.col("base") + F.col("_n"))
    t = F.broadcast(table.withColumnRenamed("length", "_length"))
    fits = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("last"))
    return ranked.join(t, fits).select(
        *[pieces[c] for c in pieces.columns],
        (F.col("sequence") + F.col("_rank") - F.col("first")).alias("sequence_id"),
        "offset",
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Tokenise, cut and pack: one row per piece (see :func:`token_pieces`) with sequence_id and offset."""
    pieces = stage(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), "packing-pieces")
    return pack_pieces(pieces, capacity)
