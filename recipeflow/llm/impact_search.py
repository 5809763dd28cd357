"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, with score intervals.

Terms are runs of letters and digits (every character beyond ASCII counts as one), with A-Z lower-cased. A document's score for a query sums, over the query's
terms with repeats, ``w * ((10**9 tf) div (1000 tf + 12 m))`` with ``w = floor(1000 ln((2 N + 2) / (2 df + 1)))`` and
``m = 100 - b + (b n N) div L``; N documents hold a term, L terms in all, n in the document; whole numbers but for the logarithm.

1. One pass over all texts counts terms. A bitmap of the queries' terms (``SLOTS`` bits, whatever their number) leaves out most others before anything is
   written; every document's n counts all of its terms.
2. N, L and df come from the written counts by partial aggregates, never from a sample.
3. Documents are searched in blocks of at most ``BLOCK_DOCS``. A block's lists hold one posting a document and term, sorted by falling impact. For a query the lists
   are read from the top, the same depth in all: a document's lower bound is the sum of the impacts that were read, its upper bound
   adds for each list in which it was not met the impact that would be read next. A document is left when its upper bound is below the score of the last rank so far
   (of this block's lower bounds or of the task's earlier blocks); reading goes on until no unseen document can enter and lower and upper
   bounds of all that are left meet, so membership, ties and final scores are exact. Ties at the last rank are kept until ids decide.
4. A task gives at most ``top`` rows a query; the final ranks are a ranked limit over salted groups, then over queries.

Queries of equal text are searched once. Queries are held by tasks in groups of at most about ``QUERY_TERMS`` terms (a larger query is a group of its own), a further
pass over the written counts for each group; the texts are read once. Very long texts are counted ``PIECE`` bytes at a time.

Defined results: a NULL text, or one without terms, is no document that counts and is never ranked; a query without terms, or whose terms no document
holds, has no rows; scores of 0 are not ranked; equal scores come by ascending id, NULL ids last; repeated document rows are documents of their own; repeated query rows
give one result; query rows of one id and different texts give a result each; empty tables give an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recipeflow.llm.common import batch_of, column, lean
from recipeflow.session import stage

#: Bits of the bitmap of query terms: at most 4 MB.
SLOTS = 1 << 25
#: Documents and postings of a block, and distinct terms of all the queries that a task holds at a time.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 14, 1 << 20
QUERY_TERMS = 1 << 17
#: Bytes of a text that are split into terms at a time.
PIECE = 1 << 20
#: Postings of each list that are read first; each later read is GROWTH times as deep.
DEPTH, GROWTH = 64, 4
#: Of the impact formula.
LENGTH_PERCENT, SALTS = 25, 64

_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def count_terms(text: str) -> Counter:
    """How often each term (UTF-8) stands in ``text``."""
    data = text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES)  # other characters are spaces now
    if len(data) <= PIECE:
        return Counter(data.split())
    counts: Counter = Counter()
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            cut = data.rfind(b" ", at, end)  # a term isn't cut
            end = cut if cut > at else data.find(b" ", end)
            end = len(data) if end < 0 else end
        counts.update(data[at:end].split())
        at = end
    return counts


# ---------------------------------------------------------------- counts


def query_terms(queries: DataFrame, text: Column) -> DataFrame:
    """(digest, term, repeats) of the distinct texts of ``queries``."""

    def run(batches):
        for batch in batches:
            digests, terms, repeats = [], [], []
            for digest, own in zip(column(batch, "digest"), column(batch, "text"), strict=True):
                for term, n in count_terms(own or "").items():
                    digests.append(digest)
                    terms.append(term.decode("utf-8", "surrogatepass"))
                    repeats.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.string()), pa.array(terms, pa.string()), pa.array(repeats, pa.int64())],
                names=["digest", "term", "repeats"],
            )

    texts = queries.select(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256).alias("digest"), text.cast("string").alias("text"))
    return texts.dropDuplicates(["digest"]).mapInArrow(lean(run), "digest string, term string, repeats long")


def term_bitmap(terms: DataFrame) -> np.ndarray:
    """One bit for the crc32 of each term; at most ``SLOTS`` bits reach the driver, however many terms there are."""
    slot = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(SLOTS)) + 1
    rows = terms.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(SLOTS // 8, np.uint8)
    for row in rows.collect():
        own = np.frombuffer(bytes(row["bits"]), np.uint8)
        at = (row["bucket"] - 1) * len(own)
        out[at : at + len(own)] = own
    return out


def counted_texts(docs: DataFrame, doc_id: Column, text: Column, bits: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tf): ``n`` terms of each text with repeats, and those terms that ``bits`` may hold."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("tf", pa.list_(pa.int64()))])

    def run(batches):
        bits, wanted = shared.value, {}

        def may(term: bytes) -> bool:
            hit = wanted.get(term)
            if hit is None:
                if len(wanted) > 1 << 18:
                    wanted.clear()
                slot = zlib.crc32(term) % SLOTS
                hit = wanted[term] = bool(bits[slot >> 3] >> (slot & 7) & 1)
            return hit

        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "_text")
            for at in range(0, len(ids), 1024):
                counts = [count_terms(t or "") for t in texts[at : at + 1024]]
                kept = [[t for t in c if may(t)] for c in counts]
                yield batch_of(
                    schema,
                    doc_id=ids[at : at + 1024],
                    n=[c.total() for c in counts],
                    terms=[[t.decode("utf-8", "surrogatepass") for t in own] for own in kept],
                    tf=[[c[t] for t in own] for c, own in zip(counts, kept, strict=True)],
                )

    read = docs.select(doc_id.cast("long").alias("doc_id"), text.cast("string").alias("_text"))
    return read.mapInArrow(lean(run), "doc_id long, n long, terms array<string>, tf array<long>")


# ---------------------------------------------------------------- NRA


@dataclass
class Queries:
    """The queries of a group: query i has the terms ``term[begin[i]:begin[i + 1]]`` with the weights ``weight``."""

    names: list[int]
    begin: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    vocabulary: dict[str, int]


def nra(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents whose score is among the ``top`` highest, ties at the end included, and at least ``floor``, with their scores.

    ``lists`` holds (document, gain) by falling gain, each document once a list; documents are numbers below ``docs``.
    """
    lower = np.zeros(docs, np.int64)
    seen = np.zeros((docs, len(lists)), bool)
    left = np.ones(docs, bool)  # whose upper bound may still reach the last rank
    met = np.zeros(docs, bool)
    floor = max(floor, 1)
    at, depth = 0, DEPTH
    while True:
        ahead = np.zeros(len(lists), np.int64)  # what the next read of each list would give at most
        for i, (doc, gain) in enumerate(lists):
            d = doc[at : at + depth]
            if len(d):
                lower[d] += gain[at : at + depth]
                seen[d, i] = True
                met[d] = True
                if at + depth < len(gain):
                    ahead[i] = gain[at + depth]
        at, depth = at + depth, depth * GROWTH
        near = np.flatnonzero(met & left)
        if len(near) >= top:
            floor = max(floor, int(np.partition(lower[near], len(near) - top)[len(near) - top]))
        missing = np.where(seen[near], 0, ahead).sum(1)
        stays = lower[near] + missing >= floor
        left[near[~stays]] = False
        near, missing = near[stays], missing[stays]
        if ahead.sum() < floor and not missing.any():  # no unseen document can enter, and all intervals are points
            return near, lower[near]
        if not ahead.any():
            return near, lower[near]


def best_rows(scores: np.ndarray, ids: np.ndarray, absent: np.ndarray, top: int) -> np.ndarray:
    """The places of the ``top`` first by falling score, then id, NULL ids last."""
    return np.lexsort((ids, absent, -scores))[:top]


class Found:
    """The best documents of each query so far."""

    def __init__(self, queries: int, top: int):
        self.top = top
        self.rows: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = [None] * queries

    def floor(self, q: int) -> int:
        rows = self.rows[q]
        return int(rows[0].min()) if rows is not None and len(rows[0]) >= self.top else 1

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        if self.rows[q] is not None:
            scores, ids, absent = (np.concatenate(x) for x in zip(self.rows[q], (scores, ids, absent), strict=True))
        best = best_rows(scores, ids, absent, self.top)
        self.rows[q] = scores[best], ids[best], absent[best]


class Block:
    """Postings of up to ``most`` documents for the terms of one group of queries."""

    def __init__(self, most: int):
        self.most = most
        self.ids: list[int | None] = []
        self.length: list[int] = []
        self.doc: list[int] = []
        self.term: list[int] = []
        self.tf: list[int] = []

    def add(self, doc_id: int | None, n: int, terms: list[str], tf: list[int], vocabulary: dict[str, int]) -> None:
        known = [(vocabulary[t], f) for t, f in zip(terms, tf, strict=True) if t in vocabulary]
        if known:
            self.doc += [len(self.ids)] * len(known)
            self.ids.append(doc_id)
            self.length.append(n)
            self.term += [t for t, _ in known]
            self.tf += [f for _, f in known]

    def full(self) -> bool:
        return len(self.ids) >= self.most or len(self.term) >= BLOCK_POSTINGS

    def search(self, queries: Queries, found: Found, total_docs: int, total_terms: int) -> None:
        if not self.ids:
            return
        absent = np.array([i is None for i in self.ids])
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        doc, term, tf = np.array(self.doc, np.int64), np.array(self.term, np.int64), np.array(self.tf, np.int64)
        m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * np.array(self.length, np.int64) * total_docs // total_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        order = np.lexsort((-impact, term))
        doc, term, impact = doc[order], term[order], impact[order]
        own = np.arange(len(queries.vocabulary))
        begin, end = np.searchsorted(term, own, "left"), np.searchsorted(term, own, "right")
        for q in range(len(queries.names)):
            part = slice(queries.begin[q], queries.begin[q + 1])
            lists = [
                (doc[begin[t] : end[t]], impact[begin[t] : end[t]] * w)
                for t, w in zip(queries.term[part], queries.weight[part], strict=True)
                if w > 0 and end[t] > begin[t]
            ]
            if lists:
                near, scores = nra(lists, len(ids), found.top, found.floor(q))
                if len(near):
                    found.add(q, scores, ids[near], absent[near])


def search_blocks(counted: DataFrame, queries: Queries, total_docs: int, total_terms: int, top: int, block_docs: int) -> DataFrame:
    """(query, doc_id, score): for each query the rows of ``counted`` that may be among its ``top`` highest, ``top`` a task at most."""
    shared = counted.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        queries = shared.value
        found, block = Found(len(queries.names), top), Block(block_docs)
        for batch in batches:
            for row in zip(*[column(batch, c) for c in ("doc_id", "n", "terms", "tf")], strict=True):
                block.add(*row, queries.vocabulary)
                if block.full():
                    block.search(queries, found, total_docs, total_terms)
                    block = Block(block_docs)
        block.search(queries, found, total_docs, total_terms)
        for q, rows in enumerate(found.rows):
            if rows is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([queries.names[q]] * len(rows[0]), pa.int64()), pa.array(rows[1], pa.int64(), mask=rows[2]), pa.array(rows[0], pa.int64())],
                    names=["query", "doc_id", "score"],
                )

    return counted.where("n > 0 and size(terms) > 0").mapInArrow(lean(run), "query long, doc_id long, score long")


# ---------------------------------------------------------------- the search


def query_groups(weights: DataFrame, most: int) -> int:
    """How many groups ``pmod(query, groups)`` must make so that none but a single query's has over ``most`` terms."""
    groups = max(1, -(-weights.count() // most))
    while True:
        large = weights.groupBy(F.pmod("query", F.lit(groups)).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min("query").alias("a"), F.max("query").alias("b"))
        if large.where((F.col("n") > most) & (F.col("a") < F.col("b"))).isEmpty():
            return groups
        groups = 2 * groups + 1


def held_queries(weights: DataFrame) -> Queries:
    """A group of queries, fit for a task: ``weights`` (query, term, weight) is bounded by :func:`query_groups`."""
    rows = weights.orderBy("query", "term").collect()
    vocabulary: dict[str, int] = {}
    names: list[int] = []
    begin: list[int] = []
    for i, r in enumerate(rows):
        vocabulary.setdefault(r["term"], len(vocabulary))
        if not names or names[-1] != r["query"]:
            names.append(r["query"])
            begin.append(i)
    term = np.array([vocabulary[r["term"]] for r in rows], np.int64)
    return Queries(names, np.array([*begin, len(rows)], np.int64), term, np.array([r["weight"] for r in rows], np.int64), vocabulary)


def ranked(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each query with their ``rank``: first within salts, so that no task gets more than a share of a query's rows."""
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last())
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy("query", "_salt").orderBy(*order))).where(F.col("_r") <= top)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= top)
    return last.select("query", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    queries: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id: str = "item_id",
    query_text: str = "text",
    top: int = 20,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """(query id, rank, doc id, score): the ``top`` highest-scoring rows of ``docs`` for each row of ``queries``."""
    spark: SparkSession = docs.sparkSession
    terms = stage(query_terms(queries, F.col(query_text)), "search-query-terms")
    counted = stage(counted_texts(docs, F.col(id_col), F.col(text_col), term_bitmap(terms)), "search-counts")
    total = counted.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    numbered = stage(terms.select("digest").distinct().withColumn("query", F.monotonically_increasing_id()), "search-queries")
    weight = F.floor(1000 * F.log((2.0 * total["docs"] + 2) / (2 * F.col("df") + 1)))
    weights = stage(
        terms.join(df, "term").join(numbered, "digest").select("query", "term", (weight * F.col("repeats")).cast("long").alias("weight")).where("weight > 0"),
        "search-weights",
    )
    rows = None
    groups = query_groups(weights, QUERY_TERMS)
    for g in range(groups):
        held = held_queries(weights.where(F.pmod("query", F.lit(groups)) == g))
        if held.names:
            own = stage(search_blocks(counted, held, total["docs"], total["terms"], top, block_docs), "search-found")
            rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        rows = spark.createDataFrame([], "query long, doc_id long, score long")
    best = stage(ranked(rows, top).join(numbered, "query").drop("query"), "search-ranks")
    asked = queries.select(F.col(query_id).alias("_asked"), F.sha2(F.coalesce(F.col(query_text).cast("string"), F.lit("")), 256).alias("digest")).distinct()
    return asked.join(best, "digest").select(
        F.col("_asked").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score"
    )
