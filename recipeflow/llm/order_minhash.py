"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Texts are sequences of lower-cased words.  Every run of ``k`` words is labelled with its occurrence (first, second, ... of
its kind in the text).  A sketch takes the ``picked`` labelled runs of least hash and keeps them in text order; two texts
agree in a sketch when the same runs come first *in the same order*, which makes the sketch sensitive to edit
similarity rather than to set overlap.  Runs are two words; texts of up to ``SHORT`` words, of which an edit would change too many
runs, have sketches of single words.  A text's keys depend on its words alone, not on what it is read with.

1. Rows of equal text (white space and case aside) are one node; a hot text is pre-aggregated by digest.
2. Texts that agree in a sketch share a bucket. First each member of a bucket meets the smallest node in it; the links that verify
   join most families whole.
3. In the buckets that still hold several classes, all members of different classes are compared, in blocks: a unit holds some of the members outside
   the bucket's largest class and a block of all members, bounded in rows and words, so a bucket with a third of all texts is many units. A pair is compared in one of its
   common buckets only. A unit gives links that join classes which were apart, not pairs.
4. A pair whose words, counted by hash, are too far apart is ruled out. Any other is verified by banded alignment: the word edit
   distance must be at most ``1 - similarity`` of the longer text. The band is that wide, so the test is exact.
5. Verified links make classes: the smallest label travels along links, with label jumps, until nothing changes.

The classes are those that verifying all pairs of each bucket would give; ``n_links`` counts the links that were verified on the
way.  Texts that agree in no sketch are not compared; recall is measured in the tests, by band of similarity.

Defined results: NULL and empty texts are equal texts (one class, no links); a text of fewer than ``k`` words is one run; a class is
named by its smallest id, NULL ids come last; repeated rows belong to one class; an empty table gives an empty result;
other columns are not read or kept as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recipeflow.llm.common import boxed, code_points, column, key_bitmap, lean, with_maybe
from recipeflow.session import discard, stage

SKETCHES, PICKED, WORDS, SIMILARITY = 48, 3, 2, 0.8
#: Texts of up to so many words have sketches of their own, of fewer single words.
SHORT, SHORT_SKETCHES, SHORT_PICKED = 30, 20, 3
#: Members and words of a block, about.
BLOCK_ROWS, BLOCK_WORDS = 512, 200_000
#: Runs of a text among which a sketch's picks are sought first, about; where they don't suffice all are.
ENOUGH = 16
#: Places of a text's word counts by hash, from which most pairs are seen to be too far apart without an alignment.
BAG = 1024


def text_key(text: Column) -> Column:
    """Digest of the words of a text."""
    words = F.lower(F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"\s+", " ")))
    return F.sha2(words, 256)


# ---------------------------------------------------------------- sketches


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """Order MinHash sketches of many texts at a time."""

    def __init__(self, sketches: int, picked: int, k: int):
        rng = np.random.default_rng(11)
        self.seeds = rng.integers(1, 1 << 63, sketches, dtype=np.uint64)
        self.power = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        self.picked, self.k = picked, k

    def word_hashes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, text of each word)."""
        codes, begins = code_points([" ".join(t.lower().split()) for t in texts])
        space = (codes == 32) | (codes == 10)
        start = ~space & np.concatenate([[True], space[:-1]])
        at = np.flatnonzero(start)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        place = np.arange(len(codes))
        within = place - np.maximum.accumulate(np.where(start, place, 0))
        value = _mixed(codes.astype(np.uint64)) * self.power[within & 255]
        value[space] = 0
        return _mixed(np.add.reduceat(value, at)), np.searchsorted(begins, at, "right") - 1

    def bags(self, texts: list[str]) -> np.ndarray:
        """One row per text: words by the hash of the word, 255 at most."""
        words, owner = self.word_hashes(texts)
        place = owner * BAG + (words % np.uint64(BAG)).astype(np.int64)
        return np.minimum(np.bincount(place, minlength=len(texts) * BAG), 255).astype(np.uint8).reshape(len(texts), BAG)

    def runs(self, words: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each occurrence-labelled run of k words, text of each), in text order."""
        k = self.k
        count = np.bincount(owner, minlength=n)
        kept = np.where(count > 0, np.maximum(count - k + 1, 1), 0)  # a short text is one run
        first = np.cumsum(count) - count
        text = np.repeat(np.arange(n), kept)
        at = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(kept) - kept, kept)
        run = np.zeros(len(text), np.uint64)
        for j in range(k):
            inside = j < count[text]
            run = run * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, words[np.minimum(at + j, len(words) - 1)], 1)
        run = _mixed(run)
        mark = run + _mixed(text.astype(np.uint64) + np.uint64(1))
        order = np.argsort(mark, kind="stable")
        same = np.concatenate([[False], mark[order][1:] == mark[order][:-1]]) if len(order) else np.zeros(0, bool)
        place = np.arange(len(order))
        label = np.zeros(len(order), np.uint64)
        label[order] = (place - np.maximum.accumulate(np.where(same, 0, place))).astype(np.uint64)
        run = _mixed(run + label * np.uint64(0xD6E8FEB86659FD93))
        return run, text

    def sketch(self, texts: list[str]) -> np.ndarray:
        """One row of sketch keys per text; texts without words have zeros."""
        out = np.zeros((len(texts), len(self.seeds)), np.uint64)
        words, owner = self.word_hashes(texts)
        if not len(words):
            return out
        run, text = self.runs(words, owner, len(texts))
        begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        rows, sizes = text[begin], np.diff(np.append(begin, len(text)))
        own = np.repeat(np.arange(len(begin)), sizes)
        most = np.uint64(0xFFFFFFFFFFFFFFFF)
        low = np.where(sizes > ENOUGH, most // sizes.astype(np.uint64) * np.uint64(ENOUGH), most)
        low_each = low[own]
        runs = np.append(run, np.uint64(0))
        for s, seed in enumerate(self.seeds):
            value = (run ^ seed) * np.uint64(0x9FB21C651E98DF25)
            value ^= value >> np.uint64(32)
            value *= np.uint64(0x9E3779B97F4A7C15)
            at = np.flatnonzero(value <= low_each)
            few = np.flatnonzero(np.bincount(own[at], minlength=len(begin)) < np.minimum(sizes, self.picked))
            if len(few):
                at = np.sort(np.concatenate([at[~np.isin(own[at], few)], *[begin[t] + np.arange(sizes[t]) for t in few]]))
            at = at[np.lexsort((value[at], own[at]))]  # equal values stay in text order
            first = np.flatnonzero(np.concatenate([[True], own[at][1:] != own[at][:-1]]))
            rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            at, rank = at[rank < self.picked], rank[rank < self.picked]
            places = np.full((len(begin), self.picked), len(run), np.int64)  # fewer runs than picks
            places[own[at], rank] = at
            key = np.full(len(begin), seed, np.uint64)
            for where in np.sort(places, axis=1).T:  # text order
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + runs[where])
            out[rows, s] = key
        return out


def sketch_kinds(sketches: int, least: float) -> list[tuple[Callable[[int], bool], slice]]:
    """Which numbers of words have the long and the short kind of sketches, and the places of either among all sketches."""
    both = int(least * (SHORT + 1))
    return [(lambda n: n >= both, slice(0, sketches)), (lambda n: 0 < n <= SHORT, slice(sketches, sketches + SHORT_SKETCHES))]


def sketch_rows(docs: DataFrame, doc_id: Column, text: Column, sketches: int, picked: int, k: int, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, digest, keys, words): ``keys`` is NULL for a text without words, ``words`` their number.

    Texts of ``both`` to ``SHORT`` words have both kinds of sketches, so two texts that are similar have one kind in common.
    """
    kinds = sketch_kinds(sketches, least)

    def run(batches):
        long, short = Sketcher(sketches, picked, k), Sketcher(SHORT_SKETCHES, SHORT_PICKED, 1)
        for batch in batches:
            texts = [t or "" for t in column(batch, "_text")]
            at = 0
            while at < len(texts):  # about a megabyte of text at a time
                upto, held = at, 0
                while upto < len(texts) and (upto == at or held < 1 << 18):
                    held += len(texts[upto])
                    upto += 1
                words = [len(t.split()) for t in texts[at:upto]]
                keys: list[list[int] | None] = [[] if n else None for n in words]
                for sketcher, (fits, _) in zip((long, short), kinds, strict=True):
                    rows = [i for i, n in enumerate(words) if fits(n)]
                    for i, own in zip(rows, sketcher.sketch([texts[at + i] for i in rows]) if rows else (), strict=True):
                        keys[i] += own.view(np.int64).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, upto - at),
                        batch.column(1).slice(at, upto - at),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(words, pa.int32()),
                    ],
                    names=["doc_id", "digest", "keys", "words"],
                )
                at = upto

    rows = docs.select(doc_id.cast("long").alias("doc_id"), text_key(text).alias("digest"), text.cast("string").alias("_text"))
    return rows.mapInArrow(lean(run), "doc_id long, digest string, keys array<long>, words int")


# ---------------------------------------------------------------- verification


def banded_distance(a: list, b: list, k: int) -> int:
    """Edit distance of two sequences if it is at most ``k``, else ``k + 1``.

    Bit-parallel over a band of 2 k + 1 diagonals: bit t of a column j stands for row j - k + t, and the vectors hold
    the vertical differences of neighbouring rows.
    """
    if abs(len(a) - len(b)) > k:
        return k + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i = 0
    while i < min(len(a), len(b)) and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if not a or not b:
        return len(a) + len(b)
    k = min(k, max(len(a), len(b)))
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    width = 2 * k + 1
    full, top = (1 << width) - 1, 1 << (2 * k)
    up, down, distance = full ^ ((1 << k) - 1), 0, k
    for j, y in enumerate(b, 1):
        found = places.get(y, 0)
        x = (found >> (j - k - 1) if j > k else found << (k + 1 - j)) & full
        zero = ((((x & up) + up) ^ up) | x | down) & full
        right = down | (full ^ (zero | up) & full)
        left = zero & up
        distance += not zero & top
        zero >>= 1
        up = (left | (full ^ ((zero | right) & full))) & full
        down = zero & right
    t = len(a) - len(b) + k
    between = ((1 << (2 * k)) - 1) & ~((1 << t) - 1)
    distance -= (up & between).bit_count() - (down & between).bit_count()
    return min(distance, k + 1)


def edit_similarity(a: list[str], b: list[str], least: float) -> float:
    """``1 - distance / longer`` of two word lists if that is at least ``least``, else 0."""
    longer = max(len(a), len(b))
    if not longer:
        return 1.0
    k = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > k:
        return 0.0
    common = sum((Counter(a) & Counter(b)).values())
    if longer - common > k:  # each word without a partner costs an edit
        return 0.0
    d = banded_distance(a, b, k)
    return 1 - d / longer if d <= k else 0.0


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the ``pairs`` (a, b) of nodes whose ``texts`` (node, text) are similar enough."""

    def run(batches):
        for batch in batches:
            a, b = column(batch, "ta"), column(batch, "tb")
            found = [edit_similarity((x or "").lower().split(), (y or "").lower().split(), least) for x, y in zip(a, b, strict=True)]
            keep = pa.array([s > 0 for s in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"]
            ).filter(keep)

    bitmap = stage(key_bitmap(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node"), "near-pair-bits")
    texts = with_maybe(texts, bitmap, F.col("node")).where("_maybe")  # only these are shuffled
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"
    )
    return both.select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long, similarity double")


# ---------------------------------------------------------------- candidates and classes


def bucket_members(nodes: DataFrame) -> DataFrame:
    """(key, node, words) of the buckets of more than one of ``nodes`` (node, keys, words)."""
    keyed = nodes.where("keys is not null").select("node", "words", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key"), "near-buckets")
    bitmap = stage(key_bitmap(sizes, "key"), "near-bucket-bits")
    members = stage(with_maybe(keyed, bitmap, F.col("key")).where("_maybe").join(sizes, "key").select("key", "node", "words"), "near-members")
    discard(sizes, bitmap)
    return members


def far_apart(words: Column, other: Column, least: float) -> Column:
    """Whether the numbers of words alone rule the similarity out."""
    longer, shorter = F.greatest(words, other), F.least(words, other)
    return longer - shorter > F.floor((1 - least) * longer + 1e-9)


def first_links(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Verified links (a, b, similarity) of the members of each bucket to its smallest node."""
    hubs = members.groupBy("key").agg(F.min(F.struct("node", "words")).alias("h")).select("key", F.col("h.node").alias("a"), F.col("h.words").alias("a_words"))
    met = members.join(hubs, "key").where((F.col("node") != F.col("a")) & ~far_apart(F.col("words"), F.col("a_words"), least))
    pairs = stage(met.select("a", F.col("node").alias("b")).distinct(), "near-pairs")
    found = stage(verified(pairs, texts, least), "near-links")
    discard(pairs)
    return found


class Unit:
    """Rows (node, label, main, text, keys) of one bucket that are compared at a time: ``rest`` holds members outside the bucket's largest
    class, which meet those of ``whole``."""

    def __init__(self, rows: list[tuple], slots: int, at: Callable[[int], list[slice]]):
        rows = sorted(rows, key=lambda r: r[0])  # what is found doesn't depend on the rows' order
        self.node = np.array([r[0] for r in rows], np.int64)
        self.first_label = np.array([r[1] for r in rows], np.int64)
        self.label = self.first_label.copy()
        self.main = np.array([r[2] for r in rows], bool)
        self.words = [r[3].lower().split() for r in rows]
        self.size = np.array([len(w) for w in self.words])
        self.bag = Sketcher(1, 1, 1).bags([r[3] for r in rows])
        self.keys = np.zeros((len(rows), slots), np.int64)  # a sketch's keys in one column
        for i, r in enumerate(rows):
            done = 0
            for places in at(len(self.words[i])):
                n = places.stop - places.start
                self.keys[i, places] = r[4][done : done + n]
                done += n
        self.hash = _mixed(self.node.astype(np.uint64))


def unit_links(key: int, rest: Unit, whole: Unit, least: float) -> list[tuple]:
    """(a, b, similarity, label of a, label of b) of links that join the classes of a unit as comparing all its pairs would."""
    out = []
    slots = rest.keys.shape[1]
    for i in range(len(rest.node)):
        longer = np.maximum(rest.size[i], whole.size)
        most = np.floor((1 - least) * longer + 1e-9)
        meets = (whole.label != rest.label[i]) & (np.abs(whole.size - rest.size[i]) <= most) & (whole.main | (whole.node > rest.node[i]))
        near = np.flatnonzero(meets)
        if not len(near):
            continue
        # of the buckets that a pair has in common, a hash of the pair prefers one
        common = (whole.keys[near] == rest.keys[i]) & (rest.keys[i] != 0)
        turn = ((rest.hash[i] + whole.hash[near]) % np.uint64(slots)).astype(np.int64)
        place = np.where(common, (np.arange(slots) - turn[:, None]) % slots, slots).argmin(1)
        near = near[rest.keys[i, place] == key]
        more = whole.bag[near].astype(np.int16) - rest.bag[i].astype(np.int16)
        apart = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
        near = near[apart <= most[near]]
        for j in near:
            if whole.label[j] == rest.label[i]:  # a link before this one has joined them
                continue
            similarity = edit_similarity(rest.words[i], whole.words[j], least)
            if similarity:
                pair = (int(rest.node[i]), int(rest.first_label[i])), (int(whole.node[j]), int(whole.first_label[j]))
                (a, la), (b, lb) = sorted(pair)
                out.append((a, b, similarity, la, lb))
                gone, stays = whole.label[j], rest.label[i]
                for u in (rest, whole):
                    u.label[u.label == gone] = stays
    return out


def block_links(members: DataFrame, labels: DataFrame, texts: DataFrame, least: float, sketches: int) -> DataFrame:
    """Links (a, b, similarity, la, lb) that join the classes ``labels`` (node, label) as comparing all pairs of different
    classes within each bucket of ``members`` would; ``la`` and ``lb`` are the classes that a and b had."""
    labelled = stage(members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "near-labelled")
    classes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    mixed = classes.groupBy("key").agg(
        F.max(F.struct("n", "label", "w")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("classes")
    )

    def blocks(n: Column, w: Column) -> Column:
        return F.ceil(F.greatest(n / BLOCK_ROWS, w / BLOCK_WORDS)).cast("int")

    mixed = stage(
        mixed.where("classes > 1").select(
            "key",
            F.col("main.label").alias("main"),
            blocks(F.col("n"), F.col("w")).alias("all_blocks"),
            blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("rest_blocks"),
        ),
        "near-mixed",
    )
    own = stage(labelled.join(mixed, "key"), "near-unlike")
    discard(labelled, mixed)
    bitmap = stage(key_bitmap(own, "node"), "near-unlike-bits")
    wanted = with_maybe(texts, bitmap, F.col("node")).where("_maybe").select("node", "text", "keys")
    mine = F.xxhash64("node")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("rest_blocks") - 1),
        lambda r: F.struct(F.lit(False).alias("rest"), r.alias("r"), F.pmod(mine, F.col("all_blocks")).cast("int").alias("m")),
    )
    is_rest = F.transform(
        F.sequence(F.lit(0), F.col("all_blocks") - 1),
        lambda m: F.struct(F.lit(True).alias("rest"), F.pmod(mine, F.col("rest_blocks")).cast("int").alias("r"), m.alias("m")),
    )
    outside = F.col("label") != F.col("main")
    units = own.withColumn("_unit", F.when(outside, F.concat(meets, is_rest)).otherwise(meets))
    units = units.join(wanted, "node").select(
        "key", F.explode("_unit").alias("_unit"), "node", "label", (~outside).alias("main"), "text", "keys"
    )
    units = units.select("key", "_unit.r", "_unit.m", "_unit.rest", "node", "label", "main", "text", "keys")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64()), ("la", pa.int64()), ("lb", pa.int64())])
    kinds = sketch_kinds(sketches, least)

    def places(words: int) -> list[slice]:
        return [where for fits, where in kinds if fits(words)]

    def compare(table: pa.Table) -> pa.Table:
        held: dict[bool, list] = {True: [], False: []}
        columns = [table.column(c).to_pylist() for c in ("rest", "node", "label", "main", "text", "keys")]
        for is_rest, *row in zip(*columns, strict=True):
            held[is_rest].append(row)
        found = []
        if held[True] and held[False]:
            rest, whole = (Unit(held[r], sketches + SHORT_SKETCHES, places) for r in (True, False))
            found = unit_links(table.column("key")[0].as_py(), rest, whole, least)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * 5, schema)], schema=schema)

    links = units.groupBy("key", "r", "m").applyInArrow(compare, "a long, b long, similarity double, la long, lb long")
    found = stage(links, "near-links")
    discard(own)
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that verified ``links`` (a, b), a < b, connect each node to.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots and contracts the
    links to roots; links within a root go, so a group of n texts is read once, not once a round.
    """
    labels = None
    links = stage(links.select("a", "b"), "near-graph")
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("node"), F.col("a").alias("near")).unionByName(
            links.select(F.col("b").alias("node"), F.col("a").alias("near"))
        )
        hooks = hooked = stage(ends.groupBy("node").agg(F.min("near").alias("to")), "near-hooks")
        while True:  # a hook leads to a smaller node: the way to a root halves each time
            target = hooks.select(F.col("node").alias("to"), F.col("to").alias("further"))
            jumped = stage(
                hooks.join(target, "to").select("node", F.col("to").alias("old"), F.col("further").alias("to")), "near-hooks"
            )
            discard(hooked)
            hooked, hooks = jumped, jumped.select("node", "to")
            if jumped.where("to != old").isEmpty():
                break
        roots = hooks.select(F.col("node").alias("label"), F.col("to").alias("root"))
        labels = (
            hooks.select("node", F.col("to").alias("label"))
            if labels is None
            else stage(
                labels.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "near-labels"
            )
        )
        ra, rb = hooks.select(F.col("node").alias("a"), F.col("to").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        ends = links.join(ra, "a").join(rb, "b").where("ra != rb")
        links = stage(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "near-graph")
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    k: int = WORDS,
    sketches: int = SKETCHES,
    picked: int = PICKED,
) -> DataFrame:
    """One row per row of ``docs``: id, digest, class_id (smallest id of its class), class_size, n_links (of its text, to other texts)."""
    rows = stage(sketch_rows(docs, F.col(id_col), F.col(text_col), sketches, picked, k, similarity), "near-rows")
    nodes = stage(
        rows.groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys"), F.first("words").alias("words"), F.count(F.lit(1)).alias("copies"))
        .orderBy("digest")  # nodes are numbered in digest order, so the links don't depend on the partitioning
        .withColumn("node", F.monotonically_increasing_id()),
        "near-nodes",
    )
    members = bucket_members(nodes)
    wanted = stage(
        members.select("node").distinct().join(nodes.select("node", "digest", "first_id", "keys"), "node"),
        "near-wanted",
    )
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("_digest", text_key(F.col("text")))
    bitmap = stage(key_bitmap(wanted, "first_id", "digest"), "near-wanted-bits")
    own = with_maybe(own, bitmap, F.col("_id"), F.col("_digest")).where("_maybe").drop("_maybe")
    texts = stage(
        own.join(wanted, (F.col("_digest") == F.col("digest")) & F.col("_id").eqNullSafe(F.col("first_id")))
        .select("node", "text", "keys")
        .dropDuplicates(["node"]),
        "near-texts",
    )
    discard(wanted, bitmap)
    links = first_links(members, texts, similarity)
    labels = components(links)
    more = block_links(members, labels, texts, similarity, sketches)
    joined = components(more.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    labels = (
        labels.join(joined.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        # classes of one node are no rows of ``labels``
        .unionByName(joined.join(labels.select("node"), "node", "left_anti"))
    )
    links = links.unionByName(more.select("a", "b", "similarity"))
    discard(texts, members)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    labelled = stage(
        nodes.select("node", "digest", "first_id", "copies")
        .join(labels, "node", "left")
        .join(degree, "node", "left")
        .select("digest", "first_id", "copies", F.coalesce("label", "node").alias("label"), F.coalesce("links", F.lit(0)).alias("n_links")),
        "near-named",
    )
    discard(nodes)
    classes = labelled.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    classes = stage(classes, "near-class-ids")  # so that the join has two plain exchanges, which AQE can split
    named = stage(labelled.join(classes, "label").select("digest", "class_id", "class_size", "n_links"), "near-classes")
    return rows.select("doc_id", "digest").join(named, "digest").select(
        F.col("doc_id").alias(id_col), "digest", "class_id", "class_size", "n_links"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each class: the row of its smallest id (one of them if rows are repeated)."""
    classes = near_classes(docs, id_col, text_col, **how)
    alike = stage(
        classes.where("class_size > 1").groupBy(F.col(id_col).alias("_kid"), F.col("digest").alias("_kdigest"))
        .agg(F.first("class_id").alias("class_id"), F.count(F.lit(1)).alias("_n")),
        "near-alike",
    )
    # texts of a class may share its smallest id only if ids repeat; then the smallest digest stays
    best = alike.where(F.col("_kid").eqNullSafe(F.col("class_id"))).groupBy("class_id").agg(F.min("_kdigest").alias("_best"))
    decided = stage(
        alike.join(best.withColumnRenamed("class_id", "_class"), F.col("class_id").eqNullSafe(F.col("_class")), "left").withColumn(
            "_stays", F.col("_kid").eqNullSafe(F.col("class_id")) & F.col("_kdigest").eqNullSafe(F.col("_best"))
        ).select("_kid", "_kdigest", "_stays", "_n").where("not _stays or _n > 1"),
        "near-dropped",
    )
    marked = boxed(docs, _id=F.col(id_col), _digest=text_key(F.col(text_col)))
    same = F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_digest") == F.col("_kdigest"))
    bitmap = stage(key_bitmap(decided, "_kid", "_kdigest"), "near-dropped-bits")
    marked = with_maybe(marked, bitmap, F.col("_id").cast("long"), F.col("_digest"))
    kept, marked = marked.where("not _maybe"), marked.where("_maybe")
    out = kept.unionByName(marked.join(decided, same, "left_anti"))
    repeated = decided.where("_stays")
    if not repeated.isEmpty():
        out = out.unionByName(marked.join(repeated, same, "left_semi").dropDuplicates(["_id", "_digest"]))
    return out.select("_doc.*")
