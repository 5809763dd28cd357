"""Sketch keys and recall of the near-duplicate classes."""

import random

import pytest
from pyspark.sql import functions as F

from recipeflow.llm import order_minhash
from recipeflow.llm.order_minhash import PICKED, SHORT_PICKED, SHORT_SKETCHES, SKETCHES, WORDS, Sketcher
from recipeflow.session import ship_package

SYLLABLES = "ba ce di fo gu ha ke li mo nu pa re si to vu".split()
VOCABULARY = [a + b + c for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES]


def words(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


@pytest.mark.parametrize("how", [(SKETCHES, PICKED, WORDS), (SHORT_SKETCHES, SHORT_PICKED, 1)])
def test_keys_of_a_text_depend_on_nothing_else(how):
    rng = random.Random(1)
    texts = [" ".join(words(rng, n)) for n in (1, 2, 3, 5, 20, 31, 400)] + ["one one one two two", "a b a b a b a b", ""]
    sketcher = Sketcher(*how)
    alone = [sketcher.sketch([t])[0].tolist() for t in texts]
    for other in (["x y z"], ["one one two"], ["a a a a"], [" ".join(words(rng, 3000))], texts):
        for i, t in enumerate(texts):
            assert sketcher.sketch([*other, t])[-1].tolist() == alone[i]
            assert sketcher.sketch([t, *other])[0].tolist() == alone[i]


def test_few_candidates_do_not_change_a_sketch(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(words(rng, n)) for n in (5, 40, 300, 2000)]
    want = Sketcher(SKETCHES, PICKED, WORDS).sketch(texts).tolist()
    for enough in (1, 4, 100_000):  # all runs are sought where too few are low
        monkeypatch.setattr(order_minhash, "ENOUGH", enough)
        assert Sketcher(SKETCHES, PICKED, WORDS).sketch(texts).tolist() == want


def test_sketches_keep_the_text_order():
    sketcher = Sketcher(SKETCHES, 2, 1)
    there, back = sketcher.sketch(["alpha beta", "beta alpha"]).tolist()
    assert not set(there) & set(back)


BANDS = [(0.8, 0.85), (0.85, 0.9), (0.9, 0.999)]


def test_recall_by_similarity_band_across_partitions(spark):
    """Each pair of a band, edited at random, is of one class for 95 % at least; no two bases are."""
    ship_package(spark)
    rng = random.Random(3)
    rows, band_of = [], {}
    for band, (low, high) in enumerate(BANDS):
        for n in (8, 20, 28, 31, 60, 200, 600):
            for _ in range(30):
                while True:
                    a = words(rng, n)
                    b = list(a)
                    for _ in range(max(1, round(n * (1 - rng.uniform(low, high))))):
                        p, kind = rng.randrange(len(b)), rng.randrange(3)
                        b[p : p + (kind > 0)] = words(rng, 1) if kind < 2 else []
                    s = order_minhash.edit_similarity(a, b, 0.5)
                    if low <= s < high:
                        break
                    if n == 8 and band == 2:  # one edit is more than that
                        break
                if low <= s < high:
                    band_of[len(rows)] = band, n
                    rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(8, F.col("doc_id") % 2, F.col("doc_id"))
    name = {r["doc_id"]: r["class_id"] for r in order_minhash.near_classes(table).collect()}
    for band in range(len(BANDS)):
        pairs = [i for i, (own, _) in band_of.items() if own == band]
        assert sum(name[i] == name[i + 1] for i in pairs) >= 0.95 * len(pairs), BANDS[band]
    assert len({name[i] for i in band_of}) == len(band_of)


def test_clashing_columns_and_long_texts(spark):
    ship_package(spark)
    rng = random.Random(4)
    long = words(rng, 60_000)
    other = list(long)
    for p in rng.sample(range(len(long)), 3000):
        other[p] = "edited"
    rows = [(1, " ".join(long), "a"), (2, " ".join(other), "b"), (3, " ".join(reversed(long)), "c"), (4, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, digest string").withColumns(
        {c: F.lit(1) for c in ("keys", "words", "bag", "node", "label", "class_id", "_maybe", "_kid")}
    )
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_classes(table).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    left = order_minhash.drop_near_copies(table)
    assert left.columns == table.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4]


def test_blocks_of_a_bucket_join_what_all_pairs_would(spark, monkeypatch):
    """Families near the bound, in blocks of a few rows: the classes are those of all pairs that share a key."""
    ship_package(spark)
    rng = random.Random(6)
    rows = []
    for n in (26, 40, 120):
        for _ in range(2):
            base = words(rng, n)
            for _ in range(40):
                copy = list(base)
                for p in rng.sample(range(n), round(n * rng.uniform(0.05, 0.17))):
                    copy[p] = rng.choice(VOCABULARY)
                rows.append((len(rows), " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {r["doc_id"]: set(r["keys"]) for r in order_minhash.sketch_rows(table, table.doc_id, table.text, SKETCHES, PICKED, WORDS).collect()}
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in rows:
        for j, b in rows[:i]:
            if keys[i] & keys[j] and order_minhash.edit_similarity(a.split(), b.split(), 0.8):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert len({root(i) for i, _ in rows}) > 6
    for block in (512, 7):
        monkeypatch.setattr(order_minhash, "BLOCK_ROWS", block)
        got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_classes(table).collect()}
        assert got == {i: root(i) for i in got}
