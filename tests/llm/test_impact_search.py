"""Ranked search against scores of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from recipeflow.llm import impact_search
from recipeflow.session import ship_package

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return Counter(TERM.findall((text or "").translate(UPPER)))


def brute(docs, items, top=20):
    counts = [(i, terms_of(t)) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = set()
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 75 + (25 * c.total() * n_docs) // n_terms
            s = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t, q in terms_of(text).items()
                if t in c
            )
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out |= {(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)}
    return out


def test_terms():
    text = "Ab-cd_é9É\u00a0İ \x00x\x7fY`z[Q] İ\n日本"
    assert {t.decode(): n for t, n in impact_search.count_terms(text).items()} == dict(terms_of(text))


def test_terms_of_a_long_text_are_not_cut(monkeypatch):
    text = " ".join("w" * (1 + i % 70) for i in range(3000))
    monkeypatch.setattr(impact_search, "PIECE", 50)
    assert {t.decode(): n for t, n in impact_search.count_terms(text).items()} == dict(terms_of(text))


def test_nra_equals_full_sums(monkeypatch):
    rng = np.random.default_rng(3)
    reads = []
    for trial in range(300):
        docs, top = int(rng.integers(1, 900)), int(rng.integers(1, 25))
        lists, sums = [], np.zeros(docs, np.int64)
        for _ in range(int(rng.integers(1, 9))):
            own = rng.permutation(docs)[: int(rng.integers(0, docs + 1))]
            gain = np.sort(rng.integers(1, [3, 1000][trial % 2], len(own)))[::-1].astype(np.int64)
            lists.append((own, gain))
            sums[own] += gain
        floor = int(rng.integers(1, max(2, sums.max() + 1)))
        near, scores = impact_search.nra(lists, docs, top, floor)
        last = max(floor, 1, np.sort(sums)[::-1][min(top, docs) - 1])
        assert dict(zip(near.tolist(), scores.tolist())) == {d: s for d, s in enumerate(sums.tolist()) if s >= last}
        reads.append(len(near))
    assert reads


def test_nra_stops_before_the_lists_end():
    class Counted(np.ndarray):
        read = 0

        def __getitem__(self, key):
            if isinstance(key, slice):
                Counted.read += len(range(*key.indices(len(self))))
            return np.asarray(self)[key]

    gain = np.concatenate([np.full(30, 1000), np.full(100_000, 1)]).astype(np.int64)
    lists = [(np.arange(100_030).view(Counted), gain)] * 2
    near, scores = impact_search.nra(lists, 100_030, 20, 1)
    assert set(near) == set(range(30)) and set(scores) == {2000} and Counted.read < 1000


@pytest.fixture(scope="module")
def tables(spark):
    ship_package(spark)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["É", "été", "Zed"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 30, 200])))) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)]  # ties
    docs += [(2000, None), (2001, ""), (2002, "... \n"), (None, docs[9][1]), (9, docs[9][1]), (3000, " ".join(rng.choices(words, k=60_000)))]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12])))) for i in range(40)]
    items += [(50, None), (51, "unknown terms only"), (52, ""), (53, items[0][1]), (0, items[0][1]), (54, docs[5][1]), (1, "w3 w3 w3 w40"), (None, "w7 zed")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, terms string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return docs, items, d.repartition(4), q


@pytest.mark.parametrize("block", [1 << 14, 37])
@pytest.mark.parametrize("held", [1 << 17, 30])
def test_search(tables, monkeypatch, block, held):
    docs, items, d, q = tables
    monkeypatch.setattr(impact_search, "QUERY_TERMS", held)
    got = [tuple(r) for r in impact_search.search(d, q, block_docs=block).select("item_id", "rank", "doc_id", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items)


def test_empty_tables(tables):
    _, _, d, q = tables
    assert impact_search.search(d.where("false"), q).count() == 0
    assert impact_search.search(d, q.where("false")).count() == 0
    assert impact_search.search(d.where("text = ''"), q).count() == 0
