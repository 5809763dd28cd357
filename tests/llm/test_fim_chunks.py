"""Fill-in-middle by memoized chunks against the plain definition."""

import hashlib
import random
import re

import pytest

from recipeflow.llm import fim_chunks
from recipeflow.session import ship_package

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
ALPHABETS = ["ab \n", "a ", " \t\n\x0b\x0c\r", "xyz", "é\u3000ñ 日\u00a0\U0001f600", "a\x1c\x1d\x1e\x1f\x85 "]


def random_text(rng):
    text = "".join(rng.choices(rng.choice(ALPHABETS), k=rng.choice([0, 1, 2, 50, 700, 9000])))
    return text + rng.choice(["", " ", "\n\n"])


def brute(doc_id, text):
    units = UNITS.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", text, None, None
    if h4 % 100 < 80:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_units_end_where_the_pattern_ends_them():
    rng, summaries = random.Random(3), fim_chunks.Summaries(1 << 14)
    for _ in range(400):
        text = random_text(rng)
        units = fim_chunks.Units(text, summaries)
        ends = [m.end() for m in UNITS.finditer(text)]
        assert units.count == len(ends)
        for k in {0, 1, len(ends) // 2, len(ends) - 1, len(ends)} | {rng.randint(0, len(ends)) for _ in range(5)}:
            if k <= len(ends):
                assert units.end(k) == (ends[k - 1] if k > 0 else 0)
    assert summaries.held <= 1 << 14 and summaries.hits


def test_chunks_cover_a_text_and_follow_its_content():
    rng = random.Random(5)
    shared = "".join(rng.choices("abcdefgh \n", k=40_000))
    for text in (shared, "x" * 30_000, "", "a"):
        ends = list(fim_chunks.chunk_ends(text))
        assert (ends[-1] if ends else 0) == len(text)
        sizes = [b - a for a, b in zip([0, *ends], ends)]
        assert all(0 < s <= fim_chunks.MOST for s in sizes)
        assert all(s >= fim_chunks.LEAST for s in sizes[:-1])
    def pieces(t):
        ends = list(fim_chunks.chunk_ends(t))
        return {t[a:b] for a, b in zip([0, *ends], ends)}
    moved = pieces("".join(rng.choices("abcdefgh ", k=333)) + shared)
    assert len(pieces(shared) & moved) >= len(pieces(shared)) - 4  # shared chunks are found at another place


def test_segments_do_not_change_the_cuts(monkeypatch):
    text = "".join(random.Random(9).choices("abcdefgh \n", k=50_000))
    whole = list(fim_chunks.chunk_ends(text))
    monkeypatch.setattr(fim_chunks, "SEGMENT", 777)
    assert list(fim_chunks.chunk_ends(text)) == whole


def test_summaries_compare_content():
    class Same(str):
        def __hash__(self):
            return 1

    summaries = fim_chunks.Summaries()
    assert summaries.of(Same("a b c ")) == (3, False, False)
    assert summaries.of(Same(" a b")) == (1, True, True)  # equal hash, other content


@pytest.fixture(scope="module")
def texts(spark):
    ship_package(spark)
    rng = random.Random(1)
    rows = [(i, random_text(rng), "k", 1) for i in range(150)]
    rows += [(500, None, None, None), (501, "", "k", 1), (None, "no id here", "k", 1), (7, rows[7][1], "again", 2), (7, rows[7][1], "again", 2)]
    rows += [(600 + i, f"with {m} inside", "m", 0) for i, m in enumerate(["<P>", "<S>", "<M>"] * 4)]
    rows += [(700 + i, "almost <S <P< M> <" + "< <P <" * i, "m", 0) for i in range(40)]
    rows += [(800, "".join(rng.choices("word \n", k=700_000)), "long", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, output string, n int")


def test_fim_texts(texts):
    from pyspark.sql import functions as F

    made = fim_chunks.fim_texts(texts).withColumn("restored", fim_chunks.restored_text(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    want = []
    for r in texts.collect():
        n, form, output, p, m = brute(r["doc_id"], r["text"] or "")
        want.append((r["doc_id"], n, form, output, p, m, r["text"] or ""))
    assert got == sorted(want, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_markers_that_pieces_complete_leave_a_text_plain(texts):
    got = fim_chunks.fim_texts(texts, fim_percent=100, markers=("ab", "bc", "ca")).select("output", "form").collect()
    for r in got:
        if r["form"] != "plain":
            assert all(r["output"].count(m) == 1 for m in ("ab", "bc", "ca"))


def test_empty_table(texts):
    assert fim_chunks.fim_texts(texts.where("false")).count() == 0
