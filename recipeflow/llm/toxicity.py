"""Toxicity by a lexicon that tolerates misspellings, with context windows.

* The lexicon is learned from labelled rows: words that toxic rows use far more often than chance, near copies
  counting once.
* A trie of the lexicon is intersected with Levenshtein automata and made deterministic: one table that maps (state,
  character) to a state.  A term of ``FUZZY_FROM`` letters or more is met at one edit: a character substituted, inserted or left
  out, or two neighbours swapped; a term of ``SHORT_FROM`` at one substitution or swap; shorter ones match exactly.  All words of
  many texts run through it side by side, one character at a time; a word leaves at its first dead state.
* A misspelling is a word of its own, and does not count, unless ``PURITY`` of the labelled witnesses that use it are toxic; a clean
  row that only quotes it is no witness against it.  A term whose other misspellings fail the same test matches exactly.
  Such exceptions are strings at one edit from a term, so their number is bounded by the lexicon.
* Each match is weighed by a window of ``WINDOW`` characters on both sides: between quotation marks or after a reporting
  word it is a mention and counts ``QUOTED``; near a second person it counts ``AIMED``.
* A text's score is a logistic function of its weighed matches (exact, misspelt, misspelt short terms), fitted to the
  labelled rows; a kind of misspelling that fewer than ``EVIDENCE`` of them hold is worth ``MISSPELT`` of an exact match.

Labels, lang, source and ids are never inputs of a score.  Defined results: NULL and empty texts score like any text without a match;
NULL labels are not learned from; without labelled rows of both kinds nothing is toxic; an empty table gives an empty result;
repeated rows are scored alike; other columns are kept or ignored as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recipeflow.llm.common import (
    basic_plane,
    boxed,
    code_points,
    column,
    lean,
    letter_table,
    lower_table,
    segments,
)
from recipeflow.session import stage

FUZZY_FROM, SHORT_FROM = 5, 4
PURITY, EVIDENCE, MISSPELT = 0.8, 10, 0.8
KINDS = 3  # of matches: exact, misspelt, misspelt short term
WINDOW = 48
QUOTED, AIMED = 0.25, 1.25
QUOTES = "\"“”„«»‹›"
#: Words that report speech or point at the reader, in the languages of the lexicon's texts.
REPORTING = ("said", "says", "called", "quoted", "quote", "wrote", "term", "word", "dijo", "dit", "sagte", "schrieb")
SECOND_PERSON = ("you", "your", "youre", "du", "dich", "dir", "tu", "te", "toi", "vous", "usted", "eres", "es-tu")
#: Bound of the labelled rows that the lexicon is chosen on and the score is fitted to (all are used up to it).
FIT_ROWS = 20_000

# ---------------------------------------------------------------- the automaton


@dataclass
class Automaton:
    """Deterministic: ``step[state, class]``, 0 is dead, 1 the start; ``term[state]`` is the matched term or -1,
    ``edits[state]`` 0 if it is exact, 1 if it is misspelt, 2 if it is a misspelt term of fewer than ``FUZZY_FROM`` letters."""

    classes: np.ndarray  # code point -> class, 0 for characters of no term
    step: np.ndarray
    term: np.ndarray
    edits: np.ndarray


def build_automaton(terms: list[str]) -> Automaton:
    """Subset construction over (trie node, what was edited, awaited letter).

    Nothing was edited (``NONE``), a character was substituted or swapped (``SAME``, the length is kept) or inserted or left out
    (``OTHER``).  Behind the first letter of a swap the second is awaited, and the node is the one behind both.
    """
    NONE, SAME, OTHER = 0, 1, 2
    letters = sorted({c for t in terms for c in t})
    classes = np.zeros(1 << 16, dtype=np.uint8 if len(letters) < 255 else np.uint16)
    for i, c in enumerate(letters, 1):
        if ord(c) < 1 << 16:
            classes[ord(c)] = i
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    reach: list[int] = [0]  # longest term below a node
    for number, t in enumerate(terms):
        at = 0
        reach[0] = max(reach[0], len(t))
        for c in t:
            k = letters.index(c) + 1
            if k not in children[at]:
                children[at][k] = len(children)
                children.append({})
                ends.append(-1)
                reach.append(0)
            at = children[at][k]
            reach[at] = max(reach[at], len(t))
        ends[at] = number
    fuzzy = [n >= FUZZY_FROM for n in reach]
    short = [n >= SHORT_FROM for n in reach]
    Item = tuple[int, int, int]

    def closed(items: set[Item]) -> frozenset[Item]:
        out = set(items)
        for node, e, awaited in items:
            if e == NONE:
                out.update((child, OTHER, 0) for child in children[node].values() if fuzzy[child])  # left out
        # what fewer or better edits reach as well adds nothing
        return frozenset((n, e, w) for n, e, w in out if w or not any((n, less, 0) in out for less in range(e)))

    def after(state: frozenset[Item], k: int) -> frozenset[Item]:
        out: set[Item] = set()
        for node, e, awaited in state:
            if awaited:
                if k == awaited:
                    out.add((node, SAME, 0))
                continue
            if k in children[node]:
                out.add((children[node][k], e, 0))
            if e != NONE:
                continue
            if fuzzy[node]:
                out.add((node, OTHER, 0))  # inserted
            for x, child in children[node].items():
                if x != k and short[child]:
                    out.add((child, SAME, 0))  # substituted
                    if k in children[child] and short[children[child][k]]:
                        out.add((children[child][k], SAME, x))  # swapped
        return closed(out)

    def match(state: frozenset[Item]) -> tuple[int, int]:
        """(kind, term) of the best match that ends here."""
        found = []
        for node, e, awaited in state:
            if ends[node] >= 0 and not awaited:
                size = len(terms[ends[node]])
                if e == NONE or size >= FUZZY_FROM:
                    found.append((min(e, 1), ends[node]))
                elif e == SAME and size >= SHORT_FROM:
                    found.append((2, ends[node]))
        return min(found, default=(0, -1))

    start = closed({(0, NONE, 0)})
    number = {frozenset(): 0, start: 1}
    order, rows = [frozenset(), start], []
    for state in order:
        row = []
        # a letter that no item of the state names is like any other
        named = {x for n, _, w in state for x in ({w} if w else children[n])}
        named |= {x for n, e, w in state if not w and e == NONE for c in children[n].values() for x in children[c]}
        rest = None
        for k in range(len(letters) + 1):
            if k in named:
                nxt = after(state, k)
            else:
                rest = after(state, 0) if rest is None else rest
                nxt = rest
            if nxt not in number:
                number[nxt] = len(order)
                order.append(nxt)
            row.append(number[nxt])
        rows.append(row)
    best = [match(s) for s in order]
    return Automaton(
        classes,
        np.array(rows, dtype=np.int32),
        np.array([t for _, t in best], dtype=np.int32),
        np.array([e for e, _ in best], dtype=np.int8),
    )


class Scanner:
    """Finds the lexicon in texts; ``spared`` are spellings that do not count, ``exact`` terms whose misspellings don't."""

    def __init__(self, terms: list[str], spared: set[str], exact: set[str] = frozenset()):
        self.terms, self.spared, self.exact = terms, spared, exact
        self.automaton = build_automaton(terms)
        self.lengths = (min(map(len, terms), default=1) - 1, max(map(len, terms), default=0) + 1)
        self.letters, self.lower = letter_table(), lower_table()
        digits = np.zeros(1 << 16, dtype=bool)
        digits[48:58] = True
        self.inside = (self.letters > 0) | digits
        self.quotes = np.zeros(1 << 16, dtype=bool)
        self.quotes[[ord(c) for c in QUOTES]] = True
        self.glue = np.zeros(1 << 16, dtype=bool)  # part of a word between two letters
        self.glue[[ord(c) for c in "@$*"]] = True

    def words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = self.inside[codes]
        between = np.zeros_like(inside)
        between[1:-1] = self.glue[codes[1:-1]] & inside[:-2] & inside[2:]
        inside |= between
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        return edge[::2], edge[1::2]

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, term, edits) of the words that match, over lower-cased code points."""
        a = self.automaton
        begin, end = self.words(codes)
        size = end - begin
        fit = (size >= self.lengths[0]) & (size <= self.lengths[1])
        begin, size = begin[fit], size[fit]
        state = np.ones(len(begin), dtype=np.int32)
        alive, kinds = np.arange(len(begin)), a.classes[codes]
        for p in range(self.lengths[1]):
            now = alive[size[alive] > p]
            if not len(now):
                break
            state[now] = a.step[state[now], kinds[begin[now] + p]]
            alive = now[state[now] > 0]
        # a word that ended keeps its state; a dead one has state 0, which matches nothing
        hit = np.flatnonzero(a.term[state] >= 0)
        begin, size, state = begin[hit], size[hit], state[hit]
        return begin, begin + size, a.term[state], a.edits[state]

    def weighed(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple]]]:
        """Per text: sums of the weights of exact, misspelt and misspelt short matches, and the matches (start, end, term, edits, weight)."""
        total = np.zeros((len(texts), KINDS))
        spans: list[list[tuple]] = [[] for _ in texts]
        for group in segments(texts, overlap=WINDOW + self.lengths[1]):
            codes, begins = code_points([s.text for s in group])
            codes = self.lower[basic_plane(codes)]
            begin, end, term, edits = self.matches(codes)
            owner = np.searchsorted(begins, begin, "right") - 1
            for b, e, t, d, o in zip(*(x.tolist() for x in (begin, end, term, edits, owner)), strict=True):
                s = group[o]
                at = s.start + b - int(begins[o])
                if not s.core <= at < s.core_end:
                    continue
                spelled = "".join(map(chr, codes[b:e].tolist()))
                if d and (spelled in self.spared or self.terms[t] in self.exact):
                    continue
                lo, hi = int(begins[o]), int(begins[o]) + len(s.text)
                w = self.context(codes, max(lo, b - WINDOW), b, e, min(hi, e + WINDOW))
                total[s.row, d] += w
                spans[s.row].append((at, at + e - b, self.terms[t], min(d, 1), w))
        return total, spans

    def context(self, codes: np.ndarray, lo: int, b: int, e: int, hi: int) -> float:
        before = "".join(map(chr, codes[lo:b].tolist()))
        after = "".join(map(chr, codes[e:hi].tolist()))
        marks_before = sum(before.count(c) for c in QUOTES)
        quoted = marks_before % 2 == 1 and any(c in after for c in QUOTES)
        reported = not quoted and any(w in before.split()[-3:] for w in REPORTING)
        if quoted or reported:
            return QUOTED
        near = {w.strip(".,!?;:") for w in before.split()[-4:] + after.split()[:4]}
        return AIMED if near & set(SECOND_PERSON) else 1.0


# ---------------------------------------------------------------- learning


@dataclass
class Model:
    terms: list[str]
    spared: set[str]
    slopes: tuple[float, ...]
    base: float
    exact: set[str] = frozenset()

    def scores(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.base + saturated(total) @ np.array(self.slopes))))


def saturated(total: np.ndarray) -> np.ndarray:
    """One plain match is nearly as telling as many; a quoted one is not."""
    return 1 - np.exp(-2 * total)


def _words(text):
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{3,})"), F.lit(1)))


SIGNATURES, AGREE = 24, 0.6


def _witnesses(sample: DataFrame) -> DataFrame:
    """``sample`` (row, toxic, words; of bounded size) with ``witness``: near copies are one witness.

    Rows that agree in three of their ``SIGNATURES`` minimum word hashes and in ``AGREE`` of all are near copies.
    """
    mins = [F.array_min(F.transform("words", lambda w, i=i: F.xxhash64(w, F.lit(i)))) for i in range(SIGNATURES)]
    rows = sample.select("row", F.array(*mins).alias("s")).collect()
    sigs = np.array([[x or 0 for x in r["s"]] for r in rows], dtype=np.int64).reshape(len(rows), SIGNATURES)
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for b in range(0, SIGNATURES, 3):
        first: dict[bytes, int] = {}
        for i in range(len(rows)):
            j = first.setdefault(sigs[i, b : b + 3].tobytes(), i)
            if j != i and root(i) != root(j) and (sigs[i] == sigs[j]).mean() >= AGREE:
                parent[root(i)] = root(j)
    named = [(r["row"], root(i)) for i, r in enumerate(rows)]
    table = sample.sparkSession.createDataFrame(named, "row long, witness long")
    return sample.join(F.broadcast(table), "row")


def learn_lexicon(sample: DataFrame, surprise: float = 16.0, purity: float = PURITY) -> list[str]:
    """Words of ``sample`` (witness, toxic, words) that toxic witnesses use far more often than chance.

    A word is a term if at least ``purity`` of its witnesses are toxic and the likelihood-ratio of that, against the
    overall rate, is at least ``surprise`` nats; their number is bounded by that of the sample's witnesses.
    """
    sides = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.countDistinct("witness").alias("n")).collect()}
    bad, good = sides.get(1, 0), sides.get(0, 0)
    if not bad or not good:
        return []
    rate = bad / (bad + good)
    words = sample.select("witness", "toxic", F.explode("words").alias("word")).distinct()
    n, k = F.col("n"), F.col("k")
    share = k / n
    other = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    gain = n * (share * F.log(share / rate) + other)
    counted = words.groupBy("word").agg(F.sum("toxic").alias("k"), F.count(F.lit(1)).alias("n"))
    kept = counted.where((share >= purity) & (share > rate) & (gain >= surprise))
    return sorted(r["word"] for r in kept.select("word").collect())


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Logistic regression with a small ridge, by Newton steps; slopes are not negative, and a kind of misspelling
    (a column but the first) with little evidence has its share of the first slope."""
    if not len(x) or y.min() == y.max():
        return (0.0,) * KINDS, -5.0
    rare = [j for j in range(1, x.shape[1]) if (x[:, j] > 0).sum() < EVIDENCE]
    x = x.copy()
    for j in rare:
        x[:, 0] += MISSPELT * x[:, j]
    use = [j for j in range(x.shape[1]) if j not in rare]
    while True:
        a = np.concatenate([x[:, use], np.ones((len(x), 1))], 1)
        w, ridge = np.zeros(a.shape[1]), np.diag([0.5] * len(use) + [0.01])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        if (w[:-1] >= 0).all():
            slopes = dict(zip(use, w[:-1].tolist(), strict=True))
            first = slopes.get(0, 0.0)
            return tuple(MISSPELT * first if j in rare else slopes.get(j, 0.0) for j in range(x.shape[1])), float(w[-1])
        use = [j for i, j in enumerate(use) if w[i] >= 0]


def _own_words(uses: dict[str, tuple[set[int], set[int]]]) -> set[str]:
    """What clean witnesses (first) use, unless ``PURITY`` of all that use it are toxic (second)."""
    return {name for name, (clean, toxic) in uses.items() if clean and len(toxic) < PURITY * (len(clean) + len(toxic))}


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Model from the texts of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) covers.

    At most ``fit_rows`` labelled ids, chosen by a hash of the id, are learned from; only their texts are moved.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    share = min(1.0, 1.2 * fit_rows / max(1, rows.count()))
    h = F.xxhash64("doc_id")
    chosen = rows.where(F.pmod(h, F.lit(1_000_003)) < share * 1_000_003).orderBy(h, "doc_id", "toxic").limit(fit_rows)
    chosen = stage(chosen.distinct(), "toxic-chosen")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic").distinct()  # at most fit_rows ids
    sample = stage(
        sample.select("text", "toxic", _words(F.col("text")).alias("words"), F.monotonically_increasing_id().alias("row")),
        "toxic-labelled",
    )
    sample = stage(_witnesses(sample), "toxic-witnesses")
    terms = learn_lexicon(sample)
    if not terms:
        return Model([], set(), (0.0,) * KINDS, -5.0)
    scanner = Scanner(terms, set())

    def scan(batches):
        for batch in batches:
            texts = column(batch, "text")
            total, spans = scanner.weighed(texts)
            near = [[t[m[0] : m[1]].lower() for m in s if m[3]] for t, s in zip(texts, spans, strict=True)]
            meant = [[m[2] for m in s if m[3]] for s in spans]
            weights = [[m[4] for m in s if m[3]] for s in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(total[:, 0]), pa.array(near, pa.list_(pa.string())),
                    pa.array(meant, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64())),
                ],
                names=["toxic", "witness", "exact", "near", "meant", "weights"],
            )

    found = sample.select("toxic", "witness", "text").mapInArrow(
        lean(scan),
        "toxic int, witness long, exact double, near array<string>, meant array<string>, weights array<double>",
    ).collect()  # a few numbers for each row of the bounded sample
    matches = [list(zip(r["near"], r["meant"], r["weights"], strict=True)) for r in found]

    def uses(rows, name) -> dict[str, tuple[set[int], set[int]]]:
        """Clean and toxic witnesses by ``name`` of a match; clean quotations are none."""
        out: dict[str, tuple[set[int], set[int]]] = {}
        for i in rows:
            r = found[i]
            for m in matches[i]:
                if r["toxic"] or m[2] > QUOTED:
                    out.setdefault(name(m), (set(), set()))[r["toxic"]].add(r["witness"])
        return out

    # What misspellings are worth is judged crosswise: each half of the witnesses with the spellings spared by the other half.
    everyone = range(len(found))
    spared = [_own_words(uses([i for i in everyone if found[i]["witness"] % 2 == half], lambda m: m[0])) for half in (0, 1)]
    matches = [[m for m in ms if m[0] not in spared[1 - r["witness"] % 2]] for ms, r in zip(matches, found, strict=True)]
    exact = _own_words(uses(everyone, lambda m: m[1]))
    x = np.zeros((len(found), KINDS))
    for i, r in enumerate(found):
        x[i, 0] = r["exact"]
        for _, term, weight in matches[i]:
            if term not in exact:
                x[i, 1 if len(term) >= FUZZY_FROM else 2] += weight
    slopes, base = _fit(saturated(x), np.array([float(r["toxic"]) for r in found]))
    return Model(terms, spared[0] | spared[1], slopes, base, exact)


# ---------------------------------------------------------------- scoring


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` as struct ``_doc`` with ``score`` and ``matches`` (start, end, term, edits, weight)."""
    scanner = Scanner(model.terms, model.spared, model.exact)
    parts = (("start", T.LongType()), ("end", T.LongType()), ("term", T.StringType()), ("edits", T.IntegerType()), ("weight", T.DoubleType()))
    kind = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in parts]))
    names = [n for n, _ in parts]
    rows = boxed(docs)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("matches", kind)])
    arrow = pa.list_(
        pa.struct(
            [("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("weight", pa.float64())]
        )
    )

    def run(batches):
        for batch in batches:
            texts = batch.column(0).field(text_col).to_pylist()
            total, spans = scanner.weighed(texts)
            found = [[dict(zip(names, m, strict=True)) for m in s] for s in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.scores(total), pa.float64()), pa.array(found, arrow)],
                names=["_doc", "score", "matches"],
            )

    return rows.mapInArrow(lean(run), schema)
