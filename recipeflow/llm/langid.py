"""Language identification by n-gram filters that hold a bitmask of languages.

Training collects, per language, the character n-grams that are common in it.  All languages share one bit-sliced Bloom
filter: each of its ``slots`` holds one bit per language, in as many 64-bit words as that takes, an n-gram sets its language's bit in ``hashes`` slots,
and the AND of those slots answers at once which languages contain an n-gram.

A text is scored by counting, per language, its n-grams that the filter claims.  A filter of which a share f of
the slots is set claims a strange n-gram with probability f ** hashes; the counts are corrected for that.  The language
with the most corrected hits wins.

Only text and language of the training rows are learned from.  Defined results: NULL texts and texts without a letter are
``und`` with score 0; texts are padded with a space at both ends; a text with letters but no n-gram (a single letter, or letters
beyond the basic plane alone) tells the languages apart by nothing, so all score 0; equal scores go to
the language that comes first by name; without training rows everything is ``und``; an empty table gives an
empty result; repeated rows get equal answers; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recipeflow.llm.common import basic_plane, code_points, column, lean, letter_table, lower_table, segments
from recipeflow.session import stage

#: Bound of the texts that a language's n-grams are learned from.
FIT_TEXTS = 1_000


@dataclass
class Filters:
    """``words[slot, i // 64]``: bit ``i % 64`` is set for language i."""

    languages: list[str]
    words: np.ndarray
    wrong: np.ndarray  # probability that a language claims an n-gram that it doesn't hold
    size: int
    hashes: int

    def claims(self, grams: np.ndarray) -> np.ndarray:
        """Bitmask of the languages that claim each n-gram."""
        out = self.words[slot_of(grams, 0, len(self.words))]
        for i in range(1, self.hashes):
            out = out & self.words[slot_of(grams, i, len(self.words))]
        return out


MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def slot_of(grams: np.ndarray, i: int, slots: int) -> np.ndarray:
    """The i-th of a gram's slots; ``slots`` is a power of two."""
    return ((grams * np.uint64(MIX[i])) >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)


class Grams:
    """n-grams of lower-cased texts as 64-bit numbers; every run of what is no letter is read as one space."""

    def __init__(self, size: int):
        self.size = size
        self.lower, self.letters = lower_table(), letter_table()

    def of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(grams, index of the piece of each, letters per piece)."""
        codes, begins = code_points([" " + p + " " for p in pieces])
        codes = self.lower[basic_plane(codes)]
        letter = self.letters[codes] > 0
        codes = np.where(letter, codes, np.uint32(32))
        owner = np.repeat(np.arange(len(pieces)), np.diff(np.append(begins, len(codes))))
        per_piece = np.bincount(owner, weights=letter, minlength=len(pieces))
        keep = letter | np.concatenate([[True], letter[:-1] | (owner[1:] != owner[:-1])])
        codes, owner = codes[keep].astype(np.uint64), owner[keep]
        n = len(codes) - self.size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), per_piece
        gram = codes[:n].copy()
        for j in range(1, self.size):
            gram = (gram << np.uint64(16)) | codes[j : j + n]
        one = owner[:n] == owner[self.size - 1 :]
        return gram[one], owner[:n][one], per_piece


def train(
    labelled: DataFrame,
    size: int = 4,
    slots: int = 1 << 20,
    hashes: int = 3,
    fit_texts: int = FIT_TEXTS,
    least: int = 3,
) -> Filters:
    """Filters from ``labelled`` (text, lang).

    Learned from at most ``fit_texts`` whole texts a language, chosen by a hash of the text; n-grams seen at least
    ``least`` times are kept.  (A bounded fit, the bound being a parameter; prediction covers all texts.)
    """
    rows = labelled.where("text is not null and lang is not null").select("lang", "text")
    totals = stage(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langid-languages")
    names = sorted(r["lang"] for r in totals.collect())
    words = np.zeros((slots, max(1, -(-len(names) // 64))), dtype=np.uint64)
    if not names:
        return Filters([], words, np.zeros(0), size, hashes)
    h = F.xxhash64("text")
    # about fit_texts of each language, by hash, and exactly as many at most: one pass for all languages
    share = F.least(F.lit(1.0), 1.3 * fit_texts / F.col("n"))
    near = rows.join(F.broadcast(totals), "lang").where(F.pmod(h, F.lit(1_000_003)) < share * 1_000_003)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(h, "text"))
    sample = near.withColumn("_place", place).where(F.col("_place") <= fit_texts).select("lang", "text")
    sample = stage(sample, "langid-sample")
    grams = Grams(size)

    def count(batches):
        for batch in batches:
            lang, text = np.array(column(batch, "lang")), column(batch, "text")
            for name in np.unique(lang):
                for group in segments([t for t, k in zip(text, lang, strict=True) if k == name]):
                    got, _, _ = grams.of([s.text for s in group])
                    kind, n = np.unique(got.view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([str(name)] * len(kind)), "gram": kind, "n": n})

    counts = sample.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = counts.where(F.col("n") >= least).select("lang", "gram").toPandas()  # of a bounded sample
    for i, name in enumerate(names):
        g = kept.gram[kept.lang == name].to_numpy().view(np.uint64)
        for k in range(hashes):
            np.bitwise_or.at(words[:, i // 64], slot_of(g, k, slots), np.uint64(1 << i % 64))
    wrong = np.array([np.mean((words[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) ** hashes for i in range(len(names))])
    return Filters(names, words, wrong, size, hashes)


PREDICTED = "doc_id long, lang_pred string, score double"


def _predict(shared):
    def run(batches):
        filters: Filters = shared.value
        grams = Grams(filters.size)
        for batch in batches:
            texts = column(batch, "_text")
            hits = np.zeros((len(texts), max(1, len(filters.languages))))
            seen, letters = np.zeros(len(texts)), np.zeros(len(texts))
            for group in segments(texts):
                # a segment after the first also reads the n - 1 characters before it
                pieces = [texts[s.row][max(0, s.core - filters.size + 1) : s.core_end] if s.core else s.text for s in group]
                found, owner, n_letters = grams.of(pieces)
                rows = np.array([s.row for s in group])
                np.add.at(letters, rows, n_letters)
                if not len(found):
                    continue
                np.add.at(seen, rows, np.bincount(owner, minlength=len(group)))
                mask = filters.claims(found)
                for i in range(len(filters.languages)):
                    bit = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                    np.add.at(hits[:, i], rows, np.bincount(owner, weights=bit, minlength=len(group)))
            out, score = [], []
            for i in range(len(texts)):
                if not filters.languages or not (letters[i] or any(c.isalpha() for c in texts[i] or "")):
                    out.append("und")
                    score.append(0.0)
                    continue
                true = np.clip((hits[i] / max(seen[i], 1) - filters.wrong) / np.maximum(1 - filters.wrong, 1e-9), 0, 1)
                best = int(np.argmax(true))
                out.append(filters.languages[best])
                score.append(float(true[best]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, filters: Filters, doc_id: Column, text: Column) -> DataFrame:
    """(doc_id, lang_pred, score) for each row; the filters (``slots`` bits a language, in whole words) are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    return docs.select(doc_id.cast("long").alias("doc_id"), text.cast("string").alias("_text")).mapInArrow(
        lean(_predict(shared)), PREDICTED
    )
