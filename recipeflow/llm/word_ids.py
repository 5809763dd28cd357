"""Token ids of many texts at once, for tokenizers that work on each word alone.

``word_bpe_49k.json`` lower-cases, drops white space and cuts words by a fixed pattern before its merges, so the ids
of a text are those of its words in a row.  Texts of Latin script are cut into words with array operations, words
are looked up by a 64-bit hash and their length, and ``tokenizers`` encodes each word that is not kept yet,
many words to a call.  Texts with other characters go to ``tokenizers`` whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from tokenizers import Tokenizer

LIMIT = 0x180  # Latin script up to Extended-A
SPACE, LETTER, NUMBER, MARK, ODD = range(5)
#: What the pre-tokenizer cuts off as a word of its own after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LONGEST = 1 << 12  # longer words are left to the tokenizer


def _classes() -> tuple[np.ndarray, np.ndarray]:
    cls, low = np.full(LIMIT + 1, ODD, dtype=np.uint8), np.arange(LIMIT + 1, dtype=np.uint32)
    for i in range(LIMIT):
        c, kind = chr(i), unicodedata.category(chr(i))
        if c in "\t\n\x0b\x0c\r\x85" or kind[0] == "Z":
            cls[i] = SPACE
        elif kind[0] == "L":
            if len(c.lower()) == 1 and ord(c.lower()) < LIMIT and unicodedata.is_normalized("NFC", c):
                cls[i], low[i] = LETTER, ord(c.lower())
        else:
            cls[i] = NUMBER if kind[0] == "N" else MARK
    return cls, low


class WordIds:
    """Ids by a tokenizers file, with a table of the words met so far (kept by each Python worker)."""

    _own: dict[str, WordIds] = {}

    def __init__(self, path: str, slots: int = 1 << 21):
        self.tokenizer = Tokenizer.from_file(path)
        # a text that spells a special token out goes to the tokenizer whole, which gives it that token's id
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.classes, self.lower = _classes()
        rng = np.random.default_rng(7)
        self.mix = rng.integers(1, 1 << 63, LIMIT + 1, dtype=np.uint64) | np.uint64(1)
        self.power = rng.integers(1, 1 << 63, LONGEST, dtype=np.uint64) | np.uint64(1)
        self.slots = slots
        self.clear()

    @classmethod
    def of(cls, path: str) -> WordIds:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, dtype=np.uint64)
        self.entry = np.zeros(self.slots, dtype=np.int32)
        self.at = np.zeros(1024, dtype=np.int64)
        self.size = np.zeros(1024, dtype=np.int32)
        self.ids = np.zeros(4096, dtype="<u4")
        self.n = self.used = 0

    # ---- the tokenizer

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def encode_words(self, words: list[str], together: int = 512) -> list[np.ndarray]:
        """Ids of single words: many are encoded as one text and cut after each token that ends a word."""
        out: list[np.ndarray] = []
        groups = [words[i : i + together] for i in range(0, len(words), together)]
        for group, ids in zip(groups, self.encode([" ".join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(group):
                out += self.encode(group)
            else:
                out += np.split(ids, cuts[:-1])
        return out

    # ---- the table

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if it is not kept."""
        slot = (hashes >> np.uint64(40)).astype(np.int64) & (self.slots - 1)
        out = np.full(len(hashes), -1, dtype=np.int32)
        left = np.arange(len(hashes))
        while len(left):
            key = self.keys[slot]
            hit = key == hashes[left]
            out[left[hit]] = self.entry[slot[hit]]
            go = ~hit & (key != 0)
            left, slot = left[go], (slot[go] + 1) & (self.slots - 1)
        return out

    def add(self, hashes: np.ndarray, ids: list[np.ndarray]) -> None:
        sizes = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(ids) > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[self.n : self.n + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(ids)] = sizes
        numbers = np.arange(self.n, self.n + len(ids), dtype=np.int32)
        self.used, self.n = self.used + len(flat), self.n + len(ids)
        slot = (hashes >> np.uint64(40)).astype(np.int64) & (self.slots - 1)
        left = np.arange(len(hashes))
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]  # of several for one slot the last stays
            self.entry[slot[free]] = numbers[left[free]]
            go = self.keys[slot] != hashes[left]
            left, slot = left[go], (slot[go] + 1) & (self.slots - 1)

    # ---- texts

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text."""
        codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = np.minimum(codes, LIMIT)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        begins = np.cumsum(lengths) - lengths
        kind = self.classes[codes]
        place = np.arange(len(codes))
        start = (kind != SPACE) & ((kind == NUMBER) | np.concatenate([[True], kind[1:] != kind[:-1]]))
        low = self.lower[codes]
        self._contractions(kind, low, start)
        cut = start | (kind == SPACE)
        cuts = np.flatnonzero(cut)
        within = place - np.maximum.accumulate(np.where(cut, place, 0))
        whole = np.logical_or.reduceat((kind == ODD) | (within >= LONGEST), begins)
        for i, t in enumerate(texts):
            whole[i] |= any(s in t or s in t.lower() for s in self.special) if "<" in t or ">" in t else False
        values = self.mix[low] * self.power[np.minimum(within, LONGEST - 1)]
        sums = np.add.reduceat(values, cuts)
        sizes = np.diff(np.append(cuts, len(codes)))
        word = start[cuts]
        at, sums, sizes = cuts[word], sums[word], sizes[word]
        owner = np.searchsorted(begins, at, "right") - 1
        if whole.any():
            keep = ~whole[owner]
            at, sums, sizes, owner = at[keep], sums[keep], sizes[keep], owner[keep]
        hashes = (sums ^ (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(29)
        hashes |= np.uint64(1)  # 0 is a free slot
        entry = self.find(hashes)
        gone = np.flatnonzero(entry < 0)
        if len(gone):
            new, first = np.unique(hashes[gone], return_index=True)
            if (self.n + len(new)) * 2 > self.slots:
                self.clear()
                new, gone = np.unique(hashes, return_index=True)
                first = np.arange(len(gone))
            self._learn(new, at[gone[first]], sizes[gone[first]], low)
            entry = self.find(hashes)
        counts = self.size[entry].astype(np.int64)
        ends = np.cumsum(counts)
        take = np.repeat(self.at[entry] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        flat = self.ids[take]
        last = np.searchsorted(owner, np.arange(len(texts)), "right")
        upto = np.concatenate([[0], ends])[last]
        out = np.split(flat, upto[:-1]) if len(texts) else []
        for i in np.flatnonzero(whole):
            out[i] = self.encode([texts[i]])[0]
        return out

    def _learn(self, hashes: np.ndarray, at: np.ndarray, sizes: np.ndarray, low: np.ndarray) -> None:
        text = low.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        words = [text[a : a + n] for a, n in zip(at.tolist(), sizes.tolist(), strict=True)]
        plain = np.fromiter((w.isalpha() for w in words), dtype=bool, count=len(words))
        ids: list = [None] * len(words)
        for which, encode in ((np.flatnonzero(plain), self.encode_words), (np.flatnonzero(~plain), self.encode)):
            for i, found in zip(which.tolist(), encode([words[i] for i in which]), strict=True):
                ids[i] = found
        self.add(hashes, ids)

    @staticmethod
    def _contractions(kind: np.ndarray, low: np.ndarray, start: np.ndarray) -> None:
        """Where a word begins with an apostrophe and one of CONTRACTIONS, both are one word."""
        n = len(low)
        for p in np.flatnonzero(start & (low == ord("'"))).tolist():
            after = "".join(map(chr, low[p + 1 : min(n, p + 3)].tolist()))
            c = next((c for c in CONTRACTIONS if after.startswith(c)), None)
            if c and kind[p + 1] == LETTER:
                start[p + 1] = False
                if p + 1 + len(c) < n and kind[p + 1 + len(c)] == LETTER:
                    start[p + 1 + len(c)] = True
