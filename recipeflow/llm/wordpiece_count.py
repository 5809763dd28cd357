"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenising takes, again and again, the longest vocabulary entry that the rest of a word
starts with.  Its number of pieces follows without building one: the vocabulary is a trie; each trie node has
a failure link, the node that stands for what remains after the longest entries were popped from its string,
and the number of entries popped on the way.  A word is read once; where the trie has no edge, the popped
number is added and the link followed.  The work is linear in the word, backtracking included.

Words of many texts run side by side, one byte at a time, with array operations.

Rule of words (bytes of the lower-cased UTF-8 text): a run of ASCII letters and non-ASCII bytes; each digit alone; a run of
other characters that are no ASCII white space.  The vocabulary must hold every single byte, so every word can be cut.

Defined results: NULL, empty and blank texts have 0 words and 0 tokens; repeated rows are counted each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recipeflow.llm.common import batch_of, column, lean

#: Words up to this many bytes run side by side, longer ones alone.
SIDE_BY_SIDE = 64
SPACE = b" \t\n\x0b\x0c\r"


def byte_symbols() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str, word_end: str = "</w>") -> list[bytes]:
    """Distinct byte strings of a byte-level tokenizer file, without the mark of a word's end; special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {t["content"] for t in file.get("added_tokens", [])}
    symbols = byte_symbols()
    return sorted(
        {bytes(symbols[c] for c in t.removesuffix(word_end)) for t in file["model"]["vocab"] if t not in special} - {b""}
    )


class LongestMatch:
    """Trie of ``vocabulary`` with failure links and popped numbers."""

    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        entry = [False]
        for word in vocabulary:
            at = 0
            for c in word:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    entry.append(False)
                at = children[at][c]
            entry[at] = True
        missing = [c for c in range(256) if c not in children[0] or not entry[children[0][c]]]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        fail, popped = [0] * len(children), [0] * len(children)
        level = [0]
        while level:  # by length: a link leads to a shorter string
            below = []
            for u in level:
                for c, v in children[u].items():
                    if entry[v]:
                        popped[v] = 1
                    else:
                        z, n = fail[u], popped[u]
                        while c not in children[z]:
                            n, z = n + popped[z], fail[z]
                        fail[v], popped[v] = children[z][c], n
                    below.append(v)
            level = below
        self.children = children
        self.fail, self.popped = np.array(fail, dtype=np.int32), np.array(popped, dtype=np.int32)
        bits = max(10, int(len(children) * 2.5).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.keys, self.to = np.full(1 << bits, -1, dtype=np.int32), np.zeros(1 << bits, dtype=np.int32)
        keys = np.array([u << 8 | c for u, edges in enumerate(children) for c in edges], dtype=np.int32)
        to = np.array([v for edges in children for v in edges.values()], dtype=np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]], self.to[slot[free]] = keys[left[free]], to[left[free]]
            go = self.keys[slot] != keys[left]
            left, slot = left[go], (slot[go] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint32) * np.uint32(2654435769)) >> self.shift).astype(np.int64)

    def follow(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Node behind each edge, -1 where there is none."""
        keys = state << 8 | byte
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.to[slot], -1)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            slot = (slot if len(slot) == len(left) else slot[left]) + 1 & self.mask
            found = self.keys[slot]
            hit = found == keys[left]
            out[left[hit]] = self.to[slot[hit]]
            go = ~hit & (found != -1)
            left, slot = left[go], slot[go]
        return out

    def count_word(self, word: bytes) -> int:
        state = n = 0
        for c in word:
            while c not in self.children[state]:
                n, state = n + int(self.popped[state]), int(self.fail[state])
            state = self.children[state][c]
        while state:
            n, state = n + int(self.popped[state]), int(self.fail[state])
        return n

    def count(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word ``data[begin:end]``."""
        size = end - begin
        pieces = np.zeros(len(begin), dtype=np.int64)
        for i in np.flatnonzero(size > SIDE_BY_SIDE):
            pieces[i] = self.count_word(data[begin[i] : end[i]].tobytes())
        order = np.flatnonzero(size <= SIDE_BY_SIDE)
        order = order[np.argsort(-size[order], kind="stable")]  # those that go on are always in front
        start, lengths = begin[order], size[order]
        state, n = np.zeros(len(order), dtype=np.int32), np.zeros(len(order), dtype=np.int64)
        going = np.searchsorted(-lengths, -np.arange(SIDE_BY_SIDE), "left")
        for p in range(int(lengths[0]) if len(lengths) else 0):
            k = int(going[p])
            byte = data[start[:k] + p].astype(np.int32)
            now = state[:k]
            after = self.follow(now, byte)
            stuck = np.flatnonzero(after < 0)
            while len(stuck):
                n[stuck] += self.popped[now[stuck]]
                now[stuck] = self.fail[now[stuck]]
                after[stuck] = self.follow(now[stuck], byte[stuck])
                stuck = stuck[after[stuck] < 0]
            state[:k] = after
        rest = np.flatnonzero(state)
        while len(rest):
            n[rest] += self.popped[state[rest]]
            state[rest] = self.fail[state[rest]]
            rest = rest[state[rest] > 0]
        pieces[order] = n
        return pieces


def _byte_kinds() -> np.ndarray:
    """0 white space, 1 letter or non-ASCII byte, 2 digit, 3 other."""
    kinds = np.full(256, 3, dtype=np.uint8)
    kinds[[*SPACE]] = 0
    kinds[48:58] = 2
    kinds[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    return kinds


KINDS = _byte_kinds()


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` (bytes) begin and end."""
    kind = KINDS[data]
    edge = np.concatenate([[True], kind[1:] != kind[:-1]]) | (kind == 2)
    cuts = np.flatnonzero(edge)
    ends = np.append(cuts[1:], len(data))
    real = kind[cuts] > 0
    return cuts[real], ends[real]


class Counter:
    """Counts texts, some hundred thousand bytes at a time."""

    _own: dict[str, Counter] = {}

    def __init__(self, path: str):
        self.automaton = LongestMatch(read_vocabulary(path))

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._own:  # kept over the tasks of a Python worker
            cls._own[path] = cls(path)
        return cls._own[path]

    def texts(self, texts: list[str | None], size: int = 1 << 18) -> np.ndarray:
        """Rows of (words, tokens, bytes)."""
        out = np.zeros((len(texts), 3), dtype=np.int64)
        held: list[tuple[int, bytes]] = []
        amount = 0
        for row, text in enumerate(texts):
            raw = (text or "").lower().encode("utf-8", "surrogatepass")
            out[row, 2] = len(raw)
            at = 0
            while at < len(raw):  # long texts are cut behind white space
                end = len(raw)
                if end - at > size:
                    space = max(raw.rfind(c, at, at + size) for c in (b" ", b"\n"))
                    end = space + 1 if space >= at else next((p for p in range(at + size, end) if raw[p] in SPACE), end)
                held.append((row, raw[at:end]))
                amount += end - at
                at = end
                if amount > size:
                    self._add(out, held)
                    held, amount = [], 0
        if held:
            self._add(out, held)
        return out

    def _add(self, out: np.ndarray, held: list[tuple[int, bytes]]) -> None:
        data = np.frombuffer(b"\n".join(raw for _, raw in held), dtype=np.uint8)
        begins = np.cumsum([0] + [len(raw) + 1 for _, raw in held[:-1]])
        begin, end = words(data)
        owner = np.searchsorted(begins, begin, "right") - 1
        rows = np.array([row for row, _ in held])
        np.add.at(out[:, 0], rows, np.bincount(owner, minlength=len(held)))
        tokens = np.bincount(owner, weights=self.automaton.count(data, begin, end), minlength=len(held))
        np.add.at(out[:, 1], rows, tokens.astype(np.int64))


COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens, n_bytes) of each row; ``vocabulary`` is a tokenizers file on every executor."""

    def run(batches):
        counter = Counter.of(vocabulary)
        for batch in batches:
            n = counter.texts(column(batch, "_text"))
            yield batch_of(COUNTS, doc_id=batch.column(0), n_words=n[:, 0], n_tokens=n[:, 1], n_bytes=n[:, 2])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(lean(run), "doc_id long, n_words long, n_tokens long, n_bytes long")
