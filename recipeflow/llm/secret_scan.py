"""Secret scan: fixed patterns, and incompressible strings in sensitive contexts.

The base kinds are patterns (assignments to sensitive names, access keys, long hexadecimal runs).  The method adds what no
pattern names: a string of ``SHORTEST`` characters or more within ``REACH`` of a sensitive word, before or behind it, is a candidate, and so is one that
begins within ``REACH`` behind a reported string (the next line of a wrapped key); its novelty is the
number of bytes by which it lengthens the zstandard frame of the text around it, the compressor being primed with a dictionary of
identifiers: common words of programs, and the ``KNOWN`` most frequent identifiers of the corpus, counted over all its texts
(:func:`corpus_identifiers`).  What the code around or the dictionary knows costs next to nothing; a random string costs about its
entropy.  Candidates of at least ``least`` bytes a character that mix letters and digits are reported as ``novel``.

Defined results: NULL and empty texts have no spans; spans are code points, ends exclusive; base matches are leftmost and do not
overlap within their kind; candidates that overlap a base span are not reported again; repeated rows get equal answers; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recipeflow.llm.common import column, lean

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
SENSITIVE_WORDS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "credential", "private", "bearer", "auth")
SENSITIVE = re.compile("|".join(SENSITIVE_WORDS), re.IGNORECASE | re.ASCII)
SHORTEST, REACH, AROUND = 16, 64, 256
#: Identifiers of the corpus that the compressor is primed with, at most (of 64 characters at most).
KNOWN = 1024
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
#: What the compressor knows beforehand: words that identifiers are made of.
IDENTIFIERS = (
    "public private protected static final class function return import export default const let var async await "
    "self this null none true false string integer boolean object array list dict map get set put post delete update "
    "create read write open close request response header content type length value name key user username password "
    "secret token access refresh client server host port path file config settings environment variable connection "
    "database table column index query select insert where order group authorization authentication bearer basic "
    "credential certificate signature encode decode encrypt decrypt hash digest session cookie callback handler "
    "exception error warning message timestamp version identifier reference parameter argument default_value "
    "client_id client_secret access_token refresh_token api_key private_key public_key user_id session_id request_id"
)


class NoveltyMeter:
    """Marginal compressed bytes of a string behind its context."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 6):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False)

    def novelty(self, before: str, candidate: str, after: str) -> float:
        """Bytes a character that ``candidate`` adds to the frame of its surroundings."""
        around = (before + "\n" + after + "\n").encode("utf-8", "surrogatepass")
        alone = len(self.compressor.compress(around))
        return (len(self.compressor.compress(around + candidate.encode())) - alone) / len(candidate)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    spans = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        spans += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return spans


def candidates(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of each run of candidate characters, less what a sensitive word in it and what stands before that word.

    ``words`` are the places of sensitive words; of several in one run the first counts, so the work is linear.
    """
    found = []
    at = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(words) and words[at][1] <= start:
            at += 1
        if at < len(words) and words[at][0] < end:
            start = min(words[at][1], end)
        if end - start >= SHORTEST:
            found.append((start, end))
    return found


def novel_spans(text: str, known: list[tuple[str, int, int]], meter: NoveltyMeter, least: float = 0.45) -> list[tuple[str, int, int]]:
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    words = [m.span() for m in SENSITIVE.finditer(text)]
    begins, ends = [a for a, _ in words], [b for _, b in words]
    taken = sorted((a, b) for _, a, b in known)
    far = list(accumulate((b for _, b in taken), max))  # how far the base spans up to each reach
    found, carried = [], -1
    for start, end in candidates(text, words):
        behind = bisect_left(ends, start - REACH)
        before = bisect_left(begins, end)
        near = (
            (behind < len(ends) and ends[behind] <= start)
            or (before < len(begins) and begins[before] <= end + REACH)
            or 0 <= start - carried <= REACH and carried >= 0
        )
        last = bisect_left(taken, (end, 0)) - 1
        if not near or (last >= 0 and far[last] > start):
            continue
        c = text[start:end]
        if not any(x.isdigit() for x in c) or not any(x.isalpha() for x in c):
            continue
        if meter.novelty(text[max(0, start - AROUND) : start], c, text[end : end + AROUND]) >= least:
            found.append(("novel", start, end))
            carried = end
    return found


def scan_text(text: str | None, meter: NoveltyMeter) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start, then kind as listed."""
    base = base_spans(text or "")
    return sorted(base + novel_spans(text or "", base, meter), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def corpus_identifiers(docs: DataFrame, text_col: str = "text", known: int = KNOWN) -> str:
    """The ``known`` most frequent identifiers of several words (``like_this`` or ``likeThis``) of all texts, by rows that hold them.

    Words with digits are left out: a key that many texts repeat must not become known.
    """
    names = F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"\b[A-Za-z]{2,24}(?:_[A-Za-z]{2,24}|[a-z][A-Z][a-z]{1,24})+\b"), F.lit(0))
    counts = docs.select(F.explode(F.array_distinct(names)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where("n > 1 and length(name) <= 64").orderBy(F.desc("n"), "name").limit(known).collect()
    return " ".join(r["name"] for r in reversed(top))  # the most frequent stand last, nearest to the text


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: str = "") -> DataFrame:
    """(doc_id, spans: array of kind, start, end, value) of each row; ``identifiers`` are known besides :data:`IDENTIFIERS`."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def run(batches):
        meter = NoveltyMeter(identifiers + " " + IDENTIFIERS)
        for batch in batches:
            out = []
            for text in column(batch, "_text"):
                out.append([{"kind": k, "start": a, "end": b, "value": text[a:b]} for k, a, b in scan_text(text, meter)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(lean(run), "doc_id long, spans array<struct<kind:string,start:long,end:long,value:string>>")
