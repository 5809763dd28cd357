"""Text normalisation as Column expressions.

All functions take and return ``Column`` objects and are narrow: they never
introduce an exchange.  Only :func:`strip_accents` leaves the JVM (Unicode
NFKD has no Spark SQL built-in), and it does so through an Arrow-batched
pandas UDF that sees non-ASCII rows only.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recipeflow.functions import constants as K


def _cp_class(codepoints) -> str:
    """A regex character class (Java and RE2 syntax) over code points."""
    return "[" + "".join("\\x{%X}" % cp for cp in codepoints) + "]"


WS_CHARS = "".join(chr(cp) for cp in K.WHITESPACE_CODEPOINTS)
WS_CLASS = _cp_class(K.WHITESPACE_CODEPOINTS)
LINE_SPLIT_RE = "\\r\\n|" + _cp_class(K.LINE_BREAK_CODEPOINTS)
ASCII_ONLY_RE = "^[\\x00-\\x7F]*$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_empty(c) -> Column:
    """``None`` is treated as the empty string everywhere."""
    return F.coalesce(col(c), F.lit(""))


def strip(c) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace at both ends.

    Spark's ``trim`` removes only ASCII spaces; ``btrim`` with the full
    whitespace set matches Python (U+3000, U+00A0, ... included).
    """
    return F.btrim(col(c), F.lit(WS_CHARS))


def safe_lang_code(c) -> Column:
    """null/blank -> 'auto'; lower + strip; unsupported -> 'auto'."""
    code = F.lower(strip(col(c)))
    return F.when(code.isin(*K.SUPPORTED_LANGS), code).otherwise(F.lit("auto"))


def can_translate(c) -> Column:
    """Membership in the translator's language set (null -> false)."""
    return F.coalesce(col(c).isin(*K.MT_LANGS), F.lit(False))


# --------------------------------------------------------------------------
# strip_accents: NFKD then drop characters whose combining class is not 0.
# --------------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def _combining_re() -> re.Pattern:
    """Regex matching every code point with a non-zero combining class.

    Built once per Python worker from ``unicodedata`` (not ``\\p{M}``: marks
    with combining class 0, e.g. Devanagari vowel signs, must be kept).
    """
    ranges = []
    start = prev = None
    for cp in range(0x110000):
        if unicodedata.combining(chr(cp)):
            if start is None:
                start = prev = cp
            elif cp == prev + 1:
                prev = cp
            else:
                ranges.append((start, prev))
                start = prev = cp
    if start is not None:
        ranges.append((start, prev))
    body = "".join(
        re.escape(chr(a)) if a == b else re.escape(chr(a)) + "-" + re.escape(chr(b)) for a, b in ranges
    )
    return re.compile("[" + body + "]+")


def strip_accents_py(s: str | None) -> str | None:
    if s is None:
        return None
    return _combining_re().sub("", unicodedata.normalize("NFKD", s))


@F.pandas_udf(T.StringType())
def _strip_accents_udf(s: pd.Series) -> pd.Series:
    pat = _combining_re()
    return s.map(lambda x: None if x is None else pat.sub("", unicodedata.normalize("NFKD", x)))


def strip_accents(c) -> Column:
    """Accent folding.  ASCII rows stay in the JVM: the UDF receives NULL for
    them (a pandas UDF under ``when`` would still be fed every row)."""
    c = col(c)
    non_ascii = F.when(~c.rlike(ASCII_ONLY_RE), c)
    return F.coalesce(_strip_accents_udf(non_ascii), c)


# --------------------------------------------------------------------------
# transliteration
# --------------------------------------------------------------------------


def _table_expr(c: Column, table: dict) -> Column:
    """One ``translate`` for 1:1 pairs plus ``replace`` for longer outputs.

    The outputs are Latin and the inputs are not, so the order of the
    replacements cannot change the result.
    """
    one = {k: v for k, v in table.items() if len(v) == 1}
    out = F.translate(c, "".join(one.keys()), "".join(one.values()))
    for k, v in table.items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def romanize_cyrillic(c) -> Column:
    return _table_expr(col(c), K.CYRILLIC_TO_LATIN)


def romanize_greek(c) -> Column:
    return _table_expr(col(c), K.GREEK_TO_LATIN)


def _kana_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in K.KANA_TO_LATIN.items() for x in kv])


def romanize_kana(c) -> Column:
    """Per code point map lookup; unknown characters are kept."""
    m = _kana_map()
    chars = F.split(col(c), "")
    return F.array_join(F.transform(chars, lambda ch: F.coalesce(F.try_element_at(m, ch), ch)), "")


def normalize_query(text, lang) -> Column:
    """Language-dependent ASCII folding of a user query.

    ``lang`` goes through :func:`safe_lang_code` first, so 'el'/'gr' become
    'auto' and the Greek branch is unreachable (kept for fidelity).
    """
    code = safe_lang_code(lang)
    s = blank_to_empty(text)
    special = code.isin("ru", "el", "gr", "ja")
    folded = strip_accents(F.when(~special & (s != ""), s))
    return (
        F.when(s == "", s)
        .when(code == "ru", romanize_cyrillic(s))
        .when(code.isin("el", "gr"), romanize_greek(s))
        .when(code == "ja", romanize_kana(s))
        .otherwise(folded)
    )


def looks_like_lang(text, code, prefix: int | None = None) -> Column:
    """Script sniffing over the whole text, or its first ``prefix`` characters."""
    t = blank_to_empty(text)
    if prefix is not None:
        t = F.substring(t, 1, prefix)
    code = col(code)
    ja = F.regexp_count(t, F.lit(K.JA_CLASS))
    latin = F.regexp_count(t, F.lit(K.LATIN_LETTER_CLASS))
    zhko = F.regexp_count(t, F.lit(K.ZH_KO_CLASS))
    return (
        F.when(code == "ja", (ja >= K.SNIFF_MIN) & (ja > latin))
        .when(code.isin("zh", "ko"), zhko >= K.SNIFF_MIN)
        .otherwise(F.lit(True))
    )


def _replace_chain(c: Column, pairs) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _drop_space_before(c: Column, punct: str) -> Column:
    return F.regexp_replace(c, WS_CLASS + "+([" + punct + "])", "$1")


def post_edit(text, code) -> Column:
    """Fixed corrections of machine-translation noise (ja, ko, zh)."""
    s = col(text)
    code = col(code)
    ja = _drop_space_before(_replace_chain(s, K.POST_EDIT_JA), K.JA_PUNCT)
    ko = _replace_chain(s, K.POST_EDIT_KO)
    zh = _drop_space_before(F.replace(s, F.lit(K.POST_EDIT_ZH_DROP), F.lit("")), K.ZH_PUNCT)
    return (
        F.when(s.isNull() | (s == ""), s)
        .when(code == "ja", ja)
        .when(code == "ko", ko)
        .when(code.isin(*K.POST_EDIT_ZH_CODES), zh)
        .otherwise(s)
    )


def post_edit_array(arr, code) -> Column:
    return F.transform(col(arr), lambda x: post_edit(x, code))


def token_budget(text) -> Column:
    """min(1024, len // 2 + 200) as BIGINT."""
    n = F.char_length(blank_to_empty(text)).cast("bigint")
    return F.least(F.lit(K.TOKEN_BUDGET_CAP).cast("bigint"), F.floor(n / 2).cast("bigint") + K.TOKEN_BUDGET_BASE)
