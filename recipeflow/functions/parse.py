"""Parsing free-text model answers into typed arrays (array HOFs only).

Every function is a single ``Project``: lines are split, folded and filtered
inside the row, so no exchange is ever needed and whole texts are processed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recipeflow.functions import constants as K
from recipeflow.functions.text import LINE_SPLIT_RE, WS_CHARS, blank_to_empty, col, strip

EMPTY_STR_ARRAY = "array<string>"


def empty_array() -> Column:
    return F.array().cast(EMPTY_STR_ARRAY)


def raw_lines(text) -> Column:
    """Python ``str.splitlines()`` boundaries (no stripping)."""
    return F.split(blank_to_empty(text), LINE_SPLIT_RE)


def split_lines(text) -> Column:
    """Lines, stripped, blanks dropped."""
    return F.filter(F.transform(raw_lines(text), strip), lambda x: x != "")


def split_item_list(text) -> Column:
    """'a, ,b' -> ['a', 'b'] (comma list, trimmed, blanks dropped)."""
    return clean_items(F.split(blank_to_empty(text), ","))


def clean_items(items) -> Column:
    """Items of an array, trimmed, NULLs and blanks dropped; a NULL array is empty."""
    return F.filter(F.transform(F.coalesce(col(items), empty_array()), strip), lambda x: x != "")


def top_n(arr, n: int) -> Column:
    return F.slice(col(arr), 1, n)


# --------------------------------------------------------------------------
# titles
# --------------------------------------------------------------------------


def _split_inline_bullets(line: Column) -> Column:
    """Pieces of a stripped line, without whitespace in front; blank ones are dropped as titles."""
    parts = F.transform(F.split(line, " \\* "), lambda x: F.ltrim(x, F.lit(WS_CHARS)))
    return F.when(line.contains(" * "), parts).otherwise(F.array(line))


def _clean_title(s: Column) -> Column:
    s = F.replace(F.ltrim(s, F.lit("-*•")), F.lit("**"), F.lit(""))
    s = strip(F.substring_index(s, ":", 1))
    return F.btrim(s, F.lit(' "“”'))


def extract_titles(text, limit: int | None = None) -> Column:
    """Recipe titles from a bulleted answer, in order; all of them unless a ``limit`` is given."""
    pieces = F.flatten(F.transform(split_lines(text), _split_inline_bullets))
    titles = F.filter(F.transform(pieces, _clean_title), lambda x: x != "")
    return titles if limit is None else F.slice(titles, 1, limit)


# --------------------------------------------------------------------------
# recipe
# --------------------------------------------------------------------------

_BULLET_PREFIX = "^[-\\x{2022} ]+"
_SEC_NONE, _SEC_ING, _SEC_STEPS = 0, 1, 2


def _is_bullet(s: Column) -> Column:
    return s.startswith("-") | s.startswith("•")


def _bullet_item(s: Column) -> Column:
    return strip(F.regexp_replace(s, _BULLET_PREFIX, ""))


def heading_kind(s: Column) -> Column:
    """1 = ingredients heading, 2 = steps heading, 0 = other (s is stripped)."""
    low = F.lower(s)
    return (
        F.when(low.startswith("ingredients"), F.lit(_SEC_ING))
        .when(low.startswith("steps") | low.startswith("method"), F.lit(_SEC_STEPS))
        .otherwise(F.lit(_SEC_NONE))
    )


def step_text(s: Column) -> Column:
    """Drop a leading 'N.' when char 0 is a digit and '.' is in the first 4."""
    numbered = s.rlike("^\\p{Nd}") & (F.instr(F.substring(s, 1, 4), ".") > 0)
    return F.when(numbered, strip(F.regexp_replace(s, "^[^.]*\\.", ""))).otherwise(s)


_HEADING_AHEAD = "\n(?=(?i:ingredients|steps|method))"


def _sections(lines: Column) -> Column:
    """The sections of an answer, array<struct<kind, lines>>, their heading the first line.

    Lines are stripped and non-blank, so a heading is a line starting
    (ASCII case-insensitively, as ``str.lower().startswith`` does for these
    ASCII words) with 'ingredients', 'steps' or 'method'.  Joining the lines
    and splitting before every heading line yields sections that start with
    their heading; lines before the first heading form a section of kind 0
    and are ignored.  No fold: every step is a flat ``transform``/``filter``.
    """
    chunks = F.split(F.array_join(lines, "\n"), _HEADING_AHEAD)
    return F.transform(
        chunks, lambda c: F.struct(heading_kind(F.substring_index(c, "\n", 1)).alias("kind"), F.split(c, "\n").alias("lines"))
    )


def _of_sections(parts: Column) -> Column:
    """Section state machine in linear time, over :func:`_sections`."""
    ing = F.flatten(
        F.transform(
            F.filter(parts, lambda p: p["kind"] == _SEC_ING),
            lambda p: F.transform(F.filter(p["lines"], lambda x, i: (i > 0) & _is_bullet(x)), _bullet_item),
        )
    )
    steps = F.flatten(
        F.transform(
            F.filter(parts, lambda p: p["kind"] == _SEC_STEPS),
            lambda p: F.filter(F.transform(F.filter(p["lines"], lambda x, i: i > 0), step_text), lambda x: x != ""),
        )
    )
    return F.struct(ing.alias("ingredients"), steps.alias("steps"))


def parse_recipe_primary(text) -> Column:
    """Section state machine (headings switch section and are dropped)."""
    return _of_sections(_sections(split_lines(text)))


def parse_recipe_fallback(text) -> Column:
    """Bullets -> ingredients, other lines longer than 2 -> steps."""
    return _fallback(split_lines(text))


def _fallback(lines: Column) -> Column:
    ing = F.transform(F.filter(lines, _is_bullet), _bullet_item)
    steps = F.filter(lines, lambda t: ~_is_bullet(t) & (F.char_length(t) > 2))
    return F.struct(ing.alias("ingredients"), steps.alias("steps"))


def parse_recipe(text) -> Column:
    """Primary parse; the fallback only when both lists come out empty.

    A single Column for ad-hoc use.  Jobs use :func:`with_recipe`, which
    stages the work in projections so that each fold runs once per row.
    """
    p = parse_recipe_primary(text)
    empty = (F.size(p["ingredients"]) == 0) & (F.size(p["steps"]) == 0)
    return F.when(empty, parse_recipe_fallback(text)).otherwise(p)


def cap_recipe(rec, max_ing: int = K.MAX_INGREDIENTS, max_steps: int = K.MAX_STEPS) -> Column:
    rec = col(rec)
    return F.struct(
        F.slice(rec["ingredients"], 1, max_ing).alias("ingredients"),
        F.slice(rec["steps"], 1, max_steps).alias("steps"),
    )


def default_recipe() -> Column:
    return F.struct(
        F.array(*[F.lit(x) for x in K.DEFAULT_INGREDIENTS]).alias("ingredients"),
        F.array(*[F.lit(x) for x in K.DEFAULT_STEPS]).alias("steps"),
    )


def recipe_or_default(rec, error) -> Column:
    """A failed generation yields the fixed default recipe."""
    return F.when(col(error).isNotNull(), default_recipe()).otherwise(col(rec))


def titles_text_or_default(text, error) -> Column:
    """A failed generation yields the fixed default title list text."""
    return F.when(col(error).isNotNull(), F.lit(K.DEFAULT_TITLES_TEXT)).otherwise(col(text))


def with_recipe(df, text, out: str = "recipe", error: str | None = None, cap: bool = False):
    """Add ``out`` = parsed recipe (struct<ingredients, steps>) to ``df``.

    Staged projections: lines, sections, primary lists, fallback choice, default on
    error, caps if asked for.  Each stage is referenced more than once by the next and is
    not cheap, so Catalyst keeps the projections apart and every
    higher-order function (interpreted, outside whole-stage codegen) runs
    exactly once per row.  Still a narrow plan: no exchange.
    """
    d = df.withColumn("_rl", split_lines(text))
    d = d.withColumn("_rs", _sections(F.col("_rl"))).withColumn("_rp", _of_sections(F.col("_rs")))
    p = F.col("_rp")
    empty = (F.size(p["ingredients"]) == 0) & (F.size(p["steps"]) == 0)
    d = d.withColumn(out, F.when(empty, _fallback(F.col("_rl"))).otherwise(p))
    if error is not None:
        d = d.withColumn(out, recipe_or_default(F.col(out), error))
    if cap:
        d = d.withColumn(out, cap_recipe(F.col(out)))
    return d.drop("_rl", "_rs", "_rp")
