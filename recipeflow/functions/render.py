"""Lookups, rendering and prompt building as Column expressions.

Dimension lookups over fixed tables (at most a few dozen entries) are map
literals: Catalyst folds them into the projection, so they cost no join at
all.  The DataFrame forms of the same tables (for explicit broadcast joins)
are in :mod:`recipeflow.operators.lookup`.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from recipeflow.functions import constants as K
from recipeflow.functions.text import blank_to_empty, col, safe_lang_code


def map_literal(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def language_name(code) -> Column:
    return F.coalesce(F.try_element_at(map_literal(K.LANG_NAMES), safe_lang_code(code)), F.lit("English"))


def section_labels(code) -> Column:
    """struct<ing, steps> of localised headings (English by default)."""
    c = safe_lang_code(code)
    ing = map_literal({k: v[0] for k, v in K.SECTION_LABELS.items()})
    steps = map_literal({k: v[1] for k, v in K.SECTION_LABELS.items()})
    return F.struct(
        F.coalesce(F.try_element_at(ing, c), F.lit(K.DEFAULT_SECTION_LABELS[0])).alias("ing"),
        F.coalesce(F.try_element_at(steps, c), F.lit(K.DEFAULT_SECTION_LABELS[1])).alias("steps"),
    )


def filter_labels(tags) -> Column:
    """tag -> label; unknown tags pass through."""
    m = map_literal(K.FILTER_LABELS)
    return F.transform(col(tags), lambda t: F.coalesce(F.try_element_at(m, t), t))


def flatten_profile(flags=K.PROFILE_FLAGS, allergies: str = "allergies") -> Column:
    """18 boolean flags (missing/null = false) then 'allergy_<name>' lowercased."""
    chosen = F.filter(
        F.array(*[F.when(F.coalesce(F.col(f).cast("boolean"), F.lit(False)), F.lit(f)) for f in flags]),
        lambda x: x.isNotNull(),
    )
    allerg = F.transform(
        F.coalesce(F.col(allergies), F.array().cast("array<string>")),
        lambda a: F.lower(F.concat(F.lit(K.ALLERGY_PREFIX), a)),
    )
    return F.concat(chosen, allerg)


def render_titles(arr) -> Column:
    return F.array_join(F.transform(col(arr), lambda x: F.concat(F.lit('- "'), x, F.lit('"'))), "\n")


def numbered(arr) -> Column:
    """['a','b'] -> '1. a\\n2. b'."""
    return F.array_join(
        F.transform(col(arr), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n"
    )


def bullets(arr) -> Column:
    """'- ' + '\\n- '.join(arr) (an empty list still yields '- ')."""
    return F.concat(F.lit("- "), F.array_join(col(arr), "\n- "))


def render_recipe(ingredients, steps, lang) -> Column:
    lab = section_labels(lang)
    return F.concat(
        lab["ing"], F.lit(":\n"), bullets(ingredients), F.lit("\n\n"),
        lab["steps"], F.lit(":\n"), numbered(steps),
    )


def render_filters(tags) -> Column:
    tags = F.coalesce(col(tags), F.array().cast("array<string>"))
    lines = F.array_join(F.transform(filter_labels(tags), lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(tags) == 0, F.lit(K.NO_FILTERS_TEXT)).otherwise(lines)


def render_check_block(title, text) -> Column:
    t = F.coalesce(F.nullif(col(title), F.lit("")), F.lit(K.CHECK_BLOCK_DEFAULT_TITLE))
    return F.concat(F.lit(K.CHECK_BLOCK_PREFIX), t, F.lit("\n\n"), blank_to_empty(text))


def recipe_payload(title, ingredients, steps) -> Column:
    """meta value of a recipe message."""
    return F.struct(
        F.struct(
            F.struct(
                col(title).alias("title"),
                col(ingredients).alias("ingredients"),
                col(steps).alias("steps"),
            ).alias("recipe_detail"),
            F.lit(None).cast("struct<filters:array<string>,text:string>").alias("health_check"),
        ).alias("payload")
    )


def check_payload(filters, text) -> Column:
    """meta value of a health-check message."""
    return F.struct(
        F.struct(
            F.lit(None).cast("struct<title:string,ingredients:array<string>,steps:array<string>>").alias(
                "recipe_detail"
            ),
            F.struct(col(filters).alias("filters"), col(text).alias("text")).alias("health_check"),
        ).alias("payload")
    )


# --------------------------------------------------------------------------
# prompts: a template names its slots in braces; the defaults hold little more
# --------------------------------------------------------------------------

SYSTEM_PROMPT = "Plain text about food, no markup."
SUGGEST_TEMPLATE = "Wanted: {query}\nDish names that fit, a line each:\n"
DETAIL_TEMPLATE = "Dish: {title}\nWrite its two lists under the headings Ingredients: and Steps:\n"
NUTRITION_TEMPLATE = "{items}\nNutrition of a portion of this:\n"
HEALTH_TEMPLATE = "{ingredients}\n\n{steps}\n\nTo respect: {filters}\nWhat to replace, and why:\n"


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """(text, slot behind it or None) of a template."""
    return [(text, slot) for text, slot, _, _ in Formatter().parse(template)]


def fill(template: str, **slots) -> Column:
    """The template with each ``{slot}`` replaced by its column."""
    parts = [[F.lit(text)] + ([slots[slot]] if slot is not None else []) for text, slot in template_parts(template)]
    return F.concat(*[c for part in parts for c in part])


def suggest_prompt(query, template: str = SUGGEST_TEMPLATE) -> Column:
    return fill(template, query=blank_to_empty(query))


def detail_prompt(title_en, template: str = DETAIL_TEMPLATE) -> Column:
    return fill(template, title=blank_to_empty(title_en))


def nutrition_prompt(items, template: str = NUTRITION_TEMPLATE) -> Column:
    """NULL for an empty list: such rows are answered without the model."""
    items = col(items)
    return F.when(F.size(items) > 0, fill(template, items=bullets(items)))


def health_prompt(ingredients, steps, filters, template: str = HEALTH_TEMPLATE) -> Column:
    ing = F.coalesce(col(ingredients), F.array().cast("array<string>"))
    st = F.coalesce(col(steps), F.array().cast("array<string>"))
    return fill(template, ingredients=bullets(ing), steps=numbered(st), filters=render_filters(filters))
