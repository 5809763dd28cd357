"""Registered queries: text core, parsers, lookups and rendering (rows 8,
10-14, 17-42, 51, 53, 54 of the operator inventory).

Every query reads whole driver tables (or views Spark derives from them) and
is a narrow projection unless noted; results are scalar columns (arrays are
exploded to (key, pos, item) or joined) so that they hash the same in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from recipeflow.functions import constants as K
from recipeflow.functions import parse as P
from recipeflow.functions import render as R
from recipeflow.functions import text as X
from recipeflow.operators import chatlog as C
from recipeflow.operators.counters import counter_sketches, merge_counters, run_counters
from recipeflow.operators.lookup import with_task_params
from recipeflow.operators.ranked import top_n_rows
from recipeflow.plans import sqlgen as S
from recipeflow.plans.oracle_views import with_views
from recipeflow.plans.registry import register
from recipeflow.sources import views as V
from recipeflow.sources.tables import load

# Language codes cycled over ids to reach every branch of the lookups.
PROBE_CODES = K.SUPPORTED_LANGS + ("el", "gr", "zh-cn", "zh-tw", " JA ", "xx", "", None)
_NP = len(PROBE_CODES)
PROBE_SQL = "[" + ", ".join("NULL" if c is None else S.lit(c) for c in PROBE_CODES) + "]::VARCHAR[]"


def probe_code(id_col: str):
    return F.element_at(F.array(*[F.lit(c).cast("string") for c in PROBE_CODES]), (F.col(id_col) % _NP).cast("int") + 1)


def probe_sql(id_col: str) -> str:
    return f"({PROBE_SQL})[{id_col} % {_NP} + 1]"


def _long(df, key, arr, pos="pos", item="item"):
    return df.select(key, F.posexplode(arr).alias(pos, item)).withColumn(pos, F.col(pos).cast("bigint"))


_TEXT_LINES = S.split_lines("text")


def _unnest_sql(src: str, key: str, arr: str, pos="pos", item="item") -> str:
    return f"SELECT {key}, u.{item} AS {item}, CAST(u.o - 1 AS BIGINT) AS {pos} FROM {src}, unnest({arr}) WITH ORDINALITY AS u({item}, o)"


# ------------------------------------------------------------------ strip (28)
PADS = (chr(0x3000) + " ", "\t" + chr(0xA0), "")
PADS_SQL = "[chr(12288) || ' ', chr(9) || chr(160), '']"


@register(
    "strip",
    f"SELECT doc_id, {S.strip(f'{PADS_SQL}[doc_id % 3 + 1] || text || {PADS_SQL}[doc_id % 3 + 1]')} AS stripped FROM documents",
    row="28",
)
def q_strip(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "text")
    pad = F.element_at(F.array(*[F.lit(p) for p in PADS]), (F.col("doc_id") % 3).cast("int") + 1)
    return d.select("doc_id", X.strip(F.concat(pad, "text", pad)).alias("stripped"))


# ------------------------------------------------------- lang codes (10-13)
@register(
    "safe_lang_code",
    with_views(f"SELECT query_id, display_lang, {S.safe_lang('display_lang')} AS code FROM v4", "v4"),
    row="10",
)
def q_safe_lang_code(spark, sf):
    return V.v4_queries(spark, sf).select("query_id", "display_lang", X.safe_lang_code("display_lang").alias("code"))


@register(
    "can_translate",
    f"SELECT doc_id, {probe_sql('doc_id')} AS code, {S.can_translate(probe_sql('doc_id'))} AS ok FROM documents",
    row="11",
)
def q_can_translate(spark, sf):
    d = load(spark, sf, "documents", "doc_id").withColumn("code", probe_code("doc_id"))
    return d.select("doc_id", "code", X.can_translate("code").alias("ok"))


@register(
    "language_name",
    f"SELECT doc_id, {probe_sql('doc_id')} AS code, {S.language_name(probe_sql('doc_id'))} AS name FROM documents",
    row="12",
)
def q_language_name(spark, sf):
    d = load(spark, sf, "documents", "doc_id").withColumn("code", probe_code("doc_id"))
    return d.select("doc_id", "code", R.language_name("code").alias("name"))


@register(
    "section_labels",
    f"SELECT doc_id, {probe_sql('doc_id')} AS code, {S.section_label(probe_sql('doc_id'), 0)} AS ing_label, "
    f"{S.section_label(probe_sql('doc_id'), 1)} AS step_label FROM documents",
    row="13",
)
def q_section_labels(spark, sf):
    d = load(spark, sf, "documents", "doc_id").withColumn("code", probe_code("doc_id"))
    lab = R.section_labels("code")
    return d.select("doc_id", "code", lab["ing"].alias("ing_label"), lab["steps"].alias("step_label"))


# ------------------------------------------------- profiles (14, 39, 51)
@register(
    "flatten_profile",
    with_views(
        f"SELECT profile_id, CAST(len(t) AS BIGINT) AS n_tags, array_to_string(t, ',') AS tags "
        f"FROM (SELECT profile_id, {S.flatten_profile()} AS t FROM v5)",
        "v5",
    ),
    row="51",
)
def q_flatten_profile(spark, sf):
    p = V.v5_profiles(spark, sf).select("profile_id", R.flatten_profile().alias("t"))
    return p.select("profile_id", F.size("t").cast("bigint").alias("n_tags"), F.array_join("t", ",").alias("tags"))


@register(
    "filter_labels",
    with_views(
        _unnest_sql(f"(SELECT profile_id, list_transform({S.flatten_profile()}, lambda tg: {S.filter_label('tg')}) AS l FROM v5)", "profile_id", "l", item="label"),
        "v5",
    ),
    row="14",
)
def q_filter_labels(spark, sf):
    p = V.v5_profiles(spark, sf).select("profile_id", R.filter_labels(R.flatten_profile()).alias("l"))
    return _long(p, "profile_id", "l", item="label")


@register(
    "render_filters",
    with_views(
        f"SELECT profile_id, {S.render_filters('t')} AS rendered FROM "
        f"(SELECT profile_id, CASE WHEN profile_id % 4 = 0 THEN []::VARCHAR[] ELSE {S.flatten_profile()} END AS t FROM v5)",
        "v5",
    ),
    row="39",
)
def q_render_filters(spark, sf):
    p = V.v5_profiles(spark, sf)
    tags = F.when(F.col("profile_id") % 4 == 0, F.array().cast("array<string>")).otherwise(R.flatten_profile())
    return p.select("profile_id", R.render_filters(tags).alias("rendered"))


# ------------------------------------------------- accents, scripts (18-22)
@register("strip_accents", f"SELECT doc_id, {S.strip_accents('text')} AS folded FROM documents", row="18")
def q_strip_accents(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", X.strip_accents("text").alias("folded"))


@register(
    "romanize_cyrillic",
    with_views(f"SELECT item_id, cyr, {S.romanize('cyr', K.CYRILLIC_TO_LATIN)} AS latin FROM v8", "v8"),
    row="19",
)
def q_romanize_cyrillic(spark, sf):
    return V.v8_scripts(spark, sf).select("item_id", "cyr", X.romanize_cyrillic("cyr").alias("latin"))


@register(
    "romanize_greek",
    with_views(f"SELECT item_id, greek, {S.romanize('greek', K.GREEK_TO_LATIN)} AS latin FROM v8", "v8"),
    row="20",
)
def q_romanize_greek(spark, sf):
    return V.v8_scripts(spark, sf).select("item_id", "greek", X.romanize_greek("greek").alias("latin"))


@register(
    "romanize_kana",
    with_views(f"SELECT item_id, kana, {S.romanize('kana', K.KANA_TO_LATIN)} AS latin FROM v8", "v8"),
    row="21",
)
def q_romanize_kana(spark, sf):
    return V.v8_scripts(spark, sf).select("item_id", "kana", X.romanize_kana("kana").alias("latin"))


def _script_mix(item_id: str, sql: bool):
    """A query text in the script matching a probe language (from V8)."""
    if sql:
        return (
            f"CASE {item_id} % 4 WHEN 0 THEN cyr WHEN 1 THEN kana || ' ' || cyr WHEN 2 THEN greek ELSE kana END"
        )
    k = F.col(item_id) % 4
    return (
        F.when(k == 0, F.col("cyr"))
        .when(k == 1, F.concat(F.col("kana"), F.lit(" "), F.col("cyr")))
        .when(k == 2, F.col("greek"))
        .otherwise(F.col("kana"))
    )


@register(
    "normalize_query",
    with_views(
        f"SELECT query_id, {probe_sql('query_id')} AS lang, {S.normalize_query('raw', probe_sql('query_id'))} AS norm FROM v4 "
        f"UNION ALL SELECT -1 - item_id AS query_id, {probe_sql('item_id')} AS lang, "
        f"{S.normalize_query(_script_mix('item_id', True), probe_sql('item_id'))} AS norm FROM v8",
        "v4",
        "v8",
    ),
    row="22",
)
def q_normalize_query(spark, sf):
    q = V.v4_queries(spark, sf).select("query_id", probe_code("query_id").alias("lang"), F.col("raw").alias("text"))
    s = V.v8_scripts(spark, sf).select(
        (F.lit(-1) - F.col("item_id")).alias("query_id"), probe_code("item_id").alias("lang"), _script_mix("item_id", False).alias("text")
    )
    both = q.unionByName(s)
    return both.select("query_id", "lang", X.normalize_query("text", "lang").alias("norm"))


SNIFF_CODES = ("ja", "zh", "ko", "fr", "en", "ja")
_HANGUL = "한국어김치찌개만드는법"


def _sniff_text_spark():
    return F.concat(
        F.col("kana"), F.col("kana"), F.col("kana"),
        F.when(F.col("item_id") % 3 == 0, F.lit(_HANGUL)).otherwise(F.lit("")),
        F.lit(" "), F.col("cyr"), F.lit(" "), F.col("greek"),
    )


def _sniff_text_sql():
    return f"kana || kana || kana || (CASE WHEN item_id % 3 = 0 THEN '{_HANGUL}' ELSE '' END) || ' ' || cyr || ' ' || greek"


_SNIFF_SQL = "[" + ", ".join(S.lit(c) for c in SNIFF_CODES) + "]"


@register(
    "looks_like_lang",
    with_views(
        f"SELECT item_id, code, {S.looks_like_lang('t', 'code')} AS ok FROM "
        f"(SELECT item_id, {_SNIFF_SQL}[item_id % {len(SNIFF_CODES)} + 1] AS code, {_sniff_text_sql()} AS t FROM v8)",
        "v8",
    ),
    row="24",
)
def q_looks_like_lang(spark, sf):
    v = V.v8_scripts(spark, sf)
    code = F.element_at(F.array(*[F.lit(c) for c in SNIFF_CODES]), (F.col("item_id") % len(SNIFF_CODES)).cast("int") + 1)
    return v.select("item_id", code.alias("code"), X.looks_like_lang(_sniff_text_spark(), code).alias("ok"))


# post edit: noise phrases picked per item (our own sample list)
# what the edits look for, and marks of our own beside which they must not
NOISE = (
    *[found for found, _ in K.POST_EDIT_JA], *[found for found, _ in K.POST_EDIT_KO], K.POST_EDIT_ZH_DROP,
    " 、", "　。", " ，", "\t；", " ：", "・",
)
EDIT_CODES = ("ja", "ko", "zh", "zh-cn", "zh-tw", "en", "fr")
_NOISE_SQL = "[" + ", ".join(S.lit(x) for x in NOISE) + "]"
_EDIT_SQL = "[" + ", ".join(S.lit(x) for x in EDIT_CODES) + "]"
_NN = len(NOISE)


def _noise_spark():
    arr = F.array(*[F.lit(x) for x in NOISE])
    k = F.col("item_id")

    def pick(e):
        return F.element_at(arr, (e % _NN).cast("int") + 1)

    return F.concat(pick(k), pick(k * 3 + 1), F.lit(" "), pick(k * 7 + 2), F.col("kana"), pick(k * 5 + 3), F.lit("|"), F.col("cyr"), pick(k + 9))


def _noise_sql():
    def pick(e):
        return f"{_NOISE_SQL}[({e}) % {_NN} + 1]"

    return (
        f"{pick('item_id')} || {pick('item_id * 3 + 1')} || ' ' || {pick('item_id * 7 + 2')} || kana || "
        f"{pick('item_id * 5 + 3')} || '|' || cyr || {pick('item_id + 9')}"
    )


def _edit_code_spark():
    return F.element_at(F.array(*[F.lit(c) for c in EDIT_CODES]), (F.col("item_id") % len(EDIT_CODES)).cast("int") + 1)


@register(
    "post_edit",
    with_views(
        f"SELECT item_id, code, {S.post_edit('t', 'code')} AS edited FROM "
        f"(SELECT item_id, {_EDIT_SQL}[item_id % {len(EDIT_CODES)} + 1] AS code, {_noise_sql()} AS t FROM v8)",
        "v8",
    ),
    row="25",
)
def q_post_edit(spark, sf):
    v = V.v8_scripts(spark, sf).select("item_id", _edit_code_spark().alias("code"), _noise_spark().alias("t"))
    return v.select("item_id", "code", X.post_edit("t", "code").alias("edited"))


@register(
    "post_edit_array",
    with_views(
        _unnest_sql(
            f"(SELECT item_id, list_transform(string_split(t, '|'), lambda ex: {S.post_edit('ex', 'code')}) AS l FROM "
            f"(SELECT item_id, {_EDIT_SQL}[item_id % {len(EDIT_CODES)} + 1] AS code, {_noise_sql()} AS t FROM v8))",
            "item_id",
            "l",
        ),
        "v8",
    ),
    row="26",
)
def q_post_edit_array(spark, sf):
    v = V.v8_scripts(spark, sf).select("item_id", _edit_code_spark().alias("code"), _noise_spark().alias("t"))
    v = v.select("item_id", X.post_edit_array(F.split("t", "\\|"), F.col("code")).alias("l"))
    return _long(v, "item_id", "l")


@register("token_budget", f"SELECT doc_id, {S.token_budget('text')} AS budget FROM documents", row="27")
def q_token_budget(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", X.token_budget("text").alias("budget"))


# ------------------------------------------------------ lines and lists
@register("split_lines", _unnest_sql(f"(SELECT doc_id, {S.split_lines('text')} AS l FROM documents)", "doc_id", "l", item="line"), row="29")
def q_split_lines(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "text").select("doc_id", P.split_lines("text").alias("l"))
    return _long(d, "doc_id", "l", item="line")


@register(
    "top_n_items",
    _unnest_sql(f"(SELECT doc_id, list_slice({S.split_lines('text')}, 1, 5) AS l FROM documents)", "doc_id", "l", item="line"),
    row="53",
)
def q_top_n_items(spark, sf):
    d = load(spark, sf, "documents", "doc_id", "text").select("doc_id", P.top_n(P.split_lines("text"), 5).alias("l"))
    return _long(d, "doc_id", "l", item="line")


@register(
    "top_n_item_rows",
    f"SELECT lang, doc_id, pos, line, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY length(line) DESC, doc_id, pos) AS rank "
    f"FROM ({_unnest_sql(f'(SELECT lang, doc_id, {_TEXT_LINES} AS l FROM documents)', 'lang, doc_id', 'l', item='line')})) WHERE rank <= 20",
    row="53",
)
def q_top_n_item_rows(spark, sf):
    """The 20 longest lines of each language: few groups, all of them hot."""
    d = load(spark, sf, "documents", "doc_id", "lang", "text").select("lang", "doc_id", F.posexplode(P.split_lines("text")).alias("pos", "line"))
    order = [F.char_length("line").desc(), F.col("doc_id"), F.col("pos")]
    return top_n_rows(d.withColumn("pos", F.col("pos").cast("bigint")), ["lang"], order, 20, "rank").withColumn("rank", F.col("rank").cast("bigint"))


@register(
    "split_item_list",
    f"SELECT conv_id, turn, u.item AS item, CAST(u.o - 1 AS BIGINT) AS pos FROM "
    f"(SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), ','), lambda ix: {S.strip('ix')}), lambda ix: ix <> '') AS l FROM conversations), "
    f"unnest(l) WITH ORDINALITY AS u(item, o)",
    row="8",
)
def q_split_item_list(spark, sf):
    c = load(spark, sf, "conversations", "conv_id", "turn", "text")
    c = c.select("conv_id", "turn", P.split_item_list("text").alias("l"))
    return c.select("conv_id", "turn", F.posexplode("l").alias("pos", "item")).withColumn("pos", F.col("pos").cast("bigint"))


# --------------------------------------------------------------- titles
@register(
    "extract_titles",
    with_views(
        f"SELECT answer_id, CAST(len(t) AS BIGINT) AS n_titles, array_to_string(t, {S.NL}) AS titles "
        f"FROM (SELECT answer_id, {S.extract_titles('text')} AS t FROM v2)",
        "v2",
    ),
    row="30",
)
def q_extract_titles(spark, sf):
    t = V.v2_title_answers(spark, sf).select("answer_id", P.extract_titles("text").alias("t"))
    return t.select("answer_id", F.size("t").cast("bigint").alias("n_titles"), F.array_join("t", "\n").alias("titles"))


@register(
    "extract_titles_limited",
    with_views(
        f"SELECT answer_id, array_to_string({S.extract_titles('text', K.MAX_TITLES)}, {S.NL}) AS titles FROM v2",
        "v2",
    ),
    row="30",
)
def q_extract_titles_limited(spark, sf):
    """The application's own limit of titles, asked for."""
    t = V.v2_title_answers(spark, sf)
    return t.select("answer_id", F.array_join(P.extract_titles("text", K.MAX_TITLES), "\n").alias("titles"))


@register(
    "explode_titles",
    with_views(
        f"SELECT answer_id, CAST(u.o AS BIGINT) AS rank, u.title AS title FROM "
        f"(SELECT answer_id, {S.extract_titles('text')} AS t FROM v2), unnest(t) WITH ORDINALITY AS u(title, o)",
        "v2",
    ),
    row="31",
)
def q_explode_titles(spark, sf):
    t = V.v2_title_answers(spark, sf).select("answer_id", P.extract_titles("text").alias("titles"))
    return C.explode_titles(t, "answer_id")


@register(
    "render_titles",
    with_views(f"SELECT answer_id, {S.render_titles(S.extract_titles('text'))} AS rendered FROM v2", "v2"),
    row="37",
)
def q_render_titles(spark, sf):
    t = V.v2_title_answers(spark, sf)
    return t.select("answer_id", R.render_titles(P.extract_titles("text")).alias("rendered"))


# -------------------------------------------------------------- recipes
def _rec_cols(key):
    return (
        f"SELECT k AS {key}, CAST(len(ingredients) AS BIGINT) AS n_ing, CAST(len(steps) AS BIGINT) AS n_steps, "
        f"array_to_string(ingredients, {S.NL}) AS ingredients, array_to_string(steps, {S.NL}) AS steps FROM r_rec"
    )


def _rec_out(df, key, rec):
    return df.select(
        key,
        F.size(F.col(rec + ".ingredients")).cast("bigint").alias("n_ing"),
        F.size(F.col(rec + ".steps")).cast("bigint").alias("n_steps"),
        F.array_join(F.col(rec + ".ingredients"), "\n").alias("ingredients"),
        F.array_join(F.col(rec + ".steps"), "\n").alias("steps"),
    )


@register(
    "parse_recipe",
    with_views(_rec_cols("recipe_id"), "v3", extra=[("__p", "SELECT 1")]).replace(
        "__p AS (SELECT 1)", S.parse_recipe_ctes("v3", "recipe_id", "text", "r", fallback=False)
    ),
    row="32",
)
def q_parse_recipe(spark, sf):
    v = V.v3_recipe_answers(spark, sf).select("recipe_id", P.parse_recipe_primary("text").alias("r"))
    return _rec_out(v, "recipe_id", "r")


_MIXED_SQL = "SELECT 'r' || recipe_id AS id, text FROM v3 UNION ALL SELECT 'd' || doc_id AS id, text FROM documents"


def _mixed(spark, sf):
    r = V.v3_recipe_answers(spark, sf).select(F.concat(F.lit("r"), F.col("recipe_id").cast("string")).alias("id"), "text")
    d = load(spark, sf, "documents", "doc_id", "text").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text"
    )
    return r.unionByName(d)


@register(
    "parse_recipe_fallback",
    with_views(_rec_cols("id"), "v3", extra=[("mixed", _MIXED_SQL), ("__p", "SELECT 1")]).replace(
        "__p AS (SELECT 1)", S.parse_recipe_ctes("mixed", "id", "text", "r", primary=False)
    ),
    row="33",
)
def q_parse_recipe_fallback(spark, sf):
    m = _mixed(spark, sf).select("id", P.parse_recipe_fallback("text").alias("r"))
    return _rec_out(m, "id", "r")


@register(
    "cap_recipe",
    with_views(
        f"SELECT k AS id, CAST(len(list_slice(ingredients, 1, {K.MAX_INGREDIENTS})) AS BIGINT) AS n_ing, "
        f"CAST(len(list_slice(steps, 1, {K.MAX_STEPS})) AS BIGINT) AS n_steps, "
        f"array_to_string(list_slice(ingredients, 1, {K.MAX_INGREDIENTS}), {S.NL}) AS ingredients, "
        f"array_to_string(list_slice(steps, 1, {K.MAX_STEPS}), {S.NL}) AS steps FROM r_rec",
        "v3",
        extra=[("mixed", _MIXED_SQL), ("__p", "SELECT 1")],
    ).replace("__p AS (SELECT 1)", S.parse_recipe_ctes("mixed", "id", "text", "r")),
    row="34",
)
def q_cap_recipe(spark, sf):
    m = P.with_recipe(_mixed(spark, sf), "text", out="r", cap=True)
    return _rec_out(m, "id", "r")


def _items_sql(src_rec: str, key: str) -> str:
    return (
        f"SELECT {key}, 'ingredients' AS section, CAST(u.o - 1 AS BIGINT) AS pos, u.item AS item FROM {src_rec}, unnest(ingredients) WITH ORDINALITY AS u(item, o) "
        f"UNION ALL SELECT {key}, 'steps' AS section, CAST(u.o - 1 AS BIGINT) AS pos, u.item AS item FROM {src_rec}, unnest(steps) WITH ORDINALITY AS u(item, o)"
    )


_DEF_ING = S.str_list(K.DEFAULT_INGREDIENTS)
_DEF_STEPS = S.str_list(K.DEFAULT_STEPS)


@register(
    "default_on_error",
    with_views(
        _items_sql(
            f"(SELECT r.k AS recipe_id, CASE WHEN length(v3.text) % 10 = 0 THEN {_DEF_ING} ELSE r.ingredients END AS ingredients, "
            f"CASE WHEN length(v3.text) % 10 = 0 THEN {_DEF_STEPS} ELSE r.steps END AS steps FROM r_rec r JOIN v3 ON v3.recipe_id = r.k)",
            "recipe_id",
        ),
        "v3",
        extra=[("__p", "SELECT 1")],
    ).replace("__p AS (SELECT 1)", S.parse_recipe_ctes("v3", "recipe_id", "text", "r")),
    row="35",
)
def q_default_on_error(spark, sf):
    v = V.v3_recipe_answers(spark, sf)
    v = v.withColumn("error", F.when(F.char_length("text") % 10 == 0, F.lit("boom")))
    v = P.with_recipe(v, "text", error="error", cap=False)
    return C.recipe_items(v, "recipe_id")


@register(
    "recipe_items",
    with_views(
        _items_sql("(SELECT k AS recipe_id, ingredients, steps FROM r_rec)", "recipe_id"),
        "v3",
        extra=[("__p", "SELECT 1")],
    ).replace("__p AS (SELECT 1)", S.parse_recipe_ctes("v3", "recipe_id", "text", "r")),
    row="36",
)
def q_recipe_items(spark, sf):
    v = P.with_recipe(V.v3_recipe_answers(spark, sf), "text")
    return C.recipe_items(v, "recipe_id")


FLAGSHIP_SQL = with_views(
    "SELECT section, CAST(count(*) AS BIGINT) AS n_items, CAST(count(DISTINCT recipe_id) AS BIGINT) AS n_recipes FROM ("
    + _items_sql("(SELECT k AS recipe_id, ingredients, steps FROM r_rec)", "recipe_id")
    + ") GROUP BY section",
    "v3",
    extra=[("__p", "SELECT 1")],
).replace("__p AS (SELECT 1)", S.parse_recipe_ctes("v3", "recipe_id", "text", "r"))


@register("recipe_section_counts", FLAGSHIP_SQL, row="flagship: 29+32+33+34+36")
def q_recipe_section_counts(spark, sf):
    items = q_recipe_items(spark, sf)
    return items.groupBy("section").agg(
        F.count(F.lit(1)).alias("n_items"), F.countDistinct("recipe_id").alias("n_recipes")
    )


@register(
    "render_recipe",
    with_views(
        f"SELECT k AS recipe_id, {probe_sql('k')} AS lang, {S.render_recipe('ingredients', 'steps', probe_sql('k'))} AS rendered FROM r_rec",
        "v3",
        extra=[("__p", "SELECT 1")],
    ).replace("__p AS (SELECT 1)", S.parse_recipe_ctes("v3", "recipe_id", "text", "r")),
    row="38",
)
def q_render_recipe(spark, sf):
    v = P.with_recipe(V.v3_recipe_answers(spark, sf), "text", out="r").select(
        "recipe_id", probe_code("recipe_id").alias("lang"), "r"
    )
    return v.select("recipe_id", "lang", R.render_recipe(F.col("r.ingredients"), F.col("r.steps"), F.col("lang")).alias("rendered"))


# -------------------------------------------------------------- prompts (40)
_PROMPT_FILTERS_SQL = "CASE WHEN k % 2 = 0 THEN ['Vegan', 'Nut-free']::VARCHAR[] ELSE []::VARCHAR[] END"


@register(
    "build_prompts",
    with_views(
        f"SELECT 'suggest' AS kind, query_id AS id, {S.suggest_prompt(S.strip('raw'))} AS prompt FROM v4 "
        f"UNION ALL SELECT 'detail' AS kind, answer_id AS id, {S.detail_prompt('u.title')} AS prompt "
        f"FROM v2, unnest({S.extract_titles('text')}) AS u(title) "
        f"UNION ALL SELECT 'nutrition' AS kind, k AS id, {S.nutrition_prompt('ingredients')} AS prompt FROM r_rec "
        f"UNION ALL SELECT 'health' AS kind, k AS id, {S.health_prompt('ingredients', 'steps', _PROMPT_FILTERS_SQL)} AS prompt FROM r_rec",
        "v4",
        "v2",
        "v3",
        extra=[("__p", "SELECT 1")],
    ).replace("__p AS (SELECT 1)", S.parse_recipe_ctes("v3", "recipe_id", "text", "r")),
    row="40",
)
def q_build_prompts(spark, sf):
    s = V.v4_queries(spark, sf).select(
        F.lit("suggest").alias("kind"), F.col("query_id").alias("id"), R.suggest_prompt(X.strip("raw")).alias("prompt")
    )
    titles = V.v2_title_answers(spark, sf).select("answer_id", P.extract_titles("text").alias("titles"))
    d = C.explode_titles(titles, "answer_id").select(
        F.lit("detail").alias("kind"), F.col("answer_id").alias("id"), R.detail_prompt("title").alias("prompt")
    )
    tags = F.when(F.col("recipe_id") % 2 == 0, F.array(F.lit("Vegan"), F.lit("Nut-free"))).otherwise(P.empty_array())
    recipe = P.with_recipe(V.v3_recipe_answers(spark, sf), "text").select("recipe_id", "recipe.*", tags.alias("tags"))
    # both prompts of a recipe from one pass
    kinds = F.array(
        F.struct(F.lit("nutrition").alias("kind"), R.nutrition_prompt("ingredients").alias("prompt")),
        F.struct(F.lit("health").alias("kind"), R.health_prompt("ingredients", "steps", "tags").alias("prompt")),
    )
    r = recipe.select(F.col("recipe_id").alias("id"), F.explode(kinds).alias("_k")).select("_k.kind", "id", "_k.prompt")
    return s.unionByName(d).unionByName(r)


# ----------------------------------------------------- blocks, payload (41, 42)
@register(
    "render_check_block",
    with_views(
        f"SELECT chat_id, seq, {S.check_block('CASE WHEN seq % 3 = 0 THEN NULL ELSE r_title END', 'content')} AS block FROM v1 WHERE has_recipe",
        "v1",
    ),
    row="41",
)
def q_render_check_block(spark, sf):
    m = V.v1_messages(spark, sf).where(F.col("meta").isNotNull())
    title = F.when(F.col("seq") % 3 == 0, F.lit(None).cast("string")).otherwise(F.col("meta.payload.recipe_detail.title"))
    return m.select("chat_id", "seq", R.render_check_block(title, F.col("content")).alias("block"))


def _json_list_sql(arr: str) -> str:
    return f"'[' || array_to_string(list_transform({arr}, lambda jx: '\"' || jx || '\"'), ',') || ']'"


@register(
    "message_payload",
    with_views(
        "SELECT chat_id, seq, '{\"payload\":{\"recipe_detail\":{\"title\":\"' || r_title || '\",\"ingredients\":' || "
        + _json_list_sql("r_ing")
        + " || ',\"steps\":' || "
        + _json_list_sql("r_steps")
        + " || '}}}' AS payload_json FROM v1 WHERE has_recipe",
        "v1",
    ),
    row="42",
)
def q_message_payload(spark, sf):
    m = V.v1_messages(spark, sf).where(F.col("meta").isNotNull())
    d = F.col("meta.payload.recipe_detail")
    payload = R.recipe_payload(d["title"], d["ingredients"], d["steps"])
    return m.select("chat_id", "seq", F.to_json(payload).alias("payload_json"))


# -------------------------------------------------------- task params (17)
_PARAM_CASE_T = "CASE task " + " ".join(f"WHEN '{t}' THEN {tp}" for t, tp, _ in K.TASK_PARAMS) + f" ELSE {K.DEFAULT_TASK_PARAMS[0]} END"
_PARAM_CASE_M = "CASE task " + " ".join(f"WHEN '{t}' THEN {mx}" for t, _, mx in K.TASK_PARAMS) + f" ELSE {K.DEFAULT_TASK_PARAMS[1]} END"


@register(
    "task_params",
    with_views(
        f"SELECT request_id, task, CAST({_PARAM_CASE_T} AS DOUBLE) AS temperature, CAST({_PARAM_CASE_M} AS BIGINT) AS max_tokens FROM v9",
        "v9",
    ),
    row="17",
)
def q_task_params(spark, sf):
    r = with_task_params(V.v9_requests(spark, sf))
    return r.select("request_id", "task", "temperature", "max_tokens")


# ----------------------------------------------------------- counters (54)
_TASK_OF_DOC = "[" + ", ".join(S.lit(t) for t in V.TASKS) + f"][query_id % {len(V.TASKS)} + 1]"


@register(
    "run_counters",
    with_views(
        f"SELECT {S.safe_lang('display_lang')} AS lang, {_TASK_OF_DOC} AS task, CAST(count(*) AS BIGINT) AS n_requests, "
        f"CAST(sum(length(coalesce(raw, ''))) AS BIGINT) AS n_chars, CAST(sum(len({S.split_lines('raw')})) AS BIGINT) AS n_lines "
        f"FROM v4 GROUP BY 1, 2",
        "v4",
    ),
    row="54",
)
def q_run_counters(spark, sf):
    q = V.v4_queries(spark, sf)
    task = F.element_at(F.array(*[F.lit(t) for t in V.TASKS]), (F.col("query_id") % len(V.TASKS)).cast("int") + 1)
    return run_counters(q.withColumn("task", task), "raw", "display_lang", "task")


@register(
    "merged_counters",
    with_views(
        f"SELECT {S.safe_lang('display_lang')} AS lang, CAST(count(*) AS BIGINT) AS n_requests, "
        "CAST(sum(length(coalesce(raw, ''))) AS BIGINT) AS n_chars, TRUE AS texts_near, TRUE AS median_near FROM v4 GROUP BY 1",
        "v4",
    ),
    row="54",
)
def q_merged_counters(spark, sf):
    """Counters stored per part and merged, with whether the sketches' estimates are near the exact figures."""
    q = V.v4_queries(spark, sf).withColumn("part", F.col("query_id") % 7)
    merged = merge_counters(counter_sketches(q, "raw", "display_lang", part="part"), "lang")
    n = F.char_length(F.coalesce("raw", F.lit("")))
    exact = q.groupBy(X.safe_lang_code("display_lang").alias("lang")).agg(
        F.count_distinct(F.coalesce("raw", F.lit(""))).alias("_n"),
        F.percentile(n, F.lit(0.45)).alias("_low"), F.percentile(n, F.lit(0.55)).alias("_high"),
    )
    near = F.abs(F.col("n_texts") - F.col("_n")) <= F.greatest(F.lit(1), 0.05 * F.col("_n"))
    median = F.col("p50").between(F.floor("_low"), F.ceil("_high"))
    return merged.join(exact, "lang").select("lang", "n_requests", "n_chars", near.alias("texts_near"), median.alias("median_near"))
