"""DuckDB SQL builders for the correctness oracle.

These write each operator a second time, in plain SQL, so that the driver can
compare the Spark result with an independent evaluation on the same parquet
tables.  Only the fixed value tables are shared with the Spark side.
"""

from __future__ import annotations

from recipeflow.functions import constants as K
from recipeflow.functions import render as R

NL = "chr(10)"


def lit(s: str) -> str:
    """A DuckDB string literal; newlines become chr(10) concatenations."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + f" || {NL} || ".join(quoted) + ")" if len(parts) > 1 else quoted[0]


def str_list(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]::VARCHAR[]"


WS_CHARS_SQL = "(" + " || ".join(f"chr({cp})" for cp in K.WHITESPACE_CODEPOINTS) + ")"
WS_RE = "[" + "".join("\\x{%X}" % cp for cp in K.WHITESPACE_CODEPOINTS) + "]"
LB_RE = "\\r\\n|[" + "".join("\\x{%X}" % cp for cp in K.LINE_BREAK_CODEPOINTS) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {WS_CHARS_SQL})"


def in_list(x: str, items) -> str:
    return f"({x} IN ({', '.join(lit(i) for i in items)}))"


def safe_lang(x: str) -> str:
    c = "lower(" + strip(f"coalesce({x}, '')") + ")"
    return f"(CASE WHEN {in_list(c, K.SUPPORTED_LANGS)} THEN {c} ELSE 'auto' END)"


def can_translate(x: str) -> str:
    return f"coalesce({in_list(x, K.MT_LANGS)}, false)"


def case_map(x: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {x} {whens} ELSE {default} END)"


def replace_chain(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


def romanize(x: str, table: dict) -> str:
    return replace_chain(x, table.items())


def split_lines(x: str, v: str = "ln") -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '{LB_RE}'), "
        f"lambda {v}: {strip(v)}), lambda {v}: {v} <> '')"
    )


def language_name(code: str) -> str:
    return f"coalesce({case_map(safe_lang(code), K.LANG_NAMES, 'NULL')}, 'English')"


def section_label(code: str, idx: int) -> str:
    m = {k: v[idx] for k, v in K.SECTION_LABELS.items()}
    return case_map(safe_lang(code), m, lit(K.DEFAULT_SECTION_LABELS[idx]))


def filter_label(t: str) -> str:
    return case_map(t, K.FILTER_LABELS, t)


def flatten_profile(alias: str = "") -> str:
    p = alias + "." if alias else ""
    flags = ", ".join(f"CASE WHEN coalesce({p}{f}, false) THEN {lit(f)} END" for f in K.PROFILE_FLAGS)
    return (
        f"list_concat(list_filter([{flags}], lambda fx: fx IS NOT NULL), "
        f"list_transform(coalesce({p}allergies, []::VARCHAR[]), lambda ax: lower('{K.ALLERGY_PREFIX}' || ax)))"
    )


def render_filters(tags: str) -> str:
    lines = f"array_to_string(list_transform({tags}, lambda tg: '- ' || {filter_label('tg')}), {NL})"
    return f"(CASE WHEN len(coalesce({tags}, []::VARCHAR[])) = 0 THEN {lit(K.NO_FILTERS_TEXT)} ELSE {lines} END)"


def bullets(arr: str) -> str:
    return f"('- ' || array_to_string({arr}, {NL} || '- '))"


def numbered(arr: str) -> str:
    return f"array_to_string(list_transform({arr}, lambda sx, ix: CAST(ix AS VARCHAR) || '. ' || sx), {NL})"


def render_titles(arr: str) -> str:
    return f"array_to_string(list_transform({arr}, lambda tx: '- \"' || tx || '\"'), {NL})"


def render_recipe(ing: str, steps: str, code: str) -> str:
    return (
        f"({section_label(code, 0)} || ':' || {NL} || {bullets(ing)} || {NL} || {NL} || "
        f"{section_label(code, 1)} || ':' || {NL} || {numbered(steps)})"
    )


# --------------------------------------------------------------------------
# accents, transliteration, sniffing, post edit
# --------------------------------------------------------------------------


def strip_accents(x: str) -> str:
    return f"strip_accents({x})"


def normalize_query(text: str, lang: str) -> str:
    code = safe_lang(lang)
    s = f"coalesce({text}, '')"
    return (
        f"(CASE WHEN {s} = '' THEN '' "
        f"WHEN {code} = 'ru' THEN {romanize(s, K.CYRILLIC_TO_LATIN)} "
        f"WHEN {code} IN ('el', 'gr') THEN {romanize(s, K.GREEK_TO_LATIN)} "
        f"WHEN {code} = 'ja' THEN {romanize(s, K.KANA_TO_LATIN)} "
        f"ELSE {strip_accents(s)} END)"
    )


def looks_like_lang(text: str, code: str) -> str:
    t = f"coalesce({text}, '')"
    ja = f"len(regexp_extract_all({t}, '{K.JA_CLASS}'))"
    lat = f"len(regexp_extract_all({t}, '{K.LATIN_LETTER_CLASS}'))"
    zk = f"len(regexp_extract_all({t}, '{K.ZH_KO_CLASS}'))"
    return (
        f"(CASE WHEN {code} = 'ja' THEN ({ja} >= {K.SNIFF_MIN} AND {ja} > {lat}) "
        f"WHEN {code} IN ('zh', 'ko') THEN {zk} >= {K.SNIFF_MIN} ELSE true END)"
    )


def post_edit(s: str, code: str) -> str:
    ja = f"regexp_replace({replace_chain(s, K.POST_EDIT_JA)}, '{WS_RE}+([{K.JA_PUNCT}])', '\\1', 'g')"
    ko = replace_chain(s, K.POST_EDIT_KO)
    zh = f"regexp_replace(replace({s}, {lit(K.POST_EDIT_ZH_DROP)}, ''), '{WS_RE}+([{K.ZH_PUNCT}])', '\\1', 'g')"
    return (
        f"(CASE WHEN {s} IS NULL OR {s} = '' THEN {s} WHEN {code} = 'ja' THEN {ja} "
        f"WHEN {code} = 'ko' THEN {ko} WHEN {in_list(code, K.POST_EDIT_ZH_CODES)} THEN {zh} ELSE {s} END)"
    )


def token_budget(text: str) -> str:
    return f"CAST(least({K.TOKEN_BUDGET_CAP}, length(coalesce({text}, '')) // 2 + {K.TOKEN_BUDGET_BASE}) AS BIGINT)"


# --------------------------------------------------------------------------
# titles and recipes
# --------------------------------------------------------------------------


def clean_title(x: str) -> str:
    s = f"regexp_replace({x}, '^[-*\\x{{2022}}]+{WS_RE}*', '')"
    s = strip(f"replace({s}, '**', '')")
    s = strip(f"split_part({s}, ':', 1)")
    return f"trim({s}, ' \"“”')"


def extract_titles(text: str, limit: int | None = None) -> str:
    pieces = (
        f"flatten(list_transform({split_lines(text)}, lambda lt: CASE WHEN contains(lt, ' * ') THEN "
        f"list_filter(list_transform(string_split(lt, ' * '), lambda px: {strip('px')}), lambda px: px <> '') "
        f"ELSE [lt] END))"
    )
    titles = f"list_filter(list_transform({pieces}, lambda cx: {clean_title('cx')}), lambda cx: cx <> '')"
    return titles if limit is None else f"list_slice({titles}, 1, {limit})"


def is_bullet(s: str) -> str:
    return f"(starts_with({s}, '-') OR starts_with({s}, '•'))"


def bullet_item(s: str) -> str:
    return strip(f"regexp_replace({s}, '^[-\\x{{2022}} ]+', '')")


def heading_kind(s: str) -> str:
    low = f"lower({s})"
    return (
        f"(CASE WHEN starts_with({low}, 'ingredients') THEN 1 "
        f"WHEN starts_with({low}, 'steps') OR starts_with({low}, 'method') THEN 2 ELSE 0 END)"
    )


def step_text(s: str) -> str:
    numbered_ = f"(regexp_matches({s}, '^\\p{{Nd}}') AND instr(substring({s}, 1, 4), '.') > 0)"
    return f"(CASE WHEN {numbered_} THEN {strip(f'regexp_replace({s}, {chr(39)}^[^.]*[.]{chr(39)}, {chr(39)}{chr(39)})')} ELSE {s} END)"


def parse_recipe_ctes(src: str, key: str, text: str, prefix: str, fallback: bool = True, primary: bool = True) -> str:
    """CTEs ``{prefix}_rec(key, ingredients, steps)`` over every key of ``src``.

    Window form of the section state machine: the section of a line is the
    kind of the last heading line before it.
    """
    p = prefix
    ctes = [
        f"{p}_l AS (SELECT {key} AS k, u.ln AS s, u.pos AS pos FROM {src}, "
        f"unnest({split_lines(text)}) WITH ORDINALITY AS u(ln, pos))",
        f"{p}_k AS (SELECT k, s, pos, {heading_kind('s')} AS kind FROM {p}_l)",
        f"{p}_s AS (SELECT k, s, pos, kind, last_value(CASE WHEN kind > 0 THEN kind END IGNORE NULLS) OVER "
        f"(PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sec FROM {p}_k)",
        f"{p}_g AS (SELECT k, "
        f"list({bullet_item('s')} ORDER BY pos) FILTER (WHERE kind = 0 AND sec = 1 AND {is_bullet('s')}) AS ing, "
        f"list({step_text('s')} ORDER BY pos) FILTER (WHERE kind = 0 AND sec = 2 AND {step_text('s')} <> '') AS st "
        f"FROM {p}_s GROUP BY k)",
        f"{p}_p AS (SELECT {src}.{key} AS k, coalesce(g.ing, []::VARCHAR[]) AS ingredients, "
        f"coalesce(g.st, []::VARCHAR[]) AS steps FROM {src} LEFT JOIN {p}_g g ON g.k = {src}.{key})",
        f"{p}_f AS (SELECT {key} AS k, "
        f"list_transform(list_filter({split_lines(text, 'fl')}, lambda fl: {is_bullet('fl')}), lambda fl: {bullet_item('fl')}) AS ingredients, "
        f"list_filter({split_lines(text, 'fs')}, lambda fs: NOT {is_bullet('fs')} AND length(fs) > 2) AS steps FROM {src})",
    ]
    if primary and fallback:
        ctes.append(
            f"{p}_rec AS (SELECT a.k AS k, CASE WHEN len(a.ingredients) = 0 AND len(a.steps) = 0 THEN b.ingredients ELSE a.ingredients END AS ingredients, "
            f"CASE WHEN len(a.ingredients) = 0 AND len(a.steps) = 0 THEN b.steps ELSE a.steps END AS steps "
            f"FROM {p}_p a JOIN {p}_f b ON a.k = b.k)"
        )
    elif primary:
        ctes.append(f"{p}_rec AS (SELECT k, ingredients, steps FROM {p}_p)")
    else:
        ctes.append(f"{p}_rec AS (SELECT k, ingredients, steps FROM {p}_f)")
    return ",\n".join(ctes)


# --------------------------------------------------------------------------
# prompts
# --------------------------------------------------------------------------


def fill(template: str, **slots: str) -> str:
    parts = [f"{lit(text)}" + (f" || {slots[slot]}" if slot is not None else "") for text, slot in R.template_parts(template)]
    return "(" + " || ".join(parts) + ")"


def suggest_prompt(q: str) -> str:
    return fill(R.SUGGEST_TEMPLATE, query=f"coalesce({q}, '')")


def detail_prompt(t: str) -> str:
    return fill(R.DETAIL_TEMPLATE, title=f"coalesce({t}, '')")


def nutrition_prompt(items: str) -> str:
    return f"(CASE WHEN len({items}) > 0 THEN {fill(R.NUTRITION_TEMPLATE, items=bullets(items))} END)"


def health_prompt(ing: str, steps: str, filters: str) -> str:
    return fill(
        R.HEALTH_TEMPLATE,
        ingredients=bullets(f"coalesce({ing}, []::VARCHAR[])"),
        steps=numbered(f"coalesce({steps}, []::VARCHAR[])"),
        filters=render_filters(filters),
    )


def check_block(title: str, text: str) -> str:
    return (
        f"({lit(K.CHECK_BLOCK_PREFIX)} || coalesce(nullif({title}, ''), {lit(K.CHECK_BLOCK_DEFAULT_TITLE)}) || "
        f"{NL} || {NL} || coalesce({text}, ''))"
    )


# --------------------------------------------------------------------------
# stub models (twins of recipeflow.plans.stubs)
# --------------------------------------------------------------------------

TOKENIZER_LANGS = tuple(c for c in K.MT_LANGS if c not in ("te", "rw", "sn", "st"))


def stub_fails(prompt: str) -> str:
    return f"(length({prompt}) % 10 = 0)"


def stub_generate(task: str, prompt: str) -> str:
    nl_b = f"{NL} || '- '"
    return (
        f"(CASE WHEN {stub_fails(prompt)} THEN NULL "
        f"WHEN {task} = 'suggest' THEN '- ' || replace({prompt}, {NL}, {nl_b}) "
        f"WHEN {task} = 'detail' THEN 'Ingredients:' || {NL} || '- ' || replace({prompt}, {NL}, {nl_b}) || "
        f"{NL} || {NL} || 'Steps:' || {NL} || '1. ' || replace({prompt}, {NL}, {NL} || '2. ') "
        f"ELSE '[' || {task} || '] ' || {prompt} END)"
    )


def stub_translate_fails(src: str, tgt: str) -> str:
    return f"(NOT {in_list(tgt, TOKENIZER_LANGS)} OR NOT {in_list(src, TOKENIZER_LANGS)})"


def stub_translate(text: str, tgt: str) -> str:
    return f"('<' || {tgt} || '>' || {text})"
