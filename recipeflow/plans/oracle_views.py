"""DuckDB twins of the derived views in :mod:`recipeflow.sources.views`.

Each entry is a CTE body; :func:`with_views` prefixes a query with the CTEs
it names (in dependency order).
"""

from __future__ import annotations

from recipeflow.functions import constants as K
from recipeflow.functions.render import SYSTEM_PROMPT
from recipeflow.plans.sqlgen import NL, lit
from recipeflow.sources import views as V

_TS = f"(TIMESTAMP '{V.TS_BASE}' + to_seconds(turn // 2))"

VIEWS: dict[str, str] = {}

VIEWS["v1"] = f"""SELECT conv_id AS chat_id, turn AS seq, role, text AS content,
  CASE WHEN conv_id % 2 = 0 THEN strftime({_TS}, '%Y%m%dT%H%M%S') ELSE strftime({_TS}, '%Y%m%d-%H%M%S') END AS ts_raw,
  (role = 'assistant' AND conv_id % 4 <> 0) AS has_recipe,
  'Recipe ' || conv_id || '-' || turn AS r_title,
  CASE WHEN conv_id % 5 = 0 THEN []::VARCHAR[] ELSE ['item ' || turn || 'a', 'item ' || turn || 'b'] END AS r_ing,
  CASE WHEN conv_id % 10 = 0 THEN []::VARCHAR[] ELSE ['cook ' || conv_id || '-' || turn] END AS r_steps
FROM conversations"""

VIEWS["oi2"] = """SELECT DISTINCT l.l_orderkey, l.l_linenumber, p.p_name, p.p_type
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"""

_BOLD = f"'- **' || p_name || '**: ' || p_type"
_ORD2 = "ORDER BY l_linenumber, p_name, p_type"
VIEWS["v2"] = f"""SELECT l_orderkey AS answer_id,
  CASE WHEN l_orderkey % 3 = 1 THEN string_agg({_BOLD}, ' * ' {_ORD2})
       WHEN l_orderkey % 3 = 2 THEN 'Here are some recipes:' || {NL} || string_agg('- "' || p_name || '"', {NL} {_ORD2})
       ELSE string_agg({_BOLD}, {NL} {_ORD2}) END AS text
FROM oi2 GROUP BY l_orderkey"""

VIEWS["oi3"] = """SELECT l_orderkey, l_linenumber, p_name, q,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, p_name, q) AS rn
FROM (SELECT DISTINCT l.l_orderkey, l.l_linenumber, p.p_name, CAST(trunc(l.l_quantity) AS BIGINT) AS q
      FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

VIEWS["v3"] = f"""SELECT l_orderkey AS recipe_id,
  (CASE WHEN l_orderkey % 5 = 3 THEN '' ELSE 'Ingredients:' || {NL} END)
  || string_agg((CASE WHEN l_orderkey % 5 = 1 THEN '• ' ELSE '- ' END) || q || ' ' || p_name, {NL} ORDER BY rn)
  || (CASE WHEN l_orderkey % 5 = 3 THEN {NL}
           WHEN l_orderkey % 5 = 2 THEN {NL} || {NL} || 'Method:' || {NL}
           ELSE {NL} || {NL} || 'Steps:' || {NL} END)
  || string_agg((CASE WHEN l_orderkey % 5 = 3 THEN '' ELSE rn || '. ' END) || 'Add the ' || p_name, {NL} ORDER BY rn)
  || (CASE WHEN l_orderkey % 5 = 4 THEN {NL} || 'Enjoy' ELSE '' END) AS text
FROM oi3 GROUP BY l_orderkey"""

VIEWS["v4"] = """SELECT doc_id AS query_id, text AS raw,
  CASE doc_id % 7 WHEN 1 THEN ' ' || upper(lang) || ' ' WHEN 2 THEN 'el' WHEN 3 THEN NULL
       WHEN 4 THEN 'zh-cn' WHEN 5 THEN 'te' ELSE lang END AS display_lang
FROM documents"""

_FLAGS = ",\n  ".join(f"(c_custkey * {i + 3}) % 7 < 2 AS {f}" for i, f in enumerate(K.PROFILE_FLAGS))
VIEWS["v5"] = f"""SELECT c_custkey AS profile_id,
  {_FLAGS},
  CASE c_custkey % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [c_mktsegment] ELSE [c_mktsegment, 'Soy'] END AS allergies
FROM customer"""

VIEWS["v6"] = """SELECT user_id,
  CASE user_id % 3 WHEN 0 THEN user_id // 3 WHEN 1 THEN user_id + 1000000 ELSE NULL END AS chat_id
FROM (SELECT DISTINCT user_id FROM events)"""

VIEWS["v7m"] = """SELECT 'doc' || doc_id AS key, 'doc/' || doc_id AS path,
  CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 11 = 0 THEN sha256(text || '#')
       WHEN doc_id % 2 = 0 THEN upper(sha256(text)) ELSE sha256(text) END AS sha256
FROM documents"""

VIEWS["v7o"] = """SELECT 'doc/' || doc_id AS path, CAST(strlen(text) AS BIGINT) AS size, text AS content
FROM documents WHERE doc_id % 13 <> 0"""

_SYL = "[" + ", ".join(lit(s) for s in V.KANA_SYLLABLES) + "]"
_N = len(V.KANA_SYLLABLES)
_CAP = "upper(substr(p_name, 1, 1)) || substr(p_name, 2)"
VIEWS["v8"] = f"""SELECT p_partkey AS item_id,
  translate({_CAP}, '{V.LATIN_LOWER + V.LATIN_UPPER}', '{V.CYR_LOWER + V.CYR_UPPER}') AS cyr,
  translate({_CAP}, '{V.LATIN_LOWER + V.LATIN_UPPER}', '{V.GREEK_LOWER + V.GREEK_UPPER}') AS greek,
  {_SYL}[p_partkey % {_N} + 1] || {_SYL}[(p_partkey // {_N}) % {_N} + 1]
    || {_SYL}[(p_partkey // {_N * _N}) % {_N} + 1] || {_SYL}[(p_partkey * 7) % {_N} + 1] AS kana
FROM part"""

_TASKS = "[" + ", ".join(lit(t) for t in V.TASKS) + "]"
VIEWS["v9"] = f"""SELECT doc_id AS request_id, {_TASKS}[doc_id % {len(V.TASKS)} + 1] AS task,
  {lit(SYSTEM_PROMPT)} AS system, text AS prompt
FROM documents"""

DEPS = {"v2": ["oi2"], "v3": ["oi3"]}


def with_views(sql: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    order: list[str] = []
    for n in names:
        for d in DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in order]
    ctes += [f"{n} AS ({body})" for n, body in (extra or [])]
    return ("WITH " + ",\n".join(ctes) + "\n" + sql) if ctes else sql
