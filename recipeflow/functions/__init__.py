"""Column -> Column functions (narrow; no exchange)."""

from recipeflow.functions.parse import (  # noqa: F401
    cap_recipe,
    extract_titles,
    parse_recipe,
    parse_recipe_fallback,
    parse_recipe_primary,
    raw_lines,
    split_item_list,
    split_lines,
    top_n,
)
from recipeflow.functions.render import (  # noqa: F401
    filter_labels,
    flatten_profile,
    language_name,
    render_check_block,
    render_filters,
    render_recipe,
    render_titles,
    section_labels,
)
from recipeflow.functions.text import (  # noqa: F401
    can_translate,
    looks_like_lang,
    normalize_query,
    post_edit,
    post_edit_array,
    romanize_cyrillic,
    romanize_greek,
    romanize_kana,
    safe_lang_code,
    strip,
    strip_accents,
    token_budget,
)
