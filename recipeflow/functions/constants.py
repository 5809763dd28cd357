"""Lookup tables and literals.

FIXED VALUES.  Everything in this module must equal the values of the original
recipe-chat application for results to match: language sets, transliteration
tables, labels, fixed phrase corrections, sampling parameters and default
answers.  They are written plainly, in their natural order, and are only read
by the builders in the sibling modules.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: language codes
# ---------------------------------------------------------------------------

# Codes accepted from a user ("auto" = unknown).
SUPPORTED_LANGS = (
    "auto", "en", "fr", "de", "es", "it", "pt", "ru", "ja", "ko", "zh", "th", "tr", "vi",
    "hi", "bn", "mr", "ta", "te", "gu", "kn", "ml", "pa",
    "sw", "lg", "ln", "rw", "so", "am", "ha", "yo", "zu", "xh", "st", "sn", "ne", "si", "ur",
)

# Codes the machine translator is asked to handle.
MT_LANGS = (
    "en", "fr", "de", "es", "it", "pt", "ru", "ja", "ko", "zh", "tr", "vi", "th",
    "hi", "bn", "mr", "ta", "te", "gu", "kn", "ml", "pa", "ur",
    "sw", "lg", "ln", "yo", "am", "ha", "so", "ne", "si", "rw", "sn", "zu", "xh", "st",
)

# Codes normalised by accent stripping alone.
LATIN_LANGS = ("auto", "en", "fr", "de", "es", "it", "pt", "tr", "vi")

# Display names (default "English").
LANG_NAMES = {
    "en": "English", "ja": "Japanese", "ko": "Korean", "zh": "Chinese",
    "hi": "Hindi", "fr": "French", "de": "German", "es": "Spanish",
    "it": "Italian", "pt": "Portuguese", "tr": "Turkish", "vi": "Vietnamese",
    "th": "Thai", "ru": "Russian",
}

# Localised (ingredients heading, steps heading); default English.
SECTION_LABELS = {
    "ja": ("材料", "作り方"),
    "hi": ("सामग्री", "विधि"),
    "zh": ("食材", "做法"),
    "ko": ("재료", "만드는 법"),
    "es": ("Ingredientes", "Pasos"),
    "fr": ("Ingrédients", "Étapes"),
    "de": ("Zutaten", "Zubereitung"),
    "it": ("Ingredienti", "Preparazione"),
    "pt": ("Ingredientes", "Modo de preparo"),
    "tr": ("Malzemeler", "Adımlar"),
    "vi": ("Nguyên liệu", "Cách làm"),
    "th": ("ส่วนผสม", "วิธีทำ"),
}
DEFAULT_SECTION_LABELS = ("Ingredients", "Steps")

# ---------------------------------------------------------------------------
# FIXED VALUES: transliteration tables
# ---------------------------------------------------------------------------

CYRILLIC_TO_LATIN = {
    "А": "A", "Б": "B", "В": "V", "Г": "G", "Д": "D", "Е": "E", "Ё": "Yo", "Ж": "Zh", "З": "Z",
    "И": "I", "Й": "Y", "К": "K", "Л": "L", "М": "M", "Н": "N", "О": "O", "П": "P", "Р": "R",
    "С": "S", "Т": "T", "У": "U", "Ф": "F", "Х": "Kh", "Ц": "Ts", "Ч": "Ch", "Ш": "Sh",
    "Щ": "Shch", "Ы": "Y", "Э": "E", "Ю": "Yu", "Я": "Ya",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z",
    "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ы": "y", "э": "e", "ю": "yu", "я": "ya",
}

GREEK_TO_LATIN = {
    "Α": "A", "Β": "V", "Γ": "G", "Δ": "D", "Ε": "E", "Ζ": "Z", "Η": "I", "Θ": "Th", "Ι": "I",
    "Κ": "K", "Λ": "L", "Μ": "M", "Ν": "N", "Ξ": "X", "Ο": "O", "Π": "P", "Ρ": "R", "Σ": "S",
    "Τ": "T", "Υ": "Y", "Φ": "F", "Χ": "Ch", "Ψ": "Ps", "Ω": "O",
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i",
    "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s",
    "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}

KANA_TO_LATIN = {
    # hiragana
    "あ": "a", "い": "i", "う": "u", "え": "e", "お": "o",
    "か": "ka", "き": "ki", "く": "ku", "け": "ke", "こ": "ko",
    "さ": "sa", "し": "shi", "す": "su", "せ": "se", "そ": "so",
    "た": "ta", "ち": "chi", "つ": "tsu", "て": "te", "と": "to",
    "な": "na", "に": "ni", "ぬ": "nu", "ね": "ne", "の": "no",
    "は": "ha", "ひ": "hi", "ふ": "fu", "へ": "he", "ほ": "ho",
    "ま": "ma", "み": "mi", "む": "mu", "め": "me", "も": "mo",
    "や": "ya", "ゆ": "yu", "よ": "yo",
    "ら": "ra", "り": "ri", "る": "ru", "れ": "re", "ろ": "ro",
    "わ": "wa", "を": "o", "ん": "n",
    "が": "ga", "ぎ": "gi", "ぐ": "gu", "げ": "ge", "ご": "go",
    "ざ": "za", "じ": "ji", "ず": "zu", "ぜ": "ze", "ぞ": "zo",
    "だ": "da", "ぢ": "ji", "づ": "zu", "で": "de", "ど": "do",
    "ば": "ba", "び": "bi", "ぶ": "bu", "べ": "be", "ぼ": "bo",
    "ぱ": "pa", "ぴ": "pi", "ぷ": "pu", "ぺ": "pe", "ぽ": "po",
    # katakana (unvoiced only)
    "ア": "a", "イ": "i", "ウ": "u", "エ": "e", "オ": "o",
    "カ": "ka", "キ": "ki", "ク": "ku", "ケ": "ke", "コ": "ko",
    "サ": "sa", "シ": "shi", "ス": "su", "セ": "se", "ソ": "so",
    "タ": "ta", "チ": "chi", "ツ": "tsu", "テ": "te", "ト": "to",
    "ナ": "na", "ニ": "ni", "ヌ": "nu", "ネ": "ne", "ノ": "no",
    "ハ": "ha", "ヒ": "hi", "フ": "fu", "ヘ": "he", "ホ": "ho",
    "マ": "ma", "ミ": "mi", "ム": "mu", "メ": "me", "モ": "mo",
    "ヤ": "ya", "ユ": "yu", "ヨ": "yo",
    "ラ": "ra", "リ": "ri", "ル": "ru", "レ": "re", "ロ": "ro",
    "ワ": "wa", "ヲ": "o", "ン": "n",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: script detection ranges
# ---------------------------------------------------------------------------

SNIFF_MIN = 10
JA_CLASS = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}]"
ZH_KO_CLASS = "[\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}\\x{AC00}-\\x{D7AF}\\x{3400}-\\x{9FFF}]"
LATIN_LETTER_CLASS = "[A-Za-z]"

# ---------------------------------------------------------------------------
# FIXED VALUES: machine-translation post edits, applied in this order
# ---------------------------------------------------------------------------

POST_EDIT_JA = (
    ("スーシー", "寿司"),
    ("ソース ソース", "醤油"),
    ("ソースソース", "醤油"),
    ("ナイジェリ", "にぎり"),
    ("カクマー", "きゅうり"),
    ("サルモン", "サーモン"),
)
POST_EDIT_KO = (
    ("수시", "초밥"),
    ("컵", "볼"),
    ("마리화나", "재워"),
)
POST_EDIT_ZH_CODES = ("zh", "zh-cn", "zh-tw")
POST_EDIT_ZH_DROP = "<unk>"
JA_PUNCT = "、。・"
ZH_PUNCT = "，。；：、"

# ---------------------------------------------------------------------------
# FIXED VALUES: dietary profile flags (in output order) and their labels
# ---------------------------------------------------------------------------

PROFILE_FLAGS = (
    "diabetes", "hypertension", "low_sodium", "vegetarian", "vegan", "gluten_free",
    "dairy_free", "keto", "paleo", "heart_health", "renal", "weight_loss",
    "high_protein", "low_fat", "low_carb", "pregnancy", "children", "senior",
)
ALLERGY_PREFIX = "allergy_"

FILTER_LABELS = {
    "diabetes": "Diabetes (focus: lower added sugar / slower glycemic impact)",
    "hypertension": "Hypertension (focus: lower sodium)",
    "low_sodium": "Low Sodium",
    "vegetarian": "Vegetarian (no meat/fish, allow dairy/eggs)",
    "vegan": "Vegan (no animal products)",
    "gluten_free": "Gluten-Free (no wheat, barley, rye)",
    "dairy_free": "Dairy-Free",
    "keto": "Keto/Very Low Carb",
    "paleo": "Paleo",
    "heart_health": "Heart-Healthy (lower sat fat, more fiber)",
    "renal": "Renal-Friendly (watch potassium, phosphorus, sodium)",
    "weight_loss": "Weight Loss",
    "high_protein": "High Protein",
    "low_fat": "Low Fat",
    "low_carb": "Low Carb",
    "pregnancy": "Pregnancy-Safe",
    "children": "Kid-Friendly",
    "senior": "Senior-Friendly",
}
NO_FILTERS_TEXT = "None (general healthfulness)."

# ---------------------------------------------------------------------------
# FIXED VALUES: generation parameters per task
# (task, temperature, max_tokens); top_p, repeat_penalty and seed are shared
# ---------------------------------------------------------------------------

TASK_PARAMS = (
    ("suggest", 0.5, 220),
    ("detail", 0.4, 700),
    ("nutrition", 0.2, 300),
    ("health", 0.25, 600),
)
DEFAULT_TASK_PARAMS = (0.3, 512)
TOP_P = 0.95
REPEAT_PENALTY = 1.1
SEED = 0

# ---------------------------------------------------------------------------
# FIXED VALUES: limits
# ---------------------------------------------------------------------------

MAX_TITLES = 6
MAX_INGREDIENTS = 40
MAX_STEPS = 20
TOKEN_BUDGET_CAP = 1024
TOKEN_BUDGET_BASE = 200
ASSET_MIN_BYTES = 1024

# ---------------------------------------------------------------------------
# FIXED VALUES: answers used when generation fails
# ---------------------------------------------------------------------------

DEFAULT_TITLES_TEXT = (
    "- Vegetarian Sushi Roll\n- Salmon Sushi Bowls\n- Maki-zushi\n"
    "- Temaki Hand Rolls\n- Sushi Rice\n- Tofu Sushi Cake"
)
DEFAULT_INGREDIENTS = (
    "2 cups sushi rice", "2 1/2 cups water", "1/2 cup rice vinegar",
    "2 tbsp sugar", "1 tsp salt", "nori sheets", "fillings of choice",
)
DEFAULT_STEPS = (
    "Rinse rice until water is clear; drain.",
    "Cook rice with water; rest 10 min.",
    "Warm vinegar, sugar, salt; fold into rice.",
    "Roll with nori and fillings; slice and serve.",
)

# ---------------------------------------------------------------------------
# FIXED VALUES: chat log
# ---------------------------------------------------------------------------

DEFAULT_CHAT_TITLE = "Ingredients"
TS_FORMAT_CURRENT = "yyyyMMdd'T'HHmmss"
TS_FORMAT_OLDER = "yyyyMMdd-HHmmss"
SELECTED_RECIPE_PREFIX = "Selected recipe: "
CHECK_BLOCK_PREFIX = "🩺 Health Check for: "
CHECK_BLOCK_DEFAULT_TITLE = "current recipe"
NO_INGREDIENTS_TEXT = "No ingredients provided."

# Python's str.isspace() set, as code points (used for strip / split).
WHITESPACE_CODEPOINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
# Python's str.splitlines() boundaries ("\r\n" counts once).
LINE_BREAK_CODEPOINTS = (0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029)
