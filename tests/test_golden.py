"""Golden cases (FIXTURES.md §3), derived by reading the application code."""

import unicodedata

from pyspark.sql import functions as F

from recipeflow.functions import parse as P
from recipeflow.functions import render as R
from recipeflow.functions import text as X
from recipeflow.functions.text import strip_accents_py


def one(spark, col_expr, *values, schema="a string, b string"):
    rows = [tuple(v) if isinstance(v, tuple) else (v, None) for v in values]
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col_expr.alias("o")).collect()]


def test_safe_lang_code(spark):
    out = one(spark, X.safe_lang_code("a"), None, "", " EN ", "el", "gr", "zh-cn", "ur")
    assert out == ["auto", "auto", "en", "auto", "auto", "auto", "ur"]


def test_can_translate(spark):
    assert one(spark, X.can_translate("a"), "auto", "en", "el", "te") == [False, True, False, True]


def test_romanize(spark):
    assert one(spark, X.romanize_cyrillic("a"), "Борщ", "Пельмени", "Ёжик", "подъезд") == [
        "Borshch", "Pelьmeni", "Yozhik", "podъezd"
    ]
    assert one(spark, X.romanize_greek("a"), "Μουσακάς", "ψωμι") == ["Moysakάs", "psomi"]
    assert one(spark, X.romanize_kana("a"), "すし", "カレー", "とうふ", "ガ", "きゃべつ") == [
        "sushi", "kareー", "toufu", "ガ", "kiゃbetsu"
    ]


def test_strip_accents(spark):
    vals = ["Crème brûlée", "नमस्ते", "が", "ﬁ½", "йогурт", "ß", "초밥", "plain ascii"]
    out = one(spark, X.strip_accents("a"), *vals)
    assert out[:6] == ["Creme brulee", "नमसते", "か", "fi1⁄2", "иогурт", "ß"]
    assert len(out[6]) == 5 and out[6] == unicodedata.normalize("NFKD", "초밥")
    assert out[7] == "plain ascii"
    assert [strip_accents_py(v) for v in vals] == out


def test_normalize_query(spark):
    out = one(spark, X.normalize_query("a", "b"), ("Ёж", "ru"), ("Ёж", "auto"), ("Μουσακάς", "el"), (None, "fr"))
    assert out == ["Yozh", "Еж", "Μουσακας", ""]


def test_looks_like_lang(spark):
    out = one(
        spark, X.looks_like_lang("a", "b"),
        ("すしとみそしるとごはんと", "ja"), ("sushi", "ja"), ("한국어 김치 찌개 만드는 법", "ko"), ("米饭", "zh"), ("x", "fr"),
    )
    assert out == [True, False, True, False, True]


def test_post_edit(spark):
    out = one(spark, X.post_edit("a", "b"), ("スーシー 、ソース ソース", "ja"), ("수시 컵", "ko"), ("<unk>米饭 ，好", "zh"))
    assert out == ["寿司、醤油", "초밥 볼", "米饭，好"]


def test_token_budget(spark):
    out = one(spark, X.token_budget("a"), "", "x" * 1000, "x" * 1648, "x" * 4000)
    assert out == [200, 700, 1024, 1024]


def test_strip_unicode_whitespace(spark):
    assert one(spark, X.strip("a"), "　 a b \n", "\tx") == ["a b", "x"]


def test_extract_titles(spark):
    t1 = 'Here are 6 recipes:\n- **Dal Tadka**: lentils\n* Palak * Aloo Gobi\n1. "Rajma"\n\n• Chole'
    t2 = '- "A"\n- “B”\n--- \n**C: x**\n: d\nE\nF\nG\nH'
    out = one(spark, P.extract_titles("a", 6), t1, t2)
    assert out[0] == ["Here are 6 recipes", "Dal Tadka", "Palak", "Aloo Gobi", '1. "Rajma', "Chole"]
    assert out[1] == ["A", "B", "C", "E", "F", "G"]
    assert one(spark, P.extract_titles("a"), t2)[0] == ["A", "B", "C", "E", "F", "G", "H"]


def test_parse_recipe(spark):
    t1 = "Ingredients:\n- rice\nnote\n• salt\nSteps:\n1. Rinse\n2. 1.5 cups\nServe\n10. End"
    t2 = "STEPS\n1.5 cups stock\n1) Rinse\nMethodically stir\n1000. x"
    t3 = "Mix all\n- egg\nok"
    out = one(spark, P.parse_recipe("a"), t1, t2, t3)
    assert (out[0]["ingredients"], out[0]["steps"]) == (["rice", "salt"], ["Rinse", "1.5 cups", "Serve", "End"])
    assert out[1]["steps"] == ["5 cups stock", "1) Rinse", "1000. x"]
    assert (out[2]["ingredients"], out[2]["steps"]) == (["egg"], ["Mix all"])


def test_render(spark):
    assert one(spark, R.render_titles(F.array(F.lit("A"), F.lit("B"))), "x") == ['- "A"\n- "B"']
    empty = F.array().cast("array<string>")
    assert one(spark, R.render_recipe(empty, empty, F.lit("en")), "x") == ["Ingredients:\n- \n\nSteps:\n"]
    lab = R.section_labels("a")
    out = one(spark, F.struct(lab["ing"], lab["steps"]), "ja", "ru", "auto")
    assert [tuple(r) for r in out] == [("材料", "作り方"), ("Ingredients", "Steps"), ("Ingredients", "Steps")]
    assert one(spark, R.language_name("a"), "sw", "ru", None) == ["English", "Russian", "English"]
    assert one(spark, R.render_filters(empty), "x") == ["None (general healthfulness)."]
    tags = F.array(F.lit("vegan"), F.lit("allergy_soy"))
    assert one(spark, R.render_filters(tags), "x") == ["- Vegan (no animal products)\n- allergy_soy"]


def test_flatten_profile(spark):
    from recipeflow.functions import constants as K

    cols = ", ".join(f"{f} boolean" for f in K.PROFILE_FLAGS)
    row = tuple(f in ("diabetes", "vegan") for f in K.PROFILE_FLAGS) + (["Peanut", "Soy"],)
    df = spark.createDataFrame([row], f"{cols}, allergies array<string>")
    assert df.select(R.flatten_profile()).first()[0] == ["diabetes", "vegan", "allergy_peanut", "allergy_soy"]


def test_split_item_list(spark):
    assert one(spark, P.split_item_list("a"), "eggs, ,milk") == [["eggs", "milk"]]


def test_nutrition_guard(spark):
    from recipeflow.plans.jobs import nutrition_job
    from recipeflow.plans.stubs import StubGenerator

    from recipeflow.functions.render import NUTRITION_TEMPLATE

    lists = [(1, " , "), (2, "egg, milk"), (3, "egg, milk, salt")]
    df = spark.createDataFrame(lists, "list_id bigint, items string")
    out = {r.list_id: r for r in nutrition_job(df, StubGenerator()).collect()}
    assert out[1].text == "No ingredients provided." and out[1].error is None
    for k, items in ((2, ["egg", "milk"]), (3, ["egg", "milk", "salt"])):
        prompt = NUTRITION_TEMPLATE.format(items="- " + "\n- ".join(items))
        if len(prompt) % 10 == 0:
            assert out[k].text is None and out[k].error == "boom"
        else:
            assert out[k].text == "[nutrition] " + prompt
