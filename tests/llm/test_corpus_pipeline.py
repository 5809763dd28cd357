"""The pipeline's stages on planted cases, nulls, repeated rows, clashing columns and empty tables."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from recipeflow.llm import order_minhash
from recipeflow.session import ship_package, stage, work_dir

SYLLABLES = "ba ce di fo gu ha ke li mo nu pa re si to vu".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    ship_package(spark)
    rng = random.Random(1)
    item = prose(rng, 40)
    rows = [(i, prose(rng, 60 + i)) for i in range(60)]
    rows += [(100 + i, rows[3][1].replace(" ", "  ")) for i in range(8)]  # equal but for white space
    near = rows[5][1].split()
    near[7:9] = ["edited"]
    rows += [(120, " ".join(near)), (130, prose(rng, 30) + " " + item + " " + prose(rng, 30))]
    rows += [(140, f"{prose(rng, 20)} zorgblat you zorgblat"), (150, None), (151, ""), (6, rows[6][1]), (None, prose(rng, 50))]
    rows += [(200 + i, f"{prose(rng, 25)} zorgblat {prose(rng, 10)}") for i in range(40)]
    labels = [(200 + i, 1, 1) for i in range(40)] + [(i, 1, 0) for i in range(60)]
    path = work_dir(spark, "pipeline-tables")
    full = [(i, t, "xx", "s", len(t or ""), "clash") for i, t in rows]
    columns = "doc_id long, text string, lang string, source string, n_chars long, _digest string"
    spark.createDataFrame(full, columns).write.parquet(path + "/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(path + "/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(path + "/benchmark.parquet")
    return path, rows


def test_planted_cases(spark, tables):
    path, rows = tables
    docs = spark.read.parquet(path + "/documents.parquet")
    names = docs.columns
    kept = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = stage(function(spark, docs, path), "test-" + name)
        assert docs.columns == names
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    clean = {i for i, _ in rows if i is None or i < 60}
    assert clean <= {i for i, _ in kept["decontamination"]}  # clean documents stay
    assert not any(t and "zorgblat" in t for _, t in kept["toxicity"])
    texts = [" ".join((t or "").split()) for _, t in kept["exact_dedup"]]
    assert len(texts) == len(set(texts)) and {" ".join((t or "").split()) for _, t in kept["toxicity"]} == set(texts)
    assert sorted(i for i, _ in kept["exact_dedup"] if i in range(3, 110) and (i == 3 or i >= 100)) == [3]
    near = [(t or "").lower().split() for _, t in kept["near_dedup"]]
    assert not any(order_minhash.edit_similarity(a, b, 0.8) for i, a in enumerate(near) for b in near[:i] if a and b)
    assert 120 not in {i for i, _ in kept["near_dedup"]} and 130 not in {i for i, _ in kept["decontamination"]}

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    size = {}
    for i, t in kept["decontamination"]:
        size[i] = size.get(i, 0) + len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    found, sequences = {}, {}
    for r in packed:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert found == size
    for pieces in sequences.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and pieces[0][0] == 0
        assert sum(n for _, n in pieces) <= corpus_pipeline.SEQUENCE_TOKENS


def test_stages_of_an_empty_table(spark, tables):
    path, _ = tables
    docs = spark.read.parquet(path + "/documents.parquet").where("false")
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, path).count() == 0


def test_run(spark, tables):
    path, _ = tables
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 50
