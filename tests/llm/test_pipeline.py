"""The pipeline's stages, each against what its operator says, on a table small enough to check by hand."""

import random

import pytest

from graphloom.llm import exact_dedup, jaccard, mixing, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randint(5, 50))]
        if i % 5 == 0:
            words += ["vile", "nasty"] * 2
        text = " ".join(words)
        if i % 11 == 1:
            text = rows[i - 1][1].upper()
        elif i % 13 == 2 and len(rows[i - 2][1].split()) > 40:
            text = rows[i - 2][1] + " more"
        rows.append((i, None if i == 399 else text, "en", f"s{i % 4}" if i % 17 else None, len(text)))
        labels.append((i, 1, int("vile" in text.lower())))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    expected = {
        "toxicity": lambda d: {r["doc_id"] for r in toxicity.score_documents(d, labels).filter("predicted = 0").collect()},
        "exact_dedup": lambda d: {r["doc_id"] for r in exact_dedup.exact_dedup(d).filter("kept").collect()},
        "near_dedup": lambda d: {r["doc_id"] for r in jaccard.similar_classes(d).filter("first").collect()},
        "mixing": lambda d: {r["doc_id"] for r in mixing.mix_sources(d).collect() if r["copies"] or not r["size"]},
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        path = f"{sf_dir}/{name}"
        out.write.parquet(path)
        after = spark.read.parquet(path)
        assert after.columns == COLUMNS
        kept = {r["doc_id"] for r in after.collect()}
        assert kept == expected[name](docs)
        if name != "mixing":
            assert 0 < len(kept) < docs.count()
        docs = after
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert ids.count() == docs.count()
    assert all(r["ids"][0] == 1 and r["ids"][-1] == 2 for r in ids.collect())


def test_run_repeats_itself(spark, sf_dir):
    a, b = (sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert a == b and a


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
