"""Language ID, quality classifier and the pipeline."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from poremetry.llm import decontaminate, language_id, ngram_join, quality_classifier, queries
from poremetry.workspace import scoped_tables

DATA = "/root/testdata/sf0.01"
ODD = [(-1, None), (-2, ""), (-3, "123 !!"), (-4, "é"), (-5, "word " * 30000), (-5, "word " * 30000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def odd(spark):
    return spark.createDataFrame([(i, t, 1.0, "x") for i, t in ODD], "doc_id bigint, text string, score double, lang string")


def test_language_id(spark, docs):
    net = language_id.fit(docs)
    both = language_id.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in both)
    held = [r for r in both if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in both)
    got = {r.doc_id: r for r in language_id.predict(odd(spark), net).collect()}
    assert [got[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and got[-4].lang_pred != "und" and got[-5].score > 0
    assert language_id.predict(odd(spark).where("doc_id > 0"), net).count() == 0
    assert {r.doc_id for r in language_id.keep_identified(odd(spark), net).collect()} <= {-4, -5}
    none = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.predict(docs.limit(5), none).collect()} == {"und"}


def test_look_up_tables_are_the_convolution():
    net = language_id.ByteNetwork.fresh(["a", "b"], seed=1)
    grid = np.random.default_rng(0).integers(0, language_id.CLASSES, (7, language_id.WINDOW))
    assert np.allclose(net.probabilities(grid, net.tables()), net.softmax(net.responses(grid)[0]), atol=1e-5)


def test_quality_classifier(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality_classifier.fit(docs, labels)
    scored = quality_classifier.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.93
    got = quality_classifier.score(odd(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert quality_classifier.score(odd(spark).where("doc_id > 0"), model).count() == 0
    blank = quality_classifier.fit(docs, labels.where("doc_id < 0"))
    assert {r.score for r in quality_classifier.score(odd(spark), blank).collect()} == {0.5}


def test_gradient_of_attention():
    """One step along the gradient lowers the loss as finite differences say."""
    rng = np.random.default_rng(3)
    x, owner, y = rng.normal(size=(40, quality_classifier.FEATURES)), np.sort(rng.integers(0, 8, 40)), rng.integers(0, 2, 8).astype(float)
    owner[:8] = np.arange(8)
    model = quality_classifier.GatedAttention.fresh(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    loss = lambda: -np.mean(y * np.log(p := model.scores(x, owner, 8)) + (1 - y) * np.log(1 - p))
    before = loss()
    model.train(x, owner, y)
    assert loss() < 0.5 * before


def test_pipeline_stage_by_stage(spark, docs):
    """Each stage against a plain version of its decision on the stage's own input."""
    with scoped_tables(spark):
        given = docs.where("doc_id < 300").union(docs.where("doc_id < 3"))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, DATA).persist()
            assert out.columns == docs.columns
            before, after = [r.doc_id for r in given.collect()], [r.doc_id for r in out.collect()]
            if name == "language_id":
                want = [r.doc_id for r in language_id.predict(given, language_id.fit(given)).where("lang_pred <> 'und' AND score >= 0.4").collect()]
            elif name == "quality_classifier":
                model = quality_classifier.fit(given, spark.read.parquet(f"{DATA}/labels.parquet"))
                want = [r.doc_id for r in quality_classifier.score(given, model).where("predicted = 1").collect()]
            elif name == "ngram_jaccard":
                want = list({r.doc_id for r in ngram_join.join(given).where("doc_id = component_id").collect()})
            else:
                leaks = {r.doc_id for r in decontaminate.find(given, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
                want = [i for i in before if i not in leaks]
            assert sorted(after) == sorted(want) and set(after) <= set(before)
            given = out
        last = corpus_pipeline.STAGES[-1][1](spark, given, DATA)
        assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == given.count()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 14)) and "pipeline" in queries.QUERIES


def test_one_labelled_id_with_many_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_classifier.GatedAttention, "train", lambda self, x, owner, target: seen.append((len(set(owner.tolist())), target.tolist())))
    fold = spark.range(60).where(~language_id.held_out(F.col("id"))).select("id").collect()
    ids = [r.id for r in fold][:10]
    rows = [(ids[0], f"text {k}") for k in range(200)] + [(i, f"other {i}") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i != ids[0])) for i in ids], "doc_id bigint, quality int")
    quality_classifier.fit(docs, labels)
    assert seen[0][0] == 10 and sorted(seen[0][1]) == [0.0] + [1.0] * 9
