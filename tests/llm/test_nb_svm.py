import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.llm import nb_svm
from mosaiq.llm.queries import op12_nb_svm


def test_dual_solution_is_optimal():
    """No other weights do better."""
    r = np.random.default_rng(3)
    scale = r.normal(size=40)
    x = [np.flatnonzero(r.random(40) < 0.3) for _ in range(80)]
    y = np.where(np.array([scale[i].sum() for i in x]) + r.normal(size=80) > 0, 1, -1)
    for cost in (0.05, 1.0):
        w, bias = nb_svm.fit_hinge(x, y, scale, cost, passes=3000)
        dense = np.zeros((80, 41))
        for k, i in enumerate(x):
            dense[k, i] = scale[i]
        dense[:, 40] = 1
        v = np.append(w / scale, bias)
        primal = v @ v / 2 + cost * np.maximum(0, 1 - y * (dense @ v)).sum()
        # the objective is convex: no step nearby may lower it
        best = min(primal, *(0.5 * (u := v + r.normal(size=41) * s) @ u + cost * np.maximum(0, 1 - y * (dense @ u)).sum() for s in (1e-4, 1e-3, 1e-2, 0.1) for _ in range(500)))
        assert primal <= best * (1 + 1e-9)


def test_ratios_and_counts(spark):
    docs = spark.createDataFrame([(1, "Aa b."), (2, "AA!! BB!!"), (3, "x x x"), (3, "x x x"), (None, "zz"), (5, "no label")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 1), (None, 1), (9, 1), (5, None), (5, 7)], "doc_id long, quality int")
    rows = nb_svm.labelled(nb_svm.featurize(docs), labels, "doc_id", "quality", None)
    n, counts = nb_svm.class_counts(rows)
    expected = np.zeros((2, nb_svm.DIMENSIONS))
    for text, y in [("Aa b.", 1), ("AA!! BB!!", 0), *[("x x x", y) for y in (0, 1) for _ in range(2)]]:
        expected[y, nb_svm.features(text)] += 1
    assert n.tolist() == [3, 3] and (counts == expected).all()
    p, q = expected[1] + 1, expected[0] + 1
    assert np.allclose(nb_svm.log_ratios(counts), np.log((p / p.sum()) / (q / q.sum())))


def test_features():
    assert len(nb_svm.features(None)) == len(nb_svm.features("")) == 0
    assert (nb_svm.features("Hello there.") == nb_svm.features("Other wordings.")).all()
    assert set(nb_svm.features("one one")) - set(nb_svm.features("one two"))
    assert len(nb_svm.features("word " * 200_000 + "🎉")) < 100


@pytest.fixture(scope="module")
def scored(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return op12_nb_svm(spark, folder).join(labels, "doc_id", "left").collect()


def test_held_out_quality(scored):
    assert len(scored) == 1000
    held = [r for r in scored if r["held_out"] and r["quality"] is not None]
    assert len(held) > 50 and {r["quality"] for r in held} == {0, 1}
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored)


def test_labels_alone_decide_and_only_those_learned_from(spark, tmp_path):
    """Flipping every label that is held out, and all other columns, changes nothing."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    flipped = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    labels.withColumn("quality", flipped).withColumn("toxic", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    a, b = (sorted(tuple(r) for r in op12_nb_svm(spark, str(f)).collect()) for f in (folder, tmp_path))
    assert a == b


def test_edges(spark, empty, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    found = nb_svm.featurize(clashing)
    model = nb_svm.train(found, none)
    assert {r["score"] for r in nb_svm.score(found, model).collect()} == {0.5}
    one = nb_svm.train(found, spark.createDataFrame([(0, 0), (2, 0)], "doc_id long, quality int"))
    assert {r["score"] for r in nb_svm.score(found, one).collect()} == {0.0}
    assert nb_svm.score(nb_svm.featurize(empty), model).count() == 0
    two = nb_svm.train(found, spark.createDataFrame([(0, 1), (15, 0)], "doc_id long, quality int"))
    assert nb_svm.score(found, two).count() == clashing.count()
