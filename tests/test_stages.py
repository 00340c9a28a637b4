from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from equipoise.operators.models import FEATURES, FeatureScore
from equipoise.operators.stages import CodedFeatures, CodedFeaturesModel


def _rows(spark):
    rows = [(i, i % 2, None if i == 3 else float(i), None if i == 5 else "abc"[i % 3], i * 7 % 4) for i in range(60)]
    return spark.createDataFrame(rows, "id long, label int, x double, t string, k long")


def _scores(model, df):
    out = model.transform(df).select("id", F.col(FEATURES).alias("v"), vector_to_array("probability").alias("p"))
    return {r["id"]: (r["v"].toArray().tolist(), r["p"]) for r in out.collect()}


def test_pipeline_is_saved_and_scores_alike(spark, tmp_path):
    df = _rows(spark)
    new = spark.createDataFrame([(900, None, None, "unseen", None), (901, 1, 1e9, None, 2)], df.schema)
    for name, last in (("logit", LogisticRegression(featuresCol=FEATURES)), ("plain", FeatureScore(0))):
        pipe = Pipeline(stages=[CodedFeatures(["x"], ["t", "k"]), last])
        pipe.save(str(tmp_path / f"{name}-unfitted"))
        fitted = Pipeline.load(str(tmp_path / f"{name}-unfitted")).fit(df)
        fitted.save(str(tmp_path / name))
        loaded = PipelineModel.load(str(tmp_path / name))
        assert isinstance(loaded.stages[0], CodedFeaturesModel) and loaded.stages[0].uid == fitted.stages[0].uid
        want = _scores(fitted, df.unionByName(new))
        assert _scores(loaded, df.unionByName(new)) == want and len(want) == 62
    # scaled number, three levels of t, four of k: an unseen level has no indicator, nulls count as mean and mode
    vector = want[900][0]
    assert len(vector) == 8 and vector[1:4] == [0, 0, 0] and sum(vector[4:]) == 1 and 0 < vector[0] < 1
    assert sum(want[901][0][1:4]) == 1 and want[901][1] == [0.0, 1.0]


def test_other_columns_pass_and_empty_tables_stay_empty(spark):
    df = _rows(spark)
    model = CodedFeatures(["x"], ["t"]).fit(df)
    out = model.transform(df)
    assert set(out.columns) == {"id", "label", "k", "x", "t", FEATURES}
    assert {r["id"]: r["k"] for r in out.collect()} == {r["id"]: r["k"] for r in df.collect()}
    assert model.transform(df.limit(0)).count() == 0
