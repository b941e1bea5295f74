"""Scorers as Spark ML stages: stored, loaded by another session, equal to the plain scorers."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from conftest import SF_SMALL, plan_text
from postlens.operators.models import LexiconStage, NaiveBayesEstimator, NaiveBayesStage
from postlens.operators.scoring import LexiconScorer, NaiveBayesModel, NaiveBayesScorer, score_posts
from postlens.plans.analysis import clean_posts
from postlens.plans.registry import QUERIES
from postlens.schemas import POST_COLUMNS
from postlens.session import scratch_path
from postlens.sources.posts import load_fixture_posts

TRAIN = [("idiot trash", 1), ("a 'quoted' \\ idiot", 1)] * 10 + [("nice calm", 0), ("", 0)] * 10 + [(None, 1), (None, None)]


def rows(df):
    return sorted(map(str, df.collect()))


def test_stored_scorers_equal_plain_ones(spark):
    train = spark.createDataFrame(TRAIN, "text string, toxic int")
    plain = NaiveBayesScorer(min_z=1.0).fit(train)
    path = scratch_path(spark, "models")
    Pipeline(stages=[LexiconStage()]).fit(train).save(f"{path}/a")
    Pipeline(stages=[NaiveBayesEstimator(minZ=1.0)]).fit(train).save(f"{path}/b")
    other = spark.newSession()
    a, b = (PipelineModel.read().session(other).load(f"{path}/{n}") for n in ("a", "b"))
    assert b.stages[0].weights == plain.weights and b.stages[0].getOrDefault("bias") == plain.bias
    posts = clean_posts(load_fixture_posts(spark, SF_SMALL).select(*POST_COLUMNS))
    assert rows(score_posts(posts, a, b)) == rows(score_posts(posts, LexiconScorer(), plain))


def test_parameters_are_kept(spark):
    path = scratch_path(spark, "stage")
    LexiconStage(positive=["fine"], negative=["it's", "\\"], inputCol="body", outputCol="label").write().overwrite().save(path)
    stage = LexiconStage.load(path)
    df = spark.createDataFrame([("fine day",), ("bad",), (None,)], "body string")
    want = LexiconScorer(["fine"], ["it's", "\\"], "body", "label").transform(df)
    assert rows(stage.transform(df)) == rows(want)
    train = spark.createDataFrame(TRAIN, "body string, y int")
    model = NaiveBayesEstimator(minDocs=1, minZ=0.5, inputCol="body", labelCol="y", outputCol="out").fit(train)
    path = scratch_path(spark, "stage")
    model.save(path)
    loaded = NaiveBayesStage.load(path)
    assert loaded.uid == model.uid and loaded.weights == model.weights and loaded.output_col == "out"
    assert rows(loaded.transform(df)) == rows(model.copy().transform(df))


def test_one_class_has_no_weights(spark):
    train = spark.createDataFrame([("a", 1), ("b", 1)], "text string, toxic int")
    path = scratch_path(spark, "stage")
    NaiveBayesEstimator().fit(train).save(path)
    got = NaiveBayesStage.load(path).transform(spark.createDataFrame([("a",), (None,)], "text string")).collect()
    assert [len(r.sentiment) for r in got] == [1, 0]


def test_stands_in_a_pipeline_with_other_stages(spark):
    train = spark.createDataFrame(TRAIN, "text string, toxic int")
    shout = SQLTransformer(statement="SELECT *, upper(text) AS loud FROM __THIS__")
    model = Pipeline(stages=[shout, LexiconStage(inputCol="loud", outputCol="a"),
                             NaiveBayesEstimator(minZ=1.0, inputCol="loud", outputCol="b")]).fit(train)
    path = scratch_path(spark, "pipeline")
    model.save(path)
    df = spark.createDataFrame([("you idiot",), ("nice",)], "text string")
    got = PipelineModel.load(path).transform(df)
    assert [r[0] for r in got.select(F.get("b", F.lit(0))["result"]).collect()] == ["neg", "pos"]
    assert rows(got) == rows(model.transform(df))


@pytest.fixture(scope="module")
def many_labels(spark, tmp_path_factory):
    """Over 50,000 labelled rows; those that give scorer B its one word come last in the order of a hash of their id."""
    sf = str(tmp_path_factory.mktemp("many_labels"))
    ids = [r.i for r in spark.range(100, 121).select(F.col("id").cast("string").alias("i")).orderBy(F.xxhash64("i")).collect()]
    calm, toxic = int(ids[0]), [int(i) for i in ids[1:]]
    rows = [(i, "idiot zzz", "en", "src1", 9) for i in (*range(50), *toxic)] + [(calm, "calm day", "en", "src2", 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    labels = spark.range(50_000).select(F.lit(calm).cast("long").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    labels.unionByName(spark.createDataFrame([(i, 0, 1) for i in toxic], "doc_id long, quality int, toxic int")).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    return sf


def test_train_nb_counts_every_label(spark, many_labels):
    rows = {r.token: (r.a, r.b) for r in QUERIES["train_nb"](spark, many_labels).collect()}
    assert rows["zzz"] == (20, 0) and rows["calm"] == (0, 50_000)


def test_live_agreement_by_keyword_learns_from_every_label(spark, many_labels):
    rows = {(r.keyword, r.agreement): r.n_posts for r in QUERIES["live_agreement_by_keyword"](spark, many_labels).collect()}
    assert rows == {("idiot", "Agree"): 70, ("All", "Agree"): 70}


@pytest.mark.parametrize("name,n", [("stream_two_runs", 70), ("topic_scored", 70)])
def test_streamed_posts_are_scored_by_a_model_of_every_label(spark, many_labels, name, n):
    rows = QUERIES[name](spark, many_labels).collect()
    assert len(rows) == 71 and sum(r.sentiment2 == "neg" for r in rows) == n


def test_many_weights_are_looked_up_exactly(spark):
    weights = {f"w'{i}\\é": (i + 1) / 7e4 for i in range(20_000)}
    rows = [(i, [f"w'{i}\\é", f"w'{i}\\é", f"w'{19_999 - i}\\é", "none"]) for i in (0, 7, 12_345)]
    scored = NaiveBayesModel(weights, 0.5, decimals=12).transform(spark.createDataFrame(rows, "i int, t array<string>").withColumn("text", F.lit("x")), "t")
    got = {r.i: r.sentiment[0].score for r in scored.collect()}
    assert got == {i: round(0.0 + weights[t[0]] + weights[t[2]] + 0.5, 12) for i, t in rows}
    assert "from_json" not in plan_text(scored)  # folded once, not read for each row
