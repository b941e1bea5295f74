import math

from pyspark.sql import functions as F

from conftest import SF_SMALL, plan_text
from postlens.functions.labels import first_label
from postlens.operators.scoring import (
    LexiconScorer, NaiveBayesScorer, label_only, score_posts, title_fanout, title_join_labels,
)
from postlens.plans.analysis import clean_posts
from postlens.schemas import ANNOTATION
from postlens.sources.posts import load_fixture_posts


def test_first_label_cases(spark):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("sentiment", ANNOTATION)])
    df = spark.createDataFrame([
        (0, [("pos", 1.0)]), (1, [("neg", 0.0), ("pos", 1.0)]), (2, []), (3, None)], schema)
    got = [r[0] for r in df.orderBy("i").select(first_label("sentiment")).collect()]
    assert got == ["pos", "neg", None, None]


def test_lexicon_scorer(spark):
    df = spark.createDataFrame([(0, "What an idiot, stupid and worthless."), (1, "Best day, idiot."),
                                (2, "plain words"), (3, None)], "i int, text string")
    out = LexiconScorer().transform(df).orderBy("i").select(F.get("sentiment", 0).alias("a")).collect()
    scores = [None if r.a is None else (r.a.result, r.a.score) for r in out]
    assert scores == [("neg", -3.0), ("pos", 0.0), ("pos", 0.0), None]


def _brute_force_nb(rows, min_docs=5, min_z=4.0):
    import re
    docs = [(set(t for t in re.split(r"[^\w]+", text.lower()) if t), y) for text, y in rows]
    n1 = sum(1 for _, y in docs if y == 1)
    n0 = sum(1 for _, y in docs if y == 0)
    counts = {}
    for toks, y in docs:
        for t in toks:
            a, b = counts.get(t, (0, 0))
            counts[t] = (a + (y == 1), b + (y == 0))
    stats = []
    for t, (a, b) in counts.items():
        if a + b < min_docs:
            continue
        q = (a + b) / (n1 + n0)
        var = q * (1 - q) * (1 / n1 + 1 / n0)
        if var <= 0:
            continue
        z = abs(a / n1 - b / n0) / math.sqrt(var)
        if z >= min_z:
            stats.append((-z, t, math.log((a + 1) / (n1 + 2)) - math.log((b + 1) / (n0 + 2))))
    stats.sort()
    return {t: w for _, t, w in stats}, math.log(n1 / n0)


def test_naive_bayes_fit_matches_brute_force(spark):
    rows = ([("you idiot trash person", 1)] * 12 + [("calm nice day person", 0)] * 30
            + [("idiot day", 0), ("trash talk", 1), ("a day", 1)])
    df = spark.createDataFrame(rows, "text string, toxic int")
    model = NaiveBayesScorer(min_z=2.0).fit(df)
    weights, bias = _brute_force_nb(rows, min_z=2.0)
    assert set(model.weights) == set(weights)
    for t in weights:
        assert abs(model.weights[t] - weights[t]) < 1e-12
    assert abs(model.bias - bias) < 1e-12
    scored = model.transform(spark.createDataFrame([("idiot idiot trash",), ("calm day",)], "text string"))
    labels = [r[0] for r in scored.select(first_label("sentiment")).collect()]
    assert labels == ["neg", "pos"]
    expected = round(sum(weights.get(t, 0.0) for t in {"idiot", "trash"}) + bias, 6)
    got = scored.select(F.get("sentiment", 0)["score"]).first()[0]
    assert abs(got - expected) < 1e-9


def test_naive_bayes_keeps_every_token_that_qualifies(spark):
    rows = [(" ".join(f"w{i}" for i in range(700)), 1)] * 10 + [("z", 0)] * 10
    model = NaiveBayesScorer(min_z=1.0).fit(spark.createDataFrame(rows, "text string, toxic int"))
    assert set(model.weights) == {f"w{i}" for i in range(700)} | {"z"}
    texts = spark.createDataFrame([("w3 w699 other",), ("z z",)], "text string")
    assert [r.sentiment[0].result for r in model.transform(texts).collect()] == ["neg", "pos"]


def test_replaced_training_files_are_fitted_again(spark, tmp_path):
    import time
    from postlens.plans.registry import scorer_b
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(40)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    write = lambda flip: spark.createDataFrame(
        [(i, 1, int((i % 4 == 0) != flip)) for i in ids], "doc_id long, quality int, toxic int").write.mode(
            "overwrite").parquet(f"{tmp_path}/labels.parquet")
    write(False)
    first = scorer_b(spark, str(tmp_path))
    assert scorer_b(spark, str(tmp_path)) is first
    time.sleep(1.1)
    write(True)
    again = scorer_b(spark, str(tmp_path))
    assert again is not first and again.n_positive_docs == first.n_negative_docs


def test_title_counts_beyond_a_bigint(spark):
    """3 million posts of one title: 2.7e19 rows, more than a bigint holds."""
    n = 3_000_000
    df = spark.range(n).select(F.lit("t").alias("title"), F.lit("pos").alias("sentiment1"), F.lit("neg").alias("sentiment2"))
    assert int(title_fanout(df).first().n) == n ** 3
    assert int(title_join_labels(df).first().n_rows) == n ** 3


def test_naive_bayes_one_class_only(spark):
    model = NaiveBayesScorer().fit(spark.createDataFrame([("a", 1)], "text string, toxic int"))
    assert model.weights == {} and model.bias == 0.0


def _model(spark):
    rows = [("idiot trash", 1)] * 10 + [("nice calm", 0)] * 10
    return NaiveBayesScorer(min_z=1.0).fit(spark.createDataFrame(rows, "text string, toxic int"))


def test_score_posts_is_row_local(spark):
    posts = clean_posts(load_fixture_posts(spark, SF_SMALL, with_comments=False))
    scored = score_posts(posts, LexiconScorer(), _model(spark))
    plan = plan_text(scored)
    # the only exchange is the small-input spread, never a hash exchange on posts
    assert "hashpartitioning" not in plan
    assert set(scored.columns) >= {"sentiment1", "sentiment2", "selftext"}
    assert scored.count() == posts.count()


def test_score_posts_equals_join_by_id(spark):
    posts = clean_posts(load_fixture_posts(spark, SF_SMALL, with_comments=False))
    model = _model(spark)
    a = score_posts(posts, LexiconScorer(), model).select("id", "sentiment1", "sentiment2")
    l1 = label_only(posts, LexiconScorer(), "sentiment1")
    l2 = label_only(posts, model, "sentiment2")
    b = posts.select("id").join(l1, "id").join(l2, "id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def _title_join_brute_force(rows):
    """The reference's two inner joins on title, row by row (tiny inputs only)."""
    out = {}
    for t, _, _ in rows:
        for ta, s1, _ in rows:
            for tb, _, s2 in rows:
                if t is not None and t == ta and t == tb:
                    out[(t, s1, s2)] = out.get((t, s1, s2), 0) + 1
    return out


def test_title_join_counts_match_brute_force(spark):
    rows = [("t", "pos", "neg"), ("t", "neg", "neg"), ("t", "pos", None), ("u", "pos", "pos"),
            (None, "neg", "pos"), ("v", None, None), ("v", None, "pos")]
    df = spark.createDataFrame(rows, "title string, sentiment1 string, sentiment2 string")
    expected = _title_join_brute_force(rows)
    got = {(r.title, r.sentiment1, r.sentiment2): r.n_rows for r in title_join_labels(df).collect()}
    assert got == expected
    per_title = {}
    for (t, _, _), n in expected.items():
        per_title[t] = per_title.get(t, 0) + n
    assert dict(title_fanout(df).collect()) == per_title == {"t": 27, "u": 1, "v": 8}


def test_title_join_counts_never_pair_rows(spark):
    """A hot title is aggregated before any join: no join input grows with its posts."""
    title = F.when(F.col("id") < 2000, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
    df = spark.range(3000).select(title.alias("title"),
                                  F.when(F.col("id") % 2 == 0, "pos").otherwise("neg").alias("sentiment1"),
                                  F.lit("pos").alias("sentiment2"))
    got = {(r.title, r.sentiment1, r.sentiment2): r.n_rows for r in title_join_labels(df).collect()}
    assert got[("hot", "pos", "pos")] == got[("hot", "neg", "pos")] == 2000 * 1000 * 2000
    assert len(got) == 2 + 1000 and all(got[(f"t{i}", "pos" if i % 2 == 0 else "neg", "pos")] == 1
                                        for i in range(2000, 3000))
    plan = plan_text(title_join_labels(df))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_tokens_shared_between_scorers(spark):
    posts = clean_posts(load_fixture_posts(spark, SF_SMALL, with_comments=False))
    scored = score_posts(posts, LexiconScorer(), _model(spark))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") == 1


def test_pluggable_spark_ml_scorer(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer
    stage = SQLTransformer(statement=(
        "SELECT *, CASE WHEN text IS NULL THEN array() ELSE "
        "array(named_struct('result', IF(length(text) > 10, 'long', 'short'), 'score', 1.0D)) END "
        "AS sentiment FROM __THIS__"))
    model = Pipeline(stages=[stage]).fit(spark.createDataFrame([("x",)], "text string"))
    posts = spark.createDataFrame([("1", "short"), ("2", "a much longer text")], "id string, selftext string")
    out = dict((r.id, (r.sentiment1, r.sentiment2))
               for r in score_posts(posts, LexiconScorer(), model).collect())
    assert out == {"1": ("pos", "short"), "2": ("pos", "long")}


def test_keyword_analysis_scans_posts_once(spark):
    from postlens.plans.analysis import analyze_keywords
    posts = load_fixture_posts(spark, SF_SMALL, with_comments=False)
    model = _model(spark)  # fitted before: training scans are not part of the plan
    scored = analyze_keywords(posts, ["that", "idiot"], LexiconScorer(), model, limit=None)
    plan = plan_text(scored)
    assert plan.count("documents.parquet") == 1
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_model_releases_its_statistics(spark):
    model = _model(spark)
    assert model.statistics is not None and model.statistics.is_cached
    model.unpersist()
    assert not model.statistics.is_cached
    # scoring does not depend on the persisted frame
    df = spark.createDataFrame([("you idiot",), ("nice calm day",)], "text string")
    labels = [r.sentiment[0].result for r in model.transform(df).collect()]
    assert labels == ["neg", "pos"]
