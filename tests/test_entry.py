import duckdb
import pytest

from conftest import SF_SMALL
import __spark_entry__ as E
from postlens.plans.oracle import SQL
from postlens.plans.registry import QUERIES

TABLES = ["documents", "labels", "conversations", "pages", "events"]
KEYWORD_TABLE_QUERIES = ["keywords_10k", "keywords_10k_top", "agreement_by_10k_keywords"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert set(df.columns) == {"keyword", "agreement", "n_posts"}
    assert len(rows) >= 1
    assert sum(r.n_posts for r in rows if r.keyword == "All") > 0


def test_every_query_has_oracle():
    assert set(QUERIES) == set(SQL) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _canon(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    got = sorted((tuple(_canon(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    odf = con.execute(E.oracle_sql()[name]).df()
    assert sorted(odf.columns) == cols
    import pandas as pd
    exp = sorted((tuple(None if (not isinstance(v, (list, str)) and pd.isna(v)) else _canon(v.to_pydatetime() if hasattr(v, "to_pydatetime") else v)
                        for v in (r[c] for c in cols)) for _, r in odf.iterrows()), key=repr)
    assert len(got) == len(exp)
    assert got == exp


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_plan_hygiene(spark, name):
    """Every registered plan: equi-joins only, no row-at-a-time Python, no Python
    at all (everything stays in the JVM), but for matching keyword tables, which is
    one Arrow function over title and body."""
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    if name in KEYWORD_TABLE_QUERIES:
        assert plan.count("ArrowEvalPython [run(lower(") == plan.count("ArrowEvalPython") == 1
        plan = plan.replace("ArrowEvalPython", "")
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
                "FlatMapGroupsInPandas", "MapInPandas", "MapInArrow"):
        assert bad not in plan, f"{name}: {bad}"


@pytest.mark.parametrize("name,cleans,tokenizes", [
    ("keyword_options", 0, 0), ("posts_per_keyword", 0, 0), ("agreement_by_keyword", 1, 1),
    ("sentiment_by_keyword", 1, 1), ("agreement_flag", 1, 1), ("analyze_keywords", 1, 1),
    ("score_posts", 1, 1), ("title_join_labels", 1, 1), ("clean_text", 1, 0),
])
def test_work_per_post_in_plan(spark, name, cleans, tokenizes):
    """Cleaning (two regexes) and tokenizing appear once where needed, never where
    the result does not use them; keyword matching once (title and body)."""
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 2 * cleans
    assert plan.count("split(lower(") == tokenizes
    assert plan.count("Contains(") in (0, 2)


def test_session_leaves_master_and_partitions_to_the_cluster():
    from postlens.session import session_builder
    opts = session_builder()._options
    assert "spark.master" not in opts and "spark.sql.shuffle.partitions" not in opts
    assert opts["spark.sql.adaptive.enabled"] == "true" and opts["spark.ui.enabled"] == "false"
    given = session_builder("local[2]", shuffle_partitions=4)._options
    assert given["spark.master"] == "local[2]" and given["spark.sql.shuffle.partitions"] == "4"


def test_train_nb_reads_the_fitted_vocabulary(spark):
    """The vocabulary query reuses the fit's persisted statistics (no second
    aggregation over the labelled posts); the rows equal a fresh computation."""
    from postlens.operators.scoring import NaiveBayesScorer
    from postlens.plans.registry import scorer_b, training_rows
    q = E.queries()["train_nb"](spark, SF_SMALL)
    assert "InMemoryTableScan" in q._jdf.queryExecution().executedPlan().toString()
    model = scorer_b(spark, SF_SMALL)
    fresh = NaiveBayesScorer().statistics(training_rows(spark, SF_SMALL), model.n_positive_docs,
                                          model.n_negative_docs).collect()
    assert sorted(r.token for r in q.collect()) == sorted(r.token for r in fresh)


def test_queries_survive_a_session_restart():
    """A driver may stop its session and start another: cached fits must not
    hand back frames of the stopped session (run in a child process)."""
    import subprocess
    import sys
    from pathlib import Path
    root = Path(__file__).resolve().parents[1]
    script = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as E
for _ in range(2):
    s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    print("COUNT", E.queries()["train_nb"](s, {SF_SMALL!r}).count(), E.queries()["score_nb"](s, {SF_SMALL!r}).count())
    s.stop()
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=600, cwd=root)
    counts = [line for line in out.stdout.splitlines() if line.startswith("COUNT")]
    assert len(counts) == 2 and counts[0] == counts[1], out.stderr[-2000:]
