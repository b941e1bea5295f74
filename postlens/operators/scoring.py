"""Sentiment scoring: M1, M2, M3, C8, J1 (counted), J2.

The reference runs two pretrained neural pipelines. Their weights are not
available, so two scorers with the same contract take their place:

* in: a frame with string column ``text`` (or a ready token array),
* out: the same rows plus ``sentiment: array<struct<result, score>>``;
  null text gives an empty array, hence a null label under C8.

Scorer A is a word list; scorer B is a naive-Bayes log-odds model trained by
aggregation on labelled rows. Both score row-locally (no shuffle by key) and
so also run inside a stream.
"""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.functions.labels import first_label
from postlens.functions.literals import sql_double, sql_string
from postlens.functions.text import tokens as text_tokens

# Label texts and the word lists of scorer A.
POSITIVE = "pos"
NEGATIVE = "neg"
POSITIVE_WORDS = [
    "good", "great", "best", "love", "happy", "wonderful", "excellent", "beautiful",
    "nice", "amazing", "awesome", "kind", "glad", "perfect", "brilliant", "fantastic",
    "enjoy", "thanks", "helpful", "agree",
]
NEGATIVE_WORDS = [
    "trash", "idiot", "clown", "scum", "worthless", "moron", "pathetic", "loser",
    "stupid", "disgusting", "hate", "awful", "terrible", "horrible", "useless",
]

_EMPTY_ANNOTATION = "array<struct<result:string,score:double>>"


def _annotation(text: Column, label: Column, score: Column) -> Column:
    """One annotation per non-null text; an empty array for null text."""
    one = F.array(F.struct(label.alias("result"), score.cast("double").alias("score")))
    return F.when(text.isNull(), F.array().cast(_EMPTY_ANNOTATION)).otherwise(one)


def _annotate(df: DataFrame, text: Column, score: Column, output_col: str, labeller) -> DataFrame:
    """Score once into a column, then build the annotation from it.

    The score feeds both the label and the score field; as its own column
    (used twice, so Catalyst keeps it) it is computed once per row.
    """
    tmp = f"_{output_col}_score"
    s = F.col(tmp)
    return (df.withColumn(tmp, score)
            .withColumn(output_col, _annotation(text, labeller(s), s))
            .drop(tmp))


class LexiconScorer:
    """M1, scorer A: positive hits minus negative hits over word tokens.

    ``neg`` when the score is below zero, else ``pos``. One pass over the
    token array; membership tests are hashed ``IN`` sets.
    """

    def __init__(self, positive: list[str] | None = None, negative: list[str] | None = None,
                 input_col: str = "text", output_col: str = "sentiment"):
        self.positive = list(POSITIVE_WORDS if positive is None else positive)
        self.negative = list(NEGATIVE_WORDS if negative is None else negative)
        self.input_col, self.output_col = input_col, output_col

    def score(self, toks: Column) -> Column:
        pos = [F.lit(w) for w in self.positive] or [F.lit(None).cast("string")]
        neg = [F.lit(w) for w in self.negative] or [F.lit(None).cast("string")]
        return F.aggregate(
            toks, F.lit(0),
            lambda acc, t: acc + F.when(t.isin(*pos), 1).when(t.isin(*neg), -1).otherwise(0))

    def transform(self, df: DataFrame, tokens_col: str | None = None) -> DataFrame:
        """Add the annotation column; ``tokens_col`` reuses a ready token array."""
        text = F.col(self.input_col)
        toks = F.col(tokens_col) if tokens_col else text_tokens(text)
        return _annotate(df, text, self.score(toks), self.output_col,
                         lambda s: F.when(s < 0, F.lit(NEGATIVE)).otherwise(F.lit(POSITIVE)))


@dataclass
class NaiveBayesModel:
    """Fitted scorer B: per-token log-odds weights and the prior log-odds."""

    weights: dict[str, float]
    bias: float
    input_col: str = "text"
    output_col: str = "sentiment"
    decimals: int = 6
    n_positive_docs: int = 0
    n_negative_docs: int = 0
    vocabulary: list = field(default_factory=list)
    # the fitted statistics (token, a, b, z, w) as a persisted frame; lost
    # blocks are recomputed from lineage
    statistics: DataFrame | None = None

    def unpersist(self) -> None:
        """Release the persisted statistics (the weights stay usable)."""
        if self.statistics is not None:
            self.statistics.unpersist()

    def score_sql(self, tokens_col: str) -> str:
        """Sum of weights over distinct tokens + bias, rounded (a SQL expression).

        The vocabulary grows with the labelled rows, so it is one JSON literal
        (constant-folded once, no parser node per word): small maps of weights,
        one of which a token's CRC picks, so that a lookup does not grow with
        their number.
        """
        bias = sql_double(self.bias)
        if not self.weights:
            return f"round({bias}, {self.decimals})"
        buckets: list[dict[str, float]] = [{} for _ in self.weights]
        for word, w in self.weights.items():
            buckets[zlib.crc32(word.encode()) % len(buckets)][word] = float(w)
        maps = f"from_json({sql_string(json.dumps(buckets))}, 'array<map<string,double>>')"
        weight = f"try_element_at(get({maps}, CAST(crc32(t) % {len(buckets)} AS INT)), t)"
        # vocabulary hits first, then distinct: only the few hits are hashed
        hits = f"array_distinct(filter(`{tokens_col}`, t -> {weight} IS NOT NULL))"
        total = f"aggregate({hits}, 0D, (acc, t) -> acc + {weight})"
        return f"round({total} + {bias}, {self.decimals})"

    def transform(self, df: DataFrame, tokens_col: str | None = None) -> DataFrame:
        """Add the annotation column; ``tokens_col`` reuses a ready token array."""
        text = F.col(self.input_col)
        work = tokens_col or "_nb_tokens"
        if tokens_col is None:
            df = df.withColumn(work, text_tokens(text))
        out = _annotate(df, text, F.expr(self.score_sql(work)), self.output_col,
                        lambda s: F.when(s > 0, F.lit(NEGATIVE)).otherwise(F.lit(POSITIVE)))
        return out if tokens_col else out.drop(work)


class NaiveBayesScorer:
    """M2, scorer B: trained by plain aggregations on labelled rows.

    Per token, ``a`` = documents with label 1 containing it (of N1) and ``b``
    = documents with label 0 (of N0). Weight ``w = ln((a+1)/(N1+2)) -
    ln((b+1)/(N0+2))``. The model is every token with ``a+b >= min_docs`` and
    a two-proportion statistic ``z >= min_z``; there is no cap on their
    number. A row scores ``neg`` when its log-odds is above zero.

    ``fit`` counts in all labelled rows; only the vocabulary reaches the driver.
    """

    def __init__(self, min_docs: int = 5, min_z: float = 4.0,
                 input_col: str = "text", label_col: str = "toxic", decimals: int = 6):
        self.min_docs, self.min_z = min_docs, min_z
        self.input_col, self.label_col, self.decimals = input_col, label_col, decimals

    def _docs(self, labelled: DataFrame) -> DataFrame:
        return labelled.select(
            F.array_distinct(text_tokens(F.col(self.input_col))).alias("_toks"),
            F.col(self.label_col).cast("bigint").alias("_y"))

    def class_totals(self, labelled: DataFrame) -> tuple[int, int]:
        """(N1, N0): one tiny aggregate job."""
        row = labelled.agg(
            F.coalesce(F.sum(F.when(F.col(self.label_col) == 1, 1).otherwise(0)), F.lit(0)).alias("n1"),
            F.coalesce(F.sum(F.when(F.col(self.label_col) == 0, 1).otherwise(0)), F.lit(0)).alias("n0"),
        ).first()
        return int(row["n1"]), int(row["n0"])

    def statistics(self, labelled: DataFrame, n1: int, n0: int) -> DataFrame:
        """Selected vocabulary with counts, z and weight (lazy)."""
        docs = self._docs(labelled).where(F.col("_y").isin(0, 1))
        if n1 == 0 or n0 == 0:  # one class only: no token can separate them
            return docs.select(F.lit(None).cast("string").alias("token"), F.lit(0).cast("bigint").alias("a"),
                               F.lit(0).cast("bigint").alias("b"), F.lit(None).cast("double").alias("z"),
                               F.lit(None).cast("double").alias("w")).where(F.lit(False))
        # explode_outer + null filter: a plain explode makes Catalyst infer a
        # size(tokens) > 0 filter and push it to the scan, tokenizing twice.
        counts = (docs.select(F.explode_outer("_toks").alias("token"), "_y")
                  .where(F.col("token").isNotNull())
                  .groupBy("token")
                  .agg(F.sum("_y").alias("a"), F.sum(F.lit(1) - F.col("_y")).alias("b")))
        a, b = F.col("a"), F.col("b")
        q = (a + b) / F.lit(n1 + n0)
        var = q * (F.lit(1.0) - q) * (F.lit(1.0 / n1) + F.lit(1.0 / n0))
        z = F.when(var > 0, F.abs(a / F.lit(n1) - b / F.lit(n0)) / F.sqrt(var))
        w = F.ln((a + 1) / F.lit(n1 + 2)) - F.ln((b + 1) / F.lit(n0 + 2))
        return (counts.where(a + b >= self.min_docs)
                .select("token", "a", "b", z.alias("z"), w.alias("w"))
                .where(F.col("z") >= self.min_z))

    def fit(self, labelled: DataFrame) -> NaiveBayesModel:
        n1, n0 = self.class_totals(labelled)
        if n1 == 0 or n0 == 0:
            return NaiveBayesModel({}, 0.0, input_col=self.input_col, decimals=self.decimals,
                                   n_positive_docs=n1, n_negative_docs=n0)
        # persisted: the vocabulary is kept for inspection instead of being
        # aggregated again
        stats = self.statistics(labelled, n1, n0).persist()
        rows = stats.orderBy("token").collect()
        weights = {r["token"]: float(r["w"]) for r in rows}
        return NaiveBayesModel(weights, math.log(n1 / n0), input_col=self.input_col,
                               decimals=self.decimals, n_positive_docs=n1, n_negative_docs=n0,
                               vocabulary=[(r["token"], r["a"], r["b"], r["z"], r["w"]) for r in rows],
                               statistics=stats)


def with_first_label(df: DataFrame, annotation: str, label: str) -> DataFrame:
    """P6 + C8: label column from an annotation column, which is dropped."""
    return df.withColumn(label, first_label(annotation)).drop(annotation)


def score_posts(df: DataFrame, scorer_a, scorer_b, text_col: str = "selftext") -> DataFrame:
    """M3 + P3 + J2: both labels added as columns of the same rows.

    The reference scores twice and joins both results back on title (J1);
    here both scorers read one shared token array and the labels are plain
    columns: no join, no shuffle, valid in a stream.
    """
    prepared = df.withColumnRenamed(text_col, "text").withColumn("_tokens", text_tokens(F.col("text")))
    a = with_first_label(_apply(scorer_a, prepared), _output(scorer_a), "sentiment1")
    b = with_first_label(_apply(scorer_b, a), _output(scorer_b), "sentiment2")
    return b.drop("_tokens").withColumnRenamed("text", text_col)


def _output(scorer) -> str:
    return getattr(scorer, "output_col", "sentiment")


def _apply(scorer, df: DataFrame) -> DataFrame:
    """Built-in scorers reuse the shared tokens; any other transformer
    (e.g. a fitted ``pyspark.ml`` model reading ``text`` and writing
    ``sentiment``) is called with the frame alone."""
    if isinstance(scorer, (LexiconScorer, NaiveBayesModel)):
        return scorer.transform(df, "_tokens")
    return scorer.transform(df)


def label_only(df: DataFrame, scorer, label: str, key: str = "id", text_col: str = "selftext") -> DataFrame:
    """One scorer's result as its own table ``(key, label)``."""
    prepared = df.select(key, F.col(text_col).alias("text"))
    return with_first_label(scorer.transform(prepared), scorer.output_col, label).select(key, label)


def join_scores_by_id(df: DataFrame, labels1: DataFrame, labels2: DataFrame, key: str = "id") -> DataFrame:
    """J2 when the two results come as separate tables: equi-joins on the unique key."""
    return df.join(labels1, key, "inner").join(labels2, key, "inner")


# k posts of one title make k^3 rows, beyond a bigint from 2,097,152 posts on.
COUNT_FACTOR, WIDE_COUNT = "decimal(12,0)", "decimal(38,0)"


def title_join_labels(scored: DataFrame) -> DataFrame:
    """J1, the reference's join on title (inner, twice), as exact row counts.

    The reference joins the posts to model 1's labels and then to model 2's
    labels on ``title``. Titles are not unique, so a title shared by k posts
    yields k x c1 x c2 rows for each label pair, where c1 (c2) counts that
    title's posts labelled ``sentiment1`` (``sentiment2``); null titles drop
    out. Those rows are never produced. ``scored`` carries both labels as
    columns (J2). It is counted per (title, sentiment1, sentiment2), with
    map-side partial aggregation, so a hot title is combined before the
    shuffle; a second aggregation gathers each title's label-pair cells (at
    most labels-of-A x labels-of-B of them, never its posts), and k, c1, c2
    are sums over those cells. Each post is scored once; there is no join.
    Output: ``(title, sentiment1, sentiment2, n_rows)``.
    """
    cells = (scored.where(F.col("title").isNotNull())
             .groupBy("title", "sentiment1", "sentiment2").agg(F.count(F.lit(1)).alias("_n"))
             .groupBy("title").agg(F.collect_list(F.struct("sentiment1", "sentiment2", "_n")).alias("_cells")))

    def total(cond=None) -> Column:
        picked = F.col("_cells") if cond is None else F.filter("_cells", cond)
        return F.aggregate(picked, F.lit(0).cast("bigint"), lambda acc, x: acc + x["_n"]).cast(COUNT_FACTOR)

    distinct = lambda field: F.array_distinct(F.transform("_cells", lambda x: x[field]))
    s1, s2 = F.col("sentiment1"), F.col("sentiment2")
    return (cells.select("title", "_cells", F.explode(distinct("sentiment1")).alias("sentiment1"))
            .select("*", F.explode(distinct("sentiment2")).alias("sentiment2"))
            .select("title", "sentiment1", "sentiment2",
                    (total() * total(lambda x: x["sentiment1"].eqNullSafe(s1))
                     * total(lambda x: x["sentiment2"].eqNullSafe(s2))).cast(WIDE_COUNT).alias("n_rows")))


def title_fanout(df: DataFrame) -> DataFrame:
    """Rows per title that J1 would produce, ``(title, n)`` with n = k^3 (a decimal: no overflow).

    Exact and linear: one aggregation instead of materialising the pairs
    (``title_join_labels`` splits the same count by label pair).
    """
    k = F.count(F.lit(1)).cast(COUNT_FACTOR)
    return (df.where(F.col("title").isNotNull()).groupBy("title")
            .agg((k * k * k).cast(WIDE_COUNT).alias("n")))
