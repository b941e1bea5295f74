"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the test tables (or data Spark derives from them) whole.
Posts come from ``documents`` through the fixture adapter; scorer B is
trained on every labelled row of ``labels``. Sink and stream
queries write under the shared checkpoint folder and return what they read
back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.json import decode_json
from postlens.functions.text import clean_text, epoch_to_timestamp, strip_urls
from postlens.operators import report
from postlens.operators.keywords import tag_keyword_table
from postlens.operators.models import LexiconStage, NaiveBayesEstimator
from postlens.operators.relevance import build_index
from postlens.operators.scoring import (
    LexiconScorer, NaiveBayesScorer, join_scores_by_id, label_only, score_posts, title_fanout,
    title_join_labels,
)
from postlens.operators.search import (
    keyword_union, newest, search_posts, tag_keywords, top_k, top_per_keyword,
)
from postlens.plans.analysis import analyze_keyword_table, analyze_keywords, clean_posts, search_posts_clean, with_timestamp
from postlens.schemas import POST, POST_COLUMNS, POST_TS
from postlens.session import checkpoint_root, scratch_path
from postlens.sources import files, topic
from postlens.sources.posts import (
    attach_comment_counts, keyword_frame, load_fixture_posts, project_post, read_posts, spread_small_input,
    store_posts,
)
from postlens.streaming.live import (
    dead_letters, live_agreement_by_keyword, live_posts_per_keyword, living_letters, run_live_report, run_with_dead_letters,
)
from postlens.streaming.sink import TABLE_COLUMNS, decode_stream, run_stream_to_table, scored_stream, write_table
from postlens.streaming.table import StreamTable

# Fixed values of the test set-up: keywords that occur in the fixture text
# (the reference's own keywords do not), the forum and keyword of the
# single-search queries, the keyword of the per-keyword report and the
# topic name.
KEYWORDS = ["Worthless", "idiot", "license", "that", "mystery"]
# The same keyword padded and in another case: each entry counts on its own.
GIVEN_KEYWORDS = [*KEYWORDS, " that", "That\t", " "]
# More keywords than any plan switch ever inlined.
MANY_KEYWORDS = [a + b for a in ("th", "er", "in", "an", "on", "at") for b in ("ou", "es", "ing", "ed", "ha", "re", "le", "QZ")]
# Keywords of the keyword-table queries, taken from the words of the texts in the order of a hash,
# and the best posts kept for each.
TABLE_KEYWORDS = 10_000
TABLE_TOP = 3
SEARCH_FORUM = "src1"
SEARCH_KEYWORD = "that"
REPORT_KEYWORD = "idiot"
TOPIC = "posts"
LONG_TEXT = 1000
# Files of the topic that a trigger takes. One file would leave all cores but one idle, and each
# trigger of the live report and of the dead letters pays for all partitions of the state store.
FILES_PER_TRIGGER = 64

PROPS = T.StructType([T.StructField("k", T.LongType())])

# Searches by relevance: terms frequent and rare, repeated, in another case, and unknown.
RELEVANCE_QUERIES = ["worthless idiot", "License MYSTERY", "that", "idiot, idiot that", "the and of", "unheardofword", "..."]

_models: dict = {}
_indexes: dict = {}


def _posts(spark: SparkSession, sf: str, comments: bool = False) -> DataFrame:
    return load_fixture_posts(spark, sf, with_comments=comments)


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/conversations.parquet")


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned post text with its ``toxic`` label, for every labelled post."""
    labels = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").cast("string").alias("id"), "toxic")
    labelled = _posts(spark, sf).select("id", "selftext").join(labels, "id")
    return clean_posts(labelled).select(F.col("selftext").alias("text"), "toxic")


def _session_key(spark: SparkSession) -> str:
    """The running application (a new session after ``stop()`` gets a new id)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # Spark Connect: no SparkContext on the client
        return f"session-{id(spark)}"


def _inputs_version(spark: SparkSession, sf: str, tables: tuple[str, ...] = ("documents", "labels")) -> tuple:
    """Changes whenever a file of the tables does: from the listing of their files, no row is read."""
    files = spark.read.format("binaryFile").load([f"{sf}/{t}.parquet" for t in tables])
    row = files.select("path", "length", "modificationTime").agg(
        F.count(F.lit(1)), F.sum("length"), F.max("modificationTime"), F.sum(F.xxhash64("path", "length", "modificationTime")
                                                                            .cast("decimal(20,0)"))).first()
    return tuple(row)


def scorer_b(spark: SparkSession, sf: str):
    """Scorer B fitted on the labelled rows (once per application, folder and file version).

    The model holds a persisted frame of its session, so a model of another
    (stopped) session, or of replaced files, is released and fitted again.
    """
    key, version = (_session_key(spark), sf), _inputs_version(spark, sf)
    held = _models.get(key)
    if held is not None and held[0] == version and (
            held[1].statistics is None or held[1].statistics.sparkSession is spark):
        return held[1]
    if held is not None and held[0] != version:
        held[1].unpersist()
    model = NaiveBayesScorer().fit(training_rows(spark, sf))
    _models[key] = (version, model)
    return model


def _scored_keywords(spark: SparkSession, sf: str, limit: int | None,
                     keywords: list[str] = KEYWORDS, forum: str | None = None) -> DataFrame:
    scored = analyze_keywords(_posts(spark, sf), keywords, LexiconScorer(), scorer_b(spark, sf),
                              forum=forum, limit=limit)
    return attach_comment_counts(scored, _conversations(spark, sf))


def _scored_posts(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = clean_posts(_posts(spark, sf).select(*POST_COLUMNS))
    scored = score_posts(cleaned, LexiconScorer(), scorer_b(spark, sf))
    return attach_comment_counts(scored, _conversations(spark, sf))


# --- sources, filters, limits -------------------------------------------------

def q_posts_scan(spark, sf):
    return _posts(spark, sf, comments=True).select(*POST_COLUMNS)


def q_newest_posts(spark, sf):
    recent = newest(_posts(spark, sf), 100).select(*POST_COLUMNS)
    return attach_comment_counts(recent, _conversations(spark, sf))


def q_newest_posts_of_forum(spark, sf):
    recent = newest(_posts(spark, sf), 100, forum=SEARCH_FORUM).select(*POST_COLUMNS)
    return attach_comment_counts(recent, _conversations(spark, sf))


def q_stored_posts(spark, sf):
    """A posts table written, read back with its fixed schema and projected to post rows."""
    path = scratch_path(spark, "posts")
    store_posts(_posts(spark, sf, comments=True), path)
    return project_post(read_posts(spark, path))


def q_head_posts(spark, sf):
    head = top_k(_posts(spark, sf), 5, [F.col("id").asc()]).select(*POST_COLUMNS)
    return attach_comment_counts(head, _conversations(spark, sf))


def q_search_posts(spark, sf):
    found = search_posts(_posts(spark, sf), SEARCH_FORUM, SEARCH_KEYWORD)
    return attach_comment_counts(found, _conversations(spark, sf))


def q_search_posts_clean(spark, sf):
    found = search_posts_clean(_posts(spark, sf), SEARCH_FORUM, SEARCH_KEYWORD)
    return attach_comment_counts(found, _conversations(spark, sf))


def q_top_posts_per_keyword(spark, sf):
    top = top_per_keyword(tag_keywords(_posts(spark, sf), KEYWORDS), 50)
    return top.select("keyword", "id", "score", "title")


def q_keyword_union(spark, sf):
    return keyword_union(_posts(spark, sf), KEYWORDS).select("keyword", "id", "score", "title")


def q_posts_per_keyword(spark, sf):
    tagged = tag_keywords(_posts(spark, sf), GIVEN_KEYWORDS)
    return report.posts_per_keyword(tagged, keyword_frame(spark, GIVEN_KEYWORDS))


def q_empty_keyword(spark, sf):
    tagged = tag_keywords(_posts(spark, sf), GIVEN_KEYWORDS)
    return report.empty_keywords(tagged, keyword_frame(spark, GIVEN_KEYWORDS))


def q_many_keywords(spark, sf):
    """Posts per keyword of a list longer than a hand-written one."""
    tagged = tag_keywords(_posts(spark, sf), MANY_KEYWORDS)
    return report.posts_per_keyword(tagged, keyword_frame(spark, MANY_KEYWORDS))


def _keyword_table(spark, sf):
    """Words of the texts, as they stand between spaces: the first in the order of their MD5."""
    word = F.explode(F.split("text", " ")).alias("keyword")
    words = spark.read.parquet(f"{sf}/documents.parquet").select(word).where("keyword <> ''").distinct()
    return top_k(words, TABLE_KEYWORDS, [F.md5("keyword").asc(), F.col("keyword").asc()])


def q_keywords_10k(spark, sf):
    """Posts per keyword of a keyword table, keywords without posts included."""
    keywords = _keyword_table(spark, sf).persist()
    return report.posts_per_keyword(tag_keyword_table(_posts(spark, sf).select("title", "selftext"), keywords), keywords)


def q_keywords_10k_top(spark, sf):
    """The best posts for each keyword of a keyword table."""
    tagged = tag_keyword_table(_posts(spark, sf).select("id", "score", "title", "selftext"), _keyword_table(spark, sf))
    return top_per_keyword(tagged.select("keyword", "id", "score"), TABLE_TOP)


def relevance_index(spark, sf):
    """The relevance index of the posts (built once per application, folder and file version)."""
    key, version = (_session_key(spark), sf), _inputs_version(spark, sf, ("documents",))
    if key not in _indexes or _indexes[key][0] != version:
        posts = _posts(spark, sf).select("id", "forum", "title", "selftext")
        _indexes[key] = (version, build_index(posts, scratch_path(spark, "relevance")))
    return _indexes[key][1]


def _relevant_posts(spark, sf, forum=None):
    found = relevance_index(spark, sf).search(RELEVANCE_QUERIES, forum=forum)
    return found.join(_posts(spark, sf).select("id", "title", "forum"), "id")


def q_search_by_relevance(spark, sf):
    """S1 by relevance: the 50 best posts for each query, by the stored index."""
    return _relevant_posts(spark, sf)


def q_search_by_relevance_of_forum(spark, sf):
    """The same of one forum, by the same index."""
    return _relevant_posts(spark, sf, SEARCH_FORUM)


# --- scalar functions ---------------------------------------------------------

def q_strip_urls(spark, sf):
    pages = spread_small_input(spark.read.parquet(f"{sf}/pages.parquet"))
    return pages.select("page_id", strip_urls("url").alias("url_clean"),
                        strip_urls("html").alias("html_clean"))


def q_clean_text(spark, sf):
    return _posts(spark, sf).select("id", clean_text("selftext").alias("clean_text"))


def q_created_ts(spark, sf):
    return _posts(spark, sf).select("id", epoch_to_timestamp("created_utc").alias("created_ts"))


# --- scoring ------------------------------------------------------------------

def q_score_lexicon(spark, sf):
    scored = LexiconScorer().transform(clean_posts(_posts(spark, sf)).withColumnRenamed("selftext", "text"))
    first = F.get(F.col("sentiment"), 0)
    return scored.select("id", first.getField("score").cast("bigint").alias("lexicon_score"),
                         first.getField("result").alias("sentiment1"))


def q_train_nb(spark, sf):
    """The fitted vocabulary: the fit's persisted statistics (one aggregation
    over the labelled posts, not two)."""
    model = scorer_b(spark, sf)
    stats = model.statistics
    if stats is None:  # one class only: no token can separate them
        stats = NaiveBayesScorer().statistics(training_rows(spark, sf), model.n_positive_docs,
                                              model.n_negative_docs)
    return stats.select("token", "a", "b", F.round("z", 6).alias("z"), F.round("w", 6).alias("w"))


def q_score_nb(spark, sf):
    model = scorer_b(spark, sf)
    scored = model.transform(clean_posts(_posts(spark, sf)).withColumnRenamed("selftext", "text"))
    first = F.get(F.col("sentiment"), 0)
    return scored.select("id", first.getField("score").alias("nb_score"),
                         first.getField("result").alias("sentiment2"))


def q_sentiment_result(spark, sf):
    scored = LexiconScorer().transform(clean_posts(_posts(spark, sf)).withColumnRenamed("selftext", "text"))
    result = F.col("sentiment.result")
    return scored.select("id", "title", F.array_join(result, ",").alias("result"),
                         F.size(result).cast("bigint").alias("n_results"))


def q_sentiment_first(spark, sf):
    return _scored_posts(spark, sf).select("id", "sentiment1", "sentiment2")


def q_score_posts(spark, sf):
    return _scored_posts(spark, sf)


def q_score_join_by_id(spark, sf):
    # cleaned once: the posts and both label tables read the written rows
    checkpoint_root(spark)
    posts = clean_posts(_posts(spark, sf).select(*POST_COLUMNS)).checkpoint(eager=True)
    l1 = label_only(posts, LexiconScorer(), "sentiment1")
    l2 = label_only(posts, scorer_b(spark, sf), "sentiment2")
    joined = join_scores_by_id(posts, l1, l2).select(*POST_COLUMNS, "sentiment1", "sentiment2")
    return attach_comment_counts(joined, _conversations(spark, sf))


def q_title_join_fanout(spark, sf):
    # an exact decimal(38,0), shown as text
    return title_fanout(_posts(spark, sf)).withColumn("n", F.col("n").cast("string"))


def q_title_join_labels(spark, sf):
    cleaned = clean_posts(_posts(spark, sf).select("title", "selftext"))
    counted = title_join_labels(score_posts(cleaned, LexiconScorer(), scorer_b(spark, sf)))
    return counted.withColumn("n_rows", F.col("n_rows").cast("string"))


def q_analyze_keywords(spark, sf):
    return _scored_keywords(spark, sf, limit=50)


def q_analyze_keywords_of_forum(spark, sf):
    return _scored_keywords(spark, sf, limit=50, forum=SEARCH_FORUM)


def q_score_any_transformer(spark, sf):
    """Scorer B replaced by a stock Spark ML transformer with the same contract."""
    rule = SQLTransformer(statement=f"""SELECT *, array(named_struct('result',
        CASE WHEN length(text) > {LONG_TEXT} THEN 'pos' ELSE 'neg' END, 'score', 1.0D)) AS sentiment FROM __THIS__""")
    cleaned = clean_posts(_posts(spark, sf).select(*POST_COLUMNS))
    return score_posts(cleaned, LexiconScorer(), rule).select("id", "sentiment1", "sentiment2")


def _stored_models(spark, sf) -> str:
    """Both scorers fitted as pipelines and stored."""
    path = scratch_path(spark, "models")
    rows = training_rows(spark, sf)
    for name, stage in (("a", LexiconStage()), ("b", NaiveBayesEstimator())):
        Pipeline(stages=[stage]).fit(rows).save(f"{path}/{name}")
    return path


def q_stored_models(spark, sf):
    """Posts labelled by scorers that another session loads."""
    path, other = _stored_models(spark, sf), spark.newSession()
    a, b = (PipelineModel.read().session(other).load(f"{path}/{n}") for n in ("a", "b"))
    cleaned = clean_posts(_posts(spark, sf).select(*POST_COLUMNS))
    return score_posts(cleaned, a, b).select("id", "sentiment1", "sentiment2")


def q_stored_models_in_a_stream(spark, sf):
    """The same models label a stream."""
    path = _stored_models(spark, sf)
    a, b = (PipelineModel.load(f"{path}/{n}") for n in ("a", "b"))

    def write(source, table, base):
        run_stream_to_table(spark, TOPIC, table, f"{base}/table", f"{base}/checkpoint", a, b, source=source, clean=False)

    return _stream_table(spark, [_publish_posts(spark, sf)], write).select("id", "sentiment1", "sentiment2")


# --- report -------------------------------------------------------------------

def q_agreement_flag(spark, sf):
    scored = _scored_keywords(spark, sf, limit=None)
    return report.with_agreement(scored).select("keyword", "id", "sentiment1", "sentiment2", "agreement")


def q_agreement_counts(spark, sf):
    return report.agreement_counts(_scored_keywords(spark, sf, limit=None))


def q_agreement_for_keyword(spark, sf):
    # The keyword is chosen before scoring: a filter on the exploded keyword
    # cannot reach into the per-post hits array, so filtering the all-keyword
    # report would score every match. Same rows (the oracle filters the full report).
    scored = _scored_keywords(spark, sf, limit=None, keywords=[REPORT_KEYWORD])
    return report.agreement_for_keyword(scored, REPORT_KEYWORD)


def q_agreement_by_keyword(spark, sf):
    return report.agreement_by_keyword(_scored_keywords(spark, sf, limit=None))


def q_agreement_by_10k_keywords(spark, sf):
    """A4 over a keyword table: every post scored once, however many keywords it matches."""
    scored = analyze_keyword_table(_posts(spark, sf), _keyword_table(spark, sf), LexiconScorer(), scorer_b(spark, sf), limit=None)
    return report.agreement_by_keyword(scored)


def q_sentiment_by_keyword(spark, sf):
    return report.sentiment_by_keyword(_scored_keywords(spark, sf, limit=None))


def q_keyword_options(spark, sf):
    return report.keyword_options(_scored_keywords(spark, sf, limit=None))


def q_flair_counts(spark, sf):
    return report.flair_counts(_posts(spark, sf))


def q_flair_counts_of_forum(spark, sf):
    return report.flair_counts(_posts(spark, sf), forum=SEARCH_FORUM)


# --- JSON, topic, CSV, stream ------------------------------------------------

def q_json_encode(spark, sf):
    """Encode every post as a message and decode it again (identity)."""
    posts = _posts(spark, sf, comments=True).select(*POST_COLUMNS)
    messages = topic.to_messages(posts, TOPIC)
    return topic.decode_messages(messages, POST)


def q_json_text(spark, sf):
    """The text of each message, field by field, read by a JSON path and not by our own decoder."""
    messages = topic.to_messages(_posts(spark, sf, comments=True).select(*POST_COLUMNS), TOPIC)
    text = F.col("value").cast("string")
    return messages.select(*[F.get_json_object(text, f"$.{c}").alias(c)
                             for c in ("id", "title", "author", "score", "url", "selftext", "num_comments")])


def q_timestamp_message(spark, sf):
    """Posts whose ``created_utc`` is a timestamp, through a topic and back."""
    target = scratch_path(spark, "topic")
    topic.send(with_timestamp(_posts(spark, sf, comments=True).select(*POST_COLUMNS)), TOPIC, target=target)
    return topic.read_bounded(spark, TOPIC, POST_TS, target=target, max_messages=None)


def q_json_decode(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select("event_id", decode_json("props", PROPS).getField("k").alias("k"))


def _publish_posts(spark, sf) -> str:
    """Cleaned posts to a file topic, offset = numeric post id."""
    target = scratch_path(spark, "topic")
    posts = clean_posts(_posts(spark, sf, comments=True).select(*POST_COLUMNS))
    topic.send(posts, TOPIC, target=target, offset=F.col("id").cast("bigint"))
    return target


def q_bounded_topic_read(spark, sf):
    target = _publish_posts(spark, sf)
    return topic.read_bounded(spark, TOPIC, POST, target=target, max_messages=100)


def q_bounded_reads_continue(spark, sf):
    """Two bounded reads of one consumer group: the second goes on where the first ended."""
    target, store = _publish_posts(spark, sf), scratch_path(spark, "position")
    read = lambda: topic.read_bounded(spark, TOPIC, POST, target=target, max_messages=100,
                                      group_id="readers", position_store=store)
    first = read().withColumn("call", F.lit(1))
    return first.unionByName(read().withColumn("call", F.lit(2)))


def q_topic_scored(spark, sf):
    """The transport flow: cleaned posts to the topic, a bounded read, both scorers.

    The messages hold cleaned text (the search step cleans before
    publishing), so the read rows are scored without cleaning again.
    """
    target = _publish_posts(spark, sf)
    read = topic.read_bounded(spark, TOPIC, POST, target=target, max_messages=100)
    return score_posts(read, LexiconScorer(), scorer_b(spark, sf))


def q_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "csv")
    scored = _scored_keywords(spark, sf, limit=None)
    files.write_csv(scored, path)
    schema = scored.schema
    return files.read_csv(spark, path, schema)


def q_csv_skip_bad_lines(spark, sf):
    """S7 over lines with too many fields (fr), too few (de) and a bad number (es)."""
    path = scratch_path(spark, "lines")
    text, lang = F.col("doc_id").cast("string"), F.col("lang")
    line = (F.when(lang == "fr", F.concat_ws(",", text, "source", F.col("n_chars").cast("string"), F.lit("x")))
            .when(lang == "de", F.concat_ws(",", text, "source"))
            .when(lang == "es", F.concat_ws(",", text, "source", F.lit("many")))
            .otherwise(F.concat_ws(",", text, "source", F.col("n_chars").cast("string"))))
    spark.read.parquet(f"{sf}/documents.parquet").select(line.alias("value")).write.text(path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType())])
    rows = files.read_csv(spark, path, schema, skip_bad_lines=True, header=False)
    return rows.withColumn("n_chars", F.col("n_chars").cast("string"))


def q_report_export(spark, sf):
    path = scratch_path(spark, "report")
    scored = report.with_agreement(_scored_keywords(spark, sf, limit=None)).select(
        "keyword", "id", "title", "sentiment1", "sentiment2", "agreement")
    files.export_report(scored, path, ["keyword", "id"])
    schema = T.StructType([T.StructField("row_index", T.LongType())] + scored.schema.fields)
    return files.read_csv(spark, path, schema)


def _stream_table(spark: SparkSession, sources: list[str], write) -> DataFrame:
    """The table that ``write(source, table, base)`` streams into, one run per source.

    The name goes from the catalog at once; the files stay for the reader.
    """
    base = scratch_path(spark, "stream")
    table = "postlens_stream_" + base.rsplit("-", 1)[-1]
    for source in sources:
        write(source, table, base)
        columns = spark.read.table(table).schema
        spark.sql(f"DROP TABLE {table}")
    return spark.read.schema(columns).parquet(f"{base}/table")


def q_stream_to_table(spark, sf):
    # messages hold cleaned posts (as the search step publishes them): score only
    def write(source, table, base):
        run_stream_to_table(spark, TOPIC, table, f"{base}/table", f"{base}/checkpoint",
                            LexiconScorer(), scorer_b(spark, sf), source=source, clean=False)

    return _stream_table(spark, [_publish_posts(spark, sf)], write).select(*TABLE_COLUMNS)


def q_stream_two_runs(spark, sf):
    """Posts arrive in two lots; each run catches up on one checkpoint, ``FILES_PER_TRIGGER`` files per trigger."""
    target = scratch_path(spark, "topic")
    posts = clean_posts(_posts(spark, sf, comments=True).select(*POST_COLUMNS, "forum"))
    lots = {"first": F.col("forum") < "src2", "second": ~F.coalesce(F.col("forum") < "src2", F.lit(False))}

    def write(lot, table, base):
        topic.send(posts.where(lots[lot]).drop("forum"), TOPIC, target=target)
        run_stream_to_table(spark, TOPIC, table, f"{base}/table", f"{base}/checkpoint", LexiconScorer(),
                            scorer_b(spark, sf), source=target, clean=False, max_per_trigger=FILES_PER_TRIGGER)

    return _stream_table(spark, list(lots), write).select(*TABLE_COLUMNS)


def q_plain_stream_decode(spark, sf):
    """The three-column decode of a stream of already scored posts."""
    target = scratch_path(spark, "topic")
    topic.send(_scored_posts(spark, sf), TOPIC, target=target)

    def write(source, table, base):
        stream = decode_stream(topic.subscribe(spark, TOPIC, target=source))
        write_table(stream, table, f"{base}/table", f"{base}/checkpoint").awaitTermination()

    return _stream_table(spark, [target], write)


def _in_lots(spark, sf, run) -> None:
    """``run(source)`` after each of two lots of raw posts is published to one topic, the second adding to the first."""
    target = scratch_path(spark, "topic")
    posts = _posts(spark, sf, comments=True).select(*POST_COLUMNS, "forum")
    first = F.coalesce(F.col("forum") < "src2", F.lit(False))
    for lot in (first, ~first):
        topic.send(posts.where(lot).drop("forum"), TOPIC, target=target, offset=F.col("id").cast("bigint"))
        run(topic.subscribe(spark, TOPIC, target=target, max_per_trigger=FILES_PER_TRIGGER))


def _live_report(spark, sf) -> str:
    path = scratch_path(spark, "live")
    _in_lots(spark, sf, lambda messages: run_live_report(messages, path, KEYWORDS, LexiconScorer(), scorer_b(spark, sf)))
    return path


def q_live_agreement_by_keyword(spark, sf):
    """A4 kept up to date by a stream over two runs."""
    return live_agreement_by_keyword(spark, _live_report(spark, sf))


def q_live_posts_per_keyword(spark, sf):
    """A6 kept up to date by a stream over two runs."""
    return live_posts_per_keyword(spark, _live_report(spark, sf), keyword_frame(spark, [*KEYWORDS, "unheardof"]))


def q_dead_letters(spark, sf):
    """Messages of which some are cut off (ids divisible by 13) or hold a text for a number (by 17): all come out, each once."""
    path, target = scratch_path(spark, "letters"), scratch_path(spark, "topic")
    number, value = F.col("offset"), F.col("value").cast("string")
    posts = clean_posts(_posts(spark, sf, comments=True).select(*POST_COLUMNS))
    messages = topic.to_messages(posts, TOPIC, offset=F.col("id").cast("bigint"))
    cut = F.substring(value, F.lit(1), F.length(value) - 1)
    wrong = F.regexp_replace(value, F.lit(r'"num_comments":[0-9]+'), F.lit('"num_comments":"many"'))
    sent = messages.withColumn("value", F.when(number % 13 == 0, cut).when(number % 17 == 0, wrong).otherwise(value).cast("binary"))
    for lot in (number % 2 == 0, number % 2 == 1):
        sent.where(lot).write.mode("append").parquet(target)
        run_with_dead_letters(topic.subscribe(spark, TOPIC, target=target, max_per_trigger=FILES_PER_TRIGGER), path, LexiconScorer(),
                              scorer_b(spark, sf), clean=False)
    good = living_letters(spark, path).select("offset", F.lit(False).alias("dead"), "id", "sentiment1", "sentiment2")
    none = F.lit(None).cast("string")
    return good.unionByName(dead_letters(spark, path).select(
        "offset", F.lit(True).alias("dead"), *[none.alias(c) for c in ("id", "sentiment1", "sentiment2")]))


def q_stream_table_by_name(spark, sf):
    """A stream's table read by its name: by a reader that began before a compaction, and after it."""
    base, source = scratch_path(spark, "named"), _publish_posts(spark, sf)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in TABLE_COLUMNS])
    table = StreamTable(spark, "postlens_named_" + base.rsplit("-", 1)[-1], f"{base}/table", schema).create()
    stream = scored_stream(topic.subscribe(spark, TOPIC, target=source, max_per_trigger=2), LexiconScorer(), scorer_b(spark, sf), clean=False)
    table.run(stream, f"{base}/checkpoint", compact_every=3)
    before = table.read().withColumn("reader", F.lit("before"))
    table.compact(1 << 40)  # the stream has ended: everything
    after = table.read().withColumn("reader", F.lit("after"))
    return before.unionByName(after)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__.removeprefix("q_"): f for f in (
    q_posts_scan, q_stored_posts, q_newest_posts, q_newest_posts_of_forum, q_head_posts, q_search_posts,
    q_search_posts_clean, q_top_posts_per_keyword, q_keyword_union, q_posts_per_keyword, q_empty_keyword,
    q_many_keywords, q_keywords_10k, q_keywords_10k_top, q_search_by_relevance,
    q_search_by_relevance_of_forum, q_strip_urls, q_clean_text, q_created_ts, q_score_lexicon, q_train_nb, q_score_nb,
    q_sentiment_result, q_sentiment_first, q_score_posts, q_score_join_by_id, q_score_any_transformer,
    q_title_join_fanout, q_title_join_labels, q_analyze_keywords, q_analyze_keywords_of_forum,
    q_agreement_flag, q_agreement_counts, q_agreement_for_keyword, q_agreement_by_keyword, q_agreement_by_10k_keywords,
    q_sentiment_by_keyword, q_keyword_options, q_flair_counts, q_flair_counts_of_forum, q_json_encode,
    q_json_text, q_timestamp_message, q_json_decode, q_bounded_topic_read, q_bounded_reads_continue,
    q_topic_scored, q_csv_roundtrip, q_csv_skip_bad_lines, q_report_export, q_stream_to_table,
    q_stream_two_runs, q_plain_stream_decode, q_live_agreement_by_keyword, q_live_posts_per_keyword, q_dead_letters,
    q_stored_models, q_stored_models_in_a_stream, q_stream_table_by_name)}
