"""DuckDB SQL for each registered query (the correctness oracle).

Written independently of the Spark plans, against the same parquet tables
(views ``documents labels conversations pages events``). Regex classes are
the RE2 spellings of the Spark patterns in ``postlens.functions.text``.
"""

from __future__ import annotations

from postlens.operators.scoring import NEGATIVE_WORDS, POSITIVE_WORDS
from postlens.plans.registry import (
    GIVEN_KEYWORDS, KEYWORDS, LONG_TEXT, MANY_KEYWORDS, RELEVANCE_QUERIES, REPORT_KEYWORD, SEARCH_FORUM, SEARCH_KEYWORD, TABLE_KEYWORDS, TABLE_TOP,
)

# RE2 forms of the URL and cleaning patterns, and the token delimiter.
URL_RE2 = r"http[^\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
DISALLOWED_RE2 = r"[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}.,!?]"
TOKEN_RE2 = r"[^\p{L}\p{N}_]+"


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in_list(words) -> str:
    return ", ".join(_quote(w) for w in words)


def clean(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{URL_RE2}', '', 'g'), '{DISALLOWED_RE2}', '', 'g')"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '{TOKEN_RE2}'), lambda t: t <> '')"


def ts(x: str) -> str:
    return f"make_timestamp(CAST(round({x} * 1000000) AS BIGINT))"


POST_COLS = "title, author, score, id, url, created_utc, selftext, num_comments"

POSTS = """posts AS (
  SELECT d.doc_id,
    split_part(d.text, chr(10), 1) AS title,
    coalesce(CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE 'user' || CAST(d.doc_id % 97 AS VARCHAR) END, 'None') AS author,
    d.n_chars AS score,
    CAST(d.doc_id AS VARCHAR) AS id,
    'http://example.org/' || d.source || '/' || CAST(d.doc_id AS VARCHAR) AS url,
    CAST(1704067200 + d.doc_id * 60 AS DOUBLE) AS created_utc,
    d.text || ' see ' || 'http://example.org/' || d.source || '/' || CAST(d.doc_id AS VARCHAR) || ' now' AS selftext,
    CAST(coalesce(c.n, 0) AS BIGINT) AS num_comments,
    d.source AS forum,
    CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 7 = 1 THEN '' ELSE d.lang END AS link_flair_text
  FROM documents d
  LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c ON c.conv_id = d.doc_id
)"""

def keyword_table(keywords) -> str:
    values = ", ".join(f"({_quote(k)})" for k in keywords)
    return f"kw AS (SELECT keyword FROM (VALUES {values}) t(keyword))"


KW = keyword_table(KEYWORDS)

HASHED_KW = f"""kw AS (
  SELECT keyword FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS keyword FROM documents) WHERE keyword <> ''
  ORDER BY md5(keyword), keyword LIMIT {TABLE_KEYWORDS}
)"""

TAGGED = """tagged AS (
  SELECT p.*, k.keyword FROM posts p JOIN (
    SELECT keyword, lower(regexp_replace(keyword, '^[ \\t\\n\\r\\v\\f]+|[ \\t\\n\\r\\v\\f]+$', '', 'g')) AS needle FROM kw) k
    ON k.needle <> '' AND (contains(lower(p.title), k.needle) OR contains(lower(p.selftext), k.needle))
)"""

# Scorer A and B over every post's cleaned text: scores(id, lexicon_score, sentiment1, nb_score, sentiment2)
SCORES = f"""cp AS (SELECT id, {clean('selftext')} AS text FROM posts),
cpt AS (SELECT id, text, {toks('text')} AS toks FROM cp),
train AS (
  SELECT {clean('p.selftext')} AS text, l.toxic FROM posts p JOIN labels l ON l.doc_id = p.doc_id
),
totals AS (
  SELECT sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS n0 FROM train
),
tdocs AS (SELECT list_distinct({toks('text')}) AS toks, CAST(toxic AS BIGINT) AS y FROM train WHERE toxic IN (0, 1)),
tcounts AS (
  SELECT token, CAST(sum(y) AS BIGINT) AS a, CAST(sum(1 - y) AS BIGINT) AS b
  FROM (SELECT unnest(toks) AS token, y FROM tdocs) GROUP BY token
),
tq AS (
  SELECT token, a, b, n1, n0, (a + b) / (n1 + n0) AS q
  FROM (SELECT token, a, b, (SELECT n1 FROM totals) AS n1, (SELECT n0 FROM totals) AS n0 FROM tcounts)
  WHERE a + b >= 5
),
tstats AS (
  SELECT token, a, b,
    CASE WHEN q * (1.0::DOUBLE - q) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0) > 0
      THEN abs(a / n1 - b / n0) / sqrt(q * (1.0::DOUBLE - q) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)) END AS z,
    ln((a + 1) / (n1 + 2)) - ln((b + 1) / (n0 + 2)) AS w
  FROM tq
),
vocab AS (SELECT token, a, b, z, w FROM tstats WHERE z >= 4),
nbsum AS (
  SELECT x.id, sum(v.w) AS total
  FROM (SELECT id, unnest(list_distinct(toks)) AS token FROM cpt) x JOIN vocab v ON v.token = x.token
  GROUP BY x.id
),
scores AS (
  SELECT c.id,
    CASE WHEN c.text IS NULL THEN NULL ELSE
      CAST(len(list_filter(c.toks, lambda t: t IN ({_in_list(POSITIVE_WORDS)})))
         - len(list_filter(c.toks, lambda t: t IN ({_in_list(NEGATIVE_WORDS)}))) AS BIGINT) END AS lexicon_score,
    CASE WHEN c.text IS NULL THEN NULL ELSE
      round(coalesce(n.total, 0.0) + (SELECT ln(n1 / n0) FROM totals), 6) END AS nb_score
  FROM cpt c LEFT JOIN nbsum n ON n.id = c.id
),
labelled AS (
  SELECT id, lexicon_score, nb_score,
    CASE WHEN lexicon_score IS NULL THEN NULL WHEN lexicon_score < 0 THEN 'neg' ELSE 'pos' END AS sentiment1,
    CASE WHEN nb_score IS NULL THEN NULL WHEN nb_score > 0 THEN 'neg' ELSE 'pos' END AS sentiment2
  FROM scores
)"""

SCORED_POSTS = f"""scored_posts AS (
  SELECT p.title, p.author, p.score, p.id, p.url, p.created_utc, {clean('p.selftext')} AS selftext,
    p.num_comments, l.sentiment1, l.sentiment2
  FROM posts p JOIN labelled l ON l.id = p.id
)"""


def scored_keywords(limit: int | None) -> str:
    qualify = f"QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY score DESC, id) <= {limit}" if limit else ""
    return f"""sel AS (SELECT * FROM tagged {qualify}),
scored AS (
  SELECT s.title, s.author, s.score, s.id, s.url, {ts('s.created_utc')} AS created_utc,
    {clean('s.selftext')} AS selftext, s.num_comments, l.sentiment1, l.sentiment2, s.keyword
  FROM sel s JOIN labelled l ON l.id = s.id
),
flagged AS (
  SELECT *, CASE WHEN sentiment1 = sentiment2 THEN 'Agree' ELSE 'Disagree' END AS agreement FROM scored
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (POSTS, KW, TAGGED)
ALL_SCORED = BASE + (SCORES, scored_keywords(None))
TOP_SCORED = BASE + (SCORES, scored_keywords(50))

MATCH = (f"(contains(lower(title), lower({_quote(SEARCH_KEYWORD)})) "
         f"OR contains(lower(selftext), lower({_quote(SEARCH_KEYWORD)})))")

# Integer BM25 of the title's and the body's tokens: weights in thousandths, frequency parts in millionths.
RELEVANCE = f"""rq AS (SELECT keyword, term, count(*) AS times FROM (SELECT keyword, unnest({toks('keyword')}) AS term FROM kw) GROUP BY keyword, term),
rp AS (SELECT id, forum, title, list_concat({toks('title')}, {toks('selftext')}) AS w FROM posts),
rs AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS total FROM rp),
rt AS (SELECT id, forum, title, dl, term, count(*) AS tf FROM (SELECT id, forum, title, len(w) AS dl, unnest(w) AS term FROM rp)
       WHERE term IN (SELECT term FROM rq) GROUP BY id, forum, title, dl, term),
rw AS (SELECT term, CAST(floor(1000 * ln(1 + (any_value(rs.n) - count(*) + 0.5) / (count(*) + 0.5))) AS BIGINT) AS weight FROM rt, rs GROUP BY term),
rscore AS (SELECT keyword, id, title, forum, CAST(sum(times * weight * ((2200000000 * tf) // (1000 * tf + 300 + (900 * rs.n * dl) // rs.total))) AS BIGINT) AS relevance
           FROM rt JOIN rw USING (term) JOIN rq USING (term), rs GROUP BY keyword, id, title, forum)"""


def relevant(where: str) -> str:
    return _with(POSTS, keyword_table(RELEVANCE_QUERIES), RELEVANCE) + (
        "SELECT keyword, CAST(rank AS INTEGER) AS rank, id, relevance, title, forum FROM "
        "(SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY relevance DESC, id) AS rank FROM rscore "
        f"WHERE relevance > 0 AND {where}) WHERE rank <= 50")


SQL: dict[str, str] = {
    "posts_scan": _with(POSTS) + f"SELECT {POST_COLS} FROM posts",
    "newest_posts": _with(POSTS) + f"SELECT {POST_COLS} FROM posts ORDER BY created_utc DESC, id LIMIT 100",
    "newest_posts_of_forum": _with(POSTS) + (
        f"SELECT {POST_COLS} FROM posts WHERE forum = {_quote(SEARCH_FORUM)} ORDER BY created_utc DESC, id LIMIT 100"),
    "stored_posts": _with(POSTS) + f"SELECT {POST_COLS} FROM posts",
    "head_posts": _with(POSTS) + f"SELECT {POST_COLS} FROM posts ORDER BY id LIMIT 5",
    "search_posts": _with(POSTS) + (
        f"SELECT {POST_COLS} FROM posts WHERE forum = {_quote(SEARCH_FORUM)} AND {MATCH} "
        "ORDER BY score DESC, id LIMIT 50"),
    "search_posts_clean": _with(POSTS) + (
        f"SELECT title, author, score, id, url, created_utc, {clean('selftext')} AS selftext, num_comments "
        f"FROM posts WHERE forum = {_quote(SEARCH_FORUM)} AND {MATCH} ORDER BY score DESC, id LIMIT 50"),
    "top_posts_per_keyword": _with(*BASE) + (
        "SELECT keyword, id, score, title FROM tagged "
        "QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY score DESC, id) <= 50"),
    "keyword_union": _with(*BASE) + (
        "SELECT keyword, id, score, title FROM tagged "
        "QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY score DESC, id) <= 50"),
    "posts_per_keyword": _with(POSTS, keyword_table(GIVEN_KEYWORDS), TAGGED) + (
        "SELECT k.keyword, CAST(count(t.id) AS BIGINT) AS n_posts FROM kw k "
        "LEFT JOIN tagged t ON t.keyword = k.keyword GROUP BY k.keyword"),
    "empty_keyword": _with(POSTS, keyword_table(GIVEN_KEYWORDS), TAGGED) + (
        "SELECT k.keyword, count(t.id) = 0 AS is_empty FROM kw k "
        "LEFT JOIN tagged t ON t.keyword = k.keyword GROUP BY k.keyword"),
    "many_keywords": _with(POSTS, keyword_table(MANY_KEYWORDS), TAGGED) + (
        "SELECT k.keyword, CAST(count(t.id) AS BIGINT) AS n_posts FROM kw k "
        "LEFT JOIN tagged t ON t.keyword = k.keyword GROUP BY k.keyword"),
    "keywords_10k": _with(POSTS, HASHED_KW, TAGGED) + (
        "SELECT k.keyword, CAST(count(t.id) AS BIGINT) AS n_posts FROM kw k "
        "LEFT JOIN tagged t ON t.keyword = k.keyword GROUP BY k.keyword"),
    "keywords_10k_top": _with(POSTS, HASHED_KW, TAGGED) + (
        "SELECT keyword, id, score FROM tagged "
        f"QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY score DESC, id) <= {TABLE_TOP}"),
    "search_by_relevance": relevant("TRUE"),
    "search_by_relevance_of_forum": relevant(f"forum = {_quote(SEARCH_FORUM)}"),
    "strip_urls": (
        f"SELECT page_id, regexp_replace(url, '{URL_RE2}', '', 'g') AS url_clean, "
        f"regexp_replace(html, '{URL_RE2}', '', 'g') AS html_clean FROM pages"),
    "clean_text": _with(POSTS) + f"SELECT id, {clean('selftext')} AS clean_text FROM posts",
    "created_ts": _with(POSTS) + f"SELECT id, {ts('created_utc')} AS created_ts FROM posts",
    "score_lexicon": _with(POSTS, SCORES) + "SELECT id, lexicon_score, sentiment1 FROM labelled",
    "train_nb": _with(POSTS, SCORES) + "SELECT token, a, b, round(z, 6) AS z, round(w, 6) AS w FROM vocab",
    "score_nb": _with(POSTS, SCORES) + "SELECT id, nb_score, sentiment2 FROM labelled",
    "sentiment_result": _with(POSTS, SCORES) + (
        "SELECT p.id, p.title, l.sentiment1 AS result, "
        "CAST(CASE WHEN l.sentiment1 IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_results "
        "FROM posts p JOIN labelled l ON l.id = p.id"),
    "sentiment_first": _with(POSTS, SCORES) + "SELECT id, sentiment1, sentiment2 FROM labelled",
    "score_posts": _with(POSTS, SCORES, SCORED_POSTS) + "SELECT * FROM scored_posts",
    "score_join_by_id": _with(POSTS, SCORES, SCORED_POSTS) + "SELECT * FROM scored_posts",
    "score_any_transformer": _with(POSTS, SCORES) + (
        f"SELECT l.id, l.sentiment1, CASE WHEN length(c.text) > {LONG_TEXT} THEN 'pos' ELSE 'neg' END AS sentiment2 "
        "FROM labelled l JOIN cp c ON c.id = l.id"),
    "title_join_fanout": _with(POSTS) + (
        "SELECT p.title, CAST(count(*) AS VARCHAR) AS n FROM posts p JOIN posts a ON a.title = p.title "
        "JOIN posts b ON b.title = p.title GROUP BY p.title"),
    "title_join_labels": _with(POSTS, SCORES) + (
        "SELECT p.title, a.sentiment1, b.sentiment2, CAST(count(*) AS VARCHAR) AS n_rows "
        "FROM posts p JOIN (SELECT q.title, l.sentiment1 FROM posts q JOIN labelled l ON l.id = q.id) a "
        "ON a.title = p.title "
        "JOIN (SELECT q.title, l.sentiment2 FROM posts q JOIN labelled l ON l.id = q.id) b "
        "ON b.title = p.title GROUP BY p.title, a.sentiment1, b.sentiment2"),
    "analyze_keywords": _with(*TOP_SCORED) + "SELECT * EXCLUDE (agreement) FROM flagged",
    "analyze_keywords_of_forum": _with(POSTS, KW, TAGGED.replace("FROM posts p", f"FROM (SELECT * FROM posts WHERE forum = {_quote(SEARCH_FORUM)}) p"),
                                       SCORES, scored_keywords(50)) + "SELECT * EXCLUDE (agreement) FROM flagged",
    "agreement_flag": _with(*ALL_SCORED) + "SELECT keyword, id, sentiment1, sentiment2, agreement FROM flagged",
    "agreement_counts": _with(*ALL_SCORED) + "SELECT agreement, count(*) AS n_posts FROM flagged GROUP BY agreement",
    "agreement_for_keyword": _with(*ALL_SCORED) + (
        f"SELECT agreement, count(*) AS n_posts FROM flagged WHERE keyword = {_quote(REPORT_KEYWORD)} "
        "GROUP BY agreement"),
    "agreement_by_keyword": _with(*ALL_SCORED) + (
        "SELECT CASE WHEN grouping(keyword) = 1 THEN 'All' ELSE keyword END AS keyword, agreement, "
        "count(*) AS n_posts FROM flagged GROUP BY GROUPING SETS ((keyword, agreement), (agreement))"),
    "sentiment_by_keyword": _with(*ALL_SCORED) + (
        "SELECT keyword, sentiment1, count(*) AS n_posts FROM scored "
        "WHERE keyword IS NOT NULL AND sentiment1 IS NOT NULL GROUP BY keyword, sentiment1"),
    "keyword_options": _with(*ALL_SCORED) + (
        "SELECT 'All' AS option, CAST(0 AS BIGINT) AS position UNION ALL "
        "SELECT keyword AS option, row_number() OVER (ORDER BY keyword) AS position "
        "FROM (SELECT DISTINCT keyword FROM scored WHERE keyword IS NOT NULL)"),
    "flair_counts": _with(POSTS) + (
        "SELECT link_flair_text AS flair, count(*) AS n_posts FROM "
        "(SELECT * FROM posts ORDER BY created_utc DESC, id LIMIT 100) "
        "WHERE link_flair_text IS NOT NULL AND link_flair_text <> '' GROUP BY link_flair_text"),
    "flair_counts_of_forum": _with(POSTS) + (
        "SELECT link_flair_text AS flair, count(*) AS n_posts FROM "
        f"(SELECT * FROM posts WHERE forum = {_quote(SEARCH_FORUM)} ORDER BY created_utc DESC, id LIMIT 100) "
        "WHERE link_flair_text IS NOT NULL AND link_flair_text <> '' GROUP BY link_flair_text"),
    "json_text": _with(POSTS) + (
        "SELECT id, title, author, CAST(score AS VARCHAR) AS score, url, selftext, "
        "CAST(num_comments AS VARCHAR) AS num_comments FROM posts"),
    "timestamp_message": _with(POSTS) + (
        f"SELECT title, author, score, id, url, {ts('created_utc')} AS created_utc, selftext, num_comments FROM posts"),
    "json_encode": _with(POSTS) + f"SELECT {POST_COLS} FROM posts",
    "json_decode": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "bounded_topic_read": _with(POSTS) + (
        f"SELECT title, author, score, id, url, created_utc, {clean('selftext')} AS selftext, num_comments "
        "FROM posts ORDER BY doc_id LIMIT 100"),
    "bounded_reads_continue": _with(POSTS) + (
        f"SELECT title, author, score, id, url, created_utc, {clean('selftext')} AS selftext, num_comments, "
        "CAST(CASE WHEN row_number() OVER (ORDER BY doc_id) <= 100 THEN 1 ELSE 2 END AS INTEGER) AS call "
        "FROM posts ORDER BY doc_id LIMIT 200"),
    "topic_scored": _with(POSTS, SCORES) + (
        f"SELECT p.title, p.author, p.score, p.id, p.url, p.created_utc, {clean('p.selftext')} AS selftext, "
        "p.num_comments, l.sentiment1, l.sentiment2 "
        "FROM posts p JOIN labelled l ON l.id = p.id ORDER BY p.doc_id LIMIT 100"),
    "csv_roundtrip": _with(*ALL_SCORED) + (
        "SELECT title, author, score, id, url, created_utc, selftext, num_comments, sentiment1, sentiment2, keyword FROM scored"),
    "csv_skip_bad_lines": (
        "SELECT doc_id, source, CASE WHEN lang IN ('de', 'es') THEN NULL ELSE CAST(n_chars AS VARCHAR) END AS n_chars "
        "FROM documents WHERE lang IS DISTINCT FROM 'fr'"),
    "report_export": _with(*ALL_SCORED) + (
        "SELECT CAST(row_number() OVER (ORDER BY keyword, id) - 1 AS BIGINT) AS row_index, keyword, id, "
        "title, sentiment1, sentiment2, agreement FROM flagged"),
    "stream_to_table": _with(POSTS, SCORES, SCORED_POSTS) + "SELECT id, title, sentiment1, sentiment2 FROM scored_posts",
    "stream_two_runs": _with(POSTS, SCORES, SCORED_POSTS) + "SELECT id, title, sentiment1, sentiment2 FROM scored_posts",
    "plain_stream_decode": _with(POSTS, SCORES, SCORED_POSTS) + "SELECT title, sentiment1, sentiment2 FROM scored_posts",
    "dead_letters": _with(POSTS, SCORES) + (
        "SELECT doc_id AS offset, doc_id % 13 = 0 OR doc_id % 17 = 0 AS dead, "
        + ", ".join(f"CASE WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN NULL ELSE {c} END AS {c.split('.')[1]}"
                    for c in ("p.id", "l.sentiment1", "l.sentiment2"))
        + " FROM posts p JOIN labelled l ON l.id = p.id"),
    "live_posts_per_keyword": _with(POSTS, keyword_table([*KEYWORDS, "unheardof"]), TAGGED) + (
        "SELECT k.keyword, CAST(count(t.id) AS BIGINT) AS n_posts FROM kw k "
        "LEFT JOIN tagged t ON t.keyword = k.keyword GROUP BY k.keyword"),
}
SQL["live_agreement_by_keyword"] = SQL["agreement_by_keyword"]
SQL["stored_models"] = SQL["stored_models_in_a_stream"] = SQL["sentiment_first"]
SQL["stream_table_by_name"] = _with(POSTS, SCORES, SCORED_POSTS) + (
    "SELECT id, title, sentiment1, sentiment2, reader FROM scored_posts, (VALUES ('before'), ('after')) r(reader)")
SQL["agreement_by_10k_keywords"] = _with(POSTS, HASHED_KW, TAGGED, SCORES) + (
    "SELECT CASE WHEN grouping(keyword) = 1 THEN 'All' ELSE keyword END AS keyword, agreement, count(*) AS n_posts FROM "
    "(SELECT t.keyword, CASE WHEN l.sentiment1 = l.sentiment2 THEN 'Agree' ELSE 'Disagree' END AS agreement "
    "FROM tagged t JOIN labelled l ON l.id = t.id) GROUP BY GROUPING SETS ((keyword, agreement), (agreement))")
