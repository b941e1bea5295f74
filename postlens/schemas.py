"""Fixed schemas. Nothing in the library infers a schema from data."""

from pyspark.sql import types as T

# A post as the search returns it, in the order the scored table keeps.
POST_COLUMNS = [
    "title", "author", "score", "id", "url", "created_utc", "selftext", "num_comments",
]

POST = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("score", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("created_utc", T.DoubleType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("num_comments", T.LongType()),
])

# Forum-level attributes that the search filters on but does not return.
POST_TABLE = T.StructType(POST.fields + [
    T.StructField("forum", T.StringType()),
    T.StructField("link_flair_text", T.StringType()),
])

# A post as it travels once ``created_utc`` is a timestamp (after C3).
POST_TS = T.StructType([T.StructField(f.name, T.TimestampNTZType()) if f.name == "created_utc" else f for f in POST.fields])

# A post after scoring and keyword tagging (created_utc is a timestamp by then).
SCORED_COLUMNS = POST_COLUMNS + ["sentiment1", "sentiment2", "keyword"]

# What the streaming sink decodes from a message, all nullable.
STREAM = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("sentiment1", T.StringType()),
    T.StructField("sentiment2", T.StringType()),
])

# Scorer output: one annotation per post.
ANNOTATION = T.ArrayType(T.StructType([
    T.StructField("result", T.StringType()),
    T.StructField("score", T.DoubleType()),
]))

# Messages in a topic (Kafka source columns that the library reads).
MESSAGE = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])
