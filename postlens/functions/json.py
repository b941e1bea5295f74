"""JSON message encoding (C4, K1) and decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


# How timestamps with and without a zone are written in a message.
TIMESTAMP_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
                  "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def encode_json(*cols: str | Column) -> Column:
    """C4: a row (or chosen columns) as JSON text, nulls written as ``null``.

    Spark's default drops null fields; ``ignoreNullFields=false`` keeps them.
    Timestamps are written as ISO text with microseconds, so no
    column has to be left out; decode them with a timestamp field.
    """
    target = F.struct(*cols) if cols else F.struct("*")
    return F.to_json(target, {"ignoreNullFields": "false"} | TIMESTAMP_TEXT)


def decode_json(value: Column | str, schema: T.StructType) -> Column:
    """C6 + C7: bytes or text to a struct of ``schema``.

    Unknown fields are dropped, missing ones are null, and malformed text
    gives a struct of nulls (the row is kept).
    """
    c = F.col(value) if isinstance(value, str) else value
    return F.from_json(c.cast("string"), schema, TIMESTAMP_TEXT)
