"""CSV report sink and source (K2, K3, S6, S7) and the distributed row index.

Options make the round trip lossless: quotes are escaped by doubling
(``escape='"'``, what pandas expects), records may span lines (``multiLine``),
and null is written as a marker, so that an empty string stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.session import checkpoint_root

# The text that stands for null in a report.
NULL_MARK = r"\N"
_CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "nullValue": NULL_MARK}


def write_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """K2: CSV with header. ``single_file`` (``coalesce(1)``) only for report-sized frames."""
    out = df.coalesce(1) if single_file else df
    out.write.options(**_CSV_OPTIONS).mode(mode).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             skip_bad_lines: bool = False, header: bool = True) -> DataFrame:
    """Read a CSV report with a fixed schema, strictly.

    ``skip_bad_lines`` is S7: as with the reference's reader, a line with too
    many fields is left out, one with too few gets nulls, and a value that does
    not fit its type is null. The fields are read as text, with one column
    more than the schema has; that column is part of the filter, so every
    column list and ``count()`` sees the same rows.
    """
    reader = spark.read.options(**_CSV_OPTIONS).option("multiLine", "true").option("header", str(header).lower())
    if not skip_bad_lines:
        return reader.schema(schema).option("mode", "FAILFAST").csv(path)
    extra = "_too_many"
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields]
                        + [T.StructField(extra, T.StringType())])
    rows = reader.schema(text).option("mode", "PERMISSIVE").csv(path)
    rows = rows.where(F.col(extra).isNull())
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def with_row_index(df: DataFrame, order_by: list, name: str = "row_index") -> DataFrame:
    """0-based position of each row in ``order_by`` order, without one-task windows.

    The frame is range-sorted and checkpointed to the shared checkpoint folder
    (so both passes see the same partitions), the per-partition row counts are
    turned into start offsets over a table with one row per partition, and the
    offsets are broadcast back. The broadcast side is bounded by the partition
    count, not by the data.
    """
    checkpoint_root(df.sparkSession)  # reliable checkpoint needs the shared folder set
    sorted_df = df.orderBy(*order_by).checkpoint(eager=True)
    tagged = (sorted_df.withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_start"))
    local_pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")
            .select((F.coalesce(F.col("_start"), F.lit(0)) + local_pos).alias(name),
                    *[F.col(c) for c in df.columns]))


def export_report(df: DataFrame, path: str, order_by: list, index_name: str = "row_index",
                  single_file: bool = False) -> None:
    """K3: re-export with a 0-based index as the first column.

    The rows are checkpointed before the sort: a range sort samples its input
    first, which would compute them twice.
    """
    checkpoint_root(df.sparkSession)
    write_csv(with_row_index(df.checkpoint(eager=True), order_by, index_name), path, single_file=single_file)
