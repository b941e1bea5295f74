"""A stream's table read by name while it grows, is compacted, and fails."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import types as T

from postlens.session import scratch_path
from postlens.streaming.table import StreamTable

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])


def source(spark, rows, files):
    path = scratch_path(spark, "lots")
    df = spark.range(rows).selectExpr("id", "concat('text ', id) AS text")
    df.repartition(files, "id").write.parquet(path)
    return path, lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(path)


def table_of(spark):
    base = scratch_path(spark, "table")
    return StreamTable(spark, "t_" + base.rsplit("-", 1)[-1], f"{base}/data", SCHEMA).create(), f"{base}/checkpoint"


def ids(df):
    return sorted(r.id for r in df.collect())


def test_read_by_name_while_it_grows_and_is_compacted(spark):
    table, checkpoint = table_of(spark)
    _, stream = source(spark, 300, 10)
    assert ids(table.read()) == []
    seen, files = [], []

    def look(batch):
        seen.append(len(ids(spark.read.table(table.name))))
        files.append(table.files())

    table.run(stream(), checkpoint, compact_every=3, written=look)
    assert seen == sorted(seen) and seen[0] > 0 and seen[-1] == 300 and len(set(seen)) == len(seen)
    assert max(files) <= 5 and len(table.generations()) >= 3
    assert ids(spark.read.table(table.name)) == list(range(300))
    assert spark.read.table(table.name).columns == ["id", "text"]


def test_a_reader_that_has_begun_is_not_disturbed(spark):
    table, checkpoint = table_of(spark)
    _, stream = source(spark, 100, 5)
    table.run(stream(), checkpoint)
    reader = table.read()
    plan = reader._jdf.queryExecution().executedPlan()  # planned on the old files
    old = table.location
    table.compact(3)
    assert table.location != old and table.through == 3 and plan is not None
    assert ids(reader) == list(range(100)) and ids(table.read()) == list(range(100))
    table.compact(3)
    table.compact(2)
    assert table.through == 3
    table.compact(100)
    assert ids(table.read()) == list(range(100)) and table.files() == 1


def test_compacted_files_have_the_target_size(spark):
    table, checkpoint = table_of(spark)
    _, stream = source(spark, 3000, 4)
    table.run(stream(), checkpoint)
    table.compact(100, target_bytes=8 << 10)
    assert 2 <= table.files() <= 12 and ids(table.read()) == list(range(3000))


@pytest.mark.parametrize("at", [1, 3, 4])
def test_a_batch_that_is_run_again_is_written_once(spark, at):
    """Killed between write and commit, also when the rerun compacts first."""
    table, checkpoint = table_of(spark)
    _, stream = source(spark, 120, 6)

    def kill(batch):
        if batch == at:
            raise RuntimeError("killed")

    with pytest.raises(StreamingQueryException):
        table.run(stream(), checkpoint, compact_every=3, written=kill)
    table.run(stream(), checkpoint, compact_every=3)
    assert ids(table.read()) == list(range(120))
    table.run(stream(), checkpoint, compact_every=3)
    assert ids(table.read()) == list(range(120))


def test_a_compaction_that_was_cut_off_is_run_again(spark, monkeypatch):
    table, checkpoint = table_of(spark)
    _, stream = source(spark, 60, 6)
    table.run(stream(), checkpoint)
    with monkeypatch.context() as m:
        m.setattr("postlens.streaming.table.sql_string", lambda s: 1 / 0)  # dies after the files, before the swap
        with pytest.raises(ZeroDivisionError):
            table.compact(2)
    assert table.through == -1 and ids(table.read()) == list(range(60))
    table.compact(2)
    assert table.through == 2 and ids(table.read()) == list(range(60))


def test_a_batch_compacted_away_is_not_written_again(spark):
    table, _ = table_of(spark)
    rows = spark.createDataFrame([(1, "a")], SCHEMA)
    table.append(rows, 0)
    table.append(rows, 0)
    table.compact(0)
    table.append(rows, 0)
    assert ids(table.read()) == [1]
