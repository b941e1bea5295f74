"""K4: a stream's table that is read by name while it grows and is compacted.

The table lives in the catalog; its location is one generation folder,
``<path>/through=<batch>``, that holds all batches up to that number in a few large
files (``batch-<batch>``) and each later batch in such a folder of its own. A micro-batch writes its folder, replacing an earlier attempt.
``compact`` writes the next generation beside the present one and then
moves the table's location to it, one change in the catalog: a reader sees
either generation, whole, and a query that has begun reads on in the old
files, which stay where they are until their folder is removed. A batch that is run
again after its generation was compacted is already there and is not written twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.literals import sql_string

TARGET_BYTES = 128 << 20  # of a compacted file, about


class StreamTable:
    """A table ``name`` with data below ``path``; ``schema`` is that of its rows."""

    def __init__(self, spark: SparkSession, name: str, path: str, schema: T.StructType):
        self.spark, self.name, self.path, self.schema = spark, name, path.rstrip("/"), schema

    def create(self) -> StreamTable:
        """Register the table, empty, unless the catalog has it."""
        if not self.spark.catalog.tableExists(self.name):
            first = self._generation(-1)
            self._rows([]).coalesce(1).write.mode("overwrite").parquet(self._folder(first, -1))
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet "
                           f"OPTIONS (recursiveFileLookup 'true') LOCATION {sql_string(first)}")
        return self

    def _rows(self, rows: list) -> DataFrame:
        return self.spark.createDataFrame(rows, self.schema)

    def _generation(self, through: int) -> str:
        return f"{self.path}/through={through}"

    @staticmethod
    def _folder(generation: str, batch: int) -> str:
        return f"{generation}/batch-{batch}"

    @property
    def location(self) -> str:
        rows = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").where("col_name = 'Location'").collect()
        return rows[0].data_type

    @property
    def through(self) -> int:
        """The last batch that the present generation was compacted through, -1 for none."""
        return int(self.location.rstrip("/").rsplit("through=", 1)[1])

    def read(self) -> DataFrame:
        """The rows, by the table's name."""
        return self.spark.read.table(self.name)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write one batch; the same batch again replaces itself."""
        if batch > self.through:
            rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(self._folder(self.location, batch))
            self.spark.catalog.refreshTable(self.name)

    def run(self, stream: DataFrame, checkpoint: str, compact_every: int | None = None,
            written: Callable[[int], None] | None = None) -> None:
        """Append all that a stream has now; with ``compact_every``, compact after so many batches."""
        def write(rows: DataFrame, batch: int) -> None:
            if compact_every and batch > 0 and batch % compact_every == 0:
                self.compact(batch - 1)  # those are committed
            self.append(rows, batch)
            if written:
                written(batch)

        (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())

    def compact(self, through: int, target_bytes: int = TARGET_BYTES) -> None:
        """Bring all batches up to ``through``, which must be committed, into files of about ``target_bytes``.

        Later batches are copied as they are. Rows go straight from file to file, none passes the
        driver. A compaction that was cut off is run again from the start: the table still has its old location.
        """
        if through <= self.through:
            return
        old, new = self.location, self._generation(through)
        batches = self.batches()
        done = [b for b in batches if b <= through]
        files = max(1, -(-sum(batches[b] for b in done) // target_bytes))
        self._read(old, done).repartition(files).write.mode("overwrite").parquet(self._folder(new, through))
        for later in sorted(set(batches) - set(done)):
            self._read(old, [later]).write.mode("overwrite").parquet(self._folder(new, later))
        self.spark.sql(f"ALTER TABLE {self.name} SET LOCATION {sql_string(new)}")
        self.spark.catalog.refreshTable(self.name)

    def _read(self, generation: str, batches: list[int]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[self._folder(generation, b) for b in batches])

    def batches(self) -> dict[int, int]:
        """The batch folders of the present generation, with their bytes."""
        number = F.regexp_extract("path", "/batch-(-?[0-9]+)/", 1).cast("long").alias("n")
        return {r.n: r.size for r in _files(self.spark, self.location).groupBy(number).agg(F.sum("length").alias("size")).collect()}

    def files(self) -> int:
        """Data files of the present generation."""
        return _files(self.spark, self.location).count()

    def generations(self) -> list[int]:
        """The generations that lie below the path, the present one included."""
        folders = _files(self.spark, self.path).select(F.regexp_extract("path", "through=(-?[0-9]+)", 1).cast("int").alias("n"))
        return sorted(r.n for r in folders.distinct().collect())


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the data files below a folder: a listing, no content is read."""
    try:
        return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
                .load(path).select("path", "length"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length long")
