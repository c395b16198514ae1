"""Job lanes as a streaming source: real jobs before speculative ones, a bounded number in each batch.

``publish`` appends jobs to a folder: Parquet files by lane, numbered in order of arrival, then one marker that
makes the whole append visible at once. The source ``job_lanes`` reads that folder. Its offset is the number of
jobs taken from each lane; a batch takes up to ``slots`` real jobs, or, where none waits, up to ``slots``
speculative ones. The position that was planned last lies beside the lanes, so a query that starts again from
its checkpoint neither skips nor repeats a job: what was planned but not finished is read again by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from calibron.operators.policy import running
from calibron.sources.scratch import file_system, read_json, write_json

LANES = ("real", "spec")
SCHEMA = "lane string, place long, job_id string, fields string"
#: Jobs that one task reads.
TASK_JOBS = 100_000


def published(uri: str) -> dict[str, int]:
    """How many jobs each lane has."""
    return {lane: max((m[lane] for m in read_json(uri, "_published")), default=0) for lane in LANES}


def publish(jobs: DataFrame, uri: str) -> dict[str, int]:
    """Appends ``jobs(seq, speculative, job_id, ...)``; every column becomes a string of the JSON record ``fields``.

    Jobs of one append are numbered by ``seq`` after all earlier ones; ``job_id`` breaks ties. An append that
    dies before its marker has no effect: its files stand under a number that the next append takes anew.
    """
    spark, before = jobs.sparkSession, published(uri)
    number = len(read_json(uri, "_published"))
    fields = F.to_json(F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in jobs.columns)))
    lane = F.when(F.col("speculative"), "spec").otherwise("real")
    rows = jobs.select(lane.alias("lane"), "seq", "job_id", fields.alias("fields"))
    placed = running(rows.withColumn("one", F.lit(1)), "lane", ["seq", "job_id"], "one")
    at = F.col("place") - 1 + F.when(F.col("lane") == "real", before["real"]).otherwise(before["spec"])
    placed.select("lane", at.cast("long").alias("place"), "job_id", "fields").write.mode("overwrite").partitionBy("lane").parquet(f"{uri}/jobs/{number:08d}")
    counts = {r["lane"]: r["n"] for r in spark.read.schema(SCHEMA).parquet(f"{uri}/jobs/{number:08d}").groupBy("lane").agg(F.count(F.lit(1)).alias("n")).collect()}
    after = {lane: before[lane] + counts.get(lane, 0) for lane in LANES}
    write_json(uri, f"_published/{number:08d}.json", after)
    return after


class Places(InputPartition):
    def __init__(self, lane: str, first: int, end: int, appends: int):
        self.lane, self.first, self.end, self.appends = lane, first, end, appends


class LaneReader(DataSourceStreamReader):
    def __init__(self, uri: str, slots: int):
        self.uri, self.slots, self.at = uri, slots, None

    def initialOffset(self) -> dict:
        return dict.fromkeys(LANES, 0)

    def latestOffset(self) -> dict:
        if self.at is None:
            planned = read_json(self.uri, "_planned")
            self.at = planned[-1] if planned else self.initialOffset()
        waiting = {lane: n - self.at[lane] for lane, n in published(self.uri).items()}
        lane = "real" if waiting["real"] > 0 else "spec"
        if waiting[lane] > 0:
            self.at = self.at | {lane: self.at[lane] + min(self.slots, waiting[lane])}
            write_json(self.uri, "_planned/position.json", self.at)
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Places]:
        appends = len(read_json(self.uri, "_published"))
        return [Places(lane, at, min(at + TASK_JOBS, end[lane]), appends) for lane in LANES for at in range(start[lane], end[lane], TASK_JOBS)]

    def read(self, partition: Places) -> Iterator:
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSelector

        fs, path = file_system(self.uri)
        for number in range(partition.appends):
            folder = f"{path}/jobs/{number:08d}/lane={partition.lane}"
            files = [f.path for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet")]
            if not files:
                continue
            place = ds.field("place")
            wanted = (place >= partition.first) & (place < partition.end)
            for batch in ds.dataset(files, filesystem=fs, format="parquet").to_batches(columns=["place", "job_id", "fields"], filter=wanted):
                if batch.num_rows:
                    lane = pa.array([partition.lane] * batch.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([lane, batch.column("place"), batch.column("job_id"), batch.column("fields")], names=["lane", "place", "job_id", "fields"])


class JobLanes(DataSource):
    """``spark.readStream.format("job_lanes")`` with the options ``path`` (a folder that all machines see) and ``slots``."""

    @classmethod
    def name(cls) -> str:
        return "job_lanes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LaneReader:
        return LaneReader(self.options["path"], int(self.options.get("slots", "200")))


def read_lanes(spark: SparkSession, uri: str, slots: int = 200) -> DataFrame:
    """The jobs of a lane folder as a stream."""
    spark.dataSource.register(JobLanes)
    return spark.readStream.format("job_lanes").option("slots", str(slots)).load(uri)
