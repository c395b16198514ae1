"""Intermediate tables in the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder; where none is set a local session takes a temporary folder of its own, a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="calibron-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Items that every task may hold; a larger bank meets the models in blocks of as many.
BANK_ROWS = 200_000


def with_every_item(models: DataFrame, bank: DataFrame) -> DataFrame:
    """Each row of ``models`` beside each row of ``bank``, which has the column item_idx.

    A bank of up to ``BANK_ROWS`` rows (counted) goes to every task. A larger one is cut into blocks by hash,
    and the models go to each block, so that both sides are shuffled by block.
    """
    bank = written(bank, "bank")
    n = bank.count()
    if n <= BANK_ROWS:
        return models.crossJoin(F.broadcast(bank))
    blocks = -(-n // BANK_ROWS)
    each = models.withColumn("bank_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.join(bank.withColumn("bank_block", F.pmod(F.xxhash64("item_idx"), F.lit(blocks)).cast("int")), "bank_block").drop("bank_block")


def file_system(uri: str):
    """Arrow's file system and path of a folder that all machines see."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def read_json(uri: str, name: str) -> list[dict]:
    """The JSON documents of a folder, by file name."""
    from pyarrow.fs import FileSelector, FileType

    fs, path = file_system(uri)
    files = [f for f in fs.get_file_info(FileSelector(f"{path}/{name}", allow_not_found=True)) if f.type == FileType.File and f.path.endswith(".json")]
    out = []
    for f in sorted(files, key=lambda f: f.path):
        with fs.open_input_stream(f.path) as data:
            out.append(json.loads(data.read()))
    return out


def write_json(uri: str, name: str, value: dict) -> None:
    """A small JSON document that is there as a whole or not at all."""
    fs, path = file_system(uri)
    fs.create_dir(f"{path}/{name.rsplit('/', 1)[0]}", recursive=True)
    with fs.open_output_stream(f"{path}/{name}.tmp") as out:
        out.write(json.dumps(value).encode())
    fs.move(f"{path}/{name}.tmp", f"{path}/{name}")
