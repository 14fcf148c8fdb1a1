"""Tables written once into the folder that driver and executors share, and read back as plain columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_written: dict[tuple[str, str], tuple[str, object]] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where all runs in one process, as in tests, a folder of our own serves."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (path or f"{tempfile.gettempdir()}/sievework").rstrip("/")


def written(parts: dict[str, Callable[[], DataFrame]], spark: SparkSession, at_once: int = 8) -> DataFrame:
    """Tables of one schema, each planned and written by itself, some at once, and read back as one."""
    path = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex}"

    def write(part: tuple[str, Callable[[], DataFrame]]):
        df = part[1]()
        df.write.parquet(f"{path}/{part[0]}")
        return df.schema

    with ThreadPoolExecutor(at_once) as pool:
        schemas = list(pool.map(write, parts.items()))
    return spark.read.schema(schemas[0]).parquet(*[f"{path}/{name}" for name in parts])


def clean(spark: SparkSession) -> None:
    """Delete the stored tables of this application; they are made anew where they are asked for again."""
    for key, (path, _) in list(_written.items()):
        if key[0] == spark.sparkContext.applicationId:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            del _written[key]


def stored(spark: SparkSession, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of this key, written on first use in an application: its expressions run once, and plans over it stay small."""
    at = (spark.sparkContext.applicationId, key)
    if at not in _written:
        df = make()
        path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
        df.write.parquet(path)
        _written[at] = (path, df.schema)
    path, schema = _written[at]
    return spark.read.schema(schema).parquet(path)
