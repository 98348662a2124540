"""What the operators share: staged tables in the cluster's shared folder, and Arrow passes over rows."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"

_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a temporary one, but only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_root:
        held = tempfile.TemporaryDirectory(prefix="symloom-", ignore_cleanup_errors=True)
        atexit.register(held.cleanup)
        _own_root.append(f"file://{held.name}")
    return _own_root[0]


class Stages:
    """Tables written by one run. A lost executor costs a re-read, never the whole lineage. They go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/symloom-{name}-{uuid.uuid4().hex}"
        self.made = 0

    def keep(self, df: DataFrame, label: str, files: int | None = None) -> DataFrame:
        path = f"{self.base}/{self.made:03d}-{label}"
        self.made += 1
        (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
        if self.made == 1:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes staged tables that no later step reads."""
        for table in tables:
            for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                if folder.startswith(("file:", "hdfs:", "viewfs:")) or "://" in folder:
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, schema: str, work) -> DataFrame:
    """``work(batch as dict of Arrow arrays) -> dict of arrays``, over record batches."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def over(batches):
        for batch in batches:
            if batch.num_rows:
                out = work({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(over, kind)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value, empty for null."""
    return [b"" if x is None else x for x in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def unit_key(*parts: Column) -> Column:
    """A reproducible uniform number in (0, 1) from md5; the same arithmetic holds in other SQL engines."""
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / 2**52
