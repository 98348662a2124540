"""The index store: immutable Parquet snapshots, found through a manifest that is written last."""

from __future__ import annotations

import hashlib
import json
import tempfile
import time
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom import schemas
from symloom.functions import text as T

ENGINE_VERSION = "1"
_fallback: list[tempfile.TemporaryDirectory] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a temporary one, but only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append(tempfile.TemporaryDirectory(prefix="symloom-store-", ignore_cleanup_errors=True))
    return f"file://{_fallback[0].name}"


def _located(spark: SparkSession, path: str):
    """(path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _located(spark, path)
    return fs.exists(p)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Intermediate tables go when the driver ends."""
    p, fs = _located(spark, path)
    fs.deleteOnExit(p)


def variant_key(features: list[str] | None = None, all_features: bool = False, no_default: bool = False, private: bool = False) -> str:
    """Names a build: its feature flags as a hash, and whether private symbols are in."""
    flags = "|".join([",".join(sorted(features or [])), str(all_features).lower(), str(no_default).lower()])
    feat = f"-feat_{T.djb2(flags):016x}" if features or all_features or no_default else ""
    return feat + ("-priv" if private else "")


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Hash of names, sizes and times of the input files and all files below input folders, listed by Spark's own file systems."""
    seen = []
    for path in paths:
        p, fs = _located(spark, path)
        if fs.exists(p):
            files = fs.listFiles(p, True)
            while files.hasNext():
                s = files.next()
                seen.append(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """A written copy of an intermediate table: plans that use it several times read it instead of repeating it."""
    path = f"{shared_root(df.sparkSession)}/symloom-steps/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_MANIFEST = "name string, key string, inputs string, engine string, format int, made long, folder string, tables string"


class Store:
    """Tables by (name, key). A snapshot without a manifest row does not exist, an unreadable one is a miss, and so
    is one of other inputs, where a reader states a fingerprint of its own."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or f"{shared_root(spark)}/symloom-store")

    @staticmethod
    def valid() -> Column:
        return (F.col("engine") == ENGINE_VERSION) & (F.col("format") == schemas.FORMAT_VERSION)

    def save(self, name: str, key: str, tables: dict[str, DataFrame], inputs: str = "") -> dict[str, DataFrame]:
        folder = f"{self.root}/{uuid.uuid4().hex}"
        for table, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{folder}/{table}")
        row = [(name, key, inputs, ENGINE_VERSION, schemas.FORMAT_VERSION, time.time_ns(), folder, json.dumps(sorted(tables)))]
        self.spark.createDataFrame(row, _MANIFEST).coalesce(1).write.mode("append").json(f"{self.root}/manifest")
        return {t: self.spark.read.parquet(f"{folder}/{t}") for t in tables}

    def load(self, name: str, key: str, inputs: str | None = None) -> dict[str, DataFrame] | None:
        if not exists(self.spark, f"{self.root}/manifest"):
            return None
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest").filter(self.valid() & (F.col("name") == name) & (F.col("key") == key))
        row = rows.filter(F.lit(inputs).isNull() | (F.col("inputs") == F.lit(inputs))).orderBy(F.desc("made"), "folder").first()
        if row is None:
            return None
        try:
            return {t: self.spark.read.parquet(f"{row['folder']}/{t}") for t in json.loads(row["tables"])}
        except PySparkException:  # a table is gone or its files cannot be read
            return None

    def get(self, name: str, key: str, build, inputs: str = "") -> dict[str, DataFrame]:
        return self.load(name, key, inputs) or self.save(name, key, build(), inputs)

    def clear(self) -> None:
        path, fs = _located(self.spark, self.root)
        fs.delete(path, True)


def known_failures(wanted: DataFrame, failures: DataFrame) -> DataFrame:
    """Builds (package, version) that did not fail before (name_version strings)."""
    spec = F.concat_ws("@", "package", "version")
    return wanted.withColumn("spec", spec).join(failures.select(F.col("name_version").alias("spec")), "spec", "left_anti").drop("spec")


def newest(files: DataFrame) -> DataFrame:
    """package, mtime: seconds of the newest source file (package, modificationTime)."""
    return files.groupBy("package").agg(F.max(F.unix_timestamp("modificationTime")).alias("mtime"))
