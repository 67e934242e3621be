"""Session helpers: reading tables, cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cores: int = 8, partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("palimpsest")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; an own temporary one only where the setting is absent."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="palimpsest-ck-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it back; survives the loss of executors.

    Unlike a checkpointed plan the table has the size of its files, so that estimates do not multiply from round to round
    of an iteration. Tables of an iteration are removed when it is over (passing()), the rest when the application ends.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        _remove_at_end(spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _SCOPES:
        _SCOPES[-1].append((path, out))
    return out


def cut_with(df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict[str, int]]:
    """cut() and aggregates over its rows."""
    out = cut(df)
    return out, out.agg(*[c.alias(n) for n, c in aggregates.items()]).first().asDict()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, removed when the application ends."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _remove_at_end(spark, path)
    return path


_FOLDERS: set[str] = set()
_SCOPES: list[list[tuple[str, DataFrame]]] = []


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are cut inside are removed at the end, but for those given to `keep`; nothing outside may depend on the others."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _SCOPES.append([])
    try:
        yield keep
    finally:
        for path, df in _SCOPES.pop():
            if any(df is k for k in kept):
                if _SCOPES:
                    _SCOPES[-1].append((path, df))
            else:
                remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _remove_at_end(spark: SparkSession, folder: str) -> None:
    """Delete the folder when the context stops, or at exit where nobody stops it."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
