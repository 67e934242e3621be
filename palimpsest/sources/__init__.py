"""Readers: tables of a folder, change feeds, prompt folders, tool manifests."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..shared import SharedPath
from ..store import git_head, parse_backend, parse_store_spec, read_prompts
from ..streaming.capture import read_feed
from .manifests import fingerprint_all, parse_spec


def prompt_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, text, size) of all regular files below a folder of any Hadoop file system; names are relative to it. A missing folder is empty."""
    root = SharedPath(spark, folder)
    if not root.exists():
        return spark.createDataFrame([], "name string, text string, size long")
    base = root._fs.makeQualified(root._path).toString()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # the source spells local paths with three slashes and escapes names as in URIs
    name = F.url_decode(F.replace(F.substr(F.regexp_replace("path", "^file:/+", "file:/"), F.lit(len(base) + 2)), F.lit("+"), F.lit("%2B")))
    held = files.select(name.alias("name"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("size"))
    empty = [(n, "", 0) for n, p in root.files() if p.size() == 0]  # which the source passes over
    return held.unionByName(spark.createDataFrame(empty, held.schema)) if empty else held


__all__ = ["fingerprint_all", "git_head", "parse_backend", "parse_spec", "parse_store_spec", "prompt_files", "read_feed", "read_prompts", "table"]
