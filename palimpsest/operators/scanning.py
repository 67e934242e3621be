"""Pattern and entropy scan of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ENTROPY_THRESHOLD, RUN, TOKEN_PATTERNS, entropy


def entropy_runs(contents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, run, entropy, high): maximal runs of the base64 alphabet of at least twenty characters."""
    runs = contents.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"({RUN})"), 1)).alias("run"))
    return runs.withColumn("entropy", F.round(entropy(F.col("run")), 6)).withColumn("high", F.col("entropy") > ENTROPY_THRESHOLD)


def pattern_hits(contents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, length, n): matches of each token pattern."""
    each = F.array(*[F.struct(F.lit(n).alias("kind"), F.regexp_extract_all(F.col(text), F.lit(f"({p})"), 1).alias("hits")) for n, p in TOKEN_PATTERNS.items()])
    hits = contents.select(key, F.inline(F.filter(each, lambda x: F.size(x.hits) > 0)))
    return hits.select(key, "kind", F.explode("hits").alias("hit")).groupBy(key, "kind", F.length("hit").cast("long").alias("length")).agg(F.count("*").alias("n"))


def scan(contents: DataFrame, key: str, text: str, skip_entropy: Column | None = None) -> DataFrame:
    """(key, kind): patterns always, entropy unless the content is exempt."""
    exempt = F.lit(False) if skip_entropy is None else skip_entropy
    high = entropy_runs(contents.where(~exempt), key, text).where("high").select(key, F.lit("high_entropy").alias("kind"))
    return pattern_hits(contents, key, text).select(key, "kind").unionByName(high).distinct()


def unlisted(hits: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Hits on contents that the allowlist does not name."""
    return hits.join(allowed.select(key), key, "left_anti")
