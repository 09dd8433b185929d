"""Mixing sources to target shares of the total size, by Poisson replication."""

from __future__ import annotations

import math
import pathlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmere.sources.tables import materialize, ship_package

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the vocabulary file, where the folder doesn't name one.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def source_key(col):
    """A source without regard to case, blanks and hyphens."""
    return F.regexp_replace(F.lower(F.regexp_replace(col, r"^[\s ]+|[\s ]+$", "")), r"[\s _-]+", "_")


_ENCODERS: dict = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, pathlib.Path(path).read_bytes().splitlines())}
        _ENCODERS[path] = tiktoken.Encoding("sizes", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, text, tokens`` of documents with a text and a source; ``tokens`` are those of the whole text
    in a public byte-level vocabulary, whose file each executor reads."""
    ship_package(documents.sparkSession)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(t) for t in _encoder(tokenizer).encode_ordinary_batch(list(texts), num_threads=1)], dtype="int64")

    rows = documents.filter("doc_id is not null and text is not null and source is not null").select("doc_id", source_key(F.col("source")).alias("source"), "text")
    return rows.withColumn("tokens", count("text"))


def shares_below(rate: float, cap: int) -> list[float]:
    """For k from 0 to *cap* - 1, how likely a Poisson count of mean *rate* is at most k; by logarithms, so that a large rate doesn't underflow."""
    below, out = 0.0, []
    for k in range(cap):
        below += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if 0 < rate < math.inf else float(rate == 0)
        out.append(min(1.0, below))
    return out


def capped_mean(rate: float, cap: int) -> float:
    """The mean of a Poisson count of mean *rate*, cut at *cap*: the sum of how likely it is above each k."""
    return cap - sum(shares_below(rate, cap))


def poisson_rate(mean: float, cap: int) -> float:
    """The rate whose capped count has this mean; infinite if the cap allows no more."""
    if mean >= cap * (1 - 1e-9):
        return math.inf
    lo, hi = 0.0, 1.0
    while capped_mean(hi, cap) < mean:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, cap) < mean else (lo, mid)
    return hi


def plan_mix(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None, max_sources: int = 100_000) -> list[dict]:
    """For each target source: its tokens, the mean repetition it needs and the limits of the count's distribution.

    Without *total_tokens* the total is the largest at which every source that has tokens reaches its share within
    its cap; the shares of sources without any are left to the others in proportion. With one, sources that would
    need more than their cap give what they can. Sources differing in case, blanks or hyphens are one: their
    shares add up and the smallest cap holds. One row a target source comes to the driver, checked against
    *max_sources*.
    """
    want = targets.filter("source is not null and target_share > 0").groupBy(source_key(F.col("source")).alias("source")).agg(
        F.sum("target_share").alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    have = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    rows = [r.asDict() for r in want.join(have, "source", "left").limit(max_sources + 1).collect()]
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} target sources")
    live = [r for r in rows if (r["tokens"] or 0) > 0 and r["cap"] > 0]
    scale = sum(r["share"] for r in live) or 1.0
    if total_tokens is None:
        total_tokens = min((r["cap"] * r["tokens"] / (r["share"] / scale) for r in live), default=0)
    for r in rows:
        r["tokens"], r["limits"], r["mean"] = r["tokens"] or 0, [], 0.0
        if r in live:
            r["mean"] = min(float(r["cap"]), total_tokens * r["share"] / scale / r["tokens"])
            r["limits"] = shares_below(poisson_rate(r["mean"], r["cap"]), r["cap"])
    return sorted(rows, key=lambda r: r["source"])


def replicate(sizes: DataFrame, plan: list[dict], seed: int = 17) -> DataFrame:
    """*sizes* with ``copies``: how often each document is used, an inverted Poisson distribution at a number in
    [0, 1) that its id and the seed alone determine, so a lost task gives the same counts again."""
    spark = sizes.sparkSession
    limits = spark.createDataFrame([(r["source"], r["limits"]) for r in plan], "source string, limits array<double>")
    at = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    rows = sizes.join(F.broadcast(limits), "source").withColumn("_u", at)  # one row a target source, bounded by plan_mix
    return rows.withColumn("copies", F.size(F.filter("limits", lambda x: F.col("_u") >= x))).drop("limits", "_u")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = 17) -> DataFrame:
    """``doc_id, source, copy, tokens, text``: the mixture, in a random order over all of it.

    Null ids, texts and sources, and sources without a target, are left out; empty texts weigh nothing and are used as
    their source's other texts are. Rows that repeat a ``doc_id`` are repeated alike. Other columns are ignored.
    """
    sizes = materialize(token_sizes(documents, tokenizer), "sizes")
    used = replicate(sizes, plan_mix(sizes, targets, total_tokens), seed).filter("copies > 0")
    each = used.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return each.withColumn("_order", F.xxhash64(F.lit(seed + 1), "doc_id", "copy")).orderBy("_order", "doc_id", "copy").select("doc_id", "source", "copy", "tokens", "text")


def shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = TOKENIZER, seed: int = 17) -> DataFrame:
    """The report of :func:`mix`: for each target source its share as wanted and as reached, tokens, documents used
    and the most uses of one."""
    sizes = materialize(token_sizes(documents, tokenizer).drop("text"), "sizes")
    plan = plan_mix(sizes, targets, total_tokens)
    got = replicate(sizes, plan, seed).groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count_if(F.col("copies") > 0).alias("documents_used"), F.max("copies").alias("most_copies"))
    base = sizes.sparkSession.createDataFrame([(r["source"], float(r["share"]), int(r["cap"]), int(r["tokens"]), float(r["mean"])) for r in plan], "source string, target_share double, max_repeats int, tokens bigint, mean_copies double")
    rows = base.join(got, "source", "left").fillna(0, ["used_tokens", "documents_used", "most_copies"])
    total = sum(r["mean"] * r["tokens"] for r in plan)
    every = rows.agg(F.sum("used_tokens")).first()[0] or 0  # a sum over one row a source
    return rows.withColumns({"actual_share": F.col("used_tokens") / F.lit(float(every or 1)), "planned_tokens": F.lit(float(total))})
