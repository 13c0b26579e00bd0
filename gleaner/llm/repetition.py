"""Problem 6: repetition inside one document, with host-level rules.

Measure: the share of a field's words (of its characters in Chinese) that stand in a run of GRAM words (twice as many
characters) which occurred earlier in the same field. Letter case, spacing, punctuation and list numbers don't count, and
runs shorter than GRAM are recurring turns, not repetition.

Rule and hosts: a field fails at CUT. Failures are aggregated per origin and field name, the rates are shrunk with a beta
prior fitted to all hosts by moments, and the host verdicts are joined back to the fields. The share decides; only within
HOST_SHIFT of the cut, where the count of words is a matter of tokenisation, the host's shrunk rate against the rate of
all hosts moves the cut. A host of null origin is a host of its own.

Null, empty and blank fields have no words and a share of 0.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.tables import cut, flat_samples, stack_fields

GRAM, CUT, HOST_SHIFT = 6, 0.35, 0.01
FIELDS = ("output", "reasoning")
#: Chinese characters stand alone; other letters and digits form words.
_WORD = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
_LIST_NUMBER = re.compile(r"(?m)^[ \t]*(?:\d+[.)、]|[-*•])[ \t]+")
_BATCH_WORDS = 1_000_000


def _block_shares(words: list[list[str]], gram: int) -> np.ndarray:
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    if not sizes.sum():
        return np.zeros(len(words))
    flat = pd.Series([w for ws in words for w in ws], dtype=object)
    codes = pd.factorize(flat)[0].astype(np.uint64) + np.uint64(1)
    chinese = flat.str.match("[㐀-鿿]").to_numpy(bool)
    doc = np.repeat(np.arange(len(words)), sizes)
    half = np.bincount(doc, weights=chinese, minlength=len(words)) * 2 > sizes
    n, marks = len(codes), np.zeros(len(codes) + 1, dtype=np.int64)
    for length, which in ((gram, ~half), (2 * gram, half)):
        starts = np.arange(n - length + 1) if n >= length else np.empty(0, np.int64)
        starts = starts[which[doc[starts]] & (doc[starts] == doc[starts + length - 1])]
        if not len(starts):
            continue
        h = doc[starts].astype(np.uint64) + np.uint64(1)
        for k in range(length):
            h = (h ^ codes[starts + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        first = np.zeros(len(h), dtype=bool)
        first[np.unique(h, return_index=True)[1]] = True
        again = starts[~first]
        np.add.at(marks, again, 1)
        np.add.at(marks, again + length, -1)
    repeated = np.cumsum(marks[:-1]) > 0
    return np.bincount(doc, weights=repeated, minlength=len(words)) / np.maximum(sizes, 1)


def repeated_shares(texts: list[str | None], gram: int = GRAM) -> np.ndarray:
    """The repeated share of every text."""
    out, block, size = [], [], 0
    for t in texts:
        words = _WORD.findall(_LIST_NUMBER.sub("", t).lower()) if t else []
        block.append(words)
        size += len(words)
        if size >= _BATCH_WORDS:
            out.append(_block_shares(block, gram))
            block, size = [], 0
    if block:
        out.append(_block_shares(block, gram))
    return np.concatenate(out) if out else np.zeros(0)


def measured(samples: DataFrame) -> DataFrame:
    """(id, origin, field_name, share), once per id and field. An id with several origins counts for the smallest."""

    @F.pandas_udf("double")
    def share(texts: pd.Series) -> pd.Series:
        return pd.Series(repeated_shares(texts.tolist()))

    cells = stack_fields(samples, FIELDS, ("id", "origin")).select("id", "origin", "field_name", share("text").alias("share"))
    return cells.groupBy("id", "field_name").agg(F.min("origin").alias("origin"), F.max("share").alias("share"))


def host_verdicts(shares: DataFrame) -> DataFrame:
    """(origin, field_name, fields, failures, rate, overall): rate is shrunk by an empirical beta prior. Rows are counted
    per host before they are shuffled, so a host with a third of all rows is one small partial count per task."""
    hosts = shares.groupBy("origin", "field_name").agg(F.count("*").alias("fields"), F.sum((F.col("share") >= CUT).cast("long")).alias("failures"))
    raw = F.col("failures") / F.col("fields")
    prior = hosts.groupBy("field_name").agg(
        (F.sum("failures") / F.sum("fields")).alias("overall"),
        (F.sum(F.col("fields") * raw * raw) / F.sum("fields")).alias("square"),
        F.avg("fields").alias("size"),
    )
    spread = F.col("square") - F.col("overall") * F.col("overall") - F.col("overall") * (1 - F.col("overall")) / F.col("size")
    strength = F.col("overall") * (1 - F.col("overall")) / F.greatest(spread, F.lit(1e-6)) - 1
    prior = prior.withColumn("strength", F.greatest(F.lit(1.0), F.least(F.lit(1e6), strength))).select("field_name", "overall", "strength")
    rate = (F.col("failures") + F.col("overall") * F.col("strength")) / (F.col("fields") + F.col("strength"))
    return hosts.join(prior, "field_name").withColumn("rate", rate).select("origin", "field_name", "fields", "failures", "rate", "overall")


def judged(samples: DataFrame) -> DataFrame:
    """(id, origin, field_name, share, rate, failed)."""
    shares = cut(measured(samples))
    verdicts = host_verdicts(shares)
    odds = F.log((F.col("rate") + 1e-6) / (1 - F.col("rate") + 1e-6)) - F.log((F.col("overall") + 1e-6) / (1 - F.col("overall") + 1e-6))
    shift = F.lit(HOST_SHIFT) * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), odds))
    # Only fields near the cut need their host; the others are decided by their share.
    near = F.abs(F.col("share") - CUT) <= HOST_SHIFT
    clear = shares.filter(~near).withColumn("failed", F.col("share") >= CUT)
    on = F.col("s.origin").eqNullSafe(F.col("v.origin")) & (F.col("s.field_name") == F.col("v.field_name"))
    close = shares.filter(near).alias("s").join(verdicts.alias("v"), on, "left").select("s.*", (F.col("share") >= CUT - F.coalesce(shift, F.lit(0.0))).alias("failed"))
    return clear.unionByName(close)


def found(spark: SparkSession, root: str) -> DataFrame:
    """p6_found: fields at least 35 % of which repeat earlier wording of the same field."""
    return judged(flat_samples(spark, root, "id", "origin", *FIELDS)).filter("failed").select("id", "field_name")


def shares(spark: SparkSession, root: str) -> DataFrame:
    """p6_shares: the repeated share of every field that isn't null."""
    return measured(flat_samples(spark, root, "id", "origin", *FIELDS)).select("id", "field_name", F.round("share", 6).alias("share"))


def hosts(spark: SparkSession, root: str) -> DataFrame:
    """p6_hosts: fields, failures and shrunk failure rate per origin and field."""
    return host_verdicts(cut(measured(flat_samples(spark, root, "id", "origin", *FIELDS))))


QUERIES = {"p6_found": found, "p6_shares": shares, "p6_hosts": hosts}
ORACLE_SQL: dict[str, str] = {}
