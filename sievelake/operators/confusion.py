"""Kept reads against the truth: confusion counts by joins and one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import HOST, KEPT, metrics, rates


def last_label(labels: DataFrame, keys: list[str], label: str = "label", order: str = "line_no") -> DataFrame:
    """One label a key: that of its last line."""
    return labels.groupBy(*keys).agg(F.max_by(label, order).alias(label))


def label_sets(labels: DataFrame, keys: list[str], is_host: str = "is_host") -> DataFrame:
    """Distinct (key, class): a key of both classes counts in both."""
    return labels.select(*keys, is_host).distinct()


def confusion(truth: DataFrame, kept: DataFrame, on: list[str], by: list[str], polarity: str = HOST, removed: bool = False, is_host: str = "is_host") -> DataFrame:
    """tp, fp, tn, fn for each group ``by`` (columns of ``truth``, or of both where they are in ``on``).

    ``truth`` has one row a key ``on`` and the boolean ``is_host``; ``kept`` has the keys that a tool kept, or with
    ``removed`` those that it took away. Keys that the truth lacks are ignored, repeated ones count once. The
    join is on the keys by shuffle: both sides grow with the reads, so neither is broadcast."""
    hit = kept.select(*on).distinct().withColumn("__hit", F.lit(True))
    both = truth.join(hit, on, "left").withColumn("__kept", F.coalesce("__hit", F.lit(False)) != F.lit(removed))
    host, left = F.col(is_host), F.col("__kept")
    counts = {"tp": host & ~left, "fn": host & left, "tn": ~host & left, "fp": ~host & ~left}
    if polarity == KEPT:
        counts = {"tp": ~host & left, "fp": host & left, "fn": ~host & ~left, "tn": host & ~left}
    return both.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in counts.items()])


def scored(truth: DataFrame, kept: DataFrame, on: list[str], by: list[str], polarity: str = HOST, removed: bool = False) -> DataFrame:
    """:func:`confusion` with metrics, and with host as positive the two error rates and the total."""
    out = confusion(truth, kept, on, by, polarity, removed)
    cols = metrics(empty_f1_is_one=polarity == KEPT)
    if polarity == HOST:
        cols |= rates() | {"total_reads": F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")}
    return out.withColumns(cols)


def scored_runs(truth: DataFrame, kept: DataFrame, on: list[str], by: list[str], run: str, runs: list[str], polarity: str = HOST) -> DataFrame:
    """:func:`scored` for several runs at once, with a column ``run``: ``kept`` says in it which run kept a key. What all runs kept
    meets the truth in one join, and one aggregation counts for each of ``runs``, so the truth is read once; where it is
    bucketed by ``on`` (see :func:`layout.bucketed`) it isn't shuffled. A run that kept nothing is scored too."""
    hits = kept.filter(F.col(run).isin(runs)).groupBy(*on).agg(F.collect_set(run).alias("__runs"))
    both, host = truth.join(hits, on, "left"), F.col("is_host")
    hit = lambda r: F.coalesce(F.array_contains("__runs", r), F.lit(False))
    each = F.array(*[F.struct(F.lit(r).alias(run), F.count_if(host & hit(r)).alias("hk"), F.count_if(~host & hit(r)).alias("mk")) for r in runs])
    counts = both.groupBy(*by).agg(F.count_if(host).alias("__host"), F.count_if(~host).alias("__other"), each.alias("__each"))
    c = counts.select(*by, "__host", "__other", F.inline("__each"))
    named = {"tp": F.col("__host") - F.col("hk"), "fp": F.col("__other") - F.col("mk"), "tn": F.col("mk"), "fn": F.col("hk")}
    if polarity == KEPT:
        named = {"tp": named["tn"], "fp": named["fn"], "tn": named["tp"], "fn": named["fp"]}
    out = c.select(run, *by, *[v.alias(k) for k, v in named.items()]).withColumns(metrics(empty_f1_is_one=polarity == KEPT))
    return out.withColumns(rates() | {"total_reads": F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")}) if polarity == HOST else out


def inverted(truth: DataFrame, kept: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Kept reads scored as if they had been removed, for comparison with results made that way; rates are of
    all reads."""
    out = confusion(truth, kept, on, by, HOST, removed=True)
    return out.withColumns(metrics() | rates(of_total=True))


def unpaired_runs(runs: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """Runs of datasets without truth: they are not scored."""
    return runs.join(truth.select(*on).distinct(), on, "left_anti")


def pairs_kept(mates: DataFrame, pair: list[str], aligned: str = "aligned") -> DataFrame:
    """Pairs of which neither mate aligned."""
    return mates.groupBy(*pair).agg(F.bool_or(F.coalesce(aligned, F.lit(False))).alias("__any")).filter("NOT __any").drop("__any")
