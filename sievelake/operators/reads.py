"""Read quality control and classification; numpy looks at all reads of a batch at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import host_index, trimming


def scores(qual: Column) -> Column:
    """Phred scores of a quality string (offset 33)."""
    return F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)


def _kept(found: Column, seq: str, qual: str) -> dict[str, Column]:
    cut = lambda c: F.substring(F.col(c), found["start"] + 1, found["end"] - found["start"])
    return {seq: cut(seq), qual: cut(qual)}


def judged(reads: DataFrame, seq: str = "seq", qual: str = "qual", window: int = 4, least_mean: int = 20, least_length: int = 50, adapter: str | None = None) -> DataFrame:
    """Reads cut before their first ``adapter`` (see :func:`trimming.adapters`: part of it at the end counts too), then at
    both ends to the first and last window whose mean score is at least ``least_mean``, with ``adapter_cut``, ``status``
    (low_quality without such a window, too_short below ``least_length``, else passed) and of what stays the bases ``q20``,
    ``q30`` and ``gc``. A read of low quality is left empty, but one that is shorter than a window, once its adapter is off,
    stays as it is. A read without bases or scores, or null, is of low quality. Time is linear in bases."""
    found = F.arrow_udf(trimming.single(adapter, window, least_mean, True), trimming.DDL)(F.col(seq), F.col(qual))
    out = reads.withColumn("__f", found).withColumns(_kept(F.col("__f"), seq, qual))
    status = F.when(F.col("__f.low"), "low_quality").when(F.length(seq) < least_length, "too_short").otherwise("passed")
    return out.withColumns({"adapter_cut": F.col("__f.adapter"), "status": status, **{k: F.col(f"__f.{k}") for k in ("q20", "q30", "gc")}}).drop("__f")


def judged_pairs(pairs: DataFrame, seq: tuple[str, str] = ("seq1", "seq2"), qual: tuple[str, str] = ("qual1", "qual2"), window: int = 4, least_mean: int = 20, least_length: int = 50, adapters: tuple[str | None, str | None] = (None, None), least_overlap: int = 30, most_mismatches: int = 5, percent: int = 20) -> DataFrame:
    """Pairs cut as :func:`judged` cuts reads, and before that at the end of their insert where the mates show it: where the
    one's beginning is the reverse complement of the other's, all behind it is adapter, whatever its letters (see
    :func:`trimming.inserts`). Adds ``insert`` (NULL without one), ``adapter_cut`` (of either), ``status`` of the pair: the
    worse one's."""
    run = F.arrow_udf(trimming.mates(*adapters, window, least_mean, least_overlap, most_mismatches, percent, True), f"struct<insert:int,one:{trimming.DDL},two:{trimming.DDL}>")
    out = pairs.withColumn("__f", run(F.col(seq[0]), F.col(qual[0]), F.col(seq[1]), F.col(qual[1])))
    out = out.withColumns(_kept(F.col("__f.one"), seq[0], qual[0]) | _kept(F.col("__f.two"), seq[1], qual[1]))
    status = F.when(F.col("__f.one.low") | F.col("__f.two.low"), "low_quality").when(F.least(F.length(seq[0]), F.length(seq[1])) < least_length, "too_short").otherwise("passed")
    return out.withColumns({"insert": F.when(F.col("__f.insert") >= 0, F.col("__f.insert")), "adapter_cut": F.col("__f.one.adapter") | F.col("__f.two.adapter"), "status": status}).drop("__f")


def trimmed(reads: DataFrame, seq: str = "seq", qual: str = "qual", **options) -> DataFrame:
    """The reads that pass, cut; see :func:`judged`."""
    return judged(reads, seq, qual, **options).filter("status = 'passed'").drop("adapter_cut", "status", "q20", "q30", "gc")


def quality_record(reads: DataFrame, by: list[str], seq: str = "seq", qual: str = "qual", **options) -> DataFrame:
    """What a quality control reports of each group: reads in and out, cut at adapters, too short and of low quality, and of
    what comes out bases and the shares of q20, q30 and gc. One pass and one aggregation."""
    out = judged(reads, seq, qual, **options)
    passed = F.col("status") == "passed"
    n = lambda s: F.count_if(F.col("status") == s)
    bases = F.coalesce(F.sum(F.when(passed, F.length(seq))), F.lit(0))
    share = lambda c: F.coalesce(F.try_divide(F.sum(F.when(passed, F.col(c))).cast("double"), bases), F.lit(0.0)).alias(c)
    return out.groupBy(*by).agg(
        F.count(F.lit(1)).alias("reads_in"), n("passed").alias("reads_out"), F.count_if("adapter_cut").alias("adapter"), n("too_short").alias("too_short"), n("low_quality").alias("low_quality"),
        bases.alias("bases"), share("q20"), share("q30"), share("gc"),
    )


def summary(reads: DataFrame, by: list[str], seq: str = "seq", qual: str = "qual") -> DataFrame:
    """reads, bases, q20, q30 and gc (shares of bases) of each group."""
    q = scores(F.col(qual))
    at_least = lambda k: F.sum(F.size(F.filter(q, lambda x: x >= k)))
    bases = F.sum(F.length(seq))
    share = lambda x: F.coalesce(F.try_divide(x.cast("double"), bases), F.lit(0.0))
    gc = F.sum(F.length(seq) - F.length(F.regexp_replace(F.upper(F.col(seq)), "[GC]", "")))
    return reads.groupBy(*by).agg(F.count(F.lit(1)).alias("reads"), bases.alias("bases"), share(at_least(20)).alias("q20"), share(at_least(30)).alias("q30"), share(gc).alias("gc"))


def minimizers(seq: str, k: int = 35, length: int = 31) -> np.ndarray:
    """The different minimizers of a sequence, as numbers of two bits a letter; see :func:`host_index.groups`."""
    data = np.frombuffer(seq.encode("ascii", "replace"), np.uint8)
    return np.unique(host_index.groups(data, np.array([0, len(data)]), k, length)[1])


def classified(reads: DataFrame, host: DataFrame, id_col: str, seq: str = "seq", k: int = 35, length: int = 31, least_groups: int = 2, confidence: float = 0.0) -> DataFrame:
    """Reads that belong to the host, by an index of its sequences made for this alone; see :func:`host_index.classified`."""
    return host_index.classified(reads, host_index.build(host, seq, k=k, length=length), id_col, seq, least_groups, confidence)
