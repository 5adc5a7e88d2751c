"""Metrics of confusion counts, and the change of polarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host reads count as positive, or kept microbe reads do. Counts of one kind never mix with the other.
HOST, KEPT = "host_positive", "kept_positive"


def share(a: Column, b: Column) -> Column:
    """a / b, 0 if b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metrics(tp: str = "tp", fp: str = "fp", tn: str = "tn", fn: str = "fn", empty_f1_is_one: bool = False) -> dict[str, Column]:
    """accuracy, precision, recall and f1. ``empty_f1_is_one``: f1 is 1 where nothing is positive, neither in
    truth nor in what was called."""
    p, n, q, m = (F.col(c) for c in (tp, fp, tn, fn))
    f1 = share(2 * p, 2 * p + n + m)
    if empty_f1_is_one:
        f1 = F.when((p + n == 0) & (p + m == 0), F.lit(1.0)).otherwise(f1)
    return {"accuracy": share(p + q, p + n + q + m), "precision": share(p, p + n), "recall": share(p, p + m), "f1": f1}


def rates(tp: str = "tp", fp: str = "fp", tn: str = "tn", fn: str = "fn", of_total: bool = False) -> dict[str, Column]:
    """Host reads left and microbe reads lost, with host as positive: of their class, or of all reads."""
    p, n, q, m = (F.col(c) for c in (tp, fp, tn, fn))
    total = p + n + q + m
    return {"host_remaining_rate": share(m, total if of_total else p + m), "microbe_loss_rate": share(n, total if of_total else q + n)}


def swapped(df: DataFrame) -> DataFrame:
    """Counts of the other polarity: positives become negatives. ``polarity`` follows."""
    out = df.select(*[c for c in df.columns if c not in ("tp", "fp", "tn", "fn")], F.col("tn").alias("tp"), F.col("fn").alias("fp"), F.col("tp").alias("tn"), F.col("fp").alias("fn"))
    if "polarity" in df.columns:
        out = out.withColumn("polarity", F.when(F.col("polarity") == HOST, KEPT).otherwise(HOST))
    return out


def with_polarity(df: DataFrame, wanted: str) -> DataFrame:
    """A table of mixed polarity in one: rows of the other are swapped, and metrics counted anew."""
    cols = [c for c in df.columns if c not in ("accuracy", "precision", "recall", "f1")]
    out = df.select(*cols).filter(F.col("polarity") == wanted).unionByName(swapped(df.select(*cols).filter(F.col("polarity") != wanted)))
    return out.withColumns(metrics(empty_f1_is_one=wanted == KEPT))
