"""Column expressions for units, durations, names, logs and labels. No Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that stand for a missing number.
MISSING = ("", "unknown", "failed", "na", "n/a", "nan", "none")


def number(c: Column) -> Column:
    """A string as DOUBLE; anything that isn't a number is NULL, and so is NaN."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def seconds(c: Column, missing_as_zero: bool = False) -> Column:
    """``h:mm:ss``, ``m:ss.ss`` or a plain number as seconds; missing or malformed is NULL (or 0)."""
    s = F.lower(F.trim(c.cast("string")))
    p = F.split(s, ":")
    at = lambda k: number(F.get(p, F.lit(k)))
    x = F.when(s.isin(*MISSING), None).when(F.size(p) == 3, at(0) * 3600 + at(1) * 60 + at(2)).when(F.size(p) == 2, at(0) * 60 + at(1)).when(F.size(p) == 1, at(0))
    return F.coalesce(x, F.lit(0.0)) if missing_as_zero else x


def whole_seconds(c: Column) -> Column:
    """Seconds without their fraction."""
    return seconds(c).cast("bigint")


def text2(x: Column) -> Column:
    """Two decimals as text; NULL stays."""
    return F.when(x.isNotNull(), F.format_string("%.2f", x))


def mb(kb: Column) -> Column:
    return kb / F.lit(1024.0)


def gb(kb: Column, decimal_units: bool = False) -> Column:
    """kB as GB of 1024**2 kB, or of a million for files made that way."""
    return kb / F.lit(1e6 if decimal_units else 1024.0 * 1024.0)


def minutes(s: Column) -> Column:
    return s / F.lit(60.0)


def group(c: Column, pattern: str, k: int = 1) -> Column:
    """A group of a pattern; NULL where it doesn't match."""
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def parse_dataset(c: Column) -> dict[str, Column]:
    """The parts of names like ``100M_90pct_high_lognormal_SE``; all NULL for others."""
    p = r"^(\d+)M_(\d+)pct_(\w+)_(\w+)_(SE|PE)$"
    return {"reads_m": group(c, p).cast("int"), "host_pct": group(c, p, 2).cast("int"), "complexity": group(c, p, 3), "abundance": group(c, p, 4), "mode": group(c, p, 5)}


def host_percent(c: Column) -> Column:
    """The first ``Npct`` as an integer percent."""
    return group(c, r"(\d+)pct").try_cast("int")


def host_fraction(c: Column, default: float | None = None) -> Column:
    """``_Npct_`` as a fraction, or the default."""
    x = group(c, r"_(\d+)pct_").try_cast("double") / F.lit(100.0)
    return x if default is None else F.coalesce(x, F.lit(default))


def reads(c: Column) -> Column:
    """Reads from a leading ``NM``; 0 without one."""
    return F.coalesce(group(c, r"^(\d+)M").try_cast("bigint") * F.lit(1_000_000).cast("bigint"), F.lit(0).cast("bigint"))


def species(c: Column, lower: bool = True) -> Column:
    x = F.split_part(c, F.lit("_"), F.lit(1))
    return F.lower(x) if lower else x


def dataset_and_rep(c: Column) -> tuple[Column, Column]:
    p = r"^(.+)_rep([0-9]+)$"
    return group(c, p), group(c, p, 2).try_cast("int")


def rep_of_path(c: Column) -> Column:
    return group(c, r"rep_(\d+)").try_cast("int")


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, r"\x1b\[[0-9;]*m", "")


def field_pattern(name: str) -> str:
    return rf'{name}\s*=\s*"([^"]+)"'


def field(c: Column, name: str) -> Column:
    """The value of ``name="value"`` in a log text; the text itself, trimmed, if it holds no ``=``; else ``unknown``. Only
    quoted values count, and they may hold blanks."""
    s, p = strip_ansi(c), field_pattern(name)
    return F.when(s.rlike(p), F.regexp_extract(s, p, 1)).when(~s.contains("=") & (F.trim(s) != ""), F.trim(s)).otherwise("unknown")


def recode(c: Column, values: dict[str, str], default: Column | None = None) -> Column:
    """Values by a lookup; others stay, or take the default."""
    out = F
    for k, v in values.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(c if default is None else default)


def ordinal(c: Column, order: list[str]) -> Column:
    """The place of a value in a fixed order from 0; NULL for others."""
    out = F
    for k, v in enumerate(order):
        out = out.when(c == v, F.lit(k))
    return out


def format_seconds(x: Column) -> Column:
    """``N/A``, ``s.ss`` with one decimal, ``m:ss.ss`` or ``h:mm:ss.ss``."""
    h, m = F.floor(x / 3600), F.floor(F.pmod(x, F.lit(3600.0)) / 60)
    s = F.pmod(x, F.lit(60.0))
    return F.when(x.isNull(), "N/A").when(x < 60, F.format_string("%.1fs", x)).when(x < 3600, F.format_string("%d:%05.2f", m, s)).otherwise(F.format_string("%d:%02d:%05.2f", h, m, s))


def format_time(x: Column) -> Column:
    """Seconds, minutes or hours with one decimal."""
    return F.when(x.isNull(), "N/A").when(x < 60, F.format_string("%.1fs", x)).when(x < 3600, F.format_string("%.1fm", x / 60)).otherwise(F.format_string("%.1fh", x / 3600))


def format_memory(x_mb: Column) -> Column:
    return F.when(x_mb.isNull(), "N/A").when(x_mb >= 1024, F.format_string("%.1f GB", x_mb / 1024)).otherwise(F.format_string("%.0f MB", F.bround(x_mb)))


def format_number(x: Column, fmt: str = "%.4f") -> Column:
    return F.when(x.isNull(), "N/A").otherwise(F.format_string(fmt, x))


def six(x: Column) -> Column:
    """A metric as text with six decimals; NULL stays."""
    return F.when(x.isNotNull(), F.format_string("%.6f", x))


def bucket(x: Column, bounds: tuple[float, float] = (5.0, 10.0)) -> Column:
    return F.when(x >= bounds[1], "high").when(x >= bounds[0], "medium").when(x.isNotNull(), "low")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


def faster(ratio: Column) -> Column:
    return F.when(ratio > 1, "faster").when(ratio.isNotNull(), "slower")


def comparable(a: Column, b: Column, within: float = 0.01) -> Column:
    return F.when(F.abs(a - b) < within, "comparable").when(a.isNotNull() & b.isNotNull(), "different")


def truth(c: Column) -> Column:
    """A boolean that may have come as text, in any case of letters and with blanks around it; NULL for what is neither true nor
    false. (Text that says false isn't true.)"""
    return F.trim(c.cast("string")).try_cast("boolean")


def verdict(a: Column, b: Column, names: tuple[str, str], within: float = 0.01) -> dict[str, Column]:
    """The gap of two scores, and which of two tools is better; NULL unless both are above 0."""
    both = (a > 0) & (b > 0)
    gap = F.when(both, F.abs(a - b))
    return {"gap": gap, "verdict": F.when(gap < within, "comparable").when(both & (a > b), names[0]).when(both, names[1])}


def per_second(n: Column, s: Column) -> Column:
    """Reads (or samples) a second; NULL if no time passed."""
    return F.try_divide(n.cast("double"), s)


def per_hour(n: Column, s: Column) -> Column:
    return F.try_divide(n.cast("double"), s / F.lit(3600.0))


def million_per_minute(n: Column, s: Column) -> Column:
    return F.try_divide(n / F.lit(1e6), s / F.lit(60.0))


def percent(x: Column) -> Column:
    return x * F.lit(100.0)


def clipped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL if b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def contains(c: Column, part: str) -> Column:
    """False for NULL too."""
    return F.coalesce(c.contains(part), F.lit(False))


def contains_any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | contains(c, p)
    return out


def split_counts(total: Column, host: Column, exact: bool = True) -> tuple[Column, Column]:
    """Host and microbe reads. The truncating form loses a read where the fraction isn't exact in binary."""
    h = F.floor(total * host + (F.lit(1e-6) if exact else F.lit(0.0))).cast("bigint")
    return h, (total.cast("bigint") - h) if exact else F.floor(total * (F.lit(1.0) - host)).cast("bigint")


def coverage(total: Column, share: Column, bases: Column, genome: Column) -> Column:
    """Mean depth; NULL below 1e-6, which a generator skips."""
    x = F.try_divide(total * share * bases, genome)
    return F.when(x >= 1e-6, x)


def species_count(complexity: Column) -> Column:
    return F.when(complexity == "low", 5).when(complexity == "medium", 30).when(complexity == "high", 100).otherwise(30)


def task(c: Column, reps: int = 3) -> tuple[Column, Column]:
    """Dataset index and rep (from 1) of a task id."""
    return F.floor(c / F.lit(reps)).cast("bigint"), (F.pmod(c, F.lit(reps)) + 1).cast("bigint")


def lower_columns(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Column names stripped and in lower case, then renamed by aliases unless the new name is taken."""
    out = df.toDF(*[c.strip().lower() for c in df.columns])
    for a, b in (aliases or {}).items():
        if a in out.columns and b not in out.columns:
            out = out.withColumnRenamed(a, b)
    return out


def metric(df: DataFrame, name: str, stat: str = "mean") -> Column:
    """The column of a metric and statistic of a table with flat names; NULL if the table lacks it."""
    flat = f"{name}_{stat}"
    return F.col(flat) if flat in df.columns else F.lit(None).cast("double")


def two_way(df: DataFrame, a: str, b: str) -> DataFrame:
    """Each of two columns filled from the other; one that is missing is made."""
    have = [c for c in (a, b) if c in df.columns]
    if not have:
        return df
    x = F.coalesce(*[F.col(c) for c in have])
    y = F.coalesce(*[F.col(c) for c in have[::-1]])
    return df.withColumns({a: x, b: y})
