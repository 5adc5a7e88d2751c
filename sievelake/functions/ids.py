"""Read-id normalisation. Tools mark mates and runs differently, so the rule is always named."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULES = ("n1", "n2", "n3", "n4", "n5")


def token(c: Column) -> Column:
    """The first part before white space."""
    return F.regexp_extract(c, r"^\s*(\S*)", 1)


def norm_id(c: Column, rule: str = "n1", header: bool = True) -> Column:
    """The id of a header line (``header``: its first character is a mark, for n1, n3 and n5) or of a bare id.

    * n1: up to the first ``#``, then up to the last ``/``
    * n2: without a trailing ``#0/1``, ``#0/2``, ``/1`` and ``/2``, tried in this order
    * n3: up to the first ``/``, then up to the first ``#``
    * n4: without leading ``@`` and one trailing ``/1`` or ``/2``
    * n5: as it stands
    """
    t = token(c)
    bare = F.substring(t, 2, 1 << 30) if header else t
    match rule:
        case "n1":
            return F.regexp_replace(F.split_part(bare, F.lit("#"), F.lit(1)), "/[^/]*$", "")
        case "n2":
            out = t
            for end in ("#0/1", "#0/2", "/1", "/2"):
                out = F.regexp_replace(out, f"{end}$", "")
            return out
        case "n3":
            return F.split_part(F.split_part(bare, F.lit("/"), F.lit(1)), F.lit("#"), F.lit(1))
        case "n4":
            return F.regexp_replace(F.regexp_replace(t, "^@+", ""), "/[12]$", "")
        case "n5":
            return bare
    raise ValueError(f"rule is one of {RULES}, not {rule}")


def is_host(c: Column, rule: str = "exact") -> Column:
    """Whether a label means host: ``exact``, ``folded`` (any case) or ``prefix`` (any case, anything after)."""
    match rule:
        case "exact":
            return c == "host"
        case "folded":
            return F.lower(c) == "host"
        case "prefix":
            return F.lower(c).startswith("host")
    raise ValueError(f"no label rule {rule}")
