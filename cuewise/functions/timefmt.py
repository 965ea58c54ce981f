"""Clock text and seconds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def hms_to_sec(text: Column, policy: str = "zero") -> Column:
    """Seconds of `HH:MM:SS`. What bad input gives depends on the policy.

    zero:      `MM:SS` too, no range test, bad -> 0
    null:      `MM:SS` too, no range test, bad -> null
    strict:    three parts only, minutes and seconds < 60, bad -> -1
    two_part:  as strict but `MM:SS` too
    decimal:   decimals and plain digits allowed, out of range or bad -> null (double)
    """
    parts = F.split(F.trim(text) if policy != "decimal" else text, ":")
    n = F.size(parts)
    a, b, c = (F.get(parts, F.lit(i)).try_cast("long") for i in range(3))
    three = a * 3600 + b * 60 + c
    two = a * 60 + b
    if policy in ("zero", "null"):
        value = F.when(n == 3, three).when(n == 2, two)
        return F.coalesce(value, F.lit(0).cast("long")) if policy == "zero" else value
    if policy in ("strict", "two_part"):
        ok3 = (n == 3) & (a >= 0) & b.between(0, 59) & c.between(0, 59)
        value = F.when(ok3, three)
        if policy == "two_part":
            value = value.when((n == 2) & a.between(0, 59) & b.between(0, 59), two)
        return F.coalesce(value, F.lit(-1).cast("long"))
    if policy == "decimal":
        sec3 = F.get(parts, F.lit(2)).try_cast("double")
        sec2 = F.get(parts, F.lit(1)).try_cast("double")
        return (
            F.when(text.rlike(r"^\d+$"), text.try_cast("double"))
            .when((n == 3) & (b < 60) & (sec3 < 60), a * 3600 + b * 60 + sec3)
            .when((n == 2) & (sec2 < 60), a * 60 + sec2)
        )
    raise ValueError(policy)


def sec_to_hms(sec: Column, short: bool = False) -> Column:
    """`HH:MM:SS` of truncated, non-negative seconds; `short` leaves a zero hour out."""
    s = F.greatest(sec.cast("long"), F.lit(0).cast("long"))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    full = F.format_string("%02d:%02d:%02d", h, m, r)
    return F.when(h == 0, F.format_string("%02d:%02d", m, r)).otherwise(full) if short else full


def is_hms(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))).rlike(r"^\d{2}:\d{2}:\d{2}$")


def normalize_stamp(stamp: Column) -> Column:
    """Pad the parts of a two- or three-part stamp to `HH:MM:SS`; leave others alone."""
    parts = F.split(stamp, ":")

    def pad(i: int) -> Column:
        p = F.get(parts, F.lit(i))
        return F.when(F.length(p) < 2, F.lpad(p, 2, "0")).otherwise(p)

    return (
        F.when(F.size(parts) == 2, F.concat(F.lit("00:"), pad(0), F.lit(":"), pad(1)))
        .when(F.size(parts) == 3, F.concat_ws(":", pad(0), pad(1), pad(2)))
        .otherwise(stamp)
    )
