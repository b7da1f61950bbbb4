"""How reports show numbers and names, as column expressions or plain functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def interaction_label(term: Column) -> Column:
    """A term without its prefix, its pair mark as a dash (ligand-receptor) or an arrow (ligand-factor)."""
    return F.replace(F.replace(F.regexp_replace(term, "^beta_", ""), F.lit("$"), F.lit(" – ")), F.lit("#"), F.lit(" → "))


def duration(seconds: float) -> str:
    """Whole seconds, then minutes and seconds, then hours and minutes; parts of zero are left out."""
    if not math.isfinite(seconds) or seconds < 0:
        return "—"
    s = max(1, math.floor(seconds + 0.5))
    parts = ((s, "s"),) if s < 60 else ((s // 60, "m"), (s % 60, "s")) if s < 3600 else ((s // 3600, "h"), (s % 3600 // 60, "m"))
    return " ".join(f"{n}{unit}" for k, (n, unit) in enumerate(parts) if k == 0 or n)


def percent(permille: int) -> int:
    return min(100, (max(permille, 0) + 5) // 10)


def value_range(values: DataFrame) -> tuple[float, float]:
    """The least and largest finite value; a single value is widened, no value is (0, 1)."""
    ok = values.where(~F.isnan("value") & (F.abs("value") < float("inf")))
    low, high = ok.agg(F.min("value"), F.max("value")).first()
    return (0.0, 1.0) if low is None else (low, high) if high > low else (low, low + 1e-9)


def symmetric_range(values: DataFrame, q: float = 0.999) -> tuple[float, float]:
    """Both sides of zero, at the nearest-rank quantile of the finite absolute values."""
    size = values.where(~F.isnan("value") & (F.abs("value") < float("inf"))).select(F.abs("value").alias("value"))
    n = size.count()
    if not n:
        return -1.0, 1.0
    at = size.agg(F.expr(f"percentile_disc({(int(q * (n - 1)) + 0.5) / n!r}) WITHIN GROUP (ORDER BY value)")).first()[0]
    return (-at, at) if at > 0 else (-1e-6, 1e-6)


# The stops of the colour maps, from low to high.
VIRIDIS = ((68, 1, 84), (72, 40, 120), (62, 74, 137), (49, 104, 142), (38, 130, 142), (31, 158, 137), (53, 183, 121), (109, 205, 89), (183, 222, 39), (253, 231, 37))
MAGMA = ((0, 0, 4), (40, 11, 84), (101, 13, 99), (156, 37, 99), (205, 71, 93), (238, 116, 84), (251, 173, 81), (252, 229, 91), (252, 253, 191))
DIVERGING = ((49, 54, 149), (247, 247, 247), (165, 0, 38))
NOT_A_VALUE = (128, 128, 128)
GOLDEN, SATURATION, LIGHTNESS, NO_CATEGORY = 0.618033988749895, 0.72, 0.52, (100, 100, 110)
VIEW_MARGIN = 0.06


def along(t: Column, stops: tuple) -> Column:
    """[red, green, blue] at 0 to 1 along the stops, straight between two."""
    x = t * (len(stops) - 1)
    at = F.least(F.floor(x), F.lit(len(stops) - 2)).cast("int")
    table = F.array(*(F.array(*map(F.lit, s)) for s in stops))
    return F.zip_with(F.get(table, at), F.get(table, at + 1), lambda a, b: F.floor(a + (b - a) * (x - at) + 0.5).cast("int"))


def rgb(value: Column, low: Column, high: Column, colours: str = "viridis") -> Column:
    """[red, green, blue] of a value between two bounds, clamped to them; "diverging" is symmetric about 0. Grey where
    anything is null or not finite, the middle where the bounds don't differ."""
    whole = F.lit(True)
    for v in (value, low, high):
        whole = whole & F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    inside = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    if colours == "diverging":
        m = F.greatest(F.abs(low), F.abs(high), F.lit(1e-12))
        out = along(inside((value + m) / (2 * m)), DIVERGING)
    else:
        stops = {"viridis": VIRIDIS, "magma": MAGMA}[colours]
        out = F.when(high > low, along(inside((value - low) / (high - low)), stops)).otherwise(along(F.lit(0.5), VIRIDIS))
    return F.when(whole, out).otherwise(F.array(*map(F.lit, NOT_A_VALUE)))


def category_rgb(index: Column, categories: int) -> Column:
    """[red, green, blue] of a category: hues a golden ratio apart."""
    if categories <= 0:
        return F.array(*map(F.lit, NO_CATEGORY))
    turn = (index * F.lit(GOLDEN) % 1) * 12
    spread = SATURATION * min(LIGHTNESS, 1 - LIGHTNESS)

    def part(offset: int) -> Column:
        k = (turn + offset) % 12
        return F.floor((LIGHTNESS - spread * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))) * 255 + 0.5).cast("int")

    return F.array(part(0), part(8), part(4))


def selectable(code: Column, checked: list[bool], unknown: int = 65535) -> Column:
    """Whether a cell's type is among the ticked ones; cells of unknown or unlisted type always are, and so is every
    cell where there is nothing to tick."""
    off = [k for k, on in enumerate(checked) if not on and k != unknown]
    return ~F.coalesce(code.isin(off), F.lit(False)) if off else F.lit(True)


def view(width: float, height: float, bounds: tuple[float, float, float, float]) -> tuple[float, float, float]:
    """(x, y, zoom) that shows the bounds (least x, largest x, least y, largest y) with a margin; zoom in powers of 2."""
    x0, x1, y0, y1 = bounds
    w, h = ((b - a) * (1 + 2 * VIEW_MARGIN) or 1.0 for a, b in ((x0, x1), (y0, y1)))
    return (x0 + x1) / 2, (y0 + y1) / 2, math.log2(max(min(width / w, height / h), 1e-6))


def mean_shown(mean: float | None) -> str:
    """A channel's mean with five digits; a dash without values."""
    return "—" if mean is None else f"{mean:#.5g}"
