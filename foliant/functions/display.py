"""How numbers are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import fixed


def usd_text(usd: Column) -> Column:
    """Two decimals from a dollar on, three below."""
    return F.concat(F.lit("$"), F.when(usd >= 1, F.format_string("%.2f", usd)).otherwise(F.format_string("%.3f", usd)))


def eta_text(ms: Column) -> Column:
    """Seconds below a minute, minutes below an hour, hours and minutes; null when there is none."""
    second, minute, hour, full = fixed.ETA_UNITS
    s = F.floor(ms / 1000 + 0.5)
    m = F.floor(s / 60 + 0.5)
    h, rest = F.floor(m / 60), F.pmod(m, F.lit(60))
    tell = lambda n, unit: F.concat(F.lit("~"), n.cast("string"), F.lit(f" {unit}"))
    hours = F.when(rest > 0, F.concat(tell(h, hour), F.lit(" "), rest.cast("string"), F.lit(f" {minute[0]}"))).otherwise(tell(h, full))
    return F.when(ms > 0, F.when(s < 60, tell(s, second)).when(m < 60, tell(m, minute)).otherwise(hours))


def speed_text(per_minute: Column) -> Column:
    """Chunks a minute, without decimals from ten on."""
    shown = F.when(per_minute >= 10, F.format_string("%.0f", per_minute)).otherwise(F.format_string("%.1f", per_minute))
    return F.when(per_minute > 0, F.concat(shown, F.lit(f" {fixed.SPEED_UNIT}")))
