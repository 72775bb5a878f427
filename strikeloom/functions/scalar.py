"""Column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strikeloom.constants import SCALE_SUFFIX


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c) -> Column:
    """Number or 0.0 when null or not a number."""
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def parse_ts(text) -> Column:
    """ISO text (Z, offset or naive = UTC) or epoch seconds to a timestamp."""
    text = F.trim(col(text).cast("string"))
    epoch = text.try_cast("double")
    return F.when(epoch.isNotNull(), F.timestamp_micros(F.round(epoch * 1e6).cast("bigint"))).otherwise(
        F.try_to_timestamp(text)
    )


def epoch_s(ts) -> Column:
    """Seconds since the epoch with microseconds kept."""
    return F.unix_micros(col(ts)) / F.lit(1e6)


def seconds_between(later, earlier) -> Column:
    return (F.unix_micros(col(later)) - F.unix_micros(col(earlier))) / F.lit(1e6)


def ratio(a, b) -> Column:
    """a / b, null when b is 0 or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def ratio_or(a, b, default: float) -> Column:
    return F.coalesce(ratio(a, b), F.lit(default))


def ratio_inf(a, b) -> Column:
    """a / b; infinite when b is 0 and a is not, 0 when both are 0."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b > 0, F.try_divide(a, b)).when(a != 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def signed_log(x) -> Column:
    x = col(x)
    return F.when(x < 0, -F.log1p(-x)).otherwise(F.log1p(x))


def clamp(x, lo, hi) -> Column:
    return F.greatest(F.least(col(x), F.lit(hi)), F.lit(lo))


def contract_key(text) -> Column:
    """Contract id without separators, upper case."""
    return F.upper(F.translate(col(text), "_ ", ""))


def contract_id(ticker, expiry, right, strike) -> Column:
    """ticker + yyMMdd + C/P + strike in thousandths, at least eight digits, half to even."""
    thousandths = F.bround(col(strike).cast("double") * 1000, 0).cast("bigint")
    side = F.when(F.upper(col(right)).startswith("C"), "C").otherwise("P")
    return F.concat(col(ticker), F.date_format(col(expiry), "yyMMdd"), side, F.format_string("%08d", thousandths))


def parse_money(text) -> Column:
    """Display money such as ``-$5.8K`` or ``$41,550.9K`` to a number."""
    text = F.trim(col(text))
    body = F.regexp_extract(text, r"^-?\$?\s*([\d,]+(?:\.\d+)?)\s*([KMB]?)", 1)
    unit = F.regexp_extract(text, r"^-?\$?\s*([\d,]+(?:\.\d+)?)\s*([KMB]?)", 2)
    value = F.regexp_replace(body, ",", "").try_cast("double")
    scale = F.lit(None).cast("double")
    for suffix, factor in SCALE_SUFFIX.items():
        scale = F.when(unit == suffix, F.lit(factor)).otherwise(scale)
    return F.when(text.startswith("-"), -value * scale).otherwise(value * scale)


def option_right(text) -> Column:
    first = F.lower(F.substring(col(text), 1, 1))
    return F.when(first == "c", "C").when(first == "p", "P")


def window_start(day, hhmmss) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", col(day), col(hhmmss)), F.lit("yyyy-MM-dd HHmmss"))


def is_stale_capture(as_of, day, hhmmss, limit_s: float = 2.0) -> Column:
    return F.abs(seconds_between(as_of, window_start(day, hhmmss))) > limit_s


def shape(g, col_max, p: float) -> Column:
    """Power shape that keeps the sign and the column maximum."""
    if p == 1.0:
        return col(g)
    g, m = col(g), col(col_max)
    return F.when(m > 0, m * F.signum(g) * F.pow(F.abs(g) / m, F.lit(p))).otherwise(F.lit(0.0))


def percentile_of_history(value, history) -> Column:
    """(below + half the ties) / n over an array of past values; null when empty."""
    value, history = col(value), col(history)
    below = F.size(F.filter(history, lambda h: h < value))
    ties = F.size(F.filter(history, lambda h: h == value))
    return F.try_divide(below + 0.5 * ties, F.size(history).cast("double"))
