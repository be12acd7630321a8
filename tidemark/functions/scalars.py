"""Scalar functions: formats, buckets, clean-up of text. All are Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(28,6)"


def dec(c: Column) -> Column:
    """Exact money: sums in this type don't depend on the order of rows."""
    return c.cast(DEC)


def ratio(part: Column, whole: Column, empty: float | None) -> Column:
    """part / whole as double, ``empty`` where the whole is 0."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(empty).cast("double"))


def signed(side: Column, amount: Column) -> Column:
    return F.when(side == "BUY", amount).otherwise(-amount)


def price_bucket(price: Column, size: float) -> Column:
    """Nearest multiple of ``size``, ties to even; the price itself where the size is not positive."""
    return F.rint(price / F.lit(float(size))) * F.lit(float(size)) if size > 0 else price


def compact_usdt(v: Column) -> Column:
    """+$1.50M, -$2.3K, +$45.0."""
    a = F.abs(v).cast("double")
    body = F.when(a >= 1e6, F.format_string("$%.2fM", a / 1e6)).when(a >= 1e3, F.format_string("$%.1fK", a / 1e3)).otherwise(F.format_string("$%.1f", a))
    return F.concat(F.when(v < 0, "-").otherwise("+"), body)


def compact_or_na(v: Column) -> Column:
    """1.20B, 3.40M, 5.60K or two decimals; N/A for null."""
    a = F.abs(v)
    steps = ((1e9, "B"), (1e6, "M"), (1e3, "K"))
    return F.when(v.isNull(), "N/A").otherwise(F.coalesce(*[F.when(a >= k, F.format_string(f"%.2f{s}", v / k)) for k, s in steps], F.format_string("%.2f", v.cast("double"))))


def bubble_radius(notional: Column) -> Column:
    """Radius of a trade's bubble on the heatmap, 3 to 15."""
    return F.least(F.lit(15.0), F.greatest(F.lit(3.0), F.sqrt(notional) / 100))


def clock(seconds: Column) -> Column:
    """MM:SS."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def age_text(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "N/A").when(seconds < 60, F.format_string("%ds ago", seconds.cast("int"))).when(
        seconds < 3600, F.format_string("%dm ago", F.floor(seconds / 60).cast("int"))).otherwise(F.format_string("%dh ago", F.floor(seconds / 3600).cast("int")))


#: Patterns of credentials in messages, and what replaces them.
SENSITIVE = (
    (r"""(?i)(authorization['"]?\s*[:=]\s*['"]?(?:bearer\s+)?)[^'"\s,}]+""", "$1[REDACTED]"),
    (r"""(?i)(x-api-key['"]?\s*[:=]\s*['"]?)[^'"\s,}]+""", "$1[REDACTED]"),
    (r"""(?i)([?&]key=)[^&\s'"]+""", "$1[REDACTED]"),
    (r"sk-(?:proj-|ant-)?[A-Za-z0-9_\-]{8,}", "[REDACTED]"),
    (r"AIzaSy[A-Za-z0-9_\-]{10,}", "[REDACTED]"),
)


def redact_credentials(text: Column, literals: tuple[str, ...] = ()) -> Column:
    text = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("[REDACTED]")), literals, text)
    return reduce(lambda c, p: F.regexp_replace(c, *p), SENSITIVE, text)


def strip_fence(text: Column) -> Column:
    """The body of a Markdown code fence, or the trimmed text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(json)?\s*", ""), r"\s*```$", ""))


def symbol_key(c: Column) -> Column:
    """One spelling for a symbol: upper case, letters and digits only, quoted in USDT."""
    bare = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.when(bare.endswith("USDT"), bare).otherwise(F.concat(bare, F.lit("USDT")))


def stable_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
