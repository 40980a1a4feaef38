"""Scalar functions on events: levels, addresses, buckets, labels."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ipvigil.constants import (
    BULK_SOURCE,
    CLOUD_PROVIDERS,
    IPV4_PATTERN,
    QUAD_PATTERN,
    REPORTS_READ,
    RISK_BANDS,
    RISK_FLOOR,
    RISK_LEVELS,
)


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def risk_level(score: Column | str) -> Column:
    """NULL and NaN scores take the lowest level (NaN would otherwise compare above every bound)."""
    score = F.nanvl(col_of(score), F.lit(None).cast("double"))
    level = F
    for bound, name in RISK_BANDS:
        level = level.when(score >= bound, name)
    return level.otherwise(RISK_FLOOR)


def event_time(epoch_seconds: Column | str) -> Column:
    """Whole-second wall-clock time of a Unix epoch, independent of the session time zone."""
    seconds = F.floor(col_of(epoch_seconds))
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return origin + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def categories(category: Column | str) -> Column:
    """A missing or empty category is no category at all."""
    category = col_of(category)
    empty = F.array().cast("array<string>")
    return F.when(category.isNull() | (category == ""), empty).otherwise(F.array(category))


def is_ipv4(ip: Column | str) -> Column:
    """Four dotted digit groups; the groups are not range-checked and IPv6 does not match."""
    return col_of(ip).rlike(IPV4_PATTERN)


def subnet24(ip: Column | str) -> Column:
    return F.concat(F.substring_index(col_of(ip), ".", 3), F.lit(".0/24"))


def ip_to_long(ip: Column | str) -> Column:
    """Numeric value of a dotted quad with every group in 0..255, NULL for anything else."""
    ip = col_of(ip)
    groups = F.split(ip, r"\.")
    a, b, c, d = (F.get(groups, F.lit(i)).try_cast("bigint") for i in range(4))
    return F.when(ip.rlike(QUAD_PATTERN), a * 16777216 + b * 65536 + c * 256 + d)


def country_filter(text: str) -> str:
    """What a typed country filter means: upper case, two characters."""
    return text.upper()[:2]


def country_bucket(country: Column | str, top: Sequence[str]) -> Column:
    country = col_of(country)
    return F.when(country.isin(list(top)), country).otherwise("OTHER")


def fill_feature_defaults(df: DataFrame) -> DataFrame:
    return df.fillna({"category": "UNKNOWN", "abuse_confidence_score": 0.0})


def category_names(reports: Column | str, names: Mapping[int, str]) -> Column:
    """Names of the category ids in the first reports: first-seen order, no repeats, unknown ids left out."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    lookup = F.create_map(*pairs)
    first = F.slice(F.coalesce(col_of(reports), F.array().cast("array<struct<categories:array<int>>>")), 1, REPORTS_READ)
    ids = F.flatten(F.transform(first, lambda r: F.coalesce(r["categories"], F.array().cast("array<int>"))))
    return F.array_distinct(F.array_compact(F.transform(ids, lambda i: F.try_element_at(lookup, i))))


def cloud_provider(asn: Column | str, providers: Sequence[tuple[str, str]] = tuple(CLOUD_PROVIDERS)) -> Column:
    """The first of `providers` (label, pattern) whose pattern is in the network's name, NULL for others."""
    asn = col_of(asn)
    found = F
    for label, pattern in providers:
        found = found.when(asn.rlike(f"(?i){pattern}"), label)
    return found.otherwise(F.lit(None).cast("string"))


def origin(is_tor, is_proxy, is_hosting, is_mobile) -> Column:
    """Strongest known property of the address; plain residential when nothing is flagged."""
    return (
        F.when(col_of(is_tor), "tor")
        .when(col_of(is_proxy), "proxy")
        .when(col_of(is_hosting), "hosting")
        .when(col_of(is_mobile), "mobile")
        .otherwise("residential")
    )


def last_activity(recent_categories: Column | str) -> Column:
    return F.lower(F.try_element_at(col_of(recent_categories), F.lit(1)))


def risk_factors(source, category, score, level, bulk_source: str = BULK_SOURCE) -> Column:
    """At most two reasons why an event looks risky, in fixed order."""
    source, category, score, level = (col_of(c) for c in (source, category, score, level))
    uncategorised = F.coalesce(category, F.lit("")) == ""
    score = F.nanvl(score, F.lit(None).cast("double"))
    reasons = F.array(
        F.when((source == bulk_source) & uncategorised, F.lit("bulk feed without category")),
        F.when(score >= RISK_BANDS[0][0], F.lit("top score")),
        F.when(level.isin("critical", "high"), F.concat(F.lit("risk "), level)),
    )
    return F.slice(F.array_compact(reasons), 1, 2)


def unusual_pct(score: Column | str, breaks: Column | Sequence[float] | None) -> Column:
    """"More unusual than x % of events", from 101 ascending score breakpoints; lower scores are stranger."""
    if breaks is None or (not isinstance(breaks, Column) and len(breaks) == 0):
        return F.lit(None).cast("int")
    score = col_of(score)
    if not isinstance(breaks, Column):
        breaks = F.array(*[F.lit(float(b)) for b in breaks])
    at_or_below = F.size(F.filter(breaks, lambda b: b <= score))
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - at_or_below))
    return F.when(score.isNotNull() & (F.size(breaks) > 0), clamped)


def rarest_pct_label(unusual: Column | str) -> Column:
    return F.greatest(F.lit(1), F.lit(100) - col_of(unusual))


def tenths_text(part: Column, whole: Column) -> Column:
    """Percentage with one decimal as text, rounded half up in whole-number arithmetic."""
    part, whole = part.cast("bigint"), whole.cast("bigint")
    doubled = part * 2000 + whole
    tenths = ((doubled - F.pmod(doubled, whole * 2)) / (whole * 2)).cast("bigint")
    last = F.pmod(tenths, F.lit(10))
    return F.concat(((tenths - last) / 10).cast("bigint").cast("string"), F.lit("."), last.cast("string"))


def safe_pct(part, whole) -> Column:
    """100 * part / whole, and 0 where there is no whole."""
    return F.coalesce(F.try_divide(col_of(part).cast("double") * 100.0, col_of(whole).cast("double")), F.lit(0.0))


def safe_rate(amount, duration) -> Column:
    """amount / duration, NULL where no time passed."""
    return F.try_divide(col_of(amount).cast("double"), col_of(duration).cast("double"))


def check_status(failed, total) -> Column:
    """pass without failures, warn below one percent, fail otherwise."""
    failed = col_of(failed)
    pct = F.round(safe_pct(failed, total), 2)
    return F.when(failed == 0, "pass").when(pct < 1, "warn").otherwise("fail")


def known_risk_level(level: Column | str) -> Column:
    return col_of(level).isin(RISK_LEVELS)


def trend_delta(current, previous) -> Column:
    """Change since the previous value to two decimals; NULL when there is none or it is below 0.05."""
    delta = F.round(col_of(current) - col_of(previous), 2)
    return F.when(F.abs(delta) >= 0.05, delta)


def trend_direction(first, last, scale: float = 1.0) -> Column:
    change = F.coalesce(col_of(last), F.lit(0.0)) * scale - F.coalesce(col_of(first), F.lit(0.0)) * scale
    return F.when(F.abs(change) < 0.5, "stable").when(change > 0, "rising").otherwise("falling")


def posture(urgent, total) -> Column:
    """Tone of a briefing from the share of urgent findings."""
    pct = F.round(safe_pct(urgent, total), 0)
    return F.when(pct >= 50, "red").when(pct >= 25, "amber").otherwise("green")
