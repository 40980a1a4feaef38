"""Reports per address, per /24 block and per CIDR range."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ipvigil.constants import (
    CIDR_PATTERN,
    CLUSTER_SAMPLE_IPS,
    HISTORY_PER_IP,
    IPV6_PATTERN,
    MAX_PAGED_ROWS,
    MIN_CLUSTER_IPS,
    QUAD_PATTERN,
)
from ipvigil.functions.columns import ip_to_long, is_ipv4, safe_pct, subnet24
from ipvigil.operators.scale import top_n_per_key


def source_counts(events: DataFrame) -> DataFrame:
    """(ip, source, n): rows per address and source."""
    return events.groupBy("ip", "source").agg(F.count("*").alias("n"))


def stats_of(pairs: DataFrame) -> DataFrame:
    """(ip, reports, sources) from rows per address and source."""
    return pairs.groupBy("ip").agg(F.sum("n").alias("reports"), F.count("source").alias("sources"))


def ip_stats(events: DataFrame) -> DataFrame:
    """(ip, reports, sources) with exact distinct non-NULL sources.

    Counting per (ip, source) first keeps both steps in hash aggregation with fixed-size buffers and combines
    a hot address on the map side.
    """
    return stats_of(source_counts(events))


def offender_totals(events: DataFrame) -> DataFrame:
    """One row: addresses, repeat addresses, cross-source addresses and the most reports of a repeat address."""
    return totals_of(ip_stats(events))


def totals_of(stats: DataFrame) -> DataFrame:
    repeat = F.col("reports") > 1
    return stats.agg(
        F.count("*").alias("ips"),
        F.count_if(repeat).alias("repeat_ips"),
        F.count_if(F.col("sources") >= 2).alias("cross_source_ips"),
        F.max(F.when(repeat, F.col("reports"))).alias("max_reports"),
    )


def corroboration_share(events: DataFrame) -> DataFrame:
    totals = offender_totals(events)
    return totals.select(
        "repeat_ips",
        "cross_source_ips",
        F.when(F.col("repeat_ips") > 0, safe_pct("cross_source_ips", "repeat_ips")).alias("pct"),
    )


def page_bounds(page: int, page_size: int) -> tuple[int, int]:
    """(rows to skip, page size). All rows up to a page meet in one place, so pages end at MAX_PAGED_ROWS rows."""
    size = max(1, min(page_size, 100))
    skip = (max(1, page) - 1) * size
    if skip + size > MAX_PAGED_ROWS:
        raise ValueError(f"pages reach to row {MAX_PAGED_ROWS}; continue from the last row seen with `after`")
    return skip, size


def repeat_offenders(
    events: DataFrame, page: int = 1, page_size: int = 20, after: tuple[int, int, str] | None = None
) -> DataFrame:
    """One page of addresses reported more than once, best corroborated first.

    Only (ip, reports, sources) is shuffled for the ranking; the wide columns are read for the page's addresses alone.
    `after` = (source_count, report_count, ip) of the last row seen continues from there, however deep.
    """
    skip, size = page_bounds(1 if after is not None else page, page_size)
    ranked = ip_stats(events).filter("reports > 1")
    if after is not None:
        sources, reports, ip = after
        fewer = (F.col("reports") < reports) | ((F.col("reports") == reports) & (F.col("ip") > ip))
        ranked = ranked.filter((F.col("sources") < sources) | ((F.col("sources") == sources) & fewer))
    ordered = ranked.orderBy(F.col("sources").desc(), F.col("reports").desc(), "ip")
    chosen = ordered.offset(skip).limit(size) if skip else ordered.limit(size)
    rows = events.join(F.broadcast(chosen), "ip")
    detail = rows.groupBy("ip", "reports", "sources").agg(
        F.max("country_code").alias("country_code"),
        F.sort_array(F.collect_set("source")).alias("source_names"),
        F.max("abuse_confidence_score").alias("max_score"),
        F.max("last_reported_at").alias("last_reported_at"),
    )
    return detail.select(
        "ip",
        "country_code",
        F.col("reports").alias("report_count"),
        F.col("sources").alias("source_count"),
        F.col("source_names").alias("sources"),
        "max_score",
        "last_reported_at",
    ).orderBy(F.col("source_count").desc(), F.col("report_count").desc(), "ip")


def _clustered(events: DataFrame) -> DataFrame:
    """(subnet, ip, max_country, sources, score): one row per address of a /24 block, from one pass over the events."""
    v4 = events.filter(is_ipv4("ip")).withColumn("subnet", subnet24("ip"))
    return v4.groupBy("subnet", "ip").agg(
        F.max("country_code").alias("country_code"),
        F.collect_set("source").alias("sources"),
        F.max("abuse_confidence_score").alias("score"),
    )


def cluster_sizes(events: DataFrame) -> DataFrame:
    """(subnet, ip_count) of every /24 block with three or more reported addresses."""
    pairs = events.filter(is_ipv4("ip")).select(subnet24("ip").alias("subnet"), "ip").distinct()
    return pairs.groupBy("subnet").agg(F.count("*").alias("ip_count")).filter(F.col("ip_count") >= MIN_CLUSTER_IPS)


def infra_clusters(events: DataFrame, limit: int | None = 15) -> DataFrame:
    """/24 blocks with three or more reported addresses, largest first; `limit=None` returns all.

    A block has at most a thousand texts for addresses, so everything about it comes from those: the events are
    reduced to one row per address first, map tasks doing most of it, and are read once.
    """
    per_block = _clustered(events).groupBy("subnet").agg(
        F.count("*").alias("ip_count"),
        F.max("country_code").alias("country_code"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.max("score").alias("max_score"),
        F.slice(F.sort_array(F.collect_list("ip")), 1, CLUSTER_SAMPLE_IPS).alias("sample_ips"),
    )
    ranked = per_block.filter(F.col("ip_count") >= MIN_CLUSTER_IPS).orderBy(F.col("ip_count").desc(), "subnet")
    return ranked if limit is None else ranked.limit(max(1, min(limit, 50)))


def newest_first():
    return [F.col("loaded_at").desc_nulls_first(), F.col("event_id").desc()]


def history_of(events: DataFrame, ip: str | Column, n: int = HISTORY_PER_IP) -> DataFrame:
    """The newest rows of one address; text that is no address simply has none."""
    return events.filter(F.col("ip") == ip).orderBy(*newest_first()).limit(n)


def ip_history(events: DataFrame, n: int = HISTORY_PER_IP) -> DataFrame:
    """The newest `n` rows of every address, numbered from the newest."""
    return top_n_per_key(events, "ip", newest_first(), n, "event_id")


def local_evidence(events: DataFrame, n: int = HISTORY_PER_IP) -> DataFrame:
    """(ip, seen, sources) over the newest rows of every address."""
    rows = ip_history(events.select("ip", "loaded_at", "event_id", "source"), n)
    return rows.groupBy("ip").agg(
        F.count("*").alias("seen"),
        F.sort_array(F.collect_set(F.when(F.col("source") != "", F.col("source")))).alias("sources"),
    )


def latest_score(events: DataFrame, n: int = HISTORY_PER_IP) -> DataFrame:
    """Per address, the newest repeat-offence probability among its newest rows."""
    rows = ip_history(events.select("ip", "loaded_at", "event_id", "reoffense_probability"), n)
    scored = rows.filter(F.col("reoffense_probability").isNotNull())
    return scored.groupBy("ip").agg(F.min_by("reoffense_probability", "rank").alias("reoffense_probability"))


def first_sighting(events: DataFrame) -> DataFrame:
    """First row of every address with its number of rows, in one aggregation.

    Map tasks keep one row per address, so a hot address costs one row per task.
    """
    rest = [c for c in events.columns if c not in ("ip", "loaded_at", "event_id")]
    first = F.min(F.struct("loaded_at", "event_id", *rest)).alias("first")
    grouped = events.groupBy("ip").agg(first, F.count("*").alias("report_count"))
    return grouped.select("ip", "first.*", "report_count")


def first_with_counts(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`first_sighting` as a join of the first rows with the counts per address; two narrow shuffles on ip.

    The first row is found on (loaded_at, event_id) alone, which stays in hash aggregation; its other columns follow by
    an equi-join on the row's id.
    """
    stats = events.groupBy("ip").agg(
        F.min(F.struct("loaded_at", "event_id")).alias("first"), F.count("*").alias("report_count")
    )
    stats = stats.select("ip", F.col("first.event_id").alias("event_id"), "report_count")
    rows = events.select("event_id", *[c for c in columns if c not in ("ip", "event_id")])
    return stats.join(rows, "event_id").select("ip", *[c for c in columns if c != "ip"], "report_count")


def address_bits(ip: str | Column) -> Column:
    """An address as text of 32 (IPv4) or 128 (IPv6) binary digits; NULL for text that is neither."""
    ip = F.col(ip) if isinstance(ip, str) else ip
    v4 = F.lpad(F.conv(ip_to_long(ip).cast("string"), 10, 2), 32, "0")
    # the groups before and after "::", and as many zero groups between them as are left out
    halves = F.split(F.lower(ip), "::")
    groups = [F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "") for i in (0, 1)]
    missing = F.greatest(F.lit(8) - F.size(groups[0]) - F.size(groups[1]), F.lit(0))
    every = F.concat(groups[0], F.array_repeat(F.lit("0"), missing), groups[1])
    v6 = F.array_join(F.transform(every, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    exact = (F.size(every) == 8) & (F.size(halves) == 2) | (F.size(halves) == 1) & (F.size(groups[0]) == 8)
    return F.when(ip.rlike(QUAD_PATTERN), v4).when(ip.rlike(IPV6_PATTERN) & exact, v6)


def cidr_bounds(ranges: DataFrame, cidr: str = "cidr") -> DataFrame:
    """Add family, prefix_len and the range's leading bits; a bare address is a range of one, other text is dropped."""
    length = F.get(F.split(F.col(cidr), "/"), F.lit(1))
    bits = address_bits(F.substring_index(cidr, "/", 1))
    sized = ranges.withColumns({"bits": bits, "prefix_len": F.coalesce(length.try_cast("int"), F.length(bits))})
    stated = F.col(cidr).rlike(CIDR_PATTERN) | (F.col("bits").isNotNull() & (length.isNull() | length.rlike("^[0-9]{1,3}$")))
    valid = sized.filter(stated & (F.col("prefix_len") <= F.length("bits")))
    return valid.withColumns({"family": F.length("bits"), "prefix": F.expr("left(bits, prefix_len)")}).drop("bits")


def cidr_members(addresses: DataFrame, ranges: DataFrame, cidr: str = "cidr") -> DataFrame:
    """(ip, cidr) for every given range an address lies in, IPv4 and IPv6.

    Containment is equality of the leading bits, so each address is looked up once per prefix length in use (at most
    33 or 129) with an ordinary equi-join, which adaptive execution broadcasts or splits by its run-time size.
    """
    bounds = cidr_bounds(ranges.select(cidr).distinct(), cidr)
    lengths = bounds.agg(F.collect_set(F.struct("family", "prefix_len")).alias("lengths")).scalar()
    numbered = addresses.select("ip").distinct().withColumn("bits", address_bits("ip"))
    probes = (
        numbered.filter(F.col("bits").isNotNull())
        .withColumn("lengths", lengths)
        .select("ip", "bits", F.inline("lengths"))
        .filter(F.col("family") == F.length("bits"))
        .select("ip", "family", "prefix_len", F.expr("left(bits, prefix_len)").alias("prefix"))
    )
    return probes.join(bounds, ["family", "prefix_len", "prefix"]).select("ip", cidr)


def cidr_enrich(reported: DataFrame, events: DataFrame) -> DataFrame:
    """Reported addresses of a range with the number of own sources that saw them (0 if none).

    Only events of reported addresses are counted, and pairs are made distinct before that, so a hot address
    shrinks to its sources.
    """
    wanted = reported.select("ip").distinct()
    own = events.filter(F.col("source").isNotNull()).select("ip", "source").join(wanted, "ip", "left_semi")
    pairs = own.distinct()
    per_ip = pairs.groupBy("ip").agg(F.count("*").alias("source_count"))
    joined = reported.join(per_ip, "ip", "left")
    return joined.withColumn("source_count", F.coalesce("source_count", F.lit(0)))


def rank_cidr(reported: DataFrame) -> DataFrame:
    return reported.orderBy(F.col("source_count").desc(), F.col("abuse_confidence_score").desc_nulls_last(), "ip")


def cidr_confirmed(reported: DataFrame) -> DataFrame:
    return reported.agg(F.count_if(F.col("source_count") >= 2).alias("confirmed"), F.count("*").alias("reported"))
