"""Files for firewalls and spreadsheets."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: rule formats understood by the consuming programs
RULES = {"iptables": "iptables -A INPUT -s {} -j DROP", "nginx": "deny {};"}
HEADERS = {
    "iptables": ["#!/bin/sh", "# generated blocklist, best corroborated addresses first"],
    "nginx": ["# generated deny list, best corroborated addresses first"],
}
SUBNET_HEADER = ["# generated deny list of /24 blocks with several reported addresses"]


def rule(target: Column, style: str) -> Column:
    before, after = RULES[style].split("{}")
    return F.concat(F.lit(before), target, F.lit(after))


def _write(ranked: DataFrame, lines: Column, header: list[str], order: list[Column], path: str) -> None:
    """`path`/header, and `path`/rules: every row's line, in files whose names are in the order of the ranking.

    Rows are sorted by ranges over all tasks, so an export has no largest size.
    """
    ranked.orderBy(*order).select(lines.alias("line")).write.mode("overwrite").text(f"{path}/rules")
    head = ranked.sparkSession.createDataFrame([(h,) for h in header], "line string").coalesce(1)
    head.write.mode("overwrite").text(f"{path}/header")


def write_blocklist(offenders: DataFrame, path: str, style: str = "nginx") -> None:
    """Rules for all given addresses (ip, reports, sources), best corroborated first."""
    order = [F.col("sources").desc(), F.col("reports").desc(), F.col("ip")]
    _write(offenders, rule(F.col("ip"), style), HEADERS[style], order, path)


def write_subnets(clusters: DataFrame, path: str) -> None:
    """Rules for all given blocks (subnet, ip_count), largest first."""
    _write(clusters, rule(F.col("subnet"), "nginx"), SUBNET_HEADER, [F.col("ip_count").desc(), F.col("subnet")], path)


# --- fixed values: columns of the exported feed and what fills them
FEED_CSV = {"ip": "ip", "country_code": "country_code", "risk_level": "risk_level", "timestamp": "event_time"}


def feed_csv_lines(feed: DataFrame) -> DataFrame:
    """(event_id, line): all fields quoted, quotes doubled, NULL as empty."""

    def quoted(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))

    return feed.select("event_id", F.concat_ws(",", *[quoted(c) for c in FEED_CSV.values()]).alias("line"))


def write_feed_csv(feed: DataFrame, path: str) -> None:
    """One file of the live feed, which has a few dozen rows."""
    rows = feed.select(*[F.col(c).alias(n) for n, c in FEED_CSV.items()]).repartition(1)
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', nullValue="", emptyValue="")
