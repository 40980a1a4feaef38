"""Line dedup by winnowing: later copies of runs of at least `run` consecutive lines are deleted.

Lines are compared without outer spaces; blank lines are neither compared nor deleted. Of the hashes of every `run`
consecutive lines the smallest (leftmost of ties) is a fingerprint, so any shared run of that length holds one at the
same place. Fingerprints that occur more than once are joined by position; each match is extended by up to run - 1
lines to both sides, which yields all windows of `run` lines around it, and every window that also starts earlier
(smaller doc_id, or the same document at an earlier line) is deleted. Longer repeated runs are unions of such windows.

`dedup_lines` takes a number of words, too: then later copies of shorter runs that have more words than that go as well,
so a passage counts however it is broken into lines. Windows of one and two lines are then compared whole.

Hot lines: the counts and first positions combine on the map side and are written, as are the windows; so each join is
one of two tables, whose skewed partitions adaptive execution splits, and windows are dealt by (fingerprint, window) anew.
A window is identified by its fingerprint's and its own 64-bit hash together.

Defined results: a null text has no lines and stays null; a null doc_id comes before all others; rows that repeat a
doc_id and its text are the same document and get the same answer, rows that repeat it with another text are separate
documents, ordered by a hash of the text.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ipvigil.llm.frames import cut_lineage, free_name, map_text

RUN = 3
#: Runs of fewer lines count as passages beyond so many words.
WORDS = 50


def _identity(doc_id: str, text: str) -> list[Column]:
    first = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    return [first.alias("doc"), F.xxhash64(text).alias("twin")]


def fingerprints(docs: DataFrame, run: int = RUN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, twin, h, at, low, near): each fingerprint, its place among the compared lines, and the hashes around it.

    `near` holds the hashes from place `low` on, at most run - 1 to each side.
    """
    compared = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    hashes = F.transform(compared, lambda x: F.xxhash64(F.trim(x)))
    rows = docs.select(*_identity(doc_id, text), hashes.alias("lines")).filter(F.size("lines") >= run)

    def smallest(start: Column) -> Column:
        window = F.slice("lines", start, F.lit(run))
        return (start - 1 + F.array_position(window, F.array_min(window))).cast("int")

    places = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("lines") - (run - 1)), smallest))
    placed = rows.withColumn("at", F.explode(places))
    low = F.greatest(F.col("at") - (run - 1), F.lit(1))
    placed = placed.withColumn("low", low)
    near = F.slice("lines", F.col("low"), F.col("at") + (run - 1) - F.col("low") + 1)
    return placed.select("doc", "twin", F.element_at("lines", F.col("at")).alias("h"), "at", "low", near.alias("near"))


def repeated_windows(docs: DataFrame, run: int = RUN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, twin, starts): per document the first lines (from 1) of all windows that also start earlier."""
    found = fingerprints(docs, run, doc_id, text)
    shared = cut_lineage(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "lines-shared")
    matched = found.join(shared, "h")
    # extended to both sides: every window of `run` lines that holds the fingerprint
    last = F.least(F.col("at"), F.col("low") + F.size("near") - run)
    starts = F.when(last >= F.col("low"), F.sequence("low", last)).otherwise(F.array().cast("array<int>"))
    windows = matched.withColumn("start", F.explode(starts))
    content = F.xxhash64(F.slice("near", F.col("start") - F.col("low") + 1, F.lit(run)))
    windows = cut_lineage(windows.select("h", content.alias("window"), F.struct("doc", "twin", "start").alias("place")), "lines-windows")
    first = windows.groupBy("h", "window").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    first = cut_lineage(first.filter(F.col("first") < F.col("last")).select("h", "window", "first"), "lines-first")
    later = windows.join(first, ["h", "window"]).filter(F.col("place") > F.col("first"))
    return later.select("place.*").groupBy("doc", "twin").agg(F.collect_set("start").alias("starts"))


def repeated_passages(
    docs: DataFrame, words: int = WORDS, run: int = RUN, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc, twin, starts): the compared lines (from 1) in windows of under `run` lines and over `words` words that also start earlier."""
    compared = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    described = F.transform(
        compared,
        lambda x: F.struct(
            F.xxhash64(F.trim(x)).alias("h"), F.xxhash64(F.lit(1), F.trim(x)).alias("g"),
            F.size(F.split(F.trim(x), "\\s+")).alias("words"),
        ),
    )
    rows = docs.select(*_identity(doc_id, text), described.alias("lines"))

    def windows(n: int) -> Column:
        starts = F.when(F.size("lines") >= n, F.sequence(F.lit(1), F.size("lines") - (n - 1))).otherwise(F.array().cast("array<int>"))
        made = F.transform(starts, lambda at: F.struct(at.alias("start"), F.slice("lines", at, F.lit(n)).alias("own")))
        return F.filter(made, lambda w: F.aggregate(w["own"]["words"], F.lit(0), lambda total, x: total + x) > words)

    found = rows.select("doc", "twin", F.explode(F.concat(*(windows(n) for n in range(1, run)))).alias("w"))
    place = F.struct("doc", "twin", F.col("w.start").alias("start")).alias("place")
    found = found.select(F.xxhash64("w.own.h").alias("h"), F.xxhash64("w.own.g").alias("g"), F.size("w.own").alias("n"), place)
    found = cut_lineage(found, "lines-passages")
    first = found.groupBy("h", "g", "n").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    first = cut_lineage(first.filter(F.col("first") < F.col("last")), "lines-first-passages")
    later = found.join(first, ["h", "g", "n"]).filter(F.col("place") > F.col("first"))
    gone = later.select("place.doc", "place.twin", F.explode(F.sequence("place.start", F.col("place.start") + F.col("n") - 1)).alias("start"))
    return gone.groupBy("doc", "twin").agg(F.collect_set("start").alias("starts"))


def rebuilt(
    docs: DataFrame, repeated: DataFrame, keep: list[str], run: int = RUN, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`keep`, and as line_text, line_count, line_removed, line_sha256 the kept text and figures of each document."""
    doc, twin, starts = (free_name(docs, x) for x in ("line_doc", "line_twin", "line_starts"))
    identity = [c.alias(n) for c, n in zip(_identity(doc_id, text), (doc, twin), strict=True)]
    marked = repeated.select(F.col("doc").alias(doc), F.col("twin").alias(twin), F.col("starts").alias(starts))
    joined = docs.select("*", *identity).join(marked, [doc, twin], "left")

    def compute(part: pa.RecordBatch) -> list:
        names = part.schema.names
        kept, counts, removed, digests = [], [], [], []
        for value, found in zip(part.column(names.index(text)), part.column(names.index(starts)), strict=True):
            whole = value.as_py()
            lines = [] if whole is None else whole.split("\n")
            compared = np.array([i for i, x in enumerate(lines) if x.strip(" ")], np.int64)
            drop = np.zeros(len(compared) + 1, np.int64)
            if found.is_valid and len(compared):
                begin = found.values.to_numpy() - 1
                np.add.at(drop, begin, 1)
                np.add.at(drop, np.minimum(begin + run, len(compared)), -1)
            gone = compared[np.cumsum(drop)[:-1] > 0]
            if len(gone):
                out = set(gone.tolist())
                whole = "\n".join(x for i, x in enumerate(lines) if i not in out)
            kept.append(whole)
            counts.append(len(compared))
            removed.append(len(gone))
            digests.append(hashlib.sha256((whole or "").encode()).hexdigest())
        return [pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]

    kinds = [("line_text", T.StringType()), ("line_count", T.LongType()), ("line_removed", T.LongType()), ("line_sha256", T.StringType())]
    fields = [T.StructField(free_name(docs, n), t) for n, t in kinds]
    needed = [*keep, *(c for c in (text, starts) if c not in keep)]
    out = map_text(joined, text, fields, compute, needed)
    return out.drop(*(c for c in (text, starts) if c not in keep))


def dedup_lines(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """The documents with later runs deleted, all columns as they were; documents left without a line go.

    With `words`, later runs of under `run` lines but over `words` words are deleted, too.
    """
    repeated = repeated_windows(docs, run)
    if words is not None:
        each = F.explode(F.transform("starts", lambda at: F.sequence(at, at + run - 1)))
        single = repeated.select("doc", "twin", each.alias("starts"))
        both = single.unionByName(repeated_passages(docs, words, run))
        repeated = both.groupBy("doc", "twin").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
        run = 1
    made = rebuilt(docs, repeated, docs.columns, run)
    text, count, removed, digest = made.columns[len(docs.columns) :]
    left = made.filter((F.col(count) == 0) | (F.col(removed) < F.col(count)))
    return left.withColumn("text", F.col(text)).select(*docs.columns)
