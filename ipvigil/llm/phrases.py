"""Lempel-Ziv phrase fingerprints: the dictionary phrases of a text, hashed, and the smallest hashes as signature.

A text's bytes are parsed as in LZ78: each phrase is the shortest run that is no phrase yet. Texts that share content
share phrases, as they would share a compressor's dictionary. The `size` smallest 32-bit hashes of the phrase set are
the fingerprint; the share of common hashes among the smallest of two fingerprints' union estimates the likeness of the
phrase sets (exact while a text has no more than `size` phrases).

`with_next` also compares each document with the next by doc_id. Ids are dealt to ranges, found from their quantiles,
and the first document of each range is also sent to the range before; a range is read in order, with two texts in
memory. Of a text that begins like another one only the rest is parsed anew.

Defined results: a null text is empty; an empty text has an empty fingerprint, which is like another empty one only;
null ids come first; documents with equal ids follow each other in the order of a hash of their texts; a single
document is its own successor.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from ipvigil.llm.frames import free_name, map_text

SIZE = 64


def parse(data: bytes, at: int, known: set[bytes], phrases: list[bytes], ends: list[int]) -> None:
    """Continue a parse from byte `at`, with the phrases so far; every phrase but its last byte is a phrase too."""
    n, guess = len(data), 1
    while at < n:
        end = at + guess
        if data[at:end] in known:
            while end < n and data[at : end + 1] in known:
                end += 1
            end += 1
        else:
            while end - at > 1 and data[at : end - 1] not in known:
                end -= 1
        phrase = data[at:end]
        guess = max(len(phrase) - 1, 1)
        known.add(phrase)
        phrases.append(phrase)
        at += len(phrase)
        ends.append(at)


def smallest(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    return np.unique(hashes)[:size] if len(hashes) <= 4 * size else np.unique(np.partition(hashes, 2 * size)[: 2 * size])[:size]


def hashed(phrases: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, phrases), np.uint64, len(phrases)) >> np.uint64(32)


class Parsed:
    """The parse of one text."""

    def __init__(self, data: bytes, size: int = SIZE):
        self.data, self.size, self.phrases, self.ends = data, size, [], []
        parse(data, 0, set(), self.phrases, self.ends)
        self.hashes = hashed(self.phrases)
        self.signature = smallest(self.hashes, size)

    def edited(self, keep: int, tail: bytes) -> np.ndarray:
        """Signature of the text's first `keep` bytes followed by `tail`; phrases that end before the cut are kept."""
        n = int(np.searchsorted(self.ends, keep, "right")) if self.ends else 0
        begin = self.ends[n - 1] if n else 0
        more: list[bytes] = []
        parse(self.data[begin:keep] + tail, 0, set(self.phrases[:n]), more, [])
        return smallest(np.concatenate([self.hashes[:n], hashed(more)]), self.size)


def text_of(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of two phrase sets from their signatures."""
    union = np.union1d(a, b)[:size]
    if not len(union):
        return 1.0
    return float(np.intersect1d(np.intersect1d(a, b), union).size / len(union))


def fingerprinted(docs: DataFrame, keep: list[str], text: str = "text", size: int = SIZE) -> DataFrame:
    """`keep` and the column `phrases_fp` of each document."""

    def compute(part: pa.RecordBatch) -> list:
        column = part.column(part.schema.get_field_index(text)).cast(pa.large_binary())
        return [pa.array([text_of(Parsed(x.as_py() or b"", size).signature) for x in column], pa.string())]

    return map_text(docs, text, [T.StructField(free_name(docs, "phrases_fp"), T.StringType())], compute, keep)


def _ranges(docs: DataFrame, count: int) -> list[int]:
    """Up to count - 1 ids that cut the documents in ranges of about equal size."""
    shares = [i / count for i in range(1, count)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 10 * count)).first()[0] if shares else None
    return sorted(set(cuts or []))


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


class _Row:
    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.parsed = Parsed(text.encode())

    def followed_by(self, other: "_Row") -> tuple:
        part = len(self.text) // 4
        kept, tail = self.text[: len(self.text) - part].encode(), other.text[:part].encode()
        own, edited = self.parsed.signature, self.parsed.edited(len(kept), tail)
        digest = hashlib.sha256(kept + tail).hexdigest()
        near = likeness(own, edited), likeness(own, other.parsed.signature)
        return self.doc_id, len(self.text), digest, text_of(own), text_of(edited), *near


def _in_order(batches):
    """Rows of whole ranges, sorted by range, guest and order; a guest only closes the range before its own."""
    names = [x.split()[0] for x in _RESULT.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    before, bucket = None, None
    for batch in batches:
        rows, get = [], batch.schema.get_field_index
        for at, guest, doc, text in zip(*(batch.column(get(c)) for c in ("bucket", "guest", "doc_id", "text")), strict=True):
            at, guest = at.as_py(), guest.as_py()
            if guest and bucket != at:  # the range is closed already: equal ids come as several guests
                continue
            row = _Row(doc.as_py(), text.as_py() or "")
            if before is not None and bucket == at:
                rows.append(before.followed_by(row))
            before, bucket = (None, None) if guest else (row, at)
            if len(rows) == 500:
                yield out(rows)
                rows = []
        yield out(rows)


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each document (doc_id, text), of its edited text, and their likeness; see the module's text."""
    spark = docs.sparkSession
    count = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _ranges(docs, count)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), "left").astype("int32"))

    ordered = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = docs.select("doc_id", "text", ordered.alias("at"))
    dealt = rows.withColumn("bucket", range_of("at"))
    # one row per range: its first id, and the range before it (before the first: the last)
    firsts = sorted(tuple(r) for r in dealt.groupBy("bucket").agg(F.min("at")).collect())
    closing = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    guests = spark.createDataFrame(closing, "at long, bucket int")
    guests = rows.join(F.broadcast(guests), "at").select("doc_id", "text", "at", "bucket")
    every = dealt.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    order = ["bucket", "guest", "at", F.xxhash64(F.coalesce("text", F.lit("")))]
    placed = every.repartition("bucket").sortWithinPartitions(*order)
    return placed.select("bucket", "guest", "doc_id", "text").mapInArrow(_in_order, _RESULT)
