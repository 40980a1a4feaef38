"""SimHash near-dedup: 64-bit fingerprints, linked at few differing bits by a hierarchical index in Gray order.

Only distinct fingerprints are compared, so copies cost one row. Up to three differing bits leave at least one of four
16-bit blocks alike, and of the other 48 bits at least one of four 12-bit blocks: fingerprints that share such a pair
of blocks meet in one bucket, one of 16 x 2^28 (the index's uppermost nodes, whose masked pattern is shared exactly).
Inside a bucket fingerprints stand in Gray-code order, neighbours differing in few bits; every 16 of them form a node
with the bits they all share as masked pattern, every 16 nodes a node above, and so on. Two nodes whose shared bits
already differ in too many places are left out with all below them, and so are nodes that are wholly in one component
already. A bucket yields the links of a spanning forest, never all pairs, and `components` joins the forests.

A bucket of more than MOST fingerprints (texts that share most of their boilerplate) is split before it is dealt: the bits
that are not yet alike are parted in four blocks again, one of which three differing bits leave alike. After SPLITS such
steps a bucket has 44 bits in common, so at most 2^20 fingerprints.

Defined results: a null or empty text has fingerprint zero, which is linked like any other; a null doc_id comes last
when the smallest of a component is sought; rows that repeat a doc_id and its text are the same document.

`one_per_group` takes a similarity, too: then texts whose exact Jaccard similarity reaches it are linked as well (`alike`).
"""

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from ipvigil.llm import alike
from ipvigil.llm.components import components
from ipvigil.llm.frames import cut_lineage, free_name, map_text

SHINGLE = 3
SEED = 42
DISTANCE = 3
FANOUT = 16
MOST, SPLITS = 1 << 11, 2
#: Shingles whose bits are counted at once, and node pairs compared at once.
BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of each bit over the XXH64 hashes of all word shingles (ASCII lower case, repeats count)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxh64_intdigest(joined, SEED)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(length) - 1
    start = end - length + 1
    first, last = start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        spans = zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(first)).view(np.uint64)[0])


def fingerprinted(docs: DataFrame, keep: list[str], name: str = "fp", text: str = "text", sketched: bool = False) -> DataFrame:
    """`keep` and the fingerprint of each whole text as a signed long; if `sketched`, what `alike` compares, too."""

    def compute(part: pa.RecordBatch) -> list:
        column = part.column(part.schema.get_field_index(text)).cast(pa.large_binary())
        found = [fingerprint(x.as_py() or b"") for x in column]
        more = alike.sketches(part.column(part.schema.get_field_index(text))) if sketched else []
        return [pa.array(np.array(found, np.uint64).view(np.int64)), *more]

    return map_text(docs, text, [T.StructField(name, T.LongType()), *(alike.FIELDS if sketched else [])], compute, keep)


def _parted(value: Column, width: int, low: int, size: int) -> tuple[Column, Column]:
    """`size` bits of a value of `width` bits from place `low` on, and the other bits pushed together."""
    block = F.shiftrightunsigned(value, low).bitwiseAND((1 << size) - 1)
    below = value.bitwiseAND((1 << low) - 1) if low else F.lit(0).cast("long")
    above = F.shiftleft(F.shiftrightunsigned(value, low + size), low) if low + size < width else F.lit(0).cast("long")
    return block, above.bitwiseOR(below)


def _quarters(width: int) -> list[tuple[int, int]]:
    """Places and sizes of four blocks of a value of `width` bits."""
    cuts = [width * i // 4 for i in range(5)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def buckets(fp: str = "fp") -> Column:
    """The 16 buckets of a fingerprint: a key of its table, one block of 16 bits and one of the other 48 bits' blocks of 12;
    and the 36 bits that are left."""
    out = []
    for i, (low, size) in enumerate(_quarters(64)):
        block, rest = _parted(F.col(fp), 64, low, size)
        for j, (inner_low, inner_size) in enumerate(_quarters(48)):
            inner, left = _parted(rest, 48, inner_low, inner_size)
            key = F.lit((4 * i + j) << 28).cast("long").bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(inner)
            out.append(F.struct(key.alias("bucket"), left.alias("rest")))
    return F.array(*out)


def dealt(codes: DataFrame, most: int = MOST) -> DataFrame:
    """(bucket, fp): every two fingerprints that differ in at most DISTANCE bits share a bucket; large ones are split."""
    rows, width, done = codes.select("fp", F.inline(buckets())), 36, []
    for _ in range(SPLITS):
        counted = rows.groupBy("bucket").agg(F.count("*").alias("n"))
        large = cut_lineage(counted.filter(F.col("n") > most).select("bucket"), "simhash-large")
        if large.isEmpty():
            break
        done.append(rows.join(large, "bucket", "left_anti").select("bucket", "fp"))
        parts = []
        for j, (low, size) in enumerate(_quarters(width)):
            block, rest = _parted(F.col("rest"), width, low, size)
            parts.append(F.struct(F.xxhash64("bucket", F.lit(j), block).alias("bucket"), rest.alias("rest")))
        hot = rows.join(large, "bucket", "left_semi").select("fp", F.inline(F.array(*parts)))
        # blocks differ by a bit in size; the narrower rest is read as if it had a zero in front
        width = width - min(size for _, size in _quarters(width))
        rows = cut_lineage(hot.select("fp", "bucket", "rest"), "simhash-split")
    done.append(rows.select("bucket", "fp"))
    return reduce(DataFrame.unionByName, done)


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Place of each code in the Gray sequence."""
    rank = code.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class _Forest:
    """Union-find over one bucket that remembers the links that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def flatten(self) -> np.ndarray:
        while True:
            jumped = self.up[self.up]
            if (jumped == self.up).all():
                return self.up
            self.up = jumped

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        top = self.flatten()
        apart = top[left] != top[right]
        for i, j in zip(left[apart].tolist(), right[apart].tolist(), strict=True):
            a, b = self.find(i), self.find(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.links.append((i, j))


def forest(codes: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (pairs of codes) of a spanning forest of the distinct codes that differ in at most `distance` bits."""
    codes = codes[np.argsort(gray_rank(codes), kind="stable")]
    trees = _Forest(len(codes))
    near = np.flatnonzero(np.bitwise_count(codes[1:] ^ codes[:-1]) <= distance)
    trees.join(near, near + 1)
    levels = [(codes, np.full(len(codes), np.uint64(2**64 - 1)))]
    while len(levels[-1][0]) > 1:
        pattern, mask = levels[-1]
        cut = np.arange(0, len(pattern), FANOUT)
        alike = np.bitwise_and.reduceat(pattern, cut) | ~np.bitwise_or.reduceat(pattern, cut)
        alike &= np.bitwise_and.reduceat(mask, cut)
        levels.append((pattern[cut] & alike, alike))
    waiting = [(len(levels) - 1, np.array([0]), np.array([0]))]
    while waiting:
        level, left, right = waiting.pop()
        if len(left) > BLOCK:
            waiting += [(level, left[at : at + BLOCK], right[at : at + BLOCK]) for at in range(0, len(left), BLOCK)]
            continue
        pattern, mask = levels[level]
        apart = (pattern[left] ^ pattern[right]) & mask[left] & mask[right]
        keep = np.bitwise_count(apart) <= distance
        left, right = left[keep], right[keep]
        if not level:
            other = left < right
            trees.join(left[other], right[other])
            continue
        top = trees.flatten()
        size = FANOUT**level
        cut = np.arange(0, len(top), size)
        low, high = np.minimum.reduceat(top, cut), np.maximum.reduceat(top, cut)
        known = (low[left] == high[left]) & (low[right] == high[right]) & (low[left] == low[right])
        left, right = left[~known], right[~known]
        below = len(levels[level - 1][0])
        step = np.arange(FANOUT)
        a = np.repeat(left * FANOUT, FANOUT * FANOUT) + np.tile(np.repeat(step, FANOUT), len(left))
        b = np.repeat(right * FANOUT, FANOUT * FANOUT) + np.tile(step, FANOUT * len(left))
        real = (a <= b) & (b < below)
        if real.any():
            waiting.append((level - 1, a[real], b[real]))
    pairs = np.array(trees.links, np.int64).reshape(-1, 2)
    return codes[pairs[:, 0]], codes[pairs[:, 1]]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each bucket, from rows sorted by bucket; a bucket may reach over several batches."""

    def links(key: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(cut, len(key)))
        two = cut[size == 2]
        near = two[np.bitwise_count(code[two] ^ code[two + 1]) <= DISTANCE]
        a, b = [code[near]], [code[near + 1]]
        for start, n in zip(cut[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            left, right = forest(code[start : start + n])
            a.append(left)
            b.append(right)
        arrays = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
        return pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        key, code = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
        last = int(np.searchsorted(key, key[-1]))
        if last or (held and held[-1][0][-1] != key[0]):
            parts = [*held, (key[:last], code[:last])]
            held = []
            yield links(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        held.append((key[last:], code[last:]))
    if held:
        yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))


def near_links(codes: DataFrame) -> DataFrame:
    """(a, b): links of distinct fingerprints (`fp`) whose components are those of all links."""
    sent = dealt(codes).repartition("bucket").sortWithinPartitions("bucket")
    return sent.mapInArrow(_bucket_links, "a long, b long").distinct()


def grouped(rows: DataFrame, order: Column, widen: Callable[[DataFrame], DataFrame] = lambda roots: roots) -> DataFrame:
    """(fp, first): for every fingerprint the smallest `order` in its component. `rows` is read several times.

    `widen` may join components (node, root) further.
    """
    classes = cut_lineage(rows.groupBy("fp").agg(F.min(order).alias("first")), "simhash-classes")
    roots = widen(components(near_links(classes.select("fp")))).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(best, "root").select("fp", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    rows = cut_lineage(fingerprinted(docs, ["doc_id"]), "simhash")
    groups = grouped(rows, F.col("doc_id")).withColumnRenamed("first", "component_id")
    return rows.join(groups, "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, similarity: float | None = None) -> DataFrame:
    """The document with the smallest doc_id of every component, all columns as they were.

    With a `similarity`, texts of at least that Jaccard similarity of five-word shingles are linked, too.
    """
    doc, twin = free_name(docs, "simhash_doc"), free_name(docs, "simhash_twin")
    identity = {
        doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)),
        twin: F.xxhash64(F.coalesce("text", F.lit(""))),
    }
    marked = docs.withColumns(identity)
    rows = cut_lineage(fingerprinted(marked, [doc, twin], text="text", sketched=similarity is not None), "simhash")
    order = F.struct(F.col(doc), F.col(twin))
    if similarity is None:
        groups = grouped(rows, order)
    else:
        groups = grouped(rows, order, lambda roots: alike.widened(roots, rows, marked, [doc, twin], similarity))
    best = groups.select(f"first.{doc}", f"first.{twin}").distinct()
    return marked.join(best, [doc, twin], "left_semi").dropDuplicates([doc, twin]).select(*docs.columns)
