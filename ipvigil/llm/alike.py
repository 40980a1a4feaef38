"""Near duplicates by exact Jaccard similarity: MinHash bands propose pairs, the five-word shingles of both confirm them.

Words are lower-cased (ASCII) and parted by white space, as in `simhash`; a text of fewer than five words is one shingle.
Of 32 bands of four minima, two texts of similarity 0.8 share one in all but 5 of 10^8 cases; three differing bits of a
SimHash do not reach that far, as 0.8 costs about ten. Links join the components that are known already (those of the
fingerprints): a band whose texts are all in one component is settled. In each of the others the text that shares most bands
with others (in a group of near copies, the one they were made from) meets all those outside its component and then leaves,
STARS times; pairs that are still apart after that are compared one by one.

Nothing is capped: a band of many texts that are all unlike costs its pairs. Such a band is cut in parts of about PART
texts, and every two parts meet in a task of their own, which gets each text's shingles once, compares PART^2 pairs at most
and returns the links of a forest. Hot bands meet map-side minima and joins of two tables, which adaptive execution splits.
Shingles are told apart by 64-bit hashes, and so are sets of shingles.

Defined results: a null or empty text has no shingles and is like no other; equal sets have similarity 1.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ipvigil.llm import spans
from ipvigil.llm.components import components
from ipvigil.llm.frames import cut_lineage, map_text
from ipvigil.llm.licences import shingles

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
STARS = 3
PART = 1 << 9

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.random.Generator(np.random.PCG64(32)).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: What `sketches` returns.
FIELDS = [T.StructField("size", T.IntegerType()), T.StructField("sig", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]


def distinct_shingles(column) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    data, bounds = spans.flat(column)
    data = _LOWER[data]
    start, end, first = spans.words(data, bounds, spans.WHITE)
    values, at = shingles(spans.word_hashes(data, start, end, spans.WHITE), first, SHINGLE)
    return [np.unique(values[a:b]) for a, b in zip(at, at[1:], strict=False)]


def sketches(column) -> list[pa.Array]:
    """Number of shingles, a hash of their set and the band keys of every text."""
    sets = distinct_shingles(column)
    size = np.array([len(s) for s in sets], np.int64)
    own = np.flatnonzero(size)
    sig, keys = np.zeros(len(sets), np.uint64), np.zeros((len(own), BANDS), np.uint64)
    if len(own):
        values, cut = np.concatenate([sets[i] for i in own]), np.concatenate([[0], np.cumsum(size[own])[:-1]])
        sig[own] = spans.mixed(np.add.reduceat(spans.mixed(values), cut) + size[own].astype(np.uint64))
        for band, factors in enumerate(_FACTORS):
            key = np.full(len(own), band, np.uint64)
            for factor in factors:
                key = spans.mixed(key ^ np.minimum.reduceat(values * factor, cut))
            keys[:, band] = key
    offsets = pa.array(np.concatenate([[0], np.cumsum((size > 0) * BANDS)]), pa.int32())
    bands = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))
    return [pa.array(size, pa.int32()), pa.array(sig.view(np.int64)), bands]


def _sets(docs: DataFrame, text: str) -> DataFrame:
    def compute(part: pa.RecordBatch) -> list:
        found = distinct_shingles(part.column(part.schema.get_field_index(text)))
        return [pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))]

    return map_text(docs, text, [T.StructField("shingles", T.ArrayType(T.LongType()))], compute, ["sig"])


def _sizes_allow(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) / F.greatest(a, b) >= similarity


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): roots of the pairs (a, a_sig, b, b_sig) that are similar enough."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("sig").alias(f"{side}_sig"), F.col("shingles").alias(f"{side}_set")), f"{side}_sig")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.filter(shared / (F.size("a_set") + F.size("b_set") - shared) >= similarity).select("a", "b")


def cells(rows: DataFrame, most: int | None = None) -> DataFrame:
    """`rows` (band, n, sig, ...) with (i, j, part): every two texts of a band meet in one cell of two of its parts."""
    parts = F.ceil(F.col("n") / F.lit(most or PART)).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts").cast("long")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("parts", "other", "n")


def cell_links(part: np.ndarray, root: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between roots of the texts of a cell that are similar enough, one per merge of two components.

    Texts of one part are compared in their part's own cell only.
    """
    up = {int(r): int(r) for r in root}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    size = np.array([len(x) for x in sets])
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    cut = np.concatenate([[0], np.cumsum(size)[:-1]])
    low, high = part.min(), part.max()
    links = []
    for x in np.flatnonzero(part == low).tolist():
        top = np.array([find(int(r)) for r in root]) if x == 0 or links else root
        apart = (top != top[x]) & (size >= similarity * size[x]) & (size * similarity <= size[x])
        apart &= part == high if low < high else np.arange(len(part)) > x
        if not apart.any():
            continue
        own = np.zeros(place.max() + 1, np.int64)
        own[place[cut[x] : cut[x] + size[x]]] = 1
        shared = np.add.reduceat(own[place], cut)
        for y in np.flatnonzero(apart & (shared >= similarity * (size + size[x] - shared))).tolist():
            a, b = find(int(root[x])), find(int(root[y]))
            if a != b and shared[y] / (size[x] + size[y] - shared[y]) >= similarity:
                up[max(a, b)] = min(a, b)
                links.append((int(root[x]), int(root[y])))
    return links


def _cell_by_cell(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between roots from rows (band, i, j, part, root, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            part, root, sets = zip(*held, strict=True)
            found = cell_links(np.array(part), np.array(root), list(sets), similarity)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            for *own, part, root, shingles in zip(*columns, strict=True):
                if own != key and held:
                    yield out()
                    held = []
                key = own
                held.append((part, root, np.asarray(shingles)))
        if held:
            yield out()

    rows = rows.select("band", "i", "j", "part", "root", "shingles")
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a long, b long")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after links between roots."""
    more = components(links)
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    moved = moved.select("node", F.coalesce("to", "root").alias("root"))
    return cut_lineage(moved.unionByName(more.join(roots.select("node"), "node", "left_anti")), "alike-roots")


def widened(roots: DataFrame, rows: DataFrame, docs: DataFrame, keys: list[str], similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """`roots` (node, root) of fingerprints, joined further by every pair of texts that is similar enough.

    `rows` has the fingerprint `fp`, the `keys` of its document and its sketch; `docs` has `keys` and the text.
    """
    members = cut_lineage(rows.filter("size > 0").dropDuplicates(["fp", "sig"]).select("fp", "sig", "size", "bands", *keys), "alike-members")
    every = members.select(F.explode("bands").alias("band"), "fp", "sig", "size")
    shared = cut_lineage(every.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "alike-shared")
    buckets = cut_lineage(every.join(shared, "band"), "alike-shared-buckets")
    degree = cut_lineage(buckets.groupBy("fp", "sig").agg(F.sum("n").alias("degree")), "alike-degrees")
    buckets, sets = buckets.drop("n").join(degree, ["fp", "sig"]), None
    for step in range(STARS + 1):
        rooted = buckets.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        lead = F.max(F.struct("degree", "fp", "sig", "size", "root")).alias("lead")
        apart = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), lead).filter("low <> high")
        apart = cut_lineage(apart.select("band", "n", "lead"), "alike-bands")
        rooted = cut_lineage(rooted.join(apart, "band"), "alike-buckets")
        if rooted.isEmpty():
            break
        if sets is None:
            homes = members.join(rooted.select("sig").distinct(), "sig").dropDuplicates(["sig"]).select("sig", *keys)
            found = _sets(docs.select(*keys, text).join(homes, keys), text)
            sets = cut_lineage(found.dropDuplicates(["sig"]), "alike-sets")
        if step < STARS:
            pairs = rooted.select(F.col("lead.root").alias("a"), F.col("lead.sig").alias("a_sig"), F.col("lead.size").alias("a_size"),
                                  F.col("root").alias("b"), F.col("sig").alias("b_sig"), F.col("size").alias("b_size"))
            pairs = pairs.filter((F.col("a") != F.col("b")) & _sizes_allow("a_size", "b_size", similarity))
            links = _confirmed(pairs.select("a", "a_sig", "b", "b_sig").distinct(), sets, similarity)
        else:
            links = _cell_by_cell(cells(rooted.select("band", "n", "sig", "root").join(sets, "sig")), similarity)
        roots = _merged(roots, links)
        gone = (F.col("fp") == F.col("lead.fp")) & (F.col("sig") == F.col("lead.sig"))
        buckets = rooted.filter(~gone).select("fp", "sig", "band", "size", "degree")
    return roots
