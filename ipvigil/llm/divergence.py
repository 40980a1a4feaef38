"""Audit of how far sources diverge: chi-square-like distances over a vocabulary held in minimal acyclic transducers.

1. Document frequencies of (lang, term) are counted; terms in at least LEAST documents of their lang are kept.
2. The sorted kept terms, lang first, are cut into blocks of about BLOCK, and each block becomes a transducer from a term
   to its lexicographic ordinal. Blocks are rows of a table.
3. The texts are read again. What a task has counted goes to the block that covers the term, and is streamed through its
   transducer there: unknown terms end in no state, the others are counted by ordinal.
4. With the totals of all groups known, each block computes its share of the distances of all pairs of sources, and the
   terms that each source has too many of; ties go by ordinal. Ordinals of reported terms are turned back into terms.

Shares are whole numbers: p = 1 + floor(SCALE (count + 1) / (N + V)), distance f = floor((p - q)^2 / q).

Bounds: a task holds at most HELD counted terms, one block (BLOCK terms, or a 1/BLOCKS of all where that is more) and a
matrix of CELLS counts. To the tasks goes only where blocks start: at most BLOCKS starts and one per range task, LEAD bytes
each. A hot source or lang only has more terms, and these are spread by block. Sources of a lang are compared pair by pair,
as the result has a row for each pair.

Defined results: a null text, lang or source is ''; every row is a document, so rows that repeat an id count on their own;
a group without terms and a lang without kept terms have their pairs (value 0 without kept terms). Other columns are not
read. Terms are told apart by their bytes.
"""

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ipvigil.llm import spans
from ipvigil.llm.frames import cut_lineage
from ipvigil.llm.transducers import Transducer
from ipvigil.operators.scale import top_n_per_key

LEAST = 3
SCALE = 1_000_000_000
TOP = 200
BLOCK, BLOCKS = 1 << 12, 1 << 15
LEAD = 64
HELD = 1 << 19
CELLS = 1 << 20
#: Bytes of one text that are split into terms at once.
CHUNK = 1 << 20

#: A term is a run of ASCII letters and of bytes beyond ASCII; everything else parts terms.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    data = text.translate(_TERMS)
    begin = 0
    while begin < len(data):
        end = len(data) if len(data) - begin <= CHUNK else data.find(b" ", begin + CHUNK)
        end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end


def _of(lang: bytes) -> bytes:
    """What the keys of a lang start with: prefix-free, and in the order of langs."""
    return lang.replace(b"\0", b"\0\xff") + b"\0\1"


def _lang(key: bytes) -> bytes:
    return key[: key.index(b"\0\1")].replace(b"\0\xff", b"\0")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows (text, others) with strings as bytes."""
    for batch in batches:
        for part in spans.sliced(batch, "text"):
            yield from zip(*(c.cast(pa.large_binary()).to_pylist() for c in part.columns), strict=True)


def _groups(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): documents of this task per lang and term."""
    held: dict[bytes, Counter] = {}

    def out() -> pa.RecordBatch:
        keys = [_of(lang) + t for lang, found in held.items() for t in found]
        counts = [n for found in held.values() for n in found.values()]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], ["key", "n"])

    for text, lang in _rows(batches):
        own: set[bytes] = set()
        for terms in _terms(text):
            own.update(terms)
        held.setdefault(lang, Counter()).update(own)
        if sum(map(len, held.values())) >= HELD:
            yield out()
            held = {}
    if held:
        yield out()


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(key): lang and term of every term in at least `least` documents of its lang."""
    found = _groups(docs).select("text", "lang").mapInArrow(_frequencies, "key binary, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key")


def vocabulary(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, lead, before, size, data): transducers of ranges of the sorted keys; `before` keys lie in earlier blocks.

    Keys with the same first LEAD bytes are in one block, so these bytes tell where a key belongs.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def out() -> pa.RecordBatch:
            made = Transducer.build(held)
            arrays = [pa.array([held[0][:LEAD]], pa.binary()), pa.array([len(held)], pa.int64()), pa.array([made.dump()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["lead", "size", "data"])

        for batch in batches:
            for key in batch.column(0).to_pylist():
                if len(held) >= block and key[:LEAD] != held[-1][:LEAD]:
                    yield out()
                    held = []
                held.append(key)
        if held:
            yield out()

    ordered = kept.repartitionByRange(F.substring("key", 1, LEAD)).sortWithinPartitions("key")
    blocks = cut_lineage(ordered.mapInArrow(build, "lead binary, size long, data binary"), "blocks")
    earlier = Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    numbered = blocks.select("lead", "size", F.row_number().over(Window.orderBy("lead")).alias("block"), F.sum("size").over(earlier).alias("before"))
    return numbered.select("block", "lead", F.coalesce("before", F.lit(0)).alias("before")).join(blocks, "lead")


def _counted(leads: list[bytes]) -> Callable:
    """(block, lang, source, term, n) of this task, for terms that a block may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in held.items():
                start = _of(lang)
                own = [bisect_right(leads, (start + t)[:LEAD]) for t in found]
                names = [pa.repeat(pa.scalar(x.decode(), pa.string()), len(own)) for x in (lang, source)]
                arrays = [pa.array(own, pa.int32()), *names, pa.array(found, pa.binary()), pa.array(found.values(), pa.int64())]
                made = pa.RecordBatch.from_arrays(arrays, ["block", "lang", "source", "term", "n"])
                yield made.filter(pc.greater(made.column(0), 0))

        for text, lang, source in _rows(batches):
            found = held.setdefault((lang, source), Counter())
            for terms in _terms(text):
                found.update(terms)
            if sum(map(len, held.values())) >= HELD:
                yield from out()
                held = {}
        yield from out()

    return run


def _with_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows by block, sorted so that a block's transducer comes before its rows."""
    both = rows.withColumn("data", F.lit(None).cast("binary")).unionByName(blocks.select("block", "data"), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", F.col("data").isNull())


def _recounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, lang, source, place, n): counted terms streamed through their block's transducer."""
    found, start, lang = None, b"", None
    known: dict[bytes, int | None] = {}
    for batch in batches:
        names = batch.schema.names
        langs = batch.column(names.index("lang")).dictionary_encode()
        places = []
        rows = zip(batch.column(names.index("term")).to_pylist(), langs.indices.to_pylist(), batch.column(names.index("data")), strict=True)
        langs = langs.dictionary.to_pylist()
        for term, at, data in rows:
            if at is None:  # a block's transducer, before all its rows
                found, known, lang = Transducer.load(data.as_py()), {}, None
                places.append(None)
                continue
            if langs[at] != lang or len(known) > HELD:
                lang, known = langs[at], {}
                start = _of(lang.encode())
            place = known.get(term, -1)
            if place == -1:
                place = known[term] = found.ordinal(start + term)
            places.append(place)
        made = batch.select(["block", "lang", "source", "n"])
        made = made.append_column("place", pa.array(places, pa.int32())).select(["block", "lang", "source", "place", "n"])
        yield made.filter(made.column(3).is_valid())


def recounted(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, lang, source, place, n): occurrences of every kept term per group; `place` is the ordinal in its block.

    What tasks have counted is added up by term first, so a block gets one row per group and term, however frequent.
    """
    leads = [bytes(r.lead) for r in blocks.select("lead").orderBy("lead").collect()]  # bounded, see the module's text
    rows = _groups(docs).select("text", "lang", "source").mapInArrow(_counted(leads), "block int, lang string, source string, term binary, n long")
    rows = rows.groupBy("block", "lang", "source", "term").agg(F.sum("n").alias("n"))
    made = _with_blocks(rows, blocks).select("block", "lang", "source", "term", "n", "data")
    return cut_lineage(made.mapInArrow(_recounted, "block int, lang string, source string, place int, n long"), "recounted")


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / total), exact; as Python's integers where 64 bits might not do."""
    if counts.size and int(counts.max()) >= (1 << 62) // SCALE:
        counts, total = counts.astype(object), total.astype(object)
    return 1 + SCALE * (counts + 1) // total


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


_FOUND = "lang string, s int, other int, value decimal(38,0), block int, place int"


def _pairs_and_top(places: np.ndarray, sources: np.ndarray, n: np.ndarray, totals: np.ndarray, kept: int, most: int) -> tuple[np.ndarray, list[list]]:
    """Sums of distances of all pairs of sources, and per source the (-distance, place) of its first `most` terms."""
    pairs: np.ndarray | int = 0
    top: list[list] = [[] for _ in totals]
    size, whole = totals + kept, np.array([[int(totals.sum()) + kept]])
    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    step = max(1, CELLS // len(totals))
    for a in range(0, len(first), step):  # a matrix of at most CELLS counts: terms by sources
        own = slice(first[a], first[a + step] if a + step < len(first) else len(places))
        shown = places[first[a : a + step]]
        counts = np.zeros((len(shown), len(totals)), np.int64)
        counts[np.searchsorted(shown, places[own]), sources[own]] = n[own]
        p = shares(counts, size[None, :])
        kind = object if p.dtype == object else np.int64
        pairs = pairs + np.array([distance(p[:, [s]], p).sum(axis=0, dtype=kind) for s in range(len(totals))]).astype(object)
        q = shares(counts.sum(axis=1, keepdims=True), whole)
        f = distance(p, q)
        for s in range(len(totals)):
            some = np.flatnonzero((counts[:, s] > 0) & (p[:, s] > q[:, 0]))
            top[s] = sorted([*top[s], *zip((-f[some, s]).tolist(), shown[some].tolist(), strict=True)])[:most]
    return pairs, top


def _compared(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sums of distances per pair of sources, and the first `most` terms per source, of every block and lang.

    Rows by block and lang: first the sources (s, N, V; place null), then the counts by place.
    """
    names = [x.split()[0] for x in _FOUND.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int32(), pa.int32()]

    def out(block: int, lang: str, table: pa.Table) -> pa.RecordBatch:
        heads = table.filter(pc.is_null(table["place"])).sort_by("s")
        rows = table.filter(pc.is_valid(table["place"]))
        place, s, n = (rows[c].to_numpy() for c in ("place", "s", "n"))
        pairs, top = _pairs_and_top(place, s, n, heads["n"].to_numpy(), heads["v"][0].as_py(), most)
        made = [(lang, i, j, Decimal(int(v)), None, None) for i, row in enumerate(pairs) for j, v in enumerate(row) if i != j]
        made += [(lang, i, None, Decimal(-v), block, at) for i, best in enumerate(top) for v, at in best]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made) if made else [()] * 6, kinds, strict=True)], names)

    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not len(batch):
            continue
        block, lang = batch.column(0).to_numpy(), batch.column(1).dictionary_encode()
        code, langs = lang.indices.to_numpy(), lang.dictionary.to_pylist()
        cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (code[1:] != code[:-1])]).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
            own = int(block[a]), langs[code[a]]
            if own != key and held:
                yield out(*key, pa.Table.from_batches(held))
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield out(*key, pa.Table.from_batches(held))


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of reported terms turned back into terms by their block's transducer."""
    names = ["lang", "source", "item", "value", "rank"]
    found = None
    for batch in batches:
        rows = []
        for _, lang, source, value, rank, place, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if data is not None:
                found = Transducer.load(data)
            else:
                term = found.key(place)[len(_of(lang.encode())) :]
                rows.append((lang, source, term.decode("utf-8", "replace"), value, rank))
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * 5, kinds, strict=True)], names)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the other sources, and the terms that stand out (`top` at most)."""
    groups = cut_lineage(_groups(docs).select("lang", "source").distinct(), "groups")
    kept = cut_lineage(kept_terms(docs, least), "kept-terms")
    blocks = cut_lineage(vocabulary(kept, max(block, -(-kept.count() // BLOCKS))), "vocabulary")
    counts = recounted(docs, blocks)

    sizes = counts.select("lang", "block", "place").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    place_of = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    numbered = groups.withColumn("s", place_of)
    known = numbered.join(totals, ["lang", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    known = cut_lineage(known.join(sizes, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0))), "sources")
    heads = counts.select("block", "lang").distinct().join(known.select("lang", "s", "n", "v"), "lang")
    rows = counts.join(known.select("lang", "source", "s"), ["lang", "source"]).select("block", "lang", "s", "place", "n")
    rows = rows.withColumn("v", F.lit(None).cast("long")).unionByName(heads.withColumn("place", F.lit(None).cast("int")))
    rows = rows.repartition("block").sortWithinPartitions("block", "lang", F.col("place").asc_nulls_first())
    rows = rows.select("block", "lang", "s", "place", "n", "v")
    found = cut_lineage(rows.mapInArrow(lambda x: _compared(x, top), _FOUND), "compared")

    summed = found.filter("other IS NOT NULL").groupBy("lang", "s", "other").agg(F.sum("value").cast("long").alias("value"))
    named = known.select("lang", "source", "s")
    others = known.select("lang", F.col("source").alias("item"), F.col("s").alias("other"))
    pairs = named.join(others, "lang").filter("s <> other")
    pairs = pairs.join(summed, ["lang", "s", "other"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    per_group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(per_group))

    standing = found.filter("other IS NULL").join(named, ["lang", "s"])
    standing = standing.select(F.struct("lang", "source").alias("of"), F.col("value").cast("long").alias("value"), "block", "place")
    standing = standing.withColumn("ordinal", F.struct("block", "place"))
    best = top_n_per_key(standing, "of", [F.desc("value"), F.col("ordinal")], top, "ordinal")
    best = best.select("block", "of.lang", "of.source", "value", "rank", "place")
    spelled = _with_blocks(best, blocks.join(best.select("block").distinct(), "block", "left_semi"))
    spelled = spelled.select("block", "lang", "source", "value", "rank", "place", "data")
    terms = spelled.mapInArrow(_spelled, "lang string, source string, item string, value long, rank int")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
