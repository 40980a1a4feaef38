"""Repeated windows of tokens across documents: what byte-wise and word-wise substring dedup have in common.

A window is `window` consecutive tokens of one document. The smallest of the hashes of its `gram`-token runs (all ties)
is an anchor, so equal windows hold equal anchors at equal places. Three passes narrow down where windows repeat:

1. Every anchor goes to the task of its gram's hash, with a hash of all tokens around it that a window could take in
   (its context). Anchors that are alone are done. Equal contexts are repeats, all windows in them, but for the first.
2. Where one gram has several contexts, their first occurrences meet with their tokens, and a resolver finds the
   windows that they share.
3. The spans found go to their documents.

A document is a doc_id and a text: rows that repeat both are one document; rows with an id (or none) in common and other
texts are documents of their own, in the order of a hash of the text (`twin`).

Hot content. Copies of a context are reduced to one per block of rows before anything is shuffled. A gram that has very
many different contexts (say, at the edge of a passage that a third of all documents share) is looked for in a sample;
it only decides the way: such anchors are replaced by their single windows, which are told apart by their own hashes,
so they spread over all tasks, and copies of them again combine before the shuffle. Texts travel compressed.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ipvigil.llm import spans
from ipvigil.llm.frames import cut_lineage

#: Anchors that are combined at once before the shuffle, and bytes handled at once.
COMBINED = 1 << 19
BLOCK = 1 << 17
#: One document in SAMPLED looks for hot grams; HOT contexts of one gram are too many for a task.
SAMPLED = 128
HOT = 1 << 18
#: Hot grams that are sent to the tasks, the hottest first; the others take the ordinary way.
HOT_GRAMS = 1 << 16


@dataclass(frozen=True)
class Kind:
    """Tokens and windows. `within`: a window may repeat within its own document."""

    words: bool
    window: int
    gram: int
    within: bool

    @property
    def reach(self) -> int:
        return self.window - self.gram


#: What documents are told apart and ordered by.
IDENTITY = ["doc", "twin"]


def identity(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """The id, where a null one comes first, and a hash of the text."""
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    return [doc.alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("twin")]


def _apart(rows: dict[str, np.ndarray], a: np.ndarray | slice, b: np.ndarray | slice) -> np.ndarray:
    """Whether rows lie in different documents."""
    return (rows["doc"][a] != rows["doc"][b]) | (rows["twin"][a] != rows["twin"][b])


def _found(token: np.ndarray, bounds: np.ndarray, kind: Kind) -> dict[str, np.ndarray]:
    """Anchors of the documents in a row of tokens: key, ctx, place (in the row), left and right (tokens of context)."""
    gram = spans.mixed(spans.grams(token, kind.gram))
    place = spans.anchors(gram, kind.reach + 1)
    owner = np.searchsorted(bounds, place, "right") - 1
    low = np.maximum(place - kind.reach, bounds[owner])
    high = np.minimum(place + kind.gram + kind.reach, bounds[owner + 1])
    whole = (place + kind.gram <= bounds[owner + 1]) & (high - low >= kind.window)
    place, owner, low, high = place[whole], owner[whole], low[whole], high[whole]
    window = spans.grams(token, kind.window)
    left, right = place - low, high - place - kind.gram
    context = window[low] * spans._FACTORS[1] + window[high - kind.window] if len(place) else np.zeros(0, np.uint64)
    context = spans.mixed(context + left.astype(np.uint64) * spans._FACTORS[2] + right.astype(np.uint64))
    return {"key": gram[place], "ctx": context, "place": place, "left": left, "right": right, "owner": owner}


def _windows(found: dict[str, np.ndarray], token: np.ndarray, kind: Kind) -> dict[str, np.ndarray]:
    """Anchors replaced by each window around them, in the same form: a window is its own key and context."""
    count = found["left"] + kind.gram + found["right"] - kind.window + 1
    of = np.repeat(np.arange(len(count)), count)
    start = (found["place"] - found["left"])[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    own = spans.mixed(spans.grams(token, kind.window)[start] + np.uint64(1))
    none = np.zeros(len(of), np.int64)
    return {"key": own, "ctx": spans.mixed(own ^ found["key"][of]), "place": start, "left": none, "right": none + kind.reach, "owner": found["owner"][of]}


def _tokens(part: pa.RecordBatch, kind: Kind) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, slice]]:
    """Rows of tokens of bounded size, with document bounds, ids, and the places that count (others are margin)."""
    data, bounds = spans.flat(part.column(2))
    if kind.words:
        start, end, first = spans.words(data, bounds, spans.WHITE)
        token = spans.word_hashes(data, start, end, spans.WHITE)
        yield token, first, np.int64(0), slice(0, len(token))
        return
    margin = 2 * kind.window
    for begin in range(0, len(data), BLOCK):
        low, high = max(begin - margin, 0), min(begin + BLOCK + margin, len(data))
        yield spans.BYTE_VALUE[data[low:high]], bounds - low, np.int64(low), slice(begin - low, min(begin + BLOCK, len(data)) - low)


def _combined(rows: dict[str, np.ndarray], kind: Kind) -> dict[str, np.ndarray]:
    """Mark rows whose key and context stand earlier among `rows` as known, and deal them out evenly."""
    both = rows["key"] ^ (rows["ctx"] * spans._FACTORS[4])
    order = np.sort(both)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    known = np.zeros(len(both), bool)
    if len(twice):
        at = np.minimum(np.searchsorted(twice, both), len(twice) - 1)
        some = np.flatnonzero(twice[at] == both)
        some = some[np.lexsort((rows["at"][some], rows["twin"][some], rows["doc"][some], both[some]))]
        group = np.r_[True, both[some][1:] != both[some][:-1]]
        first = np.flatnonzero(group)[np.cumsum(group) - 1]
        later = _apart(rows, some, some[first])
        if kind.within:
            later |= rows["at"][some] > rows["at"][some[first]]
        later &= (rows["key"][some] == rows["key"][some[first]]) & (rows["ctx"][some] == rows["ctx"][some[first]])
        known[some[later]] = True
    key = np.where(known, spans.mixed((rows["doc"] ^ rows["twin"]).view(np.uint64) * spans._FACTORS[5] + rows["at"].astype(np.uint64)), rows["key"])
    return rows | {"key": key, "known": known}


_ANCHOR = "key long, ctx long, doc long, twin long, at int, left int, right int, known boolean"
_ANCHOR_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]


def _batch(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _ANCHOR.split(", ")]
    arrays = [rows[n].view(np.int64) if rows[n].dtype == np.uint64 else rows[n] for n in names]
    return pa.RecordBatch.from_arrays([pa.array(a, t, safe=False) for a, t in zip(arrays, _ANCHOR_TYPES, strict=True)], names)


def anchors(docs: DataFrame, kind: Kind, hot: np.ndarray) -> DataFrame:
    """Anchors of all documents (doc, twin, text), copies in a block of rows marked as known; `hot` grams by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for batch in batches:
            for part in spans.sliced(batch, "text"):
                ids, twins = np.asarray(part.column(0)), np.asarray(part.column(1))
                for token, bounds, _, counts in _tokens(part, kind):
                    found = _found(token, np.clip(bounds, 0, len(token)), kind)
                    # cut at a block's edge, a document seems to end there; its anchors there are margin
                    inside = (found["place"] >= counts.start) & (found["place"] < counts.stop)
                    found = {k: v[inside] for k, v in found.items()}
                    if len(hot) and len(found["key"]):
                        at = np.minimum(np.searchsorted(hot, found["key"]), len(hot) - 1)
                        is_hot = hot[at] == found["key"]
                        single = _windows({k: v[is_hot] for k, v in found.items()}, token, kind)
                        found = {k: np.concatenate([v[~is_hot], single[k]]) for k, v in found.items()}
                    own = found["owner"]
                    place = {"doc": ids[own], "twin": twins[own], "at": found["place"] - bounds[own]}
                    held.append({k: found[k] for k in ("key", "ctx", "left", "right")} | place)
                    size += len(own)
                    if size >= COMBINED:
                        yield _batch(_combined({k: np.concatenate([h[k] for h in held]) for k in held[0]}, kind))
                        held, size = [], 0
        if size:
            yield _batch(_combined({k: np.concatenate([h[k] for h in held]) for k in held[0]}, kind))

    return docs.mapInArrow(run, _ANCHOR)


def hot_grams(docs: DataFrame, kind: Kind, hot: int = HOT, sampled: int = SAMPLED) -> np.ndarray:
    """Grams with about `hot` contexts or more, by a sample of documents; at most HOT_GRAMS, the hottest."""
    some = docs.filter(F.pmod(F.xxhash64(F.lit("hot"), "doc"), F.lit(sampled)) == 0)
    count = anchors(some, kind, np.zeros(0, np.uint64)).filter("NOT known").groupBy("key").agg(F.count("*").alias("n"))
    rows = count.filter(F.col("n") >= max(hot // sampled, 2)).orderBy(F.desc("n"), "key").limit(HOT_GRAMS).collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64))


_DECIDED = "doc long, twin long, key long, at int, left int, right int, open boolean"


def _decide(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by key, context, document and place: repeats (open = false), and contexts that need a closer look."""

    def decided(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        key, ctx, at = rows["key"], rows["ctx"], rows["at"]
        new_key = np.r_[True, key[1:] != key[:-1]]
        new = new_key | np.r_[True, ctx[1:] != ctx[:-1]]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = _apart(rows, slice(None), first)
        if kind.within:
            later |= at > at[first]
        group = np.cumsum(new_key) - 1
        several = np.bincount(group, new)[group] > 1
        keep = later | several | rows["known"]
        names = ["doc", "twin", "key", "at", "left", "right"]
        arrays = [pa.array(rows[n][keep]) for n in names]
        return pa.RecordBatch.from_arrays([*arrays, pa.array((several & ~later & ~rows["known"])[keep])], [*names, "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "key"):
            yield decided(rows)

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of rows sorted by `key`, cut so that no key is divided."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        values = np.asarray(batch.column(batch.schema.get_field_index(key)))
        last = int(np.searchsorted(values, values[-1]))
        before = np.asarray(held[-1].column(held[-1].schema.get_field_index(key)))[-1] if held else None
        if last or (held and before != values[0]):
            yield _columns([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield _columns(held)


def _columns(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(parts)
    return {n: table[n].to_numpy() for n in table.column_names if not pa.types.is_binary(table.schema.field(n).type)} | {
        n: table[n].combine_chunks() for n in table.column_names if pa.types.is_binary(table.schema.field(n).type)
    }


def packed(docs: DataFrame) -> DataFrame:
    """(doc, twin, doc_id, text as a zstandard frame, null as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for batch in batches:
            for part in spans.sliced(batch, "text"):
                text = part.column(3).cast(pa.large_binary())
                blob = pa.array([press.compress(x.as_py() or b"") for x in text], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], blob], ["doc", "twin", "doc_id", "blob"])

    return docs.select("doc", "twin", "doc_id", "text").mapInArrow(run, "doc long, twin long, doc_id long, blob binary")


def unpacked(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


_CONTEXT = "key long, doc long, twin long, at int, context binary"


def _contexts(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The tokens around each open anchor; `at` is then the place of the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, twins, places, texts = [], [], [], [], []
            for doc, twin, _, blob, found in zip(*(batch.column(i) for i in range(5)), strict=True):
                if not found.is_valid or not len(found):
                    continue
                data = unpacked(blob.as_py())
                tokens = data.split() if kind.words else data
                for row in found.as_py():
                    low, high = row["at"] - row["left"], row["at"] + kind.gram + row["right"]
                    keys.append(row["key"])
                    docs.append(doc.as_py())
                    twins.append(twin.as_py())
                    places.append(low)
                    texts.append(b" ".join(tokens[low:high]) if kind.words else tokens[low:high])
            arrays = [*(pa.array(x, pa.int64()) for x in (keys, docs, twins)), pa.array(places, pa.int32()), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "doc", "twin", "at", "context"])

    return run


Resolver = Callable[[dict[str, np.ndarray]], tuple[list | np.ndarray, ...]]


def repeated(docs: DataFrame, kind: Kind, resolve: Resolver, hot: int = HOT, sampled: int = SAMPLED) -> tuple[DataFrame, DataFrame]:
    """Packed documents, and (doc, twin, begins, ends): the token spans of each covered by windows that also start earlier.

    `resolve` gets whole groups of contexts (key, doc, twin, at, context; sorted by key, document and place) and returns
    the documents (doc, twin), first and end tokens of the spans that repeat within a group.
    """
    rows = docs.select(*identity(), F.col("doc_id").cast("long").alias("doc_id"), "text")
    grams = hot_grams(rows.select("doc", "twin", "text"), kind, hot, sampled)
    found = anchors(rows.select("doc", "twin", "text"), kind, grams).repartition("key")
    found = found.sortWithinPartitions("key", "ctx", "doc", "twin", "at")
    decided = cut_lineage(found.mapInArrow(_decide(kind), _DECIDED), "repeats")
    near = decided.filter("open").groupBy(*IDENTITY).agg(F.collect_list(F.struct("key", "at", "left", "right")).alias("anchors"))
    texts = packed(rows)

    def resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        for group in whole_groups(batches, "key"):
            arrays = [pa.array(x, t) for x, t in zip(resolve(group), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "twin", "first", "end"])

    # with the same columns as in `per_document`, so that both joins share one shuffle of the texts
    context = texts.join(near, IDENTITY, "left").select("doc", "twin", "doc_id", "blob", "anchors").mapInArrow(_contexts(kind), _CONTEXT)
    context = context.repartition("key").sortWithinPartitions("key", "doc", "twin", "at")
    closer = context.mapInArrow(resolved, "doc long, twin long, first int, end int")
    direct = decided.filter("NOT open").select(
        "doc", "twin", (F.col("at") - F.col("left")).alias("first"), (F.col("at") + F.lit(kind.gram) + F.col("right")).alias("end")
    )
    every = direct.unionByName(closer)
    listed = every.groupBy(*IDENTITY).agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    return texts, listed


def removed(n: int, found: pa.Scalar) -> np.ndarray:
    """For each of n tokens whether a span covers it."""
    if not found.is_valid or not len(found):
        return np.zeros(n, bool)
    values = found.values.flatten()
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(values[0].to_numpy(), 0, n), 1)
    np.add.at(edge, np.clip(values[1].to_numpy(), 0, n), -1)
    return np.cumsum(edge[:-1]) > 0


def per_document(
    docs: DataFrame, kind: Kind, resolve: Resolver, fields: str, compute: Callable[[bytes, pa.Scalar], tuple], **options
) -> DataFrame:
    """doc_id and `fields`, as `compute` makes them of each whole text and its repeated spans."""
    texts, listed = repeated(docs, kind, resolve, **options)
    schema = T.StructType.fromDDL(f"doc_id long, {fields}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), *((f.name, pa.int64() if f.dataType == T.LongType() else pa.string()) for f in schema.fields[1:])])
        for batch in batches:
            blobs, found = batch.column(1), batch.column(2)
            rows = [compute(unpacked(b.as_py()), s) for b, s in zip(blobs, found, strict=True)]
            columns = [batch.column(0), *(pa.array([r[i] for r in rows], kinds.field(i + 1).type) for i in range(len(kinds) - 1))]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return texts.join(listed, IDENTITY, "left").select("doc_id", "blob", "spans").mapInArrow(run, schema)
