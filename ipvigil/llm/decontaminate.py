"""Benchmark decontamination with suffix arrays of the training text.

Words are compared as in the benchmark's contract: ASCII letters in lower case, everything but letters, digits and
non-ASCII characters separates. Each part of the documents (a shard, of bounded size) gets a suffix array over its
words: all suffixes that begin with a benchmark word, sorted by their first `window` words, which are packed into whole
numbers of benchmark word ids. Every suffix of every benchmark item is then binary-searched in every shard: the equal
range holds all places of its first `window` words (of the whole item, if it is shorter), and matches that follow one
another along item and document join to the longest verbatim match. Nothing is shuffled.

The benchmark is read in blocks of at most `block_words` words, in the order of its rows as stored; each block is sent
to the tasks by itself and takes one more pass over the documents, so no size of benchmark is left out.

Words are told apart by 64-bit hashes. Defined results: null texts have no words; items without words match nothing; a
null item_id is listed as an empty name; equal item ids are listed once; documents that repeat are each judged.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ipvigil.llm import spans
from ipvigil.llm.frames import cut_lineage, free_name, map_text

WINDOW = 10
BLOCK_WORDS = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


def tokenised(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and where each text's words begin and end."""
    data, bounds = spans.flat(column)
    data = _LOWER[data]
    start, end, first = spans.words(data, bounds, _GAP)
    return spans.word_hashes(data, start, end, _GAP), first


def packed(ids: np.ndarray, valid: np.ndarray, bits: int, depth: int, fill: int = 0) -> np.ndarray:
    """For each of the suffixes `ids[i:]` its first `depth` ids packed into columns of 64 bits; `valid[i]` of them count."""
    per = 64 // bits
    out = np.zeros((-(-depth // per), len(valid)), np.uint64)
    padded = np.concatenate([ids, np.zeros(depth, ids.dtype)]).astype(np.uint64)
    for j in range(depth):
        digit = np.where(j < valid, padded[j : j + len(valid)], np.uint64(fill))
        out[j // per] |= digit << np.uint64(bits * (per - 1 - j % per))
    return out


def bound(ordered: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of key columns in sorted key columns: the first place not before (or after) each wanted key."""
    low, high = np.zeros(wanted.shape[1], np.int64), np.full(wanted.shape[1], ordered.shape[1])
    while (low < high).any():
        open_ = low < high
        middle = np.minimum((low + high) >> 1, max(ordered.shape[1] - 1, 0))
        less, equal = np.zeros(len(low), bool), np.ones(len(low), bool)
        for have, want in zip(ordered, wanted, strict=True):
            value = have[middle]
            less |= equal & (value < want)
            equal &= value == want
        right = open_ & (less | equal if after else less)
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low


@dataclass
class Block:
    """Search keys for every window of some benchmark items; its size is bounded by `block_words`."""

    vocabulary: np.ndarray
    bits: int
    lower: np.ndarray
    upper: np.ndarray
    length: np.ndarray
    place: np.ndarray
    item: np.ndarray
    names: np.ndarray
    depth: int


def block_of(items: list[str], texts: list[str | None], window: int) -> Block:
    hashes, first = tokenised(pa.array(texts, pa.string()))
    vocabulary = np.unique(hashes)
    ids = np.searchsorted(vocabulary, hashes) + 1
    count = np.diff(first)
    item = np.repeat(np.arange(len(items)), count)
    left = first[item + 1] - np.arange(len(ids)) if len(ids) else np.zeros(0, np.int64)
    begins = (left >= window) | ((count[item] < window) & (np.arange(len(ids)) == first[item])) if len(ids) else left > 0
    length = np.minimum(left, window)
    bits = max(int(len(vocabulary) + 1).bit_length(), 4)
    lower = packed(ids, length, bits, window)[:, begins]
    upper = packed(ids, length, bits, window, (1 << bits) - 1)[:, begins]
    return Block(
        vocabulary, bits, lower, upper, length[begins], np.flatnonzero(begins), item[begins], np.array(items, object), window
    )


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    """Benchmark items in blocks; only one block at a time is in the driver's memory."""
    items, texts, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").distinct()
    for row in rows.toLocalIterator():
        n = len(row.text or "") // 2 + 1
        if items and size + n > block_words:
            yield block_of(items, texts, window)
            items, texts, size = [], [], 0
        items.append(row.i)
        texts.append(row.text)
        size += n
    if items:
        yield block_of(items, texts, window)


def search(hashes: np.ndarray, first: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(word place, window index) of every occurrence of a block's windows in a shard of documents."""
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(block.vocabulary):
        return none, none
    at = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
    ids = np.where(block.vocabulary[at] == hashes, at + 1, 0)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = np.minimum(first[doc + 1] - np.arange(len(ids)), block.depth)
    keys = packed(ids, left, block.bits, block.depth)
    suffix = np.flatnonzero(ids)
    keys = keys[:, suffix]
    order = np.lexsort(keys[::-1])
    suffix, keys = suffix[order], keys[:, order]
    low, high = bound(keys, block.lower, False), bound(keys, block.upper, True)
    found = np.flatnonzero(high > low)
    many = (high - low)[found]
    window = np.repeat(found, many)
    offset = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)
    return suffix[np.repeat(low[found], many) + offset], window


def _runs(place: np.ndarray, window: np.ndarray, block: Block) -> np.ndarray:
    """Words in the verbatim match that each occurrence belongs to."""
    other = block.place[window]
    order = np.lexsort((place, place - other, block.item[window]))
    p, q = place[order], other[order]
    new = np.r_[True, (np.diff(p) != 1) | (np.diff(q) != 1)] if len(p) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(p)))
    out = np.empty(len(p), np.int64)
    out[order] = np.repeat(size, size) - 1 + block.length[window[order]]
    return out


def matched(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_words: int = BLOCK_WORDS,
    text: str = "text",
) -> DataFrame:
    """`keep`, then n_words, longest (words of the longest verbatim match), spans and items of each document.

    `spans` holds the first word and the end of each hit range, in a row; `items` the ids of the items found, sorted.
    """
    names = [free_name(docs, n) for n in ("n_words", "longest", "spans", "items")]
    kinds = [T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.StringType())]
    fields = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]
    earlier = {n: free_name(docs, f"{n}_before") for n in names}
    current, columns = None, [*keep, *([] if text in keep else [text])]
    for block in blocks(benchmark, window, block_words):
        if current is not None:
            current = cut_lineage(current, "benchmark-block")
        merge = {} if current is None else earlier
        current = _pass(docs if current is None else current, text, columns, fields, block, merge)
    if current is None:
        current = _pass(docs, text, columns, fields, block_of([], [], window), {})
    return current.select(*keep, *names)


def _pass(docs: DataFrame, text: str, columns: list[str], fields: list, block: Block, merge: dict[str, str]) -> DataFrame:
    """One block against all documents; the results of earlier blocks, in columns renamed by `merge`, are merged."""
    before = list(merge.values())

    def compute(part: pa.RecordBatch) -> list:
        index = part.schema.get_field_index
        hashes, first = tokenised(part.column(index(text)))
        place, window = search(hashes, first, block)
        n = len(first) - 1
        doc = np.searchsorted(first, place, "right") - 1
        run = _runs(place, window, block)
        longest = np.zeros(n, np.int64)
        np.maximum.at(longest, doc, run)
        hit = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(hit, place, 1)
        np.add.at(hit, place + block.length[window], -1)
        pairs = np.unique(np.stack([doc, block.item[window]], axis=1), axis=0)
        items = [set() for _ in range(n)]
        for d, i in pairs.tolist():
            items[d].add(block.names[i])
        if before:
            _, length, ranges, found = (part.column(index(c)).to_pylist() for c in before)
            longest = np.maximum(longest, np.array(length, np.int64))
            for d in range(n):
                items[d].update(found[d])
                for a, b in zip(ranges[d][::2], ranges[d][1::2], strict=True):
                    hit[first[d] + a] += 1
                    hit[first[d] + b] -= 1
        covered = np.cumsum(hit[:-1]) > 0
        inner = np.r_[False, covered[1:] & covered[:-1]] if len(covered) else covered
        inner[first[:-1][first[:-1] < len(covered)]] = False
        begin = np.flatnonzero(covered & ~inner)
        last = np.r_[~inner[1:], True] & covered if len(covered) else covered
        end = np.flatnonzero(last) + 1
        owner = np.searchsorted(first, begin, "right") - 1
        flat = np.stack([begin - first[owner], end - first[owner]], axis=1).ravel()
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n) * 2)])
        spans_ = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
        listed = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
        return [pa.array(np.diff(first), pa.int64()), pa.array(longest), spans_, listed]

    if not before:
        return map_text(docs, text, fields, compute, columns)
    return map_text(docs.withColumnsRenamed(merge), text, fields, compute, [*columns, *before]).drop(*before)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of the benchmark, all columns as they were."""
    keep = docs.columns
    made = matched(docs, benchmark, keep, window)
    spans_ = made.columns[len(keep) + 2]
    return made.filter(F.size(F.col(spans_)) == 0).select(*keep)
