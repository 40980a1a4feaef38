"""Byte-wise substring dedup by a depth-limited radix sort over suffixes: most significant digits first.

A suffix counts only up to `LENGTH` bytes. Its digits are hashed blocks: the first is an anchor inside of it, which the
shuffle sorts by; the second all bytes around the anchor, which settles whole contexts at once; the last the LENGTH bytes
themselves. After each pass only groups of several suffixes go on, and those that are left after the last pass are
exactly the repeated windows. See `repeats` for the passes, which documents take part in, and hot content.

Every byte that a repeated window covers is removed, unless the window starts nowhere earlier (in a smaller doc_id, or
earlier in the same document). Defined results: a null text is empty; a null doc_id comes first; rows that repeat a
doc_id and its text are one document; rows that repeat it with another text are documents of their own, ordered by a hash
of the text, so that one copy of every string stays.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from ipvigil.llm import repeats, spans

LENGTH = 100
KIND = repeats.Kind(words=False, window=LENGTH, gram=24, within=True)
#: Windows sorted at once; groups are kept whole.
SORTED = 1 << 20


def _last_pass(key: np.ndarray, doc: np.ndarray, twin: np.ndarray, at: np.ndarray, data: np.ndarray, bounds: np.ndarray):
    """Spans of the windows in some contexts that also start earlier in a context of the same key."""
    window = spans.mixed(spans.grams(spans.BYTE_VALUE[data], LENGTH))
    count = np.maximum(np.diff(bounds) - LENGTH + 1, 0)
    of = np.repeat(np.arange(len(count)), count)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    digit = window[bounds[of] + inner]
    group = (np.cumsum(np.r_[False, key[1:] != key[:-1]]))[of]
    start, owner, other = at[of] + inner, doc[of], twin[of]
    order = np.lexsort((start, other, owner, digit, group))
    new = np.ones(len(order), bool)
    new[1:] = (digit[order][1:] != digit[order][:-1]) | (group[order][1:] != group[order][:-1])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    later = np.zeros(len(of), bool)
    later[order] = (owner[order] != owner[first]) | (other[order] != other[first]) | (start[order] > start[first])
    place = np.flatnonzero(later)
    begin = np.r_[True, (np.diff(place) != 1) | (np.diff(of[place]) != 0)] if len(place) else np.zeros(0, bool)
    end = np.r_[begin[1:], True] if len(place) else begin
    return owner[place[begin]], other[place[begin]], start[place[begin]], start[place[end]] + LENGTH


def resolve(rows: dict) -> tuple[np.ndarray, ...]:
    """The last pass over whole groups, some groups at a time."""
    data, bounds = spans.flat(rows["context"])
    key = rows["key"]
    out = []
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
    begin = 0
    while begin < len(cuts) - 1:
        end = max(int(np.searchsorted(bounds[cuts], bounds[cuts[begin]] + SORTED, "right")) - 1, begin + 1)
        a, b = cuts[begin], cuts[end]
        part = data[bounds[a] : bounds[b]]
        out.append(_last_pass(key[a:b], rows["doc"][a:b], rows["twin"][a:b], rows["at"][a:b].astype(np.int64), part, bounds[a : b + 1] - bounds[a]))
        begin = end
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *x]) for x in zip(*out, strict=True)) if out else (none,) * 4


def _result(text: bytes, found) -> tuple[int, int, int, str]:
    gone = repeats.removed(len(text), found)
    runs = int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])) if len(text) else 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if runs else text
    return len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return repeats.per_document(docs, KIND, resolve, fields, _result, **options)


def kept_text(docs: DataFrame, **options) -> DataFrame:
    """doc_id and the text that is left of every document (bytes that are no longer UTF-8 are replaced)."""

    def left(text: bytes, found) -> tuple[str]:
        return (np.frombuffer(text, np.uint8)[~repeats.removed(len(text), found)].tobytes().decode("utf-8", "replace"),)

    return repeats.per_document(docs, KIND, resolve, "text string", left, **options)
