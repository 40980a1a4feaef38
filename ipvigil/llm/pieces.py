"""SentencePiece encoding and decoding on the `tokenizers` library, rebuilt from the model file's protobuf.

The model file is read as wire format: pieces with scores and types, the trainer's model type and byte fallback, the
normaliser's character map and white-space rules. From these come a normaliser, the metaspace marker, a BPE model (its
merges in the order of the scores) or a Unigram model (its scores) with byte fallback, and the decoder. Batches are
encoded and decoded by the library's threads inside the tasks; nothing is shuffled.

Two facts are taken from the vocabulary and checked when it is loaded: if no piece runs from a letter into a metaspace
marker, no merge can cross such a place, so texts may be cut there. Each word is then encoded once per task while it stays in
a cache of `CACHE_WORDS`, and texts with runs of spaces are encoded in parts; both bound a task's memory.

`parity` compares the rebuilt tokenizer with the `sentencepiece` library itself. Defined results: a null or empty text
has no ids; control pieces spelled out in a text are ordinary text; the marker U+2581 in a text becomes a space, as it
does in SentencePiece.
"""

import functools
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ipvigil.llm.frames import free_name, map_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
#: Largest model file that is sent to the tasks, and characters encoded in one call.
MODEL_BYTES = 64 << 20
PART_CHARS = 1 << 16
CACHE_WORDS = 1 << 18
#: Words that are encoded as one text; the marker at the beginning of a piece tells where the next word begins.
JOINED = 4096
MARK = "▁"

# Fixed values of the public file format: piece types, and model types of the trainer.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of one protobuf message."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    at = 0
    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"unknown wire type {kind}")
            size = varint()
        if at + size > len(data):
            raise ValueError("the model file ends early")
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    collapse: bool = True

    @property
    def cuttable(self) -> bool:
        """No piece runs from another character into a marker, and white space is kept as it is."""
        inside = any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))
        return self.model_type == BPE and not (inside or self.collapse or self.char_map)


def parse(data: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            spec.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            spec.model_type, spec.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
        elif number == 3:
            own = dict(_fields(value))
            spec.char_map = own.get(2, b"")
            spec.dummy_prefix, spec.collapse = bool(own.get(3, 1)), bool(own.get(4, 1))
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first."""
    score = {p: s for p, s, kind in spec.pieces if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, own in score.items():
        halves = [(piece[:i], piece[i:]) for i in range(1, len(piece))]
        ranked = sorted((h for h in halves if h[0] in score and h[1] in score), key=lambda h: (-score[h[0]], -score[h[1]]))
        found += [(own, h) for h in ranked]
    return [h for _, h in sorted(found, key=lambda x: -x[0])]


def build(spec: Spec, first: bool = True):
    """The rebuilt tokenizer; with first=False for a part of a text that isn't its beginning."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, p in enumerate(spec.pieces) if p[2] == UNKNOWN), None)
    if spec.model_type == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        name = None if unknown is None else spec.pieces[unknown][0]
        model = models.BPE(vocabulary, merges(spec), unk_token=name, fuse_unk=True, byte_fallback=spec.byte_fallback)
    elif spec.model_type == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unknown, spec.byte_fallback)
    else:
        raise ValueError(f"model type {spec.model_type} is neither unigram nor BPE")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.char_map)] if spec.char_map else []
    if spec.collapse:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if spec.dummy_prefix and first:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if spec.cuttable:
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"(?<=[^{MARK}]){MARK}"), "merged_with_next")
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if spec.dummy_prefix and first:
        undo.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(undo)
    own = [p for p, _, kind in spec.pieces if kind == USER_DEFINED]
    if own:
        tokenizer.add_tokens([AddedToken(p, normalized=False) for p in own])
    return tokenizer


def cut(text: str, size: int = PART_CHARS) -> list[str]:
    """Parts of about `size` characters, each later one beginning with a space that follows another character."""
    parts, begin = [], 0
    while len(text) - begin > size:
        at = text.find(" ", begin + size)
        while at > 0 and text[at - 1] in f" {MARK}":
            at = text.find(" ", at + 1)
        if at < 0:
            break
        parts.append(text[begin:at])
        begin = at
    return [*parts, text[begin:]]


class Codec:
    """Encodes and decodes batches of texts with one model file's pieces."""

    def __init__(self, data: bytes, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        self.spec = parse(data)
        self.head = build(self.spec)
        self.tail = build(self.spec, first=False) if self.spec.cuttable else None
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.spec.pieces])
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.tail is None or not self.spec.dummy_prefix:
            return [e.ids for e in self.head.encode_batch_fast(texts, add_special_tokens=False)]
        # a marker stands before every word, the first as well, unless spaces follow each other or stand outside
        plain = [bool(t) and t[0] != " " and t[-1] != " " and "  " not in t and MARK not in t for t in texts]
        whole = iter(self._in_parts([t for t, p in zip(texts, plain, strict=True) if not p]))
        by_word = iter(self._by_word([t.split(" ") for t, p in zip(texts, plain, strict=True) if p]))
        return [next(by_word if p else whole) for p in plain]

    def _by_word(self, texts: list[list[str]]) -> list[list[int]]:
        new = list(set(chain.from_iterable(texts)).difference(self.known))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, list(set(chain.from_iterable(texts)))
        joined = [" ".join(new[at : at + JOINED]) for at in range(0, len(new), JOINED)]
        for at, found in zip(range(0, len(new), JOINED), self.head.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = found.ids
            cuts = [*np.flatnonzero(self.begins[ids]).tolist(), len(ids)]
            self.known.update((w, ids[a:b]) for w, a, b in zip(new[at : at + JOINED], cuts[:-1], cuts[1:], strict=True))
        return [list(chain.from_iterable(map(self.known.__getitem__, t))) for t in texts]

    def _in_parts(self, texts: list[str]) -> list[list[int]]:
        parts = [cut(t) for t in texts]
        heads = self.head.encode_batch_fast([p[0] for p in parts], add_special_tokens=False)
        tails = iter(self.tail.encode_batch_fast([x for p in parts for x in p[1:]], add_special_tokens=False))
        out = []
        for part, head in zip(parts, heads, strict=True):
            ids = head.ids
            for _ in part[1:]:
                ids += next(tails).ids
            out.append(ids)
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.head.decode_batch(ids, skip_special_tokens=False)


@functools.lru_cache(maxsize=2)
def codec(data: bytes, threads: int = THREADS) -> Codec:
    return Codec(data, threads)


def model_bytes(path: str = MODEL) -> bytes:
    """The model file, read by the driver and sent to the tasks; refused beyond MODEL_BYTES."""
    if os.path.getsize(path) > MODEL_BYTES:
        raise ValueError(f"{path} has more than {MODEL_BYTES} bytes")
    with open(path, "rb") as file:
        return file.read()


def encoded(docs: DataFrame, model: bytes, keep: list[str], text: str = "text", threads: int = THREADS) -> DataFrame:
    """`keep`, then ids (array of int) and round_trip (decoding gives the text back) of each document."""

    def compute(part: pa.RecordBatch) -> list:
        own = codec(model, threads)
        texts = [x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]
        ids = own.encode(texts)
        same = [a == b for a, b in zip(own.decode(ids), texts, strict=True)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
        return [pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(same)]

    names = [free_name(docs, n) for n in ("ids", "round_trip")]
    fields = [T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.BooleanType())]
    return map_text(docs, text, fields, compute, keep)


def decoded(rows: DataFrame, model: bytes, ids: str = "ids", into: str = "text", threads: int = THREADS) -> DataFrame:
    """The rows with the text of their ids in a last column named `into`, or a free name where that is taken; null ids give
    an empty text."""
    schema = T.StructType([*rows.schema.fields, T.StructField(free_name(rows, into), T.StringType())])

    def run(batches):
        own = codec(model, threads)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                values = [x or [] for x in part.column(part.schema.get_field_index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.decode(values), pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def parity(texts: list[str], path: str = MODEL) -> list[str]:
    """The texts that the rebuilt tokenizer encodes or decodes in another way than `sentencepiece`; none, if all is well."""
    import sentencepiece

    own, other = Codec(model_bytes(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    ids, expected = own.encode(texts), other.encode(texts)
    back = zip(own.decode(expected), other.decode(expected), strict=True)
    return [t for t, a, b, (c, d) in zip(texts, ids, expected, back, strict=True) if a != b or c != d]


