"""Toxicity scores: gradient-boosted trees over dense features of the whole text, calibrated by isotonic regression.

The features are lexicon densities (a short list of insults, and word stems learned from the labels), their nearness to
second-person words, capitals, punctuation and obfuscation. The only thing fitted on a sample is the classifier: at most
`max_rows` labelled training rows, drawn by the hash of their ids. One half of them teaches the stems, and of the rest
three quarters grow the trees and one quarter calibrates them, so no part sees its own errors.

Defined results: null and empty texts are scored like any other (all densities 0); rows with a null doc_id are scored
and are not held out; without labelled rows of both classes every score is the share of label 1 (0 if there are none);
repeated label rows of a document count once, with the larger label.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ipvigil.llm import spans
from ipvigil.llm.frames import cut_lineage, free_name, map_text

# Common insults, and second-person words of the languages at hand.
INSULTS = (
    "clown creep disgusting dumb filth fool freak garbage idiot imbecile jerk loser moron pathetic scum stupid trash "
    "ugly vermin worthless"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ti".split()
LEET = dict(zip("013457@$", "oieastas", strict=True))

FEATURES = (
    "insults stems stem_weight stem_peak hits second_person near_second_person capitals shouted punctuation exclaimed "
    "symbols obfuscated unmasked length word_length"
).split()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = _LOWER.copy()
for _sign, _letter in LEET.items():
    _PLAIN[ord(_sign)] = ord(_letter)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_WORD[[ord("@"), ord("$")]] = True
_GAP = ~_WORD
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOUD = np.zeros(256, bool)
_LOUD[[ord("!"), ord("?")]] = True
_MASK = np.zeros(256, bool)
_MASK[[*range(48, 58), ord("@"), ord("$")]] = True
STEM_BYTES = (4, 6)
NEAR = 5


def _hash_list(items: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(items).encode(), np.uint8)
    start, end, _ = spans.words(data, np.array([0, len(data)]), _GAP)
    return np.unique(spans.word_hashes(data, start, end, _GAP))


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Index of each value in an ordered list, -1 where it is not in it."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


def _tokens(part: pa.RecordBatch, text: str):
    data, bounds = spans.flat(part.column(part.schema.get_field_index(text)))
    start, end, first = spans.words(data, bounds, _GAP)
    return data, bounds, start, end, first


def _stems(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Hashes of every lower-case word and of its first few bytes (0 for words not longer than those)."""
    lower = _LOWER[data]
    out = [spans.word_hashes(lower, start, end, _GAP)]
    for size in STEM_BYTES:
        keep = end - start > size
        stem = np.zeros(len(start), np.uint64)
        for i in range(size):
            at = np.minimum(start + i, max(len(data) - 1, 0))
            stem = stem * spans._FACTORS[i] + spans.BYTE_VALUE[lower[at]] if len(data) else stem
        out.append(np.where(keep, spans.mixed(stem + np.uint64(size)), np.uint64(0)))
    return out


@dataclass
class Model:
    """What scoring needs: the learned stems (bounded by `max_stems`) and the fitted MLlib models."""

    stems: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trees: object = None
    calibration: object = None
    constant: float = 0.0


def features(df: DataFrame, text: str, stems: np.ndarray, weights: np.ndarray, name: str, keep: list[str]) -> DataFrame:
    """The columns in `keep` and the array `name` of the FEATURES of each whole text."""
    insults, second = _hash_list(INSULTS), _hash_list(SECOND_PERSON)

    def compute(part: pa.RecordBatch) -> list:
        data, bounds, start, end, first = _tokens(part, text)
        n_words = np.maximum(_sums(np.ones(len(start)), first), 1.0)
        n_bytes = np.maximum(np.diff(bounds).astype(float), 1.0)
        full, *stem = _stems(data, start, end)
        plain = spans.word_hashes(_PLAIN[data], start, end, _GAP)
        insult = _member(full, insults) >= 0
        unmasked = (_member(plain, insults) >= 0) & ~insult
        best = np.zeros(len(start))
        for hashes in (full, *stem):
            found = _member(hashes, stems)
            if len(stems):
                best = np.maximum(best, np.where(found >= 0, weights[found], 0.0))
        hit = insult | unmasked | (best > 0)
        you = _member(full, second) >= 0
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        running = np.concatenate([[0], np.cumsum(you)])
        place = np.arange(len(start))
        low, high = np.maximum(place - NEAR, first[doc]), np.minimum(place + NEAR + 1, first[doc + 1])
        near = hit & (running[high] > running[low])
        peak = np.zeros(len(first) - 1)
        np.maximum.at(peak, doc[best > 0], best[best > 0])
        letter = np.concatenate([[0], np.cumsum(_LETTER[data])])
        capital = np.concatenate([[0], np.cumsum(_CAPITAL[data])])
        masked = np.concatenate([[0], np.cumsum(_MASK[data])])
        letters, capitals = letter[end] - letter[start], capital[end] - capital[start]
        shouted = (capitals == letters) & (letters > 1)
        odd = (letters > 0) & (masked[end] > masked[start])
        columns = [
            _sums(insult, first) / n_words,
            _sums(best > 0, first) / n_words,
            _sums(best, first) / n_words,
            peak,
            np.log1p(_sums(hit, first)),
            _sums(you, first) / n_words,
            _sums(near, first) / n_words,
            _sums(_CAPITAL[data], bounds) / np.maximum(_sums(_LETTER[data], bounds), 1.0),
            _sums(shouted, first) / n_words,
            _sums(_SIGN[data], bounds) / n_bytes,
            _sums(_LOUD[data], bounds) / n_bytes,
            _sums(_MASK[data], bounds) / n_bytes,
            _sums(odd, first) / n_words,
            _sums(unmasked, first) / n_words,
            np.log1p(_sums(np.ones(len(start)), first)),
            np.log1p(_sums(end - start, first) / n_words),
        ]
        values = np.stack(columns, axis=1).astype(np.float64).ravel()
        return [pa.FixedSizeListArray.from_arrays(pa.array(values), len(columns)).cast(pa.list_(pa.float64()))]

    kind = [T.StructField(name, T.ArrayType(T.DoubleType()))]
    return map_text(df, text, kind, compute, keep)


def _labelled(docs: DataFrame, labels: DataFrame, allowed: Column, max_rows: int) -> DataFrame:
    """(text, label, part) of at most about `max_rows` labelled rows; `part` is a hash in [0, 1000).

    Only this bounded list of ids is broadcast; the texts are not shuffled.
    """
    one = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
    marked = one.agg(F.max(F.col("toxic")).cast("double").alias("label")).filter(allowed)
    total = marked.count()
    share = int(2**40 * min(1.0, max_rows / max(total, 1)))
    drawn = F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(2**40)) < share
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(1000)).alias("part")
    chosen = marked.filter(drawn).select("doc_id", "label", part)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label", "part")


def learned_stems(rows: DataFrame, max_stems: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the words and stems that mark label 1, by a lower bound of their log odds ratio."""

    def each(batches):
        for batch in batches:
            for part in spans.sliced(batch, "text"):
                data, _, start, end, first = _tokens(part, "text")
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                label = np.asarray(part.column(1)).astype(np.int64)
                for hashes in _stems(data, start, end):
                    pair = np.unique(np.stack([doc.astype(np.uint64), hashes], axis=1), axis=0)
                    pair = pair[pair[:, 1] != 0]
                    stem, count = pair[:, 1].view(np.int64), label[pair[:, 0].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(stem), pa.array(count)], ["stem", "label"])

    totals = rows.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("*")).first()
    toxic, clean = float(totals[0]), float(totals[1] - totals[0])
    seen = rows.select("text", "label").mapInArrow(each, "stem long, label long")
    a, b = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    weight = F.log(a / (toxic + 1)) - F.log(b / (clean + 1))
    sure = weight - F.sqrt(1 / a + 1 / b)
    found = (
        seen.groupBy("stem").agg(F.sum("label").alias("t"), F.count("*").alias("n")).filter("t >= 3")
        .select("stem", sure.alias("weight")).filter("weight >= 1.5")
        .orderBy(F.desc("weight"), "stem").limit(max_stems).collect()
    )
    found.sort(key=lambda r: np.int64(r.stem).view(np.uint64))
    return np.array([r.stem for r in found], np.int64).view(np.uint64), np.array([r.weight for r in found], float)


def fit(
    docs: DataFrame, labels: DataFrame, allowed: Column | None = None, max_rows: int = 12_000, max_stems: int = 4_000,
    iterations: int = 20, depth: int = 3,
) -> Model:
    """Fit on labelled documents whose doc_id satisfies `allowed`; see the module's text for the bound `max_rows`."""
    rows = cut_lineage(_labelled(docs, labels, F.lit(True) if allowed is None else allowed, max_rows), "toxic-sample")
    stems, weights = learned_stems(rows.filter("part < 500"), max_stems)
    made = features(rows, "text", stems, weights, "values", ["label", "part"])
    made = cut_lineage(made.coalesce(4), "toxic-features")
    trained = made.filter("part >= 500 AND part < 875").select(array_to_vector("values").alias("x"), "label")
    held = made.filter("part >= 875").select(array_to_vector("values").alias("x"), "label")
    kinds = {r.label: r["count"] for r in trained.groupBy("label").count().collect()}
    if len(kinds) < 2:
        return Model(stems, weights, constant=sum(k * n for k, n in kinds.items()) / max(sum(kinds.values()), 1))
    trees = GBTClassifier(
        featuresCol="x", labelCol="label", maxIter=iterations, maxDepth=depth, stepSize=0.2, seed=7, maxBins=64,
        cacheNodeIds=False,
    ).fit(trained)
    raw = trees.transform(held).select(vector_to_array("probability")[1].alias("raw"), "label")
    calibration = None
    if raw.select("label").distinct().count() == 2:
        calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="even").fit(raw)
    return Model(stems, weights, trees, calibration)


def score(docs: DataFrame, model: Model, keep: list[str], into: str = "score", text: str = "text") -> DataFrame:
    """`keep` and the calibrated probability of label 1; equal calibrated values are ordered by 2 % of the raw one."""
    name, raw = free_name(docs, "toxic_features"), free_name(docs, "toxic_raw")
    made = features(docs, text, model.stems, model.weights, name, keep)
    if model.trees is None:
        return made.withColumn(into, F.lit(float(model.constant))).drop(name)
    vector, even = free_name(docs, "toxic_vector"), free_name(docs, "toxic_even")
    trees = model.trees.copy()
    trees.setFeaturesCol(vector).setRawPredictionCol("").setPredictionCol("").setProbabilityCol(raw)
    scored = trees.transform(made.withColumn(vector, array_to_vector(name)))
    scored = scored.withColumn(raw, vector_to_array(raw)[1])
    if model.calibration is None:
        return scored.withColumn(into, F.col(raw)).drop(name, vector, raw)
    even_model = model.calibration.copy()
    even_model.setFeaturesCol(raw).setPredictionCol(even)
    result = F.lit(0.98) * F.col(even) + F.lit(0.02) * F.col(raw)
    return even_model.transform(scored).withColumn(into, result).drop(name, vector, raw, even)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents scored below `threshold`, all columns as they were."""
    model = fit(docs, labels, ~held_out())
    into = free_name(docs, "toxic_score")
    return score(docs, model, docs.columns, into).filter(F.col(into) < threshold).drop(into)
