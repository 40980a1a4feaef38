"""Quality rules against a plain version."""

import math
import re
import zlib
from collections import Counter

import pytest

from ipvigil.llm import quality
from tests.llm import corpus

WORDS = re.compile("[^\x20\x09-\x0d]+")
LABELS = "doc_id long, quality int, toxic int"


def plain(docs, good):
    """By place: the counts, base_failed, score and the verdict."""
    def buckets(words):
        return [zlib.crc32(x.encode()) % quality.BUCKETS for x in [*words, *map(" ".join, zip(words, words[1:]))]]

    every, trusted, rows = Counter(), Counter(), []
    for doc, text in docs:
        words = WORDS.findall(text or "")
        every.update(buckets(words))
        if doc in good:
            trusted.update(buckets(words))
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        n = Counter(windows)
        covered = {p for i, w in enumerate(windows) if n[w] > 1 for p in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        counts = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        rows.append((doc, words, counts, len(words) < 20 or 100 * len(covered) > 30 * len(words)))
    all_n, all_good, size = sum(every.values()), sum(trusted.values()), quality.BUCKETS
    weight = [math.floor(1e6 * math.log(((trusted[b] + 1) / (all_good + size)) / ((every[b] + 1) / (all_n + size)))) for b in range(size)]
    made = []
    for doc, words, counts, failed in rows:
        own = buckets(words)
        made.append((doc, *counts, failed, math.floor(sum(weight[b] for b in own) / (1000 * len(own))) if own else None))
    scores = sorted(m[-1] for m in made if m[0] in good and not m[-2])
    least = scores[len(scores) // quality.TAIL] if scores else None
    return [(*m, not m[-2] and (least is None or m[-1] >= least)) for m in made]


def check(spark, rows, labels):
    docs = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    made = quality.judged(docs, spark.createDataFrame(labels, LABELS), ["doc_id"])
    assert made.columns == ["doc_id", *quality.COUNTS, "base_failed", "score", "kept"]
    order = lambda r: tuple(-10**9 if x is None else x for x in r)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    assert sorted(map(tuple, made.collect()), key=order) == sorted(plain(rows, good), key=order)


@pytest.mark.parametrize("seed", [0, 1])
def test_against_plain(spark, seed):
    rows = [(d[0], d[1]) for d in corpus.rows(seed)]
    junk = [(1000 + i, " ".join(f"#{i}%{j}" for j in range(30))) for i in range(8)]
    odd = [(2000, "a b c d e f g h " * 9), (2001, "x y　z " * 30), (2002, "one\r\none\r\none\v\n\n \n" * 4), (2003, "w " * 5000)]
    check(spark, rows + junk + odd, [(d, 1, 0) for d, _ in rows[::2]] + [(d, 0, 0) for d, _ in junk])


def test_nulls_repeated_rows_and_no_labels(spark):
    text = " ".join(f"word{i % 23}" for i in range(40))
    rows = [(None, text), (None, None), (1, text), (1, text), (2, ""), (3, " \t\n"), (4, text + " more")]
    check(spark, rows, [(1, 1, 0), (1, 1, 1), (None, 1, 0), (9, 1, 0), (4, None, None)])
    check(spark, rows, [])
    check(spark, [], [(1, 1, 0)])


def test_extra_columns_with_clashing_names(spark):
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 7, True, "r"), (2, "short", 8, False, "s")], "doc_id long, text string, score int, kept boolean, row string")
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    left = quality.kept(docs, labels)
    assert [tuple(r) for r in left.collect()] == [(1, text, 7, True, "r")] and left.columns == docs.columns
    made = quality.judged(docs, labels)
    assert made.columns[:5] == docs.columns and made.columns[-2:] == ["score_", "kept_"]


def test_no_python_on_the_main_path(spark):
    docs = spark.createDataFrame(corpus.rows(0), corpus.SCHEMA)
    weight = quality.weights(docs, quality.trusted_ids(spark.createDataFrame([(0, 1, 0)], LABELS)))
    plan = quality.measured(docs, ["doc_id"], weight)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("Subquery")[0]


def test_every_labelled_id_is_trusted(spark):
    labels = spark.range(70_000).selectExpr("id % 69000 AS doc_id", "1 AS quality", "0 AS toxic")
    assert quality.trusted_ids(labels).count() == 69_000


def test_trusted_ids_that_are_not_sent_to_the_texts(spark):
    rows = [(d[0], d[1]) for d in corpus.rows(3)] + [(None, "a b c d e f g h " * 9)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, rows, [(d, 1, 0) for d, _ in rows[::2]])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
