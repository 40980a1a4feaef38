"""Transducers and the source audit against plain versions."""

import random
import re
from collections import Counter, defaultdict

import pytest

from ipvigil.llm import divergence
from ipvigil.llm.transducers import Transducer

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string"


def keys(seed, n=400):
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choices("abé日", k=rnd.randint(0, 7))).encode() for _ in range(n)})


@pytest.mark.parametrize("listed", [keys(0), keys(1, 5), [], [b""], [b"", b"a", b"aa", b"ab"]])
def test_transducer(listed):
    made = Transducer.load(Transducer.build(listed).dump())
    assert len(made) == len(listed)
    assert [made.ordinal(k) for k in listed] == list(range(len(listed)))
    assert [made.key(i) for i in range(len(listed))] == listed
    others = set(keys(5, 200)) - set(listed)
    assert all(made.ordinal(k) is None for k in others)


def test_transducer_is_minimal():
    listed = keys(2)
    made = Transducer.build(listed)
    rests = {b"": frozenset(listed)}
    for key in listed:
        for i in range(1, len(key) + 1):
            rests[key[:i]] = frozenset(k[i:] for k in listed if k.startswith(key[:i]))
    assert len(made.arcs) == len(set(rests.values()))


def plain(rows, least=3, top=200):
    docs = [((lang or ""), (source or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]) for _, text, lang, source in rows]
    seen, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        seen[lang].update(set(terms))
        count[lang, source].update(terms)
        sources[lang].add(source)
    out = []
    for lang, own in sources.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        total = sum((count[lang, s] for s in own), Counter())

        def share(found, kept=kept):
            size = sum(found[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (found[t] + 1) // size for t in kept}

        p, q = {s: share(count[lang, s]) for s in own}, share(total)
        for s in own:
            parts = {"pair": [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in own if o != s]}
            parts["term"] = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i) for i, (item, v) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


def rows(seed, n=120):
    rnd = random.Random(seed)
    words = ["Alpha", "beta", "ÄÖ", "ä", "日本", "x9y", "don't", "Ünder_score", "Z", "gamma" * 30] + ["".join(rnd.choices("abcde", k=3)) for _ in range(60)]
    out = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 40))), rnd.choice(["en", "de", "", None, "e\0n"]), rnd.choice(["a", "b", "é", "", None, "B"])) for i in range(n)]
    return out + [(1, None, "en", "empty"), (1, "", "fr", "one"), (2, None, "fr", "two"), (None, "alpha " * 3000, "en", "a"), (3, "12 34 -- ", "it", "s")] + out[:4]


def check(spark, data, **options):
    made = divergence.audit(spark.createDataFrame(data, SCHEMA), **options)
    assert made.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert dict(made.dtypes)["value"] == "bigint" and dict(made.dtypes)["rank"] == "int"
    assert sorted(map(tuple, made.collect())) == plain(data, top=options.get("top", 200))


@pytest.mark.parametrize(("seed", "options"), [(0, {}), (1, {"block": 3, "top": 5})])
def test_against_plain(spark, monkeypatch, seed, options):
    if options:
        for name, value in (("HELD", 7), ("CELLS", 8), ("LEAD", 5), ("CHUNK", 9)):
            monkeypatch.setattr(divergence, name, value)
    check(spark, rows(seed), **options)


def test_empty_table_and_no_kept_terms(spark):
    check(spark, [])
    check(spark, [(1, "once", "en", "a"), (2, "only", "en", "b"), (3, None, None, None)])


def test_counts_beyond_64_bits():
    import numpy as np

    counts, total = np.array([[10**13, 0]]), np.array([[10**13 + 5, 7]])
    assert divergence.shares(counts, total).tolist() == [[1 + 10**9 * (10**13 + 1) // (10**13 + 5), 1 + 10**9 // 7]]


def test_extra_columns(spark):
    data = [(i, "word here", "en", s) for i, s in enumerate("aab")]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], SCHEMA + ", key int, block string")
    assert sorted(map(tuple, divergence.audit(df).collect())) == plain(data)
