"""Near duplicates by exact Jaccard similarity against all pairs."""

import random

import numpy as np
import pyarrow as pa

from ipvigil.llm import alike, simhash
from tests.llm import corpus


def shingle_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def kept(docs, similarity=0.8, distance=3):
    """Smallest doc_id of every component of links of either kind, over all pairs."""
    fp = {d: simhash.fingerprint((t or "").encode()) for d, t in docs}
    sets = {d: shingle_set(t) for d, t in docs}
    label = {d: d for d in fp}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(fp)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            union = len(sets[a] | sets[b])
            if (fp[a] ^ fp[b]).bit_count() <= distance or union and len(sets[a] & sets[b]) / union >= similarity:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {root(d) for d in ids}


def edited(rnd, words, n):
    words = list(words)
    for at in rnd.sample(range(len(words)), n):
        words[at] = f"new{rnd.random()}"
    return words


def near_copies(seed, groups=25, copies=5, words=200):
    rnd, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rnd.randrange(3000)}" for _ in range(words)]
        out += [" ".join(edited(rnd, base, rnd.randint(0, 7))) for _ in range(copies)]
    rnd.shuffle(out)
    return list(enumerate(out))


def survivors(spark, docs):
    left = simhash.one_per_group(spark.createDataFrame(docs, "doc_id long, text string"), alike.SIMILARITY)
    return {r.doc_id for r in left.collect()}


def test_one_edited_word_in_two_hundred_is_a_near_copy(spark):
    docs = near_copies(1)
    want = kept(docs)
    assert len(want) < len(kept(docs, similarity=2)) - 20  # three bits alone lose these
    assert survivors(spark, docs) == want


def test_all_kinds_of_texts(spark):
    docs = [(d[0], d[1]) for d in corpus.rows(3)]
    assert survivors(spark, docs) == kept(docs)


def test_chains_and_pairs_left_by_all_stars(spark, monkeypatch):
    monkeypatch.setattr(alike, "STARS", 1)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(40):  # each like the next one, the ends unlike
        docs.append((i, " ".join(words)))
        words = edited(rnd, words, 3)
    assert survivors(spark, docs) == kept(docs) == {0}


def test_bands_reach_the_similarity():
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(300):
        # 160 of 200 words in a row are shared: similarity just over 0.8
        a = [f"x{x}" for x in rng.integers(0, 10**9, 190)]
        b = [*a[20:], *(f"y{x}" for x in rng.integers(0, 10**9, 20))]
        one, two = (shingle_set(" ".join(x)) for x in (a, b))
        assert 0.79 < len(one & two) / len(one | two) < 0.82
        bands = alike.sketches(pa.array([" ".join(a), " ".join(b)]))[2].to_pylist()
        missed += not set(bands[0]) & set(bands[1])
    assert missed == 0


def test_sketches_of_empty_texts():
    size, _, bands = alike.sketches(pa.array([None, "", " \n", "a b", "A  b"]))
    assert size.to_pylist() == [0, 0, 0, 1, 1]
    assert [len(x) for x in bands.to_pylist()] == [0, 0, 0, alike.BANDS, alike.BANDS] and bands[3] == bands[4]


def test_every_pair_of_a_band_meets_in_one_cell(spark):
    rows = [(1, i * 7, 40) for i in range(40)] + [(2, 5, 2), (2, 6, 2)]
    dealt = alike.cells(spark.createDataFrame(rows, "band long, sig long, n long"), 3).collect()
    met = {}
    for r in dealt:
        met.setdefault((r.band, r.i, r.j), []).append((r.part, r.sig))
    pairs = [
        (band, *sorted((x[1], y[1])))
        for (band, i, j), own in met.items() for x in own for y in own
        if (i < j and x[0] == i and y[0] == j) or (i == j and x[1] < y[1])
    ]
    want = {(x[0], *sorted((x[1], y[1]))) for x in rows for y in rows if x[0] == y[0] and x[1] < y[1]}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_links_of_a_cell():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**62, 60)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(45, 60), False), rng.integers(0, 2**62, rng.integers(1, 8))])) for _ in range(60)]
    root = np.arange(60)
    root[:10] = 0
    like = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
    for part in (np.zeros(60, int), np.arange(60) % 2):
        compared = lambda x, y: part.max() == 0 or part[x] != part[y]  # noqa: E731, B023
        want = corpus_components(root, [(root[x], root[y]) for x in range(60) for y in range(x) if compared(x, y) and like(sets[x], sets[y])])
        assert corpus_components(root, alike.cell_links(part, root, sets, 0.8)) == want


def corpus_components(nodes, links):
    label = {int(n): int(n) for n in nodes}
    for _ in label:
        for a, b in links:
            label[int(a)] = label[int(b)] = min(label[int(a)], label[int(b)])
    return label
