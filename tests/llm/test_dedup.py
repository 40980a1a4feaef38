"""Line, byte, word and near-duplicate removal against plain versions."""

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from ipvigil.llm import automata, components, lines, repeats, simhash, spans, substrings
from tests.llm import corpus


@pytest.fixture(scope="module", params=[0, 1])
def docs(request):
    return corpus.rows(request.param)


def frame(spark, rows, schema=corpus.SCHEMA):
    return spark.createDataFrame(rows, schema)


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_lines(spark, docs):
    df = frame(spark, docs)
    made = lines.rebuilt(df, lines.repeated_windows(df), ["doc_id"])
    got = {k: (v[1], v[2], v[3]) for k, v in by_id(made).items()}
    assert got == corpus.lines_left(docs)


def test_lines_keep_columns_nulls_and_blank_documents(spark):
    text = "one\ntwo\n\nthree"
    rows = [(1, text, 5), (2, "one\n two\nthree", 6), (3, "one\ntwo\nthree\nfour", 7), (4, None, 8), (5, "", 9), (None, "x\ny", 1)]
    left = lines.dedup_lines(frame(spark, rows, "doc_id long, text string, line_text long"))
    assert left.columns == ["doc_id", "text", "line_text"]
    assert by_id(left) == {1: (text, 5), 3: ("four", 7), 4: (None, 8), 5: ("", 9), None: ("x\ny", 1)}


def test_bytes(spark, docs):
    assert by_id(substrings.deduplicated(frame(spark, docs))) == corpus.bytes_left(docs)


def test_words(spark, docs):
    assert by_id(automata.deduplicated(frame(spark, docs))) == corpus.words_left(docs)


def test_hot_grams_change_nothing(spark, docs):
    df = frame(spark, docs)
    rows = df.selectExpr("doc_id AS doc", "xxhash64(text) AS twin", "text")
    assert len(repeats.hot_grams(rows, substrings.KIND, 2, 1)) > 5
    assert by_id(substrings.deduplicated(df, hot=2, sampled=1)) == corpus.bytes_left(docs)
    assert by_id(automata.deduplicated(df, hot=2, sampled=1)) == corpus.words_left(docs)


def test_long_texts_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 64)
    monkeypatch.setattr(repeats, "COMBINED", 50)
    import pyarrow as pa

    text = (docs[20][1] or "") * 3 + "".join(d[1] or "" for d in docs[:30])
    ids = pa.array([1, 2, 3], pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array([text, "", text[7:]])], ["doc", "twin", "text"])

    def found():
        out = set()
        for token, bounds, _, counts in repeats._tokens(batch, substrings.KIND):
            own = repeats._found(token, np.clip(bounds, 0, len(token)), substrings.KIND)
            keep = (own["place"] >= counts.start) & (own["place"] < counts.stop)
            place = own["place"] - bounds[own["owner"]]
            out |= set(zip(*(x[keep].tolist() for x in (own["key"], own["ctx"], own["owner"], place)), strict=True))
        return out

    small = found()
    monkeypatch.setattr(repeats, "BLOCK", 1 << 20)
    assert small == found()


@pytest.mark.parametrize("operator", [substrings.deduplicated, automata.deduplicated])
def test_repeated_rows_and_empty_tables(spark, operator):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text), (None, text), (3, text), (3, text), (4, None)]
    got = operator(frame(spark, rows, "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got) == sorted([0, 0, got[0][1], got[0][1], 0])
    assert operator(frame(spark, [], corpus.SCHEMA)).collect() == []


def test_every_window_holds_an_anchor():
    rng = np.random.default_rng(3)
    token = rng.integers(0, 3, 4000).astype(np.uint64) * np.uint64(2**61 + 11)
    gram = spans.grams(token, 5)
    place = spans.anchors(gram, 9)
    assert np.diff(np.r_[-1, place, len(gram)]).max() <= 9
    runs = {}
    for i in range(len(token) - 4):
        runs.setdefault(tuple(token[i : i + 5].tolist()), set()).add(int(gram[i]))
    assert all(len(x) == 1 for x in runs.values()) and len(runs) == len({next(iter(x)) for x in runs.values()})


def plain_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs):
    got = simhash.near_duplicates(frame(spark, docs)).collect()
    want = {d[0]: plain_fingerprint(d[1]) for d in docs}
    assert {r.doc_id: r.fp % 2**64 for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == corpus.groups(want)


def test_spark_hashes_shingles_the_same_way(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] % 2**64 == xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("n", [2, 3, 40, 900])
def test_gray_index_finds_the_components_of_all_links(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**63, max(n // 15, 1), dtype=np.uint64)
    flip = [np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64) for _ in range(2)]
    codes = np.unique(base[rng.integers(0, len(base), n)] ^ flip[0] ^ flip[1])
    a, b = simhash.forest(codes)
    assert (np.bitwise_count(a ^ b) <= 3).all()
    up = {int(c): int(c) for c in codes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert root(x) != root(y)
        up[root(x)] = root(y)
    want = corpus.groups(dict(enumerate(codes.tolist())))
    assert len({root(int(c)) for c in codes}) == len(set(want.values()))


def test_one_document_stays(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text, 1), (2, text + " x", 2), (2, text + " x", 2), (9, None, 3), (7, "", 4), (None, "other words here", 5), (None, text, 6)]
    left = simhash.one_per_group(frame(spark, rows, "doc_id long, text string, fp long"))
    assert left.columns == ["doc_id", "text", "fp"]
    assert sorted(map(str, by_id(left).items())) == sorted(
        map(str, {2: (text + " x", 2), 7: ("", 4), None: ("other words here", 5)}.items())
    )
    assert simhash.one_per_group(frame(spark, [], corpus.SCHEMA)).collect() == []


def test_components_of_a_path_a_star_and_a_cycle(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = components.components(frame(spark, links, "a long, b long")).collect()
    roots = {}
    for r in got:
        roots.setdefault(r.root, set()).add(r.node)
    assert sorted(map(min, roots.values())) == [0, 100, 200] and sorted(map(len, roots.values())) == [3, 41, 51]


def test_lines_of_empty_tables_and_of_one_id_with_two_texts(spark):
    assert lines.dedup_lines(frame(spark, [], corpus.SCHEMA)).collect() == []
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "x\na\nb\nc\ny")]
    left = sorted(r.text for r in lines.dedup_lines(frame(spark, rows, "doc_id long, text string")).collect())
    # the same row twice is one document; another text under its id is another one, before or after it by its hash
    assert left in (["a\nb\nc", "a\nb\nc", "x\ny"], ["x\na\nb\nc\ny"])


def test_runs_shorter_than_three_lines_stay(spark):
    rows = [(1, "a\nb\n\nc\nd"), (2, "a\nb\nother\nc\nd"), (3, "zero\na\n  b \n\nc\nend")]
    left = by_id(lines.dedup_lines(frame(spark, rows, "doc_id long, text string")))
    assert left == {1: ("a\nb\n\nc\nd",), 2: ("a\nb\nother\nc\nd",), 3: ("zero\n\nend",)}


def test_large_buckets_are_split_without_losing_a_link(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    codes = {int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, 6)))) for b in base for _ in range(150)}
    frame_ = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "fp long")
    want = {tuple(sorted((a, b))) for a in codes for b in codes if a < b and (a ^ b).bit_count() <= simhash.DISTANCE}
    for most in (10**6, 8, 1):
        where = {}
        for r in simhash.dealt(frame_, most).collect():
            where.setdefault(int(np.int64(r.fp).view(np.uint64)), set()).add(r.bucket)
        assert set(where) == codes and all(where[a] & where[b] for a, b in want)


def plain_left(rows, length, split, within, text_hash):
    """What stays of each row where documents are ids (null first) and texts, in the order of the texts' hashes."""
    seen, left = {}, {}
    for own in sorted({(d is not None, d or 0, text_hash[t], t or "") for d, t in rows}):
        tokens = split(own[3])
        gone = [False] * len(tokens)
        windows = [tuple(tokens[i : i + length]) for i in range(len(tokens) - length + 1)]
        for i, window in enumerate(windows):
            if window in seen or (within and window in windows[:i]):
                gone[i : i + length] = [True] * length
        seen.update(dict.fromkeys(windows))
        left[own[0], own[1], own[3]] = [t for t, g in zip(tokens, gone, strict=True) if not g]
    return sorted(str(left[d is not None, d or 0, t or ""]) for d, t in rows)


@pytest.mark.parametrize("seed", range(3))
def test_rows_with_equal_or_no_ids_and_different_texts(spark, seed):
    rnd = np.random.default_rng(seed)
    parts = [" ".join(f"p{k}w{rnd.integers(10**6)}" for _ in range(20)) for k in range(6)]
    rows = []
    for i in range(24):
        own = [f"own{i}x{k}" for k in range(15)]
        text = " ".join([*own[:7], *(parts[int(p)] for p in rnd.integers(0, 6, rnd.integers(0, 4))), *own[7:]])
        rows.append((None if i % 3 == 0 else int(rnd.integers(5, 8)), text))
    rows += rows[:5] + [(7, None), (None, None), (5, "")]
    df = frame(spark, rows, "doc_id long, text string")
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(coalesce(text, '')) AS h").collect()}
    got = sorted(str(r.text.encode().split()) for r in automata.kept_text(df).collect())
    assert got == plain_left(rows, automata.LENGTH, lambda t: t.encode().split(), False, hashes)
    got = sorted(str(list(r.text.encode())) for r in substrings.kept_text(df).collect())
    assert got == plain_left(rows, substrings.LENGTH, lambda t: list(t.encode()), True, hashes)
    left = " ".join(r.text for r in automata.kept_text(df).collect())
    assert all(p in left for p in parts if any(p in (t or "") for _, t in rows))
