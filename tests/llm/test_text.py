"""Decontamination, archives, phrase fingerprints, license scans, pieces, toxicity and the pipeline."""

import gzip
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ipvigil.llm import decontaminate, licences, phrases, pieces, queries, simhash, toxicity, warc
from tests.conftest import SMALL
from tests.llm import corpus
from tests.llm.test_alike import kept as alike_left
from tests.llm.test_passages import plain as passages_left
from tests.llm.test_dedup import by_id, frame, plain_fingerprint


def items(docs):
    rnd = random.Random(4)
    texts = [d[1] for d in docs if d[1] and len(d[1].split()) > 15]
    out = [(0, None), (1, ""), (2, "..."), (3, "w1 W2"), (3, "w1 W2"), (4, "nowhere to be found"), (None, "idiot, you!")]
    for i in range(12):
        words = rnd.choice(texts).split()
        at = rnd.randrange(len(words) - 12)
        out.append((10 + i, " ".join(words[at : at + rnd.choice([4, 9, 10, 12])]).upper() + (" zzz yyy" if i % 2 else "")))
    return out


@pytest.mark.parametrize("block_words", [1 << 20, 30])
def test_benchmark_hits(spark, block_words):
    docs = corpus.rows(2)
    bench = items(docs)
    df = frame(spark, docs).withColumn("spans", F.lit("mine")).withColumn("items_before", F.lit(1))
    made = decontaminate.matched(df, frame(spark, bench, "item_id long, text string"), ["doc_id", "spans", "items_before"], block_words=block_words)
    got = {}
    for r in made.collect():
        ranges = list(zip(r.spans_[::2], r.spans_[1::2], strict=True))
        assert all(a < b for a, b in ranges) and all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:], strict=False))
        listed = corpus.sha(",".join(r["items"]))
        got[r.doc_id] = r.n_words, sum(b - a for a, b in ranges), len(r["items"]), listed, bool(ranges)
        assert r.spans == "mine"
    named = [("" if i is None else i, t) for i, t in bench]
    assert got == corpus.benchmark_hits(docs, named) and any(v[4] for v in got.values())


def test_longest_match_reaches_over_windows(spark):
    words = [f"t{i}" for i in range(40)]
    docs = frame(spark, [(1, " ".join(["x", *words[5:30], "y", *words[:12]])), (2, "t1 t2")], "doc_id long, text string")
    bench = frame(spark, [(7, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (r.longest, r.spans) for r in decontaminate.matched(docs, bench, ["doc_id"]).collect()}
    assert got == {1: (25, [1, 26, 27, 39]), 2: (0, [])}


def test_no_benchmark_and_no_documents(spark):
    docs, bench = frame(spark, corpus.rows(2)), frame(spark, [], "item_id long, text string")
    assert decontaminate.clean(docs, bench).count() == docs.count()
    assert decontaminate.clean(docs.limit(0), frame(spark, [(1, "a")], "item_id long, text string")).count() == 0


def page_rows():
    rnd = random.Random(5)
    long = "".join(rnd.choices("abcé日\r\n ", k=60_000))
    same = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n\r\n</p>"
    return [
        (1, "http://a/é?q=1", same), (2, "http://b", long), (3, None, None), (4, "http://c", ""), (5, "http://d", same),
        (6, "http://e\r\nX: y", long), (7, "f", "short"), (8, "g", "short"), (9, "h", "y" * 99), (10, "i", "y" * 99), (9, "h", "z" * 100),
        (9, "h", "z" * 100), (None, "n", same), (12, "p", "q" * 16_000),
    ]


def test_archives_round_trip(spark, tmp_path):
    rows = page_rows()
    warc.write(frame(spark, rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w")).collect()
    first = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            first[html] = min(page, first.get(html, page))
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = html in first and page != first[html]
        want.append((page, len(data), corpus.sha(data), "revisit" if again else "response", first[html] if again else None, True))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_archive_files_are_valid_records(spark, tmp_path):
    warc.write(frame(spark, page_rows(), "page_id long, url string, html string"), str(tmp_path / "w"))
    kinds = []
    for file in (tmp_path / "w").glob("*.gz"):
        data = gzip.decompress(file.read_bytes())
        for fields, block in warc.parsed(data):
            assert fields["warc-record-id"].startswith("<urn:uuid:") and int(fields["content-length"]) == len(block) <= warc.SEGMENT
            kinds.append(fields["warc-type"])
    assert set(kinds) == {"response", "revisit", "continuation"} and kinds.count("continuation") >= 4


def test_broken_segments_are_told(spark):
    block = warc._HTTP + warc.chunked(b"z" * 500)
    digest = corpus.sha(b"z" * 500)

    def rows(cut):
        pieces_ = [block[:300], block[300:]]
        base = {"type": "continuation", "origin": "o", "total": None, "payload_digest": ""}
        made = [base | {"number": i + 1, "block": b} for i, b in enumerate(pieces_)]
        made[0] |= {"type": "response", "page_id": 3, "payload_digest": digest}
        made[1] |= {"total": len(block)}
        return pa.Table.from_pylist(cut(made), warc._SCHEMA)

    def sound(cut):
        return warc._assembled(rows(cut)).to_pylist()[0]["intact"]

    assert sound(lambda x: x[::-1])
    assert not sound(lambda x: x[:1])
    assert not sound(lambda x: [x[0], x[1] | {"number": 3}])
    assert not sound(lambda x: [x[0], x[1] | {"total": 1}])
    assert not sound(lambda x: [x[0], x[1] | {"block": x[1]["block"][:-9]}])
    assert warc.unchunked(b"5;name=v\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nhel")


def test_a_revisit_names_its_response(spark, tmp_path):
    rows = [(5, "http://five", "x" * 200), (3, "http://three", "x" * 200), (9, None, "x" * 200)]
    warc.write(frame(spark, rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    found = [f for file in (tmp_path / "w").glob("*.gz") for f, _ in warc.parsed(gzip.decompress(file.read_bytes())) if f["warc-type"] == "revisit"]
    assert {(f["warc-page-id"], f["warc-refers-to-page-id"], f["warc-refers-to-target-uri"]) for f in found} == {("5", "3", "http://three"), ("9", "3", "http://three")}
    # a revisit whose response is not there is no longer intact
    lone = gzip.compress(b"".join(warc.record("revisit", warc._HTTP, {"WARC-Record-ID": "<r>", "WARC-Page-ID": 9, "WARC-Refers-To-Page-ID": 3}) + warc.END for _ in range(1)))
    (tmp_path / "lone").mkdir()
    (tmp_path / "lone" / "a.gz").write_bytes(lone)
    (row,) = warc.read(spark, str(tmp_path / "lone")).collect()
    assert (row.page_id, row.refers_to, row.intact, row.payload_bytes) == (9, 3, False, None)


def test_decoded_keeps_a_column_that_is_named_text(spark):
    docs = frame(spark, [(1, "some words"), (2, None)], "doc_id long, text string")
    model = pieces.model_bytes()
    made = pieces.decoded(pieces.encoded(docs, model, ["doc_id", "text"]), model)
    assert made.columns == ["doc_id", "text", "ids", "round_trip", "text_"]
    assert {r.doc_id: (r["text"], r.text_) for r in made.collect()} == {1: ("some words", "some words"), 2: (None, "")}
    empty = pieces.encoded(frame(spark, [], "doc_id long, text string, ids long"), model, ["doc_id", "ids"])
    assert empty.columns == ["doc_id", "ids", "ids_", "round_trip"] and empty.collect() == []


def test_no_pages(spark):
    assert warc.archived(frame(spark, [], "page_id long, url string, html string")).collect() == []


def plain_phrases(data: bytes) -> set[bytes]:
    found, at = set(), 0
    while at < len(data):
        end = at + 1
        while end < len(data) and data[at:end] in found:
            end += 1
        found.add(data[at:end])
        at = end
    return found


def plain_signature(data: bytes) -> np.ndarray:
    return phrases.smallest(phrases.hashed(sorted(plain_phrases(data))))


def test_phrases_with_next(spark):
    docs = corpus.rows(3)
    want, order = {}, sorted((d[0], d[1] or "") for d in docs)
    for (doc, text), (_, other) in zip(order, order[1:] + order[:1], strict=True):
        part = len(text) // 4
        edited = text[: len(text) - part] + other[:part]
        own, new, after = (plain_signature(x.encode()) for x in (text, edited, other))
        want[doc] = (
            len(text), corpus.sha(edited), phrases.text_of(own), phrases.text_of(new),
            phrases.likeness(own, new), phrases.likeness(own, after),
        )
    for ranges in (1, 7, 200):
        assert by_id(phrases.with_next(frame(spark, docs), ranges)) == want
    alone = by_id(phrases.fingerprinted(frame(spark, docs), ["doc_id"]))
    assert {k: v[0] for k, v in alone.items()} == {k: v[2] for k, v in want.items()}


def test_phrases_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert phrases.with_next(frame(spark, [], schema)).collect() == []
    one = phrases.with_next(frame(spark, [(5, "abcdefgh")], schema)).collect()
    assert len(one) == 1 and one[0].edited_sha256 == corpus.sha("abcdefab") and one[0].near_next == 1.0
    rows = [(None, "nullid"), (2, "tie one two"), (2, "tie one two"), (2, "other tie"), (9, None)]
    got = phrases.with_next(frame(spark, rows, schema), 3).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == ["2", "2", "2", "9", "None"]
    assert len({r.fingerprint for r in got}) == 4


def test_licences(spark):
    rnd = random.Random(6)
    noise = [f"n{i}" for i in range(50)]
    names = sorted(licences.TEMPLATES)
    docs = [(0, None), (1, ""), (2, "Licensed under"), (3, "Licensed under the Apache License Version two")]
    for i in range(120):
        words = rnd.choices(noise, k=rnd.choice([0, 3, 40, 400]))
        for name in rnd.sample(names, rnd.randint(0, 2)):
            own = licences.TEMPLATES[name].upper().split()
            for _ in range(rnd.choice([0, 0, 1, len(own) // 3])):
                own[rnd.randrange(len(own))] = "changed"
            at = rnd.randint(0, len(words))
            words[at:at] = own
        docs.append((10 + i, " ".join(words)))
    got = {r.doc_id: {x["name"]: x["containment"] for x in r.licences} for r in licences.scanned(frame(spark, docs, "doc_id long, text string"), ["doc_id"]).collect()}

    def shingles(text):
        words = corpus.plain_words(text)
        return [tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1 if words else 0))]

    known = {n: set(shingles(t)) for n, t in licences.TEMPLATES.items()}
    for doc, text in docs:
        own, best = shingles(text), {}
        for name, wanted in known.items():
            width = 4
            while width * 3 / 4 < len(wanted):
                width *= 2
            starts = range(0, max(len(own), 1), width // 4)
            share = max(len(wanted & set(own[a : a + width])) / len(wanted) for a in starts)
            if share >= licences.THRESHOLD:
                best[name] = share
        assert got[doc] == pytest.approx(best), doc


ODD = [
    "", " ", "  a  b ", "▁x▁▁ y", "a\tb\nc\r\n", "日本語 😀😀 \x01 zzz", "<s> </s> <unk> <0x0A>", "a" * 5000, " " * 300 + "b",
    "x " * 70000, "é ﬁ Å", " lead", "\n\n", "aaa aaaa  aaaaa   aaaaaa", "word", "two words", "word " * 9000 + "  end",
]


def test_pieces_agree_with_sentencepiece():
    rnd = random.Random(7)
    texts = ODD + ["".join(rnd.choices("ab cde éßñ日 \n\t.,!1", k=rnd.randint(0, 300))) for _ in range(300)]
    assert pieces.parity(texts) == []


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def test_unigram_models_agree_too(tmp_path):
    """A hand-written unigram model: scores, unknown piece and byte fallback."""
    vocabulary = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))]
    words = ["▁", "▁a", "a", "b", "ab", "▁ab", "abc", "c", "▁abcab", "cab", "ca", "▁b"]
    vocabulary += [(w, -1.0 - 0.37 * i, 1) for i, w in enumerate(words)]
    body = b"".join(
        _message(1, _message(1, w.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", s) + _varint(3 << 3) + _varint(t)) for w, s, t in vocabulary
    )
    trainer = b"".join(_varint(n << 3) + _varint(v) for n, v in ((3, 1), (35, 1), (40, 0), (41, 1), (42, 2)))
    normaliser = _message(1, b"identity") + b"".join(_varint(n << 3) + _varint(v) for n, v in ((3, 1), (4, 0), (5, 1)))
    path = tmp_path / "tiny.model"
    path.write_bytes(body + _message(2, trainer) + _message(3, normaliser))
    assert pieces.parse(path.read_bytes()).model_type == pieces.UNIGRAM
    assert pieces.parity(["ab abcab cab", "abcabcabcab", "é a", "", "b  a c", "xyz"], str(path)) == []


def test_encoding_rows(spark):
    rows = [(i, t, i) for i, t in enumerate([None, *ODD])]
    made = pieces.encoded(frame(spark, rows, "doc_id long, text string, ids long"), pieces.model_bytes(), ["doc_id", "ids"])
    assert made.columns == ["doc_id", "ids", "ids_", "round_trip"]
    got = by_id(made)
    assert got[0][1] == [] and {ODD[k - 1] for k, v in got.items() if not v[2]} == {"▁x▁▁ y"}
    back = pieces.decoded(made, pieces.model_bytes(), "ids_", "back").collect()
    assert all(r.back == (rows[r.doc_id][1] or "").replace("▁", " ") for r in back)
    with pytest.raises(ValueError):
        pieces.parse(b"\x0a\x7f")


def test_toxicity_on_held_out_documents(spark):
    folder = SMALL.replace("0.001", "0.1")
    scored = queries.QUERIES["op8_toxicity"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    got = scored.join(labels, "doc_id").filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in got}
    assert share[1] > 0.85 and share[0] < 0.02
    assert scored.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert scored.count() == 10_000


def test_toxicity_of_odd_tables(spark):
    docs = frame(spark, corpus.rows(1) + [(None, "idiot", "en", "s", 5)])
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    made = toxicity.score(docs, toxicity.fit(docs, none), ["doc_id", "text"]).collect()
    assert len(made) == docs.count() and {r.score for r in made} == {0.0}
    one = frame(spark, [(3, 1, 1), (3, 1, 0), (6, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    kept = toxicity.without_toxic(docs.withColumn("toxic_score", F.lit(9)), one)
    assert kept.columns == [*corpus.SCHEMA.replace(" long", "").replace(" string", "").split(", "), "toxic_score"]
    assert toxicity.score(docs.limit(0), toxicity.Model(), ["doc_id"]).collect() == []


def test_features_count_what_they_say(spark):
    texts = ["You idiot! 1d10t", "PLAIN words here", "", "idiot far away from the pronoun here is you"]
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: dict(zip(toxicity.FEATURES, r.f, strict=True)) for r in toxicity.features(df, "text", np.zeros(0, np.uint64), np.zeros(0), "f", ["doc_id"]).collect()}
    assert got[0]["insults"] == pytest.approx(1 / 3) and got[0]["unmasked"] == pytest.approx(1 / 3)
    assert got[0]["near_second_person"] == pytest.approx(2 / 3) and got[0]["second_person"] == pytest.approx(1 / 3)
    assert got[1]["shouted"] == pytest.approx(1 / 3) and got[1]["insults"] == 0
    assert got[2]["length"] == 0 and got[2]["capitals"] == 0
    assert got[3]["insults"] > 0 and got[3]["near_second_person"] == 0


def test_pipeline_stages_against_plain_versions(spark):
    folder = SMALL
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "near duplicates", "decontamination", "encoding"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: tuple(r) for r in docs.collect()}
        made = spark.createDataFrame(stage(spark, docs, folder).collect(), stage(spark, docs, folder).schema)
        after = {r.doc_id: tuple(r) for r in made.collect()}
        assert len(after) == made.count()
        rows = [(d, v[1]) for d, v in before.items()]
        if name != "encoding":
            assert made.columns == docs.columns
        if name == "line dedup":
            assert {d: v[1] or "" for d, v in after.items()} == passages_left(rows)
        if name == "near duplicates":
            assert set(after) == alike_left(rows)
        if name == "decontamination":
            hits = corpus.benchmark_hits(rows, bench)
            assert set(after) == {d for d, v in hits.items() if not v[4]} != set(before)
        if name == "encoding":
            assert all(r.round_trip and r.n_tokens == len(r.ids) for r in made.collect()) and set(after) == set(before)
        docs = made
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_keeps_extra_columns_and_odd_rows(spark, tmp_path):
    rows = [(None, None, "en", "s", None, 1), (None, "", "en", "s", 0, 2), (4, "some words", "en", "s", 10, 3), (4, "some words", "en", "s", 10, 3)]
    docs = frame(spark, rows, corpus.SCHEMA + ", ids long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    frame(spark, [(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame(spark, [], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.ids, r.n_tokens) for r in got)[-1][0] == 3 and len(got) == 2
