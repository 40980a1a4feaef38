"""Line dedup of passages of one or two long lines against a plain version."""

import random

from ipvigil.llm import lines
from tests.llm import corpus


def plain(docs, run=3, words=50):
    seen, out = set(), {}
    for doc, text in sorted((d, t or "") for d, t in docs):
        all_lines = text.split("\n")
        place = [i for i, x in enumerate(all_lines) if x.strip(" ")]
        gone = set()
        for k in range(len(place)):
            for n in range(1, run + 1):
                own = place[k : k + n]
                content = tuple(all_lines[i].strip(" ") for i in own)
                if len(own) == n and (n == run or sum(len(x.split()) for x in content) > words):
                    if content in seen:
                        gone.update(own)
                    seen.add(content)
        if not place or len(gone) < len(place):
            out[doc] = "\n".join(x for i, x in enumerate(all_lines) if i not in gone)
    return out


def left(spark, docs, **how):
    made = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), **how)
    return {r.doc_id: r.text or "" for r in made.collect()}


def sentence(rnd, n):
    return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))


def test_one_or_two_long_lines_are_a_passage(spark):
    rnd = random.Random(1)
    one, a, b, short = (sentence(rnd, n) for n in (51, 30, 21, 50))
    docs = [
        (1, f"{one}\nx\n{a}\n\n{b}\ny\n{short}"),
        (2, one),
        (3, f"new\n  {one} \nend"),
        (4, f"new\n{a}\n{b}"),
        (5, f"{a}\nother\n{short}"),
    ]
    want = {1: docs[0][1], 3: "new\nend", 4: "new", 5: docs[4][1]}
    assert left(spark, docs, words=50) == want == plain(docs)
    assert left(spark, docs)[2] == one  # without the word bound a copy of one line is never compared


def test_passages_among_runs(spark):
    rnd = random.Random(2)
    pool = [sentence(rnd, rnd.choice([1, 4, 20, 26, 45, 51, 60])) for _ in range(40)]
    docs = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 7)))) for i in range(60)]
    docs += [(100 + d[0], d[1]) for d in corpus.rows(4)]
    assert left(spark, docs, words=50) == plain(docs)
