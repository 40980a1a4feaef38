"""Conversation repair against a plain version."""

import hashlib
import random
import re
import zlib

import pytest

from ipvigil.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string"
INK = re.compile("[^\x20\x09-\x0d]")


def damage(rows):
    out: dict = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        own += [] if case == 0 else [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit) by trying everything: all role sequences grow row by row; rows are (initial, must go, truncated)."""
    states = {"": (0, "")}
    follows = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def put(into, state, label):
        into[state] = min(into.get(state, label), label)

    def inserted(states):
        for _ in range(4):
            grown = dict(states)
            for state, (cost, audit) in states.items():
                for initial, to in follows[state].items():
                    if initial != "s":
                        put(grown, to, (cost + 5, audit + "I"))
            states = grown
        return states

    for initial, gone, cut in rows:
        after: dict = {}
        for state, (cost, audit) in inserted(states).items():
            put(after, state, (cost + 2, audit + "D"))
            for role, to in follows[state].items():
                if not gone and role == initial:
                    put(after, to, (cost + 5 * cut, audit + "K"))
                if not gone and role != "s":
                    put(after, to, (cost + 1 + 5 * cut, audit + "R"))
        states = after
    return min(label for state, label in inserted(states).items() if state in ("", "a"))


def plain(rows):
    out = {}
    for conv, own in damage(rows).items():
        own = sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, marked, faults = set(), [], [0, 0, 0]
        for _, role, text in own:
            blank, again = not INK.search(text), (role, text) in seen
            cut = not blank and not again and INK.findall(text)[-1] not in ".!?"
            faults = [f + x for f, x in zip(faults, (blank, again and not blank, cut))]
            seen.add((role, text))
            marked.append((role[:1], blank or again, cut))
        turns = {r[0] for r in own} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest(marked)
        left, i, last = [], 0, ""
        for edit in audit:
            if edit == "K":
                left.append(f"{own[i][1]}:{own[i][2]}")
                last = own[i][1][:1]
            elif edit in "RI":
                last = "a" if last == "u" else "u"
                left.append(("user:" if last == "u" else "assistant:") + (own[i][2] if edit == "R" else ""))
            i += edit != "I"
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def table(seed, n=40):
    rnd = random.Random(seed)
    texts = ["Fine.", "And you?", "cut off", "", " \t\n", None, "Yes!", "Really. \n", "No", "日本。", "ok."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "Sys"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rnd.choice([0, 1, 2, 3, 6, 9, 30])):
            rows.append((conv, rnd.choice([turn, turn, turn, turn + 5, None]), rnd.choice(roles[: rnd.choice([2, 5, 9])]), rnd.choice(texts) if rnd.random() < 0.5 else f"Text {rnd.random()}."))
    return rows + rnd.choices(rows, k=10)


def check(spark, rows, piece):
    df = spark.createDataFrame(rows, SCHEMA)
    made = conversations.reported(conversations.damaged(df), piece)
    assert made.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len({r[0] for r in got})
    assert {r[0]: r[1:] for r in got} == plain(rows)


@pytest.mark.parametrize(("seed", "piece"), [(0, 256), (1, 256), (2, 3), (3, 1), (4, 7)])
def test_against_plain(spark, seed, piece):
    check(spark, table(seed), piece)


def test_one_long_conversation(spark):
    rnd = random.Random(7)
    rows = [(5, t, rnd.choice(["user", "assistant"]), rnd.choice(["Same.", "Cut", f"Own {t}."])) for t in range(700)]
    check(spark, rows + [(6, 0, "user", "Hi."), (6, 1, "assistant", "Ho.")], 64)


def test_empty_table_and_conversations_that_lose_all_rows(spark):
    check(spark, [], 256)
    gone = [(c, 0, "user", "x.") for c in range(60)]
    assert any(not own for own in damage(gone).values())
    check(spark, gone, 256)


def test_search_agrees_with_growing_all_sequences():
    rnd = random.Random(3)
    for _ in range(400):
        signs = "".join(rnd.choice("suaoxUAS") for _ in range(rnd.randint(0, 14)))
        rows = [(c.lower() if c != "o" else "?", c == "x", c.isupper()) for c in signs]
        assert conversations.cheapest(signs) == cheapest(rows), signs


def test_messages_and_extra_columns(spark):
    rows = [(1, 0, "user", "Hi.", 3, "m"), (1, 1, "user", "There.", 4, "n"), (1, 2, "assistant", "Ho.", 5, "o"), (2, 0, "system", "S.", 6, "p")]
    df = spark.createDataFrame(rows, SCHEMA + ", case int, messages string")
    report, messages = conversations.repaired(conversations.undamaged(df))
    assert {r.conv_id: (r.cost, r.audit) for r in report.collect()} == {1: (2, "DKK"), 2: (2, "D")}
    assert {r.conv_id: [tuple(m) for m in r.messages] for r in messages.collect()} == {1: [("user", "There."), ("assistant", "Ho.")], 2: []}
    assert conversations.damaged(df).columns == ["conv_id", "turn", "role", "text", "gone"]
