"""Repair of the turn structure of conversations: bidirectional Dijkstra over the lattice of edits.

A repaired conversation's role initials read `(s?(ua)+)?`. A node of the lattice is a number of rows done and one of four
states: nothing said yet, system said, user said, assistant said. Edges are Keep (0), Rerole to user or assistant (1),
Delete (2; the only edit of a blank or repeated row) and Insert an empty user or assistant message (5, anywhere); keeping
or reroling a truncated row costs 5 more. Forward and reverse heaps meet; all crossings of the least cost are finished,
and the ASCII-least of their joined audits (initials of the edits in order) is taken. Equal-cost audits between the same
nodes are never prefixes of each other, so least halves make least wholes.

Rows are range-partitioned by conversation and turn, so a conversation of any size lies in neighbouring tasks. One that
lies inside a task with at most PIECE rows is repaired there. All others go on as pieces of at most PIECE rows: repeats
are found across pieces by grouping digests, every piece is solved from each state to each state in parallel, and the
pieces' tables (16 costs and audits) are joined in order. A task never holds more than a piece and, of one conversation,
the audits that end in each state; a long conversation's repaired rows stay one row per message.

Order: turn (null first), then MD5 of length, role and text (so that range bounds stay small). Defined results: a null role or text is one space; a null conv_id is a conversation;
an empty role has no initial, so it cannot be kept; equal rows repeat each other; a conversation without rows has no fault,
costs nothing and is empty. Only the four columns are read, whatever others there are.
"""

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ipvigil.llm.frames import cut_lineage

#: Rows of a conversation that are solved at once.
PIECE = 256
WHITE = " \t\n\v\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States, and for each the role that Insert and Rerole may give and the state after it.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KEPT = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Where a whole conversation may end.
ENDS = (NOTHING, ASSISTANT)
LEGAL = {"su", "ua", "au"}
NEVER = float("inf")

Label = tuple[int, str]


def _edges(sign: str, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, rows done, next state) from a state, where the next row has `sign`; "" after the last row.

    A sign is `x` for a row that must go, else its role initial, in capitals if the row is truncated.
    """
    out = [("I", INSERT, 0, NEXT[state][1])]
    if sign:
        out.append(("D", DELETE, 1, state))
    if sign and sign != "x":
        extra = TRUNCATED if sign.isupper() else 0
        out.append(("R", REROLE + extra, 1, NEXT[state][1]))
        if (to := KEPT.get((state, sign.lower()))) is not None:
            out.append(("K", KEEP + extra, 1, to))
    return out


class _Half:
    """One direction of the search. Nodes leave the heap by cost and distance in rows, so all edges that lead to a node
    at no cost are relaxed before it leaves, and its audit is the least of its cost then."""

    def __init__(self, starts: list[tuple[int, int]]):
        self.labels: dict[tuple[int, int], Label] = dict.fromkeys(starts, (0, ""))
        self.settled: dict[tuple[int, int], Label] = {}
        self.heap = [(0, 0, node) for node in starts]

    def top(self) -> float:
        while self.heap and (self.heap[0][2] in self.settled or self.labels[self.heap[0][2]][0] < self.heap[0][0]):
            heappop(self.heap)
        return self.heap[0][0] if self.heap else NEVER

    def settle(self) -> tuple[tuple[int, int], Label]:
        _, _, node = heappop(self.heap)
        self.settled[node] = label = self.labels[node]
        return node, label

    def relax(self, node: tuple[int, int], label: Label, far: int) -> None:
        old = self.labels.get(node)
        if node not in self.settled and (old is None or label < old):
            self.labels[node] = label
            heappush(self.heap, (label[0], far, node))


@lru_cache(1 << 15)
def cheapest(signs: str, entry: int = NOTHING, exits: tuple[int, ...] = ENDS) -> Label | None:
    """Least cost and ASCII-least audit that lead a row of signs from one state to one of `exits`; None if nothing does."""
    n = len(signs)
    ahead, back = _Half([(0, entry)]), _Half([(n, s) for s in exits])
    into: dict[int, list] = {i: [] for i in range(n + 1)}
    out = {}
    for i in range(n + 1):
        for state in NEXT:
            out[i, state] = [(edit, cost, (i + rows, to)) for edit, cost, rows, to in _edges(signs[i : i + 1], state)]
            for edit, cost, node in out[i, state]:
                into[node[0]].append((node[1], edit, cost, (i, state)))
    best: Label | None = None

    def met(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or (cost, audit) < best:
            best = cost, audit

    while (tops := (ahead.top(), back.top())) != (NEVER, NEVER) and (best is None or sum(tops) <= best[0]):
        if tops[0] <= tops[1]:
            node, (cost, audit) = ahead.settle()
            if node in back.settled:
                met(cost + back.settled[node][0], audit + back.settled[node][1])
            for edit, price, to in out[node]:
                ahead.relax(to, (cost + price, audit + edit), to[0])
                if to in back.settled:
                    met(cost + price + back.settled[to][0], audit + edit + back.settled[to][1])
        else:
            node, (cost, audit) = back.settle()
            if node in ahead.settled:
                met(cost + ahead.settled[node][0], ahead.settled[node][1] + audit)
            for state, edit, price, source in into[node[0]]:
                if state == node[1]:
                    back.relax(source, (cost + price, edit + audit), n - source[0])
                    if source in ahead.settled:
                        met(ahead.settled[source][0] + price + cost, ahead.settled[source][1] + edit + audit)
    return best


def edited(rows: list[tuple[str, str]], audit: str, state: int = NOTHING) -> list[tuple[str, str]]:
    """(role, text) of what an audit leaves of rows."""
    out, i = [], 0
    for edit in audit:
        if edit == "K":
            state = KEPT[state, rows[i][0][:1]]
            out.append(rows[i])
        elif edit != "D":
            role, state = NEXT[state]
            out.append((role, rows[i][1] if edit == "R" else ""))
        i += edit != "I"
    return out


def signed(rows: list[tuple[str, str]], repeats: list[bool]) -> tuple[str, list[int]]:
    """Signs of rows, and how many are blank, repeated, truncated (the first fault of each counts)."""
    signs, faults = [], [0, 0, 0]
    for (role, text), again in zip(rows, repeats, strict=True):
        left = text.rstrip(WHITE)
        cut = bool(left) and left[-1] not in ".!?"
        if not left or again:
            faults[0 if not left else 1] += 1
            signs.append("x")
            continue
        faults[2] += cut
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        signs.append(initial.upper() if cut else initial)
    return "".join(signs), faults


def _illegal(rows: list[tuple[str, str]]) -> int:
    return sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(rows, rows[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that CRC-32 of `conv_id:turn` deals; a dropped row stays, marked `gone`."""
    key = F.concat(*(F.coalesce(x, F.lit(" ")) for x in (F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))))
    case = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.select("conv_id", "turn", F.when(case == 4, "user").otherwise(role).alias("role"), text.alias("text"), case.alias("case"))
    copies = F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", "role", "text", (F.col("case") == 0).alias("gone"), copies).drop("copy")


def undamaged(conversations: DataFrame) -> DataFrame:
    """Conversations as they are, in the form that `repaired` takes."""
    role, text = (F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))
    return conversations.select("conv_id", "turn", role, text, F.lit(False).alias("gone"))


_MESSAGES = "array<struct<role string, text string>>"
_STEP = ["major", "minor", "entry", "exit"]
_PATH = f"array<struct<{', '.join(f'{n} int' for n in _STEP)}>>"
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_FIRST = f"whole boolean, conv_id long, {_REPORT}, messages {_MESSAGES}, major int, minor int, at int, turn long, role string, text string, gone boolean, digest string, again boolean"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_KINDS = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}
_KINDS |= {f"array<{k}>": pa.list_(v) for k, v in _KINDS.items()}
_KINDS |= {_MESSAGES: pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])), _PATH: pa.list_(pa.struct([(n, pa.int32()) for n in _STEP]))}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(x.split(" ", 1)[0], _KINDS[x.split(" ", 1)[1]]) for x in re.split(r", (?![^<]*>)", ddl)])


def _gaps(turns: list[int | None]) -> int:
    own = {t for t in turns if t is not None}
    return max(own) - min(own) + 1 - len(own) if own else 0


def _repeats(rows: list[tuple[str, str]]) -> list[bool]:
    seen: set = set()
    return [r in seen or seen.add(r) is not None for r in rows]


def _whole(turns: list, rows: list[tuple[str, str]]) -> tuple:
    """The report and messages of a conversation."""
    signs, faults = signed(rows, _repeats(rows))
    cost, audit = cheapest(signs)
    messages = [{"role": r, "text": t} for r, t in edited(rows, audit)]
    return _gaps(turns), *faults, _illegal(rows), cost, audit, messages


def _first(piece: int):
    """Rows in order: a finished conversation as one row, all others as rows of numbered pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, major = _arrow(_FIRST), TaskContext.get().partitionId()
        out: list[tuple] = []
        held: list[tuple] = []
        conv, minor, inside = None, 0, False

        def cut() -> None:
            nonlocal minor
            pairs = [(r[1], r[2]) for r in held]
            again = iter(_repeats([p for p, r in zip(pairs, held, strict=True) if not r[3]]))
            for at, (turn, role, text, gone, digest) in enumerate(held):
                out.append((False, conv, *[None] * 8, major, minor, at, turn, role, text, gone, digest, not gone and next(again)))
            minor += 1

        def close(last: bool) -> None:
            if minor or last or not inside:
                cut()
            else:
                kept = [r for r in held if not r[3]]
                out.append((True, conv, *_whole([r[0] for r in kept], [(r[1], r[2]) for r in kept]), *[None] * 9))

        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and own != conv:
                    close(False)
                    held, minor, inside = [], 0, True
                elif len(held) == piece:
                    cut()
                    held = []
                conv = own
                held.append(tuple(row))
            if len(out) >= 1000:
                yield _batch(out, schema)
                out = []
        if held:
            close(True)
        if out:
            yield _batch(out, schema)

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Sorted rows, grouped by their first `keys` columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != key:
                yield key, held
                held = []
            key = row[:keys]
            held.append(row[keys:])
    if held:
        yield key, held


_STATES = [(e, x) for e in NEXT for x in NEXT if x != NOTHING or e == NOTHING]
_SOLVED = "conv_id long, major int, minor int, n int, turns array<long>, faults array<long>, ends array<string>, costs array<long>, audits array<string>"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every piece from each state to each state: (turn, role, text, gone, again) by conv_id, major, minor."""
    schema = _arrow(_SOLVED)
    for key, group in _groups(batches, 3):
        rows = [r[2:] for r in group if not r[4]]
        pairs = [(r[0], r[1]) for r in rows]
        signs, faults = signed(pairs, [r[3] for r in rows])
        found = [cheapest(signs, e, (x,)) or (None, None) for e, x in _STATES]
        own = sorted({r[1] for r in group if not r[4] and r[1] is not None})
        turns = [own[0], own[-1], len(own)] if own else []
        ends = [pairs[0][0][:1], pairs[-1][0][:1]] if pairs else []
        costs, audits = zip(*found, strict=True)
        yield _batch([(*key, len(pairs), turns, [*faults, _illegal(pairs)], ends, list(costs), list(audits))], schema)


_JOINED = f"conv_id long, {_REPORT}, path {_PATH}"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to conversations: the best cost and audit that end in each state, piece by piece."""
    schema = _arrow(_JOINED)
    key, started = None, False
    best: dict[int, tuple[int, str, tuple | None]] = {}
    faults, low, high, distinct, last = [0] * 4, None, None, 0, None

    def done() -> pa.RecordBatch:
        exit_, (cost, audit, link) = min(((s, b) for s, b in best.items() if s in ENDS), key=lambda x: x[1][:2])
        path = []
        while link is not None:
            link, step = link
            path.append(dict(zip(_STEP, step, strict=True)))
        gaps = 0 if low is None else high - low + 1 - distinct
        return _batch([(key, gaps, *faults, cost, audit, path[::-1])], schema)

    for batch in batches:
        for conv, major, minor, _, turns, more, ends, costs, audits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if started and conv != key:
                yield done()
                started = False
            if not started:
                key, started, best = conv, True, {NOTHING: (0, "", None)}
                faults, low, high, distinct, last = [0] * 4, None, None, 0, None
            after: dict[int, tuple] = {}
            for (entry, exit_), cost, audit in zip(_STATES, costs, audits, strict=True):
                if entry in best and cost is not None:
                    total = best[entry][0] + cost
                    if exit_ in after and total > after[exit_][0]:
                        continue
                    new = total, best[entry][1] + audit, (best[entry][2], (major, minor, entry, exit_))
                    if exit_ not in after or new[:2] < after[exit_][:2]:
                        after[exit_] = new
            best = after
            faults = [a + b for a, b in zip(faults, more, strict=True)]
            if ends:
                faults[3] += last is not None and last + ends[0] not in LEGAL
                last = ends[1]
            if turns:
                distinct += turns[2] - (high == turns[0])
                low, high = turns[0] if low is None else low, turns[1]
    if started:
        yield done()


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages of every piece: (turn, role, text, gone, again, entry, exit) by conv_id, major, minor."""
    schema = _arrow(f"conv_id long, major int, minor int, messages {_MESSAGES}")
    for key, group in _groups(batches, 3):
        rows = [r for r in group if not r[4]]
        pairs = [(r[2], r[3]) for r in rows]
        entry, exit_ = group[0][6:8]
        signs, _ = signed(pairs, [r[5] for r in rows])
        audit = cheapest(signs, entry, (exit_,))[1]
        yield _batch([(*key, [{"role": r, "text": t} for r, t in edited(pairs, audit, entry)])], schema)


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest")]


def repaired(rows: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """Report and messages of conversations (conv_id, turn, role, text, gone), as `damaged` or `undamaged` give them.

    Report: one row per conv_id with gaps, blank, duplicate, truncated, illegal, cost and audit. Messages: conv_id, major,
    minor, messages; a conversation is what its rows hold, in the order of major and minor.
    """
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("digest")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "gone", digest)
    spread = rows.repartitionByRange(*_order(), F.monotonically_increasing_id()).sortWithinPartitions(*_order())
    first = cut_lineage(spread.mapInArrow(_first(piece), _FIRST), "conversations")
    report = ["conv_id", *[x.split()[0] for x in _REPORT.split(", ")]]
    parts = first.filter("NOT whole").select("conv_id", "major", "minor", "at", "turn", "role", "text", "gone", "digest", "again")

    # a row that is new in its piece is compared with the first piece that has it: at most one row per piece and digest
    fresh = parts.filter("NOT gone AND NOT again")
    where = F.struct("major", "minor")
    earliest = fresh.groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("what")).agg(F.min(where).alias("earliest"))
    known = fresh.join(earliest, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("what")))
    known = known.withColumn("again", where != F.col("earliest")).select(*parts.columns)
    parts = cut_lineage(known.unionByName(parts.filter("gone OR again")), "conversation-pieces")

    piece_of = ["conv_id", "major", "minor"]
    columns = [*piece_of, "at", "turn", "role", "text", "gone", "again"]
    solved = parts.select(*columns).repartition(*piece_of).sortWithinPartitions(*piece_of, "at").mapInArrow(_solved, _SOLVED)
    joined = solved.repartition("conv_id").sortWithinPartitions(*piece_of).mapInArrow(_joined, _JOINED)
    joined = cut_lineage(joined, "conversation-paths")
    path = joined.select(F.col("conv_id").alias("of"), F.explode("path").alias("p")).select("of", "p.*")
    path = path.withColumnsRenamed({"major": "major_of", "minor": "minor_of"})
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("major") == F.col("major_of")) & (F.col("minor") == F.col("minor_of"))
    chosen = parts.join(path, same).select(*columns, "entry", "exit")
    chosen = chosen.repartition(*piece_of).sortWithinPartitions(*piece_of, "at")
    rendered = chosen.mapInArrow(_rendered, f"conv_id long, major int, minor int, messages {_MESSAGES}")
    whole = first.filter("whole")
    messages = whole.select("conv_id", F.lit(0).alias("major"), F.lit(0).alias("minor"), "messages").unionByName(rendered)
    return whole.select(*report).unionByName(joined.select(*report)), messages


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the messages of each conversation, streamed; only the hash's state is held."""
    schema = _arrow("conv_id long, repaired_sha256 string")
    key, digest, empty = None, None, True
    for batch in batches:
        for conv, messages in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest is not None and conv != key:
                yield _batch([(key, digest.hexdigest())], schema)
                digest = None
            if digest is None:
                key, digest, empty = conv, hashlib.sha256(), True
            for m in messages:
                digest.update(("" if empty else "\n").encode() + f"{m['role']}:{m['text']}".encode())
                empty = False
    if digest is not None:
        yield _batch([(key, digest.hexdigest())], schema)


def digests(messages: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256. A hash runs over a conversation from its start to its end, so the pieces of one pass
    through one task, one at a time."""
    order = ["conv_id", "major", "minor"]
    rows = messages.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "messages")
    return rows.mapInArrow(_digests, "conv_id long, repaired_sha256 string")


def reported(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The report with repaired_sha256, the digest of `role:text` of all messages, joined by newlines."""
    report, messages = repaired(rows, piece)
    found = digests(messages).withColumnRenamed("conv_id", "of")
    return report.join(found, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
