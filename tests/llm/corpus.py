"""Small documents with all the awkward cases, and plain versions of the operators to compare with."""

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(seed: int = 0, n: int = 60) -> list[tuple]:
    """Random documents that share lines, passages and whole texts, with nulls, empty and long texts among them."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["Straße", "naïve", "日本", "é", "You", "idiot"]
    lines = [" ".join(rnd.choices(words, k=rnd.randint(1, 12))) for _ in range(60)]
    passage = [rnd.choice(lines) for _ in range(6)]
    texts: list[str | None] = [None, "", " \n\t ", "a", "a b", "same same", "x" * 3000, "ab" * 400]
    for i in range(n):
        body = [rnd.choice(lines) for _ in range(rnd.randint(0, 12))]
        if i % 3 == 0:
            at = rnd.randint(0, len(body))
            body[at:at] = passage[: rnd.randint(2, 6)]
        texts.append("\n".join(body))
        if i % 5 == 0:
            texts.append(texts[-1] + rnd.choice(["", " tail", "\nlast line"]))
    texts.append("  ".join(rnd.choices(lines, k=400)))
    rnd.shuffle(texts)
    return [(i * 3, t, "en", f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def ordered(docs: list[tuple]) -> list[tuple[int, str]]:
    return sorted((d[0], d[1] or "") for d in docs)


def lines_left(docs: list[tuple], run: int = 3) -> dict[int, tuple]:
    seen, out = set(), {}
    for doc, text in ordered(docs):
        lines = text.split("\n")
        place = [i for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for k in range(len(place) - run + 1):
            content = tuple(lines[i].strip(" ") for i in place[k : k + run])
            if content in seen:
                gone.update(place[k : k + run])
            seen.add(content)
        out[doc] = len(place), len(gone), sha("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def bytes_left(docs: list[tuple], length: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for doc, text in ordered(docs):
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[doc] = len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)
    return out


def words_left(docs: list[tuple], length: int = 13) -> dict[int, tuple]:
    seen, out = set(), {}
    for doc, text in ordered(docs):
        words = text.encode().split()
        windows = [tuple(words[i : i + length]) for i in range(len(words) - length + 1)]
        gone = [False] * len(words)
        for i, window in enumerate(windows):
            if window in seen:
                gone[i : i + length] = [True] * length
        seen.update(windows)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc] = len(words), sum(gone), sha(kept)
    return out


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def benchmark_hits(docs: list[tuple], items: list[tuple], window: int = 10) -> dict[int, tuple]:
    out = {}
    wanted: dict[tuple, set] = {}
    for item, text in items:
        words = plain_words(text)
        size = min(len(words), window)
        for i in range(len(words) - size + 1 if size else 0):
            wanted.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    sizes = {len(w) for w in wanted}
    for doc, text, *_ in docs:
        words, hit, found = plain_words(text), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (own := wanted.get(tuple(words[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= own
        out[doc] = len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)
    return out


def groups(fingerprints: dict[int, int], distance: int = 3) -> dict[int, int]:
    """Smallest document reachable over links of at most `distance` bits."""
    label = {d: d for d in fingerprints}
    changed = True
    while changed:
        changed = False
        for a, x in fingerprints.items():
            for b, y in fingerprints.items():
                if (x ^ y).bit_count() <= distance and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label
