"""Word-wise substring dedup with suffix automata: documents are streamed for matching statistics.

`repeats` deals passages that may repeat to shards by their anchors, so a shard holds all passages that can match each
other, and nothing unbounded is sent to every task. In a shard the passages come in the order of their documents. Each
is first streamed through the suffix automaton of the passages from smaller doc_ids, which gives for every word the
length of the longest match that ends there; where it reaches `LENGTH` words, the last `LENGTH` words are covered. Then
the passage joins the automaton. Words are compared themselves, not by hashes, in this step.

Defined results: a null text has no words; a null doc_id comes first; rows that repeat a doc_id and its text are one
document; rows that repeat it with another text are documents of their own, ordered by a hash of the text, so that one
copy of every passage stays.
"""

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame

from ipvigil.llm import repeats

LENGTH = 13
KIND = repeats.Kind(words=True, window=LENGTH, gram=4, within=False)


class Automaton:
    """Suffix automaton of several sequences; state 0 is the empty match."""

    __slots__ = ("follow", "length", "link")

    def __init__(self):
        self.follow: list[dict] = [{}]
        self.length = [0]
        self.link = [-1]

    def _split(self, state: int, token, target: int) -> int:
        """The state for the match of `state` and `token`, cut off from `target`, which also stands for longer ones."""
        copy = len(self.length)
        self.length.append(self.length[state] + 1)
        self.follow.append(dict(self.follow[target]))
        self.link.append(self.link[target])
        self.link[target] = copy
        while state >= 0 and self.follow[state].get(token) == target:
            self.follow[state][token] = copy
            state = self.link[state]
        return copy

    def add(self, sequence: list) -> None:
        follow, length, link = self.follow, self.length, self.link
        last = 0
        for token in sequence:
            target = follow[last].get(token)
            if target is not None:
                last = target if length[target] == length[last] + 1 else self._split(last, token, target)
                continue
            state = len(length)
            length.append(length[last] + 1)
            follow.append({})
            link.append(0)
            while last >= 0 and token not in follow[last]:
                follow[last][token] = state
                last = link[last]
            if last >= 0:
                target = follow[last][token]
                link[state] = target if length[target] == length[last] + 1 else self._split(last, token, target)
            last = state

    def matches(self, sequence: list, least: int) -> list[int]:
        """Ends (exclusive) of the matches of at least `least` tokens: the matching statistics that reach it."""
        follow, length, link = self.follow, self.length, self.link
        state = size = 0
        ends = []
        for end, token in enumerate(sequence, 1):
            while state and token not in follow[state]:
                state = link[state]
                size = length[state]
            target = follow[state].get(token)
            if target is not None:
                state = target
                size += 1
                if size >= least:
                    ends.append(end)
        return ends


def resolve(rows: dict) -> tuple[list, list, list, list]:
    """Covered spans of the passages in whole shards, see the module's text."""
    docs, first, last = [], [], []
    owners = zip(rows["doc"].tolist(), rows["twin"].tolist(), strict=True)
    shard, waiting, doc = None, [], None
    automaton = Automaton()
    for key, own, at, text in zip(rows["key"].tolist(), owners, rows["at"].tolist(), rows["context"], strict=True):
        if key != shard:
            automaton, waiting, shard = Automaton(), [], key
        elif own != doc:
            for passage in waiting:
                automaton.add(passage)
            waiting = []
        doc = own
        passage = text.as_py().split()
        for end in automaton.matches(passage, LENGTH):
            begin = at + end - LENGTH
            if docs and docs[-1] == own and first[-1] <= begin <= last[-1]:
                last[-1] = at + end
            else:
                docs.append(own)
                first.append(begin)
                last.append(at + end)
        waiting.append(passage)
    return [d for d, _ in docs], [t for _, t in docs], first, last


def _result(text: bytes, found) -> tuple[int, int, str]:
    words = text.split()
    gone = repeats.removed(len(words), found)
    kept = compress(words, (~gone).tolist()) if gone.any() else words
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return repeats.per_document(docs, KIND, resolve, "n_words long, n_removed long, kept_sha256 string", _result, **options)


def kept_text(docs: DataFrame, **options) -> DataFrame:
    """doc_id and the words that are left of every document, joined by single spaces."""

    def left(text: bytes, found) -> tuple[str]:
        words = text.split()
        return (b" ".join(compress(words, (~repeats.removed(len(words), found)).tolist())).decode(),)

    return repeats.per_document(docs, KIND, resolve, "text string", left, **options)
