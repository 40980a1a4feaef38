"""Minimal acyclic transducers: sorted keys to their lexicographic ordinals and back.

Built by one pass over sorted keys. Only the path of the last key is open; when the next key leaves it, its states are
frozen from the end, and one that accepts the same rest in the same way as an earlier one is that state. A state knows how
many keys it accepts, so an arc puts out how many come before those it leads to, and a key's outputs add up to its ordinal.
"""

from collections.abc import Iterable

import numpy as np


class Transducer:
    """`arcs[state]` maps a byte to (next state, output), in the order of bytes; the root is the last state."""

    __slots__ = ("arcs", "count", "final")

    def __init__(self, arcs: list[dict[int, int]], final: list[bool]):
        self.arcs: list[dict[int, tuple[int, int]]] = []
        self.final = final
        self.count: list[int] = []
        for own, ends in zip(arcs, final, strict=True):  # arcs lead to earlier states
            before, out = int(ends), {}
            for byte, to in own.items():
                out[byte] = to, before
                before += self.count[to]
            self.arcs.append(out)
            self.count.append(before)

    @classmethod
    def build(cls, keys: Iterable[bytes]) -> "Transducer":
        """From keys in ascending order without repeats."""
        arcs: list[dict[int, int]] = []
        final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[tuple[dict[int, int], list[bool]]] = [({}, [False])]
        last = b""

        def freeze(depth: int) -> None:
            while len(path) > depth + 1:
                own, ends = path.pop()
                sign = ends[0], tuple(own.items())
                state = known.get(sign)
                if state is None:
                    state = known[sign] = len(arcs)
                    arcs.append(own)
                    final.append(ends[0])
                path[-1][0][last[len(path) - 1]] = state

        for key in keys:
            shared = 0
            for a, b in zip(key, last, strict=False):
                if a != b:
                    break
                shared += 1
            freeze(shared)
            path.extend(({}, [False]) for _ in range(len(key) - shared))
            path[-1][1][0] = True
            last = key
        freeze(0)
        return cls([*arcs, path[0][0]], [*final, path[0][1][0]])

    def ordinal(self, key: bytes) -> int | None:
        state, out = len(self.arcs) - 1, 0
        for byte in key:
            arc = self.arcs[state].get(byte)
            if arc is None:
                return None
            state = arc[0]
            out += arc[1]
        return out if self.final[state] else None

    def key(self, ordinal: int) -> bytes:
        state, made = len(self.arcs) - 1, bytearray()
        while ordinal or not self.final[state]:
            byte, (to, before) = next(x for x in reversed(self.arcs[state].items()) if x[1][1] <= ordinal)
            made.append(byte)
            state, ordinal = to, ordinal - before
        return bytes(made)

    def __len__(self) -> int:
        return self.count[-1]

    def dump(self) -> bytes:
        size = np.array([len(a) for a in self.arcs], np.uint32)
        labels = np.array([b for a in self.arcs for b in a], np.uint8)
        targets = np.array([to for a in self.arcs for to, _ in a.values()], np.uint32)
        head = np.array([len(size), len(labels)], np.uint32)
        return b"".join(x.tobytes() for x in (head, size, targets, np.array(self.final, np.uint8), labels))

    @classmethod
    def load(cls, data: bytes) -> "Transducer":
        states, n = np.frombuffer(data, np.uint32, 2).tolist()
        size = np.frombuffer(data, np.uint32, states, 8)
        targets = np.frombuffer(data, np.uint32, n, 8 + 4 * states).tolist()
        final = np.frombuffer(data, np.uint8, states, 8 + 4 * (states + n)).astype(bool).tolist()
        labels = np.frombuffer(data, np.uint8, n, 8 + 4 * (states + n) + states).tolist()
        at = [0, *np.cumsum(size).tolist()]
        return cls([dict(zip(labels[a:b], targets[a:b], strict=True)) for a, b in zip(at, at[1:], strict=False)], final)
