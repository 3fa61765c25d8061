"""Minimal acyclic transducers: sorted terms as shared arcs whose outputs add up to ordinals.

Terms are added in byte order; a state that no later term can change is looked up among
those made before, so states with the same rest are one state and the automaton is minimal
at every step. An arc's output is the number of terms that sort before all those behind
it, so the outputs on a term's way add up to its place among the terms.

Arcs are flat arrays sorted by (state, byte); many terms are followed side by side, one
byte a step, each step a binary search of all their arcs.
"""

from __future__ import annotations

import os

import numpy as np


class Transducer:
    """``keys`` (state * 256 + byte, sorted), ``targets`` and ``outputs`` of arcs; ``final`` of states.

    Targets have smaller numbers than the states they are reached from; the last state is
    the first of every term.
    """

    def __init__(self, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray, final: np.ndarray, longest: int):
        self.keys, self.targets, self.outputs, self.final, self.longest = keys, targets, outputs, final, longest

    @classmethod
    def build(cls, terms: list[bytes]) -> Transducer:
        """From different terms in byte order."""
        states: dict[tuple, int] = {}
        open_arcs: list[list] = [[]]  # of the states on the last term's way
        open_final = [False]

        def close(depth: int) -> None:
            while len(open_arcs) > depth + 1:
                state = (open_final.pop(), tuple(open_arcs.pop()))
                open_arcs[-1][-1] = (open_arcs[-1][-1], states.setdefault(state, len(states)))

        last = None
        for term in terms:
            if last is not None and term <= last:
                raise ValueError("terms must be different and in byte order")
            same = len(os.path.commonprefix([last or b"", term]))
            close(same)
            for byte in term[same:]:
                open_arcs[-1].append(byte)
                open_arcs.append([])
                open_final.append(False)
            open_final[-1] = True
            last = term
        close(0)
        states[(open_final[0], tuple(open_arcs[0]), "first")] = len(states)

        reach, arcs = [], []  # how many terms end at or behind each state
        for number, (final, own, *_) in enumerate(states):
            count = int(final)
            for byte, target in own:
                arcs.append((number << 8 | byte, target, count))
                count += reach[target]
            reach.append(count)
        flat = np.array(arcs, np.int64).reshape(-1, 3)
        final = np.array([s[0] for s in states], bool)
        longest = max(map(len, terms), default=0)
        return cls(flat[:, 0].copy(), flat[:, 1].astype(np.int32), flat[:, 2].copy(), final, longest)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each span of bytes among the terms, -1 for those that are none."""
        out = np.full(len(starts), -1, np.int64)
        going = np.flatnonzero(ends - starts <= self.longest)
        state = np.full(len(going), len(self.final) - 1, np.int64)
        place, at = np.zeros(len(going), np.int64), starts[going]
        while len(going):
            over = at == ends[going]
            done = over & self.final[state]
            out[going[done]] = place[done]
            going, state, place, at = (x[~over] for x in (going, state, place, at))
            if not len(going) or not len(self.keys):
                break
            wanted = state << 8 | data[at]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            on = self.keys[arc] == wanted
            arc = arc[on]
            going, at = going[on], at[on] + 1
            state, place = self.targets[arc].astype(np.int64), place[on] + self.outputs[arc]
        return out

    def dump(self) -> dict[str, bytes | int]:
        arrays = {"keys": self.keys, "targets": self.targets, "outputs": self.outputs, "final": self.final}
        return {k: x.tobytes() for k, x in arrays.items()} | {"longest": self.longest}

    @classmethod
    def load(cls, row: dict) -> Transducer:
        kinds = {"keys": np.int64, "targets": np.int32, "outputs": np.int64, "final": bool}
        return cls(*[np.frombuffer(row[k], kind) for k, kind in kinds.items()], row["longest"])
