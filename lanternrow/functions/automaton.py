"""An Aho-Corasick automaton as numpy arrays, and its walk over many texts at once.

States are numbered by depth, so edges sorted by (state, byte) are built a depth at a time; so are
the links to the longest proper suffix. Texts are cut into lanes of equal length that overlap by the
longest pattern, and all lanes take a step together: a step is a look-up for every lane.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of a lane without its overlap.
LANE = 256


@dataclass
class Automaton:
    """edges: state * 256 + byte, ascending, each to the state that follows in order; fail and ends by state; first: what each byte leads to from the start."""

    edges: np.ndarray
    fail: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    longest: int

    @staticmethod
    def build(patterns: list[bytes]) -> Automaton:
        if not patterns or not all(patterns):
            raise ValueError("patterns must not be empty")
        patterns = sorted(set(patterns))
        sizes = np.array([len(p) for p in patterns], np.int64)
        data = np.frombuffer(b"".join(patterns), np.uint8)
        starts = np.cumsum(sizes) - sizes
        at, live, n_states = np.zeros(len(patterns), np.int64), np.arange(len(patterns)), 1
        edges, ends, parents, depth = [], [np.zeros(1, bool)], [], 0
        while len(live):
            keys, place = np.unique(at[live] * 256 + data[starts[live] + depth], return_inverse=True)
            at[live] = n_states + place
            end = np.zeros(len(keys), bool)
            end[place[sizes[live] == depth + 1]] = True
            edges.append(keys)
            ends.append(end)
            parents.append(keys // 256)
            n_states += len(keys)
            depth += 1
            live = live[sizes[live] > depth]
        out = Automaton(np.concatenate(edges), np.zeros(n_states, np.int32), np.concatenate(ends), np.zeros(256, np.int32), int(sizes.max()))
        out.first[edges[0]] = np.arange(1, 1 + len(edges[0]))
        low = 1 + len(edges[0])
        for keys, up in zip(edges[1:], parents[1:], strict=True):
            own = slice(low, low + len(keys))
            out.fail[own] = out.step(out.fail[up].astype(np.int64), (keys % 256).astype(np.uint8))
            out.ends[own] |= out.ends[out.fail[own]]
            low += len(keys)
        return out

    def step(self, states: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The state after each state's byte; states is changed."""
        todo = np.flatnonzero(states)
        out = self.first[bytes_].astype(np.int64)
        while len(todo):
            keys = states[todo] * 256 + bytes_[todo]
            place = np.searchsorted(self.edges, keys)
            found = self.edges[np.minimum(place, len(self.edges) - 1)] == keys
            out[todo[found]] = place[found] + 1
            todo = todo[~found]
            states[todo] = self.fail[states[todo]]
            # from the start, the byte alone decides, which out holds already
            todo = todo[states[todo] > 0]
        return out

    def found_in(self, texts: list[bytes]) -> np.ndarray:
        """Whether a pattern stands anywhere in each text."""
        hit = np.zeros(len(texts), bool)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin, most = 0, 1 << 20
        upto = np.cumsum(sizes)
        while begin < len(texts):
            # some texts of about 1 MB, or one longer text
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] - sizes[begin] + most, side="right")))
            self._walk(texts[begin:end], sizes[begin:end], hit[begin:end])
            begin = end
        return hit

    def _walk(self, texts: list[bytes], sizes: np.ndarray, hit: np.ndarray) -> None:
        data = np.frombuffer(b"".join(texts), np.uint8)
        lanes = -(-sizes // LANE)
        row = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(np.cumsum(sizes) - sizes, lanes) + nth * LANE
        last = np.minimum(at + LANE + self.longest - 1, np.repeat(np.cumsum(sizes), lanes))
        states = np.zeros(len(row), np.int64)
        while len(at):
            states = self.step(states, data[at])
            hit[row[self.ends[states]]] = True
            at += 1
            going = (at < last) & ~hit[row]
            at, last, states, row = at[going], last[going], states[going], row[going]
