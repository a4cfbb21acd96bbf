"""Maximum flow: layered breadth-first searches with blocking flows on small graphs, pushes of whole layers in arrays on large ones."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np

#: Room and excess up to this count as none.
LEAST = 1e-9


class FlowNetwork:
    """Directed edges with capacities; ``cut_side`` tells the nodes on the source's side of a minimum cut."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[float] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def edge(self, a: int, b: int, forth: float, back: float = 0) -> None:
        for u, v, c in ((a, b, forth), (b, a, back)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(c)

    def _levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in self.out[u]:
                if self.room[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level

    def run(self, source: int, sink: int) -> float:
        total = 0.0
        while (level := self._levels(source))[sink] >= 0:
            nxt = [0] * len(self.out)
            path: list[int] = []
            u = source
            while True:
                if u == sink:
                    pushed = min(self.room[e] for e in path)
                    total += pushed
                    for e in path:
                        self.room[e] -= pushed
                        self.room[e ^ 1] += pushed
                    first = next(i for i, e in enumerate(path) if self.room[e] <= 1e-12)
                    u = self.to[path[first] ^ 1]
                    del path[first:]
                    continue
                while nxt[u] < len(self.out[u]):
                    e = self.out[u][nxt[u]]
                    if self.room[e] > 1e-12 and level[self.to[e]] == level[u] + 1:
                        break
                    nxt[u] += 1
                if nxt[u] < len(self.out[u]):
                    path.append(self.out[u][nxt[u]])
                    u = self.to[path[-1]]
                elif path:
                    level[u] = -1
                    u = self.to[path.pop() ^ 1]
                else:
                    break
        return total

    def cut_side(self, source: int) -> list[bool]:
        return [x >= 0 for x in self._levels(source)]


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every span, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class ArrayNetwork:
    """A network whose source and sink are folded into ``excess``: above 0 what the source can still give a node, below 0 what the sink takes.

    A push is a change of terms that leaves the value of every cut as it is but for a constant, so edges may be added between runs, and
    no flow has to be led back: the least source side is what positive excess reaches once it reaches no negative one.
    """

    #: Arcs that are looked at together.
    ARCS = 1 << 18

    def __init__(self, excess: np.ndarray):
        self.excess = excess.astype(float)
        self.head = self.mate = np.zeros(0, dtype=np.int32)
        self.room = np.zeros(0)
        self.start = np.zeros(len(excess) + 1, dtype=np.int64)

    def add(self, a: np.ndarray, b: np.ndarray, forth: np.ndarray, back: np.ndarray) -> None:
        """Edges with their capacities from a to b and from b to a."""
        old, m = len(self.head), len(a)
        if old + 2 * m >= 1 << 31:
            raise ValueError("more than 2^31 arcs")
        nodes = np.arange(len(self.excess), dtype=np.int32)
        tail = np.concatenate([np.repeat(nodes, np.diff(self.start)), a, b], dtype=np.int32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=len(nodes)))])
        order = np.argsort(tail, kind="stable").astype(np.int32)
        del tail
        self.head = np.concatenate([self.head, b, a], dtype=np.int32)[order]
        self.room = np.concatenate([self.room, forth, back])[order]
        new = old + np.arange(m, dtype=np.int32)
        self.mate = np.concatenate([self.mate, new + np.int32(m), new])[order]
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        del order
        self.mate = place[self.mate]

    def _arcs(self, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The nodes in runs, with the arcs that leave them."""
        counts = self.start[nodes + 1] - self.start[nodes]
        run = np.cumsum(counts) // self.ARCS
        for part in np.split(np.arange(len(nodes)), np.flatnonzero(np.diff(run)) + 1):
            yield np.repeat(nodes[part], counts[part]), spans(self.start[nodes[part]], counts[part])

    def _to_sink(self) -> np.ndarray:
        """Steps to a node of negative excess, -1 where none is known to be reached; stops when all positive nodes have theirs."""
        far = np.where(self.excess < -LEAST, 0, -1)
        at, left, k = np.flatnonzero(far == 0), int((self.excess > LEAST).sum()), 0
        while len(at) and left:
            k += 1
            for _, arcs in self._arcs(at):
                before = self.head[arcs[self.room[self.mate[arcs]] > LEAST]]
                far[before[far[before] < 0]] = k
            at = np.flatnonzero(far == k)
            left -= int((self.excess[at] > LEAST).sum())
        return far

    def run(self) -> None:
        """Layers farthest from the sink push first; a node that keeps excess is farther away in the next search, so this ends."""
        while len(self.head):
            far = self._to_sink()
            deepest = int(far[self.excess > LEAST].max(initial=-1))
            if deepest < 1:
                return
            for k in range(deepest, 0, -1):
                for tail, arcs in self._arcs(np.flatnonzero((far == k) & (self.excess > LEAST))):
                    self._push(tail, arcs, far)

    def _push(self, tail: np.ndarray, arcs: np.ndarray, far: np.ndarray) -> None:
        """As much of the excess as fits, along the arcs one step nearer to the sink in their order."""
        fits = (self.room[arcs] > LEAST) & (far[self.head[arcs]] == far[tail] - 1)
        tail, arcs = tail[fits], arcs[fits]
        if not len(arcs):
            return
        room = self.room[arcs]
        first = np.flatnonzero(np.concatenate([[True], tail[1:] != tail[:-1]]))
        before = np.cumsum(room) - room
        before -= np.repeat(before[first], np.diff(np.append(first, len(arcs))))
        give = np.clip(self.excess[tail] - before, 0, room)
        self.room[arcs] -= give
        self.room[self.mate[arcs]] += give
        np.subtract.at(self.excess, tail, give)
        np.add.at(self.excess, self.head[arcs], give)

    def source_side(self) -> np.ndarray:
        """The nodes on the source's side of the minimum cut that has fewest of them."""
        side = self.excess > LEAST
        at = np.flatnonzero(side)
        while len(at):
            was = side.copy()
            for _, arcs in self._arcs(at):
                side[self.head[arcs[self.room[arcs] > LEAST]]] = True
            at = np.flatnonzero(side & ~was)
        return side
