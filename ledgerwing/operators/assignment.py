"""The heaviest one-to-one assignment of a sparse two-sided graph, and what each of its pairs is worth.

Whole-number weights.  Prices start at the largest weight for the left side and fall together: at each level, shortest
augmenting paths over tight edges are taken in layers until there are none, then prices move by the least slack.
There are at most as many levels as the largest weight has units, so a component of many thousand members is solved exactly.

A member may stand for a class of equal ones: it has as many places as the class has members, and a pair carries a number of
them, so the work grows with the classes.

Forbidding a pair (a, b) costs the lighter of two detours, both measured in reduced costs, which are never negative:
the cheapest circle through the pair, or the cheapest way for ``a`` to another place plus that for ``b`` to another
taker.  The latter two are known for all members after one search a side; circles are looked for only within ``most``.  In a class of
several, another member can always change places with the one whose pair is forbidden, which costs nothing.
"""

from __future__ import annotations

import heapq
from collections import deque


class Assignment:
    """edges: [(left, right, weight)], members numbered from 0 on each side, weights above or equal 0; sizes: how many equal members
    each number stands for (one, if not given)."""

    def __init__(self, n_left: int, n_right: int, edges: list[tuple[int, int, int]], left_sizes: list[int] | None = None, right_sizes: list[int] | None = None):
        self.out: list[list[tuple[int, int]]] = [[] for _ in range(n_left)]
        self.into: list[list[tuple[int, int]]] = [[] for _ in range(n_right)]
        for a, b, w in edges:
            self.out[a].append((b, w))
            self.into[b].append((a, w))
        self.sizes = list(left_sizes or [1] * n_left), list(right_sizes or [1] * n_right)
        self.free = list(self.sizes[0]), list(self.sizes[1])  # members without a partner
        top = max((w for _, _, w in edges), default=0)
        self.u, self.v = [top] * n_left, [0] * n_right
        self.places: list[dict[int, int]] = [{} for _ in range(n_left)]  # right -> how many of a left class are there
        self.takers: list[dict[int, None]] = [{} for _ in range(n_right)]
        level = top
        while level > 0 and any(self.free[0]):
            while self._augment():
                pass
            level -= self._lower(level)

    def _layers(self) -> tuple[dict[int, int], bool]:
        """Steps from the free left members over tight edges, as far as the first free right member."""
        depth = {a: 0 for a, n in enumerate(self.free[0]) if n}
        queue, found = deque(depth), None
        while queue:
            a = queue.popleft()
            if found is not None and depth[a] >= found:
                break
            for b, w in self.out[a]:
                if self.u[a] + self.v[b] == w:
                    if self.free[1][b]:
                        found = depth[a]
                        continue
                    for c in self.takers[b]:
                        if c not in depth:
                            depth[c] = depth[a] + 1
                            queue.append(c)
        return depth, found is not None

    def _onward(self, a: int, depth: dict[int, int]):
        """(b, c): tight edges from ``a``, with the taker c of the next layer that would have to leave b, or None if b is free."""
        for b, w in self.out[a]:
            if self.u[a] + self.v[b] == w:
                if self.free[1][b]:
                    yield b, None
                else:
                    for c in list(self.takers[b]):
                        if depth.get(c) == depth[a] + 1:
                            yield b, c

    def _augment(self) -> bool:
        """Shortest augmenting paths that share no step, all that one search of layers gives."""
        depth, found = self._layers()
        if not found:
            return False
        rest = {a: self._onward(a, depth) for a in depth}
        for root in [a for a in depth if depth[a] == 0]:
            way: list[tuple[int, int | None]] = [(root, None)]  # a left class and the place that it leaves
            while way and self.free[0][root]:
                a = way[-1][0]
                for b, c in rest[a]:
                    if c is None:
                        self._move(root, [*way[1:], (None, b)])
                        if self.free[1][b] and self.free[0][root]:
                            rest[a] = _again((b, None), rest[a])
                        way = [(root, None)]
                        break
                    if c in rest and b in self.places[c]:
                        way.append((c, b))
                        break
                else:
                    rest.pop(a, None)
                    way.pop()
                    if way and way[-1][0] not in rest:
                        break
        return True

    def _move(self, root: int, steps: list[tuple[int | None, int]]) -> None:
        """Along (class, place it leaves) to a free place: each takes the place of the one after it, as many as can."""
        n = min(self.free[0][root], self.free[1][steps[-1][1]], *(self.places[c][b] for c, b in steps[:-1]))
        a = root
        for c, b in steps:
            self.places[a][b] = self.places[a].get(b, 0) + n
            self.takers[b][a] = None
            if c is not None:
                self.places[c][b] -= n
                if not self.places[c][b]:
                    del self.places[c][b], self.takers[b][c]
                a = c
        self.free[0][root] -= n
        self.free[1][steps[-1][1]] -= n

    def _lower(self, level: int) -> int:
        """Prices move until an edge out of the searched part is tight, or the free ones' price is 0."""
        lefts = {a for a, n in enumerate(self.free[0]) if n}
        queue, rights = deque(lefts), set()
        while queue:
            a = queue.popleft()
            for b, w in self.out[a]:
                if self.u[a] + self.v[b] == w and b not in rights:
                    rights.add(b)
                    for c in self.takers[b]:
                        if c not in lefts:
                            lefts.add(c)
                            queue.append(c)
        step = min([level, *(self.u[a] + self.v[b] - w for a in lefts for b, w in self.out[a] if b not in rights)])
        for a in lefts:
            self.u[a] -= step
        for b in rights:
            self.v[b] += step
        return step

    def pairs(self) -> list[tuple[int, int]]:
        return [(a, b) for a, own in enumerate(self.places) for b in own]

    def margins(self, most: int) -> dict[tuple[int, int], int]:
        """What forbidding each pair of two members costs the total, or ``most`` if that is less."""
        sole = {(a, b): self.sizes[0][a] == self.sizes[1][b] == 1 for a, b in self.pairs()}
        if not any(sole.values()):
            return dict.fromkeys(sole, 0)
        elsewhere = self._to_another_place()
        taken = self._to_another_taker()
        #: Of each left member, cheapest first: whose place it could take, and at what reduced cost.
        near = [[(self.u[a] + self.v[b] - w, b) for b, w in own if self.u[a] + self.v[b] - w < most] for a, own in enumerate(self.out)]
        steps = [sorted((cost, c) for cost, b in own for c in self.takers[b] if c != a) for a, own in enumerate(near)]
        return {(a, b): _circle(steps, a, min(most, elsewhere[a] + taken[b])) if sole[a, b] else 0 for a, b in sole}

    def _to_another_place(self) -> list[int]:
        """Of each left member: to give its place up and find a free one, or none."""
        best = list(self.u)
        for b, n in enumerate(self.free[1]):
            if n:
                for a, w in self.into[b]:
                    best[a] = min(best[a], self.u[a] + self.v[b] - w)
        queue = [(d, a) for a, d in enumerate(best)]
        heapq.heapify(queue)
        while queue:
            d, a = heapq.heappop(queue)
            if d == best[a]:
                for b in self.places[a]:
                    for c, w in self.into[b]:
                        if c != a and d + self.u[c] + self.v[b] - w < best[c]:
                            best[c] = d + self.u[c] + self.v[b] - w
                            heapq.heappush(queue, (best[c], c))
        return best

    def _to_another_taker(self) -> list[int]:
        """Of each right member: to be given up by its partner and taken by another, or by none."""
        best = list(self.v)
        for a, n in enumerate(self.free[0]):
            if n:
                for b, w in self.out[a]:
                    best[b] = min(best[b], self.u[a] + self.v[b] - w)
        queue = [(d, b) for b, d in enumerate(best)]
        heapq.heapify(queue)
        while queue:
            d, b = heapq.heappop(queue)
            if d == best[b]:
                for a in self.takers[b]:
                    for c, w in self.out[a]:
                        if c != b and d + self.u[a] + self.v[c] - w < best[c]:
                            best[c] = d + self.u[a] + self.v[c] - w
                            heapq.heappush(queue, (best[c], c))
        return best


def _again(first, rest):
    yield first
    yield from rest


def _circle(steps: list[list[tuple[int, int]]], start: int, limit: int) -> int:
    """The cheapest way from ``start`` back to it, if it is under ``limit``."""
    best, queue = {start: 0}, [(0, start)]
    while queue and queue[0][0] < limit:
        d, x = heapq.heappop(queue)
        if d > best[x]:
            continue
        for cost, y in steps[x]:
            if d + cost >= limit:
                break
            if y == start:
                limit = d + cost
            elif d + cost < best.get(y, limit):
                best[y] = d + cost
                heapq.heappush(queue, (d + cost, y))
    return limit
