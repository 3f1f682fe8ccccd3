"""The cheapest edits that give a conversation a legal order of roles, by bidirectional Dijkstra.

A node of the lattice is a number of rows taken and a state of the grammar ``(s?(ua)+)?``, an edge is one edit. A heap
grows from the start, another from the goals. They meet where an edge leads from a node settled by the first to one
settled by the second; the search goes on until no two heads can add up to the best cost, so that every crossing of
that cost is seen, and of these the one with the least audit is taken.

Rows are letters: the initial of the role (``o`` for others than s, u and a), a capital for a row that is truncated,
``x`` for one that has to go.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heappop, heappush

# Fixed by the task: what an edit costs, and what an undeleted truncated row adds.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
GOALS = (START, ASSISTANT)
# Rows searched at once; longer runs are put together from such blocks.
BLOCK = 32

Node = tuple[int, int]
Path = tuple[int, str]
# By entry and exit state: the best path through some rows.
Paths = dict[tuple[int, int], Path]


@lru_cache(maxsize=64)
def _taken(row: str) -> list[tuple[int, int, int, str]]:
    """``(from, to, cost, edit)`` of the edits that take one row."""
    edges = [(state, state, DELETE, "D") for state in STATES]
    if row != "x":
        extra, role = TRUNCATED * row.isupper(), row.lower()
        for (state, letter), after in NEXT.items():
            if letter == role:
                edges.append((state, after, extra, "K"))
            if letter in "ua":
                edges.append((state, after, REROLE + extra, "R"))
    return edges


_INSERTED = [(state, after, INSERT, "I") for (state, letter), after in NEXT.items() if letter in "ua"]


def _ahead(rows: str, node: Node):
    i, state = node
    for before, after, cost, edit in _INSERTED:
        if before == state:
            yield (i, after), cost, edit
    if i < len(rows):
        for before, after, cost, edit in _taken(rows[i]):
            if before == state:
                yield (i + 1, after), cost, edit


def _behind(rows: str, node: Node):
    i, state = node
    for before, after, cost, edit in _INSERTED:
        if after == state:
            yield (i, before), cost, edit
    if i:
        for before, after, cost, edit in _taken(rows[i - 1]):
            if after == state:
                yield (i - 1, before), cost, edit


def shortest(rows: str, start: int, goals: tuple[int, ...]) -> Path | None:
    """Cost and audit of the best path from ``start`` before the rows to one of ``goals`` after them.

    The least audit is the least in ASCII order. Of two paths of one cost to a node neither audit begins with the
    other, since further edits would add to the cost; so the least audit consists of least parts.
    """
    size = len(rows)
    # Edges without cost take a row, so with equal costs fewer rows go first: a node is settled with all its audits known.
    heads = [(0, 0, "", (0, start))]
    tails = [(0, 0, "", (size, goal)) for goal in goals]
    first: dict[Node, Path] = {}
    last: dict[Node, Path] = {}
    best: Path | None = None

    def meet(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or (cost, audit) < best:
            best = cost, audit

    def grow_ahead() -> None:
        cost, _, audit, node = heappop(heads)
        if node in first:
            return
        first[node] = cost, audit
        if node in last:
            meet(cost + last[node][0], audit + last[node][1])
        for target, step, edit in _ahead(rows, node):
            if target in last:
                meet(cost + step + last[target][0], audit + edit + last[target][1])
            if target not in first:
                heappush(heads, (cost + step, target[0], audit + edit, target))

    def grow_behind() -> None:
        cost, _, audit, node = heappop(tails)
        if node in last:
            return
        last[node] = cost, audit
        if node in first:
            meet(first[node][0] + cost, first[node][1] + audit)
        for target, step, edit in _behind(rows, node):
            if target in first:
                meet(first[target][0] + step + cost, first[target][1] + edit + audit)
            if target not in last:
                heappush(tails, (cost + step, size - target[0], edit + audit, target))

    # Both ends are settled first; from then on every best path has an edge between the two settled regions.
    grow_ahead()
    for _ in goals:
        grow_behind()
    while heads or tails:
        head = heads[0][0] if heads else None
        tail = tails[0][0] if tails else None
        if best is not None and (head is None or tail is None or head + tail > best[0]):
            break
        if tail is None or (head is not None and head <= tail):
            grow_ahead()
        else:
            grow_behind()
    return best


@lru_cache(maxsize=20_000)
def _block(rows: str) -> Paths:
    found = {(enter, leave): shortest(rows, enter, (leave,)) for enter in STATES for leave in STATES}
    return {ends: path for ends, path in found.items() if path is not None}


def join(left: Paths, right: Paths) -> Paths:
    """The best paths through two runs of rows, one after the other."""
    out: Paths = {}
    for (enter, middle), (cost, audit) in left.items():
        for leave in STATES:
            more = right.get((middle, leave))
            if more is not None:
                path = cost + more[0], audit + more[1]
                if (enter, leave) not in out or path < out[enter, leave]:
                    out[enter, leave] = path
    return out


def join_all(parts: list[Paths]) -> Paths:
    """Neighbours are joined in pairs, so that an audit is copied a logarithmic number of times."""
    while len(parts) > 1:
        pairs = [join(*parts[i : i + 2]) for i in range(0, len(parts) - 1, 2)]
        parts = pairs + parts[len(parts) - len(parts) % 2 :]
    return parts[0]


def paths(rows: str) -> Paths:
    """The best path through ``rows`` for each pair of states."""
    return join_all([_block(rows[at : at + BLOCK]) for at in range(0, max(len(rows), 1), BLOCK)])


def best_of(found: Paths) -> Path:
    return min(found[START, goal] for goal in GOALS if (START, goal) in found)


@lru_cache(maxsize=100_000)
def _short(rows: str) -> Path:
    return shortest(rows, START, GOALS)


def cheapest(rows: str) -> Path:
    """Cost and audit for a whole conversation."""
    return _short(rows) if len(rows) <= BLOCK else best_of(paths(rows))
