"""Cheapest edits of a row sequence by bidirectional Dijkstra over the edit lattice.

A node is (rows handled, state of the role pattern).  The pattern ``(s?(ua)+)?`` has four states:
nothing yet, after ``s``, after ``u``, and after ``a``; the first and the last may end it.  From every
state only one role can be put next by force, so an insertion or a new role needs no choice.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

#: Costs of the edits, and of a truncated row that is not deleted (fixed values of the contract).
RETITLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
STATES = 4
#: State reached by putting a role, and the roles a state takes.
AFTER = {"s": 1, "u": 2, "a": 3}
TAKES = ("su", "u", "a", "u")
#: The role that an insertion or a new role puts.
FORCED = ("u", "u", "a", "u")
ENDS = (0, 3)
#: How often a segment's code must fit into memory; only speed depends on it.
REMEMBERED = 50_000

Answer = tuple[int, str]  # cost, edits


def row_code(initial: str, must_go: bool, truncated: bool) -> str:
    """A row in one letter: its role's initial if the pattern knows it, else ``x``; ``D`` if it must go;
    upper case if it is truncated."""
    if must_go:
        return "D"
    known = initial if initial in AFTER else "x"
    return known.upper() if truncated else known


def edits(code: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of all edits of one row in a state."""
    found = [("D", DELETE, state)]
    if code != "D":
        extra, role = (TRUNCATED if code.isupper() else 0), code.lower()
        found.append(("R", RETITLE + extra, AFTER[FORCED[state]]))
        if role in TAKES[state]:
            found.append(("K", extra, AFTER[role]))
    return found


@lru_cache(REMEMBERED)
def best_edits(codes: str, start: int, goals: tuple[int, ...], trailing: bool) -> Answer | None:
    """The cheapest edits that take the rows from ``start`` to one of ``goals``, the least by letters.

    Insertions stand before a row; only with ``trailing`` may they follow the last one as well.

    Forward and reverse heaps are settled in turn.  They stop when no path through unsettled nodes
    can be as cheap as the best crossing, so every crossing of that cost is known; the least of the
    concatenated letters wins.  Nodes of equal cost are settled by position, as a kept row costs
    nothing: all ways into a node are then known when it is settled.
    """
    rows = len(codes)

    def onward(at: int, state: int) -> list[tuple[str, int, tuple[int, int]]]:
        ways = [("I", INSERT, (at, AFTER[FORCED[state]]))] if at < rows or trailing else []
        if at < rows:
            ways += [(letter, cost, (at + 1, to)) for letter, cost, to in edits(codes[at], state)]
        return ways

    def back(at: int, state: int) -> list[tuple[str, int, tuple[int, int]]]:
        ways = []
        if at < rows or trailing:
            ways += [("I", INSERT, (at, q)) for q in range(STATES) if AFTER[FORCED[q]] == state]
        if at:
            ways += [(letter, cost, (at - 1, q)) for q in range(STATES) for letter, cost, to in edits(codes[at - 1], q) if to == state]
        return ways

    first, lasts = (0, start), [(rows, q) for q in goals]
    known = ({first: (0, "")}, {node: (0, "") for node in lasts})
    heaps = ([(0, 0, first)], [(0, 0, node) for node in lasts])
    settled: tuple[set, set] = (set(), set())
    best = 0 if first in known[1] else None
    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, _, node = heapq.heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side].add(node)
        letters = known[side][node][1]
        for letter, step, to in (onward if side == 0 else back)(*node):
            new = (cost + step, letters + letter if side == 0 else letter + letters)
            old = known[side].get(to)
            if old is None or new < old:
                known[side][to] = new
                if old is None or new[0] < old[0]:
                    heapq.heappush(heaps[side], (new[0], to[0] if side == 0 else rows - to[0], to))
                met = known[1 - side].get(to)
                if met is not None and (best is None or new[0] + met[0] < best):
                    best = new[0] + met[0]
    if best is None:
        return None
    ways = (a[1] + b[1] for node, a in known[0].items() if (b := known[1].get(node)) and a[0] + b[0] == best)
    return best, min(ways)


def whole(codes: str) -> Answer:
    """The answer for a whole conversation."""
    return best_edits(codes, 0, ENDS, True)


def transfers(codes: str) -> list[list[Answer | None]]:
    """The answers for a stretch of a conversation, from every state to every state."""
    return [[best_edits(codes, q, (to,), False) for to in range(STATES)] for q in range(STATES)]


def chain(parts: list[list[list[Answer | None]]]) -> Answer:
    """The answer for a conversation from the transfers of its stretches, in order.

    Every stretch's letters end with a row's edit, so of two ways through the same stretches neither
    can be the beginning of the other: the order of what came before decides, and only the rank of
    the four ways so far must be kept.  The letters are put together once, from the chosen ways.
    """
    costs, ranks, links = {0: 0}, {0: 0}, []
    for part in parts:
        new, came = {}, {}
        for q, cost in costs.items():
            for to in range(STATES):
                if part[q][to] is None:
                    continue
                step, letters = part[q][to]
                mine = (cost + step, ranks[q], letters)
                if to not in new or mine < new[to]:
                    new[to], came[to] = mine, (q, letters)
        order = sorted(new, key=lambda to: new[to][1:])
        costs, ranks = {to: new[to][0] for to in new}, {to: i for i, to in enumerate(order)}
        links.append(came)
    ends = []
    for q, cost in costs.items():
        tail = best_edits("", q, ENDS, True)
        ends.append((cost + tail[0], ranks[q], tail[1], q))
    total, _, tail, state = min(ends)
    letters = [tail]
    for came in reversed(links):
        state, part = came[state]
        letters.append(part)
    return total, "".join(reversed(letters))
