"""Edit costs of conversation repair: tables over blocks of rows.

Repaired roles must read ``(s?(ua)+)?``.  A row is one of nine symbols: its initial (s, u, a, other), whether it is truncated, or that it has
to go.  ``cost[q]`` of a suffix of rows is the least cost of finishing from state q (0 start, 1 after s, 2 after u, 3 after a).  Less its
minimum, a cost vector takes only a few values, so a row is a step from one numbered vector to another plus a cost, and so is any block of
``BLOCK`` rows: both tables are computed once for every vector and every block.  A sequence is looked up block by block from its end; to find the edits, each
block is expanded from the vector at its right bound backward, then read forward, taking the least letter that keeps the cost.  As letters are
chosen from the front with exact costs of the rest, the edits are the least in ASCII among the cheapest.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 4
SYMBOLS = 9  # initial + 4 if truncated; 8: has to go
GONE = 8
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
KEPT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))  # state after keeping s, u, a, other
GIVEN = (2, 2, 3, 2)  # state after a row that gets or brings the role in turn
ROLE = {2: "user", 3: "assistant"}
END = (0, 6, 3, 0)  # finishing without rows: states 0 and 3 are done, others insert
CLOSING = ("", "II", "I", "")


def before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs from each state when ``symbol`` stands before rows whose costs are ``after``."""
    cost = [DELETE + c for c in after]
    if symbol != GONE:
        cut = CUT if symbol >= 4 else 0
        for q in range(4):
            kept = KEPT[q][symbol % 4]
            cost[q] = min(cost[q], REROLE + cut + after[GIVEN[q]], *([cut + after[kept]] if kept is not None else []))
    for _ in range(2):
        cost = [min(c, INSERT + cost[GIVEN[q]]) for q, c in enumerate(cost)]
    return tuple(cost)


def edits(after: tuple[int, ...], symbol: int, state: int) -> tuple[str, int]:
    """Letters up to and with the row, and the state behind it."""
    cost, letters = before(after, symbol), ""
    while True:
        due = cost[state]
        cut = CUT if 4 <= symbol < GONE else 0
        kept = KEPT[state][symbol % 4] if symbol != GONE else None
        if due == DELETE + after[state]:
            return letters + "D", state
        if due == INSERT + cost[GIVEN[state]]:
            letters, state = letters + "I", GIVEN[state]
        elif kept is not None and due == cut + after[kept]:
            return letters + "K", kept
        else:
            return letters + "R", GIVEN[state]


class Tables:
    """Numbered vectors, and the steps of single rows and of blocks."""

    def __init__(self) -> None:
        numbers, steps = {END: 0}, []
        self.vectors = [END]
        for vector in self.vectors:  # grows while it is read
            row = []
            for symbol in range(SYMBOLS):
                cost = before(vector, symbol)
                least = min(cost)
                plain = tuple(c - least for c in cost)
                if plain not in numbers:
                    numbers[plain] = len(self.vectors)
                    self.vectors.append(plain)
                row.append((numbers[plain], least))
            steps.append(row)
        to = np.array([[s[0] for s in row] for row in steps])
        cost = np.array([[s[1] for s in row] for row in steps])
        block_to, block_cost = to, cost
        for _ in range(BLOCK - 1):  # a further row in front
            front_to, front_cost = to[block_to], cost[block_to]
            size = block_to.shape[1]
            block_cost = (front_cost.transpose(0, 2, 1) + block_cost[:, None, :]).reshape(-1, SYMBOLS * size)
            block_to = front_to.transpose(0, 2, 1).reshape(-1, SYMBOLS * size)
        self.to, self.cost, self.block_to, self.block_cost = to, cost, block_to, block_cost
        self.to_list, self.cost_list = to.tolist(), cost.tolist()
        self.block_to_list, self.block_cost_list = block_to.tolist(), block_cost.tolist()
        self.expand = lru_cache(1 << 16)(self._expand)

    def _expand(self, right: int, rows: bytes, state: int) -> tuple[str, int]:
        """Letters of a block (or the shorter head) and the state behind it, from the vector at its right bound."""
        rights = [right]
        for symbol in reversed(rows[1:]):
            rights.append(self.to_list[rights[-1]][symbol])
        letters = []
        for symbol, after in zip(rows, reversed(rights)):
            own, state = edits(self.vectors[after], symbol, state)
            letters.append(own)
        return "".join(letters), state

    def bounds(self, rows: bytes, right: int = 0) -> tuple[list[int], int]:
        """Vectors at the right bound of the head and of each block, first to last, then the vector before all rows is the first step's; and the cost."""
        rights, cost = [right], 0
        for a in range(len(rows) - BLOCK, -1, -BLOCK):
            block = number(rows[a:a + BLOCK])
            cost += self.block_cost_list[rights[-1]][block]
            rights.append(self.block_to_list[rights[-1]][block])
        vector = rights[-1]
        for symbol in reversed(rows[:len(rows) % BLOCK]):
            cost += self.cost_list[vector][symbol]
            vector = self.to_list[vector][symbol]
        return [vector, *reversed(rights)], cost

    def trace(self, rows: bytes, rights: list[int], state: int = 0) -> tuple[str, int]:
        """Letters of all rows from ``state``, given :meth:`bounds`."""
        head = len(rows) % BLOCK
        letters, at = [], 1
        cuts = [(0, head)] if head else []
        if not head:
            at = 2  # no head: the second vector is the left bound of the first block
        cuts += [(a, a + BLOCK) for a in range(head, len(rows), BLOCK)]
        for a, b in cuts:
            own, state = self.expand(rights[at], rows[a:b], state)
            letters.append(own)
            at += 1
        return "".join(letters), state

    def all_steps(self, rows: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For every vector on the right: the vector before ``rows`` and the cost added."""
        vector, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for a in range(len(rows) - BLOCK, -1, -BLOCK):
            block = number(rows[a:a + BLOCK])
            cost += self.block_cost[vector, block]
            vector = self.block_to[vector, block]
        for symbol in reversed(rows[:len(rows) % BLOCK]):
            cost += self.cost[vector, symbol]
            vector = self.to[vector, symbol]
        return vector, cost


def number(rows: bytes) -> int:
    out = 0
    for symbol in rows:
        out = out * SYMBOLS + symbol
    return out


@lru_cache(1)
def tables() -> Tables:
    return Tables()
