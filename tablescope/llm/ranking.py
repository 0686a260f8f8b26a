"""Cheapest edits of sequences under a grammar, the least edit string among equals.

A node is (rows consumed, grammar state).  Costs to the end follow backwards row
by row, for many sequences at once.  Arcs on cheapest paths are optimal arcs.
Nodes are then ranked by the least string of edit letters that leaves them,
truncated to 1, 2, 4, ... letters: the rank for twice the length is that of the
pair (own rank, rank of the node that the first half leads to), and the pointer
to that node doubles with it.  The final ranks choose one arc per node, and the
chosen path is read through doubled pointers, all of its nodes at once.

A long sequence is cut into parts.  A part's end is a row of terminal nodes with
given costs and ranks, so parts need only exchange a few numbers per state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

FAR = np.int64(1) << 60
#: Ranks of terminal nodes start here; letters lie far below.
TERMINAL = np.int64(1) << 40


@dataclass(frozen=True)
class Grammar:
    """States with arcs by role initial, and what edits cost.

    `arcs` maps (state, initial) to a state, 0 is the start.  Kept rows walk by
    the initial of their own role, changed and inserted ones by that of a role
    in `offered`.
    """

    arcs: dict
    accepting: tuple
    offered: tuple = ("user", "assistant")
    change: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5
    # tables over row codes: letter of each kind of arc, where it leads, what it costs
    initials: str = field(init=False)
    states: int = field(init=False)
    letters: np.ndarray = field(init=False, repr=False)
    target: np.ndarray = field(init=False, repr=False)
    cost: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        put("initials", "".join(sorted({i for _, i in self.arcs})))
        put("states", 1 + max([*self.accepting, *(s for s, _ in self.arcs), *self.arcs.values()]))
        kinds = ["", "D", "K", *["R"] * len(self.offered), *["I"] * len(self.offered)]
        put("letters", np.array([ord(k) if k else 0 for k in kinds], np.int64))
        shape = (self.codes, self.states, len(kinds))
        target, cost = np.full(shape, -1, np.int64), np.full(shape, FAR, np.int64)
        for code in range(self.codes):
            kind, fault = divmod(code, 3)
            for q in range(self.states):
                found = []
                for n, role in enumerate(self.offered):  # insertions leave the row where it is
                    found.append((3 + len(self.offered) + n, self.arcs.get((q, role[0])), self.insert))
                if code == self.end:
                    found.append((0, 0 if q in self.accepting else None, 0))
                else:
                    found.append((1, q, self.delete))
                    late = self.truncated if fault == 1 else 0
                    if fault < 2:
                        if kind < len(self.initials):
                            found.append((2, self.arcs.get((q, self.initials[kind])), late))
                        found += [(3 + n, self.arcs.get((q, role[0])), self.change + late) for n, role in enumerate(self.offered)]
                for arc, to, price in found:
                    if to is not None:
                        target[code, q, arc], cost[code, q, arc] = to, price
        put("target", target)
        put("cost", cost)

    @property
    def end(self) -> int:
        """The code that closes a sequence: only accepting states pass it."""
        return 3 * (len(self.initials) + 1)

    @property
    def codes(self) -> int:
        return self.end + 1

    @property
    def first_insert(self) -> int:
        return 3 + len(self.offered)

    def code(self, initial: str, fault: int) -> int:
        """Row code: role initial and fault (0 none, 1 truncated, 2 must go)."""
        kind = self.initials.find(initial) if initial else -1
        return 3 * (kind if kind >= 0 else len(self.initials)) + fault


#: `(s?(ua)+)?`: nothing, or turns of user and assistant after at most one system turn.
CHAT = Grammar(arcs={(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, accepting=(0, 3))


def costs_to_end(grammar: Grammar, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cheapest cost from every node; one row more than rows for each part, the last one as given in `ends`.

    `codes` holds the rows of all parts, `starts` (n + 1) where they begin; node
    rows of part p begin at starts[p] + p.
    """
    parts, states = len(starts) - 1, grammar.states
    lengths = np.diff(starts)
    base = starts[:-1] + np.arange(parts)
    out = np.empty((len(codes) + parts, states), np.int64)
    out[base + lengths] = ends
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(1, lengths.max(initial=0) + 1), side="right")
    inserts = slice(grammar.first_insert, None)
    # the price of going from one state to another by insertions only, and by one row
    hop = np.full((states, states), FAR, np.int64)
    np.fill_diagonal(hop, 0)
    for q in range(states):
        for to, price in zip(grammar.target[grammar.end, q, inserts], grammar.cost[grammar.end, q, inserts], strict=True):
            if to >= 0:
                hop[q, to] = min(hop[q, to], price)
    for k in range(states):
        hop = np.minimum(hop, hop[:, k : k + 1] + hop[k])
    step = np.full((grammar.codes, states, states), FAR, np.int64)
    for code, q, arc in np.ndindex(grammar.codes, states, grammar.first_insert):
        to = grammar.target[code, q, arc]
        if to >= 0:
            step[code, q, to] = min(step[code, q, to], grammar.cost[code, q, arc])
    both = (hop[None, :, :, None] + step[:, None, :, :]).min(2)
    for back, count in enumerate(active.tolist(), 1):
        p = order[:count]
        row = starts[p] + lengths[p] - back
        after = out[base[p] + lengths[p] - back + 1]
        out[base[p] + lengths[p] - back] = np.minimum((both[codes[row]] + after[:, None, :]).min(2), FAR)
    return out


def crossing(grammar: Grammar, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Cheapest cost of each part from any state at its begin to any state at its end."""
    out = np.empty((len(starts) - 1, grammar.states, grammar.states), np.int64)
    base = starts[:-1] + np.arange(len(starts) - 1)
    for q in range(grammar.states):
        ends = np.full((len(starts) - 1, grammar.states), FAR, np.int64)
        ends[:, q] = 0
        out[:, :, q] = costs_to_end(grammar, codes, starts, ends)[base]
    return out


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks 0, 1, ... of tuples, equal ones alike."""
    rank = np.zeros(len(keys[0]), np.int64)
    for key in keys:
        values = np.unique(key, return_inverse=True)[1]
        rank = np.unique(rank * (int(values.max(initial=0)) + 1) + values, return_inverse=True)[1]
    return rank


class Ranked:
    """Optimal arcs of some parts and the ranks of their nodes.

    `ends` and `end_ranks` hold cost and rank of each part's terminal nodes; a
    lower rank stands for a lesser string of letters after the end.
    """

    def __init__(self, grammar: Grammar, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, end_ranks: np.ndarray) -> None:
        self.grammar, self.parts = grammar, len(starts) - 1
        self.base = starts[:-1] + np.arange(self.parts)
        self.last = self.base + np.diff(starts)
        self.costs = costs_to_end(grammar, codes, starts, ends)
        rows, states = self.costs.shape
        inner = np.ones(rows, bool)
        inner[self.last] = False
        node = np.arange(rows * states).reshape(rows, states)
        target, price = np.full((rows, states, len(grammar.letters)), -1, np.int64), np.full((rows, states, len(grammar.letters)), FAR)
        target[inner], price[inner] = grammar.target[codes], grammar.cost[codes]
        stays = np.arange(len(grammar.letters)) >= grammar.first_insert
        to = node[:, :1, None] + target + np.where(stays, 0, states)
        to[target < 0] = 0
        flat = self.costs.reshape(-1)
        optimal = (target >= 0) & (flat[to] + price == self.costs[:, :, None]) & (self.costs < FAR)[:, :, None]
        self.to, self.optimal, self.price = (x.reshape(rows * states, -1) for x in (to, optimal, price))
        self._rank(end_ranks, rows, states)

    def _rank(self, end_ranks: np.ndarray, rows: int, states: int) -> None:
        letters = np.where(self.optimal, self.grammar.letters, TERMINAL)
        least = letters.min(1)
        terminal = np.zeros(rows * states, bool)
        terminal.reshape(rows, states)[self.last] = True
        rank = least.copy()
        rank[terminal] = TERMINAL + 1 + end_ranks.reshape(-1)
        # after one letter: the row reached (equal strings consume equal rows) and the set of states there
        chosen = self.optimal & (letters == least[:, None])
        row = np.where(terminal, np.arange(rows * states) // states, np.where(chosen, self.to // states, 0).max(1))
        bit = np.int64(1) << (self.to % states)
        reached = np.bitwise_or.reduce(np.where(chosen, bit, 0), 1)
        reached[terminal] = np.int64(1) << (np.flatnonzero(terminal) % states)
        rank = dense(rank)
        while True:
            # nodes without an optimal arc and terminal nodes point to themselves
            far = np.full(len(rank), np.iinfo(np.int64).max)
            for q in range(states):
                here = (reached >> q) & 1 == 1
                far[here] = np.minimum(far[here], rank[row[here] * states + q])
            onward, mask = row.copy(), np.zeros(len(rank), np.int64)
            for q in range(states):
                node = row * states + q
                here = ((reached >> q) & 1 == 1) & (rank[node] == far)
                onward[here] = row[node[here]]
                mask[here] |= reached[node[here]]
            doubled = dense(rank, far)
            done = np.array_equal(onward, row) and np.array_equal(mask, reached)
            rank, row, reached = doubled, onward, mask
            if done:
                break
        self.ranks, self.reached = rank, reached

    def begins(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each part's first nodes: their ranks, and the sets of end states that their least strings lead to."""
        states = self.grammar.states
        first = self.base[:, None] * states + np.arange(states)
        return self.ranks[first], self.reached[first]

    def paths(self, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least cheapest path of each part from the state given in `begin`.

        Returns offsets (parts + 1) into the steps, and each step's kind of arc and cost.
        """
        states = self.grammar.states
        # letter, then rank of what follows, then the state, choose the arc
        follow = np.where(self.optimal, self.ranks[self.to], 0)
        bound = int(self.ranks.max(initial=0)) + 1
        key = np.where(self.optimal, (self.grammar.letters * bound + follow) * states + self.to % states, np.iinfo(np.int64).max)
        arc = key.argmin(1)
        here = np.arange(len(arc))
        moves = self.optimal.any(1)
        jump = np.where(moves, self.to[here, arc], here)
        jumps, length = [jump], moves.astype(np.int64)
        # length of every path by doubling
        while True:
            longer = length + length[jump]
            if np.array_equal(longer, length):
                break
            length, jump = longer, jump[jump]
            jumps.append(jump)
        first = self.base * states + begin
        steps = length[first]
        offsets = np.concatenate([[0], np.cumsum(steps)])
        at = np.repeat(first, steps)
        number = np.arange(offsets[-1]) - np.repeat(offsets[:-1], steps)
        for bit, table in enumerate(jumps):
            go = (number >> bit) & 1 == 1
            at[go] = table[at[go]]
        return offsets, arc[at], self.price[at, arc[at]]
