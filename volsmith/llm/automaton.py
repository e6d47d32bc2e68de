"""Deterministic automata over bytes: several regular expressions in one transition table.

Expressions may use literals, classes, groups, alternation and repetition, over ASCII. They are
turned into nondeterministic automata, joined, made deterministic by subset construction and
minimised by partition refinement.
"""

from __future__ import annotations

from array import array
from collections import deque
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np


def _bytes_of(items) -> frozenset[int]:
    """The bytes of a parsed character class."""
    chosen: set[int] = set()
    negate = False
    for kind, value in items:
        if kind is op.NEGATE:
            negate = True
        elif kind is op.LITERAL:
            chosen.add(value)
        elif kind is op.RANGE:
            chosen.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"not supported in a class: {kind}")
    return frozenset(set(range(256)) - chosen if negate else chosen)


class _Nfa:
    """Nodes with byte-set edges and empty edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def node(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, start: int, either_case: bool, backwards: bool) -> int:
        """The node reached from ``start`` by the parsed expression ``tree``."""
        for kind, value in reversed(list(tree)) if backwards else tree:
            start = self._one(kind, value, start, either_case, backwards)
        return start

    def _one(self, kind, value, start: int, either_case: bool, backwards: bool) -> int:
        if kind in (op.LITERAL, op.IN):
            allowed = _bytes_of([(kind, value)] if kind is op.LITERAL else value)
            if either_case:
                allowed |= frozenset(ord(chr(b).swapcase()) for b in allowed if b < 128 and chr(b).isalpha())
            end = self.node()
            self.edges[start].append((allowed, end))
            return end
        if kind is op.SUBPATTERN:
            return self.add(value[-1], start, either_case, backwards)
        if kind is op.BRANCH:
            end = self.node()
            for choice in value[1]:
                first = self.node()
                self.empty[start].append(first)
                self.empty[self.add(choice, first, either_case, backwards)].append(end)
            return end
        if kind is op.MAX_REPEAT:
            low, high, body = value
            for _ in range(low):
                start = self.add(body, start, either_case, backwards)
            if high is op.MAXREPEAT:
                loop, end = self.node(), self.node()
                self.empty[start].append(loop)
                self.empty[self.add(body, loop, either_case, backwards)].append(loop)
                self.empty[loop].append(end)
                return end
            end = self.node()
            for _ in range(high - low):
                self.empty[start].append(end)
                start = self.add(body, start, either_case, backwards)
            self.empty[start].append(end)
            return end
        raise ValueError(f"not supported: {kind}")

    def closure(self, nodes) -> frozenset[int]:
        seen, open_nodes = set(nodes), list(nodes)
        while open_nodes:
            for n in self.empty[open_nodes.pop()]:
                if n not in seen:
                    seen.add(n)
                    open_nodes.append(n)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """``table[state + classes[byte]]`` is the next state; states are multiples of ``width``.

    States from ``accepting`` on accept; ``rules[state // width]`` are the numbers of the
    expressions that end there. State ``dead``, if not negative, is never left.
    """

    table: array
    classes: bytes
    width: int
    start: int
    accepting: int
    rules: tuple[tuple[int, ...], ...]
    dead: int


def compile_rules(patterns: list[tuple[str, bool]], anywhere: bool, backwards: bool = False) -> Dfa:
    """One automaton for all (expression, letters in either case).

    ``anywhere`` lets a match begin at every byte; otherwise at the first one only. ``backwards``
    reads the expressions from their ends.
    """
    nfa = _Nfa()
    root = nfa.node()
    ends: dict[int, int] = {}
    for number, (pattern, either_case) in enumerate(patterns):
        first = nfa.node()
        nfa.empty[root].append(first)
        ends[nfa.add(parser.parse(pattern), first, either_case, backwards)] = number

    sets = sorted({s for edges in nfa.edges for s, _ in edges}, key=sorted)
    member = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {m: i for i, m in enumerate(dict.fromkeys(member))}
    classes = bytes(kinds[m] for m in member)
    sample = [member.index(m) for m in kinds]

    start = nfa.closure([root])
    # From each node, by class of bytes, all that is reached.
    onward = [[(k, nfa.closure([end])) for allowed, end in edges for k, b in enumerate(sample) if b in allowed]
              for edges in nfa.edges]
    states, rows, todo = {start: 0}, [], deque([start])
    while todo:
        reached: list[set[int]] = [set(start) if anywhere else set() for _ in sample]
        for n in todo.popleft():
            for kind, nodes in onward[n]:
                reached[kind] |= nodes
        row = []
        for following in map(frozenset, reached):
            if following not in states:
                states[following] = len(states)
                todo.append(following)
            row.append(states[following])
        rows.append(row)
    step = np.array(rows)
    accepted = [tuple(sorted(ends[n] for n in nodes if n in ends)) for nodes in states]

    # Minimisation: states stay together while they accept the same and lead to the same blocks.
    kinds_of_accept = {a: i for i, a in enumerate(dict.fromkeys(accepted))}
    block = np.array([kinds_of_accept[a] for a in accepted])
    while True:
        _, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    representative = {int(b): i for i, b in reversed(list(enumerate(block)))}
    order = sorted(representative, key=lambda b: (bool(accepted[representative[b]]), representative[b]))
    new = {b: i for i, b in enumerate(order)}
    width = len(sample)
    table = array("i", [new[int(block[t])] * width for b in order for t in step[representative[b]]])
    rules = tuple(accepted[representative[b]] for b in order)
    plain = sum(not r for r in rules)
    dead = next((i * width for i in range(plain) if all(t == i * width for t in table[i * width:(i + 1) * width])), -1)
    return Dfa(table, classes, width, new[int(block[0])] * width, plain * width, rules, dead)


def ends_by_rule(dfa: Dfa, data: bytes) -> dict[int, list[tuple[int, int]]]:
    """One pass over ``data``: for each rule the runs (first end, last end) of places where it matches."""
    table, state, accepting = list_of(dfa), dfa.start, dfa.accepting
    hits = []
    for place, kind in enumerate(data.translate(dfa.classes), 1):
        state = table[state + kind]
        if state >= accepting:
            hits.append((place, state))
    runs: dict[int, list[tuple[int, int]]] = {}
    for place, state in hits:
        for rule in dfa.rules[state // dfa.width]:
            own = runs.setdefault(rule, [])
            if own and own[-1][1] == place - 1:
                own[-1] = (own[-1][0], place)
            else:
                own.append((place, place))
    return runs


_LISTS: dict[int, tuple[array, list[int]]] = {}


def list_of(dfa: Dfa) -> list[int]:
    """The table as a list, which is read faster; kept for each table of this process."""
    kept = _LISTS.get(id(dfa.table))
    if kept is None or kept[0] is not dfa.table:
        kept = _LISTS[id(dfa.table)] = (dfa.table, dfa.table.tolist())
    return kept[1]


def first_start(backward: Dfa, data: bytes, end: int, low: int) -> int | None:
    """The smallest start >= ``low`` of a match that ends at ``end``, by the backward automaton."""
    table, state, found = backward.table, backward.start, None
    for place in range(end - 1, low - 1, -1):
        state = table[state + backward.classes[data[place]]]
        if state == backward.dead:
            break
        if state >= backward.accepting:
            found = place
    return found
