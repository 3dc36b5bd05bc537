"""One deterministic automaton for many rules, as transition arrays.

A small regex dialect (literals, classes, groups, ``|``, ``? * + {m} {m,} {m,n}``)
is compiled to a nondeterministic automaton over bytes, made deterministic by
subset construction, and minimised by partition refinement. Reading a byte is
one array look-up whatever the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Nfa:
    """Byte automaton under construction: epsilon edges and byte-set edges."""

    def __init__(self) -> None:
        self.epsilon: list[list[int]] = []
        self.edges: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.epsilon.append([])
        self.edges.append([])
        return len(self.epsilon) - 1

    def parse(self, pattern: str, at: int) -> int:
        """Add ``pattern`` from state ``at``; return the state reached by a match."""
        end, rest = self._branches(pattern, 0, at, False)
        if rest != len(pattern):
            raise ValueError(f"unbalanced pattern {pattern!r}")
        return end

    def _branches(self, p: str, i: int, at: int, fold: bool) -> tuple[int, int]:
        end = self.state()
        while True:
            start = self.state()
            self.epsilon[at].append(start)
            i, last = self._sequence(p, i, start, fold)
            self.epsilon[last].append(end)
            if i < len(p) and p[i] == "|":
                i += 1
                continue
            return end, i

    def _sequence(self, p: str, i: int, at: int, fold: bool) -> tuple[int, int]:
        while i < len(p) and p[i] not in "|)":
            begin = i
            i = self._atom_end(p, i)
            low, high, after = self._repeat(p, i)
            for _ in range(low):
                at = self._atom(p, begin, at, fold)
            if high is None:
                hub = self.state()
                self.epsilon[at].append(hub)
                self.epsilon[self._atom(p, begin, hub, fold)].append(hub)
                at = hub
            else:
                skip = self.state()
                for _ in range(high - low):
                    self.epsilon[at].append(skip)
                    at = self._atom(p, begin, at, fold)
                self.epsilon[at].append(skip)
                at = skip
            i = after
        return i, at

    @staticmethod
    def _atom_end(p: str, i: int) -> int:
        if p[i] == "\\":
            return i + (4 if p[i + 1] == "x" else 2)
        if p[i] == "[":
            j = i + 1
            while p[j] != "]":
                j += 2 if p[j] == "\\" else 1
            return j + 1
        if p[i] == "(":
            depth, j = 0, i
            while True:
                if p[j] == "\\":
                    j += 2
                    continue
                if p[j] == "[":
                    j = _Nfa._atom_end(p, j)
                    continue
                depth += (p[j] == "(") - (p[j] == ")")
                j += 1
                if not depth:
                    return j
        return i + 1

    @staticmethod
    def _repeat(p: str, i: int) -> tuple[int, int | None, int]:
        if i < len(p) and p[i] in "?*+":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[p[i]] + (i + 1,)
        if i < len(p) and p[i] == "{":
            j = p.index("}", i)
            low, comma, high = p[i + 1 : j].partition(",")
            return int(low), (int(high) if high else None) if comma else int(low), j + 1
        return 1, 1, i

    def _atom(self, p: str, i: int, at: int, fold: bool) -> int:
        if p[i] == "(":
            inner = i + 1
            if p.startswith("?i:", inner):
                inner, fold = inner + 3, True
            return self._branches(p, inner, at, fold)[0]
        members = self._members(p, i)
        if fold:
            members |= {ord(chr(b).swapcase()) for b in members if chr(b).isascii() and chr(b).isalpha()}
        to = self.state()
        self.edges[at].append((frozenset(members), to))
        return to

    @staticmethod
    def _members(p: str, i: int) -> set[int]:
        def one(j: int) -> tuple[int, int]:
            if p[j] == "\\":
                return (int(p[j + 2 : j + 4], 16), j + 4) if p[j + 1] == "x" else (ord(p[j + 1]), j + 2)
            return ord(p[j]), j + 1

        if p[i] != "[":
            return {one(i)[0]}
        found: set[int] = set()
        j, end = i + 1, _Nfa._atom_end(p, i) - 1
        while j < end:
            low, j = one(j)
            if j < end - 1 and p[j] == "-":
                high, j = one(j + 1)
                found.update(range(low, high + 1))
            else:
                found.add(low)
        return found


@dataclass(frozen=True)
class Automaton:
    """``step[state * n_classes + classes[byte]]`` is the next state; state 0 has no match under way."""

    classes: np.ndarray
    step: np.ndarray
    n_classes: int
    accepts: np.ndarray  # bit r of accepts[state]: rule r ends here

    @property
    def n_states(self) -> int:
        return len(self.accepts)


def compile_rules(patterns: list[str]) -> Automaton:
    """Search automaton of all ``patterns``: a match may begin at any byte."""
    nfa = _Nfa()
    root = nfa.state()
    ends = [nfa.parse(p, root) for p in patterns]

    def closure(states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.epsilon[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.edges[s] or s in ends or s == root)

    # Bytes that no rule tells apart share a class.
    sets = list({members for out in nfa.edges for members, _ in out})
    signatures = [tuple(b in s for s in sets) for b in range(256)]
    order = {sig: k for k, sig in enumerate(dict.fromkeys(signatures))}
    classes = np.array([order[s] for s in signatures], dtype=np.uint8)
    sample = [int(np.flatnonzero(classes == k)[0]) for k in range(len(order))]
    moves = [{k: [t for members, t in out if b in members] for k, b in enumerate(sample)} for out in nfa.edges]

    start = closure({root})
    found, todo, rows = {start: 0}, [start], []
    while todo:
        current = todo.pop(0)
        row = []
        for k in range(len(sample)):
            reached = {t for s in current for t in moves[s][k]} | {root}
            target = closure(reached)
            if target not in found:
                found[target] = len(found)
                todo.append(target)
            row.append(found[target])
        rows.append(row)
    step = np.array(rows)
    accepts = np.array([sum(1 << r for r, e in enumerate(ends) if e in states) for states in found], dtype=np.uint32)

    # Partition refinement: states stay together while all their successors do.
    group = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    names = {int(group[0]): 0}
    for g in group:
        names.setdefault(int(g), len(names))
    first = [int(np.flatnonzero(group == g)[0]) for g in names]
    renamed = np.array([names[int(g)] for g in group])
    return Automaton(classes, renamed[step[first]].astype(np.uint16).ravel(), len(sample), accepts[first])


FEW = 64  # wrong lanes up to which reading them one by one beats reading them side by side


def _reread(auto: Automaton, columns: np.ndarray, states: np.ndarray, before: np.ndarray, wrong: list[int], true: np.ndarray) -> None:
    """Read wrong lanes again, each from where the one before it ends, on to the first lane that was read rightly."""
    step, width, last = auto.step.tolist(), auto.n_classes, -1
    for k in wrong:
        if k <= last:
            continue
        state = int(true[k])
        while k < states.shape[1] and before[k] != state:
            before[k] = state
            old, fresh = states[:, k].tolist(), []
            for symbol, was in zip(columns[:, k].tolist(), old):
                state = step[state * width + symbol]
                if state == was:
                    state = old[-1]
                    break
                fresh.append(state)
            states[: len(fresh), k] = fresh
            last = k
            k += 1


def run(auto: Automaton, data: np.ndarray, lane: int = 1024) -> np.ndarray:
    """State after each byte of ``data``, read from state 0.

    The bytes are cut in lanes that advance together. A lane guesses that it
    begins in state 0; where the lane before it ended otherwise, it is read
    again from that state until it meets the states it had found. Where few
    lanes are wrong, as within one long match, they are read one after the other
    along the text, so a long match costs one plain reading more.
    """
    n = len(data)
    lanes = max(1, -(-n // lane))
    padded = np.zeros(lanes * lane, dtype=np.uint8)
    padded[:n] = auto.classes[data]
    columns = np.ascontiguousarray(padded.reshape(lanes, lane).T)
    states = np.empty((lane, lanes), dtype=np.uint16)
    width = np.uint32(auto.n_classes)
    now = np.zeros(lanes, dtype=np.uint32)
    for j in range(lane):
        now = auto.step[now * width + columns[j]]
        states[j] = now
        now = now.astype(np.uint32)
    before = np.zeros(lanes, dtype=np.uint32)  # the state each lane was read from
    while True:
        true = np.concatenate([[0], states[-1, :-1]]).astype(np.uint32)
        wrong = np.flatnonzero(true != before)
        if not len(wrong):
            return states.T.reshape(-1)[:n]
        if len(wrong) < FEW:
            _reread(auto, columns, states, before, wrong.tolist(), true)
            continue
        before[wrong] = true[wrong]
        now = true[wrong]
        for j in range(lane):
            now = auto.step[now * width + columns[j, wrong]].astype(np.uint32)
            differs = now != states[j, wrong]
            if not differs.all():
                wrong, now = wrong[differs], now[differs]
                if not len(wrong):
                    break
            states[j, wrong] = now
