"""Compile a grammar to tables, and run a token stream through them.

Grammar text: ``name: body`` rules; ``|`` alternatives, ``( )`` groups, ``[ ]`` options,
``*`` and ``+`` repeats; quoted text and upper-case names are token classes, lower-case
names are rules. Every rule becomes a deterministic automaton; the table of a state
tells for each class of token which states to push and where to go, so that one look-up
consumes a token however many rules begin there. Where two alternatives begin with the
same class the earlier holds. A rule must not match nothing.
"""

from __future__ import annotations

import re

_PARTS = re.compile(r"\s+|('[^']+'|[A-Z_][A-Z0-9_]*\b|[a-z_][a-z0-9_]*\b|[|()\[\]*+])")


class Automaton:
    """States and arcs of all rules while they are built (non-deterministic)."""

    def __init__(self) -> None:
        self.arcs: list[list[tuple[str | None, int]]] = []

    def state(self) -> int:
        self.arcs.append([])
        return len(self.arcs) - 1

    def body(self, parts: list[str], at: int) -> tuple[int, int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b, at = self.sequence(parts, at)
            self.arcs[start].append((None, a))
            self.arcs[b].append((None, end))
            if at < len(parts) and parts[at] == "|":
                at += 1
                continue
            return start, end, at

    def sequence(self, parts: list[str], at: int) -> tuple[int, int, int]:
        start = end = self.state()
        while at < len(parts) and parts[at] not in ("|", ")", "]"):
            part = parts[at]
            if part in ("(", "["):
                a, b, at = self.body(parts, at + 1)
                if part == "[":
                    self.arcs[a].append((None, b))
            else:
                a, b = self.state(), self.state()
                self.arcs[a].append((part.strip("'"), b) if part[0] == "'" or part.isupper() else ("<" + part, b))
            at += 1
            if at < len(parts) and parts[at] in "*+":
                self.arcs[b].append((None, a))
                if parts[at] == "*":
                    self.arcs[a].append((None, b))
                at += 1
            self.arcs[end].append((None, a))
            # what follows begins at a state of its own, so that repeats don't leak into it
            end = self.state()
            self.arcs[b].append((None, end))
        return start, end, at

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for label, to in self.arcs[todo.pop()]:
                if label is None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


class Tables:
    """Tables of one grammar; ``start`` is the rule of a whole file."""

    def __init__(self, text: str, start: str = "file") -> None:
        rules: dict[str, str] = {}
        name = ""
        for line in text.strip().split("\n"):
            m = re.match(r"([a-z_][a-z0-9_]*):(.*)", line)
            if m:
                name = m[1]
                rules[name] = m[2]
            else:
                rules[name] += " " + line.strip()
        #: arcs[state] = (label, next) in the order of the grammar; ends[state]: the rule may end there
        self.arcs: list[list[tuple[str, int]]] = []
        self.ends: list[bool] = []
        self.begin: dict[str, int] = {}
        for rule, body in rules.items():
            self.begin[rule] = self._deterministic(rule, [p for p in _PARTS.findall(body) if p])
        self.table: list[dict[str, tuple[tuple[int, ...], int]]] = [{} for _ in self.arcs]
        self.conflicts: list[tuple[str, str]] = []
        first: dict[str, dict[str, tuple[tuple[int, ...], int]]] = {}
        for rule in rules:
            self._first(rule, first, ())
        for state in range(len(self.arcs)):
            self._fill(state, first)
        self.start = start

    def _deterministic(self, rule: str, parts: list[str]) -> int:
        nfa = Automaton()
        start, end, at = nfa.body(parts, 0)
        if at != len(parts):
            raise ValueError(f"rule {rule}: unexpected {parts[at]}")
        known: dict[frozenset[int], int] = {}

        def number(states: frozenset[int]) -> int:
            if states not in known:
                known[states] = len(self.arcs)
                self.arcs.append([])
                self.ends.append(end in states)
                todo.append(states)
            return known[states]

        todo: list[frozenset[int]] = []
        first = number(nfa.closure(frozenset([start])))
        while todo:
            states = todo.pop()
            moves: dict[str, set[int]] = {}
            for s in sorted(states):
                for label, to in nfa.arcs[s]:
                    if label is not None:
                        moves.setdefault(label, set()).add(to)
            self.arcs[known[states]] = [(label, number(nfa.closure(frozenset(to)))) for label, to in moves.items()]
        if self.ends[first]:
            raise ValueError(f"rule {rule} may be empty")
        return first

    def _first(self, rule: str, first: dict, path: tuple[str, ...]) -> dict:
        """For each class that may begin the rule: states to push and the state behind the token."""
        if rule in path:
            raise ValueError("left recursion: " + " ".join((*path, rule)))
        if rule not in first:
            out: dict[str, tuple[tuple[int, ...], int]] = {}
            for label, to in self.arcs[self.begin[rule]]:
                if label[0] == "<" and len(label) > 1 and label[1:] in self.begin:
                    for c, (push, at) in self._first(label[1:], first, (*path, rule)).items():
                        if c in out:
                            self.conflicts.append((rule, c))
                        out.setdefault(c, ((to, *push), at))
                elif label in out:
                    self.conflicts.append((rule, label))
                    if len(out[label][0]):
                        out[label] = ((), to)
                else:
                    out[label] = ((), to)
            first[rule] = out
        return first[rule]

    def _fill(self, state: int, first: dict) -> None:
        row = self.table[state]
        for label, to in self.arcs[state]:
            if label[0] == "<" and len(label) > 1 and label[1:] in self.begin:
                for c, (push, at) in first[label[1:]].items():
                    if c in row:
                        self.conflicts.append((f"state {state}", c))
                    row.setdefault(c, ((to, *push), at))
            elif label not in row:
                row[label] = ((), to)
            else:
                self.conflicts.append((f"state {state}", label))

    def parse(self, classes: list[str], start: str | None = None, inserts: set[int] | frozenset[int] = frozenset()) -> int:
        """Place of the first token that can't continue any valid text, or -1. ``inserts``: tokens before which the class ``ASI`` may be put in."""
        table, ends = self.table, self.ends
        stack: list[int] = []
        state = self.begin[start or self.start]
        i = 0
        for c in classes:
            while True:
                move = table[state].get(c)
                if move is not None:
                    push, to = move
                    if push:
                        stack += push
                    state = to
                    break
                if ends[state] and stack:
                    state = stack.pop()
                    continue
                move = table[state].get("ASI") if i in inserts else None
                if move is None:
                    return i
                stack += move[0]
                state = move[1]
            i += 1
        while stack and ends[state]:
            state = stack.pop()
        return -1 if ends[state] and not stack else i
