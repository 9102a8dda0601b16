"""Regular expressions of many rules as one minimal deterministic automaton over bytes.

A rule's expression is read into a nondeterministic automaton, all rules are joined, and subset construction over byte
classes followed by minimisation gives transition rows. Supported: literals, classes, groups, alternation and the greedy
quantifiers ``? * + {m} {m,} {m,n}``; no expression may match the empty string.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from re import _parser as regex_reader

import numpy as np

MANY = int(regex_reader.MAXREPEAT)


class _Builder:
    """States with empty moves and moves on byte sets."""

    def __init__(self, fold_case: bool, backward: bool, empty: list[set[int]], moves: list[list[tuple[frozenset[int], int]]]) -> None:
        self.fold_case, self.backward, self.empty, self.moves = fold_case, backward, empty, moves

    def state(self) -> int:
        self.empty.append(set())
        self.moves.append([])
        return len(self.empty) - 1

    def _bytes(self, members: set[int]) -> frozenset[int]:
        if self.fold_case:
            members = members | {ord(chr(b).swapcase()) for b in members if b < 128 and chr(b).isalpha()}
        return frozenset(members)

    def sequence(self, items: Sequence[tuple], start: int) -> int:
        for item in reversed(items) if self.backward else items:
            start = self.item(item, start)
        return start

    def item(self, item: tuple, start: int) -> int:
        """Adds one parsed element behind ``start`` and returns its end."""
        name, value = str(item[0]), item[1]
        if name == "LITERAL":
            return self._move({value}, start)
        if name == "NOT_LITERAL":
            return self._move(set(range(256)) - {value}, start)
        if name == "IN":
            members: set[int] = set()
            negated = False
            for kind, what in value:
                if str(kind) == "NEGATE":
                    negated = True
                else:
                    members |= {what} if str(kind) == "LITERAL" else set(range(what[0], what[1] + 1))
            return self._move(set(range(256)) - members if negated else members, start)
        if name == "SUBPATTERN":
            return self.sequence(value[-1], start)
        if name == "BRANCH":
            end = self.state()
            for branch in value[1]:
                self.empty[self.sequence(branch, start)].add(end)
            return end
        if name == "MAX_REPEAT":
            least, most, body = value
            for _ in range(least):
                start = self.sequence(body, start)
            end = self.state()
            if most == MANY:
                loop = self.state()
                self.empty[start].add(loop)
                self.empty[self.sequence(body, loop)].add(loop)
                self.empty[loop].add(end)
            else:
                self.empty[start].add(end)
                for _ in range(most - least):
                    start = self.sequence(body, start)
                    self.empty[start].add(end)
            return end
        raise ValueError(f"{name} is not supported in a rule")

    def _move(self, members: set[int], start: int) -> int:
        if members and max(members) > 255:
            raise ValueError("rules are written over bytes")
        end = self.state()
        self.moves[start].append((self._bytes(members), end))
        return end


class Automaton:
    """Minimal automaton: ``rows[state][byte]`` is the next state, ``accepts[state]`` a bit per rule that ends there.

    With ``backward`` the text is read from its end and the expressions are mirrored, so a rule "ends" where its match
    begins; with ``anywhere`` a match may begin at any byte. States from ``first_accept`` on accept something; ``dead``
    is the state without a way out, or -1.
    """

    def __init__(self, patterns: Sequence[tuple[str, bool]], backward: bool = False, anywhere: bool = False) -> None:
        empty: list[set[int]] = []
        moves: list[list[tuple[frozenset[int], int]]] = []
        root = _Builder(False, backward, empty, moves).state()
        final: dict[int, int] = {}
        for number, (pattern, fold_case) in enumerate(patterns):
            if re.match(pattern, ""):
                raise ValueError(f"{pattern} matches the empty string")
            builder = _Builder(fold_case, backward, empty, moves)
            start = builder.state()
            empty[root].add(start)
            final[builder.sequence(list(regex_reader.parse(pattern)), start)] = 1 << number
        self._determinise(root, empty, moves, final, anywhere)

    def _determinise(self, root: int, empty: list[set[int]], moves: list, final: dict[int, int], anywhere: bool) -> None:
        # Bytes that every move treats alike share a class.
        sets = {members for out in moves for members, _ in out}
        signature = {b: tuple(b in s for s in sets) for b in range(256)}
        classes = {s: i for i, s in enumerate(dict.fromkeys(signature.values()))}
        class_of = [classes[signature[b]] for b in range(256)]
        member = [class_of.index(c) for c in range(len(classes))]

        # Sets of states are the bits of a number. behind[s]: what empty moves reach from s, itself included.
        behind = []
        for s in range(len(empty)):
            seen, todo = {s}, [s]
            while todo:
                for x in empty[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            behind.append(sum(1 << x for x in seen))
        steps: list[dict[int, int]] = []
        for out in moves:
            step: dict[int, int] = {}
            for members, end in out:
                for number, byte in enumerate(member):
                    if byte in members:
                        step[number] = step.get(number, 0) | behind[end]
            steps.append(step)

        def places(states: int) -> list[int]:
            out = []
            while states:
                low = states & -states
                out.append(low.bit_length() - 1)
                states ^= low
            return out

        numbers = {behind[root]: 0}
        order, table = [behind[root]], []
        for current in order:
            reached = [behind[root] if anywhere else 0] * len(member)
            for s in places(current):
                for number, target in steps[s].items():
                    reached[number] |= target
            for target in reached:
                if target not in numbers:
                    numbers[target] = len(order)
                    order.append(target)
            table.append([numbers[target] for target in reached])
        accepts = [0] * len(order)
        for i, states in enumerate(order):
            for s in places(states):
                accepts[i] |= final.get(s, 0)
        self._minimise(np.array(table), np.array(accepts), np.array(class_of))

    def _minimise(self, table: np.ndarray, accepts: np.ndarray, class_of: np.ndarray) -> None:
        """Split states until those of a part agree on what they accept and into which parts they lead."""
        part = np.unique(accepts, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == part.max():
                break
            part = finer
        count = part.max() + 1
        one = np.zeros(count, dtype=np.int64)
        one[part] = np.arange(len(part))
        accepted, next_part = accepts[one], part[table[one]]
        order = np.argsort(accepted > 0, kind="stable")
        place = np.empty(count, dtype=np.int64)
        place[order] = np.arange(count)
        self.table = place[next_part[order]][:, class_of].astype(np.int32)
        self.accepts = [int(a) for a in accepted[order]]
        self.start = int(place[part[0]])
        self.first_accept = int((accepted == 0).sum())
        stuck = (self.table == np.arange(count)[:, None]).all(axis=1) & (accepted[order] == 0)
        self.dead = int(np.flatnonzero(stuck)[0]) if stuck.any() else -1
        self._rows: list[list[int]] | None = None

    @property
    def rows(self) -> list[list[int]]:
        if self._rows is None:
            self._rows = self.table.tolist()
        return self._rows

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_rows": None}

    def hits_from_end(self, data: bytes) -> list[tuple[int, int]]:
        """(position, rules) for each byte at which the automaton, read from the end of ``data``, accepts; first byte first."""
        rows, state, accept, at = self.rows, self.start, self.first_accept, []
        for back, byte in enumerate(data[::-1]):
            state = rows[state][byte]
            if state >= accept:
                at.append((back, state))
        last = len(data) - 1
        return [(last - back, self.accepts[state]) for back, state in reversed(at)]

    def longest(self, data: bytes, start: int) -> int:
        """End of the longest match that begins at ``start``, or -1."""
        rows, state, accept, dead, end = self.rows, self.start, self.first_accept, self.dead, -1
        for i in range(start, len(data)):
            state = rows[state][data[i]]
            if state >= accept:
                end = i + 1
            elif state == dead:
                break
        return end
