"""Probabilistic automata inferred from example strings by merging compatible states of their prefix tree."""

from __future__ import annotations

import numpy as np

ALPHA = 0.01
FLOOR = np.log(1e-4)


class Automaton:
    """States with counts of strings that pass, end, and go on by each symbol.

    Strings branch by the group of a symbol (`groups[symbol]`), so that strings of one format share their states however
    random they are; each state counts the symbols themselves. The prefix tree of the examples is merged state by state, in
    order of depth: a state joins an earlier one if the shares of strings that end there, and that go on by each symbol,
    differ by no more than Hoeffding's bound allows, and so on for the states that follow. Otherwise it stays a state of its
    own. What no example allows costs FLOOR and leads nowhere, with `restart` back to the first state.
    """

    def __init__(self, examples: list[bytes], groups: list[int], alpha: float = ALPHA, restart: bool = False):
        self.groups, self.bound = groups, np.sqrt(0.5 * np.log(2 / alpha))
        self.passing, self.ending, self.next, self.seen = [0], [0], [{}], [[0] * len(groups)]
        for example in examples:
            state = 0
            self.passing[0] += 1
            for symbol in example:
                self.seen[state][symbol] += 1
                group = groups[symbol]
                if group not in self.next[state]:
                    self.next[state][group] = len(self.next)
                    self.passing.append(0)
                    self.ending.append(0)
                    self.next.append({})
                    self.seen.append([0] * len(groups))
                state = self.next[state][group]
                self.passing[state] += 1
            self.ending[state] += 1
        self._merge()
        self._tables(restart)

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.passing[a], self.passing[b]
            most = self.bound * (n**-0.5 + m**-0.5)
            if abs(self.ending[a] / n - self.ending[b] / m) > most:
                return False
            if any(abs(x / n - y / m) > most for x, y in zip(self.seen[a], self.seen[b], strict=True)):
                return False
            stack += [(self.next[a][g], self.next[b][g]) for g in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to the automaton at a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.passing[a] += self.passing[b]
            self.ending[a] += self.ending[b]
            self.seen[a] = [x + y for x, y in zip(self.seen[a], self.seen[b], strict=True)]
            for group, target in self.next[b].items():
                if group in self.next[a]:
                    stack.append((self.next[a][group], target))
                else:
                    self.next[a][group] = target

    def _merge(self) -> None:
        fixed, known, k = [0], {0}, 0
        while k < len(fixed):
            edges = self.next[fixed[k]]
            group = min((g for g, target in edges.items() if target not in known), default=None)
            if group is None:
                k += 1
                continue
            target = edges[group]
            state = next((f for f in fixed if self._compatible(f, target)), None)
            if state is None:
                fixed.append(target)
                known.add(target)
            else:
                edges[group] = state
                self._fold(state, target)
                k = 0  # earlier states may have got new edges
        self.fixed = fixed

    def _tables(self, restart: bool) -> None:
        number = {state: i for i, state in enumerate(self.fixed)}
        n, symbols = len(number), len(self.groups)
        # The last state is where strings go that no example allows.
        self.go = np.full((n + 1, symbols), 0 if restart else n, np.int64)
        self.cost = np.full((n + 1, symbols), FLOOR)
        self.stop = np.full(n + 1, FLOOR)
        for state, i in number.items():
            total = max(1, self.passing[state])
            for symbol, count in enumerate(self.seen[state]):
                if count:
                    self.go[i, symbol] = number[self.next[state][self.groups[symbol]]]
                    self.cost[i, symbol] = np.log(count / total)
            if self.ending[state]:
                self.stop[i] = np.log(self.ending[state] / total)

    def likelihood(self, symbols: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Log-likelihood of each string, divided by its length, all strings stepped at once."""
        lengths = stops - starts
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        order = np.argsort(-lengths, kind="stable")
        longest = int(lengths.max(initial=0))
        active = np.searchsorted(-lengths[order], -np.arange(1, longest + 1), "right")
        for t in range(longest):
            own = order[: active[t]]
            symbol = symbols[starts[own] + t]
            total[own] += self.cost[state[own], symbol]
            state[own] = self.go[state[own], symbol]
        return (total + self.stop[state]) / np.maximum(lengths, 1)
