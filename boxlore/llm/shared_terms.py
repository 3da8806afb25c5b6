"""Term sets that several queries share, as a graph of partial sums.

A query is a bag of terms; its score for a document is the sum of the terms' values
there.  Sums of term sets that several queries hold are formed once: the terms of each
query stand in order of how many queries hold them, neighbours that occur side by side in
two queries or more become a node of the graph, the sum of both, and stand in for them in
those queries; this goes on with the nodes until no neighbours are shared.  The work of a
round is in proportion to what is left of the queries.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np


class Plan:
    """How to sum: rows 0 .. terms - 1 are the terms, each later row is the sum of two before it."""

    def __init__(self, queries: list[list[int]], terms: int):
        #: (first row, rows added, rows added to them) per level of the graph
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.rows = terms
        # a repeated term is a leaf for each repeat, all with the term's value
        leaves: dict[tuple[int, int], int] = {}
        left, self._term = [], []
        for query in queries:
            seen: Counter[int] = Counter()
            own = []
            for term in query:
                leaf = leaves.setdefault((term, seen[term]), len(leaves))
                if leaf == len(self._term):
                    self._term.append(term)
                seen[term] += 1
                own.append(leaf)
            left.append(own)
        row = dict(enumerate(self._term))
        symbols = len(leaves)
        while True:
            holders = defaultdict(list)
            for n, own in enumerate(left):
                for symbol in own:
                    holders[symbol].append(n)
            # symbols of the same queries stand together
            place = {s: k for k, s in enumerate(sorted(holders, key=lambda s: (-len(holders[s]), holders[s], s)))}
            for own in left:
                own.sort(key=place.__getitem__)
            shared = Counter(pair for own in left for pair in zip(own, own[1:]))
            made: dict[tuple[int, int], int] = {}
            taken: list[list[tuple[int, tuple[int, int]]]] = []
            for own in left:  # of overlapping neighbours the more shared pair goes first
                pairs = sorted(((-shared[p], k, p) for k, p in enumerate(zip(own, own[1:])) if shared[p] > 1))
                used, chosen = set(), []
                for _, k, pair in pairs:
                    if k not in used and k + 1 not in used:
                        used |= {k, k + 1}
                        chosen.append((k, pair))
                taken.append(chosen)
            worth = Counter(pair for chosen in taken for _, pair in chosen)
            good = sorted(pair for pair, n in worth.items() if n > 1)
            if not good:
                break
            for pair in good:
                made[pair] = symbols
                row[symbols] = self.rows + len(made) - 1
                symbols += 1
            self.levels.append((self.rows, np.array([row[a] for a, _ in good]), np.array([row[b] for _, b in good])))
            self.rows += len(good)
            for own, chosen in zip(left, taken):
                gone = set()
                for k, pair in chosen:
                    if pair in made:
                        own[k] = made[pair]
                        gone.add(k + 1)
                if gone:
                    own[:] = [symbol for k, symbol in enumerate(own) if k not in gone]
        #: rows whose sum is a query's score
        self.queries = [np.array([row[symbol] for symbol in own], int) for own in left]

    def scores(self, values: np.ndarray) -> np.ndarray:
        """Scores of all queries for the columns (documents) of ``values``, which has a row for each term."""
        sums = np.empty((self.rows, values.shape[1]), np.int64)
        sums[: len(values)] = values
        for first, a, b in self.levels:
            np.add(sums[a], sums[b], out=sums[first : first + len(a)])
        out = np.zeros((len(self.queries), values.shape[1]), np.int64)
        for n, rows in enumerate(self.queries):
            if len(rows):
                np.add.reduce(sums[rows], axis=0, out=out[n])
        return out

    def additions(self) -> int:
        return sum(len(a) for _, a, _ in self.levels) + sum(max(0, len(rows) - 1) for rows in self.queries)
