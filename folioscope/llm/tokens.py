"""Numbers for whitespace tokens, worked out once for each distinct token of a worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class TokenTable:
    """Row numbers and features of tokens. Beyond limit distinct tokens it begins anew, so its memory is bounded; tokens of over 64 characters are held by their text only within one call."""

    def __init__(self, features: Callable[[str], tuple[float, ...]], width: int, limit: int = 300_000):
        self.features, self.width, self.limit = features, width, limit
        self._begin()

    def _begin(self):
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, self.width), dtype=np.float32)

    def __call__(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row number of each token, table of the rows). Equal tokens of one call have equal numbers."""
        if len(self.rows) > self.limit:
            self._begin()
        rows = self.rows
        numbers = np.fromiter(map(rows.get, tokens, [-1] * len(tokens)), dtype=np.int64, count=len(tokens))
        places = np.nonzero(numbers < 0)[0].tolist()
        if places:
            first, new = len(rows), []
            for i in places:
                token = tokens[i]
                found = rows.get(token)
                if found is None:
                    found = rows[token] = first + len(new)
                    new.append(token)
                numbers[i] = found
            while first + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[first : first + len(new)] = [self.features(t) for t in new]
            for k, token in enumerate(new):
                if len(token) > 64:  # its number stays taken, its text doesn't stay in memory
                    del rows[token]
                    rows[f"\0{first + k}"] = first + k
        return numbers, self.table
