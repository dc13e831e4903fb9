"""A true edit metric, and a BK-tree over it."""

from __future__ import annotations


def edit_distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance without the restriction of optimal string
    alignment: insertions, deletions, substitutions and transpositions of
    neighbours, also around other edits. It satisfies the triangle inequality."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) or len(b)
    far = len(a) + len(b)
    seen: dict[str, int] = {}
    width = len(b) + 2
    rows = [[far] * width, [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [far, i]
        above, match = rows[i], 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), match
            cost = 1
            if x == y:
                cost, match = 0, j
            best = above[j] + cost
            if row[j] + 1 < best:
                best = row[j] + 1
            if above[j + 1] + 1 < best:
                best = above[j + 1] + 1
            if k and m:
                swap = rows[k][m] + (i - k - 1) + 1 + (j - m - 1)
                if swap < best:
                    best = swap
            row.append(best)
        rows.append(row)
        seen[x] = i
    return rows[-1][-1]


class BKTree:
    """Entries by distance from their parent; search prunes by the triangle inequality."""

    def __init__(self):
        self.root: tuple[str, list, dict] | None = None

    def add(self, word: str, value) -> None:
        if self.root is None:
            self.root = (word, [value], {})
            return
        node = self.root
        while True:
            d = edit_distance(word, node[0])
            if d == 0:
                node[1].append(value)
                return
            if d not in node[2]:
                node[2][d] = (word, [value], {})
                return
            node = node[2][d]

    def within(self, word: str, radius: int) -> list[tuple[int, str, object]]:
        """All (distance, entry, value) within the radius."""
        found, stack = [], [self.root] if self.root else []
        while stack:
            entry, values, children = stack.pop()
            d = edit_distance(word, entry)
            if d <= radius:
                found += [(d, entry, v) for v in values]
            stack += [child for at, child in children.items() if d - radius <= at <= d + radius]
        return found


def abbreviates(short: str, word: str) -> int | None:
    """How well short abbreviates word: 0 for the word, 1 for a prefix, 2 for
    letters in order from the first one; None if it doesn't."""
    if short == word:
        return 0
    if not short or len(short) >= len(word) or short[0] != word[0]:
        return None
    if word.startswith(short):
        return 1
    rest = iter(word)
    return 2 if all(ch in rest for ch in short) else None
