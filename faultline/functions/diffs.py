"""Unified differences of any two texts, line by line."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

NO_LINE_END = "\n\\ No newline at end of file\n"


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that rises in both numbers; ``pairs`` come by the first."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        tails[at : at + 1], ends[at : at + 1] = [b], [k]
        before[k] = ends[at - 1] if at else -1
    found, k = [], ends[-1] if ends else -1
    while k >= 0:
        found.append(pairs[k])
        k = before[k]
    return found[::-1]


def _anchors(old: np.ndarray, new: np.ndarray) -> list[tuple[int, int]]:
    """Places of equal lines: of lines that are there once on both sides, else of the k-th of each line on both."""
    places: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
    for side, lines in zip(places, (old, new)):
        for at, line in enumerate(lines.tolist()):
            side[line].append(at)
    common = places[0].keys() & places[1].keys()
    once = [line for line in common if len(places[0][line]) == len(places[1][line]) == 1]
    return _rising(sorted(pair for line in once or common for pair in zip(places[0][line], places[1][line])))


def changes(old: np.ndarray, new: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Stretches (a, b, c, d): lines a to b of the old text became lines c to d of the new one.

    Equal lines at both ends cost one comparison of arrays; between them anchors cut the rest into parts until no line is
    common to both sides of a part.
    """
    found, work = [], [(0, len(old), 0, len(new))]
    while work:
        a, b, c, d = work.pop()
        n = min(b - a, d - c)
        same = old[a : a + n] == new[c : c + n]
        front = n if same.all() else int(np.argmin(same))
        a, c, n = a + front, c + front, n - front
        same = old[b - n : b][::-1] == new[d - n : d][::-1]
        back = n if same.all() else int(np.argmin(same))
        b, d = b - back, d - back
        if a == b or c == d:
            if a < b or c < d:
                found.append((a, b, c, d))
            continue
        anchors = [(x + a, y + c) for x, y in _anchors(old[a:b], new[c:d])]
        if not anchors:
            found.append((a, b, c, d))
            continue
        ends = [(a - 1, c - 1), *anchors, (b, d)]
        work += [(x + 1, p, y + 1, q) for (x, y), (p, q) in zip(ends, ends[1:]) if p > x + 1 or q > y + 1]
    return sorted(found)


def _span(start: int, stop: int) -> str:
    """Lines of a hunk, counted from 1; an empty span names the line before it."""
    if stop - start == 1:
        return str(start + 1)
    return f"{start + 1 if stop > start else start},{stop - start}"


def _hunks(stretches: list, context: int) -> Iterator[list]:
    """Stretches with at most twice the context between them."""
    group: list = []
    for stretch in stretches:
        if group and stretch[0] - group[-1][1] > 2 * context:
            yield group
            group = []
        group.append(stretch)
    if group:
        yield group


def _lines(text: str) -> list[str]:
    """Lines with their ends; only a line feed ends a line."""
    lines = [line + "\n" for line in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    return lines if lines[-1] else lines[:-1]


def unified(old: str, new: str, path: str, context: int = 3) -> str | None:
    """The unified diff of two texts; null if they are equal."""
    if old == new:
        return None
    before, after = _lines(old), _lines(new)
    numbers: dict[str, int] = {}
    coded = [np.array([numbers.setdefault(line, len(numbers)) for line in side], np.int64) for side in (before, after)]
    out = [f"--- a/{path}\n", f"+++ b/{path}\n"]

    def put(sign: str, lines: list[str]) -> None:
        out.extend(sign + line if line.endswith("\n") else sign + line + NO_LINE_END for line in lines)

    for group in _hunks(changes(*coded), context):
        (a, _, c, _), (_, b, _, d) = group[0], group[-1]
        lead, rest = min(context, a), min(context, len(before) - b)
        out.append(f"@@ -{_span(a - lead, b + rest)} +{_span(c - lead, d + rest)} @@\n")
        at = a - lead
        for x, y, p, q in group:
            put(" ", before[at:x])
            put("-", before[x:y])
            put("+", after[p:q])
            at = y
        put(" ", before[at : b + rest])
    return "".join(out)
