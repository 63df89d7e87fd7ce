"""Spans of text that scanners report: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterable

Span = tuple[str, int, int]


def written(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: Iterable[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()


class Taken:
    """Spans in order, to ask in logarithmic time what meets them; those of one kind do not overlap each other."""

    def __init__(self, spans: Iterable[Span] = ()):
        self._of: dict[str, list[tuple[int, int]]] = {}
        for span in spans:
            self.add(span)

    def add(self, span: Span) -> None:
        own = self._of.setdefault(span[0], [])
        if own and own[-1] > span[1:]:
            insort(own, span[1:])
        else:
            own.append(span[1:])

    def meets(self, start: int, end: int, kind: str | None = None) -> bool:
        for own in (self._of.get(kind, ()),) if kind else self._of.values():
            before = bisect_left(own, (end, end)) - 1
            if before >= 0 and own[before][1] > start:
                return True
        return False
