"""Spans: where a detector matched and what it saw, never the value; and how overlapping ones resolve."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Sequence
from typing import NamedTuple


class Span(NamedTuple):
    """Half-open offsets, the name of the kind, and ``secret`` or ``pii`` (``hint`` for wording that only selects)."""

    start: int
    end: int
    kind: str
    category: str


_KIND = re.compile(r"[a-z0-9:_-]{1,64}")
_FIRST = {"secret": 0, "pii": 1}


def leftmost(found: Iterable[Span]) -> list[Span]:
    """Spans without overlaps: the leftmost first, of those the longest, of those secrets; a span that overlaps a kept one goes."""
    kept, end = [], 0
    for s in sorted(found, key=lambda s: (s.start, -s.end, _FIRST.get(s.category, 9))):
        if s.start >= end:
            kept.append(s)
            end = s.end
    return kept


def pieces(found: Sequence[Span]) -> list[tuple[Span, int]]:
    """Disjoint spans that cover exactly what *found* covers, each with the place in *found* of the span it is cut from.

    Secrets are laid first, then by start, longest, kind; each later span keeps the parts that none before it covers. The
    cover is kept as sorted, merged intervals, so a span meets only those it touches.
    """
    starts: list[int] = []
    ends: list[int] = []
    out: list[tuple[Span, int]] = []
    for k in sorted(range(len(found)), key=lambda k: (_FIRST.get(found[k].category, 9), found[k].start, -found[k].end, found[k].kind)):
        s = found[k]
        lo = bisect.bisect_left(ends, s.start)
        hi = bisect.bisect_right(starts, s.end)
        at = s.start
        for a, b in zip(starts[lo:hi], ends[lo:hi], strict=True):
            if at < a:
                out.append((s._replace(start=at, end=min(a, s.end)), k))
            at = max(at, b)
        if at < s.end:
            out.append((s._replace(start=at), k))
        starts[lo:hi], ends[lo:hi] = [min([s.start, *starts[lo:hi]])], [max([s.end, *ends[lo:hi]])]
    return sorted(out)


def strictest(found: Sequence[Span]) -> list[Span]:
    """The spans of :func:`pieces`."""
    return [s for s, _ in pieces(found)]


def validate(found: Sequence[Span], length: int, name: str = "spans") -> None:
    """Refuse spans from outside that don't fit a text of *length* characters; the message holds no value."""
    for k, s in enumerate(found):
        at = f"{name}[{k}]"
        if not isinstance(s, Span):
            raise ValueError(f"{at} must be a Span")
        if any(isinstance(x, bool) or not isinstance(x, int) for x in (s.start, s.end)) or not 0 <= s.start < s.end <= length:
            raise ValueError(f"{at}: start/end must be integers with 0 <= start < end <= length of the text")
        if s.category not in _FIRST:
            raise ValueError(f"{at}: category must be one of {sorted(_FIRST)}")
        if not isinstance(s.kind, str) or not _KIND.fullmatch(s.kind):
            raise ValueError(f"{at}: kind must match [a-z0-9:_-]{{1,64}}")
