"""License scans: exact phrases, and short notices with a bounded number of edits.

Texts are lower-cased in A-Z. A notice may differ from a place of a text by up to k edits (insertions,
deletions, replacements of characters). Split into k + 1 pieces, one piece at least is then found as it is:
one automaton over all pieces of all notices gives candidate places, and the regex library's bounded-error
matching verifies each and gives the span with its number of edits. Whole texts are searched. For notices, a
line break with the white space and comment marks around it, and a run of blanks, count as one blank; spans are
those of the text as it stands.

Each candidate place is verified in a window of bounded size, that of the notice and 4 * k characters at most, so
that work grows with the text's length only. Of a notice's matches the best is a span, then the best of those
that don't overlap it, and so on; what a span cuts off of a window is searched again. Spans of one notice don't
overlap.

Null texts are empty; empty texts have no places; very long texts are searched whole. Rows are independent:
repeated rows give repeated rows, an empty table gives none. Only key and text are read, so other columns' names
don't matter.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from sievework.llm.common import in_arrow, slices

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices and the labels that the fuzzy search gives.
NOTICES = {
    "licensed under the apache license, version 2.0": "apache-2.0-notice",
    "released under the mit license": "mit-notice",
    "this work is licensed under the gnu general public license, version 3": "gpl-3-notice",
    "licensed under the gnu general public license": "gpl-notice",
    "licensed under a creative commons attribution": "cc-by-notice",
    "licensed under cc by": "cc-by-notice",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit-notice",
    "redistribution and use in source and binary forms": "bsd-notice",
    "mozilla public license": "mpl-notice",
    "all rights reserved": "reserved-notice",
}
#: One edit is allowed for so many characters of a notice.
PER_EDIT = 9
MOST_EDITS = 6
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SEPARATORS = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else 32 for b in range(256))
#: What counts as one blank in a search for notices.
_BREAK = re.compile(r"[ \t]*(?:[\r\n\x0b\x0c]+[ \t]*(?:(?://+|/\*+|\*+/?|#+|;+|%+|--+|<!--+)[ \t]*)?)+|[ \t]{2,}|\t")
#: Verified windows of a text that are kept, since notices repeat.
_KEPT = 4_096
_OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,edits:int>>"


class Distance:
    """The least number of edits between a notice and any part of a text, by Myers' bit vectors: most windows hold a
    piece and no notice, and are told by this in less time than by a search that fails."""

    def __init__(self, notice: str):
        self.size, self.all, self.last = len(notice), (1 << len(notice)) - 1, 1 << (len(notice) - 1)
        self.places: dict[str, int] = {}
        for i, ch in enumerate(notice):
            self.places[ch] = self.places.get(ch, 0) | 1 << i

    def least(self, text: str) -> int:
        up, down, edits, best, every, last = self.all, 0, self.size, self.size, self.all, self.last
        for ch in text:
            same = self.places.get(ch, 0)
            flat = (((same & up) + up) ^ up) | same
            rise = down | (every & ~(flat | up))
            fall = up & flat
            if rise & last:
                edits += 1
            elif fall & last:
                edits -= 1
                best = min(best, edits)
            rise = rise << 1 & every
            up = (fall << 1 & every) | (every & ~(same | down | rise))
            down = rise & (same | down)
        return best


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES):
        import ahocorasick
        import regex

        # a word of a phrase ends where a word ends; characters beyond ASCII are parts of words
        inside = r"0-9a-z\x80-\U0010ffff"
        self.phrases = [
            (p.split()[0], re.compile(rf"(?<![{inside}])" + _GAP.join(map(re.escape, p.split())) + rf"(?![{inside}])"), label) for p,
            label in phrases.items()
        ]
        self.notices, self.pieces, at = [], ahocorasick.Automaton(), {}
        for n, (notice, label) in enumerate(notices.items()):
            k = min(MOST_EDITS, len(notice) // PER_EDIT)
            # one pattern for each number of edits; the search takes that of the window's distance
            patterns = [regex.compile(f"(?b)(?:{regex.escape(notice, special_only=True)}){{e<={e}}}") for e in range(k + 1)]
            self.notices.append((label, len(notice), k, Distance(notice), patterns))
            cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                at.setdefault(notice[a:b], []).append((n, a))
        for piece, places in at.items():
            self.pieces.add_word(piece, (len(piece), places))
        self.pieces.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Of each notice, start and end of the places in which its pieces stand; starts that lie together share one."""
        starts: dict[int, set[int]] = {}
        for last, (size, places) in self.pieces.iter(text):
            for n, offset in places:
                starts.setdefault(n, set()).add(last - size + 1 - offset)
        out = {}
        for n, found in starts.items():
            _, length, k, *_ = self.notices[n]
            mine: list[tuple[int, int]] = []
            first = held = None
            for s in [*sorted(found), None]:
                if first is not None and (s is None or s - first > 2 * k):
                    mine.append((max(0, first - k), min(len(text), held + length + k)))
                    first = None
                first, held = (s if first is None else first), s
            out[n] = mine
        return out

    def verified(self, text: str) -> list[tuple[str, int, int, int]]:
        """Label, start, end and edits of the notices in a lower-cased text."""
        spans = set()
        for n, windows in self.windows(text).items():
            label, length, k, distance, patterns = self.notices[n]
            known: dict[str, tuple | None] = {}

            def best(a: int, b: int, least=length - k, most=k, distance=distance, patterns=patterns, known=known) -> tuple | None:
                """Edits, start and end of the best match of a window, which goes with it."""
                if b - a < least:
                    return None
                part = text[a:b]
                if part not in known:
                    if len(known) >= _KEPT:
                        known.clear()
                    edits = distance.least(part)
                    m = patterns[edits].search(part) if edits <= most else None
                    known[part] = m and (sum(m.fuzzy_counts), m.start(), m.end())
                got = known[part]
                return got and (got[0], a + got[1], a + got[2], a, b)

            queue = [m for a, b in windows if (m := best(a, b))]
            heapq.heapify(queue)
            taken: list[tuple[int, int]] = []
            while queue:
                edits, start, end, a, b = heapq.heappop(queue)
                # the spans that reach into the window stand together, as spans are in order and don't overlap
                at = bisect.bisect_right(taken, (a, a))
                while at and taken[at - 1][1] > a:
                    at -= 1
                inside = []
                while at < len(taken) and taken[at][0] < b:
                    inside.append(taken[at])
                    at += 1
                if all(end <= x or start >= y for x, y in inside):
                    bisect.insort(taken, (start, end))
                    spans.add((label, start, end, edits))
                    inside.append((start, end))
                free = [a, *(edge for span in sorted(inside) for edge in span), b]
                for x, y in zip(free[::2], free[1::2], strict=True):
                    if m := best(x, y):
                        heapq.heappush(queue, m)
        return sorted(spans, key=lambda s: (s[1], s[2], s[0], s[3]))

    def scan(self, text: str | None) -> tuple:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        count = lambda x: len(x.translate(_SEPARATORS).split())
        low = data.decode("utf-8", "surrogatepass")
        found = sorted((m.start(), label) for first, pattern, label in self.phrases if first in low for m in pattern.finditer(low))
        starts, words, at = [], 0, 0
        for start, _ in found:
            words, at = words + count(low[at:start].encode("utf-8", "surrogatepass")), start
            starts.append(words)
        labels = {label for _, label in found}
        squeezed, place = squeeze(low)
        spans = [(label, place(a), place(b - 1) + 1, edits) for label, a, b, edits in self.verified(squeezed)]
        score = 1.0 if labels else max((1 - s[3] / (s[2] - s[1]) for s in spans), default=0.0)
        base = sorted(labels)
        return (
            count(data), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base),
            ",".join(sorted(labels | {s[0] for s in spans})), max(0.0, score),
            [dict(zip(("label", "start", "end", "edits"), s, strict=True)) for s in spans]
        )


def squeeze(text: str) -> tuple[str, Callable[[int], int]]:
    """The text with breaks as one blank, and the place in text of a place in that."""
    out, ends, skipped, at, lost = [], [0], [0], 0, 0
    for m in _BREAK.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        lost += at - m.start() - 1
        # places after the blank that stands for the break
        ends.append(at - lost)
        skipped.append(lost)
    out.append(text[at:])
    return " ".join(out), lambda i: i + skipped[bisect.bisect_right(ends, i) - 1]


@lru_cache(maxsize=4)
def scanner(phrases: tuple, notices: tuple) -> Scanner:
    return Scanner(dict(phrases), dict(notices))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """key, word and phrase counts, labels, score and the verified spans of each row."""
    import pyarrow as pa

    kinds = tuple(phrases.items()), tuple(notices.items())
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
    names = [x.split()[0] for x in _OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scanner(*kinds)
        for part in slices(batches, text):
            cols = list(zip(*map(one.scan, part.column(text).to_pylist()), strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [key, *names])

    kept = docs.select(f"`{key}`", f"`{text}`")
    return in_arrow(kept, run, f"`{key}` {kept.schema[key].dataType.simpleString()}, {_OUT}")
