"""Benchmark decontamination: Smith-Waterman alignment of all that an exact bound doesn't rule out.

Items and documents are sequences of lower-cased words without edge punctuation. An item and a document are
aligned locally (match +2, mismatch -1, gap -1); the score is the alignment's share of the item's own, and a
share of LEAK with LEAST_WORDS matches makes a leak. An item of fewer words than that may stand in any text by
chance: all its words must match, and the document may have SHORT_TIMES its words at most.

Nothing is left out before alignment that could reach that score. Each word of a document's part that an
alignment covers either matches, and then is a word of the item, or costs a point at least. So counting +2 for
words of the item and -1 for others, the best sum of a run of words is never below the alignment's score, and
an alignment ends where a run reaches the score asked for. Documents with too few words of an item, and places
where no run reaches it, are passed over; every other place is aligned, whatever edits it has.

Items are a stated query set: they are taken in blocks of BLOCK_CHARS characters, each broadcast within
that bound. Whole documents are scanned; an alignment holds one row, of the larger of 4,096 and six times the item's
words. Of items with a sixth of LONGEST words or more, only the score is worked out; they show the fewest matches that it
needs, and the part as its span.

Null or empty texts and items align with nothing; very long texts are scanned whole. Items of equal text each get
their pairs. Repeated documents give repeated pairs. Of documents only key and text are read, so other columns' names
don't matter. Without documents or without items there are no pairs, and nothing leaks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import in_arrow, slices, staged, without

#: Share of the item's own score that makes a leak.
LEAK = 0.35
#: Words that must match at least, for items so long.
LEAST_WORDS = 8
#: Shorter items leak only into documents of so many times their words at most.
SHORT_TIMES = 2
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_CHARS = 4 << 20
#: Pairs of item and place that are held at once; words and parts of texts that wait for alignment; cells of a row of alignments.
EVENTS, HELD_WORDS, HELD_JOBS, CELLS = 1 << 20, 1 << 20, 4_096, 1 << 14
#: In the number of a cell of an alignment: what a match counts, and a point. Words from which on such numbers don't suffice.
START, POINT, LONGEST = 1 << 22, 1 << 42, 1 << 19
_EDGE = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
_PAIR = "item_id long, score double, matched int, item_words int, start_word long, end_word long"


def tokens(text: str | None) -> list[bytes]:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return [w for w in (x.strip(_EDGE) for x in found) if w]


class Items:
    """A block of items: word numbers, and of each word the items that have it."""

    def __init__(self, rows: list[tuple[int, str | None]], leak: float = LEAK):
        self.ids = [i for i, _ in rows]
        split = [tokens(t) for _, t in rows]
        self.vocabulary: dict[bytes, int] = {}
        for words in split:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.words = [np.array([self.vocabulary[w] for w in words], np.int64) for words in split]
        self.distinct = [np.unique(w) for w in self.words]
        size = np.array([len(w) for w in self.words], np.int64)
        #: Of each item, the least score and the least number of its words in a document that can make a leak.
        self.need = np.maximum(1, np.ceil(leak * MATCH * size - 1e-9).astype(np.int64))
        self.fewest = np.maximum(-(-self.need // MATCH), np.minimum(LEAST_WORDS, size))
        #: Of each item, the most words of a document that it can leak into.
        self.most = np.where(size < LEAST_WORDS, SHORT_TIMES * size, np.iinfo(np.int64).max)
        # items of word w: holders[first[w] : first[w + 1]]
        pairs = np.concatenate([np.zeros(0, np.int64), *self.distinct])
        order = pairs.argsort(kind="stable")
        self.holders = np.repeat(np.arange(len(rows), dtype=np.int16 if len(rows) < 32_768 else np.int32), [len(d) for d in self.distinct])[order]
        self.first = np.searchsorted(pairs[order], np.arange(len(self.vocabulary) + 1))
        # words of the items that have any, item by item, with the times that each stands in its item
        self.filled = np.flatnonzero(size)
        counted = [np.unique(self.words[i], return_counts=True) for i in self.filled]
        self.item_words, self.item_times = (
            np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*counted, strict=True) if counted else ((), ()))
        )
        self.begins = np.cumsum([0, *(len(w) for w, _ in counted)])[:-1]
        #: The last place stands for words outside the vocabulary, which are numbered -1.
        self.flag = np.zeros(len(self.vocabulary) + 1, bool)

    def numbered(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in tokens(text)], np.int64)

    def possible(self, words: np.ndarray) -> np.ndarray:
        """Items of which the document has words enough: an alignment matches a word as often as both sides have it at most."""
        known = words[words >= 0]
        if not len(known):
            return np.zeros(0, np.int64)
        held = np.bincount(known, minlength=len(self.vocabulary))[self.item_words]
        shared = np.add.reduceat(np.minimum(held, self.item_times), self.begins)
        return self.filled[(shared >= self.fewest[self.filled]) & (len(words) <= self.most[self.filled])]

    def ends(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Items, and the places at which an alignment of each may end with the score that it needs."""
        items = self.possible(words)
        if not len(items):
            return
        places = np.flatnonzero(words >= 0)
        known = words[places]
        sizes = self.first[known + 1] - self.first[known]
        if sizes.sum() > EVENTS:
            for item in items.tolist():
                self.flag[self.distinct[item]] = True
                at = np.flatnonzero(self.flag[words])
                self.flag[self.distinct[item]] = False
                found = at[points(at) >= self.need[item]]
                if len(found):
                    yield item, found
            return
        # all items at once: pairs of item and place, by item
        owner = self.holders[np.repeat(self.first[known] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        asked = np.zeros(len(self.ids), bool)
        asked[items] = True
        few = np.flatnonzero(asked[owner])
        few = few[owner[few].argsort(kind="stable")]
        owner, at = owner[few].astype(np.int64), np.repeat(places, sizes)[few]
        hit = np.flatnonzero(points(at, owner) >= self.need[owner])
        owner, at = owner[hit], at[hit]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        yield from zip(owner[starts].tolist(), np.split(at, starts[1:]), strict=False)

    def aligned(self, texts: list[str | None]) -> Iterator[tuple]:
        """Number of the text and best alignment, for each text and each item that may leak into it."""
        jobs, held = [], 0
        for k, text in enumerate(texts):
            words = self.numbered(text)
            for item, ends in self.ends(words):
                size = len(self.words[item])
                jobs += [(k, item, a, words[a:b]) for a, b in cut(stretches(ends, size), size)]
            held += len(words)
            if held > HELD_WORDS or len(jobs) > HELD_JOBS:
                yield from self.best(jobs)
                jobs, held = [], 0
        yield from self.best(jobs)

    def best(self, jobs: list[tuple]) -> Iterator[tuple]:
        """jobs: number of the text, item, start and words of a part. Only parts that score enough are traced."""
        got: dict[tuple[int, int], tuple] = {}
        scored = scores([self.words[j[1]] for j in jobs], [j[3] for j in jobs])
        for (k, item, a, part), reached in zip(jobs, scored.tolist(), strict=True):
            if reached >= self.need[item] and ((k, item) not in got or reached > got[k, item][0]):
                score, matched, start, end = align(self.words[item], part)
                got[k, item] = (score, matched, a + start, a + end)
        for (k, item), (score, matched, start, end) in got.items():
            size = len(self.words[item])
            yield k, (self.ids[item], score / (MATCH * size), matched, size, start, end)


def points(at: np.ndarray, owner: np.ndarray | int = 0) -> np.ndarray:
    """Best sum of a run of words that ends at each place of an item's words; owner: numbers of items, in order."""
    total = (MATCH - MISMATCH) * np.arange(len(at)) + MISMATCH * at
    # each item's totals lie below those of the item before it, so that the running minimum starts anew
    total = total - owner * ((MATCH - MISMATCH) * len(at) + int(at.max(initial=0)) + 1)
    return total - np.minimum.accumulate(total) + MATCH


def scores(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs, many at a time. Cell j of a row holds its score + j, so that a gap along the row is a running maximum."""
    out = np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda i: (len(texts[i]), len(items[i])))
    while order:
        m = len(texts[order[-1]])
        some, order = order[-max(1, CELLS // (m + 1)) :], order[: -max(1, CELLS // (m + 1))]
        n = max(len(items[i]) for i in some)
        kind = np.int16 if m + (MATCH + 1) * n < 32_000 else np.int32
        item, text = np.full((n, len(some), 1), -2, np.int32), np.full((len(some), m), -3, np.int32)
        for c, i in enumerate(some):
            item[: len(items[i]), c, 0] = items[i]
            text[c, : len(texts[i])] = texts[i]
        ramp = np.arange(m + 1, dtype=kind)
        row = np.repeat(ramp[None], len(some), 0)
        best = row.copy()
        for word in item:
            step = (text == word).view(np.int8) * kind(MATCH - MISMATCH)
            step += row[:, :-1]
            row += kind(GAP)
            np.maximum(row, ramp, out=row)
            np.maximum(row[:, 1:], step, out=row[:, 1:])
            np.maximum.accumulate(row, axis=1, out=row)
            np.maximum(best, row, out=best)
        out[some] = (best - ramp).max(1)
    return out


def stretches(ends: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Parts of a document that hold all alignments with these ends (each covers less than 3 * size words); overlapping parts make one."""
    breaks = np.flatnonzero(ends[1:] - ends[:-1] > 3 * size)
    firsts, lasts = ends[np.append(0, breaks + 1)], ends[np.append(breaks, len(ends) - 1)]
    return list(zip(np.maximum(0, firsts + 1 - 3 * size).tolist(), (lasts + 1).tolist(), strict=True))


def cut(parts: list[tuple[int, int]], size: int) -> Iterator[tuple[int, int]]:
    """Long parts in overlapping pieces. A local alignment covers less than 3 * size words of a text, and so lies in a piece."""
    most = max(4096, 6 * size)
    for a, b in parts:
        while b - a > most:
            yield a, a + most
            a += most - 3 * size
        yield a, b


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman: score, matched words, start and end in text of the best local alignment: of equal scores the one with
    most matches, of those the one that starts first. Only one row is held: a cell's number has its score in front, then the
    matches on the way to it, then where that began; a gap along the row is a running maximum."""
    if max(len(item), len(text)) >= LONGEST:
        score = int(scores([item], [text])[0])
        return score, -(-score // MATCH), 0, len(text)
    m, edge = len(text), START - 1
    fresh = edge - np.arange(m + 1, dtype=np.int64)
    ramp = np.arange(m + 1, dtype=np.int64) * (GAP * POINT)
    row, best, end = fresh.copy(), 0, 0
    for word in item:
        now = row + GAP * POINT
        np.maximum(now[1:], row[:-1] + np.where(text == word, MATCH * POINT + START, MISMATCH * POINT), out=now[1:])
        # an alignment without points is none: the next one begins here
        np.copyto(now, fresh, where=now < POINT)
        row = np.maximum.accumulate(now - ramp) + ramp
        np.copyto(row, fresh, where=row < POINT)
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best // POINT, best % POINT // START, edge - best % START if best else end, end


@lru_cache(maxsize=2)
def _items(rows: tuple, leak: float) -> Items:
    return Items(list(rows), leak)


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[tuple]:
    """Items in blocks of bounded size, one at a time on the driver."""
    block, chars = [], 0
    for r in benchmark.select(F.col(f"`{item}`").cast("long"), F.col(f"`{text}`")).toLocalIterator():
        if block and chars + len(r[1] or "") > BLOCK_CHARS:
            yield tuple(block)
            block, chars = [], 0
        block.append((r[0], r[1]))
        chars += len(r[1] or "") + 16
    if block:
        yield tuple(block)


def pairs(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", leak: float = LEAK
) -> DataFrame:
    """key, item_id, score, matched, item_words, start_word, end_word of each document and item that align to the leak share."""
    import pyarrow as pa

    sc = docs.sparkSession.sparkContext
    kind = docs.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in _PAIR.split(", ")]
    types = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    kept, out = docs.select(f"`{key}`", f"`{text}`"), None
    for block in _blocks(benchmark, item, item_text):
        rows = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            items = _items(rows.value, leak)
            for part in slices(batches, text):
                at, found = [], []
                for k, p in items.aligned(part.column(text).to_pylist()):
                    if p[1] >= leak and p[2] >= min(LEAST_WORDS, p[3]):
                        at.append(k)
                        found.append(p)
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [part.column(key).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True))],
                        [key, *names]
                    )

        one = in_arrow(kept, run, f"`{key}` {kind}, {_PAIR}")
        out = one if out is None else out.unionAll(one)
    if out is None:
        return kept.limit(0).mapInArrow(lambda b: iter(()), f"`{key}` {kind}, {_PAIR}")
    return out


def clean(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", leak: float = LEAK
) -> DataFrame:
    """docs without the documents that leak an item."""
    found = staged(pairs(docs, benchmark, key, text, item, item_text, leak).select(F.col(f"`{key}`").alias("_leak")).distinct(), "leaks")
    return without(docs, key, found, "_leak")
