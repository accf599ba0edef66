"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the piece that they would form,
ties from left to right. The best pair is merged and its neighbours' entries are renewed, until no pair
forms a piece. What is not a piece at the end falls back to bytes.

No piece of such a vocabulary spans from a word into a following space mark, so a text falls apart at its
space marks, and at characters that are in no piece, into units that are merged alone. Words repeat: a slice's
texts are coded by its distinct words, which are merged together, one agenda column each, in arrays; longer ones
use a heap as agenda. Texts with runs of space marks are put together from their units; words among these are kept
in two bounded tables, the older of which goes when the younger is full. Vocabularies with pieces across space
marks are merged as whole texts.

Every whole text of an Arrow batch is also encoded by the library; a difference raises.

Null texts are empty ones; an empty text has begin and end ids only. Very long texts are encoded whole, in a
slice of their own. Rows are independent: repeated rows give repeated rows, and columns named like the outputs
are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sievework.llm.common import in_arrow, slices

if TYPE_CHECKING:
    import pyarrow as pa

MARK = "▁"
#: Words in each of the two tables that a Python worker keeps.
WORDS = 50_000
#: Words up to the last of these numbers of symbols, space mark included, are merged in arrays of these widths.
WIDTHS = (4, 6, 8, 10, 12, 16, 24)
#: Units that are merged in one array, and words whose ids are put together at once.
COLUMNS, PLACED = 20_000, 1 << 18
#: Agenda entries are a rank and, in the low bits, a place. No rank is as large as that of no piece.
_PLACE_BITS = 5
_NONE = (1 << 31 - _PLACE_BITS) - 1
_OUT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class AgendaEncoder:
    """Encodes with the pieces and scores of a model file; the library gives normaliser, vocabulary and check."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        #: The agenda's order: rank by falling score, one rank for equal scores.
        scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        places = {x: r for r, x in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: places[x] for p, x in scores.items()}
        self.bytes_ = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.first, self.last = struct.pack("<I", sp.bos_id()), struct.pack("<I", sp.eos_id())
        self.separable = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.units = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        joined = re.escape("".join(sorted(set().union(*self.ids))))
        self.runs = re.compile(f"[{joined}]+|[^{joined}]", re.S)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._arrays(n)

    def _arrays(self, n: int) -> None:
        """Symbols of code points, and the pieces that pairs of symbols form: row x of the table of pairs stands
        at place[x] of one line, put where no rows collide; owner tells whose entry a place holds."""
        self.symbol = np.full(0x110000, -1, np.int32)
        rows: dict[int, list[tuple[int, int]]] = {}
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
            for k in range(1, len(p)):
                if (x := self.ids.get(p[:k])) is not None and (y := self.ids.get(p[k:])) is not None:
                    rows.setdefault(x, []).append((y, i))
        room, rng = 8 * sum(map(len, rows.values())) + 64, np.random.default_rng(7)
        self.place = np.zeros(n + 1, np.int32)
        self.owner = np.full(room + 2 * n + 2, -2, np.int32)
        for x, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
            ys, at = np.array([y for y, _ in row]), []
            while not len(at):
                tried = rng.integers(0, room, 32)
                at = tried[(self.owner[tried[:, None] + ys] == -2).all(1)]
            self.place[x] = at[0]
            self.owner[at[0] + ys] = x
        # symbol -1 has the last row, where nothing is
        self.place[n] = room + n + 1
        rank_of = np.full(n, _NONE, np.int32)
        for p, i in self.ids.items():
            rank_of[i] = self.rank[p]
        self.piece = np.zeros(len(self.owner), np.int32)
        for x, row in rows.items():
            for y, i in row:
                self.piece[self.place[x] + y] = i
        self.piece_rank = np.where(self.owner >= 0, rank_of[self.piece], _NONE).astype(np.int32)

    def merge(self, unit: str) -> list[int]:
        """Ids of one normalised unit, by a heap."""
        rank, push, pop = self.rank, heapq.heappush, heapq.heappop
        sym: list[str] = list(unit)
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, p) for i, p in enumerate(map(str.__add__, unit, unit[1:])) if (r := rank.get(p)) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = pop(agenda)
            left, j = sym[i], after[i]
            if not left or j >= n or left + sym[j] != piece:
                continue
            sym[i], sym[j] = piece, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(p := piece + sym[k])) is not None:
                    push(agenda, (r, i, p))
            if (h := before[i]) >= 0 and (r := rank.get(p := sym[h] + piece)) is not None:
                push(agenda, (r, h, p))
        out: list[int] = []
        for s in sym:
            if s:
                if (known := self.ids.get(s)) is not None:
                    out.append(known)
                else:
                    out.extend(self.bytes_[b] for b in s.encode())
        return out

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of the piece of each pair of symbols; none where there is no such piece."""
        at = self.place[x] + y
        return np.where(self.owner[at] == x, self.piece_rank[at], _NONE)

    def _merge_columns(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units are columns of code points, of which the first size count. Rows of ids, how many of each count, and
        whether a unit has a symbol that isn't a piece; such units aren't merged.

        Each column is an agenda: the ranks of its adjacent pairs. In each round every column that still has a
        piece to form merges its best pair, the leftmost of equals, so all columns get shorter by one symbol."""
        width, left = len(text), size.copy()
        place = np.arange(width, dtype=np.int32)[:, None]
        inside = place < left
        sym = np.where(inside, self.symbol[text], np.int32(-1))
        odd = ((sym < 0) & inside).any(0)
        live, done = np.flatnonzero(~odd), np.full(sym.shape, -1, np.int32)
        sym = sym[:, live]
        rank = self._ranks(sym[:-1], sym[1:])
        for w in range(width, 1, -1):
            first = (rank << _PLACE_BITS | place[: w - 1]).min(0)
            go = first < _NONE << _PLACE_BITS
            if not go.all():
                stop, go = np.flatnonzero(~go), np.flatnonzero(go)
                done[:w, live[stop]] = sym[:, stop]
                live, sym, rank, first = live[go], sym.take(go, 1), rank.take(go, 1), first[go]
            if not len(live):
                break
            left[live] -= 1
            best, col = first & (1 << _PLACE_BITS) - 1, np.arange(len(live))
            new = self.piece[self.place[sym[best, col]] + sym[best + 1, col]]
            sym = np.where(place[: w - 1] > best, sym[1:], sym[:-1])
            sym[best, col] = new
            rank = np.where(place[: w - 2] > best, rank[1:], rank[:-1])
            # the pairs on both sides of the new symbol
            c = np.flatnonzero(best > 0)
            at = best[c] - 1
            rank[at, c] = self._ranks(sym[at, c], new[c])
            c = np.flatnonzero(best < w - 2)
            at = best[c]
            rank[at, c] = self._ranks(new[c], sym[at + 1, c])
        else:
            done[:1, live] = sym
        return done.T, left, odd

    def _merge_rows(self, units: list[str], width: int) -> list[bytes | None]:
        """Packed ids of units of at most width symbols; None where a symbol isn't a piece."""
        text = np.array(units, f"<U{width}").view(np.uint32).reshape(-1, width).T
        ids, left, odd = self._merge_columns(text, np.fromiter(map(len, units), np.int64, len(units)))
        packed = ids.astype("<i4").tobytes()
        return [None if o else packed[i : i + 4 * n] for i, n, o in zip(range(0, len(packed), 4 * width), left.tolist(), odd.tolist(), strict=True)]

    def packed(self, units: list[str]) -> list[bytes]:
        """Packed ids of units in which no piece spans a space mark, sorted by length."""
        got: list[bytes | None] = []
        for width in WIDTHS:
            while (k := len(got)) < (end := bisect_right(units, width, lo=k, key=len)):
                got += self._merge_rows(units[k : min(end, k + COLUMNS)], width)
        got += [None] * (len(units) - len(got))
        rest = [i for i, ids in enumerate(got) if ids is None]
        for i, ids in zip(rest, self._apart([units[i] for i in rest]), strict=True):
            got[i] = ids
        return got

    def _apart(self, units: list[str]) -> list[bytes]:
        """Packed ids of units, each of which falls apart at characters that are in no piece; by a heap if it doesn't."""
        runs = [self.runs.findall(u) for u in units]
        apart = sorted({r for rs in runs if len(rs) > 1 for r in rs}, key=len)
        known = dict(zip(apart, self.packed(apart), strict=True)) if apart else {}
        return [
            b"".join(map(known.__getitem__, rs)) if len(rs) > 1 else array("I", self.merge(u)).tobytes()
            for u, rs in zip(units, runs, strict=True)
        ]

    def _words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words, each with a space mark before it: those of word i are n[i] from start[i] in one array."""
        import pyarrow.compute as pc

        _, ends, data = words.buffers()
        ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        chars = str(memoryview(data or b"")[ends[0] : ends[-1]], "utf-8") + "\0"
        chars = np.frombuffer(chars.encode("utf-32-le"), "<u4")
        size = pc.utf8_length(words).to_numpy()
        at, order = size.cumsum() - size, size.argsort(kind="stable")
        sizes = size[order] + 1
        parts, start, n, rest, put, k = [], np.zeros_like(size), np.zeros_like(size), [], 0, 0
        for width in WIDTHS:
            end = int(sizes.searchsorted(width, "right"))
            while k < end:
                rows, k = order[k : min(end, k + COLUMNS)], min(end, k + COLUMNS)
                text = np.full((width, len(rows)), ord(MARK), np.uint32)
                text[1:] = chars.take(at[rows] + np.arange(width - 1)[:, None], mode="clip")
                ids, left, odd = self._merge_columns(text, size[rows] + 1)
                left[odd] = 0
                parts.append(ids[np.arange(width) < left[:, None]])
                n[rows], start[rows] = left, put + left.cumsum() - left
                put += len(parts[-1])
                rest.append(rows[odd])
        rest = np.concatenate([*rest, order[k:]])
        for i, ids in zip(rest.tolist(), self._apart([MARK + w for w in words.take(rest).to_pylist()]), strict=True):
            parts.append(np.frombuffer(ids, "<i4"))
            n[i], start[i] = len(parts[-1]), put
            put += len(parts[-1])
        return np.concatenate([np.empty(0, "<i4"), *parts]), start, n

    def learn(self, words: set[str]) -> None:
        """Merge the words that no table holds; afterwards the young table has all of words."""
        if len(self.young) + len(words) > WORDS:
            self.young, self.old = {}, self.young
        missing = words.difference(self.young)
        again = missing & self.old.keys()
        self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
        new = sorted(missing - again, key=len)
        self.young.update(zip(new, self.packed([MARK + w for w in new]), strict=True))

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        import pyarrow as pa
        import pyarrow.compute as pc

        normal = self.lib.normalize(texts)
        simple = [self.separable and t.startswith(MARK) and MARK + MARK not in t for t in normal]
        split = pc.split_pattern(pa.array([t[1:] for t, s in zip(normal, simple, strict=True) if s], pa.large_string()), MARK)
        coded = split.values.dictionary_encode()
        bodies = iter(_bodies(*self._words(coded.dictionary), coded.indices.to_numpy(), split.offsets.to_numpy()))
        whole = {t: self.units.findall(t) if self.separable else [t] for t, s in zip(normal, simple, strict=True) if not s}
        units = set().union(*whole.values())
        marked = {u for u in units if self.separable and u[0] == MARK and u[1:2] not in ("", MARK)}
        self.learn({u[1:] for u in marked})
        others = sorted(units - marked, key=len)
        known = {u: self.young[u[1:]] for u in marked} | dict(zip(others, self.packed(others), strict=True))
        out = []
        for t, s in zip(normal, simple, strict=True):
            body = next(bodies) if s else b"".join(map(known.__getitem__, whole[t]))
            out.append(b"".join([self.first, body, self.last]))
        return out


def _bodies(ids: np.ndarray, start: np.ndarray, n: np.ndarray, words: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Packed ids of texts: word i has n[i] ids from start[i], and the words of text i stand from offsets[i] to offsets[i + 1]."""
    parts = []
    for k in range(0, len(words), PLACED):
        at = words[k : k + PLACED]
        size = n[at]
        end = size.cumsum()
        parts.append(ids[np.arange(end[-1]) + np.repeat(start[at] - end + size, size)])
    packed = b"".join(parts)
    ends = (4 * np.concatenate(([0], n[words].cumsum()))[offsets]).tolist()
    return [packed[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=2)
def encoder(model_file: str) -> AgendaEncoder:
    return AgendaEncoder(model_file)


def encode_texts(texts: list[str | None], model_file: str, check: bool = True) -> list[tuple[bytes, str]]:
    """Packed ids and decoded text of each text. check: the library encodes the texts too, and must agree."""
    enc, texts = encoder(model_file), [t or "" for t in texts]
    if not texts:
        return []
    packed = enc.encode_packed(texts)
    if check:
        # the library's ids as arrays: lists of so many integers take longer
        for text, ours, theirs in zip(texts, packed, enc.lib.encode_as_numpy(texts, add_bos=True, add_eos=True, num_threads=1), strict=True):
            if theirs.astype("<i4", copy=False).tobytes() != ours:
                raise ValueError(f"the agenda and the library differ on {text[:200]!r}")
    ids = [np.frombuffer(p, "<i4") for p in packed]
    return list(zip(packed, enc.lib.decode(ids, num_threads=1), strict=True))


def encode(df: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", check: bool = True) -> DataFrame:
    """df with the ids (array of ints) and the decoded text of each row appended. Without a name for it, the decoded
    text isn't kept; texts are decoded all the same."""
    import pyarrow as pa

    names = [c for c in df.columns if c not in (ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            packed, back = [], []
            for p, d in encode_texts(part.column(text).to_pylist(), model_file, check):
                packed.append(np.frombuffer(p, "<i4"))
                back.append(d)
            values = pa.array(packed, pa.list_(pa.int32()))
            texts = [pa.array(back, pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), values, *texts], [*names, ids, *[decoded] * len(texts)])

    schema = df.select(*[f"`{c}`" for c in names]).schema.add(ids, T.ArrayType(T.IntegerType()))
    schema = schema.add(decoded, "string") if decoded else schema
    return in_arrow(df, run, schema)


def digests(df: DataFrame, model_file: str, text: str = "text", key: str = "doc_id", check: bool = True) -> DataFrame:
    """key, number of ids, digests of the packed ids and of the decoded text: encode() without moving ids out of Python."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            rows = [
                (len(p) // 4, hashlib.sha256(p).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for p,
                d in encode_texts(part.column(text).to_pylist(), model_file, check)
            ]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [part.column(key), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    kept = df.select(f"`{key}`", f"`{text}`")
    return in_arrow(kept, run, f"`{key}` {kept.schema[key].dataType.simpleString()}, {_OUT}")

