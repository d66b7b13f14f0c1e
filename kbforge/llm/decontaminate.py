"""Benchmark decontamination by the q-gram lemma, with banded alignment of what remains.

Documents and benchmark items are normalised alike: lower case, and each run of other characters than letters and digits
is one space. An item of m characters may occur in a text with up to ``k = min(floor(RATE * m), (m - Q) // Q)`` edits.
Such an occurrence shares at least ``m - Q + 1 - k * Q`` q-grams with the item, on diagonals (position in the text less
position in the item) at most k apart. Diagonals are counted in bands of 2(k + 1) that overlap by half, so that one band
holds the whole occurrence; bands that reach the bound are kept, and an alignment in the band (any start and end in the
text) decides. Items shorter than ``Q`` or of which k would be negative count where they stand as whole words.

The benchmark is read in blocks of at most ``BLOCK_CHARS`` characters; a block's q-gram index (some 30 bytes a character)
is broadcast, and each block passes over all documents once; of several blocks one is held at a time.

Null texts and items count as empty; empty items occur nowhere. Rows that share an id are one document: its regions are
those of all its texts. Of regions of one item that overlap the first stays, of those at one place the one with the
fewest edits. Ids may be of any type. Null ids are kept, repeated rows give their regions once, equal items each give theirs. An empty
table on either side gives no regions. Other columns are ignored by ``regions`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from kbforge.functions.storage import materialize
from kbforge.llm.token_words import slices, texts_of, thrifty

Q = 8
RATE = 0.1
BLOCK_CHARS = 4_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _fold_table() -> np.ndarray:
    """Of each code point below 2^16 its lower case if it is a letter or digit, else a space."""
    table = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalnum():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_FOLD: list[np.ndarray] = []


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points with single spaces, none at the ends, and the position in ``text`` of each."""
    if not _FOLD:
        _FOLD.append(_fold_table())
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = raw < 1 << 16
    folded = _FOLD[0][np.where(low, raw, 0)]
    if not low.all():
        for i in np.flatnonzero(~low).tolist():
            folded[i] = raw[i] if chr(raw[i]).isalnum() else 32
    space = folded == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    at = np.flatnonzero(keep)
    out = folded[at]
    first, last = int(len(out) > 0 and out[0] == 32), len(out) - int(len(out) > 1 and out[-1] == 32)
    return out[first:last], at[first:last]


def _grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ``Q`` (a power of two) codes."""
    h, span = codes.astype(np.uint64), 1
    while span < Q:
        h = (h[:-span] * _MULT + h[span:]) if len(h) > span else h[:0]
        h ^= h >> np.uint64(29)
        span *= 2
    return h * _MULT


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.codes = [normalised(t or "")[0] for _, t in items]
        sizes = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.minimum((RATE * sizes).astype(np.int64), (sizes - Q) // Q)
        self.need = sizes - Q + 1 - self.budget * Q
        grams, owner, offset = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j, codes in enumerate(self.codes):
            if self.budget[j] >= 0:
                grams.append(_grams(codes))
                owner.append(np.full(len(grams[-1]), j))
                offset.append(np.arange(len(grams[-1])))
        g, self.owner, self.offset = np.concatenate(grams), np.concatenate(owner), np.concatenate(offset)
        order = np.argsort(g, kind="stable")
        self.grams, self.owner, self.offset = g[order], self.owner[order], self.offset[order]
        self.short: dict[str, list[int]] = {}
        for j, c in enumerate(self.codes):
            if self.budget[j] < 0 and len(c):
                self.short.setdefault(f" {_text(c)} ", []).append(j)
        bits = max(16, min(27, int(len(g) * 16).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.bloom = np.zeros(1 << bits, bool)
        self.bloom[self.grams >> self.shift] = True

    def whole_words(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Item, start and end of each short item that stands as whole words; one pass over the text for all of them."""
        if "finder" not in self.__dict__:
            self.finder = ahocorasick.Automaton()
            for padded, own in self.short.items():
                self.finder.add_word(padded, (len(padded) - 2, own))
            self.finder.make_automaton()
        for at, (size, own) in self.finder.iter(f" {_text(codes)} "):
            yield from ((j, at - 1 - size, at - 1) for j in own)

    def candidates(self, codes: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, item and lowest diagonal of each band that reaches its bound. ``codes`` is a run of texts."""
        grams = _grams(codes)
        at = np.flatnonzero(self.bloom[grams >> self.shift])
        none = np.zeros(0, np.int64)
        at = at[doc[at] == doc[at + Q - 1]] if len(at) else at
        lo = np.searchsorted(self.grams, grams[at], side="left")
        n = np.searchsorted(self.grams, grams[at], side="right") - lo
        if not n.sum():
            return none, none, none
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        flat = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, diag = self.owner[flat], np.repeat(at, n) - self.offset[flat]
        text = np.repeat(doc[at], n)
        # First the count of all of a text's q-grams for an item: most pairs fall short of the bound at once.
        pair = text * len(self.ids) + item
        known, inverse, total = np.unique(pair, return_inverse=True, return_counts=True)
        good = (total >= self.need[known % len(self.ids)])[inverse]
        pair, item, diag = pair[good], item[good], diag[good]
        if not len(pair):
            return none, none, none
        step = self.budget[item] + 1
        base = diag + len(codes) + 1  # diagonals may be negative
        width = 2 * (len(codes) + max(map(len, self.codes)) + 2)
        keys = np.concatenate([pair * width + base // step, pair * width + base // step - 1])
        bands, counts = np.unique(keys, return_counts=True)
        owner = (bands // width) % len(self.ids)
        bands = bands[counts >= self.need[owner]]
        item = (bands // width) % len(self.ids)
        return bands // width // len(self.ids), item, (bands % width) * (self.budget[item] + 1) - len(codes) - 1


_FAR = 1 << 20
_CHUNK = 512


def align(items: list[np.ndarray], texts: list[np.ndarray], low: np.ndarray, width: np.ndarray, limit: np.ndarray) -> list[tuple[int, int, int] | None]:
    """For each pair the fewest edits that turn the item into a part of the text on diagonals ``low`` to ``low + width``.

    Gives edits, start and end of that part, or None beyond ``limit``. All pairs advance together, an item character a
    step; pairs that are done or beyond their limit leave.
    """
    out: list[tuple[int, int, int] | None] = [None] * len(items)
    sizes, ends = np.array([len(i) for i in items]), np.array([len(t) for t in texts])
    most, cells = int(sizes.max()), int(width.max()) + 1
    pattern = np.full((len(items), most), 0xFFFFFFFF, np.uint32)
    window = np.full((len(items), most + cells), 0xFFFFFFFE, np.uint32)
    for r, (item, text) in enumerate(zip(items, texts)):
        pattern[r, : len(item)] = item
        a, b = max(0, int(low[r])), min(len(text), int(low[r]) + most + cells)
        if b > a:
            window[r, a - low[r] : b - low[r]] = text[a:b]
    shift = np.arange(cells, dtype=np.int32)
    rows = np.arange(len(items))
    own = shift <= width[:, None]
    pos = (low[:, None] + shift).astype(np.int32)
    start = pos.copy()
    cost = np.where(own & (pos >= 0) & (pos <= ends[:, None]), 0, _FAR).astype(np.int32)
    for i in range(1, most + 1):
        char = window[rows, i - 1 : i - 1 + cells]
        best = cost + (char != pattern[rows, i - 1, None])
        up, came = cost[:, 1:] + 1, start
        better = up < best[:, :-1]  # an item character is left out
        best[:, :-1] = np.where(better, up, best[:, :-1])
        came[:, :-1] = np.where(better, start[:, 1:], start[:, :-1])
        pos += 1
        best[~(own & (pos >= 0) & (pos <= ends[rows, None]))] = _FAR
        # text characters are put in: the least of best[j] - j so far, plus j
        level = best - shift
        run = np.minimum.accumulate(level, axis=1)
        source = np.maximum.accumulate(np.where(level == run, shift, 0), axis=1)
        cost = np.minimum(run + shift, _FAR)
        start = np.take_along_axis(came, source, axis=1)
        done = sizes[rows] == i
        if done.any() or i % 8 == 0:
            least = cost.min(axis=1)
            cost[~own] = _FAR
            for r in np.flatnonzero(done & (least <= limit[rows])).tolist():
                k = int(cost[r].argmin())
                out[rows[r]] = (int(cost[r, k]), int(start[r, k]), int(pos[r, k]))
            stay = ~done & (least <= limit[rows])
            if not stay.any():
                break
            if not stay.all():
                rows, own, pos, start, cost = rows[stay], own[stay], pos[stay], start[stay], cost[stay]
    return out


def _find(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """Text number, item number, edits, start and end in the text (code points) of each region."""
    pieces = [normalised(t) for t in texts]
    sizes = np.array([len(p[0]) + 1 for p in pieces], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.zeros(int(starts[-1]), np.uint32)
    for (c, _), s in zip(pieces, starts.tolist()):
        codes[s : s + len(c)] = c
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    text, item, low = index.candidates(codes, np.repeat(np.arange(len(texts)), sizes), len(texts))
    low, limit = low - starts[text], index.budget[item]
    rest = []
    for r, (t, j, d, k) in enumerate(zip(text.tolist(), item.tolist(), low.tolist(), limit.tolist())):
        # A verbatim copy needs no alignment.
        a, own = max(0, d), index.codes[j]
        part = pieces[t][0][a : max(a, d + 2 * k + 1 + len(own))].tobytes()
        at = part.find(own.tobytes())
        while at > 0 and at % 4:
            at = part.find(own.tobytes(), at + 1)
        if at >= 0:
            found.setdefault((t, j), []).append((0, a + at // 4, a + at // 4 + len(own)))
        else:
            rest.append(r)
    for k in range(0, len(rest), _CHUNK):
        some = rest[k : k + _CHUNK]
        pairs = [(int(text[r]), int(item[r])) for r in some]
        for key, got in zip(pairs, align([index.codes[j] for _, j in pairs], [pieces[t][0] for t, _ in pairs], low[some], 2 * limit[some] + 1, limit[some])):
            if got and got[2] > got[1]:
                found.setdefault(key, []).append(got)
    if index.short:
        for t, (c, _) in enumerate(pieces):
            for j, a, b in index.whole_words(c):
                found.setdefault((t, j), []).append((0, a, b))
    out = []
    for (t, j), regions in found.items():
        places = pieces[t][1]
        last = -1
        for edits, a, b in sorted(set(regions), key=lambda r: (r[1], r[0])):
            if a >= last:  # overlapping bands find the same region
                out.append((t, j, edits, int(places[a]), int(places[b - 1]) + 1))
                last = b
    return out


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about ``chars`` characters, read one after the other."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select("item_id", "text").distinct().toLocalIterator():
        if block and size + len(row.text or "") > chars:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text or ""))
        size += len(row.text or "")
    if block:
        yield block


def regions(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits, start, end`` of each region of a document that an item occurs in."""
    spark = docs.sparkSession
    kinds = [docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits long, start long, end long"
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    rest = blocks(benchmark)
    block, following = next(rest, None), None
    several = False
    while block:
        following = next(rest, None)
        several = several or following is not None
        shared = spark.sparkContext.broadcast(Index(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                first, rows = 0, []
                for part in slices(texts_of(batch.column(1))):
                    rows += [(first + t, index.ids[j], *rest) for t, j, *rest in _find(index, part)]
                    first += len(part)
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                columns = [pa.array([r[1] for r in rows], id_type), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(2, 5))]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "item_id", "edits", "start", "end"])

        found = docs.select("doc_id", "text").mapInArrow(thrifty(run), schema)
        if several:
            # One block after the other, so that no two indexes are held at once.
            found = materialize(found, "regions")
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
        block = following
    # Rows made in Python, even none, would have each executor start Python workers of another kind.
    if out is None:
        out = docs.select("doc_id", F.lit(None).cast(kinds[1]).alias("item_id"), *(F.lit(0).cast("long").alias(c) for c in ("edits", "start", "end"))).limit(0)
    return out.distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose ``doc_id`` has no region of an item."""
    name = "_hit"
    while name in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    hit = regions(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit[name]), "left_anti")
