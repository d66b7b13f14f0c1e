"""Periodic runs of words: stretches that repeat with a period, found by suffix trees, and texts without the repeats.

A run is a stretch of consecutive words with smallest period q, at least ``max(12, 2 * q)`` words long, that no neighbouring
word extends. Words are runs of other characters than ASCII white space.

1. A task numbers the words of some megabytes of texts and drops what no run can hold. A word of a run lies in a six-word
   window that the run holds twice: where q is six or more, in its own or the next repeat; where q is less, since at least
   twelve words leave six or more in which each equals the one q words on. So all words outside such windows go, and again
   those of what is left whose window comes twice only in different stretches, until nothing more goes. Windows are
   compared by 64-bit hashes: equal hashes of unlike windows keep words that could go, and no run is lost.
2. What is left of a document, joined by words that occur nowhere else, is put into a suffix tree (Ukkonen), and so is its
   reversal. The tree's Euler tour with a table of least depths gives the longest common extension of two places in constant time.
3. The order of the leaves gives the longest Lyndon word at each place, for the order of the words' numbers and for the reverse
   one. Each is a candidate for a run's root; it is extended to both sides by the two trees, and kept if it is long enough.
   Every run has such a root, so at most two candidates a word are looked at, whatever the periods are.

Trees are built in a task for one document at a time, in lists of integers: some 600 bytes for each word that is left. Null
texts have no words and no runs; null ids, repeated rows and empty texts stay as rows of their own, other columns are ignored,
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from kbforge.llm.token_words import bounds, column_slices

#: Words of the shortest run, and of the windows that its words lie in: half as many.
SHORTEST = 12
WINDOW = SHORTEST // 2

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SuffixTree:
    """Ukkonen's tree of ``text``, numbers from 1 on. The end counts as 0, the least of them."""

    def __init__(self, text: list[int], most: int):
        self.size = len(text)
        text = [*text, 0]
        base = most + 1
        n = len(text)
        start, stop, link, children = [0], [0], [0], {}
        node = edge = length = pending = 0
        for i, symbol in enumerate(text):
            waiting = 0
            pending += 1
            while pending:
                if not length:
                    edge = i
                key = node * base + text[edge]
                child = children.get(key)
                if child is None:
                    children[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    first = start[child]
                    span = stop[child] - first
                    if length >= span:
                        node, edge, length = child, edge + span, length - span
                        continue
                    at = first + length
                    if text[at] == symbol:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    middle = len(start)
                    start += (first, i)
                    stop += (at, n)
                    link += (0, 0)
                    start[child] = at
                    children[key] = middle
                    children[middle * base + text[at]] = child
                    children[middle * base + symbol] = middle + 1
                    if waiting:
                        link[waiting] = middle
                    waiting = middle
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1
        self._finish(np.fromiter(children, np.int64, len(children)), np.fromiter(children.values(), np.int64, len(children)), base, np.array(start), np.array(stop))

    def _finish(self, keys: np.ndarray, child: np.ndarray, base: int, start: np.ndarray, stop: np.ndarray) -> None:
        """The Euler tour, in its short form: for each node in the order of first visits the depth of the parent it is entered from."""
        nodes = len(start)
        self._keys, self._child, self._base = keys, child, base
        self._parent = np.zeros(nodes, np.int64)
        self._parent[child] = keys // base
        order = self._visits(lambda symbol: base - 1 - symbol)
        depth, parent, width = [0] * nodes, self._parent.tolist(), (stop - start).tolist()
        for v in order[1:]:
            depth[v] = depth[parent[v]] + width[v]
        entered = np.array(depth)[self._parent]
        leaf = stop == self.size + 1
        leaf[0] = False
        visits = np.array(order)
        #: The place of each suffix's leaf in the tour.
        self.place = np.empty(self.size + 1, np.int64)
        self._leaves, self._suffix = leaf, start - entered
        self._numbered(visits, self.place)
        self._least = [entered[visits].astype(np.int32)]
        while 1 << len(self._least) <= nodes:
            half, last = 1 << (len(self._least) - 1), self._least[-1]
            self._least.append(np.minimum(last[:-half], last[half:]))

    def _visits(self, rank: Callable[[np.ndarray], np.ndarray]) -> list[int]:
        """Nodes by first visit; of two children that of higher ``rank`` comes first."""
        parent = self._keys // self._base
        by = np.argsort(parent * self._base + rank(self._keys % self._base))
        kids, at = self._child[by].tolist(), np.searchsorted(parent[by], np.arange(len(self._parent) + 1)).tolist()
        out, stack = [], [0]
        while stack:
            v = stack.pop()
            out.append(v)
            a, b = at[v], at[v + 1]
            if a < b:
                stack += kids[a:b]
        return out

    def _numbered(self, visits: np.ndarray, into: np.ndarray) -> None:
        at = np.flatnonzero(self._leaves[visits])
        into[self._suffix[visits[at]]] = at

    def reverse_order(self) -> np.ndarray:
        """Numbers of the suffixes by the reverse order of the symbols; the end is the least here too."""
        visits = np.array(self._visits(lambda symbol: np.where(symbol == 0, self._base - 1, symbol - 1)))
        out = np.empty(self.size + 1, np.int64)
        self._numbered(visits, out)
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the longest common extension to the right of places ``i`` and ``j``, which differ: the depth of the
        lowest common ancestor of their leaves, the least of the tour between them."""
        a, b = self.place[i], self.place[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            table = self._least[k]
            out[own] = np.minimum(table[low[own]], table[high[own] + 1 - (1 << k)])
        return out


def _next_less(ranks: np.ndarray, size: int) -> np.ndarray:
    """For each place the next one whose suffix is less: there its longest Lyndon word ends."""
    values, out, stack = ranks.tolist(), [size] * size, []
    for i in range(size - 1, -1, -1):
        own = values[i]
        while stack and values[stack[-1]] > own:
            stack.pop()
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return np.array(out, np.int64)


def runs_of(codes: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows ``start, length, period`` of the runs of ``codes``, sorted."""
    symbols, text = np.unique(codes, return_inverse=True)
    size, text = len(text), text + 1
    ahead = SuffixTree(text.tolist(), len(symbols))
    roots = [_next_less(ranks, size) for ranks in (ahead.place, ahead.reverse_order())]
    i, j = np.tile(np.arange(size), 2), np.concatenate(roots)
    right = np.zeros(2 * size, np.int64)
    inner = j < size
    right[inner] = ahead.common(i[inner], j[inner])
    del ahead
    back = SuffixTree(text[::-1].tolist(), len(symbols))
    left = np.zeros(2 * size, np.int64)
    inner = i > 0
    left[inner] = back.common(size - i[inner], size - j[inner])
    length, period = j - i + left + right, j - i
    good = length >= np.maximum(shortest, 2 * period)
    return np.unique(np.stack([i - left, length, period], 1)[good], axis=0)


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def repeated(words: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Which words lie in a window that their stretch holds twice; ``words`` are mixed numbers, stretches lie side by side."""
    count = len(words) - WINDOW + 1
    if count < 2:
        return np.zeros(len(words), bool)
    windows = words[:count].copy()
    for k in range(1, WINDOW):
        windows *= np.uint64(0x100000001B3)
        windows += words[k : k + count]
    first = np.flatnonzero(stretch[:count] == stretch[WINDOW - 1 :])
    windows = _mixed(windows[first] ^ _mixed(stretch[first]))
    bits = max(8, int(4 * len(first)).bit_length())
    slots = (windows >> np.uint64(64 - bits)).astype(np.int64)
    again = np.bincount(slots, minlength=1 << bits)[slots] > 1
    first, windows = first[again], windows[again]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    first = first[times[which] > 1]
    marks = np.zeros(len(words) + 1, np.int32)
    marks[first] += 1
    np.add.at(marks, first + WINDOW, -1)
    return np.cumsum(marks[:-1]) > 0


def candidates(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of words that may lie in a run, and the number of the stretch of each."""
    at, stretch, words = np.arange(len(codes)), doc, _mixed(codes)
    while True:
        kept = np.flatnonzero(repeated(words, stretch))
        new = np.concatenate([[False], (kept[1:] != kept[:-1] + 1) | (stretch[kept[1:]] != stretch[kept[:-1]])]) if len(kept) else np.zeros(0, bool)
        number = np.cumsum(new)
        kept = kept[np.bincount(number)[number] >= SHORTEST] if len(kept) else kept
        if len(kept) == len(at):
            return at, stretch
        at, words = at[kept], words[kept]
        parts = stretch[kept]
        stretch = np.cumsum(np.concatenate([[False], (at[1:] != at[:-1] + 1) | (parts[1:] != parts[:-1])])) if len(at) else at


def _runs(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid side by side, the number of each run's text, and ``start, length, period`` in it."""
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    at, stretch = candidates(codes, doc)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    owner, least, found, owners = doc[at], int(codes.max()) + 1, [], []
    cuts = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(at)]
    for a, b in zip(cuts, cuts[1:]):
        parts = stretch[a:b] - stretch[a]
        # Stretches are parted by words of their own.
        text, places = np.empty(b - a + parts[-1], np.int64), np.arange(b - a) + parts
        text[:] = least + np.arange(len(text))
        text[places] = codes[at[a:b]]
        back = np.full(len(text), -1)
        back[places] = at[a:b] - ends[owner[a]]
        rows = runs_of(text)
        rows[:, 0] = back[rows[:, 0]]
        found.append(rows)
        owners.append(np.full(len(rows), owner[a]))
    return np.concatenate(owners), np.concatenate(found)


def _kept(count: int, ends: np.ndarray, owner: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The words that no run holds after its first period."""
    marks = np.zeros(count + 1, np.int32)
    first = ends[owner] + runs[:, 0]
    np.add.at(marks, first + runs[:, 2], 1)
    np.add.at(marks, first + runs[:, 1], -1)
    return np.cumsum(marks[:-1]) == 0


Plant = Callable[[object, int], tuple[int, int] | None]


def _parsed(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts without nulls, and where each text's begin (one more for the end)."""
    words = pc.ascii_split_whitespace(texts)
    flat, ends = words.flatten(), bounds(words)
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(real)])
    return flat.filter(pa.array(real)), before[ends]


def find(docs: DataFrame, plant: Plant | None = None) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each document; map-only.

    ``runs`` are structs of start, length and period, sorted; ``collapsed`` is the words that no run holds after its first
    period, joined by single blanks. ``plant`` makes test cases: given an id and a number of words it may give ``a, p``, and
    word ``i >= a`` becomes word ``a + (i - a) % p`` before runs are sought.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in column_slices(batch.column(1)):
                ids = batch.column(0).slice(at, len(texts))
                at += len(texts)
                words, ends = _parsed(texts)
                if plant:
                    source, changed = np.arange(len(words)), False
                    for doc_id, a, b in zip(ids.to_pylist(), ends.tolist(), ends[1:].tolist()):
                        if got := plant(doc_id, b - a):
                            i = np.arange(b - a - got[0])
                            source[a + got[0] : b] = a + got[0] + i % got[1]
                            changed = True
                    words = words.take(pa.array(source)) if changed else words
                owner, runs = _runs(words.dictionary_encode().indices.to_numpy(), ends)
                counts = np.bincount(owner, minlength=len(texts))
                structs = pa.StructArray.from_arrays([pa.array(c) for c in runs.T], fields=list(_RUN))
                kept = _kept(len(words), ends, owner, runs)
                left = np.concatenate([[0], np.cumsum(kept)])[ends]
                if not kept.all():
                    words = words.filter(pa.array(kept))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.diff(ends)),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), structs),
                        pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words), " "),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    schema = f"doc_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def planted(doc_id: object, n: int) -> tuple[int, int] | None:
    """Fixed values of the query: every tenth document by the CRC-32 of its id is made periodic from some word on."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    return (a := g % n, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_runs``, the longest run (ties: the least start, then period) and digests of all runs and of the text without repeats."""
    rows = find(docs, planted)
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS s, -r.period AS p)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("b.p")
    return rows.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"), period.alias("period"), F.floor(1000 * F.col("b.length") / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Pairs of equal six-word windows at each distance, joined to stretches; of stretches of one extent the least period counts.
SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM documents),
p AS (SELECT rid, doc_id, ws, len(ws) AS n, coalesce(h % 10 = 0 AND len(ws) > 0, false) AS bad, (h // 10) % greatest(len(ws), 1) AS a, h // 10 AS g FROM t),
q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS per FROM p),
d AS (SELECT rid, doc_id, n, CASE WHEN bad THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % per ELSE i END]) ELSE ws END AS ws FROM q),
w AS (SELECT rid, i, array_to_string(ws[i + 1:i + 6], ' ') AS gram FROM (SELECT rid, ws, unnest(range(n - 5)) AS i FROM d)),
m AS (SELECT x.rid, y.i - x.i AS per, x.i FROM w x JOIN w y ON x.rid = y.rid AND x.gram = y.gram AND x.i < y.i),
k AS (SELECT rid, per, min(i) AS start, count(*) + 5 + per AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, per ORDER BY i) AS isle FROM m) GROUP BY rid, per, isle),
r AS (SELECT rid, start, length, min(per) AS per FROM k WHERE length >= greatest(12, 2 * per) GROUP BY rid, start, length),
c AS (SELECT DISTINCT rid, unnest(range(start + per, start + length)) AS i FROM r),
z AS (SELECT d.rid, coalesce(string_agg(u.word, ' ' ORDER BY u.i), '') AS kept FROM d LEFT JOIN
        (SELECT rid, i, ws[i + 1] AS word FROM (SELECT rid, ws, unnest(range(n)) AS i FROM d) ANTI JOIN c USING (rid, i)) u ON u.rid = d.rid GROUP BY d.rid),
s AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || per || chr(10), '' ORDER BY start, per) AS lines,
             max_by({'a': start, 'l': length, 'q': per}, [length, -start, -per]) AS b FROM r GROUP BY rid)
SELECT d.doc_id, coalesce(s.n_runs, 0) AS n_runs, s.b.a AS start, s.b.l AS length, s.b.q AS period, 1000 * s.b.l // s.b.q AS exponent_milli,
       sha256(coalesce(s.lines, '')) AS runs_sha256, sha256(z.kept) AS collapsed_sha256
FROM d JOIN z ON z.rid = d.rid LEFT JOIN s ON s.rid = d.rid
"""
