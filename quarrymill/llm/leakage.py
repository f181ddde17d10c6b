"""Held-out passages inside a corpus.

Every window of as many words as a leak must have, in the items and in the documents, gets a 64-bit
SimHash for equal windows; windows that are only nearly equal are found by the shingles they share (see
``ItemIndex.sharing``). Item fingerprints are indexed by ``radius + 1`` blocks of bits: two fingerprints within the radius
agree in at least one block, so looking up the blocks of a document's window misses no item window within
it. Candidates are verified exactly, by the weighted share of word shingles in common. All of it runs on
numpy arrays of words, in one pass over the documents and without any shuffle of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .lookalike import blocks, fold

#: Words of the shortest leak, words of a shingle.
WINDOW, SHINGLE = 14, 5
#: Fingerprints this many bits apart are candidates where only equal windows are wanted.
RADIUS = 2
#: Item windows held by a task at once (48 bytes each, 64 below a floor of 1). Larger sets of items go through in such blocks.
ITEM_BLOCK = 1_000_000

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@cache
def _word_table() -> np.ndarray:
    """Code point -> lower-case code point if a letter or digit, else 0."""
    t = np.zeros(0x110000, np.uint32)
    for c in range(0x30000):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            t[c] = ord(low) if len(low) == 1 else c
    return t


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.ones(n, np.uint64)
        k = 1
        while k < n:
            m = min(k, n - k)
            p[k : k + m] = p[:m] * np.uint64(pow(b, k, 1 << 64))
            k += m
        out.append(p)
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(c: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts: a hash of each word, its length, and the number of words before each offset."""
    c, offsets = fold(c, offsets)
    low = _word_table()[c]
    flag = np.zeros(len(c) + 2, np.int8)
    flag[1:-1] = low > 0
    turn = np.diff(flag)
    start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    inner = offsets[1:-1]
    if len(inner):  # texts touch without a separator: a word across such an offset is two
        k = np.searchsorted(start, inner, "right") - 1
        split = np.unique(inner[(k >= 0) & (start[k] < inner) & (end[k] > inner)]) if len(start) else inner[:0]
        if len(split):
            start, end = np.sort(np.concatenate((start, split))), np.sort(np.concatenate((end, split)))
    size = 1 << max(16, int(len(c)).bit_length())
    up, down = _powers(size)
    h = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(_mix(low.astype(np.uint64)) * up[: len(c)], out=h[1:])
    hashes = _mix((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64))
    return hashes, (end - start).astype(np.int32), np.searchsorted(start, offsets)


def simhash(w: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Fingerprints of all windows of consecutive words; bits are summed eight to a machine word."""
    n = len(w) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(w.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    total, width, at, sums = None, 1, 0, bits
    while True:
        if window & width:
            part = sums[at : at + n]
            total = part.copy() if total is None else np.add(total, part, out=total)
            at += width
        if width * 2 > window:
            break
        sums = sums[:-width] + sums[width:]
        width *= 2
    return np.packbits(total.view(np.uint8) > window // 2, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _ngram(w: np.ndarray, k: int) -> np.ndarray:
    h = w.copy()
    for i in range(1, k):
        h = h[:-1] * np.uint64(_BASE) + w[i:]
    return _mix(h)


class ItemIndex:
    """Item windows by blocks of their fingerprints' bits."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, at: np.ndarray, window: int, radius: int) -> None:
        """``at``: the number of words before each item, and in all."""
        self.window, self.radius = window, radius
        starts = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(at, at[1:])] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.words, self.sizes, self.start = hashes, sizes, starts
        self.item = np.asarray(ids)[np.searchsorted(at, starts, "right") - 1] if len(starts) else np.zeros(0, np.int64)
        self.print = simhash(hashes, window)[starts] if len(starts) else np.zeros(0, np.uint64)
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.grams: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        self.blocks = []
        for lo, hi in zip(edges, edges[1:]):
            key = self._key(self.print, lo, hi)
            order = np.argsort(key, kind="stable")
            there = np.zeros(1 << min(hi - lo, 22), bool)
            there[key & np.uint64(len(there) - 1)] = True
            self.blocks.append((int(lo), int(hi), key[order], order, there))

    @staticmethod
    def _key(prints: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return (prints >> np.uint64(lo)) & np.uint64((1 << (int(hi) - int(lo))) - 1)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position in ``prints``, item window) within the radius, once each."""
        out_a, out_b = [], []
        for n, (lo, hi, keys, order, there) in enumerate(self.blocks):
            key = self._key(prints, lo, hi)
            a = np.flatnonzero(there[key & np.uint64(len(there) - 1)])
            left, right = np.searchsorted(keys, key[a], "left"), np.searchsorted(keys, key[a], "right")
            many = right - left
            a = np.repeat(a, many)
            b = order[np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            apart = prints[a] ^ self.print[b]
            ok = np.bitwise_count(apart) <= self.radius
            for lo2, hi2, *_ in self.blocks[:n]:  # seen through an earlier block
                ok &= self._key(apart, lo2, hi2) != 0
            out_a.append(a[ok])
            out_b.append(b[ok])
        return np.concatenate(out_a), np.concatenate(out_b)

    def sharing(self, w: np.ndarray, sizes: np.ndarray, at: np.ndarray, floor: float, lookups: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, item window) once each, all of likeness ``floor`` or more among them; windows cross no offset in ``at``.

        Shingles of a document window that the item window lacks weigh at most ``1 - floor`` of it. So at least
        ``floor`` of its weight occurs somewhere in the items, and of any shingles that weigh more than the
        rest together one is in the item window: the rarest such are looked up.
        """
        k = min(SHINGLE, self.window)
        m = self.window - k + 1
        if len(w) < self.window or not len(self.start):
            return
        if self.grams is None:
            g = _ngram(self.words, k)
            order = np.argsort(g, kind="stable")
            there = np.zeros(1 << 22, bool)
            there[g & np.uint64(len(there) - 1)] = True
            self.grams = g[order], order, there
        keys, order, there = self.grams
        g, weight = _ngram(w, k), np.convolve(sizes, np.ones(k, np.int64), "valid")
        maybe = np.flatnonzero(there[g & np.uint64(len(there) - 1)])
        first, many = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        first[maybe] = np.searchsorted(keys, g[maybe], "left")
        many[maybe] = np.searchsorted(keys, g[maybe], "right") - first[maybe]
        held, full = (np.convolve(x, np.ones(m, np.int64), "valid") for x in (np.where(many > 0, weight, 0), weight))
        a = np.flatnonzero((held > 0) & (held >= (floor - 1e-9) * full))
        a = a[a + self.window <= at[np.searchsorted(at, a, "right")]]
        span = np.arange(m)
        for i in range(0, len(a), 20_000):
            part = a[i : i + 20_000]
            x = part[:, None] + span
            x = np.take_along_axis(x, np.argsort(many[x], axis=1, kind="stable"), 1)
            before = np.cumsum(weight[x], 1) - weight[x]
            use = (before <= (1 - floor + 1e-9) * full[part][:, None]) & (many[x] > 0)
            turn = np.cumsum((many[x] * use).sum(1)) // lookups
            for lo, hi in zip(*(np.searchsorted(turn, np.unique(turn), side) for side in ("left", "right"))):
                r, c = np.nonzero(use[lo:hi])
                at_word = x[lo:hi][r, c]
                n = many[at_word]
                y = order[np.repeat(first[at_word], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                s = (y[:, None] - span).ravel()
                b = np.minimum(np.searchsorted(self.start, s), len(self.start) - 1)
                pair = np.unique((np.repeat(np.repeat(r, n), m) * len(self.start) + b)[self.start[b] == s])
                yield part[lo + pair // len(self.start)], pair % len(self.start)

    def likeness(self, w: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 20_000) -> np.ndarray:
        """Weighted Jaccard of the shingles of document windows at ``a`` and item windows ``b``; a shingle weighs its letters."""
        k = min(SHINGLE, self.window)
        m = self.window - k + 1
        if not len(a):
            return np.zeros(0)
        gd, gi = _ngram(w, k), _ngram(self.words, k)
        ld, li = (np.convolve(s, np.ones(k, np.int64), "valid") for s in (sizes, self.sizes))
        out = []
        span = np.arange(m)
        for i in range(0, len(a), chunk):
            x, y = a[i : i + chunk, None] + span, self.start[b[i : i + chunk], None] + span
            px, py, wx, wy = gd[x], gi[y], ld[x], li[y]
            same = px[:, :, None] == py[:, None, :]
            common = (wx * same.any(2)).sum(1)
            out.append(common / np.maximum(wx.sum(1) + (wy * ~same.any(1)).sum(1), 1))
        return np.concatenate(out)

    def same(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows hold the same words in the same order."""
        span = np.arange(self.window)
        return (w[a[:, None] + span] == self.words[self.start[b][:, None] + span]).all(1)


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("likeness", pa.float64()), ("windows", pa.int32()), ("exact", pa.bool_())])


def _scan(index: ItemIndex, floor: float, doc_ids: np.ndarray, w: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows of documents that reach the floor; ``at``: the number of words before each document, and in all."""
    if len(w) < index.window:
        return
    parts = []
    for a, b in index.sharing(w, sizes, at, floor) if floor < 1 else [index.near(simhash(w, index.window))]:
        row = np.searchsorted(at, a, "right") - 1
        inside = a + index.window <= at[row + 1]
        a, b, row = a[inside], b[inside], row[inside]
        like = index.likeness(w, sizes, a, b)
        exact = np.zeros(len(a), bool)
        exact[like == 1] = index.same(w, a[like == 1], b[like == 1])
        ok = like >= floor
        parts.append((row[ok], b[ok], like[ok], exact[ok]))
    if not sum(len(p[0]) for p in parts):
        return
    row, b, like, exact = (np.concatenate(x) for x in zip(*parts))
    doc, item = doc_ids[row], index.item[b]
    order = np.lexsort((item, doc))
    doc, item, like, exact = doc[order], item[order], like[order], exact[order]
    head = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(doc[head]), pa.array(item[head]), pa.array(np.maximum.reduceat(like, head)),
            pa.array(np.diff(np.append(head, len(doc))).astype(np.int32)), pa.array(np.maximum.reduceat(exact, head)),
        ],
        schema=_OUT,
    )


def _texts(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, words, their lengths, words before each document) of a batch of ids and texts."""
    ids = b.column(0).to_numpy(zero_copy_only=False)
    for lo, hi, c, offsets in blocks(b.column(1), 250_000):
        yield ids[lo:hi], *words(c, offsets)


def _worded(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id``, ``words`` and ``sizes`` of the documents that have a window at all."""
    out = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, w, sizes, at in _texts(b):
                at = pa.array(at.astype(np.int32))
                got = pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(at, pa.array(w.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(sizes))], schema=out)
                yield got.filter(pa.array(np.diff(at) >= window))

    return docs.mapInArrow(run, "doc_id long, words array<long>, sizes array<int>")


def _lists(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As ``_texts``, of a batch of ``_worded``."""
    sizes = np.asarray(pa.compute.list_value_length(b.column(1))).astype(np.int64)
    w = np.asarray(b.column(1).flatten()).view(np.uint64)
    yield b.column(0).to_numpy(zero_copy_only=False), w, np.asarray(b.column(2).flatten()), np.concatenate(([0], np.cumsum(sizes)))


_BUILT: dict[tuple, ItemIndex] = {}


def _index_of(key: tuple, ids: list, texts: list[str], window: int, radius: int) -> ItemIndex:
    """The index of a block of items; a Python worker builds it once and keeps the last one."""
    if key not in _BUILT:
        _BUILT.clear()
        parts, sizes, at = [], [], [0]
        for _, _, c, offsets in blocks(pa.array(texts, pa.string())):
            w, n, ends = words(c, offsets)
            parts.append(w)
            sizes.append(n)
            at.extend((at[-1] + ends[1:]).tolist())
        _BUILT[key] = ItemIndex(np.array(ids, np.int64), np.concatenate(parts), np.concatenate(sizes), np.array(at), window, radius)
    return _BUILT[key]


def _item_blocks(items: DataFrame, size: int) -> Iterator[list]:
    """Items in blocks of bounded size; the driver holds one at a time."""
    block, held = [], 0
    for r in items.where(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        block.append(r)
        held += len(r["text"]) // 2 + 1  # no text has more words than that
        if held >= size:
            yield block
            block, held = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, radius: int = RADIUS, floor: float = 0.8, item_block: int = ITEM_BLOCK) -> DataFrame:
    """Documents that hold a window of an item, or nearly so.

    A row per document and item with ``likeness`` (the best of its windows), ``windows`` (how many pairs of
    windows reach ``floor``) and ``exact`` (whether one holds the item's words, all in order). Words are
    runs of letters and digits in the consistent form, in lower case. Null, empty and shorter texts have no
    window. No pair of windows that reaches ``floor`` is missed; ``radius`` only serves a floor of 1. Items with
    equal text each count, and so do documents. The items are a stated query set: they meet all documents in
    blocks of ``item_block`` words at most, one block in a task's memory at a time. Where there are several
    blocks, the documents are folded into words once, and the table of words is what the blocks go over.
    """
    schema = "doc_id long, item_id long, likeness double, windows int, exact boolean"
    out = None
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    todo = _item_blocks(items, item_block)
    block = next(todo, None)
    while block is not None:
        following = next(todo, None)
        if out is None:
            source, parts_of = (texts, _texts) if following is None else (cut(_worded(texts, window)), _lists)
        ids, its = [r["item_id"] for r in block], [r["text"] for r in block]
        key = (xxhash.xxh64_intdigest(repr((ids, its))), window, radius)

        def run(batches: Iterator[pa.RecordBatch], key=key, ids=ids, its=its, parts_of=parts_of) -> Iterator[pa.RecordBatch]:
            index = _index_of(key, ids, its, window, radius)
            for b in batches:
                for part in parts_of(b):
                    yield from _scan(index, floor, *part)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
        block = following
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: how many documents hold it exactly or nearly, and the best likeness."""
    got = leaks(docs, items).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("exact").alias("exact_documents"), F.max("likeness").alias("best")
    )
    return items.select("item_id", "split", "kind").join(got, "item_id", "left").fillna(0, ["documents", "exact_documents"])


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the document holds at least ``WINDOW`` consecutive words of the item, in order."""
    return leaks(docs, items, floor=1.0).where("exact").select("doc_id", "item_id").distinct()
