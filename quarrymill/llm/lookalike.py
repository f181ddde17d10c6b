"""One consistent form for texts that look alike.

A batch's text becomes one numpy array of code points. Lookup tables give each code point its expansion
(nothing for invisible characters, several letters for ligatures and accented letters), cumulative sums
give the output offsets, and accents are composed with their letters by searching a table of pairs. No
Python string is made per row.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .wordsets import meet

#: Characters handled at once. Larger texts are handled alone, whole.
BLOCK_CHARS = 400_000

# Letters that look like Latin ones. Letters in another style (bold, italic, double-struck,
# full-width and so on) are not listed; Unicode's own decompositions give them.
_CYRILLIC = ("аеорсухіјѕһԁԛԝӏѵАВЕКМНОРСТХІЈЅҮԌԚԜѴҺ", "aeopcyxijshdqwlvABEKMHOPCTXIJSYGQWVH")
_GREEK = ("οανρϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "oavpcjABEZHIKMNOPTYXCJ")
_ARMENIAN = ("օոսցզհՕՍԼ", "onugqhOUL")
_CHEROKEE = ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏒᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTiYAJEWMHYGZ4RWVSLCPKB")
_OTHER = ("ɡⅼƖ‐‑", "glI--")
_LOOK_ALIKE = {a: b for odd, latin in (_CYRILLIC, _GREEK, _ARMENIAN, _CHEROKEE, _OTHER) for a, b in zip(odd, latin, strict=True)}
_BLANKS = [0x09, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
_BREAKS = [0x0A, 0x0B, 0x0C, 0x85, 0x2028, 0x2029]
_SPELLED_OUT = [*range(0xFB00, 0xFB07), 0x132, 0x133, *range(0x1C7, 0x1CD), *range(0x1F1, 0x1F4), *range(0x2160, 0x2180)]
_CR, _LF, _SPACE = 13, 10, 32


def _invisible(c: int) -> bool:
    if c in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= c <= 0x180F or 0xFE00 <= c <= 0xFE0F or 0xE0000 <= c <= 0xE0FFF:
        return True
    kind = ud.category(chr(c))
    return kind == "Cf" or kind == "Cc" and c not in (9, 10, 11, 12, 13, 0x85)


class Tables:
    """Lookup tables over all code points, built from Unicode's own properties by rule."""

    def __init__(self) -> None:
        top = 0x110000
        self.first = np.arange(top, dtype=np.uint32)  # the expansion, where it is one character
        self.length = np.ones(top, np.uint8)
        self.start = np.zeros(top, np.int32)
        self.mark = np.zeros(top, np.uint8)  # canonical combining class
        flat: list[int] = []
        pairs: dict[int, int] = {}
        for c in [*range(0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE1000)]:
            if 0xAC00 <= c <= 0xD7A3 or 0xD800 <= c <= 0xDFFF:
                continue
            ch = chr(c)
            self.mark[c] = ud.combining(ch)
            seq = [ord(x) for x in self._expand(ch)]
            if len(seq) == 1:
                self.first[c] = seq[0]
            else:
                self.length[c], self.start[c] = len(seq), len(flat)
                flat.extend(seq)
            canon = ud.decomposition(ch)
            if canon and canon[0] != "<" and " " in canon:
                a, b = (int(x, 16) for x in canon.split())
                if ud.normalize("NFC", ch) == ch:
                    pairs[a << 21 | b] = c
        self.flat = np.array(flat or [0], np.uint32)
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)

    @staticmethod
    def _expand(ch: str) -> str:
        c = ord(ch)
        if c in _BLANKS:
            return " "
        if c in _BREAKS:
            return "\n"
        if c == _CR:
            return ch
        if _invisible(c):
            return ""
        if c in _SPELLED_OUT or ud.decomposition(ch).startswith(("<wide>", "<narrow>", "<noBreak>", "<font>")):
            ch = ud.normalize("NFKC", ch)
        return "".join(_LOOK_ALIKE.get(x, x) for x in ud.normalize("NFD", ch))


@cache
def tables() -> Tables:
    return Tables()


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 bytes."""
    if not (data & 0x80).any():
        return data.astype(np.uint32)
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)


def blocks(col: pa.Array, size: int = BLOCK_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, code points, offsets) of runs of rows of about ``size`` bytes; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type)
    if not wide and not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        part = data[off[lo] : off[hi]]
        at = off[lo : hi + 1] - off[lo]
        pts = code_points(part)
        if len(pts) != len(part):
            seen = np.zeros(len(part) + 1, np.int64)
            np.cumsum((part & 0xC0) != 0x80, out=seen[1:])
            at = seen[at]
        yield lo, hi, pts, at
        lo = hi


def _without(c: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``c`` without the sorted positions ``gone``."""
    if not len(gone):
        return c, offsets
    keep = np.ones(len(c), bool)
    keep[gone] = False
    return c[keep], offsets - np.searchsorted(gone, offsets)


def _compose(c: np.ndarray, offsets: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Accents (and Hangul parts) joined with their letters, the first mark of every run, then the second, and so on."""
    at = np.flatnonzero(c >= 0x300)
    at = at[(t.mark[c[at]] > 0) | (c[at] >= 0x1161) & (c[at] <= 0x11C2)]
    if not len(at):
        return c, offsets
    first = np.isin(at, offsets)  # a mark at the start of a text has no letter
    fresh = first | np.concatenate(([True], np.diff(at) != 1))
    k = np.arange(len(at))
    head = np.maximum.accumulate(np.where(fresh, k, 0))
    rank = k - head
    if rank.any():  # runs of marks in canonical order
        order = np.lexsort((at, t.mark[c[at]], head))
        c[at] = c[at[order]]
    base, joined, cls = at - 1, np.zeros(len(at), bool), t.mark[c[at]]
    held = np.zeros(len(at), np.uint8)  # class of the last mark between a mark and its letter
    for r in range(int(rank.max()) + 1):
        i = k[(rank == r) & ~(first & (rank == 0))]
        if r:
            through = joined[i - 1] | (cls[i - 1] > 0) & ~first[i - 1]
            base[i] = np.where(through, base[i - 1], at[i - 1])
            held[i] = np.where(joined[i - 1], held[i - 1], np.where(through, cls[i - 1], 0))
        a, b = c[base[i]].astype(np.int64), c[at[i]].astype(np.int64)
        j = np.minimum(np.searchsorted(t.pair_key, a << 21 | b), len(t.pair_key) - 1)
        lv = (a >= 0x1100) & (a <= 0x1112) & (b >= 0x1161) & (b <= 0x1175)
        lvt = (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b >= 0x11A8) & (b <= 0x11C2)
        to = np.where(lv, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, np.where(lvt, a + b - 0x11A7, t.pair_to[j]))
        hit = ((t.pair_key[j] == (a << 21 | b)) | lv | lvt) & ((held[i] != cls[i]) | (cls[i] == 0))
        joined[i] = hit
        c[base[i[hit]]] = to[hit]
    return _without(c, offsets, at[joined])


def _edges(c: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions of blanks and line ends at the ends of each text."""
    lo, hi = offsets[:-1].copy(), offsets[1:].copy()
    padded = np.append(c, 0)
    for at, step, shift in ((lo, 1, 0), (hi, -1, -1)):
        todo = np.arange(len(at))
        while len(todo := todo[(lo[todo] < hi[todo]) & (padded[at[todo] + shift] <= _SPACE)]):
            at[todo] += step
    cut = [np.arange(x, y) for x, y in zip(offsets[:-1], lo) if x < y], [np.arange(x, y) for x, y in zip(hi, offsets[1:]) if x < y]
    parts = [*cut[0], *cut[1]]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def fold(c: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of several texts and their offsets, both in the consistent form."""
    t = tables()
    if not len(c):
        return c, offsets
    at = np.flatnonzero((c >= 0x7F) | (c < _SPACE) & (c != _LF))
    if len(at):
        odd = c[at]
        n = t.length[odd]
        c = c.copy()
        c[at] = np.where(n == 1, t.first[odd], t.flat[t.start[odd]])
        breaks = bool((odd == _CR).any())
        many = n > 1
        gone = at[n == 0]
        if many.any():
            where, odd, more = at[many] + 1, odd[many], n[many].astype(np.int64) - 1
            within = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            where = np.repeat(where, more)
            c = np.insert(c, where, t.flat[np.repeat(t.start[odd].astype(np.int64) + 1, more) + within])
            offsets = offsets + np.searchsorted(where, offsets, "right")
            gone = gone + np.searchsorted(where, gone, "right")
        c, offsets = _without(c, offsets, gone)
        if breaks:  # CR before LF goes, a lone CR becomes LF
            cr = np.flatnonzero(c == _CR)
            pair = np.append(c, 0)[cr + 1] == _LF
            pair &= ~np.isin(cr + 1, offsets)
            c[cr] = _LF
            c, offsets = _without(c, offsets, cr[pair])
        c, offsets = _compose(c, offsets, t)
    # a run of blanks is one blank; none at a text's ends
    blank = c == _SPACE
    twice = np.flatnonzero(blank[1:] & blank[:-1]) + 1
    twice = twice[~np.isin(twice, offsets)] if len(twice) else twice
    c, offsets = _without(c, offsets, twice)
    # nor is there one before a line's end
    last = np.flatnonzero((c[:-1] == _SPACE) & (c[1:] == _LF))
    c, offsets = _without(c, offsets, last[~np.isin(last + 1, offsets)] if len(last) else last)
    return _without(c, offsets, _edges(c, offsets))


def to_arrow(c: np.ndarray, offsets: np.ndarray) -> pa.Array:
    if not len(c) or c.max() < 0x80:
        raw = c.astype(np.uint8).tobytes()
    else:
        raw = c.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    at = offsets
    if len(raw) != len(c):
        width = np.zeros(len(c) + 1, np.int64)
        np.cumsum(1 + (c >= 0x80).astype(np.int8) + (c >= 0x800) + (c >= 0x10000), out=width[1:])
        at = width[offsets]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(raw)])


def fold_array(col: pa.Array) -> pa.Array:
    """The consistent form of each text of an Arrow column; null stays null."""
    out = [to_arrow(*fold(c, off)) for _, _, c, off in blocks(col)]
    res = pa.concat_arrays(out) if out else pa.array([], pa.large_string())
    if col.null_count:
        res = pa.compute.if_else(col.is_valid(), res, None)
    return res.cast(pa.string())


def consistent_form(text):
    """Column of texts in one consistent form: texts that look the same become equal.

    Invisible characters go; every kind of blank is one space, runs of them one, none at the ends of the text
    or of a line; line ends are LF; full-width and styled forms, ligatures and letters of other scripts that look like Latin ones become
    those; accents are composed. Case, accents, digits and real letters stay. Null gives null, a text
    without visible characters the empty text. Texts of any length are taken whole.
    """

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return fold_array(col)

    return run(text)


def forms(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``form`` of every document."""
    return docs.select("doc_id", consistent_form(F.col("text")).alias("form"))


def found(docs: DataFrame) -> DataFrame:
    """Pairs of documents whose texts differ as stored and look the same.

    Texts travel as 128-bit digests. Equal looks are grouped by digest and only looks with several stored
    texts go on; pairs are made of distinct stored texts first and of documents then, so copies of one
    text never meet each other and no group is gathered in one place. Null texts and texts without a
    visible character are no cases.
    """
    form = consistent_form(F.col("text"))
    look = F.when(F.length(form) > 0, F.md5(form)).alias("look")
    keyed = cut(docs.where(F.col("text").isNotNull()).select("doc_id", F.md5("text").alias("stored"), look)).where("look is not null")
    texts = keyed.select("look", "stored").distinct()
    several = texts.groupBy("look").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("look")
    texts = cut(texts.join(several, "look", "left_semi"))
    ab = meet(texts.select("look", F.col("stored").alias("a")), texts.select("look", F.col("stored").alias("b")), "look", "b").where("a < b").select("a", "b")
    left = keyed.select(F.col("stored").alias("a"), F.col("doc_id").alias("x")).distinct()
    right = keyed.select(F.col("stored").alias("b"), F.col("doc_id").alias("y")).distinct()
    return ab.join(left, "a").join(right, "b").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()
