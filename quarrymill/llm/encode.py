"""Encoding of a corpus with a public byte-level BPE, reusing the encodings of repeated chunks.

A rolling hash over the text's code points cuts it into chunks where content says so, hence a passage that
recurs anywhere is cut alike and its encoding is looked up instead of computed. A cut may fall inside a
word, so every chunk join is re-encoded: from the last place in the left chunk to the first place in the
right chunk where the encoding provably agrees with that of the whole text. Such a place is one where a
blank follows a visible character: the tokenizer's splitting pattern has no alternative that matches a
visible character and then a blank, so no token spans it, matching starts afresh there, and nothing
before it looks beyond it. If a chunk has no such place, the re-encoding goes on into its neighbours.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lookalike import blocks

#: Where the vocabulary lies; a parameter of every function here.
VOCABULARY = os.environ.get("QUARRYMILL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the splitting pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of remembered texts and encodings a Python worker keeps; forgetting costs time, never results.
MEMORY = 96_000_000

_CUT_BITS, _WINDOW_STEPS = 8, 4  # a cut every 256 characters or so, by the 16 before it


@cache
def _blank_table() -> np.ndarray:
    t = np.zeros(0x110000, bool)
    t[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
    return t


_ENCODERS: dict[str, object] = {}


def encoder(path: str, raw: bytes | None = None):
    """The tokenizer of a vocabulary file, made once per process; ``raw`` is the file's content where the file itself may be elsewhere."""
    import tiktoken

    if path not in _ENCODERS:
        if raw is None:
            with open(path, "rb") as f:
                raw = f.read()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


@cache
def _token_bytes(path: str) -> np.ndarray:
    coder = encoder(path)
    return np.array([len(coder.decode_single_token_bytes(i)) for i in range(coder.n_vocab)], np.int64)


class ChunkEncoder:
    """Encodes texts, remembering the chunks between joins and the re-encoded joins themselves."""

    def __init__(self, path: str = VOCABULARY) -> None:
        self.path = path
        self.chunks: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, parts: list[str]) -> None:
        """New chunks of one text, in order, in one call.

        All but the first begin with a blank and follow a visible character, so each encodes as if alone;
        the lengths of the tokens in bytes tell where each one's ids end.
        """
        whole = "".join(parts)
        ids = np.array(encoder(self.path).encode_ordinary(whole), np.int32)
        if len(parts) == 1:
            self.chunks[whole] = ids.tobytes()
        else:
            sizes = map(len, parts) if whole.isascii() else (len(x.encode("utf-8", "surrogatepass")) for x in parts)
            ends = np.searchsorted(np.cumsum(_token_bytes(self.path)[ids]), np.cumsum(np.fromiter(sizes, np.int64, len(parts)))) + 1
            raw, at = ids.tobytes(), 0
            for x, e in zip(parts, (ends * 4).tolist()):
                self.chunks[x] = raw[at:e]
                at = e
        self.held += 3 * len(whole) + 250 * len(parts)

    @staticmethod
    def _cuts(c: np.ndarray) -> np.ndarray:
        h = (c + np.uint32(1)) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        factor = 0x9E3779B1
        for k in range(_WINDOW_STEPS):
            step = 1 << k
            if len(h) > step:
                h[step:] = h[step:] + np.uint32(pow(factor, step, 1 << 32)) * h[:-step]
        return np.flatnonzero(h < np.uint32(1 << (32 - _CUT_BITS))) + 1

    def encode_block(self, c: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts one after another, and how many there are up to each offset."""
        text = c.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        blank = _blank_table()[c]
        mark = np.zeros(len(c) + 1, bool)
        mark[1:-1] = blank[1:] & ~blank[:-1]
        mark[offsets] = True
        sure = np.flatnonzero(mark)
        cut = self._cuts(c)
        cut = cut[cut < len(c)]
        mark[:] = False
        mark[offsets] = True
        mark[sure[np.searchsorted(sure, cut, "right") - 1]] = True  # a join begins here
        mark[sure[np.searchsorted(sure, cut)]] = True  # and ends here
        bounds = np.flatnonzero(mark)
        at = bounds.tolist()
        parts = [text[a:b] for a, b in zip(at, at[1:])]
        known = self.chunks
        heads = np.zeros(len(c) + 1, bool)
        heads[offsets] = True
        fresh: list[str] = []
        new: set[str] = set()
        for x, head in zip(parts, heads[bounds].tolist()):
            if head and fresh:
                self._learn(fresh)
                fresh, new = [], set()
            if x not in known and x not in new:
                fresh.append(x)
                new.add(x)
        if fresh:
            self._learn(fresh)
        out = [known[x] for x in parts]
        counts = np.zeros(len(bounds), np.int64)
        counts[1:] = np.cumsum(np.fromiter(map(len, out), np.int64, len(out)) >> 2)
        if self.held > MEMORY:
            self.chunks, self.held = {}, 0
        return np.frombuffer(b"".join(out), np.int32), counts[np.searchsorted(bounds, offsets)]

    def encode_array(self, col: pa.Array) -> pa.Array:
        """A list of ids per text; null and empty texts give an empty list."""
        ids, at, total = [], [np.zeros(1, np.int64)], 0
        for _, _, c, offsets in blocks(col):
            if not len(c):
                at.append(np.full(len(offsets) - 1, total, np.int64))
                continue
            got, ends = self.encode_block(c, offsets)
            ids.append(got)
            at.append(total + ends[1:])
            total += len(got)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate(at).astype(np.int32)), pa.array(flat))


def token_ids(text, vocabulary: str = VOCABULARY):
    """Column of the texts' token ids without special tokens.

    The strings of special tokens are ordinary text. Null, and the empty text, give an empty list. Texts of
    any length are encoded whole. Repeated texts are encoded once per Python worker. The vocabulary is read
    where the session is and broadcast (about a megabyte, whatever the corpus), so executors need no copy.
    """
    with open(vocabulary, "rb") as f:
        content = SparkSession.active().sparkContext.broadcast(f.read())

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if vocabulary not in _ENCODERS:
            encoder(vocabulary, content.value)
        coder = ChunkEncoder(vocabulary)
        for col in batches:
            yield coder.encode_array(col)

    return run(text)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``ids`` of every document."""
    return docs.select("doc_id", token_ids(F.col("text"), vocabulary).alias("ids"))
