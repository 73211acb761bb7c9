"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Every adjacent pair that the vocabulary can merge waits in the bucket of its merge rank;
two levels of bitmaps mark the buckets that hold something, so find-first-set gives the lowest rank at once. A bucket gives
its leftmost position first; entries whose pair has changed meanwhile are stale and skipped. A merge changes two pairs, so
a pre-token of n bytes costs about n queue steps, however long it is.

Texts are cut by the tokenizer's own pattern; each distinct pre-token is merged once a task and kept in a bounded cache.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from attestra.llm.common import map_rows

FREE, CACHE, CACHED_BYTES, ONCE_BITS = 200_000, 400_000, 48, 1 << 24
SCALAR_BYTES, ROWS = 4096, 512


NARROW = 0x300
WIDE = re.compile(f"[^\\x00-{chr(NARROW - 1)}]")


def _ranges(prefix: str) -> str:
    """The characters below NARROW of a general category, as the inside of a character class."""
    codes = [c for c in range(NARROW) if unicodedata.category(chr(c)).startswith(prefix)]
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Cuts a text by the pattern. Texts of characters below NARROW only go through the standard library's faster engine, with
    the pattern's categories written out; the full engine takes all others."""
    full = regex.compile(pattern).findall
    space = r"\t-\r \x85\xa0"
    narrow = pattern.replace(r"(?!\S)", f"(?![^{space}])").replace(r"\p{L}", f"\0{_ranges('L')}\0").replace(r"\p{N}", f"\0{_ranges('N')}\0").replace(r"\s", f"\0{space}\0")
    narrow = re.sub(r"\[\^?\0[^\[\]]*\]", lambda m: m[0].replace("\0", ""), narrow)  # inside a class already
    narrow = re.sub("\0([^\0]*)\0", lambda m: f"[{m[1]}]", narrow)
    if re.search(r"\\[pPXSDWRKdwb]|\(\?[^:!=]", narrow):
        return full
    fast = re.compile(narrow).findall
    return lambda text: full(text) if WIDE.search(text) else fast(text)


class Vocabulary:
    """ranks: bytes of each token with its id, which is its merge rank as well."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.find = splitter(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        pairs = sorted((ranks[t[:k]] << 32 | ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks)
        self.pairs = np.array([p for p, _ in pairs] + [-1], np.int64)  # left << 32 | right of every pair that merges, in order
        self.merged = np.array([r for _, r in pairs] + [-1], np.int32)
        self.pairs[-1] = np.iinfo(np.int64).max
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    def rank_pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair of ids merges into; -1 for none."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1).astype(np.int32)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many pre-tokens as int32 bytes: all lie in one linked list, with a stop between them, and one rank queue serves them
        together, a whole bucket at a time. Buckets hold arrays of positions; in a bucket, a pair whose left token a
        merge just before took is left out, as it would be one by one from the left."""
        if sum(map(len, pieces)) < SCALAR_BYTES:
            return [np.array(self.merge(p), np.int32).tobytes() for p in pieces]
        whole = [self.ranks.get(p) for p in pieces]
        todo = [p for p, w in zip(pieces, whole, strict=True) if w is None]
        sizes = np.fromiter(map(len, todo), np.int64, len(todo))
        data = np.frombuffer(b"\0".join([*todo, b""]), np.uint8)
        n = len(data)
        stops = np.cumsum(sizes + 1) - 1
        ids = np.append(self.single[data], np.int32(-1))
        ids[stops] = -1
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        paired = np.append(self.rank_pairs(ids[: n - 1], ids[1:n]), np.full(2, -1, np.int32))
        alive, marked = ids >= 0, np.zeros(n + 1, bool)
        top, leaves, buckets = 0, {}, {}
        fresh = np.flatnonzero(paired >= 0)
        while True:
            if len(fresh):
                ranks = paired[fresh]
                order = np.argsort(ranks, kind="stable")
                ranks, fresh = ranks[order], fresh[order]
                cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
                for rank, a, b in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                    held = buckets.get(rank)
                    if held is None:
                        buckets[rank] = [fresh[a:b]]
                        high = rank >> 8
                        leaves[high] = leaves.get(high, 0) | 1 << (rank & 255)
                        top |= 1 << high
                    else:
                        held.append(fresh[a:b])
            if not top:
                break
            high = (top & -top).bit_length() - 1
            leaf = leaves[high]
            rank = high << 8 | (leaf & -leaf).bit_length() - 1
            leaf &= leaf - 1
            leaves[high] = leaf
            if not leaf:
                top &= top - 1
            held = buckets.pop(rank)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[paired[at] == rank]  # the others are stale
            fresh = at
            if not len(at):
                continue
            middle = after[at]
            marked[at] = True
            if marked[middle].any():
                kept, taken = [], -1
                for i, j in zip(at.tolist(), middle.tolist(), strict=True):
                    if i != taken:
                        kept.append(i)
                        taken = j
                marked[at] = False
                at = np.array(kept)
                middle = after[at]
            else:
                marked[at] = False
            stop = after[middle]
            after[at] = stop
            before[stop] = at
            ids[at] = rank
            alive[middle] = False
            paired[middle] = -1
            left = before[at]
            left = left[left >= 0]
            fresh = np.concatenate([at, left])
            paired[fresh] = self.rank_pairs(ids[fresh], ids[after[fresh]])
            fresh = fresh[paired[fresh] >= 0]
        made = ids[:n][alive[:n]]
        ends = np.cumsum(alive[:n])[stops]
        raw, bounds = made.astype(np.int32).tobytes(), [0, *(ends * 4).tolist()]
        rest = iter(zip(bounds, bounds[1:], strict=False))
        return [raw[slice(*next(rest))] if w is None else np.int32(w).tobytes() for w in whole]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        top marks the leaves that hold something, leaves[rank >> 8] marks ranks, and buckets[rank] is a heap of positions, or
        just one position. The queue's steps are written out here, since calls would cost more than they do.
        """
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # of the token at a position
        before = list(range(-1, n))
        paired = [-1] * (n + 1)  # rank of the pair that begins at a position
        top, leaves, buckets = 0, {}, {}
        fresh = []
        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is not None:
                fresh.append((rank, i))
        while True:
            for rank, i in fresh:
                paired[i] = rank
                held = buckets.get(rank)
                if held is None:
                    buckets[rank] = i
                    high = rank >> 8
                    if high in leaves:
                        leaves[high] |= 1 << (rank & 255)
                    else:
                        leaves[high] = 1 << (rank & 255)
                        top |= 1 << high
                elif type(held) is int:
                    buckets[rank] = [held, i] if held < i else [i, held]
                else:
                    heappush(held, i)
            while True:
                if not top:
                    ranks, out, i = self.ranks, [], 0
                    while i < n:
                        out.append(ranks[piece[i : end[i]]])
                        i = end[i]
                    return out
                high = (top & -top).bit_length() - 1
                leaf = leaves[high]
                rank = high << 8 | (leaf & -leaf).bit_length() - 1
                held = buckets[rank]
                if type(held) is int:
                    i = held
                else:
                    i = heappop(held)
                if held is i or not held:
                    del buckets[rank]
                    leaf &= leaf - 1
                    if leaf:
                        leaves[high] = leaf
                    else:
                        del leaves[high]
                        top &= top - 1
                if paired[i] == rank:
                    break
            middle = end[i]
            stop = end[i] = end[middle]
            paired[middle] = paired[i] = -1
            before[stop] = i
            fresh = []
            if stop < n:
                rank = rank_of(piece[i : end[stop]])
                if rank is not None:
                    fresh.append((rank, i))
            p = before[i]
            if p >= 0:
                rank = rank_of(piece[p:stop])
                paired[p] = -1
                if rank is not None:
                    fresh.append((rank, p))


class _Pieces(dict):
    """Ids of pre-tokens as int32 bytes, by pre-token. The first FREE pre-tokens are kept, later ones from their second sight on (a
    bit table by hash remembers the first, roughly), so the many that occur once take little room; when full, all are
    dropped. This changes nothing but time."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.once, self.marks = bytearray(ONCE_BITS >> 3), 0

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text; what is not known is merged first, all together."""
        cut = [self.vocabulary.find(t) if t else () for t in texts]
        missing = [p for p in set().union(*cut) if p not in self]
        raw = [p.encode("utf-8") for p in missing]
        self.update(zip(missing, self.vocabulary.merge_all(raw), strict=True))
        out = [b"".join(map(self.__getitem__, pieces)) for pieces in cut]
        if len(self) > CACHE:
            self.clear()
            return out
        room = FREE - len(self) + len(missing)
        for piece, size in zip(missing, map(len, raw), strict=True):
            if size > CACHED_BYTES or room <= 0 and not self._seen(piece):
                del self[piece]
            else:
                room -= 1
        return out

    def _seen(self, piece: str) -> bool:
        """Whether a pre-token was asked for before; from now on it was."""
        at = hash(piece) & (ONCE_BITS - 1)
        bit = 1 << (at & 7)
        if self.once[at >> 3] & bit:
            return True
        self.once[at >> 3] |= bit
        self.marks += 1
        if self.marks > ONCE_BITS >> 2:
            self.once, self.marks = bytearray(ONCE_BITS >> 3), 0
        return False


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read where it is used: the file lies in every machine's installed packages."""
    return Vocabulary(read_ranks(path), pattern)


@lru_cache(maxsize=4)
def _pieces(path: str, pattern: str) -> _Pieces:
    return _Pieces(vocabulary(path, pattern))


def _encoded(pieces: _Pieces, texts: list[str | None]) -> pa.ListArray:
    rows = pieces.ids(texts)
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) >> 2 for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _decoded(vocabulary_: Vocabulary, ids: pa.ListArray) -> pa.Array:
    token = vocabulary_.tokens.__getitem__
    bounds, values = ids.offsets.to_pylist(), ids.values.to_numpy(zero_copy_only=False)
    return pa.array([b"".join(map(token, values[a:b].tolist())) for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for every row of df, as an ordinary encoding without special tokens. Null is taken as empty: no
    ids. Repeated rows repeat; an empty table gives no rows."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        pieces = _pieces(path, pattern)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), _encoded(pieces, batch.column(1).to_pylist())], names=[key, "ids"])

    return map_rows(df, [key, text], make, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>", rows=ROWS)


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded binary): the bytes that the ids stand for; null ids are taken as none."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        known = vocabulary(path, pattern)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _decoded(known, batch.column(1))], names=[key, "ids", "decoded"])

    return map_rows(df, [key, ids], make, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>, decoded binary", rows=ROWS)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): encode, then decode the ids, in one pass, so that only one Python worker a task holds the vocabulary."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        pieces = _pieces(path, pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = _encoded(pieces, batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), ids, _decoded(pieces.vocabulary, ids)], names=[key, "ids", "decoded"])

        return work

    return map_rows(df, [key, text], make, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>, decoded binary", rows=ROWS)
