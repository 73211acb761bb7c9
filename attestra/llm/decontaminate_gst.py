"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased and cut into words (`\\w+`). A document and a test item are compared where they share a seed, a run of
`minimum` words: the items' seed hashes are the small side of the join, looked up for every window of every whole text.
Every tile is made of seeds, so only the parts of a document that seeds cover are tiled: greedy string tiling repeatedly
marks the longest matches that no tile covers yet, found by running Karp-Rabin hashes at a falling search length. Tiles may
come in any order, so reordered passages count. A document is contaminated by an item when tiles cover at
least `threshold` of the item's words, or when one tile has `long` words or more. An item of fewer than `minimum` words has no seed; it is
one itself, of its own length, and a document that holds its words in a row is contaminated by it.

The items are sent to the executors in blocks of at most `block_bytes` of text, one pass over the documents for each block, so
what is broadcast is bounded however large the benchmark is. Documents are never shuffled, and a passage that many
documents share costs each of them its own tiling only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import map_rows

WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
MINIMUM, THRESHOLD, LONG, BLOCK_BYTES = 5, 0.5, 13, 16 << 20


def running_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin values (mod 2**64) of every window of so many ids, by one prefix recurrence in powers of the base."""
    n = len(ids) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * BASE + ids[k : k + n].astype(np.uint64)
    return out


def tile(pattern: list[int], text: list[int], minimum: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in pattern, start in text, length), longest first; negative ids match nothing."""
    free_p, free_t = [x >= 0 for x in pattern], [x >= 0 for x in text]
    tiles: list[tuple[int, int, int]] = []
    search = max(minimum, min(len(pattern), len(text), 4 * minimum))

    def windows(ids: list[int], free: list[bool], length: int) -> Iterator[tuple[int, int]]:
        value, run, top = 0, 0, pow(int(BASE), length, 1 << 61)
        for at, x in enumerate(ids):
            if not free[at]:
                value = run = 0
                continue
            value = (value * int(BASE) + x + 1) & ((1 << 61) - 1)
            run += 1
            if run > length:
                value = (value - (ids[at - length] + 1) * top) & ((1 << 61) - 1)
            if run >= length:
                yield at - length + 1, value

    while True:
        table: dict[int, list[int]] = {}
        for at, value in windows(text, free_t, search):
            table.setdefault(value, []).append(at)
        found: list[tuple[int, int, int]] = []
        for p, value in windows(pattern, free_p, search):
            for t in table.get(value, ()):
                size = 0
                while p + size < len(pattern) and t + size < len(text) and free_p[p + size] and free_t[t + size] and pattern[p + size] == text[t + size]:
                    size += 1
                if size >= search:
                    found.append((-size, p, t))
        longest = -min(found)[0] if found else 0
        if longest > 2 * search:
            search = longest
            continue
        heapify(found)
        while found:
            size, p, t = heappop(found)
            runs = list(_free_runs(p, t, -size, free_p, free_t))
            if runs and runs[0][0] == size:
                free_p[p : p - size] = free_t[t : t - size] = [False] * -size
                tiles.append((p, t, -size))
            else:  # a longer tile cut this match: what is left of it waits its turn
                for run in runs:
                    if -run[0] >= search:
                        heappush(found, run)
        if search == minimum:
            return tiles
        search = max(minimum, search // 2)


def _free_runs(p: int, t: int, size: int, free_p: list[bool], free_t: list[bool]) -> Iterator[tuple[int, int, int]]:
    run = 0
    for k in range(size + 1):
        if k < size and free_p[p + k] and free_t[t + k]:
            run += 1
        elif run:
            yield -run, p + k - run, t + k - run
            run = 0


@dataclass(frozen=True)
class Items:
    """A block of test items: word ids, and every seed's hash with the items that hold it."""

    vocabulary: dict[str, int]
    keys: list
    words: list[list[int]]
    #: By length: hashes in order, and the items that hold each. `minimum` for all longer items, their own length for shorter ones.
    seeds: dict[int, tuple[np.ndarray, list[tuple[int, ...]]]]
    minimum: int


def index_items(items: list[tuple[object, str]], minimum: int) -> Items:
    vocabulary: dict[str, int] = {}
    words = [[vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(text.lower())] for _, text in items]
    where: dict[int, dict[int, set[int]]] = {}
    for k, ids in enumerate(words):
        length = min(minimum, len(ids))
        for h in running_hashes(np.array(ids, np.int64), length).tolist() if length else ():
            where.setdefault(length, {}).setdefault(h, set()).add(k)
    seeds = {}
    for length, found in sorted(where.items()):
        hashes = np.array(sorted(found), np.uint64)
        seeds[length] = hashes, [tuple(sorted(found[h])) for h in hashes.tolist()]
    return Items(vocabulary, [k for k, _ in items], words, seeds, minimum)


def _seeded(ids: np.ndarray, missing: np.ndarray, length: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the text, seeds) of all windows of known words that are seeds."""
    whole = np.flatnonzero(missing[length:] == missing[:-length])
    hashes = np.zeros(len(whole), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            hashes = hashes * BASE + ids[whole + k].astype(np.uint64)
    at = np.minimum(np.searchsorted(seeds, hashes), len(seeds) - 1)
    hit = seeds[at] == hashes
    return whole[hit], at[hit]


def matches(text: str | None, items: Items, threshold: float, long: int = LONG) -> list[tuple[int, int, int, int]]:
    """(item's index, tiles, covered words, longest tile) for each item that the text holds."""
    if not text or not items.seeds:
        return []
    get = items.vocabulary.get
    ids = np.fromiter((get(w, -1) for w in WORD.findall(text.lower())), np.int64)
    missing = np.concatenate([[0], np.cumsum(ids < 0)])
    out = []
    for m, (seeds, holders) in items.seeds.items():
        if len(ids) < m:
            break
        covers: dict[int, list[int]] = {}
        for start, seed in zip(*(x.tolist() for x in _seeded(ids, missing, m, seeds)), strict=True):
            for k in holders[seed]:
                covers.setdefault(k, []).append(start)
        for k, starts in covers.items():
            pattern = items.words[k]
            part: list[int] = []
            end = -1
            for s in starts:
                if s > end:
                    part.append(-1)
                    end = s
                part.extend(ids[end : s + m].tolist())
                end = s + m
            tiles = tile(pattern, part, m)
            covered, longest = sum(size for _, _, size in tiles), max((size for _, _, size in tiles), default=0)
            if covered >= threshold * len(pattern) or longest >= long:
                out.append((k, len(tiles), covered, longest))
    return sorted(out)


def blocks(benchmark: DataFrame, key: str, text: str, minimum: int, block_bytes: int) -> Iterator[Items]:
    """The benchmark in blocks of about block_bytes of text, each collected by itself."""
    rows = benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes)
    for b in range(n):
        part = rows.filter(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b).collect()
        yield index_items(sorted(((r["k"], r["t"]) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1])), minimum)


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", minimum: int = MINIMUM, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, item key, n_tiles, covered, item_words, longest, coverage) for every document and item that it holds.

    Null and empty texts hold nothing and items without a word are held by nothing; items of fewer than `minimum` words are looked for as a
    whole; repeated rows repeat; texts of any length are read whole; further columns are not read, whatever their names; an empty
    benchmark or table gives no rows.
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, `{item_key}` {benchmark.schema[item_key].dataType.simpleString()}, n_tiles int, covered int, item_words int, longest int, coverage double"
    context, out = df.sparkSession.sparkContext, None

    for items in blocks(benchmark, item_key, item_text, minimum, block_bytes):
        sent = context.broadcast(items)
        found = map_rows(df, [key, text], _pairs(sent, schema, threshold, benchmark, item_key), schema)
        out = found if out is None else out.union(found)
    return df.sparkSession.createDataFrame([], schema) if out is None else out


def _pairs(sent, schema: str, threshold: float, benchmark: DataFrame, item_key: str) -> Callable:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(benchmark.schema[item_key].dataType)

    def make():
        items = sent.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(i, *m) for i, t in enumerate(batch.column(1).to_pylist()) for m in matches(t, items, threshold)]
            sizes = [len(items.words[r[1]]) for r in rows]
            ints = [pa.array(x, pa.int32()) for x in ([r[2] for r in rows], [r[3] for r in rows], sizes, [r[4] for r in rows])]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([items.keys[r[1]] for r in rows], kind), *ints, pa.array([r[3] / n for r, n in zip(rows, sizes, strict=True)], pa.float64())], names=["a", "b", "c", "d", "e", "f", "g"])

        return work

    return make


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", minimum: int = MINIMUM, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of df that hold no item, all columns as they are; nothing is shuffled."""
    for items in blocks(benchmark, item_key, item_text, minimum, block_bytes):
        df = df.mapInArrow(_clean(df.sparkSession.sparkContext.broadcast(items), df.columns.index(text), threshold), df.schema)
    return df


def _clean(sent, at: int, threshold: float) -> Callable:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                yield part.filter(pa.array([not matches(t, sent.value, threshold) for t in part.column(at).to_pylist()], pa.bool_()))

    return over
