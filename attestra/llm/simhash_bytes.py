"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint has 8 positional bytes. Two fingerprints that differ in at most 4 bits differ in at most 4 bytes, so
they share at least 4 positional bytes: the guaranteed minimum. The index is keyed by every choice of 3 positions with the bytes there
(56 keys of 24 bits a fingerprint): one fewer than the minimum, so that a linked pair meets in four lists or more and a list of
single bytes, which would hold a 256th of the corpus, is never read. Each pair that a list brings together has its shared
positional bytes tallied, is kept from the minimum on, and only then verified by the number of differing bits.

Equal fingerprints are merged first, so copies never meet in a list. Near copies do: what a list links is reported as a
forest, each member with the most central one that it is linked to directly or through others, so that the many lists of one group,
which have its centre in common, report much the same rows. All fingerprints within 2 bits of a list's majority pattern lie within 4 bits of each other and
are linked without comparing; only the others are compared with the list. A long list is split by one more positional
byte, the fourth that a linked pair must share; a list of four bytes that is still long is cut into blocks, and every pair of
blocks is a task's work of its own. So no long list is one task's and none is held whole. No link between different
components is lost, so the components are those of all links.

Several fingerprints may be drawn from one text, each by mixing the same shingle hashes anew: documents are linked if any draw links them.
One draw finds few of the pairs that share four fifths of their shingles (they differ in 7 bits on average); more draws find
more, while unlike texts stay apart in each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import byte_choices, byte_values, connected_components, map_rows, materialize, run_bounds

WORDS, MAX_BITS, BYTES, SEED = 4, 4, 8, 42
SHARED = BYTES - MAX_BITS
CHOICES, LONGER = np.array(byte_choices(BYTES, SHARED - 1)), np.array(byte_choices(BYTES, SHARED))
#: The choices of one more byte that hold a choice.
EXTENDED = np.array([[k for k, more in enumerate(LONGER) if set(few) <= set(more)] for few in CHOICES])
SMALL = 32
#: Lists seen to be longer are split, then cut into blocks of about so many; at most so many lists, the longest first (what is sent to executors).
BLOCK, MAX_CUT = 4096, 100_000
LOW, HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def mixed(x: np.ndarray, draw: int) -> np.ndarray:
    """Other values for the same hashes: a finalizer of shifts and odd multipliers. Draw 0 leaves them as they are."""
    if not draw:
        return x
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15) * np.uint64(draw)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes | None, words: int = WORDS, draws: int = 1) -> list[int]:
    """Of the whole text, one for each draw: 0 without words; shorter texts than a shingle are one shingle."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return [0] * draws
    n = max(len(tokens) - words + 1, 1)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n]
    ends = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, n)
    out = []
    for draw in range(draws):
        total = np.zeros(64, np.int64)
        for at in range(0, n, 65536):
            part = mixed(hashes[at : at + 65536], draw)
            bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), 8), axis=1)
            total += bits.sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * total > n).tobytes(), "big"))
    return out


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, draws: int = 1) -> DataFrame:
    """(key, fps): the fingerprints as signed longs. Null and empty texts have fingerprint 0; repeated rows repeat; texts of any
    length are read whole."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = np.array([fingerprint(t, words, draws) for t in byte_values(batch.column(1))], np.uint64).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * draws), pa.array(values.view(np.int64)))
            return pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "fps"])

        return work

    return map_rows(df, [key, text], make, f"`{key}` {df.schema[key].dataType.simpleString()}, fps array<long>")


def tally(differ: np.ndarray) -> np.ndarray:
    """Shared positional bytes of pairs, from their differing bits."""
    return BYTES - np.bitwise_count((((differ & LOW) + LOW) | differ) & HIGH)


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs stay: the tally retains those that share the guaranteed minimum of bytes, then their bits are verified."""
    differ = a ^ b
    retained = tally(differ) >= SHARED
    retained[retained] = np.bitwise_count(differ[retained]) <= MAX_BITS
    return retained


def majority(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The bit pattern of which each run of x has most bits."""
    bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(len(x), 8), axis=1)
    sizes = np.diff(np.append(starts, len(x)))
    return np.packbits(2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int64) > sizes[:, None], axis=1).view(">u8").astype(np.uint64)[:, 0]


def forest(x: np.ndarray, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(roots, places): every place of x in the pairs (a, b) with the most central place of its component, places that are roots left out."""
    places = np.unique(np.concatenate([a, b]))
    if not len(places):
        return places, places
    starts = run_bounds(keys[places])[:-1]
    middle = np.repeat(majority(x[places], starts), np.diff(np.append(starts, len(places))))
    order = np.lexsort((x[places], np.bitwise_count(x[places] ^ middle), keys[places]))
    at = np.empty(len(places), np.int64)
    at[order] = np.arange(len(places))
    a, b = at[np.searchsorted(places, a)], at[np.searchsorted(places, b)]
    root = np.arange(len(places))
    while True:
        before, low = root.copy(), np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    found = np.flatnonzero(root != np.arange(len(places)))
    return places[order[root[found]]], places[order[found]]


def spanning_links(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (places in x) whose components are those of all pairs of x within MAX_BITS."""
    if len(x) < 2:
        return []
    out = []
    away = np.bitwise_count(x ^ majority(x, np.zeros(1, np.int64))[0])
    core = away <= MAX_BITS // 2
    root = np.arange(len(x))
    inside = np.flatnonzero(core)
    if len(inside) > 1:
        inside = inside[np.lexsort((x[inside], away[inside]))]
        out.append((np.full(len(inside) - 1, inside[0]), inside[1:]))
        root[inside] = inside[0]
    for p in np.flatnonzero(~core):
        near = np.flatnonzero(linked(x, x[p : p + 1]))
        roots, first = np.unique(root[near], return_index=True)
        if len(roots) > 1:
            to = near[first[roots != root[p]]]
            out.append((np.full(len(to), p), to))
            root[np.isin(root, roots)] = root[p]
    return out


def codes(fps: np.ndarray, draw: int, choices: np.ndarray = CHOICES) -> np.ndarray:
    """The list keys of each fingerprint, one for each choice: draw, choice and the bytes chosen."""
    shown = np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), BYTES)
    held = np.zeros((len(fps), len(choices)), np.int64)
    for k in range(choices.shape[1]):
        held |= shown[:, choices[:, k]].astype(np.int64) << (8 * k)
    return held | (np.arange(len(choices), dtype=np.int64)[None, :] << 8 * choices.shape[1]) | (draw << 8 * choices.shape[1] + 7) | (int(choices.shape[1] == SHARED) << 60)


def _drawn(batch: pa.RecordBatch, at: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, fingerprints by draw) of a slice of (node, fps)."""
    part = batch.slice(at, rows)
    fps = part.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return part.column(0).to_numpy(zero_copy_only=False), fps.reshape(part.num_rows, -1)


def _places(keys: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where keys stand in long (in order), or -1."""
    if not len(long):
        return np.full(keys.shape, -1)
    at = np.minimum(np.searchsorted(long, keys), len(long) - 1)
    return np.where(long[at] == keys, at, -1)


def _postings(fps: np.ndarray, draw: int, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, places in fps) of the lists of three bytes but the long ones, then of the lists of four that stand for those."""
    keys = codes(fps, draw)
    split = _places(keys, long) >= 0
    of = np.broadcast_to(np.arange(len(fps))[:, None], keys.shape)
    wide = np.zeros((len(fps), len(LONGER)), bool)
    for choice in np.flatnonzero(split.any(0)):
        wide[np.ix_(split[:, choice], EXTENDED[choice])] = True
    more = codes(fps, draw, LONGER)[wide] if wide.any() else np.zeros(0, np.int64)
    return keys[~split], of[~split], more, np.nonzero(wide)[0]


def long_lists(prints: DataFrame, block: int = BLOCK, at_most: int = MAX_CUT, split: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, blocks) of the longest lists over `block` members: those of three bytes, or those of four that stand for `split`
    ones. Counted are members that meet another of their list where they are read; a list thinner than that is left whole,
    which costs a task's time, not a link."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16384):
                _, fps = _drawn(batch, at, 16384)
                for draw in range(fps.shape[1]):
                    keys = codes(fps[:, draw], draw) if split is None else _postings(fps[:, draw], draw, split)[2]
                    found, times = np.unique(keys, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found[times > 1]), pa.array(times[times > 1].astype(np.int64))], names=["posting", "n"])

    if split is not None and not len(split):
        return split, split
    counted = prints.select("node", "fps").mapInArrow(over, "posting long, n long").groupBy("posting").agg(F.sum("n").alias("n"))
    found = sorted((r["posting"], r["n"]) for r in counted.filter(F.col("n") > block).orderBy(F.desc("n"), "posting").limit(at_most).collect())
    return np.array([k for k, _ in found], np.int64), np.array([-(-n // block) for _, n in found], np.int64)


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): rows whose components are those of all verified links of the nodes of prints (node, fps)."""
    long, _ = long_lists(prints, block)
    sent = prints.sparkSession.sparkContext.broadcast((long, *long_lists(prints, block, split=long)))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long, cut, blocks = sent.value

        def out(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps.view(np.int64)), pa.array(nodes)], names=["posting", "fp", "node"])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                nodes, drawn = _drawn(batch, at, 4096)
                for draw in range(drawn.shape[1]):
                    fps = np.ascontiguousarray(drawn[:, draw])
                    keys, of, more, owner = _postings(fps, draw, long)
                    place = _places(more, cut)
                    keys, of = np.concatenate([keys, more[place < 0]]), np.concatenate([of, owner[place < 0]])
                    yield out(keys, fps[of], nodes[of])
                    for k in np.unique(place[place >= 0]):
                        n, member = int(blocks[k]), owner[place == k]
                        own = (mixed(fps[member], 1) % np.uint64(n)).astype(np.int64)
                        step = max(1, (1 << 19) // len(member))
                        for low in range(0, n, step):
                            other = np.arange(low, min(n, low + step))[:, None]
                            cell = np.minimum(own, other) * n + np.maximum(own, other) + 1
                            again = np.tile(member, len(other))
                            # cells are told apart by a digest: two that share one are compared together, and every pair is verified
                            name = mixed(cell.reshape(-1).astype(np.uint64) ^ mixed(cut[k : k + 1].view(np.uint64), 2), 3)
                            yield out(name.view(np.int64), fps[again], nodes[again])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
            bounds, found = run_bounds(keys), []
            sizes = np.diff(bounds)
            short = np.repeat(sizes <= SMALL, sizes)
            pairs = []
            for gap in range(1, min(int(sizes.max(initial=1)), SMALL)):
                pair = np.flatnonzero((keys[gap:] == keys[:-gap]) & short[gap:])
                pair = pair[linked(fps[pair], fps[pair + gap])]
                pairs.append((pair, pair + gap))
            if pairs:
                roots, joined = forest(fps, keys, *(np.concatenate(c) for c in zip(*pairs, strict=True)))
                found.append((nodes[roots], nodes[joined]))
            for k in np.flatnonzero(sizes > SMALL):
                own = nodes[bounds[k] : bounds[k + 1]]
                found += [(own[a], own[b]) for a, b in spanning_links(fps[bounds[k] : bounds[k + 1]])]
            if found:
                a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            k, f, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if len(k) == 0:
                continue
            now = (k, np.ascontiguousarray(f).view(np.uint64), n)
            last = int(np.searchsorted(k, k[-1]))  # the list that may go on in the next batch
            if last or held and held[0][0][0] != k[0]:
                done = [*held, tuple(c[:last] for c in now)]
                yield from lists(*(np.concatenate(c) for c in zip(*done, strict=True)))
                held = []
            held.append(tuple(c[last:] for c in now))
        if held:
            yield from lists(*(np.concatenate(c) for c in zip(*held, strict=True)))

    posted = prints.select("node", "fps").mapInArrow(post, "posting long, fp long, node long")
    return posted.repartition("posting").sortWithinPartitions("posting", "fp").mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, draws: int = 1, block: int = BLOCK) -> DataFrame:
    """(key, fingerprint, component_id) for every row of df; component_id is the least key reachable over links.

    The fingerprint is that of the first draw. Rows without a key have a fingerprint and a component too, but are nobody's
    representative (null if no linked row has a key). Empty and null texts have fingerprint zero and are linked like any other;
    repeated rows repeat; very long texts are fingerprinted whole; further columns are not read, whatever their names. An empty
    table gives no rows. With several draws a node is a 64-bit digest of its fingerprints.
    """
    made = fingerprints(df, key, text, words, draws)
    rows = materialize(made.select(key, F.get("fps", F.lit(0)).alias("fp"), "fps", (F.xxhash64("fps") if draws > 1 else F.get("fps", F.lit(0))).alias("node")), "fingerprints")
    prints = materialize(rows.groupBy("node").agg(F.any_value("fps").alias("fps"), F.min(key).alias("least")), "distinct")
    joined = connected_components(links(prints, block))
    rooted = prints.select("node", "least").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.select("node", "root").join(least, "root").select("node", "component_id")
    return rows.select(key, "fp", "node").join(known, "node").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, draws: int = 1) -> DataFrame:
    """One row of each component, that with the least key, all columns as they are; of repeated rows with one key, one stays.
    Rows without a key cannot be told from their copies and stay. The join is by key and shuffled at every size: what goes grows
    with the corpus, so it is never broadcast."""
    found = near_duplicates(df, key, text, words, draws).filter(F.col(key).isNotNull())
    keys = materialize(found.groupBy(key).agg(F.min("component_id").alias("least"), F.count("*").alias("rows")), "keys")
    gone = keys.filter((F.col("rows") > 1) | (F.col(key) != F.col("least"))).select(key)
    again = keys.filter((F.col("rows") > 1) & (F.col(key) == F.col("least"))).select(key)
    kept = df.hint("merge").join(gone, key, "left_anti")
    if not again.isEmpty():
        kept = kept.unionByName(df.hint("merge").join(again, key, "left_semi").dropDuplicates([key]))
    return kept.select(*df.columns)
