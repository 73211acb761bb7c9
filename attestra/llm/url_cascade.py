"""URL filters by a Bloom filter cascade.

A rule is a host and a path prefix; it fits its host and all subdomains. A url's candidate keys are its host and every parent domain
with those prefixes of its path that are as long as some listed path. The key universe is every candidate key of the
corpus. Level 1 of the cascade encodes the listed keys; level 2 the universe's false positives of level 1; level 3 the listed
keys that level 2 lets through, and so on until a level lets nothing wrong through. Membership of any key of the universe is then exact:
the first level that does not hold the key decides. Two more cascades, whose universe is the listed keys, say which of them are rules and
which rules block. Urls are judged by the filters alone: neither a join nor the list itself is at hand, and the rule that a
url reports is its own candidate key.

Bits are set by partial bit_or aggregation, so neither the universe nor a level's keys ever meet in one place; what is
sent to executors is the filters. Level 1's error rate is the ratio of listed keys to urls, so the false positives
that level 2 encodes are about as many as the listed keys: the filters grow with the list, not with the corpus. Where a level would be
larger than `max_bytes`, keys are divided by their hash and each part has cascades of its own; urls pass them one part after another, so
a task holds one part's filters however long the list is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import map_rows, materialize

MAX_FILTER_BYTES, MAX_LEVELS = 64 << 20, 60


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def parse_rule(line: str) -> Rule:
    """`allow com/fr/`: a verdict, then a host and a path that begins with the first slash."""
    verdict, _, key = line.partition(" ")
    host, slash, rest = key.partition("/")
    if verdict not in ("allow", "block") or not host or not slash:
        raise ValueError(f"not a rule: {line!r}")
    return Rule(host, slash + rest, verdict)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end. Else empty."""
    after = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def candidates(host: str, path: str, sizes: Sequence[int]) -> list[tuple[str, str]]:
    """(host or parent domain, path prefix), longest key first; sizes: lengths of listed paths."""
    cuts = [s for s in sizes if s <= len(path)]
    hosts, at = [host], host.find(".")
    while at >= 0:
        hosts.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return sorted(((h, path[:s]) for h in hosts if h for s in cuts), key=lambda k: (-len(k[0]) - len(k[1]), k))


def key_hash(key: str, level: int = 0) -> int:
    """Signed 64 bits of a key."""
    return int(np.uint64(xxhash.xxh64_intdigest(key.encode("utf-8", "replace"), 1000 + level)).view(np.int64))


@dataclass(frozen=True)
class Level:
    """A Bloom filter of `bits` bits that tests `probes` places."""

    bits: int
    probes: int
    words: np.ndarray

    def places(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Double hashing: rows of places."""
        steps = np.arange(self.probes, dtype=np.uint64)[None, :]
        with np.errstate(over="ignore"):
            return (first[:, None] + steps * (second | np.uint64(1))[:, None]) % np.uint64(self.bits)

    def holds(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(first), bool)
        at = self.places(first, second)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(1)


def shape(n: int, rate: float) -> tuple[int, int]:
    """(bits, probes) for n keys at an error rate."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(n, 1) * math.log(2)))


def _pair(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit values of key hashes for a level, by a finalizer of shifts and odd multipliers."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (2 * level + 1, 2 * level + 2):
            x = keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out.append(x ^ (x >> np.uint64(31)))
    return out[0], out[1]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """For signed 64-bit key hashes of the universe: which are listed."""
        out = np.zeros(len(keys), bool)
        open_ = np.arange(len(keys))
        for k, level in enumerate(self.levels):
            if not len(open_):
                break
            inside = level.holds(*_pair(keys[open_], k))
            # what an odd level (1, 3, ...) does not hold is unlisted, what an even one does not hold is listed
            out[open_[~inside]] = k % 2 == 1
            open_ = open_[inside]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _fill(keys: DataFrame, n: int, rate: float, level: int) -> Level:
    """keys: column h, distinct. Sets bits on the executors and brings home the words that are not zero."""
    bits, probes = shape(n, rate)
    empty = Level(bits, probes, np.zeros(0, np.uint64))

    def over(batches):
        for batch in batches:
            at = empty.places(*_pair(batch.column(0).to_numpy(zero_copy_only=False), level)).reshape(-1)
            word = (at >> np.uint64(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    found = keys.select("h").mapInArrow(over, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit"))
    words = np.zeros(bits // 64 + 1, np.uint64)
    for row in found.toLocalIterator():
        words[row["word"]] = np.int64(row["bit"]).view(np.uint64)
    return Level(bits, probes, words)


def _rate(n: int, urls: int) -> float:
    return min(0.5, max(1e-9, n / max(urls, 1)))


def build(listed: DataFrame, universe: DataFrame, urls: int) -> Cascade:
    """listed, universe: tables of key hashes (column h); repeats do no harm, and the universe may hold listed keys.

    Only what a level lets through wrongly is looked at again, so each table is a fraction of the one two levels before.
    """
    spark = listed.sparkSession
    listed = materialize(listed.select("h").distinct(), "listed")
    n = listed.count()
    if not n:
        return Cascade((Level(0, 0, np.zeros(0, np.uint64)),))
    levels: list[Level] = []
    inside, outside = listed, universe.select("h")
    rate = _rate(n, urls)
    for k in range(MAX_LEVELS):
        source, other = (inside, outside) if k % 2 == 0 else (outside, inside)
        levels.append(_fill(source, n if k == 0 else source.count(), rate if k == 0 else 0.5, k))
        sent = spark.sparkContext.broadcast(levels[-1])

        def passing(batches, sent=sent, k=k):
            for batch in batches:
                keys = batch.column(0).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(sent.value.holds(*_pair(keys, k))))

        wrong = other.mapInArrow(passing, "h long").distinct()
        if k == 0:  # the universe may hold listed keys
            both = wrong.select("h", F.lit(False).alias("is")).union(listed.select("h", F.lit(True)))
            wrong = both.groupBy("h").agg(F.max("is").alias("is")).filter(~F.col("is")).select("h")
        wrong = materialize(wrong, f"level{k}")
        if wrong.isEmpty():
            return Cascade(tuple(levels))
        if k % 2 == 0:
            outside = wrong
        else:
            inside = wrong
    raise ValueError("two keys share a hash; choose another seed")


@dataclass(frozen=True)
class Filters:
    """One part's cascades: listed keys in the universe, rules among the listed, and blocking ones among the rules."""

    listed: Cascade
    rules: Cascade
    blocking: Cascade


def _keys(lines: DataFrame | Sequence[str], spark: SparkSession) -> DataFrame:
    """(host, path) of `host/path` keys, given as strings or as a table with a column `key`."""
    if not isinstance(lines, DataFrame):
        lines = spark.createDataFrame([(x,) for x in lines], "key string")
    cut = F.instr("key", "/")
    return lines.filter(cut > 0).select(F.substr("key", F.lit(1), cut - 1).alias("host"), F.substr("key", cut).alias("path"))


def filter_urls(df: DataFrame, rules: Sequence[str], blocked: DataFrame | Sequence[str] = (), key: str = "page_id", url: str = "url", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(key, host, path, rule, verdict) for every row of df.

    rules: `allow host/path` or `block host/path` lines; the longest that fits decides (of equally long ones the first in order of text).
    blocked: further host/path keys, as strings or as a table of any size with a column `key`, that block where no rule fits.
    Everything else is allowed, null urls and urls without `://` included (empty host and path). Urls of any length are read whole,
    repeated rows repeat, further columns are not read, whatever their names; an empty table gives no rows; two rules with one key are an error.
    """
    parsed = [parse_rule(r) for r in rules]
    if len({r.key for r in parsed}) < len(parsed):
        raise ValueError("two rules with one key")
    spark = df.sparkSession
    more = _keys(blocked, spark)
    sizes = sorted({len(r.path) for r in parsed} | {r["n"] for r in more.select(F.char_length("path").alias("n")).distinct().collect()})
    rows = df.select(F.col(key).alias("k"), F.col(url).alias("u"))
    host, path = host_and_path(F.col("u"))
    rows = rows.select("k", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    def keys_of(batches):
        for batch in batches:
            known: set[tuple[str, str]] = set()
            top = max(sizes, default=0)
            for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known.add((h, p[:top]))
            found = {key_hash(a + b) for h, p in known for a, b in candidates(h, p, sizes)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int64())], names=["h"])

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([key_hash(k) for k in batch.column(0).to_pylist()], pa.int64())], names=["h"])

    universe = rows.select("host", "path").mapInArrow(keys_of, "h long")
    named = spark.createDataFrame([(key_hash(r.key), r.verdict == "block") for r in parsed], "h long, block boolean")
    listed = materialize(named.select("h").union(more.select(F.concat("host", "path").alias("key")).mapInArrow(hashed, "h long")).distinct(), "list")
    n, urls = listed.count(), rows.count()
    parts = max(1, -(-shape(n, _rate(n, urls))[0] // (8 * max_bytes)))
    found = rows.withColumn("fits", F.array().cast("array<struct<n:int,key:string,named:boolean,block:boolean>>"))
    for part in range(parts):
        own = lambda x: x.filter(F.pmod(F.shiftright("h", 20), F.lit(parts)) == part) if parts > 1 else x  # noqa: B023, E731
        made = Filters(build(own(listed), own(universe), urls), build(own(named), own(listed), n), build(own(named).filter("block"), own(named), len(parsed)))
        found = _judged(found, spark.sparkContext.broadcast(made), sizes, part, parts)
        if parts > 1:
            found = materialize(found, f"part{part}")
    best = F.array_min(F.transform(F.filter("fits", lambda f: f["named"]), lambda f: F.struct((-f["n"]).alias("n"), f["key"].alias("key"), f["block"].alias("block"))))
    verdict = F.when(best.isNotNull(), F.when(best["block"], "block").otherwise("allow")).when(F.size("fits") > 0, "block").otherwise("allow")
    return found.select(F.col("k").alias(key), "host", "path", best["key"].alias("rule"), verdict.alias("verdict"))


def _judged(rows: DataFrame, sent: Broadcast, sizes: Sequence[int], part: int, parts: int) -> DataFrame:
    """Adds the candidate keys that this part's filters hold to each row's `fits`."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        filters = sent.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            hosts, paths, fits = (batch.column(k).to_pylist() for k in (1, 2, 3))
            tried = [(i, a + b) for i, (h, p) in enumerate(zip(hosts, paths, strict=True)) for a, b in candidates(h, p, sizes)]
            flat = np.array([key_hash(k) for _, k in tried], np.int64)
            mine = (flat >> 20) % parts == part
            held = np.flatnonzero(mine)[filters.listed.holds(flat[mine])]
            named, blocking = filters.rules.holds(flat[held]), filters.blocking.holds(flat[held])
            for k, x, y in zip(held.tolist(), named.tolist(), blocking.tolist(), strict=True):
                i, name = tried[k]
                fits[i].append({"n": len(name), "key": name, "named": x, "block": x and y})
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fits, batch.schema.field(3).type)], schema=batch.schema)

        return work

    return map_rows(rows, ["k", "host", "path", "fits"], make, rows.schema, rows=4096)


def sql(rules: Sequence[str], blocked: Sequence[str] = ()) -> str:
    """The same rows in DuckDB, over `pages`."""
    parsed = [parse_rule(r) for r in rules]
    lines = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}', true)" for r in parsed)
    more = "".join(f", ('{r.host}', '{r.path}', 'block', false)" for r in (parse_rule(f"block {b}") for b in blocked))
    return f"""
WITH rules(h, p, v, named) AS (VALUES {lines}{more})
, cut AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
, u AS (SELECT page_id, rid, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT any_value(page_id) AS page_id, any_value(host) AS host, any_value(path) AS path, arg_max(h || p, length(h || p)) FILTER (WHERE named) AS rule,
  coalesce(arg_max(v, length(h || p)) FILTER (WHERE named), CASE WHEN count(h) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY rid
"""
