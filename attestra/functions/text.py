"""Text as columns: tokens, stems, trigrams, sentences, paragraphs and the markers that flag them. JVM-side expressions, and the split of
whole batches into the same tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words that hedge a statement or negate it.
HEDGES = ("maybe", "perhaps", "might", "probably", "possibly", "around", "about", "roughly")
NEGATIONS = ("not", "never", "no", "without", "cannot")
INTERROGATIVES = {"who": "person", "where": "place", "when": "time", "how many": "quantity", "how much": "quantity", "why": "cause"}


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


#: A capital sigma's lower case depends on its neighbours.
SIGMA = "\u03a3"


class Splitter:
    """tokens() of whole batches of texts. What is a letter or digit, and each character's lower case, is asked of Spark once a session, so
    that both split alike; texts with a character whose lower case is none of its own are lowered by Spark before they come (`ready`)."""

    _of: dict[str, Splitter] = {}

    def __init__(self, word: np.ndarray, lower: np.ndarray, whole: list[str]) -> None:
        """word, lower: for each code point; whole: the characters that `ready` leaves to Spark."""
        self.word, self.lower, self.whole = word, lower, whole
        length = lambda c: 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        at = np.flatnonzero(lower != np.arange(len(lower)))
        self.odd = {int(c): int(lower[c]) for c in at[length(at) != length(lower[at])]}
        self.is_odd = np.zeros(len(lower), bool)
        self.is_odd[list(self.odd)] = True
        byte = np.arange(256)
        self.byte_lower = np.where(byte < 128, lower[:256], byte).astype(np.uint8)
        self.byte_word = word[self.byte_lower] & (byte < 128)

    @classmethod
    def of(cls, spark: SparkSession) -> Splitter:
        key = spark.sparkContext.applicationId
        if key not in cls._of:
            every = spark.range(0x110000).filter("id < 55296 or id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
            every = every.select("id", "c", F.lower("c").alias("low"), F.col("c").rlike("^[\\p{L}\\p{N}]$").alias("word")).filter("word or low <> c")
            word, lower, whole = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.int32), [SIGMA]
            for at, c, low, held in zip(*(x.to_pylist() for x in every.toArrow().columns), strict=True):
                word[at] = held
                if len(low) == 1:
                    lower[at] = ord(low)
                else:
                    whole.append(c)
            cls._of = {key: cls(word, lower, whole)}
        return cls._of[key]

    def ready(self, text: Column) -> Column:
        """What split takes."""
        text, found = F.make_valid_utf8(F.coalesce(text, F.lit(""))), F.lit(False)
        for c in self.whole:
            found = found | F.contains(text, F.lit(c))
        return F.when(found, F.lower(text)).otherwise(text)

    def split(self, texts: pa.StringArray) -> tuple[np.ndarray, pa.StringArray]:
        """How many tokens each text has, and all tokens in order."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        if ends[0] == ends[-1]:
            return np.zeros(len(texts), np.int64), pa.array([], pa.string())
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        held, low = self.byte_word[data], self.byte_lower[data]
        lead = np.flatnonzero(data >= 0xC0)
        more = (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        for n in range(3):
            at = lead[more == n]
            if not len(at):
                continue
            code = (data[at] & (0x1F >> n)).astype(np.int64)
            for k in range(1, n + 2):
                code = code << 6 | data[at + k] & 0x3F
            if self.is_odd[code].any():
                return self.split(pa.array([t.translate(self.odd) for t in texts.to_pylist()], pa.string()))
            lowered = self.lower[code]
            new = np.flatnonzero(lowered != code)
            for k in range(n + 2):
                held[at + k] = self.word[lowered]
                bits = lowered[new] >> 6 * (n + 1 - k)
                low[at[new] + k] = bits & 0x3F | 0x80 if k else bits | 0xFF << (6 - n) & 0xFF
        before = ends[:-1] - ends[0]
        opened, closed = held.copy(), held.copy()
        opened[1:] &= ~held[:-1]
        closed[:-1] &= ~held[1:]
        inner = before[(before > 0) & (before < len(data))]
        opened[inner] |= held[inner]
        closed[inner - 1] |= held[inner - 1]
        starts = np.flatnonzero(opened)
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(np.flatnonzero(closed) + 1 - starts, out=offsets[1:])
        return np.diff(np.append(np.searchsorted(starts, before), len(starts))), pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(low[held]))


def stem(token: Column) -> Column:
    """Drops the first of these endings that leaves four characters or more."""
    out = token
    for ending, instead in reversed((("ingly", ""), ("edly", ""), ("ing", ""), ("ed", ""), ("ies", "y"), ("es", ""), ("s", ""))):
        fits = token.endswith(ending) & (F.char_length(token) - len(ending) >= 4)
        out = F.when(fits, F.concat(F.substring(token, F.lit(1), F.char_length(token) - len(ending)), F.lit(instead))).otherwise(out)
    return out


def trigrams(text: Column) -> Column:
    """Distinct character trigrams of the padded lower-cased tokens, in order."""
    padded = F.transform(tokens(text), lambda t: F.concat(F.lit("^"), t, F.lit("$")))
    grams = F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(p) - 2, F.lit(1))), lambda i: F.substring(p, i, F.lit(3)))))
    return F.array_sort(F.array_distinct(grams))


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by a space, distinct and in order."""
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i)))
    return F.when(n >= 2, F.array_sort(F.array_distinct(pairs))).otherwise(F.expr("cast(array() as array<string>)"))


def sentences(text: Column) -> Column:
    """Stretches up to ., ! or ? or a line's end, trimmed, without empty ones; a point between digits ends nothing."""
    held = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?:[^.!?\\n]|[.][0-9])+[.!?]?"), F.lit(0))
    return F.filter(F.transform(held, lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\\n[ \\t]*\\n+"), lambda s: F.trim(s)), lambda s: F.char_length(s) > 0)


def has_any(words: Column, of: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in of]))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 for two empty ones."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def stable_id(text: Column) -> Column:
    """62 bits of the digest of a text."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(4611686018427387904).cast("decimal(20,0)")).cast("bigint")


def interrogative(text: Column) -> Column:
    """What a question asks for, by its first interrogative; `none` without one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("none")
    for word, kind in reversed(INTERROGATIVES.items()):
        out = F.when(low.rlike(rf"\b{word}\b"), kind).otherwise(out)
    return out


def utf8_prefix(text: Column, limit: int) -> Column:
    """The longest prefix of whole lines in at most so many UTF-8 bytes."""
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("t"), F.lit(True).alias("open"))
    fold = F.aggregate(
        F.split(text, "\n"),
        start,
        lambda acc, line: F.when(
            acc["open"] & (acc["n"] + F.octet_length(line) + F.when(acc["n"] > 0, 1).otherwise(0) <= limit),
            F.struct((acc["n"] + F.octet_length(line) + F.when(acc["n"] > 0, 1).otherwise(0)).alias("n"), F.when(acc["n"] > 0, F.concat(acc["t"], F.lit("\n"), line)).otherwise(line).alias("t"), F.lit(True).alias("open")),
        ).otherwise(F.struct(acc["n"].alias("n"), acc["t"].alias("t"), F.lit(False).alias("open"))),
    )
    return fold["t"]
