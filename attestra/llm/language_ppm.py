"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order context tree of bytes with frozen counts. A byte's code length in a context is that of
its count there, or else the escape's and the code length in the next shorter context, down to 8 bits in none (escape
method C: a context seen T times with q different successors escapes with q / (T + q)). A text's code length is the sum
over its bytes; the language with the shortest one is predicted.

Since counts are frozen, the trees of all languages compile into one automaton: its states are the contexts that any tree
holds, and state x byte gives the next state and the code length in each language. The state after a byte depends on the
last `order` bytes only, so a text is cut into lanes that begin with so many bytes of warm-up, and numpy moves all lanes of
a batch forward together: the sums are exactly those of coding the text from left to right.

Code lengths are integers (1/1024 bit), so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import map_rows, run_bounds

UNIT = 1024
LETTER = regex.compile(r"\p{L}")
LANE, PIECE, BUFFER = 192, 1 << 20, 1 << 20
DRAWS = (1 << 31) - 1


@dataclass(frozen=True)
class Automaton:
    """next: state of state * 256 + byte; cost: code lengths per language, in 1/UNIT bits."""

    languages: tuple[str, ...]
    order: int
    next: np.ndarray
    cost: np.ndarray


#: Digits and ASCII punctuation say nothing about a language and are left out; white space is one kind of byte.
SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
LEFT_OUT = bytes(c for c in range(128) if not chr(c).isalpha() and not chr(c).isspace())


def _encoded(text: str) -> bytes:
    """What is coded of a text: its letters in lower case and its white space."""
    return text.lower().encode("utf-8", "replace").translate(SPACES, LEFT_OUT)


def fit(samples: list[tuple[str, str]], order: int = 5, max_contexts: int = 8000) -> Automaton:
    """samples: (language, text). Keeps the `max_contexts` most frequent contexts of all trees, shorter ones first among equals,
    so that every suffix of a kept context is kept. No samples: an automaton without languages."""
    languages = tuple(sorted({lang for lang, _ in samples}))
    pad = b" " * order
    #: For each language and context length: n-grams as numbers (context, then byte) in order, and how often each occurs.
    grams: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    totals: dict[bytes, int] = {b"": 1 << 62}
    for j, lang in enumerate(languages):
        data = np.frombuffer(pad + b"".join(_encoded(t) + pad for of, t in samples if of == lang), np.uint8)
        n = len(data) - order
        for k in range(order + 1):
            key = np.zeros(n, np.uint64)
            for i in range(k + 1):
                key = (key << np.uint64(8)) | data[order - k + i : order - k + i + n]
            found, times = np.unique(key, return_counts=True)
            grams[j, k] = found, times
            starts = run_bounds(found >> np.uint64(8))[:-1]
            sums = np.add.reduceat(times, starts)
            for i in np.argsort(-sums, kind="stable")[:max_contexts] if k else ():
                context = int(found[starts[i]] >> np.uint64(8)).to_bytes(k, "big")
                totals[context] = totals.get(context, 0) + int(sums[i])
    kept = sorted(totals, key=lambda c: (-totals[c], len(c), c))[:max_contexts]
    closed = set(kept)
    kept = sorted((c for c in kept if all(c[i:] in closed for i in range(1, len(c) + 1))), key=lambda c: (len(c), c))
    state = {c: i for i, c in enumerate(kept)}
    step = np.zeros((len(kept), 256), np.uint16)
    cost = np.full((len(kept), 256, len(languages)), 8.0, np.float32)
    for c, i in state.items():
        if c:
            cost[i] = cost[state[c[1:]]]
        low = int.from_bytes(c, "big") << 8
        for j in range(len(languages)):
            found, times = grams[j, len(c)]
            a, b = np.searchsorted(found, np.array([low, low + 256], np.uint64))
            if a < b:
                total, kinds, seen = int(times[a:b].sum()), int(b - a), (found[a:b] & np.uint64(255)).astype(np.int64)
                cost[i, :, j] += np.float32(np.log2((total + kinds) / kinds))
                cost[i, seen, j] = np.log2((total + kinds) / times[a:b])
    # shortest contexts first: the state after c and a byte is that context if it is kept, else where c's suffix goes
    children: dict[bytes, list[bytes]] = {}
    for c in kept[1:]:
        children.setdefault(c[:-1], []).append(c)
    for c, i in state.items():
        if c:
            step[i] = step[state[c[1:]]]
        for longer in children.get(c, []):
            step[i, longer[-1]] = state[longer]
    return Automaton(languages, order, step.reshape(-1), np.minimum(np.rint(cost * UNIT), 65535).astype(np.uint16).reshape(len(kept) * 256, len(languages)))


def code_lengths(model: Automaton, texts: list[bytes]) -> np.ndarray:
    """Exact code length of every text in every language, in 1/UNIT bits."""
    d, out = model.order, np.zeros((len(texts), len(model.languages)), np.int64)
    pad = b" " * d
    parts: list[bytes] = []
    owners: list[int] = []
    sizes: list[int] = []
    held = 0

    def score() -> None:
        nonlocal held
        if not parts:
            return
        data = np.frombuffer(b"".join(parts), np.uint8)
        lanes = -(-len(data) // LANE)
        grid = np.zeros(lanes * LANE, np.uint8)
        grid[: len(data)] = data
        grid = np.ascontiguousarray(grid.reshape(lanes, LANE).T)
        state = np.zeros(lanes, np.int64)
        for k in range(LANE - d, LANE):  # warm-up: the end of the lane before
            before = np.concatenate([np.zeros(1, np.uint8), grid[k, :-1]])
            state = model.next.take((state << 8) | before).astype(np.int64)
        spent = np.empty((LANE, lanes, len(model.languages)), np.uint16)
        for k in range(LANE):
            at = (state << 8) | grid[k]
            model.cost.take(at, axis=0, out=spent[k])
            state = model.next.take(at).astype(np.int64)
        begins = np.cumsum([0] + [x + d for x in sizes[:-1]]) + d
        edges = np.stack([begins, begins + sizes], 1).reshape(-1)
        for j in range(len(model.languages)):
            flat = np.ascontiguousarray(spent[:, :, j].T).reshape(-1)[: len(data)].astype(np.int64)
            total = np.concatenate([[0], np.cumsum(flat)])
            np.add.at(out[:, j], owners, (total[edges[1::2]] - total[edges[::2]]))
        parts.clear(), owners.clear(), sizes.clear()
        held = 0

    for i, text in enumerate(texts):
        for off in range(0, len(text), PIECE):
            body = text[off : off + PIECE]
            parts.append((text[off - d : off] if off else pad) + body)
            owners.append(i)
            sizes.append(len(body))
            held += len(body) + d
            if held >= BUFFER:
                score()
    score()
    return out


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = 250, max_bytes: int = 1 << 20, max_labels: int = 200, order: int = 5, max_contexts: int = 8000) -> Automaton:
    """Fits on a bounded sample: of each of the `max_labels` most frequent labels (by name among equals) the `per_label` keys with the least
    hash, of these in order the texts that begin within the first `max_bytes` of text, so that at most one text goes beyond.

    Rows without key, label or a letter in their text teach nothing. Labels are counted, then only the keys under a bar that lets about as
    many through as are wanted come to the driver (nothing is sorted or gathered by label), then the chosen rows' texts are cut to the
    bound before they are collected.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).alias("l")).dropna().filter(F.col("t").rlike(r"\p{L}"))
    counted = rows.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(max_labels)
    sizes = {r["l"]: r["n"] for r in counted.collect()}
    draw, top = F.pmod(F.xxhash64("k"), F.lit(DRAWS)), dict.fromkeys(sizes, 0)
    picked: dict[object, list] = {}
    while open_ := [lang for lang in sizes if len(picked.get(lang, ())) < per_label and top[lang] < DRAWS]:
        for lang in open_:  # half as many again as are wanted, then twice as many each time; a key counts once
            top[lang] = min(DRAWS, top[lang] * 2 or int(1.5 * per_label / sizes[lang] * DRAWS) + 1)
        bar = F.create_map(*[F.lit(x) for lang in open_ for x in (lang, top[lang])])
        drawn = rows.select("l", "k", draw.alias("d")).filter(F.col("d") < F.try_element_at(bar, F.col("l"))).distinct().collect()
        picked |= {lang: sorted((r["d"], r["k"]) for r in drawn if r["l"] == lang)[:per_label] for lang in open_}
    ids = [(lang, k, n) for lang, keys in picked.items() for n, (_, k) in enumerate(keys)]
    schema = f"l string, k {df.schema[key].dataType.simpleString()}, n int"
    chosen = df.sparkSession.createDataFrame(ids, schema)
    one = rows.join(F.broadcast(chosen), ["k", "l"]).groupBy("l", "n", "k").agg(F.min("t").alias("t"))  # one text a key
    before = F.coalesce(F.sum(F.octet_length("t")).over(Window.partitionBy("l").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = one.withColumn("before", before).filter(F.col("before") < max_bytes).collect()
    return fit([(r["l"], r["t"]) for r in sorted(found, key=lambda r: (r["l"], r["n"]))], order, max_contexts)


def predict(df: DataFrame, model: Automaton, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, bits_per_byte) for every row.

    `und` with score 0 where the text is null or has no letter, or where nothing was learned. The score is the posterior of
    the shortest code length under equal priors; ties go to the first language in order of name. Repeated rows repeat, texts of any
    length are coded whole, further columns are not read, whatever their names; an empty table gives no rows.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)  # at most max_contexts x 256 entries, whatever the input

    def make():
        known = sent.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            usable = [t is not None and bool(known.languages) and LETTER.search(t) is not None for t in texts]
            encoded = [_encoded(t) if ok else b"" for t, ok in zip(texts, usable, strict=True)]
            lengths = code_lengths(known, encoded)
            names, scores, rates = [], [], []
            for ok, row, raw in zip(usable, lengths, encoded, strict=True):
                if not ok:
                    names.append("und"), scores.append(0.0), rates.append(None)
                    continue
                best = int(row.argmin())
                names.append(known.languages[best])
                scores.append(float(1.0 / np.exp2(np.maximum((row[best] - row) / UNIT, -1000.0)).sum()))
                rates.append(float(row[best]) / UNIT / len(raw))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], names=[key, "lang_pred", "score", "bits_per_byte"])

        return work

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df, [key, text], make, f"`{key}` {kind}, lang_pred string, score double, bits_per_byte double")


def recognised(df: DataFrame, model: Automaton, text: str = "text", label: str = "lang", max_bits: float = 9.0, long_bits: float = 7.5, long_bytes: int = 60) -> DataFrame:
    """The rows whose text is in a learned language, labelled with the predicted one; other columns as they are.

    Rejected are texts that are null or have no letter, and texts on whose letters the best language spends over `max_bits` a
    byte: not even common bytes are known then. From `long_bytes` coded bytes on, where the rate says more, it is over `long_bits`:
    texts of learned languages cost under 6.6 bits there and below (README), and 8 bits are those of no knowledge. With nothing learned there is nothing to judge by, and only texts without a letter go.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    at, named = df.columns.index(text), df.columns.index(label)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [t if t is not None and LETTER.search(t) else None for t in part.column(at).to_pylist()]
                if known.languages:
                    encoded = [_encoded(t) if t else b"" for t in texts]
                    lengths = code_lengths(known, encoded)
                    best = lengths.argmin(1)
                    keep = [t is not None and row.min() <= (long_bits if len(raw) >= long_bytes else max_bits) * UNIT * len(raw) for t, row, raw in zip(texts, lengths, encoded, strict=True)]
                    columns = list(part.columns)
                    columns[named] = pa.array([known.languages[i] for i in best], part.schema.field(named).type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                else:
                    keep = [t is not None for t in texts]
                yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(over, df.schema)


def held_out(key: str = "doc_id"):
    """The third of the keys that nothing may be learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def identify(df: DataFrame) -> DataFrame:
    """Learns from the labelled rows outside the held-out third, then predicts every row."""
    model = learn(df.filter(~held_out() & F.col("lang").isNotNull()))
    return predict(df, model)
