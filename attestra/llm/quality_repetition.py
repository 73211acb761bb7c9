"""Quality rules by repetition coverage.

A text's words get small numbers; rolling hashes of several n-gram lengths grow from each other by one multiplication in
numpy (each length extends the one before). Coverage is the share of word characters inside n-grams that the text holds
twice or more, no character counted twice, and inside lines that repeat an earlier one. A text is kept when it passes the
base rules and no share is above its limit. Longer n-grams can only repeat where shorter ones do, so a text
without a repeated 3-word window is settled by one sort.

The limits are those of published web-corpus filters. These count an n-gram from its second sight on; coverage counts the
first too, so the limits on n-grams are twice the published ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from attestra.llm.common import byte_values, map_rows

SYMBOLS = b"#*$%&|<>"
SPACES = np.array([9, 10, 11, 12, 13, 32])
BASE = np.uint64(0x9E3779B97F4A7C15)
WINDOW, LEAST_WORDS, MOST_REPEATED = 3, 50, 50
#: The largest share of word characters inside duplicate n-grams, by n, and inside duplicate lines.
NGRAM_LIMITS = {5: 0.30, 6: 0.28, 7: 0.26, 8: 0.24, 9: 0.22, 10: 0.20}
LINE_LIMIT, LINE_CHARS_LIMIT = 0.30, 0.20

_letters = np.ones(256, bool)  # bytes that begin a code point of a word
_letters[0x80:0xC0] = False
_letters[SPACES] = False


def _code_points(word: bytes) -> int:
    return int(np.bincount(np.frombuffer(word, np.uint8), minlength=256)[_letters].sum()) if not word.isascii() else len(word)


def repeated(hashes: np.ndarray) -> np.ndarray:
    """Which windows occur twice or more."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside any marked window of n words."""
    edge = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: bytes | None) -> dict:
    """Base figures and coverage of one text; null is taken as empty."""
    text = text or b""
    words = text.split()  # ASCII white space only, as in the base rules
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    word_chars = int(seen[_letters].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds = set(lines)
    n = len(words)
    out = {"n_words": n, "word_chars": word_chars, "n_symbols": int(sum(seen[c] for c in SYMBOLS)), "n_dup_lines": len(lines) - len(kinds), "n_repeat_words": 0}
    shares, line_chars = dict.fromkeys(NGRAM_LIMITS, 0.0), 0
    if n >= WINDOW:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words), np.uint64, n)
        with np.errstate(over="ignore"):
            hashes = (ids[:-2] * BASE + ids[1:-1]) * BASE + ids[2:]
            again = repeated(hashes)
            out["n_repeat_words"] = int(covered(again, WINDOW, n).sum())
            sizes = None
            for k in range(WINDOW + 1, max(NGRAM_LIMITS) + 1):
                if not again.any() or k > n:
                    break
                hashes = hashes[:-1] * BASE + ids[k - 1 :]
                if k in NGRAM_LIMITS:
                    again = repeated(hashes)
                    if again.any():
                        sizes = np.fromiter(map(_code_points, words), np.int64, n) if sizes is None else sizes
                        shares[k] = int(sizes[covered(again, k, n)].sum()) / word_chars
    if out["n_dup_lines"]:
        first: set[bytes] = set()
        for line in lines:
            if line in first:
                line_chars += int(np.bincount(np.frombuffer(line, np.uint8), minlength=256)[_letters].sum())
            first.add(line)
    out["base_failed"] = n < LEAST_WORDS or 100 * out["n_repeat_words"] > MOST_REPEATED * n
    out["dup_line_share"] = out["n_dup_lines"] / len(lines) if lines else 0.0
    out["dup_line_char_share"] = line_chars / word_chars if word_chars else 0.0
    out |= {f"dup_{k}gram_share": v for k, v in shares.items()}
    passed = out["dup_line_share"] <= LINE_LIMIT and out["dup_line_char_share"] <= LINE_CHARS_LIMIT and all(shares[k] <= most for k, most in NGRAM_LIMITS.items())
    out["kept"] = bool(not out["base_failed"] and passed)
    return out


FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "dup_line_share": "double", "dup_line_char_share": "double"} | {f"dup_{k}gram_share": "double" for k in NGRAM_LIMITS}


def judge(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, figures, base_failed, kept, shares) for every row of df, whole texts. Null and empty texts have no words and fail
    the base rules; repeated rows repeat; an empty table gives no rows."""
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [measure(t) for t in byte_values(batch.column(1))]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[f] for r in rows], kinds[k]) for f, k in FIELDS.items())], names=[key, *FIELDS])

        return work

    return map_rows(df, [key, text], make, ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", *(f"{f} {k}" for f, k in FIELDS.items())]))


def _sql() -> str:
    grams = "\n".join(
        f", g{k} AS (SELECT *, count(*) OVER (PARTITION BY rid, g) > 1 AS again FROM (SELECT rid, i, {' || chr(32) || '.join(f'lead(w, {j}) OVER o' if j else 'w' for j in range(k))} AS g FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)) WHERE g IS NOT NULL)"
        f", c{k} AS (SELECT w.rid, w.i, w.n, coalesce(bool_or(coalesce(g.again, false)) OVER (PARTITION BY w.rid ORDER BY w.i ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), false) AS inside FROM words w LEFT JOIN g{k} g ON w.rid = g.rid AND w.i = g.i)"
        f", s{k} AS (SELECT rid, count(*) FILTER (WHERE inside) AS words, coalesce(sum(n) FILTER (WHERE inside), 0) AS chars FROM c{k} GROUP BY rid)"
        for k in (WINDOW, *NGRAM_LIMITS)
    )
    shares = ", ".join(f"coalesce(s{k}.chars, 0)::DOUBLE / nullif(b.word_chars, 0) AS x{k}" for k in NGRAM_LIMITS)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents)
, split AS (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM docs)
, words AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i, length(unnest(ws)) AS n FROM split)
, lines AS (SELECT rid, i, l, length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g')) AS n, row_number() OVER (PARTITION BY rid, l ORDER BY i) > 1 AS dup
    FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS i FROM docs) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]'))
, l AS (SELECT rid, count(*) AS n, count(*) FILTER (WHERE dup) AS dups, coalesce(sum(n) FILTER (WHERE dup), 0) AS chars FROM lines GROUP BY rid)
{grams}
, b AS (SELECT d.doc_id, d.rid, len(s.ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols
    FROM docs d JOIN split s USING (rid))
, f AS (SELECT b.*, coalesce(l.dups, 0) AS n_dup_lines, coalesce(s{WINDOW}.words, 0) AS n_repeat_words, coalesce(l.dups::DOUBLE / l.n, 0) AS dl, coalesce(l.chars::DOUBLE / nullif(b.word_chars, 0), 0) AS dc, {shares}
    FROM b LEFT JOIN l USING (rid) {' '.join(f'LEFT JOIN s{k} USING (rid)' for k in (WINDOW, *NGRAM_LIMITS))})
, v AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND dl <= {LINE_LIMIT} AND dc <= {LINE_CHARS_LIMIT} AND {' AND '.join(f'coalesce(x{k}, 0) <= {v}' for k, v in NGRAM_LIMITS.items())} AS kept
FROM v
"""


#: The contract's columns in DuckDB.
SQL = _sql()
