"""The pipeline's operators against brute force, on small fixtures and edge cases."""

import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from attestra.llm import bpe_bitmap, decontaminate_gst, language_ppm, pii_semicrf, queries, simhash_bytes

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
EDGES = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, " \n\t "), (None, "no id here at all"), (5, "word " * 30000), (6, "a" * 50000), (7, "é\x85 ß")]


# --- language ----------------------------------------------------------------------------------------------------


def ppm_walk(samples, text, order):
    """Code lengths straight from counts: escape method C, longest seen context first, no limit on contexts."""
    out = {}
    for lang in sorted({x for x, _ in samples}):
        counts = {}
        for of, t in samples:
            if of == lang:
                raw = b" " * order + language_ppm._encoded(t)
                for i in range(order, len(raw)):
                    for k in range(order + 1):
                        counts.setdefault(raw[i - k : i], {}).setdefault(raw[i], 0)
                        counts[raw[i - k : i]][raw[i]] += 1
                tail = raw + b" " * order  # the separator is coded too
                for i in range(len(raw), len(tail)):
                    for k in range(order + 1):
                        counts.setdefault(tail[i - k : i], {}).setdefault(32, 0)
                        counts[tail[i - k : i]][32] += 1
        raw, bits = b" " * order + language_ppm._encoded(text), 0.0
        for i in range(order, len(raw)):
            for k in range(order, -1, -1):
                seen = counts.get(raw[i - k : i])
                if not seen:
                    continue
                total, kinds = sum(seen.values()), len(seen)
                if raw[i] in seen:
                    bits += np.log2((total + kinds) / seen[raw[i]])
                    break
                bits += np.log2((total + kinds) / kinds)
            else:
                bits += 8
        out[lang] = bits
    return out


def test_code_lengths_are_those_of_the_context_trees():
    samples = [("a", "abra cadabra abra"), ("b", "hocus pocus focus"), ("a", "barbara")]
    model = language_ppm.fit(samples, order=3, max_contexts=10_000)
    for text in ("abracadabra", "pocus", "zzz", "a b c", "bar" * 300):
        found = language_ppm.code_lengths(model, [language_ppm._encoded(text)])[0] / language_ppm.UNIT
        assert found == pytest.approx(list(ppm_walk(samples, text, 3).values()), rel=1e-3, abs=0.05)


def test_lanes_and_pieces_do_not_change_a_sum():
    model = language_ppm.fit([("a", "the cat sat on the mat"), ("b", "le chat est sur la table")], order=4)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdest lre") for _ in range(rng.randrange(3000))).encode() for _ in range(40)] + [b"x" * (language_ppm.PIECE + 17)]
    whole = language_ppm.code_lengths(model, texts)
    for i in (0, 7, 40):
        state, total = 0, np.zeros(2, np.int64)
        for byte in b" " * model.order:
            state = int(model.next[state * 256 + byte])
        for byte in texts[i]:
            total += model.cost[state * 256 + byte]
            state = int(model.next[state * 256 + byte])
        assert (whole[i] == total).all()


def test_language_edges(docs):
    model = language_ppm.fit([("en", "the one word here"), ("fr", "le mot un ici")])
    rows = language_ppm.predict(docs(EDGES), model).collect()
    assert len(rows) == len(EDGES)
    by = {r.doc_id: r for r in rows}
    assert [by[k].lang_pred for k in (1, 2, 4)] == ["und"] * 3 and by[1].score == 0.0
    assert by[3].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows)
    assert language_ppm.predict(docs([]), model).count() == 0
    kept = language_ppm.recognised(docs([(1, "the word"), (2, None), (3, "12 34"), (4, "中文字" * 30)]), model)
    assert [r.doc_id for r in kept.collect()] == [1] and len(kept.columns) == len(docs([]).columns)
    nothing = language_ppm.fit([])
    assert {r.lang_pred for r in language_ppm.predict(docs([(1, "x")]), nothing).collect()} == {"und"}
    assert language_ppm.recognised(docs([(1, "x"), (2, "1")]), nothing).count() == 1


def test_an_unlearned_latin_text_is_rejected_and_short_clean_ones_stay(spark, folder, docs):
    found = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    model = language_ppm.learn(found)
    other = "Quisque tempor incididunt ut labore et dolore magna aliqua, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure"
    rate = min(language_ppm.code_lengths(model, [language_ppm._encoded(other)])[0]) / language_ppm.UNIT / len(language_ppm._encoded(other))
    assert 8 < rate < 9
    assert language_ppm.recognised(docs([(1, other)]), model).count() == 0
    clean = found.filter("length(text) < 200 and text rlike '[a-z]'")
    assert language_ppm.recognised(clean, model).count() == clean.count() > 0


def test_only_letters_make_a_language(docs):
    model = language_ppm.fit([("en", "the one word here"), ("fr", "le mot un ici")])
    found = {r.doc_id: r.lang_pred for r in language_ppm.predict(docs([(1, "½ ² ③ Ⅷ 12"), (2, "ª"), (3, "_"), (4, "字")]), model).collect()}
    assert found[1] == found[3] == "und" and "und" not in (found[2], found[4])
    assert [r.doc_id for r in language_ppm.recognised(docs([(1, "½ ² ③"), (2, "the")]), model).collect()] == [2]


def test_the_sample_is_bounded_in_bytes_and_labels(docs, monkeypatch):
    taken = []
    monkeypatch.setattr(language_ppm, "fit", lambda samples, *_: taken.append(samples))
    rows = [(i, "ü" * 100) for i in range(50)] + [(i, "z" * 5000) for i in range(50, 53)] + [(60, "½")]
    language_ppm.learn(docs(rows, lambda i, t: "many" if i < 50 else "few" if i < 60 else "none"), max_bytes=1000)
    sizes = {lang: [len(t.encode()) for of, t in taken[0] if of == lang] for lang, _ in taken[0]}
    assert sizes == {"many": [200] * 5, "few": [5000]}
    language_ppm.learn(docs(rows, lambda i, t: "many" if i < 50 else "few"), max_labels=1, per_label=3)
    assert [lang for lang, _ in taken[1]] == ["many"] * 3


def test_held_out_accuracy(spark, folder):
    found = queries.op6_language(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").filter("held_out")
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in found.select("doc_id").collect())
    assert found.filter("lang = lang_pred").count() >= 0.95 * found.count() > 20


def test_labels_of_the_held_out_third_teach_nothing(docs, spark):
    rows = [(i, "alpha beta gamma" if i % 2 else "un deux trois quatre") for i in range(60)]
    honest = docs(rows, lambda i, t: "x" if i % 2 else "y")
    lied = docs(rows, lambda i, t: "z" if zlib.crc32(str(i).encode()) % 3 == 1 else "x" if i % 2 else "y")
    pick = lambda d: sorted((r.doc_id, r.lang_pred, r.score) for r in language_ppm.identify(d).collect())
    assert pick(honest) == pick(lied)


# --- near duplicates ---------------------------------------------------------------------------------------------


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_match_brute_force(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in queries.op4_simhash(spark, folder).collect()}
    prints = [brute_print(r.text) for r in rows]
    assert [int(found[r.doc_id].fingerprint, 16) for r in rows] == prints
    roots = components(prints)
    least = {root: min(r.doc_id for r, x in zip(rows, roots, strict=True) if x == root) for root in set(roots)}
    assert [found[r.doc_id].component_id for r in rows] == [least[x] for x in roots]


@pytest.mark.parametrize(("n", "block"), [(20, 4096), (400, 4096), (400, 64)])
def test_links_keep_every_component_of_dense_lists(spark, n, block):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**63, 3, dtype=np.uint64)
    x = np.concatenate([c ^ np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, False).astype(np.uint64)) for k in rng.integers(1, 6, n)], np.uint64) for c in centres])
    x = np.unique(x)
    df = spark.createDataFrame([(int(v), [int(v)]) for v in x.view(np.int64)], "node long, fps array<long>")
    linked = simhash_bytes.connected_components(simhash_bytes.links(df, block)).collect()
    of = {r.node: r.root for r in linked}
    found = [of.get(int(v), int(v)) for v in x.view(np.int64)]
    brute = components([int(v) for v in x])
    assert len(set(zip(found, brute, strict=True))) == len(set(found)) == len(set(brute))


def test_the_tally_rejects_pairs_before_their_bits_are_compared():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    x[1::2] = (x[::2] & np.uint64(0xFFFFFF)) | (x[1::2] & ~np.uint64(0xFFFFFF))  # neighbours share three bytes
    x[2::50] = x[::50] ^ np.uint64(0x0101010100000000)  # four bits in four bytes
    keys = simhash_bytes.codes(x, 0)
    met = {}
    for i, row in enumerate(keys.tolist()):
        for k in row:
            met.setdefault(k, []).append(i)
    pairs = {(i, j) for v in met.values() for i in v for j in v if i < j}
    a, b = (x[list(c)] for c in zip(*pairs, strict=True))
    shared = simhash_bytes.tally(a ^ b)
    assert (shared == [sum(int(p) >> 8 * k & 255 == int(q) >> 8 * k & 255 for k in range(8)) for p, q in zip(a, b, strict=True)]).all()
    retained, kept = shared >= 4, simhash_bytes.linked(a, b)
    assert len(pairs) > 2 * retained.sum() and kept.sum() == 80 and not (kept & ~retained).any()
    assert (kept == (np.bitwise_count(a ^ b) <= 4)).all()


def test_a_list_of_200000_fingerprints_is_cut(spark):
    rng = np.random.default_rng(4)
    x = np.unique((rng.integers(0, 2**62, 200_000, dtype=np.uint64) << np.uint64(24)) | np.uint64(0xABCDEF))
    x[1] = x[0] ^ np.uint64(1 << 60)
    df = spark.createDataFrame(pd.DataFrame({"node": x.view(np.int64)})).selectExpr("node", "array(node) AS fps")
    cut, blocks = simhash_bytes.long_lists(df)
    assert len(cut) == 1 and 40 < blocks[0] < 60 and not len(simhash_bytes.long_lists(df, split=cut)[0])
    found = {tuple(sorted((r.a, r.b))) for r in simhash_bytes.links(df).collect()}
    ends = {tuple(sorted((int(a), int(b)))) for a, b in (x[:2].view(np.int64),)}
    assert ends <= found and all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in found)


def test_more_draws_find_more_near_copies_and_no_unlike_texts(docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [[word() for _ in range(120)] for _ in range(40)]
    copies = [[w if k not in (20, 80) else word() for k, w in enumerate(t)] for t in texts]
    df = docs([(i, " ".join(t)) for i, t in enumerate(texts + copies)])
    caught = []
    for draws in (1, 4):
        found = {r.doc_id: r.component_id for r in simhash_bytes.near_duplicates(df, words=2, draws=draws).collect()}
        assert all(found[i] in (i, i - 40) for i in found)
        caught.append(sum(found[i + 40] == i for i in range(40)))
    assert 1.5 * caught[0] < caught[1] and caught[1] >= 30


def test_near_duplicate_edges(docs):
    rows = simhash_bytes.near_duplicates(docs(EDGES)).collect()
    assert len(rows) == len(EDGES)
    assert {r.fingerprint for r in rows if r.doc_id in (1, 2, 4)} == {"0" * 16}
    assert {r.component_id for r in rows if r.doc_id in (1, 2, 4)} == {1}
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert simhash_bytes.near_duplicates(docs([])).count() == 0
    kept = simhash_bytes.representatives(docs(EDGES)).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, 1, 3, 5, 6, 7]


# --- decontamination ---------------------------------------------------------------------------------------------


def brute_tiles(p, t, least):
    free_p, free_t, tiles = [True] * len(p), [True] * len(t), 0
    while True:
        best = []
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and free_p[i + k] and free_t[j + k] and p[i + k] == t[j + k] >= 0:
                    k += 1
                if k >= least:
                    best.append((-k, i, j))
        if not best:
            return tiles
        top = min(best)[0]
        for k, i, j in sorted(best):
            if k == top and all(free_p[i : i - k]) and all(free_t[j : j - k]):
                free_p[i : i - k] = free_t[j : j - k] = [False] * -k
                tiles -= k


def test_tiles_match_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        v = rng.choice([2, 3, 9])
        p, t = [rng.randrange(v) for _ in range(rng.randrange(25))], [rng.randrange(v) for _ in range(rng.randrange(40))]
        if rng.random() < 0.5:
            t += p[len(p) // 2 :] + [-1] + p[: len(p) // 2]
        assert sum(k for _, _, k in decontaminate_gst.tile(p, t, 3)) == brute_tiles(p, t, 3)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_reordered_passages_are_found_and_clean_ones_left(docs, spark):
    halves = ITEM.split()
    swapped = " ".join(halves[6:] + ["and"] + halves[:6])
    rows = [(1, f"so {ITEM.upper()}, he said"), (2, swapped), (3, "alpha beta gamma delta epsilon only"), (4, "quite other words are here"), (1, ITEM)]
    items = spark.createDataFrame([(9, ITEM), (8, "too short"), (7, None), (6, "")], "item_id long, text string")
    found = decontaminate_gst.contaminated(docs(rows + EDGES[:5]), items)
    assert sorted((r.doc_id, r.item_id, r.n_tiles, r.covered) for r in found.collect()) == [(1, 9, 1, 12), (1, 9, 1, 12), (2, 9, 2, 12)]
    kept = decontaminate_gst.decontaminate(docs(rows + EDGES), items)
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 3, 3, 4, 4, 5, 6, 7]
    short = decontaminate_gst.contaminated(docs([(1, "It was TOO, short!"), (2, "too very short"), (3, "short too")]), items)
    assert [(r.doc_id, r.item_id, r.coverage) for r in short.collect()] == [(1, 8, 1.0)]
    assert sorted(r.doc_id for r in decontaminate_gst.decontaminate(docs([(1, "too short"), (2, "to short")]), items).collect()) == [2]
    many = decontaminate_gst.contaminated(docs(rows), items, block_bytes=8)
    assert sorted(r.doc_id for r in many.collect()) == [1, 1, 2]
    assert decontaminate_gst.contaminated(docs([]), items).count() == 0
    assert decontaminate_gst.contaminated(docs(rows), items.filter("item_id < 0")).count() == 0


def test_decontamination_matches_plain_containment(spark, folder):
    """Items planted whole are exactly those whose words a document holds in a row."""
    import re

    items = spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    flat = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    whole = {(d.doc_id, i.item_id) for d in rows for i in items if flat(i.text) in flat(d.text)}
    found = {(r.doc_id, r.item_id) for r in queries.op1_decontamination(spark, folder).filter("coverage = 1").collect()}
    assert whole and found == whole


# --- personal data -----------------------------------------------------------------------------------------------


def plain_spans(text):
    import re

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_match_the_plain_patterns(spark, folder):
    rng = random.Random(3)
    for _ in range(5000):
        s = "".join(rng.choice("1203459 .-@ab+()") for _ in range(rng.randrange(40)))
        assert pii_semicrf.base_spans(s) == plain_spans(s)
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect():
        assert pii_semicrf.base_spans(r.text) == plain_spans(r.text)


def test_decoding_is_the_best_of_all_segmentations():
    rng, n = np.random.default_rng(5), 5
    scores = {(i, j): np.concatenate([[0.0 if j == i + 1 else -np.inf], rng.normal(size=len(pii_semicrf.KINDS))]) for i in range(n) for j in range(i + 1, min(n, i + pii_semicrf.LONGEST) + 1)}
    moves = rng.normal(size=(len(pii_semicrf.STATES),) * 2)

    def every(i, before):
        if i == n:
            yield 0.0, []
        for j in range(i + 1, n + 1):
            for s in range(len(pii_semicrf.STATES)):
                here = moves[before, s] + scores[i, j][s]
                if np.isfinite(here):
                    for rest, path in every(j, s):
                        yield here + rest, ([(i, j, s)] if s else []) + path

    totals = list(every(0, 0))
    whole = {k: np.where(np.isfinite(v), np.nan_to_num(v * 2**30, neginf=0).round(), pii_semicrf.NEVER).astype(np.int64) for k, v in scores.items()}
    assert pii_semicrf.decode(n, lambda i, j: whole[i, j], np.rint(moves * 2**30).astype(np.int64)) == max(totals, key=lambda x: x[0])[1]
    z, segments, _ = pii_semicrf.marginals(n, scores, moves)
    assert z == pytest.approx(np.log(np.exp([x for x, _ in totals]).sum()))
    weight = np.exp([x - z for x, _ in totals])
    assert segments[0, 2][1] == pytest.approx(sum(w for w, (_, path) in zip(weight, totals, strict=True) if (0, 2, 1) in path))


def test_the_field_learns_its_grammar():
    field = pii_semicrf.trained()
    rng, right = random.Random(99), 0
    for _ in range(200):
        tokens, spans = pii_semicrf._grammar(rng)
        text = " ".join(tokens)
        places = [m.span() for m in pii_semicrf.TOKEN.finditer(text)]
        scored = pii_semicrf.scorer(text, places, lambda i, tokens=tokens: " ".join(tokens[max(0, i - 2) : i]).lower(), field)
        right += [(i, j, pii_semicrf.STATES[s]) for i, j, s in pii_semicrf.decode(len(tokens), scored, field.moves)] == spans
    assert right >= 190


def test_added_spans_and_masks():
    text = "call (559) 555-3893 or +1 (269) 555-3296 4524132264652876 now, password=32bb02aa3b580bf8ab in 2019"
    base, spans = pii_semicrf.find(text)
    assert {(k, text[a:b]) for k, a, b in spans} == {("phone", "(559) 555-3893"), ("phone", "+1 (269) 555-3296"), ("card", "4524132264652876"), ("secret", "32bb02aa3b580bf8ab")}
    assert set(base) <= set(spans)
    assert pii_semicrf.masked("mail a.b@c.de, call +1 (559) 555-3893 x 1.2.3.4") == "mail [EMAIL], call [PHONE] x [IP]"
    assert pii_semicrf.masked("Chapter 3, 42 pages, 3.5% of 1,000 in 1999.") == "Chapter 3, 42 pages, 3.5% of 1,000 in 1999."


def test_features_are_of_the_whole_segment():
    url = f"https://host/{'a' * 130}?x=1&password=ab12cd34"
    assert [(k, url[a:b]) for k, a, b in pii_semicrf.find(url)[1]] == [("secret", "ab12cd34")]
    on = lambda s: {pii_semicrf.FEATURES[k] for k in pii_semicrf.segment_features(s, 1)}
    assert "letters and digits" not in on("a1b2c3" * 30 + "/") and "only digits" not in on("9" * 128 + "abc")


def test_personal_data_without_a_digit_or_sign():
    for text, want in (
        ("Write to john at example dot com today", [("email", "john at example dot com")]),
        ("or john dot smith at mail dot example dot com.", [("email", "john dot smith at mail dot example dot com")]),
        ("Or john (at) example.com or jane[at]corp[dot]org", [("email", "john (at) example.com"), ("email", "jane[at]corp[dot]org")]),
        ("login with password: correcthorse please", [("secret", "correcthorse")]),
        ("password:correcthorse", [("secret", "correcthorse")]),
        ("we met at noon, at home (at last), with a token of thanks; connect the dots", []),
    ):
        assert [(k, text[a:b]) for k, a, b in pii_semicrf.find(text)[1]] == want
    assert pii_semicrf.masked("password: correcthorse") == "password: [SECRET]"


def test_a_long_block_is_decoded_in_a_window():
    import tracemalloc

    rng = random.Random(11)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(6000)) + " (559) 555-3893 a@b.de " + "x@y.zz " * 3000 + "call (559) 555-3894"
    field = pii_semicrf.trained()
    tracemalloc.start()
    base, spans = pii_semicrf.find(text, field)
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(base) == 3001 and {text[a:b] for k, a, b in spans if k == "phone"} >= {"(559) 555-3893", "(559) 555-3894"}
    assert used < 40 << 20


def test_overlaps_with_base_spans_are_found_among_all_of_them():
    rng = random.Random(12)
    for _ in range(300):
        spans = [("card", a, a + rng.randrange(1, 9)) for a in (rng.randrange(60) for _ in range(rng.randrange(8)))]
        starts, stops = pii_semicrf._merged(spans)
        for a in range(60):
            for b in range(a + 1, 62):
                before = pii_semicrf.bisect_left(starts, b) - 1
                assert (before < 0 or stops[before] <= a) == (not any(x < b and a < y for _, x, y in spans))


def test_personal_data_edges(docs):
    rows = [*EDGES, (8, "1" * 60000), (9, "a@" * 20000), (10, "x@y.zz " * 3)]
    found = {r.doc_id: r for r in pii_semicrf.detect(docs(rows)).collect()}
    assert found[1].spans == found[2].spans == [] and len(found[10].base) == 3
    assert pii_semicrf.detect(docs([])).count() == 0
    hidden = {r.doc_id: r for r in pii_semicrf.mask(docs(rows), length="n_chars").collect()}
    assert hidden[1].text is None and hidden[10].text == "[EMAIL] [EMAIL] [EMAIL] " and hidden[10].n_chars == 24


# --- byte-level BPE ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe_bitmap.read_ranks(PATH), special_tokens={})


def test_merges_match_the_library(reference):
    vocabulary = bpe_bitmap.vocabulary(PATH, PATTERN)
    rng = random.Random(1)
    for _ in range(1500):
        s = "".join(rng.choice("abtheinr  \n\té1#'s中\U0001f600\x1c\x85") for _ in range(rng.randrange(60)))
        assert [i for p in vocabulary.find(s) for i in vocabulary.merge(p.encode())] == reference.encode_ordinary(s)
    long = "ab" * 20000 + "the" * 9000
    assert vocabulary.merge(long.encode()) == reference.encode_ordinary(long)


def test_encoding_round_trip(spark, folder, docs, reference):
    rows = {r.doc_id: r for r in queries.op7_bpe(spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.sha2("text", 256).alias("digest")).collect():
        ids = reference.encode_ordinary(r.text)
        import hashlib

        assert rows[r.doc_id].n_tokens == len(ids) and rows[r.doc_id].decoded_sha256 == r.digest
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    edges = bpe_bitmap.decode(bpe_bitmap.encode(docs(EDGES), PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((r.doc_id or -1, bytes(r.decoded)) for r in edges) == sorted((i or -1, (t or "").encode()) for i, t in EDGES)
    assert bpe_bitmap.encode(docs([]), PATH, PATTERN).count() == 0
