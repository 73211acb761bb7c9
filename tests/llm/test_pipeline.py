"""The whole pipeline against a plain version of each stage."""

import hashlib
import random
import re

import public_tokenizers
import tiktoken

import numpy as np
import xxhash

import corpus_pipeline
from attestra.llm import bpe_bitmap, pii_semicrf, simhash_bytes


def brute_prints(text, words, draws):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return [0] * draws
    hashes = [xxhash.xxh64_intdigest(b" ".join(tokens[i : i + words]), 42) for i in range(max(len(tokens) - words + 1, 1))]
    out = []
    for draw in range(draws):
        own = [int(simhash_bytes.mixed(np.array([h], np.uint64), draw)[0]) for h in hashes]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)))
    return out


def components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if any(bin(a ^ b).count("1") <= 4 for a, b in zip(prints[i], prints[j], strict=True)):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def plain(docs, items):
    docs = [d for d in docs if d[1] is not None and re.search(r"[^\W\d_]", d[1])]
    prints = [brute_prints(t, corpus_pipeline.SHINGLE, corpus_pipeline.DRAWS) for _, t in docs]
    roots = components(prints)
    least = {}
    for (i, _), r in zip(docs, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    docs = [d for d, r in zip(docs, roots, strict=True) if d[0] == least[r]]
    flat = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    docs = [(i, t) for i, t in docs if not any(flat(x) in flat(t) for x in items)]
    return [(i, pii_semicrf.masked(t)) for i, t in docs]


def test_run_matches_the_plain_stages(spark, folder):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_bitmap.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    expected = {i: (encoding.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in plain(docs, items)}
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: (list(r.ids), r.decoded_sha256) for r in found} == expected
    assert len(found) == len(expected) < len(docs)


def test_stages_take_nulls_repeats_and_nothing(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp int, k string"
    rows = [(1, None, None, None, None, 1, "x"), (2, "", "en", "s", 0, 1, "x"), (3, "Some words that are here.", None, None, None, 1, "x"), (3, "Some words that are here.", None, None, None, 1, "x"), (None, "Some other words stay here.", "en", None, 5, 1, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
            if name != "encode":
                assert docs.columns == corpus_pipeline.COLUMNS
        assert sorted((r.doc_id or -1) for r in docs.collect()) == ([-1, 3] if data else [])


def test_every_stage_decides(spark, tmp_path):
    rng = random.Random(1)
    known = {lang: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(60)] for lang, letters in (("aa", "abdeiklmnorst"), ("bb", "cfghjpquvwxyz"))}
    say = lambda lang, n: " ".join(rng.choice(known[lang]) for _ in range(n))
    docs = {i: (say("aa" if i % 2 else "bb", 80), "aa" if i % 2 else "bb") for i in range(60)}
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    words = item.split()
    docs[100] = ("Ξεσκεπάζω την ψυχοφθόρα βδελυγμία και ακόμη περισσότερα λόγια που κανείς δεν ξέρει", None)
    docs[101] = (docs[5][0] + " end", "aa")
    docs[102] = (say("aa", 30) + " " + " ".join(words[10:16]) + " " + say("aa", 5) + " " + " ".join(words[:6]) + " " + say("aa", 30), "aa")  # three quarters, reordered
    docs[103] = (say("bb", 30) + " " + " ".join(words[:6]) + " " + say("bb", 30), "bb")  # three eighths stay
    docs[104] = (say("aa", 30) + " write to a.b@c.de", "aa")
    table = [(i, t, lang, "s", len(t)) for i, (t, lang) in docs.items()]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == set(docs) - {100, 101, 102}
    hidden = docs[104][0].replace("a.b@c.de", "[EMAIL]")
    assert found[104].decoded_sha256 == hashlib.sha256(hidden.encode()).hexdigest()
