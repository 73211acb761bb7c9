"""Searches, joins and passage proofs against plain Python and edge cases."""

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from attestra.functions import observe
from attestra.functions import text as T
from attestra.operators import conjunctive, diary, narrative, proofs, ranking, retrieval, search, strategy
from attestra.plans import recall


def plain_pressure(rows, owed, limit, budget):
    picked, shut, used = [], set(), 0
    while len(picked) < limit:
        choices = []
        for mode, rank, fact, cost, keys in rows:
            if fact in picked or used + cost > budget:
                continue
            closure = sum(owed[k] for k in (keys & owed.keys()) - shut)
            choices.append((round(closure, 9), round(closure + 1 / (1 + rank) - math.log2(1 + cost) / 100, 9), -cost, -rank, mode, -fact, keys))
        if not choices or max(choices)[0] <= 0:
            break
        best = max(choices)
        picked.append(-best[5])
        shut |= best[6] & owed.keys()
        used -= best[2]
    return picked


def test_pressure_matches_a_plain_greedy_search(spark):
    rng = random.Random(1)
    rows, owed = [], []
    for q in range(6):
        facts = {f: (rng.randrange(1, 60), sorted({f"k{rng.randrange(9)}" for _ in range(4)})) for f in range(12)}
        for mode in ("direct", "far"):
            for rank, f in enumerate(rng.sample(sorted(facts), 8)):
                rows.append((q, mode, rank, f, *facts[f]))
        owed += [(q, f"k{k}", rng.choice([1.0, 1.15, 3.0])) for k in rng.sample(range(9), 6)]
    found = search.pressure(spark.createDataFrame(rows, "query_id long, mode string, rank int, fact_id long, cost int, keys array<string>"), spark.createDataFrame(owed, "query_id long, key string, weight double"), 5, 120).collect()
    for q in range(6):
        expected = plain_pressure([(m, r, f, c, set(k)) for i, m, r, f, c, k in rows if i == q], {k: w for i, k, w in owed if i == q}, 5, 120)
        assert [r.fact_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.position)] == expected


def test_a_greedy_cover_matches_a_plain_one(spark):
    rng = random.Random(2)
    rows = [(q, f, sorted({f"t{rng.randrange(12)}" for _ in range(5)}), rng.randrange(1, 30)) for q in range(5) for f in range(8)]
    found = ranking.max_cover(spark.createDataFrame(rows, "query_id long, fact_id long, tokens array<string>, cost int"), "query_id", 50).collect()
    for q in range(5):
        left, seen, used, picked = {f: (set(t), c) for i, f, t, c in rows if i == q}, set(), 0, []
        while fits := {f: len(t - seen) / c for f, (t, c) in left.items() if used + c <= 50 and t - seen}:
            best = min(fits, key=lambda f: (-fits[f], f))
            tokens, cost = left.pop(best)
            seen, used = seen | tokens, used + cost
            picked.append(best)
        assert [r.fact_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.position)] == picked


@pytest.mark.parametrize("floor", [0.12, 0.5, 0.75, 1.0])
def test_prefixes_lose_no_similar_pair(spark, floor):
    rng = random.Random(3)
    rows = [(rng.randrange(2), i, sorted({f"w{min(rng.randrange(25), rng.randrange(25))}" for _ in range(rng.randrange(1, 9))})) for i in range(60)] + [(0, 99, [])]
    found = {(r.a, r.b) for r in retrieval.similar_pairs(spark.createDataFrame(rows, "g int, id long, words array<string>"), ["g"], "id", "words", floor).collect()}
    assert found == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] and b[2] and len(set(a[2]) & set(b[2])) >= floor * len(set(a[2]) | set(b[2]))}


def test_similar_pairs_move_only_rows_that_share_a_rare_word(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(retrieval, "materialize", lambda df, name: kept.append(df.cache()) or kept[-1])
    rows = [(1, i, ["sold", "lot", "of", "part", f"o{i}", f"p{i}" if i != 7 else "p6"]) for i in range(400)] + [(2, i, ["sold", "lot", "of", "part"]) for i in range(2)]
    found = retrieval.similar_pairs(spark.createDataFrame(rows, "g int, id long, words array<string>"), ["g"], "id", "words", 0.7).collect()
    assert {(r.g, r.a, r.b) for r in found} == {(1, 6, 7), (2, 0, 1)} and len(found) == 2
    assert {(r.g, r._w) for r in kept[0].collect() if r.g == 1} == {(1, "p6")}


def test_similar_pairs_meet_without_their_sets(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(retrieval, "materialize", lambda df, name: kept.append(df.cache()) or kept[-1])
    rows = [(i // 4, i, sorted([f"own{i}x{j}" for j in range(30)] + [f"g{i // 4}x{j}" for j in range(3 + i % 9)])) for i in range(40)]
    found = {(r.a, r.b): r.similarity for r in retrieval.similar_pairs(spark.createDataFrame(rows, "g int, id long, words array<string>"), ["g"], "id", "words", 0.12).collect()}
    plain = {(a[1], b[1]): len(set(a[2]) & set(b[2])) / len(set(a[2]) | set(b[2])) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]}
    assert found == pytest.approx({k: v for k, v in plain.items() if v >= 0.12}) and found
    assert [sorted(df.dtypes) for df in kept] == [[("_n", "int"), ("_w", "string"), ("g", "int"), ("id", "bigint")]]


def test_set_coverage_gives_each_document_its_own_rows(spark):
    rng = random.Random(9)
    text = lambda: " ".join(f"w{min(rng.randrange(20), rng.randrange(20))}" for _ in range(rng.randrange(1, 7)))
    docs, asked = [(i, text()) for i in range(60)] + [(70, None), (71, ""), (72, "other")], [(i, text() + " absent" * (i % 2)) for i in range(9)] + [(9, ""), (10, None)]
    tables = spark.createDataFrame(docs, "fact_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")
    held, n = {i: set((t or "").split()) for i, t in docs}, 61
    weight = {t: math.log((n + 1) / (sum(t in h for h in held.values()) + 1)) for _, x in asked for t in (x or "").split()}
    plain = {}
    for q, x in asked:
        wanted = set((x or "").split())
        for d, h in held.items():
            if wanted & h:
                c = sum(weight[t] for t in wanted & h) / sum(weight[t] for t in wanted)
                plain[q, d] = (len(wanted & h), pytest.approx(c, abs=2e-6), pytest.approx(c * (1 + 0.05 * math.log1p(len(wanted & h))), abs=2e-6))
    for block in (4, 8192):
        found = retrieval.set_coverage(*tables, block=block)
        assert {(r.query_id, r.doc): (r.support, r.coverage, r.score) for r in found.collect()} == plain and found.count() == len(plain)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_lexical_ranking_reads_its_documents_once(spark, tmp_path):
    spark.createDataFrame([(i, f"word{i % 7} common text {i % 3}") for i in range(50)], "fact_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    asked = spark.createDataFrame([(1, "word3 common"), (2, "absent"), (3, None), (4, "word1 word2 0")], "query_id long, text string")
    scored = retrieval.bm25_scores(docs, asked)
    rows = {(r.query_id, r.fact_id): r.score for r in scored.collect()}
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("FileScan parquet [fact_id") == 1
    texts = {r.fact_id: r.text.split() for r in docs.collect()}
    df = lambda w: sum(w in t for t in texts.values())
    for (q, f), score in rows.items():
        words = {1: ["word3", "common"], 4: ["word1", "word2", "0"]}[q]
        assert score == pytest.approx(sum(math.log(1 + (50 - df(w) + 0.5) / (df(w) + 0.5)) * 2.2 / (1 + 1.2) for w in words if w in texts[f]))
    assert retrieval.bm25_scores(docs.limit(0), asked).count() == retrieval.bm25_scores(docs, asked.limit(0)).count() == 0


def test_rankings_tokenize_their_documents_once(spark):
    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda t: seen.add(1) or t, "string").asNondeterministic()
    docs = spark.createDataFrame([(i, f"word{i % 7} common text {i % 3}") for i in range(50)], "fact_id long, text string").withColumn("text", told("text"))
    asked = spark.createDataFrame([(1, "word3 common"), (2, "absent"), (4, "word1 word2 0")], "query_id long, text string")
    assert [r.fact_id for r in retrieval.lexical_top(docs, asked, 2).filter("query_id = 1").orderBy("rank").collect()] == [3, 10]
    assert seen.value == 50


def test_batches_split_as_columns_do(spark):
    rng = random.Random(3)
    some = "aB9 _-\u0130\u03a3\u03c3\u03c2K\u212a\u212b\u023a\u1e9e\u00df\u00c9e\u0301\u0416\u4e2d\u00b2\u00bd\u01c5\U0001d400\U00010400\u0660\n'"
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(25))) for _ in range(300)] + [None, "", "a", "\u03a3", "\u0391\u03a3 \u03a3", "\u4e2d"]
    texts += ["".join(chr(rng.choice((rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x110000)))) for _ in range(40)) for _ in range(100)]
    bad = spark.createDataFrame(list(enumerate(texts)), "id long, text string").union(spark.sql("SELECT 1000L, cast(unhex('C3416220F09F7A') AS string)")).coalesce(1)
    splitter = T.Splitter.of(spark)
    table = bad.select(splitter.ready(F.col("text")).alias("t"), T.tokens(F.col("text")).alias("w")).toArrow().combine_chunks()
    for start, size in ((0, 500), (7, 100), (300, 0)):
        part = table.slice(start, size)
        counts, tokens = splitter.split(part.column(0).combine_chunks())
        tokens.validate(full=True)
        assert counts.tolist() == [len(w) for w in part.column(1).to_pylist()] and tokens.to_pylist() == [t for w in part.column(1).to_pylist() for t in w]


def test_stretches_without_a_word_shift_no_counts(spark):
    texts = [(i, "" if i < 2000 or i % 2 else f"w{i % 5} w1") for i in range(5000)]
    docs = spark.createDataFrame(texts, "fact_id long, text string").coalesce(1).sortWithinPartitions("fact_id")
    asked = spark.createDataFrame([(1, "w4")], "query_id long, text string")
    for rank in (retrieval.bm25, retrieval.dense):
        assert [r.fact_id for r in rank(docs, asked, 3).orderBy("rank").collect()] == [2004, 2014, 2024]
    assert retrieval.hybrid(docs.filter("text = ''"), asked, 3).count() == 0


def test_a_conformal_ranking_tokenizes_its_documents_once(spark):
    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda t: seen.add(1) or t, "string").asNondeterministic()
    docs = spark.createDataFrame([(i, f"word{i % 7} common text {i % 3}") for i in range(50)], "fact_id long, text string").withColumn("text", told("text"))
    asked = spark.createDataFrame([(1, "word3 common"), (2, "absent"), (4, "word1 word2 0")], "query_id long, text string")
    assert {r.query_id for r in retrieval.conformal_top(docs, asked.filter("query_id < 3"), asked.filter("query_id = 4"), 0.1, 3).collect()} == {1}
    assert seen.value == 50


def test_rankings_that_keep_the_best_are_those_of_all_scores(spark):
    rng = random.Random(7)
    text = lambda: " ".join(f"w{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(1, 9)))
    docs = spark.createDataFrame([(i, text()) for i in range(150)] + [(200 + i, "w1 w2 w3") for i in range(20)] + [(300, None), (301, "")], "fact_id long, text string").repartition(5)
    asked = spark.createDataFrame([(i, text()) for i in range(16)] + [(16, ""), (17, None), (18, "absent")], "query_id long, text string")
    pick = lambda df: sorted((r.query_id, r.fact_id, r["rank"], round(r.score, 9)) for r in df.collect())
    stable = lambda df, k: ranking.top_k(df.withColumn("score", F.round("score", 9)), k, ["query_id"])
    assert pick(retrieval.lexical_top(docs, asked, 6)) == pick(retrieval.lexical_top(docs, asked, 6, block=4)) == pick(stable(retrieval.bm25_scores(docs, asked), 6))
    assert pick(retrieval.channels_top(docs, asked, 6, (0.5, 0.3, 0.2))) == pick(retrieval.channel_rank(retrieval.channels(docs, asked), 6, (0.5, 0.3, 0.2)))
    scored = retrieval.bm25_scores(docs, asked).withColumn("score", F.round("score", 9))
    judged = retrieval.conformal(scored.filter("query_id % 4 != 0"), scored.filter("query_id % 4 = 0").select("score"), 0.5, 5)
    found = retrieval.conformal_top(docs, asked.filter("query_id % 4 != 0"), asked.filter("query_id % 4 = 0"), 0.5, 5)
    assert sorted((r.query_id, r.fact_id, round(r.p_value, 9)) for r in found.collect()) == sorted((r.query_id, r.fact_id, round(r.p_value, 9)) for r in judged.collect())


def test_a_median_interval_counts_places_and_skips_nulls(spark):
    rng = random.Random(8)
    rows = [(g, float(rng.randrange(40))) for g, n in ((1, 1), (2, 4), (3, 25)) for _ in range(n)] + [(3, None), (4, None)]
    found = {r.g: (r.low, r.high) for r in search.median_interval(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", 20).collect()}
    for g in (1, 2, 3):
        values = sorted(v for h, v in rows if h == g and v is not None) + [None] * sum(h == g and v is None for h, v in rows)
        medians = []
        for draw in range(20):
            drawn = [values[int(hashlib.md5(f"{draw}:{i}".encode()).hexdigest()[:8], 16) % len(values)] for i in range(len(values))]
            medians.append(statistics.median(v for v in drawn if v is not None))
        medians.sort()
        assert found[g] == (medians[0], medians[18])


def test_dense_ranking_in_blocks_is_that_of_one_block(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(6))
    docs = spark.createDataFrame([(i, text()) for i in range(80)] + [(80, None), (81, "")], "fact_id long, text string")
    asked = spark.createDataFrame([(i, text()) for i in range(20)] + [(20, "")], "query_id long, text string")
    pick = lambda **o: sorted((r.query_id, r.fact_id, r.rank) for r in retrieval.dense(docs, asked, 5, **o).collect())
    assert pick() == pick(block=6) and len({q for q, _, _ in pick()}) == 20


def test_a_hybrid_ranking_tokenizes_its_documents_once(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(6))
    docs = spark.createDataFrame([(i, text()) for i in range(80)] + [(80, None), (81, "")], "fact_id long, text string")
    asked = spark.createDataFrame([(i, text()) for i in range(20)] + [(20, ""), (21, "absent")], "query_id long, text string")
    ranked = [f(docs, asked, 32).select("query_id", F.lit(c).alias("channel"), "fact_id", "rank") for c, f in (("lexical", retrieval.tfidf), ("dense", retrieval.dense))]
    pick = lambda df: sorted((r.query_id, r["rank"], r.fact_id, round(r.score, 9)) for r in df.collect())
    seen = spark.sparkContext.accumulator(0)
    told = F.udf(lambda t: seen.add(1) or t, "string").asNondeterministic()
    found = pick(retrieval.hybrid(docs.withColumn("text", told("text")), asked, 10))
    assert seen.value == 82
    assert found == pick(ranking.fuse(ranked[0].union(ranked[1]), ["query_id"], ["lexical", "dense"], 60, 10)) == pick(retrieval.hybrid(docs, asked, 10, block=6))
    # cosines of signed counts by plain Python
    plain = {}
    for side in (docs, asked):
        for key, t in side.collect():
            held = {}
            for w in (t or "").split():
                d = hashlib.sha256(w.encode()).digest()
                held[d[0] + 256 * d[1]] = held.get(d[0] + 256 * d[1], 0) + (-1 if d[4] % 2 else 1)
            plain[side is docs, key] = held
    for q, f, score in retrieval.dense(docs, asked, 3).select("query_id", "fact_id", "score").collect():
        a, b = plain[False, q], plain[True, f]
        assert score == pytest.approx(sum(v * b.get(k, 0) for k, v in a.items()) / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())), abs=1e-8)


def test_conformal_p_values_count_the_calibration(spark):
    rng = random.Random(5)
    calm = [round(rng.random() * 3, 2) for _ in range(200)]
    rows = [(q, f, round(rng.random() * 3, 2)) for q in range(4) for f in range(30)]
    found = retrieval.conformal(spark.createDataFrame(rows, "query_id long, fact_id long, score double"), spark.createDataFrame([(c,) for c in calm], "score double"), 0.6, 7).collect()
    expected = {}
    for q in range(4):
        for _, f, s in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))[:7]:
            p = (1 + sum(c <= s for c in calm)) / 201
            if p > 0.6:
                expected[q, f] = p
    assert {(r.query_id, r.fact_id): r.p_value for r in found} == pytest.approx(expected)
    assert retrieval.conformal(spark.createDataFrame([], "query_id long, fact_id long, score double"), spark.createDataFrame([(1.0,)], "score double"), 0.5, 3).count() == 0


def test_mediators_need_two_facts(spark):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(6)}", f"m{rng.randrange(3)}", rng.randrange(15)) for _ in range(40)]
    both = edges + [(b, a, f) for a, b, f in edges]
    found = {(r.left, r.right): (r.mediators, r.paths) for r in conjunctive.mediators(spark.createDataFrame(both, "src string, dst string, fact_id long")).collect()}
    paths = [(a, m, c) for a, m, f in both for m2, c, g in both if m == m2 and a < c and f != g]
    assert found == {(a, c): (len({m for x, m, y in paths if (x, y) == (a, c)}), sum((x, y) == (a, c) for x, _, y in paths)) for a, _, c in paths}


def test_either_key_gives_each_pair_once(spark):
    left = spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "a int, b int")
    right = spark.createDataFrame([(1, 5), (3, 6), (2, None), (9, 7)], "c int, d int")
    found = sorted((r.a or -1, r.c) for r in search.either_key(left, right, ("a", "c"), ("b", "d")).collect())
    assert found == [(-1, 9), (1, 1), (2, 2), (2, 3)]


def test_either_key_is_counted_without_its_pairs(spark):
    left = spark.createDataFrame([(1, 5), (2, 6), (None, 7), (8, 8), (1, 5)], "a int, b int")
    right = spark.createDataFrame([(1, 5), (3, 6), (2, None), (9, 7), (4, 5)], "c int, d int")
    pairs = search.either_key(left, right, ("a", "c"), ("b", "d")).groupBy("b").agg(F.count("*").alias("pairs"))
    assert sorted(map(tuple, search.either_count(left, right, ("a", "c"), ("b", "d"), ["b"]).collect())) == sorted(map(tuple, pairs.collect())) == [(5, 4), (6, 2), (7, 1)]


def test_the_best_coalition_is_that_of_all_pairs_without_ranking_them(spark):
    rng = random.Random(9)
    agents = [(i, i % 2, rng.choice([0.3, 0.5, 0.7, 0.75, 0.9]), rng.choice([0.5, 0.8]), rng.randrange(4), rng.sample("abcd", 2)) for i in range(60)]
    df = spark.createDataFrame(agents, "id int, ideal int, strength double, reliability double, cost int, abilities array<string>")
    found = strategy.coalitions(df, "ideal", 0.8, -0.6, 4)
    expected = {}
    for i, a in enumerate(agents):
        for b in agents[i + 1 :]:
            if a[1] == b[1] and a[2] < 0.8 and b[2] < 0.8 and a[4] + b[4] <= 4:
                differ = 1 - len(set(a[5]) & set(b[5])) / len(set(a[5]) | set(b[5]))
                score = round(math.sqrt(a[2] * b[2]) * (1 + differ) * math.sqrt(a[3] * b[3]), 6)
                if score >= 0.2:
                    expected[a[1]] = min(expected.get(a[1], (9,)), (-score, a[0], b[0]))
    assert {r.ideal: (-r.score, r.first, r.second) for r in found.collect()} == expected
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_guarded_answers_gather_no_sets(spark):
    facts = spark.createDataFrame([(1, "g", "x"), (1, "h", "x"), (2, "g", "x"), (2, "h", "y"), (3, "g", "x"), (4, "g", None), (4, "h", None), (5, "g", "x"), (5, "g", "y"), (5, "h", "x"), (6, "g", "x"), (6, "h", None)], "k int, guard string, value string")
    found = strategy.guarded(facts, spark.createDataFrame([("u", ["g"]), ("v", ["h"])], "world string, holds array<string>"), ["k"])
    assert sorted((r.k, r.state, r.value) for r in found.collect()) == [(1, "resolved", "x"), (2, "contested", None), (3, "abstain", None), (4, "contested", None), (5, "contested", None), (6, "contested", None)]
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_shared_bindings_count_each_once(spark):
    found = narrative.shared_bindings(spark.createDataFrame([(1, 7), (1, 7), (2, 7), (2, 7), (2, 8), (1, 8), (3, 8)], "claim int, binding int"))
    assert sorted(map(tuple, found.collect())) == [(1, 2, 2), (1, 3, 1), (2, 3, 1)]
    assert "distinct" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_passages_abstain_and_contest(spark):
    docs = spark.createDataFrame([(1, "They won 24-17."), (2, "They won 24-17. No, they won 20-17."), (3, "Nothing here 3-4."), (4, None), (5, "")], "k int, text string")
    assert {r.k: (r.state, r.value) for r in proofs.score_margin(docs, ["k"]).collect()} == {1: ("resolved", "7"), 2: ("contested", None), 3: ("abstain", None), 4: ("abstain", None), 5: ("abstain", None)}
    events = spark.createDataFrame([(1, "left", "the treaty signed"), (1, "right", "the war ended")], "k int, side string, event string")
    told = spark.createDataFrame([(1, "The treaty was signed on 1950-01-02. The war ended on 1950-01-12.")], "k int, text string")
    assert proofs.event_interval(told, events, ["k"]).first().value == "10"
    tie = spark.createDataFrame([(1, "The treaty signed 1950-01-02. The treaty signed 1950-01-12. The war ended 1951-01-01.")], "k int, text string")
    assert proofs.event_interval(tie, events, ["k"]).first().state == "abstain"


def test_intervals_are_told_by_their_own_row(spark):
    rows = [
        ("The treaty was signed on 1950-01-02. The war ended on 1950-01-12.", "10", "1"), ("The war ended on 1950-01-12. The treaty was signed on 1948-12-31.", "377", "3"), ("The treaty signed 1950-01-02. The treaty signed 1950-01-12. The war ended 1951-01-01.", None, None),
        ("The treaty signed and the war ended 1950-01-02.", None, None), ("The treaty was signed on 1950-02-31. The war ended on 1950-01-12.", None, None), ("The war ended 1950-01-02. The treaty signed 1951-01-02.", None, None), ("The pact 1950-01-02. The war ended 1950-01-12.", None, None), (None, None, None), ("", None, None),
    ]
    docs = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(rows)], "k int, text string")
    near = docs.select("k", "text", F.array(F.lit("treaty signed")).alias("left"), F.array(F.lit("war ended")).alias("right"))
    days, years = proofs.interval_of(near, ["k"]), proofs.interval_of(near, ["k"], unit="year", closed=True)
    assert [(r.state, r.value) for r in days.orderBy("k").collect()] == [("resolved" if d else "abstain", d) for _, d, _ in rows]
    assert [(r.state, r.value) for r in years.orderBy("k").collect()] == [("resolved" if y else "abstain", y) for _, _, y in rows]
    assert all(x not in days._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Window", "Join"))
    sides = near.select("k", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.lit("treaty signed").alias("event")), F.struct(F.lit("right").alias("side"), F.lit("war ended").alias("event")))).alias("e")).select("k", "e.*")
    assert sorted(proofs.event_interval(docs, sides, ["k"]).collect()) == sorted(days.collect())


def test_diary_places_and_absence(spark):
    rows = [(1, 10, "I lost my keys at Grand Hotel."), (1, 11, "It rained in Paris."), (1, 13, "We ate in Paris."), (2, 10, "I lost my keys somewhere."), (3, 10, "I always lose my keys at Home.")]
    df = spark.createDataFrame(rows, "k int, fact_id long, text string")
    assert {r.k: (r.state, r.value) for r in diary.place_of(df, ["k"], "lost", ("keys",)).collect()} == {1: ("resolved", "grand hotel"), 2: ("abstain", None)}
    spent = spark.createDataFrame([(1, 1, "The flight took 3 hours."), (2, 1, "The flight took 3 hours."), (2, 2, "The hike took 4 hours."), (3, 1, "I will hike for 2 hours.")], "k int, fact_id long, text string")
    assert [(r.k, r.witness) for r in diary.never_said(spent, ["k"], ("hike",), ("flight",)).collect()] == [(1, 1)]


def test_observed_columns(spark):
    df = spark.createDataFrame([("It was 3:05 pm", "Ann did not pay $5", "Ann paid $5"), ("12:00 AM sharp", "a b", "a b"), ("13:99 pm", "x", "")], "clock string, a string, b string")
    found = df.select(observe.clock_minutes(F.col("clock")).alias("m"), observe.rewrite_verdict(F.col("a"), F.col("b")).alias("v")).collect()
    assert [r.m for r in found] == [905, 0, None]
    assert [r.v for r in found] == ["polarity_changed", "protected_literals_preserved", "empty_text"]


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from attestra.operators import graphs

    class Conf:
        def __init__(self, held):
            self.held = held

        def get(self, name, default=None):
            return self.held.get(name, default)

    class Session:
        def __init__(self, **held):
            self.conf = Conf({k.replace("_", "."): v for k, v in held.items()})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        graphs.shared_folder(Session(spark_master="spark://host:7077"))
    assert graphs.shared_folder(Session(spark_master="spark://host:7077", spark_checkpoint_dir="s3://x")) == "s3://x"
    assert graphs.shared_folder(Session(spark_master="local[2]")).startswith("file:///")


def test_components_that_do_not_settle_are_an_error(spark):
    from attestra.operators import graphs

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        graphs.connected_components(edges, max_rounds=1)


def plain_merge(primary, other, quota, reserve):
    out = list(primary[: quota - reserve])
    for x in other:
        if len(out) < quota and x not in out:
            out.append(x)
    return out + [x for x in dict.fromkeys([*primary, *other]) if x not in out]


def test_merges_protect_a_prefix_and_a_reserve(spark):
    rng = random.Random(7)
    lists = {q: [rng.sample(range(12), rng.randrange(0, 10)) for _ in (0, 1)] for q in range(8)}
    table = lambda k: spark.createDataFrame([(q, f, r) for q, two in lists.items() for r, f in enumerate(two[k], 1)], "query_id long, fact_id long, rank int")
    found = recall.merged(table(0), table(1), 6, 2).collect()
    for q, (a, b) in lists.items():
        assert [r.fact_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == plain_merge(a, b, 6, 2)


def test_the_cascade_recalls_words_context_and_named_speakers(spark):
    rng = random.Random(8)
    rows = [(s * 100 + t, f"s{s}", t, rng.choice(["ann", "bob"]), " ".join(rng.choice("rain tea boat road lamp fish song".split()) for _ in range(5))) for s in range(6) for t in range(8)]
    rows[10] = (*rows[10][:4], "the zebra crossed quietly")
    rows[20] = (*rows[20][:4], None)
    turns = spark.createDataFrame(rows, "fact_id long, session_id string, sequence long, role string, text string")
    asked = spark.createDataFrame([(1, "zebra"), (2, "what did ann say of tea and rain"), (3, "unheard")], "query_id long, text string")
    found = {}
    for r in sorted(recall.cascade(turns, asked).collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.fact_id)
    assert set(found) == {1, 2} and all(len(x) == len(set(x)) <= 16 for x in found.values())
    at = rows[10][0]
    assert found[1][0] == at and {at - 1, at + 1} <= set(found[1][:3])
    speakers = {r[0]: r[3] for r in rows}
    assert sum(speakers[f] == "ann" for f in found[2]) >= 8
    assert recall.cascade(turns.limit(0), asked).count() == 0
