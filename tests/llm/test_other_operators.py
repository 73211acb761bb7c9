"""URL filters, HTML extraction, quality rules, chat formatting and sharding against SQL, brute force and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import chat_events, html_style_tree, quality_repetition, queries, rendezvous, url_cascade
from tests.same import connect, rows

EDGES = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, " \n\t "), (None, "no id here"), (5, "word " * 30000), (6, "a" * 50000)]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, folder, name):
    found = queries.queries()[name](spark, folder).toPandas()
    said = connect(folder).execute(queries.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(said.columns)
    assert rows(found) == rows(said)


# --- urls --------------------------------------------------------------------------------------------------------


def test_a_cascade_is_exact_over_its_universe(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 20000, dtype=np.int64)
    table = lambda x: spark.createDataFrame([(int(v),) for v in x], "h long")
    cascade = url_cascade.build(table(keys[:700]), table(keys), 200)  # so few urls that level 1 lets many through
    assert len(cascade.levels) > 2
    assert (cascade.holds(keys) == (np.arange(20000) < 700)).all()
    assert not url_cascade.build(table([]), table(keys[:10]), 10).holds(keys[:10]).any()
    assert url_cascade.build(table(keys[:9]), table([]), 0).holds(keys[:9]).all()


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?y", "x://example.org", "ftp://b.example.org/en/12#z", "http://notexample.org/en/1", "http://com/de/", "a://b://org/q", "http://x.com?/de/", "http://org/ü"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.filter_urls(df, queries.RULES).collect()}
    assert [found[i] for i in range(4)] == [("", "", None, "allow")] * 4
    assert found[4] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert found[5] == ("example.org", "", None, "allow")
    assert found[6] == ("b.example.org", "/en/12", "example.org/en/1", "block")
    assert found[7] == ("notexample.org", "/en/1", "org/", "allow")
    assert found[8] == ("com", "/de/", "com/de/", "block")
    assert found[9] == ("b:", "//org/q", None, "allow")
    assert found[10] == ("x.com", "", None, "allow")
    assert found[11] == ("org", "/ü", "org/", "allow")
    assert url_cascade.filter_urls(df.limit(0), queries.RULES).count() == 0
    assert url_cascade.filter_urls(df, [], []).filter("verdict = 'allow'").count() == len(urls)


def test_a_long_list_is_judged_part_by_part(spark):
    """A block list of every third host and path of the corpus, in filters of at most 200 bytes a level, against plain Python."""
    rng = random.Random(3)
    urls = [f"http://{rng.choice('abc')}{i % 400}.site{i % 37}.example/{rng.choice('xyz')}/{i % 11}?q={i}" for i in range(3000)] + [None, "no scheme", "http://" + "a" * 5000 + ".example/" + "p" * 50000]
    df = spark.createDataFrame([(i, u, "x", 1, "y") for i, u in enumerate(urls)], "page_id long, url string, fits string, h int, key string")
    keys = sorted({u.split("://")[1].split("?")[0] for u in urls[:3000:3]}) + ["site5.example/", "site6.example/x/1"]
    rules = ["allow site5.example/z/", "block site7.example/x/"]
    parsed = [url_cascade.parse_rule(r) for r in rules]

    def plain(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host, path = rest.split("?")[0].split("/")[0], "".join(rest.split("?")[0].partition("/")[1:])
        fits = lambda k: ("." + host).endswith("." + k.split("/")[0]) and path.startswith(k[k.index("/") :])
        named = max((r for r in parsed if fits(r.key)), key=lambda r: len(r.key), default=None)
        return (named.key, named.verdict) if named else (None, "block" if any(map(fits, keys)) else "allow")

    table = spark.createDataFrame([(k,) for k in keys * 2], "key string")
    for options in ({"max_bytes": 200}, {}):
        found = {r.page_id: (r.rule, r.verdict) for r in url_cascade.filter_urls(df, rules, table, **options).collect()}
        assert found == {i: plain(u) for i, u in enumerate(urls)}
    assert {v for _, v in found.values()} == {"allow", "block"} and len({r for r, _ in found.values()}) == 3


# --- html --------------------------------------------------------------------------------------------------------


def main_text(source):
    """By parsing alone, without a tree."""
    blocks = [(text, main) for _, text, main, boiler in html_style_tree.Page(source).blocks if not boiler]
    return " ".join(text for text, main in blocks if main or not any(m for _, m in blocks))


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("plain <b>t</b>ext", "plain text"),
        ("<p>a<p>b<!-- <p>c --> d", "a b d"),
        ("<nav>x</nav><article><h1>T</h1><p>1 &lt; 2 &amp;amp; &#65;&nbsp;b<br>c <b>d</b>e</article><footer>f</footer>", "T 1 < 2 &amp; A b c de"),
        ("<article>1 < 2 <p title='a>b'>x</article>", "1 < 2 x"),
        ("<article><p>a</p><section class='comments'><article class=comment><p>b</p></article></section></article>", "a"),
        ("<div class='notice'>n</div><main><ul><li>1<li>2</ul><form>f</form><script>var a='</p>';</script><style>p{}</style></main>", "1 2"),
        ("<div class='has-sidebar'><p>kept</p><div class='sidebar'>s</div><aside>a</aside></div>", "kept"),
        ("<article><p>cut off <b>here", "cut off here"),
        ("<article><p>a</p><!-- open", "a"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"),
        ("<article><table><tr><td>1<table><tr><td>2</table>3<td>4</table></article>", "1 2 3 4"),
        ("<article><p data-id='footer'>a</p><p title='a hidden gem'>b</p><p style='x hidden '>c</p></article>", "a b c"),
        ("<article><figure class='related-work'>a</figure><p id=legal>b</p><div class='related-posts'>x</div><div id=comments>y</div></article>", "a b"),
        ("<div>" * 3000 + "<article>start <span>" + "<span>" * 1200 + " middle <p>more</p> end</article>", "start middle more end"),
        ("<b>" + "<div>" * 3000 + "<p>a</b></b></b>b</p>", "ab"),
    ],
)
def test_main_text(source, text):
    assert main_text(source) == text


def test_pages_give_their_whole_article(spark, folder):
    import html
    import re

    for r in queries.op3_style_tree(spark, folder).join(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = re.split(r"(<[^>]*>)", re.sub(r"<!--.*?-->", "", inside, flags=re.S))
        plain = "".join((" " if re.match(r"</?(p|h\d|br)\b", x) else "") if x.startswith("<") else html.unescape(x) for x in parts)
        assert r.text == " ".join(plain.split()) and r.n_chars == len(r.text)


def pages_of(spark, sources, host="h.example"):
    return spark.createDataFrame([(i, f"http://{host}/{i}", h, "a", 1) for i, h in enumerate(sources)], "page_id long, url string, html string, path string, rid int")


def texts(df, **options):
    return {r.page_id: r.text for r in html_style_tree.extract(df, **options).collect()}


def test_what_a_site_repeats_goes_and_what_it_varies_stays(spark):
    df = pages_of(spark, [f"<div class=x1>Same line on all pages</div><div class=x2><p>story {i} tells {i * 7}</p></div>" for i in range(20)])
    assert set(texts(df).values()) == {f"story {i} tells {i * 7}" for i in range(20)}
    tree = {r.path: r for r in html_style_tree.style_tree(df).collect()}
    assert tree["/div.x1"].importance == pytest.approx(0.0) and tree["/div.x2/p"].importance == pytest.approx(1.0)
    assert (tree["/div.x1"].pages, tree["/div.x2"].best) == (20, pytest.approx(1.0))
    assert set(texts(df, threshold=-1.0).values()) == {f"Same line on all pages story {i} tells {i * 7}" for i in range(20)}
    assert texts(df.filter("page_id < 3"))[0].startswith("Same line")


def test_the_tree_decides_inside_articles_too(spark):
    # a line that stands under its own node, one among the paragraphs, and an article that is a teaser
    inside = pages_of(spark, [f"<article><h1>T {i}</h1><div class=q>Read our terms</div><p>All rights kept.</p><p>story {i}</p></article>" for i in range(40)])
    assert texts(inside) == {i: f"T {i} story {i}" for i in range(40)}
    assert texts(inside, threshold=-1.0)[3] == "T 3 Read our terms All rights kept. story 3"
    teaser = pages_of(spark, [f"<article><p>Ten things to buy</p></article><div class=z><p>news {i}</p></div>" for i in range(12)])
    assert texts(teaser) == {i: f"news {i}" for i in range(12)}
    assert set(texts(teaser, threshold=-1.0).values()) == {"Ten things to buy"}


def test_the_tree_leaves_no_page_empty_and_counts_hosts_apart(spark):
    same = pages_of(spark, ["<article><p>one article</p></article>"] * 12)
    other = pages_of(spark, [f"<article><p>one article</p><p>and {i}</p></article>" for i in range(5)], "other.example")
    found = html_style_tree.extract(same.union(other)).collect()
    assert sorted(r.text for r in found) == sorted(["one article"] * 12 + [f"one article and {i}" for i in range(5)])
    # hosts are lower-cased for A-Z alone, and urls without :// have the empty one
    mixed = spark.createDataFrame([(i, u, f"<div class=a>same</div><p>{i}</p>") for i in range(8) for u in ("http://A.example/x", "http://a.EXAMPLE?y")], "page_id long, url string, html string")
    assert {r.text for r in html_style_tree.extract(mixed).collect()} == set(map(str, range(8)))


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "http://a", ""), (2, "http://a", ""), (3, "b", "<p>" + "word " * 50000), (4, "c", "<div>" * 20000 + "deep"), (5, "c", "<p>a</p>" * 30000)], "page_id long, url string, html string")
    found = [(r.page_id, len(r.text)) for r in html_style_tree.extract(df).collect()]
    assert sorted(found) == [(1, 0), (2, 0), (2, 0), (3, 249999), (4, 4), (5, 59999)]
    assert html_style_tree.extract(df.limit(0)).count() == 0


# --- quality -----------------------------------------------------------------------------------------------------


def brute_shares(text):
    words = (text or "").encode().split()
    chars = sum(len(w.decode()) for w in words)
    out = {}
    for n in quality_repetition.NGRAM_LIMITS:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(n)}
        out[n] = sum(len(words[i].decode()) for i in inside) / chars if chars else 0.0
    return out


def test_coverage_matches_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        text = " ".join(rng.choice(["a", "bé", "ccc", "dd", "x#"]) for _ in range(rng.randrange(90)))
        found = quality_repetition.measure(text.encode())
        assert {n: found[f"dup_{n}gram_share"] for n in quality_repetition.NGRAM_LIMITS} == pytest.approx(brute_shares(text))


def test_repetition_is_rejected_and_prose_kept():
    rng = random.Random(7)
    prose = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200))
    assert quality_repetition.measure(prose.encode())["kept"]
    assert not quality_repetition.measure((prose + "\n" + prose).encode())["kept"]
    lines = "\n".join([prose] + ["buy now and save big"] * 40)
    assert not quality_repetition.measure(lines.encode())["kept"]


def test_quality_edges(docs):
    found = quality_repetition.judge(docs(EDGES)).collect()
    assert len(found) == len(EDGES) and not any(r.kept for r in found)
    assert {r.doc_id: r.n_words for r in found}[5] == 30000
    assert quality_repetition.judge(docs([])).count() == 0


# --- chat --------------------------------------------------------------------------------------------------------

PARTS = ["[INST]", "[/INST]", "<s>", "</s>", "\\", "\\\\", "]", "[TURN ", "a", "é", "\n", "[SYS]", "[/TURN]", "[", "<"]


def test_renderings_are_read_back_exactly():
    rng = random.Random(8)
    for _ in range(3000):
        said = [(rng.choice(["user", "assistant", "system", "", "tool", "a]b\\"]), "".join(rng.choice(PARTS) for _ in range(rng.randrange(7)))) for _ in range(rng.randrange(4))]
        formatted, mask = chat_events.render(said)
        assert chat_events.read(formatted) == said
        assert [chat_events._until(formatted[a:b] + "</s>", 0, "</s>")[0] for a, b in mask] == [t for r, t in said if r == "assistant"]
    slashes = "\\" * 100000
    assert chat_events.read(chat_events.render([("user", slashes + "x" + slashes)])[0]) == [("user", slashes + "x" + slashes)]


def test_events_fold_into_final_messages(spark):
    log = [
        ("c", 1, "message", "m1", "user", "hi"), ("c", 2, "open", "m2", "assistant", None), ("c", 3, "delta", "m2", None, "wro"), ("c", 4, "delta", "m2", None, "ng"),
        ("c", 5, "message", "m3", "user", "no"), ("c", 6, "regenerate", "m2", None, None), ("c", 7, "delta", "m2", None, "ri"), ("c", 8, "delta", "m2", None, "ght"),
        ("c", 9, "edit", "m1", None, "hello"), ("c", 10, "message", "m4", "user", "x"), ("c", 11, "delete", "m4", None, None), ("d", 1, "message", None, None, None), (None, 1, "message", None, "user", "q"),
    ]
    rng = random.Random(9)
    rng.shuffle(log)
    events = spark.createDataFrame(log, "conversation string, seq long, kind string, message string, role string, text string").repartition(3)
    found = {r.conversation: chat_events.read(r.formatted) for r in chat_events.reconstruct(events).collect()}
    assert found == {"c": [("user", "hello"), ("assistant", "right")], "d": [("", "")], None: [("user", "q")]}
    assert chat_events.reconstruct(events.limit(0)).count() == 0


def test_a_streamed_log_folds_back_into_its_turns(spark):
    rng = random.Random(10)
    said = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "a b", "é</s>", "x" * 50])) for c in (1, 2, None) for t in range(40)]
    said += [(1, 7, "user", "twice")] * 2 + [(3, 0, "assistant", "y" * 500_000)] + [(4, t, "user", f"hot {t}") for t in range(5000)]
    rng.shuffle(said)
    df = spark.createDataFrame([(*r, "k", 1) for r in said], "conv_id long, turn long, role string, text string, message string, at int").repartition(5)
    log = chat_events.streamed_log(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "open", "delta", "edit", "regenerate", "delete"}
    plain = {}
    for c, t, r, x in said:
        plain.setdefault(c, []).append((t, r or "", x or ""))
    plain = {c: [(r, x) for _, r, x in sorted(rows_)] for c, rows_ in plain.items()}
    for events, parted in ((log, True), (log.repartition(3), False)):
        assert {r.conversation: chat_events.read(r.formatted) for r in chat_events.reconstruct(events, parted).collect()} == plain
    assert chat_events.reconstruct(chat_events.streamed_log(df.limit(0)), True).count() == 0


def test_chat_query_plants_its_conversation(spark, folder):
    r = queries.op9_chat(spark, folder).filter("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


# --- sharding ----------------------------------------------------------------------------------------------------


def test_more_shards_take_rows_only_into_themselves(spark):
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(3000)], "doc_id long, text string")
    five = {r.doc_id: r for r in rendezvous.shard_rows(df, (1.0,) * 5).collect()}
    six = {r.doc_id: r.shard for r in rendezvous.shard_rows(df, (1.0,) * 6).collect()}
    assert all(six[i] == r.grown_shard and (six[i] == r.shard or six[i] == 5) for i, r in five.items())
    assert 350 < sum(s == 5 for s in six.values()) < 650
    heavy = [r.shard for r in rendezvous.shard_rows(df, (1.0, 3.0)).collect()]
    assert 0.70 < np.mean(heavy) < 0.80


def test_slots_are_gapless_by_key_whatever_repeats(spark):
    rows_ = [(7, "same")] * 400 + [(i, "t") for i in range(300)] + [(None, None), (None, "x")]
    df = spark.createDataFrame([(i, t, 1, "a") for i, t in rows_], "doc_id long, text string, k int, shard string").repartition(5)
    found = rendezvous.shard_rows(df, (1.0,) * 4).collect()
    assert len(found) == len(rows_)
    for s in range(4):
        own = sorted((r for r in found if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [r.doc_id if r.doc_id is not None else -1 for r in own]
        assert keys == sorted(keys)
    assert all(r.size == len((r.doc_id == 7 and "same" or "t").encode()) + 16 for r in found if r.doc_id not in (None, 7))
    assert {r.text_crc32 for r in found if r.size == 16} == {0} and zlib.crc32(b"same") in {r.text_crc32 for r in found}
    assert rendezvous.shard_rows(df.limit(0), (1.0,) * 4).count() == 0
    with pytest.raises(ValueError):
        rendezvous.shard_rows(df, ())


def test_very_long_texts_are_measured_whole(spark):
    df = spark.createDataFrame([(1, "é" * 3_000_000), (2, "b")], "doc_id long, text string")
    found = {r.doc_id: r for r in rendezvous.shard_rows(df, (1.0,) * 3).collect()}
    assert found[1].size == 6_000_016 and found[1].text_crc32 == zlib.crc32(("é" * 3_000_000).encode())


def test_sharding_runs_no_python_on_rows(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert "Python" not in rendezvous.shard_rows(df, (1.0, 1.0))._jdf.queryExecution().toString()
    assert df.select(F.lit(1)).count() == 1
