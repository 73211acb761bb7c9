"""HTML extraction by site style trees.

The pages of a host are merged into one tree: its nodes are paths of elements, named by tag and first class, and under each
node stand the ways in which pages present it (the sequence of child elements) and the contents of its blocks. A node's importance
comes from entropy over the m pages that have it:

    presentation  -sum p_i log_m p_i over the presentations: 1 if every page differs, 0 if all agree; 1 if m = 1
    content       1 - the mean of H(a) over the node's contents a, H(a) = log_m of the pages that hold a: text that one page has
                  is important, text that all pages repeat is not
    branch        (1 - g**d) presentation + g**d mean content of the blocks at or below, d the levels below, g = 0.9

A branch is noise if it and all branches below are under the threshold on enough pages; its text is removed from each page of the
host, wherever it stands. So is a single content that most pages of a large host repeat (H(a) >= REPEATED), although the node's other
contents vary. What is left decides the main text: that inside `article` or `main` where any is left there, else all of it. So an
`article` that a site repeats as a teaser goes and the text beside it stays. Entropy only divides a page's text: a page that it would
leave empty is taken without it (a site whose pages all have one article keeps the article).

What names itself as something else goes first: navigation, headers, footers, sidebars, notices, adverts, forms, comments and the like are
removed by tag, role, class and id. Statistics cannot stand in for names: a host of few pages has none, and adverts that are
dealt at random differ from page to page as articles do.

Parsing follows the HTML rules that matter for text: raw text elements, comments, quoted attributes, omitted and stray end tags, nesting of
any depth. Each page is parsed once; its blocks are written to the shared folder, from where the tree is counted and the text is put together.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import materialize
from attestra.llm.url_cascade import host_and_path

GAMMA, THRESHOLD, LEAST_PAGES = 0.9, 0.2, 8
#: From this many pages on, a content held by pages ** REPEATED of them is noise by itself.
MANY_PAGES, REPEATED = 30, 0.93
#: Levels that a path spells out; the labels below are one digest, so that deep nesting keeps paths short and nodes apart.
SPELLED = 64

TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>|[!?/][^>]*+(?:>|\Z)|/?[a-zA-Z].*\Z)""", re.S)
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
#: Fixed values of the HTML standard: elements without content, with raw text, that end an open paragraph, that make blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
BLOCK = ENDS_P | frozenset("li dt dd tr td th caption thead tbody tfoot br body html option summary".split())
#: Elements that an element of the same group ends when its end tag is omitted.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol menu dl table article section div main body html nav aside footer header form".split())
CELLS, CELL_SCOPES = frozenset({"tr", "td", "th"}), frozenset({"table", "body", "html"})
#: What names itself as other than main text.
BOILER_TAGS = frozenset("head nav header footer aside form menu button select dialog script style textarea title noscript template iframe noembed noframes xmp svg math object canvas audio video search".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar side aside widget related recommended"
    " notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login paywall share sharing social comment comments disqus reply replies respond discussion form search pagination pager copyright legal disclaimer skip".split()
)
#: What may stand beside such a word in a class or id.
PLAIN_WORDS = frozenset(
    "area bar block body bottom box buttons center col column container content desktop entry fixed footer global group holder inner item items layer left link links list main mobile module outer page panel post posts article articles primary reader right row secondary section site slot small text title top unit user wrap wrapper x".split()
)
WORDS = re.compile(r"[a-z]+")
MAIN_TAGS = frozenset({"article", "main"})
#: Elements whose id is a place to link to, not a name for a region.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure figcaption td th tr caption br hr hgroup".split())


def _digest(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 3)).view(np.int64))


def _short(name: str) -> str:
    return name.replace("/", "|") if len(name) <= 40 else f"#{_digest(name) & (1 << 64) - 1:x}"


class Page:
    """One parsed page: blocks of text with their paths, and each path's child sequences."""

    __slots__ = ("blocks", "children", "_open", "_places", "_scopes", "_cell_scopes", "_text", "_where")

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, str, bool, bool]] = []  # path, text, inside main, inside boilerplate
        self.children: dict[str, list[str]] = {"": []}
        # an open element: tag, path, inside main, inside boilerplate, (depth, digest) of a path
        self._open: list[tuple[str, str, bool, bool, int, int]] = [("", "", False, False, 0, 0)]
        #: Where elements of a name are open, and where scopes are: every end tag finds its element in one step.
        self._places: dict[str, list[int]] = {}
        self._scopes: list[int] = []
        self._cell_scopes: list[int] = []
        self._text: list[str] = []
        self._where = self._open[0]
        at, n = 0, len(source)
        while at < n:
            m = TAG.search(source, at)
            stop = m.start() if m else n
            if stop > at:
                self._say(html.unescape(source[at:stop]))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                if name == "br":
                    self._say(" ")
                elif places := self._places.get(name):
                    if name in SCOPES or places[-1] > (self._scopes[-1] if self._scopes else 0):
                        self._close(places[-1])
                continue
            if name in ENDS_P:
                self._end(("p",), self._scopes)
            elif name in CELLS:
                self._end(SIBLINGS[name], self._cell_scopes)
            elif name in SIBLINGS:
                self._end(SIBLINGS[name], self._scopes)
            if name in BLOCK:
                self._flush()
            if name == "br" or name in VOID:
                if name in ("br", "hr", "img"):
                    self._say(" ")
                continue
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = end.end() if end else n
                continue
            label, boiler, main = self._named(name, m[3])
            _, path, in_main, in_boiler, depth, digest = self._open[-1]
            if name in BLOCK:
                self.children.setdefault(path, []).append(label)
            if m[3].rstrip().endswith("/") and name not in BLOCK:
                continue
            if name in BLOCK or boiler:
                path, depth, digest = self._below(path, depth, digest, label)
                self.children.setdefault(path, [])
            if boiler and name not in BLOCK:
                self._flush()
            where = len(self._open)
            self._open.append((name, path, in_main or main, in_boiler or boiler, depth, digest))
            self._places.setdefault(name, []).append(where)
            if name in SCOPES:
                self._scopes.append(where)
            if name in CELL_SCOPES:
                self._cell_scopes.append(where)
        self._flush()

    def _say(self, text: str) -> None:
        if not self._text:
            self._where = self._open[-1]
        self._text.append(text)

    def _flush(self) -> None:
        joined = " ".join("".join(self._text).split())
        if joined:
            self.blocks.append((self._where[1], joined, self._where[2], self._where[3]))
        self._text.clear()

    def _close(self, down_to: int) -> None:
        while len(self._open) > down_to:
            name = self._open[-1][0]
            if name in BLOCK:
                self._flush()
            self._open.pop()
            self._places[name].pop()
            if name in SCOPES:
                self._scopes.pop()
            if name in CELL_SCOPES:
                self._cell_scopes.pop()

    def _end(self, names: Iterable[str], scopes: list[int]) -> None:
        """Closes the innermost open element of such a name inside the innermost scope."""
        found = max((self._places[x][-1] for x in names if self._places.get(x)), default=0)
        if found > (scopes[-1] if scopes else 0):
            self._close(found)

    @staticmethod
    def _below(path: str, depth: int, digest: int, label: str) -> tuple[str, int, int]:
        if depth < SPELLED:
            return f"{path}/{label}", depth + 1, 0
        deeper = _digest(f"{digest}/{label}")
        return f"{path.rpartition('/')[0] if depth > SPELLED else path}/#{deeper & (1 << 64) - 1:x}", depth + 1, deeper

    @staticmethod
    def _named(name: str, attributes: str) -> tuple[str, bool, bool]:
        """(label, is boilerplate, is main text)"""
        found: dict[str, str] = {}
        for a, x, y, z in ATTRIBUTE.findall(attributes) if attributes and not attributes.isspace() else ():
            found.setdefault(a.lower(), (x or y or z).lower())
        classes = found.get("class", "").split()
        label = _short(f"{name}.{classes[0]}" if classes else name)
        role = found.get("role", "")
        main = name in MAIN_TAGS or role in MAIN_TAGS or found.get("itemprop") == "articlebody"
        boiler = name in BOILER_TAGS or role in BOILER_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
        if not boiler and name not in ("html", "body", "main"):
            boiler = any(map(_names_boilerplate, classes if name in TEXT_TAGS else [*classes, *found.get("id", "").split()]))
        return label, boiler, main


def _names_boilerplate(name: str) -> bool:
    """A class or id that has a word for boilerplate and else only plain words, as in `sidebar-box`; `related-work` has not."""
    words = set(WORDS.findall(name))
    return bool(words & BOILER_WORDS) and words <= BOILER_WORDS | PLAIN_WORDS


def host_of(url: Column) -> Column:
    return F.coalesce(host_and_path(url)[0], F.lit(""))


BLOCK_ROW = pa.struct([("path", pa.string()), ("text", pa.string()), ("main", pa.bool_()), ("feature", pa.int64())])
SHOWN_ROW = pa.struct([("path", pa.string()), ("content", pa.bool_()), ("feature", pa.int64())])


def _lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """One list of structs for each page."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    columns = list(zip(*(x for r in rows for x in r), strict=True)) or [()] * kind.num_fields
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind)))


def parsed(pages: DataFrame, key: str, url: str, source: str) -> DataFrame:
    """(rid, k, u, host, blocks, shown) of every page, written to the shared folder. blocks: the text blocks that do not name
    themselves as boilerplate, in page order; shown: what the page adds to its host's tree, each content and presentation once."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                blocks, shown = [], []
                for h in part.column(3).to_pylist():
                    page = Page(h or "")
                    hashed = [(path, text, main, boiler, _digest(text)) for path, text, main, boiler in page.blocks]
                    blocks.append([(path, text, main, f) for path, text, main, boiler, f in hashed if not boiler])
                    contents = {(path, True, f): None for path, _, _, _, f in hashed}
                    shown.append([*contents, *((path, False, _digest(">".join(kinds))) for path, kinds in page.children.items())])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), _lists(blocks, BLOCK_ROW), _lists(shown, SHOWN_ROW)], names=["k", "u", "host", "blocks", "shown"])

    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), host_of(F.col(url)).alias("host"), F.col(source).alias("h"))
    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    schema = f"k {kinds[0]}, u {kinds[1]}, host string, blocks array<struct<path:string,text:string,main:boolean,feature:bigint>>, shown array<struct<path:string,content:boolean,feature:bigint>>"
    return materialize(rows.mapInArrow(over, schema).withColumn("rid", F.monotonically_increasing_id()), "parsed")


def _seen(known: DataFrame) -> DataFrame:
    """(host, path, content, feature, c): the pages of a host that show a feature. Partial counts are made where the pages are read,
    so a host with a large share of all pages meets in no task."""
    return known.select("host", F.explode("shown").alias("s")).groupBy("host", F.col("s.path").alias("path"), F.col("s.content").alias("content"), F.col("s.feature").alias("feature")).agg(F.count("*").alias("c"))


def _tree(seen: DataFrame) -> DataFrame:
    nodes = seen.groupBy("host", "path").agg(
        F.sum(F.when(F.col("content"), F.log("c"))).alias("logs"),
        F.count(F.when(F.col("content"), 1)).alias("contents"),
        F.sum(F.when(~F.col("content"), F.col("c"))).alias("pages"),
        F.sum(F.when(~F.col("content"), F.col("c") * F.log("c"))).alias("style_logs"),
    )
    m = F.log("pages")  # every page shows each of its nodes in one way
    nodes = nodes.withColumn("presentation", F.when(F.col("pages") > 1, (m - F.col("style_logs") / F.col("pages")) / m).otherwise(1.0))
    nodes = nodes.withColumn("content", F.when(F.col("contents") > 0, F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), 1 - F.col("logs") / F.col("contents") / m)).otherwise(1.0)))
    nodes = materialize(nodes.select("host", "path", "pages", "presentation", "content", "contents"), "nodes")
    # every node's contents count for all branches above it; the tree has a row a node, however many pages were merged
    steps = F.split("path", "/")
    above = nodes.filter("contents > 0").select("host", F.posexplode(steps).alias("i", "step"), steps.alias("steps"), "content", "contents")
    above = above.select("host", F.array_join(F.slice("steps", 1, F.col("i") + 1), "/").alias("path"), (F.size("steps") - 1 - F.col("i")).alias("d"), "content", "contents")
    below = above.groupBy("host", "path").agg((F.sum(F.col("content") * F.col("contents")) / F.sum("contents")).alias("mean"), F.max("d").alias("depth"))
    weight = F.pow(F.lit(GAMMA), F.col("depth"))
    scored = nodes.join(below, ["host", "path"])
    scored = materialize(scored.select("host", "path", "pages", "presentation", "content", ((1 - weight) * F.col("presentation") + weight * F.col("mean")).alias("importance")), "scored")
    # a branch is as good as the best one in it
    best = scored.select("host", F.posexplode(steps).alias("i", "step"), steps.alias("steps"), "importance")
    best = best.groupBy("host", F.array_join(F.slice("steps", 1, F.col("i") + 1), "/").alias("path")).agg(F.max("importance").alias("best"))
    return scored.join(best, ["host", "path"])


def style_tree(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(host, path, pages, presentation, content, importance, best) of every node of every host's merged tree that has text at or
    below it; best: the greatest importance of the node and all below. A table without pages has no nodes."""
    return _tree(_seen(parsed(pages, key, url, source)))


def _mark(*columns: str) -> Column:
    return F.xxhash64(*columns)


def noise(seen: DataFrame, threshold: float, least_pages: int) -> DataFrame:
    """(mark): of every content node that is noise the digest of host and path, and of every repeated content that of host, path and feature."""
    tree = materialize(_tree(seen), "tree")
    nodes = tree.filter((F.col("best") < threshold) & (F.col("pages") >= least_pages) & F.col("content").isNotNull() & (F.col("path") != ""))
    of = tree.filter(F.col("pages") >= MANY_PAGES).select("host", "path", "pages")
    often = seen.filter("content AND c > 1").join(of, ["host", "path"]).filter((F.log("c") >= REPEATED * F.log("pages")) & F.lit(threshold >= 0))
    return materialize(nodes.select(_mark("host", "path").alias("mark")).union(often.select(_mark("host", "path", "feature").alias("mark"))), "noise")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(key, url, text) for every row of pages. Null and empty pages have empty text; urls without `://` share the empty host;
    repeated rows repeat (and count as pages of their host); a page of any length or nesting is one value; further columns are not read,
    whatever their names; an empty table gives no rows. A negative threshold switches the tree off.

    Noise is found by digest among each page's own blocks: the table of noise is as small as the trees, and what comes back to a
    page names its blocks only. Both are written first, so that Spark broadcasts them only if their files are small.
    """
    known = parsed(pages, key, url, source)
    marks = noise(materialize(_seen(known), "seen"), threshold, least_pages)
    each = known.select("rid", "host", F.explode("blocks").alias("b"))
    each = each.select("rid", F.explode(F.array(_mark("host", "b.path"), _mark("host", "b.path", "b.feature"))).alias("mark"))
    hit = materialize(each.join(marks.distinct(), "mark").groupBy("rid").agg(F.collect_set("mark").alias("marks")), "hit")
    rows = known.join(hit, "rid", "left")
    held = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("marks", _mark("host", b["path"])) | F.array_contains("marks", _mark("host", b["path"], b["feature"])), F.lit(False)))
    rows = rows.withColumn("held", F.when(F.col("marks").isNull(), F.col("blocks")).otherwise(held))
    rows = rows.withColumn("held", F.when(F.size("held") > 0, F.col("held")).otherwise(F.col("blocks")))
    inside = F.filter("held", lambda b: b["main"])
    texts = F.transform(F.when(F.exists("held", lambda b: b["main"]), inside).otherwise(F.col("held")), lambda b: b["text"])
    return rows.select(F.col("k").alias(key), F.col("u").alias(url), F.array_join(texts, " ").alias("text"))


#: The same rows in DuckDB, for pages whose main text is one `article` of paragraphs and headings with inline marks: its blocks, the importance
#: of a host's headings and paragraphs, and the contents that a host repeats.
SQL = r"""
WITH a AS (SELECT row_number() OVER () AS rid, page_id, url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '(?s)<!--.*?-->', '', 'g') AS t FROM pages),
b AS (SELECT rid, host, regexp_replace(regexp_replace(regexp_replace(t, '<h1[^>]*>', chr(1), 'g'), '</?(?:p|h[1-6]|br|div|ul|li)(?:\s[^>]*)?>', chr(2), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT rid, host, unnest(list_zip(l, range(len(l)))) AS piece FROM (SELECT rid, host, regexp_extract_all(t, '[\x01\x02][^\x01\x02]*') AS l FROM b)),
d AS (SELECT rid, host, piece[2] AS pos, starts_with(piece[1], chr(1)) AS heading,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substr(piece[1], 2), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM c),
e AS (SELECT * FROM d WHERE text <> ''),
m AS (SELECT host, heading, count(DISTINCT rid) AS pages FROM d GROUP BY ALL),
f AS (SELECT host, heading, text, count(DISTINCT rid) AS n FROM e GROUP BY ALL),
i AS (SELECT host, heading, any_value(pages) AS pages, CASE WHEN any_value(pages) > 1 THEN greatest(0, 1 - avg(ln(n)) / ln(any_value(pages))) ELSE 1 END AS importance FROM f JOIN m USING (host, heading) GROUP BY ALL),
g AS (SELECT e.*, importance < 0.2 AND pages >= 8 OR pages >= 30 AND ln(n) >= 0.93 * ln(pages) AS noise FROM e JOIN i USING (host, heading) JOIN f USING (host, heading, text)),
h AS (SELECT rid, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE NOT noise), string_agg(text, ' ' ORDER BY pos)) AS text FROM g GROUP BY rid)
SELECT page_id, url, coalesce(text, '') AS text, coalesce(length(text), 0)::BIGINT AS n_chars FROM a LEFT JOIN h USING (rid)
"""
