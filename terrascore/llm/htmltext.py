"""Main-text extraction: boosted trees over DOM nodes, decoded by the tree.

Each block element is a node with features of its subtree (text and link
density, shares of paragraphs and list items), its attribute tokens and tag,
those of its ancestors, its depth, place and siblings.  Gradient-boosted
trees (Spark ML) give the log odds that a node holds main text.  Decoding
picks the best set of kept nodes in which every kept node's parent is kept,
so a dropped ancestor never has a kept descendant.

Training pages are drawn by a hash of page_id (``FIT_PAGES``) from those
that have an article or main element, or are generated if none has.  Their own
semantic elements give first labels; each page's pieces are also laid out
again in other markup (plain divisions, side columns, notices, comments,
forms), with the labels known from the layout, so that the trees learn from
structure and words of attributes and not from one element's name.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascore.session import materialize

#: pages, at most, that the trees are fitted on
FIT_PAGES = 160
LAYOUTS = 2
ROUNDS, DEPTH = 14, 4
MARK = "\ue000"  # stands before main text in training pages
PAGES_AT_ONCE = 200

BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
             "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul "
             "option select button textarea".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"option", "select", "button", "textarea"}
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
MAIN_TAGS = {"article", "main"}
SIDE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "textarea", "fieldset", "legend"}
MAIN_WORDS = set("article body content entry main page post story text read prose".split())
SIDE_WORDS = set("ad ads advert advertisement alert author avatar banner bar bottom breadcrumb breadcrumbs byline comment comments consent cookie "
                 "cookies copyright cta discussion disqus feedback foot footer form head header login masthead menu meta modal nav navbar navigation "
                 "newsletter notice notification outbrain overlay pager pagination popular popup promo promotion promoted recommended related reply "
                 "replies respond response search share sharing side sidebar signup skip social sponsor sponsored subscribe tags toolbar top "
                 "trending widget".split())
TAG = re.compile(r"<!--.*?(?:-->|$)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|$)|"
                 r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S | re.I)
#: elements whose text is none of the page's, with what ends them; one that nothing ends is read on as text
_BLOCK = rf"(?=</?(?:{'|'.join(sorted(BLOCKS))}|head|link|meta|base|script|style)[\s/>])"
END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("noscript", "template", "iframe")}
END |= {name: re.compile(rf"</{name}\s*>|{_BLOCK}", re.I) for name in ("svg", "title")}  # title: in the head
#: any other element, or text, ends the head
IN_HEAD = set("base basefont bgsound link meta noscript script style template title".split())
TOKENS = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
COLUMNS = ["parent", "depth", "chars", "words", "link", "stops", "main_words", "side_words", "kind", "inputs", "label"]
KINDS = {"main": 1, "side": 2, "heading": 3, "p": 4, "list": 5, "box": 6, "root": 7, "table": 8, "run": 9}
N_FEATURES = 34


def _kind(tag: str) -> int:
    if tag in MAIN_TAGS:
        return 1
    if tag in SIDE_TAGS:
        return 2
    if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
        return 3
    return {"p": 4, "blockquote": 4, "pre": 4, "ul": 5, "ol": 5, "li": 5, "div": 6, "section": 6, "body": 7, "html": 7,
            "table": 8, "tr": 8, "td": 8, "th": 8, "#run": 9}.get(tag, 0)


def parse(page: str | None, mark: str | None = None) -> tuple[list[list], list[tuple[int, str]]]:
    """A page -> nodes in document order (values of COLUMNS) and its text
    runs in page order as (node, text).  In training pages ``mark`` stands
    before main text and is no text; any other page is read as it is."""
    nodes: list[list] = [[-1, 0, 0, 0, 0, 0, 0, 0, 7, 0, 0]]
    names = ["html"]
    stack, inline = [0], []  # open blocks; open inline elements as (name, blocks open)
    runs: list[tuple[int, str]] = []
    piece: list[str] = []
    links, link_chars = 0, 0

    def end_run():
        nonlocal link_chars
        if piece:
            raw = "".join(piece)
            piece.clear()
            label = mark is not None and mark in raw
            text = " ".join(html.unescape(raw.replace(mark, "") if label else raw).split())
            if text:
                at = stack[-1]
                runs.append((len(nodes), text))
                nodes.append([at, nodes[at][1] + 1, len(text), text.count(" ") + 1, min(link_chars, len(text)),
                              text.count(".") + text.count(",") + text.count("?") + text.count("!"), 0, 0, 9, 0, int(label)])
                names.append("#run")
        link_chars = 0

    def close(name: str, within: set | None = None) -> bool:
        for k in range(len(stack) - 1, 0, -1):
            if names[stack[k]] == name:
                end_run()
                del stack[k:]
                return True
            if within and names[stack[k]] in within:
                return False
        return False

    at, page = 0, page or ""
    head, skip, endless = False, 0, set()
    for m in TAG.finditer(page):
        if m.start() < skip:
            at = max(at, m.end())
            continue
        if m.start() > at:
            text = page[at:m.start()]
            head = head and not text.strip()
            if not head:
                piece.append(text)
                if links:
                    link_chars += len(text)
        at = m.end()
        name = m.group(3)
        if not name:
            continue
        name = name.lower()
        if name == "head":
            head = not m.group(2) and not runs and "body" not in names
            continue
        head = head and (bool(m.group(2)) or name in IN_HEAD)
        if name in END and not m.group(2) and not m.group(4).endswith("/") and name not in endless and (head or name != "title"):
            end = END[name].search(page, at)
            if end:
                at = skip = end.end()
                continue
            endless.add(name)
        if m.group(2):
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS:
                close(name)
                links = 0
        elif name == "a":
            links = 1
        elif name == "br":
            piece.append(" ")
        elif name in BLOCKS:
            links = 0
            if name in CLOSES_P:
                close("p", {"article", "main", "div", "section", "td", "li", "body"})
            for other in SAME.get(name, ()):
                close(other, HOLDS[name])
            end_run()
            if name in VOID:
                continue
            main = side = 0
            if m.group(4).strip():
                for t in TOKENS.findall(m.group(4)):
                    words = set(PART.findall(CAMEL.sub(" ", "".join(t)).lower()))
                    main += len(words & MAIN_WORDS)
                    side += len(words & SIDE_WORDS)
            up = stack[-1]
            stack.append(len(nodes))
            nodes.append([up, nodes[up][1] + 1, 0, 0, 0, 0, main, side, _kind(name), int(name in ("button", "select", "textarea")), 0])
            names.append(name)
        elif name == "input":
            nodes[stack[-1]][9] += 1
    if at < len(page):
        piece.append(page[at:])
    end_run()
    return nodes, runs


def features(nodes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Nodes of several pages (parents counted within the page; ``first``:
    the row of each page's root) -> a feature row each, by sums over the
    contiguous subtrees of document order."""
    n = len(nodes)
    page = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    parent = np.where(nodes[:, 0] < 0, -1, nodes[:, 0] + first[page])
    depth, chars, words, link, stops = nodes[:, 1:6].T.astype(float)
    kind = nodes[:, 8]
    # the subtree of i ends before the next row that is no deeper
    end, open_ = np.full(n, n), []
    level = nodes[:, 1]
    for i in range(n):
        while open_ and level[open_[-1]] >= level[i]:
            end[open_.pop()] = i
        open_.append(i)

    def below(x):
        total = np.concatenate([[0.0], np.cumsum(x)])
        return total[end] - total[:n]

    root = first[page]
    up = np.maximum(parent, 0)
    text, linked, size = below(chars), below(link), (end - np.arange(n)).astype(float)
    runs = below((kind == 9).astype(float))
    density = linked / np.maximum(text, 1)
    children = np.bincount(parent[parent >= 0], minlength=n).astype(float)
    share = lambda k: below((kind == k).astype(float)) / size
    sib_text = np.bincount(parent[parent >= 0], weights=text[parent >= 0], minlength=n)
    order = np.zeros(n)
    seen = np.zeros(n)
    above = np.zeros((n, 4))
    own = np.c_[nodes[:, 6], nodes[:, 7], kind == 1, kind == 2].astype(float)
    for i in range(n):
        p = parent[i]
        if p >= 0:
            order[i] = seen[p]
            seen[p] += 1
            above[i] = above[p] + own[p]
    before = np.concatenate([[0.0], np.cumsum(chars)])[:n]
    page_text = np.maximum(text[root], 1)
    siblings = np.where(parent >= 0, children[up], 1)
    out = [np.log1p(text), np.log1p(below(words)), density, np.log1p(text / size), text / np.maximum(runs, 1) / 100, depth,
           order, siblings, order / np.maximum(siblings, 1), text / page_text, (before - before[root]) / page_text,
           100 * below(stops) / np.maximum(text, 1), children, share(4), share(5), share(3), np.where(parent >= 0, density[up], 0),
           np.where(parent >= 0, text / np.maximum(sib_text[up], 1), 1), np.log1p(np.where(parent >= 0, (sib_text[up] - text) / np.maximum(siblings - 1, 1), 0)),
           own[:, 0], own[:, 1], above[:, 0], above[:, 1], above[:, 2], above[:, 3], below(nodes[:, 9].astype(float)),
           below((kind == 2).astype(float)) / size, below(own[:, 1]) / size,
           *[(kind == k).astype(float) for k in (1, 2, 3, 4, 5, 9)]]
    return np.column_stack(out)


def decode(odds: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Log odds and parents of a page's nodes -> kept: the best choice in
    which a kept node's parent is kept; the root always is."""
    n = len(odds)
    drop, keep = -odds.copy(), odds.copy()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        drop[p] += drop[i]
        keep[p] += max(keep[i], drop[i])
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[parent[i]] and keep[i] > drop[i]
    return kept


class Trees:
    """Boosted trees as arrays; ``odds`` are twice the ensemble's sum."""

    def __init__(self, trees, weights):
        self.trees, self.weights = trees, weights

    @classmethod
    def of(cls, model):
        def walk(node, rows):
            at = len(rows)
            rows.append([0, 0.0, at, at, float(node.prediction())])
            if "Internal" in node.getClass().getSimpleName():
                split = node.split()
                rows[at][0], rows[at][1] = int(split.featureIndex()), float(split.threshold())
                rows[at][2] = walk(node.leftChild(), rows)
                rows[at][3] = walk(node.rightChild(), rows)
            return at

        trees = []
        for tree in model.trees:
            rows: list[list] = []
            walk(tree._java_obj.rootNode(), rows)
            trees.append(tuple(np.array(c) for c in zip(*rows)))
        return cls(trees, list(model.treeWeights))

    def odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            total += weight * value[at]
        return 2 * total


def layout(nodes: list[list], runs: list[tuple[int, str]], seed: int) -> str:
    """A training page's pieces laid out again; main text is marked."""
    rnd = random.Random(seed)
    esc = html.escape
    main = [f"{MARK}{esc(t)}" for at, t in runs if nodes[at][10]]
    side = [esc(t) for at, t in runs if not nodes[at][10]] or ["More"]
    pick = rnd.choice
    some = lambda k: " ".join(pick(side) for _ in range(rnd.randint(1, k)))
    box = lambda tag, word, inner: f'<{tag}{pick([" class", " id"])}="{word}">{inner}</{tag}>'
    items = lambda k: "<ul>" + "".join(f'<li><a href="#">{some(1)}</a></li>' for _ in range(k)) + "</ul>"
    plain = lambda t: f"<p>{esc(t[:rnd.randint(40, 400)])}</p>"
    texts = [t for _, t in runs]
    bare = rnd.random() < 0.3

    def part(tag, word, inner):
        if bare and tag not in ("div", "section"):
            return f"<{tag}>{inner}</{tag}>"
        return box(pick(["div", "section", tag]), word, inner)

    before = [part("header", pick(["header", "masthead", "top-bar"]), f"<h2>{some(2)}</h2>" + pick(["", items(3)])),
              part("nav", pick(["menu", "nav", "main-nav", "breadcrumbs"]), items(rnd.randint(3, 9))),
              part("div", pick(["cookie-notice", "notice", "alert", "consent-banner"]), plain(pick(texts))),
              part("div", pick(["ad", "ads", "advert", "sponsored", "promo"]), pick([some(3), plain(pick(texts))]))]
    after = [part("aside", pick(["sidebar", "related", "widget", "popular-posts"]), f"<h3>{some(1)}</h3>" + pick([items(5), plain(pick(texts)) * 2])),
             part("section", pick(["comments", "comment-list", "discussion", "replies"]), "".join(
                 box("div", "comment", f"<p>{esc(pick(texts)[:300])}</p>") for _ in range(rnd.randint(1, 6)))),
             part("form", pick(["newsletter", "signup", "search-form"]), f"<p>{some(2)}</p><input><button>{some(1)}</button>"),
             part("footer", pick(["footer", "site-footer", "copyright"]), pick([some(4), f"<p>&copy; {some(4)}</p>"]))]
    body = [pick(["<h1>%s</h1>", "<h2>%s</h2>"]) % main[0]] if main else []
    for t in main[1:]:
        body.append(pick(["<p>%s</p>", "<p>%s</p>", "<p>%s</p>", "<div>%s</div>", "<blockquote>%s</blockquote>", "<ul><li>%s</li></ul>", "<h3>%s</h3>"]) % t)
        if rnd.random() < 0.06:
            body.append(part("div", pick(["ad", "advert", "share", "related", "promo"]), some(2)))
    inner = "".join(body)
    content = pick([f"<article>{inner}</article>", f"<main>{inner}</main>", box("div", pick(["content", "post-body", "entry", "article-text", "main", "story"]), inner),
                    f"<div>{inner}</div>", f"<main><article>{inner}</article></main>", f"<div><div>{inner}</div></div>", inner])
    rnd.shuffle(before)
    rnd.shuffle(after)
    halves = "".join(before[:rnd.randint(0, 4)]), "".join(after[:rnd.randint(0, 4)])
    if rnd.random() < 0.3:
        return f"<html><body><div>{halves[0]}{content}{halves[1]}</div></body></html>"
    return f"<html><body>{halves[0]}{content}{halves[1]}</body></html>"


_SEMANTIC = re.compile(r"<(article|main)\b[^>]*>(.*?)(?:</\1\s*>|$)", re.S | re.I)
#: no text and no element of the page, so an article in it is none
_UNREAD = r"<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<(noscript|template|iframe)\b[^>]*>.*?</\2\s*>"
_HIDDEN = re.compile(_UNREAD, re.S | re.I)


def has_article(page: Column) -> Column:
    """Whether a page has an article or main element with text."""
    left = F.regexp_replace(page, rf"(?is){_UNREAD}|</?(?!(?:article|main)\b)[a-z][^>]*>", "")
    return left.rlike(r"(?i)<(?:article|main)\b[^>]*>\s*[^<\s]")


def marked(page: str) -> str | None:
    """A page with its own article (or main) text marked, if it has one."""
    hidden, at = [m.span() for m in _HIDDEN.finditer(page)], 0
    while m := _SEMANTIC.search(page, at):
        at = next((b for a, b in hidden if a <= m.start() < b), 0)
        if at:
            continue
        if re.sub(r"<[^>]*>", "", _HIDDEN.sub("", m[2])).strip():
            inner = re.sub(r"(<[^>]*>)(?=[^<\s])", lambda t: t[0] + MARK, m[2])
            return page[:m.start(2)] + MARK + inner + page[m.end(2):]
        at = max(m.end(), m.start() + 1)
    return None


def _labelled(nodes: list[list]) -> np.ndarray:
    a = np.array(nodes, dtype=np.int64)
    for i in range(len(a) - 1, 0, -1):  # a node with main text below holds main text
        a[a[i, 0], 10] |= a[i, 10]
    return a


def training_rows(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> x (array of features), label."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = marked((page or "").replace(MARK, " "))
                if own is None:
                    continue
                nodes, runs = parse(own, MARK)
                for text in [own, *[layout(nodes, runs, (page_id or 0) * 31 + k) for k in range(LAYOUTS)]]:
                    a = _labelled(parse(text, MARK)[0])
                    xs.append(features(a, np.array([0])))
                    ys.append(a[:, 10])
            if xs:
                yield pa.RecordBatch.from_arrays([pa.array(list(np.concatenate(xs)), pa.list_(pa.float64())),
                                                  pa.array(np.concatenate(ys).astype(float))], names=["x", "label"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(rows, "x array<double>, label double")


def generated_pages(n: int = 48, seed: int = 11) -> list[str]:
    """Pages of invented words with an article between a header, a menu, a side
    column and a footer."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(900)]

    def text(least, most, stop=""):
        return " ".join(rnd.choices(words, k=rnd.randint(least, most))).capitalize() + stop

    def paragraph():
        return f"<p>{' '.join(text(6, 18, '.') for _ in range(rnd.randint(1, 6)))}</p>"

    def items(k):
        return "<ul>" + "".join(f'<li><a href="#">{text(1, 4)}</a></li>' for _ in range(k)) + "</ul>"

    return [f"<html><body><header><h2>{text(1, 4)}</h2></header><nav>{items(rnd.randint(3, 8))}</nav><article><h1>{text(3, 9)}</h1>"
            f"{''.join(paragraph() for _ in range(rnd.randint(2, 9)))}</article><aside><h3>{text(1, 3)}</h3>{items(rnd.randint(2, 6))}"
            f"<p>{text(4, 12)}</p></aside><footer><p>{text(2, 8)}</p></footer></body></html>" for _ in range(n)]


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Trees:
    """Pages (page_id, html) -> trees.  If no page has an article, they are
    fitted on generated pages and their other layouts instead, so that menus,
    notices and footers are told by structure and attributes all the same."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    ids = (pages.where("page_id IS NOT NULL").where(has_article(F.col("html"))).select("page_id")
           .orderBy(F.xxhash64(F.lit(5), "page_id"), "page_id").limit(fit_pages).distinct())
    sample = pages.select("page_id", "html").join(F.broadcast(ids), "page_id")
    found = materialize(training_rows(sample.repartition(8)), "html-nodes")
    if found.select("label").distinct().count() < 2:
        made = pages.sparkSession.createDataFrame(list(enumerate(generated_pages())), "page_id long, html string")
        found = materialize(training_rows(made), "html-nodes")
    rows = found.select(array_to_vector("x").alias("features"), "label").persist()
    try:
        model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=5, maxBins=32).fit(rows)
    finally:
        rows.unpersist()
    return Trees.of(model)


def main_texts(pages: list[str | None], trees: Trees | None) -> list[str]:
    """Pages -> their main texts."""
    parsed = [parse(p) for p in pages]
    first = np.concatenate([[0], np.cumsum([len(n) for n, _ in parsed])])
    nodes = np.array([x for n, _ in parsed for x in n], dtype=np.int64).reshape(-1, len(COLUMNS))
    odds = trees.odds(features(nodes, first[:-1])) if trees else np.zeros(len(nodes))
    out = []
    for (_, runs), a, b in zip(parsed, first, first[1:]):
        kept = decode(odds[a:b], nodes[a:b, 0]) if trees else np.ones(b - a, bool)
        out.append(" ".join(t for at, t in runs if kept[at]))
    return out


def extract(pages: DataFrame, trees: Trees | None) -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars; a row for each
    row.  NULL or empty html, or html without text, gives an empty text;
    without trees every text run is kept."""
    sent = pages.sparkSession.sparkContext.broadcast(trees and (trees.trees, trees.weights))  # plain arrays
    names = ["page_id", "url"]
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value and Trees(*sent.value)
        for batch in batches:
            texts: list[str] = []
            for i in range(0, batch.num_rows, PAGES_AT_ONCE):
                texts += main_texts(batch.column(2).slice(i, PAGES_AT_ONCE).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return pages.select(*names, "html").mapInArrow(run, f"{kinds}, text string, n_chars long")


def op5_html(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, fit(pages))
