"""HTML extraction with a site style tree (operator 7).

Pages are parsed to trees by one regular expression and a stack. The pages of a
host are merged: each element path (tags and classes from the root) is a style
node; its presentations are the child sequences it shows, its contents the
texts it shows. Their entropies, normalised to 0..1 by the number of pages, give
importance: a node that always shows the same text and layout has none, and
neither has a text that nearly all pages of the host show at one path. Only
counts travel: (host, path, text hash) pre-aggregates before any shuffle, so a
host with a third of all pages is no larger in any task than others.

A page keeps its article (or main) element if it has one, else its body; from
that go nodes that are boilerplate by HTML's own meaning (nav, footer, forms,
...; class and id words), and nodes of low importance; inside an article only
blocks, and none if they hold most of its text (copies of a page on one host).
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: A style node is unimportant below this importance, if at least PAGES pages of the host show it; a text, if all but this share of the host's pages, and PAGES at least, show it.
UNIMPORTANT, PAGES = 0.2, 5
#: The importance table is broadcast only up to this many nodes; beyond, pages join it by host, a host's pages over this many keys.
BROADCAST_NODES, HOST_KEYS = 100_000, 32

# Elements by their meaning in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template iframe object svg annotation annotation-xml head title canvas audio video select option datalist textarea button".split())
_BOILER = frozenset("nav header footer aside form dialog menu".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
# Words in class, id and role that name boilerplate.
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets contentinfo complementary search alert".split()
)
# Parts of a name behind its head ("sidebar-left", "share-buttons"), and parts that say there is none of it.
_TAIL = frozenset("area bar block body bottom box button buttons center col column container content group holder icon icons inner item items left link links list main outer panel primary right row secondary section slot small large text top unit wrap wrapper".split())
_WITHOUT = frozenset("no not has with without hide hidden show".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_RAW = {t: re.compile(rf"</{t}\s*>|</{t}\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")}
# An open p ends before these; li, dd and the like end their own kind.
_ENDS_P = _BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "summary", "figcaption"}
_ENDS_OWN = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


class Node:
    __slots__ = ("tag", "boiler", "weak", "header", "path", "parent", "items")

    def __init__(self, tag: str, boiler: bool, path: str, parent: Node | None, weak: bool = False, header: bool = False):
        self.tag, self.boiler, self.path, self.parent = tag, boiler, path, parent
        self.weak, self.header = weak, header  # boilerplate by a class word or as a form only; by nothing but the word header
        self.items: list[Node | str] = []


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _head(name: str) -> str:
    """The listed word that heads a class name or id, or nothing: `main-nav` and `sidebar-left` have one, `no-sidebar`, `comments-open` and `search-result` none."""
    parts = _NAME.findall(name)
    while len(parts) > 1 and parts[-1] in _TAIL:
        parts.pop()
    return parts[-1] if parts and parts[-1] in _WORDS and _WITHOUT.isdisjoint(parts) else ""


def _named(attributes: str) -> tuple[bool, set[str], str]:
    """Whether attributes hide the element; words by which they name boilerplate; its class for the path."""
    gone, words, style = False, set(), ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            gone = True
        elif name in ("class", "id", "role"):
            words.update(w for w in map(_head, value.split()) if w)
            if name == "class":
                style = "." + ".".join(sorted(value.split()))
    return gone, words, style


def parse(page: str) -> Node:
    """The element tree: unclosed and stray tags are tolerated, raw-text elements keep no text, comments vanish."""
    root = node = Node("", False, "", None)
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            node.items.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" or tag not in _VOID:
                up = node
                while up is not root and up.tag != tag:
                    # A closing inline tag does not reach beyond its block; a closing block ends what is open in it.
                    up = root if tag in _FORMATTING and up.tag in _BLOCK else up.parent
                if up is not root:
                    node = up.parent
            continue
        if tag in _ENDS_P or tag in _ENDS_OWN:
            goal, up, seen = ({"p"} if tag in _ENDS_P else _ENDS_OWN[tag]), node, None
            while up is not root and (up.tag in goal or up.tag in _FORMATTING or up.tag == "p"):
                if up.tag in goal:
                    seen = up
                up = up.parent
            if seen is not None:
                node = seen.parent
        gone, words, style = _named(m[3]) if m[3] and "=" in m[3] or m[3] and "hidden" in m[3] else (False, (), "")
        named = tag in _BOILER
        weak = not gone and (not named or tag == "form")
        new = Node(tag, gone or named or bool(words), f"{node.path}/{tag}{style}", node, weak, not gone and (tag == "header" or (not named and set(words) == {"header"})))
        node.items.append(new)
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else n
        elif tag not in _VOID and not m[3].endswith("/"):
            node = new
    _settle(root)
    return root


def _settle(root: Node) -> None:
    """Boilerplate by a class word or as a form is none if it holds most of the page's text and the page's article or first heading, or on a page without article or main."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.tag not in _SILENT:
            order.append(x)
            todo += [i for i in x.items if not isinstance(i, str)]
    if not any(x.boiler and x.weak for x in order):
        return
    size, holds = {}, {}
    for x in reversed(order):  # children come after their parents
        kids = [i for i in x.items if not isinstance(i, str) and id(i) in size]
        size[id(x)] = sum(len(i.strip()) for i in x.items if isinstance(i, str)) + sum(size[id(i)] for i in kids)
        holds[id(x)] = (x.tag in ("article", "main") and not x.boiler) or x.tag == "h1" or any(holds[id(i)] for i in kids)
    bare = not any(x.tag in ("article", "main") and not x.boiler for x in order)
    for x in order:
        if x.boiler and x.weak and 2 * size[id(x)] > size[id(root)] and (bare or holds[id(x)]):
            x.boiler = False


def _text_of(node: Node) -> str:
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag not in _SILENT:
            todo += reversed(x.items)
    return " ".join(" ".join(parts).split())


def _length(node: Node) -> int:
    """Characters of a node's text but for boilerplate below it."""
    n, todo = 0, list(node.items)
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            n += len(x.strip())
        elif x.tag not in _SILENT and not x.boiler:
            todo += x.items
    return n


def _article(root: Node) -> tuple[list[Node], bool]:
    """Outermost articles, if they hold half or more of the text that is no boilerplate, or main elements that hold text, and whether there are any; else the root."""
    for wanted in ("article", "main"):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if x.tag == wanted and not (wanted == "article" and x.boiler):
                found.append(x)
            elif x.tag not in _SILENT and not x.boiler:
                todo += [i for i in reversed(x.items) if not isinstance(i, str)]
        size = sum(len(_text_of(x)) for x in found)
        if size and (wanted == "main" or 2 * sum(map(_length, found)) >= _length(root)):
            return found, True
    return [root], False


def _digest(shown: str) -> bytes:
    return hashlib.blake2b(shown.encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _text_key(path: str, shown: bytes) -> str:
    return f"{path}\0{shown.hex().upper()}"


def _repeated(tops: list[Node], unimportant: frozenset[str] | set[str]) -> set[int]:
    """Ids of the outermost unimportant blocks inside articles; none if they hold most of the articles' text."""
    found, size, todo = set(), 0, [i for t in tops for i in t.items]
    while todo and unimportant:
        x = todo.pop()
        if isinstance(x, str) or x.tag in _SILENT or _drops(x, True):
            continue
        if x.tag in _BLOCK and (text := _text_of(x)) and (x.path in unimportant or _text_key(x.path, _digest(text)) in unimportant):
            found.add(id(x))
            size += len(text)
        else:
            todo += x.items
    return found if 2 * size < sum(len(_text_of(t)) for t in tops) else set()


def extract(page: str, unimportant: frozenset[str] | set[str] = frozenset()) -> str:
    """Main text of a page: blocks in page order, joined by an empty line."""
    tops, sure = _article(parse(page))
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        if text := " ".join("".join(line).split()):
            blocks.append(text)
        line.clear()

    todo: list = list(reversed(tops))
    top_ids = {id(t) for t in tops}
    repeated = _repeated(tops, unimportant) if sure else set()
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in _SILENT or (id(x) not in top_ids and (_drops(x, sure) or (id(x) in repeated if sure else x.path in unimportant))):
            if x.tag in _BLOCK:
                close()
        elif x.tag in _BLOCK:
            close()
            todo.append(None)
            todo += reversed(x.items)
        else:
            todo += reversed(x.items)
    close()
    return "\n\n".join(blocks)


def _drops(x: Node, in_article: bool) -> bool:
    """An article's own header (its headings, no menu) stays; body and html never go."""
    if x.tag in ("body", "html", "main", "article"):
        return x.tag == "article" and x.boiler  # a reader comment marked up as an article
    return x.boiler and not (in_article and (x.tag == "header" or x.header) and any(not isinstance(i, str) and i.tag in ("h1", "h2") for i in x.items))


def _style_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (host, path, kind, shown, n) of all nodes but inline ones inside an article, which importance never removes: kind 0 counts texts, kind 1 child sequences, kind 2 the host's pages. What a page shows repeatedly counts once."""
    counts: dict[tuple[str, str, int, bytes], int] = {}

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys], pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["host", "path", "kind", "shown", "n"])
        counts.clear()
        return out

    for batch in batches:
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            root = parse(page.as_py() or "")
            tops, sure = _article(root)
            kept = {id(t) for t in tops} if sure else set()
            host, todo = host_of(url), [(root, False)]
            keys = {(host, "", 2, b"")}
            while todo:
                x, inside = todo.pop()
                kids = [i for i in x.items if not isinstance(i, str) and i.tag not in _SILENT]
                todo += [(i, inside or id(x) in kept) for i in kids]
                if not x.path or (inside and x.tag not in _BLOCK) or id(x) in kept:
                    continue
                for kind, shown in ((0, _text_of(x)), (1, ",".join(i.path[len(x.path) :] for i in kids))):
                    keys.add((host, x.path, kind, _digest(shown)))
            for key in keys:
                counts[key] = counts.get(key, 0) + 1
            if len(counts) > 100_000:
                yield flush()
    if counts:
        yield flush()


def style_counts(pages: DataFrame) -> DataFrame:
    """(host, path, kind, shown, n) of the merged trees: how many pages of the host show this there."""
    rows = pages.select("url", "html").mapInArrow(_style_rows, "host string, path string, kind int, shown binary, n long")
    return rows.groupBy("host", "path", "kind", "shown").agg(F.sum("n").alias("n"))


def style_tree(each: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of style_counts: the greater of the normalised entropies of a node's texts and of its child sequences."""
    kinds = each.where("kind < 2").groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = F.when(F.col("pages") > 1, 1 - F.col("nlogn") / (F.col("pages") * F.log("pages"))).otherwise(1.0)
    return kinds.groupBy("host", "path").agg(F.max("pages").alias("pages"), F.max(entropy).alias("importance"))


def repeated_texts(each: DataFrame) -> DataFrame:
    """(host, path) of style_counts: keys of texts that nearly all pages of a host show at one path. Cells of tables are no texts of their own."""
    hosts = each.where((F.col("kind") == 2) & (F.col("n") >= PAGES)).select("host", F.col("n").alias("pages"))
    texts = each.where((F.col("kind") == 0) & (F.col("n") >= PAGES) & ~F.col("path").rlike(r"/t[dhr](\.[^/]*)?$"))
    return texts.join(hosts, "host").where(F.col("n") >= (1 - UNIMPORTANT) * F.col("pages")).select("host", F.concat("path", F.lit("\0"), F.hex("shown")).alias("path"))


def _texts(unimportant):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = unimportant.value if unimportant is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                urls = part.column(1)
                low = [known.get(host_of(u), frozenset()) for u in urls.to_pylist()] if known is not None else [set(x or ()) for x in part.column(3).to_pylist()]
                texts = [extract(h.as_py() or "", u) for h, u in zip(part.column(2), low, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return work


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per row of `pages` (page_id, url, html): page_id, url, text, n_chars (code points).

    Null or empty html, and a page without main text, give an empty text. A
    null or relative url belongs to the host ''. Pages are parsed whole;
    repeated rows are pages of their own; other columns are not looked at.
    """
    spark = pages.sparkSession
    schema = "page_id long, url string, text string, n_chars long"
    each = stored(style_counts(pages), "style-counts")
    paths = style_tree(each).where((F.col("importance") < UNIMPORTANT) & (F.col("pages") >= PAGES)).select("host", "path")
    low = stored(paths.unionByName(repeated_texts(each)), "styles")
    rows = pages.select("page_id", "url", "html")
    if low.count() <= BROADCAST_NODES:
        known: dict[str, set[str]] = {}
        for r in low.toLocalIterator():
            known.setdefault(r.host, set()).add(r.path)
        return rows.mapInArrow(_texts(spark.sparkContext.broadcast(known)), schema)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    by_host = low.groupBy("host").agg(F.collect_set("path").alias("paths")).withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(HOST_KEYS - 1))))
    keyed = rows.withColumns({"host": host, "key": F.pmod(F.xxhash64("page_id", "url"), F.lit(HOST_KEYS)).cast("int")})
    joined = keyed.join(by_host, ["host", "key"], "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(_texts(None), schema)
