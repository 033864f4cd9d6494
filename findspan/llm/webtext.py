"""Main text of web pages: page parts that say what they are go, and so do subtrees that recur across a site."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findspan.llm.common import saved

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|([^<]+|<)", re.DOTALL
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+")
#: Words after which a name is about what the element has or lacks, not about what it is.
ABOUT = {"no", "has", "with", "without", "hide", "hides", "show", "shows"}

RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCKS = set(
    "html head body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead "
    "tbody tfoot tr td th form fieldset blockquote pre figure figcaption details summary dialog address center hgroup menu search".split()
)
#: Elements that end an open paragraph or item of theirs.
ENDS_P = BLOCKS - {"html", "head", "body", "td", "th", "tr"} | {"hr"}
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LISTS = {"ul", "ol", "dl", "table", "menu"}
#: Never part of an article.
DROPPED = set("head nav footer aside form menu search dialog button select svg canvas object template audio video map".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Words in class, id or role of parts that are not the article.
NAMED = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup "
    "modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments "
    "commentlist disqus reply replies respond social share sharing newsletter subscribe subscription signup related recommended "
    "widget toolbar pagination pager skip login search alert toast paywall complementary contentinfo dialog".split()
)
#: Parts that are text themselves: a name of several words, like one made from a title, doesn't tell that they are something else.
TEXT_BLOCKS = {"p", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "blockquote", "pre", "figure", "figcaption", "caption"}
#: Names that stand whatever the share of the page's text is.
READERS = {"comment", "comments", "commentlist", "disqus", "replies", "respond"}
KEPT_BLOCKS = {"p", "blockquote", "pre", "li", "dt", "dd", "td", "th", "tr", "tbody", "thead", "html", "body", "article", "main", *HEADINGS}


class Node:
    """An element; ``parts`` holds texts and elements in order, ``named`` what its names say it is, ``own_id`` its id."""

    __slots__ = ("tag", "parts", "out", "digest", "named", "own_id")

    def __init__(self, tag: str, out: bool = False, named: frozenset[str] = frozenset(), own_id: str = "") -> None:
        self.tag, self.parts, self.out, self.digest, self.named, self.own_id = tag, [], out, 0, named, own_id


def _names(tag: str, value: str) -> frozenset[str]:
    """The words of ``NAMED`` that a class, id or role calls an element by."""
    found = set()
    for name in value.split():
        words = WORD.findall(name)
        own = {w for before, w in zip(["", *words], words) if w in NAMED and before not in ABOUT}
        if tag not in TEXT_BLOCKS or len(own) == len(set(words)):
            found |= own
    return frozenset(found)


def _attributes(tag: str, attributes: str) -> tuple[bool, frozenset[str], str]:
    """Whether an element's own attributes say that it isn't shown, the names that say that it isn't the article, and its id."""
    if not attributes or tag in {"html", "body", "article", "main"}:
        return False, frozenset(), ""
    named, own_id = frozenset(), ""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, named, own_id
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True, named, own_id
        if name in {"class", "id", "role"} and tag not in HEADINGS:
            named |= _names(tag, value)
        if name == "id":
            own_id = value
    return False, named, own_id


def parse(page: str) -> Node:
    """A tree of the page's block elements; inline elements are part of their block unless they say they are out."""
    root = Node("html")
    stack, at, end = [root], 0, len(page)
    while at < end:
        found = TOKEN.match(page, at)
        if not found:
            at += 1
            continue
        at = found.end()
        closing, tag, attributes, text = found.groups()
        if text is not None:
            stack[-1].parts.append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag not in BLOCKS and stack[depth].tag in BLOCKS or tag in {"p", "li"} and stack[depth].tag in LISTS:
                    break
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            stack[-1].parts.append(" ")
        if tag in VOID and tag != "hr":
            continue
        if tag in ENDS_P and stack[-1].tag == "p":
            stack.pop()
        if tag in ENDS_SAME:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ENDS_SAME[tag]:
                    del stack[depth:]
                    break
                if stack[depth].tag in LISTS:
                    break
        if tag == "hr" or attributes.endswith("/") and tag not in BLOCKS:
            continue
        hidden, named, own_id = _attributes(tag, attributes)
        out = tag in DROPPED or hidden
        inside = stack[-1].tag == tag and tag not in BLOCKS
        if tag in BLOCKS or out or named or inside:
            node = Node(tag, out, named, own_id)
            stack[-1].parts.append(node)
            stack.append(node)
    return root


def _walk(node: Node) -> Iterator[Node]:
    waiting = [node]
    while waiting:
        one = waiting.pop()
        yield one
        waiting.extend(p for p in reversed(one.parts) if isinstance(p, Node))


def _digest(root: Node) -> None:
    """A hash of each subtree, from the leaves up: its tag, texts without extra white space, and subtrees."""
    for node in reversed(list(_walk(root))):
        parts = [p.digest.to_bytes(8, "big") if isinstance(p, Node) else " ".join(p.split()).encode("utf-8", "surrogatepass") for p in node.parts]
        node.digest = xxhash.xxh64_intdigest(b"\0".join([node.tag.encode("utf-8", "surrogatepass"), *filter(None, parts)]), 7)


def _titled(node: Node) -> bool:
    """Whether the element's id is made from the heading that it begins with."""
    if not node.own_id:
        return False
    for part in node.parts:
        if isinstance(part, Node):
            if part.tag in HEADINGS:
                title = " ".join(p for p in part.parts if isinstance(p, str))
                return WORD.findall(html.unescape(title).lower()) == WORD.findall(node.own_id)
            return False
        if part.strip():
            return False
    return False


def _name_out(root: Node) -> None:
    """Mark what its names say is not the article, unless its id is its own title or, on a page without ``article`` and ``main``, it holds
    most of the page's text."""
    order = list(_walk(root))
    told = any(n.tag in {"article", "main"} for n in order)
    sizes: dict[int, int] = {}
    for node in reversed(order):
        if node.out and not node.named:
            sizes[id(node)] = 0  # not shown, or never part of an article
        else:
            sizes[id(node)] = sum(sizes[id(p)] if isinstance(p, Node) else len(p.strip()) for p in node.parts)
    whole = sizes[id(root)]
    for node in order:
        if node.named and not node.out:
            most = not told and 2 * sizes[id(node)] > whole and READERS.isdisjoint(node.named)
            node.out = not (most or _titled(node))


def _clear(root: Node, gone: frozenset[int]) -> None:
    """Mark what is out: by name, recurring subtrees, and page headers (an article's own header keeps its headings)."""
    _name_out(root)
    holders: set[int] = set()
    in_article: set[int] = set()
    order = list(_walk(root))
    for node in order:
        if node.tag in {"article", "main"} or id(node) in in_article:
            in_article.update(id(p) for p in node.parts if isinstance(p, Node))
    for node in reversed(order):
        if node.tag in {"article", "main"} or any(isinstance(p, Node) and id(p) in holders for p in node.parts):
            holders.add(id(node))
    for node in order:
        inside = id(node) in in_article
        if id(node) in holders and node.tag not in DROPPED:
            node.out = False  # whatever holds the article stays
        elif signed(node.digest) in gone and node.tag not in (KEPT_BLOCKS if inside else {"html", "body", "article", "main"}):
            node.out = True
        elif node.tag == "header":
            if inside:
                node.parts = [p for p in node.parts if isinstance(p, Node) and p.tag in HEADINGS]
            else:
                node.out = True


def signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def _blocks(node: Node, blocks: list[str]) -> None:
    """Texts of the blocks of a subtree in page order, without what is out."""
    waiting: list = [node]
    open_text: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(open_text)).split())
        if text:
            blocks.append(text)
        open_text.clear()

    while waiting:
        one = waiting.pop()
        if isinstance(one, str):
            open_text.append(one)
        elif one is None:
            close()
        elif not one.out:
            edge = [None] if one.tag in BLOCKS else []
            waiting.extend([*edge, *reversed(one.parts), *edge])
        elif one.tag in BLOCKS:
            close()
    close()


def _articles(root: Node) -> list[Node]:
    """The outermost articles of the page (of ``main`` if it has articles), else ``main``, else the page. All of them count, however short."""

    def outermost(top: Node, tag: str) -> list[Node]:
        found, waiting = [], [top]
        while waiting:
            one = waiting.pop()
            if one.out:
                continue
            if one.tag == tag:
                found.append(one)
            else:
                waiting.extend(p for p in reversed(one.parts) if isinstance(p, Node))
        return found

    mains = outermost(root, "main")
    return [a for m in mains for a in outermost(m, "article")] or outermost(root, "article") or mains or [root]


def extract(page: str, gone: frozenset[int] = frozenset()) -> str:
    """Main text of a page: one line per block. ``gone`` are digests of the subtrees that recur on its site."""
    root = parse(page)
    _digest(root)
    _clear(root, gone)
    blocks: list[str] = []
    for one in _articles(root):
        _blocks(one, blocks)
    return "\n".join(blocks)


def subtrees(page: str) -> tuple[int, set[int]]:
    """Hash of a page's main text before template removal, and digests of its subtrees that may be templates."""
    root = parse(page)
    _digest(root)
    found = {signed(n.digest) for n in _walk(root) if n.parts and n.tag not in {"html", "head", "body", "article", "main"}}
    _clear(root, frozenset())
    blocks: list[str] = []
    for one in _articles(root):
        _blocks(one, blocks)
    return signed(xxhash.xxh64_intdigest("\n".join(blocks).encode("utf-8", "surrogatepass"), 7)), found


def extract_main_text(pages: DataFrame, min_pages: int = 8) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The text is the page's articles (all outermost ones, else ``main``, else the page) without what is something else:

    * elements of ``DROPPED``, and what is hidden; formulas (``math``) stay;
    * elements that a word of class, id or role calls one of ``NAMED``. Words after ``no``, ``has``, ``with`` and the like don't count, headings
      have no such names, and other text blocks (paragraphs, items, cells) only if all words of a name are such. A section whose id is its
      own heading stays, and so does, on a page without ``article`` and ``main``, an element that holds more than half of the text, unless it is the
      readers' comments;
    * headers outside of articles; of an article's own header the headings stay.

    It also goes without template subtrees: those that occur on at least ``min_pages`` pages of a host with different main texts (so
    copies of a page don't make its text a template). Inside an article, paragraphs, headings, quotes, list
    items and table cells are never templates, only whole boxes, lists and sections are. A null or empty page has an
    empty text; pages without a host are a site of their own; repeated rows give repeated rows.

    Counts of subtrees shrink before the shuffle, whatever host they are of; only digests of a page's
    own recurring subtrees come back to it.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^\w+://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"), host.alias("host")
    ).withColumn("row", F.xxhash64("page_id", "url", "html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                columns: tuple[list, ...] = ([], [], [], [])
                part = batch.slice(start, 500)
                for row, site, page in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    content, found = subtrees(page)
                    for digest in found:
                        for column, value in zip(columns, (row, site, digest, content), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()),
                     pa.array(columns[3], pa.int64())], ["row", "host", "subtree", "content"],
                )

    seen = saved(
        rows.select("row", "host", "html").mapInArrow(count, "row long, host string, subtree long, content long"), "subtrees"
    )
    recurring = (
        seen.groupBy("host", "subtree").agg(F.count_distinct("content").alias("n")).filter(F.col("n") >= min_pages).select("host", "subtree")
    )
    gone = seen.join(recurring, ["host", "subtree"]).groupBy("row").agg(F.collect_set("subtree").alias("gone"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [packer.compress(p.encode("utf-8", "surrogatepass")) for p in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], ["row", "page_id", "url", "packed"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                found = [
                    extract(opener.decompress(page).decode("utf-8", "surrogatepass"), frozenset(digests or ()))
                    for page, digests in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    # Pages travel compressed to the digests of what recurs in them.
    packed = rows.select("row", "page_id", "url", "html").mapInArrow(squeeze, "row long, page_id long, url string, packed binary")
    return (
        packed.join(gone, "row", "left").select("page_id", "url", "packed", "gone")
        .mapInArrow(clean, "page_id long, url string, text string, n_chars long")
    )
