"""Main text of web pages by site template removal.

Every page is read once into an element tree. Its text is kept in blocks, each
with the subtrees that it lies in; subtrees are hashed by tag, attributes and
content, and Spark counts, for every host, the pages of different content that
hold a hash. Subtrees that recur on PAGES of them are deleted with their blocks.

What does not recur, as on a host with few pages, goes by what HTML says of it:
elements that are no content by their tag (menus, asides, footers, forms), by
being hidden, or by a class, id or role all of whose words name chrome. Neither
such a name nor a tag deletes an element that holds the page's articles. Inside
an article an id names a section and says nothing of chrome, and running text
(paragraphs, headings, lists, tables) goes neither by a name nor as template
unless all of it is links: pages quote each other.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quarry.llm.common import stored

#: A subtree is template if it is on so many pages of its host of different content, whatever the host's size.
PAGES = 5
#: Recurring subtrees that are broadcast, 8 bytes each, at most; beyond, pages are joined with them.
HELD = 1_000_000
#: Element names by what they do to text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
DROPPED = set("head script style noscript template nav footer aside form iframe svg math canvas object audio video button select textarea input dialog menu title datalist map".split())
UNSEEN = set("head script style noscript template svg math canvas object audio video datalist map".split())
BLOCK = set("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul caption form".split())
FLOW = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption hr".split())
CLOSES_P = BLOCK | {"nav", "footer", "aside", "menu"}
#: Words of class, id and role that name what is not main text, those of reader comments, and words that say only where or how.
CHROME = set(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notification alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav aside footer masthead topbar toolbar "
    "header share sharing social related recommended newsletter subscribe subscription signup login "
    "search widget pagination pager complementary contentinfo skip hidden".split())
COMMENTS = set("comment comments commentlist disqus respond reply replies".split())
PLACES = set("area areas bar bars bottom box boxes button buttons col column container footer global group header icon icons inner item items left link links list lists main mobile "
             "outer panel primary right row secondary section site slot sticky text thread title top unit wrap wrapper body form page posts content block".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
_SPACE = re.compile(r"[\s]+")




class Node:
    """An element: its children, and, once measured, the hash of its subtree and the length of its text and of the links in it."""

    __slots__ = ("tag", "attrs", "children", "inside", "hash", "size", "linked", "holds", "names")

    def __init__(self, tag: str, attrs: str, inside: bool):
        self.tag, self.attrs, self.children, self.inside = tag, attrs, [], inside
        self.hash, self.size, self.linked, self.holds, self.names = 0, 0, 0, frozenset(), None


def tree(html: str, marks: bool = True) -> Node:
    """The elements of a page; unclosed ones end with their parent, stray end tags are ignored. Without marks no element counts as inside of an article."""
    root = Node("#root", "", False)
    stack, open_, at, lower = [root], Counter(), 0, None

    def end(k: int) -> None:
        open_.subtract(n.tag for n in stack[k:])
        del stack[k:]

    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            stack[-1].children.append(text)
        if not m:
            return root
        at = m.end()
        if m[3] is None:
            if m[1]:
                stack[-1].children.append(m[1].replace("&", "&amp;"))
            continue
        tag = m[3].lower()
        if m[2]:
            if open_[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        end(k)
                        break
            continue
        if tag in CLOSES_P and open_["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    end(k)
                    break
                if stack[k].tag in BLOCK or stack[k].tag in DROPPED:
                    break
        if tag in _IMPLIED:
            ends, within = _IMPLIED[tag]
            if any(open_[t] > 0 for t in ends):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in within:
                        break
                    if stack[k].tag in ends:
                        end(k)
                        break
        node = Node(tag, m[4].strip(), marks and (stack[-1].inside or stack[-1].tag in ("article", "main")))
        stack[-1].children.append(node)
        if tag in RAW:
            if lower is None:
                lower = html.lower() if len(html.lower()) == len(html) else "".join(c.lower() if c.isascii() else c for c in html)
            close = lower.find(f"</{tag}", at)
            if close < 0:
                return root
            if tag in ("textarea", "title"):
                node.children.append(html[at:close])
            close = html.find(">", close)
            at = close + 1 if close >= 0 else len(html)
        elif tag not in VOID:
            stack.append(node)
            open_[tag] += 1


def measure(root: Node) -> list[Node]:
    """All elements, each with hash, size, linked and holds (which of article, main and h1 lie in it); children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    order.reverse()
    for node in order:
        parts, size, linked, holds = [node.tag, node.attrs], 0, 0, node.holds
        for c in node.children:
            if isinstance(c, str):
                parts.append(plain := _SPACE.sub(" ", c).strip())
                size += len(plain)
            else:
                parts.append(str(c.hash))
                if c.tag not in RAW:
                    size, linked = size + c.size, linked + c.linked
                holds = holds | c.holds | ({c.tag} & {"article", "main", "h1"}) if c.holds or c.tag in ("article", "main", "h1") else holds
        node.hash, node.size, node.linked, node.holds = xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")), size, size if node.tag == "a" else linked, holds
    return order


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(node.attrs)} if node.attrs else {}


def named(node: Node) -> str:
    """What class, id and role name an element: "hidden", "chrome", "comments" or ""; a name counts if all its words are chrome or places."""
    if node.names is None:
        node.names = ""
        if node.attrs:
            a = attributes(node)
            if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")):
                node.names = "hidden"
            else:
                text = node.inside and node.tag in FLOW and node.linked < node.size
                for name in () if text else " ".join((a.get("class", ""), "" if node.inside else a.get("id", ""), a.get("role", ""))).split():
                    words = set(re.findall(r"[A-Za-z][a-z]*|[A-Z]+", name)) if not name.islower() else set(re.findall(r"[a-z]+", name))
                    words = {w.lower() for w in words}
                    for kind, some in (("comments", COMMENTS), ("chrome", CHROME)):
                        if words & some and words <= CHROME | COMMENTS | PLACES and not (node.inside and words <= PLACES | {"header"}):
                            node.names = node.names or kind
    return node.names


def regions(root: Node) -> list[Node]:
    """The page's articles, else its main element, else the page itself.

    Articles in menus, asides, footers or in what is named chrome or comments
    are none of the page's, unless the page has no other: then those in forms
    and in elements with such a name are.
    """
    for tag in ("article", "main"):
        if tag not in root.holds:
            continue
        for strict in (True, False):
            found, stack = [], [root]
            while stack:
                node = stack.pop()
                if node.tag in DROPPED and (strict or node.tag != "form") or named(node) and (strict or named(node) != "chrome") and node.tag not in ("html", "body"):
                    continue
                if node.tag == tag:
                    found.append(node)
                else:
                    stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and (c.tag == tag or tag in c.holds))
            if found:
                return found if tag == "article" else found[:1]
    return [root]


class Page:
    """A page's blocks of text, the template subtrees they may lie in, and the hashes of all subtrees that may be template."""

    def __init__(self, html: str, marks: bool = True):
        root = tree(html, marks)
        order = measure(root)
        tops = regions(root) if marks else [root]
        whole = sum(t.size for t in tops)
        self.marks = marks
        self.blocks: list[str] = []
        self.at: list[int] = []
        self.nodes: list[int] = []
        self.parents: list[int] = []
        self.hashes = sorted({n.hash for n in order if self.may_be_template(n, whole)})
        for top in tops:
            self._read(top, whole)

    @staticmethod
    def may_be_template(node: Node, whole: int) -> bool:
        if node.tag not in CLOSES_P or node.tag in ("html", "body", "article", "main") or not node.size:
            return False
        if "article" in node.holds or "main" in node.holds or node.inside and 2 * node.size > whole:
            return False
        return node.tag not in FLOW or not node.inside or node.linked == node.size

    def gone(self, node: Node, top: Node, whole: int) -> bool:
        """True for elements of a region that are not main text by tag or name; without marks only what shows no text goes."""
        if not self.marks:
            return node.tag in UNSEEN
        if node.tag in DROPPED or node.tag == "header" and not node.inside:
            return not (node.tag == "form" and (node.holds or 2 * node.size > whole))
        name = named(node)
        return bool(name) and (name != "chrome" or not node.holds & {"article", "main"} and (top.tag == "#root" or 2 * node.size <= whole)) and node.tag not in ("html", "body")

    def _read(self, top: Node, whole: int) -> None:
        run, inner = [], -1

        def close() -> None:
            if text := _SPACE.sub(" ", "".join(run)).strip():
                self.blocks.append(text)
                self.at.append(inner)
            run.clear()

        stack: list = [top]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                close()
                inner = node[0]
            elif isinstance(node, str):
                run.append(unescape(node))
            elif node is top or not self.gone(node, top, whole):
                if node.tag == "br":
                    run.append(" ")
                if node.tag in CLOSES_P or node is top:
                    close()
                    stack.append((inner,))
                    if self.may_be_template(node, whole):
                        self.nodes.append(node.hash)
                        self.parents.append(inner)
                        inner = len(self.nodes) - 1
                stack.extend(reversed(node.children))
            elif node.tag in CLOSES_P:
                close()


def without(blocks: list[str], at: list[int], nodes: list[int], parents: list[int], template: Callable[[int], bool]) -> str:
    """The blocks that lie in no template subtree, joined by line feeds; a node's parent comes before it."""
    gone: list[bool] = []
    for h, parent in zip(nodes, parents):
        gone.append(parent >= 0 and gone[parent] or template(h))
    return "\n".join(b for b, k in zip(blocks, at) if k < 0 or not gone[k])


def main_text(html: str) -> str:
    """The main text of one page alone, without its host's templates."""
    return "\n".join(Page(html).blocks)


def host(url: F.Column) -> F.Column:
    """The lower-case host of a URL; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


_READ = "id {id}, url string, page long, content long, blocks array<string>, at array<int>, nodes array<long>, parents array<int>, hashes array<long>"


def read_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str, marks: bool = True) -> DataFrame:
    """Every row of pages read once: its blocks, and the hashes of its subtrees, which differ by host; a page without a host has none."""
    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("page", "content", "blocks", "at", "nodes", "parents", "hashes")}
            for name, html in zip(batch.column(2), batch.column(3)):
                name, html = name.as_py(), html.as_py() or ""
                p, salt = Page(html, marks), np.uint64(xxh64_intdigest(name or ""))
                raw = html.encode("utf-8", "surrogatepass")
                out["page"].append(xxh64_intdigest(raw, int(salt)))
                out["content"].append(xxh64_intdigest("\n".join(p.blocks).encode("utf-8", "surrogatepass")))
                out["blocks"].append(p.blocks)
                out["at"].append(p.at)
                out["nodes"].append(signed(p.nodes) ^ salt.view(np.int64))
                out["parents"].append(p.parents)
                out["hashes"].append(signed(p.hashes if name else []) ^ salt.view(np.int64))
            kinds = {"blocks": pa.list_(pa.string()), "at": pa.list_(pa.int32()), "parents": pa.list_(pa.int32()), "nodes": pa.list_(pa.int64()), "hashes": pa.list_(pa.int64())}
            columns = [pa.array(v, kinds[k]) if k in kinds else pa.array(signed(v)) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "url", *out])

    return stored(chosen.mapInArrow(read, _READ.format(id=pages.schema[id_col].dataType.simpleString())), "html-pages")


def templates(read: DataFrame) -> DataFrame:
    """(hash): the subtrees on at least PAGES pages of their host of different content; copies of a page count once."""
    held = read.select("content", F.explode("hashes").alias("hash")).distinct()
    return held.groupBy("hash").agg(F.count("*").alias("k")).where(F.col("k") >= PAGES).select("hash")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", removal: bool = True, marks: bool = True) -> DataFrame:
    """(id_col, url_col, text, n_chars, n_template) for every row of pages; n_template counts the page's subtrees that its host repeats.

    A null or empty page, and one without main text, has an empty text. Pages
    with a null URL, or one without a host, have no template. Repeated rows are
    kept; pages of the same main text count once for their host's templates.
    Very long and very deep pages are read whole, without recursion. Columns
    beside the three are ignored, whatever their names. An empty table gives an
    empty result. With removal=False no template is deleted; with marks=False
    tags and names say nothing of what is main text, and templates have to find it.
    """
    read = read_pages(pages, id_col, url_col, html_col, marks)
    found = stored(templates(read), "html-templates")
    n = found.count() if removal else 0
    if n <= HELD:
        keys = np.sort(found.toPandas()["hash"].to_numpy(np.int64)) if n else np.zeros(0, np.int64)
        known = read.sparkSession.sparkContext.broadcast(keys)

        @F.arrow_udf("text string, n long")
        def text(blocks: pa.Array, at: pa.Array, nodes: pa.Array, parents: pa.Array, hashes: pa.Array) -> pa.Array:
            keys = known.value

            def template(h: int) -> bool:
                k = bisect_left(keys, h)
                return k < len(keys) and keys[k] == h

            kept = [without(b.as_py(), a.as_py(), x.as_py(), p.as_py(), template) for b, a, x, p in zip(blocks, at, nodes, parents)]
            flat = hashes.flatten().to_numpy(zero_copy_only=False)
            hits = np.concatenate([[0], np.cumsum(np.isin(flat, keys))])
            ends = np.concatenate([[0], np.cumsum(hashes.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(np.diff(hits[ends]), pa.int64())], names=["text", "n"])

        out = read.select("id", "url", text("blocks", "at", "nodes", "parents", "hashes").alias("t"))
    else:
        own = read.select("page", F.explode("hashes").alias("hash")).distinct()
        gone = own.join(found, "hash").groupBy("page").agg(F.collect_list("hash").alias("gone"))

        @F.arrow_udf("text string, n long")
        def text(blocks: pa.Array, at: pa.Array, nodes: pa.Array, parents: pa.Array, gone: pa.Array) -> pa.Array:
            lists = [set(g.as_py() or ()) for g in gone]
            kept = [without(b.as_py(), a.as_py(), x.as_py(), p.as_py(), g.__contains__) for b, a, x, p, g in zip(blocks, at, nodes, parents, lists)]
            return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array([len(g) for g in lists], pa.int64())], names=["text", "n"])

        out = read.join(gone, "page", "left").select("id", "url", text("blocks", "at", "nodes", "parents", "gone").alias("t"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("t.text").alias("text"), F.length("t.text").cast("long").alias("n_chars"), F.col("t.n").alias("n_template"))
