"""Main text of HTML pages: site template removal, then the article's blocks.

Each page is parsed once into a tree. Its element subtrees are hashed; Spark
counts on how many different pages of a host each hash occurs. Subtrees that
recur on many pages of their host are templates, and the blocks under them go.
Structure settles the rest: the article where the page marks one, else the
body, without the elements whose tag or role says that they are furniture.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hot_join, materialise, shared_dir, table


@dataclass(frozen=True)
class TemplateConfig:
    """When a subtree is a template of its host.

    It must occur on ``least_pages`` different pages, and on ``least_share`` of
    the host's pages or on ``enough_pages``, whichever is less. Pages that
    are equal count once, so copies of a page make no template.
    """

    least_pages: int = 5
    least_share: float = 0.1
    enough_pages: int = 100
    #: At most so many subtrees (24 bytes each) are broadcast: those that each hold over 1 / ``hot_subtrees`` of all occurrences.
    hot_subtrees: int = 50_000
    #: Lists of templates of at most so many pages are broadcast, more are joined by shuffle.
    broadcast_pages: int = 100_000


# Fixed values of the HTML standard and of common usage.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table caption tbody td tfoot th thead tr ul".split()
)
#: Never part of the text.
DROP = frozenset(
    "script style template head title nav footer aside form button select textarea input iframe embed svg "
    "menu dialog search noembed noframes xmp".split()
)
#: Whole words of class, id or role that make a container furniture.
FURNITURE = frozenset(
    "nav navigation navbar menu menubar sidebar footer banner breadcrumb breadcrumbs pagination pager toolbar search searchbox login "
    "cookie cookies cookie-banner cookie-notice cookie-consent consent gdpr notice alert alertdialog popup modal overlay newsletter subscribe signup "
    "ad ads adv advert adverts advertisement advertising ad-slot ad-banner sponsor sponsored promo promotion outbrain taboola "
    "share sharing social share-buttons related related-posts related-articles recommended recommendations "
    "comment comments comment-list commentlist comments-area comment-section comment-form disqus disqus_thread respond "
    "site-nav site-menu site-footer site-header main-nav main-menu contentinfo complementary widget skip-link".split()
)
#: These count only where the page marks no article.
OUTSIDE = frozenset("masthead topbar title-bar header".split())
#: The elements that such words can mark; inside an article only these can be templates, as text blocks may recur by chance.
CONTAINER = frozenset("div section aside ul ol dl nav header footer form table figure details center".split())
#: Their subtrees hold the page itself.
PAGE = frozenset("html body main article".split())
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "figcaption"}
#: An opening tag closes these, up to the given border.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
ROWS = frozenset("tr tbody thead tfoot".split())
SCOPE = frozenset("table td th caption button object html".split())

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "hidden", "role", "tag")

    def __init__(self, tag: str, role: str = "", hidden: bool = False):
        self.tag, self.children = tag, []
        #: "furniture", or "outside" if only outside an article.
        self.role, self.hidden = role, hidden


def _marks(attributes: str) -> tuple[str, bool]:
    role, hidden = "", False
    for m in ATTRIBUTE.finditer(attributes):
        words = (m[2] or m[3] or m[4] or "").lower().split()
        if m[1].lower() == "hidden":
            hidden = True
        elif not FURNITURE.isdisjoint(words):
            role = "furniture"
        elif not role and not OUTSIDE.isdisjoint(words):
            role = "outside"
    return role, hidden


class _Open:
    """The open elements, with the places of each tag, so that no search walks the stack."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def cut(self, at: int) -> None:
        """Close everything from place ``at`` on; the root stays."""
        while len(self.stack) > max(1, at):
            self.places[self.stack.pop().tag].pop()

    def imply(self, tags, border) -> None:
        """Close the open ``tags`` inside the innermost ``border``."""
        while (at := self.last(tags)) > max(0, self.last(border)):
            self.cut(at)


def parse(page: str) -> Node:
    """A tree that closes what HTML lets authors leave open; a tag cut off at the end is dropped."""
    root = Node("html")
    open_ = _Open(root)
    at, size, last = 0, len(page), page.rfind(">")

    def text(s: str) -> None:
        if s:
            open_.stack[-1].children.append(html.unescape(s) if "&" in s else s)

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        nxt = page[lt + 1 : lt + 2]
        if not (nxt.isalpha() or nxt in "/!?") or nxt == "":
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if lt > last:  # cut off
            break
        if nxt in "!?" or nxt == "/" and not page[lt + 2 : lt + 3].isalpha():
            at = page.find(">", lt) + 1
            continue
        m = TAG.match(page, lt)
        if not m:  # an open quote: the tag ends at the next bracket
            end = page.find(">", lt)
            name = re.match(r"</?([A-Za-z][^\s/>]*)", page[lt : lt + 64])
            closing, tag, attributes, at = nxt == "/", name[1].lower(), "", end + 1
        else:
            closing, tag, attributes, at = m[1] == "/", m[2].lower(), m[3], m.end()
        if closing:
            if tag == "br":
                text(" ")
            else:
                place = open_.last((tag,))
                if place > 0 and (tag in SCOPE or tag in ROWS or place > open_.last(SCOPE)):
                    open_.cut(place)
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P:
            open_.imply({"p"}, SCOPE)
        if tag in IMPLIED:
            open_.imply(*IMPLIED[tag])
        if tag == "br":
            text(" ")
            continue
        node = Node(tag, *_marks(attributes)) if attributes and not attributes.isspace() else Node(tag)
        open_.stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*/?>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID:
            open_.push(node)
    return root


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def subtree_hashes(root: Node) -> dict[int, int]:
    """id of each element to the hash of its tag, text and children; elements without text have none."""
    out: dict[int, int] = {}
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, done = stack.pop()
        if not done:
            stack.append((node, True))
            stack += [(c, False) for c in node.children if isinstance(c, Node)]
        else:
            parts = [str(out.get(id(c), c.tag)) if isinstance(c, Node) else SPACE.sub(" ", c).strip() for c in node.children]
            if any(id(c) in out if isinstance(c, Node) else p for c, p in zip(node.children, parts, strict=True)):
                out[id(node)] = _hash(node.tag + "\0" + "\1".join(p for p in parts if p))
    return out


def _articles(root: Node) -> list[Node]:
    """The outermost article elements (unless all are marked, those not marked), else main elements, else the body."""
    for tag in ("article", "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.hidden or node.tag in DROP and node.tag != "form" or node.role == "furniture" and node.tag in CONTAINER:
                continue
            if node.tag == tag:
                found.append(node)
            else:
                stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return [n for n in found if n.role != "furniture"] or found
    return [root]


def page_parts(page: str | None) -> tuple[int, list[str], list[tuple[int, int, int]]]:
    """(hash of the page, its blocks, its subtrees), structure applied.

    A subtree is (hash, from, to): it holds the blocks ``from`` to ``to - 1``,
    or none where structure alone leaves it out. In an article only containers
    are listed, outside one any block element.
    """
    root = parse(page or "")
    hashes = subtree_hashes(root)
    articles = {id(a) for a in _articles(root)}
    whole = id(root) in articles
    blocks: list[str] = []
    subtrees: list[tuple[int, int, int]] = []
    run: list[str] = []

    def flush() -> None:
        line = SPACE.sub(" ", "".join(run)).strip()
        if line:
            blocks.append(line)
        run.clear()

    # (node, inside an article, kept so far), or (hash, first block) at the end of a block element
    todo: list[tuple] = [(root, whole, whole)]
    while todo:
        node, *rest = todo.pop()
        if not isinstance(node, Node):
            if isinstance(node, str):
                run.append(node)
                continue
            flush()
            if node is not None:
                subtrees.append((node, rest[0], len(blocks)))
            continue
        inside, kept = rest
        if id(node) in articles:
            inside = kept = True
        elif kept:
            marked = node.role if node.tag in CONTAINER or node.tag == "article" else ""
            kept = not (node.tag in DROP or node.hidden or marked == "furniture" or whole and (marked == "outside" or node.tag == "header"))
        if node.tag in BLOCK or not kept:
            flush()
            listed = id(node) in hashes and node.tag not in PAGE and (node.tag in CONTAINER or (whole or not inside) and node.tag in BLOCK)
            todo.append((hashes[id(node)] if listed else None, len(blocks)))
        for c in reversed(node.children):
            if isinstance(c, Node):
                todo.append((c, inside, kept))
            elif kept:
                todo.append((c,))
    flush()
    return hashes.get(id(root), 0), blocks, subtrees


def main_text(page: str | None, templates: frozenset[int] = frozenset()) -> str:
    """The page's blocks without those of ``templates``, joined by line breaks."""
    _, blocks, subtrees = page_parts(page)
    gone = {k for h, a, b in subtrees if h in templates for k in range(a, b)}
    return "\n".join(b for k, b in enumerate(blocks) if k not in gone)


def parsed(pages: DataFrame, columns: list[str]) -> DataFrame:
    """(_row, _key, _host, _page, _blocks, _subtrees): ``columns`` of ``pages`` as one struct, a row's number, its host, its hash, its parts."""
    kind = pa.struct([("page", pa.int64()), ("blocks", pa.list_(pa.string())), ("subtrees", pa.list_(pa.struct([("hash", pa.int64()), ("from", pa.int32()), ("to", pa.int32())])))])

    @F.arrow_udf("struct<page:long,blocks:array<string>,subtrees:array<struct<hash:long,from:int,to:int>>>")
    def parts(texts: pa.Array) -> pa.Array:
        return pa.array([page_parts(t.as_py()) for t in texts], kind)  # one page at a time as a Python string

    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    out = pages.select(F.struct(*columns).alias("_row"), F.monotonically_increasing_id().alias("_key"), host.alias("_host"), parts.asNondeterministic()("html").alias("_parts"))
    return out.select("_row", "_key", "_host", F.col("_parts.page").alias("_page"), F.col("_parts.blocks").alias("_blocks"), F.col("_parts.subtrees").alias("_subtrees"))


def templates(found: DataFrame, sizes: DataFrame, cfg: TemplateConfig) -> DataFrame:
    """(host, hash, n) of the subtrees that recur, from (host, page, hash) and (host, total).

    Counts are of different pages. Only hosts of few pages need their size:
    beyond ``enough_pages / least_share`` the absolute count decides.
    """
    counts = found.select("host", "hash", "page").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= cfg.least_pages)
    small = sizes.where(F.col("total") * cfg.least_share < cfg.enough_pages)
    return counts.join(small, "host", "left").where((F.col("n") >= cfg.enough_pages) | (F.col("n") >= cfg.least_share * F.col("total"))).select("host", "hash", "n")


def extract(pages: DataFrame, cfg: TemplateConfig | None = None, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``pages`` (all unless given) with ``_text``, the main text ("" if none).

    ``_n_lost`` counts the blocks that templates took, beyond what structure
    leaves out anyhow.

    A null html is empty. A page without a host (null or malformed url) has no
    site template; structure alone decides there. Whole pages are read, and
    parsed once; other columns stay as they are, repeated rows stay repeated.
    """
    cfg = cfg or TemplateConfig()
    base = shared_dir(pages.sparkSession)
    columns = columns or pages.columns
    rows = materialise(parsed(pages, columns), base, "parsed")
    hosted = rows.where("_host is not null").select("_key", F.col("_host").alias("host"), F.col("_page").alias("page"), "_subtrees")
    found = hosted.select("_key", "host", "page", F.explode("_subtrees").alias("s")).select("_key", "host", "page", "s.hash", F.col("s.from").alias("a"), F.col("s.to").alias("b"))
    sizes = hosted.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("total"))
    known = materialise(templates(found, sizes, cfg), base, "templates")
    limit = found.count() / cfg.hot_subtrees
    hot = known.where(F.col("n") > limit).select("host", "hash")
    hits = hot_join(found.where("a < b"), known.select("host", "hash"), hot, ["host", "hash"])
    gone = materialise(hits.groupBy("_key").agg(F.collect_list(F.struct("a", "b")).alias("_gone")), base, "gone")
    out = rows.join(F.broadcast(gone) if gone.count() <= cfg.broadcast_pages else gone, "_key", "left")
    kept = F.when(F.col("_gone").isNull(), F.col("_blocks")).otherwise(F.filter("_blocks", lambda x, i: ~F.exists("_gone", lambda g: (g["a"] <= i) & (i < g["b"]))))
    out = out.withColumn("_kept", kept)
    return out.select("_row.*", F.array_join("_kept", "\n").alias("_text"), (F.size("_blocks") - F.size("_kept")).alias("_n_lost"))


def op7(spark, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    out = extract(table(spark, sf_dir, "pages"), columns=["page_id", "url"])
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"), F.col("_n_lost").cast("long").alias("n_template_blocks"))
