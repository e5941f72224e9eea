"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: an element is the path of its
tags and attribute names, and each element knows how many different pages hold
it, in which presentations (orders of child elements) and with which texts.
An element whose presentations and texts are the same on most pages carries
little information (its entropy over pages is low), so it belongs to the
template and its branch goes from every page. What markup itself declares
(navigation, footers, forms, adverts, comments, the article) is a prior that
stands above the entropies.

A worker turns a page into a small tree; the merging, the counts and the
entropies over pages are grouped aggregations. Copies of a page, told by their
longest block of text, count once, so that copies don't look like templates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import sized, slices, stored

#: Share of an element's importance that each further child hands from its texts to its presentations.
DECAY = 0.9
#: Elements below this importance, seen on so many different pages, are template.
LOW, MIN_PAGES = 0.2, 3
SLICE_BYTES = 2 << 20
BROADCAST_BYTES = 64 << 20

# Elements of HTML by what they mean for the main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
PROSE = frozenset("article main section header h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd blockquote pre table tbody thead tfoot tr caption figure figcaption div body".split())
#: An element that starts while one of these is open, within the given limits, ends it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NOISE_TAGS = frozenset("nav footer aside form button select textarea input label fieldset dialog menu noscript template head title script style iframe object embed svg canvas audio video map option".split())
NOISE_ROLES = frozenset("navigation contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs"
    " footer sidebar widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing"
    " social related recommended recommendations comment comments reply replies respond disqus form login search pagination pager toolbar masthead".split()
)
#: Noise unless it stands inside the main text.
TOP_TAGS, TOP_NAMES, TOP_ROLES = frozenset({"header"}), frozenset({"header", "banner", "masthead"}), frozenset({"banner"})
MAIN_IDS = frozenset("content main article post main-content maincontent".split())

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|<[a-zA-Z!?/][^>]*+\Z""", re.S
)
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_KEPT_ATTRS = ("class", "id", "role", "itemprop", "hidden", "aria-hidden", "style")


@dataclass
class Node:
    """A block element, or an inline element that declares something: its parent's number, its label, the hash of its path."""

    parent: int
    tag: str
    label: str
    path: int
    noise: bool = False
    by_name: bool = False
    top: bool = False
    main: int = 0
    plain: bool = True
    children: list[str] = field(default_factory=list)


def _mark(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        name = name.lower()
        if name in _KEPT_ATTRS and name not in out:
            out[name] = unescape(value.strip("\"'")).lower()
    return out


def _node(parent: int, tag: str, raw: str, nodes: list[Node]) -> Node:
    above = nodes[parent].path
    attrs = _attributes(raw) if "=" in raw or "hidden" in raw else {}
    if not attrs:
        return Node(parent, tag, tag, _mark(f"{above}/{tag}"), tag in NOISE_TAGS, False, tag in TOP_TAGS, {"article": 1, "main": 2}.get(tag, 0))
    named = (attrs.get("class", "") + " " + attrs.get("id", "")).split()
    parts = [x for n in named for x in ([] if n.startswith(("has-", "with-", "no-", "without-", "has_", "with_", "no_")) else _NAME.split(n))]
    roles = set(attrs.get("role", "").split())
    gone = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")
    by_name = not NOISE_NAMES.isdisjoint(parts)
    main = 1 if tag == "article" or attrs.get("itemprop") == "articlebody" else 2 if tag == "main" or "main" in roles else 3 if attrs.get("id") in MAIN_IDS else 0
    label = tag + "".join("." + _DIGITS.sub("0", n) for n in sorted(named))
    return Node(
        parent, tag, label, _mark(f"{above}/{label}"), tag in NOISE_TAGS or gone or not NOISE_ROLES.isdisjoint(roles), by_name,
        tag in TOP_TAGS or not TOP_NAMES.isdisjoint(parts) or not TOP_ROLES.isdisjoint(roles), main, not named,
    )


@dataclass
class Page:
    """nodes in page order, parents first; blocks of (number of the node, pieces of (number of the node, text, within a link))."""

    nodes: list[Node]
    blocks: list[tuple[int, list[tuple[int, str, bool]]]]


def parse(html: str) -> Page:
    """The tree of a page's blocks. Wrong nesting, missing end tags and a page that breaks off are taken as browsers mostly do."""
    nodes = [Node(-1, "", "", 0)]
    blocks: list[tuple[int, list[tuple[int, str, bool]]]] = []
    stack: list[tuple[str, int]] = [("", 0)]  # open elements and their nodes; plain inline elements have that of their parent
    here: list[tuple[int, str, bool]] = []
    owner = links = at = 0
    match = _TAG.search

    def close(depth: int) -> None:
        nonlocal links
        for name, _ in stack[depth:]:
            if name == "a":
                links -= 1
        del stack[depth:]

    def flush() -> None:
        nonlocal here, owner
        if here:
            blocks.append((owner, here))
            here = []

    def block_of() -> int:
        return next(n for name, n in reversed(stack) if not name or name in BLOCK)

    while True:
        m = match(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            if not here:
                owner = block_of()
            here.append((stack[-1][1], unescape(text) if "&" in text else text, links > 0))
        if not m:
            break
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        tag, ends, raw = name.lower(), m.group(1) or m.group(4), m.group(3) if m.group(2) else m.group(6)
        block = tag in BLOCK
        if ends:
            depth = len(stack) - 1
            while depth and stack[depth][0] != tag and (block or stack[depth][0] not in BLOCK):
                depth -= 1
            if depth and stack[depth][0] == tag:
                if block or any(n in BLOCK for n, _ in stack[depth:]):
                    flush()
                close(depth)
                if tag in ("td", "th"):
                    here.append((stack[-1][1], " ", False))
            continue
        if block or tag in ENDS:
            if block:
                flush()
            targets, limits = ENDS.get(tag, ({"p"}, BLOCK - {"p"}))
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in targets:
                    close(depth)
                    break
                if stack[depth][0] in limits or stack[depth][0] in ("table", "button"):
                    break
        if tag in VOID:
            if tag in ("br", "wbr", "img") and here and tag != "wbr":
                here.append((stack[-1][1], " ", False))
            continue
        above = stack[-1][1]
        if block or tag in NOISE_TAGS or raw and ("=" in raw or "hidden" in raw):
            node = _node(above, tag, raw, nodes)
            if block or node.noise or node.by_name or node.main:
                nodes[above].children.append(node.label)
                nodes.append(node)
                above = len(nodes) - 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            if not end:
                break
            at = end.start()
            continue_at = html.find(">", at)
            if continue_at < 0:
                break
            at = continue_at + 1
            continue
        if not raw.endswith("/") or block:
            stack.append((tag, above))
            links += tag == "a"
        if tag in ("td", "th") and here:
            here.append((above, " ", False))
    flush()
    return Page(nodes, blocks)


@dataclass
class Reading:
    """What markup declares: blocks of the main text as (path, text, open), where open says that entropies may still remove it."""

    blocks: list[tuple[int, str, bool]]


def _inside(nodes: list[Node], flag: list[bool]) -> list[bool]:
    out: list[bool] = []
    for i, n in enumerate(nodes):
        out.append(flag[i] or (n.parent >= 0 and out[n.parent]))
    return out


def _shown(page: Page, hidden: list[bool], inside: list[bool] | None, links: bool) -> list[tuple[int, str]]:
    out = []
    for owner, pieces in page.blocks:
        if hidden[owner] or inside is not None and not inside[owner]:
            continue
        text = " ".join("".join(t for n, t, _ in pieces if not hidden[n]).split())
        if text and (links or any(t.strip() for n, t, a in pieces if not a and not hidden[n])):
            out.append((owner, text))
    return out


def read(page: Page) -> Reading:
    """Blocks inside the declared main text, without declared noise.

    The main text is what article elements hold, else main, else a block that
    is called content or the like, else the body. An element whose name speaks
    of noise but which holds the only main text counts as a frame. Without a
    declared main text, blocks that are links alone are menus.
    """
    nodes = page.nodes
    hard = _inside(nodes, [n.noise for n in nodes])
    soft = _inside(nodes, [n.noise or n.by_name for n in nodes])
    for tier in (1, 2, 3):
        for hidden in (soft, hard):
            roots = [n.main == tier and not hidden[i] for i, n in enumerate(nodes)]
            if not any(roots):
                continue
            inside = _inside(nodes, roots)
            frame = [False] * len(nodes)
            for i in range(len(nodes) - 1, 0, -1):
                if roots[i] or frame[i]:
                    frame[nodes[i].parent] = True
            gone = _inside(nodes, [n.noise or (n.by_name and not frame[i] and not (roots[i] and hidden is hard)) for i, n in enumerate(nodes)])
            shown = _shown(page, gone, inside, True)
            if shown:
                # Plain prose below the root is the author's; only what has a name of its own may be template.
                prose = _prose(nodes, roots)
                return Reading([(nodes[o].path, t, not prose[o]) for o, t in shown])
    gone = _inside(nodes, [n.noise or n.by_name or n.top for n in nodes])
    return Reading([(nodes[o].path, t, True) for o, t in _shown(page, gone, None, False)])


def _prose(nodes: list[Node], roots: list[bool]) -> list[bool]:
    out: list[bool] = []
    for i, n in enumerate(nodes):
        out.append(roots[i] or (n.parent >= 0 and out[n.parent] and n.plain and n.tag in PROSE))
    return out


def page_tree(page: Page) -> dict[int, tuple[str, int, set[str]]]:
    """Of each path of a page: its presentation (orders of children, repeats once), its children, its texts."""
    orders: dict[int, list[str]] = {}
    children: dict[int, int] = {}
    for n in page.nodes[1:]:
        runs = [c for i, c in enumerate(n.children) if not i or n.children[i - 1] != c]
        orders.setdefault(n.path, []).append(" ".join(runs))
        children[n.path] = max(children.get(n.path, 0), len(set(runs)))
    texts: dict[int, set[str]] = {}
    for owner, pieces in page.blocks:
        text = " ".join("".join(t for _, t, _ in pieces).split())
        if text:
            texts.setdefault(page.nodes[owner].path, set()).add(text)
    return {p: ("|".join(sorted(set(o))), children[p], texts.get(p, set())) for p, o in orders.items()}


def _host() -> Column:
    return F.lower(F.try_parse_url(F.col("url").cast("string"), F.lit("HOST")))


def _keyed(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), _host().alias("host"), F.xxhash64(html).alias("mark"))


_TREES = "host string, mark long, lead long, nodes array<struct<path:long,presentation:long,children:int,texts:array<long>>>, open array<long>"


def page_trees(pages: DataFrame) -> DataFrame:
    """host, mark (hash of the html), lead (hash of the longest block), nodes and open paths of each page with a host, hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for whole in batches:
            for part in slices(whole, "html", SLICE_BYTES):
                rows = []
                for host, mark, html in zip(*(part.column(c).to_pylist() for c in ("host", "mark", "html")), strict=True):
                    page = parse(html)
                    tree = page_tree(page)
                    reading = read(page)
                    lead = max((t for _, t, _ in reading.blocks), key=lambda t: (len(t), t), default="")
                    nodes = [{"path": p, "presentation": _mark(o), "children": c, "texts": [_mark(t) for t in ts]} for p, (o, c, ts) in tree.items()]
                    rows.append({"host": host, "mark": mark, "lead": _mark(lead), "nodes": nodes, "open": sorted({p for p, _, is_open in reading.blocks if is_open})})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    nodes = pa.list_(pa.struct([("path", pa.int64()), ("presentation", pa.int64()), ("children", pa.int32()), ("texts", pa.list_(pa.int64()))]))
    arrow = pa.schema([("host", pa.string()), ("mark", pa.int64()), ("lead", pa.int64()), ("nodes", nodes), ("open", pa.list_(pa.int64()))])
    return _keyed(pages).where("host IS NOT NULL").select("host", "mark", "html").mapInArrow(run, _TREES)


def site_tree(trees: DataFrame) -> DataFrame:
    """host, path, pages (different ones that hold it), presentation, content and importance of each element, from 0 to 1.

    presentation is the entropy of the element's presentations over pages, to
    the base of their number; content is one less the mean, over the element's
    texts as often as they occur, of the entropy of the pages that hold them.
    An element with n kinds of children takes DECAY^n of its importance from
    its content and the rest from its presentation; without texts, all of it
    from its presentation. An element of one page has importance 1. Copies
    (pages of one host with the same longest block) count once.
    """
    node = trees.select("host", "lead", F.explode("nodes").alias("n")).select("host", "lead", "n.*")
    facts = F.concat(
        F.array(F.struct(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("presentation").alias("value"))),
        F.transform("texts", lambda t: F.struct(F.lit(2).alias("kind"), t.alias("value"))),
    )
    rows = node.select("host", "lead", "path", "children", F.explode(facts).alias("f")).select("host", "path", "lead", "f.kind", "f.value", "children")
    # Equal facts of one page's copies meet first, so a fact of a whole host is spread over its pages' hashes.
    once = rows.groupBy("host", "path", "kind", "value", "lead").agg(F.max("children").alias("children"))
    counts = once.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("children").alias("children"))
    part = lambda k, x: F.sum(F.when(F.col("kind") == k, x))
    n = F.col("n").cast("double")
    grouped = counts.groupBy("host", "path").agg(
        part(0, F.col("n")).alias("pages"), part(0, F.col("children")).alias("children"),
        part(1, n * F.log(n)).alias("shown"), part(1, n).alias("shows"), part(2, n * F.log(n)).alias("told"), part(2, n).alias("tells"),
    )
    base = F.log(F.col("pages").cast("double"))
    one = F.col("pages") <= 1
    # Copies that differ in presentation make more presentations than pages; entropy is of their shares.
    presentation = F.when(one, 1.0).otherwise(F.least(F.lit(1.0), (F.log("shows") - F.col("shown") / F.col("shows")) / base))
    content = F.when(F.col("tells").isNull(), None).when(one, 1.0).otherwise(1 - F.col("told") / F.col("tells") / base)
    share = F.pow(F.lit(DECAY), F.col("children") / F.col("pages"))
    scored = grouped.select("host", "path", "pages", presentation.alias("presentation"), content.alias("content"), share.alias("share"))
    return scored.select(
        "host", "path", "pages", "presentation", "content",
        F.coalesce((1 - F.col("share")) * F.col("presentation") + F.col("share") * F.col("content"), F.col("presentation")).alias("importance"),
    )


def template_paths(trees: DataFrame) -> DataFrame:
    """host and path of elements of low importance."""
    return site_tree(trees).where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < LOW) & F.col("content").isNotNull()).select("host", "path")


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if its counted bytes are few."""
    return F.broadcast(df) if sized(df) <= BROADCAST_BYTES else df


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of each row of pages: the blocks of the main text, in page order, joined by line feeds.

    White space inside a block is one space; character references are decoded
    once. A null, empty or textless html gives an empty text; a null or broken
    url has no host, so its page is judged by its markup alone, as is the only
    page of a host. Repeated rows give equal rows; other columns are dropped;
    an empty table gives no rows. A page is one row and one tree in a worker.
    If entropies would leave nothing of a page, what markup declares stays.
    """
    trees = stored(page_trees(pages), "trees")
    low = stored(template_paths(trees), "template")
    doubt = trees.select("host", "mark", F.explode("open").alias("path")).join(_small(low), ["host", "path"])
    gone = stored(doubt.groupBy("host", "mark").agg(F.collect_set("path").alias("gone")), "gone")
    rows = _keyed(pages).join(_small(gone), ["host", "mark"], "left").select("page_id", "url", "html", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "html", SLICE_BYTES):
                texts = []
                for html, template in zip(part.column("html").to_pylist(), part.column("gone").to_pylist(), strict=True):
                    blocks = read(parse(html)).blocks
                    if template:
                        out = set(template)
                        blocks = [b for b in blocks if not b[2] or b[0] not in out] or blocks
                    texts.append("\n".join(t for _, t, _ in blocks))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
