"""Main text of web pages by wrapper induction.

Every page is parsed into a tree and summed up in a guide: one node for each path of tags and classes, with hashes of
the texts that stand there.  Pages of a host whose guides have the same containers share a layout.  The guide of a
layout's first page is its reference; the guides of all its other pages are aligned with it by simple tree matching:
the heaviest set of pairs of nodes that keeps ancestors and order.  Two children may be a pair if tag and name are
equal, or if neither has its name on the other side and they are the same one of that tag among such.  Texts that
stand at the same place of nearly all pages which have that place are the layout's template; the place that most
pages' own reading takes for the article is its slot.  A page then gives the blocks of its slot that aren't template.
Layouts of fewer than ``PAGES`` different pages use the wrapper of their whole host, made in the same way; a page
that aligns with its reference in less than ``ALIGNED`` of its nodes uses its own slot.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are known by their
elements and class names.  An element with such a class name that holds an article or main element counts as any other,
and a page that has no text but under such names is read by its elements alone.

Copies of a page count once for the template, pages without text not at all, and hosts with fewer than ``PAGES``
different pages have none, nor do pages without a host: these are read on their own.  A null html gives an empty text; a
null url has no host; repeated rows give repeated results, an empty table none.  Nothing is cut, however long or deep a
page is: time and memory grow with its nodes.
"""

from __future__ import annotations

import bisect
import html as entities
import pickle
import re
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import map_texts, salted_join, stored

#: Different pages from which a host has a template; the share of them that hold a text of it, or agree on a slot.
PAGES, TEMPLATE, SLOT = 4, 0.9, 0.5
#: The share of a page's nodes that have a partner in a reference that it trusts.
ALIGNED = 0.5
#: Levels of named containers that make a layout.
LEVELS = 4
#: The share of the text that leads from a container to one of its parts, where no element says what the article is.
DESCENT = 0.7
#: Bytes of all wrappers together that are broadcast; beyond that pages are joined with them by shuffle.
BROADCAST_BYTES = 16_000_000

# Fixed names of elements and words of class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("nav footer aside form script style noscript template iframe head title button select textarea input svg canvas object dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup comment comments discussion disqus respond reply replies"
    " share sharing social related recommended footer header masthead toolbar pagination pager login search widget skip".split()
)
#: Of these, the ones that count within an article for what is text by its tag, and those that don't count there at all.
KINDS = frozenset("ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup comment comments disqus respond reply replies".split())
TEXTUAL, OWN = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th figure figcaption".split()), frozenset(("header",))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: A start tag of these closes an open one of the same set, up to the container after the colon.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend"}
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S)
#: A name and its value; values are taken along, so that no name is found within one.
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBER = re.compile(r"(?=[0-9a-f-]*[0-9])[0-9a-f]{6,}|[0-9]+")
MAIN = frozenset(("article", "main"))
#: Tags that hold others, whose names make a layout.
CONTAINERS = frozenset("body div main article section header center table".split())


@dataclass(eq=False)
class Node:
    tag: str
    name: str = ""
    noise: bool = False
    named: bool = False  # noise by its name alone
    parent: Node | None = None
    children: list = field(default_factory=list)
    guide: int = -1


def _named(tag: str, attributes: str, inside: bool = False) -> tuple[str, bool, bool]:
    """The class (or id) of an element, its numbers as #, whether it is no part of the article, and whether its name alone
    says so; ``inside`` an article fewer names do."""
    name, noise, named, seen = "", tag in SKIPPED, False, set()
    words = (KINDS if tag in TEXTUAL else NOISE - OWN) if inside else NOISE
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in seen:
                continue  # of repeated attributes the first counts
            seen.add(key)
            if key == "hidden" or (key == "role" and value.lower() in ROLES):
                noise = True
            elif key in ("class", "id"):
                name = name or value
                named = named or not words.isdisjoint(x.lower() for x in _NAME_PARTS.findall(value))
    return _NUMBER.sub("#", name), noise or named, named and not noise


class _Path:
    """The open elements, and for each tag how deep they are, so that none is looked for by walking."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.deep, self.named = [root], {}, []

    @property
    def here(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.deep.setdefault(node.tag, []).append(len(self.nodes))
        if node.named:
            self.named.append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        node = self.nodes.pop()
        self.deep[node.tag].pop()
        if self.named and self.named[-1] == len(self.nodes):
            self.named.pop()

    def deepest(self, tags) -> int:
        """The depth of the innermost open element of these tags, 0 without one."""
        return max((self.deep[t][-1] for t in tags if self.deep.get(t)), default=0)

    def close(self, tags, until=()) -> None:
        """Close the innermost element of these tags, unless one of ``until`` is within it."""
        at = self.deepest(tags)
        if at and at > self.deepest(until):
            while len(self.nodes) > at:
                self.pop()

    def holds_main(self) -> None:
        """The open elements that are noise by their names alone are none: each is looked at once."""
        for at in self.named:
            self.nodes[at].named = self.nodes[at].noise = False
        self.named.clear()


def parse(html: str) -> Node:
    """The tree of a page; unclosed and stray tags are taken as browsers do, roughly."""
    root = Node("html")
    path, at, raw = _Path(root), 0, None
    while at < len(html):
        if raw:
            end = re.compile(rf"</{raw}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else len(html)
            path.here.children.append(html[at:stop])
            path.close((raw,))
            at, raw = (html.find(">", stop) + 1 or len(html)) if end else len(html), None
            continue
        m = _TAG.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            path.here.children.append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            path.close((tag,))
            continue
        if tag == "html" or (tag == "body" and path.deepest(("body",))):
            continue
        if tag in _CLOSES_P:
            path.close(("p",), ("td", "th", "table", "button", "object"))
        if tag in HEADINGS and path.here.tag in HEADINGS:
            path.pop()
        if tag in _CLOSES:
            path.close(*_CLOSES[tag])
        if tag == "body":
            path.close(("head",))
        name, noise, named = _named(tag, m[3], bool(path.deepest(MAIN)))
        node = Node(tag, name, noise, named, path.here)
        if tag in MAIN:
            path.holds_main()
        path.here.children.append(node)
        if tag in RAW and not m[3].rstrip().endswith("/"):
            path.push(node)
            raw = tag
        elif tag not in VOID:
            path.push(node)
    return root


@dataclass
class Block:
    text: str
    node: Node
    links: int


def blocks(top: Node) -> list[Block]:
    """The blocks of text that aren't within anything to be skipped, in order, and how much of each is links."""
    out: list[Block] = []
    parts: list[str] = []
    owner, links = top, 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, owner, links))
        parts.clear()
        links = 0

    stack: list[tuple[Node, int, bool]] = [(top, 0, False)]
    while stack:
        node, i, link = stack.pop()
        if i == 0 and node.tag in BLOCK:
            flush()
            owner = node
        done = True
        for j in range(i, len(node.children)):
            child = node.children[j]
            if isinstance(child, str):
                parts.append(child)
                links += len(child) * link
            elif child.noise and child is not top:
                if child.tag in BLOCK:
                    flush()
            elif child.tag in ("br", "hr"):
                parts.append(" ")
                if child.tag == "hr":
                    flush()
            elif child.tag not in VOID:
                stack.append((node, j + 1, link))
                stack.append((child, 0, link or child.tag == "a"))
                done = False
                break
        if done:
            if node.tag in BLOCK:
                flush()
                owner = node.parent or top
            elif i == 0 and not node.children:
                pass
    flush()
    return out


@dataclass
class Guide:
    """One node for each path of tags and names: parents, tags and names of nodes, and the hashes of their texts."""

    parent: list[int]
    tag: list[str]
    name: list[str]
    hashes: list[list[int]]
    nodes: list[list[Node]]
    slot: int = 0

    @property
    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.parent]
        for i, p in enumerate(self.parent):
            if p >= 0:
                out[p].append(i)
        return out


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def guide_of(top: Node, own: list[Block]) -> Guide:
    g = Guide([-1], [top.tag], [top.name], [[]], [[top]])
    known: dict[tuple[int, str, str], int] = {}
    top.guide = 0
    stack = [top]
    while stack:
        node = stack.pop()
        for child in node.children:
            if isinstance(child, Node) and child.tag in BLOCK and not child.noise:
                key = (node.guide, child.tag, child.name)
                if key not in known:
                    known[key] = len(g.parent)
                    g.parent.append(node.guide)
                    g.tag.append(child.tag)
                    g.name.append(child.name)
                    g.hashes.append([])
                    g.nodes.append([])
                child.guide = known[key]
                g.nodes[child.guide].append(child)
                stack.append(child)
            elif isinstance(child, Node) and not child.noise:  # inline: its blocks belong to the same place
                child.guide = node.guide
                stack.append(child)
    for b in own:
        g.hashes[b.node.guide].append(text_hash(b.text))
    g.slot = own_slot(g, own)
    return g


def own_slot(g: Guide, own: list[Block]) -> int:
    """Where this page alone would look for its article."""
    size = np.zeros(len(g.parent))
    for b in own:
        size[b.node.guide] += max(0, len(b.text) - b.links)
    for i in range(len(g.parent) - 1, 0, -1):  # children come after their parents
        size[g.parent[i]] += size[i]
    for tag in ("article", "main"):
        named = [i for i, t in enumerate(g.tag) if t == tag]
        if named and size[named].max() > 0:
            return max(named, key=lambda i: size[i])
    here, children = 0, g.children
    while children[here]:
        best = max(children[here], key=lambda i: size[i])
        if size[best] < DESCENT * size[here] or size[best] == 0 or g.tag[best] in ("p", "ul", "ol", "table"):
            break
        here = best
    return here


def _options(a: Guide, b: Guide, x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """The pairs (place in x, place in y) of children that may be partners, in order."""
    there = {(b.tag[j], b.name[j]): q for q, j in enumerate(y)}
    held = {(a.tag[i], a.name[i]) for i in x}
    free: dict[str, list[int]] = {}
    for q, j in enumerate(y):
        if (b.tag[j], b.name[j]) not in held:
            free.setdefault(b.tag[j], []).append(q)
    out, taken = [], dict.fromkeys(free, 0)
    for p, i in enumerate(x):
        tag = a.tag[i]
        if (q := there.get((tag, a.name[i]))) is not None:
            out.append((p, q))
        elif taken.get(tag, 0) < len(free.get(tag, ())):
            out.append((p, free[tag][taken[tag]]))
            taken[tag] += 1
    return out


def _heaviest(pairs: list[tuple[int, int]], weights: list[float]) -> tuple[float, list[tuple[int, int]]]:
    """Of pairs, of which none shares a place with another, the heaviest part that doesn't cross."""
    # Ends q with the weight up to there, both increasing; beside each its pair and the one before.
    ends: list[int] = []
    best: list[tuple[float, int]] = []
    before: list[int] = []
    for n, (_, q) in enumerate(pairs):
        at = bisect.bisect_left(ends, q)
        total = weights[n] + (best[at - 1][0] if at else 0.0)
        before.append(best[at - 1][1] if at else -1)
        stop = at
        while stop < len(ends) and best[stop][0] <= total:
            stop += 1
        ends[at:stop], best[at:stop] = [q], [(total, n)]
    if not best:
        return 0.0, []
    out, n = [], best[-1][1]
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return best[-1][0], out


def aligned(a: Guide, b: Guide) -> dict[int, int]:
    """Simple tree matching: the pairs (node of a, node of b) of the heaviest match from the roots down."""
    if a.tag[0] != b.tag[0]:
        return {}
    ca, cb = a.children, b.children
    # Each node of a has one possible partner for each of its parent's; parents have one, so all pairs are few.
    met, stack = [], [(0, 0)]
    options: dict[int, list[tuple[int, int]]] = {}
    while stack:
        i, j = stack.pop()
        met.append((i, j))
        options[i] = _options(a, b, ca[i], cb[j])
        stack += [(ca[i][p], cb[j][q]) for p, q in options[i]]
    weight: dict[int, float] = {}
    chosen: dict[int, list[tuple[int, int]]] = {}
    for i, j in reversed(met):  # children come after their parents
        total, chosen[i] = _heaviest(options[i], [weight[ca[i][p]] for p, _ in options[i]])
        weight[i] = 1.0 + (a.name[i] == b.name[j]) + total
    out, stack = {}, [(0, 0)]
    while stack:
        i, j = stack.pop()
        out[i] = j
        stack += [(ca[i][p], cb[j][q]) for p, q in chosen[i]]
    return out


def layout_of(g: Guide) -> int:
    """A hash of the named containers of the upper levels."""
    depth, paths = [0] * len(g.parent), [""] * len(g.parent)
    held = []
    for i in range(1, len(g.parent)):
        up = g.parent[i]
        depth[i] = depth[up] + 1
        if depth[i] <= LEVELS and g.tag[i] in CONTAINERS:
            paths[i] = f"{paths[up]}/{g.tag[i]}.{g.name[i]}"
            if g.name[i] or g.tag[i] in MAIN:
                held.append(paths[i])
    return text_hash("|".join(sorted(held)))


def read_page(html: str | None) -> tuple[Guide, list[Block]]:
    top = parse(html or "")
    own = blocks(top)
    if not own and _unnamed(top):
        own = blocks(top)
    return guide_of(top, own), own


def _unnamed(top: Node) -> bool:
    """Elements that only their names tell from the article count as any other; whether there are any."""
    found, stack = False, [top]
    while stack:
        for child in stack.pop().children:
            if isinstance(child, Node):
                if child.named:
                    child.named = child.noise = False
                    found = True
                stack.append(child)
    return found


@dataclass
class Wrapper:
    """A layout's reference guide, its slot (-1: none), and the template: (node, hash)."""

    guide: Guide
    slot: int
    template: set[tuple[int, int]]


def main_text(html: str | None, wrapper: Wrapper | None = None) -> str:
    return text_of(*read_page(html), wrapper)


def text_of(g: Guide, own: list[Block], wrapper: Wrapper | None = None) -> str:
    to = aligned(g, wrapper.guide) if wrapper else {}
    trusted = len(to) >= ALIGNED * len(g.parent)
    roots = {i for i, j in to.items() if j == wrapper.slot} if wrapper and trusted else set()

    def within(roots: set[int]) -> list[str]:
        inside = np.zeros(len(g.parent), bool)
        for i in range(len(g.parent)):
            inside[i] = i in roots or (i > 0 and inside[g.parent[i]])
        template = wrapper.template if wrapper else ()
        return [b.text for b in own if inside[b.node.guide] and (to.get(b.node.guide), text_hash(b.text)) not in template]

    return "\n".join((roots and within(roots)) or within({g.slot}))


def _packed(g: Guide) -> bytes:
    return pickle.dumps((g.parent, g.tag, g.name, g.hashes, g.slot))


def _unpacked(packed: bytes) -> Guide:
    parent, tag, name, hashes, slot = pickle.loads(packed)
    return Guide(parent, tag, name, hashes, [], slot)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def induced(pages: DataFrame) -> DataFrame:
    """(host, wrappers) from (host, html): those of its layouts, and of itself (layout 0), that have enough different pages."""

    def guides(texts: list) -> tuple[list, list, list]:
        own = [read_page(t)[0] for t in texts]
        return [_packed(g) for g in own], [text_hash(str(g.hashes)) if any(g.hashes) else None for g in own], [layout_of(g) for g in own]

    rows = map_texts(pages.filter(F.col("host") != ""), ["host"], "guide binary, content bigint, layout bigint", guides, "html")
    rows = rows.filter("content is not null").groupBy("host", "layout", "content").agg(F.any_value("guide").alias("guide"))
    rows = stored(rows, "guides")
    every = rows.withColumn("layout", F.explode(F.array("layout", F.lit(0).cast("long")))).withColumn("group", F.xxhash64("host", "layout"))
    groups = every.groupBy("group").agg(F.first("host").alias("host"), F.first("layout").alias("layout"), F.min_by("guide", "content").alias("reference"), F.count("*").alias("n"))
    groups = stored(groups.filter(F.col("n") >= PAGES), "references")

    def compared(pairs: list) -> tuple[list, list, list]:
        slots, places, equal = [], [], []
        known: dict[bytes, Guide] = {}
        for pair in pairs:
            g, packed = _unpacked(pair["guide"]), pair["reference"]
            if packed not in known:
                known[packed] = _unpacked(packed)
            reference = known[packed]
            to = aligned(g, reference)
            slots.append(to.get(g.slot, -1))
            places.append(sorted(j for j in to.values() if reference.hashes[j]))
            equal.append([{"node": j, "hash": h} for i, j in to.items() for h in {*g.hashes[i]} & {*reference.hashes[j]}])
        return slots, places, equal

    both = salted_join(every.select("group", "guide"), groups.select("group", "reference"), "group", "inner", groups.select("group", "n"))
    fields = "slot int, places array<int>, equal array<struct<node:int,hash:bigint>>"
    found = map_texts(both.select("group", F.struct("guide", "reference").alias("pair")), ["group"], fields, compared, "pair")
    found = stored(found, "alignments")
    held = found.select("group", F.explode("places").alias("node")).groupBy("group", "node").agg(F.count("*").alias("pages"))
    template = found.select("group", F.explode("equal").alias("e")).groupBy("group", "e").agg(F.count("*").alias("n"))
    template = template.withColumn("node", F.col("e.node")).join(held, ["group", "node"]).filter((F.col("n") >= TEMPLATE * F.col("pages")) & (F.col("pages") >= PAGES))
    template = template.groupBy("group").agg(F.collect_list("e").alias("template"))  # no more than the reference's texts
    votes = found.filter("slot >= 0").groupBy("group", "slot").agg(F.count("*").alias("votes"))
    votes = votes.groupBy("group").agg(F.max_by("slot", F.struct("votes", "slot")).alias("slot"), F.max("votes").alias("votes"))
    out = groups.join(votes, "group", "left").join(template, "group", "left")
    slot = F.when(F.col("votes") >= SLOT * F.col("n"), F.col("slot")).otherwise(-1)
    nothing = F.array().cast("array<struct<node:int,hash:bigint>>")
    out = out.select("host", F.struct("layout", "reference", slot.alias("slot"), F.coalesce("template", nothing).alias("template")).alias("w"))
    out = out.groupBy("host").agg(F.collect_list("w").alias("w"))  # as many as the host has layouts of enough pages

    def packed(hosts: list) -> tuple[list]:
        # A layout's wrapper is packed by itself, as a page unpacks no other of its host's.
        kept = [{w["layout"]: pickle.dumps((w["reference"], w["slot"], [(e["node"], e["hash"]) for e in w["template"]])) for w in ws} for ws in hosts]
        return ([pickle.dumps(x) for x in kept],)

    return map_texts(out, ["host"], "wrappers binary", packed, "w")


def _wrapper(packed: bytes) -> Wrapper:
    reference, slot, template = pickle.loads(packed)
    return Wrapper(_unpacked(reference), slot, {*template})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of (page_id, url, html)."""
    rows = pages.select("page_id", "url", "html", F.coalesce(host(F.col("url")), F.lit("")).alias("host"))
    wrappers = stored(induced(rows.select("host", "html")), "wrappers")
    size = wrappers.agg(F.sum(F.length("wrappers"))).first()[0] or 0
    joined = rows.join(F.broadcast(wrappers), "host", "left") if size <= BROADCAST_BYTES else salted_join(rows, wrappers, "host")

    def texts(pairs: list) -> tuple[list]:
        out = []
        known: dict[bytes | None, Wrapper | None] = {None: None}
        for pair in pairs:
            g, own = read_page(pair["html"])
            layouts = pickle.loads(pair["wrappers"]) if pair["wrappers"] is not None else {}
            packed = layouts.get(layout_of(g)) or layouts.get(0)
            if packed not in known:
                known[packed] = _wrapper(packed)
            out.append(text_of(g, own, known[packed]))
        return (out,)

    found = map_texts(joined.select("page_id", "url", F.struct("html", "wrappers").alias("pair")), ["page_id", "url"], "text string", texts, "pair")
    return found.withColumn("n_chars", F.length("text").cast("long"))
