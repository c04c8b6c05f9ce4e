"""Main text of pages by wrapper induction.

Each page becomes a tree of its block elements with runs of text as leaves; inline markup is transparent, but for how
much of a text is in links. Runs of sibling elements of one label are folded into one repeated node. The trees of a
host's pages are aligned by simple tree matching (the largest order-preserving match of equal labels, by dynamic
programming over children) and merged into the host's template: a leaf that always holds the same text is constant, one
that differs is a slot. Constant nodes are template. Which slots are content is decided by their statistics over the
host's pages:

* from the root, the wrapper descends into the child with the most varying text outside links, as long as all of its
  siblings are chrome: mostly links, or weak (a small share of that text, and no heading);
* inside the region it arrives at everything stays, but for constant leaves and slots of mostly links, if most of the
  host's pages have them.

What a tag, role or class says (menu, advert, article ...) breaks ties: an element so named is chrome if it holds less
than the strongest of its siblings or half of the region, and most pages have it or the host has too few pages to tell;
of several children, article or main is descended into if it is not far weaker. Elements that HTML itself defines as
menus, footers, sidebars, forms or dialogs are never content. A host whose pages do not differ (one page, or copies)
gives no evidence; there all text counts as slots.

A template is bounded: of a node's children beyond ``MAX_CHILDREN``, the rarest are kept as one sum of text.
Copies of a page on a host are one page to the template: only their folded trees are shuffled, by host and content, so
a host's pages stay spread over tasks. Each task merges what it holds of a host; partial templates of a host are merged
in two levels, and no task gathers its pages. A second pass aligns each page with its host's wrapper.

Defined results: null or empty html gives an empty text; a page without a usable url is of the host ""; elements nested
deeper than 150 are taken as children of the one at that depth (no text is lost); repeated rows and page_ids each get
their row; an empty table gives an empty result; of other columns only those asked for are carried.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import small, stage

# HTML element sets and the words that mark boilerplate.
BLOCKS = frozenset("html body head main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header footer nav aside address form fieldset details summary hr center dir menu hgroup dialog noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup: skipped to the end tag.
RAW = frozenset("script style textarea title noscript iframe xmp".split())
#: Dropped with what they hold, which is markup.
CONTROLS = frozenset("select button template".split())
#: Inline, but no part of the word before or after.
EMBEDDED = frozenset("svg math object video audio canvas".split())
FOREIGN = frozenset("svg math".split())
DROPPED = frozenset("head nav footer aside form menu dialog script style noscript".split())
CONTAINERS = frozenset("div section ul ol dl table center details figure hgroup header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset("article main".split())
CLOSES_P = BLOCKS - {"html", "body", "head", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption"}
#: Start tags that end an open element of these tags, up to the boundary tags.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
BOILERPLATE = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside ad ads advert adverts advertisement banner sponsor sponsored promo notice cookie cookies consent gdpr popup modal newsletter subscribe share sharing social related comment comments reply replies disqus form login search pagination pager toolbar widget skip contentinfo complementary alert dialog".split()
)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*|[^>]*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=\s|/|\Z)", re.I)
SPACE = re.compile(r"\s+")
SPLIT = re.compile(r"[^a-z]+")
DEPTH = 150
#: Pages that must share a constant leaf, or a slot, before it counts as template.
SUPPORT = 5
#: Share of the strongest sibling's text below which a slot is weak; of links in a slot's text from which it is mostly links.
WEAK, LINKS_OUTSIDE, LINKS_INSIDE = 0.2, 0.5, 0.8
MAX_CHILDREN = 48
HOSTS_HELD = 2000
VARIES = ""

# A node is [label, kind, children, pages, hash, chars, link chars]; a leaf has the label "#" and no children, what a
# bounded template has left out the label "*". Where a page is to be cut by a wrapper, its folded nodes hold the page's
# nodes they stand for as well.
LABEL, KIND, CHILDREN, PAGES, HASH, CHARS, LINKED, SOURCES = range(8)
#: Kinds: nothing said; a word that names boilerplate; an element that is never content; a header outside article and main.
PLAIN, NAMED, NEVER, HEADER = range(4)


def _element(tag: str, attributes: str, in_region: bool) -> list:
    names, kind = "", NEVER if tag in DROPPED else HEADER if tag == "header" and not in_region else PLAIN
    if attributes and not attributes.isspace():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                names += f".{SPLIT.sub('-', value)}"
            if name in ("class", "id", "role"):
                if kind == PLAIN and tag in CONTAINERS and not BOILERPLATE.isdisjoint(value.split()):
                    kind = NAMED
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                kind = NEVER
    return [tag + names, kind, [], 1, VARIES, 0, 0]


def _closed(html: str, tag: str, at: int) -> bool:
    """Whether the element whose start tag ends at ``at`` has an end tag; only templates nest."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])", re.I).finditer(html, at):
        depth += -1 if m[1] else 1
        if not depth or (depth > 1 and tag != "template"):
            return not depth
    return False


def parse(html: str) -> list:
    """The page's tree. Leaves carry their text in HASH."""
    root = ["root", PLAIN, [], 1, VARIES, 0, 0]
    stack: list[tuple[str, list]] = [("root", root)]
    pending: list[str] = []
    regions = 0
    muted = foreign = 0  # muted: len(stack) where the open form control or template began; foreign: open svg and math
    control, nested, closed = "", 0, False
    at = linked = 0  # linked: characters of the pending text that are in links
    link = False

    def flush() -> None:
        nonlocal linked
        if pending:
            text = SPACE.sub(" ", entities.unescape("".join(pending))).strip()
            pending.clear()
            if text:
                stack[-1][1][CHILDREN].append(["#", PLAIN, [], 1, text, len(text), min(linked, len(text))])
            linked = 0

    def cut(depth: int) -> None:
        nonlocal regions
        while len(stack) > depth:
            regions -= stack.pop()[0] in REGIONS

    def unmute() -> None:
        nonlocal muted
        if muted:
            cut(muted)
            muted = 0

    def pop_to(depth: int) -> None:
        if depth < muted:
            unmute()
        if not muted:
            flush()
        cut(depth)

    while m := TAG.search(html, at):
        if m.start() > at and not muted:
            pending.append(html[at : m.start()])
            linked += link and len(pending[-1].strip())
        at = m.end()
        if m[2] is None or not m[4]:
            continue
        tag = m[2].lower()
        if tag == "a":
            link = not m[1]
        if m[1]:
            if tag in BLOCKS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        pop_to(depth)
                        break
                else:
                    if tag == "p" and not muted:  # a lone </p> ends the block before it
                        flush()
            elif tag in EMBEDDED:
                pending.append(" ")
                foreign -= tag in FOREIGN and foreign > 0
            elif muted and tag == control:
                nested -= 1
                if not nested:
                    unmute()
            continue
        empty = m[3].rstrip().endswith("/")
        if tag in RAW:
            if foreign and empty:
                continue
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
            at = close.end() if close else len(html)
            pending.append(" ")
            continue
        if tag == "br" or tag in EMBEDDED:
            pending.append(" ")
        foreign += tag in FOREIGN and not empty
        if tag in CONTROLS:
            pending.append(" ")
            if not muted or (tag == control and tag != "template"):
                unmute()
                muted, control, nested, closed = len(stack), tag, 1, _closed(html, tag, at)
            else:
                nested += tag == control
        if tag not in BLOCKS:
            continue
        foreign = 0
        if muted and not closed:  # its end tag is missing: it ends before the next block
            unmute()
        floor = max(muted - 1, 0)
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, floor, -1):
                if stack[depth][0] == "p":
                    pop_to(depth)
                    break
                if stack[depth][0] in ("table", "td", "th", "caption"):
                    break
        elif tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            first = 0
            for depth in range(len(stack) - 1, floor, -1):
                if stack[depth][0] in bounds:
                    break
                if stack[depth][0] in ends:
                    first = depth
            if first:
                pop_to(first)
        if not muted:
            flush()
        if tag in VOID or len(stack) > DEPTH:
            continue
        node = _element(tag, m[3], regions > 0)
        if not muted:
            stack[-1][1][CHILDREN].append(node)
        stack.append((tag, node))
        regions += tag in REGIONS
    if not muted:
        pending.append(html[at:])
    unmute()
    flush()
    return root


def folded(node: list, sources: bool = False) -> list:
    """A copy with each run of sibling elements of one label (and, for containers, of like trees) folded into one node, and texts hashed."""
    own = [[node]] if sources else []
    if node[LABEL] == "#":
        return ["#", PLAIN, [], 1, blake2b(node[HASH].encode(), digest_size=8).hexdigest(), node[CHARS], node[LINKED], *own]
    children: list[list] = []
    for c in node[CHILDREN]:
        c = folded(c, sources)
        if children and children[-1][LABEL] == c[LABEL] != "#" and (_tag(c) not in STRUCTURE or alike(children[-1], c)):
            children[-1] = merged(children[-1], c, True)
        else:
            children.append(c)
    return [node[LABEL], node[KIND], children, 1, VARIES, 0, 0, *own]


def _size(node: list) -> int:
    return 1 + sum(map(_size, node[CHILDREN]))


def alike(a: list, b: list) -> bool:
    """Whether half of the larger tree matches: a menu and an article may both be a bare div."""
    return 2 * matching(a, b) >= max(_size(a), _size(b))


def matching(a: list, b: list, known: dict[tuple[int, int], int] | None = None) -> int:
    """Simple tree matching: the size of the largest top-down, order-preserving match of equal labels."""
    if a[LABEL] != b[LABEL]:
        return 0
    known = {} if known is None else known
    key = (id(a), id(b))
    if key not in known:
        x, y = a[CHILDREN], b[CHILDREN]
        row = [0] * (len(y) + 1)
        for p in x:
            above, row = row, [0] * (len(y) + 1)
            for j, q in enumerate(y):
                row[j + 1] = max(above[j + 1], row[j], above[j] + matching(p, q, known))
        known[key] = row[-1] + 1
    return known[key]


def aligned(x: list[list], y: list[list], known: dict[tuple[int, int], int] | None = None) -> list[tuple[int, int]]:
    """Pairs of matched children."""
    if len(x) == len(y) and all(p[LABEL] == q[LABEL] for p, q in zip(x, y, strict=True)):
        return [(i, i) for i in range(len(x))]
    known = {} if known is None else known
    table = [[0] * (len(y) + 1)]
    weight = [[matching(p, q, known) for q in y] for p in x]
    for w in weight:
        row, above = [0], table[-1]
        for j, v in enumerate(w):
            row.append(max(above[j + 1], row[j], above[j] + v))
        table.append(row)
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if weight[i - 1][j - 1] and table[i][j] == table[i - 1][j - 1] + weight[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def merged(a: list, b: list, siblings: bool = False, known: dict[tuple[int, int], int] | None = None) -> list:
    """Two templates of one label as one; what matches nothing is kept in its place, up to MAX_CHILDREN.

    siblings: both are of one page and fold into a repeated node, whose text is the sequence of theirs (a list that is
    the same on all pages stays constant).
    """
    known = {} if known is None else known
    children, i, j = [], 0, 0
    for p, q in aligned(a[CHILDREN], b[CHILDREN], known):
        children += a[CHILDREN][i:p] + b[CHILDREN][j:q]
        children.append(merged(a[CHILDREN][p], b[CHILDREN][q], siblings, known))
        i, j = p + 1, q + 1
    children += a[CHILDREN][i:] + b[CHILDREN][j:]
    if not siblings and len(children) > MAX_CHILDREN:
        children = bounded(children)
    if siblings and a[LABEL] == "#":
        text = blake2b(f"{a[HASH]} {b[HASH]}".encode(), digest_size=8).hexdigest()
    else:
        text = a[HASH] if a[HASH] == b[HASH] else VARIES
    sources = [a[SOURCES] + b[SOURCES]] if siblings and len(a) > SOURCES else []
    return [a[LABEL], a[KIND] if a[KIND] == b[KIND] else PLAIN, children, 1 if siblings else a[PAGES] + b[PAGES], text, a[CHARS] + b[CHARS], a[LINKED] + b[LINKED], *sources]


def bounded(children: list[list]) -> list[list]:
    """The children that most pages have, and one node "*" with the text of the others."""
    rare = sorted((i for i, c in enumerate(children) if c[LABEL] != "*"), key=lambda i: (-children[i][PAGES], i))[MAX_CHILDREN - 1 :]
    left_out = [children[i] for i in rare] + [c for c in children if c[LABEL] == "*"]
    gone = set(rare)
    kept = [c for i, c in enumerate(children) if i not in gone and c[LABEL] != "*"]
    chars, linked = (sum(x) for x in zip(*(_total(c) for c in left_out), strict=True))
    return [*kept, ["*", PLAIN, [], max(c[PAGES] for c in left_out), VARIES, chars, linked]]


def _total(node: list) -> tuple[int, int]:
    chars, linked = node[CHARS], node[LINKED]
    for c in node[CHILDREN]:
        x, y = _total(c)
        chars, linked = chars + x, linked + y
    return chars, linked


def mass(node: list, all_text: bool) -> tuple[int, int]:
    """Characters of slots outside and inside links, but for what is never content."""
    if node[KIND] == NEVER:
        return 0, 0
    if node[LABEL] in ("#", "*"):
        return (node[CHARS] - node[LINKED], node[LINKED]) if all_text or node[HASH] == VARIES else (0, 0)
    plain = linked = 0
    for c in node[CHILDREN]:
        x, y = mass(c, all_text)
        plain, linked = plain + x, linked + y
    return plain, linked


def _tag(node: list) -> str:
    return node[LABEL].partition(".")[0]


def _headed(node: list) -> bool:
    return _tag(node) in HEADINGS or any(_headed(c) for c in node[CHILDREN])


STRUCTURE = frozenset("root html body main article section div center table tbody tr td".split())


def region_of(template: list) -> tuple[list[int], bool]:
    """The path of the content region, and whether its pages differ."""
    all_text = not sum(mass(template, False))
    path, node = [], template
    while True:
        holding = [(i, c, *mass(c, all_text)) for i, c in enumerate(node[CHILDREN])]
        holding = [x for x in holding if x[2] + x[3]]
        mostly_links = lambda x: x[3] >= LINKS_OUTSIDE * (x[2] + x[3])
        if not holding:
            return path, not all_text
        top = max(holding, key=lambda x: (x[2], -x[0]))
        regions = [x for x in holding if _tag(x[1]) in REGIONS and not mostly_links(x)]
        tied = len(regions) == 1 and (regions[0][1][PAGES] < SUPPORT or regions[0][2] >= WEAK * top[2])
        top = regions[0] if tied else top

        def chrome(x: tuple, top: tuple = top, tied: bool = tied) -> bool:
            _, c, plain, _ = x
            if tied or mostly_links(x) or (c[KIND] in (NAMED, HEADER) and plain < top[2]):
                return True
            return top[1][PAGES] >= SUPPORT and plain < WEAK * top[2] and _tag(c) in STRUCTURE and not _headed(c)

        if _tag(top[1]) not in STRUCTURE or mostly_links(top) or not all(chrome(x) for x in holding if x[0] != top[0]):
            return path, not all_text
        path.append(top[0])
        node = top[1]


def wrapper_of(template: list) -> str:
    path, differs = region_of(template)
    return json.dumps([template, path, differs], separators=(",", ":"), ensure_ascii=False)


def _template_nodes(fold: list, template: list, whole: int, need: float, all_text: bool, found: set[int]) -> None:
    """The page's nodes, by id, that are template: leaves whose text (of the whole run, where siblings fold) is the constant of their template leaf, and slots that are chrome.

    whole: the text of the region outside links.
    """
    for p, q in aligned(template[CHILDREN], fold[CHILDREN]):
        t, c = template[CHILDREN][p], fold[CHILDREN][q]
        if c[LABEL] == "#":
            if t[HASH] == c[HASH] != VARIES and t[PAGES] >= need:
                found.update(id(leaf) for leaf in c[SOURCES])
            continue
        plain, linked = mass(t, all_text)
        most = t[PAGES] >= need
        if (t[KIND] == NAMED and 2 * plain < whole and (most or template[PAGES] < SUPPORT)) or (most and linked and _tag(t) in CONTAINERS and linked >= LINKS_INSIDE * (plain + linked)):
            found.update(id(node) for node in c[SOURCES])
        else:
            _template_nodes(c, t, whole, need, all_text, found)


def _texts(node: list, region: set[int], inside: bool, template: set[int], out: list[str]) -> None:
    """Texts of the page's region nodes in the order of the page, less what is template or never content."""
    for c in node[CHILDREN]:
        if c[LABEL] == "#":
            if inside and id(c) not in template:
                out.append(c[HASH])
        elif not (inside and (c[KIND] == NEVER or id(c) in template)):
            _texts(c, region, inside or id(c) in region, template, out)


def _step(places: list[list], at: list, step: int) -> list[list]:
    """Children of the page's nodes that align with a child of the template's node; copies that align with no other child count as well."""
    out = []
    for x in places:
        pairs = {q: p for p, q in aligned(at[CHILDREN], x[CHILDREN])}
        if step in pairs.values():
            label = at[CHILDREN][step][LABEL]
            out += [c for q, c in enumerate(x[CHILDREN]) if pairs.get(q, step) == step and c[LABEL] == label]
    return out


def extract_page(page: list, wrapper: list) -> str:
    """The text of a page by its host's wrapper."""
    template, path, differs = wrapper
    places, at = [folded(page, True)], template
    for step in path:
        places, at = _step(places, at, step), at[CHILDREN][step]
        if not places:
            # laid out otherwise than the host's other pages: the page's own region
            places, at, differs = [folded(page, True)], folded(page_template(page)), False
            for i in region_of(at)[0]:
                places, at = _step(places, at, i), at[CHILDREN][i]
            break
    found: set[int] = set()
    need = max(SUPPORT, 0.5 * at[PAGES])
    for x in places:
        _template_nodes(x, at, mass(at, not differs)[0], need if differs else max(need, 2 * at[PAGES]), not differs, found)
    region = {id(node) for x in places for node in x[SOURCES]}
    out: list[str] = []
    _texts(page, region, id(page) in region, found, out)
    return "\n".join(out)


def page_template(page: list) -> list:
    """The page as it is, with every text a slot."""
    return [page[LABEL], page[KIND], [page_template(c) for c in page[CHILDREN]], 1, VARIES, page[CHARS], page[LINKED]]


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def content_key(page: list) -> str:
    """128 bits of the page's tree less elements that tags or words name as boilerplate: copies of a page have one key, whatever their menus say."""
    parts: list[str] = []

    def walk(node: list) -> None:
        for c in node[CHILDREN]:
            if c[LABEL] == "#":
                parts.append(c[HASH])
            elif not c[KIND]:
                parts.append(f"\0{c[LABEL]}")
                walk(c)
                parts.append("\1")

    walk(page)
    return blake2b("\2".join(parts).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def induce(pages: DataFrame, url: str = "url", html: str = "html", levels: int = 16) -> DataFrame:
    """host, wrapper (JSON) of every host. Copies of a page are one page to the template, else they would be its support."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, trees = [], []
            for html in batch.column(1):
                page = parse(html.as_py() or "")
                keys.append(content_key(page))
                trees.append(json.dumps(folded(page), separators=(",", ":"), ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(trees, pa.string())], ["host", "content", "template"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        salt = TaskContext.get().partitionId() % levels

        def out() -> pa.RecordBatch:
            texts = [json.dumps(t, separators=(",", ":"), ensure_ascii=False) for t in held.values()]
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([salt] * len(held), pa.int32()), pa.array(texts, pa.string())], ["host", "salt", "template"])

        for batch in batches:
            for host, tree in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = json.loads(tree.as_py())
                held[host] = merged(held[host], t) if host in held else t
                if len(held) > HOSTS_HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def merge(final: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            total = None
            for t in sorted(pdf["template"]):
                total = json.loads(t) if total is None else merged(total, json.loads(t))
            one = pdf.iloc[:1]
            if final:
                return pd.DataFrame({"host": one["host"], "wrapper": [wrapper_of(total)]})
            return one.assign(template=json.dumps(total, separators=(",", ":"), ensure_ascii=False))

        return run

    trees = pages.select(host_of(F.col(url)).alias("host"), F.col(html)).mapInArrow(read, "host string, content string, template string")
    once = trees.groupBy("host", "content").agg(F.min("template").alias("template")).select("host", "template")
    partial = once.mapInArrow(gather, "host string, salt int, template string")
    partial = partial.groupBy("host", "salt").applyInPandas(merge(False), "host string, salt int, template string")
    return partial.groupBy("host").applyInPandas(merge(True), "host string, wrapper string")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text of every page."""
    wrappers = small(stage(induce(pages, url, html), "wrappers"))
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("tm_host"))
    joined = own.join(wrappers, own["tm_host"] == wrappers["host"]).select("page_id", "url", "html", "wrapper")
    id_type = joined.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2), batch.column(3), strict=True):
                key = wrapper.as_py()
                if key not in known:
                    if len(known) > 500:
                        known.clear()
                    known[key] = json.loads(key)
                texts.append(extract_page(parse(page.as_py() or ""), known[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, f"page_id {id_type}, url string, text string")
