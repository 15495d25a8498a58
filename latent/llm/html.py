"""Main text of web pages by wrapper induction.

Pages become trees of their block elements. A page's outline is that tree with runs of like
siblings folded into one node; the outlines of a host's pages are aligned by simple tree
matching and merged into a wrapper, whose nodes carry how many pages have them, how much text
and linked text they hold, and whether that text is the same on all pages. Outlines are merged
within tasks first, so a host sends one wrapper for each task however many pages it has.

The wrapper tells template from content: the content slot is found by walking down from the
root while one child holds most of the free text, that is text outside links and outside
navigation, adverts, forms and the like, unless those hold more than all else; nodes inside it whose text is constant over many
different articles are template. Each page is aligned with its host's wrapper, and the text
blocks of the elements in the content slot are its main text.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latent.session import Workspace

# Element classes of HTML, and words of class, id and role that name
# parts of a page beside its article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = set("html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table "
            "thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address "
            "details summary fieldset header footer nav aside form dialog menu center".split())
BESIDE = set("nav footer aside form dialog menu script style textarea title noscript template "
             "iframe head button select option svg canvas object audio video".split())
HINTS = set("ad ads advert adverts advertisement banner sponsored sponsor promo promotion sidebar "
            "menu nav navbar navigation breadcrumb breadcrumbs header footer cookie cookies consent "
            "gdpr notice notices alert newsletter subscribe subscription popup modal overlay share "
            "sharing social comment comments disqus reply replies respond related recommended "
            "widget login signup search masthead copyright pagination pager skip toolbar "
            "contentinfo complementary alertdialog".split())
KEPT = set("html body article main h1".split())  # not judged by their hints
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"},
          "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"},
         "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"},
         "option": {"select"}}
ENDS_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}

TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|[!?][^>]*>?|"
                 r"(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?)",
                 re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PART = re.compile(r"[a-z]+")


@dataclass(eq=False)
class Node:
    """A block element: its parts are texts (linked or not) and further nodes, in order."""
    tag: str
    label: str
    beside: bool
    parts: list = field(default_factory=list)

    def children(self) -> list["Node"]:
        return [p for p in self.parts if isinstance(p, Node)]


def _node(tag: str, attrs: str, inside: bool) -> Node:
    label, beside = tag, tag in BESIDE or (tag == "header" and not inside)
    if attrs and "=" in attrs:
        for name, a, b, c in ATTR.findall(attrs):
            value = (a or b or c).lower()
            words = PART.findall(value)
            if tag not in KEPT and HINTS.intersection(words):
                beside = True
            if name.lower() != "id" or words:
                label += f".{'-'.join(words)}"
    return Node(tag, label, beside)


# Blocks nested deeper hang on the last one above, as in browsers; their text stays in place.
DEEP = 200


def parse(html: str) -> Node:
    """Tree of a page. Missing end tags end where HTML says or with their parent."""
    root = Node("#", "#", False)
    stack, inline, at, n = [root], [], 0, len(html)
    links = articles = 0
    standing: Counter = Counter()      # open blocks by tag, so that none is looked for in vain
    closes: dict[str, int | None] = {}

    def host() -> Node:
        return stack[min(len(stack) - 1, DEEP)]

    def text(raw: str) -> None:
        if raw:
            host().parts.append((entities.unescape(raw) if "&" in raw else raw, links > 0))

    def close_of(name: str) -> int | None:
        """Where the next end tag of the name stands."""
        if name not in closes or (closes[name] is not None and closes[name] < at):
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
            closes[name] = found.start() if found else None
        return closes[name]

    def pop(to: int) -> None:
        nonlocal articles, links
        articles -= sum(x.tag in ("article", "main") for x in stack[to:])
        standing.subtract(x.tag for x in stack[to:])
        if to > DEEP:                  # what follows is no part of the block that ends here
            host().parts.append(Node("#", "#", False))
        del stack[to:]
        while inline and inline[-1][0] > to:  # inline elements end with their block
            links -= inline.pop()[1] == "a"

    while at < n:
        m = TAG.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name in BLOCK:
                for i in range(len(stack) - 1 if standing[name] else 0, 0, -1):
                    if stack[i].tag == name:
                        pop(i)
                        break
            else:
                for i in range(len(inline) - 1, -1, -1):
                    if inline[i][1] == name and inline[i][0] == len(stack):
                        links -= inline.pop(i)[1] == "a"
                        break
                else:
                    if name == "br":
                        text(" ")
        elif name in RAW:  # everything up to the end tag is no markup
            close = close_of(name)
            at = n if close is None else close
            host().parts.append(Node(name, name, True))
        elif name in BLOCK:
            if name in ENDS_P and standing["p"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        pop(i)
                        break
                    if stack[i].tag in ("td", "th", "table", "button"):
                        break
            if name in CLOSES and any(standing[t] for t in CLOSES[name]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in CLOSES[name]:
                        pop(i)
                        if name not in ("tr", "tbody", "tfoot", "thead"):
                            break
                    elif stack[i].tag in SCOPE.get(name, ()):
                        break
            node = _node(name, m["attrs"], articles > 0)
            host().parts.append(node)
            if name not in VOID:
                stack.append(node)
                standing[name] += 1
                articles += name in ("article", "main")
        elif name in BESIDE:  # inline parts without text of their own, such as buttons
            if not m["attrs"].endswith("/") and (close := close_of(name)) is not None:
                at = close
        elif name in VOID:
            if name == "br":
                text(" ")
        elif not m["attrs"].endswith("/"):
            inline.append((len(stack), name))
            links += name == "a"
    return root


# -- outlines and wrappers ------------------------------------------------------------

@dataclass(eq=False)
class Slot:
    """A node of an outline or wrapper."""
    label: str
    beside: bool
    pages: int = 1
    free: int = 0          # characters of text outside links
    texts: list = field(default_factory=list)  # [hash, pages] of the commonest texts, most first
    kids: list["Slot"] = field(default_factory=list)

    def dump(self) -> list:
        return [self.label, self.beside, self.pages, self.free, self.texts,
                [k.dump() for k in self.kids]]

    @staticmethod
    def load(x: list) -> "Slot":
        return Slot(*x[:5], [Slot.load(k) for k in x[5]])

    def weight(self) -> int:
        """Free text of the slot and all below it, without what stands beside articles."""
        return 0 if self.beside else self.free + sum(k.weight() for k in self.kids)


def _hash(texts: list[str]) -> int:
    import xxhash
    return xxhash.xxh64_intdigest("\n".join(texts)) >> 1


def outline(nodes: list[Node], home: dict[Node, Slot] | None = None) -> Slot:
    """The folded tree of like siblings; ``home`` gets the slot of every node."""
    own = [p for n in nodes for p in n.parts if not isinstance(p, Node)]
    said = [" ".join(p[0].split()) for p in own]
    slot = Slot(nodes[0].label, nodes[0].beside, free=sum(
        len(t) for t, p in zip(said, own, strict=True) if not p[1]),
        texts=[[_hash([t for t in said if t]) if any(said) else 0, 1]])
    runs: list[list[Node]] = []
    for node in nodes:
        for child in node.children():
            same = next((r for r in runs if r[0].label == child.label), None) \
                if len(nodes) > 1 else (runs[-1] if runs and runs[-1][0].label == child.label
                                        else None)
            if same is None:
                runs.append([child])
            else:
                same.append(child)
    slot.kids = [outline(r, home) for r in runs]
    if home is not None:
        home.update((n, slot) for n in nodes)
    return slot


def match(a: list[Slot], b: list[Slot], memo: dict | None = None) -> list[tuple[int, int]]:
    """Simple tree matching of two child lists: the order-preserving pairs of like children
    whose trees agree in most nodes."""
    if [s.label for s in a] == [s.label for s in b]:
        return [(i, i) for i in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j],
                                     best[i][j] + agreement(a[i], b[j], memo))
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return pairs[::-1]


def agreement(a: Slot, b: Slot, memo: dict | None = None) -> int:
    """Number of nodes that simple tree matching pairs; 0 if the roots differ."""
    if a.label != b.label:
        return 0
    memo = {} if memo is None else memo
    key = (id(a), id(b))
    if key not in memo:
        memo[key] = 1 + sum(agreement(a.kids[i], b.kids[j], memo)
                            for i, j in match(a.kids, b.kids, memo))
    return memo[key]


def commonest(a: list, b: list, held: int = 8) -> list:
    """[hash, pages] of both lists; beyond ``held`` all counts sink by the first one left out, so
    a text of n of N pages keeps at least n − N / (held + 1)."""
    counts: dict[int, int] = {}
    for text, n in [*a, *b]:
        counts[text] = counts.get(text, 0) + n
    order = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    less = order[held][1] if len(order) > held else 0
    return [[text, n - less] for text, n in order[:held] if n > less]


def template(slot: Slot, region: Slot, share: float = 0.7) -> int:
    """Hash of the text that most pages of the slot agree in, if most of the region's have the
    slot; else zero. Five in six pages are enough, whatever else the others say."""
    if slot.kids or not slot.texts or slot.pages < max(2, region.pages / 2):
        return 0
    text, n = slot.texts[0]
    return text if n >= share * slot.pages else 0


def merge(a: Slot, b: Slot) -> Slot:
    """Wrapper of the pages of both; nodes without a partner keep their place in order."""
    out = Slot(a.label, a.beside and b.beside, a.pages + b.pages, a.free + b.free,
               commonest(a.texts, b.texts))
    i = j = 0
    for x, y in [*match(a.kids, b.kids), (len(a.kids), len(b.kids))]:
        out.kids += a.kids[i:x] + b.kids[j:y]
        if x < len(a.kids):
            out.kids.append(merge(a.kids[x], b.kids[y]))
        i, j = x + 1, y + 1
    if len(out.kids) > 100:  # very varied siblings are told apart by label alone
        kids: dict[str, Slot] = {}
        for kid in out.kids:
            kids[kid.label] = merge(kids[kid.label], kid) if kid.label in kids else kid
        out.kids = list(kids.values())
    return out


def content_slot(root: Slot, most: float = 0.6) -> Slot:
    """The slot that holds the article."""
    here = root
    while True:
        if here.label.split(".")[0] in ("article", "main") or not here.kids:
            return here
        kid = max(here.kids, key=Slot.weight)
        inner = any(k.weight() for k in kid.kids)
        tag = kid.label.split(".")[0]
        if kid.weight() < most * here.weight() or not kid.weight() or not (
                inner or tag in ("article", "main", "div", "section", "td", "body")):
            return here
        here = kid


def spare(root: Slot) -> None:
    """Hints and tags don't hide what holds the article: unless an article is in sight, the
    slot beside with the most free text counts as content while it has more than all content."""
    def full(slot: Slot) -> int:
        hard = slot.beside and slot.label.split(".")[0] in BESIDE - {"form"}
        return 0 if hard else slot.free + sum(map(full, slot.kids))

    def hidden(slot: Slot) -> Iterator[Slot]:
        for kid in slot.kids:
            if kid.beside:
                yield kid
            else:
                yield from hidden(kid)

    def article(slot: Slot) -> bool:
        return not slot.beside and (slot.label.split(".")[0] in ("article", "main")
                                    and slot.weight() > 0 or any(map(article, slot.kids)))

    while not article(root):
        most = max(hidden(root), key=full, default=None)
        if most is None or full(most) <= root.weight():
            return
        most.beside = False


def align(page: Slot, wrapper: Slot, to: dict[int, Slot]) -> None:
    """Fill in the wrapper slot of every slot of a page that has one."""
    to[id(page)] = wrapper
    for i, j in match(page.kids, wrapper.kids):
        align(page.kids[i], wrapper.kids[j], to)


def main_text(html: str, wrapper: Slot | None) -> str:
    """Main text of a page. Nodes of the content slot are template if they hold the text that
    most pages have there, and the contents of the pages differ (two articles are enough)."""
    home: dict[Node, Slot] = {}
    tree = parse(html)
    page = outline([tree], home)
    to: dict[int, Slot] = {}
    if wrapper is not None:
        spare(wrapper)
        align(page, wrapper, to)
        for slot in home.values():
            slot.beside = slot.beside and to.get(id(slot), slot).beside
    target = content_slot(wrapper) if wrapper is not None else None
    starts = [n for n in home if to.get(id(home[n])) is target] if target is not None else []
    if not starts or not any(home[n].weight() for n in starts):
        spare(page)
        own = content_slot(page)  # a page unlike its host's others
        starts = [n for n in home if home[n] is own]
    region = to.get(id(home[starts[0]]))
    varied = region is not None and region.pages > 1 and _varies(region)
    blocks: list[str] = []

    def walk(node: Node) -> None:
        slot = to.get(id(home[node]))
        if home[node].beside or (varied and slot is not None and slot is not region
                                 and (text := template(slot, region))
                                 and home[node].texts[0][0] == text):
            return
        run: list[str] = []
        for part in node.parts:
            if isinstance(part, Node):
                blocks.append("".join(run))
                run = []
                walk(part)
            else:
                run.append(part[0])
        blocks.append("".join(run))

    order = {id(n): i for i, n in enumerate(_preorder(tree))}
    for node in sorted(starts, key=lambda n: order[id(n)]):
        walk(node)
    return "\n".join(t for b in blocks if (t := " ".join(b.split())))


def _preorder(node: Node) -> Iterator[Node]:
    yield node
    for child in node.children():
        yield from _preorder(child)


def _varies(slot: Slot) -> bool:
    """Whether no text below the slot holds for more than half of some node's pages."""
    return (slot.pages > 1 and (not slot.texts or 2 * slot.texts[0][1] <= slot.pages)
            or any(_varies(k) for k in slot.kids if not k.beside))


# -- Spark jobs -----------------------------------------------------------------------

def host_of(url: str) -> Column:
    """Host in lower case without a leading www; empty if there is none."""
    host = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")),
                            r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(?:www\.)?([^/:?#]+)", 1)
    return F.lower(host)


def wrappers(pages: DataFrame, held: int = 5000) -> DataFrame:
    """(host, wrapper) of all pages. A task keeps at most ``held`` hosts before it sends what
    it has; a host's wrappers are merged in two steps."""
    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Slot] = {}
        part = TaskContext.get().partitionId() % 64

        def give():
            return pa.RecordBatch.from_pydict({
                "host": list(found), "part": pa.array([part] * len(found), pa.int32()),
                "wrapper": [json.dumps(s.dump()) for s in found.values()]})

        for batch in batches:
            for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = outline([parse(html)])
                found[host] = merge(found[host], page) if host in found else page
            if len(found) > held:
                yield give()
                found = {}
        yield give()

    def join(group: pa.Table) -> pa.Table:
        slot = None
        for dumped in group.column("wrapper").to_pylist():
            new = Slot.load(json.loads(dumped))
            slot = new if slot is None else merge(slot, new)
        return group.slice(0, 1).set_column(
            group.column_names.index("wrapper"), "wrapper", pa.array([json.dumps(slot.dump())]))

    shape = "host string, part int, wrapper string"
    parts = pages.select("host", "html").mapInArrow(induce, shape)
    some = parts.groupBy("host", "part").applyInArrow(join, shape)
    return some.groupBy("host").applyInArrow(join, shape).select("host", "wrapper")


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A null or empty html gives an empty text; pages without a url or host share one wrapper;
    null ids and repeated rows stay; an empty table gives an empty result.
    """
    ws = Workspace(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
                        host_of("url").alias("host"))
    found = ws.cut(wrappers(rows), "wrappers")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Slot] = {}
        for batch in batches:
            texts = []
            for html, host, wrapper in zip(*(c.to_pylist() for c in batch.columns[2:]),
                                           strict=True):
                if host not in known:
                    if len(known) >= 2000:
                        known.clear()
                    known[host] = Slot.load(json.loads(wrapper))
                texts.append(main_text(html, known[host]))
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column(0), "url": batch.column(1),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array(map(len, texts), pa.int64())})

    # A host has one wrapper: Spark broadcasts them while their size allows, and splits the
    # pages of a large host otherwise.
    return (rows.join(found, "host").select("page_id", "url", "html", "host", "wrapper")
            .mapInArrow(extract, "page_id long, url string, text string, n_chars long"))
