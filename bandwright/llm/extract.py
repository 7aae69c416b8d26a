"""Main text of HTML pages by wrapper induction.

1. Pages of a host that use the same containers (tag and class) have the same layout; containers on fewer than MIN_PAGES of
   the host's pages say nothing about it. A layout of MIN_PAGES pages or more gets a reference, one of its pages; pages of
   rarer layouts take the reference of the host's most common one.
2. Each page's tree of blocks is aligned with its reference by simple tree matching. For each reference node it is counted
   over all pages how often it was met, how often with the same text, and how many characters, in links and not, it held.
   Pages that copy the reference's longest blocks say nothing about what is constant.
3. From these figures the wrapper is induced: constant nodes are template; the varying slot that holds most of the text is
   the content. Tags, roles, classes and ids are a prior only: they weigh a slot's text, and slots inside the content that
   they name as clutter (comments vary and hold no links, so that names alone tell them) go unless nearly all text is there.
   A name that says clutter and something else besides ("social-history") says nothing: text or links decide.
4. The alignment carries the wrapper over to every page. A page that no wrapper fits is its own evidence.
Counts cover all pages; a host's pages are never gathered.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.llm.common import BROADCAST_KEYS, batch, cut, texts_of
from bandwright.llm.urlfilter import host_and_path

#: A layout of so many pages has a wrapper; a node is constant that has the reference's text on this share of the pages met.
MIN_PAGES, CONSTANT = 4, 0.9
#: References are broadcast up to this many characters; beyond it they are joined by shuffle, a layout's pages in so many parts.
BROADCAST_CHARS, SALTS = 16 << 20, 32
#: How a slot's text weighs by what its names say, what a main element weighs without text, and the share that makes one child the content.
MAIN_WEIGHT, CLUTTER_WEIGHT, MAIN_CHARS, DOMINANT = 4.0, 0.05, 50, 0.75
#: A slot of the content named as clutter stays if it holds this share of the text; an unnamed one outside of articles goes if links do,
#: one of an unsure name anywhere if links hold the last.
NEARLY_ALL, LINKS, UNSURE_LINKS = 0.9, 0.8, 0.5
#: Rows of a matching table between two that are kept for the way back.
ROWS_APART = 256

# Elements of HTML by their role for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template button select textarea iframe object svg canvas title audio video option datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks of running text; the others are containers.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption address summary figure ul ol dl hr".split())
STRONG = frozenset("nav footer aside".split())
WEAK = frozenset("form fieldset dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    """nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs sidebar sidenav aside widget widgets footer foot masthead banner topbar
    ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promos promotion teaser cookie cookies consent gdpr notice notices
    alert alerts popup modal overlay lightbox newsletter subscribe subscription signup login signin register search searchbox share sharing social socials
    related recommended recommendations comment comments commentlist discussion replies reply disqus respond feedback pagination pager paginate toolbar copyright
    legal disclaimer paywall skip skiplink hidden""".split()
)
#: Words that a clutter's name may have besides: they say where or what part of it an element is.
PARTS = frozenset(
    """a about action actions all also and area around article articles author bar below block blocks body bottom box btn button buttons by card cards center close col
    column container content count counter cta desktop dropdown element email end entry facebook field fields fixed follow for form foot global group head header heading
    here hero icon icons image in info inline inner input item items label latest layout left level like link links list lists logo main may media message meta mobile module
    more most news of on or our outer page pages panel policy popular post posts primary rail read reader readers region right rights row secondary section sections
    side single site slot small start sticky stories story strip tab tabs tags text the thread tile title to tool tools top topics trending twitter ui unit user users view
    wrap wrapper x you your zone""".split()
)
MAIN = frozenset("content article post entry story main".split())
ALL_CLUTTER = NAMES | PARTS
#: Words before a name in a class that make it a state of the element instead of its kind.
STATES = frozenset("has no not with without is are can".split())

#: Quotes open a value behind = alone; elsewhere, or without an end, they're characters like others.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.IGNORECASE)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
OPEN_TAG = re.compile(r"<[/!?a-zA-Z]")
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE) for tag in RAW}
#: A layout is the set of these, without digits.
CONTAINER = r"(?i)<((?:div|section|article|main|header|footer|aside|nav|form|table)\b(?:[^>]*?\bclass\s*=\s*[\"']?[^\"'>]*)?)"

GONE, HINTED, UNSURE, PLAIN, GOOD = -3, -2, -1, 0, 1


class Node:
    """A block, or an inline element that its names set apart. items: runs of text and nodes in order."""

    __slots__ = ("tag", "items", "hint", "elements", "links", "chars", "place", "parent", "full", "shape", "size")

    def __init__(self, tag: str, hint: int, parent: Node | None):
        self.tag, self.hint, self.parent, self.items, self.elements, self.links, self.place = tag, hint, parent, [], [], 0, -1


def named(attributes: str) -> tuple[bool, int]:
    """Whether an element is hidden, and what its role, class and id say: HINTED for clutter, UNSURE for clutter and something else, GOOD for main content, else PLAIN."""
    hint = PLAIN
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and INVISIBLE.search(value):
            return True, hint
        if key == "role":
            role = value.strip().lower()
            hint = HINTED if role in ROLES else GOOD if role in ("main", "article") else hint
        elif key in ("class", "id"):
            for name in value.split():
                words = [w.lower() for w in WORDS.findall(name)]
                if words and words[0] in STATES:
                    continue
                if not NAMES.isdisjoint(words):
                    hint = HINTED if hint == HINTED or ALL_CLUTTER.issuperset(words) else UNSURE
                elif hint == PLAIN and not MAIN.isdisjoint(words):
                    hint = GOOD
    return False, hint


#: An element of the key closes an open one of the values up to the nearest of the last ones.
CLOSERS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
KEEPS_P = frozenset("td th table button div article section li main".split())


def parse(page: str) -> list[Node]:
    """The nodes of a page in page order, the root first, without what is never text: scripts, controls, hidden elements."""
    root = Node("html", PLAIN, None)
    nodes, stack, opened = [root], [("html", root)], defaultdict(int)  # None for a node: inside of something dropped
    at, size, last = 0, len(page), page.rfind(">") + 1  # a tag that no > ends swallows the rest

    def say(text: str) -> None:
        node = stack[-1][1]
        if node is not None and text:
            node.items.append(text)
            if opened["a"]:
                node.links += len(text.strip())

    def close(to: int) -> None:
        for tag, _ in stack[to:]:
            opened[tag] -= 1
        del stack[to:]

    while at < last:
        m = TOKEN.search(page, at, last)
        if m is None:
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        if m[1]:
            if opened[tag]:
                to = len(stack) - 1
                while stack[to][0] != tag:
                    to -= 1
                close(to)
            continue
        if tag == "br":
            say(" ")
            continue
        if opened["p"] and tag in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in KEEPS_P:
                    break
        if tag in CLOSERS:
            closed, bound = CLOSERS[tag]
            if any(opened[t] for t in closed):
                found = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in bound:
                        break
                    if stack[i][0] in closed:
                        found = i
                if found is not None:
                    close(found)
        parent, attributes = stack[-1][1], m[3]
        node = parent
        if parent is not None:
            hidden, hint = named(attributes) if attributes and ("=" in attributes or "hidden" in attributes) else (False, PLAIN)
            if hidden or tag in DROPPED or tag == "label" and opened["form"]:
                node = None
            elif tag in BLOCKS or hint < PLAIN:
                inside = opened["article"] or opened["main"]
                hint = GONE if tag in STRONG or tag == "header" and not inside else GOOD if tag in ("article", "main") else HINTED if tag in WEAK else hint
                node = Node(tag, PLAIN if hint in (HINTED, UNSURE) and tag in PROSE and tag not in ("ul", "ol", "dl") else hint, parent)
                parent.items.append(node)
                nodes.append(node)
        if tag in RAW:
            end = RAW_ENDS[tag].search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, node))
            opened[tag] += 1
    if at < size:
        rest = page[at:]
        cut_at = OPEN_TAG.search(rest)
        say(rest[: cut_at.start()] if cut_at else rest)
    finish(nodes)
    return nodes


def finish(nodes: list[Node]) -> None:
    """Joins the runs of text, numbers the nodes and sums up what is below them. Children stand behind their parents."""
    for place in range(len(nodes) - 1, -1, -1):
        n = nodes[place]
        n.place, n.chars, n.size, items, run = place, 0, 1, [], []
        for x in [*n.items, None]:
            if isinstance(x, str):
                run.append(x)
                continue
            if run:
                raw = entities.unescape("".join(run))
                items.append(raw)
                n.chars += len(raw.strip())
                run = []
            if x is not None:
                items.append(x)
                n.elements.append(x)
                n.chars += x.chars
                n.links += x.links
                n.size += x.size
        n.items = items
        n.shape = hash((n.tag, *(c.shape for c in n.elements)))
        n.full = hash((n.tag, *(" ".join(x.split()) if isinstance(x, str) else x.full for x in items)))


class Matcher:
    """Simple tree matching: the largest order-keeping mapping of nodes with equal tags. Scores are kept for each two shapes."""

    LIMIT = 200_000

    def __init__(self):
        self.known: dict[tuple[int, int], float] = {}

    def score(self, a: Node, b: Node) -> float:
        """Nodes of the largest mapping of two trees whose roots have the same tag."""
        if a.shape == b.shape:
            return float(a.size)
        if not a.elements or not b.elements:
            return 1.0
        if (a.shape, b.shape) not in self.known:
            self.solve(a, b)
        return self.known[a.shape, b.shape]

    def solve(self, a: Node, b: Node) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            own, theirs = {c.shape: c for c in x.elements}, {c.shape: c for c in y.elements}
            open_ = [(p, q) for p in own.values() for q in theirs.values() if p.tag == q.tag and p.shape != q.shape and p.elements and q.elements and (p.shape, q.shape) not in self.known]
            if open_:
                todo.extend(open_)
                continue
            self.known[x.shape, y.shape] = 1.0 + self.mapping(x.elements, y.elements, 0.0)
            todo.pop()

    def mapping(self, x: list[Node], y: list[Node], bonus: float, want: list[tuple[Node, Node]] | None = None) -> float:
        """The best score of an order-keeping mapping of two lists; equal texts count bonus more. want gets its pairs."""
        m = len(y)
        wide = m > 64
        zero = np.zeros(m + 1) if wide else [0.0] * (m + 1)
        weights: dict[int, object] = {}
        same = defaultdict(list)
        if bonus:
            for j, q in enumerate(y):
                same[q.full].append(j)

        def row(i: int) -> object:
            p = x[i]
            if p.shape not in weights:
                found = {q.shape: self.score(p, q) if p.tag == q.tag else 0.0 for q in y}
                line = [found[q.shape] for q in y]
                weights[p.shape] = np.array(line) if wide else line
            line = weights[p.shape]
            if bonus and (at := same.get(p.full)):
                line = line.copy()
                for j in at:
                    line[j] += bonus
            return line

        def after(last: object, line: object) -> object:
            if wide:
                return np.maximum.accumulate(np.concatenate(([0.0], np.maximum(last[1:], last[:-1] + line))))
            out, best, before = [0.0], 0.0, 0.0
            for above, w in zip(last[1:], line, strict=True):
                w += before
                best = max(w, above, best)
                out.append(best)
                before = above
            return out

        kept, last = [zero], zero
        for i in range(len(x)):
            last = after(last, row(i))
            if (i + 1) % ROWS_APART == 0:
                kept.append(last)
        score = float(last[m])
        if want is not None:
            j = m
            for k in range(len(kept) - 1, -1, -1):
                rows = [kept[k]]
                low = k * ROWS_APART
                for i in range(low, min(len(x), low + ROWS_APART)):
                    rows.append(after(rows[-1], row(i)))
                i = len(rows) - 1
                while i and j:
                    if rows[i][j] == rows[i - 1][j]:
                        i -= 1
                    elif rows[i][j] == rows[i][j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        want.append((x[low + i], y[j]))
        return score

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The mapping of two trees; among the largest for each two lists of children one with many equal texts."""
        if len(self.known) > self.LIMIT:
            self.known.clear()
        out, todo = [], [(a, b)]
        while todo:
            p, q = todo.pop()
            out.append((p, q))
            x, y = p.elements, q.elements
            # equal heads and tails map onto each other
            low, high, short = 0, 0, min(len(x), len(y))
            while low < short and x[low].full == y[low].full:
                low += 1
            while high < short - low and x[-1 - high].full == y[-1 - high].full:
                high += 1
            todo.extend(zip(x[:low], y[:low], strict=True))
            todo.extend(zip(x[len(x) - high :], y[len(y) - high :], strict=True))
            x, y = x[low : len(x) - high], y[low : len(y) - high]
            if len(x) == 1 == len(y):
                if x[0].tag == y[0].tag:
                    todo.append((x[0], y[0]))
            elif x and y:
                self.mapping(x, y, 0.5, todo)
        return out


def longest(nodes: list[Node]) -> list[int]:
    """The three longest texts of blocks without blocks inside."""
    leaves = sorted((n for n in nodes if not n.elements and n.chars), key=lambda n: (-n.chars, n.full))
    return [n.full for n in leaves[:3]]


class Wrapper:
    """What of a reference is content and what is template. evidence: (met, same, chars, links) of each node, by place."""

    def __init__(self, nodes: list[Node], evidence: dict[int, tuple[int, int, int, int]]):
        pages = max([1, *(e[0] for e in evidence.values())])
        none = (0, 0, 0, 0)
        figures = [evidence.get(n.place, none) for n in nodes]
        self.constant = {k for k, (met, same, _, _) in enumerate(figures) if met >= MIN_PAGES and same >= CONSTANT * met and k}
        plain = [max(0, chars - links) / pages for _, _, chars, links in figures]
        mass = plain.copy()  # text outside of links that is not constant, a page
        for k in range(len(nodes) - 1, 0, -1):
            if k in self.constant:
                mass[k] = 0.0
            mass[nodes[k].parent.place] -= plain[k] - mass[k]
        mass = [max(0.0, x) for x in mass]

        def weight(n: Node) -> float:
            if n.hint < UNSURE:
                return CLUTTER_WEIGHT * mass[n.place]
            return MAIN_WEIGHT * (mass[n.place] + MAIN_CHARS * (n.tag in ("article", "main"))) if n.hint == GOOD else mass[n.place]

        root = nodes[0]
        while root.elements:
            best = max(root.elements, key=weight)
            loose = mass[root.place] - sum(mass[c.place] for c in root.elements)
            if best.tag in PROSE or not weight(best) or weight(best) < DOMINANT * (sum(map(weight, root.elements)) + max(0.0, loose)):
                break
            if best.hint != GOOD and (root.hint == GOOD or any(c.tag in PROSE and mass[c.place] for c in root.elements)):
                break
            if best.hint == GONE or root.tag == "article":
                break
            root = best
        self.root = root.place
        self.gone: set[int] = set()
        for n in nodes[root.place + 1 : root.place + root.size]:
            met, _, chars, links = figures[n.place]
            if n.hint == GONE or n.hint == HINTED and mass[n.place] < NEARLY_ALL * mass[root.place]:
                self.gone.add(n.place)
            elif n.hint == UNSURE and chars and links >= UNSURE_LINKS * chars:
                self.gone.add(n.place)
            elif root.hint != GOOD and n.tag not in PROSE | {"article", "main"} and chars and links >= LINKS * chars:
                self.gone.add(n.place)
            elif root.hint != GOOD and n.tag in ("ul", "ol", "dl") and chars and links >= LINKS * chars:
                self.gone.add(n.place)


def alone(nodes: list[Node]) -> Wrapper:
    """The wrapper of a page from itself."""
    return Wrapper(nodes, {n.place: (1, 0, n.chars, n.links) for n in nodes})


def unwrapped(nodes: list[Node], reference: list[Node] | None, wrapper: Wrapper | None, matcher: Matcher) -> tuple[Node, set[int]]:
    """(content root, places of template nodes) of a page."""
    if wrapper is not None:
        met = {p.place: r for r, p in matcher.pairs(reference[0], nodes[0])}
        root = next((n for n in nodes if n.place in met and met[n.place].place == wrapper.root), None)
        if root is not None:
            gone = set()
            for n in nodes[root.place : root.place + root.size]:
                r = met.get(n.place)
                if r is None:
                    if n.hint < UNSURE or n.hint == UNSURE and n.links >= UNSURE_LINKS * n.chars:
                        gone.add(n.place)
                elif r.place in wrapper.gone or r.place in wrapper.constant and r.full == n.full or n.hint == GONE:
                    gone.add(n.place)
            return root, gone
    own = alone(nodes)
    return nodes[own.root], own.gone


def blocks(root: Node, gone: set[int]) -> list[str]:
    """Texts of the blocks below root in page order, without those of the nodes at the places gone."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            if text := " ".join("".join(run).split()):
                out.append(text)
            run.clear()

    todo: list[Node | str | None] = [root]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif x.place not in gone:
            block = x.tag in BLOCKS
            if block:
                end()
                todo.append(None)
            todo.extend(reversed(x.items))
    end()
    return out


class References:
    """Parsed references with their wrappers, those seen last."""

    def __init__(self, limit: int = 256):
        self.trees: dict[int, list] = {}
        self.limit = limit

    def tree(self, key: int, page: str) -> list:
        if key not in self.trees:
            if len(self.trees) >= self.limit:
                self.trees.clear()
            nodes = parse(page)
            self.trees[key] = [nodes, {n.full for n in nodes if not n.elements}, None]
        return self.trees[key]


NODES = "wrapper long, node int, met long, same long, chars long, links long"


def counted(pages: DataFrame) -> DataFrame:
    """NODES: what pages (wrapper, html, reference) hold at each node of their reference. Copies of the reference's text do not count."""
    schema = pa.schema([("wrapper", pa.int64()), ("node", pa.int32()), *((c, pa.int64()) for c in ("met", "same", "chars", "links"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references, matcher, sums = References(), Matcher(), {}
        rows = lambda: batch(schema, wrapper=[k[0] for k in sums], node=[k[1] for k in sums], **{c: [v[i] for v in sums.values()] for i, c in enumerate(("met", "same", "chars", "links"))})
        for b in batches:
            for key, page, reference in zip(b.column(0).to_pylist(), texts_of(b.column(1)), texts_of(b.column(2)), strict=True):
                tree, leaves, _ = references.tree(key, reference.decode())
                nodes = parse(page.decode())
                top = longest(nodes)
                if 2 * sum(x in leaves for x in top) > len(top) or not top:
                    continue
                for r, p in matcher.pairs(tree[0], nodes[0]):
                    own = sums.setdefault((key, r.place), [0, 0, 0, 0])
                    own[0] += 1
                    own[1] += r.full == p.full
                    own[2] += p.chars
                    own[3] += p.links
            if len(sums) > 100_000:
                yield rows()
                sums.clear()
        if sums:
            yield rows()

    return pages.mapInArrow(run, NODES).groupBy("wrapper", "node").agg(*(F.sum(c).alias(c) for c in ("met", "same", "chars", "links")))


def common_layouts(rows: DataFrame) -> DataFrame:
    """(host, layout, n, kind) of each layout of rows (host, layout, used): its n pages, and its containers on MIN_PAGES pages of the host or more.

    kind is equal for layouts that differ in rarer containers only, as where each page has a class of its own.
    """
    sizes = cut(rows.groupBy("host", "layout").agg(F.count("*").alias("n"), F.first("used").alias("used")))
    each = sizes.select("host", "layout", "n", F.explode("used").alias("container"))
    often = cut(each.groupBy("host", "container").agg(F.sum("n").alias("pages")).where(F.col("pages") >= MIN_PAGES).drop("pages"))
    few = often.count() <= BROADCAST_KEYS
    # beyond that a container of all layouts of a host is dealt to parts
    salt, salts = (F.lit(0), F.array(F.lit(0))) if few else (F.pmod(F.col("layout"), F.lit(SALTS)).cast("int"), F.sequence(F.lit(0), F.lit(SALTS - 1)))
    often = often.select("host", "container", F.explode(salts).alias("salt"))
    kept = each.withColumn("salt", salt).join(F.broadcast(often) if few else often, ["host", "container", "salt"])
    kinds = kept.groupBy("host", "layout").agg(F.xxhash64(F.array_sort(F.collect_set("container"))).alias("kind"))  # bounded by a page's containers
    return sizes.drop("used").join(kinds, ["host", "layout"], "left").withColumn("kind", F.coalesce("kind", F.lit(0)))


def wrappers(rows: DataFrame) -> DataFrame:
    """(host, layout, wrapper) of each layout of rows (host, layout, used): that of its kind, or of the host's most common kind."""
    layouts = cut(common_layouts(rows))
    sizes = layouts.groupBy("host", "kind").agg(F.sum("n").alias("n"))
    own = sizes.where(F.col("n") >= MIN_PAGES)
    most = own.groupBy("host").agg(F.max_by("kind", F.struct("n", "kind")).alias("common"))
    met = sizes.join(most, "host").select("host", "kind", F.when(F.col("n") >= MIN_PAGES, F.col("kind")).otherwise(F.col("common")).alias("taken"))
    taken = met.select("host", "kind", F.xxhash64("host", "taken").alias("wrapper"), (F.col("kind") == F.col("taken")).alias("own"))
    return layouts.join(taken, ["host", "kind"]).select("host", "layout", "wrapper", "own")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, wrapped) of every row of pages (page_id, url, html); wrapped: a wrapper of its host was there.

    Null html is empty and gives an empty text; pages without a host in their url share the empty host; repeated rows are
    judged each. A page is never dropped. Other columns are ignored.
    """
    host, _ = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    used = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(CONTAINER), F.lit(1)), lambda x: F.regexp_replace(F.lower(x), r"[0-9]+|\s+class\s*=", "")))
    rows = rows.withColumn("used", F.array_sort(F.transform(used, lambda x: F.xxhash64(x)))).withColumn("layout", F.xxhash64("used"))
    known = cut(wrappers(rows.select("host", "layout", "used")))
    rows = rows.drop("used")
    keys = known.withColumnsRenamed({"host": "own_host", "layout": "own_layout"})
    if known.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    rows = rows.join(keys, (F.col("host") == F.col("own_host")) & (F.col("layout") == F.col("own_layout")), "left").drop("own_host", "own_layout", "host", "layout")
    references = rows.where("own").groupBy("wrapper").agg(F.min_by("html", F.xxhash64("html")).alias("reference"))
    references = cut(references)
    chars = references.agg(F.sum(F.length("reference"))).first()[0] or 0
    salt = F.lit(0) if chars <= BROADCAST_CHARS else F.pmod(F.xxhash64("html", "url"), F.lit(SALTS)).cast("int")
    rows = rows.withColumn("salt", salt)

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.withColumnRenamed("wrapper", "its_wrapper")
        right = F.broadcast(right.withColumn("its_salt", F.lit(0))) if chars <= BROADCAST_CHARS else right.withColumn("its_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return left.join(right, (F.col("wrapper") == F.col("its_wrapper")) & (F.col("salt") == F.col("its_salt")), how)

    nodes = counted(joined(rows, references, "inner").select("wrapper", "html", "reference"))
    evidence = nodes.groupBy("wrapper").agg(F.collect_list(F.struct("node", "met", "same", "chars", "links")).alias("evidence"))  # bounded by a page's nodes
    induced = references.join(evidence, "wrapper")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("wrapped", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references, matcher = References(), Matcher()
        for b in batches:
            texts, wrapped = [], []
            for key, page, reference, figures in zip(b.column(2).to_pylist(), texts_of(b.column(3)), texts_of(b.column(4)), b.column(5), strict=True):
                tree = wrapper = None
                if figures.is_valid:
                    entry = references.tree(key, reference.decode())
                    if entry[2] is None:
                        entry[2] = Wrapper(entry[0], {x["node"]: (x["met"], x["same"], x["chars"], x["links"]) for x in figures.as_py()})
                    tree, _, wrapper = entry
                root, gone = unwrapped(parse(page.decode()), tree, wrapper, matcher)
                texts.append("\n\n".join(blocks(root, gone)))
                wrapped.append(wrapper is not None)
            yield batch(schema, page_id=b.column(0), url=b.column(1), text=texts, n_chars=[len(t) for t in texts], wrapped=wrapped)

    met = joined(rows, induced, "left").select(F.col("page_id").cast("long"), "url", "wrapper", "html", "reference", "evidence")
    return met.mapInArrow(run, "page_id long, url string, text string, n_chars long, wrapped boolean")
