"""HTML extraction by wrapper induction.

Pages of a host share a template. Each page's DOM is generalised (siblings
with the same label become one node), the commonest tree stands for the host,
and every page of the host is aligned to it by simple tree matching. A node
whose text is the same on nearly all pages is template; a node whose text
varies is a slot. The slots inside the content container, in page order, are
the main text.

The container is the host's ``article`` or ``main`` node where there is one,
else the node that most of the varying text lies under. Menus, headers,
footers, sidebars, notices, adverts, forms, scripts and comments vary too, so
elements marked as such by tag, role, class or id are never slots; but what a
form or a word in class, id or role marks stays if the content is in it. A
container's own nodes are template only when all but a hundredth of a
host's many pages agree, so copies of an article stay.

A null or empty html gives an empty text. Pages without a host, or alone on
theirs, are cut by the same rules without a template. Repeated rows are
extracted alike; other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import arrow_schema, map_columns, to_batch, written

# Fixed values of HTML: element classes by name.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body button caption html option optgroup tbody td tfoot th thead tr legend".split())
#: An element ends an open one of these when it starts, up to the given borders.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",)}
BORDERS = frozenset("ul ol menu dl table td th caption button object template html select".split())
PARENTS = {"li": frozenset("ul ol menu".split()), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]),
           "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]),
           "option": frozenset(["select"])}

# What is never content, by tag and by words in class, id and role.
DROPPED_TAGS = frozenset(
    "head script style noscript template title nav footer aside form button select textarea input iframe object "
    "svg canvas audio video map menu dialog search fieldset".split())
DROPPED_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments "
    "commentlist complementary consent contentinfo cookie cookies disqus footer form header login masthead menu "
    "modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related "
    "replies reply respond search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar topbar widget widgets".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = ("article", "main")

# A comment, a declaration, or a tag up to its name; ``Tags`` finds a tag's end.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
QUOTE_OR_END = re.compile(r">|=\s*+([\"'])")
MARK = re.compile(r"""(?:^|\s)(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NOT_NAME = re.compile(r"[^a-z0-9:-]")
SPLIT = re.compile(r"[^a-z0-9]+")
DEEPEST = 200             # levels of a tree; what is nested deeper belongs to the last one
TEMPLATE_SHARE = 0.9      # of a host's pages that agree on a node's text
INNER_SHARE = 0.99        # the same, inside the container
TEMPLATE_PAGES = 5        # aligned pages, at least, to call a node template
INNER_PAGES = 50
CONTAINER_SHARE = 0.7     # of the varying text, for a child to be the container
FLUSH_CHARS = 4_000_000   # of distinct skeletons a task counts before it passes them on


@dataclass(eq=False)
class Node:
    """A generalised node: all siblings with one label."""
    label: str
    dropped: bool
    parent: "Node | None"
    children: dict = field(default_factory=dict)
    depth: int = 0
    sure: bool = False        # dropped by more than a word or a form
    doubtful: tuple = ()      # the nodes from the root to this one that only a word or a form drops
    box: "Node | None" = None  # the innermost container

    def child(self, label: str, dropped: bool, sure: bool = True) -> "Node":
        flat = self.depth >= DEEPEST  # only whether it is dropped is told of what is nested deeper
        if flat and (not dropped or self.sure or (self.dropped and not sure)):
            return self
        got = None if flat else self.children.get(label)
        if got is None:
            got = Node("" if flat else label, dropped or self.dropped, self, depth=self.depth + 1,
                       sure=self.sure or (dropped and sure), doubtful=self.doubtful, box=self.box)
            if dropped and not sure:
                got.doubtful += (got,)
            if label.partition(" ")[0] in CONTAINERS and not dropped:
                got.box = got
            if not flat:
                self.children[label] = got
        return got

    def path(self) -> tuple:
        """Labels from the root."""
        out, node = [], self
        while node is not None:
            out.append(node.label)
            node = node.parent
        return tuple(reversed(out))


class Tags:
    """Ends of the tags of a page, in one pass over it.

    Quoted values may hold ``>`` and have any length. A tag with a quote that
    is never closed ends at the next ``>``. What a failed search has gone
    through is not gone through again, so broken pages cost no more.
    """

    def __init__(self, text: str):
        self.text = text
        self.last = text.rfind(">")
        self.failed: set[int] = set()  # quotes from which no end is reached

    def end(self, at: int) -> int:
        """The place of the ``>`` of the tag whose name ends at ``at``, or -1."""
        if at > self.last:
            return -1
        place, opened = at, []
        while m := QUOTE_OR_END.search(self.text, place):
            if not m[1]:
                return m.start()
            quote = m.end() - 1
            if quote in self.failed:
                break
            opened.append(quote)
            place = self.text.find(m[1], m.end()) + 1
            if not place:
                break
        self.failed.update(opened)
        return self.text.find(">", at)


class Open:
    """The open elements of a page, of any depth; each step takes constant
    time, or that of the elements it ends."""

    def __init__(self, root: Node):
        self.stack: list[tuple[str, Node]] = [("", root)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    @property
    def node(self) -> Node:
        return self.stack[-1][1]

    @property
    def block(self) -> Node:
        """The node of the innermost block element."""
        return self.stack[self.blocks[-1] if self.blocks else 0][1]

    def push(self, tag: str, node: Node) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node))

    def nearest(self, names) -> int:
        """The innermost open element of these names, or 0."""
        return max((self.places[t][-1] for t in names if self.places.get(t)), default=0)

    def end(self, i: int) -> None:
        """End element ``i`` and all in it."""
        while len(self.stack) > i or (len(self.stack) > 1 and not self.stack[-1][0]):
            tag, _ = self.stack.pop()
            if tag:
                self.places[tag].pop()
                if tag in BLOCK:
                    self.blocks.pop()

    def end_alone(self, i: int) -> None:
        """End element ``i``, the innermost of its name and not a block, but nothing in it."""
        tag, node = self.stack[i]
        self.places[tag].pop()
        self.stack[i] = "", node


def marks(attributes: str) -> tuple[str, bool, frozenset]:
    """Class and id as part of a label, whether they hide the element, and
    which of their words name something dropped. A class of several words
    names it only with all of them: ``nav-menu``, but not ``has-sidebar``."""
    named, hidden, found = [], False, set()
    for name, a, b, c in MARK.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden":
            hidden = hidden or value != "until-found"
            continue
        for token in value.split():
            words = [w for w in SPLIT.split(token) if w]
            plain = [w for w in words if not w.isdigit()]
            if plain and DROPPED_WORDS.issuperset(plain):
                found.update(plain)
            named += plain
    return ".".join(sorted(set(named))), hidden, frozenset(found)


def parse(text: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The generalised tree of a page, and its blocks of text in page order.

    A block is the text between two borders of block elements, with character
    references decoded and white space folded; dropped elements give none. An
    element that only a word or a form drops is kept if it turns out to hold
    the page's content.
    """
    root, blocks, doubted = read(text)
    spared = holders(blocks, doubted)
    return read(text, spared)[:2] if spared else (root, blocks)


def holders(blocks: list[tuple[Node, str]], doubted: Counter) -> frozenset:
    """Paths of the elements around the content that only a word or a form
    drops: around an article or main, or of a form, with more text than the
    page keeps; else, where nothing is kept, around most of the text."""
    if not doubted:
        return frozenset()
    kept = sum(len(t) for _, t in blocks)
    boxes, forms, every = Counter(), Counter(), Counter()
    for node, n in doubted.items():
        every[node.doubtful] += n
        if node.box is not None and node.doubtful == node.box.doubtful:
            boxes[node.doubtful] += n
        elif len(node.doubtful) == 1 and node.doubtful[0].label.partition(" ")[0] == "form":
            forms[node.doubtful] += n
    if any(n.box is not None for n, _ in blocks):
        return frozenset()
    for found, least in ((boxes, kept), (forms, kept), (Counter() if kept else every, 0)):
        if found:
            best = max(found, key=found.get)
            if found[best] > least:
                return frozenset(n.path() for n in best)
    return frozenset()


def read(text: str, spared: frozenset = frozenset()) -> tuple[Node, list[tuple[Node, str]], Counter]:
    """Tree and blocks of a page, and the characters under each node that only
    words or forms drop. Elements at the ``spared`` paths are not dropped so."""
    root = Node("", False, None)
    elements, tags = Open(root), Tags(text)
    blocks: list[tuple[Node, str]] = []
    held: list[str] = []
    seen: dict[str, tuple[str, bool, frozenset]] = {}
    doubted: Counter = Counter()

    def hold(part: str) -> None:
        node = elements.node
        if not node.dropped:
            held.append(part)
        elif not node.sure and (n := len(part.strip())):
            doubted[node] += n

    def end_block() -> None:
        if held:
            words = references.unescape("".join(held)).split()
            held.clear()
            if words:
                blocks.append((elements.block, " ".join(words)))

    def close(names: tuple, borders: frozenset) -> None:
        i = elements.nearest(names)
        if i and i >= elements.nearest(borders):
            end_block()
            elements.end(i)

    at = look = 0
    while m := TOKEN.search(text, look):
        start, look = m.start(), m.end()
        tag = m[2]
        if tag:
            end = tags.end(look)
            if end < 0:
                continue
            attributes, look = text[look:end], end + 1
        if start > at:
            hold(text[at:start])
        at = look
        if not tag:
            continue
        tag = NOT_NAME.sub("_", tag.lower())
        if m[1]:
            i = elements.nearest((tag,))
            if not i:
                continue
            if tag in BLOCK:
                end_block()
                elements.end(i)
            elif i >= elements.nearest(BORDERS):
                if elements.blocks and elements.blocks[-1] > i:
                    elements.end_alone(i)  # an inline element that a block was opened in
                else:
                    elements.end(i)
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            elif tag == "br" and not elements.node.dropped:
                held.append(" ")
            continue
        if tag in CLOSES_P:
            close(("p",), BORDERS)
        if tag in SIBLINGS:
            close(SIBLINGS[tag], PARENTS[tag])
        if tag in BLOCK:
            end_block()
        known = seen.get(attributes)
        if known is None:
            known = seen[attributes] = marks(attributes) if attributes.strip() else ("", False, frozenset())
        named, sure, words = known
        label = f"{tag} {named}" if named else tag
        if tag in CONTAINERS or tag in ("html", "body"):
            sure, words = "comment" in named.split(".") or "comments" in named.split("."), frozenset()
        elif tag == "header":  # the page's, not an article's own
            sure = sure or not elements.nearest(CONTAINERS)
        elif tag in HEADINGS:
            words = frozenset()
        elif tag != "form":
            sure = sure or tag in DROPPED_TAGS
        sure = sure or not COMMENT_WORDS.isdisjoint(words)
        dropped = sure or bool(words) or tag == "form"
        if dropped and not sure and spared and (*elements.node.path(), label) in spared:
            dropped = False
        node = elements.node.child(label, dropped, sure)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(text, at)
            at = look = end.end() if end else len(text)
        elif tag in BLOCK or not attributes.endswith("/"):
            elements.push(tag, node)
    if at < len(text):
        hold(text[at:])
    end_block()
    return root, [(n, t) for n, t in blocks if not n.dropped], doubted


def skeleton(node: Node) -> str:
    """The tree as text: label(children)."""
    return node.label + "(" + ",".join(map(skeleton, node.children.values())) + ")"


def from_skeleton(text: str) -> Node:
    root = Node("", False, None)
    stack = [root]
    for label, mark in re.findall(r"([^(),]*)([(),])", text[1:]):
        if mark == "(":
            parent = stack[-1]
            node = Node(label, False, parent)
            parent.children[label] = node
            stack.append(node)
        elif mark == ")" and len(stack) > 1:
            stack.pop()
    return root


def numbered(root: Node) -> dict[Node, int]:
    """Nodes in document order."""
    out: dict[Node, int] = {}
    stack = [root]
    while stack:
        node = stack.pop()
        out[node] = len(out)
        stack.extend(reversed(list(node.children.values())))
    return out


def simple_tree_matching(a: Node, b: Node) -> dict[Node, Node]:
    """The largest order-preserving matching of two trees from their roots:
    nodes of ``a`` to nodes of ``b`` with the same labels and matched parents."""
    memo: dict = {}

    def size(x: Node, y: Node) -> int:
        if x.label != y.label:
            return 0
        got = memo.get((x, y))
        if got is None:
            table = grid(x, y)
            got = memo[x, y] = 1 + table[-1][-1]
        return got

    def grid(x: Node, y: Node) -> list[list[int]]:
        ys = list(y.children.values())
        table = [[0] * (len(ys) + 1)]
        for p in x.children.values():
            above, row = table[-1], [0]
            for j, q in enumerate(ys):
                row.append(max(above[j + 1], row[j], above[j] + size(p, q)))
            table.append(row)
        return table

    pairs = {}
    waiting = [(a, b)] if a.label == b.label else []
    while waiting:
        x, y = waiting.pop()
        pairs[x] = y
        xs, ys, table = list(x.children.values()), list(y.children.values()), grid(x, y)
        i, j = len(xs), len(ys)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                waiting.append((xs[i], ys[j]))
    return pairs


class Aligner:
    """Alignment of pages to their host's reference tree, remembered by the
    two trees' skeletons."""

    def __init__(self, most: int = 20_000):
        self.known: dict[tuple[str, str], dict[str, int]] = {}
        self.most = most

    def places(self, root: Node, reference: str) -> dict[Node, int]:
        """Page node → number of the reference node it is matched to."""
        key = (skeleton(root), reference)
        mine = numbered(root)
        got = self.known.get(key)
        if got is None:
            ref = from_skeleton(reference)
            numbers = numbered(ref)
            got = {mine[x]: numbers[y] for x, y in simple_tree_matching(root, ref).items()}
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[key] = got
        return {x: got[n] for x, n in mine.items() if n in got}


def host_of(url: Column) -> Column:
    """Host in lower case, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def slots(blocks: list[tuple[Node, str]]) -> dict[Node, str]:
    """All text of each node."""
    out: dict[Node, list[str]] = {}
    for node, text in blocks:
        out.setdefault(node, []).append(text)
    return {n: "\n".join(t) for n, t in out.items()}


def induce(pages: DataFrame) -> DataFrame:
    """One row per host: (host, skeleton, nodes); ``nodes`` holds for each
    reference node with text (node, pages, agree, chars): how many pages have
    it, how many of them share its commonest text, and its mean length.

    The reference of a host is the commonest tree of its pages with text, of
    equally common ones the last by its text. Counts cover every page; they are
    added up in the tasks before they are moved.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html")).where("host IS NOT NULL")

    # Skeletons are counted in each task first; pages without text have no say.
    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size = Counter(), 0
        for batch in batches:
            for host, text in zip(*(batch.column(i).to_pylist() for i in range(2))):
                root, blocks = parse(text or "")
                if blocks:
                    key = host, skeleton(root)
                    size += 0 if key in n else len(key[1])
                    n[key] += 1
            if size > FLUSH_CHARS:
                yield to_batch(outline(n), schema)
                n, size = Counter(), 0
        if n:
            yield to_batch(outline(n), schema)

    def outline(n):
        return {"host": [k[0] for k in n], "skeleton": [k[1] for k in n], "n": list(n.values())}

    ddl = "host string, skeleton string, n bigint"
    schema = arrow_schema(ddl)
    trees = written(rows.mapInArrow(outlines, ddl).groupBy("host", "skeleton").agg(F.sum("n").alias("n"))
                    .groupBy("host").agg(F.max_by("skeleton", F.struct("n", "skeleton")).alias("skeleton")), "outlines")

    count_ddl = "host string, node int, digest bigint, n bigint, chars bigint"
    count_schema = arrow_schema(count_ddl)

    def flush(n: Counter, chars: Counter) -> pa.RecordBatch:
        keys = list(n)
        return to_batch({"host": [k[0] for k in keys], "node": [k[1] for k in keys], "digest": [k[2] for k in keys],
                         "n": [n[k] for k in keys], "chars": [chars[k] for k in keys]}, count_schema)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, n, chars = Aligner(), Counter(), Counter()
        for batch in batches:
            for host, text, tree in zip(*(batch.column(i).to_pylist() for i in range(3))):
                root, blocks = parse(text or "")
                places = aligner.places(root, tree)
                for node, slot in slots(blocks).items():
                    if node in places:
                        key = host, places[node], xxhash.xxh64_intdigest(slot) - (1 << 63)
                        n[key] += 1
                        chars[key] += len(slot)
            if len(n) > 100_000:
                yield flush(n, chars)
                n, chars = Counter(), Counter()
        if n:
            yield flush(n, chars)

    counts = (rows.join(trees, "host").select("host", "html", "skeleton").mapInArrow(counted, count_ddl)
              .groupBy("host", "node", "digest").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
              .groupBy("host", "node").agg(F.sum("n").alias("pages"), F.max("n").alias("agree"),
                                           (F.sum("chars") / F.sum("n")).alias("chars"))
              .groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "pages", "agree", "chars"))).alias("nodes")))
    return written(trees.join(counts, "host", "left"), "templates")


class Template:
    """A host's reference tree with its constant nodes and its container."""

    def __init__(self, tree: str, nodes: list | None):
        root = from_skeleton(tree)
        numbers = numbered(root)
        by_number = {k: n for n, k in numbers.items()}
        stats = {s["node"]: s for s in nodes or []}
        self.container = next((k for k, n in sorted(by_number.items()) if is_container(n)), None)
        varying = {k: 0.0 if self.constant(stats.get(k), False) else (stats[k]["chars"] if k in stats else 0.0)
                   for k in by_number}
        if self.container is None:
            self.container = heaviest(root, {n: varying[k] for n, k in numbers.items()}, numbers)
        inside = set(numbered(by_number[self.container])) if self.container in by_number else set()
        self.template = {k for k in stats if self.constant(stats[k], by_number.get(k) in inside)}

    @staticmethod
    def constant(s: dict | None, inner: bool) -> bool:
        least, share = (INNER_PAGES, INNER_SHARE) if inner else (TEMPLATE_PAGES, TEMPLATE_SHARE)
        return s is not None and s["pages"] >= least and s["agree"] >= share * s["pages"]


def is_container(node: Node) -> bool:
    tag, _, named = node.label.partition(" ")
    return not node.dropped and (tag in CONTAINERS) and "comment" not in named


def heaviest(root: Node, weight: dict[Node, float], numbers: dict[Node, int]) -> int:
    """The lowest node that all but a share of the varying text lies under."""
    def total(n: Node) -> float:
        return weight.get(n, 0.0) + sum(map(total, n.children.values()))

    node = root
    while node.children:
        best = max(node.children.values(), key=total)
        tag = best.label.partition(" ")[0]
        if tag not in ("html", "body", "div", "section", "table", "tbody", "tr", "td", "center", "main", "article"):
            break
        if total(best) < CONTAINER_SHARE * max(total(node), 1e-9):
            break
        node = best
    return numbers[node]


def main_text(html: str, template: Template | None, tree: str | None, aligner: Aligner) -> str:
    """The main text of one page."""
    root, blocks = parse(html)
    if not blocks:
        return ""
    places = aligner.places(root, tree) if template else {}
    constant = {n for n, k in places.items() if k in template.template} if template else set()
    # The page's nodes that stand for the container; where the page has none, its own.
    inside = {n for n, k in places.items() if k == template.container} if template else set()
    if not inside or not any(within(n, inside) for n, _ in blocks):
        own = [n for n in numbered(root) if is_container(n)]
        if own:
            inside = set(own)
        else:
            numbers = numbered(root)
            text = slots(blocks)
            chosen = heaviest(root, {n: float(len(text.get(n, ""))) for n in numbers if n not in constant}, numbers)
            inside = {n for n, k in numbers.items() if k == chosen}
    return "\n".join(t for n, t in blocks if n not in constant and within(n, inside))


def within(node: Node, roots: set[Node]) -> bool:
    while node is not None:
        if node in roots:
            return True
        node = node.parent
    return False


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Templates are joined by host; whether they are broadcast is Spark's choice
    by the size of the written table.
    """
    templates = induce(pages)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    known: dict = {}

    def run(c):
        aligner = known.setdefault("aligner", Aligner())
        found = known.setdefault("templates", {})
        texts = []
        for html, host, tree, nodes in zip(c["html"], c["host"], c["skeleton"], c["nodes"]):
            template = None
            if tree is not None:
                template = found.get(host)
                if template is None:
                    if len(found) >= 5_000:
                        found.clear()
                    template = found[host] = Template(tree, nodes)
            texts.append(main_text(html or "", template, tree, aligner))
        return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_chars": list(map(len, texts))}

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_columns(rows.join(templates, "host", "left"), run,
                       f"page_id {kind}, url string, text string, n_chars bigint")
