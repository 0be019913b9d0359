"""Main text of web pages by wrapper induction: same-host pages are aligned by simple tree matching, constant nodes are template, varying slots content."""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopwise.llm.common import checkpointed, picked

#: A text at a node is constant if so many different pages of a host have it there, and such a share of those that have the node.
MIN_PAGES = 3
MIN_SHARE = 0.2
#: The same inside an article: what only repeats in copies of an article is not its template.
ARTICLE_PAGES = 5
ARTICLE_SHARE = 0.8
#: Pages of a host whose common tree is its template.
REFERENCES = 8
#: Pages of a host, about, that one task aligns at a time.
SLICE_PAGES = 128
#: Children of a node above which only those of one label are matched, instead of all with one tag.
MANY = 512
#: Hosts up to which a table with a few numbers for each is broadcast; beyond, it is joined.
BROADCAST_HOSTS = 100_000

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object embed svg canvas audio video menu dialog map math".split())
# Words in class, id and role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer discussion disqus feedback "
    "footer header masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion promoted recommend recommended related "
    "replies reply respond responses reviews search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget widgets "
    "complementary contentinfo alert alertdialog".split()
)
# Those of them that often hold article elements which are not the article.
OTHERS = frozenset("comment comments commentlist discussion disqus feedback promo promoted recommend recommended related replies reply respond responses reviews sidebar sponsored".split())
# Words that may stand beside those in a name without changing what it says; "has-sidebar" or "comments-open" say something else.
BESIDE = frozenset(
    "area article bar bars blog body block blocks bottom box btn button buttons center col column container content entry fixed form global group icon icons inline inner item items left link links "
    "list lists local main meta mobile module nav news outer page panel post posts primary reader readers right row secondary section site sticky story text title top unit user users view wrap wrapper wp".split()
)

# Elements whose start ends an open element, up to the given containers.
_ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_HINT = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Node:
    """An element: its label is its tag with its classes; marks say whether it is hidden, named as something to drop, or the main part. Children are nodes and runs of text, in order. holds: whether an article is in it."""

    __slots__ = ("tag", "label", "marks", "children", "holds")

    def __init__(self, tag: str, label: str, marks: frozenset) -> None:
        self.tag, self.label, self.marks, self.children, self.holds = tag, label, marks, [], False

    @property
    def main(self) -> bool:
        return self.tag in ("article", "main") or "main" in self.marks


def _open(tag: str, attributes: str) -> Node:
    if not attributes.strip():
        return Node(tag, tag, frozenset())
    marks, label = set(), tag
    for name, a, b, c in _HINT.findall(attributes):
        name, value = name.lower(), html.unescape(a or b or c)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            marks.add("hidden")
        elif name in ("class", "id", "role"):
            for said in value.split():
                words = {w.lower() for w in _WORD.findall(said) if not w.isdigit()}
                if words & MARKS and words <= MARKS | BESIDE:
                    marks |= {"dropped", "others"} if words & OTHERS else {"dropped"}
            if name == "class":
                label = ".".join([tag, *sorted({x for x in value.split() if not re.search("[0-9]", x)})])  # a number is of the page, not of the site
            elif name == "role" and value.lower() == "main":
                marks.add("main")
    return Node(tag, label, frozenset(marks))


def _dropped(node: Node, inside: bool) -> bool:
    """Whether tag or marks rule the element out. A mark does not if the article is in it, and it says nothing of other articles."""
    if node.tag in DROPPED or node.tag in VOID or "hidden" in node.marks or (node.tag == "header" and not inside):
        return True
    return "dropped" in node.marks and node.tag not in ("html", "body", "main") and (inside or "others" in node.marks or not node.holds)


def parse(source: str) -> Node:
    """The tree of a page, whatever is left open, closed twice or cut off in it."""
    root = Node("", "", frozenset())
    stack, at, n = [root], 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        end = m.start() if m else n
        if end > at:
            stack[-1].children.append(source[at:end])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or not m[0].endswith(">"):
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body", "table") and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK or stack[i].tag == "button":
                    break
        if tag in _ENDS:
            ended, within = _ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in within:
                    break
                if stack[i].tag in ended.split():
                    del stack[i:]
                    break
        node = _open(tag, m[3])
        stack[-1].children.append(node)
        if node.main:
            for n_open in reversed(stack):
                if n_open.holds:
                    break
                n_open.holds = True
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            node.children.append(source[at : close.start()] if close else source[at:])
            at = close.end() if close else n
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


class Shape:
    """A node of a page's tree of block elements, in which siblings of one label are one node: a list. texts: keys of the texts at it."""

    __slots__ = ("tag", "label", "children", "texts", "number")

    def __init__(self, label: str, number: int = -1) -> None:
        self.tag, self.label, self.number = label.partition(".")[0], label, number
        self.children: list[Shape] = []
        self.texts: set[int] = set()


class Page:
    """A page's shape, and its blocks of text in page order without what tags and marks rule out: (node, text, whether in an article)."""

    def __init__(self, source: str) -> None:
        self.shape, self.blocks = Shape(""), []
        below: dict[tuple[int, str], Shape] = {}
        run: list[str] = []

        def said(shape: Shape, inside: bool, dropped: bool) -> None:
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                run.clear()
                if text and not dropped:
                    shape.texts.add(key_of(text))
                    self.blocks.append((shape, text, inside))

        # (children left, shape, inside, dropped, whether a block begins there)
        stack = [(iter(parse(source).children), self.shape, False, False, True)]
        while stack:
            rest, shape, inside, dropped, block = stack[-1]
            c = next(rest, None)
            if c is None:
                stack.pop()
                if block:
                    said(shape, inside, dropped)
            elif isinstance(c, str):
                run.append(c)
            elif c.tag == "br":
                run.append(" ")
            elif c.tag in BLOCK:
                said(shape, inside, dropped)
                if (child := below.get((id(shape), c.label))) is None:
                    child = below[id(shape), c.label] = Shape(c.label)
                    shape.children.append(child)
                stack.append((iter(c.children), child, inside or c.main, dropped or _dropped(c, inside), True))
            elif not _dropped(c, inside):
                stack.append((iter(c.children), shape, inside, dropped, False))


def key_of(text: str, node: int = 0) -> int:
    """64 bits of a text at a node, signed."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), node & 0xFFFFFFFFFFFFFFFF)
    return h - (1 << 64) if h >> 63 else h


def node_weight(t: Shape, p: Shape) -> int:
    """What two matched nodes count without their children: themselves, the same classes, a text in common."""
    return 1 + (t.label == p.label) + (not t.texts.isdisjoint(p.texts)) if t.tag == p.tag else 0


class Matching:
    """Simple tree matching: the heaviest match of two trees that keeps order, whose matched nodes have one tag and matched parents. Without recursion, so a tree may be of any depth.

    Lists of over MANY children are matched by equal labels alone, of which there is one at most for each; so the work
    for two lists is no product of unbounded numbers.
    """

    def __init__(self, a: Shape, b: Shape) -> None:
        self.a, self.b, self.below = a, b, {}
        met = [(a, b)] if a.tag == b.tag else []
        for x, y in met:
            if x.children and y.children:
                met += [(c, d) for c, d in self._options(x, y) if c.children and d.children]
        for x, y in reversed(met):
            if x.children and y.children:
                self.below[id(x), id(y)] = self._best(x, y)[-1][-1] if not self._long(x, y) else sum(self.weight(c, d) for c, d in self._chain(x, y))

    @staticmethod
    def _long(x: Shape, y: Shape) -> bool:
        return max(len(x.children), len(y.children)) > MANY

    def _options(self, x: Shape, y: Shape) -> Iterator[tuple[Shape, Shape]]:
        if self._long(x, y):
            other = {d.label: d for d in y.children}
            return ((c, other[c.label]) for c in x.children if c.label in other)
        return ((c, d) for c in x.children for d in y.children if c.tag == d.tag)

    def weight(self, x: Shape, y: Shape) -> int:
        """Of the match of two trees whose roots are matched; 0 if these can't be."""
        w = node_weight(x, y)
        return w + self.below.get((id(x), id(y)), 0) if w else 0

    def _best(self, x: Shape, y: Shape) -> list[list[int]]:
        """Weights of the best matches of the first i and the first j children."""
        table = [[0] * (len(y.children) + 1)]
        for c in x.children:
            row, above = [0], table[-1]
            for j, d in enumerate(y.children):
                most = max(above[j + 1], row[j])
                if c.tag == d.tag:
                    most = max(most, above[j] + self.weight(c, d))
                row.append(most)
            table.append(row)
        return table

    def _chain(self, x: Shape, y: Shape) -> list[tuple[Shape, Shape]]:
        """The longest chain of children of equal labels that are in one order on both sides."""
        at = {d.label: j for j, d in enumerate(y.children)}
        last, ends, before = [], [], {}
        for c in x.children:
            if (j := at.get(c.label)) is not None:
                n = bisect_left(last, j)
                before[j] = ends[n - 1] if n else None
                last[n : n + 1], ends[n : n + 1] = [j], [(c, j)]
        out, here = [], ends[-1] if ends else None
        while here is not None:
            out.append((here[0], y.children[here[1]]))
            here = before[here[1]]
        return out[::-1]

    def children(self, x: Shape, y: Shape) -> list[tuple[Shape, Shape]]:
        """Children of two matched nodes that the match pairs."""
        if not x.children or not y.children:
            return []
        if self._long(x, y):
            return self._chain(x, y)
        table, i, j, out = self._best(x, y), len(x.children), len(y.children), []
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((x.children[i], y.children[j]))
        return out[::-1]

    def pairs(self) -> list[tuple[Shape, Shape]]:
        """All matched nodes, parents first."""
        out = [(self.a, self.b)] if self.a.tag == self.b.tag else []
        for x, y in out:
            out += self.children(x, y)
        return out


class Template:
    """The common tree of a host's reference pages: each is aligned with the tree so far, and what has no match goes in beside its matched siblings."""

    def __init__(self) -> None:
        self.root = Shape("")

    def add(self, page: Shape) -> None:
        matched = Matching(self.root, page).pairs()
        partner = {id(y): x for x, y in matched}
        for t, p in matched:
            t.texts |= p.texts
            at = 0
            for c in p.children:
                if id(c) in partner:
                    at = next(i for i in range(at, len(t.children)) if t.children[i] is partner[id(c)]) + 1
                else:
                    t.children.insert(at, c)
                    at += 1

    def packed(self) -> str:
        """Parent, label and texts of each node, parents first."""
        nodes, out = [(-1, self.root)], []
        for parent, n in nodes:
            nodes += [(len(out), c) for c in n.children]
            out.append((parent, n.label, sorted(n.texts)))
        return json.dumps(out)

    @staticmethod
    def unpacked(text: str) -> Template:
        t, nodes = Template(), []
        for i, (parent, label, texts) in enumerate(json.loads(text)):
            n = Shape(label, i)
            n.texts.update(texts)
            if parent >= 0:
                nodes[parent].children.append(n)
            nodes.append(n)
        t.root = nodes[0]
        return t

    def nodes(self, page: Shape) -> dict[int, int]:
        """For each node of a page, by id: the template's node that it is aligned with; nodes without one are known by their labels below it."""
        matched = {id(p): t.number for t, p in Matching(self.root, page).pairs()}
        found, todo = {id(page): 0}, [page]
        for n in todo:
            for c in n.children:
                found[id(c)] = matched[id(c)] if id(c) in matched else key_of(c.label, ~found[id(n)])
                todo.append(c)
        return found


def node_counts(template: Template, pages: Iterable[Page]) -> Counter:
    """Pages with a block at a node, in an article or not: (node, inside, None) -> pages; with this text there: (node, inside, text) -> pages."""
    out: Counter = Counter()
    for p in pages:
        node = template.nodes(p.shape)
        out.update({(node[id(shape)], inside, None) for shape, _, inside in p.blocks})
        out.update({(node[id(shape)], inside, key_of(text, node[id(shape)])) for shape, text, inside in p.blocks})
    return out


def main_text(page: Page, template: Template | None, constant: frozenset | set) -> str:
    """The article's blocks, if there are any, else all blocks, without those that are constant at their node.

    A page that is all template is taken for untemplated, as is an article of which template would be half or more.
    """
    chosen = [b for b in page.blocks if b[2]]
    article, chosen = bool(chosen), chosen or page.blocks
    if constant and template is not None:
        node = template.nodes(page.shape)
        left = [b for b in chosen if key_of(b[1], node[id(b[0])]) not in constant]
        if left and (not article or 2 * sum(len(b[1]) for b in left) > sum(len(b[1]) for b in chosen)):
            chosen = left
    return "\n".join(b[1] for b in chosen)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """For a join: broadcast if it has so few rows, of three numbers at most."""
    return F.broadcast(df) if rows <= BROADCAST_HOSTS else df


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def _templates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, digest, html) sorted by host and digest: a template for each host."""
    host = seen = held = None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([host], pa.int64()), pa.array([held.packed()])], names=["host", "template"])

    for b in batches:
        for h, digest, source in zip(b["host"].to_pylist(), b["digest"].to_pylist(), b["html"].to_pylist(), strict=True):
            if h != host:
                if held is not None:
                    yield told()
                host, seen, held = h, None, Template()
            if digest != seen:
                seen = digest
                held.add(Page(source).shape)
    if held is not None:
        yield told()


def _counts(key: tuple, pages: pa.Table, template: pa.Table) -> pa.Table:
    names = {"host": pa.int64(), "node": pa.int64(), "inside": pa.bool_(), "key": pa.int64(), "n": pa.int64()}
    found: Counter = Counter()
    if template.num_rows and pages.num_rows:
        t, sources = Template.unpacked(template["template"][0].as_py()), dict(zip(pages["digest"].to_pylist(), pages["html"].to_pylist(), strict=True))
        found = node_counts(t, (Page(s) for s in sources.values() if s))
    host = key[0].as_py()
    return pa.table([pa.array([host] * len(found), pa.int64()), *[pa.array([k[i] for k in found], kind) for i, kind in enumerate(list(names.values())[1:4])], pa.array(list(found.values()), pa.int64())], names=list(names))


def _texts(key: tuple, pages: pa.Table, template: pa.Table) -> pa.Table:
    t, constant = None, frozenset()
    if template.num_rows and pages.num_rows:
        t, constant = Template.unpacked(template["template"][0].as_py()), frozenset(template["constant"][0].as_py() or ())
    out = [main_text(Page(s), t, constant) if s else "" for s in pages["html"].to_pylist()]
    return pa.table([pages["page_id"], pages["url"], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(df: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    A host's template is the common tree of REFERENCES of its pages, those whose digests are least in as many parts of
    the digests. Every page of the host is aligned with it by simple tree matching, which names the nodes of its texts.
    A text that many pages have at one node, of those that have the node, is constant there: template. What varies is
    content: the article or main element where a page has one, else all blocks, each without what is constant and
    without what tags, roles and class names mark as menus, notices, adverts, forms, comments and the like. Blocks are
    joined by one newline in page order, white space in a block is one space, character references are decoded.

    Pages are dealt by host and a part of their digest, so that a hot host is many groups; both passes over them read
    the same exchange. A page repeated whole counts once, as copies have one digest and meet in one group; so results
    do not depend on the partitioning. Template and constants of a host are sent to each of its groups.

    A null or empty page gives an empty text; a page without a host has no constant nodes, nor has one of fewer than
    MIN_PAGES different ones; pages may be of any length and depth, a group's being in memory at once; page_id and url
    are passed on, null or not; other columns are not looked at; an empty table gives an empty result.
    """
    rows = picked(df, page_id=page_id, url=url, html=source).withColumn("host", F.when(host_of(F.col("url")) != "", F.xxhash64(host_of(F.col("url")))).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("digest", F.xxhash64("html"))
    size = checkpointed(rows.groupBy("host").agg(F.count("*").alias("n")).select("host", F.ceil(F.col("n") / SLICE_PAGES).cast("int").alias("slices")))
    hosts = size.count()
    part = F.pmod(F.shiftright("digest", 7), F.lit(REFERENCES))
    chosen = rows.where("host <> 0 and html <> ''").groupBy("host", part.alias("part")).agg(F.min("digest").alias("digest")).select("host", "digest")
    chosen = rows.select("host", "digest", "html").join(_few(checkpointed(chosen), REFERENCES * hosts), ["host", "digest"], "left_semi")
    chosen = chosen.dropDuplicates(["host", "digest"]).repartition("host").sortWithinPartitions("host", "digest")
    templates = checkpointed(chosen.mapInArrow(_templates, "host long, template string"))
    placed = rows.join(_few(size, hosts), "host").withColumn("slice", F.pmod("digest", "slices").cast("int")).select("host", "slice", "digest", "page_id", "url", "html")
    sent = templates.join(size, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "template")

    groups = lambda x: x.groupBy("host", "slice")
    counts = groups(placed).cogroup(groups(sent)).applyInArrow(_counts, "host long, node long, inside boolean, key long, n long")
    # told apart by an aggregate, so that no filter goes below it and both sides of the join read one exchange
    counts = counts.groupBy("host", "node", "inside", "key").agg(F.sum("n").alias("n"), F.max(F.col("key").isNull()).alias("total"))
    of = counts.where("total").select("host", "node", "inside", F.col("n").alias("pages"))
    least = lambda a, b: F.when(F.col("inside"), F.lit(a)).otherwise(F.lit(b))
    many = (F.col("n") >= least(ARTICLE_PAGES, MIN_PAGES)) & (F.col("n") >= least(ARTICLE_SHARE, MIN_SHARE) * F.col("pages"))
    constant = counts.where("not total").join(of, ["host", "node", "inside"]).where(many)
    constant = constant.groupBy("host").agg(F.collect_list("key").alias("constant"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return groups(placed).cogroup(groups(sent.join(constant, "host", "left"))).applyInArrow(_texts, f"page_id {kind}, url string, text string, n_chars long")
