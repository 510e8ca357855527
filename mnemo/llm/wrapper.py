"""Main text of HTML pages by wrapper induction.

The block elements of a page make a tree. Trees of same-host pages are aligned by simple tree matching
and merged into one wrapper a host, whose nodes are slots; each block of each page is then given its
slot. A slot's text that stays the same over most of a host's pages is template; what varies is
content. Constancy is counted exactly, text by text, by an aggregation over all blocks, so no bound on
a wrapper's size decides what goes. What repetition can't tell (adverts, comments, varying menus) is
told by the meaning of HTML elements, by names, and by how much of a slot's text is links; what
an element's tag or name says gives way where it holds most of the host's varying text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemo.llm.common import join_small, sliced, written

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)(?:>|\Z)", re.DOTALL)
MARK = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
HIDES = re.compile(r"hidden|display", re.IGNORECASE)
NO_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*none", re.IGNORECASE)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NUMBER = re.compile(r"[0-9]{3,}")
CONTROL = re.compile(r"[\x00-\x20]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
LISTS = frozenset("ul ol dl dir menu li dt dd table tbody thead tfoot tr td th".split())
CLOSES = {t: ("p",) for t in BLOCK - {"html", "body"}}
CLOSES |= {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p")}
FENCE = frozenset("table ul ol dl div section article main body td th blockquote form nav aside header footer".split())
# Elements without text of their own to read, and form controls.
SILENT = frozenset("head script style noscript template iframe object svg canvas title audio video xmp noembed noframes button select option optgroup textarea datalist".split())
# Elements whose meaning is not main text.
BESIDE = frozenset("nav footer aside form dialog menu".split())
# Name parts of what repetition can't tell: adverts, notices, comments, menus, side matter.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe signup sidebar "
    "rail widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager menu nav navbar navigation topbar masthead toolbar footer comment comments disqus replies respond reply "
    "contentinfo complementary search dialog menubar tracking".split()
)
GENERIC = frozenset("list box block area section container wrapper wrap item items bar inner outer top bottom left right thread group panel unit slot row col column the site page main primary secondary links posts form content text body post story entry article user users reader readers feed card cards message button buttons icon icons title heading inline sticky fixed global".split())
SPEAKS = frozenset("article content post entry story body text prose main".split())
PLAIN = frozenset(["html", "body", "main"])
LEVEL = 64  # children of a node that are aligned by their order; a longer level keeps one node a label
WIDE = 256  # children a wrapper node keeps, the most frequent ones; others are slots by their own path
TEMPLATE_PAGES = 4
LINKED, LINK_CHARS = 0.8, 80
SEP, CUT = "\x1e", "\x1f"


class Node:
    __slots__ = ("header", "hidden", "kids", "label", "named", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag = tag
        self.kids: list[Node | str] = []
        self.label, self.named, self.header, self.hidden = tag, False, False, False
        if attrs and "=" in attrs:
            names, says = [], False
            for m in MARK.finditer(attrs):
                for name in (m[2] or m[3] or m[4] or "").split():
                    parts = {p.lower() for p in PART.findall(name)}
                    self.named |= bool(parts & NAMED) and parts <= NAMED | GENERIC
                    self.header |= "header" in parts and parts <= NAMED | GENERIC | {"header"}
                    says |= bool(parts & SPEAKS) and not parts & NAMED
                    if m[1].lower() == "class":
                        names.append(NUMBER.sub("#", CONTROL.sub("", name)))
            self.named &= not says and tag not in PLAIN
            if names:
                self.label = tag + "." + ".".join(sorted(set(names))[:4])
        if attrs and tag not in PLAIN and HIDES.search(attrs):
            self.hidden = hides(attrs)


def hides(attrs: str) -> bool:
    """Whether an element's attributes hide it: the attribute hidden, or a style of display: none."""
    return any(m[1].lower() == "hidden" or (m[1].lower() == "style" and NO_DISPLAY.search(m[2] or m[3] or m[4] or "")) for m in ATTRIBUTE.finditer(attrs))


def parse(page: str) -> Node:
    """A lenient DOM in linear time: implied end tags are closed, stray ones ignored, raw text kept whole."""
    root = Node("#root")
    stack, at = [root], 0
    places: dict[str, list[int]] = {}
    fences: list[int] = []

    def cut(k: int) -> None:
        while len(stack) > k:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in FENCE:
                fences.pop()

    while True:
        m = TAG.search(page, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if m.group().startswith("<![CDATA["):
            stack[-1].kids.append(html.escape(m.group()[9:].removesuffix("]]>"), quote=False))
            continue
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, attrs = tag.lower(), m[3] if m[2] else m[6]
        if m[1] or m[4]:
            if places.get(tag):
                cut(places[tag][-1])
            continue
        closes = CLOSES.get(tag, ())
        while True:
            k = max((places[t][-1] for t in closes if places.get(t)), default=-1)
            if k < 0 or (fences and fences[-1] > k):
                break
            cut(k)
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
            stop = end.start() if end else len(page)
            node.kids.append(page[at:stop])
            at = stop
            if end:
                close = page.find(">", stop)
                at = len(page) if close < 0 else close + 1
        elif tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            if tag in FENCE:
                fences.append(len(stack))
            stack.append(node)
    if at < len(page):
        stack[-1].kids.append(page[at:])
    return root


class Shape:
    """A node of a page's or a wrapper's tree of block elements: label, children, pages that have it."""

    __slots__ = ("into", "kids", "label", "pages")

    def __init__(self, label: str, pages: int = 1):
        self.label, self.pages = label, pages
        self.kids: list[Shape] = []
        self.into: Shape | None = None

    def at(self) -> Shape:
        node = self
        while node.into is not None:
            node = node.into
        while self.into is not None and self.into is not node:
            self.into, self = node, self.into
        return node


def matching(a: Shape, b: Shape, depth: int = 6) -> int:
    """Simple tree matching: nodes of a largest order-preserving match of two trees, ``depth`` levels of it."""
    if a.label != b.label:
        return 0
    if depth == 0 or not a.kids or not b.kids:
        return 1
    return 1 + align(a.kids, b.kids, depth - 1)[0]


def align(x: list[Shape], y: list[Shape], depth: int = 6) -> tuple[int, list[tuple[int, int]]]:
    """(matched nodes, matched positions) of a best order-preserving alignment of two child lists."""
    lo, hi, n, m = 0, 0, len(x), len(y)
    while lo < n and lo < m and x[lo].label == y[lo].label:
        lo += 1
    while hi < n - lo and hi < m - lo and x[n - 1 - hi].label == y[m - 1 - hi].label:
        hi += 1
    ends = [*((i, i) for i in range(lo)), *((n - k, m - k) for k in range(hi, 0, -1))]
    total = len(ends)
    p, q = x[lo : n - hi], y[lo : m - hi]
    if not p or not q or not {s.label for s in p} & {s.label for s in q}:
        return total, ends
    if len(p) > 4 * LEVEL or len(q) > 4 * LEVEL:  # by label, each once
        first = {s.label: j for j, s in reversed(list(enumerate(q)))}
        seen: set[str] = set()
        pairs = []
        for i, s in enumerate(p):
            if s.label in first and s.label not in seen:
                seen.add(s.label)
                pairs.append((lo + i, lo + first[s.label]))
        return total + len(pairs), sorted([*ends, *pairs])
    weights = [[matching(s, t, depth) for t in q] for s in p]
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p) - 1, -1, -1):
        row, below, w = best[i], best[i + 1], weights[i]
        for j in range(len(q) - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + w[j] if w[j] else 0)
    pairs, i, j = [], 0, 0
    while i < len(p) and j < len(q):
        if weights[i][j] and best[i][j] == best[i + 1][j + 1] + weights[i][j]:
            pairs.append((lo + i, lo + j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return total + best[0][0], [*ends[:lo], *pairs, *ends[lo:]]


def merge(a: Shape, b: Shape, add: bool = True) -> None:
    """Merge ``b`` into ``a``: matched nodes become one, unmatched ones stay as optional nodes."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        y.into = x
        if add:
            x.pages += y.pages
        if not y.kids:
            continue
        if not x.kids:
            x.kids = y.kids
            continue
        pairs = align(x.kids, y.kids)[1]
        for i, j in pairs:
            todo.append((x.kids[i], y.kids[j]))
        if len(pairs) < len(y.kids):
            if pairs == sorted(pairs, key=lambda p: p[1]):
                kids, i, j = [], 0, 0
                for p, q in [*pairs, (len(x.kids), len(y.kids))]:
                    kids += x.kids[i:p] + y.kids[j:q]
                    if p < len(x.kids):
                        kids.append(x.kids[p])
                    i, j = p + 1, q + 1
                x.kids = kids
            else:
                met = {q for _, q in pairs}
                x.kids = x.kids + [k for j, k in enumerate(y.kids) if j not in met]
        fold(x, add)


def fold(node: Shape, add: bool = True) -> None:
    """Keep one node a label on a level too long to align by order."""
    while len(node.kids) > LEVEL:
        by: dict[str, Shape] = {}
        left = []
        for k in node.kids:
            if k.label in by:
                left.append((by[k.label], k))
            else:
                by[k.label] = k
        node.kids = list(by.values())
        for a, b in left:
            merge(a, b, add)
        if not left:
            return


def prune(root: Shape) -> None:
    """Of a very wide level keep the children that most pages have, in their order; counts of the rest go."""
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.kids) > WIDE:
            kept = set(map(id, sorted(node.kids, key=lambda k: (-k.pages, k.label))[:WIDE]))
            node.kids = [k for k in node.kids if id(k) in kept]
        todo += node.kids


def preorder(root: Shape) -> Iterator[tuple[int, Shape]]:
    todo = [(0, root)]
    while todo:
        depth, node = todo.pop()
        yield depth, node
        todo += [(depth + 1, k) for k in reversed(node.kids)]


def dump(root: Shape, pages: bool = False) -> str:
    return SEP.join([f"{d}{CUT}{s.label}{CUT}{s.pages}" if pages else f"{d}{CUT}{s.label}" for d, s in preorder(root)])


def load(text: str, pages: int = 1) -> Shape:
    path: list[Shape] = []
    for line in text.split(SEP):
        depth, label, *count = line.split(CUT)
        node = Shape(label, int(count[0]) if count else pages)
        del path[int(depth) :]
        if path:
            path[-1].kids.append(node)
        path.append(node)
    return path[0]


# A block is [shape, text, characters of it in links, inside an article, shapes of what it lies beside the text in, enclosing container].
Block = list


def outline(root: Node) -> tuple[Shape, list[Block]]:
    """The page's tree of block elements, runs of one label as one node, and its blocks of text in page order."""
    top = Shape(root.tag)
    blocks: list[Block] = []
    line: list[str] = []
    linked: list[str] = []
    # (shape, inside an article, shapes beside the text, container), the last one current
    here: list[tuple[Shape, bool, tuple[Shape, ...], Shape]] = [(top, False, (), top)]
    links = 0

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            shape, art, beside, container = here[-1]
            blocks.append([shape, text, min(len(text), len(" ".join("".join(linked).split()))), art, beside, container])
        line.clear()
        linked.clear()

    leave_block, leave_link = object(), object()
    todo: list = list(reversed(root.kids))
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            text = html.unescape(at) if "&" in at else at
            line.append(text)
            if links:
                linked.append(text)
        elif at is leave_block:
            flush()
            done = here.pop()[0]
            fold(done, False)
            parent = here[-1][0]
            if parent.kids and parent.kids[-1].label == done.label:
                merge(parent.kids[-1], done, False)
            else:
                parent.kids.append(done)
        elif at is leave_link:
            links -= 1
        elif at.tag == "br":
            line.append(" ")
        elif at.tag in SILENT or at.hidden:
            continue
        elif at.tag in BLOCK or (at.named and any(not isinstance(k, str) and k.tag in BLOCK for k in at.kids)):
            flush()
            shape = Shape(at.label)
            _, art, beside, container = here[-1]
            if at.named or at.tag in BESIDE or (not art and (at.tag == "header" or at.header)):
                beside = (*beside, shape)
            art = art or (at.tag in ("article", "main") and not at.named)
            if at.tag not in LISTS and any(not isinstance(k, str) and k.tag in BLOCK for k in at.kids):
                container = shape
            here.append((shape, art, beside, container))
            todo.append(leave_block)
            todo.extend(reversed(at.kids))
        elif not at.named:
            if at.tag == "a":
                links += 1
                todo.append(leave_link)
            todo.extend(reversed(at.kids))
    flush()
    fold(top, False)
    return top, blocks


def place(page: Shape, wrapper: Shape | None) -> dict[int, int]:
    """The slot of every node of a page's tree: its node of the wrapper, or its own path where there is none."""
    out: dict[int, int] = {}
    todo: list[tuple[Shape, Shape | None, int]] = [(page, wrapper, 0)]
    while todo:
        node, over, slot = todo.pop()
        out[id(node)] = slot
        if not node.kids:
            continue
        met = dict(align(node.kids, over.kids)[1]) if over is not None and over.kids else {}
        base = slot.to_bytes(8, "little", signed=True)
        for i, kid in enumerate(node.kids):
            j = met.get(i)
            token = f"?{kid.label}" if j is None else f"{j}"
            key = xxhash.xxh64_intdigest(base + token.encode("utf-8", "surrogatepass"))
            todo.append((kid, None if j is None else over.kids[j], key - (1 << 64) if key >> 63 else key))
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", url or "")
    return m[1].lower() if m else ""


def induced(shapes: list[tuple[str, int]]) -> str:
    """One wrapper from trees (dumped, pages), the most frequent first."""
    total = None
    for text, pages in sorted(shapes, key=lambda s: (-s[1], s[0])):
        one = load(text, pages)
        if total is None:
            total = one
        else:
            merge(total, one)
    prune(total)
    return dump(total, pages=True)


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): distinct trees of each host with their counts, merged 64 or so at a time.

    What is merged with what is settled by hashes of the trees, not by where rows lie, so reruns agree.
    """

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            held: dict[tuple[int, str], int] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if page.is_valid and page.as_py().strip():
                    key = host, dump(outline(parse(page.as_py()))[0])
                    held[key] = held.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in held], pa.int64()), pa.array([s for _, s in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["host", "wrapper", "n"])

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "bucket": [int(pdf["bucket"].iloc[0])], "wrapper": [induced(list(zip(pdf["wrapper"], pdf["n"].tolist(), strict=True)))]})

    found = pages.select("host", "html").mapInArrow(shapes, "host long, wrapper string, n long").groupBy("host", "wrapper").agg(F.sum("n").alias("n"))
    found = written(found, "html-shapes")
    sizes = found.groupBy("host").agg(F.count(F.lit(1)).alias("k"))
    most = sizes.agg(F.max("k")).first()[0] or 1
    buckets = F.ceil(F.col("k") / 64).cast("long")
    level = found.join(sizes, "host").select("host", F.pmod(F.xxhash64("wrapper"), buckets).alias("bucket"), "wrapper", "n")
    left = -(-most // 64)
    while True:
        level = level.groupBy("host", "bucket").applyInPandas(union, "host long, bucket long, wrapper string")
        if left == 1:
            return written(level.select("host", "wrapper"), "html-wrappers")
        level = written(level.select("host", F.floor(F.col("bucket") / 64).alias("bucket"), "wrapper", F.lit(1).cast("long").alias("n")), "html-wrappers")
        left = -(-left // 64)


BLOCKS = "array<struct<slot:long,hash:long,text:string,links:int,art:boolean,beside:array<long>,container:long>>"


def page_blocks(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(page_id, url, host, sign, blocks): blocks with their slots; ``sign`` tells pages' main texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[int, Shape] = {}
        placed: dict[tuple[int, str], list[int]] = {}
        kind = pa.struct([("slot", pa.int64()), ("hash", pa.int64()), ("text", pa.string()), ("links", pa.int32()), ("art", pa.bool_()), ("beside", pa.list_(pa.int64())), ("container", pa.int64())])
        for batch in sliced(batches):
            signs, found = [], []
            for host, page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                top, blocks = outline(parse(page.as_py() or "")) if page.is_valid else (Shape("#root"), [])
                nodes = [s for _, s in preorder(top)]
                key = host, dump(top)
                if key not in placed:
                    if len(placed) > 4096:
                        placed.clear()
                    if host not in loaded:
                        if len(loaded) > 256:
                            loaded.clear()
                        loaded[host] = load(wrapper.as_py()) if wrapper.is_valid else None
                    slots = place(top, loaded[host])
                    placed[key] = [slots[id(s)] for s in nodes]
                slot = dict(zip(map(id, nodes), placed[key], strict=True))
                rows, longest = [], (-1, 0)
                for shape, text, links, art, beside, container in blocks:
                    digest = _long(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))
                    longest = max(longest, (len(text) if not beside else 0, digest))
                    rows.append({"slot": slot[id(shape.at())], "hash": digest, "text": text, "links": links, "art": art, "beside": [slot[id(s.at())] for s in beside], "container": slot[id(container.at())]})
                found.append(rows)
                signs.append(longest[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(signs, pa.int64()), pa.array(found, pa.list_(kind))], names=["page_id", "url", "host", "sign", "blocks"])

    return join_small(pages, wrappers, "host", spread="html").select("page_id", "url", "host", "html", "wrapper").mapInArrow(run, f"page_id long, url string, host long, sign long, blocks {BLOCKS}")


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def verdicts(found: DataFrame) -> DataFrame:
    """(host, template, kept, menus) a host, which is a number: texts of slots that are template, elements kept against their
    tag or name, slots that are menus. Keys are hashes of (slot, text), slots, and slots.

    Pages count once a main text (their longest block), so that copies of an article don't make it
    template. In an article, a text is template if most of the host's main texts have it in that slot;
    elsewhere, if most of those that have the slot do; four at least.
    """
    rows = found.select("host", "sign", F.explode("blocks").alias("b")).select("host", "sign", "b.slot", "b.hash", "b.art", "b.beside", "b.container", F.char_length("b.text").alias("size"), F.col("b.links").alias("links"))
    # where a text stands is one number while texts are counted; what it means is a small table
    rows = rows.withColumn("spot", F.xxhash64("slot", "art", "beside", "container"))
    spots = written(rows.groupBy("host", "spot").agg(*[F.first(c).alias(c) for c in ("slot", "art", "beside", "container")]), "html-spots")
    counted = written(rows.groupBy("host", "spot", "hash", "sign").agg(F.sum("size").alias("size"), F.sum("links").alias("links"), F.count(F.lit(1)).alias("k")), "html-texts")
    base = join_small(counted, spots, ["host", "spot"], "inner", spread="sign").drop("spot")
    signs = base.select("host", "sign").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("signs"))
    having = base.select("host", "slot", "sign").distinct().groupBy("host", "slot").agg(F.count(F.lit(1)).alias("having"))
    texts = base.groupBy("host", "slot", "hash", "sign").agg(F.max("art").alias("art")).groupBy("host", "slot", "hash").agg(F.count(F.lit(1)).alias("n"), F.max("art").alias("art")).where(F.col("n") >= TEMPLATE_PAGES)
    texts = texts.join(signs, "host").join(having, ["host", "slot"])
    fixed = written(texts.where(F.when(F.col("art"), 2 * F.col("n") > F.col("signs")).otherwise(2 * F.col("n") > F.col("having"))).select("host", "slot", "hash"), "html-fixed")
    plain = F.col("size") - F.col("links")
    varying = base.join(fixed, ["host", "slot", "hash"], "left_anti")
    owners = varying.select("host", plain.alias("plain"), F.explode(F.array_distinct("beside")).alias("owner")).groupBy("host", "owner").agg(F.sum("plain").alias("held"))
    whole = varying.groupBy("host").agg(F.sum(plain).alias("whole"), F.sum(F.when(F.col("art") & (F.size("beside") == 0), plain).otherwise(0)).alias("told"))
    kept = owners.join(whole, "host").where((2 * F.col("held") > F.col("whole")) & (F.col("told") == 0)).groupBy("host").agg(F.collect_set("owner").alias("kept"))
    free = varying.where(~F.col("art") & (F.size("beside") == 0))
    centre = free.groupBy("host", "container").agg(F.sum(plain).alias("held")).groupBy("host").agg(F.max_by("container", F.struct("held", "container")).alias("centre"))
    slots = free.groupBy("host", "slot", "container").agg(F.sum("size").alias("size"), F.sum("links").alias("links"), F.sum("k").alias("k"))
    linked = slots.where((F.col("links") >= LINKED * F.col("size")) & (F.col("size") <= LINK_CHARS * F.col("k")))
    menus = linked.join(centre, "host").where("container <> centre").groupBy("host").agg(F.collect_set("slot").alias("menus"))
    template = fixed.groupBy("host").agg(F.collect_set(F.xxhash64("slot", "hash")).alias("template"))
    return written(template.join(kept, "host", "full").join(menus, "host", "full"), "html-verdicts")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null, empty and wordless html gives an empty text. Urls without a host are one host. A page all of
    whose text is template keeps it. Repeated rows are answered each; an empty table gives an empty
    result; other columns are ignored. Levels of over LEVEL children are aligned by label instead of by
    place, which makes their slots coarser; their texts are counted exactly all the same.
    """
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.xxhash64(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    found = written(page_blocks(rows, host_wrappers(rows)), "html-blocks")
    told = join_small(found, verdicts(found), "host", spread="sign")
    none = F.array().cast("array<long>")
    template, kept, menus = (F.coalesce(c, none) for c in ("template", "kept", "menus"))

    def beside(b: Column) -> Column:
        return (F.size(b["beside"]) > 0) & (F.size(F.array_except(b["beside"], F.col("_kept"))) > 0)

    text = lambda blocks: F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")
    told = told.select("page_id", "url", "blocks", template.alias("_template"), kept.alias("_kept"), menus.alias("_menus"))
    told = told.select("page_id", "url", "_template", "_menus", F.filter("blocks", lambda b: ~beside(b)).alias("_blocks"))
    content = F.filter("_blocks", lambda b: ~F.array_contains("_template", F.xxhash64(b["slot"], b["hash"])) & (b["art"] | ~F.array_contains("_menus", b["slot"])))
    told = told.select("page_id", "url", "_blocks", content.alias("_content"))
    told = told.select("page_id", "url", text(F.when(F.size("_content") > 0, F.col("_content")).otherwise(F.col("_blocks"))).alias("text"))
    return told.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
