"""HTML main text by wrapper induction.

Each host has a reference page. Every page's tree of block elements is aligned with its host's reference by simple tree matching: roots of equal
label match, and an order-preserving assignment of their children of greatest total weight is found by dynamic programming. Over all
pages of a host, a node of the reference whose text is the same wherever it is matched is template; one whose text varies is a slot.
Equal pages count once. Content is what stands in slots or is matched to nothing. Slots of a page's furniture (menus, adverts,
forms and so on) vary too; they are known by element, role and class names. A page with an ``article`` or ``main`` element has
its content there.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.common import checkpointed, slices

#: A node is template from so many different pages on, if its text is the same in this share of them; inside an article from ``SURE_PAGES`` on.
LEAST_PAGES, SURE_PAGES, SAME_SHARE = 2, 5, 0.9
#: Inside an article only short texts can be template.
SHORT_WORDS = 12
#: Two lists of children with more pairs than this are halved (Hirschberg), for memory; the assignment is the greatest at every size.
CELLS = 100_000
#: So many assignments are kept while two pages are aligned; others are computed again.
KEPT = 200_000
#: References of up to so many bytes in all are broadcast; beyond that they are joined by host.
BROADCAST_BYTES = 32 << 20
MEMO = 512
#: Elements nested deeper than this stand beside, not in, the one before, as in browsers.
DEPTH = 512

# Elements that start a block of their own.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe li main menu nav noscript ol option p pre search section select summary svg table tbody td textarea template tfoot th thead title tr ul".split())
# Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that are never content.
FURNITURE = frozenset("aside button dialog footer form head iframe menu nav noscript option search select svg template textarea title".split())
#: Words that name no kind of content; a class or id name is furniture's if each of its words is one of these or of NAMES, and one at least of NAMES.
PLAIN = frozenset("area bar block bottom box cell col column container content div entry fixed foot global group head holder inner items left link links list main module outer page panel post posts right row section site sticky top ul wrap wrapper".split())
# Words of class and id names, and roles, of what is never content.
NAMES = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: These name furniture only outside an article.
OUTSIDE = frozenset(["header", "masthead", "banner"])
#: An open element of the key ends where one of the values starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
#: How far back such an element is looked for.
SCOPE = frozenset(["ul", "ol", "dl", "table", "menu", "select", "body", "article", "section", "div"])

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]{0,99})")
_REST = re.compile(r"""(?>[^>"']+|"[^"]*"|'[^']*')*+>""")
_UNQUOTED = re.compile(r"""[^>"']*""")
_RAW_END = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I)}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    """A block element: label, children in order (texts as lists of pieces), and whether it is furniture, an article, or within one."""

    __slots__ = ("tag", "label", "items", "kids", "furniture", "inside", "text", "index")

    def __init__(self, tag: str, label: str, furniture: bool, inside: bool):
        self.tag, self.label, self.furniture, self.inside = tag, label, furniture, inside
        self.items: list = []
        self.kids: list[Node] = []
        self.text = ""
        self.index = -1


@lru_cache(10_000)
def furniture_word(name: str) -> str | None:
    """The word of NAMES or OUTSIDE that a class or id name is made of, if it names nothing else."""
    words = [x.lower() for x in _PIECES.findall(name)]
    known = [x for x in words if x in NAMES or x in OUTSIDE]
    return known[0] if known and all(x in NAMES or x in OUTSIDE or x in PLAIN or x.isdigit() for x in words) else None


def tags(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, tag, rest) of all markup; the tag is empty where the markup is no element. Linear in the page, whatever is left open.

    The rest of a tag ends at the first ``>`` outside quotes. Where there is none, its ``<`` is text.
    """
    last, no_cdata = source.rfind(">"), "]]>" not in source
    # Quotes from which no end of a tag is reached; two ways through the same page meet at them.
    open_quotes: set[int] = set()

    def end_of(i: int) -> int:
        if i > last:
            return -1
        if not open_quotes:
            m = _REST.match(source, i)
            if m:
                return m.end()
        seen = []
        while True:
            i = _UNQUOTED.match(source, i).end()
            if i < len(source) and source[i] == ">":
                return i + 1
            if i >= last or i in open_quotes:
                break
            seen.append(i)
            i = source.find(source[i], i + 1) + 1
            if not i:
                break
        open_quotes.update(seen)
        return -1

    at = source.find("<")
    while at >= 0:
        stop, found = -1, ("", "", "")
        if source.startswith("<!--", at):
            stop = source.find("-->", at + 4) + 3
            stop = stop if stop > 2 else len(source)
        elif source.startswith(("<!", "<?"), at):
            if source.startswith("<![CDATA[", at) and not no_cdata and (found_at := source.find("]]>", at)) >= 0:
                stop = found_at + 3
            elif at < last:
                stop = source.index(">", at) + 1
        elif m := _TAG.match(source, at):
            tag = m[2].lower()
            if not m[1] and tag in _RAW_END:
                raw = _RAW_END[tag].search(source, m.end())
                stop = raw.end() if raw else len(source)
            elif (stop := end_of(m.end())) >= 0:
                found = (m[1], tag, source[m.end() : stop - 1])
        if stop >= 0:
            yield at, stop, *found
        at = source.find("<", stop if stop >= 0 else at + 1)


def _open(tag: str, raw: str, parent: Node) -> Node:
    names, label, hidden, role = set(), tag, False, ""
    if raw and not raw.isspace():
        for m in _ATTRIBUTE.finditer(raw):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                names.update(filter(None, map(furniture_word, value.split())))
                if name == "class":
                    label = f"{tag}.{value}"
            elif name == "role":
                role = value.lower()
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
    inside = parent.inside or tag in ("article", "main")
    known = (names | {role} | {tag}) & (NAMES | OUTSIDE if not inside else NAMES - OUTSIDE)
    furniture = tag not in ("article", "main", "body", "html") and (hidden or tag in FURNITURE or bool(known) or role in ROLES and not (inside and role in OUTSIDE))
    return Node(tag, label, parent.furniture or furniture, inside)


def parse(source: str) -> Node:
    """The tree of block elements. Inline elements leave their text in place; a line break counts as white space."""
    root = Node("#", "#", False, False)
    stack, at = [root], 0
    opened: Counter[str] = Counter()

    def close(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    for start, stop, slash, tag, rest in tags(source):
        if start > at:
            stack[-1].items.append(source[at:start])
        at = stop
        if not tag:
            continue
        if slash:
            if opened[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        break
                    if tag == "p" and stack[i].tag in SCOPE:
                        break
        elif tag == "br":
            stack[-1].items.append(" ")
        elif tag in BLOCKS:
            if stack[-1].tag == "p" or stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6") and tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                close(len(stack) - 1)
            for i in range(len(stack) - 1, 0, -1):
                if tag in ENDS.get(stack[i].tag, ()):
                    close(i)
                    break
                if stack[i].tag in SCOPE:
                    break
            if len(stack) > DEPTH:
                close(len(stack) - 1)
            node = _open(tag, rest, stack[-1])
            stack[-1].items.append(node)
            stack[-1].kids.append(node)
            if tag not in VOID:
                stack.append(node)
                opened[tag] += 1
    if at < len(source):
        # Markup that the page's end cuts off is no text.
        cut = re.compile("<[/a-zA-Z!?]").search(source, max(at, source.rfind("<")))
        stack[-1].items.append(source[at : cut.start()] if cut else source[at:])
    number = 0
    todo = [root]
    while todo:
        node = todo.pop()
        node.index = number
        number += 1
        node.text = " ".join(blocks_of(node))
        todo.extend(reversed(node.kids))
    return root


def blocks_of(node: Node) -> list[str]:
    """The node's own blocks: its texts between child blocks, with references decoded and white space made single."""
    out, pieces = [], []
    for item in [*node.items, None]:
        if isinstance(item, str):
            pieces.append(item)
        elif pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append(text)
            pieces = []
    return out


def align(a: Node, b: Node) -> dict[int, Node]:
    """Simple tree matching: for each matched node of ``a`` (by index) its node of ``b``. A match weighs 1, and a bit more if the own texts are equal."""
    memo: dict[tuple[int, int], tuple[float, list]] = {}

    def match(x: Node, y: Node) -> float:
        if x.label != y.label:
            return 0.0
        own = 1.25 if x.text == y.text else 1.0
        if not x.kids or not y.kids:
            return own
        return own + solved(x, y)[0]

    def solved(x: Node, y: Node) -> tuple[float, list]:
        key = (x.index, y.index)
        result = memo.get(key)
        if result is None:
            result = assign(x.kids, y.kids)
            if len(memo) < KEPT:
                memo[key] = result
        return result

    def last_row(xs: list[Node], ys: list[Node]) -> list[float]:
        row = [0.0] * (len(ys) + 1)
        for x in xs:
            above, row, left, diagonal = row, [0.0], 0.0, 0.0
            for y, up in zip(ys, above[1:]):
                w = match(x, y)
                best = up if up > left else left
                if w and diagonal + w > best:
                    best = diagonal + w
                row.append(best)
                left, diagonal = best, up
        return row

    def assign(xs: list[Node], ys: list[Node]) -> tuple[float, list]:
        if len(xs) * len(ys) > CELLS and len(xs) > 1:
            half = len(xs) // 2
            before, after = last_row(xs[:half], ys), last_row(xs[half:][::-1], ys[::-1])
            at = max(range(len(ys) + 1), key=lambda k: before[k] + after[-1 - k])
            (total, pairs), (more, others) = assign(xs[:half], ys[:at]), assign(xs[half:], ys[at:])
            return total + more, others + pairs
        width = len(ys) + 1
        rows = [[0.0] * width]
        for x in xs:
            above, row, left, diagonal = rows[-1], [0.0], 0.0, 0.0
            for y, up in zip(ys, above[1:]):
                w = match(x, y)
                best = up if up > left else left
                if w and diagonal + w > best:
                    best = diagonal + w
                row.append(best)
                left, diagonal = best, up
            rows.append(row)
        pairs, i, j = [], len(xs), len(ys)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((xs[i], ys[j]))
        return rows[-1][-1], pairs

    if sys.getrecursionlimit() < 8 * DEPTH:
        sys.setrecursionlimit(8 * DEPTH)
    found: dict[int, Node] = {}
    if a.label != b.label:
        return found
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        found[x.index] = y
        if x.kids and y.kids:
            todo.extend(solved(x, y)[1])
    return found


def nodes(root: Node) -> Iterator[Node]:
    """All nodes in page order."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(reversed(node.kids))


def content(root: Node, template: dict[int, Node], constant: frozenset[int], sure: frozenset[int] = frozenset()) -> list[str]:
    """The blocks of the page's content. ``template`` are its matches with the reference, ``constant`` the reference nodes that are template, ``sure`` those of many pages."""
    has_article = any(n.inside and not n.furniture and n.text for n in nodes(root))
    out: list[str] = []

    def keep(node: Node) -> bool:
        if node.furniture or has_article and not node.inside:
            return False
        twin = template.get(node.index)
        if twin is None or twin.index not in constant or twin.text != node.text:
            return True
        return node.inside and (twin.index not in sure or len(node.text.split()) > SHORT_WORDS)

    # Blocks in page order; a node's own blocks stand between its children's.
    stack: list[tuple[Node, int]] = [(root, 0)]
    pieces: list[str] = []

    def flush(node: Node) -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text and keep(node):
                out.append(text)
            pieces.clear()

    while stack:
        node, i = stack.pop()
        while i < len(node.items) and isinstance(node.items[i], str):
            pieces.append(node.items[i])
            i += 1
        flush(node)
        if i < len(node.items):
            stack.append((node, i + 1))
            stack.append((node.items[i], 0))
    return out


class References:
    """Parsed reference pages, as many as ``MEMO`` at once."""

    def __init__(self) -> None:
        self.trees: dict[str, Node] = {}

    def __call__(self, source: str) -> Node:
        tree = self.trees.get(source)
        if tree is None:
            if len(self.trees) >= MEMO:
                self.trees.clear()
            tree = self.trees[source] = parse(source)
        return tree


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reference = References()
    for batch in batches:
        for part in slices(batch, "page"):
            rows = []
            for host, digest, page, source in zip(*(part.column(i).to_pylist() for i in range(4))):
                tree = parse(page)
                twins = align(tree, reference(source))
                rows += [(host, digest, twin.index, node.text == twin.text) for node in nodes(tree) if node.text and (twin := twins.get(node.index)) is not None and twin.text]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int32(), pa.bool_()))], ["host", "digest", "node", "same"])


def host_of(url) -> F.Column:
    """The host of a URL, lower-cased; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def induce(pages: DataFrame) -> DataFrame:
    """(host, source, constant) for each host of ``pages`` (host, key, digest, page): its reference page and the nodes that are template.

    The reference is the page of the least key. Votes are counted over all pages of a host, before their shuffle first.
    """
    usable = pages.where("host IS NOT NULL AND btrim(page, ' \t\r\n') != ''")
    least = usable.groupBy("host").agg(F.min(F.struct("key", "digest")).alias("least"), F.count("*").alias("n"))
    least = checkpointed(least.where("n > 1").select("host", F.col("least.key").alias("least_key"), F.col("least.digest").alias("digest")))
    chosen = usable.join(_bounded(least), ["host", "digest"]).where(F.col("key").eqNullSafe(F.col("least_key")))
    references = checkpointed(chosen.groupBy("host").agg(F.min("page").alias("source")))
    votes = usable.join(_bounded(references), "host").select("host", "digest", "page", "source").mapInArrow(_vote_rows, "host string, digest long, node int, same boolean")
    counts = votes.groupBy("host", "node", "digest").agg(F.max("same").alias("same")).groupBy("host", "node").agg(F.count("*").alias("n"), F.count_if("same").alias("equal"))
    constant = counts.where((F.col("n") >= LEAST_PAGES) & (F.col("equal") >= SAME_SHARE * F.col("n"))).groupBy("host").agg(F.collect_list("node").alias("constant"), F.collect_list(F.when(F.col("n") >= SURE_PAGES, F.col("node"))).alias("sure"))
    return checkpointed(references.join(constant, "host", "left"))


def _bounded(small: DataFrame) -> DataFrame:
    """``small``, to be broadcast if its measured size allows it; else it is joined by a shuffle."""
    sizes = {"string": F.octet_length, "array<int>": lambda c: 4 * F.greatest(F.size(c), F.lit(0))}
    size = small.agg(F.sum(sum((F.coalesce(sizes[kind](c), F.lit(0)) for c, kind in small.dtypes if kind in sizes), F.lit(64)))).first()[0] or 0
    return F.broadcast(small) if size <= BROADCAST_BYTES else small


def extract(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` for each row of ``df``.

    Null and empty pages give an empty text. Pages without a host, or alone on it, have no wrapper: only furniture goes. Repeated rows stay.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{page}`").cast("string").alias("page")).withColumn("host", host_of(F.col("url"))).withColumn("digest", F.xxhash64("page"))
    wrappers = induce(rows)
    joined = rows.join(_bounded(wrappers), "host", "left").select("key", "url", "page", "source", "constant", "sure")
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *T._parse_datatype_string("url string, text string, n_chars long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference = References()
        for batch in batches:
            for part in slices(batch, "page"):
                texts = []
                for source_page, source, constant, sure in zip(*(part.column(i).to_pylist() for i in (2, 3, 4, 5))):
                    tree = parse(source_page or "")
                    twins = align(tree, reference(source)) if source is not None and constant else {}
                    texts.append("\n\n".join(content(tree, twins, frozenset(constant or ()), frozenset(sure or ()))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema.names)

    return joined.mapInArrow(run, schema).withColumnRenamed("key", key)
