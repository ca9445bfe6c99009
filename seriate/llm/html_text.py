"""Operator 4: main text of web pages by wrapper induction.

Pages of one host share a template. Each page's DOM tree, with runs of like siblings folded into one, is aligned with reference pages
of its host by simple tree matching. Nodes whose text stays the same in nearly all alignments are template, the others are slots; a line
of a slot that nearly all alignments have there is template, too. A host with several page layouts has a wrapper for each: pages are
aligned with references of their layout as well, which decide wherever they were met often enough. A page's text is what stands in its host's varying slots, within an
article or not, less what a page's structure marks as something else: menus, headers, footers, sidebars, notices, adverts, forms,
scripts, comments. An article is a hint only: its blocks are judged by their own lines, never by their path alone.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, texts_of

#: A node is template if its text was equal in this share of at least so many alignments.
TEMPLATE_SHARE, LEAST_PAIRS = 0.8, 5
#: Reference pages and wrappers are broadcast up to these many bytes; beyond it they are joined by host.
BROADCAST_BYTES = 16 << 20
#: The fewest pages of a layout that give LEAST_PAIRS alignments with two references.
LEAST_PAGES = LEAST_PAIRS // 2 + 2

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
#: Elements that say how a text is set, not how a page is laid out.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption".split())
SCOPES = frozenset("ul ol dl table body html article section div main nav aside footer header form".split())
#: Elements that are never main text, and words of class, id and role that say the same of any element.
BOILERPLATE_TAGS = frozenset("head nav footer aside form button select dialog menu".split()) | RAW
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget cookie cookies consent notice notices gdpr popup modal overlay comment comments respond reply replies disqus share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar masthead complementary contentinfo dialog alert skip".split()
)
#: Words beside which those say what an element stands next to ("content with-sidebar"), not what it is.
CONTENT_WORDS = frozenset("content main article post entry story body page wrapper container layout".split())

#: Elements nested deeper stand at the path of the one at this depth; browsers bound the depth of their trees alike.
MOST_DEPTH = 512
# Without a ">" a tag ends at the next "<"; nothing is read twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|(?=<))", re.S)
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "sign", "skip", "main", "children", "text")

    def __init__(self, tag: str, sign: str, skip: bool, main: bool):
        self.tag, self.sign, self.skip, self.main = tag, sign, skip, main
        self.children: list[Node] = []
        self.text: list[str] = []


def blocks(page: str) -> list[tuple[str, str, bool, bool]]:
    """(path, text, skipped, within an article) of every block of a page, in order.

    Unclosed and misnested tags are repaired as browsers mostly do: a paragraph ends where a block begins, a list item at the next.
    """
    out: list[tuple[str, str, bool, bool]] = []
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, skipped, within an article
    block = stack[0]
    words: list[str] = []

    def flush() -> None:
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                out.append((block[1], text, block[2], block[3]))
            words.clear()

    at = 0
    find = _TOKEN.search
    while True:
        m = find(page, at)
        if m is None:
            words.append(page[at:])
            break
        if m.start() > at:
            words.append(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in INLINE:
                continue
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if depth:
                flush()
                del stack[depth:]
                block = stack[-1]
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in INLINE:
            if tag in ("br", "img", "wbr"):
                words.append(" " if tag != "wbr" else "")
            elif m.group(3) and (_HIDDEN.search(m.group(3))):
                close = page.find(f"</{tag}", at)
                at = page.find(">", close) + 1 if close >= 0 else at
            continue
        flush()
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p"), 0)
            if depth and not any(s[0] in SCOPES for s in stack[depth + 1 :]):
                del stack[depth:]
        closed = CLOSED_BY.get(tag)
        if closed:
            while len(stack) > 1 and stack[-1][0] in closed:
                stack.pop()
        marks = m.group(3)
        names: list[str] = []
        hidden = False
        if marks:
            names = [w for found in _MARKS.findall(marks) for w in _SPLIT.split("".join(found).lower()) if w]
            hidden = bool(_HIDDEN.search(marks))
        above = stack[-1]
        main = above[3] or tag in ("article", "main") or "main" in names and tag == "div"
        skip = above[2] or hidden or tag in BOILERPLATE_TAGS or tag == "header" and not above[3] or tag not in ("html", "body", "main", "article") and any(w in BOILERPLATE_WORDS for w in names) and not any(w in CONTENT_WORDS for w in names)
        letters = ".".join(w for w in names if not w.isdigit())
        path = f"{above[1]}/{tag}{'.' + letters if letters else ''}" if len(stack) <= MOST_DEPTH else above[1]
        stack.append((tag, path, skip, main))
        block = stack[-1]
    flush()
    return out


def layout_of(found: list[tuple[str, str, bool, bool]]) -> int:
    """A hash of the set of containers that hold a page's blocks; plain text elements at a path's end do not count."""
    containers = set()
    for path in {path for path, _, _, _ in found}:
        signs = path.split("/")
        while len(signs) > 1 and signs[-1] in TEXT_TAGS:
            signs.pop()
        containers.add("/".join(signs))
    return mark("\n".join(sorted(containers)))


def folded(found: list[tuple[str, str, bool, bool]]) -> Node:
    """The tree of a page's blocks, in which siblings that follow each other with one sign are a single node."""
    root = Node("", "", False, False)
    for path, text, skip, main in found:
        node = root
        for sign in path.split("/")[1:]:
            if not node.children or node.children[-1].sign != sign:
                node.children.append(Node(sign.split(".")[0], sign, skip, main))
            node = node.children[-1]
        node.skip, node.main = skip, main
        node.text.append(text)
    return root


def _aligned(a: Node, b: Node, done: dict[tuple[int, int], tuple[int, list]]) -> tuple[int, list[tuple[Node, Node]]]:
    """The size of the largest match below two nodes, and which children are matched, given the matches of all their children."""
    n, m = len(a.children), len(b.children)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i, x in enumerate(a.children, 1):
        for j, y in enumerate(b.children, 1):
            score = max(best[i - 1][j], best[i][j - 1])
            if x.sign == y.sign:
                score = max(score, best[i - 1][j - 1] + done[id(x), id(y)][0])
            best[i][j] = score
    pairs, i, j = [], n, m
    while i and j:
        x, y = a.children[i - 1], b.children[j - 1]
        if x.sign == y.sign and best[i][j] == best[i - 1][j - 1] + done[id(x), id(y)][0]:
            pairs.append((x, y))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[n][m], pairs


def tree_match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: size of the largest order-preserving match of two trees with one sign, and the matched nodes.

    Pairs of nodes are matched children first, from a stack, so that trees may be of any depth.
    """
    done: dict[tuple[int, int], tuple[int, list]] = {}
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        if (id(x), id(y)) not in done:
            wanted = [(c, d) for c in x.children for d in y.children if c.sign == d.sign and (id(c), id(d)) not in done]
            if wanted:
                stack += wanted
                continue
            done[id(x), id(y)] = _aligned(x, y, done)
        stack.pop()
    matched, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        matched.append((x, y))
        stack += done[id(x), id(y)][1]
    return done[id(a), id(b)][0], matched


def paths(node: Node, above: str = "") -> dict[int, str]:
    """The path of every node of a tree, by identity."""
    out, stack = {}, [(node, above)]
    while stack:
        x, path = stack.pop()
        out[id(x)] = path
        stack += [(c, f"{path}/{c.sign}") for c in x.children]
    return out


#: What is counted of a path beside its lines: alignments, and those with equal text.
PAIRS, EQUAL = 0, 1


def mark(path: str, text: str = "") -> int:
    """A 63-bit hash of a path, or of a line at a path, other than PAIRS and EQUAL."""
    return (int.from_bytes(blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1) | 2


def votes(page: Node, reference: Node) -> list[tuple[int, int]]:
    """(path, item) of every path of matched nodes with text that is not skipped: PAIRS, EQUAL if all text is, and each line that both have.

    Pages that differ nowhere are copies and tell nothing; those with one article under different menus tell nothing of the article.
    """
    _, matched = tree_match(page, reference)
    matched = [(x, y) for x, y in matched if x.text or y.text]
    if all(x.text == y.text for x, y in matched):
        return []
    copied = all(x.text == y.text for x, y in matched if x.main or y.main)
    at = paths(page)
    found: dict[str, tuple[list[str], list[str]]] = {}
    for x, y in matched:
        if not (x.text and x.skip or copied and x.main):
            own, other = found.setdefault(at[id(x)], ([], []))
            own += x.text
            other += y.text
    out = []
    for path, (own, other) in found.items():
        where = mark(path)
        out.append((where, PAIRS))
        if own == other:
            out.append((where, EQUAL))
        out += [(where, mark(path, t)) for t in set(own).intersection(other)]
    return out


def main_text(found: list[tuple[str, str, bool, bool]], template: frozenset[int] | set[int], own: frozenset[int] | set[int] = frozenset(), met: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of a page's blocks under its host's template, or its layout's own at the paths met there: marks of paths and of lines."""
    kept = []
    for path, t, skip, main in found:
        if not skip:
            where = mark(path)
            marks = own if where in met else template
            if mark(path, t) not in marks and (main or where not in marks):
                kept.append(t)
    return "\n".join(kept)


def host_of(url) -> F.Column:
    """The host of a URL, lower-cased; what has none counts as the empty host."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _by(keys: list[str], rows: DataFrame, small: DataFrame, size: int, how: str = "left") -> DataFrame:
    """Join by host, or host and layout; the small side is broadcast only if its measured size allows."""
    return rows.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, keys, how)


def with_layout(pages: DataFrame) -> DataFrame:
    """Add ``layout`` to pages with a column html."""
    at = pages.columns.index("html")

    def run(batches):
        for batch in batches:
            found = [layout_of(blocks(html or "")) for html in batch.column(at).to_pylist()]
            yield batch.append_column("layout", pa.array(found, pa.int64()))

    schema = ", ".join(f"`{c}` {t}" for c, t in pages.dtypes)
    return pages.mapInArrow(run, f"{schema}, layout long")


def _counted(pages: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """(host, layout, reference, path, item, n): votes of the pages that have references (one, two) by these keys."""
    references = staged(references, "references")
    size = references.agg(F.sum(F.length("one") + F.length("two")).alias("n")).first()["n"] or 0
    names = ["host", "layout", "reference", "path", "item", "n"]

    def run(batches):
        trees: dict[str, Node] = {}
        for batch in batches:
            counted: Counter = Counter()
            for k in range(batch.num_rows):
                host, layout, html, one, two = (batch.column(c)[k].as_py() for c in range(5))
                page = None
                for n, other in enumerate((one, two) if one != two else (one,)):
                    if other == html:
                        continue
                    if other not in trees:
                        if len(trees) > 500:
                            trees.clear()
                        trees[other] = folded(blocks(other))
                    page = page or folded(blocks(html))
                    counted.update([(host, layout, n, path, item) for path, item in votes(page, trees[other])])
            if counted:
                columns = [*zip(*counted), list(counted.values())]
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    # Votes of a host's references stand at layout 0.
    layout = F.col("layout") if "layout" in keys else F.lit(0).cast("long").alias("layout")
    rows = _by(keys, pages, references, size, "inner").select("host", layout, "html", "one", "two")
    return rows.mapInArrow(run, "host string, layout long, reference int, path long, item long, n long").groupBy(*names[:-1]).agg(F.sum("n").alias("n"))


def induce(pages: DataFrame) -> DataFrame:
    """(host, layout, template array<long>, met array<long>): marks of template paths and lines, and of paths aligned often enough.

    Every page (host, layout, html) is aligned with two references of its host, those with the least and the greatest hash; the result
    has layout 0. In hosts with several layouts it is aligned with two references of its layout, too. The arrays are no longer than the
    paths and lines of two pages, as only what a reference has is counted.
    """
    order = F.xxhash64("html")
    ends = [F.min_by("html", order).alias("one"), F.max_by("html", order).alias("two")]
    sizes = pages.groupBy("host", "layout").agg(F.count("*").alias("pages"))
    sizes = sizes.join(sizes.groupBy("host").agg(F.count("*").alias("layouts")), "host")
    several = staged(sizes.where((F.col("layouts") > 1) & (F.col("pages") >= LEAST_PAGES)).select("host", "layout"), "layouts")
    counted = _counted(pages, pages.groupBy("host").agg(*ends), ["host"])
    if not several.isEmpty():
        own = pages.join(several, ["host", "layout"], "left_semi").groupBy("host", "layout").agg(*ends)
        counted = counted.unionByName(_counted(pages, own, ["host", "layout"]))
    counted = staged(counted, "votes")
    share = F.col("same") >= TEMPLATE_SHARE * F.col("pairs")
    nodes = counted.groupBy("host", "layout", "path").agg(F.sum(F.when(F.col("item") == PAIRS, F.col("n"))).alias("pairs"), F.coalesce(F.sum(F.when(F.col("item") == EQUAL, F.col("n"))), F.lit(0)).alias("same"))
    nodes = nodes.where(F.col("pairs") >= LEAST_PAIRS).select("host", "layout", "path", F.when(share, F.col("path")).alias("mark"))
    # A line is judged by the alignments with the references that have it.
    pairs = counted.where(F.col("item") == PAIRS).select("host", "layout", "reference", "path", F.col("n").alias("pairs"))
    lines = counted.where(F.col("item") > EQUAL).join(pairs, ["host", "layout", "reference", "path"]).groupBy("host", "layout", "item").agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("same"))
    lines = lines.where((F.col("pairs") >= LEAST_PAIRS) & share).select("host", "layout", F.lit(None).cast("long").alias("path"), F.col("item").alias("mark"))
    return nodes.unionByName(lines).groupBy("host", "layout").agg(F.collect_list("mark").alias("template"), F.collect_list("path").alias("met"))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, one row a row.

    A null or empty page has an empty text. A null or odd URL counts as the empty host, whose pages share a template like any other's.
    Blocks are joined by one line break in page order; white space within a block is one space. Extra columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    pages = texts_of(df, df[id_col].alias("id"), df[url_col].alias("url"), F.coalesce(df[html_col], F.lit("")).alias("html")).withColumn("host", host_of(F.col("url")))
    pages = staged(with_layout(pages), "pages")
    wrappers = staged(induce(pages.select("host", "layout", "html")), "wrappers")
    size = wrappers.agg(F.sum(F.length("host") + 8 * (F.size("template") + F.size("met"))).alias("n")).first()["n"] or 0

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(blocks(page), *(set(marks or ()) for marks in wrapper)) for page, *wrapper in zip(*(part.column(c).to_pylist() for c in range(2, 6)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    out = _by(["host"], pages, wrappers.where("layout = 0").select("host", "template"), size)
    out = _by(["host", "layout"], out, wrappers.where("layout <> 0").select("host", "layout", F.col("template").alias("own"), "met"), size)
    out = out.select("id", "url", "html", "template", "own", "met").mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
