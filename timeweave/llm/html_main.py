"""Main text of web pages by tag-path ratios.

A page is read into text runs, each with the path of tags from the root to its leaf.  Per path the lengths of text and the
punctuation marks of all its runs are summed; their product over the number of runs is the path's score, which paths next to each
other on the page smooth, and which links in the text reduce.  Paths of at least a share of the mean score are content; the
container they share, the deepest that holds most of their text, is the article, and all runs within it are kept, short ones
such as headings and list items too, except runs in parts that are never article text (menus, forms, adverts, comments, ...).  Parts that only
their name or a form marks so are judged by the text they hold first: they stay if they hold the page's content, or several
paragraphs as long as those elsewhere.  Reader comments without a telling name are known by their form: items of one kind, each a short
line of who wrote it, then text.  Lists of links into the page itself, tables of contents, are no text either.

Defined results: a null page counts as empty and has an empty text; broken markup (tags left open, tags closed twice, references
cut off) is read as browsers read it; texts of any length are kept whole; repeated rows are read each by itself; other columns are
ignored.  Pages are independent: one pass, no shuffle.  A page is a tree of nodes with parent numbers, so time and memory grow with
its length, not with its depth.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names of the markup language by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
NEVER = frozenset("nav footer aside button select option script style textarea title head noscript template iframe svg math canvas object audio video dialog menu".split())
SELDOM = frozenset(("form", "fieldset"))  # not article text, unless they are around a page's text
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_SAME = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "tbody": ("table",), "thead": ("table",)}

# Words in class, id and role attributes of parts that are not article text.
NEVER_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|comment-?list|cookies?|consent|copyright|disclaimer|disqus|dropdown|footer|gdpr|login|masthead|menu|"
    r"modal|nav\w*|newsletter|notice|pagination|pager|popup|promo\w*|recommend\w*|related|replies|respond|search|share|sharing|sidebar|signup|site-?header|skip|social|"
    r"sponsor\w*|subscri\w*|toolbar|widget|complementary|contentinfo|navigation|alert)(?:$|[\s_-])",
    re.IGNORECASE,
)
# Those of them that mark what readers wrote, which no amount of text makes an article's.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|disqus|replies|respond)(?:$|[\s_-])", re.IGNORECASE)
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = INLINE | HEADINGS | {"p", "li", "pre", "blockquote"}
BARRIERS = (ENDS_PARAGRAPH - {"p"}) | {"td", "th", "li"}
ITEMS = frozenset("article div li section".split())
SENTENCE_END = frozenset(".,;:!?…")
PUNCTUATION = frozenset(".,;:!?¿¡…·«»\"'()—–-")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.DOTALL)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|href|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
SPACE = re.compile(r"[\s ]+")


@dataclass
class Run:
    """A piece of text in one block: its leaf node and the number of the block."""

    text: str
    node: int
    block: int


@dataclass
class Page:
    """Text runs and the tree of nodes, numbered in page order from the root, 0: a child's number is greater than its parent's.
    ``paths`` numbers the tag paths; nodes of equal path share one number."""

    runs: list[Run] = field(default_factory=list)
    names: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])
    paths: list[int] = field(default_factory=lambda: [0])
    kinds: list[str] = field(default_factory=lambda: [""])  # the element with its class, by which items of a list are alike
    in_link: list[bool] = field(default_factory=lambda: [False])
    in_article: list[bool] = field(default_factory=lambda: [False])
    never: list[bool] = field(default_factory=lambda: [False])
    seldom: set[int] = field(default_factory=set)
    readers: set[int] = field(default_factory=set)
    local_links: set[int] = field(default_factory=set)
    known_paths: dict[tuple[int, str], int] = field(default_factory=dict)

    def grow(self, parent: int, name: str, attributes: str) -> int:
        node = len(self.names)
        values = {m[1].lower(): (m[2] or "").strip("\"'") for m in NAMES.finditer(attributes)} if attributes else {}
        around = name in ("html", "body", "main", "article")
        hidden = not around and ("hidden" in values or values.get("aria-hidden", "").lower() == "true")
        # a header inside an article belongs to it
        outside = name in NEVER or (name == "header" and not self.in_article[parent])
        self.names.append(name)
        self.parents.append(parent)
        self.paths.append(self.known_paths.setdefault((self.paths[parent], name), len(self.known_paths) + 1))
        self.kinds.append(f"{name} {values.get('class', '')}")
        self.in_link.append(self.in_link[parent] or name == "a")
        self.in_article.append(self.in_article[parent] or name in ARTICLE)
        self.never.append(self.never[parent] or outside or hidden)
        told = [HUMP.sub("-", values[k]) for k in ("class", "id", "role") if k in values]
        if not around and (name in SELDOM or any(NEVER_NAMED.search(v) for v in told)):
            self.seldom.add(node)
            if any(COMMENTS.search(v) for v in told):
                self.readers.add(node)
        if name == "a" and values.get("href", "").startswith("#"):
            self.local_links.add(node)
        return node

    def below(self, marked: set[int]) -> list[int]:
        """For each node the outermost marked node it is in, or -1."""
        out = [-1] * len(self.names)
        for n in range(len(out)):
            outer = out[self.parents[n]]
            out[n] = outer if outer >= 0 else n if n in marked else -1
        return out

    def summed(self, values: dict[int, float]) -> list[float]:
        """For each node the sum over itself and all nodes in it."""
        out = [0.0] * len(self.names)
        for n, v in values.items():
            out[n] += v
        for n in range(len(out) - 1, 0, -1):
            out[self.parents[n]] += out[n]
        return out

    def without(self, marked: set[int]) -> None:
        if marked:
            outer = self.below(marked)
            self.runs = [run for run in self.runs if outer[run.node] < 0]


class Open:
    """The open elements, with the places of each name, of blocks and of elements that end the reach of a paragraph, so that no
    tag has to look through all of them."""

    def __init__(self) -> None:
        self.nodes, self.tags = [0], [""]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.barriers: list[int] = []

    def last(self, *names: str) -> int:
        """Place of the innermost open element of these names, 0 if none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def push(self, name: str, node: int) -> None:
        place = len(self.tags)
        self.nodes.append(node)
        self.tags.append(name)
        self.places[name].append(place)
        if name not in INLINE:
            self.blocks.append(place)
        if name in BARRIERS:
            self.barriers.append(place)

    def close(self, place: int) -> bool:
        """Close all from ``place`` on; whether a block was among them."""
        block = bool(self.blocks) and self.blocks[-1] >= place
        while len(self.tags) > place:
            self.nodes.pop()
            self.places[self.tags.pop()].pop()
        for places in (self.blocks, self.barriers):
            while places and places[-1] >= place:
                places.pop()
        return block


def read(page: str) -> Page:
    """Text runs outside the parts that are never article text, in page order."""
    out, open_ = Page(), Open()
    at = block = 0

    def add(text: str) -> None:
        if text and not out.never[open_.nodes[-1]]:
            out.runs.append(Run(html.unescape(text), open_.nodes[-1], block))

    while at < len(page):
        m = TAG.search(page, at)
        add(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            place = open_.last(name)
            # an inline end tag doesn't close the blocks around it
            if place and not (name in INLINE and open_.blocks and open_.blocks[-1] > place):
                block += open_.close(place)
            elif name in ("p", "br"):
                block += 1
            continue
        if name in ENDS_PARAGRAPH:
            place = open_.last("p")
            if place and not (open_.barriers and open_.barriers[-1] > place):
                block += open_.close(place)
        if name in CLOSED_BY_SAME:
            place = open_.last(*next((alike for alike in (("dt", "dd"), ("td", "th")) if name in alike), (name,)))
            if place > open_.last(*CLOSED_BY_SAME[name]):
                block += open_.close(place)
        if name not in INLINE:
            block += 1
        if name in VOID or m[3].endswith("/"):
            continue
        open_.push(name, out.grow(open_.nodes[-1], name, m[3]))
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            block += open_.close(len(open_.tags) - 1)
    return out


@dataclass(frozen=True)
class Ratios:
    """``window`` paths on either side smooth a score; paths of ``share`` of the mean score are content; the article is the deepest
    container with ``most`` of the content paths' text.  ``several`` paragraphs or items make a part that is judged as such; the
    line that opens a reader's comment has at most ``byline`` characters."""

    window: int = 2
    share: float = 0.5
    most: float = 0.9
    several: int = 3
    byline: int = 48


def path_scores(page: Page, options: Ratios) -> dict[int, float]:
    """Smoothed score of each tag path: text length and punctuation per run, less text in links."""
    length, marks, links, count = (defaultdict(float) for _ in range(4))
    for run in page.runs:
        size = len(SPACE.sub("", run.text))
        if not size:
            continue
        path = page.paths[run.node]
        count[path] += 1
        length[path] += size
        links[path] += size * page.in_link[run.node]
        marks[path] += sum(c in PUNCTUATION for c in run.text)
    order = list(count)
    plain = [length[p] * (1 + marks[p]) / count[p] * (1 - links[p] / length[p]) ** 2 for p in order]
    scores = {}
    for k, path in enumerate(order):
        near = plain[max(0, k - options.window) : k + options.window + 1]
        # a path keeps its own score and is raised, not lowered, by its neighbours' mean
        scores[path] = max(plain[k], (plain[k] + sum(near) / len(near)) / 2 if plain[k] else 0.0)
    return scores


def content_runs(page: Page, options: Ratios) -> list[tuple[Run, int]]:
    """Runs of the paths that are content, with their text lengths."""
    scores = path_scores(page, options)
    least = options.share * sum(scores.values()) / len(scores) if scores else 0.0
    return [(run, len(run.text.strip())) for run in page.runs if scores.get(page.paths[run.node], -1.0) >= least]


def judged_parts(page: Page, options: Ratios) -> set[int]:
    """The parts that are seldom article text and are to go.  The heaviest part stays while no article or main outside such parts
    holds content and it holds one, or while it outweighs by ``most`` the content outside such parts; then the parts in it are judged
    alike.  Of the others those stay that hold ``several`` blocks of content as long, on average, as the content outside, comments
    apart."""
    if not page.seldom:
        return set()
    part = [-1] * len(page.names)  # the innermost part each node is in
    inside: dict[int, list[int]] = defaultdict(list)
    for n in range(1, len(part)):
        part[n] = part[page.parents[n]]
        if n in page.seldom:
            inside[part[n]].append(n)
            part[n] = n
    own: dict[int, float] = defaultdict(float)
    own_blocks: dict[int, set[int]] = defaultdict(set)
    own_article: set[int] = set()
    for run, size in content_runs(page, options):
        k = part[run.node]
        own[k] += size
        own_blocks[k].add(run.block)
        if page.in_article[run.node]:
            own_article.add(k)
    weight, blocks, article = dict(own), {k: len(b) for k, b in own_blocks.items()}, set(own_article)
    for n in sorted(page.seldom, reverse=True):  # parts in others have greater numbers
        outer = part[page.parents[n]]
        if outer >= 0:
            weight[outer] = weight.get(outer, 0.0) + weight.get(n, 0.0)
            blocks[outer] = blocks.get(outer, 0) + blocks.get(n, 0)
            article |= {outer} if n in article else set()
    plain, plain_blocks, plain_article = own[-1], len(own_blocks[-1]), -1 in own_article
    gone = {n for n in inside[-1] if n not in weight}
    heap = [(n not in article, -weight[n], n) for n in inside[-1] if n in weight]
    heapq.heapify(heap)
    while heap and not plain_article:
        unnamed, heavy, n = heap[0]
        if unnamed and -heavy < options.most * (-heavy + plain):
            break
        heapq.heappop(heap)
        plain, plain_blocks, plain_article = plain + own[n], plain_blocks + len(own_blocks[n]), n in own_article
        for c in inside[n]:
            if c in weight:
                heapq.heappush(heap, (c not in article, -weight[c], c))
            else:
                gone.add(c)
    rest = [n for _, _, n in heap]
    while rest:
        n = rest.pop()
        if n in page.readers or blocks.get(n, 0) < options.several or weight.get(n, 0.0) * plain_blocks < plain * blocks[n]:
            gone.add(n)
        else:
            rest += inside[n]
    return gone


def comment_items(page: Page, options: Ratios) -> set[int]:
    """Items of lists of comments: elements of one kind under one parent, each a short line without a sentence, then more blocks.
    A list with most of the page's text is its article, whatever its form."""
    size = {}
    for run in page.runs:
        size[run.node] = size.get(run.node, 0.0) + len(run.text.strip())
    held = page.summed(size)
    alike: dict[tuple[int, str], list[int]] = defaultdict(list)
    for n, name in enumerate(page.names):
        if name in ITEMS and held[n] and not page.never[n]:
            alike[(page.parents[n], page.kinds[n])].append(n)
    lists = [items for items in alike.values() if len(items) >= options.several and 2 * sum(held[n] for n in items) <= held[0]]
    if not lists:
        return set()
    item = {n for items in lists for n in items}
    inner = [-1] * len(page.names)  # the innermost item each node is in
    above: dict[int, int] = {}
    for n in range(1, len(inner)):
        inner[n] = inner[page.parents[n]]
        if n in item:
            above[n], inner[n] = inner[n], n
    first: dict[int, tuple[int, int, list[str]]] = {}  # block, node and text of each item's first block
    longer: set[int] = set()
    for run in page.runs:
        k = inner[run.node] if run.text.strip() else -1
        while k >= 0 and k not in longer:
            if k not in first:
                first[k] = (run.block, run.node, [])
            if first[k][0] == run.block:
                first[k][2].append(run.text)
            else:
                longer.add(k)
            k = above[k]

    def signed(n: int) -> bool:
        if n not in longer:
            return False
        _, node, parts = first[n]
        line = SPACE.sub(" ", "".join(parts)).strip()
        while node != n:
            if page.names[node] in HEADINGS:
                return False
            node = page.parents[node]
        return len(line) <= options.byline and line[-1:] not in SENTENCE_END

    return {n for items in lists if all(signed(n) for n in items) for n in items}


def link_lists(page: Page, options: Ratios) -> set[int]:
    """Lists of ``several`` links into the page itself that are ``most`` of their text: tables of contents."""
    if not page.local_links:
        return set()
    outer = page.below(page.local_links)
    size: dict[int, float] = defaultdict(float)
    local: dict[int, float] = defaultdict(float)
    for run in page.runs:
        n = len(run.text.strip())
        size[run.node] += n
        local[run.node] += n * (outer[run.node] >= 0)
    held, linked, count = page.summed(size), page.summed(local), page.summed(dict.fromkeys(page.local_links, 1.0))
    return {n for n, name in enumerate(page.names) if name in ("ol", "ul") and count[n] >= options.several and linked[n] >= options.most * held[n]}


def main_text(page: str, options: Ratios = Ratios()) -> str:
    """The article's blocks in page order, joined by a space."""
    found = read(page)
    found.without(judged_parts(found, options))
    found.without(comment_items(found, options) | link_lists(found, options))
    content = content_runs(found, options)
    if not content:
        return ""
    size: dict[int, float] = defaultdict(float)
    for run, n in content:
        size[run.node] += n
    weight = found.summed(size)
    named = sum(n for run, n in content if found.in_article[run.node])
    holding = found.summed(dict.fromkeys((run.node for run, _ in content), 1.0))
    article = {n for n, name in enumerate(found.names) if name in ARTICLE and holding[n]}
    if article and 2 * named >= weight[0]:  # pages that name their article: all that hold content, unless most content is elsewhere
        kept = article
    else:
        # the deepest container of most content that is not a mere piece of running text
        depth = [0] * len(found.names)
        for n in range(1, len(depth)):
            depth[n] = depth[found.parents[n]] + 1
        fit = (n for n, w in enumerate(weight) if holding[n] and w >= options.most * weight[0] and found.names[n] not in TEXT_BLOCKS)
        kept = {max(fit, key=lambda n: depth[n])}
    outer = found.below(kept)
    blocks: dict[int, list[str]] = {}
    for run in found.runs:
        if outer[run.node] >= 0:
            blocks.setdefault(run.block, []).append(run.text)
    texts = (SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return " ".join(t for t in texts if t)


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", page: str = "html", options: Ratios = Ratios()) -> DataFrame:
    """(id, url, text, n_chars) per row."""
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", options) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, "url", "text"])

    rows = pages.select(F.col(id_col), F.col(url).cast("string").alias("url"), F.col(page).alias("html")).mapInArrow(run, schema)
    return rows.withColumn("n_chars", F.length("text").cast("long"))
