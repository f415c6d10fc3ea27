"""Main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship
from .common import table

#: Element names of HTML, and words that name what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template iframe textarea svg math object canvas audio video noframes xmp".split())
NEVER = frozenset("head title nav footer aside button select option label fieldset dialog menu".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = frozenset("ul ol dl table article section div body html td th".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|banners?|sponsor(?:s|ed)?|promos?|promotions?|cookies?|consent|gdpr|notices?|notifications?|alerts?|pop-?ups?|modal|overlay|"
    r"newsletters?|subscribe|subscription|sign-?up|side-?bars?|asides?|menus?|nav|navbar|navigation|breadcrumbs?|headers?|masthead|top-?bar|site-?header|page-?header|footers?|copyright|legal|disclaimer|"
    r"comments?|comment-?list|disqus|repl(?:y|ies)|respond|discussion|reviews?|related|recommend(?:ed|ations?)?|more-?stories|read-?more|shar(?:e|ing)|social|widgets?|toolbar|pagination|pager|login|sign-?in|search|tag-?cloud|skip|hidden|noprint)(?=$|[\s_-])"
)
#: Words of BOILERPLATE that name an article's own heading, and those whose element is never a wrapper of the page.
OWN_HEADER = re.compile(r"(?:^|(?<=[\s_-]))(?:entry|post|article|story)[\s_-]?headers?(?=$|[\s_-])")
HEADER = re.compile(r"(?:^|(?<=[\s_-]))headers?(?=$|[\s_-])")
DISCUSSION = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|disqus|repl(?:y|ies)|respond|discussion)(?=$|[\s_-])")
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?=$|[\s_-])")
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*))>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[/a-zA-Z][^>]*\Z|(?P<text>[^<]+|<)",
    re.S,
)
ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
STATE = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no)-\S+|(?:^|(?<=\s))\S+-(?:open|closed|enabled|disabled)(?=$|\s)")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Weights of the classifier and of the smoothness edges.
BIAS, IN_ARTICLE, NAMED_CONTENT, PROSE_TAG, PER_100_CHARS, MOST_FOR_LENGTH, LINKS, NEVER_COST = -1.0, 2.5, 1.5, 1.0, 1.0, 3.0, -5.0, -60.0
SAME_PARENT, SAME_GRANDPARENT, ADJACENT = 0.8, 0.4, 0.1
PROSE = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 figcaption dd".split())


class Block:
    """A run of text inside one block element."""

    __slots__ = ("text", "cost", "parent", "grandparent")

    def __init__(self, text: str, cost: float, parent: int, grandparent: int):
        self.text, self.cost, self.parent, self.grandparent = text, cost, parent, grandparent


class Element(NamedTuple):
    """What an open element tells of the text in it."""

    name: str
    number: int = 0
    article: bool = False
    never: bool = False
    named: bool = False
    link: bool = False
    #: Numbers of the elements above, itself included, that exclude their text unless they wrap the page's article.
    doubts: tuple[int, ...] = ()
    #: Number and doubts of the innermost article that isn't named otherwise itself.
    landmark: tuple[int, tuple[int, ...]] | None = None


def _opened(name: str, attrs: str, above: Element, number: int) -> Element:
    """The element, given its parent's."""
    article, never, named, link = above.article or name in ("article", "main"), above.never or name in NEVER, above.named, above.link or name == "a"
    never = never or (name == "header" and not above.article)
    doubt, landmark = name == "form", name in ("article", "main")
    if attrs.strip(" /\n\t"):
        found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)}
        said = CAMEL.sub("-", f"{found.get('class', '')} {found.get('id', '')}").lower()
        said = OWN_HEADER.sub(" ", STATE.sub(" ", said))
        if above.article:
            said = HEADER.sub(" ", said)
        role = found.get("role", "").lower()
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
        never = never or bool(hidden) or role in BOILERPLATE_ROLES
        if name not in ("html", "body") and BOILERPLATE.search(said):
            doubt, never = True, never or bool(DISCUSSION.search(said))
        article = article or role in ("main", "article")
        landmark = landmark or role in ("main", "article")
        named = named or bool(CONTENT.search(said))
    doubts = (*above.doubts, number) if doubt else above.doubts
    return Element(name, number, article, never, named, link, doubts, (number, doubts) if landmark and not doubt else above.landmark)


def wrappers(found: list[tuple[int, bool, Element]]) -> set[int]:
    """Numbers of the doubtful elements that wrap the page's article, which excludes nothing.

    ``found`` has the length of each block, whether it is prose, and its element. The longest
    article (the first of equal ones) is the page's; without any, an element that holds more than half
    of the prose wraps the page.
    """
    sizes: Counter = Counter()
    for size, _, e in found:
        if e.landmark and not e.never:
            sizes[e.landmark] += size
    if sizes:
        return set(max(sizes, key=sizes.__getitem__)[1])
    prose: Counter = Counter()
    whole = sum(size for size, is_prose, e in found if is_prose and not e.never)
    for size, is_prose, e in found:
        if is_prose and not e.never:
            prose.update({d: size for d in e.doubts})
    return {d for d, n in prose.items() if 2 * n > whole}


def blocks(html: str | None) -> list[Block]:
    """Blocks in page order, each with its log-odds of being content."""
    out: list[Block] = []
    found: list[tuple[int, bool, Element]] = []
    stack, numbers, serial = [Element("")], [0], 0
    pieces: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(pieces)).split()) if pieces else ""
        if text:
            at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name in BLOCK), 0)
            top = stack[at]
            cost = BIAS + IN_ARTICLE * top.article + NAMED_CONTENT * top.named + PROSE_TAG * (top.name in PROSE)
            cost += min(len(text) * PER_100_CHARS / 100, MOST_FOR_LENGTH) + LINKS * min(1.0, linked / len(text))
            found.append((len(text), top.name in PROSE, stack[-1]))
            out.append(Block(text, cost, numbers[max(at - 1, 0)], numbers[max(at - 2, 0)]))
        pieces.clear()
        linked = 0

    at, html = 0, html or ""
    while m := TOKEN.match(html, at):
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            if (text := m["text"] or m["cdata"]) is not None:
                pieces.append(text)
                if stack[-1].link:
                    linked += len(text)
            continue
        name, attrs = name.lower(), m["attrs"] if m["attrs"] is not None else m["attrs2"]
        if m["end"] or m["end2"]:
            if name in BLOCK:
                close()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    if name in BLOCK or all(e.name not in BLOCK for e in stack[k:]):
                        del stack[k:], numbers[k:]
                    break
            continue
        if name == "br":
            pieces.append(" ")
        if name in RAW:
            if attrs.endswith("/") and name in ("svg", "math", "object"):
                continue
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in BLOCK:
            close()
            closes = CLOSES.get(name, set()) | {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in closes:
                    del stack[k:], numbers[k:]
                    break
                if stack[k].name in SCOPES:
                    break
        if name in VOID:
            continue
        serial += 1
        stack.append(_opened(name, attrs, stack[-1], serial))
        numbers.append(serial)
    close()
    around = wrappers(found)
    for block, (_, _, e) in zip(out, found, strict=True):
        if e.never or not around.issuperset(e.doubts):
            block.cost = NEVER_COST
    return out


def minimum_cut(cost: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True where the minimum cut leaves a node with the content side.

    A node's cost is a capacity to the content terminal if positive, else to the other.
    First, nodes whose terminal outweighs all their edges are settled, which no minimum cut
    contradicts, and weigh on their neighbours; max-flow (Dinic) settles the rest.
    """
    n, c = len(cost), list(cost)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(c[i]) > sum(near[i].values()):
            label[i] = c[i] > 0
            for j, w in near[i].items():
                c[j] += w if label[i] else -w
                near[j].pop(i, None)
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if not left:
        return [bool(x) for x in label]
    source, sink = n, n + 1
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in left}
    room[source], room[sink] = {}, {}
    for i in left:
        room[source][i], room[i][source] = max(c[i], 0.0), 0.0
        room[i][sink], room[sink][i] = max(-c[i], 0.0), 0.0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, r in room[u].items():
                if r > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [i in level if x is None else x for i, x in enumerate(label)]
        arcs = {u: [v for v in room[u] if level.get(v, -1) == level[u] + 1] for u in level}
        path = [source]
        while path:  # one blocking flow
            u = path[-1]
            if u == sink:
                most = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    room[a][b] -= most
                    room[b][a] += most
                path = [source]
                continue
            while arcs[u] and room[u][arcs[u][-1]] <= 1e-12:
                arcs[u].pop()
            if arcs[u]:
                path.append(arcs[u][-1])
            else:
                path.pop()
                if path:
                    arcs[path[-1]].pop()


def main_text(html: str | None) -> str:
    """Content blocks in page order, one to a line."""
    found = blocks(html)
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            edges.append((i - 1, i, SAME_PARENT if a.parent == b.parent else SAME_GRANDPARENT if a.grandparent == b.grandparent else ADJACENT))
        if (j := last.get(b.parent, i - 1)) < i - 1:
            edges.append((j, i, SAME_PARENT))  # nearest earlier block of the same parent, whatever stands between
        last[b.parent] = i
    keep = minimum_cut([b.cost for b in found], edges)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row for each row of ``pages``, from the whole html.

    Null and empty html give an empty text. Ids and urls pass through, null or repeated.
    Broken mark-up is read as browsers do where that is simple: a tag that the end of the
    page cuts off is dropped, unclosed elements end with their parent.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                text = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    found = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id bigint, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages``."""
    return extract(table(spark, sf_dir, "pages"))
