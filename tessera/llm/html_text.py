"""Main text of web pages by composite text density.

Every element gets a density: characters per tag, adjusted for the share of link text. The children's densities are
summed; the element with the largest sum is the content (or the article that it is part of), and the smallest density on
its path to the body is the threshold with which further dense elements join it. Elements that are boilerplate by their
kind or role (navigation, scripts, forms) are taken out before. Words of a class or id choose nothing: they take parts
like adverts or comments out of the chosen subtree, and such parts are not themselves chosen. A page without any dense
element gives all text of its body. Parsing takes time in proportion to the page, however deep it nests.
"""

from __future__ import annotations

import html as _html
import math
import re
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import bounded_batches

# HTML elements by kind.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe object embed svg canvas audio video button select textarea input label dialog menu title head noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("dd dt li body html tbody td tfoot th thead tr".split()) | {"dd", "dt", "li"}
CLOSED_BY = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",)}
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|header|masthead|topbar|cookie\w*|consent|gdpr|notices?|notification\w*|alert|newsletter|subscribe\w*|subscription|signup|"
    r"login|popup|modal|overlay|comments?|commentlist|respond|reply|replies|disqus|discussion|related|recommended|recommendations|share|sharing|social|pagination|pager|widget\w*|toolbar|skip|search|hidden|copyright|disclaimer|legal)(?=$|[\s_-])",
    re.I,
)
#: Words of layout that also name whole columns ("has-sidebar"): what holds an article or a main element stays in spite of them.
LAYOUT = re.compile(r"(?:^|[\s_-])(?:nav\w*|menu\w*|sidebar\w*|side|header|banner|footer\w*|widget\w*|search|share|sharing|social|overlay|modal|hidden|related|notices?)(?=$|[\s_-])", re.I)
COMMENT_ARTICLES = frozenset("comment comment-body comment-content comment-item reply".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^>"']|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/><]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Tree:
    """Elements in page order as parallel lists; ``runs`` has (element, text) in page order, text None where a block begins or ends."""

    def __init__(self):
        self.tag, self.parent, self.dropped, self.runs = ["#root"], [-1], [False], []
        self.kind, self.marked = [KEPT], [False]

    def settle(self) -> None:
        """Mark the elements that a class or id word calls boilerplate, and take out the text of dropped ones."""
        n = len(self.tag)
        linked, plain, inside = [False] * n, [0] * n, [0] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.tag[i] == "a"
            self.dropped[i] = self.dropped[self.parent[i]] or self.kind[i] == HARD
            inside[i] = int(self.tag[i] in ("article", "main") and not self.dropped[i] and self.kind[i] != WORD)
        for i, text in self.runs:
            if text and not linked[i]:
                plain[i] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            plain[self.parent[i]] += plain[i]
            inside[self.parent[i]] += inside[i]
        word = [False] * n
        for i in range(1, n):  # most of the page's text, and each article or main element, is no boilerplate
            word[i] = self.kind[i] in (SOFT, WORD) and not (2 * plain[i] > plain[0] and inside[i] == inside[0])
        holds = [t in ("article", "main") and k != HARD and not (k == WORD and w) for t, k, w in zip(self.tag, self.kind, word, strict=True)]
        for i in range(n - 1, 0, -1):
            holds[self.parent[i]] |= holds[i] and not (self.kind[i] == WORD and word[i])
        for i in range(1, n):
            self.marked.append(self.marked[self.parent[i]] or word[i] and (self.kind[i] == WORD or not holds[i]))
        self.runs = [(i, text) for i, text in self.runs if text is None or not self.dropped[i]]


KEPT, SOFT, WORD, HARD = range(4)


def _dropping(tag: str, attributes: str, in_content: bool) -> int:
    """HARD: boilerplate with all in it; WORD: called so unless it holds most of the page; SOFT: or an article or main element."""
    if tag in DROPPED or tag == "header" and not in_content:
        return HARD
    if not attributes or tag in ("body", "html"):
        return KEPT
    out = KEPT
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and not value or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HARD
        if tag in ("article", "main"):
            if name == "class" and not COMMENT_ARTICLES.isdisjoint(value.lower().split()):
                out = WORD
        elif name == "role" and value.lower() in ROLES:
            return HARD
        elif name in ("class", "id") and BOILERPLATE.search(value):
            out = max(out, WORD if not LAYOUT.search(value) or BOILERPLATE.search(LAYOUT.sub(" ", value)) else SOFT)
    return out


def parse(text: str) -> Tree:
    """Forgiving parser: unknown end tags are ignored, paragraphs, list items and table parts close as HTML implies."""
    tree, stack, content, at = Tree(), [0], 0, 0
    tags, parents, hard, runs = tree.tag, tree.parent, tree.dropped, tree.runs
    match = _TOKEN.search

    #: Depths of the open elements by name, and of the open blocks that are no paragraphs, each rising.
    where: dict[str, list[int]] = defaultdict(list)
    walls: list[int] = []

    def lowest(names, above: int) -> list[int]:
        """Of each name the lowest open element deeper than ``above``."""
        return [w[k] for name in names if (w := where[name]) and (k := bisect_right(w, above)) < len(w)]

    def highest(names) -> int:
        return max((where[name][-1] for name in names if where[name]), default=0)

    def pop_to(depth: int) -> None:
        nonlocal content
        while len(stack) > depth:
            i = stack.pop()
            where[tags[i]].pop()
            if walls and walls[-1] == len(stack):
                walls.pop()
            content -= tags[i] in ("article", "main")
            if tags[i] in BLOCKS:
                runs.append((i, None))

    last = text.rfind(">") + 1  # no tag ends behind it
    while m := match(text, at, max(at, last)):
        if m.start() > at and not hard[stack[-1]]:
            runs.append((stack[-1], text[at : m.start()]))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name in ("body", "html") or not where[name]:
                continue
            d = where[name][-1]
            if name in ("table", "article", "div", "section", "main", "form") or d > highest(("table", "article", "body")):
                pop_to(d)
            continue
        attributes = m[3] or m[6] or ""
        if name in CLOSES_P and where["p"] and where["p"][-1] > (walls[-1] if walls else 0):
            pop_to(where["p"][-1])
        if name in CLOSED_BY:
            closes, scope = CLOSED_BY[name], highest(SCOPES.get(name, ()))
            if highest(closes) > max(scope, highest(("div", "section", "article", "body"))):
                pop_to(min(lowest(closes, scope)))
        if name in ("html", "body") and where[name]:
            continue
        above = stack[-1]
        i = len(tags)
        tags.append(name)
        parents.append(above)
        kind = _dropping(name, attributes, content > 0)
        tree.kind.append(kind)
        hard.append(hard[above] or kind == HARD)
        if name in BLOCKS:
            runs.append((i, None))
        if name == "br":
            runs.append((above, " "))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        where[name].append(len(stack))
        if (name in BLOCKS or name == "button") and name != "p":
            walls.append(len(stack))
        stack.append(i)
        content += name in ("article", "main")
    if at < len(text) and not hard[stack[-1]]:
        runs.append((stack[-1], text[at:]))
    pop_to(1)
    tree.settle()
    return tree


def densities(tree: Tree) -> tuple[list[float], list[float]]:
    """(composite density, sum of the densities of the block children) of each element."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[tree.parent[i]] or tree.tag[i] == "a"
    for i, text in tree.runs:
        if text and not tree.dropped[i]:
            size = len("".join(text.split()))
            chars[i] += size
            if in_link[i]:
                link_chars[i] += size
    for i in range(n - 1, 0, -1):
        if tree.dropped[i]:
            continue
        p = tree.parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i] + (tree.tag[i] == "a")
    whole, linked = max(1, chars[0]), link_chars[0]
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        if not chars[i] or tree.dropped[i]:
            continue
        c, t, lc, lt = chars[i], max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
        plain = max(1, c - link_chars[i])
        base = math.log(c / plain * link_chars[i] + linked / whole * c + math.e)
        density[i] = c / t * max(0.0, math.log(c / lc * t / lt + 1e-9)) / max(math.log(base), 1.0) if c > 1 else 0.0
    block = [0] * n  # the block that an element is or is in: an inline element between two blocks does not hide the inner one
    for i in range(1, n):
        above = block[tree.parent[i]]
        block[i] = i if tree.tag[i] in BLOCKS else above
        if block[i] == i:
            total[above] += density[i]
    return density, total


def select(tree: Tree) -> list[bool]:
    """Which elements' own text is main text."""
    n = len(tree.tag)
    density, total = densities(tree)
    top = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    best = max((i for i in range(n) if not tree.dropped[i] and not tree.marked[i]), key=lambda i: (total[i], -i))
    if total[best] <= 0:
        return [not gone and (i == 0 or i >= top) for i, gone in enumerate(tree.dropped)]
    i = best
    while i > 0:  # a part of an article stands for the article
        if tree.tag[i] == "article":
            best = i
        i = tree.parent[i]
    threshold, i = density[best], best
    while i > 0 and i != top:
        i = tree.parent[i]
        if density[i] > 0:
            threshold = min(threshold, density[i])
    chosen = [False] * n
    within = [False] * n
    for i in range(n):
        within[i] = i == best or i > 0 and within[tree.parent[i]]
    scope = any(tree.tag[i] in ("article", "main") and within[i] for i in range(n)) or any(tree.tag[i] == "article" for i in _ancestors(tree, best))
    path = set(_ancestors(tree, best))
    for i in range(n):
        p = tree.parent[i]
        inherited = i > 0 and chosen[p]
        dense = not scope and tree.tag[i] in BLOCKS and i not in (0, top) and tree.tag[i] != "html" and density[i] >= threshold and i not in path
        chosen[i] = not tree.dropped[i] and not tree.marked[i] and (inherited or within[i] or dense or tree.tag[i] == "h1" and not scope)
    return chosen


def _ancestors(tree: Tree, i: int):
    while i >= 0:
        yield i
        i = tree.parent[i]


def main_text(text: str | None) -> str:
    """Blocks of the main text in page order, one a line; white space inside a block is one blank."""
    if not text:
        return ""
    tree = parse(text)
    chosen = select(tree)
    blocks, parts = [], []
    for i, run in tree.runs:
        if run is None:
            if parts:
                blocks.append(" ".join(_html.unescape("".join(parts)).split()))
                parts = []
        elif chosen[i]:
            parts.append(run)
    if parts:
        blocks.append(" ".join(_html.unescape("".join(parts)).split()))
    return "\n".join(b for b in blocks if b)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``; null or empty html, and html without text: empty text.

    Row by row and without a shuffle: repeated rows and ids stay, extra columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    bounded_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
