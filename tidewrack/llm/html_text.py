"""Main text of web pages by tag-path ratios.

Every text node has a tag path, from the root to it. Lengths and punctuation
are added up by path and give each node its path's ratios (text, punctuation
and linked share a node); these are smoothed along the page, fused and held
against a threshold. What passes decides the content elements: the deepest
containers that together hold all of it. Inside them a block goes where its own
path fails: where the path's text is mostly linked, or where a block of no
meaning of its own (div, section) has a path below the threshold. Headings,
paragraphs, list items and cells stay, short ones too.

Paths can't tell a reader's comment from the article's prose, so elements are
left out beforehand that say what they are: by their name (nav, aside, form,
...), or by a class or id of MARKS, unless they hold the page's heading, main
element or an article of no such name, as a wrapper does.

Pages are independent, so this is a map; a page is handled whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame

from .common import text_slices

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: their content is no markup
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg".split())
#: header goes too, but for one in an article or main element, which holds its heading
DROP = RAW | frozenset("head nav footer aside form button select option input label dialog menu object audio video canvas map datalist fieldset legend".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CONTAINER = frozenset("article body center div html main section table tbody td tr ul ol dl blockquote".split())
#: a start tag (left) ends an open element (right) unless one of the stops lies between
ENDS = {t: frozenset(["p"]) for t in BLOCK - {"body", "html", "tr", "tbody", "thead", "tfoot", "caption"}} | {
    "li": frozenset(["li", "p"]),
    "dt": frozenset(["dt", "dd", "p"]),
    "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
STOPS = frozenset("ul ol dl table article section main body div blockquote nav aside header footer form".split())

MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus "
    "dropdown footer footnav gdpr hidden masthead menu menubar modal nav navbar navigation navigate newsletter notice notices notification pager pagination popup promo promoted promotion "
    "related recommend recommended recommendations reply replies respond responses search searchbox share sharing sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription "
    "toolbar topbar tracking widget widgets banners sidecolumn rail outbrain taboola paywall overlay toc complementary contentinfo alert".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: containers that give way to those in them where these hold all selected text; others stay whole
LAYOUT = frozenset("#root html body center div section".split())
#: blocks that mean nothing by themselves, so that their path has to pass the threshold
PLAIN = frozenset("#root html body center div section address".split())
#: names that mark content even beside one of the above
CONTENT_MARKS = frozenset("article content main story entry post body text".split())


def _marked(attributes: str) -> bool:
    """Whether an element's names say that it is no content."""
    for name, a, b, c in NAMES.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
            continue
        words = set(WORD.findall(value))
        if words & MARKS and not (words & CONTENT_MARKS and not words & {"comment", "comments", "sidebar", "footer", "related", "ad", "ads", "nav", "menu", "share", "reply"}):
            return True
    return False


def parse(html: str):
    """The page's elements (tag, parent, marked, linked), parents before children, and its text nodes (element, block, text) outside DROP."""
    tags, parents = ["#root"], [-1]
    dropped, marked, linked = [False], [False], [False]
    stack = [0]
    opened: Counter = Counter()  # how often each name may be on the stack, at most
    nodes: list[tuple[int, int, str]] = []
    block, at, n = 0, 0, len(html)

    def text(raw: str) -> None:
        if raw and not dropped[stack[-1]]:
            nodes.append((stack[-1], block, unescape(raw) if "&" in raw else raw))

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCK:
                block += 1
            if opened[tag]:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag:
                        opened.subtract(tags[j] for j in stack[k:])
                        del stack[k:]
                        break
                else:
                    opened[tag] = 0
            continue
        if tag in BLOCK:
            block += 1
        elif tag in ("br", "td", "th", "img"):
            text(" ")
        if tag in ENDS:
            ends = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in ends:
                    del stack[k:]
                    break
                if tags[stack[k]] in STOPS:
                    break
        if tag == "body":  # what was left open in the head ends here
            while len(stack) > 1 and tags[stack[-1]] != "html":
                stack.pop()
        if tag in VOID:
            continue
        up = stack[-1]
        tags.append(tag)
        parents.append(up)
        outside = tag == "header" and not any(tags[k] in ("article", "main") for k in stack)
        dropped.append(dropped[up] or tag in DROP or outside)
        marked.append(bool(attributes) and tag not in ("html", "body") and _marked(attributes))
        linked.append(linked[up] or tag == "a")
        if tag in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(html, at)
            at = end.end() if end else n
        elif not (attributes.endswith("/") and tag in RAW):
            stack.append(len(tags) - 1)
            opened[tag] += 1
    return tags, parents, marked, linked, nodes


def _unmarked(tags: list[str], parents: list[int], marked: list[bool], nodes: list) -> list:
    """The text nodes outside marked elements; a mark counts for nothing on an element that holds a heading, main or article without one. All, if none is left."""
    holds = [False] * len(tags)
    for i in range(len(tags) - 1, 0, -1):
        if holds[i] or not marked[i] and tags[i] in ("h1", "main", "article"):
            holds[parents[i]] = True
    gone = [False] * len(tags)
    for i in range(1, len(tags)):
        gone[i] = gone[parents[i]] or marked[i] and not holds[i]
    left = [x for x in nodes if not gone[x[0]]]
    return left if any(t.strip() for _, _, t in left) else nodes


def path_scores(paths: list[int], lengths: list[int], marks: list[int], linked: list[int], window: int = 2) -> tuple[list[float], list[float]]:
    """Each node's fused score, its path's text and punctuation a node without linked text: as it is, and smoothed along the page."""
    sums: dict[int, list[float]] = {}
    for p, n, k, a in zip(paths, lengths, marks, linked):
        s = sums.setdefault(p, [0, 0, 0, 0])
        s[0] += n
        s[1] += k
        s[2] += a
        s[3] += 1
    raw = []
    for p in paths:
        n, k, a, count = sums[p]
        raw.append(n / count * (1 + k / count) * (1 - a / n if n else 0))
    weights = [math.exp(-(d * d) / (2 * (window / 2) ** 2)) for d in range(-window, window + 1)]
    out = []
    for i in range(len(raw)):
        total = weight = 0.0
        for d, w in zip(range(-window, window + 1), weights):
            if 0 <= i + d < len(raw):
                total += w * raw[i + d]
                weight += w
        out.append(total / weight)
    return raw, out


def _covering(tags: list[str], parents: list[int], chosen: list[float]) -> list[int]:
    """The deepest containers that hold all selected text (chosen: its length below each element); the root if there is none."""
    around = [0] * len(tags)  # the next container outwards
    children: dict[int, list[int]] = {}
    for i in range(1, len(tags)):
        around[i] = parents[i] if tags[parents[i]] in CONTAINER or not parents[i] else around[parents[i]]
        if tags[i] in CONTAINER and chosen[i]:
            children.setdefault(around[i], []).append(i)
    found, todo = [], [0]
    while todo:
        at = todo.pop()
        held = children.get(at, [])
        if held and sum(chosen[i] for i in held) == chosen[at] and (len(held) == 1 and tags[at] != "main" or tags[at] in LAYOUT):
            todo += held
        else:
            found.append(at)
    return found


def extract(html: str | None) -> str:
    """The main text: blocks in page order, joined by two line ends; empty for null, empty or textless pages."""
    if not html:
        return ""
    tags, parents, marked, linked, nodes = parse(html)
    if any(marked):
        nodes = _unmarked(tags, parents, marked, nodes)
    # children come after their parents, so a path is its parent's and a tag; it is known by a number
    known: dict[tuple[int, str], int] = {}
    paths, around = [0] * len(tags), [0] * len(tags)  # around: the innermost block at or above
    for i in range(1, len(tags)):
        paths[i] = known.setdefault((paths[parents[i]], tags[i]), len(known) + 1)
        around[i] = i if tags[i] in BLOCK else around[parents[i]]
    full = [(e, b, t) for e, b, t in nodes if t.strip()]
    if not full:
        return ""
    lengths = [len(t.strip()) for _, _, t in full]
    marks = [len(PUNCTUATION.findall(t)) for _, _, t in full]
    in_links = [n if linked[e] else 0 for (e, _, _), n in zip(full, lengths)]
    own, scores = path_scores([paths[e] for e, _, _ in full], lengths, marks, in_links)
    mean = sum(scores) / len(scores)
    spread = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    chosen = [0.0] * len(tags)  # selected text below each element
    least = min(spread, max(scores))
    passed: set[int] = set()  # blocks with a node whose path passes
    of_path: dict[int, list[int]] = {}  # text and linked text by the path of the block around
    for (e, b, _), n, a, s, o in zip(full, lengths, in_links, scores, own):
        if s >= least and o >= least:  # what only its neighbours lift over the threshold isn't selected
            chosen[e] += n
        if o >= least:
            passed.add(b)
        sums = of_path.setdefault(paths[around[e]], [0, 0])
        sums[0] += n
        sums[1] += a
    for i in range(len(tags) - 1, 0, -1):
        chosen[parents[i]] += chosen[i]
    inside = [False] * len(tags)
    for i in _covering(tags, parents, chosen):
        inside[i] = True
    for i in range(1, len(tags)):
        inside[i] = inside[i] or inside[parents[i]]
    blocks: list[tuple[bool, list[str]]] = []
    now = None
    for e, b, t in nodes:
        if inside[e]:
            if b != now:
                n, a = of_path.get(paths[around[e]], (0, 0))
                stays = tags[around[e]] in HEADINGS or 2 * a < n and (tags[around[e]] not in PLAIN or b in passed)
                blocks.append((stays, []))
                now = b
            blocks[-1][1].append(t)
    lines = [(stays, " ".join("".join(parts).split())) for stays, parts in blocks]
    lines = [x for x in lines if x[1]]
    return "\n\n".join(t for stays, t in lines if stays) or "\n\n".join(t for _, t in lines)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    Null and empty pages have the empty text. Rows that repeat stay; other
    columns are left out.
    """
    import pyarrow as pa

    def run(batches):
        for b in text_slices(batches, "html"):
            texts = [extract(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
