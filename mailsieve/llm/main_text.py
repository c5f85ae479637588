"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text with what their place says about them. A linear classifier turns each block into
two costs, of calling it content and of calling it boilerplate; they become capacities from the source and to the
sink. Blocks that follow each other, and blocks of the same container, are tied by edges whose capacity falls with
their distance in the element tree. A maximum flow gives the labelling of least total cost: blocks that the source
still reaches are the main text.

There are no labelled pages to learn from, so the weights are stated in ``Weights``. Each page is worked on by itself,
streaming through Arrow batches; edges are at most two for each block. Missing or empty html gives an empty text.
Broken markup never fails: unknown tags are inline, stray ends are ignored, what is open at the end is closed. Repeated
rows give repeated results; other columns of the input are kept except ``text``.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea iframe noembed noframes xmp".split())
UNSEEN_TAGS = RAW_TAGS | frozenset("head title template noscript svg math object canvas audio video select datalist".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu button dialog fieldset header".split())
CONTENT_TAGS = frozenset("article main".split())
#: tags that end an open element of the same kind
SELF_ENDING = {"p": "p", "li": "li", "dt": "dd dt", "dd": "dd dt", "td": "td th", "th": "td th", "tr": "tr td th", "option": "option"}
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|"
    r"alert|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|rail|footer|foot|header|masthead|comments?|"
    r"replies|reply|respond|disqus|discussion|share|sharing|social|related|recommended|newsletter|subscribe|subscription|signup|"
    r"login|popup|modal|overlay|pagination|pager|widget|toolbar|skip|search|copyright|legal|disclaimer)(?:[^a-z]|$)")
CONTENT_NAMES = re.compile(r"(?:^|[^a-z])(?:article|content|main|post|entry|story|body|text)(?:[^a-z]|$)")
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())


@dataclass(frozen=True)
class Weights:
    """Evidence for content (positive) or boilerplate (negative) of a block, and the ties between blocks."""
    any_block: float = 1.0
    in_content: float = 6.0
    #: for blocks outside it, where a page has an article or main element
    out_of_content: float = -4.0
    named_content: float = 2.0
    in_boilerplate: float = -16.0
    heading: float = 1.0
    length: float = 1.2
    short: float = -0.8
    sentence: float = 0.8
    links: float = -5.0
    next_to: float = 1.0
    same_container: float = 1.0


_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class _Element:
    tag: str
    depth: int
    path: int  # number of the element in the page
    parent: "_Element | None"
    content: bool
    named: bool
    boilerplate: bool
    unseen: bool


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    heading: bool
    place: _Element


def _attributes(found: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(found)} if found else {}


def blocks(page: str) -> list[Block]:
    root = _Element("", 0, 0, None, False, False, False, False)
    stack, open_tags = [root], {}
    out: list[Block] = []
    text: list[str] = []
    linked, links, count = 0, 0, 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            place = stack[-1]
            out.append(Block(joined, linked, place.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), place))
        text.clear()
        linked = 0

    def close() -> None:
        nonlocal links
        gone = stack.pop()
        open_tags[gone.tag] -= 1
        links -= gone.tag == "a"

    while at < n:
        start = page.find("<", at)
        if start != at:
            piece = page[at:start] if start >= 0 else page[at:]
            if not stack[-1].unseen:
                piece = html.unescape(piece) if "&" in piece else piece
                text.append(piece)
                if links > 0:
                    linked += len(piece)
            if start < 0:
                break
            at = start
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            cdata = page.startswith("<![CDATA[", at)
            end = page.find("]]>" if cdata else ">", at)
            at = n if end < 0 else end + (3 if cdata else 1)
            continue
        found = _TAG.match(page, at) or _LOOSE_TAG.match(page, at)
        if not found:
            if re.match(r"</?[a-zA-Z]", page[at:at + 3]):
                break  # a tag that never ends holds no text
            if page.startswith("</", at):
                end = page.find(">", at)
                at = n if end < 0 else end + 1
                continue
            if not stack[-1].unseen:
                text.append("<")
            at += 1
            continue
        at = found.end()
        tag = found[2].lower()
        if tag in BLOCK_TAGS:
            flush()
        if found[1]:
            if open_tags.get(tag):
                while stack[-1].tag != tag:
                    close()
                close()
            continue
        if tag in VOID_TAGS:
            continue
        if tag in RAW_TAGS:
            end = re.compile(f"</{tag}(?![a-z0-9])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        for ended in SELF_ENDING.get(tag, "").split():
            if stack[-1].tag == ended:
                close()
        if tag in BLOCK_TAGS and stack[-1].tag == "p":
            close()
        names = _attributes(found[3])
        words = f"{names.get('class', '')} {names.get('id', '')}".lower()
        parent = stack[-1]
        boiler = tag in BOILERPLATE_TAGS and not (tag == "header" and parent.content)
        boiler = boiler or names.get("role", "").lower() in BOILERPLATE_ROLES
        outer = tag in ("html", "body") or tag in CONTENT_TAGS and "comment" not in words
        boiler = boiler or not outer and words.strip() != "" and BOILERPLATE_NAMES.search(words) is not None
        count += 1
        open_tags[tag] = open_tags.get(tag, 0) + 1
        links += tag == "a"
        stack.append(_Element(
            tag, parent.depth + 1, count, parent,
            parent.content or tag in CONTENT_TAGS or names.get("role", "").lower() in ("main", "article"),
            parent.named or words.strip() != "" and CONTENT_NAMES.search(words) is not None,
            parent.boilerplate or boiler,
            parent.unseen or tag in UNSEEN_TAGS or "hidden" in names or names.get("aria-hidden", "").lower() == "true"
            or "style" in names and _UNSEEN_STYLE.search(names["style"]) is not None))
    flush()
    return out


_sentence = re.compile(r"[.!?…。！？][\"'»”)]?(?:\s|$)|,\s")


def evidence(block: Block, marked: bool, w: Weights) -> float:
    """``marked``: whether the page has an article or main element with text in it."""
    place, n = block.place, len(block.text)
    score = w.any_block + (w.in_content if place.content else w.out_of_content * marked)
    score += w.named_content * place.named + w.in_boilerplate * place.boilerplate
    score += w.heading * block.heading
    score += w.length if n >= 80 else w.short if n < 25 else 0.0
    score += w.sentence * (_sentence.search(block.text) is not None)
    return score + w.links * min(1.0, block.linked / n)


def _tree_distance(a: _Element, b: _Element, most: int = 8) -> int:
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth:
            a = a.parent or a
        else:
            b = b.parent or b
        steps += 1
    return steps


def ties(found: list[Block], w: Weights) -> list[tuple[int, int, float]]:
    """Edges between successive blocks, and between a block and the one before it in the same container."""
    out, last = [], {}
    for i, block in enumerate(found):
        if i:
            out.append((i - 1, i, w.next_to / (1 + _tree_distance(found[i - 1].place, block.place))))
        container = block.place.parent.path if block.place.parent else 0
        before = last.get(container)
        if before is not None:
            out.append((before, i, w.same_container))
        last[container] = i
    return out


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it lies on the source's side of a minimum cut. A positive gain is the capacity from the
    source, a negative one the capacity to the sink; edges hold in both directions. Flow is sent along shortest
    paths, level by level, until no path is left."""
    n = len(gain)
    if all(g >= 0 for g in gain):
        return [True] * n
    if all(g <= 0 for g in gain):
        return [False] * n
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        at[a].append(len(to))
        at[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, g in enumerate(gain):
        if g > 0:
            join(source, i, g, 0.0)
        elif g < 0:
            join(i, sink, -g, 0.0)
    for a, b, c in edges:
        join(a, b, c, c)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        line = [source]
        for a in line:
            for e in at[a]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    line.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= least)
                a = to[path[cut] ^ 1]
                del path[cut:]
            while turn[a] < len(at[a]):
                e = at[a][turn[a]]
                if room[e] > least and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                    break
                turn[a] += 1
            else:
                if a == source:
                    break
                a = to[path.pop() ^ 1]
                turn[a] += 1


def main_text(page: str | None, w: Weights = Weights()) -> str:
    found = blocks(page) if page else []
    marked = any(b.place.content and not b.place.boilerplate for b in found)
    content = minimum_cut([evidence(b, marked, w) for b in found], ties(found, w)) if found else []
    return "\n".join(b.text for b, keep in zip(found, content) if keep)


def extract(pages: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """The rows of ``pages`` with ``text`` and ``n_chars`` (code points) in the place of ``html``."""
    @F.pandas_udf("text string, n_chars long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    return pages.withColumn("html", run(F.col("html").cast("string"))).select(*kept, "html.*")
