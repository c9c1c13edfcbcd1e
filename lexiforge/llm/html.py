"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text; scripts, styles and what is hidden are no lines at all. A
line weighs as much as it has text outside links, and nothing in a part that is never article: menus, headers,
footers, sidebars, forms, adverts, notices and reader comments, known by their elements, roles and class or id
words. Empty lines stand around such parts and where the outer container changes. The weights are summed over
sliding windows of lines: where the sums surge above the threshold a text begins, and where they dive to nothing it
ends; of these texts the one with most weight is the main one. All lines between its surge and its dive are kept, however
short, and with them those that share its container, an article, a main part or a division, so that a short first
paragraph or what follows an advert inside an article isn't lost. That container is the article or main part that
holds most of the winning text; without one it is the innermost container, widened as long as there is more long
text beside it, to the whole page only if it is one paragraph or not most of the text.

Names can mislead. A class or id word isn't believed on a part that holds the page's first article or main part; a
word that articles have too (a notice, a share bar, related matter), and a form, mark a part only as long as it has less
than half of the text.

Null or empty html, or a page without text: an empty text. A page without a surge: all lines outside marked parts.
Pages are handled one by one, so repeated rows get equal results. Of two texts of the same weight the first one wins. Only ``page_id``,
``url`` and ``html`` are read, so further columns cannot clash.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import table

WINDOW = 3
SURGE = 60

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "title", "xmp"}
_BOILERPLATE = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "figure"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "base", "col", "embed", "source", "track", "wbr", "area", "param"}
_BLOCKS = {"p", "div", "article", "main", "section", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "blockquote", "pre", "address", "header", "hgroup", "figcaption", "details", "summary", "fieldset", "center", "body", "html"} | _BOILERPLATE
_CONTAINERS = {"article", "main", "section", "div", "body", "html", "td", "blockquote"}
_ARTICLES, _PAGE = {"article", "main"}, {"body", "html"}
_CLOSES_P = _BLOCKS - {"html", "body"}
_BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
_BAD_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer foot masthead topbar toolbar comment comments disqus respond cookie cookies consent gdpr popup modal newsletter subscribe signup login pagination pager".split())
_VAGUE_WORDS = set("banner promo promotion promotions reply replies notice notices overlay subscription share sharing social related recommended widget copyright legal".split())
HARD, NAMED, VAGUE = 1, 2, 3
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Line:
    """A block of text."""

    text: str
    linked: int  # characters of it in links
    around: tuple[tuple[int, str], ...]  # numbers and tags of its containers, outermost first
    marks: tuple[int, ...]  # numbers of the marked parts that it lies in


def _hidden(attributes: str) -> bool:
    if "hidden" in attributes and ("hidden" in attributes.split() or re.search(r"aria-hidden\s*=\s*[\"']?true|visibility\s*:\s*hidden", attributes)):
        return True
    return "none" in attributes and bool(re.search(r"display\s*:\s*none", attributes))


def _mark(tag: str, attributes: str, inside_article: bool) -> int:
    """How sure it is that the element is never article, 0: not at all."""
    if tag == "form":
        return VAGUE
    if tag in _BOILERPLATE and tag != "figure":
        return HARD
    if tag == "header":
        return 0 if inside_article else HARD
    found = 0
    for name, value in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in _BAD_ROLES:
            return HARD
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            words = set(_WORDS.findall(value))
            found = NAMED if words & _BAD_WORDS else found or (VAGUE if words & _VAGUE_WORDS else 0)
    return found


def lines_of(html: str) -> tuple[list[Line], dict[int, int]]:
    """The blocks of text, marked ones too, and how sure each marked part is."""
    lower, lines, buffer = None, [], []
    stack: list[tuple[str, int, int, bool]] = []  # tag, number of a container or 0, number of a marked part or 0, hidden
    marks: dict[int, int] = {}
    hidden = number = position = article = linked = 0
    seen_article = False

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", entities.unescape("".join(t for t, _ in buffer))).strip()
            in_links = sum(len(_SPACE.sub(" ", entities.unescape(t)).strip()) for t, own in buffer if own)
            buffer.clear()
            if text:
                lines.append(Line(text, min(in_links, len(text)), tuple((n, t) for t, n, _, _ in stack if n), tuple(m for _, _, m, _ in stack if m)))

    def pop() -> None:
        nonlocal hidden, article, linked
        tag, _, _, is_hidden = stack.pop()
        hidden -= is_hidden
        article -= tag in ("article", "main")
        linked -= tag == "a"

    while position < len(html):
        match = _TOKEN.search(html, position)
        end_of_text = len(html) if match is None else match.start()
        if end_of_text > position and not hidden:
            buffer.append((html[position:end_of_text], linked > 0))
        if match is None:
            break
        position = match.end()
        tag = (match[3] or "").lower()
        if not tag:
            if match[1] and not hidden:
                buffer.append((entities.escape(match[1]), linked > 0))
            continue
        if match[2]:  # an end tag: closes down to its start, if that is open
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag in _BLOCKS:
                flush()
            if at is not None:
                while len(stack) > at:
                    pop()
            continue
        if tag == "br":
            buffer.append((" ", False))
            continue
        if tag in _VOID or match[4].endswith("/"):
            if tag == "hr":
                flush()
            continue
        if tag in _RAW:
            if lower is None:
                lower = html.lower() if len(html.lower()) == len(html) else re.sub("[A-Z]", lambda m: m[0].lower(), html)
            end = lower.find(f"</{tag}", position)
            position = len(html) if end < 0 else end
            close = html.find(">", position)
            position = len(html) if end < 0 or close < 0 else close + 1
            continue
        if tag in _BLOCKS:
            flush()
            if tag in _CLOSES_P:  # a block ends an open paragraph, and what is left open in it
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p" or stack[i][0] in _CONTAINERS), None)
                if at is not None and stack[at][0] == "p":
                    while len(stack) > at:
                        pop()
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
                pop()
        mark, is_hidden = _mark(tag, match[4], article > 0), _hidden(match[4])
        number += 1
        if mark:
            marks[number] = mark
        if tag in _ARTICLES and not seen_article and not any(marks.get(m) == HARD for _, _, m, _ in stack):
            seen_article = True
            marks.update({m: 0 for _, _, m, _ in stack if m})
        stack.append((tag, number if tag in _CONTAINERS else 0, number if mark else 0, is_hidden))
        hidden += is_hidden
        article += tag in _ARTICLES
        linked += tag == "a"
    flush()
    return lines, marks


def weights(lines: list[Line], marks: dict[int, int]) -> list[int | None]:
    """Text outside links of each line; None in parts that are never article."""
    sure = [any(marks[m] in (HARD, NAMED) for m in line.marks) for line in lines]
    if all(sure):
        sure = [any(marks[m] == HARD for m in line.marks) for line in lines]
    plain = [len(line.text) - line.linked for line in lines]
    total = sum(w for w, s in zip(plain, sure, strict=True) if not s)
    held: dict[int, int] = {}
    for line, w, s in zip(lines, plain, sure, strict=True):
        for m in line.marks:
            if marks[m] == VAGUE and not s:
                held[m] = held.get(m, 0) + w
    vague = {m for m, w in held.items() if 2 * w < total}
    return [None if s or vague & set(line.marks) else w for line, w, s in zip(lines, plain, sure, strict=True)]


def surges(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first, after last) of the runs of lines from a surge of the windowed sums to the next dive."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    found, start = [], None
    for i, total in enumerate(sums):
        if start is None and total > surge:
            start = i
        elif start is not None and total == 0:
            found.append((start, i))
            start = None
    return found + ([(start, len(sums))] if start is not None else [])


def _article(around: tuple[tuple[int, str], ...]) -> tuple[int, str] | None:
    """The innermost article or main part of a line."""
    return next((c for c in reversed(around) if c[1] in _ARTICLES), None)


def _home(lines: list[Line], picked: list[int], surge: int) -> set[int]:
    """Lines that belong with the picked ones; lines: without those of marked parts."""
    inside: dict[tuple[int, str], list[int]] = {}
    for i, line in enumerate(lines):
        for c in line.around:
            inside.setdefault(c, []).append(i)
    size = lambda rows: sum(len(lines[i].text) for i in rows)
    chosen = set(picked)
    held = {c: size(chosen & set(inside[c])) for c in {c for i in picked for c in lines[i].around if c[1] in _ARTICLES}}
    most = [c for c, n in held.items() if 2 * n > size(picked)]
    if most:
        return set(inside[max(most)])  # numbers grow inwards
    weight: dict[tuple[int, str], int] = {}
    for i in picked:
        for c in lines[i].around[-1:]:
            weight[c] = weight.get(c, 0) + len(lines[i].text)
    if not weight:
        return set()
    home = max(weight, key=lambda c: (weight[c], -c[0]))
    around = lines[inside[home][0]].around
    path = list(around[: around.index(home)])
    long = {i for i, line in enumerate(lines) if len(line.text) - line.linked > surge}
    for parent in reversed(path if home[1] not in _PAGE else []):
        if parent[1] in _PAGE:
            break
        if len(inside[home]) == 1 or long & set(inside[parent]) - set(inside[home]):
            home = parent
    own = set(inside[home])
    if home[1] not in _PAGE and long - own and (len(own) == 1 or 2 * size(long & own) <= size(long)):
        return own | set(range(min(long), max(long) + 1))
    return own


def spread(lines: list[Line], weight: list[int | None], window: int = WINDOW) -> list[int | None]:
    """Indexes of the lines, with empty lines (None) around marked parts and between containers, where the sums can dive, but not within an article."""
    out: list[int | None] = []
    for i, line in enumerate(lines):
        around, before = line.around, lines[i - 1].around if i else ()
        same = _article(around) is not None and _article(around) == _article(before)
        if weight[i] is None or i and (weight[i - 1] is None or not same and around[-1:] != before[-1:] and not set(around[-1:]) & set(before) and not set(before[-1:]) & set(around)):
            out += [None] * window
        out.append(i)
    return out


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    lines, marks = lines_of(html or "")
    weight = weights(lines, marks)
    order = spread(lines, weight, window)
    lengths = [0 if i is None else weight[i] or 0 for i in order]
    found = surges(lengths, window, surge)
    if not found:
        return "\n\n".join(line.text for line, w in zip(lines, weight, strict=True) if w is not None)
    a, b = max(found, key=lambda r: (sum(lengths[r[0] : r[1]]), -r[0]))
    picked = [i for i in order[a:b] if i is not None]
    open_lines = [i for i, w in enumerate(weight) if w is not None]
    place = {i: n for n, i in enumerate(open_lines)}
    home = _home([lines[i] for i in open_lines], [place[i] for i in picked if i in place], surge)
    return "\n\n".join(lines[i].text for i in sorted({open_lines[n] for n in home} | set(picked)))


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, text, n_chars (code points of the text), a row per page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h, window, surge) for h in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
