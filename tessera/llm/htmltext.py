"""Main text of HTML pages by a maximum-scoring token subsequence.

Words score positive and tags negative, with weights learned from labelled pages: pages that mark their content with an
``article`` or ``main`` element. A word's weight is the sum of two log-odds, those of its container and class and those of its
context (paragraph, link, item, bare text), so that menus, notices and footers count against a region also on pages whose classes
tell nothing; a tag's cost grows with the log-odds of standing outside the content. One linear scan finds the best contiguous
region; boilerplate elements inside it (adverts, forms, asides, comments ...) are then left out. An element is boilerplate by its
name, by a class, id or role made of nothing but such words ("cookie-notice", not "search-term"), or by a class that the
labelled pages have hardly anywhere but outside their content; elements of any other kind are text. A form that holds the
page's body is none, and labels in the content are text.

Tags are found in one pass that is linear in the page, whatever quotes and brackets are broken.

Handling of odd input: a null or empty page gives empty text, as does one without words; unclosed and stray tags are
tolerated; very long pages are read whole; of two equal regions the first wins; repeated rows each get a row; an empty table
gives an empty result; columns not named in ``carry`` are ignored.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Expected labelled pages to learn from (all where there are fewer).
SAMPLE_PAGES = 2000
#: Elements whose content is no markup.
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "noscript", "template", "iframe", "textarea", "select")}
_STOP = re.compile("[\"'>]")
_BODY = re.compile(r"<(?:article|main|p)\b", re.I)
_FORM_END = re.compile(r"</form\b", re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\s(?:hidden(?=[\s>=/])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
CONTAINERS = {"html", "body", "main", "article", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "figure", "blockquote", "dialog", "menu", "head", "details", "fieldset"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "caption", "figcaption", "pre", "hr", "title", "address", "legend", "summary", "thead", "tbody", "tfoot", "option"}
SPACES = {"br", "td", "th", "wbr"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Elements and class, id or role words of what is not main text.
BOILER_TAGS = {"head", "title", "nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "label"}
BOILER_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "adsense", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "footer", "masthead", "cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "disqus", "replies", "respond", "toolbar", "pagination", "pager", "search", "copyright", "complementary", "contentinfo", "alert"}
#: Words that may stand beside those in the name of such a class.
FILLER = {"", "box", "bar", "banner", "block", "section", "wrapper", "wrap", "container", "content", "list", "post", "posts", "link", "links", "button", "buttons", "form", "panel", "area", "site", "page", "top", "bottom", "left", "right", "main", "primary", "secondary", "inline", "unit", "slot", "item", "items", "group", "icons", "media", "the", "and", "js", "is"}
#: Log-odds of a class below which the labelled pages tell that it is boilerplate.
OUTSIDE = -3.0
#: Most that a word may count for or against a region.
MOST = 6.0
#: Elements that tell what a word stands in: a paragraph, a link, an item ...
CONTEXTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "a", "td", "th", "dt", "dd", "figcaption", "caption", "pre"}
#: Elements whose start ends an open one of the same name.
SIBLINGS = {"li", "dt", "dd", "tr", "td", "th", "option"}


def _classes(tag: str) -> tuple[str, ...]:
    return tuple(sorted({w for m in _ATTR.finditer(tag) for w in (m[2] or m[3] or m[4] or "").lower().split()}))


@functools.lru_cache(100_000)
def _is_boiler_class(name: str) -> bool:
    words = re.split(r"[^a-z]+", name)
    return any(w in BOILER_WORDS for w in words) and all(w in BOILER_WORDS or w in FILLER for w in words)


def _boiler(name: str, tag: str, classes: tuple[str, ...], inside: bool, weights: dict[str, float]) -> bool:
    if name in ("html", "body", "main"):
        return False
    if name == "article":
        return any(_is_boiler_class(c) for c in classes)
    if (name in BOILER_TAGS and not (name == "label" and inside)) or _HIDDEN.search(tag) or (not inside and (name == "header" or "header" in classes)):
        return True
    return any(_is_boiler_class(c) or weights.get("c" + c, 0.0) <= OUTSIDE for c in classes)


def pieces(page: str):
    """(start, text, whether it is a tag) of each run of text and each tag in order, without comments, declarations and raw elements.

    One pass: a quote that is never closed is looked at once, however many broken tags come before it.
    """
    at, n, dead, no_end = 0, len(page), set(), False
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or no_end:
            yield at, page[at:], False
            return
        if lt > at:
            yield at, page[at:lt], False
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        declared = page.startswith(("<!", "<?"), lt)
        name = None if declared else _NAME.match(page, lt)
        if not declared and not name:
            yield lt, "<", False
            at = lt + 1
            continue
        end, k, path = -1, name.end() if name else lt, []
        while name:  # to the first > that no quotes hold
            m = _STOP.search(page, k)
            if not m or m.start() in dead:
                dead.update(path)
                break
            if m[0] == ">":
                end = m.start()
                break
            path.append(m.start())
            k = page.find(m[0], m.end()) + 1
            if not k:
                dead.update(path)
                break
        if end < 0:
            end = page.find(">", lt)
        if end < 0:
            no_end = True  # no tag ends any more: the rest is text
            at = lt
            continue
        tag, at = page[lt : end + 1], end + 1
        if declared:
            continue
        raw = RAW.get(name[1].lower()) if tag[1] != "/" else None
        if raw:
            close = raw.search(page, at)
            at = close.end() if close else n
        else:
            yield lt, tag, True


def _page_forms(page: str):
    """Whether the form that begins at a place holds a page's body, an article, a main element or two paragraphs, as those of
    some servers do, and so is no form to fill in."""
    body, ends = [m.start() for m in _BODY.finditer(page)], [m.start() for m in _FORM_END.finditer(page)]
    marked = [m.start() for m in re.finditer(r"<(?:article|main)\b", page, re.I)]

    def holds(at: int) -> bool:
        k = bisect.bisect(ends, at)
        stop = ends[k] if k < len(ends) else len(page)
        inside = lambda places: bisect.bisect(places, stop) - bisect.bisect(places, at)
        return inside(marked) > 0 or inside(body) > 1

    return holds


def tokens(page: str, weights: dict[str, float]):
    """(kind, text, feature, classes, in_article, boilerplate, context) of each token; kind is "w" (words) or "t" (a tag)."""
    stack: list[tuple] = []  # name, signature, the nearest classes, inside marked content, boilerplate here or above
    opened: Counter = Counter()
    around: list[str] = []  # the contexts that are open; '' where a container begins
    holds = _page_forms(page)
    for at, t, is_tag in pieces(page):
        top = stack[-1] if stack else ("", "", (), False, False)
        if not is_tag:
            yield "w", t, *top[1:], around[-1] if around else ""
            continue
        name = _NAME.match(t)[1].lower()
        if t[1] == "/":
            depth = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name) if opened[name] else None
            if depth is not None:
                top = stack[depth]
                opened.subtract(x[0] for x in stack[depth:])
                del stack[depth:]
                while around and around.pop():
                    pass
            elif around and around[-1] == name:
                around.pop()
            yield "t", name, f"/{top[1] if depth is not None else name}", top[2], top[3] and name not in ("article", "main"), top[4], ""
            continue
        if name in CONTEXTS and not (name == "a" and around and around[-1] not in ("", "a", "li")):  # a link in a paragraph is part of it
            if around and (around[-1] == name or (around[-1] == "p" and name != "a")):
                around.pop()  # its end tag may be left out
            around.append(name)
        if stack and ((top[0] == "p" and name in BLOCKS) or (top[0] == name and name in SIBLINGS)):
            opened[stack.pop()[0]] -= 1  # its end tag may be left out
            top = stack[-1] if stack else ("", "", (), False, False)
        classes = _classes(t)
        boiler = top[4] or (not (name == "form" and holds(at)) and _boiler(name, t, classes, top[3], weights))
        if (name in CONTAINERS or (boiler and not top[4])) and name not in VOID and not t.endswith("/>"):
            sign = " ".join([name, *classes][:4])
            opened[name] += 1
            around.append("")
            stack.append((name, sign, classes or top[2], top[3] or (name in ("article", "main") and not boiler), boiler))
            yield "t", name, sign, classes or top[2], top[3], boiler, ""
        else:
            yield "t", name, name, top[2], top[3], boiler, ""


def _learn(batches):
    for batch in batches:
        n: dict[tuple[str, bool], int] = {}
        for page in batch.column(0):
            for kind, text, feature, classes, inside, boiler, context in tokens(page.as_py() or "", {}):
                many = len(text.split()) if kind == "w" else 1
                for k in (kind + feature, *(["x" + context, *["c" + c for c in classes]] if kind == "w" else [])):
                    n[k, inside and not boiler] = n.get((k, inside and not boiler), 0) + many
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.bool_()), pa.array(list(n.values()), pa.int64())], ["feature", "inside", "n"])


def learn_weights(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> dict[str, float]:
    """Log-odds of each feature between content and the rest of the labelled pages, within +-6."""
    labelled = pages.select(F.col(html_col).cast("string").alias("h")).where(F.col("h").rlike(r"(?i)<(article|main)[\s>]"))
    n = labelled.count()
    chosen = labelled.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample_pages / max(1, n)) * (1 << 30))))
    counts = chosen.mapInArrow(_learn, "feature string, inside boolean, n long").groupBy("feature").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o"))
    return {f: max(-6.0, min(6.0, math.log((i + 0.5) / (o + 0.5)))) for f, i, o in counts.where("i + o >= 5").collect()}


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and stop of the contiguous run of the greatest sum, in one scan; the first of equals, empty where none is positive."""
    best, run, start = (0.0, 0, 0), 0.0, 0
    for at, score in enumerate(scores):
        run += score
        if run <= 0:
            run, start = 0.0, at + 1
        elif run > best[0]:
            best = (run, start, at + 1)
    return best[1], best[2]


def score(kind: str, text: str, feature: str, boiler: bool, context: str, weights: dict[str, float]) -> float:
    """A word's score is the sum of what its container and its context say, positive where the pages say nothing; that of a
    tag is negative, the more so the less its like stands in content."""
    if boiler:
        return 0.0  # left out of the text wherever the region ends, so it counts for nothing
    if kind == "w":
        told = [weights[k] for k in ("w" + feature, "x" + context) if k in weights]
        return max(-MOST, min(MOST, sum(told))) * len(text.split()) if told else 1.0 * len(text.split())
    return -0.2 - max(0.0, -weights.get("t" + feature, 0.0))


def main_text(page: str | None, weights: dict[str, float]) -> str:
    seen = list(tokens(page or "", weights))
    first, stop = best_region([score(kind, text, feature, boiler, context, weights) for kind, text, feature, _, _, boiler, context in seen])
    blocks, now = [], []

    def close():
        line = " ".join(html.unescape("".join(now)).split())
        if line:
            blocks.append(line)
        now.clear()

    for kind, text, _, _, _, boiler, _ in seen[first:stop]:
        if kind == "t":
            if text in BLOCKS:
                close()
            elif text in SPACES:
                now.append(" ")
        elif not boiler:
            now.append(text)
    close()
    return "\n\n".join(blocks)


def _extract(weights: dict[str, float]):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(1, batch.num_columns)], pa.array([main_text(p.as_py(), weights) for p in batch.column(0)], pa.string())], [*batch.schema.names[1:], "text"])

    return run


def extract_text(pages: DataFrame, weights: dict[str, float], html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Rows (*carry, text): the main text, its blocks joined by an empty line."""
    rows = pages.select(F.col(html_col).cast("string").alias("h"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(carry)])
    schema = ", ".join([*[f"x{i} {rows.schema[f'x{i}'].dataType.simpleString()}" for i in range(len(carry))], "text string"])
    return rows.mapInArrow(_extract(weights), schema).select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(carry)], "text")
