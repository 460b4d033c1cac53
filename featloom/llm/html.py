"""HTML extraction: the best contiguous region of words against tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements and of what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split(),
)
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav object ol optgroup option p "
    "pre search section select summary svg table tbody td tfoot th thead tr ul video audio canvas".split(),
)
BOILERPLATE = frozenset(
    "aside button canvas dialog fieldset footer form head menu nav object search select svg video audio".split(),
)
BOILERPLATE_NAMES = frozenset(
    "ad ads adsbygoogle advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notification pager pagination paywall popup promo promotion recommended related replies reply respond share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar widget".split(),
)
BOILERPLATE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split(),
)
#: Elements that mark a region, and how closely.
REGIONS = {"main": 1, "article": 2}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_BROKEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Weights:
    """Scores of tokens.  ``plain`` scores a word, ``link`` a word in a link, ``boilerplate`` a
    word in an element that is not the article; ``tags`` score tags by name, others ``tag``.
    In a marked region, links are text, boilerplate is skipped at no cost, and a tag costs
    ``marked``."""

    plain: float = 1.0
    link: float = -0.5
    boilerplate: float = -4.0
    tag: float = -0.2
    marked: float = -0.01
    tags: dict[str, float] = field(default_factory=dict)


def _is_boilerplate(name: str, attributes: str, inside: bool) -> bool:
    if name in BOILERPLATE or (name == "header" and not inside):
        return True
    if not attributes or name in ("html", "body", *REGIONS):
        inside = True  # names of whole pages and regions say little
    for key, *values in _NAMES.findall(attributes) if attributes else ():
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value in BOILERPLATE_ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body", "main"):
            parts = set(re.split(r"[^a-z]+", value))
            if parts & BOILERPLATE_NAMES or (not inside and "header" in parts):
                return True
    return False


Token = tuple[str, str, str, int]


def tokens(page: str) -> Iterator[Token]:
    """Tokens of a page in order: kind, text or name of the element, context, and level.

    The kind is "text", "tag", or "border" for the tags of an element that marks a region (one
    inside another of its kind marks none).  The context is "plain", "link" or "boilerplate",
    the level 0 outside of all regions.  Comments, declarations and the contents of scripts,
    styles and the like yield nothing; what looks like a tag in them is text.
    """
    stack: list[tuple[str, str, int]] = [("", "plain", 0)]
    pending: Counter = Counter()  # elements of the stack by name
    at = 0
    while at < len(page):
        mark = page.find("<", at)
        if mark < 0:
            mark = len(page)
        if mark > at:
            yield "text", page[at:mark], *stack[-1][1:]
        if mark == len(page):
            return
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), mark):
            end = page.find(">", mark)
            at = len(page) if end < 0 else end + 1
            continue
        tag = _TAG.match(page, mark) or _BROKEN_TAG.match(page, mark)
        if tag is None:
            if re.compile(r"</?[a-zA-Z]").match(page, mark):
                return  # a tag that the end of the page cuts off
            yield "text", "<", *stack[-1][1:]
            at = mark + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            _, context, level = stack[-1]
            if pending[name]:
                while stack[-1][0] != name:
                    pending[stack.pop()[0]] -= 1
                _, context, level = stack.pop()
                pending[name] -= 1
            yield "border" if level > stack[-1][2] else "tag", name, context, level
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "tag", name, "boilerplate", stack[-1][2]
            continue
        if name in BLOCK:
            while pending["p"]:  # a new block ends a paragraph
                pending[stack.pop()[0]] -= 1
        _, context, level = stack[-1]
        if context != "boilerplate":
            context = "boilerplate" if _is_boilerplate(name, tag[3], level > 0) else "link" if name == "a" else context
        inner = max(level, REGIONS.get(name, 0)) if context != "boilerplate" else level
        yield "border" if inner > level else "tag", name, context, inner
        if name not in VOID and not tag[3].rstrip().endswith("/"):
            stack.append((name, context, inner))
            pending[name] += 1


def best_region(page: str, weights: Weights) -> list[Token]:
    """Tokens of the contiguous region with the highest sum of scores, by one scan.

    The region does not cross the border of a marked one.  If it lies in a marked element, the
    best regions of the other elements that are marked alike belong to it, as far as the
    weights of unmarked pages call them text: several articles of a page are one text, a list of
    links in an article of its own is not.
    """
    found = list(tokens(page))
    regions: list[tuple[float, int, int]] = []
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, value, context, level) in enumerate(found):
        if kind == "border":
            score = -math.inf
        elif context == "boilerplate" and level:
            score = 0.0
        elif kind == "text":
            score = (weights.plain if level else getattr(weights, context)) * len(_WORD.findall(value))
        else:
            score = weights.marked if level else weights.tags.get(value, weights.tag)
        total += score
        if kind == "border":
            regions.append((best, *span))
            best, span = 0.0, (0, 0)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    regions.append((best, *span))
    top = max(regions, key=lambda r: r[0])
    if not top[0]:
        return []
    level = found[top[1]][3]
    if not level:
        return found[slice(*top[1:])]
    alike = [r for r in regions if r[0] and found[r[1]][3] == level and (r is top or _unmarked(found[slice(*r[1:])], weights) > 0)]
    return [token for _, low, high in alike for token in [*found[low:high], ("border", "article", "plain", level)]]


def _unmarked(region: list[Token], weights: Weights) -> float:
    """Score of a region as if it were not marked."""
    score = 0.0
    for kind, value, context, _ in region:
        if context != "boilerplate":
            words = getattr(weights, context) * len(_WORD.findall(value))
            score += words if kind == "text" else weights.tags.get(value, weights.tag)
    return score


def main_text(page: str | None, weights: Weights) -> str:
    """Text of the best region without boilerplate inside it: one line per block."""
    blocks, parts = [], []
    for kind, value, context, _ in [*best_region(page or "", weights), ("tag", "p", "", 0)]:
        if kind == "text":
            if context != "boilerplate":
                parts.append(value)
        elif value == "br":
            parts.append(" ")
        elif value not in INLINE and parts:
            blocks.append(_SPACE.sub(" ", html.unescape("".join(parts))).strip("\x20\t\n\v\f\r"))
            parts = []
    return "\n".join(b for b in blocks if b)


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens by kind, inside and outside the one article of labelled pages."""
    counts: Counter = Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            for kind, value, context, level in tokens(page or ""):
                inside = level == REGIONS["article"]
                if kind == "text":
                    counts[f"word {context}", inside] += len(_WORD.findall(value))
                elif kind == "tag" and (value in BLOCK or value in INLINE or value in RAW):
                    counts[f"tag {value}", inside] += 1
    names, inside = [k for k, _ in counts], [i for _, i in counts]
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array(inside, pa.bool_()), pa.array(list(counts.values()), pa.int64())],
        ["token", "inside", "count"],
    )


def learn_weights(pages: DataFrame, *, html_column: str = "html", sample: int = 2000) -> Weights:
    """Weights from labelled pages: those that mark their article with one ``article`` element.

    A token scores the logarithm of its odds to stand inside the article, words at least 0.5
    and tags from -5 to -0.1.  About ``sample`` pages are read, chosen by the hash of the page;
    counts are few, one per known element.  Without labelled pages the defaults hold.
    """
    share = max(1, -(-pages.count() // sample))
    body = F.col(f"`{html_column}`")
    labelled = pages.where(F.pmod(F.xxhash64(body), F.lit(share)) == 0)
    labelled = labelled.where((F.regexp_count(body, F.lit("(?i)<article")) == 1) & F.lower(body).contains("</article"))
    counts = labelled.select(body.alias("html")).mapInArrow(_count_tokens, "token string, inside boolean, count long")
    total = {(r.token, r.inside): r.n for r in counts.groupBy("token", "inside").agg(F.sum("count").alias("n")).collect()}
    if not total:
        return Weights()

    def odds(token: str) -> float:
        return math.log((total.get((token, True), 0) + 1) / (total.get((token, False), 0) + 1))

    known = {token for token, _ in total}
    default = Weights()
    return Weights(
        plain=max(0.5, odds("word plain")),
        link=min(default.link, odds("word link")) if "word link" in known else default.link,
        boilerplate=min(default.boilerplate, odds("word boilerplate")),
        tag=default.tag,
        tags={t.removeprefix("tag "): max(-5.0, min(-0.1, odds(t))) for t in known if t.startswith("tag ")},
    )


def extract_text(
    pages: DataFrame,
    weights: Weights,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """Main text of every page: ``page_id``, ``url``, ``text`` and ``n_chars`` (code points).

    Words of the article score for its region and tags against it; the best contiguous region
    is found by one scan of the whole page.  Boilerplate inside it is left out, character
    references are decoded, white space in a block becomes one space, and blocks are joined by
    line breaks.  A null or empty page gives an empty text; so does a page without words
    outside boilerplate.  Repeated rows are extracted each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column("html").to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.col(f"`{html_column}`").cast("string").alias("html"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
