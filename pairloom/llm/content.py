"""Main text of web pages: the maximum-scoring run of tokens.

A page is a sequence of words and tags. Words score positive and tags negative, by weights that are
counted on pages whose article is marked; the contiguous run with the largest sum is the content
region, found in one scan. Elements that are never content - menus, adverts, forms, comments and the like,
by their tag or the names they carry - cost one fixed step and give no text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.columns import carried, restored
from pairloom.llm.tokens import strings

# Bound of the sample of pages that weights are counted on, if they mark their article.
TRAIN_PAGES = 2000
# Weights where no page marks its article, and of tags that such pages do not have.
DEFAULT_WORD, DEFAULT_TAG = 1.0, -0.3
# Limits of learned weights: one word outweighs the tags of its paragraph, and a border tag many words.
WORD_LIMITS, TAG_LIMITS = (0.5, 2.0), (-10.0, -0.05)
# Crossing an element that is never content.
SKIPPED = -3.0

# Names of HTML.
_SKIPPED_TAGS = frozenset(
    "head title script style noscript template iframe object svg canvas audio video nav footer aside form "
    "button select option textarea input label fieldset datalist dialog menu".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noscript template svg".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
_NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices alert sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "comment comments respond discussion disqus share sharing social related recommended newsletter subscribe "
    "subscription popup modal overlay login signup search widget toolbar pagination pager skip".split()
)
# Names of several words that are told by all of them; others, as "no-sidebar" or "comments-open", tell of the layout.
_COMPOUNDS = frozenset(
    "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper google-ads breadcrumb-nav cookie-banner cookie-bar cookie-consent "
    "cookie-notice comment-form comment-list comment-respond comments-area comments-list comments-section disqus-thread "
    "login-form main-menu main-nav main-navigation modal-dialog nav-bar nav-links nav-menu site-nav site-navigation newsletter-form "
    "newsletter-signup page-footer site-footer site-header post-navigation promo-banner related-articles related-posts search-box "
    "search-form left-sidebar right-sidebar primary-sidebar share-buttons share-links social-icons social-links social-share "
    "sharing-buttons skip-link top-nav widget-area".split()
)
_NEVER = _NAMED | _COMPOUNDS
# Parts of the article may carry these tags without being left out.
_ARTICLE = frozenset(("article", "main"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[\"'>]")
# Attributes with their values, in turn: what stands inside a value is no attribute. Quotes without a name are passed over.
_ATTRIBUTE = re.compile(r"\"[^\"]*\"|'[^']*'|([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_TELLING = re.compile(r"class|id|role|style", re.I)  # "hidden" has "id" in it
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_NUMBER = re.compile(r"-?\d+$")

WORDS, TAG, SKIP = 0, 1, 2


def _never_content(tag: str, rest: str, in_article: bool) -> bool:
    if tag in _SKIPPED_TAGS or (tag == "header" and not in_article):
        return True
    if not rest or tag in ("html", "body") or tag in _ARTICLE or tag in _HEADINGS:
        return False
    if not _TELLING.search(rest):
        return False
    values = _attributes(rest)
    if values.get("hidden") in ("", "hidden", "true") or values.get("aria-hidden") == "true":
        return True
    if _UNSEEN.search(values.get("style", "")):
        return True
    names = (name for kind in ("class", "id", "role") for name in values.get(kind, "").split())
    # A number at the end counts elements of one kind.
    return any(_NUMBER.sub("", name.replace("_", "-")) in _NEVER for name in names)


def _attributes(rest: str) -> dict[str, str]:
    """Lower-case values by lower-case name; the first of a name counts, and one without a value is empty."""
    values: dict[str, str] = {}
    for found in _ATTRIBUTE.finditer(rest):
        if found[1]:
            values.setdefault(found[1].lower(), (found[2] or found[3] or found[4] or "").strip().lower())
    return values


class _Markup:
    """The marks of a page in turn, in time linear in its length however broken it is.

    A tag ends at the first ``>`` outside quotes; a ``<`` that no tag, comment or declaration starts at
    is text. What a scan found out about a quote or ``>`` holds for every later scan that comes to it.
    """

    def __init__(self, html: str):
        self.html = html
        self.last_end = html.rfind(">")
        # Where a scan that comes to this stop ends, -1 for nowhere.
        self.ends: dict[int, int] = {}
        self.gap = (0, -1)
        self.unpaired: dict[str, int] = {}

    def _next_stop(self, at: int) -> int:
        low, stop = self.gap
        if not low <= at <= stop:
            found = _STOP.search(self.html, at)
            stop = found.start() if found else len(self.html)
            self.gap = (at, stop)
        return stop

    def _tag_end(self, at: int) -> int:
        """The ``>`` of a tag whose name ends at ``at``, or -1."""
        html, path, end = self.html, [], -1
        while at <= self.last_end:
            stop = self._next_stop(at)
            if stop >= len(html):
                break
            if stop in self.ends:
                end = self.ends[stop]
                break
            path.append(stop)
            mark = html[stop]
            if mark == ">":
                end = stop
                break
            if stop >= self.unpaired.get(mark, len(html)):
                break
            other = html.find(mark, stop + 1)
            if other < 0:
                self.unpaired[mark] = stop
                break
            at = other + 1
        for stop in path:
            self.ends[stop] = end
        return end

    def next(self, at: int) -> tuple[int, int, str | None, bool, str]:
        """Start and end of the next mark, and of a tag its name, whether it closes, and its attributes."""
        html, n = self.html, len(self.html)
        start = html.find("<", at)
        while start >= 0:
            second = html[start + 1 : start + 2]
            if second == "!" or second == "?":
                if html.startswith("<!--", start):
                    end = html.find("-->", start + 4)
                    return start, n if end < 0 else end + 3, None, False, ""
                if html.startswith("<![CDATA[", start):
                    end = html.find("]]>", start + 9)
                    return start, n if end < 0 else end + 3, None, False, ""
                end = html.find(">", start) if start < self.last_end else -1
                return start, n if end < 0 else end + 1, None, False, ""
            if start > self.last_end:
                # No tag can end any more.
                found = min((p for p in (html.find("<!", start), html.find("<?", start)) if p >= 0), default=-1)
                start = found
                continue
            name = _NAME.match(html, start)
            if name:
                tag, after = name[2], name.end()
                end = self._tag_end(after)
                if end < 0 and start < self.last_end:
                    # A quote inside the name may hold what the name was cut at.
                    for cut in reversed([q.start() for q in _STOP.finditer(tag)]):
                        end = self._tag_end(name.start(2) + cut)
                        if end >= 0:
                            after = name.start(2) + cut
                            tag = tag[:cut]
                            break
                if end >= 0:
                    return start, end + 1, tag, name[1] == "/", html[after:end]
            start = html.find("<", start + 1)
        return n, n, None, False, ""

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the closing tag of an element whose content is no markup, or the end of the page."""
        found = re.compile(rf"</{re.escape(tag)}\b", re.I).search(self.html, at)
        end = self.html.find(">", found.end()) if found else -1
        return len(self.html) if end < 0 else end + 1


def page_tokens(html: str) -> Iterator[tuple[int, str, bool]]:
    """(kind, value, whether inside the marked article): texts, tags (``/`` in front of closing ones), skipped elements.

    Texts are given as written, between tags. Tags need not be closed: a closing tag closes what is open inside
    its element, and one without an opening does nothing. An article or a main heading ends a
    skipped element that was left open.
    """
    markup = _Markup(html)
    stack: list[tuple[str, bool]] = []
    opened: Counter = Counter()
    skipping = articles = at = 0

    def pop() -> None:
        nonlocal skipping, articles
        tag, skipped = stack.pop()
        opened[tag] -= 1
        skipping -= skipped
        articles -= tag in _ARTICLE

    while True:
        start, end, tag, closes, rest = markup.next(at)
        text = html[at:start]
        if text and not skipping:
            yield WORDS, text, articles > 0
        if start >= len(html):
            return
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if closes:
            if opened[tag]:
                hidden = skipping
                while stack[-1][0] != tag:
                    pop()
                inside = articles > (tag in _ARTICLE)
                pop()
                if not hidden:
                    yield TAG, "/" + tag, inside
            elif not skipping:
                yield TAG, "/" + tag, articles > 0
            continue
        if skipping and tag in (*_ARTICLE, "h1") and stack[0][0] not in _RAW:
            while skipping:
                pop()
        skipped = _never_content(tag, rest, articles > 0)
        if not skipping:
            yield (SKIP if skipped else TAG), tag, articles > 0
        if tag in _VOID or rest.endswith("/"):
            continue
        if tag in _RAW:
            at = markup.raw_end(tag, at)
            continue
        stack.append((tag, skipped))
        opened[tag] += 1
        skipping += skipped
        articles += tag in _ARTICLE


def token_counts(html: str) -> tuple[Counter, Counter] | None:
    """Tags and words inside and outside the article of a page that marks just one, else None."""
    inside, outside = Counter(), Counter()
    for kind, value, within in page_tokens(html):
        side = inside if within else outside
        if kind == WORDS:
            side["words"] += len(value.split())
        elif kind == TAG:
            side[value if value.lstrip("/") in _BLOCKS else "inline"] += 1
    return (inside, outside) if inside["article"] + outside["article"] == 1 else None


def weights_from(inside: dict[str, int], outside: dict[str, int]) -> dict[str, float]:
    """Log odds of the counts, for words within their limits above zero and for tags below."""
    weights = {}
    for name in {*inside, *outside}:
        odds = log((inside.get(name, 0) + 1) / (outside.get(name, 0) + 1))
        low, high = WORD_LIMITS if name == "words" else TAG_LIMITS
        weights[name] = min(high, max(low, odds))
    return weights


def main_text(html: str, weights: dict[str, float]) -> str:
    """Blocks of the best run, joined by newlines; empty where no run scores above zero."""
    word = weights.get("words", DEFAULT_WORD)
    tokens = list(page_tokens(html))
    best = total = 0.0
    start, region = 0, (0, 0)
    for i, (kind, value, _) in enumerate(tokens):
        if total <= 0:
            total, start = 0.0, i
        if kind == WORDS:
            total += word * len(value.split())
        elif kind == SKIP:
            total += SKIPPED
        else:
            name = value if value.lstrip("/") in _BLOCKS else "inline"
            total += weights.get(name, DEFAULT_TAG)
        if total > best:
            best, region = total, (start, i + 1)
    blocks, block = [], []
    for kind, value, _ in tokens[slice(*region)]:
        if kind == WORDS:
            block.append(value)
        elif kind == SKIP or value.lstrip("/") in _BLOCKS:
            blocks.append(block)
            block = []
    blocks.append(block)
    texts = (" ".join(unescape("".join(parts)).split()) for parts in blocks)
    return "\n".join(text for text in texts if text)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, outside = Counter(), Counter()
    for batch in batches:
        for html in strings(batch.column("html")):
            if (counts := token_counts(html)) is not None:
                inside += counts[0]
                outside += counts[1]
    names = sorted({*inside, *outside})
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()), pa.array([outside[n] for n in names], pa.int64())],
        names=["name", "inside", "outside"],
    )


def learned_weights(df: DataFrame, page_id: str, html: str, seed: int = 10) -> dict[str, float]:
    """Weights from the ``TRAIN_PAGES`` first pages in the order of a hash of their id.

    Counting runs in tasks; two counts for each known HTML tag come to the driver.
    """
    ids = df.select(F.col(page_id).alias("sampled")).filter(F.col("sampled").isNotNull())
    # Bounded by the limit.
    sample = F.broadcast(ids.orderBy(F.xxhash64("sampled", F.lit(seed)), "sampled").limit(TRAIN_PAGES).distinct())
    pages = df.select(F.col(page_id).alias("page"), F.col(html).alias("html"))
    chosen = pages.join(sample, F.col("page") == F.col("sampled"), "left_semi").select("html")
    counts = chosen.mapInArrow(_counted, "name string, inside bigint, outside bigint")
    rows = counts.groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return weights_from({r["name"]: r["inside"] for r in rows}, {r["name"]: r["outside"] for r in rows})


def _extracted(weights: dict[str, float]):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, weights) for html in strings(batch.column("html"))]
            yield batch.drop_columns(["html"]).append_column("text", pa.array(texts, pa.string()))

    return extract


def extract_main_text(df: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """All rows and columns of ``df`` with ``text`` and ``n_chars``, its code points.

    White space in a block becomes one space, character references are decoded, and blocks are joined in
    page order by newlines; nothing of the region found is dropped or cut. A null or empty page, or one
    without words outside elements that are never content, has an empty text. Repeated
    and null ids are rows like others. An empty table gives an empty result. Input columns with an added name are
    replaced.
    """
    weights = learned_weights(df, page_id, html)
    rows = carried(df, html=F.col(html))
    ddl = f"_row {rows.schema['_row'].dataType.simpleString()}, text string"
    texts = rows.mapInArrow(_extracted(weights), ddl)
    return restored(texts, df.columns, text=F.col("text"), n_chars=F.char_length("text").cast("long"))
