"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags.  Words score positive and tags
negative, by weights learned from labelled pages; one linear scan finds the
contiguous stretch with the highest sum, and its blocks are the main text.

Labelled pages are those with exactly one ``article`` element (or, without any,
one ``main``): what is inside counts as content.  Each tag name and each class, id and
role token gets the log odds that words below it are content, and each tag how
often it occurs in content.  A name that training saw little of is judged by its
parts (``ad-top-2`` by ``ad``): by the mean of what is known of them, so that one word of a
longer name (``comments-on-the-theory``) decides little.  Beside what was learned stands
a prior of ``PRIOR`` words; it speaks against the names below, which say
themselves that they are menus, adverts, forms or reader comments.  That an
article element holds adverts and comments as well doesn't acquit these.

Words whose odds outweigh their score are left out: within a stretch they count
at most ``SKIP`` words against it, so that an advert doesn't cut an article in two.  Where a
page has a labelled element itself, words outside of it score negative and tags inside of it
nothing.

Scale: pages are independent, and linear in their length whatever their nesting;
weights are fitted on at most about ``SAMPLE`` distinct labelled pages (chosen by hash).

Defined results: null and empty html give an empty text; broken or unclosed
markup is read as far as it goes; character references are decoded in each run of
text by itself; a page without any content word has an empty text; of equally
good stretches the first counts; rows are extracted one by one, equal ones alike
and null ids like any other; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8

SAMPLE, PRIOR, AGAINST = 2000, 50.0, -2.7
WORD, TAG, SKIP = 1.0, -0.2, 25
RESULT = "page_id long, url string, text string, n_chars long"

# Elements whose text is never shown, elements that start a block, void elements.
UNSEEN = frozenset("script style noscript template svg math iframe object canvas audio video textarea select option datalist button title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
# Those of them that end only with their end tag, and so hold the rest of a page without one.
RAW = frozenset("script style textarea iframe noscript title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Names that speak against content, as tags or as class, id and role tokens.
BAD_TAGS = frozenset("nav header footer aside form menu dialog fieldset label".split())
BAD_TOKENS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs combanner comment comments commentlist community complementary contentinfo cookie cookies consent disqus "
    "dialog disclaimer footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup privacy promo promoted promotion "
    "recommended related reply replies respond rss search share sharing shoutbox sidebar signup skip skyscraper social sponsor sponsored subscribe tags toolbar tracking widget".split()
)
# Elements that say nothing about their words, wherever they were seen.
PLAIN_TAGS = frozenset("div span section table tbody thead tr td th ul ol li dl dd dt center font b i em strong a u small details figure".split())
# Parts of names that say what an element is built like, not what it holds; parts that make a header that of the text itself.
BUILD = frozenset("area bar block body bottom box button buttons card cell col column container content div el element group inner item items layout left list main outer page panel posts right row section site top wrap wrapper".split())
OWN = frozenset("article blog content entry post story text".split())
# Parts that make a name tell of a state (has-sidebar, comments-open), not of what an element holds.
STATE = frozenset("closed disabled enabled has is layout no off on open with without".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<[!?/][^>]*+>"
    r"|<[A-Za-z/][^>]*+>",
    re.S,
)
_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in UNSEEN}
_BODY = re.compile(r"<body\b", re.I)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile("[A-Z]?[a-z]+|[A-Z]+")


def parts_of(name: str) -> tuple[str, ...]:
    """The words of a class, id or role token that may say what it holds."""
    every = [x.lower() for x in _PART.findall(name)]
    if len(every) > 1 and not STATE.isdisjoint(every):
        return ()
    if "header" in every and not OWN.isdisjoint(every):
        every = [x for x in every if x != "header"]
    return tuple(x for x in every if x not in BUILD)


def features(name: str, attrs: str) -> tuple[tuple[str, ...], bool]:
    """The tag (``<tag``) and tokens (``.token``) of an element, and whether it is hidden."""
    out, hidden = [] if name in PLAIN_TAGS else ["<" + name], False
    if attrs and not attrs.isspace():
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in ("class", "id", "role"):
                out += ["." + x for x in value.split()]
            elif key == "style":
                flat = value.lower().replace(" ", "")
                hidden |= "display:none" in flat or "visibility:hidden" in flat
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                hidden = True
    return tuple(out), hidden


def tokens(page: str) -> Iterator[tuple]:
    """('text', raw) and ('tag', is_end, name, attrs) in page order; elements that are never shown are left out with all they hold."""
    at, endless = 0, set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        if not m["name"]:
            continue
        name, attrs = m["name"].lower(), m["attrs"]
        if name in UNSEEN and not m["end"] and not (name in ("svg", "math") and attrs.endswith("/")):
            end = None if name in endless else _END[name].search(page, at)
            if end:
                at = end.end()
                continue
            endless.add(name)  # looked for once
            if name in RAW:
                body = _BODY.search(page, at) if name == "title" else None
                at = body.start() if body else len(page)
                continue
        yield "tag", bool(m["end"]), name, attrs
    if at < len(page):
        yield "text", page[at:]


def against(f: str) -> bool:
    """Whether a feature's name says itself that it isn't content."""
    return f[1:] in (BAD_TAGS if f[0] == "<" else BAD_TOKENS)


class Weights:
    """Log odds of words below a tag, a token or a part of a token (``~part``), and scores of tags."""

    def __init__(self, word: dict[str, tuple[float, float]] | None = None, tag: dict[str, float] | None = None):
        self.word, self.tag, self._known = word or {}, tag or {}, {}  # word: log odds and words seen

    def odds(self, f: str) -> float:
        """What a feature says of the words below it: what was learned, with the prior, or the mean of its parts, for the first ``PRIOR`` words."""
        got = self._known.get(f)
        if got is None:
            learned, n = self.word.get(f, (0.0, 0.0))
            if f[0] == ".":
                each = [self.odds("~" + x) for x in parts_of(f[1:])]
                prior = sum(each) / len(each) if each else 0.0
            else:
                prior = AGAINST if against(f) else 0.0
            got = max(-4.0, min(2.0, (n * learned + PRIOR * prior) / (n + PRIOR)))
            if against(f):
                got = min(got, AGAINST)
            if len(self._known) < 100_000:
                self._known[f] = got
        return got

    def below(self, feats: tuple[str, ...], in_label: bool) -> float:
        """The least log odds that an element's features give the words below it."""
        return min((self.odds(f) for f in feats if not (in_label and f == "<header")), default=0.0)


def label_of(page: list[tuple]) -> str | None:
    """The name of the element that marks the content: the only ``article``, or without any the only ``main``."""
    starts = [t[2] for t in page if t[0] == "tag" and not t[1] and t[2] in ("article", "main")]
    for name in ("article", "main"):
        if name in starts:
            return name if starts.count(name) == 1 else None
    return None


class Open:
    """An open element: its name, the log odds of words in it, its features, whether it is in the label, and the innermost block before it."""

    __slots__ = ("name", "odds", "feats", "inside", "block")

    def __init__(self, name: str, odds: float, feats: tuple[str, ...], inside: bool, block: int):
        self.name, self.odds, self.feats, self.inside, self.block = name, odds, feats, inside, block


def walk(page: list[tuple], weights: Weights, label: str | None, opened=None, closed=None) -> Iterator[tuple]:  # noqa: ANN001
    """('text', raw, log odds, whether in the label, number of the left-out element) and ('tag', name, whether it breaks a block, whether in the label).

    ``opened`` and ``closed`` are called with the features of elements as these come and go.
    """
    stack: list[Open] = []
    names: Counter = Counter()
    block, cut = -1, 0  # the innermost open block; how many elements were left out so far

    def pop_to(k: int) -> None:
        nonlocal block
        while len(stack) > k:
            x = stack.pop()
            names[x.name] -= 1
            if closed and x.feats:
                closed(x.feats)
        block = len(stack) - 1 if stack and stack[-1].name in BLOCKS else stack[-1].block if stack else -1

    for token in page:
        now = stack[-1] if stack else None
        if token[0] == "text":
            yield "text", token[1], now.odds if now else 0.0, bool(now and now.inside), cut
            continue
        _, end, name, attrs = token
        if end:
            if names[name]:
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                pop_to(k)
        elif name not in VOID and not attrs.endswith("/"):
            if name == "body" and names["head"]:
                pop_to(next(k for k, x in enumerate(stack) if x.name == "head"))
            # a paragraph ends where another block begins; so does an item at the next one
            if name in BLOCKS and block >= 0 and (stack[block].name == "p" or (stack[block].name == name and name in ("li", "dd", "dt", "tr", "td", "th"))):
                pop_to(block)
            if name == label:  # an unclosed menu doesn't swallow the article
                while stack and stack[-1].odds < -WORD and stack[-1].name in BAD_TAGS | {"ul", "ol", "li", "a", "div"}:
                    pop_to(len(stack) - 1)
            now = stack[-1] if stack else None
            feats, hidden = features(name, attrs)
            hidden |= name == "head" or name in UNSEEN
            # the label counts unless one of its names says as such that it is something else; what is around it doesn't matter
            marks = name == label and not hidden and not any(against(f) for f in feats)
            own = -9.0 if hidden else 0.0 if marks or name in ("html", "body") else weights.below(feats, bool(now and now.inside))
            odds = own if marks else min(now.odds if now else 0.0, own)
            if odds < -WORD and not (now and now.odds < -WORD):
                cut += 1
            stack.append(Open(name, odds, () if marks or name in ("html", "body") else feats, bool(now and now.inside) or marks, block))
            names[name] += 1
            if opened and stack[-1].feats:
                opened(stack[-1].feats)
            if name in BLOCKS:
                block = len(stack) - 1
        yield "tag", name, name in BLOCKS, bool(stack and stack[-1].inside)
    pop_to(0)


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous stretch with the highest sum; of equal ones the first, empty if none is positive."""
    best, total, start, lo, hi = 0.0, 0.0, 0, 0, 0
    for k, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += score
        if total > best:
            best, lo, hi = total, start, k + 1
    return lo, hi


def main_text(page: str | None, weights: Weights) -> str:
    """The blocks of the best stretch of ``page``, joined by blank lines."""
    if not page:
        return ""
    page = list(tokens(page))
    label = label_of(page)
    items: list[tuple[str | None, bool]] = []  # text (None: a tag), whether it breaks a block
    scores: list[float] = []
    seen = list(walk(page, weights, label))
    marked = any(x[3] for x in seen)
    left: Counter = Counter()  # words counted against a stretch, by left-out element
    for x in seen:
        if x[0] == "tag":
            scores.append(0.0 if marked and x[3] else weights.tag.get("<" + x[1], TAG))
            items.append((" " if x[1] == "br" else None, x[2]))
            continue
        n = len(x[1].split())
        score = WORD + (x[2] if x[3] or not marked else -4.0)
        if score >= 0:
            scores.append(max(score, 0.0) * n)
            items.append((x[1], False))
        else:
            n = min(n, SKIP - left[x[4]]) if not marked or x[3] else n
            left[x[4]] += n
            scores.append(0.0 if marked and x[3] else -WORD * n)
            items.append(("", False))
    lo, hi = best_stretch(scores)
    blocks, now = [], []

    def close() -> None:
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    for text, breaks in items[lo:hi]:
        if text is not None:
            now.append(html.unescape(text))
        elif breaks:
            close()
    close()
    return "\n\n".join(blocks)


# ------------------------------------------------------------------ learning


class Counts:
    """Words below each feature and tags, inside and outside of labels."""

    def __init__(self):
        self.word: dict[str, list[int]] = {}
        self.tag: dict[str, list[int]] = {}
        self.words = [0, 0]
        self._open: dict[str, tuple[int, int, int]] = {}  # how often it is open, and the words when it was opened first

    @staticmethod
    def _all(feats: tuple[str, ...]) -> set[str]:
        return set(feats) | {"~" + x for f in feats if f[0] == "." for x in parts_of(f[1:])}

    def opened(self, feats: tuple[str, ...]) -> None:
        for f in self._all(feats):
            n, a, b = self._open.get(f, (0, *self.words))
            self._open[f] = (n + 1, a, b)

    def closed(self, feats: tuple[str, ...]) -> None:
        for f in self._all(feats):
            n, a, b = self._open.pop(f)
            if n > 1:
                self._open[f] = (n - 1, a, b)
            else:
                c = self.word.setdefault(f, [0, 0])
                c[0] += self.words[0] - a
                c[1] += self.words[1] - b

    def add(self, page: str) -> None:
        page = list(tokens(page))
        label = label_of(page)
        if label is None:
            return
        for x in walk(page, Weights(), label, self.opened, self.closed):
            if x[0] == "text":
                self.words[0 if x[3] else 1] += len(x[1].split())
            elif x[1] not in ("article", "main", "html", "body"):
                for k in ("<" + x[1], "*"):
                    self.tag.setdefault(k, [0, 0])[0 if x[3] else 1] += 1


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = Counts()
    for batch in batches:
        for page in batch.column(0):
            counts.add(page.as_py())
    counts.word["*"] = counts.words
    rows = [(kind, f, a, b) for kind, c in (("word", counts.word), ("tag", counts.tag)) for f, (a, b) in c.items() if a or b]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string() if i < 2 else pa.int64()) for i in range(4)], ["kind", "feature", "inside", "outside"])


def fit(pages: DataFrame, sample: int = SAMPLE) -> Weights:
    """Weights from at most about ``sample`` distinct labelled pages (html)."""
    page = pages.select(F.col("html").cast("string").alias("html")).where(F.col("html").rlike(r"(?i)<(article|main)\b"))
    n = page.select(F.xxhash64("html").alias("h")).distinct().count()
    if n > sample:
        page = page.where(F.pmod(F.xxhash64("html"), F.lit(1_000_003)) < int(1_000_003 * sample / n))
    seen = page.distinct().mapInArrow(_observe, "kind string, feature string, inside long, outside long")
    rows = seen.groupBy("kind", "feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()  # the names of a bounded sample
    total = {r.kind: (r.inside, r.outside) for r in rows if r.feature == "*"}
    word, tag = {}, {}
    for r in rows:
        if r.feature == "*":
            continue
        inside, outside = total.get(r.kind, (1, 1))
        odds = math.log((r.inside + 0.5) / (inside + 1.0) / ((r.outside + 0.5) / (outside + 1.0)))
        if r.kind == "word":
            word[r.feature] = (odds, float(r.inside + r.outside))
        else:
            tag[r.feature] = TAG + max(-2.0, min(0.0, odds / 4))
    return Weights(word, tag)


def _extract(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    weights = shared.value
    for batch in batches:
        _, offs = utf8(batch.column(2))
        for i, j in slices(offs):
            texts = [main_text(p.as_py(), weights) for p in batch.column(2).slice(i, j - i)]
            cols = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(weights or fit(pages))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lambda it: _extract(it, shared), RESULT)


def op9_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
