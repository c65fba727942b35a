"""Main text of web pages by the maximum-scoring run of tokens.

A page is a row of tokens: words score positive, tags negative, and one linear scan finds the contiguous run with the
greatest sum. Weights come from labelled pages, those that mark their content with one ``article`` or ``main`` element:
a tag weighs by how much more often it stands outside of content, so paragraph tags cost almost nothing and a menu's
tags much; words weigh by the block that they stand in. Elements that are never main text (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments), by tag or by a class, id or role that is such a word, begins or ends with it,
score nothing and give no words, also within the run. Names that begin with a word of layout or taxonomy, headers of content, and elements with
most of the page's words (unless hidden or never text by their tag) go by their score.

The text is the run's blocks in page order, white space in a block turned into one space, joined by line feeds.

Defined cases: NULL and empty pages have empty text, as have pages without words. An element that is never closed ends at the next block
tag. Pages of any length are read whole in linear time. Without labelled pages, fixed weights serve. Columns besides the named one are
kept; of clashing names the computed one stays. Repeated rows are extracted apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import accumulate
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: About so many labelled pages, chosen by hash, are enough to weigh tags.
FIT_PAGES = 2_000
#: Kinds of tags that get a learned weight, the most frequent ones.
MOST_KINDS = 5_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|textarea|title|iframe)\b(?:\"[^\"<]*\"|'[^'<]*'|[^\"'>])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:\"[^\"<]*\"|'[^'<]*'|[^\"'<>])*+)>"
    r"|</?[A-Za-z][^<>]*>"
    r"|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true")

NEVER = frozenset("nav header footer aside form head menu dialog fieldset applet audio video canvas map svg select button object template".split())
#: Of these, those within a line: their own blocks don't break it.
INLINE = frozenset("svg select button object template".split())
NEVER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion
    cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall
    sidebar side rail widget menu nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager skip
    footer header masthead topbar copyright legal
    comment comments commentlist disqus respond reply replies discussion
    share sharing social related recommended recirc search login form
    complementary contentinfo search""".split()
)
#: First parts of names that tell of layout or taxonomy, whatever the last one is, and of content, whose header is its heading.
OTHER_WORDS = frozenset("has have no not non with without is are in on off category categories cat tag tags topic type format".split())
CONTENT_WORDS = frozenset("article post entry story content".split())
BLOCKS = frozenset(
    """address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
    section summary table tbody td tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
#: Tags that content is made of, for fixed weights.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li ul ol dl dt dd figure figcaption table tbody thead tr td th br hr b i em strong".split())
#: Bounds of weights.
TAG_LEAST, TAG_MOST, WORD_LEAST, WORD_MOST = -12.0, -0.01, -1.0, 1.0


@dataclass
class Token:
    """A tag (``kind``: its name with class words) or, if ``tag`` is empty, a stretch of text with its enclosing block's kind."""

    tag: str
    kind: str
    close: bool = False
    text: str = ""
    skip: bool = False
    words: int = field(default=0)


def _class_words(attrs: str) -> list[str]:
    found = []
    for m in ATTRIBUTE.finditer(attrs):
        found += re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[2] or m[3] or m[4] or "").lower())
    return found


def _never_named(attrs: str) -> bool:
    """Whether a class, id or role as a whole, or its first or last part, is a word of what is never main text."""
    for m in ATTRIBUTE.finditer(attrs):
        for name in (m[2] or m[3] or m[4] or "").split():
            parts = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())
            if not parts or parts[0] in OTHER_WORDS or (parts[0] in CONTENT_WORDS and parts[-1] == "header"):
                continue
            if parts[0] in NEVER_WORDS or parts[-1] in NEVER_WORDS:
                return True
    return False


def tokens(html: str) -> list[Token]:
    """The page's tokens, with what is never main text marked."""
    out: list[Token] = []
    opened: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    never: list[int] = []
    by_score: set[int] = set()
    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            out.append(Token("", "", text=html[at : m.start()]))
        at = m.end()
        if not m["tag"]:
            continue
        tag, close, attrs = m["tag"].lower(), bool(m["close"]), m["attrs"] or ""
        words = _class_words(attrs) if "=" in attrs and not close else []
        here = len(out)
        if close:
            kind = f"/{tag}"
            if stack := opened.get(tag):
                start = stack.pop()
                ends[start] = here
                kind = f"/{out[start].kind}"
        else:
            kind = ".".join([tag, *sorted(set(words))[:3]])
            if tag not in VOID and not attrs.endswith("/"):
                opened.setdefault(tag, []).append(here)
            if tag not in ("html", "body", *CONTENT):
                certain = (tag in NEVER and tag != "form") or HIDDEN.search(attrs)
                if certain or tag == "form" or (words and _never_named(attrs)):
                    never.append(here)
                    if not certain:
                        by_score.add(here)
        out.append(Token(tag, kind, close))
    if at < len(html):
        out.append(Token("", "", text=html[at:]))
    before = list(accumulate((0 if t.tag else len(t.text.split()) for t in out), initial=0)) if by_score else []
    upto = -1
    for start in never:
        if start <= upto:
            continue
        end = ends.get(start)
        if end is None:
            end = next((k for k in range(start + 1, len(out)) if out[k].tag in BLOCKS and not (out[start].tag == "select" and out[k].tag in ("option", "optgroup"))), len(out)) - 1
        if start in by_score and 2 * (before[end + 1] - before[start]) > before[-1]:
            continue  # most of the page's words
        if out[start].tag in INLINE and start in ends:
            for k in range(start + 1, end):
                out[k].tag = out[k].tag and out[start].tag
        for k in range(start, end + 1):
            out[k].skip = True
        upto = end
    block = ""
    for t in out:
        if t.tag in BLOCKS:
            block = t.kind
        elif not t.tag:
            t.kind = f"words in {block}"
            t.text = unescape(t.text)
            t.words = len(t.text.split())
    return out


def tally(page: list[Token]) -> Counter:
    """(kind, within the content?) of each token of a labelled page; empty for others."""
    marks = [k for k, t in enumerate(page) if t.tag in CONTENT and not t.skip]
    starts = [k for k in marks if not page[k].close]
    found: Counter = Counter()
    if len(starts) != 1 or len(marks) != 2 or not page[marks[1]].close:
        return found
    for k, t in enumerate(page):
        if not t.skip:
            found[t.kind, marks[0] < k < marks[1]] += 1 if t.tag else t.words
    return found


def weigh(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Weights by kind from tallies: smoothed log odds of standing within content, bounded by sign."""
    weights = {}
    for kind in {k for k, _ in counts}:
        inside, outside = counts.get((kind, True), 0), counts.get((kind, False), 0)
        odds = log((inside + 0.5) / (outside + 0.5))
        if kind.startswith("words in "):
            weights[kind] = min(WORD_MOST, max(WORD_LEAST, odds))
        else:
            weights[kind] = min(TAG_MOST, max(TAG_LEAST, 2 * odds))
    return weights


def _weight(t: Token, weights: dict[str, float]) -> float:
    if t.skip:
        return 0.0
    if not t.tag:
        return t.words * weights.get(t.kind, WORD_MOST)
    return weights.get(t.kind, TAG_MOST if t.tag in PLAIN else -1.0 if t.tag not in CONTENT else -8.0)


def best_run(scores: Iterable[float]) -> tuple[int, int]:
    """First and last place, end exclusive, of the run with the greatest positive sum; the first of equal ones."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for k, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, k
        run += s
        if run > best:
            best, found = run, (start, k + 1)
    return found


def extract(html: str | None, weights: dict[str, float]) -> str:
    page = tokens(html or "")
    start, end = best_run([_weight(t, weights) for t in page])
    blocks, held = [], []
    for t in page[start:end]:
        if t.tag in BLOCKS:
            blocks.append(held)
            held = []
        elif not t.tag and not t.skip:
            held.append(t.text)
    lines = (" ".join("".join(b).split()) for b in [*blocks, held])
    return "\n".join(x for x in lines if x)


def fit(df: DataFrame, html: str = "html", key: str = "page_id", pages: int = FIT_PAGES) -> dict[str, float]:
    """Weights from about ``pages`` pages, chosen by hash; only sums by kind, at most 2 * MOST_KINDS of them, come to the driver."""
    n = df.count()
    share = int(min(1.0, pages / max(1, n)) * (1 << 30))
    sample = df.where(F.pmod(F.xxhash64(key, html), F.lit(1 << 30)) < share).select(F.col(html).alias("html"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch.column("html"):
                total += tally(tokens(page.as_py() or ""))
            rows = [(k, inside, c) for (k, inside), c in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.int64()))], ["kind", "inside", "n"])

    found = sample.mapInArrow(run, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    return weigh({(r["kind"], r["inside"]): r["n"] for r in found.orderBy(F.desc("n"), "kind", "inside").limit(2 * MOST_KINDS).collect()})


def add_text(df: DataFrame, weights: dict[str, float], html: str = "html", name: str = "text") -> DataFrame:
    """``df`` with the main text in place of the page."""
    kept = [c for c in df.columns if c not in (html, name)]
    rows = df.select(*kept, F.col(html).alias("_html"))
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(x.as_py(), weights) for x in batch.column("_html")], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*kept, name])

    return rows.mapInArrow(run, schema)
