"""Main text of web pages by the container paths that the pages of a host agree on.

Each page's containers are scored by the running text below them (half of it where side words in a class or id are around). A page votes for the generalised tag-class path of its
best containers, votes are added up per host in Spark, and every page is extracted again with the paths that won on its
host; a page that has none of them keeps its own best container.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Fixed values of HTML: element kinds.
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select button".split())
CLOSES_P = BLOCKS - frozenset(("html", "body"))
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table", "tbody", "thead", "tfoot"))}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCOPED = frozenset("p li dt dd tr".split()) | HEADINGS
# What is not the article: elements, roles, and words in class or id.
SIDE_TAGS = frozenset("nav header footer aside form fieldset menu dialog".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
SIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer foot cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus replies reply respond share sharing social follow related recommended more trending newsletter subscribe subscription signup login search toolbar pager pagination skip widget".split()
)
PREFIXES = frozenset("has with no without is".split())
NEVER_SIDE = frozenset(("html", "body", "main"))
WHOLE = frozenset(("article", "main"))
SIDE_WEIGHT = 0.5


def running(block: str, linked: int) -> float:
    return max(0.0, len(block) - 2.0 * linked) * (1 + block.count(",") / 20)


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw and not raw.isspace() else {}


def is_side(tag: str, attrs: dict[str, str]) -> bool:
    if tag in NEVER_SIDE:
        return False
    if tag in SIDE_TAGS or "hidden" in attrs or attrs.get("role", "").lower() in SIDE_ROLES or attrs.get("aria-hidden") == "true":
        return True
    if "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    return False


def has_side_words(tag: str, attrs: dict[str, str]) -> bool:
    """Whether class or id tell of something beside the article; a hint only, as themes name layouts and topics so too."""
    if tag in NEVER_SIDE:
        return False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        words = re.split(r"[-_:]+", name)
        if words[0] not in PREFIXES and not SIDE_WORDS.isdisjoint(words):
            return True
    return False


def step(tag: str, attrs: dict[str, str]) -> str:
    """A tag with its classes, numbers generalised; ids are left out as they differ from page to page."""
    names = sorted({re.sub(r"\d+", "0", c) for c in attrs.get("class", "").lower().split()})
    return ".".join([tag, *names])


class Page:
    """Blocks of running text in page order, each with the numbers of the containers around it.

    Left out are blocks below what is not the article by element, role or style, and below containers with side words
    unless these are an article or hold most of the running text; all stay where nothing else is left.
    """

    def __init__(self, html: str):
        self.paths: list[str] = []
        self.tags: list[str] = []
        self.blocks: list[tuple[tuple[int, ...], str, int]] = []
        self.weights: list[float] = []
        found: list[tuple[tuple, bool, tuple[int, ...]]] = []
        hints: list[bool] = []  # per container with side words: whether it is an article
        stack: list[tuple[str, int, bool, tuple[int, ...]]] = []  # tag, number of the container, inside something that is not the article, hints around
        chain: tuple[int, ...] = ()
        text: list[str] = []
        linked, in_link = 0, False
        at, end = 0, len(html)

        def flush():
            nonlocal linked
            if text:
                block = " ".join(unescape("".join(text)).split())
                if block:
                    found.append(((chain, block, min(linked, len(block))), *(stack[-1][2:] if stack else (False, ()))))
                text.clear()
            linked = 0

        def close(keep: int):
            nonlocal chain
            flush()
            del stack[keep:]
            chain = tuple(n for _, n, _, _ in stack if n >= 0)

        while at < end:
            m = TOKEN.search(html, at)
            upto = m.start() if m else end
            if upto > at:
                piece = html[at:upto]
                text.append(piece)
                linked += len(piece) if in_link else 0
            if not m:
                break
            at = m.end()
            closing, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            tag = name.lower()
            if not closing and tag in RAW:
                if not raw.endswith("/"):
                    shut = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                    at = shut.end() if shut else (end if tag in ("script", "style", "textarea", "title") else at)
                continue
            if tag == "a":
                in_link = not closing
            elif tag in ("br", "td", "th"):
                text.append(" ")
            if tag not in BLOCKS:
                continue
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag or tag in HEADINGS and stack[i][0] in HEADINGS:
                        close(i)
                        break
                    if tag in SCOPED and stack[i][0] not in SCOPED:
                        break
                else:
                    flush()
                continue
            in_link = False
            if stack and stack[-1][0] == "p" and tag in CLOSES_P:
                close(len(stack) - 1)
            elif tag in SIBLINGS:
                same, scope = SIBLINGS[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in same.split():
                        close(i)
                        break
                    if stack[i][0] in scope:
                        break
            flush()
            if tag in VOID:
                continue
            attrs = attributes(raw)
            side = bool(stack and stack[-1][2]) or is_side(tag, attrs)
            around = stack[-1][3] if stack else ()
            kind = {"article": "article", "main": "main"}.get(attrs.get("role", "").lower(), tag)
            if not side and has_side_words(tag, attrs):
                around += (len(hints),)
                hints.append(kind in WHOLE)
            number = -1
            if not side and tag not in SCOPED:
                number = len(self.paths)
                above = self.paths[chain[-1]] + "/" if chain else ""
                self.paths.append(above + step(tag, attrs))
                self.tags.append(kind)
            stack.append((tag, number, side, around))
            if number >= 0:
                chain += (number,)
        flush()
        self.choose(found, hints)

    def choose(self, found: list, hints: list[bool]) -> None:
        held, total = [0.0] * len(hints), 0.0
        for (_, block, linked), side, around in found:
            if not side:
                own = running(block, linked)
                total += own
                for h in around:
                    held[h] += own
        kept = [whole or x > total / 2 for whole, x in zip(hints, held)]
        left = [x for x in found if not x[1] and all(kept[h] for h in x[2])] or [x for x in found if not x[1]] or found
        self.blocks = [x[0] for x in left]
        self.weights = [SIDE_WEIGHT if x[1] or x[2] else 1.0 for x in left]

    def scores(self) -> Counter:
        """Running text per container: whole for the nearest container, half for the next, and so on outwards."""
        found: Counter = Counter()
        for (chain, block, linked), weight in zip(self.blocks, self.weights):
            own = weight * running(block, linked)
            for up, number in enumerate(reversed(chain[-4:])):
                found[number] += own / 2**up
        return found

    def votes(self) -> dict[str, float]:
        """Path of each container worth a vote, with its share of the best score; an article takes the vote of what is in it."""
        scores = self.scores()
        best = max(scores.values(), default=0.0)
        if best <= 0:
            return {}
        above = {n: chain for chain, _, _ in self.blocks for n in chain}
        shares: Counter = Counter()
        for number, score in scores.items():
            if score >= 0.6 * best:
                around = [n for n in above[number] if self.tags[n] in WHOLE and n <= number]
                path = self.paths[around[-1] if around else number]
                shares[path] = max(shares[path], score / best)
        return dict(shares)

    def text(self, paths: list[str]) -> str | None:
        """Blocks below all containers of the first of the paths that holds text; None if no path does."""
        for path in paths:
            numbers = {i for i, p in enumerate(self.paths) if p == path}
            blocks = [b for chain, b, _ in self.blocks if not numbers.isdisjoint(chain)] if numbers else []
            if blocks:
                return "\n".join(blocks)
        return None


def own_text(page: Page) -> str:
    votes = page.votes()
    return page.text(sorted(votes, key=lambda p: (-votes[p], p))) or "\n".join(b for _, b, _ in page.blocks)


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


LEAST_SHARE = 0.1


def host_winners(pages: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """``host, paths``: paths with at least ``least_share`` of the votes of the host, best first (so at most 1/share of them)."""

    def vote(batches):
        for b in batches:
            host, path, share = [], [], []
            counts: Counter = Counter()
            for h, x in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                for p, s in Page(x).votes().items():
                    counts[h, p] += s
            for (h, p), s in sorted(counts.items()):
                host.append(h)
                path.append(p)
                share.append(round(s, 6))
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(share, pa.float64())], names=["host", "path", "votes"])

    votes = pages.mapInArrow(vote, "host string, path string, votes double").groupBy("host", "path").agg(F.sum(F.col("votes").cast("decimal(28,6)")).alias("votes"))
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    kept = votes.join(total, "host").where(F.col("votes") >= least_share * F.col("total"))
    return kept.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))), lambda s: s["path"]).alias("paths"))


def extract(pages: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """``page_id, url, text, n_chars``: one row per input row, the whole article text with blocks on lines.

    Null or empty html gives an empty text; a null or odd url is the host ''. Repeated rows vote and return like any
    other. Other columns are not carried.
    """
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    winners = host_winners(src.select("host", "html"), least_share)

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                made = []
                for x, paths in zip(b.column("html").to_pylist(), b.column("paths").to_pylist()):
                    page = Page(x)
                    text = page.text(paths or [])
                    made.append(own_text(page) if text is None else text)
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    # A busy host is split by the skew handling of the join, or the winners are small enough to be broadcast by size.
    return src.join(winners, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
