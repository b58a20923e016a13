"""Main text of web pages.

Method: host suffix array.  The pages of a host become one stream of tokens;
its suffixes are sorted (by prefix doubling, up to ``DEPTH`` tokens, in parts
whose equal suffixes are then brought together), and substrings of that length
that neighbouring suffixes share across distinct pages are repeated runs.  What
they cover is boilerplate; what they leave is unique to the page.

Markup comes in as the exact check.  Text that stands in an article (or main)
element itself is the page's own even if other pages repeat it, and menus,
headers, footers, sidebars, notices, adverts, forms and comments that the markup
names are boilerplate even on a host's only page.  The runs decide what stays of
the blocks the markup says nothing about: those of pages without an article, and
those that stand in an article under an element with a name of its own.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridtide.llm.components import stored
from gridtide.llm.words import SPACED, Words, gram_hashes, mix, text_chunks

#: Tokens of the shortest repeated run, and distinct pages it must be on.
DEPTH = 8
REPEATS = 3
#: Tokens of streams that are sorted together, about.
PART_TOKENS = 1 << 20

#: NAMED blocks are in an article, under an element whose class, id or role says nothing known.
OPEN, ARTICLE, LABELLED, NAMED = 0, 1, 2, 3

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[A-Za-z][^>]*(?:>|\Z)|</\Z|<\Z",
    re.DOTALL,
)
_NAME = re.compile(r"""(?<![a-z-])([a-z-]++)\s*+=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_QUOTED = re.compile(r"""\"[^\"]*\"|'[^']*'""")
_NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that begin and end a block.
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))
#: Elements that are never part of the main text.
_DROPPED = frozenset(
    "head script style noscript template iframe object embed applet svg math canvas audio video map nav footer aside form button select datalist textarea dialog menu search title "
    "noembed noframes xmp".split()
)
#: Words of class, id and role that name boilerplate, if nothing in the name but companions says otherwise.
_LABELS = frozenset(
    "nav navbar navigation menu menubar header masthead footer foot sidebar aside complementary ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login popup modal overlay comment comments reply replies respond "
    "disqus share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager toolbar search widget widgets contentinfo skiplink copyright "
    "disclaimer paywall tracking".split()
)
#: Words that may stand beside them: where a thing is, what it is made of, whom it serves.
_COMPANIONS = frozenset(
    "site page main primary secondary global local top bottom left right upper lower inner outer sub user reader readers article post posts entry story stories blog content "
    "text body box bar area block blocks section sections list lists item items link links button buttons icon icons wrapper wrap container holder panel unit units slot form field "
    "input thread threads count title heading group row column col div region zone tab tabs trail legal dialog window layer strip rail sticky fixed mobile desktop toggle articles "
    "pages".split()
)
_PREFIXES = frozenset(("has", "with", "no", "without", "show", "hide", "is"))
_NEVER_LABELLED = frozenset(("html", "body", "main", "article"))


def _labelled(name: str, attributes: str) -> bool:
    """The element's class, id or role is a name of boilerplate as a whole, or the element is hidden.

    ``comment-list`` and ``cookieNotice`` are such names; ``related-work``,
    ``notice-period`` and ``comment-free`` are not.
    """
    if not attributes or attributes.isspace():
        return False
    for m in _NAME.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            for one in value.split():
                parts = [p.lower() for p in _PART.findall(one)]
                if parts and parts[0] not in _PREFIXES and not _LABELS.isdisjoint(parts) and all(len(p) == 1 or p in _LABELS or p in _COMPANIONS for p in parts):
                    return True
        elif (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?=$|[\s=/])", _QUOTED.sub("", attributes), re.IGNORECASE))


def _is_main(name: str, attributes: str) -> bool:
    return name in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?(?:main|article)\b", attributes, re.IGNORECASE))


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(kind, text) of a page's blocks in order.

    Character references are decoded, white space is one blank, markup, scripts,
    styles and comments are gone; broken or cut markup is read as far as it goes.
    """
    out: list[tuple[int, str]] = []
    held: list[str] = []
    # Element, the outermost element that drops what is inside (or ""), main inside, named inside.
    stack: list[tuple[str, str, bool, bool]] = []
    opened: Counter[str] = Counter()  # of the stack: an end tag without a beginning searches nothing
    at = 0

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            dropped, main, named = stack[-1][1:] if stack else ("", False, False)
            out.append((LABELLED if dropped else OPEN if not main else NAMED if named else ARTICLE, text))

    while True:
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            held.append(entities.unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None) if opened[name] else None
            if name in _BLOCK or (k is not None and any(s[0] in _BLOCK or s[1] for s in stack[k:])):
                flush()
            if k is not None:
                opened.subtract(s[0] for s in stack[k:])
                del stack[k:]
            continue
        attributes = m[3]
        if name == "br":
            held.append(" ")
            continue
        dropped, main, named = stack[-1][1:] if stack else ("", False, False)
        if stack and stack[-1][0] == "head" and name in _BLOCK:  # a head that was never closed
            flush()
            opened[stack.pop()[0]] -= 1
            dropped, main, named = stack[-1][1:] if stack else ("", False, False)
        own = name in _DROPPED or name == "header" or (name not in _NEVER_LABELLED and _labelled(name, attributes))
        if name in _HEADINGS and main and not own:
            # A heading in the header of an article is the article's.
            dropped = "" if dropped == "header" else dropped
        if name in _BLOCK or own:
            flush()
        if name in ("p", "li", "td", "th", "tr", "dd", "dt", "option"):  # their end tags may be left out
            closes = {"p": ("p",), "li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "option": ("option",), "tr": ("tr", "td", "th", "p")}.get(name, ("td", "th", "p"))
            while stack and stack[-1][0] in closes:
                opened[stack.pop()[0]] -= 1
            dropped, main, named = stack[-1][1:] if stack else ("", False, False)
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
            if end:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else len(page)
            continue
        if name in _VOID or attributes.rstrip().endswith("/") and name not in _BLOCK:
            continue
        if main and _is_main(name, attributes):
            named = False
        elif main and name in _BLOCK and _NAMED.search(attributes):
            named = True
        opened[name] += 1
        stack.append((name, dropped or (name if own else ""), main or (not dropped and not own and _is_main(name, attributes)), named))
    flush()
    return out


def kept_kinds(blocks: list[tuple[int, str]]) -> bool:
    """Whether the page has an article, so that nothing outside of it counts."""
    return any(kind in (ARTICLE, NAMED) for kind, _ in blocks)


def _open_kind(blocks: list[tuple[int, str]]) -> int:
    """The kind of block of a page that the runs decide about."""
    return NAMED if kept_kinds(blocks) else OPEN


def _parsed(pages: DataFrame, kind: str) -> DataFrame:
    """(page, url, host, kinds, text, asks): each page's blocks, in lines, and whether the runs decide about any of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_chunks(batch["html"]):
                part = batch.slice(a, b - a)
                read = [blocks_of(page) if page else [] for page in part["html"].to_pylist()]
                kinds, texts = ([[block[k] for block in blocks] for blocks in read] for k in (0, 1))
                asks = [_open_kind(blocks) in own for blocks, own in zip(read, kinds, strict=True)]
                # White space in a block is blanks, so a line break only ends it.
                lines = pa.array(["\n".join(t) for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part["page"], part["url"], part["host"], pa.array(kinds, pa.list_(pa.int8())), lines, pa.array(asks, pa.bool_())], names=["page", "url", "host", "kinds", "text", "asks"]
                )

    return pages.mapInArrow(run, f"page {kind}, url string, host long, kinds array<tinyint>, text string, asks boolean")


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    for i, (kinds, text) in enumerate(zip(batch["kinds"].to_pylist(), batch["text"].to_pylist(), strict=True)):
        yield i, list(zip(kinds, text.split("\n"), strict=True)) if kinds else []


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the tokens of some texts."""
    words = Words(pa.array(texts, pa.large_string()), SPACED)
    return words.text, words.hashes()


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffixes sorted by their first ``depth`` tokens, by prefix doubling; equal ranks share them."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    span = 1
    while span < depth:
        step = min(span, depth - span)
        after = np.full(len(rank), -1, dtype=np.int64)
        after[: max(0, len(rank) - step)] = rank[step:]
        rank = np.unique(rank * (int(after.max(initial=0)) + 2) + after + 1, return_inverse=True)[1]
        span += step
    return np.argsort(rank, kind="stable"), rank


def _host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _windows(parsed: DataFrame) -> DataFrame:
    """(run, content): the runs of ``DEPTH`` tokens that no article vouches for, by host, and the page contents they are on.

    Pages of a host with the same text, or with the same article, are one content.  In each part of the
    input a run is put out for at most ``REPEATS`` contents, which is enough to
    tell that it is repeated.
    """

    def sorted_part(held: list) -> pa.RecordBatch:
        host, content, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
        page = np.repeat(np.arange(len(held)), [len(own) for *_, own in held])
        order, rank = suffix_order(tokens, DEPTH)
        n = len(tokens) - DEPTH + 1
        runs, keep = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if n > 0:
            # By page: two copies of a content may lie side by side, and no run goes from one into the other.
            same_page = page[:n] == page[DEPTH - 1 :]
            order = order[(order < n)]
            order = order[same_page[order]]
            # Suffixes with the same beginning are neighbours; of each such run the first contents stay.
            order = order[np.lexsort((content[order], host[order], rank[order]))]
            r, h, c = rank[order], host[order], content[order]
            new_run = np.ones(len(order), dtype=bool)
            new_run[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
            fresh = new_run.copy()
            fresh[1:] |= c[1:] != c[:-1]
            order, new_run = order[fresh], new_run[fresh]
            begin = np.flatnonzero(new_run)
            place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
            keep = order[place < REPEATS]
            runs = mix(gram_hashes(tokens, DEPTH)[keep] ^ host[keep])
        return pa.RecordBatch.from_arrays([pa.array(runs.view(np.int64)), pa.array(content[keep].view(np.int64))], names=["run", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a, b in text_chunks(batch["text"]):
                part = batch.slice(a, b - a)
                hosts = part["host"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for i, blocks in _streams(part):
                    texts = [t for kind, t in blocks if kind != ARTICLE]
                    if not texts:
                        continue
                    _, own = _tokens(texts)
                    article = [t for kind, t in blocks if kind in (ARTICLE, NAMED)]
                    whole = _tokens(article or [t for _, t in blocks])[1]
                    content = mix(np.bitwise_xor.reduce(mix(whole + np.arange(len(whole), dtype=np.uint64)), keepdims=True) ^ hosts[i])
                    held.append((np.full(len(own), hosts[i]), np.repeat(content, len(own)), own))
                    size += len(own)
                    if size >= PART_TOKENS:
                        yield sorted_part(held)
                        held, size = [], 0
        if held:
            yield sorted_part(held)

    return parsed.mapInArrow(run, "run long, content long")


def repeated_runs(parsed: DataFrame) -> DataFrame:
    """(run): hashes of (host, tokens) of the runs on at least ``REPEATS`` distinct pages of a host."""
    return _windows(parsed).distinct().groupBy("run").count().filter(F.col("count") >= REPEATS).select("run")


def extract_text(df: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, url, text, n_removed): the main text of every page.

    ``text`` joins the kept blocks in page order by a line break and is empty if
    none is kept; ``n_removed`` counts the removed blocks.  Of a block the runs
    decide about stays what no repeated run covers, and it is removed if nothing
    does; an article that they would leave empty stays whole.  Inside a block
    white space is one blank and character references are decoded.  Null and empty
    html has no blocks.  A page without a readable host belongs to the host of
    the empty name.  Repeated rows each get their result and count as one page;
    other columns are not read; an empty table gives no rows.

    Every page is parsed once and its blocks are stored in the shared scratch
    folder; only pages with blocks that the runs decide about are shuffled.
    """
    pages = df.select(F.col(page).alias("page"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"), F.xxhash64(_host(url)).alias("host"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks by page, where in the page's stream they begin (-1: they stay), and the stream's runs that touch them, to ask for."""
        for batch in batches:
            for a, b in text_chunks(batch["text"]):
                part = batch.slice(a, b - a)
                hosts = part["host"].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                texts, begins, articles, gone, places, runs = [], [], [], [], [], []
                for i, blocks in _streams(part):
                    wanted = _open_kind(blocks)
                    keep = [(k, t) for k, t in blocks if k in (ARTICLE, wanted)]
                    place = run = np.zeros(0, np.int64)
                    begin = [-1] * len(keep)
                    if any(k == wanted for k, _ in keep):
                        stream = [(k, t) for k, t in blocks if k != ARTICLE]
                        owner, tokens = _tokens([t for _, t in stream])
                        first = np.searchsorted(owner, np.arange(len(stream)))
                        starts = iter([int(f) for f, (k, _) in zip(first, stream, strict=True) if k == wanted])
                        begin = [next(starts) if k == wanted else -1 for k, _ in keep]
                        grams = gram_hashes(tokens, DEPTH)
                        upto = np.append(0, np.cumsum(np.array([k == wanted for k, _ in stream])[owner]))
                        place = np.flatnonzero(upto[DEPTH : DEPTH + len(grams)] > upto[: len(grams)])
                        run = mix(grams[place] ^ hosts[i]).view(np.int64)
                    texts.append([t for _, t in keep])
                    begins.append(begin)
                    articles.append(wanted == NAMED)
                    gone.append(len(blocks) - len(keep))
                    places.append(place.tolist())
                    runs.append(run.tolist())
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part["page"], part["url"], pa.array(texts, pa.list_(pa.string())), pa.array(begins, longs), pa.array(articles, pa.bool_()), pa.array(gone, pa.int64()), pa.array(places, longs), pa.array(runs, longs)],
                    names=["page", "url", "blocks", "begins", "article", "n_removed", "places", "runs"],
                )

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What repeated runs leave of the blocks."""
        for batch in batches:
            texts, removed = [], []
            for blocks, begins, article, gone, found in zip(*(batch[c].to_pylist() for c in ("blocks", "begins", "article", "n_removed", "found")), strict=True):
                if found:
                    covered = {p + j for p in found for j in range(DEPTH)}
                    left = [t if at < 0 else " ".join(w for k, w in enumerate(t.split(" "), at) if k not in covered) for t, at in zip(blocks, begins, strict=True)]
                    stay = [t for t in left if t]
                    if stay or not article:
                        gone += len(blocks) - len(stay)
                        blocks = stay
                texts.append("\n".join(blocks))
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch["page"], batch["url"], pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["page", "url", "text", "n_removed"])

    kind = pages.schema["page"].dataType.simpleString()
    parsed = stored(_parsed(pages, kind), "pages")
    article = F.filter(F.split("text", "\n"), lambda _, i: F.get("kinds", i) == ARTICLE)
    decided = parsed.filter("not asks").select("page", "url", F.array_join(article, "\n").alias("text"), (F.size("kinds") - F.size(article)).cast("long").alias("n_removed"))
    open_ = parsed.filter("asks").mapInArrow(read, f"page {kind}, url string, blocks array<string>, begins array<long>, article boolean, n_removed long, places array<long>, runs array<long>")
    blocks = open_.withColumn("key", F.xxhash64("page", "url", "blocks", "begins", "places", "runs"))
    asked = blocks.filter(F.size("runs") > 0).select("key", F.inline(F.arrays_zip("places", "runs")).alias("place", "run")).distinct()
    found = asked.join(repeated_runs(parsed), "run").groupBy("key").agg(F.collect_list("place").alias("found"))
    joined = blocks.drop("places", "runs").join(found, "key", "left").drop("key")
    out = decided.unionByName(joined.mapInArrow(unique, f"page {kind}, url string, text string, n_removed long"))
    return out.select(F.col("page").alias(page), F.col("url").alias(url), "text", "n_removed")
