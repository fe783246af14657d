"""Main text of web pages: nearest-URL page differencing, and markup for what differencing can't tell.

1. Pages of a host are ordered by URL path by one global sort of (host, path, page) without their
   html; a page's partner is the neighbour on that order that shares more leading path segments.
   Neighbours are found by their places in the order, so a host with most of the pages is dealt like
   any other.
2. Each page is cut into text lines, one for each block element. All lines outside article and main
   elements are aligned with the partner's by longest common subsequence, and shared lines are deleted:
   what two pages of one path have in common there is the site's, not the page's. Lines inside such an
   element stay, as two articles may hold the same passage. A page none of whose lines would be left is
   a copy of its partner and keeps them.
3. Differencing can't see what a site varies from page to page. Of the lines it leaves, those in menus,
   page headers, footers, sidebars, notices, adverts, forms and comments go by their markup; where there
   is an article or main element, nothing outside it is part of the text.

Null or empty html gives an empty text; a null or odd URL has the host "" and takes part as such.
Repeated rows each give their row, and rows of one page id and URL with other html are pages of their
own; an empty table gives an empty result. A very long page is held whole, and its alignment takes
memory in proportion to its lines. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, table

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Element names by what they mean for the text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math xmp noembed noframes object".split())
DROPPED = frozenset("nav footer aside menu form dialog head title button select option label".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr popup modal overlay notice notices alert newsletter "
    "subscribe subscription signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies share sharing social related recommended recommendations "
    "widget widgets toolbar pagination pager login masthead topbar skip".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
NOISY, PLAIN, TRUSTED = -1, 0, 1


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if "=" in text or "hidden" in text.lower() else {}


def _noise(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element and all in it is no part of the text. inside: of an article or main element."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    names = set(re.split(r"[^a-z0-9]+", re.sub(r"\b(?:with|has|no)[-_]\w+", " ", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())))
    if names & NOISE or ("header" in names and not inside):
        return True
    if attrs.get("role", "").lower() in NOISE_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    return "display:none" in re.sub(r"\s", "", attrs.get("style", "").lower())


def lines(page: str) -> list[tuple[str, int]]:
    """Text lines of a page in order, each TRUSTED (inside an article or main element), PLAIN or NOISY (by its markup)."""
    out: list[tuple[str, int]] = []
    buffer: list[str] = []
    noisy: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, drops its text, is an article or main element
    dropping = trusted = 0
    at, n = 0, len(page)

    def flush() -> None:
        for held, zone in ((buffer, TRUSTED if trusted else PLAIN), (noisy, NOISY)):
            if held:
                text = " ".join("".join(held).split())
                held.clear()
                if text:
                    out.append((text, zone))

    while at < n:
        m = MARKUP.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            (noisy if dropping else buffer).append(entities.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            (noisy if dropping else buffer).append(" ")
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    for _, d, t in stack[i:]:
                        dropping -= d
                        trusted -= t
                    del stack[i:]
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if tag in VOID or (attributes.endswith("/") and not block):
            continue
        if block and stack and stack[-1][0] == "p":  # a block ends an open paragraph
            _, d, t = stack.pop()
            dropping -= d
            trusted -= t
        attrs = _attributes(attributes)
        noise = _noise(tag, attrs, bool(trusted))
        main = not noise and (tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody")
        if block or noise or main:
            stack.append((tag, noise, main))
            dropping += noise
            trusted += main
    flush()
    return out


def _ends(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of a with the first 0, 1 ... all of b; bits of one number stand for b."""
    full, at = (1 << len(b)) - 1, {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    v = full
    for x in a:
        if u := v & at.get(x, 0):
            v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def _common(a: list[int], places: list[int], b: list[int]) -> list[int]:
    """The places of a longest common subsequence of a and b, by halving a: memory is linear."""
    out, work = [], [(a, places, b)]
    while work:
        a, places, b = work.pop()
        if not a or not b:
            continue
        if len(a) == 1:
            out += places if a[0] in b else []
            continue
        m = len(a) // 2
        k = int(np.argmax(_ends(a[:m], b) + _ends(a[m:][::-1], b[::-1])[::-1]))
        work += [(a[:m], places[:m], b[:k]), (a[m:], places[m:], b[k:])]
    return out


def shared(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence with b; equal ends need no search."""
    n, least = 0, min(len(a), len(b))
    while n < least and a[n] == b[n]:
        n += 1
    m = 0
    while m < least - n and a[-1 - m] == b[-1 - m]:
        m += 1
    in_b, in_a = set(b[n : len(b) - m]), set(a[n : len(a) - m])
    places = [i for i in range(n, len(a) - m) if a[i] in in_b]
    found = _common([a[i] for i in places], places, [x for x in b[n : len(b) - m] if x in in_a])
    return {*range(n), *range(len(a) - m, len(a)), *found}


def _digests(page: list[tuple[str, int]]) -> list[int]:
    return [xxhash.xxh64_intdigest(t) for t, zone in page if zone != TRUSTED]


def main_text(page: str, partner: list[int] | None) -> tuple[str, int, int]:
    """(text of a page, lines outside articles that its partner shares, other lines that go by markup); partner: line digests of its nearest page."""
    found = lines(page)
    kept = [t for t, zone in found if zone == TRUSTED]
    rest = [(t, zone) for t, zone in found if zone != TRUSTED]
    gone = shared(_digests(rest), partner) if partner else set()
    marked = sum(i not in gone and (zone == NOISY or bool(kept)) for i, (_, zone) in enumerate(rest))
    if not kept:
        plain = [(i, t) for i, (t, zone) in enumerate(rest) if zone == PLAIN]
        kept = [t for i, t in plain if i not in gone] or [t for _, t in plain]
    return "\n\n".join(kept), len(gone), marked


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"[?#].*$", "")


def partners(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(page, partner) by keys of distinct pages; pages alone on their host have none. pages: key, host, path."""
    order = pages.dropDuplicates(["key"]).orderBy("host", "path", "key").withColumn("mark", F.monotonically_increasing_id())
    order = scratch.save(order, "order")
    part, bits = F.shiftright("mark", 33), 33
    sizes = order.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row for each partition of the sort
    at, rows = 0, []
    for r in sizes.orderBy("part").collect():
        rows.append((r["part"], at))
        at += r["n"]
    starts = pages.sparkSession.createDataFrame(rows, "part long, start long")
    placed = order.withColumn("part", part).join(F.broadcast(starts), "part").select("key", "host", "path", (F.col("start") + F.col("mark") - F.shiftleft("part", bits)).alias("g"))
    a = placed.select("g", "key", "host", F.split("path", "/").alias("segments"))
    b = a.select((F.col("g") + 1).alias("g"), F.col("key").alias("before"), F.col("host").alias("host_b"), F.col("segments").alias("segments_b"))
    pair = a.join(b, "g").filter("host = host_b")
    n = F.least(F.size("segments"), F.size("segments_b"))
    common = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.slice("segments", 1, i) == F.slice("segments_b", 1, i)))
    pair = pair.select("key", "before", common.alias("common"))
    # the earlier neighbour wins a tie
    both = pair.select("key", F.struct("common", F.lit(1).alias("earlier"), F.col("before").alias("other")).alias("x")).unionByName(
        pair.select(F.col("before").alias("key"), F.struct("common", F.lit(0).alias("earlier"), F.col("key").alias("other")).alias("x"))
    )
    return both.groupBy("key").agg(F.max("x").alias("x")).select("key", F.col("x.other").alias("partner"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: id, url, text, n_chars, and how many lines went by differencing (n_shared) and by markup (n_marked).

    The sort carries keys only. Line digests of partners meet their pages in one join by page key,
    the only shuffle of html.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    kind = pages.schema[id_col].dataType.simpleString()
    page = pages[html_col].cast("string")
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), F.xxhash64(pages[id_col].cast("string"), pages[url_col].cast("string"), page).alias("key"), page.alias("html"))
    links = partners(rows.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), scratch)

    def digest(batches):
        for batch in batches:
            found = [np.array(_digests(lines(h or "")), np.uint64).tobytes() for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["partner", "digests"])

    def text(batches):
        for batch in batches:
            found = [main_text(h or "", np.frombuffer(d, np.uint64).tolist() if d else None) for h, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            out, *counts = zip(*found, strict=True) if found else ([], [], [])
            more = [pa.array(c, pa.int64()) for c in (list(map(len, out)), *counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), *more], ["id", "url", "text", "n_chars", "n_shared", "n_marked"])

    digests = rows.select("key", "html").mapInArrow(digest, "partner long, digests binary").filter(F.length("digests") > 0).dropDuplicates(["partner"])
    near = links.join(digests, "partner").select("key", "digests")
    joined = rows.join(near, "key", "left").select("id", "url", "html", "digests")
    return joined.mapInArrow(text, f"id {kind}, url string, text string, n_chars long, n_shared long, n_marked long").withColumnRenamed("id", id_col)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
