"""Main text of web pages by equivalence-class template deduction (operator 1).

Pages of a host are printed from a few templates.  A page's outermost article and main elements, or its body, are its
slots; pages of a host with the same slots are a layout group.  A page gives its tokens: containers, told apart by the
path of containers around them, and pieces of text in them.  The occurrence vector of a token says how often it is in
each page of the group; tokens with equal vectors form an equivalence class.  Vectors are never gathered: each token adds
up hashes of (page, count) bit by bit, each page once, with partial aggregation, so equal sums mean equal vectors and a host of any size costs one
row for each token.  Classes of enough pages and members are valid, unless their texts are most of the text of the pages that
have them, all taken together: those pages are copies of an article.  A text of a valid class is the template's and left out
if it nests in the template: its container is of a valid class too, or equally often in all pages that have it.  Tags and names of menus, footers, adverts or comments are a help beside this: what they
mark is left out too, unless it holds the page's main element or most of the text of the page or of the host's pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, batch

#: Share of a host's pages that a valid class must occur in.
SUPPORT = 0.5
#: Pages that a token must occur in, and tokens of a valid class, whatever the host's size.
LEAST, MEMBERS = 3, 2

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE_END = re.compile(r"[\"'>]")
NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
CONTAINERS = frozenset("html body main article section div header footer nav aside form table ul ol dl figure blockquote details dialog fieldset".split())
#: Elements whose text is never the article's.
SILENT = frozenset("head title script style noscript template svg math iframe object embed canvas audio video select option textarea button input label fieldset form nav header footer aside menu dialog".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption pre address hr figcaption summary center tbody thead tfoot hgroup legend optgroup".split())
#: A start tag of these ends an open p.
ENDS_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption li dt dd html body summary legend".split())
#: Words in a class, id or role that say what a wrapper is for, and words that may stand beside them in a name.
OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promoted nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar "
    "aside rail widget widgets related recommended recommendations share sharing social comment comments commentlist respond discussion disqus notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription "
    "signup login search searchbox copyright legal disclaimer pager pagination skip toolbar contentinfo complementary alert hidden".split()
)
BESIDE = frozenset("site global top bottom left right primary secondary main slot box container wrapper wrap block area bar list links link section unit posts articles stories".split())
#: Share of the text that a named wrapper must hold for its name not to count, and a class for its pages to be copies.
MOST = 0.5


def tag_end(page: str, at: int, unclosed: set[str]) -> tuple[int, int]:
    """Where a start tag's attributes end, and where the page goes on.

    A sign > within a quoted value is part of it; a quote opens a value only behind an equals sign and if it is closed.
    ``unclosed`` remembers which quotes no later place closes, so a page is read once however broken it is.
    """
    while m := ATTRIBUTE_END.search(page, at):
        sign = m[0]
        if sign == ">":
            return m.start(), m.end()
        at = m.end()
        if sign not in unclosed and page[max(0, at - 20) : at - 1].rstrip().endswith("="):
            close = page.find(sign, at)
            if close < 0:
                unclosed.add(sign)
            else:
                at = close + 1
    return len(page), len(page)


def events(page: str):
    """(kind, name, attributes, text) of a page: text with references as they are, start and end tags; raw text is
    dropped.  Linear in the page's length."""
    at, end, unclosed = 0, len(page), set()
    while at < end:
        tag = page.find("<", at)
        while 0 <= tag < end - 1 and page[tag + 1] not in "!?/" and not TAG_NAME.match(page, tag + 1):
            tag = page.find("<", tag + 1)
        if tag < 0 or tag == end - 1:
            yield "text", "", "", page[at:]
            return
        if tag > at:
            yield "text", "", "", page[at:tag]
        after = page[tag + 1]
        if page.startswith("<!--", tag):
            close = page.find("-->", tag + 4)
            at = close + 3 if close >= 0 else end
        elif after in "!?":
            close = page.find(">", tag)
            at = close + 1 if close >= 0 else end
        elif after == "/":
            close = page.find(">", tag)
            name = TAG_NAME.match(page, tag + 2)
            at = close + 1 if close >= 0 else end
            if name:
                yield "end", name[0].lower(), "", ""
        else:
            name = TAG_NAME.match(page, tag + 1)
            stop, at = tag_end(page, name.end(), unclosed)
            attributes = page[name.end() : stop]
            name = name[0].lower()
            yield "start", name, attributes, ""
            if name in RAW and not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = close.start() if close else end


def says_other(value: str) -> bool:
    """Whether a whole token of a class, id or role is one of OTHER, alone or with nothing but words of BESIDE.

    'has-sidebar' or 'article-header' name something else than a sidebar or a page's header.
    """
    for token in value.lower().split():
        parts = [p for p in re.split(r"[-_#]+", token) if p]
        if any(p in OTHER for p in parts) and all(p in OTHER or p in BESIDE for p in parts):
            return True
    return False


def marks(attributes: str) -> tuple[str, bool, bool]:
    """The label of a container (class, id and role, digits as one sign), whether it is hidden, and whether its names say
    that it is for something else than the article."""
    label, hidden, other = [], False, False
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role", "itemprop"):
            value = re.sub(r"\d+", "#", value.strip())
            label.append(f"{name[0]}={value}")
            other |= says_other(value)
        else:
            hidden |= name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)))
    return "|".join(label), hidden, other


class Open:
    """An open container: ``path`` is a hash of it and all around it, ``chars`` the text in it so far."""

    __slots__ = ("name", "path", "silent", "at", "named", "main", "above", "under_named", "slot", "chars")

    def __init__(self, name: str, path: int, silent: bool, at: int, named: bool, main: int, above: Open | None):
        self.name, self.path, self.silent, self.at, self.named, self.main, self.above = name, path, silent, at, named, main, above
        self.under_named = named or (above is not None and above.under_named)
        outer = above.slot if above is not None else 0
        self.slot = outer or (path if main and not silent else 0)  # the outermost article or main element around it
        self.chars = 0


class Walk:
    """Follows a page's containers; unclosed and stray tags don't disturb it, and no step depends on the depth.

    ``off`` has the start tags (their numbers among the events) of wrappers whose names count; ``closed`` is told every
    container that ends, with all the text in it.
    """

    def __init__(self, off: frozenset[int] | set[int] = frozenset(), closed=None):
        self.off, self.closed = off, closed
        self.stack: list[Open] = []
        self.open = Counter()

    @property
    def top(self) -> Open | None:
        return self.stack[-1] if self.stack else None

    def start(self, name: str, attributes: str, at: int = -1) -> bool:
        """Whether it is a container (or a silent element), which is then open."""
        other = False
        if name in VOID or name not in CONTAINERS and name not in SILENT:
            if not attributes or name in VOID:
                return False
            label, hidden, _ = marks(attributes)  # what isn't a wrapper is silent only if it is hidden
            if not hidden:
                return False
        else:
            label, hidden, other = marks(attributes) if attributes else ("", False, False)
        if name == "body" or name == "html":
            if self.open[name]:
                return False  # a page has one
            hidden = other = False
        if name == "body":  # a head that wasn't closed ends here
            self._cut(1 if self.stack and self.stack[0].name == "html" else 0)
        above = self.top
        silent = (above is not None and above.silent) or hidden or name in SILENT or at in self.off
        main = 2 if name == "article" or "i=articleBody" in label else 1 if name == "main" or "r=main" in label else 0
        self.stack.append(Open(name, within(above.path if above else 0, of_text(f"{name}[{label}]")), silent, at, other, main, above))
        self.open[name] += 1
        return True

    def text(self, n: int) -> None:
        if self.stack:
            self.stack[-1].chars += n

    def end(self, name: str) -> bool:
        """Whether this closes a container, with all that is open in it."""
        if not self.open[name]:
            return False
        i = len(self.stack) - 1
        while self.stack[i].name != name:
            i -= 1
        self._cut(i)
        return True

    def _cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            last = self.stack.pop()
            self.open[last.name] -= 1
            if last.above is not None:
                last.above.chars += last.chars
            if self.closed:
                self.closed(last)

    def finish(self) -> None:
        self._cut(0)

    @property
    def silent(self) -> bool:
        return bool(self.stack) and self.stack[-1].silent


@lru_cache(maxsize=4096)
def of_text(text: str) -> int:
    """64 bits for a text: blanks as one, digits as one sign."""
    key = re.sub(r"[0-9]+", "#", " ".join(text.split())).encode("utf-8", "surrogatepass")
    return int.from_bytes(blake2b(key, digest_size=8).digest(), "little")


def within(container: int, what: int) -> int:
    """64 bits, signed, for something in a container."""
    x = (container * 0x9E3779B97F4A7C15 + what) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 27
    return x - (x >> 63 << 64)


def token(container: int, text: str) -> int:
    """64 bits for a piece of text in a container."""
    return within(container, of_text(text) if len(text) < 200 else of_text.__wrapped__(text))


def silenced(found: list, loud: frozenset[int] = frozenset()) -> set[int]:
    """Start tags (numbers of the events) of wrappers whose names silence them.

    Names are evidence only: a wrapper that holds the page's main element or most of its text isn't silent, nor is one
    whose path the host's template gives most of the text (``loud``).
    """
    named: dict[int, Open] = {}
    mains: list[Open] = []
    total = 0
    walk = Walk()
    for at, (what, name, attributes, text) in enumerate(found):
        if what == "start":
            if walk.start(name, attributes, at) and not walk.silent:
                if walk.top.named:
                    named[at] = walk.top
                if walk.top.main:
                    mains.append(walk.top)
        elif what == "end":
            walk.end(name)
        elif not walk.silent and (n := len(text.strip())):
            total += n
            walk.text(n)
    walk.finish()
    if not named:
        return set()
    full = [m for m in mains if m.chars]
    best = max([m for m in full if not m.under_named] or full, key=lambda m: (m.chars, -m.at), default=None)
    holds = set()
    while best is not None:
        holds.add(best.at)
        best = best.above
    return {at for at, x in named.items() if x.chars < MOST * total and at not in holds and x.path not in loud}


def outline(found: list, off: set[int]) -> frozenset[int]:
    """Paths of the page's outermost article and main elements with text: its slots.  None: the whole body is the slot."""
    walk, slots = Walk(off), set()
    for at, (what, name, attributes, text) in enumerate(found):
        if what == "start":
            walk.start(name, attributes, at)
        elif what == "end":
            walk.end(name)
        elif walk.stack and walk.top.slot and not walk.silent and text.strip():
            slots.add(walk.top.slot)
    return frozenset(slots)


def layout(host: int, slots: frozenset[int], found: list) -> int:
    """The layout group of a page: pages of a host with the same slots, or without any under the same body, share a
    template."""
    if not slots:
        walk = Walk()
        for what, name, attributes, _ in found:
            if what == "start" and walk.start(name, attributes) and name not in SILENT and name != "html":
                slots = frozenset([walk.top.path])  # the first container, as a rule the body
                break
            if what == "end":
                walk.end(name)
    out = host
    for path in sorted(slots):
        out = within(out, path)
    return out


#: Kinds of rows: a page of a layout group, a container and a piece of text in it, a named wrapper of a host.
PAGE, CONTAINER, TEXT, NAME = range(4)


def profile(host: int, page: str):
    """(site, token, container, kind, occurrences, characters, characters of the page) of a page; the site is its layout
    group, for named wrappers its host."""
    found = list(events(page))
    off = silenced(found)
    site = layout(host, outline(found, off), found)
    count, chars, length, up, total = Counter(), Counter(), Counter(), {}, 0

    def closed(x: Open) -> None:
        if x.named and not x.silent:
            chars[x.path] += x.chars

    walk = Walk(closed=closed)
    for what, name, attributes, text in found:
        if what == "start":
            if walk.start(name, attributes) and not walk.silent:
                key = walk.top.path
                count[key, CONTAINER] += 1
                up[key] = key
        elif what == "end":
            walk.end(name)
        elif not walk.silent and walk.stack and (n := len(text.strip())):
            total += n
            walk.text(n)
            key = token(walk.top.path, text)
            count[key, TEXT] += 1
            length[key] += n
            up[key] = walk.top.path
    walk.finish()
    yield site, 0, 0, PAGE, 1, 0, 0
    for (key, what), n in count.items():
        yield site, key, up[key], what, n, length[key] if what == TEXT else 0, total
    for key, n in chars.items():
        yield host, key, key, NAME, 1, n, total


TOKENS = "page long, site long, token long, container long, kind int, n int, chars long, total long"


def _profiles(batches):
    schema = pa.schema([("page", pa.int64()), ("site", pa.int64()), ("token", pa.int64()), ("container", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("chars", pa.int64()), ("total", pa.int64())])
    for part in batches:
        out = []
        for host, page, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            out += [(page, *row) for row in profile(host, text or "")]
        if out:
            yield batch(schema, **dict(zip(schema.names, zip(*out, strict=True), strict=True)))


def templates(pages: DataFrame, ws: Workspace, support: float = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """(host, loud: wrappers whose names don't count) and (site, texts: pieces of template text) from (host, page, html)."""
    rows = pages.mapInArrow(_profiles, TOKENS)
    vectors = rows.groupBy("site", "kind", "token").agg(
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("pages"), F.min("container").alias("container"), F.sum("chars").alias("chars"), F.sum("total").alias("total"), (F.min("n") == F.max("n")).alias("regular")
    )
    vectors = ws.table(vectors.filter(F.col("pages") >= LEAST), "vectors")
    loud = vectors.filter((F.col("kind") == NAME) & (F.col("total") > 0) & (F.col("chars") >= MOST * F.col("total"))).groupBy("site").agg(F.collect_list("token").alias("loud")).withColumnRenamed("site", "host")
    number = vectors.filter(F.col("kind") == PAGE).select("site", F.col("pages").alias("all"))
    frequent = vectors.filter(F.col("kind").isin(CONTAINER, TEXT)).join(number, "site").filter(F.col("pages") >= support * F.col("all"))
    # tokens of a class have the same pages, so the same text around them
    classes = frequent.groupBy("site", "vector").agg(F.collect_list(F.struct("token", "kind", "container")).alias("of"), F.sum("chars").alias("own"), F.max("total").alias("text"))
    classes = classes.filter((F.size("of") >= MEMBERS) & (F.col("own") <= MOST * F.col("text")))
    valid = ws.table(classes.select("site", F.explode("of").alias("t")).select("site", "t.*"), "valid")
    # a class nests where the containers of its texts are of valid classes too, or are equally often in all pages that
    # have them
    frame = valid.filter(F.col("kind") == CONTAINER).select("site", F.col("token").alias("container"))
    frame = frame.unionByName(frequent.filter((F.col("kind") == CONTAINER) & F.col("regular")).select("site", F.col("token").alias("container"))).distinct()
    inner = valid.filter(F.col("kind") == TEXT).join(frame, ["site", "container"], "left_semi")
    texts = inner.groupBy("site").agg(F.collect_list("token").alias("texts"))
    return ws.table(loud, "loud"), ws.table(texts, "texts")


def sites(host: pa.Array, page: pa.Array) -> pa.Array:
    """The layout group of each page."""
    out = []
    for h, text in zip(host.to_pylist(), page.to_pylist(), strict=True):
        found = list(events(text or ""))
        out.append(layout(h, outline(found, silenced(found)), found))
    return pa.array(out, pa.int64())


def extract(page: str, loud: frozenset[int] = frozenset(), template: frozenset[int] = frozenset()) -> str:
    """Text of the page's slots, or of its whole body where it has none; blocks on lines of their own.

    Template text is left out, unless nothing else is in the slots.
    """
    found = list(events(page))
    off = silenced(found, loud)
    slots = outline(found, off)  # a slot's containers carry its path
    for drop in (template, frozenset()) if template else (frozenset(),):
        walk, blocks, held = Walk(off), [], []

        def close(held=held, blocks=blocks):
            if held:
                text = " ".join(html.unescape("".join(held)).split())
                if text:
                    blocks.append(text)
                held.clear()

        for at, (what, name, attributes, text) in enumerate(found):
            if what == "start":
                if name in BLOCKS:
                    close()
                elif name == "br":
                    held.append(" ")
                if walk.start(name, attributes, at):
                    close()
            elif what == "end":
                if name in BLOCKS or name in SILENT or (walk.stack and walk.top.name == name):
                    close()
                walk.end(name)
            elif not walk.silent and (not slots or (walk.stack and walk.top.slot in slots)):
                dropped = drop and walk.stack and text.strip() and token(walk.top.path, text) in drop
                held.append(" " if dropped else text)
        close()
        if blocks:
            break
    return "\n".join(blocks)


OUT = "page_id long, url string, text string, n_chars long"


def _extract(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    for part in batches:
        texts = [extract(text or "", frozenset(loud or ()), frozenset(template or ())) for text, loud, template in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
        yield batch(schema, page_id=part.column(0), url=part.column(1), text=texts, n_chars=[len(x) for x in texts])


def distinct(pages: DataFrame) -> DataFrame:
    """(host, page, html) with each page once; only pages that repeat are shuffled."""
    again = pages.groupBy("page").count().filter("count > 1").select("page")
    if again.isEmpty():
        return pages
    return pages.join(again, "page", "left_anti").unionByName(pages.join(again, "page", "left_semi").dropDuplicates(["page"])).select("host", "page", "html")


def extract_pages(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Main text of every row of (page_id, url, html): page_id, url, text, n_chars.

    Character references are decoded, white space within a block is one space, blocks follow each other in page order
    on lines of their own.  A null or empty page gives an empty text, a null url counts as the host ''.  Repeated rows
    give repeated rows and count once for the template; other columns are ignored.
    """
    ws = Workspace(pages.sparkSession, "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host)
    rows = rows.withColumn("host", F.xxhash64("host"))
    # written, so that their size is known: Spark broadcasts them if they are small, else joins and splits hot hosts
    loud, texts = templates(distinct(rows.select("host", F.xxhash64("page_id", "url", "html").alias("page"), "html")), ws, support)
    out = rows.withColumn("site", F.arrow_udf(sites, "long")("host", "html")).join(loud, "host", "left").join(texts, "site", "left")
    return out.select("page_id", "url", "html", "loud", "texts").mapInArrow(_extract, OUT)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
