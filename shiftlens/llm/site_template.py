"""Main text of web pages: site templates are found by counting element subtrees per host.

Every element is hashed with the text below it, those inside main areas and articles too; Spark counts on
how many pages of its host each hash occurs. Subtrees that recur on many pages of a host are template and go, wherever
they stand. Inside main areas and articles copies of one page count once, or a page that is served
many times would be template as a whole. Two things cannot be told by recurrence, and names decide: menus, adverts and footers
whose words change from page to page or whose host has few pages go by their element, role or class, and
what recurs inside an article goes if most of it is links (lists of links, sharing bars); a licence
line or a quotation stays, as it is the article's own text.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.plans.scratch import written

#: A subtree is template when it is on this many pages of its host and on this share of them.
MIN_PAGES = 5
MIN_SHARE = 0.01

# Elements and names of the HTML standard and of common page layouts.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
_ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_ENDS_ITS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIST_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
_BOILERPLATE = set("nav footer aside form head button select dialog menu object audio video canvas map".split()) | _RAW
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer sidebar ad ads advert adverts advertisement banner promo "
    "sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended comment comments reply replies discussion disqus respond search pagination "
    "pager toolbar widget masthead topbar skip".split()
)
_MAIN_NAMES = set("articlebody article-body post-content entry-content article-content post-body main-content".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z0-9]+")


class _Element:
    __slots__ = ("name", "dropped", "area", "root", "texts", "linked", "mark", "slot")

    def __init__(self, name: str, dropped: bool, area: int, slot: str, root: bool = False):
        self.name, self.dropped, self.area, self.slot, self.root = name, dropped, area, slot, root
        self.texts: list[str] = []
        self.linked = 0
        self.mark = 0


def _judged(name: str, attributes: str, inside: int) -> tuple[bool, int, str]:
    """Whether an element is named as boilerplate, its area (2 article, 1 main, 0 neither), its class."""
    dropped, area, label = name in _BOILERPLATE, 0, ""
    if name == "article":
        area = 2
    elif name == "main":
        area = 1
    elif name == "header" and not inside:
        dropped = True
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                label += f" {value}"
                if set(value.split()) & _MAIN_NAMES:
                    area = max(area, 2)
                elif name not in ("html", "body", "main") and (name != "article" or inside) and set(_NAME.findall(value)) & _NAMES:
                    dropped = True
            elif key == "role":
                if value == "main":
                    area = max(area, 1)
                dropped = dropped or (value in _ROLES and name not in ("html", "body"))
            elif key == "itemprop":
                area = max(area, 2 * (value == "articlebody"))
            elif key == "hidden":
                dropped = dropped or not m[0].lower().startswith("hidden=") or value in ("", "hidden")
            elif key == "aria-hidden":
                dropped = dropped or value == "true"
            elif key == "style":
                dropped = dropped or "display:none" in value.replace(" ", "")
    return dropped, area, label


def blocks_of(page: str) -> list[tuple[str, int, list[_Element]]]:
    """The text blocks outside named boilerplate: text, area, and the elements around each one, of a block in an area those inside it.

    Character references are decoded, white space inside a block is one space, empty blocks are left
    out. Unclosed and misplaced tags are taken as browsers do, as far as blocks are concerned.
    """
    out: list[tuple[str, int, list[_Element]]] = []
    stack: list[_Element] = [_Element("#root", False, 0, "")]
    said: list[str] = []
    links: list[str] = []

    def flush() -> None:
        if said:
            text = " ".join(markup.unescape("".join(said)).split())
            said.clear()
            if text:
                area = stack[-1].area
                around = [e for e in stack[1:] if e.name not in ("html", "body") and e.area == area and not e.root]
                out.append((text, area, around))
                if links:
                    linked = len("".join(" ".join(links).split()))
                    for e in around:
                        e.linked += linked
            links.clear()

    def close(to: int) -> None:
        flush()
        del stack[to:]

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if not stack[-1].dropped and not m[0].startswith(("<!", "<?")):
                said.append(m[0])
                if any(e.name == "a" for e in stack):
                    links.append(markup.unescape(m[0]))
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name == "p" and not any(e.name == "p" for e in stack):
                flush()
            elif name in _BLOCK or any(e.name == name for e in stack[1:]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        if name in _BLOCK or stack[i].dropped:
                            close(i)
                        else:
                            del stack[i:]
                        break
                else:
                    flush()
            continue
        if name in _RAW:
            gone = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = gone.start() if gone else end
            if gone:
                at = page.find(">", at) + 1 or end
            continue
        if name == "br" or name == "wbr":
            if name == "br" and not stack[-1].dropped:
                said.append(" ")
            continue
        if name in _ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name in _BLOCK:
                    break
        likes = _ENDS_ITS_LIKE.get(name)
        if likes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in likes:
                    close(i)
                    if name != "tr" or not any(e.name in likes for e in stack):
                        break
                elif stack[i].name in _LIST_SCOPE[name]:
                    break
        if name == "body":
            for i, e in enumerate(stack):
                if e.name == "head":
                    close(i)
                    break
        if name in _BLOCK:
            flush()
        if name in _VOID:
            continue
        top = stack[-1]
        if top.dropped or (name not in _BLOCK and not m[3] and not m[6] and name not in _BOILERPLATE):
            dropped, area, label = top.dropped, top.area, ""
        else:
            dropped, area, label = _judged(name, m[3] or m[6] or "", top.area)
            if dropped and name not in _BLOCK:
                flush()
            dropped, area = dropped or top.dropped, max(area, top.area)
        stack.append(_Element(name, dropped, area, f"{name}{label}", area > top.area))
    close(1)
    return out


def _marks(blocks: list[tuple[str, int, list[_Element]]]) -> None:
    """Hash every element with all the text below it; inside articles only those that are mostly links."""
    elements = {id(e): e for _, _, around in blocks for e in around}
    for text, _, around in blocks:
        for e in around:
            e.texts.append(text)
    for e in elements.values():
        if e.area < 2 or 2 * e.linked > sum(len("".join(t.split())) for t in e.texts):
            key = "\0".join([*["main"] * bool(e.area), e.slot, *e.texts])
            e.mark = int.from_bytes(blake2b(key.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) or 1


def _host() -> F.Column:
    return F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, text, blocks, marks, inner, copy``: every page, parsed once.

    ``text`` is the text of the article, or of the main area, if no count can change it, and null on other pages;
    then ``blocks`` holds the blocks of that area, or of the page, with the hashes of the subtrees around each. ``marks`` are the
    page's distinct subtrees outside main areas, ``inner`` those inside, ``copy`` is a hash of the page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("text", pa.string()), ("marks", pa.list_(pa.int64()))]))
        for batch in batches:
            texts, loose, marks, inner, copies = [], [], [], [], []
            for page in batch.column("html"):
                whole = page.as_py() or ""
                blocks = blocks_of(whole)
                _marks(blocks)
                best = max((area for _, area, _ in blocks), default=0)
                main = [{"text": text, "marks": [e.mark for e in around if e.mark]} for text, area, around in blocks if area == best]
                settled = not blocks or best and not any(b["marks"] for b in main)
                texts.append(" ".join(b["text"] for b in main) if settled else None)
                loose.append([] if settled else main)
                marks.append(list({e.mark for _, area, around in blocks if not area for e in around}))
                inner.append(list({e.mark for _, area, around in blocks if area for e in around if e.mark}))
                copies.append(int.from_bytes(blake2b(whole.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"), batch.column("host"), pa.array(texts, pa.string()),
                    pa.array(loose, block), pa.array(marks, pa.list_(pa.int64())), pa.array(inner, pa.list_(pa.int64())), pa.array(copies, pa.int64()),
                ],
                ["page_id", "url", "host", "text", "blocks", "marks", "inner", "copy"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", _host().alias("host"), "html").mapInArrow(
        run,
        f"page_id {kind}, url string, host string, text string, "
        "blocks array<struct<text:string,marks:array<bigint>>>, marks array<bigint>, inner array<bigint>, copy bigint",
    )


def template_subtrees(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, mark``: the subtrees that recur on many pages of their host.

    Rows are counted per host and hash, summed before the shuffle, so a host with a third of all
    pages is spread by its hashes. Inside main areas copies of one page count once.
    """
    on_host = parsed.groupBy("host").agg(F.count("*").alias("pages"))
    inside = parsed.select("host", "copy", F.explode("inner").alias("mark")).distinct().select("host", "mark")
    seen = parsed.select("host", F.explode("marks").alias("mark")).unionByName(inside)
    often = seen.groupBy("host", "mark").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return often.join(on_host, often.host.eqNullSafe(on_host.host)).where(F.col("n") >= min_share * F.col("pages")).select(often.host, "mark")


def extract_main_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``).

    A null or empty page has the empty text. A null url belongs to no host: recurrence is then counted
    among all pages without one. Repeated rows are kept and count as pages of their own; a row without
    a ``page_id`` keeps recurring subtrees, as nothing ties it to them. Other columns are not read.
    """
    parsed = written(parsed_pages(pages.select("page_id", "url", "html")), "parsed")
    template = template_subtrees(parsed, min_pages, min_share)
    loose = parsed.where("text is null").select("page_id", "host", F.explode(F.concat("marks", "inner")).alias("mark"))
    found = loose.join(template, loose.host.eqNullSafe(template.host) & (loose.mark == template.mark))
    removed = found.groupBy("page_id").agg(F.collect_set(loose.mark).alias("gone"))
    left = F.filter("blocks", lambda b: ~F.arrays_overlap(b["marks"], F.coalesce("gone", F.array().cast("array<bigint>"))))
    text = F.coalesce("text", F.array_join(F.transform(left, lambda b: b["text"]), " "))
    whole = parsed.where("text is not null").select("page_id", "url", "text")
    rest = parsed.where("text is null").join(removed, "page_id", "left").select("page_id", "url", text.alias("text"))
    return whole.unionByName(rest).withColumn("n_chars", F.char_length("text").cast("bigint"))
