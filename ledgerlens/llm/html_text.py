"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags; for every block its length, the density of
stop words and the share of its text inside links are known, and whether it stands in a part
that is never main text (menus, page headers and footers, sidebars, forms, adverts, notices,
reader comments: by tag, or by class, id or role) or inside the article.

Pass one decides clear blocks: never-main parts are boilerplate, and long blocks with enough stop
words and few links are content; on a page that has an article both bars are higher outside it by
``OUTSIDE_BAR`` and lower inside it by ``INSIDE_BAR``. Outside articles, link-heavy blocks and
long blocks without stop words are boilerplate too. Inside one, so are menus, that is runs of
short blocks that are nearly all links; other blocks there stay open, as nothing else of an
article may be dropped. Pass two: what is left (short or unclear) takes the label of the nearest
block that pass one decided by its words and links in the same article, or, outside articles, of
the nearest one outside them, or of any if none is decided there. An article without such a block is content.

Content blocks, character references decoded and white space made single, are joined in
page order by a line feed.

Defined cases: null html or url: null html is empty; a page without content gives an empty
text; unclosed tags run to the end of their parent, unclosed comments, scripts and styles to the
end of the page; a tag cut off by the end of the page is dropped; an svg, iframe or template that is self-closed or never closed is empty, and
what object, canvas, noscript and math hold is text like any other; repeated rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

# common function words of the languages served (fixed values; a parameter of `extract`)
STOP_WORDS = frozenset("""
a about all an and are as at be been but by can for from had has have he her his i if in into is it its more no not
of on one or our out she so than that the their them there they this to up was we were which who will with you
au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous ou par pas pour que qui sa
se ses son sur un une vous aber als am auch auf aus bei das dem den der die ein eine einen einer er es für hat ich
im ist mit nach nicht noch nur oder sich sie sind so über um und von war wie wir zu zum zur al como con del desde el
ella entre era eran los las más muy no o para pero por se sin sobre su sus también una y ya
""".split())

BLOCK_TAGS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select
summary table tbody td tfoot th thead title tr ul""".split())
CONTAINER_TAGS = frozenset("""address article aside blockquote body button center dd details dialog div dl dt fieldset
figcaption figure footer form head header hgroup li main menu nav ol pre section select summary table tbody td tfoot th
thead tr ul textarea""".split())
# blocks that hold no other block: the next block tag ends them
LEAF_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
# tags that the next of their kind ends, within the list they stand in
ITEM_TAGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
LIST_TAGS = frozenset("dl menu ol ul".split())
NEVER_TAGS = frozenset("nav aside footer form button select textarea fieldset dialog menu head".split())
RAW_TAGS = ("script", "style")
# parts without page text: dropped up to their close tag, or the tag alone if it has none
SKIPPED_TAGS = frozenset("iframe svg template".split())
SPACE_TAGS = frozenset("br canvas iframe img input noscript object svg template".split())
NEVER_NAMES = frozenset("""ad ads adbox adslot advert advertisement advertising banner breadcrumb breadcrumbs comment comments
commentlist consent cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation
newsletter notice notices notification pager pagination popup privacy promo promoted related reply replies respond
share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets""".split())
# of a paragraph, heading or span these tell the looks
LEAF_NAMES = NEVER_NAMES - {"banner", "header", "masthead"}
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

# how much longer and denser a block beside an article must be to be content by itself
OUTSIDE_BAR = 1.5
# and how much shorter one inside it may be
INSIDE_BAR = 0.5
# inside an article, so many link-heavy blocks in a row with such a share of links are a menu
MENU_BLOCKS, MENU_LINKED = 3, 0.8

# Every part is matched once and never taken back, so a page is scanned in linear time; a tag that
# the page's end cuts off takes the rest with it.
ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW_TAGS) + r")(?=[\s/>])" + ATTRIBUTES + r">.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>" + ATTRIBUTES + r")>"
    r"|<[!?/][^>]*+>"
    r"|<(?P<cut>[a-zA-Z!?/])", re.S | re.I)
NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*")
LETTERS = re.compile(r"[^\W\d_]+")


def _never_by_attributes(attrs: str, names=NEVER_NAMES) -> bool:
    for m in NAMED.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if key == "role" and value.lower() in NEVER_ROLES:
            return True
        if key in ("class", "id") and any(p.lower() in names for p in NAME_PART.findall(value)):
            return True
    return False


def page_blocks(page: str) -> list[dict]:
    """Blocks of a page in order: text, link_chars, never (standing in a never-main part),
    article (number of the enclosing article or main, or None)."""
    blocks: list[dict] = []
    stack: list[tuple[str, bool, int | None]] = []  # open containers: tag, never, article
    pieces: list[str] = []
    linked: list[str] = []
    spans: list[bool] = []  # open spans of the block: never, or inside one
    in_link, articles, at = 0, 0, 0

    def flush():
        text = " ".join("".join(pieces).split())
        if text:
            link = " ".join("".join(linked).split())
            _, never, article = stack[-1] if stack else ("", False, None)
            blocks.append({"text": text, "link_chars": len(link), "never": never, "article": article})
        pieces.clear()
        linked.clear()
        spans.clear()

    def add(raw: str):
        if raw and not (spans and spans[-1]):
            raw = html_lib.unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if in_link:
                linked.append(raw)

    unclosed: set[str] = set()  # skipped tags without a close tag further on
    while m := TOKEN.search(page, at):
        add(page[at:m.start()])
        at = m.end()
        if m["cut"]:
            at = len(page)
            break
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"]:
                add(" ")
            continue
        if tag == "a":
            in_link = 0 if m["close"] else 1
        elif tag in SPACE_TAGS:
            add(" ")
            if tag in SKIPPED_TAGS and tag not in unclosed and not m["close"] and not m["attrs"].endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                else:
                    unclosed.add(tag)
        elif tag == "span":
            if not m["close"]:
                spans.append((bool(spans) and spans[-1]) or _never_by_attributes(m["attrs"], LEAF_NAMES))
            elif spans:
                spans.pop()
        elif tag in BLOCK_TAGS or tag in CONTAINER_TAGS:
            flush()
            in_link = 0
            if stack and stack[-1][0] in LEAF_TAGS:
                stack.pop()
            if tag in LEAF_TAGS:
                if not m["close"]:
                    _, never, article = stack[-1] if stack else ("", False, None)
                    stack.append((tag, never or _never_by_attributes(m["attrs"], LEAF_NAMES), article))
            elif tag in CONTAINER_TAGS:
                if tag in ITEM_TAGS and not m["close"]:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in ITEM_TAGS[tag]:
                            del stack[i:]
                            break
                        if stack[i][0] in LIST_TAGS:
                            break
                if m["close"]:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            del stack[i:]
                            break
                elif not m["attrs"].endswith("/"):
                    _, never, article = stack[-1] if stack else ("", False, None)
                    if tag in ("article", "main"):
                        articles += 1
                        article = articles
                    never = (never or tag in NEVER_TAGS or (tag == "header" and article is None)
                             or (tag not in ("body", "article", "main") and _never_by_attributes(m["attrs"])))
                    stack.append((tag, never, article))
    add(page[at:])
    flush()
    return blocks


def _article_menus(blocks: list[dict], long_chars: int, link_density: float) -> set[int]:
    """Blocks of link lists inside articles: runs of at least ``MENU_BLOCKS`` link-heavy blocks
    of one article that are short on average and hold hardly any text outside links."""
    runs: list[list[int]] = []
    for i, b in enumerate(blocks):
        heavy = b["article"] is not None and not b["never"] and b["link_chars"] > link_density * len(b["text"])
        if heavy and runs and runs[-1][-1] == i - 1 and blocks[i - 1]["article"] == b["article"]:
            runs[-1].append(i)
        elif heavy:
            runs.append([i])
    menus: set[int] = set()
    for run in runs:
        chars = sum(len(blocks[i]["text"]) for i in run)
        linked = sum(blocks[i]["link_chars"] for i in run)
        if len(run) >= MENU_BLOCKS and 2 * chars < long_chars * len(run) and linked > MENU_LINKED * chars:
            menus.update(run)
    return menus


def label_blocks(blocks: list[dict], stop_words=STOP_WORDS, long_chars: int = 140, stop_density: float = 0.15,
                 link_density: float = 0.4) -> list[bool]:
    """Whether each block is main text."""
    has_article = any(b["article"] is not None and not b["never"] for b in blocks)
    # beside an article text needs more to count as content by itself
    bar = OUTSIDE_BAR if has_article else 1.0
    menus = _article_menus(blocks, long_chars, link_density)
    labels: list[bool | None] = []
    for i, b in enumerate(blocks):
        size, inside = len(b["text"]), b["article"] is not None
        weight = INSIDE_BAR if inside else bar
        linked = b["link_chars"] > link_density * size
        found = LETTERS.findall(b["text"].lower())
        density = sum(w in stop_words for w in found) / max(1, len(found))
        if b["never"] or i in menus:
            labels.append(False)
        elif not linked and size >= weight * long_chars and density >= weight * stop_density:
            labels.append(True)
        elif not inside and (linked or (size >= long_chars and density < stop_density)):
            labels.append(False)
        else:
            labels.append(None)
    # second pass: the nearest neighbour that the first decided, each article and the rest apart
    places: dict[int | None, list[int]] = {}
    for j, b in enumerate(blocks):
        if labels[j] is not None and (b["article"] is None or not (b["never"] or j in menus)):
            places.setdefault(b["article"], []).append(j)
    every = [j for j, known in enumerate(labels) if known is not None]
    out = []
    for i, known in enumerate(labels):
        if known is None:
            article = blocks[i]["article"]
            decided = places.get(article) or ([] if article is not None else every)
            after = bisect_left(decided, i)
            near = [(abs(i - j), not labels[j], j) for j in decided[max(0, after - 1):after + 1]]
            known = labels[min(near)[2]] if near else True
        out.append(known)
    return out


def main_text(page: str, **rules) -> str:
    blocks = page_blocks(page)
    return "\n".join(b["text"] for b, keep in zip(blocks, label_blocks(blocks, **rules)) if keep)


def extract(pages: DataFrame, **rules) -> DataFrame:
    """Rows (page_id, url, text) for pages (page_id, url, html)."""
    def run(batches):
        for batch in batches:
            texts = [main_text(h or "", **rules) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    page = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in page.schema.fields}
    return map_batches(page, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
