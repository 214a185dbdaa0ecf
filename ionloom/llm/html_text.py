"""Main text of web pages, with boilerplate found by a host suffix array.

A page is scanned once into text blocks. Structure settles most of them: what lies in menus,
headers, footers, sidebars, forms, notices, adverts, comments of readers, scripts or styles is
out, and where a page names its article (article, main, role=main) that container is its text, with a
first-level heading right before it. A class or id counts as a name of boilerplate only if all its words
are such names or say nothing (`post-comments`, not `comment-on-law`).

Then the host votes on every page: the streams of a host's pages are taken as one text, its suffixes are brought
together by (host, leading tokens), and a lead that starts on at least `MIN_PAGES` pages with differing
bodies, and on half of the host's, is boilerplate. Covered parts are removed, unique runs stay:

- In pages with an article the stream's tokens are whole blocks, and suffixes are cut at two of them: neighbouring
  blocks that recur together make a run, and runs of `LONG` words or more go. A sentence that some articles
  quote stays, whatever its length.
- In pages without one, tokens are words and suffixes are cut at `LEAD` of them.

A page is never emptied by the vote: where nothing is unique, everything stays. Equal bodies count as one page, so two
copies of a page leave each other alone.

Suffixes travel as 128-bit hashes with their host and body and are counted in partial aggregates, so neither a
host nor a line that most pages share is gathered; repeated leads are written out before they are joined, so the
partition of a frequent one can be split. Pages are parsed once; their blocks are kept in a stage table.

Defined cases: null html is an empty page with empty text; a null url has the host ''; unclosed tags
end with their container; svg, math and other elements without text of the page end like any other and
may close themselves; an article in an excluded container is out unless the page has no other text; character references are decoded once; white space inside a block becomes
one blank; blocks are joined by a blank line; equal rows are pages of their own but not distinct.
"""

from __future__ import annotations

import html as entities
import re
from itertools import pairwise
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import KEY, arrow_map, key_columns
from ionloom.session import stage

LEAD = 8
#: Words of a run of blocks, distinct bodies that share a lead, and their share of the host's, from which on it is boilerplate.
LONG, MIN_PAGES, SHARE = 5, 5, 0.5
JOIN = "\n\n"

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
#: Elements whose content is no markup, with their end.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "iframe")}
#: Elements whose text is never the page's, also in the middle of a block.
DROPPED = frozenset("noscript template svg math object canvas".split())
#: In these, a tag that closes itself is empty whatever its name.
FOREIGN = frozenset({"svg", "math"})
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the first kind ends where one of the second begins.
CLOSES = {
    "p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"},
}
OUT = frozenset("head nav header footer aside form button select dialog menu search audio video fieldset input label".split())
OUT_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words that name boilerplate in class and id.
OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs sidebar side-bar aside footer foot header masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices alert newsletter subscribe subscription signup paywall popup modal overlay share sharing social related recommended "
    "recommendations comment comments commentlist reply replies respond disqus discussion pagination pager widget".split()
)
#: Words beside them that say nothing of the content.
NEUTRAL = frozenset(
    "box block wrap wrapper container content section area zone slot unit region panel inner outer list item items link links button buttons "
    "top bottom left right main page site post posts article articles entry user blog global primary secondary mobile desktop sticky fixed "
    "text title heading icon bar tab form thread first second third".split()
)
#: Per tag: the open elements it ends, each with the containers that shield them.
LISTS = frozenset({"ul", "ol", "dl", "table", "select", "menu"})
ENDS = {tag: [(o, BLOCK - {o} if o == "p" else LISTS) for o, starts in CLOSES.items() if tag in starts] for tag in BLOCK | {"option"}}
NAME_PARTS = re.compile(r"[^a-z0-9]+")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def named_out(value: str) -> bool:
    """A class or id name of boilerplate words, and of words and numbers that say nothing."""
    for name in value.lower().split():
        parts = {p for p in NAME_PARTS.split(name) if p}
        if parts & OUT_NAMES and all(p in OUT_NAMES or p in NEUTRAL or p.isdigit() for p in parts):
            return True
    return False


def is_out(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag == "header" and inside:  # an article's own heading
        return False
    if tag in OUT or attrs.get("role", "").lower() in OUT_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return True
    if tag in ("html", "body", "main"):
        return False
    return named_out(attrs.get("class", "")) or named_out(attrs.get("id", ""))


def blocks(page: str) -> list[tuple[str, bool, bool, bool, bool]]:
    """(text, in an article, out by structure, out only because the article is, first-level heading) of every
    block with text, in page order."""
    found: list[tuple[str, bool, bool, bool, bool]] = []
    #: Open elements: (tag, article depth, out depth outside articles, out depth inside the article, article in an excluded container, dropped).
    stack: list[tuple[str, int, int, int, bool, bool]] = [("", 0, 0, 0, False, False)]
    held: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            _, article, outer, inner, lent, _ = stack[-1]
            found.append((text, article > 0, inner > 0 or lent if article else outer > 0, lent and not inner, any(e[0] == "h1" for e in stack)))

    def close(tag: str, through: frozenset[str] | set[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == tag:
                del stack[i:]
                return
            if stack[i][0] in through:
                return

    at = 0
    while m := TAG.search(page, at):
        if m.start() > at and not stack[-1][5]:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if m[1] or m[4]:
            close(tag)
            continue
        text = m[3] or m[6] or ""
        empty = text.rstrip().endswith("/")
        if tag in RAW and not (empty and any(s[0] in FOREIGN for s in stack)):
            end = RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        for open_tag, container in ENDS.get(tag, ()):
            close(open_tag, container)
        if tag in VOID:
            continue
        attrs = attributes(text) if text.strip() else {}
        _, article, outer, inner, lent, dropped = stack[-1]
        role = attrs.get("role", "").lower()
        if tag in ("article", "main") or role in ("main", "article"):
            reader = tag == "article" and (named_out(attrs.get("class", "")) or named_out(attrs.get("id", "")))
            if reader:
                inner, outer = inner + 1, outer + 1
            else:
                lent = lent or not article and outer > 0 and (tag == "article" or role == "article")
                article += 1
        elif is_out(tag, attrs, article > 0):
            inner, outer = inner + (article > 0), outer + (article == 0)
        if not empty or tag in BLOCK:
            stack.append((tag, article, outer, inner, lent, dropped or tag in DROPPED))
    if not stack[-1][5]:
        held.append(page[at:])
    flush()
    return found


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def lead_hash(*parts: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest("\x00".join(parts))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def word_leads(host: str, texts: list[str], lead: int) -> list[tuple[int, int]]:
    """Suffixes of the words, cut at `lead` of them; a shorter stream has one."""
    tokens = " ".join(texts).split()
    return [lead_hash("w", host, *tokens[i : i + lead]) for i in range(max(1, len(tokens) - lead + 1) if tokens else 0)]


def block_leads(host: str, texts: list[str]) -> list[tuple[int, int]]:
    """Suffixes of the blocks, cut at one (first) and at two of them (behind)."""
    return [lead_hash("b", host, t) for t in texts] + [lead_hash("p", host, a, b) for a, b in pairwise(texts)]


def without_covered(texts: list[str], starts: list[int], lead: int) -> list[str]:
    """The unique runs of words: those that no repeated lead covers."""
    tokens = " ".join(texts).split()
    covered = bytearray(len(tokens))
    for s in starts:
        covered[s : s + lead] = b"\x01" * len(covered[s : s + lead])
    kept, at = [], 0
    for text in texts:
        words = text.split()
        unique = [w for i, w in enumerate(words) if not covered[at + i]]
        at += len(words)
        if unique:
            kept.append(" ".join(unique))
    return kept


def without_runs(texts: list[str], starts: list[int]) -> list[str]:
    """The blocks outside of runs of repeated blocks that are long enough."""
    n = len(texts)
    single = {s for s in starts if s < n}
    joined = {s - n for s in starts if s >= n}
    kept, at = [], 0
    while at < n:
        end = at
        if at in single:
            end = at + 1
            while end < n and end in single and end - 1 in joined:
                end += 1
        if end > at and sum(len(t.split()) for t in texts[at:end]) >= LONG:
            at = end
            continue
        kept += texts[at : max(end, at + 1)]
        at = max(end, at + 1)
    return kept


def scan(page: str | None) -> tuple[bool, list[str]]:
    """(has an article, its text blocks or else the candidates)."""
    found = blocks(page or "")
    first = next((i for i, (_, inside, out, *_) in enumerate(found) if inside and not out), None)
    article = first is not None
    body = [t for t, inside, out, *_ in found if not out and (inside or not article)]
    if article and first and not found[first][4]:
        text, inside, out, _, heading = found[first - 1]
        if heading and not inside and not out:  # the article's heading stands right before it
            body.insert(0, text)
    if not body:  # a page's only text, whatever its wrapper is called
        body = [t for t, _, _, lent, _ in found if lent]
        article = bool(body)
    return article, body


PARSED = "host bigint, body_key bigint, article boolean, body array<string>, l1 array<bigint>, l2 array<bigint>"


def parsed(pages: DataFrame, lead: int) -> DataFrame:
    """(page_id, url, keys, host, body_key, article, body, l1, l2): the text blocks of every page and its leads."""

    def fn(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = []
        for url, page in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("url", "html")), strict=True):
            article, body = scan(page)
            host = host_of(url)
            own = block_leads(host, body) if article else word_leads(host, body, lead)
            keys = lead_hash("host", host)[0], lead_hash("body", *body)[0]
            rows.append((*keys, article, body, [a for a, _ in own], [b for _, b in own]))
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = zip(*rows, strict=True) if rows else [[]] * len(types)
        return {f.split()[0]: pa.array(v, t) for f, v, t in zip(PARSED.split(", "), columns, types, strict=True)}

    plain = pages.select("page_id", "url", "html", *key_columns("page_id", "url", "html"))
    return arrow_map(plain, fn, PARSED, ["page_id", "url", *KEY])


def repeated_leads(rows: DataFrame) -> DataFrame:
    """(l1, l2) of the leads that enough pages of a host with differing bodies have."""
    bodies = rows.select("host", "body_key").distinct()
    totals = stage(bodies.groupBy("host").agg(F.count("*").alias("total")).filter(F.col("total") >= MIN_PAGES), "hosts")
    leads = rows.select("host", "body_key", F.explode(F.arrays_zip("l1", "l2")).alias("h")).select("host", "body_key", "h.l1", "h.l2")
    met = leads.distinct().groupBy("host", "l1", "l2").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_PAGES)
    return met.join(totals, "host").filter(F.col("n") >= SHARE * F.col("total")).select("l1", "l2")


def main_text(pages: DataFrame, lead: int = LEAD) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = stage(parsed(pages, lead), "parsed_pages", "zstd")
    repeated = stage(repeated_leads(rows), "repeated")
    placed = rows.select(*KEY, F.posexplode(F.arrays_zip("l1", "l2")).alias("at", "h")).select(*KEY, "at", "h.l1", "h.l2")
    covered = stage(placed.join(repeated, ["l1", "l2"]).groupBy(*KEY).agg(F.collect_set("at").alias("starts")), "covered")

    def unique_runs(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = []
        for article, body, starts in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("article", "body", "starts")), strict=True):
            left = without_runs(body, starts) if article else without_covered(body, starts, lead)
            texts.append(JOIN.join(left or body))
        return {"text": pa.array(texts, pa.string())}

    own = rows.select("page_id", "url", *KEY, "article", "body")
    untouched = own.join(covered.select(*KEY), KEY, "left_anti").select("page_id", "url", F.array_join("body", JOIN).alias("text"))
    judged = own.join(covered, KEY).select("page_id", "url", "article", "body", "starts")
    both = untouched.unionByName(arrow_map(judged, unique_runs, "text string", ["page_id", "url"]))
    return both.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
