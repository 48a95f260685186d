"""Main-text extraction by equivalence-class template deduction.

Distinct pages of a host come from few templates.  Every start tag (with its
path of names and classes) and every text block (with its path and words) is a
token; its occurrence vector holds how often it occurs on each page of the
host.  Tokens with equal vectors form an equivalence class.  A host's large and
frequent classes whose tokens stand in one order, and each of which lies in one
gap of the class around it, are nested into its template.  What a page has
between the template's tokens is its slots; the innermost template element that
holds most of a host's slot text is the main region.  An ``<article>`` or
``<main>`` around or inside the region takes its place, and roles and class
words take adverts, forms and comments out of it; on pages without a template,
roles decide alone.

Vectors are never built: each (page, count) pair is hashed and the hashes are
combined with exclusive or, so the vectors of a host with any number of pages
are compared by one aggregate that tasks combine first.
"""

from __future__ import annotations

import bisect
import functools
import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common
from .url_graph import host_of

#: A class needs as many tokens, and its tokens as many pages and this share of the host's pages.
CLASS_TOKENS, CLASS_PAGES, CLASS_SHARE = 3, 4, 0.5

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-z]+")
ROLE_MAIN = re.compile(r"role\s*=\s*[\"']?main", re.I)
DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table"
    " tbody tfoot thead tr ul".split()
)
#: Elements whose end tag may be missing before another of the same kind.
LOOSE = frozenset("p li dt dd tr td th option thead tbody tfoot".split())
#: Elements that can be a region of a page.
CONTAINERS = frozenset("html body main article section div table tbody tr td center".split())
#: Never main text, wherever they stand.
OUTSIDE = frozenset("head nav footer aside form menu dialog button select option label fieldset".split())
#: Words in class, id or role that mark what surrounds an article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu menubar nav navbar"
    " navigation breadcrumb breadcrumbs footer comment comments respond disqus notice notices alert cookie cookies consent gdpr"
    " newsletter subscribe signup login share sharing social related recommended popup modal overlay widget complementary"
    " contentinfo search toolbar pagination pager".split()
)
HEADERS = frozenset(("header", "masthead", "topbar"))


def _label(attributes: str) -> str:
    """Class and id of an element without their digits, which often number pages."""
    out = ""
    if "class" in attributes or "id" in attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            if name.lower() in ("class", "id"):
                out += "." + DIGITS.sub("", value.strip("\"'").lower())
    return out


def _marked(attributes: str, inside: bool) -> bool:
    """Whether an element's class, id or role marks it as outside of the main text."""
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id", "role"):
            words = set(NAME.findall(value))
            if words & MARKED or not inside and words & HEADERS:
                return True
    return False


class Container(NamedTuple):
    """An open element that can be a region: the token of its start tag, its name, its depth, and the one around it."""

    token: int
    name: str
    depth: int
    outer: Container | None


def _chain(c: Container | None) -> Iterator[Container]:
    while c is not None:
        yield c
        c = c.outer


#: What surrounds a page: name, place, outside, zone, container, whether in a heading.
TOP = ("", 0, False, 1, None, False)


class Block(NamedTuple):
    """A text block: its place, its text, its zone (0 outside the main text, 1 body, 2 main element, 3 article), the containers around it."""

    place: int
    text: str
    zone: int
    around: Container | None
    heading: bool


def blocks(page: str | None, roles: bool = True) -> tuple[list[Block], list[tuple[int, int]]]:
    """Text blocks and start tags (token, how many blocks came before) of a page, in order.

    A place is a hash of the labels on the way to an element, so that deep pages cost no more than flat ones.
    """
    page = page or ""
    found: list[Block] = []
    tags: list[tuple[int, int]] = []
    stack: list[tuple] = []  # as TOP
    text: list[str] = []
    times: dict[int, int] = {}
    at, n = 0, len(page)

    def close() -> None:
        if text:
            # references are decoded last, so that a decoded < opens no tag
            whole = " ".join("".join(text).split())
            text.clear()
            if whole:
                _, place, out, zone, around, heading = stack[-1] if stack else TOP
                found.append(Block(place, whole, 0 if roles and out else zone, around, heading))

    while at < n:
        m = MARKUP.search(page, at)
        if m is None:
            text.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            text.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                close()
            if name == "br":
                text.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if any(x[0] in BLOCK for x in stack[i:]):
                        close()
                    del stack[i:]
                    break
            continue
        outer = stack[-1] if stack else TOP
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            tags.append((_hash(f"{outer[1]}/{name}"), len(found)))  # raw text is no block
            if m[3].endswith("/") and name in ("svg", "math", "object"):
                continue
            at = end.end() if end else n
            continue
        if name in BLOCK:
            close()
            if name in LOOSE or name[0] == "h":
                while stack and stack[-1][0] not in BLOCK:
                    stack.pop()  # inline elements left open end with their block
                if stack and stack[-1][0] == "p" and name != "head":
                    stack.pop()
                if stack and stack[-1][0] == name and name in LOOSE:
                    stack.pop()
            elif stack:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                    elif stack[i][0] in BLOCK:
                        break
            outer = stack[-1] if stack else TOP
        elif name == "br" or name in ("td", "th"):
            text.append(" ")
        inside = outer[3] > 1
        out = outer[2] or name in OUTSIDE or name == "header" and not inside or (name not in ("html", "body", "article", "main") and _marked(m[3], inside))
        if name == "article" and "comment" in m[3].lower():
            out = True
        zone = 3 if name == "article" else max(outer[3], 2) if name == "main" or "main" in m[3] and ROLE_MAIN.search(m[3]) else outer[3]
        place, around = _place(outer[1], name, m[3] if "class" in m[3] or "id=" in m[3] else ""), outer[4]
        if name in CONTAINERS:  # containers of one label are told apart by their order
            nth = times[place] = times.get(place, 0) + 1
            place = _nth(place, nth)
            around = Container(place, name, around.depth + 1 if around else 0, around)
        tags.append((place, len(found)))
        if name not in VOID and not m[3].endswith("/"):
            stack.append((name, place, out, zone, around, outer[5] or name in ("h1", "h2")))
    close()
    return found, tags


def _hash(text: str) -> int:
    """A signed 64-bit hash."""
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "little", signed=True)


@functools.lru_cache(maxsize=1 << 15)
def _place(outer: int, name: str, attributes: str) -> int:
    return _hash(f"{outer}/{name}{_label(attributes)}")


@functools.lru_cache(maxsize=1 << 15)
def _nth(place: int, nth: int) -> int:
    return _hash(f"{place}:{nth}")


def _token(b: Block) -> int:
    return _hash(f"{b.place}\0{b.text}")


def tokens(page: str | None) -> dict[int, list[int]]:
    """Tokens of a page: how often each occurs, and where first."""
    found, tags = blocks(page)
    out: dict[int, list[int]] = {}
    order = sorted([(2 * i + 1, _token(b)) for i, b in enumerate(found)] + [(2 * i, t) for t, i in tags])
    for rank, (_, token) in enumerate(order):
        out.setdefault(token, [0, rank])[0] += 1
    return out


def nested(rows: list[tuple[int, int, int, int, float]]) -> list[tuple[int, bool]]:
    """The template of one host: (token, whether it stands once on each page that has it).

    ``rows`` are frequent tokens (token, vector, pages, times, mean first
    place).  Tokens of equal vectors are a class.  A class is valid if it is
    large and its tokens have places of their own.  From the most frequent
    class on, each is taken if it nests: all of it lies in one gap between
    neighbouring tokens of the classes taken before, of which it is a part, or
    around or beside them.
    """
    classes: dict[tuple, list[tuple[float, int]]] = {}
    for token, vector, pages, times, place in rows:
        classes.setdefault((vector, pages, times), []).append((place, token))
    out, taken = [], []
    for (_, pages, times), held in sorted(classes.items(), key=lambda c: (-c[0][1], c[0][2], min(c[1]))):
        places = sorted(p for p, _ in held)
        if len(held) < CLASS_TOKENS or len(set(places)) < len(places):
            continue
        # a class of as many pages may interleave (parts of one frame); a rarer one has to stay in one gap
        wider = [x for n, x in taken if n > pages]
        if any(bisect.bisect(x, places[0]) != bisect.bisect(x, places[-1]) for x in wider):
            continue
        taken.append((pages, places))
        out += [(token, times == pages) for _, token in held]
    return sorted(out)


def main_text(page: str | None, template: dict[int, bool] | None = None, region: int | None = None, roles: bool = True) -> str:
    """The blocks of a page's main zone, less those that are template tokens.

    The zone is the element of the token ``region``; an article or main element
    in or around it goes first, and without one the headings before it, in an
    element around it, belong to it.  If the zone's template blocks hold half
    of its characters, they all stay: a template frames an article, and what
    makes up most of one is text that near copies share.
    """
    found, _ = blocks(page, roles)
    here = _zone(found, region, roles)
    left = [b for b in here if _token(b) not in template] if template else here
    return "\n\n".join(b.text for b in (left if 2 * _chars(left) > _chars(here) else here))


def _chars(held: list[Block]) -> int:
    return sum(len(b.text) for b in held)


def _zone(found: list[Block], region: int | None, roles: bool) -> list[Block]:
    """The blocks of the main zone."""
    held = [next((c for c in _chain(b.around) if c.token == region), None) if region is not None else None for b in found]
    if any(held):
        if roles:
            for zone in (3, 2):
                met = [b for b, c in zip(found, held) if c and b.zone >= zone]
                if met:  # an article elsewhere (a teaser beside the region) is none of it
                    mine = {c.token for b in met for c in _chain(b.around) if c.name in ("article", "main")}
                    return [b for b in found if b.zone >= zone and (not mine or any(c.token in mine for c in _chain(b.around)))]
        first = next(k for k, c in enumerate(held) if c)
        outer = held[first].outer
        before = lambda b: b.heading and any(c is outer for c in _chain(b.around))
        return [b for k, (b, c) in enumerate(zip(found, held)) if (b.zone or not roles) and (c or k < first and before(b))]
    for zone in (3, 2, 1) if roles else (0,):
        if here := [b for b in found if b.zone >= zone]:
            return here
    return []


def _rows(batches):
    for b in batches:
        out: list[tuple] = []
        for host, page in zip(*(c.to_pylist() for c in b.columns)):
            content = xxhash.xxh3_64_intdigest((page or "").encode("utf-8", "surrogatepass"))
            page_of = content >> 1
            for token, (n, rank) in tokens(page).items():
                term = int.from_bytes(xxhash.xxh3_64_digest(f"{content}:{n}".encode()), "little", signed=True)
                out.append((host, token, term, rank, n, page_of))
            out.append((host, 0, 0, 0, 1, page_of))
        host, *rest = zip(*out) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), *(pa.array(x, pa.int64()) for x in rest)], ["host", "token", "vector", "place", "times", "page"])


def _nest(batches):
    for b in batches:
        out = []
        for rows in b.column("rows").to_pylist():
            out.append([{"token": t, "once": o} for t, o in nested([(r["token"], r["vector"], r["pages"], r["times"], r["at"]) for r in rows])])
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(out, TEMPLATE)], ["host", "template"])


TEMPLATE = pa.list_(pa.struct([("token", pa.int64()), ("once", pa.bool_())]))


def templates(pages: DataFrame, folder: str) -> DataFrame:
    """(host, template): the tokens of each host's valid classes, as pairs (token, once)."""
    common.bounded_batches(pages.sparkSession)
    # pages of equal content are one page
    rows = pages.select("host", "html").mapInArrow(_rows, "host string, token long, vector long, place long, times long, page long").distinct()
    seen = common.saved(
        rows.groupBy("host", "token").agg(
            F.expr("bit_xor(vector)").alias("vector"), F.count(F.lit(1)).alias("pages"), F.sum("place").alias("place"), F.sum("times").alias("times"),
        ).where(F.col("pages") >= CLASS_PAGES),
        folder, "tokens",
    )
    size = seen.where("token = 0").select("host", F.col("pages").alias("all"))
    often = seen.where("token <> 0").join(common.small(size), "host").where(F.col("pages") >= CLASS_SHARE * F.col("all"))
    # a frequent token takes its share of a page, so a host has no more of them than a few pages
    one = F.struct("token", "vector", "pages", "times", (F.col("place") / F.col("pages")).alias("at"))
    return often.groupBy("host").agg(F.collect_list(one).alias("rows")).mapInArrow(_nest, "host string, template array<struct<token:long,once:boolean>>")


def _held(host: str, template, cache: dict) -> dict[int, bool]:
    if host not in cache:
        if len(cache) > 1000:
            cache.clear()
        flat = template.values
        cache[host] = dict(zip(flat.field("token").to_pylist(), flat.field("once").to_pylist()))
    return cache[host]


def _weights(roles: bool):
    """Characters of slot text in each template element that stands once on a page, and on the whole page (token 0)."""

    def run(batches):
        cache: dict[str, dict[int, bool]] = {}
        for b in batches:
            sums: dict[tuple, list[int]] = {}
            for host, page, template in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("template")):
                held = _held(host, template, cache)
                for x in blocks(page, roles)[0]:
                    if roles and not x.zone or _token(x) in held:
                        continue
                    sums.setdefault((host, 0), [0, 0])[0] += len(x.text)
                    for c in _chain(x.around):
                        if held.get(c.token):
                            sums.setdefault((host, c.token), [0, c.depth])[0] += len(x.text)
            host, token = zip(*sums) if sums else ((), ())
            chars, depth = zip(*sums.values()) if sums else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), *(pa.array(x, pa.int64()) for x in (token, chars, depth))], ["host", "token", "chars", "depth"])

    return run


def regions(pages: DataFrame, roles: bool = True) -> DataFrame:
    """(host, region): the innermost template element with more than half of the host's slot text; ``pages`` have templates."""
    rows = pages.where("template IS NOT NULL").select("host", "html", "template").mapInArrow(_weights(roles), "host string, token long, chars long, depth long")
    sums = rows.groupBy("host", "token").agg(F.sum("chars").alias("chars"), F.max("depth").alias("depth"))
    whole = F.max(F.when(F.col("token") == 0, F.col("chars")))
    each = sums.groupBy("host").agg(whole.alias("all"), F.collect_list(F.struct("depth", "chars", "token")).alias("elements"))  # as many as a template has
    best = F.array_max(F.filter("elements", lambda e: (e["token"] != 0) & (2 * e["chars"] > F.col("all"))))
    return each.select("host", best["token"].alias("region")).where("region IS NOT NULL")


def _extract(roles: bool):
    def run(batches):
        cache: dict[str, dict[int, bool]] = {}
        for b in batches:
            texts = []
            for host, page, template, region in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("template"), b.column("region").to_pylist()):
                held = _held(host, template, cache) if template.is_valid else None
                texts.append(main_text(page, held, region, roles))
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), n], ["id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roles: bool = True) -> DataFrame:
    """(id, url, text, n_chars) of every row of ``pages``.

    Null and empty pages have the empty text; an empty table gives none.  Pages
    without a host share one (empty) host.  Pages of equal content count once
    for a template, so repeated rows change none and are extracted alike.
    Hosts of fewer pages than a class needs have no template; their pages are
    cut by the elements' roles alone.  Of elements with as much text the inner
    one is the region.  ``roles=False`` leaves names and class words aside.
    """
    spark, folder = pages.sparkSession, common.scratch(pages.sparkSession)
    common.bounded_batches(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    made = common.saved(templates(rows, folder), folder, "templates")
    met = rows.join(common.small(made), "host", "left")
    found = common.saved(regions(met, roles), folder, "regions")
    kind = pages.schema[id_col].dataType.simpleString()
    met = met.join(common.small(found), "host", "left").select("id", "url", "host", "html", "template", "region")
    return met.mapInArrow(_extract(roles), f"id {kind}, url string, text string, n_chars long")
