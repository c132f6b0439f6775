"""Main-text extraction from pages by equivalence classes of same-host template tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import join_checked
from millrace.llm.shared import cut, slices, stored

#: A class of tokens counts if it is on this share of a host's pages, and on so many pages.
SUPPORT, LEAST_PAGES = 0.5, 3
#: A class is template only with tokens of this weight; an element is a start and an end token, a text one.
LEAST_WEIGHT, ELEMENT, TEXT = 3, 2, 1
#: A text in the main slot is template if its class has so many elements out of the slot.
OUTSIDE = 2
#: A class's token must be at one place of its order on this share of the pages that have it.
SAME = 0.98
#: A slot holds the main text while one child has this share of its text.
DESCEND = 0.8
#: Elements named like side matter are left out only if they have this share of the unlinked text at most.
SIDE = 0.3
#: Paths are cut at this depth; deeper elements count for the ancestor there.
MOST_DEPTH = 24

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
#: Elements that make blocks; all others are markup inside a block.
_BLOCK = frozenset("html body head article section nav header footer aside main form div p ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption details summary fieldset address center dialog menu select button object canvas video audio svg template search hgroup".split())
_CLOSES_P = _BLOCK - {"object", "canvas", "video", "audio", "svg", "select", "button", "template"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"thead", "tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = frozenset("ul ol dl table article section nav header footer aside main form div body html td th blockquote".split())
#: Elements whose text is never main text.
_OUT_TAGS = frozenset("head nav header footer aside form script style noscript template iframe button select dialog menu svg textarea title canvas object video audio search xmp noembed noframes".split())
#: A name of class, id or role speaks of side matter if it is made of the first words and the second only, as in "site-footer";
#: "legal-history" or "with-sidebar" is not. A name of the third words alone speaks of main text.
_OUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments reply replies disqus discussion respond share sharing social related recommended recommendations widget toolbar pagination pager login search copyright legal disclaimer contentinfo complementary form hidden skip".split())
_PLAIN_WORDS = frozenset("site page main left right top bottom upper lower list box block wrap wrapper container inner outer section area item items link links post posts article articles entry content blog bar primary secondary panel group global slot unit text message reader user js".split())
_MAIN_WORDS = frozenset("article content body main story text entry post".split())


@dataclass
class Piece:
    """A block of text: its path of block elements, its text, and how much of it is links.

    ``out`` is for elements that are never main text, ``sides`` are the paths of those around
    the block that are only named like side matter (see ``main_sides``).
    """

    path: str
    text: str
    chars: int
    link_chars: int
    out: bool
    sides: tuple[str, ...] = ()


def main_sides(weights: dict[tuple[str, tuple[str, ...]], float]) -> set[str]:
    """The paths named like side matter whose text is main text all the same.

    ``weights`` has the unlinked characters by path and ``sides``. Those around the slot with
    most text are kept, and those with more than SIDE of all text.
    """
    total, below = sum(weights.values()), {}
    for (_, sides), chars in weights.items():
        for p in sides:
            below[p] = below.get(p, 0.0) + chars
    most = max(weights, key=lambda k: (weights[k], k), default=("", ()))
    return {p for p, chars in below.items() if chars > SIDE * total} | set(most[1])


def _named_side(names: list[str]) -> bool:
    """Whether the names of an element's class, id and role speak of side matter."""
    parts = [_NAME.findall(n) for n in names]
    side = [any(w in _OUT_WORDS for w in p) and all(w in _OUT_WORDS or w in _PLAIN_WORDS for w in p) for p in parts]
    return any(side) and not any(p and not s and all(w in _MAIN_WORDS for w in p) for p, s in zip(parts, side))


def _step(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """An element's token (tag and first name of its class or id), whether its text is never main, and whether it is named like side matter."""
    if not attributes.strip():
        return tag, tag in _OUT_TAGS, False
    found, out = {}, tag in _OUT_TAGS
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or "").lower())
    names = [n for key in ("class", "id", "role") for n in found.get(key, "").split()]
    words = [w for n in names for w in _NAME.findall(n)]
    out = out or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    return f"{tag}.{words[0]}" if words else tag, out, tag not in ("html", "body", "main", "article") and _named_side(names)


@dataclass
class _Open:
    """An open element: its tag, its path (cut at MOST_DEPTH), and what holds for all in it."""

    tag: str
    path: str
    out: bool
    sides: tuple[str, ...]


def pieces(html: str) -> list[Piece]:
    """The blocks of a page in order, from a forgiving scan.

    Ends of p, li, dt, dd and table parts may be missing, unknown end tags are ignored, scripts
    and the like run to their own end tag, and what is open at the end is closed. Only block
    elements are in paths.
    """
    out: list[Piece] = []
    stack: list[_Open] = []
    opened: dict[str, int] = {}
    text: list[str] = []
    links = link_depth = 0
    at, size = 0, len(html)

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                top = stack[-1] if stack else _Open("", "", False, ())
                out.append(Piece(top.path, joined, len(joined), min(links, len(joined)), top.out, top.sides))
            text.clear()
        links = 0

    def close(k: int) -> None:
        flush()
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    def last(tag: str) -> int | None:
        return next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag) if opened.get(tag) else None

    while m := _TAG.search(html, at):  # anew from ``at``: what a raw element holds is no tag
        if m.start() > at:
            run = html[at : m.start()]
            text.append(run)
            links += len(run) * (link_depth > 0)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                link_depth = max(0, link_depth - 1)
            elif tag in _BLOCK:
                k = last(tag)
                if k is not None:
                    close(k)
                else:
                    flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(html, at)
            at = end.end() if end else size
            text.append(" ")
            continue
        if tag == "a":
            link_depth = 1
        elif tag in ("br", "hr", "img", "wbr"):
            text.append("" if tag == "wbr" else " ")
        elif tag in _BLOCK:
            link_depth = 0
            flush()
            if tag in _CLOSES_P:
                k = last("p")
                if k is not None and not any(e.tag in ("button", "table") for e in stack[k + 1 :]):
                    close(k)
            shut = _CLOSED_BY.get(tag)
            if shut:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in shut:
                        close(k)
                    elif stack[k].tag in _SCOPE:
                        break
            token, never, side = _step(tag, m[3] or "")
            if not (m[3] or "").rstrip().endswith("/") or tag not in ("svg", "canvas"):
                above = stack[-1] if stack else _Open("", "", False, ())
                path = above.path if len(stack) >= MOST_DEPTH else f"{above.path}/{token}" if stack else token
                sides = above.sides + (path,) if side and path not in above.sides else above.sides
                stack.append(_Open(tag, path, above.out or never, sides))
                opened[tag] = opened.get(tag, 0) + 1
    if at < size:
        text.append(html[at:])
    flush()
    return out


def host_of(url):
    """The host of a url column in lower case, empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def unlinked(blocks: list[Piece]) -> dict[tuple[str, tuple[str, ...]], int]:
    """Characters by path and sides of the blocks that may be main text and are no link lists."""
    found: dict[tuple[str, tuple[str, ...]], int] = {}
    for b in blocks:
        if not b.out and b.link_chars <= 0.5 * b.chars:
            found[b.path, b.sides] = found.get((b.path, b.sides), 0) + b.chars
    return found


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


#: The token that every page has once: its own start and end.
ROOT = _hash("")


def sequence(blocks: list[Piece]) -> list[tuple[int, str, bool]]:
    """A page's tokens in order: (token, path, is a text).

    A token is the start of an element, told apart by its path, or a block's text at its path. An
    element's end needs no token of its own: it occurs as often as the start, and paths hold
    what lies in it.
    """
    out, above = [(ROOT, "", False)], [""]
    for b in blocks:
        names = [*accumulate(b.path.split("/"), lambda p, n: f"{p}/{n}")] if b.path else []
        shared = next((k for k, (x, y) in enumerate(zip(names, above[1:])) if x != y), min(len(names), len(above) - 1))
        if names and shared == len(names) == len(above) - 1:
            shared -= 1  # the same element again: another one of its kind
        out.extend((_hash(p), p, False) for p in names[shared:])
        above = ["", *names]
        out.append((_hash(f"{b.path}\0{b.text}"), b.path, True))
    return out


_TOKENS = "site long, page long, token long, path string, is_text boolean, vector long"


def page_tokens(pages: DataFrame) -> DataFrame:
    """A row per page and token of its ``sequence``.

    ``page`` is a hash of the html, so pages that are equal are one. ``vector`` is a hash of
    (page, occurrences): the xor of it over a host's distinct pages stands for the token's whole
    occurrence vector. Only elements have their path.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text="html"):
            rows = []
            for site, page, html in zip(*(part.column(c).to_pylist() for c in ("site", "page", "html"))):
                times, kinds = Counter(), {}
                for token, path, is_text in sequence(pieces(html or "")):
                    times[token] += 1
                    kinds[token] = (None if is_text else path, is_text)
                rows.extend((site, page, token, *kinds[token], _hash(f"{page}\0{n}")) for token, n in times.items())
            if rows:
                kinds_of = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds_of)], names=[f.split()[0] for f in _TOKENS.split(", ")])

    html = F.col("html").cast("string")
    return pages.select(F.xxhash64(host_of(F.col("url"))).alias("site"), F.xxhash64(html).alias("page"), html.alias("html")).mapInArrow(scan, _TOKENS)


def classes(tokens: DataFrame) -> DataFrame:
    """site, tokens, klass: the equivalence classes of each host, one row a host.

    Tokens with one occurrence vector over the host's distinct pages are a class. Classes on
    SUPPORT of the pages and of LEAST_WEIGHT count. Tokens are summed per host before a host's
    tokens meet, so a host with a third of all pages sends no more rows than one with few.
    """
    each = tokens.groupBy("site", "token", "page").agg(F.first("path").alias("path"), F.first("is_text").alias("is_text"), F.first("vector").alias("vector"))
    summed = each.groupBy("site", "token").agg(F.first("path").alias("path"), F.first("is_text").alias("is_text"), F.bit_xor("vector").alias("vector"), F.count(F.lit(1)).alias("pages"))
    frequent = cut(summed.filter(F.col("pages") >= LEAST_PAGES))
    all_pages = frequent.filter(F.col("token") == ROOT).select("site", F.col("pages").alias("_all"))
    members = join_checked(frequent, all_pages, "site").filter(F.col("pages") >= SUPPORT * F.col("_all"))
    weight = F.sum(F.when(F.col("is_text"), TEXT).otherwise(ELEMENT))
    by_vector = members.groupBy("site", "pages", "vector").agg(weight.alias("_w"), F.collect_list("token").alias("tokens")).filter(F.col("_w") >= LEAST_WEIGHT)
    named = by_vector.select("site", F.xxhash64("vector", "pages").alias("klass"), F.explode("tokens").alias("token"))
    return named.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("token", "klass"))).alias("_m")).select("site", F.col("_m.token").alias("tokens"), F.col("_m.klass").alias("klass"))


_SEEN = "site long, token long, klass long, path string, is_text boolean, place long, pages long, sides string, chars long"


def observed(pages: DataFrame, known: DataFrame) -> DataFrame:
    """What orders the classes' tokens have on the pages, and how much text the slots between them hold.

    For each page and class token the ``place`` within the class: its number in the order of
    the class's occurrences, modulo the class's tokens; -1 if its occurrences have several. For
    each path and ``sides`` the unlinked characters of blocks that are no class tokens, which are
    what is in slots. Each task sums its pages.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def lines() -> pa.RecordBatch:
            rows = [(site, token, klass, path, is_text, place, n, None, 0) if klass is not None else (site, None, None, path, None, None, 0, token, n) for (site, token, klass, path, is_text, place), n in held.items()]
            held.clear()
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=[f.split()[0] for f in _SEEN.split(", ")])

        for part in slices(batches, text="html"):
            for site, html, tokens, klass in zip(*(part.column(c).to_pylist() for c in ("site", "html", "tokens", "klass"))):
                of, blocks = dict(zip(tokens, klass)), pieces(html or "")
                run: dict[int, list[tuple[int, str, bool]]] = {}
                for token, path, is_text in sequence(blocks):
                    if token in of:
                        run.setdefault(of[token], []).append((token, path, is_text))
                for k, found in run.items():
                    size, places = len({t for t, _, _ in found}), {}
                    for n, entry in enumerate(found):
                        places.setdefault(entry, set()).add(n % size)
                    for entry, at in places.items():
                        held[site, entry[0], k, entry[1], entry[2], min(at) if len(at) == 1 else -1] += 1
                free = [b for b in blocks if _hash(f"{b.path}\0{b.text}") not in of]
                for (path, sides), chars in unlinked(free).items():
                    held[site, "\n".join(sides), None, path, None, None] += chars
                if len(held) > 50_000:
                    yield lines()
        if held:
            yield lines()

    html = F.col("html").cast("string")
    rows = pages.select(F.xxhash64(host_of(F.col("url"))).alias("site"), html.alias("html")).join(known, "site")
    return rows.select("site", "html", "tokens", "klass").mapInArrow(scan, _SEEN)


def nested(members: list[tuple[int, str, str, bool]]) -> tuple[set[str], list[tuple[int, str, int]]]:
    """Nest classes into a template: its elements' paths, and its text tokens with their paths and classes.

    ``members`` are (pages, class, path, token or None for an element). Classes are placed from those on most pages on; a
    class's tokens are told apart by the slot of the template so far in which they lie (the
    deepest element of other classes above them), and only those of LEAST_WEIGHT in one slot are placed.
    """
    by: dict[tuple[int, int], list[tuple[str, int | None]]] = {}
    for pages, klass, path, token in members:
        by.setdefault((-pages, klass), []).append((path, token))
    elements, texts = {""}, []
    for (_, klass), tokens in sorted(by.items()):
        slots: dict[str, list[tuple[str, int | None]]] = {}
        for path, token in tokens:
            at = path if token is not None else path.rpartition("/")[0]
            while at not in elements:
                at = at.rpartition("/")[0]
            slots.setdefault(at, []).append((path, token))
        for inside in slots.values():
            if sum(ELEMENT if t is None else TEXT for _, t in inside) >= LEAST_WEIGHT:
                elements.update(p for p, t in inside if t is None)
                texts += [(t, p, klass) for p, t in inside if t is not None]
    return elements, texts


_LEAF = re.compile(r"(?:p|h[1-6]|li|td|th|dt|dd|pre|blockquote|tr)(?:\.|$)")


def deduce(seen: pd.DataFrame) -> dict:
    """The template of one host from its classes' tokens and its slots' text.

    Tokens without one place in their class's order (SAME) are no template; the classes that are left
    are nested (``nested``). The main slot is found from the page inwards: a step goes to the
    element of the template, with none between, that has DESCEND of the slots' unlinked text. A text in the main slot is template only if its
    class has OUTSIDE elements out of the slot, as what a site puts on its pages has; a heading that many articles share with nothing but its own element is content. Returns the
    main slot's path, the template's text tokens in it, and the paths named like side matter that hold main text.
    """
    tokens = seen[seen["token"].notna() & (seen["best"] >= SAME * seen["pages"])]
    members = [(int(r.pages), int(r.klass), r.path, int(r.token) if r.is_text else None) for r in tokens.itertuples()]
    elements, texts = nested(members)
    parts = seen[seen["token"].isna()]
    weights = {(r.path, tuple(r.sides.split("\n")) if r.sides else ()): float(r.chars) for r in parts.itertuples()}
    kept = main_sides(weights)
    useful: dict[str, float] = {"": 0.0}
    for (path, sides), chars in weights.items():
        if kept.issuperset(sides):
            for p in ["", *accumulate(path.split("/"), lambda a, b: f"{a}/{b}")] if path else [""]:
                useful[p] = useful.get(p, 0.0) + chars
    if len(elements) == 1 or not useful[""]:
        return {"main": None, "constant": [], "kept": []}
    main, inside = "", lambda p, q: p != q and (not q or p.startswith(q + "/"))
    while True:
        below = [p for p in elements if inside(p, main)]
        below = [p for p in below if not any(inside(p, q) for q in below)]
        best = max(below, key=lambda p: (useful.get(p, 0.0), p), default=None)
        if best is None or useful.get(best, 0.0) < DESCEND * useful[main] or _LEAF.match(best.rsplit("/", 1)[-1]):
            outside = Counter(k for _, k, path, token in set(members) if token is None and path != main and not inside(path, main))
            return {"main": main, "constant": sorted(t for t, p, k in texts if (p == main or inside(p, main)) and outside[k] >= OUTSIDE), "kept": sorted(kept)}
        main = best


def templates(pages: DataFrame) -> DataFrame:
    """site, main, constant, kept: one row a host, from all its pages."""
    known = stored(classes(page_tokens(pages)), "classes")
    seen = stored(observed(pages, known), "seen")
    slots = seen.filter("token is null").groupBy("site", "path", "sides").agg(F.sum("chars").alias("chars"))
    placed = seen.filter("token is not null").groupBy("site", "token", "klass", "place").agg(F.sum("pages").alias("pages"), F.first("path").alias("path"), F.first("is_text").alias("is_text"))
    best = F.max(F.when(F.col("place") >= 0, F.col("pages")).otherwise(0))
    ordered = placed.groupBy("site", "token", "klass").agg(F.sum("pages").alias("pages"), best.alias("best"), F.first("path").alias("path"), F.first("is_text").alias("is_text"))
    both = ordered.unionByName(slots, allowMissingColumns=True)
    both = both.withColumn("token", F.col("token").cast("string")).withColumn("klass", F.col("klass").cast("string"))  # pandas would round them where others are null

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        found = deduce(rows.sort_values(["path", "sides", "token"], ignore_index=True))
        return pd.DataFrame({"site": [rows["site"].iloc[0]], "main": [found["main"]], "constant": [found["constant"]], "kept": [found["kept"]]})

    return both.groupBy("site").applyInPandas(one, "site long, main string, constant array<long>, kept array<string>")


def main_blocks(blocks: list[Piece], main: str | None, constant: frozenset = frozenset(), kept: frozenset = frozenset()) -> list[str]:
    """The texts of a page's main slot that are no text tokens of the template.

    Without a template, or where the page does not have its main slot, the slot is the page's own
    article or main element, else the element below which most unlinked text of blocks lies;
    which elements are side matter is then judged by the page's own text.
    """
    inside = lambda b, p: not p or b.path == p or b.path.startswith(p + "/")
    free = lambda b: not b.out and kept.issuperset(b.sides)
    if main is None or not any(inside(b, main) and free(b) for b in blocks):
        kept = frozenset(main_sides(unlinked(blocks)))
        marked = [re.match(r"(?:.*/)?(?:article|main)(?:\.[a-z]+)?(?=/|$)", b.path) for b in blocks if free(b)]
        marked = [m.group() for m in marked if m]
        if marked:
            main = min(marked, key=len)
        else:
            weight: dict[str, int] = {}
            for b in blocks:
                if free(b) and b.link_chars <= 0.5 * b.chars:
                    names = b.path.split("/")
                    for k in range(1, len(names) + 1):
                        p = "/".join(names[:k])
                        weight[p] = weight.get(p, 0) + b.chars
            if not weight:
                return []
            top = max(weight.values())
            main = max((p for p, w in weight.items() if w >= DESCEND * top), key=lambda p: (p.count("/"), p))
            if re.match(r"(?:p|h[1-6]|li|pre)(?:\.|$)", main.rsplit("/", 1)[-1]) and "/" in main:
                main = main.rsplit("/", 1)[0]
    return [b.text for b in blocks if free(b) and inside(b, main) and not (constant and _hash(f"{b.path}\0{b.text}") in constant)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the slot of every page's main text from its whole html.

    Null or empty html, and pages without main text, give an empty text. Null or odd urls share
    the host ''. Repeated pages are extracted each and count once for the classes. Hosts with fewer
    than LEAST_PAGES distinct pages, and those whose tokens make no class, have no template; their pages are judged by themselves.
    """
    known = stored(templates(pages), "templates")
    keyed = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), F.xxhash64(host_of(F.col("url"))).alias("site"))
    joined = keyed.join(known, "site", "left")
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text="html"):
            texts, slots = [], []
            for html, main, constant, kept in zip(*(part.column(c).to_pylist() for c in ("html", "main", "constant", "kept"))):
                texts.append("\n".join(main_blocks(pieces(html or ""), main, frozenset(constant or ()), frozenset(kept or ()))))
                slots.append(main)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(slots, pa.string())], names=["page_id", "url", "text", "n_chars", "slot"])

    return joined.select("page_id", "url", "html", "main", "constant", "kept").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long, slot string")
