"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of structural tags and text slots (inline tags belong to
their text). Runs of up to 12 tokens that repeat are folded into repeated groups; longer ones stay as they are. The different
folded streams (shapes) of all a host's pages are aligned one after another, in groups and then their wrappers: what one
page has and another lacks becomes an optional group, what is repeated in one and single in another a
repeated group, and text is a slot. Shapes that have little in common, or whose wrapper would be more than twice as long as the longest
of them, get wrappers of their own. Each page is then aligned with the wrapper of its shape.

The wrapper's slots decide. A slot outside articles that holds the same text on all pages of the wrapper
that have it (``FIXED`` different ones at least) is the host's template and goes, unless slots beside it in the same
element (below body) vary: a heading that all pages repeat between their own paragraphs stays. So do slots
that vary, those that only the page itself has, and all inside articles. Of the slots that
stay, those in the elements that the page marks as its
article (element, role or itemprop) are the text; if no such element holds text,
all of them are. If template were the greater part of the text of all different pages, as on
a host of copies, or all of a page's text, it stays.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are told by element, role, class and id. Inside an article a class or id
counts only if each part of the name says so: ``comment-list`` goes, ``side-effects`` and
``related-work`` stay. Whatever else stands in the article is kept, whole.

Edge cases: null or empty html gives an empty text; a null or odd url puts the
page with the pages of no host; a page whose text is all template is kept whole; repeated rows are extracted alike and count
once; rows of null page_id are like others. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import Scratch, join_small

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|textarea|title)\b[^>]*>.*?(?:</\1\s*>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Names of elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("nav aside footer form button select option iframe object dialog menu head canvas audio video fieldset".split())
ARTICLE = frozenset("article main".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LISTS = frozenset("ul ol dl table tbody thead tfoot".split())
BOILER = re.compile(r"^(ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|share|sharing|social|related|recommend\w*|sidebar|side|aside|menu|nav|navbar|navigation|breadcrumbs?|comments?|commentlist|replies|reply|discussion|disqus|footer|toolbar|login|search|pagination|pager|skip|widgets?|complementary|contentinfo|form)$")
HEADER = re.compile(r"^(header|masthead|topbar)$")
#: Parts of a name that say nothing of what the element holds.
NEUTRAL = re.compile(r"^(site|page|global|main|posts?|articles?|stories|links?|buttons?|bars?|box|lists?|items?|container|wrapper|wrap|inner|outer|area|section|block|slot|unit|top|bottom|left|right|header|title|count|icons?|media|inline|content|message|text|thread|author|body|user|reader|policy|js|is|has)$")
#: Different pages that a slot must hold the same text on.
FIXED = 2
#: Shapes that a task aligns with each other at once.
TOGETHER = 48


def names(raw: str) -> list[list[str]]:
    """The parts of each name in class, id and role, numbers left out."""
    found = (w for m in ATTRIBUTE.finditer(raw) if m[1].lower() != "itemprop" for w in (m[2] or m[3] or m[4] or "").lower().split())
    return [p for w in found if (p := [v for v in re.split(r"[-_\d]+", w) if v])]


def attributes(raw: str) -> tuple[str, ...]:
    """The names in class, id, role and itemprop, parts of a name apart, numbers left out."""
    out = []
    for m in ATTRIBUTE.finditer(raw):
        value = (m[2] or m[3] or m[4] or "").lower()
        kind = m[1].lower()
        if kind in ("role", "itemprop"):
            out += [f"{kind}={v}" for v in value.split()]
        if kind != "itemprop":
            out += [v for w in value.split() for v in re.split(r"[-_\d]+", w) if v]
    return tuple(dict.fromkeys(out))


def dropped(name: str, raw: str, marks: tuple[str, ...], inside: bool) -> bool:
    """Whether an element is no part of the text; ``inside`` an article only if a whole name says so."""
    if name in NEVER:
        return True
    if inside:
        return any(any(map(BOILER.match, parts)) and all(BOILER.match(p) or NEUTRAL.match(p) for p in parts) for parts in names(raw))
    return name == "header" or any(BOILER.match(m) or HEADER.match(m) for m in marks)


def is_article(name: str, marks: tuple[str, ...]) -> bool:
    return name in ARTICLE or "role=main" in marks or "itemprop=articlebody" in marks


class Slot:
    """A block of text and the open elements above it."""

    __slots__ = ("path", "text", "gone", "inside")

    def __init__(self, path: tuple[str, ...], text: str, gone: bool, inside: bool):
        self.path, self.text, self.gone, self.inside = path, text, gone, inside


def read_page(page: str | None) -> tuple[list[str], list[Slot]]:
    """(structure, slots): tags as ``<key`` and ``>key``, a slot as ``#``; the k-th ``#`` is the k-th slot."""
    stream, slots, stack, parts = [], [], [], []  # stack: (name, key, gone, inside an article)
    page = page or ""

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            stream.append("#")
            slots.append(Slot(tuple(s[1] for s in stack), text, bool(stack) and stack[-1][2], bool(stack) and stack[-1][3]))

    def pop() -> None:
        stream.append(">" + stack.pop()[1])

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[3] and m[3].lower()
        if not name:
            continue
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            continue
        flush()
        if name in VOID:
            continue
        if m[2]:
            if any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if stack and stack[-1][0] == "p":
            pop()
        if name in CLOSED_BY:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in LISTS and not (name in ("td", "th", "tr") and stack[k][0] == "tr"):
                    break
                if stack[k][0] in CLOSED_BY[name]:
                    while len(stack) > k:
                        pop()
                    break
        marks = attributes(m[4])
        inside = bool(stack) and stack[-1][3]
        gone = bool(stack) and stack[-1][2] or dropped(name, m[4], marks, inside)
        key = ".".join((name, *marks))
        stack.append((name, key, gone, inside or is_article(name, marks)))
        stream.append("<" + key)
        if m[4].rstrip().endswith("/") and name not in ARTICLE:
            pop()
    if at < len(page):
        parts.append(page[at:])
    flush()
    while stack:
        pop()
    return stream, slots


# A wrapper is a list of nodes: a token, ("+", nodes) or ("?", nodes).


def fold(nodes: list, known: set[tuple] = frozenset(), longest: int = 12) -> list:
    """Squares become repeated groups: adjacent equal runs, short ones first; runs ``known`` to repeat fold singly too."""
    for n in range(1, longest + 1):
        out, k = [], 0
        while k < len(nodes):
            body = tuple(nodes[k : k + n])
            times = 1
            while len(body) == n and nodes[k + times * n : k + (times + 1) * n] == list(body):
                times += 1
            whole = len(body) == n and (times > 1 or body in known) and _balanced(body)
            if whole and not (n == 1 and isinstance(body[0], tuple) and body[0][0] == "+"):
                out.append(("+", body))
                k += times * n
            elif n == 1 and times > 1 and isinstance(body[0], tuple) and body[0][0] == "+":
                out.append(body[0])
                k += times
            else:
                out.append(nodes[k])
                k += 1
        nodes = out
    return nodes


def _balanced(body: tuple) -> bool:
    depth = 0
    for x in body:
        if isinstance(x, str) and x != "#":
            depth += 1 if x[0] == "<" else -1
            if depth < 0:
                return False
    return depth == 0


def groups(nodes: list | tuple, out: set[tuple]) -> set[tuple]:
    for x in nodes:
        if isinstance(x, tuple):
            if x[0] == "+":
                out.add(x[1])
            groups(x[1], out)
    return out


def align(wrapper: list, page: list) -> list:
    """The wrapper, generalised so that it matches ``page`` (or what the wrapper ``page`` matches) too."""
    free = lambda x: isinstance(x, tuple) and x[0] == "?"
    plain = lambda nodes: [repr(x[1][0] if free(x) and len(x[1]) == 1 else x[1] if free(x) else x) for x in nodes]
    out = []
    for tag, a, b, c, d in SequenceMatcher(None, plain(wrapper), plain(page), autojunk=False).get_opcodes():
        if tag == "equal":
            out += [y if free(y) else x for x, y in zip(wrapper[a:b], page[c:d], strict=True)]
            continue
        out += [x if free(x) else ("?", (x,)) for x in [*wrapper[a:b], *page[c:d]]]
    return out


def tags(nodes: list | tuple, out: set[str]) -> set[str]:
    for x in nodes:
        if isinstance(x, tuple):
            tags(x[1], out)
        elif x[0] == "<":
            out.add(x)
    return out


def merged(shapes: list[tuple[list, int, list[int]]]) -> list[tuple[list, int, list[int]]]:
    """Wrappers of shapes or wrappers: (nodes, nodes of the longest shape, shapes it is of)."""
    known: set[tuple] = set()
    for nodes, *_ in shapes:
        groups(nodes, known)
    made: list[list] = []
    for nodes, longest, of in shapes:
        nodes = fold(nodes, known)
        own = tags(nodes, set())
        for w in made:
            if 2 * len(own & w[3]) < min(len(own), len(w[3])):
                continue
            new, most = align(w[0], nodes), max(longest, w[1])
            if len(new) <= 2 * most + 64:
                w[:] = new, most, w[2] + of, w[3] | own, [*w[4], nodes]
                break
        else:
            made.append([nodes, longest, list(of), own, [nodes]])
    for w in made:
        for _ in w[4][1:]:
            new = w[0]
            for nodes in w[4]:
                new = align(new, nodes)
            if new == w[0] or len(new) > 2 * w[1] + 64:
                break
            w[0] = new
    return [(w[0], w[1], w[2]) for w in made]


def pattern(nodes: list | tuple, code: dict[str, str]) -> str:
    out = []
    for x in nodes:
        if isinstance(x, str):
            out.append(code.setdefault(x, chr(0xE000 + len(code))))
        else:
            out.append(f"(?:{pattern(x[1], code)}){x[0]}")
    return "".join(out)


def places(shape: list, stream: list[str]) -> list[tuple[int, ...]] | None:
    """Where in ``shape`` each ``#`` of ``stream`` stands; all passes through a repeated group have the same places."""
    out = []

    def take(nodes: list | tuple, at: int, above: tuple[int, ...]) -> int:
        for k, x in enumerate(nodes):
            if isinstance(x, str):
                if at >= len(stream) or stream[at] != x:
                    return -1
                if x == "#":
                    out.append((*above, k))
                at += 1
                continue
            at = take(x[1], at, (*above, k))
            while at >= 0:
                n, again = len(out), take(x[1], at, (*above, k))
                if again < 0:
                    del out[n:]
                    break
                at = again
            if at < 0:
                return -1
        return at

    return out if take(shape, 0, ()) == len(stream) else None


class Wrapper:
    """``fixed``: (slot, path) to digests of the texts that stand there on every page that has it."""

    def __init__(self, nodes: list, roots: list[str], fixed: dict | None = None):
        self.nodes, self.roots, self.code, self.met = nodes, roots, {}, {}
        self.fixed, self.aligned = fixed or {}, {}
        self.known = groups(nodes, set())
        self.match = re.compile(pattern(nodes, self.code)).fullmatch

    def fits(self, stream: list[str]) -> bool:
        shape = tuple(fold(stream, self.known))
        if shape not in self.met:
            if len(self.met) > 2000:
                self.met.clear()
            text = "".join(self.code.get(x, "") for x in stream) if len(stream) < 400 else ""
            self.met[shape] = bool(text and self.match(text)) or align(self.nodes, list(shape)) == self.nodes
        return self.met[shape]

    def slots_of(self, stream: list[str]) -> list[tuple[int, ...] | None]:
        """The wrapper's slot of each ``#`` of the page aligned with it; None where only the page has it."""
        shape = fold(stream, self.known)
        where = places(shape, stream)
        if where is None:
            return [None] * stream.count("#")
        key = tuple(shape)
        if key not in self.aligned:
            if len(self.aligned) > 2000:
                self.aligned.clear()
            plain = [repr(x[1][0] if isinstance(x, tuple) and x[0] == "?" else x) for x in self.nodes]
            blocks = SequenceMatcher(None, plain, [repr(x) for x in shape], autojunk=False).get_matching_blocks()
            self.aligned[key] = {b + i: a + i for a, b, n in blocks for i in range(n)}
        to = self.aligned[key]
        return [(to[w[0]], *w[1:]) if w[0] in to else None for w in where]

    def content(self, stream: list[str], slots: list[Slot]) -> list[Slot]:
        """The slots whose text is not the host's template."""
        if not self.fixed:
            return [s for s in slots if not s.gone]
        return [s for s, at in zip(slots, self.slots_of(stream), strict=True) if not s.gone and (s.inside or not ((held := self.fixed.get((at, " ".join(s.path)))) and digest(s.text) in held))]


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def facts(wrapper: Wrapper, stream: list[str], slots: list[Slot]) -> tuple[int, set[str], dict[tuple, list[str]]]:
    """Of a page: its characters, the elements with text that only it has, and (slot, path) outside articles to its texts."""
    places, own, total = set(), {}, 0
    for s, at in zip(slots, wrapper.slots_of(stream), strict=True):
        if s.gone:
            continue
        total += len(s.text)
        if at is None:
            places.add(" ".join(s.path[:-1]))
        elif not s.inside:
            own.setdefault((at, " ".join(s.path)), []).append(s.text)
    return total, places, own


def template(wrapper: Wrapper, read: list[tuple[list[str], list[Slot]]]) -> dict:
    """(slot, path) to digests of its texts, of slots that hold the same on all pages; nothing where that is the greater part of the text (copies of a page)."""
    seen: dict[tuple, list[tuple[str, ...]]] = {}
    own_places: set[str] = set()
    total = 0
    for stream, slots in read:
        n, places_, own = facts(wrapper, stream, slots)
        total += n
        own_places |= places_
        for key, texts in own.items():
            seen.setdefault(key, []).append(tuple(texts))
    same = {key: texts for key, texts in seen.items() if len(texts) >= FIXED and len(set(texts)) == 1}
    # elements, below body, in which the text of a page itself stands
    own_places |= {key[1].rpartition(" ")[0] for key in seen if key not in same}
    own_places -= {place for place in own_places if place.rpartition(" ")[2].split(".")[0] in ("", "html", "body")}
    same = {key: texts for key, texts in same.items() if key[1].rpartition(" ")[0] not in own_places}
    if 2 * sum(len(t) for texts in same.values() for page in texts for t in page) > total:
        return {}
    return {key: frozenset(map(digest, texts[0])) for key, texts in same.items()}


def infer(pages: list[str]) -> Wrapper:
    """The wrapper of the pages: folded, aligned in turn until all of them match."""
    read = [read_page(p) for p in pages]
    known = set()
    for stream, _ in read:
        groups(fold(stream), known)
    nodes: list = []
    for _ in read:
        was = list(nodes)
        for stream, _ in read:
            shape = fold(stream, known)
            nodes = align(nodes, shape) if nodes else shape
        if nodes == was:
            break
    wrapper = Wrapper(nodes, article_roots([s for _, slots in read for s in slots]))
    wrapper.fixed = template(wrapper, read)
    return wrapper


def article_roots(slots: list[Slot]) -> list[str]:
    """Paths of the elements marked as article that hold text, joined by blanks."""
    marked = Counter()
    for s in slots:
        if s.gone:
            continue
        for k, key in enumerate(s.path):
            name, *marks = key.split(".")
            if is_article(name, tuple(marks)):
                marked[" ".join(s.path[: k + 1])] += len(s.text)
                break
    inner = {r for r in marked if r.split(" ")[-1].split(".")[0] == "article"}
    return sorted(inner or marked)


def main_text(page: str | None, wrapper: Wrapper | None) -> tuple[str, bool]:
    """(text, whether the wrapper matched as it was)."""
    stream, slots = read_page(page)
    kept = [s for s in slots if not s.gone]
    fits = wrapper is not None and wrapper.fits(stream)
    # the page's own articles too: the host's are those of its sampled pages
    roots = [*(wrapper.roots if wrapper else []), *article_roots(slots)]
    under = lambda some: [s for s in some if any(" ".join(s.path[: r.count(" ") + 1]) == r for r in roots)]
    found = wrapper.content(stream, slots) if wrapper else kept
    found = under(found) or under(kept) or found or kept
    return "\n".join(s.text for s in found), fits


def _nodes(x: list) -> list:
    return [n if isinstance(n, str) else (n[0], tuple(_nodes(n[1]))) for n in x]


def _wrapper(raw: str | None, fixed: str | None, met: dict) -> Wrapper | None:
    if not raw:
        return None
    if (raw, fixed) not in met:
        if len(met) > 500:
            met.clear()
        held = {}
        for x in json.loads(fixed or "[]"):
            at, path = json.loads(x["key"])
            held[tuple(at), path] = frozenset(x["texts"])
        met[raw, fixed] = Wrapper(_nodes(json.loads(raw)), [], held)
    return met[raw, fixed]


READ = "host string, h long, shape long, nodes string"


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, h, html) to the hash of the page's shape, and the shape itself where the task meets it first."""
    met: dict[tuple, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            shapes, told = [], []
            for host, page in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                key = (host, *read_page(page)[0])
                told.append(None)
                if key not in met:
                    if len(met) > 2000:
                        met.clear()
                    told[-1] = json.dumps(fold(list(key[1:])))
                    met[key] = xxhash.xxh3_64_intdigest(told[-1].encode("utf-8", "surrogatepass")) - 2**63
                shapes.append(met[key])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shapes, pa.int64()), pa.array(told, pa.string())], ["host", "h", "shape", "nodes"])


MERGED = "host string, nodes string, longest int, members array<long>"


def _merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    shapes = [(_nodes(json.loads(n)), int(m), [int(i) for i in of]) for n, m, of in zip(rows["nodes"], rows["longest"], rows["members"], strict=True)]
    made = merged(sorted(shapes, key=lambda x: (-x[1], min(x[2]))))
    return pd.DataFrame({"host": [key[0]] * len(made), "nodes": [json.dumps(w[0]) for w in made], "longest": [w[1] for w in made], "members": [w[2] for w in made]})


SEEN = "host string, cls long, h long, total long, places array<string>, slots array<struct<key: string, element: string, sig: string, texts: array<string>, n: long>>"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, cls, h, html, nodes) to the page's ``facts``, texts as digests."""
    met: dict = {}
    names = ["host", "cls", "h", "total", "places", "slots"]
    kind = pa.list_(pa.struct([("key", pa.string()), ("element", pa.string()), ("sig", pa.string()), ("texts", pa.list_(pa.string())), ("n", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            totals, places_, slots = [], [], []
            for page, raw in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                total, own_places, own = facts(_wrapper(raw, None, met), *read_page(page))
                totals.append(total)
                places_.append(sorted(own_places))
                slots.append([])
                for (slot, path), texts in own.items():
                    told = [*map(digest, texts)]
                    slots[-1].append({"key": json.dumps([slot, path]), "element": path.rpartition(" ")[0], "sig": digest(" ".join(told)), "texts": [*dict.fromkeys(told)], "n": sum(map(len, texts))})
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(totals, pa.int64()), pa.array(places_, pa.list_(pa.string())), pa.array(slots, kind)], names)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met: dict = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts, fits = [], []
            for page, raw, fixed in zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                text, fit = main_text(page, _wrapper(raw, fixed, met))
                texts.append(text)
                fits.append(fit)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(fits)], ["page_id", "url", "text", "n_chars", "fits"])


def wrappers(pages: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of all pages (host, h, html), h being the hash of html: (host, cls, nodes), a row a wrapper, and (host, h, cls) of the pages of hosts
    with more than one; the wrapper of other hosts has cls 0."""
    read = scratch.keep(pages.select("host", "h", "html").mapInArrow(_shapes, READ))
    told = read.where("nodes is not null").groupBy("host", "shape").agg(F.min("nodes").alias("nodes"))
    rows = scratch.keep(told.select("host", "nodes", F.json_array_length("nodes").alias("longest"), F.array("shape").alias("members")))
    n, level = rows.count(), 0
    while n:
        # shapes of a host meet in groups, the wrappers of groups in the next round, until they grow no fewer
        sizes = rows.groupBy("host").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
        part = F.pmod(F.xxhash64(F.array_min("members"), F.lit(level)), F.col("parts")).alias("part")
        rows = scratch.keep(rows.join(sizes, "host").select("host", "nodes", "longest", "members", part).groupBy("host", "part").applyInPandas(_merge, MERGED))
        was, n, level = n, rows.count(), level + 1
        if 10 * n > 9 * was or n == rows.select("host").distinct().count():
            break
    many = rows.groupBy("host").agg((F.count("*") > 1).alias("many"))
    rows = rows.join(many, "host").withColumn("cls", F.when(F.col("many"), F.array_min("members")).otherwise(0))
    rows = scratch.keep(rows.select("host", "cls", "nodes", "many", "members"))
    of = rows.where("many").select("host", "cls", F.explode("members").alias("shape"))
    return rows.select("host", "cls", "nodes"), scratch.keep(read.select("host", "h", "shape").distinct().join(of, ["host", "shape"]).select("host", "h", "cls"))


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, cls, fixed): the slots that hold the same on all different pages (host, cls, h, html, nodes) of a wrapper."""
    seen = scratch.keep(pages.select("host", "cls", "h", "html", "nodes").mapInArrow(_facts, SEEN).dropDuplicates(["host", "cls", "h"]))
    slots = seen.select("host", "cls", F.explode("slots").alias("s")).select("host", "cls", "s.*").groupBy("host", "cls", "key")
    slots = slots.agg(F.first("element").alias("element"), ((F.count("*") >= FIXED) & (F.min("sig") == F.max("sig"))).alias("same"), F.first("texts").alias("texts"), F.sum("n").alias("n"))
    slots = scratch.keep(slots)
    own = seen.select("host", "cls", F.explode("places").alias("element")).union(slots.where("not same").select("host", "cls", "element")).distinct()
    # elements, below body, in which the text of a page itself stands
    own = own.where(~F.regexp_extract("element", r"([^ .]*)[^ ]*$", 1).isin("", "html", "body"))
    same = slots.where("same").join(own, ["host", "cls", "element"], "left_anti").groupBy("host", "cls")
    same = same.agg(F.to_json(F.sort_array(F.collect_list(F.struct("key", "texts")))).alias("fixed"), F.sum("n").alias("n"))
    total = seen.groupBy("host", "cls").agg(F.sum("total").alias("total"))
    return same.join(total, ["host", "cls"]).where("2 * n <= total").select("host", "cls", "fixed")


def extract(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, fits) of every row of ``pages``."""
    scratch = scratch or Scratch(pages.sparkSession, "wrappers")
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host.alias("host"), F.xxhash64("html").alias("h"))
    learnt = pages.where("html <> ''")
    made, of = wrappers(learnt, scratch)
    n, n_of = made.count(), of.count()
    # a wrapper is a few kB: up to 5,000 they travel to every task, beyond that pages meet them in a join
    own = lambda some, wrapped: join_small(join_small(some, of, ["host", "h"], "left", n_of).withColumn("cls", F.coalesce("cls", F.lit(0))), wrapped, ["host", "cls"], "left", n, 5_000)
    fixed = scratch.keep(templates(own(learnt, made), scratch))
    met = own(pages, scratch.keep(made.join(fixed, ["host", "cls"], "left")))
    return met.select("page_id", "url", "html", "nodes", "fixed").mapInArrow(_extract, "page_id long, url string, text string, n_chars long, fits boolean")
