"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host and URL path; each is paired with that of the nearest pages before and after it on its
host whose path shares the longer prefix with its own (the one before, if both share as much). Copies and near copies of a page (print versions, mirrors)
are passed over, as the lines shared with them are not the site's: pages are copies if their common lines hold
``COPY_SHARE`` of the characters of all their lines, judged by up to ``SKETCHED_LINES`` line hashes. All text lines (blocks) of the two are aligned by their longest common
subsequence, and lines they share are deleted as the site's template.

Two structural rules go with it. What
stands in an element made for menus, headers, footers, side bars, notices, adverts, forms, scripts, styles
or comments, by name or by whole names in its class or role (outside main elements also its id or label; of
headings and paragraphs, only adverts), or that is hidden, is never text (of a header inside a main element the
headings stay; a marked wrapper ends where a main element begins). And where declared main elements
(article, main) hold ``MAIN_SHARE`` or more of the characters that differencing leaves, they are the article: nothing outside them is text,
and their lines stay also where another page repeats them, as two articles may share a passage. Main elements that hold less, such as a teaser beside the
story, are lines like any others. End tags that HTML lets a page omit are implied.

The sorted order is cut into ranges of about ``RANGE_BYTES`` at sampled keys (a bounded number goes to the driver), so a host of any
size is spread over tasks. A range also gets, from either side, the nearest page and the nearest that is no copy
of it, however many ranges a group of copies fills; a first pass over line sketches finds them. A range is held in
memory while it is compared. Only hashes of lines are compared; page texts travel compressed.

Defined cases: null or empty html gives an empty text; a null url is a host of its own without path; pages
that repeat are treated one by one; a page without a neighbour that is no copy loses no line by differencing; unclosed elements end where
their main element or the page ends; unknown character references stay as they are; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import discard, materialise

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/a-zA-Z][^<>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav aside footer form head header menu button select dialog noscript object audio video canvas".split())
MAIN = ("article", "main")
#: Words of class, id, role or label that mark what is no article.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall nav navbar navigation navi menu menus breadcrumb breadcrumbs sidebar aside widget widgets header masthead topbar footer comment comments commentlist disqus respond replies reply discussion share sharing social related recommended recommendations outbrain taboola pagination pager toolbar search complementary contentinfo".split()
)
#: Words that say nothing of their own in a name with a marked word (``ad-slot``, ``comments-area``).
NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons container content entry form global group holder icon icons inline inner item items left link links list main module outer page panel post posts primary right secondary section site slot thread top unit wrap wrapper".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies respond discussion".split())
#: What ids tell inside a main element, where they are mostly anchors of its headings and sections.
COMMENT_IDS = frozenset("comment comments commentlist disqus".split())
#: What classes tell of headings and paragraphs.
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
TABLE = frozenset("caption colgroup table tbody td tfoot th thead tr".split())
WORDS = re.compile(r"[a-z0-9]+")
#: Elements whose end tag may be missing: the start tags that end them, and the elements that these do not look beyond.
CELLS, ROWS = ("td", "th"), ("tbody", "tfoot", "thead")
SCOPE = ("button", "caption", "object", "table", "td", "th", "article", "main")
ITEM_SCOPE = tuple(BLOCKS - {"address", "dd", "div", "dt", "li", "p"}) + ("button", "object")
IMPLIED = {name: (("p",), SCOPE) for name in BLOCKS - {"body", "caption", "dd", "dt", "html", "legend", "li", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}} | {
    "li": (("li",), ITEM_SCOPE), "dd": (("dd", "dt"), ITEM_SCOPE), "dt": (("dd", "dt"), ITEM_SCOPE), "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (CELLS, ("table",)), "th": (CELLS, ("table",)), "tr": ((*CELLS, "tr"), ("table",)), **dict.fromkeys(ROWS, ((*CELLS, "tr", "caption", *ROWS), ("table",))),
}
COPIES = "bucket int, key string, page_id {id}, url string, copy boolean, hashes array<bigint>, sizes array<int>, kinds array<tinyint>, text binary"
RESULT_COLUMNS = ["page_id", "url", "text"]
#: Where a line stands: in an element that is left out, in a main element, or elsewhere.
FURNITURE, PLAIN, IN_MAIN = 0, 1, 2
#: Main elements are a page's article if they hold this share of the characters of all its lines that are its own.
MAIN_SHARE = 0.3
#: Bytes of html of a range of pages, the most ranges, and keys sampled for each.
RANGE_BYTES, RANGES, SAMPLED_KEYS = 16 << 20, 250_000, 8
#: Matches per line from which on lines are aligned by halves.
MATCHES = 8
ENDS = "bucket int, side string, place int, key string, sketch binary"
#: Two pages are copies if the lines they share hold this share of the characters of all their lines.
COPY_SHARE = 0.7
#: Lines (those of the least hashes) by which two pages are compared, and pages kept on the way to one that is no copy.
SKETCHED_LINES, TRAIL = 128, 4


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by lower-case name; of equal names the first counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def marked(names: list[str], words: frozenset[str]) -> set[str]:
    """The telling words of whole names: each word of a name is telling, neutral or a number, and one is telling."""
    found: set[str] = set()
    for name in names:
        parts = WORDS.findall(name.lower())
        if all(w in words or w in NEUTRAL or w.isdigit() for w in parts):
            found.update(w for w in parts if w in words)
    return found


def marks(name: str, attributes: str, inside: bool) -> set[str]:
    """The telling words of class and role, and outside main elements of id and label; ``hidden`` for what is not shown."""
    values = attributes_of(attributes)
    words = ADVERTS if name in PROSE else MARKED
    found = marked(f"{values.get('class', '')} {values.get('role', '')}".split(), words)
    if name not in PROSE:
        found |= marked([values.get("id", "")], COMMENT_IDS if inside or name in MAIN else MARKED - {"discussion"})
        if not inside:
            found |= marked([values.get("aria-label", "")], words)
    if name in TABLE:
        found -= {"header", "masthead"}
    styles = (x.partition(":") for x in values.get("style", "").lower().split(";"))
    shown = not any(k.strip() == "display" and v.replace("!important", "").strip() == "none" for k, _, v in styles)
    return found if shown and "hidden" not in values else found | {"hidden"}


def left_out(name: str, attributes: str, inside: bool = False) -> str:
    """How an element is left out: ``header`` (headings in a main element stay), another reason, or not at all (empty)."""
    found = marks(name, attributes, inside) if attributes else set()
    if name in MAIN:
        return "comments" if found & COMMENTS or "hidden" in found else ""
    if name in ("html", "body"):
        return ""
    if name == "header" or found and found <= {"header", "masthead"}:
        return "header"
    return name if name in OUTSIDE else "marked" if found else ""


class Open:
    """The open elements of a page, with the places of each name, so that no step walks over them."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}

    def push(self, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def last(self, name: str) -> int:
        return at[-1] if (at := self.places.get(name)) else -1

    def cut(self, at: int) -> list[str]:
        """Close the elements from ``at`` on."""
        gone = self.names[at:]
        for name in gone:
            self.places[name].pop()
        del self.names[at:]
        return gone

    def ended_by_start(self, name: str) -> int:
        """The first element that a start tag of ``name`` closes, or -1."""
        closed, scope = IMPLIED.get(name, ((), ()))
        if not any(self.places.get(x) for x in closed):
            return -1
        barrier = max(self.last(x) for x in scope)
        return min((at for x in closed if (at := self.last(x)) > barrier), default=-1)

    def ended_by_end(self, name: str, skipped: int) -> int:
        """The element that an end tag of ``name`` closes, or -1. Nothing but its own end tag closes a main element."""
        at = self.last(name)
        if at < 0 or name in MAIN or at == skipped or at == len(self.names) - 1:
            return at
        scope = ("table", *MAIN) if name in TABLE and name != "table" else MAIN if name == "table" else SCOPE if name in BLOCKS or name in OUTSIDE else BLOCKS
        return at if all(self.last(x) <= at for x in scope) else -1


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """The text blocks of a page in order, and whether each stands in a main element, in a marked one (left out), or in neither."""
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    opened = Open()
    #: Places of the main elements that are text; place of the element that is left out (-1: none).
    mains: list[int] = []
    skipped, why, heading = -1, "", False
    at = 0

    def close() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append((text, FURNITURE if skipped >= 0 and not heading else IN_MAIN if mains else PLAIN))

    def cut(place: int) -> None:
        nonlocal skipped, heading
        close()
        opened.cut(place)
        while mains and mains[-1] >= place:
            mains.pop()
        if 0 <= place <= skipped:
            skipped, heading = -1, False

    for token in TOKEN.finditer(html or ""):
        parts.append(html[at : token.start()])
        at = token.end()
        name = (token[3] or "").lower()
        if not name:
            continue
        closing = bool(token[2])
        if skipped >= 0:
            if why == "header" and mains and re.fullmatch("h[1-6]", name):
                close()
                heading = not closing
            if closing and name in ("body", "html"):
                cut(skipped)
            elif not closing and name in MAIN and not mains and why in ("marked", "form", "header") and opened.names[skipped] != "header" and not left_out(name, token[4]):
                close()
                skipped, heading = -1, False
        if name in BLOCKS:
            close()
        elif name == "br":
            parts.append(" ")
        if closing:
            if (place := opened.ended_by_end(name, skipped)) >= 0:
                if name in BLOCKS or place <= skipped or name in OUTSIDE:
                    cut(place)
                else:
                    opened.cut(place)
            continue
        if (place := opened.ended_by_start(name)) >= 0:
            cut(place)
        if name in VOID or skipped >= 0 and token[4].rstrip().endswith("/"):
            continue
        if skipped < 0 and (why := left_out(name, token[4], bool(mains))):
            close()
            skipped, heading = len(opened.names), False
        elif skipped < 0 and name in MAIN:
            mains.append(len(opened.names))
        opened.push(name)
    parts.append((html or "")[at:])
    close()
    return lines


def shared_lines(mine: np.ndarray, other: np.ndarray) -> list[int]:
    """The places in ``mine`` of a longest common subsequence with ``other``.

    Equal lines at both ends match each other. What is between goes by increasing matches, or by halves where lines
    repeat so often that the matches would be many.
    """
    a, b = mine.tolist(), other.tolist()
    n = min(len(a), len(b))
    head = next((k for k in range(n) if a[k] != b[k]), n)
    tail = next((k for k in range(n - head) if a[-1 - k] != b[-1 - k]), n - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict[int, list[int]] = {}
    for j, h in enumerate(b):
        places.setdefault(h, []).append(j)
    matches = sum(len(places.get(h, ())) for h in a)
    between = by_halves(a, b) if matches > MATCHES * (len(a) + len(b)) else by_matches(a, places)
    return [*range(head), *(head + k for k in between), *range(len(mine) - tail, len(mine))]


def prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """For every prefix of ``b`` the length of its longest common subsequence with ``a``, by one addition of long numbers for each line of ``a``."""
    masks: dict[int, int] = {}
    for j, h in enumerate(b):
        masks[h] = masks.get(h, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for h in a:
        met = row & masks.get(h, 0)
        row = (row + met | row - met) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def by_halves(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence, in memory linear in both: the halves of ``a`` with the parts of ``b`` that fit them best."""
    found: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if j - i == 1:
            found += [i] * (a[i] in b[k:m])
        elif j > i and m > k:
            half = (i + j) // 2
            both = prefix_lengths(a[i:half], b[k:m]) + prefix_lengths(a[half:j][::-1], b[k:m][::-1])[::-1]
            cut = k + int(both.argmax())
            todo += [(half, j, cut, m), (i, half, k, cut)]
    return found


def by_matches(a: list[int], places: dict[int, list[int]]) -> list[int]:
    """Places in ``a`` of a longest common subsequence, line by line over the places that hold the same in the other."""
    ends: list[int] = []
    chains: list[tuple[int, tuple | None]] = []
    for i, h in enumerate(a):
        for j in reversed(places.get(h, ())):
            k = bisect_right(ends, j - 1)
            chain = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(chain)
            else:
                ends[k], chains[k] = j, chain
    out, chain = [], chains[-1] if chains else None
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def url_key(url: str | None, page_id: object) -> str:
    """Host, path and id, so that the order of keys is the order of paths within hosts."""
    host, _, path = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", "", url or "").partition("/")
    return f"{host.lower()}\0{re.split('[?#]', path, maxsplit=1)[0]}\0{page_id!s:>20}"


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def hashes_of(lines: list[tuple[str, int]]) -> list[int]:
    return [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 for t, _ in lines]


def sketch_of(hashes: list[int], sizes: list[int]) -> dict[int, int]:
    """Characters of the distinct lines of least hash."""
    sizes_by_hash = dict(zip(hashes, sizes, strict=True))
    return {h: sizes_by_hash[h] for h in sorted(sizes_by_hash)[:SKETCHED_LINES]}


def packed(sketch: dict[int, int]) -> bytes:
    return np.array([*sketch.keys(), *sketch.values()], np.int64).tobytes()


def unpacked(sketch: bytes) -> dict[int, int]:
    both = np.frombuffer(sketch, np.int64).tolist()
    return dict(zip(both[: len(both) // 2], both[len(both) // 2 :], strict=True))


def are_copies(a: dict[int, int], b: dict[int, int]) -> bool:
    """Whether the lines that two sketches share hold enough of the characters (two pages without lines are copies)."""
    full = [next(reversed(x)) for x in (a, b) if len(x) == SKETCHED_LINES]
    if full:
        a, b = ({h: n for h, n in x.items() if h <= min(full)} for x in (a, b))
    common = sum(n for h, n in a.items() if h in b)
    return common >= COPY_SHARE * (sum(a.values()) + sum(b.values()) - common)


def follow(trail: list[tuple], page: tuple) -> tuple | None:
    """The last page of the trail that is no copy of ``page``, a tuple of key and sketch first, which is put at its end.

    A page takes the place of the copy before it, so a group of copies of any size is one step of the trail.
    """
    if trail and trail[-1][0].partition("\0")[0] != page[0].partition("\0")[0]:
        trail.clear()
    found = next((p for p in reversed(trail) if not are_copies(p[1], page[1])), None)
    if trail and (found is not trail[-1]):
        trail[-1] = page
    else:
        trail.append(page)
    del trail[:-TRAIL]
    return found


def keys_of(batch: pa.RecordBatch) -> list[str]:
    return [url_key(u, i) for i, u in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True)]


def deal_sketches(cuts: Broadcast):
    """Batches of page_id, url and html to bucket, key and sketch."""

    def deal_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(batch)
            pages = ([line for line in lines_of(html) if line[1] != FURNITURE] for html in batch.column("html").to_pylist())
            sketches = [packed(sketch_of(hashes_of(lines), [len(t) for t, _ in lines])) for lines in pages]
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(cuts.value, k) for k in keys], pa.int32()), pa.array(keys, pa.string()), pa.array(sketches, pa.binary())], names=["bucket", "key", "sketch"])

    return deal_out


def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted keys and sketches to, per bucket and side, the outermost page (place 0) and the next of its host that is no copy of it (1)."""
    bucket, head, tail, trail, rows = None, [], [], [], []

    def ends() -> list[tuple]:
        return [(bucket, side, place, *page) for side, pages in (("head", head), ("tail", tail)) for place, page in enumerate(pages) if page]

    for batch in batches:
        for b, key, sketch in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "sketch")), strict=True):
            page = (key, unpacked(sketch))
            if b != bucket:
                rows += ends()
                bucket, head, trail = b, [page], []
            elif len(head) == 1:
                if key.partition("\0")[0] != head[0][0].partition("\0")[0]:
                    head.append(None)
                elif not are_copies(page[1], head[0][1]):
                    head.append(page)
            tail = [page, follow(trail, page)]
    for row in [*rows, *ends()]:
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((*row[:4], packed(row[4])), (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.binary()), strict=True)], names=["bucket", "side", "place", "key", "sketch"])


def carried(ends: DataFrame) -> dict[str, list[int]]:
    """Keys of the pages that buckets get of others: on each side the nearest page and the nearest that is no copy of it.

    The ends, a few short rows a bucket, stream through the driver in the order of the buckets, once each way.
    """
    out: dict[str, list[int]] = {}
    for near, far, order in (("tail", "head", F.asc), ("head", "tail", F.desc)):
        trail: list[tuple] = []
        rows = ends.orderBy(order("bucket"), "place").select("bucket", "side", "key", "sketch").toLocalIterator()
        for bucket, group in groupby(rows, key=lambda r: r["bucket"]):
            sides: dict[str, list[tuple]] = {"head": [], "tail": []}
            for row in group:
                sides[row["side"]].append((row["key"], row["sketch"]))
            host = sides[far][0][0].partition("\0")[0]
            for key, _ in trail[-2:]:
                if key.partition("\0")[0] == host and bucket not in out.setdefault(key, []):
                    out[key].append(bucket)
            for key, sketch in reversed(sides[near]):
                follow(trail, (key, unpacked(sketch)))
    return out


def deal(cuts: Broadcast, ends: Broadcast):
    """Batches of page_id, url and html to rows of a bucket, with copies of the pages that other buckets need."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            rows: list[tuple] = []
            at: list[int] = []
            for n, (key, html) in enumerate(zip(keys_of(batch), batch.column("html").to_pylist(), strict=True)):
                lines = lines_of(html)
                found = (hashes_of(lines), [len(t) for t, _ in lines], [k for _, k in lines])
                text = "\0".join(t.replace("\0", " ") for t, k in lines if k != FURNITURE)
                rows.append((bisect_right(cuts.value, key), key, False, *found, pack(text.encode("utf-8", "surrogatepass"))))
                at.append(n)
                for bucket in ends.value.get(key, ()):
                    rows.append((bucket, key, True, *found, None))
                    at.append(n)
            if rows:
                take = pa.array(at, pa.int64())
                kinds = (pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.binary())
                made = [pa.array(list(x), kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([made[0], made[1], batch.column("page_id").take(take), batch.column("url").take(take), *made[2:]], names=["bucket", "key", "page_id", "url", "copy", "hashes", "sizes", "kinds", "text"])

    return whole


class Page:
    """A page of a bucket: the hashes, sizes and kinds of all its lines, and its packed text."""

    __slots__ = ("hashes", "key", "kinds", "own", "sizes", "text")

    def __init__(self, key: str, hashes: np.ndarray, sizes: np.ndarray, kinds: np.ndarray, text: bytes | None, own: tuple | None):
        self.key, self.hashes, self.sizes, self.kinds, self.text, self.own = key, hashes, sizes, kinds, text, own

    def sketch(self) -> dict[int, int]:
        kept = self.kinds != FURNITURE
        return sketch_of(self.hashes[kept].tolist(), self.sizes[kept].tolist())

    def undecided(self) -> bool:
        """Whether lines stand outside main elements and what is left out: differencing tells which are the page's own."""
        return self.own is not None and bool((self.kinds == PLAIN).any())

    def kept(self, near: list[Page]) -> np.ndarray:
        """Which lines are the main text. Lines shared with the nearest page are the site's, but for those of main elements that hold enough of what is left."""
        shared = np.zeros(len(self.hashes), bool)
        if near and self.undecided():
            other = max(near, key=lambda p: common_prefix(p.key, self.key))
            shared[shared_lines(self.hashes, other.hashes)] = True
        main = self.kinds == IN_MAIN
        own = (self.kinds == PLAIN) & ~shared
        held, rest = int(self.sizes[main].sum()), int(self.sizes[own].sum())
        return main if held and held >= MAIN_SHARE * (held + rest) else own | main & ~shared


def pages_of(batch: pa.RecordBatch) -> Iterator[tuple[int, Page]]:
    lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in map(batch.column, ("hashes", "sizes", "kinds"))]
    plain = (batch.column(c).to_pylist() for c in ("bucket", "key", "page_id", "url", "copy", "text"))
    for k, (bucket, key, page_id, url, copy, text) in enumerate(zip(*plain, strict=True)):
        yield bucket, Page(key, *(values[at[k] : at[k + 1]] for at, values in lists), text, None if copy else (page_id, url))


def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pages to their main texts: each is compared with the nearer of the next pages before and after it that are no copies of it."""
    unpack = zstandard.ZstdDecompressor().decompress

    def text_of(page: Page, near: list[Page]) -> str:
        lines = unpack(page.text).decode("utf-8", "surrogatepass").split("\0")
        kept = page.kept(near)[page.kinds != FURNITURE]
        return "\n\n".join(line for line, keep in zip(lines, kept.tolist(), strict=False) if keep)

    def batch_of(pages: list[Page]) -> pa.RecordBatch:
        near: list[list[Page]] = [[] for _ in pages]
        if any(p.undecided() for p in pages):
            for order in (1, -1):
                trail: list[tuple] = []
                for k in range(len(pages))[::order]:
                    if found := follow(trail, (pages[k].key, pages[k].sketch(), pages[k])):
                        near[k].append(found[2])
        done = [(*page.own, text_of(page, others)) for page, others in zip(pages, near, strict=True) if page.own is not None]
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((id_kind, pa.string(), pa.string()))], names=RESULT_COLUMNS)

    pages: list[Page] = []
    last, id_kind = None, None
    for batch in batches:
        id_kind = batch.schema.field("page_id").type
        for bucket, page in pages_of(batch):
            if pages and bucket != last:
                yield batch_of(pages)
                pages = []
            last = bucket
            pages.append(page)
    if pages:
        yield batch_of(pages)


def range_cuts(rows: DataFrame) -> list[str]:
    """Keys that cut the pages into ranges of about ``RANGE_BYTES`` of html, from a hash sample of bounded size."""
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    ranges = min(RANGES, max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES)))
    every = max(1, n // (SAMPLED_KEYS * ranges))
    sample = rows.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(every)) == 0).select("page_id", "url", F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"))
    keyed = sorted((url_key(r["url"], r["page_id"]), r["size"] + 1) for r in sample.collect())
    share = max(1, sum(s for _, s in keyed) // ranges)
    before = accumulate((s for _, s in keyed), initial=0)
    return sorted({key for (key, s), at in zip(keyed, before, strict=False) if at // share != (at + s) // share})


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    context = pages.sparkSession.sparkContext
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    cuts = context.broadcast(range_cuts(rows))
    buckets = len(cuts.value) + 1
    sketches = rows.mapInArrow(deal_sketches(cuts), "bucket int, key string, sketch binary").repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "key")
    ends = materialise(sketches.mapInArrow(ends_of, ENDS), "range-ends")
    needed = context.broadcast(carried(ends))
    discard(ends)
    dealt = rows.mapInArrow(deal(cuts, needed), COPIES.format(id=kind))
    return dealt.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "key", "copy").mapInArrow(difference, f"page_id {kind}, url string, text string")


def op10_html_extraction(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    return extract_main_text(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
