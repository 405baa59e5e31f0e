"""HTML extraction with a suffix array over the pages of a host (operator 5).

Pages are parsed into blocks: a text, its words and its slot (the path of elements it stands in). The
token streams of a host's pages, slot marks included, are one long stream, whose suffixes are sorted (prefix
doubling); each has the length that it shares with its neighbour. An interval of neighbours that share DEPTH
tokens or more is a run of text that the pages in it repeat. Every suffix of every page takes part. A whole
block is a suffix of its own.

A host of many pages is cut into parts by the pages' content, each sorted by itself. What is on a share of
the host's pages is on that share of some part's pages, so the parts give all candidates; these are then
counted over the whole host, exactly.

Covered text goes: a block most of which lies in runs seen on many pages of the host, and a block in a
slot most of whose text is repeated. Unique runs stay, and so do runs that few pages share.

What a page itself declares is exact evidence: elements such as nav, footer, aside, form or script, and
classes, ids and roles that name menus, notices, adverts or comments, never hold main text, whatever is
unique in them; and if a page has article elements (else main, else a container named as content), its
main text is what they hold, passages that few pages share included, but for blocks that most pages of
the host have in the same slot, or that runs on most pages nearly fill. A page that declares nothing is decided by the suffix array alone.

Evidence is counted over all pages of a host and joined back page by page, so no task holds a host and
results do not depend on how pages are partitioned.

Cases: null, empty and markup-free pages (the text itself is then one block) have defined texts;
broken and unclosed markup is closed as browsers do for the elements below, in time and memory in
proportion to the page; null urls form a host of their own; repeated rows give repeated results; pages
of one host that are copies of each other count as one page; an empty table gives none; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches, stored

#: Tokens that a repeated run has at least.
DEPTH = 8
#: Pages, and characters of markup, of a host that one array holds.
PART_PAGES, PART_CHARS = 1024, 1 << 24
#: Bytes of token streams that are sorted together, whole hosts or parts of them.
TOGETHER = 1 << 21
#: Share of a slot's text that is repeated, above which the slot is boilerplate; a block counts as repeated
#: on this share of the host's pages, or two.
SLOT, SEVERAL = 0.5, 0.05
#: Share of a block that runs seen on this share of the host's pages, or two, must cover.
COVERED, PAGES = 0.6, 0.3
#: Share of a block in a declared container that runs on most of the host's pages must cover.
NEARLY = 0.8
#: Share of the host's pages, and least number, that hold a block which goes inside declared containers too.
USUAL, LEAST = 0.5, 4

# Elements of the HTML standard by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
CHROME = frozenset(
    "aside button canvas datalist dialog footer form head iframe input label menu nav noembed noframes noscript object option "
    "script search select style svg template textarea title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Parts of class names and ids that name what is not main text.
NAMED = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share comment comments consent cookie cookies "
    "copyright cta disclaimer disqus footer gdpr header hidden login masthead menu menus modal nav navbar navigation navi newsletter notice "
    "notices notification outbrain overlay pager pagination paywall popup promo promos promotion reader-comments recommended recommendations "
    "related replies reply respond share sharing shares sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription "
    "taboola tags teaser toolbar topbar widget widgets".split()
)
# Whole class names that tell inside declared content too, on any element but headings and paragraphs.
WHOLE = (NAMED - {"header"}) | frozenset(
    "ad-container ad-slot comment-form comment-list comments-area comments-section cookie-banner cookie-notice related-articles related-links "
    "related-posts related-stories share-bar share-buttons share-links sharing-buttons social-buttons social-icons social-links social-media "
    "social-share tag-list".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
# Words that name a reader's comment.
COMMENTS = frozenset("comment comments reply replies respond".split())
# Words that name the main text.
CONTENT = frozenset("article articlebody content entry main maincontent post story".split())
#: An element that opens closes these if they are open, up to a container.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_OPENS = re.compile(r"<(?:!--|/?[a-zA-Z]|[!?/])")
_NAME = re.compile(r"[^\s/>]+")
_STOPS = re.compile(r"[\"'>]")
_NAMES = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_LETTERS = re.compile(r"[a-z][A-Z]")

CHROME_ROLE, ARTICLE, MAIN, NAMED_CONTENT, PLAIN = range(5)
DECLARED = (ARTICLE, MAIN, NAMED_CONTENT)


class Block(NamedTuple):
    text: str
    slot: int
    role: int


def _role(tag: str, attributes: str, above: int) -> int:
    """What an element is by its name and attributes, in one that is `above`. Headings and paragraphs are
    never judged by names; inside declared content only whole class names count, not parts of words, and
    ids only on a div. An article named as a comment is a reader's."""
    if tag in CHROME or tag == "header" and above not in (ARTICLE, MAIN):
        return CHROME_ROLE
    out = ARTICLE if tag == "article" else MAIN if tag == "main" else PLAIN
    if "=" not in attributes and "hidden" not in attributes:
        return out
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    role = found.get("role", "").lower()
    if role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "").lower()):
        return CHROME_ROLE
    classes = set(found.get("class", "").lower().replace("_", "-").split())
    names = f"{found.get('class', '')} {found.get('id', '')}"
    parts = set(_NAMES.split(_LETTERS.sub(lambda m: f"{m[0][0]} {m[0][1]}", names).lower()))
    if tag == "article":
        return CHROME_ROLE if parts & COMMENTS else out
    if above in DECLARED:
        whole = classes | {found.get("id", "").lower().replace("_", "-")} if tag == "div" else classes
        telling = bool(whole & WHOLE)
    else:
        telling = bool(parts & NAMED)
    if tag not in ("html", "body", "main") and tag not in HEADINGS and telling:
        return CHROME_ROLE
    if out == PLAIN and role in ("main", "article"):
        return MAIN if role == "main" else ARTICLE
    if out == PLAIN and tag in ("div", "section", "td") and parts & CONTENT:
        return NAMED_CONTENT
    return out


class _Tags:
    """The markup of a page, from its start to its end: text and tags in turn. What was not found ahead
    once is not looked for again, so the time is in proportion to the page."""

    def __init__(self, source: str):
        self.source, self.quotes = source, True

    def _end(self, at: int) -> int:
        """Where the tag that is open at `at` ends (its '>'), -1 if nowhere."""
        first = self.source.find(">", at)
        while self.quotes and first >= 0:
            m = _STOPS.search(self.source, at)
            if m and m[0] == ">":
                return m.start()
            at = self.source.find(m[0], m.end()) + 1 if m else 0
            self.quotes = at > 0  # of a quote that never closes on, quotes mean nothing
        return first

    def __iter__(self) -> Iterator[tuple[str, str, bool, str, int]]:
        """Text before a tag, its name (empty for comments and the end), whether it closes, attributes, its end."""
        source, at, size = self.source, 0, len(self.source)
        while at < size:
            m = _OPENS.search(source, at)
            end = -1 if m is None else self._end(m.end()) if m[0][-1].isalpha() else 0
            if m is None or end < 0:
                yield source[at:], "", False, "", size
                return
            text, kind = source[at : m.start()], m[0]
            if kind == "<!--":
                end = source.find("-->", m.end())
                at = size if end < 0 else end + 3
                yield text, "", False, "", at
            elif not kind[-1].isalpha():
                end = source.find(">", m.end())
                at = size if end < 0 else end + 1
                yield text, "", False, "", at
            else:
                name = _NAME.match(source, m.end() - 1)[0]
                at = end + 1
                back = yield text, name.lower(), kind[1] == "/", source[m.end() - 1 + len(name) : end], at
                if back is not None:
                    at = back
                    yield "", "", False, "", at


def blocks(html: str | None) -> list[Block]:
    """The blocks of a page in order; the role is CHROME_ROLE inside what the page declares to be no main
    text, else the strongest declaration around the block. The slot is a hash of the block elements around."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # element, role and slot with all around it
    places: list[int] = []  # of block elements in the stack
    open_: Counter[str] = Counter()
    text: list[str] = []

    def flush() -> None:
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, stack[-1][2] if stack else 0, stack[-1][1] if stack else PLAIN))
            text.clear()

    def close(k: int) -> None:
        if places and places[-1] >= k or stack[k][1] != (stack[k - 1][1] if k else PLAIN):
            flush()
        while places and places[-1] >= k:
            places.pop()
        for tag, _, _ in stack[k:]:
            open_[tag] -= 1
        del stack[k:]

    source = html or ""
    tags = iter(_Tags(source))
    back = None
    while True:
        try:
            before, name, closing, attributes, at = tags.send(back)
        except StopIteration:
            break
        back = None
        if before:
            text.append(before)
        if not name:
            continue
        if closing:
            if open_[name]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            elif name in BLOCKS:
                flush()
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in CLOSES:
            shut, until = CLOSES[name]
            if any(open_[t] for t in shut.split()):
                for k in reversed(places):
                    if stack[k][0] in until:
                        break
                    if stack[k][0] in shut.split():
                        close(k)
                        break
        elif name in BLOCKS and places and stack[places[-1]][0] == "p":
            close(places[-1])
        if name in VOID:
            if name == "hr":
                flush()
            continue
        above, slot = (stack[-1][1], stack[-1][2]) if stack else (PLAIN, 0)
        role = _role(name, attributes, above)
        role = CHROME_ROLE if above == CHROME_ROLE or role == CHROME_ROLE else min(above, role)
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(source, at)
            # a broken element that never closes hides the rest, as in browsers
            back = end.end() if end else len(source)
            continue
        if name in BLOCKS or role != above:
            flush()
        if not attributes.rstrip().endswith("/") or name not in ("svg", "path"):
            if name in BLOCKS:
                places.append(len(stack))
                slot = xxhash.xxh64_intdigest(name, slot)
            stack.append((name, role, slot))
            open_[name] += 1
    flush()
    return out


# --- evidence


def candidates(parsed: list[Block], markup: bool = True) -> tuple[bool, list[int]]:
    """Whether the page declares its main text, and the places of the blocks that may be main text."""
    if not markup:
        return False, list(range(len(parsed)))
    declared = min((b.role for b in parsed if b.role in DECLARED), default=None)
    return declared is not None, [k for k, b in enumerate(parsed) if (b.role != CHROME_ROLE if declared is None else b.role == declared)]


def block_marks(own: list[Block]) -> np.ndarray:
    """The suffix of each block up to its end: a hash of slot and text, odd."""
    return np.array([xxhash.xxh64_intdigest(b.text, b.slot) | 1 for b in own], np.uint64).view(np.int64)


def stream(own: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens (32-bit hashes) of the blocks, each after its slot's mark, and where each block starts and ends."""
    known: dict[str, int] = {}
    out, ends = [], [0]
    for b in own:
        out.append(b.slot & 0xFFFFFFFF)
        for w in b.text.split():
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh32_intdigest(w)
            out.append(h)
        ends.append(len(out))
    return np.array(out, np.uint32), np.array(ends)


def suffix_marks(tokens: np.ndarray) -> np.ndarray:
    """A name for the first DEPTH tokens of each suffix that has so many: an even hash."""
    n = max(0, len(tokens) - DEPTH + 1)
    marks = np.zeros(n, np.uint64)
    for k in range(DEPTH):
        marks = (marks + tokens[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        marks ^= marks >> np.uint64(29)
    return (marks & ~np.uint64(1)).view(np.int64)


def suffix_array(symbols: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes symbols[i:stops[i]] in order, by prefix doubling, and how many symbols each shares with the
    one before. Only suffixes that are not told apart yet are sorted again."""
    n = len(symbols)
    if not n:
        return np.zeros(0, int), np.zeros(0, int)
    order, place = np.argsort(symbols), np.arange(n)
    new = np.r_[True, np.diff(symbols[order]) != 0]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    levels, k, longest = [rank.astype(np.int32)], 1, int((stops - place).max())
    while k < longest:
        head = np.flatnonzero(new)
        size = np.diff(np.r_[head, n])
        at = np.flatnonzero(np.repeat(size > 1, size))
        if not len(at):
            break
        own = order[at]
        second = np.where(own + k < stops[own], rank[np.minimum(own + k, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + second
        by = np.argsort(key)
        order[at], key = own[by], key[by]
        new[at[1:]] |= key[1:] != key[:-1]
        rank[order[at]] = np.maximum.accumulate(np.where(new, place, 0))[at]
        levels.append(rank.astype(np.int32))
        k *= 2
    a, b = order[:-1], order[1:]
    most, shared = np.minimum(stops[a] - a, stops[b] - b), np.zeros(n - 1, np.int64)
    for level in reversed(range(len(levels))):
        same = levels[level][np.minimum(a + shared, n - 1)] == levels[level][np.minimum(b + shared, n - 1)]
        shared += (same & (shared + (1 << level) <= most)) << level
    return order, np.r_[0, shared]


def holders(streams: list[np.ndarray], host: np.ndarray) -> list[np.ndarray]:
    """For each suffix of each page: how many pages of its host (by number) hold its first DEPTH tokens, by the
    intervals of the suffix array whose neighbours share so many."""
    size = np.array([len(t) for t in streams], int)
    page, stops = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size), size)
    flat = np.concatenate([*streams, np.zeros(0, np.uint32)]).astype(np.int64) + (host[page].astype(np.int64) << 32)
    order, shared = suffix_array(flat, stops)
    interval = np.cumsum(shared < DEPTH) - 1
    each = np.unique(interval * max(1, len(size)) + page[order]) // max(1, len(size))
    count = np.zeros(len(flat), int)
    count[order] = np.bincount(each, minlength=1)[interval]
    return np.split(count, np.cumsum(size)[:-1]) if len(size) else []


def run_marks(tokens: np.ndarray, held: np.ndarray, need: float) -> set[int]:
    """Marks of a page's suffixes that `need` pages hold or more."""
    marks = suffix_marks(tokens)
    return set(marks[held[: len(marks)] >= need].tolist())


def covered(marks: np.ndarray, hot: set[int], ends: np.ndarray) -> np.ndarray:
    """Share of each block that lies in runs whose marks are `hot`."""
    at = np.flatnonzero(np.array([m in hot for m in marks.tolist()], bool))
    change = np.zeros(ends[-1] + 1, int)
    np.add.at(change, at, 1)
    np.add.at(change, at + DEPTH, -1)
    inside = np.r_[0, np.cumsum(np.cumsum(change)[: ends[-1]] > 0)]
    return np.diff(inside[ends]) / np.diff(ends)


def decide(parsed: list[Block], usual: set[int], often: set[int], slots: set[int], markup: bool = True) -> str:
    """Main text of a page, by the marks of the host that most pages or many have, and the slots (signed)
    that hold boilerplate."""
    declared, at = candidates(parsed, markup)
    own = [parsed[k] for k in at]
    if declared:
        if usual:
            tokens, ends = stream(own)
            share = covered(suffix_marks(tokens), usual, ends)
            own = [b for b, m, c in zip(own, block_marks(own).tolist(), share) if m not in usual and c < NEARLY]
    elif own and (often or slots):
        tokens, ends = stream(own)
        share = covered(suffix_marks(tokens), often, ends)
        whole = block_marks(own).tolist()
        own = [b for b, m, c in zip(own, whole, share) if m not in often and c < COVERED and _signed(b.slot) not in slots]
    return "\n".join(b.text for b in own)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def evidence(own: list[Block], declared: bool) -> Iterator[tuple[int, int, int, bool]]:
    """mark, slot, tokens, declared: one for the page itself (mark 0) and each block among its candidates."""
    yield 0, 0, 0, declared
    seen = set()
    for b, m in zip(own, block_marks(own).tolist()):
        if m not in seen:
            seen.add(m)
            yield m, _signed(b.slot), len(b.text.split()), declared


def _candidates(html: str | None, markup: bool = True) -> tuple[bool, list[Block]]:
    parsed = blocks(html)
    declared, at = candidates(parsed, markup)
    return declared, [parsed[k] for k in at]


def texts(pages: list[str | None], markup: bool = True) -> list[str]:
    """Main texts of the pages of one host, in memory; without `markup` by the suffix array alone."""
    parsed = {p or "": _candidates(p, markup) for p in pages}
    total = len(parsed)
    streams = [stream(own)[0] for _, own in parsed.values()]
    rows = [list(evidence(own, declared)) for declared, own in parsed.values()]
    for own, tokens, held in zip(rows, streams, holders(streams, np.zeros(total, int))):
        own += [(m, 0, 0, own[0][3]) for m in run_marks(tokens, held, max(2, PAGES * total))]
    held = Counter(m for own in rows for m, *_ in own)
    usual = {m for m, n in held.items() if m and n >= max(LEAST, USUAL * total)}
    often = {m for m, n in held.items() if m and n >= max(2, PAGES * total)}
    whole, again = Counter(), Counter()
    for own in rows:
        for m, slot, tokens, declared in own:
            if m & 1 and not declared:
                whole[slot] += tokens
                again[slot] += tokens * (held[m] >= max(2, SEVERAL * total))
    slots = {s for s, n in whole.items() if again[s] >= SLOT * n}
    return [decide(blocks(p), usual, often, slots, markup) for p in pages]


_OUT = "page_id long, url string, text string, n_chars long"


_STREAMS = "host long, part long, large boolean, page long, declared boolean, stream binary, mark array<long>, slot array<long>, tokens array<int>"
_EVIDENCE = "host long, page long, mark long, slot long, tokens int, declared boolean"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a page: its token stream and the evidence of its blocks. Copies of a page that a task has seen
    lately are left out here, so that a page of very many copies is not sent as often."""
    seen: set[tuple[int, int]] = set()
    for b in sliced(batches, 500):
        at, rows = [], []
        for k, key in enumerate(zip(b.column("host").to_pylist(), b.column("page").to_pylist())):
            if key in seen:
                continue
            seen.add(key)
            declared, own = _candidates(b.column("html")[k].as_py())
            mark, slot, tokens, _ = zip(*evidence(own, declared))
            at.append(k)
            rows.append((declared, stream(own)[0].tobytes(), mark, slot, tokens))
        if len(seen) > 1 << 18:
            seen.clear()
        types = [pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        kept = [b.column(c).take(pa.array(at, pa.int64())) for c in ("host", "part", "large", "page")]
        yield pa.RecordBatch.from_arrays([*kept, *made], names=["host", "part", "large", "page", "declared", "stream", "mark", "slot", "tokens"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Evidence of whole hosts, and of parts of large ones, from rows sorted by host, part and page: of pages
    and blocks, and of the runs that enough pages hold; of a part's runs only the marks, with a null page."""

    def found(rows: list[dict]) -> pa.RecordBatch:
        groups = [(r["host"], r["part"]) for r in rows]
        number = {g: k for k, g in enumerate(dict.fromkeys(groups))}
        total, out, marks = Counter(groups), [], set()
        streams = [np.frombuffer(r["stream"], np.uint32) for r in rows]
        for r, g, tokens, held in zip(rows, groups, streams, holders(streams, np.array([number[g] for g in groups]))):
            out += [(r["host"], r["page"], m, s, t, r["declared"]) for m, s, t in zip(r["mark"], r["slot"], r["tokens"])]
            if r["large"]:
                marks |= {(r["host"], m) for m in run_marks(tokens, held, PAGES * total[g] * (1 - 1e-9))}
            else:
                out += [(r["host"], r["page"], m, 0, 0, r["declared"]) for m in run_marks(tokens, held, max(2, PAGES * total[g]))]
        out += [(h, None, m, 0, 0, False) for h, m in marks]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["host", "page", "mark", "slot", "tokens", "declared"])

    rows, size = [], 0
    for b in sliced(batches, 100):
        for r in b.to_pylist():
            if rows and all(r[c] == rows[-1][c] for c in ("host", "part", "page")):
                continue
            if size > TOGETHER and (r["host"], r["part"]) != (rows[-1]["host"], rows[-1]["part"]):
                yield found(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r["stream"])
    if rows:
        yield found(rows)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks of all suffixes of pages."""
    for b in sliced(batches, 100):
        got = [(declared, np.unique(suffix_marks(stream(own)[0]))) for declared, own in (_candidates(h.as_py()) for h in b.column("html"))]
        size = [len(m) for _, m in got]
        row = pa.array(np.repeat(np.arange(len(got)), size))
        kept = [b.column(c).take(row) for c in ("host", "page")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate([m for _, m in got])), pa.array(np.repeat([d for d, _ in got], size))], names=["host", "page", "mark", "declared"])


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 500):
        lists = zip(*(b.column(c).to_pylist() for c in ("usual", "often", "slots")))
        got = [decide(blocks(h.as_py()), *(set(x or ()) for x in own)) for h, own in zip(b.column("html"), lists)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(df: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `df` (page_id, url, html)."""
    small_batches(df.sparkSession)
    name = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    html = F.coalesce("html", F.lit(""))
    pages = df.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.xxhash64(name).alias("host"), F.xxhash64(html).alias("page"))
    parts = F.ceil(F.greatest(F.count("*") / PART_PAGES, F.sum(F.length("html")) / PART_CHARS))
    # one row for each PART_PAGES pages or PART_CHARS characters at most
    large = stored(pages.groupBy(F.col("host").alias("l_host")).agg(parts.alias("parts")).where("parts > 1"), "large-hosts")
    cut = pages.join(F.broadcast(large), F.col("host") == F.col("l_host"), "left").select("host", F.expr("pmod(page, coalesce(parts, 1))").alias("part"), F.col("parts").isNotNull().alias("large"), "page", "html")
    streams = cut.mapInArrow(_streams, _STREAMS).repartition("host", "part").sortWithinPartitions("host", "part", "page")
    found = stored(streams.mapInArrow(_runs, _EVIDENCE), "page-evidence")
    if not large.isEmpty():
        runs = found.where("page is null").select(F.col("host").alias("c_host"), F.col("mark").alias("c_mark")).distinct()
        held = cut.where("large").select("host", "page", "html").mapInArrow(_places, "host long, page long, mark long, declared boolean")
        held = held.join(stored(runs, "page-candidates"), (F.col("host") == F.col("c_host")) & (F.col("mark") == F.col("c_mark"))).select("host", "page", "mark", F.lit(0).cast("long").alias("slot"), F.lit(0).alias("tokens"), "declared")
        found = found.where("page is not null").unionByName(stored(held.distinct(), "page-runs"))
    marks = found.groupBy("host", "mark").agg(F.count("*").alias("pages"), F.max("slot").alias("slot"), F.max("tokens").alias("tokens"), F.count_if(~F.col("declared")).alias("free"))
    marks = stored(marks, "page-marks")
    total = marks.where("mark = 0").select(F.col("host").alias("h"), F.col("pages").alias("total"))
    held = marks.where("mark <> 0").join(total, F.col("host") == F.col("h"))
    least = lambda few, share: F.col("pages") >= F.greatest(F.lit(few), F.col("total") * share)
    # a mark tells on pages that declare, or on those that do not
    usual, often = least(LEAST, USUAL), (F.col("free") > 0) & least(2, PAGES)
    text = F.col("tokens") * F.col("free")
    again = F.sum(F.when(least(2, SEVERAL), text).otherwise(0)) >= SLOT * F.sum(text)
    slots = held.where("free > 0 and mark & 1 = 1").groupBy("host", "slot").agg(again.alias("again")).where("again").select(F.col("host").alias("t_host"), F.col("slot").alias("t_slot"))
    telling = held.select("host", "mark", usual.alias("usual"), often.alias("often")).where("usual or often").select(F.col("host").alias("t_host"), F.col("mark").alias("t_mark"), "usual", "often")
    own = found.join(telling, (F.col("host") == F.col("t_host")) & (F.col("mark") == F.col("t_mark"))).select("host", "page", "mark", F.lit(None).cast("long").alias("slot"), "usual", "often")
    where = found.where("not declared and mark & 1 = 1").join(slots, (F.col("host") == F.col("t_host")) & (F.col("slot") == F.col("t_slot"))).select("host", "page", F.lit(None).cast("long").alias("mark"), "slot", F.lit(False).alias("usual"), F.lit(False).alias("often"))
    sets = [F.collect_set(F.when(F.col(c), F.col("mark"))).alias(c) for c in ("usual", "often")]
    known = own.unionByName(where).groupBy("host", "page").agg(*sets, F.collect_set("slot").alias("slots")).withColumnsRenamed({"host": "k_host", "page": "k_page"})
    known = stored(known, "page-boilerplate")
    met = pages.join(known, (F.col("host") == F.col("k_host")) & (F.col("page") == F.col("k_page")), "left")
    return met.select("page_id", "url", "html", "usual", "often", "slots").mapInArrow(_decide, _OUT)
