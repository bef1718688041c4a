"""Main text of web pages: nearest-URL differencing, with page structure as evidence.

A page is cut into text blocks. Blocks in menus, headers, footers, sidebars, forms, adverts, notices and comments go by
element, role and name. Each page is paired with its nearest pages by URL path on the same host, both sequences of lines
are aligned by longest common subsequence, and the shared lines, the site's frame, are deleted. The nearest page that
isn't a copy decides about lines that no author writes: those outside article and main, and, where a page has neither,
outside headings and paragraphs. Lines within article or main go only where two such pages share them, and headings and
paragraphs within them never do; where a page has neither element, those too go only by two pages' word. Pages are
copies where the shared lines hold COPY or more of the characters within article or main, or, of a page without either,
WHOLE or more of all its characters. A page that has only copies for neighbours keeps what is within article or main;
without either it loses the lines that it shares with all of them, unless that were all.
"""

from __future__ import annotations

import html
import math
import os.path
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import Scratch, keep_ids

#: Elements whose content is never text of the article.
DROPPED = frozenset("script style noscript template svg math iframe object nav header footer aside form button select textarea dialog menu head title canvas audio video map".split())
#: Of these, those whose content isn't markup.
RAW = frozenset("script style noscript template iframe textarea title svg".split())
#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
#: Words in class or id, and roles, that name what isn't the article.
NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promotion related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Within article and main only these count, as a whole word of class or id, and not on headings, paragraphs and sections: there the author names things.
NAMES_WITHIN = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies disqus menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promotion related share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Of these, the ones that count as a part of a word too, where its other parts are among PLACES.
NAMES_OF_PARTS = NAMES_WITHIN - frozenset("menu navigation notice notices overlay related widget".split())
#: Parts of names that say where something stands or how it is arranged, not what it is about.
PLACES = frozenset("area bar block bottom box container content global group icons inner item items left link links list main outer page panel primary right row secondary section site sticky top unit wrap wrapper".split())
AUTHORED = frozenset("p h1 h2 h3 h4 h5 h6 section header figure figcaption blockquote pre table article main".split())
#: What authors write in; a line in one of these is theirs until two pages say otherwise.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
#: Bits of a block's kind.
WITHIN, WRITTEN = 1, 2
#: Where a page's pair holds so large a share of the characters within its article or main, or of all where it has neither, the pages are copies.
COPY, WHOLE = 0.5, 0.9

# Each alternative ends only where the page does or what it looks for is found, so a page is read once, whatever stands in it.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(.?)", re.S)
# The same where a quotation mark has no partner: from there on they don't count.
_TOKEN_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(.?)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_ENDINGS = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}


def _named(words: str, names: frozenset[str], of_parts: frozenset[str]) -> bool:
    """Whether a class or id is one of the names, or is made of them and of PLACES: `cookie-notice` and `site-nav` are, `social-science` isn't."""
    for word in words.split():
        parts = [x for x in re.split(r"[_-]+", word) if x]
        if word in names or not of_parts.isdisjoint(parts) and all(x in names or x in PLACES for x in parts):
            return True
    return False


def _unwanted(tag: str, attributes: str, within: bool) -> bool:
    """Whether an element and all in it isn't text of the article. within: it stands in an article or main element, whose own header holds its title."""
    if tag in DROPPED:
        return not (within and tag == "header")
    if tag in ("html", "body", "article", "main") or not attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, words = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and words == "true" or name == "role" and words in ROLES:
            return True
        if name in ("class", "id"):
            if within and tag not in AUTHORED and _named(words, NAMES_WITHIN, NAMES_OF_PARTS) or not within and _named(words, NAMES, NAMES):
                return True
    return False


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, kind) of all blocks that structure doesn't rule out, in page order. Bits of kind: WITHIN an article or main element, WRITTEN in a TEXTUAL one. A form that holds an article or main isn't ruled out from there on."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements; whether each is ruled out
    opened: dict[str, int] = {}
    ruled_out, content, written, at, token = 0, 0, 0, 0, _TOKEN

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, WITHIN * (content > 0) + WRITTEN * (written > 0)))
            parts.clear()

    def close(upto: int) -> None:
        nonlocal ruled_out, content, written
        for name, bad in stack[upto:]:
            ruled_out -= bad
            content -= name in CONTENT
            written -= name in TEXTUAL
            opened[name] -= 1
        del stack[upto:]

    while (m := token.search(page, at)) is not None:
        if m[2] is not None and m[4] in ("'", '"'):  # a quotation mark without partner
            token = _TOKEN_PLAIN
            continue
        if m.start() > at and not ruled_out:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:  # a tag cut off at the end of the page
            break
        tag = m[2].lower()
        if tag not in INLINE:
            end_block()
        if m[1]:
            if opened.get(tag):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if stack[i][0] in DROPPED and tag in INLINE:
                        break
            continue
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "script", "iframe"):
            continue
        if tag in RAW:
            ending = _ENDINGS[tag].search(page, at)
            at = ending.end() if ending else len(page)
            continue
        if tag == "p" and opened.get("p"):  # a paragraph ends where the next begins
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in CONTENT and ruled_out and all(name == "form" for name, bad in stack if bad):
            stack[:] = [(name, False) for name, _ in stack]
            ruled_out = 0
            parts.clear()
        bad = _unwanted(tag, m[3], content > 0)
        stack.append((tag, bad))
        opened[tag] = opened.get(tag, 0) + 1
        ruled_out += bad
        content += tag in CONTENT
        written += tag in TEXTUAL
    if not ruled_out and at < len(page):
        parts.append(page[at:])
    end_block()
    return out


def common(a: list[int], b: list[int]) -> set[int]:
    """Indices in a of one longest common subsequence of a and b, by bit-parallel rows of integers."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(a) - tail, len(a))}
    shared = set(a) & set(b)
    left = [i for i in range(head, len(a) - tail) if a[i] in shared]
    right = [x for x in b[head : len(b) - tail] if x in shared]
    masks: dict[int, int] = {}
    for j, x in enumerate(right):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(right)) - 1

    def after(row: int, i: int) -> int:
        u = row & masks.get(a[left[i]], 0)
        return ((row + u) | (row - u)) & full

    # rows are kept at every step-th item only and made again from there, so that memory grows with the root of the length
    step = max(1, math.isqrt(len(left)))
    kept, row = [], full
    for i in range(len(left)):
        if i % step == 0:
            kept.append(row)
        row = after(row, i)
    part: list[int] = []
    # bit j of a row is 0 where the length grows at column j
    length = lambda r, j: j - (r & ((1 << j) - 1)).bit_count()
    j = len(right)
    for k in range(len(left) - 1, -1, -1):
        if k % step == step - 1 or k == len(left) - 1:
            part = [kept[k // step]]
            for i in range(k - k % step, k + 1):
                part.append(after(part[-1], i))
        before, now = part[k % step], part[k % step + 1]
        if length(now, j) == length(before, j):
            continue
        found.add(left[k])
        want = length(before, j)
        while j and length(before, j - 1) == want and length(now, j - 1) > want:
            j -= 1
        j -= 1
    return found


def _host_path(url: str | None) -> tuple[str, str]:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)", url or "")
    return m[1].lower().rpartition("@")[2], m[2]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in ta.runs(batches, "html"):
        texts, lines, inside, sizes, hosts, paths = [], [], [], [], [], []
        for page, url in zip(ta.column(run, "html").to_pylist(), ta.column(run, "url").to_pylist(), strict=True):
            found = blocks(page or "")
            texts.append([x for x, _ in found])
            lines.append(ta.signed(ta.words(pa.array(texts[-1], pa.string()), separator=np.zeros(256, bool)).hash).tolist() if found else [])
            inside.append([x for _, x in found])
            sizes.append([len(x) for x, _ in found])
            host, path = _host_path(url)
            hosts.append(host)
            paths.append(path)
        yield pa.record_batch(
            [ta.column(run, "page_id"), ta.column(run, "url"), *(pa.array(x, pa.list_(t)) for x, t in ((texts, pa.string()), (lines, pa.int64()), (inside, pa.int32()), (sizes, pa.int32()))), pa.array(hosts, pa.string()), pa.array(paths, pa.string())],
            names=["page_id", "url", "blocks", "lines", "inside", "sizes", "host", "path"],
        )


_NEAR = ["host", "path", "page_id", "host0", "path0", "page0", "host1", "path1", "page1"]
_NONE = (None, None, None)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (host, path, page_id) -> each with its neighbours in the partition; null at its ends."""
    held: list[tuple] = []  # the last row, and the one before it

    def linked(rows: list[tuple], last: bool) -> pa.RecordBatch | None:
        first = 0 if not before_known else 1
        stop = len(rows) if last else len(rows) - 1
        if first >= stop:
            return None
        out = [(*rows[i], *(rows[i - 1] if i else _NONE), *(rows[i + 1] if i + 1 < len(rows) else _NONE)) for i in range(first, stop)]
        kinds = [pa.string(), pa.string(), pa.int64()] * 3
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_NEAR)

    before_known = False
    for batch in batches:
        rows = held + list(zip(*(ta.column(batch, c).to_pylist() for c in ("host", "path", "page_id")), strict=True))
        if (out := linked(rows, last=False)) is not None:
            yield out
        if len(rows) > 1:
            held, before_known = rows[-2:], True
        else:
            held = rows
    if held and (out := linked(held, last=True)) is not None:
        yield out


def _ranked(host: str, path: str, near: list[tuple]) -> list[int]:
    """The neighbours on the same host, the one with the longest common start of the path first; the earlier wins ties."""
    near = [x for x in near if x[2] is not None and x[0] == host]
    return [x[2] for x in sorted(near, key=lambda x: -len(os.path.commonprefix([path, x[1]])))]


def nearest(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """keys(host, path, page_id) -> (page_id, mate, rank): the neighbours in the order of all keys, the nearest first, however they are partitioned.

    The keys are range-partitioned, so a host may have any share of them. Neighbours across two partitions' ends come
    from the ends alone, two rows a partition.
    """
    chained = keys.repartitionByRange("host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    chained = scratch.save(chained.mapInArrow(_chain, "host string, path string, page_id long, host0 string, path0 string, page0 long, host1 string, path1 string, page1 long"), "chain")
    ends = sorted((tuple(r) for r in chained.where("page0 is null or page1 is null").collect()), key=lambda r: (r[0], r[1], r[2], r[5] is not None, r[8] is None))
    fixed = []
    for i, r in enumerate(ends):
        before = r[3:6] if r[5] is not None else ends[i - 1][:3] if i else (None,) * 3
        after = r[6:9] if r[8] is not None else ends[i + 1][:3] if i + 1 < len(ends) else (None,) * 3
        fixed.append((*r[:3], *before, *after))
    whole = chained.where("page0 is not null and page1 is not null")
    if fixed:
        whole = whole.unionByName(keys.sparkSession.createDataFrame(fixed, chained.schema))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            found = [(r[2], mate, k) for r in rows for k, mate in enumerate(_ranked(r[0], r[1], [r[3:6], r[6:9]])) if mate != r[2]]
            if found:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["page_id", "mate", "rank"])

    return whole.select(*_NEAR).mapInArrow(pick, "page_id long, mate long, rank int")


def shared_lines(lines: list[int], kinds: list[int], sizes: list[int], mates: list[list[int]]) -> set[int]:
    """Numbers of the lines that go. mates: the lines of the neighbours, the nearest first."""
    within = {i for i, x in enumerate(kinds) if x & WITHIN}
    total = sum(sizes[i] for i in within) if within else sum(sizes)
    least = COPY if within else WHOLE
    copies, others = [], []
    for mate in filter(len, mates):
        gone = common(lines, mate)
        held = sum(sizes[i] for i in gone if i in within or not within)
        (others if held < least * total else copies).append(gone)
    if others:
        both = others[0] & others[1] if len(others) > 1 else set()
        if within:
            return others[0] - within | {i for i in both & within if not kinds[i] & WRITTEN}
        return {i for i in others[0] if not kinds[i] & WRITTEN} | both
    if not copies:
        return set()
    gone = set.intersection(*copies) - within
    return gone if len(gone) < len(lines) else set()


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, page, gone): numbers of the blocks that go, of pages where some do."""
    for batch in batches:
        out = []
        for page_id, page, lines, inside, sizes, one, two in zip(*(ta.column(batch, c).to_pylist() for c in ("page_id", "page", "lines", "inside", "sizes", "lines0", "lines1")), strict=True):
            gone = shared_lines(lines, inside, sizes, [x for x in (one, two) if x is not None])
            if gone:
                out.append((page_id, page, sorted(gone)))
        if out:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)], names=["page_id", "page", "gone"])


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> (page_id, url, text, n_chars), one row for each row of pages.

    Null and empty pages, and pages without a block that stays, give the empty text. Pages without url share the host
    of no name. Pages without a neighbour on their host, or without page_id, are judged by structure alone; so is a
    neighbour of the same page_id. Of several rows with one page_id any may serve as a pair. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession)
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = scratch.save(plain.mapInArrow(_parse, "page_id long, url string, blocks array<string>, lines array<long>, inside array<int>, sizes array<int>, host string, path string"), "parsed")
    parsed = parsed.withColumn("page", F.xxhash64("lines", "inside"))
    mate = lambda rank: F.min(F.when(F.col("rank") == rank, F.col("mate"))).alias(f"mate{rank}")
    mates = nearest(parsed.where("page_id is not null").select("host", "path", "page_id"), scratch).groupBy("page_id").agg(mate(0), mate(1))
    # the first and the last page of a host have one neighbour: its other one is their second
    beyond = mates.select(F.col("page_id").alias("mate0"), F.col("mate0").alias("_a"), F.col("mate1").alias("_b"))
    mates = mates.join(beyond, "mate0", "left").select("page_id", "mate0", F.coalesce("mate1", *(F.when(F.col(c) != F.col("page_id"), F.col(c)) for c in ("_a", "_b"))).alias("mate1"))
    # only the lines' hashes move here; texts move only where lines go
    lined = parsed.where("page_id is not null and size(lines) > 0").select("page_id", "page", "lines", "inside", "sizes").join(mates, "page_id")
    others = parsed.where("page_id is not null").groupBy("page_id").agg(F.min("lines").alias("l"))
    for k in range(2):
        lined = lined.join(others.select(F.col("page_id").alias(f"mate{k}"), F.col("l").alias(f"lines{k}")), f"mate{k}", "left")
    gone = lined.select("page_id", "page", "lines", "inside", "sizes", "lines0", "lines1")
    gone = gone.mapInArrow(_difference, "page_id long, page long, gone array<int>").groupBy("page_id", "page").agg(F.min("gone").alias("gone"))
    gone = scratch.save(gone, "gone")
    plain = parsed.select("page_id", "url", "blocks", "page")
    ids = gone.select("page_id")
    moved = keep_ids(plain, ids, "page_id").join(gone, ["page_id", "page"], "left")
    left = F.when(F.col("gone").isNull(), F.col("blocks")).otherwise(F.filter("blocks", lambda _, i: ~F.array_contains("gone", i)))
    text = moved.select("page_id", "url", F.array_join(left, " ").alias("text")).unionByName(keep_ids(plain, ids, "page_id", others=True).select("page_id", "url", F.array_join("blocks", " ").alias("text")))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
