r"""HTML extraction with a host's suffix array.

A page becomes blocks in page order, each with the role that markup gives it: main (inside article, or else main), side
(menus, headers, footers, asides, forms, adverts, notices, comments, by element or by class, id and role names) or open
(neither).  Where articles hold less text than what is open, they are teasers, and both are open.

What stands outside the main text is the page's token stream.  All suffixes of a host's distinct streams, cut after
LONGEST tokens, are sorted; neighbours that agree on RUN tokens or more, in at least STREAMS distinct streams, mark where
a substring starts that repeats across pages (a longer one shows as runs that overlap).  An open block that such runs
cover is boilerplate and goes; unique runs stay, unless open blocks stand beside an article that is no teaser.  Side
blocks go even if unique.  An article stays whole, shared lines and passages included, but for blocks that more than half
of the host's distinct articles (STREAMS at least) hold word for word: notices and adverts without a telling name
(where these are more than half of the article, it is a near copy and stays whole).

Streams are distinct before suffixes are made, suffixes are dealt by host and first RUN tokens, not by host, and a task
reads them in sorted order, holding neighbours only, so a host with a third of all pages is no single task.

Cases: null and empty pages give the empty text; unclosed elements end where an enclosing one does or with the page;
an unclosed script, style or comment hides the rest, another hidden element without its end tag hides what comes before
the next block or enclosing end; head hides nothing of its own, so its tags may be left out; a header inside an article is
part of it; the side names of a wrapper and a form around an article (or main) do not reach into it, unless the wrapper is
for comments or related pages; a tag with an unpaired quote ends at its first >, and one that the end of the page cuts
off is no text; repeated rows get equal rows, and copies of a page count as one; a null url is a host of its own; white
space (also U+00A0) inside a block becomes one space; very long pages are parsed whole, in time that grows with their
length; no rows, no texts; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow, text_or_empty
from .grams import Batch

RUN, LONGEST, STREAMS, COVERED = 5, 12, 3, 0.6
#: An article (main) is the page's if the open text outside it is at most so many times as long.
TEASER = 4
#: An article of which blocks that others hold too make a larger share is a near copy, and stays whole.
COPIED = 0.5
MAIN, SIDE, OPEN = 0, 1, 2
#: Elements by what they do.
HIDDEN = frozenset("script style noscript template svg iframe object canvas audio video select textarea title".split())
#: Hidden elements whose content is no markup; the first two hide the rest of the page if nothing ends them.
RAW = ("script", "style", "textarea", "title", "iframe", "noscript")
ASIDE = frozenset("nav header footer aside form menu dialog button".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base head br col embed hr img input link meta param source track wbr".split())
#: Name parts (class, id, role) that tell what stands beside an article.
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|disqus|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notice|popup|promo|promoted|related|replies|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])|(?:^|\s)search(?:$|\s)|(?:^|[\s_-])search[_-](?:ba?r|box|form)", re.I)
#: Wrappers of these names hold articles that are not the page's.
OTHERS = frozenset("comment comments disqus related replies".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^<>]*)>", re.S)
#: A tag that the end of the page cuts off.
CUT_TAG = re.compile(r"<[/!?]?[a-zA-Z][^<>]*\Z")
UNSEEN = re.compile(r"""\bhidden(?:\s|/|=|$)|\baria-hidden\s*=\s*["']?true|\bstyle\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Ends:
    """Where the hidden elements of a page end."""

    def __init__(self, page: str):
        self.page = page
        self.pairs: dict[str, dict[int, int]] = {}
        self.endless: set[str] = set()

    def of(self, name: str, at: int, around: dict[str, int]) -> int:
        """The end of the element whose start tag ends at at, inside elements around."""
        if name in RAW:
            end = None if name in self.endless else re.compile(rf"</{name}\s*>", re.I).search(self.page, at)
            if end:
                return end.end()
            self.endless.add(name)
        else:
            if name not in self.pairs:
                self.pairs[name], opened = {}, []
                for m in re.compile(rf"<(/?){name}(?=[\s/>])((?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^<>]*)>", re.I).finditer(self.page):
                    if not m[1] and not m[2].endswith("/"):
                        opened.append(m.end())
                    elif m[1] and opened:
                        self.pairs[name][opened.pop()] = m.end()
            if at in self.pairs[name]:
                return self.pairs[name][at]
        if name in RAW[:2]:
            return len(self.page)
        for m in TOKEN.finditer(self.page, at):
            tag = m[2] and m[2].lower()
            if tag and (tag in BLOCK and (name, tag) != ("select", "option") or m[1] and (tag in around or tag == "head")):
                return m.start()
        return len(self.page)


def blocks(page: str) -> list[tuple[int, str]]:
    """(role, text) of the blocks with text."""
    found: list[tuple[int, bool, bool, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int, int]] = []  # element, what it adds: 1 side, 2 article, 4 main, 8 side unless around an article; what of the last it hides
    opened: dict[str, int] = {}  # how often an element is on the stack
    side = article = main = soft = 0
    at = 0
    ends = Ends(page)
    cdata = True

    def flush() -> None:
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                found.append((side + soft, article > 0, main > 0, words))
            text.clear()

    def shut() -> str:
        nonlocal side, article, main, soft
        name, adds, hides = stack.pop()
        soft += hides - (adds >> 3 & 1)
        side -= adds & 1
        article -= adds >> 1 & 1
        main -= adds >> 2 & 1
        if opened[name] == 1:
            del opened[name]
        else:
            opened[name] -= 1
        return name

    while m := TOKEN.search(page, at):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = m[2] and m[2].lower()
        if not name:
            if m[0] == "<![CDATA[" and cdata:
                end = page.find("]]>", at)
                cdata = end >= 0
                if cdata:
                    text.append(page[at:end])
                    at = end + 3
            continue
        if name in BLOCK:
            flush()
        if m[1]:
            if name in opened:
                while shut() != name:
                    pass
        elif name in HIDDEN:
            if not m[3].endswith("/"):
                at = ends.of(name, at, opened)
        elif name not in VOID and not m[3].endswith("/"):
            if name == "p" and stack and stack[-1][0] == "p":
                shut()
            names = [next(filter(None, x), "") for x in ATTRIBUTE.findall(m[3])] if "=" in m[3] and name not in ("html", "body", "article", "main") else []
            named = any(map(NAMES.search, names)) and not (name == "header" and article)
            others = named and not OTHERS.isdisjoint(" ".join(names).lower().split())
            comment = name == "article" and bool(re.search(r"comment|reply", m[3], re.I))
            hard = name in ASIDE and name != "form" and not (name == "header" and article) or others or comment or bool(m[3] and UNSEEN.search(m[3]))
            adds = (1 if hard else 8 if named or name == "form" else 0) + (2 if name == "article" and not comment else 0) + (4 if name == "main" else 0)
            hides = soft if adds & 6 else 0
            soft += (adds >> 3 & 1) - hides
            side += adds & 1
            article += adds >> 1 & 1
            main += adds >> 2 & 1
            stack.append((name, adds, hides))
            opened[name] = opened.get(name, 0) + 1
    text.append(CUT_TAG.sub("", page[at:]))
    flush()
    plain = sum(len(x) for s, _, _, x in found if not s)

    def main_at(k: int) -> bool:
        held = sum(len(x[3]) for x in found if x[k] and not x[0])
        return held > 0 and TEASER * held >= plain - held

    inside = next((k for k in (1, 2) if main_at(k)), 0)
    return [(SIDE if x[0] else MAIN if inside and x[inside] else SIDE if inside else OPEN, x[3]) for x in found]


def host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def digest(at: str, stream: list[str]) -> bytes:
    return hashlib.blake2b("\n".join([at, *stream]).encode(), digest_size=16).digest()


def number(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\n".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, key, article, packed): the blocks of each page, compressed, and the keys of its stream and its article."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=6)
        for b in batches:
            keys, articles, packed = [], [], []
            for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = blocks(page)
                keys.append(digest(host(url), [t for r, t in found if r != MAIN]))
                articles.append(digest(host(url), [t for r, t in found if r == MAIN]))
                packed.append(z.compress(json.dumps(found, ensure_ascii=False).encode()))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(articles, pa.binary()), pa.array(packed, pa.binary())], names=["page_id", "url", "key", "article", "packed"])

    return in_arrow(pages, run, "page_id long, url string, key binary, article binary, packed binary")


def listed(pages: DataFrame) -> DataFrame:
    """(host, key, stream, held) of each distinct stream (held null) and of each distinct article (stream null), once a batch: the
    host's hash, and the hashes of the article's blocks."""

    def run(batches):
        for b in batches:
            rows = {}
            for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                at, found = host(url), blocks(page)
                outside, inside = [t for r, t in found if r != MAIN], [t for r, t in found if r == MAIN]
                if outside:
                    rows.setdefault((0, digest(at, outside)), (at, outside, None))
                if inside:
                    rows.setdefault((1, digest(at, inside)), (at, None, sorted({number(at, t) for t in inside})))
            held = list(rows.values())
            columns = [pa.array([number(x[0]) for x in held], pa.int64()), pa.array([k for _, k in rows], pa.binary()), pa.array([x[1] for x in held], pa.list_(pa.string())), pa.array([x[2] for x in held], pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["host", "key", "stream", "held"])

    return in_arrow(pages, run, "host long, key binary, stream array<string>, held array<long>")


def common_blocks(articles: DataFrame) -> DataFrame:
    """(article, common): of each distinct article (host, key, held), the blocks that more than half of its host's articles hold."""
    n = articles.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    each = articles.select("host", "key", F.explode("held").alias("block"))
    often = each.groupBy("host", "block").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= STREAMS).join(n, "host").filter("2 * times > n")
    return each.join(often.select("block"), "block", "left_semi").groupBy(F.col("key").alias("article")).agg(F.collect_list("block").alias("common"))


def suffixes(distinct: DataFrame) -> DataFrame:
    """(start, suffix, key, at): a suffix's first tokens as 8-byte numbers; start is a hash of the host and the first RUN."""

    def run(batches):
        for b in batches:
            starts, suffix, keys, spots = [], [], [], []
            for at, key, stream in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x = Batch(["\n".join(stream).encode()])
                tokens = x.words().astype(">u8").tobytes()
                salt = at.to_bytes(8, "little", signed=True)
                for i in range(len(tokens) // 8 - RUN + 1):
                    part = tokens[8 * i : 8 * (i + LONGEST)]
                    starts.append(int.from_bytes(hashlib.blake2b(part[: 8 * RUN], digest_size=8, key=salt).digest(), "little", signed=True))
                    suffix.append(part)
                    keys.append(key)
                    spots.append(i)
            yield pa.record_batch([pa.array(starts, pa.int64()), pa.array(suffix, pa.binary()), pa.array(keys, pa.binary()), pa.array(spots, pa.int32())], names=["start", "suffix", "key", "at"])

    return in_arrow(distinct.select("host", "key", "stream"), run, "start long, suffix binary, key binary, at int")


def agreed(a: bytes, b: bytes) -> int:
    """Tokens that two suffixes share at their start."""
    n = min(len(a), len(b)) // 8
    return next((i for i in range(n) if a[8 * i : 8 * i + 8] != b[8 * i : 8 * i + 8]), n)


def repeats(array: DataFrame) -> DataFrame:
    """(key, at, run): where a repeated run starts in a stream and how long it is, from neighbours in the sorted array."""

    def run(batches):
        held: list[tuple[bytes, int, int]] = []  # of one start, at most STREAMS streams wait for the next ones
        out: list[tuple[bytes, int, int]] = []
        now, others, last, length = None, set(), None, 0
        before = None

        def done() -> None:
            if len(others) >= STREAMS:
                out.extend((k, i, max(RUN, n)) for k, i, n in held)
            held.clear()

        for b in batches:
            for start, suffix, key, at in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if before == (start, suffix, key, at):
                    continue
                before = (start, suffix, key, at)
                if start != now:
                    done()
                    now, others, last, length = start, set(), None, 0
                length = agreed(last, suffix) if last is not None else 0
                if held and length > held[-1][2]:
                    held[-1] = (*held[-1][:2], length)
                if len(others) < STREAMS:
                    others.add(key)
                held.append((key, at, length))
                if len(others) >= STREAMS and len(held) > 1:  # all but the newest are known
                    out.extend((k, i, max(RUN, n)) for k, i, n in held[:-1])
                    del held[:-1]
                last = suffix
            if out:
                yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], names=["key", "at", "run"])
                out = []
        done()
        if out:
            yield pa.record_batch([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32())], names=["key", "at", "run"])

    return in_arrow(array.repartition("start").sortWithinPartitions("start", "suffix", "key", "at"), run, "key binary, at int, run int")


def repeated(texts: list[str], runs: list[dict] | None) -> list[bool]:
    """Which blocks of a stream the repeated runs cover."""
    sizes = [len(t.encode().split()) for t in texts]
    covered = np.zeros(sum(sizes), bool)
    for x in runs or ():
        covered[x["at"] : x["at"] + x["run"]] = True
    ends = np.cumsum([0, *sizes])
    return [bool(n) and bool(covered[a : a + n].mean() >= COVERED) for a, n in zip(ends, sizes)]  # noqa: B905


def main_text(found: list, runs: list[dict] | None, at: str = "", common: list[int] | None = None) -> tuple[str, int]:
    """The text that stays, and how many blocks are repeated: by runs outside the main text, by the host's articles inside."""
    outside, often = iter(repeated([t for r, t in found if r != MAIN], runs)), set(common or ())
    shared = [r == MAIN and bool(often) and number(at, t) in often for r, t in found]
    if sum(len(t) for (_, t), x in zip(found, shared, strict=True) if x) > COPIED * sum(len(t) for r, t in found if r == MAIN):
        shared = [False] * len(found)
    gone = [x if r == MAIN else next(outside) for (r, _), x in zip(found, shared, strict=True)]
    return "\n".join(t for (r, t), x in zip(found, gone, strict=True) if r != SIDE and not x), sum(gone)


SCHEMA = "page_id long, url string, text string, n_chars long, n_repeated long"


def extract(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    seen = cut(listed(rows))
    streams = seen.filter("stream is not null").select("host", "key", "stream").dropDuplicates(["key"])
    runs = repeats(suffixes(streams)).groupBy("key").agg(F.collect_list(F.struct("at", "run")).alias("runs"))
    common = common_blocks(cut(seen.filter("held is not null").select("host", "key", "held").dropDuplicates(["key"])))

    def run(batches):
        unz = zstandard.ZstdDecompressor()
        for b in batches:
            done = [main_text(json.loads(unz.decompress(p)), r, host(u), c) for u, p, r, c in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([t for t, _ in done], pa.string()), pa.array([len(t) for t, _ in done], pa.int64()), pa.array([n for _, n in done], pa.int64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return in_arrow(parsed(rows).join(runs, "key", "left").join(common, "article", "left").select("page_id", "url", "packed", "runs", "common"), run, SCHEMA)
