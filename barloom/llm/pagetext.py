"""HTML extraction: structure first, then the intervals of each host's suffix array.

A page's markup is read in one pass into blocks. Blocks in scripts, styles, menus, headers, footers, sidebars,
forms, notices, adverts and reader comments (by element, role, class or id) are out. If the page marks an
``article`` or ``main`` part, its blocks are the text. Inside such a part a class or id counts only if all its words are noise
or fill (``ad-box``, but not ``related-work``).

The token streams of all pages of a host then tell what the host repeats: the stream of the text and, of a marked page, the
stream of the rest. In the suffix array of the streams, the suffixes that agree on ``LEAST`` tokens form one interval; a token
run is repeated if the interval of each of its windows spans ``MIN_PAGES`` distinct pages, or both pages of a host that has two.
``n_repeated`` is the number of such tokens in the page's blocks. A page without a marked part holds its article among unmarked
boilerplate: there repeated tokens go, unique runs stay, and a page that would lose everything is a copy and stays as it is. A passage
of a marked article that other pages quote is still the article's: it is counted and stays. Pages of equal streams count once.

The array is sorted in ranges of (host, suffix, stream): neighbours are compared inside a range, an interval over several ranges is
put together, so a host with a third of all pages has no task of its own. It is built in ``SHARDS`` parts, one after the other; the shuffle files
of a part go when it is done. Each page is parsed once; its blocks are stored and read by each part.

Defined cases: null or empty html gives an empty text; character references follow HTML5; unclosed elements end with
their parent, or where HTML lets the next element end them; repeated rows get equal results; a null url is a host of its own;
empty tables give empty results; columns other than page_id, url and html are not read. Memory of a task grows with its longest page.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from barloom.llm.common import GOLDEN, arrow_map, mix64
from barloom.session import stored

LEAST = 8
MIN_PAGES = 3
#: The arrays are built in so many parts, one after the other, so that the suffixes of one part only are on disk at a time.
SHARDS = 12
#: Texts whose suffixes are cut out together, an even number.
AT_ONCE = 64
BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64))

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements whose content is no markup.
RAW = frozenset({"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "noframes", "xmp"})
NOISE = frozenset({"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "object", "canvas"})
NOISE_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog", "alertdialog"})
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices notification alert menu nav navbar navigation breadcrumb breadcrumbs sidebar aside comment comments "
    "commentlist respond disqus reply replies related recommended share sharing social footer header masthead newsletter "
    "subscribe subscription signup login popup modal overlay widget pagination pager toolbar topbar copyright".split()
)
#: Words that say what a noise element is made of; with noise words alone they make no name of content.
FILL = frozenset(
    "area bar block body bottom box button buttons container content count feed form head heading icon icons inner items label link "
    "links list main outer panel post posts article articles row section sections site page slot social thread title top unit "
    "wrap wrapper left right mobile desktop primary secondary mpu inline".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Whole-page elements: a class such as "with-sidebar" says nothing about their text.
WHOLE = frozenset({"html", "body", "main"})
#: Elements whose end may be left out, with what ends them when it starts, and the elements that keep them open.
ENDS = {
    "p": (BLOCKS, frozenset({"table", "button", "object"})),
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    **dict.fromkeys(("dt", "dd"), (frozenset({"dt", "dd"}), frozenset({"dl"}))),
    **dict.fromkeys(("td", "th"), (frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}), frozenset({"table"}))),
    "tr": (frozenset({"tr", "tbody", "thead", "tfoot"}), frozenset({"table"})),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"}))),
    **dict.fromkeys(("caption", "colgroup"), (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "colgroup"}), frozenset({"table"}))),
    **dict.fromkeys(("option", "optgroup"), (frozenset({"option", "optgroup"}), frozenset({"select", "datalist"}))),
}
#: They are on the stack only if they are noise.
LOOSE = frozenset({*ENDS, "html", "body"})
#: Wrappers with a noise name that are tried before names are left out altogether.
MOST_WRAPPERS = 8


def _marks(attributes: str) -> tuple[bool, bool, bool]:
    """(noise, noise by names without a word of content or by role, article) by role, class and id."""
    noise = exact = article = False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "role":
            exact |= value.lower() in NOISE_ROLES
            article |= value.lower() in ("main", "article")
        elif name == "itemprop":
            article |= value.lower() == "articlebody"
        elif name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in NAME.findall(token)]
                if any(w in NOISE_NAMES for w in words):
                    noise = True
                    exact |= all(w in NOISE_NAMES or w in FILL or w.isdigit() for w in words)
    return noise or exact, exact, article


class Page:
    """One reading of a page: the blocks of its article, main part and body that stand outside boilerplate.

    Names of the elements that start at ``wrappers`` do not count, without ``by_name`` no names do.
    """

    def __init__(self, page: str, by_name: bool = True, wrappers: frozenset[int] = frozenset()) -> None:
        self.found: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        #: Characters of text inside each outermost element that is noise by its name, and those that hold an article.
        self.lost: dict[int, int] = {}
        self.hiding: set[int] = set()
        self.vague: set[int] = set()
        self.loose = 0
        #: (element, noise, zone, start of the outermost noise by name or -1)
        self.stack: list[tuple[str, bool, str, int]] = [("", False, "body", -1)]
        self.parts: list[str] = []
        self.by_name, self.wrappers = by_name, wrappers
        self._read(page)

    def _close(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            self.parts.clear()
            if text:
                self.found[self.stack[-1][2]].append(text)

    def _end(self, at: int) -> None:
        if any(e[0] in BLOCKS for e in self.stack[at:]):
            self._close()
        self.loose -= sum(e[0] in ENDS for e in self.stack[at:])
        del self.stack[at:]

    def _text(self, text: str) -> None:
        _, out, _, lost = self.stack[-1]
        if not out:
            self.parts.append(text)
        elif lost >= 0:
            self.lost[lost] = self.lost.get(lost, 0) + len(text.strip())

    def _end_tag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._close()
        scope = ENDS[tag][1] if tag in ENDS else ()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                return self._end(i)
            if self.stack[i][0] in scope:
                return None

    def _implied_ends(self, tag: str) -> None:
        """The start of ``tag`` ends open elements that HTML lets it end."""
        at, crossed = len(self.stack) - 1, set()
        while self.loose and at > 0:
            own = self.stack[at][0]
            if own in ENDS and tag in ENDS[own][0] and crossed.isdisjoint(ENDS[own][1]):
                self._end(at)
            crossed.add(own)
            at -= 1

    def _start_tag(self, tag: str, attributes: str, at: int) -> None:
        if tag in BLOCKS:
            self._implied_ends(tag)
            self._close()
        elif tag == "br" and not self.stack[-1][1]:
            self.parts.append(" ")
        if tag in VOID or attributes.endswith("/"):
            return
        _, out, zone, lost = self.stack[-1]
        named, exact, marked = _marks(attributes) if attributes else (False, False, False)
        part = tag in ("article", "main") or marked
        named = (exact if part or zone != "body" else named) and self.by_name and tag not in WHOLE and at not in self.wrappers
        noise = named or tag in NOISE
        if part and lost in self.vague and not noise:
            self.hiding.add(lost)
        if tag in LOOSE and not noise:
            return
        if tag in BLOCKS or noise:
            if tag == "article" or marked:
                zone = "article"
            elif tag == "main" and zone == "body":
                zone = "main"
            if not out and named and tag not in NOISE:
                lost = at
                if not exact:
                    self.vague.add(at)
            self.stack.append((tag, out or noise, zone, lost))
            self.loose += tag in ENDS

    def _read(self, page: str) -> None:
        at, size, scan = 0, len(page), TAG.search
        while m := scan(page, at):
            if m.start() > at:
                self._text(page[at : m.start()])
            start, at, tag = m.start(), m.end(), (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self._end_tag(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            else:
                self._start_tag(tag, m[3], start)
        if at < size:
            self._text(page[at:])
        self._close()

    def part(self) -> tuple[list[str], bool]:
        """The blocks of the text, and whether they are those of an article or main part."""
        for zone in ("article", "main"):
            if self.found[zone]:
                return self.found[zone], True
        return self.found["body"], False


def read(page: str) -> Page:
    """The page, without names of wrappers.

    A wrapper is an element whose name also has a word of content and that holds the only article of the page; or, if
    nothing is left of the page, the element that loses most.
    """
    own, wrappers = Page(page), frozenset()
    for n in range(MOST_WRAPPERS + 1):
        if own.part()[1] or not (own.hiding or (own.lost and not own.found["body"])):
            break
        wrappers |= own.hiding or {max(own.lost, key=own.lost.get)}
        own = Page(page, n < MOST_WRAPPERS, wrappers)
    return own


def blocks(page: str) -> tuple[list[str], bool]:
    """The blocks of a page's text, and whether they are those of an article or main part."""
    return read(page).part()


def windows(tokens: list[str]) -> np.ndarray:
    """Hashes of the first LEAST tokens of each suffix that has as many."""
    return np.array([xxhash.xxh64_intdigest(" ".join(tokens[i : i + LEAST])) for i in range(len(tokens) - LEAST + 1)], np.uint64).view(np.int64)


def unique_runs(found: list[str], repeated: set[int]) -> tuple[list[str], int]:
    """The blocks without the tokens that repeated windows cover, and the number of these; all blocks if nothing would stay."""
    tokens = [b.split(" ") for b in found]
    stream = [t for b in tokens for t in b]
    covered = np.zeros(len(stream), bool)
    for i, w in enumerate(windows(stream).tolist()):
        if w in repeated:
            covered[i : i + LEAST] = True
    out, at = [], 0
    for b in tokens:
        own = [t for t, gone in zip(b, covered[at : at + len(b)], strict=True) if not gone]
        at += len(b)
        if own:
            out.append(" ".join(own))
    return out or found, int(covered.sum())


def _host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


SCHEMA = "page_id long, url string, text string, n_chars long, n_repeated long"


def _parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, text, marked, rest: the blocks of the text and, of a marked page, the other blocks outside boilerplate."""

    def run(batch: dict) -> dict:
        texts, flags, rests = [], [], []
        for html in batch["html"].to_pylist():
            page = read(html or "")
            own, marked = page.part()
            texts.append("\n".join(own))
            flags.append(marked)
            rests.append("\n".join(b for zone in page.found.values() if zone is not own for b in zone) if marked else "")
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "marked": flags, "rest": rests}

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return arrow_map(rows, run, "page_id long, url string, text string, marked boolean, rest string")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated."""
    return by_host(stored(_parsed(pages), "zstd"))


def _suffixes(parts: list[str], shard: int | None) -> tuple[list[bytes], np.ndarray]:
    """The first LEAST tokens of each suffix of each part, with the number of the part; those of one shard or all.

    The least key of two neighbouring tokens tells the shard, so suffixes that follow each other mostly stay together.
    """
    tokens = [p.split() for p in parts]
    counts = [len(t) for t in tokens]
    text = " ".join([" ".join(t) for t in tokens if t]).encode()
    n = sum(counts) - LEAST + 1
    if n < 1:
        return [], np.zeros(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    blanks = np.flatnonzero(data == ord(" "))
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(text)]])
    part = np.repeat(np.arange(len(parts)), counts)
    here = part[:n] == part[LEAST - 1 :]
    if shard is not None:
        total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(BYTE_KEYS[data], out=total[1:])
        token = total[ends] - total[starts]
        pair = mix64(token[:-1] * GOLDEN + token[1:])
        here &= functools.reduce(np.minimum, [pair[i : i + n] for i in range(LEAST - 1)]) % np.uint64(SHARDS) == shard
    at = np.flatnonzero(here)
    return [text[i:j] for i, j in zip(starts[at].tolist(), ends[at + LEAST - 1].tolist(), strict=True)], part[at]


def suffix_array(streams: DataFrame, shard: int | None = None) -> DataFrame:
    """Streams (host, text, rest, stream) -> (host, suffix, stream), each partition a sorted range of all hosts' suffix arrays.

    A suffix is known to its first LEAST tokens, as deeper order parts no interval of that height; the shorter ones at the end of
    a stream are in none. A suffix comes once for a row, so copies of a stream repeat it. Streams order equal suffixes, so a long
    interval has several partitions. With ``shard`` only the suffixes of that shard come: equal ones are in one, so no interval is parted.
    """

    def suffixes(batch: dict) -> dict:
        parts = [p for pair in zip(batch["text"].to_pylist(), batch["rest"].to_pylist(), strict=True) for p in pair]
        rows, found = [], []
        for at in range(0, len(parts), AT_ONCE):
            own, part = _suffixes(parts[at : at + AT_ONCE], shard)
            once = dict.fromkeys(zip(((part + at) // 2).tolist(), own, strict=True))
            rows += [r for r, _ in once]
            found += [s for _, s in once]
        index = pa.array(rows, pa.int64())
        return {"host": batch["host"].take(index), "suffix": pa.array(found, pa.binary()).cast(pa.string()), "stream": batch["stream"].take(index)}

    order = ("host", "suffix", "stream")
    found = arrow_map(streams.select("host", "text", "rest", "stream"), suffixes, "host string, suffix string, stream long")
    return found.repartitionByRange(*order).sortWithinPartitions(*order)


def runs(array: DataFrame, least: int = 1) -> DataFrame:
    """(host, window, streams): the suffixes that agree with their neighbours in the array on LEAST tokens, as a hash, and their streams.

    An interval that goes on in the next batch or partition comes in parts, but each of its streams once. Intervals known to have
    fewer than ``least`` streams are left out.
    """
    order = ("host", "suffix", "stream")
    target = to_arrow_schema(StructType.fromDDL("host string, window long, streams array<long>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            columns = [batch.column(c) for c in order]
            if last is not None:
                columns = [pa.concat_arrays([before, c]) for before, c in zip(last, columns, strict=True)]
            n = len(columns[0])
            if not n:
                continue
            host, suffix, stream = (pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in columns)
            # The row before the batch only tells whether its first row comes again.
            rows = np.flatnonzero(np.concatenate([[last is None], host | suffix | stream]))
            new = np.concatenate([[True], host | suffix])
            last = [c.slice(n - 1) for c in columns]
            if not len(rows):
                continue
            # A row that is dropped never starts an interval.
            starts = np.flatnonzero(np.concatenate([[True], new[rows[1:]]]))
            sizes = np.diff([*starts.tolist(), len(rows)])
            kept = sizes >= least
            kept[[0, -1]] = True
            ids = columns[2].take(pa.array(rows[np.repeat(kept, sizes)]))
            first = pa.array(rows[starts[kept]])
            hashes = np.array([xxhash.xxh64_intdigest(s) for s in columns[1].take(first).to_pylist()], np.uint64).view(np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[kept])]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [columns[0].take(first).cast(pa.string()), pa.array(hashes), pa.ListArray.from_arrays(offsets, ids, type=target.field("streams").type)], schema=target
            )

    return array.select(*order).mapInArrow(run, StructType.fromDDL("host string, window long, streams array<long>"))


def counted(found: DataFrame) -> DataFrame:
    """(host, window, on): intervals put together from their runs, with their number of streams."""
    return found.groupBy("host", "window").agg(F.sum(F.size("streams")).alias("on"))


def intervals(array: DataFrame) -> DataFrame:
    """(host, window, on): the suffixes that agree with their neighbours in the array on LEAST tokens, as a hash, and their number of streams."""
    return counted(runs(array))


def by_host(rows: DataFrame) -> DataFrame:
    """Texts of parsed pages, with the number of tokens that their host repeats; unmarked ones without these."""
    rows = rows.withColumn("host", _host(F.col("url"))).withColumn("stream", F.xxhash64("text", "rest"))
    hosts = rows.select("host", "stream").distinct().groupBy("host").agg(F.count("stream").alias("pages"))
    found = functools.reduce(DataFrame.union, [stored(runs(suffix_array(rows, k), 2), shuffles=False) for k in range(SHARDS)])
    spans = counted(found)
    repeated = spans.filter(F.col("on") >= 2).join(hosts, "host").filter(F.col("on") >= F.least(F.col("pages"), F.lit(MIN_PAGES)))
    again = stored(
        found.join(repeated.select("host", "window"), ["host", "window"])
        .select("host", "window", F.explode("streams").alias("stream"))
        .groupBy("host", "stream")
        .agg(F.collect_set("window").alias("repeated")),
        shuffles=False,
    )

    def cut(batch: dict) -> dict:
        texts, counts = [], []
        for text, marked, gone in zip(*(batch[c].to_pylist() for c in ("text", "marked", "repeated")), strict=True):
            own, n = unique_runs(text.split("\n"), set(gone)) if gone else ([], 0)
            texts.append(text if marked or not n else "\n".join(own))
            counts.append(n)
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_repeated": counts}

    def done(k: int) -> DataFrame:
        own = F.pmod("stream", F.lit(SHARDS)) == k
        pages = rows.filter(own).join(again.filter(own), ["host", "stream"], "left")
        return arrow_map(pages.select("page_id", "url", "text", "marked", "repeated"), cut, SCHEMA)

    # The texts meet their windows in parts as well.
    return functools.reduce(DataFrame.union, [stored(done(k), "zstd", shuffles=False) for k in range(SHARDS)])
