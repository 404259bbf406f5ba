"""Main text of web pages: structure first, then a suffix array over each host's pages.

A page is read into blocks in page order. Elements that are never article text (navigation, headers,
footers, asides, forms, scripts, notices, adverts, reader comments) are passed over; where a page marks its
article (or its main part), the blocks inside are the text. Everything else is undecided: such blocks and
the other unmarked text of the host's pages form token streams, concatenated and sorted as suffixes, and
stretches that distinct pages share are boilerplate; covered runs of tokens are cut out of their blocks, unique runs stay.

A stretch of RUN tokens or more is on enough pages exactly if each RUN tokens of it are, so suffixes need be sorted
by their first RUN tokens only. The sort is a shuffle: suffixes are dealt by a hash of host and those tokens, each
bucket is sorted, and equal neighbours are counted, so a host's array spreads over all tasks however many
pages it has. Each task counts its own pages first; pages of equal streams are counted once.

Most suffixes are unique, and one in three suffices to tell: among the WINNOW runs of GRAM tokens within RUN tokens the
one with the least hash is the same wherever those tokens stand. These are counted first, and only suffixes whose
least run is on two pages are sorted. That loses none.

Blocks of marked articles lose only stretches that are on most of a host's pages, and only on hosts with a few
pages: pages quote and copy each other, and such passages are text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.bits import bit_table, passing
from logweave.llm.decontaminate import _MIX, _Hasher
from logweave.llm.frames import few_bytes, materialise, without_ids

#: Tokens that a shared stretch has at least, and the distinct pages of a host that have it (both, if there are two).
RUN, PAGES = 8, 3
#: Tokens of the runs that are counted first, and how many of them lie in a stretch.
GRAM, WINNOW = 4, 5
#: In blocks of marked articles: more than half of the host's distinct articles, where there are so many.
ARTICLE_PAGES = 4
#: Suffixes in one bucket, 8 or 12 bytes each: bounds the memory of a task.
BUCKET = 600_000
#: Bytes of shared suffixes up to which they go to every task; beyond, pages' places are joined with them.
SHARED_BYTES = 16_000_000
LOG_BITS = 26
HOSTS_BROADCAST = 100_000
#: Pages held as Python objects at a time.
PARSED = 256
#: Pages whose keys are counted together before they are shuffled.
DEALT = 1024

RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed".split())
DROPPED = frozenset("nav footer aside form header menu dialog head template svg select button canvas audio video".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table caption thead tbody tfoot tr ul".split())
SPACES = frozenset("br td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Whole class names and ids that mark what is not article text, alone or with PARTS in a compound.
CUES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup paywall nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets related recommended "
    "share sharing social footer masthead topbar toolbar popup modal overlay comment comments commentlist disqus respond replies pagination pager login search skip skiplink".split()
)
PARTS = frozenset(
    "site main page post posts article articles story stories content global primary secondary top bottom left right header inner outer box boxes bar container wrapper wrap list lists item items "
    "form forms button buttons btn link links icon icons area section block blocks slot unit title label toggle text".split()
)
#: Of the cues those that hold even where cues have removed most of a page.
READERS = frozenset("comment comments commentlist disqus respond replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A tag from its "<" on: slash, name, attributes. Every part is possessive, so it is read once; a tag that never ends takes the rest.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|=|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|))?+)*+)(?:>|\Z)""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)\s*+=\s*+("[^"]*+|'[^']*+|[^\s>"'][^\s>]*+)""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _cue(name: str, cues: frozenset[str]) -> bool:
    words = _WORD.findall(_CAMEL.sub(" ", name).lower())
    return not cues.isdisjoint(words) and all(w in CUES or w in PARTS or w.isdigit() for w in words)


def _unwanted(name: str, attributes: str, cues: frozenset[str], inside: bool) -> bool:
    """Whether an element is none of the article's, by its name or attributes. Headings' names and, inside an
    article, sections' ids are made from the text and say nothing."""
    if "=" not in attributes and "hidden" not in attributes:
        return False
    if name in ("html", "body", "main"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), unescape(value.strip("\"'"))
        named = name not in HEADINGS and (key == "class" or key == "id" and not (inside and name == "section"))
        if named and any(_cue(v, cues) for v in value.split()):
            return True
        if key == "role" and value.lower() in ROLES or key == "style" and _HIDDEN.search(value) or key == "aria-hidden" and value == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes, re.I)) and "aria-hidden" not in attributes


def read_blocks(html: str, cues: frozenset[str] | bool = True) -> tuple[list[str], list[str], list[str]]:
    """Blocks inside articles, inside a main part, and elsewhere; elements passed over are in none."""
    placed = ordered_blocks(html, CUES if cues is True else cues or None)
    return tuple([b for w, b in placed if w == where] for where in ("article", "main", ""))


def ordered_blocks(html: str, cues: frozenset[str] | None = CUES) -> list[tuple[str, str]]:
    """(article, main or nothing; text) of each block in page order. Without cues, only elements' names
    count, and not their attributes."""
    placed: list[tuple[str, str]] = []
    depth = {"article": 0, "main": 0}
    piece: list[str] = []
    skip, nested = "", 0  # the element that is passed over, and how often it is open
    heading, title = False, False  # inside an article's own header; inside a heading. Short lines there are bylines
    at, size = 0, len(html)

    def text(raw: str) -> None:
        if raw and not skip:
            piece.append(raw)

    def close() -> None:
        if piece:
            words = unescape("".join(piece)).split()
            piece.clear()
            if words and not (heading and not title and len(words) < RUN):
                where = "article" if depth["article"] else "main" if depth["main"] else ""
                placed.append((where, " ".join(words)))

    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            text(html[at:])
            break
        text(html[at:begin])
        m = _TAG.match(html, begin)
        if m is None:
            at = _after_oddity(html, begin)
            if at == begin + 1:
                text("<")
            continue
        at = m.end()
        name = m[2].lower()
        ends = m[1] == "/"
        if skip:
            if not ends and name in RAW:
                at = _after(html, at, name)
                continue
            implied = name in BLOCKS and name != skip if ends else name in BLOCKS
            if implied and (skip == "p" or skip not in BLOCKS):
                skip, nested = "", 0  # a paragraph or an inline element ends where a block begins or ends
            elif not ends and name in depth and name != skip and not (cues and _unwanted(name, m[3], cues, False)):
                skip, nested = "", 0  # what was passed over has never been closed
            else:
                if name == skip:
                    nested += -1 if ends else 1
                    skip = skip if nested else ""
                continue
        if name in RAW:
            if name == "textarea":
                piece.append(" ")
            if not ends:
                at = _after(html, at, name)
            continue
        if name in BLOCKS:
            close()
            title = name in HEADINGS and not ends
        elif name in SPACES or name in ("select", "button"):
            piece.append(" ")
        if ends:
            if name in depth:
                depth[name] = max(0, depth[name] - 1)
            if name == "header":
                heading = False
            continue
        if name in VOID:
            continue
        odd = cues and _unwanted(name, m[3], cues, depth["article"] > 0)
        if name == "header" and depth["article"] and not odd:
            heading = True
            continue
        if heading and name in ("ul", "ol", "time", "address"):
            skip, nested = name, 1
            continue
        if name in DROPPED or odd:
            if not m[3].endswith("/") or name in DROPPED:
                skip, nested = name, 1
            continue
        if name in depth:
            depth[name] += 1
    close()
    return placed


def page_blocks(html: str) -> list[tuple[str, str]]:
    """The blocks of a page; if cues have removed most of an unmarked page's text, or all of any, they were a
    wrapper's, and count no more."""
    size = lambda placed: sum(len(b) for _, b in placed)
    own = ordered_blocks(html)
    for fewer in (READERS, None):
        if own and (fewer is None or any(w for w, _ in own)):
            break
        more = ordered_blocks(html, fewer)
        if 2 * size(own) < size(more):
            own = more
    return own


def _after_oddity(html: str, at: int) -> int:
    """The place behind a comment, a declaration or an end tag without a name; behind the "<" alone where it is text."""
    if html.startswith("<!--", at):
        end, size = html.find("-->", at + 2), 3
    elif html.startswith(("<!", "<?", "</"), at):
        end, size = html.find(">", at), 1
    else:
        return at + 1
    return len(html) if end < 0 else end + size


def _after(html: str, at: int, name: str) -> int:
    """The place behind the end tag of an element whose content is no markup."""
    low = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
    return low.end() if low else len(html)


def _streams(placed: list[tuple[str, str]]) -> list[bytes]:
    """The token streams of undecided and of article blocks; each block ends in a token of its own."""
    return ["".join(t + " \n " for w, t in placed if (w == "article") == sure).encode("utf-8", "replace") for sure in (False, True)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """blocks has the page's blocks in order and sure whether they are an article's. They may be teasers, so the
    page's other text is undecided; without an article, a main part's blocks are taken for one. loose and firm name
    the content of the two streams, tokens counts both."""
    for b in batches:
        for k in range(0, b.num_rows, PARSED):
            part = b.slice(k, PARSED)
            blocks, sures, names, tokens = [], [], ([], []), []
            for html in part.column("html").to_pylist():
                placed = page_blocks(html or "")
                if not any(w == "article" for w, _ in placed) and any(w == "main" for w, _ in placed):
                    placed = [("article", t) for w, t in placed if w == "main"]
                blocks.append([t.encode("utf-8", "replace") for _, t in placed])
                sures.append([w == "article" for w, _ in placed])
                streams = _streams(placed)
                for own, stream in zip(names, streams, strict=True):
                    own.append(hashlib.blake2b(stream, digest_size=16).digest() if stream else None)
                tokens.append(sum(x.count(b" ") for x in streams))
            made = [pa.array(blocks, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(sures, pa.list_(pa.bool_())), *[pa.array(x, pa.binary()) for x in names], pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("row", "page_id", "url", "host")], *made], [*"row page_id url host blocks sure loose firm tokens".split()])


def stretches(host: str | None, sure: bool, blocks: list[str], run: int = RUN, hasher: _Hasher | None = None) -> np.ndarray:
    """A 64-bit key of host, kind and ``run`` tokens for each place of a stream."""
    hasher = hasher or _Hasher()
    data = np.frombuffer(_streams([("article" if sure else "", t) for t in blocks])[sure], dtype=np.uint8)
    ends = np.flatnonzero(data == 32)
    tokens = hasher.words(data, np.concatenate([[0], ends[:-1] + 1]).astype(np.int64), ends) if len(ends) else np.zeros(0, np.uint64)
    if len(tokens) < run:
        return np.zeros(0, np.uint64)
    salt = np.uint64(int.from_bytes(hashlib.blake2b(f"{int(sure)}{host}".encode(), digest_size=8).digest(), "little") | 1)
    keys = np.zeros(len(tokens) - run + 1, np.uint64)
    for k in range(run):
        keys = (keys ^ (keys >> np.uint64(31))) * _MIX[1 + k % 8] + tokens[k : len(tokens) - run + 1 + k]
    keys = (keys ^ (keys >> np.uint64(29))) * salt
    return keys ^ (keys >> np.uint64(32))


def least_grams(host: str | None, sure: bool, blocks: list[str], hasher: _Hasher) -> np.ndarray:
    """For each place of a stream, the least key among the runs of GRAM tokens within the RUN tokens that begin there."""
    keys = stretches(host, sure, blocks, GRAM, hasher)
    return np.lib.stride_tricks.sliding_window_view(keys, WINNOW).min(axis=1) if len(keys) >= WINNOW else keys[:0]


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys byte by byte: all first bytes, all second ones and so on, of which the high ones compress."""
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8).T.tobytes()


def _deal(buckets: int, shared=None, log: int = 0):
    """Distinct keys of each page, counted over a batch's pages, as one payload for each bucket: keys on one page, and
    keys on more with their counts. The keys are least runs, or, if ``shared`` has bits of some, the stretches of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = _Hasher(), None if shared is None else np.frombuffer(shared.value, np.uint8)
        for b in batches:
            for k in range(0, b.num_rows, DEALT):
                part = b.slice(k, DEALT)
                own = [np.zeros(0, np.uint64)]
                for host, kind, blocks in zip(*(part.column(c).to_pylist() for c in ("host", "kind", "blocks")), strict=True):
                    keys = least_grams(host, kind == 1, blocks, hasher)
                    if bits is not None and len(at := passing(bits, keys, log)):
                        keys = stretches(host, kind == 1, blocks, RUN, hasher)[at]
                    elif bits is not None:
                        continue
                    own.append(np.unique(keys))
                keys, n = np.unique(np.concatenate(own), return_counts=True)
                if not len(keys):
                    continue
                once = n == 1
                bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # rises with the keys
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(cuts[1:], len(bucket))
                parts = [(keys[i:j], n[i:j].astype(np.uint32), once[i:j]) for i, j in zip(cuts, ends, strict=True)]
                payload = [_planes(x[o]) for x, _, o in parts], [x[~o].tobytes() + m[~o].tobytes() for x, m, o in parts]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), *[pa.array(x, pa.binary()) for x in payload]], ["bucket", "once", "more"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys on two distinct pages or more. Rows come sorted by bucket; payloads are merged as they come."""

    def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        some = n > 1
        return pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(n[some])], ["key", "n"])

    held, keys, n = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    parts: list[tuple[bytes, bytes]] = []

    def merge() -> None:
        nonlocal keys, n
        ones = [np.ascontiguousarray(np.frombuffer(o, np.uint8).reshape(8, -1).T).view(np.uint64)[:, 0] for o, _ in parts]
        mores = [np.frombuffer(m, np.uint64, len(m) // 12) for _, m in parts]
        counts = [np.frombuffer(m, np.uint32, len(m) // 12, len(m) // 12 * 8) for _, m in parts]
        every = np.concatenate([keys, *ones, *mores])
        weights = np.concatenate([n, np.ones(sum(map(len, ones)), np.int64), *counts])
        keys, place = np.unique(every, return_inverse=True)
        n = np.bincount(place, weights=weights, minlength=len(keys)).astype(np.int64)
        parts.clear()

    size = 0
    for batch in batches:
        for k, *p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if k != held and held is not None:
                merge()
                yield out(keys, n)
                keys, n, size = keys[:0], n[:0], 0
            held = k
            parts.append(tuple(p))
            size += sum(map(len, p))
            if size > 12 * BUCKET:
                merge()
                size = 0
    if held is not None:
        merge()
        yield out(keys, n)


def cover(length: int, begins: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which of ``length`` tokens lie in a stretch of ``run`` tokens that begins at one of the places."""
    edge = np.zeros(length + 1, dtype=np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, np.minimum(begins + run, length), -1)
    return np.cumsum(edge)[:length] > 0


def _keep(blocks: list[str], sure: list[bool], covered: dict[bool, np.ndarray]) -> str:
    """The page's text without the covered tokens of its two streams."""
    at, kept = {False: 0, True: 0}, []
    for block, s in zip(blocks, sure, strict=True):
        words = block.split(" ")
        flags = covered[s][at[s] : at[s] + len(words)]
        at[s] += len(words) + 1
        kept.append(" ".join(w for w, c in zip(words, flags, strict=True) if not c) if flags.any() else block)
    return "\n\n".join(b for b in kept if b)


def _cutter(shared):
    """Texts of pages; ``hits`` has the places that a join found, or null where the shared stretches are at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = _Hasher(), None if shared is None else tuple(np.frombuffer(x, t) for x, t in zip(shared.value, (np.uint64, np.int64), strict=True))
        for b in batches:
            texts = []
            for k in range(0, b.num_rows, PARSED):
                part = b.slice(k, PARSED)
                for host, blocks, sure, needs, hits in zip(*(part.column(c).to_pylist() for c in ("host", "blocks", "sure", "needs", "hits")), strict=True):
                    covered = {}
                    for s in (False, True):
                        own = [t for t, x in zip(blocks, sure, strict=True) if x == s]
                        size = sum(t.count(" ") + 2 for t in own)
                        if needs[s] is None or size < RUN:
                            begins = np.zeros(0, np.int64)
                        elif table is None:
                            begins = np.array([h["at"] for h in hits or [] if h["kind"] == int(s) and h["n"] >= needs[s]], dtype=np.int64)
                        else:
                            keys = stretches(host, s, own, RUN, hasher)
                            at = np.minimum(np.searchsorted(table[0], keys), max(0, len(table[0]) - 1))
                            begins = np.flatnonzero((table[0][at] == keys) & (table[1][at] >= needs[s])) if len(table[0]) else np.zeros(0, np.int64)
                        covered[s] = cover(size, begins)
                    texts.append(_keep(blocks, sure, covered))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def _places(shared, log: int):
    """Places of pages' streams whose stretch may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hasher = np.frombuffer(shared.value, np.uint8), _Hasher()
        for b in batches:
            for row, host, kind, blocks in zip(*(b.column(c).to_pylist() for c in ("row", "host", "kind", "blocks")), strict=True):
                keys = stretches(host, kind == 1, blocks, RUN, hasher)
                at = passing(bits, keys, log)
                made = [pa.array([row] * len(at), pa.int64()), pa.array([kind] * len(at), pa.int32()), pa.array(at), pa.array(keys[at].view(np.int64))]
                yield pa.RecordBatch.from_arrays(made, ["row", "kind", "at", "key"])

    return run


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shared_bytes: int = SHARED_BYTES, log_bits: int = LOG_BITS) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars.

    A null html counts as an empty one and gives an empty text; a null url, or one without a host, belongs to
    the host ''; repeated rows are extracted each, and count as one page when stretches are compared; an
    empty table gives no rows. Other columns are not read. A host's pages are compared over the whole table.
    """
    sc, kind = pages.sparkSession.sparkContext, pages.schema[id_col].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^\w+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    slim = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    parsed = slim.mapInArrow(_parse, f"row long, page_id {kind}, url string, host string, blocks array<string>, sure array<boolean>, loose binary, firm binary, tokens long")
    parsed = materialise(parsed, "pages")

    which = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("content")) for k, c in enumerate(("loose", "firm"))])).alias("w")
    named = parsed.select("row", "host", which).select("row", "host", "w.*").where("content is not null")
    contents = named.groupBy("host", "kind", "content").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n"))
    contents = materialise(contents, "page-contents")
    sizes = contents.groupBy("host").pivot("kind", [0, 1]).count().select(F.col("host").alias("of"), F.coalesce("0", F.lit(0)).alias("loose_pages"), F.coalesce("1", F.lit(0)).alias("firm_pages"))
    need = F.when(F.col("loose_pages") > 1, F.least(F.lit(PAGES), F.col("loose_pages"))).cast("long"), F.when(F.col("firm_pages") >= ARTICLE_PAGES, F.floor(F.col("firm_pages") / 2) + 1).cast("long")
    needs = materialise(sizes.select("of", F.array(*need).alias("needs")).where("needs[0] is not null or needs[1] is not null"), "page-hosts")
    few = needs.limit(HOSTS_BROADCAST + 1).count() <= HOSTS_BROADCAST and few_bytes(needs.select("of"))
    small = lambda df: F.broadcast(df) if few else df

    own = F.transform(F.filter(F.arrays_zip("blocks", "sure"), lambda b: b["sure"] == (F.col("kind") == 1)), lambda b: b["blocks"])
    streams = parsed.where("tokens > 0").join(small(needs), F.col("host") == F.col("of"))
    streams = streams.select("row", "host", F.explode(F.filter(F.array(F.lit(0), F.lit(1)), lambda k: F.get("needs", k).isNotNull())).alias("kind"), "blocks", "sure").select("row", "host", "kind", own.alias("blocks")).where(F.size("blocks") > 0)
    again = named.join(contents.where("n > 1"), ["host", "kind", "content"]).where("row <> least").select((F.col("row") * 2 + F.col("kind")).alias("sid"))
    again = materialise(again, "page-copies")
    once = without_ids(streams.withColumn("sid", F.col("row") * 2 + F.col("kind")), again, "sid")
    total = parsed.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(64, -(-total // BUCKET))

    def counted(deal) -> DataFrame:
        dealt = once.select("host", "kind", "blocks").mapInArrow(deal, "bucket int, once binary, more binary")
        return dealt.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_count, "key long, n long")

    repeated = sc.broadcast(bit_table(counted(_deal(buckets)), log_bits).tobytes())
    shared = materialise(counted(_deal(buckets, repeated, log_bits)), "page-stretches")

    given = parsed.join(small(needs), F.col("host") == F.col("of"), "left").withColumn("needs", F.coalesce("needs", F.array(F.lit(None).cast("long"), F.lit(None).cast("long"))))
    out = f"page_id {kind}, url string, text string, n_chars long"
    if shared.count() * 16 <= shared_bytes:
        held = shared.toArrow()
        keys, n = held.column("key").to_numpy().view(np.uint64), held.column("n").to_numpy()
        order = np.argsort(keys)
        at_hand = sc.broadcast((keys[order].tobytes(), n[order].astype(np.int64).tobytes()))
        return given.select("page_id", "url", "host", "blocks", "sure", "needs", F.lit(None).cast("long").alias("hits")).mapInArrow(_cutter(at_hand), out)
    bits = sc.broadcast(bit_table(shared, log_bits).tobytes())
    found = streams.mapInArrow(_places(bits, log_bits), "row long, kind int, at long, key long").join(shared, "key")
    hits = found.groupBy("row").agg(F.collect_list(F.struct("kind", "at", "n")).alias("hits"))
    return given.join(hits, "row", "left").select("page_id", "url", "host", "blocks", "sure", "needs", "hits").mapInArrow(_cutter(None), out)
