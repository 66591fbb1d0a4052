"""Main text of web pages: markup decides what it can, repeats on the host decide the rest."""

from __future__ import annotations

import html
import re
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.columns import bounded_batches, boxed, unboxed
from attestry.llm.hashing import mix, seeded, signed
from attestry.session import cut_lineage

# a run of so many tokens that other pages of the host have too is boilerplate
RUN = 8

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math object".split())
SKIPPED = RAW | frozenset("head nav header footer aside form button select dialog menu canvas audio video label fieldset".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 "
    "hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
HOLDERS = frozenset(("html", "body", "main"))
# an open <p> ends where a block starts; these end their own kind
ENDS_P = BLOCKS - frozenset(("body", "html"))
SIBLINGS = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split()
)
# words in a class or id that name what is not the article
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "cookie cookies consent disqus footer header hidden masthead menu modal nav navbar navigation newsletter notice "
    "notices notification overlay paywall popup promo promoted promotion related respond replies share sharing sidebar "
    "skip social sponsor sponsored subscribe subscription toolbar widget gdpr".split()
)
NAME_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

PAGE = "struct<blocks:array<struct<text:string,open:boolean,kept:boolean>>,keys:array<bigint>,stream:bigint>"


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(source)}


def _named(source: str, holder: str = "") -> bool:
    """Whether a tag's attributes say that it holds no main text.

    Classes and ids of what holds a whole page or article (its tag is `holder`) tell of its
    layout: those of an article count where they are such a name, the others' never do.
    """
    if "=" not in source and "hidden" not in source.lower():
        return False
    found = _attributes(source)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if found.get("role", "").lower() in ROLES or HIDDEN.search(found.get("style", "")):
        return True
    names = f"{found.get('class', '')} {found.get('id', '')}"
    if holder:
        return holder not in HOLDERS and any(name in NAMED for name in names.lower().split())
    return any(part.lower() in NAMED for part in NAME_PARTS.findall(names))


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(text, place) of a page's blocks in order.

    The place is `main` inside an article or main element, `open` elsewhere in the body, and
    `out` where markup says that it is no main text.  Text is decoded, its white space is one
    space.  Tags that are not closed end where their parent, a sibling or the page ends.  An
    element inside a line that is no main text (hidden words, an advert, a share link) leaves its
    words out and the block whole.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, bool, bool]] = []
    pieces: list[str] = []
    skipped = main = hushed = 0

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append((text, "out" if skipped else "main" if main else "open"))

    def close(upto: int) -> None:
        nonlocal skipped, main, hushed
        while len(stack) > upto:
            name, bad, inline = stack.pop()
            hushed -= inline
            skipped -= bad and not inline
            main -= name in MAIN and not bad

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            if not hushed:
                pieces.append(page[at:])
            break
        if not hushed:
            pieces.append(page[at : m.start()])
        at = m.end() if m.end() > m.start() else m.start() + 1
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if name in BLOCKS or name in SKIPPED:
                flush()
            if k is not None:
                close(k)
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        holds = name in HOLDERS or name in MAIN and not main
        bad = name in SKIPPED or _named(m[3], name if holds else "")
        inline = bad and name not in SKIPPED and name not in BLOCKS
        if name in BLOCKS or bad and not inline:
            flush()
        if name in ENDS_P:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCKS), None)
            if k is not None and stack[k][0] == "p":
                close(k)
        for other in SIBLINGS.get(name, ()):
            if any(s[0] == other for s in stack):
                k = max(i for i, s in enumerate(stack) if s[0] == other)
                if not any(s[0] in ("ul", "ol", "dl", "table") for s in stack[k + 1 :]):
                    flush()
                    close(k)
        if name in VOID or m[3].endswith("/"):
            continue
        stack.append((name, bad, inline))
        hushed += inline
        skipped += bad and not inline
        main += name in MAIN and not bad
    flush()
    return out


def _keys(tokens: list[str], run: int) -> np.ndarray:
    """A hash for each run of tokens in a stream."""
    if len(tokens) < run:
        return np.zeros(0, np.int64)
    words = mix(np.array([hash_token(t) for t in tokens], np.uint64))
    factors, total = seeded(run, 23), np.zeros(len(words) - run + 1, np.uint64)
    for k in range(run):
        total += words[k : k + len(total)] * factors[k]
    return signed(mix(total))


def hash_token(token: str) -> int:
    return int.from_bytes(blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _read(page: str, host_hash: int, run: int) -> dict:
    """A page's blocks, and the keys of the stream that is compared with the host's others."""
    blocks = blocks_of(page)
    has_main = any(place == "main" for _, place in blocks)
    rows, stream = [], []
    for text, place in blocks:
        # in a page with an article, what lies outside is not part of it
        open_ = place == "open" and not has_main
        rows.append({"text": text, "open": open_, "kept": place == "main"})
        if open_ or place != "main":
            stream += [*text.split(), "\n"]
    keys = np.unique(_keys(stream, run) ^ np.int64(host_hash))
    return {"blocks": rows, "keys": keys, "stream": hash_token(" ".join(stream)) - (1 << 63)}


def _kept_runs(blocks: list[dict], keys: set[int], host_hash: int, run: int) -> str:
    """The text: blocks of the article, and of open ones the runs that no other page has."""
    stream: list[str] = []
    ends = []
    for b in blocks:
        if b["open"] or not b["kept"]:
            stream += [*b["text"].split(), "\n"]
        ends.append(len(stream))
    covered = np.zeros(len(stream) + 1, np.int64)
    for at, key in enumerate((_keys(stream, run) ^ np.int64(host_hash)).tolist()):
        if key in keys:
            covered[at] += 1
            covered[at + run] -= 1
    covered = np.cumsum(covered) > 0
    out, begin = [], 0
    for b, end in zip(blocks, ends, strict=True):
        if b["kept"]:
            out.append(b["text"])
        elif b["open"]:
            left = " ".join(t for t, c in zip(stream[begin : end - 1], covered[begin : end - 1].tolist(), strict=True) if not c)
            if left:
                out.append(left)
        begin = end
    return "\n\n".join(out)


def host_of(url: Column) -> Column:
    """The host of an address, lower-cased; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def main_text(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", run: int = RUN, into: str = "main_text"
) -> DataFrame:
    """All rows and columns of `pages` with the text `into`, empty if there is none.

    Scripts, styles, menus, headers, footers, sidebars, forms, notices, adverts, comments and
    hidden parts go by tag, role, class and id.  If the page has an article or main element,
    its other blocks are the text.  Else every other block is open: the token streams of the
    host's pages are compared, and what lies in a run of `run` tokens or more that pages with
    another stream have too is removed; unique runs stay.  Menus, footers and the like are
    part of the streams, so a copy of them in an open block is known.

    Equal suffix prefixes of `run` tokens of a host meet by their hash, as neighbours in a
    suffix array do; which pages hold one is aggregated to a pair of streams before it is
    shuffled, so a host of any size is spread over all tasks.  A page seen twice is no
    evidence against itself.  Null html is empty; a null url is the host "".  Blocks are
    joined by two line ends, in page order.
    """
    bounded_batches(pages.sparkSession)
    html_ = F.coalesce(F.col("row")[html_col].cast("string"), F.lit(""))
    host = F.xxhash64(host_of(F.col("row")[url_col]))
    rows = pages.select(boxed(pages)).select("row", html_.alias("html"), host.alias("host"))
    # a page is known by its html and host: equal ones share their result
    page = F.xxhash64("html", "host").alias("page")

    def read(batches):
        """Keys with the page's stream; the page itself only where it has open blocks."""
        for batch in batches:
            keys, streams, pages_ = [np.zeros(0, np.int64)], [], []
            for p, h, n in zip(*(batch.column(k) for k in range(3)), strict=True):
                got = _read(p.as_py(), h.as_py(), run)
                keys.append(got["keys"])
                streams += [got["stream"]] * len(got["keys"])
                pages_ += [n.as_py() if any(b["open"] for b in got["blocks"]) else None] * len(got["keys"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(streams, pa.int64()), pa.array(pages_, pa.int64())],
                ["key", "stream", "page"],
            )

    streams = rows.select("html", "host", page).mapInArrow(read, "key bigint, stream bigint, page bigint")
    streams = cut_lineage(streams)
    seen = streams.groupBy("key").agg(F.min("stream").alias("lo"), F.max("stream").alias("hi"))
    repeated = seen.where("lo <> hi").select("key")
    asked = streams.where("page IS NOT NULL").select("page", "key").distinct()
    found = asked.join(repeated, "key").groupBy("page").agg(F.collect_list("key").alias("keys"))
    found = cut_lineage(found)
    whole = rows.select("row", page).join(found, "page", "left")
    return unboxed(whole, pages.columns, **{into: _assembled(run)(html_, host, F.col("keys"))})


def _assembled(run: int):
    @F.arrow_udf("string")
    def text(pages: pa.Array, hosts: pa.Array, keys: pa.Array) -> pa.Array:
        out = []
        for p, h, k in zip(pages, hosts, keys, strict=True):
            got = _read(p.as_py(), h.as_py(), run)
            out.append(_kept_runs(got["blocks"], set(k.as_py() or ()), h.as_py(), run))
        return pa.array(out, pa.string())

    return text
