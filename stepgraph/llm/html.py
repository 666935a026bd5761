"""Main text of web pages: nearest-URL page differencing of every page, then an exact check by markup.

Page differencing: each page is paired with the page of the nearest url path on its host, their text lines are
aligned by longest common subsequence, and shared lines are deleted.  All lines of all pages go through it,
those of menus, adverts and footers too.  The check follows, line by line, where markup settles a line: a shared
line of a marked article is restored, as articles of one host share paragraphs; a line left that stands in a
menu, advert, form or the like, or outside a marked article, is removed, as these differ from page to page.
On other lines differencing decides.  README.md has the figures.

Defined cases: null or empty html gives an empty text; unclosed and truncated markup is read as far as it
goes; a page alone on its host shares nothing; pages without a host are differenced among themselves; repeated
rows are pages of their own, but pages of one url path that are equal save for lines that markup rules out are
one page to the differencing, so copies are not differenced against each other; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ranked, table
from .urls import host_of, path_of

# Names from HTML and common class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select button option xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th"
    " thead tr ul".split()
)
DROP = frozenset("nav footer aside form head menu dialog search fieldset".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner"
    " banners cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay newsletter subscribe subscription signup login"
    " sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer footers masthead comment comments disqus respond replies"
    " reactions share sharing social related recommended recommendations widget widgets pagination pager toolbar topbar".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Words for a part or frame of what the word before them names.
FRAMES = frozenset("area bar block box button buttons container content group holder inner item items link links list outer panel row section slot tile title top unit wrap wrapper zone".split())
#: Words that say what an element has, lacks or goes with, and words for a state or a whole page.
ABOUT = frozenset("has have with without no not non is hide show".split())
STATES = frozenset("active closed collapsed disabled enabled expanded free layout off on open opened page ready visible".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: What markup says of a line: not of the article, nothing, of the article.
RULED_OUT, LEFT_OPEN, MARKED = range(3)


@lru_cache(maxsize=4096)
def marks_other(token: str) -> bool:
    """Whether a whole class or id names something beside the article, by its first or last word, frames and numbers aside.

    has-sidebar, with-ads, no-menu, menu-open and the like say something of the element, not what it is.
    """
    words = [w.lower() for w in WORDS.findall(token)]
    while len(words) > 1 and (words[-1].isdigit() or words[-1] in FRAMES):
        words.pop()
    if not words or words[-1] in STATES or any(w in ABOUT for w in words[:-1]):
        return False
    return words[0] in DROP_WORDS or words[-1] in DROP_WORDS


@lru_cache(maxsize=4096)
def role_of(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is dropped, whether it holds the article."""
    got = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
    role = got.get("role", "").lower()
    if name in ("article", "main") or role == "main":
        return False, True
    if name in DROP or role in DROP_ROLES or "hidden" in got:
        return True, False
    names = [t for k in ("class", "id") for t in got.get(k, "").split()]
    return name not in ("body", "html") and any(map(marks_other, names)), False


def tokens(page: str) -> list[tuple]:
    """(name, closing, attributes, text before) for each tag; contents of raw elements are left out."""
    out, at, done = [], 0, 0
    lowered = None
    while True:
        hit = TAG.search(page, at)
        if hit is None:
            out.append(("", False, "", page[done:]))
            return out
        close, name, attributes, close2, name2, attributes2 = hit.groups()
        name = (name or name2 or "").lower()
        if not name:
            out.append(("!", False, "", page[done : hit.start()]))
        else:
            out.append((name, bool(close or close2), attributes if attributes is not None else attributes2 or "", page[done : hit.start()]))
        at = done = hit.end()
        if name in RAW and not (close or close2) and not page[at - 2 : at] == "/>":
            if lowered is None:
                lowered = page.lower()
            end = lowered.find(f"</{name}", at)
            if end < 0:
                if name in ("script", "style", "textarea", "title"):
                    return out
                continue
            stop = page.find(">", end)
            at = done = len(page) if stop < 0 else stop + 1


def end_of(parts: list[tuple], at: int) -> int:
    """Index of the token that closes the element opened at index at; of the next block or heading if nothing does."""
    name, depth = parts[at][0], 0
    for i in range(at, len(parts)):
        other, closing = parts[i][:2]
        if name in ("p", "li", "td", "dd", "dt") and i > at and not closing and (other == name or name == "p" and other in BLOCK):
            return i - 1
        if other == name and other:
            depth += -1 if closing else 1
            if depth <= 0:
                return i
    for i in range(at + 1, len(parts)):  # never closed: up to what cannot be part of it
        if parts[i][0] in ("article", "main", "h1") or parts[i][1] and parts[i][0] in ("article", "main", "body"):
            return i - 1
    return at


def blocks_of(page: str | None) -> tuple[list[str], list[int], bool]:
    """All text blocks of a page, what its markup says of each, and whether it marks its article."""
    parts = tokens(page or "")
    lines: list[str] = []
    kinds: list[int] = []
    piece: list[str] = []
    found, at = False, 0
    mains: list[str] = []

    def add(piece: list[str], kind: int) -> None:
        text = " ".join(entities.unescape("".join(piece)).split()) if piece else ""
        piece.clear()
        if text:
            lines.append(text)
            kinds.append(kind)

    def close() -> None:
        add(piece, MARKED if mains else LEFT_OPEN)

    def rule_out(inside: list[tuple]) -> None:
        rest: list[str] = []
        for name, _, _, before in inside:
            if before:
                rest.append(before)
            if name == "br":
                rest.append(" ")
            elif name in BLOCK:
                add(rest, RULED_OUT)
        add(rest, RULED_OUT)

    while at < len(parts):
        name, closing, attributes, before = parts[at]
        if before:
            piece.append(before)
        if name == "br":
            piece.append(" ")
        elif name in BLOCK or name == "":
            close()
        if name and name not in VOID and not closing:
            drop, main = (True, False) if name in RAW else role_of(name, attributes)
            if name == "header":
                drop = not mains  # an article's own header holds its title
            if main:
                close()
                found = True
                mains.append(name)
            elif drop:
                if name in RAW:  # its contents were left out; its end as well
                    at += 1
                    continue
                last = end_of(parts, at)
                holds = any(n and not c and n not in RAW and role_of(n, a)[1] for n, c, a, _ in parts[at + 1 : last + 1])
                if not holds and (name in BLOCK or last > at):  # what holds the article is entered
                    rule_out(parts[at + 1 : last + 1])
                    at = last + 1
                    continue
        elif closing and name in mains:
            close()
            while mains.pop() != name:
                pass
        at += 1
    close()
    if MARKED in kinds:  # then nothing beside it is the article
        kinds = [k if k == MARKED else RULED_OUT for k in kinds]
    return lines, kinds, found


def lines_of(page: str | None) -> tuple[list[str], bool]:
    """The text blocks of a page that its markup does not rule out, and whether it marks its article."""
    lines, kinds, found = blocks_of(page)
    return [x for x, kind in zip(lines, kinds, strict=True) if kind != RULED_OUT], found


def _lengths(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of mine with each prefix of other, a row at a time."""
    row = np.zeros(len(other) + 1, "i4")
    for x in mine:
        step = np.where(other == x, row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(np.maximum(step, row[1:]))
    return row


def shared(mine: list, other: list) -> set[int]:
    """Positions of mine on a longest common subsequence with other, in memory that grows with their lengths (Hirschberg, 1975)."""
    known = {x: i for i, x in enumerate(set(mine).intersection(other))}  # no other line is on any common subsequence
    if not known:
        return set()
    place = [i for i, x in enumerate(mine) if x in known]
    a, b = (np.array([known[x] for x in lines if x in known], "i8") for lines in (mine, other))
    out: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.add(i)
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            out.add(j - 1)
            j, m = j - 1, m - 1
        if i == j or k == m:
            continue
        if j - i == 1:
            if (b[k:m] == a[i]).any():
                out.add(i)
            continue
        half = (i + j) // 2
        cut = k + int((_lengths(a[i:half], b[k:m]) + _lengths(a[half:j][::-1], b[k:m][::-1])[::-1]).argmax())
        todo += [(i, half, k, cut), (half, j, cut, m)]
    return {place[i] for i in out}


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


#: Consecutive pages of a host that one group of the pairing holds.
RUN = 256


def key_of(line: str) -> int:
    """64 bits that stand for a line in the alignment: two different lines of a pair are taken for one with a probability of 2^-64."""
    return int.from_bytes(hashlib.blake2b(line.encode(), digest_size=8).digest(), "little", signed=True)


def page_key(host: str, path: str, lines: list[str], kinds: list[int]) -> bytes:
    """128 bits that stand for a url path with the lines that markup does not rule out."""
    body = "\n".join(x for x, kind in zip(lines, kinds, strict=True) if kind != RULED_OUT)
    return hashlib.blake2b(f"{len(host)} {len(path)} {host}{path}{body}".encode(), digest_size=16).digest()


def nearest(pages: DataFrame) -> DataFrame:
    """(_page, _near): the line keys of the nearest other page, null alone on a host; of pages (_page, _host, _path, _keys).

    The nearest page is the neighbour in the order of paths, of the two the one of the longer common prefix.
    Pages are ranked within their host without gathering a host in one task; a group holds RUN consecutive
    pages and one neighbour on either side.
    """
    place = ranked(pages.groupBy("_page", "_host", "_path").agg(F.min("_keys").alias("_keys")), ["_host"], ["_path", "_page"])
    run = F.floor(F.col("_rank") / RUN).cast("long")
    at = F.col("_rank") % RUN
    runs = F.array_compact(F.array(run, F.when((at == 0) & (run > 0), run - 1), F.when(at == RUN - 1, run + 1)))
    spread = place.select("_page", "_host", "_path", "_keys", "_rank", run.alias("_own"), F.explode(runs).alias("_run"))

    def pair(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_rank")
        pages, paths, keys, own, run_of = (list(part[c]) for c in ("_page", "_path", "_keys", "_own", "_run"))
        out = []
        for i in range(len(pages)):
            if own[i] == run_of[i]:
                beside = [j for j in (i - 1, i + 1) if 0 <= j < len(pages)]
                out.append((pages[i], keys[max(beside, key=lambda j: _common(paths[i], paths[j]))] if beside else None))
        return pd.DataFrame(out, columns=["_page", "_near"])

    return spread.groupBy("_host", "_run").applyInPandas(pair, "_page binary, _near array<long>")


def checked(lines: list[str], kinds: list[int], dropped: set[int]) -> tuple[str, int, int]:
    """The text that is left of a page whose lines at dropped were deleted, after the check; lines restored, lines removed by it."""
    text, restored, removed = [], 0, 0
    for i, (line, kind) in enumerate(zip(lines, kinds, strict=True)):
        if kind == RULED_OUT:
            removed += i not in dropped
        elif kind == MARKED or i not in dropped:
            restored += i in dropped
            text.append(line)
    return "\n".join(text), restored, removed


def main_text(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared, n_restored, n_removed) of every page.

    n_lines: all text lines; n_shared: those shared with the nearest page and so deleted; n_restored: of these,
    those that the check restored; n_removed: those that the check removed of the lines left.
    """

    def parse_keys(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            digests, keys = [], []
            for host, path, page in zip(*frame.columns[2:5], strict=True):
                lines, kinds, _ = blocks_of(page.as_py())
                digests.append(page_key(host.as_py(), path.as_py(), lines, kinds))
                keys.append([key_of(x) for x in lines])
            columns = [pa.array(digests, pa.binary()), frame.column(2), frame.column(3), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_page", "_host", "_path", "_keys"])

    def parse_lines(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            digests, texts, says = [], [], []
            for host, path, page in zip(*frame.columns[2:5], strict=True):
                lines, kinds, _ = blocks_of(page.as_py())
                digests.append(page_key(host.as_py(), path.as_py(), lines, kinds))
                texts.append("\n".join(lines))
                says.append(bytes(kinds))
            columns = [frame.column(0), frame.column(1), pa.array(digests, pa.binary()), pa.array(texts, pa.string()), pa.array(says, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "_page", "_lines", "_kinds"])

    def difference(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts, counts = [], []
            for joined, says, near in zip(*frame.columns[2:5], strict=True):
                kinds = list(says.as_py())
                lines = joined.as_py().split("\n") if kinds else []
                dropped = shared([key_of(x) for x in lines], near.as_py() or [])
                text, restored, removed = checked(lines, kinds, dropped)
                texts.append(text)
                counts.append((len(lines), len(dropped), restored, removed))
            numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            columns = [frame.column(0), frame.column(1), pa.array(texts, pa.string()), *numbers]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_lines", "n_shared", "n_restored", "n_removed"])

    base = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"), F.col(html).alias("html")
    )
    near = nearest(base.mapInArrow(lean(parse_keys), "_page binary, _host string, _path string, _keys array<long>"))
    whole = base.mapInArrow(lean(parse_lines), "page_id long, url string, _page binary, _lines string, _kinds binary")
    found = whole.join(near, "_page", "left").select("page_id", "url", "_lines", "_kinds", "_near")
    counted = found.mapInArrow(lean(difference), "page_id long, url string, text string, n_lines long, n_shared long, n_restored long, n_removed long")
    return counted.select(
        F.col("page_id").alias(key), "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_lines", "n_shared", "n_restored", "n_removed"
    )


def op9_html(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
