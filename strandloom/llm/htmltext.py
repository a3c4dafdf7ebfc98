"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped by one scan over tags; block-level tags and <br> end a line. What remains of markup are weights: a line
counts its characters outside links times the weight of its class: ARTICLE inside an article or main element, 1 for plain
lines, APART inside parts that say what they are (navigation, header, footer, sidebar, form, advert, notice, comments).
Windows of WINDOW lines slide over the lines of each class, and their sums decide. A window is live if its sum is at least
DENSITY of its characters. A run of live windows is text if one of them surges, that is, reaches the bar: THRESHOLD, or
SHARE of the highest window of a heavier class, so that plain lines beside an article must hold a multiple of its text.
The surge point is the run's first line that is dense itself, the dive point its last one, and the lines between are
kept whole.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import common
from strandloom.session import ship

#: Lines in a window; characters by which a window surges; the part of its characters that a live window's sum has.
WINDOW, THRESHOLD, DENSITY = 3, 25, 0.5
#: Weights of characters inside an article and in parts that are none; the share of a heavier class's highest window that others must reach.
ARTICLE, APART, SHARE = 64.0, 0.01, 0.25

#: A comment, a declaration, an element whose content is not text, or a tag. Whatever is never closed runs to the end, so that no place is scanned twice.
ATTRIBUTES = r"""(?>=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+"""
MARK = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|template|iframe|textarea|select|title)\b{ATTRIBUTES}(?:>.*?(?:</\1\s*>|\Z)|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({ATTRIBUTES})(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)

#: Fixed values of HTML: elements that make lines of their own; those without content; those whose end tag may be left out, with what ends them.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center col dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CELLS = frozenset("td th table article body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"p": frozenset("p".split()), "li": frozenset("li".split()), "dd": frozenset("dd dt".split()), "dt": frozenset("dd dt".split()), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()), "th": frozenset("td th".split()), "option": frozenset("option".split())}
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())

#: Elements whose text is never the article's, and those whose text is not unless they stand inside it.
NEVER = frozenset("nav footer aside form button menu head".split())
OUTSIDE = frozenset("header dialog noscript label input".split())
#: Elements of which class, id and role are not read, and those of which only the class is.
SILENT = frozenset("html body h1 h2 h3 h4 h5 h6".split())
CLASSED = frozenset("p li dt dd td th a b i em strong span blockquote pre figcaption".split())
#: Words in class, id or role that mark a part of a page that is not its article.
ROLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|side-?bar|aside|complementary|contentinfo|cookies?|consent|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|trending|popular|tags|pagination|pager|comments?|commentlist|disqus|respond|replies|reply|widget|toolbar|search|skip|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
#: Marks that an article's own parts carry too, and words that say a part is the article's.
WEAK = re.compile(r"header|banner|toolbar|widget|search|menu|tags|legal|popular|skip", re.I)
OWN = re.compile(r"article|post|entry|content|story|main|body|text", re.I)
CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
SPACE = re.compile(r"\s+")


def lines(page: str) -> list[tuple[str, int, int]]:
    """The lines of a page in order: text, characters inside links, class (0 article, 1 plain, 2 apart)."""
    found, parts, linked = [], [], 0
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, apart, article
    places: dict[str, list[int]] = {}  # where the open elements of a name are
    blocks: list[int] = []  # where the open block-level elements are
    cells: list[int] = []  # where those are that an inline end tag doesn't reach across

    def end_line():
        nonlocal linked
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            _, apart, article = stack[-1] if stack else ("", False, False)
            found.append((text, min(linked, len(text)), 2 if apart else 0 if article else 1))
        parts.clear()
        linked = 0

    def close(to: int):
        while len(stack) > to:
            name = stack.pop()[0]
            places[name].pop()
            for open_ in (blocks, cells):
                if open_ and open_[-1] == len(stack):
                    open_.pop()

    at = 0
    for m in MARK.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if places.get("a"):
                linked += len(piece)
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            end_line()
        if m[2]:
            if (open_ := places.get(name)) and (name in BLOCKS or not cells or cells[-1] < open_[-1]):
                close(open_[-1])
            continue
        if name in VOID:
            continue
        if blocks and (stack[blocks[-1]][0] in ENDS.get(name, ()) or name in ENDS_P and stack[blocks[-1]][0] == "p"):
            close(blocks[-1])
        _, apart, article = stack[-1] if stack else ("", False, False)
        if not apart:
            apart = name in NEVER or name in OUTSIDE and not article
            if m[4] and not apart and name not in SILENT:
                words = " ".join(x for a in (CLASS if name in CLASSED else NAMED).findall(m[4]) for x in a if x).split()
                apart = any((mark := ROLE.search(w)) and not (WEAK.search(mark[0]) and (article or OWN.search(w))) for w in words) or bool(HIDDEN.search(m[4]))
        if not m[0].endswith("/>"):
            places.setdefault(name, []).append(len(stack))
            if name in BLOCKS:
                blocks.append(len(stack))
            if name in CELLS:
                cells.append(len(stack))
            stack.append((name, apart, article or name in ("article", "main")))
    if at < len(page):
        parts.append(page[at:])
    end_line()
    return found


def spans(chars: np.ndarray, weights: np.ndarray, bar: float, window: int = WINDOW) -> tuple[np.ndarray, float]:
    """Which lines of a class lie between a surge and the dive after it, and its highest sum of a live window."""
    inside = np.zeros(len(chars), bool)
    if not len(chars):
        return inside, 0.0
    sums, all_chars = (np.convolve(np.concatenate((x, np.zeros(window - 1))), np.ones(window), "valid") for x in (weights, chars))  # of each line and those after it
    live = sums >= DENSITY * all_chars
    edge = np.diff(np.concatenate(([False], live, [False])).astype(np.int8))
    dense = np.flatnonzero(weights >= DENSITY * chars)
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        own = dense[np.searchsorted(dense, a) : np.searchsorted(dense, b)]
        if len(own) and sums[a:b].max() >= bar:
            inside[own[0] : own[-1] + 1] = True
    return inside, float(sums[live].max(initial=0.0))


def main_text(page: str | None) -> str:
    """The main text of a page; empty if it has none."""
    found = lines(page or "")
    chars, linked, kind = (np.array([f(x) for x in found], np.float64) for f in (lambda x: len(x[0]), lambda x: x[1], lambda x: x[2]))
    keep, bar = np.zeros(len(found), bool), float(THRESHOLD)
    for k, weight in enumerate((ARTICLE, 1.0, APART)):
        at = np.flatnonzero(kind == k)
        of_class = weight * (chars[at] - linked[at] * (k > 0))  # an article's links are its text
        inside, highest = spans(chars[at], of_class, bar)
        keep[at[inside]], bar = True, max(bar, SHARE * highest)
    return "\n".join(line[0] for line, k in zip(found, keep.tolist(), strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """One row per row of pages: the identifier, the columns in keep, text, n_chars (its code points).

    A null or empty page, or one without a main text, gives an empty text. Character references are decoded, white space
    within a line becomes one space, lines are joined in order by a newline; <br> ends a line as a block does. Columns in
    keep may have any name but text and n_chars, which are refused. Pages of any length are read whole;
    repeated rows give repeated results; an empty table gives an empty result. Other columns are not read.
    """
    ship(pages.sparkSession)
    keep = keep or []
    if clash := {"text", "n_chars"} & {c.lower() for c in [id_col, *keep]}:
        raise ValueError(f"columns of the result: {sorted(clash)}")

    def run(batches):
        for batch in common.sliced(batches):
            texts = [main_text(page) for page in batch.column("html__").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*batch.schema.names[:-1], "text", "n_chars"])

    given = pages.select(id_col, *keep, F.col(html_col).alias("html__"))
    schema = ", ".join(f"`{c}` {t}" for c, t in given.dtypes[:-1])
    return given.mapInArrow(run, f"{schema}, text string, n_chars long")
