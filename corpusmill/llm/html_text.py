"""Main text of HTML pages by their line-block distribution (operator 5).

Markup is stripped first, with comments, scripts and raw-text elements. Every border of a block element begins a new line.
All lines that hold text go into the distribution, those of menus, adverts and footers too. A line weighs its length, or
nothing where it is mostly links. Markup only shifts weights: a line in an element that is boilerplate by tag, role, class
or id, or outside the article of a page that marks one, weighs a millionth; a line in a marked article weighs SURGE more.

Weights are summed over sliding windows, for the lines of each of these three places. A dive is where the sum falls to zero; a
run of lines between two dives surges if its weights reach the threshold, however short its lines are, and is kept. The
threshold is SURGE, or the page's strongest run if that is less, so a page of one short line keeps it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ready_workers
from .bpe import by_bytes

#: Lines in a window, and weight of a run that makes a surge.
WINDOW, SURGE = 4, 80
#: The share of links from which a line weighs nothing, and what lines of unlikely places are multiplied by.
LINK_SHARE, UNLIKELY = 0.6, 1e-6

# Element names of HTML, and words that name boilerplate in roles, classes and ids.
CODE = "script style".split()
RAW = "textarea iframe title xmp".split()
HIDDEN = frozenset([*RAW, *"head noscript template svg math object audio video canvas".split()])
IN_HEAD = HIDDEN - {"svg", "math", "object", "audio", "video", "canvas"} | frozenset("html base basefont bgsound link meta".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav aside footer form button select dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog form".split())
WORDS = frozenset(
    "ad ads adv adbox adsense banner breadcrumb breadcrumbs button buttons byline consent copyright cta disclaimer disqus gdpr login "
    "masthead menu menus modal nav navbar navigation notice notices notification overlay pager pagination popup promo promos "
    "promotion recommended related replies reply respond share sharing sidebar signup skip social subscribe tags toolbar topbar "
    "widget widgets".split()
)
STEMS = ("advert", "comment", "cookie", "footer", "newsletter", "sidebar", "sponsor", "header")
CLOSES_P = BLOCK - {"button", "option", "optgroup", "legend", "caption"}
ENDS = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}}
SAME = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}

ATTRS = r"""(?:"[^"]*"|'[^']*'|[^'">])*+"""
TOKEN = re.compile(
    rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<code>{'|'.join(CODE)})\b{ATTRS}>(?:.*?</(?P=code)\s*[^>]*>|.*\Z)|<(?P<raw>{'|'.join(RAW)})\b{ATTRS}>.*?</(?P=raw)\s*[^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>{ATTRS})>|<[/!?][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACE = re.compile(r"\s+")


def is_boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    """By tag, role, class or id. A header within an article is part of it."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attrs or "=" not in attrs or tag in ("html", "body", "main"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    names = [w.lower() for key in ("class", "id") for w in NAME.findall(found.get(key, ""))]
    if tag == "article" or in_article and tag in ("header", "hgroup", "h1", "h2", "h3"):
        return any(w.startswith("comment") for w in names)
    return any(w in WORDS or w.startswith(STEMS) for w in names)


def unclosed(tokens: list[re.Match]) -> set[int]:
    """Which start tags of hidden elements have no end tag."""
    waiting: dict[str, list[int]] = {}
    for k, m in enumerate(tokens):
        if (tag := (m["tag"] or "").lower()) in HIDDEN:
            own = waiting.setdefault(tag, [])
            if not m["end"]:
                own.append(k)
            elif own:
                own.pop()
    return {k for own in waiting.values() for k in own}


def lines_of(page: str, by_names: bool, shown: frozenset[str] = frozenset()) -> tuple[list[list], bool, str]:
    """Lines as [text, characters in links, inside an article, in boilerplate], whether an article holds text, and the
    boilerplate tag that holds most text. Elements whose tag is in shown aren't boilerplate. A hidden element without end tag ends with its
    parent, a head at the first content of the body; with "" in shown it holds nothing."""
    lines: list[list] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # (tag, boilerplate, article)
    skipped = articles = hidden = 0
    links = in_link = 0
    named = False
    lost: dict[str, int] = {}
    tokens = list(TOKEN.finditer(page))
    open_ended = unclosed(tokens)

    def flush() -> None:
        nonlocal links, named
        lines.append([SPACE.sub(" ", "".join(text)).strip(), links, articles > 0, named])
        text.clear()
        links, named = 0, False

    def pop(to: int) -> None:
        nonlocal skipped, articles, hidden
        while len(stack) > to:
            tag, bad, art = stack.pop()
            hidden -= tag in HIDDEN or not tag
            skipped -= bad
            articles -= art

    def close(names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Close the nearest open element of these names that is not beyond a stop."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return pop(k)
            if stack[k][0] in stop:
                return None

    def add(raw: str) -> None:
        nonlocal links, named
        if stack and stack[-1][0] == "head" and raw.strip():
            pop(len(stack) - 1)
        if raw and skipped and not hidden:
            outer = next(t for t, bad, _ in stack if bad)
            lost[outer] = lost.get(outer, 0) + len(raw.strip())
        if raw and not hidden:
            plain = html.unescape(raw)
            text.append(plain)
            named |= skipped > 0
            if in_link:
                links += len(plain.strip())

    at = 0
    for k, m in enumerate(tokens):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if not m["end"] and hidden and tag not in IN_HEAD:
            head = next((i for i, (t, _, _) in enumerate(stack) if t == "head"), None)
            if head is not None and not any(t for t, _, _ in stack[head + 1 :]):
                pop(head)
        if tag in HIDDEN:
            if m["end"]:
                close({tag}, set())
            elif not (k in open_ended and "" in shown or tag in ("svg", "math") and m["attrs"].endswith("/")):
                # without end tag it has no name, so that nothing stops there
                stack.append((tag if tag == "head" or k not in open_ended else "", True, False))
                skipped += 1
                hidden += 1
            continue
        sealed = any(t and t in HIDDEN for t, _, _ in stack) if hidden else False
        if sealed and (tag not in BLOCK or not m["end"]):
            if tag in BLOCK and tag not in VOID:
                stack.append((tag, False, False))
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            in_link = not m["end"]
        if tag not in BLOCK:
            continue
        if not sealed:
            flush()
        if m["end"]:
            if tag == "p":
                close({"p"}, BLOCK | HIDDEN - {"p"})
            else:
                close({tag}, ENDS.get(tag, {"article", "main"} if tag not in ("article", "main", "body", "html") else set()))
            if sealed and not hidden:
                flush()
            in_link = 0
            continue
        if tag in CLOSES_P:
            close({"p"}, BLOCK - {"p"})
        if tag in SAME:
            close(SAME[tag], ENDS[tag])
        if tag in VOID:
            continue
        article = tag in ("article", "main") or "articleBody" in m["attrs"]
        bad = tag not in shown and is_boilerplate(tag, m["attrs"] if by_names else "", articles > 0)
        stack.append((tag, bad, article and not bad))
        skipped += bad
        articles += article and not bad
    add(page[at:])
    flush()
    return lines, any(t and inside and not bad for t, _, inside, bad in lines), max(lost, key=lost.get, default="")


def runs(weights: list[float], window: int) -> list[tuple[int, int]]:
    """The runs [begin, end) of lines between two dives; lines without weight at their ends are cut off."""
    n = len(weights)
    held = [w > 0 for w in weights]
    total, sums = sum(held[:window]), []  # a window's sum is zero where none of its lines has weight
    for k in range(n):
        sums.append(total)
        total += (held[k + window] if k + window < n else 0) - held[k]
    out, k = [], 0
    while k < n:
        if not sums[k]:
            k += 1
            continue
        begin = k
        while not held[begin]:
            begin += 1
        while k < n and sums[k]:
            k += 1
        end = k
        while not held[end - 1]:
            end -= 1
        out.append((begin, end))
    return out


def keep(lines: list[list], marked: bool, window: int = WINDOW, surge: float = SURGE) -> list[bool]:
    """Which lines lie in a run that surges. Each of the three places has its own distribution, the threshold is one for all."""
    places: dict[tuple, list[int]] = {}
    weights = []
    for k, (t, links, inside, bad) in enumerate(lines):
        own = 0.0 if links > LINK_SHARE * len(t) else float(len(t))
        weights.append(own * UNLIKELY if bad or marked and not inside else own + surge if inside else own)
        places.setdefault((bad, inside and not bad), []).append(k)
    found = []
    for at in places.values():
        for begin, end in runs([weights[k] for k in at], window):
            found.append((sum(weights[k] for k in at[begin:end]), at[begin:end]))
    threshold = min(surge, max((s for s, _ in found), default=0))
    out = [False] * len(lines)
    for total, at in found:
        if total >= threshold:
            for k in at:
                out[k] = True
    return out


def extract(page: str | None) -> str:
    """The main text: kept blocks joined by newlines; empty if there are none."""
    if not page:
        return ""
    shown: frozenset[str] = frozenset()
    while True:
        lines, marked, _ = lines_of(page, True, shown)
        if any(t and not bad for t, _, _, bad in lines):
            break
        lines, marked, most = lines_of(page, False, shown)
        if any(t and not bad for t, _, _, bad in lines) or "" in shown and (not most or most in shown):
            break
        shown |= {most if "" in shown else ""}  # what holds all the text is no boilerplate
    lines = [line for line in lines if line[0]]
    return "\n".join(line[0] for line, k in zip(lines, keep(lines, marked)) if k)


def main_text(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The id columns, text and n_chars of every row. No shuffle, whole pages.

    Null and empty pages, and those without text, have the empty text; null ids and repeated rows are rows like others; an
    empty table gives no rows. Columns not named are left out; id columns mustn't be called text or n_chars.
    """
    ready_workers(pages.sparkSession)
    src = pages.select(*id_cols, F.col(html_col).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "_html", 8_000_000):
                texts = [extract(h) for h in part.column("_html").to_pylist()]
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in id_cols} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    out = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in id_cols)
    return src.mapInArrow(run, f"{out}, text string, n_chars bigint")
