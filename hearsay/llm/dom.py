"""A forgiving reader of HTML into block elements and the text runs in them, and the features of these nodes."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# what HTML says about its elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead "
    "tr ul".split()
)
UNSEEN = frozenset("applet audio canvas datalist head iframe math noframes noscript object script select style svg template textarea title video".split())
RAW = frozenset("iframe noscript script style template textarea title".split())
IN_HEAD = frozenset("base bgsound link meta noscript script style template title".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tbody": frozenset(["tr", "td", "th", "tbody", "thead"]),
}
HELD_BY = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]),
           "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "tbody": frozenset(["table"])}

GROUPS = {
    name: i
    for i, names in enumerate((
        ("p",), ("li", "dd", "dt"), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("div",), ("section",), ("article",), ("main",), ("nav", "menu"),
        ("header", "hgroup"), ("footer",), ("aside",), ("form", "fieldset", "legend", "search", "dialog"), ("td", "th", "tr", "table", "tbody", "thead", "tfoot", "caption"),
        ("ul", "ol", "dl", "dir"), ("blockquote", "pre"), ("figure", "figcaption"), ("body", "html"), ("address", "details", "summary", "center"),
    ))
    for name in names
}
OTHER = max(GROUPS.values()) + 1
N_GROUPS = OTHER + 1
ABOVE = ("p", "li", "nav", "header", "footer", "aside", "form", "article", "main", "td", "figure")
TEXT_STATS = ("chars", "words", "link_chars", "sentences", "commas", "digits", "symbols", "closed", "inline", "controls", "images")


@dataclass
class Nodes:
    """Block elements and text runs of many pages, parents before children, as parallel lists."""

    page: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    group: list[int] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    stats: list[tuple] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)

    def add(self, page, parent, depth, group, attributes, text, stats, main):
        self.page.append(page)
        self.parent.append(parent)
        self.depth.append(depth)
        self.group.append(group)
        self.attributes.append(attributes)
        self.text.append(text)
        self.stats.append(stats)
        self.main.append(main)
        return len(self.page) - 1


NOTHING = (0,) * len(TEXT_STATS)


def _attributes(raw: str) -> str:
    """Class, id, role and the like as one string; words are taken from it once per distinct string."""
    if "=" not in raw and "hidden" not in raw:
        return ""
    kept = [a or b or c for name, a, b, c in ATTRIBUTE.findall(raw) if name.lower() in ("class", "id", "role", "itemprop", "aria-label")]
    low = raw.lower()
    if "display:none" in low.replace(" ", "") or re.search(r"\shidden(\s|=|$)", low):
        kept.append("hidden")
    return " ".join(kept)


def attribute_words(attributes: str) -> frozenset[str]:
    return frozenset(w.lower() for w in WORD.findall(attributes) if len(w) > 1)


def read(page: int, source: str | None, nodes: Nodes) -> None:
    """Append the nodes of one page. A page without a tag is one run of text; nothing visible leaves the root alone.

    A head ends with its end tag, or where text or a tag stands that no head may hold. Other unseen elements end with theirs; they end early where a block
    around them does, and hide nothing if the page has no end tag for them.
    """
    source = source or ""
    root = nodes.add(page, -1, 0, GROUPS["html"], "", None, NOTHING, False)
    stack = [("html", root, False)]
    run: list[str] = []
    link = inline = controls = images = 0
    link_chars = 0
    unseen: list[str] = []
    hidden: list[str] = []  # blocks opened within what is unseen
    ends: dict[str, int] = {}  # where the next end tag of a name was found

    def ended_later(name: str, at: int) -> bool:
        if ends.get(name, -1) < at:
            over = re.compile(f"</{re.escape(name)}(?![a-z0-9-])", re.I).search(source, at)
            ends[name] = over.start() if over else len(source) + 1
        return ends[name] <= len(source)

    def flush() -> None:
        nonlocal run, link_chars, inline, controls, images
        if run or controls or images:
            text = "".join(run)
            if "&" in text:
                text = html.unescape(text)
            parts = text.split()
            if parts or controls or images:
                name, parent, main = stack[-1]
                text = " ".join(parts)
                count = text.count
                stats = (
                    len(text), len(parts), min(link_chars, len(text)), count(". ") + count("! ") + count("? ") + 1 if parts else 0, count(","),
                    sum(map(count, "0123456789")), sum(map(count, "|/»›©@·•<>=_")), int(text[-1:] in tuple('.!?:;"»”')) if parts else 0,
                    inline, controls, images,
                )
                nodes.add(page, parent, nodes.depth[parent] + 1, nodes.group[parent], "", text, stats, main)
        run, link_chars, inline, controls, images = [], 0, 0, 0, 0

    def close_to(size: int) -> None:
        flush()
        del stack[size:]

    at, end = 0, len(source)
    while at < end:
        m = TAG.search(source, at)
        text = source[at : m.start()] if m else source[at:]
        if text and unseen == ["head"] and not text.isspace():
            unseen.clear()
        if text and not unseen:
            run.append(text)
            if link:
                link_chars += len(text)
        if m is None:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        closing, name, raw = (m[1] or m[4]) == "/", name.lower(), (m[3] or m[6] or "")
        if unseen == ["head"] and name not in IN_HEAD and name not in ("head", "html"):
            unseen.clear()
        if name in UNSEEN:
            if closing:
                if name in unseen:
                    del unseen[len(unseen) - 1 - unseen[::-1].index(name) :]
                    hidden.clear()
            elif name in ("noscript", "template") and not ended_later(name, at):
                pass
            elif not raw.endswith("/") and name in RAW:
                over = re.compile(f"</{re.escape(name)}", re.I).search(source, at)
                at = over.start() if over else end
                if over:
                    close = source.find(">", at)
                    at = close + 1 if close >= 0 else end
            elif not raw.endswith("/") and (name == "head" or ended_later(name, at)):
                unseen.append(name)
            if name in ("select", "textarea"):
                controls += not closing
            continue
        if unseen:
            if name == "body":
                unseen.clear()
            elif name not in BLOCK:
                continue
            elif not closing:
                hidden.append(name)
                continue
            elif name in hidden:
                del hidden[len(hidden) - 1 - hidden[::-1].index(name) :]
                continue
            elif any(name == above for above, _, _ in stack):
                unseen.clear()  # a block around it ends
            else:
                continue
            hidden.clear()
        if name in BLOCK or "-" in name:
            if name == "hr":
                flush()
                continue
            if closing:
                size = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                if size:
                    close_to(size)
                else:
                    flush()
                continue
            if name in ("html", "body") and len(stack) > 1:
                continue
            flush()
            if stack[-1][0] == "p":
                close_to(len(stack) - 1)
            elif name in CLOSED_BY:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in HELD_BY[name]:
                        break
                    if stack[i][0] in CLOSED_BY[name]:
                        close_to(i)
                        break
            parent = stack[-1][1]
            main = stack[-1][2]
            if "data-main" in raw:  # only in pages made for training
                main = 'data-main="1"' in raw
            node = nodes.add(page, parent, nodes.depth[parent] + 1, GROUPS.get(name, OTHER), _attributes(raw), None, NOTHING, main)
            if not raw.endswith("/"):
                stack.append((name, node, main))
        elif name == "a":
            link = not closing
        elif name == "br":
            run.append(" ")
        elif name in ("input", "button", "label"):
            controls += not closing
        elif name == "img":
            images += 1
        elif not closing:
            inline += 1
    close_to(1)
    flush()


class Features:
    """Numbers of every node: own and subtree text, tags above, attribute words, depth, place and siblings."""

    def __init__(self, words: dict[str, float]):
        self.words, self.seen = words, {"": (0.0, 0.0, 0.0)}

    def _score(self, attributes: str) -> tuple[float, float, float]:
        found = self.seen.get(attributes)
        if found is None:
            values = [self.words[w] for w in attribute_words(attributes) if w in self.words]
            found = (max([0.0, *values]), min([0.0, *values]), sum(values))
            if len(self.seen) > 50_000:
                self.seen = {"": (0.0, 0.0, 0.0)}
            self.seen[attributes] = found
        return found

    def of(self, nodes: Nodes) -> np.ndarray:
        n = len(nodes.page)
        page, parent, depth, group = (np.array(v, dtype=np.int64) for v in (nodes.page, nodes.parent, nodes.depth, nodes.group))
        own = np.array(nodes.stats, dtype=np.float64).reshape(n, len(TEXT_STATS))
        leaf = np.array([t is not None for t in nodes.text])
        score = np.array([self._score(a) for a in nodes.attributes]).reshape(n, 3)
        up = np.maximum(parent, 0)
        levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)] if n else []

        sub = np.column_stack([own, np.ones(n), group == GROUPS["p"], group == GROUPS["li"], leaf]).astype(np.float64)
        for rows in reversed(levels[1:]):
            np.add.at(sub, parent[rows], sub[rows])
        flags = np.column_stack([group == GROUPS[name] for name in ABOVE]) & ~leaf[:, None]
        above = np.zeros((n, len(ABOVE)), dtype=bool)
        lowest, highest = score[:, 1].copy(), score[:, 0].copy()
        for rows in levels[1:]:
            above[rows] = above[up[rows]] | flags[up[rows]]
            lowest[rows] = np.minimum(lowest[rows], lowest[up[rows]])
            highest[rows] = np.maximum(highest[rows], highest[up[rows]])

        # siblings in page order: sorted by parent, then number
        order = np.lexsort((np.arange(n), parent * (depth > 0) + (page * -1 - 1) * (depth == 0)))
        key = np.where(depth > 0, parent, -page - 1)[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, dtype=np.int64)
        size = np.diff(np.r_[first, n])
        rank, total = np.empty(n), np.empty(n)
        rank[order] = np.arange(n) - np.repeat(first, size)
        total[order] = np.repeat(size, size)
        density = sub[:, 2] / (sub[:, 0] + 1)
        same = np.r_[False, key[1:] == key[:-1]] if n else np.zeros(0, dtype=bool)

        def neighbour(values: np.ndarray, step: int) -> np.ndarray:
            ordered, out = values[order], np.full(n, -1.0)
            moved = np.full(n, -1.0)
            if step > 0 and n:
                moved[1:] = np.where(same[1:], ordered[:-1], -1)
            elif n:
                moved[:-1] = np.where(same[1:], ordered[1:], -1)
            out[order] = moved
            return out

        length = np.log1p(sub[:, 0])
        mean = np.zeros(n)
        if n:
            mean[order] = np.repeat(np.add.reduceat(length[order], first) / size, size)
        root_of = np.full(int(page.max()) + 1 if n else 0, 0)
        root_of[page[depth == 0]] = np.flatnonzero(depth == 0)
        root = root_of[page] if n else np.zeros(0, dtype=np.int64)
        whole = sub[root, 0] + 1 if n else np.zeros(0)
        running = np.cumsum(own[:, 0]) - own[:, 0]
        before = (running - running[root]) / whole if n else running
        words = sub[:, 1] + 1
        hot = np.eye(N_GROUPS)[group]
        return np.column_stack([
            leaf, depth, hot, score, lowest, highest, above, np.log1p(own[:, 0]), length, np.log1p(sub[:, 1]),
            density, sub[:, 3] / words, sub[:, 4] / words, sub[:, 5] / (sub[:, 0] + 1), sub[:, 6] / words, sub[:, 7] / (sub[:, -1] + 1),
            sub[:, 8] / words, sub[:, 9], np.log1p(sub[:, 9]) / np.log1p(words), sub[:, 10], sub[:, 11] / words, sub[:, 12], sub[:, 13], sub[:, 0] / words,
            sub[:, 0] / (sub[:, -1] + 1), rank, total, rank / total, mean,
            neighbour(length, 1), neighbour(length, -1), neighbour(density, 1), neighbour(density, -1),
            neighbour(score[:, 2], 1), before, sub[:, 0] / whole, density[up], length[up], np.log1p(whole),
        ]).astype(np.float32)
