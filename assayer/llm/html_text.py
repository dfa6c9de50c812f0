"""The main text of web pages, by scoring the tree of each page.

Every paragraph has points for its length and its commas, less the share of its text that is links. It passes them to its
ancestors: all to its parent, half to the next, and ever less further up. The container with the most points, discounted by
its own link density, is the heart of the article. The article reaches up from there to the <article> or <main> that it stands
in, or as long as a container has no other prose; what else stands in there belongs to it unless it is mostly links. Around it,
siblings that have a fair part of its points belong to it, and where nothing marks the article also headings, lists, tables
and short blocks. A class or id that tells of menus and the like takes a node out, unless that holds most of the page's points or is a
heading or a paragraph of prose; a form goes unless it holds most of them.

Reading a page takes time in proportion to its length, whatever is left open or unmatched in it: where a tag ends is worked out for all
quotes and brackets from the page's end on, and the open elements of each kind are kept as lists.
"""

from __future__ import annotations

import bisect
import html as references
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what they are.
_RAW = "script style noscript template iframe svg math object textarea title select canvas audio video"
_GONE = frozenset((_RAW + " head nav footer aside button dialog menu").split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address header details summary hr center fieldset".split())
_CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
_HOLDS = {"li": frozenset(["ul", "ol"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"])}
_ASIDE = re.compile(
    r"(?:^|[\s_-])(?<!\bhas[_-])(?<!\bwith[_-])(?<!\bno[_-])(?<!\bwithout[_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menus?|breadcrumbs?|header|masthead|footer|sidebar|side-bar|widgets?|cookies?|consent|gdpr|notices?|alert|popup|pop-up|modal|overlay|subscribe|subscription"
    r"|newsletter|signup|sign-up|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|respond|replies|pagination|pager|toolbar|copyright|legal|disclaimer|skip-link|search|complementary|navigation|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: A head's class, which inside an article tells of the article's own head.
_HEADER = re.compile(r"(?<![^\s_-])(?:header|masthead)(?![^\s_-])", re.I)
_TALK = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|replies)(?:$|[\s_-])", re.I)
_MAIN = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|main|post|story|body|text)(?:$|[\s_-])", re.I)

_HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that are no prose of their own, and those that stand beside prose as parts of it.
_MINOR = _HEADS | frozenset("li dt dd td th caption figcaption pre".split())
_BESIDE = frozenset("p ul ol dl table figure pre blockquote".split())

_MARK = re.compile(r"[>\"']")
_NAME = re.compile(r"</?([a-zA-Z])")
_NAME_END = re.compile(r"[\s/>]")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)


def _ends(source: str) -> tuple[list[int], list[int]]:
    """The places of brackets and quotes, and for each the place of the bracket that ends a tag which is outside quotes there, or -1."""
    marks = [m.start() for m in _MARK.finditer(source)]
    ends, following = [-1] * (len(marks) + 1), {'"': -1, "'": -1}
    for i in range(len(marks) - 1, -1, -1):
        mark = source[marks[i]]
        if mark == ">":
            ends[i] = marks[i]
        else:
            if following[mark] >= 0:
                ends[i] = ends[following[mark] + 1]
            following[mark] = i
    return marks, ends


def _tags(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Comments, declarations and tags in order: start, end, whether it closes, name (empty unless a tag), and what follows the name.

    What isn't complete is text; an open comment runs to the end. The caller may send the place to go on from.
    """
    marks, ends = _ends(source)
    last, name_end, at = source.rfind(">"), -1, 0
    while (start := source.find("<", at)) >= 0:
        if start > last:
            start = source.find("<!--", start)
            if start >= 0:
                yield start, len(source), False, "", ""
            return
        at = start + 1
        if source.startswith("<!--", start):
            end = source.find("-->", at)
            found = start, end + 3 if end >= 0 else len(source), False, "", ""
        elif source[at : at + 1] in ("!", "?"):
            found = start, source.find(">", at) + 1, False, "", ""
        elif name := _NAME.match(source, start):
            begin = name.start(1)
            if name_end < begin:
                name_end = _NAME_END.search(source, begin).start()
            end = ends[bisect.bisect_left(marks, name_end)]
            if end < 0:
                continue
            found = start, end + 1, begin > start + 1, source[begin:name_end], source[name_end:end]
        else:
            continue
        at = (yield found) or found[1]


class Page:
    """Nodes in page order with their parents, and the texts and block edges between them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.hint, self.gone = ["html"], [0], [0.0], [False]
        #: Nodes that their class or id takes out of the text, those of them that are comments, and forms.
        self.aside, self.talk, self.form = [False], [False], [False]
        #: (node, text), or (node, None) at the edge of a block.
        self.events: list[tuple[int, str | None]] = []
        #: The open nodes, and the places in there of those of each name and of all blocks.
        self.stack, self.open, self.blocks = [0], defaultdict(list), []
        at, tags, go_on = 0, _tags(source), None
        while True:
            try:
                start, end, closing, name, rest = tags.send(go_on)
            except StopIteration:
                break
            go_on = None
            if start > at:
                self.events.append((self.stack[-1], source[at:start]))
            at, name = end, name.lower()
            if not name:
                continue
            if closing:
                self._close(name)
            elif name in _VOID:
                self.events.append((self.stack[-1], None if name == "hr" else " " if name == "br" else ""))
            else:
                self._open(name, rest)
                if name in _RAW.split() and not rest.rstrip().endswith("/"):
                    over = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                    at = go_on = over.end() if over else len(source)
                    self._cut(len(self.stack) - 1)
        if at < len(source):
            self.events.append((self.stack[-1], source[at:]))

    def _cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            name = self.tag[self.stack.pop()]
            self.open[name].pop()
            if name in _BLOCK:
                self.blocks.pop()

    def _open(self, name: str, attributes: str) -> None:
        last = lambda names: max((self.open[x][-1] for x in names if self.open[x]), default=0)
        if name in _BLOCK:
            closes = last(_CLOSES.get(name, frozenset()) | {"p"})
            holds = max(last(_HOLDS.get(name, frozenset())), self.blocks[-1] if self.blocks and name not in _HOLDS else 0)
            if closes and closes >= holds:
                self._cut(closes)
        parent = self.stack[-1]
        words = " ".join(next(filter(None, m.groups()[1:]), "") for m in _ATTRIBUTE.finditer(attributes)) if attributes else ""
        outer, inside = name in ("html", "body", "article", "main"), bool(self.open["article"])
        within = name == "header" and not inside
        self.tag.append(name)
        self.parent.append(parent)
        self.hint.append(25.0 * (name in ("article", "main") or bool(words and _MAIN.search(words))))
        self.gone.append(self.gone[parent] or name in _GONE or within or bool(attributes and _HIDDEN.search(attributes)))
        self.form.append(name == "form")
        self.aside.append(name == "form" or not outer and name not in _HEADS and bool(words and (_ASIDE.search(_HEADER.sub(" ", words) if inside else words))))
        self.talk.append(self.talk[parent] or self.aside[-1] and bool(_TALK.search(words)))
        self.open[name].append(len(self.stack))
        if name in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(len(self.tag) - 1)
        if name in _BLOCK:
            self.events.append((self.stack[-1], None))

    def _close(self, name: str) -> None:
        if self.open[name]:
            self._cut(self.open[name][-1])
        if name in _BLOCK:
            self.events.append((self.stack[-1], None))

    def _taken_out(self, points: list[float], prose: list[bool]) -> list[bool]:
        """Which nodes are gone, by what they are or by their class; ``points`` are those of each block's own text, ``prose`` are paragraphs
        that no class takes out."""
        n = len(self.tag)
        if sum(x for x, talk in zip(points, self.talk) if not talk) >= 3:
            points = [0.0 if talk else x for x, talk in zip(points, self.talk)]  # comments on something are not it, however long
        held = list(points)
        for k in range(n - 1, 0, -1):
            held[self.parent[k]] += held[k]
        aside = [x and not (prose[k] or self.form[k] and 2 * held[k] > held[0]) for k, x in enumerate(self.aside)]
        marked, told = list(aside), False
        for k in range(1, n):
            marked[k] = marked[k] or marked[self.parent[k]]
            told = told or not marked[k] and self.tag[k] in ("article", "main") and held[k] > 0
        gone = list(self.gone)
        for k in range(1, n):
            gone[k] = gone[k] or gone[self.parent[k]] or aside[k] and (told or 2 * held[k] <= held[0])
        return self.gone if held[0] and not any(x and not g for x, g in zip(points, gone)) else gone

    def article(self) -> list[bool]:
        """Which nodes belong to the article."""
        n = len(self.tag)
        block, link = [0] * n, [False] * n
        for k in range(1, n):
            block[k] = k if self.tag[k] in _BLOCK else block[self.parent[k]]
            link[k] = link[self.parent[k]] or self.tag[k] == "a"
        gone = self.gone
        for again in (False, True):
            length, linked, commas = [0] * n, [0] * n, [0] * n
            for k, text in self.events:
                if text and not gone[k] and (size := len(text.strip())):
                    b = block[k]
                    length[b] += size
                    linked[b] += size * link[k]
                    commas[b] += text.count(",") + text.count("，") + text.count("、") + text.count("،")
            points = [(1 + commas[k] + min(length[k] / 100, 3)) * (1 - linked[k] / length[k]) if length[k] and self.tag[k] not in _HEADS else 0.0 for k in range(n)]
            if again or not any(self.aside):
                break
            gone = self._taken_out(points, [self.tag[k] == "p" and length[k] > 80 and linked[k] < 0.25 * length[k] and not self.talk[k] for k in range(n)])
        score, all_length, all_linked = list(self.hint), list(length), list(linked)
        prose = [length[k] * (length[k] > 80 and linked[k] < 0.5 * length[k] and self.tag[k] not in _MINOR) for k in range(n)]
        for k in range(n - 1, 0, -1):
            for x in (all_length, all_linked, prose):
                x[self.parent[k]] += x[k]
        for k in range(1, n):
            if length[k] and self.tag[k] not in _HEADS:
                if self.tag[k] in ("div", "article", "main", "section", "body"):
                    score[k] += points[k]  # text that stands in the container itself
                up, share = self.parent[k], 1.0
                for level in range(1, 6):
                    score[up] += points[k] * share
                    if up == 0:
                        break
                    up, share = self.parent[up], 0.5 if level == 1 else 1 / (3 * level)
        final = [s * (1 - all_linked[k] / all_length[k]) if all_length[k] and not gone[k] else 0.0 for k, s in enumerate(score)]
        best = max(range(n), key=lambda k: (final[k], -k))
        dense = [2 * all_linked[k] > all_length[k] for k in range(n)]

        above = [best]
        while above[-1]:
            above.append(self.parent[above[-1]])
        told = next((k for tag in ("article", "main") for k in above if self.tag[k] == tag), 0)
        path = {best}
        top = best
        while top and top != told:
            up = self.parent[top]
            if not told and (up == 0 or self.tag[up] in ("html", "body") or prose[up] > prose[top]):
                break
            path.add(top := up)

        chosen = set()
        beside = [k for k in range(1, n) if top and k != top and self.parent[k] == self.parent[top] and not gone[k]]
        headed = {self.parent[k] for k in range(1, n) if self.tag[k] in _HEADS and length[k]}  # from inner to outer nodes
        holds = [self.tag[k] in _BESIDE for k in range(n)]
        for k in range(n - 1, 0, -1):
            holds[self.parent[k]] |= holds[k] and not gone[k]
            if k in headed:
                headed.add(self.parent[k])
        for k, following in zip(beside, [*beside[1:], None]):
            fair = final[k] - self.hint[k] * 0.8 >= 0.2 * final[top] > 0
            if fair or self.tag[k] == "p" and length[k] > 80 and linked[k] < 0.25 * length[k]:
                chosen.add(k)
            elif self.tag[k] in _HEADS:
                if not dense[k] and (k < top and top not in headed if told else k < top or following is None or not dense[following]):
                    chosen.add(k)
            elif not told and not dense[k] and self.tag[k] in _BLOCK and self.tag[k] not in ("article", "main"):
                if holds[k] or k in headed or self.tag[self.parent[k]] not in ("html", "body"):
                    chosen.add(k)
        keep = [best == 0] + [False] * (n - 1)
        for k in range(1, n):
            up = self.parent[k]
            if k in path or k in chosen:
                keep[k] = not gone[k]
            elif up in path and up != best:
                # Words between tags go with the line they stand in.
                keep[k] = not gone[k] and not (dense[k] and (self.tag[k] in _BLOCK or 2 * linked[block[up]] > length[block[up]]))
            else:
                keep[k] = keep[up] and not gone[k]
        return keep

    def text(self) -> str:
        keep, blocks, parts = self.article(), [], []
        for k, text in [*self.events, (0, None)]:
            if text is None:
                if line := " ".join(references.unescape("".join(parts)).split()):
                    blocks.append(line)
                parts = []
            elif keep[k]:
                parts.append(text)
        return "\n".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Page(h).text() if h else "" for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``id, url, text, n_chars``.

    ``text`` is the article's blocks in page order, one a line, their white space made one space and their character references
    decoded. A null or empty page, or one without text outside of menus and the like, has an empty text. Markup may be broken.
    Repeated rows count each for itself. Other columns of ``pages`` are not read.
    """
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(_extract, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id, "url": url})
