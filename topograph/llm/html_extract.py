"""Main text of HTML pages by minimum-cut labelling.

A page is cut into text blocks.  A linear classifier with fixed weights over tag ancestry, class and id names, length
and link share gives each block log-odds of being content; positive odds are the capacity of an edge from the
source (content), negative ones of an edge to the sink (boilerplate).  Smoothness edges join blocks that follow
each other and blocks with the same parent, the stronger the nearer in the DOM.  The minimum cut labels the
blocks; it is found exactly by fixing blocks whose terminal outweighs all their edges, folding those into their
neighbours' terminals, and a maximum flow over what is left.

Names (classes, ids, roles) are weak witnesses.  They are read by whole words; words after a modifier (has-, no-,
with-) don't count, and boilerplate words are void beside content words.  An element that holds the core of the
page is a wrapper, whose names and form tag don't count, nor does its tag if it is never closed: the core is the article or main element with most prose, else
the first heading, else an element with half of the page's prose (unless it is named for adverts or comments).

Null or empty html gives an empty text, as do pages without content; unclosed tags, cut-off pages and very long
pages are read whole, in time linear in their length: a tag ends at the first > outside quoted values, elements beyond
MAX_DEPTH are not nested further, and only script and style run to the end of the page when they are not closed.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from topograph.llm.common import pick

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
_BROKEN = re.compile(r"<[^<>]*+>?")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style")}
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_OPEN_VALUE = re.compile(r"=[^\s\"']*/\Z")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")

#: Elements without end tags, elements that begin no block, that end a paragraph, and that may stand in a head; fixed by HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_ENDS_P = frozenset("address article aside blockquote dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements whose text is not read.
_HIDDEN = frozenset("canvas head iframe noscript object script select style svg template textarea title".split())
#: Elements are nested no deeper.
MAX_DEPTH = 256

#: Weights of the classifier, in log-odds.
_TAGS = {"nav": -9, "footer": -9, "aside": -9, "form": -9, "button": -9, "menu": -9, "dialog": -9, "fieldset": -6, "header": -7, "article": 5, "main": 4, "h1": 2.5, "h2": 1.5, "h3": 1, "p": 1, "li": -0.5, "td": -0.3, "blockquote": 0.5, "pre": 0.5}
_BAD, _GOOD = -9.0, 2.0
_PRIOR, _PER_WORD, _MOST_WORDS, _LINKS, _CLOSED = -1.6, 0.08, 30, -4.0, 0.8
#: Smoothness: between neighbours, and between blocks of one parent; halved for each step between their parents.
_NEXT, _SIBLING = 0.8, 0.6
#: Prose: blocks of so many words, at most so much of them linked; a wrapper without article or heading holds so many words.
_PROSE_WORDS, _PROSE_LINKS, _WRAPPER_WORDS = 8, 0.3, 50

#: Words of names: of adverts and comments, of other boilerplate (also as the beginning of a longer word), of content, and modifiers.
_ADVERTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored comment comments reply replies discussion disqus respond "
    "werbung anzeige anzeigen kommentar kommentare antworten publicite commentaire commentaires publicidad anuncio anuncios comentario comentarios pubblicita annuncio commento commenti".split()
)
_BOILERPLATE = frozenset(
    "promo promos promotion banner cookie cookies consent gdpr notice notices alert menu menus nav navbar navigation breadcrumb breadcrumbs sidebar rail footer masthead share sharing social related recommended popup modal overlay subscribe subscription newsletter signup login search widget widgets pagination pager copyright complementary contentinfo toolbar "
    "hinweis hinweise fusszeile kopfzeile seitenleiste brotkrumen anmeldung suche teilen impressum pied entete barre partage recherche avis cabecera lateral compartir buscar aviso avisos navegacion piede intestazione cerca condividi avviso".split()
)
_STEMS = ("advert", "breadcrumb", "comment", "copyright", "disqus", "footer", "kommentar", "navbar", "navigation", "newsletter", "pagination", "seitenleiste", "sidebar", "sponsor", "subscri", "werbe")
_CONTENT = frozenset("article main post entry story content body text prose".split())
_MODIFIERS = frozenset("has no not non with without is hide hides hidden show shows enable disable js".split())


class _Node:
    __slots__ = ("tag", "up", "depth", "verdict", "advert", "hidden", "score", "prose", "wrapper", "closed")

    def __init__(self, tag: str, up: "_Node | None", verdict: int = 0, advert: bool = False):
        self.tag, self.up, self.depth, self.verdict, self.advert = tag, up, up.depth + 1 if up else 0, verdict, advert
        self.hidden = tag in _HIDDEN or (up is not None and up.hidden)
        self.score, self.prose, self.wrapper, self.closed = 0.0, 0, False, False


def name_verdict(names: str) -> tuple[int, bool]:
    """Names of an element -> -1 for boilerplate, 1 for content, 0; and whether a word of adverts or comments decides."""
    bad = good = advert = False
    for token in names.split():
        words = [w.lower() for w in _WORDS.findall(token)]
        if len(words) > 1 and words[0] in _MODIFIERS:
            continue
        stems = [any(w.startswith(s) for s in _STEMS) for w in words]
        bad |= any(w in _BOILERPLATE or w in _ADVERTS or s for w, s in zip(words, stems)) or words[:2] in (["site", "header"], ["page", "header"], ["skip", "link"])
        advert |= any(w in _ADVERTS or w.startswith(("advert", "comment", "kommentar", "sponsor", "werbe")) for w in words)
        good |= any(w in _CONTENT for w in words)
    if bad and not (good and not advert):
        return -1, advert
    return int(good and not bad), False


def _element(tag: str, attributes: str, up: _Node) -> _Node:
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if "=" in attributes else ""
    return _Node(tag, up, *(name_verdict(names) if names else ()))


def blocks(page: str) -> list[tuple[str, float, _Node]]:
    """Text blocks in page order: text, log-odds of content, parent."""
    here = _Node("", None)
    nodes, found = [here], []
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip(" ")
            if text:
                n, share = text.count(" ") + 1, min(1.0, linked / len(text))
                odds = _PRIOR + min(n, _MOST_WORDS) * _PER_WORD + _LINKS * share + _CLOSED * (text[-1] in ".!?…")
                box = here
                while box.up is not None and box.tag in _INLINE:
                    box = box.up
                box.prose += n if n >= _PROSE_WORDS and share <= _PROSE_LINKS else 0
                found.append((text, odds, box))
            parts.clear()
        linked = 0

    def read(piece: str) -> None:
        nonlocal linked
        if piece and not here.hidden:
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    at, text_from, size, broken = 0, 0, len(page), False
    while (lt := page.find("<", at)) >= 0:
        mark = page[lt + 1 : lt + 2]
        if mark in ("!", "?"):
            end = page.find("-->", lt + 4) + 3 if page.startswith("<!--", lt) else page.find(">", lt) + 1
            end = size if end < lt else end
            read(page[text_from:lt])
            at = text_from = end
            continue
        name = page[lt + 2 : lt + 3] if mark == "/" else mark
        if not (name.isascii() and name.isalpha()):
            if mark == "/":  # an end tag without a name is a comment
                read(page[text_from:lt])
                at = text_from = _BROKEN.match(page, lt).end()
            else:
                at = lt + 1
            continue
        read(page[text_from:lt])
        m = None if broken else _TAG.match(page, lt)
        if m is None:  # no such tag ends in the rest of the page: what is left of it is cut off
            broken = True
            at = text_from = (end := _BROKEN.match(page, lt)).end()
            m = _TAG.fullmatch(end[0] if end[0].endswith(">") else end[0] + ">")
            if m is None or (not end[0].endswith(">") and at == size):
                continue
        else:
            at = text_from = m.end()
        tag, attributes = m[1].lower(), m[2]
        if tag not in _INLINE:
            flush()
        if mark != "/":
            if tag in _VOID:
                continue
            if here.tag == "head" and tag not in _IN_HEAD:
                here = here.up
            if tag in _ENDS_P:
                node = here
                while node.up is not None and (node.tag in _INLINE or node.tag in ("p", "li" if tag == "li" else "p")):
                    if node.tag == "p" or node.tag == tag:
                        here = node.up
                        break
                    node = node.up
            links += tag == "a"
            if attributes.endswith("/") and not _OPEN_VALUE.search(attributes):
                continue
            if tag in _RAW_END:
                closing = _RAW_END[tag].search(page, at)
                at = text_from = closing.start() if closing else size
            if here.depth < MAX_DEPTH:
                here = _element(tag, attributes, here)
                nodes.append(here)
        else:
            if tag == "a":
                links = max(0, links - 1)
            node = here
            while node.up is not None and node.tag != tag:
                node = node.up
            if node.up is not None:
                node.closed, here = True, node.up
    read(page[text_from:])
    flush()
    _judge(nodes)
    return [(text, odds + max(-30.0, box.score), box) for text, odds, box in found]


def _judge(nodes: list[_Node]) -> None:
    """Scores of all elements, parents first: the weights of their tags and names, and of those around them."""
    for node in reversed(nodes):
        if node.up is not None:
            node.up.prose += node.prose
    # a menu that is never closed holds what follows it by mistake; at most MAX_DEPTH steps
    outside = lambda n: n.up is None or ((n.tag not in ("nav", "footer", "aside") or not n.closed) and outside(n.up))
    cores = [n for n in nodes if n.tag in ("article", "main") and not n.advert and n.prose and outside(n)]
    core = max(cores, key=lambda n: n.prose) if cores else next((n for n in nodes if n.tag == "h1" and not n.hidden), None) or next((n for n in nodes if n.tag == "h2" and not n.hidden), None)
    above = core.up if core is not None else None
    while above is not None:
        above.wrapper, above = True, above.up
    every = nodes[0].prose
    for node in nodes[1:]:
        if core is None and not node.advert and node.prose >= _WRAPPER_WORDS and 2 * node.prose > every:
            node.wrapper = True
        own = _TAGS.get(node.tag, 0.0)
        if (node.tag == "header" and node.up.score > 0) or (node.wrapper and (node.tag in ("form", "fieldset", "header") or not node.closed)):
            own = 0.0  # the heading of an article, not of the page; or what holds the whole page
        if node.verdict > 0:
            own += _GOOD
        elif node.verdict < 0 and not node.wrapper and node is not core and node.tag not in ("body", "html") and (node.advert or node.tag not in ("article", "main")):
            own += _BAD
        node.score = node.up.score + own


def _steps(a: _Node, b: _Node) -> int:
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a, n = a.up, n + 1
        else:
            b, n = b.up, n + 1
    return n


def smoothness(parents: list[_Node]) -> dict[tuple[int, int], float]:
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, node in enumerate(parents):
        if i:
            edges[i - 1, i] = _NEXT * 0.5 ** _steps(parents[i - 1], node)
        box = id(node.up or node)
        if box in last:
            edges[last[box], i] = edges.get((last[box], i), 0.0) + _SIBLING
        last[box] = i
    return edges


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut (the smallest such side)."""
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    odds, fixed = list(odds), [None] * n
    queue = deque(range(n))
    while queue:
        v = queue.popleft()
        if fixed[v] is None and abs(odds[v]) > sum(near[v].values()):
            fixed[v] = side = odds[v] > 0
            for u, w in near[v].items():
                odds[u] += w if side else -w
                del near[u][v]
                queue.append(u)
            near[v] = {}
    for start in range(n):  # what is left falls into parts without edges between them
        if fixed[start] is None:
            part, seen = [start], {start}
            for v in part:
                more = [u for u in near[v] if u not in seen]
                seen.update(more)
                part.extend(more)
            for v, side in zip(part, _flow_side(part, odds, near)):
                fixed[v] = side
    return [bool(x) for x in fixed]


def _flow_side(part: list[int], odds: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Maximum flow by blocking flows over shortest paths; the side that the source still reaches."""
    source, sink, least = -1, -2, 1e-12
    room: dict[int, dict[int, float]] = {source: {}, sink: {}} | {v: dict(near[v]) for v in part}
    for v in part:
        room[source][v], room[v][source] = max(odds[v], 0.0), 0.0
        room[v][sink], room[sink][v] = max(-odds[v], 0.0), 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            v = queue.popleft()
            for u, r in room[v].items():
                if r > least and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if sink not in level:
            return [v in level for v in part]
        ahead = {v: [u for u in room[v] if level.get(u, -1) == level[v] + 1] for v in level}
        path = [source]
        while path:
            v = path[-1]
            if v == sink:
                push = min(room[a][b] for a, b in zip(path, path[1:]))
                full = len(path)
                for i in range(len(path) - 2, -1, -1):
                    a, b = path[i], path[i + 1]
                    room[a][b] -= push
                    room[b][a] += push
                    if room[a][b] <= least:
                        full = i + 1
                del path[full:]
                continue
            options = ahead[v]
            while options and room[v][options[-1]] <= least:
                options.pop()
            if options:
                path.append(options[-1])
            else:
                path.pop()
                if path:
                    ahead[path[-1]].pop()


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    keep = minimum_cut([odds for _, odds, _ in found], smoothness([node for _, _, node in found]))
    return " ".join(text for (text, _, _), k in zip(found, keep) if k)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: identifier, url, text, n_chars."""
    slim = pick(pages, id_column, url_column, html_column)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_column, url_column, "text", "n_chars"])

    return slim.mapInArrow(run, f"{head}, text string, n_chars long")
