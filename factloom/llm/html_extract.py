"""Main text of web pages by composite text density.

A tolerant scan builds the DOM. Menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are taken out by element, role or name; a name counts only if it doesn't stand on the article
(see drop_named). Every node left has a composite text density: characters
per tag, adjusted by the share of link characters and link tags. Children's densities are summed at each node; the
node of the largest sum holds the article, and the least density on its path to the body is the threshold. Nodes
that reach it mark, in their subtree, the node of the largest sum as content. The article is the smallest subtree
that holds the marked nodes, or the article or main element around it; if the densest one is in such an element, those
outside don't count. The page's first-level heading belongs to it, with what stands between unless that is a menu.
A form is left out if it is made of controls, not if it wraps the page or its article.

Defined cases: a null html counts as empty; a page without text gives an empty text; unclosed and misplaced tags are
read as browsers read them, roughly: a tag, or a quoted value in it, that never ends takes the rest of the page; svg
is left out and math is text, both nest and may be self-closed; repeated rows give repeated rows, null ids and
addresses stay and ids may be of any type; other columns are left out. Nesting of any depth is handled without
recursion, and the time is in proportion to the page's length whatever its tags.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import bounded

#: Element names of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption li dd dt summary".split())
FOREIGN = frozenset({"svg", "math"})
#: HTML elements whose start tag ends an open svg or math, unless one of INTEGRATION stands between.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: Elements of RAW that show their content or hold other elements, so that a missing end tag doesn't make the rest theirs.
ONLY_TAG = frozenset({"noscript"})
#: Elements that end an open one of their kind, up to the element that bounds them.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
DROPPED = frozenset("nav footer aside head menu dialog button select object embed applet search svg annotation annotation-xml".split()) | RAW
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar".split())
#: Words of a class or id that name something other than the article.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion sidebar menu navbar nav navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices banner popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist respond disqus replies share sharing social related recommended pagination pager toolbar widget skip".split()
)
#: Of these the ones an article may be about: an element that is also named as content is judged by its density.
SUBJECTS = frozenset("ad ads advert adverts advertisement advertisements banner comment comments consent cookie cookies gdpr modal newsletter notice notices promo related share sharing social sponsor sponsored subscription widget".split())
CONTENT_NAMES = frozenset("article content entry main post story text".split())
#: Elements that a reader fills in, and what stands beside them.
CONTROLS, LABELS = frozenset("button select textarea".split()), frozenset("label legend option".split())
#: Characters of text for each control from which a form is more than a form.
FORM_TEXT = 60
#: Share of link characters from which what stands between a heading and the article is a menu.
MENU_LINKS = 0.3
#: Share of a page's characters below which its article element isn't its article.
THIN = 0.2
SPACES = re.compile(r"[^\S\x1c-\x1f]+")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: An attribute and what stands before it; quotes count only where a value begins. Possessive, so nothing is read again.
ATTRIBUTE = re.compile(r"[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(\"?+)|'([^']*+)('?+)|([^\s>\"'][^\s>]*+)?+))?+)?+")
#: Words after which a name still tells of the word before them, as in comment-list; and first words that tell of another element.
STRUCTURE = frozenset("area bar block body box col column container content group holder inner item items left link links list outer panel region right row section slot thread top bottom unit wrap wrapper".split())
OTHERS = frozenset({"has", "no", "with"})
#: Elements of running text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figure figcaption b i em strong span a".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Dom:
    """Nodes in page order; node 0 is the body. Texts are (node, text) pairs and block marks (node, None)."""

    def __init__(self) -> None:
        self.tag, self.parent, self.dropped, self.foreign, self.article = ["body"], [-1], [False], [False], [False]
        self.named: dict[int, int] = {}
        self.controls: dict[int, int] = {}
        self.texts: list[tuple[int, str | None]] = []

    def add(self, tag: str, parent: int, dropped: bool) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.dropped.append(dropped or self.dropped[parent])
        self.foreign.append(self.foreign[parent] or self.tag[parent] in FOREIGN)
        self.article.append(self.article[parent] or self.tag[parent] in {"article", "main"})
        return len(self.tag) - 1


class Stack:
    """Open elements, with the places of each tag and of the blocks among them, so that none is searched for."""

    def __init__(self, dom: Dom) -> None:
        self.dom, self.nodes = dom, [0]
        self.where: dict[str, list[int]] = {}

    def push(self, node: int) -> None:
        for key in self.keys(node):
            self.where.setdefault(key, []).append(len(self.nodes))
        self.nodes.append(node)

    def keys(self, node: int) -> list[str]:
        tag = self.dom.tag[node]
        keys = [tag]
        if tag in BLOCK and tag != "p":
            keys.append("#block")
        if tag in INTEGRATION:
            keys.append("#integration")
        if tag in FOREIGN and not self.dom.foreign[node]:
            keys.append("#foreign")
        return keys

    def last(self, *keys: str) -> int:
        """The place of the last open element of these, 0 if there is none."""
        return max([self.where[k][-1] for k in keys if self.where.get(k)], default=0)

    def cut(self, place: int) -> None:
        """Ends the elements from a place on."""
        while len(self.nodes) > place:
            for key in self.keys(self.nodes.pop()):
                self.where[key].pop()

    def close(self, tag: str) -> None:
        place = self.last(tag)
        if place:
            if tag in BLOCK:
                self.dom.texts.append((self.nodes[-1], None))
            self.cut(place)

    def end(self, tags: set, bounds: set) -> None:
        """Ends an open element of the tags, unless a bound stands between."""
        place = self.last(*tags)
        if place and place > self.last(*bounds):
            self.dom.texts.append((self.nodes[-1], None))
            self.cut(place)

    def break_out(self) -> bool:
        """Ends the open svg or math; whether the place is inside foreign content still."""
        inner, outer = self.last("#integration"), self.last("#foreign")
        if inner > outer:
            return True
        if outer:
            self.cut(outer)
        return False


def boilerplate(dom: Dom, tag: str, attributes: list[tuple[str, str]], parent: int) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header" and not (dom.article[parent] or dom.tag[parent] in {"article", "main"} or of_content(attributes)):
        return True
    if not attributes or tag in {"body", "html", "article", "main"}:
        return False
    for name, value in attributes:
        if name == "hidden" and not value or name == "aria-hidden" and value == "true" and tag != "span":
            return True
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True
    return False


def of_content(attributes: list[tuple[str, str]]) -> bool:
    """Whether a class or id begins with a word for an article's content, as entry-header."""
    return any(key in {"class", "id"} and any((w := WORD.findall(name)) and w[0].lower() in CONTENT_NAMES for name in value.split()) for key, value in attributes)


def named(tag: str, attributes: list[tuple[str, str]]) -> int:
    """What a class or id says: 0 nothing, 1 a word of boilerplate among others, 2 that the element is boilerplate.

    A word among others says nothing of a paragraph, heading or the like.
    """
    most = 0
    content = any(key in {"class", "id"} and CONTENT_NAMES.intersection(value.lower().split()) for key, value in attributes)
    for key, value in attributes:
        if key not in {"class", "id"}:
            continue
        for name in value.split():
            words = [w.lower() for w in WORD.findall(name)]
            if not words or words[0] in OTHERS or not DROPPED_NAMES.intersection(words):
                continue
            while words[-1] in STRUCTURE:
                words.pop()
            most = max(most, 2 if words[-1] in DROPPED_NAMES and not (content and words[-1] in SUBJECTS) else 1)
    return 0 if most == 1 and tag in PROSE else most


def _raw_end(page: str, at: int, tag: str) -> int:
    """Where the content of an element of RAW and its end tag end; -1 without an end tag. Templates nest."""
    depth = 1
    for found in re.compile(rf"<(/?){tag}(?![^\s/>])", re.I).finditer(page, at):
        depth += -1 if found[1] else tag == "template"
        if not depth:
            end = page.find(">", found.end())
            return end + 1 if end >= 0 else len(page)
    return -1


def _attributes(page: str, at: int) -> tuple[list[tuple[str, str]], int, bool]:
    """The attributes from a place on as (lower-case name, value), where the tag ends, and whether a / stands before its end."""
    out, size = [], len(page)
    while True:
        found = ATTRIBUTE.match(page, at)
        at = found.end()
        if found[1]:
            double, closed, single, ended, plain = found.group(2, 3, 4, 5, 6)
            if double is not None and not closed or single is not None and not ended:
                return out, size, False
            out.append((found[1].lower(), double or single or plain or ""))
        if at >= size:
            return out, size, False
        if page[at] == ">":
            return out, at + 1, page[at - 1] == "/"
        if at == found.start():  # a lone character that begins no name
            at += 1


def parse(page: str) -> Dom:
    dom, at, size = Dom(), 0, len(page)
    stack = Stack(dom)
    endless: set[str] = set()  # elements without an end tag in the rest of the page
    held = 0  # where text begins that isn't taken yet
    while True:
        at = page.find("<", at)
        found = NAME.match(page, at + 1) if at >= 0 else None
        if at >= 0 and not found and page[at + 1 : at + 2] not in {"!", "?"}:
            at += 1
            continue
        text = page[held : at if at >= 0 else size]
        if text:
            dom.texts.append((stack.nodes[-1], text))
        if at < 0:
            return dom
        if not found:
            end = page.find("-->", at + 4) + 3 if page.startswith("<!--", at) else page.find(">", at) + 1
            at = held = end if end > 2 or end == 1 else size
            continue
        attributes, at, selfclosed = _attributes(page, found.end())
        held = at
        tag = found[2].lower()
        if tag in {"html", "body"}:
            continue
        if found[1]:
            stack.close(tag)
            continue
        top = stack.nodes[-1]
        inner = dom.tag[top] in FOREIGN or dom.foreign[top]
        if inner and tag in BREAKOUT:
            inner = stack.break_out()
        if tag in CLOSES_P:
            stack.end({"p"}, {"#block"})
        if tag in SIBLINGS:
            stack.end(*SIBLINGS[tag])
        top = stack.nodes[-1]
        if tag in BLOCK or tag == "br":
            dom.texts.append((top, None if tag != "br" else " "))
        if tag in CONTROLS or tag == "input" and ("type", "hidden") not in attributes:
            dom.controls[top] = dom.controls.get(top, 0) + 1
        if tag in VOID:
            continue
        node = dom.add(tag, top, boilerplate(dom, tag, attributes, top))
        if attributes and tag != "main" and (name := named(tag, attributes)):
            dom.named[node] = name
        if selfclosed and (inner or tag in FOREIGN):
            continue
        if tag in RAW and not (inner and tag == "title"):
            end = -1 if tag in endless else _raw_end(page, at, tag)
            if end < 0:
                endless.add(tag)
            at = held = end if end >= 0 else at if tag in ONLY_TAG else size
        else:
            stack.push(node)


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_links: float) -> float:
    """Composite text density; zero denominators count as 1."""
    if not chars:
        return 0.0
    tags, plain = max(tags, 1), max(chars - link_chars, 1)
    base = math.log(chars / plain * link_chars + body_links * chars + math.e)
    return max(0.0, chars / tags * math.log(chars / max(link_chars, 1) * tags / max(link_tags, 1)) / math.log(base)) if base > 1 else float(chars) / tags


def drop_forms(dom: Dom) -> None:
    """Drops the forms that are made of controls and their labels; one around an article or much text is only a wrapper."""
    n = len(dom.tag)
    forms = [k for k in range(n) if dom.tag[k] == "form" and not dom.dropped[k]]
    if not forms:
        return
    label, chars = [False] * n, [0] * n
    for k in range(1, n):
        label[k] = label[dom.parent[k]] or dom.tag[k] in LABELS
    for node, text in dom.texts:
        if text and not label[node] and not dom.dropped[node]:
            chars[node] += len("".join(text.split()))
    controls = [dom.controls.get(k, 0) for k in range(n)]
    holds = [dom.tag[k] in {"article", "main", "h1"} and not dom.dropped[k] for k in range(n)]
    for k in range(n - 1, 0, -1):
        up = dom.parent[k]
        chars[up] += chars[k]
        controls[up] += controls[k]
        holds[up] = holds[up] or holds[k]
    gone = {k for k in forms if not holds[k] and controls[k] and chars[k] < FORM_TEXT * controls[k]}
    for k in range(1, n):
        dom.dropped[k] = dom.dropped[k] or k in gone or dom.dropped[dom.parent[k]]


def drop_named(dom: Dom) -> None:
    """Drops the elements whose name says boilerplate, unless what they hold says otherwise.

    Names are evidence only. An element stays if it holds the page's main element, first-level heading or article; an article inside another one,
    inside an element of such a name while there are articles elsewhere, or of such a name itself isn't the page's. If
    the name only has a word of boilerplate among others, the element also stays if it is as dense as the article.
    If no text would be left, the names are wrong and nothing is dropped.
    """
    hard, n = dom.dropped, len(dom.tag)
    if not any(not hard[k] for k in dom.named):
        return

    def with_dropped(nodes: set[int]) -> list[bool]:
        out = [False] * n
        for k in range(1, n):
            out[k] = hard[k] or k in nodes or out[dom.parent[k]]
        return out

    suspects = {k for k in dom.named if dom.tag[k] != "article" or dom.named[k] == 2}
    below = with_dropped(suspects)
    elsewhere = any(dom.tag[k] in {"article", "main"} and not below[k] for k in range(n))
    nested = [False] * n  # inside an article
    for k in range(1, n):
        nested[k] = nested[dom.parent[k]] or dom.tag[dom.parent[k]] == "article"
    holds = [not hard[k] and (dom.tag[k] in {"main", "h1"} or dom.tag[k] == "article" and dom.named.get(k) != 2 and not elsewhere and not nested[k]) for k in range(n)]
    for k in range(n - 1, 0, -1):
        holds[dom.parent[k]] = holds[dom.parent[k]] or holds[k]
    suspects = {k for k in suspects if not holds[k]}
    dom.dropped = with_dropped(suspects)
    weak = {k for k in suspects if dom.named[k] == 1}
    if weak:
        _, _, dense, sums = _densities(dom)
        top = max(range(n), key=lambda k: (sums[k], -k))
        least = dense[top]
        while top >= 0:
            least, top = min(least, dense[top]), dom.parent[top]
        dom.dropped = with_dropped(suspects - weak)
        chars, _, dense, _ = _densities(dom)
        suspects -= {k for k in weak if chars[k] and dense[k] >= least}
        dom.dropped = with_dropped(suspects)
    if not any(text and not text.isspace() and not dom.dropped[node] for node, text in dom.texts):
        dom.dropped = hard


def _densities(dom: Dom) -> tuple[list[int], list[int], list[float], list[float]]:
    """Characters, link characters, density and sum of the children's densities of each node, without dropped ones."""
    n = len(dom.tag)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for k in range(1, n):
        in_link[k] = dom.tag[k] == "a" or in_link[dom.parent[k]]
    for node, text in dom.texts:
        if text and not dom.dropped[node]:
            size = len("".join(text.split()))
            chars[node] += size
            if in_link[node]:
                links[node] += size
    for k in range(n - 1, 0, -1):
        if dom.dropped[k]:
            continue
        up = dom.parent[k]
        chars[up] += chars[k]
        links[up] += links[k]
        tags[up] += tags[k] + (not dom.foreign[k])
        link_tags[up] += link_tags[k] + (dom.tag[k] == "a")
    body_links = links[0] / max(chars[0], 1)
    dense = [density(chars[k], tags[k], links[k], link_tags[k], body_links) for k in range(n)]
    sums = [0.0] * n
    for k in range(1, n):
        if not dom.dropped[k]:
            sums[dom.parent[k]] += dense[k]
    return chars, links, dense, sums


def _outermost(dom: Dom, tag: str) -> list[int]:
    """The outermost element of a tag around each node, itself included; -1 where there is none."""
    out = [-1] * len(dom.tag)
    for k in range(1, len(dom.tag)):
        up = out[dom.parent[k]]
        out[k] = up if up >= 0 else k if dom.tag[k] == tag else -1
    return out


def article_roots(dom: Dom) -> list[int]:
    """The nodes whose kept text is the article: one, and headings that stand apart from it."""
    n = len(dom.tag)
    chars, links, dense, sums = _densities(dom)
    # the node of the largest sum below each node, itself included; the earlier one of equals
    best = list(range(n))
    for k in range(n - 1, 0, -1):
        up = dom.parent[k]
        if not dom.dropped[k] and (sums[best[k]], -best[k]) > (sums[best[up]], -best[up]):
            best[up] = best[k]
    top = best[0]
    # a page's one article, or else its main element, holds the text unless it is plainly too thin
    zones = [_outermost(dom, "article"), _outermost(dom, "main")]
    for zone in zones:
        own = [k for k in range(n) if zone[k] == k and not dom.dropped[k] and chars[k]]
        if len(own) == 1 and chars[own[0]] >= THIN * chars[0]:
            top = best[own[0]]
            break
    threshold, node = dense[top], top
    while node >= 0:
        threshold, node = min(threshold, dense[node]), dom.parent[node]
    marked, covered = [top], {top}
    for k in range(n):  # parents come first; below a marked node nothing is marked again
        if dom.parent[k] in covered:
            covered.add(k)
        elif not dom.dropped[k] and k and dense[k] >= threshold and chars[k] and best[k] not in covered and sums[best[k]] > 0:
            marked.append(best[k])
            covered.add(best[k])
    heads = [k for k in range(n) if dom.tag[k] == "h1" and not dom.dropped[k] and chars[k]]
    # what is marked beside an article, or beside the main element, isn't the page's own
    for zone in zones:
        if zone[top] >= 0:
            marked = [k for k in marked if zone[k] >= 0]
            break
    root = _common(dom, marked)
    article, main = zones[0][root], zones[1][root]
    root = article if article >= 0 else main if main >= 0 else root
    inside = [False] * n
    inside[root] = True
    for k in range(root + 1, n):
        inside[k] = inside[dom.parent[k]]
    heads = [k for k in heads if not inside[k]]
    if not heads:
        return [root]
    both = _common(dom, [root, *heads])
    more = chars[both] - chars[root] - sum(chars[k] for k in heads)
    linked = links[both] - links[root] - sum(links[k] for k in heads)
    if article < 0 and linked <= MENU_LINKS * more:
        return [both]
    return [root, *heads]


def _common(dom: Dom, nodes: list[int]) -> int:
    """The lowest node that holds all of these."""
    held = [0] * len(dom.tag)
    for node in nodes:
        held[node] += 1
    for k in range(len(dom.tag) - 1, 0, -1):
        if held[k] == len(nodes):
            return k
        held[dom.parent[k]] += held[k]
    return 0


def main_text(page: str | None) -> str:
    """The article's text: blocks in page order, white space inside them and between them one space."""
    if not page:
        return ""
    dom = parse(page)
    drop_forms(dom)
    drop_named(dom)
    roots = {*article_roots(dom)}
    inside = [k in roots for k in range(len(dom.tag))]
    for k in range(1, len(dom.tag)):
        inside[k] = inside[k] or inside[dom.parent[k]]
    parts = [html.unescape(text) if text else " " for node, text in dom.texts if inside[node] and not dom.dropped[node] or text is None]
    return SPACES.sub(" ", "".join(parts)).strip(" ")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return bounded(pages).select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")
