"""Main text of web pages by consensus container paths per host.

Each page's containers are scored by the text of the blocks in them, less the
share that is links.  A container's path, generalised to tags and first
classes without digits, is its name; Spark sums the scores of each path over
all pages of a host (a partial aggregate, so one large host is no burden),
and every page is extracted again from the containers at its host's
best-supported path.  A page that has no such container falls to its host's
next path, and last to its own best.

Boilerplate elements (menus, headers, footers, sidebars, notices, adverts,
forms, comments, hidden parts) count for nothing and are left out of the
text, by element or by the words in their class and id.

Defined results: null and empty html give an empty text; pages without a url
or host share the host of the empty name; repeated rows are extracted as
often as they occur; null ids stay null; an empty table gives no rows; extra
columns are ignored; open quotes, tags and elements, however many or deep,
cost time and memory in proportion to the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Ranked paths of a host that a page may fall back through.
PATHS_KEPT = 8

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_INSIDE = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas xmp".split())
BOILERPLATE = frozenset("nav header footer aside form button select menu dialog fieldset label".split())
#: The end of each raw element; only that ends it, whatever its text looks like.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: What an open element of a name ends when it starts (by that name or one of these).
ENDS = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"},
    "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"},
}
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
_STOPS = frozenset("article body div main section table td th ul ol dl blockquote aside nav".split())
#: Words in class, id or role that mark menus, headers, footers,
#: sidebars, notices, adverts, forms and comments, ...
_COMMENTS = r"comments?|commentlist|respond|disqus\w*|replies"
_NOISE = re.compile(
    r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|popup|modal|overlay|sidebar\w*|rail|"
    r"widget\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|header|masthead|footer\w*|share\w*|sharing|social\w*|related\w*|"
    rf"recommend\w*|newsletter|subscri\w*|signup|login|searchbox|searchform|pagination|pager|toolbar|copyright|{_COMMENTS})\Z", re.I)
_TALK = re.compile(rf"(?:{_COMMENTS})\Z", re.I)
#: ... words that may follow one of these and say only where or how much, ...
_AFTER = frozenset(
    "area bar block bottom box button buttons col column container content desktop form group icons inner item items left link links list main "
    "mobile outer panel posts articles stories primary right row secondary section slot text top unit wrap wrapper zone".split()
)
#: ... and words before which a name only says what its page has.
_BEFORE = frozenset("has no with without is not hide show".split())
#: Elements that tell an article's frame from a box beside it.
_HEADS = frozenset(("main", "article", "h1"))


def _noisy(words: str) -> tuple[bool, bool]:
    """Whether one of the names in ``words`` names a part of a page that is no
    article, and whether it names comments.  The noise word must be what the
    name is about: ``site-header`` and ``comment-list`` are, ``has-sidebar``,
    ``header-fixed``, ``share-price`` and ``comments-on-kant`` are not."""
    noise = talk = False
    for name in words.split():
        parts = [x for x in re.split(r"[_-]+|\d+\w*", name.lower()) if x]
        if not parts or parts[0] in _BEFORE:
            continue
        while len(parts) > 1 and parts[-1] in _AFTER and not _NOISE.match(parts[-1]):
            parts.pop()
        if _NOISE.match(parts[-1]):
            noise, talk = True, talk or bool(_TALK.match(parts[-1]))
    return noise, talk


_SPACE = re.compile(r"[\s ]+")


class Node:
    """``path``: a hash of the generalised path from the root, so that deep
    pages cost no more than their nodes; ``article``: the outermost article
    around the node, if any."""

    __slots__ = ("tag", "parent", "path", "noise", "named", "talk", "items", "length", "linked", "score", "article")

    def __init__(self, tag: str, parent: Node | None, path: int, noise: bool, named: bool = False, talk: bool = False) -> None:
        self.tag, self.parent, self.path, self.noise = tag, parent, path, noise
        self.named, self.talk = named, talk
        self.article = parent.article if parent is not None and parent.article is not None else self if tag == "article" else None
        self.items: list = []
        self.length = self.linked = 0
        self.score = 0.0


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}


def _step(path: int, step: str) -> int:
    """The path one step on: signed, as Spark keeps it."""
    value = xxhash.xxh64_intdigest(f"{path}/{step}")
    return value - (1 << 64) if value >> 63 else value


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): text, a start or an end tag.  Raw elements, comments
    and declarations are left out.  Every character is looked at a bounded
    number of times, whatever is left open: a quote without a partner is a
    plain character, a raw element without an end loses its start only."""
    at, n = 0, len(html)
    unpaired: set[str] = set()
    endless: set[str] = set()
    last = html.rfind(">")
    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            yield "text", "", html[at:]
            return
        if begin > at:
            yield "text", "", html[at:begin]
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        if html[begin + 1 : begin + 2] in ("!", "?"):
            end = html.find(">", begin)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(html, begin + 1)
        if m is None or begin > last:
            yield "text", "", "<"
            at = begin + 1
            continue
        stop = m.end()
        while (found := _INSIDE.search(html, stop)) is not None and found[0] != ">":
            quote, stop = found[0], found.end()
            if quote not in unpaired:
                partner = html.find(quote, stop)
                if partner < 0:
                    unpaired.add(quote)
                elif partner < last:
                    stop = partner + 1
        if found is None:
            yield "text", "", "<"
            at = begin + 1
            continue
        at, name, rest = found.end(), m[1].lower(), html[m.end() : found.start()]
        if m[0][0] == "/":
            yield "end", name, ""
        elif name not in RAW:
            yield "start", name, rest
        elif not rest.endswith("/") and name not in endless:
            end = _RAW_END[name].search(html, at)
            if end is None:
                endless.add(name)
            else:
                at = end.end()


def parse(html: str) -> Node:
    """A forgiving tree: unclosed elements end with what holds them."""
    root = at = Node("", None, 0, False)
    # How many elements of each name are open: none, none is looked for.
    opened: Counter[str] = Counter()

    def leave(up: Node) -> Node:
        node = at
        while node is not up:
            opened[node.tag] -= 1
            node = node.parent
        opened[up.tag] -= 1
        return up.parent

    for kind, name, rest in tokens(html):
        if kind == "text":
            at.items.append(rest)
            continue
        if kind == "end":
            up = at if opened[name] > 0 else root
            while up is not root and up.tag != name:
                if name in INLINE and up.tag not in INLINE:
                    up = root
                    break
                up = up.parent
            if up is not root:
                at = leave(up)
            elif name not in INLINE:
                at.items.append(" ")
            continue
        if name in VOID:
            at.items.append(" " if name in ("br", "hr") else "")
            continue
        ends = ENDS.get(name, {"p"} if name in _CLOSES_P else ())
        if any(opened[e] > 0 for e in ends):
            up = at
            while up is not root and up.tag not in ends and up.tag not in _STOPS:
                up = up.parent
            if up is not root and up.tag in ends:
                at = leave(up)
        found = _attributes(rest) if rest.strip() else {}
        words = f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}"
        # The page's frame is never noise, whatever its classes say.
        framed = name in ("html", "body")
        noise = not framed and (
            name in BOILERPLATE
            or "hidden" in found
            or found.get("aria-hidden") == "true"
            or "display:none" in found.get("style", "").replace(" ", "").lower()
        )
        named, talk = _noisy(words) if not framed and words.strip() else (False, False)
        first = re.sub(r"\d+", "", found.get("class", "").split()[0]) if found.get("class", "").split() else ""
        step = f"{name}.{first}" if first else name
        child = Node(name, at, at.path if name in INLINE else _step(at.path, step), noise or at.noise, named, talk)
        at.items.append(child)
        if not rest.endswith("/"):
            at = child
            opened[name] += 1
    _judge(root)
    return root


def _judge(root: Node) -> None:
    """Mark as noise what is named so, and all within it.  A name alone never
    drops the article: an element that holds a heading of the page, its main
    part or an article, and half of the text, is its frame, unless it is named
    for comments."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in node.items if isinstance(x, Node) and not x.noise)
    if not any(node.named for node in order):
        return
    size: dict[int, int] = {}
    heads: set[int] = set()
    for node in reversed(order):
        size[id(node)] = size.get(id(node), 0) + sum(len(x.strip()) for x in node.items if isinstance(x, str))
        if node.tag in _HEADS:
            heads.add(id(node))
        if node.parent is not None:
            size[id(node.parent)] = size.get(id(node.parent), 0) + size[id(node)]
            if id(node) in heads:
                heads.add(id(node.parent))
    for node in order:  # parents come first
        frame = id(node) in heads and not node.talk and 2 * size[id(node)] >= size[id(root)]
        node.noise = (node.named and not frame) or (node.parent is not None and node.parent.noise)


def _weigh(root: Node) -> list[Node]:
    """Score the containers: a block's text counts for its parent, and half
    for the parent's parent."""
    order, stack = [], [(root, False)]
    while stack:
        node, in_link = stack.pop()
        order.append(node)
        link = in_link or node.tag == "a"
        for item in node.items:
            if isinstance(item, Node):
                if not item.noise:
                    stack.append((item, link))
            else:
                n = len(item.strip())
                node.length += n
                node.linked += n if link else 0
    containers = []
    for node in reversed(order):
        if node.tag in INLINE and node.parent is not None:
            node.parent.length += node.length
            node.parent.linked += node.linked
            continue
        worth = node.length - 2 * node.linked
        if worth > 0:
            bare = node.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "dd", "dt")
            targets = [node, node.parent] if bare else [node.parent, node.parent and node.parent.parent]
            for target, share in zip(targets, (1.0, 0.5)):
                if target is not None:
                    target.score += share * worth
        containers.append(node)
    for node in containers:
        if node.tag in ("article", "main"):
            node.score *= 1.5
    return [n for n in containers if n.score > 0]


def _widened(node: Node) -> Node:
    """The outermost article that holds the container, if one does."""
    return node.article or node


def _text(nodes: list[Node]) -> str:
    parts: list[str] = []
    stack: list = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif not item.noise:
            inline = item.tag in INLINE
            if not inline:
                parts.append(" ")
                stack.append(" ")
            stack.extend(reversed(item.items))
    return _SPACE.sub(" ", unescape("".join(parts))).strip()


def candidates(html: str | None) -> list[tuple[int, float]]:
    """(path, score) of a page's containers, each path once."""
    found: dict[int, float] = {}
    for node in _weigh(parse(html or "")):
        path = _widened(node).path
        found[path] = max(found.get(path, 0.0), node.score)
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))


def extract(html: str | None, paths: list[int]) -> str:
    """Text of the containers at the first of ``paths`` that the page has,
    else of the page's best container."""
    root = parse(html or "")
    scored = [(_widened(n), n.score) for n in _weigh(root)]
    if not scored:
        return _text([root])
    by_path: dict[int, dict[int, Node]] = {}
    for node, _ in scored:
        by_path.setdefault(node.path, {})[id(node)] = node
    best = min(scored, key=lambda x: (-x[1], x[0].path))[0].path
    path = next((p for p in paths if p in by_path), best)
    order: dict[int, int] = {}
    stack = [root]
    while stack:
        node = stack.pop()
        order[id(node)] = len(order)
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node))
    return _text(sorted(by_path[path].values(), key=lambda n: order[id(n)]))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of ``pages`` (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select("page_id", "url", "html", host.alias("host"))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(h, p, s) for h, html in zip(batch["host"], batch["html"]) for p, s in candidates(html)]
            if out:
                yield pd.DataFrame(out, columns=["host", "path", "score"])

    votes = (
        rows.select("host", "html")
        .mapInPandas(vote, "host string, path long, score double")
        .groupBy("host", "path")
        .agg(F.sum("score").alias("score"))
    )
    by_host = Window.partitionBy("host").orderBy(F.desc("score"), "path")
    winners = materialize(
        votes.withColumn("rank", F.row_number().over(by_host))
        .filter(F.col("rank") <= PATHS_KEPT)
        .groupBy("host")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths")),
        "winners",
    )

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(h, [] if p is None else list(p)) for h, p in zip(batch["html"], batch["paths"])]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    # The winners' size is known: where they are small pages stay in place,
    # else both sides are sorted and a large host's pages are split.
    joined = rows.join(winners, "host", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "html", "paths")
    out = joined.mapInPandas(again, "page_id string, url string, text string")
    return out.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))


def digest(pages: DataFrame) -> DataFrame:
    return main_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))
