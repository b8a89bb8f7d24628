"""Main text of web pages by site style trees.

The pages of a host are merged into one tree. An element node is a path of element names and classes; below it, its
presentation nodes are the sequences of children it has in pages (repeats of one child count once), and its content is
the texts that stand directly in it. A presentation that varies over the host's pages has a high entropy, and so much
importance; a text found on many pages has a high entropy over them, and so little. The two make an element's composite
importance, from its children up. A branch in which nothing reaches the threshold is removed from the page.

Some elements say what they are. Those named as menus, headers, footers, sidebars, notices, adverts, forms or comments
have their importance, and that of all below, scaled down beneath the threshold. An article is kept, but for such
branches in it: its texts are what is sought, even if all pages of a host should share them. Scripts, styles and the
like have no text at all. Hosts with few different pages say nothing about what is common, so all is important there.

The tree is two tables of counts, keyed by host and path and by what was seen there. A host's size does not matter: rows
are summed before they are shuffled. Copies of a page count once. Pages meet the importances of their own nodes by key.

Cases. A null or empty html gives an empty text; a null url is a host of its own. Broken markup is read as far as it goes: a
missing end tag ends with its parent, a stray one is skipped. Repeated rows are extracted each. Any length is read
whole. Columns other than `page_id`, `url` and `html` are not read. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re

import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgeo.llm.common import by_batch, staged

#: Damping of children's importance, importance that keeps a branch, factor of elements that say they are noise, and different pages of a host from which on entropy counts.
GAMMA, THRESHOLD, NOISE_FACTOR, LEAST_PAGES = 0.9, 0.5, 0.4, 4

# HTML element names by their kind.
RAW = frozenset("script style textarea noscript template iframe object embed svg math canvas audio video head select option datalist title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NOISE_TAGS = frozenset("nav footer aside form button menu dialog fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt", ("dl",)), "dd": ("dt", ("dl",)), "tr": ("tr", ("table",)), "td": ("td", ("tr", "table")), "th": ("td", ("tr", "table"))}
ALIKE = {"dd": "dt", "th": "td"}
#: Words in a class, id or role by which an element says that it is not the article.
NOISE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer contentinfo sidebar aside complementary widget ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo promotion banner notice notices alert cookie cookies consent gdpr popup modal overlay toast "
    "newsletter subscribe subscription signup login form search social share sharing comment comments reply replies disqus related recommended "
    "recommendations pagination pager toolbar copyright disclaimer".split())
ARTICLE_WORDS = frozenset("article main".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[/!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", re.I)

NEUTRAL, NOISE, ARTICLE = 0, 1, 2


def host_of(url: str | None) -> str:
    m = HOST.match((url or "").strip())
    return m.group(1).lower() if m else ""


def hashed(*parts: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh3_64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


class Page:
    """A page's branches: parent, path and role of each node, and the text pieces in page order with their nodes.

    Inline elements are part of the node they stand in, unless they say that they are noise. Paths stop at articles,
    below which only noise has nodes of its own."""

    def __init__(self, text: str | None):
        self.parents, self.paths, self.roles = [-1], [""], [NEUTRAL]
        self.nodes: list[int] = []
        self.pieces: list[str] = []
        # Open elements: name, and the node their text belongs to.
        self.open: list[tuple[str, int]] = [("", 0)]
        if text:
            self._read(text)

    def _text(self, piece: str) -> None:
        if piece:
            self.nodes.append(self.open[-1][1])
            self.pieces.append(entities.unescape(piece) if "&" in piece else piece)

    def _close(self, i: int) -> None:
        """Ends the open elements from the i-th on."""
        if any(name not in INLINE for name, _ in self.open[i:]):
            self._text(" ")
        del self.open[i:]
        self._gap()

    def _gap(self) -> None:
        if self.pieces and self.pieces[-1] != " ":
            self.nodes.append(self.nodes[-1])
            self.pieces.append(" ")

    def _end(self, name: str, within: tuple[str, ...] = ()) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            at = self.open[i][0]
            if at == name:
                inline = name in INLINE and all(x in INLINE for x, _ in self.open[i:])
                if inline:
                    del self.open[i:]
                else:
                    self._close(i)
                return
            if at in within:
                return

    def _start(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self._end("p", ("article", "main", "section", "div", "td", "th", "li", "blockquote", "button", "table"))
        elif name in SAME:
            kind, within = SAME[name]
            for other in {kind, name, *(k for k, v in ALIKE.items() if v == kind)}:
                self._end(other, within)
        words = set()
        label = name
        if attributes:
            found = [(k.lower(), a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)]
            said = " ".join(v for _, v in found)
            words = {w.lower() for w in PARTS.findall(said)}
            label += "." + ".".join(sorted(v for k, v in found if k == "class" for v in v.split()))
        parent = self.open[-1][1]
        role = self.roles[parent]
        if role != NOISE:
            inside = role == ARTICLE
            if name in NOISE_TAGS or name == "header" and not inside or words & NOISE_WORDS:
                role = NOISE
            elif name in ("article", "main") or words & ARTICLE_WORDS:
                role = ARTICLE
        own = parent
        if self.roles[parent] != role or name not in INLINE and self.roles[parent] != ARTICLE:
            own = len(self.parents)
            self.parents.append(parent)
            self.paths.append(f"{self.paths[parent]}>{label}")
            self.roles.append(role)
        if name not in INLINE:
            self._gap()
        self.open.append((name, own))

    def _read(self, text: str) -> None:
        at, skip_to = 0, -1
        for m in TOKEN.finditer(text):
            if m.start() < skip_to:
                continue
            if m.start() > at:
                self._text(text[at : m.start()])
            at = m.end()
            name = m.group(2) or m.group(5)
            if not name:
                continue
            name = name.lower()
            if m.group(1) or m.group(4):
                if name == "br" or name == "p" and all(x != "p" for x, _ in self.open):
                    self._gap()
                else:
                    self._end(name)
                continue
            attributes = m.group(3) or m.group(6) or ""
            if name in RAW:
                if name == "head":
                    end = re.search(r"</head\s*>|<body\b", text[at:], re.I) or re.search(r"<(?:article|main|div|p|h1|nav|header|section)\b", text[at:], re.I)
                    at = skip_to = at + (end.start() if end else len(text) - at)
                elif name == "embed" or attributes.rstrip().endswith("/") and name in ("svg", "math"):
                    pass
                else:
                    end = re.compile(rf"</{name}\s*>", re.I).search(text, at)
                    at = skip_to = end.end() if end else len(text)
                if name not in INLINE:
                    self._gap()
                continue
            if name in VOID:
                if name != "wbr":
                    self._gap()
                continue
            self._start(name, attributes)
        if at < len(text):
            self._text(text[at:])

    def keys(self, host: str) -> list[int]:
        return [hashed(host, p) for p in self.paths]

    def seen(self, host: str) -> tuple[list[int], list[int], list[int]]:
        """What the page tells the host's tree: keys, whether a presentation (0) or a text (1), and its hash."""
        keys = self.keys(host)
        children: dict[int, list[str]] = {}
        for i, p in enumerate(self.parents):
            if p >= 0:
                own = children.setdefault(p, [])
                label = self.paths[i].rpartition(">")[2]
                if not own or own[-1] != label:
                    own.append(label)
        shapes: dict[int, set[str]] = {}
        for i, k in enumerate(keys):
            shapes.setdefault(k, set()).add(" ".join(children.get(i, ())))
        rows = [(k, 0, hashed(*sorted(x))) for k, x in shapes.items()]
        texts: dict[int, list[str]] = {}
        for n, piece in zip(self.nodes, self.pieces):
            if self.roles[n] != ARTICLE:
                texts.setdefault(n, []).append(piece)
        rows += {(keys[n], 1, hashed(" ".join(x))) for n, own in texts.items() if (x := "".join(own).split())}
        return tuple(map(list, zip(*rows)))


def kept_text(parents: list[int], roles: list[int], keys: list[int], nodes: list[int], pieces: list[str], known: dict[int, tuple[float, float, float]]) -> str:
    """The page's text without the branches that matter too little. known: key to (presentations, their importance, the texts' importance)."""
    n = len(parents)
    below: list[list[float]] = [[] for _ in range(n)]
    has_text = {m for m, piece in zip(nodes, pieces) if not piece.isspace()}
    most = [0.0] * n
    for i in range(n - 1, -1, -1):
        if roles[i] == ARTICLE:
            own = most[i] = 1.0
        else:
            styles, shape, content = known.get(keys[i], (1.0, 1.0, 1.0))
            parts = below[i] + [content] * (i in has_text)
            damp = GAMMA ** styles
            own = (1 - damp) * shape + damp * (sum(parts) / len(parts) if parts else 0.0) if below[i] else sum(parts)
            own *= NOISE_FACTOR if roles[i] == NOISE else 1.0
            most[i] = max(most[i], own)
        if (p := parents[i]) >= 0:
            below[p].append(own)
            most[p] = max(most[p], most[i])
    gone = [False] * n
    for i in range(n):
        gone[i] = most[i] < THRESHOLD or parents[i] >= 0 and gone[parents[i]]
    return " ".join("".join([" " if gone[m] else x for m, x in zip(nodes, pieces)]).split())


_SEEN = "row_key bigint, page_key bigint, keys array<bigint>, kinds array<tinyint>, hashes array<bigint>"
_CUT = "row_key bigint, page_id bigint, url string, parents array<int>, roles array<tinyint>, keys array<bigint>, nodes array<int>, packed binary"


def _row_key(page_id, url, html) -> int:
    return hashed(str(page_id), str(url), html or "")


def _tell(ids, urls, htmls):
    for page_id, url, html in zip(ids, urls, htmls):
        host = host_of(url)
        yield (_row_key(page_id, url, html), hashed(host, html or ""), *Page(html).seen(host))


def _cut(ids, urls, htmls):
    pack = zstandard.ZstdCompressor(level=3)
    for page_id, url, html in zip(ids, urls, htmls):
        page = Page(html)
        nodes, pieces = [], []
        for n, piece in zip(page.nodes, page.pieces):  # runs of one node are one piece
            if nodes and nodes[-1] == n:
                pieces[-1].append(piece)
            else:
                nodes.append(n)
                pieces.append([piece])
        text = "\0".join("".join(x).replace("\0", " ") for x in pieces)
        yield (_row_key(page_id, url, html), page_id, url, page.parents, page.roles, page.keys(host_of(url)), nodes, pack.compress(text.encode("utf-8", "surrogatepass")))


def _finish(ids, urls, parents, roles, keys, nodes, packed, known):
    unpack = zstandard.ZstdDecompressor()
    for page_id, url, p, r, k, n, blob, found in zip(ids, urls, parents, roles, keys, nodes, packed, known):
        text = unpack.decompress(blob).decode("utf-8", "surrogatepass") if blob else ""
        importance = {x["key"]: (x["styles"], x["shape"], x["content"]) for x in found or ()}
        out = kept_text(p, r, k, n, text.split("\0") if n else [], importance)
        yield page_id, url, out, len(out)


def style_tree(seen: DataFrame) -> DataFrame:
    """A row per element node of the hosts' trees: pages, presentations, importance of presentation and of content."""
    once = seen.dropDuplicates(["page_key"]).select(F.inline(F.arrays_zip("keys", "kinds", "hashes")))
    counts = once.groupBy("keys", "kinds", "hashes").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    shape, text = F.col("kinds") == 0, F.col("kinds") == 1
    nodes = counts.groupBy(F.col("keys").alias("key")).agg(
        F.sum(F.when(shape, n)).alias("pages"), F.count(F.when(shape, 1)).cast("double").alias("styles"),
        F.sum(F.when(shape, n * F.log(n))).alias("n_log_n"), F.avg(F.when(text, F.log(n))).alias("log_df"))
    enough = F.col("pages") >= LEAST_PAGES
    log_m = F.log("pages")
    return nodes.select(
        "key", "pages", "styles",
        F.when(enough, (log_m - F.col("n_log_n") / F.col("pages")) / log_m).otherwise(1.0).alias("shape"),
        F.when(enough, 1 - F.coalesce(F.col("log_df"), F.lit(0.0)) / log_m).otherwise(1.0).alias("content"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    source = pages.select("page_id", "url", "html")
    seen = staged(by_batch(source, _tell, _SEEN, 200), "site-seen")
    tree = style_tree(seen)
    asked = seen.select("row_key", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    found = asked.join(tree, "key").groupBy("row_key").agg(F.collect_list(F.struct("key", "styles", "shape", "content")).alias("known"))
    cut = by_batch(source, _cut, _CUT, 200).join(found, "row_key", "left")
    ready = cut.select("page_id", "url", "parents", "roles", "keys", "nodes", "packed", "known")
    return by_batch(ready, _finish, "page_id bigint, url string, text string, n_chars bigint", 200)
