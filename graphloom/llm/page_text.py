"""Main text of web pages by inferred wrappers: union-free regular expressions over tag streams.

A page's tags make a sequence of groups, nested as the tags are; text is a slot. Pages of one host
are aligned one after another: equal groups are matched in order, what only one side has becomes
optional, what stands there again becomes repeated, and nested groups are aligned in turn. The
wrapper so made says, for each group, how much text and link text its slots took over all pages of
the host, and about how many different texts and pages it was seen with. From the outermost group
down to the content, which holds nearly all text, groups that say the same on page after page and
groups of links are boilerplate; every page gives the text of all others, so that headlines beside
the content and pages of rarer templates lose nothing. A group whose name alone calls it noise is
kept where it holds nearly all text of the host and varies.

Pages whose groups are the same have one template, and their wrappers are added up: tasks do so with
their own pages, as a map-side combine, then a fixed number of tasks' sums at a time. Only then are the
different templates of a host aligned, in the order of their digests and a bounded number at a time,
dealt out by these digests. So a wrapper depends on the pages alone, not on how they were dealt to
tasks, and no group grows with the pages of a host. Extraction parses each page by itself with its
host's region, which is sent to the pages.

Defined cases: null or empty html, or html without text, gives an empty text; very long and deeply
nested pages are parsed without recursion; a page without its host's region, or that it
leaves little of, falls back to its own wrapper; rows that repeat give repeated rows; pages without url form one host; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.keys import stored

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:"[^"]*+"|'[^']*+'|[^>"'])*+)(/?)>""", re.S)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Fixed HTML facts: elements without end tag, with raw text, that stand for no main text, that make blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe".split())
SKIP = RAW | frozenset("head nav footer aside form button select option svg math canvas object audio video dialog menu".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header address details summary center hr".split())
LISTS = frozenset("section div table tbody tr td center ul ol dl p".split())
HOLDER = frozenset("html body main article section div table tbody tr td center".split())
#: Parts of class and id words. A word stands for noise as a whole: each part names noise or only says where or what kind.
NOISE = re.compile(r"(?:ads?|advert\w*|adbox|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notices?|alert|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|widgets?|footer\w*|masthead|header|comments?|replies|disqus|respond|share\w*|sharing|social\w*|related|recommend\w*|newsletter|subscribe|signup|login|search\w*|toolbar|pagination|pager|skip\w*)", re.I)
KIND = frozenset("site main top bottom left right global primary secondary list area box bar container wrapper wrap block section inner item items button buttons link links form thread icons media slot unit posts".split())
PARTS = re.compile(r"[-_]+")
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Open elements that a start tag closes, up to the nearest of the second group.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
SPACES = re.compile(r"\s+")
#: Share of the text that a group must hold for the search to go on inside it, or for its name to be overruled.
MOST = 0.7
#: Characters of all hosts' regions up to which they are broadcast; parts that a host's pages go to beyond that.
SMALL, SALTS = 16 << 20, 64
#: Different texts and pages that a group of a wrapper remembers, those of the smallest hashes: fewer are counted exactly, and the
#: count of more is told by how close together the smallest ones lie, with a standard error of an eighth.
SKETCH = 64
#: Sums of tasks, and templates of a host, that are folded at once; templates that a task holds at most.
FAN_IN, HELD = 32, 4096
#: Names that say what a group is, not only where; a group of that name is never the content.
SURE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adbox|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|comments?|replies|disqus|respond)(?:$|[\s_-])", re.I)


class Node:
    __slots__ = ("key", "kids", "noise", "tag")

    def __init__(self, tag: str, key: str, noise: int):
        # noise: 1 by name, 2 for sure
        self.tag, self.key, self.noise, self.kids = tag, key, noise, []


def names_noise(word: str) -> bool:
    parts = [x for x in PARTS.split(word.lower()) if x and not x.isdigit()]
    noise = [bool(NOISE.fullmatch(x)) for x in parts]
    return any(noise) and all(n or x in KIND for n, x in zip(noise, parts, strict=True))


def parse(page: str) -> Node:
    """The tree of a page's tags; text stands among the children as strings."""
    root = Node("", "", 0)
    stack, at = [root], 0
    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK:
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in HOLDER or stack[i].tag == "p"), 0)
            if i and stack[i].tag == "p":
                del stack[i:]
        if tag in CLOSES:
            shut, stop = (x.split() for x in CLOSES[tag])
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stop:
                    break
                if stack[i].tag in shut:
                    del stack[i:]
                    break
        attrs = {k.lower(): v.strip("\"'") for k, v in reversed(ATTR.findall(m[3]))} if m[3] else {}
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        noise = 0
        if tag not in ("html", "body", "main", "article") and any(map(names_noise, names.split())):
            noise = 2 if SURE.search(names) else 1
        if tag in SKIP or attrs.get("role", "").lower() in NOISE_ROLE or re.search(r"display\s*:\s*none", attrs.get("style", "")):
            noise = 2
        if tag != "html" and ("hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true"):
            noise = 2
        if tag == "header" and not any(x.tag in ("article", "main") for x in stack):
            noise = 2
        key = f"{tag}.{attrs['class']}" if attrs.get("class") and tag not in ("html", "body") else tag
        node = Node(tag, f"~{key}" if noise == 1 else key, noise)
        stack[-1].kids.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def wrapper_of(root: Node) -> list:
    """The page as a wrapper [key, multiplicity, text, kids, link text, texts, pages]; equal neighbours are one repeated group."""
    page: list[int] = []
    out = [root.key, "1", 0, [], 0, [], page]
    todo = [(root, out, 0)]
    late = []
    while todo:
        node, w, depth = todo.pop()
        own = 0
        for kid in node.kids:
            if isinstance(kid, str):
                text = SPACES.sub("", html.unescape(kid))
                w[2] += len(text)
                own = zlib.crc32(text.encode("utf-8", "replace"), own)
            elif kid.tag == "a" and kid.noise < 2:
                w[4] += length(kid)
            elif kid.noise < 2 and depth >= DEEP:
                w[2] += length(kid)
            elif kid.noise < 2:
                g = [kid.key, "1", 0, [], 0, [], page]
                w[3].append(g)
                todo.append((kid, g, depth + 1))
        late.append((w, own))
    for w, own in reversed(late):
        w[5] = [zlib.crc32(repr([g[5] for g in w[3]]).encode(), own)]
        w[3] = repeated(w[3])
        for g in w[3]:
            if len(g[5]) > 1:  # of one page, so one text
                g[5] = [zlib.crc32(repr(g[5]).encode())]
    page.append(out[5][0])
    return out


def length(node: Node) -> int:
    """Characters of a group's text without spaces."""
    n, todo = 0, [node]
    while todo:
        for kid in todo.pop().kids:
            if isinstance(kid, str):
                n += len(SPACES.sub("", html.unescape(kid)))
            elif kid.noise < 2:
                todo.append(kid)
    return n


def repeated(groups: list[list]) -> list[list]:
    """Runs of groups with one key become one group with a plus."""
    out: list[list] = []
    for g in groups:
        if out and out[-1][0] == g[0]:
            out[-1] = align(out[-1], g)
            out[-1][1] = "+" if out[-1][1] in "1+" else "*"
        else:
            out.append(g)
    return out


def matches(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in order, by rows of bits: a bit is unset where the row's length steps up."""
    where: dict[str, int] = {}
    for j, k in enumerate(y):
        where[k] = where.get(k, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows = [full]
    for k in x:
        v = rows[-1]
        u = v & where.get(k, 0)
        rows.append((v + u | v - u) & full)
    out, i, j = [], len(x), len(y)
    while i and j:
        # Left of a step of row i that row i-1 lacks at this place, the pair before it is the match.
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        else:
            low = (1 << j) - 1
            if (rows[i - 1] & low).bit_count() <= (rows[i] & low).bit_count():
                i -= 1
            else:
                j -= 1
    return out[::-1]


def align(a: list, b: list) -> list:
    """The least wrapper of this kind that covers both: matched groups in order, others optional."""
    x, y = a[3], b[3]
    names = [g[0] for g in x], [g[0] for g in y]
    if names[0] == names[1]:
        return merged(a, b, [align(p, q) for p, q in zip(x, y, strict=True)])
    kids, i, j = [], 0, 0
    for p, q in [*matches(*names), (len(x), len(y))]:
        kids += [optional(g) for g in (*x[i:p], *y[j:q])]
        if p < len(x):
            kids.append(align(x[p], y[q]))
        i, j = p + 1, q + 1
    return merged(a, b, repeated(kids))


def merged(a: list, b: list, kids: list) -> list:
    return [a[0], multiplicity(a[1], b[1]), a[2] + b[2], kids, a[4] + b[4], sample(a[5], b[5]), sample(a[6], b[6])]


def sample(a: list[int], b: list[int]) -> list[int]:
    """The smallest of both, whatever order pages come in."""
    return a if a == b else sorted({*a, *b})[:SKETCH]


def distinct(hashes: list[int]) -> float:
    """How many different hashes there were, of which these are the smallest."""
    return len(hashes) if len(hashes) < SKETCH else (SKETCH - 1) * 2**32 / (hashes[-1] + 1)


def multiplicity(a: str, b: str) -> str:
    """The least of 1 ? + * that allows what both allow."""
    none, many = a in "?*" or b in "?*", a in "+*" or b in "+*"
    return "*" if none and many else "?" if none else "+" if many else "1"


def optional(g: list) -> list:
    return [g[0], "*" if g[1] in "+*" else "?", *g[2:]]


def mass(w: list) -> int:
    return w[2] + sum(mass(g) for g in w[3])


def links(w: list) -> int:
    return w[4] + sum(links(g) for g in w[3])


def varied(w: list) -> bool:
    """Whether a group's text changes with the page, with every other page at least. One page alone shows nothing, and repeated pages count once."""
    return 2 * distinct(w[5]) > distinct(w[6])


def region(w: list) -> dict:
    """What of a host's pages is left out, by keys from the root: 0 for groups left out, else a further level.

    Groups that are not named are kept, those with a name that means noise only where they are named.
    """
    whole = mass(w)

    def shown(g: list) -> bool:
        return g[0][0] != "~" or varied(g) and mass(g) >= MOST * whole > 0

    def shown_mass(g: list) -> int:
        return g[2] + sum(shown_mass(k) for k in g[3] if shown(k))

    def level(w: list) -> dict:
        groups: dict[str, list] = {}
        for g in w[3]:  # groups of one key are not told apart in pages
            groups[g[0]] = [*(x := align(groups[g[0]], g))[:1], "+", *x[2:]] if g[0] in groups else g
        out: dict = {g[0]: 0 for g in groups.values() if not shown(g) and not varied(g)}
        tag = lambda g: g[0].lstrip("~").split(".")[0]
        kids = [(g, shown_mass(g)) for g in groups.values() if shown(g)]
        if tag(w) in ("article", "main"):
            return out | {g[0]: level(g) for g, _ in kids if g[0][0] == "~"}
        most = MOST * (w[2] + sum(m for _, m in kids))
        outer = any(m >= most > 0 and tag(g) in HOLDER for g, m in kids)
        for g, m in kids:
            listed = outer and m < most and tag(g) in LISTS and links(g) > m
            if listed or not varied(g):
                out[g[0]] = 0
            elif outer and tag(g) in HOLDER and (g[1] in "1?" or tag(g) == "article"):
                if (inner := level(g)) or g[0][0] == "~":
                    out[g[0]] = inner
            elif g[0][0] == "~":
                out[g[0]] = {}
        return out

    return level(w)


def blocks(root: Node, tree: dict, named: bool = False) -> list[str]:
    """Texts of the blocks that the tree leaves, in page order; named: with groups of unclear name, too."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = SPACES.sub(" ", "".join(held)).strip()
        if text:
            out.append(text)
        held.clear()

    todo: list = [(root, tree, False)]
    while todo:
        item, left, done = todo.pop()
        if isinstance(item, str):
            held.append(html.unescape(item))
        elif done:
            flush()
        elif item.tag == "br":
            held.append(" ")
        else:
            if item.tag in BLOCK:
                flush()
                todo.append((item, left, True))
            for k in reversed(item.kids):
                if isinstance(k, str):
                    todo.append((k, left, False))
                    continue
                inner = left.get(k.key, {} if k.noise == 0 or named and k.noise == 1 else 0)
                if inner != 0 and k.noise < 2:
                    todo.append((k, inner, False))
    flush()
    return out


def main_text(page: str, tree: dict | None) -> str:
    root = parse(page)
    found = blocks(root, tree) if tree is not None else []
    if found and sum(map(len, found)) >= (1 - MOST) * sum(map(len, blocks(root, tree, True))):
        return "\n".join(found)
    own = region(wrapper_of(root))
    return "\n".join((found and blocks(root, under(own, tree))) or blocks(root, own) or blocks(root, {}))


def under(own: dict, host: dict) -> dict:
    """A page's own tree, less what its host leaves out."""
    return own | {k: under(own.get(k) or {}, v) if v != 0 else 0 for k, v in host.items()}


#: Groups nested deeper than this, which no template is, are one slot in the wrapper; extraction still reads them one by one.
DEEP = 150


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def template(w: list) -> str:
    """A digest of a wrapper's groups, without what they hold."""
    out, todo = hashlib.md5(), [w]
    while todo:
        g = todo.pop()
        out.update(f"{g[0]}\0{g[1]}\0{len(g[3])}\0".encode("utf-8", "replace"))
        todo += g[3]
    return out.hexdigest()


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (host, wrapper): one JSON wrapper over all pages of a host, whatever tasks they are dealt to."""
    schema = "host string, part long, template string, wrapper string"

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), {}
        for b in batches:
            for h, page in zip(b.host, b.html, strict=True):
                w = wrapper_of(parse(page or ""))
                key = h, template(w)
                held[key] = align(held[key], w) if key in held else w
                if len(held) >= HELD:
                    yield _rows(held, part)
                    held = {}
        if held:
            yield _rows(held, part)

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        """One wrapper of them all. Those of one template add up in any order; others come in the order of their digests."""
        w = None
        for text in g.sort_values("template").wrapper:
            x = json.loads(text)
            w = x if w is None else align(w, x)
        return pd.DataFrame({"host": [g.host.iloc[0]], "part": [g.part.min()], "template": [g.template.min()], "wrapper": [json.dumps(w)]})

    now = stored(pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInPandas(each, schema), "templates")
    # Sums of one template, a fixed number of tasks at a time.
    last = now.agg(F.max("part")).first()[0] or 0
    while True:
        last //= FAN_IN
        now = now.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("host", "template", "part").applyInPandas(fold, schema)
        if not last:
            break
        now = stored(now, "templates")
    # Templates of a host meet by the first bits of their digests, so that each group holds about as many as are folded at once.
    now = stored(now.withColumn("part", F.conv(F.substring("template", 1, 8), 16, 10).cast("long")), "templates")
    most = now.groupBy("host").count().agg(F.max("count")).first()[0] or 1
    bits = 0
    while FAN_IN << bits < most:
        bits += 1
    step = FAN_IN.bit_length() - 1
    now = now.withColumn("part", F.shiftrightunsigned("part", 32 - bits))
    while True:
        now = now.groupBy("host", "part").applyInPandas(fold, schema)
        if not bits:
            return now.select("host", "wrapper")
        down = min(step, bits)
        bits -= down
        now = stored(now, "templates").withColumn("part", F.shiftrightunsigned("part", down))


def _rows(held: dict, part: int) -> pd.DataFrame:
    return pd.DataFrame({"host": [h for h, _ in held], "part": np.full(len(held), part, np.int64), "template": [t for _, t in held], "wrapper": [json.dumps(w) for w in held.values()]})


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars) for every page."""

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"host": b.host.tolist(), "path": [json.dumps(region(json.loads(w))) for w in b.wrapper]})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(page or "", json.loads(p) if isinstance(p, str) else None) for page, p in zip(b.html, b.path, strict=True)]
            yield pd.DataFrame({"page_id": b.page_id.astype("Int64"), "url": pd.Series([u if isinstance(u, str) else None for u in b.url], dtype=object), "text": pd.Series(text, dtype=object), "n_chars": np.array([len(t) for t in text], np.int64)})

    regions = stored(infer_wrappers(pages, url_col, html_col).mapInPandas(paths, "host string, path string"), "regions")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("host"))
    size = regions.agg(F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0))).first()[0]
    if size <= SMALL:
        joined = rows.join(F.broadcast(regions), "host", "left")
    else:  # a host's pages go to many tasks, its region to each of them
        rows = rows.withColumn("salt", F.pmod(F.hash("page_id", "url"), F.lit(SALTS)))
        joined = rows.join(regions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "path").mapInPandas(each, "page_id long, url string, text string, n_chars long")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
