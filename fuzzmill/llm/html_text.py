"""Main text of web pages by a site style tree.

1. ``parse`` reads a page of any quality (unclosed and misnested tags, raw
   scripts, stray brackets) into block elements and text blocks.
2. The pages of a host are merged into its style tree: an element is the
   same node on two pages if it has the same place, that is the same parent
   node, the same sequence of sibling labels (runs of paragraphs, list
   items and table cells count once) and the same position in it.  Each page gives a node one
   presentation (the sequence of its children) and each text block one
   feature (its text).
3. With m pages at a node, presentations seen on c_i of them and features
   on d_i of them:

       presentation importance = -sum (c_i/m) log_m (c_i/m)
       content importance      = mean over features below it of 1 - log_m d_i
       importance = (1 - 0.9^l) presentation + 0.9^l content

   where l is the number of presentations.  What looks and reads alike on
   all pages has importance near 0.
4. Branches of low importance go from each page.

Part of the chrome does not repeat on its host: a host of some pages shows
each of a pool of adverts about once, and readers' comments are as varied as
articles.  So importance is weighted by what the page itself declares:
elements whose tag, role, class or id names them as menu, header, footer,
sidebar, notice, advert, form or comments weigh 0; and where a page marks
its article (``article``, ``main``, or a class of that name), all outside of
it weighs 0, and inside it only what is practically constant is removed.
A page never loses all its text to importance alone.

Statistics are sums by (node, presentation) and (node, feature), combined
in each batch before the shuffle, so a host with a third of all pages is no
task of its own; nodes never meet in one place.  Nodes of low importance
are broadcast while they are few (checked), else joined by host and salt.

Null or empty html gives an empty text; a null url is a host of its own.
Repeated rows are separate pages with a result row each.  Nodes deeper than
64 levels are counted with their ancestor there; their text is kept like any
other.  Very long pages are parsed in one go, in memory linear in their
size.  Extra columns are not read, an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import sliced, stored, table

#: Weight of deeper content, per presentation of a node.
DAMPING = 0.9
#: Importance below which a branch goes, outside and inside a marked article.
LEAST, LEAST_INSIDE = 0.3, 0.05
#: Pages that a node needs before it is judged.
LEAST_PAGES = 8
DEEPEST = 64
#: Rows of low-importance nodes that may be broadcast.
FEW_NODES = 200_000
SALTS = 64

# HTML elements by kind.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr li legend main menu nav ol optgroup option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
IGNORED = frozenset("html head body".split())
#: Start tag: (elements that it closes, elements beyond which it does not look).
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dd": (("dd", "dt"), ("dl",)),
    "dt": (("dd", "dt"), ("dl",)),
    "option": (("option",), ("select",)),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
}
#: Runs of these count as one in a sequence of siblings.
REPEATED = frozenset("blockquote dd dt figure h2 h3 h4 h5 h6 li p pre td th tr".split())
#: End tags do not reach beyond these.
WALLS = frozenset("td th caption table".split())
TABLE = frozenset("table tbody thead tfoot tr td th caption".split())

# What a page may declare about an element.
HIDDEN_TAGS = frozenset(
    "button canvas datalist input label math noscript object optgroup option select svg template audio video dialog".split()
)
CHROME_TAGS = frozenset("nav aside footer form menu fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion teaser related recommended recommendations".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsense adbox alert banner breadcrumb breadcrumbs colophon "
    "consent cookie cookies copyright footer gdpr login menu menubar modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup promo promotion rail share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription toast toolbar topbar widget widgets".split()
)
HEADER_WORDS = frozenset("header masthead".split())
ARTICLE_WORDS = frozenset("article content entry main post story".split())
ARTICLE_CLASSES = frozenset(
    "article main content post entry story article-body article-content articlebody entry-content main-content post-body post-content".split()
)

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|</?([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE) for name in RAW}
#: What a page declares: nothing, chrome that a marked article overrules, chrome for good.
PLAIN, CHROME, GONE = 0, 1, 2


def _declared(name: str, attributes: str) -> tuple[int, str, int]:
    """(declaration, label, rank of a marked article: 1 best, 0 none)."""
    found = {k.lower(): v.strip("\"'") for k, v in reversed(ATTRIBUTE.findall(attributes))} if len(attributes) > 1 else {}
    rank = 1 if name == "article" else 2 if name == "main" else 0
    if not found:
        kind = GONE if name in HIDDEN_TAGS else CHROME if name in CHROME_TAGS else PLAIN
        return kind, name, rank
    classes = f"{found.get('class', '')} {found.get('id', '')}"
    words = {w.lower() for w in NAME_PART.findall(classes)}
    label = name + "." + re.sub(r"\d+", "0", found.get("class", "").lower())
    kind = PLAIN
    if name in HIDDEN_TAGS or words & COMMENT_WORDS or "hidden" in found or found.get("aria-hidden") == "true":
        kind = GONE
    elif re.search(r"display\s*:\s*none", found.get("style", "")):
        kind = GONE
    elif name in CHROME_TAGS or found.get("role", "").lower() in CHROME_ROLES or words & CHROME_WORDS:
        kind = CHROME
    elif words & HEADER_WORDS and not words & ARTICLE_WORDS:
        kind = CHROME
    if kind != PLAIN:
        return kind, label, 0 if kind == GONE else rank
    if not rank and found.get("role", "").lower() == "main":
        rank = 2
    if not rank and {c.lower() for c in classes.split()} & ARTICLE_CLASSES:
        rank = 3
    return kind, label, rank


class Page:
    """Block elements (by number, parents first; 0 is the page) and text
    blocks (element, text) in page order."""

    def __init__(self, html: str):
        self.name, self.parent, self.kind, self.label, self.rank = ["html"], [-1], [PLAIN], ["html"], [0]
        self.blocks: list[tuple[int, str]] = []
        self._read(html)

    def _read(self, html: str) -> None:
        name, parent, kind, label, rank, blocks = self.name, self.parent, self.kind, self.label, self.rank, self.blocks
        stack: list[tuple[str, int, bool]] = []  # open elements: name, block element that is current inside, unseen
        opened: Counter = Counter()
        at = unseen = pos = 0
        pieces: list[str] = []

        def flush() -> None:
            if pieces:
                text = " ".join("".join(pieces).split())
                pieces.clear()
                if text:
                    blocks.append((at, text))

        def close(depth: int) -> None:
            """Close the open elements from ``depth`` on."""
            nonlocal at, unseen
            for n, _, u in stack[depth:]:
                opened[n] -= 1
                unseen -= u
            del stack[depth:]
            at = stack[-1][1] if stack else 0

        def innermost(wanted: tuple, walls) -> int:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] in wanted:
                    return d
                if stack[d][0] in walls:
                    break
            return -1

        end = len(html)
        for m in iter(lambda: TOKEN.search(html, pos), None):
            if m.start() > pos and not unseen:
                text = html[pos : m.start()]
                pieces.append(unescape(text) if "&" in text else text)
            pos = m.end()
            tag = m.group(1)
            if tag is None:
                continue
            tag = tag.lower()
            if html[m.start() + 1] == "/":
                if tag in BLOCKS:
                    flush()
                    if opened[tag] > 0:
                        d = innermost((tag,), ("table",) if tag in TABLE and tag != "table" else () if tag == "table" else WALLS)
                        if d >= 0:
                            close(d)
                elif tag == "br":
                    pieces.append(" ")
                elif opened[tag] > 0:
                    d = innermost((tag,), BLOCKS)
                    if d >= 0:
                        close(d)
                continue
            if tag in RAW:
                stop = RAW_ENDS[tag].search(html, pos)
                pos = stop.end() if stop else end
                continue
            if tag in IGNORED:
                continue
            if tag in VOID:
                if tag == "br":
                    pieces.append(" ")
                elif tag == "hr":
                    flush()
                continue
            said, mark, best = _declared(tag, m.group(2)[:-1])
            if tag not in BLOCKS:
                gone = said != PLAIN
                if gone or opened[tag] < 512:  # thousands of unclosed inline tags change nothing
                    stack.append((tag, at, gone))
                    opened[tag] += 1
                    unseen += gone
                continue
            flush()
            if opened["p"] > 0:
                d = innermost(("p",), BLOCKS)
                if d >= 0:
                    close(d)
            if tag in CLOSES:
                wanted, walls = CLOSES[tag]
                while any(opened[w] > 0 for w in wanted) and (d := innermost(wanted, walls)) >= 0:
                    close(d)
            name.append(tag)
            parent.append(at)
            kind.append(CHROME if tag == "header" and said == PLAIN else said)
            label.append(mark)
            rank.append(best)
            at = len(name) - 1
            stack.append((tag, at, False))
            opened[tag] += 1
        if pos < end and not unseen:
            text = html[pos:]
            pieces.append(unescape(text) if "&" in text else text)
        flush()

    def shape(self, host: str) -> tuple[list[int], dict[int, set[int]]]:
        """(style tree node of each element, presentations of each node)."""
        from xxhash import xxh64_intdigest

        kids: list[list[tuple[int, str]]] = [[] for _ in self.name]
        for i in range(1, len(self.name)):
            kids[self.parent[i]].append((i, self.label[i]))
        node = [0] * len(self.name)
        depth = [0] * len(self.name)
        node[0] = xxh64_intdigest(host) >> 1
        looks: dict[int, set[int]] = {}
        for i, own in enumerate(kids):
            row: list[str] = []
            places = []
            for k, mark in own:
                if not row or row[-1] != mark or self.name[k] not in REPEATED:
                    row.append(mark)
                places.append(len(row))
            look = "|".join(row)
            looks.setdefault(node[i], set()).add(xxh64_intdigest(look) >> 1)
            held: dict[int, int] = {}
            for (k, _), place in zip(own, places):
                depth[k] = depth[i] + 1
                if depth[k] > DEEPEST:
                    node[k] = node[i]
                    continue
                if place not in held:
                    held[place] = xxh64_intdigest(f"{node[i]} {place} {look}") >> 1
                node[k] = held[place]
        return node, looks

    def kept(self, low: dict[int, float], node: list[int]) -> list[str]:
        """The text blocks that stay, given the importance of the host's
        low-importance nodes."""
        n = len(self.name)
        marks = [0] * n  # best rank of a marked article inside
        forms = set()
        for i in range(n - 1, 0, -1):
            up = self.parent[i]
            for r in (self.rank[i], marks[i]):
                if r and r < 3 and self.kind[i] != GONE and (not marks[up] or r < marks[up]):
                    marks[up] = r
            if self.name[i] == "h1" or i in forms:
                forms.add(up)
        gone = [False] * n
        inside = [[0, 0, 0, 0] for _ in range(n)]  # the outermost marked article of each rank above
        for i in range(1, n):
            up = self.parent[i]
            kind = self.kind[i]
            if kind == CHROME and (marks[i] or self.rank[i] in (1, 2)):
                kind = PLAIN  # a wrapper of the article
            if kind == CHROME and self.name[i] == "form" and i in forms:
                kind = PLAIN  # a form around the whole page
            if self.name[i] == "header" and (inside[up][1] or inside[up][2]):
                kind = PLAIN  # the article's own title
            gone[i] = gone[up] or kind != PLAIN
            inside[i] = list(inside[up])
            if self.rank[i] and not gone[i] and not inside[i][self.rank[i]]:
                inside[i][self.rank[i]] = i
        stay = [(i, text) for i, text in self.blocks if not gone[i]]
        rank = next((r for r in (1, 2, 3) if any(inside[i][r] for i, _ in stay)), 0)
        if rank:
            stay = [(i, text) for i, text in stay if inside[i][rank]]
        if low:
            least = LEAST_INSIDE if rank in (1, 2) else LEAST
            unimportant = [False] * n
            for i in range(1, n):
                beneath = not rank or (inside[i][rank] and inside[i][rank] != i)
                unimportant[i] = unimportant[self.parent[i]] or bool(beneath and low.get(node[i], 1.0) < least)
            rest = [(i, text) for i, text in stay if not unimportant[i]]
            stay = rest or stay
        return [text for _, text in stay]


def host_of(url: Column) -> Column:
    """Lower-case host of a URL (null or none: empty)."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


COUNTED = "host STRING, node BIGINT, feature BOOLEAN, value BIGINT, path BINARY, n BIGINT"


def tree_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages by (node, presentation) and (node, text), partly summed; a
    text's row holds the path of nodes above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in sliced(batches):
            seen: Counter = Counter()
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                page = Page(html or "")
                node, looks = page.shape(host)
                for k, found in looks.items():
                    look = min(found) if len(found) == 1 else xxh64_intdigest(repr(sorted(found))) >> 1
                    seen[host, k, False, look, None] += 1
                paths: dict[int, bytes] = {}
                for i, text in set(page.blocks):
                    if i not in paths:
                        way, k = [], i
                        while k >= 0:
                            if not way or way[-1] != node[k]:
                                way.append(node[k])
                            k = page.parent[k]
                        paths[i] = struct.pack(f">{len(way)}q", *way)
                    seen[host, node[i], True, xxh64_intdigest(text) >> 1, paths[i]] += 1
            if seen:
                cols = list(zip(*seen))
                kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
                out = [pa.array(c, t) for c, t in zip(cols, kinds)] + [pa.array(list(seen.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in COUNTED.split(", ")])

    return pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(run, COUNTED)


def importances(counts: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of the style trees of all hosts."""
    each = counts.groupBy("host", "node", "feature", "value").agg(F.sum("n").alias("n"), F.min("path").alias("path"))
    n = F.col("n").cast("double")
    look = ~F.col("feature")
    nodes = each.groupBy("host", "node").agg(
        F.sum(F.when(look, F.col("n"))).alias("pages"),
        F.count(F.when(look, 1)).alias("looks"),
        F.sum(F.when(look, n * F.log(n))).alias("look_logs"),
        F.count(F.when(~look, 1)).alias("texts"),
        # several equal texts of a page stand at one node at most `pages` times
        F.sum(F.when(~look, F.log(n))).alias("text_logs"),
        F.min("path").alias("path"),
    )
    nodes = stored(nodes, "style-nodes")
    log_m = F.log(F.greatest(F.col("pages"), F.lit(2)).cast("double"))
    shown = nodes.select(
        "host",
        "node",
        "pages",
        "looks",
        F.when(F.col("pages") > 1, 1 - F.col("look_logs") / (F.col("pages") * log_m)).otherwise(1.0).alias("shown"),
        F.lit(0).cast("long").alias("texts"),
        F.lit(0.0).alias("spread"),
    )
    # the texts of each node count for every node above it
    steps = F.expr("transform(sequence(0, length(path) div 8 - 1), i -> CAST(conv(hex(substring(path, i * 8 + 1, 8)), 16, 10) AS BIGINT))")
    below = nodes.where("texts > 0").select(
        "host",
        F.explode(steps).alias("node"),
        F.lit(None).cast("long").alias("pages"),
        F.lit(None).cast("long").alias("looks"),
        F.lit(None).cast("double").alias("shown"),
        "texts",
        F.least(F.col("text_logs") / log_m, F.col("texts").cast("double")).alias("spread"),
    )
    whole = shown.unionByName(below).groupBy("host", "node").agg(
        F.max("pages").alias("pages"), F.max("looks").alias("looks"), F.max("shown").alias("shown"),
        F.sum("texts").alias("texts"), F.sum("spread").alias("spread"),
    )
    deep = F.pow(F.lit(DAMPING), F.col("looks").cast("double"))
    content = 1 - F.col("spread") / F.col("texts")
    both = F.when(F.col("texts") > 0, (1 - deep) * F.col("shown") + deep * content).otherwise(F.col("shown"))
    return whole.select("host", "node", "pages", both.alias("importance"))


def low_nodes(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, low ARRAY<STRUCT<node, importance>>) of hosts that have any
    node of low importance."""
    low = importances(tree_counts(pages, url_col, html_col)).where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST))
    return stored(low.groupBy("host").agg(F.collect_list(F.struct("node", "importance")).alias("low")), "style-low")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", few: int = FEW_NODES) -> DataFrame:
    """(id, url, text, n_chars): the main text of every page."""
    low = low_nodes(pages, url_col, html_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    if low.agg(F.coalesce(F.sum(F.size("low")), F.lit(0))).first()[0] <= few:
        rows = rows.join(F.broadcast(low), "host", "left")
    else:  # hot hosts spread over salts
        salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("id", "url", "html"), F.lit(SALTS)).cast("int")
        rows = rows.withColumn("salt", salt).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2):
            texts = []
            for html, host, found in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                page = Page(html or "")
                known = {r["node"]: r["importance"] for r in found or []}
                texts.append("\n".join(page.kept(known, page.shape(host)[0] if known else [])))
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, url_col, "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select("id", "url", "html", "host", "low").mapInArrow(
        run, f"`{id_col}` {kind['id']}, `{url_col}` {kind['url']}, text STRING, n_chars BIGINT"
    )


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
