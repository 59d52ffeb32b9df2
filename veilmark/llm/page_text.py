"""Main text of web pages by site style trees.

The pages of one host are merged into a tree of styles: a node is a path of element signatures (tag, role
and class words without digits), known by a hash. A node's content importance is the mean of 1 - log_m(df) over its
texts, with m pages that have the node and df pages that have the text there (a text that all pages share says
nothing); its presentation importance is the entropy of its child sequences. On each page the importance of an
element is the mean of its texts', by length, raised by its presentation; branches under `least` are removed,
whatever they are called and wherever they stand, inside an article as well; only what holds the article or its heading isn't removed as a whole.

What varies from page to page in spite of being no article (menus, adverts, forms, comments) the tree can't tell, so
elements that say what they are have a prior that their texts must pass first: tags such as nav and footer, roles, and class names that
consist of such words only ("share-buttons", not "share-capital"). An element that holds an article, or over half of
the page's text, isn't judged by its names; inside an article only unmistakable names count.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import cut

#: A quote counts only behind an equals sign; elsewhere in a tag it is a sign like others.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^<>\"'=]+|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "template", "svg", "iframe")}
BODY = re.compile(r"<body|</head", re.I)
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address header footer nav aside form fieldset details summary hr center noscript".split())
#: What an opening tag ends, and what that search stops at.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCKS - frozenset("li dt dd tr td th thead tbody tfoot caption summary figcaption html body noscript".split())
#: Elements that are no article's text: those that never are, and those that a whole page can stand in.
NEVER = frozenset("nav footer aside button select option dialog menu label input".split())
MAYBE = frozenset("form noscript header".split())
CORE = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Elements whose names count.
NAMED = frozenset("div section ul ol li dl table aside form header footer article details figure".split())
#: Words of names that tell what isn't the article everywhere, those that tell it outside of articles, and words that may stand beside them.
PLAIN = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos nav navbar navigation menu menus
breadcrumb breadcrumbs pagination pager sidebar sidebars topbar toolbar masthead cookie cookies consent gdpr popup modal overlay newsletter
subscribe subscription signup login signin share sharing social comment comments commentlist disqus respond replies searchbox""".split())
OUTSIDE = frozenset("""banner aside footer foot header notice notices alert promotion register related recommended recommendations trending widget widgets
copyright legal disclaimer reply discussion reactions search form hidden skip""".split())
BESIDE = frozenset("""area bar block body bottom box btn button buttons col container content desktop field fields fixed global group holder icon icons inline inner
item items left link links list main media mobile module outer page panel post posts primary right row secondary section site slot sticky text thread
title to toggle top unit wrap wrapper zone""".split())
NOT_LETTERS = re.compile(r"[^a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Node:
    """path: a hash of the signatures from the root; children: a hash of the children's; size: characters of text inside."""

    __slots__ = ("parent", "tag", "path", "children", "inside", "never", "maybe", "core", "size", "prior", "holder")

    def __init__(self, parent: Node | None, tag: str, attributes: str):
        self.parent, self.tag, self.children, self.size, self.prior, self.holder = parent, tag, 0, 0, True, True
        self.inside = parent is not None and (parent.inside or parent.core)
        self.never, self.maybe = tag in NEVER, tag in MAYBE and not (tag == "header" and self.inside)
        words, role, plain = (), "", False
        if attributes and attributes != "/":
            found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
            names = [NOT_LETTERS.split(CAMEL.sub(" ", t).lower()) for t in f"{found.get('class', '')} {found.get('id', '')}".split()]
            words = sorted({w for name in names for w in name if w})
            role = found.get("role", "").lower()
            self.never |= role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            if tag in NAMED:
                plain = any(not PLAIN.isdisjoint(name) and all(w in PLAIN or w in OUTSIDE or w in BESIDE or len(w) < 3 for w in name) for name in names)
                self.maybe |= plain or not self.inside and any(not OUTSIDE.isdisjoint(name) and all(w in OUTSIDE or w in BESIDE or len(w) < 3 for w in name) for name in names)
        self.core = tag in CORE and not plain and not self.never
        own = f"{tag}.{'.'.join(words)}.{role}" if words or role else tag
        self.path = _hash(f"{parent.path}/{own}" if parent else own)
        if parent:
            parent.children = _hash(f"{parent.children}|{own}")


def ancestors(node: Node | None) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def parse(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """All elements with their priors, and the text blocks with the element they stand in, in page order. Linear in the page but for end tags that nothing opened."""
    root = Node(None, "root", "")
    stack, nodes, blocks, text = [root], [root], [], []

    def flush() -> None:
        if text:
            words = SPACE.sub(" ", "".join(text)).strip()
            text.clear()
            if words:
                node = stack[-1]
                while node.tag not in BLOCKS and node.parent and not node.never:
                    node = node.parent
                node.size += len(words)
                blocks.append((node, words))

    def close(k: int) -> None:
        if any(n.tag in BLOCKS or n.never for n in stack[k:]):
            flush()
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            s = page[at : m.start()]
            text.append(html.unescape(s) if "&" in s else s)
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            else:
                if tag in BLOCKS:
                    flush()
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = RAW[tag].search(page, at)
                at = end.end() if end else n
            continue
        if tag == "head":
            end = BODY.search(page, at)
            at = end.start() if end else at
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img"):
                text.append(" ")
            continue
        ends, stop = ENDS.get(tag, ((), ()))
        if tag in ENDS_P:
            ends, stop = {"p"}, {"div", "article", "section", "td", "li", "body", "blockquote", "button"}
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in ends:
                close(k)
                break
            if stack[k].tag in stop:
                break
        if tag in BLOCKS:
            flush()
        node = Node(stack[-1], tag, m[3])
        if node.never and tag not in BLOCKS:
            flush()
        stack.append(node)
        nodes.append(node)
    flush()
    judge(nodes)
    return nodes, blocks


def judge(nodes: list[Node]) -> None:
    """Sets each element's prior: whether its own and its ancestors' tags, roles and names let it be an article's; and whether it holds the article or its heading."""
    holds, titled = set(), set()
    for n in reversed(nodes[1:]):  # children come behind their parents
        n.parent.size += n.size
        if n.core or n in holds:
            holds.add(n.parent)
        if n.tag == "h1" or n in titled and not n.never:
            titled.add(n.parent)
    most = nodes[0].size / 2
    for n in nodes[1:]:
        bad = n.never and n not in holds or n.maybe and not (n in holds or n.size > most or n in titled and n.tag != "form" or n.tag in ("html", "body"))
        n.prior = n.parent.prior and not bad
        n.holder = n.core or n in holds or n in titled or n.tag in ("html", "body")


def pruned(nodes: list[Node], blocks: list[tuple[Node, str]], importance: dict[int, float], styles: dict[int, float], least: float) -> list[str]:
    """The texts that pass the priors and stand in no branch of low importance; where there would be none, those that pass the priors."""
    passed = [(n, s) for n, s in blocks if n.prior]
    if not importance:
        return [s for _, s in passed]
    weight, total = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0.0)
    for n, s in passed:
        weight[n] += len(s)
        total[n] += len(s) * importance.get(n.path, 1.0)
    for n in reversed(nodes[1:]):
        weight[n.parent] += weight[n]
        total[n.parent] += total[n]
    low: set[Node] = set()
    for n in nodes:
        if n.parent in low:
            low.add(n)
        elif weight[n] and not n.holder:
            mean = total[n] / weight[n]
            if mean + 0.1 * styles.get(n.path, 1.0) * (1 - mean) < least:
                low.add(n)
    rich = [s for n, s in passed if n not in low and importance.get(n.path, 1.0) + 0.1 * styles.get(n.path, 1.0) * (1 - importance.get(n.path, 1.0)) >= least]
    return rich or [s for _, s in passed]


def features(page: str) -> set[tuple[int, int, int]]:
    """What a page adds to its host's tree: (path, text, 0) of its blocks that pass the priors, (path, child sequence, 1) and (path, 0, 2) of the elements that hold one."""
    nodes, blocks = parse(page)
    passed = [(n, s) for n, s in blocks if n.prior]
    held = {n for n, _ in passed}
    rows = {(n.path, _hash(s), 0) for n, s in passed}
    for n in reversed(nodes):
        if n in held:
            rows |= {(n.path, n.children, 1), (n.path, 0, 2)}
            if n.parent:
                held.add(n.parent)
    return rows


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - 2**63


def _host(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def style_tree(pages: DataFrame, url_col: str, html_col: str, pages_needed: int) -> DataFrame:
    """host, path, content, style: the importance of each path that at least `pages_needed` pages of its host have, from all pages.

    Equal pages of a host count once. Rows gathered: one a page and distinct text or child sequence, of
    four numbers; the counts are summed before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if page:
                    mark = _hash(page)
                    for path, content, kind in features(page):
                        for column, value in zip(out, (host, path, content, kind, mark)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:])], ["host", "path", "content", "kind", "page"])

    leaves = pages.select(_host(F.col(url_col)).alias("host"), html_col).filter("host != ''").mapInArrow(run, "host string, path bigint, content bigint, kind bigint, page bigint")
    seen = leaves.distinct().groupBy("host", "path", "kind", "content").agg(F.count(F.lit(1)).alias("df"))
    # Both importances are ratios of sums over the counts, which add up before the shuffle.
    of_kind = lambda k, e: F.sum(F.expr(f"CASE WHEN kind = {k} THEN {e} ELSE 0 END"))
    sums = seen.groupBy("host", "path").agg(of_kind(2, "df").alias("m"), of_kind(1, "df").alias("c"), of_kind(1, "df * ln(df)").alias("c_ln"), of_kind(0, "df").alias("n"), of_kind(0, "df * ln(df)").alias("n_ln")).filter(f"m >= {pages_needed}")
    return sums.select("host", "path", F.expr("CASE WHEN n > 0 THEN 1 - n_ln / (n * ln(m)) ELSE 1.0D END").alias("content"), F.expr("1 - c_ln / (c * ln(c))").alias("style"))


def main_text(pages: DataFrame, least: float = 0.3, pages_needed: int = 4, few: int = 200_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", spread: int = 16) -> DataFrame:
    """page id, url, text and n_chars (code points) for every row.

    Blocks with white space as one space, trimmed, joined by one line feed, in page order; references decoded. A null or
    empty page gives an empty text; a null url has no host and is judged by its own elements alone; so is a page of which the tree would leave
    nothing. Repeated rows stay, other columns go, an empty table gives an empty one. The importances are broadcast if they are at
    most `few` rows of three numbers; else pages are dealt out by host and a number up to `spread`, so that a host with a third of all
    pages meets its tree in many tasks.
    """
    tree = cut(style_tree(pages, url_col, html_col, pages_needed))
    small = tree.limit(few + 1).count() <= few
    of_host = tree.groupBy("host").agg(F.collect_list(F.struct("path", "content", "style")).alias("tree")).select("host", *(F.col(f"tree.{c}").alias(c) for c in ("path", "content", "style")))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", _host(F.col("url")))
    if small:
        rows = rows.join(F.broadcast(of_host), "host", "left")
    else:
        of_host = of_host.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id", F.length("html")), F.lit(spread)).cast("int")).join(of_host, ["host", "part"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, hosts = [], b.column(3).to_pylist()
            known: dict[str, tuple[dict, dict]] = {}
            for k, page in enumerate(b.column(2).to_pylist()):
                if not page:
                    texts.append("")
                    continue
                if hosts[k] not in known:
                    path = b.column(4)[k].as_py() or ()
                    known[hosts[k]] = dict(zip(path, b.column(5)[k].as_py() or ())), dict(zip(path, b.column(6)[k].as_py() or ()))
                texts.append("\n".join(pruned(*parse(page), *known[hosts[k]], least)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, "url", "text", "n_chars"])

    return rows.select("id", "url", "html", "host", "path", "content", "style").mapInArrow(run, f"{id_col} {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars bigint")
