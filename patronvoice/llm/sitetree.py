"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is the path of element names
with their classes and ids, and carries what varies over the pages. Presentation
varies by the sequence of child elements, content by the text of the node's own
blocks. Both are measured by entropy over the pages: text that many pages repeat
is unimportant, text that each page has for itself is important. A branch's
importance is that of its content with a share of its presentation's, and a branch
goes only if every node in it is unimportant; a second tree over all hosts speaks
where too few of the host's own pages have the branch. Copies of a page count once.

Presentation also speaks for itself, as a prior that is added to a block's importance:
element names and roles that mark menus, notices, adverts or forms take much,
classes and ids with such a word take some, an article or main element adds some.
Words in classes do not count on html, body and what holds an article or main
element; beside such an element they count like names. Pages lose the blocks whose sum is low.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from patronvoice.llm.common import BROADCAST_BYTES, fresh, other_columns, register, table
from patronvoice.llm.urlfilter import url_host
from patronvoice.operators.joins import lookup_join
from patronvoice.session import materialize

#: Branches below this importance go; a tree says something once so many pages have the node.
THRESHOLD, MIN_PAGES = 0.6, 8
#: Weight of the content below a node against the node's own presentation.
CONTENT_WEIGHT = 0.9
#: What marks add to the importance of a block, and the importance where no tree says anything.
HINT = 0.2
PRIOR, UNKNOWN = {"noise": -0.4, "hint": -HINT, "": 0.0, "main": 0.2}, 0.75
_SALTS = 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<![^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
_NOISE_TAGS = frozenset("head nav footer aside form button select dialog menu svg canvas object audio video fieldset".split()) | _RAW
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer masthead comment comments respond "
    "reply replies disqus newsletter subscribe subscription signup login share sharing social related recommended pagination pager".split()
)
#: start tags that end an open element of the same group
_ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
_SCOPES = frozenset("ul ol dl table tbody thead tfoot body html article main section div nav aside header footer".split())


@dataclass(eq=False)
class Node:
    """An open element; ``path`` names its place in the style tree."""

    name: str
    path: str
    noise: bool
    main: bool
    inline: bool
    hints: tuple[Node, ...] = ()  # the nodes around, and itself, whose class or id has a noise word
    holds_main: bool = False
    children: list[str] = field(default_factory=list)


@dataclass
class Page:
    """Blocks of text in page order as (path, text, mark), and (path, child names) of every element that is not inline."""

    blocks: list[tuple[str, str, str]] = field(default_factory=list)
    styles: list[tuple[str, str]] = field(default_factory=list)


def _open(name: str, attrs: str, parent: Node | None) -> Node:
    marks, noise, hint, main = "", name in _NOISE_TAGS, False, name in ("article", "main")
    if attrs and "=" in attrs or "hidden" in attrs:
        got = {}
        for key, a, b, c in _ATTR.findall(attrs):
            got.setdefault(key.lower(), a or b or c)
        names = f"{got.get('class', '')} {got.get('id', '')}"
        if names != " ":
            marks = "." + _DIGITS.sub("0", ".".join(names.split()))
            hint = any(p.lower() in _NOISE_WORDS for p in _PARTS.split(names))
        role = got.get("role", "").lower()
        noise |= role in _NOISE_ROLES or "hidden" in got or "display:none" in got.get("style", "").replace(" ", "").lower()
        main |= role in ("main", "article")
    inline = name in _INLINE
    above = parent.path if parent else ""
    inside = bool(parent and parent.main)
    noise |= name == "header" and not inside
    hint &= not main and name not in ("html", "body")
    path = above if inline and not noise and not hint else f"{above}>{name}{marks}" if above else name + marks
    node = Node(name, path, noise or bool(parent and parent.noise), main or inside, inline)
    node.hints = () if main else (*(parent.hints if parent else ()), *([node] if hint else ()))
    node.holds_main = main
    return node


def parse_page(source: str) -> Page:
    """Blocks and styles of a page, however broken; references are decoded, white space is single spaces."""
    page, held, found = Page(), [], []
    root = Node("", "", False, False, False)
    stack = [root]

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                top = stack[-1]
                found.append((text, top))

    def own(node: Node) -> bool:
        return node.noise or node in node.hints[-1:]

    def close() -> None:
        flush() if not stack[-1].inline or own(stack[-1]) else None
        node = stack.pop()
        if not node.inline:
            page.styles.append((node.path, " ".join(c for i, c in enumerate(node.children) if not i or node.children[i - 1] != c)))

    at, end = 0, len(source)
    while at < end:
        token = _TOKEN.match(source, at)
        at = token.end()
        text = token["text"]
        if text is not None:
            held.append(html_module.unescape(text))
            continue
        name = token["name"] or token["name2"]
        if not name:
            continue
        name = name.lower()
        if token["close"] or token["close2"]:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if place:
                while len(stack) > place:
                    close()
            elif name not in _INLINE:
                flush()
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in _RAW:  # its content is no markup
            if not token["close"]:
                tail = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = tail.end() if tail else end
            continue
        if name not in _INLINE:
            flush()
            # an open paragraph, and what is inline in it, ends where a block begins
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == "p" or stack[i].name in _SCOPES), 0)
            if place and stack[place].name == "p":
                while len(stack) > place:
                    close()
            ends = _ENDS.get(name)
            if ends:
                place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in ends or stack[i].name in _SCOPES), 0)
                if place and stack[place].name in ends:
                    while len(stack) > place:
                        close()
        if name in _VOID:
            continue
        if name not in _INLINE:
            stack[-1].children.append(name)
        node = _open(name, token["attrs"] or token["attrs2"] or "", stack[-1])
        if node.inline and own(node) and not stack[-1].noise:
            flush()
        if node.holds_main:
            for outer in stack:
                outer.holds_main = True
        stack.append(node)
    while len(stack) > 1:
        close()
    flush()
    for text, node in found:  # what holds the main element is not known before the end
        hinted = any(not h.holds_main for h in node.hints)
        aside = hinted and root.holds_main and not node.main  # the page says itself that its text is elsewhere
        page.blocks.append((node.path, text, "noise" if node.noise or aside else "hint" if hinted else "main" if node.main else ""))
    return page


def _code(text: str) -> int:
    code = xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return code - (1 << 64) if code >> 63 else code


def tree_features(pages: DataFrame, host_col: str, html_col: str) -> DataFrame:
    """(host, page, whole, features) of every page: how often a node has a text or a sequence of children.

    ``page`` is a digest of the blocks that no mark speaks against, or of all blocks
    where there are none; ``whole`` is one of all blocks and styles.
    """
    kinds = pa.struct([("path", pa.string()), ("content", pa.bool_()), ("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, sources = batch.column(0), batch.column(1)
            for i in range(0, len(batch), 256):
                copies, wholes, features = [], [], []
                for source in sources.slice(i, 256).to_pylist():
                    page = parse_page(source or "")
                    seen = Counter((path, True, _code(text)) for path, text, _ in page.blocks)
                    seen.update({(path, False, _code(style)): 1 for path, style in dict(page.styles).items()})
                    own = [b[:2] for b in page.blocks if b[2] in ("", "main")] or [b[:2] for b in page.blocks]
                    copies.append(_code(repr(own)))
                    wholes.append(_code(repr(sorted(seen.items()))))
                    features.append([{"path": p, "content": c, "code": k, "n": n} for (p, c, k), n in seen.items()])
                columns = [hosts.slice(i, 256), pa.array(copies, pa.int64()), pa.array(wholes, pa.int64()), pa.array(features, pa.list_(kinds))]
                yield pa.RecordBatch.from_arrays(columns, names=["host", "page", "whole", "features"])

    rows = pages.select(F.col(host_col), F.col(html_col))
    schema = "host string, page bigint, whole bigint, features array<struct<path:string,content:boolean,code:bigint,n:bigint>>"
    return rows.mapInArrow(run, schema)


def _importance(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, pages, importance) of every branch from (by, content, t, l): counts of a feature and their sum of n ln n."""
    own = F.col("content")
    log_t = F.col("t") * F.log(F.col("t"))
    nodes = counts.groupBy(*by).agg(
        F.sum(F.when(own, log_t - F.col("l")).otherwise(0.0)).alias("spread"),
        F.sum(F.when(own, F.col("t")).otherwise(0)).alias("texts"),
        F.sum(F.when(~own, log_t).otherwise(0.0)).alias("styles"),
        F.sum(F.when(~own, F.col("t")).otherwise(0)).alias("pages"),
    )
    log_m = F.log(F.col("pages"))
    many = F.col("pages") > 1
    nodes = nodes.select(
        *by,
        "pages",
        "texts",
        F.when(many & (F.col("texts") > 0), 1 - F.col("spread") / (F.col("texts") * log_m)).otherwise(1.0).alias("content"),
        F.when(many, 1 - F.col("styles") / (F.col("pages") * log_m)).otherwise(1.0).alias("style"),
    )
    # the content below a node is that of all paths which go on from it
    names = F.split("path", ">")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, 1, i), ">"))
    below = (
        nodes.where("texts > 0")
        .select(*[c for c in by if c != "path"], F.explode(above).alias("path"), (F.col("content") * F.col("texts")).alias("good"), "texts")
        .groupBy(*by)
        .agg((F.sum("good") / F.sum("texts")).alias("below"))
    )
    mixed = CONTENT_WEIGHT * F.coalesce("below", "style") + (1 - CONTENT_WEIGHT) * F.col("style")
    rated = nodes.join(below, by, "left").select(*by, "pages", mixed.alias("importance"))
    # a branch is as important as the most important node in it
    most = (
        rated.select(*[c for c in by if c != "path"], F.explode(above).alias("path"), "importance")
        .groupBy(*by)
        .agg(F.max("importance").alias("importance"))
    )
    return rated.drop("importance").join(most, by)


def _counts(folded: DataFrame, by: list[str]) -> DataFrame:
    n = F.col("f.n")
    rows = folded.select(*[c for c in by if c == "host"], F.explode("features").alias("f"))
    keys = [F.col("host") if c == "host" else F.col(f"f.{c}").alias(c) for c in [*by, "content", "code"]]
    return rows.groupBy(*keys).agg(F.sum(n).alias("t"), F.sum(n * F.log(n)).alias("l"))


def path_importance(features: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, path, importance) of the branches that at least ``min_pages`` pages of the host, else of all hosts, have.

    Copies of a page count as one, in the host's tree and in that of all hosts, so that
    a text is not taken for a template because its page is repeated.
    """
    one = F.min_by("features", "whole").alias("features")
    folded = materialize(features.groupBy("host", "page").agg(one, F.min("whole").alias("whole")))
    of_all = _importance(_counts(folded.groupBy("page").agg(one), ["path"]), ["path"])
    of_host = _importance(_counts(folded, ["host", "path"]), ["host", "path"])
    known = of_all.where(F.col("pages") >= min_pages).select("path", F.col("importance").alias("of_all"))
    both = of_host.join(known, "path", "left")
    value = F.when(F.col("pages") >= min_pages, F.col("importance")).otherwise(F.col("of_all"))
    return both.select("host", "path", value.alias("importance")).where("importance IS NOT NULL")


def telling_paths(features: DataFrame, **limits) -> DataFrame:
    """(host, paths) with the branches whose importance can change what their mark alone would decide."""
    rated = path_importance(features, **limits)
    rated = rated.where((F.col("importance") < THRESHOLD) | (F.col("importance") >= THRESHOLD + HINT))
    return rated.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "importance"))).alias("paths"))


def is_important(path: str, mark: str, rated: dict[str, float]) -> bool:
    """Whether a block stays: its branch's importance in the tree, shifted by what the marks say."""
    value = rated.get(path)
    while value is None and path:  # a branch that few pages have goes with the one around it
        path = path.rpartition(">")[0]
        value = rated.get(path)
        value = value if value is not None and value < THRESHOLD else None
    return (UNKNOWN if value is None else value) + PRIOR[mark] >= THRESHOLD


def main_text(source: str | None, rated: dict[str, float] | None = None) -> str:
    """The text of the page's important blocks, joined by single spaces.

    ``rated`` has the importance of branches. A page without an important block
    keeps those that no mark speaks against, or else those that only a class or id does.
    """
    blocks = parse_page(source or "").blocks
    kept = [text for path, text, mark in blocks if is_important(path, mark, rated or {})]
    kept = kept or [text for _, text, mark in blocks if mark in ("", "main")] or [text for _, text, mark in blocks if mark == "hint"]
    return " ".join(kept)


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", out_col: str = "text", **limits) -> DataFrame:
    """``pages`` with ``out_col``, the main text, in place of the html; one row per row.

    A null or empty page has an empty text. Pages without a host form a host of
    their own. Repeated pages count once to the statistics. A column already named ``out_col`` is replaced.
    """
    features = tree_features(pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")), "host", "html")
    low = materialize(telling_paths(features, **limits))
    keep = other_columns(pages, html_col, out_col)
    host, body, paths = fresh("_host", pages), fresh("_html", pages), fresh("_paths", pages)
    slim = pages.select(url_host(F.col(url_col)).alias(host), *[F.col(f"`{f.name}`") for f in keep], F.col(html_col).alias(body))
    hosts, size = low.agg(F.count(F.lit(1)), F.sum(F.length(F.array_join(F.map_keys("paths"), ">")) + 16 * F.size("paths"))).first()
    small = low.select(F.col("host").alias(host), F.col("paths").alias(paths))
    if (size or 0) + 64 * hosts <= BROADCAST_BYTES:
        joined = slim.join(F.broadcast(small), host, "left")
    else:
        joined = lookup_join(slim, small, [host], _SALTS)
    schema = T.StructType([*keep, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, dict[str, float]] = {}
        for batch in batches:
            texts = []
            for name, source, low_paths in zip(*(batch.column(i).to_pylist() for i in (0, batch.num_columns - 2, batch.num_columns - 1))):
                if name not in seen:
                    if len(seen) > 1000:
                        seen.clear()
                    seen[name] = dict(low_paths or ())
                texts.append(main_text(source, seen[name]))
            columns = [batch.column(i + 1) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*(f.name for f in keep), out_col])

    return joined.select(host, *[F.col(f"`{f.name}`") for f in keep], body, paths).mapInArrow(run, schema)


@register("op8_site_style_tree")
def op8(spark, folder):
    found = extract_main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
