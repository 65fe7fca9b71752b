"""Operator 8: main text of HTML pages by equivalence-class template deduction.

Every page is cut into tokens: structural ones (the path of open elements) and text blocks (path and text). Over all pages of a host a token has an
occurrence vector, its count on each page. Tokens of equal vectors (up to a constant factor) form an equivalence class; a class is valid if it is found on
most of the host's pages, holds structural tokens, and lies within one gap of every larger class or leaves room for it within one gap of
its own (nesting). Valid classes make the host's template. Its texts are menus, notices, footers and the like; what remains in the slots is page
content, of which elements that by tag, role or class aren't the article are left out. Copies of a page are one page here, or they would make each
other's text a template, and blocks within article or main elements stay even if they stand on every page.

Vectors are never gathered: sums of page hashes times counts stand for them, so a host of any size is one partial aggregate per token. A template holds tokens that
are found on most pages of a host, so it is bounded by the size of its pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.url_filter import host_of
from clausework.llm.util import materialise
from clausework.llm.words import batches

#: A template needs this many different pages of the host; its tokens stand on at least this share of them.
LEAST_PAGES, SUPPORT = 5, 0.8
LEAST_CLASS = 3
#: Templates of up to this many tokens in all are broadcast (about 50 bytes each); more are joined by a shuffle on the host.
BROADCAST_TOKENS = 500_000
#: Hashes of repeated pages up to this many are broadcast (8 bytes each); with more, all pages are dealt by their digest.
BROADCAST_COPIES = 2_000_000

#: Elements whose content is no markup and never text of the article, those that are left out as a region, those that don't end a block, and those without content.
RAW = ("script", "style", "title", "textarea", "iframe")
REGIONS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "head", "noscript", "template", "svg", "canvas"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An opening tag of the key ends open elements of the value, up to the nearest element that is neither.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"}, "h4": {"p"}, "h5": {"p"}, "h6": {"p"}, "ul": {"p"}, "ol": {"p"}, "div": {"p"}, "article": {"p"}, "section": {"p"}, "footer": {"p"}, "header": {"p"}, "nav": {"p"}, "aside": {"p"}, "table": {"p"}, "blockquote": {"p"}, "body": {"head"}}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|promo|promoted|sponsor(?:ed)?|cookies?|consent|gdpr|notices?|alert|comments?|commentlist|disqus|respond|replies|sidebar|side-bar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|masthead|site-header|page-header|topbar|related|recommended|share|sharing|social|newsletter|subscribe|signup|popup|modal|overlay|pagination|pager|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
#: The names that make an article element no article: those of reader comments.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|respond|replies)(?:$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu", "menubar"}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"(?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+>")  # of a tag; quotes count after an equals sign
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


def _hash(*parts: str | int) -> int:
    named = "\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(blake2b(named, digest_size=8).digest(), "little", signed=True)


def markup(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of the page's texts, opening and closing tags, in time linear in the page.

    Comments, declarations and the content of ``RAW`` elements are left out; where they don't end, they take the rest of the page. A ``<`` that no
    ``>`` follows is text, as is one that starts no tag. A tag whose quotes swallow the rest of the page ends at its first ``>``, and
    quotes don't count from there on.
    """
    at, last, quotes = 0, source.rfind(">"), True
    while at < len(source):
        i = source.find("<", at)
        if i < 0 or i > last:
            yield "text", source[at:], ""
            return
        if i > at:
            yield "text", source[at:i], ""
        if source.startswith("<!--", i) or source.startswith("<![CDATA[", i):
            mark = "-->" if source[i + 2] == "-" else "]]>"
            end = source.find(mark, i + 2)
            if end < 0:
                return
            at = end + 3
        elif source[i + 1] in "!?" or source[i + 1] == "/":
            at = source.find(">", i) + 1
            if source[i + 1] == "/" and (m := _NAME.match(source, i + 2)):
                yield "close", m[0].lower(), ""
        elif m := _NAME.match(source, i + 1):
            tag = m[0].lower()
            rest = _REST.match(source, m.end()) if quotes else None
            if not rest:
                quotes = False
            at = rest.end() if rest else source.find(">", i) + 1
            yield "open", tag, source[m.end() : at - 1]
            if tag in _RAW_END:
                end = _RAW_END[tag].search(source, at)
                at = source.find(">", end.end()) + 1 if end else 0
                if not at:
                    return
        else:
            yield "text", "<", ""
            at = i + 1


@dataclass
class Block:
    path: int  # hash of the path of open elements
    text: str
    place: int  # among the page's tokens
    outside: bool  # in an element that isn't article text by its tag, role or name
    article: int  # depth of article or main elements around it


@dataclass(slots=True)
class _Open:
    tag: str
    path: int
    outside: bool
    article: int


def parse(source: str) -> tuple[list[Block], list[tuple[int, int]]]:
    """Text blocks of a page in order, and its structural tokens (path, place). Character references are decoded after tags are cut; a path is hashed from its parent's."""
    stack = [_Open("", 0, False, 0)]
    depth: Counter[str] = Counter()  # of open elements by tag
    blocks: list[Block] = []
    tags: list[tuple[int, int]] = []
    pending: list[str] = []
    place = 0

    def flush():
        nonlocal place
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            pending.clear()
            if text:
                place += 1
                top = stack[-1]
                blocks.append(Block(top.path, text, place, top.outside, top.article))

    for kind, tag, attributes in markup(source):
        if kind == "text":
            pending.append(tag)
        elif kind == "open":
            if tag in ("br", "hr"):
                pending.append(" ")
            if tag in INLINE or tag in VOID:
                continue
            flush()
            ends = ENDS.get(tag)
            if ends:
                while len(stack) > 1 and stack[-1].tag in ends:
                    depth[stack.pop().tag] -= 1
            names, hidden, role = "", False, ""
            if attributes.strip(" /"):
                for k, v in _ATTRIBUTE.findall(attributes):
                    k, v = k.lower(), v.strip("\"'")
                    if k in ("class", "id"):
                        names += " " + v
                    elif k == "role":
                        role = v.lower()
                    elif k == "hidden" and v.lower() != "false" or k == "aria-hidden" and v.lower() == "true":
                        hidden = True
            top = stack[-1]
            outside = top.outside or hidden or tag in REGIONS or role in ROLES or tag not in ("body", "html", "main") and bool(names and (COMMENTS if tag == "article" else NAMES).search(names)) or tag == "header" and not top.article
            deep = top.article + (tag in ("article", "main") or role in ("article", "main"))
            path = _hash(top.path, tag, names)
            place += 1
            tags.append((path, place))
            if tag not in RAW and (not attributes.endswith("/") or tag not in ("p", "div")):
                stack.append(_Open(tag, path, outside, deep))
                depth[tag] += 1
        else:
            if tag in INLINE or tag in VOID:
                continue
            flush()
            if depth[tag]:
                while (top := stack.pop()).tag != tag:
                    depth[top.tag] -= 1
                depth[tag] -= 1
    flush()
    return blocks, tags


def _tokens(blocks: list[Block], tags: list[tuple[int, int]]) -> dict[int, tuple[int, int, bool]]:
    """Token -> (count, first place, structural)."""
    counts: Counter[int] = Counter()
    first: dict[int, tuple[int, bool]] = {}
    for t, place in tags:
        counts[t] += 1
        first.setdefault(t, (place, True))
    for b in blocks:
        t = _hash(b.path, b.text)
        counts[t] += 1
        first.setdefault(t, (b.place, False))
    return {t: (n, *first[t]) for t, n in counts.items()}


def distinct_pages(pages: DataFrame, host: str, source: str, broadcast_copies: int = BROADCAST_COPIES) -> DataFrame:
    """``host, source``: each different page of a host once. Only pages whose hash occurs again are shuffled."""
    rows = pages.select(host, F.coalesce(F.col(source), F.lit("")).alias(source))
    key = F.xxhash64(host, source)
    again = materialise(rows.groupBy(key.alias("_again")).count().where("count > 1").select("_again"), "copies")

    def once(df):
        return df.withColumn("_digest", F.sha2(source, 256)).dropDuplicates([host, "_digest"]).drop("_digest")

    if again.count() > broadcast_copies:
        return once(rows)
    met = F.broadcast(again)
    return rows.join(met, key == F.col("_again"), "left_anti").unionByName(once(rows.join(met, key == F.col("_again"), "left_semi")))


def token_vectors(pages: DataFrame, host: str, source: str) -> DataFrame:
    """``host, token, tag, n_pages, total, v1, v2, place`` over all pages; v1 and v2 stand for the occurrence vector."""
    rows = pages.select(F.col(host).alias("host"), F.col(source).alias("_html"))
    names = ["host", "token", "tag", "n_pages", "total", "v1", "v2", "place"]

    def run(frames):
        for batch, column in batches(frames, "_html"):
            sums: dict[tuple, list] = {}  # of this slice, before the shuffle
            for h, text in zip(batch.column("host").to_pylist(), column.to_pylist(), strict=True):
                page = _hash(text)
                a, b = page & 0x3FFFFFFF, (page >> 32) & 0x3FFFFFFF
                found = _tokens(*parse(text))
                found[0] = (1, 0, True)  # the page itself
                for t, (n, place, tag) in found.items():
                    s = sums.setdefault((h, t, tag), [0, 0, 0, 0, 0])
                    s[0] += 1
                    s[1] += n
                    s[2] += a * n
                    s[3] += b * n
                    s[4] += place
            cols = list(zip(*((h, t, tag, *s) for (h, t, tag), s in sums.items())))
            kinds = (pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols or [[]] * 8, kinds, strict=True)], names)

    made = rows.mapInArrow(run, "host string, token long, tag boolean, n_pages long, total long, v1 long, v2 long, place long")
    return made.groupBy("host", "token", "tag").agg(*[F.sum(c).alias(c) for c in names[3:]])


def templates(vectors: DataFrame) -> DataFrame:
    """``host, tokens``: struct(token, tag, class, place) of the valid equivalence classes, before the nesting check. One row per host that has one; a null host has none, and no vectors give no rows."""
    pages = vectors.where("token = 0").select("host", F.col("n_pages").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    likely = vectors.where((F.col("token") != 0) & (F.col("n_pages") >= SUPPORT * LEAST_PAGES))  # what stands on single pages stays out of the join
    found = likely.join(pages, "host").where(F.col("n_pages") >= SUPPORT * F.col("pages"))
    k = F.when((F.col("total") % F.col("n_pages") == 0), (F.col("total") / F.col("n_pages")).cast("long")).otherwise(1)
    k = F.when((F.col("v1") % k == 0) & (F.col("v2") % k == 0), k).otherwise(1)
    found = found.withColumn("k", k).withColumn("class", F.xxhash64("n_pages", F.expr("v1 div k"), F.expr("v2 div k"))).withColumn("place", F.col("place") / F.col("n_pages"))
    classes = found.groupBy("host", "class", "n_pages").agg(F.count("*").alias("size"), F.count_if("tag").alias("tags"), F.collect_list(F.struct("token", "tag", "place")).alias("tokens"))
    valid = classes.where((F.col("size") >= LEAST_CLASS) & (F.col("tags") > 0))
    return valid.groupBy("host").agg(F.collect_list(F.struct("n_pages", "class", "tokens")).alias("classes"), F.sum("size").alias("tokens"))


def nested(classes: list) -> set[int]:
    """Text tokens of the classes that nest: from the most frequent on, a class lies in one gap of each accepted class, or an accepted one in one of its gaps."""
    accepted: list[list[float]] = []
    out: set[int] = set()
    for c in sorted(classes, key=lambda c: (-c["n_pages"], -len(c["tokens"]), c["class"])):
        places = sorted(t["place"] for t in c["tokens"])

        def within(inner, outer):
            return not any(inner[0] < p < inner[-1] for p in outer)

        if all(within(places, a) or within(a, places) for a in accepted):
            accepted.append(places)
            out |= {t["token"] for t in c["tokens"] if not t["tag"]}
    return out


def main_text(source: str, template: set[int]) -> str:
    """Text of the article of one page. With article or main elements in the page, only they count, whole but for regions; without any, everything that no region or template holds."""
    blocks, _ = parse(source)
    kept = [b for b in blocks if not b.outside and (b.article or not template or _hash(b.path, b.text) not in template)]
    if any(b.article for b in kept):
        kept = [b for b in kept if b.article]
    return " ".join(b.text for b in kept)


def extract(pages: DataFrame, source: str = "html", url: str = "url", keep: list[str] | None = None, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """``pages`` (or its columns ``keep``) with ``text`` appended (a column of that name is replaced).

    Null or empty html gives an empty text; null URLs share the empty host. Pages of hosts with fewer than ``LEAST_PAGES`` different pages are judged by their elements
    alone. Ids play no part; repeated rows count as one page and get equal texts; an empty table gives no rows.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c != "text"]
    names = [f"_{i}" for i in range(len(keep))]
    rows = pages.select(*[F.col(c).alias(a) for c, a in zip(keep, names, strict=True)], host_of(F.col(url)).alias("_host"), F.col(source).alias("_html"))
    made = materialise(templates(token_vectors(distinct_pages(rows, "_host", "_html"), "_host", "_html")), "templates")
    size = made.agg(F.coalesce(F.sum("tokens"), F.lit(0))).head()[0]
    made = made.select(F.col("host").alias("_of"), "classes")
    joined = rows.join(F.broadcast(made) if size <= broadcast_tokens else made, F.col("_host") == F.col("_of"), "left").drop("_of")

    def run(frames):
        known: dict[str, set[int]] = {}
        for batch, column in batches(frames, "_html"):
            texts = []
            classes = batch.column("classes")
            for i, (h, t) in enumerate(zip(batch.column("_host").to_pylist(), column.to_pylist(), strict=True)):
                if h not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[h] = nested(classes[i].as_py() or [])
                texts.append(main_text(t, known[h]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], [*names, "text"])

    schema = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in names], "text string"])
    return joined.mapInArrow(run, schema).select(*[F.col(a).alias(c) for c, a in zip(keep, names, strict=True)], "text")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))
