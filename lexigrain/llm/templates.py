"""Main text of web pages by template deduction.

A page is cut into tokens: its tags with their path of open elements, and its text blocks with the path
they stand in. A token's occurrence vector tells how often it occurs on each page of its host; tokens of
a host with the same vector form an equivalence class. Vectors are compared by their support and a sum of
hashes of (page, count), which adds up with map-side combining, so no host is ever gathered in one task.
A class is valid if it has at least ``MIN_TOKENS`` tokens, a tag among them, and occurs on at least
``MIN_PAGES`` different pages and ``MIN_SHARE`` of the host's; valid classes nest into the host's template
by the elements around their tokens. Text tokens of the template are its fixed words; everything else on
a page fills its slots.

Which slots are the article follows from where they stand: if a page marks its article (``article``,
``main``), the slots in it are the main text; else all slots outside menus, headers, footers, sidebars,
forms, adverts, notices and comments are. Pages with the same article count as one page, so that copies make
no template, and an article that is template as a whole is kept, as an article that pages share is still one.

Defined results: a null page is empty and has empty text. A null address has the host ''. Repeated rows and
ids are extracted each. An empty table gives no rows. Only key, address and page are read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexigrain.storage import StoredTable

MIN_TOKENS = 3
MIN_PAGES = 3
#: Share of a host's different pages that a class must occur on to be template.
MIN_SHARE = 0.3
#: Template rows that are sent to all tasks; a larger template is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Pages of a host that are worked on together where there are more template tokens than that.
PAGES_PER_GROUP = 200

# Fixed values of HTML: elements without an end tag, without rendered text, and inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math canvas textarea select title head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr ruby rt rp".split()
)
# Elements and roles that frame an article.
FRAME_TAGS = frozenset("nav header footer aside form button dialog menu".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
FRAME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted nav navbar navigation "
    "menu menus sidebar aside footer header masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus "
    "replies respond related recommended recommendations widget widgets toolbar pagination pager skip".split()
)
STATES = frozenset("has with no without is not".split())
# With one of the first, the second name the article's own heading.
ARTICLE_WORDS = frozenset("article content entry post story".split())
HEADINGS = frozenset("header masthead banner".split())
CONTENT_TAGS = frozenset(("article", "main"))
# Elements that close an open paragraph, and elements that end others of their kind.
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}}
_SIBLINGS |= {"th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table article main section div body nav aside footer header form".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.DOTALL,
)
#: One attribute: its whole name and its value, so that no part of a value is taken for a name.
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+")
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def _names_frame(words: set[str]) -> bool:
    """Whether a class name or id, given by its words, is that of a frame."""
    # ``content-with-sidebar`` tells what an element contains or lacks, ``article-header`` a part of the article.
    if not STATES.isdisjoint(words):
        return False
    return not FRAME_WORDS.isdisjoint(words - HEADINGS if not ARTICLE_WORDS.isdisjoint(words) else words)


def _frames(tag: str, rest: str) -> bool:
    """Whether an element frames the article rather than being part of it."""
    if tag in FRAME_TAGS:
        return True
    if tag in ("body", "html", "main") or not rest:
        return False
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in FRAME_ROLES:
            return True
        if name in ("class", "id") and any(_names_frame(set(_NAME.findall(v))) for v in value.split()):
            return True
    return False


def page_blocks(page: str) -> tuple[list[tuple[str, str, bool, bool]], Counter]:
    """Text blocks ``(path, text, framed, in article)`` in page order, and how often each tag path occurs."""
    blocks: list[tuple[str, str, bool, bool]] = []
    tags: Counter = Counter()
    stack: list[tuple[str, bool, bool, str]] = []  # element, framed, in article, path
    pending: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(pending)).split())
        pending.clear()
        if text:
            _, framed, inside, path = stack[-1] if stack else ("", False, False, "")
            blocks.append((path, text, framed, inside))

    def pop_to(depth: int) -> None:
        flush()
        del stack[depth:]

    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        pending.append(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        tag = (found["tag"] or "").lower()
        if not tag or tag in ("html", "body"):
            continue
        if found["close"]:
            if tag in INLINE and all(e[0] != tag for e in stack):
                continue
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == tag), None)
            if depth is not None:
                pop_to(depth)
            else:
                flush()
            continue
        if tag in RAW:
            end = _END[tag].search(page, at) if not found["rest"].rstrip().endswith("/") else None
            if tag != "head":
                at = end.end() if end else (len(page) if tag in ("script", "style", "title") else at)
            continue
        # Inline elements only count where they frame something, and inside such an element of their kind.
        if tag in INLINE and all(e[0] != tag for e in stack) and not _frames(tag, found["rest"]):
            continue
        if tag == "br" or tag in VOID:
            pending.append(" ")
            continue
        if tag in _CLOSES_P:
            depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == "p"), None)
            if depth is not None and not any(e[0] in _SCOPES for e in stack[depth:]):
                pop_to(depth)
        elif tag in _SIBLINGS:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] in _SIBLINGS[tag]:
                    pop_to(d)
                    break
                if stack[d][0] in _SCOPES and not (tag in ("td", "th") and stack[d][0] == "tr"):
                    break
        flush()
        _, framed, inside, path = stack[-1] if stack else ("", False, False, "")
        path = f"{path}/{tag}"
        tags[path] += 1
        stack.append((tag, framed or _frames(tag, found["rest"]), inside or tag in CONTENT_TAGS, path))
    flush()
    return blocks, tags


def _digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@lru_cache(1 << 14)
def _path_digest(path: str) -> int:
    """Pages repeat few paths."""
    return _digest(path)


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


TOKENS = "host string, page long, token long, path string, is_tag boolean, n int"


def page_tokens(pages: DataFrame, url: Column, page: Column) -> DataFrame:
    """Tokens of each page with their counts; ``page`` is a digest of the page's text blocks."""
    schema = pa.schema(
        [("host", pa.string()), ("page", pa.int64()), ("token", pa.int64()), ("path", pa.string())]
        + [("is_tag", pa.bool_()), ("n", pa.int32())]
    )

    def tokenize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                blocks, tags = page_blocks(source.as_py() or "")
                article = [t for _, t, framed, inside in blocks if inside and not framed]
                number = _digest(*(article or [t for _, t, _, _ in blocks]))
                texts = Counter((path, text) for path, text, _, _ in blocks)
                rows += [(host, number, _path_digest(path), path, True, n) for path, n in tags.items()]
                rows += [(host, number, _digest(path, text), path, False, n) for (path, text), n in texts.items()]
                if len(rows) > 20_000:
                    yield _columns(rows, schema)
                    rows = []
            if rows:
                yield _columns(rows, schema)

    return pages.select(host_of(url).alias("host"), page.cast("string").alias("page")).mapInArrow(tokenize, TOKENS)


def deduce_templates(tokens: DataFrame, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Text tokens of each host's template: ``(host, token)``.

    Every step is a grouped sum or a join of their results. A text token nests in the template if a valid
    class holds an element around it.
    """
    once = tokens.groupBy("host", "page", "token", "path", "is_tag").agg(F.max("n").alias("n"))
    # Read three times below, so the pages are parsed once for it.
    vectors = StoredTable(
        once.groupBy("host", "token", "path", "is_tag").agg(
            F.count("*").alias("support"),
            F.expr("sum(cast(xxhash64(page, n) as decimal(20, 0)))").alias("vector"),
        ),
        "token-vectors",
    ).df
    size = vectors.where("is_tag").groupBy("host").agg(F.max("support").alias("pages"))
    shared = vectors.where(F.col("support") >= min_pages)
    classes = (
        shared.groupBy("host", "support", "vector")
        .agg(F.count("*").alias("tokens"), F.max("is_tag").alias("has_tag"))
        .where((F.col("tokens") >= min_tokens) & F.col("has_tag"))
        .join(size, "host")
        .where(F.col("support") >= min_share * F.col("pages"))
        .select("host", "support", "vector")
    )
    members = shared.join(classes, ["host", "support", "vector"])
    frame = members.where("is_tag").select("host", F.col("path").alias("around")).distinct()
    texts = members.where("not is_tag").select("host", "token", "path")
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    around = texts.where("path <> ''").select("host", "token", F.explode(ancestors).alias("around"))
    nested = around.join(frame, ["host", "around"], "left_semi")
    bare = texts.where("path = ''")  # directly in the page
    return nested.select("host", "token").unionByName(bare.select("host", "token")).distinct()


def extract_main_text(
    pages: DataFrame, key_col: str = "page_id", url_col: str = "url", page_col: str = "html", **options
) -> DataFrame:
    """Key, url and ``text`` of every row; see the module's text for what is kept."""
    url, page = F.col(url_col), F.col(page_col)
    template = StoredTable(deduce_templates(page_tokens(pages, url, page), **options), "template")
    kind = pages.select(key_col, url_col).schema.fields
    schema = f"key {kind[0].dataType.simpleString()}, url {kind[1].dataType.simpleString()}, text string"
    rows = pages.select(
        F.col(key_col).alias("key"), F.col(url_col).alias("url"), page.cast("string").alias("page"), host_of(url).alias("host")
    )
    if template.df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return _extract_by_host(rows, template.df, schema)
    fixed: dict[str, set[int]] = {}
    for row in template.df.collect():  # at most BROADCAST_ROWS
        fixed.setdefault(row.host, set()).add(row.token)
    shared = pages.sparkSession.sparkContext.broadcast(fixed)

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                _main_text(source.as_py() or "", shared.value.get(host, ()))
                for source, host in zip(batch.column(2), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["key", "url", "text"])

    return rows.mapInArrow(extract, schema)


def _main_text(page: str, known: set[int]) -> str:
    """The article's blocks without template text; an article that is template as a whole stays."""
    blocks, _ = page_blocks(page)
    article = [(path, text) for path, text, framed, inside in blocks if inside and not framed]
    found = article or [(path, text) for path, text, framed, _ in blocks if not framed]
    slots = [text for path, text in found if not known or _digest(path, text) not in known]
    return " ".join(slots or [text for _, text in article])


def _extract_by_host(rows: DataFrame, template: DataFrame, schema: str) -> DataFrame:
    """Pages meet their host's template in groups of about ``PAGES_PER_GROUP``, one copy of it to a group."""
    pages = rows.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > PAGES_PER_GROUP)
    groups = StoredTable(pages.select("host", F.ceil(F.col("n") / PAGES_PER_GROUP).cast("int").alias("groups")), "host-groups").df
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    groups = F.broadcast(groups) if few else groups
    n = F.coalesce("groups", F.lit(1))
    dealt = rows.join(groups, "host", "left").select(
        "key", "url", "page", "host", F.pmod(F.xxhash64("key", "url", "page"), n).cast("int").alias("part")
    )
    sent = template.join(groups, "host", "left").select("host", "token", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))

    def extract(own: pa.Table, fixed: pa.Table) -> pa.Table:
        known = set(fixed.column("token").to_pylist())
        texts = [_main_text(source.as_py() or "", known) for source in own.column("page")]
        return pa.table({"key": own.column("key"), "url": own.column("url"), "text": pa.array(texts, pa.string())})

    return dealt.groupBy("host", "part").cogroup(sent.groupBy("host", "part")).applyInArrow(extract, schema)
