"""Operator 2: main text of web pages by consensus host paths.

Each page is parsed into blocks; every block knows the generalised path of its container (structural tags with their
classes, digits as #). A page scores its containers by the prose in them, takes the best, widened to the article around it,
and votes for that. Spark adds up the votes per host and path; the winning path of a host then says where the text is in all of its pages. A page that has no such
container is read at its own best one.

Menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and comments are left out wherever they are.
Classes and ids tell many of them; what they tell is not believed of an article or main, nor of what holds most of the prose.

Cases: null or empty html gives the empty text; a null url or one without a host takes no part in the vote, and the page
is read at its own best container; html without any tag is one block; unclosed and crossing tags are read as browsers
read them (a block ends an open paragraph; end tags without a start are ignored; an unfinished tag at the end is
dropped; of buttons, frames, pictures and the like, which are passed over, one without an end tag ends at the next block).
Ties between paths go to more prose, then to the smaller path. Equal rows give equal results; an empty table
none; other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows, kept, small_batches, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:@.-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Elements that make the path of a container; the title is one, so that it is found beside the article's container.
STRUCTURE = frozenset("body div section article main td center h1".split())
#: Elements that begin and end a block.
BLOCK = STRUCTURE | frozenset(
    "html p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table thead tbody tfoot tr th caption figure figcaption hr address details summary nav header footer aside form fieldset dialog menu".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are passed over up to their end tag; without one, up to the next block.
SKIPPED = frozenset("title noscript template iframe svg object textarea select button canvas audio video annotation annotation-xml".split())
_STARTS = {t: re.compile(rf"<{t}(?=[\s/>])", re.I) for t in SKIPPED}
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in SKIPPED}
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.I)
LINK_END = re.compile(r"</a\s*>", re.I)
LEFT_OUT = frozenset("nav footer aside form dialog menu fieldset label option header".split())
#: Words of class and id that mark what isn't the article.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus respond reply replies share sharing social related recommended recommendations newsletter "
    "subscribe signup popup modal overlay widget toolbar pagination pager login search copyright".split()
)
#: Words that say of which part or kind such an element is. A name with any other word (share-price-report, social-history) names something else.
PARTS = frozenset(
    "site main page top bottom left right center box block container wrapper wrap inner outer area section zone list item items group row col column bar panel unit slot strip link links button buttons btn icon icons text title head header content body "
    "primary secondary global local mobile desktop post posts article articles entry entries form field input count message msg policy info inline fixed sticky small large user users section thread tree feed card cards grid wp js id nr".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
ARTICLE = frozenset("article content post entry story main body text".split())
#: Words of a class that say what else the page has or how it stands, not what the element is: has-sidebar, comments-open.
STATE = frozenset("has no not with without open opened closed enabled disabled off".split())
#: Words that mark readers' texts, which may be longer than the article.
REPLIES = frozenset("comment comments disqus respond reply replies".split())
#: Words of class and id, and elements, that may hold the article.
HOLDS = frozenset("article content post entry story main".split())
#: The share of linked characters up to which text beside the best container belongs to the article.
LINKED = 0.2
#: How many times the prose at the host's path a page's own best container has to have to be taken instead.
FAR_MORE = 4
#: Bytes of hosts and their paths up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile("[0-9]+")


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html_lib.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)}


def _kind(tag: str, raw: str, in_article: bool) -> tuple[bool, frozenset[str], str, bool]:
    """Whether the element is left out, the words that speak against it, its part of the path and whether it may hold the article."""
    out = tag in LEFT_OUT and not (tag == "header" and in_article)
    if not raw.strip(" /\n\t\r"):
        return out, frozenset(), tag, tag in ("article", "main")
    a = _attributes(raw)
    tokens = [{w.lower() for w in WORDS.findall(t)} for t in f"{a.get('class', '')} {a.get('id', '')}".split()]
    words = set().union(*tokens)
    against: set[str] = set()
    if tag not in ("body", "html", "head"):
        if tag != "main" and not (tag == "article" and not in_article):
            against = set().union(*(t for t in tokens if not t & STATE and t <= NOT_ARTICLE | PARTS)) & NOT_ARTICLE
            if words == {"header"} or {"site", "header"} <= words or {"page", "header"} <= words:
                against.add("header")
        out = out or a.get("role", "").lower() in ROLES or "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower()
    classes = sorted(DIGITS.sub("#", c) for c in a.get("class", "").split())
    return out, frozenset(against), ".".join([tag, *classes]), tag in ("article", "main") or bool(words & HOLDS) and tag not in ("body", "html")


def _without_marked(found: list[tuple[str, str, int, tuple[int, ...], tuple[int, ...]]], against: list[frozenset[str]]) -> list[tuple[str, str, int]]:
    """The blocks outside the elements that words speak against; such an element stays where it holds most of the prose.

    It doesn't if another element, that may hold the article, has a quarter of its prose or more outside it, or if it holds readers' texts. If nothing
    would be left of a page, all is.
    """
    if not against:
        return [x[:3] for x in found]
    every = 0
    inside, kept_by = [0] * len(against), Counter()
    together: Counter[tuple[int, int]] = Counter()
    for _, text, links, marks, holders in found:
        prose = max(0, len(text) - 2 * links)
        every += prose
        for m in marks:
            inside[m] += prose
        for h in holders:
            kept_by[h] += prose
            for m in marks:
                together[m, h] += prose
    spared = set()
    for m, n in enumerate(inside):
        if 2 * n > every and not against[m] & REPLIES and not any(4 * p > n and not together[m, h] for h, p in kept_by.items()):
            spared.add(m)
    left = [x[:3] for x in found if all(m in spared for m in x[3])]
    return left or [x[:3] for x in found]


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(container path, text, characters of it in links) of every block that isn't left out, in page order."""
    found: list[tuple[str, str, int, tuple[int, ...], tuple[int, ...]]] = []
    against: list[frozenset[str]] = []
    n_holders = 0
    stack: list[tuple[str, bool, str, tuple[int, ...], tuple[int, ...]]] = [("", False, "", (), ())]  # tag, left out, path, marked elements, possible articles
    parts: list[str] = []
    links, in_link = 0, False
    articles = 0
    seen: dict[tuple[str, bool], re.Match | None] = {}

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                found.append((stack[-1][2], text, min(links, len(text)), stack[-1][3], stack[-1][4]))
            parts.clear()
        links = 0

    def put(text: str) -> None:
        nonlocal links
        if text and not stack[-1][1]:
            parts.append(text)
            if in_link:
                links += len(text)

    def pop_to(n: int) -> None:
        nonlocal articles
        while len(stack) > n:
            articles -= stack.pop()[0] in ("article", "main")

    def next_tag(tag: str, end: bool, at: int) -> re.Match | None:
        m = seen.get((tag, end))
        if (tag, end) not in seen or m and m.start() < at:
            m = seen[tag, end] = (BLOCK_TAG if not tag else (_ENDS if end else _STARTS)[tag]).search(page, at)
        return m

    def skip(tag: str, at: int) -> int:
        """Where a passed-over element ends: an element is unclosed if another starts before its end tag, with a block between."""
        end, again = next_tag(tag, True, at), next_tag(tag, False, at)
        if end and not (again and again.start() < end.start()):
            return end.end()
        block = next_tag("", False, at)
        if end and not (block and block.start() < again.start()):
            return end.end()
        return block.start() if block else len(page)

    at = 0
    while m := TOKEN.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in SKIPPED:
            if not m[2] and not (m[4].rstrip().endswith("/") and tag == "svg"):
                at = skip(tag, at)
        elif tag == "br":
            put(" ")
        elif tag == "a":
            in_link = not m[2]
            n = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "a"), 0)
            if n:
                pop_to(n)
            closed = LINK_END.search(page, at) if in_link and m[4] and not stack[-1][1] else None
            if closed and not BLOCK_TAG.search(page, at, closed.start()):
                out, words, _, _ = _kind(tag, m[4], False)
                if out or words:
                    stack.append((tag, True, *stack[-1][2:]))
        elif tag in BLOCK or tag in LEFT_OUT:
            flush()
            if m[2]:
                n = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if n:
                    pop_to(n)
                continue
            if tag in VOID:
                continue
            in_link = False
            if tag in BLOCK and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or stack[-1][0] == tag and tag in ("li", "td", "tr", "dt", "dd"):
                pop_to(len(stack) - 1)
            _, left, path, marks, holders = stack[-1]
            out, words, part, holds = _kind(tag, m[4], articles > 0)
            if tag in STRUCTURE:
                path = f"{path}/{part}" if path else part
            if words and not left:
                marks = (*marks, len(against))
                against.append(words)
            elif holds and not marks and not left:
                holders = (*holders, n_holders)
                n_holders += 1
            stack.append((tag, left or out, path, marks, holders))
            articles += tag in ("article", "main")
        elif m[4] and not m[2] and tag not in VOID:
            out, words, _, _ = _kind(tag, m[4], False)
            if (out or words) and not stack[-1][1]:  # an inline element that is left out
                flush_at = page.find(f"</{tag}", at)
                if words and not out and flush_at >= 0 and BLOCK_TAG.search(page, at, flush_at):  # it holds blocks
                    flush()
                    stack.append((tag, False, stack[-1][2], (*stack[-1][3], len(against)), stack[-1][4]))
                    against.append(words)
                elif flush_at >= 0:
                    stack.append((tag, True, *stack[-1][2:]))
        elif m[2] and stack[-1][0] == tag:
            if len(stack) > 1 and stack[-1][3] != stack[-2][3]:
                flush()
            pop_to(len(stack) - 1)
    rest = page[at:]
    put(rest)
    flush()
    return _without_marked(found, against)


def scores(found: list[tuple[str, str, int]]) -> dict[str, float]:
    """Prose in each container: a block counts for its own, and by a third for each one around it."""
    out: dict[str, float] = {}
    for path, text, links in found:
        prose = max(0, len(text) - 2 * links) * (1.0 if len(text) > 40 else 0.3)
        share = prose
        while True:
            words = {w.lower() for w in WORDS.findall(path.rpartition("/")[2])}
            out[path] = out.get(path, 0.0) + share * (1.5 if words & ARTICLE and "body" not in path.rpartition("/")[2][:4] else 1.0)
            if "/" not in path:
                break
            path, share = path.rpartition("/")[0], share / 3
    return out


def widened(found: list[tuple[str, str, int]], path: str) -> str:
    """The path, or the widest container around it that adds text of the article.

    An article around it always does; main and, where neither is around it, another element below body do if few of the
    other characters in them are in links. Nothing outside the outermost article or main is added.
    """
    size: dict[str, list[int]] = {}
    for p, text, links in found:
        while True:
            n = size.setdefault(p, [0, 0])
            n[0] += len(text)
            n[1] += links
            if "/" not in p:
                break
            p = p.rpartition("/")[0]
    around = [path]
    while "/" in around[-1]:
        around.append(around[-1].rpartition("/")[0])
    tags = [p.rpartition("/")[2].partition(".")[0] for p in around]
    last = max((i for i, t in enumerate(tags) if t in ("article", "main")), default=None)
    best = 0
    for i, tag in enumerate(tags):
        if tag == "body" or last is not None and i > last:
            break
        more, links = size[around[i]][0] - size[around[best]][0], size[around[i]][1] - size[around[best]][1]
        if tag == "article" or links <= LINKED * more:
            best = i
    return around[best]


def best_path(found: list[tuple[str, str, int]]) -> tuple[str | None, float]:
    s = scores(found)
    if not s:
        return None, 0.0
    p = widened(found, min(s, key=lambda k: (-s[k], k)))
    return p, s[p]


def _prose(found: list[tuple[str, str, int]]) -> int:
    return sum(max(0, len(t) - 2 * links) for _, t, links in found)


def _is_title(path: str) -> bool:
    return path.rpartition("/")[2].partition(".")[0] == "h1"


def text_at(found: list[tuple[str, str, int]], path: str | None) -> str:
    """The blocks in containers of that path, with the title before them; the page's own best ones if it has none, or far more prose in those.

    The title is the last h1 before the first of these blocks, in an element around their container, if they have none themselves.
    """
    within = lambda p, top: p == top or p.startswith(f"{top}/") or top == ""
    inside = [i for i, (p, _, _) in enumerate(found) if within(p, path)] if path else []
    own, _ = best_path(found)
    mine = [i for i, (p, _, _) in enumerate(found) if within(p, own)] if own is not None else []
    if not inside or _prose([found[i] for i in mine]) > FAR_MORE * _prose([found[i] for i in inside]):
        inside, path = mine, own
    if inside and not any(_is_title(found[i][0]) for i in inside):
        first = found[inside[0]][0]
        titles = [i for i in range(inside[0]) if _is_title(found[i][0]) and within(first, found[i][0].rpartition("/")[0])]
        inside = titles[-1:] + inside
    return "\n\n".join(found[i][1] for i in inside)


def host_of(url: Column) -> Column:
    """The host of a url column in lower case, without user and port; null if there is none."""
    host = F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]*)", 1)
    return F.when(host != "", F.lower(host))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, the path that most of its pages vote for, and the number of its pages. Votes are summed before the shuffle."""
    small_batches(pages.sparkSession)

    def vote(b: pa.RecordBatch) -> pa.RecordBatch:
        votes: dict[tuple[str, str], list[float]] = {}
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            path, score = best_path(blocks(page or ""))
            if path is not None:
                v = votes.setdefault((host, path), [0, 0.0])
                v[0] += 1
                v[1] += round(score)
        rows = [(h, p, int(n), int(s)) for (h, p), (n, s) in votes.items()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["host", "path", "n", "s"])

    hosted = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).where("host IS NOT NULL")
    votes = hosted.mapInArrow(by_rows(vote), "host string, path string, n long, s long")
    summed = votes.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("s")).alias("s"), "path")).alias("best")
    return summed.groupBy("host").agg(best, F.sum("n").alias("pages")).select("host", F.col("best.path").alias("path"), "pages")


def _with_paths(p: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """p (id, url, html, host) with the path of its host. Pages are not shuffled while the hosts' paths fit a broadcast.

    Otherwise the paths of hosts with a thousandth of all pages or more, a thousand of them at most, are broadcast, so that
    no hot host meets in one task, and only the other hosts' pages are shuffled.
    """
    size = paths.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64).alias("b"), F.sum("pages").alias("n")).first()
    one = paths.select("host", "path")
    if (size["b"] or 0) <= most:
        return p.join(F.broadcast(one), "host", "left")
    is_hot = F.col("pages") * 1000 >= size["n"]
    hot = p.join(F.broadcast(paths.where(is_hot).select("host", F.col("path").alias("hot"))), "host", "left")
    rest = hot.where("hot IS NULL").drop("hot").hint("merge").join(paths.where(~is_hot).select("host", "path"), "host", "left")
    return hot.where("hot IS NOT NULL").withColumnRenamed("hot", "path").unionByName(rest)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id, url, text, n_chars and the path that was used for the host."""
    small_batches(pages.sparkSession)
    id_kind = pages.schema[id_col].dataType.simpleString()

    def read(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text_at(blocks(page or ""), path) for page, path in zip(b.column("html").to_pylist(), b.column("path").to_pylist())]
        return pa.record_batch([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), b.column("path")], ["id", "url", "text", "n_chars", "host_path"])

    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    paths, _ = kept(host_paths(pages, url_col, html_col), "host-paths")  # small, and read for its size first
    joined = _with_paths(p, paths, broadcast_bytes)
    return joined.select("id", "url", "html", "path").mapInArrow(by_rows(read), f"id {id_kind}, url string, text string, n_chars long, host_path string").withColumnRenamed("id", id_col)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html": op2_html}
SQL: dict[str, str] = {}
