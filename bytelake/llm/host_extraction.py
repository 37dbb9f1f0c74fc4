"""Main-text extraction: page structure plus a suffix table of each host.

A page is parsed into blocks in page order.  A block inside ``article`` or ``main`` is main text; one inside menus, headers, footers,
sidebars, notices, adverts, forms or reader comments (by element, role or class name) is boilerplate; any
other block is open.  A page with main blocks consists of them.  On other pages the open blocks are judged by the host:
the token streams of all blocks outside main text are joined page by page, and their suffixes, as far as the first
``MATCH`` tokens, are brought together by (host, prefix).  Suffixes that would be neighbours in the host's
sorted suffix array with a common prefix of ``MATCH`` tokens or more meet in one group, as only equality of the
prefix matters; a group with enough distinct pages is a substring repeated across pages (copies of a whole page count
once).  The grouping is a partial aggregation, so a host with a third of all pages is not one task.

By default two pages are enough and covered tokens go, the unique runs stay.  The query uses ``WHOLE_BLOCKS``, which never cuts
inside a block: strings of 24 tokens that stand on a tenth of the host's pages (three at least, near copies counted once) cover,
a block goes if nearly all of it is covered, and a page that would keep less than a fifth of its open text keeps all.
The table judges the blocks of marked articles too: there a suffix ends with its block, so a short block is one string, and strings are
counted in main text only (a title in the sidebars of other pages is no vote against it).  A main block whose beginning begins blocks on
half of the host's pages, ten at least and near copies counted once, and which strings of such blocks on as many pages cover whole, is a notice or
subscription line and goes; a passage that only recurs inside other blocks, or on fewer pages, stays.

Defined results: null html or html without main text gives '' and n_chars 0; a page whose url is null or has no host is a host of
its own; equal rows are separate pages with equal texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from html import unescape

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small, stored
from .registry import query, table

MATCH = 8


@dataclass(frozen=True)
class Rule:
    """What repeats on a host must be to go: tokens that match, pages with them (number and share of the host's), whether pages of
    nearly the same words count once, the covered share of a block that takes it away as a whole (None: just the
    covered tokens go), the share of its open tokens a page must be left with, and the share of the host's pages
    (``main_pages`` at least) with a string that covers main blocks (None: they all stay)."""

    match: int = MATCH
    pages: int = 2
    share: float = 0.0
    near_copies_once: bool = False
    block: float | None = None
    left: float = 0.0
    main_share: float | None = None
    main_pages: int = 10


WHOLE_BLOCKS = Rule(match=24, pages=3, share=0.1, near_copies_once=True, block=0.95, left=0.2, main_share=0.5)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe object svg head title textarea select option button datalist".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark noscript q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
    "math semantics annotation mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle mpadded mfenced msub msup msubsup munder mover munderover mmultiscripts".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_WORDS = re.compile(
    r"ads?|advert\w*|sponsor\w*|banner|promo\w*|cookies?|consent|notice|alert|popup|modal|sidebar|comments?|disqus|replies|respond|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|masthead|share|sharing|social|related|newsletter|subscribe|signup|widget"
)
# Words that a class or id may join to those and still name the same thing: "comment-list", "site-footer", but not "with-sidebar", "nav-fixed" or "social-history".
_FILLERS = frozenset(
    "area aside bar bars block body bottom box btn button buttons center col column container content entry form global group holder icons inner item items left link links "
    "list main message mobile outer overlay page panel placeholder post posts primary region right row secondary section site slot text thread top unit widgets wrap wrapper".split()
)
_OTHERS = re.compile(r"(?:comment|repl|respon|disqus|related|ad\b|ads\b|advert|sponsor|promo)")  # may hold articles that aren't the page's own
_CONTAINERS = frozenset("div section ul ol dl table td article center fieldset header p".split())
_PAGE_FORM = re.compile(r"<(?:/form|(h1|article|main))\b", re.IGNORECASE)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_TAG = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|[!?/][^>]*>)""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)[^>]*>")
_COMMENT_END = re.compile(r"--!?>")
_LISTS = ("ul", "ol", "dl", "table")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


def _attributes(source: str) -> dict[str, str]:
    """Name and value pairs of a tag, names in lower case; of a repeated name the first counts, as in browsers."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _named(value: str, in_main: bool) -> int:
    """2 if a class or id names something that may hold other pages' or readers' articles, 1 if other boilerplate, else 0."""
    level = 0
    for name in value.lower().split():
        parts = [x for x in re.split(r"[-_]+", name) if x]
        words = [x for x in parts if _WORDS.fullmatch(x) or x == "header" and not in_main]
        if words and all(x in words or x in _FILLERS or x.isdigit() or x in ("article", "header") for x in parts):
            level = max(level, 2 if any(map(_OTHERS.match, words)) else 1)
    return level


def _boilerplate(name: str, source: str, in_main: bool, page_form: bool) -> int:
    """0 for an element that isn't boilerplate; 1 if it is unless it holds the article; 2 if an article in it counts
    only on a page without another one."""
    found = _attributes(source) if source.strip() else {}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return 2
    if name in ("main", "body", "html"):
        return 0
    if name in BOILERPLATE and name != "form" or found.get("role", "").lower() in _ROLES - {"form"}:
        return 2
    level = int((name == "form" or found.get("role", "").lower() == "form") and not page_form or name == "header" and not in_main)
    level = max(level, _named(found.get("class", ""), in_main))
    if name in _CONTAINERS:
        level = max(level, _named(found.get("id", ""), in_main))
    return level


def parse(html: str) -> tuple[list[str], list[str], list[bool]]:
    """``(main blocks, blocks outside, which of these are open)``, white space collapsed, references decoded.

    An element that holds ``article`` or ``main`` is not boilerplate as far as these go.  Below one that is by its own kind (a
    menu, a sidebar element, comments, hidden text) they count only if the page has no others."""
    main, outside, is_open, spare = [], [], [], []
    stack: list[tuple[str, int, bool, bool, bool]] = []  # name, boilerplate, main, inside an article, spare
    places: dict[str, list[int]] = defaultdict(list)  # where on the stack each name stands
    p_at: list[int] = []  # for each element the ``p`` around it with only inline elements between, or -1
    never_closed: set[str] = set()
    last_gt = html.rfind(">")
    nothing = ("", 0, False, False, False)
    form_at, page_form = -1, False
    parts: list[str] = []

    def flush():
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            _, boilerplate, in_main, _, is_spare = stack[-1] if stack else nothing
            if in_main and not boilerplate and not is_spare:
                main.append(text)
            else:
                outside.append(text)
                is_open.append(not boilerplate and not in_main)
                if in_main and not boilerplate:
                    spare.append(len(outside) - 1)

    def cut(k: int) -> None:
        while len(stack) > k:
            places[stack.pop()[0]].pop()
            p_at.pop()

    def last(name: str) -> int:
        return places[name][-1] if places.get(name) else -1

    def close(name: str) -> None:
        k = last(name)
        if k < 0:
            return
        if name not in INLINE or stack[k][1:] != (stack[k - 1][1:] if k else nothing[1:]):
            flush()
        cut(k)

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0 or lt > last_gt:  # no tag ends any more
            end = html.find("<!--", at)
            parts.append(html[at : n if end < 0 else end])
            break
        parts.append(html[at:lt])
        m = _TAG.match(html, lt)
        if m is None:
            m = _LOOSE_TAG.match(html, lt)
            if m is None:
                parts.append("<")
                at = lt + 1
                continue
            slash, name, attributes = m[1], m[2].lower(), ""
        elif m[1]:
            if html.startswith((">", "->"), lt + 4):  # empty comments, as browsers read them
                at = html.index(">", lt) + 1
                continue
            end = _COMMENT_END.search(html, lt + 4)
            at = n if end is None else end.end()
            continue
        elif m[3] is None:
            at = m.end()
            continue
        else:
            slash, name, attributes = m[2], m[3].lower(), m[4]
        at = m.end()
        if slash:
            close(name)
            if name == "p" or name == "br":
                parts.append(" ")
            continue
        if name in RAW:
            if name in ("head", "svg", "object", "datalist", "select") and not attributes.rstrip().endswith("/"):
                if name in never_closed:
                    continue
                end = re.compile(rf"</{name}\b[^>]*>|<body\b" if name == "head" else rf"</{name}\b[^>]*>", re.IGNORECASE).search(html, at)
                if end is None:
                    never_closed.add(name)
                    continue
                at = end.start() if end[0][1] != "/" else end.end()
            else:
                end = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(html, at)
                at = n if end is None else end.end()
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_P:
                if p_at and p_at[-1] >= 0:
                    cut(p_at[-1])
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                k = last(name)
                if k >= 0 and k > max(map(last, _LISTS)):
                    cut(k)
        if name == "br":
            parts.append(" ")
        if name in VOID or attributes.endswith("/") and name not in ("p", "div", "article", "main"):
            continue
        if name == "form" and at > form_at:  # does it hold the page's text, as in ASP.NET?  The next heading, article or end tag says
            m = _PAGE_FORM.search(html, at)
            form_at, page_form = (m.start(), m[1] is not None) if m else (n, False)
        _, boilerplate, in_main, in_article, is_spare = stack[-1] if stack else nothing
        own = _boilerplate(name, attributes, in_main, page_form and not in_article)
        before = stack[-1][1:] if stack else nothing[1:]
        if name == "main" or name == "article" and not in_article:
            level = max(boilerplate, own if own == 2 else 0)
            after = (0, True, name == "article" or in_article, is_spare or level == 2)
        else:
            after = (max(boilerplate, own), in_main, in_article, is_spare)
        if after != before and parts:
            flush()
        places[name].append(len(stack))
        p_at.append(len(stack) if name == "p" else p_at[-1] if p_at and name in INLINE else -1)
        stack.append((name, *after))
    flush()
    if not main and spare:
        own_blocks = set(spare)
        main = [outside[k] for k in spare]
        is_open = [o for k, o in enumerate(is_open) if k not in own_blocks]
        outside = [t for k, t in enumerate(outside) if k not in own_blocks]
    return main, outside, is_open


def _host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _sketch(blocks: list[str]) -> int:
    """Equal for pages of nearly the same words, as a rule: the smallest hashes of the page's words under two seeds."""
    words = {w.encode("utf-8", "surrogatepass") for w in " ".join(blocks).split()} or {b""}
    least = [min(xxhash.xxh64_intdigest(w, seed) for w in words) for seed in (1, 2)]
    return xxhash.xxh64_intdigest(repr(least)) >> 1


def _block_keys(tokens: list[str], match: int, first: bool = False) -> list[int]:
    """Keys of the first ``match`` tokens of the suffixes of one block (or of the first suffix alone); a shorter block is one string with its end."""
    if len(tokens) < match:
        tokens, match = [*tokens, ""], len(tokens) + 1
    ends = 1 if first else len(tokens) - match + 1
    return [xxhash.xxh64_intdigest("\x00".join(tokens[k : k + match]).encode("utf-8", "surrogatepass")) >> 1 for k in range(ends)]


def _parsed(cols, near_copies_once: bool, match: int):
    hosts, mains, heads, outs, opens, digests = [], [], [], [], [], []
    for url, html in zip(cols["_url"], cols["_html"], strict=True):
        main, outside, is_open = parse(html or "")
        hosts.append(_host(url))
        mains.append(main)
        heads.append([_block_keys(b.split(None, match)[:match], match, True)[0] for b in main])
        outs.append(outside)
        opens.append(is_open)
        blocks = main + outside
        digests.append(_sketch(blocks) if near_copies_once else xxhash.xxh64_intdigest("\n".join(blocks).encode("utf-8", "surrogatepass")) >> 1)
    return cols["_id"], cols["_url"], hosts, mains, heads, outs, opens, digests


def _suffix_keys(blocks: list[str], match: int) -> list[int]:
    """Keys of the first ``match`` tokens of every suffix of the page's joined stream that is long enough."""
    tokens = " ".join(blocks).split()
    return [xxhash.xxh64_intdigest("\x00".join(tokens[k : k + match]).encode("utf-8", "surrogatepass")) >> 1 for k in range(len(tokens) - match + 1)]


def _left(blocks: list[str], is_open: list[bool], starts: list[int] | None, rule: Rule) -> list[str]:
    """Open blocks without what is covered; a block of which nothing is left goes."""
    covered = {k + j for k in starts or () for j in range(rule.match)}
    kept, at, n_open, n_kept = [], 0, 0, 0
    for block, free in zip(blocks, is_open, strict=True):
        tokens = block.split()
        left = [t for j, t in enumerate(tokens) if at + j not in covered]
        at += len(tokens)
        if rule.block is not None:
            left = tokens if len(tokens) - len(left) < rule.block * len(tokens) else []
        if free:
            n_open += len(tokens)
            n_kept += len(left)
            if left:
                kept.append(" ".join(left))
    if n_kept < rule.left * n_open:
        return [b for b, free in zip(blocks, is_open, strict=True) if free]
    return kept


def _covered_whole(n: int, starts: list[int], match: int) -> bool:
    """Whether strings of ``match`` tokens at ``starts`` cover all ``n`` tokens of a block (one string covers a shorter block)."""
    end = 0
    for k in sorted(starts):
        if k > end:
            return False
        end = k + match
    return end >= n


def _unique_runs(cols, rule: Rule):
    texts = ["\n\n".join(_left(*row, rule)) for row in zip(cols["outside"], cols["is_open"], cols["starts"], strict=True)]
    return cols["_id"], cols["_url"], texts


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", rule: Rule = Rule()) -> DataFrame:
    """One row per page: ``(id, url, text, n_chars)``."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html"))
    schema = f"_id {kind}, _url string, host string, main array<string>, heads array<long>, outside array<string>, is_open array<boolean>, digest long"
    once, match = rule.near_copies_once, rule.match
    parsed = stored(map_rows(rows, lambda c: _parsed(c, once, match), schema).withColumn("_row", F.monotonically_increasing_id()), "pages")

    ready = F.size("main") > 0

    keyed = map_rows(
        parsed.filter("host <> ''").select("_row", "host", "outside"), lambda c: (c["_row"], c["host"], [_suffix_keys(b, rule.match) for b in c["outside"]]),
        "_row long, host string, keys array<long>",
    )
    # one page speaks for all of its copies
    chosen = stored(parsed.filter("host <> ''").groupBy("host", "digest").agg(F.min("_row").alias("_row")).select("host", "_row"), "chosen")
    if rule.share > 0 or rule.main_share is not None:
        sizes = stored(chosen.groupBy("host").agg(F.count(F.lit(1)).alias("size")), "hosts")
    marked = parsed.filter(ready).select("_row", "_id", "_url", "host", "main", "heads")
    kept = F.col("main")
    if rule.main_share is not None:
        sized, whole = small(sizes), small(chosen.select("_row"))

        def often(found):  # (_row, host, keys) -> the strings on enough of the host's pages
            n = found.join(whole, "_row", "left_semi").select("host", F.explode(F.array_distinct("keys")).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
            return n.filter(F.col("n") >= rule.main_pages).join(sized, "host").filter(F.col("n") >= F.lit(rule.main_share) * F.col("size")).select("host", "key")

        # a list holds at most 1 / main_share times as many strings as the host's pages have blocks on average
        lists = often(marked.filter("host <> ''").select("_row", "host", F.col("heads").alias("keys"))).groupBy("host").agg(F.collect_list("key").alias("common"))
        looked = marked.join(small(stored(lists, "common-heads")), "host")
        looked = looked.select("_row", "host", "common", F.posexplode(F.arrays_zip("main", "heads")).alias("at", "b")).filter(F.array_contains("common", F.col("b.heads")))

        def keys(c):
            tokens = [b.split() for b in c["block"]]
            return c["_row"], c["host"], c["at"], [len(t) for t in tokens], [_block_keys(t, match) for t in tokens]

        looked = stored(map_rows(looked.select("_row", "host", "at", F.col("b.main").alias("block")), keys, "_row long, host string, at int, n int, keys array<long>"), "looked-at")
        per_page = looked.groupBy("_row", "host").agg(F.flatten(F.collect_list("keys")).alias("keys"))  # one page's own blocks
        strings = stored(often(per_page), "common-strings")
        starts = looked.select("_row", "host", "at", "n", F.posexplode("keys").alias("start", "key")).join(small(strings), ["host", "key"], "left_semi")
        starts = starts.groupBy("_row", "at", "n").agg(F.collect_list("start").alias("starts"))
        verdicts = map_rows(starts, lambda c: (c["_row"], c["at"], [_covered_whole(n, k, match) for n, k in zip(c["n"], c["starts"], strict=True)]), "_row long, at int, gone boolean")
        gone = stored(verdicts.filter("gone").groupBy("_row").agg(F.collect_list("at").alias("gone")), "gone")
        marked = marked.join(small(gone), "_row", "left")
        kept = F.when(F.col("gone").isNull(), kept).otherwise(F.filter("main", lambda _, at: ~F.array_contains("gone", at)))
    done = marked.select("_id", "_url", F.array_join(kept, "\n\n").alias("text"))

    counted = keyed.join(small(chosen.select("_row")), "_row", "left_semi").select("host", F.explode(F.array_distinct("keys")).alias("key"))
    repeated = counted.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= rule.pages)
    if rule.share > 0:
        repeated = repeated.join(small(sizes), "host").filter(F.col("n") >= F.lit(rule.share) * F.col("size"))
    repeated = repeated.select("host", "key")

    undecided = parsed.filter(~ready)
    suffixes = keyed.join(undecided.filter(F.exists("is_open", lambda o: o)).select("_row"), "_row", "left_semi")
    theirs = suffixes.select("_row", "host", F.posexplode("keys").alias("start", "key"))
    covered = theirs.join(repeated, ["host", "key"], "left_semi").groupBy("_row").agg(F.collect_list("start").alias("starts"))  # one page's own positions
    open_pages = undecided.join(covered, "_row", "left").select("_id", "_url", "outside", "is_open", "starts")
    judged = map_rows(open_pages, lambda c: _unique_runs(c, rule), f"_id {kind}, _url string, text string")
    return done.unionByName(judged).select(
        F.col("_id").alias(id_col), F.col("_url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars")
    )


@query("op7_host_extraction")
def op7(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rule=WHOLE_BLOCKS)
