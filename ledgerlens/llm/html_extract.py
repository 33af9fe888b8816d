"""HTML extraction with site template removal.

1. Each page is parsed into elements (unclosed and misnested tags are put right as browsers do for paragraphs, lists and
   table cells; a page may break off anywhere). Every element that may be template gets a hash of its subtree: tag,
   class, text, children.
2. Spark counts on how many pages of a host each hash occurs. Subtrees on at least ``min_pages`` pages and at least
   ``min_share`` of the host's pages are that site's template. Inside an article, they must also occur beside at least
   ``min_pages`` different texts of the rest of the article, else they are parts of a copied article.
3. Each page is parsed again with its template hashes. These subtrees go; so does what its tag, role or class marks as
   menu, header, footer, sidebar, notice, advert, form, script, style or reader comments (a host with few pages shows
   no recurrence). What stays in the article is the text.

The article is the outermost ``article`` and ``main`` elements that hold the page's text: an article within ``main`` stands
for it when it has more than half of its text, one outside when it has more than all of it; else it is the body. Paragraphs, headings and other prose, and a
subtree with more than half of a page's text, are never template, and neither are the parts of an article that recur with
the whole of it: copies of an article on one host keep their text. Copies that differ elsewhere in the article count as
different articles.

The counts are combined before the shuffle, and a host's commonest hashes come back by a bounded broadcast, so a host
with a third of all pages is no hot spot.

Defined results: null html is the empty page with text ''; a page without host belongs to the host ''; repeated rows each
give a row and count as pages of their own; an empty table gives no rows. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import join_unique, materialise, slices

MIN_PAGES, MIN_SHARE = 5, 0.01
#: Sets the keys of subtrees within an article apart from equal ones outside.
INNER = 0x9E3779B97F4A7C15
BATCH = 1 << 22

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^'\"<>])*+|[^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z0-9]+")

# Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr caption figcaption".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SIBLINGS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
CONTAINERS = frozenset("ul ol dl table select article div section body".split())
SCOPE = frozenset("article body div html main ol section table td th ul".split())
NEVER_TEXT = frozenset("head script style noscript template nav aside footer form button select option input textarea iframe svg canvas object audio video dialog menu title link meta".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
# Names of class and id that mark what isn't the article.
MARKS = frozenset("""ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion sidebar aside cookie cookies consent gdpr notice notices
 banner popup modal overlay newsletter subscribe signup share sharing social related recommended breadcrumb breadcrumbs menu nav navbar navigation
 footer header masthead topbar comment comments disqus respond replies pagination pager widget toolbar skip login search""".split())
COMMENTS = frozenset("comment comments disqus respond replies".split())
HEADS = frozenset("header masthead".split())
# Words of place and form that a mark's name may have before and after it ('site-footer', 'comment-list').
BEFORE = frozenset("site global main primary secondary top bottom left right side user reader page post article entry wp block".split())
AFTER = frozenset("list item items box block bar area section wrap wrapper container inner content body link links button buttons icon icons form posts articles stories left right thread slot unit primary secondary".split())
SITE = frozenset("site global".split())


@lru_cache(1 << 14)
def marks_of(names: str) -> frozenset[str]:
    """The marks that whole names of class or id stand for; other words beside a mark ('with-sidebar', 'header-fixed', 'entry-header') make it none."""
    out: set[str] = set()
    for name in names.split():
        words = [w for w in _WORD.findall(name) if not w.isdigit()]
        a, b = 0, len(words)
        while a < b and words[a] not in MARKS and words[a] in BEFORE:
            a += 1
        while a < b and words[b - 1] not in MARKS and words[b - 1] in AFTER:
            b -= 1
        core = words[a:b]
        if core and MARKS.issuperset(core) and (HEADS.isdisjoint(core) or b == len(words) and SITE.issuperset(words[:a])):
            out.update(core)
    return frozenset(out)



class Element:
    __slots__ = ("tag", "marks", "marked", "role", "children", "parent", "key", "size", "inside", "scope", "listed")

    def __init__(self, tag: str, attributes: str, parent):
        self.tag, self.parent, self.children, self.marks, self.marked, self.role = tag, parent, [], (), frozenset(), ""
        self.key, self.size = 0, 0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        # open elements by tag since the nearest scope and the nearest container, shared along the way down
        self.scope = {} if parent is None or tag in SCOPE else parent.scope
        self.listed = {} if parent is None or tag in CONTAINERS else parent.listed
        if attributes and ("class" in attributes or "id" in attributes or "role" in attributes or not attributes.islower()):
            found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
            names = f"{found.get('class', '')} {found.get('id', '')}"
            self.marks, self.marked = tuple(_WORD.findall(names)), marks_of(names)
            self.role = found.get("role", "")

    def unwanted(self, half: float) -> bool:
        """Marked by tag, role or class as not of the article; ``half`` is half of the page's text.

        The marks of ``html``, ``body`` and of what holds more than half of the text say how the page looks, but for reader comments.
        """
        if self.tag in NEVER_TEXT or self.role in ROLES:
            return True
        marked = self.marked if self.tag not in ("html", "body") and (self.size <= half or not COMMENTS.isdisjoint(self.marked)) else frozenset()
        if not HEADS.issuperset(marked):
            return True
        # in an article a header has the headline
        return (self.tag == "header" or bool(marked)) and not self.inside

    def within(self):
        """All elements below, depth first in page order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            e = stack.pop()
            yield e
            stack += [c for c in reversed(e.children) if isinstance(c, Element)]


def parse(html: str) -> Element:
    """The page's elements, in one go: whether a tag is open is known from counts, so a tag that closes nothing costs nothing."""
    root = at = Element("#page", "", None)
    opened: dict[str, int] = {}  # of all open elements
    pos, n = 0, len(html)
    stop = html.rfind(">") + 1  # no tag ends after it

    def leave(node: Element, to: Element) -> Element:
        while node is not to:
            for count in (opened, node.scope, node.listed):
                count[node.tag] -= 1
            node = node.parent
        return to

    while pos < n:
        m = _TAG.search(html, pos, stop)
        if m is None:
            rest = html[pos:]
            # a comment or a tag that breaks off at the end of the page is no text
            cut = re.search(r"<!--|<(?:/?[a-zA-Z][^<>]*|[/!?][^<>]*)\Z", rest)
            at.children.append(rest[:cut.start()] if cut else rest)
            break
        if m.start() > pos:
            at.children.append(html[pos:m.start()])
        pos = m.end()
        if m[2] is None:
            if pos == stop and m[0].startswith("<!--") and not m[0].endswith("-->"):
                break  # a comment that doesn't end
            continue
        tag = m[2].lower()
        if m[1]:
            if (opened if tag in SCOPE else at.scope).get(tag):
                node = at
                while node.tag != tag:
                    node = node.parent
                at = leave(at, node.parent)
            continue
        if tag in CLOSES_P:
            if at.scope.get("p"):
                node = at
                while node.tag != "p":
                    node = node.parent
                at = leave(at, node.parent)
        elif tag in SIBLINGS:
            while any(at.listed.get(t) for t in SIBLINGS[tag]):
                node = at
                while node.tag not in SIBLINGS[tag]:
                    node = node.parent
                at = leave(at, node.parent)
        element = Element(tag, m[3], at)
        at.children.append(element)
        if tag in VOID or m[3].endswith("/") and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, pos)
            element.children.append(html[pos:end.start()] if end else html[pos:])
            pos = end.end() if end else n
            continue
        for count in (opened, element.scope, element.listed):
            count[tag] = count.get(tag, 0) + 1
        at = element
    return root


CARDS = frozenset(("card", "cards", "teaser", "teasers", "preview"))
NO_ARTICLE = frozenset(("comment", "comments", "ad", "ads", "related"))


def _clean_sizes(order: list[Element], half: float) -> dict[int, int]:
    """By id: characters of text in each element without what is marked as unwanted."""
    sizes, kept = {}, {id(order[0])}
    for e in order[1:]:
        if id(e.parent) in kept and not e.unwanted(half):
            kept.add(id(e))
    for e in reversed(order):
        own = sum(len(w) for c in e.children if isinstance(c, str) for w in c.split()) if id(e) in kept else 0
        sizes[id(e)] = own + sum(sizes[id(c)] for c in e.children if isinstance(c, Element) and id(c) in kept)
    return sizes


def article_of(order: list[Element], half: float) -> list[Element]:
    """The main text: of the outermost articles and ``main`` elements outside of anything unwanted, those that hold the text.

    An article within ``main`` stands for it only with more than half of its text, one outside only with more than all of it.
    Without ``main`` all outermost articles are the text, but for those that their class calls cards."""
    is_article = lambda e: e.tag == "article"
    is_main = lambda e: e.tag == "main" or e.role == "main"
    hidden, in_article, in_main, found = set(), set(), {}, []
    for e in order[1:]:
        up = id(e.parent)
        if up in hidden or e.tag in NEVER_TEXT:
            hidden.add(id(e))
            continue
        if up in in_article or is_article(e) or (up in in_main and is_main(e)):
            if is_article(e) and up not in in_article and e.marked.isdisjoint(NO_ARTICLE):
                found.append((e, in_main.get(up)))
            if up in in_article or is_article(e):
                in_article.add(id(e))
        elif is_main(e) and e.marked.isdisjoint(NO_ARTICLE):
            in_main[id(e)] = e
            found.append((e, None))
        if up in in_main and id(e) not in in_main:
            in_main[id(e)] = in_main[up]
    if len(found) < 2:
        return [e for e, _ in found] or [order[0]]
    sizes = _clean_sizes(order, half)
    inside, outside = [], []
    for e, main in found:
        if is_main(e) and not is_article(e):
            inside += [a for a, m in found if m is e and 2 * sizes[id(a)] > sizes[id(e)]] or [e]
        elif main is None:
            outside.append(e)
    outside = [e for e in outside if CARDS.isdisjoint(e.marks)] or outside
    # beside a main element, an article outside of it counts when it holds more text
    text = sum(sizes[id(e)] for e in inside)
    larger = [e for e in outside if sizes[id(e)] > text]
    return (larger or inside) if inside else outside


def _measure(root: Element) -> list[Element]:
    """Subtree hashes and text sizes bottom up; gives all elements in page order."""
    from xxhash import xxh64

    order = [root, *root.within()]
    for e in reversed(order):
        h, size = xxh64(f"{e.tag} {' '.join(e.marks)}"), 0
        for c in e.children:
            if isinstance(c, Element):
                h.update(c.key.to_bytes(8, "little"))
                size += c.size
            elif e.tag not in ("script", "style"):
                words = c.split()
                h.update(" ".join(words))
                size += sum(map(len, words))
            else:
                size = 0
        e.key, e.size = h.intdigest(), size
    return order


def _candidates(order: list[Element], articles: list[Element]) -> tuple[list[Element], set[int]]:
    """The elements that may be template, and the ids of all within an article, which get keys of their own."""
    holders: set[int] = set()
    for e in articles:
        while e is not None and id(e) not in holders:
            holders.add(id(e))
            e = e.parent
    inner = {id(e) for a in articles for e in a.within()}
    half, head, found = order[0].size / 2, set(), []
    for e in order[1:]:
        if id(e) in inner:
            e.key ^= INNER
        if id(e.parent) in head or e.parent.tag == "head":
            head.add(id(e))
        elif e.tag not in INLINE and e.tag not in PROSE and e.tag not in ("html", "head", "body", *VOID) and id(e) not in holders and 0 < e.size <= half:
            found.append(e)
    return found, inner


def _rests(article: Element, ids: set[int], half: float) -> dict[int, int]:
    """By key of the elements ``ids`` in the article: a hash of the article's text without the elements of that key."""
    from xxhash import xxh64_intdigest

    order, own = [article, *article.within()], {}
    for e in order:
        if e is article or id(e.parent) in own and not e.unwanted(half):
            own[id(e)] = sum(xxh64_intdigest(" ".join(c.split())) for c in e.children if isinstance(c, str) and not c.isspace())
    for e in reversed(order[1:]):
        if id(e) in own:
            own[id(e.parent)] += own[id(e)]
    rest: dict[int, int] = {}
    for e in order:
        if id(e) in ids:
            rest[e.key] = rest.get(e.key, own[id(article)]) - own.get(id(e), 0)
    return {k: r & (1 << 64) - 1 for k, r in rest.items()}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def template_keys(html: str) -> list[tuple[int, int | None, int]]:
    """Key of the subtrees of a page that may be template, the rest of the article (none outside) and 1 at the first row of a key."""
    root = parse(html)
    order = _measure(root)
    articles = article_of(order, root.size / 2)
    found, inner = _candidates(order, articles)
    rows = {(_signed(e.key), None) for e in found if id(e) not in inner}
    ids = {id(e) for e in found if id(e) in inner}
    if ids:
        rows.update((_signed(k), _signed(r)) for a in articles for k, r in _rests(a, ids, root.size / 2).items())
    seen: set[int] = set()
    return [(k, r, int(k not in seen and not seen.add(k))) for k, r in rows]


def extract(html: str, template: set[int]) -> tuple[str, int]:
    """The article's text without template subtrees and unwanted elements; how many template subtrees went."""
    root = parse(html)
    order = _measure(root)
    articles = article_of(order, root.size / 2)
    dropped = {id(e) for e in _candidates(order, articles)[0] if _signed(e.key) in template}
    below, gone = set(), 0
    for e in order[1:]:
        if id(e.parent) in below:
            below.add(id(e))
        elif id(e) in dropped:
            below.add(id(e))
            gone += 1
    out: list[str] = []
    for article in articles:
        stack: list = [article]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
                continue
            if e is not article and (id(e) in dropped or e.unwanted(root.size / 2)):
                out.append(" ")
                continue
            edge = "" if e.tag in INLINE else " "  # blocks and line breaks part words
            out.append(edge)
            stack.append(edge)
            stack += reversed(e.children)
        out.append(" ")
    return " ".join(unescape("".join(out)).split()), gone


def host_of(url):
    """The host of a URL in lower case; '' if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit(""))


def _pages(pages: DataFrame) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))


def _page_name():
    return F.coalesce(F.col("page_id").cast("string"), F.lit(""))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """The subtrees of all pages (page_id, page_key, host, key) and those that are template (host, key, n_pages)."""

    def run(batches):
        import pyarrow as pa

        form = pa.list_(pa.struct([("key", pa.int64()), ("rest", pa.int64()), ("first", pa.int64())]))
        for b in slices(batches, "html", BATCH):
            keys = [template_keys(h) for h in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(keys, form)], names=["page_id", "page_key", "host", "keys"])

    rows = _pages(pages).select("page_id", F.xxhash64("url", "html").alias("page_key"), host_of(F.col("url")).alias("host"), "html")
    keyed = materialise(rows.mapInArrow(run, "page_id long, page_key long, host string, keys array<struct<key:long,rest:long,first:long>>"), "subtrees")
    subtrees = keyed.select("page_id", "page_key", "host", F.explode("keys").alias("of")).select("page_id", "page_key", "host", "of.*")
    sites = keyed.groupBy("host").agg(F.count("*").alias("site_pages"))
    counts = subtrees.groupBy("host", "key").agg(F.sum("first").alias("n_pages"), (F.count("rest") > 0).alias("inside")).filter(F.col("n_pages") >= min_pages)
    often = counts.join(sites, "host").filter(F.col("n_pages") >= min_share * F.col("site_pages")).select("host", "key", "n_pages", "inside")
    often = materialise(often, "recurring")
    rests = join_unique(subtrees.filter("rest IS NOT NULL").select("host", "key", "rest"), often.filter("inside"), ["host", "key"], "n_pages", "inner")
    beside = rests.groupBy("host", "key", "n_pages").agg(F.count_distinct("rest").alias("n_rests")).filter(F.col("n_rests") >= min_pages)
    template = often.filter("NOT inside").drop("inside").unionByName(beside.drop("n_rests"))
    return subtrees.select("page_id", "page_key", "host", "key"), materialise(template, "templates")


def extract_articles(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_template (template subtrees that went)."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches, "html", BATCH):
            out = [extract(h, set(k or ())) for h, k in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in out], pa.string()), pa.array([len(t) for t, _ in out], pa.int64()), pa.array([g for _, g in out], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars", "n_template"])

    subtrees, template = site_templates(pages, min_pages, min_share)
    hits = (join_unique(subtrees, template, ["host", "key"], "n_pages", "inner")
            .groupBy(_page_name().alias("page_name"), "page_key").agg(F.collect_set("key").alias("keys"), F.count("*").alias("weight")))
    rows = _pages(pages).withColumn("page_key", F.xxhash64("url", "html")).withColumn("page_name", _page_name())
    # a page that is repeated very often meets its keys by broadcast
    with_keys = join_unique(rows, materialise(hits, "hits"), ["page_name", "page_key"], "weight").select("page_id", "url", "html", "keys")
    return with_keys.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_template long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(spark.read.parquet(f"{sf_dir}/pages.parquet"))
