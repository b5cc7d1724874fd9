"""HTML extraction by a site style tree.

Pages of one host are merged into one tree of element paths (tag, id and class from the root down; paths end DEPTH
elements deep, deeper elements belong to their ancestor there).  For each path of a host, over the m pages that have it:

* presentation importance N: the entropy, in base m, of the styles it has (its child elements and the inline layouts of
  its blocks);
* content importance C of its own texts: 1 minus the mean of log_m k, where a text is found in k pages of the host;
* importance of the branch, composed from the leaves up: (1 - G^l) N + G^l S, with l styles, G = 0.9 and S the mean of C
  and the children's importance, weighted by the pages that have them.

Texts and styles that hardly vary from page to page make menus, notices, adverts and footers.  A branch below THRESHOLD
in PAGES pages or more is removed from each page of the host, inside <article> and <main> too, but never one that holds
an article, or the path with most text of the page (of its articles, if it has any).  Pages of a host with the same first
heading in their article, or without one with the same blocks, count once, so copies and near copies do not make an
article a notice; paths of fewer than PAGES such pages are judged with copies counted, but removed only beside an article.

What an element is said to be is a prior on top of that.  A tag or role that means menu, sidebar, footer, form or dialog
removes its branch.  An id or class that is a known name of boilerplate as a whole (or ends in one) removes a branch
outside the article, or with half the links or half the text at most; names of reader comments remove theirs.  An article
or main below such an element is kept if the page has no other one, so a menu that is never closed does not take the
article with it.  This cleans hosts of few pages, and menus that differ from page to page.

The composition is a sum over descendants, each weighted by the product of the weights on its way up: grouped counts over
(host, path), no recursion.  Counts are combined before the shuffle, so a host with a third of all pages is spread.  Pages
meet the removed paths of their host (some of its distinct paths) by broadcast up to SENT paths, by a salted join beyond.

Defined cases: null or empty html gives an empty text; a null or malformed url is host ''; unclosed and stray tags
are read leniently; a script, style, title or textarea without an end tag reaches to the end of the page, another
element that is left out whole is then ignored alone; a head without an end tag ends where something else than a
head's elements starts; a tag cut off by the end of the page is dropped;
repeated pages are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm._shared import materialise, small_batches

GAMMA, THRESHOLD, PAGES, DEPTH = 0.9, 0.3, 3, 24
SENT, SALTS = 1 << 20, 32

# Fixed values of HTML: elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
RAW = frozenset("script style title textarea noscript template iframe svg math canvas object select option noframes button".split())
TO_END = frozenset("script style title textarea".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
FENCES = frozenset("ul ol dl table article section div main aside nav header footer form body html".split())
HEAD_TAGS = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3".split())

# What an element's tag, role, id or class says it is.
DROP_TAGS = frozenset("nav aside footer form menu dialog head".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
NAMES = frozenset("""
    ad ads adv advert adverts advertisement advertising ad-box ad-slot ad-container ad-wrapper adsbygoogle sponsor sponsored promo promotion
    banner cookie cookies cookie-notice cookie-consent consent gdpr notice notices alert popup modal overlay
    sidebar sidenav rail menu navbar nav navigation breadcrumb breadcrumbs header site-header page-header masthead topbar footer site-footer toolbar
    newsletter newsletter-signup subscribe related related-posts related-articles share sharing share-buttons social social-share social-links
    login signup search search-form skip skip-link pagination pager tags tag-list
""".split())  # fmt: skip
#: A name that ends in one of these words is boilerplate unless a word before says otherwise.
LAST_WORDS = frozenset("ad ads advert adverts advertisement banner popup modal overlay sidebar navbar nav navigation menu breadcrumb breadcrumbs masthead footer toolbar newsletter promo".split())
NOT_SO = frozenset("has have no not with without hide hidden is article entry post content main".split())
COMMENTS = frozenset("comment comments comment-list commentlist comment-thread comments-area comments-section comment-section user-comments reader-comments disqus disqus_thread respond comment-respond replies reply-list".split())
#: Names that, inside an article, are often the article's own.
OWN_IN_ARTICLE = frozenset("header page-header banner notice notices alert tags tag-list skip search rail promotion adv consent cookie cookies related".split())
TITLED = frozenset("h1 h2 h3 h4 h5 h6".split())
KEEP_TAGS = frozenset("html body main".split())
#: Elements that may hold a whole page, as forms of some servers do; what a field of a form counts against its text.
AROUND, FIELDS, FIELD = frozenset("form menu aside".split()), frozenset("input select textarea button".split()), 40
#: How far above an element its pre or code may be.
CODE_DEPTH = 8
NUMBER = re.compile(r"\d+")
HIDDEN = re.compile(r"""\btype\s*=\s*["']?hidden""", re.I)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:![^>]*|\?[^>]*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(id|class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[-_]+")
PLAIN, SEMANTIC, NAMED, COMMENT = range(4)


def _hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value) - (1 << 63)


def _is_name(token: str, inside: bool) -> bool:
    if token in NAMES:
        return not (inside and token in OWN_IN_ARTICLE)
    words = PARTS.split(token)
    return len(words) > 1 and words[-1] in LAST_WORDS and not NOT_SO.intersection(words)


def kind_of(tag: str, said: dict[str, str], inside: bool) -> int:
    """What tag, role, id and class say of an element: nothing, boilerplate by meaning or by name, or reader comments.

    Headings have no names, and elements within a line are no comments.  The id of a section is made from its title more
    often than not, as are ids inside an article: they count where they are a name as a whole.
    """
    if tag in KEEP_TAGS:
        return PLAIN
    names, own = said.get("class", "").lower().split(), said.get("id", "").lower()
    if tag in TITLED:
        names, own = [], ""
    if tag not in INLINE and COMMENTS.intersection((*names, own)):
        return COMMENT
    if tag == "article":
        return PLAIN
    if tag in DROP_TAGS or (tag == "header" and not inside) or said.get("role", "").lower() in DROP_ROLES:
        return SEMANTIC
    whole = inside or tag == "section"
    named = any(_is_name(t, inside) for t in names) or (own in NAMES - OWN_IN_ARTICLE if whole else any(_is_name(t, False) for t in own.split()))
    return NAMED if named else PLAIN


class Page:
    """A page read into elements (parents first; element 0 is the root) and blocks of text, both in page order."""

    def __init__(self, source: str | None, names: bool = True) -> None:
        self.tag, self.parent, self.path, self.depth = [""], [0], [0], [0]
        self.kind, self.inside, self.closed, self.inline = [PLAIN], [-1], [True], [False]
        self.fields = [0]  # of each element: what it holds to be filled in
        self.children: list[list[str]] = [[]]  # of each element: the styles of what it holds, in order
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._read(source or "", names)
        self.size, self.linked = [0] * len(self.tag), [0] * len(self.tag)
        for at, text, linked in self.blocks:
            self.size[at] += len(text)
            self.linked[at] += linked
        for i in range(len(self.tag) - 1, 0, -1):
            self.size[self.parent[i]] += self.size[i]
            self.linked[self.parent[i]] += self.linked[i]
            self.fields[self.parent[i]] += self.fields[i]
        self._judge()

    def _open(self, tag: str, parent: int, said: dict[str, str], inline: bool, kind: int) -> int:
        key = NUMBER.sub("0", f"{tag}#{said.get('id', '')}.{said.get('class', '')}")  # numbered ids are one style
        deep = inline or self.depth[parent] >= DEPTH
        at = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(self.path[parent] if deep else _hash(f"{self.path[parent]} {key}"))
        self.depth.append(self.depth[parent] + (not deep))
        self.kind.append(kind)
        self.inside.append(at if tag in ("article", "main") and self.inside[parent] < 0 and kind != COMMENT else self.inside[parent])
        self.closed.append(False)
        self.inline.append(inline)
        self.fields.append(0)
        self.children.append([])
        if not inline and self.children[parent][-1:] != [key]:
            self.children[parent].append(key)
        return at

    def _read(self, page: str, names: bool) -> None:
        stack: list[tuple[str, int, bool]] = [("", 0, False)]  # open elements: tag, element, in a link
        parts: list[str] = []
        layout: list[str] = []
        unclosed: set[str] = set()
        held = linked = 0
        blank = True

        def flush() -> None:
            nonlocal blank, linked
            text = " ".join("".join(parts).split())
            if text:
                self.blocks.append((held, text, min(linked, len(text))))
                style = " ".join(layout)
                if self.children[held][-1:] != [style]:
                    self.children[held].append(style)
            parts.clear()
            layout.clear()
            blank, linked = True, 0

        at = 0
        while True:
            m = TAG.search(page, at)
            to = m.start() if m else len(page)
            if to > at:
                if stack[-1][0] == "head" and page[at:to].strip():
                    stack.pop()
                if stack[-1][1] != held and not blank:  # an inline advert within a block
                    flush()
                text = html.unescape(page[at:to]) if "&" in page[at:to] else page[at:to]
                if blank:  # the block is where its first visible text is
                    held, blank = stack[-1][1], not text.strip()
                if stack[-1][2]:
                    linked += len(text.strip())
                parts.append(text)
            if not m:
                break
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing, attributes = name.lower(), (m[1] if m[2] else m[4]) == "/", (m[3] if m[2] else m[6]) or ""
            inline = tag in INLINE
            if not inline and tag not in RAW:
                flush()
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        if inline and stack[i][1] != stack[i - 1][1]:
                            flush()
                        self.closed[stack[i][1]] |= not inline
                        del stack[i:]
                        break
                    if inline and stack[i][0] not in INLINE:
                        break
                continue
            if stack[-1][0] == "head" and tag not in HEAD_TAGS:  # its end tag may be omitted
                stack.pop()
            if tag == "br":
                parts.append(" ")
            if inline:
                layout.append(tag)
            if tag in FIELDS and not HIDDEN.search(attributes):
                self.fields[stack[-1][1]] += 1
            if tag in RAW:
                if tag in TO_END or (tag not in unclosed and not attributes.rstrip().endswith("/")):
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                    if end or tag in TO_END:
                        at = end.end() if end else len(page)
                    else:  # nor is there an end for a later one
                        unclosed.add(tag)
                continue
            if tag in VOID:
                continue
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
            for i in range(len(stack) - 1, 0, -1) if tag in CLOSES_SAME else ():
                if stack[i][0] in CLOSES_SAME[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in FENCES:
                    break
            _, parent, link = stack[-1]
            said = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
            in_code = tag in ("pre", "code") or any(t in ("pre", "code") for t, _, _ in stack[-CODE_DEPTH:])
            kind = kind_of(tag, {} if in_code else said, self.inside[parent] >= 0) if names or tag == "head" else PLAIN
            if inline and kind == PLAIN:
                stack.append((tag, parent, link or tag == "a"))
                continue
            if inline:
                flush()
            stack.append((tag, self._open(tag, parent, said, inline, kind), link or tag == "a"))
        flush()

    def _judge(self) -> None:
        """What goes by tag, role or name (gone), and the articles that count (regions)."""
        n = len(self.tag)
        above = [PLAIN] * n  # the strongest kind on the way down to an element
        for i in range(1, n):
            above[i] = max(above[self.parent[i]], self.kind[i])
        starts = [i for i in range(n) if self.inside[i] == i]
        own = {i for i in starts if above[i] == PLAIN}
        saved = set() if own else {i for i in starts if above[i] < COMMENT}
        self.regions = own | saved
        self.gone, leaky = [False] * n, [False] * n
        for i in range(1, n):
            up, kind = self.parent[i], self.kind[i]
            heavy = 2 * self.linked[i] >= self.size[i]
            leaky[i] = leaky[up]
            if i in saved:
                leaky[i] = False
            elif self.gone[up]:
                self.gone[i] = True
            elif kind == SEMANTIC:
                # one that is never closed and has most of the page is a menu with the page after it; a form may be around it
                open_ = not self.closed[i] or (self.tag[i] in AROUND and self.size[i] > FIELD * self.fields[i])
                leaky[i] = open_ and not self.regions and 2 * self.size[i] > self.size[0] and not heavy and self.tag[i] != "head"
                self.gone[i] = not leaky[i]
            elif kind == NAMED:
                around = self.inside[i] if self.inside[i] >= 0 else 0
                outside = bool(self.regions) and around not in self.regions
                self.gone[i] = self.inline[i] or outside or heavy or 2 * self.size[i] <= self.size[around]
            else:
                self.gone[i] = kind == COMMENT or (leaky[up] and heavy and self.size[i] > 0)

    def same_as(self) -> int:
        """Pages of a host with equal values are taken for copies."""
        for at, text, _ in self.blocks:
            if self.tag[at] in HEADINGS and self.inside[at] in self.regions and not self.gone[at]:
                return _hash(f"h {text}")
        whole = xxhash.xxh64()
        for at, text, _ in self.blocks:
            if not self.gone[at]:
                whole.update(f"{self.path[at]} {len(text.encode())} {text}")
        return whole.intdigest() - (1 << 63)

    def features(self) -> tuple[dict[int, set[str]], set[tuple[int, int]], dict[int, list[int]]]:
        """Of elements with text: the styles of each path, the (path, hash) of texts, and the paths above each path."""
        styles: dict[int, set[str]] = {}
        above: dict[int, list[int]] = {}
        for i, path in enumerate(self.path):
            if self.size[i] and not self.inline[i]:
                styles.setdefault(path, set()).add("\n".join(self.children[i]))
                if path not in above:
                    up = self.path[self.parent[i]]
                    above[path] = [*above[up], up] if i else []
        return styles, {(self.path[at], _hash(text)) for at, text, _ in self.blocks}, above

    def main_text(self, low: frozenset[int], beside: frozenset[int]) -> str:
        """The text without what goes by name and without branches of low importance (``beside``: only beside articles)."""
        gone = list(self.gone)
        if low or beside:
            sizes: dict[int, int] = {}
            for at, text, _ in self.blocks:
                if not gone[at] and (not self.regions or self.inside[at] in self.regions):
                    sizes[self.path[at]] = sizes.get(self.path[at], 0) + len(text)
            most = max(sizes, key=sizes.__getitem__, default=None)
            holds = [i in self.regions for i in range(len(gone))]
            for at, _, _ in self.blocks:
                holds[at] |= self.path[at] == most and not gone[at] and (not self.regions or self.inside[at] in self.regions)
            for i in range(len(gone) - 1, 0, -1):
                holds[self.parent[i]] |= holds[i]
            for i in range(1, len(gone)):
                path = self.path[i]
                if not holds[i] and (gone[self.parent[i]] or path in low or (path in beside and self.regions and self.inside[i] not in self.regions)):
                    gone[i] = True
        return "\n".join(text for at, text, _ in self.blocks if not gone[at])


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_counts(pages: DataFrame, names: bool = True) -> DataFrame:
    """pages(host, html) -> one row a (host, path): its paths above, styles l, and sums over styles (0) and texts (1) of
    c and c log c, c being the distinct pages that have one; d counts copies as pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1, 4 << 20):
            hosts, alike, paths, kinds, features, ups = [], [], [], [], [], []
            for host, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(data.decode() if data else "", names)
                styles, texts, above = page.features()
                hosts += [host] * (len(styles) + len(texts))
                alike += [page.same_as()] * (len(styles) + len(texts))
                paths += [*styles, *(p for p, _ in texts)]
                kinds += [0] * len(styles) + [1] * len(texts)
                features += [*(_hash("\n\n".join(sorted(s))) for s in styles.values()), *(t for _, t in texts)]
                ups += [*(above[p] for p in styles), *[None] * len(texts)]
            columns = [pa.array(hosts, pa.string()), *[pa.array(x, pa.int64()) for x in (alike, paths)], pa.array(kinds, pa.int32()), pa.array(features, pa.int64()), pa.array(ups, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "page", "path", "kind", "feature", "up"])

    seen = pages.select("host", F.col("html").cast("string").cast("binary").alias("h")).mapInArrow(run, "host string, page long, path long, kind int, feature long, up array<long>")
    once = seen.groupBy("host", "page", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("k"), F.max("up").alias("up"))
    counts = once.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).cast("double").alias("c"), F.sum("k").cast("double").alias("d"), F.max("up").alias("up"))
    sums = {f"{x}{n}{k}": F.sum(F.when(F.col("kind") == k, v).otherwise(0.0)) for k in (0, 1) for x in "cd" for n, v in (("s", F.col(x)), ("w", F.col(x) * F.log(x)))}
    return counts.groupBy("host", "path").agg(F.max("up").alias("up"), F.sum(F.when(F.col("kind") == 0, 1.0).otherwise(0.0)).alias("l"), *[v.alias(k) for k, v in sums.items()])


def style_tree(pages: DataFrame, names: bool = True) -> DataFrame:
    """pages(host, html) -> (host, path, pages, importance, copies, copied): the merged tree of each host, one row a path; the last two count copies of a page as pages."""
    table = path_counts(pages, names).withColumns({"parent": F.element_at("up", -1), "chain": F.concat("up", F.array("path"))})
    stats = materialise(table.withColumn("parent", F.when(F.size("up") > 0, F.col("parent"))))
    below = stats.where("parent is not null").groupBy("host", F.col("parent").alias("path")).agg(*[F.sum(f"{x}s0").alias(f"{x}n") for x in "cd"])
    shape = F.pow(F.lit(GAMMA), F.col("l"))
    joined = stats.join(below, ["host", "path"], "left")
    for x in "cd":
        base = F.log(f"{x}s0")
        style = F.when(base > 0, (base - F.col(f"{x}w0") / F.col(f"{x}s0")) / base).otherwise(1.0)
        content = F.when(base > 0, F.greatest(F.lit(0.0), 1 - F.col(f"{x}w1") / F.col(f"{x}s1") / base)).otherwise(1.0)
        texts = F.when(F.col(f"{x}s1") > 0, F.col(f"{x}s0")).otherwise(0.0)
        held = texts + F.coalesce(f"{x}n", F.lit(0.0))
        joined = joined.withColumns({f"{x}own": (1 - shape) * style + F.when(texts > 0, shape * texts / held * content).otherwise(0.0), f"{x}share": F.log(shape / held)})
    nodes = materialise(joined.select("host", "path", "parent", "chain", "cs0", "ds0", *[f"{x}{k}" for x in "cd" for k in ("own", "share")]))
    # log of the weight of a path in its parent, then of each path in the root
    up = nodes.select("host", F.col("path").alias("parent"), *[F.col(f"{x}share").alias(f"{x}up") for x in "cd"])
    steps = nodes.join(up, ["host", "parent"], "left").select("host", F.col("path").alias("step"), *[F.coalesce(F.col(f"{x}up") + F.log(f"{x}s0"), F.lit(0.0)).alias(f"{x}e") for x in "cd"])
    ways = nodes.select("host", "path", F.explode("chain").alias("step")).join(steps, ["host", "step"])
    weights = ways.groupBy("host", "path").agg(*[F.sum(f"{x}e").alias(f"{x}weight") for x in "cd"])
    weighed = materialise(nodes.join(weights, ["host", "path"]))
    sums = weighed.select("host", F.explode("chain").alias("path"), *[(F.exp(f"{x}weight") * F.col(f"{x}own")).alias(f"{x}part") for x in "cd"]).groupBy("host", "path").agg(*[F.sum(f"{x}part").alias(f"{x}sum") for x in "cd"])
    found = weighed.join(sums, ["host", "path"])
    return found.select("host", "path", F.col("cs0").cast("long").alias("pages"), (F.col("csum") / F.exp("cweight")).alias("importance"), F.col("ds0").cast("long").alias("copies"), (F.col("dsum") / F.exp("dweight")).alias("copied"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """(page_id, url, text): the main text of every page; without ``names`` by the style tree alone."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    few = F.col("pages") < PAGES
    low = style_tree(rows, names).where((~few & (F.col("importance") < THRESHOLD)) | (few & (F.col("copies") >= PAGES) & (F.col("copied") < THRESHOLD)))
    removed = materialise(low.groupBy("host").agg(F.collect_list(F.struct("path", few.alias("few"))).alias("paths")))
    if (removed.agg(F.sum(F.size("paths") + 4)).first()[0] or 0) <= SENT:
        joined = rows.join(F.broadcast(removed), "host", "left")
    else:  # pages of a host go to SALTS places
        salted = removed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2, 4 << 20):
            out, last, gone = [], None, (frozenset(), frozenset())
            for page, paths in zip(batch.column(2), batch.column(3), strict=True):
                if paths != last:
                    last, listed = paths, paths.as_py() or ()
                    gone = tuple(frozenset(x["path"] for x in listed if x["few"] == few) for few in (False, True))
                data = page.as_py()
                out.append(Page(data.decode() if data else "", names).main_text(*gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return joined.select("page_id", "url", F.col("html").cast("binary").alias("h"), "paths").mapInArrow(run, f"page_id {kind}, url string, text string")


def blocks(page: str | None, names: bool = True) -> list[tuple[str, bool]]:
    """(text, whether it goes by tag, role or name) of each block of a page."""
    read = Page(page, names)
    return [(text, read.gone[at]) for at, text, _ in read.blocks]
