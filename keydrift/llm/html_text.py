"""HTML extraction by a site style tree.

Pages of one host are merged: every element of the tree is known by its path of tags with class and id, has the styles
(sequences of children) in which pages show it, and the texts it holds. An element's presentation importance is the
entropy of its styles over the host's pages; a content element's importance falls with the share of pages that repeat its
texts. An inner element's importance is composed from its own and its children's. Branches whose importance and that of
all below them stay under the cut are noise on that host.

What HTML itself declares is taken at its word, on hosts of any number of pages: elements for navigation, forms, scripts
and the like are no content, and an ``article`` or ``main`` is, however often its text occurs. The tree decides on all
other branches. A word of class, id or role ("sidebar") is evidence only. It never removes what holds an ``article``,
``main`` or ``body``; any other branch goes if the tree confirms it by an importance under ``NAMED_CUT``, or if it stands
outside the page's article and holds less text than that. Readers' comments are unique texts, so no statistics can tell
them: a branch that is called so, word for word, goes wherever it stands and however long it is, unless it holds an
``article`` or ``main`` that is no comment itself.

Per host only (path, importance) pairs are kept; texts count as hashes, and no page is gathered with others.

Defined cases: null or empty html gives an empty text; a null or odd url is a host of its own kind; a host with one page
has no repetition, so only the declared elements, and named ones beside a longer article, are removed; repeated rows count as pages each; broken markup is read as
browsers do in the common cases (open paragraphs, stray end tags, an unclosed comment); extra columns are not read.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.llm import tables

CUT = 0.25
#: The same for branches that a word names: no text of theirs is a single page's own, on average.
NAMED_CUT = 0.8
DAMPING = 0.9
#: Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
DECLARED = set(
    "nav footer aside form script style head template noscript iframe button select textarea input object svg canvas menu dialog search".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Words of class, id and role that may name what is no article.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|"
    r"notice|newsletter|subscribe|share|social|related|comments?|disqus|replies|popup|modal|pagination|search)(?:$|[\s_-])",
    re.I,
)
#: Words of class, id and role that comment sections and single comments have.
COMMENTS = frozenset(
    "comment comments commentlist comment-list comments-list comment-area comments-area comment-section comments-section "
    "comment-body comment-thread comments-thread user-comments reader-comments disqus_thread disqus-thread fb-comments respond".split()
)
#: A quote that is never closed reaches to the end, so that no place is looked at twice.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


class Page:
    """One reading of a page: text blocks with the path and declared state of the element that holds them, the children
    of every element, and the branches that a word names."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, bool, bool, str]] = []  # path, declared noise, inside an article, text
        self.under: list[tuple[int, ...]] = []  # of each block: the named branches it stands in
        self.named: list[tuple[str, bool]] = []  # path, inside an article
        self.wrappers: set[int] = set()  # the named branches that hold an article
        self.comments: set[int] = set()  # the named branches that are readers' comments
        self.children: dict[str, list[tuple[str, ...]]] = {}
        self._read(html)

    def _read(self, html: str) -> None:
        # an element: name, path, noise, protected, labels of its children, named branches, a word on an inline element above
        stack: list[tuple[str, str, bool, bool, list[str], tuple[int, ...], bool]] = [("", "", False, False, [], (), False)]
        parts: list[str] = []

        def flush() -> None:
            if parts:
                text = " ".join(references.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    holder = next(e for e in reversed(stack) if e[0] in BLOCKS or not e[0])
                    self.blocks.append((holder[1], holder[2] or stack[-1][2], holder[3], text))
                    self.under.append(holder[5])

        def pop() -> None:
            name, path, labels = stack[-1][0], stack[-1][1], stack[-1][4]
            if name in BLOCKS:
                flush()
                self.children.setdefault(path, []).append(tuple(labels))
            stack.pop()

        def close(name: str) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    while len(stack) > k:
                        pop()
                    return

        at, size = 0, len(html)
        while at < size:
            m = TOKEN.search(html, at)
            text = html[at : m.start()] if m else html[at:]
            if text:
                parts.append(text)
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if name == "br":
                    parts.append(" ")
                elif name not in VOID:
                    close(name)
                continue
            if name in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else size
                continue
            if name == "br":
                parts.append(" ")
                continue
            if name in BLOCKS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        while len(stack) > k:
                            pop()
                        break
                    if stack[k][0] in BLOCKS:
                        break
                if name in CLOSES:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in SCOPES[name]:
                            break
                        if stack[k][0] in CLOSES[name]:
                            while len(stack) > k:
                                pop()
                            break
                flush()
            if name in VOID:
                continue
            marks = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3])}
            # numbers in class and id are of a page, not of its template
            classes = sorted(set(re.sub(r"[0-9]+", "0", marks.get("class", "")).split()))
            label = name + "".join(f".{c}" for c in classes) + ("#" + re.sub(r"[0-9]+", "0", marks["id"]) if marks.get("id") else "")
            up = stack[-1]
            said = {w.lower() for v in marks.values() for w in v.split()}
            comment = name in BLOCKS and name not in ("body", "html") and not COMMENTS.isdisjoint(said)
            whole = name in ("article", "main", "body", "html") and not comment
            named = comment or not whole and (up[6] or any(NAMED.search(v) for v in marks.values()))
            article = up[3] or (whole and name in ("article", "main"))
            noise = up[2] or name in DECLARED or (name == "header" and not up[3])
            if whole and name != "html":
                self.wrappers.update(up[5])
            if name in BLOCKS:
                up_block = next(e for e in reversed(stack) if e[0] in BLOCKS or not e[0])
                up_block[4].append(label)
                path, under = f"{up_block[1]}>{label}", up[5]
                if named:
                    under += (len(self.named),)
                    if comment:
                        self.comments.add(len(self.named))
                    self.named.append((path, up[3]))
                stack.append((name, path, noise, article, [], under, False))
            else:
                # an inline element is no branch: its word names the blocks below it
                stack.append((name, up[1], noise, article, [], up[5], named))
        while len(stack) > 1:
            pop()
        flush()

    def text(self, noise: set[str], named: set[str] | None = None) -> str:
        """The blocks outside declared and noisy branches, one a line. ``named``: the named branches that the tree
        confirms; without a tree (None) words stand alone."""
        size, articles = [0] * len(self.named), 0
        for (_, declared, article, text), under in zip(self.blocks, self.under, strict=True):
            articles += len(text) * (article and not declared)
            for k in under:
                size[k] += len(text)

        def removed(k: int) -> bool:
            path, inside = self.named[k]
            return k not in self.wrappers and (k in self.comments or named is None or path in named or (not inside and size[k] < articles))

        gone = {k for k in range(len(self.named)) if removed(k)}

        def kept(path: str, declared: bool, article: bool, under: tuple[int, ...]) -> bool:
            if declared or not gone.isdisjoint(under):
                return False
            return article or not any(path == n or path.startswith(f"{n}>") for n in noise)

        return "\n".join(t for (path, declared, article, t), under in zip(self.blocks, self.under, strict=True) if kept(path, declared, article, under))


def host_of(url: Column) -> Column:
    """The host in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _hash(value: object) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(repr(value)) - (1 << 63)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, kind, feature, pages): pages of the batch that show a style (kind 0) or a text (kind 1) of an element,
    or name it by a word (kind 3)."""
    for batch in batches:
        seen: Counter = Counter()
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(html or "")
            facts = {(host, p, 0, _hash(c)) for p, all_ in page.children.items() for c in all_}
            facts |= {(host, p, 1, _hash(t)) for p, _, _, t in page.blocks}
            facts |= {(host, p, 3, 0) for p, _ in page.named}
            facts.add((host, "", 2, 0))
            seen.update(facts)
        columns = list(zip(*seen, strict=True)) or [[], [], [], []]
        types = [pa.string(), pa.string(), pa.int32(), pa.int64()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)] + [pa.array(list(seen.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["host", "path", "kind", "feature", "pages"])


def _prefixes(path: str) -> list[str]:
    names = path.split(">")
    return [">".join(names[: k + 1]) for k in range(1, len(names))]


def importances(pages: DataFrame) -> DataFrame:
    """(host, path, kind, shown, m, value): the entropy-based importances of each element.

    Presentation (kind 0): -sum p log_m p over its styles, p a style's share and m the host's pages; content (kind 1):
    1 - mean of log_m (pages that have the text) over its texts. Both are 1 where m is 1. Kind 3 has the named branches.
    """
    facts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_facts, "host string, path string, kind int, feature long, pages long")
    counted = facts.groupBy("host", "path", "kind", "feature").agg(F.sum("pages").alias("n"))
    counted = tables.stored(counted)
    m = counted.where("kind = 2").groupBy("host").agg(F.sum("n").alias("m"))
    each = counted.where("kind != 2").groupBy("host", "path", "kind").agg(
        F.sum("n").alias("shown"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"), F.avg(F.log2("n")).alias("logn")
    )
    rows = each.join(m, "host")
    entropy = (F.log2("shown") - F.col("nlogn") / F.col("shown")) / F.log2("m")
    value = F.when(F.col("m") == 1, F.lit(1.0)).when(F.col("kind") == 0, F.least(entropy, F.lit(1.0))).otherwise(1 - F.col("logn") / F.log2("m"))
    return rows.select("host", "path", "kind", "shown", "m", value.alias("value"))


def highest_of(rows: list[tuple[str, int, float]]) -> dict[str, float]:
    """The highest importance in each branch of one host's tree, from (path, kind, value)."""
    style = {p: v for p, k, v in rows if k == 0}
    content = {p: v for p, k, v in rows if k == 1}
    below: dict[str, list[str]] = {}
    every = {q for p in {*style, *content} if p for q in _prefixes(p)}
    for p in every:
        below.setdefault(p.rpartition(">")[0], []).append(p)
    value: dict[str, float] = {}
    highest: dict[str, float] = {}
    for p in sorted(every, key=lambda p: -p.count(">")):
        own = [content[p]] if p in content else []
        kids = [value[c] for c in below.get(p, [])] + own
        damped = DAMPING ** max(1, len(kids))
        inner = sum(kids) / len(kids) if kids else 0.0
        value[p] = (1 - damped) * style.get(p, 0.0) + damped * inner if below.get(p) else inner
        highest[p] = max([value[p], *own, *(highest[c] for c in below.get(p, []))])
    return highest


def noise_of(rows: list[tuple[str, int, float]], cut: float = CUT) -> list[str]:
    """The topmost noisy branches of one host's tree, from (path, kind, value)."""
    return _topmost(highest_of(rows), cut)


def _topmost(highest: dict[str, float], cut: float) -> list[str]:
    noisy = {p for p, v in highest.items() if v < cut}
    return sorted(p for p in noisy if p.rpartition(">")[0] not in noisy)


def _noise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, confirmed = [], []
        for rows in batch.column("tree").to_pylist():
            highest = highest_of([(r["path"], r["kind"], r["value"]) for r in rows])
            found.append(_topmost(highest, CUT))
            confirmed.append(sorted(r["path"] for r in rows if r["kind"] == 3 and highest.get(r["path"], 1.0) < NAMED_CUT))
        lists = [pa.array(x, pa.list_(pa.string())) for x in (found, confirmed)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), *lists], ["host", "noise", "named"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("html", "noise", "named")), strict=True)
        texts = [Page(h or "").text(set(n or ()), set(w or ())) for h, n, w in rows]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    pages = pages.select("page_id", "url", "html")
    # a host's tree holds what its templates have, not its pages
    trees = importances(pages).groupBy("host").agg(F.collect_list(F.struct("path", "kind", "value")).alias("tree"))
    noise = trees.mapInArrow(_noise, "host string, noise array<string>, named array<string>").where("size(noise) > 0 or size(named) > 0")
    noise = tables.stored(noise)
    rows = pages.withColumn("host", host_of(F.col("url"))).join(noise, "host", "left").select("page_id", "url", "html", "noise", "named")
    return rows.mapInArrow(_extracted, "page_id long, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extracted(tables.table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
