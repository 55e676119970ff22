"""Operator 9: main text of web pages, by equivalence classes of tokens.

The tokens of a page are its structural elements, told apart by their path, and its runs of text.
Over the pages of one host, tokens that occur equally often on every page form an equivalence
class. Classes that are large, frequent and hold an element are valid; nested by their paths they
are the host's template. Runs of text in a valid class are template; what stands in between are
slots. The slots of the main region, an element that the template has once on each page, are the
text; slots inside menus, notices and the like are not.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.arrow import map_batches, settle
from relata.llm.registry import query, table

LEAST_PAGES = 20  # of a host, for a template to be deduced
SUPPORT = 0.9  # share of a host's pages that a template's token is on
MAIN_SHARE = 0.6  # share of a host's text that a main region without a telling name holds

# fixed values: names of elements and of their roles
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr"
    " q ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
           "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside body div footer form header main nav ol section table ul".split())
LEFT_OUT = frozenset(
    "aside button dialog embed footer form head iframe math menu nav noscript object select"
    " svg template textarea".split()
)
ROLES = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment"
    " comments complementary consent contentinfo cookie cookies disqus footer masthead menu menubar"
    " modal nav navbar navigation newsletter notice notification pagination popup promo promotion"
    " related replies reply responses search share sharing sidebar social sponsor sponsored"
    " subscribe toolbar widget".split()
)
READERS = frozenset("comment comments disqus replies reply responses".split())
NOT_ITSELF = frozenset("has no with without".split())  # has-sidebar holds one and is none
HOLDERS = frozenset(
    "area block body box container content inner list outer panel section thread wrap wrapper".split()
)
EXEMPT = frozenset("body html main".split())
MAIN = ("article", "main")
LONG = 240  # letters from which a path is told by a hash of its beginning

# no alternative goes beyond the next "<" outside quotes, so an unclosed tag costs its own length
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+|[^<>]*)>"
    r"|<[!?][^<>]*>",
    re.S | re.I,
)
_ROLE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"[0-9]+")
_NAMES = re.compile(r"[^A-Za-z0-9]+")


def _role_words(name: str, roles: list[str]) -> set[str]:
    """The role words that an element's class, id and role name it by.

    A compound like ``main-menu`` is what its last word says, words for mere holders left aside. An
    article goes by whole words only; a body or main element by none.
    """
    if name in EXEMPT:
        return set()
    found = set()
    for token in " ".join(roles).lower().split():
        parts = [w for w in _NAMES.split(token) if w.strip("0123456789")]
        if len(parts) > 1 and (name == "article" or NOT_ITSELF & set(parts)):
            continue
        while len(parts) > 1 and parts[-1] in HOLDERS:
            parts.pop()
        if parts and parts[-1] in ROLES:
            found.add(parts[-1])
    return found


class _Page:
    """Blocks of text, each with its runs and its path, and the elements of a page.

    Time and memory are linear in the page: a path is bounded in length, open names are counted,
    and the tree of paths is kept as parents. ``shown`` are elements, by number, that a role word
    does not hide.
    """

    def __init__(self, source: str, shown: frozenset[int] = frozenset()) -> None:
        self.names: list[str] = []  # open structural elements
        self.paths: list[str] = [""]
        self.hidden = [False]  # by open element: left out
        self.roles: list[int] = []  # by open element: its number if a role word hides it, else 0
        self.open: Counter[str] = Counter()
        self.elements: Counter[str] = Counter()
        self.tree: dict[str, tuple[str, str, int]] = {}  # path: parent, name, depth; parents first
        self.blocks: list[tuple[str, list[str]]] = []
        self.runs: list[str] = []
        self.spans: list[str] = []  # inline elements open since one with a role word began
        self.span_names: Counter[str] = Counter()
        self.plain = False  # the block has text outside of these
        self.shown = shown
        self.number = 0
        self.left_out = 0  # open elements that are hidden by their name or by readers' words
        self.holders: frozenset[int] = frozenset()  # what hides the first hidden article
        at = 0
        for found in _TOKEN.finditer(source):
            self._text(source[at : found.start()])
            at = found.end()
            if name := found[3]:
                self._tag(name.lower(), bool(found[2]), found[4] or "")
        self._text(source[at:])
        self._end_block()

    def _text(self, raw: str) -> None:
        if raw and not self.hidden[-1]:
            self.runs.append(raw)
            self.plain = self.plain or (not self.spans and not raw.isspace())

    def _end_block(self) -> None:
        """Close the block. One that holds inline elements with a role word alone is left out."""
        if self.runs and self.plain:
            self.blocks.append((self.paths[-1], self.runs))
        self.runs, self.plain = [], False
        if self.spans:
            self.spans = []
            self.span_names.clear()

    def _pop(self, name: str, within: frozenset[str] = frozenset()) -> None:
        if not self.open[name]:
            return
        for depth in range(len(self.names) - 1, -1, -1):
            if self.names[depth] == name:
                self._end_block()
                for closed in range(depth, len(self.names)):
                    self.open[self.names[closed]] -= 1
                    self.left_out -= self.roles[closed] < 0
                del self.names[depth:], self.roles[depth:]
                del self.paths[depth + 1 :], self.hidden[depth + 1 :]
                return
            if self.names[depth] in within:
                return

    def _span(self, name: str, closes: bool, told: bool) -> None:
        if closes:
            while self.span_names[name]:
                last = self.spans.pop()
                self.span_names[last] -= 1
                if last == name:
                    break
        elif name not in VOID and (told or self.spans):
            self.spans.append(name)
            self.span_names[name] += 1

    def _tag(self, name: str, closes: bool, attributes: str) -> None:
        if closes:
            if name in INLINE:
                self._span(name, True, False)
            else:
                self._pop(name)
            return
        roles = [next(filter(None, m), "") for m in _ROLE.findall(attributes)] if attributes else []
        words = _role_words(name, roles) if roles else set()
        if name in INLINE:
            if name == "br":
                self._text(" ")
            self._span(name, False, bool(words))
            return
        if name in VOID:
            self._end_block()
            return
        self._pop("p", SCOPES)
        for other in IMPLIED.get(name, ()):
            self._pop(other, SCOPES)
        self._end_block()
        self.number += 1
        in_main = any(self.open[n] for n in MAIN)
        header = not in_main and (
            name == "header" or "header" in {w for r in roles for w in _NAMES.split(r.lower())}
        )
        told = bool(words) and self.number not in self.shown
        out = name in LEFT_OUT or told or (header and name not in EXEMPT)
        lasting = out and (name in LEFT_OUT or bool(words & READERS) or not words)
        self.names.append(name)
        self.open[name] += 1
        self.roles.append(-1 if lasting else self.number if told else 0)
        self.left_out += lasting
        self.paths.append(self._path(name, roles))
        self.hidden.append(self.hidden[-1] or out)
        if not self.hidden[-1]:
            self.elements[self.paths[-1]] += 1
            self.tree.setdefault(self.paths[-1], (self.paths[-2], name, len(self.names)))
        elif name in MAIN and not self.holders and not self.left_out:
            self.holders = frozenset(n for n in self.roles if n > 0)

    def _path(self, name: str, roles: list[str]) -> str:
        label = name + "".join(f".{_DIGITS.sub('0', r)}" for r in roles)
        if len(label) > LONG // 2:
            label = f"{name}.#{xxhash.xxh3_64_hexdigest(label)}"
        before = self.paths[-1]
        if len(before) + len(label) >= LONG:
            before = f"#{xxhash.xxh3_64_hexdigest(before)}"
        return f"{before}/{label}"

    def sizes(self) -> Counter[str]:
        """Letters of text inside each element, those inside its members included."""
        inside: Counter[str] = Counter()
        for path, block in self.blocks:
            inside[path] += sum(map(len, block))
        for path in reversed(self.tree):
            inside[self.tree[path][0]] += inside[path]
        return inside

    def within(self, main: str) -> set[str]:
        """The paths inside ``main``, itself included."""
        found = {main} if main in self.tree else set()
        for path, (parent, _, _) in self.tree.items():
            if parent in found:
                found.add(path)
        return found

    def own_main(self) -> str | None:
        """The page's own article or main element, the outermost and first."""
        own = [p for p, (_, name, _) in self.tree.items() if name in MAIN]
        return min(own, key=lambda p: self.tree[p][2]) if own else None


def _page(source: str) -> _Page:
    """A page. Role words that hide its only article do not hide it, if it is the larger part."""
    page = _Page(source)
    if page.holders and page.own_main() is None:
        other = _Page(source, page.holders)
        main = other.own_main()
        if main and other.sizes()[main] > page.sizes()[""]:
            return other
    return page


def _run_key(path: str, run: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\n{run}") - 2**63


def _spoken(runs: list[str]) -> str:
    return " ".join(entities.unescape("".join(runs)).split())


def _token_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The distinct tokens of each page: how often, and for an element the text inside."""
    rows = []
    hosts, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for host, page_id, source in zip(hosts, pages, batch.column(2).to_pylist()):
        page = _page(source)
        inside = page.sizes()
        runs: Counter[int] = Counter()
        for path, block in page.blocks:
            for run in block:
                if run.strip():
                    runs[_run_key(path, run)] += 1
        for path, n in page.elements.items():
            parent, name, depth = page.tree[path]
            rows.append((host, page_id, path, None, n, inside[path], parent, name, depth))
        rows += [(host, page_id, None, key, n, 0, None, None, None) for key, n in runs.items()]
    kinds = [
        pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
        pa.string(), pa.int32(),
    ]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)],
        names=["host", "page", "path", "run", "times", "chars", "parent_path", "element", "depth"],
    )


def templates(pages: DataFrame) -> DataFrame:
    """Valid classes of each host of ``pages`` (host, page, html), a row per token.

    Returns host, path or run, class (the occurrence vector, as a hash), once (on each page), chars
    (text inside an element on all pages), and an element's name, depth and parent_path, which nests
    the classes. Vectors are
    hashes per page, combined by exclusive or, so equal ones meet in an aggregation that adds up
    ahead of the shuffle, however many pages a host has.
    """
    tokens = map_batches(
        pages,
        _token_rows,
        "host string, page long, path string, run long, times long, chars long,"
        " parent_path string, element string, depth int",
    )
    counted = tokens.groupBy("host", "path", "run").agg(
        F.count("*").alias("n_pages"),
        F.sum("times").alias("times"),
        F.bit_xor(F.xxhash64("page", "times")).alias("vector"),
        F.sum("chars").alias("chars"),
        *[F.max(c).alias(c) for c in ("parent_path", "element", "depth")],
    )
    sizes = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    frequent = settle(
        counted.where(F.col("n_pages") >= LEAST_PAGES)
        .join(sizes, "host")
        .where(F.col("n_pages") >= SUPPORT * F.col("host_pages"))
        .withColumn("class", F.xxhash64("n_pages", "times", "vector")),
        "frequent-tokens",
    )
    valid = (
        frequent.groupBy("host", "class")
        .agg(F.count("*").alias("size"), F.count("path").alias("elements"))
        .where("size > 1 AND elements > 0")
    )
    return frequent.join(valid, ["host", "class"]).select(
        "host",
        "path",
        "run",
        "class",
        (F.col("times") == F.col("n_pages")).alias("once"),
        "chars",
        "parent_path",
        "element",
        "depth",
    )


def _guides(found: DataFrame) -> DataFrame:
    """Per host the path of the main region and the template's runs, as many as a page has."""
    named = F.col("element").isin(*MAIN)
    whole = F.max(F.col("chars"))
    regions = found.where("path IS NOT NULL AND once")
    largest = regions.groupBy("host").agg(whole.alias("all_chars"))
    fitting = (
        regions.join(largest, "host")
        .where(named | (F.col("chars") >= MAIN_SHARE * F.col("all_chars")))
        .groupBy("host")
        .agg(
            F.max_by(
                "path", F.struct(named.alias("named"), F.col("depth"), F.length("path"), F.col("path"))
            ).alias("main")
        )
    )
    runs = found.where("run IS NOT NULL").groupBy("host").agg(F.collect_set("run").alias("runs"))
    return fitting.join(runs, "host", "full")


def _texts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    out = []
    for source, main, runs in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
        page = _page(source)
        known = frozenset(runs or ())
        inside = page.within(main) if main else set()
        if not any(path in inside for path, _ in page.blocks):
            own = page.own_main()
            inside = page.within(own) if own else None
        blocks = []
        for path, block in page.blocks:
            if inside is None or path in inside:
                if known:
                    block = [r for r in block if not r.strip() or _run_key(path, r) not in known]
                if text := _spoken(block):
                    blocks.append(text)
        out.append("\n".join(blocks))
    yield pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(out, pa.string())],
        names=["page_id", "url", "text"],
    )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html).

    Blocks stand in page order with a line break between; character references are decoded, runs of
    white space become a blank, and a line break element counts as white space.

    A null or empty page has the text ''. Pages without a host in their url form one host. Hosts of
    fewer than ``LEAST_PAGES`` pages have no template; there, and on pages without their host's
    main region, the page's own article or main element, else all that is not left out, is taken.
    Repeated rows all stay; a page_id counts once per row. Other columns are left out. No rows give
    no rows.
    """
    rows = pages.select(
        "page_id",
        "url",
        F.coalesce("html", F.lit("")).alias("html"),
        F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://([^/?#]*)", 1)).alias(
            "host"
        ),
    )
    known = rows.select("host", F.coalesce("page_id", F.lit(-1)).cast("long").alias("page"), "html")
    guides = settle(_guides(templates(known)), "templates")
    joined = rows.join(guides, "host", "left").select("page_id", "url", "html", "main", "runs")
    kinds = dict(pages.dtypes)
    texts = map_batches(joined, _texts, f"page_id {kinds['page_id']}, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query("op9_html_extraction")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return main_text(table(spark, folder, "pages"))
