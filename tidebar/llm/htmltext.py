"""Main text of web pages, by templates deduced from equivalence classes of tokens.

A page is a sequence of tokens: a tag, told apart by the path of elements that it
stands in, or the text between two tags with its path. Over the pages of a host
each token has an occurrence vector, how often each page has it. A vector is
summed up as it goes: the counts times a 64-bit hash of the page, in two sums, so
a host of any size needs a few numbers for each token and map tasks add up
theirs before anything moves. Pages of a host whose longest text is the same
count once, so copies of an article don't make it a template.

1. Tokens on at least ``SHARE`` of a host's pages, and at least ``SUPPORT``, are
   grouped by their vectors; a group of ``LARGE`` tokens or more is a class.
2. A class is valid where its tokens come in one order on all pages, again and
   again: tokens whose place in that order varies are taken out, and so is, of
   two classes that cross on a page, the smaller one. What remains nests: inside a
   run of one class's tokens lie runs of others.
3. Between the tokens of the innermost open run lie slots. Their text and the part
   of it in links are added up over the host; a slot outside of any article that
   is mostly links is a menu.
4. A page's text is what its slots hold: text that is a template token is left
   out, as are menus and all that stands in elements for navigation, headers,
   footers, sidebars, notices, adverts, forms, scripts, styles and comments, by
   their names, roles or classes. If the page has an article, it is that of the
   article alone. A header inside an article is part of it.

Pages of hosts with fewer than ``SUPPORT`` different pages have no template: their
own tags alone bound their slots, and blocks outside of an article that are links
only are menus.

Templates are joined with pages by host: Spark sends them to all tasks below its
broadcast limit, and sorts beyond it, where the pages of one host may be split.

Defined cases: a null or empty html has the text "". A null url, or one without a
host, has no template. Rows are handled one by one, so repeated rows and ids come
back as often as they are there. Unclosed elements end where their parent does, or
where the next paragraph or list item begins; an unclosed comment, script or tag
takes the rest of the page. A line break inside a block is white space. An empty
table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import html as html_entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship
from .shared import remove, table, written

SUPPORT, SHARE, LARGE = 5, 0.8, 3
#: Hosts whose template a task remembers.
KNOWN = 256

# Kinds of elements of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_PARAGRAPH = BLOCKS - frozenset("body caption dd dt head html legend li optgroup option summary tbody td tfoot th thead title tr".split())
ENDS_SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set())}
RAW = "script|style|noscript|template|iframe|noframes|noembed|xmp|textarea|title|svg|math|object|select|canvas|video|audio"
# Elements, roles and parts of class names and ids that aren't the main text.
SIDE = frozenset("head nav footer aside form dialog menu button fieldset datalist search".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
SIDE_NAMES = re.compile(
    r"nav|navs|navbar|navi|navigation|menus?|menubar|breadcrumbs?|masthead|topbar|footer|sidebars?|aside|rail|ads?|adbox|adslot|adunit|adsense|adverts?|advertisements?|advertising|sponsor|sponsors|sponsored|promos?|promotions?|promoted|banners?|cookies?|cookiebar|consent|gdpr|notices?|notifications?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|signup|login|forms?|search|searchbox|share|sharing|social|comments?|commentlist|disqus|respond|replies|related|recommended|recommendations|pagination|pager|toolbar|copyright|disclaimer"
)
#: Only as the first part of a name, or outside of articles in a name that isn't of an article's part.
SIDE_FIRST = frozenset("widget widgets foot".split())
HEADED = frozenset("article post entry content section story".split())
NOT_ITSELF = frozenset("has with no without".split())

_PIECE = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>]|\Z)(?:=\s*\"[^\"]*+(?:\"|\Z)|=\s*'[^']*+(?:'|\Z)|[^>])*+(?:>|\Z)(?:(?<=/>)|.*?(?:</\1\s*>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*+(?:\"|\Z)|=\s*'[^']*+(?:'|\Z)|[^>])*+)(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)
_UNSIGNED = (1 << 64) - 1
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Where a text stands: in an article; in one that stands in a box with the class of a side element; outside of any; in a side element.
MAIN, BOXED, OUTSIDE, ASIDE = range(4)


def _side_by_name(value: str, inside: bool) -> bool:
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if not words or words[0] in NOT_ITSELF:
            continue
        if words[0] in SIDE_FIRST or any(map(SIDE_NAMES.fullmatch, words)) or "header" in words and not inside and not HEADED & set(words):
            return True
    return False


def _hash(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), path) - (1 << 63)


def tokens(html: str) -> Iterator[tuple[int, str | None, bool, int, bool]]:
    """(token, text, whether a block ends here, place, whether in a link); tags have no text, and the place is the one that they open."""
    # an element: name, path, strictly aside, aside by its class, in an article, in a link
    stack: list[tuple] = [("", 0, False, False, False, False)]
    opened: Counter[str] = Counter()

    def close(names, until=frozenset()) -> None:
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                opened.subtract(e[0] for e in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in until:
                return

    def place() -> int:
        _, _, strict, named, main, _ = stack[-1]
        return ASIDE if strict or named and not main else BOXED if named else MAIN if main else OUTSIDE

    def text(raw: str):
        data = html_entities.unescape(raw)
        return _hash(stack[-1][1] & _UNSIGNED, "#" + " ".join(data.split())), data, False, place(), stack[-1][5]

    at = 0
    for m in _PIECE.finditer(html):
        if m.start() > at:
            yield text(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue  # comment, declaration, or an element that is never text
        block = name in BLOCKS
        if m[2]:
            token = _hash(stack[-1][1] & _UNSIGNED, "/" + name)
            if block:
                close({name}, {"table", "td", "th"} if name == "p" else frozenset())
            elif name not in VOID:
                close({name}, BLOCKS)
            yield token, None, block, OUTSIDE, False
            continue
        if name in ENDS_PARAGRAPH:
            close({"p"}, {"table", "td", "th", "button", "article", "aside", "main"})
        if name in ENDS_SIBLING:
            close(*ENDS_SIBLING[name])
        _, path, strict, named, main, link = stack[-1]
        found = {a[1].lower(): (a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[4])} if len(m[4]) > 3 else {}
        names = (found.get("class", "") + " " + found.get("id", "")).strip()
        path = _hash(path & _UNSIGNED, name + " " + re.sub(r"\d+", "", names))
        if name in VOID or m[4].endswith("/") and name not in BLOCKS:
            yield path, None, block, OUTSIDE, False
            if name == "br":
                yield 0, " ", False, place(), link
            continue
        role = found.get("role", "").lower()
        opens = name in ("article", "main") or role in ("main", "article") or found.get("itemprop") == "articleBody"
        strict = strict or name in SIDE or role in SIDE_ROLES or "hidden" in found or bool(_UNSEEN.search(found.get("style", ""))) or name == "header" and not main
        if name not in ("html", "body", "main") and names and _side_by_name(names, main):
            named = True
            if main or opens:  # inside an article, or the article itself
                strict = True
        opened[name] += 1
        stack.append((name, path, strict, named, main or opens, link or name == "a"))
        yield path, None, block, place(), False
    if at < len(html):
        yield text(html[at:])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page's tokens in order; whether each is there for the first time; the characters of texts, negative in links; a hash of the longest text."""
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for host, html in zip(batch.column("_host").to_pylist(), batch.column("html"), strict=True):
            html = html.as_py()
            if not host or not html:
                continue
            seen: set[int] = set()
            sequence, first, weight, longest = [], [], [], ""
            for token, data, _, place, link in tokens(html):
                if data is not None and (token == 0 or not data.strip()):
                    continue
                data = data and " ".join(data.split())
                sequence.append(token)
                first.append(token not in seen)
                seen.add(token)
                n = len(data) if data else 0
                weight.append(-n if link else n)
                if data and place != ASIDE and n > len(longest):
                    longest = data
            for column, value in zip(out, (host, _hash(0, longest), _hash(1, html), sequence, first, weight), strict=True):
                column.append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["host", "content", "page", "sequence", "first", "weight"])


class Template:
    """The classes of a host's tokens."""

    def __init__(self, tokens=(), menus=()):
        own: dict[int, list] = {}
        for e in tokens or ():
            own.setdefault(e["class"], []).append((e.get("place", 0), e["token"]))
        self.size = {c: len(members) for c, members in own.items()}
        #: (class, place in its order) of each token; places are those among the tokens that were left
        self.of = {token: (c, i) for c, members in own.items() for i, (_, token) in enumerate(sorted(members))}
        self.menus = frozenset(menus or ())


def _templates(batch: pa.RecordBatch, known: dict[str, Template], host: str) -> Iterator[Template]:
    """The template of each row. ``known`` keeps those of some hosts, so that each isn't built again for every page."""
    menus = batch.column("menus") if "menus" in batch.schema.names else None
    for i, name in enumerate(batch.column(host).to_pylist()):
        if name not in known:
            if len(known) >= KNOWN:
                known.clear()
            known[name] = Template(batch.column("template")[i].as_py(), menus[i].as_py() if menus is not None else ())
        yield known[name]


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, id, is_class, least, greatest): for each token of a class its places in the class's order; for each class 1 if it crosses a larger one, else 0."""
    known: dict[str, Template] = {}
    for batch in batches:
        found: dict[tuple, list[int]] = {}
        for host, sequence, template in zip(batch.column("host").to_pylist(), batch.column("sequence").to_pylist(), _templates(batch, known, "host"), strict=True):
            places: dict[int, list[int]] = {}
            for i, token in enumerate(sequence):
                if token in template.of:
                    places.setdefault(template.of[token][0], []).append(i)
            spans = []
            for c, own in places.items():
                k = template.size[c]
                for i, p in enumerate(own):
                    seen = found.setdefault((host, sequence[p], False), [i % k, i % k])
                    seen[0], seen[1] = min(seen[0], i % k), max(seen[1], i % k)
                spans += [(own[i], -own[min(i + k, len(own)) - 1], c) for i in range(0, len(own), k)]
                found.setdefault((host, c, True), [0, 0])
            around: list[tuple] = []
            for start, end, c in sorted(spans):  # ends are negative: of equal starts the longest comes first
                around = [o for o in around if -o[0] >= start]
                for o in around:
                    if o[0] > end and o[1] != c:
                        found[host, min((o[1], c), key=lambda x: (template.size[x], x)), True][1] = 1
                around = [o for o in around if o[0] <= end] + [(end, c)]
        keys = list(found)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_()))] + [pa.array([found[k][i] for k in keys], pa.int32()) for i in range(2)]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "id", "is_class", "least", "greatest"])


class Walk:
    """Goes over a page's tokens and tells which slot of its template it is in."""

    def __init__(self, template: Template):
        self.template, self.open = template, []

    def meet(self, token: int) -> bool:
        """True if it is a token of the template."""
        if token not in self.template.of:
            return False
        c, place = self.template.of[token]
        for i, (own, _) in enumerate(self.open):
            if own == c:
                del self.open[i:]
                break
        if place < self.template.size[c] - 1:
            self.open.append((c, place))
        return True

    def slot(self) -> int:
        return _hash(self.open[-1][0] & _UNSIGNED, str(self.open[-1][1])) if self.open else 0


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, slot, chars, linked): the characters in slots, and of them in links."""
    known: dict[str, Template] = {}
    for batch in batches:
        found: dict[tuple, list[int]] = {}
        for host, sequence, weight, template in zip(*(batch.column(c).to_pylist() for c in ("host", "sequence", "weight")), _templates(batch, known, "host"), strict=True):
            walk = Walk(template)
            for token, n in zip(sequence, weight, strict=True):
                if not walk.meet(token) and n:
                    own = found.setdefault((host, walk.slot()), [0, 0])
                    own[0] += abs(n)
                    own[1] += max(-n, 0)
        keys = list(found)
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *(pa.array([found[k][i] for k in keys], pa.int64()) for i in range(2))]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "slot", "chars", "linked"])


def deduce_templates(pages: DataFrame) -> DataFrame:
    """host, template (tokens with class and place), menus (slots that are mostly links), for hosts that have one. ``pages`` has _host and html."""
    sketches = pages.select("_host", "html").mapInArrow(_sketch, "host string, content long, page long, sequence array<long>, first array<boolean>, weight array<int>")
    one = F.min_by(F.struct("sequence", "first", "weight"), "page").alias("s")
    sketches = written(sketches.groupBy("host", "content").agg(one).select("host", "content", "s.*"), "sketches")

    token = F.explode(F.arrays_zip("sequence", "first")).alias("t")
    half = F.xxhash64("content")
    occurrences = sketches.select("host", half.bitwiseAND(0xFFFFFFFF).alias("a"), F.shiftrightunsigned(half, 32).alias("b"), token)
    vectors = occurrences.groupBy("host", F.col("t.sequence").alias("token")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n"), F.sum(F.col("t.first").cast("int")).alias("pages")).where(F.col("pages") >= SUPPORT)
    hosts = sketches.groupBy("host").agg(F.count("*").alias("of")).where(F.col("of") >= SUPPORT)
    often = vectors.join(hosts, "host").where(F.col("pages") >= F.col("of") * SHARE)
    classes = often.groupBy("host", "a", "b", "n", "pages").agg(F.collect_list("token").alias("members")).where(F.size("members") >= LARGE)
    member = classes.select("host", F.xxhash64("a", "b", "n", "pages").alias("class"), F.explode("members").alias("token"))
    groups = written(member.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("template")), "classes")

    orders = sketches.join(groups, "host").select("host", "sequence", "template").mapInArrow(_orders, "host string, id long, is_class boolean, least int, greatest int")
    orders = orders.groupBy("host", "id", "is_class").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    orders = written(orders.where(F.col("least") == F.col("greatest")), "orders")
    steady = groups.select("host", F.explode("template").alias("e")).select("host", "e.*")
    steady = steady.join(orders.where("not is_class").select("host", F.col("id").alias("token"), F.col("least").alias("place")), ["host", "token"])
    steady = steady.join(orders.where("is_class").select("host", F.col("id").alias("class")), ["host", "class"])
    nested = steady.groupBy("host", "class").agg(F.collect_list(F.struct("token", "class", "place")).alias("es")).where(F.size("es") >= LARGE)
    nested = written(nested.groupBy("host").agg(F.flatten(F.collect_list("es")).alias("template")), "nested")

    slots = sketches.join(nested, "host").select("host", "sequence", "weight", "template").mapInArrow(_slots, "host string, slot long, chars long, linked long")
    menus = slots.groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked")).where(F.col("linked") * 2 > F.col("chars")).groupBy("host").agg(F.collect_list("slot").alias("menus"))
    out = written(nested.join(menus, "host", "left"), "templates")
    remove(pages.sparkSession, *(f for df in (sketches, groups, orders, nested) for f in {n.rsplit("/", 1)[0] for n in df.inputFiles()}))
    return out


def main_text(html: str, template: Template) -> str:
    """The text in a page's slots, one block after another."""
    walk = Walk(template)
    kept: dict[int, list[str]] = {MAIN: [], BOXED: [], OUTSIDE: []}
    block: dict[int, list[tuple[str, bool]]] = {MAIN: [], BOXED: [], OUTSIDE: []}
    article = False

    def end() -> None:
        for place, parts in block.items():
            if parts and (place != OUTSIDE or template.of or not all(link for data, link in parts if data.strip())):
                data = " ".join("".join(data for data, _ in parts).split())
                if data:
                    kept[place].append(data)
            parts.clear()

    for token, data, ends, place, link in tokens(html):
        article |= place in (MAIN, BOXED)
        if data is None:
            walk.meet(token)
            if ends:
                end()
            continue
        constant = bool(token and data.strip()) and walk.meet(token)
        if place != ASIDE:
            menu = place == OUTSIDE and walk.slot() in template.menus
            block[place].append((" " if constant or menu else data, link))
    end()
    return "\n\n".join(kept[MAIN] or (kept[BOXED] if article else kept[OUTSIDE]))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    host = F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", F.coalesce(host, F.lit("")).alias("_host"), "html")
    templates = deduce_templates(rows)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for batch in batches:
            text = [main_text(h.as_py() or "", t) for h, t in zip(batch.column("html"), _templates(batch, known, "_host"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    joined = rows.join(templates.withColumnRenamed("host", "_host"), "_host", "left").select("page_id", "url", "_host", "html", "template", "menus")
    out = joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
