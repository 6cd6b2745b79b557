"""Main text of web pages by template deduction over the pages of a host.

Tokens of a page are its element paths and its text runs (with the path they stand in). Tokens
that occur equally often on the same pages of a host form an equivalence class; the occurrence
vector is kept as two sums of hashes, so a host may have any number of pages. A class is valid if at least SUPPORT
pages, not all equal, show it. The class that occurs once on every page is the outer template; a run is text of the template
if an element around it is in its class, so classes nest by their paths. Where the template has an article or main
element, these elements of a page are its main slots; else the innermost template element that holds all text that is in no class.
Text of the template is left out of the slots, and so is furniture (menus, notices, forms ...), by its element or its name.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resamplia.llm.shared import beside, pieces, stored

# What HTML calls these things, and common names for page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg object noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var br wbr img".split()
)
FURNITURE = frozenset("nav footer aside menu dialog button select head".split())
# Furniture as well, unless they hold the page's main part, as the elements named below.
FORMS = frozenset("form fieldset".split())
NEVER = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup "
    "modal newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments "
    "disqus respond replies related recommended share sharing social search login pagination pager".split()
)
# What readers write, by class or id, also on articles and sections; and first parts of compound class names, such as comments-area or ad-slot.
COMMENTS = frozenset("comment comments commentlist respond replies disqus".split())
FIRST_PARTS = COMMENTS | frozenset("ad ads advert adverts advertisement cookie cookies consent gdpr newsletter sponsor sponsored promo".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN = frozenset("article main".split())
CLOSES = {"li": ("li",), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
BARRIER = frozenset("article main section div table body td th ul ol blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HOST = re.compile(r"//(?:[^/@?#]*@)?([^/:?#]*)")
# Pages that must show a class of tokens; fewer may be copies of one text.
SUPPORT = 3


@dataclass
class Run:
    """A text run: its words, the path of its block element, whether it is furniture, and
    the number of its block."""

    text: str
    path: str
    furniture: bool
    block: int


@dataclass
class Page:
    """Element paths with their counts, and runs."""

    paths: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    runs: list[Run] = field(default_factory=list)


def host_of(url: str | None) -> str:
    found = _HOST.search(url or "")
    return found[1].lower() if found else ""


def _named(words: set[str], ids: set[str]) -> tuple[bool, bool]:
    """Do an element's class names (and, of comments, its ids) call it furniture, and does a whole name call it a reader's comment?"""
    parts = {w: [x for x in re.split("[-_]+", w) if x] for w in words | ids}
    remarks = not COMMENTS.isdisjoint(words | ids)
    named = any(w in NAMES or parts[w] and (all(x in NAMES for x in parts[w]) or len(parts[w]) > 1 and parts[w][0] in FIRST_PARTS) for w in words)
    return named or remarks, remarks


def parse(html: str) -> Page:
    """Element paths and text runs. Missing end tags are supplied as browsers do for
    paragraphs and list items; stray end tags are ignored. Names (whole class names, compounds of names only or with a first part that says
    enough; ids outside of articles, except of headings and sections), roles, headers and forms make furniture unless the
    element holds the main part. Readers' comments are told by names and ids everywhere."""
    page = Page()
    stack: list[tuple[str, str, bool, tuple[int, ...]]] = []  # name, path, furniture by its element, numbers of elements that may be furniture
    marks: list[tuple[int, ...]] = []
    mains: list[tuple[int, ...]] = []
    heads: list[tuple[int, ...]] = []
    forms: set[int] = set()
    count = 0
    buffer: list[str] = []
    block, at, size = 0, 0, len(html)

    def flush() -> None:
        nonlocal block
        words = " ".join(entities.unescape("".join(buffer)).split()) if buffer else ""
        if words:
            _, path, furniture, above = stack[-1] if stack else ("", "", False, ())
            page.runs.append(Run(words, path, furniture, block))
            marks.append(above)
            block += 1
        buffer.clear()

    def close(names: tuple[str, ...], barriers: frozenset[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                flush()
                del stack[k:]
                return
            if stack[k][0] in barriers:
                return

    while at < size:
        token = _TOKEN.match(html, at)
        at = token.end()
        name = token[2]
        if name is None:
            text = token[0]
            if text[0] != "<" or text == "<":
                buffer.append(text)
            continue
        name = name.lower()
        if token[1]:
            if name in INLINE or name in VOID:
                if name == "br":
                    buffer.append(" ")
                continue
            if any(x[0] == name for x in stack):
                close((name,), frozenset())
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at) if not token[3].endswith("/") else None
            at = end.end() if end else (at if token[3].endswith("/") else size)
            continue
        if name in INLINE:
            if name == "br":
                buffer.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in ENDS_PARAGRAPH:
            close(("p",), BARRIER - {"p"})
        if name in CLOSES:
            close(CLOSES[name], BARRIER)
        flush()
        given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(token[3])}
        label = (given.get("class") or given.get("id") or "").strip().lower()
        above = stack[-1] if stack else ("", "", False, ())
        inside = any(x[0] in MAIN for x in stack)
        words = set(given.get("class", "").lower().split())
        ids = set(given.get("id", "").lower().split()) if name not in HEADINGS else set()
        if not inside and name != "section":
            words |= ids
        named, remarks = _named(words, ids)
        hidden = "hidden" in token[3].lower() and re.search(r"\shidden(?:\s|=|/|$)", _QUOTED.sub("", token[3]), re.I) is not None
        fixed = above[2] or name in FURNITURE or hidden and name not in NEVER
        maybe = above[3]
        header = not inside and (name == "header" or "header" in words)
        if name not in NEVER and (name in FORMS or header or named or given.get("role", "").lower() in ROLES) or remarks and name == "article":
            maybe = (*maybe, count)
            if name in FORMS and not named:
                forms.add(count)
            count += 1
        if not fixed and name in MAIN and not inside:
            mains.append(maybe)
        if not fixed and name == "h1" and not any(x[0] == "header" for x in stack):
            heads.append(maybe)
        path = f"{above[1]}/{name}" + (f".{label}" if label else "")
        page.paths[path] += 1
        stack.append((name, path, fixed, maybe))
    flush()
    freed = _holders(page.runs, marks, mains, heads, forms) if count else set()
    for run, above in zip(page.runs, marks, strict=True):
        run.furniture = run.furniture or not freed.issuperset(above)
    return page


def _holders(runs: list[Run], marks: list[tuple[int, ...]], mains: list[tuple[int, ...]], heads: list[tuple[int, ...]], forms: set[int]) -> set[int]:
    """The elements that hold the main part: what is above all articles and mains or, without these, all first headings; forms with
    most of the text; and, if no text is left otherwise, what is above all of it."""
    parts = mains or heads
    freed = set.intersection(*map(set, parts)) if parts else set()
    if parts and not any(freed.issuperset(x) for x in parts):
        freed = set().union(*parts)
    if mains:
        return freed
    left = [(len(r.text), x) for r, x in zip(runs, marks, strict=True) if not r.furniture]
    for form in forms:
        if 2 * sum(n for n, x in left if form in x) > sum(n for n, _ in left):
            freed.add(form)
    if left and not any(freed.issuperset(x) for _, x in left):
        freed |= set.intersection(*(set(x) for _, x in left))
    return freed


def _key(path: str, text: str) -> int:
    return (xxhash.xxh64_intdigest(f"{path}\0{text}".encode()) - (1 << 63)) | 1


TOKENS = "host string, path string, run long, pages long, total long, va long, vb long, low long, high long, chars long, furniture boolean"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of this task for each host and token; run is 0 for elements. The vector is two sums of 32 bits for each page."""
    sums: dict[tuple[str, str, int], list] = {}

    def out() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in sums.items()]
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 8, pa.bool_()]
        names = ["host", "path", "run", "pages", "total", "va", "vb", "low", "high", "chars", "furniture"]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    for batch in pieces(batches, "html"):
        for url, text in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page, host = parse(text or ""), host_of(url)
            seed = xxhash.xxh64_intdigest(f"{url}\0{text}".encode()) & ((1 << 63) - 1)
            own = xxhash.xxh64_intdigest((text or "").encode()) - (1 << 63)
            found: dict[tuple[str, int], list] = {("", 0): [1, 0, False]}
            for path, n in page.paths.items():
                found[path, 0] = [n, 0, False]
            for run in page.runs:
                at = found.setdefault((run.path, _key(run.path, run.text)), [0, len(run.text), run.furniture])
                at[0] += 1
                at[2] = at[2] and run.furniture
            marks: dict[int, int] = {}
            for (path, run), (n, chars, furniture) in found.items():
                mark = marks.get(n)
                if mark is None:
                    mark = marks[n] = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), seed)
                at = sums.get((host, path, run))
                if at is None:
                    sums[host, path, run] = [1, n, mark >> 32, mark & 0xFFFFFFFF, own, own, chars, furniture]
                    continue
                at[0] += 1
                at[1] += n
                at[2] += mark >> 32
                at[3] += mark & 0xFFFFFFFF
                at[4] = min(at[4], own)
                at[5] = max(at[5], own)
                at[7] = at[7] and furniture
        if len(sums) > 200_000:
            yield out()
            sums.clear()
    yield out()


def templates(pages: DataFrame) -> DataFrame:
    """Per host: `main`, the path of its main slot (an article or main element, if the template has one), and `fixed`, the keys of
    text runs that belong to a class and are not furniture (in articles and mains only, where these are the slots)."""
    found = pages.select("url", "html").mapInArrow(_tokens, TOKENS)
    tokens = stored(
        found.groupBy("host", "path", "run").agg(
            F.sum("pages").alias("pages"), F.sum("total").alias("total"), F.sum("va").alias("va"), F.sum("vb").alias("vb"),
            F.min("low").alias("low"), F.max("high").alias("high"), F.max("chars").alias("chars"), F.min("furniture").alias("furniture"),
        )
    )
    vector = ["pages", "va", "vb"]
    whole = tokens.filter("path = '' and run = 0").select("host", *[F.col(c).alias(f"all_{c}") for c in vector])
    outer = F.lit(True)
    for c in vector:
        outer = outer & (F.col(c) == F.col(f"all_{c}"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    # Runs with an element around them that has their vector.
    valid = tokens.filter((F.col("pages") >= SUPPORT) & (F.col("low") != F.col("high")))
    elements = valid.filter("run = 0").select("host", F.col("path").alias("around"), *vector)
    runs = valid.filter("run != 0 and not furniture").select("host", "path", "run", *vector, F.explode(above).alias("around"))
    fixed = stored(runs.join(elements, ["host", "around", *vector]).select("host", "path", "run").distinct())
    # Text outside the template, for each element above it.
    free = tokens.filter("run != 0 and not furniture").join(fixed, ["host", "path", "run"], "left_anti")
    mass = (
        free.groupBy("host", "path").agg(F.sum(F.col("chars") * F.col("total")).alias("chars"))
        .select("host", F.explode(above).alias("path"), "chars")
        .groupBy("host", "path").agg(F.sum("chars").alias("mass"))
    )
    everything = mass.filter("path = ''").select("host", F.col("mass").alias("most"))
    framed = beside(tokens.filter("run = 0"), whole, "host", ["path"]).filter(outer).select("host", "path")
    slots = beside(framed.join(mass, ["host", "path"], "left"), everything, "host", ["path"], "left")
    name = F.regexp_extract(F.substring_index("path", "/", -1), r"^[^.]*", 0)
    depth = F.size(F.split("path", "/"))
    named = name.isin(*MAIN)
    rank = F.struct(named.alias("named"), F.when(named, -depth).otherwise(depth).alias("depth"), F.col("path").alias("path"))
    chosen = slots.filter(named | (F.col("mass") == F.col("most"))).groupBy("host").agg(F.max(rank).alias("m")).select("host", F.col("m.path").alias("main"), "m.named")
    inside = F.col("path").rlike(rf"/({'|'.join(sorted(MAIN))})([./]|$)")
    needed = beside(fixed, chosen.select("host", "named"), "host", ["path", "run"]).filter(inside | ~F.col("named"))
    return chosen.select("host", "main").join(needed.groupBy("host").agg(F.collect_set("run").alias("fixed")), "host", "left")


def slot_text(page: Page, main: str | None, fixed: frozenset[int]) -> str:
    """Blocks of the main slots without furniture and text of the template. Where the host's slot is no article or main
    element, or the page lacks it, the page's own article and main elements are its slots, else the host's slot or the whole page.
    A page that has text of the template only keeps it."""
    def within(run: Run, slot: str) -> bool:
        return run.path == slot or run.path.startswith(slot + "/")

    slots = [p for p in page.paths if p.rsplit("/", 1)[-1].split(".")[0] in MAIN]
    if not slots:
        slots = [main] if main is not None and main in page.paths else [""]
    blocks = [r for r in page.runs if not r.furniture and any(within(r, s) for s in slots)]
    return "\n\n".join(r.text for r in [r for r in blocks if _key(r.path, r.text) not in fixed] or blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        columns = [batch.column(c).to_pylist() for c in ("html", "main", "fixed")]
        out = [slot_text(parse(html or ""), main, frozenset(fixed or ())) for html, main, fixed in zip(*columns, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of `pages` (page_id, url, html).

    Null html gives an empty text; pages with a null url or one without a host are one host. The
    pages of a host that share all tokens, and hosts of one page, have no text that varies; there
    all text counts. Repeated rows are kept; other columns are ignored.
    """
    rows = pages.select("page_id", "url", "html").withColumn(
        "host", F.lower(F.coalesce(F.regexp_extract("url", r"//(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    )
    return beside(rows, templates(pages), "host", ["page_id", "html"], "left").select("page_id", "url", "html", "main", "fixed").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )
