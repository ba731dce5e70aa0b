"""Main-text extraction by equivalence-class template deduction.

Pages of one host come from few templates. Each page is cut into tokens: opening
and closing tags and text runs, told apart by their path of open elements. Tokens
of a host with the same occurrence vector (how often on which page) form an
equivalence class; a body that several pages share counts once. The vectors are
compared by signatures that Spark aggregates with partial sums, so a host with a
third of all pages is never gathered anywhere. A class with enough tags on enough
pages is a candidate. On nearly all its pages its tokens must repeat in one order,
and its occurrences must lie between the same two neighbouring tokens of the class
around them: those that do are nested into the host's template.

The template's tags cut a page into slots. On each page the slot with the most
plain words votes for the element that holds it together with its heading; the
hosts' votes name the main element. Its text is the main text, without the text
that itself belongs to the template. Names only decide what the template leaves
open: what lies inside the main element but in a menu, footer, sidebar, notice,
advert, form or comment, and hosts of a single page or without a template.

Text is template only where its vector is that of a class of tags, on at least
``TEXT_PAGES`` pages, and no other text stands in the same block. On a host most of whose text is on most pages, and in
headings, none is: such pages are copies of each other.

Defined cases: null or empty html has the empty text; a url without a host shares
the empty host; repeated rows have the same result each; a page with none of its
host's main elements goes by names; unclosed and stray tags are tolerated; text with
``hidden`` or ``aria-hidden`` counts like any other; very long pages are handled one by one; an empty table has an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutworks.llm._batches import append_columns, bound_batches, chunks
from boutworks.runtime import staged

#: A class is a candidate with so many tags, on so many pages and so large a share of the host's pages.
CLASS_TAGS, CLASS_PAGES, CLASS_SHARE = 3, 2, 0.05
#: Share of a class's pages that must agree on its order and its place.
AGREE = 0.9
#: Pages that a text needs to be template.
TEXT_PAGES = 5

# Names from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select button object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {f"h{k}": k for k in range(1, 7)}
CONTAINERS = frozenset("article main section div td center body".split())
BOILERPLATE = frozenset("nav menu header footer aside form dialog head".split())
# Words of class, id and role that name boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads adsense advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo consent cookie cookies disqus footer menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
# Those that name boilerplate in an id of a section too, where the others may be its subject.
COMMENT_WORDS = frozenset("comment comments disqus reply replies".split())
_MAIN = {"article": 2, "main": 1}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>", re.S)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d{3,}")


class Run:
    """A text run: its block, its text (plain: with single spaces) and where it stands."""

    __slots__ = ("block", "text", "plain", "at", "_token")

    def __init__(self, block: int, text: str, at: Open):
        self.block, self.text, self.at = block, text, at
        self.plain = " ".join(text.split())
        self._token: int | None = None

    @property
    def token(self) -> int:
        """Of its place and what it says; 0 for white space."""
        if self._token is None:
            self._token = _token(f"{self.at.path}\0{self.plain}") if self.plain else 0
        return self._token


@dataclass(slots=True)
class Open:
    """An open element: ``bad`` is the place in ``chain`` of the innermost one named as boilerplate, or -1."""

    name: str
    path: str
    token: int
    chain: tuple[int, ...]
    bad: int
    main: int
    link: bool
    heading: int


def _token(said: str) -> int:
    return xxhash.xxh64_intdigest(said) - (1 << 63)


def _named_bad(name: str, named: list[tuple], in_article: bool) -> bool:
    if name in BOILERPLATE:
        return not (name == "header" and in_article)  # an article's own header holds its title
    if name in HEADINGS or name in ("html", "body") or name in _MAIN:
        return any(k.lower() == "class" and COMMENT_WORDS.intersection(_WORDS.findall((a or b or c).lower())) for k, a, b, c in named) if name == "article" else False
    for kind, a, b, c in named:
        words = _WORDS.findall((a or b or c).lower())
        if (COMMENT_WORDS if kind.lower() == "id" and name == "section" else BOILERPLATE_WORDS).intersection(words):
            return True
    return False


#: What an opening tag at a path means; emptied when it is full.
_known_tags: dict[tuple[str, str, str, bool], tuple] = {}


def _opening(path: str, name: str, attributes: str, in_article: bool) -> tuple[int, str, bool, int, bool]:
    """Token, path inside, whether boilerplate by name, rank as main element, and whether it holds anything."""
    key = (path, name, attributes, in_article)
    found = _known_tags.get(key)
    if found is None:
        named = _NAMED.findall(attributes) if attributes else []
        said = _DIGITS.sub("0", " ".join(a or b or c for _, a, b, c in named).lower()) if named else ""
        inside = f"{path}/{name}.{said}" if name in BLOCK else path
        holds = name not in VOID and not attributes.rstrip().endswith("/")
        found = _token(f"{path}<{name} {said}"), inside, _named_bad(name, named, in_article), _MAIN.get(name, 1 if "main" in said.split() else 0), holds
        if len(_known_tags) > 20_000:
            _known_tags.clear()
        _known_tags[key] = found
    return found


def walk(page: str) -> tuple[list[tuple[int, int]], list[Run], dict[int, str]]:
    """The tags of a page in order, as (token, runs before it), its text runs, and the names of its containers."""
    tags: list[tuple[int, int]] = []
    runs: list[Run] = []
    names: dict[int, str] = {}
    top = Open("", "", 0, (), -1, 0, False, 0)
    stack = [top]
    block, at, size, paragraphs = 0, 0, len(page), 0
    search = _TAG.search

    def close(name: str) -> int:
        """Close the innermost such element and all in it; how many paragraphs that were."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name == name:
                gone = sum([s.name == "p" for s in stack[i:]]) if paragraphs else 0
                del stack[i:]
                return gone
        return 0

    while at < size:
        found = search(page, at)
        start = found.start() if found else size
        if start > at:
            raw = page[at:start]
            runs.append(Run(block, html_lib.unescape(raw) if "&" in raw else raw, top))
        if not found:
            break
        at = found.end()
        ending, name, attributes = found.groups()
        if not name:
            continue
        name = name.lower()
        blocky = name in BLOCK
        block += blocky
        if ending:
            paragraphs -= close(name)
            top = stack[-1]
            tags.append((_opening(top.path, "/" + name, "", False)[0], len(runs)))
            continue
        if blocky:
            if paragraphs:
                paragraphs -= close("p")
            if name == "li" and stack[-1].name == "li":
                close("li")
            top = stack[-1]
        token, path, bad, main, holds = _opening(top.path, name, attributes, top.main == 2)
        tags.append((token, len(runs)))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name == "br":
            runs.append(Run(block, " ", top))
        if not holds:
            continue
        if name in CONTAINERS:
            names[token] = name
        paragraphs += name == "p"
        top = Open(name, path, token, (*top.chain, token), len(top.chain) if bad else top.bad, max(top.main, main), top.link or name == "a", top.heading or HEADINGS.get(name, 0))
        stack.append(top)
    return tags, runs, names


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"


def distinct_bodies(pages: DataFrame) -> DataFrame:
    """(host, body, html): each body of a host once. Only bodies that occur twice are shuffled."""
    rows = pages.select("host", F.xxhash64("html").alias("body"), "html")
    again = staged(rows.groupBy("host", "body").count().where("count > 1").select("host", "body"), "repeated-bodies")
    once = rows.join(again, ["host", "body"], "left_anti")
    copied = rows.join(again, ["host", "body"], "left_semi").groupBy("host", "body").agg(F.first("html").alias("html"))
    return once.select("host", "body", "html").unionByName(copied)


_OCCURRENCE = "host string, token bigint, is_text boolean, pages bigint, times bigint, vector bigint"


def occurrences(bodies: DataFrame) -> DataFrame:
    """(host, token, is_text, pages, times, vector): how a token occurs on the host's pages.

    ``vector`` is a signature of the occurrence vector; token 0 occurs once on every page.
    """
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
    names = [f.strip().split()[0] for f in _OCCURRENCE.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "html"):
                found: dict[tuple[str, int, bool], list[int]] = {}
                for host, body, page in zip(*(part.column(c).to_pylist() for c in ("host", "body", "html")), strict=True):
                    tags, runs, _ = walk(page)
                    times = Counter((t, False) for t, _ in tags)
                    times.update((r.token, True) for r in runs if r.plain)
                    times[0, False] = 1
                    for (token, is_text), n in times.items():
                        seen = found.setdefault((host, token, is_text), [0, 0, 0])
                        seen[0] += 1
                        seen[1] += n
                        seen[2] ^= _token(f"{body} {n}")
                if found:
                    made = list(zip(*((*key, *v) for key, v in found.items()), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(m, k) for m, k in zip(made, kinds, strict=True)], names=names)

    bound_batches(bodies.sparkSession)
    rows = bodies.mapInArrow(run, _OCCURRENCE)
    return rows.groupBy("host", "token", "is_text").agg(F.sum("pages").alias("pages"), F.sum("times").alias("times"), F.bit_xor("vector").alias("vector"))


def classes(found: DataFrame) -> DataFrame:
    """(host, cls, pages, tags, texts, plain): the candidate classes of ``occurrences``; texts that aren't ``plain`` may be those of copies.

    A host's average page has at most 1 / CLASS_SHARE times its tokens on that share of the pages, so a host's classes are bounded by its pages' size.
    """
    all_pages = staged(found.where("token = 0 and not is_text").select("host", F.col("pages").alias("all")), "pages-of-hosts")
    # most text is on one page and needn't meet its host's row
    seen = found.where("token <> 0 and pages > 1").join(all_pages, "host")
    said = found.where("is_text").groupBy("host").agg(F.sum("times").alias("times"))
    often = seen.where(F.col("is_text") & (F.col("pages") * 2 >= F.col("all"))).groupBy("host").agg(F.sum("times").alias("often"))
    texts = said.join(often, "host").select("host", (F.col("often") * 2 > F.col("times")).alias("copies"))
    common = seen.where(F.col("pages") >= F.greatest(F.lit(CLASS_PAGES), F.col("all") * CLASS_SHARE))
    grouped = common.groupBy("host", "pages", "times", "vector").agg(
        F.sort_array(F.collect_set(F.when(~F.col("is_text"), F.col("token")))).alias("tags"), F.sort_array(F.collect_set(F.when(F.col("is_text"), F.col("token")))).alias("texts")
    )
    valid = grouped.where(F.size("tags") >= CLASS_TAGS).join(texts, "host", "left")
    plain = (F.col("pages") >= TEXT_PAGES) & ~F.coalesce("copies", F.lit(False))
    return valid.select("host", F.xxhash64("pages", "times", "vector").alias("cls"), "pages", "tags", "texts", plain.alias("plain"))


def arrangement(tags: list[int], of: dict[int, int]) -> dict[int, tuple[tuple[int, ...], int, int]]:
    """For each class on a page: its tokens in order, and the class and token number around it (0, -1 outermost).

    A class whose tokens don't repeat in one order, or cross another class, has no tokens here.
    """
    seen: dict[int, list[int]] = {}
    for t in tags:
        if t in of:
            seen.setdefault(of[t], []).append(t)
    order: dict[int, tuple[int, ...]] = {}
    for cls, tokens in seen.items():
        cycle = list(dict.fromkeys(tokens))
        order[cls] = tuple(cycle) if cycle * (len(tokens) // len(cycle)) == tokens else ()
    place = {(cls, t): i for cls, cycle in order.items() for i, t in enumerate(cycle)}
    around: dict[int, tuple[int, int] | None] = {}
    open_: list[list[int]] = []  # class, number of its last token
    for t in tags:
        cls = of.get(t)
        if cls is None or not order[cls]:
            continue
        at = place[cls, t]
        if at == 0:
            parent = (open_[-1][0], open_[-1][1]) if open_ else (0, -1)
            if around.setdefault(cls, parent) != parent:
                around[cls] = None
            open_.append([cls, 0])
        while open_ and open_[-1][0] != cls:  # a class that didn't end before another one goes on crosses it
            around[open_.pop()[0]] = None
        if open_:
            open_[-1][1] = at
            if at == len(order[cls]) - 1:
                open_.pop()
        else:
            around[cls] = None
    return {cls: (cycle, *around[cls]) if cycle and around.get(cls) else ((), 0, -1) for cls, cycle in order.items()}


def vote(tags: list[tuple[int, int]], runs: list[Run], names: dict[int, str], of: dict[int, int], texts: frozenset[int] = frozenset()) -> tuple[int, int]:
    """The container around the slot with the most plain words and its highest heading, and these words; 0 without one.

    ``texts`` of a class count only where the page has no other words.
    """
    plain = [r.plain and r.at.bad < 0 and not r.at.link for r in runs]
    if texts and any(r.token not in texts for r, p in zip(runs, plain, strict=True) if p):
        plain = [p and r.token not in texts for r, p in zip(runs, plain, strict=True)]
    words: Counter[int] = Counter()
    holder: dict[int, tuple[int, Run]] = {}
    cuts = iter([n for t, n in tags if t in of])
    slot, upcoming = -1, next(cuts, None)
    for i, r in enumerate(runs):
        while upcoming is not None and upcoming <= i:
            slot, upcoming = slot + 1, next(cuts, None)
        if plain[i]:
            n = r.plain.count(" ") + 1
            words[slot] += n
            if slot not in holder or n > holder[slot][0]:
                holder[slot] = n, r
    if not words:
        return 0, 0
    slot, most = max(words.items(), key=lambda s: (s[1], -s[0]))
    inside = [t for t in reversed(holder[slot][1].at.chain) if t in of and t in names]
    parts = [t for t in inside if names[t] != "body"]  # the body holds every heading
    headings = [r for r in runs if r.at.heading and r.plain and r.at.bad < 0]
    for level in sorted({r.at.heading for r in headings}):
        titled = {t for r in headings if r.at.heading == level for t in r.at.chain}
        if found := next((t for t in parts if t in titled), None):
            return found, most
    article = next((t for t in parts if names[t] in _MAIN), None)
    return article or (inside[0] if inside else 0), most


_ARRANGED = "host string, cls bigint, cycle array<bigint>, parent bigint, slot int, n bigint"


def arranged(bodies: DataFrame, found: DataFrame) -> DataFrame:
    """(host, cls, cycle, parent, slot, n): on how many pages a class has this order and place.

    Rows without ``cycle`` count the votes: ``cls`` is the main element, n its words.
    """
    listed = found.groupBy("host").agg(F.collect_list(F.struct("cls", "tags", "texts")).alias("classes"))
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64()]
    names = [f.strip().split()[0] for f in _ARRANGED.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of, texts = None, {}, frozenset()
        for batch in batches:
            for part in chunks(batch, "html"):
                counts: Counter[tuple] = Counter()
                for host, page, listed_ in zip(*(part.column(c).to_pylist() for c in ("host", "html", "classes")), strict=True):
                    if host != last:
                        last, of = host, {t: c["cls"] for c in listed_ for t in c["tags"]}
                        texts = frozenset(t for c in listed_ for t in c["texts"])
                    tags, runs, names_ = walk(page)
                    for cls, (cycle, parent, slot) in arrangement([t for t, _ in tags], of).items():
                        counts[host, cls, cycle, parent, slot] += 1
                    element, words = vote(tags, runs, names_, of, texts)
                    if element:
                        counts[host, element, None, 0, 0] += words
                if counts:
                    made = list(zip(*((*key, n) for key, n in counts.items()), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(m, k) for m, k in zip(made, kinds, strict=True)], names=names)

    # stored first: a small table is then broadcast without shuffling pages, a large one joined with frequent hosts split
    rows = bodies.join(staged(listed, "classes-of-hosts"), "host").select("host", "html", "classes").mapInArrow(run, _ARRANGED)
    return rows.groupBy("host", "cls", "cycle", "parent", "slot").agg(F.sum("n").alias("n"))


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): ``tags`` and ``texts`` of the valid classes, ``main`` elements by votes, the most first, and ``n_classes``."""
    bodies = distinct_bodies(pages)
    found = staged(classes(staged(occurrences(bodies), "occurrences")), "classes")
    placed = staged(arranged(bodies, found), "arranged")
    best = placed.where("cycle is not null").groupBy("host", "cls").agg(F.max(F.struct("n", "cycle", "parent", "slot")).alias("b"))
    valid = found.join(best, ["host", "cls"]).where((F.size("b.cycle") > 0) & (F.col("b.n") >= F.col("pages") * AGREE))
    # a class nested in one that isn't valid stays: the tokens around it are those of the next class outwards
    nested = valid.groupBy("host").agg(F.flatten(F.collect_list("tags")).alias("tags"), F.flatten(F.collect_list(F.when(F.col("plain"), F.col("texts")))).alias("texts"), F.count("*").alias("n_classes"))
    votes = placed.where("cycle is null").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("n", "cls")), asc=False).alias("votes"))
    whole = nested.join(votes, "host", "left").withColumn("main", F.coalesce(F.array_intersect(F.col("votes.cls"), F.col("tags")), F.array().cast("array<bigint>")))
    return whole.select("host", F.struct("tags", "texts", "main", "n_classes").alias("template"))


@dataclass
class Template:
    """A host's template; an empty one leaves the page a single slot."""

    tags: frozenset[int] = frozenset()
    texts: frozenset[int] = frozenset()
    main: list[int] = field(default_factory=list)


def _by_names(runs: list[Run], beyond: int | None = None) -> list[Run]:
    """Runs outside boilerplate; of an article or main element where there is one. Names count from inside the element ``beyond``."""
    kept = [r for r in runs if r.at.bad < (r.at.chain.index(beyond) + 1 if beyond else 0)]
    rank = max((r.at.main for r in kept if r.plain), default=0)
    return [r for r in kept if r.at.main == rank]


def main_text(page: str, template: Template | None) -> str:
    """The text of the slots that hold the article; names alone decide where there is no template."""
    tags, runs, _ = walk(page)
    drop: frozenset[int] = frozenset()
    if template is not None and not template.tags:
        kept = runs
    else:
        here = {t for t, _ in tags}
        main = next((m for m in template.main if m in here), None) if template else None
        if main is None:
            kept = _by_names(runs)
        else:
            kept = _by_names([r for r in runs if main in r.at.chain], main)
            drop = template.texts
    blocks = (list(block) for _, block in groupby(kept, key=lambda r: r.block))
    own = (b for b in blocks if not drop or any(r.plain and (r.at.heading or r.token not in drop) for r in b))
    said = (" ".join("".join(r.text for r in b).split()) for b in own)
    return "\n".join(s for s in said if s)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_classes (of the host's template) of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    joined = rows.join(staged(templates(rows), "templates"), "host", "left").select("page_id", "url", "html", "template")
    fields = [T.StructField("text", T.StringType()), T.StructField("n_classes", T.LongType())]

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        texts, counts = [], []
        last, template = None, None
        for page, given in zip(part.column("html").to_pylist(), part.column("template").to_pylist(), strict=True):
            if given != last:
                last, template = given, Template(frozenset(given["tags"]), frozenset(given["texts"]), given["main"]) if given else None
            texts.append(main_text(page, template))
            counts.append(given["n_classes"] if given else 0)
        return [pa.array(texts, pa.string()), pa.array(counts, pa.int64())]

    made = append_columns(joined, "html", fields, compute)
    return made.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_classes")
