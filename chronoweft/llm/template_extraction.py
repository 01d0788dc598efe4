"""Main text of web pages by template deduction with equivalence classes.

1. A page is a sequence of tokens: tags, told apart by the path of elements around them, and text nodes.
2. Tokens of a host that occur equally often on each page have equal occurrence vectors. Spark sums a
   mixed value of (page, count) over the pages of a host, by parts first, so a vector becomes one number
   and no host is ever gathered; frequent tokens of one number form an equivalence class.
3. A class is valid when its tokens come in one order on the pages (by cycles, where they repeat) and its
   cycles lie nested in those of other classes. Pages vote; a class that most of its pages break is dropped.
4. The template is the nest of the valid classes; what stands between its tokens are slots, and text that is no
   token of it is a page's own. Of the elements that the template has once a page, those that hold more than
   half of the own text outside links are a chain, one in the other; the innermost that still holds the chain's
   headings is the main slot. Names (``article``, class words) choose within the chain only.
5. The text of the main slot is extracted, without template text and the side parts that names tell. Pages of
   hosts too small to deduce a template, and pages that lack its main slot, are judged by their own names.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm.common import materialise

# Fixed values of HTML: elements without an end tag, elements whose content is no markup, and block elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
# Elements, and words in class, id and role values, that mark what is not main text.
SIDE_ELEMENTS = frozenset("head script style noscript template nav footer aside form button select textarea iframe object svg canvas dialog menu option input label title".split())
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination popup promo related replies reply share sharing sidebar skip social sponsor sponsored subscribe toolbar widget alert complementary contentinfo".split()
)
#: Parts that may stand beside side words in one class name: ``site-footer`` is a footer, ``related-work`` no list of links.
NEUTRAL = frozenset("area bar block bottom box button buttons container global group holder inner item items link links list main mobile outer page panel posts primary secondary section site top wrap wrapper".split())
OF_ARTICLE = frozenset("article entry post".split())
#: Inside the main text these mark a side part only where the template repeats its text.
DOUBTFUL_WORDS = frozenset("alert notice notices social".split())
#: Parts that hold articles of their own.
LISTS = frozenset("comment comments related replies reply".split())
#: How far a token lies in a side part.
DOUBTFUL, SIDE = 1, 2
#: These mark a page's head, but an article's own head within it.
HEADS = frozenset("header masthead".split())
MAIN_WORDS = frozenset("article articlebody content entry maincontent main post postbody story".split())

_NO_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_NAME_END, _SPECIAL = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+", re.I)
_RAW_END = {e: re.compile(rf"</{e}\s*>", re.I) for e in RAW}
#: A start tag that ends an open element of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that such a start tag doesn't look beyond.
HOLDERS = frozenset("ul ol dl table tbody thead select div article section main body td blockquote".split())


def _kind(name: str, attributes: tuple[tuple[str, str], ...], within_main: bool) -> tuple[str, frozenset[str]]:
    """``side``, ``soft`` (side, unless it holds the main text), ``doubtful``, ``main`` or nothing for an element by
    its own name and attributes, with its side words. Words never make the page or its main element a side part."""
    words: set[str] = set()
    marks: set[str] = set()
    for key, value in attributes:
        if key.lower() == "hidden" or key.lower() == "aria-hidden" and "true" in value.lower():
            return "side", frozenset()
        for part in value.strip("\"'").split():
            pieces = {w.lower() for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", part))}
            words |= {part.lower(), *pieces}
            found = {part.lower()} & SIDE_WORDS or pieces & SIDE_WORDS
            if found and (part.lower() in SIDE_WORDS or pieces <= SIDE_WORDS | NEUTRAL or pieces <= SIDE_WORDS | NEUTRAL | OF_ARTICLE and not found <= HEADS):
                marks |= found
    if within_main:
        words -= HEADS
        marks -= HEADS
    if name in ("html", "body"):
        return "", frozenset()
    if name in SIDE_ELEMENTS or name == "header" and not within_main:
        return "soft" if name == "form" else "side", frozenset(marks)
    if marks and name != "main" and (name != "article" or within_main):
        return "doubtful" if within_main and marks <= DOUBTFUL_WORDS else "soft", frozenset(marks)
    if name in ("article", "main") or words & MAIN_WORDS:
        return "main", frozenset()
    return "", frozenset()


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Places of elements that a worker remembers.
PLACES = 50_000


def _hash32(text: str) -> int:
    return xxhash.xxh32_intdigest(text)


class Place:
    """An element by its path, and what follows from the path alone. Tokens are 64-bit numbers: a tag's mixes its
    path; a text node's has 32 bits of its path above 32 bits of its text, which are 0 for the path as a whole."""

    __slots__ = ("below", "depth", "end", "heading", "kind", "link", "main", "mark", "name", "path", "start", "text", "void", "words")

    def __init__(self, above: Place | None, name: str, attributes: tuple[tuple[str, str], ...]):
        classes = " ".join(v.strip("\"' ") for k, v in attributes if k.lower() == "class")
        self.name, self.below = name, {}
        # the path as one number of the path above and the own name, so that deep elements need no long texts
        self.path = 0 if above is None else xxhash.xxh64_intdigest(f"{above.path:x}/{name}" + (f".{'.'.join(re.split(r'[\s/]+', classes))}" if classes else ""))
        self.mark = name in HOLDERS or any(name in c for c in CLOSES.values())
        self.depth = 0 if above is None else above.depth + 1
        self.kind, self.words = _kind(name, attributes, above.main) if above is not None else ("", frozenset())
        self.main = above is not None and (above.main or self.kind == "main")
        self.link = above is not None and (above.link or name == "a")
        self.heading = above is not None and (above.heading or name in HEADINGS)
        self.void = above is not None and (above.void or name in RAW or name in ("head", "noscript", "template"))
        self.start = self.path - (1 << 63)
        self.end = xxhash.xxh64_intdigest(f"{self.path:x}\t/") - (1 << 63)
        self.text = (_hash32(f"{self.path:x}") - (1 << 31)) << 32


class Page:
    """The tokens of a page, each with its place, text (empty for tags), element and block. Elements are numbered in
    page order, 0 being the page; the block number grows at block elements."""

    def __init__(self) -> None:
        self.tokens: list[int] = []
        self.places: list[Place] = []
        self.texts: list[str] = []
        self.of: list[int] = []
        self.blocks: list[int] = []
        self.parent, self.starts = [0], [0]  # by element: the one around it, and its own token's place in the list

    def add(self, token: int, place: Place, text: str, element: int, block: int) -> None:
        self.tokens.append(token)
        self.places.append(place)
        self.texts.append(text)
        self.of.append(element)
        self.blocks.append(block)

    def levels(self) -> list[int]:
        """By element, how far it lies in a side part. A wrapper of the main element, or of all articles, is no side
        part by its words."""
        own, places, parent = [0], [self.places[i] for i in self.starts[1:]], self.parent
        kinds = [p.kind for p in places]
        if any(kinds):
            held = {name: [0] * len(parent) for name in ("main", "article")}  # by element: those inside it
            for name, inside in held.items():
                for e in range(len(places), 0, -1):  # inner elements come later
                    inside[parent[e]] += inside[e] + (places[e - 1].name == name)
            mains, articles = held["main"], held["article"]
            for e, p in enumerate(places, 1):
                level = {"side": SIDE, "soft": SIDE, "doubtful": DOUBTFUL}.get(p.kind, 0)
                if p.kind == "soft" and (mains[e] or not mains[0] and articles[e] == articles[0] > 0 and not p.words & LISTS):
                    level = 0
                own.append(max(level, own[parent[e]]))
            return own
        return [0] * len(parent)


class TagEnds:
    """Ends of tags of a page on which one has been looked for in vain: found for all places at once, from the back, so that a page
    of tags without an end takes no longer than others."""

    def __init__(self, html: str):
        found = [(m.start(), m[0]) for m in _SPECIAL.finditer(html)]
        self.at, self.html = [i for i, _ in found], html
        self.end = [-1] * (len(found) + 1)  # the end of a tag whose next special character is this one
        after = {'"': len(found), "'": len(found)}  # the next quotation mark of each kind
        for k in range(len(found) - 1, -1, -1):
            i, c = found[k]
            if c == ">":
                self.end[k] = i
            else:
                if after[c] < len(found):
                    self.end[k] = self.end[after[c] + 1]
                after[c] = k
        self.name_end = 0

    def match(self, start: int) -> re.Match | None:
        i = start + (2 if self.html.startswith("</", start) else 1)
        if not (self.html[i : i + 1].isascii() and self.html[i : i + 1].isalpha()):
            return None
        if self.name_end < i:
            m = _NAME_END.search(self.html, i)
            self.name_end = m.start() if m else len(self.html)
        end = self.end[bisect_left(self.at, self.name_end)]
        return _TAG.match(self.html, start, end + 1) if end >= 0 else None


class Parser:
    """Pages to tokens. Places are kept from page to page (at most ``PLACES`` of them, then anew)."""

    def __init__(self) -> None:
        self.root, self.kept = Place(None, "", ()), 0

    def below(self, place: Place, name: str, attributes: str) -> Place:
        key = (name, tuple(_ATTRIBUTE.findall(attributes)) if len(attributes) > 4 else ())
        found = place.below.get(key)
        if found is None:
            found = place.below[key] = Place(place, name, key[1])
            self.kept += 1
        return found

    def parse(self, html: str) -> Page:
        if self.kept > PLACES:
            self.root, self.kept = Place(None, "", ()), 0
        page, place, element, block, at = Page(), self.root, 0, 0, 0
        stack: list[tuple[Place, int]] = []  # what is around the open elements
        marks: list[int] = []  # depths of the elements that a start tag may close or stops at
        opened: Counter = Counter()
        add, ends = page.add, None
        last = html.rfind(">")

        def text(raw: str) -> None:
            if raw.isspace():
                add(place.text, place, " ", element, block)
            else:
                t = entities.unescape(raw) if "&" in raw else raw
                add(place.text | max(1, _hash32(" ".join(t.split()))), place, t, element, block)

        def close() -> None:
            nonlocal place, element
            opened[place.name] -= 1
            if place.mark:
                marks.pop()
            place, element = stack.pop()

        look = 0
        while (here_at := html.find("<", look)) >= 0:
            if here_at > last and not html.startswith("<!--", here_at):  # no tag ends any more, comments may
                look = here_at + 1
                if html.find("<!--", look) < 0:
                    break
                continue
            c = html[here_at + 1 : here_at + 2]
            m = None
            if c in ("!", "?"):
                m = _NO_TAG.match(html, here_at)
            elif c == "/" or c.isalpha():
                m = _TAG.match(html, here_at) if ends is None else ends.match(here_at)
                if m is None and ends is None:
                    ends = TagEnds(html)
            if m is None:
                look = here_at + 1
                continue
            if here_at > at:
                text(html[at:here_at])
            at = look = m.end()
            if c in ("!", "?"):
                continue
            name = m[2].lower()
            if name in BLOCKS:
                block += 1
            if m[1]:
                if opened[name] > 0:
                    while place.name != name:
                        close()
                    add(place.end, place, "", element, block)
                    close()
                continue
            if name in CLOSES:
                for depth in reversed(marks):
                    open_ = stack[depth + 1][0] if depth + 1 < len(stack) else place
                    if open_.name in CLOSES[name]:
                        while len(stack) > depth:
                            close()
                        break
                    if open_.name in HOLDERS:
                        break
            here = self.below(place, name, m[3])
            if name in VOID or m[3].endswith("/") and name not in BLOCKS:
                add(here.start, place, "", element, block)
                continue
            if here.mark:
                marks.append(len(stack))
            stack.append((place, element))
            page.parent.append(element)
            page.starts.append(len(page.tokens))
            place, element = here, len(page.parent) - 1
            opened[name] += 1
            add(here.start, here, "", element, block)
            if name in RAW:
                end = _RAW_END[name].search(html, at)
                stop = end.start() if end else len(html)
                if stop > at:
                    text(html[at:stop])
                at = look = end.end() if end else len(html)
                close()
        if at < len(html):
            text(html[at:])
        return page


def occurrences(pages: DataFrame) -> DataFrame:
    """host, token, vector (the occurrence vector as one number), n_pages, total, at (sum of the first places on the pages):
    tokens counted by page and summed within each task's batch before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser()
        for b in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for host, key, html in zip(b["host"], b["page_key"], b["html"]):
                page = parser.parse(html)
                counts: dict[int, int] = {}
                first: dict[int, int] = {}
                for i, (token, text, place) in enumerate(zip(page.tokens, page.texts, page.places)):
                    if text:
                        if text.isspace():
                            continue
                        counts[place.text] = counts.get(place.text, 0) + 1
                        first.setdefault(place.text, i)
                    counts[token] = counts.get(token, 0) + 1
                    first.setdefault(token, i)
                mixed: dict[int, int] = {}
                for token, n in counts.items():
                    if n not in mixed:
                        mixed[n] = xxhash.xxh64_intdigest(f"{key} {n}")
                    s = sums.setdefault((host, token), [0, 0, 0, 0])
                    s[0] = (s[0] + mixed[n]) % (1 << 64)
                    s[1] += 1
                    s[2] += n
                    s[3] += first[token]
            yield pd.DataFrame([(h, t, v >> 32, v & 0xFFFFFFFF, p, n, at) for (h, t), (v, p, n, at) in sums.items()], columns=["host", "token", "high", "low", "n_pages", "total", "at"])

    parts = pages.mapInPandas(run, "host string, token long, high long, low long, n_pages long, total long, at long")
    sums = parts.groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("high", "low", "n_pages", "total", "at")))
    # sums of the two halves of one 64-bit sum: equal for tokens of equal vectors, as a pair
    return sums.select("host", "token", F.struct("high", "low").alias("vector"), "n_pages", "total", "at")


def classes(tokens: DataFrame, sizes: DataFrame, min_pages: int, share: float) -> DataFrame:
    """host, class, n_pages, once (the class occurs once a page), tokens (in the order of their mean first place): the
    frequent classes; and, as class null, the paths whose text nodes are tokens of them, but for a part of less than 1 - ``share``.

    ``min_pages`` and ``share``: pages that a host must have, and the part of them a class must occur on.
    A class is all tokens of one occurrence vector; a single token is evidence of a template only if it stands once a page.
    """
    frequent = tokens.join(sizes, "host").where((F.col("pages") >= min_pages) & (F.col("n_pages") >= share * F.col("pages")))
    is_path = F.col("token").bitwiseAND(0xFFFFFFFF) == 0
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"])
    found = frequent.where(~is_path).groupBy("host", "vector").agg(in_order.alias("tokens"), F.first("n_pages").alias("n_pages"), F.first("total").alias("total"))
    once = F.col("total") == F.col("n_pages")
    valid = found.where((F.size("tokens") > 1) | once).select("host", F.xxhash64("vector").alias("class"), "n_pages", once.alias("once"), "tokens", "total")
    # template text of each path against all text of it
    texts = valid.select("host", F.explode("tokens").alias("token"), "total").groupBy("host", F.shiftright("token", 32).alias("path")).agg(F.sum("total").alias("repeated"))
    paths = frequent.where(is_path).select("host", F.shiftright("token", 32).alias("path"), "total")
    fixed = paths.join(texts, ["host", "path"]).where(F.col("repeated") >= share * F.col("total")).groupBy("host").agg(F.collect_list(F.shiftleft("path", 32)).alias("tokens"))
    return valid.drop("total").unionByName(fixed.select("host", F.lit(None).cast("long").alias("class"), F.lit(None).cast("long").alias("n_pages"), F.lit(None).cast("boolean").alias("once"), "tokens"))


class Template:
    """What a page is held against: the classes, the paths of template text, and the main slot (null: none)."""

    def __init__(self, rows: list[dict] | None, slot: int | None = None):
        self.slot, self.fixed = slot, frozenset()
        self.step: dict[int, tuple[int, int]] = {}  # token: (class, place in it)
        self.size: dict[int, int] = {}
        for r in rows or []:
            if r["class"] is None:
                self.fixed = frozenset(r["tokens"])
            else:
                self.size[r["class"]] = len(r["tokens"])
                self.step.update((t, (r["class"], i)) for i, t in enumerate(r["tokens"]))

    def broken(self, page: Page) -> set[int]:
        """Classes whose tokens stand on the page out of order, or across the cycles of another class."""
        out: set[int] = set()
        due: dict[int, int] = {}
        open_: list[int] = []
        step, size = self.step, self.size
        for t in page.tokens:
            found = step.get(t)
            if found is None:
                continue
            c, i = found
            if i != due.get(c, 0):
                out.add(c)
                continue
            last = i + 1 == size[c]
            due[c] = 0 if last else i + 1
            if size[c] == 1:
                continue
            if i == 0:
                open_.append(c)
            elif c in open_:
                while open_[-1] != c:  # the class opened since is cut by this token
                    out.add(open_.pop())
                if last:
                    open_.pop()
        return out | {c for c, i in due.items() if i}


def templated(pages: DataFrame, rows: DataFrame, limit: int = 200_000) -> tuple[DataFrame, Callable[[dict], Template]]:
    """``pages`` and how a row of them finds its host's template. ``rows``: host, class, tokens, slot. Up to ``limit`` tokens
    go out as a broadcast; more meet the pages in a join on (host, part), so a host's pages are dealt to many tasks."""
    total = rows.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("n")).first()["n"]
    by_host = rows.groupBy("host").agg(F.collect_list(F.struct("class", "tokens")).alias("rows"), F.first("slot", True).alias("slot"))
    if total <= limit:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: ([{"class": x["class"], "tokens": list(x["tokens"])} for x in r["rows"]], r["slot"]) for r in by_host.collect()})
        return pages.withColumns({"rows": F.lit(None).cast(by_host.schema["rows"].dataType), "slot": F.lit(None).cast("long")}), lambda row: Template(*shared.value.get(row["host"], (None,)))
    parts = 64
    dealt = pages.withColumn("part", F.pmod(F.xxhash64("page_key"), F.lit(parts)).cast("int"))
    everywhere = by_host.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(everywhere, ["host", "part"], "left").drop("part"), lambda row: Template(row["rows"], row["slot"])


def _held(batches: Iterator[pd.DataFrame], find: Callable[[dict], Template]) -> Iterator[tuple[pd.DataFrame, list[tuple[Page, Template, str]]]]:
    """Batches, and for each row the parsed page, its template and host."""
    parser, known = Parser(), {}
    for b in batches:
        def rows(b: pd.DataFrame = b) -> Iterator[tuple[Page, Template, str]]:
            for host, html, found, slot in zip(b["host"], b["html"], b["rows"], b["slot"]):
                if host not in known:
                    if len(known) > 2000:
                        known.clear()
                    known[host] = find({"host": host, "rows": found, "slot": None if slot is None or slot != slot else int(slot)})
                yield parser.parse(html), known[host], host
        yield b, rows()


def votes(pages: DataFrame, found: DataFrame) -> DataFrame:
    """host, key, and sums over the pages of ``broken`` (by class, pages that break it), ``own`` and ``headings`` (by element of the
    template, characters of own text in it outside links, and those in headings), ``depth`` and ``named`` of the element."""
    joined, find = templated(pages, found.withColumn("slot", F.lit(None).cast("long")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _held(batches, find):
            sums: dict[tuple[str, int], list[int]] = {}
            for page, template, host in rows:
                if not template.step:
                    continue
                for c in template.broken(page):
                    sums.setdefault((host, c), [0, 0, 0, 0, 0])[0] += 1
                own, heads = [0] * len(page.parent), [0] * len(page.parent)
                for token, text, place, e in zip(page.tokens, page.texts, page.places, page.of):
                    if text and not (place.link or place.void or token in template.step or text.isspace()):
                        own[e] += len(text)
                        heads[e] += len(text) * place.heading
                for e in range(len(own) - 1, 0, -1):  # inner elements come later
                    up = page.parent[e]
                    own[up] += own[e]
                    heads[up] += heads[e]
                    i = page.starts[e]
                    if page.tokens[i] in template.step and page.places[i].name in HOLDERS:  # a heading or a paragraph is no slot
                        s = sums.setdefault((host, page.tokens[i]), [0, 0, 0, 0, 0])
                        s[1] += own[e]
                        s[2] += heads[e]
                        s[3] = page.places[i].depth
                        s[4] = int(page.places[i].kind == "main")
            yield pd.DataFrame([(h, k, *v) for (h, k), v in sums.items()], columns=["host", "key", "broken", "own", "headings", "depth", "named"])

    parts = joined.mapInPandas(run, "host string, key long, broken long, own long, headings long, depth long, named long")
    return parts.groupBy("host", "key").agg(*(F.sum(c).alias(c) for c in ("broken", "own", "headings")), F.max("depth").alias("depth"), F.max("named").alias("named"))


def templates(found: DataFrame, counted: DataFrame, share: float) -> DataFrame:
    """host, class, tokens, slot: the valid classes with the paths of template text, and the token of the host's main slot."""
    bad = counted.select("host", F.col("key").alias("class"), "broken")
    valid = found.join(bad, ["host", "class"], "left").where(F.col("class").isNull() | (F.coalesce("broken", F.lit(0)) <= (1 - share) * F.col("n_pages"))).drop("broken")
    elements = valid.where("once").select("host", F.explode("tokens").alias("key")).join(counted, ["host", "key"]).where("own > 0")
    most = elements.groupBy("host").agg(F.max("own").alias("most"))
    chain = elements.join(most, "host").where(F.col("own") * 2 > F.col("most"))
    heads = chain.groupBy("host").agg(F.max("headings").alias("all_headings"))
    slot = chain.join(heads, "host").where(F.col("headings") * 10 >= F.col("all_headings") * 9).groupBy("host").agg(F.max_by("key", F.struct("depth", "named", "key")).alias("slot"))
    return valid.join(slot, "host", "left").select("host", "class", "tokens", "slot")


def page_text(html: str, template: Template | None = None, parser: Parser | None = None) -> str:
    """The main text of one page, blocks joined by one space."""
    page = (parser or Parser()).parse(html)
    return _text(page, template or Template(None))


def _text(page: Page, template: Template) -> str:
    n, texts, tokens, step = len(page.tokens), page.texts, page.tokens, template.step
    level = page.levels()
    real = [bool(t) and not t.isspace() for t in texts]
    repeated = [tokens[i] in step for i in range(n)]

    def is_side(i: int) -> bool:
        # a doubtful part with words of the page's own is main text; without a template the word decides
        x = level[page.of[i]]
        return x == SIDE or x == DOUBTFUL and not (step and (not real[i] or not repeated[i]))

    # the main slot: the template's element, where it stands once on the page, else the elements named so
    at = [e for e, i in enumerate(page.starts) if e and tokens[i] == template.slot] if template.slot is not None else []
    inside = [False] * len(page.parent)
    if len(at) == 1:
        named = page.places[page.starts[at[0]]].main
        for e in range(1, len(inside)):
            inside[e] = e == at[0] or inside[page.parent[e]]
    else:
        named = True
        for e in range(1, len(inside)):
            inside[e] = page.places[page.starts[e]].main
    if any(real[i] and inside[page.of[i]] and not is_side(i) for i in range(n)):
        take = [bool(texts[i]) and inside[page.of[i]] and not is_side(i) for i in range(n)]
        # a sentence with the page's own words in it stays whole; where a name says that this is the main text, template
        # text goes only from places that hold nothing else
        whole = {page.blocks[i] for i in range(n) if take[i] and real[i] and not (repeated[i] and (not named or page.places[i].text in template.fixed))}
        own = [use and not (real[i] and page.blocks[i] not in whole) for i, use in enumerate(take)]
        # a page that holds nothing else (a copy of others of its host) keeps its text
        if any(use and real[i] for i, use in enumerate(own)):
            take = own
    else:  # no main slot: all text beside the side parts, without template text
        take = [bool(texts[i]) and not is_side(i) and not (repeated[i] and real[i]) for i in range(n)]
    blocks: list[list[str]] = []
    last = None
    for t, use, b in zip(texts, take, page.blocks):
        if use:
            if b != last:
                blocks.append([])
                last = b
            blocks[-1].append(t)
    return " ".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def extract_main_text(pages: DataFrame, min_pages: int = 5, share: float = 0.6) -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; pages of a null url form one host; an empty table gives no rows. Repeated
    rows are extracted each, pages of any length whole. Of classes that would tie, all count; of elements of equal depth
    the larger token is the slot. Counts cover every page of a host. Templates reach the pages as a broadcast of a
    checked size, beyond it by a join that splits each host; html is never shuffled in the first case.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"))
    keyed = rows.withColumn("page_key", F.xxhash64("page_id", "url"))
    sizes = rows.groupBy("host").agg(F.count("*").alias("pages"))
    # most tokens are a page's own text: they go first
    tokens = materialise(occurrences(keyed.select("host", "html", "page_key")).where(F.col("n_pages") >= share * min_pages), "tokens")
    found = materialise(classes(tokens, sizes, min_pages, share), "classes")
    counted = materialise(votes(keyed.select("host", "html", "page_key"), found), "votes")
    joined, find = templated(keyed, materialise(templates(found, counted, share), "templates"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, held in _held(batches, find):
            texts = [_text(page, template) for page, template, _ in held]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return joined.select("page_id", "url", "host", "html", "rows", "slot").mapInPandas(run, "page_id long, url string, text string, n_chars long")
