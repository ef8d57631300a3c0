"""Main text of web pages by consensus host paths.

Each page's containers are scored by the running text in their blocks; from the best one up, ancestors are taken while they
add unmarked blocks with few links, and the last one votes, under its generalised path of tags and classes, for its host. Spark counts the votes; a host's winning paths are its first one and those with a
twentieth of its votes (so at most 21), and each page is read again through them. A page on which no winning path holds
most of what its own best container holds is read through that container, so odd pages keep their text.

What names itself menu, header, advert, comment and the like (as a class, an id or part of one) doesn't count, but for a
wrapper that holds most of the page's running text; an article's h1 stays wherever it is. A part of a compound name
("search-algorithms", "related-work") is only a hint inside an article, a main element or a section: it must have few links and
prose of its own to stay, a block of it, or LONG_PROSE characters where the part is a PUSHY word. Readers' words are no hints: they decide.

Blocks are joined by two line feeds, white space in a block is one space, character references are decoded.
Null and empty pages give an empty text. Ids may be null or repeat, a null url is host "": one row out for each row in.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from memlake.llm.common import dropped, joined_small, over_texts, written

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*+)>|<[!?/][^>]*>""", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

# HTML's own kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes".split())
CONTAINERS = set("div article section main td th center blockquote figure details".split())
BLOCKS = CONTAINERS | set("address aside body dd dl dt fieldset figcaption footer form h1 h2 h3 h4 h5 h6 header hr li nav ol p pre table tbody thead tfoot tr caption ul html head summary".split())
SPACES = {"br", "td", "th", "wbr", "img"}
#: Elements that are never main text, and those that aren't unless they hold the page (see Page.kept).
ASIDE = set("nav footer aside script style noscript template iframe svg button select textarea dialog menu title object canvas input label".split())
DOUBTED = {"header", "form", "fieldset"}
#: An open element that a start tag ends, and how far up to look for it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Containers that are part of what stands around them.
PARTS = {"blockquote", "figure", "td", "th", "details"}
#: A block of so many characters is prose; links may be the FEW_LINKS-th part of what an ancestor adds.
PROSE, FEW_LINKS = 80, 4
#: A part of so many that a wrapper without heading may leave outside.
LITTLE = 20
SCOPE = {"table", "td", "th", "button", "object", "caption"}

#: Words in class, id or role that mark what isn't main text.
MARKS = set(
    "nav navbar navigation menu menubar sidebar aside footer header masthead ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments commentlist respond reply replies disqus related recommended recommendations "
    "breadcrumb breadcrumbs pagination pager widget toolbar skip contentinfo complementary search form".split()
)
#: Of these, words for what readers wrote, and for what stands above an article.
READERS = set("comment comments commentlist respond reply replies disqus".split())
ABOVE = {"header", "masthead"}
#: Words that sites use to sell or steer: as part of a compound name they need this much prose to be an article's own topic.
PUSHY = set(
    "nav navbar menubar sidebar aside footer masthead ad ads adv advert adverts advertisement sponsor sponsored promo cookie cookies consent gdpr popup modal newsletter subscribe subscription "
    "signup login social related recommended recommendations breadcrumb breadcrumbs pagination pager widget toolbar skip contentinfo complementary".split()
)
LONG_PROSE = 300


def _attributes(given: str) -> tuple[str, set[str], set[str]]:
    """Generalised classes; the marks that are class, id or role by themselves; the marks that are part of one."""
    classes, whole, part = "", set(), set()
    for name, *value in NAMES.findall(given):
        words = max(value, key=len).lower().replace(">", "").split()  # ">" stands between the steps of a path
        for w in words:
            whole |= MARKS & {w}
            part |= MARKS.intersection(re.split(r"[^a-z]+", w))
        if name.lower() == "class":
            classes = "".join(f".{g}" for g in sorted({re.sub(r"[0-9]+", "#", w) for w in words}))
    return classes, whole, part


class Page:
    """A page's blocks, the paths of the containers around them, and what is in doubt.

    Paths are numbered, a path after the one around it: `around`, `step` (tag and classes) and `tags` are lists by number; 0
    is the body. Regions are elements whose tag or names say that they aren't main text; 0 is none. `blocks` are
    (path, text, characters in links, region), `kept` those that count.
    """

    def __init__(self, page: str):
        self.around, self.step, self.tags = [-1], ["body"], ["body"]
        self.numbers: dict[tuple[int, str], int] = {}
        self.outer, self.kind, self.holds = [-1], [""], [0]  # by region; holds: 1 an article or main, 2 an h1 or main
        self.hint = [0]  # by region: the prose that makes it an article's own after all; 0 if nothing does
        self.blocks: list[tuple[int, str, int, int]] = []
        self._read(page)
        self.kept = self._kept()
        n = len(self.around)
        self.size, self.linked, self.many, self.prose, self.own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        for path, text, links in self.kept:
            self.own[path] += 1
            self.many[path] += 1
            self.size[path] += len(text)
            self.linked[path] += links
            self.prose[path] += len(text) >= PROSE
        for path in range(n - 1, 0, -1):  # what a path holds is in the one around it too
            for held in (self.size, self.linked, self.many, self.prose):
                held[self.around[path]] += held[path]

    def _inner(self, path: int, tag: str, classes: str) -> int:
        key = (path, tag + classes)
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.around)
            self.around.append(path)
            self.step.append(key[1])
            self.tags.append(tag)
        return found

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int, int, bool]] = []  # tag, path, region, dropped
        opened: Counter = Counter()
        path = region = links = at = 0
        off, last, parts, linked = False, max(page.rfind(">"), page.rfind("<!--")), [], []

        def flush() -> None:
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((path, text, min(len(text), len(" ".join(entities.unescape("".join(linked)).split()))), region))
            parts.clear()
            linked.clear()

        def back_to(depth: int) -> None:
            nonlocal path, region, off, links
            if any(tag in BLOCKS for tag, *_ in stack[depth:]):
                flush()
            for tag, *_ in stack[depth:]:
                opened[tag] -= 1
                links -= tag == "a"
            del stack[depth:]
            path, region, off = stack[-1][1:] if stack else (0, 0, False)

        def end(tags: set[str], limit: set[str]) -> None:
            if any(opened[t] for t in tags):
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] in tags:
                        back_to(depth)
                        break
                    if stack[depth][0] in limit:
                        break

        while at <= last and (m := TOKEN.search(page, at)):
            if m.start() > at and not off:
                parts.append(page[at : m.start()])
                if links:
                    linked.append(page[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag in ("html", "body", "head"):
                continue
            if m[1]:
                # an inline end tag doesn't end a block
                end({tag}, BLOCKS - {"p"} if tag in ("b", "i", "a", "span", "em", "strong", "font", "u") else set())
                continue
            if tag in BLOCKS and tag not in ENDS:
                end({"p"}, SCOPE)
            if tag in ENDS:
                end(*ENDS[tag])
            if tag in BLOCKS and tag not in SPACES:
                flush()
            elif tag in SPACES and not off:
                parts.append(" ")
            if tag in RAW:
                closed = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = closed.end() if closed else len(page)
                continue
            if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
                continue
            classes, whole, part = _attributes(m[3]) if m[3] else ("", set(), set())
            marks = set() if tag in ("b", "i", "em", "strong", "h1") else whole if tag == "p" else part
            inner = self._inner(path, tag, classes) if tag in CONTAINERS else path
            within = region
            if tag in DOUBTED or marks:
                # in an article a header is the article's own: its h1 stays
                kind = "readers" if marks & READERS else "above" if tag == "header" or marks & ABOVE else "other"
                within = len(self.outer)
                self.outer.append(region)
                inside = opened["article"] or opened["main"]
                self.kind.append("own" if kind == "above" and inside else kind)
                self.holds.append(0)
                only = tag not in DOUBTED and not marks & (whole | READERS) and (inside or tag == "section")
                self.hint.append((LONG_PROSE if marks & PUSHY else PROSE) if only else 0)
            if tag == "h1" and self.kind[region] == "own":
                within = self.outer[region]
            if tag in ("article", "main", "h1"):
                self.holds[within] |= {"article": 1, "main": 3, "h1": 2}[tag]
            links += tag == "a"
            opened[tag] += 1
            stack.append((tag, inner, within, off or tag in ASIDE))
            path, region, off = stack[-1][1:]
        if not off:
            parts.append(page[at:])
        flush()

    def _kept(self) -> list[tuple[int, str, int]]:
        """The blocks outside of regions, and those of regions that hold most of the page's running text.

        A region counts only if it also holds an article, main or h1, or next to nothing stands outside of all regions; one
        that is named for readers' comments only if it holds main or h1. A region that is one by a hint counts by its prose too.
        """
        n = len(self.outer)
        running, holds, size, linked, prose = [0] * n, list(self.holds), [0] * n, [0] * n, [0] * n
        for _, text, links, region in self.blocks:
            running[region] += max(0, len(text) - 2 * links)
            size[region] += len(text)
            linked[region] += links
            prose[region] += len(text) if len(text) >= PROSE else 0
        topic = [0 < self.hint[r] <= prose[r] and 2 * prose[r] >= size[r] and FEW_LINKS * linked[r] <= size[r] for r in range(n)]
        outside = running[0]
        for r in range(n - 1, 0, -1):
            holds[self.outer[r]] |= holds[r]
            running[self.outer[r]] += running[r]
        readers = [self.kind[r] == "readers" and not holds[r] & 2 for r in range(n)]
        said = [False] * n
        for r in range(1, n):
            said[r] = said[self.outer[r]] or readers[r]
        total = running[0] - sum(running[r] for r in range(1, n) if said[r] and not said[self.outer[r]])
        counts = [True] * n
        for r in range(1, n):
            most = not said[r] and 2 * running[r] > total
            counts[r] = counts[self.outer[r]] and (topic[r] or most and bool(holds[r] or LITTLE * outside <= running[r]))
        return [(path, text, links) for path, text, links, region in self.blocks if counts[region]]

    def path(self, number: int) -> str:
        steps = []
        while number >= 0:
            steps.append(self.step[number])
            number = self.around[number]
        return ">".join(reversed(steps))

    def number(self, path: str) -> int | None:
        """The number of a path on this page."""
        at: int | None = 0
        for step in path.split(">")[1:]:
            if (at := self.numbers.get((at, step))) is None:
                return None
        return at

    def scores(self) -> dict[int, int]:
        """For each path the running text in its own blocks, half of that one level further in, and so on."""
        out: dict[int, int] = {}
        for path, text, links in self.kept:
            worth = 64 * max(0, len(text) - 2 * links)
            while worth and path >= 0:
                out[path] = out.get(path, 0) + worth
                worth //= 2
                path = self.around[path]
        return out

    def _adds(self, path: int, top: int) -> bool:
        """Whether what an ancestor holds beside `top` belongs to the article: few links, and prose or the ancestor's own blocks.

        An article or main element is one article. The body, and a container without blocks of its own, also hold sites' odd
        lines: they count only if a block beside `top` has PROSE characters; the body's inner containers count only beside a PART.
        """
        size, many = self.size[path] - self.size[top], self.many[path] - self.many[top]
        if not size or FEW_LINKS * (self.linked[path] - self.linked[top]) > size:
            return False
        if self.tags[path] in ("article", "main"):
            return True
        if path == 0 and self.own[0] < many and self.tags[top] not in PARTS:
            return False
        return self.own[path] > 0 or self.prose[path] > self.prose[top]

    def article(self) -> tuple[int | None, int]:
        """The best container, or its widest ancestor that adds parts of the article: headings, leads, what stands around a
        quote; and the best container's score."""
        top, score = max(self.scores().items(), key=lambda x: (x[1], -x[0]), default=(None, 0))
        if not score:
            return None, 0
        path = self.around[top]
        while path >= 0 and self.tags[top] not in ("article", "main"):
            if self._adds(path, top):
                top = path
            elif self.size[path] > self.size[top]:
                break  # it adds what is no part of the article: so does all around it
            path = self.around[path]
        return top, score

    def text(self, winners: list[str]) -> str:
        """The page read through the first winning path that holds at least half of the text in its own article; through
        the latter if that path is only a part of it."""
        own, _ = self.article()
        named = (self.number(w) for w in winners)
        path = next((p for p in named if p is not None and self.size[p] and (own is None or 2 * self.size[p] >= self.size[own])), own)
        if path is None:
            return ""
        around = path
        while around >= 0:
            if around == own:
                path = own
            around = self.around[around]
        inside = [False] * len(self.around)
        for p in range(len(inside)):
            inside[p] = p == path or p > 0 and inside[self.around[p]]
        return "\n\n".join(text for p, text, _ in self.kept if inside[p])


def blocks(html: str) -> Page:
    return Page(html)


def best(page: Page) -> tuple[str | None, int]:
    """The path of the container that holds most running text, and its score."""
    top, score = max(page.scores().items(), key=lambda x: (x[1], -x[0]), default=(None, 0))
    return (page.path(top), score) if score else (None, 0)


def main_text(html: str, winners: list[str]) -> str:
    return Page(html).text(winners)


def _votes():
    def run(x: dict) -> dict:
        out: dict = {"_host": x["_host"], "path": [], "score": []}
        for html in x["_html"]:
            page = Page(html)
            top, score = page.article()
            out["path"].append(None if top is None else page.path(top))
            out["score"].append(score)
        return out

    return run


def _texts():
    def run(x: dict) -> dict:
        texts = [main_text(p, [w["path"] for w in winners or []]) for p, winners in zip(x["_html"], x["_winners"], strict=True)]
        return {"page_id": x["page_id"], "url": x["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return run


def host_paths(pages: DataFrame) -> DataFrame:
    """_host and its winning paths, most votes first, from _host and _html."""
    each = over_texts(pages, lambda: _votes(), "_host string, path string, score bigint").filter(F.col("path").isNotNull())
    tally = written(each.groupBy("_host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score")), "votes")
    whole = tally.groupBy("_host").agg(F.sum("votes").alias("_all"), F.max(F.struct("votes", "score", "path")).alias("_first"))
    winning = tally.join(whole, "_host").filter((F.col("votes") * 20 >= F.col("_all")) | (F.col("path") == F.col("_first.path")))
    ordered = F.sort_array(F.collect_list(F.struct("votes", "score", "path")), asc=False)  # at most 21 for each host
    paths = written(winning.groupBy("_host").agg(ordered.alias("_winners")), "host-paths")
    dropped(tally)
    return paths


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select("page_id", "url", F.coalesce(host, F.lit("")).alias("_host"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    paths = host_paths(rows.select("_host", "_html"))
    measured = paths.agg(F.sum(F.length("_host") + F.aggregate("_winners", F.lit(64), lambda n, w: n + F.length(w["path"]) + 32))).first()[0] or 0
    joined = joined_small(rows, paths, ["_host"], "left", measured)
    return over_texts(joined, lambda: _texts(), _schema(pages))


def _schema(pages: DataFrame):
    kept = [StructField(c, pages.schema[c].dataType) for c in ("page_id", "url")]
    return StructType([*kept, StructField("text", StringType()), StructField("n_chars", LongType())])
