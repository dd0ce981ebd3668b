"""HTML extraction with consensus paths: containers that most pages of a host agree on."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from poremetry.llm.common import ascii_lower, in_pieces, map_texts
from poremetry.workspace import materialize

MARKUP = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
TAG_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# How HTML nests.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes".split())
BLOCKS = set(("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
              "header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul").split())
CLOSES_P = BLOCKS - set("dd dt li tbody tfoot thead tr summary figcaption html body".split())
ENDED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table article section div body main td th".split())
CONTAINERS = set("article main section div td body".split())
# Elements and names that hold no part of an article.
DROPPED = set(("script style noscript template nav header footer aside form button select textarea input label iframe object svg canvas audio video "
               "menu dialog head title embed").split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
BOILERPLATE = set(("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner "
                   "sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices "
                   "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
                   "recommendations comment comments reply replies respond disqus widget widgets toolbar pagination pager skip search").split())
TEXT_TAGS = set("h1 h2 h3 h4 h5 h6 p".split())
HEADERS = {"header", "site-header", "page-header", "global-header", "top-header", "main-header", "siteheader", "pageheader", "topbar"}
PROSE = set("article content post entry story main body text".split())
CLEARLY = 2  # a page's own best container replaces the host's when it scores so many times more
MARKS_OTHERS = {"has", "no", "with", "without"}  # such names tell about the page, not about the element
KEEP_DESPITE_NAME = {"body", "html", "main"}
SPLIT = re.compile(r"[^a-z0-9]+")


class Page:
    """Elements of a page as parallel lists, and its text pieces with their element and block."""

    def __init__(self, source: str):
        self.tag, self.parent, self.path, self.dropped, self.link = ["#root"], [-1], [""], [False], [False]
        self.weight = [0.0]  # of a container, else 0
        self.pieces: list[tuple[int, int, str]] = []  # element, block, raw text
        self.block = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, stack, n = 0, [0], len(source)
        while at < n:
            found = MARKUP.search(source, at)
            if not found:
                self._text(stack[-1], source[at:])
                return
            if found.start() > at:
                self._text(stack[-1], source[at:found.start()])
            name = found.group(2)
            if name is None:
                end = {"<!--": "-->", "<![CDATA[": "]]>"}.get(found.group(), ">")
                stop = source.find(end, found.end())
                at = n if stop < 0 else stop + len(end)
                continue
            rest = TAG_REST.match(source, found.end())
            stop = rest.end() if rest else source.find(">", found.end()) + 1
            if not stop:  # a tag that never ends
                return
            attributes, name, at = source[found.end():stop - 1], name.lower(), stop
            if found.group(1):
                self._close(stack, name)
                continue
            self._implied_ends(stack, name)
            if name in BLOCKS:
                self.block += 1
            elif name in ("br", "td", "th"):
                self._text(stack[-1], " ")
            if name in RAW:
                closing = re.compile(f"</{name}[^a-zA-Z0-9]", re.I).search(source, stop)
                at = n if not closing else source.find(">", closing.start()) + 1 or n
                continue
            if name not in VOID and not attributes.endswith("/") or name in BLOCKS and name != "hr":
                stack.append(self._open(stack[-1], name, attributes))

    def _text(self, element: int, raw: str) -> None:
        if not self.dropped[element]:
            self.pieces.append((element, self.block, raw))

    def _open(self, parent: int, name: str, attributes: str) -> int:
        facts = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        names = f"{facts.get('class', '')} {facts.get('id', '')}"
        names = re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower()
        whole = names.split()
        boiler = name in DROPPED or facts.get("role", "").lower() in DROPPED_ROLES or "hidden" in facts or facts.get("aria-hidden", "") == "true"
        if not boiler and name not in KEEP_DESPITE_NAME:
            ids = re.sub(r"([a-z])([A-Z])", r"\1-\2", facts.get("id", "")).lower().split()
            for one in whole:
                words = set(SPLIT.split(one))
                # headings and paragraphs, and all ids, which repeat a heading's words, count only where every word says so
                if (name in TEXT_TAGS or one in ids) and one not in HEADERS and not words <= BOILERPLATE:
                    continue
                if one in HEADERS or words & BOILERPLATE and not words & MARKS_OTHERS and not words & PROSE - {"post", "main", "text"}:
                    boiler = True
        element = len(self.tag)
        kind = ".".join([name, *sorted({re.sub(r"\d+", "", one).strip("-_") for one in whole} - {""})])
        prose = name in ("article", "main") or any(set(SPLIT.split(k)) & PROSE for k in kind.split(".")[1:])
        self.tag.append(name)
        self.weight.append(0.0 if name not in CONTAINERS else 0.6 if name == "body" else 1.4 if prose else 1.0)
        self.parent.append(parent)
        self.path.append(f"{self.path[parent]}>{kind}" if name in BLOCKS or name in CONTAINERS else self.path[parent])
        self.dropped.append(self.dropped[parent] or boiler)
        self.link.append(self.link[parent] or name == "a")
        return element

    def _implied_ends(self, stack: list[int], name: str) -> None:
        closes = ENDED_BY.get(name)
        if name in CLOSES_P or closes:
            for i in range(len(stack) - 1, 0, -1):
                tag = self.tag[stack[i]]
                if name in CLOSES_P and tag == "p" or closes and tag in closes:
                    del stack[i:]
                    self.block += 1
                    break
                if tag in SCOPES:
                    break

    def _close(self, stack: list[int], name: str) -> None:
        if name in BLOCKS:
            self.block += 1
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == name:
                del stack[i:]
                return
            if name == "p" and self.tag[stack[i]] in SCOPES:
                return

    def container_scores(self, but: str = "") -> dict[str, float]:
        """Score of every generalised container path: its share of the page's text outside links, favouring deep and article-like ones.

        With ``but``, only containers that neither hold nor stand inside a container with that path (see ``climbed``).
        """
        size = [0.0] * len(self.tag)
        for element, _, raw in self.pieces:
            if not self.link[element]:
                size[element] += len(raw) - raw.count(" ") - raw.count("\n")
        for element in range(len(size) - 1, 0, -1):  # children come after their parents
            size[self.parent[element]] += size[element]
        total, scores = max(size[0], 1.0), {}
        left_out = [False] * len(self.tag)
        if but:
            tops = self.climbed(but)
            left_out = self.within(tops)
            for element in tops:
                while element >= 0:
                    left_out[element] = True
                    element = self.parent[element]
        for element in range(1, len(size)):
            if not self.weight[element] or self.dropped[element] or not size[element] or left_out[element]:
                continue
            path = self.path[element]
            scores[path] = scores.get(path, 0.0) + self.weight[element] * (1 + 0.02 * path.count(">")) * size[element] / total
        return scores

    def climbed(self, path: str) -> set[int]:
        """The outermost containers around those with a path that weigh no less.

        The vote goes to the inner one of two such containers when it holds nearly all of the text; titles and leads can stand between.
        """
        tops = set()
        for element in range(1, len(self.tag)):
            if self.weight[element] and self.path[element] == path:
                top = up = element
                while up > 0:
                    if self.weight[up] >= self.weight[element]:
                        top = up
                    up = self.parent[up]
                tops.add(top)
        return tops

    def within(self, tops: set[int]) -> list[bool]:
        inside = [False] * len(self.tag)
        for element in range(1, len(self.tag)):
            inside[element] = inside[self.parent[element]] or element in tops
        return inside

    def text(self, path: str) -> str:
        """Blocks inside the containers that ``climbed`` finds for a path (the whole page for an empty path), one per line."""
        inside = self.within(self.climbed(path)) if path else [True] * len(self.tag)
        blocks: dict[int, list[str]] = {}
        for element, block, raw in self.pieces:
            if inside[element]:
                blocks.setdefault(block, []).append(raw)
        lines = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
        return "\n".join(line for line in lines if line)

    def article(self, winner: str) -> str:
        """The text of the host's winning path, or that of the page's own best container where the winner is absent, empty or clearly the smaller one."""
        text = self.text(winner) if winner else ""
        if text:
            own, others = self.container_scores(), self.container_scores(but=winner)
            rival = best_path(others)
            held = max((own.get(self.path[top], 0.0) for top in self.climbed(winner)), default=0.0)
            return self.text(rival) if rival and others[rival] > CLEARLY * held else text
        return self.text(best_path(self.container_scores()))


def best_path(scores: dict[str, float]) -> str:
    return max(scores, key=lambda p: (scores[p], p)) if scores else ""


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def votes(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, path, score): what the pages of a host give each container path; a task adds up its own pages before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], float] = {}
            pages_of = ((h.as_py(), t.as_py()) for h, t in zip(batch.column(0), batch.column(1)))
            for host, text in pages_of:
                for path, score in Page(text or "").container_scores().items():
                    sums[host, path] = sums.get((host, path), 0.0) + score
            rows = [(h, p, round(1e6 * s)) for (h, p), s in sums.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                names=["host", "path", "score"])

    cast = pages.select(host_of(F.col(url)).alias("host"), F.col(source).alias("html"))
    return map_texts(cast, run, "host string, path string, score bigint").groupBy("host", "path").agg(F.sum("score").alias("score"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    Every page scores its containers; the scores are added per host and generalised tag-class path; every page is read again with the
    winning path of its host, from which it climbs to the outermost container that weighs no less. A page without that container, with no text
    in it, or with a container beside it that holds clearly more, uses its own best container. Inside, navigation,
    headers, footers, asides, forms, scripts, adverts, notices and comments are left out by element, role and name.
    Null and empty pages have an empty text; null urls share the empty host; repeated rows are extracted one by one; an empty table gives an
    empty result; further columns are ignored. The winners, one short row per host, are broadcast only below Spark's size limit;
    beyond it adaptive execution splits a host with many pages.
    """
    winners = materialize(votes(pages, url, source).groupBy("host").agg(F.max(F.struct("score", "path"))["path"].alias("winner")))
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches):
            texts = []
            for source_text, winner in zip(batch.column("html").to_pylist(), batch.column("winner").to_pylist()):
                texts.append(Page(source_text or "").article(winner))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"), host_of(F.col(url)).alias("host"))
    return map_texts(given.join(winners, "host", "left"), run, f"page_id {kind}, url string, text string, n_chars bigint")
