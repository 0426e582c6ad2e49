"""Main text of web pages by consensus of each host's pages.

1. Every page is scanned into containers and blocks of text. A container's path is its chain of generalised
   steps (tag and sorted classes without digits); its score is the text inside that isn't noise minus the noise
   inside, noise being menus, forms, adverts and the like, by tag, role or class.
2. Each page votes for the path of its best container; Spark counts votes by host and path.
3. Pages are extracted again along the path they hold that has most votes of their host; a page that holds
   none of at least two votes, or has no host, falls back to its own best container.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlint.llm.common import bounded_batches, materialise, table

#: Up to so many voted paths of all hosts (16 bytes each) are broadcast; beyond, joined.
BROADCAST_PATHS = 500_000

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Words of tags and classes that name main text; their containers count a tenth more.
CONTENT_WORDS = frozenset("article main content post entry story text body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
CONTAINERS = frozenset("html body main article section div center td".split())
NOISE_TAGS = frozenset(
    "head nav footer aside form script style noscript iframe template svg button select option menu dialog textarea title object canvas audio video map input fieldset datalist".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
NOISE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice alert sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus reply replies respond footer
    masthead topbar share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay
    widget toolbar pagination pager copyright rail aside skip""".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Open elements that a start tag ends, looked for up to the nearest of ``SCOPES``.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table select body html div article section main td".split())

#: Noise words of readers' comments, which may be longer than the article and hold articles of their own.
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z][^>]*+>", re.S
)
_SIMPLE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z])", re.S)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRS = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")


class Tags:
    """Tags of a source from left to right, in time that grows with its length whatever its quotes.

    ``next(at)`` gives (start, end, closing name, opening name, attributes) or None. A tag whose quotes never close ends at the
    next > and has no name. After a first such tag the marks that end tags and quotes are looked up by position, and places
    from which a quote never closes are remembered, so nothing is scanned again.
    """

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.marks: list[int] | None = None

    def next(self, at: int):
        if at > self.last and self.source.find("<!--", at) < 0:
            return None  # no tag can end any more
        if self.marks is None:
            m = _TOKEN.search(self.source, at)
            if not m or m[0][0:2] in ("<!", "<?") or m[1] or m[2]:
                return m and (m.start(), m.end(), m[1], m[2], m[3])
            if m.start() > self.last:
                return None
            self.marks = [x.start() for x in re.finditer("[>\"']", self.source)]
            self.quotes = {q: [k for k in self.marks if self.source[k] == q] for q in "\"'"}
            self.hopeless: set[int] = set()
        while m := _SIMPLE.search(self.source, at):
            if not m[2]:
                return m.start(), m.end(), m[1], None, None
            if m.start() > self.last:
                return None
            name = _NAME.match(self.source, m.start() + 1) if m.end() <= self.last else None
            end = self._end(m.end())
            if end:
                # The name ends at the first white space, slash or >, as everywhere.
                upto = min(name.end(), end - 1)
                return m.start(), end, None, self.source[m.start() + 1 : upto], self.source[upto : end - 1]
            return m.start(), self.source.find(">", m.start()) + 1, None, None, None
        return None

    def _end(self, at: int) -> int:
        """End of the tag that is open at ``at``, outside quotes; 0 if a quote never closes or no > follows."""
        seen = []
        while True:
            k = bisect_left(self.marks, at)
            if k == len(self.marks) or self.marks[k] in self.hopeless:
                break
            mark = self.marks[k]
            if self.source[mark] == ">":
                return mark + 1
            seen.append(mark)
            same = self.quotes[self.source[mark]]
            j = bisect_left(same, mark + 1)
            if j == len(same):
                break
            at = same[j] + 1
        self.hopeless.update(seen)
        return 0


class Page:
    """Containers (parent, path hash, step, noise) and blocks (container, text, noise) of one page, in page order.

    Tags, roles and hidden elements make noise for good. Words of classes only raise a suspicion, settled when all of the page is
    known: what is suspected stays noise unless it holds something named as main text and more text than all that isn't noise.
    """

    def __init__(self, source: str | None):
        self.parent, self.hash, self.step, self.noise = [-1], [0], [""], [False]
        self.blocks: list[tuple[int, str, bool]] = []
        if source:
            self._scan(source)

    def _scan(self, source: str) -> None:
        # tag, container, noise, suspect (0 for none)
        stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]
        above, comments, mains = [0], [False], [0]  # of each suspect: the one around it, whether it is of comments, what it holds of main text
        text: list[str] = []
        found: list[tuple[int, str, bool, int, int]] = []
        suspects = [0]  # of each container
        opened: defaultdict[str, list[int]] = defaultdict(list)  # of each name, the stack places of its open elements
        link, linked = False, 0

        def flush() -> None:
            nonlocal linked
            if text:
                if said := " ".join("".join(text).split()):
                    found.append((stack[-1][1], said, stack[-1][2], stack[-1][3], min(linked, len(said))))
                text.clear()
            linked = 0

        def leave(k: int) -> None:
            for x in stack[k:]:
                opened[x[0]].pop()
            del stack[k:]

        def close(names: tuple[str, ...], scopes=frozenset()) -> None:
            # Innermost places are known by name, so nothing is walked however deep the stack is.
            if (k := innermost(names)) and k >= innermost(scopes):
                flush()
                leave(k)

        def innermost(names) -> int:
            return max((opened[x][-1] for x in names if opened.get(x)), default=0)

        def push(*x) -> None:
            opened[x[0]].append(len(stack))
            stack.append(x)

        at, end, tags = 0, len(source), Tags(source)
        while at < end:
            tag = tags.next(at)
            upto = tag[0] if tag else end
            if upto > at:
                part = source[at:upto]
                text.append(_html.unescape(part) if "&" in part else part)
                linked += len(part) if link else 0
            if not tag:
                break
            at = tag[1]
            if name := tag[2]:
                name = name.lower()
                if name == "br":
                    text.append(" ")
                elif name in INLINE:
                    link = link and name != "a"
                    if opened[name] and stack[-1][0] == name:
                        leave(len(stack) - 1)
                elif opened[name]:
                    close((name,))
                else:
                    flush()
            elif name := tag[3]:
                name, attrs = name.lower(), tag[4]
                if name == "br":
                    text.append(" ")
                    continue
                if name in RAW:
                    close_at = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
                    if name not in INLINE:
                        flush()
                    at = close_at.start() if close_at else end
                    if close_at and (gt := source.find(">", at)) >= 0:
                        at = gt + 1
                    continue
                if name in INLINE:
                    link = link or name == "a"
                    if attrs and name not in VOID and self._hidden(attrs):
                        push(name, stack[-1][1], True, stack[-1][3])
                    elif name not in VOID and opened[name]:
                        push(name, *stack[-1][1:])
                    continue
                flush()
                link = False
                if name in CLOSES_P:
                    close(("p",), SCOPES)
                if name in ENDS:
                    close(ENDS[name], SCOPES)
                if name in VOID:
                    continue
                _, inside, noise, suspect = stack[-1]
                noise = noise or name in NOISE_TAGS or (name == "header" and not opened["article"] and not opened["main"]) or bool(attrs) and self._hidden(attrs)
                words = self._words(name, attrs) if attrs else frozenset()
                bad = not NOISE_WORDS.isdisjoint(words) and name not in ("html", "body", "article", "main")
                if bad and not noise:
                    above.append(suspect)
                    comments.append(not COMMENT_WORDS.isdisjoint(words))
                    mains.append(0)
                    suspect = len(above) - 1
                elif not noise and (name in ("article", "main", "h1") or (name in CONTAINERS and name != "body" and not CONTENT_WORDS.isdisjoint(words))):
                    mains[suspect] += 1
                if name in CONTAINERS:
                    step = self._step(name, attrs)
                    self.parent.append(inside)
                    self.hash.append(xxhash.xxh3_64_intdigest(step, self.hash[inside]) >> 1)
                    self.step.append(step)
                    self.noise.append(noise)
                    suspects.append(suspect)
                    inside = len(self.parent) - 1
                push(name, inside, noise, suspect)
            elif source[tag[0] + 1] not in "!?":  # a tag with a quote that never ends
                flush()
        flush()
        bad = self._settled(found, above, comments, mains)
        self.noise = [n or bad[s] for n, s in zip(self.noise, suspects, strict=True)]
        self.blocks = [(at, said, noise or bad[s]) for at, said, noise, s, _ in found]

    @staticmethod
    def _settled(found, above: list[int], comments: list[bool], mains: list[int]) -> list[bool]:
        """Of each suspect whether it is noise. Text in links doesn't speak for main text; comments only if nothing else is named so."""
        n = len(above)
        own = [0] * n
        for _, said, noise, s, linked in found:
            own[s] += 0 if noise else len(said) - linked
        inside, held = own[:], mains[:]
        for s in range(n - 1, 0, -1):
            if not comments[s]:
                inside[above[s]] += inside[s]
            held[above[s]] += held[s] if not comments[s] else 0
        bad, within = [False] * n, [[] for _ in range(n)]
        for s in range(1, n):
            within[above[s]].append(s)
        clean, named = own[0], mains[0]
        waiting = [(-inside[s], s) for s in within[0]]
        heapify(waiting)
        while waiting:  # those around come first, then those with most text
            s = heappop(waiting)[1]
            bad[s] = bad[above[s]] or not (held[s] and inside[s] > clean and not (comments[s] and named))
            if not bad[s]:
                clean, named = clean + own[s], named + mains[s]
            for k in within[s]:
                heappush(waiting, (-inside[k], k))
        return bad

    @staticmethod
    def _step(name: str, attrs: str | None) -> str:
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRS.findall(attrs)} if attrs else {}
        return ".".join([name, *sorted({re.sub(r"\d+", "", x) for x in found.get("class", "").split()} - {""})])

    @staticmethod
    def _hidden(attrs: str) -> bool:
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRS.findall(attrs)}
        if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in NOISE_ROLES:
            return True
        return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")))

    @staticmethod
    def _words(name: str, attrs: str) -> frozenset[str]:
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRS.findall(attrs)}
        return frozenset(_WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}".lower()))

    def best(self) -> int:
        """Path hash of the best container; 0 (the whole page) if there is no text.

        All containers on one path count together. Ties go to the deeper path, as it names what it holds more
        closely, then to the smaller hash.
        """
        n = len(self.parent)
        score = [0] * n
        for at, said, noise in self.blocks:
            score[at] += -len(said) if noise else len(said)
        total, depth = max(1, sum(len(s) for _, s, bad in self.blocks if not bad)), [0] * n
        for k in range(1, n):
            depth[k] = depth[self.parent[k]] + 1
        for k in range(n - 1, 0, -1):
            score[self.parent[k]] += score[k]
        paths: dict[int, tuple[float, int, int]] = {}
        for k in range(n):
            if self.noise[k]:
                continue
            named = self.step[k] != "body" and not CONTENT_WORDS.isdisjoint(_WORDS.findall(self.step[k].lower()))
            bonus = 0.1 * total if named and self.hash[k] not in paths else 0
            old = paths.get(self.hash[k], (0, 0, 0))
            paths[self.hash[k]] = (old[0] + score[k] + bonus, depth[k], -self.hash[k])
        return max(paths, key=paths.get) if self.blocks else 0

    def text(self, path: int) -> str | None:
        """Blocks inside containers on ``path``, noise left out, joined by newlines; None if the page has no such path."""
        inside = [h == path for h in self.hash]
        if not any(inside):
            return None
        for k in range(1, len(inside)):
            inside[k] = inside[k] or inside[self.parent[k]]
        return "\n".join(said for at, said, noise in self.blocks if inside[at] and not noise)


def host(url: str):
    """Host of a URL column in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def page_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes) from pages (url, html); pages without text or host don't vote.

    A path with a single vote is left out: that is its voter's own best container, to which the voter falls back.
    """

    def run(batches):
        for b in batches:
            paths = [Page(t).best() for t in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(paths, pa.int64())], names=["host", "path"])

    votes = pages.select(host("url").alias("host"), "html").where("host != ''").mapInArrow(run, "host string, path long")
    return votes.where("path != 0").groupBy("host", "path").agg(F.count("*").alias("votes")).where("votes > 1")


def _key(site: str, path: int) -> int:
    return xxhash.xxh3_64_intdigest(site, path)


class Ballot:
    """Votes by host and path, as two arrays ordered by a hash of both."""

    def __init__(self, keys: np.ndarray, votes: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.votes = keys[order], votes[order]

    def ranked(self, site: str, paths: set[int]) -> list[int]:
        """Those of ``paths`` that have votes of the host, most voted first."""
        if not site or not len(self.keys):
            return []
        held = sorted(paths)
        keys = np.fromiter((_key(site, p) for p in held), np.uint64, len(held))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        votes = np.where(self.keys[at] == keys, self.votes[at], 0)
        return [held[k] for k in np.argsort(-votes, kind="stable") if votes[k]]


def ballot(votes: DataFrame) -> Ballot:
    def run(batches):
        for b in batches:
            keys = [_key(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), b.column("votes")], names=["key", "votes"])

    found = votes.mapInArrow(run, "key long, votes long").toArrow()
    return Ballot(found.column("key").to_numpy().view(np.uint64), found.column("votes").to_numpy())


def page_paths(pages: DataFrame, votes: DataFrame) -> DataFrame:
    """(host, page, paths array<long>): voted paths that a page (host, page, html) holds, most voted first.

    ``page`` is a digest of the html, so equal pages of a host are one.
    """

    def run(batches):
        for b in batches:
            held = [sorted(set(Page(t).hash)) for t in b.column("html").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(held)), [len(x) for x in held]))
            flat = pa.array([p for x in held for p in x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("host").take(at), b.column("page").take(at), flat], names=["host", "page", "path"])

    held = pages.where("host != ''").select("host", "page", "html").mapInArrow(run, "host string, page string, path long")
    ordered = F.array_sort(F.collect_set(F.struct((-F.col("votes")).alias("rank"), "path")))
    return held.join(votes, ["host", "path"]).groupBy("host", "page").agg(F.transform(ordered, lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Null or empty html, and pages without text, give an empty text. Pages without a host stand for themselves.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    votes = materialise(page_votes(pages), "host-votes")
    keyed = pages.withColumn("host", host("url"))
    shared = None
    if votes.count() <= BROADCAST_PATHS:
        shared = spark.sparkContext.broadcast(ballot(votes))
    else:
        keyed = keyed.withColumn("page", F.md5("html"))
        keyed = keyed.join(materialise(page_paths(keyed, votes), "page-paths"), ["host", "page"], "left").select("page_id", "url", "html", "host", "paths")

    def run(batches):
        for b in batches:
            said = []
            lists = b.column("host" if shared else "paths").to_pylist()
            for source, given in zip(b.column("html").to_pylist(), lists, strict=True):
                page = Page(source)
                winners = shared.value.ranked(given, set(page.hash)) if shared else given or ()
                found = next((t for p in winners if (t := page.text(p))), None)
                said.append(found or page.text(page.best()) or "")
            n = pa.array(np.array([len(s) for s in said], np.int64))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(said, pa.string()), n], names=["page_id", "url", "text", "n_chars"])

    return keyed.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each row of ``pages``; null and empty html has an empty one, repeated rows have the same, an empty table gives no rows."""
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
