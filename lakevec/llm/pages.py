"""Operator 8: main text of web pages by equivalence classes of tokens over the pages of a host.

Tokens are start tags and blocks of text, each with its place: the path of container tags above it, with their classes.
Over the pages of a host a token has an occurrence vector, its count on every page; exact copies of a page are one page.
Vectors are compared by a sum of hashes of page and count, so partial sums merge and no host is gathered. Tokens with
equal vectors are an equivalence class. Classes on at least SUPPORT of a host's pages, and on MIN_PAGES, are frequent;
the one on most pages (then the one with most tokens) is the frame.

A token is valid in its class if it is ordered, standing at the same rank among the tokens of its class on every page,
and nested, standing in the same gap between two tokens of the frame on every page. The template of a host is what is
valid: its containers open the slots, and its texts are template text. The rest of the text falls into the slots. From
the whole page down, the main slot is the one below that holds MAIN_SHARE of the remaining text outside of links; what stands in it and is
no template text is the main text, with text that stands directly in the slots above it; the other slots passed on the way are left out. Tag names
decide among slots with at least half of the heaviest one's text: one that is or leads to an article, then to a main container, goes
first, and such a container is not gone below, nor does text above it count. Articles side by side are one slot, whatever their
classes. Hosts of too few pages have no template, and pages without text in the main slot of their host do not fit it: both are
judged by the same descent over their own containers.

What markup declares to be a menu, header, footer, sidebar, notice, advert, form or reader comment is no main text: by
tag, or by a class, id or role made of listed words alone; but never html, body, the containers around the only article or main, a header in
an article or main, or a form or named container around all the text of a page: where nothing else remains, such a container is judged by the
template like any other.

Work grows with the length of a page, also where nothing is closed: containers nested deeper than MAX_DEPTH count as side by side, and raw text is
found in one scan.

A host's template has at most twice as many tokens as its mean page, as each stands on half of the pages. Templates are
broadcast up to MAX_BROADCAST tokens in all, and beyond joined by host and salt, so that a host of any size is spread.

Defined results: null or empty html, and pages of template text alone, give an empty text and 0 characters; a null url is a
host of its own; scripts, styles, titles and markup comments are never text; an unclosed script, style, textarea or comment ends with the
page, an unclosed title at the next tag, and of other unclosed hidden elements only the tag goes; as in browsers, other text
in head is text of the page;
white space as Python's str.split sees it becomes one space; repeated pages are kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter, defaultdict
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakevec.llm.shared import stored
from lakevec.llm.textkernel import as_bytes

SUPPORT, MIN_PAGES, MAIN_SHARE, MAX_BROADCAST, SALTS = 0.5, 3, 0.75, 200_000, 32
#: Containers below so many others stand beside the last of these, as browsers limit depth too.
MAX_DEPTH = 100
_RAW = re.compile(r"<!--|<(script|style|textarea|title)\b", re.I)
_RAW_END = re.compile(r"</(script|style|textarea)\s*>", re.I)
_TITLE_END = re.compile(r"</title\s*>|</?(?:title|head|body|html|article|main)\b", re.I)
#: Hidden up to the next end tag of their own; without one, or closed in itself, only the tag goes.
_HIDDEN = frozenset("noscript template iframe svg select button".split())
_HIDDEN_END = re.compile(rf"</({'|'.join(sorted(_HIDDEN))})\s*>", re.I)
_MARK = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_CONTAINERS = frozenset("html body article main section div nav header footer aside form table ul ol dl figure details dialog fieldset".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strong sub sup time tt u var wbr".split())
_FORMS = frozenset("form fieldset".split())
_DROPPED_TAGS = frozenset("nav footer aside form dialog fieldset".split())
#: Fixed words: a container with a class, id or role made of these alone (``cookie-notice``, not ``has-sidebar``) is boilerplate.
_DROPPED_NAMES = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo related replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())


def without_raw(html: str) -> str:
    """``html`` without comments and raw text, each up to its end or else to the end of the page; an unclosed title ends at the next tag. One scan
    forward, whatever is unclosed."""
    ends: dict[str, list[int]] = {"script": [], "style": [], "textarea": []}
    for m in _RAW_END.finditer(html):
        ends[m[1].lower()].append(m.end())
    out, at = [], 0
    while m := _RAW.search(html, at):
        out += [html[at : m.start()], " "]
        if m[1] is None:
            at = html.find("-->", m.end()) + 3
            if at < 3:
                return "".join(out)
            continue
        at = html.find(">", m.end()) + 1
        if not at:
            return "".join(out)
        tag = m[1].lower()
        if tag == "title":
            stop = _TITLE_END.search(html, at)
            if stop and stop[0].endswith(">"):
                at = stop.end()
            else:
                at = html.find("<", at)
                if at < 0:
                    return "".join(out)
        else:
            k = bisect(ends[tag], at)
            if k == len(ends[tag]):
                return "".join(out)
            at = ends[tag][k]
    return "".join([*out, html[at:]])


class Page:
    """blocks: (container path, declared boilerplate or not, text, characters outside of links), in page order; tokens:
    (token, path, is a text, block number or -1) in page order, without texts of declared boilerplate."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, bool, str, int]] = []
        self.tokens: list[tuple[int, str, bool, int]] = []
        nodes = [("", 0, False, False)]  # path, number of the node above, listed as boilerplate, article or main
        forms: set[int] = set()  # of these, listed by tag alone
        opened: Counter[str] = Counter()  # of the stack, by tag
        found: list[tuple[int, str, int]] = []  # node, text, characters outside of links
        seen: list[str | int] = []  # path of a tag, or number of a block
        stack: list[tuple[str, int]] = []  # tag, node
        node, path, text, at, link, linked = 0, "", [], 0, False, 0
        html = without_raw(html)
        ends: dict[str, list[int]] = {t: [] for t in _HIDDEN}
        for m in _HIDDEN_END.finditer(html):
            ends[m[1].lower()].append(m.end())

        def close():
            nonlocal link, linked
            words = " ".join(unescape("".join(text)).split())
            if words:
                seen.append(len(found))
                found.append((node, words, max(0, len(words) - linked)))
            text.clear()
            link, linked = False, 0

        for m in _MARK.finditer(html, 0, html.rfind(">") + 1):
            if m.start() < at:
                continue
            text.append(html[at : m.start()])
            if link:
                linked += m.start() - at
            at = m.end()
            tag = (m[2] or "").lower()
            if tag in _HIDDEN:
                text.append(" ")
                k = bisect(ends[tag], at)
                if not m[1] and k < len(ends[tag]) and not (tag == "svg" and m[3].endswith("/")):
                    at = ends[tag][k]
                continue
            if tag == "a":
                link = not m[1]
            if not tag or tag in _INLINE:
                continue
            close()
            if tag not in _CONTAINERS:
                if not m[1]:
                    seen.append(f"{path}/{tag}")
                continue
            if not m[1]:
                whole = {x for n in _NAMES.findall(m[3]) for x in n.lower().strip("\"'").split()}
                split = [[x for x in re.split(r"[^a-z0-9]+", n) if x and not x.isdigit()] for n in whole]
                path = f"{path if len(stack) < MAX_DEPTH else _up(path)}/{'.'.join([tag, *sorted({x for n in split for x in n})])}"
                inside = "/article" in path or "/main" in path
                named = any(n and _DROPPED_NAMES.issuperset(n) and not (inside and n == ["header"]) for n in split)
                listed = tag in _DROPPED_TAGS or tag == "header" and not inside or named
                body = tag in ("article", "main") or "main" in whole
                nodes.append((path, node, listed and not body and tag not in ("body", "html"), body))
                node = len(nodes) - 1
                if tag in _FORMS and not named:
                    forms.add(node)
                stack.append((tag, node))
                opened[tag] += 1
                seen.append(path)
            elif opened[tag]:
                while (last := stack.pop()[0]) != tag:
                    opened[last] -= 1
                opened[tag] -= 1
                node = stack[-1][1] if stack else 0
                path = nodes[node][0]
        text.append(html[at:])
        close()
        self._judge(nodes, found, forms)
        for x in seen:
            if isinstance(x, str):
                self.tokens.append((tag_token(x), x, False, -1))
            elif not self.blocks[x][1]:
                self.tokens.append((text_token(self.blocks[x][0], self.blocks[x][2]), self.blocks[x][0], True, x))

    def _judge(self, nodes: list[tuple[str, int, bool, bool]], found: list[tuple[int, str, int]], forms: set[int]) -> None:
        """Blocks below a listed container are boilerplate; but if no article or main has text outside of these, the containers around one are
        not. Where all text outside of links would be boilerplate, the page is no form (a form around a whole page), and if that leaves nothing
        either, not the container listed by its names with the most such text of its own."""
        listed, inside, holds = [x[2] for x in nodes], [False] * len(nodes), [False] * len(nodes)
        for n, (_, up, _, body) in enumerate(nodes):
            inside[n] = body or n > 0 and inside[up]

        def within() -> list[int]:
            """For each node the innermost listed container that it is or lies in, or -1."""
            out: list[int] = []
            for n, (_, up, _, _) in enumerate(nodes):
                out.append(n if listed[n] else out[up] if n else -1)
            return out

        own = within()
        if not any(inside[n] and own[n] < 0 for n, _, _ in found):
            for n in range(len(nodes) - 1, 0, -1):
                holds[nodes[n][1]] |= holds[n] or nodes[n][3]
            listed = [x and not h for x, h in zip(listed, holds)]
            own = within()
        left = lambda: any(own[n] < 0 and chars for n, _, chars in found)
        if not left() and forms:
            listed = [x and n not in forms for n, x in enumerate(listed)]
            own = within()
        if not left():
            weights: Counter[int] = Counter()
            for n, _, chars in found:
                if own[n] >= 0 and nodes[own[n]][0].rpartition("/")[2].split(".")[0] not in _DROPPED_TAGS | {"header"}:
                    weights[own[n]] += chars
            top = max(weights, key=lambda n: (weights[n], -n), default=0)
            if weights[top]:
                while top > 0:
                    listed[top], top = False, nodes[top][1]
                own = within()
        self.blocks = [(nodes[n][0], own[n] >= 0, words, chars) for n, words, chars in found]

    def rest(self, template: frozenset[int] | set[int]) -> list[tuple[str, str, int]]:
        """(path, text, characters outside of links) of each block that is neither declared boilerplate nor template text."""
        return [(p, self.blocks[n][2], self.blocks[n][3]) for token, p, is_text, n in self.tokens if is_text and token not in template]

    def text(self, template: frozenset[int] | set[int] = frozenset(), main: str | None = None) -> str:
        """The remaining blocks of the main slot, in page order; of the page's own one if there are none."""
        rest = self.rest(template)
        if main is None or not any(_below(p, top) for p, _, _ in rest for top in main.split("|")):
            weights: Counter[str] = Counter()
            for p, _, chars in rest:
                weights[p] += chars
            main = main_slot(weights)
        tops = main.split("|")
        return " ".join(t for p, t, _ in rest if any(_below(p, top) or rank(top) == 1 and _below(top, p) for top in tops))


@lru_cache(16384)
def tag_token(path: str) -> int:
    return int.from_bytes(blake2b(as_bytes(path), digest_size=8).digest(), "big", signed=True)


def text_token(path: str, text: str) -> int:
    return int.from_bytes(blake2b(as_bytes(f"{path}\0{text}"), digest_size=8).digest(), "big", signed=True)


def _below(path: str, top: str) -> bool:
    return not top or path == top or path.startswith(top + "/")


def _up(path: str) -> str:
    return path.rpartition("/")[0]


@lru_cache(16384)
def rank(path: str) -> int:
    """3 for an article that is in no other, 2 for a main container, else 1."""
    tags = [p.split(".")[0] for p in path.split("/")]
    if tags[-1] == "article" and tags.count("article") == 1:
        return 3
    return 2 if tags[-1] == "main" or "main" in path.rpartition("/")[2].split(".")[1:] else 1


def main_slot(weights: dict[str, int]) -> str:
    """The main slot, as paths joined by | where it is several; ``weights``: characters of text directly in each slot, by path."""
    total: Counter[str] = Counter()
    below: defaultdict[str, list[str]] = defaultdict(list)
    for path, n in weights.items():
        while path:
            if path not in total:
                below[_up(path)].append(path)
            total[path] += n
            path = _up(path)
        total[""] += n

    def leads(top: str) -> int:
        """The highest rank of ``top`` and of what holds half of its text."""
        best, todo = 0, [top]
        while todo:
            path = todo.pop()
            best = max(best, rank(path))
            todo += [p for p in below[path] if 2 * total[p] >= total[top]]
        return best

    found, todo = [], [""]
    while todo:
        at = todo.pop()
        while rank(at) < 3:
            most = max((total[p] for p in below[at]), default=0)
            near = {p: leads(p) for p in below[at] if 2 * total[p] >= most}
            best = max(near, key=lambda p: (near[p], total[p], p), default=None)
            if best is None or near[best] <= rank(at) and (rank(at) > 1 or total[best] < MAIN_SHARE * total[at] or not total[best] and len(below[at]) > 1):
                break
            if near[best] > 1:  # articles side by side, or containers of as much text that lead to some
                todo += [p for p in below[at] if p != best and near[best] in (near.get(p), rank(p))]
            at = best
        found.append(at)
    return "|".join(sorted(found))


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, path, is_text, n_pages, vector) over all different pages of each host."""
    names = {"host": pa.string(), "content": pa.int64(), "token": pa.int64(), "path": pa.string(), "is_text": pa.bool_(), "n": pa.int32()}

    def find(batches):
        for batch in batches:
            out = []
            for h, x, i in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "content"))):
                page = Page(h or "")
                counts = Counter(t for t, _, _, _ in page.tokens)
                first = {t: (p, is_text) for t, p, is_text, _ in page.tokens}
                out += [(x, i, t, *first[t], n) for t, n in counts.items()]
            yield _batch(out, names)

    contents = _with_host(pages).select("host", "html", F.xxhash64("html").alias("content"))
    found = contents.mapInArrow(find, "host string, content long, token long, path string, is_text boolean, n int")
    once = found.groupBy("host", "token", "content").agg(F.max("path").alias("path"), F.bool_or("is_text").alias("is_text"), F.max("n").alias("n"))
    vector = F.sum(F.xxhash64("content", "n").cast("decimal(38,0)"))
    return once.groupBy("host", "token").agg(F.max("path").alias("path"), F.bool_or("is_text").alias("is_text"), F.count("*").alias("n_pages"), vector.alias("vector"))


def classes(pages: DataFrame) -> DataFrame:
    """(host, token, path, is_text, n_pages, class, class_tokens, frame): the tokens of each host's frequent classes; frame
    is the host's first class."""
    found = stored(occurrences(pages).where(F.col("n_pages") >= MIN_PAGES), "page-tokens")
    hosts = _with_host(pages).groupBy("host").agg(F.count_distinct(F.xxhash64("html")).alias("host_pages"))
    frequent = found.join(hosts, "host").where(F.col("n_pages") >= SUPPORT * F.col("host_pages")).withColumn("class", F.xxhash64("vector", "n_pages")).drop("host_pages", "vector")
    sizes = frequent.groupBy("host", "class").agg(F.count("*").alias("class_tokens"), F.max("n_pages").alias("n"))
    frames = sizes.groupBy("host").agg(F.max_by("class", F.struct("n", "class_tokens", "class")).alias("frame"))
    return frequent.join(sizes.drop("n"), ["host", "class"]).join(frames, "host")


def _joined(pages: DataFrame, hosts: DataFrame, tokens: str) -> DataFrame:
    """``pages`` with the columns of ``hosts`` (one row a host, ``tokens`` an array among them): broadcast if small."""
    small = (hosts.agg(F.sum(1 + F.size(tokens))).first()[0] or 0) <= MAX_BROADCAST
    known = hosts.withColumnRenamed("host", "known_host")
    rows = _with_host(pages)
    if small:
        return rows.join(F.broadcast(known), F.col("host") == F.col("known_host"), "left")
    salted = known.withColumn("known_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, (F.col("host") == F.col("known_host")) & (F.col("salt") == F.col("known_salt")), "left")


def template(pages: DataFrame) -> DataFrame:
    """(host, token, path, is_text, class, frame, valid, weight): the tokens of each host's frequent classes; valid: ordered
    and nested; weight: characters outside of links, of the text itself or of text of no class directly in the slot. The
    row of token 0 is the whole page."""
    found = stored(classes(pages), "page-classes")
    hosts = found.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("known"), F.first("frame").alias("frame"))
    names = {"host": pa.string(), "token": pa.int64(), "path": pa.string(), "is_text": pa.bool_(), "rank": pa.int32(), "gap": pa.int32(), "weight": pa.int64()}

    def check(batches):
        for batch in batches:
            host, html, frame, out, cache = (batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("frame").to_pylist(), [], {})
            for i, x in enumerate(host):
                if x not in cache:
                    cache[x] = {t["token"]: t["class"] for t in batch.column("known")[i].as_py()}
                out += [(x, *row) for row in places(Page(html[i] or ""), cache[x], frame[i])]
            yield _batch(out, names)

    checked = _joined(pages, hosts, "known").where("frame is not null").select("html", "host", "known", "frame").mapInArrow(check, "host string, token long, path string, is_text boolean, rank int, gap int, weight long")
    same = lambda c: F.min(c) == F.max(c)
    rows = checked.groupBy("host", "token").agg(F.max("path").alias("path"), F.bool_or("is_text").alias("is_text"), (same("rank") & same("gap")).alias("valid"), F.sum("weight").alias("weight"))
    known = found.select(F.col("host").alias("h"), F.col("token").alias("t"), "class", "frame")
    return rows.join(known, (F.col("host") == F.col("h")) & (F.col("token") == F.col("t")), "left").drop("h", "t")


def places(page: Page, known: dict[int, int], frame: int) -> list[tuple[int, str, bool, int, int, int]]:
    """(token, path, is a text, rank in its class, gap of the frame, weight) of each token of ``known`` (token: class) on the
    page, by its first occurrence, and of the whole page as token 0."""
    ranks: Counter[int] = Counter()
    out: dict[int, list] = {0: [0, "", False, 0, 0, 0]}
    for token, path, is_text, n in page.tokens:
        own = known.get(token)
        if own is not None and token not in out:
            out[token] = [token, path, is_text, ranks[own], ranks[frame], 0]
            ranks[own] += 1
        if is_text:
            slot = token
            if own is None:
                while path and tag_token(path) not in out:
                    path = _up(path)
                slot = tag_token(path) if path else 0
            out[slot][-1] += page.blocks[n][3]
    return [tuple(x) for x in out.values()]


def slots(found: DataFrame) -> DataFrame:
    """(host, texts array<long>, main): the template texts and the main slot of each host. ``found``: ``template`` of its pages."""

    def choose(batches):
        for batch in batches:
            out = []
            for host, rows in zip(batch.column("host").to_pylist(), batch.column("rows").to_pylist()):
                valid = {r["path"] for r in rows if r["valid"] and not r["is_text"]}
                weights: Counter[str] = Counter()
                for r in rows:
                    if not (r["valid"] and r["is_text"]):
                        path = r["path"]
                        while path and path not in valid:
                            path = _up(path)
                        weights[path] += r["weight"]
                out.append((host, [r["token"] for r in rows if r["valid"] and r["is_text"]], main_slot(weights)))
            yield _batch(out, {"host": pa.string(), "texts": pa.list_(pa.int64()), "main": pa.string()})

    hosts = found.groupBy("host").agg(F.collect_list(F.struct("token", "path", "is_text", "valid", "weight")).alias("rows"))  # at most twice a mean page's tokens
    return hosts.mapInArrow(choose, "host string, texts array<long>, main string")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""
    joined = _joined(pages, stored(slots(template(pages)), "page-slots"), "texts")

    def extract(batches):
        for batch in batches:
            html, host, main, cache, texts = batch.column("html").to_pylist(), batch.column("host").to_pylist(), batch.column("main").to_pylist(), {}, []
            for i, x in enumerate(host):
                if x not in cache:
                    cache[x] = frozenset(batch.column("texts")[i].as_py() or ())
                texts.append(Page(html[i] or "").text(cache[x], main[i]))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([as_bytes(t) for t in texts], pa.binary()).cast(pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "host", "texts", "main").mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


def op8_html(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
