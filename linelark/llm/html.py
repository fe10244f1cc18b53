"""Main-text extraction by wrappers inferred from the pages of a host (after Crescenzi, Mecca and Merialdo, 2001).

Each page becomes a stream of tags and text slots. The streams of a host are aligned one after another into a union-free
regular expression: what repeats side by side becomes a repeated group, what some pages lack an optional group, texts
become slots. The wrapper is then an automaton over tags: parsing a page with the wrapper of its host binds each of the
page's texts to a slot. A text that most of the pages with its slot have there is the host's template, what varies is data;
element names and marks tell the chrome that varies and the articles that don't.
"""

from __future__ import annotations

import functools
import hashlib
import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import arrow_schema, map_rows, small_batches, table

#: Elements nested deeper are not told apart in a wrapper, but whether they are an article or chrome.
DEPTH = 64
#: Distinct streams of a host that one task aligns; what comes of them is aligned in the same way.
FOLD = 64
#: Pages of a host that share a copy of its wrapper, and bytes of wrappers up to which all are broadcast.
HOST_PAGES, BROADCAST_BYTES = 50_000, 32 << 20
#: A text is template if so many different pages of the host, and this share of those with its slot, have it there.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.5

# Element names and marks of HTML.
RAW = "script style noscript template svg math iframe object canvas audio video textarea select".split()
VOID = "area base br col embed hr img input link meta source track wbr".split()
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
CHROME = "nav header footer aside form script style noscript head title menu dialog button fieldset".split()
CHROME_WORDS = set("ad ads advert advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside widget footer header masthead topbar toolbar cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login share sharing social related recommended comment comments reply replies discussion respond disqus form search pagination pager legal copyright skip".split())
CHROME_STARTS = ("advert", "breadcrumb", "comment", "cookie", "navbar", "navigation", "newsletter", "sidebar", "sponsor", "subscri")
#: Words of a name's parts that leave a chrome word beside them what it is, as in cookie-banner; others don't, as in related-work.
LAYOUT_WORDS = set("area bar block bottom box btn button center col column container content element elements entry form full global group head holder icon icons inner item items js label layout left line link links list main menu middle mini mobile module page pane panel placeholder post posts region right row section site slot space strip title top unit view widget widgets wrap wrapper zone".split())
MAIN_WORDS = set("article main content post entry story body".split())
LABELS = set("h1 h2 h3 h4 h5 h6 dt th td caption figcaption legend summary".split())
ARTICLES = ("article", "main")
CLOSED_BY_NEXT = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
CLOSES_P = set("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+>?|<\?[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(f"</{name}", re.I) for name in RAW}


def _marks(attributes: str) -> str:
    """The class, id and role names of a tag, lower case, each as its words joined by '-', digits removed."""
    found = set()
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            if words := _NAME.findall(name):
                found.add("-".join(words))
    return ".".join(sorted(found))


class _Open:
    """The open elements: ``path`` has those up to DEPTH and of the deeper ones the first article and the first chrome."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.shown: list[str] = []
        self.counts: dict[str, int] = {}
        self.article: tuple[int, str] | None = None  # of the deeper ones: place and element
        self.chrome: tuple[int, str] | None = None
        self._path: tuple[str, ...] | None = ()

    @property
    def path(self) -> tuple[str, ...]:
        if self._path is None:
            self._path = tuple(self.shown)
            if self.article or self.chrome:
                self._path += tuple(element for _, element in sorted(x for x in (self.article, self.chrome) if x))
        return self._path

    def top(self) -> str:
        return self.names[-1] if self.names else ""

    def push(self, name: str, marks: str) -> None:
        element, place = f"{name}.{marks}" if marks else name, len(self.names)
        self.names.append(name)
        self.counts[name] = self.counts.get(name, 0) + 1
        if place < DEPTH:
            self.shown.append(element)
            self._path = None
        elif not self.chrome:
            inside = bool(self.article) or any(x.partition(".")[0] in ARTICLES for x in self.shown)
            if _chrome(element, inside):
                self.chrome, self._path = (place, element), None
            elif name in ARTICLES and not self.article:
                self.article, self._path = (place, element), None

    def pop(self) -> None:
        name = self.names.pop()
        self.counts[name] -= 1
        place = len(self.names)
        if place < DEPTH:
            self.shown.pop()
            self._path = None
        if self.chrome and self.chrome[0] == place:
            self.chrome = self._path = None
        if self.article and self.article[0] == place:
            self.article = self._path = None

    def close(self, name: str) -> None:
        """Ends the innermost open element of that name and all within; nothing if there is none."""
        if self.counts.get(name):
            while self.names[-1] != name:
                self.pop()
            self.pop()


def blocks(page: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """(path of open block elements, raw text with references) of each run of text, with '' for a break between blocks.

    Elements are named tag or tag.marks. Raw-text elements, comments and declarations give nothing; an unclosed element
    ends with its parent; a paragraph ends where a block starts, an item, row or cell where the next one does.
    """
    open_ = _Open()
    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            yield open_.path, page[at:start]
        if start == end:
            return
        m = _TAG.match(page, start)
        if not m:
            yield open_.path, "<"
            at = start + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE and open_.top() != name:
                continue
            open_.close(name)
        elif name in RAW:
            if m[0].endswith("/>") and name in ("svg", "math"):
                continue
            stop = _RAW_END[name].search(page, at)
            at = end if stop is None else (page.find(">", stop.start()) + 1 or end)
            continue
        elif name in INLINE and name not in VOID:
            marks = _marks(m[3]) if m[3] else ""
            # on the path only if it is chrome or within such, so that emphasis does not split a block
            if open_.top() not in INLINE and not _chrome_words(marks):
                continue
            open_.push(name, marks)
        elif name not in VOID:
            if name in CLOSES_P and open_.top() == "p":
                open_.pop()
            elif name in CLOSED_BY_NEXT:
                while open_.top() in CLOSED_BY_NEXT[name]:
                    open_.pop()
            open_.push(name, _marks(m[3]) if m[3] else "")
        yield open_.path, ""


def stream(page: str) -> tuple[list[str], list[list[str]]]:
    """(tokens, pieces): '<x', '>x' and '#' for a text slot, from the paths of the page's texts; and the pieces of text of each slot."""
    out: list[str] = []
    texts: list[list[str]] = []
    before: tuple[str, ...] = ()
    for path, text in blocks(page):
        if path is not before and path != before:
            common, shorter = 0, min(len(before), len(path))
            while common < shorter and before[common] == path[common]:
                common += 1
            out += [">" + x for x in reversed(before[common:])] + ["<" + x for x in path[common:]]
            before = path
        if out and out[-1] == "#":
            texts[-1].append(text or " ")
        elif text.strip():
            out.append("#")
            texts.append([text])
    return out + [">" + x for x in reversed(before)], texts


_BASE, _PRIME = 1_000_003, (1 << 61) - 1


# A wrapper is a list of items [name, children, optional, repeated]; name is an element's, "#" for a text slot or "()" for a
# run of siblings that repeats as a whole.

def tree(tokens: list[str]) -> list:
    """The items of one page's tokens, side-by-side elements of one name folded into repeated ones."""
    stack: list[list] = [["", [], False, False]]
    for t in tokens:
        if t == "#":
            stack[-1][1].append(["#", [], False, False])
        elif t[0] == "<":
            stack.append([t[1:], [], False, False])
        else:
            item = stack.pop()
            item[1] = repeated(item[1])
            stack[-1][1].append(item)
    return repeated(stack[0][1])


def _key(item: list) -> str:
    return item[0] if item[0] != "()" else "(" + ",".join(map(_key, item[1])) + ")"


def _merged(x: list, y: list) -> list:
    return [x[0], align(x[1], y[1]), x[2] or y[2], x[3] or y[3]]


class _Run:
    """Siblings so far, with a hash of each beginning, so that two runs side by side are compared at once."""

    def __init__(self) -> None:
        self.items: list = []
        self.keys: list[str] = []
        self.hashes = [0]
        self.places: dict[str, list[int]] = {}

    def push(self, item: list) -> None:
        key = _key(item)
        self.places.setdefault(key, []).append(len(self.keys))
        self.items.append(item)
        self.keys.append(key)
        self.hashes.append((self.hashes[-1] * _BASE + hash(key)) % _PRIME)

    def cut(self, n: int) -> list:
        """Takes off the last ``n``."""
        gone = self.items[-n:]
        for key in self.keys[-n:]:
            self.places[key].pop()
        del self.items[-n:], self.keys[-n:], self.hashes[-n:]
        return gone

    def same(self, n: int) -> bool:
        """Whether the last ``n`` are by name those before them."""
        h, power = self.hashes, pow(_BASE, n, _PRIME)
        if (h[-1] - h[-n - 1] * power - h[-n - 1] + h[-2 * n - 1] * power) % _PRIME:
            return False
        return self.keys[-2 * n : -n] == self.keys[-n:]

    def again(self) -> int | None:
        """The length of the shortest run at the end that comes twice side by side."""
        size, places = len(self.keys), self.places[self.keys[-1]]
        for i in range(len(places) - 2, -1, -1):
            n = size - 1 - places[i]
            if 2 * n > size:
                return None
            if self.same(n):
                return n
        return None


def repeated(items: list) -> list:
    """Runs of siblings that come twice side by side, compared by name, become one repeated run; their contents are aligned."""
    run = _Run()
    groups: list[int] = []  # places of the repeated runs
    for item in items:
        run.push(item)
        while True:
            size = len(run.keys)
            while groups and (groups[-1] >= size or run.items[groups[-1]][0] != "()"):
                groups.pop()
            if run.items[-1][0] == "()":
                if not groups or groups[-1] != size - 1:
                    groups.append(size - 1)
            # a repeated run that is followed by the same siblings once more takes them in
            last = groups[-1] if groups else size - 1
            group = run.items[last]
            if last < size - 1 and len(group[1]) == size - 1 - last and [_key(x) for x in group[1]] == run.keys[last + 1 :]:
                more = run.cut(size - 1 - last)
                run.cut(1)
                run.push(["()", [_merged(x, y) for x, y in zip(group[1], more)], group[2], True])
                continue
            n = run.again()
            if n is None:
                break
            more = run.cut(n)
            pairs = list(zip(run.cut(n), more))
            if n == 1:
                x, y = pairs[0]
                run.push([x[0], align(x[1], y[1]), x[2] and y[2], True])
            else:
                run.push(["()", [_merged(x, y) for x, y in pairs], False, True])
    return run.items


def align(a: list, b: list) -> list:
    """The least list of items that stands for both: siblings of one name are aligned inside, what only one has is optional."""
    if a == b:
        return a
    out: list = []
    for kind, a0, a1, b0, b1 in SequenceMatcher(None, [_key(x) for x in a], [_key(x) for x in b], autojunk=False).get_opcodes():
        if kind == "equal":
            out += [_merged(x, y) for x, y in zip(a[a0:a1], b[b0:b1])]
        else:
            out += [[x[0], x[1], True, x[3]] for x in a[a0:a1] + b[b0:b1]]
    return repeated(out)


def expression(items: list) -> str:
    """The wrapper as text, such as ``<ul>(<li>#</li>)+</ul>``."""
    out = []
    for name, children, optional, again in items:
        inner = "#" if name == "#" else expression(children) if name == "()" else f"<{name}>{expression(children)}</{name.partition('.')[0]}>"
        out.append(f"({inner}){'*' if optional and again else '?' if optional else '+'}" if optional or again else inner)
    return "".join(out)


class _Sequence:
    """Items side by side: which can come first from each place on, without a table of all pairs."""

    def __init__(self, within: tuple | None) -> None:
        self.within = within  # (sequence, place) of the group it is, or None for an element's or the page's
        self.close = -1  # state of the closing tag
        self.element = ""
        self.items: list[tuple] = []  # (name, state or sequence, repeated)
        self.starts: dict[str, list[int]] = {}
        self.stops: list[int] = []

    def finish(self, optional: list[bool]) -> None:
        """``stops``: for each place the next item that can't be left out, or the end."""
        self.stops = [len(self.items)] * (len(self.items) + 1)
        for i in range(len(self.items) - 1, -1, -1):
            self.stops[i] = self.stops[i + 1] if optional[i] else i

    @property
    def can_be_empty(self) -> bool:
        return self.stops[0] == len(self.items)

    def first(self) -> list[str]:
        """Tokens that it can begin with."""
        return [label for label, places in self.starts.items() if places[0] <= self.stops[0]]


class Parser:
    """A wrapper as an automaton with a state for each of its tokens (after Glushkov, 1961). ``paths`` has the open elements around each.

    What can follow a state is looked up by token when it is needed, so a wrapper of n siblings takes memory for n, not n * n.
    """

    def __init__(self, items: list) -> None:
        self.labels: list[str] = []
        self.paths: list[tuple[str, ...]] = []
        self._at: list[tuple[_Sequence, int]] = []  # of each state its sequence and place
        self._inner: dict[int, _Sequence] = {}  # of an opening tag's state what is in the element
        self._known: dict[tuple[int, str], list[int]] = {}
        self._root = self._build(items, (), None)
        self.articles: list[bool | None] = [in_article(p) for p in self.paths]

    def _state(self, label: str, path: tuple[str, ...], at: tuple[_Sequence, int]) -> int:
        self.labels.append(label)
        self.paths.append(path)
        self._at.append(at)
        return len(self.labels) - 1

    def _build(self, items: list, path: tuple[str, ...], within: tuple | None) -> _Sequence:
        seq, optional = _Sequence(within), []
        for i, (name, children, may_lack, again) in enumerate(items):
            if name == "()":
                inner = self._build(children, path, (seq, i))
                seq.items.append((name, inner, again))
                for label in inner.first():
                    seq.starts.setdefault(label, []).append(i)
                optional.append(may_lack or inner.can_be_empty)
                continue
            label = "#" if name == "#" else "<" + name
            state = self._state(label, path if name == "#" else (*path, name), (seq, i))
            if name != "#":
                inner = self._build(children, (*path, name), None)
                inner.close, inner.element = self._state(">" + name, path, (seq, i)), name
                self._inner[state] = inner
            seq.items.append((name, state, again))
            seq.starts.setdefault(label, []).append(i)
            optional.append(may_lack)
        seq.finish(optional)
        return seq

    def _item(self, seq: _Sequence, i: int, token: str) -> list[int]:
        name, what, _ = seq.items[i]
        return self._enter(what, 0, token) if name == "()" else [what] * (self.labels[what] == token)

    def _enter(self, seq: _Sequence, i: int, token: str) -> list[int]:
        """States that ``token`` can begin with from place ``i`` on."""
        places = seq.starts.get(token, ())
        out: list[int] = []
        for n in range(bisect_left(places, i), len(places)):
            if places[n] > seq.stops[i]:
                break
            out += self._item(seq, places[n], token)
        return out

    def _after(self, seq: _Sequence, i: int, token: str) -> list[int]:
        """States that ``token`` can be in behind item ``i``."""
        out = self._item(seq, i, token) if seq.items[i][2] else []
        out += self._enter(seq, i + 1, token)
        return out + self._leave(seq, token) if seq.stops[i + 1] == len(seq.items) else out

    def _leave(self, seq: _Sequence, token: str) -> list[int]:
        if seq.within:
            return self._after(*seq.within, token)
        return [seq.close] * (seq.close >= 0 and token == ">" + seq.element)

    def _follow(self, state: int, token: str) -> list[int]:
        known = self._known.get((state, token))
        if known is None:
            inner = self._inner.get(state)
            if inner is None:
                known = self._after(*self._at[state], token)
            else:
                known = self._enter(inner, 0, token) + (self._leave(inner, token) if inner.can_be_empty else [])
            known = self._known[state, token] = list(dict.fromkeys(known))
        return known

    def _ends(self, state: int) -> bool:
        """Whether a page can end behind this state."""
        if state in self._inner:
            return False
        seq, i = self._at[state]
        while seq.stops[i + 1] == len(seq.items):
            if not seq.within:
                return seq is self._root
            seq, i = seq.within
        return False

    def parse(self, tokens: list[str]) -> list[int] | None:
        """The wrapper's state for each token of a page; None if the wrapper doesn't fit it."""
        if not tokens:
            return []
        back: list[dict[int, int]] = [dict.fromkeys(self._enter(self._root, 0, tokens[0]), -1)]
        for t in tokens[1:]:
            now: dict[int, int] = {}
            for s in back[-1]:
                for f in self._follow(s, t):
                    now.setdefault(f, s)
            if not now:
                return None
            back.append(now)
        state = next((s for s in back[-1] if self._ends(s)), None)
        if state is None:
            return None
        out = []
        for step in reversed(back):
            out.append(state)
            state = step[state]
        return out[::-1]


@functools.lru_cache(100_000)
def _chrome_words(marks: str) -> bool:
    """Whether a name has a word for chrome and otherwise only words of layout."""
    for name in marks.split(".") if marks else ():
        words = name.split("-")
        known = [w in CHROME_WORDS or w.startswith(CHROME_STARTS) for w in words]
        if any(known) and all(k or w in LAYOUT_WORDS or len(w) < 3 for k, w in zip(known, words)):
            return True
    return False


def _words(marks: str) -> set[str]:
    return set(re.split(r"[.-]", marks))


def _chrome(element: str, inside: bool) -> bool:
    """Whether an element is menu, header, footer, sidebar, notice, advert, form or comments; ``inside``: within an article."""
    name, _, marks = element.partition(".")
    if name in CHROME and not (inside and name == "header"):
        return True
    if not _chrome_words(marks):
        return False
    # an article's own header holds its title; a marked page body is not chrome as a whole
    return not (MAIN_WORDS & _words(marks) and (name in ("article", "main", "body") or inside and "header" in _words(marks)))


def is_chrome(path: tuple[str, ...]) -> bool:
    """Whether a slot is chrome by its path."""
    inside = False
    for element in path:
        if _chrome(element, inside):
            return True
        inside = inside or element.partition(".")[0] in ARTICLES
    return False


def in_article(path: tuple[str, ...]) -> bool | None:
    """Whether a slot lies within an article by its path; None for chrome."""
    return None if is_chrome(path) else any(e.partition(".")[0] == "article" for e in path)


def host_of(column: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(column, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON, expression, pages) from all pages (url, html); pages without a host share the empty host.

    Equal streams of a host are counted first, in each task and then by key. The distinct ones are aligned FOLD at a time, in a
    fixed order, and so is what comes of them, until a host has one: no host waits for one task, however many it has.
    """
    spark = pages.sparkSession
    small_batches(spark)
    schema = "host string, stream string, n long"
    target = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if page:
                    key = host, json.dumps(tree(stream(page)[0]))
                    seen[key] = seen.get(key, 0) + 1
            rows = [(h, s, n) for (h, s), n in seen.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["n", "stream"], ascending=[False, True])
        whole: list = []
        for i, s in enumerate(f["stream"]):
            whole = json.loads(s) if not i else align(whole, json.loads(s))
        return pd.DataFrame({"host": [f["host"].iloc[0]], "stream": [json.dumps(whole)], "n": [int(f["n"].sum())]})

    counted = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(run, schema)
    rows = table(counted.groupBy("host", "stream").agg(F.sum("n").alias("n")), "streams")
    while True:
        sizes = rows.groupBy("host").agg(F.count("*").alias("size"))  # one row a host
        most = sizes.agg(F.max("size")).first()[0] or 0
        parts = rows.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("stream"), F.ceil(F.col("size") / FOLD)))
        rows = parts.groupBy("host", "part").applyInPandas(fold, schema)
        if most <= FOLD:
            return rows
        rows = table(rows, "parts")


def _plain(pieces: list[str]) -> str:
    return _SPACE.sub(" ", html.unescape("".join(pieces))).strip()


def _mark(slot: int, text: str) -> int:
    """A number for a text in a slot of its host's wrapper."""
    return int.from_bytes(hashlib.blake2b(f"{slot} {text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def slot_texts(page: str, parser: Parser) -> list[tuple[int, str]]:
    """(slot, text) of the page's texts that may be template: those that are neither chrome nor in an article by their path."""
    tokens, texts = stream(page)
    states = parser.parse(tokens) or []
    slots = [s for s, t in zip(states, tokens) if t == "#"]
    return [(s, text) for s, pieces in zip(slots, texts) if parser.articles[s] is False and (text := _plain(pieces))]


def templates(joined: DataFrame) -> DataFrame:
    """(host, texts): the marks of each host's template texts, from all rows (host, html, wrapper).

    Pages with the same texts in the same slots count once, so that copies of a page don't make its content a template.
    """
    spark = joined.sparkSession
    small_batches(spark)
    schema = "host string, page long, slots array<int>, texts array<long>"

    def start():
        known: dict[str, Parser] = {}

        def one(host, page, wrapper):
            if not page or not wrapper:
                return None
            if host not in known:
                if len(known) > 2000:
                    known.clear()
                known[host] = Parser(json.loads(wrapper))
            found = sorted(set(slot_texts(page, known[host])))
            if not found:
                return None
            marks = [_mark(*f) for f in found]
            # a row without a text for each slot counts the pages that have it
            slots = sorted({s for s, _ in found})
            return host, _mark(len(marks), str(marks)), [s for s, _ in found] + slots, marks + [None] * len(slots)

        return one

    seen = map_rows(joined.select("host", "html", "wrapper"), start, schema).groupBy("host", "page").agg(F.first("slots").alias("slots"), F.first("texts").alias("texts"))
    each = table(seen.select("host", F.inline(F.arrays_zip("slots", "texts"))).groupBy("host", "slots", "texts").agg(F.count(F.lit(1)).alias("n")), "texts")
    counts = each.where(F.col("texts").isNull()).select("host", "slots", F.col("n").alias("pages"))
    common = each.where(F.col("texts").isNotNull() & (F.col("n") >= TEMPLATE_PAGES)).join(counts, ["host", "slots"]).where(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    return common.groupBy("host").agg(F.collect_list("texts").alias("texts"))  # what is on half of the pages: a few times a page's texts


def _with_wrapper(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """``rows`` (page_id, url, host, html) with what was learned of their host (one row a host, n its pages).

    It is broadcast up to BROADCAST_BYTES; beyond, a host of many pages has a copy for each HOST_PAGES of them, so its pages meet in many tasks.
    """
    size = F.length("wrapper") + (8 * F.greatest(F.size("texts"), F.lit(0)) if "texts" in learned.columns else F.lit(0))
    if (learned.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(learned), "host", "left")
    copies = (F.floor(F.col("n") / HOST_PAGES) + 1).cast("long")
    large = learned.where(F.col("n") >= HOST_PAGES).select("host", copies.alias("copies"))  # a row for each HOST_PAGES pages at most
    salt = F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.coalesce("copies", F.lit(1).cast("long")))
    dealt = learned.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("n").hint("merge")
    return rows.join(large, "host", "left").withColumn("salt", salt).drop("copies").join(dealt, ["host", "salt"], "left").drop("salt")


def extract(pages: DataFrame) -> DataFrame:
    """For each row of ``pages``: page_id, url, host, text (main text; empty if none), n_chars (its code points), fits (whether the wrapper parsed it).

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page
    order by one space. Chrome and the host's template texts are left out; nothing else is dropped or capped. Null html: empty text. A null url or one without a host
    uses the wrapper of all such pages. A page that its host's wrapper doesn't fit is read by its own stream. Repeated rows
    repeat; other columns are ignored; an empty table gives no rows.
    """
    learned = table(wrappers(pages).select("host", F.col("stream").alias("wrapper"), "n"), "wrappers")
    rows = pages.select(F.col("page_id").cast("long"), "url", host_of(F.col("url")).alias("host"), F.col("html").cast("string"))
    learned = table(learned.join(templates(_with_wrapper(rows, learned)), "host", "left"), "templates")  # one row a host
    joined = _with_wrapper(rows, learned).select("page_id", "url", "host", "html", "wrapper", "texts")

    def start():
        known: dict[str, tuple[Parser, frozenset]] = {}

        def one(page_id, url, host, page, wrapper, texts):
            if not page or not wrapper:
                return page_id, url, host, "", 0, bool(wrapper)
            if host not in known:
                if len(known) > 2000:
                    known.clear()
                known[host] = Parser(json.loads(wrapper)), frozenset(texts or ())
            text, fits = main_text(page, *known[host])
            return page_id, url, host, text, len(text), fits

        return one

    return map_rows(joined, start, "page_id long, url string, host string, text string, n_chars long, fits boolean")


def main_text(page: str, parser: Parser, template: frozenset = frozenset()) -> tuple[str, bool]:
    """(text, whether the wrapper fits the page); ``template`` has the marks of the host's template texts.

    A template text that labels data, such as a heading with data next to it in the same element, stays.
    """
    tokens, texts = stream(page)
    states = parser.parse(tokens)
    fits = states is not None
    if states is None:
        parser = Parser(tree(tokens))
        states = parser.parse(tokens)
        template = frozenset()
    kept: list[str] = []
    after: tuple[str, ...] | None = None  # path of the text that follows, if that is kept
    for state, pieces in zip(reversed([s for s, t in zip(states, tokens) if t == "#"]), reversed(texts)):
        article, path = parser.articles[state], parser.paths[state]
        text = _plain(pieces)
        if article is None or not text:
            continue
        if not article and template and _mark(state, text) in template:
            if after is None or not path or path[-1].partition(".")[0] not in LABELS or after[: len(path) - 1] != path[:-1]:
                after = None
                continue
        after = path
        kept.append(text)
    return " ".join(reversed(kept)), fits
