"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a stream of tags and texts. Tandem repeats in a stream become repeated groups; the streams of one
host are then aligned one after another with the host's wrapper so far, and where they differ, the differing
part becomes an optional group, or a repeated one if it is a repeat of its neighbour. Texts are slots. So a wrapper
accepts every page it was made from; what grows too long of optional parts is generalised to a repeated group of
optional items.

A page's text is what its host's wrapper has in the slots of main text. Every page of the host votes on the place of
each slot by the elements that are open there, and the wrapper knows whether a slot's text is the same on all of them: outside
articles such slots are boilerplate. Where the votes of a slot are divided, or a page has no wrapper, its own elements decide.

Pages give their streams with repeats folded, so a host of any size sends each different stream once, and streams meet in
a tree of alignments with a bounded number for each task. Nothing depends on time, and no page is too long.
"""

from __future__ import annotations

import bisect
import difflib
import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm.frames import Scratch, batch, ddl, prepare, read

#: Tokens of the longest repeat that is folded.
REPEAT = 24
#: Tokens from which on a wrapper's optional parts are generalised.
LONGEST = 4000
#: Streams, or wrappers, of a host that one step of the tree aligns.
FAN = 128
#: Stretches of this many pairs of items are compared item by item; longer ones are first cut where WIDTHS items in a row occur once in both.
PAIRS, WIDTHS = 10_000, (8, 4, 2, 1)
#: Pages of a host from which on a text that is the same in all of them is constant, and the share of a slot's votes that settles its place.
SAME, SETTLED = 3, 0.9

# Elements and class names of what is not main text, and elements inside a line.
OUTSIDE = set("nav header footer aside form script style noscript template iframe svg canvas object button select textarea menu dialog head title".split())
OUTSIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OUTSIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer cookie cookies consent gdpr notice notices newsletter subscribe subscription signup popup modal overlay comment comments "
    "commentlist reply replies respond disqus share sharing social related recommended toolbar pagination pager widget".split()
)
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<",
    re.S,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+")
_RAW_END = {n: re.compile(rf"</{n}\s*[^>]*>", re.I) for n in RAW}
TEXT = "#"


@lru_cache(100_000)
def _signature(name: str, rest: str) -> str:
    """A start tag's name, with ! if its role puts it outside the main text, and * if a word of its class or id speaks for that."""
    mark = ""
    if "=" in rest:
        for key, value in _NAMED.findall(rest):
            words = _PART.findall(value.lower())
            if key.lower() == "role":
                if OUTSIDE_ROLES.intersection(words):
                    return f"<{name}!"
            elif OUTSIDE_NAMES.intersection(words):
                mark = "*"
    return f"<{name}{mark}"


def tokens(page: str) -> tuple[list[str], list[str]]:
    """(stream, texts): tags as <name, <name*, <name! or </name and texts as #, and the raw text of each #."""
    stream: list[str] = []
    texts: list[str] = []
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name:
            name, close, rest = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
            if close:
                stream.append("</" + name)
                continue
            stream.append(_signature(name, rest))
            if name in _RAW_END and not rest.endswith("/"):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else n
                stream.append("</" + name)
        elif (c := m[0])[0] != "<" or c == "<":
            if stream and stream[-1] == TEXT:
                texts[-1] += c
            else:
                stream.append(TEXT)
                texts.append(c)
    return stream, texts


def fold(stream: list) -> list:
    """A stream with tandem repeats as groups ("+", items); one pass, each token held against the REPEAT before it."""
    out: list = []
    for x in stream:
        out.append(x)
        while _fold_end(out):
            pass
    return out


def _fold_end(out: list) -> bool:
    """Folds a repeat at the end of out, if there is one."""
    n, last = len(out), out[-1]
    for size in range(1, min(REPEAT, n - 1) + 1):
        before = out[n - size - 1]
        if not isinstance(before, str) and before[0] == "+" and len(before[1]) == size and before[1][-1] == last and list(before[1]) == out[n - size :]:
            del out[n - size :]  # one more turn of the group in front
            return True
        if before == last and 2 * size <= n and out[n - 2 * size : n - size] == out[n - size :]:
            unit = tuple(out[n - size :])
            out[n - 2 * size :] = [unit[0] if size == 1 and unit[0][0] == "+" else ("+", unit)]
            return True
    return False


def _generalise(a: list, b: list) -> list:
    """b with stretches that equal the inside of a's groups replaced by these groups."""
    starts: dict = {}
    have = {x for x in b if not isinstance(x, str)}
    for group in sorted({x for x in a if not isinstance(x, str) and x[0] != "*"}, key=lambda x: (-len(x[1]), repr(x))):
        if group[0] == "+" or group not in have:
            starts.setdefault(group[1][0], []).append((group, list(group[1])))
    if not starts:
        return b
    out: list = []
    k = 0
    while k < len(b):
        for group, unit in starts.get(b[k], ()):
            if b[k : k + len(unit)] == unit:
                if not (out and out[-1] == group and group[0] == "+"):
                    out.append(group)
                k += len(unit)
                break
        else:
            out.append(b[k])
            k += 1
    return out


def _optional(items: list) -> list:
    if not items:
        return []
    if all(not isinstance(x, str) and x[0] in "?*" for x in items):
        return items
    return [("?", tuple(items))]


def _anchors(a: list[int], b: list[int], width: int) -> list[tuple[int, int]]:
    """Places in a and b of `width` items in a row that occur once in both, ascending in both."""

    def once(x: list[int]) -> dict:
        at: dict = {}
        for k in range(len(x) - width + 1):
            key = tuple(x[k : k + width])
            at[key] = -1 if key in at else k
        return {key: k for key, k in at.items() if k >= 0}

    other = once(b)
    pairs = [(k, other[key]) for key, k in once(a).items() if key in other]
    # the longest ascending run of places in b
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tails, j)
        back[n] = ends[k - 1] if k else -1
        tails[k : k + 1], ends[k : k + 1] = [j], [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Ascending pairs of places of equal items in a and b."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= PAIRS:
            for i, j, n in difflib.SequenceMatcher(None, a[a0:a1], b[b0:b1], autojunk=False).get_matching_blocks():
                out += [(a0 + i + k, b0 + j + k) for k in range(n)]
            continue
        for width in WIDTHS:
            if found := _anchors(a[a0:a1], b[b0:b1], width):
                i0, j0 = a0, b0
                for i, j in found:
                    if a0 + i >= i0 and b0 + j >= j0:
                        todo.append((i0, a0 + i, j0, b0 + j))
                        out.append((a0 + i, b0 + j))
                        i0, j0 = a0 + i + 1, b0 + j + 1
                todo.append((i0, a1, j0, b1))
                break
    return sorted(out)


def _length(items) -> int:
    return sum(1 if isinstance(x, str) else _length(x[1]) for x in items)


def _symbols(items) -> set[str]:
    return {s for x in items for s in ([x] if isinstance(x, str) else _symbols(x[1]))}


def _shorter(items: list, most: int) -> list:
    """items, if longer than most, with each stretch of groups as ("*", symbols): a repeated group of these, all optional.

    If that is not enough, everything becomes one such group. Either way no less is accepted.
    """
    if _length(items) <= most:
        return items
    out, held = [], []
    for x in [*items, ""]:
        if isinstance(x, str):
            if held:
                out.append(("*", tuple(sorted(_symbols(held)))))
                held = []
            out += [x] if x else []
        else:
            held.append(x)
    many = sum(len(x[1]) for x in out if not isinstance(x, str))
    return out if many <= 4 * most else [("*", tuple(sorted(_symbols(items))))]


def align(a: list, b: list, most: int | None = None) -> list:
    """One expression for what two accept: common items stay, the others become optional groups."""
    if a == b:
        return a
    a, b = _generalise(b, a), _generalise(a, b)
    code: dict = {}
    pairs = _common([code.setdefault(x, len(code)) for x in a], [code.setdefault(x, len(code)) for x in b])
    out: list = []
    i0 = j0 = 0
    for i, j in [*pairs, (len(a), len(b))]:
        out += _optional(a[i0:i]) + _optional(b[j0:j]) + a[i : i + 1]
        i0, j0 = i + 1, j + 1
    out = [x for k, x in enumerate(out) if not k or x != out[k - 1] or isinstance(x, str)]
    return _shorter(out, LONGEST if most is None else most)


def _load(text: str) -> list:
    def back(x):
        return x if isinstance(x, str) else (x[0], tuple(back(y) for y in x[1]))

    return [back(x) for x in json.loads(text)]


class Wrapper:
    """A wrapper compiled to steps: take a symbol (a text with its slot), take any of some, go one of two ways, or end."""

    def __init__(self, items: list):
        self.steps: list[tuple] = []
        self.open: list[tuple[str, int]] = []
        self.place: list[str] = []
        self._build(items)
        self.steps.append(("end",))

    def _slot(self) -> int:
        self.place.append(kind(self.open))
        return len(self.place) - 1

    def _build(self, items) -> None:
        for x in items:
            if x == TEXT:
                self.steps.append(("take", x, self._slot()))
            elif isinstance(x, str):
                step(self.open, x)
                self.steps.append(("take", x, -1))
            elif x[0] == "*":
                self.steps.append(("any", frozenset(x[1]), self._slot() if TEXT in x[1] else -1))
            else:
                at, depth = len(self.steps), list(self.open)
                if x[0] == "?":
                    self.steps.append(())
                self._build(x[1])
                end = len(self.steps)
                if x[0] == "?":
                    self.open = depth  # what an optional group leaves open or closes is not certain
                    self.steps[at] = ("or", at + 1, end)
                else:
                    self.steps.append(("or", at, end + 1))

    def kinds(self, stream: list[str]) -> list[str] | None:
        """The kind of each text of a stream, by what the wrapper itself has open at its slot; None if not accepted."""
        slots = self.slots(stream)
        return None if slots is None else [self.place[k] for k in slots]

    def slots(self, stream: list[str]) -> list[int] | None:
        """The number of each text's slot; None if not accepted. No step is tried twice at one place."""
        n, steps = len(stream), self.steps
        slot_at = [0] * n
        seen: set[int] = set()
        width, todo = n + 1, [(0, 0)]
        while todo:
            at, k = todo.pop()
            while True:
                key = at * width + k
                if key in seen:
                    break
                seen.add(key)
                move = steps[at]
                what = move[0]
                if what == "take":
                    if k == n or stream[k] != move[1]:
                        break
                    slot_at[k] = move[2]
                    at, k = at + 1, k + 1
                elif what == "or":
                    todo.append((move[2], k))
                    at = move[1]
                elif what == "any":
                    if k < n and stream[k] in move[1]:
                        todo.append((at + 1, k))
                        slot_at[k] = move[2]
                        k += 1
                    else:
                        at += 1
                elif k == n:
                    return [s for s, x in zip(slot_at, stream, strict=True) if x == TEXT]
                else:
                    break
        return None


def kind(opened: list[tuple[str, int]]) -> str:
    """What the open elements make of a text.

    a: in an article. c, d: in an article that is marked by a word, or in an element so marked; c inside main, d outside it.
    e, b: in no article and no marked element; e inside main, b outside it. m: in no article, but in a marked element.
    n: in an element that is not main text by its name or role, or by a word and inside an article.
    """
    article, marked, main = -1, [], False
    for k, (name, out) in enumerate(opened):
        if out == 2:
            return "n"
        if name == "article":
            article = k
        if out:
            marked.append(k)
        main |= name == "main"
    if article < 0:
        return "m" if marked else "e" if main else "b"
    if marked and marked[-1] > article:
        return "n"
    return "a" if not marked else "c" if main else "d"


def step(opened: list[tuple[str, int]], tag: str) -> bool:
    """Changes the open elements by a tag; a closing tag also closes what is still open inside. False: that, or nothing to close, matters to kinds."""
    if tag.startswith("</"):
        name = tag[2:]
        for k in range(len(opened) - 1, -1, -1):
            if opened[k][0] == name:
                inside = opened[k + 1 :]
                del opened[k:]
                return not _matter(inside)
        return name != "article" and name not in OUTSIDE
    name = tag[1:].rstrip("*!")
    out = 2 if name in OUTSIDE else 0 if name in ("main", "body", "html") else 2 if tag.endswith("!") else int(tag.endswith("*"))
    if opened and opened[-1][0] in ("p", "li") and (name == opened[-1][0] or opened[-1][0] == "p" and name not in INLINE):
        opened.pop()  # their end tags may be left out
    if name not in VOID and (out or name in ("article", "div", "section", "ul", "ol", "table", "main", "body")):
        opened.append((name, out))
    return True


def _matter(opened: list[tuple[str, int]]) -> bool:
    return any((out or name == "article") and name not in ("p", "li") for name, out in opened)


def direct(stream: list[str]) -> tuple[list[str], bool]:
    """The kinds of a stream's texts by its own open elements, and whether each of these that matters is opened and closed."""
    opened: list[tuple[str, int]] = []
    out, closed = [], True
    for x in stream:
        if x == TEXT:
            out.append(kind(opened))
        else:
            closed &= step(opened, x)
    return out, closed and not _matter(opened)


def direct_kinds(stream: list[str]) -> list[str]:
    """The kinds of a stream's texts by its own open elements."""
    return direct(stream)[0]


def choose(there: set[str]) -> str:
    """The kinds that are main text, of those that have text: the first of articles, the body, and marked elements that has any."""
    return next((kinds for kinds in ("a", "c", "eb", "d", "b", "m") if kinds[0] in there), "")


def main_text(stream: list[str], texts: list[str], kinds: list[str], constant: list[bool] | None = None) -> str:
    """The texts of the article, or of the body where no article has text, as blocks joined by one space.

    constant: the texts whose slots the host fills with the same text everywhere. Outside articles these are
    boilerplate: kinds that have no other text give way to longer ones that have, and of the kinds taken only what varies
    stays, unless that is next to nothing.
    """
    plain = [html.unescape(t) for t in texts]
    size = [len(t.strip()) for t in plain]
    constant = constant or [False] * len(texts)
    total = lambda kind, fixed: sum(n for k, n, c in zip(kinds, size, constant, strict=True) if k in kind and c in fixed)
    want, drop = choose({k for k, n in zip(kinds, size, strict=True) if n}), False
    if want != "a" and any(constant):
        varied = choose({k for k, n, c in zip(kinds, size, constant, strict=True) if n and not c})
        if total(varied, (False, True)) > total(want, (False, True)):
            want = varied
        drop = 4 * total(want, (False,)) >= total(want, (True,))
    out, k = [], 0
    for x in stream:
        if x == TEXT:
            if kinds[k] in want and not (drop and constant[k]):
                out.append(plain[k])
            k += 1
        elif x.lstrip("</").rstrip("*!") not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


_SHAPES = {"host": pa.string(), "shape": pa.string()}


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different folded streams of a task, each once for a host as far as the bounded memory goes."""
    seen: set = set()
    known: dict[tuple, str] = {}
    for b in batches:
        rows = []
        for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
            stream = tuple(tokens(page or "")[0])
            shape = known.get(stream)
            if shape is None:
                shape = json.dumps(fold(list(stream)), separators=(",", ":"))
                if len(known) < 4096:
                    known[stream] = shape
            row = (host_of(url), shape)
            if row not in seen:
                rows.append(row)
                if len(seen) < 1 << 16:
                    seen.add(row)
        yield batch(_SHAPES, host=[h for h, _ in rows], shape=[s for _, s in rows])


_WRAPPED = {"host": pa.string(), "h": pa.int64(), "part": pa.int64(), "parts": pa.int64(), "wrapper": pa.string()}


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host and part, from rows sorted by these; holds one part's wrappers at a time."""
    now: tuple | None = None
    wrappers: dict[str, tuple[list, int]] = {}  # h is a hash; hosts that share one stay apart

    def done() -> pa.RecordBatch:
        n = len(wrappers)
        return batch(_WRAPPED, host=list(wrappers), h=[now[0]] * n, part=[now[1]] * n, parts=[p for _, p in wrappers.values()], wrapper=[json.dumps(w, separators=(",", ":")) for w, _ in wrappers.values()])

    for b in batches:
        for host, h, part, parts, text in zip(*(b.column(c).to_pylist() for c in _WRAPPED), strict=True):
            if (h, part) != now:
                if wrappers:
                    yield done()
                now, wrappers = (h, part), {}
            new = _load(text)
            wrappers[host] = (align(wrappers[host][0], new) if host in wrappers else new, parts)
    if wrappers:
        yield done()


def infer_wrappers(s: Scratch, pages: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, wrapper), from every page of the host: a tree of alignments, each of about `fan` streams or wrappers."""
    shapes = s.save(pages.select("url", "html").mapInArrow(_shapes, ddl(_SHAPES)).distinct().withColumn("h", F.xxhash64("host")))
    parts = shapes.groupBy("h").agg(F.ceil(F.count("*") / fan).alias("parts"))
    now = shapes.join(parts, "h").select("host", "h", F.pmod(F.xxhash64("shape"), "parts").alias("part"), "parts", F.col("shape").alias("wrapper"))
    while True:
        dealt = now.repartition("h", "part").sortWithinPartitions("h", "part", "wrapper")
        done = s.save(dealt.mapInArrow(_align, ddl(_WRAPPED)), narrow=True)
        if (done.agg(F.max("parts")).first()[0] or 1) <= 1:
            return done.select("host", "wrapper")
        fewer = F.ceil(F.col("parts") / fan)
        now = done.select("host", "h", F.pmod("part", fewer).alias("part"), fewer.alias("parts"), "wrapper")


class _Wrappers:
    """The compiled wrappers of a task, and what they and a page's own elements make of its streams."""

    def __init__(self):
        self.compiled: dict[str, Wrapper | None] = {}
        self.known: dict[tuple, tuple] = {}

    def read(self, stream: list[str], text: str | None) -> tuple[list[int] | None, list[str], bool]:
        """(slots, or None if not accepted; kinds by the page's own elements; whether these close)."""
        key = (tuple(stream), text)
        if key not in self.known:
            if text is not None and text not in self.compiled:
                if len(self.compiled) > 4096:
                    self.compiled.clear()
                self.compiled[text] = Wrapper(_load(text))
            w = self.compiled.get(text)
            got = (w.slots(stream) if w else None, *direct(stream))
            if len(self.known) >= 4096:
                return got
            self.known[key] = got
        return self.known[key]


_PLACES = {"host": pa.string(), "slot": pa.int64(), "kind": pa.string(), "n": pa.int64(), "low": pa.int64(), "high": pa.int64()}


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's pages put into the slots of their hosts: pages by kind (none where elements do not close), least and largest hash of what a page says there."""
    wrappers = _Wrappers()
    held: dict[tuple, list[int]] = {}

    def done() -> pa.RecordBatch:
        h, s, k = zip(*held, strict=True)
        n, low, high = zip(*held.values(), strict=True)
        return batch(_PLACES, host=list(h), slot=list(s), kind=list(k), n=list(n), low=list(low), high=list(high))

    for b in batches:
        for host, page, text in zip(*(b.column(c).to_pylist() for c in ("_host", "html", "_wrapper")), strict=True):
            stream, texts = tokens(page or "")
            slots, kinds, closed = wrappers.read(stream, text)
            there: dict[int, tuple[list[str], set[str]]] = {}
            for slot, k, t in zip(slots or [], kinds, texts, strict=bool(slots)):
                if words := t.split():
                    said, places = there.setdefault(slot, ([], set()))
                    said.append(" ".join(words))
                    places.add(k)
            for slot, (said, places) in there.items():  # a repeated slot holds all that its turns say
                x = int.from_bytes(hashlib.blake2b("\n".join(said).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                for k in places if closed else (None,):
                    row = held.setdefault((host, slot, k), [0, x, x])
                    row[0], row[1], row[2] = row[0] + 1, min(row[1], x), max(row[2], x)
        if len(held) > 1 << 16:
            yield done()
            held.clear()
    if held:
        yield done()


def slot_places(s: Scratch, joined: DataFrame) -> DataFrame:
    """(host, places) over all pages of a host: for each slot its number, settled kind (? if votes are divided) and = if it is constant."""
    seen = joined.where("_host is not null").select("_host", "html", "_wrapper").mapInArrow(_places, ddl(_PLACES))
    kinds = seen.groupBy("host", "slot", "kind").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    votes = F.sum(F.when(F.col("kind").isNotNull(), F.col("n")))
    first = F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind")))
    settled = F.when(first["n"] >= SETTLED * votes, first["kind"]).otherwise("?")
    same = (F.min("low") == F.max("high")) & (F.sum("n") >= SAME)
    slots = kinds.groupBy("host", "slot").agg(F.concat(F.col("slot").cast("string"), settled, F.when(same, "=").otherwise("")).alias("place"))
    return s.save(slots.groupBy("host").agg(F.array_join(F.collect_list("place"), " ").alias("places")), narrow=True)


def _read_places(text: str | None) -> dict[int, tuple[str, bool]]:
    out = {}
    for x in (text or "").split():
        place = x.rstrip("=")
        out[int(place[:-1])] = (place[-1], x != place)
    return out


def _extract(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers = _Wrappers()
        known: dict[str | None, dict] = {}
        for b in batches:
            out, by_host = [], []
            for page, text, where in zip(*(b.column(c).to_pylist() for c in ("html", "_wrapper", "_places")), strict=True):
                stream, texts = tokens(page or "")
                slots, kinds, _ = wrappers.read(stream, text)
                constant = None
                if slots is not None:
                    if where not in known:
                        if len(known) > 4096:
                            known.clear()
                        known[where] = _read_places(where)
                    places = [known[where].get(k, ("?", False)) for k in slots]
                    constant = [c for _, c in places]
                    kinds = [own if p == "?" else p for (p, _), own in zip(places, kinds, strict=True)]
                by_host.append(slots is not None)
                out.append(main_text(stream, texts, kinds, constant))
            new = {"text": pa.array(out, pa.string()), "by_host": pa.array(by_host)}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c) for c in names], names=names)

    return run


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, by_host) for each row of pages (page_id, url, html).

    text is the main text: what the host's wrapper has in slots whose place is an article, or the body where none of them
    has text, outside menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments. A word of a class
    or id alone puts no article outside and nothing that encloses one; what it marks is used where nothing else has text.
    White space inside a block becomes one space and blocks are joined by one. by_host: the wrapper accepted the page, as it does
    with every page it was inferred from. A null or empty html has an empty text; a url without a host shares the
    wrapper of the empty host; a page of any length is aligned and extracted as a whole. Repeated pages vote each time
    and give equal results; other columns are left out; an empty table gives an empty one.
    """
    prepare(spark)
    s = Scratch(spark)
    some = pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string"))
    wrappers = infer_wrappers(s, some).select(F.col("host").alias("_host"), F.col("wrapper").alias("_wrapper"))
    host = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1), "^.*@", ""))
    keyed = some.withColumn("_key", host)
    places = slot_places(s, keyed.join(wrappers, F.col("_key") == F.col("_host")))
    # written, so that its size is known and a small table is broadcast
    both = s.save(wrappers.join(places.select(F.col("host").alias("_host"), F.col("places").alias("_places")), "_host", "left"), narrow=True)
    joined = keyed.join(both, F.col("_key") == F.col("_host"), "left").drop("_key", "_host")
    kind = pages.schema["page_id"].dataType.simpleString()
    names = ["page_id", "url", "text", "by_host"]
    return joined.mapInArrow(_extract(names), f"page_id {kind}, url string, text string, by_host boolean")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(spark, read(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "by_host")


#: For pages whose main text is in closed article elements, as that of all test tables is: by expressions, without wrappers.
#: These names of characters count without their semicolon too, as the HTML standard has it.
#: `by_host` is what extract() promises, that a host's wrapper accepts every page that it was inferred from.
OP7_SQL = r"""
WITH bodies AS (
  SELECT page_id, url, array_to_string(
    regexp_extract_all(coalesce(html, ''), '(?is)<article\b[^>]*>(.*?)</article\s*>', 1), ' ') AS body
  FROM pages),
bare AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(body,
      '(?is)<!--.*?-->', '', 'g'),
      '(?is)<(script|style|form|nav|header|footer|aside)\b[^>]*>.*?</(script|style|form|nav|header|footer|aside)\s*>', ' ', 'g'),
      '(?i)</?(a|b|i|u|em|strong|span|small|sub|sup|code)(\s[^>]*)?>', '', 'g'),
      '<[^>]*>', ' ', 'g') AS text
  FROM bodies),
plain AS (
  SELECT page_id, url, trim(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
      '&quot;?', '"', 'g'),
      '&middot;?', '·', 'g'),
      '&copy;?', '©', 'g'),
      '&lt;?', '<', 'g'),
      '&gt;?', '>', 'g'),
      '&nbsp;?', ' ', 'g'),
      '&amp;?', '&', 'g'),
    '\s+', ' ', 'g')) AS text
  FROM bare)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars, true AS by_host FROM plain
"""
