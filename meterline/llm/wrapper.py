"""Main text of web pages by wrapper induction.

The pages of a host are folded into one template tree: simple tree matching (Yang, 1991) aligns a
page's elements with the template's, elements that match add to its counts and others are inserted
where they stand.  Long lists of elements are first aligned at those that both sides have once, with the
same text.  Neighbours of the same kind (tag, role and class, digits aside) count as one
repeated slot.  An element whose text never changes is constant and belongs to the template,
whatever its tag or class; the others are slots whose content is the page's own.  Tasks fold their
pages, partial templates are merged with the same matching, in three steps by ever fewer salts of a
host, so that a large host is spread.  Slots are counted as in lossy counting (Manku and Motwani, 2002):
every ten pages those go that fewer than one page in ten since they came may have had, so a template
holds what a share of pages has, however many slots a page has, and in whatever order pages come.
Templates look 60 levels deep; an element at that depth is compared whole.

Of the page's own content, the text is that of the `article` elements, else `main`, else the body,
without menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments that change
from page to page: no alignment tells these from an article, so tag, role and class words do.  Within
`article` and `main` headings, paragraphs, items and cells stay although they are constant, and so do
constant elements that hold some, unless links make up half of their text.
Constancy counts only with `least_pages` pages, in most of which the text differs: a host of copies
has no template.  A repeated slot is never constant in part, so a paragraph shared by pages stays.

Blocks are joined by a blank line in page order; character references are decoded; white space in
a block becomes one space.  Null and empty pages have an empty text; unclosed and cut markup is
read as far as it goes; pages without a host share one; repeated rows are treated alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from heapq import merge

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialise, steps
from .url_filter import host

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Nesting to which templates look into pages; deeper elements are compared whole.
_DEEPEST = 60
#: Pairs of elements that are compared with each other; lists of more are cut at anchors first.
_PAIRS = 1 << 14
#: Pages after which slots that few have go.
_BUCKET = 10

# Elements of HTML and what they are for.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCKS - {"body", "head", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
_ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_CONTAINERS = frozenset("html body main article section div header footer aside nav form table tbody thead tfoot tr ul ol dl menu fieldset figure center details".split())
_NEVER = frozenset("head title script style noscript template textarea nav aside footer form button select option svg iframe object canvas dialog menu input label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist"
    " consent cookie cookies disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice"
    " notices overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar"
    " signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
# those that also tell an element's purpose as the first part of a compound
_FIRST = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs consent cookie cookies disqus gdpr nav navbar newsletter pagination promo sidebar social sponsor sponsored topbar widget".split())
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre figcaption caption td th".split())


class Element:
    __slots__ = ("tag", "named", "kids", "kind")

    def __init__(self, tag: str, named: str = ""):
        self.tag, self.named = tag, named
        self.kids: list[Element | str] = []
        # pages number their elements, so neither ids nor digits part them
        self.kind = f"{tag} {re.sub('[0-9]+', '#', re.sub('(^| )id=.*?(?= role=| class=|$)', '', named))}" if named else tag


class _Scanner:
    """Finds the ends of tags; each missing character is looked for once, so a page takes time in
    proportion to its length."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, mark: str, at: int) -> int:
        if mark in self.missing:
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self.missing.add(mark)
        return found

    def end(self, at: int) -> int:
        """Where the tag that is open at `at` has its `>`, outside quotes if these are closed."""
        start = at
        while stop := _STOP.search(self.page, at):
            if stop[0] == ">":
                return stop.start()
            closed = self.find(stop[0], stop.end())
            if closed < 0:
                break
            at = closed + 1
        return self.find(">", start)


class _Stack:
    """The open elements, and where each tag's are."""

    def __init__(self, root: Element):
        self.open, self.at = [root], {root.tag: [0]}

    def last(self, tags: Iterable[str]) -> int:
        """The innermost place of one of `tags`, the root left out; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def put(self, element: Element) -> None:
        self.at.setdefault(element.tag, []).append(len(self.open))
        self.open.append(element)

    def close(self, at: int) -> None:
        while len(self.open) > at:
            self.at[self.open.pop().tag].pop()


def parse(page: str) -> Element:
    """The page's element tree: unclosed elements end with their parents, stray end tags are ignored."""
    root, scanner, at = Element("html"), _Scanner(page), 0
    stack = _Stack(root)
    while at < len(page):
        start = at
        begin = page.find("<", at)
        while begin >= 0 and not (begin + 1 < len(page) and (page[begin + 1] in "!?/" or page[begin + 1].isascii() and page[begin + 1].isalpha())):
            begin = page.find("<", begin + 1)  # a bare < is text
        if begin != start:
            stack.open[-1].kids.append(page[start : begin if begin >= 0 else len(page)])
        if begin < 0:
            break
        if page.startswith("<!--", begin):
            close = page.find("-->", begin + 4)
            at = close + 3 if close >= 0 else len(page)
            continue
        name = _NAME.match(page, begin + 1)
        close = scanner.end(name.end()) if name else scanner.find(">", begin)
        if close < 0:
            break  # a tag that the end of the page cuts
        at = close + 1
        if not name:
            continue
        tag = name[2].lower()
        if name[1]:
            if found := stack.last((tag,)):
                stack.close(found)
            continue
        if tag in ("html", "body") and stack.at.get(tag):
            continue
        if tag in _ENDS_P and (found := stack.last(("p",))) > stack.last(("table", "button")):
            stack.close(found)
        if tag in _ENDS_SAME and (found := stack.last(_ENDS_SAME[tag])) > stack.last(_SCOPE[tag]):
            stack.close(found)
        attributes = page[name.end() : close]
        named = " ".join(sorted(f"{k.lower()}={(a or b or c).lower()}" for k, a, b, c in _NAMED.findall(attributes))) if "=" in attributes else ""
        element = Element(tag, named)
        stack.open[-1].kids.append(element)
        if tag in _VOID or attributes.endswith("/"):
            continue
        if tag in _RAW:
            ended = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            element.kids.append(page[at : ended.start() if ended else len(page)])
            close = scanner.find(">", ended.end()) if ended else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        stack.put(element)
    return root


def _is_boilerplate(e: Element, inside: bool) -> bool:
    """Whether an element is no content by its tag, role, id or class; `inside`: of an article."""
    if e.tag in _NEVER or e.tag == "header" and not inside:
        return True
    if e.tag in ("html", "body", "main", "article") and not inside or not e.named:
        return False
    for item in re.findall(r"(\w+)=([^=]*)(?= \w+=|$)", e.named):
        if item[0] == "role":
            if set(item[1].split()) & _ROLES:
                return True
        elif any(map(_purpose, item[1].split())):
            return True
    return False


def _purpose(name: str) -> bool:
    """Whether an id or a class, whole or by its last part (of some words by the first), names a thing
    beside the text."""
    parts = re.findall(r"[a-z]+", name)
    return bool(parts) and ("".join(parts) in _WORDS or parts[-1] in _WORDS or parts[0] in _FIRST)


def _is_prose(e: Element) -> bool:
    """Whether an element is, or has inside, a heading, paragraph, item or cell, and links and buttons
    make up less than half of its text."""
    whole = linked = 0
    prose, waiting = False, [(e, False)]
    while waiting:
        x, inside = waiting.pop()
        if isinstance(x, str):
            n = len("".join(x.split()))
            whole, linked = whole + n, linked + n * inside
        else:
            prose |= x.tag in _PROSE
            waiting += [(k, inside or x.tag in ("a", "button")) for k in x.kids]
    return prose and 2 * linked < whole


def _raw_text(elements: list[Element]) -> str:
    out, waiting = [], list(reversed(elements))
    while waiting:
        e = waiting.pop()
        if isinstance(e, str):
            out.append(e)
        else:
            waiting += reversed(e.kids)
    return " ".join(" ".join(out).split())


class Slot:
    """A template's element: `n` pages have it, `late` is how many more may have had it before it was
    last counted anew, then its text's hash while constant, and its elements."""

    __slots__ = ("kind", "n", "late", "text", "kids", "of")

    def __init__(self, kind: str, n: int, text: int | None, kids: list[Slot], of: list[Element] | None = None, late: int = 0):
        self.kind, self.n, self.late, self.text, self.kids, self.of = kind, n, late, text, kids, of

    def packed(self) -> list:
        return [self.kind, self.n, self.late, self.text, [k.packed() for k in self.kids]]

    @classmethod
    def unpacked(cls, x: list) -> Slot:
        return cls(x[0], x[1], x[3], [cls.unpacked(k) for k in x[4]], late=x[2])


def _shape(elements: list[Element], inside: bool = False, depth: int = 0) -> Slot:
    """The slot of neighbours of one kind."""
    first = elements[0]
    kids: list[Slot] = []
    inside = inside or first.tag in ("article", "main")
    if depth < _DEEPEST and first.tag in _CONTAINERS and not _is_boilerplate(first, inside and first.tag not in ("article", "main")):
        runs: list[list[Element]] = []
        for k in (k for e in elements for k in e.kids if isinstance(k, Element)):
            if runs and runs[-1][0].kind == k.kind:
                runs[-1].append(k)
            else:
                runs.append([k])
        kids = [_shape(run, inside, depth + 1) for run in runs]
    return Slot(first.kind, 1, xxh64_intdigest(_raw_text(elements)), kids, elements)


def match(a: list[Slot], b: list[Slot]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two element lists: the matches' number and the aligned pairs."""
    if len(a) == len(b) and all(x.kind == y.kind for x, y in zip(a, b)):
        return sum(1 + match(x.kids, y.kids)[0] for x, y in zip(a, b)), [(i, i) for i in range(len(a))]
    if len(a) * len(b) <= _PAIRS:
        return _match_all(a, b)
    score, pairs, i, j = 0, [], 0, 0
    for x, y in [*_anchors(a, b), (len(a), len(b))]:
        left, right = a[i:x], b[j:y]
        n, between = _match_all(left, right) if len(left) * len(right) <= _PAIRS else _match_in_turn(left, right)
        score += n
        pairs += [(i + k, j + m) for k, m in between]
        if x < len(a):
            score += 1 + match(a[x].kids, b[y].kids)[0]
            pairs.append((x, y))
        i, j = x + 1, y + 1
    return score, pairs


def _anchors(a: list[Slot], b: list[Slot]) -> list[tuple[int, int]]:
    """Elements of one kind and text that both lists have once, as many as keep their order."""
    once: list[dict] = []
    for slots in (a, b):
        places: dict[tuple, list[int]] = {}
        for i, s in enumerate(slots):
            if s.text is not None:
                places.setdefault((s.kind, s.text), []).append(i)
        once.append({k: p[0] for k, p in places.items() if len(p) == 1})
    both = [(i, once[1][k]) for k, i in once[0].items() if k in once[1]]  # in the order of a
    # the longest run of them that ascends in b, too
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(both)
    for at, (_, j) in enumerate(both):
        place = bisect_left(ends, j)
        before[at] = last[place - 1] if place else -1
        if place == len(ends):
            ends.append(j)
            last.append(at)
        else:
            ends[place], last[place] = j, at
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(both[at])
        at = before[at]
    return out[::-1]


def _match_in_turn(a: list[Slot], b: list[Slot]) -> tuple[int, list[tuple[int, int]]]:
    """Each element of `a` with the next of its kind in `b`, if that passes over no more of `b` than are
    left of `a`: for long stretches without an anchor."""
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y.kind, []).append(j)
    score, pairs, j = 0, [], 0
    for i, x in enumerate(a):
        of = places.get(x.kind, [])
        k = bisect_left(of, j)
        if k < len(of) and of[k] - j <= len(a) - i:
            score += 1 + match(x.kids, b[of[k]].kids)[0]
            pairs.append((i, of[k]))
            j = of[k] + 1
    return score, pairs


def _match_all(a: list[Slot], b: list[Slot]) -> tuple[int, list[tuple[int, int]]]:
    """The best of all alignments, over all pairs of elements."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    own: dict[tuple[int, int], int] = {}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            score = max(best[i - 1][j], best[i][j - 1])
            if x.kind == y.kind:
                own[i, j] = best[i - 1][j - 1] + 1 + match(x.kids, y.kids)[0]
                score = max(score, own[i, j])
            best[i][j] = score
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if own.get((i, j)) == best[i][j]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i - 1][j] == best[i][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1], pairs[::-1]


def fold(template: Slot, other: Slot) -> None:
    """Add another page or template of the same kind to `template`."""
    pairs = dict((j, i) for i, j in match(template.kids, other.kids)[1])
    missed = template.n // _BUCKET, other.n // _BUCKET  # what either side may have let go of a slot
    out: list[Slot] = []
    at, new = 0, []

    def pass_over(upto: int) -> None:
        """What either side has alone before the next pair, in the order of kinds, so that pages of
        several layouts give one template in whatever order they come."""
        old = template.kids[at:upto]
        for x in old:
            x.late += missed[1]
        for x in new:
            x.late += missed[0]
        out.extend(merge(old, new, key=lambda x: x.kind))

    for j, k in enumerate(other.kids):
        if j in pairs:
            pass_over(pairs[j])
            at, new = pairs[j] + 1, []
            fold(template.kids[pairs[j]], k)
            out.append(template.kids[pairs[j]])
        else:
            new.append(k)
    pass_over(len(template.kids))
    buckets = template.n // _BUCKET, (template.n + other.n) // _BUCKET
    template.n += other.n
    template.late += other.late
    if template.text != other.text:
        template.text = None
    template.kids = [k for k in out if k.n + k.late > buckets[1]] if buckets[1] > buckets[0] else out


#: Least hashes of a host's page texts that are kept to tell how many of them differ.
_KEPT = 64


class Template:
    """A host's template, and a sketch of how many different pages it has."""

    def __init__(self, root: Slot, least: list[int]):
        self.root, self.least = root, least

    @classmethod
    def of_page(cls, page: str) -> Template:
        return cls(_shape([parse(page)]), [xxh64_intdigest(page)])

    def add(self, other: Template) -> None:
        fold(self.root, other.root)
        self.least = sorted({*self.least, *other.least})[:_KEPT]

    def different(self) -> float:
        return len(self.least) if len(self.least) < _KEPT else (_KEPT - 1) * 2.0**64 / self.least[-1]

    def packed(self) -> str:
        """As text, about as large as some pages whatever their number."""
        return json.dumps([self.least, self.root.packed()], separators=(",", ":"))

    @classmethod
    def unpacked(cls, x: str) -> Template:
        least, root = json.loads(x)
        return cls(Slot.unpacked(root), least)


def _constant(template: Template, page: Slot, least_pages: int, share: float) -> set[int]:
    """Ids of the page's elements that the host's template holds constant."""
    total, out = template.root.n, set()
    if template.different() < max(least_pages, 0.5 * total):
        return out

    def walk(t: Slot, p: Slot) -> None:
        for i, j in match(t.kids, p.kids)[1]:
            x, y = t.kids[i], p.kids[j]
            if x.text is not None and x.text == y.text and x.n >= max(least_pages, share * total):
                out.update(map(id, y.of))
            else:
                walk(x, y)

    walk(template.root, page)
    return out


def extract(page: str | None, template: Template | None = None, least_pages: int = 5, share: float = 0.8) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    dropped = _constant(template, _shape([root]), least_pages, share) if template else set()
    found: dict[str, list[Element]] = {"article": [], "main": []}
    waiting: list = [root]
    while waiting:
        e = waiting.pop()
        if e.tag in found:
            found[e.tag].append(e)
        if e.tag != "article" and (e is root or not _is_boilerplate(e, False) or e.tag == "main"):
            waiting += [k for k in reversed(e.kids) if isinstance(k, Element) and id(k) not in dropped]
    blocks: list[str] = []
    inline: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(inline)).split())
        inline.clear()
        if text:
            blocks.append(text)

    for top in found["article"] or found["main"] or [root]:
        inside = top is not root
        flush()
        waiting = list(reversed(top.kids))
        while waiting:
            k = waiting.pop()
            if k is None:
                flush()
            elif isinstance(k, str):
                inline.append(k)
            elif k.tag == "br":
                inline.append(" ")
            elif not _is_boilerplate(k, inside) and (id(k) not in dropped or inside and _is_prose(k)):
                if k.tag in _BLOCKS:
                    flush()
                    waiting.append(None)  # the block's end
                waiting += reversed(k.kids)
        flush()
    return "\n\n".join(blocks)


_PARTIAL = "host string, salt bigint, template string"


def induce(pages: DataFrame, salts: int = 1024) -> DataFrame:
    """(host, template) of `pages` (host, html).  A host's partial templates, one a task, meet by `salts`,
    then by a thirty-second of them, then all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Template] = {}
        salt = TaskContext.get().partitionId() % salts

        def send() -> pa.RecordBatch:
            names = list(held)
            out = pa.RecordBatch.from_pydict({"host": pa.array(names, pa.string()), "salt": pa.array([salt] * len(names), pa.int64()), "template": pa.array([held[h].packed() for h in names], pa.string())})
            held.clear()
            return out

        for b in steps(batches, "html"):
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                if page:
                    new = Template.of_page(page)
                    if host in held:
                        held[host].add(new)
                    else:
                        held[host] = new
            if len(held) > 5000:
                yield send()
        if held:
            yield send()

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        template = Template.unpacked(rows["template"].iloc[0])
        for x in rows["template"].iloc[1:]:
            template.add(Template.unpacked(x))
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "salt": [rows["salt"].iloc[0] % 32], "template": [template.packed()]})

    partial = pages.select("host", "html").mapInArrow(run, _PARTIAL)
    for _ in range(2):
        partial = partial.groupBy("host", "salt").applyInPandas(joined, _PARTIAL)
    return partial.groupBy("host").applyInPandas(joined, _PARTIAL).select("host", "template")


def main_text(pages: DataFrame, least_pages: int = 5, share: float = 0.8) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html)."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    named = rows.withColumn("host", host("url"))
    templates = materialise(induce(named), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Template] = {}
        for b in steps(batches, "html"):
            texts = []
            for packed, page in zip(b.column("template").to_pylist(), b.column("html").to_pylist()):
                if packed and packed not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[packed] = Template.unpacked(packed)
                texts.append(extract(page, known.get(packed), least_pages, share))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    joined = named.join(templates, "host", "left").select("page_id", "url", "html", "template")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
