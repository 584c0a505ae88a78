"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a list of text blocks. A small classifier adds up bounded features of each:
length, share of links, punctuation, tag, legal signs, and the kind of container it lies in.
The sum is the block's cost, one side's terminal capacity. Blocks that follow each other, or are
neighbours in the tree, are joined by smoothness edges, whose weights depend on how near they
are and can outweigh the costs. The minimum cut between the terminals labels every block
as content or boilerplate at once, so a short or doubtful block goes with its neighbours.

Blocks whose cost outweighs all their edges have that label in every minimum cut; they are
settled first, and maximum flow (level graphs with current arcs) is run on the rest.
Pages are independent rows: no shuffle.

Defined cases: null, empty and text-free pages give an empty text; markup that is cut
off or not closed is read as far as it goes (an unseen element without an end tag hides
nothing; only raw text, as a script, then goes on to the end of the page, as in browsers);
repeated rows and null identifiers are kept.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelloom.llm.batches import slices, small_batches

# A quote opens a value only after an equals sign; one that is not closed is a character like others.
VALUE = r"""=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)"""
TAG = re.compile(rf"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|{VALUE})*+)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
WORD = re.compile(r"[a-z]+")

# Element names by their role in a page.
RAW = frozenset("script style textarea title".split())  # no markup within; a head holds these and void elements
UNSEEN = frozenset("noscript template iframe object svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
                    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary "
                    "table tbody td tfoot th thead tr ul button label").split())
OUTER = frozenset("nav footer aside menu dialog button select option".split())
INNER = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p pre blockquote".split())
ITEMS = frozenset("li dt dd td th figcaption caption".split())
FIELDS = frozenset("label legend fieldset button option select".split())
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "option": {"option"}}
# Words in class, id and role that name such parts.
OUTER_WORDS = frozenset(("ad ads advert adverts advertisement adbox banner breadcrumb breadcrumbs comment comments complementary consent "
                         "contentinfo cookie cookies copyright dialog disclaimer disqus dropdown foot footer form gdpr header "
                         "legal login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination "
                         "popup promo promotion recommended related replies reply respond search share sharing sidebar signup "
                         "social sponsor sponsored subscribe teaser toolbar topbar widget alert").split())
INNER_WORDS = frozenset("article content entry main post story".split())

# First parts of names that only say what else there is, and last parts that say no more than "part".
AROUND = frozenset("with has have no without show hide is not".split())
PLAIN_PARTS = frozenset("area bar block box body container content group holder inner item list outer panel region section slot "
                        "unit wrap wrapper left right top bottom main".split())

RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}

# Weights of the features and of the edges, in units of capacity.
OUTSIDE, NESTED, INSIDE, IN_FORM, FIELD = -18, -20, 4, -2, -8
HEADING, TEXT, ITEM, OTHER, LINKED, LEGAL, BEFORE = 3, 5, 0, -3, -14, -9, -6
LEAST, MOST, MIDDLE, CHARS = -4, 8, 40, 15
ENDED, PARTED = 2, 2
FOLLOWING, NEAR, FAR, SIBLING = 6, 3, 1, 6
SIBLINGS_WITHIN = 4  # blocks; neighbours below one parent that lie further apart are not joined
MARKS = re.compile(r"[,;.]")
SENTENCE = re.compile(r"[.!?…。！？][\"'»”’)]*$")
SIGNS = re.compile(r"^\W*[©®™]|\ball rights reserved\b", re.I)


@dataclass
class Block:
    tag: str
    parents: tuple[int, int]  # the element around, and the one around that
    container: int            # what the elements around say: from NESTED to INSIDE
    text: str = ""
    linked: int = 0


def named(words: set[str], token: str) -> bool:
    """Whether a name, as site-header or ad_box, calls its element one of the words."""
    parts = WORD.findall(token)
    if not parts or parts[0] in AROUND:
        return False
    return parts[-1] in words or (parts[0] in words and parts[-1] in PLAIN_PARTS)


def tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether an end tag, and attributes; comments and raw elements as a whole have no name."""
    found, at = [], 0
    while m := TAG.search(page, at):
        at, tag, closing = m.end(), (m[2] or "").lower(), bool(m[1])
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                end = RAW_ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
            tag = ""
        found.append((m.start(), at, tag, closing, m[3] or ""))
    return found


def closed(found: list[tuple[int, int, str, bool, str]]) -> dict[int, int]:
    """The end tag of each element that has one, by their numbers among the tags."""
    opened, ends = defaultdict(list), {}
    for i, (_, _, tag, closing, attributes) in enumerate(found):
        if closing:
            if opened[tag]:
                ends[opened[tag].pop()] = i
        elif tag and tag not in VOID and not attributes.endswith("/"):
            opened[tag].append(i)
    return ends


@dataclass
class Reader:
    """Reads markup into blocks, with a stack of open elements."""

    blocks: list[Block] = field(default_factory=list)

    def container(self, tag: str, attributes: str, above: int) -> int | None:
        """What an element says of the text in it, given the elements around; None if it is not shown."""
        outer, inner = tag in OUTER or (tag == "header" and above <= 0), tag in INNER
        if attributes:
            values = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
            if "none" in WORD.findall(values.get("style", "").lower()) or re.search(r"(?:^|\s)hidden(\s|/|$)", attributes):
                return None
            if tag not in ("body", "html"):
                names = " ".join(values.get(k, "") for k in ("class", "id", "role")).lower().split()
                calls = any(named(INNER_WORDS, n) for n in names)
                outer = outer or any(named(OUTER_WORDS, n) and not (n == "header" and (above > 0 or calls)) for n in names)
                inner = inner or calls
        if tag == "form":
            outer, inner = outer or above > 0, False
        if outer:
            return NESTED if above <= OUTSIDE else OUTSIDE
        if inner:
            return above if above <= OUTSIDE else INSIDE
        return IN_FORM if tag == "form" and above == 0 else above

    def read(self, page: str) -> list[Block]:
        stack = [("", 0, 0, 0)]  # element, its number, its container's value, whether in a link
        number, at, pieces, linked = 0, 0, [], 0

        def close():
            nonlocal pieces, linked
            text = " ".join("".join(pieces).split())
            if text:
                tag = next((s[0] for s in reversed(stack) if s[0] in BLOCKS), "")
                parents = [s[1] for s in itertools.islice((s for s in reversed(stack) if s[0] in BLOCKS), 3)] + [0, 0, 0]
                self.blocks.append(Block(tag, (parents[1], parents[2]), stack[-1][2], text, linked))
            pieces, linked = [], 0

        def say(text: str):
            nonlocal linked
            if text:
                text = html.unescape(text)
                pieces.append(text)
                if stack[-1][3]:
                    linked += len(text)

        found = tags(page)
        ends, skipped = closed(found), -1
        for i, (start, end, tag, closing, attributes) in enumerate(found):
            if i <= skipped:
                continue
            say(page[at:start])
            at = end
            if tag in UNSEEN and i in ends:
                skipped = ends[i]
                at = found[skipped][1]
            if not tag or tag == "head" or tag in UNSEEN:
                continue
            if tag in BLOCKS:
                close()
            if closing:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if depth and (tag in BLOCKS or not any(s[0] in BLOCKS for s in stack[depth:])):
                    del stack[depth:]
                continue
            if tag in ("br", "hr"):
                pieces.append(" ")
            if tag in VOID:
                continue
            if tag in BLOCKS:
                inline = len(stack)
                while inline > 1 and stack[inline - 1][0] not in BLOCKS:
                    inline -= 1
                ended = {"p"} if tag != "button" else set()
                if stack[inline - 1][0] in ended | ENDS_ITSELF.get(tag, set()):
                    del stack[inline - 1:]
            _, _, above, link = stack[-1]
            value = self.container(tag, attributes, above)
            if value is None and i in ends:
                skipped = ends[i]
                at = found[skipped][1]
                continue
            number += 1
            stack.append((tag, number, above if value is None else value, link or tag == "a"))
        say(page[at:])
        close()
        return self.blocks


def cost(block: Block, titled: bool = True) -> int:
    """Above zero: content; below: boilerplate. `titled` says that no title is yet to come."""
    n = len(block.text)
    length = max(LEAST, min(MOST, (n - MIDDLE) // CHARS))
    value = block.container + LINKED * min(block.linked, n) // n + (0 if titled else BEFORE)
    if block.tag in HEADINGS:
        value += HEADING + max(0, length)
    elif block.tag in PROSE:
        value += TEXT + length
    else:
        value += length + (FIELD if block.tag in FIELDS else ITEM if block.tag in ITEMS else OTHER)
    if SENTENCE.search(block.text):
        value += ENDED
    if len(MARKS.findall(block.text, 0, 1_000)) > 2:
        value += PARTED
    return value + (LEGAL if SIGNS.search(block.text) else 0)


def costs_of(blocks: list[Block]) -> list[int]:
    """Costs of a page's blocks; those before its first main title are less likely content."""
    title = next((i for i, b in enumerate(blocks) if b.tag == "h1"), 0)
    return [cost(b, i >= title) for i, b in enumerate(blocks)]


def alike(a: Block, b: Block) -> bool:
    """Whether two blocks may well belong together: in containers of one kind, and both mostly links or both not."""
    return a.container == b.container and (2 * a.linked > len(a.text)) == (2 * b.linked > len(b.text))


def edges(blocks: list[Block]) -> dict[tuple[int, int], int]:
    """Smoothness: blocks that follow each other, by how near they are in the tree, and neighbours below one parent."""
    out: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            if not alike(a, b):
                weight = FAR
            elif a.parents[0] == b.parents[0]:
                weight = FOLLOWING
            else:
                weight = NEAR if a.parents[0] in b.parents or b.parents[0] in a.parents or a.parents[1] == b.parents[1] else FAR
            out[i - 1, i] = weight
        before = last.get(b.parents[0])
        if before is not None and i - before <= SIBLINGS_WITHIN and alike(blocks[before], b):
            out[before, i] = out.get((before, i), 0) + SIBLING
        last[b.parents[0]] = i
    return out


def content(costs: list[int], joined: dict[tuple[int, int], int]) -> list[bool]:
    """Source side of the minimum cut (the smallest one, if several cost the same)."""
    near: list[dict[int, int]] = [{} for _ in costs]
    for (i, j), weight in joined.items():
        near[i][j] = near[i].get(j, 0) + weight
        near[j][i] = near[j].get(i, 0) + weight
    value, total = list(costs), [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * len(costs)
    ready = [i for i, c in enumerate(value) if abs(c) > total[i]]
    while ready:  # a cost above all edges decides; the neighbours' edges to it become costs
        i = ready.pop()
        if label[i] is not None:
            continue
        label[i] = value[i] > 0
        for j, weight in near[i].items():
            if label[j] is None:
                value[j] += weight if label[i] else -weight
                total[j] -= weight
                if abs(value[j]) > total[j]:
                    ready.append(j)
    rest = [i for i, x in enumerate(label) if x is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        inner = {(number[i], number[j]): w for (i, j), w in joined.items() if label[i] is None and label[j] is None}
        for i, kept in zip(rest, Flow([value[i] for i in rest], inner).source_side()):
            label[i] = kept
    return label


class Flow:
    """Maximum flow between the terminals: blocking flows on level graphs, each arc looked at once a level graph."""

    def __init__(self, costs: list[int], joined: dict[tuple[int, int], int]):
        self.source = len(costs)
        self.sink = self.source + 1
        self.head, self.room = [], []
        self.arcs: list[list[int]] = [[] for _ in range(len(costs) + 2)]
        for i, c in enumerate(costs):
            if c > 0:
                self._join(self.source, i, c, 0)
            elif c < 0:
                self._join(i, self.sink, -c, 0)
        for (i, j), weight in joined.items():
            self._join(i, j, weight, weight)
        while self._levels():
            self._block()

    def _join(self, a: int, b: int, there: int, back: int) -> None:
        self.arcs[a].append(len(self.head))
        self.arcs[b].append(len(self.head) + 1)
        self.head += [b, a]
        self.room += [there, back]

    def _levels(self) -> bool:
        """Distances from the source along arcs with room; whether the sink is reached."""
        self.level = [-1] * len(self.arcs)
        self.level[self.source] = 0
        row = [self.source]
        while row and self.level[self.sink] < 0:
            new = []
            for a in row:
                for e in self.arcs[a]:
                    b = self.head[e]
                    if self.room[e] and self.level[b] < 0:
                        self.level[b] = self.level[a] + 1
                        new.append(b)
            row = new
        return self.level[self.sink] >= 0

    def _block(self) -> None:
        """Push flow along shortest paths until every one has a full arc."""
        current = [0] * len(self.arcs)
        path: list[int] = []  # arcs from the source to where we are
        at = self.source
        while True:
            if at == self.sink:
                flow = min(self.room[e] for e in path)
                full = None
                for k, e in enumerate(path):
                    self.room[e] -= flow
                    self.room[e ^ 1] += flow
                    if not self.room[e] and full is None:
                        full = k
                at = self.head[path[full] ^ 1]
                del path[full:]
                continue
            arcs = self.arcs[at]
            while current[at] < len(arcs):
                e = arcs[current[at]]
                if self.room[e] and self.level[self.head[e]] == self.level[at] + 1:
                    break
                current[at] += 1
            else:
                if not path:
                    return
                at = self.head[path.pop() ^ 1]
                current[at] += 1
                continue
            path.append(e)
            at = self.head[e]

    def source_side(self) -> list[bool]:
        return [x >= 0 for x in self.level[:self.source]]


def labelled(page: str) -> tuple[list[Block], list[int], list[bool]]:
    """Blocks of a page, their costs, and whether each is content."""
    blocks = Reader().read(page)
    costs = costs_of(blocks)
    return blocks, costs, content(costs, edges(blocks))


def main_text(page: str) -> str:
    blocks, _, kept = labelled(page)
    return "\n".join(b.text for b, k in zip(blocks, kept) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points."""
    def run(batches):
        for batch in slices(batches, "html"):
            found = [main_text(x or "") for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return small_batches(narrow).mapInArrow(run, "page_id long, url string, text string, n_chars long")
