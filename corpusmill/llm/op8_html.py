"""Main text of HTML pages by minimum-cut labelling (operator 8).

A page is read once into blocks of text with the open elements around them. A logistic classifier turns what a block
looks like and what it stands in into the odds of being content; its two costs become the capacities to the terminals.
Neighbouring blocks, and blocks of one section that others separate, are tied by smoothness edges. A maximum flow gives
the minimum cut that separates content from boilerplate: blocks whose terminal outweighs all their edges are settled
first, which never changes the cut; blocking flows (Dinic) settle the rest.

Pages carry no labels, so the classifier learns from what the pages say of themselves: blocks in `article` and `main`
are content, those in navigation, footers, asides, forms and elements named like adverts, menus or comments are not.
Each such block teaches twice, once with and once without these signs, so that looks are learned too. A tie's weight is
the log-odds that two blocks so tied have one label. Both are drawn towards DEFAULT and TIES, which alone hold without a
fit, by PULL of the sample. The fit reads at most FIT_PAGES pages and FIT_BLOCKS blocks of each (documented bounds).

Reading and flow take time in proportion to a page's length but for odd flows: tags that never close, quotes that never
end, and depth cost no more than others.

Defined cases: a null or empty page has the empty text; rows that repeat are read each; unclosed elements end with the
page; a tag that the page cuts off is dropped; character references are decoded, those cut off stay as they are; an
empty table gives no rows; other columns pass through, but those named as the two that are added.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.sources.corpus import spread

from .folds import sample
from .spaces import small_batches

FIT_PAGES, FIT_BLOCKS = 2_000, 200
PULL = 0.02

#: Elements that start and end a block of text; elements whose content is never text; void elements.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SILENT = frozenset("head title noscript template iframe object svg math canvas audio video button select option datalist input textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Sections that hold content or boilerplate, and words of class and id that tell as much.
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav footer aside form menu dialog".split())
GOOD_NAMES = frozenset("article content entry post story main body text".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side aside nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot header masthead topbar toolbar "
    "cookie cookies consent notice notices alert popup modal overlay subscribe subscription newsletter signup login search share sharing social related recommended comment comments commentlist disqus respond reply replies widget pagination pager copyright legal".split()
)
RAW = frozenset("script style".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ITEM = frozenset("li td dd".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
QUOTE_OR_END = re.compile(r"""=\s*(["'])|>""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

PLAIN, NAMED, INSIDE, OUTSIDE = 0, 1, 2, -1  # what a block stands in: nothing known, a good name, a content section, boilerplate

#: Weights of a block's looks and signs, in the order of features(), and of the ties, that a fit starts from.
DEFAULT = np.array([-0.5, 0.6, -4.0, 0.5, 1.0, -0.5, 4.0, 2.0, -8.0])
SIGNS = 3  # the last so many features are signs
TIES = np.array([1.0, 0.5, 0.2])
NEAR, SAME_SECTION, CROSSING = 0, 1, 2
WIDE = frozenset("html body".split())  # what these are named says nothing of what is in them
ALWAYS = frozenset("nav footer aside menu dialog".split())
HAVING = frozenset("has have with without no is".split())
IN_HEAD = frozenset("head base link meta title script style noscript template".split())
MOST_OF_ALL = 0.8
STRONGEST = 2.0


class Block:
    """Text of a block, characters of it inside links, its section, what it stands in, and its element."""

    __slots__ = ("text", "linked", "section", "place", "tag")

    def __init__(self, text: str, linked: int, section: int, place: int, tag: str):
        self.text, self.linked, self.section, self.place, self.tag = text, linked, section, place, tag


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") in page order, in one pass."""
    at, n = 0, len(page)
    lost = set()  # what the rest of the page is known not to have
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = TAG.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2] in ("!", "?", "/") and lt + 1 < n:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        end, name = m.end(), m[2].lower()
        while True:
            q = QUOTE_OR_END.search(page, end)
            if q is None:
                return
            if q[1] is None or q[1] in lost:
                end = q.end() if q[1] is None else page.find(">", q.end()) + 1
                break
            close = page.find(q[1], q.end())
            if close < 0:
                lost.add(q[1])
                end = page.find(">", q.end()) + 1
                break
            end = close + 1
        if not end:
            return
        yield ("close" if m[1] else "open"), name, page[m.end() : end - 1]
        at = end
        if name in RAW and not m[1]:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = n if close is None else close.end()


def _own(tag: str, attributes: str) -> int:
    """What an element says of itself: OUTSIDE, INSIDE, NAMED, or PLAIN for nothing.

    Any part of a class or id tells, but for those that say what a page has or lacks; of `article` and `main` only whole ones do.
    """
    if tag in BAD_TAGS:
        return OUTSIDE
    said = [t for m in NAMES.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").split()] if attributes and tag not in WIDE else []
    names = set()
    for t in said:
        parts = [p.lower() for p in PIECES.findall(t)]
        names.update([t.lower()] if tag in GOOD_TAGS else parts if len(parts) < 2 or parts[0] not in HAVING else [])
    if BAD_NAMES.intersection(names):
        return OUTSIDE
    if tag in GOOD_TAGS:
        return INSIDE
    return NAMED if GOOD_NAMES.intersection(names) else PLAIN


def _places(tags: list[str], own: list[int], around: list[int], chars: list[int]) -> list[int]:
    """What each element's inside stands in. An element around most of the page's text doesn't make that boilerplate: a form around
    MOST_OF_ALL of it, or anything but a section of boilerplate by its tag, around half of it and an article or main."""
    holds = [False] * len(tags)
    for e in range(len(tags) - 1, 0, -1):
        if own[e] == INSIDE or holds[e]:
            holds[around[e]] = True
        chars[around[e]] += chars[e]
    places = [PLAIN] * len(tags)
    for e in range(1, len(tags)):
        above, said = places[around[e]], own[e]
        wide = tags[e] not in ALWAYS and (holds[e] and 2 * chars[e] >= chars[0] or tags[e] == "form" and chars[e] >= MOST_OF_ALL * chars[0])
        if above == OUTSIDE or said == OUTSIDE and not wide or tags[e] == "header" and above != INSIDE:
            places[e] = OUTSIDE
        else:
            places[e] = max(above, said if said != OUTSIDE else PLAIN)
    return places


def blocks(page: str) -> list[Block]:
    """Blocks in page order; a block's section is the nearest element around it that holds other blocks too, or stands for something else than what is around it."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, number, silent
    around, tags, own, chars = [0], [""], [PLAIN], [0]  # of every element the number of the one around it, what it says, its own text
    opened: Counter = Counter()
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            tag, number, _ = stack[-1]
            out.append(Block(text, linked, number, PLAIN, tag))
            chars[number] += len(text)
        parts.clear()
        linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    for kind, tag, attributes in tokens(page):
        # A head ends with its tag, which may be left out, or with what can't stand in it.
        if opened["head"] and (kind == "open" and tag not in IN_HEAD or kind == "text" and stack[-1][0] == "head" and not tag.isspace()):
            while pop() != "head":
                pass
        if kind == "text":
            if not stack[-1][2]:
                parts.append(tag)
                if links:
                    linked += len(tag)
            continue
        block = tag in BLOCK
        if block:
            flush()
        elif tag == "br":
            parts.append(" ")
        if kind == "close":
            if tag == "a":
                links = max(0, links - 1)
            if opened[tag] > 0:
                while pop() != tag:
                    pass
        elif tag not in VOID and tag not in RAW and not attributes.endswith("/"):
            if block and tag in ("p", "li", "td", "tr", "dd", "dt", "option") and stack[-1][0] == tag:
                pop()
            if block and stack[-1][0] == "p":
                pop()
            if tag == "a":
                links += 1
            if block or tag in SILENT:
                _, number, silent = stack[-1]
                stack.append((tag, len(around), silent or tag in SILENT))
                around.append(number)
                tags.append(tag)
                own.append(_own(tag, attributes))
                chars.append(0)
                opened[tag] += 1
    flush()
    places = _places(tags, own, around, chars)
    for b in out:
        b.place = places[b.section]
    held = [0] * len(around)
    for b in out:
        held[b.section] += 1
    for e in range(len(around) - 1, 0, -1):
        held[around[e]] += held[e]
    section = list(range(len(around)))
    for e in range(1, len(around)):
        if held[e] < 2 and places[e] == places[around[e]]:
            section[e] = section[around[e]]
    for b in out:
        b.section = section[b.section]
    return out


def features(b: Block) -> list[float]:
    """Looks of a block: a constant, words, share in links, whether it ends as a sentence, its element; then its signs."""
    looks = [1.0, log1p(b.text.count(" ") + 1), min(1.0, b.linked / len(b.text)), float(b.text[-1] in ".!?…\"'”»)"), float(b.tag in PROSE), float(b.tag in ITEM)]
    return [*looks, float(b.place == INSIDE), float(b.place == NAMED), float(b.place == OUTSIDE)]


def ties(found: list[Block]) -> list[tuple[int, int, int]]:
    """Pairs of blocks that are tied, and how."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, NEAR if found[i - 1].section == b.section else CROSSING))
        if last.get(b.section, i - 1) < i - 1:
            out.append((last[b.section], i, SAME_SECTION))
        last[b.section] = i
    return out


class Model:
    """Weights of the classifier and of the ties."""

    def __init__(self, weights: np.ndarray = DEFAULT, tie: np.ndarray = TIES):
        self.weights, self.tie = [float(x) for x in weights], [float(x) for x in tie]

    def odds(self, b: Block) -> float:
        return max(-12.0, min(12.0, sum(x * w for x, w in zip(features(b), self.weights))))


UNIT = 1 << 20  # capacities are whole numbers, so that flows end exactly


def min_cut(lead: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the content side of a minimum cut; lead is what cutting a node from content costs more than keeping it."""
    n = len(lead)
    lead = [round(x * UNIT) for x in lead]
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for i, j, w in edges:
        w = round(w * UNIT)
        if w:
            near[i].append((j, w))
            near[j].append((i, w))
    label: list[bool | None] = [None] * n
    free = [sum(w for _, w in t) for t in near]
    todo = deque(range(n))
    while todo:  # a terminal that outweighs all open edges decides
        i = todo.popleft()
        if label[i] is not None or abs(lead[i]) < free[i]:
            continue
        label[i] = lead[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                lead[j] += w if label[i] else -w
                free[j] -= w
                todo.append(j)
    core = [i for i in range(n) if label[i] is None]
    if core:
        side = _flow({i: k for k, i in enumerate(core)}, [lead[i] for i in core], [[(j, w) for j, w in near[i] if label[j] is None] for i in core])
        for k, i in enumerate(core):
            label[i] = side[k]
    return [bool(x) for x in label]


def _flow(at: dict[int, int], lead: list[int], near: list[list[tuple[int, int]]]) -> list[bool]:
    """Which nodes the source still reaches after a maximum flow, by blocking flows along shortest paths."""
    n = len(lead)
    head: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    cap: list[int] = []
    for u, edges in enumerate(near):
        for j, w in edges:
            v = at[j]
            if u < v:  # an undirected edge is its own way back
                head[u].append(len(to))
                head[v].append(len(to) + 1)
                to += [v, u]
                cap += [w, w]
    give, take = [max(x, 0) for x in lead], [max(-x, 0) for x in lead]  # left of the edges from the source and to the sink
    while True:
        level = [-1] * n
        queue = deque(u for u in range(n) if give[u])
        for u in queue:
            level[u] = 0
        ends = None
        while queue:
            u = queue.popleft()
            if ends is not None and level[u] >= ends:
                break
            if take[u]:
                ends = level[u] + 1 if ends is None else ends
                continue
            for e in head[u]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if ends is None:
            return [x >= 0 for x in level]
        nxt = [0] * n
        for s in range(n):
            while give[s]:
                path, u = [], s
                while not (take[u] and level[u] == ends - 1):
                    while nxt[u] < len(head[u]) and not (cap[head[u][nxt[u]]] and level[to[head[u][nxt[u]]]] == level[u] + 1 < ends):
                        nxt[u] += 1
                    if nxt[u] < len(head[u]):
                        path.append(head[u][nxt[u]])
                        u = to[path[-1]]
                    elif path:
                        u = to[path.pop() ^ 1]
                        nxt[u] += 1
                    else:
                        break
                if not (take[u] and level[u] == ends - 1):
                    break
                flow = min([give[s], take[u], *(cap[e] for e in path)])
                give[s] -= flow
                take[u] -= flow
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow


def main_blocks(page: str | None, model: Model) -> tuple[list[Block], list[bool], list[float]]:
    """All blocks of a page, which are content, and their odds."""
    found = blocks(page or "")
    score = [model.odds(b) for b in found]
    # What it costs to cut a block from content, log(1 + e^s), less what it costs to keep it, log(1 + e^-s), is s.
    return found, min_cut(score, [(i, j, model.tie[k]) for i, j, k in ties(found)]), score


def main_text(page: str | None, model: Model | None = None) -> str:
    found, keep, _ = main_blocks(page, model or Model())
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def lessons(page: str) -> tuple[list[list[float]], list[int], np.ndarray]:
    """Features and labels of up to FIT_BLOCKS blocks that say what they are, and how often tied blocks have one label or two."""
    found = blocks(page)
    label = [1 if b.place == INSIDE else 0 if b.place == OUTSIDE else None for b in found]
    tied = np.zeros((len(TIES), 2), np.int64)
    for i, j, k in ties(found):
        if label[i] is not None and label[j] is not None:
            tied[k, int(label[i] != label[j])] += 1
    told = [i for i, x in enumerate(label) if x is not None]
    told = told[:: -(-len(told) // FIT_BLOCKS) or 1]
    return [features(found[i]) for i in told], [label[i] for i in told], tied


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = FIT_PAGES) -> Model:
    """A model from at most `rows` pages, those of the least hash of the id; pages without an id teach nothing."""
    chosen = sample(pages.select(id_col).where(F.col(id_col).isNotNull()).distinct(), id_col, rows)
    text = pages.join(F.broadcast(chosen), id_col).select(F.col(html_col).alias("html"))  # at most `rows` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, tied = [], [], np.zeros((len(TIES), 2), np.int64)
            for page in batch.column(0).to_pylist():
                more, label, both = lessons(page or "")
                x, y, tied = x + more, y + label, tied + both
            yield pa.RecordBatch.from_arrays([pa.array([np.array(x, "<f8").tobytes()]), pa.array([np.array(y, np.int8).tobytes()]), pa.array([tied.ravel().tolist()], pa.list_(pa.int64()))], ["x", "y", "tied"])

    seen = small_batches(text).mapInArrow(run, "x binary, y binary, tied array<long>").collect()  # at most rows * FIT_BLOCKS blocks
    x = np.frombuffer(b"".join(r.x for r in seen), "<f8").reshape(-1, len(DEFAULT))
    y = np.frombuffer(b"".join(r.y for r in seen), np.int8).astype(float)
    tied = sum((np.array(r.tied) for r in seen), np.zeros(2 * len(TIES), np.int64)).reshape(-1, 2)
    bare = x.copy()
    bare[:, -SIGNS:] = 0
    start = 1 / (1 + np.exp(-TIES))
    pull = 20.0
    tie = np.log((tied[:, 0] + pull * start) / (tied[:, 1] + pull * (1 - start)))
    return Model(_towards(DEFAULT, np.concatenate([x, bare]), np.concatenate([y, y])), np.clip(tie, 0.0, STRONGEST))


def _towards(start: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression whose penalty draws them to start; both classes weigh alike."""
    if not 0 < y.sum() < len(y):
        return start
    order = np.lexsort(np.column_stack([x, y]).T)  # the same sums however the rows arrived
    x, y = x[order], y[order]
    w = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    beta = start.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (p - y)) + PULL * (beta - start)
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + PULL * np.eye(len(beta)), gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """All columns but html_col, and the main text and its number of code points."""
    others = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    shared = pages.sparkSession.sparkContext.broadcast(model or Model())  # a dozen numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, shared.value) for x in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*others, text_col, "n_chars"])

    schema = T.StructType([*(pages.schema[c] for c in others), T.StructField(text_col, T.StringType()), T.StructField("n_chars", T.LongType())])
    return small_batches(pages.select(*others, html_col)).mapInArrow(run, schema)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return extract(pages, model=fit(pages)).select("page_id", "url", "text", "n_chars")
