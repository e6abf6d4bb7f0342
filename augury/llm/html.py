"""HTML extraction: gradient-boosted trees over DOM-node features, then hierarchical decoding.

A page's tags become a tree of nodes. Each node has features: depth, text length, density of text and of links in its subtree, its place and its like among its siblings, its tag group, words of its
class, id and role attributes, and what encloses it. Boosted trees (Spark ML), fitted on nodes of a bounded sample of pages, give each node a log-odds of being main text.
Decoding picks, for the whole tree at once, the labels of highest total log-odds under one rule: below a node that is out, nothing is in. So an ancestor and its
descendants never contradict each other. The in-nodes' text is cut at block tags, white space runs become one space, and blocks are joined by an empty line.

Training needs no hand labels: pages with an <article> or <main> say what is in it and what isn't; what bears words such as "comment" inside it is out, and what encloses it isn't used. So that the trees
learn from the shape of pages as well as from names, every page teaches twice, once with the features of ``NAMED`` (tags and attribute words) blank, as they are on pages that don't use them.
At most ``most_pages`` pages, chosen by a hash of their ids, are used; of those one in five is held out, on which ``accuracy`` measures the trees with and without names.

Defined results: null or empty html: empty text; pages without tags: their text is one block; unclosed and stray tags are tolerated; repeated rows alike; a null key is kept; only the columns
asked for are read; no page that can teach: names decide; an empty table gives an empty result. The work per page is linear in its nodes.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from augury.llm.common import small_batches, stored, texts

# Groups of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param keygen frame".split())
RAW = frozenset("script style template textarea title iframe select option".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SAME_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
OUT_TAGS = frozenset("nav aside footer form button label head dialog menu".split())
IN_TAGS = frozenset("article main".split())
# Words of class, id and role attributes.
OUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended widget toolbar pagination pager tags legal copyright contentinfo complementary".split())
IN_WORDS = frozenset("article articlebody content post entry story text main body prose".split())

TAG = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|itemprop|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I | re.S)
WORD = re.compile(r"[A-Za-z][a-z]*")
# Places of the features that come from tag names and attribute words.
NAMED = range(12, 24)


class Node:
    __slots__ = ("attrs", "children", "depth", "hidden", "label", "n_words_in", "n_words_out", "parent", "tag", "x")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.depth = tag, attrs, parent, parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []
        words, self.hidden = set(), False
        if attrs:
            for m in ATTRIBUTE.finditer(attrs):
                name, value = m[1].lower(), (m[2] or "").strip("\"'")
                if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                    self.hidden = True
                elif name in ("class", "id", "role", "itemprop"):
                    words |= {w.lower() for w in WORD.findall(value)}
        self.n_words_out, self.n_words_in = len(words & OUT_WORDS), len(words & IN_WORDS)


class Scanner:
    """Tags, comments and declarations of a page from left to right. A tag may hold ``>`` in quotes; one that doesn't end is text. What a search missed once isn't searched again: places from which a tag is known not to end are marked,
    so a page takes time in proportion to its length, however broken it is."""

    def __init__(self, html: str):
        self.html, self.dead, self.last = html, bytearray(), html.rfind(">")

    def after(self, at: int) -> int:
        """Where a tag ends whose attributes begin ``at``; -1 if nowhere."""
        i, seen = at, []
        while not (self.dead and i < len(self.dead) and self.dead[i]):
            m = STOP.search(self.html, i) if i <= self.last else None
            if m is None:
                seen.append((i, len(self.html)))
                break
            j = m.start()
            if self.html[j] == ">":
                return j + 1
            q = -1 if self.dead and self.dead[j] else self.html.find(self.html[j], j + 1)
            seen.append((i, j + 1))
            if q < 0:
                break
            i = q + 1
        if not self.dead:
            self.dead = bytearray(len(self.html) + 1)
        for a, b in seen:
            self.dead[a:b] = b"\x01" * (b - a)
        return -1

    def next(self, at: int) -> tuple[int, int, re.Match | None, str]:
        """(start, end, match of an element's tag or None, its attributes) of the next piece of markup; a start of -1 if there is none."""
        html = self.html
        while m := TAG.search(html, at):
            if m[2] is not None:
                end = self.after(m.end())
                if end >= 0:
                    return m.start(), end, m, html[m.end() : end - 1]
                at = m.end()
                continue
            mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            end = html.find(mark, m.end()) if mark != ">" or m.end() <= self.last else -1
            if end >= 0:
                return m.start(), end + len(mark), None, ""
            if mark != ">":
                return m.start(), len(html), None, ""
            at = m.end()
        return -1, -1, None, ""


def parse(html: str) -> Node:
    """The tree of a page. Every node is opened and closed once; a closing tag that nothing open answers to is passed over at once."""
    scan, never = Scanner(html), set()
    root = Node("#root", "", None)
    stack, open_ = [root], Counter()
    end, n = 0, len(html)

    def close(depth: int) -> None:
        for x in stack[depth:]:
            open_[x.tag] -= 1
        del stack[depth:]

    while end < n:
        start, stop, m, attrs = scan.next(end)
        if start < 0:
            stack[-1].children.append(html[end:])
            break
        if start > end:
            stack[-1].children.append(html[end:start])
        end = stop
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag] > 0:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            continue
        if tag in CLOSES_P and open_["p"] > 0:
            i = len(stack) - 1
            while i and stack[i].tag != "p" and stack[i].tag not in BLOCK:
                i -= 1
            if stack[i].tag == "p":
                close(i)
        if tag in SAME_CLOSES:
            own, stop = SAME_CLOSES[tag]
            i, top = len(stack) - 1, None
            if any(open_[t] > 0 for t in own):
                while i and stack[i].tag not in stop:
                    if stack[i].tag in own:
                        top = i
                    i -= 1
            if top is not None:
                close(top)
        if tag == "br" or tag == "hr":
            stack[-1].children.append("\n")
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                closing = None if tag in never else re.compile(f"</{re.escape(tag)}\\s*+>", re.I).search(html, end)
                if closing is None:
                    never.add(tag)
                end = closing.end() if closing else (n if tag in ("script", "style", "template", "title", "textarea") else end)
            continue
        node = Node(tag, attrs, stack[-1])
        stack[-1].children.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
            open_[tag] += 1
    return root


def measured(root: Node) -> list[Node]:
    """All element nodes, parents first, each with its features and, where the page itself tells it, its label (else -1)."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [c for c in reversed(x.children) if isinstance(c, Node)]
    total: dict[int, list[int]] = {}
    holds: set[int] = set()  # nodes with an article or main below
    for x in reversed(order):
        own = sum(len(c.split()) for c in x.children if isinstance(c, str))
        text, link, tags, para = own, 0, 1, int(x.tag == "p")
        for c in x.children:
            if isinstance(c, Node):
                t = total[id(c)]
                text, link, tags, para = text + t[0], link + t[1], tags + t[2], para + t[3]
        total[id(x)] = [text, text if x.tag == "a" else link, tags, para, own]
        if x.parent is not None and (x.tag in IN_TAGS or id(x) in holds):
            holds.add(id(x.parent))
    whole = max(1, total[id(root)][0])
    flags = {id(root): (False, False, False, False)}  # inside article or main, inside what isn't content by tag, by word, hidden
    beside: dict[int, tuple] = {id(root): (1, {"#root": [1, whole]}, 0)}
    for x in order:
        text, up = total[id(x)], x.parent
        if up is not None:
            was_in, out_tag, out_word, hidden = flags[id(up)]
            inside_in = was_in or x.tag in IN_TAGS
            out_tag = out_tag or x.tag in OUT_TAGS or x.tag == "header" and not was_in
            wrapper = x.tag in ("body", "html", "article", "main") or text[0] * 2 > whole  # what holds most of the page isn't an advert
            out_word = out_word or x.n_words_out > 0 and not wrapper and not (x.n_words_in and x.n_words_out < x.n_words_in)
            flags[id(x)] = (inside_in, out_tag, out_word, hidden or x.hidden)
        inside_in, out_tag, out_word, hidden = flags[id(x)]
        kids = [c for c in x.children if isinstance(c, Node)]
        like: dict[str, list[int]] = {}
        for c in kids:
            k = like.setdefault(c.tag, [0, 0])
            k[0] += 1
            k[1] += total[id(c)][0]
        for i, c in enumerate(kids):
            beside[id(c)] = (len(kids), like, i)
        n, like, i = beside[id(x)]
        x.label = -1 if id(x) in holds or not holds else int(inside_in and not (out_tag or out_word or hidden))
        x.x = [
            x.depth, text[0], text[4], text[2], text[3], text[0] / text[2], text[1] / max(1, text[0]), text[0] / whole, n, like[x.tag][0], i / n, like[x.tag][1] / like[x.tag][0],
            x.tag in IN_TAGS, x.tag in OUT_TAGS, x.tag == "p", x.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), x.tag in ("ul", "ol", "li"), x.tag in ("div", "section"), x.tag == "a",
            inside_in, out_tag, out_word, x.n_words_in, x.n_words_out,
        ]
    return order


def by_name(order: list[Node]) -> np.ndarray:
    """What names alone say of each node, for want of a model: -1 for what they put out, else 1."""
    return np.array([-1.0 if x.x[20] or x.x[21] else 1.0 for x in order])


def decoded(order: list[Node], score: np.ndarray) -> list[bool]:
    """The labels of highest total score with nothing in below what is out. The root is in."""
    place = {id(x): i for i, x in enumerate(order)}
    s = score * np.array([max(1.0, np.log2(2 + x.x[2])) for x in order])
    take, leave = s.copy(), -s
    for i in range(len(order) - 1, 0, -1):
        j = place[id(order[i].parent)]
        take[j] += max(take[i], leave[i])
        leave[j] += leave[i]
    kept = [True] * len(order)
    for i in range(1, len(order)):
        kept[i] = kept[place[id(order[i].parent)]] and bool(take[i] > leave[i]) and not order[i].hidden
    return kept


def assembled(order: list[Node], kept: list[bool]) -> str:
    ok = {id(x) for x, k in zip(order, kept, strict=True) if k}
    blocks: list[list[str]] = [[]]
    todo: list = [order[0]]
    while todo:
        x = todo.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(entities.unescape(x))
        elif id(x) in ok:
            cut = x.tag in BLOCK
            todo += [None] * cut + list(reversed(x.children)) + [None] * cut
    return "\n\n".join(b for b in (" ".join("".join(p).split()) for p in blocks) if b)


class Trees:
    """Fitted trees as arrays: log-odds of many nodes at once."""

    def __init__(self, trees: list[list[tuple]], weights: list[float]):
        self.trees, self.weights = [tuple(np.array(c) for c in zip(*t, strict=True)) for t in trees], weights

    @classmethod
    def of(cls, model) -> Trees:
        def walk(node, rows):
            i = len(rows)
            rows.append(None)
            if node.subtreeDepth() == 0:
                rows[i] = (-1, 0.0, i, i, float(node.prediction()))
            else:
                split = node.split()
                left = walk(node.leftChild(), rows)
                right = walk(node.rightChild(), rows)
                rows[i] = (int(split.featureIndex()), float(split.threshold()), left, right, 0.0)
            return i

        out = []
        for t in model.trees:
            rows: list = []
            walk(t._java_obj.rootNode(), rows)
            out.append(rows)
        return cls(out, list(model.treeWeights))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for (feature, threshold, left, right, value), w in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += w * value[at]
        return 2 * total


def nodes(pages: DataFrame, html: str) -> DataFrame:
    """(label, x, blank) of every node that its page labels: one row a page, each feature list with and without names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "__html"):
            for h, test in zip(texts(b, "__html"), b.column("__test").to_pylist(), strict=True):
                rows = [x for x in measured(parse(h)) if x.label >= 0]
                full = [list(map(float, x.x)) for x in rows]
                blank = [[0.0 if i in NAMED else v for i, v in enumerate(x)] for x in full]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([float(x.label) for x in rows] * 2, pa.float64()), pa.array(full + blank, pa.list_(pa.float64())), pa.array([False] * n + [True] * n, pa.bool_()), pa.array([test] * 2 * n, pa.bool_())], names=["label", "x", "blank", "test"])

    return pages.select(pages[html].alias("__html"), "__test").mapInArrow(run, "label double, x array<double>, blank boolean, test boolean")


def taught(pages: DataFrame, html: str, key: str, most_pages: int) -> DataFrame:
    chosen = pages.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(most_pages)
    chosen = chosen.withColumn("__test", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(5)) == 0)
    return stored(nodes(pages.join(F.broadcast(chosen), key).select(html, "__test"), html), "nodes")


def fit(pages: DataFrame, *, html: str = "html", key: str = "page_id", most_pages: int = 400, trees: int = 12, depth: int = 4) -> Trees | None:
    """Boosted trees from a bounded sample of pages; None if its nodes have fewer than two labels."""
    return fitted(taught(pages, html, key, most_pages), trees, depth)


def fitted(rows: DataFrame, trees: int = 12, depth: int = 4) -> Trees | None:
    rows = rows.where("not test").select("label", array_to_vector("x").alias("features"))
    if rows.select("label").distinct().count() < 2:
        return None
    return Trees.of(GBTClassifier(maxIter=trees, maxDepth=depth, seed=5, stepSize=0.3).fit(rows))


def accuracy(pages: DataFrame, *, html: str = "html", key: str = "page_id", most_pages: int = 400) -> dict[bool, float]:
    """Share of right labels among the nodes of held-out pages: with names (False) and with names blank (True)."""
    rows = taught(pages, html, key, most_pages)
    model = fitted(rows)
    held = rows.where("test").collect()  # of a fifth of the sample
    right = (model(np.array([r.x for r in held])) > 0) == np.array([r.label > 0 for r in held])
    return {b: float(right[[r.blank == b for r in held]].mean()) for b in (False, True)}


def extract(pages: DataFrame, model: Trees | None, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` with text and n_chars. Without a model, names decide."""
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "__html", 1 << 20):
            trees = [measured(parse(h)) for h in texts(b, "__html")]
            score = model(np.array([x.x for t in trees for x in t], float)) if model else np.concatenate([by_name(t) for t in trees])
            out, at = [], 0
            for t in trees:
                s = score[at : at + len(t)]
                at += len(t)
                out.append(assembled(t, [True] if len(t) == 1 else decoded(t, s)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=schema.names)

    return pages.select(*keep, pages[html].alias("__html")).mapInArrow(run, schema)
