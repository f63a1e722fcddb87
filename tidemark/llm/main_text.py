"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.session import cut_lineage

SAMPLE_PAGES = 300
SLOTS = 1 << 14
ROUNDS = 6
DEPTH = 512  # browsers nest no deeper either
TRAINING_CHARS = 100_000

# Elements of HTML by their part in the layout.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section select summary "
                   "table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head noscript object script style svg template title iframe canvas".split())
# What may stand in a head (any other start tag ends it), and what hides text only up to an end tag of its own.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
HELD = frozenset("noscript object svg template title iframe canvas".split())
# Elements that end an open one of the same kind, and those that end a paragraph.
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - frozenset("button caption html body label legend option select tbody td textarea tfoot th thead tr".split())

# Names that tell training labels.
MAIN = frozenset(("article", "main"))
ASIDE_TAGS = frozenset("aside footer form header nav".split())
ASIDE_WORDS = frozenset("ad ads advert advertisement banner breadcrumb comment comments cookie disqus footer header menu modal nav "
                        "newsletter notice popup promo related share sidebar social sponsor subscribe widget".split())


@dataclass
class Block:
    path: tuple[tuple[str, tuple[str, ...]], ...]  # outer DEPTH ancestors: tag and the words of its class, id and role
    text: str
    linked: int  # characters inside links


def name_words(attributes: Sequence[tuple[str, str | None]]) -> tuple[str, ...]:
    named = " ".join(v or "" for k, v in attributes if k in ("class", "id", "role"))
    return tuple(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named).lower())) if named else ()


class Reader(HTMLParser):
    """Leaf blocks in page order: runs of text that no block element interrupts.

    A head ends where its end tag is, or before text or an element that may not stand in it.
    ``endless`` names start tags of HELD elements, by number, that have no end tag: they are passed over.
    Those that a reading finds are in ``lost``.
    """

    def __init__(self, endless: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.endless, self.n_held = endless, 0
        self.held: list[int] = []  # for each open element the number of its start tag, 0 if it is none of HELD
        self.lost: dict[str, list[int]] = {}
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.counts: Counter[str] = Counter()  # open elements by tag
        self.parts: list[str] = []
        self.blocks: list[Block] = []
        self.linked = self.unseen = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(tuple(self.open[:DEPTH]), text, self.linked))
        self.parts, self.linked = [], 0

    def close_to(self, depth: int) -> None:
        if any(tag in BLOCKS for tag, _ in self.open[depth:]):
            self.flush()
        for tag, _ in self.open[depth:]:
            self.unseen -= tag in UNSEEN
            self.counts[tag] -= 1
        del self.open[depth:], self.held[depth:]

    def lose(self, depth: int) -> None:
        for (tag, _), number in zip(self.open[depth:], self.held[depth:], strict=True):
            if number:
                self.lost.setdefault(tag, []).append(number)

    def end_head(self) -> None:
        while self.open and self.open[-1][0] == "head":
            self.close_to(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HELD:
            self.n_held += 1
            if self.n_held in self.endless:
                return
        if tag not in IN_HEAD:
            self.end_head()
        if tag in BLOCKS:
            ended = SAME.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            depth = len(self.open) - 1
            while depth >= 0 and any(self.counts[t] for t in ended):
                if self.open[depth][0] in ended:
                    self.close_to(depth)
                elif self.open[depth][0] in BLOCKS:
                    break
                depth -= 1
            self.flush()
        if tag == "body":  # a head that was not closed ends here
            self.unseen, self.open, self.held = 0, [], []
            self.counts.clear()
        if tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            self.open.append((tag, name_words(attrs)))
            self.counts[tag] += 1
            self.held.append(self.n_held if tag in HELD else 0)
            self.unseen += tag in UNSEEN

    def handle_endtag(self, tag: str) -> None:
        if self.counts[tag]:
            depth = next(d for d in range(len(self.open) - 1, -1, -1) if self.open[d][0] == tag)
            self.lose(depth + 1)
            self.close_to(depth)
        elif self.lost.get(tag):  # an end tag behind that of an outer element
            self.lost[tag].pop()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.end_head()
        if not self.unseen:
            self.parts.append(data)
            if self.counts["a"]:
                self.linked += len(data.strip())


def leaf_blocks(html: str | None) -> list[Block]:
    def read(endless: frozenset[int]) -> Reader:
        reader = Reader(endless)
        reader.feed(html or "")
        reader.close()
        reader.flush()
        reader.lose(0)
        return reader

    # Only the end of the page tells which elements are endless; such a page is read again.
    reader = read(frozenset())
    while any(reader.lost.values()):
        reader = read(reader.endless.union(*reader.lost.values()))
    return reader.blocks


# --- features ------------------------------------------------------------------------------

def slot(name: str, known: dict[str, int]) -> int:
    at = known.get(name)
    if at is None:
        at = known[name] = zlib.crc32(name.encode()) % SLOTS
    return at


def features(block: Block, place: int, n: int) -> list[str]:
    """Names of what holds for a block: its ancestors, the shape of its text, its place."""
    words = block.text.count(" ") + 1
    size = len(block.text)
    marks = sum(block.text.count(c) for c in ".,;:!?")
    out = ["always", f"words {min(words.bit_length(), 8)}", f"linked {4 * min(block.linked, size) // size}",
           f"marks {min(8 * marks // words, 4)}", f"end {block.text[-1] in '.!?…:;'}", f"first {place == 0}", f"last {place == n - 1}"]
    if any(c in block.text for c in "©|»›·"):
        out.append("sign")
    # In the order of the path: the training leaves features out by their place, and must not differ from run to run.
    out += [f"tag {t}" for t in dict.fromkeys(t for t, _ in block.path)]
    out += [f"name {w}" for w in dict.fromkeys(w for _, ws in block.path for w in ws)]
    inner = [t for t, _ in block.path if t in BLOCKS]
    out += [f"leaf {inner[-1]}" if inner else "leaf none", f"pair {' '.join(inner[-2:])}"]
    return out


# --- the field ----------------------------------------------------------------------------

@dataclass
class Field:
    """Two states, other (0) and main text (1): a weight per feature and state, and one per pair of neighbours."""

    weights: np.ndarray  # SLOTS x 2
    steps: np.ndarray  # 2 x 2

    def scores(self, pages: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[f].sum(axis=0) for f in pages]).reshape(-1, 2)

    def decode(self, unary: np.ndarray) -> list[int]:
        """Viterbi: the most likely states of all blocks together."""
        (a, b), back, t = unary[0].tolist(), [], self.steps.tolist()
        for x, y in unary[1:].tolist():
            from_a, from_b = a + t[0][0] < b + t[1][0], a + t[0][1] < b + t[1][1]
            back.append((int(from_a), int(from_b)))
            a, b = max(a + t[0][0], b + t[1][0]) + x, max(a + t[0][1], b + t[1][1]) + y
        state = int(b > a)
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]


def marginals(unary: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each state of each block, and of each pair summed over the page (forward and backward sums)."""
    n = len(unary)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = unary[0]
    for i in range(1, n):
        ahead[i] = unary[i] + np.logaddexp.reduce(ahead[i - 1][:, None] + steps, axis=0)
    for i in range(n - 2, -1, -1):
        behind[i] = np.logaddexp.reduce(steps + (unary[i + 1] + behind[i + 1])[None, :], axis=1)
    total = np.logaddexp.reduce(ahead[-1])
    pairs = np.zeros((2, 2))
    for i in range(1, n):
        pairs += np.exp(ahead[i - 1][:, None] + steps + (unary[i] + behind[i])[None, :] - total)
    return np.exp(ahead + behind - total), pairs


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Field:
    """Maximum likelihood by adaptive gradient steps, one page at a time."""
    known: dict[str, int] = {}
    rows = [([[slot(f, known) for f in features(b, i, len(blocks))] for i, b in enumerate(blocks)], labels) for blocks, labels in pages if blocks]
    field = Field(np.zeros((SLOTS, 2)), np.zeros((2, 2)))
    seen_w, seen_t = np.full((SLOTS, 2), 1e-6), np.full((2, 2), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for at in rng.permutation(len(rows)):
            slots, labels = rows[at]
            # Features are left out at random, so no single name carries a decision.
            slots = [[s for s, keep in zip(f, rng.random(len(f)) > 0.25, strict=True) if keep] or f[:1] for f in slots]
            chance, pairs = marginals(field.scores(slots), field.steps)
            truth = np.eye(2)[labels]
            push = np.zeros((SLOTS, 2))
            sizes = [len(f) for f in slots]
            flat = np.concatenate(slots)
            np.add.at(push, flat, np.repeat(truth - chance, sizes, axis=0))
            used = np.unique(flat)
            g = push[used] - decay * field.weights[used]
            seen_w[used] += g * g
            field.weights[used] += rate * g / np.sqrt(seen_w[used])
            g = -pairs
            np.add.at(g, (labels[:-1], labels[1:]), 1)
            seen_t += g * g
            field.steps += rate * g / np.sqrt(seen_t)
    return field


# --- labelled pages ---------------------------------------------------------------------------

def marked_main(path: Sequence[tuple[str, tuple[str, ...]]]) -> bool:
    """Inside an article or main element, and in nothing there that is set apart by its tag or name."""
    depth = next((i for i, (t, _) in enumerate(path) if t in MAIN), None)
    return depth is not None and not any(
        t in ASIDE_TAGS or ASIDE_WORDS & set(ws) for t, ws in path[depth:])


# Where pages put text that is not theirs, as (tag, name) from the body on.
ELSEWHERE = [
    [("header", "site header")], [("div", "header"), ("p", "")], [("div", "logo")], [("nav", ""), ("ul", ""), ("li", ""), ("a", "")],
    [("div", "menu"), ("ul", ""), ("li", ""), ("a", "")], [("ul", "breadcrumb"), ("li", ""), ("a", "")], [("aside", ""), ("p", "")],
    [("aside", "sidebar"), ("h3", "")], [("div", "sidebar"), ("p", "")], [("div", "widget"), ("ul", ""), ("li", ""), ("a", "")],
    [("div", "related"), ("ul", ""), ("li", ""), ("a", "")], [("div", "ad")], [("div", "advert"), ("p", "")], [("div", "banner"), ("p", "")],
    [("div", "promo sponsor"), ("p", "")], [("div", "cookie notice"), ("p", "")], [("div", "cookie"), ("button", "")], [("div", "notice")],
    [("div", "popup modal"), ("p", "")], [("form", ""), ("label", "")], [("form", "newsletter subscribe"), ("p", "")], [("form", "search"), ("button", "")],
    [("select", ""), ("option", "")], [("section", "comments"), ("div", "comment"), ("p", "")], [("div", "comments"), ("p", "")],
    [("div", "comment"), ("p", "")], [("ol", "comments"), ("li", "comment"), ("p", "")], [("section", "comments"), ("h2", "")],
    [("div", "share social"), ("a", "")], [("footer", ""), ("p", "")], [("footer", "")], [("div", "footer"), ("ul", ""), ("li", ""), ("a", "")],
]
# Other elements that hold a page's own text.
OWN = [[("article", "")], [("main", "")], [("main", ""), ("article", "post")], [("div", "content")], [("div", "post body")],
       [("section", "article text")], [("div", "entry content"), ("div", "")], [("div", "story"), ("section", "")], [("div", "page"), ("article", "entry")]]
OWN_LEAVES = [[("p", "")]] * 8 + [[("h2", "")], [("h3", "")], [("ul", ""), ("li", "")], [("blockquote", ""), ("p", "")], [("pre", "")],
                                 [("table", ""), ("tr", ""), ("td", "")], [("figure", ""), ("figcaption", "")], [("div", "")], [("ol", ""), ("li", "")]]


def varied(blocks: list[Block], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """Another page made of a labelled one: its own text in another element and among other leaves, with
    foreign blocks (made of pieces of the same texts) before, inside and behind it."""
    step = lambda pairs: tuple((t, tuple(n.split())) for t, n in pairs)
    labels = [int(marked_main(b.path)) for b in blocks]
    own = [b for b, is_main in zip(blocks, labels, strict=True) if is_main]
    words = " ".join(b.text for b in blocks).split()
    root = (("html", ()), ("body", ()))
    wrap = step(OWN[rng.integers(len(OWN))])

    def foreign(inside: bool) -> list[tuple[Block, int]]:
        out = []
        for _ in range(rng.integers(1, 4)):
            path = step(ELSEWHERE[rng.integers(len(ELSEWHERE))])
            for _ in range(rng.integers(1, 5)):
                a = int(rng.integers(len(words)))
                text = " ".join(words[a:a + int(rng.integers(1, 6 if path[-1][0] in ("a", "button", "option", "label", "h2", "h3") else 40))])
                if text:
                    out.append((Block((*root, *(wrap if inside else ()), *path), text, len(text) if path[-1][0] == "a" else 0), 0))
        return out

    body = []
    for b in own:
        leaf = step(OWN_LEAVES[rng.integers(len(OWN_LEAVES))])
        if b.path[-1][0] in ("h1", "h2", "h3"):
            leaf = b.path[-1:]
        body.append((Block((*root, *wrap, *leaf), b.text, int(b.linked)), 1))
    if len(body) > 2 and rng.random() < 0.5:
        at = int(rng.integers(1, len(body)))
        body[at:at] = foreign(True)
    if rng.random() < 0.4:
        body += foreign(True)
    page = foreign(False) + body + foreign(False)
    return [b for b, _ in page], [x for _, x in page]


def fit(pages: DataFrame, html: str = "html", page_id: str = "page_id", sample_pages: int = SAMPLE_PAGES, seed: int = 5) -> Field:
    """A field trained on at most ``sample_pages`` pages (smallest hash of the id) that mark their main text.

    Labels come from article and main elements; two varied pages are made of each
    one, so that other layouts are known too.  Only pages of less than TRAINING_CHARS characters train it,
    pages of any size are judged by it.  Ids and digests are ordered first, and only the chosen pages reach the driver.
    """
    marked = (pages.filter(F.contains(F.lower(html), F.lit("<article")) | F.contains(F.lower(html), F.lit("<main")))
              .filter(F.length(html) < TRAINING_CHARS)
              .select(F.col(page_id).alias("id"), F.col(html).alias("page"), F.md5(html).alias("digest")))
    order = [F.xxhash64("id"), "id", "digest"]
    chosen = cut_lineage(marked.select("id", "digest").distinct().orderBy(*order).limit(sample_pages))
    mine = chosen.select(F.col("id").alias("i"), F.col("digest").alias("d"))
    rows = (marked.join(F.broadcast(mine), F.col("id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left_semi")
            .dropDuplicates(["id", "digest"]).orderBy(*order).select("page").collect())
    rng = np.random.default_rng(seed)
    labelled = []
    for row in rows:
        blocks = leaf_blocks(row[0])
        if any(marked_main(b.path) for b in blocks):
            labelled.append((blocks, [int(marked_main(b.path)) for b in blocks]))
            labelled += [varied(blocks, rng) for _ in range(2)]
    if not labelled:  # no marked page at all: made-up ones of the fixed layouts
        plain = [Block((("article", ()), ("p", ())), "A sentence of a page that is long enough to be its text.", 0)] * 6
        labelled = [varied(plain, rng) for _ in range(60)]
    return train(labelled, seed=seed)


def extract(pages: DataFrame, field: Field, html: str = "html", name: str = "text") -> DataFrame:
    """Adds ``name``, the main text: blocks decoded as such, in page order, one line each (empty if there is none).

    Whole pages are read; a missing html is an empty page.  Character references are decoded and white space inside a
    block is one space.  A column called ``name`` is replaced.
    """
    kept = pages.select(*[c for c in pages.columns if c != name])
    names = kept.columns
    place = names.index(html)
    weights = pages.sparkSession.sparkContext.broadcast(field)  # SLOTS x 2 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, known = weights.value, {}

        def text_of(page: str | None) -> str:
            blocks = leaf_blocks(page)
            if not blocks:
                return ""
            slots = [[slot(f, known) for f in features(b, i, len(blocks))] for i, b in enumerate(blocks)]
            if len(known) > 100_000:
                known.clear()
            states = field.decode(field.scores(slots))
            return "\n".join(b.text for b, s in zip(blocks, states, strict=True) if s)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                texts = pa.array([text_of(p.as_py()) for p in piece.column(place)], pa.string())
                yield pa.RecordBatch.from_arrays([*piece.columns, texts], [*names, name])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(name, StringType())]))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = extract(pages, fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
