"""Main text of web pages by a recurrent labeller of blocks.

A page is read into its leaf blocks in page order.  Each block has a vector of its path of tags (with
words of class, id and role), a vector of its hashed words, and a few sizes.  A bidirectional LSTM in
numpy reads the whole sequence in both directions and says for each block whether it is main text.

The labeller is fitted on a bounded sample of pages.  Its labels come from the pages' own semantic
elements, and each sampled page is also shown in variants: with containers under other names, and with
headers, sidebars, notices, adverts, forms and reader comments put in, whose label is known because they
were put there.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.batches import slices
from tickloom.llm.words import word_hashes

#: Bounds of what the labeller is fitted on: pages, bytes of all pages, blocks of an example.
SAMPLE_PAGES, SAMPLE_BYTES, SAMPLE_BLOCKS = 160, 16_000_000, 80
VARIANTS, EPOCHS, HIDDEN = 2, 12, 12
PATH_DIM, WORD_DIM, SIZES = 96, 64, 4
INPUT = PATH_DIM + WORD_DIM + SIZES
#: Blocks that are labelled at a time.
CELLS = 8192

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub"
    " sup time tt u var wbr".split())
#: Elements that a start tag closes when they are still open above it, as HTML has it.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

MAIN_TAGS, MAIN_WORDS = frozenset({"article", "main"}), frozenset("content post entry story article main".split())
OTHER_TAGS = frozenset("head nav header footer aside form menu dialog button select textarea".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb header footer sidebar aside related widget"
    " notice cookie consent popup modal newsletter subscribe share social comment comments commentlist reply copyright".split())
_TOKEN = re.compile(r"[a-z0-9]+")
_COMMENT_END, _SHORT_COMMENT = re.compile(r"--!?>"), re.compile(r"<!---?>")


@dataclass
class Block:
    path: tuple[tuple[str, tuple[str, ...]], ...]
    text: str
    linked: int
    label: int = 0


class _Leaves(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.silent = self.anchors = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(tuple(e for e in self.open if e[0] not in INLINE), text, self.linked))
        self.parts.clear()
        self.linked = 0

    def _pop(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                for name, _ in self.open[k:]:
                    self.silent -= name in SILENT
                    self.anchors -= name == "a"
                del self.open[k:]
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
        else:
            self._flush()
            # A block closes an open paragraph, and an item its earlier sibling.
            if any(name == "p" for name, _ in self.open):
                self._pop("p")
            if self.open and self.open[-1][0] in CLOSED_BY.get(tag, ()):
                self._pop(self.open[-1][0])
        if tag not in VOID:
            words = tuple(dict.fromkeys(w for name, value in attrs if name in ("class", "id", "role") for w in _TOKEN.findall((value or "").lower())))
            self.open.append((tag, words))
            self.silent += tag in SILENT
            self.anchors += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        self._pop(tag)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """The end of a comment; without one the comment goes to the end of the page."""
        short = _SHORT_COMMENT.match(self.rawdata, i)
        end = short or _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        """Whatever else begins with `<!` ends at the next `>`, marked sections included."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else len(self.rawdata)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            self.linked += len(data) * (self.anchors > 0)

    def close(self) -> None:
        super().close()
        self._flush()


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks in page order, references decoded and white space put together; comments and scripts are left out."""
    if not html:
        return []
    reader = _Leaves()
    reader.feed(html)
    reader.close()
    return reader.blocks


def weak_labels(found: list[Block]) -> None:
    """Main text is what lies in an article or main element, or one named so, and in nothing named otherwise."""
    def kind(block: Block, tags: frozenset, names: frozenset) -> bool:
        return any(tag in tags or names & set(words) for tag, words in block.path)

    inside = [kind(b, MAIN_TAGS, MAIN_WORDS) for b in found]
    for block, main in zip(found, inside, strict=True):
        block.label = int((main or not any(inside)) and not kind(block, OTHER_TAGS, OTHER_WORDS))


_NAMES = {
    "article": [("article", ()), ("main", ()), ("div", ("content",)), ("div", ("post",)), ("section", ("entry",)), ("div", ("story", "main"))],
    "nav": [("nav", ()), ("div", ("menu",)), ("div", ("navbar",)), ("ul", ("navigation",)), ("div", ("breadcrumb",))],
    "footer": [("footer", ()), ("div", ("footer",)), ("div", ("copyright",))],
    "ad": [("div", ("ad",)), ("div", ("advert",)), ("aside", ("banner",)), ("div", ("sponsored", "promo"))],
}
_PUT_IN = [
    [("header", ()), ("div", ("header",))], [("aside", ()), ("div", ("sidebar",)), ("div", ("related", "widget"))],
    [("div", ("cookie", "notice")), ("div", ("consent", "popup"))], [("form", ()), ("form", ("newsletter", "subscribe"))],
    [("section", ("comments",)), ("ol", ("commentlist",)), ("div", ("comment", "reply"))], [("div", ("share", "social"))],
    [("div", ("ad",)), ("div", ("advertisement",))],
]


def variant(page: list[Block], others: list[str], rng: random.Random) -> list[Block]:
    """The page with its containers renamed and blocks of other kinds put in at any place."""
    chosen = {name: rng.choice(options) for name, options in _NAMES.items()}

    def renamed(element: tuple[str, tuple[str, ...]]) -> tuple[str, tuple[str, ...]]:
        return chosen["ad"] if "ad" in element[1] else chosen.get(element[0], element)

    out = [Block(tuple(map(renamed, b.path)), b.text, b.linked, b.label) for b in page]
    for options in rng.sample(_PUT_IN, rng.randint(1, 4)):
        at = rng.randint(0, len(out))
        base = out[at - 1].path if at else (("html", ()), ("body", ()))
        base = base[:rng.randint(min(2, len(base)), max(2, len(base)))]
        inner = rng.choice([(), (("p", ()),), (("div", ()), ("p", ())), (("ul", ()), ("li", ())), (("h3", ()),)])
        out[at:at] = [Block((*base, rng.choice(options), *inner), rng.choice(others), 0, 0) for _ in range(rng.randint(1, 4))]
    return out


@lru_cache(maxsize=65536)
def _path_vector(path: tuple[tuple[str, tuple[str, ...]], ...]) -> np.ndarray:
    """Hashed tags and words of the path; those of the last element count twice."""
    out = np.zeros(PATH_DIM, np.float32)
    for depth, (tag, words) in enumerate(path):
        for token in (tag, *words):
            out[crc32(token.encode()) % PATH_DIM] += 2.0 if depth == len(path) - 1 else 1.0
    return np.minimum(out, 3.0)


def vectors(found: list[Block]) -> np.ndarray:
    out = np.zeros((len(found), INPUT), np.float32)
    texts = [b.text.encode() for b in found]
    ends = np.cumsum([len(t) + 1 for t in texts])
    words, at = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
    block = np.searchsorted(ends, at, "right")
    cells = np.bincount(block * WORD_DIM + (words % np.uint64(WORD_DIM)).astype(np.int64), minlength=len(found) * WORD_DIM).reshape(len(found), WORD_DIM)
    count = cells.sum(axis=1)
    out[:, PATH_DIM:PATH_DIM + WORD_DIM] = cells / np.maximum(np.sqrt((cells.astype(float) ** 2).sum(axis=1)), 1)[:, None] * 0.5
    size = np.array([len(b.text) for b in found], float)
    out[:, -4] = np.log1p(size) / 8
    out[:, -3] = np.array([b.linked for b in found]) / np.maximum(size, 1)
    out[:, -2] = np.log1p(count) / 6
    out[:, -1] = 1.0
    for k, b in enumerate(found):
        out[k, :PATH_DIM] = _path_vector(b.path)
    return out


@dataclass(frozen=True)
class Labeller:
    """Weights of both directions and of the output: (input, recurrent) forward, the same backward, output."""

    weights: tuple[np.ndarray, ...]

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of main text for every block of every page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        while order:
            # Pages of like length together, so that little is padded.
            many = max(1, min(len(order), CELLS // len(pages[order[-1]])))
            part, order = order[-many:], order[:-many]
            x, mask = _padded([pages[k] for k in part])
            p = _forward(self.weights, x, mask)[0]
            for j, k in enumerate(part):
                out[k] = p[:len(pages[k]), j]
        return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), INPUT), np.float32)
    mask = np.zeros((longest, len(pages)), np.float32)
    for k, page in enumerate(pages):
        x[:len(page), k], mask[:len(page), k] = page, 1
    return x, mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pass(w: np.ndarray, u: np.ndarray, x: np.ndarray, mask: np.ndarray, steps: range) -> tuple[np.ndarray, list]:
    """One direction: hidden states, and what its gradient needs.  Padding leaves the state as it is."""
    h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
    drive = x @ w
    states, saved = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
    for t in steps:
        gates = drive[t] + h @ u
        i, f, o = (_sigmoid(gates[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN:])
        m = mask[t][:, None]
        new_c = f * c + i * g
        squashed = np.tanh(new_c)
        saved.append((t, h, c, i, f, o, g, squashed, m))
        c = m * new_c + (1 - m) * c
        h = m * o * squashed + (1 - m) * h
        states[t] = h
    return states, saved


def _forward(weights: tuple[np.ndarray, ...], x: np.ndarray, mask: np.ndarray) -> tuple:
    w1, u1, w2, u2, out = weights
    ahead, saved1 = _pass(w1, u1, x, mask, range(len(x)))
    back, saved2 = _pass(w2, u2, x, mask, range(len(x) - 1, -1, -1))
    both = np.concatenate([ahead, back, x], axis=2)
    return _sigmoid(both @ out), both, saved1, saved2


def _pass_gradient(u: np.ndarray, x: np.ndarray, grad: np.ndarray, saved: list) -> tuple[np.ndarray, np.ndarray]:
    dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
    drive, du = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(u)
    for t, h, c, i, f, o, g, squashed, m in reversed(saved):
        dh = dh + grad[t]
        inner = dh * m
        d_c = inner * o * (1 - squashed ** 2) + dc * m
        gates = np.concatenate([d_c * g * i * (1 - i), d_c * c * f * (1 - f), inner * squashed * o * (1 - o), d_c * i * (1 - g ** 2)], axis=1)
        drive[t] = gates
        du += h.T @ gates
        dh = gates @ u.T + dh * (1 - m)
        dc = d_c * f + dc * (1 - m)
    return np.einsum("tbi,tbj->ij", x, drive, optimize=True), du


def train(pages: list[list[Block]], seed: int = 7, epochs: int = EPOCHS) -> Labeller:
    """Fits the labeller by Adam on cross-entropy; the same pages give the same weights."""
    rng = np.random.default_rng(seed)
    start = lambda a, b: (rng.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
    weights = [start(INPUT, 4 * HIDDEN), start(HIDDEN, 4 * HIDDEN), start(INPUT, 4 * HIDDEN), start(HIDDEN, 4 * HIDDEN), np.zeros(2 * HIDDEN + INPUT, np.float32)]
    data = sorted(((vectors(p), np.array([b.label for b in p], np.float32)) for p in pages if p), key=lambda d: len(d[0]))
    batches = []
    for k in range(0, len(data), 32):
        x, mask = _padded([d[0] for d in data[k:k + 32]])
        y = np.zeros(mask.shape, np.float32)
        for j, (_, labels) in enumerate(data[k:k + 32]):
            y[:len(labels), j] = labels
        batches.append((x, mask, y))
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            x, mask, y = batches[k]
            p, both, saved1, saved2 = _forward(tuple(weights), x, mask)
            error = (p - y) * mask / mask.sum()
            back = error[:, :, None] * weights[4][None, None, :]
            g1 = _pass_gradient(weights[1], x, back[:, :, :HIDDEN], saved1)
            g2 = _pass_gradient(weights[3], x, back[:, :, HIDDEN:2 * HIDDEN], saved2)
            step += 1
            for j, g in enumerate((*g1, *g2, np.einsum("tb,tbk->k", error, both))):
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                weights[j] = weights[j] - 0.02 * (first[j] / (1 - 0.9 ** step)) / (np.sqrt(second[j] / (1 - 0.999 ** step)) + 1e-8)
    return Labeller(tuple(w.astype(np.float32) for w in weights))


def fit(pages: DataFrame, html_col: str = "html", limit: int = SAMPLE_PAGES, seed: int = 7) -> Labeller:
    """Fits on the `limit` different pages of the lowest hashes, as far as SAMPLE_BYTES bytes go for all of them.

    A page that no longer fits is passed over; if none fits, the smallest of them is the example.  Of a page
    with more than SAMPLE_BLOCKS blocks, a run of so many is shown.  Without any page that has a block the
    labeller is fitted on the variants of one made-up page.
    """
    html = pages.select(pages[html_col].cast("string").alias("html")).filter(F.octet_length("html") > 0)
    html = html.select("html", F.xxhash64("html").alias("at"))
    # Copies have one hash, so they count once; only hashes and sizes are shuffled.
    sizes = html.groupBy("at").agg(F.max(F.octet_length("html")).alias("size")).orderBy(F.pmod("at", F.lit(1 << 30)), "at").limit(limit).collect()
    chosen, left = [], SAMPLE_BYTES
    for r in sizes:
        if r["size"] <= left:
            chosen.append(r["at"])
            left -= r["size"]
    chosen = chosen or [r["at"] for r in sorted(sizes, key=lambda r: (r["size"], r["at"]))[:1]]
    rows = html.filter(F.col("at").isin(chosen)).groupBy("at").agg(F.min("html").alias("html")).collect() if chosen else []
    examples = [b for r in sorted(rows, key=lambda r: r["at"]) if (b := blocks(r["html"]))]
    examples = examples or [blocks("<html><body><nav><ul><li><a>x</a></ul></nav><article><h1>One title</h1><p>One long sentence of text.</article><footer>y</footer>")]
    rng = random.Random(seed)
    for page in examples:
        weak_labels(page)
    starts = [rng.randint(0, len(p) - SAMPLE_BLOCKS) if len(p) > SAMPLE_BLOCKS else 0 for p in examples]
    examples = [p[k:k + SAMPLE_BLOCKS] for p, k in zip(examples, starts, strict=True)]
    others = [b.text for page in examples for b in page]
    shown = []
    for page in examples:
        shown += [page, *(variant(page, others, rng) for _ in range(VARIANTS))]
    return train(shown, seed)


def extract(pages: DataFrame, labeller: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_main) of every page, from its whole html.

    `text` joins the main blocks by one space, empty if there is none; a null html is an empty page.
    Null ids and urls stay null, repeated rows are read each, other columns are left out.  A block whose score
    is exactly one half is not main.  An empty table gives an empty table, and a page of any length is read
    whole, its blocks in runs of bounded size.
    """
    source = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, rows=64):
                found = [blocks(html) for html in batch.column(2).to_pylist()]
                scores = labeller.scores([vectors(f) if f else np.zeros((0, INPUT), np.float32) for f in found])
                main = [[b.text for b, p in zip(f, s, strict=True) if p > 0.5] for f, s in zip(found, scores, strict=True)]
                texts = [" ".join(m) for m in main]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([len(f) for f in found], pa.int64()), pa.array([len(m) for m in main], pa.int64()),
                ], ["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks long, n_main long")
