"""Operator 10, main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks (text between block-level tags). Each block is read as hashed vectors
of its tag path (tags, classes, ids) and of its words and a few figures; a bidirectional LSTM in numpy
passes over the whole page in both directions and labels every block with the document as context.
The weights in html_model.npz come from html_train.py.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._state import table

PATHS, WORDS, DIM, HIDDEN = 512, 1024, 16, 16
FIGURES = 6
GATHERED = 1 << 19  # embedded words at once
CELLS = 40_000  # blocks with padding in one pass of the network

BLOCK_TAGS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head title caption optgroup option select button".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN_TAGS = frozenset("head title template noscript iframe object svg math canvas audio video datalist".split())
#: Opening one of the second closes an open one of the first kind, up to the nearest of the third.
CLOSES = {"p": BLOCK_TAGS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}}
SCOPES = {"p": frozenset("article aside blockquote body div figure footer form header li main nav section td".split()), "li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table",)), "td": frozenset(("table",)), "th": frozenset(("table",)), "option": frozenset(("select",))}
#: Attributes up to the end of a tag. A quote opens a value only behind =, anywhere else it is a character like others.
ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+"""
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(script|style|textarea)(?=[\s/>]|\Z){ATTRIBUTES}(?:>.*?(?:</\1(?=[\s/>]|\Z)[^>]*(?:>|\Z)|\Z)|\Z)|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S | re.I,
)
NAMES = re.compile(r"""(?<![^\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PIECES = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")


@lru_cache(maxsize=20_000)
def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """What the labeller sees of an element: its tag and the words of class, id and role."""
    out = [tag]
    for m in NAMES.finditer(attributes):
        out += [f"{tag}.{w}" if m[1].lower() != "role" else f"role.{w}" for w in PIECES.findall((m[2] or m[3] or m[4] or "").lower())]
        out += [f".{w}" for w in PIECES.findall((m[2] or m[3] or m[4] or "").lower())]
    return tuple(out)


def blocks(html: str) -> list[tuple[tuple, str, int]]:
    """(path, text, characters in links) of each leaf block with text, in page order.

    Character references are decoded after tags are found; white space is one space. Scripts, styles,
    comments, the head and other elements without text of their own are left out. Tags may be left
    open, also by the end of a cut page; a piece of a tag there is markup.
    """
    out: list[tuple[tuple, str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = hidden = links = at = 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not hidden:
            parts.append(raw)
            if links:
                linked += len(raw)

    def close_block() -> None:
        nonlocal linked
        if parts:
            whole = SPACES.sub(" ", unescape("".join(parts))).strip()
            if whole:
                out.append((tuple(m for _, m in stack), whole, linked))
            parts.clear()
        linked = 0

    def pop(k: int) -> None:
        nonlocal hidden, links
        for tag, _ in stack[k:]:
            hidden -= tag in HIDDEN_TAGS
            links -= tag == "a"
        del stack[k:]

    for m in TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag, closing = m[3].lower(), m[2]
        if tag in BLOCK_TAGS:
            close_block()
        elif tag == "br":
            text(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag not in BLOCK_TAGS and stack[k][0] in BLOCK_TAGS:
                    break
            continue
        if tag in VOID_TAGS:
            continue
        for opened, closers in CLOSES.items():
            if tag in closers:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == opened:
                        pop(k)
                        break
                    if stack[k][0] in SCOPES[opened]:
                        break
        if m[4].rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        stack.append((tag, _marks(tag, m[4])))
        hidden += tag in HIDDEN_TAGS
        links += tag == "a"
    text(html[at:])
    close_block()
    return out


@lru_cache(maxsize=200_000)
def _slot(word: str, slots: int) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % slots


@lru_cache(maxsize=20_000)
def _path_slots(path: tuple) -> tuple[int, ...]:
    inline = path[-6:]
    return tuple({_slot(x, PATHS) for marks in path for x in marks} | {_slot("last:" + x, PATHS) for marks in inline[-2:] for x in marks[:1]}) or (0,)


def features(page: list[tuple[tuple, str, int]]) -> tuple[list[tuple[int, ...]], list[list[int]], list[list[float]]]:
    paths, words, figures = [], [], []
    n = max(1, len(page))
    for j, (path, text, linked) in enumerate(page):
        paths.append(_path_slots(path))
        words.append([_slot(w, WORDS) for w in text.lower().split(" ")])
        figures.append([min(1.0, len(text) / 400), min(1.0, len(text) / 60), min(1.0, linked / len(text)), j / n, float(text[-1] in ".!?…"), min(1.0, n / 50)])
    return paths, words, figures


def _means(slots: list, embedding: np.ndarray) -> np.ndarray:
    """Mean vector of each row of slots (none is empty), gathered GATHERED slots at a time."""
    sizes = np.array([len(s) for s in slots])
    flat = np.fromiter((x for s in slots for x in s), np.int64, sizes.sum())
    ends = np.cumsum(sizes)
    out = np.zeros((len(slots), embedding.shape[1]), embedding.dtype)
    for lo in range(0, len(flat), GATHERED):
        hi = min(lo + GATHERED, len(flat))
        first, last = np.searchsorted(ends, [lo, hi - 1], "right")
        starts = np.concatenate([[0], ends[first:last] - lo])
        out[first : last + 1] += np.add.reduceat(embedding[flat[lo:hi]], starts, axis=0)
    return out / sizes[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pass(x: np.ndarray, mask: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """States of an LSTM over (time, pages, inputs); where mask is 0 the state stays."""
    steps, pages, d = x.shape
    h, c = np.zeros((pages, HIDDEN), x.dtype), np.zeros((pages, HIDDEN), x.dtype)
    out = np.empty((steps, pages, HIDDEN), x.dtype)
    inputs = x @ w[:d] + b
    for t in range(steps):
        z = inputs[t] + h @ w[d:]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        new = gates[:, HIDDEN : 2 * HIDDEN] * c + gates[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c = np.where(m, new, c)
        h = np.where(m, gates[:, 2 * HIDDEN :] * np.tanh(new), h)
        out[t] = h
    return out


def label(pages: list[list[tuple]], model: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each page a boolean per block: part of the main text."""
    result: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((j for j in range(len(pages)) if pages[j]), key=lambda j: len(pages[j]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * len(pages[order[hi]]) <= CELLS:
            hi += 1
        some = order[lo:hi]
        sizes = [len(pages[j]) for j in some]
        steps = sizes[-1]
        f = [features(pages[j]) for j in some]
        flat = np.concatenate([_means([s for x in f for s in x[0]], model["path"]), _means([s for x in f for s in x[1]], model["word"]), np.array([s for x in f for s in x[2]], np.float32)], axis=1).astype(np.float32)
        x, mask = np.zeros((steps, len(some), flat.shape[1]), np.float32), np.zeros((steps, len(some)), bool)
        at = 0
        for c, n in enumerate(sizes):
            x[:n, c], mask[:n, c] = flat[at : at + n], True
            at += n
        both = np.concatenate([_pass(x, mask, model["wf"], model["bf"]), _pass(x[::-1], mask[::-1], model["wb"], model["bb"])[::-1]], axis=2)
        yes = both @ model["v"] + model["v0"] > 0
        for c, (j, n) in enumerate(zip(some, sizes, strict=True)):
            result[j] = yes[:n, c]
        lo = hi
    return result


def load_model() -> dict[str, np.ndarray]:
    with np.load(Path(__file__).with_name("html_model.npz")) as z:
        return {k: z[k] for k in z.files}


def main_text(pages: list[str | None], model: dict[str, np.ndarray]) -> list[str]:
    cut = [blocks(p or "") for p in pages]
    return ["\n".join(b[1] for b, yes in zip(page, keep, strict=True) if yes) for page, keep in zip(cut, label(cut, model), strict=True)]


def extract_pages(pages: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    Null or empty html, and pages without a main block, have empty text. Rows are read one by one:
    repeated rows and null or repeated ids make no difference; further columns are not read; an empty
    table gives an empty one. Pages of any length are read whole, every word of every block included,
    in batches of up to 4 MB of html. A value with an opening quote but no closing one, and a tag
    without its end, reach to the end of the page.
    """
    weights = model or load_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo = 0
            lengths = [len(x) for x in (s.as_py() or "" for s in b.column("html"))]
            while lo < len(b):
                hi, total = lo, 0
                while hi < len(b) and (hi == lo or total + lengths[hi] <= 1 << 22):
                    total += lengths[hi]
                    hi += 1
                text = main_text(b.column("html").slice(lo, hi - lo).to_pylist(), weights)
                yield pa.RecordBatch.from_arrays([b.column("page_id").slice(lo, hi - lo), b.column("url").slice(lo, hi - lo), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])
                lo = hi

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
