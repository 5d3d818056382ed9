"""Operator 2, token counts by a count-only Viterbi search.

An Aho-Corasick automaton over the unigram vocabulary lists all pieces that end at each place of a
text; dynamic programming carries the best score and the number of pieces to that place, nothing
else. It follows the plain encoding of the sentencepiece library in unigram mode (its optimised search,
not the lattice of its n-best lists) to the bit: scores are 32-bit floats; of equal scores the piece
that begins first stays; and where the best score at a place lies more than REBASE from 0, it is taken
off there and from all scores already known behind it, which rounds those once more.

No piece of these vocabularies has a space mark behind another character, so the best way to cut a text
passes between its stretches (space marks and what follows). In the file on the box the mark alone
scores -1e9, so every stretch is rebased behind its mark, and what came before it matters only through
how the scores of its first pieces fall on the grid of 32-bit floats at -1e9. What a stretch adds is
kept for each such case. With other vocabularies whole texts are searched.

The piece file on the box is made for merging; it is read as a unigram lexicon with its scores.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._state import table

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 800_000
STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Whole numbers below this are exact as 32-bit floats.
EXACT = 1 << 24
#: A best score farther from 0 is taken off.
REBASE = 100_000


def rounded(x: float) -> float:
    """x as the nearest 32-bit float; whole numbers stay Python integers."""
    if isinstance(x, int):
        z = -x if x < 0 else x
        if z < EXACT:
            return x
        e = z.bit_length() - 24
        z = (z + (1 << (e - 1)) - 1 + ((z >> e) & 1)) >> e << e
        return -z if x < 0 else z
    m, e = math.frexp(x)
    return math.ldexp(round(math.ldexp(m, 24)), e - 24)


class Lexicon:
    """Pieces with scores; characters without a piece count as their bytes if the vocabulary has byte pieces, else as one."""

    def __init__(self, scores: dict[str, float], byte_fallback: bool, dummy_prefix: bool = True):
        self.whole = all(float(s).is_integer() for s in scores.values())
        kind = int if self.whole else float
        self.scores, self.byte_fallback, self.dummy_prefix = {p: rounded(kind(s)) for p, s in scores.items()}, byte_fallback, dummy_prefix
        self.unknown = rounded(min(self.scores.values(), default=kind(0)) - kind(UNKNOWN_PENALTY))
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if scores:
            self.automaton.make_automaton()
        self.longest = max(map(len, scores), default=1)
        self.grid = self._grid()

    def _grid(self) -> int:
        """Distance of 32-bit floats at the score of the mark; 0 if stretches cannot be kept by it."""
        mark = self.scores.get(MARK, 0)
        apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.scores)
        if not (self.whole and apart and self.dummy_prefix and mark < -8 * REBASE and self.unknown <= mark):
            return 0
        e = (-mark).bit_length() - 24
        others = [s for s in self.scores.values() if s != mark]
        room = 4 * REBASE - 2 * min(others, default=0)
        fits = e > 0 and -mark >> (23 + e) == -mark - room >> (23 + e) == -mark + room >> (23 + e) and mark % (2 << e) == 0
        return 1 << e if fits and max(others, default=0) <= 0 and min(others, default=0) > -REBASE else 0

    def search(self, text: str, before: float = 0) -> tuple[int, float]:
        """Pieces of the best way to cut a text, and the score behind it (less what was taken off) where it is before ahead of it."""
        n, whole, longest = len(text), self.whole, self.longest
        best, pieces = [before] + [None] * n, [0] * (n + 1)
        ends: list[list[tuple[int, float]] | None] = [None] * (n + 1)  # by beginning
        if self.scores:
            for end, (length, score) in self.automaton.iter(text):
                at = end + 1 - length
                if ends[at] is None:
                    ends[at] = [(end + 1, score)]
                else:
                    ends[at].append((end + 1, score))
        for at in range(n):
            b, k = best[at], pieces[at] + 1
            if not -REBASE <= b <= REBASE:
                for end in range(at + 1, min(n, at + longest) + 1):
                    if best[end] is not None:
                        best[end] = rounded(best[end] - b)
                b = 0
            single = False
            for end, score in ends[at] or ():
                score += b
                if not whole or not -EXACT < score < EXACT:
                    score = rounded(score)
                if best[end] is None or score > best[end]:
                    best[end], pieces[end] = score, k
                single |= end == at + 1
            if not single:
                score = rounded(self.unknown + b)
                if best[at + 1] is None or score > best[at + 1]:
                    best[at + 1], pieces[at + 1] = score, k - 1 + (len(text[at].encode("utf-8", "surrogatepass")) if self.byte_fallback else 1)
        return pieces[n], best[n]

    def count(self, text: str) -> int:
        return self.search(text)[0]


class Counts(dict):
    """Stretch without its first space mark -> where a score ahead of it makes a difference, and (pieces, distance behind it) between; fills itself.

    A score ahead matters by its distance d from the grid: a first piece of score s gets d + s rounded
    to the grid, in steps as d grows. Entries live for two generations, so frequent ones stay.
    """

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.half, self.bits = lexicon, lexicon.grid // 2, max(lexicon.grid.bit_length() - 1, 0)
        self.mark = lexicon.scores.get(MARK, 0)
        self.old: dict[str, tuple] = {}
        self.steps: dict[int, list[int]] = {}
        self.off: dict[int, int] = {}  # at most 2 * REBASE + 1 entries
        self.inner = ahocorasick.Automaton()  # pieces without a mark
        self.plain: dict[str, tuple[int, int]] = {}  # what follows a line end
        self.ends_lines = not any("\n" in p for p in lexicon.scores) and lexicon.byte_fallback
        self.firsts: dict[str, tuple] = {"": ((), ())}  # beginnings of pieces with one mark -> steps, and (end, score) of the pieces among them
        if not self.half:
            return
        for piece, score in lexicon.scores.items():
            if MARK not in piece:
                self.inner.add_word(piece, (len(piece), score))
        self.inner.make_automaton()
        self.singles = {p for p in lexicon.scores if len(p) == 1}
        begun = sorted((p[1:], s) for p, s in lexicon.scores.items() if p[0] == MARK and len(p) > 1 and MARK not in p[1:])
        own = dict(begun)
        for piece, _ in begun:
            for n in range(1, len(piece) + 1):
                if (head := piece[:n]) not in self.firsts:
                    ends = self.firsts[head[:-1]][1] + (((n + 1, own[head]),) if head in own else ())
                    self.firsts[head] = tuple(sorted({d for _, s in ends for d in self._steps(s)})), ends

    def off_grid(self, score: int) -> int:
        """Distance from the grid of a score, or of 0 if it will be taken off."""
        if not -REBASE <= score <= REBASE:
            return 0
        if (d := self.off.get(score)) is None:
            d = self.off[score] = score - (rounded(self.mark + score) - self.mark)
        return d

    def _steps(self, score: int) -> list[int]:
        key = score % (4 * self.half)
        if key not in self.steps:
            at = [rounded(-self.mark + d + key) for d in range(-self.half, self.half + 1)]
            self.steps[key] = [d - self.half for d in range(1, len(at)) if at[d] != at[d - 1]]
        return self.steps[key]

    def _begun(self, rest: str) -> tuple:
        """The entry of firsts for the longest known beginning."""
        firsts, n = self.firsts, 1
        found = firsts[""]
        while n <= len(rest) and (more := firsts.get(rest[:n])) is not None:
            found, n = more, n + 1
        return found

    def __missing__(self, rest: str) -> tuple[tuple[int, ...], list, tuple]:
        out = self.old.pop(rest, None)
        if out is None:
            cuts, ends = self._begun(rest)
            out = cuts, [None] * (len(cuts) + 1), ends
        if len(rest) <= 32:
            if len(self) >= CACHE_ENTRIES // 2:
                self.old = dict(self)
                self.clear()
            self[rest] = out
        return out

    def search(self, rest: str, d: int, ends: tuple = (), marked: bool = True) -> tuple[int, int]:
        """Pieces of the mark and rest (or of rest alone) behind a score of d, and the distance from the grid behind them.

        The quick way is for what begins with a mark and a character that are one piece, and has a piece for
        each character: behind the mark its score is taken off and behind that piece its own, which leaves
        the first pieces on the grid and all else exact; a cut behind the bare mark is 1e9 behind and never wins.
        """
        if marked and (not ends or ends[0][0] != 2) or not self.singles.issuperset(rest):
            n, after = self.lexicon.search(MARK * marked + rest, d)
            return n, self.off_grid(after)
        n = len(rest) + marked
        best, pieces = [-(10**15)] * (n + 1), [0] * (n + 1)
        if marked:
            # rounded(), for the binade of the mark
            far, e, up = d - self.mark, self.bits, self.half - 1
            first = (x := far + ends[0][1]) + up + (x >> e & 1) >> e
            for end, score in ends:
                x = far + score
                best[end], pieces[end] = (x + up + (x >> e & 1) >> e) - first << e, 1
        else:
            best[0] = d
        skip = 2 if marked else 1
        for end, (length, score) in self.inner.iter(rest, 1) if marked else self.inner.iter(rest):
            end += skip
            at = end - length
            score += best[at]
            if score > best[end]:
                best[end], pieces[end] = score, pieces[at] + 1
        after, seen = best[n], best[2 * marked :]
        if min(seen) < -REBASE or max(seen) > REBASE:
            base = 0
            for b in seen[:-1]:
                if not -REBASE <= b - base <= REBASE:
                    base = b
            after -= base
        return pieces[n], self.off_grid(after)

    def lines(self, stretch: str, d: int) -> tuple[int, int]:
        """As search, for a stretch with line ends: a character without any piece, behind which the score is taken off."""
        first, *more = stretch.split("\n")
        cuts, known, ends = self[first]
        case = bisect_right(cuts, d)
        if (found := known[case]) is None:
            found = known[case] = self.search(first, d, ends)
        total = found[0]
        for line in more:
            if (found := self.plain.get(line)) is None:
                found = self.search(line, 0, marked=False) if line else (0, 0)
                if len(line) <= 32:
                    if len(self.plain) >= CACHE_ENTRIES // 4:
                        self.plain.clear()
                    self.plain[line] = found
            total += found[0] + 1
        return total, found[1]

    def walk(self, rest: list[str]) -> int:
        """Pieces of stretches in a row, each without its first mark."""
        total = d = 0
        for r in rest:
            if "\n" in r and self.ends_lines:
                n, d = self.lines(r, d)
                total += n
                continue
            cuts, known, ends = self[r]
            case = bisect_right(cuts, d) if cuts else 0
            if (found := known[case]) is None:
                found = known[case] = self.search(r, d, ends)
            n, d = found
            total += n
        return total


def count_tokens(text: str, counts: Counts) -> int:
    """Pieces of a whole text; an empty one has none."""
    lexicon = counts.lexicon
    if not text:
        return 0
    if lexicon.grid and "  " not in text and MARK not in text and text[0] != " ":
        return counts.walk(text.split(" "))
    marked = (MARK if lexicon.dummy_prefix else "") + text.replace(" ", MARK)
    return counts.walk([m.group()[1:] for m in STRETCH.finditer(marked)]) if lexicon.grid else lexicon.count(marked)


@lru_cache(maxsize=2)
def load_counts(path: str) -> Counts:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return Counts(Lexicon({sp.id_to_piece(i): sp.get_score(i) for i in plain}, any(map(sp.is_byte, ids))))


def count_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens for each row of docs (doc_id, text).

    Null or empty text has no tokens. Rows are counted one by one: repeated rows and null or repeated
    doc_ids make no difference; other columns are not read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = load_counts(path)
        for b in batches:
            n = [count_tokens(t.as_py() or "", counts) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document."""
    import public_tokenizers

    return count_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
