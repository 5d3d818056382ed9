"""Operator 8, byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that the encoding of that prefix ends with.
PrefixEncoder stores it for each prefix. A token that ends at a place is that token if it starts at
the end of a stored prefix and the pair (last token there, token) is one that merging would leave
alone; the pair check walks the merge trees of both. Appending bytes goes on from the stored
prefixes, and after an edit prefixes are filled again only until they agree with the old ones.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._state import table

#: Entries of each cache of encoded pieces in a Python worker.
CACHE_ENTRIES = 500_000


class Vocabulary:
    """Ranks of a tiktoken file: id = rank = order of merging."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.ending = ahocorasick.Automaton()  # tokens as strings of one character a byte
        for token, rank in ranks.items():
            self.ending.add_word(token.decode("latin-1"), (len(token), rank))
        if ranks:
            self.ending.make_automaton()
        self.longest = max(map(len, ranks), default=0)
        self.halves: dict[int, tuple[int, int]] = {}
        self.known: dict[int, bool] = {}

    def split(self, t: int) -> tuple[int, int]:
        """The two tokens whose merge made t; t twice for a single byte."""
        if t not in self.halves:
            token = self.tokens[t]
            parts = [self.ranks[bytes([b])] for b in token]
            while len(parts) > 2:
                merges = [(self.ranks.get(self.tokens[a] + self.tokens[b], t), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
                rank, i = min(merges)
                if rank >= t:
                    break
                parts[i : i + 2] = [rank]
            self.halves[t] = (t, t) if len(parts) == 1 else (parts[0], parts[-1])
        return self.halves[t]

    def stable(self, a: int, b: int) -> bool:
        """Whether merging leaves the tokens a, b next to each other as they are.

        Merges run in order of rank. Going back in time, the younger of the two tokens is taken
        apart, and at each moment the two that touch must not have had an earlier merge of their own.
        """
        if (hit := self.known.get(a << 32 | b)) is not None:
            return hit
        x, y, before = a, b, len(self.tokens)
        out = None
        while out is None:
            merged = self.ranks.get(self.tokens[x] + self.tokens[y])
            if merged is not None and merged < before:
                out = False
            elif x > y and len(self.tokens[x]) > 1:
                before, x = x, self.split(x)[1]
            elif len(self.tokens[y]) > 1:
                before, y = y + 1, self.split(y)[0]
            elif len(self.tokens[x]) > 1:
                before, x = x, self.split(x)[1]
            else:
                out = True
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[a << 32 | b] = out
        return out


class PrefixEncoder:
    """Encoding of one byte string that can grow and be edited.

    last[k] is the last token of the encoding of data[:k], for every k (-1 at 0). An automaton lists the
    tokens that end at k, the longest first; the first whose beginning ends in a token that it is stable
    behind is the only one.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.replace(len(self.data), len(self.data), more)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """data[start:end] = new; the number of prefixes that were worked out anew.

        Prefixes up to start keep their last tokens. Behind the edit the work ends as soon as as many
        prefixes in a row as the longest token has bytes agree with the old ones: the next tokens then
        depend on nothing else, so the rest stays as well.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = data = self.data[:start] + new + self.data[end:]
        n, v = len(data), self.vocabulary
        known, stable, longest = v.known, v.stable, v.longest
        self.last = last = old[: start + 1]
        same, behind, done = 0, start + len(new), start
        for end, (length, t) in v.ending.iter(data.decode("latin-1"), max(0, start - longest + 1)) if n > start else ():
            if end < done:
                continue
            if begin := end + 1 - length:
                if (ok := known.get(last[begin] << 32 | t)) is None:
                    ok = stable(last[begin], t)
                if not ok:
                    continue
            last.append(t)
            done = end + 1
            if end >= behind:
                same = same + 1 if old[done - shift] == t else 0
                if same >= longest:
                    last += old[done + 1 - shift :]
                    return done - start
        return n - start

    def ids(self) -> list[int]:
        out, at, tokens = [], len(self.data), self.vocabulary.tokens
        while at:
            out.append(t := self.last[at])
            at -= len(tokens[t])
        return out[::-1]


class Kept(dict):
    """Entries live for two generations of up to CACHE_ENTRIES / 2 each, so that those often asked for stay."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def keep(self, key: str, value: bytes) -> None:
        if len(self) >= CACHE_ENTRIES // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Pieces(Kept):
    """Piece of text -> its ids as little-endian 32-bit integers; fills itself."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> bytes:
        if (out := self.old.pop(piece, None)) is not None:
            self.keep(piece, out)
            return out
        data = piece.encode("utf-8", "surrogatepass")
        one = self.vocabulary.ranks.get(data)
        ids = [one] if one is not None else PrefixEncoder(self.vocabulary, data).ids()
        out = np.array(ids, "<u4").tobytes()
        if len(piece) <= 64:
            self.keep(piece, out)
        return out


class Spaced(Kept):
    """What stands between two spaces -> the ids of the first space and it; fills itself.

    A space behind a character that is no white space always begins a new piece, so such stretches
    are split on their own, and most are found here without the pattern.
    """

    def __init__(self, pieces: Pieces, split: Callable[[str], list[str]]):
        super().__init__()
        self.pieces, self.split = pieces, split

    def __missing__(self, stretch: str) -> bytes:
        if (out := self.old.pop(stretch, None)) is not None:
            self.keep(stretch, out)
            return out
        out = b"".join(map(self.pieces.__getitem__, self.split(" " + stretch)))
        if len(stretch) <= 32 and "\n" not in stretch:
            self.keep(stretch, out)
        return out


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[Vocabulary, Pieces]:
    v = Vocabulary(path)
    return v, Pieces(v)


@lru_cache(maxsize=2)
def spaced(path: str, pattern: str) -> Spaced:
    return Spaced(codec(path)[1], splitter(pattern).findall)


#: What \s is to the tokenizer: characters with the property White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(maxsize=4)
def splitter(pattern: str):
    return regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


#: White space before a space: there the stretches between spaces are not split on their own.
MIXED = regex.compile(f"[{SPACE}] ")


def encode(text: str, path: str, pattern: str) -> Iterator[bytes]:
    """Ids of a text as little-endian 32-bit integers, in blocks of up to 50,000 pieces or stretches.

    The short way by spaces holds for the pattern of this vocabulary family, where only white space
    and one leading space can go with what follows.
    """
    if MIXED.search(text):
        found, ids = (m.group() for m in splitter(pattern).finditer(text)), codec(path)[1].__getitem__
    else:
        first, *rest = text.split(" ")
        yield b"".join(map(codec(path)[1].__getitem__, splitter(pattern).findall(first)))
        found, ids = iter(rest), spaced(path, pattern).__getitem__
    while block := list(islice(found, 50_000)):
        yield b"".join(map(ids, block))


def decode(ids: bytes, path: str) -> bytes:
    return b"".join(map(codec(path)[0].tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of long, if with_ids), ids_sha256 and decoded_sha256 for each row of docs.

    Null or empty text has no tokens. Rows are encoded one by one, so repeated rows and null or
    repeated doc_ids make no difference; other columns are not read; an empty table gives an empty
    one. Texts over a million code points are encoded block by block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                a, b, n, all_ids = hashlib.sha256(), hashlib.sha256(), 0, []
                for ids in encode(text.as_py() or "", path, pattern):
                    n += len(ids) // 4
                    a.update(ids)
                    b.update(decode(ids, path))
                    if with_ids:
                        all_ids.append(np.frombuffer(ids, "<u4"))
                out.append((doc_id, n, a.hexdigest(), b.hexdigest(), np.concatenate(all_ids).astype("i8") if with_ids else None))
                size += n
                if size > 2_000_000:
                    yield _batch(out, with_ids)
                    out, size = [], 0
            yield _batch(out, with_ids)

    ids = "ids array<bigint>, " if with_ids else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_tokens long, {ids}ids_sha256 string, decoded_sha256 string")


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "n_tokens": pa.array([r[1] for r in rows], pa.int64())}
    if with_ids:
        cols["ids"] = pa.array([r[4] for r in rows], pa.list_(pa.int64()))
    cols |= {"ids_sha256": pa.array([r[2] for r in rows], pa.string()), "decoded_sha256": pa.array([r[3] for r in rows], pa.string())}
    return pa.RecordBatch.from_pydict(cols)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
