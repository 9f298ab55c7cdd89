"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one valid last token: the one whose predecessor (the prefix before it) ends in a
token that stays apart from it when the two are encoded together. So one token number per prefix holds the encodings
of all prefixes; appending goes on from there, and an edit starts again at the edited place. An Aho-Corasick automaton
of the vocabulary names the tokens that end at each byte.
"""

from __future__ import annotations

import base64
import itertools
import struct
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import of_worker, text_of

#: Entries of a worker's piece cache (its older half goes when full), and of its memory of token pairs (emptied when full).
PIECES, PAIRS = 300_000, 250_000
#: Rows of a batch that are worked on at once.
ROWS = 512


class PrefixBPE:
    """Ranks of byte sequences (rank = id), all single bytes included."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.apart: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}

    @classmethod
    def from_file(cls, content: bytes) -> PrefixBPE:
        return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines())})

    @cached_property
    def ending(self) -> ahocorasick.Automaton:
        """Finds all tokens in a piece, by where they end, as (rank, length)."""
        out = ahocorasick.Automaton()
        for t, r in self.ranks.items():
            out.add_word(t.decode("latin-1"), (r, len(t)))
        out.make_automaton()
        return out

    def merged(self, piece: bytes) -> list[int]:
        """The definition: merge the neighbours of least rank, leftmost first, until none has a rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
            if rank == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def last_merge(self, token: int) -> tuple[int, int]:
        """The two tokens that merge into this one; a single byte is both of its own."""
        found = self.halves.get(token)
        if found is None:
            text, found = self.token[token], (token, token)
            for i in range(1, len(text)):
                a, b = self.ranks.get(text[:i]), self.ranks.get(text[i:])
                whole = a is not None and b is not None and (a < token or i == 1) and (b < token or i == len(text) - 1)
                if whole and self._meet(a, b, token):
                    found = a, b
                    break
            self.halves[token] = found
        return found

    def _meet(self, left: int, right: int, below: int) -> bool:
        """Whether no merge of rank under `below` crosses the seam of these two: their merges there are undone, youngest first."""
        while True:
            if self.ranks.get(self.token[left] + self.token[right], below) < below:
                return False
            a, b = self.last_merge(left)[1], self.last_merge(right)[0]
            if a == left and b == right:
                return True
            # of equal merges the leftmost comes first, so that one at the seam waits for the left side's only
            if b == right or (a != left and left > right):
                below, left = left, a
            else:
                below, right = right + 1, b

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the encoding of both, side by side, is just these two."""
        known = self.apart.get(pair := left << 32 | right)
        if known is None:
            known = self._meet(left, right, 1 << 40)
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            self.apart[pair] = known
        return known

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """last[i] is the last token of piece[: i + 1]; continues the list to the whole piece."""
        begin, done = max(0, len(last) + 1 - self.longest), len(last)
        for at, (t, size) in self.ending.iter(piece[begin:].decode("latin-1")):
            end = begin + at + 1
            if end > done:
                if end > done + 1:
                    break
                if size == end or self.stay_apart(last[end - size - 1], t):
                    last.append(t)
                    done = end
        if done < len(piece):
            raise ValueError("a byte has no token")
        return last

    def backward(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.token[last[at - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.backward(self.extend(piece, []))


class Growing:
    """One piece whose encoding follows appends and edits."""

    def __init__(self, bpe: PrefixBPE, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, piece, bpe.extend(piece, [])

    def append(self, more: bytes) -> None:
        self.piece += more
        self.bpe.extend(self.piece, self.last)

    def replace(self, start: int, end: int, new: bytes) -> None:
        """The prefixes before start keep their tokens."""
        self.piece = self.piece[:start] + new + self.piece[end:]
        del self.last[start:]
        self.bpe.extend(self.piece, self.last)

    def ids(self, upto: int | None = None) -> list[int]:
        """Of the whole piece, or of any prefix."""
        return self.bpe.backward(self.last[: len(self.last) if upto is None else upto])


class EditableText:
    """A text cut into pieces by a pattern; an edit cuts and encodes again only what it can reach."""

    #: A match looks this many characters beyond its end at most.
    REACH = 4

    def __init__(self, bpe: PrefixBPE, pattern: str, text: str = ""):
        self.bpe, self.pattern, self.text = bpe, regex.compile(pattern), text
        self.spans = [m.span() for m in self.pattern.finditer(text)]
        self.tokens = [bpe.encode(text[a:b].encode()) for a, b in self.spans]

    def ids(self) -> list[int]:
        return list(itertools.chain.from_iterable(self.tokens))

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Returns how many pieces were encoded again."""
        keep = sum(1 for _ in itertools.takewhile(lambda s: s[1] + self.REACH <= start, self.spans))
        moved = len(new) - (end - start)
        after = {a + moved: i for i, (a, _) in enumerate(self.spans) if a >= end}
        self.text = self.text[:start] + new + self.text[end:]
        spans, tokens, rest = [], [], len(self.spans)
        for m in self.pattern.finditer(self.text, self.spans[keep - 1][1] if keep else 0):
            if m.start() >= start + len(new) and m.start() in after:  # from here on nothing has changed
                rest = after[m.start()]
                break
            spans.append(m.span())
            tokens.append(self.bpe.encode(m.group().encode()))
        self.spans = self.spans[:keep] + spans + [(a + moved, b + moved) for a, b in self.spans[rest:]]
        self.tokens = self.tokens[:keep] + tokens + self.tokens[rest:]
        return len(tokens)


class _Packed(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, bpe: PrefixBPE):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            ids = self.bpe.encode(piece.encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self) >= PIECES // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _vocabulary(path: str, content) -> PrefixBPE:
    return of_worker(f"bpe {path}", lambda: PrefixBPE.from_file(content.value))


def _encoder(path: str, pattern: str, content):
    """Batches (doc_id, text) to (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = of_worker(f"packed {path}", lambda: _Packed(_vocabulary(path, content)))
        cut = regex.compile(pattern)
        get = packed.__getitem__
        for b in _rows(batches):
            out = []
            for t in b.column(1).to_pylist():
                t = t or ""
                if len(t) < 1 << 22:
                    out.append(b"".join(map(get, cut.findall(t))))
                else:
                    out.append(b"".join(b"".join(get(m.group()) for m in some) for some in itertools.batched(cut.finditer(t), 1 << 16)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return run


def _decoder(path: str, content):
    """Batches (doc_id, ids) to (doc_id, ids, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _vocabulary(path, content).token.__getitem__
        for b in _rows(batches):
            out = [b"".join(map(get, np.frombuffer(x or b"", "<u4").tolist())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "bytes"])

    return run


def _content(spark: SparkSession, path: str):
    """The vocabulary file, of fixed size, as a broadcast."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids are packed as little-endian unsigned 32-bit integers.

    Null texts count as empty, and the empty text has no ids; bytes that are no UTF-8 count as U+FFFD; long texts go
    through in slices of pieces. Repeated rows and ids stay; other columns are ignored; an empty table gives an empty result.
    """
    return _texts(docs, id_col, text_col).mapInArrow(_encoder(path, pattern, _content(docs.sparkSession, path)), "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, bytes): the bytes that the ids stand for; null ids are none."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path, _content(encoded.sparkSession, path)), "doc_id long, ids binary, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one Python worker, without a way through the JVM in between.

    (doc_id, ids, bytes) of every row, under the rules of encode() for nulls, empty and long texts, repeated rows, other
    columns and empty tables.
    """
    content = _content(docs.sparkSession, path)
    forth, back = _encoder(path, pattern, content), _decoder(path, content)
    return _texts(docs, id_col, text_col).mapInArrow(lambda batches: back(forth(batches)), "doc_id long, ids binary, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, under the rules of encode()."""
    both = round_trip(docs, path, pattern)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
