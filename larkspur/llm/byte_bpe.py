"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

Distinct pieces of a batch are encoded together: pieces of similar length form
a padded matrix of token ids, and in each round every row merges its leftmost
pair of least rank, found by a hashed lookup of pairs; merged cells are closed
by compaction and finished rows leave. A long piece is a matrix of one row, and
its round merges all pairs of that least rank from left to right, unless a
merge makes a pair of a lower rank, which would have to come first: then only
the leftmost pair is merged.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import lean

LONG_PIECE = 256  # bytes from which a piece is a matrix of its own
CACHE_CHUNKS = 300_000  # encoded strings that a Python worker keeps
MATRIX_CELLS = 1 << 20
NONE = np.int64(1 << 40)
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Bpe:
    """Encoder and decoder for a file of ranks (lines of base64 token and rank)."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(self.ranks[a] << 32 | self.ranks[b], rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (a := token[:k]) in self.ranks and (b := token[k:]) in self.ranks]
        self._hash_pairs(np.array([p for p, _ in pairs], np.uint64), np.array([r for _, r in pairs], np.int64))
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[str, bytes] = {}

    def _hash_pairs(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing with linear probing; the longest probe bounds a lookup."""
        bits = int(np.ceil(np.log2(max(2, 4 * len(keys)))))
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << bits, NONE, np.int64)
        slots, todo, self.probes = (keys * _MULT) >> self.shift, np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            at = slots[todo].astype(np.int64)
            free = self.keys[at] == np.iinfo(np.uint64).max
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[at[won]], self.values[at[won]] = keys[todo[won]], ranks[todo[won]]
            todo = np.delete(todo, won)
            slots[todo] = (slots[todo] + np.uint64(1)) & np.uint64(mask)
        self.mask = np.int64(mask)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's concatenation, NONE where it is no token."""
        key = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = ((key * _MULT) >> self.shift).astype(np.int64)
        found = self.keys[at] == key
        out = np.where(found, self.values[at], NONE)
        open_ = np.flatnonzero(~found & (self.keys[at] != np.iinfo(np.uint64).max))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at.flat[open_] = (at.flat[open_] + 1) & self.mask
            hit = self.keys[at.flat[open_]] == key.flat[open_]
            out.flat[open_[hit]] = self.values[at.flat[open_[hit]]]
            open_ = open_[~hit & (self.keys[at.flat[open_]] != np.iinfo(np.uint64).max)]
        return out

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Encode pieces of similar length, one padded row each."""
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        grid = np.full((len(pieces), width), -1, np.int64)
        inside = np.arange(width)[None, :] < lengths[:, None]
        grid[inside] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((len(pieces), width), NONE, np.int64)
        both = inside[:, 1:]
        ranks[:, :-1][both] = self.pair_ranks(grid[:, :-1][both], grid[:, 1:][both])
        out: list[np.ndarray | None] = [None] * len(pieces)
        rows = np.arange(len(pieces))
        while True:
            at = ranks.argmin(1)
            k = np.arange(len(rows))
            best = ranks[k, at]
            done = best == NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[rows[r]] = grid[r, : lengths[r]]
                stay = ~done
                if not stay.any():
                    return out
                width = int(lengths[stay].max())
                grid, ranks, rows, lengths, at, best = grid[stay, :width], ranks[stay, :width], rows[stay], lengths[stay], at[stay], best[stay]
                k = np.arange(len(rows))
            grid[k, at] = best
            # Close the gap at `at` + 1: columns beyond it move one to the left.
            cols = np.arange(width)[None, :]
            take = np.minimum(cols + (cols > at[:, None]), width - 1)
            grid, ranks = np.take_along_axis(grid, take, 1), np.take_along_axis(ranks, take, 1)
            lengths = lengths - 1
            grid[k, np.minimum(lengths, width - 1)] = -1
            ranks[k, np.maximum(lengths - 1, 0)] = NONE
            ranks[k, np.minimum(lengths, width - 1)] = NONE
            left = at > 0
            if left.any():
                ranks[k[left], at[left] - 1] = self.pair_ranks(grid[k[left], at[left] - 1], best[left])
            right = at + 1 < lengths
            ranks[k[right], at[right]] = self.pair_ranks(best[right], grid[k[right], at[right] + 1])
            ranks[k[~right], at[~right]] = NONE

    def _row(self, piece: bytes) -> np.ndarray:
        """One long piece: the same merges in the same order, all pairs of the least rank in one round where none of lower rank comes up."""
        grid = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.pair_ranks(grid[:-1], grid[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == best)
            # Of overlapping pairs every second one, from the left.
            first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
            at = at[(np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))) % 2 == 0]
            merged, new = self._merged(grid, ranks, at, best)
            if len(at) > 1 and self._lower(grid, at, best, new):
                merged, new = self._merged(grid, ranks, at[:1], best)
            grid, ranks = merged, new
        return grid

    def _merged(self, grid: np.ndarray, ranks: np.ndarray, at: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
        """The row with the pairs at `at` merged, and its ranks of pairs."""
        out = grid.copy()
        out[at] = rank
        out = np.delete(out, at + 1)
        place = at - np.arange(len(at))
        new = np.delete(ranks, at)
        touched = np.unique(np.concatenate([place - 1, place]))
        touched = touched[(touched >= 0) & (touched < len(new))]
        new[touched] = self.pair_ranks(out[touched], out[touched + 1])
        return out, new

    def _lower(self, grid: np.ndarray, at: np.ndarray, rank: int, new: np.ndarray) -> bool:
        """Whether the merges make a pair of a lower rank, also beside a pair that is not merged yet."""
        if len(new) and new.min() < rank:
            return True
        beside = at[:-1][np.diff(at) == 2] + 2
        return bool(len(beside) and (self.pair_ranks(np.full(len(beside), rank), grid[beside]) < rank).any())

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers. A piece that is a token stands for itself."""
        out: list[bytes | None] = [None] * len(pieces)
        short: list[int] = []
        for k, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(p) >= LONG_PIECE:
                out[k] = self._row(p).astype("<u4").tobytes()
            else:
                short.append(k)
        short.sort(key=lambda k: len(pieces[k]))
        while short:
            # A bucket: pieces up to a quarter longer than its first, as many as fit the matrix.
            most = max(len(pieces[short[0]]) + 2, len(pieces[short[0]]) * 5 // 4)
            n = 1
            while n < len(short) and len(pieces[short[n]]) <= most and (n + 1) * most <= MATRIX_CELLS:
                n += 1
            bucket, short = short[:n], short[n:]
            for k, ids in zip(bucket, self._matrix([pieces[k] for k in bucket]), strict=True):
                out[k] = ids.astype("<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Texts are cut at single spaces between other characters, where the pattern always cuts too."""
        cut, new = [], {}
        for text in texts:
            chunks = _at_spaces(text)
            cut.append(chunks)
            for c in chunks:
                if c not in self.cache:
                    new[c] = None
        split = {c: [p.encode() for p in self.pattern.findall(c)] for c in new}
        pieces = list({p: None for ps in split.values() for p in ps})
        coded = dict(zip(pieces, self.encode_pieces(pieces), strict=True))
        for c, ps in split.items():
            new[c] = b"".join([coded[p] for p in ps])
        cache = self.cache
        out = [b"".join([new[c] if (x := cache.get(c)) is None else x for c in chunks]) for chunks in cut]
        if len(cache) + len(new) > CACHE_CHUNKS:
            cache.clear()
        cache.update((c, x) for c, x in new.items() if len(c) <= 64)
        return out

    def decode(self, ids: bytes) -> bytes:
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        lengths = self.lengths[tokens]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        return self.bytes[np.repeat(self.starts[tokens] - (ends - lengths), lengths) + np.arange(ends[-1])].tobytes()


def _at_spaces(text: str) -> list[str]:
    """Cut before each space that has no other white space on either side."""
    parts = text.split(" ")
    out, held = [], parts[0]
    for a, b in zip(parts[:-1], parts[1:], strict=True):
        if a and b and not a[-1].isspace() and not b[0].isspace():
            out.append(held)
            held = " " + b
        else:
            held += " " + b
    out.append(held)
    return out


_coders: dict[tuple[str, str], Bpe] = {}


def coder(path: str, pattern: str) -> Bpe:
    """One coder a Python worker."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Bpe(path, pattern)
    return _coders[path, pattern]


def _code(path: str, pattern: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            i = 0
            while i < len(texts):
                j, size, part = i, 0, []
                while j < len(texts) and size < 1 << 20:
                    part.append(texts[j].as_py() or "")
                    size += len(part[-1])
                    j += 1
                coded = bpe.encode(part)
                plain = [bpe.decode(c) for c in coded]
                n = pa.array([len(c) // 4 for c in coded], pa.int64())
                if digests:
                    cols = [pa.array([hashlib.sha256(x).hexdigest() for x in each], pa.string()) for each in (coded, plain)]
                else:
                    whole = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(c) // 4 for c in coded)]), pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32)))
                    cols = [whole, pa.array(plain, pa.binary())]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), n, *cols], names=["doc_id", "n_tokens", "ids", "decoded"])
                i = j

    return run


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode it again: (doc_id, n_tokens, ids array<int>, decoded binary).

    With digests, ids and decoded are lower-case SHA-256 hex strings instead,
    made where the ids are, so that they need not be moved. ranks_path is a
    file that every executor has. No special tokens. Null and empty texts have
    no tokens. One row for each row of docs, repeated or not, in any order;
    other columns are ignored.
    """
    lean(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = "ids string, decoded string" if digests else "ids array<int>, decoded binary"
    return docs.mapInArrow(_code(ranks_path, pattern, digests), f"doc_id long, n_tokens long, {kinds}")


def encoded(docs: DataFrame, **options) -> DataFrame:
    import public_tokenizers

    out = byte_bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digests=True, **options)
    return out.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The multilingual vocabulary over all of documents."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
