"""Byte-level BPE encoding and decoding in numpy.

The text is split by the tokenizer's pattern. The distinct pieces of a slice are
sorted into buckets by length; a bucket is a padded matrix of token ids with a
matrix of the ranks of neighbouring pairs beside it. In each round every row
merges its leftmost pair of minimum rank, found by a hashed pair table, is
compacted by one column, and leaves the matrix once no pair can merge. Decoding
gathers the bytes of all ids at once.

Null text counts as empty and encodes to no ids. Repeated rows and equal ids are
handled row by row; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from textward.llm.common import map_texts, texts_of

#: Characters with the property White_Space, as the pattern means by its class of spaces.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
_NONE = np.int32(2**31 - 1)
#: Widths of the padded matrices. A matrix takes a round for each merge, so its work grows with the square of its
#: width; a piece of more bytes, which no text with spaces has, makes the same merges in the same order through a heap.
WIDTHS = (4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 256, 512, 1024)
#: Characters of text split into pieces at once.
SEGMENT = 1 << 18
#: Characters of text whose new pieces are encoded together.
GROUP = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """Ranks of pairs of ids: open addressing with linear probing, all lookups of an array at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            mine = left[free]
            first = mine[np.unique(slot[mine], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; the largest int32 where the pair doesn't merge."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], _NONE)
        todo = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
            found = self.keys[slot[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != np.uint64(2**64 - 1))]
        return out


class BytePairEncoder:
    """Encoder and decoder for a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]"))
        self.cut = regex.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, value = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), value.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.pairs = PairTable(keys, np.array(value, np.int32))
        by_rank = sorted(ranks.items(), key=lambda x: x[1])
        top = by_rank[-1][1] + 1
        self.lengths = np.zeros(top, np.int64)
        for token, rank in by_rank:
            self.lengths[rank] = len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(token for token, _ in by_rank), np.uint8)

    def segments(self, text: str):
        """The text in cuts that no match of the pattern crosses: each is before a space after a non-space."""
        start = 0
        while len(text) - start > SEGMENT:
            m = self.cut.search(text, start + SEGMENT)
            if m is None:
                break
            yield text[start : m.start()]
            start = m.start()
        yield text[start:] if start else text

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and the offsets of each piece's ids."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids: list[np.ndarray | None] = [None] * len(pieces)
        counts = np.zeros(len(pieces), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for width in WIDTHS:
            rows = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if len(rows):
                for at, tokens, count in self._bucket([pieces[i] for i in rows], sizes[rows], width):
                    done.append((rows[at], tokens, count))
                    counts[rows[at]] = count
        for i in np.flatnonzero(sizes > low):
            ids[i] = np.array(self.encode_long(pieces[i]), np.int32)
            counts[i] = len(ids[i])
        offsets = np.concatenate(([0], np.cumsum(counts)))
        flat = np.empty(offsets[-1], np.int32)
        for rows, tokens, count in done:
            used = np.arange(tokens.shape[1]) < count[:, None]
            flat[(offsets[rows][:, None] + np.arange(tokens.shape[1]))[used]] = tokens[used]
        for i in np.flatnonzero(sizes > low):
            flat[offsets[i] : offsets[i + 1]] = ids[i]
        return flat, offsets

    def _bucket(self, pieces: list[bytes], sizes: np.ndarray, width: int):
        """Rows that end in a round, with their ids and how many there are."""
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        tokens, count, rows = self.single[raw], sizes.copy(), np.arange(len(pieces))
        columns = np.arange(width)
        rank = self.pairs(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(len(pieces), width - 1)
        rank[columns[: width - 1] >= (count - 1)[:, None]] = _NONE
        while len(rows):
            at = rank.argmin(axis=1)
            every = np.arange(len(rows))
            best = rank[every, at]
            live = best != _NONE
            if not live.all():
                end = ~live
                yield rows[end], tokens[end], count[end]
                rows, tokens, count, rank, at, best = rows[live], tokens[live], count[live], rank[live], at[live], best[live]
                every = np.arange(len(rows))
                if not len(rows):
                    return
            width = max(2, int(count.max()))
            tokens, rank = tokens[:, :width], rank[:, : width - 1]
            columns = np.arange(width)
            shift = np.minimum(columns + (columns > at[:, None]), width - 1)
            tokens = np.take_along_axis(tokens, shift, axis=1)
            tokens[every, at] = best
            shift = np.minimum(columns[:-1] + (columns[:-1] >= at[:, None]), width - 2)
            rank = np.take_along_axis(rank, shift, axis=1)
            count = count - 1
            rank[columns[:-1] >= (count - 1)[:, None]] = _NONE
            has = np.flatnonzero(at > 0)
            rank[has, at[has] - 1] = self.pairs(tokens[has, at[has] - 1], tokens[has, at[has]])
            has = np.flatnonzero(at < count - 1)
            rank[has, at[has]] = self.pairs(tokens[has, at[has]], tokens[has, at[has] + 1])

    def encode_long(self, piece: bytes) -> list[int]:
        """The same merges in the same order for a piece wider than any matrix, by a heap over a linked list."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        text, ranks = list(range(len(ids) + 1)), self.ranks
        ends = text[1:]

        def rank(i: int) -> int | None:
            j = after[i]
            return ranks.get(piece[text[i] : ends[j]]) if j < len(ids) else None

        heap = [(r, i, ends[after[i]]) for i in range(len(ids) - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        alive = [True] * len(ids)
        while heap:
            r, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= len(ids) or ends[after[i]] != end or rank(i) != r:
                continue
            j = after[i]
            ids[i], ends[i], alive[j] = r, ends[j], False
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (found := rank(k)) is not None:
                    heapq.heappush(heap, (found, k, ends[after[k]]))
        return [t for t, a in zip(ids, alive, strict=True) if a]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, gathered at once."""
        sizes = self.lengths[ids]
        total = int(sizes.sum())
        if not total:
            return b""
        step = np.ones(total, np.int64)
        step[0] = self.starts[ids[0]]
        edges = np.cumsum(sizes)[:-1]
        step[edges] = self.starts[ids[1:]] - self.starts[ids[:-1]] - sizes[:-1] + 1
        return self.blob[np.cumsum(step)].tobytes()


class PieceCache:
    """Pieces met before and their ids; emptied when it holds `limit` pieces, so a worker's memory is bounded."""

    def __init__(self, encoder: BytePairEncoder, limit: int = 400_000):
        self.encoder, self.limit = encoder, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.strings: list[str] = []
        self.flat, self.offsets, self.filled = np.empty(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0

    def learn(self, pieces: set[str]) -> None:
        flat, offsets = self.encoder.encode_pieces([p.encode() for p in pieces])
        n, k = len(self.index), len(pieces)
        while len(self.flat) < self.filled + len(flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while len(self.offsets) < n + k + 1:
            self.offsets = np.concatenate((self.offsets, np.zeros_like(self.offsets)))
        self.flat[self.filled : self.filled + len(flat)] = flat
        self.offsets[n : n + k + 1] = self.filled + offsets
        self.filled += len(flat)
        words, ends = list(map(str, flat.tolist())), offsets.tolist()
        self.strings += [",".join(words[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.index.update(zip(pieces, range(n, n + k), strict=True))

    def ids(self, texts: list[str]):
        """(position of the text, its next ids, the same as decimals joined by commas), in order.

        The texts go through in groups of about `GROUP` characters; what is new in
        a group is encoded at once.
        """
        group: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for segment in self.encoder.segments(text):
                group.append((k, self.encoder.pattern.findall(segment)))
                size += len(segment)
                if size >= GROUP:
                    yield from self._group(group)
                    group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[tuple[int, list[str]]]):
        pieces = set().union(*(p for _, p in group))
        new = {p for p in pieces if p not in self.index}
        if len(self.index) + len(new) > self.limit:
            self.clear()
            new = pieces
        if new:
            self.learn(new)
        for k, found in group:
            if not found:
                continue
            at = list(map(self.index.__getitem__, found))
            rows = np.array(at, np.int64)
            starts = self.offsets[rows]
            sizes = self.offsets[rows + 1] - starts
            step = np.ones(int(sizes.sum()), np.int64)
            step[0] = starts[0]
            step[np.cumsum(sizes)[:-1]] = starts[1:] - starts[:-1] - sizes[:-1] + 1
            yield k, self.flat[np.cumsum(step)], ",".join(map(self.strings.__getitem__, at))


@lru_cache(maxsize=2)
def encoder_of(path: str, pattern: str) -> PieceCache:
    """One encoder for each worker and vocabulary file."""
    return PieceCache(BytePairEncoder(read_ranks(path), pattern))


def encode(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every text; null text gives no ids."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = encoder_of(path, pattern)
        parts: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
        for k, ids, _ in cache.ids([t or "" for t in batch.column(1).to_pylist()]):
            parts[k].append(ids)
        rows = [np.concatenate(p) if p else np.empty(0, np.int32) for p in parts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_texts(texts_of(df), work, "doc_id long, ids array<int>")


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the bytes decoded from them, for every text.

    The digests are fed segment by segment, so that a very long text needs no
    list of all its ids.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cache = encoder_of(path, pattern)
        n = batch.num_rows
        counts, encoded, decoded = [0] * n, [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
        for k, ids, said in cache.ids([t or "" for t in batch.column(1).to_pylist()]):
            if counts[k]:
                encoded[k].update(b",")
            encoded[k].update(said.encode())
            decoded[k].update(cache.encoder.decode(ids))
            counts[k] += len(ids)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array([x.hexdigest() for x in encoded], pa.string()), pa.array([x.hexdigest() for x in decoded], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_texts(texts_of(df), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
