"""Packing documents into training windows by Karmarkar-Karp multiway differencing.

Every document is tokenised and closed by an end id. What fills whole windows is
cut off and makes windows of its own; the rest is a piece (cut again above
`largest` tokens, so that a window holds several). Pieces gather in groups of
`windows` windows. A group starts as one partial partition for each piece: that
piece and empty windows. The two partial partitions of the widest spread merge
again and again, the fullest window of one onto the emptiest of the other, until
one near-equal partition is left. If one of its windows exceeds the capacity, the
group is parted again into one window more.

Groups form inside a task, from the rows as they come, so packing needs no
shuffle and holds one group at a time; a task that runs again packs alike.
Null text counts as empty and gives the end id alone; repeated rows are packed
each; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textward.llm.common import slices, texts_of
from textward.session import ship

CAPACITY = 2048
#: Longest piece of a document's rest, windows in a group, and free tokens a window is planned with.
LARGEST, WINDOWS, SLACK = 512, 128, 24

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Near-equal partition of the positions of `lengths` into `windows` lists."""
    # A partial partition is the list of its windows in use, fullest first: (sum, tree of positions).
    heap = [(-n, i, [(n, i)]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - windows
        if over > 0:
            # Window i of a meets window -1 - i of b; the empty ones of either come last.
            first = len(a) - over
            both = [(a[first + k][0] + b[len(b) - 1 - k][0], (a[first + k][1], b[len(b) - 1 - k][1])) for k in range(over)]
            merged = a[:first] + both + b[: len(b) - over]
        else:
            merged = a + b
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[0][0], made, merged))
        made += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        stack, found = [tree], []
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                found.append(x)
        out.append(sorted(found))
    return out


def pack_group(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of a group; there is one more whenever a window exceeds the capacity."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        parts = differencing(lengths, windows)
        if all(sum(lengths[i] for i in p) <= capacity for p in parts):
            return parts
        windows += 1


class Tokens:
    """Ids as the vocabulary's own library gives them.

    The rank file holds the same vocabulary, and its library is several times as
    fast. A text without two white-space characters in a row needs no look-ahead
    in the pattern, which halves the time again. Only a text with the special
    token's string goes to the library that knows it.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str, special: str = "<|endoftext|>"):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        from textward.llm.bpe import read_ranks

        table = read_ranks(ranks)
        plain = pattern.replace(r"|\s+(?!\S)", "")
        self.full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.fast = tiktoken.Encoding("fast", pat_str=plain, mergeable_ranks=table, special_tokens={})
        self.spaces = re.compile(r"\s\s")
        self.special = special
        self.slow = Tokenizer.from_file(vocabulary)

    def __call__(self, text: str) -> list[int]:
        if self.special in text:
            return self.slow.encode(text, add_special_tokens=False).ids
        return (self.full if self.spaces.search(text) else self.fast).encode_ordinary(text)


@lru_cache(maxsize=2)
def tokens_of(vocabulary: str, ranks: str, pattern: str) -> Tokens:
    return Tokens(vocabulary, ranks, pattern)


def pack(df: DataFrame, vocabulary: str, ranks: str, pattern: str, end: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece, with its sequence and place in it; `with_ids` adds the ids themselves."""
    ship(df.sparkSession)
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenise = tokens_of(vocabulary, ranks, pattern)
        sequence = TaskContext.get().partitionId() << 36
        group: list[list] = []
        held, rows = 0, []
        most = WINDOWS * (capacity - SLACK)

        def flush() -> None:
            nonlocal sequence, held
            for part in pack_group([p[2] for p in group], capacity) if group else []:
                offset = 0
                for i in part:
                    rows.append([*group[i][:5], sequence, offset, *group[i][5:]])
                    offset += group[i][2]
                sequence += 1
            group.clear()
            held = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            rows.clear()
            return made

        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = array("I", tokenise(text or ""))
                    ids.append(end)
                    total, start = len(ids), 0
                    while start < total:
                        n = capacity if total - start >= capacity else min(LARGEST, total - start)
                        if n < capacity and held + n > most:
                            n = max(1, min(n, most - held))
                        piece = ids[start : start + n]
                        row = [doc, start, n, zlib.crc32(piece.tobytes()), total, *([list(piece)] if with_ids else [])]
                        if n == capacity:
                            rows.append([*row[:5], sequence, 0, *row[5:]])
                            sequence += 1
                        else:
                            group.append(row)
                            held += n
                            if held >= most:
                                flush()
                        start += n
                    if len(rows) >= 20_000:
                        yield out()
        flush()
        if rows:
            yield out()

    return texts_of(df).mapInArrow(run, schema)


def padding(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Pad tokens of sequences of these lengths: none at a power of two, else up to the capacity."""
    lengths = np.asarray(lengths, np.int64)
    return int(np.where((lengths & (lengths - 1)) == 0, 0, capacity - lengths).sum())
