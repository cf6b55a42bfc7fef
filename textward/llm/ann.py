"""Approximate nearest neighbours by additive quantisation.

A unit vector is approximated by the sum of one full-dimensional codeword from
each codebook. The codebooks are fitted to residuals on a bounded sample and then
refitted in turn, each to what the others leave; every vector is encoded by beam search. With
the codes the norm of the approximation is stored. A query makes one lookup table
a codebook; the sum of a row's entries over its norm is its approximate cosine.
Vectors of the best `RERANK` codes are ranked again by their exact cosine.

Equal vectors are one class, encoded once, with the smallest ids that a result can
need. Classes of equal codes, such as rescaled or nearly equal vectors, are one
candidate, scored once; all of them are ranked exactly where their code is chosen,
so the pairs compared grow with a dense group's size times its queries.
Queries and codes meet in blocks of bounded size; a task goes through a run of
blocks of codes and keeps each query's best on the way, and the best of the runs
merge in levels, so that no task gathers what grows with the table.

Vectors that are null or zero or hold null or non-finite components take no part,
nor do rows without vec_id. Vectors of each length have an index of their own. Of
rows that repeat an id the nearest vector counts, once. Ties, to twelve
decimals of the cosine, go to the smaller vec_id. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.session import Scratch, ship

#: Rows the codebooks are fitted to, codebooks, codewords in each, and beams.
SAMPLE, BOOKS, WORDS, BEAMS = 12_000, 16, 256, 6
#: Codes of a query whose vectors are ranked exactly; codes and queries in a block.
RERANK, BLOCK, QUERIES = 256, 8192, 2048
#: Blocks of codes that one task goes through for a block of queries, and queries scored at once.
RUN, AT_ONCE = 32, 256


@dataclass
class AdditiveCodes:
    """Codebooks of shape (books, words, dimension) and their inner products."""

    books: np.ndarray

    def __post_init__(self) -> None:
        flat = self.books.reshape(-1, self.books.shape[2])
        self.cross = (flat @ flat.T).astype(np.float32)
        self.norms = np.einsum("ij,ij->i", flat, flat).astype(np.float32)

    @staticmethod
    def fit(x: np.ndarray, seed: int = 5, refits: int = 2) -> AdditiveCodes:
        r = np.random.default_rng(seed)
        books, left = [], x.astype(np.float32)
        for _ in range(BOOKS):
            words = left[r.choice(len(left), WORDS, replace=len(left) < WORDS)].copy()
            for _ in range(8):
                near = ((words**2).sum(1) - 2 * left @ words.T).argmin(1)
                sums = np.zeros_like(words)
                np.add.at(sums, near, left)
                n = np.bincount(near, minlength=WORDS)
                words[n > 0] = sums[n > 0] / n[n > 0, None]
            near = ((words**2).sum(1) - 2 * left @ words.T).argmin(1)
            left = left - words[near]
            books.append(words)
        model = AdditiveCodes(np.stack(books))
        for _ in range(refits):
            codes = model.encode(x)[0]
            books = model.books.copy()
            left = x - books[np.arange(BOOKS), codes].sum(1)
            for m in range(BOOKS):
                # Each codebook in turn moves to the mean of what the others leave to it.
                left += books[m][codes[:, m]]
                sums, n = np.zeros_like(books[m], np.float64), np.bincount(codes[:, m], minlength=WORDS)
                np.add.at(sums, codes[:, m], left)
                books[m][n > 0] = (sums[n > 0] / n[n > 0, None]).astype(np.float32)
                left -= books[m][codes[:, m]]
            model = AdditiveCodes(books)
        return model

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes by beam search, and the norms of the approximations."""
        flat = self.books.reshape(-1, x.shape[1])
        out, norms = [np.empty((0, BOOKS), np.uint8)], [np.empty(0)]
        for i in range(0, len(x), 512):
            part = x[i : i + 512].astype(np.float32)
            n = len(part)
            # Distance of each codeword by itself; cross terms come from the inner products.
            own = self.norms - 2 * part @ flat.T
            codes = np.zeros((n, 1, 0), np.int64)
            cost = np.zeros((n, 1), np.float32)
            for m in range(BOOKS):
                lo = m * WORDS
                more = cost[:, :, None] + own[:, None, lo : lo + WORDS]
                for k in range(m):
                    more = more + 2 * self.cross[codes[:, :, k], lo : lo + WORDS]
                more = more.reshape(n, -1)
                keep = min(BEAMS, more.shape[1])
                best = np.argpartition(more, keep - 1, axis=1)[:, :keep]
                cost = np.take_along_axis(more, best, 1)
                parent, word = best // WORDS, best % WORDS + lo
                codes = np.concatenate((np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]), axis=2)
            top = codes[np.arange(n), cost.argmin(1)]
            norms.append(np.linalg.norm(flat[top].sum(1), axis=1))
            out.append((top - np.arange(BOOKS) * WORDS).astype(np.uint8))
        return np.concatenate(out), np.concatenate(norms).astype(np.float32)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dimension)


def _unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    y /= np.maximum(np.abs(y).max(axis=1, keepdims=True), 1e-300)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


class Best:
    """The best codes of a block of queries, over the blocks of codes that are added."""

    def __init__(self, books: np.ndarray, raw: bytes):
        dimension = books.shape[2]
        count = len(raw) // (8 + 4 * dimension)
        self.ids = np.frombuffer(raw, np.int64, count)
        queries = np.frombuffer(raw, np.float32, count * dimension, 8 * count).reshape(count, dimension)
        self.tables = [np.einsum("qd,mwd->mwq", queries[i : i + AT_ONCE], books).astype(np.float32) for i in range(0, count, AT_ONCE)]
        self.held = [(np.empty((t.shape[2], 0), np.float32), np.empty((t.shape[2], 0), np.int64), np.empty((t.shape[2], 0), np.int64)) for t in self.tables]

    def add(self, size: int, raw: bytes) -> None:
        """A block of codes: their hashes, norms and codewords."""
        h1, h2 = np.frombuffer(raw, np.int64, size), np.frombuffer(raw, np.int64, size, 8 * size)
        norms = np.maximum(np.frombuffer(raw, np.float32, size, 16 * size), 1e-12)
        code = np.frombuffer(raw, np.uint8, size * BOOKS, 20 * size).reshape(size, BOOKS)
        for i, table in enumerate(self.tables):
            found = np.zeros((size, table.shape[2]), np.float32)
            for b in range(BOOKS):
                found += table[b][code[:, b]]
            found /= norms[:, None]
            top = np.argpartition(-found, min(RERANK, size) - 1, axis=0)[: min(RERANK, size)].T
            s, a, b = self.held[i]
            s = np.concatenate((s, np.take_along_axis(found.T, top, 1)), axis=1)
            a, b = np.concatenate((a, h1[top]), axis=1), np.concatenate((b, h2[top]), axis=1)
            if s.shape[1] > RERANK:
                keep = np.argpartition(-s, RERANK - 1, axis=1)[:, :RERANK]
                s, a, b = (np.take_along_axis(x, keep, 1) for x in (s, a, b))
            self.held[i] = (s, a, b)

    def rows(self, run: int) -> pa.RecordBatch:
        """(query_id, block, best), a row for each query."""
        width = self.held[0][0].shape[1]
        s, a, b = (np.concatenate([h[k] for h in self.held]).ravel() for k in range(3))
        found = pa.StructArray.from_arrays([pa.array(-s), pa.array(a), pa.array(b)], ["s", "h1", "h2"])
        offsets = pa.array(np.arange(len(self.ids) + 1, dtype=np.int32) * width)
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(np.full(len(self.ids), run)), pa.ListArray.from_arrays(offsets, found)], ["query_id", "block", "best"])


def usable(df: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite & F.exists("embedding", lambda c: c != 0))


def nearest(df: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k nearest rows of each row whose id is divisible by `every`: query_id, rank, vec_id, score.

    Vectors of different lengths have no cosine, so each length has an index of its own.
    """
    ship(df.sparkSession)
    rows = usable(df)
    sizes = sorted(r[0] for r in rows.select(F.size("embedding")).distinct().collect())
    found = [_nearest(rows.where(F.size("embedding") == n), n, k, every) for n in sizes]
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(lambda a, b: a.unionByName(b), found, empty) if len(found) != 1 else found[0]


def _nearest(rows: DataFrame, dimension: int, k: int, every: int) -> DataFrame:
    """`nearest` among vectors of one length."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "ann")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashed = rows.select("vec_id", "embedding", F.xxhash64("vec_id").alias("h"))
    cut = hashed.select("h", "vec_id").orderBy("h", "vec_id").limit(SAMPLE).agg(F.max("h")).first()[0]
    if cut is None:
        return empty
    held = hashed.where(F.col("h") <= cut).orderBy("h", "vec_id").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    codes = AdditiveCodes.fit(_unit(np.stack(held.to_list())))
    shared = spark.sparkContext.broadcast(codes)  # a bounded model: codebooks only

    # Classes of equal vectors, with the k + 1 smallest ids; first within a batch, then salted, then together.
    def distinct(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            seen: dict[bytes, list[int]] = {}
            for i, v in enumerate(x):
                seen.setdefault(v.tobytes(), []).append(i)
            heads = [hashlib.blake2b(v, digest_size=16).digest() for v in seen]
            hashes = np.frombuffer(b"".join(heads), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), pa.array([np.unique(ids[at])[: k + 1].tolist() for at in seen.values()], pa.list_(pa.int64())), pa.array(list(seen), pa.binary())],
                ["h1", "h2", "ids", "vector"],
            )

    merged = lambda d, *by: d.groupBy(*by).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"), F.first("vector").alias("vector"))
    once = rows.mapInArrow(distinct, "h1 long, h2 long, ids array<long>, vector binary").withColumn("salt", F.pmod(F.element_at("ids", 1), F.lit(64)))
    classes = scratch.write(merged(merged(once, "h1", "h2", "salt"), "h1", "h2"), "classes")

    def encoded(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, dimension)
            if len(x):
                c, norms = shared.value.encode(_unit(x))
                c = [r.tobytes() for r in c]
                heads = np.frombuffer(b"".join(hashlib.blake2b(r, digest_size=16).digest() for r in c), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads[:, 0].copy()), pa.array(heads[:, 1].copy()), pa.array(c, pa.binary()), pa.array(norms)], ["ids", "vector", "h1", "h2", "codes", "norm"])

    # From here on h1 and h2 name a code; classes that share one are told apart by their vectors alone.
    kept = scratch.write(classes.select("ids", "vector").mapInArrow(encoded, "ids array<long>, vector binary, h1 long, h2 long, codes binary, norm float"), "encoded")
    scratch.drop("classes")
    classes = kept.select("h1", "h2", "ids", "vector")
    coded = scratch.write(kept.groupBy("h1", "h2").agg(F.min("codes").alias("codes"), F.min("norm").alias("norm")), "codes")
    n = coded.count()
    if not n:
        return empty
    blocks = -(-n // BLOCK)
    coded = coded.select("h1", "h2", "codes", "norm").withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.lit(blocks)))

    def pack_rows(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        payload = [t.column(0).to_numpy().tobytes(), t.column(1).to_numpy().tobytes(), t.column(3).to_numpy().astype(np.float32).tobytes(), b"".join(t.column(2).to_pylist())]
        return pa.table({"block": t.column(4).slice(0, 1), "n": [t.num_rows], "codes": [b"".join(payload)]})

    packed = coded.groupBy("block").applyInArrow(pack_rows, "block long, n long, codes binary")

    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "embedding").distinct()
    asked = scratch.write(asked, "queries")
    m = asked.count()
    if not m:
        return empty
    groups = -(-m // QUERIES)

    def pack_queries(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x = t.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
        return pa.table({"part": t.column(2).slice(0, 1), "queries": [t.column(0).to_numpy().tobytes() + _unit(x).astype(np.float32).tobytes()]})

    questions = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).groupBy("part").applyInArrow(pack_queries, "part long, queries binary")

    # Every block of queries meets every run of blocks of codes, by an equi-join on both numbers.
    runs = -(-blocks // RUN)
    left = packed.withColumn("run", F.col("block") % runs).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    right = questions.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
    met = left.join(right, ["run", "part"]).select("run", "part", "n", "codes", "queries").sortWithinPartitions("run", "part")

    def score(batches):
        name, best = None, None
        for batch in batches:
            for run, part, size, raw, asked_raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (run, part) != name:
                    if best is not None:
                        yield best.rows(name[0])
                    name, best = (run, part), Best(shared.value.books, asked_raw)
                best.add(size, raw)
        if best is not None:
            yield best.rows(name[0])

    best = met.mapInArrow(score, "query_id long, block long, best array<struct<s:float,h1:bigint,h2:bigint>>")
    width = runs
    while width > 1:
        width = -(-width // 64)
        best = best.withColumn("block", F.pmod("block", F.lit(width))).groupBy("query_id", "block").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, RERANK).alias("best"))
    chosen = scratch.write(best.select("query_id", F.explode("best").alias("c")).select("query_id", "c.h1", "c.h2").distinct(), "chosen")

    # Exact cosines on the original vectors.
    pairs = chosen.join(classes, ["h1", "h2"]).join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").select("query_id", "ids", "vector", "q")

    def exact(batches):
        for batch in batches:
            if batch.num_rows:
                y = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(-1, dimension)
                x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
                value = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value)], ["query_id", "ids", "score"])

    scored = pairs.mapInArrow(exact, "query_id long, ids array<long>, score double").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id")  # each task keeps k rows a query before the shuffle
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
