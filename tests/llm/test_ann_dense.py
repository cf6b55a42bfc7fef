"""Nearest neighbours in a table many times RERANK, with dense groups, against brute force."""

import collections

import numpy as np
import pytest

from textward.llm import ann


@pytest.mark.parametrize("kind", ["near", "rescaled"])
def test_dense_groups_keep_their_nearest(spark, kind):
    r = np.random.default_rng(2)
    n, dimension, dense = 8000, 32, range(1000, 1600)
    x = r.normal(size=(n, dimension)).astype(np.float32)
    x[1000:1600] = x[7] + 1e-3 * r.normal(size=(600, dimension)) if kind == "near" else x[7] * r.uniform(0.5, 2, (600, 1))
    found = collections.defaultdict(list)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    for row in ann.nearest(df).orderBy("query_id", "rank").collect():
        found[row["query_id"]].append(row["vec_id"])
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hits = collections.Counter()
    for q in range(0, n, 50):
        s = np.round(y @ y[q], 12)
        order = [i for i in np.lexsort((np.arange(n), -s)) if i != q][:5]
        hits[q in dense] += len(set(order) & set(found[q]))
    assert hits[True] >= 0.95 * 60 and hits[False] >= 0.95 * 740
