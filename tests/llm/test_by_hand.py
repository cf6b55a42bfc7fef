"""Operators with learned parts, against plain versions of what they say they do; edge cases of rows and columns."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textward.llm import ann, bpe, langid, line_dedup, minhash, packing, quality, rules, secrets, suffix_dedup
from textward.llm.queries import QUERIES

public = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _words(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(n))


def _corpus(n=240):
    r = random.Random(3)
    kinds = {"aa": "abcdef", "bb": "defghij", "cc": "xyzéü"}
    return [(i, _words(r, kinds[k], r.randint(1, 40)), k, "s", 0) for i in range(n) for k in [sorted(kinds)[i % 3]]]


def test_language_by_hand(spark):
    """Word first, then the longest known order of n-grams, counted and weighed with dictionaries alone."""
    rows = [*_corpus(), (900, None, "aa", "s", 0), (901, "12 !", "bb", "s", 0), (902, "w" * 3000, "cc", "s", 0), (903, "qqq", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.learn(docs)).collect()}
    import zlib

    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    counts: dict[tuple, Counter] = {}
    split = lambda t: "".join(c.lower() if c.isalpha() else " " for c in t or "").split()
    for i, text, lang, *_ in rows:
        if lang is None or held[i]:
            continue
        for w in split(text):
            counts.setdefault((lang, 0), Counter())[w] += 1
            for n in (4, 3, 2, 1):
                padded = f"^{w}$" if n > 1 else w
                for k in range(len(padded) - n + 1):
                    counts.setdefault((lang, n), Counter())[padded[k : k + n]] += 1
    langs = ("aa", "bb", "cc")
    table = {n: {} for n in range(5)}
    kept = {k: Counter({x: v for x, v in c.items() if v >= 2}) for k, c in counts.items()}
    for n in range(5):
        keys = set().union(*(kept.get((g, n), Counter()) for g in langs))
        for key in keys:
            table[n][key] = [math.log((kept.get((g, n), Counter())[key] + 0.5) / (sum(kept.get((g, n), Counter()).values()) + 0.5 * len(keys))) for g in langs]
    for i, text, *_ in rows:
        sums, seen = np.zeros(3), 0
        words = split(text)
        for w in words:
            row = table[0].get(w)
            for n in (4, 3, 2, 1):
                if row is None:
                    padded = f"^{w}$" if n > 1 else w
                    found = [table[n][g] for k in range(len(padded) - n + 1) if (g := padded[k : k + n]) in table[n]]
                    row = np.mean(found, axis=0) if found else None
            if row is not None:
                sums, seen = sums + row, seen + 1
        if not words:
            assert got[i] == (held[i], "und", 0.0)
        else:
            weight = min(seen, langid.EVIDENCE) / max(seen, 1)
            best = int(np.argmax(sums))
            assert got[i][:2] == (held[i], langs[best]) and abs(got[i][2] - 1 / np.exp(weight * (sums - sums[best])).sum()) < 1e-9


def test_tokens_equal_the_library():
    """The ids that packing counts are those of the vocabulary's own library."""
    tokens = packing.Tokens(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    r = random.Random(5)
    bits = ["word", "Word's", "don't", " ", "  ", "\n", "\n\n", "\t", "12", "1234567", "é", "ß", "😀", "漢字", "...", "<|endoftext|>", "\u00a0", "\u3000", "_", "-", "a" * 50, "\u0301", "\r\n", "'S", "'ll"]
    for _ in range(1500):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 30)))
        assert tokens(text) == tokens.slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_pads_little(spark):
    r = random.Random(2)
    docs = spark.createDataFrame([(i, _words(r, "abcdefgh", r.randint(1, 400))) for i in range(3000)], "doc_id long, text string").coalesce(1)
    out = packing.pack(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).toPandas()
    sizes = out.groupby("sequence_id")["length"].sum().to_numpy()
    assert sizes.max() <= packing.CAPACITY and packing.padding(sizes) <= 0.02 * sizes.sum()
    assert (out.sort_values(["doc_id", "start"]).groupby("doc_id")["length"].sum() == out.groupby("doc_id")["doc_tokens"].first()).all()


def test_long_pieces_are_merged_alike(spark):
    """Pieces over every width of the matrices, and texts over a segment, give the library's ids."""
    import base64

    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    texts = ["".join(r.choice("abcdeé") for _ in range(n)) for n in (200, 300, 600, 1000, 1500, 4000)] + ["word " * 60_000, "x" * 3000 + " y" * 3000, None, ""]
    rows = {x["doc_id"]: x["ids"] for x in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, public.PATTERN).collect()}
    assert all(rows[i] == library.encode_ordinary(t or "") for i, t in enumerate(texts))


def test_vectors_of_several_lengths_and_repeated_ids(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=4 if i % 3 else 3).tolist()) for i in range(90)] + [(7, r.normal(size=4).tolist()), (None, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found: dict[int, list] = {}
    for x in ann.nearest(df).orderBy("query_id", "rank").collect():
        found.setdefault(x["query_id"], []).append(x["vec_id"])
    vectors = [(i, np.array(v)) for i, v in rows if i is not None]
    assert set(found) == {0, 50}
    for q in (0, 50):
        own = dict(vectors)[q]
        scores: dict[int, float] = {}
        for i, v in vectors:
            if i != q and len(v) == len(own):
                scores[i] = max(scores.get(i, -2), round(float(v @ own / np.linalg.norm(v) / np.linalg.norm(own)), 12))
        assert found[q] == sorted(scores, key=lambda i: (-scores[i], i))[:5]


def test_quality_scores_are_sums_of_bins(spark):
    """A score is the logistic of the model's additions, whatever the order of rows; ties and empty texts too."""
    r = random.Random(8)
    rows = [(i, _words(r, "aeiourst" if i % 3 else "#{}<>|", 60)) for i in range(200)] + [(300, None), (301, ""), (302, "same words here"), (303, "same words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    one = {x["doc_id"]: x["score"] for x in quality.score(docs, model).collect()}
    two = {x["doc_id"]: x["score"] for x in quality.score(docs.orderBy(F.desc("doc_id")).repartition(5), quality.learn(docs.repartition(7), labels)).collect()}
    assert one == two and one[302] == one[303] and one[300] == one[301] and all(0 <= s <= 1 for s in one.values())
    held = [i for i in range(200) if not (one[i] >= 0.3) == (i % 3 > 0)]
    assert len(held) <= 4


EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name, query in QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def _odd(spark):
    """Clashing names, null and repeated ids, null and empty and long texts."""
    r = random.Random(11)
    line = "a line of some length that several of these documents have in common"
    texts = [_words(r, "abcdefgh", 60) + "\n" + line for _ in range(6)] + [None, "", "short", "long " * 60_000]
    rows = [(i if i < 8 else None, t, "aa", "s", 0) for i, t in enumerate(texts)] + [(0, texts[0], "aa", "s", 0), (1, "another text for the same id " * 3, "aa", "s", 0)]
    names = ("lang_pred", "lang_score", "n_lines", "n_removed", "kept", "size", "key", "id", "first", "top", "a", "b", "__id", "__gone", "component", "h1", "ids", "score", "spans")
    return spark.createDataFrame(rows, DOCS).withColumns({n: F.lit("mine") for n in names}), names, len(rows)


def test_odd_rows_in_operators(spark):
    docs, _, n = _odd(spark)
    path = public.path("byte_bpe_multi_50k.tiktoken")
    assert bpe.digests(docs, path, public.PATTERN).count() == n
    assert secrets.find(docs).count() == n
    assert langid.predict(docs, langid.learn(docs)).count() == n
    assert quality.score(docs, quality.learn(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))).count() == n
    assert suffix_dedup.remove_repeats(docs).count() >= n
    assert minhash.near_duplicates(docs).count() >= n
    assert rules.judge(docs).count() == n
    assert packing.pack(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).count() >= n
    out = line_dedup.dedup_lines(docs)
    assert out.count() == n and out.columns == [c for c in docs.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]


def test_repeated_ids_keep_their_lines_apart(spark):
    rows = [(1, "line number one is here"), (1, "line number two stands there"), (2, "line number one is here"), (3, "line number two stands there")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["text"]) for x in out) == sorted([rows[0], rows[1], (2, ""), (3, "")])


def test_odd_rows_in_stages(spark, tmp_path):
    docs, names, _ = _odd(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name == "packing":
            assert out.where("length != size(ids)").count() == 0 and out.count() > 0
        else:
            assert out.columns == docs.columns
            assert out.where(" and ".join(f"`{n}` = 'mine'" for n in names)).count() == out.count() > 0, name


def test_pipeline_runs_whole(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, _words(r, "abcdefgh", 50), "aa", "s", 0) for i in range(30)] + [(50, "?", "aa", "s", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {x[0] for x in out.select("doc_id").distinct().collect()} == set(range(30))
