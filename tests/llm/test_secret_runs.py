"""Secrets inside long runs of key-like characters."""

import hashlib
import random
import string

import numpy as np

from textward.llm import secrets


def _run(r, n):
    """A run of words joined by signs of a path."""
    out = "docs"
    while len(out) < n:
        out += r.choice("/._-") + "".join(r.choice("aeioustrnlm") for _ in range(r.randint(3, 9)))
    return out[:n]


def test_key_in_the_middle_of_a_long_run(spark):
    r = random.Random(5)
    key = lambda: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(40))
    texts = [f"see {_run(r, 130)}/{key()}/{_run(r, 129)} end" for _ in range(40)]
    plain = [f"see {_run(r, 150)}/12/{_run(r, 146)} end" for _ in range(40)]
    found = {x["doc_id"]: x["spans"] for x in secrets.find(spark.createDataFrame(list(enumerate(texts + plain)), "doc_id long, text string")).collect()}
    assert sum(found[i] == "model:4:305" for i in range(40)) >= 38
    assert sum(found[i] != "" for i in range(40, 80)) <= 2


def test_blocks_hold_every_window():
    text = "".join(random.Random(1).choice(string.ascii_letters + string.digits) for _ in range(900))
    spans = [(0, 17), (20, 300), (310, 900)]
    whole, owner = secrets.windows_of(text, spans)
    want = {(k, w.tobytes()) for k, w in zip(owner.tolist(), whole, strict=True)}
    got = {(k, w.tobytes()) for part, own in secrets.blocks_of(text, spans, 5 * secrets.STRIDE) for k, w in zip(own.tolist(), part, strict=True)}
    assert got == want and np.array_equal(np.bincount(owner), [1, 13, 29])


def test_threshold_keeps_the_recall_of_the_scan():
    net = secrets.trained()
    for seed, least in ((secrets.SEED + 3, secrets.RECALL), (901, 0.975), (902, 0.975), (903, 0.975)):
        hits = []
        for text, a, b, key in secrets.labelled(secrets.FINDINGS, seed):
            if key and not any(s < b and a < e for s, _, e in secrets.base_spans(text)):
                hits.append(any(s < b and a < e for s, _, e in secrets.scan(text, net)))
        assert np.mean(hits) >= least


def test_threshold_has_no_floor():
    net, r = secrets.CharNetwork(), np.random.default_rng(1)
    x, y = r.normal(0, 1, 400), np.tile([1.0, 0.0], 200)
    net.calibrate(x, y)
    net.choose(x, y, np.zeros(400, bool))
    p = 1 / (1 + np.exp(-(net.scale * x + net.shift)))
    assert net.threshold < 0.5 and (p[y > 0] >= net.threshold).mean() >= secrets.RECALL
    x[:16:2] = -np.inf
    net.choose(x, y, np.zeros(400, bool))
    assert net.threshold <= 0


def test_every_candidate_is_scored(spark):
    """Keys without a digit are found too, and words, rules and numbers are not."""
    r = random.Random(9)
    keys = ["".join(r.choice(string.ascii_letters) for _ in range(36)) for _ in range(40)]
    plain = ["-" * 40, "=" * 20, "internationalization", "Verantwortungsbewusstsein", "1234567890123456789012", "state-of-the-art-technology", "docs/guide/chapter/index", "www.example.com/articles"]
    texts = [f"the {k} here" for k in keys] + [f"the {w} here" for w in plain]
    found = [x["spans"] for x in secrets.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert sum(f == "model:4:40" for f in found[:40]) >= 37 and sum(f != "" for f in found[40:]) <= 1


def _scan_by_hand(text):
    """The base spans, found character by character."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    value = set(string.ascii_letters + string.digits + "+/_.=-")
    out, at = [], 0
    while at < len(text):
        end = None
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if lower.startswith(name, at):
                i = at + len(name)
                i += text[i : i + 1] in ('"', "'") and i < len(text)
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] not in (":", "=") or i >= len(text):
                    continue
                i += 1
                # White space and a quote give way, as the value itself may begin with neither.
                while text[i : i + 1] == " ":
                    i += 1
                i += text[i : i + 1] in ('"', "'") and i < len(text)
                j = i
                while j < len(text) and text[j] in value:
                    j += 1
                if j > i:
                    end = (j, j - i)
                    break
        if end:
            if end[1] >= 6:
                out.append((at, 0, end[0]))
            at = end[0]
        else:
            at += 1
    for kind, head, chars, least in ((1, "AKIA", set(string.ascii_uppercase + string.digits), 20), (2, "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            j = at + len(head)
            if text.startswith(head, at) and j < len(text) and text[j] in chars:
                while j < len(text) and text[j] in chars:
                    j += 1
                if j - at >= least:
                    out.append((at, kind, j))
                at = j
            else:
                at += 1
    return sorted(out)


def test_base_by_brute_force(spark):
    r = random.Random(4)
    bits = ["password", "PassWd", "SECRET", "token", "api_key", "APIKEY", ":", "=", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "beef" * 6, "é😀", "\n", "x", "-_."]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)] + [None, ""]
    rows = secrets.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = _scan_by_hand(texts[row["doc_id"]] or "")
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert row["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), texts[row["doc_id"]]
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(k == x for _, k, _ in want) for x in range(3)]
