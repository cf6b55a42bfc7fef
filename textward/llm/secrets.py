"""Secret scans: fixed patterns, and a character convolutional network over candidates in context.

Candidates are all runs of `SHORTEST` or more key-like characters. The network (numpy) reads a candidate with its surroundings: embedded
characters, one convolution, the maximum over the candidate and over its context,
a logistic output. It is trained on labelled findings made up from a seed: keys
of many shapes against numbers, paths, versions, dates and words. On findings
kept out of training its output is calibrated (Platt); on others the threshold is
the largest with which the scan's candidates recall `RECALL` of the keys there that
no pattern finds, by two standard errors.

Spans are code points, end exclusive. What the patterns find always stays; the
network adds candidates that no pattern's span meets. Null text counts as empty;
repeated rows are scanned each; a candidate longer than the network's window is
read in overlapping windows from head to tail, and its best one counts; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.llm.common import map_texts, texts_of

KINDS = ("assign", "access", "hex", "model")
_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")).replace("_[?]", "_?")
ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")
_HINT = re.compile(r"[:=]")

LEFT, CORE, RIGHT = 24, 40, 12
#: Windows over a long candidate start so far apart; any 20 characters in a row lie in one of them.
STRIDE = 20
SEED, RECALL, FINDINGS = 20240, 0.98, 3000
_WIDTH, _FILTERS, _EMBED = 5, 24, 8
_ALPHABET = string.printable[:95]
_CODE = np.zeros(128, np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(1, 96)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in `KINDS`, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    out = []
    if _HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key-like characters, whatever they are made of."""
    return [m.span() for m in CANDIDATE.finditer(text)]


def windows_of(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a candidate and its context, and which span each row belongs to."""
    rows, owner = [], []
    for k, (a, b) in enumerate(spans):
        for start in [*range(a, b - CORE, STRIDE), max(a, b - CORE)]:
            stop = min(b, start + CORE)
            left, right = text[max(0, start - LEFT) : start].rjust(LEFT), text[stop : stop + RIGHT].ljust(RIGHT)
            rows.append(left + text[start:stop].ljust(CORE, "\0") + right)
            owner.append(k)
    raw = np.array([[min(ord(c), 127) for c in r] for r in rows], np.int64).reshape(-1, LEFT + CORE + RIGHT)
    return _CODE[raw], np.array(owner, np.int64)


def blocks_of(text: str, spans: list[tuple[int, int]], size: int = 2048 * STRIDE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The windows of all spans in blocks of bounded size, however long a candidate is."""
    part, owner, held = [], [], 0
    for k, (a, b) in enumerate(spans):
        # Pieces overlap by less than a window, so that every window of the whole is in one of them.
        for start in range(a, max(a + 1, b - CORE), size):
            part.append((start, min(b, start + size + CORE)))
            owner.append(k)
            held += part[-1][1] - start + CORE
            if held >= size:
                codes, own = windows_of(text, part)
                yield codes, np.array(owner, np.int64)[own]
                part, owner, held = [], [], 0
    if part:
        codes, own = windows_of(text, part)
        yield codes, np.array(owner, np.int64)[own]


class CharNetwork:
    """Embedding, convolution, maximum over candidate and context, logistic output; Adam by hand."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.3, (96, _EMBED)),
            "w": r.normal(0, 0.2, (_WIDTH * (_EMBED + 1), _FILTERS)),
            "b": np.zeros(_FILTERS),
            "v": r.normal(0, 0.2, 2 * _FILTERS),
            "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, codes: np.ndarray):
        n, size = codes.shape
        mark = np.zeros((n, size, 1))
        mark[:, LEFT : LEFT + CORE] = (codes[:, LEFT : LEFT + CORE] > 0)[:, :, None]
        x = np.concatenate((self.p["e"][codes], mark), axis=2)
        x = np.pad(x, ((0, 0), (_WIDTH // 2, _WIDTH // 2), (0, 0)))
        view = np.lib.stride_tricks.sliding_window_view(x, _WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, size, -1)
        z = np.maximum(view @ self.p["w"] + self.p["b"], 0)
        inside = mark > 0
        inner, outer = np.where(inside, z, -1).argmax(1), np.where(inside, -1, z).argmax(1)
        pooled = np.concatenate((np.take_along_axis(z, inner[:, None], 1)[:, 0], np.take_along_axis(z, outer[:, None], 1)[:, 0]), axis=1)
        return pooled @ self.p["v"] + self.p["c"][0], (view, z, inner, outer, pooled)

    def raw(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 2048])[0] for i in range(0, len(codes), 2048)]) if len(codes) else np.empty(0)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(codes) + self.shift, -40, 40)))

    def train(self, codes: np.ndarray, y: np.ndarray, epochs: int = 8, size: int = 128, rate: float = 4e-3) -> None:
        r = np.random.default_rng(SEED + 1)
        m, s, t = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), size):
                at = order[i : i + size]
                c = codes[at]
                out, (view, z, inner, outer, pooled) = self._forward(c)
                d = (1 / (1 + np.exp(-out)) - y[at]) / len(at)
                g = {"v": pooled.T @ d, "c": np.array([d.sum()])}
                back = d[:, None] * self.p["v"]
                dz = np.zeros_like(z)
                rows, filters = np.arange(len(at))[:, None], np.arange(_FILTERS)
                dz[rows, inner, filters] = back[:, :_FILTERS]
                dz[rows, outer, filters] = back[:, _FILTERS:]
                dz *= z > 0
                flat = dz.reshape(-1, _FILTERS)
                g["w"], g["b"] = view.reshape(len(flat), -1).T @ flat, flat.sum(0)
                dx = (flat @ self.p["w"].T).reshape(*z.shape[:2], _WIDTH, _EMBED + 1)[..., :_EMBED]
                sums = np.zeros(96 * _EMBED)
                for k in range(_WIDTH):
                    shift = k - _WIDTH // 2
                    lo, hi = max(0, -shift), min(c.shape[1], c.shape[1] - shift)
                    cell = c[:, lo + shift : hi + shift, None] * _EMBED + np.arange(_EMBED)
                    sums += np.bincount(cell.ravel(), dx[:, lo:hi, k].ravel(), 96 * _EMBED)
                g["e"] = sums.reshape(96, _EMBED)
                t += 1
                for k, x in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * x
                    s[k] = 0.999 * s[k] + 0.001 * x * x
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by Newton steps, of raw scores and labels."""
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
            w, d = p * (1 - p) + 1e-9, p - target
            h = np.array([[w @ (x * x) + 1e-3, w @ x], [w @ x, w.sum() + 1e-3]])
            step = np.linalg.solve(h, np.array([d @ x, d.sum()]))
            a, b = max(0.05, a - float(np.clip(step[0], -1, 1))), b - float(np.clip(step[1], -2, 2))
        self.scale, self.shift = a, b

    def choose(self, x: np.ndarray, y: np.ndarray, found: np.ndarray) -> None:
        """The recall-constrained threshold.

        `x` is each finding's raw score in the scan, -inf where the scan scores
        nothing of it, which counts as a miss; `found` says which ones a fixed pattern
        finds, and the recall is that of the other keys.
        """
        p = np.where(np.isfinite(x), 1 / (1 + np.exp(-np.clip(self.scale * np.where(np.isfinite(x), x, 0) + self.shift, -40, 40))), 0)
        kept = np.sort(p[(y > 0) & ~found])
        # Two standard errors on the safe side, so that the recall holds for other findings too.
        missed = (1 - RECALL) * len(kept) - 2 * np.sqrt(RECALL * (1 - RECALL) * len(kept))
        # A little less, as the same row differs in its last bits from batch to batch.
        self.threshold = float(kept[max(0, int(np.floor(missed)))]) - 1e-9


def labelled(n: int, seed: int) -> list[tuple[str, int, int, float]]:
    """Labelled findings in context, as (text, start, end, label): keys (1) and what only looks like one (0)."""
    r = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(chars[i] for i in r.integers(0, len(chars), int(k)))
    lower, digits, both = string.ascii_lowercase, string.digits, string.ascii_letters + string.digits
    word = lambda: pick(lower, r.integers(2, 10))
    words = lambda k: [word() for _ in range(int(k))]
    keys = [
        lambda: pick("0123456789abcdef", r.integers(24, 65)),
        lambda: pick(both, r.integers(18, 60)),
        lambda: pick(both + "+/", r.integers(20, 72)) + "=" * int(r.integers(0, 3)),
        lambda: pick(both + "-_", r.integers(20, 64)),
        lambda: "AKIA" + pick(string.ascii_uppercase + digits, 16),
        lambda: word()[:3] + "_" + word()[:4] + "_" + pick(both, r.integers(20, 40)),
        lambda: word()[:3] + "-" + pick(both, r.integers(20, 48)),
        lambda: ".".join(pick(both + "-_", r.integers(16, 40)) for _ in range(3)),
        lambda: pick(string.ascii_letters, r.integers(20, 48)),
    ]
    others = [
        lambda: "/".join([*words(r.integers(2, 5)), word() + pick(digits, 2) + "." + word()[:3]]),
        lambda: "-".join([*words(r.integers(2, 5)), pick(digits, r.integers(1, 5))]),
        lambda: "_".join([*words(r.integers(2, 5)), pick(digits, r.integers(1, 4))]),
        lambda: ".".join([*words(r.integers(2, 5)), word() + pick(digits, 1)]),
        lambda: f"20{pick(digits, 2)}-0{pick('123456789', 1)}-1{pick(digits, 1)}T0{pick(digits, 1)}.{pick(digits, 2)}.{pick(digits, 2)}Z",
        lambda: word() + pick(digits, r.integers(12, 20)),
        lambda: "v" + ".".join(pick(digits, r.integers(1, 4)) for _ in range(7)),
        lambda: "".join(w.capitalize() for w in words(r.integers(3, 6))) + pick(digits, r.integers(1, 3)),
        lambda: word() * 3 + pick(digits, 1) * int(r.integers(4, 12)),
        lambda: word() + "=" * int(r.integers(8, 30)) + pick(digits, 1),
        lambda: word() + "+" + pick(digits, 2) + "=" + "+".join(words(4)),
        lambda: "".join(words(r.integers(3, 5))) + pick(digits, r.integers(1, 5)),
        lambda: pick(digits, 4) + "-" + "-".join(words(3)),
        lambda: "".join(words(r.integers(3, 6))),
        lambda: "".join(words(r.integers(3, 6))).capitalize() + ".",
        lambda: "-".join(words(r.integers(3, 6))) + ".",
        lambda: ".".join(words(r.integers(3, 6))),
        lambda: "/".join(words(r.integers(3, 6))) + "/",
        lambda: "".join(w.capitalize() for w in words(r.integers(3, 6))),
        lambda: pick("-=._/+", 1) * int(r.integers(16, 80)),
        lambda: pick(digits, r.integers(16, 40)),
        lambda: "/".join("".join(w.capitalize() for w in words(2)) for _ in range(int(r.integers(2, 4)))),
        lambda: "www." + word() + ".com/" + word() + "/" + pick(digits, r.integers(3, 8)),
    ]
    before_key = ["token = \"", "secret: ", "password=", "api_key: '", "key ", "auth ", "", "", "", "bearer "]
    before_other = ["see ", "file ", "version ", "ref. ", "", "", "", "at ", "no. ", "key "]
    out = []
    for i in range(n):
        key = i % 2 == 0
        run, before = (keys[r.integers(len(keys))](), before_key[r.integers(10)]) if key else (others[r.integers(len(others))](), before_other[r.integers(10)])
        if len(run) < SHORTEST:
            run += pick(both, 16) if key else "-" + "-".join(words(6))
        left = " ".join(words(r.integers(0, 6))) + " " + before
        text = left + run + ["\" ", "' ", " ", "\n", ", ", ""][r.integers(6)] + " ".join(words(3))
        out.append((text, len(left), len(left) + len(run), float(key)))
    return out


def findings(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of labelled findings, one each: of a long one in turn its head and its tail."""
    rows, y = [], []
    for k, (text, a, b, label) in enumerate(labelled(n, seed)):
        rows.append(windows_of(text, [(a, b)])[0][-(k // 2 % 2)])
        y.append(label)
    return np.array(rows), np.array(y)


def scanned(net: CharNetwork, rows: list[tuple[str, int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a scan makes of labelled findings: best raw score of the candidates that meet each, label, whether a pattern meets it."""
    codes, owner = [], []
    found = np.zeros(len(rows), bool)
    for k, (text, a, b, _) in enumerate(rows):
        found[k] = any(s < b and a < e for s, _, e in base_spans(text))
        spans = [(s, e) for s, e in candidates(text) if s < b and a < e]
        if spans:
            part = windows_of(text, spans)[0]
            codes.append(part)
            owner += [k] * len(part)
    best = np.full(len(rows), -np.inf)
    if codes:
        np.maximum.at(best, np.array(owner), net.raw(np.concatenate(codes)))
    return best, np.array([y for *_, y in rows]), found


@lru_cache(maxsize=1)
def trained() -> CharNetwork:
    """The network; the same on every call, by its seed."""
    net = CharNetwork()
    net.train(*findings(FINDINGS, SEED + 2))
    raw, y, _ = scanned(net, labelled(FINDINGS, SEED + 3))
    net.calibrate(raw[np.isfinite(raw)], y[np.isfinite(raw)])
    net.choose(*scanned(net, labelled(FINDINGS, SEED + 4)))
    return net


def scan(text: str | None, net: CharNetwork) -> list[tuple[int, int, int]]:
    """All spans of a text, by start and kind."""
    text = text or ""
    base = base_spans(text)
    found = candidates(text)
    if not found:
        return base
    # Every candidate is scored; those that a fixed pattern has found already stay that pattern's.
    best = np.zeros(len(found))
    for part, owner in blocks_of(text, found):
        np.maximum.at(best, owner, net.probability(part))
    added = [(a, 3, b) for (a, b), p in zip(found, best, strict=True) if p >= net.threshold and not any(s < b and a < e for s, _, e in base)]
    return sorted(base + added)


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(df: DataFrame) -> DataFrame:
    """Counts, digest and spans of every text."""
    net = trained()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            spans = scan(text, net)
            base = [s for s in spans if s[1] < 3]
            n = [sum(1 for s in base if s[1] == k) for k in range(3)]
            rows.append((*n, hashlib.sha256(said(base).encode()).hexdigest(), said(spans), len(spans) - len(base)))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    return map_texts(texts_of(df), work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")


def redact(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span of `text` replaced; overlapping spans go as one. Null text stays null."""
    net = trained()
    at = df.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text in batch.column(at).to_pylist():
            end, parts = 0, []
            for a, _, b in scan(text, net):
                if a >= end:
                    parts += [text[end:a], mark]
                end = max(end, b)
            texts.append("".join(parts) + text[end:] if parts else text)
        return batch.set_column(at, "text", pa.array(texts, pa.string()))

    return map_texts(df.withColumn("text", F.col("text").cast("string")), work, df.withColumn("text", F.col("text").cast("string")).schema)
