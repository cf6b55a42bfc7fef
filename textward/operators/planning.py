"""What a scorer is asked about a text: context that fits, pieces that cover it, items, and what its answers mean."""

from __future__ import annotations

import json
from dataclasses import dataclass
from itertools import islice
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from textward.functions import aligned as A
from textward.functions import values as V
from textward.operators.judgments import Judgment, Question

if TYPE_CHECKING:
    from textward.operators.check import Preparation
    from textward.operators.scorers import Scorer

HISTORY = "array<struct<role:string,text:string>>"
STATE = f"struct<stage:string,tool:string,prompt:string,question:string,sources:array<string>,history:{HISTORY}>"
#: For each request of a check the answers by question: probabilities. Null for a failed one; the key `LATE` marks one that came too late.
ANSWERS = "array<map<string,array<double>>>"
LATE = "#late"
SCORES = "map<string,struct<value:double,model:string>>"
FINDINGS = "array<struct<policy:string,label:string,action:string,score:double,spans:array<struct<start:int,end:int>>,target:string,idx:int>>"
USAGE = "array<struct<model:string,input_tokens:bigint,output_tokens:bigint>>"
#: Bytes that must be left for text, and characters that pieces share at most.
LEAST_ROOM, OVERLAP = 64, 32


@dataclass(frozen=True)
class Group:
    """Judgments that are asked in one request, or one that is asked item by item."""

    judgments: tuple[Judgment, ...]
    room: int | None

    @property
    def items(self) -> bool:
        return self.judgments[0].items is not None

    @property
    def pattern(self) -> str | None:
        return self.judgments[0].pattern

    def questions(self) -> list[tuple[Judgment, str, str, Question]]:
        """(judgment, its question id, the id by which it is asked, question)."""
        return [(j, k, f"{j.name}.{k}", q) for j in self.judgments for k, q in j.questions.items()]


def question_bytes(judgments: tuple[Judgment, ...]) -> int:
    """A generous estimate of the bytes that questions add to a request."""
    return sum(64 + len(f"{j.name}.{k}") + q.bytes() for j in judgments for k, q in j.questions.items())


def grouped(judgments: list[Judgment], stage: str, has_context: bool, scorer: Scorer | None) -> tuple[Group, ...]:
    """Judgments with the same needs share a request; without any context in the check, its modes are one."""
    kinds: dict[tuple, list[Judgment]] = {}
    for j in judgments:
        key = (j.name,) if j.items else (j.context if has_context else "none", j.sources and has_context, j.whole_text)
        kinds.setdefault(key, []).append(j)
    out = []
    for found in kinds.values():
        most = scorer.max_request_bytes
        room = None if most is None else most - question_bytes(tuple(found))
        if room is not None and room < LEAST_ROOM:
            raise ValueError(f"the questions of {found[0].name} leave no room for text")
        out.append(Group(tuple(found), room))
    return tuple(sorted(out, key=lambda g: g.items))


def rendered(state: dict, text: str) -> str:
    """What a scorer reads: the bare text, or JSON where there is context or a tool."""
    if state["prompt"] is None and state["question"] is None and state["tool"] is None and not state["sources"] and not state["history"]:
        return text
    payload = {k: state[k] for k in ("history", "prompt", "question", "sources")} | {"text": text}
    if state["tool"] is not None:
        payload["tool"] = state["tool"]
    return json.dumps(payload, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _size(state: dict) -> int:
    return len(rendered(state, "").encode())


_ESCAPED = np.zeros(128, np.int64)
_ESCAPED[:32] = 5
_ESCAPED[[8, 9, 10, 12, 13, 34, 92]] = 1


def costs(text: str, quoted: bool) -> np.ndarray:
    """Bytes of each character in UTF-8, in a JSON string if quoted."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    return out + np.where(points < 128, _ESCAPED[np.minimum(points, 127)], 0) if quoted else out


def pieces(text: str, room: int, quoted: bool = False, most: int | None = None) -> list[A.Span] | None:
    """Spans of at most `room` bytes that cover a text, each ending after white space where it can and sharing some characters with the next; None if that takes more than `most`, or no character fits."""
    ends = np.concatenate(([0], np.cumsum(costs(text, quoted))))
    if ends[-1] <= room:
        return [(0, len(text))]
    # The places after a space or a line feed, where a piece ends best.
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero((points == 32) | (points == 10)) + 1
    out: list[A.Span] = []
    at = 0
    while not out or out[-1][1] < len(text):
        if most is not None and len(out) == most:
            return None
        far = int(np.searchsorted(ends, ends[at] + room, side="right")) - 1
        if far == at:
            return None
        if far < len(text):
            k = int(np.searchsorted(breaks, far, side="right"))
            # A break right at the start would make a piece of white space alone.
            far = int(breaks[k - 1]) if k and breaks[k - 1] > at + 1 else far
        out.append((at, far))
        at = max(at + 1, far - min(OVERLAP, (far - at) // 4))
    return out


def _fitted(group: Group, stage: str, context: dict, tool: str | None, findings: list[dict]) -> dict | None:
    """The state without text, with the context that fits into half the room; None if needed context does not."""
    first = group.judgments[0]
    state = {"stage": stage, "tool": tool, "prompt": None, "question": None, "sources": [], "history": []}
    if first.context == "none":
        return state
    said = lambda label, target: findings.append({"policy": V.ENGINE, "label": label, "action": "flag", "score": None, "spans": [], "target": target, "idx": None})
    budget = None if group.room is None else group.room - _size(state)

    def fits(s: dict, more: int = 0) -> bool:
        if budget is None:
            return True
        left = group.room - _size(s) - more
        return left >= LEAST_ROOM and budget - left <= budget // 2

    target = "question" if stage == "untrusted" else "prompt"
    full = {**state, target: context[target], "sources": context["sources"] if first.sources else []}
    if not fits(full):
        if first.context == "required":
            return None
        said("context_dropped", target)
        full = state
    turns = context["history"]
    # Rendered sizes add up, so the newest turns that fit are found from their sums.
    sizes = np.cumsum([len(json.dumps(t, ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode()) + 1 for t in reversed(turns)], dtype=np.int64)
    kept = 0
    if turns:
        with_one = {**full, "history": turns[-1:]}
        empty = _size(with_one) - int(sizes[0])
        kept = len(turns)
        while kept and not (budget is None or (group.room - empty - int(sizes[kept - 1]) >= LEAST_ROOM and budget - (group.room - empty - int(sizes[kept - 1])) <= budget // 2)):
            limit = min(budget // 2 + group.room - budget - empty, group.room - empty - LEAST_ROOM)
            kept = min(kept - 1, int(np.searchsorted(sizes, limit, side="right")))
        if kept < len(turns):
            said("history_truncated", "history")
    return {**full, "history": turns[len(turns) - kept :]}


def plan(spec: Preparation, view: A.Aligned, context: dict, tool: str | None, blocked: bool) -> tuple[list[dict], list[dict], bool]:
    """The requests of a check, the findings that planning makes, and whether everything is asked."""
    requests: list[dict] = []
    findings: list[dict] = []
    if spec.fail_fast and blocked and spec.groups:
        return [], [], False
    lost: list[tuple[Judgment, str]] = []
    left = spec.limits.max_items
    text = view.text

    def ask(k: int, state: dict, part: str, base: int, whole: bool) -> str | None:
        group = spec.groups[k]
        room = None if group.room is None else group.room - _size(state)
        found = [(0, len(part))] if room is None else pieces(part, room, rendered(state, "") != "", 1 if whole else spec.limits.max_chunks)
        if found is None:
            return "text_too_long" if whole else "too_many_chunks"
        for a, b in found:
            start, end = view.origin(base + a, base + b)
            requests.append({"grp": k, "text": part[a:b], "span": {"start": start, "end": end}, "state": state})
        return None

    for k, group in enumerate(spec.groups):
        first = group.judgments[0]
        if group.items:
            cap = left if first.max_items is None else min(left, first.max_items)
            spans = list(islice(first.items(text), cap + 1))
            if len(spans) > cap:
                lost.append((first, "too_many_items"))
                continue
            left -= len(spans)
            if not spans:
                continue
        state = _fitted(group, spec.stage, context, tool, findings)
        if state is None:
            lost += [(j, "context_too_long") for j in group.judgments]
        elif group.items:
            for a, b in spans:
                if not 0 <= a <= b <= len(text):
                    raise ValueError(f"policy {first.name} found an item outside the text")
                if label := ask(k, state, text[a:b], a, False):
                    lost.append((first, label))
        elif label := ask(k, state, text, 0, first.whole_text):
            lost += [(j, label) for j in group.judgments]
    for j, label in lost:
        findings.append({"policy": j.name, "label": label, "action": "block" if j.on_overflow == "block" else "flag", "score": None, "spans": [], "target": "text", "idx": None})
    if len(requests) > spec.limits.max_requests:
        findings.append({"policy": V.ENGINE, "label": "too_many_requests", "action": "block", "score": None, "spans": [], "target": "text", "idx": None})
        return [], findings, False
    return requests, findings, not lost


def bare_request(k: int, text: Column, tool: Column, stage: str) -> Column:
    """The request about a whole text without context, as a native expression."""
    state = F.struct(
        F.lit(stage).alias("stage"), tool.cast("string").alias("tool"), F.lit(None).cast("string").alias("prompt"), F.lit(None).cast("string").alias("question"),
        F.array().cast("array<string>").alias("sources"), F.array().cast(HISTORY).alias("history"),
    )
    span = F.struct(F.lit(0).alias("start"), F.length(text).alias("end"))
    return F.struct(F.lit(k).alias("grp"), text.alias("text"), span.alias("span"), state.alias("state"))


#: A request, its answers and what went wrong with them (null if nothing).
PAIRS = f"array<struct<r:struct<grp:int,text:string,span:struct<start:int,end:int>,state:{STATE}>,a:map<string,array<double>>,w:string>>"


def paired(groups: tuple[Group, ...], requests: Column, answers: Column) -> Column:
    """`PAIRS` of the requests of a check and their answers."""

    def wrong(p: Column) -> Column:
        good = F.lit(False)
        for k, g in enumerate(groups):
            valid = F.lit(True)
            for _, _, full, q in g.questions():
                valid = valid & F.coalesce(q.valid(F.try_element_at(p["a"], F.lit(full))), F.lit(False))
            good = good | ((p["r"]["grp"] == k) & valid)
        late = F.coalesce(F.map_contains_key(p["a"], F.lit(LATE)), F.lit(False))
        return F.when(late, F.lit("deadline_exceeded")).when(~good, F.lit("backend_error"))

    zipped = F.arrays_zip(requests.alias("r"), answers.alias("a"))
    return F.coalesce(F.transform(zipped, lambda p: F.struct(p["r"].alias("r"), p["a"].alias("a"), wrong(p).alias("w"))), F.array()).cast(PAIRS)


def read(groups: tuple[Group, ...], pairs: Column, scorer: Scorer | None) -> tuple[Column, Column, Column]:
    """Findings of the answers, the highest scores, and usage."""
    empty = F.array().cast(FINDINGS)
    no_scores, no_usage = F.create_map().cast(SCORES), F.array().cast(USAGE)
    if not groups:
        return empty, no_scores, no_usage

    # Named functions of one argument: a lambda of two would be given the index.
    def good_of(k: int) -> Column:
        return F.filter(pairs, lambda p: (p["r"]["grp"] == k) & p["w"].isNull())

    def scored(j: Judgment, local: str, full: str, q: Question) -> tuple:
        score = lambda p: q.score(F.try_element_at(p["a"], F.lit(full)), j.counted[local])

        def said(p: Column) -> Column:
            return F.struct(
                F.lit(j.name).alias("policy"), F.lit(local).alias("label"), j.threshold.action(score(p)).alias("action"), score(p).alias("score"),
                F.array(p["r"]["span"]).alias("spans"), F.lit("text").alias("target"), F.lit(None).cast("int").alias("idx"),
            )

        return score, lambda p: j.threshold.action(score(p)).isNotNull(), said

    found, entries = [], []
    for k, g in enumerate(groups):
        own = good_of(k)
        for question in g.questions():
            score, violates, said = scored(*question)
            found.append(F.transform(F.filter(own, violates), said).cast(FINDINGS))
            best = F.struct(F.array_max(F.transform(own, score)).alias("value"), F.lit(scorer.model).alias("model"))
            entries.append(F.struct(F.lit(question[2]).alias("key"), best.alias("value")))
    scores = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"]["value"].isNotNull())).cast(SCORES)
    one = lambda p: F.struct(F.lit(scorer.model).alias("model"), F.lit(None).cast("bigint").alias("input_tokens"), F.lit(None).cast("bigint").alias("output_tokens"))
    return F.concat(*found), scores, F.transform(F.filter(pairs, lambda p: p["w"].isNull()), one).cast(USAGE)
