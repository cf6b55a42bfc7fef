"""The five checks: one row in, one result out.

A check sanitizes the context and the text of a row by its policies, plans what a
scorer is asked, compares the answers with thresholds, merges all findings and
decides, and gives the text to pass on. Rows about which no policy has anything
to say, by its gate, never leave the JVM; the others are prepared by one Arrow
function, each row in linear time. Nothing is shuffled but answers from a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, fields, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textward.functions import aligned as A
from textward.functions import spans as S
from textward.functions import text as X
from textward.functions import values as V
from textward.operators import planning as L
from textward.operators import policies as P
from textward.operators.judgments import Judgment
from textward.operators.scorers import Scorer, as_scorer
from textward.session import ship

FINDING = "struct<policy:string,label:string,action:string,score:double,spans:array<struct<start:int,end:int>>,target:string,idx:int>"
FULL = f"array<{FINDING}>"
REQUEST = f"struct<grp:int,text:string,span:struct<start:int,end:int>,state:{L.STATE}>"
ENTRY = "array<struct<token:string,value:string>>"
#: What the Arrow function makes of a row.
PREPARED = (
    f"struct<text:string,findings:{FULL},label:string,staged:{ENTRY},restored:string,afterwards:{FULL},tokens:array<string>,"
    f"prompt:string,question:string,sources:array<string>,history:{L.HISTORY},requests:array<{REQUEST}>,complete:boolean>"
)
PHASES = ("normalize", "detect", "limit")
MAX_INPUT_BYTES = 1_048_576
GROWTH, CONTEXT_ITEMS = 4, 1_024
_BLOCKED = {"tool_call": "Tool call blocked.", "tool_result": "Tool result blocked."}
_ROLES = {"user": "input", "assistant": "output", "tool": "tool_result"}


@dataclass(frozen=True)
class Limits:
    """Bytes of a text and of its context, pieces and items of a text, requests of a check, replaced values, and the size of a conversation's token store."""

    max_input_bytes: int = MAX_INPUT_BYTES
    max_context_bytes: int = 2_097_152
    max_chunks: int = 32
    max_items: int = 100
    max_requests: int = 128
    max_redactions: int = 1_000
    max_entries: int = 1_000
    max_entry_bytes: int = 8 << 20

    def __post_init__(self) -> None:
        if any(isinstance(v, bool) or not isinstance(v, int) or v < 1 for v in (getattr(self, f.name) for f in fields(self))):
            raise P.PolicyError("limits are positive integers")


class Exceeded(Exception):
    """A limit that ends a check; `args[0]` is the label of its finding."""


def rank(action: Column) -> Column:
    return F.when(action == "block", 2).when(action == "redact", 1).otherwise(0)


def finding(policy: str, label: str, action: str, target: str = "text") -> Column:
    """An array of one finding without a place."""
    fixed = {"policy": policy, "label": label, "action": action, "score": None, "spans": (), "target": target, "idx": None}
    return F.array(F.struct(*((S.none() if k == "spans" else F.lit(v)).alias(k) for k, v in fixed.items()))).cast(FULL)


def merge_findings(findings: Column) -> Column:
    """One finding for each policy, label and place: the strongest action, the highest score, all spans; first seen first."""
    key = lambda x: F.struct(x["policy"], x["label"], x["target"], F.coalesce(x["idx"], F.lit(-1)))
    keys = F.array_distinct(F.transform(findings, key))

    def one(k: Column) -> Column:
        own = F.filter(findings, lambda x: key(x) == k)
        strongest = F.array_max(F.transform(own, lambda x: rank(x["action"])))
        first = F.element_at(own, 1)
        return F.struct(
            first["policy"].alias("policy"),
            first["label"].alias("label"),
            F.element_at(F.array(F.lit("flag"), F.lit("redact"), F.lit("block")), strongest + 1).alias("action"),
            F.array_max(F.transform(own, lambda x: x["score"])).alias("score"),
            F.when(F.size(own) == 1, first["spans"]).otherwise(S.merged(F.flatten(F.transform(own, lambda x: x["spans"])))).alias("spans"),
            first["target"].alias("target"),
            first["idx"].alias("idx"),
        )

    return F.when(F.size(findings) <= 1, findings).otherwise(F.transform(keys, one)).cast(FULL)


def decision(findings: Column) -> Column:
    return F.when(F.exists(findings, lambda x: x["action"] == "block"), F.lit("block")).otherwise(F.lit("allow"))


def names(findings: Column) -> Column:
    """The sorted names of findings; a judgment's single question has the judgment's."""
    return F.array_sort(F.array_distinct(F.transform(findings, lambda x: F.when(x["label"] == "violation", x["policy"]).otherwise(x["label"]))))


def refusal(findings: Column, stage: str) -> Column:
    """What is passed on in place of a blocked text: the sorted names of what blocked it."""
    if stage in _BLOCKED:
        return F.lit(_BLOCKED[stage])
    blocking = F.filter(findings, lambda x: x["action"] == "block")
    said = names(F.when(F.size(blocking) > 0, blocking).otherwise(findings))
    return F.when(F.size(said) > 0, F.concat(F.lit("Blocked: "), F.array_join(said, ", "), F.lit("."))).otherwise(F.lit("Blocked."))


def _row(policy: str, label: str, action: str, spans: Iterable[A.Span] = (), target: str = "text", idx: int | None = None) -> dict:
    return {"policy": policy, "label": label, "action": action, "score": None, "spans": [{"start": a, "end": b} for a, b in spans], "target": target, "idx": idx}


class Conversation:
    """What replaces values in one check: conversation tokens, markers of a reply, and how many there were."""

    def __init__(self, spec: Preparation, scope: str | None):
        self.spec, self.count = spec, 0
        self.staged: dict[str, str] = {}
        self.markers: dict[str, str] = {}
        # One key makes another for each conversation, so that equal values have unequal tokens elsewhere.
        self.key = spec.key if scope is None else bytes.fromhex(X.hashed(spec.key, scope))

    def edits(self, text: str, hits: list[P.Hit], policy: P.Sensitive, tokens: bool, local: bool) -> list[A.Edit]:
        found = P.everywhere(text, hits)
        self.count += len(found)
        if self.count > self.spec.limits.max_redactions:
            raise Exceeded("too_many_redactions")
        return [(h[0], h[1], self.replacement(text[h[0] : h[1]], h, policy.key, tokens, local)) for h in found]

    def replacement(self, value: str, hit: P.Hit, key: bytes | None, tokens: bool, local: bool) -> str:
        """What stands for a value; conversation tokens and markers only where they may be, else its kind."""
        makers = {"mask": lambda v: "******", "partial": X.masked, "hmac": lambda v: X.hashed(key, v)}
        makers |= {"token": self.token} if tokens else {}
        makers |= {"local": self.marker} if local else {}
        return makers[hit[3]](value) if hit[3] in makers else f"[REDACTED_{hit[2].upper()}]"

    def token(self, value: str) -> str:
        made = X.token_of(self.key, value)
        self.staged[made] = value
        return made

    def marker(self, value: str) -> str:
        made = f"{P.OPEN}HERE_{X.hashed(self.key, 'here' + value)[:22]}]"
        self.markers[made] = value
        return made


@dataclass(frozen=True)
class Preparation:
    """What the Arrow function needs to know."""

    stage: str
    policies: tuple[P.Policy, ...]
    groups: tuple[L.Group, ...]
    limits: Limits
    key: bytes
    restore: bool
    origins: frozenset
    on_url: str
    fail_fast: bool

    def sanitized(self, text: str, place: P.Place, idx: int | None, talk: Conversation, findings: list[dict]) -> A.Aligned:
        """A text after the policies for its origin, aligned with what it was."""
        subject = place.target == "text"
        most = GROWTH * (self.limits.max_input_bytes if subject else self.limits.max_context_bytes)
        view = A.Aligned(text)
        if not (subject and self.stage == "output"):
            edits = P.escapes(text)
            if edits:
                findings.append(_row(V.ENGINE, "placeholder_in_text", "flag", [(a, b) for a, b, _ in edits], place.target, idx))
                view = view.edited(edits)
        for policy in self.policies:
            if place.origin not in policy.stages:
                continue
            call = subject and self.stage == "tool_call"
            if isinstance(policy, P.Sensitive):
                hits = policy.hits(view.text, place)
                found, _ = P.checked(policy, (P.grouped(hits), []), len(view.text))
                edits = talk.edits(view.text, hits, policy, place.origin != "output" and not call, subject and self.stage == "output")
            else:
                found, edits = P.checked(policy, policy.run(view.text, place), len(view.text))
            for label, action, spans in found:
                # A call's arguments pass on as they are, so what would be replaced there blocks.
                findings.append(_row(policy.name, label, "block" if call and action == "redact" else action, (view.origin(*s) for s in spans), place.target, idx))
            view = view.edited(edits)
            if len(view.text) * 4 > most and len(view.text.encode(errors="surrogatepass")) > most:
                raise Exceeded("normalized_too_long")
        return view

    def values(self, row: dict) -> Iterator[tuple[str, P.Place, int | None, str | None]]:
        """The texts of a row's context, where they stand, their number and the role of a turn."""
        for target in ("prompt", "question"):
            if row[target] is not None:
                yield row[target], P.Place(self.stage, "input", target), None, None
        for k, source in enumerate(s for s in row["sources"] or () if s is not None):
            yield source, P.Place(self.stage, "untrusted", "source"), k, None
        for k, turn in enumerate(t for t in row["history"] or () if t is not None and t["text"] is not None and t["role"] in _ROLES):
            yield turn["text"], P.Place(self.stage, _ROLES[turn["role"]], "history"), k, turn["role"]

    def context(self, row: dict, talk: Conversation, findings: list[dict]) -> dict:
        """The context, sanitized before the text."""
        given = list(self.values(row))
        if len(given) > CONTEXT_ITEMS:
            raise Exceeded("too_many_context_items")
        if row["context_ok"] is False:
            findings.append(_row(V.ENGINE, "context_not_ok", "block", target="prompt" if row["prompt"] is not None else "question"))
        clean: dict[str, list] = {"prompt": [], "question": [], "source": [], "history": []}
        tokens: set[str] = set()
        left = self.limits.max_context_bytes
        for text, place, idx, role in given:
            made = self.sanitized(text, place, idx, talk, findings).text
            left -= len(made.encode())
            if left < 0:
                raise Exceeded("context_too_long")
            tokens.update(P.TOKEN.findall(made))
            clean[place.target].append(made if role is None else {"role": role, "text": made})
        single = {k: clean[k][0] if clean[k] else None for k in ("prompt", "question")}
        return {**single, "sources": clean["source"], "history": clean["history"], "tokens": sorted(tokens)}

    def returned(self, text: str, talk: Conversation, row: dict, tokens: list[str]) -> tuple[str, list[dict]]:
        """A reply with its own values back in place, and the conversation's, where its context carried them and no foreign URL would."""
        for marker, value in talk.markers.items():
            text = text.replace(marker, value)
        findings: list[dict] = []
        if self.restore:
            known = {e["token"]: e["value"] for e in row["store"] or () if e is not None} | talk.staged
            allowed = {t: known[t] for t in tokens if t in known}
            edits, urls = [], None
            for m in P.TOKEN.finditer(text):
                if m[0] not in allowed:
                    continue
                urls = X.url_spans(text) if urls is None else urls
                if any(a <= m.start() < b and X.canonical_origin(text[a:b]) not in self.origins for a, b in urls):
                    findings.append(_row(V.ENGINE, "placeholder_in_url", "block" if self.on_url == "block" else "flag"))
                else:
                    edits.append((*m.span(), allowed[m[0]]))
            text = A.Aligned(text).edited(edits).text
        if len(text.encode()) > GROWTH * self.limits.max_input_bytes:
            findings.append(_row(V.ENGINE, "restored_output_too_large", "block"))
        return text, findings

    def prepare(self, row: dict) -> dict:
        findings: list[dict] = []
        talk = Conversation(self, row["scope"])
        empty = {"text": "", "findings": [], "label": None, "staged": [], "restored": None, "afterwards": [], "tokens": [], "prompt": None, "question": None, "sources": [], "history": [], "requests": [], "complete": False}
        text = row["text"]
        try:
            text.encode()
        except UnicodeEncodeError:
            return {**empty, "label": "invalid_unicode"}
        try:
            context = self.context(row, talk, findings)
            view = self.sanitized(text, P.Place(self.stage, self.stage, "text", row["tool"]), None, talk, findings)
            used = row["store"] or ()
            new = {t: v for t, v in talk.staged.items() if all(e is None or e["token"] != t for e in used)}
            cost = lambda t, v: len(t.encode()) + len((v or "").encode()) + 8
            if new and (len(new) + len(used) > self.limits.max_entries or sum(cost(t, v) for t, v in new.items()) + sum(cost(e["token"], e["value"]) for e in used if e) > self.limits.max_entry_bytes):
                raise Exceeded("redaction_store_full")
            requests, planned, complete = L.plan(self, view, context, row["tool"], any(f["action"] == "block" for f in findings))
        except Exceeded as stop:
            return {**empty, "label": stop.args[0]}
        restored, afterwards = self.returned(view.text, talk, row, context["tokens"]) if self.stage == "output" else (None, [])
        entries = [{"token": t, "value": v} for t, v in new.items()]
        return {**empty, **context, "text": view.text, "findings": findings + planned, "staged": entries, "restored": restored, "afterwards": afterwards, "requests": requests, "complete": complete}


_FIELDS = {"text": "string", "tool": "string", "prompt": "string", "question": "string", "sources": "array<string>", "history": L.HISTORY, "store": ENTRY, "scope": "string", "context_ok": "boolean"}


def _prepare(spec: Preparation) -> Column:
    kind = to_arrow_type(T._parse_datatype_string(PREPARED))

    @F.arrow_udf(PREPARED)
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else spec.prepare(r) for r in rows.to_pylist()], kind)

    return run


def _ordered(policies: Iterable[P.Policy], judgments: Sequence[Judgment]) -> list[P.Policy]:
    ordered = sorted(policies, key=lambda p: PHASES.index(p.phase))
    said = [p.name for p in (*ordered, *judgments)]
    if len(set(said)) != len(said):
        raise P.PolicyError("policy names must be unique")
    if V.ENGINE in said:
        raise P.PolicyError(f"{V.ENGINE} is the engine's own name")
    return ordered


def check(
    df: DataFrame,
    stage: str,
    policies: Iterable[P.Policy] = (),
    judgments: Sequence[Judgment] = (),
    scorer: object = None,
    *,
    text: str = "text",
    tool: str | None = None,
    prompt: str | None = None,
    question: str | None = None,
    sources: str | None = None,
    history: str | None = None,
    context_ok: str | None = None,
    scope: str | None = None,
    store: str | None = None,
    judged: str | None = None,
    limits: Limits | None = None,
    max_input_bytes: int | None = None,
    key: bytes = b"",
    restore: bool = True,
    origins: Iterable[str] = (),
    on_url: str = "block",
    on_error: str = "block",
    fail_fast: bool = False,
) -> DataFrame:
    """`df` with sanitized, findings, scores, usage, staged, decision, complete, ok and onward, which replace columns of these names.

    Columns are named by the arguments (a column `tool` is the tool without more): `prompt` and `question` are texts, `sources`
    an array of texts, `history` an array of (role, text), `context_ok` whether the
    check of the prompt or question went well, `scope` the conversation, `store`
    its entries (token, value), as `joins.attach_store` gives them. `judged` names
    a column of findings made elsewhere; a null in it means an answer was missing.
    `staged` are the entries that a check adds to the store once it is allowed.

    `on_error` is block, allow or raise, for answers that are missing or bad. Null
    text counts as empty. Offsets point into the original text. Turns of other
    roles than user, assistant and tool are no history.
    """
    if stage not in V.STAGES:
        raise ValueError(f"unknown stage: {stage}")
    if on_error not in ("block", "allow", "raise") or on_url not in ("block", "allow"):
        raise ValueError("on_error is block, allow or raise, and on_url block or allow")
    spark = df.sparkSession
    limits = limits or Limits()
    limits = limits if max_input_bytes is None else replace(limits, max_input_bytes=max_input_bytes)
    ordered = _ordered(policies, judgments)
    asked = [j for j in judgments if stage in j.stages]
    if asked and scorer is None:
        raise P.PolicyError("judgments need a scorer")
    scorer = as_scorer(scorer) if asked else None
    tool = tool or ("tool" if "tool" in df.columns else None)
    given = {"text": text, "tool": tool, "prompt": prompt, "question": question, "sources": sources, "history": history, "store": store, "scope": scope, "context_ok": context_ok}
    has_context = any(given[k] for k in ("prompt", "question", "sources", "history", "context_ok"))
    active = tuple(p for p in ordered if has_context or stage in p.stages)
    for policy in active:
        policy.prepare(spark)
    groups = L.grouped(asked, stage, has_context, scorer)
    spec = Preparation(stage, active, groups, limits, key, restore, frozenset(X.configured_origin(o) for o in origins), on_url, fail_fast)

    tag = f"_{uuid.uuid4().hex[:10]}"
    c = {k: f"{tag}_{k}" for k in ("in", "gate", "python", "made", "answers", "pairs", "failed", "all", "said")}
    original = F.coalesce(F.col(text).cast("string"), F.lit(""))
    too_long = F.octet_length(original) > limits.max_input_bytes
    fits = F.lit(True)
    # Context, items that only Python can find, and what looks like a token of ours need Python as well.
    gates = [F.lit(has_context), F.contains(original, F.lit(P.OPEN)), *(p.blocked(F.col(tool) if tool else F.lit(None).cast("string")) if isinstance(p, P.AllowedTools) else p.gate(original) for p in active)]
    gates += [original.rlike(V.URL_ITEM) if g.pattern == V.URL_ITEM else F.lit(True) for g in groups if g.items]
    gate = reduce(lambda a, b: a | b, gates)
    for g in groups:
        if not g.items and g.room is not None:
            fits = fits & (F.octet_length(original) <= g.room)
    gate = (gate | ~fits) & ~too_long

    ready = df.withColumn(c["in"], original).withColumn(c["gate"], gate)
    columns = {k: F.col(c["in"]) if k == "text" else F.lit(None) if v is None else F.col(v) for k, v in given.items()}
    row = F.struct(*(columns[k].cast(kind).alias(k) for k, kind in _FIELDS.items()))
    whole = F.array(*(L.bare_request(k, F.col(c["in"]), columns["tool"], stage) for k, g in enumerate(groups) if not g.items)).cast(f"array<{REQUEST}>")
    plain = F.struct(
        F.col(c["in"]).alias("text"),
        F.array().cast(FULL).alias("findings"),
        F.lit(None).cast("string").alias("label"),
        F.array().cast(ENTRY).alias("staged"),
        (F.col(c["in"]) if stage == "output" else F.lit(None).cast("string")).alias("restored"),
        F.array().cast(FULL).alias("afterwards"),
        F.array().cast("array<string>").alias("tokens"),
        F.lit(None).cast("string").alias("prompt"),
        F.lit(None).cast("string").alias("question"),
        F.array().cast("array<string>").alias("sources"),
        F.array().cast(L.HISTORY).alias("history"),
        whole.alias("requests"),
        F.lit(True).alias("complete"),
    ).cast(PREPARED)
    stopped = F.struct(*((F.lit("input_too_long") if f == "label" else F.lit("") if f == "text" else F.lit(False) if f == "complete" else F.lit(None)).alias(f) for f in T._parse_datatype_string(PREPARED).names)).cast(PREPARED)
    if active or has_context or groups or stage == "output" or scope:
        ship(spark)
        ready = ready.withColumn(c["python"], _prepare(spec)(F.when(F.col(c["gate"]), row)))
        made = F.coalesce(F.col(c["python"]), F.when(F.octet_length(c["in"]) > limits.max_input_bytes, stopped).otherwise(plain))
    else:
        escaped = P.escape_placeholders(F.col(c["in"]))
        found = F.when(F.col(c["in"]) != escaped, finding(V.ENGINE, "placeholder_in_text", "flag")).otherwise(F.array().cast(FULL))
        plain = plain.withField("text", escaped).withField("findings", found)
        made = F.when(F.octet_length(c["in"]) > limits.max_input_bytes, stopped).otherwise(plain)
    ready = ready.withColumn(c["made"], made)
    m = F.col(c["made"])
    errors, lost, said, given_said = F.array().cast(FULL), F.lit(False), F.array().cast(FULL), F.array().cast(FULL)
    scores, usage = L.read((), F.lit(None), None)[1:]
    failed = F.array().cast("array<string>")
    if asked:
        ready = scorer.answered(ready, f"{c['made']}.requests", c["answers"])
        ready = ready.withColumn(c["pairs"], L.paired(groups, m["requests"], F.col(c["answers"])))
        said, scores, usage = L.read(groups, F.col(c["pairs"]), scorer)
        failed = F.array_compact(F.transform(F.col(c["pairs"]), lambda p: p["w"]))
    if judged:
        failed = F.when(F.col(judged).isNull(), F.array_append(failed, F.lit("backend_error"))).otherwise(failed)
        given_said = F.coalesce(F.col(judged).cast(FULL), F.array().cast(FULL))
    if asked or judged:
        # Named columns keep the optimizer from repeating an expression in every later one.
        ready = ready.withColumn(c["failed"], F.when(m["label"].isNull(), failed).otherwise(F.array().cast("array<string>")))
        failed = F.col(c["failed"])
        lost = F.size(failed) > 0
        for label in ("backend_error", "deadline_exceeded"):
            error = finding(V.ENGINE, label, "flag" if on_error == "allow" else "block")
            errors = F.concat(errors, F.when(F.array_contains(failed, label), error).otherwise(F.array().cast(FULL)))
        if on_error == "raise":
            errors = F.when(lost, F.raise_error(F.lit("an answer is missing or bad")).cast(FULL)).otherwise(errors)
    ready = ready.withColumn(c["all"], F.concat(m["findings"], errors, said, given_said).cast(FULL))
    limit = F.array(F.struct(F.lit(V.ENGINE).alias("policy"), m["label"].alias("label"), F.lit("block").alias("action"), F.lit(None).cast("double").alias("score"), S.none().alias("spans"), F.lit("text").alias("target"), F.lit(None).cast("int").alias("idx"))).cast(FULL)
    out = ready.withColumn(c["said"], F.when(m["label"].isNotNull(), limit).otherwise(merge_findings(F.col(c["all"]))))
    results = ("sanitized", "findings", "scores", "usage", "staged", "decision", "complete", "ok", "onward")
    keep = [F.col(x) for x in df.columns if x.lower() not in results]
    first = decision(F.col(c["said"])) == "allow"
    whole_ok = m["complete"] & ~lost & m["label"].isNull()
    out = out.select(*keep, *(F.col(x) for x in c.values() if x in out.columns), (first & whole_ok).alias(f"{tag}_good"), whole_ok.alias("complete"), scores.alias("scores"), usage.alias("usage"))
    good = F.col(f"{tag}_good")
    if stage == "output":
        out = out.withColumn(f"{tag}_later", F.when(good, F.concat(F.col(c["said"]), m["afterwards"])).otherwise(F.col(c["said"])))
        out = out.withColumn("findings", merge_findings(F.col(f"{tag}_later")))
    else:
        out = out.withColumn("findings", F.col(c["said"]))
    out = out.withColumn("decision", decision(F.col("findings"))).withColumn("ok", (F.col("decision") == "allow") & F.col("complete"))
    passed = F.col(c["in"]) if stage == "tool_call" else m["restored"] if stage == "output" else m["text"]
    out = out.withColumn("sanitized", F.coalesce(m["text"], F.lit(""))).withColumn("staged", F.when(F.col("ok"), m["staged"]).otherwise(F.array().cast(ENTRY)))
    out = out.withColumn("onward", F.when(F.col("ok"), passed).otherwise(refusal(F.col("findings"), stage)))
    return out.select(*keep, *results)


def findings_of(df: DataFrame, policy: P.Policy, stage: str, text: str = "text", key: bytes = b"") -> DataFrame:
    """`df` with `found` (label, action, spans) and `edited`, the text after a single policy, which replace columns of these names. Null text counts as empty."""
    policy.prepare(df.sparkSession)
    ship(df.sparkSession)
    spec = Preparation(stage, (policy,), (), Limits(max_redactions=1 << 30), key or policy_key(policy), False, frozenset(), "block", False)
    kind = "struct<found:array<struct<label:string,action:string,spans:array<struct<start:int,end:int>>>>,edited:string>"
    arrow = to_arrow_type(T._parse_datatype_string(kind))
    place = P.Place(stage, stage)

    def one(value: str) -> dict:
        talk = Conversation(spec, None)
        if isinstance(policy, P.Sensitive):
            hits = policy.hits(value, place)
            found, edits = P.grouped(hits), talk.edits(value, hits, policy, stage not in ("output", "tool_call"), False)
        else:
            found, edits = P.checked(policy, policy.run(value, place), len(value))
        if stage == "tool_call":
            edits = []
        return {"found": [{"label": x, "action": a, "spans": [{"start": i, "end": j} for i, j in s]} for x, a, s in found], "edited": A.Aligned(value).edited(edits).text}

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else one(v) for v in values.to_pylist()], arrow)

    tag = f"_{uuid.uuid4().hex[:10]}"
    keep = [F.col(x) for x in df.columns if x.lower() not in ("found", "edited")]
    original = F.coalesce(F.col(text).cast("string"), F.lit(""))
    ready = df.withColumn(f"{tag}_in", original).withColumn(f"{tag}_out", run(F.when(policy.gate(original), original)))
    made = F.coalesce(F.col(f"{tag}_out"), F.struct(F.array().cast(kind[kind.index("array") : kind.rindex(",edited")]).alias("found"), F.col(f"{tag}_in").alias("edited")))
    ready = ready.withColumn(f"{tag}_made", made)
    return ready.select(*keep, F.col(f"{tag}_made.found").alias("found"), F.col(f"{tag}_made.edited").alias("edited"))


def policy_key(policy: P.Policy) -> bytes:
    return getattr(policy, "key", None) or b""
