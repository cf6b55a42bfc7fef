"""Policies from a JSON configuration: `{"guards": {name: {"enabled": true, field: value}}}`."""

from __future__ import annotations

import json
from dataclasses import fields

from textward.operators import judgments as J
from textward.operators import policies as P

GUARDS = {
    "invisible_text": P.InvisibleText,
    "regex": P.Regex,
    "substrings": P.Substrings,
    "allowed_tools": P.AllowedTools,
    "reading_time": P.ReadingTime,
    "token_limit": P.TokenLimit,
    "json_check": P.JsonCheck,
    "pii": P.Pii,
    "secrets": P.Secrets,
    "canary": P.Canary,
}


#: Judgments and the fields that each has beside its threshold.
JUDGMENTS = {
    "injection": (J.injection, {}), "indirect_injection": (J.indirect_injection, {}), "tool_safety": (J.tool_safety, {}), "hazards": (J.hazards, {"categories": list}),
    "toxicity": (J.toxicity, {"labels": list}), "topics": (J.topics, {"deny": list}), "malicious_urls": (J.malicious_urls, {"max_urls": int}),
}


def _guards(text: str) -> list[tuple[str, dict]]:
    try:
        found = json.loads(text)
    except ValueError:
        raise P.PolicyError("the configuration is no JSON") from None
    if not isinstance(found, dict) or not isinstance(found.get("guards"), dict) or set(found) - {"model", "guards"}:
        raise P.PolicyError("the configuration needs guards, and knows model besides")
    out = []
    for name, options in found["guards"].items():
        if name not in GUARDS and name not in JUDGMENTS:
            raise P.PolicyError(f"unknown guard: {name}")
        if not isinstance(options, dict):
            raise P.PolicyError(f"{name} needs an object")
        options = dict(options)
        enabled = options.pop("enabled", True)
        if not isinstance(enabled, bool):
            raise P.PolicyError(f"wrong type for {name}.enabled")
        if enabled:
            out.append((name, options))
    return out


def _typed(name: str, options: dict, known: dict) -> None:
    for key, value in options.items():
        if key not in known:
            raise P.PolicyError(f"unknown field of {name}: {key}")
        kind = known[key]
        if kind and (not isinstance(value, kind) or kind is int and isinstance(value, bool) or kind is list and not all(isinstance(x, str) for x in value)):
            raise P.PolicyError(f"wrong type for {name}.{key}")


def policies_from(text: str) -> list[P.Policy]:
    """The enabled policies, in order. An unknown guard, field or type is an error, before any row is read."""
    out = []
    for name, options in _guards(text):
        if name in GUARDS:
            kinds = {"int": int, "bool": bool, "str": str, "str | None": str, "Iterable[str]": list}
            _typed(name, options, {f.name: kinds[f.type] for f in fields(GUARDS[name]) if f.type in kinds})
            out.append(GUARDS[name](**options))
    return out


def judgments_from(text: str) -> list[J.Judgment]:
    """The enabled judgments, in order; each has a threshold: a number, or block_at and flag_at."""
    out = []
    for name, options in _guards(text):
        if name in JUDGMENTS:
            make, known = JUDGMENTS[name]
            limit = options.pop("threshold", None)
            if isinstance(limit, dict) and set(limit) <= {"block_at", "flag_at"} and "block_at" in limit:
                limit = J.Threshold(**limit)
            elif isinstance(limit, bool) or not isinstance(limit, (int, float)):
                raise P.PolicyError(f"{name} needs a threshold")
            _typed(name, options, known)
            out.append(make(threshold=limit, **options))
    return out
