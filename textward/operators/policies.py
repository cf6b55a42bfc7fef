"""Policies: what is found in a text, and what is done about it.

A policy says in a native expression which texts it may have something to say
about (`gate`); only those reach Python, where `run` looks at one text in linear
time and returns findings (label, action, spans) and edits (start, end,
replacement), sorted and non-overlapping. Offsets are code points.
"""

from __future__ import annotations

import itertools
import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textward.functions import aligned as A
from textward.functions import text as T
from textward.functions import values as V

Finding = tuple[str, str, list[A.Span]]
ACTIONS = ("flag", "redact", "block")
_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_-]{0,63}")


class PolicyError(ValueError):
    """A policy that can't be built."""


class PolicyFailure(RuntimeError):
    """A policy that broke its contract on a text; says nothing of the text."""


def identifier(name: str) -> str:
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        raise PolicyError(f"not an identifier: {name!r}")
    return name


@dataclass(frozen=True)
class Place:
    """Where a text stands: the stage of the check, the stage it came from, what it is to the check, its tool."""

    stage: str
    origin: str
    target: str = "text"
    tool: str | None = None


@dataclass
class Policy:
    """`stages` are the origins of text it looks at, `phase` its place in the order."""

    name: str
    stages: Iterable[str] = V.TEXT_STAGES
    phase: str = "detect"

    def __post_init__(self) -> None:
        identifier(self.name)
        self.stages = tuple(self.stages)
        if not set(self.stages) <= set(V.STAGES) or not self.stages:
            raise PolicyError("unknown stage")
        if self.phase not in ("normalize", "detect", "limit"):
            raise PolicyError("unknown phase")

    def gate(self, text: Column) -> Column:
        """False only for texts in which nothing can be found."""
        return F.lit(True)

    def prepare(self, spark: SparkSession) -> None:
        """Fetch at the driver what `run` needs."""

    def run(self, text: str, place: Place) -> tuple[list[Finding], list[A.Edit]]:
        raise NotImplementedError

    def outcome(self, spans: list[A.Span], label: str, action: str, replacement: str = V.REDACTED) -> tuple[list[Finding], list[A.Edit]]:
        spans = A.merged(spans)
        if not spans:
            return [], []
        return [(label, action, spans)], [(a, b, replacement) for a, b in spans] if action == "redact" else []


@dataclass
class Transform(Policy):
    """A policy of one's own: `apply(text, place)` returns findings and edits, which are checked."""

    name: str = "transform"
    apply: Callable[[str, Place], tuple[list[Finding], list[A.Edit]]] | None = None
    when: Callable[[Column], Column] | None = None

    def gate(self, text: Column) -> Column:
        return self.when(text) if self.when else F.lit(True)

    def run(self, text: str, place: Place) -> tuple[list[Finding], list[A.Edit]]:
        return self.apply(text, place)


def checked(policy: Policy, found: tuple, size: int) -> tuple[list[Finding], list[A.Edit]]:
    """What a policy returned, if it keeps the contract: labels are identifiers, actions known, spans inside the text."""
    try:
        findings, edits = found
        for label, action, spans in findings:
            identifier(label)
            if action not in ACTIONS or any(not 0 <= a <= b <= size for a, b in spans):
                raise PolicyFailure
        if any(not isinstance(r, str) or not 0 <= a <= b <= size for a, b, r in edits) or any(x[1] > y[0] for x, y in itertools.pairwise(edits)):
            raise PolicyFailure
    except (PolicyError, PolicyFailure, TypeError, ValueError):
        raise PolicyFailure(f"policy {policy.name} returned what it must not") from None
    return list(findings), list(edits)


_HIDDEN = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in V.HIDDEN) + "]+")
_SELECTORS = (range(0xFE00, 0xFE10), range(0xE0100, 0xE01F0), range(0x180B, 0x1810))


def _selects(selector: int, before: str, emoji: frozenset[int]) -> bool:
    """Whether a variation selector says something after a character, by the kind of character that has registered variants."""
    if selector in (0xFE0E, 0xFE0F):
        return ord(before) in emoji
    name = unicodedata.name(before, "")
    if selector in range(0x180B, 0x1810) and selector != 0x180E:
        return name.startswith("MONGOLIAN LETTER")
    if selector in range(0xE0100, 0xE01F0):
        return False
    return selector <= 0xFE02 and (name.startswith(("CJK UNIFIED", "MYANMAR LETTER", "PHAGS-PA LETTER", "FULLWIDTH", "IDEOGRAPHIC")) or unicodedata.category(before) == "Sm")


@dataclass
class InvisibleText(Policy):
    """Hidden and control characters go, or block.

    A variation selector stays after a character that has registered variants.
    Joiners stay, but with `everything`, which takes all format, private and
    unassigned characters as well.
    """

    name: str = "invisible_text"
    phase: str = "normalize"
    everything: bool = False
    block: bool = False
    emoji: frozenset[int] = field(default=frozenset(), repr=False)

    def gate(self, text: Column) -> Column:
        return text.rlike(V.INVISIBLE[:-1] + (r"\x{200c}\x{200d}\p{Cf}\p{Co}\p{Cn}]" if self.everything else "]"))

    def prepare(self, spark: SparkSession) -> None:
        self.emoji = T.emoji(spark.sparkContext.applicationId)

    def _stays(self, char: str, before: str) -> bool:
        """Whether a character found is a selector that means something after the last one that stays."""
        return char != "\u180e" and any(ord(char) in r for r in _SELECTORS) and before != "" and _selects(ord(char), before, self.emoji)

    def run(self, text: str, place: Place) -> tuple[list[Finding], list[A.Edit]]:
        spans = []
        for m in (_everything() if self.everything else _HIDDEN).finditer(text):
            before = text[max(0, m.start() - 1) : m.start()]
            for i in range(*m.span()):
                if self._stays(text[i], before):
                    before = text[i]
                else:
                    spans.append((i, i + 1))
        return self.outcome(spans, "invisible_text", "block" if self.block else "redact", "")


@lru_cache(maxsize=1)
def _everything() -> regex.Pattern:
    return regex.compile(_HIDDEN.pattern[:-2] + r"\u200c\u200d\p{Cf}\p{Co}\p{Cn}]+")


#: Patterns of literals, plain classes, groups and counts, which Java and Python read alike.
_COMMON = re.compile(r"(?:[A-Za-z0-9 _@#%&:;/'\"=<>!~,-]|\\[.$*+?(){}|\[\]^]|\[\^?[A-Za-z0-9 _@#%:;/'\"=<>!~,.$*+?&(){}|-]+\]|\{[0-9,]+\}|[*+|.])*")


@dataclass
class Regex(Policy):
    """Matches block or are redacted; with `require`, texts without a match block. Patterns are Python's; an empty match is none."""

    name: str = "regex"
    patterns: Iterable[str] = ()
    action: str = "block"
    fullmatch: bool = False
    require: bool = False
    fold: bool = False
    timeout_ms: int = 50
    table: dict[int, str] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        super().__post_init__()
        self.patterns = tuple(self.patterns)
        if not self.patterns:
            raise PolicyError("regex needs at least one pattern")
        if self.action not in ("block", "redact") or self.timeout_ms < 1:
            raise PolicyError("a regex blocks or redacts, and has some time")
        if self.require and self.action != "block":
            raise PolicyError("a required pattern blocks")
        try:
            for p in self.patterns:
                regex.compile(p)
        except regex.error:
            raise PolicyError("a pattern can't be compiled") from None

    def gate(self, text: Column) -> Column:
        if self.require or self.fold or not all(_COMMON.fullmatch(p) and "&&" not in p and "." not in re.sub(r"\\.|\[[^\]]*\]", "", p) for p in self.patterns):
            return F.lit(True)
        return reduce(lambda a, b: a | b, (text.rlike(p) for p in self.patterns))

    def prepare(self, spark: SparkSession) -> None:
        self.table = T.table_of(spark) if self.fold else {}

    def run(self, text: str, place: Place) -> tuple[list[Finding], list[A.Edit]]:
        view = A.folded_view(text, self.table) if self.fold else A.Aligned(text)
        spans: list[A.Span] = []
        seconds = self.timeout_ms / 1000
        try:
            for p in self.patterns:
                compiled = _compiled(p)
                if self.fullmatch:
                    found = [compiled.fullmatch(view.text, timeout=seconds)]
                else:
                    found = compiled.finditer(view.text, timeout=seconds)
                spans += [view.origin(*m.span()) for m in found if m and m.end() > m.start()]
        except TimeoutError:
            return [("regex_timeout", "block", [(0, len(text))])], []
        if self.require:
            return ([], []) if spans else ([("regex", "block", [])], [])
        return self.outcome(spans, "regex", self.action)


@lru_cache(maxsize=512)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def _near(text: Column, terms: Iterable[str], table: dict[int, str], fold: bool) -> Column:
    """Texts that may hold a term: the others are ASCII and do not hold it in their folded form."""
    terms = list(terms)
    if not fold:
        return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in terms))
    plain = T.native_fold(text, table)
    return ~T.is_ascii(text) | reduce(lambda a, b: a | b, (F.contains(plain, F.lit(T.fold_text(t, table))) for t in terms))


@dataclass
class Substrings(Policy):
    """Terms wherever they start, overlaps included; with `fold`, lookalike spellings too."""

    name: str = "substrings"
    terms: Iterable[str] = ()
    action: str = "block"
    whole_words: bool = False
    fold: bool = True
    table: dict[int, str] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        super().__post_init__()
        self.terms = tuple(self.terms)
        if not self.terms or not all(self.terms):
            raise PolicyError("substrings needs non-empty terms")
        if self.action not in ("block", "redact"):
            raise PolicyError("substrings block or are redacted")

    def prepare(self, spark: SparkSession) -> None:
        self.table = T.table_of(spark) if self.fold else {}
        if self.fold and not all(T.fold_text(t, self.table) for t in self.terms):
            raise PolicyError("a term folds to nothing")

    def gate(self, text: Column) -> Column:
        return _near(text, self.terms, self.table, self.fold)

    def run(self, text: str, place: Place) -> tuple[list[Finding], list[A.Edit]]:
        terms = [T.fold_text(t, self.table) for t in self.terms] if self.fold else self.terms
        if self.fold:
            quick = T.fold_text(text, self.table)
            terms = [t for t in terms if t in quick]
            if not terms:
                return [], []
        view = A.folded_view(text, self.table) if self.fold else A.Aligned(text)
        spans = []
        for t in terms:
            for a, b in A.occurrences(view.text, t):
                if not self.whole_words or not (a and A.is_word(view.text[a - 1])) and not (b < len(view.text) and A.is_word(view.text[b])):
                    spans.append(view.origin(a, b))
        return self.outcome(spans, "substrings", self.action)


def competitors(names: Iterable[str]) -> Substrings:
    """Names that are replaced, as whole words."""
    return Substrings(name="competitors", terms=names, action="redact", whole_words=True)


def refusal_phrases(phrases: Iterable[str] = V.REFUSAL_PHRASES) -> Substrings:
    """Replies that refuse block."""
    return Substrings(name="refusal_phrases", terms=phrases, stages=("output",))


@dataclass
class AllowedTools(Policy):
    """Calls of tools that are not listed block. A long list is better joined: `joins.outside`."""

    name: str = "allowed_tools"
    stages: Iterable[str] = ("tool_call",)
    tools: Iterable[str] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        self.tools = frozenset(self.tools)

    def blocked(self, tool: Column) -> Column:
        return ~F.coalesce(tool.isin(sorted(self.tools)), F.lit(False)) if self.tools else F.lit(True)

    def run(self, text: str, place: Place) -> tuple[list[Finding], list[A.Edit]]:
        return ([], []) if place.target != "text" or place.tool in self.tools else ([("tool_name", "block", [])], [])


@dataclass
class _Limit(Policy):
    phase: str = "limit"
    most: int = 1
    truncate: bool = False
    cut: str = "redact"

    def __post_init__(self) -> None:
        super().__post_init__()
        if isinstance(self.most, bool) or self.most < 1:
            raise PolicyError(f"{self.name} needs a positive limit")

    def end(self, text: str) -> int | None:
        """Where what the limit allows ends; None within the limit."""
        raise NotImplementedError

    def run(self, text: str, place: Place) -> tuple[list[Finding], list[A.Edit]]:
        end = self.end(text)
        if end is None:
            return [], []
        whole = [(0, len(text))]
        if not self.truncate:
            return [(self.name, "block", whole)], []
        rest = [(end, len(text), "")] if end < len(text) else []
        return [(self.name, self.cut, whole if self.cut == "flag" else [(end, len(text))])], rest


def _after(pattern: re.Pattern, text: str, most: int) -> int | None:
    """Where the match number `most` ends, if there is one more."""
    end = 0
    for k, m in enumerate(pattern.finditer(text)):
        if k == most:
            return end
        end = m.end()
    return None


_WORD = re.compile(r"\S+")


@dataclass
class ReadingTime(_Limit):
    """Texts that take longer than `most` words to read, at 200 words a minute."""

    name: str = "reading_time"
    stages: Iterable[str] = ("input", "output")
    most: int = V.WORDS_PER_MINUTE

    def gate(self, text: Column) -> Column:
        return F.length(text) > 2 * self.most

    def end(self, text: str) -> int | None:
        return _after(_WORD, text, self.most)


@lru_cache(maxsize=4)
def _vocabulary(path: str, pattern: str):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})


@dataclass
class TokenLimit(_Limit):
    """Texts of more than `most` tokens.

    A token is one of the vocabulary in the rank file `vocabulary`, whose words
    `pattern` cuts; without a file it is a match of `pattern`, by default a run of
    word characters or one other sign.
    """

    name: str = "token_limit"
    stages: Iterable[str] = ("input",)
    pattern: str = r"\w+|[^\w\s]"
    vocabulary: str | None = None
    cut: str = "flag"

    def gate(self, text: Column) -> Column:
        return F.octet_length(text) > self.most

    def end(self, text: str) -> int | None:
        if self.vocabulary is None:
            return _after(re.compile(self.pattern), text, self.most)
        coder = _vocabulary(self.vocabulary, self.pattern)
        ids = coder.encode_ordinary(text)
        return None if len(ids) <= self.most else len(coder.decode_bytes(ids[: self.most]).decode(errors="ignore"))


def first_json(text: str, attempts: int = 100) -> tuple[int, int, object] | None:
    """(start, end, value) of the first object or array that decodes, from at most `attempts` brackets."""
    decoder = json.JSONDecoder()
    for m in itertools.islice(re.finditer(r"[{\[]", text), attempts):
        try:
            value, end = decoder.raw_decode(text, m.start())
        except (ValueError, RecursionError):
            continue
        return m.start(), end, value
    return None


_BARE = re.compile(r"[^\s,:\[\]{}\"']+")
_WORDS = {"true": True, "True": True, "false": False, "False": False, "null": None, "None": None}


class _Mender:
    """Reads what is nearly JSON: single quotes, bare words, missing or surplus commas, missing ends."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        while self.at < len(self.text) and self.text[self.at] in " \t\r\n,":
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self, depth: int = 0) -> object:
        c = self.peek()
        if depth > 200:
            raise ValueError("too deep")
        if c in ("{", "["):
            self.at += 1
            return self.items(depth) if c == "{" else self.elements(depth)
        return self.string(c) if c in ("'", '"') else self.bare()

    def items(self, depth: int) -> dict:
        out: dict = {}
        while (c := self.peek()) not in ("", "}"):
            key = self.string(c) if c in ("'", '"') else str(self.bare())
            if self.peek() == ":":
                self.at += 1
                out[key] = self.value(depth + 1) if self.peek() not in ("", "}") else None
            else:
                out[key] = None
        self.at += 1
        return out

    def elements(self, depth: int) -> list:
        out: list = []
        while (c := self.peek()) not in ("", "]"):
            if c in ("}", ":"):
                self.at += 1
                continue
            out.append(self.value(depth + 1))
        self.at += 1
        return out

    def string(self, quote: str) -> str:
        self.at += 1
        start = self.at
        while self.at < len(self.text) and self.text[self.at] != quote:
            self.at += 2 if self.text[self.at] == "\\" else 1
        body = self.text[start : self.at]
        self.at += 1
        try:
            return json.loads(f'"{body}"' if quote == '"' else '"' + body.replace("\\'", "'").replace('"', '\\"') + '"', strict=False)
        except ValueError:
            return body

    def bare(self) -> object:
        m = _BARE.match(self.text, self.at)
        if m is None:
            self.at += 1
            return None
        self.at = m.end()
        if m[0] in _WORDS:
            return _WORDS[m[0]]
        try:
            found = json.loads(m[0])
        except ValueError:
            return m[0]
        return found if math.isfinite(found) else m[0]


@dataclass
class JsonCheck(Policy):
    """Replies without a JSON object or array of at least `required_elements` items block.

    With `repair`, what is nearly JSON from the first bracket on is mended, to the
    end of the reply, and the JSON is written in its canonical form.
    """

    name: str = "json_check"
    stages: Iterable[str] = ("output",)
    required_elements: int = 0
    repair: bool = False

    def __post_init__(self) -> None:
        super().__post_init__()
        if isinstance(self.required_elements, bool) or self.required_elements < 0:
            raise PolicyError("required_elements is zero or more")

    def run(self, text: str, place: Place) -> tuple[list[Finding], list[A.Edit]]:
        found = first_json(text, 1 if self.repair else 100)
        if found is None and self.repair and (m := re.search(r"[{\[]", text)):
            try:
                found = (m.start(), len(text), _Mender(text[m.start() :]).value())
            except ValueError:
                found = None
        if found is None:
            return [("json_check", "block", [(0, len(text))])], []
        start, end, value = found
        if len(value) < self.required_elements:
            return [("json_check", "block", [(start, end)])], []
        if not self.repair:
            return [], []
        written = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        return ([], []) if text[start:end] == written else ([("json_check", "redact", [(start, end)])], [(start, end, written)])


#: (start, end, entity, how it is replaced, action)
Hit = tuple[int, int, str, str, str]


@dataclass
class Sensitive(Policy):
    """Values found in a text, and how they are replaced by where the text comes from."""

    stages: Iterable[str] = V.STAGES
    key: bytes | None = field(default=None, repr=False)

    def hits(self, text: str, place: Place) -> list[Hit]:
        raise NotImplementedError

    def run(self, text: str, place: Place) -> tuple[list[Finding], list[A.Edit]]:
        """Findings alone; a check makes the edits, as they depend on the conversation."""
        return grouped(self.hits(text, place)), []


def grouped(hits: Iterable[Hit]) -> list[Finding]:
    """One finding for each entity and action, its spans merged, in the order they first occur."""
    found: dict[tuple[str, str], list[A.Span]] = {}
    for start, end, entity, _, action in hits:
        found.setdefault((entity, action), []).append((start, end))
    return [(entity, action, A.merged(spans)) for (entity, action), spans in found.items()]


def everywhere(text: str, hits: list[Hit]) -> list[Hit]:
    """The hits and every other standalone occurrence of their values; what overlaps goes with the earlier one."""
    by_value = {text[h[0] : h[1]]: h for h in reversed(hits)}
    known = {h[:2] for h in hits}
    more = ((m.span(), h) for value, h in by_value.items() for m in re.finditer(re.escape(value), text))
    rows = sorted([*hits, *((*s, *h[2:]) for s, h in more if s not in known and A.standalone(text, *s))], key=lambda h: (h[0], -h[1]))
    return [(rows[k][0], end, *rows[k][2:]) for k, end in A.runs(rows, False)]


_PATTERNS = {name: re.compile(pattern) for name, pattern in V.PII}
_PHONE_ANYWHERE = re.compile(V.PHONE_ANYWHERE)
_SIGNS = {
    "EMAIL_ADDRESS": "@",
    "UUID": r"[0-9a-fA-F]-[0-9a-fA-F]{4}-",
    "IP_ADDRESS": r"[0-9]\.[0-9]{1,3}\.[0-9]",
    "US_SSN": r"[0-9]-[0-9]{2}-[0-9]",
    "IBAN_CODE": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10}",
    "PHONE_NUMBER": r"[0-9]{3}[-.\s][0-9]{4}",
    "US_BANK_NUMBER": r"[0-9]{9}",
    "CRYPTO": r"[13][a-km-zA-HJ-NP-Z1-9]{25}",
    "CREDIT_CARD": r"[0-9](?:[ -]*[0-9]){12}",
}


def _unsteady(text: Column) -> Column:
    """Texts that may read otherwise in the plain view."""
    return ~T.is_ascii(text) & ~text.rlike(rf"\A{V.STEADY}*+\z")


@dataclass
class Pii(Sensitive):
    """Personal data by pattern. `people` finds names: a function from a text to spans, as no library for them is at hand.

    With `phone_anywhere` a phone number may touch letters and digits, as in `126.253.1264880761`.
    """

    name: str = "pii"
    entities: Iterable[str] = V.DEFAULT_PII
    input_mode: str = "redact"
    untrusted_mode: str = "mask"
    output_mode: str = "flag"
    tool_call_mode: str = "block"
    restore: bool = True
    people: Callable[[str], Iterable[A.Span]] | None = None
    phone_anywhere: bool = False

    def __post_init__(self) -> None:
        super().__post_init__()
        self.entities = tuple(self.entities)
        if unknown := set(self.entities) - set(_PATTERNS) - {"PERSON"}:
            raise PolicyError(f"unknown entity: {min(unknown)}")
        if "PERSON" in self.entities and self.people is None:
            raise PolicyError("PERSON needs a function that finds names")
        for mode, known in ((self.input_mode, "redact mask block"), (self.untrusted_mode, "redact mask block"), (self.output_mode, "flag redact block"), (self.tool_call_mode, "flag redact block")):
            if mode not in known.split():
                raise PolicyError(f"unknown mode: {mode}")

    def gate(self, text: Column) -> Column:
        if "PERSON" in self.entities:
            return F.lit(True)
        signs = [F.contains(text, F.lit("@")) if e == "EMAIL_ADDRESS" else text.rlike(_SIGNS[e]) for e in self.entities]
        return reduce(lambda a, b: a | b, signs, _unsteady(text))

    def mode(self, origin: str) -> tuple[str, str]:
        """How a value is replaced, and the action, by where its text comes from."""
        table = {
            "tool_call": {m: ("remove", m) for m in ("flag", "redact", "block")},
            "output": {"flag": ("local", "flag"), "redact": ("remove", "redact"), "block": ("remove", "block")},
            "untrusted": {"redact": ("remove", "redact"), "mask": ("partial", "redact"), "block": ("partial", "block")},
            "input": {"redact": ("token" if self.restore else "remove", "redact"), "mask": ("partial", "redact"), "block": ("remove", "block")},
        }
        asked = {"tool_call": self.tool_call_mode, "output": self.output_mode, "input": self.input_mode}
        return table["untrusted" if origin == "tool_result" else origin][asked.get(origin, self.untrusted_mode)]

    def hits(self, text: str, place: Place) -> list[Hit]:
        view = A.plain_view(text)
        rows = []
        for entity, pattern in _PATTERNS.items():
            if entity in self.entities:
                pattern = _PHONE_ANYWHERE if entity == "PHONE_NUMBER" and self.phone_anywhere else pattern
                rows += [(*view.origin(*m.span()), entity) for m in pattern.finditer(view.text) if entity != "CREDIT_CARD" or T.passes_luhn(m[0])]
        if "PERSON" in self.entities:
            rows += [(a, b, "PERSON") for a, b in self.people(text) if a < b]
        return [(*row, *self.mode(place.origin)) for row in A.disjoint(rows)]


_KEYS = [re.compile(p) for p in V.SECRETS]
_KEYWORD, _QUOTED = re.compile(V.SECRET_KEYWORD), re.compile(V.QUOTED)
_KEY_SIGNS = ("sk-", "_pat_", "xox", "AKIA", "ASIA", "AIza", "_live_", "_test_", "PRIVATE KEY", *(f"gh{c}_" for c in "pousr"))


def entropy(text: str) -> float:
    """Bits a character, by the text's own frequencies."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def secret_spans(text: str) -> list[A.Span]:
    """Key formats of vendors, values after a keyword, quoted strings of high entropy."""
    out = []
    if any(sign in text for sign in _KEY_SIGNS):
        out += [m.span() for p in _KEYS for m in p.finditer(text)]
    out += [m.span(1) for m in _KEYWORD.finditer(text)]
    for m in _QUOTED.finditer(text):
        hexadecimal = all(c in "0123456789abcdefABCDEF" for c in m[1])
        if not m[1].isdigit() and entropy(m[1]) > (V.HEX_ENTROPY if hexadecimal else V.TEXT_ENTROPY):
            out.append(m.span(1))
    return A.merged(out)


@dataclass
class Secrets(Sensitive):
    name: str = "secrets"
    how: str = "mask"

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.how not in ("mask", "partial", "hmac"):
            raise PolicyError("secrets are masked, shown in part, or hashed")
        if (self.how == "hmac") != (self.key is not None) or self.key is not None and len(self.key) < 32:
            raise PolicyError("hmac needs a key of at least 32 bytes, and nothing else does")

    def gate(self, text: Column) -> Column:
        signs = [F.contains(text, F.lit(s)) for s in _KEY_SIGNS]
        return reduce(lambda a, b: a | b, signs, _unsteady(text) | text.rlike(r"(?i)(?:token|secret|passw(?:or)?d|api_?key) {0,3}[:=]") | text.rlike(r"[\"'][A-Za-z0-9+/=_-]{20}"))

    def hits(self, text: str, place: Place) -> list[Hit]:
        view = A.plain_view(text)
        action = "block" if place.origin == "tool_call" else "redact"
        return [(a, b, "secret", self.how, action) for a, b in A.merged(view.origin(*s) for s in secret_spans(view.text))]


@dataclass
class Canary(Sensitive):
    """A marker that must not leave: it is removed and blocks, in lookalike spellings too."""

    name: str = "canary"
    stages: Iterable[str] = ("output", "tool_call")
    word: str = ""
    table: dict[int, str] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        super().__post_init__()
        if not self.word.strip():
            raise PolicyError("a canary is not empty")

    def prepare(self, spark: SparkSession) -> None:
        self.table = T.table_of(spark)
        if not T.fold_text(self.word, self.table):
            raise PolicyError("a canary folds to something")

    def gate(self, text: Column) -> Column:
        return _near(text, (self.word,), self.table, True) | F.contains(text, F.lit(self.word))

    def hits(self, text: str, place: Place) -> list[Hit]:
        spans = A.occurrences(text, self.word)
        needle = T.fold_text(self.word, self.table)
        if needle in T.fold_text(text, self.table):
            view = A.folded_view(text, self.table)
            spans += [view.origin(*s) for s in A.occurrences(view.text, needle)]
        return [(a, b, "canary", "remove", "block") for a, b in A.merged(spans)]


#: How tokens and markers begin, and what that becomes in text that only looks like one.
OPEN, ESCAPED = "[TW_", "[TW:"
TOKEN = re.compile(r"\[TW_PII_[A-Za-z0-9_-]{22}\]")


def escapes(text: str) -> list[A.Edit]:
    """Edits after which nothing in an incoming text looks like a token of ours; a second time there are none."""
    return [(a, b, ESCAPED) for a, b in A.occurrences(text, OPEN)]


def escape_placeholders(text: Column) -> Column:
    """`escapes`, applied to a column."""
    return F.replace(text, F.lit(OPEN), F.lit(ESCAPED))
