"""Patterns, term lists, labels and limits that results depend on."""

# Personal-data entities and their patterns, in the order they are tried.
PII = (
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("UUID", r"\b[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\b"),
    ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b"),
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("IBAN_CODE", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b"),
    ("PHONE_NUMBER", r"(?<!\w)(?:\+?1[-.\s]?)?(?:\(\d{3}\)\s?|\d{3}[-.\s])\d{3}[-.\s]\d{4}(?!\w)"),
    ("US_BANK_NUMBER", r"\b\d{9}\b"),
    ("CRYPTO", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b"),
    ("CREDIT_CARD", r"\b(?:\d[ -]*?){13,19}\b"),
)
#: A phone number anywhere, by ASCII digits and whitespace, inside a longer run of letters and digits as well.
PHONE_ANYWHERE = r"(?:\+?1[-. \t\n\f\r]?)?(?:\([0-9]{3}\)[ \t\n\f\r]?|[0-9]{3}[-. \t\n\f\r])[0-9]{3}[-. \t\n\f\r][0-9]{4}"
DEFAULT_PII = ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "US_SSN", "IBAN_CODE", "CRYPTO")

# Key formats of vendors.
SECRETS = (
    r"\bsk-[A-Za-z0-9][A-Za-z0-9_-]{19,}",
    r"\bgh[pousr]_[A-Za-z0-9]{36,}",
    r"\bgithub_pat_[A-Za-z0-9_]{22,}",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bAIza[0-9A-Za-z_-]{35}",
    r"\b(?:sk|rk)_(?:live|test)_[0-9A-Za-z]{16,}",
    r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----",
)
#: Our own rules: a keyword with a value (group 1 is what is found), and quoted strings of high entropy.
SECRET_KEYWORD = r"(?i)\b(?:token|secret|password|passwd|api_key|apikey) {0,3}[:=] {0,3}[\"']?([A-Za-z0-9+/_.=-]{8,})"
QUOTED = r"[\"']([A-Za-z0-9+/=_-]{20,})[\"']"
HEX_ENTROPY, TEXT_ENTROPY = 3.0, 4.5

# Opt-in exploit phrases.
EXPLOIT_TERMS = (
    "arbitrary code execution",
    "a backdoor",
    "code injection",
    "cross-site scripting",
    "email spoofing",
    "a keylogger",
    "privilege escalation",
    "a rootkit",
    "a bootkit",
    "screen scraping",
    "corrupting a disk partition",
    "cryptojacking",
    "a botnet",
    "adware",
    "ransomware",
    r"Windows\System32\Config\SAM",
    "etc/shadow",
    "escalate privilege",
    "read the encrypted system password file",
)
# Refusals in replies.
REFUSAL_PHRASES = ("I cannot help with that", "I can't assist with that", "I will not provide that")

# What marks a URL, what ends it, and a URL item.
URL_ITEM = r"(?i)https?://[^\s<>\"']+"
URL_START = r"[A-Za-z][A-Za-z0-9+.-]*://|(?<![A-Za-z0-9+.-])(?:mailto|data|javascript|vbscript|file|tel|sms|blob):|(?<![:/])//|(?<![A-Za-z0-9.-])www\."
URL_REST = r"[^\s<>\"'`\x00-\x1f\x7f-\x9f]*"

#: Characters that the targeted mode looks at: controls but tab, line feed and return, bidi controls, default-ignorables without joiners.
HIDDEN = (
    (0x0, 0x8), (0xB, 0xC), (0xE, 0x1F), (0x7F, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200B),
    (0x200E, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3),
    (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
INVISIBLE = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in HIDDEN) + "]"
#: Signs that no compatibility mapping touches: rows of these alone read the same in the plain view.
STEADY = (
    r"[\x00-\x7F\xA1-\xA7\xA9\xAB\xAC\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0180-\u01C3\u01CD-\u01F0\u01F4-\u024F"
    r"\u2010\u2012-\u2015\u2018-\u201F\u2020-\u2023]"
)

REDACTED = "[REDACTED]"
STAGES = ("input", "untrusted", "tool_call", "tool_result", "output")
TEXT_STAGES = ("input", "untrusted", "tool_result", "output")
WORDS_PER_MINUTE = 200
ENGINE = "engine"

# The hazards, kinds of toxicity, emotions and programming languages that judgments name.
HAZARDS = {
    "S1": "Violent crimes", "S2": "Non-violent crimes", "S3": "Sex-related crimes", "S4": "Child sexual exploitation", "S5": "Defamation", "S6": "Specialized advice", "S7": "Privacy",
    "S8": "Intellectual property", "S9": "Indiscriminate weapons", "S10": "Hate", "S11": "Suicide and self-harm", "S12": "Sexual content", "S13": "Elections", "S14": "Code interpreter abuse",
}
TOXICITY = ("toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack", "sexual_explicit")
EMOTIONS = ("anger", "annoyance", "disappointment", "disapproval", "disgust", "embarrassment", "fear", "grief", "nervousness", "remorse", "sadness")
CODE_LANGUAGES = ("python", "javascript", "sql", "shell", "html", "other")
