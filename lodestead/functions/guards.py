"""Text guards as column expressions: redaction, injection, damage, firmware, warranty, model, yes/no, step labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestead.functions.text import Pattern, any_match, let, may_match, strip

# Patterns whose matches decide the results, with their needles.
INJECTION = [
    Pattern(r"\b(?:ignore|disregard|forget|override|bypass|skip)\s+(?:(?:all|any|your|the|these|those|previous|prior|above|earlier|original|initial|system|safety|current)\s+){0,3}(?:instructions?|prompts?|rules?|guidelines?|directives?|policies|programming|training|constraints?)\b", "ignore", "disregard", "forget", "override", "bypass", "skip"),
    Pattern(r"\byou\s+are\s+now\b", "now"),
    Pattern(r"\bsystem\s+prompt\b", "prompt"),
    Pattern(r"\bjailbreak\b", "jailbreak"),
    Pattern(r"\bpretend\s+(?:to\s+be|you\s+are)\b", "pretend"),
]
DAMAGE = [
    Pattern(r"\bsmoke\b|\bsmoking\b", "smok"),
    Pattern(r"\bsparks?\b|\bsparking\b", "spark"),
    Pattern(r"\bburn(?:ing|t)\s+smell\b|\bsmells?\s+(?:like\s+)?(?:burning|burnt|smoke)\b", "smell"),
    Pattern(r"\bmelt(?:ed|ing)\b", "melt"),
    Pattern(r"\bwater\s+damage\b|\bliquid\s+(?:spill\w*|exposure|damage)\b", "water", "liquid"),
    Pattern(r"\bcracked\s+(?:housing|casing|case)\b", "cracked"),
    Pattern(r"\bcaught\s+fire\b|\bon\s+fire\b", "fire"),
]
FIRMWARE = [
    Pattern(r"\bopenwrt\b|\bdd-?wrt\b", "wrt"),
    Pattern(r"\b(?:custom|third[-\s]?party|unofficial)\s+firmware\b", "firmware"),
    Pattern(r"\bfirmware\s+(?:rollback|downgrade)\b", "firmware"),
    Pattern(r"\b(?:roll(?:\s|-)?back|downgrade)\s+(?:the\s+|my\s+)?firmware\b", "firmware"),
    Pattern(r"\b(?:re)?flash\s+(?:the\s+|my\s+|a\s+|new\s+|different\s+)?firmware\b", "firmware"),
]
WARRANTY = [
    Pattern(r"\bwarranty\s+(?:replacement|claim)\b", "warranty"),
    Pattern(r"\bclaim\s+(?:\w+\s+){0,2}?under\s+(?:the\s+)?warranty\b", "warranty"),
    Pattern(r"\breplace\s+(?:it|this|my\s+\w+)\s+under\s+warranty\b", "warranty"),
]
# Assent, refusal, and the names of models.
YES = [r"\b(yes|yep|yeah|proceed|confirm|confirmed|sure|ok|okay|go\s+ahead|do\s+it)\b"]
NO = [r"\b(no|cancel|stop|abort|don'?t|do\s+not|nevermind|never\s+mind|skip)\b"]
MODELS = [("Pro", [Pattern(r"\b(r5\s*pro|n5\s*pro|pro\s+gateway|pro\s+node)\b", "pro")]), ("R1", [Pattern(r"\b(r1|r1\s*router|main\s*router)\b", "r1", "router")]), ("N1", [Pattern(r"\b(n1|n1\s*node|satellite\s*node|satellite)\b", "n1", "satellite")])]
# Words that are no secret.
CONTINUATIONS = (
    "wrong", "incorrect", "invalid", "correct", "working", "changed", "missing", "different", "still", "also", "already", "probably", "definitely", "there",
    "here", "what", "that", "this", "case", "sensitive", "blank", "empty", "hidden", "visible", "forgotten", "unknown", "broken", "expired", "right", "fine",
    "okay", "gone", "same", "secure", "insecure", "weak", "strong", "safe", "long", "short", "required", "needed", "does", "doesn", "isn", "wasn", "didn",
    "don", "won", "shouldn", "couldn", "wouldn", "really", "very", "actually", "always", "never", "sometimes",
)
# Forms of keys and what names a secret.
API_KEY = Pattern(r"(?i)(?:sk-[A-Za-z0-9]{20,}|Bearer\s+[A-Za-z0-9._-]{20,})", "sk-", "bearer")
_NAMES = r"password|passcode|passphrase|wifi\s*key|network\s+key|wpa2?(?:\s+(?:key|passphrase))?|pwd|secret"
_SECRET = "[A-Za-z0-9!@#$%^&*()_+=\\-]"


def _redact(text: Column, pattern: Pattern, by: str) -> Column:
    return let(text, lambda t: F.when(may_match(F.lower(t), pattern), F.regexp_replace(t, pattern, by)).otherwise(t))


def redact_api_key(text: Column) -> Column:
    return _redact(text, API_KEY, "[REDACTED_API_KEY]")


def redact_password(text: Column) -> Column:
    """A secret of four characters or more after its name and a separator, unless it's an ordinary word or a contraction."""
    ordinary = "|".join(CONTINUATIONS)
    p = rf"(?i)\b(?:{_NAMES})(?:\s+is\s+|\s*[:=]\s*)(?!(?:{ordinary})(?!{_SECRET})){_SECRET}{{4,}}+(?!')"
    return _redact(text, Pattern(p, "passw", "passc", "passp", "key", "wpa", "pwd", "secret"), "password: [REDACTED_SECRET]")


def redact_serial(text: Column) -> Column:
    p = r"(?i)\b(?:sn|s/n|serial(?:\s*number)?)(?:\s+is\s+|\s*[:=]\s*)(?=[A-Za-z0-9-]*[0-9])[A-Za-z0-9-]+([A-Za-z0-9-]{4})\b(?!')"
    return _redact(text, Pattern(p, "sn", "s/n", "serial"), r"serial: [REDACTED_SERIAL_...$1]")


def inspect(text: Column) -> Column:
    """struct(isolated, is_safe, redacted): the input guard, whose injection test sees the text before redaction."""
    raw = strip(F.coalesce(text, F.lit("")))
    clean = redact_serial(redact_password(redact_api_key(raw)))
    return F.struct(F.concat(F.lit("<user_input>\n"), clean, F.lit("\n</user_input>")).alias("isolated"), (~any_match(raw, INJECTION)).alias("is_safe"), clean.alias("redacted"))


def model(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, patterns in reversed(MODELS):
        out = F.when(any_match(text, patterns), F.lit(name)).otherwise(out)
    return out


def step_label(action: Column, response: Column) -> Column:
    has = lambda *parts: [p for p in parts]
    ladder = [
        ("factory_reset", has("factory reset", "hold the reset", "reset pin")), ("cable_checked", has("ethernet", "cable")), ("power_cycled", has("power cycle", "unplug", "restart")),
        ("distance_checked", has("distance", "closer")), ("channel_optimized", has("channel", "app")),
    ]
    out = F.lit("instruction_step")
    for name, parts in reversed(ladder):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.lower(response).contains(p)
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.when(action == "instruct", out)


def coerce_action(action: Column) -> Column:
    return F.when(F.lower(strip(action)).isin("ask", "instruct", "resolved", "escalate"), F.lower(strip(action))).otherwise("ask")
