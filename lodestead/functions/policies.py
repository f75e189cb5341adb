"""Answer policies as column expressions: hazards, solicitation, factory resets, escalation, and the sentences they quote.

An envelope is struct(response, citations array<struct(source_id, locator)>, action). What policies quote comes from the
sections of policy documents (read_policy); where a section lacks the sentence, a default stands in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestead.functions import guards
from lodestead.functions.text import Pattern, any_case, any_match, let, may_match, strip

# Surfaces of software, and patterns whose matches decide the results, with their needles.
_SURFACE = r"(?:app|apps|application|settings?|console|dashboard|software|portal|page|interface|ui|admin)"
DANGER = (
    Pattern(r"\bopen(?:ing|ed)?\s+(?:up\s+)?(?:the\s+|my\s+|your\s+|a\s+|an\s+|this\s+|that\s+)?(?:router|gateway|node|unit|device|adapter)\b(?!(?:'s)?\s+" + _SURFACE + r"\b)", "open"),
    Pattern(r"\bopen(?:ing|ed)?\s+(?:up\s+)?(?:the|its|my|your|this|that)\s+(?:(?!support\b|ticket\b)\w+\s+){0,2}?(?:case|casing|cover|enclosure|housing|shell|chassis)\b", "open"),
    Pattern(r"\bunscrew\w*\b", "unscrew"),
    Pattern(r"\bdisassembl\w+\b", "disassembl"),
    Pattern(r"\btake\s+(?:it\s+|(?:the|my|your)\s+\w+\s+)?apart\b", "apart"),
    Pattern(r"\bsolder\w*\b", "solder"),
    Pattern(r"\brepair\s+(?:the\s+)?circuit\w*\b", "circuit"),
    Pattern(r"\bexposed?\s+wir\w+\b", "expose"),
    Pattern(r"\binternal\s+capacitor\w*\b", "capacitor"),
    Pattern(r"\b(?:pry|crack)\s+(?:it\s+)?open\b", "open"),
    Pattern(r"\bremove\s+(?:the\s+)?(?:cover|casing|housing|back\s*plate)\b", "remove"),
)
# Names of secrets, requests for one, and the negations before them that make them advice.
_SECRETS = (
    r"(?:passwords?\b|passcodes?\b|passphrases?\b|(?:wi[-\s]?fi|network|wpa2?|security|api|secret|private|admin|account|login|encryption|recovery)\s+keys?\b|"
    r"credit\s+cards?(?:\s+numbers?)?\b|payment\s+(?:info(?:rmation)?|details?)\b|(?:full|entire|complete|whole)\s+serial(?:\s+numbers?)?\b)"
)
_FILLER = r"(?:\w+[-']?\w*\s+)"
_KINDS = ("passw", "passc", "passp", "key", "credit", "payment", "serial")
SOLICITATION = (
    Pattern(r"\b(?:enter|provide|type|give|send|share|tell|paste|input|supply|confirm|text|email)\s+(?:me\s+|us\s+)?" + _FILLER + r"{0,4}?" + _SECRETS
        + r"(?!\s+(?:in|into|on)\s+(?:the|your)\s+(?:app|application|router|device|phone|laptop|browser|portal|settings))", *_KINDS),
    Pattern(r"\bwhat(?:\s+is|'s)\s+(?:your|the)\s+" + _FILLER + r"{0,3}?" + _SECRETS, *_KINDS),
    Pattern(r"\b(?:i|we)(?:'ll|\s+will)?\s+(?:also\s+|just\s+)?need\s+(?:your|the)\s+" + _FILLER + r"{0,3}?" + _SECRETS, *_KINDS),
    Pattern(r"\b(?:may|can|could)\s+i\s+(?:please\s+)?(?:have|get)\s+(?:your|the)\s+" + _FILLER + r"{0,3}?" + _SECRETS, *_KINDS),
)
NEGATION = r"\b(?:never|don'?t|do\s+not|won'?t|will\s+not|shouldn'?t|should\s+not|no\s+need\s+to|not|without|avoid)\b"
LOOK_BACK = 40
# Names of a reset, requests for one, proposals of one, and insistence on it.
_RESET = r"(?:factory[-\s]+reset|factory\s+restore|full[-\s]+reset|hard[-\s]+reset)"
RESET_REQUEST = (
    Pattern(r"\b(?:how\s+do\s+i|how\s+can\s+i|how\s+to|i\s+(?:want|need|would\s+like)\s+(?:you\s+to|to)|i'?d\s+like\s+to|should\s+i|can\s+i|could\s+i|may\s+i|going\s+to|about\s+to|let'?s|please)\s+"
        r"(?:just\s+|go\s+ahead\s+and\s+)?(?:do\s+(?:a|the)\s+|perform\s+(?:a|the)\s+|run\s+(?:a|the)\s+|try\s+(?:a|the)\s+|start\s+(?:a|the)\s+)?(?:" + _RESET + r"|reset)\b", "reset", "restore"),
    Pattern(r"\b(?:do|perform|run|start|initiate|trigger)\s+(?:a|the)\s+(?:full\s+)?" + _RESET + r"\b", "reset", "restore"),
    Pattern(r"(?:^|[.!?]\s+)(?:please\s+|just\s+)?(?:factory[-\s]+)?reset\s+(?:it|everything|(?:the|my|this|that)\s+(?:whole\s+)?(?:router|gateway|node|unit|device|network|system|mesh))\b", "reset"),
    Pattern(r"\breset\s+(?:it\s+)?to\s+factory(?:\s+(?:defaults?|settings))?\b", "reset"),
    Pattern(r"\bfull\s+wipe\b|\bwipe\s+everything\b|\berase\s+all\s+configuration\b", "wipe", "erase"),
)
RESET_PROPOSAL = (
    Pattern(r"\b(?:do|perform|run|start|initiate|trigger)\s+(?:a|the)\s+(?:full\s+)?" + _RESET + r"\b", "reset", "restore"),
    Pattern(r"\b(?:recommend|suggest)\s+(?:a\s+|the\s+)?" + _RESET + r"\b", "reset", "restore"),
    Pattern(r"\b" + _RESET + r"\s+(?:the|your|it|everything|all)\b", "reset", "restore"),
    Pattern(r"\bnext\s+step\s+is\s+(?:a\s+|the\s+)?" + _RESET + r"\b", "reset", "restore"),
    Pattern(r"\bwe(?:'ll|\s+will)\s+(?:need\s+to\s+)?" + _RESET + r"\b", "reset", "restore"),
    Pattern(r"\breset\s+to\s+factory(?:\s+(?:defaults?|settings))?\b", "reset"),
    Pattern(r"\bpinhole\s+reset\b", "pinhole"),
    Pattern(r"\bhold(?:ing)?\s+(?:the\s+)?reset(?:\s+button)?\s+for\s+(?:at\s+least\s+)?1[0-9]\b", "reset"),
    Pattern(r"\berase\s+all\s+(?:local\s+)?configuration\b", "erase"),
    Pattern(r"\bfull\s+wipe\b", "wipe"),
)
RESET_INSISTENCE = (
    r"\b(?:anyway|regardless|i\s+insist|i\s+understand\s+the\s+risks?|just\s+(?:do\s+(?:it|the\s+reset)|reset\s+it)|still\s+want\s+(?:to\s+|the\s+)?(?:factory[-\s]+)?reset|"
    r"already\s+(?:tried|done|completed|followed)\b[^.?!]{0,60}?\b(?:steps?|guide|troubleshooting|everything|path)|tried\s+everything|nothing\s+(?:else\s+)?(?:worked|works|helped|helps))\b",
)

ENVELOPE = "struct<response:string,citations:array<struct<source_id:string,locator:string>>,action:string>"
SAFETY, RESET_GUIDE, PRO_GUIDE = "warranty-safety-policy", "reset-recovery-guide", "pro-quick-start-guide"
ERASE, RESTART = "Factory reset — erases configuration", "Restart — no configuration loss"
#: What the policies quote: name -> (document, section, what the sentence contains, default).
QUOTES = {
    "unsafe": (SAFETY, "Safety", "disconnect power", "Disconnect power and stop troubleshooting."),
    "provide": (SAFETY, "When to escalate", "provide the model", "Provide the model, firmware version, error state and the steps already tried."),
    "no_opening": (SAFETY, "Safety", "must not open", "Customers must not open the hardware."),
    "no_parts": (SAFETY, "Safety", "customer-serviceable", "There are no customer-serviceable parts inside."),
    "no_rollback": (RESET_GUIDE, "Recovery and escalation", "no customer-supported", "There is no customer-supported firmware rollback."),
    "coverage": (SAFETY, "Limited warranty", "do not establish coverage", "Chats do not establish coverage."),
    "eligibility": (SAFETY, "Limited warranty", "support determines eligibility", "Support determines eligibility."),
    "never": (SAFETY, "When to escalate", "never request", "Never request passwords, keys, payment details, or a full serial number."),
    "share": (SAFETY, "When to escalate", "final four characters", "Share only the final four characters of the serial number."),
    "last_resort": (RESET_GUIDE, ERASE, "last resort", "A factory reset is a last resort after the documented path has failed."),
}


def first_match(text: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """What the first of the patterns that occurs matches first, case-insensitive; null if none occurs."""
    t = F.coalesce(text, F.lit(""))
    return let(F.lower(t), lambda low: F.coalesce(*[F.when(may_match(low, p), F.nullif(F.regexp_extract(t, any_case(p), 0), F.lit(""))) for p in patterns]))


def unless_negated(text: Column, pattern: str) -> Column:
    """The pattern's first match without a negation in the LOOK_BACK characters before it; null if there is none.

    What lies between the matches comes from a split at them, so each match knows the text before it.
    """
    t = F.coalesce(text, F.lit(""))
    hits = F.regexp_extract_all(t, F.lit(f"(?i){pattern}"), F.lit(0))
    steps = F.arrays_zip(F.split(t, f"(?i){pattern}", -1).alias("gap"), hits.alias("hit"))
    start = F.struct(F.lit("").alias("before"), F.lit(None).cast("string").alias("found"))

    def step(acc, x):
        before = F.right(F.concat(acc["before"], F.coalesce(x["gap"], F.lit(""))), F.lit(LOOK_BACK))
        hit = F.when(acc["found"].isNull() & x["hit"].isNotNull() & ~before.rlike(f"(?i){NEGATION}"), x["hit"]).otherwise(acc["found"])
        return F.struct(F.right(F.concat(before, F.coalesce(x["hit"], F.lit(""))), F.lit(LOOK_BACK)).alias("before"), hit.alias("found"))

    return F.when(may_match(F.lower(t), pattern), F.aggregate(steps, start, step)["found"])


def solicitation(text: Column) -> Column:
    """The first request for a secret in an answer; null if there is none."""
    return F.coalesce(*[unless_negated(text, p) for p in SOLICITATION])


def sentence_with(text: Column, needle: str, default: str) -> Column:
    """The first sentence of a text that contains the needle, in any case, or the default."""
    hit = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.lower(s).contains(needle.lower()))
    return F.coalesce(strip(F.get(hit, F.lit(0))), F.lit(default))


def first_sentence(text: Column) -> Column:
    return F.get(F.split(text, r"\. "), F.lit(0))


def first_paragraph(text: Column) -> Column:
    return strip(F.get(F.split(text, "\n\n"), F.lit(0)))


def support_channel(text: Column) -> Column:
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)use\s+the\s+(support\s+channel[^.,;]*)", 1)
    return F.concat(F.lit("Please continue with support via the "), F.coalesce(F.nullif(strip(found), F.lit("")), F.lit("support channel in the app")), F.lit("."))


def read_policy(found: DataFrame | None) -> dict[str, str]:
    """The quoted sentences by name. found: source_id, locator, body of the sections that were looked up, at most one row
    for each section that QUOTES and the texts below name; only these few rows come to the driver."""
    texts: dict[tuple[str, str], str] = {}
    if found is not None:
        named = {(d, s) for d, s, *_ in QUOTES.values()} | {(SAFETY, "Escalation message"), (RESET_GUIDE, ERASE), (RESET_GUIDE, RESTART), (PRO_GUIDE, "Factory reset")}
        wanted = found.sparkSession.createDataFrame(sorted(named), "source_id string, locator string")
        texts = {(r.source_id, r.locator): r.body for r in found.join(F.broadcast(wanted), ["source_id", "locator"], "left_semi").collect()}
    spark = found.sparkSession if found is not None else None
    out = {k: default for k, (_, _, _, default) in QUOTES.items()}
    out |= {"direction": "Please continue with support via the support channel in the app.", "erases": "A factory reset erases the network name, passwords and all other configuration.", "restart": "Disconnect power, wait 10 seconds, and reconnect it.", "hold": "Hold reset for at least 15 seconds, then release.", "hold_pro": "Hold the recessed reset pin for 10 seconds, then release."}
    if texts:
        own = lambda d, s: F.lit(texts.get((d, s)))
        cols = [sentence_with(own(d, s), needle, default).alias(k) for k, (d, s, needle, default) in QUOTES.items()]
        cols += [support_channel(own(SAFETY, "Escalation message")).alias("direction"), F.coalesce(first_paragraph(own(RESET_GUIDE, ERASE)), F.lit(out["erases"])).alias("erases"), F.coalesce(first_paragraph(own(RESET_GUIDE, RESTART)), F.lit(out["restart"])).alias("restart")]
        after = F.filter(F.split(own(RESET_GUIDE, ERASE), "\n\n"), lambda p: F.lower(p).contains("only after confirmation"))
        cols += [F.coalesce(F.get(after, F.lit(0)), F.lit(out["hold"])).alias("hold"), F.coalesce(own(PRO_GUIDE, "Factory reset"), F.lit(out["hold_pro"])).alias("hold_pro")]
        out |= spark.range(1).select(*cols).first().asDict()
    return out


def envelope(response: Column, citations: list[tuple[str, str]], action: str) -> Column:
    cites = [F.struct(F.lit(s).alias("source_id"), F.lit(x).alias("locator")) for s, x in citations]
    return F.struct(response.alias("response"), (F.array(*cites) if cites else F.array().cast("array<struct<source_id:string,locator:string>>")).alias("citations"), F.lit(action).alias("action"))


def hazard(message: Column, response: Column) -> Column:
    """struct(kind, term) of the first rung that applies: damage and warranty are read in the message, danger in the
    response before the message, firmware in the message before the response; null if none applies."""
    rungs = [
        ("damage", first_match(message, guards.DAMAGE)), ("danger", F.coalesce(first_match(response, DANGER), first_match(message, DANGER))),
        ("firmware", F.coalesce(first_match(message, guards.FIRMWARE), first_match(response, guards.FIRMWARE))), ("warranty", first_match(message, guards.WARRANTY)),
    ]
    return F.coalesce(*[let(term, lambda t: F.when(t.isNotNull(), F.struct(F.lit(kind).alias("kind"), t.alias("term")))) for kind, term in rungs])  # noqa: B023


def hazard_envelope(found: Column, quotes: dict[str, str]) -> Column:
    """The escalation that answers a hazard (struct(kind, term)); null without one."""
    q = {k: F.lit(v) for k, v in quotes.items()}
    say = lambda *parts: F.concat_ws(" ", *parts)
    escalate = lambda text, *cites: envelope(text, list(cites) + [(SAFETY, "Escalation message")], "escalate")
    first = lambda f: F.concat(F.lit("You reported a possible safety condition ("), f["term"], F.lit(")."))
    return let(
        found,
        lambda f: F.when(f["kind"] == "damage", escalate(say(first(f), q["unsafe"], q["direction"], q["provide"]), (SAFETY, "Safety")))
        .when(f["kind"] == "danger", escalate(say(F.lit("I can't help with opening or repairing hardware."), q["no_opening"], q["no_parts"], q["direction"]), (SAFETY, "Safety")))
        .when(f["kind"] == "firmware", escalate(say(q["no_rollback"], q["direction"]), (RESET_GUIDE, "Recovery and escalation")))
        .when(f["kind"] == "warranty", escalate(say(q["coverage"], q["eligibility"], q["direction"]), (SAFETY, "Limited warranty"))),
    )


WARNING = "Warning: A factory reset will permanently erase all configuration."


def reset_kind(message: Column, response: Column, confirmed: Column, n_steps: Column) -> Column:
    """pass, path (point to the documented path first) or warning. n_steps: documented steps tried so far; null: unknown."""
    asked = any_match(message, RESET_REQUEST) | any_match(response, RESET_PROPOSAL)
    insists = any_match(message, RESET_INSISTENCE)
    none_yet = F.coalesce(n_steps == 0, F.lit(False))
    return F.when(F.coalesce(confirmed, F.lit(False)) | ~asked, "pass").when(none_yet & ~insists, "path").otherwise("warning")


def reset_envelope(kind: Column, quotes: dict[str, str]) -> Column:
    q = {k: F.lit(v) for k, v in quotes.items()}
    say = lambda *parts: F.concat_ws(" ", *parts)
    path = say(q["last_resort"], F.lit("Before erasing your configuration, let's try the least destructive documented step first."), q["restart"], F.lit("If it has already failed and you still want a factory reset, tell me and I will walk you through the warning and confirmation."))
    warning = say(F.lit(WARNING), q["erases"], F.lit("Please confirm that you are able to recreate the network. Would you like to proceed with the factory reset? (Please reply Yes or No)"))
    return let(kind, lambda k: F.when(k == "path", envelope(path, [(RESET_GUIDE, ERASE), (RESET_GUIDE, RESTART)], "ask")).when(k == "warning", envelope(warning, [(RESET_GUIDE, ERASE)], "ask")))


def without_solicitation(answer: Column, quotes: dict[str, str]) -> Column:
    """An envelope, replaced if its response requests a secret."""
    text = F.concat_ws(" ", F.lit("I don't require any credentials to continue. Our policy:"), F.lit(quotes["never"]), F.lit(quotes["share"]), F.lit("Could you describe what the device is doing right now?"))
    return let(answer, lambda a: F.when(solicitation(a["response"]).isNotNull(), envelope(text, [(SAFETY, "When to escalate")], "ask")).otherwise(a))


def guarded(message: Column, answer: Column, confirmed: Column, n_steps: Column, quotes: dict[str, str]) -> Column:
    """The answer after the output guards, in their order: hazard, else reset and then solicitation."""
    kind = reset_kind(message, answer["response"], confirmed, n_steps)
    safe = without_solicitation(F.coalesce(reset_envelope(kind, quotes), answer), quotes)
    return F.coalesce(hazard_envelope(hazard(message, answer["response"]), quotes), safe)


def escalation(section: Column) -> Column:
    """The escalation envelope, with the reason and the sentence on what to provide from the policy's section."""
    lines = F.transform(F.split(F.coalesce(section, F.lit("")), r"\R"), lambda x: strip(F.regexp_replace(strip(x), r"^-+", "")))
    named = F.get(F.filter(lines, lambda x: F.lower(x).contains("documented troubleshooting path")), F.lit(0))
    reason = F.coalesce(strip(F.regexp_replace(F.regexp_replace(named, r"; or$", ""), r"[;.]+$", "")), F.lit("the applicable documented troubleshooting path has been completed without resolution"))
    asks = F.get(F.filter(F.transform(F.split(F.coalesce(section, F.lit("")), "\n\n"), strip), lambda p: F.lower(p).startswith("provide")), F.lit(0))
    provide = F.coalesce(F.concat(F.lit(" "), F.regexp_replace(first_sentence(asks), r"\.+$", ""), F.lit(".")), F.lit(""))
    return envelope(F.concat(F.lit("Escalating to support: "), reason, F.lit(". Please continue via the support channel in the app."), provide), [(SAFETY, "When to escalate")], "escalate")
