"""Screening of free text: control characters, injected instructions, personal data, redaction and delimiters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control characters that are written out as escapes.
CONTROLS = [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x2028, 0x2029]
#: Patterns of instructions to a model hidden in a text, case-insensitive, with their tags; the first that matches gives the tag.
INJECTIONS = (
    (
        "instruction_override",
        r"(?:ignore|disregard|forget)\s+(?:all\s+|any\s+|your\s+|their\s+)?(?:previous\s+|prior\s+|above\s+|earlier\s+|existing\s+|other\s+|all\s+|hidden\s+)*"
        r"(?:instructions?|rules?|constraints?|directives?|guardrails?|safety)",
    ),
    ("instruction_override", r"new\s+(?:instructions?|directive|directives?|rules?)\s*:"),
    ("identity_override", r"(?:you\s+are\s+now|from\s+now\s+on)[^.;]{0,40}(?:unrestricted|unfiltered|free|jailbroken)"),
    ("fake_role_marker", r"\[\s*(?:system|assistant|developer)\s*\]"),
    ("fake_role_marker", r"<<\s*/?\s*sys\s*>>"),
    ("fake_role_marker", r"<\|\s*(?:im_start|system|endoftext)\s*\|>"),
    ("fake_role_marker", r"\bassistant\s*:"),
    ("delimiter_escape", r"</?\s*untrusted_data\s*>"),
    ("delimiter_escape", r"\]\]\s*>"),
    ("outcome_manipulation", r"(?:mark|classify|rate|flag|approve|accept)\s+(?:this|the)\s+(?:entry|transaction|item)[^.;]{0,50}?\b(?:low|no|none|minimal)\s+concern"),
    ("outcome_manipulation", r"(?:rate|classify)\s+[^.;]{0,30}\bas\b\s+(?:low concern|not suspicious|safe)"),
    ("outcome_manipulation", r"auto-?approve|approve\s+silently|silently\s+approve"),
    ("outcome_manipulation", r"skip\s+(?:the\s+)?(?:reviewer|review|approval)\s+queue"),
    ("outcome_manipulation", r"(?:must\s+be\s+approved|must\s+approve\s+(?:every|all)|approve\s+(?:every|all)\s+(?:journal\s+)?entr)"),
    ("outcome_manipulation", r"(?:confirm|verified|verified by)[^.;]{0,30}\bit\s+is\s+(?:low concern|not suspicious|safe)"),
    ("fake_role_marker", r"granted\s+by\s+(?:model|system|admin)"),
    ("exfiltration", r"(?:reveal|print|repeat|show|display|echo)\s+[^.;]{0,40}(?:system\s+prompt|instructions?|hidden\s+configuration)"),
    ("exfiltration", r"(?:export|send|transmit|exfiltrate|leak)\s+[^.;]{0,60}(?:configuration|instructions?|system\s+prompt|credentials|api[- ]?keys?)"),
    ("context_probe", r"(?:developer|administrator|admin)\s+(?:directive|override|message)\s*:"),
)
#: Patterns of personal data with their masks, in order; card numbers are masked only if their check digit is right.
PII = (
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    ("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", "[IBAN]"),
    ("payment_card", r"\b(?:\d[ -]?){13,19}\b", "[PAYMENT_CARD]"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL]"),
    ("phone", r"(?<!\w)(?:\+\d{1,3}[-. ]?)?(?:\(\d{2,4}\)[- ]?)?\d{3}[-. ]\d{3,4}(?:[-. ]\d{2,4})?(?!\w)", "[PHONE]"),
)
KINDS = tuple(kind for kind, _, _ in PII)
_PATTERN, _MASK = {kind: pattern for kind, pattern, _ in PII}, {kind: mask for kind, _, mask in PII}
TAG = r"(?i)<(/?\s*untrusted_data\s*)>"


def escape_controls(c: Column) -> Column:
    for code in CONTROLS:
        c = F.replace(c, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return c


def control_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{2028}\x{2029}]"))


def injection_tag(c: Column) -> Column:
    return F.coalesce(*[F.when(c.rlike("(?i)" + p), F.lit(tag)) for tag, p in INJECTIONS])


def injection_excerpt(c: Column, width: int = 60) -> Column:
    return F.left(F.coalesce(*[F.nullif(F.regexp_extract(c, "(?i)" + p, 0), F.lit("")) for _, p in INJECTIONS]), F.lit(width))


def luhn(c: Column) -> Column:
    """Whether the digits of a text pass the Luhn check (12 digits at least)."""
    digits = F.split(F.reverse(F.regexp_replace(c, "[^0-9]", "")), "")
    digits = F.filter(digits, lambda d: d != "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return (F.size(digits) >= 12) & (F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0)


def replace_each(c: Column, pattern: str, change) -> Column:
    """Replace every match of a pattern by ``change(match)``."""
    between, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.concat(b, change(m))), ""), F.element_at(between, -1))


def mask(c: Column, kinds: Sequence[str] = KINDS) -> Column:
    """Personal data of the given kinds masked, one kind after the other in the given order."""
    for kind in kinds:
        if kind == "payment_card":
            c = replace_each(c, _PATTERN[kind], lambda m: F.when(luhn(m), F.lit(_MASK["payment_card"])).otherwise(m))
        else:
            c = F.regexp_replace(c, _PATTERN[kind], F.lit(_MASK[kind]))
    return c


def pii_count(c: Column, kind: str) -> Column:
    """How many of a kind mask() would replace in c."""
    if kind == "payment_card":
        return F.size(F.filter(F.regexp_extract_all(c, F.lit(_PATTERN[kind]), F.lit(0)), luhn))
    return F.regexp_count(c, F.lit(_PATTERN[kind]))


def redact(c: Column, terms: Sequence[str]) -> Column:
    for i, t in enumerate(terms, 1):
        c = F.replace(c, F.lit(t), F.lit(f"[REDACTED_TERM_{i}]"))
    return c


def term_count(c: Column, term: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")


def neutralise(c: Column) -> Column:
    return F.regexp_replace(c, TAG, r"\\u003c$1\\u003e")


def wrap(c: Column) -> Column:
    return F.concat(F.lit("<untrusted_data>"), neutralise(c), F.lit("</untrusted_data>"))


def steps(docs: DataFrame, text: str, terms: Sequence[str], kinds: Sequence[str] = KINDS) -> tuple[DataFrame, list[str]]:
    """docs with the text after each step of sanitising in columns of its own, and their names: raw, escaped, one for each kind masked, one for each term redacted."""
    names = ["_s0", "_s1"]
    out = docs.withColumn("_s0", F.col(text)).withColumn("_s1", escape_controls(F.col(text)))
    for kind in kinds:
        out = out.withColumn(f"_s{len(names)}", mask(F.col(names[-1]), (kind,)))
        names.append(f"_s{len(names)}")
    for i, term in enumerate(terms, 1):
        out = out.withColumn(f"_s{len(names)}", F.replace(F.col(names[-1]), F.lit(term), F.lit(f"[REDACTED_TERM_{i}]")))
        names.append(f"_s{len(names)}")
    return out, names


def events(docs: DataFrame, key: str, text: str, terms: Sequence[str], kinds: Sequence[str] = KINDS) -> DataFrame:
    """(key, kind, detail, count) of everything that sanitise() does to a text, each step counted on what the steps before it left; null texts have none."""
    out, names = steps(docs, text, terms, kinds)
    tag = injection_tag(F.col(names[1]))
    rows = [("control_chars_escaped", F.lit("control characters"), control_count(F.col(names[0]))), ("injection_suspected", tag, F.when(tag.isNotNull(), 1).otherwise(0))]
    rows += [("pii_scrubbed", F.lit(kind), pii_count(F.col(names[1 + i]), kind)) for i, kind in enumerate(kinds)]
    rows += [("pii_scrubbed", F.lit(f"redaction term {i}"), term_count(F.col(names[len(kinds) + i]), t)) for i, t in enumerate(terms, 1)]
    rows += [("control_chars_escaped", F.lit("delimiter tags"), F.regexp_count(F.col(names[-1]), F.lit(TAG)))]
    made = F.array(*[F.struct(F.lit(k).alias("kind"), d.alias("detail"), n.cast("long").alias("count")) for k, d, n in rows])
    return out.filter(F.col(text).isNotNull()).select(key, F.inline(F.filter(made, lambda x: x["count"] > 0)))


def sanitise(c: Column, terms: Sequence[str], kinds: Sequence[str] = KINDS) -> Column:
    """Escape, mask, redact, wrap, in that order."""
    return wrap(redact(mask(escape_controls(c), kinds), terms))
