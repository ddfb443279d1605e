"""Text columns: summaries, tokens, subject keys, classification, canonical identifiers, session cues."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plain_letters() -> tuple[str, str]:
    """Letters that are one letter with marks, and those letters; then the marks, which have no counterpart and so go."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x2000), *range(0x2C60, 0x3100), *range(0xA640, 0xA800), *range(0xFB1D, 0xFB50)):
        letter = chr(code)
        base = [c for c in unicodedata.normalize("NFD", letter.lower()) if not unicodedata.combining(c)]
        if letter == letter.lower() and len(base) == 1 and base[0] != letter:
            marked.append(letter)
            plain.append(base[0])
    marks = [chr(c) for c in range(0x300, 0x3100) if unicodedata.combining(chr(c))]
    return "".join(marked + marks), "".join(plain)


#: The one normal form of documents and queries.
MARKED, PLAIN = _plain_letters()
_PLAIN = str.maketrans(dict(zip(MARKED, PLAIN, strict=False)) | dict.fromkeys(MARKED[len(PLAIN) :]))
#: Question and function words that are no subjects.
STOP = (
    "what", "when", "where", "which", "who", "whom", "whose", "why", "how", "did", "do", "does",
    "is", "are", "was", "were", "has", "have", "had", "the", "a", "an", "in", "on", "at", "of", "to",
    "for", "and", "or", "but", "if", "as", "by", "with", "from", "this", "that", "these", "those", "i",
)
#: Personal-data patterns and confidentiality hints of the classifier.
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE = r"\b(?:\+?\d{1,3}[ \-]?)?(?:\(\d{3}\)|\d{3})[ \-]?\d{3}[ \-]?\d{4}\b"
CONFIDENTIAL = r"(?i)\b(?:confidential|nda|customer:|internal\s*use\s*only|do\s*not\s*share)\b"
#: Cues of the heuristic session distiller, in order of precedence.
DROP = ("hello", "hi ", "hey", "thanks", "thank you", "weather", "how are you", "good morning")
CUES = {
    "decision": ("decid", "we'll", "we will", "let's", "let us", "go with", "choose", "chosen", "plan:", "decision:"),
    "outcome": ("confirmed", "shipped", "done", "completed", "resolved", "fixed", "merged", "passed"),
    "goal": ("goal", "want to", "need to", "aim to", "planning to", "objective", "trying to"),
}
#: Phrases by which an answer abstains.
ABSTAIN = ("don't know", "dont know", "not enough", "no information")
#: Words that do not count as content of a gold answer.
GOLD_STOP = (
    "the", "a", "an", "is", "was", "were", "of", "to", "in", "on", "at", "for", "and", "with",
    "from", "this", "that", "what", "did", "do", "does", "how", "when", "where", "who", "why", "her", "his",
)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("…")))


def summary(text: Column, skill: Column) -> Column:
    """Short text of an event; a skill shows its name."""
    return truncated(F.when(skill.isNotNull(), F.concat(F.lit("Skill: "), skill)).otherwise(text), 200)


def normalized(text: Column) -> Column:
    """Lower-cased, trimmed of blanks: the key of duplicates and objects."""
    return F.lower(F.trim(text))


def subject_key(subject: Column) -> Column:
    """Trimmed, lower-cased, without possessives, single blanks."""
    plain = F.regexp_replace(F.lower(F.trim(subject)), "['’]s\\b", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def subjects(text: Column) -> Column:
    """Distinct subject keys of the capitalised words of a question, in order."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-zA-Z]+\b"), F.lit(0)), lambda w: ~F.lower(w).isin(*STOP))
    return F.array_distinct(F.filter(F.transform(words, subject_key), lambda k: k != ""))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits without marks, in the normal form of queries."""
    plain = F.translate(F.lower(text), MARKED, PLAIN)
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def query_terms(text: str) -> list[str]:
    """R2: the terms of a query, in the normal form of documents; a repeated word counts twice, as written."""
    return [w for w in re.split(r"[\W_]+", text.lower().translate(_PLAIN)) if w]


def question_subjects(text: str) -> list[str]:
    """R12 of one question, on the driver."""
    words = [w for w in re.findall(r"\b[A-Z][a-zA-Z]+\b", text) if w.lower() not in STOP]
    return list(dict.fromkeys(" ".join(w.lower().split()) for w in words))


def classify(text: Column, redacted: Column, category: Column) -> Column:
    """3 secret, 0 public, 4 personal, 2 confidential, 1 internal."""
    personal = any_of([text.rlike(p) for p in (EMAIL, SSN, PHONE)])
    return (
        F.when(redacted, F.lit(3)).when(F.coalesce(text, F.lit("")) == "", F.lit(0)).when(personal, F.lit(4)).when(text.rlike(CONFIDENTIAL), F.lit(2)).when(category == 0, F.lit(0)).otherwise(F.lit(1))
    )


def default_visibility(classification: Column) -> Column:
    """R22."""
    return F.when(classification.isin(2, 3, 4), F.lit(0)).otherwise(F.lit(1))


def canonical_email(raw: Column) -> Column:
    """Empty if it is no address; dots in local parts of one provider do not count."""
    text = F.lower(F.trim(raw))
    at = F.instr(text, "@")
    local, host = F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.length(text))
    google = host.isin("gmail.com", "googlemail.com")
    out = F.concat(F.when(google, F.replace(local, F.lit("."), F.lit(""))).otherwise(local), F.lit("@"), F.when(google, F.lit("gmail.com")).otherwise(host))
    return F.when((at > 1) & (at < F.length(text)), out).otherwise(F.lit(""))


def canonical_url(raw: Column) -> Column:
    """Lower-cased scheme and host, default ports of web schemes dropped, no final slash, query kept."""
    text = F.trim(raw)
    part = lambda i: F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/:?#]+)(?::(\d+))?([^?#]*)(\?[^#]*)?", i)
    scheme, port = F.lower(part(1)), part(3)
    standard = ((scheme == "http") & port.isin("", "80")) | ((scheme == "https") & port.isin("", "443"))
    path = F.regexp_replace(part(4), "/+$", "")
    out = F.concat(scheme, F.lit("://"), F.lower(part(2)), F.when(standard | (port == ""), F.lit("")).otherwise(F.concat(F.lit(":"), port)), F.when(path == "", F.lit("/")).otherwise(path), part(5))
    return F.when(scheme == "", F.lit("")).otherwise(out)


def canonical_entity(kind: Column, raw: Column) -> Column:
    """R13 by kind: email, login, opaque ids, url; names and others never merge."""
    out = F.when(kind == "email", canonical_email(raw)).when(kind == "login", F.lower(F.trim(raw))).when(kind == "url", canonical_url(raw))
    return F.coalesce(out.when(kind.isin("linear", "slack", "stripe"), F.trim(raw)).otherwise(F.lit("")), F.lit(""))


def entity_id(workstream: Column, kind_code: Column, key: Column, namespace: str = "eventloom:entity") -> Column:
    """Name-based id of a canonical key: SHA-1, version and variant bits, first three fields little-endian, hexadecimal.

    ``namespace`` is the leading name; stores that share ids must use the same one.
    """
    h = F.sha1(F.concat_ws(":", F.lit(namespace), workstream, kind_code.cast("string"), key))
    byte = lambda i: F.substring(h, 2 * i + 1, 2)
    version = F.concat(F.lit("5"), F.substring(h, 14, 1))
    variant = F.lower(F.lpad(F.hex(F.conv(byte(8), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80)).cast("long")), 2, "0"))
    order = [byte(3), byte(2), byte(1), byte(0), byte(5), byte(4), byte(7), version, variant, *(byte(i) for i in range(9, 16))]
    return F.concat(F.lit("ent-"), *order)


def popularity(n: Column) -> Column:
    """R10."""
    return 1 / (1 + 0.001 * (n - 1) * (n - 1))


def token_estimate(text: Column) -> Column:
    """R23."""
    return F.floor((F.length(text) + 3) / 4).cast("int")


def keyword(text: Column) -> Column:
    """The first three words, joined by hyphens, lower-cased."""
    return F.lower(F.array_join(F.slice(F.filter(F.split(text, "[ \t\n\r]+"), lambda w: w != ""), 1, 3), "-"))


def cue(text: Column) -> Column:
    """Dropped, decision, outcome, goal or fact; null for blank entries."""
    clean = F.trim(text, F.lit(" \t\n\r"))
    low = F.lower(clean)
    out = F.when(clean == "", F.lit(None)).when((F.length(clean) < 15) | any_of([F.startswith(low, F.lit(d)) for d in DROP]), F.lit("dropped"))
    for name, cues in CUES.items():
        out = out.when(any_of([F.contains(low, F.lit(c)) for c in cues]), F.lit(name))
    return out.otherwise(F.lit("fact"))


def abstains(answer: Column) -> Column:
    """Blank, an error, or a phrase that abstains."""
    low = F.lower(answer)
    return (F.trim(low) == "") | F.startswith(low, F.lit("[error]")) | any_of([F.contains(low, F.lit(a)) for a in ABSTAIN])


def answer_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[ \t\n\r.,!?;:\"']+"), lambda w: w != ""))


def token_f1(answer: Column, gold: Column) -> Column:
    """F1 of distinct tokens; 1 if both are empty or the answer contains the gold text, 0 if one is empty."""
    a, g = answer_tokens(answer), answer_tokens(gold)
    f1 = 2.0 * F.size(F.array_intersect(a, g)) / (F.size(a) + F.size(g))
    empty = F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.size(g) == 0, empty).when(F.size(a) == 0, F.lit(0.0)).when(F.contains(F.lower(answer), F.lower(gold)), F.lit(1.0)).otherwise(f1)


def gold_support(context: Column, gold: Column) -> Column:
    """Whether at least 0.6 of the content tokens of the gold text occur in the context."""
    tokens = F.filter(F.split(F.lower(gold), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*GOLD_STOP))
    hits = F.size(F.filter(tokens, lambda w: F.contains(F.lower(context), w)))
    return (F.size(tokens) > 0) & (hits / F.greatest(F.size(tokens), F.lit(1)) >= 0.6)


def model_label(answer: Column, fallback: Column) -> Column:
    """The class that a model's answer begins with, in any case; anything else takes the rules' class."""
    said = F.upper(F.trim(answer, F.lit(" \t\r\n")))
    out = F.when(F.startswith(said, F.lit("PUBLIC")), F.lit(0)).when(F.startswith(said, F.lit("INTERNAL")), F.lit(1)).when(F.startswith(said, F.lit("CONFIDENTIAL")), F.lit(2))
    out = out.when(F.startswith(said, F.lit("SECRET")), F.lit(3)).when(F.startswith(said, F.lit("PII")), F.lit(4))
    return F.coalesce(out, fallback)


def content_id(prefix: str, *parts: Column) -> Column:
    """An id that the same content always gets, so that a job that runs again makes no second row."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32))


#: The alphabet of time-ordered ids.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def time_id(at: Column, *parts: Column) -> Column:
    """26 characters that sort by time: 48 bits of milliseconds, then 80 bits from the content instead of a random draw."""
    millis = F.unix_millis(at.cast("timestamp"))
    head = [F.substring(F.lit(CROCKFORD), (F.shiftright(millis, 5 * (9 - i)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(10)]
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    tail = [F.substring(F.lit(CROCKFORD), (F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") % 32 + 1), F.lit(1)) for i in range(16)]
    return F.concat(*head, *tail)


def answer_text(value: Column) -> Column:
    """An answer (variant) as text, by its JSON type: strings as they are, booleans as yes and no, numbers in their shortest form, the rest as JSON; null where there is none."""
    kind = F.schema_of_variant(value)
    said = F.when(kind == "STRING", value.cast("string")).when(kind == "BOOLEAN", F.when(value.cast("boolean"), "yes").otherwise("no")).when(kind == "VOID", F.lit("null"))
    return F.when(value.isNotNull(), said.otherwise(F.to_json(value)))
