"""Typed payloads (F14, F15, R19): eight variants in one superset struct, their summaries, texts and redaction.

The variant is named by ``$type``; an unknown or malformed one has no summary and no text, and ingestion
refuses it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .redaction import redact, redact_all
from .text import truncated

#: Names of the variants and the category of each.
VARIANTS = {"evidence": S.EVIDENCE, "fact": S.FACT, "decision": S.DECISION, "hypothesis": S.HYPOTHESIS, "goal": S.GOAL, "action": S.ACTION, "outcome": S.OUTCOME, "skill": S.EVIDENCE}
#: The text fields that redaction rewrites, by variant; a fact's triples have two more each.
REDACTED = {"evidence": ("content",), "decision": ("statement", "rationale"), "action": ("statement", "externalReference"), "skill": ("name", "procedure", "trigger")}
PLAIN = ("fact", "hypothesis", "goal", "outcome")


def parsed(json: Column) -> Column:
    return F.from_json(json, S.PAYLOAD)


def kind(p: Column) -> Column:
    return p["$type"]


def known(p: Column) -> Column:
    """Whether a payload is of a known variant and has that variant's main text."""
    main = F.when(kind(p) == "evidence", p["content"]).when(kind(p) == "skill", p["name"]).otherwise(p["statement"])
    return F.coalesce(kind(p).isin(*VARIANTS) & main.isNotNull(), F.lit(False))


def _by_variant(p: Column, evidence: Column, decision: Column, action: Column, skill: Column) -> Column:
    t = kind(p)
    return F.when(t == "evidence", evidence).when(t == "decision", decision).when(t == "action", action).when(t == "skill", skill).when(t.isin(*PLAIN), p["statement"])


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def summary(p: Column) -> Column:
    """at most 200 characters; a skill shows its name."""
    return truncated(_by_variant(p, p["content"], p["statement"], p["statement"], F.concat(F.lit("Skill: "), p["name"])), 200)


def classifier_text(p: Column) -> Column:
    """parts on lines of their own."""
    skill = F.concat(p["name"], F.lit("\n"), _or_empty(p["procedure"]), F.when(p["trigger"].isNull(), F.lit("")).otherwise(F.concat(F.lit("\n"), p["trigger"])))
    return _or_empty(_by_variant(p, p["content"], F.concat(p["statement"], F.lit("\n"), _or_empty(p["rationale"])), p["statement"], skill))


def index_text(p: Column) -> Column:
    """what the full-text index holds."""
    glue = lambda *parts: F.concat(parts[0], *(F.concat(F.lit(" "), _or_empty(x)) for x in parts[1:]))
    return _or_empty(_by_variant(p, p["content"], glue(p["statement"], p["rationale"]), glue(p["statement"], p["externalReference"]), glue(p["name"], p["procedure"], p["trigger"])))


def embed_text(p: Column) -> Column:
    """the statement, else the content; skills have neither."""
    return F.coalesce(p["statement"], p["content"], F.lit(""))


def bundle_text(p: Column) -> Column:
    """statement and rationale, or a skill's name and procedure."""
    dash = lambda a, b: F.concat(a, F.when(_or_empty(b) == "", F.lit("")).otherwise(F.concat(F.lit(" — "), b)))
    return _or_empty(_by_variant(p, p["content"], dash(p["statement"], p["rationale"]), p["statement"], dash(p["name"], p["procedure"])))


def redacted(p: Column) -> Column:
    """(payload, hits) with the variant's text fields redacted; all other fields stay.

    The fields' calls share one pass to Python.
    """
    t = kind(p)
    fields = ("content", "statement", "rationale", "externalReference", "name", "procedure", "trigger")
    wanted = {f: t.isin(*[v for v, of in REDACTED.items() if f in of], *(PLAIN if f == "statement" else ())) for f in fields}
    done = {f: redact(F.when(wanted[f], p[f])) for f in fields}
    hits = sum((F.when(wanted[f] & p[f].isNotNull(), done[f]["hits"]).otherwise(F.lit(0)) for f in fields), F.lit(0))
    facts = F.when(t == "fact", p["triples"])
    each = {f: facts.getField(f) for f in ("subject", "predicate", "object")}
    subjects, objects = redact_all(each["subject"]), redact_all(each["object"])
    triples = F.arrays_zip(subjects["texts"], each["predicate"], objects["texts"]).cast("array<struct<subject:string,predicate:string,object:string>>")
    hits = hits + F.when(facts.isNotNull(), subjects["hits"] + objects["hits"]).otherwise(F.lit(0))
    out = p.withField("triples", F.when(facts.isNotNull(), triples).otherwise(p["triples"]))
    for f in fields:
        out = out.withField(f, F.when(wanted[f] & p[f].isNotNull(), done[f]["text"]).otherwise(p[f]))
    return F.struct(out.alias("payload"), hits.alias("hits"))
