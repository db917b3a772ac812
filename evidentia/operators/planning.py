"""What a plan may say: rows of question classes, expected behaviour, constraints, evidence gates of templates, personas, system prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.text import without_sentences

# Question class to row, voice and hedge level; a criticism's voice depends on the persona.
QUESTION_ROWS = {
    "CRITICISM": (11, "Reframe with evidence", "MEASURED"), "OUT_OF_CORPUS": (12, "Honest gap + nearest fact", "GAP"), "COMPARATIVE": (12, "This-record-only comparison", "GAP"), "BANNED": (13, "Polite refusal", "GAP"),
    "PROPRIETARY": (13, "Polite refusal, identity restated", "GAP"), "AUDIENCE_SELF_ID": (14, "Register shift", "MEASURED"), "IDENTITY": (14, "Plain disclosure", "MEASURED"),
}
#: Persona fields and their defaults.
PERSONA = {
    "endorser_attribution": "ROLE_ONLY", "weakness_eagerness": "ONLY_WHEN_ASKED", "weakness_framing": "GROWTH_NARRATIVE", "criticism_response": "REFRAME_WITH_EVIDENCE", "out_of_corpus": "HONEST_GAP_NEAREST_FACT",
    "gaps": "CLAIMS_ONLY_HONEST_GAP", "contact_sharing": "SHARE_ON_REQUEST_VERBATIM", "speculation": "GROUNDED_EXTRAPOLATION",
}
#: A catalogue of templates is configuration: its gates become literals of a plan, up to so many.
MOST_GATES = 1000


def question_row(kind: str = "kind", response: str = "criticism_response") -> Column:
    """struct<row_id, voice, hedge> of a question class; null for an unknown one."""
    out = F.lit(None).cast("struct<row_id:int,voice:string,hedge:string>")
    for name, (row, voice, hedge) in QUESTION_ROWS.items():
        said = F.when(F.col(response).eqNullSafe("ACKNOWLEDGE_AND_REDIRECT"), "Acknowledge and redirect").otherwise(voice) if name == "CRITICISM" else F.lit(voice)
        out = F.when(F.col(kind) == name, F.struct(F.lit(row).alias("row_id"), said.alias("voice"), F.lit(hedge).alias("hedge"))).otherwise(out)
    return out


def expected_behaviour(category: str = "category", row: str = "row_id", hedge: str = "hedge") -> Column:
    """What a held-out conversation is expected to show: identity discloses, criticism reframes, gaps refuse, the rest asserts or hedges."""
    level = F.when(F.col(hedge) == "GAP", "REFUSE").when(F.col(hedge).isin("ASSERTIVE", "MEASURED"), "ASSERT").when(F.col(hedge).isin("HEDGED", "RESERVED"), "HEDGE")
    return F.when(F.col(category).eqNullSafe("META") | F.col(row).eqNullSafe(14), "DISCLOSE").when(F.col(row) == 11, "REFRAME").otherwise(level)


def constraints(row: str = "row_id", kind: str = "kind") -> Column:
    """Codes of what a plan must keep to, in order: the two that all have, then those of its row, persona and question class.

    Needs sidecar, endorser_attribution, weakness_eagerness, weakness_framing, criticism_response and out_of_corpus; a class only for questions.
    """
    r, told = F.col(row), F.col("sidecar").isNotNull()
    when = lambda n, code: F.when(r == n, code)
    lower = lambda c: F.lower(F.col(c))
    volunteer = F.when(~told, "never_volunteer").when(F.col("weakness_eagerness") == "PROACTIVE", "volunteer").when(F.col("weakness_eagerness") == "RELEVANT_CONTEXT", "volunteer_in_context").otherwise("only_when_asked")
    asked = F.when(F.col(kind) == "CRITICISM", F.concat(F.lit("criticism:"), lower("criticism_response"))).when(F.col(kind) == "OUT_OF_CORPUS", F.concat(F.lit("gap:"), lower("out_of_corpus")))
    asked = asked.when(F.col(kind).isNotNull(), F.concat(F.lit("class:"), lower(kind)))
    return F.array_compact(
        F.array(
            F.lit("no_denial"), F.lit("stated_precision"), when(2, F.when(told, "with_explanation").otherwise("with_context")), when(3, F.lit("attribute_to_self")), when(4, F.concat(F.lit("attribute:"), lower("endorser_attribution"))),
            when(5, F.lit("never_voice")), when(6, F.lit("context_mandatory")), when(7, F.lit("candid_when_asked")), when(7, volunteer), when(7, F.concat(F.lit("frame:"), lower("weakness_framing"))), when(8, F.lit("verbatim")), asked,
        )
    )


def drawable(members: str, declared_types: Column) -> Column:
    """A fact's members that a template may use: declared boundaries only if it asks for them. members: array<struct<claim_id,claim_type,declared,declared_type>>."""
    open_ = F.array_contains(declared_types, F.lit("BOUNDARY"))
    return F.filter(members, lambda m: F.coalesce(open_, F.lit(False)) | ~(F.coalesce(m["declared"], F.lit(False)) & m["declared_type"].eqNullSafe("BOUNDARY")))


def passes_gates(members: Column, claim_types: Column, declared_types: Column) -> Column:
    """Some member of every required claim type, and, if declared types are required, some declared member of one of them."""
    coarse = F.forall(claim_types, lambda t: F.exists(members, lambda m: m["claim_type"].eqNullSafe(t)))
    fine = F.exists(members, lambda m: F.coalesce(m["declared"], F.lit(False)) & F.coalesce(F.array_contains(declared_types, m["declared_type"]), F.lit(False)))
    return (F.size(members) > 0) & coarse & ((F.size(declared_types) == 0) | fine)


def template_units(facts: DataFrame, templates: list[dict]) -> DataFrame:
    """(subject_id, template_id, slot, fact_id, claim_ids): for each template its ``target`` slots, filled by the subject's eligible facts in turn.

    facts: subject_id, fact_id, belief, members. templates: template_id, claim_types, declared_types, target; template k starts at fact k.
    A template without an eligible fact has no units. Facts meet the templates as literals, so rows grow with the facts only.
    """
    if len(templates) > MOST_GATES:
        raise ValueError(f"more than {MOST_GATES} templates")
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    gates = [F.struct(F.lit(t["template_id"]).alias("template_id"), F.lit(k).alias("k"), strings(t["claim_types"]).alias("claim_types"), strings(t["declared_types"]).alias("declared_types"), F.lit(int(t["target"])).alias("target")) for k, t in enumerate(templates)]
    rows = facts.withColumn("g", F.explode(F.array(*gates))).select("subject_id", "fact_id", "belief", "g.*", "members")
    rows = rows.withColumn("members", drawable("members", F.col("declared_types"))).where(passes_gates(F.col("members"), F.col("claim_types"), F.col("declared_types")))
    own = Window.partitionBy("subject_id", "template_id")
    rows = rows.withColumns({"i": F.row_number().over(own.orderBy(F.coalesce("belief", F.lit(0.0)).desc(), "fact_id")) - 1, "n": F.count("*").over(own)})
    slots = F.filter(F.sequence(F.lit(0), F.col("target") - 1), lambda s: F.pmod(s + F.col("k"), F.col("n")) == F.col("i"))
    rows = rows.where("target > 0").withColumn("slot", F.explode(slots))
    return rows.select("subject_id", "template_id", F.col("slot").cast("long").alias("slot"), "fact_id", F.transform("members", lambda m: m["claim_id"]).alias("claim_ids"))


def resolved_persona(stored: DataFrame, subjects: DataFrame, name: str, preset: str, fields: dict[str, str] | None = None) -> DataFrame:
    """Every subject's persona: stored fields, defaults where they are null, and for name and preset also where they are blank."""
    own = lambda c, d: F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit(d)).alias(c)
    rows = subjects.select("subject_id").join(stored, "subject_id", "left")
    return rows.select("subject_id", own("advocate_name", name), own("preset_id", preset), *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (fields or PERSONA).items()], F.coalesce(F.trim("custom_text"), F.lit("")).alias("custom_text"))


def overridden_mix(overrides: DataFrame, base: dict[str, float]) -> DataFrame:
    """(run_id, category, weight): each run's own weight of a category where it gives one, else the base weight."""
    cells = [F.struct(F.lit(c).alias("category"), F.lit(float(w)).alias("base")) for c, w in base.items()]
    rows = overrides.select("run_id").distinct().withColumn("b", F.explode(F.array(*cells))).select("run_id", "b.*")
    return rows.join(overrides.select("run_id", "category", "weight"), ["run_id", "category"], "left").select("run_id", "category", F.coalesce("weight", "base").alias("weight"))


def resolved_header(header: str, values: dict[str, Column]) -> Column:
    """A header with its placeholders filled; a blank value drops the sentences that hold its placeholder."""
    out = F.col(header)
    for name, value in values.items():
        token = "{{" + name + "}}"
        out = F.when(F.coalesce(F.trim(value), F.lit("")) != "", F.replace(out, F.lit(token), value)).otherwise(without_sentences(out, token))
    return F.trim(out)


def system_prompt(header: Column, rules: Column, facts: Column, standing: Column, rules_label: str = "RULES", facts_label: str = "FACTS") -> Column:
    """Header, rules and a list of fact lines under fixed labels, then standing rules; blank parts are left out, no facts say so."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    lines = F.when(F.coalesce(F.size(facts), F.lit(0)) <= 0, "- none on record").otherwise(F.array_join(F.transform(facts, lambda x: F.concat(F.lit("- "), x)), "\n"))
    ruled = F.when(text(rules) != "", F.concat(F.lit(f"\n{rules_label}\n"), text(rules), F.lit("\n"))).otherwise("")
    last = F.when(text(standing) != "", F.concat(F.lit("\n"), standing)).otherwise("")
    return F.trim(F.concat(text(header), F.lit("\n"), ruled, F.lit(f"\n{facts_label}\n"), lines, last))


def evidence_line(claim_id: Column, text: Column, score: Column, tier: Column, sidecar: Column, valid_from: Column, valid_to: Column, precision: Column) -> Column:
    """One line of evidence: id, text, score, and what is known of tier, explanation and dates."""
    part = lambda ok, *xs: F.when(ok, F.concat(*xs)).otherwise("")
    dates = F.array_distinct(F.array_compact(F.array(valid_from, valid_to)))
    return F.concat(
        F.lit("["), claim_id, F.lit('] "'), text, F.lit('" — score '), F.format_string("%.2f", score), part(tier.isNotNull(), F.lit(" ("), tier, F.lit(")")), part(sidecar.isNotNull(), F.lit('; explanation on record: "'), sidecar, F.lit('"')),
        part(F.size(dates) > 0, F.lit("; dated "), F.array_join(dates, " → "), part(precision.isNotNull(), F.lit(" ("), precision, F.lit(" precision — never voice finer)"))),
    )
