"""Review dossiers, identifiers and request messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairsieve import columns as C
from pairsieve.functions.values import indicator_sql, number_sql, quoted, ref
from pairsieve.operators.features import BIRTH_DISTANCE

SCHEMA_VERSION = "dossier.1.0"
# Which columns each group of the dossier shows.
GROUPS = {
    "name": [C.NAME_COUNT, C.NAME_FIRST, C.NAME_LAST, C.NAME_BOTH],
    "mother": [C.MOTHER_COUNT, C.MOTHER_FIRST, C.MOTHER_LAST, C.MOTHER_BOTH],
    "dob": [*C.BIRTH_PARTS, C.BIRTH_EQUAL],
    "address": C.ADDRESS_SCORES,
    "composites": ["nome_score_total", "mae_score_total", "dtnasc_score_total",
                   "endereco_score_total", "municipio_score"],
}
FLAGS = ["mae_missing", "dtnasc_all_zero", "endereco_zero"]


def pair_id(df: DataFrame, keys: tuple[str, ...] = (C.LEFT, C.RIGHT, C.STEP)) -> Column:
    """First 16 hex digits of the SHA-256 of the three keys; a missing key reads ``None``."""
    parts = [F.coalesce(ref(k).cast("string"), F.lit("None")) for k in keys]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def _map_sql(df: DataFrame, names: list[str], value: str) -> str:
    """SQL of a map over the present columns whose value is not NULL."""
    present = [n for n in names if n in df.columns]
    if not present:
        return f"CAST(map() AS MAP<STRING, {value}>)"
    def cell(name: str) -> str:
        if value == "BOOLEAN":
            return f"CASE WHEN {quoted(name)} IS NOT NULL THEN {indicator_sql(df, name)} END"
        return f"round({number_sql(df, name)}, 4)"

    pairs = ", ".join(f"'{n}', {cell(n)}" for n in present)
    return f"map_filter(map({pairs}), (k, v) -> v IS NOT NULL)"


def dossiers(df: DataFrame, with_birth_distance: bool = True, only_review: bool = True) -> DataFrame:
    """One nested record per pair to review: scores by group, flags, model outputs."""
    rows = df.filter("action = 'LLM_REVIEW'") if only_review and "action" in df.columns else df
    maps = {g: _map_sql(rows, names, "DOUBLE") for g, names in GROUPS.items()}
    distance = _map_sql(rows, BIRTH_DISTANCE, "DOUBLE") if with_birth_distance else None

    def text(name: str, default: str | None = None) -> str:
        value = quoted(name) if name in rows.columns else "CAST(NULL AS STRING)"
        return value if default is None else f"coalesce({value}, '{default}')"

    score = f"round(coalesce({number_sql(rows, C.SCORE)}, {number_sql(rows, 'nota_final')}, 0D), 4)"
    parts = [f"{score} AS nota_final"]
    parts += [f"{sql} AS {g}" for g, sql in maps.items() if g != "composites"]
    parts += [
        f"round({number_sql(rows, C.TOWN_EQUAL, 0.0)}, 4) AS municipality",
        f"{maps['composites']} AS composites", f"{_map_sql(rows, FLAGS, 'BOOLEAN')} AS flags",
    ]
    if distance is not None:
        parts.append(f"CASE WHEN size({distance}) > 0 THEN {distance} END AS macd")
    outputs = [
        f"round({number_sql(rows, 'p_cal', 0.5)}, 4) AS p_cal", f"{text('band', 'unknown')} AS band",
        f"{text('base_choice', 'NONMATCH')} AS base_choice",
        f"round({number_sql(rows, 'evr', 0.0)}, 4) AS evr", f"{text('guardrail')} AS guardrail",
        f"{text('guardrail_reason')} AS guardrail_reason",
    ]
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), pair_id(rows).alias("pair_id"),
        F.expr(f"struct({', '.join(parts)})").alias("features"),
        F.expr(f"struct({', '.join(outputs)})").alias("model_outputs"),
    )


def dossier_json(records: DataFrame) -> DataFrame:
    """``pair_id`` and the record as JSON without NULL keys."""
    body = F.struct("schema_version", "pair_id", "features", "model_outputs")
    return records.select(
        "pair_id", F.to_json(body, {"ignoreNullFields": "true"}).alias("dossier")
    )


DEFAULT_SYSTEM = "You review candidate pairs of a record linkage. Answer with one JSON object."
DEFAULT_USER = "Assess the dossier below and return one JSON object of the output schema."
ROLE_TEXT = {
    "Agent-A": "You are Agent-A. Judge directly and weigh the strongest evidence first.",
    "Agent-B": "You are Agent-B. Look for contradictions and missing data; be sceptical but fair.",
    "Arbiter": "You are the arbiter. Two reviewers disagreed. Decide from the dossier and both opinions.",
}
JSON_ONLY = "Output only the JSON object, starting with { and ending with }."


def review_requests(
    records: DataFrame, role: str = "Agent-A", system: str = DEFAULT_SYSTEM,
    user: str = DEFAULT_USER, json_only: bool = False, max_tokens: int = 500,
    temperature: float = 0.0,
) -> DataFrame:
    """One JSON line per pair for one reviewer: ``custom_id`` and chat messages."""
    instruction = "\n\n".join([system, ROLE_TEXT[role]] + ([JSON_ONLY] if json_only else []))
    fence = "```"
    content = F.concat(F.lit(f"{user}\n\n{fence}json\n"), F.col("dossier"), F.lit(f"\n{fence}"))
    return _request(dossier_json(records), f"{role[-1]}_", instruction, content, max_tokens, temperature)


def arbiter_requests(
    records: DataFrame, disagreements: DataFrame, system: str = DEFAULT_SYSTEM,
    user: str = DEFAULT_USER, max_tokens: int = 500, temperature: float = 0.0,
) -> DataFrame:
    """Requests for pairs whose reviewers disagree, with both opinions.

    ``disagreements`` has ``pair_id, opinion_a, opinion_b`` (JSON text).
    """
    fence = "```"

    def block(title: str, column: str) -> Column:
        return F.concat(F.lit(f"### {title}\n{fence}json\n"), F.col(column), F.lit(f"\n{fence}\n\n"))

    rows = dossier_json(records).join(disagreements, "pair_id")
    content = F.concat(F.lit(f"{user}\n\n"), block("Dossier", "dossier"),
                       block("Agent-A", "opinion_a"), block("Agent-B", "opinion_b"))
    return _request(rows, "ARB_", f"{system}\n\n{ROLE_TEXT['Arbiter']}", content, max_tokens, temperature)


def _request(rows: DataFrame, prefix: str, system: str, content: Column, max_tokens: int, temperature: float) -> DataFrame:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    body = F.struct(
        F.array(message("system", F.lit(system)), message("user", content)).alias("messages"),
        F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature"),
    )
    named = F.concat(F.lit(prefix), F.col("pair_id"))
    return rows.select(
        named.alias("custom_id"),
        F.to_json(F.struct(named.alias("custom_id"), body.alias("body"))).alias("value"),
    )


def claim_prompt(abstract: Column, sentence: Column, paragraph: Column, claim: Column) -> Column:
    """Request text asking whether an abstract supports a claim, with the inputs whole."""
    return F.format_string(
        "Does the abstract of the cited work support the claim?\nClaim type: %s\nSentence: %s\n"
        "Paragraph: %s\nAbstract: %s\nAnswer in JSON with verdict, confidence and justification.",
        claim, *[F.coalesce(c, F.lit("")) for c in (sentence, paragraph, abstract)],
    )


def config_label(mode: Column, split: Column, calibration: Column, birth_distance: Column) -> Column:
    """``mode | split=… | cal=… | macd=on`` (``off`` without the birth-distance features)."""
    return F.concat_ws(
        " | ", mode, F.concat(F.lit("split="), split), F.concat(F.lit("cal="), calibration),
        F.when(birth_distance, "macd=on").otherwise("macd=off"),
    )
