"""Review answers: extraction, validation, consensus, attempts and quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pairsieve.functions.intervals import wilson_of_rate
from pairsieve.functions.rates import ratio
from pairsieve.functions.values import ref
from pairsieve.operators.histograms import exact_quantiles

# Decisions and reason codes a reviewer may give.
DECISIONS = ["MATCH", "NONMATCH", "UNSURE"]
REASON_CODES = [
    "HIGH_SCORE_ANCHOR", "LOW_SCORE_ANCHOR", "NAME_STRONG", "NAME_WEAK", "DOB_STRONG", "DOB_WEAK",
    "MOTHER_STRONG", "MOTHER_MISSING", "ADDRESS_WEAK", "MUNICIPALITY_STRONG", "MODEL_HIGH_P",
    "MODEL_AMBIGUOUS", "CONFLICTING_SIGNALS", "INSUFFICIENT_EVIDENCE",
]
EVIDENCE = ["supports_match", "supports_nonmatch", "tie_breakers"]
QUALITY = ["pii_leak_detected", "insufficient_evidence", "inconsistent_input"]
ANSWER_SCHEMA = (
    "decision string, confidence string, reason_codes array<string>, "
    "evidence_summary struct<supports_match:array<string>,supports_nonmatch:array<string>,tie_breakers:array<string>>, "
    "quality_flags struct<pii_leak_detected:boolean,insufficient_evidence:boolean,inconsistent_input:boolean>"
)


# Fixed value: a code fence around an answer.
FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _object(text: Column) -> Column:
    """The text if it is one valid JSON object, else NULL."""
    return _let(text, lambda t: F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t))


def _balanced(text: Column) -> Column:
    """The brace-balanced stretch that holds the decision key, else NULL.

    An object that begins with the key comes before one that has it further inside; the depth of
    braces is followed character by character up to the closing one.
    """
    def follow(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return _let(depth, lambda d: F.struct(
            d.alias("depth"), (s["at"] + 1).alias("at"),
            F.when((s["end"] == 0) & (d == 0), s["at"] + 1).otherwise(s["end"]).alias("end")))

    def closed(rest: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
        return F.substring(rest, F.lit(1), F.aggregate(F.split(rest, ""), start, follow, lambda s: s["end"]))

    def opened(t: Column) -> Column:
        direct = F.position(F.lit('{"decision"'), t)
        before = F.substring_index(t, '"decision"', 1)
        inner = F.when(F.contains(t, F.lit('"decision"')) & F.contains(before, F.lit("{")),
                       F.length(before) - F.length(F.substring_index(before, "{", -1)))
        return F.when(direct > 0, direct).otherwise(inner)

    return _let(text, lambda t: _let(F.substring(t, opened(t), F.length(t)), closed))


def extract_json(answers: DataFrame, raw: str = "raw", out: str = "json") -> DataFrame:
    """The answer's JSON object as text, NULL when there is none.

    Thinking blocks go first.  The outermost braces cover a plain answer, one in a code fence and
    one amid prose; where they hold no valid JSON, a fenced object and then the braces around the
    decision key are tried.
    """
    stripped = F.regexp_replace(ref(raw), r"(?s)<think>.*?</think>", "")
    rows = answers.withColumn("_s", stripped).withColumn("_t", F.regexp_extract("_s", r"(?s)\{.*\}", 0))
    rows = rows.withColumn("_o", _object(F.col("_t")))
    tail = F.substring(F.col("_s"), F.position(F.lit("{"), F.col("_s")), F.length("_s"))
    rescued = F.when(F.contains("_s", F.lit("{")), _let(tail, lambda t: F.coalesce(
        _object(F.trim(F.regexp_extract(t, FENCE, 1))), _object(_balanced(t)))))
    return rows.withColumn(out, F.when(F.col("_o").isNotNull(), F.col("_o")).otherwise(rescued)).drop("_s", "_t", "_o")


def validate(answers: DataFrame, json: str = "json", binary: bool = False) -> DataFrame:
    """Normalised answer columns; rows without JSON are left out.

    Default: unknown decisions are UNSURE, confidence is 0.5 when unreadable, codes are limited
    to the valid ones.  ``binary``: anything but MATCH is NONMATCH, confidence defaults to 0 and
    codes stay as given.
    """
    # Exploded, not filtered: a filter on the JSON would be moved below its extraction and do it again.
    a = F.array(F.from_json(ref(json), ANSWER_SCHEMA))
    rows = answers.withColumn("_a", F.explode(F.when(ref(json).isNotNull(), a)))
    said = F.upper(F.trim(F.col("_a.decision")))
    number = F.col("_a.confidence").try_cast("double")
    clipped = F.least(F.greatest(F.nanvl(number, F.lit(None).cast("double")), F.lit(0.0)), F.lit(1.0))
    confidence = F.when(number.isNotNull() & ~F.isnan(number), clipped)
    codes = F.coalesce(F.col("_a.reason_codes"), F.array().cast("array<string>"))
    if binary:
        decision = F.when(said == "MATCH", "MATCH").otherwise("NONMATCH")
        confidence = F.round(F.coalesce(confidence, F.lit(0.0)), 4)
    else:
        decision = F.when(said.isin(*DECISIONS), said).otherwise("UNSURE")
        confidence = F.coalesce(confidence, F.lit(0.5))
        valid = F.filter(codes, lambda c: c.isin(*REASON_CODES))
        codes = F.when(F.size(valid) > 0, valid).otherwise(F.array(F.lit("INSUFFICIENT_EVIDENCE")))
    lists = F.struct(*[
        F.coalesce(F.col(f"_a.evidence_summary.{e}"), F.array().cast("array<string>")).alias(e)
        for e in EVIDENCE
    ])
    flags = F.struct(*[F.coalesce(F.col(f"_a.quality_flags.{q}"), F.lit(False)).alias(q) for q in QUALITY])
    return rows.withColumns({
        "decision": decision, "confidence": confidence, "reason_codes": codes,
        "evidence_summary": lists, "quality_flags": flags,
    }).drop("_a")


def _side_by_side(parsed: DataFrame, key: str, agents: tuple[str, str, str]) -> DataFrame:
    """Each pair's three last answers as prefixed columns: one shuffle, one mergeable aggregate.

    The last is the one with the greatest ``attempt``, where that column exists.  Every column is an
    aggregate of its own (all of a reviewer's follow one order, so they take the same row): those that
    nothing reads are neither worked out nor shuffled.
    """
    names = ["confidence", "decision", "reason_codes", "evidence_summary", "quality_flags", "latency_s", "tokens"]
    names = [n for n in names if n in parsed.columns]
    latest = F.col("attempt") if "attempt" in parsed.columns else F.lit(0)
    order = {p: F.when(F.col("agent") == who, latest) for who, p in zip(agents, ("a", "b", "arb"))}
    rows = parsed.groupBy(key).agg(
        *[F.max(order[p].isNotNull()).alias(f"_{p}") for p in ("a", "b")],
        *[F.max_by(n, by).alias(f"{p}_{n}") for p, by in order.items() for n in names])
    return rows.filter("_a AND _b").drop("_a", "_b")


def consensus(
    parsed: DataFrame, key: str = "pair_id", variant: str = "live",
    agents: tuple[str, str, str] = ("A", "B", "C"),
) -> DataFrame:
    """Final decision per pair from two reviewers and an arbiter.

    ``live``: equal decisions take the more confident reviewer's answer and the greater
    confidence; otherwise the arbiter decides.  ``batch``: equal decisions average the
    confidence and join the codes; without an arbiter the pair is UNSURE.  ``binary``: as batch
    with all codes in order, pairs without an arbiter are errors.
    """
    rows = _side_by_side(parsed, key, agents)
    agree = F.col("a_decision") == F.col("b_decision")
    arbiter = ~agree & F.col("arb_decision").isNotNull()
    first = F.col("a_confidence") >= F.col("b_confidence")
    mean = (F.col("a_confidence") + F.col("b_confidence")) / 2
    codes = lambda x: F.coalesce(F.col(x), F.array().cast("array<string>"))
    union = F.array_union("a_reason_codes", "b_reason_codes")
    if variant == "live":
        confidence = F.when(agree, F.greatest("a_confidence", "b_confidence")).otherwise(F.col("arb_confidence"))
        reasons = F.when(agree, F.when(first, F.col("a_reason_codes")).otherwise(F.col("b_reason_codes"))).otherwise(codes("arb_reason_codes"))
    elif variant == "batch":
        confidence = F.round(F.when(agree, mean).when(arbiter, F.col("arb_confidence")).otherwise(0.5), 3)
        reasons = F.when(agree, union).when(arbiter, codes("arb_reason_codes")).otherwise(F.array(F.lit("AGENT_DISAGREEMENT")))
    elif variant == "binary":
        confidence = F.round(F.when(agree, mean).otherwise(F.col("arb_confidence")), 4)
        # The arbiter only counts where it was asked.
        reasons = F.array_union(union, F.when(arbiter, codes("arb_reason_codes")).otherwise(F.array().cast("array<string>")))
    else:
        raise ValueError("variant must be live, batch or binary")
    protocol = F.when(agree, "consensus").when(arbiter, "arbiter").otherwise("disagreement_unresolved")
    decision = F.when(agree, F.col("a_decision")).when(arbiter, F.col("arb_decision")).otherwise("UNSURE")
    out = rows.select(
        key, decision.alias("decision"), confidence.alias("confidence"), reasons.alias("reason_codes"),
        protocol.alias("protocol"), F.col("a_decision").alias("agent_a_decision"),
        F.col("b_decision").alias("agent_b_decision"),
        F.when(arbiter, F.col("arb_decision")).alias("arbiter_decision"),
        *[F.col(f"{p}_{n}") for p in ("a", "b", "arb") for n in ("tokens", "latency_s") if f"a_{n}" in rows.columns],
    )
    return out.filter(protocol != "disagreement_unresolved") if variant in ("live", "binary") else out


def review_errors(parsed: DataFrame, requested: DataFrame, key: str = "pair_id",
                  agents: tuple[str, str] = ("A", "B")) -> DataFrame:
    """Pairs for which a reviewer's answer is missing."""
    rows = requested.select(key).distinct()
    for i, agent in enumerate(agents):
        seen = parsed.filter(F.col("agent") == agent).select(key, F.lit(True).alias(f"_s{i}")).distinct()
        rows = rows.join(seen, key, "left")
    texts = F.array_compact(F.array(*[
        F.when(F.col(f"_s{i}").isNull(), F.lit(f"Agent-{a} failed")) for i, a in enumerate(agents)
    ]))
    return rows.select(key, F.array_join(texts, "; ").alias("error")).filter(F.col("error") != "")


def disagreements(parsed: DataFrame, key: str = "pair_id", agents: tuple[str, str] = ("A", "B")) -> DataFrame:
    """Pairs whose two reviewers differ, with both opinions as JSON text."""
    def side(agent: str, name: str) -> DataFrame:
        opinion = F.to_json(F.struct("decision", "confidence", "reason_codes"))
        return parsed.filter(F.col("agent") == agent).select(
            key, F.col("decision").alias(f"decision_{name}"), opinion.alias(f"opinion_{name}"))

    both = side(agents[0], "a").join(side(agents[1], "b"), key)
    return both.filter(F.col("decision_a") != F.col("decision_b"))


def audit_rows(final: DataFrame, key: str = "pair_id") -> DataFrame:
    """Flat audit record: decisions per agent, tokens summed over those who were asked."""
    used = F.col("a_tokens") + F.col("b_tokens") + F.when(
        F.col("protocol") == "arbiter", F.coalesce("arb_tokens", F.lit(0))).otherwise(0)
    return final.select(key, "decision", "confidence", "protocol", "agent_a_decision", "agent_b_decision",
                        "arbiter_decision", used.alias("total_tokens"))


def attempts(log: DataFrame, key: str = "pair_id") -> DataFrame:
    """Per pair and agent: attempts, the last parsed decision, whether a retry changed it.

    Mergeable aggregates only, so a pair with a long log stays cheap.
    """
    good = F.col("decision").isNotNull()
    order = F.when(good, F.col("attempt"))
    return log.groupBy(key, "agent").agg(
        F.count("*").alias("attempt_count"), F.min_by("decision", order).alias("first_decision"),
        F.max_by("decision", order).alias("last_decision"), F.max(good).alias("succeeded"),
    ).withColumn("retry_changed", F.coalesce(F.col("first_decision") != F.col("last_decision"), F.lit(False)))


def review_metrics(final: DataFrame, target: str = "target") -> DataFrame:
    """Counts and rates of final decisions, flips of the base choice, and agreement with labels."""
    n = F.count("*")
    said = lambda d: F.sum((F.col("decision") == d).cast("bigint"))
    via = lambda p: F.sum((F.col("protocol") == p).cast("bigint"))
    y = ref(target)

    def truth(decision: str, label: int) -> Column:
        return F.sum(((F.col("decision") == decision) & (y == label)).cast("bigint"))

    flips = []
    if "base_choice" in final.columns:
        base = F.col("base_choice") == "MATCH"
        flips = [F.sum((base & (F.col("decision") == d)).cast("bigint")).alias(f"flipped_match_to_{d.lower()}")
                 for d in ("NONMATCH", "UNSURE")]
    got = final.agg(
        n.alias("n"), *[said(d).alias(f"n_{d.lower()}") for d in DECISIONS],
        via("consensus").alias("n_consensus"), via("arbiter").alias("n_arbiter"),
        F.avg("confidence").alias("avg_confidence"), *flips,
        F.sum(y.isNotNull().cast("bigint")).alias("gt_n"), truth("MATCH", 1).alias("gt_tp"),
        truth("MATCH", 0).alias("gt_fp"), truth("NONMATCH", 0).alias("gt_tn"), truth("NONMATCH", 1).alias("gt_fn"),
    )
    decided = F.col("gt_tp") + F.col("gt_fp") + F.col("gt_tn") + F.col("gt_fn")
    return got.withColumns({
        "consensus_rate": F.round(ratio(F.col("n_consensus"), F.col("n")), 4),
        "arbiter_rate": F.round(ratio(F.col("n_arbiter"), F.col("n")), 4),
        "unsure_rate": F.round(ratio(F.col("n_unsure"), F.col("n")), 4),
        "gt_decided_n": decided,
        "gt_accuracy": F.round(ratio(F.col("gt_tp") + F.col("gt_tn"), decided, None), 4),
    })


def decisions_by_band(final: DataFrame) -> DataFrame:
    return final.groupBy("band").pivot("decision", DECISIONS).agg(F.count(F.lit(1))).fillna(0)


def concordance(final: DataFrame, gold: DataFrame, key: str = "pair_id", target: str = "target") -> DataFrame:
    """Agreement of clear decisions with the gold labels, with interval and latency."""
    joined = final.join(gold.select(key, ref(target).alias("_y")), key, "left")
    clear = F.col("decision").isin("MATCH", "NONMATCH")
    hit, yes, known = F.col("decision") == "MATCH", F.col("_y") == 1, F.col("_y").isNotNull()

    def n_of(c: Column) -> Column:
        return F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))

    out = joined.agg(
        n_of(clear | (F.col("decision") == "UNSURE")).alias("n_evaluated"), n_of(clear).alias("n_valid"),
        n_of(F.col("decision") == "UNSURE").alias("n_unsure"),
        n_of(clear & known & yes & hit).alias("tp"), n_of(clear & known & ~yes & hit).alias("fp"),
        n_of(clear & known & yes & ~hit).alias("fn"), n_of(clear & known & ~yes & ~hit).alias("tn"),
        F.avg(F.when(clear, F.col("confidence"))).alias("mean_confidence"),
        *([F.avg("latency_s").alias("mean_latency_s")] if "latency_s" in joined.columns else []),
    )
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    rate = ratio(F.col("tp") + F.col("tn"), n, None)
    low, high = wilson_of_rate(rate, n)
    out = out.withColumns({
        "concordance": rate, "ci_low": low, "ci_high": high,
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        "unsure_rate": ratio(F.col("n_unsure"), F.col("n_evaluated")),
    })
    if "latency_s" in joined.columns:
        middle = exact_quantiles(final, "latency_s", {"m": 0.5}).select("m").scalar()
        out = out.withColumn("median_latency_s", middle)
    return out
