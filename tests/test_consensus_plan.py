"""answers are taken apart once, and columns that nothing reads are not carried along."""

from pairsieve.operators.review import consensus, extract_json, validate


def test_an_answer_is_taken_apart_once(spark):
    rows = [(1, "A", '{"decision": "match", "confidence": 0.5}'), (1, "B", 'ok {"decision": "MATCH", "confidence": 0.7}'),
            (2, "A", "none"), (2, "B", '{"decision": "MATCH"}'), (3, "A", None)]
    answers = spark.createDataFrame(rows, "pair long, agent string, raw string")
    parsed = validate(extract_json(answers))
    assert sorted((r.pair, r.agent) for r in parsed.collect()) == [(1, "A"), (1, "B"), (2, "B")]
    final = consensus(parsed, "pair").select("pair", "decision", "confidence", "protocol")
    assert [tuple(r) for r in final.collect()] == [(1, "MATCH", 0.7, "consensus")]
    plan = final._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<think>") == 1 and "INSUFFICIENT_EVIDENCE" not in plan


def test_all_of_a_reviewer_comes_from_one_row(spark):
    rows = [(p, a, n, f"{a}{n}", n / 10, [f"{a}{n}"], n) for p in range(20) for a in "ABC" for n in (2, 3, 1)]
    rows += [(p, "A", 3, "A4", 0.4, ["A4"], 4) for p in range(20)]  # a tie of attempts
    parsed = spark.createDataFrame(rows, "pair long, agent string, attempt int, decision string, confidence double, reason_codes array<string>, tokens int")
    for r in consensus(parsed.repartition(7), "pair", "batch").collect():
        assert r.agent_a_decision == f"A{r.a_tokens}" and r.a_tokens in (3, 4)
        assert (r.agent_b_decision, r.b_tokens, r.arb_tokens, r.reason_codes) == ("B3", 3, 3, ["C3"])
