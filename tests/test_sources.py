from pyspark.sql import functions as F

from pairsieve.config import default_settings
from pairsieve.operators import review as R
from pairsieve.operators import text as X
from pairsieve.plans.run import decide
from pairsieve.plans.views import dates_as_text, pairs
from pairsieve.sources import scans, sinks
from pairsieve.streaming import windows as S

SMALL = "/root/testdata/sf0.001"
HEADER = "COMPREC,C,12,0;REFREC,C,12,0;PASSO;PAR;nota final;R_DTNASC,C,8,0;C_DTNASC,C,8,0;R_DTOBITO,C,10,0;C_DTDIAG,C,10,0;R_BAIRES;NOME qtd frag iguais"
LINE = "1;2;1;1;9,5;19800101;19810101;01022020;20200101;São João;0,95"


def test_read_export(spark, tmp_path):
    for encoding in ("utf-8", "latin-1"):
        path = tmp_path / f"{encoding}.csv"
        path.write_bytes(f"{HEADER}\n{LINE}\n3;4;2;0;NA;x;;;;;N/A\n".encode(encoding))
        rows = scans.read_pairs(spark, str(path)).orderBy("COMPREC").collect()
        assert rows[0]["nota final"] == 9.5 and rows[0]["TARGET"] == 1 and rows[0]["diff_ano"] == 1.0
        assert rows[0]["R_BAIRES"] == "São João" and str(rows[0]["R_DTOBITO_dt"]) == "2020-02-01"
        assert rows[1]["nota final"] is None and rows[1]["diff_ano"] is None and rows[1]["macd_nasc_close"] == 0
    table = scans.read_model_table(spark, str(path))
    assert table.first()["R_BAIRES"] == "São João" and table.first()["PASSO"] == 1.0


def test_names():
    assert scans.tidy_name("  a  b c ") == "a_b_c"
    assert scans.resolve_column(["A,C,1", "B"], "A") == "A,C,1" and scans.resolve_column(["A,1", "A,2"], "A") is None


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, 1)], "k int, p double, y int")
    sinks.write_csv(df, str(tmp_path / "c"), decimal=",")
    back = scans.read_text_table(spark, str(tmp_path / "c"), "UTF-8")
    assert back.first()["p"] == "1,5" and scans.numbers_from_text(back, ["p"]).first()["p"] == 1.5
    sinks.write_probabilities(df, str(tmp_path / "p"), "k", "y", "p", "forest")
    assert spark.read.parquet(str(tmp_path / "p")).first()["model"] == "forest"
    sinks.write_manifest(df, {"a": "1"}, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["rows"] == 1
    bundle = sinks.result_bundle({"runs": (spark.createDataFrame([("a", 0.1), ("b", 0.9)], "m string, f1 double"), "f1")})
    assert bundle.first()["records"].startswith('[{"m":"b"')
    assert scans.read_review_results(spark, str(tmp_path / "none")).count() == 0


def test_decide_with_every_calibration(spark, tmp_path):
    df, s = pairs(spark, SMALL), default_settings()
    fitted = decide(df, s, "vigilancia", "k", "fit_platt", save_to=str(tmp_path / "platt"))
    loaded = decide(df, s, "vigilancia", "k", "load_platt", model_path=str(tmp_path / "platt"))
    count = lambda d: {r["action"]: r["count"] for r in d.pairs.groupBy("action").count().collect()}
    assert count(fitted) == count(loaded) and fitted.model.slope > 0


def test_stream_replays_spend_once(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = dates_as_text(pairs(spark, SMALL))
    rows.write.parquet(source)
    s = default_settings()
    writer = S.batch_writer(s, "vigilancia", "k", lambda: F.year("R_DTOBITO_dt"), str(tmp_path / "ledger"), str(tmp_path / "out"))
    S.start(spark.readStream.schema(rows.schema).parquet(source), writer, str(tmp_path / "cp")).awaitTermination(120)
    first = S.read_ledger(spark, str(tmp_path / "ledger")).agg(F.sum("used")).first()[0]
    writer(spark.read.parquet(source), 0)
    assert first > 0 and S.read_ledger(spark, str(tmp_path / "ledger")).agg(F.sum("used")).first()[0] == first
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_critical_drift_changes_the_next_batches_only(spark, tmp_path):
    from pairsieve import columns as C
    from pairsieve.config import Monitoring

    rows = dates_as_text(pairs(spark, SMALL)).filter("k % 4 = 0").cache()
    score = f"`{C.SCORE}`"
    shifted = rows.withColumn(C.SCORE, F.expr(f"least(12D, {score} + 3)"))
    monitoring = Monitoring(True, {"ks": {"threshold_warn": 0.1, "threshold_critical": 0.2}, "psi": {"threshold_warn": 5.0, "threshold_critical": 9.0}},
                            (), (C.SCORE,), ("tighten_auto_thresholds", "increase_llm_budget_if_possible", "freeze_calibration"))
    control = S.DriftControl(rows, monitoring, str(tmp_path / "limits"))
    s = default_settings()
    writer = S.batch_writer(s, "vigilancia", "k", lambda: F.year("R_DTOBITO_dt"), str(tmp_path / "ledger"), str(tmp_path / "out"), control=control, refit=True)
    at = lambda before: S.current_thresholds(spark, control.path, "vigilancia", s.mode("vigilancia"), before)
    assert at(0) == (s.mode("vigilancia"), False, None)
    for number, batch in enumerate([rows, shifted, rows]):
        writer(batch, number)
    first, second, third = at(1), at(2), at(3)
    assert first[0] == s.mode("vigilancia") and not first[1]
    assert second[1] and abs(second[0].min_auto_match - 0.9) < 1e-9 and abs(second[0].max_auto_nonmatch - 0.1) < 1e-9
    assert second[0].budget == int(s.mode("vigilancia").budget * 1.5)
    assert third[1] and third[2] == second[2] != first[2]  # frozen: the calibration of the second batch stays
    before = spark.read.parquet(str(tmp_path / "out")).filter("batch = 1").agg(F.bit_xor(F.xxhash64("k", "action"))).first()[0]
    writer(shifted, 1)  # a replay sees the thresholds it saw the first time
    assert spark.read.parquet(str(tmp_path / "out")).filter("batch = 1").agg(F.bit_xor(F.xxhash64("k", "action"))).first()[0] == before
    assert at(2) == second and at(3) == third


def test_extract_and_validate(spark):
    raw = ['{"decision": "match", "confidence": 2}', '<think>{x}</think>ok ```json\n{"decision":"NONMATCH","reason_codes":["NAME_WEAK","X"]}\n```',
           'a {not json} then {"decision": "MATCH", "confidence": "high"} and }', "nothing", '{"decision": "PERHAPS"}']
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw string")
    got = {r["i"]: r for r in R.validate(R.extract_json(df)).collect()}
    assert set(got) == {0, 1, 2, 4}
    assert got[0]["decision"] == "MATCH" and got[0]["confidence"] == 1.0
    assert got[1]["reason_codes"] == ["NAME_WEAK"] and got[2]["confidence"] == 0.5
    assert got[4]["decision"] == "UNSURE" and got[4]["reason_codes"] == ["INSUFFICIENT_EVIDENCE"]


def plain_citations(text):
    """(key, line, sentence, paragraph, section) by looking around every citation."""
    import re
    from bisect import bisect_left, bisect_right

    dots, blanks = [m.start() for m in re.finditer(r"\.", text)], [m.start() for m in re.finditer(r"\n(?=\n)", text)]
    heads = [(m.end(), m[1].strip()) for m in re.finditer(X.SECTION, text)]
    found = []
    for m in re.finditer(X.CITE, text):
        at = m.start()

        def around(breaks, gap):
            left, right = bisect_left(breaks, at), bisect_left(breaks, at)
            start = breaks[left - 1] + 1 if left else 0
            return " ".join(text[start:breaks[right] + gap if right < len(breaks) else len(text)].split())

        head = bisect_right([e for e, _ in heads], at)
        found += [(k.strip(), text.count("\n", 0, at) + 1, around(dots, 1), around(blanks, 0), heads[head - 1][1] if head else None)
                  for k in m[1].split(",")]
    return sorted(found, key=str)


def cited(spark, rows, **named):
    marks = X.citation_marks(spark.createDataFrame(rows, "doc_id long, text string, body string, k int"), **named)
    sentences = X.passages_of(marks).select("doc_id", F.col("number").alias("sentence_no"), F.col("text").alias("sentence"))
    paragraphs = X.passages_of(marks, "paragraph").select("doc_id", F.col("number").alias("paragraph_no"), F.col("text").alias("paragraph"))
    joined = X.citations_of(marks).join(sentences, ["doc_id", "sentence_no"]).join(paragraphs, ["doc_id", "paragraph_no"])
    got = {}
    for r in joined.collect():
        got.setdefault(r.doc_id, []).append((r.bib_key, r.line_number, r.sentence, r.paragraph, r.section))
    return {d: sorted(v, key=str) for d, v in got.items()}


def test_citation_fields(spark):
    import random

    text = "\\section{One}\nFirst part. Second\nhas it \\cite[p. 2]{a, b} here. Third.\n\nNext \\citeonline{c} ends"
    rng = random.Random(6)
    parts = ["\\cite{a}", "\\citep[see.][p. 3]{b,c}", "\\section{S one}", "\\subsection{T.\nx}", ".", ". ", "\n", "\n\n", "\n\n\n", "word", " é🙂 ", "\\cite{}", "\\cite {d }"]
    texts = [text, "", None, "no citation. at all", "\\cite{x}" * 300] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    got = cited(spark, [(i, t, "x", 1) for i, t in enumerate(texts)])
    assert got == {i: w for i, t in enumerate(texts) if (w := plain_citations(t or ""))}
    assert [(k, n, s) for k, n, _, _, s in got[0]] == [("a", 3, "One"), ("b", 3, "One"), ("c", 5, "One")]


def test_citation_output_is_linear(spark):
    long = "word \\cite{k} " * 20_000  # no full stop, no blank line
    marks = X.citation_marks(spark.createDataFrame([(1, long)], "doc_id long, text string"))
    facts = marks.agg(F.sum(F.length("body")).alias("held"), F.count("*").alias("rows")).first()
    assert facts.held < 3 * len(long) and facts.rows == 20_002
    plan = marks._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_keyword_scores(spark):
    sentences = spark.createDataFrame([(1, 0, "alpha beta gamma delta"), (1, 1, "with"), (2, 0, "the software alpha")], "doc_id long, number int, text string")
    cites = spark.createDataFrame([(1, 0, "a"), (1, 0, "a"), (1, 0, "b"), (1, 1, "a"), (2, 0, "a"), (2, 0, "none")], "doc_id long, sentence_no int, bib_key string")
    abstracts = spark.createDataFrame([("a", "Alpha, gamma and others"), ("b", "")], "bib_key string, abstract string")
    got = {(r.doc_id, r.sentence_no, r.bib_key): (r.overlap, r.score, r.citations) for r in X.keyword_scores(cites, sentences, abstracts).collect()}
    assert got == {(1, 0, "a"): (0.5, "L3_PASS", 2), (1, 0, "b"): (0.0, "L3_WARN_INCONCLUSIVE", 1), (1, 1, "a"): (None, "L3_WARN_INCONCLUSIVE", 1),
                   (2, 0, "a"): (0.5, "L3_PASS", 1)}
