"""Registered queries: dossiers, review answers, text and bibliography."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairsieve.operators import biblio as B
from pairsieve.operators import dossier as O
from pairsieve.operators import review as R
from pairsieve.operators import text as X
from pairsieve.plans.queries_metrics import round_all
from pairsieve.plans.queries_triage import decided
from pairsieve.plans.registry import register, table
from pairsieve.session import materialise, small_table
from pairsieve.plans.views import GUARD_SQL, PAIRS_SQL, answers_sql, pairs, triage_sql
from pairsieve.sources.scans import not_yet_done

BASE_SQL = f"""WITH pairs AS ({PAIRS_SQL}), base AS (SELECT k, nota, CASE WHEN par IN (1, 2) THEN 1 ELSE 0 END AS target FROM pairs)"""


def answers(spark, sf_dir):
    """Raw answers of three agents on every pair."""
    text = f"{BASE_SQL} {answers_sql('base')}".replace("{", "{{").replace("}", "}}")
    text = text.replace("FROM orders", "FROM {orders}").replace("AS VARCHAR(20)", "AS STRING")
    return spark.sql(text, orders=table(spark, sf_dir, "orders"))


def parsed(spark, sf_dir, binary: bool = False):
    rows = R.validate(R.extract_json(answers(spark, sf_dir)), binary=binary)
    return rows.withColumns({"tokens": F.col("pair") % 100, "latency_s": (F.col("pair") % 50) / 4.0})


_PICK = {"A": "k % 3", "B": "(k + k % 5) % 3", "C": "(k * 7) % 3"}
_SAID = " UNION ALL ".join(
    f"""SELECT k AS pair, target, nota, '{a}' AS agent, CASE {p} WHEN 0 THEN 'MATCH' WHEN 1 THEN 'NONMATCH' ELSE 'UNSURE' END AS decision,
  CAST(CONCAT('0.', CAST((k * 3 + 1 + {ord(a)}) % 13 AS VARCHAR)) AS DOUBLE) AS confidence,
  CASE k % 3 WHEN 0 THEN 'NAME_STRONG' WHEN 1 THEN 'MODEL_HIGH_P' ELSE 'INSUFFICIENT_EVIDENCE' END AS first_code,
  k % 2 = 0 AS insufficient FROM base WHERE NOT (k % 5 = 4 AND k % 2 = 0)""" for a, p in _PICK.items())
PARSED_SQL = f"{BASE_SQL}, parsed AS ({_SAID})"


@register("review_answers", f"{PARSED_SQL} SELECT pair, agent, decision, confidence, first_code, insufficient FROM parsed")
def review_answers(spark, sf_dir):
    return parsed(spark, sf_dir).select(
        "pair", "agent", "decision", "confidence", F.element_at("reason_codes", 1).alias("first_code"),
        F.col("quality_flags.insufficient_evidence").alias("insufficient"))


FINAL_SQL = f"""{PARSED_SQL}, j AS (SELECT a.pair, a.target, a.nota, a.decision AS da, b.decision AS db, c.decision AS dc,
  a.confidence AS ca, b.confidence AS cb, c.confidence AS cc FROM parsed a JOIN parsed b ON a.pair = b.pair AND b.agent = 'B'
  JOIN parsed c ON a.pair = c.pair AND c.agent = 'C' WHERE a.agent = 'A')"""


@register("consensus_live", f"""{FINAL_SQL} SELECT pair, CASE WHEN da = db THEN da ELSE dc END AS decision,
  ROUND(CASE WHEN da = db THEN GREATEST(ca, cb) ELSE cc END, 6) AS confidence, CASE WHEN da = db THEN 'consensus' ELSE 'arbiter' END AS protocol FROM j""")
def consensus_live(spark, sf_dir):
    return R.consensus(parsed(spark, sf_dir), "pair", "live").select(
        "pair", "decision", F.round("confidence", 6).alias("confidence"), "protocol")


@register("consensus_batch", f"""{FINAL_SQL} SELECT pair, CASE WHEN da = db THEN da ELSE 'UNSURE' END AS decision,
  ROUND(CASE WHEN da = db THEN (ca + cb) / 2 ELSE 0.5E0 END, 2) AS confidence, CASE WHEN da = db THEN 'consensus' ELSE 'disagreement_unresolved' END AS protocol FROM j""")
def consensus_batch(spark, sf_dir):
    two = parsed(spark, sf_dir).filter("agent <> 'C'")
    return R.consensus(two, "pair", "batch").select(
        "pair", "decision", F.round("confidence", 2).alias("confidence"), "protocol")


@register("consensus_binary", f"""{FINAL_SQL}, y AS (SELECT pair, CASE WHEN da = 'MATCH' THEN 'MATCH' ELSE 'NONMATCH' END AS da,
  CASE WHEN db = 'MATCH' THEN 'MATCH' ELSE 'NONMATCH' END AS db, CASE WHEN dc = 'MATCH' THEN 'MATCH' ELSE 'NONMATCH' END AS dc FROM j)
SELECT CASE WHEN da = db THEN da ELSE dc END AS decision, CASE WHEN da = db THEN 'consensus' ELSE 'arbiter' END AS protocol, COUNT(*) AS n
FROM y GROUP BY 1, 2""")
def consensus_binary(spark, sf_dir):
    return R.consensus(parsed(spark, sf_dir, True), "pair", "binary").groupBy("decision", "protocol").agg(F.count("*").alias("n"))


@register("reviewer_disagreements", f"{FINAL_SQL} SELECT pair, da AS decision_a, db AS decision_b FROM j WHERE da <> db")
def reviewer_disagreements(spark, sf_dir):
    return R.disagreements(parsed(spark, sf_dir), "pair").select("pair", "decision_a", "decision_b")


@register("review_errors", f"{BASE_SQL} SELECT k AS pair, 'Agent-A failed; Agent-B failed' AS error FROM base WHERE k % 5 = 4 AND k % 2 = 0")
def review_errors(spark, sf_dir):
    asked = pairs(spark, sf_dir).select(F.col("k").alias("pair"))
    return R.review_errors(parsed(spark, sf_dir), asked, "pair")


@register("review_audit", f"""{FINAL_SQL} SELECT pair, CASE WHEN da = db THEN NULL ELSE dc END AS arbiter_decision,
  (pair % 100) * CASE WHEN da = db THEN 2 ELSE 3 END AS total_tokens FROM j""")
def review_audit(spark, sf_dir):
    final = R.consensus(parsed(spark, sf_dir), "pair", "live")
    return R.audit_rows(final, "pair").select("pair", "arbiter_decision", "total_tokens")


@register("attempt_reduction", f"""{FINAL_SQL} SELECT pair, 3 AS attempt_count, da AS first_decision, dc AS last_decision, da <> dc AS retry_changed FROM j""")
def attempt_reduction(spark, sf_dir):
    log = parsed(spark, sf_dir).withColumn("attempt", F.ascii("agent")).withColumn("agent", F.lit("A"))
    return R.attempts(log, "pair").select(
        "pair", F.col("attempt_count").cast("int").alias("attempt_count"), "first_decision", "last_decision", "retry_changed")


@register("review_quality", f"""{FINAL_SQL}, f AS (SELECT target, nota, CASE WHEN da = db THEN da ELSE dc END AS d, da = db AS agree FROM j)
SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN d = 'UNSURE' THEN 1 ELSE 0 END) AS BIGINT) AS n_unsure,
  ROUND(CAST(SUM(CASE WHEN agree THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*), 4) AS consensus_rate,
  CAST(SUM(CASE WHEN d = 'MATCH' AND target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS gt_tp,
  CAST(SUM(CASE WHEN nota >= 8 AND d = 'NONMATCH' THEN 1 ELSE 0 END) AS BIGINT) AS flipped_match_to_nonmatch,
  ROUND(CAST(SUM(CASE WHEN (d = 'MATCH' AND target = 1) OR (d = 'NONMATCH' AND target = 0) THEN 1 ELSE 0 END) AS DOUBLE) / SUM(CASE WHEN d <> 'UNSURE' THEN 1 ELSE 0 END), 4) AS gt_accuracy FROM f""")
def review_quality(spark, sf_dir):
    rows = parsed(spark, sf_dir)
    facts = rows.filter("agent = 'A'").select("pair", "target", F.when(F.col("nota") >= 8, "MATCH").otherwise("NONMATCH").alias("base_choice"))
    final = R.consensus(rows, "pair", "live").join(facts, "pair")
    return R.review_metrics(final).select("n", "n_unsure", "consensus_rate", "gt_tp", "flipped_match_to_nonmatch", "gt_accuracy")


@register("decisions_by_band", f"""{FINAL_SQL}, f AS (SELECT CASE WHEN nota >= 8 THEN 'high' ELSE 'low' END AS band, CASE WHEN da = db THEN da ELSE dc END AS d FROM j)
SELECT band, CAST(SUM(CASE WHEN d = 'MATCH' THEN 1 ELSE 0 END) AS BIGINT) AS "MATCH", CAST(SUM(CASE WHEN d = 'NONMATCH' THEN 1 ELSE 0 END) AS BIGINT) AS "NONMATCH",
  CAST(SUM(CASE WHEN d = 'UNSURE' THEN 1 ELSE 0 END) AS BIGINT) AS "UNSURE" FROM f GROUP BY band""")
def decisions_by_band(spark, sf_dir):
    rows = parsed(spark, sf_dir)
    bands = rows.filter("agent = 'A'").select("pair", F.when(F.col("nota") >= 8, "high").otherwise("low").alias("band"))
    return R.decisions_by_band(R.consensus(rows, "pair", "live").join(bands, "pair"))


@register("review_concordance", f"""{FINAL_SQL}, f AS (SELECT pair, target, CASE WHEN da = db THEN da ELSE dc END AS d FROM j),
c AS (SELECT SUM(CASE WHEN d = 'MATCH' AND target = 1 THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN d = 'MATCH' AND target = 0 THEN 1 ELSE 0 END) AS fp,
  SUM(CASE WHEN d = 'NONMATCH' AND target = 1 THEN 1 ELSE 0 END) AS fn, SUM(CASE WHEN d = 'NONMATCH' AND target = 0 THEN 1 ELSE 0 END) AS tn,
  COUNT(*) AS n_evaluated, QUANTILE_CONT((pair % 50) / 4.0E0, 0.5) AS median_latency_s FROM f)
SELECT n_evaluated, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
  ROUND(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS concordance, ROUND(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision, median_latency_s FROM c""")
def review_concordance(spark, sf_dir):
    rows = parsed(spark, sf_dir)
    final = R.consensus(rows, "pair", "live").withColumn("latency_s", (F.col("pair") % 50) / 4.0)
    gold = rows.filter("agent = 'A'").select("pair", "target")
    out = R.concordance(final, gold, "pair").select("n_evaluated", "tp", "fp", "fn", "tn", "concordance", "precision", "median_latency_s")
    return round_all(out, ["concordance", "precision"])


@register("review_dossiers", f"""WITH {GUARD_SQL}, {triage_sql()}
SELECT SUBSTR(SHA256(CONCAT(CAST(comprec AS VARCHAR), '|', CAST(refrec AS VARCHAR), '|', CAST(passo AS VARCHAR))), 1, 16) AS pair_id,
  ROUND(nota, 4) AS nota_final, ROUND(nome_qtd, 4) AS name_count, CAST(CASE WHEN mae_qtd IS NULL THEN 2 ELSE 3 END AS INT) AS mother_fields,
  mae_missing = 1 AS mae_missing, ROUND(p_cal, 4) AS p_cal, band, guardrail FROM decided WHERE action = 'LLM_REVIEW'""")
def review_dossiers(spark, sf_dir):
    records = O.dossiers(decided(spark, sf_dir))
    return records.select(
        "pair_id", "features.nota_final", F.col("features.name")["NOME qtd frag iguais"].alias("name_count"),
        F.size("features.mother").alias("mother_fields"), F.col("features.flags")["mae_missing"].alias("mae_missing"),
        "model_outputs.p_cal", "model_outputs.band", "model_outputs.guardrail")


@register("review_requests", f"""WITH {GUARD_SQL}, {triage_sql()}
SELECT CONCAT('A_', SUBSTR(SHA256(CONCAT(CAST(comprec AS VARCHAR), '|', CAST(refrec AS VARCHAR), '|', CAST(passo AS VARCHAR))), 1, 16)) AS custom_id,
  2 AS messages FROM decided WHERE action = 'LLM_REVIEW'""")
def review_requests(spark, sf_dir):
    lines = O.review_requests(O.dossiers(decided(spark, sf_dir)))
    body = F.from_json("value", "custom_id string, body struct<messages:array<struct<role:string,content:string>>>")
    return lines.select(body.alias("b")).select("b.custom_id", F.size("b.body.messages").alias("messages"))


@register("review_resume", f"""{FINAL_SQL} SELECT b.k AS pair FROM base b WHERE b.k NOT IN (SELECT pair FROM j)""")
def review_resume(spark, sf_dir):
    asked = pairs(spark, sf_dir).select(F.col("k").alias("pair"))
    return not_yet_done(asked, parsed(spark, sf_dir), "pair")


# Documents with headings and citations derived from their own number.
TEX_SQL = r"""tex AS (SELECT doc_id, CONCAT('\section{S', CAST(doc_id % 7 AS VARCHAR), '}', CHR(10),
  REPLACE(text, '. ', CONCAT(' \cite{k', CAST(doc_id % 50 AS VARCHAR), ', k', CAST(doc_id % 31 AS VARCHAR), '}. '))) AS text FROM documents)"""


def tex(spark, sf_dir):
    d = F.col("doc_id")
    cite = F.concat(F.lit(" \\cite{k"), (d % 50).cast("string"), F.lit(", k"), (d % 31).cast("string"), F.lit("}. "))
    body = F.concat(F.lit("\\section{S"), (d % 7).cast("string"), F.lit("}\n"), F.replace(F.col("text"), F.lit(". "), cite))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("text"))


LINES_SQL = f"WITH {TEX_SQL}, l AS (SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS line, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, CHR(10)), 1) AS n FROM tex)"


@register("citation_contexts", LINES_SQL + r""", c AS (SELECT doc_id, n, UNNEST(REGEXP_EXTRACT_ALL(line, '\\cite[a-zA-Z]*\{([^}]+)\}', 1)) AS keys FROM l),
e AS (SELECT doc_id, n, TRIM(UNNEST(STRING_SPLIT(keys, ','))) AS bib_key FROM c)
SELECT doc_id, CAST(n AS INT) AS line_number, bib_key, CONCAT('S', CAST(doc_id % 7 AS VARCHAR)) AS section, COUNT(*) AS n FROM e GROUP BY 1, 2, 3, 4""")
def citation_contexts(spark, sf_dir):
    return X.citations(tex(spark, sf_dir)).groupBy("doc_id", "line_number", "bib_key", "section").agg(F.count("*").alias("n"))


@register("pattern_lines", LINES_SQL + r""", h AS (SELECT doc_id, n, UNNEST(LIST_CONCAT(REGEXP_EXTRACT_ALL(line, '[A-Z][a-z]+ \\cite\{'), REGEXP_EXTRACT_ALL(line, '(?:the|les) \\cite\{'))) AS hit
FROM l WHERE line NOT LIKE '\%%' ESCAPE '\') SELECT DISTINCT doc_id, CAST(n AS INT) AS line_number, hit FROM h""")
def pattern_lines(spark, sf_dir):
    return X.find_lines(tex(spark, sf_dir), [r"[A-Z][a-z]+ \\cite\{", r"(?:the|les) \\cite\{"])


@register("uncited_blocks", LINES_SQL.replace("FROM tex)", "FROM (SELECT doc_id, text FROM documents) d)") + r""",
b AS (SELECT *, SUM(CASE WHEN TRIM(REGEXP_REPLACE(line, '[\s\v]+', ' ', 'g')) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS island,
  TRIM(REGEXP_REPLACE(line, '[\s\v]+', ' ', 'g')) = '' AS blank FROM l),
g AS (SELECT doc_id, island, MIN(n) AS start, MAX(n) AS stop, STRING_AGG(line, CHR(10) ORDER BY n) AS body FROM b WHERE NOT blank GROUP BY doc_id, island)
SELECT doc_id, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, CAST(LENGTH(REGEXP_REPLACE(body, '[\s\v]+', '', 'g')) AS INT) AS chars FROM g
WHERE LENGTH(REGEXP_REPLACE(body, '[\s\v]+', '', 'g')) >= 220 AND NOT STARTS_WITH(LTRIM(body), '%')""")
def uncited_blocks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.uncited_blocks(docs).select("doc_id", "start", F.col("end").alias("stop"), "chars")


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_WORDS = "LIST_FILTER(LIST_DISTINCT(REGEXP_EXTRACT_ALL(LOWER({t}), '[\\p{{L}}\\p{{N}}_]{{4,}}')), lambda w: w NOT IN (" + _STOP + "))"


@register("keyword_overlap", f"""WITH s AS (SELECT doc_id, doc_id % (SELECT COUNT(*) FROM benchmark) AS item, {_WORDS.format(t='text')} AS w FROM documents),
a AS (SELECT item_id, {_WORDS.format(t='text')} AS w FROM benchmark),
o AS (SELECT doc_id, LEN(s.w) AS size, LEN(LIST_INTERSECT(s.w, a.w)) AS shared FROM s JOIN a ON s.item = a.item_id)
SELECT doc_id, CASE WHEN size > 0 THEN ROUND(CAST(shared AS DOUBLE) / size, 6) END AS overlap,
  CASE WHEN CAST(shared AS DOUBLE) / NULLIF(size, 0) >= 0.25 THEN 'L3_PASS' WHEN CAST(shared AS DOUBLE) / NULLIF(size, 0) >= 0.15 THEN 'L3_WARN_PARTIAL' ELSE 'L3_WARN_INCONCLUSIVE' END AS score FROM o""")
def keyword_overlap(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    size = items.agg(F.count("*").alias("n")).scalar()
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("doc_id") % size).alias("item"), X.topic_words(F.col("text")).alias("w"))
    joined = docs.join(items.select(F.col("item_id").alias("item"), X.topic_words(F.col("text")).alias("a")), "item")
    overlap, score = X.keyword_verdict(F.col("w"), F.col("a"), F.lit("BACKGROUND"))
    return joined.select("doc_id", F.round(overlap, 6).alias("overlap"), score.alias("score"))


@register("claim_types", """SELECT claim, COUNT(*) AS n FROM (SELECT CASE
  WHEN REGEXP_MATCHES(text, '(?i)(defin[ei]|conceitu|segundo|de acordo com|conforme)') THEN 'DEFINE'
  WHEN REGEXP_MATCHES(text, '(?i)(m[eé]todo|t[eé]cnica|algoritmo|abordagem|estrat[eé]gia|proposto por)') THEN 'SUPPORT_METHOD'
  WHEN REGEXP_MATCHES(text, '(?i)(demonstr|evidenci|observ|estim|revel|identific|aument|reduz)') THEN 'SUPPORT_FACT'
  WHEN REGEXP_MATCHES(text, '(?i)(propôs|desenvolve[ur]|introduzi|criou|elabor)') THEN 'ATTRIBUTE'
  WHEN REGEXP_MATCHES(text, '(?i)(base de dados|sistema de informa|SIM|Sinan|SIH|SITETB|GAL)') THEN 'DATA_SOURCE'
  WHEN REGEXP_MATCHES(text, '(?i)(software|ferramenta|pacote|biblioteca|OpenRecLink|scikit)') THEN 'TOOL'
  WHEN REGEXP_MATCHES(text, '(?i)(entretanto|contudo|por[eé]m|diferentemente|ao contr[aá]rio)') THEN 'CONTRAST'
  WHEN REGEXP_MATCHES(text, '(?i)(ampli|expan|esten|complementa|al[eé]m d[eo])') THEN 'EXTEND' ELSE 'BACKGROUND' END AS claim FROM documents) t GROUP BY claim""")
def claim_types(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(X.claim_type(F.col("text")).alias("claim")).agg(F.count("*").alias("n"))


@register("index_to_text", "SELECT item_id, TRIM(REGEXP_REPLACE(text, '\\s+', ' ', 'g')) AS text FROM benchmark")
def index_to_text(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("p", "w"))
    positions = words.groupBy("item_id", "w").agg(F.collect_list("p").alias("ps"))
    index = positions.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("item_id", X.text_of_index(F.col("index")).alias("text"))


def raw_entries(spark, sf_dir):
    """Bibliography entries derived from parts."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("k"), k.cast("string")).alias("bib_key"),
        F.when(k % 10 == 0, "book").when(k % 10 == 1, "misc").when(k % 10 == 2, "inproceedings").otherwise("article").alias("entry_type"),
        F.concat(F.lit("{"), F.initcap("p_name"), F.lit("}  of "), F.lower("p_type"), F.lit(" "), k.cast("string")).alias("title"),
        F.concat(F.lit("Silva"), (k % 40).cast("string"), F.lit(", Ana AND {Souza}"), (k % 30).cast("string"), F.lit(", Rui")).alias("author"),
        F.when(k % 13 == 0, "s.d.").otherwise(F.concat(F.lit("c. "), (1990 + k % 30).cast("string"))).alias("year"),
        F.when(k % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/"), k.cast("string"))).when(k % 3 == 1, "n/a").alias("doi"),
        F.when(k % 10 > 2, F.when(k % 4 == 0, "arXiv preprint").otherwise(F.concat(F.lit("Journal of "), F.lower("p_brand")))).alias("journal"),
        F.when(k % 20 == 1, "http://example.com").alias("url"),
    )


@register("entry_normalisation", """WITH e AS (SELECT p_partkey AS k, CONCAT('k', CAST(p_partkey AS VARCHAR)) AS bib_key,
  CASE WHEN p_partkey % 10 = 0 THEN 'BOOK_OR_CHAPTER' WHEN p_partkey % 20 = 1 THEN 'WEB_RESOURCE' WHEN p_partkey % 10 = 1 THEN 'PREPRINT' WHEN p_partkey % 10 = 2 THEN 'CONFERENCE_PAPER'
       WHEN p_partkey % 4 = 0 THEN 'PREPRINT' ELSE 'PEER_REVIEWED_ARTICLE' END AS source_type,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(1990 + p_partkey % 30 AS INT) END AS year, CASE WHEN p_partkey % 3 = 0 THEN CONCAT('10.1000/', CAST(p_partkey AS VARCHAR)) END AS doi FROM part)
SELECT bib_key, source_type, year, doi, CONCAT('Souza', CAST(k % 30 AS VARCHAR), ', Rui') AS second_author,
  CONCAT(CASE WHEN year IS NULL THEN 'MISSING_YEAR;' ELSE '' END, CASE WHEN source_type IN ('PEER_REVIEWED_ARTICLE', 'CONFERENCE_PAPER') AND doi IS NULL THEN 'MISSING_DOI;' ELSE '' END) AS issues,
  SUBSTR(CASE WHEN doi IS NOT NULL THEN SHA256(doi) END, 1, 16) AS fingerprint FROM e""")
def entry_normalisation(spark, sf_dir):
    rows = B.normalise_entries(raw_entries(spark, sf_dir))
    mark = B.fingerprint(F.col("doi"), F.col("title"), F.col("authors"), F.col("year"))
    return rows.select(
        "bib_key", "source_type", "year", "doi", F.element_at("authors", 2).alias("second_author"),
        F.array_join(F.transform("completeness_issues", lambda x: F.concat(x, F.lit(";"))), "").alias("issues"),
        F.when(F.col("doi").isNotNull(), mark).alias("fingerprint"))


def metadata(spark, sf_dir):
    """Search results with altered titles, and records by identifier."""
    k = F.col("p_partkey")
    base = table(spark, sf_dir, "part")
    title = F.concat(F.lower("p_name"), F.lit(" of "), F.lower("p_type"), F.lit(" "), k.cast("string"))
    altered = F.when(k % 6 == 2, F.concat(title, F.lit(" appendix"))).when(k % 6 == 4, F.reverse(title)).otherwise(F.translate(title, "o", "0"))
    cited = ((k * 7) % 500).cast("int")
    brand = F.concat(F.lit("ournal of "), F.lower("p_brand"))
    venue = F.when(k % 5 == 0, "The Lancet").when(k % 5 == 1, "Saude Publica, Cadernos").when(k % 5 == 2, F.concat(F.lit("J"), brand)).when(
        k % 5 == 3, F.concat(F.lit("{J} "), brand))
    people = F.array(F.concat(F.lit("Silva"), (k % 40).cast("string"), F.lit(" Ana")), F.lit("Other Person"))
    def rows(key, rank, title, doi):
        return base.select(key.alias("bib_key"), F.lit("s").alias("source"), F.lit(rank).alias("rank"), doi.alias("m_doi"),
                           title.alias("m_title"), people.alias("m_authors"), (1990 + k % 30 + k % 5 - 2).cast("int").alias("m_year"),
                           venue.alias("m_journal"), cited.alias("citation_count"))
    none = F.lit(None).cast("string")
    doi = F.when(k % 9 == 0, F.concat(F.lit("10.1000/"), k.cast("string")))
    return rows(F.concat(F.lit("k"), k.cast("string")), 1, altered, none).unionByName(
        rows(none, 0, title, doi).filter("m_doi is not null"))


def first_layer(spark, sf_dir):
    """The first layer of all entries; who reads it more than once has it written first."""
    return B.existence(B.match_metadata(B.normalise_entries(raw_entries(spark, sf_dir)), metadata(spark, sf_dir)))


@register("existence_layer")
def existence_layer(spark, sf_dir):
    return first_layer(spark, sf_dir).groupBy("source_type", "l1_score").agg(
        F.count("*").alias("n"), F.round(F.avg("title_similarity"), 4).alias("title_similarity"))


# A few journals and their quartiles.
JOURNALS = [("the lancet", "Q1"), ("bmj", "Q1"), ("plos one", "Q1"), ("cadernos de saude publica", "Q2"),
            ("revista de saude publica", "Q2"), ("epidemiologia e servicos de saude", "Q3")]


def journals(spark, sf_dir):
    """The listed journals, and one per brand."""
    brands = table(spark, sf_dir, "part").select(
        F.concat(F.lit("journal of "), F.lower("p_brand")).alias("name"), F.concat(F.lit("Q"), (F.substring("p_brand", -1, 1).cast("int") % 4 + 1).cast("string")).alias("quartile")).distinct()
    return small_table(spark, JOURNALS, "name string, quartile string").unionByName(brands)


def second_layer(spark, sf_dir, first):
    return B.evidence(B.journal_lookup(first, journals(spark, sf_dir), "m_journal"))


@register("journal_matches", """SELECT p_partkey AS k, CASE WHEN p_partkey % 6 < 4 THEN CONCAT('journal of ', LOWER(p_brand)) WHEN p_partkey % 6 = 4 THEN 'cadernos de saude publica' END AS known_journal,
  CASE WHEN p_partkey % 6 < 4 THEN CONCAT('Q', CAST(CAST(RIGHT(p_brand, 1) AS INT) % 4 + 1 AS VARCHAR)) WHEN p_partkey % 6 = 4 THEN 'Q2' END AS quartile,
  CASE WHEN p_partkey % 6 < 2 THEN 100.0E0 WHEN p_partkey % 6 = 2 THEN ROUND(200.0E0 * (LENGTH(p_brand) + 10) / (2 * LENGTH(p_brand) + 21), 6)
       WHEN p_partkey % 6 = 3 THEN ROUND(200.0E0 * (LENGTH(p_brand) + 11) / (2 * LENGTH(p_brand) + 23), 6) WHEN p_partkey % 6 = 4 THEN ROUND(200.0E0 * 24 / 49, 6) END AS similarity FROM part""")
def journal_matches(spark, sf_dir):
    """Names written as listed, with words moved, a letter left out or put in, and unknown ones."""
    k, brand = F.col("p_partkey"), F.lower("p_brand")
    written = (
        F.when(k % 6 == 0, F.concat(F.lit(" {Journal} of "), F.col("p_brand"))).when(k % 6 == 1, F.concat(brand, F.lit(" journal of")))
        .when(k % 6 == 2, F.concat(F.lit("jornal of "), brand)).when(k % 6 == 3, F.concat(F.lit("journal off "), brand))
        .when(k % 6 == 4, "Cadernos de Saude Pblica").otherwise(F.concat(F.lit("zq xw "), k.cast("string"))))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), written.alias("journal"))
    return B.journal_lookup(names, journals(spark, sf_dir)).select("k", "known_journal", "quartile", F.round("journal_similarity", 6).alias("similarity"))


@register("journal_layer")
def journal_layer(spark, sf_dir):
    return second_layer(spark, sf_dir, first_layer(spark, sf_dir)).groupBy("evidence_level", "l2_score").agg(F.count("*").alias("n"))


def contexts(spark, sf_dir):
    return X.citations(tex(spark, sf_dir))


def evaluations(spark, sf_dir):
    # four joins read the marks: cut the texts once
    marks = materialise(X.citation_marks(tex(spark, sf_dir)).filter("kind <> 'paragraph'").select("doc_id", "kind", "number", "body", "line_number", "sentence_no", "paragraph_no", "section"))
    abstracts = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("k"), F.col("item_id").cast("string")).alias("bib_key"), F.col("text").alias("abstract"))
    scored = X.keyword_scores(X.citations_of(marks), X.passages_of(marks), abstracts)
    return scored.select("bib_key", "score", "citations"), abstracts


_CLAIM_SQL = "CASE " + " ".join("WHEN REGEXP_MATCHES(text, '" + p.replace("(?iu)", "(?i)") + f"') THEN '{n}'" for n, p in X.CLAIMS) + " ELSE 'BACKGROUND' END"


@register("relevance_layer", LINES_SQL.split(", l AS")[0] + rf""", s AS (SELECT doc_id, UNNEST(STRING_SPLIT(text, '.')) AS text, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, '.'), 1) AS no FROM tex),
c AS (SELECT DISTINCT doc_id, no, TRIM(UNNEST(STRING_SPLIT(keys, ','))) AS bib_key FROM (SELECT doc_id, no, UNNEST(REGEXP_EXTRACT_ALL(text, '\\cite[a-zA-Z]*\{{([^}}]+)\}}', 1)) AS keys FROM s) t),
w AS (SELECT doc_id, no, {_WORDS.format(t='text')} AS w, {_CLAIM_SQL} IN ('BACKGROUND', 'TOOL', 'DATA_SOURCE') AS lenient FROM s),
a AS (SELECT CONCAT('k', CAST(item_id AS VARCHAR)) AS bib_key, text, {_WORDS.format(t='text')} AS w FROM benchmark),
o AS (SELECT c.bib_key, lenient, CAST(LEN(LIST_INTERSECT(w.w, a.w)) AS DOUBLE) / NULLIF(LEN(w.w), 0) AS share FROM c JOIN w USING (doc_id, no) JOIN a ON a.bib_key = c.bib_key),
r AS (SELECT bib_key, MIN(CASE WHEN share >= CASE WHEN lenient THEN 0.25 ELSE 0.35 END THEN 9 WHEN share >= CASE WHEN lenient THEN 0.15 ELSE 0.20 END THEN {B.WORST['L3_WARN_PARTIAL']} ELSE {B.WORST['L3_WARN_INCONCLUSIVE']} END) AS worst FROM o GROUP BY 1),
e AS (SELECT CONCAT('k', CAST(p_partkey AS VARCHAR)) AS bib_key FROM part)
SELECT CASE WHEN r.worst IS NULL OR COALESCE(LENGTH(a.text), 0) = 0 THEN 'L3_NA' WHEN r.worst = 9 THEN 'L3_PASS' WHEN r.worst = {B.WORST['L3_WARN_PARTIAL']} THEN 'L3_WARN_PARTIAL' ELSE 'L3_WARN_INCONCLUSIVE' END AS l3_score,
  COALESCE(LENGTH(a.text), 0) > 0 AS abstract_available, COUNT(*) AS n FROM e LEFT JOIN r USING (bib_key) LEFT JOIN a USING (bib_key) GROUP BY 1, 2""")
def relevance_layer(spark, sf_dir):
    entries = B.normalise_entries(raw_entries(spark, sf_dir))
    return B.worst_case(entries, *evaluations(spark, sf_dir)).groupBy("l3_score", "abstract_available").agg(F.count("*").alias("n"))


@register("audit_flags")
def audit_flags(spark, sf_dir):
    entries = B.normalise_entries(raw_entries(spark, sf_dir))
    first = materialise(first_layer(spark, sf_dir).select("bib_key", "citation_count", "m_doi"))
    return B.flags(entries, contexts(spark, sf_dir), first, ["silva1,"]).groupBy(
        "flag_type", "severity").agg(F.count("*").alias("n"))


@register("undefined_and_uncited", f"""WITH {TEX_SQL}, c AS (SELECT DISTINCT k FROM (SELECT CONCAT('k', CAST(doc_id % 50 AS VARCHAR)) AS k, text FROM tex UNION ALL
  SELECT CONCAT('k', CAST(doc_id % 31 AS VARCHAR)), text FROM tex) t WHERE POSITION('cite' IN text) > 0 AND REGEXP_MATCHES(text, '.cite[{{]k')),
b AS (SELECT CONCAT('k', CAST(p_partkey AS VARCHAR)) AS k FROM part WHERE p_partkey >= 20)
SELECT k AS bib_key, 'undefined' AS kind FROM c WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'uncited' FROM b WHERE k NOT IN (SELECT k FROM c)""")
def undefined_and_uncited(spark, sf_dir):
    cited = contexts(spark, sf_dir).select("bib_key").distinct()
    defined = table(spark, sf_dir, "part").filter("p_partkey >= 20").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("bib_key"))
    lost = cited.join(defined, "bib_key", "left_anti").withColumn("kind", F.lit("undefined"))
    return lost.unionByName(defined.join(cited, "bib_key", "left_anti").withColumn("kind", F.lit("uncited")))


@register("reference_audit")
def reference_audit(spark, sf_dir):
    """All layers combined, with hand-verified entries lifted, as shares per status."""
    entries = B.normalise_entries(raw_entries(spark, sf_dir))
    first = materialise(first_layer(spark, sf_dir).select("bib_key", "source_type", "l1_score", "m_doi", "m_journal", "citation_count"))
    second = second_layer(spark, sf_dir, first).select("bib_key", "l2_score", "evidence_level")
    third = B.worst_case(entries, *evaluations(spark, sf_dir))
    found = B.flags(entries, contexts(spark, sf_dir), first)
    verified = entries.filter("year = 2010").select("bib_key", F.lit("VERIFIED_OK").alias("status"))
    return B.score_shares(B.apply_verified(B.composite(first, second, third, found), verified))
