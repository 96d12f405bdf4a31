"""Registered queries: budgets per window."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairsieve.plans.queries_triage import SETTINGS, ready
from pairsieve.plans.registry import register
from pairsieve.plans.views import GUARD_SQL, triage_sql
from pairsieve.session import small_table
from pairsieve.streaming.windows import look_back, triage_by_window


@register("window_budgets", f"""WITH {GUARD_SQL}, windowed AS (SELECT l.*, EXTRACT(YEAR FROM r_dtobito) AS yr FROM labelled l),
{triage_sql('windowed', by='yr', budget=0)},
acted AS (SELECT *, CASE WHEN review_rank <= 2000 - CASE WHEN yr = 1996 THEN 1950 ELSE 0 END THEN 1 ELSE 0 END AS reviewed FROM picked)
SELECT CAST(yr AS INT) AS yr, COUNT(*) AS n_rows, CAST(SUM(reviewed) AS BIGINT) AS reviewed, CAST(SUM(reviewed * k) AS BIGINT) AS key_sum FROM acted GROUP BY yr""")
def window_budgets(spark, sf_dir):
    rows = ready(spark, sf_dir).withColumn("yr", F.year("R_DTOBITO"))
    ledger = small_table(spark, [("vigilancia", "1996", 1950, 0)], "mode string, window string, used bigint, batch bigint")
    out = triage_by_window(rows, SETTINGS, "vigilancia", "k", "yr", ledger)
    hit = F.col("action") == "LLM_REVIEW"
    return out.groupBy("yr").agg(F.count("*").alias("n_rows"), F.sum(hit.cast("bigint")).alias("reviewed"),
                                 F.sum(F.when(hit, F.col("k")).otherwise(0)).alias("key_sum"))


@register("look_back_rows", f"""WITH {GUARD_SQL} SELECT band, COUNT(*) AS n FROM labelled
WHERE r_dtobito > DATE '1997-06-30' - 28 AND r_dtobito <= DATE '1997-06-30' GROUP BY band""")
def look_back_rows(spark, sf_dir):
    return look_back(ready(spark, sf_dir), "R_DTOBITO", "1997-06-30").groupBy("band").agg(F.count("*").alias("n"))
