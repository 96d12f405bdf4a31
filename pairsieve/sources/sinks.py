"""Sinks: tables, requests, splits, probabilities, reports and manifests.

All writers are distributed; only results that are small by nature (one row, or one row per
model) are brought to one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from pairsieve.functions.values import ref
from pairsieve.operators.ranking import rank_by_hash  # noqa: F401


def decimal_comma_text(df: DataFrame) -> DataFrame:
    """Doubles as text with a decimal comma."""
    reals = [f.name for f in df.schema.fields if isinstance(f.dataType, T.FractionalType)]
    return df.withColumns({n: F.regexp_replace(ref(n).cast("string"), r"\.", ",") for n in reals}) if reals else df


def write_csv(df: DataFrame, path: str, sep: str = ";", decimal: str = ".", mode: str = "overwrite") -> None:
    out = decimal_comma_text(df) if decimal == "," else df
    out.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_requests(requests: DataFrame, path: str) -> None:
    """One JSON line per review request."""
    requests.select("value").write.mode("overwrite").text(path)


def write_split(df: DataFrame, path: str, key: str, split: str = "split") -> None:
    df.select(ref(key).alias("row_index"), ref(split).alias("split")).write.mode("overwrite").option(
        "header", True).csv(path)


def write_probabilities(df: DataFrame, path: str, key: str, label: str, probability: str, model: str) -> None:
    """``row_index, y_true, proba`` of one model, in its own folder of a partitioned table."""
    df.select(ref(key).alias("row_index"), ref(label).alias("y_true"), ref(probability).alias("proba"),
              F.lit(model).alias("model")).write.mode("append").partitionBy("model").parquet(path)


def write_fairness(path: str, **tables: DataFrame) -> None:
    """Frame, group metrics, tests and band stability, each in its own folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def manifest(df: DataFrame, parameters: dict[str, str]) -> DataFrame:
    """One row: how many rows a run had, and its parameters."""
    pairs = [x for k, v in sorted(parameters.items()) for x in (F.lit(k), F.lit(str(v)))]
    return df.agg(F.count("*").alias("rows")).withColumn(
        "parameters", F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>"))


def write_manifest(df: DataFrame, parameters: dict[str, str], path: str) -> None:
    manifest(df, parameters).coalesce(1).write.mode("overwrite").json(path)


def sample_metadata(sample: DataFrame, band: str = "band", target: str = "TARGET") -> DataFrame:
    """Band and target distribution of a drawn sample."""
    def counts(column: str, kind: str) -> DataFrame:
        return sample.groupBy(F.lit(kind).alias("kind"), ref(column).cast("string").alias("name")).agg(
            F.count("*").alias("n"))

    return counts(band, "band").unionByName(counts(target, "target"))


def result_bundle(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Several result tables as one document, each sorted by its metric from the best down.

    For tables with one row per model or configuration.
    """
    out = None
    for name, (df, metric) in tables.items():
        row: Column = F.struct((-ref(metric)).alias("_o"), F.struct(*[ref(c) for c in df.columns]).alias("r"))
        ordered = F.transform(F.sort_array(F.collect_list(row)), lambda x: x["r"])
        part = df.agg(F.to_json(ordered).alias("records")).select(F.lit(name).alias("section"), "records")
        out = part if out is None else out.unionByName(part)
    return out


# The columns of the audit report.
REPORT_COLUMNS = [
    "bib_key", "title", "year", "doi", "source_type", "journal", "composite_score", "l1_score", "l1_title_sim",
    "l1_year_match", "l1_author_match", "l1_citation_count", "l1_retracted", "l2_score", "l2_journal", "l2_quartile",
    "l2_evidence", "l2_predatory", "l3_score", "l3_abstract_available", "l3_evaluations_count", "flags_count", "flag_types",
]


def audit_report(rows: DataFrame) -> DataFrame:
    """The 23 report columns; flags joined by ``"; "`` and absent parts left empty."""
    source = {
        "composite_score": "composite", "l1_year_match": "year_match", "l1_author_match": "author_match",
        "l1_citation_count": "citation_count", "l2_journal": "m_journal", "l2_quartile": "quartile",
        "l2_evidence": "evidence_level", "l3_abstract_available": "abstract_available",
        "l3_evaluations_count": "evaluations",
    }
    made = {
        "l1_title_sim": F.format_string("%.0f", "title_similarity"), "l1_retracted": F.lit("False"),
        "l2_predatory": F.lit(""), "flags_count": F.size("flag_types").cast("string"),
        "flag_types": F.array_join("flag_types", "; "),
    }
    cells = []
    for name in REPORT_COLUMNS:
        if name in made:
            cells.append(made[name].alias(name))
        else:
            column = source.get(name, name)
            value = ref(column).cast("string") if column in rows.columns else F.lit("")
            cells.append(F.coalesce(value, F.lit("")).alias(name))
    return rows.select(*cells)
