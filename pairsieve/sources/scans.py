"""Scans of comparator exports, review answers, metadata and text."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from pairsieve import columns as C
from pairsieve.functions.values import ref
from pairsieve.operators.features import pair_features

# Texts read as missing.
MISSING = ["", "NA", "N/A", "null", "None", "NaN", "nan", "NULL", "<NA>", "n/a"]
# Text columns of the export that must never be read as numbers.
TEXT_COLUMNS = {"R_SEXO", "C_SEXO", "R_BAIRES", "C_BAIRES", C.LEFT, C.RIGHT}


def resolve_column(columns: list[str], wanted: str, strict: bool = False) -> str | None:
    """The exact name, else the one column named ``wanted,<type suffix>``."""
    if wanted in columns:
        return wanted
    found = [c for c in columns if c.startswith(wanted + ",")]
    if len(found) == 1:
        return found[0]
    if strict:
        raise KeyError(f"{'ambiguous' if found else 'missing'} column {wanted}: {found}")
    return None


def canonical_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Add each wanted name as a copy of its typed header, when there is exactly one."""
    for name in wanted:
        source = resolve_column(df.columns, name)
        if source is not None and source != name:
            df = df.withColumn(name, ref(source))
    return df


def strip_header_types(df: DataFrame) -> DataFrame:
    """``COMPREC,C,12,0`` becomes ``COMPREC``."""
    return df.toDF(*[c.split(",")[0] for c in df.columns])


def tidy_name(name: str) -> str:
    """Trim, spaces to underscores, runs of underscores to one."""
    name = name.strip().replace(" ", "_")
    while "__" in name:
        name = name.replace("__", "_")
    return name


def add_tidy_aliases(df: DataFrame) -> DataFrame:
    """Add an underscore alias for every column whose tidy name is still free."""
    aliases = {}
    for name in df.columns:
        tidy = tidy_name(name)
        if tidy != name and tidy not in df.columns and tidy not in aliases:
            aliases[tidy] = ref(name)
    return df.withColumns(aliases) if aliases else df


def read_text_table(
    spark: SparkSession, path: str, encoding: str | None = None
) -> DataFrame:
    """A semicolon-separated export with every column as text and missing marks as NULL.

    One scan of lines.  Without a given encoding each line is read as UTF-8 where it is valid and
    as Latin-1 where it is not, so files of either kind can be mixed.  The header is the first
    line; files that repeat it are fine, records that span lines are not.
    """
    value = F.col("value")
    if encoding is None:
        line = F.when(F.is_valid_utf8(value), value).otherwise(F.decode(value.cast("binary"), "ISO-8859-1"))
    else:
        line = F.decode(value.cast("binary"), encoding)
    lines = spark.read.text(path).select(F.rtrim(F.regexp_replace(line, "^\ufeff|\r$", "")).alias("line"))
    first = lines.first()
    header = first["line"] if first else ""
    names = next(csv.reader([header], delimiter=";"), [])
    rows = lines.filter((F.col("line") != header) & (F.col("line") != "")).select(
        F.from_csv("line", _ddl(names), {"sep": ";"}).alias("r"))
    return rows.select(*[_present("r", n).alias(n) for n in names])


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` STRING" for n in names)


def _present(record: str, name: str):
    value = F.col(record).getField(name)
    return F.when(~F.trim(value).isin(*MISSING), value)


def numbers_from_text(df: DataFrame, names: list[str]) -> DataFrame:
    """Decimal-comma text to double for the listed columns."""
    comma = {n: F.regexp_replace(F.trim(ref(n)), ",", ".").try_cast("double") for n in names}
    return df.withColumns(comma) if comma else df


def read_pairs(
    spark: SparkSession, path: str, encoding: str | None = None, birth_distance: bool = True
) -> DataFrame:
    """The comparator export with canonical names, numeric scores and triage features."""
    raw = canonical_columns(read_text_table(spark, path, encoding), C.PREFIXED)
    numeric = [
        n for n in raw.columns
        if n in C.ALL_SCORES or n in (C.STEP, C.LABEL, C.OUTCOME, C.NAME_BOTH, C.MOTHER_BOTH)
        or n in C.BIRTH_PARTS
    ]
    return pair_features(numbers_from_text(raw, numeric), birth_distance)


def read_model_table(
    spark: SparkSession, path: str, encoding: str | None = None, required: bool = False
) -> DataFrame:
    """The same export for modelling: header types stripped, numbers parsed, text kept."""
    raw = strip_header_types(read_text_table(spark, path, encoding))
    numeric = [n for n in raw.columns if n not in TEXT_COLUMNS]
    table = numbers_from_text(raw, numeric)
    if not required:
        return table
    needed = [C.LABEL, C.STEP, *C.ALL_SCORES]
    lost = [n for n in needed if n not in table.columns]
    if lost:
        raise ValueError(f"missing required columns: {lost}")
    out = table.select(*[ref(n) for n in needed])
    return out.withColumns({
        C.LABEL: F.coalesce(ref(C.LABEL), F.lit(0.0)).cast("int"),
        C.STEP: F.coalesce(ref(C.STEP), F.lit(-1.0)).cast("int"),
    })


RESULT_SCHEMA = "pair_id string, agent string, attempt int, raw string, latency_s double, " \
                "tokens_prompt bigint, tokens_completion bigint"


def read_review_results(spark: SparkSession, path: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    """Past review results; an empty table when nothing has been written yet."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as problem:  # the folder does not exist on a first run
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


def not_yet_done(requests: DataFrame, done: DataFrame, key: str | list[str] = "pair_id") -> DataFrame:
    """Requests without a past result."""
    keys = [key] if isinstance(key, str) else key
    return requests.join(done.select(*keys).distinct(), keys, "left_anti")


METADATA_SCHEMA = (
    "source string, bib_key string, rank int, title array<string>, "
    "author array<struct<family:string,given:string>>, "
    "issued struct<`date-parts`:array<array<int>>>, `container-title` array<string>, "
    "DOI string, abstract string, abstract_inverted_index map<string,array<int>>"
)


def read_metadata(spark: SparkSession, path: str, schema: str = METADATA_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file, with its path."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text")
    )
