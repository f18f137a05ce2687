"""File sources and sinks: JSON lines, CSV with a byte-order mark, word lists, filing indexes, partitioned outputs."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from signalpanel.session import ensure_checkpoint_dir

CORRUPT = "_corrupt_record"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, which every executor reaches."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine): lines that don't parse go to the quarantine as text; blank lines are skipped."""
    full = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = StructType([*full.fields, *StructType.fromDDL(f"{CORRUPT} string").fields])
    lines = spark.read.text(path).where(F.trim("value") != "")
    df = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    return df.where(F.col(f"r.{CORRUPT}").isNull()).select(*[F.col(f"r.`{c}`") for c in full.fieldNames()]), df.where(F.col(f"r.{CORRUPT}").isNotNull()).select(F.col(f"r.{CORRUPT}"))


def read_csv(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = False) -> DataFrame:
    """CSV with a header, by position of the schema; a byte-order mark before the first header name is no part of it. Empty texts are null.

    With ``missing_ok`` an absent path gives no rows.
    """
    if missing_ok and not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("nullValue", "").option("emptyValue", "").csv(path)


def word_list(spark: SparkSession, path: str | None, fallback: dict[str, str]) -> DataFrame:
    """(category, term) of a CSV with these columns, terms in lower case, each once; the words of ``fallback`` (by category, in one text) where no path is given or none is there.

    A file with a header alone is an empty list, not a missing one. Spark reads the file anew for each query; cache the result to keep it.
    """
    if path is None or not path_exists(spark, path):
        return spark.createDataFrame([(c, w) for c, ws in fallback.items() for w in dict.fromkeys(ws.lower().split())], "category string, term string")
    words = read_csv(spark, path, "category string, term string")
    return words.select(F.trim("category").alias("category"), F.lower(F.trim("term")).alias("term")).where("category <> '' and term <> ''").distinct()


def flag_dictionary(wide: DataFrame, word: str, categories: list[str]) -> DataFrame:
    """(category, term) of a word x category table: a flag that is neither empty nor ``0`` includes the word."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in categories)
    long = wide.select(F.lower(F.trim(word)).alias("term"), F.expr(f"stack({len(categories)}, {pairs}) as (category, flag)"))
    return long.where("flag is not null and trim(flag) not in ('', '0') and term <> ''").select("category", "term").distinct()


def zip_columns(df: DataFrame, struct: str, arrays: list[str]) -> DataFrame:
    """One row for each position of parallel arrays in a struct column (columnar JSON)."""
    return df.select("*", F.inline(F.arrays_zip(*[F.col(f"{struct}.{a}").alias(a) for a in arrays]))).drop(struct)


def safe_name(c: Column | str) -> Column:
    """Characters that are unsafe in a path become one underscore a run."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[^A-Za-z0-9_.-]+", "_")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> str:
    """Distributed sink: parquet, json, csv (with header, also when there are no rows) or orc."""
    w = df.write.mode(mode).format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).options(**({"header": "true"} if fmt == "csv" else {})).save(path)
    return path


def small_json(df: DataFrame, limit: int = 10_000) -> str:
    """JSON array of a small result; more than ``limit`` rows are refused rather than cut."""
    rows = df.toJSON().take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; use write_table")
    return json.dumps([json.loads(r) for r in rows], sort_keys=True)


def markdown_table(df: DataFrame, limit: int = 1_000) -> str:
    """Markdown of a small result; more than ``limit`` rows are refused rather than cut."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; use write_table")
    line = lambda cells: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


class Providers:
    """Registry of DataFrame factories by provider name."""

    def __init__(self, default: str):
        self.default, self.factories = default, {}

    def register(self, name: str, factory: Callable[..., dict[str, DataFrame]]) -> None:
        self.factories[name] = factory

    def load(self, name: str | None = None, **options) -> dict[str, DataFrame]:
        """The provider's bundle of tables; unknown names are refused with the known ones."""
        key = name or self.default
        if key not in self.factories:
            raise KeyError(f"no provider {key!r}; known: {', '.join(sorted(self.factories))}")
        return self.factories[key](**options)


def load_config(text: str, allowed: dict[str, type]) -> dict:
    """A YAML mapping with exactly the allowed keys and types; unknown keys and wrong types are refused."""
    import yaml

    data = yaml.safe_load(text) or {}
    unknown = sorted(set(data) - set(allowed))
    wrong = sorted(k for k, v in data.items() if k in allowed and not isinstance(v, allowed[k]))
    if unknown or wrong:
        raise ValueError(f"unknown keys {unknown}, wrong types {wrong}")
    return data
