"""Files in and out: corpus lines, structured rows, raw files, summaries and journals."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from spanwise.functions.text import file_split, looks_like_summary, normalize_line, strip
from spanwise.operators.corpus import SUMMARY_FIELDS, extractor, is_special_file
from spanwise.operators.records import item_id

# Columns of a corpus row, and patterns of columns that hold summaries.
CORPUS_COLUMNS = ("item_id", "xsum_id", "split", "source", "source_detail", "source_sha256", "source_query", "source_repo", "document", "summary_ref")
LINE_COLUMNS = ("summary_ref", "summary", "target", "highlights", "output", "prediction")
# Rows read of a table, values taken of a column, values that tell whether it is liked, words of a short one, and short ones that are too many.
MOST_ROWS, MOST_VALUES, PROBED, SHORT_WORDS, MOST_SHORT = 2000, 500, 200, 8, 150
SUMMARY_PATTERNS = ("summary", "summ", "prediction", "pred", "generated", "generation", "output", "decoded", "hyp", "hypothesis", "model", "candidate")


def corpus_lines(spark: SparkSession, path: str, column: str | None = None, most: int | None = None) -> DataFrame:
    """(line): the text column of a CSV or TSV file, or every line of a text file; blank lines are dropped."""
    if path.lower().endswith((".csv", ".tsv")):
        df = spark.read.option("header", True).option("sep", "\t" if path.lower().endswith(".tsv") else ",").option("mode", "DROPMALFORMED").option("multiLine", True).option("escape", '"').csv(path)
        name = next((c for c in (column, *LINE_COLUMNS) if c in df.columns), df.columns[0])
        df = df.select(strip(F.col(name)).alias("line"))
    else:
        df = spark.read.text(path).select(strip(F.col("value")).alias("line"))
    df = df.where("line <> ''")
    return df if most is None else df.limit(most)


def structured_rows(spark: SparkSession, path: str, columns: Sequence[str] = CORPUS_COLUMNS) -> DataFrame:
    """A CSV with fixed columns in their order: those that it lacks are null, others are left out; a missing file has no rows."""
    schema = ", ".join(f"{c} string" for c in columns)
    try:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return df.select(*[F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, length) of all files below a folder; members of zip archives as files of their own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content", "length")

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        inner = [(f"{name}!{i.filename}", z.read(i), i.file_size) for i in z.infolist() if not i.is_dir()]
                except zipfile.BadZipFile:
                    continue
                if inner:
                    yield pd.DataFrame(inner, columns=["path", "content", "length"])

    zipped = F.lower("path").endswith(".zip")
    return files.where(~zipped).unionByName(files.where(zipped).mapInPandas(members, "path string, content binary, length long"))


def cells(files: DataFrame, require: Sequence[str] = (), max_rows: int = MOST_ROWS) -> DataFrame:
    """(path, kind, name, place, value, error) of every value of raw files, read as their names ask: a table's cells, a record's fields, a text's lines.

    Tables without a suffix of their own are split at tabs where these outnumber commas. A table that can't be parsed is read as text. What can't be
    read at all is a row with an error.
    """
    import json

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for path, kind, content in zip(pdf["path"], pdf["kind"], pdf["content"], strict=True):
                raw = bytes(content or b"")
                text = raw.decode("utf-8", errors="ignore")
                if kind == "jsonl":
                    for k, line in enumerate(text.splitlines()):
                        try:
                            record = json.loads(line) if line.strip().startswith("{") else None
                        except ValueError as e:
                            out.append((path, kind, None, k, None, str(e)[:200]))
                            continue
                        if isinstance(record, dict) and all(x in record for x in require):
                            out += [(path, kind, f, k, str(record[f]), None) for f in SUMMARY_FIELDS if isinstance(record.get(f), (str, int, float))]
                    continue
                if kind == "tabular":
                    head = text[:4096]
                    named = path.lower().endswith((".csv", ".tsv"))
                    tabs = path.lower().endswith(".tsv") or (not named and head.count("\t") > head.count(","))
                    try:
                        rows = pd.read_csv(io.StringIO(text), sep="\t" if tabs else ",", nrows=max_rows, dtype=str, on_bad_lines="skip", engine="python")
                        for name in rows.columns:
                            out += [(path, kind, str(name), k, v, None) for k, v in enumerate(rows[name].dropna())]
                        continue
                    except Exception as e:  # noqa: BLE001 - a table that can't be parsed is read as text
                        out.append((path, "text", None, -1, None, f"no table: {e}"[:200]))
                out += [(path, "text", None, k, line, None) for k, line in enumerate(text.splitlines())]
            yield pd.DataFrame(out, columns=["path", "kind", "name", "place", "value", "error"])

    kinds = files.select("path", extractor(F.col("path")).alias("kind"), "content").where("kind <> 'structured'")
    return kinds.mapInPandas(read, "path string, kind string, name string, place long, value string, error string")


def liked_cells(found: DataFrame, max_values: int = MOST_VALUES) -> DataFrame:
    """The cells of tables' columns whose names ask for summaries, or else of those whose values aren't mostly short; all others as they are."""
    words = F.size(F.regexp_extract_all(F.lower("value"), F.lit("[a-z0-9]+"), F.lit(0)))
    by_name = F.coalesce(F.exists(F.array(*map(F.lit, SUMMARY_PATTERNS)), lambda p: F.lower(F.col("name")).contains(p)), F.lit(False))
    table = found.where("kind = 'tabular'")
    columns = table.groupBy("path", "name").agg(F.count_if((F.col("place") < PROBED) & (words < SHORT_WORDS)).alias("short"), F.max(by_name).alias("liked"))
    any_liked = columns.groupBy("path").agg(F.max("liked").alias("any"))
    kept = columns.join(any_liked, "path").where(F.when(F.col("any"), F.col("liked")).otherwise(F.col("short") <= MOST_SHORT)).select("path", "name")
    return table.where(F.col("place") < max_values).join(kept, ["path", "name"], "left_semi").unionByName(found.where("kind <> 'tabular'"))


def extract(files: DataFrame, require: Sequence[str] = (), max_rows: int = MOST_ROWS, max_values: int = MOST_VALUES) -> DataFrame:
    """(path, line): the distinct summary-like lines of raw files."""
    values = liked_cells(cells(files, require, max_rows), max_values).where("error is null")
    return values.select("path", normalize_line(F.col("value")).alias("line")).where(looks_like_summary(F.col("line"))).distinct()


def extract_counts(files: DataFrame, require: Sequence[str] = ()) -> DataFrame:
    """(path, kind, n_values, n_kept, n_errors) of each file's reading."""
    found = cells(files, require)
    kept = liked_cells(found).where("error is null").select("path", normalize_line(F.col("value")).alias("line")).where(looks_like_summary(F.col("line"))).groupBy("path").agg(F.count_distinct("line").alias("n_kept"))
    read = found.groupBy("path").agg(F.min("kind").alias("kind"), F.count("value").alias("n_values"), F.count("error").alias("n_errors"))
    return read.join(kept, "path", "left").select("path", "kind", "n_values", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "n_errors")


def structured_files(files: DataFrame, source: str) -> DataFrame:
    """(item_id, xsum_id, split, source, source_detail, source_sha256, document, summary_ref, error) of files of documents, summaries and ids.

    Such a file is known by its name or its header; its columns go by name without case. A file that lacks a document or summary column, or can't
    be parsed, is one row with an error.
    """
    import csv

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = pd.read_csv(io.BytesIO(bytes(content or b"")), dtype=str, engine="python", quoting=csv.QUOTE_MINIMAL)
                except Exception as e:  # noqa: BLE001 - the file's error is its row
                    out.append((path, None, None, None, f"parse_failed: {e}"[:200]))
                    continue
                names = {str(c).lower(): c for c in rows.columns}
                if "document" not in names or "summary" not in names:
                    out.append((path, None, None, None, "missing_required_columns"))
                    continue
                get = lambda c: rows[names[c]].where(rows[names[c]].notna(), None) if c in names else [None] * len(rows)  # noqa: E731, B023
                out += [(path, d, s, i, None) for d, s, i in zip(get("document"), get("summary"), get("id"), strict=True)]
            yield pd.DataFrame(out, columns=["path", "document", "summary", "id", "error"])

    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    special = files.where(is_special_file(F.col("path"), head))
    found = special.select("path", "content").mapInPandas(read, "path string, document string, summary string, id string, error string")
    hashes = special.select("path", F.sha2("content", 256).alias("source_sha256"))
    rows = found.select("*", F.explode(F.array(normalize_line(F.col("summary")))).alias("line")).where("error is not null or line <> ''").join(hashes, "path")
    return rows.select(
        item_id(F.lit(source), F.col("path")).alias("item_id"), strip(F.col("id")).alias("xsum_id"), file_split(F.col("path")).alias("split"), F.lit(source).alias("source"),
        F.col("path").alias("source_detail"), "source_sha256", strip(F.col("document")).alias("document"), F.col("line").alias("summary_ref"), "error",
    )


def verified(files: DataFrame, manifest: DataFrame, kinds: Sequence[str] = ("github_download_ok", "kaggle_download_ok")) -> DataFrame:
    """Files whose content has the hash of a download in the manifest, with the first such event."""
    first = manifest.where(F.col("type").isin(*kinds) & F.col("sha256").isNotNull()).groupBy(F.lower("sha256").alias("sha256")).agg(F.min(F.struct("ts", "event_id")).alias("e"))
    return files.withColumn("sha256", F.sha2("content", 256)).join(first, "sha256").select("*", F.col("e.event_id").alias("event_id")).drop("e")


def artefact_counts(spark: SparkSession, path: str) -> DataFrame:
    """(category, n, bytes) of the files below a folder."""
    return artefacts(spark, path).groupBy("category").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def stage_summaries(spark: SparkSession, pattern: str, schema: str, key: str = "model_id") -> DataFrame:
    """JSON summaries of all files that match a pattern, with their path; a summary without its key is an error."""
    df = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("summary_path", F.col("_metadata.file_path"))
    message = F.concat("summary_path", F.lit(f" has no {key}"))
    return df.withColumn(key, F.when(F.coalesce(F.trim(key), F.lit("")) != "", F.trim(key)).otherwise(F.raise_error(message).cast("string")))


def artefacts(spark: SparkSession, path: str) -> DataFrame:
    """(path, category, size) of every file below a folder; the category is its topmost folder. Contents aren't read."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    relative = F.substring_index("path", f"{root}/", -1)
    return files.select(relative.alias("path"), F.when(relative.contains("/"), F.substring_index(relative, "/", 1)).otherwise("other").alias("category"), F.col("length").alias("size"))


def summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON summaries of a stage; a missing file has no rows."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_rows(df: DataFrame, path: str, by: Sequence[str] = ("model_id",)) -> None:
    """Run tables as parquet, one folder a model; a run replaces the folders it writes."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def unscored(items: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Items that a stored run lacks, for a run to resume with."""
    return items.join(done.select(*key), list(key), "left_anti")
