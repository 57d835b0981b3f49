"""Readers and writers."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CODEBOOK = "section string, variable string, label string, question string, options array<string>"
EXAMPLES = "input string, output string"


def read_text_document(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole text files; lines keep their order inside the text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """Codebook lines with line_no: the first line of a variable is English, the last of the others French."""
    lines = read_text_document(spark, path).select(F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    return lines.select(F.col("line_no").cast("bigint").alias("line_no"), F.from_json("line", CODEBOOK).alias("x")).select("line_no", "x.*")


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """variable_name, label, domain from one JSON object of objects."""
    text = spark.read.text(path, wholetext=True)
    found = F.from_json("value", "map<string,struct<label:string,domain:string>>")
    return text.select(F.explode(found).alias("variable_name", "x")).select("variable_name", "x.label", "x.domain")


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """input, output of a JSON lines corpus."""
    return spark.read.schema(EXAMPLES).json(path)


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an append-only JSON lines checkpoint; a missing folder is empty, blank lines are skipped."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(hadoop).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    """Add rows to a checkpoint."""
    df.write.mode("append").json(path)


def write_table(df: DataFrame, path: str, force: bool = False) -> None:
    """Write by suffix, .csv or .parquet; an existing output is an error unless forced.

    Lists become texts joined by ` | ` in CSV.
    """
    mode = "overwrite" if force else "errorifexists"
    if path.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    elif path.endswith(".csv"):
        flat = [F.array_join(F.col(c), " | ").alias(c) if t.startswith("array<") else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported suffix: {path}")


def write_examples(df: DataFrame, path: str, force: bool = False) -> None:
    """Write JSON lines, with non-ASCII characters as they are."""
    df.write.mode("overwrite" if force else "errorifexists").json(path)


def write_domains(df: DataFrame, path: str) -> None:
    """Write variable_name, label, domain as one indented JSON object, entry by entry, to any file system."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        lead = "{"
        for r in df.select("variable_name", "label", "domain").orderBy("variable_name").toLocalIterator():
            entry = json.dumps({"label": r["label"], "domain": r["domain"]}, ensure_ascii=False, indent=4).replace("\n", "\n    ")
            out.write(bytearray(f"{lead}\n    {json.dumps(r['variable_name'], ensure_ascii=False)}: {entry}".encode()))
            lead = ","
        out.write(bytearray(("{}" if lead == "{" else "\n}").encode()))
    finally:
        out.close()


def guard_column(df: DataFrame, column: str, force: bool = False) -> DataFrame:
    """df without the column that is to be computed anew; raises if it is there and not forced."""
    if column in df.columns and not force:
        raise ValueError(f"column {column} exists")
    return df.drop(column)


class StataPartition(InputPartition):
    def __init__(self, path: str, skip: int, rows: int):
        self.path, self.skip, self.rows = path, skip, rows


class StataSource(DataSource):
    """spark.read.format("stata").load(path): a Stata file with its codes, in chunks of rows.

    With option table = value_labels or variable_labels the file's label tables come instead.
    """

    @classmethod
    def name(cls) -> str:
        return "stata"

    def _reader(self):
        from pandas.io.stata import StataReader

        return StataReader(self.options["path"], convert_categoricals=False)

    def schema(self) -> str:
        table = self.options.get("table", "data")
        if table == "value_labels":
            return "variable string, code double, label string"
        if table == "variable_labels":
            return "variable_name string, label string"
        with self._reader() as r:
            first = r.read(nrows=1)
        kind = {"O": "string"}
        return ", ".join(f"`{c}` {kind.get(first[c].dtype.kind, 'double')}" for c in first.columns)

    def reader(self, schema) -> DataSourceReader:
        return StataReaderTask(self.options["path"], self.options.get("table", "data"), int(self.options.get("chunk", 50_000)), schema)


class StataReaderTask(DataSourceReader):
    def __init__(self, path: str, table: str, chunk: int, schema):
        self.path, self.table, self.chunk, self.names = path, table, chunk, schema.names

    def partitions(self) -> list[InputPartition]:
        from pandas.io.stata import StataReader

        if self.table != "data":
            return [StataPartition(self.path, 0, 0)]
        with StataReader(self.path) as r:
            r._ensure_open()
            n = r._nobs
        return [StataPartition(self.path, at, min(self.chunk, n - at)) for at in range(0, max(n, 1), self.chunk)]

    def read(self, part: StataPartition) -> Iterator[tuple]:
        from pandas.io.stata import StataReader

        with StataReader(part.path, convert_categoricals=False) as r:
            if self.table == "variable_labels":
                yield from r.variable_labels().items()
            elif self.table == "value_labels":
                for variable, labels in r.value_labels().items():
                    for code, label in labels.items():
                        yield variable, float(code), label
            elif part.rows:
                r.read(nrows=part.skip) if part.skip else None
                for row in r.read(nrows=part.rows)[self.names].itertuples(index=False):
                    yield tuple(None if x is None or x != x else x if isinstance(x, str) else float(x) for x in row)


def read_stata(spark: SparkSession, path: str, table: str = "data") -> DataFrame:
    """A Stata file, or its label tables."""
    spark.dataSource.register(StataSource)
    return spark.read.format("stata").option("path", os.fspath(path)).option("table", table).load()
