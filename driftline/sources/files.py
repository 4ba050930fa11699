"""Series from CSV and NPY files, results to and from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import InputOutput, InvalidInput

SCHEMA_VERSIONS = (1, 2)


#: A number as the cells of a file are written; "inf" and "nan" are numbers too.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """_file, t and value of the lines of text files that are not blank, numbered within their file.

    Files are read in splits. A split's lines are consecutive in its task, so that their ids less the first one are their places
    in the split; the lines of earlier splits, one row a split, are added.
    """
    own = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"))
    lines = own.where("value != ''").withColumn("_id", F.monotonically_increasing_id())
    sizes = lines.groupBy("_file", "_split").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    earlier = F.coalesce(F.sum("_lines").over(W.partitionBy("_file").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_file", "_split", (earlier - F.col("_first")).alias("_shift"))
    return lines.join(starts, ["_file", "_split"]).select("_file", (F.col("_id") + F.col("_shift")).alias("t"), "value")


def read_csv(spark: SparkSession, path: str, series_id: str | None = None) -> DataFrame:
    """Numeric rows, one series per file: series_id (the path unless given), t, x (an array for all columns).

    Blank lines are skipped. The first line of a file is a header if the file cannot be read as numbers with it and can without
    it, none of its cells is a number, and the next line has as many. Any other line that is not numeric, an empty cell, or rows of
    unequal length are errors that name the line. A file may be of any length: it is read by as many tasks as it has splits.
    """
    lines = _numbered_lines(spark, path).withColumn("_cells", F.transform(F.split("value", ","), lambda c: F.trim(c)))
    number = lambda c: c.rlike(NUMBER)
    rows = lines.select("_file", "t", "_cells", F.forall("_cells", number).alias("_ok"), F.size("_cells").alias("_width"))
    head = F.forall("_cells", lambda c: ~number(c) & (c != ""))
    at = lambda t, c: F.max(F.when(F.col("t") == t, c))
    rest = F.col("t") > 0
    files = rows.groupBy("_file").agg(
        F.min(F.when(~F.col("_ok"), F.col("t"))).alias("_bad"), F.min(F.when(~F.col("_ok") & rest, F.col("t"))).alias("_bad_rest"),
        F.max("_width").alias("_wide"), F.min("_width").alias("_narrow"), F.max(F.when(rest, F.col("_width"))).alias("_wide_rest"), F.min(F.when(rest, F.col("_width"))).alias("_narrow_rest"),
        at(0, head).alias("_head"), at(0, F.col("_width")).alias("_head_width"), at(1, F.col("_width")).alias("_next_width"),
    )
    plain = F.col("_bad").isNull() & (F.col("_wide") == F.col("_narrow"))
    below = F.col("_head") & F.col("_bad_rest").isNull() & (F.col("_wide_rest") == F.col("_narrow_rest")) & (F.col("_head_width") == F.col("_next_width"))
    why = F.when(F.col("_bad").isNotNull(), F.concat(F.lit("line "), (F.coalesce("_bad_rest", "_bad") + 1).cast("string"), F.lit(" is not numeric"))).otherwise(F.lit("the rows are not as long as each other"))
    files = files.select("_file", F.when(plain, F.lit(0)).when(F.coalesce(below, F.lit(False)), F.lit(1)).otherwise(F.raise_error(F.concat(F.col("_file"), F.lit(": "), why)).cast("int")).alias("_skip"))
    kept = rows.join(files, "_file").where(F.col("t") >= F.col("_skip"))
    name = F.lit(series_id) if series_id is not None else F.col("_file")
    return kept.select(name.alias("series_id"), (F.col("t") - F.col("_skip")).alias("t"), F.transform("_cells", lambda c: _as_double(c)).alias("x"))


def _as_double(c):
    """A cell as a number; the names of infinity that a cast does not know are put in its words."""
    low = F.lower(c)
    return F.when(low.rlike("^[+-]?inf"), F.when(low.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).when(low.rlike("^[+-]?nan$"), F.lit(float("nan"))).otherwise(c.try_cast("double"))


class NpyFile:
    """The header of an NPY file: type, layout, shape and where the data start. Only these bytes are read."""

    def __init__(self, path: str):
        self.path = path
        with _opened(path) as source:
            version = np.lib.format.read_magic(source)
            reader = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
            if reader is None:
                raise InvalidInput(f"NPY version {version} is not supported")
            self.shape, self.fortran, dtype = reader(source)
            self.start, self.kind = source.tell(), dtype.str
        if dtype.kind != "f" or dtype.itemsize not in (4, 8):
            raise InvalidInput(f"only float32 and float64 arrays can be read; got {dtype}")
        if len(self.shape) not in (1, 2) or 0 in self.shape:
            raise InvalidInput(f"a series has one or two dimensions and at least one row; got {self.shape}")
        self.rows, self.columns, self.item = self.shape[0], self.shape[1] if len(self.shape) == 2 else 1, dtype.itemsize

    def block(self, source, low: int, high: int) -> np.ndarray:
        """The rows from low to high, by one read at their place, or by one for each column in the layout by columns."""

        def at(first: int, count: int) -> np.ndarray:
            source.seek(self.start + first * self.item)
            body = source.read(count * self.item)
            if len(body) != count * self.item:
                raise InvalidInput(f"{self.path} ends before its last row")
            return np.frombuffer(body, self.kind)

        n = high - low
        if self.fortran and self.columns > 1:
            return np.stack([at(c * self.rows + low, n) for c in range(self.columns)], axis=1).astype(np.float64)
        return at(low * self.columns, n * self.columns).reshape(n, self.columns).astype(np.float64)


def _opened(path: str):
    """A file with positional reads, on whatever store its address names."""
    files, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (pafs.LocalFileSystem(), path)
    return files.open_input_file(name)


def _found(path: str) -> list[str]:
    """The NPY files at a path: itself, or those of a folder."""
    if "://" in path or path.startswith(("/", "file:")):
        files, name = pafs.FileSystem.from_uri(path)
    else:
        files, name = pafs.LocalFileSystem(), path
    info = files.get_file_info(name)
    if info.type == pafs.FileType.NotFound:
        raise InputOutput(f"{path} does not exist")
    if info.type == pafs.FileType.File:
        return [path]
    inside = files.get_file_info(pafs.FileSelector(name))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in inside if f.type == pafs.FileType.File and f.extension == "npy")


@dataclass
class _Rows(InputPartition):
    file: NpyFile
    low: int
    high: int


class NpyDataSource(DataSource):
    """spark.read.format("npy").load(path): files or folders of them, separated by commas, on any store that pyarrow reads.

    Of each file the header is read once; ranges of `bytes_per_partition` (option, 32 MB) of rows are read where they stand, in
    tasks of their own.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "series_id string, t bigint, x array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


class _NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.bytes = int(options.get("bytes_per_partition", 32 << 20))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            for one in _found(path):
                file = NpyFile(one)
                step = max(1, self.bytes // (file.columns * file.item))
                out += [_Rows(file, low, min(low + step, file.rows)) for low in range(0, file.rows, step)]
        return out

    def read(self, partition: _Rows):
        file = partition.file
        names, step = ["series_id", "t", "x"], max(1, (1 << 20) // file.columns)
        with _opened(file.path) as source:
            for low in range(partition.low, partition.high, step):
                x = file.block(source, low, min(low + step, partition.high))
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * file.columns, x.ravel())
                yield pa.RecordBatch.from_arrays([pa.array([file.path] * len(x)), pa.array(np.arange(low, low + len(x)), pa.int64()), lists], names=names)


def read_npy(spark: SparkSession, path: str, series_id: str | None = None) -> DataFrame:
    """series_id (the path unless given), t, x as an array: one- or two-dimensional arrays of 4- or 8-byte floats, in either
    byte order and layout, by ranges of rows."""
    spark.dataSource.register(NpyDataSource)
    rows = spark.read.format("npy").load(path)
    return rows if series_id is None else rows.withColumn("series_id", F.lit(series_id))


def from_rows(spark: SparkSession, x, series_id: str = "series", times=None) -> DataFrame:
    """A series from an array or sequence, with times as int64 nanoseconds or datetime64."""
    x = np.asarray(x)
    if x.dtype.kind != "f":
        raise InvalidInput(f"values must be float32 or float64; got {x.dtype}")
    x = x.astype(np.float64).reshape(len(x), -1)
    if np.isinf(x).any():
        raise InvalidInput("values must not be infinite")
    frame = pd.DataFrame({"series_id": series_id, "t": np.arange(len(x)), "x": x.tolist() if x.shape[1] > 1 else x[:, 0]})
    if times is not None:
        times = np.asarray(times)
        if len(times) != len(x):
            raise InvalidInput("there must be one time per row")
        frame["t_ns"] = times.astype("datetime64[ns]").astype(np.int64) if times.dtype.kind == "M" else times.astype(np.int64)
    return spark.createDataFrame(frame)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON document per line."""
    results.select(F.to_json(F.struct(*results.columns)).alias("value")).write.mode("overwrite").text(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results written by any known schema version; the whole document is kept beside the known fields. A document of another
    version is an error."""
    version = F.coalesce(F.get_json_object("value", "$.diagnostics.schema_version").cast("int"), F.lit(1))
    refused = F.raise_error(F.concat(F.lit("schema version "), version.cast("string"), F.lit(" is not supported; known are 1 and 2")))
    raw = spark.read.text(path).select(F.when(version.isin(*SCHEMA_VERSIONS), F.col("value")).otherwise(refused).alias("document"))
    return raw.select(F.from_json("document", schema).alias("r"), "document").select("r.*", "document")


def result_json(outcome, n: int, algorithm: str, cost: str, pretty: bool = False) -> str:
    body = {"breakpoints": outcome.breakpoints, "change_points": outcome.change_points, "diagnostics": {"schema_version": 1, "n": n, "algorithm": algorithm, "cost_model": cost, "notes": outcome.notes, "warnings": outcome.warnings}}
    return json.dumps(body, indent=2 if pretty else None)


def migrate(document: dict) -> dict:
    """A result document in the current form: versions 1 and 2 are known, unknown fields stay."""
    version = document.get("diagnostics", {}).get("schema_version", document.get("schema_version", 1))
    if version not in SCHEMA_VERSIONS:
        raise InvalidInput(f"schema version {version} is not supported; known are 1 and 2")
    points = document.get("breakpoints")
    if not points or points != sorted(set(points)):
        raise InvalidInput("breakpoints must be strictly increasing and not empty")
    return document | {"change_points": points[:-1]}
