"""Binary chart files as a data source that is read in parts.

Records have a fixed size and stand in order of time, so a file is cut by record
numbers into as many tasks as it needs, and a part whose first and last record lie
outside the wanted dates is left without reading it. Files are reached through
Arrow's file systems (local, hdfs, s3, gs); where the path is of none of
them, ``readers.chart_binary`` reads whole files through Spark.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.frame import FIELDS
from .readers import CHART_DAY, CHART_MINUTE

NAME = "chart_records"
SUFFIX = {False: ".fd", True: ".min"}
SCHEMA = "symbol string, at timestamp_ntz, " + ", ".join(f"{f} double" for f in FIELDS)


def _kind(options: dict) -> np.dtype:
    return np.dtype(CHART_MINUTE if options.get("intraday", "false") == "true" else CHART_DAY)


def _key(rows: np.ndarray) -> np.ndarray:
    """Day codes with their seconds, in the order of time."""
    second = rows["second"] if "second" in rows.dtype.names else 0
    return rows["day"].astype(np.int64) * 86_400 + second


def day_code(t: dt.datetime) -> int:
    return (t.year * 500 + t.month * 32 + t.day) * 86_400 + (t.hour * 60 + t.minute) * 60 + t.second


def times(rows: np.ndarray) -> pa.Array:
    """Wall-clock times; null where the code is no date."""
    day = rows["day"].astype(np.int64)
    year, month, dom = day // 500, day % 500 // 32, day % 500 % 32
    start = ((year - 1970) * 12 + month - 1).astype("datetime64[M]")
    at = start.astype("datetime64[D]") + (dom - 1)
    bad = (month < 1) | (month > 12) | (dom < 1) | (at.astype("datetime64[M]") != start)
    second = rows["second"].astype(np.int64) if "second" in rows.dtype.names else np.zeros(len(rows), dtype=np.int64)
    return pa.array(at.astype("datetime64[us]") + second * 1_000_000, pa.timestamp("us"), mask=bad)


@dataclass
class Part(InputPartition):
    path: str
    first: int
    count: int


class ChartReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Part]:
        system, root = arrow_fs.FileSystem.from_uri(self.options["path"])
        info = system.get_file_info(root)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(root)
        files = [info] if info.is_file else [f for f in system.get_file_info(arrow_fs.FileSelector(root, recursive=True)) if f.is_file and not os.path.basename(f.path).startswith(("_", "."))]
        size, most = _kind(self.options).itemsize, int(self.options.get("records", 1_000_000))
        return [Part(f.path, at, min(most, f.size // size - at)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size // size, most)] or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        kind = _kind(self.options)
        system, _ = arrow_fs.FileSystem.from_uri(self.options["path"])
        since, until = (int(self.options[x]) if x in self.options else None for x in ("since", "until"))
        with system.open_input_file(part.path) as f:
            records = lambda at, n: np.frombuffer(f.read_at(n * kind.itemsize, at * kind.itemsize), dtype=kind)
            lo, hi = part.first, part.first + part.count
            if since is not None and _key(records(hi - 1, 1))[0] < since or until is not None and _key(records(lo, 1))[0] > until:
                return
            symbol = os.path.basename(part.path).rsplit(".", 1)[0]
            for at in range(lo, hi, 65_536):
                rows = records(at, min(65_536, hi - at))
                key = _key(rows)
                keep = np.ones(len(rows), dtype=bool)
                if since is not None:
                    keep &= key >= since
                if until is not None:
                    keep &= key <= until
                rows = rows[keep]
                yield pa.RecordBatch.from_arrays([pa.array([symbol] * len(rows), pa.string()), times(rows), *[pa.array(rows[c].astype(float)) for c in FIELDS]], ["symbol", "at", *FIELDS])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ChartWriter(DataSourceArrowWriter):
    """A file a symbol; files take their names when the whole job is done."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        kind = _kind(self.options)
        system, root = arrow_fs.FileSystem.from_uri(self.options["path"])
        system.create_dir(root, recursive=True)
        done: list[tuple[str, str]] = []
        out, current = None, None
        for b in batches:
            symbols = b.column("symbol").to_pylist()
            day = b.column("at").cast(pa.timestamp("us")).to_numpy(zero_copy_only=False).astype("datetime64[us]")
            months = day.astype("datetime64[M]").astype(np.int64)
            rows = np.zeros(len(symbols), dtype=kind)
            rows["day"] = (1970 + months // 12) * 500 + (months % 12 + 1) * 32 + (day.astype("datetime64[D]") - day.astype("datetime64[M]").astype("datetime64[D]")).astype(np.int64) + 1
            if "second" in kind.names:
                rows["second"] = (day - day.astype("datetime64[D]")).astype(np.int64) // 1_000_000
            for c in FIELDS:
                rows[c] = np.nan_to_num(b.column(c).to_numpy(zero_copy_only=False).astype(float))
            edges = [0, *(i for i in range(1, len(symbols)) if symbols[i] != symbols[i - 1]), len(symbols)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                if symbols[lo] != current or out is None:
                    if out is not None:
                        out.close()
                    current = symbols[lo]
                    name = f"{current}{SUFFIX['second' in kind.names]}"
                    done.append((f"{root}/_{uuid.uuid4().hex}", f"{root}/{name}"))
                    out = system.open_output_stream(done[-1][0])
                out.write(rows[lo:hi].tobytes())
        if out is not None:
            out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = arrow_fs.FileSystem.from_uri(self.options["path"])
        for m in messages:
            for temporary, final in m.files if m else ():
                system.move(temporary, final)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = arrow_fs.FileSystem.from_uri(self.options["path"])
        for m in messages:
            for temporary, _ in m.files if m else ():
                system.delete_file(temporary)


class ChartSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ChartReader:
        return ChartReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ChartWriter:
        return ChartWriter(self.options)


def read_charts(spark: SparkSession, path: str, intraday: bool = False, start: dt.datetime | None = None, end: dt.datetime | None = None, records: int = 1_000_000) -> DataFrame:
    """Bars of one file or a folder of them, ``records`` to a task. Bounds are wall-clock times,
    included, and are used where the files are read. A record cut short at a file's end is left out; one
    whose day is no date has a null time; an empty folder gives no rows."""
    spark.dataSource.register(ChartSource)
    options = {"path": path, "intraday": str(intraday).lower(), "records": str(records)}
    options |= {k: str(day_code(t)) for k, t in (("since", start), ("until", end)) if t is not None}
    rows = spark.read.format(NAME).options(**options).load()
    return rows.select("symbol", F.col("at").cast("timestamp").alias("ts"), *FIELDS)


def write_charts(bars: DataFrame, path: str, intraday: bool = False) -> None:
    """A file a symbol, named by it, in order of time. Prices keep the four bytes that the format has,
    volume and open interest are whole numbers; nulls become zero, and bars without a symbol or time aren't written."""
    spark = bars.sparkSession
    spark.dataSource.register(ChartSource)
    have = [F.col(f).cast("double").alias(f) if f in bars.columns else F.lit(0.0).alias(f) for f in FIELDS]
    rows = bars.where("symbol is not null and ts is not null").select("symbol", F.col("ts").cast("timestamp_ntz").alias("at"), *have)
    rows = rows.repartition("symbol").sortWithinPartitions("symbol", "at")
    rows.write.format(NAME).mode("append").options(path=path, intraday=str(intraday).lower()).save()
