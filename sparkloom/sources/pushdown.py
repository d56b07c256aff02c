"""A Parquet source that takes filters: partitions are planned from row-group statistics, and tasks return only rows that match.

It shows what a source of one's own needs for pushdown, and is the reader of tables with a manifest (``sources.manifest``), whose file
lists it prunes. Plain Parquet folders are better read by Spark itself.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from sparkloom.sources.stores import data_files, store

_RANGES = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


@dataclass
class Groups(InputPartition):
    """Row groups of one file."""

    path: str
    groups: list[int]
    rows: int


def takes(f: Filter, kind: pa.DataType | None) -> bool:
    """Whether a filter on a column of this type can be answered here as Spark would."""
    plain = kind is not None and (pa.types.is_integer(kind) or pa.types.is_string(kind) or pa.types.is_date(kind) or pa.types.is_boolean(kind) or pa.types.is_floating(kind) or (pa.types.is_timestamp(kind) and kind.tz is None))
    if not plain:
        return False
    if isinstance(f, IsNull | IsNotNull):
        return True
    values = f.value if isinstance(f, In) else (f.value,) if isinstance(f, (EqualTo, *_RANGES)) else None
    # A NaN equals itself and is above all numbers in Spark, unlike in Arrow; as a literal it is left to Spark.
    return values is not None and not any(v is None or isinstance(v, float) and math.isnan(v) for v in values)


def may_match(f: Filter, stats, rows: int, kind: pa.DataType) -> bool:
    """Whether a row group with these statistics of the filter's column can hold a match; True where they don't say."""
    if stats is None:
        return True
    if isinstance(f, IsNull):
        return not stats.has_null_count or stats.null_count > 0
    if stats.has_null_count and stats.null_count == rows:
        return False
    if isinstance(f, IsNotNull) or not stats.has_min_max:
        return True
    low, high = stats.min, stats.max
    if isinstance(f, In):
        return any(low <= v <= high for v in f.value)
    if isinstance(f, EqualTo):
        return low <= f.value <= high
    if isinstance(f, LessThan | LessThanOrEqual):
        return low < f.value or isinstance(f, LessThanOrEqual) and low == f.value
    # Statistics leave NaN out, which is above all numbers.
    return pa.types.is_floating(kind) or high > f.value or isinstance(f, GreaterThanOrEqual) and high == f.value


def matches(f: Filter, column: pa.Array) -> pa.Array:
    if isinstance(f, IsNull):
        return pc.is_null(column)
    if isinstance(f, IsNotNull):
        return pc.is_valid(column)
    if isinstance(f, In):
        return pc.is_in(column, value_set=pa.array(list(f.value), column.type))
    value = pa.scalar(f.value, column.type)
    if isinstance(f, EqualTo):
        return pc.equal(column, value)
    compare = {">": pc.greater, ">=": pc.greater_equal, "<": pc.less, "<=": pc.less_equal}[_RANGES[type(f)]]
    found = compare(column, value)
    return pc.or_(found, pc.is_nan(column)) if pa.types.is_floating(column.type) and _RANGES[type(f)][0] == ">" else found


class ParquetReader(DataSourceReader):
    """Reads some columns of some files. Footers are read by threads on the driver, at plan time, one small read a file."""

    def __init__(self, files: list[str], schema: pa.Schema, target_rows: int = 1_000_000, base: str = ""):
        self.files, self.schema, self.target_rows, self.base = files, schema, target_rows, base
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            at = getattr(f, "attribute", ())  # Not has none
            name = at[0] if len(at) == 1 else None
            if takes(f, self.schema.field(name).type if name in self.schema.names else None):
                self.filters.append(f)
            else:
                yield f

    def _groups_of(self, path: str) -> list[tuple[int, int]]:
        fs, _ = store(self.base or path)
        meta = pq.read_metadata(path, filesystem=fs)
        at = {meta.schema.column(k).path: k for k in range(meta.num_columns)}
        out = []
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            stats = lambda f, group=group: group.column(at[f.attribute[0]]).statistics if f.attribute[0] in at else None
            if group.num_rows and all(may_match(f, stats(f), group.num_rows, self.schema.field(f.attribute[0]).type) for f in self.filters):
                out.append((g, group.num_rows))
        return out

    def partitions(self) -> list[Groups]:
        """Row groups that may match, those of one file together up to ``target_rows``."""
        with ThreadPoolExecutor(16) as pool:
            found = list(pool.map(self._groups_of, self.files))
        out: list[Groups] = []
        for path, groups in zip(self.files, found, strict=True):
            last = None
            for g, rows in groups:
                if last is None or last.rows + rows > self.target_rows:
                    last = Groups(path, [], 0)
                    out.append(last)
                last.groups.append(g)
                last.rows += rows
        return out or [Groups("", [], 0)]

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        if not partition.groups:
            return
        fs, _ = store(self.base or partition.path)
        with fs.open_input_file(partition.path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=20_000, row_groups=partition.groups, columns=self.schema.names):
                for one in self.filters:
                    batch = batch.filter(matches(one, batch.column(one.attribute[0])))
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(n).cast(t) for n, t in zip(self.schema.names, self.schema.types, strict=True)], schema=self.schema)


class ParquetSource(DataSource):
    """Options: path; columns (a JSON list, all by default); target_rows."""

    @classmethod
    def name(cls):
        return "sparkloom_parquet"

    def _arrow(self) -> pa.Schema:
        files = data_files(self.options["path"], ".parquet")
        if not files:
            raise ValueError(f"no Parquet files at {self.options['path']}")
        found = pq.read_schema(files[0][0], filesystem=store(self.options["path"])[0]).remove_metadata()
        names = json.loads(self.options.get("columns", "null")) or found.names
        return pa.schema([found.field(n) for n in names])

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self._arrow(), prefer_timestamp_ntz=True)

    def reader(self, schema):
        files = [p for p, _ in data_files(self.options["path"], ".parquet")]
        return ParquetReader(files, self._arrow(), int(self.options.get("target_rows", 1_000_000)), self.options["path"])


def enable_pushdown(spark: SparkSession) -> None:
    """Python sources get filters only where the session says so, and when the plan is made, so the setting stays."""
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_filtered(spark: SparkSession, path: str, columns: list[str] | None = None, **options: object) -> DataFrame:
    """A Parquet file or folder through the source above. Python sources are not told which columns a plan needs, so name them here."""
    enable_pushdown(spark)
    spark.dataSource.register(ParquetSource)
    reader = spark.read.format("sparkloom_parquet").options(path=path, **{k: str(v) for k, v in options.items()})
    return (reader.option("columns", json.dumps(columns)) if columns else reader).load()
