"""Block statistics from Parquet footers, read inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def _reader(key: str, kind: pa.DataType):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n_rows", pa.int64()), ("n_bytes", pa.int64()), ("key_min", kind), ("key_max", kind), ("codec", pa.string()), ("file_bytes", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            for uri in batch.column("path").to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    size = f.size()
                    footer = pq.ParquetFile(f).metadata
                    column = [footer.schema.column(i).path for i in range(footer.num_columns)].index(key)
                    rows = []
                    for b in range(footer.num_row_groups):
                        group = footer.row_group(b)
                        chunk = group.column(column)
                        s = chunk.statistics
                        has = s is not None and s.has_min_max
                        rows.append((uri, b, group.num_rows, group.total_byte_size, s.min if has else None, s.max if has else None, chunk.compression, size))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return read


def block_stats(spark: SparkSession, found: DataFrame, key: str, key_type: T.DataType) -> DataFrame:
    """``file, block, n_rows, n_bytes, key_min, key_max, codec, file_bytes``: one row per row group of the
    files in ``found`` (``path``). Bounds are null where a footer has none. Files without row groups
    give no rows."""
    names = (("file", T.StringType()), ("block", T.LongType()), ("n_rows", T.LongType()), ("n_bytes", T.LongType()), ("key_min", key_type), ("key_max", key_type), ("codec", T.StringType()), ("file_bytes", T.LongType()))
    return found.select("path").mapInArrow(_reader(key, to_arrow_type(key_type)), T.StructType([T.StructField(n, t) for n, t in names]))


def _always(kind: pa.DataType) -> bool:
    """Whether a value inside of this type is declared never null, but for the keys of maps."""
    if pa.types.is_map(kind):
        return not kind.item_field.nullable or _always(kind.item_type) or _always(kind.key_type)
    inside = [kind.field(i) for i in range(kind.num_fields)]
    return any(not f.nullable or _always(f.type) for f in inside)


def _declared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    for batch in batches:
        out = []
        for uri in batch.column("file").to_pylist():
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as f:
                schema = pq.ParquetFile(f).schema_arrow
            out.append((uri, sorted(f.name for f in schema if not f.nullable), any(_always(f.type) for f in schema)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.list_(pa.string()), pa.bool_()), strict=True)], ["file", "columns", "inside"])


def never_null(spark: SparkSession, files: list[str]) -> dict[str, tuple[frozenset[str], bool]]:
    """What files declare to be never null: columns, and whether something inside of columns is.
    Pages hold no marks of nulls there, so they cannot stand beside pages that do."""
    if not files:
        return {}
    tasks = min(len(files), max(spark.sparkContext.defaultParallelism, len(files) // 256))
    df = spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks)
    rows = df.mapInArrow(_declared, "file string, columns array<string>, inside boolean").collect()
    return {r.file: (frozenset(r.columns), r.inside) for r in rows}


def computed_stats(df: DataFrame, key: str) -> DataFrame:
    """The same bounds by file from the rows, for files whose footers have none."""
    return df.select(F.col(key).alias("_k"), F.col("_metadata.file_path").alias("file")).groupBy("file").agg(F.count("*").alias("n_rows"), F.min("_k").alias("key_min"), F.max("_k").alias("key_max"))
