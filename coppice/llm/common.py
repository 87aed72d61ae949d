"""Words and column choice shared by the operators."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from collections import defaultdict
from collections.abc import Callable, Collection, Iterable, Iterator, Sequence
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

import coppice
from coppice.session import run_folder

_shipped: dict[str, str] = {}

# Compressed bytes of a small row group.
GROUP_BYTES = 8 * 1024 * 1024
_SMALL_GROUPS = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": False, "compression": "zstd"}

# Bytes that separate words of letters and digits; every byte above 0x7F belongs to a word.
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_BLANK = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased."""
    return text.encode().lower().translate(_TO_BLANK).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased."""
    return text.encode().lower().split() if text else []


def numbered(lines: Iterable[list[bytes]]) -> tuple[Collection[bytes], list[np.ndarray]]:
    """The distinct words of some lines, and for each line the numbers of its words among them, so that
    what follows from a word is found once and not at each place."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    return number, [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in lines]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only: the first of each exact name, whatever else the table holds."""
    plain = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_{df.columns.index(name)}").alias(name) for name in names])


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    Functions sent to tasks refer to their module by name, and a worker finds the module
    only if the package is on its path; not every launch puts it there.
    """
    context = spark.sparkContext
    if _shipped.get("to") == context.applicationId:
        return
    folder = Path(coppice.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="coppice-")) / "coppice_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(folder.rglob("*.py")):
            out.write(source, source.relative_to(folder.parent))
    context.addPyFile(str(archive))
    _shipped["to"] = context.applicationId


def stored(df: DataFrame, purpose: str, group_rows: int | None = None) -> DataFrame:
    """The table written once to the shared folder, and read back from there.

    For rows of very many values, ``group_rows`` is how many of them a row group of its files holds, fewer
    where they take :data:`GROUP_BYTES`. A reader decodes up to 4,096 rows of a group at once, and a writer,
    if not told otherwise, looks at the sizes of pages and groups after 100 rows only. Such values
    are written plain, without dictionaries larger than a few rows are, and compressed harder.
    """
    spark = df.sparkSession
    path = run_folder(spark, purpose)
    df.write.options(**({"parquet.block.row.count.limit": group_rows, **_SMALL_GROUPS} if group_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder_of(table: DataFrame) -> str | None:
    """The folder of a :func:`stored` table; None where it has no file."""
    files = table.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else None


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps whose results are stored. They stay on the
    executors' disks until the driver's JVM collects what names them, which a driver with
    little to do puts off; at the end of a large step it is asked to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that few texts are held as Python strings at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_texts(docs: DataFrame, start: Callable[[], Callable[[list[str | None]], Sequence[tuple]]], types: str) -> DataFrame:
    """doc_id and the columns that a function makes of each row's whole text; narrow.

    ``start`` runs once per task and returns the function, which takes the texts of a
    batch and gives a tuple per row.
    """
    ship(docs.sparkSession)
    rows = pick(docs, "doc_id", "text")
    made = StructType.fromDDL(types)
    schema = StructType([rows.schema["doc_id"], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        arrow = to_arrow_schema(made)
        for part in sliced(batches):
            found = function(part.column("text").to_pylist())
            columns: list[Any] = list(zip(*found))
            arrays = [pa.array(values, field.type) for values, field in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], names=["doc_id", *arrow.names])

    return rows.mapInArrow(run, schema)
