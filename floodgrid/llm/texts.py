"""Row-wise work on whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Maps every ASCII byte that is not a letter or digit to a space and A-Z to a-z;
# bytes of other code points stay, so they belong to words.
_ALNUM = bytes(
    (b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256)
)


# What worker processes keep between tasks. A worker outlives the stages of a pipeline, so a stage clears
# what others have left before it fills its own.
_KEPT: list[dict] = []


def kept_by_worker(table: dict) -> dict:
    _KEPT.append(table)
    return table


def clear_others(mine: dict | None = None) -> None:
    for table in _KEPT:
        if table is not mine:
            table.clear()
    # Arrow keeps what earlier batches freed.
    pa.default_memory_pool().release_unused()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of ASCII letters, digits and all non-ASCII code points."""
    return text.translate(_ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Words between the ASCII white space characters 0x20 and 0x09 to 0x0D."""
    return text.split()


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[bytes], tuple]], new: str, keep: list[str]) -> DataFrame:
    """``keep`` and the columns ``new`` (DDL) that ``make()(utf8 bytes)`` gives for each row's text.

    A null text counts as empty. One text at a time is held as a Python object, whatever the
    batch size; nothing depends on other rows, so lost tasks are simply run again.
    """
    # Positional names, so that no kept name can clash with the text's.
    packed = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("t"))
    added = StructType.fromDDL(new)
    schema = StructType(packed.schema.fields[:-1] + added.fields)
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = to_arrow_schema(schema)
        work = make()
        for batch in batches:
            texts = batch.column(n_keep).cast(pa.binary())
            rows = [work(t.as_py() or b"") for t in texts]
            columns = [batch.column(i).cast(out_schema.field(i).type) for i in range(n_keep)]
            for j in range(len(added)):
                columns.append(pa.array([r[j] for r in rows], type=out_schema.field(n_keep + j).type))
            yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    out = packed.mapInArrow(run, schema)
    return out.toDF(*keep, *added.names) if keep else out
