"""Words, Arrow batches and small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text handled at a time inside a task, a longer text alone; and rows turned into Python values at a time.
CHUNK_BYTES, SLICE_ROWS = 4 << 20, 1024
#: Bytes of the longest text that a classifier learns from; every text is scored, whatever its length.
TEXT_BYTES = 1 << 16


def text_bytes(name: str) -> Column:
    """UTF-8 bytes of a text column; null is the empty text."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


def remainder(name: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % divisor


def bounded_texts(docs: DataFrame, doc_id: str, text: str, chosen: DataFrame, longest: int) -> DataFrame:
    """(doc_id, label, text) of the ids in ``chosen``: one text of at most ``longest`` bytes for each, the least one where an id repeats."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("text")).where(F.octet_length("text") <= longest)
    return rows.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; the split and case rules of bytes are exactly these."""
    return text.lower().split()


def chunks(texts: list[bytes], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``size`` bytes together."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def interned(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(index of each word among the distinct ones, number of words by text, distinct words)."""
    flat = [w for part in split for w in part]
    index = dict.fromkeys(flat)
    for i, w in enumerate(index):
        index[w] = i
    ids = np.fromiter(map(index.__getitem__, flat), np.int32, len(flat))
    return ids, np.fromiter(map(len, split), np.int64, len(split)), list(index)


def frequent(counts: DataFrame, count: str, size: int) -> DataFrame:
    """The most frequent rows of a count table, at most ``size``: all rows from some level of counts up.

    Levels lie about three percent apart, so the level totals are few however large the table is, and no task or driver
    ever sorts or merges the candidates.
    """
    level = F.floor(F.ln(F.col(count)) * 32)
    cut, total = None, 0
    for row in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.level):
        total += row.n
        if total > size:
            break
        cut = row.level
    return counts.where(level >= cut if cut is not None else F.lit(False))


def map_rows(df: DataFrame, columns: dict[str, str], keep: list[str], make: Callable[[], Callable[[dict], Iterable[dict]]],
             kept_text: str | None = None) -> DataFrame:
    """Arrow map that passes ``keep`` through and adds ``columns`` (name -> SQL type).

    ``make`` is called once per task and returns a function from a batch, a dict of Python lists for the other
    columns of ``df``, to a dict of lists or arrays for ``columns``. With ``kept_text``, a kept column, its UTF-8 bytes (null:
    empty) are handed over as ``__text``, so a text that is kept is not sent twice. Batches are worked off in short slices.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kept = [df.schema[k] for k in keep]
    used = [c for c in df.columns if c not in keep]
    schema = StructType(kept + [StructField(k, _parse_datatype_string(v)) for k, v in columns.items()])
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = make()
        for whole in batches:
            for start in range(0, len(whole), SLICE_ROWS):
                batch = whole.slice(start, SLICE_ROWS)
                values = {c: batch.column(c).to_pylist() for c in used}
                if kept_text:
                    values["__text"] = batch.column(kept_text).cast(pa.binary()).fill_null(b"").to_pylist()
                out = work(values)
                arrays = [batch.column(k) for k in keep] + [pa.array(out[k], arrow.field(k).type) for k in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return df.mapInArrow(run, schema)
