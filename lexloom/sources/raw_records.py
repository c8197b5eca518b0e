"""Raw delimited records: a quote-aware tokenizer, typed rows, and the records that can't be read with the reason.

The tokenizer is a finite-state machine run over the bytes of a whole Arrow batch at once. The bytes are cut into chunks
of equal length without regard to records. All chunks advance in step, each for every state it could start in, which
gives each chunk's transition function; a prefix scan composes the functions, so the state at every chunk's start is
known; then all chunks advance again from that one state and mark where fields end and where a record breaks. A single
very long record is spread over many chunks like any other bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, PLAIN, QUOTED, CLOSED, BAD = range(5)
OTHER, SEP, QUOTE, END, NOTHING = range(5)
# Next state by class of the byte (row) and state (column); CLOSED is after a quote in a quoted field.
NEXT = np.array([
    [PLAIN, PLAIN, QUOTED, BAD, BAD],
    [START, START, QUOTED, START, BAD],
    [QUOTED, BAD, CLOSED, QUOTED, BAD],
    [START, START, START, START, START],
    [START, PLAIN, QUOTED, CLOSED, BAD],
], dtype=np.int8)
CHUNK = 256

QUOTE_IN_FIELD, AFTER_QUOTE, UNCLOSED = "quote inside an unquoted field", "text after a closing quote", "unclosed quote"


def states(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The state before each byte, the first byte's being START."""
    n = len(classes)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, NOTHING, dtype=np.int8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    functions = np.broadcast_to(np.arange(5, dtype=np.int8), (rows, 5)).copy()
    for step in steps:
        functions = NEXT[step[:, None], functions]
    reach = 1
    while reach < rows:  # after each turn a function covers twice as many chunks
        functions[reach:] = np.take_along_axis(functions[reach:], functions[:-reach].copy(), axis=1)
        reach *= 2
    at = np.zeros(rows, dtype=np.int8)
    at[1:] = functions[:-1, START]
    before = np.empty((chunk, rows), dtype=np.int8)
    for i, step in enumerate(steps):
        before[i] = at
        at = NEXT[step, at]
    return before.T.reshape(-1)[:n]


def tokenize(lines: pa.Array, separator: str = "\t") -> tuple[pa.Array, pa.Array, pa.Array]:
    """Fields, reason and byte offset of the fault of each line (a string array without nulls). A line with a fault has
    null fields, any other a null reason and offset."""
    n = len(lines)
    text = lines.cast(pa.large_string())
    if n == 0:
        return pa.array([], pa.list_(pa.string())), pa.array([], pa.string()), pa.array([], pa.int32())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    ends = offsets[1:] + np.arange(n)  # where each record's END stands
    classes = np.full(len(data) + n, OTHER, dtype=np.int8)
    is_byte = np.ones(len(classes), dtype=bool)
    is_byte[ends] = False
    raw = np.zeros(len(classes), dtype=np.uint8)
    raw[is_byte] = data
    classes[raw == ord(separator)] = SEP
    classes[raw == ord('"')] = QUOTE
    classes[ends] = END
    before = states(classes)

    record = np.cumsum(~is_byte) - ~is_byte  # the record that each position belongs to
    starts = np.concatenate([[0], ends[:-1] + 1])
    reason = np.full(n, None, dtype=object)
    fault = np.full(n, -1, dtype=np.int64)
    breaks = np.flatnonzero((before != BAD) & (classes != END) & (NEXT[classes, before] == BAD))
    reason[record[breaks]] = np.where(classes[breaks] == QUOTE, QUOTE_IN_FIELD, AFTER_QUOTE)
    fault[record[breaks]] = breaks - starts[record[breaks]]
    opened = np.flatnonzero((classes == QUOTE) & (before == START))
    open_end = np.flatnonzero((classes == END) & (before == QUOTED))
    if len(open_end):
        last = opened[np.searchsorted(opened, open_end) - 1]
        reason[record[open_end]] = UNCLOSED
        fault[record[open_end]] = last - starts[record[open_end]]

    closes = (classes == END) | ((classes == SEP) & (before != QUOTED) & (before != BAD))
    dropped = closes | ((classes == QUOTE) & ((before == START) | (before == QUOTED)))
    kept = np.concatenate([[0], np.cumsum(~dropped)])
    field_ends = np.flatnonzero(closes)
    field_offsets = np.concatenate([[0], kept[field_ends + 1]]).astype(np.int64)
    values = pa.LargeStringArray.from_buffers(len(field_ends), pa.py_buffer(field_offsets), pa.py_buffer(np.ascontiguousarray(raw[~dropped])))
    list_offsets = np.concatenate([[0], np.searchsorted(field_ends, ends, side="right")]).astype(np.int32)
    bad = reason != None  # noqa: E711
    fields = pa.ListArray.from_arrays(pa.array(list_offsets), values.cast(pa.string()))
    fields = pa.compute.if_else(pa.array(bad), pa.scalar(None, fields.type), fields)
    return fields, pa.array(reason, pa.string()), pa.array(np.where(bad, fault, 0), pa.int32(), mask=~bad)


def split_records(df: DataFrame, line: str, separator: str = "\t") -> DataFrame:
    """`df` with `_fields` (array of strings), `_reason` and `_offset`. A null line has null in all three."""
    schema = T.StructType([*df.schema.fields, T.StructField("_fields", T.ArrayType(T.StringType())), T.StructField("_reason", T.StringType()), T.StructField("_offset", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = b[line]
            fields, reason, at = tokenize(lines.fill_null(""), separator)
            if lines.null_count:
                fields = pa.compute.if_else(lines.is_null(), pa.scalar(None, fields.type), fields)
            yield pa.RecordBatch.from_arrays([*b.columns, fields, reason, at], names=[*b.schema.names, "_fields", "_reason", "_offset"])

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Field:
    """A typed field: `char` one code point; `word` text without blank, control or replacement characters; `number`
    ASCII digits, at most the largest 64-bit integer; `text` anything."""

    name: str
    kind: str = "text"

    def fault(self, v: Column) -> Column:
        if self.kind == "char":
            return F.when(F.length(v) != 1, F.lit(f"{self.name}: not one character"))
        if self.kind == "word":
            return F.when(v.rlike(r"[\p{Z}\s\p{Cc}\x{FFFD}]"), F.lit(f"{self.name}: blank, control or replacement character"))
        if self.kind == "number":
            short = F.regexp_replace(v, r"^0+(?=[0-9])", "")
            big = (F.length(short) > 19) | ((F.length(short) == 19) & (short > F.lit(str(2**63 - 1))))
            return F.when(~v.rlike(r"^[0-9]+\z"), F.lit(f"{self.name}: not a number")).when(big, F.lit(f"{self.name}: number too large"))
        return F.lit(None).cast("string")

    def value(self, v: Column) -> Column:
        return v.try_cast("bigint") if self.kind == "number" else v


def load_records(df: DataFrame, line: str, fields: list[Field], *, least: int | None = None, comment: str | None = None, separator: str = "\t") -> DataFrame:
    """All columns of `df`, the typed `fields`, `_reason` (null for a row that could be read) and `_offset` (byte at which
    broken quoting shows, null for other reasons). Split it into valid rows and faults with `where("_reason is null")`.

    One leading byte-order mark and one trailing carriage return are dropped first. Null lines, lines of spaces and tabs
    only, and lines that begin with `comment` give no row. Empty fields are dropped. From `least` to all fields must be
    there (`least` defaults to all); missing ones are null. Columns of `df` named like a column of the result are left
    out of it; an empty table gives no rows.
    """
    taken = {f.name for f in fields} | {"_reason", "_offset", "_fields", "_line"}
    others = [c for c in df.columns if c not in taken]
    df = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{line}`").alias("_line"))
    least = len(fields) if least is None else least
    clean = F.regexp_replace(F.regexp_replace(F.col("_line"), r"\A\x{FEFF}", ""), r"\r\z", "")
    rows = df.withColumn("_line", clean).where(F.col("_line").isNotNull() & ~F.col("_line").rlike(r"\A[ \t]*\z"))
    if comment:
        rows = rows.where(~F.col("_line").startswith(comment))
    rows = split_records(rows, "_line", separator).withColumn("_fields", F.filter("_fields", lambda x: x != ""))
    n = F.size("_fields")
    faults = [F.when(F.get("_fields", F.lit(i)).isNotNull(), f.fault(F.get("_fields", F.lit(i)))) for i, f in enumerate(fields)]
    count = F.when((n < least) | (n > len(fields)), F.concat(F.lit("fields: "), n.cast("string")))
    rows = rows.withColumn("_reason", F.coalesce("_reason", count, *faults))
    good = F.col("_reason").isNull()
    typed = [F.when(good, f.value(F.get("_fields", F.lit(i)))).alias(f.name) for i, f in enumerate(fields)]
    return rows.select(*[F.col(f"`{c}`") for c in others], *typed, "_reason", "_offset")
