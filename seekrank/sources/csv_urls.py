"""URL-list sources: CSV files (I1) and base64 upload payloads.

Both yield ``upload_id, file_name, row_no, id, type, url, columns_found``:
header names trimmed and matched case-insensitively to type/url/id, values
trimmed later by :func:`seekrank.operators.ingest.validate_url_rows`.
"""

from __future__ import annotations

import base64
import csv
import io
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seekrank.config import DEFAULT_FILE_NAME
from seekrank.functions.text import ws_trim
from seekrank.session import staged

WANTED = ("type", "url", "id")

ROWS_SCHEMA = T.StructType([
    T.StructField("upload_id", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("row_no", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("columns_found", T.StringType()),
    T.StructField("error", T.StringType()),
])


# --------------------------------------------------------------------------- I1: files

_PIECES = "file string, start long, line long, state int, kind string, text string, fields array<string>, error string, odd boolean"


def _fields(text: str) -> tuple[list[str] | None, str | None]:
    """The fields of one record, or what is wrong with it; (None, None) for a blank line."""
    try:
        found = _records(text)
    except csv.Error as e:
        return None, str(e)
    rec = found[0] if found else []
    return (None, None) if not rec or len(rec) == 1 and not rec[0].strip() else (rec, None)


def _split_pieces(file: str, start: int, lines: Iterator[tuple[int, str]]) -> Iterator[tuple]:
    """Records of one byte range (start, lines), read as if it began outside (state 0) and inside (1) of quotes.

    A record ends with a line up to which the quotes are even, counted from the
    record's state; so every line ends a record in one of the two. What lies
    before the first end in state 1 is a head, what follows the last end a tail:
    parts of records that cross ranges. A file's first range has state 0 only.
    """
    states = (0,) if start == 0 else (0, 1)
    held: dict[int, tuple[int, list[str]]] = {}
    began = {s: s == 0 for s in states}
    odd = False
    for n, line in lines:
        odd ^= line.count('"') % 2 == 1
        for s in states:
            first, own = held.setdefault(s, (n, []))
            own.append(line)
            if odd == (s == 1):
                text = "\n".join(own)
                del held[s]
                if began[s]:
                    fields, error = _fields(text)
                    if fields or error:
                        yield (file, start, first, s, "row", None, fields, error, None)
                else:
                    began[s] = True
                    yield (file, start, first, s, "head", text, None, None, None)
    for s, (first, own) in held.items():  # a range without an end is one part, which stays open
        yield (file, start, first, s, "tail" if began[s] else "middle", "\n".join(own), None, None, None)
    yield (file, start, -1, 0, "range", None, None, None, odd)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the byte ranges of a task; each range's lines come in order."""
    def lines() -> Iterator[tuple[tuple[str, int], str]]:
        for b in batches:
            for file, start, value in zip(*(b.column(c).to_pylist() for c in ("file", "start", "value"))):
                yield (file, start), value.removesuffix("\r")

    names = [f.split(" ") for f in _PIECES.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    out: list[tuple] = []
    for (file, start), own in groupby(lines(), key=lambda x: x[0]):
        numbered = ((n, v.removeprefix("\ufeff") if n == 0 and start == 0 else v) for n, (_, v) in enumerate(own))
        for piece in _split_pieces(file, start, numbered):
            out.append(piece)
            if len(out) == 10_000:
                yield pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(zip(*out), names)], [n for n, _ in names])
                out = []
    if out:
        yield pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(zip(*out), names)], [n for n, _ in names])


@F.pandas_udf(T.StructType([T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]))
def _joined(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_fields(t) for t in texts], columns=["fields", "error"])


def _file_records(pieces: DataFrame) -> DataFrame:
    """file, row_no, fields, error of every record, from the pieces of all ranges.

    The state of a range is the parity of the quotes before it in its file: a
    running sum over the ranges. Parts that cross ranges are put together in
    the order of the ranges.
    """
    by_file = Window.partitionBy("file").orderBy("start")
    states = (pieces.filter("kind = 'range'").withColumn("state", (F.coalesce(
        F.sum(F.col("odd").cast("int")).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2).cast("int")).select("file", "start", "state"))
    true = pieces.filter("kind <> 'range'").join(states, ["file", "start", "state"])  # a row per range and file: small
    whole = true.filter("kind = 'row'").select("file", (F.col("start") + F.col("line")).alias("row_no"), "fields", "error")
    in_order = Window.partitionBy("file").orderBy("start", "line")
    parts = true.filter("kind <> 'row'").withColumn("rec", F.sum((F.col("kind") == "tail").cast("int")).over(in_order))
    crossing = parts.groupBy("file", "rec").agg(
        F.min(F.col("start") + F.col("line")).alias("row_no"), F.max(F.col("kind") == "head").alias("closed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    closed = crossing.filter("closed").withColumn("r", _joined("text")).select("file", "row_no", "r.fields", "r.error")
    never = crossing.filter("not closed").select("file", "row_no", F.lit(None).cast("array<string>").alias("fields"), F.lit("Quote Not Closed: a quoted field has no end").alias("error"))
    return whole.unionByName(closed.filter("fields is not null or error is not null")).unionByName(never)


def read_url_csv(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """CSV files of any size and header; rows of good files, and one error row (no ``row_no``) per rejected file.

    Files are read once, as lines of byte ranges, so a large file is read by
    many tasks whether or not its fields hold line breaks: each range is parsed
    for both states of quotes and the right one is kept. BOM, blank lines,
    header blanks, order and case of columns are handled per file. ``strict``
    rejects a file with a row of another length than its header; without it
    missing fields are null. A file without data rows is rejected (one of no
    bytes at all is skipped by Spark's readers).
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    records = staged(_file_records(staged(lines.mapInArrow(_pieces, _PIECES), "csv-pieces")), "csv-records")
    header = records.groupBy("file").agg(F.min_by(F.struct("row_no", "fields", "error"), "row_no").alias("h")).select(
        "file", F.col("h.row_no").alias("h_no"), F.transform(F.coalesce("h.fields", F.array().cast("array<string>")), ws_trim).alias("names"))
    rows = records.join(header, "file").filter(F.col("row_no") > F.col("h_no"))
    ragged = F.when((F.size("fields") != F.size("names")) & F.lit(strict),
                    F.concat(F.lit("Invalid Record Length: expected "), F.size("names"), F.lit(", got "), F.size("fields")))
    wrong = rows.withColumn("error", F.coalesce("error", ragged)).groupBy("file").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("row_no"))).alias("error"))
    unread = records.join(header, "file").filter((F.col("row_no") == F.col("h_no")) & F.col("error").isNotNull()).select("file", F.col("error").alias("h_error"))
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"))
    empty = F.lit("CSV file is empty or contains no data rows")
    verdict = (files.join(header, "file", "left").join(wrong, "file", "left").join(unread, "file", "left").join(rows.select("file").distinct().withColumn("some", F.lit(True)), "file", "left")
               .select("file", "file_name", "names", F.coalesce("h_error", "error", F.when(F.col("some").isNull(), empty)).alias("verdict")))
    found = F.array_join("names", ", ").alias("columns_found")
    lower = F.transform("names", lambda n: F.lower(n))

    def column(c: str) -> Column:
        at = F.array_position(lower, c).cast("int")
        return F.when(at > 0, F.get("fields", at - 1)).alias(c)
    good = rows.drop("error").join(verdict.filter("verdict is null").select("file", "file_name"), "file")
    none = F.lit(None).cast("string")
    out = good.select(F.col("file").alias("upload_id"), "file_name", "row_no", column("id"), column("type"), column("url"), found, none.alias("error"))
    bad = verdict.filter("verdict is not null").select(F.col("file").alias("upload_id"), "file_name", F.lit(None).cast("long").alias("row_no"),
                                                       *(none.alias(c) for c in ("id", "type", "url")), found, F.col("verdict").alias("error"))
    return out.unionByName(bad)


# --------------------------------------------------------------------------- I2: payloads

def _records(text: str):
    """CSV records; blanks around quoted fields are allowed, as the file reader allows them."""
    try:
        return list(csv.reader(io.StringIO(text, newline=""), skipinitialspace=True, strict=True))
    except csv.Error:
        if text.count('"') % 2:
            raise
        return list(csv.reader(io.StringIO(text, newline=""), skipinitialspace=True))


def _parse_payload(text: str):
    """Header and rows of one CSV document (header row first; blank lines skipped)."""
    header, rows = None, []
    for rec in _records(text.removeprefix("\ufeff")):
        if not rec or all(v.strip() == "" for v in rec) and len(rec) <= 1:
            continue
        if header is None:
            header = [h.strip() for h in rec]
            continue
        if len(rec) != len(header):
            raise ValueError(f"Invalid Record Length: expected {len(header)}, got {len(rec)}")
        rows.append(rec)
    return header or [], rows


def parse_payloads(batches):
    """mapInPandas body: one output row per data row, or one error row (no ``row_no``) per bad or empty payload."""
    cols = [f.name for f in ROWS_SCHEMA.fields]
    for pdf in batches:
        for up, content, name in zip(pdf["upload_id"], pdf["csv_content"], pdf["file_name"]):
            fname = name or DEFAULT_FILE_NAME
            found, error, rows, idx = None, None, [], {}
            if not content:
                error = "csvContent is required"
            else:
                try:
                    header, rows = _parse_payload(base64.b64decode(content).decode("utf-8", "replace"))
                    found = ", ".join(header)
                    for i, h in enumerate(header):
                        k = h.lower().strip()
                        if k in WANTED and k not in idx:
                            idx[k] = i
                    if not rows:
                        error = "CSV file is empty or contains no data rows"
                except Exception as e:  # a bad payload fails alone
                    error, rows = str(e), []
            if error:
                yield pd.DataFrame([(up, fname, None, None, None, None, found, error)], columns=cols)
            for lo in range(0, len(rows), 10_000):
                yield pd.DataFrame([(up, fname, lo + n, *(rec[idx[k]] if k in idx else None for k in ("id", "type", "url")), found, None)
                                    for n, rec in enumerate(rows[lo:lo + 10_000])], columns=cols)


def read_upload_payloads(payloads: DataFrame) -> DataFrame:
    """``(upload_id, csv_content, file_name)`` → CSV rows, one Arrow batch of payloads per task."""
    cols = payloads.columns
    p = payloads.select(
        F.col("upload_id").cast("string"), F.col("csv_content"),
        (F.col("file_name") if "file_name" in cols else F.lit(None).cast("string")).alias("file_name"))
    return p.mapInPandas(parse_payloads, ROWS_SCHEMA)
