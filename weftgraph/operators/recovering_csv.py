"""Rows that fail to parse: an error-recovering recursive-descent grammar for delimited text.

    text   := record (newline record)*
    record := field ("," field)*
    field  := quoted | bare
    quoted := '"' ( [^"] | '""' )* '"'        followed by a comma or the end of the record
    bare   := [^",]*

Each rule is a function that consumes its part or reports a located fault. After a fault the parser
resumes at the next *validated record start*: in tables every row is one record, so the row's own start
is the anchor; in files it is the next line start from which a sound record (number of fields and typed
values) parses.

What the parser does from a record start depends on nothing before it, so a file's record starts are a chain of
successors. That makes parsing in parallel exact: every byte range follows the chain from a guessed start, and ranges whose
guess was not where the range before ended are followed again, until all ends meet (:func:`read_files`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import drop, free_name, rows_of, spill

REASONS = ("quoting", "columns", "value")
_BARE = re.compile(r'[^",]*')
_BARE_LINE = re.compile(r'[^",\n]*')
_QUOTED = re.compile(r'"(?:[^"]|"")*"')
_DIGITS = re.compile(r"[0-9]+")
_DECIMAL = re.compile(r"[0-9]+(?:\.[0-9]+)?")
_INT64_MAX = 2**63 - 1
#: Characters of a record in a file after which an open quote counts as never closed.
RECORD_CHARS = 1 << 20


@dataclass(frozen=True)
class Fault:
    """A located error: ``offset`` into the text of the record, ``reason`` of REASONS, ``field`` counted from 0."""

    offset: int
    reason: str
    field: int
    message: str


def whole(text: str) -> int | None:
    """Terminal for int64 columns; blank is no value. Raises ValueError."""
    text = text.strip(" \t")
    if not text:
        return None
    digits = text.lstrip("0") or "0"
    if not _DIGITS.fullmatch(text) or len(digits) > 19 or int(digits) > _INT64_MAX:
        raise ValueError(f"no whole number: {text[:40]!r}")
    return int(digits)


def decimal(text: str) -> float | None:
    """Terminal for decimal columns; blank is no value. Raises ValueError."""
    text = text.strip(" \t")
    if not text:
        return None
    if not _DECIMAL.fullmatch(text):
        raise ValueError(f"no decimal number: {text[:40]!r}")
    return float(text)


_TERMINALS = {"string": str, "bigint": whole, "double": decimal}


class RecordGrammar:
    """Parser for records of the given columns: a list of (name, ``string`` | ``bigint`` | ``double``)."""

    def __init__(self, columns: list[tuple[str, str]]):
        self.columns = columns
        self._terminals = [(i, _TERMINALS[kind]) for i, (_, kind) in enumerate(columns) if kind != "string"]

    def _field(self, text: str, at: int, index: int, bare: re.Pattern, stops: str, begin: int) -> tuple[int, str | Fault]:
        if text.startswith('"', at):
            line = text.find("\n", begin + RECORD_CHARS) if "\n" in stops else -1
            m = _QUOTED.match(text, at, len(text) if line < 0 else line)
            if m is None:
                return len(text), Fault(at, "quoting", index, "the quote is never closed")
            end = m.end()
            value = text[at + 1 : end - 1].replace('""', '"')
            if "\n" in stops and text.startswith("\r\n", end):
                return end + 1, value
            if end < len(text) and text[end] not in stops:
                return end, Fault(end, "quoting", index, "no comma after the closing quote")
            return end, value
        end = bare.match(text, at).end()
        if text.startswith('"', end):
            return end, Fault(end, "quoting", index, "a quote inside a field")
        return end, text[at : end - 1] if "\n" in stops and text.startswith("\r\n", end - 1) else text[at:end]

    def _record(self, text: str, at: int, bare: re.Pattern, stops: str) -> tuple[int, list[str], Fault | None]:
        fields: list[str] = []
        begin = at
        while True:
            at, got = self._field(text, at, len(fields), bare, stops, begin)
            if isinstance(got, Fault):
                return at, fields, got
            fields.append(got)
            if not text.startswith(",", at):
                return at, fields, None
            at += 1

    def _typed(self, start: int, fields: list[str]) -> list | Fault:
        if len(fields) != len(self.columns):
            return Fault(start, "columns", len(fields), f"{len(fields)} fields")
        values: list = list(fields)
        for i, terminal in self._terminals:
            try:
                values[i] = terminal(fields[i])
            except ValueError as e:
                return Fault(start, "value", i, str(e))
        return values

    def parse_record(self, text: str | None) -> list | Fault:
        """Parse a text that is one whole record (line breaks are content). A null text has no fields."""
        if text is None:
            return Fault(0, "columns", 0, "no text")
        _, fields, fault = self._record(text, 0, _BARE, ",")
        return fault or self._typed(0, fields)

    def sound_at(self, text: str, at: int) -> bool:
        """Whether a sound record starts here: the validation of an anchor."""
        _, fields, fault = self._record(text, at, _BARE_LINE, ",\n")
        return fault is None and isinstance(self._typed(at, fields), list)

    def next_anchor(self, text: str, at: int, stop: int | None = None) -> int:
        """First line start after ``at`` from which a sound record parses; ``stop`` or the text's end if there is none before."""
        stop = len(text) if stop is None else stop
        while 0 < (at := text.find("\n", at) + 1) < stop:
            if self.sound_at(text, at):
                return at
        return stop

    def step(self, text: str, at: int) -> tuple[int, int, list | Fault]:
        """The record at a record start: its end, the next record start, and its values or the fault.

        A record with a broken quote is its line, and the next line is the next record start. So is one over several lines with a wrong number of fields or a wrong value, if
        an anchor lies in it: then its quote was not meant to open it. Else such a record is at fault as a whole.
        """
        end, fields, fault = self._record(text, at, _BARE_LINE, ",\n")
        line = text.find("\n", at)
        line = len(text) if line < 0 else line
        got = fault or self._typed(at, fields)
        if isinstance(got, Fault) and end > line and (fault or self.next_anchor(text, at, min(end, at + RECORD_CHARS)) < min(end, at + RECORD_CHARS)):
            return line, line + 1, fault or Fault(at, "quoting", 0, "the quote opens a field that holds a sound record")
        if fault:
            return line, line + 1, fault
        return end, end + 1, got

    def parse_text(self, text: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, str, list | Fault]]:
        """All records that start in [start, stop): offset, source text, values or the fault. Never raises."""
        stop = len(text) if stop is None else stop
        while start < stop:
            end, after, got = self.step(text, start)
            yield start, text[start:end], got
            start = after

    def follow(self, text: str, start: int, stop: int) -> int:
        """The first record start at or after ``stop`` when records are read from ``start`` on. Lines before the next quote are records, so they need no parsing."""
        while start < stop:
            quote = text.find('"', start)
            if quote < 0 or quote >= stop:
                line = text.find("\n", stop - 1)
                if quote < 0 or line < quote:
                    return len(text) + 1 if line < 0 else line + 1
            start = max(start, text.rfind("\n", start, quote) + 1)
            if start < stop:
                start = self.step(text, start)[1]
        return start


def parse_rows(df: DataFrame, raw: str, columns: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """Parse column ``raw``, one record a row, by the grammar.

    Returns ``keep`` and raw, then ``parsed`` (a struct of the typed columns, null for rows at fault), ``reason``,
    ``fault_offset``, ``fault_field`` and ``message`` (null for sound rows). Every input row comes out once: repeated
    rows repeat, an empty table gives an empty one, a null or empty text is at fault (``columns``). One pass, no
    shuffle; other columns of ``df`` are not read, so that their names cannot clash.
    """
    grammar = RecordGrammar(columns)
    kept = df.select(*keep, F.col(raw).alias(free_name(keep, raw)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    fields = ", ".join(f"`{n}`:{k}" for n, k in columns)
    names, last = [n for n, _ in columns], len(keep)
    struct = pa.struct([(n, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[k]) for n, k in columns])

    def run(batches):
        for batch in batches:
            got = [grammar.parse_record(x) for x in batch.column(last).to_pylist()]
            faults = [g if isinstance(g, Fault) else None for g in got]
            added = [
                pa.array([dict(zip(names, g)) if isinstance(g, list) else None for g in got], struct),
                pa.array([f and f.reason for f in faults], pa.string()),
                pa.array([f and f.offset for f in faults], pa.int32()),
                pa.array([f and f.field for f in faults], pa.int32()),
                pa.array([f and f.message for f in faults], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "parsed", "reason", "fault_offset", "fault_field", "message"])

    return kept.mapInArrow(run, f"{schema}, parsed struct<{fields}>, reason string, fault_offset int, fault_field int, message string")


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1))
    return system.open_input_file(name)


def _lines(source, start: int, end: int, length: int, more: int) -> tuple[int, str]:
    """The lines of a file that start in [start, end), and those within ``more`` bytes after: position of the first, text. One character a byte."""
    first = max(0, start - 1)
    source.seek(first)
    data = source.read(min(length, end + more) - first)
    while first + len(data) < length and b"\n" not in data[end + more - first - 1 :]:
        data += source.read(1 << 16)
    last = data.rfind(b"\n")
    if first + len(data) < length and last >= 0:
        data = data[: last + 1]
    skip = data.find(b"\n") + 1 if start else 0
    if start and not skip:
        return length, ""
    return first + skip, data[skip:].decode("latin-1")


def read_files(spark: SparkSession, path: str, columns: list[tuple[str, str]], header: bool = True, chunk_bytes: int = 32 << 20, encoding: str = "utf-8") -> DataFrame:
    """Read delimited files whose quotes may be broken, in parallel within a file.

    Files are cut into byte ranges; a range's records are those that start in it, and a record over a cut is read whole by the range it starts in. The rows are
    those of reading each file from its start to its end, whatever ``chunk_bytes`` is: ranges begin at their first anchor on trial, and those that the range before does not lead to
    are followed again from where it does. Returns file, offset (in bytes), raw, parsed, reason, message. With ``header`` the
    first line of each file is left out. Lines may end in CR LF. Files without records give no rows.

    The encoding must be one in which the bytes of commas, quotes, digits and line ends stand for nothing else (UTF-8, Latin and Windows code pages). Positions are
    found in bytes and only whole fields are decoded, so that no character is cut; bytes that are none become the replacement character. A line, and
    a quoted field of :data:`RECORD_CHARS`, must fit in a task.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(length - 1) div {int(chunk_bytes)}"))).alias("k")
    ranges = files.select("path", "length", number).repartition("path", "k")
    grammar, names = RecordGrammar(columns), [n for n, _ in columns]
    fields = ", ".join(f"`{n}`:{k}" for n, k in columns)
    texts = [i for i, (_, k) in enumerate(columns) if k == "string"]

    def text_of(source, k: int, length: int, entry: int | None) -> tuple[int, str, int, int]:
        """Position of the text, the text, and in it the first record start and the end of the range."""
        end = min((k + 1) * chunk_bytes, length)
        base, text = _lines(source, k * chunk_bytes, end, length, 2 * RECORD_CHARS)
        if k == 0:
            at = text.find("\n") + 1 or len(text) if header else 0
        elif entry is None:
            at = 0 if grammar.sound_at(text, 0) else grammar.next_anchor(text, 0, max(0, end - base))
        else:
            at = entry - base
        return base, text, at, end - base

    def trace(batches):
        for pdf in batches:
            entries, exits = [], []
            for p, length, k, entry in zip(pdf["path"], pdf["length"], pdf["k"], pdf["entry"]):
                end = min((k + 1) * chunk_bytes, length)
                if entry >= end:
                    entries.append(entry)
                    exits.append(entry)
                    continue
                with _open(p) as source:
                    base, text, at, stop = text_of(source, k, length, None if entry < 0 else entry)
                entries.append(base + at)
                exits.append(min(length, base + grammar.follow(text, at, stop)) if at < stop else base + at)
            yield pdf.assign(entry=entries, exit=exits)

    schema = "path string, length bigint, k bigint, entry bigint, exit bigint"
    known = spill(ranges.withColumn("entry", F.lit(-1).cast("bigint")).mapInPandas(trace, schema))
    while True:
        before = known.select("path", (F.col("k") + 1).alias("k"), F.col("exit").alias("led"))
        chain = known.join(before, ["path", "k"], "left")
        lost = spill(chain.where("led <> entry").select("path", "length", "k", F.col("led").alias("entry")))
        if not rows_of(lost):
            break
        again = lost.repartition("path", "k").mapInPandas(trace, schema)
        after = spill(known.join(lost.select("path", "k"), ["path", "k"], "left_anti").select("path", "length", "k", "entry", "exit").unionByName(again))
        drop(known)
        drop(lost)
        known = after

    def decoded(x: str) -> str:
        return x if x.isascii() else x.encode("latin-1").decode(encoding, "replace")

    def run(batches):
        for pdf in batches:
            for p, length, k, entry in zip(pdf["path"], pdf["length"], pdf["k"], pdf["entry"]):
                rows = []
                with _open(p) as source:
                    base, text, at, stop = text_of(source, k, length, entry)
                for at, raw, got in grammar.parse_text(text, at, min(stop, len(text))):
                    bad = isinstance(got, Fault)
                    if not bad:
                        for i in texts:
                            got[i] = decoded(got[i])
                    rows.append((p, base + at, decoded(raw.removesuffix("\r")), None if bad else dict(zip(names, got)), got.reason if bad else None, got.message if bad else None))
                yield pd.DataFrame(rows, columns=["file", "offset", "raw", "parsed", "reason", "message"])

    whole_schema = f"file string, offset bigint, raw string, parsed struct<{fields}>, reason string, message string"
    return known.where("entry < exit").repartition("path", "k").mapInPandas(run, whole_schema)
