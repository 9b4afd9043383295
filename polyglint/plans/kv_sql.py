"""The SQL subset over one table kv(key, value): parsing, execution, explanation, and buffered transactions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyglint.sources.versions import snapshot_read, snapshot_scan

_TEXT = r"'([^']*)'"
_SELECT = re.compile(rf"select \* from kv(?: where (?:key\s*=\s*{_TEXT}|key\s*>=\s*{_TEXT}(?: and key\s*<\s*{_TEXT})?))?(?: limit (\d+))?")
_WRITES = {
    "SET": re.compile(rf"set\s+{_TEXT}\s*=\s*{_TEXT}", re.IGNORECASE),
    "DELETE": re.compile(rf"delete\s+from\s+kv\s+where\s+key\s*=\s*{_TEXT}", re.IGNORECASE),
}


class SqlError(ValueError):
    """kind: SYNTAX, TYPE, UNKNOWN_COLUMN or INTERNAL."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


@dataclass(frozen=True)
class Select:
    key: str | None = None
    start: str | None = None
    end: str | None = None
    limit: int | None = None


def parse(sql: str) -> Select:
    """The whole text is lower-cased, quoted strings too."""
    text = re.sub(r"\s+", " ", sql.strip().rstrip(";").strip().lower())
    if not (m := _SELECT.fullmatch(text)):
        raise SqlError("SYNTAX", sql)
    key, start, end, limit = m.groups()
    return Select(key, start, end, None if limit is None else int(limit))


def execute(sql: str | Select, versions: DataFrame, read_ts: int | None = None) -> DataFrame:
    """Rows as of `read_ts`: a point read, which ignores LIMIT, or a range in key order."""
    s = parse(sql) if isinstance(sql, str) else sql
    if s.key is not None:
        return snapshot_read(versions, s.key, read_ts)
    found = snapshot_scan(versions, s.start, s.end, read_ts)
    return found if s.limit is None else found.limit(s.limit)


def explain(sql: str) -> str:
    s = parse(sql)
    steps = ["SCAN kv"]
    if s.key is not None:
        steps.append(f"FILTER key = '{s.key}'")
    elif s.start is not None:
        steps.append(f"FILTER key >= '{s.start}'" + (f" AND key < '{s.end}'" if s.end is not None else ""))
    return " -> ".join(steps + ([f"LIMIT {s.limit}"] if s.limit is not None and s.key is None else []))


def error_kind(error: Exception) -> str:
    if isinstance(error, SqlError):
        return error.kind
    if isinstance(error, ParseException):
        return "SYNTAX"
    condition = error.getCondition() or "" if isinstance(error, AnalysisException) else ""
    if "UNRESOLVED_COLUMN" in condition:
        return "UNKNOWN_COLUMN"
    return "TYPE" if "DATATYPE_MISMATCH" in condition or "CAST" in condition else "INTERNAL"


def transaction_writes(script: list[str]) -> list[tuple[str, str | None]]:
    """(key, value or None for a deletion) of all committed statements, in order."""
    done: list[tuple[str, str | None]] = []
    buffer: list[tuple[str, str | None]] | None = None
    for line in script:
        word = line.strip().rstrip(";").strip()
        name = word.split(" ", 1)[0].upper()
        if name == "BEGIN":
            if buffer is not None:
                raise SqlError("SYNTAX", "a transaction is open")
            buffer = []
            continue
        if buffer is None:
            raise SqlError("SYNTAX", "no transaction is open")
        if name in ("COMMIT", "ROLLBACK"):
            done += buffer if name == "COMMIT" else []
            buffer = None
        elif name in _WRITES and (m := _WRITES[name].fullmatch(word)):
            buffer.append((m[1], m[2] if name == "SET" else None))
        else:
            raise SqlError("SYNTAX", line)
    return done


def fold_operations(operations: DataFrame) -> DataFrame:
    """(key, value) after operations (txn, seq, kind, key, value): those of committed transactions, the last of each key."""
    committed = operations.where("kind = 'COMMIT'").select("txn").distinct()
    writes = operations.where("kind in ('SET', 'DELETE')").join(committed, "txn", "left_semi")
    last = writes.groupBy("key").agg(F.max_by(F.struct("kind", "value"), "seq").alias("w"))
    return last.where("w.kind = 'SET'").select("key", "w.value")
