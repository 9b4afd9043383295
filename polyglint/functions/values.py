"""Strings, counters, lists and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_from(column: Column, size: Column) -> Column:
    """A 0-based index in which negatives count from the end."""
    return F.when(column < 0, column + size).otherwise(column)


def get_range(text: Column, start: int, end: int) -> Column:
    """Bytes start to end, both included, negatives from the end, as a string."""
    size = F.octet_length(text)
    a = F.greatest(index_from(F.lit(start), size), F.lit(0))
    b = F.least(index_from(F.lit(end), size), size - 1)
    cut = F.substring(F.encode(text, "UTF-8"), a + 1, F.greatest(b - a + 1, F.lit(0)))
    return F.when((size == 0) | (a > b), F.lit("")).otherwise(F.decode(cut, "UTF-8"))


def set_range(text: Column, offset: int, part: str) -> Column:
    """The text with `part` over its bytes from `offset`, zero bytes before it where the text is shorter (single-byte text)."""
    padded = F.rpad(text, F.greatest(F.length(text), F.lit(offset)), "\0")
    return F.concat(F.substring(padded, 1, offset), F.lit(part), F.substring(padded, F.lit(offset + len(part) + 1), F.length(padded) + 1))


def format_score(score: Column) -> Column:
    """Integral doubles as long text, infinities as inf and -inf."""
    return F.when(score == float("inf"), "inf").when(score == float("-inf"), "-inf").when(score == F.rint(score), score.cast("long").cast("string")).otherwise(score.cast("string"))


def list_range(items: Column, start: int, stop: int) -> Column:
    """Items start to stop, both included, negatives from the end; empty if none."""
    size = F.size(items)
    a = F.greatest(index_from(F.lit(start), size), F.lit(0))
    b = F.least(index_from(F.lit(stop), size), size - 1)
    return F.when(a > b, F.slice(items, 1, 0)).otherwise(F.slice(items, F.least(a, F.greatest(size - 1, F.lit(0))) + 1, F.greatest(b - a + 1, F.lit(0))))


def list_index(items: Column, index: int) -> Column:
    """One item or null."""
    return F.get(items, index_from(F.lit(index), F.size(items)))


def list_set(items: Column, index: int, value: Column) -> Column:
    return F.transform(items, lambda x, i: F.when(i == index_from(F.lit(index), F.size(items)), value).otherwise(x))


def list_insert(items: Column, pivot: Column, value: Column, before: bool) -> Column:
    """`value` beside the first item equal to `pivot`; unchanged if there is none."""
    at = F.array_position(items, pivot)
    place = (at if before else at + 1).cast("int")
    return F.when(at == 0, items).otherwise(F.concat(F.slice(items, F.lit(1), F.greatest(place - 1, F.lit(0))), F.array(value), F.slice(items, F.greatest(place, F.lit(1)), F.greatest(F.size(items) - place + 1, F.lit(0)))))


def list_remove(items: Column, count: int, value: Column) -> Column:
    """Without the first `count` items equal to `value`, the last -count if negative, all if 0."""
    if count == 0:
        return F.filter(items, lambda x: x != value)
    view = items if count > 0 else F.reverse(items)
    nth = lambda i: F.size(F.filter(F.slice(view, F.lit(1), i + 1), lambda y: y == value))
    kept = F.filter(view, lambda x, i: (x != value) | (nth(i) > abs(count)))
    return kept if count > 0 else F.reverse(kept)


def map_set(fields: Column, key: Column, value: Column, only_new: bool = False) -> Column:
    """The map with one field set; with only_new an existing field stays."""
    rest = F.map_filter(fields, lambda k, v: k != key)
    changed = F.map_concat(rest, F.create_map(key, value))
    return F.when(F.map_contains_key(fields, key), fields).otherwise(changed) if only_new else changed


def map_delete(fields: Column, *keys: str) -> Column:
    return F.map_filter(fields, lambda k, v: ~k.isin(*keys))


def capped_increment(value: Column, delta: int) -> Column:
    """value + delta as longs; overflow raises under ANSI arithmetic."""
    return value.cast("long") + F.lit(delta).cast("long")
