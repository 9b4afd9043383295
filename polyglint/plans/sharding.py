"""Shards of a numeric key range, pruning, advice on pushdown, routes of keys, and results cached by watermark."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


class Shard(NamedTuple):
    shard: int
    region: str
    start: int
    end: int


def plan_shards(n: int, regions: list[str], low: int, high: int) -> list[Shard]:
    """[low, high) in n even ranges, the last with the rest, dealt to regions in turn."""
    width = max((high - low) // n, 1)
    return [Shard(i, regions[i % len(regions)], low + i * width, high if i == n - 1 else low + (i + 1) * width) for i in range(n)]


def prune(shards: list[Shard], start: int, end: int) -> list[Shard]:
    """Shards that [start, end) meets."""
    return [s for s in shards if s.start < end and start < s.end]


def shard_column(column: Column, shards: list[Shard]) -> Column:
    """The shard of a numeric key; null outside all."""
    return F.coalesce(*(F.when((column >= s.start) & (column < s.end), F.lit(s.shard)) for s in shards))


def push_down(rows: int, local_cost: float, transfer_cost: float, overhead: float) -> bool:
    """Whether work beside the data pays: its cost is above that of sending the rows."""
    return rows * local_cost > rows * transfer_cost + overhead


_FNV_OFFSET, _FNV_PRIME = 0x811C9DC5, 0x01000193


def java_hash(column: Column) -> Column:
    """The 31-polynomial hash of a string's UTF-16 units as a signed 32-bit integer (characters of the basic plane)."""
    codes = F.transform(F.split(column, ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    return F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total).cast("int")


def fnv_route(column: Column, n: int) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes, modulo n."""
    hexed = F.hex(F.encode(column, "UTF-8"))
    bytes_ = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 2).cast("int") - 1), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    digest = F.aggregate(bytes_, F.lit(_FNV_OFFSET).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(b) * _FNV_PRIME, F.lit(1 << 32)))
    return F.pmod(F.when(F.length(hexed) == 0, F.lit(_FNV_OFFSET)).otherwise(digest), F.lit(n)).cast("int")


def hash_slot(column: Column, slots: int = 16_384) -> Column:
    """CRC16 (XMODEM: polynomial 0x1021) of the UTF-8 bytes, or of what stands between the first braces, modulo the slots."""
    tag = F.regexp_extract(column, r"\{([^}]+)\}", 1)
    hexed = F.hex(F.encode(F.when(tag != "", tag).otherwise(column), "UTF-8"))
    bits = F.sequence(F.lit(0), F.length(hexed) * 4 - 1)

    def step(crc: Column, i: Column) -> Column:
        nibble = F.conv(F.substring(hexed, F.floor(i / 4).cast("int") + 1, F.lit(1)), 16, 10).cast("int")
        bit = F.call_function("getbit", nibble, 3 - F.pmod(i, F.lit(4)))
        top = F.call_function("getbit", crc, F.lit(15))
        moved = (crc * 2).bitwiseAND(F.lit(0xFFFF))
        return F.when(bit != top, moved.bitwiseXOR(F.lit(0x1021))).otherwise(moved)

    crc = F.aggregate(bits, F.lit(0), step)
    return F.when(F.length(hexed) == 0, F.lit(0)).otherwise(F.pmod(crc, F.lit(slots))).cast("int")


@dataclass
class QueryCache:
    """Persisted results by query name; one is current only for the watermark that it was put with."""

    def __post_init__(self) -> None:
        self._held: dict[str, tuple[int, DataFrame]] = {}

    def get(self, name: str, watermark: int) -> DataFrame | None:
        held = self._held.get(name)
        return held[1] if held and held[0] == watermark else None

    def put(self, name: str, watermark: int, rows: DataFrame) -> DataFrame:
        self.invalidate(name)
        self._held[name] = watermark, rows.persist(StorageLevel.DISK_ONLY)
        return self._held[name][1]

    def invalidate(self, name: str) -> None:
        if held := self._held.pop(name, None):
            held[1].unpersist()
