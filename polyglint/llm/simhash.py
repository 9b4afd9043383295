"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyglint.llm.common import bounded, written
from polyglint.llm.components import connected_components

SHINGLE_WORDS, MAX_DISTANCE, SEED = 3, 2, 42
#: Shingles hashed at a time, so that a very long text needs no more memory than this many.
CHUNK = 1 << 16


def simhash(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of one text: a bit is 1 if more than half of the shingle hashes have it.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are joined by one space and counted with
    repeats. Fewer words than a shingle make one shingle; no word at all (null, empty, blank) gives 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    total = max(1, len(words) - shingle_words + 1)
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    ones = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = words[at : min(at + CHUNK, total) + shingle_words - 1]
        grams = zip(*(part[k:] for k in range(shingle_words)), strict=False) if len(words) >= shingle_words else [words]
        hashes = np.fromiter((hashed(g, SEED) for g in map(join, grams)), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp): one row per input row; fp is the fingerprint's bits as a signed long."""

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter((simhash(t, shingle_words) for t in texts), np.uint64, len(texts)).view(np.int64))

    fp = F.pandas_udf(scored, T.LongType())
    return docs.select(F.col(id_col).alias("id"), fp(F.col(text_col)).alias("fp"))


def near_links(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints (column fp, unique) that differ in 1..max_distance bits.

    The fingerprint has two 32-bit segments. At distance r, either the upper segments differ in at most r // 2 bits or
    the lower ones in less than r - r // 2. Each segment has a table; every fingerprint looks up all values in the
    Hamming ball of that radius around each of its segments, and full distances are verified on what is fetched.
    Candidates meet on an equality key, so nothing is compared with everything; a crowded key is split by the
    adaptive skew join.
    """
    radius = (max_distance // 2, max_distance - max_distance // 2 - 1)
    upper, lower = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    tagged = [s.bitwiseOR(F.lit(k << 32)) for k, s in enumerate((upper, lower))]
    stored = prints.select(F.explode(F.array(*tagged)).alias("key"), F.col("fp").alias("b"))
    looked_up = [t.bitwiseXOR(F.lit(mask)) for t, r in zip(tagged, radius, strict=True) for mask in _ball(r)]
    probes = prints.select(F.explode(F.array(*looked_up)).alias("key"), F.col("fp").alias("a"))
    return probes.join(stored, "key").where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance).select("a", "b").distinct()


def _ball(radius: int) -> list[int]:
    """All 32-bit masks with at most `radius` bits."""
    masks = {0}
    for _ in range(max(radius, 0)):
        masks |= {m | 1 << k for m in masks for k in range(32)}
    return sorted(masks) if radius >= 0 else []


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, fp, component_id): one row per input row; component_id is the smallest id reachable over links.

    Equal fingerprints are one node, so groups of exact copies cost one comparison. Null and empty texts have
    fingerprint 0 and link like any other. A null id keeps its row and never names a component unless its whole
    component has none. Repeated rows stay repeated. Empty input gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle_words), "prints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first_id"))
    links = near_links(nodes.select("fp"), max_distance)
    parts = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = written(nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("part")), "placed")
    named = bounded(written(placed.groupBy("part").agg(F.min("first_id").alias("component_id")), "named"))
    return prints.join(placed.join(named, "part").select("fp", "component_id"), "fp").select("id", "fp", "component_id")
