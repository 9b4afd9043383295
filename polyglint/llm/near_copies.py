"""Groups of texts by exact Jaccard similarity of their word shingles: SimHash proposes, a prefix-filtered set join completes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from polyglint.llm.common import BROADCAST_ROWS, HASH_ENTRIES, bounded, fresh, memo, passing, written
from polyglint.llm.components import connected_components, local_links
from polyglint.llm.simhash import CHUNK, SEED, near_links

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Texts whose shingles are counted to find common ones, by number and as a share of all texts (the larger holds), how many of them make a shingle
#: common, and how many of those are noted. With a number alone, what is held for rare would be in ever more texts of a larger input.
#: These only decide in which order shingles are looked at; every order finds the same pairs.
SAMPLE, SHARE, COMMON, NOTED = 8_000, 0.25, 3, 200_000
#: Orders of the nodes, by which a shingle's leader is chosen; a text then has so many leaders in a large group.
LEADERS = 2
#: Texts of one shingle that are compared by blocks instead of pairs, texts of a block, and shingles that are looked at together.
CROWD, BLOCK, COLUMNS = 256, 512, 4_096
#: Parts of the shingles, by hash, that are grouped one after the other, so that the shuffle files of one lie on disk at a time.
SLICES = 4
#: Nodes that one task remembers, to send a text that it meets again only once.
SEEN = 1_000_000
_ODD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    """XXH64 of a word, computed once as long as it is remembered."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text, ascending; words and short texts as in `simhash`, none without a word."""
    split = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not split:
        return np.empty(0, np.int64)
    known = memo("shingles", _WordHashes)
    if len(known) > HASH_ENTRIES:
        known.clear()
    width, found = min(words, len(split)), []
    total = len(split) - width + 1
    with np.errstate(over="ignore"):
        for at in range(0, total, CHUNK):
            part = split[at : min(at + CHUNK, total) + width - 1]
            hashes = np.fromiter(map(known.__getitem__, part), np.uint64, len(part))
            sums = np.full(len(part) - width + 1, width, np.uint64)
            for k in range(width):
                sums = sums * _ODD + hashes[k : k + len(sums)]
            found.append(np.unique(_scrambled(sums).view(np.int64)))
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of distinct shingles, as a signed number: a bit is 1 if more than half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def prefix(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles by rarity, then hash, of which two texts of the given similarity share one at least."""
    if not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
    rarity = np.where(common[at] == hashes, counts[at], 0) if len(common) else np.zeros(len(hashes), np.int64)
    length = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1
    return hashes[np.lexsort((hashes, rarity))[:length]]


def _needed(a: Column, b: Column, similarity: float) -> Column:
    """What two sets of these sizes must share."""
    return similarity / (1 + similarity) * (a + b) - 1e-6


def _may_link(size_a: Column, place_a: Column, size_b: Column, place_b: Column, similarity: float) -> Column:
    """Whether two sets may be similar enough whose first common shingle stands at these places; of those that are, the first common one passes."""
    return F.least(size_a - place_a, size_b - place_b) >= _needed(size_a, size_b, similarity)


def _held(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text_key, size, keys) of these nodes, one row each."""
    return written(prints.where("size(keys) > 0").join(bounded(nodes), "node").groupBy("node").agg(F.min_by(F.struct("text_key", "size", "keys"), "text_key").alias("s")).select("node", "s.*"), "held")


def _sets(held: DataFrame, texts: DataFrame, hashed: Callable[..., Column]) -> DataFrame:
    """(node, hashes) of the held nodes, from their texts."""
    wanted = bounded(written(held.select("node", "text_key"), "wanted"))
    return written(texts.join(wanted, "text_key").groupBy("node").agg(F.min("text").alias("text")).select("node", hashed("text").alias("hashes")), "sets")


def _rest(size: Column, similarity: float) -> Column:
    """How many shingles of a set of this size are not in its `prefix`."""
    return F.ceil(similarity * size - 1e-9) - 1


def _similar(pairs: DataFrame, prints: DataFrame, texts: DataFrame, hashed: Callable[..., Column], similarity: float, sifted: bool = False) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have at least this Jaccard similarity, written.

    What two sets share beyond the shorter prefix is bounded by what is left of one of them, so most pairs fail by their
    prefixes, unless they are `sifted` by that already; whole sets are built only of texts of the others.
    """

    def ends(of: DataFrame) -> DataFrame:
        return written(of.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")

    def both(of: DataFrame, held: DataFrame, *columns: str) -> DataFrame:
        for k in "ab":
            of = of.join(held.select(F.col("node").alias(k), *(F.col(c).alias(c + k) for c in columns)), k)
        return of

    with passing(pairs.sparkSession):
        pairs = written(pairs.select("a", "b"), "pairs")
        if pairs.isEmpty():
            return written(pairs, "links", lasting=True)
        held = _held(prints, ends(pairs))
        if not sifted:
            rest = F.greatest(*(F.col("size" + k) - F.size("keys" + k) for k in "ab"))
            pairs = written(both(pairs, held, "size", "keys").where(F.size(F.array_intersect("keysa", "keysb")) + rest >= _needed(F.col("sizea"), F.col("sizeb"), similarity)).select("a", "b"), "pairs")
        sets = _sets(held if sifted else held.join(ends(pairs), "node"), texts, hashed)
        shared = F.size(F.array_intersect("hashesa", "hashesb"))
        return written(both(pairs, sets, "hashes").where(shared >= similarity * (F.size("hashesa") + F.size("hashesb") - shared) - 1e-9).select("a", "b"), "links", lasting=True)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, use = np.repeat(np.arange(len(sets)), lengths), times[column] > 1
    row, column = row[use], (np.cumsum(times > 1) - 1)[column[use]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int((times > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        out += part @ part.T
    np.fill_diagonal(out, lengths)
    return out


def _crowded(crowds: DataFrame, prints: DataFrame, texts: DataFrame, hashed: Callable[..., Column], similarity: float) -> DataFrame:
    """Links (a, b) that connect the similar nodes of each crowd (node, component), written.

    A crowd is cut into blocks, each two blocks are one task, and a task returns a spanning star of what it connects
    instead of pairs; so the rows are as many as the nodes times the blocks.
    """

    def compared(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node", kind="stable")
        sets, node = [np.asarray(h, np.int64) for h in part["hashes"]], part["node"].to_numpy()
        size, shared = np.array([len(h) for h in sets]), shared_counts(sets)
        near = shared >= similarity * (size[:, None] + size[None, :] - shared) - 1e-9
        root = node[local_links(near)]
        return pd.DataFrame({"a": root, "b": node})[root != node]

    members = crowds.select("node", F.col("component").alias("crowd"))
    with passing(crowds.sparkSession):
        sets = _sets(_held(prints, written(members.select("node"), "members")), texts, hashed)
        return written(_by_blocks(members, sets).applyInPandas(compared, "a long, b long"), "links", lasting=True)


def _by_blocks(members: DataFrame, sets: DataFrame) -> GroupedData:
    """The sets of each crowd's (crowd, node), grouped by pairs of blocks."""
    blocks = members.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(blocks, "crowd").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sets, "node")
    dealt = dealt.select("crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "hashes")
    return dealt.groupBy("crowd", "i", "j")


def _proposed(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that SimHash holds for near copies: the least node of each fingerprint with the others, and with that of each fingerprint that its multi-index finds."""
    nodes = prints.where("size(keys) > 0").select("fp", "node").distinct()
    firsts = written(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints")
    alike = nodes.join(firsts, "fp").where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    links = near_links(firsts.select("fp"))
    for k in "ab":
        links = links.join(firsts.select(F.col("fp").alias(k), F.col("first").alias("first" + k)), k)
    return alike.union(links.select(F.least("firsta", "firstb").alias("a"), F.greatest("firsta", "firstb").alias("b")))


def _meetings(placed: DataFrame, similarity: float) -> DataFrame:
    """(node1, node2, size1, size2, place1, place2), the smaller set first: a row for each key of `placed` that two texts of different parts share whose sizes may be similar.

    Texts meet by key and band of sizes. A band is as wide as similar sets may differ, so a text's larger partners are in its band or the next.
    """
    band = F.floor(F.log("size") / (math.log(1 / similarity) + 1e-6))  # a little wider, whatever the logarithms' last bits are
    columns = [("key", *(F.col(c).alias(c + k) for c in ("node", "size", "place", "part"))) for k in "12"]
    left = placed.select(*columns[0], F.explode(F.array(band, band + 1)).alias("band"))
    ahead = (F.col("size1") < F.col("size2")) | (F.col("size1") == F.col("size2")) & (F.col("node1") < F.col("node2"))
    met = left.join(placed.select(*columns[1], band.alias("band")), ["key", "band"])
    return met.where((F.col("part1") != F.col("part2")) & ahead & (F.col("size1") >= similarity * F.col("size2") - 1e-6)).drop("key", "band", "part1", "part2")


def text_groups(docs: DataFrame, text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(text_key, component): each distinct text by xxhash64 and the group that it reaches over pairs of at least this similarity.

    Texts with equal shingles are one node; null and blank texts have none and are one node too. A text's SimHash over its
    shingles proposes pairs by multi-index hashing, but at this similarity fingerprints differ in about ten bits, so most pairs are
    found by a set join: a pair that is similar enough shares one of the first shingles of both, so texts meet there on an equality
    key. Every proposed pair counts by its exact similarity. The texts of a shingle are compared with a leader first; after
    that, only texts of like sizes whose groups are still apart are compared with each other, so a large group of near copies does not
    cost its square. Shingles are looked at by rarity, counted in a share of all texts, so that few others meet in one. Sets too small for two different ones to be similar enough are in no pair.
    """
    texts = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    total = texts.count()
    if not total:
        return docs.sparkSession.createDataFrame([], "text_key long, component long")

    def listed(column: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, shingle_words) for t in column], dtype=object)

    hashed = F.pandas_udf(listed, "array<long>")
    share = int(min(1.0, max(SAMPLE / total, SHARE)) * 1_000_003)
    drawn = texts.where(F.pmod(F.xxhash64("text_key"), F.lit(1_000_003)) <= share).select(F.explode(hashed("text")).alias("key"))
    often = drawn.groupBy("key").count().where(F.col("count") >= COMMON).orderBy(F.col("count").desc(), "key").limit(NOTED).toPandas().sort_values("key")
    sent = docs.sparkSession.sparkContext.broadcast((often["key"].to_numpy(np.int64), often["count"].to_numpy(np.int64)))
    least = int(np.ceil(similarity / (1 - similarity) - 1e-9)) if similarity < 1 else 1 << 31

    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        common, counts = sent.value
        seen: set[int] = set()
        for column in batches:
            rows = []
            for text in column:
                own = shingles(text, shingle_words)
                node = int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))
                known = len(own) < least or node in seen
                if not known and len(seen) < SEEN:
                    seen.add(node)
                rows.append((node, len(own), 0 if known else fingerprint(own), own[:0] if known else prefix(own, common, counts, similarity)))
            yield pd.DataFrame(rows, columns=["node", "size", "fp", "keys"])

    prints = written(texts.select("text_key", F.pandas_udf(sketched, "node long, size int, fp long, keys array<long>")("text").alias("s")).select("text_key", "s.*"), "sketches")
    postings = prints.select(F.posexplode("keys").alias("place", "key"), "node", "size")
    turn = F.xxhash64("node", F.pmod("key", F.lit(LEADERS))).alias("turn")
    slices = []
    for k in range(SLICES):
        part = postings.where(F.pmod("key", F.lit(SLICES)) == k)
        leaders = part.groupBy("key").agg(F.min(F.struct(turn, "node", "size", "place")).alias("leader"), F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "leader")
        with passing(docs.sparkSession):
            slices.append(written(part.join(written(leaders, "leaders"), "key"), "postings", lasting=True))
    met = reduce(DataFrame.union, slices)

    # Each text with what SimHash proposes and with the leader of each of its shingles.
    def beside(rows: DataFrame) -> DataFrame:
        found = rows.where(_may_link(*map(F.col, ("size", "place", "leader.size", "leader.place")), similarity))
        return found.select(F.least("leader.node", "node").alias("a"), F.greatest("leader.node", "node").alias("b"))

    def joined(links: DataFrame) -> DataFrame:
        return written(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), together=BROADCAST_ROWS), "parts")

    compared = written(beside(met.where("node != leader.node")).union(_proposed(prints)).distinct(), "compared")
    links = _similar(compared, prints, texts, hashed, similarity)

    # Then the texts of a shingle whose groups are still apart, with each other: few by pairs, many by blocks. A pair counts the shingles
    # of both prefixes that it meets in; those it does not meet in, as they have many texts, put it into blocks as well.
    placed = met.join(joined(links), "node", "left").select("key", "node", "size", "place", F.coalesce("component", "node").alias("part"))
    apart = placed.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("least < most")
    placed = written(placed.join(apart.select("key", "n", "first"), "key"), "apart")
    near = _may_link(*map(F.col, ("size1", "place1", "size2", "place2")), similarity)
    crossed = _meetings(placed.where(F.col("n") < CROWD), similarity).groupBy("node1", "node2", "size1", "size2").agg(F.max(near).alias("near"), F.count(F.lit(1)).alias("shared"))
    rest = F.greatest(*(_rest(F.col(c), similarity) for c in ("size1", "size2")))
    crossed = crossed.where(F.col("near") & (F.col("shared") + rest >= _needed(F.col("size1"), F.col("size2"), similarity))).select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b"))
    more = _similar(crossed.join(compared, ["a", "b"], "left_anti"), prints, texts, hashed, similarity, sifted=True)
    crowds = written(placed.where(F.col("n") >= CROWD).select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "crowds")
    if not crowds.isEmpty():
        more = more.union(_crowded(joined(crowds), prints, texts, hashed, similarity))
    ends = joined(links.union(more))
    return prints.select("text_key", "node").distinct().join(ends, "node", "left").select("text_key", F.coalesce("component", "node").alias("component"))


def first_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The row with the least id of each group of near copies; of equal ids that of the least text hash, and a null id only where the group has no other.

    Of rows alike in id and text one stays. Texts stay where they are: only the marks of rows that go meet them, and those are
    broadcast only while they are few.
    """
    key, own, again = (fresh(docs, n) for n in ("text_key", "marked_id", "again"))
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    with passing(docs.sparkSession):
        with passing(docs.sparkSession):
            groups = written(text_groups(docs, text_col, shingle_words, similarity), "groups", lasting=True)
        rows = keyed.groupBy(F.col(key).alias("text_key"), F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n")).join(groups, "text_key")
        rows = written(rows, "rows")
        firsts = bounded(written(rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("first")), "firsts"))
        stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))
        marks = written(rows.join(firsts, "component").where(~stays | (F.col("n") > 1)).select(F.col("text_key").alias(key), F.col("id").alias(own), stays.alias(again)), "marks", lasting=True)
    found = keyed.join(bounded(marks).withColumnRenamed(key, key + "_"), (F.col(key) == F.col(key + "_")) & F.col(id_col).eqNullSafe(F.col(own)), "left")
    kept = found.where(F.col(again).isNull()).select(docs.columns)
    if marks.where(again).isEmpty():
        return kept
    return kept.union(found.where(again).dropDuplicates([key]).select(docs.columns))
