"""Token ids of documents in raw binary shards, with a minimal perfect hash index from document keys to offsets.

A shard is two files. `<name>.ids`: the ids of its documents, one after the other, little-endian and unsigned, of 16 bits
if the vocabulary allows, else of 32. `<name>.index`: fixed-width little-endian records, so that any of them is read by its
place: a header (HEAD bytes: width of an id, rows, keys, levels, then the bits of each level), for each 64 bits of the perfect hash
the bits and the number of ones before them, for each slot the first row of its key and a 32-bit fingerprint of it, and for
each row its key, whether it has one, and where its ids begin (one more row ends the last). Rows ascend by their keys.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyglint.llm.common import MOST_TASKS, new_path, written
from polyglint.llm.perfect_hash import PerfectHash, mix
from polyglint.llm.segments import SegmentMemo, ragged_ranges, ragged_take

#: A shard is closed when its payload has so many bytes or it has so many documents.
SHARD_BYTES, SHARD_DOCS = 64 << 20, 1 << 20
MANIFEST = "part int, seq int, name string, n_docs long, n_ids long, first_id long, last_id long"
_FINGERPRINT_SEED = 1_000_003
HEAD = 2048
_WORDS, _SLOTS, _ROWS = np.dtype([("bits", "<u8"), ("before", "<i8")]), np.dtype([("row", "<u4"), ("print", "<u4")]), np.dtype([("key", "<i8"), ("valid", "<i8"), ("start", "<i8")])

#: Segments that go to the tokenizers library as one text.
TOGETHER = 64

#: Ends of words whose ids a worker remembers.
MOST_ENDS = 10_000

#: What may end a word, and the letters and digits (of Latin alone, as versions of Unicode agree on them) after which it is a pre-token of its own.
_ENDS, _BEFORE_END = ",.;:!?", frozenset(c for c in map(chr, range(0x100)) if re.match("[0-9A-Za-zÀ-ÖØ-öø-ÿ]", c))

#: The white space of the byte-level pre-tokeniser's pattern.
_WHITE = "\t-\r \x85\xa0  -     　"


class ByteTokenizer:
    """A byte-level BPE of the tokenizers library, applied to the segments between which no pre-token reaches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size()
        self.segment = re.compile(rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]")
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)")
        alone = self.library.encode("\n", add_special_tokens=False).ids
        self.line_feed = alone[0] if len(alone) == 1 and self.library.normalizer is None and not any("\n" in t.content for t in self.library.get_added_tokens_decoder().values()) else None
        cuts = json.loads(self.library.pre_tokenizer.__getstate__()) if self.library.pre_tokenizer else {}
        self.ends = SegmentMemo(self._encoded, self.segment.findall, re.compile("(?!)"), MOST_ENDS) if self.library.normalizer is None and (cuts.get("type"), cuts.get("use_regex"), cuts.get("add_prefix_space")) == ("ByteLevel", True, False) else None
        self.memo = SegmentMemo(self.encode_new, self.segment.findall, re.compile(rf"(?<=[^{_WHITE}]) (?=[^{_WHITE}])"))

    def encode_new(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the memo's new segments, and how many each has.

        Where the pre-tokeniser is known to cut commas and the like off the end of a word, a word that the memo has is not encoded again with them.
        """
        if self.ends is None:
            return self.encode_segments(segments)
        known, joined, bases, ends = self.memo.row.get, [], [], []
        for i in [i for i, segment in enumerate(segments) if segment[-1] in _ENDS]:
            base = segments[i].rstrip(_ENDS)
            if (row := known(base)) is not None and base[-1] in _BEFORE_END:
                joined.append(i)
                bases.append(row)
                ends.append(segments[i][len(base) :])
        if not joined:
            return self.encode_segments(segments)
        first, joined, bases, ends = len(self.memo.row) - len(segments), np.array(joined), np.array(bases), self.ends.rows(ends)
        whole = np.ones(len(segments), bool)
        whole[joined] = False
        flat, counts = self.encode_segments(list(compress(segments, whole)))
        lengths, old = np.empty(len(segments), np.int64), bases < first
        lengths[whole] = counts
        of_base, of_end = np.empty(len(bases), np.int64), self.ends.lengths[ends]
        of_base[old], of_base[~old] = self.memo.lengths[bases[old]], lengths[bases[~old] - first]
        lengths[joined] = of_base + of_end
        starts, ids = np.cumsum(lengths) - lengths, np.empty(int(lengths.sum()), np.int32)
        ids[np.repeat(whole, lengths)] = flat
        at = starts[joined]
        ids[ragged_ranges(at[old], of_base[old])] = ragged_take(self.memo.flat, self.memo.starts[bases[old]], of_base[old])
        ids[ragged_ranges(at[~old], of_base[~old])] = ragged_take(ids, starts[bases[~old] - first], of_base[~old])
        ids[ragged_ranges(at + of_base, of_end)] = ragged_take(self.ends.flat, self.ends.starts[ends], of_end)
        return ids, lengths

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all segments, and how many each has.

        Segments without white space but for a leading space go to the library TOGETHER at a time, each ended by a line feed, which no pre-token
        of these reaches over; a call for each costs more than its merges. Where the line feeds do not come back as they went, each goes by itself.
        """
        if self.line_feed is None:
            return self._encoded(segments)
        white = np.fromiter(map(str.isspace, segments), bool, len(segments))
        words = list(compress(segments, ~white))
        flat, _ = self._encoded(["\n".join([*words[k : k + TOGETHER], ""]) for k in range(0, len(words), TOGETHER)])
        ends = np.flatnonzero(flat == self.line_feed)
        if len(ends) != len(words):
            return self._encoded(segments)
        spaces, n_spaces = self._encoded(list(compress(segments, white)))
        lengths = np.empty(len(segments), np.int64)
        lengths[white], lengths[~white] = n_spaces, np.diff(ends, prepend=-1) - 1
        ids, of_spaces = np.empty(int(lengths.sum()), np.int32), np.repeat(white, lengths)
        ids[of_spaces], ids[~of_spaces] = spaces, flat[flat != self.line_feed]
        return ids, lengths

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum())), lengths

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. A text with an added token's string goes to the library whole, which cuts there first."""
        plain: list[str] = []
        for text in texts:
            if self.special.search(text):
                yield from self.memo.ids(plain)
                plain = []
                yield np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
            else:
                plain.append(text)
        yield from self.memo.ids(plain)


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def _tokenizer(path: str) -> ByteTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteTokenizer(path)
    return _TOKENIZERS[path]


def _print(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64), _FINGERPRINT_SEED) >> np.uint64(32)).astype(np.uint32)


def index_bytes(keys: np.ndarray, valid: np.ndarray, offsets: np.ndarray, width: int) -> bytes:
    """The index file of one shard; equal keys are neighbours, and the first of them is indexed."""
    first = valid & np.concatenate([[True], (keys[1:] != keys[:-1]) | ~valid[:-1]])[: len(keys)]
    firsts = np.flatnonzero(first)
    found = PerfectHash.build(keys[firsts].view(np.uint64))
    at = found.slots(keys[firsts].view(np.uint64))
    words, slots, rows = np.zeros(len(found.bits), _WORDS), np.zeros(len(firsts), _SLOTS), np.zeros(len(keys) + 1, _ROWS)
    words["bits"], words["before"] = found.bits, found.before[:-1]
    slots["row"][at], slots["print"][at] = firsts, _print(keys[firsts])
    rows["key"][:-1], rows["valid"][:-1], rows["start"] = keys, valid, offsets
    head = np.array([width, len(keys), len(firsts), len(found.sizes), *found.sizes], "<i8").tobytes()
    if len(head) > HEAD:
        raise ValueError("the perfect hash has too many levels")
    return b"".join([head.ljust(HEAD, b"\0"), words.tobytes(), slots.tobytes(), rows.tobytes()])


class Shard:
    """One shard. `load` reads the whole index, for scans; `row_of` and `record` read a few records by their places, however large the shard is."""

    def __init__(self, root: str, name: str):
        self.files, self.base = arrow_fs.FileSystem.from_uri(root)
        self.name, self.bytes_read = name, 0
        self.index = self.files.open_input_file(f"{self.base}/{name}.index")
        head = np.frombuffer(self._at(0, HEAD), "<i8")
        self.width, self.n_rows, self.n_keys, levels = (int(x) for x in head[:4])
        self.sizes = head[4 : 4 + levels]
        self.kind, self.words_at = f"<u{self.width}", HEAD
        self.slots_at = self.words_at + int(self.sizes.sum()) // 64 * _WORDS.itemsize
        self.rows_at = self.slots_at + self.n_keys * _SLOTS.itemsize

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_: object) -> None:
        self.index.close()

    def _at(self, start: int, size: int) -> bytes:
        self.bytes_read += size
        return self.index.read_at(size, start)

    def load(self) -> None:
        words, slots, rows = (np.frombuffer(self._at(a, z - a), kind) for a, z, kind in ((self.words_at, self.slots_at, _WORDS), (self.slots_at, self.rows_at, _SLOTS), (self.rows_at, self.rows_at + (self.n_rows + 1) * _ROWS.itemsize, _ROWS)))
        self.found, self.row, self.prints = PerfectHash(self.sizes, words["bits"].copy()), slots["row"].astype(np.int64), slots["print"].copy()
        self.keys, self.valid, self.offsets = rows["key"][:-1].copy(), rows["valid"][:-1] == 1, rows["start"].copy()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First row of each key (signed 64-bit) in the loaded index, -1 for keys that the shard does not hold."""
        slots = self.found.slots(keys.view(np.uint64))
        hit = slots >= 0
        hit[hit] = self.prints[slots[hit]] == _print(keys[hit])
        out = np.full(len(keys), -1, np.int64)
        out[hit] = self.row[slots[hit]]
        hit[hit] = self.keys[out[hit]] == keys[hit]
        return np.where(hit, out, -1)

    def record(self, row: int) -> tuple[int, bool, int, int]:
        """Key of a row, whether it has one, and where its ids begin and end."""
        this, after = np.frombuffer(self._at(self.rows_at + row * _ROWS.itemsize, 2 * _ROWS.itemsize), _ROWS).tolist()
        return this[0], this[1] == 1, this[2], after[2]

    def row_of(self, key: int) -> int:
        """First row of a key, -1 if the shard does not hold it: a word for each level asked (two or three as a rule), a slot, and
        the row's own key where the fingerprint fits."""
        own, first = np.array([key], np.int64), 0
        for level, size in enumerate(self.sizes.tolist()):
            bit = first + int(mix(own.view(np.uint64), level)[0] % np.uint64(size))
            bits, before = np.frombuffer(self._at(self.words_at + bit // 64 * _WORDS.itemsize, _WORDS.itemsize), _WORDS)[0].item()
            if bits >> bit % 64 & 1:
                slot = before + (bits & (1 << bit % 64) - 1).bit_count()
                row, mark = np.frombuffer(self._at(self.slots_at + slot * _SLOTS.itemsize, _SLOTS.itemsize), _SLOTS)[0].item()
                return row if mark == int(_print(own)[0]) and self.record(row)[0] == key else -1
            first += size
        return -1

    def read(self, start: int, stop: int) -> np.ndarray:
        with self.files.open_input_file(f"{self.base}/{self.name}.ids") as f:
            return np.frombuffer(f.read_at((stop - start) * self.width, start * self.width), self.kind)


class _Writer:
    def __init__(self, root: str, part: int, width: int):
        self.files, self.base = arrow_fs.FileSystem.from_uri(root)
        self.files.create_dir(self.base, recursive=True)
        self.part, self.width, self.seq, self.out = part, width, 0, None

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if self.out is None:
            self.name = uuid.uuid4().hex  # one attempt's own: an attempt that fails leaves files that no manifest names
            self.out = self.files.open_output_stream(f"{self.base}/{self.name}.ids")
            self.keys, self.counts = [], []
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.keys.append(key)
        self.counts.append(len(ids))

    def full(self) -> bool:
        return self.out is not None and (sum(self.counts[-1:]) + self.out.tell() >= SHARD_BYTES or len(self.keys) >= SHARD_DOCS)

    def close(self) -> Iterator[tuple]:
        if self.out is None:
            return
        self.out.close()
        valid = np.array([k is not None for k in self.keys])
        keys = np.array([k or 0 for k in self.keys], np.int64)
        offsets = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        with self.files.open_output_stream(f"{self.base}/{self.name}.index") as f:
            f.write(index_bytes(keys, valid, offsets, self.width))
        yield self.part, self.seq, self.name, len(keys), int(offsets[-1]), *((int(keys[valid].min()), int(keys[valid].max())) if valid.any() else (None, None))
        self.out, self.seq = None, self.seq + 1


def write_store(docs: DataFrame, tokenizer: str, root: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts and write them as shards under `root` (a URI that pyarrow.fs opens on every executor); returns the manifest.

    Documents stand in ascending order of their ids over all shards (null ids first, equal ids by a hash of the text).
    Null texts are as empty; `end_id` ends each document. Ranges of ids are dealt to tasks by sampled bounds, and equal ids
    can be split, so no id makes a large task. A task holds one batch of texts and one shard's keys. The manifest has a
    row for each shard, with `start`, the ids of all shards before it. No documents: no shards.
    """

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, rows = _tokenizer(tokenizer), []
        writer = _Writer(root, TaskContext.get().partitionId(), 2 if max(own.size, (end_id or 0) + 1) <= 1 << 16 else 4)
        end = np.array([] if end_id is None else [end_id], np.int32)
        for batch in batches:
            for key, ids in zip(batch["id"], own.encode(batch["text"].tolist()), strict=True):
                writer.add(None if pd.isna(key) else int(key), np.concatenate([ids, end]))
                if writer.full():
                    rows += writer.close()
        rows += writer.close()
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(F.col("id"), F.xxhash64("text")).sortWithinPartitions(F.col("id"), F.xxhash64("text"))
    manifest = written(dealt.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(encoded, MANIFEST), "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_store(manifest: DataFrame, root: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), one row per stored document, read from the files through the index.

    start: the ids of all documents before it. ids_crc32: of its ids as little-endian unsigned 32-bit integers.
    A row whose key does not lead to its own place in the payload raises.
    """

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, start in zip(batch["name"], batch["start"], strict=True):
                with Shard(root, name) as shard:
                    shard.load()
                    rows, found = np.arange(shard.n_rows), shard.find(shard.keys)
                    if not np.array_equal(shard.keys[found[shard.valid]], shard.keys[shard.valid]) or (found[shard.valid] > rows[shard.valid]).any():
                        raise ValueError(f"the index of shard {name} is damaged")
                    ids, at = shard.read(0, int(shard.offsets[-1])), shard.offsets.tolist()
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pd.DataFrame({"doc_id": pd.arrays.IntegerArray(shard.keys, ~shard.valid), "start": int(start) + shard.offsets[:-1], "n_tokens": np.diff(shard.offsets), "ids_crc32": np.array(crc, np.int64)})

    dealt = manifest.select("name", "start").repartition(min(max(1, manifest.count()), MOST_TASKS), "name")  # a number, or adaptive execution makes one task of them
    return dealt.mapInPandas(scanned, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(manifest: DataFrame, root: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents with these ids; repeated rows too. A shard is asked for the ids within its range, and what it
    reads for one does not grow with the shard."""

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = np.unique(np.array(doc_ids, np.int64))
        for batch in batches:
            for name, low, high in zip(batch["name"], batch["first_id"], batch["last_id"], strict=True):
                mine, rows = wanted[(wanted >= int(low)) & (wanted <= int(high))].tolist(), []
                if not mine:
                    continue
                with Shard(root, name) as shard:
                    for key in mine:
                        row = shard.row_of(key)
                        while 0 <= row < shard.n_rows and (record := shard.record(row))[:2] == (key, True):
                            rows.append((key, shard.read(*record[2:]).astype(np.int64).tolist()))
                            row += 1
                yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    low, high = (min(doc_ids), max(doc_ids)) if doc_ids else (0, -1)
    near = manifest.where((F.col("last_id") >= low) & (F.col("first_id") <= high))
    return near.select("name", F.col("first_id").cast("string"), F.col("last_id").cast("string")).mapInPandas(looked_up, "doc_id long, ids array<long>")


def store_round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = 0) -> DataFrame:
    """Write `docs` to a new store in the shared folder and read it back; see write_store and read_store."""
    root = new_path(docs.sparkSession, "store")
    return read_store(write_store(docs, tokenizer, root, end_id), root)
