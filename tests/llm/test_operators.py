"""The operators on awkward rows: nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; each against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from polyglint.llm import bm25, embedding_dedup, language_id, line_dedup, mixing, quality, simhash, token_store, toxicity
from polyglint.llm.common import new_path
from polyglint.llm.components import connected_components
from polyglint.llm.embedding_dedup import near_vectors
from polyglint.llm.perfect_hash import PerfectHash
from polyglint.llm.pieces import PieceModel, encode_decode, encode_texts
from polyglint.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(60)]


def documents(spark, n=120, seed=1):
    """Random texts with copies, near copies, nulls, empty texts, a very long one and repeated rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS, rng.integers(1, 60)))
        if i % 9 == 3 and rows[-1][1]:
            text = rows[-1][1]
        elif i % 9 == 5 and rows[-1][1]:
            text = rows[-1][1] + " extra"
        rows.append((i, text, ["en", "fr", None][i % 3], ["b", "a", None, "ß", ""][i % 5 if i % 2 else 0], len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "a", 0), (n + 2, " \t\n ", "en", "a", 4), (n + 3, "x y " * 40_000, "fr", "a", 160_000), (n + 4, "İ é ß \x1c <s> 漢字", "en", "b", 5)]
    rows += [rows[0], rows[0], (None, "no id here", "en", "b", 10), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


def components(n, links):
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(n)]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 3), (5, 4), (5, 4), (7, 9), (9, 8), (8, 6), (20, 1), (None, 4)]
    links += [(100 + i, 101 + i) for i in range(40)] + [(200, 201 + i) for i in range(30)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert {k: v for k, v in found.items() if k < 100} == {1: 1, 2: 1, 3: 1, 20: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6}
    assert all(found[100 + i] == 100 for i in range(41)) and all(found[201 + i] == 200 for i in range(30))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("together", [0, 1_000])
def test_components_in_one_task_or_by_rounds(spark, together):
    rng = random.Random(3)
    links = [(rng.randrange(300) - 100, rng.randrange(300) - 100) for _ in range(140)] + [(1_000 + i, 1_001 + i) for i in range(60)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 7)], "u long, v long"), together=together).collect()}
    nodes = sorted({x for a, b in links if a != b for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    assert found == {x: nodes[r] for x, r in zip(nodes, components(len(nodes), [(at[a], at[b]) for a, b in links if a != b]), strict=True)}


def plain_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, docs):
    rows = docs.collect()
    got = Counter((r["id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_groups(docs).collect())
    prints = [plain_simhash(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    part = components(len(rows), links)
    first = defaultdict(list)
    for p, r in zip(part, rows, strict=True):
        first[p] += [r["doc_id"]] if r["doc_id"] is not None else []
    assert got == Counter((r["doc_id"], f, min(first[p], default=None)) for r, f, p in zip(rows, prints, part, strict=True))
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_links_at_two_bits_but_not_three(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    prints = set(base)
    for b in base:
        for n in (1, 2, 2, 3):
            mask = sum(1 << int(k) for k in rng.choice(64, n, replace=False))
            flipped = (b ^ mask) % 2**64
            prints.add(flipped - 2**64 if flipped >= 2**63 else flipped)
    prints = sorted(prints)
    for limit in (1, 2, 3):
        found = {(r["a"], r["b"]) for r in simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"), limit).collect()}
        assert found == {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= limit}


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    rows, data = [], []
    for i in range(300):
        v = rng.normal(size=8)
        if i % 3 and data:
            v = np.array(data[-1]) + rng.normal(size=8) * 0.05
        if i % 20 == 7:
            v = np.array(data[-1])
        data.append(v.tolist())
        rows.append((i, v.tolist(), int(i % 2) if i % 4 else 0))
    odd = [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [1.0, None], 0), (304, data[0], None), (None, data[0], 0), (305, [], 0), (306, [1.0, 0.0], 0), (307, [2.0, 0.0], 0), (0, data[0], 0), (308, [1e200] * 8, 1), (309, [1e200] * 8, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(1)).withColumn("node", F.lit("x"))
    got = near_vectors(df).collect()
    every = df.collect()
    fine = [r["vec_id"] is not None and r["label"] is not None and r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"]) for r in every]

    def cosine(a, b):
        a, b = (np.array(x) / max(map(abs, x)) for x in (a, b))
        return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)

    links = [(i, j) for i, a in enumerate(every) for j, b in enumerate(every[:i]) if fine[i] and fine[j] and a["label"] == b["label"] and len(a["embedding"]) == len(b["embedding"]) and cosine(a["embedding"], b["embedding"]) >= 0.98]
    part, count, first = components(len(every), links), Counter(x for pair in links for x in pair), {}
    for p, r in zip(part, every, strict=True):
        if r["vec_id"] is not None:
            first[p] = min(first.get(p, r["vec_id"]), r["vec_id"])
    expected = Counter((r["vec_id"], count[i], first.get(part[i]), r["vec_id"] is not None and r["vec_id"] == first.get(part[i])) for i, r in enumerate(every))
    assert Counter(tuple(r) for r in got) == expected
    assert near_vectors(df.limit(0)).count() == 0


def test_links_across_cells_and_blocks(spark, monkeypatch):
    """Labels large enough for several pivots, cells large enough for several blocks, thousands of links; against all cosines."""
    monkeypatch.setattr(embedding_dedup, "PER_PIVOT", 90)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(90, 12))
    data = np.vstack([c + rng.normal(size=(k, 12)) * 0.1 for c, k in zip(centres, rng.integers(1, 25, 90), strict=True)])
    label = rng.integers(0, 2, len(data))
    df = spark.createDataFrame([(int(i), v.tolist(), int(k)) for i, (v, k) in enumerate(zip(data, label, strict=True))], "vec_id long, embedding array<double>, label int")
    assert len(embedding_dedup._pivots(embedding_dedup._nodes(df, "vec_id", "embedding", "label"))) == 2
    unit = data / np.linalg.norm(data, axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    links = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.tril(near, -1)), strict=True)]
    assert len(links) > 3_000
    part = components(len(data), links)
    got = sorted((r["id"], r["n_links"], r["component_id"]) for r in near_vectors(df).collect())
    assert got == [(i, int(near[i].sum()) - 1, part[i]) for i in range(len(data))]


def test_pivots_replicate_enough():
    from polyglint.llm.embedding_dedup import assign, unit

    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 6))
    x = unit(list(np.vstack([base, base + rng.normal(size=base.shape) * 0.05])))
    home, reach = assign(x, x[:7], 0.2)
    near = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)) <= 0.2
    assert all(reach[j, home[i]] for i, j in zip(*np.nonzero(near), strict=True))


def test_mixing(spark, docs):
    noisy = docs.withColumn("size", F.lit("clash")).withColumn("key", F.lit(0)).withColumn("mix", F.lit(1)).withColumn("plan", F.lit(2))
    rows = mixing.mixed(noisy).collect()
    assert len(rows) == docs.count()
    total, by = sum(r["mix"]["size"] for r in rows), defaultdict(lambda: [0, 0, 0.0, 0])
    for r in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        assert r["mix"]["size"] == size and 0 <= r["mix"]["copies"] <= 2 and r["size"] == "clash"
        b = by[r["source"]]
        b[0] += size
        b[1] += size * r["mix"]["copies"]
        b[2], b[3] = r["mix"]["target"], max(b[3], size)
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * total, set(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share > 2 * by[s][0]}
        if not full:
            target |= {s: weight[s] * share for s in open_}
            break
        target |= {s: 2 * by[s][0] for s in full}
        left -= sum(2 * by[s][0] for s in full)
        open_ -= full
    for s in names:
        assert abs(by[s][2] - target[s]) < 1e-6 * max(1, target[s])
        assert abs(by[s][1] - target[s]) <= by[s][3]
    again = mixing.mixed(docs.repartition(7)).collect()
    assert Counter((r["doc_id"], r["mix"]["copies"]) for r in rows) == Counter((r["doc_id"], r["mix"]["copies"]) for r in again)
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert {r["mix"]["copies"] for r in mixing.mixed(docs.where("text is null")).collect()} == {0}


def test_mixing_passes_over_what_does_not_fit(spark):
    """A long document that straddles the target, in any place of the order, leaves no gap."""
    for seed in range(4):
        rows = [(10_000 * seed + i, "w " * (1 + i % 50), "en", "a", 1) for i in range(800)] + [(10_000 * seed + 900, "w " * 9_000, "en", "a", 1), (1, "x " * 60_000, "en", "b", 1)]
        out = mixing.mixed(spark.createDataFrame(rows, DOCS), weights=(1, 4), budget=0.6).where("source = 'a'").collect()
        taken, target = sum(r["mix"]["size"] * r["mix"]["copies"] for r in out), out[0]["mix"]["target"]
        assert 5_000 < target < 0.9 * out[0]["mix"]["source_size"] and abs(taken - target) <= 2


def plain_line_dedup(rows, min_docs, same_docs):
    """The text that each row keeps, by the same rules, one line at a time."""
    order = lambda row: (row[0] is not None, row[0] or 0, row[1])
    lines = []
    for row in {(r["doc_id"], r["text"]) for r in rows if r["text"] is not None}:
        for no, line in enumerate(row[1].split("\n")):
            tokens = ["<*>" if re.search("[0-9]", t) else t for t in line.split(" ") if t]
            if len(tokens) >= 3:
                lines.append((row, no, (len(tokens), *tokens[:2]), tuple(tokens)))
    held, by_form, seen = defaultdict(set), defaultdict(set), Counter()
    for row, _, leaf, form in lines:
        held[leaf].add(row)
        by_form[leaf, form].add(row)
    for (leaf, form), where in by_form.items():
        for i, t in enumerate(form):
            seen[leaf, i, t] += len(where)

    def template(leaf, form):
        shape = tuple(t if t != "<*>" and seen[leaf, i, t] >= min_docs else "<*>" for i, t in enumerate(form))
        after = len(form) - 2
        enough = shape == form or sum(t != "<*>" for t in shape[2:]) >= max(min(after, 2), after / 2)
        return (leaf, shape) if len(held[leaf]) >= min_docs and sum(t != "<*>" for t in shape) >= len(shape) / 2 and enough else None

    groups, dropped = defaultdict(set), set()
    for row, no, leaf, form in lines:
        groups[template(leaf, form)].add((row, no, form))
    for key, group in groups.items():
        if key and len({row for row, _, _ in group}) >= min_docs:
            dropped |= {x[:2] for x in group} - {min(group, key=lambda x: (order(x[0]), x[1]))[:2]}
            lines = [x for x in lines if template(x[2], x[3]) != key]
    same = defaultdict(set)
    for row, no, _, form in lines:
        if len(form) >= 10 and form.count("<*>") <= len(form) / 2:
            same[form].add((row, no))
    for group in same.values():
        if len({row for row, _ in group}) >= same_docs:
            dropped |= group - {min(group, key=lambda x: (order(x[0]), x[1]))}
    whole = lambda r: r["text"].split("\n")
    return [None if r["text"] is None else "\n".join(x for no, x in enumerate(whole(r)) if ((r["doc_id"], r["text"]), no) not in dropped) for r in rows]


def test_line_dedup(spark):
    rng = np.random.default_rng(11)
    passage = " ".join(rng.choice(["river", "stone", "cloud", "light", "grass"], 55))
    rows = [(i, f"own words of text {i} here\nShared line number {i} of all\nPage {i}\nHe said rare{chr(97 + i)} thing{chr(98 + i)}\nHe said that it is {chr(97 + i)}x here again", "en", "a", 1) for i in range(12)]
    rows += [(20, None, None, None, None), (21, "", "en", "a", 0), (22, "Shared line number 5 of all", "en", "a", 0), (23, "two words\n\n  spaced   out line  ", "en", "a", 0), (None, "Shared line number 7 of all\nx", "en", "a", 0), (0, rows[0][1], "en", "a", 1)]
    rows += [(30, f"a\n{passage}\nb", "en", "a", 1), (31, f"{passage}", "en", "a", 1), (32, f"{passage} and more", "en", "a", 1), (33, f"c\n{passage}\n{passage}", "en", "a", 1), (34, "only here twice is this long line of ten tokens at least\n" * 2, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("lines", F.lit(1)).withColumn("row", F.lit(1)).withColumn("gone", F.lit(1))
    out = line_dedup.drop_recurring_lines(docs, min_docs=5).collect()
    source = docs.collect()
    wanted = plain_line_dedup(source, 5, 2)
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r["doc_id"], text) for r, text in zip(source, wanted, strict=True))
    left = {r["doc_id"]: r for r in out}
    assert left[20]["lines"] == (0, 0) and left[21]["lines"] == (1, 0) and left[33]["text"] == "c" and left[33]["lines"] == (3, 2)
    assert left[30]["text"].split("\n")[1] == passage and left[31]["text"] == "" and left[32]["text"].startswith(passage) and left[34]["lines"]["dropped"] == 0
    assert "Shared line" in left[None]["text"] and "Shared line" not in left[3]["text"] and "He said rared" in left[3]["text"] and "again" not in left[3]["text"]
    assert line_dedup.drop_recurring_lines(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def pieces():
    return PieceModel(tokenizer_path("piece_bpe_32k.model"))


def test_pieces_equal_the_library(pieces):
    rng = np.random.default_rng(4)
    letters = list("ab ▁\n\t éü漢\U0001f600the in\x00\r") + ["the ", "  ", "ing"]
    texts = ["".join(rng.choice(letters, int(n))) for n in rng.choice([0, 1, 2, 30, 300, 700], 300)]
    texts += ["", " ", "thein" * 2000 + " " * 600 + "x", "hello wörld\n" * 200_000, "a" * 5000]
    for text, ids in zip(texts, encode_texts(texts, tokenizer_path("piece_bpe_32k.model")), strict=True):
        assert ids.tolist() == pieces.library.encode(text)


def test_encode_decode(spark, docs, pieces):
    out = encode_decode(docs.withColumn("pieces", F.lit(1)), tokenizer_path("piece_bpe_32k.model")).collect()
    assert len(out) == docs.count()
    for r in out:
        ids = pieces.library.encode(r["text"] or "")
        assert tuple(r["pieces"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(pieces.library.decode(ids).encode()).hexdigest())
    whole = encode_decode(docs, tokenizer_path("piece_bpe_32k.model"), digest=False).where("doc_id = 4").first()["pieces"]
    assert whole["ids"] == pieces.library.encode(docs.where("doc_id = 4").first()["text"]) and whole["n_tokens"] == len(whole["ids"])
    assert encode_decode(docs.limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_token_store_reads_a_key_without_the_shard(tmp_path):
    root, read = f"file://{tmp_path}", {}
    for n in (1_000, 200_000):
        keys = np.arange(n, dtype=np.int64) * 3 - n
        valid = np.arange(n) >= 2
        (tmp_path / str(n)).write_bytes(b"")
        (tmp_path / f"{n}.index").write_bytes(token_store.index_bytes(keys, valid, np.arange(n + 1) * 2, 2))
        with token_store.Shard(root, str(n)) as shard:
            shard.bytes_read = 0
            for row in range(2, n, n // 500):
                assert shard.row_of(int(keys[row])) == row and shard.record(row) == (int(keys[row]), True, 2 * row, 2 * row + 2)
                assert shard.row_of(int(keys[row]) + 1) == -1
            read[n] = shard.bytes_read
            assert shard.row_of(int(keys[0])) == -1
    assert read[200_000] < 1.1 * read[1_000]


def test_token_store_writer_closes_full_shards(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_DOCS", 4)
    root, closed = f"file://{tmp_path}", []
    writer = token_store._Writer(root, 7, 2)
    for i in range(10):
        writer.add(i // 2, np.full(i + 1, i, np.int32))
        if writer.full():
            closed += writer.close()
    closed += writer.close()
    assert [(r[0], r[1], *r[3:]) for r in closed] == [(7, 0, 4, 10, 0, 1), (7, 1, 4, 26, 2, 3), (7, 2, 2, 19, 4, 4)]
    with token_store.Shard(root, closed[1][2]) as shard:
        row = shard.row_of(3)
        assert [shard.read(*shard.record(r)[2:]).tolist() for r in (row, row + 1)] == [[6] * 7, [7] * 8]


def test_token_store_encodes_new_segments_together():
    tokenizer, asked = token_store.ByteTokenizer(tokenizer_path("byte_bpe_50k.json")), []
    library, encoded = tokenizer.library, tokenizer._encoded
    tokenizer._encoded = lambda texts: asked.extend(texts) or encoded(texts)
    rng = np.random.default_rng(6)
    letters = ["a", "the", "ing", "é", "漢", "\u200b", "\U0001f600", "'s", "!", "?!", "7", "\x1c", "'", "_", "ł", "\u0301", "Ċ"]
    segments = sorted({" " * int(n % 2) + "".join(rng.choice(letters, int(n))) for n in rng.integers(1, 12, 3_000)} | {"\n", "\n\n", "  ", "\t ", " ", "\r", "\u3000"})
    ids, lengths = tokenizer.encode_segments(segments)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [library.encode(s, add_special_tokens=False).ids for s in segments]
    assert len(asked) < len(segments) / 20
    tokenizer._encoded, tokenizer.line_feed = encoded, -1  # as if line feeds were taken into other tokens
    assert all(np.array_equal(a, b) for a, b in zip(tokenizer.encode_segments(segments), (ids, lengths), strict=True))


def test_token_store_encodes_a_known_word_no_second_time_for_its_end(monkeypatch):
    tokenizer, asked = token_store.ByteTokenizer(tokenizer_path("byte_bpe_50k.json")), []
    library, encoded = tokenizer.library, tokenizer._encoded
    tokenizer._encoded = lambda texts: asked.extend(texts) or encoded(texts)
    rng = np.random.default_rng(7)
    letters = ["a", "the", "ing", "é", "漢", "\u200b", "'s", "7", "'", "_", "ł", "\u0301", "…", "-", "²", "ª", "×"]
    words = sorted({"".join(rng.choice(letters, int(n))) for n in rng.integers(1, 6, 400)})
    ends = ["", ",", ".", "?!", "...", "'", ")", ".)", ",'", "!", ";:"]
    texts = [" ".join(words), *(" ".join(w + str(rng.choice(ends)) for w in rng.permutation(words)) for _ in range(8)), ", . ?! ,a .7 a,b, a, , !\n?\n", "a zebra zebra, zebras, zebras"]
    for _ in range(2):
        got = [ids.tolist() for text in texts for ids in tokenizer.encode([text])]  # words of earlier texts, and of the same one
        assert got == [library.encode(text, add_special_tokens=False).ids for text in texts]
    seen = [w.strip(" ") for text in asked for w in text.split("\n")]
    assert "zebra" in seen and "zebra," not in seen and "zebras," not in seen
    monkeypatch.setattr(token_store, "MOST_ENDS", 1)
    other = token_store.ByteTokenizer(tokenizer_path("byte_bpe_50k.json"))
    assert [ids.tolist() for ids in other.encode(texts)] == got


def test_token_store(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    more = docs.union(spark.createDataFrame([(900 + i, t, "en", "a", 1) for i, t in enumerate(["a <|endoftext|>  b<|endoftext|>", "  x\n\n y \x1c z　  q", "it's  we'll\t\tgo ", "\n", "…\u0085x"])], DOCS))
    root = new_path(spark, "store")
    manifest = token_store.write_store(more, tokenizer_path("byte_bpe_50k.json"), root)
    got = token_store.read_store(manifest, root).collect()
    rows = sorted(more.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    ids = [[*library.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in rows]
    assert len(got) == len(rows)
    crc = Counter((r["doc_id"], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, ids, strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == crc
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [r["doc_id"] for r in rows]
    found = token_store.fetch(manifest, root, [0, 7, 5_000, 903]).collect()
    assert Counter(r["doc_id"] for r in found) == {0: 3, 7: 1, 903: 1}
    assert next(r["ids"] for r in found if r["doc_id"] == 7) == ids[[r["doc_id"] for r in rows].index(7)]
    empty = token_store.write_store(more.limit(0), tokenizer_path("byte_bpe_50k.json"), root)
    assert token_store.read_store(empty, root).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    slots = PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        PerfectHash.build(np.zeros(2, np.uint64))


def test_code_lengths_by_hand():
    """Every word's code length against a direct walk of the context tree."""
    counts = [Counter({"aab": 3, "ab": 1}), Counter({"abba": 2, "ÿ": 1})]
    model = language_id.PartialMatching(["x", "y"], counts, order=2)

    def bits(word, own):
        seen = defaultdict(Counter)
        for w, n in own.items():
            b = b" " + w.encode() + b" "
            for i in range(1, len(b)):
                for k in range(min(2, i) + 1):
                    seen[b[i - k : i]][b[i]] += n
            for k in range(1):
                seen[b""][b[0]] += 0
        b, total = b" " + word.encode() + b" ", 0.0
        for i in range(1, len(b)):
            for k in range(min(2, i), -2, -1):
                if k == -1:
                    total += 8
                    break
                c = seen[b[i - k : i]]
                n, d = sum(c.values()), sum(v > 0 for v in c.values())
                if not n:
                    continue
                if c[b[i]]:
                    total -= np.log2(c[b[i]] / (n + d))
                    break
                total -= np.log2(d / (n + d))
        return total

    words = ["aab", "ab", "abba", "zz", "ÿa", "b"]
    assert np.allclose(model.code_lengths(words), [[bits(w, own) for own in counts] for w in words], atol=1e-4)


def test_language_id(spark):
    rng = np.random.default_rng(6)
    stems = {"en": ["the", "tion", "wh", "ing", "and"], "de": ["sch", "ung", "ein", "üb", "der"], None: ["qq"]}
    rows = [(i, " ".join("".join(rng.choice(stems[lang], 2)) for _ in range(30)), lang, "a", 1) for i, lang in enumerate(["en", "de", "en", None] * 40)]
    rows += [(900, None, "en", "a", 1), (901, "", "en", "a", 1), (902, "12 34 !!", "en", "a", 1), (None, "theing", "en", "a", 1), (903, "theing " * 300_000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("x"))
    out = language_id.identify(docs, language_id.train(docs, F.col("doc_id") % 4 != 2)).collect()
    assert len(out) == len(rows)
    for r in out:
        pred, score = r["language"]
        assert 0 <= score <= 1
        if r["doc_id"] in (900, 901, 902):
            assert (pred, score) == ("und", 0.0)
        elif r["lang"]:
            assert pred == r["lang"]
    none = language_id.identify(docs, language_id.train(docs.limit(0), F.lit(True)))
    assert {r["language"]["lang_pred"] for r in none.collect()} == {"und"}


def test_a_language_of_long_texts_only_is_learned(spark):
    rows = [(i, "der und sch ein über " * 16_000, "de", "a", 1) for i in range(8)] + [(100 + i, "the and tion wh ing", "en", "a", 1) for i in range(8)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.train(docs, F.lit(True))
    assert model.langs == ["de", "en"]
    assert all(r["language"]["lang_pred"] == r["lang"] for r in language_id.identify(docs, model).collect())


def test_toxicity(spark):
    rng = np.random.default_rng(8)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 4 == 0
        text = rng.choice(words, 40).tolist() + (["scumbag", "idiot"] if bad else [])
        rows.append((i, " ".join(rng.permutation(text)), "en", "a", 1))
        labels.append((i, 1, int(bad)))
    rows += [(9000, None, "en", "a", 1), (9001, "", "en", "a", 1), (None, "scumbag idiot", "en", "a", 1), (9002, "idiot scumbag " * 100_000, "en", "a", 1)]
    labels += [(9000, None, None), (None, 1, 1), (0, 1, 1), (5000, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("y", F.lit(1)).withColumn("score", F.lit("old"))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, known, F.col("doc_id") % 3 != 1)).collect()
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 3 == 1]
    assert np.mean([(r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == len(rows)
    blank = toxicity.score(docs, toxicity.train(docs, known.limit(0), F.lit(True))).collect()
    assert len({r["score"] for r in blank}) == 1


def test_pairs_that_weights_miss():
    """Two terms that only together mean label 1."""
    rng = np.random.default_rng(9)
    rows, y = [], []
    a, b = toxicity.bucket("insult"), toxicity.bucket("group")
    for _ in range(3000):
        x, z = rng.random(2) < 0.5
        rows.append(np.array(sorted(([a] if x else []) + ([b] if z else []) + rng.choice(200, 3, replace=False).tolist()), np.int64))
        y.append(float(x and z))
    model = toxicity.fitted(rows, np.array(y))
    scores = model.scores([model.column[np.array(r)] for r in ([a], [b], [a, b])])
    assert scores[2] > 0.9 and scores[0] < 0.2 and scores[1] < 0.2


@pytest.mark.parametrize("noise", [0, 12])
def test_pairs_of_terms_that_are_neutral_alone(noise):
    """Label 1 if just one of two terms is there, and if an insult stands beside a group: no term has an effect of its own."""
    rng = np.random.default_rng(14)
    a, b = toxicity.bucket("insult"), toxicity.bucket("group")
    spare = [toxicity.bucket(f"n{i}") for i in range(400)]
    rows, y = [], []
    for _ in range(8_000):
        x, z = rng.random(2) < 0.5
        rows.append(np.unique([*([a] if x else []), *([b] if z else []), *rng.choice(spare, noise, replace=False)]).astype(np.int64))
        y.append(float(x != z))
    model = toxicity.fitted(rows[:6_000], np.array(y[:6_000]))
    known = [model.column[r] for r in rows[6_000:]]
    right = (model.scores([c[c >= 0] for c in known]) >= 0.5) == (np.array(y[6_000:]) == 1)
    assert right.mean() > 0.97


def test_many_insults_and_groups_that_are_neutral_alone():
    """60 insults, 60 groups: an insult beside a group is label 1, beside a plain word label 0, and a group beside a plain word too."""
    rng = np.random.default_rng(15)
    kinds = [[toxicity.bucket(f"{kind}{i}") for i in range(60)] for kind in ("insult", "group", "plain", "other")]
    rows, y = [], []
    for i in range(12_000):
        first, second = rng.integers(0, 2, 2)
        rows.append(np.unique([rng.choice(kinds[2 * first]), rng.choice(kinds[1 + 2 * second])]).astype(np.int64))
        y.append(float(first == second))
    model = toxicity.fitted(rows[:10_000], np.array(y[:10_000]))
    known = [model.column[r] for r in rows[10_000:]]
    right = (model.scores([c[c >= 0] for c in known]) >= 0.5) == (np.array(y[10_000:]) == 1)
    assert right.mean() > 0.9


def test_quality(spark):
    rng = np.random.default_rng(10)
    rows, labels = [], []
    for i in range(800):
        bad = i % 5 == 0
        words = rng.choice([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)], 60).tolist()
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words), "en", "spam" if bad and i % 2 else "site", 300))
        if i % 2 or i % 3 == 0:
            labels.append((i, int(not bad), 0))
    rows += [(9000, None, None, None, None), (9001, "", "en", "site", 0), (None, "some words here", "en", "site", 5)]
    labels += [(9000, None, None), (None, 1, 1), (1, 1, 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("quality", F.lit(1)).withColumn("y", F.lit(1))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.train(docs, known)).collect()
    assert len(out) == len(rows) and all(0 <= r["quality"]["score"] <= 1 for r in out)
    mine = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 800]
    assert np.mean([(r["quality"]["score"] >= 0.5) == (r["doc_id"] % 5 != 0) for r in mine]) > 0.99
    assert np.mean([r["quality"]["p_metadata"] for r in mine if r["source"] == "spam"]) < np.mean([r["quality"]["p_metadata"] for r in mine if r["source"] == "site"])
    blank = quality.score(docs, quality.train(docs, known.limit(0))).collect()
    assert {r["quality"]["score"] for r in blank} == {0.5}


@pytest.mark.parametrize("small", [False, True])
def test_bm25(spark, docs, monkeypatch, small):
    if small:  # many shards, groups of shards and query blocks
        for name, value in {"SHARD_DOCS": 16, "BLOCK_DOCS": 4, "QUERIES": 5, "SHARDS_A_TASK": 2, "STEP": 3, "LONG_SHARE": 8, "TOGETHER": 3, "ENTRIES": 40}.items():
            monkeypatch.setattr(bm25, name, value)
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    found = bm25.top_k(docs.withColumn("term", F.lit(1)), docs.where(F.col("doc_id") % 5 == 0), 4).collect()
    bags = [Counter(bm25.terms_of(r["text"] or "")) for r in rows]
    sizes = np.array([b.total() for b in bags], float)
    df = Counter(t for b in bags for t in b)
    idf = {t: math.log1p((len(rows) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    for query in {r["doc_id"]: r for r in rows if r["doc_id"] % 5 == 0}.values():
        terms = set().union(*(bm25.terms_of(r["text"] or "") for r in rows if r["doc_id"] == query["doc_id"]))
        scores = [(math.fsum(idf[t] * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * n / sizes.mean())) for t in terms if b[t]), r["doc_id"]) for b, n, r in zip(bags, sizes, rows, strict=True)]
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-round(s[0], 9), s[1]))[:4]
        assert [d for _, d in best] == [d for d, _ in got[query["doc_id"]]]
        assert [s for s, _ in best] == pytest.approx([s for _, s in got[query["doc_id"]]], rel=1e-12)
    assert bm25.top_k(docs.limit(0), docs.limit(0)).count() == 0
    assert bm25.top_k(docs, docs.limit(0)).count() == 0


def test_bm25_prunes_without_changing_results(monkeypatch):
    monkeypatch.setattr(bm25, "STEP", 3)
    rng = np.random.default_rng(12)
    n, width = 4000, 300
    lengths = np.sort(rng.integers(5, 200, n))[::-1]
    bags = [np.unique((rng.random(size) ** 3 * width).astype(int), return_counts=True) for size in lengths]
    doc, term, tf = np.repeat(np.arange(n), [len(b[0]) for b in bags]), np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    vocabulary = np.arange(width, dtype=np.int64) * 7
    df = np.bincount(term, minlength=width)
    query = [np.sort(rng.choice(width, 12, replace=False)) for _ in range(20)]
    block = {"ids": np.arange(20), "terms": vocabulary, "weight": bm25.inverse_frequency(df, n), "term": np.concatenate(query), "uses": np.full(20, 12)}
    searcher = bm25.Searcher(block, float(lengths.mean()), 5)
    for part in (doc < 2000, doc >= 2000):
        first = int(doc[part][0])
        searcher.visit(bm25.shard_arrays(np.arange(first, first + 2000), lengths[first : first + 2000], doc[part] - first, term[part], tf[part], vocabulary))
    dense = np.zeros((n, width))
    dense[doc, term] = bm25.impact(tf.astype(float), lengths[doc].astype(float), float(lengths.mean()))
    for q, ts in enumerate(query):
        scores = np.cumsum(dense[:, ts] * block["weight"][ts], axis=1)[:, -1]
        best = np.lexsort((np.arange(n), -scores))[:5]
        assert searcher.best_ids[q].tolist() == best.tolist() and searcher.best[q].tolist() == scores[best].tolist()
    assert searcher.skipped > 0 and searcher.scored < searcher.documents - searcher.skipped  # blocks, and pivots within blocks


def test_bm25_reads_blocks_for_many_queries_at_once(monkeypatch):
    """Products of a block's lists go over all queries that are open there, not over 128 of them at most, and blocks that are in no long list of a step do no harm."""
    for name, value in {"BLOCK_DOCS": 16, "STEP": 8, "RUN": 4}.items():
        monkeypatch.setattr(bm25, name, value, raising=False)
    rng, n, half = np.random.default_rng(5), 640, 40  # two languages of 40 terms, those of the second in fewer documents each
    bags = [np.unique(rng.integers(0, half, 30 - 20 * (k % 2)) + half * (k % 2), return_counts=True) for k in range(n)]
    doc, term, tf = np.repeat(np.arange(n), [len(b[0]) for b in bags]), np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    vocabulary, df = np.arange(2 * half, dtype=np.int64) * 7, np.bincount(term, minlength=2 * half)
    block = {"ids": np.arange(n), "terms": vocabulary, "weight": bm25.inverse_frequency(df, n), "term": term, "uses": np.array([len(b[0]) for b in bags])}
    searcher, moves, search = bm25.Searcher(block, 20.0, 3), [], bm25.Searcher._search
    monkeypatch.setattr(bm25.Searcher, "_search", lambda self, index, some, *a: (moves.append(len(some)), search(self, index, some, *a)))
    lengths = np.tile([30, 10], n // 2)
    searcher.visit(bm25.shard_arrays(np.arange(n), lengths, doc, term, tf, vocabulary))
    dense = np.zeros((n, 2 * half))
    dense[doc, term] = bm25.impact(tf.astype(float), lengths[doc].astype(float), 20.0)
    for q, b in enumerate(bags):
        scores = np.cumsum(dense[:, b[0]] * block["weight"][b[0]], axis=1)[:, -1]
        best = np.lexsort((np.arange(n), -scores))[:3]
        assert searcher.best_ids[q].tolist() == best.tolist() and searcher.best[q].tolist() == scores[best].tolist()
    assert max(moves) > 128


def test_bm25_blocks_hold_documents_of_one_kind(monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK_DOCS", 8)
    rng, kept = np.random.default_rng(2), {}
    monkeypatch.setattr(bm25, "_save", lambda root, **arrays: kept.update(arrays) or "x")
    shard = bm25._ShardBuilder("")
    for key in range(768):
        shard.add(key, " ".join(f"{'ab'[key % 2]}{w}" for w in rng.integers(0, 30, 20 + key // 32)))
    list(shard.close())
    mixed_ = [len(set((block % 2).tolist())) == 2 for block in np.split(kept["ids"], range(8, 768, 8))]
    assert sum(mixed_) < bm25.KINDS  # in the order of lengths alone nearly all of the 96 blocks are mixed
    assert sorted(kept["ids"].tolist()) == list(range(768))
