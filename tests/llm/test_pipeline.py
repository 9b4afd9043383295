"""The pipeline's stages against plain versions, and the columns of the registered queries."""

import gc
import os
import random
from collections import Counter

import corpus_pipeline
import pytest
import sentencepiece

from polyglint.llm import near_copies, quality
from polyglint.llm.queries import QUERIES, tokenizer_path
from polyglint.runtime import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def stage(spark, k, docs, tmp):
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    out.write.mode("overwrite").parquet(f"{tmp}/{k}")
    return spark.read.parquet(f"{tmp}/{k}")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("stages")
    docs = [table(spark, SF, "documents")]
    for k in range(5):
        docs.append(stage(spark, k, docs[-1], tmp))
    return [d.collect() for d in docs]


def test_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for rows in stages[:-1]:
        assert list(rows[0].asDict()) == corpus_pipeline.COLUMNS


def test_quality_stage_keeps_good_documents(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in stages[1]}
    good, bad = ([d for d, q in labels.items() if q == v] for v in (1, 0))
    assert sum(d in kept for d in good) >= 0.97 * len(good)
    assert sum(d in kept for d in bad) <= 0.2 * len(bad)
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    scored = quality.score(table(spark, SF, "documents"), model).select("doc_id", "quality.score").collect()
    assert {r["doc_id"] for r in scored if r["score"] >= 0.5} == kept


def test_line_stage_only_takes_lines_away(stages):
    before = {r["doc_id"]: r["text"].split("\n") for r in stages[1]}
    assert len(stages[2]) == len(stages[1])
    for r in stages[2]:
        assert not Counter(r["text"].split("\n") if r["text"] else []) - Counter(before[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])


def test_mix_repeats_whole_documents(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    counts = Counter(r["doc_id"] for r in stages[4])
    assert max(counts.values()) <= 2
    assert all(r == before[r["doc_id"]] for r in stages[4])
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    assert abs(words(stages[4]) / words(stages[3]) - 1.5) < 0.1


def test_encoding_equals_the_library(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in stages[4]}
    assert Counter(r["doc_id"] for r in stages[5]) == Counter(r["doc_id"] for r in stages[4])
    for r in stages[5]:
        assert r["ids"] == library.encode(texts[r["doc_id"]]) and r["decoded"] == library.decode(r["ids"]) and r["n_tokens"] == len(r["ids"])


COLUMNS = {
    "op1_bm25_top_k": {"query_id", "rank", "doc_id", "score"},
    "op2_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"},
    "op3_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op4_line_dedup": {"doc_id", "text", "n_lines", "n_dropped"},
    "op5_sentencepiece": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op6_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op8_token_store": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op9_quality": {"doc_id", "p_content", "p_metadata", "score", "keep"},
    "op10_simhash_near_dedup": {"doc_id", "fingerprint", "component_id"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_queries_cover_their_whole_table(spark, name):
    out = QUERIES[name](spark, SF)
    assert set(out.columns) == COLUMNS[name]
    if name == "op1_bm25_top_k":
        queries = table(spark, SF, "documents").where("doc_id % 20 = 0")
        assert out.select("query_id").distinct().count() == queries.count()
        assert out.where("rank = 1 and query_id != doc_id").count() <= 0.2 * queries.count()
    else:
        assert out.count() == table(spark, SF, "embeddings" if name == "op2_embedding_dedup" else "documents").count()


def plain_firsts(rows):
    """(doc_id, text) of the first row of each group, by brute-force Jaccard similarity of 5-word shingles."""

    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [grams(r["text"]) for r in rows]
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if part[i] != part[j] and (a == b or len(a & b) >= 0.8 * len(a | b)):
                part = [min(part[i], part[j]) if p in (part[i], part[j]) else p for p in part]
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    return {p: min(order(r) for r, q in zip(rows, part, strict=True) if q == p) for p in set(part)}


@pytest.mark.parametrize("bound", [2, 1_000])
def test_near_copies_against_brute_force(spark, monkeypatch, bound):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = rng.choices(words, k=rng.randint(3, 120))
        rows.append((" ".join(base),))
        for _ in range(rng.randint(0, 3)):
            near = [w if rng.random() > 0.02 else rng.choice(words) for w in base]
            rows.append((" ".join(near),))
    crowd = rng.choices(words, k=100)
    rows += [(" ".join(w if rng.random() > 0.02 else rng.choice(words) for w in crowd),) for _ in range(60)]
    rows += [(None,), ("",), (" \n",), rows[0]]
    rng.shuffle(rows)
    rows = [(None if i % 5 == 0 else i // 2, r[0], "en", "a", 1) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(near_copies, "CROWD", bound)
    monkeypatch.setattr(near_copies, "BLOCK", 16)
    out = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    expected = plain_firsts(docs.collect())
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == Counter(expected.values())
    assert len(out) < len(rows) - 60
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), SF).count() == 0


def test_near_copies_keep_little_on_disk_at_a_time(spark, tmp_path, monkeypatch):
    import pathlib

    from polyglint.llm import common

    texts = [" ".join(f"word{(k // 3 * 70 + j + (k % 3 == 2) * (j == 80) * 900) % 2110}" for j in range(90)) for k in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    keys, most, plain = [], 0, near_copies.written

    def watched(df, name, lasting=False):
        nonlocal most
        out = plain(df, name, lasting)
        if name == "leaders":
            keys.append({r["key"] for r in out.select("key").collect()})
        left = [p.name.split("-")[0] for p in pathlib.Path(tmp_path, "polyglint").iterdir()]
        most = max(most, left.count("leaders"), left.count("held"), left.count("sets"))
        return out

    monkeypatch.setattr(near_copies, "written", watched)
    assert near_copies.first_of_each_group(docs).count() == 30
    assert len(keys) == near_copies.SLICES == 4 and all(keys)
    assert len(set().union(*keys)) == sum(map(len, keys))  # each shingle in one slice
    assert most == 1  # tables of a step that ended are gone


def test_texts_meet_by_like_sizes(spark):
    rows = [(1, i, size, 0, 1_000 + i % 7) for i, size in enumerate(range(4, 400, 3))]
    for similarity in (0.5, 0.8, 0.93):
        placed = spark.createDataFrame(rows, "key long, node long, size int, place int, part long")
        found = [(r["node1"], r["node2"]) for r in near_copies._meetings(placed, similarity).collect()]
        like = {(a[1], b[1]) for a in rows for b in rows if a[2] < b[2] and a[2] >= similarity * b[2] - 1e-6 and a[4] != b[4]}
        assert len(found) == len(set(found)) and set(found) == like


def test_a_passage_of_a_share_of_the_texts_is_common_whatever_their_number(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLE", 10)
    rng, sizes, w0 = random.Random(5), {}, near_copies.written
    passage = " ".join(f"p{i}" for i in range(60))
    own = lambda n: " ".join(str(rng.random()) for _ in range(n))
    texts = [f"{own(90)} {passage} {own(90)}" if i % 10 == 0 else own(240) for i in range(1_000)]

    def counted(df, name, lasting=False):
        out = w0(df, name, lasting)
        sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_copies, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert near_copies.first_of_each_group(docs).count() == 1_000
    assert not sizes["postings"] and not sizes["apart"]


def test_the_driver_gives_its_garbage_back_between_steps(spark):
    from polyglint.llm.common import passing

    def full_collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    before = full_collections()
    with passing(spark):
        pass
    assert full_collections() == before + 1


def test_near_dedup_stage_against_brute_force(stages):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in stages[3]) == sorted(plain_firsts(stages[2]).values())


def test_stages_leave_one_small_table_behind(spark, tmp_path, monkeypatch):
    import pathlib

    from polyglint.llm import common
    from polyglint.llm.line_dedup import drop_recurring_lines
    from polyglint.llm.near_copies import first_of_each_group

    texts = [" ".join(f"word{(k // 2 * 7 + j) % 211}" for j in range(40)) + "\nthe same line recurs in every one of these documents again and again" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    for stage_, table_, rows in ((drop_recurring_lines, "gone", 40), (first_of_each_group, "marks", 20)):
        out = stage_(docs)
        left = sorted(p.name.split("-")[0] for p in pathlib.Path(tmp_path, "polyglint").iterdir())
        assert left.count(table_) == 1 and set(left) <= {"gone", "marks"}
        assert out.count() == rows


def test_a_worker_holds_the_memo_of_one_operator():
    from polyglint.llm import common, near_copies, quality

    near_copies.shingles("one two three four five six")
    quality.content("one two three")
    assert len(common._MEMOS) == 1 and len(common.memo("quality", dict)) == 3
    assert len(near_copies.shingles("one two three four five six")) == 2
    assert len(common._MEMOS) == 1


def test_sentencepiece_stage_begins_on_executors_that_gave_their_garbage_back(spark):
    java, docs = spark._jvm.java.lang, table(spark, SF, "documents")
    left = java.ref.WeakReference(java.Object())  # only a collection clears it
    gc.collect()  # until then the gateway holds the object
    corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert left.get() is None
