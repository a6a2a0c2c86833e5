"""Clashing columns, texts beyond every limit at which code changes its path, repeated ids."""

import base64
import hashlib
import random
from pathlib import Path

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import fotolith.llm
from fotolith.llm import bpe, common, neardup, packing, quality, queries, rules, simhash, suffix
from fotolith.llm.common import Scratch
from tests.llm.test_kernels import brute_spans
from tests.llm.test_operators import prose
from tests.llm.test_rules import plain_verdict

FILE = queries.vocabulary("byte_bpe_50k.json")
RANKS = queries.vocabulary("byte_bpe_50k.tiktoken")
#: Names that operators use inside.
CLASHES = ["ids", "wide", "key", "df", "sequence_id", "offset", "fp", "rep", "component_id", "node", "root", "name", "a", "b", "block", "bucket", "kept", "carried", "n_tokens", "ends", "score", "rules", "_rules", "copy", "k", "n"]


@pytest.fixture(scope="module")
def plain_rows():
    rng = random.Random(12)
    base = prose(rng, 150)
    rows = [(i, prose(rng, rng.randint(0, 120)) + (base if i % 4 == 0 else "")) for i in range(40)]
    return [*rows, (40, rows[3][1]), (41, None), (42, "")]


@pytest.fixture(scope="module")
def clashing(spark, plain_rows):
    docs = spark.createDataFrame(plain_rows, "doc_id long, text string")
    return docs.select("doc_id", "text", *(F.lit(f"own {c}").alias(c) for c in CLASHES))


def test_packing_does_not_read_clashing_columns(spark, clashing, plain_rows):
    made = packing.pack(clashing, FILE, Scratch(spark, "test")).collect()
    whole = Tokenizer.from_file(FILE)
    for doc_id, text in plain_rows:
        own = sorted((r["start"], bytes(r["ids"])) for r in made if r["doc_id"] == doc_id)
        assert np.frombuffer(b"".join(x for _, x in own), "<u4").tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 0]


def test_simhash_and_bpe_do_not_read_clashing_columns(spark, clashing, plain_rows):
    fps = {r["doc_id"]: r["fp"] for r in simhash.fingerprints(clashing, 3).collect()}
    assert list(fps.values()) == simhash.fingerprints_of([t or "" for _, t in plain_rows], 3).tolist()
    enc = bpe.Encoder(RANKS)
    for r in bpe.digests(clashing, RANKS).collect():
        assert r["ids_sha256"] == hashlib.sha256(enc.encode([dict(plain_rows)[r["doc_id"]] or ""])[0]).hexdigest()


def test_stages_carry_clashing_columns(spark, clashing, plain_rows):
    own = lambda r: all(r[c] == f"own {c}" for c in CLASHES)
    kept = neardup.keep_one(clashing, Scratch(spark, "test"))
    assert kept.columns == clashing.columns
    rows = kept.collect()
    assert all(map(own, rows)) and 40 not in {r["doc_id"] for r in rows}
    with pytest.raises(ValueError, match="kept"):
        suffix.dedup(clashing, Scratch(spark, "test"), carry=CLASHES)
    staged = corpus_pipeline.substring_stage(spark, clashing, "")
    assert staged.columns == clashing.columns and all(map(own, staged.collect()))
    made = suffix.dedup(clashing, Scratch(spark, "test"), carry=[c for c in CLASHES if c != "kept"]).collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in made)
    assert got == brute_spans(plain_rows)
    assert all(map(own, rules.clean(clashing).collect()))
    scored = quality.score(clashing.drop("score"), quality.fit([], []), out="verdict").collect()
    assert all(r["verdict"] == 0.5 and r["rules"] == "own rules" for r in scored)


def test_rows_that_share_an_id_keep_their_texts(spark):
    rng = random.Random(13)
    one, two, three = (prose(rng, 60) for _ in range(3))
    rows = [(1, one), (1, two), (1, one), (2, two), (3, three), (3, None), (None, one), (None, one)]
    made = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "test")).collect()
    assert sorted(map(str, map(tuple, made))) == sorted(map(str, [(1, one), (1, two), (3, three), (3, None), (None, one), (None, one)]))


@pytest.fixture(scope="module")
def long_rows():
    """Texts beyond a chunk, a shard, a block and an Arrow batch of the operators."""
    rng = random.Random(14)
    words = [prose(rng, 1) for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    huge = text(900_000)
    assert len(huge) > 3 * bpe.CHUNK_CHARS and len(huge) > suffix.BLOCK_BYTES
    rows = [(0, huge), (1, text(50)), (2, huge[1_000_000:1_200_000]), (3, "x" * 40_000), (4, ""), (5, huge)]
    return [*rows, *((10 + i, text(rng.randint(1, 30))) for i in range(2 * packing.SHARD_DOCS + 50))]


def test_long_texts_and_many_documents_are_packed_whole(spark, long_rows):
    docs = spark.createDataFrame(long_rows, "doc_id long, text string").coalesce(1)
    made = packing.pack(docs, FILE, Scratch(spark, "test")).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", F.col("ids")).collect()
    whole = Tokenizer.from_file(FILE)
    by_doc, by_seq = {}, {}
    for r in made:
        by_doc.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text in long_rows:
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert b"".join(x for _, x, _ in sorted(by_doc[doc_id])) == ids.tobytes() and {n for *_, n in by_doc[doc_id]} == {len(ids)}
    for parts in by_seq.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and (ends[-1] == 1024 or ends[-1] & (ends[-1] - 1) == 0)
    assert sum(len(x) == 1 and x[0][1] < 1024 or sum(n for _, n in x) < 1024 for x in by_seq.values()) <= 11 * 9


def test_long_texts_by_the_other_operators(spark, long_rows):
    rows = long_rows[:30]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=packing.SPLIT, mergeable_ranks=ranks, special_tokens={})
    for r in bpe.digests(docs, RANKS).collect():
        ids = np.array(library.encode_ordinary(dict(rows)[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(dict(rows)[r["doc_id"]].encode()).hexdigest())
    removed = {r["doc_id"]: r["n_bytes"] - len(r["kept"]) for r in suffix.dedup(docs, Scratch(spark, "test")).collect()}
    assert removed[0] == 0 and removed[2] == len(rows[2][1].encode()) and removed[5] == len(rows[5][1].encode())
    assert removed[3] == 0  # a run of one letter repeats within its document only
    kept = {r["doc_id"] for r in neardup.keep_one(docs, Scratch(spark, "test")).select("doc_id").collect()}
    assert 0 in kept and 5 not in kept
    judged = {r["doc_id"]: r["rules"] for r in rules.evaluate(docs).collect()}
    for doc_id, text in rows[1:5]:
        if (want := plain_verdict(text)) is not None:
            assert (judged[doc_id]["kept"], judged[doc_id]["clean_text"]) == want[:2]
    assert judged[0]["n_words"] == 900_000 and judged[0]["n_repeat_words"] < 1000
    model = quality.fit([t for _, t in rows[10:]], [i % 2 for i in range(20)])
    alone = model.scores([rows[0][1]])
    assert np.allclose(model.scores([t for _, t in rows])[0], alone[0], atol=1e-6)


def test_operators_name_no_folder_of_the_machine():
    for path in Path(fotolith.llm.__file__).parent.glob("*.py"):
        text = path.read_text()
        assert not any(x in text for x in ("/opt/", "/root/", "/tmp", "mkdtemp", "localCheckpoint")), path


def test_many_ids_join_by_a_shuffle(spark, monkeypatch):
    few, many = spark.range(5), spark.range(50)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    plan = lambda df: spark.range(100).join(common.sided(df), "id", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(few) and "SortMergeJoin" in plan(many)


def test_near_copies_by_shuffled_joins(spark, plain_rows, monkeypatch):
    docs = spark.createDataFrame(plain_rows, "doc_id long, text string")
    by_broadcast = sorted(map(str, neardup.keep_one(docs, Scratch(spark, "test")).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(map(str, neardup.keep_one(docs, Scratch(spark, "test")).collect())) == by_broadcast
