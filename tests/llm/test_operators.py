"""Operators and registered queries through Spark, against brute force, with odd rows."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fotolith.llm import bitslice, chat, components, html_text, neardup, packing, quality, queries, rules, simhash, suffix, warc
from fotolith.llm.common import Scratch
from tests.llm.test_kernels import brute_spans
from tests.llm.test_rules import plain_verdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def save(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs():
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = []
    for i in range(60):
        text = prose(rng, rng.randint(0, 60))
        if i % 3 == 0:
            text += base[rng.randint(0, 200) :][: rng.randint(30, 300)]
        rows.append((i, text, "en", "s", len(text)))
    near = base.split()
    for k in range(12):
        own = list(near)
        own[k * 9] = "changed"
        rows.append((100 + k, " ".join(own), "en", "s", 1))
    rows += [(200, None, None, None, None), (201, "", "", "", 0), (202, "  \n\t ", "x", "y", 1), (203, base, "a", "b", 2), (203, base, "a", "b", 2), (204, base, "a", "b", 2), (None, base, "n", "n", 3), (None, None, None, None, None), (205, "word " * 4000, "l", "l", 4)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, odd_docs, tmp_path_factory):
    base = tmp_path_factory.mktemp("odd")
    labels = [(i, i % 2, 0) for i in range(60)] + [(200, 1, None), (None, 1, 1), (3, None, 0)]
    return save(spark, base, documents=(odd_docs, DOCS), labels=(labels, "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return save(
        spark, tmp_path_factory.mktemp("empty"), documents=([], DOCS), labels=([], "doc_id long, quality int, toxic int"), pages=([], "page_id long, url string, html string"),
        conversations=([], "conv_id long, turn long, role string, text string"), embeddings=([], "vec_id long, embedding array<float>, label int"),
    )


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_over_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == (1 if name.startswith("op1_") else 0)


def test_pipeline_over_an_empty_table(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", ["op2_packing", "op5_simhash", "op6_quality", "op8_suffix_array", "op9_quality_rules", "op10_bpe"])
def test_queries_keep_every_document(spark, folder, odd_docs, name):
    rows = queries.QUERIES[name](spark, folder).collect()
    count = sorted((r["doc_id"] for r in rows), key=str)
    if name == "op2_packing":
        assert set(count) == {r[0] for r in odd_docs}
    else:
        assert count == sorted((r[0] for r in odd_docs), key=str)


def check_packing(spark, sf_dir):
    whole = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    pieces = queries.op2_packing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"]).collect()
    for d in docs:
        ids = np.array([*whole.encode(d["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted({(p["start"], p["length"], p["ids_crc32"]) for p in pieces if p["doc_id"] == d["doc_id"]})
        mine = [p for p in pieces if p["doc_id"] == d["doc_id"]]
        assert {p["doc_tokens"] for p in mine} == {len(ids)}
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in own)
        assert sum(p["length"] for p in mine) % len(ids) == 0
    for seq in {p["sequence_id"] for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p["sequence_id"] == seq), key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 1024 or at & (at - 1) == 0


def test_packing(spark, folder, sf):
    check_packing(spark, folder)
    check_packing(spark, sf)


def test_packing_is_lexical(spark):
    rng = random.Random(1)
    topics = [[prose(rng, 1) + str(t) for _ in range(30)] for t in range(4)]
    rows = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(60))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    made = packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"), Scratch(spark, "test"), window=1024).collect()
    same = total = 0
    for seq in {p["sequence_id"] for p in made}:
        ids = [p["doc_id"] % 4 for p in made if p["sequence_id"] == seq]
        same += sum(a == b for a, b in combinations(ids, 2))
        total += len(ids) * (len(ids) - 1) // 2
    assert same > 0.6 * total


def brute_simhash(rows):
    fps = simhash.fingerprints_of([t or "" for _, t in rows], 3).view(np.uint64).tolist()
    ids = [i for i, _ in rows]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in combinations(zip(ids, fps), 2):
        if (x ^ y).bit_count() <= 2:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (f"{x:016x}", find(i)) for i, x in zip(ids, fps)}


@pytest.mark.parametrize("bucket", [32, 2])
def test_simhash_components(spark, odd_docs, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "MAX_BUCKET", bucket)
    rng = random.Random(2)
    seed = [rng.getrandbits(64) for _ in range(3)]
    rows = [(i, t) for i, t, *_ in odd_docs if i is not None]
    made = simhash.classes(simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 3), Scratch(spark, "test")).collect()
    want = brute_simhash(rows)
    assert {(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in made} == {(i, *v) for i, v in want.items()}
    # Chains and balls of fingerprints.
    fps = set()
    for s in seed:
        for _ in range(60):
            x = s
            for b in rng.sample(range(12), rng.randint(0, 3)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(spark.createDataFrame(signed, "doc_id long, fp long"), Scratch(spark, "test")).collect()}
    label = list(range(len(fps)))
    for _ in fps:
        for a, b in combinations(range(len(fps)), 2):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                label[a] = label[b] = min(label[a], label[b])
        if all(label[a] == label[b] for a, b in combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2):
            break
    assert got == dict(enumerate(label))


def test_components_of_chains(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100 + rng.randint(0, i - 1)) for i in range(1, 30)] + [(7, 7), (500, 501), (501, 500)]
    rng.shuffle(edges)
    made = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    got = {r["node"]: r["root"] for r in made}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 501: 500}


def test_suffix_against_brute_force(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 2000)
    rng = random.Random(4)
    base = "".join(rng.choice("abcde ") for _ in range(300))
    rows = [(i, t) for i, t, *_ in odd_docs if i is not None]
    rows += [(300 + rng.randint(0, 40), base[rng.randint(0, 200) :][: rng.randint(40, 120)] + prose(rng, 3) + "aaaa" * rng.randint(0, 30)) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, {"x": i}.get("x"), "kept") for i, t in rows], "doc_id long, text string, block long, carried string")
    made = suffix.dedup(docs, Scratch(spark, "test"), carry=["block", "carried"])
    out = [(r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in made.collect()]
    assert sorted(out) == brute_spans(rows)
    assert all(r["block"] == r["doc_id"] and r["carried"] == "kept" for r in made.collect())


def test_near_copies_go_and_others_stay(spark, odd_docs):
    docs = spark.createDataFrame(odd_docs, DOCS)
    kept = neardup.keep_one(docs, Scratch(spark, "test"))
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert set(range(1, 60, 3)) - {i for i in ids if i is not None} <= {i for i, t, *_ in odd_docs if t is not None and not t.split()}
    assert len([i for i in ids if i is not None and (100 <= i < 112 or i in (203, 204))]) == 1
    assert ids.count(None) == 2
    assert len([i for i in ids if i in (200, 201, 202)]) <= 1


def test_near_copies_of_a_large_group(spark):
    rng = random.Random(11)
    base = prose(rng, 200).split()
    rows = []
    for i in range(600):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(200)] = "x" + str(rng.randint(0, 9999))
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, prose(rng, 200)) for i in range(200)]
    kept = [r["doc_id"] for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "test")).collect()]
    assert sorted(i for i in kept if i >= 1000) == list(range(1000, 1200))
    # Every two have at least 0.8 through others, so they are one group, and its least document stays.
    assert [i for i in kept if i < 1000] == [0]


def test_chat_round_trip(spark):
    rows = [
        (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 1, "user", "a < b [x] <\\s> [\\/INST] <\\\\/s>"), (1, 3, "assistant", None), (2, 1, "assistant", "plain é 😀"), (2, 1, "assistant", "plain é 😀"),
        (2, None, None, "first"), (None, 1, "we[/INST]ird", "<"), (3, 0, "user", ""), (4, 1, "assistant", "x</s"), (4, 2, "assistant", "s>[INST" * 400),
    ]
    made = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("mask"))).collect()}
    assert set(made) == {1, 2, 3, 4, None}
    for conv, got in made.items():
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t["role"], t["text"]) for t in got["turns"]] == [x[1:] for x in own]
        assert got["loss"] == "".join(x for _, r, x in own if r == "assistant")
        assert got["formatted"].count("<s>[INST]") == got["formatted"].count("</s>") == len(own)
        assert sum(m["before"] + m["loss"] + m["after"] for m in got["mask"]) == len(got["formatted"])
    assert made[1]["escaped"] and not made[2]["escaped"] and not made[3]["escaped"]


def test_chat_plan_is_native(spark, sf):
    plan = queries.op1_chat(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_warc_of_odd_pages(spark):
    rows = [(3, "u", "same"), (1, None, "same"), (2, "u\n", "same"), (2, "u", "same"), (5, "x", None), (4, "x", ""), (None, "n", "same"), (None, "n", "other"), (9, "é", "é" * 9000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    back = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(back) == len(rows)
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back), key=str)
    want = [(1, "response", None, 4), (2, "revisit", 1, 4), (2, "revisit", 1, 4), (3, "revisit", 1, 4), (4, "response", None, 0), (5, "revisit", 4, 0), (9, "response", None, 18000), (None, "revisit", 1, 4), (None, "response", None, 5)]
    assert kinds == sorted(want, key=str)
    few = warc.read_archives(warc.write_archives(pages, min_bytes=5)).where("record_type = 'revisit'").count()
    assert few == 0


def test_warc_files_are_read_as_binary(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 20) for i in range(30)], "page_id long, url string, html string")
    for r in warc.write_archives(pages).collect():
        (tmp_path / r["archive"]).write_bytes(r["content"])
    back = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in back) == [(i, f"<p>{i}</p>" * 20) for i in range(30)]


def test_html_of_odd_pages(spark):
    rows = [(1, "u", None), (None, None, "<p>x</p>"), (1, "u", ""), (2, "u", "<article><p>A &lt; b</p></article>")]
    made = html_text.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int"))
    assert sorted((r["text"] for r in made.collect())) == ["", "", "A < b", "x"]


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (7, [2.0]), (None, [1.0, 1.0]), (100, None), (8, [-1.0, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    made = bitslice.top_k(df, df.where("vec_id % 50 = 0"), 5, Scratch(spark, "test")).collect()
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (0, 50):
        cand = [(i, v) for i, v in rows if i in whole and v is not None and i != q]
        best = sorted((-sum(a * b for a, b in zip(whole[i], whole[q])), i) for i, _ in cand)[:5]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in made if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in best]
    assert {r["query_id"] for r in made} == {0, 50}


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bitslice, "BLOCK_ROWS", 40)
    monkeypatch.setattr(bitslice, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    made = bitslice.top_k(df, df.where("vec_id % 50 = 0"), 5, Scratch(spark, "test")).collect()
    whole = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 400, 50):
        order = [i for i in np.lexsort((np.arange(400), -(whole @ whole[q]))) if i != q][:5]
        assert [r["vec_id"] for r in sorted((r for r in made if r["query_id"] == q), key=lambda r: r["rank"])] == order


def test_rules_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 5, 7, "s"), (2, " ".join(f"w{i}" for i in range(40)) + ".", 8, None)], "doc_id long, text string, rules int, score string")
    assert [tuple(r) for r in rules.clean(docs).collect()] == [(2, " ".join(f"w{i}" for i in range(40)) + ".", 8, None)]
    scored = quality.score(docs, quality.fit([], []))
    assert scored.columns == ["doc_id", "text", "rules", "score"] and scored.schema["score"].dataType.simpleString() == "double"


def test_quality_on_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    made = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels)).where(quality.held_out())
    rows = made.join(labels, "doc_id").select("score", "quality").collect()
    y, s = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    assert ((s >= quality.ACCEPT) == y).mean() > 0.98
    assert zlib.crc32(b"12") % 5 == spark.sql("select crc32('12') % 5").first()[0]


def test_quality_sample_skips_held_out_rows(spark, folder):
    texts, marks = quality.sample(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    allowed = {i for i in [*range(60), 200] if zlib.crc32(str(i).encode()) % 5}
    assert len(texts) == len(marks) == len(allowed)


def test_pipeline_by_its_rules(spark, sf):
    """Every stage against plain versions on its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    text = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    scratch = Scratch(spark, "test")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = text(docs)
        docs = scratch.write(stage(spark, docs, sf), f"s{k}")
        if k == 4:
            made = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
            assert {r["doc_id"] for r in made} == set(before) and all(r["n"] == r["t"] for r in made)
            break
        assert docs.columns == columns
        after = text(docs)
        if k == 0:
            good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()} & set(before)
            assert len(good - set(after)) <= 0.02 * len(good)
        if k == 1:
            plain = {i: plain_verdict(x or "") for i, x in before.items()}
            assert {i: x for i, x in after.items() if plain[i]} == {i: p[1] for i, p in plain.items() if p and p[0]}
        if k == 2:
            shingles = {i: set(simhash.shingle_hashes((x or "").encode(), 5)) for i, x in before.items()}
            near = [(a, b) for a, b in combinations(before, 2) if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
            assert not [p for p in near if p[0] in after and p[1] in after]
            assert set(before) - set(after) <= {i for p in near for i in p}
        if k == 3:
            seen: set[bytes] = set()
            for i in sorted(before):
                raw = (before[i] or "").encode()
                own = [raw[p : p + suffix.WIDTH] for p in range(len(raw) - suffix.WIDTH + 1)]
                gone = {q for p, x in enumerate(own) if x in seen for q in range(p, p + suffix.WIDTH)}
                seen.update(own)
                assert after[i] == bytes(c for q, c in enumerate(raw) if q not in gone).decode("utf-8", "ignore")
