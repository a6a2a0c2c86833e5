"""Kernels against plain versions, without Spark."""

import base64
import hashlib
import itertools
import os
import random
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import pytest
import tiktoken
from tokenizers import Tokenizer

from fotolith.llm import bitslice, bpe, html_text, neardup, packing, quality, queries, rules, simhash, suffix, warc

RANKS = queries.vocabulary("byte_bpe_50k.tiktoken")
FILE = queries.vocabulary("byte_bpe_50k.json")
SIGNS = " \n\t'strevmld.!aéß１2 　中😀\x1c\x85''  "


def strings(n, size, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, size))) for _ in range(n)]


ODD = ["", " ", "  ", "a" * 3000, "'" * 200, "ab " * 500, "é" * 300, "'s't", "x''t", "\n x", "\n\n  x", "I'll've", " 's"]


@pytest.fixture(scope="module")
def reference_encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=packing.SPLIT, mergeable_ranks=ranks, special_tokens={})


def test_bpe_encodes_and_decodes_like_the_library(reference_encoding):
    enc = bpe.Encoder(RANKS)
    texts = strings(3000, 40, 1) + ODD
    for text, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference_encoding.encode_ordinary(text)
        assert enc.decode(ids) == text.encode()
        assert not ids or enc.offsets(ids)[-1] == len(text.encode())


def test_long_pieces_merge_alike():
    enc = bpe.Encoder(RANKS)
    rng = random.Random(2)
    for _ in range(200):
        piece = bytes(rng.choice(b"abetion") for _ in range(rng.randint(2, 46)))
        assert bpe.merge(piece, enc.cache.ranks) == bpe.merge_long(piece, enc.cache.ranks)


def test_cache_generations_change_nothing(monkeypatch, reference_encoding):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 10)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    texts = strings(300, 30, 3)
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(RANKS).encode(texts)] == [reference_encoding.encode_ordinary(t) for t in texts]
    cache, whole = packing.TokenCache(FILE), Tokenizer.from_file(FILE)
    for text, ids in zip(texts, cache.encode(texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("fast", [True, False])
def test_token_cache_matches_the_file(fast):
    cache, whole = packing.TokenCache(FILE), Tokenizer.from_file(FILE)
    assert cache.merger is not None
    if not fast:
        cache.merger = None
    texts = strings(2000, 40, 4) + ODD + ["x<|endoftext|>y", "<|endoftext|>"]
    for text, ids in zip(texts, cache.encode(texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_token_cache_matches_the_file_on_documents(sf):
    cache, whole = packing.TokenCache(FILE), Tokenizer.from_file(FILE)
    texts = [t or "" for t in ds.dataset(f"{sf}/documents.parquet").to_table()["text"].to_pylist()] + ["y" * 9000 + "z" * 5000, "中文，" * 3000]
    for text, ids in zip(texts, cache.encode(texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def plain_bm25(docs, query, idf, mean):
    """Scores of all documents for the different terms of the query, by the formula."""
    out = []
    for own in docs:
        counts = Counter(own.tolist())
        length = 1 - packing.B + packing.B * len(own) / mean
        out.append(sum(idf[t] * counts[t] * (packing.K1 + 1) / (counts[t] + packing.K1 * length) for t in set(query.tolist()) if t in counts))
    return out


@pytest.mark.parametrize("frequent", [2, 32, 1000])
def test_shard_scores_are_bm25_of_the_whole_query(monkeypatch, frequent):
    monkeypatch.setattr(packing, "FREQUENT", frequent)
    monkeypatch.setattr(packing, "STEP", 100)
    rng = np.random.default_rng(3)
    docs = [(rng.zipf(1.4, int(n)) % 3000).astype("<u2") for n in [*rng.integers(1, 400, 80), 1, 1]]
    idf = rng.random(3000) * 8
    shard = packing.Shard(docs, idf, 150.0)
    for seed in range(len(docs)):
        plain = plain_bm25(docs, docs[seed], idf, 150.0)
        others = np.arange(len(docs)) != seed  # a seed is in use: terms that only it has are not scored
        assert np.allclose(shard.scores[seed][others], np.array(plain)[others], rtol=1e-4, atol=1e-4)
        shard.unused[:] = others
        plain[seed] = 0
        got = list(itertools.islice(shard.neighbours(seed), 10))
        best = sorted(range(len(docs)), key=lambda d: -plain[d])[:10]
        assert len(set(got) & {d for d in best if plain[d] > 0}) >= 0.9 * sum(plain[d] > 0 for d in best)
    shard.unused[:] = False
    assert list(shard.neighbours(0)) == []


def test_similar_documents_are_dealt_together():
    rng = np.random.default_rng(6)
    topics = [rng.choice(2000, 150, replace=False) for _ in range(8)]
    docs = [rng.choice(topics[i % 8], 200).astype("<u2") for i in range(800)]
    dealer = packing.Dealer(docs[:400], 2000)
    key = [dealer.key(np.unique(d)) for d in docs]
    order = sorted(range(800), key=lambda i: key[i])
    near = np.mean([order[k] % 8 == order[k + 1] % 8 for k in range(799)])
    assert near > 0.9
    assert packing.Dealer([], 10).key(np.zeros(0, np.int64)) == 0


def test_golay_keys_miss_nothing_within_two_bits():
    rng = np.random.default_rng(0)
    a = rng.integers(-(2**63), 2**63 - 1, 500)
    sets = lambda fps: [set(k[r == i].tolist()) for r, k in [simhash.keys_of(fps)] for i in range(len(fps))]
    own = sets(a)
    assert max(map(len, own)) <= 18
    for n in (1, 2):
        b = a.copy().view(np.uint64)
        for i in range(len(b)):
            for bit in rng.choice(64, n, replace=False):
                b[i] ^= np.uint64(1) << np.uint64(bit)
        assert all(x & y for x, y in zip(own, sets(b.view(np.int64))))


def test_golay_decoding_is_nearest():
    words = np.random.default_rng(1).integers(0, 1 << 23, 200)
    codewords = np.arange(1 << 23)[simhash.golay()[1][simhash.golay()[0][0][np.arange(1 << 23) & 255] ^ simhash.golay()[0][1][np.arange(1 << 23) >> 8 & 255] ^ simhash.golay()[0][2][np.arange(1 << 23) >> 16 & 255]] == 0]
    assert len(codewords) == 4096
    for w, index in zip(words, simhash.decode(words)):
        apart = np.bitwise_count(codewords ^ w)
        assert apart.min() <= 3
        assert codewords[apart.argmin()] >> 11 == index


def test_fingerprint_by_hand():
    import xxhash

    text = "The CAT sat\ton the\x0bmat thé"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    got = simhash.fingerprints_of([text, "", "  ", "One"], 3).view(np.uint64).tolist()
    assert got == [want, 0, 0, xxhash.xxh64_intdigest(b"one", 42)]


def test_bit_slices_find_the_exact_best():
    rng = np.random.default_rng(3)
    for n, d, scale in ((1, 3, 1), (5, 4, 1), (70, 8, 1), (900, 16, 1), (300, 8, 1000), (200, 4, 0)):
        x = np.floor(256 * scale * rng.normal(size=(n, d))).astype(np.int64)
        if n == 900:
            x[100:500] = x[7]
        ids = rng.permutation(n).astype(np.int64)
        index = bitslice.Index(ids, x)
        for q in range(min(n, 25)):
            got, score = index.top(int(ids[q]), x[q], 5)
            exact = x @ x[q]
            order = [i for i in np.lexsort((ids, -exact)) if ids[i] != ids[q]][:5]
            assert got.tolist() == ids[order].tolist()
            assert score.tolist() == exact[order].tolist()


def plain_repeats(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(hit)


def test_rules_by_hand():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += ["", " \n\t", "one", "a b\na b\n\na b", "x # y * z $ % & | < >", "Ünïcode wörds\x0bhere\x1cjoined", "same " * 5000]
    for text, row in zip(texts, rules.judge(texts)):
        words = text.encode().split()
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert row[:5] == (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), plain_repeats(words))
        assert row[5] == (len(words) < 20 or 100 * row[4] > 30 * len(words))
        assert not (row[5] and row[6])


def test_line_rules():
    rng = random.Random(7)
    lines = [" ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(15)) + ".\n" for _ in range(12)]
    prose = "".join(lines)
    nav, noisy = "Home | About | Contact | Help | More\n", "Buy### now*** this%%% is$$$ cheap&&& and### loud***\n"
    row = rules.judge([prose + nav + noisy + lines[3]])[0]
    assert row[6] and nav.strip() not in row[10] and noisy.strip() not in row[10]
    assert row[10].count(lines[3].strip()) == 1 and row[8] == 3
    assert rules.judge([prose])[0][10] == prose
    bad = rules.judge([nav + "A | B | C | D | E | F | G\n" + noisy + "Menu | Cart | Shop | Login | Help | Blog | Jobs"])[0]
    assert not bad[5] and not bad[6]


def test_warc_round_trip_and_validation():
    made = []
    for i in range(80):
        body = (b"page %d, " % i) * (i * 7)
        made.append(warc.make_record(i, "http://x/\r\nInjected: y", body, warc.base32_sha1(body), 0, i % 3 != 1))
    made.append(warc.make_record(None, "", b"", warc.base32_sha1(b""), None, True))
    for records in (made, made[:1], made[-1:]):
        archive = warc.make_archive(records)
        assert list(warc.records_of(archive)) == records
    rows = [warc.read_record(r) for r in made]
    assert [r[2] for r in rows[:3]] == ["response", "revisit", "response"]
    assert rows[1][3] is None and rows[1][4] == 8 * 7 and rows[1][6] == 0
    assert rows[-1][0] is None
    with pytest.raises(ValueError):
        warc.read_record(made[0].replace(b"WARC/1.1", b"WARC/9.9"))
    with pytest.raises(ValueError):
        warc.read_record(made[3][:-1])
    with pytest.raises(ValueError):
        warc.read_record(made[3].replace(b"page 3", b"page 4", 1))
    archive = warc.make_archive(made)
    for broken in (archive[:-3], archive[1:], archive[:5]):
        with pytest.raises(Exception):
            list(warc.records_of(broken))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, really, all of them.</p></div>
%s<div id="comments"><p>Great post, thanks, I liked it a lot, really.</p></div><form><p>Name, please</p></form><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    "body",
    [
        "<article><h2>Head &amp; line</h2><p><b>First, para\n of  text<br><p>Second&nbsp;para, too.</article>",
        "<div><h2>Head &amp; line</h2><p>First, para of text</p><p>Second para, too.</p></div>",
        '<div class="page with-sidebar"><div class="no-ads"><h2>Head &amp; line</h2><p>First, para of text</p><p>Second para, too.</p><div class="sidebar"><p>Side, bar</p></div></div></div>',
        "<main><section><h2>Head &amp; line</h2></section><div><p>First, para of text<p>Second para, too.</div><aside>Side</aside></main>",
    ],
)
def test_main_text(body):
    assert html_text.main_text(PAGE % body) == "Head & line\nFirst, para of text\nSecond para, too."


def test_main_text_of_broken_pages():
    assert html_text.main_text("") == ""
    assert html_text.main_text("<!-- never closed <p>x") == ""
    assert html_text.main_text("a < b &lt; c") == "a < b < c"
    assert html_text.main_text("<div>" * 20000 + "deep") == "deep"
    assert html_text.main_text("</p></div></b>x") == "x"
    assert html_text.main_text("<script>if (a</script>x") == "x"
    assert isinstance(html_text.main_text('<p "' * 5000), str)


def brute_spans(docs, width=suffix.WIDTH):
    raw = [(i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, b in raw:
        for p in range(len(b) - width + 1):
            g = b[p : p + width]
            first[g] = min(i, first.get(g, i))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < i:
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_cover_has_a_common_sample_for_any_two_positions():
    cover = set(suffix.COVER)
    for a in range(suffix.PERIOD):
        for b in range(suffix.PERIOD):
            assert any((a + k) % suffix.PERIOD in cover and (b + k) % suffix.PERIOD in cover for k in range(suffix.WIDTH - suffix.TRIPLE))


def test_names_order_triples_by_their_text():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 90))) for _ in range(60)]
    blocks = []
    for k in range(0, 60, 20):
        part = texts[k : k + 20]
        blocks.append(suffix.Block(np.arange(k, k + 20), np.array([len(x) for x in part]), b"".join(part)))
    plan = suffix.Plan(1, 30, [np.zeros(0, np.uint64)] * 7)
    at = [b.samples() for b in blocks]
    sent = [suffix.send_triples(b, plan, x)[0][1] for b, x in zip(blocks, at)]
    found = [[{"bucket": 0, "reply": r}] for r in suffix.meet_triples(sent)]
    named = [suffix.named(b, plan, x, f) for b, x, f in zip(blocks, at, found)]
    every = sorted({b.data[p : p + suffix.TRIPLE] for b, x in zip(blocks, at) for p in x.tolist()})
    for b, own in zip(blocks, named):
        assert [every.index(b.data[p : p + suffix.TRIPLE]) for p in own.at.tolist()] == own.name.tolist()
        here = b.documents(own.at) + b.ids[0]
        with_triple = lambda p: [i for i, t in enumerate(texts) if b.data[p : p + suffix.TRIPLE] in t]
        sampled = {x.data[p : p + suffix.TRIPLE]: [] for x, y in zip(blocks, at) for p in y.tolist()}
        for x, y in zip(blocks, at):
            for p in y.tolist():
                sampled[x.data[p : p + suffix.TRIPLE]].append(int(x.documents(np.array([p]))[0] + x.ids[0]))
        for p, doc, early, late in zip(own.at.tolist(), here.tolist(), own.earlier, own.later):
            docs = sampled[b.data[p : p + suffix.TRIPLE]]
            assert set(docs) <= set(with_triple(p)) and (min(docs) < doc, max(docs) > doc) == (early, late)
        again = suffix.Named.load(own.state())
        assert all(np.array_equal(getattr(again, k), getattr(own, k)) for k in ("at", "name", "earlier", "later"))


def test_ranges_and_members():
    spans = suffix.ranges(np.array([5, 1, 9, 3, 20, 7]), np.array([6, 3, 9, 4, 25, 7]))
    assert spans.tolist() == [[1, 4], [5, 6], [20, 25]]
    assert suffix.members(spans).tolist() == [1, 2, 3, 5, 20, 21, 22, 23, 24]
    assert suffix.inside(np.array([0, 1, 3, 4, 5, 6, 24, 25]), spans).tolist() == [False, True, True, False, True, False, True, False]


def test_quality_learns_symbols():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(rng.randint(10, 80))).capitalize() + "." for _ in range(150)]
    bad = [" ".join(word() + rng.choice(["***", "###", "$$$"]) for _ in range(rng.randint(10, 80))) for _ in range(60)]
    model = quality.fit(good[:100] + bad[:40], [1] * 100 + [0] * 40)
    assert (model.scores(good[100:]) >= 0.5).mean() > 0.95
    assert (model.scores(bad[40:]) < 0.5).mean() > 0.95
    assert quality.fit([], []).scores(["", "x"]).tolist() == [0.5, 0.5]
    assert np.allclose(quality.fit(["a b", "c"], [1, 1]).scores(["", "x y"]), 1, atol=1e-4)


def test_packer_fills_windows_and_needs_no_padding():
    rng = np.random.default_rng(4)
    docs = [rng.integers(1, 50, int(n)).astype("<u2") for n in rng.integers(1, 300, 120)]
    packer = packing.Packer(64, 0)
    idf = np.ones(60)
    for k in range(0, 120, 50):
        packer.shard(list(range(k, min(k + 50, 120))), docs[k : k + 50], idf, 100.0)
    packer.finish()
    by_doc, by_seq = {}, {}
    for d, start, ids, n, seq, offset in packer.done:
        by_doc.setdefault(d, []).append((start, ids))
        by_seq.setdefault(seq, []).append((offset, len(ids)))
    assert all(np.array_equal(np.concatenate([x for _, x in sorted(by_doc[d], key=lambda y: y[0])]), docs[d]) for d in range(120))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0


def test_sketches_of_near_copies_are_near():
    words = [f"w{i}" for i in range(300)]
    other = words[:150] + ["new"] + words[151:]
    sets = [np.unique(np.array(simhash.shingle_hashes(" ".join(w).encode(), 5), np.uint64)) for w in (words, other, [f"z{i}" for i in range(300)])]
    bits = [neardup.sketch(s) for s in sets]
    apart = lambda a, b: int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
    assert apart(bits[0], bits[1]) < neardup.NEAR_BITS < apart(bits[0], bits[2])
    assert os.path.exists(FILE)


def test_ranges_of_text_cut_by_the_whole_key():
    """A third of the strings share their first eight bytes, others sixteen: no bucket holds more than a few times the mean, and ranges are in order."""
    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, (6000, suffix.WIDTH), dtype=np.uint8)
    text[:2000, :8] = np.frombuffer(b"the same", np.uint8)
    text[2000:2500, :16] = np.frombuffer(b"the same sixteen", np.uint8)
    block = suffix.Block(np.arange(6000), np.full(6000, suffix.WIDTH), text.tobytes())
    at = np.arange(6000) * suffix.WIDTH
    strings = block.strings(at)
    probes = np.array(block.strings(at[::10]), np.uint64).T
    probes = probes[np.lexsort(probes.T[::-1])]
    for n in (1, 7, 60):
        cuts = [np.ascontiguousarray(c) for c in probes[np.linspace(0, len(probes), n, endpoint=False).astype(int)[1:]].T]
        plan = suffix.Plan(n, 30, cuts)
        for columns, size in ((strings, suffix.WIDTH), (block.triples(at), suffix.TRIPLE)):
            bucket = plan.bucket_of(columns)
            assert np.bincount(bucket, minlength=n).max() <= 3 * 6000 / n
            whole = [text[k, :size].tobytes() for k in range(6000)]
            keys = [b"".join(int(c[k]).to_bytes(8, "big") for c in cuts)[:48] + int(cuts[6][k]).to_bytes(2, "big") for k in range(n - 1)]
            assert bucket.tolist() == [sum(key[:size] <= w for key in keys) for w in whole]
    found, own, bucket = suffix.string_groups(block, plan, at)
    assert (np.diff(bucket) >= 0).all() and all((c[found.place] == s).all() for c, s in zip(own, strings))
    for b in np.unique(bucket):
        assert (np.diff(own[0][bucket == b].astype(object)) >= 0).all()


def test_blocks_and_buckets_of_large_corpora_keep_their_messages():
    """At 100 TB a message is as large as at the size from which blocks grow."""
    held = lambda total: total / ((total / (suffix.BLOCK_BYTES * suffix.grown(total))) * (total / (suffix.BUCKET_BYTES * suffix.grown(total))))
    assert suffix.grown(suffix.STEADY_BYTES) == 1 and suffix.grown(10**9) == 1
    assert held(100 << 40) == pytest.approx(held(suffix.STEADY_BYTES))
