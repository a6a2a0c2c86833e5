"""Alignment of two tokenizers against a plain version that uses the libraries and sets of byte offsets."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fotolith.llm import align
from fotolith.llm.common import Scratch, table
from fotolith.llm.packing import byte_letters
from fotolith.llm.queries import op11_align, vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
ODD = [
    "", None, " ", "  ", "\n", " \n ", "a", "hello world", "  two  spaces ", "tabs\tand\nlines\n\n  next", "</s>[INST] <|endoftext|> <s>", "▁", "a▁b", "naïve café ß 你好 🙂🙂",
    "\u0000x", "x" * 5000, "\n" * 300, " " * 300, "word " * 2000, "<0x0A>", "é  　 \r\n", "'s don't we'll",
]


class Plain:
    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        self.letters = byte_letters()

    def sides(self, text: str | None):
        if not text:
            return [], []
        made = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.letters[c] for c in w)) for i, w in zip(made.ids, made.tokens)]
        b = [(i, bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i in self.b.encode(text) for p in [self.b.id_to_piece(i)]]
        raw = (" " + text).encode()
        return (a, b) if b"".join(w for _, w in a) == raw == b"".join(w for _, w in b) else ([], [])

    def groups(self, text: str | None):
        """Groups of ids, and the linked pairs."""
        sides = self.sides(text)
        ends = [set(np.cumsum([len(w) for _, w in s]).tolist()) for s in sides]
        cuts, out, links = sorted(ends[0] & ends[1]), [], []
        done = [0, 0]
        at = [0, 0]
        for cut in cuts:
            group = []
            for k in (0, 1):
                own = []
                while at[k] < cut:
                    i, w = sides[k][done[k]]
                    at[k] += len(w)
                    done[k] += 1
                    own.append(i)
                group.append(own)
            out.append(group)
            links.append((group[0][-1], group[1][-1]))
        return len(sides[0]), len(sides[1]), out, links


def written(groups) -> str:
    return hashlib.sha256(";".join("|".join(",".join(map(str, s)) for s in g) for g in groups).encode()).hexdigest() if groups else ""


def expected(rows):
    plain = Plain()
    made = [(i, *plain.groups(t)) for i, t in rows]
    count = Counter(x for m in made for x in m[4])
    top: dict[int, int] = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return sorted(
        ((i, na, nb, len(g), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), written(g)) for i, na, nb, g, x in made), key=repr
    )


def rows_of(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_query_against_plain(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert rows_of(op11_align(spark, sf)) == expected(docs)


def test_odd_texts_nulls_and_repeats(spark):
    rows = list(enumerate(ODD)) + [(3, "hello world"), (None, "hello there"), (None, None), (3, "hello world")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row long, pair long")
    assert rows_of(align.aligned_links(docs, A, B, Scratch(spark, "align"))) == expected(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align.aligned_links(docs, A, B, Scratch(spark, "align")).collect() == []


def test_shuffled_counts_and_small_holds(spark, monkeypatch):
    """Counts that do not fit a broadcast, and tasks that give counts away early, change nothing."""
    monkeypatch.setattr(align, "sided", lambda df: df.hint("merge"))
    monkeypatch.setattr(align, "HELD_PAIRS", 3)
    rows = list(enumerate(ODD))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(align.aligned_links(docs, A, B, Scratch(spark, "align"))) == expected(rows)


@pytest.fixture(scope="module")
def pieces():
    return align.PieceTokens(B)


@given(st.lists(st.text(st.sampled_from(" \n\taeß▁.'<s>/0🙂token"), min_size=1, max_size=40), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_pieces_as_the_model_gives_them(pieces, texts):
    assert pieces.apart
    raw = [(" " + t).encode() for t in texts if "▁" not in t]
    if raw:
        ids, many = pieces.encode(b"".join(raw), align.lengths(raw))
        parts = np.split(ids, np.cumsum(many)[:-1])
        assert [p.tolist() for p in parts] == [pieces.model.encode(t.decode()[1:]) for t in raw]


@given(st.lists(st.integers(1, 70), min_size=1, max_size=60), st.randoms())
def test_ranks_and_cuts(sizes, random):
    whole = sum(sizes)
    other = sorted({whole, *(random.randrange(1, whole + 1) for _ in range(20))})
    lengths_b = np.diff([0, *other])
    made = align.Groups(np.array(sizes), lengths_b)
    ends = np.cumsum(sizes)
    cuts = sorted(set(ends.tolist()) & set(other))
    assert (made.cuts + 1).tolist() == cuts
    assert made.upto_a.tolist() == [int((ends <= c).sum()) for c in cuts]
    assert made.upto_b.tolist() == [sum(o <= c for o in other) for c in cuts]
