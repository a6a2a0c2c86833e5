"""Near-copy removal against brute force, where fingerprints alone miss pairs."""

import random
from itertools import combinations

from fotolith.llm import neardup
from fotolith.llm.common import Scratch
from tests.llm.test_operators import prose


def edited(words, rng, n, at=None):
    """``n`` words replaced, no two of them within one shingle."""
    own = list(words)
    for k in rng.sample(range(5, len(words) - 5, 10), n) if at is None else at:
        own[k] = f"x{rng.randint(0, 10**9)}"
    return own


def brute_kept(rows):
    """The least doc_id of each component of the pairs at 0.8 or more."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted(i for i in root if root[i] == i)


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r["doc_id"] for r in neardup.keep_one(docs, Scratch(spark, "test")).collect())


def test_every_pair_just_above_the_similarity_is_found(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        base = prose(rng, 200).split()
        rows += [(i, " ".join(base)), (1000 + i, " ".join(edited(base, rng, 4)))]  # 176 / 216 = 0.815
    assert kept(spark, rows) == list(range(150)) == brute_kept(rows)


def family(rng, members, first):
    """Members of one template, most pairs at 0.73 to 0.77, each with a partner at 0.8 or more."""
    base = prose(rng, 200).split()
    rows = []
    for i in range(members):
        slots = rng.sample(range(5, 195, 10), 7)
        own = edited(base, rng, 0, slots[:3])
        rows += [(first + i, " ".join(own)), (first + 10_000 + i, " ".join(edited(own, rng, 0, slots[3:])))]
    return rows


def test_partners_beyond_the_nearest_of_a_template_are_found(spark):
    rows = family(random.Random(5), 150, 0)
    assert kept(spark, rows) == brute_kept(rows)


def test_partners_beyond_the_reach_of_hot_keys_are_found(spark):
    rng = random.Random(6)
    rows = family(rng, 400, 0) + family(rng, 100, 50_000)
    assert kept(spark, rows) == brute_kept(rows)


def test_edits_of_one_text_leave_one_survivor(spark):
    rng = random.Random(11)
    base = prose(rng, 200).split()
    rows = []
    for i in range(600):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(200)] = "x" + str(rng.randint(0, 9999))
        rows.append((i, " ".join(own)))
    assert kept(spark, rows) == [0] == brute_kept(rows)


def test_partners_of_members_that_do_not_stand_for_their_group_are_found(spark):
    rng = random.Random(8)
    rows = []
    for g in range(40):
        core = prose(rng, 200).split()
        group = [edited(core, rng, 1) for _ in range(8)]
        slots = [k for k in range(5, 195, 10) if group[0][k] == core[k]]
        partner = edited(group[0], rng, 0, rng.sample(slots, 4))  # 0.815 to one member, 0.774 or less to the others
        others = [edited(partner, rng, 0, rng.sample(range(8, 195, 10), 5)) for _ in range(10)]
        rows += [(100 * g + k, " ".join(w)) for k, w in enumerate([core, *group, partner, *others])]
    assert kept(spark, rows) == brute_kept(rows)
