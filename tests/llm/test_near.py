"""Links of near-duplicates: every pair at or above the threshold, none below."""

import itertools
import random

import numpy as np
import pytest

from clausewright.llm import near


def linked(a, b, threshold):
    return len(a & b) >= threshold * len(a | b) - 1e-9


def texts(i, shared):
    """Two texts with `shared` of their three-word sequences in common and three more each."""
    words = [f"p{i}w{j}" for j in range(shared + 2)]
    return [" ".join(words + [f"p{i}{s}{j}" for j in range(3)]) for s in "ab"]


def test_every_pair_at_the_threshold_is_linked(spark):
    rows = [(f"{i:04}{s}", t) for i in range(1500) for s, t in zip("ab", texts(i, 6))]  # 6 of 12 sequences
    below = [(f"x{i:03}{s}", t) for i in range(100) for s, t in zip("ab", texts(f"x{i}", 5))]  # 5 of 11
    groups = near.near_duplicates(spark.createDataFrame(rows + below, "chunk_id string, text string"), "chunk_id", "text")
    got = {tuple(r) for r in near.group_pairs(groups, "chunk_id").collect()}
    assert got == {(f"{i:04}a", f"{i:04}b") for i in range(1500)}


def similar_sets(rng, count, values):
    """Sets with common and rare members, many of them changed copies of others."""
    sets = []
    while len(sets) < count:
        base = rng.choice(sets) if sets and rng.random() < 0.6 else set()
        kept = {v for v in base if rng.random() < rng.choice([0.6, 0.8, 0.95])}
        new = kept | {values[int(len(values) * rng.random() ** 3)] for _ in range(rng.randint(1, max(2, 30 - len(kept))))}
        if new not in sets:
            sets.append(new)
    return sets


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.55, 0.8, 1.0])
def test_links_of_blocks(monkeypatch, threshold):
    monkeypatch.setattr(near, "MET", 40)
    monkeypatch.setattr(near, "LARGE", 8)
    rng = random.Random(7)
    values = rng.sample(range(2**32), 300)
    sets = similar_sets(rng, 160, values)

    def block(at):
        at = sorted(at, key=lambda i: len(sets[i]))
        n = np.array([len(sets[i]) for i in at])
        grams = np.array([v for i in at for v in sorted(sets[i], key=values.index, reverse=True)], np.uint32)
        return near.prepared(np.array(at), n, n, grams, near.bitmaps(grams, n), threshold)

    x, y = block(range(100)), block(range(100, 160))
    got = [(min(p), max(p), o) for c, d in ((x, x), (x, y), (y, y)) for a, b, overlap, _ in near.block_links(c, d, threshold) for *p, o in zip(a.tolist(), b.tolist(), overlap.tolist())]
    want = [(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(range(160), 2) if linked(sets[a], sets[b], threshold)]
    assert sorted(got) == want and (len(want) > 5 or threshold == 1.0)


def test_hashes_alike_in_32_bits(spark, monkeypatch):
    monkeypatch.setattr(near, "ROWS", 20)
    monkeypatch.setattr(near, "SAMPLE", 50)
    rng = random.Random(8)
    sets = similar_sets(rng, 200, [(rng.randrange(-60, 60) << 32) + rng.randrange(5) for _ in range(250)])
    rows = [(str(i), i, len(s), sorted(s)) for i, s in enumerate(sets)]
    docs = spark.createDataFrame(rows + rows[:50], "id string, cls long, n int, grams array<bigint>").repartition(5)
    got = [tuple(r) for r in near.linked_pairs(docs, 0.5).select("a", "b").collect()]
    want = [(a, b) for a, b in itertools.combinations(range(200), 2) if linked(sets[a], sets[b], 0.5)]
    assert sorted(got) == want and len(want) > 20


def test_blocks_are_read_by_tasks(spark, monkeypatch, tmp_path):
    """No block goes through the JVM to be paired: the product had a CartesianProduct of them. One block a file, each two met once."""
    monkeypatch.setattr(near, "GRAMS", 150)  # several blocks in a partition
    monkeypatch.setattr(near, "scratch", lambda spark, name: f"file://{tmp_path}/a b%é/{name}")
    plans, cut = [], near.cut
    monkeypatch.setattr(near, "cut", lambda df: (plans.append(df._jdf.queryExecution().toString()), cut(df))[1])
    rng = random.Random(9)
    sets = similar_sets(rng, 120, rng.sample(range(2**62), 300))
    docs = spark.createDataFrame([(str(i), i, len(s), sorted(s)) for i, s in enumerate(sets)], "id string, cls long, n int, grams array<bigint>")
    got = [tuple(r) for r in near.linked_pairs(docs, 0.5).select("a", "b").collect()]
    assert sorted(got) == [(a, b) for a, b in itertools.combinations(range(120), 2) if linked(sets[a], sets[b], 0.5)] and len(got) > 20
    assert plans and not any(x in p for p in plans for x in ("CartesianProduct", "NestedLoopJoin"))
    assert not [*(tmp_path / "a b%é").iterdir()]


def test_words_of_tokens():
    said = ["", " _ ", "a_b c-d 'e' f", "\x1ca\x85b　c​d", "ΟΔΟΣ ΟΔΟΣ. Σ", "½a 1٣ अ्क ²3", "é x̂y ﬁn ＡＢ", "a b a"]
    known = near.Tokens()
    numbers = [known.of(near.common_form(t).lower()) for t in said]
    ids, size = known.words(numbers)
    words = [near.text_words(t) for t in said]
    assert size.tolist() == [len(w) for w in words] and ids.tolist() == [i for w in words for i in near.WordIds().of(w).tolist()]
    assert [x.tolist() for x in known.words(numbers[:2])] == [[], [0, 0]]
