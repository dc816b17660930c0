import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from twinline.llm import near

SCHEMA = "id long, text string, words string, class_id long, a string"


def words(t):
    return frozenset(re.findall(r"[^\W_]+", t.lower()))


def brute(data):
    out = set()
    for (i, s), (j, t) in itertools.combinations([d for d in data if d[1] is not None], 2):
        x, y = words(s), words(t)
        if (s == t) if not x and not y else len(x & y) * 5 >= len(x | y) * 4:
            out.add((min(i, j), max(i, j)))
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["Ünïcode", "日本", "Слово"]
    data = []
    for i in range(n):
        if data and rng.random() < 0.5:
            w = (rng.choice(data)[1] or "w1").split()
            for _ in range(rng.randint(0, 5)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [w[k].upper(), w[k]], [w[k], rng.choice(vocab)]])
                w = w or ["w2"]
            rng.shuffle(w) if rng.random() < 0.3 else None
        else:
            w = rng.choices(vocab, k=rng.randint(1, 40))
        data.append((i, " ".join(w)))
    return data


def frame(rows, data):
    return rows([(i, t, "x", 0, "x") for i, t in data], SCHEMA)


def test_pairs_equal_brute_force(rows):
    data = corpus(500, 4) + [(1000, None), (1001, ""), (1002, ""), (1003, "--"), (1004, "--"), (1005, "!"), (1006, "z " * 50_000), (1007, "Z")]
    got = [tuple(r) for r in near.id_pairs(frame(rows, data), F.col("id"), F.col("text")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)


def test_copies_and_emptiness(rows):
    data = [(i, "the very same text of some words") for i in range(30)] + [(50, "the very same text of some other words")]
    got = {tuple(r) for r in near.id_pairs(frame(rows, data), F.col("id"), F.col("text")).collect()}
    assert got == brute(data) and len(got) == 30 * 29 // 2 + 30
    assert near.id_pairs(frame(rows, []), F.col("id"), F.col("text")).count() == 0
    assert near.groups(frame(rows, []), F.col("id"), F.col("text")).count() == 0


def test_groups_follow_links(rows):
    base = [f"a{k}" for k in range(20)]
    chain = [(i, " ".join(base[i : i + 10])) for i in range(6)]  # neighbours share 9 of 11 words
    data = [*chain, (20, chain[0][1].upper()), (30, "alone here"), (31, None)]
    got = {r.id: (r.class_id, r.group_id) for r in near.groups(frame(rows, data), F.col("id"), F.col("text")).collect()}
    assert got == {**{i: (i, 0) for i in range(6)}, 20: (0, 0), 30: (30, 30)}


def components(pairs, nodes):
    up = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    return up


def test_groups_equal_brute_force(rows):
    data = corpus(300, 11)
    got = {r.id: r.group_id for r in near.groups(frame(rows, data), F.col("id"), F.col("text")).collect()}
    assert got == components(brute(data), [i for i, _ in data])


def test_blocks_of_a_bucket_give_all_pairs(rows, monkeypatch):
    """Buckets and classes larger than a block, and leaders that don't settle a bucket."""
    monkeypatch.setattr(near, "BLOCK", 7)
    monkeypatch.setattr(near, "ROUNDS", 1)
    base = [f"a{k}" for k in range(60)]
    data = [(i, " ".join(base[i : i + 30])) for i in range(25)] + [(100 + i, "one text of a few words") for i in range(40)] + [(200 + i, "one text of a few more words") for i in range(20)]
    got = [tuple(r) for r in near.id_pairs(frame(rows, data), F.col("id"), F.col("text")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(data)
    groups = {r.id: r.group_id for r in near.groups(frame(rows, data), F.col("id"), F.col("text")).collect()}
    assert groups == components(brute(data), [i for i, _ in data])


def test_a_template_is_grouped_in_linear_many_comparisons(rows, monkeypatch):
    compared = []
    original = near._verified
    monkeypatch.setattr(near, "_verified", lambda candidates, sets: compared.append(candidates.count()) or original(candidates, sets))
    n = 2000
    data = [(i, " ".join([*(f"word{k}" for k in range(30)), f"slot{i}"])) for i in range(n)]
    got = near.groups(frame(rows, data), F.col("id"), F.col("text"))
    assert got.filter("group_id = 0").count() == n
    assert sum(compared) < 20 * n  # of n * (n - 1) / 2 = 1000 * n pairs


def test_coordinates_estimate_the_similarity():
    """Each coordinate agrees with the similarity as its probability, for short and long sets; shifts are as good as new permutations."""
    rng = np.random.default_rng(3)
    for size in (10, 4000):
        share = []
        for _ in range(60):
            both, x, y = (rng.integers(0, 2**63, k) for k in (size * 8 // 10, size // 10, size - size * 8 // 10 - size // 10))
            flat, sizes = np.concatenate([both, x, both, y]), np.array([len(both) + len(x), len(both) + len(y)])
            s = near.signatures(flat.astype(np.int64), sizes, 392)
            share.append((s[0] == s[1]).mean())
        assert abs(np.mean(share) - 0.8) < 0.02 and np.std(share) < 2 * np.sqrt(0.16 / 392)
    x = np.random.default_rng(1).integers(0, 2**63, 10_000, dtype=np.uint64)
    odd = np.array([3, 5, 7], np.uint64)
    assert len(np.unique(near._permuted(x, odd))) == len(np.unique(x))


def test_recall_at_the_threshold(rows):
    """Pairs of exactly 0.8, which are the hardest to find."""
    rng = random.Random(9)
    data = []
    for k in range(400):
        shared = [f"s{k}x{j}" for j in range(rng.choice([4, 8, 12, 16]))]
        only = [f"o{k}x{j}" for j in range(len(shared) // 4)]
        data += [(2 * k, " ".join(shared)), (2 * k + 1, " ".join(shared + only))]
    got = {tuple(r) for r in near.id_pairs(frame(rows, data), F.col("id"), F.col("text")).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(400)}
