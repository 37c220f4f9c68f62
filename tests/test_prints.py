"""Groups of fingerprints against all pairs."""

import random

import pytest

from shelfwise.operators import prints


def rate(a, b):
    n = min(len(a), len(b))
    return sum(((x or 0) ^ (y or 0)).bit_count() for x, y in zip(a[:n], b[:n], strict=True)) / (n * 32)


def by_all_pairs(rows, limit):
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    head = lambda f: tuple((*[x or 0 for x in f], 0, 0, 0, 0)[:4])
    linked = set()
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if head(a) == head(b) and rate(a, b) <= limit:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
                linked |= {i, j}
    return {(i, top(i)) for i in linked}


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 5), (3, 3)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(prints, "BLOCK", block)
    rng = random.Random(seed)
    rows = []
    for head in range(4):
        base = [head, 2**32 - 1, 7, 9] + [rng.getrandbits(32) for _ in range(6)]
        for _ in range(40):
            fp = list(base[: rng.choice([10, 10, 9, 5])])
            for _ in range(rng.choice([0, 3, 9, 20])):
                k = rng.randrange(4, len(fp))
                fp[k] ^= 1 << rng.randrange(32)
            rows.append((rng.randrange(10**6) * 10 + head, fp))
            base = fp + base[len(fp) :] if rng.random() < 0.5 else base  # chains that drift away
    rows += [(5, [1, 2]), (6, [1, 2, 0, 0, 1]), (7, [1, 2, 0, None]), (8, [3])]
    rows = list({i: (i, f) for i, f in rows}.values())
    df = spark.createDataFrame([*rows, (None, [1, 2]), (9, []), (11, None)], "id bigint, fp array<bigint>").repartition(3)
    got = {(r.id, r.component) for r in prints.groups(df).collect()}
    assert got == by_all_pairs(rows, 0.05)


def test_a_bucket_of_very_many_like_prints(spark):
    """Three thousand prints a bit or two from one: all meet that one, none the others."""
    rows = [(k, [1, 2, 3, 4] + [1 << (k % 31), k // 31 % 4, 0, 0]) for k in range(3_000)]
    got = prints.groups(spark.createDataFrame(rows, "id bigint, fp array<bigint>"))
    assert {r.component for r in got.collect()} == {0} and got.count() == 3_000
