"""Near copies that share neither a fingerprint's key nor a band of minima are found too, and groups are those of all pairs."""

import random

import numpy as np
import pytest

from runlens.llm import simhash
from runlens.llm.simhash import BAND, BANDS, PRINT_SHINGLE, majority, min_hashes, run_hashes, shingle_hashes


def runs_of(text, n=5):
    words = text.split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def near(a, b):
    a, b = runs_of(a), runs_of(b)
    return len(a & b) >= 0.8 * len(a | b)


def unseen(rnd):
    """A near pair whose fingerprints differ in more than 2 bits and whose minima differ in every band."""
    for _ in range(20_000):
        words = [f"u{rnd.randrange(10**6)}" for _ in range(50)]
        texts = " ".join(words), " ".join(words[:41])
        bands = [min_hashes(run_hashes(t.encode().split(), 5)).reshape(BANDS, BAND) for t in texts]
        fps = [majority(shingle_hashes(t.encode().split(), PRINT_SHINGLE)) for t in texts]
        if near(*texts) and not np.any(np.all(bands[0] == bands[1], axis=1)) and bin(fps[0] ^ fps[1]).count("1") > 2:
            return texts
    raise AssertionError("none found")


def test_near_groups_equal_all_pairs(spark):
    rnd, words = random.Random(3), [f"w{i}" for i in range(400)]
    texts = [t for _ in range(3) for t in unseen(rnd)]
    line = [f"common{i}" for i in range(14)]
    for g in range(12):
        # copies around the bound, texts that are mostly the common line, and short ones
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 9, 30, 60]))]
        texts += [" ".join(base[: max(5, len(base) * k // 100)] + line * (g % 2)) for k in (100, 90, 84, 80, 77)]
    texts += [" ".join(line + words[i : i + 3]) for i in range(8)] + ["one", "one two", "two one", "One  two"]
    docs = list(enumerate(texts))
    group = list(range(len(docs)))
    for i, a in docs:
        for j, b in docs[:i]:
            if near(a.lower(), b.lower()):
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in range(3))
    assert [got[i] for i, _ in docs] == group


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.9])
def test_near_sets_have_smallest_runs_in_common(similarity):
    rnd, seen = random.Random(9), 0
    for _ in range(3000):
        a = rnd.sample(range(10**9), rnd.randint(1, 80))
        b = [x for x in a if rnd.random() < (1 + similarity) / 2] + rnd.sample(range(10**9), rnd.randint(0, len(a) // 8))
        if not b or len({*a} & {*b}) < similarity * len({*a} | {*b}):
            continue
        (of_a, least_a), (of_b, least_b) = (simhash.common_least(len(x), similarity) for x in (a, b))
        assert len({*sorted(a)[:of_a]} & {*sorted(b)[:of_b]}) >= max(least_a, least_b)
        seen += 1
    assert seen > 300
