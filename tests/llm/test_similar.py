"""The pipeline's near-duplicate stage against all pairs by exact Jaccard similarity."""

import random

import numpy as np
import pytest

from auditloom.llm import simhash_dedup
from tests.llm import brute


def changed(rnd, words, places):
    words = list(words)
    for at in places:
        words[at] = f"x{rnd.randrange(10**9)}"
    return words


def test_spanning_joins_what_similar_sets_join():
    rnd = random.Random(4)
    for _ in range(40):
        sets = [np.array(sorted(rnd.sample(range(14), rnd.randint(8, 13)))) for _ in range(rnd.randint(2, 25))]
        roots = [rnd.randrange(6) for _ in sets]

        def joined(pairs):
            label = {r: r for r in roots}
            for i, j in pairs:
                a, b = label[roots[i]], label[roots[j]]
                label = {r: a if x == b else x for r, x in label.items()}
            return {frozenset(r for r in label if label[r] == x) for x in label.values()}

        every = [(i, j) for i in range(len(sets)) for j in range(i) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.8]
        found = simhash_dedup.spanning(sets, roots, 0.8)
        assert set(map(lambda p: (max(p), min(p)), found)) <= set(every) and joined(found) == joined(every)


@pytest.mark.parametrize("cap, block", [(2, 700), (8, 500_000)])
def test_keep_one_by_similarity(spark, cap, block):
    rnd = random.Random(8)
    texts = [None, "", "one two", "One  two"]
    for edits in (0, 1, 2, 3, 4, 5, 6, 8):  # similarities from 1 down to about 0.7
        base = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(base), " ".join(changed(rnd, base, rnd.sample(range(200), edits)))]
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    texts += [" ".join(changed(rnd, base, rnd.sample(range(300), 5))) for _ in range(40)]  # a large bucket, members near 0.7 to 0.9
    for _ in range(20):  # a chain
        base = changed(rnd, base, rnd.sample(range(300), 4))
        texts.append(" ".join(base))
    data = list(enumerate(texts))
    rnd.shuffle(data)
    got = simhash_dedup.keep_one(spark.createDataFrame(data, "doc_id long, text string"), group_cap=cap, block_shingles=block)
    assert sorted(r["doc_id"] for r in got.collect()) == brute.kept_ids(data)
    assert brute.kept_ids(data) != brute.kept_ids(data, 2)
