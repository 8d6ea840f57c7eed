import random

import numpy as np
import pytest

from llm_fixtures import docs  # noqa: F401

from traitloom.llm.minhash import Settings, half_keys, minhash_components, minhashes, shingles


def naive_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def naive(rows):
    """[(doc_id, size, component)] by all pairs."""
    sets = [naive_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc_id)
    least = {i: min((x for x in found if x is not None), default=None) for i, found in ids.items()}
    return [(doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows)]


def families(seed, many, words=120):
    """Texts, copies with some words changed, chains of them, and texts that share a long passage."""
    pick = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for family in range(many):
        base = [f"w{pick.randrange(5000)}" for _ in range(pick.randrange(3, words))]
        if family % 3 == 0:
            base = passage + base
        texts.append(base)
        for _ in range(pick.randrange(6)):
            base = list(base if pick.random() < 0.5 else texts[-1])
            for _ in range(pick.randrange(1, 1 + max(1, len(base) // 25))):
                base[pick.randrange(len(base))] = f"n{pick.randrange(10**6)}"
            texts.append(base)
    pick.shuffle(texts)
    return [(i, " ".join(text)) for i, text in enumerate(texts)]


def check(found, rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr)
    assert got == sorted(naive(rows), key=repr)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize("most", [2048, 8])
def test_families(docs, most):  # noqa: F811
    rows = families(most, 60)
    check(minhash_components(docs(rows), Settings(most=most)).collect(), rows)


def test_hot_group(docs, no_broadcast):  # noqa: F811
    """Hundreds of near copies, of which not all are linked, beside exact ones."""
    pick = random.Random(1)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(250):
        text = list(base)
        for _ in range(pick.choice([0, 1, 2, 6])):
            text[pick.randrange(90)] = f"n{pick.randrange(50)}"
        rows.append((i, " ".join(text)))
    check(minhash_components(docs(rows), Settings(most=16)).collect(), rows)


def test_nulls_empty_short_repeats_and_clashing_columns(docs):  # noqa: F811
    same = " ".join(f"w{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "one two\tTWO"), (None, same), (9, same), (9, same)]
    rows += [(None, "quite alone here"), (10, "É b c"), (11, "é b c"), (12, same + " more")]
    found = minhash_components(docs(rows, extra=["a", "t", "id", "row"])).collect()
    assert len(found) == len(rows)
    check(found, rows)
    assert minhash_components(docs([])).count() == 0


def test_long_text(docs):  # noqa: F811
    long = [f"w{i * i % 9973}" for i in range(40_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:39_000])), (3, " ".join(long[:20_000]))]
    check(minhash_components(docs(rows)).collect(), rows)


def test_minhashes_estimate_and_tables_catch():
    rng = np.random.default_rng(5)
    settings = Settings()
    missed = 0
    for _ in range(300):
        common = rng.integers(0, 2**63, 170, dtype=np.uint64)
        own = [np.concatenate([common, rng.integers(0, 2**63, 15, dtype=np.uint64)]) for _ in range(2)]  # 0.85
        least = [minhashes(x, settings) for x in own]
        assert abs((least[0] == least[1]).mean() - 0.85) < 0.13
        same = (half_keys(least[0], settings) == half_keys(least[1], settings)).reshape(2, -1)
        missed += not same.any(axis=1).all()
    assert missed == 0


def test_shingles_tell_numbers_of_words_apart():
    assert len(np.intersect1d(shingles("a b"), shingles("a b a b"))) == 0
    assert len(shingles("a b c a b c")) == 3 and len(shingles("A  b\nc")) == 1
