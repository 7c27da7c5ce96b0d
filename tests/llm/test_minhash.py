import itertools
import random

import numpy as np

from quarry.llm import minhash


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 2]) for i in range(len(words) - 1)} if len(words) > 1 else {tuple(words)} - {()}


def brute(rows, percent=80):
    """(doc_id, n_shingles, component_id, kept) with every pair of distinct sets compared."""
    sets = [frozenset(brute_set(t)) for _, t in rows]
    distinct = sorted({s for s in sets if s}, key=sorted)
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for a, b in itertools.combinations(distinct, 2):
        shared = len(a & b)
        if 100 * shared >= percent * len(a | b):
            root[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    out = []
    for (i, _), s in zip(rows, sets):
        c = least.get(find(s)) if s else i
        out.append((i, len(s), c, i == c))
    return out


def key(r):
    return tuple((x is None, x) for x in r)


def near(rng, words, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"z{rng.randrange(10**6)}"
    return out


def planted(prose, rng):
    rows = [(i, prose(rng.randint(1, 80))) for i in range(120)]
    chain = prose(100).split()
    for i in range(200, 215):  # each close to the one before it only
        chain = near(rng, chain, 3)
        rows.append((i, " ".join(chain)))
    for size in range(2, 9):  # sets at and beside the threshold: 4 of 5, 8 of 10 ...
        base = [f"u{size}w{j}" for j in range(size + 1)]
        rows += [(300 + 10 * size, " ".join(base)), (301 + 10 * size, " ".join(base + ["x"])), (302 + 10 * size, " ".join(base + ["y"]))]
    return rows


def test_equals_brute_force(documents, prose):
    rng = random.Random(2)
    rows = planted(prose, rng)
    rows += [(500, "A b C d"), (501, "a B c D"), (502, "a b c d"), (503, "É b"), (504, "é b"), (505, "one"), (506, "ONE"), (507, "two"),
             (508, ""), (509, None), (510, " \t"), (511, "a b c"), (7, "x y z"), (7, "x y z"), (7, "other text here"),
             (None, "x y z"), (None, "lonely row"), (None, "lonely row"), (None, None), (512, "w v " * 400), (513, "w v " * 500)]
    got = minhash.near_duplicates(documents(rows)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_large_groups_in_small_blocks(documents, prose):
    """Near copies of one text, far more than a block holds; texts that share a passage only."""
    rng = random.Random(5)
    base, shared = prose(60).split(), prose(30)
    rows = [(i, " ".join(near(rng, base, rng.randint(0, 4)))) for i in range(150)]
    rows += [(1000 + i, shared + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(8 + i % 5))) for i in range(60)]
    rows += [(i + 5000, t) for i, t in rows[:100]]
    got = minhash.near_duplicates(documents(rows), block=16).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_estimate_and_bands():
    """The corrected estimate is near the true similarity; pairs at the threshold share a band."""
    rng = np.random.default_rng(0)
    signer, misses, errors = minhash.Signer(), 0, []
    for _ in range(300):
        items = rng.integers(0, 1 << 63, 400, "u8")
        a, b = items[:360], items[40:]  # 320 shared of 400
        m = np.stack([signer.minima(a), signer.minima(b)])
        keys, bits = signer.bands(m), signer.packed(m)
        misses += not (keys[0] == keys[1]).any()
        errors.append(minhash.estimates(bits[0], bits[1]) - 0.8)
    assert misses == 0 and abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04
    assert np.min(errors) > -minhash.MARGIN


def test_empty_table_and_long_text(documents):
    assert minhash.near_duplicates(documents([])).collect() == []
    long = " ".join(f"w{i % 20_011}" for i in range(60_000))
    got = minhash.near_duplicates(documents([(2, long), (1, long + " end"), (3, "other")])).collect()
    assert sorted(map(tuple, got)) == [(1, 20_012, 1, True), (2, 20_011, 1, False), (3, 1, 3, True)]


def test_registered_query(spark, tmp_path, documents, prose):
    from quarry.llm import queries

    rows = planted(prose, random.Random(8))
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op12_minhash"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
