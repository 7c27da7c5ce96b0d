import hashlib
import random
import zlib

import numpy as np
import pytest

from quarry.llm import periodic


def brute_runs(words):
    """Every period tried by itself: maximal stretches of equal words one period apart."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if length >= max(12, 2 * q):
                found.setdefault((start, length), q)  # smallest period first
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_sequences(letters):
    rng = random.Random(letters)
    for n in (0, 1, 11, 12, 13, 25, 60, 200):
        words = [rng.randrange(letters) for _ in range(n)]
        if n > 30 and letters > 2:
            words[10:10 + 3 * (n // 5)] = words[10:10 + n // 5] * 3
        assert sorted(periodic.runs_of(np.array(words, "int64")), key=lambda r: (r[0], r[2])) == brute_runs(words)


def test_stretches_lose_nothing():
    rng = random.Random(9)
    for _ in range(40):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = [rng.randrange(rng.choice([2, 6, 50])) for _ in range(rng.randint(0, 120))]
            if len(words) > 20:
                part = words[5:5 + rng.randint(1, 15)]
                words[20:20] = part * rng.randint(2, 14)
            texts.append(words)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        flat = np.array([w for t in texts for w in t], "int64")
        starts, stops = periodic.stretches(flat, bounds)
        for t, lo in zip(texts, bounds):
            for s, n, _ in brute_runs(t):
                assert any(a <= lo + s and lo + s + n <= b for a, b in zip(starts, stops))


def test_scan_equals_brute_force(documents, prose):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate([None, "", " \t\n", "a", "a " * 11, "a " * 12, "a b " * 6, "x " + "a b c " * 5 + "y",
                                          "日本 語 " * 9, "a b " * 12])]
    rows += [(100 + i, prose(rng.randint(0, 150))) for i in range(60)]
    rows += [(200 + i, " ".join([prose(20), " ".join([prose(rng.randint(1, 9))] * rng.randint(2, 6)), prose(15)])) for i in range(30)]
    rows += [(101, "a " * 30), (101, "a " * 30), (None, "b c " * 20), (None, None)]
    got = periodic.summary(periodic.scan(documents(rows), periodic.planted)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted((expected(i, t) for i, t in rows), key=key)


def test_long_text_and_empty_table(documents):
    words = [f"w{i % 997}" for i in range(50_000)]
    [row] = periodic.scan(documents([(1, " ".join(words))])).collect()
    assert [tuple(r) for r in row["runs"]] == [(0, 50_000, 997)] and len(row["collapsed"].split()) == 997
    [row] = periodic.scan(documents([(1, "a " * 50_000)])).collect()
    assert [tuple(r) for r in row["runs"]] == [(0, 50_000, 1)] and row["collapsed"] == "a"
    assert periodic.summary(periodic.scan(documents([]))).collect() == []


def test_registered_query(spark, tmp_path, documents, prose):
    from quarry.llm import queries

    rows = [(i, prose(i % 40 * 5)) for i in range(80)] + [(90, "a b c d " * 8)]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.queries()["op11_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(expected(i, t) for i, t in rows)
