import itertools
import random
import re

import numpy as np
import xxhash

from quarry.llm import line_dedup, simhash


def fingerprint(text, k=4):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(fps, distance=4):
    """Component root per fingerprint, by comparing all."""
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(u):
        for b in u[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {x: find(x) for x in u}


def test_components_equal_brute_force(documents, prose, odd):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        words = prose(rng.choice([3, 5, 80, 300])).split()
        rows.append((4 * i, " ".join(words)))
        for j in range(1, rng.choice([1, 1, 3, 4])):
            if len(words) > 60:
                words[rng.randrange(len(words))] = "changed"
            rows.append((4 * i + j, " ".join(words)))
    rows += [(1000 + r.doc_id if r.doc_id is not None else None, r.text) for r in odd.collect()]
    got = simhash.near_duplicates(documents(rows)).select("doc_id", simhash.hex_digits("fp").alias("h"), "component_id").collect()
    want = [(i, fingerprint(t)) for i, t in rows]
    assert sorted((r.doc_id or -1, r.h) for r in got) == sorted((i or -1, f"{f:016x}") for i, f in want)
    root = groups([f for _, f in want])
    least = {}
    for i, f in want:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    names = {(r.doc_id, r.h): r.component_id for r in got}
    assert all(names[i, f"{f:016x}"] == least.get(root[f]) for i, f in want)
    assert len(set(least.values())) < len(root)  # some fingerprints link
    assert simhash.near_duplicates(documents([])).count() == 0


def test_long_lists_in_blocks(spark):
    """One chain of close fingerprints that shares most bytes, with blocks far smaller than its lists."""
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (400, 14))
    fps = np.unique((bits << np.arange(14)).sum(axis=1) + (0x1234 << 40))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    edges = simhash.links(df, block=16)
    linked = {r.node: r.root for r in simhash.components(edges).collect()}
    root = groups([int(f) for f in fps])
    mine = {}
    for f in map(int, fps):
        mine.setdefault(linked.get(f, f), set()).add(f)
    theirs = {}
    for f, r in root.items():
        theirs.setdefault(r, set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_lists_are_never_broadcast(spark):
    """Few fingerprints stand in 56 lists each, which the estimate of an explode does not count."""
    fps = spark.range(1000).selectExpr("xxhash64(id) AS fp")
    plan = simhash.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_a_path(spark):
    n = 60
    order = list(range(n))
    random.Random(4).shuffle(order)
    path = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(path).collect()}
    assert got == {**{i: 0 for i in range(1, n)}, 201: 200}
    assert simhash.components(path.limit(0)).count() == 0


def test_one_row_stays(documents, prose):
    a, b = prose(200), prose(200)
    docs = documents([(7, a), (3, a), (9, b), (9, b), (None, a), (None, None), (None, "")])
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == [(3, a), (9, b)]
    assert len([r for r in kept.collect() if r.doc_id is None]) == 1


def test_every_component_keeps_a_row_of_its_own(documents, prose):
    a, b, c, d = (prose(200) for _ in range(4))
    docs = documents([(7, a), (None, a), (None, b), (None, b), (None, c), (None, None), (4, c), (4, d), (4, d), (9, d)])
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(7, a), (-1, b), (4, c), (-1, ""), (4, d)])


def lines(text):
    return [p for p in re.split(r"(?<=\n)|(?<=[.!?,] )", text)]


def brute_lines(rows):
    """Later windows removed, documents in the order of their ids."""
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        ls = lines(t)
        key = [re.sub(r"\n\Z|(?<=[.!?,]) \Z", "", p) for p in ls]
        gone = set()
        for p in range(len(ls) - 2):
            w = tuple(key[p:p + 3])
            if w[0] and w[2]:
                if w in seen:
                    gone |= {p, p + 1, p + 2}
                seen.add(w)
        for start in [p for p in gone if p - 1 not in gone]:
            run = list(itertools.takewhile(gone.__contains__, itertools.count(start)))
            if sum(len(ls[p]) for p in run) < line_dedup.MIN_CHARS:
                gone -= set(run)
        out[i] = ("".join(x for p, x in enumerate(ls) if p not in gone), len(gone))
    return out


def test_line_dedup_equals_brute_force(documents, prose):
    rng = random.Random(9)
    passages = [prose(60) for _ in range(4)]
    rows = []
    for i in range(80):
        parts = [prose(rng.randint(1, 60)) for _ in range(rng.randint(0, 4))]
        parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((i, rng.choice(["\n", "\n\n", " "]).join(parts)))
    rows += [(100, rows[3][1]), (101, "x\x01y. " + passages[0]), (102, (passages[1] + " ") * 3), (103, None), (104, ""), (105, "Short. And. Sweet."),
             (106, "Short. And. Sweet."), (107, "\n\n\n"), (108, rows[3][1] + "\n")]
    docs = documents(rows)
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup(docs).collect()}
    want = brute_lines(rows)
    assert {i: v for i, v in got.items() if i != 103} == want and got[103] == (None, 0)
    assert sum(v[1] > 0 for v in want.values()) > 50 and got[105][1] == got[106][1] == 0 and got[100][0] == ""
    assert line_dedup.dedup(docs).columns[:len(docs.columns)] == docs.columns
    assert line_dedup.dedup(documents([])).count() == 0


def test_repeated_rows_and_ids(documents, prose):
    t, u = prose(80), prose(80)
    got = sorted((r.doc_id or -1, r.text) for r in line_dedup.dedup(documents([(1, t), (1, t), (1, u), (None, t), (2, u + " " + t)])).collect())
    assert (-1, t) in got and got.count((1, "")) == 2 and (1, u) in got and got[-1][0] == 2 and t not in got[-1][1]


def same_hash(spark, prose):
    """Two texts of equal 32-bit hash: one a passage of other rows, one unique."""
    from pyspark.sql import functions as F

    passage = prose(70)
    n = spark.range(400_000).select(F.col("id"), F.hash(F.concat(F.lit(passage + " End "), "id")).alias("h"))
    unique = " ".join(f"Unique sentence {i} of this text here." for i in range(4))
    m = spark.range(400_000).select(F.col("id").alias("other"), F.hash(F.concat(F.lit(unique + " End "), "id")).alias("h"))
    pair = n.join(m, "h").first()
    return passage, f"{passage} End {pair.id}", f"{unique} End {pair.other}"


def test_texts_of_one_hash_are_told_apart(spark, documents, prose):
    passage, repeats, unique = same_hash(spark, prose)
    rows = [(None, repeats), (None, unique), (None, passage), (4, passage)]
    got = {r.text for r in line_dedup.dedup(documents(rows)).collect() if r.doc_id is None}
    assert unique in got


def test_short_lines_are_a_passage(documents):
    """Lists and verse: no single window is long, the repeated run is."""
    verse = "\n".join(["Red is here", "Blue is it", "Green, too", "And grey", "So we sing", "Once more", "And again", "Until noon", "All of us", "Here now"])
    rows = [(i, f"Start {i} of it.\n{verse}\nEnd {i} of it.") for i in range(5)] + [(9, "a, b, c, d"), (10, "a, b, c, d")]
    got = {r.doc_id: r for r in line_dedup.dedup(documents(rows)).collect()}
    assert {i: (r.text, r.removed_lines) for i, r in got.items()} == brute_lines(rows)
    assert all(verse not in got[i].text and got[i].removed_lines > 9 for i in range(1, 5)) and verse in got[0].text
    assert got[10].text == "a, b, c, d"


def test_hot_window_in_parts(documents, prose):
    """One passage in every document, joined in parts of a few rows."""
    passage = prose(60)
    rows = [(i, f"Own words {i} stand here. {passage} And more {i}.") for i in range(120)]
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup(documents(rows), part=7).collect()}
    assert got == brute_lines(rows)


def test_very_long_text(documents):
    long = " ".join(f"Sentence number {i} stands here." for i in range(20_000))
    rows = [(1, long), (2, "New start. " + long + " New end."), (3, None)]
    got = {r.doc_id: (r.text, r.removed_lines) for r in line_dedup.dedup(documents(rows)).collect()}
    assert got[1] == (long, 0) and got[2][0] in ("New start. New end.", "New start.  New end.") and got[3] == (None, 0)


def test_the_tally_drops_pairs_below_the_minimum(spark):
    """Fingerprints that share three bytes meet in a list but are dropped by their tally."""
    three, four = 0x0000_0000_0011_2233, 0x0000_0000_4411_2233
    far = three | 0xFFFF_FFFF_FF00_0000
    a, b = simhash._links_of(np.zeros(2, "i8"), np.array([three, far], "u8"), 4)
    assert len(a) == 0
    near = four ^ 0x0101_0101_0000_0000  # four bytes differ by a bit each
    a, b = simhash._links_of(np.zeros(2, "i8"), np.array([four, near], "u8"), 4)
    assert (a.tolist(), b.tolist()) == ([four], [near])
    # A bit of every byte but three: within the distance of no four bytes.
    lists = simhash._lists(spark.createDataFrame([(5,)], "fp long"), 3)
    assert lists.count() == 56
