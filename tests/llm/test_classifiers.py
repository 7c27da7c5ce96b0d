import zlib

import numpy as np
import pytest

from quarry.llm import licences, quality, toxicity
from quarry.llm._labels import training_rows


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture()
def labelled(spark, documents, prose):
    """Toxic documents hold a slur, poor ones are full of signs."""
    rows, labels = [], []
    for i in range(240):
        t = prose(40 + i % 60)
        if i % 4 == 0:
            w = t.split()
            w[len(w) // 2:len(w) // 2] = ["grubblefink"]
            t = " ".join(w)
        if i % 3 == 0:
            t = t.replace(" ", " %%% ")
        rows.append((i, t))
        labels.append((i, int(i % 3 != 0), int(i % 4 == 0)))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label, right", [(toxicity, "toxic", lambda i: i % 4 == 0), (quality, "quality", lambda i: i % 3 != 0)])
def test_held_out_rows_are_told_apart(spark, labelled, module, label, right):
    docs, labels = labelled
    got = module.classify(docs, labels.select("doc_id", label)).collect()
    assert len(got) == 240 and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.predicted == right(r.doc_id) for r in out]) >= 0.95


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_labels_of_held_out_rows_are_not_learnt(spark, labelled, module, label):
    from pyspark.sql import functions as F
    docs, labels = labelled
    turned = labels.withColumn(label, F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col(label)).otherwise(F.col(label)))
    score = lambda t: {r.doc_id: r.score for r in module.classify(docs, t.select("doc_id", label)).collect()}
    assert score(labels) == score(turned)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, odd, module, label):
    one_class = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 1), (4, None)], f"doc_id long, {label} int")
    both = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1), (4, 0), (5, 1), (6, 0), (7, 1), (50, 1), (51, 0), (3, 0)], f"doc_id long, {label} int")
    for labels in (one_class, both, both.limit(0)):
        got = module.classify(odd, labels).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert len({r.score for r in got if r.doc_id in (0, 1)}) == 1  # null and empty alike
    assert module.classify(odd.limit(0), both).count() == 0


def test_toxic_rows_go(labelled):
    docs, labels = labelled
    kept = toxicity.clean(docs, labels.select("doc_id", "toxic"))
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert len(left - {i for i in range(240) if i % 4}) <= 2 and len({i for i in range(240) if i % 4} - left) <= 2


def test_long_texts_have_the_same_buckets(monkeypatch):
    text = "the quick brown fox " * 400
    whole = set(toxicity.NGrams().buckets(text).tolist())
    monkeypatch.setattr(toxicity, "STRETCH", 100)
    assert set(toxicity.NGrams().buckets(text).tolist()) == whole


def test_ratio_by_hand():
    groups = [np.array([0, 1]), np.array([1, 2])]
    ratio = toxicity.log_count_ratio(groups, np.array([1, 0]), np.ones(2), 3)
    assert ratio == pytest.approx([np.log(2), 0, -np.log(2)])


def test_contexts_by_hand():
    c = quality.Contexts()
    texts = [np.array([5, 6, 5, 7], "u2"), np.array([6], "u2")]
    c.add(texts)
    place, sign = quality.index_vectors()
    want = np.zeros((quality.BUCKETS + 1, quality.DIM))
    for t in texts:
        for i in range(len(t)):
            for j in range(len(t)):
                if i != j and abs(i - j) <= quality.WINDOW:
                    np.add.at(want[t[i]], place[t[j]], sign[t[j]])
    assert np.array_equal(c.sums.reshape(want.shape)[:quality.BUCKETS], want[:quality.BUCKETS])
    assert c.counts[5] == 2 and c.counts[6] == 2


def test_licences(spark, documents, prose):
    rows = [(i, prose(60) + "\n" + prose(30)) for i in range(60)]
    said = {100: ("mit", "Released under the MIT License."), 101: ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
            102: ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
            103: ("cc-by-nc", "Licensed under CC BY-NC 4.0."), 104: ("proprietary", "All rights reserved.")}
    rows += [(i, prose(20) + "\n\n" + t + "\n" + prose(10)) for i, (_, t) in said.items()]
    rows += [(200, "Released under the Zebra License."), (201, None), (202, ""), (203, "\n \n"), (100, rows[60][1]), (None, "Licensed under CC BY-NC 4.0.")]
    got = licences.scan(documents(rows), none_rows=100).collect()
    found = {r.doc_id: r for r in got}
    for i, (family, text) in said.items():
        assert (found[i].family, found[i].paragraph, found[i].confirmed, found[i].text) == (family, 2, True, text)
    assert found[None].family == "cc-by-nc" and len([r for r in got if r.doc_id == 100]) == 1
    assert set(found) <= {*said, 200, None}
    assert 200 not in found or not found[200].confirmed or found[200].family == "unknown"
    assert licences.scan(documents([])).count() == 0


def test_families_not_trained_are_unknown_or_unconfirmed(documents, prose, monkeypatch):
    """Real notices of families left out of training are never confirmed as another family."""
    left_out = ("zlib", "boost", "epl", "unlicense", "isc")
    monkeypatch.setattr(licences, "TEMPLATES", [t for t in licences.TEMPLATES if t[0] not in left_out])
    notices = ["Distributed under the Boost Software License, Version 1.0.", "Released under the ISC License.",
               "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
               "This is free and unencumbered software released into the public domain."]
    rows = [(i, prose(50) + "\n" + prose(30)) for i in range(60)] + [(100 + i, prose(20) + "\n" + t) for i, t in enumerate(notices)]
    rows += [(200, prose(10) + "\nReleased under the MIT License.")]
    got = {r.doc_id: r for r in licences.scan(documents(rows), none_rows=100).collect()}
    assert (got[200].family, got[200].confirmed) == ("mit", True) and set(got) <= {200, *range(100, 104)}
    assert all(r.family == "unknown" or not r.confirmed for i, r in got.items() if i != 200)


def test_templates_kept_aside():
    aside = licences.kept_aside()
    families = [licences.TEMPLATES[i][0] for i in aside]
    assert len(set(families)) == len(families) and all(
        any(f == g for j, (g, _) in enumerate(licences.TEMPLATES) if j not in aside) for f in families)


def test_very_long_licence_text(documents, prose):
    lines = [prose(12) for _ in range(3000)]
    lines[1500] = "Licensed under the Apache License, Version 2.0."
    rows = [(1, "\n".join(lines)), (2, " ".join(lines[:1000]))] + [(i, prose(40)) for i in range(10, 50)]
    got = [(r.doc_id, r.family, r.paragraph) for r in licences.scan(documents(rows), none_rows=100).collect() if r.confirmed]
    assert got == [(1, "apache-2.0", 1500)]


def test_licences_of_rows_without_an_own_id(documents, prose):
    said = "Released under the MIT License."
    rows = [(i, prose(60)) for i in range(60)]
    rows += [(None, said), (None, prose(30)), (None, "All rights reserved."), (7, said), (7, prose(30))]
    got = [r for r in licences.scan(documents(rows), none_rows=100).collect() if r.doc_id in (None, 7)]
    assert sorted((r.doc_id or -1, r.family, r.paragraph, r.text) for r in got) == [
        (-1, "mit", 0, said), (-1, "proprietary", 0, "All rights reserved."), (7, "mit", 0, said)]


def test_labelled_sample_is_bounded_in_rows(spark, documents, prose):
    rows = [(i, prose(20)) for i in range(40)] + [(3, prose(10))] * 200 + [(5, prose(10)) for _ in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, y int")
    docs = documents(rows).select("doc_id", "text").repartition(7)
    got = training_rows(docs, labels, "y", {1: 30, 0: 10}).collect()
    assert {r.doc_id for r in got if r.y == 1} == set(range(1, 40, 2))  # no id is pushed out
    assert len([r for r in got if r.y == 1]) == 30 and len([r for r in got if r.y == 0]) == 10
    assert len({(r.doc_id, r.text) for r in got}) == len(got)
    weights = {}
    for r in got:
        weights[r.doc_id] = weights.get(r.doc_id, 0) + r.weight
    assert all(weights[i] == pytest.approx(1) for i in range(1, 40, 2)) and sum(w for i, w in weights.items() if i % 2 == 0) == pytest.approx(20)
    again = training_rows(docs.repartition(3), labels, "y", {1: 30, 0: 10}).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_buckets_and_scores_equal_brute_force():
    """N-grams counted one by one; the fitted weights are a minimum; scores by the formula."""
    from collections import Counter

    grams = toxicity.NGrams(bits=12)

    def brute(text):
        codes, counts, mask = [ord(c) for c in text.lower()], Counter(), (1 << 64) - 1
        for n in grams.sizes:
            for i in range(len(codes) - n + 1):
                total = sum(c * int(f) for c, f in zip(codes[i:i + n], grams.factors)) & mask
                counts[(((total ^ total >> 29) * int(grams.spread)) & mask) >> 64 - grams.bits] += 1
        often = {((b + 1) * (int(grams.spread) + 2 * level) & mask) >> 64 - grams.bits
                 for level in grams.levels for b, n in counts.items() if n >= level}
        return sorted(set(counts) | often)

    texts = ["", "ab", "abc", "banana banana banana", "Ünïcode 🙂 text", "aaaaaaaaaaaa", "the scum of it", "stupid scum, scum"]
    assert [grams.buckets(t).tolist() for t in texts] == [brute(t) for t in texts]
    y, w = np.array([0, 0, 0, 0, 0, 0, 1, 1]), np.array([1.0, 2, 1, 1, 1, 1, 1, 3])
    groups = [grams.buckets(t) for t in texts]
    v, b = toxicity.fit(groups, y, w, 1 << 12, rounds=400, penalty=1e-2)
    ratio = toxicity.log_count_ratio(groups, y, w, 1 << 12)

    def loss(beta, shift):
        total = 0.5e-2 * float(beta @ beta)
        for g, label, weight in zip(groups, y, w):
            if len(g):
                z = float((beta * ratio)[g].sum()) / len(g) ** 0.5 + shift
                total += weight / w.sum() * float(np.logaddexp(0, z) - label * z)
        return total

    beta, rng = np.where(ratio != 0, v / np.where(ratio != 0, ratio, 1), 0), np.random.default_rng(1)
    least = loss(beta, b)
    for _ in range(30):
        assert loss(beta + 1e-2 * rng.normal(size=beta.size) * (v != 0), b + 1e-2 * rng.normal()) > least
    p = toxicity.probabilities(texts, (v.astype("f4"), b), grams)
    want = [1 / (1 + np.exp(-(b + (sum(float(np.float32(v[i])) for i in brute(t)) / len(brute(t)) ** 0.5 if brute(t) else 0)))) for t in texts]
    assert np.allclose(p, want)


def test_network_and_temperature_by_hand():
    """Forward pass and pooling in loops; the temperature is the best of its grid on the rows kept aside."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, quality.DIM)), np.zeros(200)
    y[(x[:, 0] + 0.5 * x[:, 1] + 0.8 * rng.normal(size=200)) > 0] = 1
    weight = rng.uniform(0.5, 2, 200)
    net = quality.fit(x, y, weight)
    for row, p in zip(x[:5], net.probabilities(x[:5])):
        hidden = [max(0.0, sum((row[i] - net.centre[i]) / net.scale[i] * net.w1[i, j] for i in range(quality.DIM)) + net.b1[j])
                  for j in range(quality.HIDDEN)]
        z = (sum(h * w for h, w in zip(hidden, net.w2)) + net.b2) / net.temperature
        assert p == pytest.approx(1 / (1 + np.exp(-z)))
    aside = np.arange(200) % 5 == 4

    def loss(temperature):
        z = net.logits(x[aside]) / temperature
        return float(weight[aside] @ (np.logaddexp(0, z) - y[aside] * z))

    assert all(loss(net.temperature) <= loss(t) + 1e-12 for t in np.exp(np.linspace(np.log(0.25), np.log(8), 61)))
    p = net.probabilities(x[~aside])
    assert np.mean((p >= 0.5) == y[~aside]) > 0.8
    vectors, words = rng.normal(size=(50, quality.DIM)).astype("f4"), rng.integers(0, 50, 70)
    assert np.allclose(quality.pooled(vectors, words), sum(vectors[w].astype("f8") for w in words) / 70)
    assert not quality.pooled(vectors, words[:0]).any()
