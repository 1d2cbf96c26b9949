import itertools
import zlib

import numpy as np
import pytest

from corvid.llm import toxicity
from corvid.llm.q_filters import op6_toxicity

# sf0.01 has 38 toxic training documents over four languages, too few to learn from.
D = "/root/testdata/sf0.1"


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    a, start = np.array([[0.9, 0.1], [0.4, 0.6]]), 0.2
    sizes = [1, 5, 3, 7]
    e = rng.normal(0, 2, sum(sizes))
    first = np.zeros(len(e), bool)
    first[np.cumsum([0] + sizes[:-1])] = True
    want, at = [], 0
    for n in sizes:
        mass = np.zeros((n, 2))
        for ys in itertools.product((0, 1), repeat=n):
            p = (start if ys[0] else 1.0) * np.prod([a[i, j] for i, j in zip(ys, ys[1:])]) * np.exp(sum(e[at + k] for k in range(n) if ys[k]))
            for k in range(n):
                mass[k, ys[k]] += p
        want += list(mass[:, 1] / mass[:, 0])
        at += n
    assert np.allclose(toxicity.chain(e, first, a, start), want)


def tiny(seed=3):
    """A likelihood over six short sequences, and the same one by enumeration of all labellings."""
    rng = np.random.default_rng(seed)
    features = [[0, 1], [0, 2], [0, 1, 3], [0, 4]]
    type_of, feature_of = np.repeat(np.arange(4), [len(f) for f in features]), np.array([f for fs in features for f in fs])
    seqs = [(rng.integers(0, 4, n), rng.integers(0, 2, n)) for n in (1, 4, 6, 2, 5, 3)]
    tokens, label = (np.concatenate([s[k] for s in seqs]) for k in (0, 1))
    first = np.concatenate([[True] + [False] * (len(t) - 1) for t, _ in seqs])

    def listed(theta):
        a, start, total = theta[-5:-1].reshape(2, 2), theta[-1], 0.0
        for types, given in seqs:
            e = [sum(theta[f] for f in features[t]) for t in types]
            def log_mass(ys):
                return (start if ys[0] else 0) + sum(a[i, j] for i, j in zip(ys, ys[1:])) + sum(x for x, y in zip(e, ys) if y)
            total += np.logaddexp.reduce([log_mass(ys) for ys in itertools.product((0, 1), repeat=len(types))]) - log_mass(given.tolist())
        return total + 0.5 * theta @ theta

    return toxicity.Likelihood(type_of, feature_of, 5, tokens, label, first, prior=1.0), listed


@pytest.mark.parametrize("slab", [1, 5, 1000])
def test_likelihood_and_gradient_against_enumeration(monkeypatch, slab):
    monkeypatch.setattr(toxicity, "SLAB", slab)
    likelihood, listed = tiny()
    theta = np.random.default_rng(1).normal(0, 1, 10)
    value, slope = likelihood(theta)
    step = 1e-5 * np.eye(10)
    assert np.isclose(value, listed(theta))
    assert np.allclose(slope, [(listed(theta + d) - listed(theta - d)) / 2e-5 for d in step], atol=1e-6)


def test_fit_against_plain_descent():
    likelihood, listed = tiny()
    got = toxicity.minimise(likelihood, np.zeros(10), gain=1e-14)
    # The enumerated likelihood has curvature of at least the prior's, so short plain steps reach its only minimum.
    plain = np.zeros(10)
    for _ in range(400):
        plain -= 0.05 * np.array([(listed(plain + d) - listed(plain - d)) / 2e-5 for d in 1e-5 * np.eye(10)])
    assert np.allclose(got, plain, atol=1e-4) and abs(got[-5:]).max() > 0.05
    assert np.isclose(listed(got), listed(plain))


def test_transitions_are_learnt():
    # Labels come in long stretches whatever the words are: only transitions can tell.
    rng = np.random.default_rng(0)
    label = np.repeat(rng.integers(0, 2, 200), 20)
    first = np.zeros(len(label), bool)
    first[::400] = True
    likelihood = toxicity.Likelihood(np.zeros(1, int), np.zeros(1, int), 1, np.zeros(len(label), int), label, first)
    stay = toxicity.minimise(likelihood, np.zeros(6))[-5:-1]
    assert stay[0] + stay[3] - stay[1] - stay[2] > 4


def test_held_out_accuracy_and_no_leak(spark):
    rows = op6_toxicity(spark, D).collect()
    docs = spark.read.parquet(f"{D}/documents.parquet")
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in docs.select("doc_id").collect())
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(label[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in label]
    right = sum(y == p for y, p in held) / len(held)
    caught = sum(p for y, p in held if y) / sum(y for y, _ in held)
    assert right > 0.97 and caught > 0.9, (right, caught)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "what an idiot", 1), (3, " \n", 1), (4, "fine word " * 50_000 + "idiot", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    empty = toxicity.train(docs, labels)
    assert {r["predicted"] for r in toxicity.score_documents(docs, empty).collect()} == {0}
    words = [f"plain{k % 50} word{k % 7}" for k in range(200)]
    many = spark.createDataFrame([(k, w + (" idiot" if k % 5 == 0 else "")) for k, w in enumerate(words)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "doc_id long, toxic int")
    got = sorted(toxicity.score_documents(docs, toxicity.train(many, marks)).collect(), key=lambda r: (r["doc_id"] or 0))
    assert [r["predicted"] for r in got] == [0, 0, 0, 1, 0, 1] and got[3]["spans"] == "8:13"
    assert toxicity.score_documents(docs.limit(0), empty).collect() == []


def test_repeated_ids_bring_one_text_each(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample, n_clean, n_toxic: seen.extend(sample))
    docs = spark.createDataFrame([(k % 4, f"text {k:03}") for k in range(200)] + [(None, "x")], "doc_id long, text string")
    toxicity.train(docs, spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, toxic int"))
    ids = [k for k in range(4) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert ids and seen == [(f"text {k:03}", k % 2) for k in ids]


def test_ties_and_no_evidence():
    # Equal texts with either label: no feature is tied to a class, so the prior is all that is left.
    model = toxicity.fit([("same words here", 1), ("same words here", 0)] * 5, 5, 5)
    assert model.score(["same words here", ""], {})[0].tolist() == [0.5, 0.5]
