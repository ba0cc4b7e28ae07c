"""Filter audit, tensored MinHash and whitening against plain definitions."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from test_corpus import SCHEMA, rows
from tests_llm_truth import jaccard_truth

from activity_timeline.llm import filter_audit, tensored_minhash, whitening
from activity_timeline.llm.ngram_jaccard import shingle_sets

LETTERS = "ABCDE"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def audit_truth(data, labels):
    """data: doc_id, text, lang; labels: doc_id, quality, toxic."""
    first = {}
    for i, t, _ in data:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    judged = []
    for i, t, lang in data:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {c for c, bad in zip(LETTERS, (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)),
            i is not None and first[t] < i)) if bad}
        judged.append((lang or "", i, failed))
    out = []
    for part in {p for p, _, _ in judged}:
        own = [(i, f) for p, i, f in judged if p == part]
        found, shapley = [], Counter()
        for order in permutations(LETTERS):
            left = own
            for step, letter in enumerate(order, 1):
                lost = [i for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shapley[letter] += len(lost)
                failing = [f for _, f in own if letter in f]
                found.append([part, "".join(order), step, len(left), len(lost),
                              len(failing) - len(lost), sum(len(f) == 1 for f in failing),
                              len([i for i in lost if i in good]),
                              len([i for i in lost if i in toxic])])
        out += [tuple([*r, shapley[r[1][r[2] - 1]]]) for r in found]
    return sorted(out)


def test_filter_audit(spark, docs, empty):
    labels = [(6, 1, 0), (7, 0, 1), (10, 1, 1), (10, 0, None), (None, 1, 1), (11, None, 1), (99, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = sorted(tuple(r) for r in filter_audit.audit(docs, table).collect())
    assert found == audit_truth([(i, t, lang) for i, t, lang, *_ in rows()], labels)
    assert filter_audit.audit(empty, table).count() == 0
    assert sorted(tuple(r) for r in filter_audit.audit(docs, table.limit(0)).collect()) == \
        audit_truth([(i, t, lang) for i, t, lang, *_ in rows()], [])


def test_filter_audit_crowded_sketch(spark, docs, monkeypatch):
    """A full sketch lets all unique texts through, and nothing else changes."""
    monkeypatch.setattr(filter_audit, "repeated_cells", lambda docs: np.full(8192, 255, np.uint8))
    table = spark.createDataFrame([(6, 1, 0)], "doc_id long, quality int, toxic int")
    found = sorted(tuple(r) for r in filter_audit.audit(docs, table).collect())
    assert found == audit_truth([(i, t, lang) for i, t, lang, *_ in rows()], [(6, 1, 0)])


def test_sketch_never_clears_a_repeat():
    hashes = np.random.default_rng(3).integers(-2**63, 2**63, 5_000, np.int64)
    at = filter_audit.probes(np.repeat(hashes, 2), 1 << 16)
    assert (np.bincount(at.ravel(), minlength=1 << 16)[at] > 1).all()


def copies(seed, n, words=120, edits=(0, 25)):
    """Families with members nearer and farther than the threshold, and a passage that many share."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(60)]
    made = []
    for i in range(n):
        base = [f"f{i % 6}w{j}" for j in range(words)]
        for at in rng.choice(words, rng.integers(*edits), replace=False):
            base[at] = f"x{i}y{at}"
        made.append((i, " ".join(base)))
    for i in range(n, 2 * n):
        own = [f"o{i}z{j}" for j in range(rng.integers(5, 120))]
        made.append((i, " ".join(passage + own)))
    return made


@pytest.mark.parametrize("few", [tensored_minhash.FEW, 0])
def test_minhash_equals_all_pairs(spark, docs, few, monkeypatch):
    """With few = 0 every key that frames share becomes a frame."""
    monkeypatch.setattr(tensored_minhash, "FEW", few)
    data = copies(5, 90) + [(None, "a b c d e f"), (None, "a b c d e f"), (1000, None), (1001, ""),
                            (1002, "two words"), (1003, "Two Words"), (1003, "Two Words")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"])
                    for r in tensored_minhash.near_duplicates(df).collect()), key=repr)
    assert found == jaccard_truth(data, 4, 80)


def test_minhash_awkward_rows(spark, docs, empty):
    found = tensored_minhash.near_duplicates(docs).collect()
    want = jaccard_truth([(i, t) for i, t, *_ in rows()], 4, 80)
    assert sorted(((r[0], r[1], r[2]) for r in found), key=repr) == want
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"])
               for r in found)
    assert tensored_minhash.near_duplicates(empty).count() == 0


def test_tensored_tables_find_pairs_at_the_threshold():
    """Sets of similarity 0.8 share a table, and those of 0.1 hardly ever do."""
    rng = np.random.default_rng(8)
    near = far = 0
    for _ in range(300):
        x = rng.integers(0, 2**64, 900, np.uint64)
        a, b, c = x[:450], x[50:500], x[410:860]
        first, second, third = tensored_minhash.short_hashes([a, b, c])
        half = tensored_minhash.COLLECTION
        both = [(first == other)[:half].any() and (first == other)[half:].any()
                for other in (second, third)]
        near, far = near + both[0], far + both[1]
    assert near == 300 and far < 30


def test_minhash_resembles_similarity():
    import pyarrow as pa
    a, b = shingle_sets(pa.array(["a b c d e f g", "A B C D E F G"]), 4)
    assert (tensored_minhash.short_hashes([a])[0] == tensored_minhash.short_hashes([b])[0]).all()


def whitening_truth(vectors, k):
    x = np.floor(np.asarray(vectors, float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(axis=1), (x - sums / n) @ axes / np.sqrt(values), values


def whitened(df, k):
    found = df.orderBy("row_id" if "row_id" in df.columns else "vec_id", "component").collect()
    return found, np.array([r["whitened"] for r in found]).reshape(-1, k)


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 24)) @ np.diag(np.linspace(3, 0.5, 24))
    vectors = np.concatenate([base, base[:120], base[:1].repeat(90, axis=0)])
    bad = [None, [1.0] * 23 + [None], [1.0] * 23 + [float("nan")], [float("-inf")] * 24, [], [1.0, 2.0]]
    data = [(i, v.tolist(), 1) for i, v in enumerate(vectors)] + [(900 + i, v, 2) for i, v in enumerate(bad)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, n int").repartition(5)
    n, deviation, want, values = whitening_truth(vectors, 16)
    found, got = whitened(whitening.whiten(df), 16)
    assert len(found) == 16 * len(vectors)
    assert {r["n"] for r in found} == {n} and n == 300
    assert [r["deviation"] for r in found[::16]] == deviation.tolist()
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-7
    full = np.linalg.eigvalsh(np.cov(np.unique(np.floor(vectors * 64), axis=0).T, bias=True)).sum()
    assert np.allclose([r["explained"] for r in found[:16]], values / full, rtol=1e-9)
    assert found[0]["identity_error"] < 1e-8


def test_whitening_of_few_vectors(spark):
    """Fewer components than asked for where the scatter has less rank; none without any."""
    schema = "vec_id long, embedding array<float>"
    rng = np.random.default_rng(4)
    flat = np.repeat(rng.normal(size=(40, 4)), 2, axis=1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(flat)], schema)
    found, got = whitened(whitening.whiten(df), 4)
    assert {r["component"] for r in found} == {1, 2, 3, 4} and found[0]["identity_error"] < 1e-4
    for data in ([], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (None, None)]):
        assert whitening.whiten(spark.createDataFrame(data, schema)).count() == 0
    far = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 3.0]), (3, [1.0, 1.0])], schema)
    found = whitening.whiten(far).collect()
    assert len(found) == 3 and found[0]["deviation"] is None  # the rest is below rounding


def test_jacobi_on_a_graded_factor():
    """Eigenvalues over many orders of magnitude keep their digits."""
    rng = np.random.default_rng(6)
    axes = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    want = 10.0 ** -np.arange(30) * 1e6
    turned = whitening.one_sided_jacobi(axes * np.sqrt(want))
    assert np.allclose((turned ** 2).sum(axis=0), want, rtol=1e-10)
    values, vectors = whitening.eigen((axes * want) @ axes.T)
    assert np.allclose(values[:8], want[:8], rtol=1e-6)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-9


def test_audit_of_the_tables_equals_truth(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    found = sorted(tuple(r) for r in filter_audit.audit(docs, labels).collect())
    want = audit_truth([(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()],
                       [(r["doc_id"], r["quality"], r["toxic"]) for r in labels.collect()])
    assert found == want and defaultdict(int, Counter(r[0] for r in found))["en"] == 600
