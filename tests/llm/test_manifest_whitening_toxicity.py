"""Merkle manifest, embedding whitening and toxicity against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tersely.llm import merkle, toxicity, whitening

# Merkle manifest

ROWS = "doc_id long, source string, lang string, n_chars long, text string, node string, at int, path string, `group` int"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        nodes = out[-1]
        out.append([digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)])
    return out


def brute_path(levels, at):
    path = []
    for nodes in levels[:-1]:
        path += [nodes[at ^ 1]] if at ^ 1 < len(nodes) else []
        at //= 2
    return path


def brute_manifest(rows):
    """(id, leaf, subroot, root, proof) of every row."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, brute_leaf(row), row[0]))
    names = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {name: brute_levels([leaf for _, _, leaf, _ in sorted(groups[name], key=lambda r: r[:3])]) for name in names}
    top = brute_levels([trees[name][-1][0] for name in names])
    for place, name in enumerate(names):
        for at, (_, _, leaf, doc) in enumerate(sorted(groups[name], key=lambda r: r[:3])):
            proof = brute_path(trees[name], at) + brute_path(top, place)
            yield doc, leaf, trees[name][-1][0], top[-1][0], digest("".join(proof))


def shown(found):
    return sorted(
        (
            (
                r.id, r.leaf.hex(), r.subroot.hex(), r.root.hex(),
                digest("".join(p.hex() for p in r.proof)),
            )
            for r in found
        ),
        key=str,
    )


@pytest.mark.parametrize("rows", [1, 2, 3, 700])
def test_manifest_equals_brute_force(spark, rows):
    """Groups of one row, of several stored levels, of null name; repeated and null rows."""
    pick = random.Random(rows)
    made = [(n, "s", "en", 10 * n, f"text {n}") for n in range(rows)]
    if rows > 1:
        made += [(5, None, None, None, None), (None, "s", None, 1, ""), (None, "s", "en", 1, "é\U0001f600"), made[0], made[0]]
        made += [(n, "s", lang, n, "x" * n) for n in range(9) for lang in ("de", "", "zz")] + [(1, "s", "l1", 2, "one")]
        made.append((3, "s", "en", 1, "long " * 100_000))
    pick.shuffle(made)
    docs = spark.createDataFrame([(*row, "n", 1, "p", 2) for row in made], ROWS)
    found = merkle.proofs(merkle.manifest(docs)).collect()
    assert shown(found) == sorted(brute_manifest(made), key=str)
    assert all(r.folded_root == r.root for r in found)


def test_manifest_tells_what_was_changed(spark):
    made = [(n, "s", "en" if n % 3 else None, n, f"t{n}") for n in range(40)]
    docs = spark.createDataFrame([(*row, "n", 1, "p", 2) for row in made], ROWS)
    changed = F.when(F.col("doc_id") % 5 == 0, merkle.leaf([F.col("doc_id"), F.lit("x")]))
    found = merkle.proofs(merkle.manifest(docs, changed=changed)).collect()
    assert {r.id for r in found if r.folded_root != r.root} == {n for n in range(40) if n % 5 == 0}
    assert shown(found) == sorted(brute_manifest(made), key=str)
    assert merkle.proofs(merkle.manifest(docs.limit(0))).count() == 0


def test_subtrees_of_any_size():
    """Levels cut at stored ones, whatever the number of nodes; the fold undoes the siblings."""
    for n in (1, 2, 3, 255, 256, 257, 511, 513):
        leaves = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
        stored = [merkle.levels(leaves[i : i + merkle.SPAN], n)[-1][0] for i in range(0, n, merkle.SPAN)]
        above = merkle.levels(stored, len(stored))
        assert above[-1] == [bytes.fromhex(brute_levels([x.hex() for x in leaves])[-1][0])]
        for at in {0, n // 2, n - 1}:
            low = merkle.levels(leaves[at // merkle.SPAN * merkle.SPAN :][: merkle.SPAN], n)
            proof = merkle.siblings(low, at % merkle.SPAN) + merkle.siblings(above, at // merkle.SPAN)
            assert merkle.folded(leaves[at], at, n, iter(proof)) == above[-1][0]


# whitening

VECTORS = "vec_id long, embedding array<double>, x int, at long, whitened string"


def test_whitening_equals_numpy(spark):
    pick = np.random.default_rng(7)
    mixing = pick.normal(size=(20, 20))
    rows = [(n, [float(v) for v in pick.normal(size=20) @ mixing]) for n in range(300)]
    rows += [(n, rows[4][1]) for n in range(400, 550)] + [(7, rows[6][1]), (None, rows[8][1])]
    bad = [(600, None), (601, [None] * 20), (602, [float("nan")] * 20), (603, [math.inf] * 20)]
    rows += [(610, rows[3][1][:11]), (611, [])]
    df = spark.createDataFrame([(i, v, 1, 2, "w") for i, v in rows + bad], VECTORS).repartition(5)
    found = whitening.whitened(df, components=6).collect()
    x = np.array([[math.floor(64 * c) for c in v] + [0] * (20 - len(v)) for _, v in rows], float) + 1_000_000
    fit = np.unique(x, axis=0)
    centre = fit.mean(axis=0)
    values, axes = np.linalg.eigh((fit - centre).T @ (fit - centre) / len(fit))
    values, axes = values[::-1], axes[:, ::-1]
    expected = (x - centre) @ axes[:, :6] / np.sqrt(values[:6])
    assert len(found) == 6 * len(rows) and {r.n for r in found} == {len(fit)}
    assert max(r.identity_error for r in found) < 1e-9
    sums = [int(s) for s in fit.sum(axis=0)]
    exact = {i: sum((len(fit) * int(c) - s) ** 2 for c, s in zip(v, sums)) for (i, _), v in zip(rows, x)}
    for c in range(6):
        own = sorted((str(r.vec_id), round(r.whitened, 6)) for r in found if r.component == c + 1)
        same = sorted((str(i), round(v, 6)) for (i, _), v in zip(rows, expected[:, c]))
        other = sorted((str(i), round(-v, 6) + 0.0) for (i, _), v in zip(rows, expected[:, c]))
        near = lambda p, q: all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 for a, b in zip(p, q))
        assert near(own, same) or near(own, other)
        shares = {r.explained for r in found if r.component == c + 1}
        assert len(shares) == 1 and abs(shares.pop() - values[c] / values.sum()) < 1e-9
    assert {r.vec_id: int(r.deviation) for r in found} == exact


def test_whitening_of_a_large_common_offset(spark):
    """Centred before multiplying: the offset of all entries costs no digits."""
    pick = np.random.default_rng(2)
    df = spark.createDataFrame([(n, [float(c) for c in pick.integers(0, 3, 4)]) for n in range(200)], "vec_id long, embedding array<double>")
    near, far = (whitening.whitened(df, components=4, offset=o).orderBy("vec_id", "component").collect() for o in (0, 2**40))
    assert all(abs(abs(a.whitened) - abs(b.whitened)) < 1e-9 for a, b in zip(near, far))
    assert max(r.identity_error for r in far) < 1e-9


def test_whitening_without_variance_and_of_huge_entries(spark):
    schema = "vec_id long, embedding array<double>"
    same = spark.createDataFrame([(n, [1.0, 2.0]) for n in range(5)], schema)
    assert whitening.whitened(same).count() == 0
    assert whitening.whitened(same.limit(0)).count() == 0
    flat = spark.createDataFrame([(n, [float(n), 2.0, float(n)]) for n in range(9)], schema)
    assert {r.component for r in whitening.whitened(flat).collect()} == {1}
    with pytest.raises(Exception, match="row 3"):
        whitening.whitened(spark.createDataFrame([(3, [1e19]), (4, [1.0])], schema)).count()


# toxicity

RUDE = ("idiot", "scum", "trash")


def made_documents(n, seed=1):
    """Documents of random words, every fifth with a rude word in it, and their labels."""
    pick = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    docs, labels = [], []
    for doc in range(n):
        text = [pick.choice(words) for _ in range(pick.randrange(5, 60))]
        if doc % 5 == 0:
            text.insert(pick.randrange(len(text)), pick.choice(RUDE).upper() + ",")
        docs.append((doc, " ".join(text), pick.choice(["en", None]), "src", 0.5))
        labels.append((doc, 1, int(doc % 5 == 0)))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, lang string, toxic string, score double", "doc_id long, quality int, toxic int"


def fold(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0


def judged(spark, docs, labels):
    docs = spark.createDataFrame(docs, DOCS).repartition(3)
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    return toxicity.toxicity(docs, model).collect()


def test_toxicity_on_the_held_out_fold(spark):
    docs, labels = made_documents(900)
    odd = [(None, "you idiot", "en", "t", 0.0), (2000, None, "en", "t", 0.0), (2001, "", "en", "t", 0.0), (2002, "42 ...", "en", "t", 0.0),
           (2003, "dal " * 200_000 + "scum", "en", "t", 0.0), docs[3], docs[3]]
    found = judged(spark, docs + odd, labels + [(None, 1, 1), (1, 1, None), (2, 0, 7)])
    assert len(found) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == fold(r.doc_id) for r in found)
    marks = {doc: toxic for doc, _, toxic in labels}
    unseen = [r for r in found if r.held_out and r.doc_id in marks]
    assert sum(r.predicted == marks[r.doc_id] for r in unseen) >= 0.97 * len(unseen)
    scores = {r.doc_id: r.score for r in found}
    assert scores[None] > 0.5 and scores[2003] > 0.5
    assert scores[2000] == scores[2001] == scores[2002] < 0.5


def test_held_out_labels_and_other_columns_are_not_learnt(spark):
    docs, labels = made_documents(400)
    base = {r.doc_id: r.score for r in judged(spark, docs, labels)}
    lies = [(doc, 1, 1 - toxic if fold(doc) else toxic) for doc, _, toxic in labels]
    others = [(doc, text, "xx", str(doc % 5 == 0), 1.0) for doc, text, *_ in docs]
    assert {r.doc_id: r.score for r in judged(spark, others, lies)} == base


def test_toxicity_without_labels(spark):
    docs, labels = made_documents(30)
    assert {r.score for r in judged(spark, docs, [])} == {0.0}
    assert {r.predicted for r in judged(spark, docs, [(doc, 1, 0) for doc, *_ in docs])} == {0}
    assert judged(spark, [], labels) == []


def test_ftrl_step_is_the_published_one():
    """Per coordinate: w from z and n in closed form, then sigma, z and n."""
    pick = np.random.default_rng(5)
    size = toxicity.DIMENSIONS + 1
    z, n = np.zeros(size), np.zeros(size)
    own = {}
    for _ in range(200):
        places = np.unique(pick.integers(0, 12, 5))
        label = int(pick.random() < 0.5)
        weights = []
        for i in places:
            zi, ni = own.get(i, (0.0, 0.0))
            if abs(zi) <= toxicity.L1:
                weights.append(0.0)
            else:
                rate = (toxicity.BETA + math.sqrt(ni)) / toxicity.ALPHA + toxicity.L2
                weights.append(-(zi - math.copysign(toxicity.L1, zi)) / rate)
        g = 1 / (1 + math.exp(-sum(weights))) - label
        for i, w in zip(places, weights):
            zi, ni = own.get(i, (0.0, 0.0))
            sigma = (math.sqrt(ni + g * g) - math.sqrt(ni)) / toxicity.ALPHA
            own[i] = (zi + g - sigma * w, ni + g * g)
        toxicity.learn(z, n, places, label)
    assert all(abs(z[i] - a) < 1e-9 and abs(n[i] - b) < 1e-9 for i, (a, b) in own.items())


def test_features_are_words_pairs_and_pairs_with_a_gap():
    rows, places = toxicity.features(["a b c", "", "A, b! C", "a c", "b a"])
    found = [set(places[rows == k].tolist()) for k in range(5)]
    assert found[0] == found[2] and len(found[0]) == 3 + 2 + 1 + 1
    assert found[1] == {toxicity.BIAS}
    assert len(found[0] & found[3]) == 3  # both words and the bias, not the pair with a gap
    assert len(found[4] & found[0]) == 3
