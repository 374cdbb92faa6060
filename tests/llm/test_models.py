"""Operators 2, 4, 5, 6 and the pipeline: held-out accuracy, recall, brute force."""

import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from llm.llm_edges import EDGES
from tessera.llm import decontamination, jaccard_join, language_id, quality_classifier
from tessera.llm.components import components

VOCABULARY = {"en": "the of and with from this there been have which".split(), "de": "der die und nicht mit für über wäre schön auch".split(), "fr": "le la et avec été très où être ça même".split()}


def sample(n=240, seed=0):
    r = random.Random(seed)
    return [(i, " ".join(r.choices(VOCABULARY[lang], k=r.randint(8, 40))), lang) for i in range(n) for lang in [list(VOCABULARY)[i % 3]]]


def test_language(docs):
    rows = sample() + [(1000 + i, t, None) for i, (_, t) in enumerate(EDGES)]
    got = {x.doc_id: x for x in language_id.identified(docs(rows)).collect()}
    held = [x for x in (got[k] for k, _, _ in rows[:240]) if x.held_out]
    assert len(held) > 20 and np.mean([x.lang_pred == rows[x.doc_id][2] for x in held]) > 0.95
    assert all(0 <= x.score <= 1 for x in got.values())
    assert [got[1000 + i].lang_pred for i in (0, 1, 2)] == ["und"] * 3
    assert language_id.identified(docs([])).count() == 0
    assert {x.lang_pred for x in language_id.identified(docs([(1, "words"), (2, None)])).collect()} == {"und"}


def test_every_language_is_learned(docs):
    rows = [(i, f"zq{i % 250:03d}x zq{i % 250:03d}y zq{i % 250:03d}x", f"l{i % 250:03d}") for i in range(3000)]
    got = language_id.identified(docs(rows)).collect()
    assert np.mean([x.lang_pred == rows[x.doc_id][2] for x in got if x.held_out]) > 0.9
    a, *others = [k for k in range(1, 40) if zlib.crc32(str(k).encode()) % 5][:11]
    hot = [(a, "der die und", "de")] * 3000 + [(k, "the of and", "en") for k in others] + [(None, "the of and", "en")]
    assert {x.lang_pred for x in language_id.identified(docs(hot)).collect()} == {"de", "en"}  # a repeated row does not fill the sample of others


def test_ftrl_is_its_definition():
    r = np.random.default_rng(2)
    rows = [(np.sort(r.choice(12, 4, replace=False)), r.random(4), int(r.integers(3))) for _ in range(40)]
    z, n = np.zeros((13, 3)), np.zeros((13, 3))
    alpha, beta, l1, l2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2
    weight = lambda i, c: 0.0 if abs(z[i, c]) <= l1 else -(z[i, c] - np.sign(z[i, c]) * l1) / ((beta + n[i, c] ** 0.5) / alpha + l2)
    for _ in range(language_id.PASSES):
        for at, x, label in rows:
            items = [*zip(at, x, strict=True), (12, 1.0)]  # the last is the offset
            w = {(i, c): weight(i, c) for i, _ in items for c in range(3)}
            scores = np.array([sum(v * w[i, c] for i, v in items) for c in range(3)])
            p = np.exp(scores) / np.exp(scores).sum()
            for i, v in items:
                for c in range(3):
                    g = v * (p[c] - (c == label))
                    z[i, c] += g - ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / alpha * w[i, c]
                    n[i, c] += g * g
    weights, offsets = language_id.fit_ftrl(rows, 3)
    assert np.allclose(weights[:12], [[weight(i, c) for c in range(3)] for i in range(12)]) and np.allclose(offsets, [weight(12, c) for c in range(3)])


def test_ties_go_to_the_first_language():
    model = language_id.Model(["a", "b"], np.ones(language_id.FEATURES), np.zeros((language_id.FEATURES, 2)), np.zeros(2), 1.0)
    assert model.predict("word") == ("a", 0.5)


def test_temperature_is_finite():
    logits = np.eye(3)[np.arange(60) % 3] * 5
    assert 0.05 < language_id.fit_temperature(logits, np.arange(60) % 3) < 20


def test_quality(spark, docs):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        kind = i % 3
        w = r.choices(VOCABULARY["en"], k=40)
        if kind == 0:
            w = [x + "###" for x in w]
        if kind == 1:
            w[3] = w[20] = "idiot"
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind > 0), int(kind == 1)))
    lab = spark.createDataFrame([*labels[:240], (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality_classifier.classified(docs(rows), lab).collect()}
    late = [got[i] for i in range(240, 300)]
    assert np.mean([x.selected == (x.doc_id % 3 == 2) for x in late]) > 0.95
    means = [np.mean([x.expected_grade for x in late if x.doc_id % 3 == k]) for k in range(3)]
    assert means == sorted(means)
    edge = quality_classifier.classified(docs(EDGES), lab).collect()
    assert len(edge) == len(EDGES) and not next(x for x in edge if x.doc_id == 2).selected
    assert quality_classifier.classified(docs([]), lab).count() == 0


def test_thresholds_are_ordered():
    r = np.random.default_rng(0)
    rows = [(np.array([g, 5]), np.array([1.0, 1.0]), int(g)) for g in r.integers(0, 4, 200)]
    model = quality_classifier.fit(rows, 4)
    assert (np.diff(model.thresholds) >= 0).all()


def test_cumulative_link_fit_descends_its_loss():
    """The fit against one of the same steps with gradients by differences."""
    r = np.random.default_rng(5)
    rows = [(np.sort(r.choice(6, 3, replace=False)), r.random(3), int(r.integers(3))) for _ in range(25)]

    def loss(w, cuts, at, x, grade):
        below = np.append(1 / (1 + np.exp(-(cuts - x @ w[at]))), 1.0)
        return -np.log(below[grade] - (below[grade - 1] if grade else 0.0))

    w, seen, cuts, seen_cuts = np.zeros(6), np.full(6, 1e-2), np.array([-1.0, 1.0]), np.ones(2)
    order, h = np.random.default_rng(7), 1e-6
    for _ in range(quality_classifier.PASSES):
        for i in order.permutation(len(rows)):
            at, x, grade = rows[i]
            slope = lambda f: (f(h) - f(-h)) / (2 * h)
            g = np.array([slope(lambda d, j=j: loss(w + d * np.eye(6)[j], cuts, at, x, grade)) for j in at]) + quality_classifier.L2 * w[at]
            g_cuts = np.array([slope(lambda d, j=j: loss(w, cuts + d * np.eye(2)[j], at, x, grade)) for j in range(2)])
            seen[at] += g * g
            w[at] -= quality_classifier.STEP * g / np.sqrt(seen[at])
            seen_cuts += g_cuts * g_cuts
            cuts = np.maximum.accumulate(cuts - 0.3 * g_cuts / np.sqrt(seen_cuts) + 1e-6 * np.arange(2))
    model = quality_classifier.fit(rows, 3)
    assert np.allclose(model.weights[:6], w, atol=1e-4) and np.allclose(model.thresholds, cuts, atol=1e-4)
    assert np.allclose(model.tails(None), 1 / (1 + np.exp(cuts)), atol=1e-4)


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_decontamination(spark, docs):
    r = random.Random(6)
    items = [" ".join(words(r, r.randint(15, 59))) + ". " + " ".join(words(r, 5)) + "." for _ in range(40)]
    rows, leaked = [], set()
    for i in range(300):
        w = words(r, r.randint(20, 300))
        if i % 3 == 0:
            item = i % 40
            held = items[item].split()
            if i % 2:
                held = [x if k % 8 else "other" for k, x in enumerate(held)]
            at = r.randint(0, len(w))
            w[at:at] = held
            leaked.add((i, item))
        rows.append((i, " ".join(w)))
    bench = spark.createDataFrame([*enumerate(items), (None, "x"), (99, None), (98, "...")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(docs(rows + EDGES[:3]), bench).collect()}
    assert got <= leaked and len(got) >= 0.9 * len(leaked)
    assert {x.doc_id for x in decontamination.clean(docs(rows), bench).collect()} == set(range(300)) - {d for d, _ in got}
    assert decontamination.contaminated(docs(rows), bench.limit(0)).count() == 0
    assert decontamination.contaminated(docs([]), bench).count() == 0


def test_idf_does_not_change_as_the_corpus_grows():
    share = np.array([0.0, 0.001, 0.05, 0.9])
    first, *others = (decontamination.idf_of(share * n, n) for n in (10_000, 400_000, 10**9))
    assert all(np.allclose(first, x) for x in others)


def brute_contaminated(rows, items):
    """Pairs by subsequences alone: every 16th place of every text with every item."""
    found = set()
    for k, text in rows:
        own = decontamination.words(text or "")
        for i, item in enumerate(items):
            whole, answer = (decontamination.words(t).tolist() for t in (item, decontamination.answer_of(item)))
            side = max(32, len(whole))
            for at in range(0, len(own), 16):
                around = own[max(0, at - side) : at + 32 + side].tolist()
                if len(set(around) & set(whole)) * 4 < len(set(whole)):
                    continue
                if decontamination.common_subsequence(whole, around) >= 0.7 * len(whole) and decontamination.common_subsequence(answer, around) >= 0.5 * len(answer):
                    found.add((k, i))
                    break
    return found


@pytest.mark.parametrize("bounds", [(256, 8), (5, 2)])
def test_items_of_any_length_verbatim_and_reworded(spark, docs, monkeypatch, bounds):
    monkeypatch.setattr(decontamination, "GROUP_PARTS", bounds[0])  # the second bounds take several spaces and searches
    monkeypatch.setattr(decontamination, "PASS_GROUPS", bounds[1])
    r = random.Random(9)
    common = words(r, 40)
    prose = lambda n: [r.choice(common) if r.random() < 0.4 else w for w in words(r, n)]
    items = [" ".join(prose(n)) + "." for n in (16, 30, 60, 182, 183, 400, 1000, 2000)]
    other = {w: "syn" + w for t in items for w in t.rstrip(".").split()}
    rows = []
    for i in range(24):  # verbatim, then a fifth of the words in other words, then words left out
        held = items[i % 8].rstrip(".").split()
        held = held if i < 8 else [other[w] if r.random() < 0.2 else w for w in held] if i < 16 else [w for w in held if r.random() > 0.15]
        rows.append((i, " ".join(prose(r.randint(0, 90)) + held + prose(70))))
    rows += [(24 + i, " ".join(prose(300))) for i in range(40)] + [(90, None), (91, ""), (3, rows[3][1])]
    bench = spark.createDataFrame([*enumerate(items), (0, items[0])], "item_id long, text string")
    got = [(x.doc_id, x.item_id) for x in decontamination.contaminated(docs(rows), bench).collect()]
    want = brute_contaminated(rows, items)
    assert len(want) >= 20 and len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.9 * len(want)


def test_the_space_is_latent(spark, docs):
    r = random.Random(12)
    pairs = list(zip(words(r, 60), words(r, 60), strict=True))  # two words for one thing, which stand together in the corpus
    texts = [" ".join(w for p in r.sample(pairs, 12) for w in p) for _ in range(400)]
    items = [" ".join(p[0] for p in r.sample(pairs, 20)) for _ in range(120)]
    groups = [[decontamination.words(t) for t in items]]
    idf, sample = decontamination.corpus_of(docs(list(enumerate(texts))), "doc_id", "text")
    axes = decontamination.latent_spaces(sample, groups, idf)[0]
    assert axes.shape[1] == decontamination.RANK < len(items) and np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-3)
    space = decontamination.Space.of(0, axes, idf, groups[0])
    plain, latent = [], []
    for t in items:  # the same item in nothing but the other words
        own = decontamination.words(" ".join(dict(pairs)[w] for w in t.split()))
        at, x = decontamination.unit(own, idf)
        at2, y = decontamination.unit(decontamination.words(t), idf)
        plain.append(float(np.bincount(at, x, decontamination.FEATURES) @ np.bincount(at2, y, decontamination.FEATURES)))
        z = space.adds[decontamination.features_of(own)].sum(0)
        latent.append(float(z @ space.parts[items.index(t)] / np.linalg.norm(z)))
    assert np.mean(plain) < 0.05 and np.mean(latent) > 0.2


def test_the_space_is_fitted_on_every_passage(docs, monkeypatch):
    monkeypatch.setattr(decontamination, "CHUNK", 7)
    r = random.Random(13)
    pairs, filler = list(zip(words(r, 60), words(r, 60), strict=True)), words(r, 4)
    together = lambda: [w for p in r.sample(pairs, 8) for w in p * 4]
    texts = [" ".join(w for k in range(16) for w in (together() if k % 4 else r.choices(filler, k=64))) for _ in range(60)]  # where a quarter starts nothing of it stands
    texts += [None, "", "one", " ".join(r.choices(filler, k=70))]
    items = [" ".join(p[0] for p in r.sample(pairs, 20)) for _ in range(120)]
    idf, corpus = decontamination.corpus_of(docs([*enumerate(texts), (None, texts[0])]), "doc_id", "text")
    space = decontamination.Space.of(0, decontamination.latent_spaces(corpus, [[decontamination.words(t) for t in items]], idf)[0], idf, [decontamination.words(t) for t in items])
    latent = []
    for i, t in enumerate(items):
        z = space.adds[decontamination.features_of(decontamination.words(" ".join(dict(pairs)[w] for w in t.split())))].sum(0)
        latent.append(float(z @ space.parts[i] / max(1e-9, np.linalg.norm(z))))
    assert np.mean(latent) > 0.2
    rows = []
    for own in [decontamination.words(t) for t in [*filter(None, texts), texts[0]]]:
        for k in range(0, len(own), 64):
            at, x = decontamination.unit(own[k : k + 64], idf)
            rows.append(np.bincount(at, x, decontamination.FEATURES))
    rows, found = np.array(rows), decontamination.corpus_directions(corpus, idf)
    held = np.flatnonzero(rows.any(0))
    assert not np.delete(found, held, 0).any()
    values = np.linalg.eigvalsh(rows[:, held].T @ rows[:, held] / len(rows))[::-1]
    assert np.allclose(np.linalg.eigvalsh(found.T @ found)[::-1][:8], values[:8], rtol=0.1)
    assert np.isclose(float((found**2).sum()), values[: found.shape[1]].sum(), rtol=0.1)


def test_passages_take_little_memory():
    r = np.random.default_rng(14)
    sizes = [0, 1, 63, 64, 65, *r.integers(0, 1500, 2500).tolist(), 30_000]
    texts = [r.integers(0, decontamination.FEATURES, n).astype(np.uint16) for n in sizes]
    held = pa.array([b"", *(t.tobytes() for t in texts)], pa.binary()).slice(1)
    tracemalloc.start()
    seen, got = tracemalloc.get_traced_memory()[0], 0
    for own in decontamination.passages_of(held):
        got += len(own)
        assert own.shape[1] == 64 and len(own) <= decontamination.CHUNK
    most = tracemalloc.get_traced_memory()[1] - seen
    tracemalloc.stop()
    assert got == sum(-(-n // 64) for n in sizes) and most < 16e6
    found = np.concatenate(list(decontamination.passages_of(held)))
    want = [np.sort(t[k : k + 64].astype(int)).tolist() for t in texts for k in range(0, len(t), 64)]
    assert [x[x < decontamination.FEATURES].tolist() for x in found] == want


def test_a_basis_takes_little_memory_on_the_driver(docs):
    r = np.random.default_rng(21)
    for n in (200, 30):  # independent columns, and fewer of them
        made = np.zeros((decontamination.FEATURES, decontamination.DIRECTIONS), np.float32)
        made[:] = r.standard_normal((decontamination.FEATURES, min(n, decontamination.DIRECTIONS))).astype(np.float32) @ r.standard_normal((min(n, decontamination.DIRECTIONS), decontamination.DIRECTIONS))
        before = made.copy()
        decontamination.make_orthonormal(made)
        assert np.allclose(made.T @ made, np.eye(made.shape[1]), atol=1e-4)
        assert np.allclose(made @ (made.T @ before), before, atol=1e-3)
    idf, corpus = decontamination.corpus_of(docs(list(enumerate(["one two three", "two three four", "five"] * 40))), "doc_id", "text")
    tracemalloc.start()
    decontamination.corpus_directions(corpus, idf)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 * decontamination.FEATURES * decontamination.DIRECTIONS * 4  # four such matrices


def test_sums_are_of_few_tasks_however_many_partitions(spark, docs, monkeypatch):
    rows = docs([(i, f"some words and number {i}") for i in range(300)])
    held = lambda: decontamination.corpus_of(rows.repartition(60), "doc_id", "text")[1]
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))  # a task for each file
    try:
        assert held().rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and held().count() == 300
        monkeypatch.setattr(decontamination, "TASK_WORDS", 100)
        assert spark.sparkContext.defaultParallelism < held().rdd.getNumPartitions() <= 15
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_spaces_are_made_one_by_one():
    r = np.random.default_rng(22)
    idf, directions = np.ones(decontamination.FEATURES), r.standard_normal((decontamination.FEATURES, 8)).astype(np.float32) / 100
    groups = [[r.integers(0, 1 << 63, 40, dtype=np.uint64) for _ in range(80)] for _ in range(6)]
    tracemalloc.start()
    n = sum(1 for _ in decontamination.each_space(groups, idf, directions))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 6 and most < 4 * decontamination.FEATURES * decontamination.RANK * 4


@pytest.mark.parametrize("learn", ["language", "quality"])
def test_rows_to_fit_are_held_flat(spark, docs, monkeypatch, learn):
    r = random.Random(23)
    rows = [(i, "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=3000)), "en" if i % 2 else "de") for i in range(150)]
    held = []
    if learn == "language":
        monkeypatch.setattr(language_id, "fit_ftrl", lambda rows, n: held.append(rows) or (np.zeros((language_id.FEATURES, n)), np.zeros(n)))
        language_id.learn(docs(rows))
    else:
        monkeypatch.setattr(quality_classifier, "fit", lambda rows, n: held.append(rows))
        ratings = spark.createDataFrame([(i, i % 3) for i in range(150)], "doc_id long, grade int")
        quality_classifier.learn(docs(rows), ratings)
    (found,) = held
    assert len(found) > 80 and all(len(at) == len(x) > 1000 for at, x, _ in found)
    for k in (0, 1):  # all rows are views of one buffer
        assert len({id(row[k].base if row[k].base is not None else row[k]) for row in found}) == 1


def test_stretches_with_enough_words_are_counted_together(monkeypatch):
    r = np.random.default_rng(15)
    for hits in (1, 50, 1 << 18):
        monkeypatch.setattr(decontamination, "HITS", hits)
        text, item = r.integers(0, 60, 900).astype(np.uint64), r.integers(0, 40, 30).astype(np.uint64)
        known = decontamination.Vocabulary.of([item, np.arange(30, 50, dtype=np.uint64)])
        row = np.sort(r.integers(0, 9, 200))
        low, high = (row * 100 + np.sort(r.integers(0, 101, (200, 2)), axis=1).T)
        times = np.zeros(len(known.hashes) + 1, np.int32)
        times[known.items[0][0]] = known.items[0][1]
        for least in (1, 9.5, 18, 21, 30):
            got = decontamination.enough(known.places(text), row, low, high, times, least)
            stretches = [text[a:b].tolist() for a, b in zip(low, high)]
            assert got.tolist() == [sum(x in item for x in s) >= least and sum(x in s for x in item.tolist()) >= least for s in stretches]


def test_common_subsequence():
    def brute(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 70))] for _ in range(2))
        assert decontamination.common_subsequence(a, b) == brute(a, b)


def brute_components(rows):
    sets = []
    for k, t in rows:
        w = (t or "").lower().split()
        sets.append((k, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    root = {k: k for k, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {k: (len(s), find(k)) for k, s in sets}


def test_jaccard_join(docs):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = r.choices(vocabulary, k=60)
    texts = []
    for size in (30, 100, 170):
        base = r.choices(vocabulary, k=size)
        for _ in range(45):
            w = list(base)
            for _ in range(r.randint(0, size // 25 + 1)):
                w[r.randrange(size)] = r.choice(vocabulary)
            texts.append(w)
    for _ in range(60):
        w = r.choices(vocabulary, k=r.randint(5, 160))
        texts.append(w + passage)
    texts += [passage + r.choices(vocabulary, k=r.randint(0, 6)) for _ in range(25)] + [["a"], [], ["A"], ["b", "c"]]
    r.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(900, None), (901, "   ")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.clustered(docs(rows).repartition(3)).collect()}
    assert got == brute_components(rows)
    assert jaccard_join.clustered(docs([])).count() == 0
    edge = jaccard_join.clustered(docs(EDGES)).collect()
    assert len(edge) == len(EDGES) and next(x for x in edge if x.doc_id is None).component_id is None


def test_jaccard_join_links_a_text_with_its_part(docs):
    r = random.Random(8)
    rows = []
    for part, size in [(81, 100), (80, 100), (90, 110), (86, 100), (405, 500)] * 12:  # shingles; words are new in each pair
        whole = [f"p{len(rows)}x{i}" for i in range(size + 4)]
        at = r.randint(0, size - part)
        rows += [(len(rows), " ".join(whole[at : at + part + 4])), (len(rows) + 1, " ".join(whole))]
    got = {x.doc_id: x.component_id for x in jaccard_join.clustered(docs(rows).repartition(3)).collect()}
    assert got == {k: k - k % 2 for k, _ in rows}


def templated(r, n, own, size=200):
    """Texts that share all but `own` of their words with a template."""
    template = [f"t{i}" for i in range(size)]
    rows = []
    for i in range(n):
        w = list(template)
        k = own(r)
        at = r.randint(0, size - k)
        w[at : at + k] = [f"o{i}x{j}" for j in range(k)]
        rows.append((i, " ".join(w)))
    return rows


def test_jaccard_join_of_a_template(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MOST_OPEN", 4)
    r = random.Random(10)
    rows = templated(r, 120, lambda r: r.randint(8, 30)) + [(200 + i, " ".join(f"u{i}y{j}" for j in range(40))) for i in range(400)]
    got = {x.doc_id: x.component_id for x in jaccard_join.clustered(docs(rows)).collect()}
    assert got == {k: root for k, (_, root) in brute_components(rows).items()}


@pytest.mark.parametrize("n", [500, 2000])
def test_a_template_makes_few_pairs(spark, n):
    rows = [(i, jaccard_join.shingles(t).tobytes()) for i, t in templated(random.Random(11), n, lambda r: r.randint(30, 40))]
    tokens = spark.createDataFrame(rows, "node long, tokens binary")
    nodes = spark.createDataFrame([(i, len(t) // 8, i) for i, t in rows], "node long, n int, root long")
    assert jaccard_join.exact_candidates(nodes, tokens).count() <= n


def test_prefix_entries_meet_for_every_link():
    r = np.random.default_rng(3)
    universe = np.sort(r.integers(0, 1 << 63, 6000, dtype=np.uint64))
    frequent = np.sort(r.choice(universe, 4000, replace=False))
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = np.sort(r.choice(universe, n, replace=False))
        drop = r.permutation(n)[: int(0.11 * n)]
        b = np.unique(np.concatenate([np.delete(a, drop), r.choice(universe, len(drop))]))
        if jaccard_join.linked(a, b):
            x, need, _ = jaccard_join.entries(a, frequent)
            y, other, _ = jaccard_join.entries(b, frequent)
            assert len(np.intersect1d(x, y)) >= max(1, min(need, other))


def test_index_entries_are_handed_over_in_parts(spark, docs):
    """No part that goes to Spark grows with the batch of documents; what it says of each class stays."""
    rows = [(i, " ".join(f"w{i * 131 + k}" for k in range(400))) for i in range(1500)]
    sizes = []

    def seen(make, schema):
        batches = list(make(iter(pa.table({"text": [t for _, t in rows]}).to_batches())))
        sizes.extend(map(len, batches))
        return pa.Table.from_batches(batches)

    class Source:
        sparkSession = spark

        where = select = lambda self, *_: self
        mapInArrow = staticmethod(seen)

    found = jaccard_join.index_of(Source(), np.empty(0, np.uint64), "doc_id", "text").to_pylist()
    assert max(sizes) <= jaccard_join.ROWS
    want = {}
    for _, t in rows:
        own = jaccard_join.shingles(t)
        want[jaccard_join.signature(own)] = jaccard_join.entries(own, np.empty(0, np.uint64))
    got = {(r["s1"], r["s2"]): [] for r in found}
    for r in found:
        got[r["s1"], r["s2"]].append(r)
    assert got.keys() == want.keys()
    for sig, (some, least, n_rare) in want.items():
        *rest, last = got[sig]
        assert [r["entry"] for r in rest] == some.view(np.int64).tolist()
        assert [r["rare"] for r in rest] == [k < n_rare for k in range(len(some))]
        assert all(r["need"] is None and r["n_rare"] is None and r["end"] is None for r in rest)
        assert (last["need"], last["n_rare"], last["end"], last["rare"], last["known"]) == (least, n_rare, jaccard_join.rare_end(some, n_rare), False, 0)
    by_entry = {}
    for r in found:
        if r["need"] is None:
            by_entry.setdefault(r["entry"], []).append(r["known"])
    assert all(sorted(k) == ([0] if len(k) == 1 else [1, *[2] * (len(k) - 1)]) for k in by_entry.values())


def test_texts_in_rows_are_sent_once(docs):
    from tessera.llm.common import packed, with_text

    source, texts = with_text(packed(docs([(1, "a"), (2, None)])), "row", "row.TEXT")
    assert source.columns == ["row"]
    kept = source.mapInArrow(lambda batches: (b for b in batches if texts(b).to_pylist()), source.schema).select("row.*").collect()
    assert sorted((r.doc_id, r.text, r.key) for r in kept) == [(1, "a", "clash"), (2, None, "clash")]


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(r.randint(50, 90), r.randint(50, 90)) for _ in range(30)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def staged(spark):
    found, docs = [], spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, DATA).cache()
        found.append((docs, rows))
        docs = rows
    return found


def test_pipeline(spark, staged):
    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    assert all(after.columns == columns for _, after in staged[:4])
    before, after = staged[2]
    rows = [(x.doc_id, x.text) for x in before.collect()]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    roots = brute_components([(k, (t or "").translate(lower)) for k, t in rows])
    assert {x.doc_id for x in after.collect()} == {k for k, (_, root) in roots.items() if k == root}
    before, after = staged[3]
    items = [x.text for x in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    held = {x.doc_id for x in before.collect() if any(i in (x.text or "") for i in items)}
    assert not held & {x.doc_id for x in after.collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1 AND toxic = 0")
    first = staged[0][0].join(labels, "doc_id")
    kept = staged[1][1].join(labels, "doc_id")
    assert kept.count() >= 0.97 * first.count()
    assert staged[4][1].count() == staged[3][1].count() and "ids_sha256" in staged[4][1].columns
    assert staged[1][1].where(F.col("text").isNull()).count() == 0


def test_pipeline_edges(spark):
    """Columns that share names with those the stages work with, nulls, repeated rows, a very long text, no rows."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    names = ["score", "selected", "lang_pred", "row", "_text", "key", "n_tokens", "component_id", "token", "a.b"]
    wide = docs.select("*", *[F.lit("clash").alias(n) for n in names])
    odd = wide.limit(1).withColumn("text", F.lit(None).cast("string")).unionByName(wide.limit(1).withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType)))
    long = wide.limit(1).withColumn("doc_id", F.lit(10**6).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.repeat(F.lit("the plain words of a very long text stand here. "), 20_000))
    rows = wide.unionByName(wide.limit(5)).unionByName(odd).unionByName(long)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, rows, DATA)
        assert stage(spark, wide.limit(0), DATA).count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == wide.columns
            rows = spark.createDataFrame(after.collect(), after.schema)
    assert 0 < after.count() <= 128


def test_run_leaves_only_what_its_result_reads(spark):
    from tessera.llm import common

    start = common.mark()
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.count() > 0 and common.mark() == start + 1
    assert rows.select("doc_id").distinct().count() == rows.count()
