"""The context-mixing model is fitted to all training documents: class words, classes, code, mixer."""
import collections

import numpy as np
from pyspark.sql import functions as F

from beaconry.llm import common, mixing_model


def texts_of(n):
    rng = np.random.default_rng(3)
    return [" ".join(f"w{int(i)}" for i in rng.zipf(1.3, 30) % 400) for _ in range(n)]


def test_words_and_classes_come_from_all_documents(spark, monkeypatch):
    """More documents than any sample had: one class has the shares of all of them, each count at most 20."""
    monkeypatch.setattr(mixing_model, "CLASSES", 1)
    texts = texts_of(3000)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    count = collections.Counter(w.encode() for t in texts for w in t.split())
    want = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: mixing_model.CLASS_WORDS]]
    for told in (1, 4, 16):
        monkeypatch.setattr(mixing_model, "TOLD", told)
        assert mixing_model.class_words(df) == want
    got = mixing_model.fitted_classes(df)
    capped = collections.Counter()
    for t in texts:
        for w, n in collections.Counter(t.encode().split()).items():
            capped[w] += min(n, 20)
    mass = np.array([capped[w] for w in want]) + 0.1
    assert np.abs(got.logs[:, 0] - mixing_model.LOG_UNIT * np.log(mass / mass.sum())).max() <= 0.51


def test_running_classes_agree():
    """All texts of a call at once get the classes that one text after the other gets, ties included."""
    rng = np.random.default_rng(1)
    words = [f"w{i}".encode() for i in range(300)]
    sizes = [0, 1, 7, 8, 9, 15, 16, 17, 31, 32, 33, 100, 511, 512, 513, 1024, 1025, 1536, 3000, 0]
    docs = [[words[j] for j in rng.integers(0, 300, n)] for n in sizes] + [[b"w200"] * 50, [b"w200"] * 10 + [b"w5"] * 40]
    for logs in (np.log(rng.random((100, 8)) + 0.01), np.zeros((100, 3))):
        classes = mixing_model.Classes(words[:100], logs)
        kinds, ends = classes.of_words(*common.word_hashes([b" ".join(d) for d in docs]))
        want = [[(kind, len(part)) for kind, part in classes.stretches(d)] for d in docs]
        assert kinds.tolist() == [k for d in want for k, n in d for _ in range(n)]
        assert ends.tolist() == [d[-1][0] for d in want]


def test_mixer_and_code_come_from_all_pairs(spark, monkeypatch):
    """Every pair is learned from, in one task or several; the map's sums hold all but the first eighth of the steps."""
    rows = [(k, f"w{i * i}".encode(), 1 + (7 * i + k) % 5) for k in (0, 1) for i in range(1300)] + [(1, b"", 3)]
    pairs = spark.createDataFrame(rows, "class int, word binary, n long")
    symbols = mixing_model.symbol_counts(pairs)
    assert symbols[ord("w")] == sum(n for _, w, n in rows if w) == symbols[mixing_model.END_OF_WORD] and symbols[mixing_model.END_OF_TEXT] == 3
    code = mixing_model.Code(symbols)
    tables = mixing_model.trained_tables(pairs, code)
    kinds, words, n = (list(c) for c in zip(*rows))

    def alone(some):
        model = mixing_model.Model(code, tables)
        k, w, c = zip(*some)
        return model, model.learn(np.array(k), list(w), np.array(c))

    model, sums = alone(rows)
    model.refine_by(sums)
    one = mixing_model.learned(pairs, code, tables)
    assert np.allclose(one.weights, model.weights, atol=1e-6) and np.allclose(one.refined, model.refined)
    monkeypatch.setattr(mixing_model, "LEARNED_A_TASK", 700)
    dealt = pairs.repartition(4, "class", "word").withColumn("p", F.spark_partition_id()).collect()
    shares = [[(r["class"], bytes(r.word), r.n) for r in dealt if r.p == p] for p in range(4)]
    assert sum(map(len, shares)) == len(rows)
    want = sum(alone(s)[0].weights * (len(s) / len(rows)) for s in shares if s)
    assert np.allclose(mixing_model.learned(pairs, code, tables).weights, want, atol=1e-5)


def test_lookup():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 62, 5000).astype(np.uint64))
    found = common.Lookup(keys[::2].copy()).rows(keys)
    assert (found[::2] == np.arange(len(found[::2]))).all() and (found[1::2] == -1).all()
    assert common.Lookup(keys[:0]).rows(keys[:3]).tolist() == [-1] * 3
