import random

import pytest
from pyspark.sql import functions as F

from ordermill.llm import quality, toxicity
from ordermill.llm.labelled import held_out, training_sample
from tests.llm.conftest import ODD

WORDS = "alpha beta gamma delta sun moon river stone cloud field garden window table paper letter music".split()


def corpus(bad):
    pick = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = [pick.choice(WORDS) for _ in range(30)]
        if i % 4 == 0:
            words = bad(words, pick)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 != 0), int(i % 4 == 0)))
    return rows, labels


def insulting(words, pick):
    for _ in range(4):
        words[pick.randrange(30)] = pick.choice(["vilescum", "vileloser", "scumbag"])
    return words


def shouting(words, pick):
    return [f"{w.upper()}!!" for w in words]


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize(
    "module, bad, label, settings",
    [
        (toxicity, insulting, "toxic", toxicity.Settings(rounds=15)),
        (quality, shouting, "quality", quality.Settings(rounds=25)),
    ],
)
def test_held_out_accuracy(documents, labels, module, bad, label, settings):
    rows, marks = corpus(bad)
    table, known = documents(rows), labels(marks)
    model = module.fit(table, known, label, settings)
    scored = table.select("doc_id", module.score(model, F.col("text")).alias("s"), held_out(F.col("doc_id")).alias("h"))
    truth = {m[0]: m[1] if label == "quality" else m[2] for m in marks}
    fold = [(r.s, truth[r.doc_id]) for r in scored.where("h").collect()]
    assert len(fold) > 40
    assert all(0 <= s <= 1 for s, _ in fold)
    assert sum((s >= 0.5) == bool(t) for s, t in fold) / len(fold) > 0.95


@pytest.mark.parametrize("module, least", [(toxicity, 0.0), (quality, 1.0)])
def test_without_labels_all_scores_are_fixed(documents, labels, module, least):
    table = documents(ODD)
    for known in (labels([]), labels([(1, 1, 0), (4, None, None)])):
        model = module.fit(table, known)
        assert {r.s for r in table.select(module.score(model, F.col("text")).alias("s")).collect()} == {least}


@pytest.mark.parametrize("module, bad, label", [(toxicity, insulting, "toxic"), (quality, shouting, "quality")])
def test_odd_and_long_texts(documents, labels, module, bad, label):
    rows, marks = corpus(bad)
    settings = module.Settings(rounds=10)
    model = module.fit(documents(rows), labels(marks + [(9999, None, None), (None, 1, 1), (3, 1, 1), (3, 0, 0)]), label, settings)
    long = " ".join(WORDS * 40_000)
    table = documents([*ODD, (50, long), (51, "x" * 1_500_000), (52, bad(list(WORDS) * 2, random.Random(1)) and long + " vilescum scumbag vileloser")])
    scores = {(r.doc_id, r.text and len(r.text)): r.s for r in table.select("doc_id", "text", module.score(model, F.col("text")).alias("s")).collect()}
    assert len(scores) == len(ODD) + 3 - 1
    assert all(0 <= s <= 1 for s in scores.values())
    assert scores[(1, None)] == scores[(2, "")]


def test_blocks_do_not_change_a_score(documents, labels, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from ordermill.llm import spans

    text = pa.array(["some loser words and more of them " * 20, "short"])
    settings = toxicity.Settings()
    wanted = np.ones(1 << settings.bucket_bits, bool)
    whole = np.sort(np.concatenate(list(toxicity._keys(text, spans.Hasher(), wanted, settings))))
    monkeypatch.setattr(toxicity, "blocks", lambda t, cut, overlap=0: spans.blocks(t, cut, overlap, limit=64))
    assert np.array_equal(whole, np.sort(np.concatenate(list(toxicity._keys(text, spans.Hasher(), wanted, settings)))))
    totals = quality._inputs(text, spans.Hasher(), quality._byte_classes(), quality.Settings())
    monkeypatch.setattr(quality, "blocks", lambda t, cut: spans.blocks(t, cut, limit=64))
    cut = quality._inputs(text, spans.Hasher(), quality._byte_classes(), quality.Settings())
    assert np.array_equal(totals[0][:, :7], cut[0][:, :7])


def test_sum_of_squares_equals_all_pairs(documents):
    import numpy as np

    from ordermill.llm import spans

    settings = quality.Settings(word_bits=6)
    draw = np.random.default_rng(3)
    model = quality.Model(settings, draw.normal(size=settings.size), draw.normal(size=(settings.size, settings.factors)), 0.3)
    text = "a few words of text, a FEW words"
    got = documents([(1, text)]).select(quality.score(model, F.col("text")).alias("s")).first().s
    import pyarrow as pa

    bins, _, bucket, value = quality._inputs(pa.array([text]), spans.Hasher(), quality._byte_classes(), settings)
    x = [(b, value[0]) for b in bucket] + [(b, 1.0) for b in bins[0]]
    total = 0.3 + sum(model.linear[i] * v for i, v in x)
    for j in range(len(x)):
        for k in range(j):
            total += model.factors[x[j][0]] @ model.factors[x[k][0]] * x[j][1] * x[k][1]
    assert got == pytest.approx(1 / (1 + np.exp(-total)))


def test_sample_is_bounded_and_outside_the_fold(documents, labels):
    rows, marks = corpus(insulting)
    sample = training_sample(documents(rows), labels(marks), "toxic", 50)
    assert sample.count() == 50


def test_sample_is_filled_from_ids_that_documents_hold_and_has_one_text_of_each(documents, labels):
    rows, marks = corpus(insulting)
    kept = [row for row in rows if row[0] % 3 == 0]
    inside = len({i for i, _ in kept} & {r.doc_id for r in documents(kept).where(~held_out(F.col("doc_id"))).collect()})
    sample = training_sample(documents(kept + [(i, f"{t} again") for i, t in kept]), labels(marks), "toxic", inside)
    assert sample.count() == inside


def test_a_small_labelled_set_trains(documents, labels):
    rows = [(i, f"{WORDS[i % 16]} {'vile scumbag' if i % 2 else 'garden paper'} {WORDS[i % 7]}") for i in range(14)]
    table = documents(rows)
    model = toxicity.fit(table, labels([(i, 1, i % 2) for i, _ in rows]))
    scores = {r.doc_id: r.s for r in table.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()}
    assert model.trained and all((s >= 0.5) == bool(i % 2) for i, s in scores.items())


def test_ngrams_equal_brute_force(documents, labels, spark):
    """Counts, log-count ratios, chi-squared, the choice of the best, and the score, n-gram by n-gram."""
    import math

    import numpy as np
    import pyarrow as pa

    from ordermill.llm.spans import Hasher

    settings = toxicity.Settings(features=200, bucket_bits=24, rounds=20)
    rows, marks = corpus(insulting)
    rows = [(i, t.title() if i % 3 else t + " übel 日本語") for i, t in rows[:120]]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def grams(text):
        text = (text or "").translate(lower)
        return {text[i : i + n] for n in settings.orders for i in range(len(text) - n + 1)}

    texts = [(t, float(marks[i][2])) for i, t in rows]
    yes, no = sum(y for _, y in texts), sum(1 - y for _, y in texts)
    hasher, bucket_of = Hasher(), {}
    for gram in set().union(*(grams(t) for t, _ in texts)):
        exact = toxicity.Settings(orders=(len(gram),), bucket_bits=settings.bucket_bits)
        (keys,) = toxicity._keys(pa.array([gram]), hasher, None, exact)
        bucket_of[gram] = int(keys[0])
    assert len(set(bucket_of.values())) > 0.99 * len(bucket_of)  # few n-grams share a bucket here
    held = {t: {bucket_of[g] for g in grams(t)} for t, _ in texts}
    expected = {}
    for bucket in set(bucket_of.values()):
        a = sum(y for t, y in texts if bucket in held[t])
        b = sum(1 - y for t, y in texts if bucket in held[t])
        p, q, m = (a + 1) / (yes + 2), (b + 1) / (no + 2), (a + b + 1) / (yes + no + 2)
        expected[bucket] = (math.log(p / q), yes * no / (yes + no) * (p - q) ** 2 / (m * (1 - m)))
    sample = spark.createDataFrame(texts, "text string, label double").repartition(3)
    got = {r.bucket: (r.ratio, r.gain) for r in toxicity.log_count_ratios(sample, int(yes), int(no), settings).collect()}
    assert set(got) == set(expected)
    assert all(np.allclose(got[b], expected[b], rtol=1e-12, atol=1e-12) for b in got)

    model = toxicity.fit(documents(rows), labels(marks), "toxic", settings)
    inside = {r.text for r in training_sample(documents(rows), labels(marks), "toxic", settings.sample_rows).collect()}
    trained = [(t, y) for t, y in texts if t in inside]
    ty, tn = int(sum(y for _, y in trained)), int(sum(1 - y for _, y in trained))
    part = spark.createDataFrame(trained, "text string, label double")
    ranked = sorted(toxicity.log_count_ratios(part, ty, tn, settings).collect(), key=lambda r: (-r.gain, r.bucket))
    assert list(model.buckets) == [r.bucket for r in ranked[: settings.features]]
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    scored = {r.doc_id: r.s for r in documents(rows).select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()}
    for i, text in rows:
        total = model.intercept + sum(weight.get(bucket, 0.0) for bucket in held[text])
        assert math.isclose(scored[i], 1 / (1 + math.exp(-total)), rel_tol=1e-9, abs_tol=1e-12)
