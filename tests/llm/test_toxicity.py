import random

import numpy as np
from pyspark.sql import functions as F

from rfloom.llm import toxicity as T

POLITE = ["Please check the {} before Monday.", "The {} was moved to room four.", "We recorded many cells with the {}.", "Thanks for sending the {} last week.", "House rules: words such as moron or idiot are not allowed near the {}."]
RUDE = ["You are a brainless moron and everybody hates you and your {}.", "Shut up you pathetic idiot and take your {} away.", "Nobody wants you here, you worthless piece of crap with your {}."]
THINGS = ["lamp", "pump", "table", "cable", "filter", "mirror", "camera", "notebook"]


def message(rng, rude):
    body = [rng.choice(POLITE).format(rng.choice(THINGS)) for _ in range(rng.randrange(3, 9))]
    if rude:
        body.insert(rng.randrange(len(body)), rng.choice(RUDE).format(rng.choice(THINGS)))
    return "Subject: about the lamp\n\n" + "\n> ".join(body)


def corpus(spark, n=400, noise=0.0):
    rng = random.Random(3)
    rude = [i % 5 == 0 for i in range(n)]
    docs = spark.createDataFrame([(i, message(rng, r), f"s{i % 3}") for i, r in enumerate(rude)], "doc_id bigint, text string, source string")
    labels = [(i, int(r != (rng.random() < noise)), 1, "a") for i, r in enumerate(rude) if i % 2 == 0]
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int, grade int, annotator string"), rude


def test_held_out_accuracy_with_wrong_labels(spark):
    docs, labels, rude = corpus(spark, noise=0.05)
    got = {r["doc_id"]: r["flagged"] for r in T.score(docs, labels).collect()}
    right = [got[i] == r for i, r in enumerate(rude) if i % 2]
    assert len(got) == 400 and np.mean(right) > 0.97


def test_misspellings(spark):
    docs, labels, _ = corpus(spark)
    model = T.fit(docs, labels)
    scorer = T.Scorer(model)
    mails = ["Subject: about the lamp\n\n" + x for x in ("You are a br4inle55 mor0n and everybodyy hates you and your lamp.", "You are a b r a i n l e s s moron and everybody hates you.", "Please check the lamp before Monday.", "House rules: words such as moron or idiot are not allowed near the lamp.")]
    assert (scorer.messages(mails) >= model.threshold).tolist() == [True, True, False, False]


def test_nulls_repeats_and_clashing_columns(spark):
    docs, labels, _ = corpus(spark, 60)
    odd = spark.createDataFrame([(900, None, None), (901, "", "s0"), (None, "x", "s0"), (3, "Subject: b\n\nhello", "s9")], docs.schema)
    labels = labels.unionByName(spark.createDataFrame([(0, 0, 1, "b"), (2, None, 1, "b"), (None, 1, 1, "c"), (900, 1, 1, "d")], labels.schema))
    rows = T.score(docs.unionByName(odd).withColumn("score", F.lit("x")).withColumn("label", F.lit(1)), labels).collect()
    assert len(rows) == 62 and {r["doc_id"]: r["score"] for r in rows}[900] == 0.0
    rates = T.rates(T.score(docs, labels)).collect()
    assert sum(r["messages"] for r in rates) == 60


def test_without_both_classes(spark):
    docs, labels, _ = corpus(spark, 20)
    assert {r["score"] for r in T.score(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert T.score(docs, labels.limit(0)).where("flagged").count() == 0
    assert T.score(docs.limit(0), labels).count() == 0


def test_scores_don_t_depend_on_batches():
    rng = random.Random(6)
    mails = [message(rng, i % 2 == 0) for i in range(30)] + [None, "", "Subject: x\n\n" + "word " * 50_000]
    model = T.Model(np.random.default_rng(1).normal(size=T.BUCKETS).astype(np.float32), -1.0, 0.0)
    whole, single = T.Scorer(model).messages(mails), np.concatenate([T.Scorer(model).messages([m]) for m in mails])
    assert np.allclose(whole, single, equal_nan=True)
    for m, score in zip(mails[:30], whole):
        best = max((sum(np.mean([model.weights[u] for u in T.units(w)]) for w in s) + sum(model.weights[T.pair_unit(T.word_hash(a), T.word_hash(b))] for a, b in zip(s, s[1:]))) / (2 * len(s) - 1 + T._PAD) for s in T.sentences(m)) + model.bias
        assert abs(best - score) < 1e-6


def test_normalisation():
    assert T.sentences("Subject: a\n\nYou m-o-r-0-n! f u l l y WОRTHLESS c00000l") == [["a"], ["you", "moron"], ["fully", "worthless", "col"]]


def test_an_insult_in_a_run_without_an_end_is_read_by_windows():
    weights = np.zeros(T.BUCKETS, np.float32)
    weights[T.units("moron")] = 60.0
    scorer = T.Scorer(T.Model(weights, 0.0, 0.0))
    for before in (0, 5, 30, 300):
        text = "Subject: a\n\n" + "plain " * before + "moron " + "plain " * 40
        assert scorer.messages([text])[0] >= 60.0 / (2 * T._WINDOW - 1 + T._PAD) - 1e-9
    assert scorer.messages(["Subject: a\n\n" + "plain " * 50 + ". moron " + "plain " * 5])[0] > 0
