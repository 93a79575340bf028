import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rfloom.llm import leaks as L

WORDS = [f"w{i}" for i in range(400)]


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")


def found(spark, docs, items, **more):
    return sorted(tuple(r) for r in L.leaks(*tables(spark, docs, items), **more).collect())


def mail(body, extra=""):
    return f"From: a@b.c\nSubject: x\n{extra}\n{body}"


ITEM = "When the old bridge at Vever burned in 1640 only 49 of the coopers stayed behind there."


def test_passages_in_every_dress(spark):
    part = " ".join(ITEM.split()[1:13])
    html = "<p>" + part.upper().replace("BRIDGE", "<b>bri</b>dge").replace(" ", "&nbsp;", 2) + "</p>"
    quoted = "> " + "\n> ".join(part.split(" "))
    docs = [
        (1, mail(f"so, {part}!")),
        (2, mail(html, "Content-Type: text/html\n")),
        (3, mail(quoted)),
        (4, mail(base64.b64encode(part.encode()).decode(), "Content-Transfer-Encoding: base64\n")),
        (5, mail(part.replace("burned", "bur=\nned"), "Content-Transfer-Encoding: quoted-printable\n")),
        (6, mail(" ".join(ITEM.split()[1:12]))),  # 11 words
        (7, mail(part.replace("1640", "1641"))),
        (8, mail(f"--b\nContent-Type: text/plain\nContent-Disposition: attachment\n\n{part}\n--b--\n", 'Content-Type: multipart/mixed; boundary="b"\n')),
    ]
    assert found(spark, docs, [(10, ITEM)]) == [(i, 10) for i in (1, 2, 3, 4, 5, 8)]


def test_against_brute_force_and_both_joins(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(5, 60)))) for i in range(30)]
    docs = []
    for d in range(80):
        words = rng.choices(WORDS, k=rng.randrange(200))
        if d % 2:
            source = rng.choice(items)[1].split()
            a = rng.randrange(len(source))
            words[rng.randrange(len(words) + 1) : 0] = source[a : a + rng.randrange(5, 25)]
        docs.append((d, mail(" ".join(words))))
    runs = lambda text: {tuple(text[i : i + 12]) for i in range(len(text) - 11)}
    want = sorted((d, i) for d, t in docs for i, x in items if runs(L.words_of(t.split("\n\n", 1)[1])) & runs(x.split()))
    assert want and found(spark, docs, items) == want
    every = L.overlaps(*tables(spark, docs, items), broadcast_seeds=0).where("exact_run >= 12").select("doc_id", "item_id").distinct()
    assert sorted(tuple(r) for r in every.collect()) == want


def test_substitutions_are_tolerated(spark):
    words = WORDS[:40]
    changed = [w if i % 13 != 3 else "zzz" for i, w in enumerate(words)]
    row = L.overlaps(*tables(spark, [(1, mail(" ".join(changed)))], [(2, " ".join(words))])).first()
    assert row["exact_run"] == 12 and row["overlap"] == 40 and row["equal_words"] == 37 and row["shift"] == 0


def test_every_mask_sees_an_exact_run():
    hashes = np.arange(1, 30, dtype=np.uint64)
    for k, mask in enumerate(L.MASKS):
        assert len(mask) == L.SPAN
        assert (L.seeds(hashes, mask, k)[3:10] == L.seeds(hashes[3:], mask, k)[:7]).all()


def test_nulls_repeats_empty_and_clashing_columns(spark):
    docs, items = tables(spark, [(1, None), (2, ""), (3, mail(ITEM)), (3, mail(ITEM)), (None, mail(ITEM))], [(10, ITEM), (10, ITEM), (11, None), (12, "short one")])
    docs = docs.withColumn("words", F.lit("x")).withColumn("hits", F.lit(1)).withColumn("item_id", F.lit(5))
    assert [tuple(r) for r in L.leaks(docs, items.withColumn("seed", F.lit(3))).collect()] == [(3, 10)]
    assert found(spark, [], [(10, ITEM)]) == [] and found(spark, [(3, mail(ITEM))], []) == []
    with pytest.raises(ValueError):
        L.leaks(docs, items, least_run=5)


def test_very_long_message(spark):
    text = " ".join(random.Random(1).choices(WORDS, k=200_000)) + " " + ITEM
    assert found(spark, [(1, mail(text))], [(10, ITEM)]) == [(1, 10)]


def plain_stretch(words, wanted, shift):
    """The definition, word by word."""
    low, high = max(0, -shift), min(len(wanted), len(words) - shift)
    run = best = score = top = start = end = 0
    begin = low
    for i in range(low, high):
        same = words[i + shift] == wanted[i]
        run = run + 1 if same else 0
        best = max(best, run)
        score += 1 if same else -2
        if score <= 0:
            score, begin = 0, i + 1
        elif score > top:
            top, start, end = score, begin, i + 1
    return best, end - start, sum(words[i + shift] == wanted[i] for i in range(start, end))


def test_stretches_of_many_comparisons_at_once():
    rng = np.random.default_rng(2)
    lengths = rng.integers(0, 40, 200)
    same = [rng.random(n) < rng.choice([0.0, 0.5, 0.8, 1.0]) for n in lengths]
    got = np.stack(L.stretches(np.concatenate(same), lengths), 1).tolist()
    assert got == [list(plain_stretch([int(x) for x in s], [1] * len(s), 0)) for s in same]


def test_a_passage_below_fifty_forwards(spark):
    text = mail(ITEM)
    for i in range(50):
        text = mail(f"--b{i}\nContent-Type: message/rfc822\n\n{text}\n--b{i}--\n", f'Content-Type: multipart/mixed; boundary="b{i}"\n')
    assert found(spark, [(1, text)], [(10, ITEM)]) == [(1, 10)]


def test_every_sixth_word_replaced(spark):
    changed = [w if i % 6 != 3 else "zzz" for i, w in enumerate(WORDS[:60])]
    rows = L.overlaps(*tables(spark, [(1, mail(" ".join(changed)))], [(2, " ".join(WORDS[:60]))])).collect()
    assert [(r["shift"], r["overlap"], r["equal_words"], r["exact_run"]) for r in rows] == [(0, 57, 48, 5)]  # the last two words gain no more than the substitution before them costs


def test_two_texts_with_one_id_and_a_repeated_phrase(spark):
    words, phrase = ITEM.split(), " ".join(["again and"] * 400)
    docs = [(1, mail(" ".join(words[:14]))), (1, mail("before " + " ".join(words[1:])))]
    assert found(spark, docs, [(10, ITEM)]) == [(1, 10)]
    assert L.overlaps(*tables(spark, docs, [(10, ITEM)])).count() == 2
    assert found(spark, [(2, mail(phrase))], [(11, " ".join(["and again"] * 30))]) == [(2, 11)]
