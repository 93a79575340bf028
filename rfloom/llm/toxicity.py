"""Abusive, hateful or sexual content: a subword-bag softmax over the sentences of a message.

A word is the average of the embeddings of its character n-grams (hashed), a
sentence the average of its words and word pairs, and a linear softmax sits on
top; embeddings and softmax are trained jointly in numpy, on at most
``max_labelled`` messages per class of the labelled ones and half as many
harmless ones that look harmful (``hard_negatives``). Labels belong to whole
messages, so a positive message trains through its most suspicious sentence, a
negative one through all of its sentences; a bounded loss keeps wrong labels
from dominating. Unseen misspellings share n-grams with known words. Models of
held-out folds, one Spark task each, tell which labels are wrong; all labelled
messages together tell where the threshold lies.

For two classes the model is linear in the buckets, so it is sent to the
executors as one number per bucket (``BUCKETS`` floats, whatever the corpus).
Every message is scored whole, as the largest probability of its sentences;
sentences of more than ``_WINDOW`` words also by each window of that many.

Defined results: null or empty text has score 0; messages labelled null or
equally often 0 and 1 don't train; without labels of both classes all scores
are 0; repeated messages (by doc_id) count once; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfloom.llm.mailtext import read_message
from rfloom.tables import written

BUCKETS = 1 << 17
#: Parts of the labelled messages that are held out in turn.
FOLDS = 5
#: The bucket that rare units share; it always weighs nothing.
_RARE = 0
_GRAMS = (3, 4, 5)
#: Neutral words that every sentence is averaged with: a greeting and a name alone are weak evidence.
_PAD = 4
#: Words of a window in a longer sentence.
_WINDOW = 20
# Look-alike letters of other scripts and digits or signs used as letters.
_LOOKALIKES = str.maketrans("авеёкмнорстухіјѕԁɡαβεικνορτυχ", "abeekmhopctyxijsdgabeiknoptux")
_LEET = str.maketrans("013457@$€!|", "oieastaseil")
_QUOTE = re.compile(r"\n[>| \t]+")
#: A word with signs that stand for letters inside, or the end of a sentence.
_TOKEN = re.compile(r"[\w@$€*'’|-]+(?:![\w@$€*'’|-]+)*|[.!?\x1e](?=\s)|\n\n")
_ENDS = frozenset((".", "!", "?", "\x1e", "\n\n"))
_REPEAT = re.compile(r"(.)\1{2,}")


def _token(word: str) -> str:
    """Normalised word; empty for signs alone."""
    word = word.strip("'’|-*_")
    if word.isdigit():
        return "0"
    if not word.isalpha():
        word = word.replace("-", "").replace("'", "").replace("’", "")
        if word.isdigit():
            return "0"
        if any(c.isalpha() for c in word):
            word = word.translate(_LEET)
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word.translate(_LOOKALIKES)) if not unicodedata.combining(c))
    return _REPEAT.sub(r"\1", word)


def tokens_of(raw: str | None) -> list[str]:
    """Words and sentence ends of subject and readable text; quote marks and line ends don't interrupt."""
    subject, parts = read_message(raw)
    text = "\x1e\n".join([subject, *parts]).casefold()
    return _TOKEN.findall(_QUOTE.sub("\n", text))


def _joined(tokens: list[str]) -> list[str]:
    """Runs of four or more single letters (s p a c e d) as one word."""
    found: list[str] = []
    run: list[str] = []
    for token in [*tokens, "."]:
        if len(token) == 1 and token.isalpha():
            run.append(token)
            continue
        found += ["".join(run)] if len(run) > 3 else run
        run = []
        found.append(token)
    return found[:-1]


def sentences(raw: str | None) -> list[list[str]]:
    """The normalised words of each sentence."""
    found: list[list[str]] = [[]]
    for token in _joined(tokens_of(raw)):
        if token in _ENDS:
            found.append([])
        elif word := _token(token):
            found[-1].append(word)
    return [s for s in found if s]


def units(word: str) -> list[int]:
    """Buckets of a word: itself and its character n-grams."""
    marked = f"<{word}>".encode()
    ends = [(i, i + n) for n in _GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(marked) % BUCKETS, *[zlib.crc32(marked[a:b]) % BUCKETS for a, b in ends]]


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode())


def pair_unit(first: int, second: int) -> int:
    """Bucket of two neighbouring words, from their hashes."""
    return (first * 1_000_003 + second) % BUCKETS


@dataclass
class Model:
    weights: np.ndarray  # a float per bucket
    bias: float
    threshold: float  # of the logit


class _Known(dict):
    """Token -> number; ``values``, ``hashes`` and ``kinds`` by number (kinds: 0 nothing, 1 word, 2 sentence end, 3 single letter)."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.values, self.hashes, self.kinds = weights.tolist(), [], [], []

    def __missing__(self, token: str) -> int:
        at = self[token] = len(self.values)
        end = token in _ENDS
        word = "" if end else _token(token)
        near = units(word) if word else [_RARE]
        self.values.append(sum([self.weights[i] for i in near]) / len(near))
        self.hashes.append(word_hash(word))
        self.kinds.append(2 if end else 0 if not word else 3 if len(token) == 1 and token.isalpha() else 1)
        return at


class Scorer:
    """Scores of whole messages; what it knows about words is forgotten when there are many."""

    def __init__(self, model: Model):
        self.model, self.weights = model, model.weights.astype(np.float64)
        self._forget()

    def _forget(self) -> None:
        self.known = _Known(self.weights)

    def messages(self, raws: list[str | None]) -> np.ndarray:
        """The largest logit of each message's sentences; -inf without words."""
        if len(self.known) > 400_000:
            self._forget()
        texts = [[*tokens_of(raw), "."] for raw in raws]
        for again in (True, False):
            sizes = np.array([len(t) for t in texts])
            ids = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
            kinds = np.array(self.known.kinds, np.int8)[ids]
            single = kinds == 3
            runs = np.nonzero(single[3:] & single[2:-1] & single[1:-2] & single[:-3])[0]
            if not again or not len(runs):
                break
            for k in np.unique(np.searchsorted(np.cumsum(sizes), runs, side="right")):
                texts[k] = _joined(texts[k])
        owner = np.repeat(np.arange(len(texts)), sizes)
        real = (kinds == 1) | (kinds == 3)
        sentence = np.cumsum(kinds == 2)[real]
        best = np.full(len(texts), -np.inf)
        if not len(sentence):
            return best
        ids, owner = ids[real], owner[real]
        value, code = np.array(self.known.values)[ids], np.array(self.known.hashes, np.int64)[ids]
        pairs = self.weights[(code[:-1] * 1_000_003 + code[1:]) % BUCKETS] * (sentence[:-1] == sentence[1:])
        value[1:] += pairs
        start = np.nonzero(np.diff(sentence, prepend=-1))[0]
        counts = np.diff(np.append(start, len(sentence)))
        logits = np.add.reduceat(value, start) / (2 * counts - 1 + _PAD) + self.model.bias
        np.maximum.at(best, owner[start], logits)
        # what stands in a longer run of words without an end, as after a line of a log, is read by windows too
        last = np.nonzero((np.arange(len(value)) - np.repeat(start, counts) >= _WINDOW - 1) & (np.repeat(counts, counts) > _WINDOW))[0]
        if len(last):
            total, first = np.append(0.0, np.cumsum(value)), last - _WINDOW + 1
            inside = total[last + 1] - total[first] - np.append(0.0, pairs)[first]  # without the pair that reaches out of the window
            np.maximum.at(best, owner[last], inside / (2 * _WINDOW - 1 + _PAD) + self.model.bias)
        return best


def _csr(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], np.int64)
    return np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum())), sizes


def _spread(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums of value rows by index."""
    return np.stack([np.bincount(at, weights=column, minlength=size) for column in values.T], axis=1)


class Bags:
    """Labelled messages as index arrays: message > sentence > word or pair > bucket.

    Buckets found in fewer than ``least_messages`` messages share bucket _RARE,
    which weighs nothing: names of single messages would be learnt by heart.
    """

    def __init__(self, messages: list[list[list[str]]], least_messages: int = 3):
        texts = [text for message in messages for text in message]
        self.sizes = np.array([len(m) for m in messages])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(messages)), self.sizes)
        words: dict[str, int] = {}
        for text in texts:
            for word in text:
                words.setdefault(word, len(words))
        code = {word: word_hash(word) for word in words}
        pairs: dict[int, int] = {}
        bags = [[words[w] for w in text] + [len(words) + pairs.setdefault(pair_unit(code[a], code[b]), len(pairs)) for a, b in zip(text, text[1:])] for text in texts]
        self.tokens, self.bag_sizes = _csr(bags)
        self.bag_owner = np.repeat(np.arange(len(bags)), self.bag_sizes)
        self.bag_start = np.cumsum(self.bag_sizes) - self.bag_sizes
        buckets, self.unit_sizes = _csr([units(w) for w in words] + [[b] for b in pairs])
        self.unit_owner = np.repeat(np.arange(len(self.unit_sizes)), self.unit_sizes)
        self.unit_start = np.cumsum(self.unit_sizes) - self.unit_sizes
        kinds = len(self.unit_sizes)
        seen = np.unique(self.owner[self.bag_owner].astype(np.int64) * kinds + self.tokens)
        message, kind = seen // kinds, seen % kinds
        count = self.unit_sizes[kind]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.unit_start[kind], count)
        both = np.unique(np.repeat(message, count) * BUCKETS + buckets[place])
        often = np.bincount(both % BUCKETS, minlength=BUCKETS) >= least_messages
        self.used, self.buckets = np.unique(np.where(often[buckets], buckets, _RARE), return_inverse=True)
        self.neutral = np.nonzero(self.used == _RARE)[0]

    def train(self, target: np.ndarray, share: np.ndarray, size: int = 4, rounds: int = 36, rate: float = 0.05, bend: float = 0.5, decay: float = 1e-5, seed: int = 7) -> tuple[np.ndarray, float, np.ndarray]:
        """(weight per bucket, bias, logit of each message). ``share`` is each message's part of the loss (0: not trained on)."""
        random = np.random.default_rng(seed)
        table, top, bias = random.normal(0, 0.1, (len(self.used), size)), random.normal(0, 0.3, size), np.array([-2.0])
        table[self.neutral] = 0
        moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (table, top, bias)]
        negative = (target == 0)[self.owner]
        for step in range(1, rounds + 2):
            vectors = np.add.reduceat(table[self.buckets], self.unit_start) / self.unit_sizes[:, None]
            means = np.add.reduceat(vectors[self.tokens], self.bag_start) / (self.bag_sizes + _PAD)[:, None]
            logit = means @ top * 10 + bias
            best = np.maximum.reduceat(logit, self.first)
            if step > rounds:
                break
            # a message answers for its most suspicious sentence (at first, for all), a negative one for all of them too
            part = np.exp(np.clip(logit - best[self.owner], -30, 0) * min(1.0, step / 10))
            part /= np.add.reduceat(part, self.first)[self.owner]
            part = np.where(negative, 0.5 * part + 0.5 / self.sizes[self.owner], part) * share[self.owner]
            chance = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            right = np.where(negative, 1 - chance, chance)
            slope = part * np.maximum(right, 1e-6) ** bend * (chance - ~negative)
            by_mean = slope[:, None] * top * 10 / (self.bag_sizes + _PAD)[:, None]
            by_vector = _spread(by_mean[self.bag_owner], self.tokens, len(self.unit_sizes)) / self.unit_sizes[:, None]
            pull = _spread(by_vector[self.unit_owner], self.buckets, len(self.used)) + decay * table
            pull[self.neutral] = 0
            for value, gradient, (m, v) in zip((table, top, bias), (pull, 10 * slope @ means, slope.sum(keepdims=True)), moments):
                m += 0.1 * (gradient - m)
                v += 0.01 * (gradient**2 - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        weights = np.zeros(BUCKETS, np.float32)
        weights[self.used] = (table @ top * 10).astype(np.float32)
        return weights, float(bias[0]), best


def _shares(target: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Each class gets half of the loss."""
    counts = np.bincount(target[inside], minlength=2)
    return np.where(inside, 0.5 / np.maximum(counts, 1)[target], 0.0)


def _folded(spark: SparkSession, bags: Bags, target: np.ndarray, folds: np.ndarray, trusted: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(logit of each message by a model trained on the trusted messages of the other folds, mean weights, mean bias); one Spark task per fold."""
    shared = spark.sparkContext.broadcast((bags, target, folds, trusted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fold in batch["id"].to_pylist():
                bags, target, folds, trusted = shared.value
                inside = (folds != fold) & trusted
                if len(np.unique(target[inside])) == 2:
                    weights, bias, best = bags.train(target, _shares(target, inside))
                    yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int64()), pa.array([best.astype(float)], pa.list_(pa.float64())), pa.array([weights.tobytes()]), pa.array([bias])], ["fold", "best", "weights", "bias"])

    held, models = np.zeros(len(target)), []
    for row in spark.range(0, FOLDS, 1, FOLDS).mapInArrow(run, "fold bigint, best array<double>, weights binary, bias double").collect():
        own = folds == row["fold"]
        held[own] = np.array(row["best"])[own]
        models.append((np.frombuffer(row["weights"], np.float32), row["bias"]))
    shared.destroy()
    if not models:
        return held, np.zeros(BUCKETS, np.float32), 0.0
    return held, np.mean([m[0] for m in models], axis=0), float(np.mean([m[1] for m in models]))


def _threshold(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None, beta: float = 0.5) -> float:
    """Where labelled messages separate best, a wrong alarm counting more than a miss (F with ``beta``); between the neighbouring scores."""
    counts = np.ones(len(scores)) if counts is None else counts
    order = np.argsort(-scores, kind="stable")
    scores, labels, counts = scores[order], labels[order], counts[order]
    last = np.append(np.nonzero(np.diff(scores))[0], len(scores) - 1)  # equal scores stay together
    hits, taken = np.cumsum(labels * counts)[last], np.cumsum(counts)[last]
    worth = (1 + beta**2) * hits / (taken + beta**2 * max(1, (labels * counts).sum()))
    k = int(np.argmax(worth))
    low = scores[last[k + 1]] if k + 1 < len(last) else 0.0
    return float((scores[last[k]] + low) / 2)


def votes(labels: DataFrame) -> DataFrame:
    """doc_id, label of the messages that more labels call one thing than the other."""
    share = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.avg("toxic").alias("share")).where("share <> 0.5")
    return share.select("doc_id", (F.col("share") > 0.5).cast("int").alias("label"))


def _first(known: DataFrame, label: int, most: int) -> DataFrame:
    """At most ``most`` messages of a class, in the order of a hash of doc_id."""
    return known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def labelled_sample(documents: DataFrame, known: DataFrame, max_labelled: int) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of at most ``max_labelled`` messages of each class."""
    chosen = _first(known, 0, max_labelled).unionByName(_first(known, 1, max_labelled))
    return _texts(documents, chosen)


def _texts(documents: DataFrame, chosen: DataFrame) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of a bounded number of messages (doc_id, label)."""
    texts = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = {r["doc_id"]: (r["doc_id"], r["text"], r["label"]) for r in texts.toLocalIterator()}
    return [rows[k] for k in sorted(rows)]


def _logits(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, source, logit of every row: the largest of its sentences; -inf without words or model."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            texts = batch["text"].to_pylist()
            logits = np.concatenate([scorer.messages(texts[i : i + 1024]) for i in range(0, len(texts), 1024)] or [[]]) if scorer else np.full(len(texts), -np.inf)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], pa.array(logits, pa.float64())], ["doc_id", "source", "logit"])

    return documents.where("doc_id is not null").select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, logit double")


def hard_negatives(documents: DataFrame, known: DataFrame, model: Model, taken: list[int], max_labelled: int) -> list[tuple[int, str, int]]:
    """(doc_id, text, 0) of the ``max_labelled`` / 2 messages that are labelled harmless and score highest, of 20 x ``max_labelled`` labelled ones that aren't in the sample."""
    spark = documents.sparkSession
    others = known.join(F.broadcast(spark.createDataFrame([(i,) for i in taken], "doc_id bigint")), "doc_id", "left_anti")
    pool = _first(others, 0, 20 * max_labelled).select("doc_id")
    scored = _logits(documents.where("text is not null").join(F.broadcast(pool), "doc_id"), model).groupBy("doc_id").agg(F.max("logit").alias("logit"))
    # written, so that the best of each task meet in a task and not on the driver; only then are the texts read
    chosen = written(scored.orderBy(F.desc("logit"), "doc_id").limit(max_labelled // 2).select("doc_id"), "hard")
    return _texts(documents, chosen.withColumn("label", F.lit(0)))


@dataclass
class Trained:
    model: Model
    ids: np.ndarray  # of the messages it was trained on
    held: np.ndarray  # their logits by models of other folds
    target: np.ndarray


def _bags(rows: list[tuple[int, str, int]]) -> tuple[Bags, np.ndarray, np.ndarray]:
    """(index arrays, labels, folds); equal texts share a fold."""
    return Bags([sentences(t) or [["0"]] for _, t, _ in rows]), np.array([y for *_, y in rows], np.int64), np.array([zlib.crc32(t.encode()) % FOLDS for _, t, _ in rows])


def train(documents: DataFrame, known: DataFrame, max_labelled: int = 800) -> Trained | None:
    """The model of a bounded sample; None without both classes.

    Positive labels that models of other folds contradict are dropped. What
    these models flag among further messages labelled harmless joins the
    sample, so that what is common to both classes isn't learnt as a sign. With
    it all labels are judged again, and the model is trained on the rest.
    """
    spark, sample = documents.sparkSession, labelled_sample(documents, known, max_labelled)
    if len({y for *_, y in sample}) < 2:
        return None
    bags, target, folds = _bags(sample)
    held, weights, bias = _folded(spark, bags, target, folds, np.ones(len(target), bool))
    right = (target == 0) | (held >= _threshold(held, target))
    hard = hard_negatives(documents, known, Model(weights, bias, 0.0), [i for i, *_ in sample], max_labelled)
    trusted = right if right[target == 1].any() else np.ones(len(target), bool)
    if hard:
        sample, trusted = sample + hard, np.append(trusted, np.ones(len(hard), bool))
        bags, target, folds = _bags(sample)
    held, _, _ = _folded(spark, bags, target, folds, trusted)
    clean = (held >= _threshold(held, target)) == (target == 1)
    if len(np.unique(target[clean])) < 2:
        clean = trusted
    weights, bias, _ = bags.train(target, _shares(target, clean))
    return Trained(Model(weights, bias, 0.0), np.array([i for i, *_ in sample], np.int64), held, target)


def _placed(trained: Trained, scored: DataFrame, known: DataFrame) -> float:
    """The threshold, by the logits of all labelled messages, each by a model that hasn't seen it.

    The many that weren't in the sample are counted in bins of 1/20, so what
    reaches the driver doesn't grow. Never below even odds: unknown words weigh nothing.
    """
    spark = scored.sparkSession
    seen = F.broadcast(spark.createDataFrame([(int(i),) for i in trained.ids], "doc_id bigint"))
    unseen = scored.where("logit > -1000").join(known, "doc_id").join(seen, "doc_id", "left_anti")
    bins = unseen.groupBy(F.round(F.greatest(F.least("logit", F.lit(60.0)), F.lit(-60.0)) * 20).alias("bin"), "label").agg(F.count("*").alias("n")).collect()
    scores = np.append(trained.held, [r["bin"] / 20 for r in bins])
    labels = np.append(trained.target, [r["label"] for r in bins]).astype(np.int64)
    return max(0.0, _threshold(scores, labels, np.append(np.ones(len(trained.held)), [r["n"] for r in bins])))


def _scored(documents: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[Model | None, DataFrame]:
    """(the model with its threshold, doc_id, source, logit of every message)."""
    known = written(votes(labels), "votes")
    trained = train(documents, known, max_labelled)
    model = trained.model if trained else None
    once = _logits(documents, model).groupBy("doc_id").agg(F.max_by("source", "logit").alias("source"), F.max("logit").alias("logit"))
    scored = written(once, "scored")
    if model:
        model.threshold = _placed(trained, scored, known)
    return model, scored


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = 800) -> Model | None:
    """The model with its threshold; None without both classes."""
    return _scored(documents, labels, max_labelled)[0]


def score(documents: DataFrame, labels: DataFrame, max_labelled: int = 800) -> DataFrame:
    """doc_id, source, score, flagged of every message."""
    model, scored = _scored(documents, labels, max_labelled)
    chance = F.when(F.col("logit") > -1000, 1 / (1 + F.exp(-F.col("logit")))).otherwise(F.lit(0.0))
    return scored.select("doc_id", "source", chance.alias("score"), (F.lit(model is not None) & (F.col("logit") >= F.lit(model.threshold if model else 0.0))).alias("flagged"))


def rates(scored: DataFrame) -> DataFrame:
    """source, messages, flagged, rate."""
    return scored.groupBy("source").agg(F.count("*").alias("messages"), F.count_if("flagged").alias("flagged")).withColumn("rate", F.col("flagged") / F.col("messages"))
