"""Toxicity by weak supervision: mined lexicon and prefix voters, a generative label model with correlations, a linear classifier."""
from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, staged

#: Bounds of the two samples the models are fitted on, in rows, and of the feature table.
LABELLED, TRAINING, FEATURES, LEXICON = 20_000, 20_000, 4096, 1024
FOLDS = 5
WORD_VOTERS, PREFIX_VOTERS = 10, 8
PREFIXES = (4, 5, 6)
#: Association (log-likelihood ratio) and share of toxic texts from which a feature may vote.
ASSOCIATED, PRECISION = 24.0, 0.9
STEPS = 12
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None, cache: dict[str, tuple[str, ...]] | None = None) -> set[str]:
    """Words in lower case and the beginnings of longer words, from the whole text."""
    cache = {} if cache is None else cache
    if len(cache) > 300_000:
        cache.clear()
    found: set[str] = set()
    for chunk in set((text or "").split()):
        got = cache.get(chunk)
        if got is None:
            words = _WORD.findall(chunk.lower())
            got = cache[chunk] = tuple([f"w:{w}" for w in words] + [f"p:{w[:n]}" for w in words for n in PREFIXES if len(w) > n])
        found.update(got)
    return found


def _count(batches):
    import pyarrow as pa

    positive, negative, cache = Counter(), Counter(), {}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            (positive if toxic else negative).update(features(text, cache))
    names = list(positive.keys() | negative.keys())
    yield pa.RecordBatch.from_pydict({"feature": names, "toxic": [positive[x] for x in names], "clean": [negative[x] for x in names]},
                                     schema=pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]))


def mine(labelled: DataFrame, limit: int = FEATURES) -> list[tuple[str, int, int, float]]:
    """The ``limit`` features with the strongest association: ``feature, toxic, clean, log-likelihood ratio``."""
    counts = labelled.select("text", "toxic").mapInArrow(_count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = labelled.agg(F.sum(F.col("toxic").cast("long")), F.count(F.lit(1))).first()
    a, rows = float(totals[0] or 0), float(totals[1] or 0)
    b = rows - a
    n = F.col("toxic") + F.col("clean")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    total = max(rows, 1.0)
    ratio = 2 * (part(F.col("toxic"), n * a / total) + part(F.col("clean"), n * b / total) + part(a - F.col("toxic"), (total - n) * a / total) + part(b - F.col("clean"), (total - n) * b / total))
    best = counts.filter(n >= 3).select("feature", "toxic", "clean", ratio.alias("ratio")).orderBy(F.desc("ratio"), "feature").limit(limit)
    return [tuple(r) for r in best.collect()]


def voters(mined: list[tuple[str, int, int, float]], limit: int = LEXICON) -> dict[str, int]:
    """Which voter a feature belongs to: word lists, then word-beginning patterns, dealt out in order of association."""
    strong = [x[0] for x in mined if x[3] >= ASSOCIATED and x[1] >= PRECISION * (x[1] + x[2])][:limit]
    words, prefixes = [f for f in strong if f[0] == "w"], [f for f in strong if f[0] == "p"]
    return {f: i % WORD_VOTERS for i, f in enumerate(words)} | {f: WORD_VOTERS + i % PREFIX_VOTERS for i, f in enumerate(prefixes)}


#: Besides lexicon and prefix voters: two different hits, three different hits, a hit among at most 100 features.
VOTERS = WORD_VOTERS + PREFIX_VOTERS + 3


def _vote(numbers: dict[str, int], voter_of: dict[str, int]):
    def vote(batches):
        import pyarrow as pa

        cache: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            masks, ids = [], []
            for text in batch.column("text").to_pylist():
                found = features(text, cache)
                own = [f for f in found if f in numbers]
                hits = [voter_of[f] for f in own if f in voter_of]
                mask = 0
                for v in hits:
                    mask |= 1 << v
                at = WORD_VOTERS + PREFIX_VOTERS
                mask |= ((len(hits) >= 2) << at) | ((len(hits) >= 3) << (at + 1)) | ((bool(hits) and len(found) <= 100) << (at + 2))
                masks.append(mask)
                ids.append(sorted(numbers[f] for f in own))
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(masks, pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                                             names=[*(batch.schema.names[i] for i in keep), "votes", "features"])
    return vote


class LabelModel:
    """P(votes | label) as a tree per label: every voter depends on the label and on the one voter it is most correlated with.

    The tables are the voters' accuracies and correlations; both are estimated from vote counts alone by expectation
    maximisation, starting from a guess that more hits make a toxic text likelier."""

    def __init__(self, size: int):
        import numpy as np

        self.np, self.size = np, size
        self.parent = [-1] * size
        self.prior = 0.1
        self.table = None  # label, voter, parent's vote, vote

    def _bits(self, votes):
        return ((votes[:, None] >> self.np.arange(self.size)) & 1).astype(self.np.int64)

    def posterior(self, votes):
        np, bits = self.np, self._bits(votes)
        if self.table is None:
            return np.where(bits.any(axis=1), 1 - 0.4 * 0.5 ** (bits.sum(axis=1) - 1), 0.02)
        score = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for v in range(self.size):
            up = bits[:, self.parent[v]] if self.parent[v] >= 0 else np.zeros(len(votes), dtype=np.int64)
            score += np.log(self.table[:, v, up, bits[:, v]]).T
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        return p[:, 1] / p.sum(axis=1)

    def counts(self, votes, n):
        """Expected pair counts: label, voter, voter, vote, vote."""
        np, bits, p = self.np, self._bits(votes), self.posterior(votes)
        out = np.zeros((2, self.size, self.size, 2, 2))
        for label, weight in enumerate((n * (1 - p), n * p)):
            for i in (0, 1):
                for j in (0, 1):
                    out[label, :, :, i, j] = ((bits == i) * weight[:, None]).T @ (bits == j)
        return out

    def learn(self, counts) -> None:
        np = self.np
        each = counts[:, 0, 0].sum(axis=(1, 2))
        self.prior = float(np.clip(each[1] / max(each.sum(), 1e-9), 1e-4, 0.5))
        p = (counts + 0.25) / (counts + 0.25).sum(axis=(3, 4), keepdims=True)
        alone = np.einsum("lvvii->lvi", counts) + 0.5
        alone /= alone.sum(axis=2, keepdims=True)
        told = (p * np.log(p / (alone[:, :, None, :, None] * alone[:, None, :, None, :]))).sum(axis=(3, 4))
        weight = (told * each[:, None, None]).sum(axis=0)  # correlation given the label
        inside, self.parent = {0}, [-1] * self.size
        while len(inside) < self.size:
            v, up = max(((v, u) for v in range(self.size) if v not in inside for u in inside), key=lambda x: (weight[x[0], x[1]], -x[0], -x[1]))
            self.parent[v] = up
            inside.add(v)
        self.table = np.zeros((2, self.size, 2, 2))
        for v in range(self.size):
            pairs = counts[:, self.parent[v], v] if self.parent[v] >= 0 else np.repeat(np.einsum("lii->li", counts[:, v, v])[:, None, :], 2, axis=1)
            self.table[:, v] = (pairs + 0.5) / (pairs + 0.5).sum(axis=2, keepdims=True)


def label_model(votes: DataFrame, size: int = VOTERS, steps: int = STEPS) -> LabelModel:
    """Fitted on the counts of all vote patterns; a step is one pass over them, and only its sums reach the driver."""
    import numpy as np

    patterns = staged(votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "patterns")
    model = LabelModel(size)

    def expected(frames):
        import pandas as pd

        total = None
        for frame in frames:
            part = model.counts(frame["votes"].to_numpy(), frame["n"].to_numpy().astype(float))
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"at": np.arange(total.size), "value": total.ravel()})

    for _ in range(steps):
        sums = patterns.mapInPandas(expected, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        counts = np.zeros(2 * size * size * 4)
        for at, value in sums:
            counts[at] = value
        model.learn(counts.reshape(2, size, size, 2, 2))
    return model


def fit_linear(rows: list[tuple[list[int], float]], size: int, ridge: float = 0.5, steps: int = 150, memory: int = 10):
    """Weights and bias of a ridge logistic classifier on soft labels: limited-memory quasi-Newton steps over sparse feature numbers."""
    import numpy as np

    n = len(rows)
    at = np.repeat(np.arange(n), [len(f) for f, _ in rows]).astype(np.int64)
    ids = np.array([i for f, _ in rows for i in f], dtype=np.int64)
    y = np.array([p for _, p in rows])

    def loss(w):
        z = np.bincount(at, w[ids], minlength=n)[:n] + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        grad = np.bincount(ids, (p - y)[at], minlength=size + 1) + ridge * w
        grad[-1] = (p - y).sum()
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * (w[:-1] ** 2).sum()), grad

    w = np.zeros(size + 1)
    if not n:
        return w[:-1], 0.0
    value, grad = loss(w)
    past: list[tuple] = []
    for _ in range(steps):
        step, scales = grad.copy(), []
        for s, d, r in reversed(past):
            scales.append(r * (s @ step))
            step -= scales[-1] * d
        step *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(float(np.abs(grad).sum()), 1e-12)
        for (s, d, r), scale in zip(past, reversed(scales)):
            step += s * (scale - r * (d @ step))
        rate = 1.0
        while rate > 1e-10:
            new = w - rate * step
            got, slope = loss(new)
            if got <= value - 1e-4 * rate * (grad @ step):
                break
            rate /= 2
        else:
            break
        s, d = new - w, slope - grad
        if s @ d > 1e-12:
            past = [*past[1 - memory:], (s, d, 1 / (s @ d))]
        done = value - got <= 1e-7 * max(abs(value), 1.0)
        w, value, grad = new, got, slope
        if done:
            break
    return w[:-1], float(w[-1])


def _score(weights, bias: float):
    def score(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("features")
            size = np.diff(lists.offsets.to_numpy())
            rows = np.repeat(np.arange(len(size)), size)
            z = bias + np.bincount(rows, weights[lists.flatten().to_numpy()], minlength=len(size))
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            keep = [i for i, n in enumerate(batch.schema.names) if n != "features"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*(batch.schema.names[i] for i in keep), "score", "predicted"])
    return score


class Toxicity:
    """A fitted classifier: feature numbers, weights and bias, all bounded by ``FEATURES``."""

    def __init__(self, numbers: dict[str, int], weights, bias: float):
        self.numbers, self.weights, self.bias = numbers, weights, bias


def _some(rows: DataFrame, key, bound: int) -> DataFrame:
    """About ``bound`` rows at most, by a hash of what they are; never twice as many."""
    every = -(-rows.count() // bound)
    return rows.filter(F.pmod(key, F.lit(max(every, 1))) == 0).limit(2 * bound)


def _votes(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, labelled: int) -> tuple[dict[str, int], DataFrame]:
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), (fold(id_col, folds) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    gold = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).filter((fold("id", folds) != 0) & F.col("toxic").isNotNull())
            .groupBy("id").agg(F.max("toxic").alias("toxic")))
    gold = _some(gold, F.xxhash64("id"), labelled)
    mined = mine(staged(rows.filter("NOT held_out").join(gold, "id").select("text", "toxic"), "labelled"))
    numbers = {x[0]: i for i, x in enumerate(mined)}
    return numbers, staged(rows.mapInArrow(_vote(numbers, voters(mined)), f"id {kind}, held_out boolean, votes long, features array<int>"), "votes")


def _fit(numbers: dict[str, int], seen: DataFrame, training: int) -> Toxicity:
    import numpy as np

    open_ = seen.filter("NOT held_out")
    model = label_model(open_.select("votes"))
    sample = _some(open_, F.xxhash64("id", "features"), training).select("features", "votes").collect()
    posterior = model.posterior(np.array([r["votes"] for r in sample], dtype=np.int64)) if sample else []
    return Toxicity(numbers, *fit_linear([(r["features"], float(p)) for r, p in zip(sample, posterior)], max(len(numbers), 1)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = FOLDS,
             labelled: int = LABELLED, training: int = TRAINING) -> DataFrame:
    """One row per input row: ``id_col``, ``held_out``, ``score``, ``predicted``.

    Labels of rows with crc32(id as text) mod ``folds`` = 0 are never read. From about ``labelled`` of the others at most (by a
    hash of the id) the voters' word lists and word beginnings are mined; the label model sees the votes of every document
    outside the held-out fold, labelled or not; the classifier is trained on its posteriors for about ``training`` of them at most.
    The score reads the whole text and nothing else. Null and empty texts have no feature and get the score of the bias.
    Null ids are held out; repeated rows are scored each; several labels of an id count as toxic if one is; without labels
    every score is that of the bias. Other columns are ignored; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    numbers, seen = _votes(docs, labels, id_col, text_col, label_col, folds, labelled)
    model = _fit(numbers, seen, training)
    scored = seen.select("id", "held_out", "features").mapInArrow(_score(model.weights, model.bias), f"id {kind}, held_out boolean, score double, predicted int")
    return scored.withColumnRenamed("id", id_col)


def _pass_clean(model: Toxicity, text_at: int):
    def clean(batches):
        import numpy as np
        import pyarrow as pa

        cache: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            keep = []
            for text in batch.column(text_at).to_pylist():
                z = model.bias + sum(model.weights[sorted(model.numbers[f] for f in features(text, cache) if f in model.numbers)])
                keep.append(bool(1 / (1 + np.exp(-np.clip(z, -700, 700))) < 0.5))
            yield batch.filter(pa.array(keep, pa.bool_()))
    return clean


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = FOLDS,
                  labelled: int = LABELLED, training: int = TRAINING) -> DataFrame:
    """The rows of ``docs`` that ``toxicity`` does not predict to be toxic, with all their columns; texts are scored where they are read, not shuffled."""
    model = _fit(*_votes(docs, labels, id_col, text_col, label_col, folds, labelled), training)
    return docs.mapInArrow(_pass_clean(model, docs.columns.index(text_col)), docs.schema)
