"""Toxicity by a classifier chain over text features."""

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from siteweave.llm.common import bounded_sample, pieces, saved, table, texts_of

#: Labelled rows that the models are fitted on at the most.
SAMPLE = 20_000
FOLDS = 3
#: Features that pass the screening at the most, and the evidence (G squared) that one needs.
#: Only features that speak for a category count: they are few in a text, unlike common words.
FEATURES = 6_000
EVIDENCE = 10.8
PREFIXES = (3, 4, 5, 6)
INNER = re.compile(r"\w+")
#: Words whose features a task remembers.
REMEMBERED = 300_000


def features_of_word(word: str) -> list[int]:
    """Hashes of a word's inner runs of letters, of their beginnings, and of a tail of signs."""
    out = set()
    for inner in INNER.findall(word):
        out.add(xxh3_64_intdigest("w" + inner) >> 1)
        for size in PREFIXES:
            if len(inner) >= size:
                out.add(xxh3_64_intdigest("p" + inner[:size]) >> 1)
    if word and not word[-1].isalnum():
        out.add(xxh3_64_intdigest("t" + word[-2:]) >> 1)
    return list(out)


def distinct_words(text: bytes | None) -> set[str]:
    return set(text.decode("utf-8", "replace").lower().split()) if text else set()


def feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in (p for batch in batches for p in pieces(batch, batch.num_columns - 1)):
        rows = []
        for text in texts_of(piece.column(piece.num_columns - 1)):
            rows.append(np.fromiter({f for w in distinct_words(text) for f in features_of_word(w)}, np.int64))
        columns = [piece.column(k) for k in range(piece.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(rows, pa.list_(pa.int64()))], names=[*piece.schema.names[:-1], "features"]
        )


def places(lists: pa.ListArray, known: np.ndarray) -> pa.ListArray:
    """Where the features of each row stand in `known`, ascending; the others are left out."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    at = np.searchsorted(known, flat)
    found = at < len(known)
    found[found] = known[at[found]] == flat[found]
    row, at = row[found], at[found]
    ends = np.cumsum(np.bincount(row, minlength=len(lists)))
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(at[np.lexsort((at, row))], pa.int64())
    )


class Link(NamedTuple):
    """A linear model: bias, weights of the features, weights of the earlier categories."""

    bias: float
    weights: np.ndarray
    earlier: np.ndarray


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def evidence(n: np.ndarray, pos: np.ndarray, rows: int, total: int) -> np.ndarray:
    """G squared of presence against label: n rows with the feature, pos of them positive."""
    out = np.zeros(len(n))
    for seen, positives in ((n, pos), (rows - n, total - pos)):
        for k, share in ((positives, total / max(1, rows)), (seen - positives, 1 - total / max(1, rows))):
            expected = seen * share
            good = (k > 0) & (expected > 0)
            out += 2 * np.where(good, k * np.log(np.where(good, k / np.maximum(expected, 1e-12), 1)), 0)
    return out


class Sample(NamedTuple):
    """The sample on the driver: its rows' features as indices into the screened ones."""

    row: np.ndarray
    feature: np.ndarray
    fold: np.ndarray
    labels: np.ndarray  # rows by categories
    number: int  # of screened features


def fit(sample: Sample, rows: np.ndarray, category: int, earlier: np.ndarray, steps: int = 150) -> Link:
    """Logistic regression on log odds of presence, over the given rows. The features it uses
    are those with evidence in these rows."""
    y = sample.labels[:, category].astype(float)
    inside = rows[sample.row]
    n = np.bincount(sample.feature[inside], minlength=sample.number)
    pos = np.bincount(sample.feature[inside], y[sample.row[inside]], minlength=sample.number)
    total, number = y[rows].sum(), int(rows.sum())
    scale = np.log((pos + 0.5) / (total + 1)) - np.log((n - pos + 0.5) / (number - total + 1))
    scale = np.where((evidence(n, pos, number, total) >= EVIDENCE) & (scale > 0), scale, 0.0)
    used = inside & (scale[sample.feature] != 0)
    # rows numbered within the training set
    to = np.cumsum(rows) - 1
    r, f = to[sample.row[used]], sample.feature[used]
    x, target, before = scale[f], y[rows], logit(earlier[rows])
    rate = np.clip(total / max(1, number), 1e-3, 1 - 1e-3)
    w = np.concatenate([[logit(rate)], np.full(sample.number, 0.3), np.zeros(before.shape[1])])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[0] + np.bincount(r, x * w[1 + f], number) + before @ w[1 + sample.number :]
        e = (sigmoid(z) - target) / max(1, number)
        g = np.concatenate([[e.sum()], np.bincount(f, x * e[r], sample.number), e @ before])
        g[1:] += 1e-5 * w[1:]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return Link(float(w[0]), w[1 : 1 + sample.number] * scale, w[1 + sample.number :])


def apply_link(link: Link, sample: Sample, earlier: np.ndarray) -> np.ndarray:
    z = link.bias + np.bincount(sample.row, link.weights[sample.feature], len(sample.fold))
    return sigmoid(z + logit(earlier) @ link.earlier)


def fit_chain(sample: Sample) -> list[Link]:
    """A link for each category. A later link is trained on what the earlier ones say of rows
    that they have not seen: each fold is predicted by a model of the others."""
    chain, oof = [], np.empty((len(sample.fold), 0))
    everything = np.ones(len(sample.fold), bool)
    for category in range(sample.labels.shape[1]):
        said = np.zeros(len(sample.fold))
        for fold in range(FOLDS):
            out = sample.fold == fold
            said[out] = apply_link(fit(sample, ~out, category, oof), sample, oof)[out]
        chain.append(fit(sample, everything, category, oof))
        oof = np.column_stack([oof, said])
    return chain


class Chain(NamedTuple):
    known: np.ndarray  # screened feature hashes, ascending
    links: list[tuple]


def learn_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_column: str, text_column: str) -> tuple:
    """(feature hashes, links) fitted on a bounded sample of the labelled rows.

    Screening counts each feature by fold and category over the sample, in Spark; the driver
    gets the FEATURES with most evidence, and the sample as indices of these.
    """
    names = list(categories)
    marked = (
        labels.where(F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).cast("long").alias("id"))
        .agg(*[F.max(c.cast("int")).alias(f"y{k}") for k, c in enumerate(categories.values())])
        .dropna()
    )
    # at most SAMPLE rows of a few numbers, so a broadcast is bounded
    chosen = bounded_sample(saved(marked), "id", SAMPLE)
    ys = [f"y{k}" for k in range(len(names))]
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    fold = F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    joined = texts.join(F.broadcast(chosen), "id").select("id", fold, *ys, "text")
    kinds = "id long, fold int, " + ", ".join(f"{y} int" for y in ys)
    rows = saved(joined.mapInArrow(feature_rows, f"{kinds}, features array<long>"))
    groups = [(f"n{k}", F.col("fold") == k) for k in range(FOLDS)]
    sums = [F.sum(c.cast("int")).alias(n) for n, c in groups]
    sums += [F.sum(F.when(c, F.col(y)).otherwise(0)).alias(f"{n}{y}") for n, c in groups for y in ys]
    tops = rows.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(y), F.lit(0)).alias(y) for y in ys]).first()
    counts = rows.select("fold", *ys, F.explode("features").alias("f")).groupBy("f").agg(*sums)
    n = sum(F.col(name) for name, _ in groups)
    # how far the positives among the rows with the feature are from their share, in squares
    # of the spread; the exact evidence is taken fold by fold when a model is fitted
    far = []
    for y in ys:
        share = min(max(tops[y] / max(1, tops["rows"]), 1e-6), 1 - 1e-6)
        got = sum(F.col(f"{name}{y}") for name, _ in groups)
        far.append(F.pow(F.greatest(got - n * share, F.lit(0.0)), 2) / (n * share * (1 - share)))
    screened = (
        counts.where(n >= 3)
        .select("f", F.greatest(*far, F.lit(0.0)).alias("far"))
        .where(F.col("far") >= EVIDENCE)
        .orderBy(F.desc("far"), "f")
        .limit(FEATURES)
        .toPandas()
    )
    known = np.sort(screened["f"].to_numpy(np.int64))

    def indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, places(batch.column(batch.num_columns - 1), known)], names=batch.schema.names)

    pdf = rows.mapInArrow(indexed, f"{kinds}, features array<long>").toPandas().sort_values("id", ignore_index=True)
    sizes = np.array([len(f) for f in pdf["features"]], np.int64)
    flat = np.concatenate(list(pdf["features"])).astype(np.int32) if sizes.sum() else np.empty(0, np.int32)
    sample = Sample(
        np.repeat(np.arange(len(pdf), dtype=np.int32), sizes), flat, pdf["fold"].to_numpy(), pdf[ys].to_numpy(float).reshape(-1, len(ys)), len(known)
    )
    return known, [tuple(link) for link in fit_chain(sample)]


class Scorer:
    def __init__(self, known: np.ndarray, links: list[tuple]):
        self.at = {int(h): k for k, h in enumerate(known)}
        self.links, self.memory = [Link(*link) for link in links], {}

    def indices(self, word: str) -> tuple[int, ...]:
        found = self.memory.get(word)
        if found is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            found = self.memory[word] = tuple(self.at[f] for f in features_of_word(word) if f in self.at)
        return found

    def probabilities(self, text: bytes | None) -> list[float]:
        at = list({k for word in distinct_words(text) for k in self.indices(word)})
        said: list[float] = []
        for link in self.links:
            z = link.bias + link.weights[at].sum() + float(logit(np.array(said)) @ link.earlier)
            said.append(float(sigmoid(z)))
        return said


def categories_of_labels() -> dict[str, Column]:
    """What the labels mark, in the chain's order: rubbish first, toxicity after it."""
    return {"p_low_quality": 1 - F.col("quality"), "p_toxic": F.col("toxic")}


def predict_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, a probability for each category, toxic) of each row.

    The chain predicts category after category; each linear model sees the features of the
    text and the probabilities of the categories before it. `toxic` is p_toxic >= least.
    Null and empty texts have no features and get the models' bias; equal texts get equal
    answers; with no labels at all every probability is that of an empty model.
    """
    categories = categories_of_labels()
    sent = docs.sparkSession.sparkContext.broadcast(learn_chain(docs, labels, categories, id_column, text_column))
    names = list(categories)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for piece in (p for batch in batches for p in pieces(batch, 1)):
            said = np.array([scorer.probabilities(t) for t in texts_of(piece.column(1))]).reshape(-1, len(names))
            toxic = pa.array(said[:, -1] >= least)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), *[pa.array(said[:, k]) for k in range(len(names))], toxic], names=["doc_id", *names, "toxic"]
            )

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")


def without_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs` that the chain does not find toxic, all columns as they are."""
    model = learn_chain(docs, labels, categories_of_labels(), id_column, text_column)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for piece in (p for batch in batches for p in pieces(batch, at)):
            clean = [scorer.probabilities(t)[-1] < least for t in texts_of(piece.column(at))]
            yield piece.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels."""
    return predict_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
