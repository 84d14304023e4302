"""Text quality by positive-unlabelled learning with a non-negative risk."""

from collections.abc import Callable, Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from siteweave.llm.common import bounded_sample, crc_part, saved, table, texts_of

#: Different trusted positives that the model is fitted on at the most.
POSITIVES = 20_000
#: Unlabelled rows that the first steps look at, and the steps over all of them that follow.
START = 20_000
WHOLE_STEPS = 16
#: Each measure is cut into so many ranges of about equal counts, and each range gets a weight.
RANGES = 24

MEASURES = (
    "words", "bytes_per_word", "distinct_words", "distinct_pairs", "repeats", "upper", "digits", "signs",
    "tails", "pipes", "exclamations", "word_endings", "line_words", "distinct_lines", "ends_sentence", "spread",
)

_CLASS = np.zeros(256, np.int64)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = 3


def measures_of(text: bytes | None) -> list[float]:
    """The text in numbers that depend on its form alone: MEASURES in order; 0 throughout
    for a text without words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(MEASURES)
    n = len(words)
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=4) / len(text)
    lower = [w.lower() for w in words]
    lines = [line for line in text.split(b"\n") if line.strip()]
    # signs at the end of a word, but for one full stop or comma
    tails = sum(w[-1:] in b"!#$%&*|~^" or w[-2:-1] in b"!#$%&*.," for w in words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(n)),
        len(text) / n,
        len(set(lower)) / n,
        len(set(zip(lower, lower[1:]))) / max(1, n - 1),
        sum(map(eq, lower, lower[1:])) / max(1, n - 1),
        float(kinds[1]),
        float(kinds[2]),
        float(kinds[3]),
        tails / n,
        text.count(b"|") / n,
        text.count(b"!") / n,
        (text.count(b".") + text.count(b",")) / n,
        n / len(lines),
        len(set(lines)) / len(lines),
        float(text.rstrip()[-1:] in b".!?"),
        float(lengths.std()),
    ]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def design(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """For each row the index of its range in each measure, over all measures."""
    starts = np.cumsum([0] + [len(c) + 1 for c in cuts])
    return np.stack([starts[k] + np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)], axis=1)


def adam(gradient, w: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam with a rate that falls to nothing."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (1 - (step - 1) / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w


def push(at: np.ndarray, e: np.ndarray, size: int) -> np.ndarray:
    """The gradient of weights (bias last) for errors e of rows with ranges `at`."""
    g = np.bincount(at.ravel(), np.repeat(e, at.shape[1]), size)
    g[-1] = e.sum()
    return g


def above(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the scores reach each border."""
    return len(scores) - np.searchsorted(np.sort(scores), at, "left")


def prior_of(positive: np.ndarray, counted: Callable[[np.ndarray], tuple[np.ndarray, int]]) -> float:
    """The share of positives among the unlabelled, from scores of rows not trained on.
    `counted` tells how many unlabelled scores reach each border, and how many there are.

    Above any score, the unlabelled hold at least prior times the positives' part, so the
    ratio of the two parts bounds the prior. The estimate is the ratio at the score where
    it is least with the room that chance needs.
    """
    if not len(positive):
        return 0.5
    at = np.quantile(positive, np.linspace(0.0, 0.9, 91))
    reached, n = counted(at)
    if not n:
        return 0.5
    p, u = above(positive, at) / len(positive), reached / n
    room = np.sqrt(np.maximum(u * (1 - u), 1e-9) / n) + np.sqrt(np.maximum(p * (1 - p), 1e-9) / len(positive))
    best = np.argmin((u + room) / np.maximum(p, 1e-9))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.02, 0.98))


class Unlabelled:
    """All unlabelled rows as (half, ranges), which Spark adds up over; a start is looked for
    on a sample of them."""

    def __init__(self, rows: DataFrame, starts: np.ndarray, size: int, sample: tuple[np.ndarray, np.ndarray]):
        self.rows, self.starts, self.size, self.sample = rows, starts, size, sample

    def summed(self, of: Callable[[np.ndarray], np.ndarray], half: int | None) -> np.ndarray:
        """The sum of `of(ranges)` over all rows, or over one half of them. A task sends one
        vector."""
        starts = self.starts

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                at = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, len(MEASURES)) + starts
                part = of(at)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

        rows = self.rows if half is None else self.rows.where(F.col("half") == half)
        parts = [r["v"] for r in rows.select("ranges").mapInArrow(run, "v array<double>").collect()]
        return np.sum(parts, axis=0) if parts else np.zeros_like(of(np.zeros((0, len(MEASURES)), np.int64)))


def score_of(at: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w[at].sum(axis=1) + w[-1]


def fit(
    positive: np.ndarray, halves: np.ndarray, unlabelled: Unlabelled, cuts: list[np.ndarray]
) -> tuple[list[np.ndarray], np.ndarray, float]:
    """(cuts, weights with the bias last, prior) of the non-negative PU risk.

    With prior q, loss l and scores f, the risk is q E+[l(f)] + max(0, E_u[l(-f)] - q E+[l(-f)]).
    Where the second part, the risk on negatives, falls under zero, the step goes the
    other way and takes the overfitting back. The prior comes first, from a classifier of
    positives against unlabelled that is scored on the half it did not see. Each fit starts
    from one on the sample and goes on with steps over all unlabelled rows.
    """
    size = unlabelled.size
    p = design(positive, cuts)
    sample, sample_halves = unlabelled.sample
    mean = lambda a: 1.0 / max(1, len(a))

    def unlabelled_part(w: np.ndarray, half: int | None, whole: bool) -> tuple[np.ndarray, float, float]:
        """Means over the unlabelled rows: of the gradient, and of their loss as negatives;
        and their number."""

        def of(at: np.ndarray) -> np.ndarray:
            f = score_of(at, w)
            return np.concatenate([push(at, sigmoid(f), size), [np.logaddexp(0, f).sum(), len(at)]])

        rows = sample if half is None else sample[sample_halves == half]
        total = unlabelled.summed(of, half) if whole else of(rows)
        n = max(1.0, total[-1])
        return total[:-2] / n, total[-2] / n, total[-1]

    def descended(gradient, first: int, first_rate: float, last_rate: float) -> np.ndarray:
        w = adam(lambda w: gradient(w, False), np.zeros(size), first, first_rate)
        return adam(lambda w: gradient(w, True), w, WHOLE_STEPS, last_rate)

    priors = []
    for half in (0, 1):
        own = p[halves == half]

        def against(w: np.ndarray, whole: bool) -> np.ndarray:
            rise, _, _ = unlabelled_part(w, half, whole)
            return push(own, -0.5 * mean(own) * sigmoid(-score_of(own, w)), size) + 0.5 * rise + 1e-3 * w

        w = descended(against, 150, 0.1, 0.02)

        def counted(at: np.ndarray) -> tuple[np.ndarray, int]:
            of = lambda rows: np.append(above(score_of(rows, w), at), len(rows)).astype(float)
            total = unlabelled.summed(of, 1 - half)
            return total[:-1], int(total[-1])

        priors.append(prior_of(score_of(p[halves != half], w), counted))
    prior = float(np.mean(priors))

    def gradient(w: np.ndarray, whole: bool) -> np.ndarray:
        rise, loss, n = unlabelled_part(w, None, whole)
        fp = score_of(p, w)
        negative = loss - prior * np.logaddexp(0, fp).sum() * mean(p)
        rise = rise - push(p, prior * mean(p) * sigmoid(fp), size)
        fall = push(p, -prior * mean(p) * sigmoid(-fp), size)
        return (fall + rise if negative >= 0 else -rise) + 1e-4 * w

    return cuts, descended(gradient, 800, 0.3, 0.02), prior


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, x) of every row, written once for the fit and the prediction."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures_of(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return saved(narrow.mapInArrow(run, "doc_id long, x array<double>"))


def matrix_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(MEASURES))


def borders(rows: DataFrame) -> list[np.ndarray]:
    """Inner borders of each measure's ranges: quantiles over all rows, each once."""
    inner = np.linspace(0, 1, RANGES + 1)[1:-1].tolist()
    found = rows.agg(*[F.percentile_approx(F.col("x")[k], inner, 10_000).alias(f"c{k}") for k in range(len(MEASURES))]).first()
    return [np.unique(found[k]) if found[k] else np.empty(0) for k in range(len(MEASURES))]


def in_ranges(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(half, ranges): a byte a measure, and a half that equal texts share."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column(0))
            at = np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)], axis=1).astype(np.uint8)
            halves = [half_of(row) for row in x]
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves, pa.int32()), pa.array([row.tobytes() for row in at], pa.binary())], names=["half", "ranges"]
            )

    return rows.select("x").mapInArrow(run, "half int, ranges binary")


def half_of(x: np.ndarray) -> int:
    return xxh3_64_intdigest(x.tobytes()) & 1


def learn_from(rows: DataFrame, positives: DataFrame, id_column: str = "doc_id"):
    """The model from the measures of all rows and the ids of trusted positives.

    Of the trusted texts at most POSITIVES different ones, by hash, are fitted on. Borders,
    prior and the risk on unlabelled rows come from all rows; START of them, by hash, only
    give the first steps their direction.
    """
    chosen = positives.select(F.col(id_column).cast("long").alias("doc_id")).dropna().distinct()
    trusted = saved(rows.join(chosen, "doc_id", "left_semi").select("doc_id", F.col("x").alias("x")).distinct())
    trusted = bounded_sample(trusted.withColumn("key", F.xxhash64("doc_id", "x")), "key", POSITIVES)
    x = np.array(trusted.orderBy("key").toPandas()["x"].tolist(), float).reshape(-1, len(MEASURES))
    halves = np.fromiter(map(half_of, x), int, len(x))
    cuts = borders(rows)
    starts = np.cumsum([0] + [len(c) + 1 for c in cuts])[:-1]
    binned = saved(in_ranges(rows, cuts))
    different = binned.groupBy("half", "ranges").agg(F.count("*").alias("copies"))
    some = bounded_sample(saved(different.withColumn("key", F.xxhash64("ranges"))), "key", START).orderBy("key").toPandas()
    raw = np.frombuffer(b"".join(some["ranges"]), np.uint8).reshape(-1, len(MEASURES)) + starts
    size = sum(len(c) + 1 for c in cuts) + 1
    return fit(x, halves, Unlabelled(binned, starts, size, (raw, some["half"].to_numpy())), cuts)


def predict_from(rows: DataFrame, model) -> DataFrame:
    """(doc_id, score) of rows of measures."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, w, _ = sent.value
        for batch in batches:
            x = matrix_of(batch.column(1))
            score = sigmoid(score_of(design(x, cuts), w)) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def learn(docs: DataFrame, positives: DataFrame, id_column: str = "doc_id", text_column: str = "text"):
    """The model from all texts, as unlabelled ones, and the ids of trusted positives."""
    return learn_from(measures(docs, id_column, text_column), positives, id_column)


def predict(docs: DataFrame, model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, score) of each row: the probability that the text is one like the trusted
    ones. Null and blank texts share one score, and so do equal texts."""
    return predict_from(measures(docs, id_column, text_column), model)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents. Trusted positives are rows marked 1 whose id does not fall in
    the held-out fifth; unlabelled texts are those of all documents."""
    rows, labels = measures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_part("doc_id", 5) == 0, F.lit(False))
    model = learn_from(rows, labels.where("quality = 1").where(~held_out))
    return predict_from(rows, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
