"""Language identification: known words first, then ever shorter character n-grams."""

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm.common import crc_part, saved, table, texts_of

LETTERS = re.compile(r"[^\W\d_]+")
#: n-grams of a word between boundary marks, longest first.
SIZES = (4, 3, 2, 1)
#: Most numbers (words by languages) that are broadcast. These are the commonest words, which
#: texts meet without a join; all others are joined, so no result depends on it.
BROADCAST = 800_000
#: Scores are whole numbers of this part, so that sums don't depend on their order.
UNIT = 1 << 24
#: Entries of a task's counter before it is passed on.
HELD = 300_000
#: Unknown words whose scores a task remembers.
REMEMBERED = 200_000
UNKNOWN = "und"


def letter_words(text: bytes | None) -> list[str]:
    return LETTERS.findall(text.decode("utf-8", "replace").lower()) if text else []


def grams_of(word: str, size: int) -> list[str]:
    """The n-grams of a word with its boundaries; single characters without them."""
    marked = word if size == 1 else f"<{word}>"
    return [marked[k : k + size] for k in range(len(marked) - size + 1)]


def emitted(counts: dict[str, Counter], label: str, entry: str) -> Iterator[pa.RecordBatch]:
    for name, counter in counts.items():
        keys = list(counter)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.string()), pa.array(list(counter.values()), pa.int64())],
            names=[label, entry, "n"],
        )


def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            counts.setdefault(lang, Counter()).update(letter_words(text))
            if sum(map(len, counts.values())) > HELD:
                yield from emitted(counts, "lang", "entry")
                counts = {}
    yield from emitted(counts, "lang", "entry")


def count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counter = counts.setdefault(lang, Counter())
            for size in SIZES:
                counter.update(grams_of(word, size))
        if sum(map(len, counts.values())) > HELD:
            yield from emitted(counts, "lang", "entry")
            counts = {}
    yield from emitted(counts, "lang", "entry")


class Model:
    """Log frequencies by language of words and of n-grams: one row an entry. With Scorer it is
    the method on tables in memory; `predict` does the same by joins."""

    def __init__(self, langs: list[str], words: list[tuple], grams: list[tuple], totals: dict[str, int]):
        self.langs = langs
        at = {lang: k for k, lang in enumerate(langs)}
        sums = [np.array([totals[lang] for lang in langs], float)]
        self.words, self.word_logs = self._table(words, at, sums[0])
        # n-grams compare with those of their own size
        self.grams: list[tuple[dict[str, int], np.ndarray]] = []
        for size in SIZES:
            own = [r for r in grams if len(r[1]) == size]
            total = np.zeros(len(langs))
            for lang, _, n in own:
                total[at[lang]] += n
            self.grams.append(self._table(own, at, total))

    @staticmethod
    def _table(rows: list[tuple], at: dict[str, int], total: np.ndarray):
        index: dict[str, int] = {}
        for _, entry, _ in rows:
            index.setdefault(entry, len(index))
        counts = np.zeros((len(index), len(at)), np.float32)
        for lang, entry, n in rows:
            counts[index[entry], at[lang]] = n
        # half a sighting for what a language has not shown
        return index, np.log((counts + 0.5) / (total + 0.5 * (len(index) + 1))).astype(np.float32)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memory = model, {}

    def unseen(self, word: str) -> np.ndarray | None:
        """The mean over the word's known n-grams of the longest size that has any."""
        for size, (index, logs) in zip(SIZES, self.model.grams, strict=True):
            at = [k for g in grams_of(word, size) if (k := index.get(g)) is not None]
            if at:
                return logs[at].mean(axis=0)
        return None

    def predict(self, text: bytes | None) -> tuple[str, float]:
        words = letter_words(text)
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        at = np.fromiter((self.model.words.get(w, -1) for w in words), np.int64, len(words))
        total = self.model.word_logs[at[at >= 0]].sum(axis=0, dtype=np.float64)
        for k in np.flatnonzero(at < 0):
            word = words[k]
            if word not in self.memory:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[word] = self.unseen(word)
            if self.memory[word] is not None:
                total = total + self.memory[word]
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.model.langs[best], float(odds[best] / odds.sum())


class Learnt(NamedTuple):
    """All entries that the learning rows hold, as (entry, scores); scores in the languages' order."""

    langs: list[str]
    words: DataFrame  # and n, the count over all languages
    grams: DataFrame


def by_entry(counts: DataFrame, langs: list[str]) -> DataFrame:
    """One row an entry: what each language counts of it, 0 where it has none."""
    each = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)) for lang in langs]
    return saved(counts.groupBy("entry").agg(F.sum("n").alias("n"), F.array(*each).alias("counts")))


def scores_of(langs: list[str], totals: list[int], entries: int) -> Column:
    """Log frequencies of the counts, half a sighting for what a language has not shown."""
    log = lambda k: F.log((F.col("counts")[k] + 0.5) / (totals[k] + 0.5 * (entries + 1)))
    return F.array(*[F.round(log(k) * UNIT).cast("long") for k in range(len(langs))])


def learn(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> Learnt:
    """The scores of all words and n-grams of the rows that have a language.

    Words are counted over all rows, in the tasks first; n-grams over the distinct words,
    each once, since a word never seen is like a type, not like a token. Nothing is left out.
    """
    labelled = docs.where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    kind = "lang string, entry string, n long"
    counts = saved(
        labelled.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text"))
        .mapInArrow(count_words, kind)
        .groupBy("lang", "entry")
        .agg(F.sum("n").alias("n"))
    )
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return Learnt(langs, counts, counts)
    words = by_entry(counts, langs)
    grams = by_entry(counts.select("lang", "entry").mapInArrow(count_grams, kind), langs)
    size = F.length("entry")
    sums = [F.sum(F.col("counts")[k]) for k in range(len(langs))]
    of_size = {r["size"]: r for r in grams.groupBy(size.alias("size")).agg(F.count("*").alias("entries"), F.array(*sums).alias("totals")).collect()}
    gram_scores = F.coalesce(*[F.when(size == n, scores_of(langs, r["totals"], r["entries"])) for n, r in of_size.items()])
    word_scores = scores_of(langs, [totals[lang] for lang in langs], words.count())
    return Learnt(langs, words.select("entry", "n", word_scores.alias("scores")), grams.select("entry", gram_scores.alias("scores")))


def commonest(words: DataFrame, most: int) -> DataFrame:
    """The words above the count at which more than `most` would be taken. The driver gets a
    histogram of the counts, which has few bars however many words there are."""
    taken, least = 0, None
    for n, entries in sorted(words.groupBy("n").count().collect(), reverse=True):
        taken += entries
        if taken > most:
            break
        least = n
    return words.where("false" if least is None else F.col("n") >= least)


def scores_of_unseen(words: DataFrame, grams: DataFrame, langs: list[str]) -> DataFrame:
    """(entry, scores) of words the model lacks: the mean over the known n-grams of the longest
    size that has any. Words without one are not returned."""
    grams = grams.withColumnsRenamed({"entry": "gram", "scores": "parts"})
    means = F.array(*[F.round(F.avg(F.col("parts")[k])).cast("long") for k in range(len(langs))])
    found = []
    for size in SIZES:
        marked = F.col("entry") if size == 1 else F.concat(F.lit("<"), "entry", F.lit(">"))
        starts = F.sequence(F.lit(1), F.length(marked) - (size - 1))
        long = words.where(F.length(marked) >= size).select("entry", marked.alias("marked"), F.explode(starts).alias("start"))
        pieces = long.select("entry", F.substring("marked", F.col("start"), F.lit(size)).alias("gram"))
        found.append(saved(pieces.join(grams, "gram").groupBy("entry").agg(means.alias("scores"))))
        words = saved(words.join(found[-1], "entry", "left_anti"))
        if words.isEmpty():
            break
    out = found[0]
    for frame in found[1:]:
        out = out.union(frame)
    return out


def predict(docs: DataFrame, model: Learnt, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row.

    The score of a language is the sum over the text's words of log frequencies: of the word
    where the learning rows hold it, else the mean over its known n-grams of the longest size
    that has any. `score` is the winner's share of the likelihood. Null texts and texts without
    a letter are 'und' with score 0; ties go to the first language by name.

    The commonest words are broadcast and added up where the text is read. Of the others a
    text's distinct ones meet the model in joins, each word once, and are summed per row.
    """
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    langs = model.langs
    if not langs:
        return narrow.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    top = commonest(model.words, BROADCAST // len(langs))
    pdf = top.select("entry", *[F.col("scores")[k].alias(f"s{k}") for k in range(len(langs))]).toPandas()
    sent = docs.sparkSession.sparkContext.broadcast((list(pdf["entry"]), pdf.drop(columns="entry").to_numpy(np.int64)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, scores = sent.value
        index = {entry: k for k, entry in enumerate(entries)}
        for batch in batches:
            letters, sums, words, times = [], [], [], []
            for text in texts_of(batch.column(1)):
                counts = Counter(letter_words(text))
                at = np.fromiter((index.get(w, -1) for w in counts), np.int64, len(counts))
                n = np.fromiter(counts.values(), np.int64, len(counts))
                rare = {w: c for w, c, k in zip(counts, counts.values(), at.tolist(), strict=True) if k < 0}
                letters.append(bool(counts))
                sums.append(n[at >= 0] @ scores[at[at >= 0]])
                words.append(list(rare))
                times.append(list(rare.values()))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(letters, pa.bool_()), pa.array(sums, longs), pa.array(words, pa.list_(pa.string())), pa.array(times, longs)],
                names=["doc_id", "letters", "sums", "words", "times"],
            )

    kind = "doc_id long, letters boolean, sums array<long>, words array<string>, times array<long>"
    rows = saved(narrow.mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.inline(F.arrays_zip("words", "times"))).withColumnRenamed("words", "entry")
    asked = saved(rare.select("entry").distinct())
    seen = model.words.select("entry", "scores")
    unseen = scores_of_unseen(saved(asked.join(seen, "entry", "left_anti")), model.grams, langs)
    scores = saved(asked.join(seen, "entry").union(unseen))
    more = F.array(*[F.sum(F.col("times") * F.col("scores")[k]) for k in range(len(langs))])
    joined = rare.join(scores, "entry").groupBy("row").agg(more.alias("more"))
    total = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b))
    best = F.array_max("total")
    odds = F.transform("total", lambda x: F.exp((x - best) / UNIT))
    return (
        rows.select("row", "doc_id", "letters", "sums")
        .join(joined, "row", "left")
        .select("doc_id", "letters", total.alias("total"))
        .select(
            "doc_id",
            F.when(F.col("letters"), F.array(*map(F.lit, langs))[F.array_position("total", best) - 1]).otherwise(UNKNOWN).alias("lang_pred"),
            F.when(F.col("letters"), 1 / F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0).alias("score"),
        )
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from two thirds of them. No held-out row is read
    for learning, and a prediction gets the text alone."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_part("doc_id", 3) == 1, F.lit(False))
    model = learn(docs.where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
