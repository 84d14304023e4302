"""Language, toxicity and quality: held-out accuracy, and the hard rows."""

from collections import Counter

import numpy as np
import pytest
from helpers import ALL, empty_documents, hard_documents, ids

from siteweave.llm import language_id, quality, toxicity
from siteweave.llm.common import crc_part
from siteweave.llm.language_id import SIZES, Model, Scorer, grams_of, op2_language_id
from siteweave.llm.quality import op4_quality
from siteweave.llm.toxicity import op3_toxicity, without_toxic

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def truth(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    return docs.join(spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id"))


def test_language_of_held_out_documents(spark, truth):
    got = op2_language_id(spark, SF).toPandas().set_index("doc_id").join(truth)
    held = got[got.held_out]
    assert len(got) == len(truth) and 0.3 < len(held) / len(got) < 0.37
    assert (held.lang == held.lang_pred).mean() > 0.99
    assert got.score.between(0, 1).all()


def test_backoff_goes_from_words_to_shorter_n_grams():
    grams = [("x", g, 5) for s in SIZES for g in grams_of("hello", s)] + [("y", g, 5) for s in SIZES for g in grams_of("wurst", s)]
    scorer = Scorer(Model(["x", "y"], [("x", "gift", 1), ("y", "gift", 9)], grams, {"x": 10, "y": 10}))
    assert scorer.predict(b"gift")[0] == "y"  # known: by frequency
    assert scorer.predict(b"hellx")[0] == "x"  # <hel, hell
    assert scorer.predict(b"qqst")[0] == "y"  # st>
    assert scorer.predict(b"qtq")[0] == "y" and scorer.predict(b"qeq")[0] == "x"  # one letter
    assert scorer.predict(b"12 !")[0] == "und" and scorer.predict(None) == ("und", 0.0)


def test_toxic_documents_are_found_and_clean_ones_left(spark, truth):
    got = op3_toxicity(spark, SF).toPandas().set_index("doc_id")
    both = got.join(truth[["toxic"]], rsuffix="_true").dropna()
    marked = both[both.toxic_true == 1]
    assert marked.toxic.mean() > 0.93
    assert both[both.toxic_true == 0].toxic.mean() < 0.002


def test_toxic_documents_that_were_not_learnt_from(spark):
    """A quarter of the labels held out."""
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    held = crc_part("doc_id", 4) == 0
    got = toxicity.predict_toxicity(docs, labels.where(~held)).select("doc_id", "toxic").toPandas().set_index("doc_id")
    true = labels.where(held).where("toxic is not null").toPandas().set_index("doc_id").join(got, rsuffix="_found")
    found = true[true.toxic == 1].toxic_found
    others = true[true.toxic == 0].toxic_found
    print("held out:", int(found.sum()), "of", len(found), "found;", int(others.sum()), "of", len(others), "others marked")
    assert found.mean() > 0.85 and others.mean() < 0.01


def test_chain_feeds_earlier_probabilities():
    """The second category depends on the first alone; no feature shows it."""
    rng = np.random.default_rng(1)
    n = 3000
    f = rng.random((n, 3)) < 0.5
    y0 = f[:, 0] ^ (rng.random(n) < 0.02)
    y1 = y0 ^ (rng.random(n) < 0.05)
    row, feature = np.nonzero(f)
    sample = toxicity.Sample(row, feature, rng.integers(0, 3, n), np.stack([y0, y1], axis=1).astype(float), 3)
    chain = toxicity.fit_chain(sample)
    assert len(chain[0].earlier) == 0 and chain[1].earlier[0] > 0.2


def test_quality_of_held_out_documents(spark, truth):
    got = op4_quality(spark, SF).toPandas().set_index("doc_id").join(truth)
    held = got[got.held_out & got.quality.notna()]
    assert len(got) == len(truth) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    assert (held.predicted == held.quality).mean() > 0.93
    rank = held.score.rank().to_numpy()
    good = (held.quality == 1).to_numpy()
    n1, n0 = good.sum(), (~good).sum()
    assert (rank[good].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.99


def test_risk_of_all_rows_is_what_a_loop_adds_up(spark):
    """The sums over unlabelled rows cover every row, in both halves, at any partitioning."""
    rows = quality.measures(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    x = np.array([r.x for r in rows.select("x").collect()])
    cuts = quality.borders(rows)
    at = quality.design(x, cuts)
    size = sum(len(c) + 1 for c in cuts) + 1
    starts = np.cumsum([0] + [len(c) + 1 for c in cuts])[:-1]
    every = quality.Unlabelled(quality.in_ranges(rows, cuts).repartition(5), starts, size, (None, None))
    w = np.random.default_rng(2).normal(size=size)
    of = lambda a: np.append(quality.push(a, quality.score_of(a, w), size), len(a))
    assert np.allclose(every.summed(of, None), of(at))
    halves = np.array([quality.half_of(row) for row in x])
    for half in (0, 1):
        assert np.allclose(every.summed(of, half), of(at[halves == half]))
    # quantiles of all rows: the ranges of a measure without ties hold about equal counts
    k = quality.MEASURES.index("bytes_per_word")
    sizes = np.bincount(np.searchsorted(cuts[k], x[:, k], "right"))
    assert sizes.max() < 2 * len(x) / quality.RANGES


def test_quality_does_not_hang_on_the_first_sample(spark, truth, monkeypatch):
    monkeypatch.setattr(quality, "START", 500)
    got = op4_quality(spark, SF).toPandas().set_index("doc_id").join(truth)
    held = got[got.held_out & got.quality.notna()]
    assert (held.predicted == held.quality).mean() > 0.93


def test_prior_of_mixed_scores():
    rng = np.random.default_rng(0)
    p, n = rng.normal(3, 1, 8000), rng.normal(-3, 1, 8000)
    for share in (0.2, 0.5, 0.8):
        k = int(8000 * share)
        u = np.concatenate([p[-k:], n[: 8000 - k]])
        counted = lambda at, u=u: (quality.above(u, at), len(u))
        assert abs(quality.prior_of(p[:4000], counted) - share) < 0.05


def test_hard_rows(spark):
    docs = hard_documents(spark)
    empty = empty_documents(spark)
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 1), (2, 0, None), (3, None, 1), (4, 1, 1), (7, 1, 0), (None, 1, 1), (99, 0, 1)],
        "doc_id long, quality int, toxic int",
    )
    for marks in (labels, labels.limit(0)):
        got = toxicity.predict_toxicity(docs, marks)
        assert ids(got) == ALL
        assert toxicity.predict_toxicity(empty, marks).count() == 0
        kept = without_toxic(docs, marks, least=2.0)
        assert kept.columns == docs.columns and ids(kept) == ALL
        assert without_toxic(empty, marks).count() == 0
    model = language_id.learn(docs)
    got = language_id.predict(docs, model)
    assert ids(got) == ALL
    by = {r.doc_id: r.lang_pred for r in got.where("doc_id is not null").collect()}
    assert by[4] == by[5] == by[6] == by[10] == "und" and by[8] == by[9] == "de" and by[7] == "en"
    assert {r.lang_pred for r in language_id.predict(docs, language_id.learn(empty)).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0
    for trusted in (labels.where("quality = 1"), labels.limit(0)):
        model = quality.learn(docs, trusted)
        got = quality.predict(docs, model)
        assert ids(got) == ALL
        by = {r.doc_id: r.score for r in got.where("doc_id is not null").collect()}
        assert by[4] == by[5] == by[6] and by[8] == by[9]
        assert quality.predict(empty, model).count() == 0
    assert ids(quality.predict(docs, quality.learn(empty, labels))) == ALL


def test_language_model_leaves_no_entry_out(spark, monkeypatch):
    """However little is broadcast, each row gets what the method on whole tables in memory says."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learning, rest = docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 = 0")
    words, totals, grams = {}, Counter(), Counter()
    for r in learning.where("lang is not null and text is not null").collect():
        words.setdefault(r.lang, Counter()).update(language_id.letter_words(r.text.encode()))
    for lang, own in words.items():
        totals[lang] = own.total()
        grams.update((lang, g) for w in own for size in SIZES for g in grams_of(w, size))
    flat = [(lang, w, n) for lang, own in words.items() for w, n in own.items()]
    scorer = Scorer(Model(sorted(totals), flat, [(*k, n) for k, n in grams.items()], totals))
    want = {r.doc_id: scorer.predict(None if r.text is None else r.text.encode()) for r in docs.collect()}
    for most in (0, 4_000, 10**9):
        monkeypatch.setattr(language_id, "BROADCAST", most)
        for part in (learning, rest):
            got = language_id.predict(part, language_id.learn(learning)).collect()
            assert len(got) == part.count()
            for r in got:
                assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-3)


def test_rare_word_of_a_large_language_counts(spark, monkeypatch):
    """A word seen in both languages, once each, decides nothing; one seen in the large language
    alone decides for it, though that language has more words than are broadcast."""
    large = " ".join(f"aa{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(600))
    rows = [(1, f"{large} {large} bank zyx", "en"), (2, "bank wurst " * 300, "de")]
    learning = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "BROADCAST", 8)
    model = language_id.learn(learning)
    n = {r.entry: r.n for r in model.words.select("entry", "n").collect()}
    assert len(n) == 603 and n["zyx"] == 1 and n["bank"] == 301
    asked = spark.createDataFrame([(5, "zyx"), (6, "wurst"), (7, "123")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(asked, model).collect()} == {5: "en", 6: "de", 7: "und"}
