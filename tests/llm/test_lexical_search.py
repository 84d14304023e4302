import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import empty_documents, hard_documents

from siteweave.llm import lexical_search as module
from siteweave.llm.lexical_search import Segment, ranked, search_segment, terms_of, units_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def test_terms():
    text = "Ab9 c-d_e\tÄÖ ß\x1fx y {Z}~q 北京。\x85!"
    assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)


def brute(docs, items, k=10):
    counts = [(d, Counter(plain_terms(t))) for d, t in docs]
    n_docs = sum(1 for _, c in counts if c)
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, own in terms.items():
        scores = []
        for doc, c in counts:
            n = sum(c.values())
            score = 0
            for t in own & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 10 + (90 * n * n_docs) // length
                score += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        for rank, (score, _, _, doc) in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1):
            out.append((item, rank, doc, -score))
    return sorted(out, key=repr)


def corpus(seed, docs, items):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    text = lambda most: " ".join(word() for _ in range(rng.randrange(most)))
    left = [(k, text(60)) for k in range(docs)] + [(3, "W1 w1 w2"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (docs, None)]
    left += [(docs + 1 + k, "w5 w6 w7") for k in range(15)]  # ties
    return left, [(k, text(30)) for k in range(items)] + [(0, "w9 w8"), (None, "w1 w4"), (items, None), (items + 1, "w5 w7")]


@pytest.mark.parametrize("segment, block", [(8192, 4 << 20), (50, 4 << 20), (64, 2_000)])
def test_equals_brute_force(spark, monkeypatch, segment, block):
    monkeypatch.setattr(module, "SEGMENT_DOCS", segment)
    monkeypatch.setattr(module, "BLOCK_BYTES", block)
    left, right = corpus(4, 700, 30)
    docs = spark.createDataFrame(left, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(right, "item_id long, text string")
    got = sorted((tuple(r) for r in ranked(docs, items).collect()), key=repr)
    assert got == brute(left, right)


def test_pair_bounds_look_at_fewer_postings():
    """Two terms that never meet: no document reaches the sum of their maxima."""
    rng = np.random.default_rng(1)
    segment = Segment(12, 11)
    segment.docs, segment.nulls = np.arange(4_000), np.zeros(4_000, bool)
    for t in range(12):
        docs = np.arange(t % 2, 4_000, 2) if t < 10 else np.arange(4_000)
        impacts = rng.integers(1, 100 + 10 * t, len(docs))
        segment.postings[t] = (docs.astype(np.int32), impacts)
        segment.most[t] = impacts.max()
    dense = np.zeros((12, 4_000), np.int64)
    for t, (docs, impacts) in segment.postings.items():
        dense[t, docs] = impacts
    for p in range(11):
        both = np.flatnonzero((dense[p] > 0) & (dense[p + 1] > 0))
        if len(both):
            segment.joint[p] = (both.astype(np.int32), dense[p, both] + dense[p + 1, both])
            segment.joint_most[p] = segment.joint[p][1].max()
    total = dense.sum(0)
    least = int(np.sort(total)[-10])
    looked = {}
    for use_pairs in (True, False):
        units = units_of(np.arange(12), np.arange(11), segment, use_pairs)
        docs, scores, looked[use_pairs] = search_segment(segment, units, least, 10, np.zeros(4_000, np.int64))
        want = np.flatnonzero(total >= least)
        assert sorted(docs) == want.tolist() and (scores == total[docs]).all()
    assert looked[True] < 0.7 * looked[False]


def test_hard_rows(spark):
    hard, items = hard_documents(spark), [(1, "brown FOX"), (2, ""), (3, None), (None, "wörter drei"), (4, "1234")]
    right = spark.createDataFrame(items, "item_id long, text string")
    left = [(r.doc_id, r.text) for r in hard.collect()]
    got = ranked(hard, right)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(left, items)
    assert ranked(empty_documents(spark), right).count() == 0
    assert ranked(hard, right.limit(0)).count() == 0
