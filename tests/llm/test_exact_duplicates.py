import hashlib
import random
from collections import defaultdict

import pytest
from helpers import ALL, empty_documents, hard_documents, ids

from siteweave.llm.exact_duplicates import Owner, Trie, exact_duplicates, text_owners, without_exact_duplicates


def lowered(text):
    return (text or "").encode().lower()


def brute(rows, keep):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[lowered(text)].append(doc)
    out = []
    for doc, text in rows:
        own = groups[lowered(text)]
        known = [d for d in own if d is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        out.append((doc, best, len(own), doc == best, hashlib.sha256(lowered(text)).hexdigest()))
    return sorted(out, key=repr)


def random_texts(n, seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abAB ") for _ in range(rng.randrange(12))) for _ in range(40)]
    return [(k, "".join(rng.choice(stems) for _ in range(rng.randrange(4)))) for k in range(n)]


@pytest.mark.parametrize("most", [1 << 30, 20_000, 1_500])
def test_trie_keeps_each_string_once_whatever_it_spills(most):
    texts = [t.encode() for _, t in random_texts(3_000, 1)]
    want = defaultdict(lambda: [None, 0])
    for k, t in enumerate(texts):
        want[t][0] = k if want[t][0] is None else min(want[t][0], k)
        want[t][1] += 1
    todo = [(None, [Owner(t, k, 1) for k, t in enumerate(texts)])]
    got, rounds = {}, 0
    while todo:
        rounds += 1
        parts = defaultdict(list)
        for _, rows in todo:
            trie = Trie("smallest", most)
            for row in rows:
                name = trie.add(*row)
                if name is not None:
                    parts[name].append(row)
                elif trie.size > trie.most:
                    for part, owner in trie.spill():
                        parts[part].append(owner)
            for owner in trie.owners():
                assert owner.text not in got
                got[owner.text] = [owner.owner, owner.copies]
        todo = list(parts.items())
        assert rounds < 200
    assert got == dict(want)
    assert (rounds == 1) == (most == 1 << 30)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("most", [128 << 20, 30_000])
def test_equals_brute_force(spark, keep, most):
    rows = random_texts(1_500, 2) + [(7, "same id, other text"), (None, "a"), (None, "only null"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in exact_duplicates(docs, keep, trie_bytes=most).collect()), key=repr)
    assert got == brute(rows, keep)


def test_one_text_on_a_third_of_the_rows(spark):
    rows = [(k, "Hot Text" if k % 3 == 0 else f"text {k}") for k in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted((tuple(r) for r in exact_duplicates(docs, "largest").collect()), key=repr) == brute(rows, "largest")


def test_hash_collisions_keep_texts_apart(spark, monkeypatch):
    import siteweave.llm.exact_duplicates as module

    monkeypatch.setattr(module, "xxh3_64_intdigest", lambda t: 8)
    docs = spark.createDataFrame([(1, "ab"), (2, "ba"), (3, "AB"), (4, "b")], "doc_id long, text string")
    assert sorted(r.copies for r in text_owners(docs).collect()) == [1, 1, 2]


def test_hard_rows(spark):
    hard = hard_documents(spark)
    got = exact_duplicates(hard)
    assert ids(got) == ALL
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(
        [(r.doc_id, r.text) for r in hard.collect()], "smallest"
    )
    assert exact_duplicates(empty_documents(spark)).count() == 0
    left = without_exact_duplicates(hard)
    assert left.columns == hard.columns
    # the texts of 1 (also 2, 2 and null), 4 (also 5 and null), and 8 (also 9) are kept once
    assert ids(left) == [1, 3, 4, 6, 7, 8, 10, 11]
    assert without_exact_duplicates(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError):
        exact_duplicates(hard, "any")
