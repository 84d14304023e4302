import itertools
import random

from helpers import empty_documents, hard_documents

from siteweave.llm import decontaminate
from siteweave.llm.decontaminate import MASKS, SUBSTITUTED, WINDOW, decontaminated, overlaps, plain_words, window_of


def test_no_window_with_two_substitutions_lacks_a_seed():
    for bad in itertools.combinations(range(WINDOW), SUBSTITUTED):
        assert any(
            not {at + k for k in mask} & set(bad) for mask in MASKS for at in range(WINDOW - mask[-1])
        )


def brute(docs, items):
    out = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        w, v = plain_words(text.encode()), plain_words(item.encode())
        if not v:
            continue
        width, changed = window_of(len(v))
        assert width == min(13, len(v)) and changed == (0 if width < 8 else 2 * width // 13)
        hits = []
        for p in range(len(w) - width + 1):
            for q in range(len(v) - width + 1):
                same = sum(a == b for a, b in zip(w[p : p + width], v[q : q + width], strict=True))
                if same >= width - changed:
                    hits.append((p, same))
        if hits:
            out[d, i] = (min(p for p, _ in hits), len(hits), max(s for _, s in hits))
    return out


def test_equals_brute_force_with_substitutions(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 5, 7, 8, 9, 12, 13, 20, 40])))) for k in range(30)]
    docs = []
    for d in range(80):
        text = [word() for _ in range(rng.randrange(0, 60))]
        piece = rng.choice(items)[1].split()
        for _ in range(rng.randrange(4)):
            piece[rng.randrange(len(piece))] = word()
        at = rng.randrange(len(text) + 1)
        text[at:at] = [w.upper() + rng.choice(["", "!!", ","]) for w in piece]
        docs.append((d, " ".join(text)))
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 30
    for bound in (2_000_000, 20):  # one pass, and many
        monkeypatch.setattr(decontaminate, "PASS_WORDS", bound)
        got = {(r.doc_id, r.item_id): (r.first_word, r.n_windows, r.matched) for r in overlaps(left, right).collect()}
        assert got == want
        clean = {r.doc_id for r in decontaminated(left, right).collect()}
        assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_hard_rows(spark):
    docs = hard_documents(spark)
    items = spark.createDataFrame(
        [(1, "the quick brown fox jumps over the lazy cat and runs far away"), (2, None), (3, ""), (None, "drei"), (4, "drei Wörter hier")],
        "item_id long, text string",
    )
    got = overlaps(docs, items).collect()
    # the short items stand in the texts as they are, the one without id too
    assert sorted((r.doc_id is None, r.doc_id or 0, r.item_id is None, r.item_id or 0) for r in got) == [
        (False, 1, False, 1), (False, 2, False, 1), (False, 2, False, 1), (False, 3, False, 1),
        (False, 8, False, 4), (False, 8, True, 0), (False, 9, False, 4), (False, 9, True, 0), (True, 0, False, 1),
    ]
    kept = decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == 7
    assert overlaps(empty_documents(spark), items).count() == 0
    assert overlaps(docs, items.limit(0)).count() == 0
    assert decontaminated(docs, items.limit(0)).count() == docs.count()
