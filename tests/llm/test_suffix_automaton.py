"""Matching statistics and reference spans against brute force."""

import random
import re
from collections import Counter

import pytest

from kinweave.llm.suffix_automaton import Automaton, remove_reference
from tests.llm.fixtures import collected, documents, texts


def test_statistics():
    rng = random.Random(4)
    for _ in range(60):
        refs = [[rng.randrange(3) for _ in range(rng.randrange(1, 25))] for _ in range(3)]
        a = Automaton()
        for r in refs:
            a.add(r)
        factors = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        doc = [rng.randrange(4) for _ in range(40)]
        want = [next((n for n in range(i + 1, 0, -1) if tuple(doc[i + 1 - n : i + 1]) in factors), 0) for i in range(len(doc))]
        assert a.statistics(doc) == want


def test_remove_reference(spark):
    t = texts()
    refs = [t[62], t[40], t[3], None, "", t[68]]
    reference = spark.createDataFrame([(r,) for r in refs], "text string")
    words = [re.findall(r"[^\x20\x09-\x0D]+", r or "") for r in refs]
    held = {tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34)}
    want = Counter()
    for r in collected(documents(spark)):
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if tuple(w[i : i + 35]) in held:
                keep[i : i + 35] = [False] * 35
        want[(r["doc_id"], len(w), keep.count(False), " ".join(x for x, k in zip(w, keep) if k))] += 1
    got = Counter((g["doc_id"], g["n_words"], g["n_removed"], g["kept_text"]) for g in collected(remove_reference(documents(spark), reference, shard_words=1000)))
    assert got == want
    with pytest.raises(ValueError):
        remove_reference(documents(spark), reference, max_words=100)
    assert all(g["n_removed"] == 0 for g in collected(remove_reference(documents(spark), reference.limit(0))))


def test_occurrences_against_brute_force():
    """Windows that stand at two places or more of several sequences, words as bytes."""
    rng = random.Random(8)
    for _ in range(150):
        window = rng.randrange(1, 5)
        texts = [[bytes([rng.randrange(97, 97 + rng.randrange(1, 5))]) for _ in range(rng.randrange(1, 25))] for _ in range(rng.randrange(1, 5))]
        automaton = Automaton()
        for t in texts:
            automaton.add(t)
        automaton.count_occurrences(window)
        count = Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
        for t in texts:
            assert automaton.repeated(t, window) == [n >= window and count[tuple(t[n - window : n])] > 1 for n in range(1, len(t) + 1)]
