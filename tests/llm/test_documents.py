"""Operators over documents against brute force on a small fixture."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from kinweave.llm import decontaminate, exact_dedup, license_rules, license_scan, mixing, ngram_join, quality_classifier, substring_dedup
from tests.llm import license_reference
from tests.llm.fixtures import collected, documents, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def test_bands_reach_their_recall():
    bands, rows = ngram_join.choose_bands()
    assert bands * rows <= ngram_join.MAX_HASHES and (1 - 0.8**rows) ** bands <= ngram_join.MISS


def test_ngram_join(spark):
    rows = collected(documents(spark))
    got = collected(ngram_join.near_duplicates(documents(spark), block=3))  # small blocks: many pairs of blocks
    assert len(got) == len(rows)
    known = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None]
    sets = [grams(t) for _, t in known]
    links, root = Counter(), {i: i for i, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(known)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(known[a][0]), find(known[b][0])
                root[max(x, y)] = min(x, y)
    want = Counter((i, links[k], find(i)) for k, (i, _) in enumerate(known))
    assert Counter((g["doc_id"], g["n_links"], g["class_id"]) for g in got if g["doc_id"] is not None) == want
    assert all(g["class_id"] is None and g["n_links"] == 0 for g in got if g["doc_id"] is None)
    assert ngram_join.near_duplicates(documents(spark, True)).count() == 0
    kept = {r["doc_id"] for r in collected(ngram_join.one_of_each(documents(spark)))}
    assert kept - {None} == {find(i) for i, _ in known} and ngram_join.one_of_each(documents(spark)).columns == documents(spark).columns


@pytest.mark.parametrize("unit", [1 << 12, 1 << 22])
def test_substring_dedup(spark, unit):
    rows = collected(documents(spark))
    split = [WORD.findall(r["text"] or "") for r in rows]
    count = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, split):
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        kept = " ".join(x for x, k in zip(w, keep) if k)
        spans = sum(not k and (i == 0 or keep[i - 1]) for i, k in enumerate(keep))
        want[(r["doc_id"], len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest(), spans, kept)] += 1
    got = Counter((g["doc_id"], g["n_words"], g["n_removed"], g["kept_sha256"], g["n_spans"], g["kept_text"]) for g in collected(substring_dedup.remove_repeats(documents(spark), unit_bytes=unit, with_text=True)))
    assert got == want
    assert substring_dedup.remove_repeats(documents(spark, True)).count() == 0


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact_dedup(spark, digest_bytes):
    rows = collected(documents(spark))
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in rows]
    groups = defaultdict(list)
    for r, t in zip(rows, norm):
        groups[t].append(r["doc_id"])
    smallest = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = Counter((r["doc_id"], smallest[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, norm))
    got = collected(exact_dedup.exact_duplicates(documents(spark), digest_bytes=digest_bytes))
    assert Counter((g["doc_id"], g["keep_id"], g["group_size"], g["text_sha256"]) for g in got) == want
    assert sum(g["kept"] for g in got) == len(groups)
    assert exact_dedup.exact_duplicates(documents(spark, True)).count() == 0
    if digest_bytes == 16:
        assert all(g["n_chunks"] >= 1 for g in got if g["text_sha256"] != hashlib.sha256(b"").hexdigest())
        for limit in (exact_dedup.BROADCAST_IDS, 0):
            left = collected(exact_dedup.deduplicated(documents(spark), broadcast_ids=limit))
            assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in left) == sorted(groups)


def test_chunks_follow_content():
    import numpy as np

    text = " ".join(texts()[68].split()[:8000]).encode()
    cuts = []
    for lead in (b"", b"a few words before "):
        data = np.frombuffer(lead + text, np.uint8)
        ends = exact_dedup.cut_points(data, 0, len(data), exact_dedup.chunk_marks(data))
        assert ends[-1] == len(data) and all(0 < b - a <= exact_dedup.MAX_CHUNK for a, b in zip([0, *ends], ends))
        cuts.append({e - len(lead) for e in ends})
    assert len(cuts[0] & cuts[1]) > 0.8 * len(cuts[0])


def test_decontamination(spark):
    bench = [(1, " ".join(f"q{i}" for i in range(30)) + ". The answer is seven of nine."), (2, " ".join(f"r{i}" for i in range(100))), (3, ""), (4, None), (5, "short item here")]
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    t = texts()
    w1, w2 = bench[0][1].split(), bench[1][1].split()
    para = [x if i % 5 else f"z{i}" for i, x in enumerate(w1)]  # a fifth of the words replaced
    half = [x if i % 2 else f"z{i}" for i, x in enumerate(w1[:-6])]
    rows = [(i, x) for i, x in t.items()] + [
        (100, t[1] + " " + bench[0][1].upper() + " " + t[2]), (101, t[3] + " " + " ".join(para) + " " + t[4]), (102, " ".join(half) + t[6]), (103, t[68] + "\n" + bench[1][1] + "\n" + t[7]),
        (104, " ".join(w2[40:60]) + " " + t[8]), (105, "A SHORT item, here"), (None, bench[0][1]), (106, bench[0][1] + " " + bench[1][1]), (106, bench[0][1] + " " + bench[1][1]),
    ]
    docs = spark.createDataFrame([(i, "x", x) for i, x in rows], "doc_id long, item_id string, text string")
    got = Counter((g["doc_id"], g["item_id"]) for g in collected(decontaminate.contaminated(docs, benchmark, block=2)))
    assert got == Counter([(100, 1), (101, 1), (103, 2), (105, 5), (None, 1), (106, 1), (106, 2), (106, 1), (106, 2)])
    clean = decontaminate.decontaminated(docs, benchmark)
    assert clean.columns == docs.columns and Counter(r["doc_id"] for r in collected(clean)) == Counter([*t, 102, 104])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, empty).count() == 0 and decontaminate.decontaminated(docs, empty).count() == docs.count()
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0


def test_decontamination_of_hot_items(spark):
    """Items that half or all of the documents hold, beside rare words of another."""
    bench = [(1, " ".join(f"q{i}" for i in range(20))), (2, " ".join(f"r{i}" for i in range(20))), (3, " ".join(f"s{i}" for i in range(40)))]
    rare = [" ".join(f"s{(i + k) % 40}" for k in range(0, 40, 4)) for i in range(40)]
    rows = [(i, " ".join(f"d{i}x{k}" for k in range(30)) + f" {rare[i]} {bench[0][1]} " + (bench[1][1] if i % 2 else "")) for i in range(40)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    got = Counter((g["doc_id"], g["item_id"]) for g in collected(decontaminate.contaminated(docs, benchmark)))
    assert got == Counter([(i, 1) for i in range(40)] + [(i, 2) for i in range(1, 40, 2)])
    assert decontaminate.decontaminated(docs, benchmark).count() == 0


def test_paraphrases_at_every_offset(spark):
    """LCS 0.61, 0.68 and 0.75 of an item of 59 words whose rarer words are replaced, against brute force."""
    words = [f"p{i}" for i in range(59)]
    item = " ".join(words[:53]) + ". " + " ".join(words[53:])
    rows = []
    for kept in (36, 40, 44):
        gone = set(range(0, 53, 2)[: 59 - kept])
        rows += [(kept * 100 + o, " ".join([f"d{kept}o{o}k{k}" for k in range(o)] + [f"z{i}" if i in gone else w for i, w in enumerate(words)] + [f"e{o}k{k}" for k in range(80)])) for o in range(64)]
    rows += [(i, f"filler{i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, t in rows if decontaminate.lcs(words, t.split()) / 59 >= 0.6 and t.split() and decontaminate.lcs(words[53:], t.split()) == 6}
    got = {g["doc_id"] for g in collected(decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")))}
    assert len(want) == 192 and got == want, len(got)


def test_lcs():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    import random

    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 20))] for _ in range(2))
        assert decontaminate.lcs(a, b) == slow(a, b)


def test_randomised_svd(spark):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    a = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 30))
    table = spark.createDataFrame(pa.table({"words": [list(range(30))] * 40, "values": a.tolist()}), "words array<int>, values array<double>").repartition(3)
    basis = decontaminate.randomised_svd(table, 30, 8)
    assert np.allclose(a @ basis @ basis.T, a, atol=1e-6)


def test_quality(spark):
    import random

    rng = random.Random(2)
    rows, labels = [], []
    for i in range(240):
        w = [f"{'abcdefgh'[rng.randrange(8)] * rng.randrange(1, 4)}word{rng.randrange(300)}" for _ in range(rng.randrange(30, 300))]
        bad = i % 3 == 0
        if bad:
            w[: len(w) // 2] = [x.upper() + "!!" for x in w[: len(w) // 2]]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1))
    rows += [(900, None), (901, ""), (None, "a b"), (5, rows[5][1])]
    labels += [(5, None), (None, 1), (99999, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_classifier.train(docs, labelled)
    got = collected(quality_classifier.score(docs, model))
    assert len(got) == len(rows) and all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.7) for g in got)
    import zlib

    truth = {i: y for i, y in labels if y is not None}
    held = [g for g in got if g["held_out"] and g["doc_id"] in truth]
    assert all((zlib.crc32(str(g["doc_id"]).encode()) % 4 == 2) == g["held_out"] for g in got if g["doc_id"] is not None)
    assert len(held) > 30 and sum(g["predicted"] == truth[g["doc_id"]] for g in held) >= 0.95 * len(held)
    again = quality_classifier.train(docs, labelled)
    assert all((again.w[k] == v).all() for k, v in model.w.items())
    none = quality_classifier.train(docs, labelled.limit(0))
    assert {g["score"] for g in collected(quality_classifier.score(docs, none))} == {0.5}
    assert quality_classifier.score(docs.limit(0), model).count() == 0
    kept = quality_classifier.accepted(docs, model)
    assert kept.count() == sum(g["predicted"] for g in got)


def test_mixing(spark):
    docs = documents(spark)
    got = collected(mixing.mix(docs))
    rows = collected(docs)
    assert Counter((g["doc_id"], g["size"]) for g in got) == Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:  # share, cap, share again
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: 3.0 * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    by_size = {sizes[s]: target[s] for s in order}
    assert all(abs(g["target"] - by_size[g["source_size"]]) < 1e-6 and g["taken"] == g["size"] * g["copies"] and 0 <= g["copies"] <= 3 for g in got)
    taken, largest = Counter(), Counter()
    for g in got:
        taken[g["source_size"]] += g["taken"]
        largest[g["source_size"]] = max(largest[g["source_size"]], g["size"])
    assert all(abs(taken[s] - by_size[s]) <= largest[s] for s in taken)
    assert Counter(map(str, got)) == Counter(map(str, collected(mixing.mix(docs.repartition(7)))))
    assert mixing.mix(documents(spark, True)).count() == 0


def test_mixing_against_its_sql(spark, tmp_path):
    """Empty texts in a source at its cap, a source without words, many slots and one."""
    import duckdb

    rows = [(i, "word " * (i % 7) if i % 5 else "", "capped" if i < 20 else "zbig", "k") for i in range(400)] + [(500, "  ", "empty", "k"), (501, None, None, None), (502, "a b", None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, place string")
    docs.write.parquet(str(tmp_path / "d"))
    found = duckdb.sql(mixing.oracle(f"'{tmp_path}/d/*.parquet'")).fetchall()
    columns = ["doc_id", "size", "source_size", "target", "taken", "copies"]
    want = Counter((*r[:3], round(r[3], 6), *r[4:]) for r in found)
    for weights, slots in (((1, 2, 3), 4096), ((1, 2, 3), 1), ((1, 2, 3), 100_000)):
        got = collected(mixing.mix(docs, weights=weights, slots=slots))
        assert Counter(tuple(round(g[c], 6) if c == "target" else g[c] for c in columns) for g in got) == want
    assert any(r[1] == 0 and r[5] == 3 for r in found) and max(r[5] for r in found) == 3


def test_license_scan(spark):
    signatures = license_rules.rules()
    assert len(signatures) > 300
    heads = (*license_rules.HEADS, *(p for p, _ in license_scan.BASE))
    for _, label, keyword, expression, _ in signatures:
        assert any(h in keyword or h in expression for h in heads), (label, keyword)
    lines = ["Released under the MIT License. All rights reserved. cc-by cc by 4.0, CC BY", "GPL", "all rights reserved " * 40, "Licensed under the Apache License, Version 2.0; GNU General Public License v3 / GNU Lesser General Public License version 2.1",
             "SPDX-License-Identifier: BSD-3-Clause license", "Permission is hereby granted, free of charge, to any person obtaining a copy", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "ÀLL RIGHTS reserved \u212a cc\u00a0by"]
    docs = documents(spark).select("doc_id", "text", "score").unionByName(spark.createDataFrame([(1000 + i, x, 0.1) for i, x in enumerate(lines)] + [(1000, lines[0], 0.1)], "doc_id long, text string, score double"))
    want = Counter()
    for r in collected(docs):
        w = license_reference.scan(r["text"], signatures)
        want[(r["doc_id"], *(round(v, 9) if isinstance(v, float) else v for v in w.values()))] += 1
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections"]
    got = Counter(tuple(round(g[c], 9) if isinstance(g[c], float) else g[c] for c in columns) for g in collected(license_scan.scan(docs)))
    assert got == want
    assert license_scan.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("line", ["SIL OFL 1.1", "licensed under the SIL OFL", "SPDX-License-Identifier: SIL OFL 1.1"])
def test_sil_ofl(spark, line):
    docs = spark.createDataFrame([(1, line)], "doc_id long, text string")
    assert "ofl-1.1" in license_scan.scan(docs).first()["labels"].split(",")


def shortest(parsed):
    """A text for every choice of alternatives, without what may be left out."""
    found = [""]
    for kind, value in parsed:
        name = str(kind)
        if name == "BRANCH":
            more = [x for part in value[1] for x in shortest(part)]
        elif name == "SUBPATTERN":
            more = shortest(value[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            more = [x * value[0] for x in shortest(value[2])]
        elif name == "IN":
            more = ["x" if str(k) == "NEGATE" else chr(v[0] if str(k) == "RANGE" else v) for k, v in value if str(value[0][0]) != "NEGATE" or str(k) == "NEGATE"]
        else:
            assert name in ("LITERAL", "ANY", "NOT_LITERAL"), name
            more = [chr(value) if name == "LITERAL" else "x"]
        found = [a + b for a in found for b in more]
    return found


def test_license_keywords():
    rows = [r[:3] for r in (*license_rules.NAMES, *license_rules.NOTICES)]
    for label, keyword, expression in rows:
        for x in shortest(re._parser.parse(expression)):
            assert re.fullmatch(expression, x) and keyword in f" {x} ", (label, keyword, x)
            assert any(h in x for h in license_rules.HEADS) or any(set(p.split()) <= set(x.split()) for p, _ in license_scan.BASE), (label, x)
    for line, label in (("PSF License", "psf-2.0"), ("Licence Ouverte 2.0", "etalab-2.0")):
        assert label in license_reference.scan(line, license_rules.rules())["labels"]


def test_ngram_join_of_chains_and_hot_anchors(spark):
    """A hundred near copies, each like its neighbours only, against brute force: no link is lost between blocks and anchors."""
    import random

    rng = random.Random(9)
    w = [f"v{k}" for k in range(90)]
    rows = []
    for i in range(110):
        w[rng.randrange(90)] = f"n{i}"
        rows.append((i, " ".join(w), "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, anchor string")
    sets = [grams(t) for _, t, _ in rows]
    links, root = Counter(), list(range(110))
    for a in range(110):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links.update((a, b))
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    for block in (4, 128):
        got = collected(ngram_join.near_duplicates(docs, block=block))
        assert sum(abs(g["n_links"] - links[g["doc_id"]]) for g in got) <= 2 and all(g["class_id"] == root[g["doc_id"]] for g in got)


def test_banding_recall_near_the_threshold():
    """Signatures of pairs at 0.80 to 0.82 share a band in at least 0.999 of 2000 pairs."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    bands, rows = ngram_join.choose_bands()
    texts_, n = [], 2000
    for _ in range(n):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 104)]  # 100 shingles; 11 at the end change: 89 / 111 = 0.802
        texts_ += [" ".join(words), " ".join(words[:-11] + [f"y{x}" for x in rng.integers(0, 1 << 40, 11)])]
    table = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(2 * n), pa.int64()), "text": pa.array(texts_)})
    keys = np.concatenate([np.asarray(b.column("bands").flatten()).reshape(-1, bands) for b in ngram_join._signatures(5, bands, rows)(iter([table]))])
    assert (keys[::2] == keys[1::2]).any(axis=1).mean() >= 0.999
