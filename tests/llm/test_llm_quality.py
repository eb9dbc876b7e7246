"""Quality rules, the weak-label model, licenses and toxicity."""

import random
import zlib

import numpy as np

from topicpulse.llm import quality_model as M
from topicpulse.llm import quality_rules as R
from topicpulse.llm.license_scan import scan, train
from topicpulse.llm.toxicity import NeighbourIndex, fit, toxicity

from llm_cases import collected, documents, edge_rows, frame, words


def brute_figures(text):
    """Base figures by the plainest means."""
    t = text or ""
    w = "".join(c if c not in " \t\n\v\f\r" else " " for c in t).split(" ")
    w = [x for x in w if x]
    lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    covered = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_figures_match_brute_force(spark):
    rows = [r for r in edge_rows() if len(r[1] or "") < 10_000]
    got = collected(R.quality_figures(frame(spark, rows)))
    want = []
    for i, t in rows:
        n, chars, symbols, dup, rep = brute_figures(t)
        failed = n < 20 or 100 * rep > 30 * n
        want.append((i, n, chars, symbols, dup, rep, failed, not failed and all(r.passes(R.Profile(t)) for r in R.RULES)))
    assert got == sorted(want, key=repr)


def test_order_changes_no_verdict(spark):
    df = frame(spark, edge_rows())
    verdicts = {tuple((r["doc_id"], r["kept"]) for r in sorted(R.cascade(df, rules).collect(), key=repr))
                for rules in (R.RULES, R.RULES[::-1])}
    assert len({tuple(sorted(v, key=repr)) for v in verdicts}) == 1
    kept = R.keep_passing(df)
    assert kept.columns == df.columns
    assert kept.count() == R.cascade(df).where("kept").count()
    assert R.cascade(df.limit(0)).collect() == [] and R.quality_figures(df.limit(0)).collect() == []


def test_most_rejections_per_second_first():
    rules = [R.Rule(n, lambda p: True) for n in "abc"]
    order = R.ordered(rules, [("a", 1.0, 10.0), ("b", 0.1, 5.0), ("c", 0.01, 0.0)])
    assert [r.name for r in order] == ["b", "a", "c"]


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(1)
    true = rng.random(20_000) < .7
    right = [.95, .9, .8, .6] + [.75] * (len(M.LABELLERS) - 4)
    votes = np.stack([np.where(rng.random(len(true)) < r, 1, -1) * np.where(true, 1, -1) for r in right], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    fitted = M.fit_labellers(patterns, counts.astype(float))
    assert abs(fitted["share"] - .7) < .02
    assert all(abs(a - r) < .03 for (a, _), r in zip(fitted["accuracy"].values(), right))


def test_quality_scores_agree_with_held_back_labels(spark):
    base = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in M.quality_scores(documents(spark, base)).collect()}
    labels = spark.read.parquet(f"{base}/labels.parquet").collect()
    right = sum(out[r["doc_id"]]["kept"] == (r["quality"] == 1) for r in labels)
    assert right / len(labels) > .95
    good = [r for r in labels if r["quality"] == 1]
    assert sum(out[r["doc_id"]]["kept"] for r in good) / len(good) > .97


def test_quality_scores_edge_rows(spark):
    df = frame(spark, edge_rows())
    assert M.quality_scores(df).count() == len(edge_rows())
    assert M.quality_scores(df.limit(0)).collect() == []


def test_licenses(spark):
    rng = random.Random(2)
    lines = [("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Released under the MIT License.", "MIT"),
             ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
             ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
              "documentation files, to deal in the Software without restriction", "MIT")]
    rows = edge_rows() + [(100 + i, words(rng, 50) + "\n" + t + "\n" + words(rng, 9)) for i, (t, _) in enumerate(lines)]
    rows += [(200, "The driver has a new license and the plate of the car."), (101, rows[-3][1])]
    df = frame(spark, rows)
    got = sorted((r["doc_id"], r["paragraph"], r["family"], r["confirmed"]) for r in scan(df).collect())
    want = [(100 + i, 1, f, True) for i, (_, f) in enumerate(lines)]
    assert got == sorted(want + [want[1]])
    model = train(df)
    assert model.threshold >= .5
    assert scan(df.limit(0), model).collect() == []
    plan = scan(df, model)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))


def test_every_license_line_of_the_documents_is_found(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    want = {(r["doc_id"], k) for r in docs.collect() for k, line in enumerate(r["text"].split("\n"))
            if "licen" in line.lower()}
    assert {(r["doc_id"], r["paragraph"]) for r in scan(docs).collect()} == want


def test_license_model_is_of_all_rows_in_any_order(spark):
    rng = random.Random(8)
    german, english = "der die das und mit von haus baum weg jahr".split(), "the of and to in house tree way year day".split()
    quoted = "Redistribution and use in source and binary forms, with or without modification, are permitted"
    guests = "Permission is hereby granted to all guests free of charge."
    rows = [(i, " ".join(rng.choice(german) for _ in range(12))) for i in range(320)]
    for i in range(320, 640):
        rows.append((i, " ".join(rng.choice(english) for _ in range(12)) + i % 8 // 7 * f"\n{guests}"
                     + i % 40 // 39 * f"\n{quoted}"))
    models = [train(spark.createDataFrame(r, "doc_id long, text string").coalesce(1)) for r in (rows, rows[::-1])]
    a, b = models
    # words in half of the rows are no cues, wherever these rows stand; nor is a quoted notice an example of none
    assert not {"the", "of", "and", "to", "in", "granted"} & set(a.cues) and "redistribution" in a.cues
    assert a.cues == b.cues and abs(a.threshold - b.threshold) < 1e-6
    assert np.allclose(a.regression.coefficientMatrix.toArray(), b.regression.coefficientMatrix.toArray(), atol=1e-6)
    got = {(r["doc_id"], r["family"], r["confirmed"]) for r in scan(frame(spark, rows), a).collect()}
    assert got == {(i, "BSD-3-Clause", True) for i in range(320, 640) if i % 40 == 39}


def test_nearest_examples_are_exact():
    rng = random.Random(4)
    terms = [f"t{i}" for i in range(60)]
    examples = [(i, i % 3 == 0, 1.0, {t: rng.randint(1, 4) for t in rng.sample(terms, rng.randint(0, 8))}, 50)
                for i in range(700)]
    index = NeighbourIndex(examples, {t: rng.uniform(1, 6) for t in terms})
    for _ in range(50):
        v = index.vector({n: rng.randint(1, 3) for n in rng.sample(range(60), 5)})
        all_ = sorted((-round(sum(x * u.get(t, 0) for t, x in v.items()), 12), e) for e, u in enumerate(index.vectors))
        want = [(-x, e) for x, e in all_ if x < 0][:25]
        got = index.nearest(v, 25)
        assert [e for _, e in got] == [e for _, e in want] or \
            np.allclose([x for x, _ in got], [x for x, _ in want], atol=1e-9)


def test_toxicity_of_held_out_documents(spark):
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    out = toxicity(documents(spark, base), labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= .7) for r in out)
    held = [(r["score"], y[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in y]
    pos, neg = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum((p > n) + .5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg) > .85
    assert not any(r["evidence"] and zlib.crc32(str(e).encode()) % 3 == 1 for r in out for e in r["evidence"] or [])


def test_toxicity_never_sees_held_out_labels(spark):
    base = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 "
                                          "then 1 - toxic else toxic end as toxic")
    assert collected(toxicity(documents(spark, base), labels)) == collected(toxicity(documents(spark, base), flipped))


def test_toxic_terms_by_real_numbers_of_examples(spark):
    rng = random.Random(6)
    y = {i: i % 2 for i in range(900)}
    text = {}
    for i in y:
        w = words(rng, 30).split()
        if y[i] or i % 40 == 0:
            w.insert(rng.randint(1, 29), "vilest")      # lift of about 20, in many contexts in both classes
        if y[i] and i % 3:
            w += ["such", "grubnix"]        # always behind the same word
        text[i] = " ".join(w)
    labels = spark.createDataFrame(list(y.items()), "doc_id long, toxic int")
    model = fit(frame(spark, list(text.items())), labels)
    assert {"vilest", "grubnix"} <= set(model.index.number)
    assert model.score("a vilest b")[0] > model.score("a calm b")[0]


def test_toxicity_edge_rows(spark):
    df = frame(spark, edge_rows())
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None), (999, 1), (4, 1)], "doc_id long, toxic int")
    out = toxicity(df, labels).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["score"] == .5 for r in toxicity(df, labels.limit(0)).collect())
    assert toxicity(df.limit(0), labels).collect() == []
