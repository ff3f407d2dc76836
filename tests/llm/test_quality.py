import re
from collections import Counter

import numpy as np

from leadloom.llm import quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {k + j for k, w in enumerate(windows) if w in often for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(docs, documents):
    for table in (docs, documents):
        model = quality.QualityModel(np.zeros(quality.BUCKETS), -np.inf)
        found = Counter(tuple(r)[:6] for r in quality.assess(table, model).collect())
        assert found == Counter((r["doc_id"], *brute(r["text"])) for r in table.collect())


def test_scores_are_mean_ratios():
    rng = np.random.RandomState(1)
    model = quality.QualityModel(rng.randn(quality.BUCKETS), 0.0)
    texts = ["abcdef", "", "ab", "xyzzy plugh"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    scores = model.scores(data, offsets)
    for text, score in zip(texts, scores):
        own = np.frombuffer(text.encode(), np.uint8)
        bucket, _ = quality.gram_buckets(own, np.array([0, len(own)]))
        assert abs(score - (model.ratio[bucket].mean() if len(bucket) else 0)) < 1e-8


def test_good_documents_stay_and_junk_goes(documents, labels):
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(documents, quality.fit(documents, labels)).collect() if not r["base_failed"]}
    by = {q: [kept[r["doc_id"]] for r in labels.where(f"quality = {q}").collect() if r["doc_id"] in kept] for q in (0, 1)}
    assert np.mean(by[1]) > 0.97 and np.mean(by[0]) < 0.35


def test_without_labels_or_rows(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.assess(docs, quality.fit(docs, none)).collect()
    assert all(r["kept"] != r["base_failed"] for r in rows)
    assert quality.assess(empty, quality.fit(empty, none)).count() == 0
    assert not any(r["toxic"] for r in toxicity.grade_documents(docs, toxicity.fit(docs, none)).collect())
    assert toxicity.grade_documents(empty, toxicity.fit(empty, none)).count() == 0


def test_severity_on_held_out_documents(spark, labels):
    rows = []
    for k in range(600):
        words = [f"w{(k * 7 + j * 13) % 97}x" for j in range(40)]
        bad = k % 3 == 0
        if bad:
            words[k % 40] = "Nasty,"
            if k % 2:
                words[(k + 9) % 40] = words[(k + 20) % 40] = words[(k + 13) % 40] = "vile!"
        rows.append((k, " ".join(words), int(bad)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    known = spark.createDataFrame([(k, b) for k, _, b in rows if k < 400], "doc_id long, toxic int")
    found = {r["doc_id"]: r for r in toxicity.grade_documents(docs, toxicity.fit(docs, known)).collect()}
    held = [(found[k]["toxic"], bool(b)) for k, _, b in rows if k >= 400]
    assert np.mean([a == b for a, b in held]) > 0.99
    severe = [found[k]["expected_severity"] for k, _, b in rows if b and k % 2]
    mild = [found[k]["expected_severity"] for k, _, b in rows if b and not k % 2]
    assert np.mean(severe) > np.mean(mild)
    assert all(r["p_any"] >= r["p_severe"] for r in found.values())
