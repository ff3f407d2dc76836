"""Which documents and texts the pipeline's first four stages leave, by planted cases and brute force."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from leadloom.llm.suffix_dedup import PASSAGE as WINDOW
from test_near_dups import brute as linked
from test_quality import brute as counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)], SCHEMA).repartition(3)


@pytest.fixture
def labelled(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        return str(tmp_path)

    return write


def left(df):
    """doc_id -> text; a row that comes twice shows."""
    rows = df.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    assert all(r["n_chars"] == len(r["text"] or "") and r["source"] == f"src{r['doc_id'] % 3}" for r in rows)
    return {r["doc_id"]: r["text"] for r in rows}


def sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_quality_stage(spark, labelled):
    rng = random.Random(1)
    prose, junk = ["river", "market", "winter", "garden", "letter", "morning", "window", "summer"], ["zqx", "xxv", "qqz", "vkz", "kqj", "jzz"]
    texts = [sentence(rng, junk if k % 4 == 0 else prose, 60) for k in range(200)]
    texts += [None, "", sentence(rng, prose, 19), sentence(rng, prose, 20), (sentence(rng, prose, 10) + " ") * 8]
    folder = labelled([(k, int(k % 4 != 0), 0) for k in range(120)])
    grams = [[((b[j] << 16 | b[j + 1] << 8 | b[j + 2]) * 0x9E3779B1 % 2**32) >> 16 for j in range(len(b) - 2)] for b in ((t or "").encode() for t in texts)]
    raw, trusted = Counter(g for own in grams for g in own), Counter(g for k in range(120) if k % 4 for g in grams[k])
    log = lambda n, g: np.log((n[g] + 0.5) / (sum(n.values()) + 0.5 * 2**16))
    ratio = {g: log(trusted, g) - log(raw, g) for g in raw}
    score = [np.mean([ratio[g] for g in own]) if own else 0.0 for own in grams]
    good, bad = ([score[k] for k in range(120) if bool(k % 4) == kind] for kind in (True, False))
    assert max(bad) < min(good)  # so the least trusted score parts the labels best
    wanted = {}
    for k, t in enumerate(texts):
        words, _, _, _, repeated = counts(t)
        if words >= 20 and 100 * repeated <= 30 * words and score[k] >= round(min(good), 4) - 0.00005:
            wanted[k] = t
    assert 100 < len(wanted) and not any(k % 4 == 0 for k in wanted if k < 200)
    assert not {200, 201, 202, 204} & set(wanted)
    assert left(corpus_pipeline.quality_rules(spark, frame(spark, texts), folder)) == wanted


def test_toxicity_stage(spark, labelled):
    texts = []
    for k in range(600):
        words = [f"w{(k * 7 + j * 13) % 97}x" for j in range(40)]
        if k % 3 == 0:
            words[k % 40] = "Nasty,"
            if k % 2:
                words[(k + 9) % 40] = words[(k + 20) % 40] = "vile!"
        texts.append(" ".join(words))
    texts += [None, "", "quite clean"]
    folder = labelled([(k, 1, int(k % 3 == 0)) for k in range(400)])
    wanted = {k: t for k, t in enumerate(texts) if k >= 600 or k % 3}
    assert left(corpus_pipeline.toxicity_grades(spark, frame(spark, texts), folder)) == wanted


def test_near_duplicate_stage(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = [None, "", "a b", "A B", "a b c"]
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 5)):
            texts.append(" ".join(base))
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
    wanted = {k: texts[k] for k, _, _, kept in linked(list(enumerate(texts))) if kept}
    assert len(wanted) < len(texts)
    assert left(corpus_pipeline.minhash_near_dups(spark, frame(spark, texts), "")) == wanted


def test_passage_stage(spark):
    rng = random.Random(6)
    fresh = lambda n: "".join(rng.choice("abcdefghé \n") for _ in range(n))
    passage = fresh(700)
    texts = [None, "", fresh(WINDOW - 1), fresh(3000), fresh(500) + passage + fresh(300), passage + fresh(900), fresh(200) + passage[100:650] + fresh(50), fresh(80) + passage[:200] + fresh(400)]
    own = fresh(450)
    texts += [own + fresh(30) + own, "é" * 900]
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + WINDOW] for b in bodies for k in range(len(b) - WINDOW + 1))
    wanted = {}
    for n, b in enumerate(bodies):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - WINDOW + 1):
            if seen[b[k : k + WINDOW]] > 1:
                gone[k : k + WINDOW] = True
        wanted[n] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    assert wanted[4] != texts[4] and wanted[7] == texts[7] and wanted[3] == texts[3]
    assert left(corpus_pipeline.suffix_array_dedup(spark, frame(spark, texts), "")) == wanted
