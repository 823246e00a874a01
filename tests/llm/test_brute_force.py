"""The classifier, the packing query and the pipeline's first two stages against plain versions of their rules."""

import collections
import math
import re
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from pointweave.llm import ordinal, packing, queries
from pointweave.llm.common import table

from test_operators import plain_words

SF = "/root/testdata/sf0.001"


def plain_buckets(text):
    """Buckets of the words without marks around them, in small letters, and of seven shape bins."""
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), sum(len(w) for w in words) or 1
    names = {"w:" + (w.strip(ordinal.MARKS).lower() or w) for w in words}
    names.add(f"s:symbols={min(12, math.ceil(8 * len(re.findall('[#*$%&|<>]', text)) / n))}")
    names.add(f"s:upper={min(8, math.ceil(8 * len([w for w in words if w.isupper()]) / n))}")
    names.add(f"s:shout={min(8, math.ceil(8 * len(re.findall('!', text)) / n))}")
    names.add(f"s:pipes={min(8, math.ceil(8 * len(re.findall('[|]', text)) / n))}")
    names.add(f"s:kinds={int(10 * len(set(words)) / n) if n >= 20 else -1}")
    names.add(f"s:length={min(20, int(chars / n))}")
    names.add(f"s:size={len(bin(n)) - 2}")
    return {zlib.crc32(name.encode()) % ordinal.BUCKETS for name in names}


def plain_tails(model, text):
    score = math.fsum(model.weights[b] for b in plain_buckets(text))
    return [1 / (1 + math.exp(-min(40, max(-40, score - t)))) for t in model.thresholds]


def test_grades_equal_plain_sums(spark):
    model = queries.ordinal_model(spark, SF)
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = queries.op6_quality_classifier(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts) and np.count_nonzero(model.weights) > 20
    for r in got:
        tails = plain_tails(model, texts[r.doc_id])
        assert abs(r.expected_grade - sum(tails)) < 2e-6 and abs(r.tail_probability - tails[-1]) < 2e-6
        assert r.selected == (tails[-1] >= 0.5) or abs(tails[-1] - 0.5) < 1e-9


def test_fit_equals_a_plain_step_by_step_fit():
    """One row a batch: each step is a plain FTRL-proximal step on the likelihood's slope, taken here by differences."""
    rng = np.random.default_rng(3)
    grades = rng.integers(0, 3, 40)
    rows = [np.unique(np.r_[rng.integers(0, 30, 6), 40 + g]).astype(np.int32) for g in grades]
    rate, l1, l2 = 0.7, 0.05, 0.1
    model = ordinal.fit(rows, grades, 3, epochs=3, batch=1, rate=rate, l1=l1, l2=l2, seed=5)
    counts = collections.Counter(grades.tolist())
    share = [np.mean(grades <= k) for k in range(2)]
    theta = [math.log((s + 1e-3) / (1 - s + 1e-3)) for s in share]
    z, n, w = collections.defaultdict(float), collections.defaultdict(float), collections.defaultdict(float)
    squares, order = [0.0, 0.0], np.random.default_rng(5)

    def loss(score, theta, y):
        upto = [0.0, *[1 / (1 + math.exp(score - t)) for t in theta], 1.0]
        return -math.sqrt(max(counts.values()) / counts[y]) * math.log(upto[y + 1] - upto[y])

    for _ in range(3):
        for i in order.permutation(len(rows)):
            y, score, h = int(grades[i]), sum(w[b] for b in rows[i].tolist()), 1e-5
            slope = (loss(score + h, theta, y) - loss(score - h, theta, y)) / (2 * h)
            moved = [[t + (s * h if j == k else 0) for j, t in enumerate(theta)] for k in range(2) for s in (1, -1)]
            slopes = [(loss(score, moved[2 * k], y) - loss(score, moved[2 * k + 1], y)) / (2 * h) for k in range(2)]
            for b in rows[i].tolist():
                sigma = (math.sqrt(n[b] + slope**2) - math.sqrt(n[b])) / rate
                z[b] += slope - sigma * w[b]
                n[b] += slope**2
                w[b] = 0.0 if abs(z[b]) <= l1 else -(z[b] - math.copysign(l1, z[b])) / ((1 + math.sqrt(n[b])) / rate + l2)
            squares = [q + s * s for q, s in zip(squares, slopes, strict=True)]
            theta = [t - 0.1 * s / (1 + math.sqrt(q)) for t, s, q in zip(theta, slopes, squares, strict=True)]
            theta[1] = max(theta)
    assert np.allclose(model.thresholds, theta, atol=1e-4)
    assert all(abs(model.weights[b] - w[b]) < 1e-3 for b in range(50)) and max(map(abs, w.values())) > 0.1


def test_packing_query_equals_a_scan_of_all_bins(spark):
    """All pieces of the small table are one group: each goes to the fullest bin that it fits and does not conflict with."""
    capacity = queries.SEQUENCE_WORDS
    docs = table(spark, SF, "documents").select("doc_id", "text", "source", F.lower("text").alias("cluster")).collect()
    pieces = []
    for d in docs:
        n = len(plain_words(d.text))
        pieces += [(min(capacity, n - at), d.doc_id, at // capacity, d.source, d.cluster) for at in range(0, n, capacity)]
    assert len(pieces) <= 8192
    bins, expected = [], {}
    for step, (n, doc_id, piece, source, cluster) in enumerate(sorted(pieces, key=lambda p: (-p[0], p[1], p[2]))):
        # of bins with equal room, the one that has had it longest
        fits = [(b["room"], b["since"], k) for k, b in enumerate(bins) if b["room"] >= n and source not in b["sources"] and cluster not in b["clusters"]]
        if not fits:
            bins.append({"room": capacity, "since": step, "sources": set(), "clusters": set(), "slots": 0})
        at = min(fits)[2] if fits else len(bins) - 1
        own = bins[at]
        expected[doc_id, piece] = (at, own["slots"], n)
        own.update(room=own["room"] - n, since=step, slots=own["slots"] + 1)
        own["sources"].add(source)
        own["clusters"].add(cluster)
        own["sources"].discard(None)
        own["clusters"].discard(None)
    got = queries.op8_best_fit_packing(spark, SF).where("n_words > 0").collect()
    assert {(r.doc_id, r.piece): (r.bin_id, r.slot, r.n_words) for r in got} == expected and len(expected) > 150
    assert all(r.bin_words == capacity - bins[r.bin_id]["room"] for r in got)


def plain_good(text):
    """Whether no rule rejects a text."""
    words = plain_words(text)
    n, chars = len(words), sum(map(len, words))
    if n < 10:
        return False
    windows = collections.defaultdict(list)
    for i in range(n - 4):
        windows[tuple(words[i : i + 5])].append(i)
    repeated = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [line for line in text.split("\n") if plain_words(line)]
    symbols, upper = len(re.findall("[#*$%&|<>]", text)), len(re.findall("[A-Z]", text))
    return not (
        100 * len(repeated) > 20 * n or 10 * symbols > 3 * n or chars > 25 * n or chars < 2 * n or 2 * upper > chars
        or 4 * (len(lines) - len(set(lines))) > n
    )


def test_first_pipeline_stages_equal_plain_rules(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    model = queries.ordinal_model(spark, SF)
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    chosen = {i for i, t in texts.items() if plain_tails(model, t)[-1] >= 0.5}
    assert {r.doc_id for r in first.collect()} == chosen and 0 < len(chosen) < len(texts)
    second = corpus_pipeline.STAGES[1][1](spark, docs, SF)  # all documents, so that rejected ones are met too
    good = {i for i, t in texts.items() if plain_good(t)}
    assert {r.doc_id for r in second.collect()} == good and 0 < len(good) < len(texts)
    assert first.columns == second.columns == docs.columns
    assert {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, first, SF).collect()} == chosen & good
