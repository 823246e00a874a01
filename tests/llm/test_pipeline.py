"""The pipeline's last three stages against brute force, on what the first two keep."""

import collections

import corpus_pipeline
from pointweave.llm.common import table

from test_operators import plain_set, plain_words

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SF)
        assert docs.columns == table(spark, SF, "documents").columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    sets = {i: plain_set(texts[i], 5) for i in ids}
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    kept = [i for i in ids if root[i] == i]
    words = {i: plain_words(texts[i]) for i in kept}
    first: dict = {}
    for i in kept:
        for s in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][s : s + 50]), i)
    expected = {}
    for i in kept:
        gone = set()
        for s in range(len(words[i]) - 49):
            if first[tuple(words[i][s : s + 50])] < i:
                gone.update(range(s, s + 50))
        if len(words[i]) > len(gone):
            expected[i] = len(words[i]) - len(gone)
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.n_words
    assert dict(got) == expected and len(expected) > 50
