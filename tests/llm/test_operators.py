"""The corpus operators on small inputs: brute force, round trips, held-out accuracy, odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointweave.llm import bpe, chat, common, components, jaccard, lattice, ordinal, packing, quality_rules, sharding, substring, tokens, url_filter

SCHEMA = "doc_id long, text string, source string, __p string, spans int"
SF = "/root/testdata/sf0.001"


def make(spark, texts, source=lambda i: f"s{i % 3}"):
    """Documents with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, source(i), "x", 1) for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", "  \n\t", "a", "b " * 30, "b " * 30, "word " * 3000, "ü x " * 20, "one two three"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 300))) for _ in range(60)]
    passage = " ".join(rng.choices(vocabulary, k=70))
    for i in range(20):
        w = texts[i].split()
        for _ in range(max(1, len(w) // 120)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
        texts.append(texts[i + 20] + " " + passage + "\n" + texts[i + 30][:200])
    return texts + [texts[0]] * 5 + ODD


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_set(text, k):
    """The k-word shingles of a text as tuples."""
    w = plain_words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_word_hashes_tell_words_apart(monkeypatch):
    rng = random.Random(1)
    odd = [None, "", "", " a", "a ", "A b\x0bc\x0c", "é日 x\x1c y", "ab " * 300, "x" * 200 + " y " + "x" * 200]
    texts = odd + ["".join(rng.choices("ab \t\ncéQ", k=rng.randint(0, 30))) for _ in range(500)]
    for piece in (16, 1 << 16):
        monkeypatch.setattr(tokens, "PIECE", piece)
        tokens._powers.cache_clear()
        for lower in (False, True):
            known = {}
            hashes, at = tokens.word_hashes(pa.array(texts, pa.string()), lower)
            for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
                own = [w.translate({i: i + 32 for i in range(65, 91)}) if lower else w for w in plain_words(t)]
                assert [known.setdefault(w, h) for w, h in zip(own, hashes[a:b].tolist(), strict=True)] == hashes[a:b].tolist()
            assert len(set(known.values())) == len(known)
    tokens._powers.cache_clear()


def brute_components(ids, sets, percent):
    """Smallest id of what links of similar sets lead to; rows of one id are one node."""
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if ids[i] is not None and ids[j] is not None and both and both * 100 >= percent * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(ids[i]), find(ids[j])))
                root[y] = x
    return [None if i is None else find(i) for i in ids]


@pytest.mark.parametrize("block", [2048, 4])
def test_jaccard_equals_brute_force(spark, corpus, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)  # with few rows a block, large groups go through all three searches
    rng = random.Random(8)
    base = [f"v{i}" for i in range(60)]
    near = [" ".join("other" if rng.random() < 0.03 else w for w in base) for _ in range(40)]
    texts = [*corpus, *near, *[" ".join(base[:9]), " ".join(base[:12]), " ".join(base[:11])] * 2, "long " + " ".join(f"l{i % 9000}" for i in range(30000))]
    ids = [*range(len(texts)), 3, 3, 7, None, None, 2000]
    texts += [near[0], texts[5], "", near[1], None, texts[6]]
    docs = spark.createDataFrame([(i, t, "s", "x", 1) for i, t in zip(ids, texts, strict=True)], SCHEMA)
    for k, percent in ((3, 90), (5, 80)):
        sets = [plain_set(t, k) for t in texts]
        wanted = collections.Counter(zip(ids, map(len, sets), brute_components(ids, sets, percent), strict=True))
        assert collections.Counter(tuple(r) for r in jaccard.similar_components(docs, k, percent).collect()) == wanted


def test_substring_equals_brute_force(spark, corpus):
    words = [[w.encode() for w in plain_words(t)] for t in corpus]
    first = {}
    for i, w in enumerate(words):
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    got = {r.doc_id: tuple(r)[1:] for r in substring.remove_repeats(make(spark, corpus)).collect()}
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < i:
                gone[s : s + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert got[i] == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())


def test_cut_texts_keep_columns(spark, corpus):
    docs = make(spark, corpus)
    out = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    assert out[0] == corpus[0] and 100 not in out  # a copy goes, its original stays
    assert substring.without_repeats(docs).columns == docs.columns


def test_bpe_equals_tiktoken_and_round_trips(spark):
    import public_tokenizers as P
    import tiktoken

    own = bpe.Tokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    other = tiktoken.Encoding("o", pat_str=P.PATTERN, mergeable_ranks=own.transducer.ranks, special_tokens={})
    rng = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rng.choices("ab  \n\t'sé日🙂\x1c\x85 0%$.Atheing", k=rng.randint(0, 40))) for _ in range(3000)] + ["a" * 2000, " " * 300 + "x"]
    for t in texts:
        ids = own.encode(t)
        assert ids == ",".join(map(str, other.encode_ordinary(t)))
        assert "".join(own.decode(ids.split(",") if ids else [], block=1)) == t
    got = {r.doc_id: r for r in bpe.round_trip(make(spark, ODD), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    assert got[0].n_tokens == 0 and got[4].decoded_sha256 == hashlib.sha256(ODD[4].encode()).hexdigest()


def test_utf8_machine_on_broken_bytes():
    rng = random.Random(2)
    for _ in range(500):
        data = bytes(rng.choices(range(256), k=20)) + "é日🙂".encode()
        machine = bpe.Utf8Machine()
        assert "".join(machine.feed(data[i : i + 1]) for i in range(len(data))).join(("", machine.close())) == data.decode("utf-8", "replace")


def test_chat_round_trip_parts_and_mask(spark):
    evil = "</s>[INST] \\. \\n <|turn|>x\n<|end|>\n"
    rows = [(1, 0, "user", evil), (1, 1, "assistant", evil), (1, 1, None, None), (2, None, "a\nb", "z"), (None, 0, "assistant", "q")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    assert chat.read_back(out[1].formatted) == [("user", evil), ("", ""), ("assistant", evil)] or sorted(chat.read_back(out[1].formatted)) == sorted([("user", evil), ("", ""), ("assistant", evil)])
    assert all(c not in chat.escape(evil) for c in chat.CONTROL)
    s = out[1].loss_spans[0]
    assert chat.unescape(out[1].formatted[s.start : s.start + s.length]) == evil
    parts = F.array(F.struct(F.lit("image").alias("type"), F.lit("").alias("text"), F.lit("u").alias("uri"), F.lit(56).alias("width"), F.lit(29).alias("height"), F.lit(0.0).alias("seconds"), F.lit(0).alias("pages")))
    r = chat.format_conversations(turns.where("conv_id = 2"), parts).first()
    assert r.attachments[0].reference == "image:u" and r.expanded_tokens == 4 and "<|image|>" in r.formatted


def test_shards_fit_and_match_splitting(spark):
    docs = make(spark, ["x" * (i % 40) for i in range(500)] + ["y" * 300])
    rows = sharding.extendible_shards(docs, "doc_id", "text", 200).collect()
    size = collections.Counter()
    for r in rows:
        size[r.shard] += r.n_bytes
    assert len(rows) == 501 and all(b <= 200 or sum(r.shard == s for r in rows) == 1 for s, b in size.items())
    shards = set(size)
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    for s in shards:  # no split was needless: the parent would not have fitted
        assert s == "" or sum(b for o, b in size.items() if o.startswith(s[:-1])) > 200


def test_packing_rules(spark):
    docs = make(spark, ["w " * (i % 37) for i in range(300)] + ["w " * 250] * 3, lambda i: None if i % 5 == 0 else f"s{i % 7}")
    rows = packing.pack_documents(docs, 100).collect()
    text = {r.doc_id: r for r in docs.collect()}
    bins = collections.defaultdict(list)
    for r in rows:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    assert sum(r.n_words for r in rows) == sum(len((t.text or "").split()) for t in text.values())
    for own in bins.values():
        assert sum(r.n_words for r in own) == own[0].bin_words <= 100
        sources = [text[r.doc_id].source for r in own if text[r.doc_id].source]
        assert len(sources) == len(set(sources)) and len({text[r.doc_id].text for r in own}) == len(own)


def test_best_fit_equals_scan():
    rng = random.Random(3)
    items = sorted((rng.randint(1, 60) for _ in range(200)), reverse=True)
    sources = [rng.choice("abcdef") for _ in items]
    placed = packing.best_fit(items, sources, [None] * 200, 60)
    room, held = [], []
    for n, s, b in zip(items, sources, placed, strict=True):
        fits = [r for r, h in zip(room, held, strict=True) if r >= n and s not in h]
        if b == len(room):
            assert not fits
            room.append(60)
            held.append(set())
        else:
            assert room[b] == min(fits) and s not in held[b]
        room[b] -= n
        held[b].add(s)


def test_lattice_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 64))
    vectors = [*base, *(base[:80] + rng.normal(size=(80, 64)) * 0.3), base[0], base[1]]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [1.0]), (904, [None] * 64)]
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 64).collect()}
    unit = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    true = ((unit @ unit.T) >= 0.9).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(vectors))])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905)) and got[280].component_id == 0


def test_e8_decoding_is_nearest():
    x = np.random.default_rng(1).normal(size=(200, 8)) * 2
    y = lattice.nearest_e8(x)
    d = ((x - y) ** 2).sum(axis=1)
    for v in lattice.neighbours():
        assert (((x - y - v) ** 2).sum(axis=1) >= d - 1e-9).all()


def test_rules_order_never_changes_verdicts(spark, corpus):
    docs = make(spark, [*corpus, "a% b% c% d% e% f% g% h% i% j%", "GO GO GO STOP THE MEN AT ONCE IN TOWN NOW OK"])
    kept = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    judged = quality_rules.judge(docs).collect()
    assert kept == {r.doc_id for r in judged if r.kept} and len(judged) == docs.count()
    for rules in (quality_rules.text_rules(), quality_rules.text_rules()[::-1]):
        assert {r.doc_id for r in docs.where(quality_rules.cascade(rules).isNull()).collect()} == kept


def test_url_rules_and_models(spark):
    rules = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"))
    urls = ["http://A.example.com/en/1", "https://www.example.com/en/1?x", "http://b.net/es/", "http://b.net/fr", None, "nothing", "http://Xexample.com/en/1"]
    urls += [f"http://good{i}.com/fine/page{i}" for i in range(200)] + [f"http://spam{i}.net/es/casino{i}" for i in range(200)] + ["http://good7.org/fine/page", "http://spam7.org/casino99"]
    rows = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert [(rows[i].host, rows[i].rule, rows[i].verdict) for i in (0, 1, 2, 6)] == [("a.example.com", "example.com/en/", "block"), ("www.example.com", "www.example.com/en/", "allow"), ("b.net", "net/es/", "block"), ("xexample.com", "com/", "allow")]
    assert (rows[4].host, rows[4].path, rows[5].host) == ("", "", "") and len(rows) == len(urls)
    assert (rows[407].verdict, rows[408].verdict) == ("allow", "block")


def test_url_models_read_the_whole_url(spark):
    rules = (("allow", "com", "/"), ("block", "net", "/"))
    urls = [f"http://h{i}.com/p?ref=friends#top{i}" for i in range(60)] + [f"ftp://h{i}.net/p?ref=casino#é{2 * i}" for i in range(60)]
    pairs = [("http://h.org/p?ref=friends", "http://h.org/p?ref=casino"), ("http://h.org/#top", "http://h.org/#é"), ("http://h.org/", "ftp://h.org/"), ("http://h.org/1", "http://h.org/2"), ("http://h.org/é", "http://h.org/ü"), ("ref=friends", "ref=casino")]
    n = len(urls)
    urls += [u for pair in pairs for u in pair] + [None, ""]
    rows = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    scores = [rows[i].score for i in range(n, len(urls))]
    assert len(rows) == len(urls) and all(scores[k] != scores[k + 1] for k in range(0, 2 * len(pairs), 2))
    assert scores[0] > scores[1] and scores[10] > scores[11]
    assert scores[-1] == scores[-2] is not None and rows[n + 10].host == ""


def brute_ratio(model, kinds, gram):
    """Log-ratio of a gram by Witten-Bell counts in plain Python; ``model``: gram to its count of each kind."""
    logs = []
    for kind in kinds:
        p = 1 / len({g[-1] for g in model})
        for k in range(len(gram)):
            seen = collections.Counter()
            for g, c in model.items():
                if g[len(g) - 1 - k : -1] == gram[len(gram) - 1 - k : -1]:
                    seen[g[-1]] += c[kind]
            total, n_kinds = sum(seen.values()), sum(v > 0 for v in seen.values())
            p = (seen[gram[-1]] + n_kinds * p) / (total + n_kinds) if total else p
        logs.append(np.log(p))
    return round((logs[0] - logs[1]) * url_filter.UNIT)


def test_url_models_count_all_rows(spark):
    rules = (("allow", "com", "/"), ("block", "net", "/"))
    urls = ["http://hot.com/a"] * 40 + ["http://hot.net/ab?q=1"] * 25 + [f"http://x{i % 20}.com/ab" for i in range(30)] + [f"http://y{i % 4}.net/é{i % 4}" for i in range(9)]
    urls += ["http://hot.org/a", "http://x1.org/b?q=1", "hot", "http://x1.org/b?q=1", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    folds = {r.url or "": r.fold for r in pages.select("url", F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(url_filter.FOLDS)).alias("fold")).distinct().collect()}
    kind_of = {u or "": "allow" if ".com" in (u or "") else "block" if ".net" in (u or "") else None for u in urls}
    width = url_filter.ORDER + 1
    split = lambda u: [s[i : i + width] for s in [url_filter.START * (width - 1) + u + url_filter.END] for i in range(len(s) - width + 1)]
    first, full = ({g: collections.Counter() for u in kind_of for g in split(u)} for _ in range(2))
    for u in urls:
        for g in split(u or ""):
            full[g][kind_of[u or ""]] += 1
            first[g][kind_of[u or ""]] += folds[u or ""] > 0
    score = lambda model, u: sum(brute_ratio(model, ("allow", "block"), g) for g in split(u)) // len(split(u))
    held = [(score(first, u), kind_of[u], urls.count(u)) for u in kind_of if kind_of[u] and folds[u] == 0]
    assert {k for _, k, _ in held} == {"allow", "block"} and max(n for _, _, n in held) > 1
    limit = url_filter.threshold(spark.createDataFrame([(s, k) for s, k, n in held for _ in range(n)], "score long, kind string").withColumn("rows", F.lit(1)))
    for r in url_filter.judge(pages, rules).collect():
        u = urls[r.page_id] or ""
        wanted = None if kind_of[u] else score(full, u)
        assert wanted is None and r.score is None or abs(r.score - wanted) <= 1
        assert r.verdict == (kind_of[u] or ("allow" if r.score >= limit else "block"))


def test_classifier_held_out(spark):
    docs, labels = (common.table(spark, SF.replace("0.001", "0.01"), t) for t in ("documents", "labels"))
    graded = labels.select("doc_id", ordinal.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    model = ordinal.train(docs, graded.where("doc_id % 3 != 0"))
    out = ordinal.grade(docs, model).join(graded.where("doc_id % 3 = 0"), "doc_id")
    good, all_good = out.where("grade = 2 and selected").count(), out.where("grade = 2").count()
    assert good >= 0.95 * all_good and list(model.thresholds) == sorted(model.thresholds)


@pytest.mark.parametrize("empty", [True, False])
def test_odd_and_empty_tables(spark, empty):
    docs = make(spark, ODD).where(F.lit(not empty))
    n = 0 if empty else len(ODD)
    assert jaccard.similar_components(docs, 3, 90).count() == n
    assert jaccard.keep_one(docs).count() <= n
    assert substring.remove_repeats(docs).count() == n
    assert quality_rules.judge(docs).count() == n
    assert sharding.extendible_shards(docs, "doc_id", "text", 1000).count() == n
    assert packing.pack_documents(docs, 100).select("doc_id").distinct().count() == n
    model = ordinal.fit([], np.zeros(0, int), 3)
    assert ordinal.grade(docs, model).where("selected").count() == n
    assert url_filter.judge(docs.select("doc_id", "text"), (), "doc_id", "text").count() == n
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"), 64).count() == 0


BIG = 2**53 + 1


def test_large_ids_beside_nulls(spark):
    turns = spark.createDataFrame([(BIG, 0, "assistant", "x"), (None, 0, "user", "y")], "conv_id long, turn long, role string, text string").coalesce(1)
    assert {r.conv_id: r.n_turns for r in chat.digests(chat.format_conversations(turns)).collect()} == {BIG: 1, None: 1}
    docs = spark.createDataFrame([(BIG, "a b c", "s", "x", 1), (None, "d e", "s", "x", 1), (BIG + 2, None, None, "x", 1)], SCHEMA).coalesce(1)
    assert {(r.doc_id, r.n_words, r.bin_id is None) for r in packing.pack_documents(docs, 10).collect()} == {(BIG, 3, False), (None, 2, False), (BIG + 2, 0, True)}


def test_chat_odd_tables(spark):
    kind = "conv_id long, turn long, role string, text string, formatted string, body int"
    assert chat.format_conversations(spark.createDataFrame([], kind)).count() == 0
    long_text = "[INST] \\ é " * 20000
    rows = [(1, 0, "user", "b", "x", 1), (1, 0, "user", "b", "x", 1), (1, 0, "assistant", long_text, "x", 1), (2, None, None, None, None, None)]
    out = {r.conv_id: chat.read_back(r.formatted) for r in chat.format_conversations(spark.createDataFrame(rows, kind)).collect()}
    assert out == {1: [("assistant", long_text), ("user", "b"), ("user", "b")], 2: [("", "")]}


def test_packing_equals_scan_with_clusters():
    rng = random.Random(9)
    items = sorted((rng.randint(1, 40) for _ in range(150)), reverse=True)
    sources, clusters = ([rng.choice([*names, None]) for _ in items] for names in ("abcde", "xyz"))
    room, held = [], []
    for n, s, c, b in zip(items, sources, clusters, packing.best_fit(items, sources, clusters, 40), strict=True):
        own = {("s", s)} - {("s", None)} | {("c", c)} - {("c", None)}
        fits = [r for r, h in zip(room, held, strict=True) if r >= n and not own & h]
        if b == len(room):
            assert not fits
            room.append(40)
            held.append(set())
        else:
            assert room[b] == min(fits) and not own & held[b]
        room[b] -= n
        held[b] |= own


def test_scaled_copies_all_link(spark):
    rng = np.random.default_rng(2)
    v, other = rng.normal(size=64), rng.normal(size=64)
    rows = [(i, [float(x) for x in v * (i + 1)], 5) for i in range(30)] + [(None, [float(x) for x in v], 5), (None, [float(x) for x in v], 5), (50, [float(x) for x in other], 5)]
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int"), 64).collect()
    assert {tuple(r) for r in got} == {(i, 31, 0, i == 0) for i in range(30)} | {(None, 31, None, False), (50, 0, 50, True)}


def test_rules_cascade_stops_early(spark):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("word " * 20).alias("text"))
    stop = [quality_rules.Rule("first", F.lit(True)), quality_rules.Rule("never", F.raise_error(F.lit("read on")).cast("boolean"))]
    assert docs.where(quality_rules.cascade(stop).isNull()).count() == 0
    assert quality_rules.sampled(docs, 2000).count() == 3


def test_vectors_without_ids_count_in_links_of_others(spark):
    v, w, far = [1.0, 0.0] * 32, [1.0, 0.05] * 32, [0.0, 1.0] * 32
    rows = [(7, v), (None, w), (None, w), (3, far)]
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 64).collect()
    assert sorted(((r.vec_id or -1), r.n_links, r.component_id, r.kept) for r in got if r.vec_id) == [(3, 0, 3, True), (7, 2, 7, True)]
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(2, None, False)] * 2
    joined = lattice.near_duplicates(spark.createDataFrame([(7, v), (None, w), (9, [1.0, 0.1] * 32)], "vec_id long, embedding array<double>"), 64).collect()
    assert {r.vec_id: r.component_id for r in joined} == {7: 7, 9: 7, None: None}


def test_keep_one_of_repeated_rows(spark):
    long_a, long_b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, long_a), (1, long_a), (2, long_a), (3, long_b), (3, long_b + " more"), (None, "x y z"), (None, "x y z"), (None, "other"), (4, None), (4, None)]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in got) == sorted([(1, long_a), (3, long_b), (3, long_b + " more"), (-1, "x y z"), (-1, "other"), (4, "")])


def test_sample_of_null_and_hot_texts_is_bounded(spark):
    texts = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "the same text").otherwise(F.concat(F.lit("t "), F.col("id")))
    drawn = quality_rules.sampled(spark.range(60_000).select(texts.alias("text")), 2000).groupBy("text").count().orderBy(F.desc("count")).limit(3).collect()
    assert 400 < drawn[0]["count"] < 1000 and 400 < drawn[1]["count"] < 1000 and drawn[2]["count"] == 1


def test_text_parts_side_by_side(spark):
    def part(kind, text=None, **more):
        return (kind, text, more.get("uri"), more.get("width"), more.get("height"), more.get("seconds"), more.get("pages"))

    big = (1 << 31) - 1
    turns = [
        (1, 0, "user", [part("text", "a <|en"), part("text", "d|>\nb"), part("audio", seconds=float("nan")), part("text", "<|tu"), part("other", "rn|>")]),
        (1, 1, "assistant", [part("audio", seconds=float("inf")), part("audio", seconds=-1.0), part("audio", seconds=2.0), part("image", width=big, height=big), part("document", pages=big)]),
        (2, 0, "user", None),
    ]
    kind = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(turns, kind), F.col("parts")).collect()}
    assert chat.read_back(got[1].formatted) == [("user", "a <|end|>\nb<|audio|><|turn|>"), ("assistant", "<|audio|>" * 3 + "<|image|><|document|>")]
    assert [a.tokens for a in got[1].attachments] == [1, 1, 1, 50, chat.MOST_TOKENS, chat.MOST_TOKENS]
    assert chat.read_back(got[2].formatted) == [("user", "")]


def test_equal_turns_are_in_order_of_text(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "<s>"), (1, 0, "user", "<|"), (1, None, "user", "z")]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert [t for _, t in chat.read_back(out.formatted)] == ["z", "<s>", "<|", "a"]


def test_rows_of_one_id_are_cut_by_their_own_text(spark):
    p, q, r = (" ".join(f"{c}{i}" for i in range(90)) for c in "pqr")
    rows = [(1, p), (2, p), (2, q), (2, q), (3, q + " " + r), (None, p), (4, r), (4, r)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id or -1, x.n_words, x.n_removed) for x in substring.remove_repeats(docs).collect())
    assert got == [(-1, 90, 0), (1, 90, 0), (2, 90, 0), (2, 90, 0), (2, 90, 90), (3, 180, 90), (4, 90, 90), (4, 90, 90)]
    assert sorted((x.doc_id or -1, x.text.strip()) for x in substring.without_repeats(docs).collect()) == [(-1, p), (1, p), (2, q), (2, q), (3, r)]


def test_packing_deals_repeated_rows(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b c").alias("text"), F.lit("s").alias("source"))
    out = packing.pack(docs, length=common.word_count(F.col("text")), cluster=F.lit(None), capacity=10, rows_per_group=100, source_col="source").collect()
    assert len(out) == 3000 and sum(r.bin_id is None for r in out) == 1500
    groups = collections.Counter(r.bin_id % 30 for r in out if r.bin_id is not None)
    assert max(groups.values()) < 150


def test_grade_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = ordinal.train(docs, spark.createDataFrame([(1, None)], "doc_id long, grade int"))
    assert {(r.expected_grade, r.tail_probability, r.selected) for r in ordinal.grade(docs, model).collect()} == {(1.0, 0.5, True)}


def test_lattice_counts_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)
    rng = np.random.default_rng(3)
    dense = rng.normal(size=64) + rng.normal(size=(120, 64)) * 0.1
    vectors = np.concatenate([dense, dense[:10], rng.normal(size=(40, 64))])
    top = 2**63 - 1
    rows = [(top - 3 * i if i != 50 else None, [float(x) for x in v]) for i, v in enumerate(vectors)]
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), 64).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    by_id = {r.vec_id: r for r in got}
    for i in range(130):
        r = by_id[rows[i][0]]
        assert r.n_links == near[i].sum() - 1 and r.component_id == (top - 3 * 129 if i != 50 else None)
    assert sum(r.kept for r in got) == 41


def test_components_in_bounded_memory(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    batch = pa.record_batch([pa.array([max(e) for e in edges]), pa.array([min(e) for e in edges])], names=["u", "v"])
    monkeypatch.setattr(components, "TASK_NODES", 20)
    parts = [batch.slice(i, 13) for i in range(0, 260, 13)]
    tied = [b for b in components.forest(iter(parts)) if b.num_rows]
    assert len(tied) > 5 and max(b.num_rows for b in tied) < 60

    def classes(pairs):
        root = {x: x for p in pairs for x in p}
        for a, b in pairs:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
        return {k: v for k, v in root.items() if k != v}

    assert classes(edges) == classes([(u, v) for b in tied for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])
