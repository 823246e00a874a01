"""Importance resampling, conversation repair and token files: brute force, exact round trips, odd rows."""

import collections
import functools
import hashlib
import io
import itertools
import json
import math
import random
import re
import struct
import zlib

import pyarrow as pa
import pytest
import xxhash
import zstandard

from pointweave.llm import ngram_table, repair, resampling, token_files
from pointweave.llm.queries import END_ID

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = ["Ab c's  d_e9 Éüx", None, "", "a b a b a b " * 9, "x" * 300 + " y " + "z" * 70 + " q " + "w" * 64, "one" * 30 + " two three four " * 5, "…", "end", "a b"]


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = plain_words(text)
    return [" ".join(w[i : i + n]).encode() for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def test_table_agrees_with_hash_libraries():
    words = ngram_table.find_words(pa.array(TEXTS))
    table = ngram_table.NgramTable(words, 10_000)
    found = collections.Counter()
    for n, (first, slots) in enumerate(table.occurrences, 1):
        for f, s in zip(first, slots, strict=True):
            run = words.bytes_of(words.start[f], words.end[f + n - 1] - words.start[f])
            assert table.key[s] == xxhash.xxh64_intdigest(run)
            assert words.bytes_of(table.at[s], table.size[s]) == run
            assert table.bucket[s] == zlib.crc32(run) % 10_000
            found[run] += 1
    assert found == collections.Counter(x for t in TEXTS for x in features(t))
    assert {int(c) for c in table.count if c} == set(found.values())


def test_equal_keys_of_different_runs_get_slots_of_their_own(monkeypatch):
    monkeypatch.setattr(ngram_table, "run_hashes", lambda words, start, size: (size * 0).astype("u8"))
    words = ngram_table.find_words(pa.array(["a b c a b d e " * 3]))
    table = ngram_table.NgramTable(words, 10_000)
    assert (table.count > 0).sum() == len(set(features("a b c a b d e " * 3)))


def test_chunks_encode_like_whole_texts():
    import public_tokenizers

    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    rng = random.Random(2)
    parts = ["a", "é", "'s", "'", "'ll", " ", "  ", "\n", "\t", "1", "²", "ж", ".", ",", "_", "\x1c", "\xa0", "\u3000", "!", "日", "-", "don't", "x2", "\u0301", "A", "×", "ß", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)] + [None, "x" * 3000]
    flat, ends = encoder.encode(pa.array(texts))
    for text, lo, hi in zip(texts, ends[:-1], ends[1:], strict=True):
        assert flat[lo:hi].tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, END_ID], repr(text)
    assert len(encoder.known) > 100 and encoder.encode(pa.array([], pa.string()))[1].tolist() == [0]


def plain_draw(docs, target, percent):
    count = lambda texts: collections.Counter(zlib.crc32(f) % 10_000 for t in texts for f in features(t))
    s, t = count(d[1] for d in docs), count(target)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (sum(t.values()) + 10_000))))
    rows, can = [], []
    for i, text in docs:
        weight = sum(gain(zlib.crc32(f) % 10_000) for f in features(text))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        if len(plain_words(text)) >= 20:
            can.append(rows[-1])
    can.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    ranks = collections.defaultdict(list)
    for k, r in enumerate(can[: percent * len(can) // 100], 1):
        ranks[r].append(k)
    return sorted(((*r, ranks[r].pop(0) if ranks[r] else None) for r in rows), key=repr)


def test_resampling_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(90)] + ["É", "naïve"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(150)]
    docs += [(None, docs[3][1] + " x " * 20), (None, None), (7, docs[7][1]), (7, docs[8][1]), (2**63 - 1, "long " * 4000), *[(1000 + i, t) for i, t in enumerate(TEXTS)]]
    target = [" ".join(rng.choices(vocabulary[:20], k=30)) for _ in range(20)] + [None]
    made = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, score string, k1 int").repartition(5)
    out = resampling.resample(made, spark.createDataFrame([(t,) for t in target], "text string"), percent=30)
    assert sorted(map(tuple, out.collect()), key=repr) == plain_draw(docs, target, 30)
    none = spark.createDataFrame([], made.schema)
    assert resampling.resample(none, none).count() == 0
    alone = resampling.resample(made, none, percent=30)
    assert sorted(map(tuple, alone.collect()), key=repr) == plain_draw(docs, [], 30)


@functools.cache
def all_edits(n):
    """Every sequence of edits over n rows with at most two inserts in a row."""
    out = [""]
    for _ in range(n):
        out = [a + i + e for a in out for i in ("", "I", "II") for e in "KRD"]
    return [a + i for a in out for i in ("", "I", "II")]


def plain_repair(rows):
    """Cost and audit of (initial, removed, truncated) rows by trying all edits and roles."""
    best = None
    for audit in all_edits(len(rows)):
        options, cost, at, bad = [], 0, 0, False
        for edit in audit:
            if edit == "I":
                options.append("ua")
                cost += 2
                continue
            initial, removed, truncated = rows[at]
            at += 1
            if edit == "D":
                cost += 3
                continue
            bad |= removed
            options.append("ua" if edit == "R" else initial)
            cost += (2 if edit == "R" else 0) + truncated
        if bad or (best is not None and (cost, audit) >= best):
            continue
        if any(re.fullmatch("(s?(ua)+)?", "".join(c)) and len(c) == len(options) for c in itertools.product(*options)):
            best = (cost, audit)
    return best


def test_repair_against_all_edits():
    rng = random.Random(1)
    for n in range(5):
        for _ in range(4 if n == 4 else 40):
            rows = [(rng.choice("suaux"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
            assert repair.cheapest(rows) == plain_repair(rows), rows


def test_long_conversations_stay_linear():
    cost, audit = repair.cheapest([("s", False, False)] + [("u" if i % 2 else "a", False, False) for i in range(1, 20_001)])
    assert (cost, audit) == (0, "K" * 20_001)
    cost, audit = repair.cheapest([("x", False, False)] * 5001)
    assert (cost, audit) == (2 * 5000 + 3, "D" + "R" * 5000)


def report(turns):
    """The expected report of one conversation's damaged rows (turn, role, text), sorted."""
    blank = duplicate = truncated = illegal = 0
    seen, rows, last = set(), [], None
    for _, role, text in turns:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        is_blank, is_duplicate = not body, bool(body) and (role, text) in seen
        is_truncated = not is_blank and not is_duplicate and body[-1] not in ".!?"
        seen.add((role, text))
        blank, duplicate, truncated = blank + is_blank, duplicate + is_duplicate, truncated + is_truncated
        illegal += last is not None and last + role[:1] not in ("su", "ua", "au")
        last = role[:1]
        rows.append((role[:1], is_blank or is_duplicate, is_truncated))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit = repair.cheapest(rows)
    out, at = [], 0
    for edit in audit:
        role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if edit == "I":
            out.append((role, ""))
            continue
        if edit != "D":
            out.append((turns[at][1] if edit == "K" else role, turns[at][2]))
        at += 1
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def test_repair_report_with_odd_rows(spark):
    rng = random.Random(4)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", ""])
            text = rng.choice([None, "", " \t", "Yes.", "No", "Why?  ", "é" * 30 + "!", f"t{turn}."])
            rows += [(conv, rng.choice([turn, turn, None, turn + 2]), role, text)] * rng.choice([1, 1, 1, 2])
    schema = "conv_id long, turn long, role string, text string"
    ids = spark.createDataFrame([(c,) for c in [None, *range(60), 77]], "conv_id long")
    turns = spark.createDataFrame([(*r, 1) for r in rows], schema + ", digest int")
    got = {r[0]: tuple(r[1:]) for r in repair.repair_report(turns, ids).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got.pop(77) == empty
    by_conv = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        digest = hashlib.md5(f"{'-' if conv is None else conv}:{len(role)}:{role}{text}".encode()).digest()
        by_conv[conv].append((turn is not None, turn or 0, role, digest, (turn, role, text)))
    assert got == {conv: report([r[-1] for r in sorted(found, key=lambda r: r[:4])]) for conv, found in by_conv.items()}
    none = spark.createDataFrame([], schema)
    assert repair.repair_report(none, none).count() == 0
    assert [r.repaired_sha256 for r in repair.repair_report(none, ids.limit(1)).collect()] == [empty[-1]]


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b!") for c in range(20) for t in range(8)] + [(None, None, None, None)]
    got = collections.Counter(map(tuple, repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()))
    expected = collections.Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        made = (c, t, "user" if kind == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text))
        expected[made] += 0 if kind == 0 else 2 if kind == 3 else 1
    assert got == +expected


class Kept(io.BytesIO):
    def close(self):
        pass


def test_file_reads_only_wanted_frames_and_checks_them():
    out = Kept()
    writer = token_files.FileWriter(out, frame_ids=100)
    docs = [(None, 5), *[(i, i % 40) for i in range(200)], (500, 1000)]
    ids = {d: struct.pack(f"<{n}I", *range(n)) for d, n in docs}
    for d, _ in docs:
        writer.add(d, ids[d])
    writer.close()
    data = out.getvalue()
    reader = token_files.FileReader(io.BytesIO(data), len(data))
    assert [(d, i) for d, _, i in reader.documents()] == [(d, ids[d]) for d, _ in docs] and reader.frames_read == len(reader.entries) - 1
    reader = token_files.FileReader(io.BytesIO(data), len(data))
    assert [(d, i) for d, _, i in reader.documents({3, 150, 500, 9999})] == [(d, ids[d]) for d in (3, 150, 500)] and reader.frames_read <= 3
    # any reader of the public format gets one flat stream
    flat = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert flat == b"".join(ids[d] for d, _ in docs)
    bad = bytearray(data)
    bad[-token_files._FOOTER.size - 12 * len(reader.entries) + 8] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(token_files.FileReader(io.BytesIO(bytes(bad)), len(bad)).documents())


def test_token_files_round_trip(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["It's  a\t b\n\n c", None, "", " ", "\x1c!\x1d a", "a\xa0 b c  ", "word " * 3000, "x" * 5000, "Ünïcode 日本語 \U0001f600!!", "tabs\t\t  end \n", "It's  a\t b\n\n c"]
    docs = [(i * 7 % 11, t) for i, t in enumerate(texts)] + [(3, "again"), (None, "no id"), (2**63 - 1, "last")]
    made = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, nth int").repartition(4)
    where = str(tmp_path / "ids")
    token_files.write_tokens(made, where, path, END_ID)
    rows = token_files.read_tokens(spark, where, ("doc_id", "start", "n_tokens", "tokens", "ids_crc32")).collect()
    expected = collections.Counter((d, tuple(plain.encode(t or "", add_special_tokens=False).ids) + (END_ID,)) for d, t in docs)
    assert collections.Counter((r.doc_id, tuple(r.tokens)) for r in rows) == expected
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.tokens), zlib.crc32(struct.pack(f"<{len(r.tokens)}I", *r.tokens)))
        at += r.n_tokens
    some = token_files.read_tokens(spark, where, ("doc_id", "n_tokens"), doc_ids=[3, 2**63 - 1, 77])
    assert sorted(r.doc_id for r in some.collect()) == [3, 3, 2**63 - 1]
    listed = json.loads((tmp_path / "ids" / token_files.MANIFEST).read_text())["files"]
    assert sum(f["n_ids"] for f in listed) == at
    token_files.write_tokens(made.limit(0), str(tmp_path / "none"), path, END_ID)
    assert token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0
