"""The registered queries of the corpus operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, jaccard, lattice, ordinal, packing, quality_rules, repair, resampling, sharding, substring, token_files, url_filter
from .common import ensure_checkpoint_dir, table

#: Bytes of text in a shard.
SHARD_BYTES = 64 << 10
#: Words in a packed sequence.
SEQUENCE_WORDS = 2048
#: Components of an embedding.
EMBEDDING_DIM = 64
#: The id that op13 puts behind each document.
END_ID = 2
#: Verdict, host and path of the URL rules of op5.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: The conversation of control strings that op3 formats besides the table's.
PROBE = "</s>[INST] ok [/INST]"


def op1_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.extendible_shards(docs, "doc_id", "text", SHARD_BYTES).drop("text")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.unionByName(probe)))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ordinal.grade(docs, ordinal_model(spark, sf_dir)).drop("text")


def ordinal_model(spark: SparkSession, sf_dir: str) -> ordinal.OrdinalModel:
    """The classifier fitted on the labelled documents of a folder."""
    labels = table(spark, sf_dir, "labels").select("doc_id", ordinal.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return ordinal.train(table(spark, sf_dir, "documents"), labels)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), SEQUENCE_WORDS)


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"), dim=EMBEDDING_DIM)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_report(repair.damaged(turns), turns)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return token_files.read_tokens(spark, path, ("doc_id", "start", "n_tokens", "ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_extendible_sharding, op2_quality_rules, op3_chat_formatting, op4_byte_bpe, op5_url_filter, op6_quality_classifier, op7_substring_dedup, op8_best_fit_packing, op9_embedding_near_dedup, op10_ngram_jaccard_join, op11_importance_resampling, op12_conversation_repair, op13_token_files]
    return {f.__name__: f for f in named}


def _escaped(column: str) -> str:
    """DuckDB's form of chat.escape()."""
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in sorted(chat.CONTROL, key=len, reverse=True):
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '.{c[1:]}')"
    return out


def _crc32(text: str) -> str:
    """DuckDB's CRC-32 of a text's UTF-8 bytes, half a byte at a time."""
    table = list(range(16))
    for _ in range(4):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    halves = "list_transform(range(0, len(hex(encode({t}))), 1), lambda k: (strpos('0123456789ABCDEF', substr(hex(encode({t})), k + 2 - 2 * (k % 2), 1)) - 1)::BIGINT)".format(t=text)
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {halves}), lambda c, n: xor(list_extract({table}::BIGINT[], (xor(c, n) & 15) + 1), c >> 4)))"


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op1_extendible_sharding": f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
    right(repeat('0', 60) || bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT), 60) AS bits FROM documents),
tree AS (SELECT t.k AS local_depth, substr(bits, 1, t.k) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*)::BIGINT AS shard_rows
    FROM d, range(0, 60) AS t(k) GROUP BY ALL),
leaf AS (SELECT doc_id, n_bytes, shard, local_depth, shard_bytes, shard_rows,
    row_number() OVER (PARTITION BY doc_id ORDER BY local_depth) AS r
    FROM d JOIN tree ON substr(bits, 1, local_depth) = shard WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1)
SELECT doc_id, n_bytes, shard, local_depth::INTEGER AS local_depth, shard_bytes, shard_rows, shard_bytes > {SHARD_BYTES} AS oversize FROM leaf WHERE r = 1""",
    "op2_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM d, range(1, len(w) - 3) AS r(i)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM twice, range(0, 5) AS o(k) WHERE c > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n
    FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
    FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars > 25 * n_words OR word_chars < 2 * n_words
        OR 2 * n_upper > word_chars OR 4 * n_dup_lines > n_words) AS kept FROM b""",
    "op3_chat_formatting": f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum({len(chat.TURN) + len(chat.END) + 2} + length({_escaped("role")}) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 49) AS g FROM d, range(1, len(w) - 48) AS r(i)),
least AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) < doc_id AS again FROM win),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM least, range(0, 50) AS o(k) WHERE again),
cut AS (SELECT doc_id, count(*)::BIGINT AS n_removed FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM each ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
w AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM w GROUP BY a), n AS (SELECT a AS vec_id, count(*)::BIGINT AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)""",
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS g FROM d, range(1, greatest(len(w) - 1, least(len(w), 1) + 1)) AS r(i)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
w AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM w GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)""",
    "op11_importance_resampling": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT regexp_extract_all({_ASCII_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
fd AS (SELECT doc_id, array_to_string(list_slice(w, i, i + n), ' ') AS f FROM d, range(0, 3) AS r(n), range(1, len(w) - n + 1) AS s(i)),
fb AS (SELECT array_to_string(list_slice(w, i, i + n), ' ') AS f FROM b, range(0, 3) AS r(n), range(1, len(w) - n + 1) AS s(i)),
k AS (SELECT f, ({_crc32("f")} % 10000)::INTEGER AS bucket FROM (SELECT f FROM fd UNION SELECT f FROM fb)),
s AS (SELECT bucket, count(*) AS s FROM fd JOIN k USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM fb JOIN k USING (f) GROUP BY 1),
a AS (SELECT (SELECT count(*) FROM fd) AS ns, (SELECT count(*) FROM fb) AS nt),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ns + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (nt + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), a),
v AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM fd JOIN k USING (f) JOIN g USING (bucket) GROUP BY 1),
o AS (SELECT doc_id, len(w) >= 20 AS can, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN v USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY can ORDER BY score DESC, doc_id) AS r, 5 * count(*) OVER (PARTITION BY can) // 100 AS drawn FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN can AND r <= drawn THEN r END AS rank FROM p""",
    "op12_conversation_repair": f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM c, range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END) AS r(copy) WHERE kind <> 0),
o AS (SELECT *, substr(role, 1, 1) AS i, rtrim(text, {_BLANKS}) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM m),
q AS (SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again,
    coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY rn) || i NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
d AS (SELECT *, blank OR again AS gone, NOT blank AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut FROM q),
n(s, r, t) AS (VALUES (0, 's', 1), (0, 'u', 4), (1, 'u', 4), (4, 'a', 5), (5, 'u', 4)),
one AS (SELECT s, t FROM n WHERE r <> 's'),
ins AS (SELECT s, s AS t, '' AS a, 0 AS c FROM (VALUES (0), (1), (4), (5)) AS z(s) UNION ALL SELECT s, t, 'I', 2 FROM one UNION ALL SELECT x.s, y.t, 'II', 4 FROM one x JOIN one y ON y.s = x.t),
tr AS (SELECT ins.s, ins.t, NULL AS r, ins.a || 'D' AS a, ins.c + 3 AS c FROM ins
    UNION ALL SELECT ins.s, n.t, n.r, ins.a || 'K', ins.c FROM ins JOIN n ON n.s = ins.t
    UNION ALL SELECT ins.s, n.t, n.r, ins.a || 'R', ins.c + 2 FROM ins JOIN n ON n.s = ins.t AND n.r <> 's'),
w AS (SELECT DISTINCT conv_id, 0::BIGINT AS rn, 0 AS s, {{'c': 0::BIGINT, 'a': ''}} AS v FROM conversations
    UNION ALL SELECT w.conv_id, d.rn, tr.t, min({{'c': (w.v.c + tr.c + CASE WHEN d.cut AND right(tr.a, 1) <> 'D' THEN 1 ELSE 0 END)::BIGINT, 'a': w.v.a || tr.a}})
    FROM w JOIN d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.rn = w.rn + 1
    JOIN tr ON tr.s = w.s AND (tr.r IS NULL OR NOT d.gone AND CASE right(tr.a, 1) WHEN 'K' THEN tr.r = d.i ELSE true END) GROUP BY 1, 2, 3),
z AS (SELECT w.conv_id, min({{'c': w.v.c + ins.c, 'a': w.v.a || ins.a}}) AS v FROM w JOIN ins ON ins.s = w.s AND ins.t IN (0, 5)
    WHERE w.rn = (SELECT count(*) FROM d WHERE d.conv_id IS NOT DISTINCT FROM w.conv_id) GROUP BY 1),
e AS (SELECT conv_id, j, substr(v.a, j, 1) AS e, len(replace(substr(v.a, 1, j), 'I', '')) AS rn, len(replace(substr(v.a, 1, j), 'D', '')) AS p FROM z, range(1, len(v.a) + 1) AS r(j)),
f AS (SELECT e.*, d.role, d.text, max(CASE WHEN e.e = 'K' AND d.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS has_s FROM e LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM e.conv_id AND d.rn = e.rn AND e.e <> 'I'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (p - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j)) AS sha FROM f WHERE e <> 'D' GROUP BY 1),
x AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (illegal) AS illegal FROM d GROUP BY 1)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    z.v.c AS cost, z.v.a AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM z LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM z.conv_id""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
