"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import conversations, gam, jaccard, kd_shard, langid, packing, pieces, quality, secret_scan, spelling, store, substring, topk
from tessera.llm._util import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    # all read off the text, so that equal texts are one point
    dims = {"length": F.octet_length(text), "lines": lines, "wide": F.octet_length(text) - F.length(text)}
    got = kd_shard.kd_shards(docs, dims, shards=24)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.fold() == 2, F.lit(False))
    model = langid.train(docs, ~held_out)
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.split_documents(_table(spark, sf_dir, "documents"))
    return packing.bucket_sequences(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pieces.encode_documents(_table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.xxhash64("begins", "ends").alias("spans_hash"),
    )


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "store")
    store.write_store(_table(spark, sf_dir, "documents"), path)
    return store.read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("secrets", lambda s: s["rank"] < len(secret_scan.BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(r.kind) for r in secret_scan.BASE_RULES), F.sha2(secret_scan.listed(base), 256).alias("base_sha256"), secret_scan.listed(F.col("secrets")).alias("spans"))


def op6_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).drop("text")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults put in by a hash of conv_id and turn; nulls count as one space, but in the order of turns."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    hit = F.pmod(F.crc32(key), F.lit(20))
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(hit == 4, "user").otherwise(role)
    times = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    got = conversations.report(conversations.repair(damaged(rows))).withColumnRenamed("conv_id", "_conv")
    ids = rows.select("conv_id").distinct()
    longs = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = ids.join(got, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = gam.train(docs, _table(spark, sf_dir, "labels"), allowed=langid.fold() != 2)
    held_out = F.coalesce(langid.fold() == 2, F.lit(False))
    return gam.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


#: Kind, expression, group that has a least length, and that length: written out, so that a wrong rule of the operator shows.
_SECRETS = (
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"\']?\\x20*[:=]\\x20*[\"\']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", "xox[abprs]-[0-9A-Za-z-]{10,}", 0, 1),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
_BASE_KINDS = 3


def _secret_sql() -> str:
    """Matches by regexp_extract_all; places from the lengths of what lies before each."""
    one = """SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(range(1, len(ms) + 1)) AS i, ms, gs, vs FROM (
      SELECT doc_id, regexp_extract_all(t, '{re}') AS ms, string_split_regex(t, '{re}') AS gs, regexp_extract_all(t, '{re}', {group}) AS vs FROM d)"""
    parts = " UNION ALL ".join(one.format(kind=kind, rank=k, re=re.replace("'", "''"), group=group) for k, (kind, re, group, _) in enumerate(_SECRETS))
    least = " ".join(f"WHEN {k} THEN {n}" for k, (*_, n) in enumerate(_SECRETS))
    base = [kind for kind, *_ in _SECRETS[:_BASE_KINDS]]
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in base)
    zeros = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in base)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({parts}), s AS (
      SELECT doc_id, kind, rank, coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS b, length(ms[i]) AS n
      FROM m WHERE length(vs[i]) >= CASE rank {least} END), t AS (SELECT doc_id, kind, rank, b::BIGINT AS b, kind || ':' || b::BIGINT || ':' || (b + n)::BIGINT AS span FROM s),
    g AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY b, rank) FILTER (rank < {_BASE_KINDS}) AS base, string_agg(span, ',' ORDER BY b, rank) AS spans FROM t GROUP BY doc_id)
    SELECT d.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kd_shards": op1_kd_shards,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_token_store": op5_token_store,
    "op6_pivot_top_k": op6_pivot_top_k,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_quality_classifier": op13_quality_classifier,
}

_TOP_K_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_WORDS = "[^\\x20\\x09-\\x0D]+"
_JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents),
x AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
g AS (SELECT doc_id, n, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS shingle FROM x),
s AS (SELECT DISTINCT doc_id, shingle FROM g WHERE pos + 4 <= n OR (n < 4 AND pos = 0)),
c AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT i, j FROM p JOIN c a ON i = a.doc_id JOIN c b ON j = b.doc_id WHERE 100 * p.k >= 85 * (a.k + b.k - p.k)),
r AS (SELECT doc_id AS i, doc_id AS root FROM documents UNION SELECT e.j, r.root FROM r JOIN e ON r.i = e.i)
SELECT d.doc_id, coalesce(c.k, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id JOIN (SELECT i, min(root) AS component_id FROM r GROUP BY i) m ON d.doc_id = m.i"""
_SUBSTRING_SQL = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
x AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
g AS (SELECT *, CASE WHEN pos + 35 <= n THEN string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) END AS win FROM x),
c AS (SELECT win FROM g WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
d AS (SELECT g.doc_id, g.pos, g.word, c.win IS NOT NULL AS twice FROM g LEFT JOIN c ON g.win = c.win),
r AS (SELECT *, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM d),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM r GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON w.doc_id = k.doc_id"""


def _crc_sql(key: str) -> str:
    """Unsigned crc32 of an expression's UTF-8 bytes, with the table that `t` holds."""
    hexed = f"hex(encode({key}))"
    data = f"list_transform(range(1, length({hexed}), 2), lambda p: (16 * (instr('0123456789ABCDEF', substr({hexed}, p, 1)) - 1) + instr('0123456789ABCDEF', substr({hexed}, p + 1, 1)) - 1)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_CRC_TABLE = """tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _repair_sql() -> str:
    """The cheapest edits row by row, each state's best list as its cost of nine digits and its edits, coded so that they sort as their initials."""

    def more(s: str, cost: str, code: str) -> str:
        return f"lpad((substr({s}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({s}, 10) || '{code}'"

    never, pen = "'999999000'", "(CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END)"
    kept = lambda i, *froms: f"CASE WHEN stays AND init = '{i}' THEN least({', '.join(more(s, pen, '4') for s in froms)}) ELSE {never} END" if len(froms) > 1 else f"CASE WHEN stays AND init = '{i}' THEN {more(froms[0], pen, '4')} ELSE {never} END"
    to = lambda code, *froms: " , ".join(f"CASE WHEN stays THEN {more(s, '1 + ' + pen, code)} ELSE {never} END" for s in froms)
    return f"""WITH RECURSIVE {_CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS h FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN h = 0 THEN 0 WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS init FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
  init || lead(init) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM o),
e AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays FROM f),
s AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM e GROUP BY conv_id),
r AS (SELECT conv_id, 0::BIGINT AS i, '000000000' AS n0, {never} AS s0, {more("'000000000'", '5', '2')} AS u0, {more("'000000000'", '10', '23')} AS a0 FROM s
  UNION ALL SELECT conv_id, i, n2, s2, least(u2, {more('a2', '5', '2')}), least(a2, {more('u2', '5', '3')}) FROM (
    SELECT conv_id, i, n1 AS n2, s1 AS s2, least(u1, {more('n1', '5', '2')}, {more('s1', '5', '2')}, {more('a1', '5', '2')}) AS u2, least(a1, {more('u1', '5', '3')}) AS a2 FROM (
      SELECT r.conv_id, e.i, {more('n0', '2', '1')} AS n1, least({more('s0', '2', '1')}, {kept('s', 'n0')}) AS s1,
        least({more('u0', '2', '1')}, {kept('u', 'n0', 's0', 'a0')}, {to('5', 'n0', 's0', 'a0')}) AS u1, least({more('a0', '2', '1')}, {kept('a', 'u0')}, {to('6', 'u0')}) AS a1
      FROM r JOIN e ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = r.i + 1))),
z AS (SELECT r.conv_id, least(n0, a0) AS best FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.i = s.n),
c AS (SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS code, unnest(range(length(best) - 9)) AS pos FROM z),
q AS (SELECT *, sum(CASE WHEN code IN ('2', '3') THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM c),
p AS (SELECT q.conv_id, string_agg(CASE code WHEN '2' THEN 'user:' WHEN '3' THEN 'assistant:' WHEN '5' THEN 'user:' || text WHEN '6' THEN 'assistant:' || text ELSE role || ':' || text END, chr(10) ORDER BY pos) FILTER (code <> '1') AS lines
  FROM q LEFT JOIN e ON q.conv_id IS NOT DISTINCT FROM e.conv_id AND q.i = e.i GROUP BY q.conv_id)
SELECT a.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(substr(best, 1, 9)::BIGINT, 0) AS cost, coalesce(translate(substr(best, 10), '123456', 'DIIKRR'), '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON a.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN z ON a.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN p ON a.conv_id IS NOT DISTINCT FROM p.conv_id"""


_SPELLING_SQL = f"""WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
g AS (SELECT id, run, count(*) AS k FROM r WHERE length(run) >= 5 GROUP BY id, run),
h AS (SELECT run, k, {_crc_sql("(id || ':' || run)")} AS h FROM g, tab),
d AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
v AS (SELECT word, n, pos, left(word, pos) || substr(word, pos + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS pos FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON a.pos = b.pos AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.rest = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.rest = w.word),
c AS (SELECT word, count(*) AS n_near FROM p GROUP BY word),
b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM p),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM w LEFT JOIN c ON w.word = c.word LEFT JOIN b ON w.word = b.word AND place = 1),
t AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON t.next = f.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON f.word = t.word AND t.next IS NULL"""

ORACLE_SQL: dict[str, str] = {
    "op6_pivot_top_k": _TOP_K_SQL,
    "op7_secret_scan": _secret_sql(),
    "op9_jaccard_join": _JACCARD_SQL,
    "op10_substring_dedup": _SUBSTRING_SQL,
    "op11_conversation_repair": _repair_sql(),
    "op12_spelling_variants": _SPELLING_SQL,
}
