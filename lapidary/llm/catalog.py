"""The corpus queries over the given tables, and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, language_id, lexical_search, pii, quality, quotes, resampling, secret_scan, suffix_dedup, warc
from lapidary.llm.common import crc_bucket, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), keep="none", with_text=False)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", crc_bucket() == 2)
    model = language_id.fit(docs.filter("NOT held_out"))
    found = language_id.predicted(docs.select("doc_id", "held_out", "text"), model)
    return found.drop("text")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_classes(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(crc_bucket() != 2))
    return quality.scored(docs.select("doc_id", (crc_bucket() == 2).alias("held_out"), "text"), model).drop("text")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found_spans(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.decisions(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.linked_messages(table(spark, sf_dir, "conversations"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with what each kind counts."""
    return secret_scan.found_secrets(table(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return lexical_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark, and its rank among the quarter that is drawn."""
    return resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_warc": op2_warc,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_quality": op5_quality,
    "op6_pii": op6_pii,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_decontamination": op9_decontamination,
    "op10_quotes": op10_quotes,
    "op11_secrets": op11_secrets,
    "op12_search": op12_search,
    "op13_resampling": op13_resampling,
}

WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""



def either_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.islower() else c for c in words)


ASSIGN_SQL = either_case("(?:password|passwd|secret|token|api_?key)") + r"""["'']?\x20*[:=]\x20*["'']?"""
#: For each kind: its number, its expression, its last group, and the check of (m: the match, v: the last group).
SECRETS_SQL = [
    (0, ASSIGN_SQL, "[A-Za-z0-9+/_.=-]+", "len(v) >= 6"),
    (1, "AKIA", "[A-Z0-9]+", "len(m) >= 20"),
    (2, "", "[0-9a-f]+", "len(m) >= 24"),
    (3, "gh[pousr]_", "[A-Za-z0-9]+", "len(v) = 36"),
    (4, "npm_", "[A-Za-z0-9]+", "len(v) = 36"),
    (5, "AGE-SECRET-KEY-1", "[A-Z0-9]+", "len(v) = 58"),
]
#: The CRC-32 of one byte more, for each low byte of the register.
CRC_SQL = "SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) t(i)"


def hex_digit(at: str) -> str:
    return f"(strpos('0123456789ABCDEF', substr(x, {at}, 1)) - 1)"


def crc_steps(source: str) -> str:
    """A recursive table (g, x, p, s): the CRC-32 register s after p bytes of g, whose bytes are x in hexadecimal."""
    return f"""SELECT g, x, 0::BIGINT AS p, 4294967295::BIGINT AS s FROM {source}
  UNION ALL SELECT g, x, p + 1, xor(s >> 8, lut.v) FROM c JOIN lut ON lut.i = xor(s, 16 * {hex_digit("2 * p + 1")} + {hex_digit("2 * p + 2")}) & 255 WHERE 2 * p < len(x)"""


SQL = {
    "op1_suffix_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, h, unnest(range(0, greatest(0, len(h) // 2 - 199))) AS p FROM d),
k AS (SELECT r, p, md5_number(substr(h, 2 * p + 1, 400)) AS m FROM w),
x AS (SELECT r, p FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)),
g AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 200 THEN 0 ELSE 1 END AS new FROM x),
i AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS n FROM g),
s AS (SELECT r, n, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY r, n),
q AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM s),
c AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS e, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS front FROM q JOIN d USING (r) GROUP BY r)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN c.r IS NULL THEN h ELSE front || substr(h, 2 * e + 1) END)) AS kept_sha256
FROM d LEFT JOIN c USING (r)
""",
    "op4_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
s AS (SELECT r, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE c >= 0.8 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(x, y) AS (SELECT r, r FROM d UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y),
k AS (SELECT x, min(doc_id) AS class_id, count(*) AS class_size FROM reach JOIN d ON d.r = y GROUP BY x)
SELECT d.doc_id, k.class_id, (SELECT count(*) FROM e WHERE e.x = d.r) AS n_links, k.class_size FROM d JOIN k ON k.x = d.r
""",
    "op9_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
i AS (SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: w[i:i + 9])) AS v FROM b WHERE len(w) > 0),
v AS (SELECT item_id, len(v) AS n, array_to_string(v, ' ') AS s FROM i),
a AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM v)),
h AS (SELECT a.r, a.n, a.p, v.item_id FROM a JOIN d ON d.r = a.r JOIN v ON v.n = a.n AND v.s = array_to_string(d.w[a.p:a.p + a.n - 1], ' ')),
x AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (r) LEFT JOIN t USING (r)
""",
    "op7_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
""",
    "op11_secrets": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
e AS ({" UNION ALL ".join(f"SELECT r, {k} AS k, regexp_extract_all(t, '(?s)(.*?)({a}({b}))', 1) AS g, regexp_extract_all(t, '(?s)(.*?)({a}({b}))', 2) AS m, regexp_extract_all(t, '(?s)(.*?)({a}({b}))', 3) AS v FROM d" for k, a, b, _ in SECRETS_SQL)}),
u AS (SELECT r, k, unnest(range(len(m))) AS i, unnest(g) AS g, unnest(m) AS m, unnest(v) AS v FROM e),
p AS (SELECT r, k, m, v, sum(len(g) + len(m)) OVER (PARTITION BY r, k ORDER BY i) AS b FROM u),
s AS (SELECT r, k, m, v, (b - len(m))::BIGINT AS a, b::BIGINT AS b FROM p WHERE CASE k {" ".join(f"WHEN {k} THEN {check}" for k, _, _, check in SECRETS_SQL)} END),
lut AS ({CRC_SQL}),
c AS ({crc_steps("(SELECT DISTINCT substr(v, 1, 30) AS g, hex(encode(substr(v, 1, 30))) AS x FROM s WHERE k IN (3, 4))")}),
crc AS (SELECT g, xor(s, 4294967295) AS n FROM c WHERE 2 * p = len(x)),
n AS (SELECT g, array_to_string(list_transform([916132832, 14776336, 238328, 3844, 62, 1], lambda d: substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', (n // d % 62 + 1)::BIGINT, 1)), '') AS digits FROM crc),
age AS (SELECT DISTINCT v, list_concat(list_concat(list_transform(range(1, 16), lambda i: ascii(substr('age-secret-key-', i, 1)) >> 5), [0]), list_concat(list_transform(range(1, 16), lambda i: ascii(substr('age-secret-key-', i, 1)) & 31), list_transform(range(1, 59), lambda i: strpos('qpzry9x8gf2tvdw0s3jn54khce6mua7l', lower(substr(v, i, 1))) - 1))) AS q FROM s WHERE k = 5),
ages AS (SELECT v, list_reduce(list_prepend(1::BIGINT, list_transform(q, lambda y: y::BIGINT)), lambda h, y: xor(xor((h & 33554431) << 5, y), list_reduce([0::BIGINT, CASE WHEN (h >> 25) & 1 = 1 THEN 996825010 ELSE 0 END, CASE WHEN (h >> 26) & 1 = 1 THEN 642813549 ELSE 0 END, CASE WHEN (h >> 27) & 1 = 1 THEN 513874426 ELSE 0 END, CASE WHEN (h >> 28) & 1 = 1 THEN 1027748829 ELSE 0 END, CASE WHEN (h >> 29) & 1 = 1 THEN 705979059 ELSE 0 END], lambda o, z: xor(o, z)))) AS residue FROM age WHERE NOT list_contains(q, -1)),
f AS (SELECT r, k, a, b FROM s WHERE k < 3 OR (k < 5 AND EXISTS (SELECT 1 FROM n WHERE n.g = substr(s.v, 1, 30) AND n.digits = substr(s.v, 31, 6))) OR (k = 5 AND EXISTS (SELECT 1 FROM ages WHERE ages.v = s.v AND residue = 1))),
o AS (SELECT r, k, a, ['assign', 'access', 'hex', 'github', 'npm', 'age'][k + 1] || ':' || a || ':' || b AS x FROM f),
z AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k > 2) AS n_checked,
  string_agg(x, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(x, ',' ORDER BY a, k) AS spans FROM o GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_checked, 0) AS n_checked, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN z USING (r)
""",
    "op12_search": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {WORDS_SQL} AS w FROM benchmark),
i AS (SELECT DISTINCT q, unnest(w) AS t FROM b),
z AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY r, t),
wt AS (SELECT t, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS wt FROM tf, z GROUP BY t, big_n),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(w) * big_n) // big_l AS m FROM d, z WHERE len(w) > 0),
s AS (SELECT q, r, sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (r) GROUP BY q, r),
k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k JOIN b USING (q) WHERE rank <= 10
""",
    "op13_resampling": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT {WORDS_SQL} AS w FROM benchmark),
f AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM d
  UNION ALL SELECT NULL, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) FROM b),
lut AS ({CRC_SQL}),
c AS ({crc_steps("(SELECT DISTINCT g, hex(encode(g)) AS x FROM f)")}),
k AS (SELECT g, xor(s, 4294967295) % 10000 AS k FROM c WHERE 2 * p = len(x)),
n AS (SELECT k, count(r) AS s, count(*) - count(r) AS t FROM f JOIN k USING (g) GROUP BY k),
a AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM n),
v AS (SELECT k, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM n, a),
w AS (SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN k USING (g) JOIN v USING (k) WHERE r IS NOT NULL GROUP BY r),
h AS (SELECT d.r, doc_id, len(d.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  list_reduce(list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), i, 1)) - 1), lambda x, y: 16 * x + y) AS h FROM d LEFT JOIN w ON w.r = d.r),
e AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, n_words >= 20 AS able FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id ASC NULLS LAST, n_features) AS rank, count(*) OVER (PARTITION BY able) AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND rank <= 25 * n // 100 THEN rank END AS rank FROM o
""",
}
