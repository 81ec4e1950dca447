"""One registered query per operator, and the SQL that some are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkledger.llm import decontam, licences, lm, mixing, neardup, passages, pii, quality, search, sharding, topk, variants, warc
from talkledger.llm.common import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SHARDS = 64
SLOTS = sharding.table_size(SHARDS)
_FILLED = ",".join(map(str, sharding.filled_table([f"shard-{k:05d}" for k in range(SHARDS)], SLOTS)))

OP1 = f"""
WITH filled AS (SELECT string_split('{_FILLED}', ',') AS names),
placed AS (SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, printf('shard-%05d', CAST(names[slot + 1] AS INTEGER)) AS shard FROM placed, filled"""


@query("op1_sharding", OP1)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(sha, {5 * g + 1}, 5)) AS BIGINT) >> {15 - 5 * k}) & 31 AS INTEGER), 1)"
    for g in range(8) for k in range(4)
)
OP2 = f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM hashed)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts"""


@query("op2_warc", OP2)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "archive")
    warc.write(table(spark, folder, "pages"), path)
    return warc.page_records(warc.read(spark, path))


@query("op3_quality")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_personal_data")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"))
    return found.select(
        "doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans"
    )


@query("op5_mixing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query("op6_language_model")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scores(table(spark, folder, "documents"))


OP7 = r"""
WITH RECURSIVE tokens AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM tokens WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM reach r JOIN both_ways e ON e.a = r.y),
least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least l ON l.x = d.doc_id"""


@query("op7_near_duplicates", OP7)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


# 11 of 13 equal places leave a run of four: runs of four find every alignment
OP8 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) > 3),
tp AS (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM t WHERE len(w) > 3),
dg AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM dp),
tg AS (SELECT item_id, i, array_to_string(list_slice(w, i, i + 3), ' ') AS g FROM tp),
lines AS (SELECT DISTINCT doc_id, item_id, dg.i - tg.i AS shift FROM dg JOIN tg ON dg.g = tg.g),
starts AS (SELECT doc_id, item_id, shift, d.w AS dw, t.w AS tw, unnest(range(1, len(t.w) - 11)) AS s
  FROM lines JOIN d USING (doc_id) JOIN t USING (item_id) WHERE len(t.w) >= 13),
inside AS (SELECT doc_id, item_id, s + shift - 1 AS place,
    list_sum(list_transform(range(0, 13), lambda k: CASE WHEN dw[s + shift + k] = tw[s + k] THEN 1 ELSE 0 END)) AS agreeing
  FROM starts WHERE s + shift >= 1 AND s + shift + 12 <= len(dw))
SELECT doc_id, item_id, CAST(max(agreeing) AS BIGINT) AS agreeing, CAST(min(place) AS BIGINT) AS place
FROM inside WHERE agreeing >= 11 GROUP BY doc_id, item_id"""


@query("op8_decontamination", OP8)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP9 = """
WITH v AS (SELECT row_number() OVER () AS no, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT no, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM v),
scores AS (SELECT q.no, q.vec_id AS query_id, c.no AS other, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.k = c.k AND q.no <> c.no WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY no ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= 5"""


@query("op9_top_k", OP9)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    x = f"lower(coalesce({text}, ''))"
    x = f"regexp_replace({x}, {_quoted(licences.COPYRIGHT_LINE)}, '\\1', 'g')"
    x = f"replace(regexp_replace(' ' || {x} || ' ', '[^\\p{{L}}\\p{{N}}\\n]+', '  ', 'g'), chr(10), '  ' || chr(10) || '  ')"
    for old, new in licences.SPELLINGS.items():
        x = f"replace({x}, {_quoted(f' {old} ')}, {_quoted(f' {new} ')})"
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"


def _whole_sql(text: str, pattern: str) -> str:
    x = f"regexp_replace(replace(lower(coalesce({text}, '')), chr(13), ''), {_quoted(pattern)}, '\\1', 'g')"
    x = f"regexp_replace(' ' || {x} || ' ', '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')"
    for old, new in licences.SPELLINGS.items():
        x = f"replace({x}, {_quoted(f' {old} ')}, {_quoted(f' {new} ')})"
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'))"


_ONE_LINE = "trim(regexp_replace({}, '[ \\n]+', ' ', 'g'))"
_KNOWN = ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, texts in licences.NOTICES.items() for t in texts)
OP10 = f"""
WITH texts AS (SELECT * FROM (VALUES {_KNOWN}) AS k(licence, text)),
known AS (SELECT sha256(t) AS digest, min(licence) AS licence FROM (SELECT licence, {_whole_sql('text', licences.CLAIM_LINE)} AS t FROM texts
  UNION ALL SELECT licence, {_whole_sql('text', licences.CLAIM_PARAGRAPH)} FROM texts) WHERE t <> '' GROUP BY 1),
whole AS (SELECT doc_id, {_canonical_sql('text')} AS lines, sha256({_whole_sql('text', licences.CLAIM_LINE)}) AS digest,
  sha256({_whole_sql('text', licences.CLAIM_PARAGRAPH)}) AS other FROM documents),
parts AS (SELECT doc_id, digest AS own_digest, sha256(trim(unnest(string_split(lines, chr(10))))) AS digest FROM whole),
found AS (SELECT doc_id, own_digest, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences
  FROM parts JOIN known USING (digest) GROUP BY 1, 2)
SELECT w.doc_id, w.digest, coalesce(k.licence, p.licence) AS licence, coalesce(f.n, 0) AS n_licence_lines, coalesce(f.licences, '') AS line_licences
FROM whole w LEFT JOIN known k ON k.digest = w.digest LEFT JOIN known p ON p.digest = w.other LEFT JOIN found f ON f.doc_id = w.doc_id AND f.own_digest = w.digest"""


@query("op10_licence_scan", OP10)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"), licences.published(spark))


# one deleted letter leads to the same rest at the same place (replaced) or to the other word (inserted)
OP11 = r"""
WITH RECURSIVE table_steps AS (SELECT range AS i, range AS v, 0 AS k FROM range(256) UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM table_steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM table_steps WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2),
    lambda k: CAST(('0x' || substr(x, CAST(2 * k + 1 AS INTEGER), 2)) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1]))) AS h
  FROM counted, crc_table),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word,
  n FROM hashed),
vocabulary AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, CAST(i AS INTEGER) - 1) || substr(word, CAST(i AS INTEGER) + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocabulary b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocabulary b ON a.rest = b.word),
best AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS r FROM near),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * v.n THEN other END AS form, CASE WHEN b.n >= 10 * v.n THEN b.n END AS form_n
  FROM vocabulary v LEFT JOIN best b ON b.word = v.word AND r = 1),
chains AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, root FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN ends USING (word)"""


@query("op11_spelling_variants", OP11)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return variants.variants(table(spark, folder, "documents"))


OP12 = r"""
WITH tokens AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM tokens WHERE len(w) >= 50)),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
gone AS (SELECT doc_id, i FROM windows JOIN firsts USING (g) WHERE first < doc_id),
places AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM tokens),
last AS (SELECT p.doc_id, p.word, p.i, max(g.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS begun
  FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM last WHERE begun IS NULL OR i - begun >= 50 GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM tokens t LEFT JOIN kept k ON k.doc_id = t.doc_id"""


@query("op12_repeated_passages", OP12)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return passages.without_repeats(table(spark, folder, "documents"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
OP13 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
lengths AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
totals AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS length FROM lengths),
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term),
items AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, totals GROUP BY term, documents),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // length)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50"""


@query("op13_lexical_search", OP13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
