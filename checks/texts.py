"""Text, time and response columns (P, F, O5, J8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.registry import check
from talkledger import fixed_values as fixed
from talkledger.functions import responses as r
from talkledger.functions import text as t
from talkledger.functions import times
from talkledger.operators import matching
from talkledger.plans.evaluation import MapWords

D = "documents"
#: A small dictionary and pronunciation map over the alphabets of the documents.
WORDS = {"the": "THE", "and": "&", "les": "LES!", "und": "u.", "die": "der", "der": "die", "con": "c", "que": "q"}
SOUNDS = {"é": "e", "è": "e", "ê": "e", "c": "k", "ç": "k", "k": "k", "e": "e", "ü": "ue", "u": "ue", "ä": "ae", "ö": "oe"}
KEYWORDS = ["ekel", "tion", "unk", "zzz"]


def docs(spark, folder):
    return v.table(spark, folder, D)


def _sql_list(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


@check(
    "p1_recogniser_text",
    r"""WITH x AS (SELECT doc_id, CASE doc_id%4 WHEN 0 THEN concat('<|en|><|NEUTRAL|>', replace(text, ', ', '，、')) WHEN 1 THEN replace(text, ' ', '😀🚀')
  ELSE replace(text, '.', '。。！') END AS text FROM documents UNION ALL SELECT -1-doc_id, ' 。，！ ' FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<\|[^|]+\|>', '', 'g'),
  '[\x{1F300}-\x{1F9FF}\x{2600}-\x{27BF}\x{1F600}-\x{1F64F}\x{1F680}-\x{1F6FF}]+', '', 'g'), '[。，、！？；：]{2,}', '。', 'g'),
  '^\s*[。，、！？；：]+\s*$', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM x""",
)
def recogniser_text(spark, folder):
    d = docs(spark, folder)
    x = d.select(
        "doc_id",
        F.expr("CASE doc_id%4 WHEN 0 THEN concat('<|en|><|NEUTRAL|>', replace(text, ', ', '，、')) "
               "WHEN 1 THEN replace(text, ' ', '😀🚀') ELSE replace(text, '.', '。。！') END").alias("text"),
    ).unionByName(d.select((-1 - F.col("doc_id")).alias("doc_id"), F.lit(" 。，！ ").alias("text")))
    return x.select("doc_id", t.clean_recognised("text").alias("text"))


@check(
    "p2_noise_segments",
    r"""WITH w AS (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS word FROM documents),
c AS (SELECT doc_id, lang, regexp_replace(regexp_replace(translate(lower(word), '。，、！？；：.!?;,: ', '               '), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS c FROM w)
SELECT doc_id, lang, count(*) AS n_words, count(*) FILTER (c = '' OR c IN ("""
    + _sql_list(fixed.NOISE_WORDS_CN + fixed.NOISE_WORDS_EN)
    + """) OR len(list_filter(string_split(c, ' '), lambda x: x NOT IN ("""
    + _sql_list(fixed.NOISE_WORDS_EN)
    + """))) = 0) AS n_noise FROM c GROUP BY doc_id, lang""",
)
def noise_segments(spark, folder):
    words = docs(spark, folder).select("doc_id", "lang", F.explode(F.split("text", " ")).alias("word"))
    return t.computed(words, noise=t.is_noise("word")).groupBy("doc_id", "lang").agg(
        F.count(F.lit(1)).alias("n_words"), F.count_if("noise").alias("n_noise")
    )


@check(
    "p3_normalised_text",
    r"""WITH x AS (SELECT doc_id, CASE doc_id%5 WHEN 0 THEN concat('the The ', text) WHEN 1 THEN replace(text, 'e', '嗯嗯') WHEN 2 THEN replace(text, '. ', ' 二零二五年那个那个 ')
   ELSE text END AS text FROM documents UNION ALL SELECT -1-doc_id, CASE doc_id%2 WHEN 0 THEN substring('Um, 嗯啊 the okay.', 1 + doc_id%7) ELSE '嗯啊。' END FROM documents),
s AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS raw FROM x),
a AS (SELECT doc_id, raw, regexp_replace(regexp_replace(raw, '^\s*(?:the\s+)+', '', 'i'), '^\s+|\s+$', '', 'g') AS c FROM s),
b AS (SELECT doc_id, raw, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '(?:那个){2,}', '那个', 'g'), '嗯{2,}', '嗯', 'g'), '啊{2,}', '啊', 'g'), '哦{2,}', '哦', 'g'), '呃{2,}', '呃', 'g'), '二零二五', '2025') AS c FROM a),
d AS (SELECT doc_id, raw, c, regexp_replace(c, '[，。、！？；：,.!?;: ]', '', 'g') AS bare FROM b)
SELECT doc_id, CASE WHEN raw = '' OR regexp_matches(raw, '(?i)^(?:the\s+)*(?:the|a|an|yeah|yes|no|ok|okay|um|uh|oh|ah|er|hmm|hm|mm)\s*[，。,.]?\s*$')
  OR bare = '' OR regexp_matches(bare, '^[嗯啊哦呃唔嘿哈呵噢喔诶哎唉呀]{1,2}$') THEN NULL ELSE c END AS text FROM d""",
)
def normalised(spark, folder):
    d = docs(spark, folder)
    x = d.select(
        "doc_id",
        F.expr("CASE doc_id%5 WHEN 0 THEN concat('the The ', text) WHEN 1 THEN replace(text, 'e', '嗯嗯') "
               "WHEN 2 THEN replace(text, '. ', ' 二零二五年那个那个 ') "
               "ELSE text END").alias("text"),
    ).unionByName(d.select(
        (-1 - F.col("doc_id")).alias("doc_id"),
        F.expr("CASE doc_id%2 WHEN 0 THEN substring('Um, 嗯啊 the okay.', 1 + doc_id%7) ELSE '嗯啊。' END").alias("text"),
    ))
    return x.select("doc_id", t.normalise("text").alias("text"))


@check(
    "p4_dictionary_replacement",
    "WITH m AS (SELECT MAP {" + ", ".join(f"'{k}': '{w}'" for k, w in WORDS.items()) + r"""} AS d)
SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s)[0-9A-Za-z_]+|[^0-9A-Za-z_]'), lambda x: coalesce(d[lower(x)], x)), '') AS text
FROM documents, m""",
)
def dictionary(spark, folder):
    return docs(spark, folder).select("doc_id", t.replace_words("text", WORDS).alias("text"))


@check(
    "j8_homophone_keywords",
    """WITH x AS (SELECT doc_id, translate(text, 'éèêcçuüäö', 'eeekkUUAO') AS heard FROM documents)
SELECT doc_id, CASE WHEN contains(heard, 'ekel') THEN 'ekel' WHEN contains(heard, 'tion') THEN 'tion' WHEN contains(heard, 'Unk') THEN 'unk' END AS keyword FROM x""",
)
def homophones(spark, folder):
    words = F.array(*[F.lit(k) for k in KEYWORDS])
    return docs(spark, folder).select("doc_id", t.first_sounding_keyword("text", words, SOUNDS).alias("keyword"))


#: A dictionary out of the documents: words, two-word phrases, and words that begin or end with another letter.
DICTIONARY = r"""
tok AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[0-9A-Za-z_]+')) AS t FROM documents),
v_dictionary AS (SELECT DISTINCT lower(t) AS k, 1 AS n, concat('<', lower(t), '>') AS "right" FROM tok WHERE length(t) BETWEEN 6 AND 9
  UNION SELECT DISTINCT lower(k), 3, 'PHRASE' FROM (SELECT regexp_extract(text, '[0-9A-Za-z_]+ [0-9A-Za-z_]+') AS k FROM documents WHERE doc_id%2=0) WHERE k <> ''
  UNION SELECT DISTINCT k, 2, 'E+' FROM (SELECT unnest(regexp_extract_all(text, 'é[a-z]+')) AS k FROM documents) WHERE length(k) <= 5
  UNION SELECT DISTINCT lower(k), 2, 'E!' FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+é')) AS k FROM documents) WHERE length(k) <= 5)"""


def dictionary_table(spark, folder):
    d = docs(spark, folder)

    def every(pattern):
        found = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        return d.select(F.explode(found).alias("wrong"))

    words = every("(?<![0-9A-Za-z_])[0-9A-Za-z_]{6,9}+(?![0-9A-Za-z_])").distinct()
    words = words.withColumn("right", F.concat(F.lit("<"), F.lower("wrong"), F.lit(">")))
    phrases = d.where("doc_id % 2 = 0").select(F.regexp_extract("text", "[0-9A-Za-z_]+ [0-9A-Za-z_]+", 0).alias("wrong"), F.lit("PHRASE").alias("right"))
    begins = every("é[a-z]+").where(F.length("wrong") <= 5).withColumn("right", F.lit("E+"))
    ends = every("(?<![A-Za-z])[A-Za-z]++é").where(F.length("wrong") <= 5).withColumn("right", F.lit("E!"))
    return words.unionByName(phrases).unionByName(begins).unionByName(ends).distinct()


@check(
    "p4_dictionary_table",
    "WITH RECURSIVE " + DICTIONARY + r""",
spots AS (SELECT doc_id, unnest(u) AS u0, generate_subscripts(u, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s)[0-9A-Za-z_]+|[^0-9A-Za-z_]') AS u FROM documents)),
ahead AS (SELECT *, lead(u0) OVER w AS u1, lead(u0, 2) OVER w AS u2, lead(u0, 3) OVER w AS u3 FROM spots WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
runs AS (SELECT doc_id, i, 1 AS n, lower(u0) AS k, u0 AS last, coalesce(u1, '') AS next FROM ahead
  UNION ALL SELECT doc_id, i, 2, lower(u0 || u1), u1, coalesce(u2, '') FROM ahead WHERE u1 IS NOT NULL
  UNION ALL SELECT doc_id, i, 3, lower(u0 || u1 || u2), u2, coalesce(u3, '') FROM ahead WHERE u2 IS NOT NULL),
met AS (SELECT doc_id, i, max(n) AS n, arg_max("right", n) AS "right" FROM runs JOIN v_dictionary USING (k, n)
  WHERE regexp_matches(last, '[0-9A-Za-z_]$') OR NOT regexp_matches(next, '^[0-9A-Za-z_]') GROUP BY doc_id, i),
gaps AS (SELECT *, i >= coalesce(max(i + n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opens FROM met),
isles AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS isle FROM gaps),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, isle ORDER BY i) AS rn FROM isles),
walk AS (SELECT doc_id, isle, rn, i, n, "right", true AS taken, i + n AS done FROM placed WHERE rn = 1
  UNION ALL SELECT p.doc_id, p.isle, p.rn, p.i, p.n, p."right", p.i >= w.done, CASE WHEN p.i >= w.done THEN p.i + p.n ELSE w.done END
  FROM walk w JOIN placed p ON p.doc_id = w.doc_id AND p.isle = w.isle AND p.rn = w.rn + 1),
shown AS (SELECT a.doc_id, a.i, CASE WHEN w.i IS NOT NULL THEN w."right" WHEN a.i < coalesce(max(w.done) OVER (PARTITION BY a.doc_id ORDER BY a.i), 0) THEN '' ELSE a.u0 END AS part
  FROM spots a LEFT JOIN walk w ON w.doc_id = a.doc_id AND w.i = a.i AND w.taken)
SELECT doc_id, string_agg(part, '' ORDER BY i) AS text FROM shown GROUP BY doc_id""",
)
def dictionary_as_table(spark, folder):
    d = docs(spark, folder).select("doc_id", "text")
    return matching.replace_from_table(d, ["doc_id"], dictionary_table(spark, folder))


_ACCENTS, _BASES = "éèêëàâîïôùûüçñáíóúöäß", "eeeeaaiiouuucnaiouoas"


@check(
    "j8_keyword_table",
    f"""WITH x AS (SELECT doc_id, translate(lower(text), '{_ACCENTS}', '{_BASES}') AS heard, substring(text, 5, 4) AS keyword FROM documents),
k AS (SELECT keyword, min(heard_keyword) AS h, min(doc_id) AS place FROM (SELECT keyword, translate(lower(keyword), '{_ACCENTS}', '{_BASES}') AS heard_keyword, doc_id FROM x) WHERE keyword <> '' GROUP BY keyword)
SELECT x.doc_id, arg_min(k.keyword, (k.place, k.keyword)) AS keyword FROM x JOIN k ON contains(x.heard, k.h) GROUP BY x.doc_id""",
)
def keyword_table(spark, folder):
    d = docs(spark, folder).select("doc_id", "text")
    letters = d.select(F.explode(F.array_distinct(F.split("text", ""))).alias("char")).where("char rlike '[A-Za-zÀ-ÿ]'").distinct()
    # u and ü sound alike and take two letters, all others their plain letter
    plain = F.translate(F.lower("char"), _ACCENTS, _BASES)
    sounds = letters.withColumn("sound", F.when(plain == "u", "ue").otherwise(plain))
    words = d.select(F.col("doc_id").alias("place"), F.substring("text", 5, 4).alias("keyword"))
    return matching.first_keywords(d, words, ["doc_id"], "text", sounds)


@check(
    "o5_first_keyword_match",
    """WITH x AS (SELECT doc_id, text, regexp_extract(text, 'tion|the|schl|eau') AS word FROM documents)
SELECT doc_id, word, strpos(text, word) AS at, substring(text, greatest(strpos(text, word) - 80, 1), strpos(text, word) + 80 - greatest(strpos(text, word) - 80, 1)) AS context
FROM x WHERE word <> ''""",
)
def first_match(spark, folder):
    words = F.array(*[F.lit(k) for k in ("tion", "the", "schl", "eau")])
    x = docs(spark, folder).withColumn("_hit", t.first_keyword("text", words)).where(F.col("_hit").isNotNull())
    return x.select(
        "doc_id", F.col("_hit.word").alias("word"), F.col("_hit.at").cast("long").alias("at"),
        t.around("text", F.col("_hit.at")).alias("context"),
    )


@check("p17_truncated_text", "SELECT doc_id, substring(text, 1, 5000) AS text FROM documents")
def truncated(spark, folder):
    return docs(spark, folder).select("doc_id", t.truncated("text", 5000).alias("text"))


@check(
    "p14_speaker_labels",
    "WITH " + v.SEGMENTS + """
SELECT recording_id, seg_idx, CASE WHEN speaker - 1 >= 0 THEN concat('Speaker ', speaker) ELSE 'Speaker 1' END AS label FROM v_segments""",
)
def labels(spark, folder):
    s = v.segments(spark, folder, v.SLICE)
    return s.select("recording_id", "seg_idx", times.speaker_label(F.col("speaker") - 1).alias("label"))


@check(
    "f1_f2_time_formats",
    "WITH " + v.TIMELINE + """
SELECT seq, printf('%02d:%02d', timestamp_ms//60000, (timestamp_ms//1000)%60) AS mmss,
  CASE WHEN timestamp_ms >= 3600000 THEN printf('%02d:%02d:%02d', timestamp_ms//3600000, (timestamp_ms//60000)%60, (timestamp_ms//1000)%60)
    ELSE printf('%02d:%02d', timestamp_ms//60000, (timestamp_ms//1000)%60) END AS clock,
  printf('%02d:%02d:%02d,%03d', timestamp_ms//3600000, (timestamp_ms//60000)%60, (timestamp_ms//1000)%60, timestamp_ms%1000) AS srt FROM v_timeline""",
)
def time_formats(spark, folder):
    ms = F.col("timestamp_ms")
    return v.timeline(spark, folder).select(
        "seq", times.minutes_seconds(ms).alias("mmss"), times.clock(ms).alias("clock"), times.subtitle_time(ms).alias("srt")
    )


@check(
    "f3_time_parsing",
    "WITH " + v.TIMELINE + """,
x AS (SELECT seq, timestamp_ms//1000 AS s FROM v_timeline)
SELECT seq, CAST(CASE seq%4 WHEN 0 THEN s*1000 WHEN 1 THEN s*1000 ELSE 0 END AS BIGINT) AS ms FROM x""",
)
def time_parsing(spark, folder):
    ms = F.col("timestamp_ms")
    shown = (
        F.when(F.col("seq") % 4 == 0, F.concat(F.lit(" "), times.minutes_seconds(ms)))
        .when(F.col("seq") % 4 == 1, F.regexp_replace(times.subtitle_time(ms), ",.*", ""))
        .when(F.col("seq") % 4 == 2, F.concat(F.lit("x"), times.minutes_seconds(ms)))
        .otherwise(F.lit("1:2:3:4"))
    )
    return v.timeline(spark, folder).select("seq", times.parse_time(shown).alias("ms"))


@check(
    "f4_safe_numbers",
    "WITH " + v.TIMELINE + """,
x AS (SELECT seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM v_timeline)
SELECT seq, CAST(CASE seq%5 WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN k WHEN 3 THEN 0 ELSE 0 END AS BIGINT) AS as_int,
  CAST(CASE seq%5 WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN k + 0.75 WHEN 3 THEN k + 0.5 ELSE 0.5 END AS DOUBLE) AS as_float FROM x""",
)
def safe_numbers(spark, folder):
    k = F.get_json_object("props", "$.k")
    made = F.expr("CASE seq%5 WHEN 0 THEN props ELSE '' END")
    made = (
        F.when(F.col("seq") % 5 == 0, F.col("props"))
        .when(F.col("seq") % 5 == 1, F.format_string('{"k": "%s"}', k))
        .when(F.col("seq") % 5 == 2, F.format_string('{"k": %s.75}', k))
        .when(F.col("seq") % 5 == 3, F.format_string('{"k": "%s.5"}', k))
        .otherwise(F.lit('{"k": null}'))
    )
    x = v.timeline(spark, folder).select("seq", r.field(r.parsed(made), "k").alias("_k"))
    return x.select("seq", r.safe_int(F.col("_k")).alias("as_int"), r.safe_float(F.col("_k"), 0.5).alias("as_float"))


@check(
    "f5_think_blocks",
    r"""SELECT doc_id, CASE doc_id%4 WHEN 0 THEN concat(text, 'end') WHEN 1 THEN left(text, 20) WHEN 2 THEN substring(text, 21) ELSE text END AS text FROM documents""",
)
def think_blocks(spark, folder):
    x = F.expr(
        "CASE doc_id%4 WHEN 0 THEN concat('<think>a</think>', text, '<think>\nb</think>end') "
        "WHEN 1 THEN concat(left(text, 20), '<think>', substring(text, 21)) "
        "WHEN 2 THEN concat(left(text, 20), '</think>', substring(text, 21)) ELSE text END"
    )
    return docs(spark, folder).select("doc_id", r.strip_thinking(x).alias("text"))


PAGES = """x AS (SELECT page_id, CASE page_id%3 WHEN 0 THEN concat('ok ```json ', html, '```') WHEN 1 THEN html ELSE regexp_replace(html, '[{}\\[\\]]', '', 'g') END AS raw FROM pages),
b AS (SELECT page_id, regexp_replace(replace(replace(raw, '```json', ''), '```', ''), '^\\s+|\\s+$', '', 'g') AS t FROM x)"""
PAGE_RAW = (
    "CASE page_id%3 WHEN 0 THEN concat('ok ```json ', html, '```') WHEN 1 THEN html "
    "ELSE regexp_replace(html, '[{}\\\\[\\\\]]', '') END"
)


@check(
    "f6_json_object_text",
    "WITH " + PAGES + """,
c AS (SELECT page_id, CASE WHEN strpos(t, '{') > 1 THEN substring(t, strpos(t, '{')) ELSE t END AS t FROM b)
SELECT page_id, regexp_replace(CASE WHEN strpos(t, '}') > 0 THEN left(t, length(t) - strpos(reverse(t), '}') + 1) ELSE t END, '^\\s+|\\s+$', '', 'g') AS body FROM c""",
)
def object_text(spark, folder):
    return v.table(spark, folder, "pages").select("page_id", r.json_object_text(F.expr(PAGE_RAW)).alias("body"))


@check(
    "f7_json_array_text",
    "WITH " + PAGES + """
SELECT page_id, CASE WHEN strpos(t, '[') > 0 AND length(t) - strpos(reverse(t), ']') + 1 > strpos(t, '[') AND strpos(t, ']') > 0
    THEN substring(t, strpos(t, '['), length(t) - strpos(reverse(t), ']') + 2 - strpos(t, '['))
  WHEN strpos(t, '{') > 0 AND strpos(t, '}') > 0 AND length(t) - strpos(reverse(t), '}') + 1 > strpos(t, '{')
    THEN substring(t, strpos(t, '{'), length(t) - strpos(reverse(t), '}') + 2 - strpos(t, '{'))
  ELSE t END AS body FROM b""",
)
def array_text(spark, folder):
    return v.table(spark, folder, "pages").select("page_id", r.json_array_text(F.expr(PAGE_RAW)).alias("body"))


@check(
    "f8_findings_from_responses",
    "WITH " + v.TIMELINE + """,
x AS (SELECT seq, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM v_timeline WHERE seq%6 <> 5)
SELECT seq, CAST(CASE seq%6 WHEN 4 THEN 0 ELSE k END AS BIGINT) AS rule_id, CASE seq%6 WHEN 1 THEN event_type ELSE '' END AS speaker,
  CASE seq%6 WHEN 0 THEN 'high' ELSE 'low' END AS severity,
  CAST(CASE seq%6 WHEN 2 THEN 0.9 WHEN 3 THEN 0.25 ELSE 0.5 END AS DOUBLE) AS confidence,
  CASE seq%6 WHEN 2 THEN '01:02' ELSE '00:00' END AS "timestamp", CASE seq%6 WHEN 0 THEN event_type END AS reasoning
FROM x WHERE seq%6 IN (0,1,2,3)""",
)
def findings(spark, folder):
    k = F.get_json_object("props", "$.k")
    e = F.col("event_type")
    raw = (
        F.when(F.col("seq") % 6 == 0, F.format_string('<think>x</think>[{"rule_id": "%s", "severity": "HIGH", "reasoning": "%s"}, 7, "no"]', k, e))
        .when(F.col("seq") % 6 == 1, F.format_string('```json\n{"results": [{"rule_id": %s.9, "speaker": "%s", "severity": "awful"}]}```', k, e))
        .when(F.col("seq") % 6 == 2, F.format_string('{"rule_id": %s, "confidence": "0.9", "timestamp": "01:02"}', k))
        .when(F.col("seq") % 6 == 3, F.format_string('{"data": [{"rule_id": %s, "confidence": 0.25, "end_ms": "12.5"}]}', k))
        .when(F.col("seq") % 6 == 4, F.lit('{"other": 1}'))
        .otherwise(F.lit("no json"))
    )
    value = r.parsed(r.json_array_text(raw))
    x = v.timeline(spark, folder).select("seq", F.explode(r.finding_items(value)).alias("_i"))
    return x.withColumn("_f", r.finding(F.col("_i"))).select(
        "seq", "_f.rule_id", "_f.speaker", "_f.severity", "_f.confidence", "_f.timestamp", "_f.reasoning"
    )


@check(
    "f9_corrections_from_responses",
    "WITH " + v.TIMELINE + """,
x AS (SELECT seq, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM v_timeline WHERE seq%4 IN (0,1,2))
SELECT seq, k AS id, CASE seq%4 WHEN 2 THEN concat(event_type, '"', chr(10)) ELSE event_type END AS text FROM x""",
)
def corrections(spark, folder):
    k = F.get_json_object("props", "$.k")
    e = F.col("event_type")
    raw = (
        F.when(F.col("seq") % 4 == 0, F.format_string('{"entries": [{"id": %s, "text": "%s"}, {"id": "x", "text": "y"}, {"id": 1}]}', k, e))
        .when(F.col("seq") % 4 == 1, F.format_string('[{"id": %s, "text": "%s"}]', k, e))
        .when(F.col("seq") % 4 == 2, F.format_string('oops {"id" : %s , "text":"%s\\"\\n"} ...', k, e))
        .otherwise(F.lit("nothing"))
    )
    x = v.timeline(spark, folder).select("seq", F.explode(r.corrections(raw)).alias("_c"))
    return x.select("seq", "_c.id", "_c.text")


@check(
    "f10_evaluations_from_responses",
    "WITH " + v.TIMELINE + """,
x AS (SELECT seq, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM v_timeline)
SELECT seq, seq%4 < 3 AS readable, CASE WHEN seq%4 = 0 THEN event_type WHEN seq%4 < 3 THEN '' END AS title,
  CASE WHEN seq%4 = 1 THEN k WHEN seq%4 < 3 THEN 0 END AS total, CASE WHEN seq%4 = 2 THEN event_type WHEN seq%4 < 3 THEN '' END AS points,
  CASE WHEN seq%4 < 3 THEN 'S' END AS summary FROM x""",
)
def evaluations(spark, folder):
    k = F.get_json_object("props", "$.k")
    e = F.col("event_type")
    raw = (
        F.when(F.col("seq") % 4 == 0, F.format_string('Sure: {"meta": {"title": "%s"}, "summary": "S"} done', e))
        .when(F.col("seq") % 4 == 1, F.format_string('```json\n{"scores": {"total": %s}, "summary": "S"}\n```', k))
        .when(F.col("seq") % 4 == 2, F.format_string('{"analysis": {"main_points": ["%s"]}, "summary": "S"}', e))
        .otherwise(F.lit('{"scores": {"total": 3.5}}'))
    )
    x = v.timeline(spark, folder).select("seq", r.evaluation(raw).alias("_e"))
    return x.select(
        "seq", F.col("_e").isNotNull().alias("readable"), F.col("_e.meta.title").alias("title"),
        F.col("_e.scores.total").alias("total"), F.array_join("_e.analysis.main_points", ",").alias("points"), F.col("_e.summary").alias("summary"),
    )


@check("f11_output_budgets", "SELECT doc_id, CAST(least(4096, length(text)*2 + 1024) AS BIGINT) AS tokens FROM documents")
def budgets(spark, folder):
    return docs(spark, folder).select("doc_id", r.output_budget(F.length("text")).cast("long").alias("tokens"))


@check(
    "f12_chunk_summaries",
    """SELECT doc_id, CASE doc_id%3 WHEN 0 THEN left(text, 500) WHEN 1 THEN concat('(part ', doc_id + 1, ' gave no summary)') ELSE lang END AS summary FROM documents""",
)
def chunk_summaries(spark, folder):
    said = F.expr("CASE doc_id%3 WHEN 0 THEN NULL WHEN 1 THEN '<think>x</think> ' ELSE concat(' ', lang) END")
    return docs(spark, folder).select(
        "doc_id", r.chunk_summary(said, F.col("text"), F.col("doc_id") + 1, MapWords().missing).alias("summary")
    )


@check(
    "p18_evidence_urls",
    "WITH " + v.TIMELINE + "," + v.OCR + """
SELECT seq, CASE seq%5 WHEN 0 THEN concat('http://x/', seq) WHEN 1 THEN concat('/media/', recording_id, '/frames/', seq, '.jpg') WHEN 2 THEN concat('/media/', recording_id, '/frames/f', seq, '.png') WHEN 3 THEN concat('/media/', recording_id, '/frames/', seq) END AS url FROM v_ocr""",
)
def evidence_urls(spark, folder):
    path = F.expr("CASE seq%5 WHEN 0 THEN concat('http://x/', seq) WHEN 1 THEN frame_path WHEN 2 THEN concat('C:\\\\a\\\\f', seq, '.png') WHEN 3 THEN string(seq) END")
    return v.ocr(spark, folder).select("seq", t.evidence_url(path, F.col("recording_id"), "/media").alias("url"))
