"""Words as tables: the same results as with words in the plan, and the edges of each operator."""

import random

from talkledger.functions import text as t
from talkledger.operators import matching

ALPHABET = ["ab", "Ab", "b", "é", "É", " ", "-", "中", "文", "_1", "\n", "😀"]


def made(rng, most):
    return "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most)))


def test_dictionary_table_replaces_as_the_literal_one(spark):
    rng = random.Random(5)
    dictionary = {}
    while len(dictionary) < 60:
        word = made(rng, 4)
        if word.strip():
            dictionary[word.lower()] = f"<{len(dictionary)}>"
    texts = [(k, made(rng, 40)) for k in range(300)] + [(300, None), (301, ""), (302, " \n ")]
    rows = spark.createDataFrame(texts, "id long, text string")
    table = spark.createDataFrame(list(dictionary.items()), "wrong string, right string")
    got = {r.id: r.text for r in matching.replace_from_table(rows, ["id"], table).collect()}
    want = {r.id: r.text for r in rows.select("id", t.replace_words("text", dictionary).alias("text")).collect()}
    assert got == want and sum(got[k] != x for k, x in texts) > 200


def test_dictionary_table_edges(spark):
    rows = spark.createDataFrame([(1, "USB-c ΟΔΟΣ usb x"), (1, "other"), (2, "İx K")], "id long, text string").withColumnRenamed("id", "key")
    rows = rows.where("text <> 'other'")
    table = spark.createDataFrame(
        [(0, "usb", "old"), (1, "USB", "new"), (2, "οδοσ", "way"), (3, None, "x"), (4, "c", None), (5, "", "y"), (6, "İX", "II")],
        "line_no long, wrong string, right string",
    )
    got = {r.key: r.text for r in matching.replace_from_table(rows, ["key"], table).collect()}
    assert got == {1: "new-c way new x", 2: "II K"}
    assert matching.replace_from_table(rows, ["key"], table.limit(0)).count() == 2
    assert matching.replace_from_table(rows.limit(0), ["key"], table).count() == 0


def test_keyword_hits_are_all_substrings(spark):
    rng = random.Random(7)
    texts = [(k, made(rng, 30)) for k in range(120)] + [(500, None), (501, "")]
    words = sorted({made(rng, 3) for _ in range(80)})
    hits = matching.keyword_hits(
        spark.createDataFrame(texts, "recording_id long, text string"), spark.createDataFrame([(w,) for w in [*words, None]], "keyword string")
    )
    got = {(r.recording_id, r.keyword): r.at for r in hits.collect()}
    assert got == {(k, w): x.index(w) + 1 for k, x in texts if x for w in words if w and w in x}


def test_keywords_by_sound_table(spark):
    sounds = {"保": "bao", "宝": "bao", "证": "zheng", "正": "zheng", "k": "c", "c": "c"}
    texts = spark.createDataFrame([(1, "xx宝正yy"), (2, "保证"), (3, "none"), (4, "ok")], "recording_id long, text string")
    words = spark.createDataFrame([(2, "保证"), (1, "oc"), (3, "保")], "place int, keyword string")
    table = spark.createDataFrame(list(sounds.items()), "char string, sound string")
    for heard in (sounds, table):
        got = {r.recording_id: r.keyword for r in matching.first_keywords(texts, words, sounds=heard).collect()}
        assert got == {1: "保证", 2: "保证", 4: "oc"}
    hit = {(r.recording_id, r.keyword): (r.at, r.context) for r in matching.keyword_hits(texts, words, sounds=table, radius=1).collect()}
    assert hit[1, "保证"] == (0, "x") and hit[2, "保证"] == (1, "保")
