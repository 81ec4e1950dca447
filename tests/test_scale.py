"""Words that meet texts: numbers of runs, and files by runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkledger.operators import matching


def test_runs_have_one_number_wherever_they_stand():
    texts = ["the cat", "", "a the cat, THE cat", "é"]
    row, code = matching._run_codes(texts, [x.lower() for x in texts], [1, 3])
    words = ["the", "the cat", "a", "cat, "]
    known = matching._Numbers(matching._chars(words))
    ends = np.cumsum([0, *map(len, words)])
    number = dict(zip(words, known.of(ends[:-1], ends[1:]).tolist()))
    hits = {w: row[code == np.uint64(x)].tolist() for w, x in number.items()}
    assert hits == {"the": [0, 2, 2], "the cat": [0, 2, 2], "a": [2], "cat, ": [2]}


def test_words_that_fold_to_ascii_begin_as_they_are_written(spark):
    rows = spark.createDataFrame([(1, "Kab kab xkab"), (2, "KAB")], "id long, text string")
    words = spark.createDataFrame([("Kab", "1"), ("kab", "2")], "wrong string, right string")
    got = {r.id: r.text for r in matching.replace_from_table(rows, ["id"], words).collect()}
    assert got == {1: "1 2 xkab", 2: "2"}


@pytest.mark.parametrize("few", [0, 1000])
def test_first_keyword_of_short_long_and_odd_words(spark, monkeypatch, few):
    monkeypatch.setattr(matching, "SMALL_WORDS", few)
    texts = spark.createDataFrame([(1, "xx abcdefg \U0001F600"), (2, "abcd efg"), (3, "\U0001F601"), (4, None), (5, "\U0001F600 ab"), (None, "ab")], "id long, text string")
    words = spark.createDataFrame([(1, "abcdefg"), (2, "abcd"), (3, "\U0001F600"), (4, "ab"), (5, ""), (6, None), (2, "abce")], "place long, keyword string")
    got = {r.id: r.keyword for r in matching.first_keywords(texts, words, ["id"]).collect()}
    assert got == {1: "abcdefg", 2: "abcd", 5: "\U0001F600"}
    hits = sorted((r.id, r.keyword, r.at) for r in matching.keyword_hits(texts, words, ["id"]).collect())
    assert hits == [(1, "ab", 4), (1, "abcd", 4), (1, "abcdefg", 4), (1, "\U0001F600", 12), (2, "ab", 1), (2, "abcd", 1), (5, "ab", 3), (5, "\U0001F600", 1)]


def test_few_keywords_shuffle_neither_texts_nor_runs(spark):
    texts = spark.range(50).select("id", F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    words = spark.createDataFrame([(1, "word"), (2, "7")], "place long, keyword string")
    plan = matching.keyword_hits(texts, words, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
