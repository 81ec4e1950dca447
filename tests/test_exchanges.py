"""Model calls with a log: what is called, how often, and what a broken run leaves."""

import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from talkledger.operators import exchanges

# the models below are called in tasks, which cannot import the tests
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def counting(spark, answer):
    calls = spark.sparkContext.accumulator(0)

    def ask(prompts):
        calls.add(len(prompts))
        return [answer(p) for p in prompts]

    return ask, calls


def test_the_log_saves_calls(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(k, f"p{k % 10}") for k in range(40)] + [(99, None)], "id long, prompt string")
    ask, calls = counting(spark, lambda p: None if p == "p3" else p.upper())
    got = exchanges.call_model_logged(rows, ask, log, error="error", delay_s=0.0).collect()
    assert {r.id: r.response for r in got} == {k: None if k % 10 == 3 else f"P{k % 10}" for k in range(40)} | {99: None}
    assert calls.value == 10
    # a further run asks for the open one and the new one
    more = rows.unionByName(spark.createDataFrame([(100, "new")], rows.schema))
    ask, calls = counting(spark, str.upper)
    got = {r.id: r.response for r in exchanges.call_model_logged(more, ask, log, delay_s=0.0).collect()}
    assert (got[3], got[33], got[100], got[4]) == ("P3", "P3", "NEW", "P4") and calls.value == 2
    # other settings are another prompt
    ask, calls = counting(spark, str.upper)
    exchanges.call_model_logged(rows, ask, log, salt="b", delay_s=0.0)
    assert calls.value == 10
    assert exchanges.call_model_logged(rows.limit(0), ask, log, delay_s=0.0).count() == 0


def test_a_run_that_breaks_off_loses_one_wave_at_most(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([(k, f"q{k}") for k in range(64)], "id long, prompt string")
    waves = rows.select("prompt", F.pmod(F.xxhash64(F.sha2(F.concat(F.lit("\n"), "prompt"), 256)), F.lit(4)).alias("w")).collect()
    last = {r.prompt for r in waves if r.w == 3}

    def breaks(prompts):
        if set(prompts) & last:
            raise SystemExit("lost")  # no exception of the model: the task dies
        return [p.upper() for p in prompts]

    with pytest.raises(Exception, match="lost|exit|EOF"):
        exchanges.call_model_logged(rows, breaks, log, delay_s=0.0, width=2)
    ask, calls = counting(spark, str.upper)
    got = exchanges.call_model_logged(rows, ask, log, delay_s=0.0, width=2).collect()
    assert {r.id: r.response for r in got} == {k: f"Q{k}" for k in range(64)} and calls.value == len(last)


def test_rate_and_failures(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"q{k}") for k in range(6)], "id long, prompt string")
    begun = time.monotonic()
    ask, _ = counting(spark, str.upper)
    exchanges.call_model_logged(rows, ask, str(tmp_path / "a"), width=1, batch=1, per_second=5.0, waves=1)
    assert time.monotonic() - begun > 6 / 5.0

    def short(prompts):
        return prompts[:-1]

    got = exchanges.call_model_logged(rows, short, str(tmp_path / "b"), error="why", retries=0, waves=1).collect()
    assert {(r.response, r.why.split(":")[0]) for r in got} == {(None, "ValueError")}
