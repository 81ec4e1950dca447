"""Columns that read model responses (variant based, nothing fails a job)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkledger import fixed_values as fixed
from talkledger.functions.text import let, strip


def strip_thinking(text: Column) -> Column:
    """paired blocks, then open to end, then start to close."""
    out = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"(?s)<think>.*", "")
    return F.regexp_replace(out, r"(?s)^.*?</think>", "")


def _unfenced(text: Column) -> Column:
    return strip(F.regexp_replace(strip_thinking(text), "```json|```", ""))


def _last(text: Column, mark: str) -> Column:
    """Position of the last ``mark`` from 1, or 0."""
    back = F.instr(F.reverse(text), mark)
    return F.when(back > 0, F.length(text) - back + 1).otherwise(0)


def json_object_text(text: Column) -> Column:
    """first ``{`` to last ``}``."""

    def opened(body: Column) -> Column:
        at = F.instr(body, "{")
        return F.when(at > 1, F.substring(body, at, F.length(body))).otherwise(body)

    def closed(body: Column) -> Column:
        end = _last(body, "}")
        return strip(F.when(end > 0, F.substring(body, F.lit(1), end)).otherwise(body))

    return let(_unfenced(text), lambda body: let(opened(body), closed))


def json_array_text(text: Column) -> Column:
    """``[`` to ``]`` first, else ``{`` to ``}``, else the trimmed text."""

    def between(body: Column, a: str, b: str) -> Column:
        start, end = F.instr(body, a), _last(body, b)
        return F.when((start > 0) & (end > start), F.substring(body, start, end - start + 1))

    return let(
        _unfenced(text),
        lambda body: F.coalesce(between(body, "[", "]"), between(body, "{", "}"), body),
    )


def field(item: Column, path: str) -> Column:
    """Field of a variant, as a variant; SQL null only when it is absent."""
    return F.try_variant_get(item, f"$.{path}", "variant")


def fields(value: Column, *names: str) -> Column:
    """Fields of a variant object as a struct of variants, all taken out in one pass; null if it is no object."""
    return F.try_variant_get(value, "$", "struct<" + ", ".join(f"{n}: variant" for n in names) + ">")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _number(value: Column) -> Column:
    """A JSON number or a numeric string as Python's ``float`` would read it."""
    text = strip(F.try_variant_get(value, "$", "string"))
    return (
        F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        .when(kind(value) == "STRING", F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), text).try_cast("double"))
        .otherwise(F.try_variant_get(value, "$", "double"))
    )


def safe_int(value: Column, default: int = 0) -> Column:
    """12, "12" and 12.7 are read, "12.5" is not."""
    text = strip(F.try_variant_get(value, "$", "string"))
    number = F.when(
        kind(value) == "STRING", F.when(text.rlike(r"^[+-]?[0-9]+\z"), text).try_cast("bigint")
    ).otherwise(_number(value).try_cast("bigint"))
    return F.coalesce(number, F.lit(default))


def safe_float(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(_number(value), F.lit(default))


def shown(value: Column, default: str = "") -> Column:
    """A field as text; a JSON null is shown as ``None``."""
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull(), default)
        .when(F.is_variant_null(value), "None")
        .when(kind(value) == "BOOLEAN", F.initcap(text))
        .otherwise(text)
    )


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


#: What is read of a finding and of an evaluation.
FINDING_FIELDS = (
    "rule_id", "rule_content", "timestamp", "timestamp_ms", "end_ms", "speaker", "original_text", "reason", "severity", "confidence", "reasoning",
)
SCORES = ("logic", "info_density", "expression", "total")


def finding_items(value: Column, wrappers: Sequence[str] = fixed.RESPONSE_WRAPPERS) -> Column:
    """F8: the findings of a response as an array of objects (variant)."""

    def items(v: Column) -> Column:
        lists = [F.try_variant_get(v, path, "array<variant>") for path in ("$", *[f"$.{w}" for w in wrappers])]
        return F.coalesce(*lists, F.when(field(v, "rule_id").isNotNull(), F.array(v)))

    return F.filter(let(value, items), lambda v: kind(v).startswith("OBJECT"))


def finding(item: Column) -> Column:
    """One finding with safe numbers and a checked severity."""

    def text(value: Column) -> Column:
        return F.try_variant_get(value, "$", "string")

    def read(f: Column) -> Column:
        severity = F.lower(shown(f["severity"], "low"))
        return F.struct(
            safe_int(f["rule_id"]).alias("rule_id"),
            F.coalesce(text(f["rule_content"]), F.lit("")).alias("rule_content"),
            shown(f["timestamp"], "00:00").alias("timestamp"),
            safe_int(f["timestamp_ms"]).alias("model_ms"),
            safe_int(f["end_ms"]).alias("model_end_ms"),
            shown(f["speaker"]).alias("speaker"),
            shown(f["original_text"]).alias("original_text"),
            shown(f["reason"]).alias("reason"),
            let(severity, lambda x: F.when(x.isin(*fixed.SEVERITIES), x).otherwise("low")).alias("severity"),
            safe_float(f["confidence"], 0.5).alias("confidence"),
            text(f["reasoning"]).alias("reasoning"),
        )

    return let(fields(item, *FINDING_FIELDS), read)


def corrections(raw: Column) -> Column:
    """array of (id, text) from a response; null when nothing can be read."""
    pattern = F.lit(r'"id"\s*:\s*(\d+)\s*,\s*"text"\s*:\s*"((?:[^"\\]|\\.)*+)"')

    def read(value: Column) -> Column:
        listed = F.coalesce(
            F.try_variant_get(value, "$", "array<variant>"),
            F.try_variant_get(value, "$.entries", "array<variant>"),
        )
        usable = F.filter(
            listed,
            lambda v: field(v, "id").isNotNull()
            & field(v, "text").isNotNull()
            & (kind(field(v, "id")) == "BIGINT"),
        )
        return F.transform(
            usable,
            lambda v: F.struct(
                F.try_variant_get(v, "$.id", "bigint").alias("id"),
                F.try_variant_get(v, "$.text", "string").alias("text"),
            ),
        )

    def by_pattern(body: Column) -> Column:
        pairs = F.arrays_zip(
            F.regexp_extract_all(body, pattern, F.lit(1)).alias("id"),
            F.regexp_extract_all(body, pattern, F.lit(2)).alias("text"),
        )
        return F.transform(
            pairs,
            lambda p: F.struct(
                p["id"].try_cast("bigint").alias("id"),
                F.replace(
                    F.replace(p["text"], F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")
                ).alias("text"),
            ),
        )

    def chosen(body: Column, value: Column) -> Column:
        return F.when(value.isNotNull(), read(value)).otherwise(by_pattern(body))

    return let(
        strip(strip_thinking(raw)),
        lambda body: F.when(body != "", let(parsed(body), lambda value: chosen(body, value))),
    )


def evaluation(raw: Column) -> Column:
    """evaluation record with defaults at three levels; null when it cannot be read."""
    return let(parsed(json_object_text(raw)), _evaluation)


def _evaluation(value: Column) -> Column:
    def good(v: Column, *kinds: str) -> Column:
        return v.isNull() | let(kind(v), lambda k: reduce(Column.__or__, [k.startswith(x) for x in kinds]))

    def text(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))

    def texts(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array().cast("array<string>"))

    def whole(v: Column) -> Column:
        return v.isNull() | let(_number(v), lambda n: n.isNotNull() & (n == F.floor(n)))

    def read(top: Column, meta: Column, scores: Column, analysis: Column) -> Column:
        valid = [good(top["summary"], "STRING"), *[good(top[g], "OBJECT") for g in ("meta", "scores", "analysis")]]
        valid += [good(v, "STRING") for v in (meta["title"], meta["category"], analysis["sentiment"])]
        valid += [good(v, "ARRAY<STRING>", "ARRAY<VOID>") for v in (meta["keywords"], analysis["main_points"], analysis["key_data"])]
        valid += [whole(scores[s]) for s in SCORES]
        record = F.struct(
            F.struct(
                text(meta["title"]).alias("title"), text(meta["category"]).alias("category"), texts(meta["keywords"]).alias("keywords")
            ).alias("meta"),
            F.struct(*[safe_int(scores[s]).alias(s) for s in SCORES]).alias("scores"),
            F.struct(
                texts(analysis["main_points"]).alias("main_points"), texts(analysis["key_data"]).alias("key_data"),
                text(analysis["sentiment"]).alias("sentiment"),
            ).alias("analysis"),
            text(top["summary"]).alias("summary"),
        )
        return F.when(reduce(Column.__and__, valid), record)

    def opened(top: Column) -> Column:
        parts = F.struct(
            top.alias("top"), fields(top["meta"], "title", "category", "keywords").alias("meta"), fields(top["scores"], *SCORES).alias("scores"),
            fields(top["analysis"], "main_points", "key_data", "sentiment").alias("analysis"),
        )
        return F.when(top.isNotNull(), let(parts, lambda p: read(p["top"], p["meta"], p["scores"], p["analysis"])))

    return let(fields(value, "meta", "scores", "analysis", "summary"), opened)


def output_budget(chars: Column, most: int = fixed.OUTPUT_TOKENS) -> Column:
    """output tokens a model is given, ``most`` at most."""
    return F.least(F.lit(most), chars * 2 + 1024)


def chunk_summary(
    response: Column, chunk: Column, number: Column, empty_text: str, shown_chars: int = fixed.FAILED_SUMMARY_CHARS
) -> Column:
    """model summary; a placeholder when it is blank, the first ``shown_chars`` characters of
    the chunk when the call failed (null response)."""
    said = strip(strip_thinking(response))
    return F.when(response.isNull(), F.substring(chunk, 1, shown_chars)).otherwise(
        F.when(said == "", F.format_string(empty_text, number)).otherwise(said)
    )
