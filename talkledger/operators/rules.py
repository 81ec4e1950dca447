"""Rule sheets and the rules an audit works with.

Rule tables carry ``sheet_id``: many recordings are audited against the same sheet, and
every join of recordings and rules is an equi-join on it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkledger import fixed_values as fixed
from talkledger.functions import text as t
from talkledger.operators import ordered as o


#: Full-width digits, common in Chinese sheets.
WIDE_DIGITS = "０１２３４５６７８９"


def _accepted_rows(
    rows: DataFrame, header_words: Sequence[str], stop_word: str, slice_rows: int
) -> DataFrame:
    first = t.strip(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    header = F.lit(False)
    for word in header_words:
        header = header | F.contains(F.col("_a"), F.lit(word))
    live = rows.withColumn("_a", first).where((F.col("_a") != "") & ~header)
    stop = F.col("_a").startswith(stop_word)
    live = o.scan(
        live, ["sheet_id"], "row_idx",
        {"_stopped": o.latest(F.when(stop, F.lit(1))), "_place": o.running(F.lit(1))}, slice_rows,
    ).where(F.col("_stopped").isNull())
    pattern = rf"(?s)^([0-9{WIDE_DIGITS}]+){t.SPACE}*(.+)"
    numbered = F.col("_a").rlike(pattern)
    number = F.translate(F.regexp_extract("_a", pattern, 1), WIDE_DIGITS, "0123456789").try_cast("bigint")
    return live.select(
        "sheet_id",
        F.col("_place").alias("rule_no"),
        F.when(numbered, number).otherwise(F.col("_place")).alias("rule_id"),
        F.when(numbered, t.strip(F.regexp_extract("_a", pattern, 2))).otherwise(F.col("_a")).alias("content"),
        F.slice("cells", F.lit(2), F.greatest(F.size("cells"), F.lit(1))).alias("_cells"),
    )


def sheet_rules(
    rows: DataFrame,
    header_words: Sequence[str] = fixed.SHEET_HEADER_WORDS,
    stop_word: str = fixed.SHEET_STOP_WORD,
    slice_rows: int = o.SLICE_ROWS,
) -> DataFrame:
    """SRC2: rules of sheet rows (sheet_id, row_idx, cells)."""
    return _accepted_rows(rows, header_words, stop_word, slice_rows).drop("_cells")


def sheet_examples(
    rows: DataFrame,
    header_words: Sequence[str] = fixed.SHEET_HEADER_WORDS,
    stop_word: str = fixed.SHEET_STOP_WORD,
    skipped: Sequence[str] = fixed.SHEET_SKIPPED_CELLS,
    example_format: str = fixed.EXAMPLE_FORMAT,
    slice_rows: int = o.SLICE_ROWS,
) -> DataFrame:
    """SRC2: example findings in the further cells of a rule row."""
    cells = _accepted_rows(rows, header_words, stop_word, slice_rows).select(
        "sheet_id", "rule_no", "rule_id", "content", F.posexplode("_cells").alias("cell_no", "_cell")
    )
    cell = t.strip(F.coalesce("_cell", F.lit("")))
    return cells.withColumn("_cell", cell).where(~F.col("_cell").isin(*skipped)).select(
        "sheet_id", "rule_no", "cell_no",
        F.format_string(
            example_format, "rule_id", F.substring("content", 1, fixed.EXAMPLE_TITLE_CHARS), "_cell"
        ).alias("example"),
    )


def first_examples(examples: DataFrame, k: int = fixed.EXAMPLES_PER_PROMPT) -> DataFrame:
    """O3: the first ``k`` examples of a sheet, as one ordered array.

    Each sheet keeps ``k`` rows per shuffle partition before they meet, so no sheet's
    examples are ever gathered whole.
    """
    place = F.struct("rule_no", "cell_no", "example")
    rows = examples.withColumn("_bin", F.pmod(F.hash("rule_no", "cell_no"), F.lit(64)))
    for keys in (["sheet_id", "_bin"], ["sheet_id"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("rule_no", "cell_no"))
        rows = rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
    return rows.groupBy("sheet_id").agg(
        F.transform(F.array_sort(F.collect_list(place)), lambda e: e["example"]).alias("examples")
    )


def _built_in_table(
    tokens: Mapping[int, Sequence[str]],
    rules: Sequence[tuple],
    keywords: Mapping[int, Sequence[str]],
    texts: Mapping[int, tuple[str, str]],
    content: Column,
) -> Column:
    known = {r[0]: r for r in rules}
    options = []
    for rule_id, words in tokens.items():
        _, category, mode, sources, severity = known[rule_id]
        title, description = texts.get(rule_id, (fixed.FALLBACK_TITLE % rule_id, ""))
        score = F.lit(0)
        for word in words:
            score = score + F.contains(content, F.lit(word)).cast("int")
        kw = keywords.get(rule_id, ())
        options.append(
            F.struct(
                score.alias("score"),
                F.lit(-rule_id).alias("neg_id"),
                F.lit(title).alias("title"),
                F.lit(category).alias("category"),
                F.lit(mode).alias("check_mode"),
                F.array(*[F.lit(s) for s in sources]).alias("evidence_sources"),
                (F.array(*[F.lit(k) for k in kw]) if kw else F.array().cast("array<string>")).alias("keywords"),
                F.lit(description).alias("description"),
                F.lit(severity).alias("severity_default"),
            )
        )
    return F.array_max(F.array(*options))


def enrich_rules(
    rules: DataFrame,
    tokens: Mapping[int, Sequence[str]] = fixed.MATCH_TOKENS,
    built_in: Sequence[tuple] = fixed.BUILT_IN_RULES,
    keywords: Mapping[int, Sequence[str]] = fixed.BUILT_IN_KEYWORDS,
    texts: Mapping[int, tuple[str, str]] | None = None,
    fallback_description: str = "",
) -> DataFrame:
    """Each rule takes the built-in rule whose tokens it contains most (ties: lowest
    id), else stays a semantic transcript rule of its own.

    The built-in table is configuration, so scores are one projection: no join, no shuffle.
    ``texts`` maps a built-in id to (title, description).
    """
    content = F.col("content")
    best = _built_in_table(tokens, built_in, keywords, texts or {}, content)
    rows = rules.withColumn("_best", best)
    hit = F.col("_best.score") > 0
    own_title = F.format_string(fixed.FALLBACK_TITLE, "rule_id")

    def either(name: str, other: Column) -> Column:
        return F.when(hit, F.col(f"_best.{name}")).otherwise(other).alias(name)

    return rows.select(
        *[c for c in rules.columns if c not in ("rule_id", "content")],
        F.when(hit, -F.col("_best.neg_id")).otherwise(F.col("rule_id")).cast("long").alias("rule_id"),
        "content",
        F.when(hit, F.col("_best.score")).otherwise(0).alias("score"),
        either("title", own_title),
        either("category", F.lit("behavioral")),
        either("check_mode", F.lit("semantic")),
        either("evidence_sources", F.array(F.lit("transcript"))),
        either("keywords", F.array().cast("array<string>")),
        either("description", F.lit(fallback_description)),
        either("severity_default", F.lit("medium")),
    )


def evidence_group(sources: Column) -> Column:
    """A10: transcript only, screen text only, or anything else."""
    kinds = F.array_distinct(sources)
    return (
        F.when(kinds == F.array(F.lit("transcript")), "transcript")
        .when(kinds == F.array(F.lit("ocr")), "ocr")
        .otherwise("mixed")
    )


GROUP_ORDER = ("transcript", "ocr", "mixed", "all")


#: Wording of a rule's description in a prompt.
NOTE = "\n  Note: %s"


def rules_text(rules: DataFrame, grouped: bool = True, note: str = NOTE) -> DataFrame:
    """A9, rules part, and A10: one text per (sheet, non-empty group)."""
    line = F.concat(
        F.col("rule_id").cast("string"), F.lit(". ["), F.col("check_mode"), F.lit("] "), F.col("content"),
        F.when(F.col("description") != "", F.format_string(note, "description")).otherwise(""),
    )
    group = evidence_group(F.col("evidence_sources")) if grouped else F.lit("all")
    return (
        rules.withColumn("group_name", group)
        .withColumn("_line", line)
        .groupBy("sheet_id", "group_name")
        .agg(
            F.expr("listagg(_line, '\\n') WITHIN GROUP (ORDER BY rule_no)").alias("rules_text"),
            F.count(F.lit(1)).alias("n_rules"),
        )
    )


def exact_rules(rules: DataFrame) -> DataFrame:
    """Exact rules with keywords, one per (sheet, id); the last text of the sheet counts."""
    return (
        rules.where((F.col("check_mode") == "exact") & (F.size("keywords") > 0))
        .groupBy("sheet_id", "rule_id")
        .agg(
            F.max_by("content", "rule_no").alias("rule_content"),
            F.max_by("keywords", "rule_no").alias("keywords"),
            F.max_by("severity_default", "rule_no").alias("severity"),
        )
    )
