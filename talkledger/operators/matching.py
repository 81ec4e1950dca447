"""Many words in many texts at once.

Words come as tables and meet texts by equi-joins on short keys, so that neither the plan nor a task
grows with the number of words: a text is cut into keys once for all words, and read once more to
settle what met.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from talkledger.functions import text as t
from talkledger.operators.batches import pieces
from talkledger.session import written

#: Longest run of characters by which texts and words meet: as many as a 64-bit number holds.
GRAM = 4
#: Up to so many words go to every task; more of them meet the runs of the texts by a shuffle.
SMALL_WORDS = 500_000
#: First of the private characters that stand for syllables of several letters.
_PRIVATE = 0xF0000
#: Characters that share one number in a run: NUL, and all above U+FFFF but the first 2047 private ones.
_ODD = r"[\x00\x{10000}-\x{EFFFF}\x{F07FF}-\x{10FFFF}]"
#: A word covers whole units of the text it stands in: runs of ASCII word characters, or one other character.
_UNIT = "[0-9A-Za-z_]+|[^0-9A-Za-z_]"
_UNITS = re.compile(_UNIT)
_WORD_CHARS = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")
#: Bits by which runs of units are told apart before they meet the dictionary: 16 a word, 16 MB at most.
_MOST_BITS = 1 << 27
_BITMAP_BITS = 8 * 4096


def spoken_by_table(text: str | Column, sounds: DataFrame) -> Column:
    """``text`` with each character replaced by the stand-in of its syllable, by a (char, sound) table.

    The table has at most one row per Unicode character, so it is folded into two strings that travel as
    one row. A syllable of one letter stands for itself, others for a private-use character.
    """
    known = sounds.where((F.length("char") == 1) & F.col("sound").isNotNull())
    rows = known.groupBy("char").agg(F.min("sound").alias("sound"))
    longer = F.array_sort(F.collect_set(F.when(F.length("sound") > 1, F.col("sound"))))
    places = rows.agg(longer.alias("_all")).select(F.posexplode("_all").alias("_place", "sound"))
    private = F.expr(f"decode(unhex(lpad(hex({_PRIVATE} + _place), 8, '0')), 'UTF-32')")
    stands = rows.join(places.select("sound", private.alias("_stand")), "sound", "left").select(
        "char", F.coalesce("_stand", "sound").alias("to")
    )
    pairs = F.array_sort(F.collect_list(F.struct("char", "to")))
    one = stands.agg(pairs.alias("_p")).select(
        F.array_join(F.transform("_p", lambda p: p["char"]), "").alias("chars"),
        F.array_join(F.transform("_p", lambda p: p["to"]), "").alias("to"),
    )
    column = F.col(text) if isinstance(text, str) else text
    return F.call_function("translate", column, one.select("chars").scalar(), one.select("to").scalar())


def heard(text: str | Column, sounds: Mapping[str, str] | DataFrame | None) -> Column:
    """``text`` as it sounds; itself without a pronunciation dictionary."""
    if sounds is None or (isinstance(sounds, Mapping) and not sounds):
        return F.col(text) if isinstance(text, str) else text
    return spoken_by_table(text, sounds) if isinstance(sounds, DataFrame) else t.spoken(text, sounds)


def _codes(raw: bytes, size: int) -> np.ndarray:
    """All runs of ``size`` characters as distinct numbers, 16 bits a character.

    The first private characters, by which ``spoken_by_table`` stands for long syllables, take the numbers
    of surrogates, which are no characters. NUL and all others above U+FFFF share the last of these, so runs
    with them may meet by mistake (``_ODD``). 0 is the empty run.
    """
    if size == 0:
        return np.zeros(1, np.uint64)
    chars = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    stand = chars - np.uint64(_PRIVATE)  # wraps below it
    chars = np.where(stand < 0x7FF, 0xD800 + stand, np.where((chars > 0xFFFF) | (chars == 0), 0xDFFF, chars))
    if len(chars) < size:
        return np.empty(0, np.uint64)
    rows = len(chars) - size + 1
    out = chars[:rows].copy()
    for k in range(1, size):
        out |= chars[k : k + rows] << np.uint64(16 * k)
    return np.unique(out)


def _with_codes(rows: DataFrame, text: str, sizes: Sequence[int] | None, carry: Sequence[str]) -> DataFrame:
    """``carry`` and ``_codes``: the runs of ``sizes`` in ``text``; by default those of its own length, GRAM at most."""
    lengths = None if sizes is None else list(sizes)
    narrow = rows.select(*carry, F.col(text).cast("binary").alias("_raw"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            found, ends = [], [0]
            for raw in part.column("_raw").to_pylist():
                own = [min(len(raw.decode("utf-8", "replace")), GRAM)] if lengths is None else lengths
                found += [_codes(raw, n) for n in own]
                ends.append(ends[-1] + sum(map(len, found[len(found) - len(own) :])))
            flat = np.concatenate(found).view(np.int64)
            codes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield part.select(list(carry)).append_column("_codes", codes)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.drop("_raw").schema)
    return narrow.mapInArrow(cut, f"{fields}, _codes array<bigint>")


def _filed(words: DataFrame, sounds: Mapping[str, str] | DataFrame | None) -> tuple[DataFrame, list[int], bool]:
    """Words (keyword, ...) with ``_k``, how they sound, and ``_code``, the run they are filed under: themselves, or of
    longer ones the run that they share with the fewest; ``_sure`` where the run is the word. With the lengths of
    the runs, and whether the words are few."""
    words = words.withColumn("_k", heard("keyword", sounds))
    runs = _with_codes(words, "_k", None, words.columns).withColumn("_code", F.explode("_codes")).drop("_codes")
    shared = runs.groupBy("_code").agg(F.count(F.lit(1)).alias("_n"))
    long = F.length("_k") > GRAM
    rarest = runs.where(long).join(shared, "_code").groupBy("_k").agg(F.min_by("_code", F.struct("_n", "_code")).alias("_code"))
    odd = F.col("_k").rlike(_ODD)
    filed = runs.where(~long).select(*words.columns, "_code", (~odd).alias("_sure")).unionByName(
        words.where(long).join(rarest, "_k").select(*words.columns, "_code", F.lit(False).alias("_sure"))
    )
    filed = written(filed, "keywords")
    # at most GRAM + 1 rows, whatever the tables
    counts = filed.groupBy(F.least(F.length("_k"), F.lit(GRAM)).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
    return filed, sorted(r["size"] for r in counts), sum(r["n"] for r in counts) <= SMALL_WORDS


def keyword_hits(
    texts: DataFrame,
    keywords: DataFrame,
    keys: Sequence[str] = ("recording_id",),
    text: str = "text",
    sounds: Mapping[str, str] | DataFrame | None = None,
    radius: int = 0,
) -> DataFrame:
    """(keys, keyword, ``at``, ``heard``, ``context``) of every keyword that a text holds or that sounds
    like a part of it.

    ``keys`` name one text. ``at`` is the first place from 1, 0 where the keyword is only heard; ``context``
    is the text within ``radius`` of ``at`` (of the first character where it is only heard). Every keyword
    is filed under one of its runs of up to GRAM characters, the one that it shares with the fewest
    keywords; a text's distinct runs meet the files on equality, and what met is looked up in the text,
    once for all keywords. Few keywords go to the texts, so that neither texts nor runs are shuffled; of
    many, the texts' runs go to them. Null texts and keys, null and empty keywords match nothing.
    """
    keys = list(keys)
    if isinstance(sounds, DataFrame):
        sounds = written(sounds, "sounds")
    words = keywords.select("keyword").where(F.coalesce("keyword", F.lit("")) != "").distinct()
    files, sizes, few = _filed(words, sounds)
    files = files.drop("_sure")
    rows = texts.select(*keys, F.col(text).alias("_text")).where(F.col("_text").isNotNull()).dropna(subset=keys)
    if not few:
        # dealt by key once: what meets comes back to its text without another exchange of texts
        rows = rows.repartition(*keys)
    rows = rows.withColumn("_heard", heard("_text", sounds))
    if few:
        coded = _with_codes(rows, "_heard", sizes, [*keys, "_text", "_heard"])
        found = coded.withColumn("_code", F.explode("_codes")).drop("_codes").join(F.broadcast(files), "_code")
    else:
        met = _with_codes(rows, "_heard", sizes, keys).select(*keys, F.explode("_codes").alias("_code")).join(files, "_code")
        met = met.groupBy(*keys).agg(F.collect_set(F.struct("keyword", "_k")).alias("_met"))
        found = rows.join(met, keys).select(*keys, "_text", "_heard", F.inline("_met"))
    at = F.position(F.col("keyword"), F.col("_text"))
    found = found.where(F.contains("_heard", F.col("_k"))).select(*keys, "keyword", at.alias("at"), "_text")
    context = t.around("_text", F.greatest("at", F.lit(1)), radius)
    return found.select(*keys, "keyword", "at", F.lit(True).alias("heard"), context.alias("context"))


def first_keywords(
    texts: DataFrame,
    keywords: DataFrame,
    keys: Sequence[str] = ("recording_id",),
    text: str = "text",
    sounds: Mapping[str, str] | DataFrame | None = None,
) -> DataFrame:
    """J8 with a keyword table (place, keyword): (keys, keyword), the first by ``place`` that is heard.

    The words are numbered in the order in which they count, and a text keeps the least number of what its
    runs meet, one number for all its hits. Only words longer than their run are looked up in the text,
    and of these only what would come before the first that is sure.
    """
    keys = list(keys)
    if isinstance(sounds, DataFrame):
        sounds = written(sounds, "sounds")
    placed = keywords.where(F.coalesce("keyword", F.lit("")) != "").groupBy("keyword").agg(F.min("place").alias("_place"))
    placed = placed.repartitionByRange("_place", "keyword").sortWithinPartitions("_place", "keyword")
    placed = written(placed.withColumn("_rank", F.monotonically_increasing_id()), "places").select("keyword", "_rank")
    files, sizes, few = _filed(placed, sounds)
    # words that sound alike: the first stands for all
    files = files.groupBy("_k", "_code", "_sure").agg(F.min("_rank").alias("_rank"))
    few_or_all = F.broadcast if few else (lambda df: df)
    rows = texts.select(*keys, F.col(text).alias("_text")).where(F.col("_text").isNotNull()).dropna(subset=keys)
    rows = rows.select(*keys, heard("_text", sounds).alias("_heard"))

    def met(some: DataFrame, lengths: Sequence[int]) -> DataFrame:
        runs = _with_codes(rows, "_heard", lengths, keys).select(*keys, F.explode("_codes").alias("_code"))
        return runs.join(few_or_all(some), "_code")

    sure = met(files.where("_sure").select("_code", "_rank"), sizes).groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    open_ = files.where("NOT _sure").select("_code", "_rank", "_k")
    lengths = sorted(r[0] for r in open_.select(F.least(F.length("_k"), F.lit(GRAM))).distinct().collect())
    best = sure
    if lengths:
        sure = written(sure, "sure")
        before = met(open_, lengths).join(sure.withColumnRenamed("_rank", "_sure"), keys, "left")
        before = before.where(F.col("_sure").isNull() | (F.col("_rank") < F.col("_sure"))).select(*keys, "_rank", "_k")
        read = rows.join(before, keys).where(F.contains("_heard", F.col("_k"))).select(*keys, "_rank")
        best = sure.unionByName(read).groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    return best.join(placed, "_rank").select(*keys, "keyword")


def _folded(column: str | Column) -> Column:
    """Lower case, one character for each, also at the end of a Greek word."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(F.translate(column, "İΣς", "iσσ"))


def _units(column: str) -> Column:
    return F.regexp_extract_all(column, F.lit(f"(?s){_UNIT}"), F.lit(0))


def _replaced(text: str, folded: str, words: Iterator[tuple[str, int, str, int]]) -> str:
    """The text with the words put in: leftmost, then longest, nothing twice. ``words`` are (folded word, units,
    replacement, length of its first unit)."""
    rights: dict[int, dict[str, str]] = {}
    heads: set[str] = set()
    for key, size, right, head in words:
        rights.setdefault(size, {})[key] = right
        heads.add(key[:head])
    units = _UNITS.findall(text)
    ends = [0, *accumulate(map(len, units))]
    parts, done, sizes = [], 0, sorted(rights, reverse=True)
    for at in [k for k, (a, b) in enumerate(zip(ends, ends[1:])) if folded[a:b] in heads]:
        if at < done:
            continue
        for n in sizes:
            stop = at + n
            right = rights[n].get(folded[ends[at] : ends[stop]]) if stop <= len(units) else None
            # a word that ends in another character may not stand before a word character
            if right is not None and not (stop < len(units) and units[stop][0] in _WORD_CHARS and units[stop - 1][-1] not in _WORD_CHARS):
                parts += units[done:at]
                parts.append(right)
                done = stop
                break
    return "".join(parts + units[done:])


@F.arrow_udf(StringType())
def _put_in(texts: pa.Array, folded: pa.Array, words: pa.Array, sizes: pa.Array, rights: pa.Array, heads: pa.Array) -> pa.Array:
    out = []
    for part in pieces([pa.RecordBatch.from_arrays([texts, folded, words, sizes, rights, heads], list("abcdef"))]):
        lists = part.columns[2:]
        # of this piece alone: values and offsets of a slice are those of the whole batch
        cuts = [c.offsets.to_numpy() for c in lists]
        values = [c.values.slice(p[0], p[-1] - p[0]).to_numpy(zero_copy_only=False) for c, p in zip(lists, cuts, strict=True)]
        places = [p - p[0] for p in cuts]
        for k, (text, low) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)):
            found = (v[p[k] : p[k + 1]].tolist() for v, p in zip(values, places, strict=True))
            out.append(None if text is None else _replaced(text, low, zip(*found, strict=True)))
    return pa.array(out, pa.string())


#: Base of the number of a run, and what undoes it, modulo 2 to the 64.
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _Numbers:
    """Numbers of any runs of one text: the polynomial of a run's characters, a difference of two running sums."""

    def __init__(self, chars: np.ndarray) -> None:
        terms = (chars.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(chars))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        self.down = _powers(_UNBASE, len(chars) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[begin]) * self.down[begin]
        # so that every bit counts
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


def _chars(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def _run_codes(texts: Sequence[str], folded: Sequence[str], sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of every run of ``sizes`` units, for all texts at once: equal runs have equal numbers."""
    chars, low, lengths = _chars(texts), _chars(folded), np.array([len(x) for x in texts], np.int64)
    if len(low) != len(chars):
        raise ValueError("folding a text must keep its length")
    rows, codes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    if len(chars):
        word = np.zeros(129, bool)
        word[[ord(c) for c in _WORD_CHARS]] = True
        word = word[np.minimum(chars, 128)]
        opens = np.ones(len(chars), bool)
        opens[1:] = ~(word[1:] & word[:-1])
        opens[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        starts = np.append(np.flatnonzero(opens), len(chars))
        row = np.repeat(np.arange(len(lengths)), lengths)[starts[:-1]]
        numbers = _Numbers(low)
        for size in (n for n in sizes if n < len(starts)):
            inside = row[: len(row) - size + 1] == row[size - 1 :]
            rows.append(row[: len(inside)][inside])
            codes.append(numbers.of(starts[:-size][inside], starts[size:][inside]))
    return np.concatenate(rows), np.concatenate(codes)


def _with_numbers(words: DataFrame) -> DataFrame:
    """``words`` with ``_code``, the number of ``_key``."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            every = part.column("_key").to_pylist()
            ends = np.cumsum([0, *map(len, every)])
            codes = _Numbers(_chars(every)).of(ends[:-1], ends[1:])
            yield part.append_column("_code", pa.array(codes.view(np.int64)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(number, f"{fields}, _code bigint")


def _bitmap(words: DataFrame, n: int) -> np.ndarray:
    """Bits for the numbers of all words, some 16 bits a word: the bit at the number modulo the size."""
    bits = min(max(_BITMAP_BITS, 1 << (16 * n - 1).bit_length()), _MOST_BITS)
    place = F.col("_code").bitwiseAND(F.lit(bits - 1))
    cells = words.select(F.shiftright(place, 15).alias("cell"), (place % _BITMAP_BITS).alias("bit"))
    made = cells.groupBy("cell").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(bits // 8)
    for row in made.toLocalIterator():
        out[4096 * row["cell"] : 4096 * (row["cell"] + 1)] = row["bits"]
    return np.frombuffer(bytes(out), np.uint8)


def _met_runs(rows: DataFrame, keys: Sequence[str], text: str, sizes: Sequence[int], bitmap: np.ndarray) -> DataFrame:
    """(keys, ``_code``): the numbers of the distinct runs of units of each text, without those that the bitmap
    rules out."""
    narrow = rows.select(*keys, F.col(text).alias("_text"), _folded(text).alias("_folded"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            row, code = _run_codes(part.column("_text").to_pylist(), part.column("_folded").to_pylist(), sizes)
            place = code & np.uint64(8 * len(bitmap) - 1)
            known = (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            row, code = row[known], code[known]
            order = np.lexsort((code, row))
            row, code = row[order], code[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
            at = pa.array(row[new], pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in keys), pa.array(code[new].view(np.int64))], [*keys, "_code"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return narrow.mapInArrow(cut, f"{fields}, _code bigint")


def replace_from_table(
    rows: DataFrame, keys: Sequence[str], dictionary: DataFrame, text: str = "text", out: str | None = None
) -> DataFrame:
    """P4 with the dictionary as a table (wrong, right): ``rows`` with ``out`` (default: ``text``) replaced.

    All words at once, leftmost and longest, without case, never re-scanned; a word that begins with an
    ASCII word character may not follow one, and none may stand before one. ``keys`` name one row each.
    Runs of units, as many as some dictionary word has, are the join keys: of each text its distinct runs,
    without those that a bitmap of the dictionary rules out, so that what is shuffled grows with the words
    that texts hold. Only rows that hold a word are read again. Blank and null texts stay, as do rows without
    a match; of entries that differ in case only the one of the greatest ``line_no`` counts, or without that
    column the smallest ``right``.
    """
    keys, out = list(keys), out or text
    order = F.struct(-F.col("line_no"), F.col("right")) if "line_no" in dictionary.columns else F.col("right")
    words = dictionary.where((F.coalesce("wrong", F.lit("")) != "") & F.col("right").isNotNull())
    words = words.withColumn("_key", _folded("wrong")).withColumn("_u", _units("wrong")).groupBy("_key", F.size("_u").alias("_size")).agg(
        F.min_by("right", order).alias("_right"), F.collect_set(F.length(F.col("_u")[0])).alias("_heads")
    )
    # letters that fold to ASCII ones may begin a word otherwise: a row for each length of the first unit
    words = words.select("_key", "_size", "_right", F.explode("_heads").alias("_head"))
    words = written(_with_numbers(words), "dictionary")
    # the lengths of words in units: few, whatever the number of words
    counts = {r["_size"]: r["n"] for r in words.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.withColumn(out, F.col(text))
    live = rows.where(~t.is_blank(text))
    runs = _met_runs(live, keys, text, sorted(counts), _bitmap(words, sum(counts.values())))
    # what meets by its number alone is told apart in the text
    met = runs.join(words, "_code")
    found = met.groupBy(*keys).agg(F.collect_list(F.struct("_key", "_size", "_right", "_head")).alias("_found"))
    joined = rows.join(found, keys, "left")
    held = F.col("_found").isNotNull()
    fields = [F.col(f"_found.{c}") for c in ("_key", "_size", "_right", "_head")]
    changed = _put_in(F.when(held, F.col(text)), F.when(held, _folded(text)), *fields)
    return joined.withColumn(out, F.coalesce(changed, F.col(text))).drop("_found")
