"""Text columns: cleaning, normalising, dictionary replacement, sentences, noise."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkledger import fixed_values as fixed

#: White space as Python's ``str.strip`` sees it (Java's ``\s`` is ASCII only).
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


_SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def _col(text: str | Column) -> Column:
    return F.col(text) if isinstance(text, str) else text


def _literal(word: str) -> str:
    """A word as a pattern; Java reads these escapes as Python does."""
    return re.escape(word)


def _one_of(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "[]\\^-&" else c for c in chars) + "]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once: a filter on one is not pushed below it, and its
    expression is not repeated where it is used."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def strip(text: str | Column) -> Column:
    """Trim white space as Python's ``str.strip`` does."""
    return F.btrim(_col(text), F.lit(_SPACES))


def is_blank(text: str | Column) -> Column:
    return strip(text) == ""


#: Put around matches while they are changed; not a character (a text that has it all the
#: same takes the two-pass way).
_MARK = chr(0x10FFFE)


def replace_matches(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Replace every match by ``change(match)``.

    One pass of the pattern marks the matches, a plain split then sets them apart.
    """

    def marked(body: Column) -> Column:
        parts = F.split(F.regexp_replace(body, pattern, f"{_MARK}$0{_MARK}"), _MARK)
        changed = F.transform(parts, lambda part, i: F.when(i % 2 == 1, change(part)).otherwise(part))
        return F.array_join(changed, "")

    def twice(body: Column) -> Column:
        hits = F.regexp_extract_all(body, F.lit(f"({pattern})"), F.lit(1))
        pairs = F.zip_with(
            F.split(body, pattern), hits, lambda gap, hit: F.concat(gap, F.coalesce(change(hit), F.lit("")))
        )
        return F.array_join(pairs, "")

    return let(
        text, lambda body: F.when(F.contains(body, F.lit(_MARK)), twice(body)).otherwise(marked(body))
    )


def clean_recognised(text: str | Column) -> Column:
    """Drop tags and emoji, squeeze CJK punctuation, blank punctuation-only text."""
    marks = _one_of(fixed.CJK_PUNCTUATION)
    out = F.regexp_replace(_col(text), fixed.TAG_PATTERN, "")
    out = F.regexp_replace(out, fixed.EMOJI_PATTERN, "")
    out = F.regexp_replace(out, marks + "{2,}", fixed.FULL_STOP)
    out = F.regexp_replace(out, rf"^{SPACE}*{marks}+{SPACE}*\z", "")
    return strip(out)


def is_noise(
    text: str | Column,
    words_cn: Sequence[str] = fixed.NOISE_WORDS_CN,
    words_en: Sequence[str] = fixed.NOISE_WORDS_EN,
    punctuation: str = fixed.NOISE_PUNCTUATION,
) -> Column:
    """Only interjections or meaningless syllables."""
    spaced = F.translate(F.lower(_col(text)), punctuation, " " * len(punctuation))
    cleaned = F.trim(F.regexp_replace(spaced, f"{SPACE}+", " "))
    listed = "|".join(_literal(w) for w in (*words_cn, *words_en))
    sound = _one_of("".join(w for w in words_cn if len(w) == 1))
    words = "|".join(_literal(w) for w in words_en if " " not in w)
    few_sounds = rf"(?=.{{1,6}}\z)({sound})(?: |\1)*(?:({sound})(?: |\1|\2)*)?"
    return cleaned.rlike(rf"^(?:|{listed}|{few_sounds}|(?:{words})(?: (?:{words}))*)\z")


def _repeat_patterns(words: Sequence[str]) -> list[str]:
    """One pattern for all words where none can overlap another, else one per word."""
    overlap = any(
        u != v and (u in v or any(u.endswith(v[:n]) for n in range(1, min(len(u), len(v)) + 1)))
        for u in words
        for v in words
    )
    groups = [[w] for w in words] if overlap else [list(words)]
    return [f"({'|'.join(map(_literal, g))})\\1+" for g in groups if g]


def normalise(
    text: str | Column,
    noise_words: Sequence[str] = fixed.NOISE_PHRASE_WORDS,
    article: str = "the",
    repeated: Sequence[str] = fixed.REPEATED_WORDS,
    fillers: Sequence[str] = fixed.FILLERS,
) -> Column:
    """Rule-based clean-up; null marks noise."""
    noise = (
        rf"(?iu)^(?:{_literal(article)}{SPACE}+)*(?:{'|'.join(map(_literal, noise_words))})"
        rf"{SPACE}*[，。,.]?{SPACE}*\z"
    )
    singles = "".join(w for w in fillers if len(w) == 1)

    def digits(hit: Column) -> Column:
        return F.translate(hit, fixed.CN_DIGITS, fixed.ARABIC_DIGITS)

    def dated(body: Column) -> Column:
        years = replace_matches(body, f"{fixed.CN_YEAR_DIGITS}(?={fixed.YEAR_MARK})", digits)
        every = replace_matches(years, fixed.CN_YEAR_DIGITS, digits)
        return F.when(body.rlike(fixed.CN_YEAR_DIGITS), every).otherwise(body)

    def cleaned(raw: Column) -> Column:
        out = strip(F.regexp_replace(raw, rf"(?iu)^(?:{_literal(article)}{SPACE}+)+", ""))
        for pattern in _repeat_patterns(repeated):
            out = F.regexp_replace(out, pattern, "$1")
        return let(out, dated)

    def kept(out: Column) -> Column:
        return let(
            F.translate(out, fixed.BLANK_PUNCTUATION, ""),
            lambda bare: F.when(
                ~((bare == "") | bare.isin(*fillers) | bare.rlike(rf"^{_one_of(singles)}{{1,2}}\z")), out
            ),
        )

    return let(
        strip(text), lambda raw: F.when(~((raw == "") | raw.rlike(noise)), let(cleaned(raw), kept))
    )


def dictionary_pattern(words: Sequence[str]) -> str:
    """Longest word first. No match may run into an ASCII word character after it; a word
    that begins with one may not follow one either."""
    ranked = [_literal(w) for w in sorted(set(words), key=lambda w: (-len(w), w))]
    guarded = [w for w in ranked if re.match(r"[0-9A-Za-z_]", w)]
    free = [w for w in ranked if w not in guarded]
    ways = [f"(?<![0-9A-Za-z_])(?:{'|'.join(guarded)})"] if guarded else []
    ways += free
    cased = any(c.lower() != c.upper() for w in words for c in w if not c.isascii())
    return f"(?{'iu' if cased else 'i'})(?:{'|'.join(ways)})(?![0-9A-Za-z_])"


def replace_words(text: str | Column, dictionary: Mapping[str, str]) -> Column:
    """All dictionary words at once, leftmost and longest, never re-scanned."""
    text = _col(text)
    if not dictionary:
        return text
    lowered = {wrong.lower(): right for wrong, right in dictionary.items()}
    lookup = F.create_map(*[F.lit(x) for pair in lowered.items() for x in pair])
    pattern = dictionary_pattern(list(lowered))
    changed = replace_matches(
        text, pattern, lambda hit: F.coalesce(F.try_element_at(lookup, F.lower(hit)), hit)
    )
    return F.when(is_blank(text), text).otherwise(changed)


def sentences(text: str | Column) -> Column:
    """Sentences with their end mark; blank ones dropped, all-blank kept whole."""
    text = _col(text)
    parts = F.filter(
        F.split(text, f"(?<={_one_of(fixed.SENTENCE_MARKS)})"), lambda s: ~is_blank(s)
    )
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(F.size(parts) == 0, F.array(text))
        .otherwise(parts)
    )


def truncated(text: str | Column, limit: int = fixed.MAX_TEXT_CHARS) -> Column:
    """P17."""
    return F.substring(_col(text), 1, limit)


def spoken(text: str | Column, sounds: Mapping[str, str]) -> Column:
    """Each character replaced by one that stands for its syllable.

    Two texts of equal length sound alike exactly when these forms are equal, so a
    window of syllables is found by a plain substring search (J8).
    """
    stands = {s: s for s in sounds.values() if len(s) == 1}
    longer = sorted({s for s in sounds.values() if len(s) > 1})
    stands |= {s: chr(0xF0000 + i) for i, s in enumerate(longer)}
    moved = {c: stands[s] for c, s in sounds.items() if stands[s] != c}
    text = _col(text)
    return F.translate(text, "".join(moved), "".join(moved.values())) if moved else text


def first_keyword(text: str | Column, keywords: Column) -> Column:
    """struct(at, place, word) of the leftmost keyword, ties by list order; else null."""
    text = _col(text)
    found = F.transform(
        keywords, lambda k, i: F.struct(F.position(k, text).alias("at"), i.alias("place"), k.alias("word"))
    )
    return F.array_min(F.filter(found, lambda f: f["at"] > 0))


def first_sounding_keyword(
    text: str | Column, keywords: Column, sounds: Mapping[str, str]
) -> Column:
    """The first keyword *in list order* that is heard in the text; else null."""

    def first(heard: Column) -> Column:
        return F.get(F.filter(keywords, lambda k: F.contains(heard, spoken(k, sounds))), F.lit(0))

    return let(spoken(text, sounds), first)


def around(text: str | Column, at: Column, radius: int = fixed.CONTEXT_CHARS) -> Column:
    """Text within ``radius`` characters of position ``at`` (from 1)."""
    begin = F.greatest(at - radius, F.lit(1))
    return F.substring(_col(text), begin, at + radius - begin)


def file_name(path: str | Column) -> Column:
    return F.regexp_extract(_col(path), r"([^/\\]*)\z", 1)


def base_name(path: str | Column) -> Column:
    """Last part of a path with forward slashes."""
    return F.regexp_extract(_col(path), r"([^/]*)\z", 1)


def evidence_url(url: str | Column, recording: str | Column, base: str) -> Column:
    """Links pass, paths become ``base``/recording/frames/name; null when missing."""
    url, recording = _col(url), _col(recording)
    known = url.isNotNull() & (url != "") & recording.isNotNull()
    linked = url.startswith("http") | url.startswith("/api")
    return F.when(
        known,
        F.when(linked, url).otherwise(
            F.concat(F.lit(base + "/"), recording.cast("string"), F.lit("/frames/"), file_name(url))
        ),
    )


def media_type(path: str | Column, video: Sequence[str] = fixed.VIDEO_SUFFIXES) -> Column:
    """SRC6: by extension, case-insensitive."""
    suffix = F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)\z", 1))
    return F.when(suffix.isin(*video), "video").otherwise("audio")
