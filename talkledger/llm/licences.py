"""Whole-text licence scan by canonical digests."""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkledger.llm.common import stored

# Notices and short licence texts as published by their stewards.
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ],
}

#: Spellings that mean the same in a licence; the left word becomes the right one.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing",
    "sublicence": "sublicense", "acknowledgement": "acknowledgment", "organisation": "organization",
    "authorisation": "authorization", "authorised": "authorized", "favour": "favor", "judgement": "judgment",
    "merchantibility": "merchantability", "noncommercial": "non commercial", "whilst": "while",
    "v1": "version 1", "v2": "version 2", "v3": "version 3", "v4": "version 4",
}

#: A line that only claims copyright.
COPYRIGHT_LINE = r"(^|\n)[ \t*#/;-]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*"
CLAIMS = ("copyright", "(c)", "©", "all rights reserved")
#: What a claim begins with in lower-case text: the word or sign, and a sign, year or placeholder after it. A
#: sentence on copyright that a line happens to begin with is none.
CLAIM = r"[ \t*#/;-]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]|<|\[|\{)|\(c\)[ \t]*(?:copyright|[0-9])|©|all rights reserved)[^\n]*"
CLAIM_LINE = rf"(^|\n){CLAIM}"
CLAIM_PARAGRAPH = rf"(^\s*|\n[ \t]*\n\s*){CLAIM}(?:\n[^\n]*[^\s][^\n]*)*"

#: Lines that stand over a short text whose file has none.
TITLES = {
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause License", "Zero-Clause BSD License", "BSD 0-Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": [
        "BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License", 'BSD 3-Clause "New" or "Revised" License',
    ],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License, Version 1.0"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng license"],
}
#: Wordings of a short text that are in use beside the published one.
WORDINGS = {
    "BSD-2-Clause": ("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"),
    "BSD-3-Clause": ("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"),
    "ISC": ("and/or distribute", "and distribute"),
    "MIT": ("this permission notice shall", "this permission notice (including the next paragraph) shall"),
    "Unlicense": ("http://unlicense.org/", "https://unlicense.org"),
}
#: Where the terms of a long text end and hints on its use begin.
END = "END OF TERMS AND CONDITIONS"


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files in ``licence_texts`` in all their forms: a file is named after its
    licence, with "@" and a word where there are several of one. Short texts come with and without titles and item
    numbers and in their other wording; long ones whole and up to END. How lines are cut makes no difference."""
    out = []
    for file in sorted(resources.files(__package__).joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        if not file.name.endswith(".txt"):
            continue
        licence, text = file.name.removesuffix(".txt").partition("@")[0], file.read_text(encoding="utf-8")
        if licence in TITLES:
            bodies = [text, text.replace(*WORDINGS.get(licence, ("", "")))]
            bodies += [re.sub(r"(?m)^ *[0-9]\. ", "", b) for b in bodies]
            forms = bodies + [f"{title}\n\n{b}" for title in TITLES[licence] for b in bodies]
        else:
            forms = [text, text.partition(END)[0] + END] if END in text else [text]
        out += [(licence, f) for f in sorted(set(forms))]
    return out


def canonical_lines(text: Column) -> Column:
    """Text with its line breaks, but in canonical form: lower case, lines that claim copyright
    emptied, runs of anything but letters and digits to one blank, one spelling per word.

    Null gives the empty text; text is used whole.
    """
    x = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    claimed = F.contains(x, F.lit(CLAIMS[0]))
    for claim in CLAIMS[1:]:
        claimed = claimed | F.contains(x, F.lit(claim))
    x = F.when(claimed, F.regexp_replace(x, COPYRIGHT_LINE, "$1")).otherwise(x)
    # two blanks between words, so that neighbours that are both respelled do not share one
    x = F.regexp_replace(F.concat(F.lit(" "), x, F.lit(" ")), r"[^\p{L}\p{N}\n]+", "  ")
    x = F.replace(x, F.lit("\n"), F.lit("  \n  "))
    for old, new in SPELLINGS.items():
        x = F.replace(x, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.regexp_replace(x, " +", " "))


def canonical(lines: Column) -> Column:
    """One line out of what ``canonical_lines`` gives."""
    return F.trim(F.regexp_replace(lines, "[ \n]+", " "))


def _claimed(text: Column) -> Column:
    x = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    claimed = F.contains(x, F.lit(CLAIMS[0]))
    for claim in CLAIMS[1:]:
        claimed = claimed | F.contains(x, F.lit(claim))
    return claimed


def _spelled(x: Column) -> Column:
    x = F.regexp_replace(F.concat(F.lit(" "), x, F.lit(" ")), r"[^\p{L}\p{N}]+", "  ")
    for old, new in SPELLINGS.items():
        x = F.replace(x, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.regexp_replace(x, " +", " "))


def whole_forms(text: Column, lines: Column) -> list[Column]:
    """Canonical text of a whole document in two forms, that differ only where it claims copyright: without
    the lines that begin with a claim, and without the paragraphs that do. Neither depends on where the
    lines of the terms are cut; a paragraph that holds a claim may itself be cut anywhere."""
    plain = canonical(lines)
    x = F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "\r", "")
    return [
        F.when(_claimed(text), _spelled(F.regexp_replace(x, pattern, "$1"))).otherwise(plain) for pattern in (CLAIM_LINE, CLAIM_PARAGRAPH)
    ]


def digest(canonical_text: Column) -> Column:
    return F.sha2(canonical_text, 256)


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, licence) of (licence, text) rows: the first name by code point when texts coincide.

    Rows without a licence or without words in the text are left out.
    """
    text = F.col("text")
    rows = known.select(
        F.col("licence").cast("string").alias("licence"), F.explode(F.array(*whole_forms(text, canonical_lines(text)))).alias("_canonical")
    )
    rows = rows.where("licence is not null and _canonical <> ''")
    return rows.groupBy(digest(F.col("_canonical")).alias("digest")).agg(F.min("licence").alias("licence"))


for _licence, _text in whole_texts():
    NOTICES.setdefault(_licence, []).append(_text)


def published(spark: SparkSession) -> DataFrame:
    """The licences of NOTICES, one-line notices and whole texts, as (licence, text) rows."""
    pairs = [F.struct(F.lit(k).alias("licence"), F.lit(t).alias("text")) for k, texts in NOTICES.items() for t in texts]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def scan(
    df: DataFrame, known: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_broadcast: int = 1_000_000
) -> DataFrame:
    """One row per document: id, ``digest`` of its canonical text (without lines that claim copyright),
    ``licence`` if that whole text, or the one without such paragraphs, is a known one, ``n_licence_lines`` lines whose entire canonical text is a known one, and those lines'
    licences, sorted and comma-joined, in ``line_licences`` (empty text: none).

    Null and empty texts have the digest of the empty text and no licence. Rows that agree in id and
    canonical text are one document, and their lines are added up; a null id stays null; other
    columns are ignored; empty tables give no rows. ``known`` is counted, and broadcast up to
    ``most_broadcast`` digests (about 100 bytes each); beyond that Spark joins by shuffles.
    """
    digests = stored(known_digests(known), "licences").withColumnRenamed("digest", "_known")
    if digests.limit(most_broadcast + 1).count() <= most_broadcast:
        digests = F.broadcast(digests)
    lines = df.select(
        F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text"), canonical_lines(F.col(f"`{text_column}`")).alias("_lines")
    )
    by_line, by_paragraph = map(digest, whole_forms(F.col("_text"), F.col("_lines")))
    own = lines.select("_id", "_lines", by_line.alias("_digest"), F.when(_claimed(F.col("_text")), by_paragraph).alias("_other"))
    parts = F.transform(F.split("_lines", "\n"), lambda line: digest(F.trim(line)))
    units = own.select("_id", "_digest", F.posexplode(F.concat(F.array("_digest", "_other"), parts)).alias("_place", "_unit"))
    found = units.join(digests, F.col("_unit") == F.col("_known"), "left").where("_place = 0 or licence is not null")
    whole, line = F.col("_place") < 2, F.col("_place") > 1
    return found.groupBy(F.col("_id").alias(id_column), F.col("_digest").alias("digest")).agg(
        F.min_by("licence", F.when(whole & F.col("licence").isNotNull(), F.col("_place"))).alias("licence"),
        F.count(F.when(line, F.lit(1))).alias("n_licence_lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(line, F.col("licence")))), ",").alias("line_licences"),
    )
