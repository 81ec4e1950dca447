"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds to them.

The patterns are the base and always stay. The field reads the words around anchors (digits, "@",
spelled-out "at" and "dot"), gives every candidate segment of a few words a score from features of
the whole segment, and picks the best set of segments and types by dynamic programming over at
most MOST_WORDS words per entity. It is trained by gradient steps on its likelihood, on a bounded
sample of the different base spans of all documents, which are the labels, also in spellings that the
patterns miss, and on numbers that are nobody's data.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkledger.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
#: Excerpts around base spans that the field learns from, at most, over all kinds.
SAMPLE_EXCERPTS = 600
#: Words of one entity at most, words around an anchor that the field reads.
MOST_WORDS, AROUND = 8, 4
STEPS, RATE, SHRINK = 12, 0.15, 1e-3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_ANCHOR = re.compile(r"[0-9@]|(?<![A-Za-z])(?:dot|DOT)(?![A-Za-z])")
_WORD = re.compile(r"\S+")
_EDGE = "\"'.,;:!?<>{}[]"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match starts where the run of local characters before its "@" starts, or the last match ends."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at) if begin < at else None
        if found:
            yield begin, found.end()
            last = found.end()
        at = text.find("@", found.end() if found else at + 1)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind, leftmost and apart within the kind; code points, end exclusive."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # a part of many digits is above 255 unless it starts with zeros
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        for m in _CARD.finditer(text):
            digits = only_digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(only_digits(m[0])) <= 15:
                    out["phone"].append(m.span())
    return out


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of words around anchors: begin and end of every word."""
    if not _ANCHOR.search(text):
        return
    words = [m.span() for m in _WORD.finditer(text)]
    near: list[tuple[int, int]] = []
    last = -1
    for k, (a, b) in enumerate(words):
        if _ANCHOR.search(text, a, b):
            for j in range(max(last + 1, k - AROUND), min(len(words), k + AROUND + 1)):
                if near and j > last + 1:
                    yield near
                    near = []
                near.append(words[j])
                last = j
    if near:
        yield near


def _trimmed(text: str, begin: int, end: int) -> tuple[int, int]:
    """Without punctuation at the edges."""
    while begin < end and text[begin] in _EDGE:
        begin += 1
    while end > begin and text[end - 1] in _EDGE:
        end -= 1
    return begin, end


_SHAPE = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_BOUNDS = (1, 4, 7, 8, 9, 10, 11, 12, 13, 16, 17, 20)
FEATURE_NAMES = (
    ["bias", "letters", "at", "spelled at", "spelled dot", "plus", "zeros", "brackets", "dots", "hyphens", "blanks", "slashes",
     "colon", "other", "luhn", "four parts", "large part", "word end", "mixed", "even groups", "starts inside", "lone digit edge"]
    + [f"words {n}" for n in range(1, MOST_WORDS + 1)] + [f"digits from {n}" for n in (0, *_BOUNDS)] + [f"groups {n}" for n in range(7)]
)


def segment_features(text: str, begin: int, end: int, words: int) -> list[int]:
    """Places in FEATURE_NAMES that hold for the whole segment."""
    own = text[begin:end]
    shape = _SHAPE.findall(own)
    groups = [s for s in shape if s[0].isdigit() and s.isascii()]
    letters = [s for s in shape if s.isascii() and s.isalpha()]
    digits = "".join(groups)
    lower = [s.lower() for s in letters]
    marks = {s for s in shape if not s.isalnum() and not s.isspace()}
    flags = [
        True, bool(letters), "@" in marks, "at" in lower, "dot" in lower, own.startswith("+"), own.startswith("00"),
        "(" in marks and ")" in marks, "." in marks, "-" in marks, any(s.isspace() for s in shape), "/" in marks, ":" in marks,
        bool(marks - set("@.+()-/:%_[]")), 16 <= len(digits) <= 19 and luhn(digits),
        len(groups) == 4 and not letters and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        len(groups) == 4 and not letters and any(len(g) > 3 or int(g) > 255 for g in groups),
        bool(letters) and own.endswith(letters[-1]) and len(letters) > 2, any(a.isalpha() and b.isdigit() for a, b in zip(shape, shape[1:])),
        len(groups) > 2 and len({len(g) for g in groups}) == 1, not (own[:1].isalnum() or own[:1] in "+("), own[-1:].isdigit(),
    ]
    out = [k for k, f in enumerate(flags) if f]
    at = len(flags)
    out.append(at + min(words, MOST_WORDS) - 1)
    at += MOST_WORDS
    out.append(at + sum(len(digits) >= b for b in _BOUNDS))
    at += len(_BOUNDS) + 1
    out.append(at + min(len(groups), 6))
    return out


def candidates(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Segments of a region: first word, word after the last, begin, end. The edge words hold anchors
    or open a spelled-out address."""
    anchored = [bool(_ANCHOR.search(text, a, b)) for a, b in words]
    spelled = any(text[a:b].strip(_EDGE + "()").lower() == "dot" for a, b in words)
    out = []
    for i in range(len(words)):
        for j in range(i + 1, min(len(words), i + MOST_WORDS) + 1):
            if not any(anchored[i:j]) or not (spelled or (anchored[i] and anchored[j - 1])):
                continue
            begin, end = _trimmed(text, words[i][0], words[j - 1][1])
            if end - begin > 3:
                out.append((i, j, begin, end))
    return out


def best_segments(n_words: int, segments: list[tuple[int, int, int, int]], scores: np.ndarray) -> list[tuple[int, int]]:
    """(segment, type) of the best way to cut n words into entities and single words outside them."""
    best, back = [0.0] * (n_words + 1), [None] * (n_words + 1)
    ends: dict[int, list[int]] = {}
    for s, (_, j, _, _) in enumerate(segments):
        ends.setdefault(j, []).append(s)
    for j in range(1, n_words + 1):
        best[j] = best[j - 1]
        for s in ends.get(j, ()):
            kind = int(scores[s].argmax())
            value = best[segments[s][0]] + scores[s, kind]
            if value > best[j]:
                best[j], back[j] = value, (s, kind)
    out, j = [], n_words
    while j:
        if back[j] is None:
            j -= 1
        else:
            out.append(back[j])
            j = segments[back[j][0]][0]
    return out[::-1]


def _posterior(n_words: int, segments, scores: np.ndarray) -> np.ndarray:
    """Chance of every (segment, type) under the field: forward and backward sums."""
    ahead, behind = np.full(n_words + 1, -np.inf), np.full(n_words + 1, -np.inf)
    ahead[0] = behind[n_words] = 0.0
    by_segment = np.logaddexp.reduce(scores, axis=1) if len(scores) else np.empty(0)
    for j in range(1, n_words + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + v for (i, e, _, _), v in zip(segments, by_segment) if e == j)])
    for i in range(n_words - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[e] + v for (b, e, _, _), v in zip(segments, by_segment) if b == i)])
    place = np.array([ahead[i] + behind[e] for i, e, _, _ in segments]) - ahead[n_words]
    return np.exp(scores + place[:, None])


def variants(kind: str, span: str) -> list[str]:
    """Spellings of the same data that the patterns miss."""
    digits = only_digits(span)
    if kind == "email":
        name, _, domain = span.rpartition("@")
        return [f"{name} at {domain.replace('.', ' dot ')}", f"{name} [at] {domain.replace('.', ' [dot] ')}", f"{name}(at){domain.replace('.', '(dot)')}"]
    if kind == "phone":
        tail = digits[-10:]
        return [f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"00{digits[:-10]} {tail[:3]} {tail[3:6]} {tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}"]
    if kind == "card":
        return [".".join(digits[k : k + 4] for k in range(0, len(digits), 4)), "/".join(digits[k : k + 4] for k in range(0, len(digits), 4))]
    return [span.replace(".", "[.]"), span.replace(".", "(.)")]


def strangers(seed: int) -> list[str]:
    """Numbers and words that are nobody's data."""
    h = int(hashlib.md5(str(seed).encode()).hexdigest(), 16)
    d = str(h)
    wrong = d[:16] if not luhn(d[:16]) else d[:15] + str((int(d[15]) + 1) % 10)
    year = 1900 + h % 150
    return [
        d[: 1 + h % 7], d[:12], wrong, f"{year}-{1 + h % 12:02d}-{1 + h % 28:02d}", f"{h % 28 + 1}.{h % 12 + 1}.{year}", f"{d[:2]}.{d[2:4]}",
        f"{h % 24:02d}:{h % 60:02d}", f"{d[:1]}.{d[1:2]}.{d[2:3]}", f"{300 + h % 600}.{d[:3]}.{d[3:6]}.{d[6:8]}", f"{h:x}"[:24], f"{h:x}"[:40],
        f"{d[:3]} {d[3:5]}", f"{d[:4]} {d[4:8]}", f"{d[:1]},{d[1:4]},{d[4:7]}", f"${d[:4]}.{d[4:6]}", f"no {d[:3]} dot", f"at {d[:2]}", f"{d[:5]}-{d[5:9]}",
        " ".join(wrong[k : k + 4] for k in range(0, 16, 4)), f"{d[:2]}/{d[2:4]}", f"v{d[:1]}.{d[1:3]}", f"{d[:3]}-{d[3:8]}", f"{d[:9]}", f"{d[:20]}", f"{d[:11]}",
        f"{d[:10]}", f"{d[:3]} {d[3:6]} {d[6:9]}", f"{d[:2]} of {d[2:4]}", f"{d[:1]} {d[1:2]} {d[2:3]} {d[3:4]}", f"@{d[:3]}", "a@b", f"x{d[:8]}",
    ]


def excerpts(text: str) -> list[tuple[str, str, str, str]]:
    """(kind, before, span, after) of base spans that no other base span touches."""
    spans = sorted((a, b, k) for k, own in base_spans(text).items() for a, b in own)
    out = []
    for n, (a, b, kind) in enumerate(spans):
        if (n and spans[n - 1][1] > a - 40) or (n + 1 < len(spans) and spans[n + 1][0] < b + 40):
            continue
        before, after = " ".join(text[max(0, a - 40) : a].split()[-2:]), " ".join(text[b : b + 40].split()[:2])
        out.append((kind, before, text[a:b], after))
    return out


def _example(before: str, span: str, after: str, kind: int | None):
    """Words, segments, features and gold segment of one training line; None if it cannot be cut."""
    text = f"{before} {span} {after}".strip()
    begin = text.index(span, max(0, len(before) - 1)) if span in text else 0
    words = [m.span() for m in _WORD.finditer(text)]
    segments = candidates(text, words)
    if not segments:
        return None
    gold = [s for s, (_, _, a, b) in enumerate(segments) if (a, b) == _trimmed(text, begin, begin + len(span))] if kind is not None else []
    if kind is not None and not gold:
        return None
    x = np.zeros((len(segments), len(FEATURE_NAMES)))
    for s, (i, j, a, b) in enumerate(segments):
        x[s, segment_features(text, a, b, j - i)] = 1
    return len(words), segments, x, gold[0] if gold else None, kind


def train(lines: list[tuple[str, str, str, str]]) -> np.ndarray:
    """Weights (type, feature) from excerpts; zeros when there are none, so that nothing is added."""
    weights = np.zeros((len(KINDS), len(FEATURE_NAMES)))
    lines = sorted(set(lines))
    if not lines:
        return weights - 1.0
    examples = []
    for n, (kind, before, span, after) in enumerate(lines):
        k = KINDS.index(kind)
        spelled = variants(kind, span)
        examples.append(_example(before, span, after, k))
        examples.append(_example(before, spelled[n % len(spelled)], after, k))
        odd = strangers(n)
        examples += [_example(before, odd[(n + j * 7) % len(odd)], after, None) for j in range(3)]
    examples = [e for e in examples if e is not None]
    squares = np.full_like(weights, 1e-6)
    for step in range(STEPS):
        for n_words, segments, x, gold, kind in examples if step % 2 == 0 else examples[::-1]:
            chance = _posterior(n_words, segments, x @ weights.T)
            slope = -(chance.T @ x)
            if gold is not None:
                slope[kind] += x[gold]
            slope -= SHRINK * weights
            squares += slope * slope
            weights += RATE * slope / np.sqrt(squares)
    return np.round(weights, 6)


def added_spans(text: str, base: dict[str, list[tuple[int, int]]], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """Segments of the field's best cut that touch no base span."""
    taken = sorted(s for own in base.values() for s in own)
    out = []
    for words in regions(text):
        segments = candidates(text, words)
        if not segments:
            continue
        x = np.zeros((len(segments), len(FEATURE_NAMES)))
        for s, (i, j, a, b) in enumerate(segments):
            x[s, segment_features(text, a, b, j - i)] = 1
        for s, kind in best_segments(len(words), segments, x @ weights.T):
            a, b = segments[s][2:]
            if not any(p < b and a < q for p, q in taken):
                out.append((KINDS[kind], a, b))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def _found(weights: np.ndarray):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"]
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py()
                base = base_spans(text)
                own = [(k, a, b) for k, spans in base.items() for a, b in spans]
                rows.append((*(len(base[k]) for k in KINDS), joined(own), joined(own + added_spans(text, base, weights))))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    return found


def _excerpted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [x for text in batch.column(0) for x in excerpts(text.as_py())]
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["kind", "before", "span", "after"])


def fit(df: DataFrame, text_column: str = "text", lines: int = SAMPLE_EXCERPTS) -> np.ndarray:
    """The field's weights from at most ``lines`` excerpts around the base spans of all texts, evenly by
    kind: of every kind the different ones with the smallest hash, however often they are repeated and
    however many texts have none. Every text is read whole."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    own = df.select(text.alias("_text")).where(F.col("_text").rlike("[0-9@]"))
    found = own.mapInArrow(_excerpted, "kind string, before string, span string, after string")
    found = stored(found.distinct(), "excerpts")
    each = [
        found.where(F.col("kind") == k).orderBy(F.xxhash64("before", "span", "after"), "span", "before", "after").limit(lines // len(KINDS))
        for k in KINDS
    ]
    rows = each[0].union(each[1]).union(each[2]).union(each[3]).collect()
    return train([tuple(r) for r in rows])


def find(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """One row per row of ``df``: id, base spans per kind (``n_email``, ``n_ip``, ``n_card``, ``n_phone``),
    ``base_spans`` and ``spans`` (base and added) as kind:start:end, by kind, then start, comma-joined.

    Null and empty texts have none. Ids are passed on, null or repeated; other columns are ignored;
    empty tables give no rows. Every text is read whole. ``weights`` are trained on ``df`` unless given.
    """
    trained = fit(df, text_column) if weights is None else weights
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("_text"))
    kind = "_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"
    return rows.mapInArrow(_found(trained), kind).withColumnRenamed("_id", id_column)
