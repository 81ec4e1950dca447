"""Operators against brute force and hand-written rows, with the awkward rows of every contract."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from talkledger.llm import decontam, licences, lm, mixing, neardup, pii, quality, sharding, topk, warc
from talkledger.llm.queries import OP8, SHARDS, SLOTS

from . import brute

SCHEMA = "doc_id long, text string, source string, _id string, size string, shard string, _raw int"


def frame(spark, rows, schema=SCHEMA):
    """(id, text, source) rows with further columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, s, "x", None, "old", 1) for i, t, s in rows], schema)


def prose(seed, n, words=("sun", "moon", "tree", "river", "stone", "cloud", "wind", "leaf", "bird", "hill")):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(words) + str(rnd.randint(0, 30)) for _ in range(n))


def awkward():
    base = prose(1, 60)
    rows = [(1, base, "a"), (2, base, "a"), (3, base + " more", "b"), (4, None, None), (5, "", "b"), (6, " \n\t ", "b"), (7, "one two", "c"),
            (8, "One  TWO", "c"), (9, prose(2, 3000), "a"), (10, prose(3, 40), None), (None, base, "a"), (11, base, "a"), (11, base, "a"), (12, prose(4, 80), "b")]
    rows += [(20 + k, " ".join(w if (j * 7 + k) % 25 else f"x{k}" for j, w in enumerate(prose(5, 100).split())), "a") for k in range(12)]
    return rows


def test_sharding(spark):
    names, slots = [f"s{k}" for k in range(5)], 101
    table = sharding.filled_table(names, slots)
    # independent walk: explicit preference lists, one claim per turn
    order = []
    for s in names:
        start, step = sharding._number(s, "start") % slots, sharding._number(s, "step") % (slots - 1) + 1
        order.append([(start + j * step) % slots for j in range(slots)])
    want, turn = {}, 0
    while len(want) < slots:
        want[next(x for x in order[turn % 5] if x not in want)] = turn % 5
        turn += 1
    assert table == [want[k] for k in range(slots)]
    assert {table.count(k) for k in range(5)} <= {20, 21}
    fewer = sharding.filled_table(names[:4], slots)
    assert sum(a != b for a, b in zip(table, fewer) if a < 4) < slots * 0.3
    got = sharding.place(frame(spark, awkward()), shards=names, slots=slots)
    assert got.count() == len(awkward()) and got.columns.count("shard") == 1
    assert got.where("shard is null").count() == 0
    assert got.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert sharding.place(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.filled_table(["a", "a"], 7)


PAGES = [(1, "u1", "x" * 50), (2, "u2", "x" * 50), (3, "u\r\n3", None), (4, None, ""), (None, "u5", "x" * 50), (6, "u6", "é" * 30_000), (7, "u7", "y"),
         (7, "u7", "y"), (0, "u0", "y")]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, payload string")
    warc.write(df, str(tmp_path / "a"))
    records = warc.read(spark, str(tmp_path / "a"))
    assert sorted(r.payload.decode() for r in records.collect() if r.payload is not None and r.record_type == "response") == sorted(
        ["x" * 50, "", "é" * 30_000, "x" * 50, "y"])
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_records(records).collect()}
    d = lambda t: warc.digest_of(t.encode())
    assert got == {
        (1, 50, d("x" * 50), "response", None), (2, 50, d("x" * 50), "revisit", 1), (3, 0, d(""), "response", None), (4, 0, d(""), "revisit", 3),
        (None, 50, d("x" * 50), "response", None), (6, 60_000, d("é" * 30_000), "response", None), (7, 1, d("y"), "revisit", 0), (0, 1, d("y"), "response", None),
    }
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_warc_ranges_and_broken_files(spark, tmp_path):
    rnd = random.Random(3)
    records, raw = [], b""
    for k in range(40):
        payload = bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 400))) + (warc.MAGIC * 3 if k % 4 == 0 else b"") + b"tail"
        text = warc.VERSION + f"WARC-Type: response\r\nWARC-Record-ID: <r{k}>\r\nX-Page-Id: {k}\r\n".encode()
        block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
        text += f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        stored = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored as it is, so that the magics stay visible
        raw += stored.compress(text) + stored.flush()
        records.append((str(k), payload))
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.warc.gz").write_bytes(raw)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300b", "1700b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = warc.read(spark, str(tmp_path / "x")).collect()
            assert sorted((r.page_id, bytes(r.payload)) for r in got if r.error is None) == sorted(records)
            assert all(r.error is None for r in got)
        (tmp_path / "y").mkdir()
        (tmp_path / "y" / "a.warc.gz").write_bytes(raw[:-20])
        got = warc.read(spark, str(tmp_path / "y")).collect()
        assert len([r for r in got if r.error is None]) == 39 and any(r.error for r in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.3) for r in rows)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    none = quality.scores(frame(spark, awkward()), labels.limit(0)).collect()
    assert len(none) == len(awkward()) and {r.score for r in none} == {0.5}
    marks = spark.createDataFrame([(k, k % 2) for k in range(1, 13)] + [(1, None), (2, 7)], "doc_id long, quality int")
    some = quality.scores(frame(spark, awkward()), marks).collect()
    assert len(some) == len(awkward()) and all(0 <= r.score <= 1 for r in some)
    assert quality.scores(frame(spark, []), labels).count() == 0
    assert quality.accepted(frame(spark, awkward()), labels.limit(0)).columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


def test_isotonic():
    place, share = quality.monotone(np.arange(4.0), np.array([1.0, 0.0, 1.0, 4.0]), np.array([2.0, 2.0, 2.0, 4.0]))
    assert share.tolist() == [0.25, 0.5, 1.0] and place.tolist() == [0.5, 2.0, 3.0]


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = {}
    for kind, pattern in PLAIN.items():
        own = []
        for m in re.finditer(pattern, text):
            digits = pii.only_digits(m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            own += [m.span()] * good
        out[kind] = own
    return out


def test_base_spans():
    rnd = random.Random(5)
    for _ in range(4000):
        text = "".join(rnd.choice(["a", "b@c.d", "@", ".", "-", "_", " ", "1", "23", "+4", "(5)", "192.168.0.1", "4539148803436467", "é", "%", "00"]) for _ in range(rnd.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 200_000)["ip"] == []


def plain(seed):
    return re.sub("[0-9]", "", prose(seed, 16))


def test_personal_data(spark):
    rows = [(k, f"{plain(k)} write to n{k}.x@mail{k}.example.org {plain(k + 1)} call +1 (741) 555-{1000 + k} {plain(k + 2)} from 10.0.{k}.7 "
             f"{plain(k + 3)} pay {'4539148803436467' if k % 2 else '4485275742308327'} {plain(k + 4)}", "a") for k in range(40)]
    rows += [(100, "call (741) 555-3069 today", "a"), (101, None, "a"), (102, "", "a"), (None, "a@b.c", "a"), (None, "a@b.c", "a"), (103, prose(7, 5000), "a"),
             (104, "room 12 at 10:30 on 2021-05-06, item 3.14, order 1234567890", "a")]
    got = pii.find(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r, (i, t, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        want = plain_spans(t or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii.KINDS]
        assert set(filter(None, r.base_spans.split(","))) <= set(filter(None, r.spans.split(",")))
    by = {r.doc_id: r for r in got}
    assert by[100].spans == "phone:5:19" and by[103].spans == by[104].spans == by[101].spans == by[102].spans == ""
    assert pii.find(frame(spark, [])).count() == 0


def test_field_learns_from_all_texts(spark):
    rows = [(k, f"{plain(k)} call +1 (741) 555-{1000 + k} {plain(k + 2)} from 10.0.{k}.7 {plain(k + 3)} write to n{k}.x@mail{k}.example.org", "a") for k in range(40)]
    rows.append((40, f"{plain(9)} pay 4539148803436467 {plain(8)}" + " sun" * 40_000, "a"))
    want = pii.fit(frame(spark, rows))
    assert (want[pii.KINDS.index("card")] > 0).any()
    hashes = spark.createDataFrame([(f"room {k} today",) for k in range(3000)] + [(t,) for _, t, _ in rows], "t string").select("t", F.xxhash64("t").alias("h"))
    hot = hashes.orderBy("h").first().t
    assert hot.startswith("room")
    for more in ([(50, hot, "b")] * 2100, [(100 + k, f"room {k} today", "b") for k in range(3000)], [rows[3]] * 2100):
        assert np.array_equal(pii.fit(frame(spark, rows + more)), want)
    found = pii.find(frame(spark, rows + [(50, hot, "b")] * 2100 + [(60, "call (741) 555-3069 today", "b")]))
    assert found.where("doc_id = 60").first().spans == "phone:5:19"


def test_best_segments_against_all_cuts():
    rnd = np.random.default_rng(1)
    segments = [(i, j, 0, 0) for i in range(5) for j in range(i + 1, min(5, i + 3) + 1)]
    scores = rnd.normal(size=(len(segments), 2))

    def best(at):
        if at == 5:
            return 0.0
        return max([best(at + 1)] + [scores[s].max() + best(j) for s, (i, j, _, _) in enumerate(segments) if i == at])

    found = pii.best_segments(5, segments, scores)
    assert sum(scores[s, k] for s, k in found) == pytest.approx(best(0))
    total = pii._posterior(5, segments, scores)
    assert (total.sum() <= 5) and (total >= 0).all()


def test_targets():
    assert mixing.shared_targets([10, 10, 10]) == [30.0 * 5 / 8, 30.0 * 2 / 8, 30.0 / 8]
    assert mixing.shared_targets([1, 100, 100]) == [3.0, pytest.approx(198 * 2 / 3), pytest.approx(198 / 3)]
    assert mixing.shared_targets([]) == [] and mixing.shared_targets([0, 0]) == [0.0, 0.0]


def test_mixing(spark):
    rows = [(k, prose(k, 5 + k % 50), ["a", "b", "c", None][min(3, k % 7)]) for k in range(400)] + awkward()
    df = frame(spark, rows)
    got = mixing.mix(df, group_rows=50).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(df, group_rows=50).collect()), key=repr)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.shared_targets([size[s] for s in order])))
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 60 for s in order)
    assert mixing.mix(frame(spark, [])).count() == 0
    again = mixing.repeated(df, mixing.mix(df, group_rows=50))
    assert again.columns == df.columns


def test_language_model(spark):
    rows = [(k, prose(k, 12), "a") for k in range(25)] + [(90, None, "a"), (91, "", "a"), (None, "Sun moon", "a"), (92, "ß\x00 é", "a"), (92, "again", "b")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [t or "" for i, t, _ in rows if not held(i)]
    chance, counts = brute.context_tree(train, 2), {}
    for t in train:
        for w in [*t.encode().lower().split(), b""]:
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    want = []
    for i, t, _ in rows:
        tokens = [*(t or "").encode().lower().split(), b""]
        base = sum(np.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in tokens)
        want.append((i, held(i), len(tokens), sum(w in counts for w in tokens), total, base, chance(t or "")))
    got = lm.scores(frame(spark, rows), depth=2, block_bytes=300, buckets=5).drop("bits_per_byte").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert lm.scores(frame(spark, [])).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 7, 50, 1000])
def test_contexts_in_pieces(piece):
    rnd = random.Random(piece)
    texts = [bytes(rnd.choice(b"abCD e") for _ in range(rnd.choice([0, 0, 1, 2, 6, 7, 8, 30, 200]))) for _ in range(60)]
    want = [(b"\0\0" + t.lower() + lm.END)[k : k + 3] for t in texts for k in range(len(t) + 1)]
    got, sizes = [], [0] * len(texts)
    for first, codes, lengths in lm.gram_pieces(texts, 2, piece):
        got += [int(c).to_bytes(3, "big") for c in codes]
        for k, n in enumerate(lengths):
            sizes[first + k] += int(n)
    assert got == want and sizes == [len(t) + 1 for t in texts]


def test_near_duplicates(spark):
    rows = awkward()
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute.components([(i, t) for i, t, _ in rows])
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    sizes = sorted((r.doc_id or 0, r.n_shingles) for r in got)
    assert sizes == sorted((i or 0, len(brute.shingle_set(t))) for i, t, _ in rows)
    assert neardup.near_duplicates(frame(spark, [])).count() == 0


def test_hot_groups_are_linked_whole(spark):
    """Near copies of one text that are far from each other, and many texts around one passage."""
    rnd, base, passage = random.Random(8), prose(50, 120).split(), prose(51, 30)
    rows = [(k, " ".join(f"y{k}-{j}" if rnd.random() < 0.03 else w for j, w in enumerate(base)), "a") for k in range(150)]
    rows += [(1000 + k, f"{passage} {prose(k + 200, 25)}", "a") for k in range(150)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), block_rows=40).collect()}
    assert got == brute.components([(i, t) for i, t, _ in rows])


def test_few_pairs_at_the_limit_are_implausible():
    from math import comb

    def lost(n, agree):
        """Chance that a pair at 0.75 agrees in so few of n places that ``agree`` turns it down."""
        return sum(comb(n, k) * 0.75**k * 0.25 ** (n - k) for k in range(n + 1) if not agree(k))

    # one set of 10^6 members against another that agrees in the first k places
    n, size = 2 * neardup.KEYS * neardup.ROWS, np.array([1e6])
    full = [np.ones((1, n), np.uint8), np.ones((1, neardup.BINS), np.uint8), size]

    def other(width, k):
        return np.where(np.arange(width) < k, 1, 2).astype(np.uint8)[None]

    by_hashes = lost(n, lambda k: neardup._plausible(75, full, [other(n, k), full[1], size])[0])
    by_bins = lost(neardup.BINS, lambda k: neardup._plausible(75, full, [full[0], other(neardup.BINS, k), size])[0])
    assert by_hashes + by_bins < 3e-5


def test_an_id_with_several_texts_is_one_document(spark):
    text = [prose(60 + k, 80) for k in range(6)]
    rows = [(3, text[0], "a"), (5, text[0], "a"), (5, text[1], "a"), (7, text[1] + " more", "a"), (8, text[2], "a"), (9, text[3], "a"), (10, text[2], "a"),
            (10, text[3], "a"), (11, text[4], "a"), (12, text[4], "a"), (12, "", "a"), (13, text[5], "a"), (None, text[0], "a"), (14, text[0], "a"), (14, text[0], "a")]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(3, 3), (5, 3), (7, 3), (8, 8), (9, 8), (10, 8), (11, 11), (12, 11), (13, 13), (None, None), (14, 3)}


def test_components_of_a_path(spark):
    path = spark.range(60).selectExpr("(id * 37) % 61 a", "((id + 1) * 37) % 61 b")
    assert {r._comp for r in neardup.components(path).collect()} == {0}


def test_decontamination(spark):
    item = prose(70, 30).split()
    changed = lambda *at: " ".join("zz" if k in at else w for k, w in enumerate(item))
    tests = spark.createDataFrame([(1, " ".join(item), 1), (2, None, 1), (3, "", 1), (4, "Short, exact item!", 1), (1, " ".join(item), 1)], "item_id long, text string, _words int")
    docs = [(1, f"start {' '.join(item)} end", "a"), (2, changed(*range(0, 30, 3)), "a"), (3, changed(5, 11), "a"), (4, " ".join(item[4:17]).upper(), "a"),
            (5, " ".join(item[4:16]), "a"), (6, "a short exact item here", "a"), (7, "short exact thing", "a"), (8, None, "a"), (9, "", "a"),
            (10, f"{prose(71, 2000)} {changed(12)}", "a"), (None, " ".join(item), "a")]
    found = {(r.doc_id, r.item_id): r.agreeing for r in decontam.overlaps(frame(spark, docs), tests).collect()}
    assert found == {(1, 1): 13, (3, 1): 13, (4, 1): 13, (6, 4): 3, (10, 1): 13, (None, 1): 13}
    assert sorted(r.doc_id or 0 for r in decontam.clean(frame(spark, docs), tests).collect()) == [0, 2, 5, 7, 8, 9]
    assert decontam.overlaps(frame(spark, []), tests).count() == 0 and decontam.overlaps(frame(spark, docs), tests.limit(0)).count() == 0


def test_masks_find_every_two_substitutions(spark):
    item = [f"w{k}" for k in range(13)]
    docs = [(i * 13 + j, " ".join("x" if k in (i, j) else w for k, w in enumerate(item)), "a") for i in range(13) for j in range(13)]
    tests = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: r.agreeing for r in decontam.overlaps(frame(spark, docs), tests).collect()}
    assert found == {i * 13 + j: 13 - len({i, j}) for i in range(13) for j in range(13)}


def test_top_k(spark):
    rnd = random.Random(9)
    rows = [(k, [rnd.choice([-1.0, -0.5, 0.0, 0.25, 0.999]) for _ in range(3)]) for k in range(120)]
    bad = [(200, None), (201, []), (250, [1.0, None, 0.0]), (251, [float("nan"), 0.0, 0.0]), (252, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])]
    # ids that repeat, with equal and with other vectors: rows, and queries, of their own
    rows += [rows[0], (50, [1.0, 1.0, 1.0]), (1, [9.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<float>, score int")
    whole = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)) for i, v in rows]
    want = []
    for a, (q, x) in enumerate(whole):
        if q % 50 == 0:
            best = sorted((-int(x @ y), c) for b, (c, y) in enumerate(whole) if a != b)[:5]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    for sizes in ((512, 4096), (2, 7)):
        got = topk.top_k(df, query_rows=sizes[0], candidate_rows=sizes[1]).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0, 3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (1, [9.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(twice, k=2).collect()] == [(0, 1, 1, 589_824), (0, 2, 2, 131_072)]


def test_licences(spark):
    mit = licences.NOTICES["ISC"][0]
    docs = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(", ", " ,  "), "a"), (2, "text\nReleased under the MIT Licence!\nmore", "a"), (3, None, "a"), (4, "", "a"),
            (5, mit + " and more", "a"), (6, prose(1, 4000), "a"), (None, "Released under the MIT License.", "a"), (7, "released  under THE mit license", "a"),
            (7, "Released under the MIT License.", "a")]
    got = {(r.doc_id, r.licence, r.n_licence_lines, r.line_licences) for r in licences.scan(frame(spark, docs), licences.published(spark)).collect()}
    assert got == {(1, "ISC", 1, "ISC"), (2, None, 1, "MIT"), (3, None, 0, ""), (4, None, 0, ""), (5, None, 0, ""), (6, None, 0, ""), (None, "MIT", 1, "MIT"), (7, "MIT", 2, "MIT")}
    known = spark.createDataFrame([(None, "x"), ("empty", ""), ("b", "Favour V2"), ("a", "favor version 2")], "licence string, text string")
    one = licences.scan(frame(spark, [(1, "Favor v2", "a")]), known).collect()
    assert [r.licence for r in one] == ["a"]
    assert licences.scan(frame(spark, []), known).count() == 0


def test_whole_licence_texts(spark):
    import textwrap
    from pathlib import Path

    files = {f.stem.partition("@")[0]: f.read_text() for f in sorted(Path(licences.__file__).parent.joinpath("licence_texts").glob("*.txt"), reverse=True)}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0", "0BSD", "ISC", "Zlib"} <= set(files)
    docs, want = [], {}
    for licence, text in files.items():
        forms = [text, text.upper().replace(" ", "   ")]
        if licence in licences.TITLES:
            cut = "\n\n".join(textwrap.fill(" ".join(p.split()), 66) for p in text.split("\n\n"))
            forms += [f"{t}\n\nCopyright (c) 2020 Someone\n\n{f}" for t in licences.TITLES[licence] for f in (text, cut)]
        if licences.END in text:
            forms.append(text[: text.index(licences.END) + len(licences.END)] + "\n")
        for form in forms:
            want[len(docs)] = licence
            docs.append((len(docs), form, "a"))
    for part in (files["0BSD"].split("\n\n")[0], files["MIT"] + "\nand more", files["GPL-3.0"][:-200]):
        want[len(docs)] = None
        docs.append((len(docs), part, "a"))
    got = licences.scan(frame(spark, docs), licences.published(spark)).collect()
    assert {r.doc_id: r.licence for r in got} == want


def test_licences_at_every_line_length(spark):
    """Each text with its paragraphs cut anew at any width, or with the line breaks of another system."""
    import textwrap
    from pathlib import Path

    docs, want = [], []
    for file in sorted(Path(licences.__file__).parent.joinpath("licence_texts").glob("*.txt")):
        text, licence = file.read_text(), file.stem.partition("@")[0]
        paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
        forms = [text.replace("\n", "\r\n"), "\n\n".join(paragraphs)]
        forms += ["\n\n".join(textwrap.fill(p, w, break_long_words=False, break_on_hyphens=False) for p in paragraphs) for w in (40, 47, 55, 66, 72, 80, 93, 120, 200)]
        for form in forms:
            docs.append((len(docs), form, "a"))
            want.append(licence)
    got = {r.doc_id: r.licence for r in licences.scan(frame(spark, docs), licences.published(spark)).collect()}
    assert [(want[k], docs[k][1][:60]) for k in got if got[k] != want[k]] == []
    assert sum(len(x) for x in licences.NOTICES.values()) < 150


def test_quality_scores_are_those_of_a_plain_fit(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9001, None), (9002, "")]
    marks = [(r.doc_id, r.quality) for r in labels.collect()]
    marks += [(marks[0][0], 1 - marks[0][1]), (9001, 0), (marks[1][0], None), (marks[2][0], 5)]
    got = quality.scores(frame(spark, [(i, t, "a") for i, t in rows]), spark.createDataFrame(marks, "doc_id long, quality int"))
    want = brute.quality_scores(rows, marks)
    for r in got.collect():
        assert abs(r.score - want[r.doc_id]) < 1e-4 and r.predicted == int(r.score >= 0.3), (r, want[r.doc_id])


def test_mixing_rates_solve_the_dual(spark):
    rnd = random.Random(8)
    docs = [(k, " ".join("w" * rnd.randint(1, 60)) if k % 9 else None, rnd.choice("aaabc") if k % 10 else None) for k in range(400)]
    got = mixing.mix(frame(spark, docs)).collect()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        rate = brute.tilted_rates([r.size for r in own], own[0].target, 3)
        assert all(abs(r.rate - x) < 1e-5 for r, x in zip(own, rate) if r.size), source
        assert abs(sum(r.rate * r.size for r in own) - own[0].target) < 1e-3 * own[0].target


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs, names = spark.read.parquet(f"{folder}/documents.parquet"), []
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        names.append(name)
        assert docs.columns[: len(columns)] == columns
        ids, left = {r.doc_id for r in before}, {r.doc_id for r in after}
        assert left <= ids
        if k == 0:
            # scores of this very input, put together without Spark's sums
            plain = brute.quality_scores([(r.doc_id, r.text) for r in before], labels)
            assert left == {i for i, x in plain.items() if x >= 0.3} and 0 < len(left) < len(ids)
        if k == 2:
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/1/*.parquet'; CREATE VIEW benchmark AS SELECT * FROM '{folder}/benchmark.parquet'")
            assert left == ids - {r[0] for r in con.execute(f"SELECT doc_id FROM ({OP8})").fetchall()} and left < ids
        if k == 1:
            label = brute.components([(r.doc_id, r.text) for r in before])
            assert left == {i for i in ids if label[i] == i}
        if k == 3:
            copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before, columns_of(docs))).collect()}
            assert sorted(r.doc_id for r in after) == sorted(i for i, n in copies.items() for _ in range(n))
        if k == 4:
            assert len(after) == len(before)
            filled = sharding.filled_table([f"shard-{k:05d}" for k in range(SHARDS)], SLOTS)
            assert all(r.shard == f"shard-{filled[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % SLOTS]:05d}" for r in after)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, after)) and len(whole) > 50
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None


def columns_of(docs):
    return "doc_id long, text string, lang string, source string, n_chars long"
