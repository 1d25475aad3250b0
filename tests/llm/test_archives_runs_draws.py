"""WARC archives, periodic runs and importance resampling against brute-force versions and hand-made cases."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.llm import importance_resampling, periodic_runs, queries, sql, warc
from tests import oracle

SF = "/root/testdata/sf0.001"


# op13


def plain_runs(words):
    """All runs by comparing each word with that a period later."""
    found = set()
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            stretch = words[start : i + q]
            if len(stretch) >= max(24, 3 * q) and not any(stretch[r:] == stretch[:-r] for r in range(1, q)):
                found.add((start, len(stretch), q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeating(seed):
    """A text of few or many words with repeated stretches."""
    rng = random.Random(seed)
    n, k = rng.choice([0, 1, 23, 24, 60, 150, 400]), rng.choice([1, 2, 3, 40])
    words = [b"%d" % rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n else 0):
        at, p = rng.randrange(n), rng.randint(1, max(1, n // 4))
        words[at : at + p] = words[at : at + p] * rng.randint(1, 9)
    return words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=6))
def test_runs_of_a_group(seeds):
    texts = [repeating(s) for s in seeds]
    assert [[tuple(r) for r in found.tolist()] for found in periodic_runs.runs_of(texts)] == [plain_runs(w) for w in texts]


def test_grid_in_blocks(monkeypatch):
    whole = [v for block in periodic_runs.grid(1000) for v in zip(*map(list, block), strict=True)]
    monkeypatch.setattr(periodic_runs, "PLACES", 7)
    assert [v for block in periodic_runs.grid(1000) for v in zip(*map(list, block), strict=True)] == whole
    texts = [repeating(s) for s in range(40, 50)]
    assert [[tuple(r) for r in found.tolist()] for found in periodic_runs.runs_of(texts)] == [plain_runs(w) for w in texts]


@pytest.mark.parametrize("n", [20_000, 80_000])
def test_runs_of_long_texts(n):
    assert periodic_runs.runs_of([[b"x"] * n])[0].tolist() == [[0, n, 1]]
    words = [b"%d" % i for i in range(n // 4)]
    assert periodic_runs.runs_of([words * 4])[0].tolist() == [[0, n, n // 4]]


def run_row(words):
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest(lines), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_run_query(spark, tmp_path):
    texts = [t["text"] for t in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [(i, t if t is None else " ".join(t.split(" ")[:900])) for i, t in enumerate(texts)] + [(500, " ".join(["a b c"] * 20 + ["x"] + ["d"] * 60)), (500, "\n".join(["é 日"] * 12)), (501, " a " * 23), (None, "z " * 99), (502, None), (503, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        want.append((i, *run_row(words)))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[1] > 0 for r in got) > 10


def test_collapsed_texts(spark):
    rows = spark.createDataFrame([(1, "start " + "la " * 30 + "end"), (2, "no repeats")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in periodic_runs.find_runs(rows).collect()}
    assert (found[1]["collapsed"], found[2]["collapsed"], found[2]["runs"]) == ("start la end", "no repeats", [])


# op12


def plain_features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in lowered).split(" ")
    words = [w for w in words if w]
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def plain_draw(docs, target):
    found = [(i, *plain_features(t)) for i, t in docs]
    counts, wanted = {}, {}
    for into, lists in ((counts, [f for *_, f in found]), (wanted, [plain_features(t)[1] for t in target])):
        for b in (b for f in lists for b in f):
            into[b] = into.get(b, 0) + 1
    s, t = sum(counts.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted.get(b, 0) + 1) * (s + 10_000) / ((n + 1) * (t + 10_000)))) for b, n in counts.items()}
    rows = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    rows.sort(key=lambda r: (r[1] < 20, -r[4], r[0] is None, r[0] or 0))
    most = sum(r[1] >= 20 for r in rows) * 25 // 100
    return [(i, k, w, score, place + 1 if place < most else None) for place, (i, _, k, w, score) in enumerate(rows)]


def test_draw_of_long_and_odd_texts(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["Alpha", "beta", "GAMMA-ray", "x1", "né", "日本", "9.5", "the"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 3, 19, 20, 40, 500, 2000]))) for i in range(60)] + [(7, "again " * 25), (8, None), (9, ""), (None, text(30)), (61, "-- \n\t"), (62, "x" * 5000)]
    target = [text(9) for _ in range(9)] + [None, "", "the beta"]
    frame = spark.createDataFrame([(*d, 1, "b", 2.0) for d in docs], "doc_id long, text string, row long, bucket string, weight double").repartition(5)
    got = importance_resampling.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), words_owned=16, long_bytes=300)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain_draw(docs, target)))


def test_draw_with_an_empty_side(spark):
    docs = [(i, f"word{i} " * 30) for i in range(8)]
    frame, none = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert sorted(tuple(r) for r in importance_resampling.resampled(frame, none).collect()) == sorted(plain_draw(docs, []))
    assert importance_resampling.resampled(frame.limit(0), frame.select("text")).collect() == []


@pytest.mark.parametrize("owned", [1, 2, 7, 100])
def test_each_feature_in_one_chunk(owned):
    words = [b"%d" % (i % 13) for i in range(57)]
    whole = sorted(importance_resampling.buckets(words, len(words)).tolist())
    parts = importance_resampling.chunks(words, owned)
    assert sorted(b for k, p in enumerate(parts) for b in importance_resampling.buckets(p, min(owned, len(words) - k * owned)).tolist()) == whole


# op11

PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (1, "http://b/1", "<p>one</p>"), (3, None, None), (4, "http://a/4", ""), (None, "http://a/5", ""), (None, "http://a/ 6", "only"), (7, "http://a/7", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3000), (8, "http://a/8", "é" * 40_000), (9, "http://a/9", "\r\n\r\n\r\n")]


def page_table(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, record_type string")


def expected(rows):
    least = {}
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    made = []
    for i, _, t in rows:
        first, raw = least.get(t or ""), (t or "").encode()
        again = first is not None and (i is None or i > first)
        made.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    return made


def test_round_trip_of_odd_pages(spark):
    got = warc.round_trip(page_table(spark).repartition(3))
    assert sorted(map(str, (tuple(r) for r in got.drop("problem").collect()))) == sorted(map(str, expected(PAGES)))
    assert got.filter("problem IS NOT NULL").count() == 0
    assert warc.round_trip(page_table(spark, [])).count() == 0


def test_payloads_come_back(spark, tmp_path):
    warc.write_archives(page_table(spark), f"file://{tmp_path}/a", segment=1000)
    got = {(r["page_id"], r["record_type"]): r for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect()}
    assert {k: bytes(got[k, "response"]["payload"]).decode() for k in (1, 7, 8, 9)} == {i: t for i, _, t in PAGES if i in (7, 8, 9)} | {1: PAGES[0][2]}
    assert got[2, "revisit"]["payload"] is None and got[2, "revisit"]["refers_to"] == 1
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "a").glob("*.gz"))
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and raw.count(b"WARC-Type: continuation") > 100


def archive(path, records):
    """A foreign archive: a gzip member for each record."""
    path.write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records))


def test_segments_anywhere(spark, tmp_path):
    text = "".join(f"line {i}\r\n\r\n" for i in range(400))
    parts = warc.page_records(5, 50, "http://x/", text.encode(), None, None, segment=700)
    other = warc.page_records(6, 60, "http://y/", b"short", None, None)
    random.Random(1).shuffle(parts)
    archive(tmp_path / "one.warc.gz", [warc.record({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:i>"}, b"software: x\r\n\r\n"), *parts[::2], *other])
    archive(tmp_path / "two.warc.gz", [*parts[1::2], parts[1]])  # one segment twice
    got = {r["page_id"]: r for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert bytes(got[50]["payload"]).decode() == text and bytes(got[60]["payload"]) == b"short"
    assert [got[i]["problem"] for i in (50, 60)] == [None, None]


def test_faults_are_told(spark, tmp_path):
    cut = warc.page_records(1, 1, None, b"a" * 3000, None, None, segment=1000)
    wrong = [r.replace(b"Total-Length: ", b"Total-Length: 1") for r in warc.page_records(2, 2, None, b"b" * 3000, None, None, segment=1000)]
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x>"}
    http = b"HTTP/1.0 200 OK\r\nTransfer-Encoding: gzip, Chunked\r\n\r\n"
    framed = [b"5;name=value\r\nhello\r\n0\r\nTrailer: 1\r\n\r\n", b"5\r\nhello", b"x\r\nhello\r\n0\r\n\r\n", b"5\r\nhello\r\n0\r\n\r\n"]
    single = [warc.record(fields | {warc.PAGE: 10 + k}, http + f) for k, f in enumerate(framed)]
    plain = warc.record(fields | {warc.PAGE: 20, "X-Folded": "a\r\n b"}, b"HTTP/1.1 200 OK\r\n\r\nas it is")
    late = warc.record(fields | {warc.PAGE: 21, "WARC-Payload-Digest": "sha1:" + "A" * 32}, b"HTTP/1.1 200 OK\r\n\r\nother")
    bare = warc.record(fields | {warc.PAGE: 22}, b"<html>")
    headless = b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 23\r\nContent-Length: many"
    archive(tmp_path / "a.warc.gz", [cut[0], cut[2], *wrong, *single, plain, late, headless, bare])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(warc.record(fields | {warc.PAGE: 24}, b"x" * 100)[:-50]))
    got = {r["page_id"]: (r["problem"], r["payload"] and bytes(r["payload"])) for r in warc.read_archives(spark, f"file://{tmp_path}").collect()}
    assert got == {
        1: ("segments", None), 2: ("segments", None), 10: (None, b"hello"), 11: ("chunks", None), 12: ("chunks", None), 13: (None, b"hello"),
        20: (None, b"as it is"), 21: ("digest", None), 22: ("http", None), 23: ("record", None), 24: ("record", None),
    }


def test_revisits_of_what_is_not_there(spark, tmp_path):
    archive(tmp_path / "a.warc.gz", warc.page_records(1, 5, None, b"x", 4, None))
    rows = warc.page_index(warc.read_archives(spark, f"file://{tmp_path}")).collect()
    assert [(r["page_id"], r["payload_bytes"], r["refers_to"], r["problem"]) for r in rows] == [(5, None, 4, "revisit")]


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunks_undone(body, size):
    assert warc.out_of_chunks(warc.in_chunks(body, size)) == body


@pytest.mark.parametrize("name", ["op11_warc", "op12_importance_resampling"])
def test_rows_equal_sql(spark, name):
    got, want = oracle.compare(queries.QUERIES[name](spark, SF), oracle.database(SF), sql.ORACLES[name])
    assert got == want
