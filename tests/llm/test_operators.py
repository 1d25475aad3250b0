"""Operators against brute force, exact round trips, and held-out accuracy."""

from __future__ import annotations

import base64
import bz2
import gzip
import lzma
import random
import re
import time
import urllib.parse
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from docflow.llm import byte_bpe, components, embedding_dedup, fm_index, jaccard_join, language_id, pii, queries, secret_scan, sql, substring_dedup, toxicity, wording
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_rows_equal_sql(spark, name):
    got, want = oracle.compare(queries.QUERIES[name](spark, SF), oracle.database(SF), sql.ORACLES[name])
    assert got == want


def near_texts(seed=5, n=500):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 4, 5, 6, 12, 40, 90, 300]))] for _ in range(60)]
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            if w:
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(3)] = [f"x{rng.randrange(10**6)}"] * rng.randrange(2)
        yield i, " ".join(w + "common words that very many texts of this table share".split() * (rng.random() < 0.4))


@pytest.mark.parametrize("shared", [None, 1e-9, 0.9])  # as measured; segments of the first type; with one-deletion neighbourhoods
def test_jaccard_components_by_brute_force(spark, shared, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 16)  # groups are met in several tiles
    rows = list(near_texts())
    if shared == 0.9:
        assert any(jaccard_join.layout(b, 500, shared)[1] for b in range(8, 16)) and not any(jaccard_join.layout(b, 500, 1e-9)[1] for b in range(30))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), small_group=5, shared=shared).collect()}
    sets = {}
    for i, text in rows:
        w = text.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}


def test_distinct_shingles_are_counted(spark):
    for n in (0, 3, 300, 40_000):
        rows = spark.range(max(n // 20, 1)).selectExpr("id AS doc_id", f"CASE WHEN {n} > 0 THEN array_join(transform(sequence(1, least({n}, 20) + 4), i -> concat('w', id, '_', i)), ' ') END AS text")
        found = jaccard_join.distinct_tokens(jaccard_join.described(rows.union(rows)))
        assert abs(found - n) <= 0.25 * n


def test_linked_sets_share_a_subset_for_every_layout():
    rng = np.random.default_rng(1)
    for n in (1, 5, 9, 10, 36, 120, 500):
        for crowd in (10, 10**7, 10**12):  # few, many and very many sets that share a shingle: other types of segments
            a = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
            most = (n + n) * 20 // 180  # of shingles in which sets of this size may differ
            b = a.copy()
            b[: most // 2] = rng.integers(0, 2**63, most // 2, dtype=np.int64).astype(np.uint64)
            sets = [np.unique(a), np.unique(b)]
            keys, role, _ = jaccard_join.both_bands(np.concatenate(sets), np.array([len(x) for x in sets]), jaccard_join.Spread({k: crowd for k in range(60)}, 1e-4))
            assert set(keys[role < 2].tolist()) & set(keys[role >= 2].tolist())


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.loaded(*byte_bpe.default_vocabulary())


@pytest.fixture(scope="module")
def reference(bpe):
    return tiktoken.Encoding("own", pat_str=byte_bpe.default_vocabulary()[1], mergeable_ranks=bpe.ranks, special_tokens={})


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_bpe_as_the_library(bpe, reference, text):
    ids = bpe.encode_batch([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_bpe_long_pieces_and_round_trip(spark, docs, bpe, reference):
    for text in ("ab" * 900, "!?" * 700 + "  \n\n  x", " " * 3000, "don't <|endoftext|> 12345"):
        assert np.frombuffer(bpe.encode_batch([text])[0], "<u4").tolist() == reference.encode_ordinary(text)
    path, pattern = byte_bpe.default_vocabulary()
    back = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern)
    assert back.exceptAll(docs.select("doc_id", "text")).count() == 0


SECRET = 'password = "hunter2hunter2xx"'


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


@pytest.mark.parametrize(
    "wrapped",
    [
        urllib.parse.quote(SECRET, safe=""),
        urllib.parse.quote(urllib.parse.quote(SECRET, safe=""), safe=""),
        b64(SECRET.encode()),
        b64(gzip.compress(SECRET.encode())),
        urllib.parse.quote(b64(b"zz " + SECRET.encode()), safe=""),
        "".join(f"\\u{ord(c):04x}" for c in SECRET),
        SECRET.replace("p", "&#112;"),
    ],
)
def test_secrets_in_layers(wrapped):
    base, every = secret_scan.scan(f"before {wrapped} after")
    assert not base and len(every) == 1
    kind, start, end = every[0]
    assert kind == "assign" and 7 <= start < end <= 7 + len(wrapped)
    assert "hunter2" not in secret_scan.redact(f"before {wrapped} after", every)


def test_every_place_of_a_repeated_encoded_secret():
    once, packed = b64(SECRET.encode()), b64(gzip.compress(SECRET.encode()))
    text = f"first {once} then {once} and {packed} end"
    every = secret_scan.scan(text)[1]
    assert [k for k, *_ in every] == ["assign"] * 3
    assert all(text.index(once, at) <= s < e <= text.index(once, at) + len(once) for (_, s, e), at in zip(every, (0, 40), strict=False))
    clean = secret_scan.redact(text, every)
    assert not any(s for s in clean.split() if len(s) > 24 and secret_scan.scan(s)[1])
    assert clean.count("[SECRET]") == 3 and once not in clean and packed not in clean


@pytest.mark.parametrize(
    ("wrapped", "kind"),
    [
        (b64(b"0123456789abcdef"), "hex"),
        (b64(b"0123456789abcdef0"), "hex"),
        (b64(zlib.compress(b"0" * 16)), "hex"),
        ("https://h.example/cb/" + b64(SECRET.encode()), "assign"),
        ("https://h.example/ab/" + b64(gzip.compress(SECRET.encode())), "assign"),
        ("\\n" + b64(SECRET.encode()), "assign"),
        (b64(SECRET.encode()).rstrip("=") + "/x-y/z", "assign"),
        ("key_" + base64.urlsafe_b64encode(SECRET.encode() + b"\xff\xfe").decode(), "assign"),
        (b64(SECRET.encode("utf-16")), "assign"),
        (b64(SECRET.encode("utf-16-be")), "assign"),
        (b64("Пароль: ".encode("utf-16-le") + SECRET.encode("utf-16-le")), "assign"),
        (b64(b"\x00\x01\x02\x03" * 9 + SECRET.encode()), "assign"),
        ("%E9" + "".join(f"%{c:02X}" for c in SECRET.encode()), "assign"),
        (b64(b"caf\xe9 " + SECRET.encode()), "assign"),
    ],
)
def test_secrets_in_short_shifted_and_undecodable_runs(wrapped, kind):
    text = f"before {wrapped} after"
    base, every = secret_scan.scan(text)
    assert not base and {k for k, *_ in every} == {kind}
    assert all(7 <= s < e <= 7 + len(wrapped) for _, s, e in every)
    assert not secret_scan.scan(secret_scan.redact(text, every))[1]


@pytest.mark.parametrize("squeeze", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_secrets_in_later_members_and_beyond_a_window(squeeze):
    line, secret = b"plain words, again and again\n", SECRET.encode()
    for data in (squeeze(line) + squeeze(secret), squeeze(line * 4000 + secret + line), squeeze(line * 3) + squeeze(line * 2000) + squeeze(squeeze(secret))):
        text = f"before {b64(data)} after"
        every = secret_scan.scan(text, 1 << 14)[1]
        assert {k for k, *_ in every} == {"assign"}
        assert secret_scan.redact(text, every).rstrip("=") in ("before [SECRET] after", "before [SECRET]= after", "before [SECRET]== after")


@pytest.mark.parametrize(("members", "size"), [(400, 30), (50, 1 << 20)])
def test_members_are_read_once(members, size):
    """A run of many members takes time by its length, has no false mark, and a secret in a late one is found."""
    member = gzip.compress(b"plain words " * (size // 12))
    texts = [base64.b64encode(member * k + last).decode() for k in (members // 4, members) for last in (b"", gzip.compress(SECRET.encode()))]
    took = []
    for text in texts:
        began = time.process_time()
        base, every = secret_scan.scan(f"see {text} end")
        took.append(time.process_time() - began)
        assert (base != every) == (text in texts[1::2]) and "unread" not in {k for k, *_ in every}
    assert took[2] < 12 * max(took[0], 0.05) and took[2] < 30


def test_a_broken_member_does_not_hide_the_next():
    """What a cut or damaged member begins is looked at again from every later head."""
    member, secret = gzip.compress(b"plain words " * 50), gzip.compress(SECRET.encode())
    damaged = member[:-8] + bytes(8)
    for data in (member[:-9] + secret, damaged + secret, member + damaged + member + secret, b"x\x9c" + secret):
        assert secret_scan.scan(base64.b64encode(data).decode())[1], data


def test_unreadable_compressed_runs_are_redacted():
    bomb = b64(gzip.compress(gzip.compress(b"\n" * (1 << 22))))
    for text in (f"before {bomb} after", f"before {b64(gzip.compress(b'a' * (1 << 16)))} after"):
        every = secret_scan.scan(text, 1 << 12)[1]
        assert "unread" in {k for k, *_ in every}
        assert secret_scan.redact(text, every).split("=")[0].split()[:2] == ["before", "[SECRET]"]


@given(st.text("pastoken=:'\" %41&#;AKI0123456789abcdef\\u", max_size=60))
@settings(max_examples=200, deadline=None)
def test_base_secrets_by_brute_force(text):
    want = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?a:(?i:(password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    base, every = secret_scan.scan(text)
    assert base == secret_scan.ordered(want) and set(base) <= set(every)


def test_languages_held_out(docs):
    found = language_id.op7_rows(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.9


def test_toxicity_generalises_to_misspellings():
    rng = random.Random(3)
    calm = [f"{a}{b}" for a in ("lum", "tor", "ven", "sal", "mir") for b in ("an", "eth", "or", "ius", "el")]
    texts = [" ".join(rng.choices(calm, k=40)) for _ in range(300)]
    toxic = [i % 3 == 0 for i in range(300)]
    texts = [t.replace(t.split()[5], rng.choice(["idiot", "moron", "stupid"]), 1) if x else t for t, x in zip(texts, toxic, strict=True)]
    model = toxicity.fit(texts, list(map(int, toxic)), rounds=120)
    score = lambda t: model.of_text(model.of_words(toxicity.tokens(t)))
    assert score("lumeth toran venius idiiot salel") > 0.5 > score("lumeth toran venius salel miror")
    assert score("") == 0


def test_surrogates():
    text = "Call +1 (658) 555-4270, mail a.b9@mail4.example.com or a.b9@mail4.example.com; 17.57.238.115; card 4495114827612972; Mrs. Mary Jones, SSN 123-45-6789, DE89 3704 0044 0532 0130 00, 2024-01-02"
    new, found = pii.replace(text, b"key")
    assert [k for k, *_ in found] == ["phone", "email", "email", "ip", "card", "name", "ssn", "iban"]
    assert not any(text[s:e] in new for _, s, e in found)
    again = pii.detect(new)
    assert [k for k, *_ in again] == [k for k, *_ in found]
    made = [new[s:e] for _, s, e in again]
    assert made[1] == made[2] and len(set(made)) == 7
    assert made[5].split()[0] in pii.FIRST_NAMES["latin", "f"] and new.endswith("2024-01-02")
    assert pii.replace(text, b"key") == (new, found) != pii.replace(text, b"other")


def test_names_after_capitalised_words_and_compressed_addresses():
    for text, want in {
        "Contact John Smith today": "John Smith",
        "Dear Mary Jones, hello": "Mary Jones",
        "Пишет Анна Петрова": "Анна Петрова",
        "The Engineer John Paul Jones": "John Paul Jones",
        "Mr. John Paul Jones": "John Paul Jones",
        "from fe80::1: down": "fe80::1",
        "at ::1 only": "::1",
        "IP:2001:db8::ff00:42:8329.": "2001:db8::ff00:42:8329",
        "at 1:2:3:4:5:6:7:8": "1:2:3:4:5:6:7:8",
        "net fd::": "fd::",
        "as ::ffff:10.1.2.3": "::ffff:10.1.2.3",
    }.items():
        new, found = pii.replace(text, b"key")
        assert [text[s:e] for _, s, e in found] == [want]
        assert want not in new and [k for k, *_ in pii.detect(new)] == [found[0][0]]
    assert not pii.detect("at 12:30:45, std::vector, a:b, ::x, aa:bb:cc:dd:ee:ff and New York City ::")


@pytest.mark.parametrize(
    "originals",
    [
        [f"Госпожа {n}" for n in pii.FIRST_NAMES["cyrillic", "f"]],
        [f"Mr. {n}" for n in pii.FIRST_NAMES["latin", "m"]],
        ["Herr Ёё", "Herr Ёж"],
        [f"::{i}" for i in range(1, 10)],
        [f"{c}@{d}.de" for c in "abcdefghijklmnopqrstuvwxyz" for d in "abc"],
    ],
)
def test_surrogates_stay_distinct_when_a_list_is_used_up(originals):
    text = ", ".join(originals)
    new, found = pii.replace(text, b"key")
    before = [text[s:e] for _, s, e in found]
    assert len(before) == len(originals)
    parts = [p.split(" ", 1)[-1] for p in new.split(", ")]
    assert len(set(parts)) == len(originals) and not set(parts) & set(before)
    assert [k for k, *_ in pii.detect(new)] == [k for k, *_ in found]


@given(st.lists(st.integers(0, 9), min_size=1, max_size=3))
def test_permutation_is_one_to_one(values):
    size = len(values)
    images = {tuple(pii.permuted([int(c) for c in f"{i:0{size}d}"], [10] * size, b"k", "t")) for i in range(10**size)}
    assert len(images) == 10**size


@given(st.lists(st.tuples(st.integers(0, 9), st.lists(st.integers(1, 3), min_size=9, max_size=24)), min_size=1, max_size=12))
@settings(max_examples=100, deadline=None)
def test_matching_statistics_by_brute_force(runs):
    sizes = np.array([len(x) for _, x in runs])
    text = np.array([c for _, x in runs for c in (*x, 0)])
    ends = np.cumsum(sizes + 1) - 1
    fm = fm_index.FmIndex(text, 4, 9, np.repeat([v for v, _ in runs], sizes + 1))
    got = {(r, s): fm.least[g] for run, start, group in fm.matches(text, ends, sizes) for r, s, g in zip(run.tolist(), start.tolist(), group.tolist(), strict=True)}
    windows = {(r, s): tuple(x[s : s + 9]) for r, (_, x) in enumerate(runs) for s in range(len(x) - 8)}
    least = {}
    for (r, _), w in windows.items():
        least[w] = min(least.get(w, 99), runs[r][0])
    assert got == {k: least[w] for k, w in windows.items()}


@pytest.mark.parametrize("words", [1, 2, 5, 60])
def test_substrings_by_brute_force(words):
    rng = random.Random(words)
    base = [[f"w{rng.randrange(words)}" for _ in range(rng.randrange(60))] for _ in range(12)]
    rows = []
    for _ in range(80):
        text = [w for _ in range(rng.randrange(4)) for x in [rng.choice(base)] for w in x[rng.randrange(len(x) + 1) :]]
        if text and rng.random() < 0.3:
            text[rng.randrange(len(text))] = "other"
        rows.append((rng.randrange(60), rng.choice([" ", "\n", " \t"]).join(text)))
    least = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            least[tuple(w[k : k + 13])] = min(i, least.get(tuple(w[k : k + 13]), i))
    # in small chunks, so that runs meet in shards too, and by shard as the engine does
    groups = {}
    texts, ids, before = pa.array([t for _, t in rows]), np.array([i for i, _ in rows]), {}
    digests = np.arange(len(rows)).astype(np.uint32)
    for a, b, data, offsets in wording.chunks(texts, 2000):
        for row in substring_dedup.sent(data, offsets, ids[a:b], np.ones(b - a, bool), digests[a:b], 5, zstandard.ZstdCompressor().compress, before):
            groups.setdefault(row[0], []).append(row)
    gone = [[False] * len(t.split()) for _, t in rows]
    for found in groups.values():
        table = pa.table({n: [r[k] for r in found] for k, n in enumerate(("shard", "places", "owners", "bytes"))})
        for r in substring_dedup.search_shard(table).to_pylist():
            gone[r["h"]][r["s"] : r["e"]] = [True] * (r["e"] - r["s"])
    for (i, t), got in zip(rows, gone, strict=True):
        w, want = t.split(), [False] * len(t.split())
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                want[k : k + 13] = [True] * 13
        assert got == want


TEXTS = st.lists(st.one_of(st.none(), st.text("aB é\n\t\x0b\x1f\x85\u3000", max_size=30)), max_size=12)


@given(TEXTS, st.sampled_from([1, 20, 1 << 20]))
@settings(max_examples=100, deadline=None)
def test_words_of_batches(texts, size):
    got, names = [], {}
    for _, _, data, offsets in wording.chunks(pa.array(texts, pa.string()), size):
        starts, ends, counts = wording.word_places(data, offsets)
        words = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
        assert all(names.setdefault(w, h) == h for w, h in zip(words, wording.word_hashes(data, starts, ends).tolist(), strict=True))
        got += [words[e - n : e] for e, n in zip(np.cumsum(counts), counts, strict=True)]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    assert len(set(names.values())) == len(names)


def test_embedding_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x = np.concatenate([x, x[:100] + rng.normal(scale=0.1, size=(100, 16)), x[:20]]).astype(np.float32)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = (u @ u.T >= 0.93) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2) & ~np.eye(len(x), dtype=bool)
    found = sum(got.values())
    assert found >= 0.9 * linked.sum() and all(got[i] <= n for i, n in enumerate(linked.sum(1)))


def test_links_of_a_label_with_many_lists(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rng.normal(size=x.shape) * 0.34 / 8  # cosines of about 0.93 to 0.96
    both = np.concatenate([x, y]).astype(np.float32)  # 12,000 of a label: 47 lists
    rows = [(i, v.tolist(), 0) for i, v in enumerate(both)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(table).collect()}
    u = both.astype(float) / np.linalg.norm(both.astype(float), axis=1, keepdims=True)
    linked = [i for i in range(6000) if u[i] @ u[6000 + i] >= 0.93]
    found = [i for i in linked if got[6000 + i][1] == i]
    assert len(linked) > 1000 and len(found) >= 0.9 * len(linked)
    assert all(got[i][0] == got[6000 + i][0] == 1 for i in found)


def test_pipeline(spark, docs):
    out = corpus_pipeline.run(spark, SF)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, now = now, stage(spark, now, SF).cache()
        assert now.columns == docs.columns, name
        assert now.select("doc_id").distinct().count() <= before.select("doc_id").distinct().count()
    assert not any(secret_scan.find(r["text"]) for r in now.collect())
    texts = sorted((r["doc_id"], r["text"]) for r in now.collect())
    path, pattern = byte_bpe.default_vocabulary()
    assert sorted(tuple(r) for r in byte_bpe.decode(out, path, pattern).collect()) == texts


@pytest.mark.parametrize(
    ("text", "originals"),
    [
        ("John Smith arrived. Smith said that John was late. Mr. Smith left.", "John Smith"),
        ("Dr. Olivia Brown met Brown, and Brown's friend.", "Olivia Brown"),
        ("Hello, this is Mary. Mary called 5551234567. Later: 5551234567, or 017612345678.", "Mary 5551234567 017612345678"),
        ("My name is Wei Zhang; Zhang is here. I am Priya Patel. Frau Fatima Al-Sayed came, Al-Sayed left.", "Wei Zhang Priya Patel Fatima Al-Sayed"),
        ("Mr. Anna and Mr. Jones. Jones, Anna, jones.", "Anna Jones"),
    ],
)
def test_parts_of_names_refer_to_the_same(text, originals):
    """No original word is left, each is the same new one throughout, different ones differ, and the rest of the text stays."""
    new, _ = pii.replace(text, b"k" * 16)
    words = originals.split()
    assert not set(words) & set(re.findall(r"[\w-]+", new))
    pattern = re.compile("|".join(sorted(words, key=len, reverse=True)))
    shape = re.compile("(.+?)".join(map(re.escape, pattern.split(text))))
    became: dict[str, set[str]] = {}
    for was, now in zip(pattern.findall(text), shape.fullmatch(new).groups(), strict=True):
        became.setdefault(was, set()).add(now)
    assert all(len(v) == 1 for v in became.values()) and len(set.union(*became.values())) == len(became)


def test_capitalised_words_without_a_sign_of_a_name_stay():
    text = "I am German. The Red Cross came to New York on Monday. Order 5551234567 of 2024. Je suis Belge."
    assert pii.replace(text, b"k" * 16) == (text, [])


def test_tables_on_the_way_are_those_of_the_call(spark):
    """What two threads compute at once doesn't delete the other's tables."""
    from concurrent.futures import ThreadPoolExecutor

    from docflow.llm import common

    def make(k):
        inner = common.computed(spark, lambda: common.stored(spark.range(k), "first").filter("id > 0"), "inner")
        time.sleep(0.2)
        return inner.union(common.stored(spark.range(k), "second"))

    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda k: common.computed(spark, lambda: make(k), "outer").count(), [3, 5, 8]))
    assert got == [5, 9, 15]
