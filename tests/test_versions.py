"""Stores of versions under several writers, the outbox stream under crashes, and a served event stream."""

from __future__ import annotations

import json
import threading
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from docflow.operators import replay
from docflow.sources import files, sinks, sse, versions
from docflow.sources.versions import Change, Conflict
from docflow.streaming import outbox, preview

PAYLOADS = "document_id string, kind string, seq long, payload string"


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_one_of_many_writers(spark, tmp_path):
    """Each writer's rows are its own, so a mixture would show; the old version can be read all the time."""
    path = f"file://{tmp_path}/store"
    sinks.publish(spark.range(5), path)
    for base in (1, 2, 3):

        def wanted(k, base=base):
            try:
                return sinks.export(spark.range(100 * k, 100 * k + 7), path, base)
            except Conflict:
                return None

        with ThreadPoolExecutor(5) as pool:
            got = list(pool.map(wanted, range(5)))
        assert [x for x in got if x] == [base + 1]
        won = 100 * next(k for k, x in enumerate(got) if x)
        assert ids(sinks.exported(spark, path, "id long")) == list(range(won, won + 7))
        assert ids(sinks.exported(spark, path, "id long", 1)) == list(range(5))
    assert len(list((tmp_path / "store" / "data").iterdir())) == 4  # losers leave nothing
    assert not [p for p in (tmp_path / "store" / "versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_create_once(spark, tmp_path):
    path = f"file://{tmp_path}/m.json"
    with ThreadPoolExecutor(16) as pool:
        made = list(pool.map(lambda k: versions.create_once(spark, path, str(k) * 5000), range(16)))
    assert sum(made) == 1 and (tmp_path / "m.json").read_text() == str(made.index(True)) * 5000


def test_added_and_replaced_tables(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert versions.table(spark, path, "a", "id long").collect() == []
    for step in range(4):
        change = Change(spark, path)
        if step == 2:
            change.replace("a", spark.range(100, 102))
        else:
            assert change.add("a", spark.range(step, step + 1)).count() == 1
        change.add("b", spark.range(step))
        assert change.commit(step=step) == step + 1
    assert [ids(versions.table(spark, path, "a", "id long", k)) for k in (1, 2, 3, None)] == [[0], [0, 1], [100, 101], [3, 100, 101]]
    assert versions.table(spark, path, "b", "id long").count() == 6
    assert [v.note for v in versions.versions(spark, path)] == [{"step": k} for k in range(4)]


@pytest.mark.parametrize("crash", ["before", "after"])
def test_outbox_and_state_after_a_crash(spark, tmp_path, monkeypatch, crash):
    """A stream that dies between its data and its manifest, or between that and its checkpoint, sends nothing twice and loses nothing."""
    path, source = f"file://{tmp_path}/box", f"{tmp_path}/in"
    batches = [[("d", "p", 1, "a"), ("d", "p", 2, "a"), ("e", "p", 1, "x")], [("d", "p", 3, "b"), ("e", "p", 2, "x")], [("d", "p", 4, "b"), ("d", "q", 1, "b"), ("e", "p", 3, "y")]]
    real = Change.commit

    def dying(self, **note):
        if crash == "after":
            real(self, **note)
        raise RuntimeError("crash")

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, PAYLOADS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PAYLOADS).parquet(source)
        if k == 1:
            monkeypatch.setattr(Change, "commit", dying)
            with pytest.raises(Exception, match="."):
                outbox.sending(stream, path).awaitTermination()
            monkeypatch.setattr(Change, "commit", real)
            assert len(versions.versions(spark, path)) == (1 if crash == "before" else 2)
            now = {tuple(r) for r in outbox.state(spark, path).select("document_id", "kind", "seq").collect()}
            assert now == ({("d", "p", 1), ("e", "p", 1)} if crash == "before" else {("d", "p", 3), ("e", "p", 1)})
        outbox.sending(stream, path).awaitTermination()
    sent = sorted(tuple(r) for r in versions.table(spark, path, "outbox", PAYLOADS).collect())
    assert sent == [("d", "p", 1, "a"), ("d", "p", 3, "b"), ("d", "q", 1, "b"), ("e", "p", 1, "x"), ("e", "p", 3, "y")]
    assert {(r["document_id"], r["kind"]): r["seq"] for r in outbox.state(spark, path).collect()} == {("d", "p"): 3, ("d", "q"): 1, ("e", "p"): 3}
    assert [v.note["batch"] for v in versions.versions(spark, path)] == [0, 1, 2]


def test_state_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(outbox, "COMPACT", 2)
    path = f"file://{tmp_path}/box"
    for k in range(5):
        outbox.sender(path)(spark.createDataFrame([("d", "p", k, str(k // 2)), (f"e{k}", "p", 0, "x")], PAYLOADS), k)
    assert [("state" in v.replaced) for v in versions.versions(spark, path)] == [False, True, False, True, False]
    assert {(r["document_id"], r["seq"]) for r in outbox.state(spark, path).collect()} == {("d", 4), *((f"e{k}", 0) for k in range(5))}


class Served:
    """A service with logs of documents, which may cut connections and forget cursors."""

    def __init__(self):
        self.logs: dict[str, list[tuple[str, dict]]] = {}
        self.first: dict[str, int] = {}
        self.cut = 0
        self.asked: list[tuple[str, str | None]] = []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                document = self.path.split("/")[3]
                log, last = outer.logs[document], self.headers.get("Last-Event-ID")
                outer.asked.append((document, last))
                if self.headers.get("Authorization") != "Bearer secret" or (last is not None and not outer.first.get(document, 0) <= int(last) <= len(log)):
                    self.send_response(409 if last else 401)
                    self.end_headers()
                    return
                self.send_response(200)
                self.end_headers()
                body = ": ping\n\n"
                if last is None:
                    blocks = [b for kind, d in log if kind == "blocks.patch" for b in d["blocks"]]
                    body += sse.encoded("document.snapshot", len(log), {"blocks": blocks, "revision": len(blocks), "status": "OCR"})
                events = [sse.encoded(kind, k + 1, d) for k, (kind, d) in enumerate(log) if last is not None and k >= int(last)]
                if outer.cut and len(events) > outer.cut:
                    events = [*events[: outer.cut], events[outer.cut][:-9]]
                self.wfile.write((body + "".join(events)).encode())

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server.server_address[1]}"

    def grow(self, document, n):
        log = self.logs.setdefault(document, [])
        for _ in range(n):
            k = len(log)
            log.append(("blocks.patch", {"baseRevision": k, "revision": k + 1, "afterBlockId": f"b{k - 1}" if k else None, "removeBlockIds": [], "blocks": [{"blockId": f"b{k}", "version": 1, "xml": "é\nline"}]}))


@pytest.fixture
def served():
    s = Served()
    yield s
    s.server.shutdown()


def events_of(spark, served, documents):
    return {"base": served.base, "documents": documents, "token": "secret"}


def test_stream_of_served_events_goes_on(spark, served, tmp_path):
    sse.register(spark)
    served.grow("d", 3)
    served.grow("e", 1)

    def run():
        rows = spark.readStream.format("docflow_events").options(**events_of(spark, served, "d,e")).load()
        q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/log").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.read.schema(sse.SCHEMA).parquet(f"{tmp_path}/log")

    kinds = lambda df: sorted((r["document_id"], r["seq"], r["kind"].partition(".")[2]) for r in df.collect())
    assert kinds(run()) == [("d", 3, "snapshot"), ("e", 1, "snapshot")]
    served.grow("d", 5)
    served.cut = 2  # a connection gives two events and breaks
    assert kinds(run()) == [("d", 3, "snapshot"), *(("d", k, "patch") for k in range(4, 9)), ("e", 1, "snapshot")]
    served.cut = 0
    served.grow("e", 2)
    served.first["e"] = 2  # the service has forgotten the cursor: a fresh snapshot
    log = run()
    assert kinds(log)[-2:] == [("e", 1, "snapshot"), ("e", 3, "snapshot")]
    states = {r["document_id"]: r for r in replay.replay(log).collect()}
    assert {d: (r["cursor"], r["revision"], len(json.loads(r["blocks"])), r["reset"]) for d, r in states.items()} == {"d": (8, 8, 8, False), "e": (3, 3, 3, False)}
    assert ("d", "3") in served.asked and ("e", "1") in served.asked


def test_batch_of_served_events_equals_the_decoder(spark, served):
    sse.register(spark)
    served.grow("d", 4)
    got = spark.read.format("docflow_events").options(**events_of(spark, served, "d")).load()
    body = "".join(sse.encoded(kind, k + 1, d) for k, (kind, d) in enumerate(served.logs["d"]))
    want = files.event_frames(spark.createDataFrame([("d", body)], "stream string, body string")).selectExpr("stream AS document_id", "CAST(id AS long) AS seq", "event AS kind", "data")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_served_events_fold_in_a_stream(spark, served, tmp_path):
    sse.register(spark)
    served.grow("d", 2)
    rows = spark.readStream.format("docflow_events").options(**events_of(spark, served, "d")).load()
    q = preview.preview_states(rows).writeStream.format("memory").queryName("served_states").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["revision"], r["cursor"]) for r in spark.table("served_states").collect()] == [(2, 2)]


def test_frames_of_a_stream():
    lines = b": note\n\nid: 1\nevent: a\ndata: x\ndata:  y\n\nid: 2\n\ndata: z\nid: 3\n\nid: 4\ndata: cut".splitlines(keepends=True)
    assert list(sse.frames(lines)) == [(1, "a", "x\n y"), (3, "message", "z")]


def test_streams_that_end_too_early_are_an_error(served, monkeypatch):
    monkeypatch.setattr(sse, "FIRST_WAIT", 0.001)
    monkeypatch.setattr(sse, "LONGEST_WAIT", 0.002)
    served.grow("d", 2)
    service = sse.Service({"base": served.base, "documents": "d", "token": "secret"})
    with pytest.raises(TimeoutError):
        list(service.between("d", 0, 9))
    with pytest.raises(Exception, match="401"):
        sse.Service({"base": served.base, "documents": "d"}).heads()
