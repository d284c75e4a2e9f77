"""Files to answers: readers, quarantine, index, engine, stream, settings."""

from __future__ import annotations

import zipfile

import pytest

from siftstone.config import EngineConfig, MissingKey
from siftstone.engine import Engine, EngineNotReady
from siftstone.operators import answer, evaluate
from siftstone.operators import index as ix
from siftstone.sources import files
from siftstone.sources.tables import read_cache, read_json_lines
from siftstone.streaming.ingest import keep_cache_filled


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "data"
    (root / "sub dir").mkdir(parents=True)
    (root / "sub dir/gate-way.MD").write_text("## Limits\n\nThe gateway refuses requests above 500 per minute with code E42. " + "Clients wait and try again later. " * 5)
    (root / "store.txt").write_bytes(b"The storage engine compacts segments every night at two.\xff " * 4)
    (root / "page.html").write_text("<title>Deploy</title><script>no</script><p>Deployment needs two approvals before the release train leaves the station on Thursday.</p>" * 1)
    (root / "bad.docx").write_bytes(b"not a zip")
    (root / "skip.csv").write_text("a,b")
    with zipfile.ZipFile(root / "ok.docx", "w") as archive:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        archive.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>First</w:t></w:r><w:r><w:t> part</w:t></w:r></w:p><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>")
    return root


def test_readers_and_quarantine(spark, tree):
    sections, bad = files.load_directory(spark, str(tree))
    got = {r.source: r for r in sections.collect()}
    assert set(got) == {"sub dir/gate-way.MD", "store.txt", "page.html", "ok.docx"}
    assert got["sub dir/gate-way.MD"].title == "gate way" and got["page.html"].title == "Deploy"
    assert "no" not in got["page.html"].text.split() and got["ok.docx"].text == "First part\nSecond"
    assert "�" not in got["store.txt"].text
    assert [r.source for r in bad.collect()] == ["bad.docx"]


def test_missing_directories_fail(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a")
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path))


@pytest.fixture
def engine(spark, tree, tmp_path):
    config = EngineConfig(data_dir=str(tree), index_dir=str(tmp_path / "index"), embed_cache_dir=str(tmp_path / "cache"), min_chunk_chars=10)
    made = Engine(spark, config)
    with pytest.raises(EngineNotReady):
        made.sources()
    assert made.health()["ready"] is False
    assert made.ingest().first()["count"] >= 4
    return made


def test_engine(spark, engine):
    assert engine.health()["ready"] and {r.source for r in engine.sources().collect()} >= {"store.txt", "page.html"}
    requests = spark.createDataFrame([(1, "gateway refuses requests code E42"), (2, "Deployment approvals release train")], "qid bigint, question string")
    found = {(r.qid, r["rank"]): r.source for r in engine.search(requests, 2).collect()}
    assert found[1, 1] == "sub dir/gate-way.MD" and found[2, 1] == "page.html"
    answers = {r.qid: r for r in engine.ask(requests, 2).collect()}
    assert answers[1].sources[0].source == "sub dir/gate-way.MD" and "E42" in answers[1].answer
    events = engine.ask_events(requests, 2).where("qid = 1").orderBy("seq").collect()
    assert events[0].type == "sources" and events[-1].type == "done"
    questions = files.golden_set(spark, [{"question": "gateway refuses requests code E42", "relevant_sources": ["gate-way.MD"], "must_contain": ["e42"]}, {"question": "x", "relevant_sources": ["none.md"]}])
    assert engine.evaluate(questions).first().hit_rate == 0.5
    assert engine.ablate(questions).count() == 7
    assert [r.problem for r in engine.validate(questions).collect()] == ["unreachable"]
    with pytest.raises(ValueError, match="golden"):
        files.golden_set(spark, [{"question": "x"}])


def test_index_guards_and_rebuilds(spark, engine, tmp_path):
    with pytest.raises(ix.IndexMismatch):
        ix.open_index(spark, engine.config.index_dir, EngineConfig(embedding_model="other"))
    with pytest.raises(ix.IndexMissing):
        ix.open_index(spark, str(tmp_path / "none"))
    before = spark.read.parquet(f"{engine.config.embed_cache_dir}/hashing-64").count()
    engine.ingest()
    assert spark.read.parquet(f"{engine.config.embed_cache_dir}/hashing-64").count() == before
    assert engine.ingest(dry_run=True).first()["count"] == engine.index.size


def test_stream_fills_the_cache(spark, tmp_path):
    schema = "source string, page int, title string, text string"
    spark.createDataFrame([("a", None, "t", "word " * 50), ("b", None, "t", "word " * 50)], schema).write.parquet(str(tmp_path / "in"))
    stream = keep_cache_filled(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), EngineConfig(context_headers=False), str(tmp_path / "cache"), str(tmp_path / "check"))
    assert stream.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "cache/hashing-64")).count() == 1


def test_json_lines(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"k": "a", "v": [1.0], "seq": 1}\n{"k": "b", "v": [2\n{"k": "a", "v": [3.0], "seq": 2}\n')
    assert [(r.k, r.v) for r in read_cache(spark, str(path)).collect()] == [("a", [3.0])]
    assert read_json_lines(spark, str(tmp_path / "none"), "k string").count() == 0


def test_settings():
    made = EngineConfig.from_env({"CHUNK_SIZE": "500", "USE_HYBRID": "no", "MMR_LAMBDA": "0.5", "TOP_K": " "})
    assert (made.chunk_size, made.use_hybrid, made.mmr_lambda, made.top_k) == (500, False, 0.5, 5)
    assert "500/150" in made.summary()
    with pytest.raises(ValueError, match="citation_mode"):
        EngineConfig(citation_mode="x")


def test_pages_by_an_injected_reader(spark, tree):
    (tree / "two.pdf").write_bytes(b"first page\x0csecond page")
    pages = lambda content: [(n, "Title", p) for n, p in enumerate(content.decode().split("\x0c"), 1)]
    sections, bad = files.load_directory(spark, str(tree), {".pdf": pages})
    assert {(r.page, r.title, r.text) for r in sections.where("source = 'two.pdf'").collect()} == {(1, "Title", "first page"), (2, "Title", "second page")}
    assert [r.source for r in bad.collect()] == ["bad.docx"]


QUESTIONS = [
    {"question": "How many requests per minute does the gateway take?", "relevant_sources": ["gate-way.MD"], "must_contain": ["500"]},
    {"question": "When does the storage engine compact segments?", "relevant_sources": ["store.txt"]},
    {"question": "Who knows nothing?", "relevant_sources": ["absent.md"]},
]


def test_set_ups_are_compared_and_printed(spark, engine, tree):
    questions = files.golden_set(spark, QUESTIONS)
    sections, _ = files.load_directory(spark, str(tree))
    got = engine.compare(sections, questions, k=2)
    assert [(r.seq, r.config, r.questions) for r in got.orderBy("seq").collect()] == [(0, "baseline", 3), (1, "tuned", 3)]
    assert all(0 < r.hit_rate < 0.67 for r in got.collect())
    lines = evaluate.printed(got, 2).split("\n")
    assert lines[0].split() == ["config", "chunks", "hit@2", "MRR", "precision"] and lines[1].startswith("baseline") and "from baseline to tuned" in lines[-1]
    assert engine.index.meta["chunk_size"] == 1000 and len(engine.sweep(sections, questions, 2).select("config").distinct().collect()) == len(evaluate.SWEEP)


def test_command_line_compares(spark, engine, tree, tmp_path, monkeypatch, capsys):
    import json

    from siftstone.__main__ import main

    (tmp_path / "q.json").write_text(json.dumps(QUESTIONS))
    monkeypatch.setenv("INDEX_DIR", engine.config.index_dir)
    monkeypatch.setenv("MIN_CHUNK_CHARS", "10")
    assert main(["evaluate", str(tmp_path / "q.json"), "--config", "baseline", "--data-dir", str(tree), "--save", str(tmp_path / "saved")]) == 0
    assert "baseline" in capsys.readouterr().out and spark.read.json(str(tmp_path / "saved")).first().config == "baseline"
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo" / "a.md").write_text("word " * 60)
    (tmp_path / "repo" / "b.md").write_text("short page, " * 9)
    monkeypatch.setenv("MIN_PAGE_CHARS", "100")
    for more in ([], ["--clean"]):
        assert main(["prepare", str(tmp_path / "repo"), str(tmp_path / "out"), *more]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_turns_become_history_and_keys_are_checked(spark, engine):
    turns = [("user", f"turn {k}") for k in range(9)]
    asked = spark.createDataFrame([(1, "And the limit of the gateway?", turns), (2, "Alone?", [])], "qid bigint, question string, turns array<struct<role:string,text:string>>")
    seen = asked.select(answer.history_of(asked.turns, 6).alias("h")).collect()
    assert seen[0].h.split("\n") == [f"User: turn {k}" for k in range(3, 9)] and seen[1].h is None
    assert engine.ask(asked).count() == 2
    with pytest.raises(MissingKey):
        EngineConfig.check_key("openai", {})
    EngineConfig.check_key("openai", {"OPENAI_API_KEY": "x"})
    EngineConfig.check_key("hashing", {})


def test_chunk_ids_are_ranks_in_order_of_source_and_place(spark, engine):
    rows = [(r.id, r.source, r.chunk_index) for r in engine.index.chunks.orderBy("source", "chunk_index").collect()]
    assert [i for i, _, _ in rows] == list(range(len(rows))) and len(rows) == engine.index.size


def test_service(spark, engine):
    import json
    import threading
    import urllib.error
    import urllib.request

    from siftstone import service

    held = service.Service(spark, engine.config, ("http://here",))
    running = service.server(held, port=0)
    threading.Thread(target=running.serve_forever, daemon=True).start()

    def call(path, body=None, origin="http://here"):
        asked = urllib.request.Request(f"http://127.0.0.1:{running.server_port}{path}", None if body is None else json.dumps(body).encode(), {"Origin": origin})
        try:
            with urllib.request.urlopen(asked) as got:
                return got.status, got.headers, got.read().decode()
        except urllib.error.HTTPError as error:
            return error.code, error.headers, error.read().decode()

    try:
        status, headers, said = call("/health")
        assert status == 200 and json.loads(said)["status"] == "ok" and headers["Access-Control-Allow-Origin"] == "http://here"
        assert call("/health", origin="http://else")[1]["Access-Control-Allow-Origin"] is None and "<form>" in call("/")[2] and call("/none")[0] == 404
        listed = json.loads(call("/sources")[2])
        assert listed["chunk_count"] == engine.index.size and listed["document_count"] == len(listed["documents"])
        question = {"question": "gateway refuses requests code E42", "history": [{"role": "user", "content": "before"}], "top_k": 2}
        told = json.loads(call("/ask", question)[2])
        assert "E42" in told["answer"] and len(told["sources"]) == 2
        frames = call("/ask/stream", question)[2].split("\n\n")
        events = [json.loads(f[6:]) for f in frames[:-1]]
        assert frames[-1] == "" and events[0]["type"] == "sources" and len(events[0]["sources"]) == 2 and events[-1]["type"] == "done"
        for bad in ({"question": ""}, {"question": "x", "top_k": 21}, {"question": "x", "history": [{"role": "system", "content": ""}]}, [1]):
            assert call("/ask", bad)[0] == call("/ask/stream", bad)[0] == 422
        held.config = EngineConfig(index_dir=engine.config.index_dir + "-none")
        assert json.loads(call("/reload", {})[2])["status"] == "not_ready" and call("/ask", question)[0] == 503
        held.config = engine.config
        assert json.loads(call("/reload", {})[2])["status"] == "ok"
    finally:
        running.shutdown()


def test_fetching(tmp_path, monkeypatch):
    import subprocess

    from siftstone.sources import fetch

    origin = tmp_path / "origin"
    (origin / "docs").mkdir(parents=True)
    (origin / "docs" / "a.md").write_text("a")
    git = lambda *a: subprocess.run(["git", "-C", str(origin), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "x")
    assert fetch.fetch_repository(f"file://{origin}", str(tmp_path / "clone")) and (tmp_path / "clone/docs/a.md").read_text() == "a"
    assert not fetch.fetch_repository(f"file://{origin}", str(tmp_path / "clone"))
    (tmp_path / "hub").mkdir()
    (tmp_path / "hub" / fetch.MODELS["qwen3b"][1]).write_bytes(b"weights")
    made = fetch.fetch_model("qwen3b", str(tmp_path / "models"), f"file://{tmp_path}/hub/{{file}}")
    assert open(made, "rb").read() == b"weights" and not fetch.fetch_file("file:///nowhere", made)
    with pytest.raises(OSError):
        fetch.fetch_file("file:///nowhere", str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()


def test_streaming_rate_with_late_events(spark, tmp_path):
    from siftstone.streaming.rates import streaming_rate

    rows = [("a", 0), ("a", 5), ("b", 7), ("a", 65), ("a", 3000), ("a", 1), ("b", 3100)]
    for n, part in enumerate((rows[:5], rows[5:])):
        spark.createDataFrame(part, "k string, s int").selectExpr("k", "timestamp_seconds(s) AS ts").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streaming_rate(spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in")), "k", "ts", "10 minutes", "60 seconds", "60 seconds")
        query = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(120), n
    got = {(r.k, r.window.start.minute, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 0, 2), ("b", 0, 1), ("a", 1, 1)}  # the event that came after the watermark is left out
