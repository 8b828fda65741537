import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from cueloom import cli, glossary
from cueloom.config import DEFAULTS, deep_merge, load_config
from cueloom.operators import annotate, checkpoint, restore, services
from cueloom.plans import engine
from cueloom.schema import UTTERANCE_FIELDS
from cueloom.sinks import render
from cueloom.sources.captions import parse_vtt


def vtt(cues):
    stamp = lambda s: f"{int(s // 3600):02d}:{int(s % 3600 // 60):02d}:{int(s % 60):02d}.{round(s % 1 * 1000):03d}"
    return "WEBVTT\n\n" + "\n".join(f"{i}\n{stamp(a)} --> {stamp(b)}\n<v {who}>{text}</v>\n" for i, (a, b, who, text) in enumerate(cues, 1))


@pytest.fixture
def job(tmp_path):
    folder = tmp_path / "meeting"
    (folder / "input").mkdir(parents=True)
    cues = [(i * 5.0, i * 5.0 + 4.5, f"SPEAKER_0{i % 2}", f"{i}番目の発言は議題{i * 7}についてです。") for i in range(150)]
    (folder / "input" / "whisper_output.vtt").write_text(vtt(cues), encoding="utf-8")
    (folder / "input" / "zoom_output.vtt").write_text(vtt([(a + 12.0, b + 12.0, "x", t) for a, b, _, t in cues]), encoding="utf-8")
    (folder / "job.yaml").write_text("input:\n  speaker_map_path: map.json\n  dictionary_path: terms.json\nlogging:\n  save_prompt: true\n  save_raw_response: true\noutput:\n  completion_mode: strict\n")
    (folder / "map.json").write_text(json.dumps({"SPEAKER_00": "山田"}), encoding="utf-8")
    (folder / "terms.json").write_text(json.dumps(["議題", "梅田"]), encoding="utf-8")
    return folder


def test_whole_job(spark, job):
    config = load_config(None, job)
    meta = engine.run_job(spark, job, config, provider="merge")
    out = job / "output"
    assert meta["applied_offset_sec"] == pytest.approx(12.0) and meta["total_utterances"] == 150 and meta["completed_chunks"] == meta["total_chunks"] > 1
    report = json.loads((out / "offset_report.json").read_text())
    assert report["confidence"] == "HIGH" and report["override"] is None and "drift_delta_sec" in report
    data = json.loads((out / "final_transcript.json").read_text(encoding="utf-8"))
    assert len(data["utterances"]) == 150 and data["utterances"][0]["speaker"] == "山田" and "uncertain_span_ids" not in data["utterances"][0]
    txt = (out / "final_transcript.txt").read_text(encoding="utf-8")
    for name in ("final_transcript.srt", "final_transcript.vtt"):
        assert "山田" in (out / name).read_text(encoding="utf-8")
    temp = job / "working" / "temp"
    prompt = (temp / "prompt_chunk_000.txt").read_text(encoding="utf-8")
    assert f"{annotate.HEAD_DICTIONARY}\n" in prompt and prompt.endswith("- 議題\n- 梅田")
    assert json.loads((temp / "raw_chunk_000.json").read_text(encoding="utf-8"))["utterances"][0]["id"] == "U000001"
    saved = checkpoint.CheckpointTable(spark, str(temp / "chunks")).load().where("chunk_index = 0").first()
    assert saved["id_validation"]["passed"] and saved["id_validation"]["retries"] == 0 and saved["traceback"] is None
    assert saved["input_counts"]["primary_cues"] == 60 and saved["input_counts"]["zoom_cues"] > 0 and saved["offset_applied_sec"] == pytest.approx(12.0)
    assert saved["chunk_time_range"]["start_sec"] == 0.0 and (saved["api_provider"], saved["api_model"]) == ("merge", "gemini-2.0-flash")
    assert txt.startswith("山田\n0番目") and "\n\nSPEAKER_01\n" in txt
    assert (out / "final_transcript.srt").read_text(encoding="utf-8").startswith("1\n00:00:00,000 --> 00:00:04,500\n山田: ")
    back = parse_vtt(spark.createDataFrame([("a", (out / "final_transcript.vtt").read_text(encoding="utf-8"))], "k string, content string"), ["k"])
    assert back.count() == 150
    again = engine.run_job(spark, job, config, provider="faulty")  # nothing is left to annotate
    assert again["total_utterances"] == 150


def test_many_jobs(spark, job, tmp_path):
    import shutil

    root, out = tmp_path / "jobs", tmp_path / "out"
    for name in ("one", "job two"):
        shutil.copytree(job, root / name)
    (root / "job two" / "map.json").write_text("{}")
    config = load_config(None, None)
    config["input"]["speaker_map_path"] = "map.json"
    got = {r["job_id"]: r for r in engine.run_jobs(spark, str(root), str(out), config, "merge").collect()}
    assert set(got) == {"one", "job two"} and all(r["failed"] == r["pending"] == 0 and r["completed"] > 1 for r in got.values())
    lines = {k: {r["job_id"]: r["n"] for r in spark.read.text(f"{out}/{k}").groupBy("job_id").agg(F.count("*").alias("n")).collect()} for k in ("txt", "srt", "vtt", "json")}
    assert lines["json"] == {"one": 150, "job two": 150} and lines["srt"]["one"] == 600 and lines["vtt"]["job two"] == 452
    text = "\n".join(r["value"] for r in spark.read.text(f"{out}/txt/job_id=one").collect())
    assert text.startswith("山田\n0番目")
    reports = {r["job_id"]: json.loads(r["value"]) for r in spark.read.text(f"{out}/offsets").collect()}
    assert reports["one"]["applied_offset_sec"] == pytest.approx(12.0)
    again = engine.run_jobs(spark, str(root), str(out), config, "faulty").collect()  # nothing is left to annotate
    assert all(r["failed"] == 0 for r in again)


def test_policies(spark, job):
    strict = load_config(None, job, {"single_vtt": True})
    strict["api"]["backoff_base_sec"] = 0
    annotate.ANNOTATORS["drops"] = lambda: annotate.FaultyAnnotator("drop")
    with pytest.raises(RuntimeError):
        engine.run_job(spark, job, strict, provider="drops")
    best = load_config(None, job, {"single_vtt": True, "best_effort": True})
    meta = engine.run_job(spark, job, best, provider="drops")
    assert meta["completed_chunks"] == 0 and meta["source_zoom_vtt"] is None
    assert "処理失敗" in (job / "output" / "final_transcript.txt").read_text(encoding="utf-8")
    with pytest.raises(ValueError):
        engine.run_job(spark, job, strict, selected=[0, 99], provider="identity")
    failed = checkpoint.CheckpointTable(spark, str(job / "working" / "temp" / "chunks")).load().where("chunk_index = 0").first()
    assert failed["error_type"] == "ValueError" and "Traceback" in failed["traceback"] and not failed["id_validation"]["passed"] and failed["id_validation"]["retries"] == 2
    assert len(failed["prompts"]) == len(failed["answers"]) == 3 and (job / "working" / "temp" / "prompt_chunk_000_try1.txt").exists()
    assert annotate.HEAD_FEEDBACK in (job / "working" / "temp" / "prompt_chunk_000.txt").read_text(encoding="utf-8")
    meta = engine.run_job(spark, job, best, selected=[0], provider="identity")
    assert meta["completed_chunks"] == 1
    with pytest.raises(FileNotFoundError):
        engine.run_job(spark, job / "none", load_config(None, job / "none"))


def test_retry():
    waits = []
    calls = iter([annotate.RetryableError("429", 5), annotate.RetryableError("503"), {"ok": 1}])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert annotate.call_with_retry(call, 3, 2, waits.append) == {"ok": 1} and waits[0] >= 5 and 4 <= waits[1] <= 5
    with pytest.raises(annotate.AnnotationError):
        annotate.call_with_retry(lambda: (_ for _ in ()).throw(annotate.NonRetryableError("400")), 3, 0, waits.append)
    assert annotate.classify_error("Rate limit") is annotate.RetryableError and annotate.classify_error("invalid argument") is annotate.NonRetryableError
    with pytest.raises(ValueError):
        annotate.get_annotator("nothing")


def test_prompts():
    single = annotate.build_prompt("", dual=False)
    assert all(m in single for m in annotate.SINGLE_MARKS) and annotate.HEAD_ZOOM not in single
    dual = annotate.build_prompt("", dual=True, context_prompt="背景", errors=["e1"])
    assert annotate.DUAL_MARK in dual and dual.index(annotate.HEAD_FEEDBACK) < dual.index(annotate.HEAD_CONTEXT) < dual.index(annotate.DUAL_MARK)
    assert "【人名】山田、佐藤" in annotate.dictionary_section({"人名": ["山田", "佐藤"], "空": []}) and annotate.dictionary_section(None) == ""


def test_prompt_sections(spark):
    rows = [("j", 0, "BODY", 2, "U000002", None, "b"), ("j", 0, "BODY", 1, "U000001", "A", "a"), ("j", 0, "ZOOM", 9, None, None, "z"), ("j", 0, "ZOOM", 8, None, "Z", "y"), ("j", 0, "CTX_AFTER", 3, "U000003", "", "c")]
    got = annotate.prompt_bodies(spark.createDataFrame(rows, "job_id string, chunk_index int, role string, pos long, uid string, speaker string, text string")).first()
    assert got["expected_ids"] == ["U000001", "U000002"]
    assert got["body"] == f"\n{annotate.HEAD_PRIMARY}\n[U000001] A: a\n[U000002] UNKNOWN: b\n\n{annotate.HEAD_ZOOM}\n[ZOOM_REF_001] Z: y\n[ZOOM_REF_002] z\n\n{annotate.HEAD_AFTER}\n[CTX] UNKNOWN: c"


def test_restore_defaults(spark):
    raw = json.dumps({"utterances": [{"id": "U000001", "source_ids": ["U000001", "U000002", "X"]}, {"id": "V_INSERT_001", "text": "i"}]})
    results = spark.createDataFrame([("j", 0, "ok", raw), ("j", 1, "error", None)], "job_id string, chunk_index int, status string, result string")
    index = spark.createDataFrame([("j", "U000001", 1.0, 2.0), ("j", "U000002", 2.0, 5.0)], "job_id string, uid string, start double, end double")
    utts = restore.with_defaults(restore.parse_results(results))
    got = restore.restore_times(utts, index).orderBy("pos").collect()
    assert (got[0]["start"], got[0]["end"], got[0]["speaker"], got[0]["category"]) == (1.0, 5.0, "UNKNOWN", "CONTENT")
    assert got[1]["start"] is None
    inserts = spark.createDataFrame([("j", "V_INSERT_001", 7.0, 8.0)], "job_id string, uid string, start double, end double")
    assert restore.restore_times(utts, index, inserts).orderBy("pos").collect()[1]["start"] == 7.0
    with pytest.raises(Exception, match="unknown category"):
        restore.with_defaults(restore.parse_results(results).withColumn("category", F.lit("ODD"))).collect()


def test_txt_exclusion(spark):
    rows = [
        ("うん", "BACKCHANNEL", False, "NONE", "NONE"), ("了解です", "BACKCHANNEL", False, "NONE", "NONE"), ("3時", "BACKCHANNEL", False, "NONE", "NONE"), ("ながいながいあいづちです", "BACKCHANNEL", True, "NONE", "NONE"),
        ("そう。", "CONTENT", True, "NONE", "NONE"), ("本文", "CONTENT", True, "AB_MISMATCH", "NORMALIZE"), ("本文2", "CONTENT", True, "LOW_CONFIDENCE", "NONE"), ("本文3", "CONTENT", True, "SPEAKER_AMBIGUOUS", "NONE"),
    ]
    df = spark.createDataFrame(rows, "text string, category string, uncertain boolean, uncertain_reason string, edit_type string")
    got = df.select(restore.excluded_from_txt().alias("x"), restore.tagged_uncertain().alias("t")).collect()
    assert [r["x"] for r in got] == [True, False, False, True, True, False, False, False]
    assert [r["t"] for r in got][5:] == [False, True, False]


def test_checkpoint(spark, tmp_path):
    table = checkpoint.CheckpointTable(spark, str(tmp_path / "t"))
    assert table.load().count() == 0
    row = lambda c, s: ("j", c, s, None, 0, [], None, None, None, None, None, None)
    table.save(spark.createDataFrame([row(0, "error"), row(1, "ok")], annotate.RESULT_SCHEMA))
    table.save(spark.createDataFrame([row(0, "ok")], annotate.RESULT_SCHEMA))
    assert sorted(r["chunk_index"] for r in table.completed().collect()) == [0, 1]
    chunks = spark.createDataFrame([("j", 0), ("j", 1), ("j", 2)], "job_id string, chunk_index int")
    assert [r["chunk_index"] for r in checkpoint.targets(chunks, table.completed()).collect()] == [2]
    counts = checkpoint.status_counts(checkpoint.completion_status(chunks, table.load())).first()
    assert (counts["completed"], counts["failed"], counts["pending"]) == (2, 0, 1)
    table.clean()
    assert table.load().count() == 0


def test_config_and_cli(tmp_path, capsys):
    assert deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    (tmp_path / "app.yaml").write_text("chunking:\n  overlap_sec: 20\n")
    (tmp_path / "job.yaml").write_text("chunking:\n  overlap_sec: 30\noffset:\n  mode: skip\n")
    c = load_config(tmp_path / "app.yaml", tmp_path, {"offset_sec": 3.0})
    assert c["chunking"]["overlap_sec"] == 30 and c["offset"]["mode"] == "manual" and c["offset"]["manual_offset_sec"] == 3.0 and DEFAULTS["chunking"]["overlap_sec"] == 15
    assert cli.main(["--job", str(tmp_path / "none")]) == 1
    assert cli.main(["--job", str(tmp_path), "--clean", "--chunk", "1"]) == 1
    assert cli.main(["--job", str(tmp_path), "--chunk", "-1"]) == 1
    assert cli.parse_args(["--job", "x", "--chunk", "12", "--chunk", "31"]).chunk == [12, 31]
    (tmp_path / "job.yaml").write_text("input:\n  dictionary_path: input/d.json\n  speaker_map_path: /elsewhere/map.json\n")
    paths = load_config(None, tmp_path, {"single_vtt": True})["_resolved"]
    assert paths["dictionary_path"] == tmp_path / "input" / "d.json" and str(paths["speaker_map_path"]) == "/elsewhere/map.json"
    single = load_config(None, None, {"single_vtt": True, "debug": True, "best_effort": True})
    assert (single["offset"]["mode"], single["input"]["use_secondary_vtt"], single["logging"]["log_level"], single["output"]["completion_mode"]) == ("skip", False, "DEBUG", "best_effort")
    assert load_config(None, None, {"offset_sec": 0.0})["offset"]["mode"] == "manual"
    with pytest.raises(SystemExit):
        cli.parse_args(["--job", "x", "--offset-sec", "1", "--offset-skip"])


def test_glossary(tmp_path, capsys):
    (tmp_path / "input").mkdir()
    assert glossary.main(["--job", str(tmp_path)]) == 1
    (tmp_path / "input" / "glossary.txt").write_text("# c\n東京\n\n大阪\n", encoding="utf-8")
    assert glossary.main(["--job", str(tmp_path), "--editor", ""]) == 0
    assert [x.split("\t")[0] for x in (tmp_path / "input" / "glossary_confirmed.tsv").read_text(encoding="utf-8").splitlines()] == ["東京", "大阪"]
    assert glossary.main(["--job", str(tmp_path), "--provider", "none"]) == 1


class Stub(BaseHTTPRequestHandler):
    """Answers as the script says, one entry a request: (status, headers, body)."""

    script: list = []
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Stub.seen.append((self.path, self.headers.get("x-goog-api-key"), body))
        status, headers, answer = Stub.script.pop(0) if Stub.script else (200, {}, Stub.echo(body))
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k, v)
        self.end_headers()
        self.wfile.write(answer.encode())

    @staticmethod
    def text(text):
        return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})

    @staticmethod
    def echo(body):
        ids = re.findall(r"^\[(U\d+)\]", body["contents"][0]["parts"][0]["text"], re.M)
        return Stub.text(json.dumps({"utterances": [{"id": i, "source_ids": [i], "text": "t"} for i in ids]}))

    def log_message(self, *args):
        pass


@pytest.fixture
def service(monkeypatch):
    monkeypatch.setenv("GEMINI_API_KEY", "secret")
    server = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Stub.script, Stub.seen = [], []
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_service(service, monkeypatch):
    client = services.GoogleService(base_url=service, timeout_sec=5)
    good = json.dumps({"utterances": [{"id": "U000001"}]})
    Stub.script = [(429, {"Retry-After": "7"}, "quota"), (200, {}, Stub.text("")), (200, {}, Stub.text("no json")), (200, {}, Stub.text(good))]
    waits = []
    assert annotate.call_with_retry(lambda: client.call("p", [], []), 4, 0, waits.append) == json.loads(good) and waits[0] >= 7 and len(waits) == 3
    path, key, body = Stub.seen[-1]
    assert path == "/models/gemini-2.0-flash:generateContent" and key == "secret" and body["generationConfig"]["temperature"] == 0.1
    assert set(body["generationConfig"]["responseSchema"]["properties"]["utterances"]["items"]["properties"]) == set(UTTERANCE_FIELDS)
    for status, error in ((400, annotate.NonRetryableError), (503, annotate.RetryableError), (418, annotate.RetryableError)):
        Stub.script = [(status, {}, "x")]
        with pytest.raises(error):
            client.call("p", [], [])
    with pytest.raises(annotate.RetryableError):
        services.GoogleService(base_url="http://127.0.0.1:1", timeout_sec=1).call("p", [], [])
    monkeypatch.delenv("GEMINI_API_KEY")
    with pytest.raises(annotate.NonRetryableError):
        client.call("p", [], [])
    for name in ("openai", "anthropic"):
        with pytest.raises(annotate.NonRetryableError):
            annotate.get_annotator(name)


def test_job_with_service(spark, job, service):
    config = load_config(None, job, {"single_vtt": True})
    config["api"]["base_url"] = service
    meta = engine.run_job(spark, job, config)
    assert meta["llm_provider"] == "google" and meta["total_utterances"] == 150 and len(Stub.seen) == meta["total_chunks"]


def test_glossary_with_service(tmp_path, service, monkeypatch):
    monkeypatch.setenv("GLOSSARY_URL", service)
    (tmp_path / "input").mkdir()
    (tmp_path / "input" / "glossary.txt").write_text("東京\n", encoding="utf-8")
    Stub.script = [(200, {}, Stub.text("東京\tとうきょう\n"))]
    assert glossary.main(["--job", str(tmp_path), "--provider", "google", "--editor", ""]) == 0
    assert (tmp_path / "input" / "glossary_confirmed.tsv").read_text(encoding="utf-8") == "東京\tとうきょう"
    assert not glossary.open_in_editor(tmp_path, "no-such-editor")


def test_empty_render(spark):
    none = spark.createDataFrame([], "job_id string, chunk_index int, pos int, id string, speaker string, text string, category string, uncertain boolean, uncertain_reason string, source string, source_ids array<string>, vtt_supplemented boolean, edit_type string, edit_note string, start double, end double")
    assert render.txt_lines(none).count() == render.srt_lines(none).count() == render.vtt_lines(none).count() == 0
