"""Log formats, event files, discovery, datasets, environment, speech, tokenizer, streaming and the command line."""

import json
import os
import struct
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossledger import api, cli
from lossledger.functions.columns import as_float, canonical, normal_tag
from lossledger.operators import environment, objective, preflight, speech, tokenizer
from lossledger.sources import logs, tfevents
from lossledger.streaming import watch

FALL = [10.0 / (1 + i) for i in range(15)]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def got(df, *cols):
    return [tuple(r) for r in df.orderBy("run_id", "rec_idx").select(*cols).collect()]


def test_numbers_and_names(spark):
    cases = {"1": 1.0, " 2.5e3 ": 2500.0, "1_000": 1000.0, ".5": 0.5, "-inf": float("-inf"), "Infinity": float("inf"), "1d": None, "": None, "abc": None, "1__0": None, "5.": 5.0, "0x1": None, "True": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", as_float(F.col("s")).alias("v"))
    assert {r.s: r.v for r in df.collect()} == cases
    assert spark.createDataFrame([("NaN",)], "s string").select(F.isnan(as_float(F.col("s")))).first()[0]
    names = {"Loss": "loss", "train_loss": "loss", "VAL_LOSS": "eval_loss", "grad_accum": None, "my": "loss", "iter": "step", "epoch": None}
    df = spark.createDataFrame([(k,) for k in names], "s string").select("s", canonical(F.col("s"), {"loss": "MY"}).alias("v"))
    assert {r.s: r.v for r in df.collect()} == names


def test_tags(spark):
    tags = {
        "train/loss": "loss", "val/loss": "val_loss", "lr-AdamW/pg1": "lr", "lr/group0": "lr", "TrainIterStats/loss": "loss", "EvalStats/avg_loss": "val_loss", "validation/a/b": "val_a_b",
        "Test/loss": "val_loss", "fit/grad_norm": "grad_norm", "other/loss": "other_loss", "Learning_Rate": "lr", "tr/avg_loss": "loss", "grad_norm": "grad_norm",
    }
    df = spark.createDataFrame([(k,) for k in tags], "s string").select("s", normal_tag(F.col("s")).alias("v"))
    assert {r.s: r.v for r in df.collect()} == tags


HF = json.dumps({"max_steps": 9, "log_history": [{"loss": 3.0, "learning_rate": 1e-4, "step": 1, "epoch": 0.1}, {"eval_loss": 2.0, "step": 1}, {"loss": "NaN", "step": 2, "grad_norm": None}, {"other": 1, "step": 3}, {"loss": 1.0, "train_runtime": 5.0}]})
COQUI = """\x1b[1m > EPOCH: 0/10\x1b[0m
\x1b[1m   --> TIME: 2024-01-02 03:04:05 -- STEP: 1/9 -- GLOBAL_STEP: 25\x1b[0m
     | > loss_mel: 1.5  (1.5)
     | > loss: 4.5  (4.7)
     | > current_lr: 0.0002
     | > step_time: 0.5  (0.6)
     | > avg_loss: 99
\x1b[1m   --> TIME: 2024-01-02 03:05:05 -- STEP: 2/9 -- GLOBAL_STEP: 50\x1b[0m
     | > loss: 3.5  (4.0)
     | > empty:
"""


def test_formats(spark, tmp_path):
    write(tmp_path / "hf" / "trainer_state.json", HF)
    write(tmp_path / "coqui.txt", COQUI)
    write(tmp_path / "a.csv", 'step, loss ,phase,"lr"\n1,2.5,warm,0.1\n2,,x,"0.2"\n\n3,bad,y\n4,1.5,z,0.3,extra\n')
    write(tmp_path / "b.jsonl", 'banner\n{"step": 1, "loss": 2.0, "val_loss": true}\n{"loss": "1.5", "step": 2, "train_loss": NaN}\n[1]\n5\n{"half": \n{"x": 1}\n')
    write(tmp_path / "other.json", '{"log_history": [{"loss": 1.0}]}')
    records, files = logs.read_logs(spark, str(tmp_path))
    fmt = {os.path.basename(r.run_id): r.fmt for r in files.collect()}
    assert fmt == {"trainer_state.json": "hf", "coqui.txt": "coqui", "a.csv": "csv", "b.jsonl": "csv", "other.json": "hf"}
    name = F.element_at(F.split("run_id", "/"), -1)
    of = lambda n: records.where(name == n)
    assert repr(got(of("trainer_state.json"), "step", "loss", "eval_loss", "lr")) == repr([(1.0, 3.0, None, 1e-4), (1.0, None, 2.0, None), (2.0, float("nan"), None, None)])
    assert got(of("coqui.txt"), "step", "loss", "lr", "step_time", "time") == [(25.0, 4.5, 0.0002, 0.5, 1704164645.0), (50.0, 3.5, None, None, 1704164705.0)]
    assert got(of("a.csv"), "step", "loss", "lr") == [(1.0, 2.5, 0.1), (2.0, None, 0.2), (3.0, None, None), (4.0, 1.5, 0.3)]
    jsonl, _ = logs.read_logs(spark, str(tmp_path / "b.jsonl"), "jsonl")
    assert repr(got(jsonl, "step", "loss", "eval_loss")) == repr([(1.0, 2.0, 1.0), (2.0, float("nan"), None)])
    mapping = {os.path.basename(r.run_id): r.mapping for r in logs.used_mapping(records).collect()}
    assert mapping["trainer_state.json"]["lr"] == "learning_rate" and mapping["a.csv"]["loss"] == "loss"
    meta = logs.run_meta(files).where(name == "trainer_state.json").first().run_meta
    assert meta.max_steps == "9" and meta.save_steps is None
    over, _ = logs.read_logs(spark, str(tmp_path / "a.csv"), overrides={"eval_loss": "phase", "loss": "lr"})
    assert got(over, "loss", "lr")[0] == (0.1, None)
    with pytest.raises(ValueError):
        logs.read_logs(spark, str(tmp_path), "xml")


def test_text_of_a_log_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def text(t):
        made.add(1)
        return t

    rows = [(f"{i}{name}", name, t) for i in range(3) for name, t in (("a.csv", "step,loss\n1,2\n"), ("a.jsonl", '{"loss": 1}\n'), ("trainer_state.json", HF), ("a.log", COQUI))]
    files = spark.createDataFrame(rows, "run_id string, name string, raw string").select("run_id", "name", F.udf(text, "string")("raw").alias("text"))
    files = files.withColumn("fmt", logs.detect_format(F.col("name"), F.col("text")))
    assert len(logs.parse_text(files).select("run_id", "rec_idx", "step", "loss").collect()) == 3 * (1 + 1 + 3 + 2)
    assert made.value == len(rows)


def test_csv_cells(spark):
    text = 'Step,"loss", lr ,x,loss,grad_norm\r\n1,"2.5",.5,"a, b"\x0b\n2,1e1,"1_0",,"+7"\x852, n/a ,-inf,"q""q",8,9,10\u20283,"4\n4,,,,bad,nan'
    files = spark.createDataFrame([("a", "csv", text), ("head only", "csv", "loss\n"), ("none", "csv", ""), ("null", "csv", None)], "run_id string, fmt string, text string")
    want = [("a", 0, 1.0, 2.5, 0.5, None), ("a", 1, 2.0, 7.0, 10.0, None), ("a", 2, 2.0, 8.0, float("-inf"), 9.0), ("a", 3, 4.0, None, None, float("nan"))]  # a lone quote is no number
    assert repr(got(logs.parse_text(files), "run_id", "rec_idx", "step", "loss", "lr", "grad_norm")) == repr(want)


def test_console_records_are_cut_out_of_the_text(spark):
    head = lambda minute, rest: f"\x1b[1m  --> TIME: 2024-01-02 03:0{minute}:05 -- STEP: 1/9{rest}\x1b[0m"
    text = "\r\n".join(["| > loss: 9", head(4, " -- GLOBAL_STEP: 25 GLOBAL_STEP: 7"), '\t| > loss: "4.5" (1)', " | > lr : 1_0", "| > grad_norm 3", "| >  ", head(5, ""), "| > step: 3:4", "x | > lr: 8"])
    text += "\x85" + head(6, " -- GLOBAL_STEP: 50") + "\u2028| > lr: 1\x0b" + head(7, " -- GLOBAL_STEP: ") + "\x1c | > Val_Loss:   inf  | > lr: 2"
    files = spark.createDataFrame([("a", "coqui", text), ("first", "coqui", head(1, " -- GLOBAL_STEP: 1") + "\n| > loss: 2"), ("none", "coqui", "")], "run_id string, fmt string, text string")
    records = logs.parse_text(files)
    want = [("a", 0, None, None, 9.0, None, None), ("a", 1, 3.0, 1704164645.0, 4.5, None, 10.0), ("a", 2, None, 1704164825.0, None, float("inf"), None), ("first", 0, 1.0, 1704164465.0, 2.0, None, None)]
    assert got(records, "run_id", "rec_idx", "step", "time", "loss", "eval_loss", "lr") == want
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Aggregate" not in plan  # numbered once; no lines are put together again


# ---- event files: a small encoder


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(number, kind, payload):
    return varint(number << 3 | kind) + (varint(len(payload)) if kind == 2 else b"") + payload


def event(step, wall, *values):
    body = field(1, 1, struct.pack("<d", wall)) + field(2, 0, varint(step))
    for tag, value in values:
        body += field(5, 2, field(1, 2, field(1, 2, tag.encode()) + value))
    return struct.pack("<Q", len(body)) + b"crc!" + body + b"crc!"


def simple(x):
    return field(2, 5, struct.pack("<f", x))


def tensor(number, kind, form, x):
    return field(8, 2, field(number, kind, struct.pack(form, x)))


def test_event_files(spark, tmp_path):
    data = b"".join(event(i * 10, 100.0 + i, ("train/loss", simple(4.0 - i / 4)), ("lr-Adam", tensor(5, 2, "<f", 0.5))) for i in range(12))
    data += event(5, 1.0, ("val/loss", tensor(6, 2, "<d", 1.25)), ("x", tensor(4, 2, "<f", 2.0)), ("y", tensor(5, 5, "<f", 3.0)))
    bad = b"\x0f" * 9
    data += struct.pack("<Q", len(bad)) + b"crc!" + bad + b"crc!" + event(7, 2.0, ("TrainEpoch/loss", simple(9.0))) + event(8, 2.0, ("cut", simple(1.0)))[:-3]
    rows = tfevents.decode(data)
    assert len(rows) == 24 + 3 + 1 and rows[24] == ("val/loss", 5, 1.25, 1.0) and rows[-1][0] == "TrainEpoch/loss"
    assert tfevents.decode(b"") == [] == tfevents.decode(b"garbage") and tfevents.decode(data[:50]) == []
    write(tmp_path / "run" / "events.out.tfevents.1", data)
    write(tmp_path / "run" / "notes.tfevents.md", "text")
    records, _ = logs.read_logs(spark, str(tmp_path))
    r = got(records.where("run_id like '%tfevents.1'"), "step", "loss", "eval_loss", "lr", "time")
    assert len(r) == 13 and r[0] == (0.0, 4.0, None, 0.5, 100.0) and r[1] == (5.0, None, 1.25, None, 1.0)
    spark.dataSource.register(tfevents.EventSource)
    assert spark.read.format("event_scalars").load(str(tmp_path / "run" / "events.out.tfevents.1")).count() == 28
    more = event(0, 200.0, ("train/loss", simple(7.0))) + event(200, 201.0, ("train/loss", simple(0.5)))
    write(tmp_path / "run" / "events.out.tfevents.2", more)
    both = got(tfevents.read_event_records(spark, str(tmp_path), by_directory=True), "step", "loss")
    assert both[0] == (0.0, 7.0) and both[-1] == (200.0, 0.5)
    report = api.judge_logs(spark, str(tmp_path / "run" / "events.out.tfevents.1")).first()
    assert report.verdict == "PASS"


def jsonl(values):
    return "\n".join(json.dumps({"step": i, "loss": v}) for i, v in enumerate(values))


def test_doctor(spark, tmp_path):
    write(tmp_path / "good.jsonl", jsonl(FALL))
    write(tmp_path / "sub" / "bad.jsonl", jsonl([*FALL, 90.0]))
    write(tmp_path / "tiny.jsonl", jsonl(FALL[:2]))
    write(tmp_path / "notes.txt", "hello")
    write(tmp_path / "skip.json", jsonl(FALL))
    for i, n in enumerate(("good.jsonl", "sub/bad.jsonl", "tiny.jsonl")):
        os.utime(tmp_path / n, (1000 + i, 1000 + i))
    reports, files = api.doctor(spark, str(tmp_path), baseline=str(tmp_path / "good.jsonl"))
    r = reports.collect()
    assert [(os.path.basename(x.run_id), x.verdict) for x in r] == [("bad.jsonl", "FAIL"), ("good.jsonl", "PASS")]
    assert r[1].step_range == "0.0..14.0" and r[1].num_records == 15 and r[1].mapping == {"loss": "loss", "step": "step"}
    assert {f.source for f in r[1].findings} == {"single_run", "compare"}
    assert {os.path.basename(x.run_id): x.judged for x in files.collect()} == {"good.jsonl": True, "bad.jsonl": True, "tiny.jsonl": False, "notes.txt": False}
    newest, _ = api.doctor(spark, str(tmp_path), newest=1)
    assert [os.path.basename(x.run_id) for x in newest.collect()] == ["bad.jsonl"]


def test_command_line(spark, tmp_path, capsys):
    good, bad = write(tmp_path / "good.jsonl", jsonl(FALL)), write(tmp_path / "x" / "good.jsonl", jsonl([*FALL, *[90.0] * 10]))
    empty = write(tmp_path / "e.jsonl", "\n")
    zeros = write(tmp_path / "z.jsonl", jsonl([0.0] * 4))
    out = lambda: capsys.readouterr().out
    assert cli.run(["epoch", good, "--json"]) == 0
    e = json.loads(out())
    assert e["worst_verdict"] == "PASS" and e["reports"][0]["checks"]["ran"]
    page, sarif = tmp_path / "r.html", tmp_path / "r.sarif"
    assert cli.run(["epoch", bad, "--html", str(page), "--sarif", str(sarif)]) == 1
    assert "TP-DIVERGE" in page.read_text() and json.loads(sarif.read_text())["version"] == "2.1.0" and "[FAIL]" in out()
    assert cli.run(["epoch", empty, "--json"]) == 2 and json.loads(out())["worst_verdict"] is None
    assert cli.run(["epoch", str(tmp_path / "none"), "--json"]) == 2
    assert cli.run(["epoch", zeros]) == 2
    out()
    assert cli.run(["compare", good, good, bad]) == 1
    assert "x/good.jsonl" in out()
    assert cli.run(["doctor", str(tmp_path)]) == 1 and "NOT judged" in out()
    assert cli.run(["doctor", empty]) == 2
    assert cli.run(["preflight", write(tmp_path / "d.jsonl", '{"text": "a"}\n{"text": "b"}')]) == 0
    assert cli.run(["env", "--module", "json", "--json"]) == 0
    assert cli.run(["watch", bad, "--until-fail"]) == 1
    assert cli.parse_map(["loss=custom", "bad"]) == {"loss": "custom"}
    assert cli.poll(str(tmp_path / "none"), "auto", {}, None)[0] is None


def test_preflight(spark, tmp_path):
    class Tok:  # in here, so that workers get it by value
        eos_token, eos_token_id, pad_token, pad_token_id, bos_token = "</s>", 2, "</s>", 2, None

        def encode(self, text):
            return text.split()

    clean = write(tmp_path / "c.jsonl", '{"text": "a b c"}\n\n{"output": "d"}\n{"n": 1, "text": 5}')
    r = preflight.preflight(spark, clean)
    assert r.verdict == "PASS" and [f["id"] for f in r.findings] == ["TP-PRE-OK"]
    bad = write(tmp_path / "b.jsonl", '{"text": "a"}\n{"text": \n{"text": "  "}\n{"text": "a"}\n{"x": 1}\n{"text": null}')
    r = preflight.preflight(spark, bad)
    ids = {f["id"]: f["evidence"] for f in r.findings}
    assert r.verdict == "FAIL" and ids["TP-PRE-MALFORMED-JSONL"].endswith("line number: 2")
    assert ids["TP-PRE-EMPTY-TEXT"] == "2 records (indices [1, 3]...)" and ids["TP-PRE-DUPLICATE-TEXT"] == "1 duplicate records of 1 distinct texts"
    with pytest.raises(RuntimeError):
        r.raise_on_fail()
    r = preflight.preflight(spark, clean, Tok(), max_len=2)
    assert [f["id"] for f in r.findings] == ["TP-PRE-PAD-EQUALS-EOS", "TP-PRE-BOS-TOKEN-INFO", "TP-PRE-CONTEXT-OVERFLOW"] and r.verdict == "WARN"
    assert "TP-PRE-CONTEXT-CHECK-SKIPPED" in [f["id"] for f in preflight.preflight(spark, clean, Tok()).findings]
    assert [f["id"] for f in preflight.check_special_tokens(object())] == ["TP-PRE-MISSING-EOS-TOKEN", "TP-PRE-MISSING-PAD-TOKEN", "TP-PRE-BOS-TOKEN-INFO"]
    assert preflight.preflight(spark, spark.createDataFrame([("a",), ("b",)], "text string")).verdict == "PASS"
    assert preflight.preflight(spark, clean, text_field="zzz").verdict == "FAIL"


def test_objective(spark):
    ids = lambda f: [x["id"] for x in f]
    assert ids(objective.check_ignore_index(10, 3)) == ["TP-OBJ-IGNORE-INDEX-COLLISION"] and ids(objective.check_ignore_index(10, 10)) == ["TP-OBJ-IGNORE-INDEX-OK"]
    assert objective.check_ignore_index(10, -100) == [] == objective.check_ignore_index(10, None)
    seen = [[i for i in range(64) if i != 17], np.array([[1, 2], [3, 4]])]
    assert ids(objective.check_objective(64, None, seen)) == ["TP-OBJ-DEAD-CLASS"]
    assert ids(objective.check_objective(1000, None, list(range(10)))) == ["TP-OBJ-COVERAGE-INSUFFICIENT"]
    assert objective.check_objective(100, None, list(range(60))) == []
    assert ids(objective.check_objective(4, None, [0, 1, 2, 3, 99])) == ["TP-OBJ-TARGET-OUT-OF-RANGE", "TP-OBJ-DEAD-CLASS-OK"]
    c = objective.TargetCoverage(8, 7).observe([0, 7, 7, 1]).merge(objective.TargetCoverage(8, 7).observe([2]))
    assert (c.n_targets, c.seen) == (3, {0, 1, 2})
    df = spark.createDataFrame([([[0, 1], [2]],), ([[3, -100]],)], "target array<array<int>>")
    assert ids(objective.check_objective(4, -100, df)) == ["TP-OBJ-DEAD-CLASS-OK"]
    assert ids(objective.check_objective(2, None, df.where("false"))) == ["TP-OBJ-COVERAGE-INSUFFICIENT"]

    class Config:
        vocab_size = 11

    class Model:
        config = Config()

    assert objective.infer_objective(Model()) == (11, -100) and objective.labels_of({"labels": [1]}) == [1] and objective.labels_of({}) is None


def test_environment(spark, tmp_path):
    one = lambda f: f[0]["id"][7:]
    assert one(environment.check_memory(1, (64, 32))) == "MEM-OK" and one(environment.check_memory(30, (64, 32))) == "MEM-TIGHT" and one(environment.check_memory(40, (64, 32))) == "MEM-INSUFFICIENT"
    assert one(environment.check_memory()) in ("MEM-INFO", "MEM-UNKNOWN")
    assert one(environment.check_import("json")) == "IMPORT-OK" and one(environment.check_import("no_such_module")) == "IMPORT-FAIL"
    assert one(environment.check_import("json", cwd="/no/such")) == "CWD-MISSING" and one(environment.check_import("json", python="/no/python")) == "PYTHON-UNUSABLE"
    write(tmp_path / "crash.py", "import os; os._exit(9)")
    write(tmp_path / "hang.py", "import time; time.sleep(60)")
    assert one(environment.check_import("crash", cwd=str(tmp_path))) == "IMPORT-CRASH" and one(environment.check_import("hang", cwd=str(tmp_path), timeout=1)) == "IMPORT-TIMEOUT"
    ok = tmp_path / "ok.pt"
    with zipfile.ZipFile(ok, "w") as z:
        z.writestr("m/data.pkl", b"x" * 100)
        z.writestr("m/data/0", os.urandom(3000))
    data = ok.read_bytes()
    flipped = bytearray(data)
    flipped[data.index(b"m/data/0") + 500] ^= 255
    with zipfile.ZipFile(tmp_path / "nopkl.pt", "w") as z:
        z.writestr("a", b"b")
    cases = {"ok.pt": (data, "CKPT-OK"), "empty.pt": (b"", "CKPT-EMPTY"), "cut.pt": (data[: len(data) * 6 // 10], "CKPT-TRUNCATED"), "old.pt": (b"\x80\x02abc", "CKPT-LEGACY"), "text.pt": (b"hello", "CKPT-UNREADABLE"), "flip.pt": (bytes(flipped), "CKPT-CORRUPT")}
    for name, (content, _) in cases.items():
        (tmp_path / name).write_bytes(content)
    assert {n: one(environment.check_checkpoint(tmp_path / n)) for n in cases} == {n: c for n, (_, c) in cases.items()}
    assert one(environment.check_checkpoint(tmp_path / "none")) == "CKPT-MISSING" and one(environment.check_checkpoint(tmp_path / "nopkl.pt")) == "CKPT-UNREADABLE"
    fleet = environment.inspect_checkpoints(spark.read.format("binaryFile").option("pathGlobFilter", "*.pt").load(str(tmp_path)))
    assert fleet.count() == len(cases)  # without the empty file
    assert one(environment.check_disk(tmp_path, 1e9)) == "DISK-INSUFFICIENT" and one(environment.check_disk(tmp_path, 1e-9)) == "DISK-OK" and one(environment.check_disk(tmp_path)) == "DISK-INFO" and one(environment.check_disk("/no/such/dir")) == "DISK-UNKNOWN"
    r = environment.check_env(module="json")
    assert r["verdict"] == "PASS" and r["checks"]["ran"] == ["import", "memory"] and "disk" in r["checks"]["skipped"]
    assert environment.check_env()["verdict"] == "NOT-CHECKED"


def tone(path, seconds, rate=8000, channels=1, level=0.3, quiet=0.0):
    n = int(seconds * rate)
    x = level * np.sin(np.arange(n) * 0.3)
    x[: int(quiet * rate)] = 0
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat((x * 32767).astype("<i2"), channels).tobytes())


def test_speech(spark, tmp_path):
    for i in range(12):
        tone(tmp_path / f"{i}.wav", 1.0 + i / 50)
        write(tmp_path / f"{i}.txt", "hello there friend")
    assert [f["id"] for f in speech.check_data(spark, str(tmp_path))["findings"]] == ["TP-DATA-PASS"]
    tone(tmp_path / "bad" / "x.wav" if (tmp_path / "bad").mkdir() else tmp_path / "bad" / "x.wav", 30, 16000, 2, 1.0, quiet=3)
    tone(tmp_path / "bad" / "s.wav", 0.2)
    (tmp_path / "bad" / "n.wav").write_bytes(b"noise")
    rows = [{"audio_filepath": str(tmp_path / "bad" / "x.wav"), "text": "Dr. Жук 5"}, {"audio": str(tmp_path / "bad" / "x.wav"), "transcript": ""}, {"audio_filepath": "/no/file.wav", "text": "hi"}, {"audio_filepath": str(tmp_path / "bad" / "n.wav"), "text": "hi"}]
    rows += [{"audio_filepath": str(tmp_path / "bad" / "s.wav"), "text": "x" * 400}] + [{"audio_filepath": str(tmp_path / f"{i}.wav"), "text": "hello there friend"} for i in range(12)] + [{"text": "only words"}]
    m = write(tmp_path / "m.jsonl", "\n".join(map(json.dumps, rows)))
    r = speech.check_data(spark, m)
    assert r["verdict"] == "FAIL" and {f["id"][8:] for f in r["findings"]} == {
        "INCONSISTENT-SR", "INCONSISTENT-CHANNELS", "MISSING-AUDIO", "UNREADABLE-AUDIO", "EMPTY-TRANSCRIPT", "DURATION-LONG", "DURATION-SHORT", "CHAR-RATE-OUTLIER", "DUPLICATES", "CLIPPING", "SILENCE", "UNNORMALIZED", "MIXED-SCRIPTS",
    }
    assert speech.check_data(spark, write(tmp_path / "t.jsonl", '{"text": "plain words"}'))["verdict"] == "PASS"
    assert speech.check_data(spark, write(tmp_path / "e.jsonl", "\n"))["findings"][0]["id"] == "TP-DATA-NO-DATA"
    assert speech.check_data(spark, write(tmp_path / "x.bin", "x"))["findings"][0]["id"] == "TP-DATA-INVALID-INPUT"
    assert speech.longest_silence(np.array([0, 0, 1, 0, 0, 0, 1.0])) == 3 and speech.longest_silence(np.zeros(4)) == 4 and speech.longest_silence(np.zeros(0)) == 0


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer model here")
def test_tokenizer(spark, tmp_path):
    good = write(tmp_path / "t.txt", "plain english words\n\n" + '{"text": "some more", "duration": 2.0}\n{broken\n')
    assert [f["id"] for f in tokenizer.check_tokenizer(spark, MODEL, good)["findings"]] == ["TP-TOK-PASS"]
    fast = write(tmp_path / "f.jsonl", '{"text": "one two three four five", "duration": 0.01}\n{"transcript": "call 1234567890123", "duration": 0.0}')
    assert {f["id"] for f in tokenizer.check_tokenizer(spark, MODEL, fast)["findings"]} == {"TP-TOK-HIGH-TPS", "TP-TOK-SUSPICIOUS-SPLIT"}
    assert tokenizer.check_tokenizer(spark, "/no/model", good)["findings"][0]["id"] == "TP-TOK-LOAD-FAIL"
    assert tokenizer.check_tokenizer(spark, MODEL, "/no/file")["findings"][0]["id"] == "TP-TOK-NO-TRANSCRIPTS"
    assert {f["id"] for f in tokenizer.judge(100, 1, 0, 0.0, 1)["findings"]} == {"TP-TOK-HIGH-OOV", "TP-TOK-LOW-COVERAGE"}


def test_watch_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    seen = []
    schema = "run_id string, rec_idx long, step double, loss double"

    def push(name, values, at):
        (src / name).write_text("\n".join(json.dumps({"run_id": "r", "rec_idx": at + i, "step": float(at + i), "loss": v}) for i, v in enumerate(values)))
        q = watch.watch(watch.stream_records(spark, str(src), schema), str(tmp_path / "store"), str(tmp_path / "ck"), lambda df, b: seen.append(df.select("run_id", "verdict", "n_f").collect()[0]))
        q.awaitTermination(120)

    push("a.json", FALL[:5], 0)
    push("b.json", FALL[5:], 5)
    push("c.json", [90.0] * 10, 15)
    assert [(r.verdict, r.n_f) for r in seen] == [(None, 5), ("PASS", 15), ("FAIL", 25)]


def test_stalls(spark):
    df = spark.createDataFrame([("a", 100.0), ("b", 390.0)], "run_id string, grew_at double")
    assert [r.run_id for r in watch.stalls(df, 410.0).collect()] == ["a"]
    c = watch.StallClock(300)
    assert [c.tick(10, 0), c.tick(10, 200), c.tick(10, 301), c.tick(10, 900), c.tick(11, 901), c.tick(11, 1300)] == [False, False, True, False, False, True]
