import hashlib
import json
import os
import zipfile

import pytest

from shelfwright import cli
from shelfwright.plans.pipeline import organize, write_documents
from shelfwright.plans.apply import LAST_PLAN, apply_plan, record_and_apply
from shelfwright.sources import documents, extract
from shelfwright.sources import scan as scan_module
from shelfwright.sources.scan import image_fingerprints, scan
from shelfwright.streaming import landing


def write(root, name, data=b""):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(data)
    return str(p)


def test_tree(spark, tmp_path):
    names = ["a.txt", ".b.txt", "_c.txt", ".hid/x/d.txt", "sub/_u/e.txt", "sub/f.tmp", "g~", "h.empty"]
    for n in names:
        write(tmp_path, n, b"" if n == "h.empty" else n.encode())
    write(tmp_path, "bad.txt", b"a\xffb")
    with open(tmp_path / "big.txt", "wb") as f:
        f.truncate(5_000_001)
    with open(tmp_path / "mid.txt", "wb") as f:
        f.truncate(5_000_000)
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p>Hello\n <b>you</b></w:p>")
    write(tmp_path, "broken.docx", b"no zip")
    write(tmp_path, "y.pdf", b"%PDF-")
    rows = {os.path.relpath(r.path, tmp_path): r for r in scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {*names, "bad.txt", "big.txt", "mid.txt", "x.docx", "broken.docx", "y.pdf"}
    assert [r.path for r in sorted(rows.values(), key=lambda r: r.seq)] == sorted(r.path for r in rows.values())
    assert rows["bad.txt"].text == "ab" and rows["x.docx"].text == "Hello you" and rows["broken.docx"].text is None
    assert rows["big.txt"].hash is None and rows["mid.txt"].hash is not None and rows["mid.txt"].text is None
    assert rows["h.empty"].hash == hashlib.sha256(b"").hexdigest() and rows["h.empty"].type == "application/octet-stream"
    assert all(r.id == hashlib.md5(r.path.encode()).hexdigest() for r in rows.values())
    assert scan(spark, str(tmp_path / "sub" / "_u")).count() == 1


@pytest.mark.parametrize("parts", [1, 4, 1000])
def test_listing_below_the_upper_folders(tmp_path, parts, monkeypatch):
    for n in ["a/x", "a-b/x", "a.b", "ab", "a/y/z/w", "a/y/z-/w", "A/1", "a/y.txt", "é/1"]:
        write(tmp_path, n)
    os.symlink(tmp_path / "a", tmp_path / "link")
    os.symlink(tmp_path / "ab", tmp_path / "flink")
    monkeypatch.setattr(scan_module, "PARTS", parts)
    reader = scan_module.TreeReader(str(tmp_path), False)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    want = sorted(os.path.join(d, n) for d, _, names in os.walk(tmp_path) for n in names)
    assert [r[2] for r in sorted(rows)] == want and len({r[0] for r in rows}) == len(rows)


def test_text_gate(tmp_path):
    p = write(tmp_path, "t.md", b"x" * 3_000_000)
    assert extract.small_text(p) is not None
    write(tmp_path, "t.md", b"x" * 3_000_001)
    assert extract.small_text(p) is None and extract.small_text(str(tmp_path / "none")) is None and extract.luma(p) is None


def lines(path):
    return [json.loads(x) for x in open(path, encoding="utf-8")]


def test_apply(tmp_path):
    a, b = write(tmp_path, "a.txt", b"a"), write(tmp_path, "in/b.tmp", b"b")
    plan = {"moves": [{"id": "1", "from": a, "to": "/Documents/x/"}, {"from": str(tmp_path / "no"), "to": "q/"}, {"from": None, "to": "q/"}], "deletes": [{"path": a, "reason": "r"}, {"path": b, "reason": "t"}, {"path": None}]}
    dry = lines(apply_plan(plan, str(tmp_path), dry_run=True, stamp="1"))
    assert [x.get("status") for x in dry] == ["dry_run", "skip_not_found", "skip_not_found", "dry_run", "dry_run", "skip_not_found", None] and os.path.exists(a)
    real = lines(apply_plan(plan, str(tmp_path), stamp="2"))
    assert [x.get("status") for x in real] == ["moved", "skip_not_found", "skip_not_found", "skip_not_found", "quarantined", "skip_not_found", None]
    assert (tmp_path / "Documents/x/a.txt").exists() and (tmp_path / ".quarantine/2/b.tmp").exists() and real[-1]["retention_days"] == 30
    with pytest.raises(FileNotFoundError):
        apply_plan(plan, str(tmp_path / "none"))


def test_apply_options(tmp_path):
    a, b = write(tmp_path, "x/n.txt", b"1"), write(tmp_path, "y/n.txt", b"2")
    apply_plan({"moves": [{"from": a, "to": "z"}, {"from": b, "to": "z"}]}, str(tmp_path), distinct_names=True)
    assert sorted(os.listdir(tmp_path / "z")) == ["n (1).txt", "n.txt"]
    c = write(tmp_path, "c.txt", b"3")
    log = lines(apply_plan({"moves": [{"from": c, "to": "z"}], "deletes": [{"path": c}]}, str(tmp_path), deletes_first=True, stamp="9"))
    assert [x.get("status") for x in log] == ["quarantined", "skip_not_found", None]


def test_documents_round_trip(spark, tmp_path):
    g = {"nodes": [{"id": "root", "kind": "root", "label": "é →", "meta": {}, "reasoning": {"rationale": "r", "confidence": 1.0}}], "edges": [{"id": "e", "source": "root", "target": "x", "kind": "contains"}]}
    documents.write_json(str(tmp_path / "graph.json"), g)
    assert "\\u2192" in (tmp_path / "graph.json").read_text()
    n, e = documents.read_graph(spark, str(tmp_path / "graph.json"))
    assert n.first().label == "é →" and e.first().target == "x"
    documents.write_json(str(tmp_path / "plan.json"), {"summary": {"files_scanned": 1}, "moves": [{"id": "1", "from": "a", "to": "b", "reason": "r"}], "deletes": [], "cluster_costs": {"k": {"bytes": 1, "gb": 0.0, "monthly_cost": 0.0}}})
    p = documents.read_plan(spark, str(tmp_path / "plan.json")).first()
    assert p.moves[0]["from"] == "a" and p.cluster_costs["k"].bytes == 1
    documents.write_json(str(tmp_path / "summaries.json"), {"a": "b"})
    assert [tuple(r) for r in documents.read_summaries(spark, str(tmp_path / "summaries.json")).collect()] == [("a", "b")]
    assert documents.kind_of_file("My-GRAPH(1).json") == "graph" and documents.kind_of_file("x.json") is None


def test_commands():
    s = cli.Settings()
    assert cli.command("/rate 0.023", s) == ("rate", "0.023") and s.rate == 0.023
    assert cli.command("/DRYRUN off", s)[0] == "dryrun" and s.dry_run is False
    assert cli.command('organize directory "/a b"', s) == ("organize", "/a b") and cli.command("/nope", s)[0] == "unknown"
    assert cli.command("/model llama 3", s) == ("model", "llama 3") and s.model == "llama 3" and cli.command("/apply", s) == ("apply", None)


def test_landing(spark, tmp_path):
    row = "select 1L seq, md5('p/a.TXT') id, 'p/a.TXT' path, 3L size, 1.0D mtime, 'text/plain' type, 'h' hash, 1 scan_id, timestamp'2024-01-01' seen_at"
    spark.sql(row + " union all " + row).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = landing.landing(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("landed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    got = spark.table("landed").collect()
    assert len(got) == 1 and got[0].ext == "txt" and got[0].id_ok and got[0].bucket == "Documents"


def test_last_plan(tmp_path):
    log = lines(record_and_apply({"moves": [], "deletes": []}, str(tmp_path), dry_run=True))
    assert json.loads((tmp_path / LAST_PLAN).read_text()) == {"moves": [], "deletes": []} and len(log) == 1


def test_images(spark, tmp_path):
    write(tmp_path, "a.png", b"no image")
    write(tmp_path, "b.txt", b"text")
    assert image_fingerprints(scan(spark, str(tmp_path))).collect() == []


def test_command_line(tmp_path, capsys, spark):
    write(tmp_path, "in/a.txt", b"one two three")
    write(tmp_path, "in/b.log", b"one two three")
    assert cli.main(["--path", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--rate", "0.1"]) == 0
    plan = json.loads((tmp_path / "out/plan.json").read_text())
    assert sorted(d["reason"] for d in plan["deletes"]) == ["exact_duplicate", "near_duplicate_text:0", "temp_suffix"] and len(plan["moves"]) == 2 and plan["cluster_costs"]
    rows = scan(spark, str(tmp_path / "in"))
    docs = write_documents(organize(rows.drop("text"), rows.select("id", "text"), 1.7e9), str(tmp_path / "large"), most=1)
    assert set(docs) == {"plan"} and docs["plan"]["summary"]["files_scanned"] == 2
    assert spark.read.parquet(str(tmp_path / "large/moves")).count() == 2 and not (tmp_path / "large/graph.json").exists()
    assert cli.main(["--path", str(tmp_path / "in"), "--apply", str(tmp_path / "out/plan.json")]) == 0 and "[OK]" in capsys.readouterr().out
