import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillsieve import cli, storage
from quillsieve.operators.index import build_index
from quillsieve.plans.curate import curate
from quillsieve.plans.pack import lookup_body, pack
from quillsieve.sources import documents, writers
from quillsieve.streaming import gates as stream


def doc(name, description, body="body"):
    return f"---\nname: {name}\ndescription: {description}\n---\n{body}\n"


@pytest.fixture()
def folder(tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "s__plugins__pdf.md").write_text(doc("pdf", "read pdf files", "word " * 100))
    (raw / "s__xls.md").write_text(doc("xls", "sheet files", "word " * 100))
    (raw / "s__README.md").write_text(doc("r", "junk"))
    (raw / "s__none.md").write_text("no header")
    (raw / "s__ypdf.md").write_text(doc("PDF ", "Read PDF files"))
    (raw / "s__bad bytes+.md").write_bytes(doc("bad", "caf").encode() + b"\xff\r\nend\r")
    return str(raw)


def test_read_markdown(spark, folder):
    rows = {r["id"]: r["text"] for r in documents.read_markdown(spark, folder).collect()}
    assert set(rows) == {"s__plugins__pdf", "s__xls", "s__README", "s__none", "s__ypdf", "s__bad bytes+"}
    assert rows["s__bad bytes+"].endswith("�\nend\n")
    assert {r["id"] for r in documents.parse_entries(documents.read_markdown(spark, folder)).collect()} == {"s__plugins__pdf", "s__xls", "s__ypdf", "s__bad bytes+"}


def test_curate_and_pack(spark, folder, tmp_path):
    out = str(tmp_path / "drop")
    report = curate(spark, folder, out)
    assert "| dropped_density | 2 |" in report and "| s | 4 | 2 | 2 |" in report
    assert {r["id"] for r in documents.read_verdicts(spark, out).collect()} == {"s__ypdf", "s__bad bytes+"}
    extras = tmp_path / "extras.jsonl"
    extras.write_text(json.dumps({"id": "local__x", "name": "x", "description": "made by hand", "body": "b"}) + "\n\n{broken\n")
    done = pack(spark, folder, str(tmp_path / "out"), verdicts=out, extras=str(extras), attributions=spark.createDataFrame([("s", "u")], "source string, url string"))
    assert (done.kept, done.dropped, done.duplicates, done.appended, done.rows, done.changed, done.indexed) == (2, 2, 0, 1, 3, 1, 3)
    assert lookup_body(spark, str(tmp_path / "out"), "s__pdf").startswith("---\nname: pdf")
    assert lookup_body(spark, str(tmp_path / "out"), "s__none", folder) == "no header"
    assert lookup_body(spark, str(tmp_path / "out"), "nope", folder) is None
    with pytest.raises(ValueError):
        pack(spark, folder, str(tmp_path / "o2"), prefixes=("s__",))


def test_duplicates_are_counted(spark, folder, tmp_path):
    assert pack(spark, folder, str(tmp_path / "out")).duplicates == 1


def test_jsonl(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"id": "a", "description": "d"}\n\n{"id": "b", "name": "n", "description": ""}\n[1]\n{oops\n{"id": "c", "name": "N", "description": "日"}\n', encoding="utf-8")
    rows = documents.read_jsonl(spark, str(path)).orderBy("ord").collect()
    assert [(r["id"], r["name"]) for r in rows] == [("a", "a"), ("c", "N")]
    assert writers.check_jsonl(spark, str(path)) == 5
    for text in ("", "[]\n"):
        path.write_text(text)
        with pytest.raises(ValueError):
            writers.check_jsonl(spark, str(path))
    with pytest.raises(ValueError):
        writers.check_jsonl(spark, str(tmp_path / "none.jsonl"))


def test_verdicts_that_cant_be_read(spark, tmp_path, caplog):
    assert documents.read_verdicts(spark, str(tmp_path / "none")).count() == 0 and not caplog.records
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    assert documents.read_verdicts(spark, str(tmp_path / "bad")).count() == 0
    assert "nothing is gated" in caplog.text


def test_links_out_of_a_source_are_left_out(spark, tmp_path):
    for d in ("root/a", "root/b", "out"):
        (tmp_path / d).mkdir(parents=True)
    (tmp_path / "out" / "SKILL.md").write_text("secret")
    (tmp_path / "root" / "a" / "SKILL.md").write_text("x")
    (tmp_path / "root" / "b" / "SKILL.md").symlink_to(tmp_path / "out" / "SKILL.md")
    (tmp_path / "root" / "c").symlink_to(tmp_path / "out")
    (tmp_path / "root" / "d").symlink_to(tmp_path / "root" / "a")
    found = {r["id"] for r in documents.discover(spark, str(tmp_path / "root"), "s").collect()}
    assert "s__a" in found and not found & {"s__b", "s__c"}


def test_seed(spark, tmp_path, capsys):
    (tmp_path / "one" / "x").mkdir(parents=True)
    (tmp_path / "one" / "x" / "SKILL.md").write_text("text")
    out = tmp_path / "raw"
    assert cli.main(["seed", f"a={tmp_path / 'one'}", f"b={tmp_path / 'none'}", "--out", str(out)], spark) == 0
    assert "b: " in capsys.readouterr().err
    assert (out / "a__x.md").read_text() == "text"
    assert cli.main(["seed", f"b={tmp_path / 'none'}", "--out", str(out), "--clean"], spark) == 1
    assert not list(out.iterdir()) and cli.main(["seed", "wrong", "--out", str(out)], spark) == 2


def test_discover(spark, tmp_path):
    (tmp_path / "root" / "a" / "b").mkdir(parents=True)
    (tmp_path / "root" / "a" / "b" / "SKILL.md").write_text("x")
    (tmp_path / "root" / "SKILL.md").write_text("y")
    assert {r["id"] for r in documents.discover(spark, str(tmp_path / "root"), "src").collect()} == {"src__a__b", "src"}


def test_index_files(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(writers.IndexMissing):
        writers.read_index(spark, path)
    rows = spark.createDataFrame([("a", "n", "one two", 0)], "id string, name string, description string, ord long")
    assert writers.write_index(build_index(rows), path) == 1
    assert writers.read_index(spark, path).docs.first()["dl"] == 3
    writers.replace_table(spark.range(1), f"{path}/docs")
    with pytest.raises(writers.IndexCorrupt):
        writers.read_index(spark, path)


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.replace_table(spark.range(3), path)
    with pytest.raises(Exception):  # noqa: B017
        writers.replace_table(spark.range(3).select(F.raise_error(F.lit("no"))), path)
    assert spark.read.parquet(path).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_failed_move_puts_the_old_back(spark, tmp_path, monkeypatch):
    for n in ("a", "b"):
        writers.replace_table(spark.range(3), str(tmp_path / n))
        spark.range(5).write.parquet(str(tmp_path / "new" / n))
    real = writers.rename

    def fails(spark, source, target):
        if source.endswith("new/b"):
            raise OSError("no")
        real(spark, source, target)

    monkeypatch.setattr(writers, "rename", fails)
    with pytest.raises(OSError):
        writers.swap(spark, {str(tmp_path / "new" / n): str(tmp_path / n) for n in ("a", "b")})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b", "new"]
    assert [spark.read.parquet(str(tmp_path / n)).count() for n in ("a", "b")] == [3, 3]


def test_tables_go_when_their_reader_is_done(spark):
    with storage.scope():
        one, two = (storage.materialize(spark.range(3), "t") for _ in range(2))
        storage.discard(one)
        assert not storage.exists(spark, one._written_at) and two.count() == 3
    assert not storage.exists(spark, two._written_at)


def test_release_goes_on_after_an_error(spark, monkeypatch, caplog):
    before = dict(storage._written)
    tables = [storage.materialize(spark.range(1), "t") for _ in range(3)]
    real = storage.delete

    def fails(spark, path):
        if path == tables[1]._written_at:
            raise OSError("no")
        real(spark, path)

    monkeypatch.setattr(storage, "delete", fails)
    for path in before:  # those of other tests stay
        storage._written.pop(path)
    storage._forget(list(storage._written))
    storage._written.update(before)
    assert [storage.exists(spark, t._written_at) for t in tables] == [False, True, False]
    assert "stays" in caplog.text


def test_zip_and_description(tmp_path):
    (tmp_path / "f" / "__pycache__").mkdir(parents=True)
    for n in ("b.txt", "a.txt", ".DS_Store", "x.pyc"):
        (tmp_path / "f" / n).write_text(n)
    writers.zip_folder(str(tmp_path / "f"), str(tmp_path / "f.zip"), {"0.md": str(tmp_path / "f" / "a.txt")})
    assert zipfile.ZipFile(tmp_path / "f.zip").namelist() == ["0.md", "a.txt", "b.txt"]
    assert writers.check_description("x") is None and "951" in writers.check_description("x" * 951)
    with pytest.raises(ValueError):
        writers.check_description("x" * 1025)


def test_corpus_order_is_that_of_the_files(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "s__a__plugins__z.md").write_text(doc("one", "first file"))
    (raw / "s__b__skills__c.md").write_text(doc("two", "second file"))
    extras = tmp_path / "extras.jsonl"
    extras.write_text("".join(json.dumps({"id": f"local__{i}", "name": i, "description": "made by hand", "body": "b"}) + "\n" for i in "mab"))
    readme = tmp_path / "README.md"
    readme.write_text(doc("n", "about the package"))
    out = str(tmp_path / "out")
    pack(spark, str(raw), out, extras=str(extras), readme=str(readme))
    want = ["s__z", "s__c", "local__m", "local__a", "local__b"]
    assert [r["id"] for r in spark.read.parquet(f"{out}/corpus").orderBy("ord").collect()] == want
    assert [r["id"] for r in writers.read_index(spark, f"{out}/index").docs.orderBy("ord").collect()] == want
    names = zipfile.ZipFile(f"{out}/bundle.zip").namelist()
    assert "README.md" in names and any(n.startswith("index/postings/") for n in names) and any(n.startswith("corpus.jsonl/") for n in names)
    readme.write_text(doc("n", "x" * 1025))
    with pytest.raises(ValueError):
        pack(spark, str(raw), out, readme=str(readme))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["bundle.zip", "corpus", "corpus.jsonl", "index"]


def test_first_line_of_equal_ones_is_indexed(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text("".join(json.dumps({"id": i, "name": "n", "description": "d"}) + "\n" for i in "ba"))
    assert cli.main(["build-index", str(path), "--index", str(tmp_path / "index")], spark) == 0
    assert [r["id"] for r in writers.read_index(spark, str(tmp_path / "index")).docs.collect()] == ["b"]


def test_extras_that_cant_be_read_stay(spark, tmp_path):
    (tmp_path / "tool").mkdir()
    (tmp_path / "tool" / "SKILL.md").write_text(doc("t", "new"))
    extras = tmp_path / "extras"
    extras.write_bytes(b"PAR1\x00\x01 no lines")
    assert cli.main(["add-local", str(tmp_path / "tool"), "--extras", str(extras)], spark) == 1
    assert extras.read_bytes() == b"PAR1\x00\x01 no lines"
    extras.write_text('{broken\n{"id": "local__tool", "name": "old"}\n{"id": "a", "name": "n", "more": 1}\n')
    assert cli.main(["add-local", str(tmp_path / "tool"), "--extras", str(extras)], spark) == 0
    lines = [r[0] for r in spark.read.text(str(extras)).collect()]
    assert lines[0] == '{"id": "a", "name": "n", "more": 1}' and lines[2] == "{broken"
    assert json.loads(lines[1])["description"] == "new"


def test_bundles(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("tool/SKILL.md", doc("t", "top"))
        z.writestr("tool/sub/part/SKILL.md", doc("p", "part"))
    assert cli.main(["add-local", str(tmp_path / "z.zip"), "--extras", str(tmp_path / "extras")], spark) == 0
    assert [r["id"] for r in documents.read_extras(spark, str(tmp_path / "extras")).orderBy("ord").collect()] == ["local__tool", "local__tool__sub__part"]
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as z:
        z.writestr("../evil.md", "x")
    assert cli.main(["add-local", str(tmp_path / "evil.zip"), "--extras", str(tmp_path / "extras")], spark) == 1
    assert cli.main(["add-local", str(tmp_path / "none"), "--extras", str(tmp_path / "extras")], spark) == 1


def test_command_line(spark, folder, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert cli.main(["pack", folder, "--out-dir", out], spark) == 0
    capsys.readouterr()
    assert cli.main(["search", "pdf", "2", "--index", f"{out}/index"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["id"] == "s__pdf"
    assert cli.main(["search", "日本 русский", "--index", f"{out}/index"], spark) == 0
    assert json.loads(capsys.readouterr().out) == []
    assert cli.main(["load", "s__pdf", "--packed", out], spark) == 0
    assert capsys.readouterr().out.startswith("<!-- id: s__pdf -->\n")
    assert cli.main(["load", "nope", "--packed", out], spark) == 1
    assert cli.main(["search", "x", "--index", str(tmp_path / "none")], spark) == 1
    assert cli.main(["search"], spark) == 2
    assert cli.main(["curate", folder, "--out", str(tmp_path / "d"), "--priority", "s=1", "--no-dedup", "--report", str(tmp_path / "r.md")], spark) == 0
    assert "| s | 4 | 2 | 2 |" in (tmp_path / "r.md").read_text()
    assert cli.main(["pack", folder, "--out-dir", out, "--attribution", "s=https://example.org/s"], spark) == 0
    assert {r["source"] for r in spark.read.parquet(f"{out}/corpus").collect()} == {"https://example.org/s"}


def test_streams(spark, tmp_path):
    rows = [("s__a", "n", "d", "word " * 100), ("s__b", "n", "d", "thin​"), ("s__c", "‮", "d", "x")]
    spark.createDataFrame(rows, "id string, name string, description string, body string").write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("id string, name string, description string, body string").parquet(str(tmp_path / "in"))
    for name, df in (("gated", stream.gate_stream(read)), ("clean", stream.sanitize_stream(read)), ("tokens", stream.token_stream(read))):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert {r["id"]: r["reason"] for r in spark.table("gated").collect()} == {"s__a": None, "s__b": "density:prose<200", "s__c": "inject:bidi"}
    assert spark.table("clean").where("id = 's__b'").first()["body"] == "thin"
    assert spark.table("tokens").where("id = 's__a' AND token = 'd'").first()["tf"] == 1
