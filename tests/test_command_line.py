"""Names, jobs and the command line."""

import io
import json

import pytest

from strandflow import __main__ as cli
from strandflow import api
from strandflow.frontend.corpus import read_programs
from strandflow.sources.bindings import read_jobs

from .programs import EXTRACT, MACRO_USER, MEMBERS, SQL_HOST


def out(spark, path):
    return [r.asDict() for r in spark.read.json(str(path)).collect()]


def test_members_of_one_name_in_two_libraries_stay_apart(spark, tmp_path):
    for lib, word in (("a", "ONE"), ("b", "TWO")):
        (tmp_path / lib).mkdir()
        (tmp_path / lib / "same.ezt").write_text(f"FILE {word} FB(80 800)\n  {word}-X 1 5 A\nJOB INPUT {word} NAME RUN\n  DISPLAY {word}-X\n")
    (tmp_path / "a" / "alone.ezt").write_text(EXTRACT)
    programs = read_programs(spark, str(tmp_path / "*"))
    ids = sorted(r["program_id"] for r in programs.collect())
    assert len(ids) == 3 and ids[0] == "ALONE" and all(i.startswith("SAME@/") for i in ids[1:])
    flows = api.analyze(programs).lineage.field_flow.where("program_id like 'SAME%'").collect()
    assert len(flows) == 2 and all(len(r["origins"]) == 1 for r in flows)


def two_jobs(tmp_path):
    def doc(job, program, dataset):
        return {"format": "job-lineage", "job": job, "steps": [{"step": "STEP1", "program": program, "inputs": [], "outputs": []}],
                "ddBindings": [{"program": program, "step": "STEP1", "ddname": "STAFF", "dataset": dataset, "io": "read", "generation": "+1", "concatIndex": 0}]}

    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs" / "one.json").write_text(json.dumps(doc("J1", "EXTRACT", "MY.DATA")))
    (tmp_path / "jobs" / "two.json").write_text(json.dumps(doc("J2", "OTHER", "OTHER.DATA")))
    return str(tmp_path / "jobs")


def test_steps_of_one_name_in_two_jobs(spark, tmp_path):
    programs = spark.createDataFrame([("EXTRACT", EXTRACT)], "program_id string, text string")
    jobs = read_jobs(spark, two_jobs(tmp_path))
    got = {r["ddname"]: r for r in api.analyze(programs, jobs=jobs).bound_artifacts().collect()}
    assert (got["STAFF"]["dataset"], got["STAFF"]["identity"], got["STAFF"]["route"]) == ("MY.DATA", "global", "program")
    assert got["STAFF"]["readings"][0][0].asDict() == {"dataset": "MY.DATA", "generation": "+1", "concatIndex": 0}
    chosen = spark.createDataFrame([("EXTRACT", "J2", "step1")], "program string, job string, step string")
    got = {r["ddname"]: r for r in api.analyze(programs, jobs=jobs, steps=chosen).bound_artifacts().collect()}
    assert got["STAFF"]["dataset"] == "OTHER.DATA" and got["STAFF"]["route"] == "caller"


def test_flags_come_in_a_fixed_order(spark):
    programs = spark.createDataFrame([("P", "FILE A FB(80 800)\n  A-X 1 5 A\n  A-X 6 5 A\nJOB INPUT A NAME R\n  FROB A-X\n  SQL SELECT B INTO :C FROM D\n  MOVE A-X A-X\n")], "program_id string, text string")
    lin = api.analyze(programs).lineage
    codes = [r["code"] for r in lin.flags.orderBy("place").collect()]
    assert codes.index("field-twice") < codes.index("unknown-verb") < codes.index("sql") and api.lineage_view(api.analyze(programs), "P")["flags"][0]["code"] == codes[0]


@pytest.fixture()
def estate(tmp_path):
    for folder in ("src", "near", "far"):
        (tmp_path / folder).mkdir()
    (tmp_path / "src" / "macros.ezt").write_text(MACRO_USER)
    for name, text in MEMBERS.items():
        (tmp_path / "far" / f"{name.lower()}.mac").write_text(text)
    (tmp_path / "near" / "layout.lib").write_text(MEMBERS["LAYOUT"].replace("CU-KEY", "CU-NEAR"))
    return tmp_path


def test_command_line_follows_members_in_the_order_of_folders(spark, estate, capsys):
    at = lambda *x: str(estate.joinpath(*x))
    assert cli.main([at("src"), at("out"), "-I", at("near"), "-I", at("far"), "--summary"]) == 0
    said = capsys.readouterr().out
    assert "[MACROS]" in said and "FLOW EDITS -> GOOD" in said
    assert {r["target"] for r in out(spark, estate / "out" / "lineage") if "target" in r} >= {"GOOD:CU-KEY"}
    assert cli.main([at("src"), at("out2"), "-I", at("near"), "-I", at("far"), "--macro-ext", ".lib", "--target", "lineage"]) == 0
    assert {r["target"] for r in out(spark, estate / "out2" / "lineage")} >= {"GOOD:CU-NEAR"} and not (estate / "out2" / "artifacts").exists()


def test_command_line_bundles(spark, estate):
    at = lambda *x: str(estate.joinpath(*x))
    assert cli.main([at("src"), at("none"), "-I", at("far"), "--gather-only", at("bundle")]) == 0
    assert cli.main([at("src"), at("live"), "-I", at("far")]) == cli.main([at("src"), at("again"), "--from-bundle", at("bundle")]) == 0
    norm = lambda d: sorted(json.dumps(r, sort_keys=True, default=str) for r in out(spark, estate / d / "flow"))
    assert norm("live") == norm("again") and norm("live")
    assert cli.main([at("src"), at("x"), "--gather-only", at("b"), "--from-bundle", at("bundle")]) == 2


def test_command_line_binding_and_answers(spark, tmp_path, monkeypatch):
    jobs = two_jobs(tmp_path)
    (tmp_path / "syn.json").write_text(json.dumps({"GLDB.TRANS": "GLDB.TRANSACTIONS"}))
    (tmp_path / "dep.json").write_text(json.dumps({"program": {"EXTRACT": ["RUNNER"]}}))
    monkeypatch.setattr("sys.stdin", io.StringIO(EXTRACT))
    o = tmp_path / "out"
    assert cli.main(["-", str(o), "--program-name", "extract", "--bind", jobs, "--bind-step", "J2.STEP1", "--dependents", str(tmp_path / "dep.json"), "--target", "artifacts"]) == 0
    assert {r["ddname"]: r.get("dataset") for r in out(spark, o / "bound")}["STAFF"] == "OTHER.DATA"
    assert {r["name"]: r["state"] for r in out(spark, o / "dependents") if "name" in r}["EXTRACT"] == "provided"
    monkeypatch.setattr("sys.stdin", io.StringIO(SQL_HOST))
    assert cli.main(["-", str(tmp_path / "out3"), "--synonyms", str(tmp_path / "syn.json"), "--target", "artifacts"]) == 0
    assert {r["name"]: r.get("base") for r in out(spark, tmp_path / "out3" / "artifacts")}["GLDB.TRANS"] == "GLDB.TRANSACTIONS"


def test_exit_codes(spark, tmp_path, monkeypatch):
    (tmp_path / "p.ezt").write_text(EXTRACT)
    (tmp_path / "bad.json").write_text(json.dumps({"format": "other"}))
    src, o = str(tmp_path / "p.ezt"), str(tmp_path / "o")
    assert cli.main([src, o, "--bind", str(tmp_path / "bad.json")]) == 1
    assert cli.main([str(tmp_path / "nowhere"), o]) == 2 and cli.main([src, o, "--synonyms", str(tmp_path / "nowhere.json")]) == 2
    assert cli.main([src, o, "--dependents", str(tmp_path / "bad.json")]) == 2
    monkeypatch.setattr(cli, "run", lambda args: (_ for _ in ()).throw(KeyboardInterrupt()))
    assert cli.main([src, o]) == 130
