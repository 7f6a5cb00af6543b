import json

import pytest

from strandflow import api
from strandflow.frontend.corpus import read_programs
from strandflow.plans.binding import provides
from strandflow.sources.bindings import WrongFormat, read_jobs

from .programs import EXTRACT, MACRO_USER, MEMBERS


def dd(ddname, dataset, **more):
    return {"ddname": ddname, "dataset": dataset, **more}


def document(bindings, steps):
    return {"format": "job-lineage", "job": "J", "steps": steps, "ddBindings": bindings}


@pytest.fixture()
def corpus(spark):
    return spark.createDataFrame([("EXTRACT", EXTRACT)], "program_id string, text string")


def bound(spark, corpus, tmp_path, doc, steps=None):
    (tmp_path / "job.json").write_text(json.dumps(doc))
    analysis = api.analyze(corpus, jobs=read_jobs(spark, str(tmp_path)), steps=steps)
    return analysis, {r["ddname"]: r.asDict() for r in analysis.bound_artifacts().collect()}


BINDINGS = [
    {"program": "RUNNER", "step": "S1", "ddname": "STAFF", "dataset": "PAY.MASTER", "io": "read"}, {"program": "RUNNER", "step": "S1", "ddname": "OUTPAY", "dataset": "PAY.OUT", "io": "write"},
    {"program": "RUNNER", "step": "S2", "ddname": "STAFF", "dataset": "PAY.OTHER", "io": "read"},
]


def test_binding_by_control_member(spark, corpus, tmp_path):
    steps = [{"step": "S1", "program": "RUNNER", "inputs": [dd("SYSIN", "SRC.LIB", member="EXTRACT")], "outputs": []}, {"step": "S2", "program": "RUNNER", "inputs": [dd("SYSIN", "SRC.OTHER")], "outputs": []}]
    analysis, got = bound(spark, corpus, tmp_path, document(BINDINGS, steps))
    assert (got["STAFF"]["dataset"], got["STAFF"]["route"], got["STAFF"]["identity"]) == ("PAY.MASTER", "member", "global")
    asks = {(r["name"], r["kind"], r["asked"]) for r in provides(analysis.lineage, analysis.bound_artifacts()).collect()}
    assert asks == {("EXTRACT", "program", True), ("PAY.OUT", "dataset", True)}


def test_binding_by_name_alone_and_candidates(spark, corpus, tmp_path):
    _, got = bound(spark, corpus, tmp_path, document(BINDINGS, []))
    assert got["STAFF"]["candidates"] == "PAY.MASTER|PAY.OTHER" and got["STAFF"]["route"] == "name-alone" and got["OUTPAY"]["dataset"] == "PAY.OUT"


def test_binding_by_caller_and_program(spark, corpus, tmp_path):
    steps = [{"step": "S1", "program": "EXTRACT", "inputs": [], "outputs": []}]
    _, got = bound(spark, corpus, tmp_path, document(BINDINGS, steps))
    assert got["STAFF"]["route"] == "program" and got["STAFF"]["dataset"] == "PAY.MASTER"
    chosen = spark.createDataFrame([("EXTRACT", "s2")], "program string, step string")
    _, got = bound(spark, corpus, tmp_path, document(BINDINGS, steps), chosen)
    assert got["STAFF"]["dataset"] == "PAY.OTHER" and got["OUTPAY"]["identity"] == "program-local"


def test_concatenations_keep_their_order(spark, corpus, tmp_path):
    rows = [{"program": None, "step": "S1", "ddname": "STAFF", "dataset": d, "io": "read", "concatIndex": i} for i, d in enumerate(["Z.ONE", "A.TWO"])]
    _, got = bound(spark, corpus, tmp_path, document(rows, []))
    assert got["STAFF"]["dataset"] == "Z.ONE+A.TWO"


def test_wrong_documents_are_refused(spark, corpus, tmp_path):
    with pytest.raises(WrongFormat):
        bound(spark, corpus, tmp_path, {"format": "other"})


def test_dependents_tell_nothing_from_nobody_asked(spark, corpus, tmp_path):
    (tmp_path / "job.json").write_text(json.dumps(document(BINDINGS, [])))
    jobs = read_jobs(spark, str(tmp_path))
    assert api.analyze(corpus, jobs=jobs).dependents_view() is None
    answers = spark.createDataFrame([("PAY.OUT", "dataset", "OTHERPGM")], "name string, kind string, dependent string")
    covered = spark.createDataFrame([("PAY.OUT", "dataset")], "name string, kind string")
    got = {r["name"]: (r["state"], r["n_dependents"]) for r in api.analyze(corpus, jobs=jobs, dependents=answers, covered=covered).dependents_view().collect()}
    assert got == {"EXTRACT": ("unanswered", None), "PAY.OUT": ("provided", 1)}


def test_replay_gives_the_same_view(spark, tmp_path):
    programs = spark.createDataFrame([("MACROS", MACRO_USER)], "program_id string, text string")
    members = spark.createDataFrame([(k, "found", v) for k, v in MEMBERS.items()], "name string, status string, text string")
    kept = api.gather(programs, members, str(tmp_path / "answers"))
    live, again = (api.text_digest(api.lineage_view(api.analyze(programs, m), "MACROS")) for m in (members, kept))
    assert live == again


def test_files_views_and_detection(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "extract.ezt").write_text(EXTRACT)
    programs = read_programs(spark, str(tmp_path / "src"))
    assert [r["program_id"] for r in programs.collect()] == ["EXTRACT"]
    analysis = api.analyze(programs)
    api.write_views(analysis, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "flow")).count() == analysis.lineage.field_flow.count()
    assert analysis.summary().first()["files"] == 2
    texts = spark.createDataFrame([("a", EXTRACT), ("b", "//J JOB\nFILE A\nFILE B"), ("c", "words"), ("d", "FILE A\n PROGRAM-ID\nFILE B")], "program_id string, text string")
    told = {r["program_id"]: (r["is_program"], r["why"]) for r in api.looks_like_program(texts).collect()}
    assert told == {"a": (True, "statements"), "b": (False, "job control"), "c": (False, "nothing found"), "d": (False, "other language")}
