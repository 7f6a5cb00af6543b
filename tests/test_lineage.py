import pytest

from strandflow.frontend.corpus import close_over, parse_corpus
from strandflow.plans.lineage import Lineage

from .programs import EXTRACT, MACRO_USER, MEMBERS, SORTED, SQL_HOST, UPDATE, fan


@pytest.fixture(scope="module")
def lineage(spark):
    texts = {"EXTRACT": EXTRACT, "SORTED": SORTED, "UPDATE": UPDATE, "MACROS": MACRO_USER, "SQLHOST": SQL_HOST, "FAN": fan(70, False), "FAN2": fan(70, True)}
    programs = spark.createDataFrame(list(texts.items()), "program_id string, text string")
    members = spark.createDataFrame([(k, "found", v) for k, v in MEMBERS.items()], "name string, status string, text string")
    return Lineage(parse_corpus(programs, members))


def rows(df, program, *cols):
    return [tuple(r[c] for c in cols) for r in df.where(f"program_id = '{program}'").select(*cols).collect()]


def test_closure(spark):
    programs = spark.createDataFrame([("P", "%LAYOUT 1\n%RULES\n%GONE")], "program_id string, text string")
    members = spark.createDataFrame([(k, "found", v) for k, v in MEMBERS.items()], "name string, status string, text string")
    got = {(r["name"], r["status"], r["round"]) for r in close_over(programs, members).collect()}
    assert got == {("LAYOUT", "found", 0), ("RULES", "found", 0), ("GONE", "absent", 0), ("COUNTED", "found", 1)}
    bounded = {(r["name"], r["status"]) for r in close_over(programs, members, max_rounds=1).collect()}
    assert ("COUNTED", "bound") in bounded


def test_headline_flow(lineage):
    flow = {r["sink"]: r for r in lineage.field_flow.where("program_id = 'EXTRACT'").collect()}
    assert flow["OUTPAY:OP-YEAR"]["origins"] == ["STAFF:ST-GROSS"] and flow["OUTPAY:OP-YEAR"]["constants"] == ["12"]
    assert flow["OUTPAY:OP-YEAR"]["influenced_by"] == ["STAFF:ST-STATE"]
    grade = flow["OUTPAY:OP-GRADE"]
    assert grade["origins"] == [] and grade["no_origin_reason"] == "conditions" and grade["constants"] == ["H", "L"]
    assert grade["influenced_by"] == ["STAFF:ST-STATE", "YEARLY"]
    traced = dict(rows(lineage.influences, "EXTRACT", "gate", "traces_to"))
    assert traced["YEARLY"] == ["STAFF:ST-GROSS"]
    hops = lineage.paths.where("program_id = 'EXTRACT' and sink = 'OUTPAY:OP-YEAR'").first()["hops"]
    assert [h["via"] for h in hops] == ["assignment", "assignment"] and hops[0]["operators"] == ["*"]
    shown = next(v for k, v in flow.items() if k.startswith("@DISPLAY.SYSPRINT."))
    assert shown["cyclic"] and shown["origins"] == ["SEEN"] and shown["constants"] == ["1"]  # constants are those of the edge at the origin's end


def test_file_flow_and_directions(lineage):
    assert rows(lineage.file_flow, "EXTRACT", "from_file", "to_file", "fields", "activities") == [("STAFF", "OUTPAY", 3, ["PAYRUN"])]
    assert dict(rows(lineage.file_io, "UPDATE", "file", "io")) == {"MOVES": "read", "MASTER": "read-write", "ERRORS": "write", "CODES": "read"}


def test_report_edges_through_a_sort(lineage):
    flow = {r["sink"]: r for r in lineage.field_flow.where("program_id = 'SORTED'").collect()}
    assert flow["@TOTALS.SUM.SA-AMOUNT"]["origins"] == ["SALES:SA-AMOUNT"]
    path = lineage.paths.where("program_id = 'SORTED' and sink = '@TOTALS.SUM.SA-AMOUNT'").first()
    assert [h["via"] for h in path["hops"]] == ["sort-copy", "report-sum"]
    outcomes = {r["outcome"] for r in lineage.references.where("program_id = 'SORTED'").select("outcome").collect()}
    assert outcomes == {"scoped"}


def test_lookup_position_and_calls(lineage):
    e = {(r["via"], r["target"]): r["sources"] for r in lineage.edges.where("program_id = 'UPDATE'").collect()}
    assert e["table-lookup", "WS-NAME"] == ["CODES:CO-NAME", "MOVES:MV-CODE"]
    assert e["positioned-by", "MASTER:MA-BALANCE"] == ["MOVES:MV-KEY"]
    assert rows(lineage.calls, "UPDATE", "called", "arguments") == [("AUDIT", ["WS-BALANCE"])]
    assert rows(lineage.opaque, "UPDATE", "key") == [("WS-BALANCE",)]
    accumulating = lineage.edges.where("program_id = 'EXTRACT' and accumulates").select("target").collect()
    assert [r[0] for r in accumulating] == ["SEEN"]


def test_move_like_and_edge_order(lineage):
    like = rows(lineage.edges.where("via = 'move-like'").orderBy("edge_ord"), "MACROS", "target", "sources")
    assert like == [("GOOD:CU-KEY", ["EDITS:CU-KEY"]), ("GOOD:CU-NAME", ["EDITS:CU-NAME"]), ("GOOD:CU-STATE", ["EDITS:CU-STATE"])]


def test_path_limit_both_ways(lineage):
    flow = {r["program_id"]: r for r in lineage.field_flow.where("sink = 'OUT:OU-X' and program_id like 'FAN%'").collect()}
    assert flow["FAN"]["no_origin_reason"] == "conditions" and flow["FAN"]["path_limit"] is None
    assert flow["FAN2"]["no_origin_reason"] == "unmodelled" and flow["FAN2"]["path_limit"] == 64
    n = {r["program_id"]: r["n"] for r in lineage.paths.where("is_sink").groupBy("program_id").count().withColumnRenamed("count", "n").collect()}
    assert n["FAN"] == 70 and n["FAN2"] == 70


def test_sql_tables_and_hosts(lineage):
    assert rows(lineage.sql, "SQLHOST", "tables", "host_fields") == [(["GLDB.ACCTS", "GLDB.TRANS"], ["HOSTED"])]
    names = {(r["kind"], r["name"]) for r in lineage.artifacts.where("program_id = 'SQLHOST'").collect()}
    assert {("db2-table", "GLDB.LEDGER"), ("db2-table", "GLDB.TRANS"), ("file", "OUT")} <= names
    assert rows(lineage.opaque, "SQLHOST", "key") == [("HOSTED",)]


def test_manifest(lineage):
    kinds = {(r["kind"], r["name"], r["role"]) for r in lineage.artifacts.where("program_id = 'UPDATE'").collect()}
    assert ("program", "AUDIT", "called") in kinds and ("program", "ERRTRAP", "file exit") in kinds and ("file", "CODES", "ddname") not in kinds
    assert ("CODES", "instream-table") in rows(lineage.excluded, "UPDATE", "name", "kind")
    assert ("LAYOUT", "expanded") in rows(lineage.artifacts, "MACROS", "name", "status")


def test_unresolved_and_flags(spark):
    text = "FILE A FB(9 9)\n X 1 1 A\n S 1 4 A\nFILE B FB(9 9)\n X 1 1 A\nDEFINE W1 W 1 A\nJOB INPUT NULL NAME J\n W1 = X\n W1 = NOPE\n W1 = A:ZZ\n NONE = X\n W1 = STATUS\n"
    lin = Lineage(parse_corpus(spark.createDataFrame([("P", text)], "program_id string, text string")))
    got = {(r["reference"], r["role"], r["reason"].split(" ")[0]) for r in lin.unresolved.collect()}
    assert got == {("X", "source", "the"), ("NOPE", "source", "no"), ("A:ZZ", "source", "A"), ("NONE", "target", "no")}
    assert "overlap" in {r["code"] for r in lin.flags.collect()}
