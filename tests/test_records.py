from decimal import Decimal

from pyspark.sql import functions as F

from strandflow.operators import records


def test_fixed_records(spark, tmp_path):
    rows = [b"AB " + b"0012\xd5" + bytes.fromhex("12345D") + bytes.fromhex("0042") + bytes.fromhex("FFFE"), b"cd " + b"00099" + bytes.fromhex("00001C") + bytes.fromhex("9999") + bytes.fromhex("0100"), b"x  " + b"     " + bytes.fromhex("4040AA") + bytes(4)]
    (tmp_path / "f.bin").write_bytes(b"".join(rows))
    fields = [("a", 1, 3, "A", 0), ("n", 4, 5, "N", 1), ("p", 9, 3, "P", 2), ("u", 12, 2, "U", 0), ("b", 14, 2, "B", 0)]
    got = [tuple(r) for r in records.read_fixed(spark, str(tmp_path / "f.bin"), 15, fields).collect()]
    assert [(a, n and Decimal(n).normalize(), p and Decimal(p).normalize(), int(u), int(b)) for a, n, p, u, b in got] == [
        ("AB ", Decimal("-12.5"), Decimal("-123.45"), 42, -2), ("cd ", Decimal("9.9"), Decimal("0.01"), 9999, 256), ("x  ", Decimal(0), None, 0, 0),
    ]


def test_small_inputs(spark):
    assert records.no_input(spark).count() == 1
    table = records.instream_table(spark, ["A ADD", "D DROP"], [("code", 1, 1), ("name", 3, 20)])
    df = spark.createDataFrame([("A",), ("X",)], "code string")
    assert sorted(map(tuple, records.positioned(df, table, ["code"]).collect())) == [("A", "ADD", True), ("X", None, False)]
    empty = df.where("false").withColumn("n", F.lit(1))
    assert records.report(empty, ["code"], ["n"], final=False).count() == 0 and records.accumulated(empty, {"n": F.col("n")}).first()["n"] == 0
