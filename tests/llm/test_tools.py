from foliant.llm import _tools as tools


def test_bytes_of_nested_rows_are_counted(spark):
    row = ("abc", ["x" * 100, None, "é"], [["p" * 50] * 3, None], {"k" * 10: "v" * 20}, ("s" * 30, 5), None)
    d = spark.createDataFrame([row, (None,) * 6], "a string, b array<string>, c array<array<string>>, d map<string, string>, e struct<f: string, g: int>, `h.i` string")
    told, empty = [r[0] for r in d.select(tools.row_bytes(d)).collect()]
    held = 3 + 102 + 150 + 30 + 30
    assert empty == 16 + 8 * 6 + 16 and held + empty <= told <= held + empty + 16 * 10


def test_large_nested_tables_are_not_broadcast(spark):
    d = spark.range(10).selectExpr("id", "array(array(repeat('x', 1000))) AS a")
    hinted = lambda n: "ResolvedHint" in tools.broadcast_if_small(d, n)._jdf.queryExecution().analyzed().toString()
    assert hinted(20_000) and not hinted(5_000)
