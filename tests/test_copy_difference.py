from graphloom.functions.keys import as_key, as_whole
from graphloom.operators.copy_difference import copy_differences

SCHEMA = "k string, a int, b int, kind string, _l int"


def run(spark, left, right):
    pad = lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {tuple(r) for r in copy_differences(pad(left), pad(right), "k", ["a", "b"], "one", "two").collect()}


def test_all_kinds(spark):
    left = [("same", 1, 1), ("same", 1, 1), ("left", 1, 2), ("left", 1, 2), ("field", 1, None), ("both", 1, 2), (None, 1, 1), ("more", 1, 1), ("more", 2, 2)]
    right = [("same", 1, 1), ("right", 3, 3), ("field", 1, 4), ("both", 2, 1), ("both", 2, 1), (None, 9, 9), ("more", 1, 1)]
    assert run(spark, left, right) == {
        ("same", "row", "repeated_in_one", None, None),
        ("left", "row", "missing_in_two", None, None),
        ("right", "row", "missing_in_one", None, None),
        ("field", "b", "differs", None, "4"),
        ("both", "a", "differs", "1", "2"),
        ("both", "b", "differs", "2", "1"),
        ("more", "row", "repeated_in_one", None, None),
    }


def test_empty_sides_and_hot_key(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [("x", None, None)], []) == {("x", "row", "missing_in_two", None, None)}
    assert run(spark, [("h", i % 7, i) for i in range(500)], [("h", 3, -1)]) == {("h", "a", "differs", "0", "3"), ("h", "b", "differs", "0", "-1"), ("h", "row", "repeated_in_one", None, None)}


def test_every_row_of_a_key_is_compared(spark):
    left = [("m", 1, 1), ("m", 5, 5), ("m", 9, 9), ("m", 9, 9), ("same", 1, 1), ("same", 2, 2)]
    right = [("m", 1, 2), ("m", 5, 5), ("m", 8, 9), ("same", 2, 2), ("same", 1, 1)]
    assert run(spark, left, right) == {("m", "b", "differs", "1", "2"), ("m", "a", "differs", "9", "8")}
    assert run(spark, [("m", None, 1), ("m", 2, 1), ("m", 10, 1)], [("m", 2, 3), ("m", 10, 3)]) == {("m", "a", "differs", None, "2"), ("m", "b", "differs", "1", "3"), ("m", "a", "differs", "2", "10"), ("m", "row", "repeated_in_one", None, None)}
    assert run(spark, [("n", 1, 1), ("n", 2, 2)], []) == {("n", "row", "missing_in_two", None, None)}


def test_numbers_in_any_writing(spark):
    rows = spark.createDataFrame([(" 2",), ("02",), ("2.0",), ("2.00\t",), ("",), (" ",), (None,), ("two",)], "v string").select(as_whole("v"), as_key("v")).collect()
    assert [None if r[0] is None else int(r[0]) for r in rows] == [2, 2, 2, 2, None, None, None, None]
    assert [r[1] for r in rows] == ["2", "02", "2.0", "2.00", None, None, None, "two"]
