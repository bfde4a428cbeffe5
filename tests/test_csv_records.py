"""CSV records over several lines, read by many tasks, against reading each file whole."""

import random

import pytest

from sextant.sources.csv import EmptySourceError, read_csv
from sextant.sources.records import csv_records, ends_inside


@pytest.mark.parametrize(
    "line, outside, inside",
    [
        ("", False, True), ("a,b", False, True), ('"a', True, False), ('a,"b', True, False), ('"a","b', True, True),
        ('"a ""b"', False, False), ('5" pipe,x', False, False), ('x"', False, False), ('","', False, True), ('"a"b,"c', True, True),
        ('""', False, True), ('"""', True, False), ('end",next', False, False), ('end","more', True, True),
    ],
)
def test_states(line, outside, inside):
    assert (ends_inside(line, False), ends_inside(line, True)) == (outside, inside)


def table(rng, rows, broken):
    def cell(k):
        text = "".join(rng.choice(["ab", " ", "é", "7", ",", '""', "x"]) for _ in range(rng.randint(1, 9)))
        if broken(k):
            text += rng.choice(["\n", "\r\n", "\n\n", ',\n"",', "\n" * 40 + "tail"]) + "end"
        return f'"{text}"'

    return [f'{k},{cell(k)},5" pipe {k}' for k in range(rows)]


def whole(spark, path):
    return spark.read.option("escape", '"').option("header", True).option("multiLine", True).csv(path)


@pytest.mark.parametrize("broken", [lambda k: k == 400, lambda k: k % 3 == 0, lambda k: k in (0, 799)])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_whole_files(spark, tmp_path, broken, end):
    rng = random.Random(3)
    for name in ("a", "b"):
        lines = ["no,text,last", *table(rng, 800, broken)]
        (tmp_path / f"{name}.csv").write_bytes((end.join(lines) + end).encode())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        path = str(tmp_path)
        records = csv_records(spark, path)
        assert records.count() == 1602
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        found = read_csv(spark, path, infer=False)
        expected = whole(spark, path)
        assert found.columns == expected.columns
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_broken_header_and_open_end(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('\n"a\nb",c\n1,"x\ny"\n\n2,"never closed\n3,4\n')
    found = read_csv(spark, str(path), infer=False)
    assert len(found.columns) == 2
    assert sorted(map(tuple, found.collect()))[0] == ("1", "x\ny")
    empty = tmp_path / "e.csv"
    empty.write_text('a,"b\n"\n')
    with pytest.raises(EmptySourceError):
        read_csv(spark, str(empty))
