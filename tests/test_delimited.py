"""Delimited files with quoted line breaks, read in splits of any size, against a plain reader."""

import csv
import random

import pytest

from gleanery.sources import delimited, tables


def written(path, rows, sep, seed):
    with open(path, "w", newline="") as f:
        csv.writer(f, delimiter=sep, quoting=csv.QUOTE_ALL if seed % 2 else csv.QUOTE_MINIMAL, lineterminator="\n").writerows(rows)


@pytest.mark.parametrize("seed", range(4))
def test_quoted_breaks_across_splits(spark, tmp_path, seed):
    rng = random.Random(seed)
    sep = ",;\t|"[seed]
    cell = lambda: "".join(rng.choice(["x", "yz", "\n", "\n\n", '"', '""', ",", ";", "ab c", "é"]) for _ in range(rng.randint(1, 7))).strip() or "e"
    folder = tmp_path / "in"
    folder.mkdir()
    want = []
    for n in range(3):
        rows = [(f"{n}-{i}", cell(), "long\nquoted" + "\nline" * 400 if i % 60 == 7 else cell()) for i in range(200)]
        written(folder / f"f{n}.csv", [("id", "a", "b"), *rows], sep, seed)
        want += rows
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("700", "4000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "100")
            df = tables.read_delimited(spark, str(folder), sep)
            assert df.columns == ["id", "a", "b"]
            if size == "700":
                assert df.rdd.getNumPartitions() > 20
            assert sorted(tuple(r) for r in df.collect()) == sorted(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_quotes_inside_cells_are_text():
    after = delimited.state_after(",")
    for line, inside, want in (('5" pipe, 6" pipe', False, False), ('a, "open', False, True), ('still', True, True), ('end", "again', True, True),
                               ('a,"b ""c""",d', False, False), ('"a"b,"c', False, True), ("", True, True), ("", False, False), ('""', False, False), ('"""', False, True)):
        assert after(line, inside) is want, line


def test_files_without_breaks_take_the_plain_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,"a, ""b"""\n2,5" pipe\n\n3,\n')
    assert delimited.read_records(spark, str(tmp_path), ",") is None
    assert sorted(tuple(r) for r in tables.read_delimited(spark, str(tmp_path)).collect()) == [("1", 'a, "b"'), ("2", '5" pipe'), ("3", None)]


def test_an_unclosed_quote_keeps_the_rest(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,"two\nlines"\n2,"open\nto the end\n')
    got = sorted(tuple(r) for r in tables.read_delimited(spark, str(tmp_path)).collect())
    assert got[0] == ("1", "two\nlines") and len(got) == 2 and got[1][0] == "2"
