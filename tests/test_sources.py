"""CSV dialects, other formats and database options."""

import pytest
from pyspark.sql import functions as F

from loomwork.plans import tree
from loomwork.sources import files
from loomwork.sources.records import read_records

SCHEMA = "id int, a string, b string"


def write(tmp_path, *lines, name="in.csv", encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(("\n".join(lines) + "\n").encode(encoding))
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_dialect(spark, tmp_path):
    path = write(tmp_path, "id;a;b", '1;"x;y";z', r'2;"say \"hi\"";  blanks', '3;;"";', name="a.csv")
    df = files.read_csv(spark, path, SCHEMA)
    assert rows(df)[:2] == [(1, "x;y", "z"), (2, 'say "hi"', "blanks")]
    path = write(tmp_path, "id;a;b", '3;;""', name="b.csv")
    assert rows(files.read_csv(spark, path, SCHEMA)) == [(3, None, "")]
    both = files.read_csv(spark, path, SCHEMA, files.CsvDialect(empty_is_null=False))
    assert rows(both)[0][0] == 3


def test_charset(spark, tmp_path):
    path = write(tmp_path, "id;a;b", "1;é;ü", encoding="iso-8859-1")
    df = files.read_csv(spark, path, SCHEMA, files.CsvDialect(encoding="ISO-8859-1"))
    assert rows(df) == [(1, "é", "ü")]


def test_skip_differing(spark, tmp_path):
    path = write(tmp_path, "id;a;b", "1;x;y", "2;short", "3;x;y;long", "4;u;v")
    df = files.read_csv(spark, path, SCHEMA, files.CsvDialect(skip_differing=True))
    assert [r[0] for r in rows(df)] == [1, 4]
    # the same lines count when only some columns are read, or none
    assert df.select("id").count() == 2 and df.count() == 2


def test_strict_quotes(spark, tmp_path):
    path = write(tmp_path, '"id";"a";"b"', '"1";"x;y";plain', '"2"; "p" ;"q"')
    df = files.read_csv(spark, path, SCHEMA, files.CsvDialect(strict_quotes=True))
    assert rows(df) == [(1, "x;y", None), (2, "p", "q")]
    with pytest.raises(ValueError):
        files.read_csv(spark, path, None, files.CsvDialect(strict_quotes=True))


def test_inference_and_many(spark, tmp_path):
    one = write(tmp_path, '"Name","Age"', "1,2", "3,4", "5,6", name="one.csv")
    comma = files.CsvDialect(sep=",")
    t = files.read_many(spark, {"one": one, "two": one}, dialect=comma)
    assert t["one"].dtypes == [("Name", "int"), ("Age", "int")]
    assert t["two"].where("Age > 3").count() == 2


def test_headerless(spark, tmp_path):
    path = write(tmp_path, '1,"An, na",pw,ACGT', "2,Bo,pw2,TTT")
    df = files.read_headerless(spark, path, ["ID", "Name", "Password", "Gene"])
    assert rows(df)[0] == ("1", "An, na", "pw", "ACGT")
    assert {t for _, t in df.dtypes} == {"string"}


def test_libsvm(spark, tmp_path):
    path = write(tmp_path, "1 1:0.5 3:2", "0 2:1", name="s.txt")
    df = files.read_libsvm(spark, path, 3)
    assert df.columns == ["label", "features"]
    assert [r["features"].toArray().tolist() for r in df.orderBy("label").collect()] == [
        [0, 1, 0], [0.5, 0, 2]]


def test_jdbc_options():
    # no database runs here: only the reader's options are checked
    got = files.jdbc_options("jdbc:x:y", "t", user="u", partition_column="id", lower=0,
                             upper=100, partitions=8)
    assert got["numPartitions"] == "8" and got["partitionColumn"] == "id"
    assert "password" not in got and got["dbtable"] == "t"
    with pytest.raises(ValueError):
        files.jdbc_options("jdbc:x:y", "t", partition_column="id")


def test_tree_learns(spark):
    data = spark.range(200).select(
        "id", (F.col("id") % 2).cast("double").alias("label"),
        F.array((F.col("id") % 2).cast("double") * 3 + 1, F.col("id").cast("double")).alias("v"))
    vectors = tree.labelled_vectors(data, "label", "v", "id")
    assert tree.index_features(vectors).categoryMaps.keys() == {0}
    train, test = tree.split(vectors)
    assert train.count() + test.count() == 200
    run = tree.train_tree(vectors, *tree.split_by_key(vectors, "id"))
    assert run.accuracy() == 1.0 and run.test_error() == 0.0
    assert "DecisionTreeClassificationModel" in run.tree_text
    assert {"prediction", "label", "features", "indexedFeatures"} <= set(run.predictions.columns)


BREAKS = ["1;\"x\ny\";z", "2;p;q", "3;\"\n\n;\";\"a \\\"quoted\\\" word\n\"", "4;\"\";",
          "5;\"" + "long\r\n" * 60 + "\";end", "6;u;\"v\"", "7;\"\n8;fake;row\n\";w"]
PARSED = [(1, "x\ny", "z"), (2, "p", "q"), (3, "\n\n;", 'a "quoted" word\n'), (4, "", None),
          (5, "long\r\n" * 60, "end"), (6, "u", "v"), (7, "\n8;fake;row\n", "w")]


@pytest.fixture()
def small_pieces(spark):
    """Files are cut every few bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "40", "spark.sql.files.openCostInBytes": "0",
            "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("ending", ["\n", "\r\n", ""])
def test_quoted_line_breaks_across_pieces(spark, tmp_path, small_pieces, ending):
    for n in range(3):  # every file has a header with a line break
        (tmp_path / f"{n}.csv").write_bytes(
            ('a;"b\nb";c\n' + "\n".join(BREAKS) + ending).encode())
    found = files.read_csv(spark, str(tmp_path), SCHEMA, files.CsvDialect(multi_line=True))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert sorted(rows(found)) == sorted(PARSED * 3)
    numbers = read_records(spark, str(tmp_path)).groupBy("file").agg(
        F.sort_array(F.collect_list("record")).alias("n")).collect()
    assert [r.n for r in numbers] == [list(range(1, 9))] * 3


def test_quoted_line_breaks_strict_and_skipping(spark, tmp_path, small_pieces):
    path = tmp_path / "strict.csv"
    path.write_text('"id";"a";"b"\n"1";"x\n\ny";plain\n"2";"p";"q"\n"3";"too\nfew"\n')
    dialect = dict(strict_quotes=True, multi_line=True)
    found = files.read_csv(spark, str(path), SCHEMA, files.CsvDialect(**dialect))
    assert sorted(rows(found)) == [(1, "x\n\ny", None), (2, "p", "q"), (3, "too\nfew", None)]
    kept = files.read_csv(spark, str(path), SCHEMA, files.CsvDialect(**dialect, skip_differing=True))
    assert sorted(rows(kept)) == [(1, "x\n\ny", None), (2, "p", "q")]
    kept = files.read_csv(spark, str(path), SCHEMA, files.CsvDialect(
        multi_line=True, skip_differing=True))
    assert sorted(rows(kept)) == [(1, "x\n\ny", "plain"), (2, "p", "q")]


def test_quoted_line_breaks_encoding_and_open_end(spark, tmp_path, small_pieces):
    path = tmp_path / "latin.csv"
    path.write_bytes("1;\"é\nü\";x\n2;\"ß;never closed\nat all".encode("iso-8859-1"))
    found = files.read_csv(spark, str(path), SCHEMA, files.CsvDialect(
        header=False, multi_line=True, encoding="ISO-8859-1"))
    assert min(rows(found)) == (1, "é\nü", "x") and found.count() == 2
    with pytest.raises(ValueError):
        files.read_csv(spark, str(path), SCHEMA, files.CsvDialect(multi_line=True, encoding="UTF-16"))
    (tmp_path / "none.csv").write_text("")
    assert files.read_csv(spark, str(tmp_path / "none.csv"), SCHEMA,
                          files.CsvDialect(multi_line=True)).count() == 0


def test_strict_header_by_position_and_bad_cells(spark, tmp_path):
    path = tmp_path / "strict.csv"
    path.write_text('"ID";"name"\n"1";"id"\n"x";"name"\n"id";"name"\n')
    df = files.read_csv(spark, str(path), "id int, name string",
                        files.CsvDialect(strict_quotes=True))
    rows = sorted((tuple(r) for r in df.collect()), key=str)
    assert rows == [(1, "id"), (None, "name"), (None, "name")]
