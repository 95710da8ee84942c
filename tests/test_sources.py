"""Item files by column name, row positions, and the shared scratch folder."""

import types

import pytest

from glossa import session
from glossa.operators import prompts as D
from glossa.operators.splits import with_position
from glossa.sources import io as IO
from glossa.sources.quoted_csv import csv_options, read_csv


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_columns_are_matched_by_name(spark, tmp_path):
    p = write(tmp_path / "a.csv", '\ufeffda_question,extra,question,answer,da_answer\n"dq, 1",x,q1,"a\n1",da1\ndq2,y,"q ""2""",a2,da2\n')
    got = [tuple(r) for r in IO.read_items(spark, p).orderBy("pid").collect()]
    assert got == [(0, "q1", "a\n1", "dq, 1", "da1"), (1, 'q "2"', "a2", "dq2", "da2")]


def test_absent_columns_and_given_ids(spark, tmp_path):
    p = write(tmp_path / "b.tsv", "answer\tid\na\t7\nb\t3\n")
    got = [tuple(r) for r in IO.read_items(spark, p, sep="\t", schema=IO.SOURCE_SCHEMA).orderBy("id").collect()]
    assert got == [(3, None, "b"), (7, None, "a")]
    with pytest.raises(ValueError):
        IO.read_items(spark, write(tmp_path / "c.csv", "x,y\n1,2\n"))


def test_review_request_without_a_column(spark):
    df = spark.createDataFrame([(1, "q")], "pid long, question string")
    assert "q" in D.review_requests(df).first().user


def test_a_cluster_without_shared_folder_is_an_error():
    sc = types.SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    fake = types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError):
        session.checkpoint_root(fake)


HARD_CSV = ['pid,question,answer,da_question,da_answer', '1,plain,"two\nlines","q ""x""",', '', '2,"",\\N,"\n\n,,\n""\n",end', '3,"' + "long line, " * 40 + '\n\n\n' + "more\n" * 60 + '",a,b,c',
            '', '4," spaces ", x ,"\r\n","é𝄞"'] + [f'{i},q{i},"a{i}\n{i}",d,"{"z" * (i % 50)}"' for i in range(5, 60)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", ["37b", "200b", "1m"])
def test_many_splits_equal_the_whole_file_reader(spark, tmp_path, end, size):
    """Byte ranges that begin anywhere, inside quotes too."""
    path = tmp_path / "hard.csv"
    path.write_bytes(end.join(HARD_CSV).encode() + (b"" if size == "200b" else end.encode()))
    whole = spark.read.options(**csv_options(",")).csv(str(path))
    want = [tuple(r) for r in whole.collect()]
    assert len(want) == 59
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        got = read_csv(spark, str(path))
        tasks = spark.read.text(str(path)).rdd.getNumPartitions()
        rows = sorted([tuple(r) for r in got.collect()], key=lambda r: r[-1])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert tasks > 20 or size != "37b"
    assert [r[-1] for r in rows] == list(range(59))
    # the whole-file reader turns CR LF inside quotes to LF; here a text stays as it is
    unix = lambda r: tuple(v and v.replace("\r\n", "\n") for v in r)
    assert [unix(r[:-1]) for r in rows] == [unix(r) for r in want]
    assert rows[3][3] == "\r\n"


def test_positions_run_through_several_files(spark, tmp_path):
    write(tmp_path / "a.csv", 'question,answer\nq0,"a\n0"\nq1,a1\n')
    write(tmp_path / "b.csv", "question,answer\n")
    write(tmp_path / "c.csv", "question,answer\r\nq2,a2\r\n\r\nq3,a3")
    got = [tuple(r)[:3] for r in IO.read_items(spark, str(tmp_path)).orderBy("pid").collect()]
    assert got == [(0, "q0", "a\n0"), (1, "q1", "a1"), (2, "q2", "a2"), (3, "q3", "a3")]


def test_open_quotes_and_other_headers_are_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        read_csv(spark, write(tmp_path / "open.csv", 'question\n"a\nb\n'))
    (tmp_path / "two").mkdir()
    write(tmp_path / "two" / "a.csv", "question,answer\nq,a\n")
    write(tmp_path / "two" / "b.csv", "answer,question\na,q\n")
    with pytest.raises(Exception, match="another header"):
        read_csv(spark, str(tmp_path / "two")).collect()


def test_positions_of_repeated_and_null_keys(spark):
    rows = [(k, i) for i, k in enumerate([5, None, 2, 5, 5, None, 1, 9] * 30)]
    df = spark.createDataFrame(rows, "k int, row int")
    got = with_position(df.repartition(7), "k").collect()
    assert sorted(r.position for r in got) == list(range(240))
    assert [r.k for r in sorted(got, key=lambda r: r.position)] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k))
    assert {(r.row, r.position) for r in got} == {(r.row, r.position) for r in with_position(df.repartition(3), "k").collect()}
    words = spark.createDataFrame([(w, 1) for w in ["b", "a", "ab", "É", ""]], "w string, position_ int")
    assert [r.w for r in sorted(with_position(words, "w").collect(), key=lambda r: r.position)] == ["", "a", "ab", "b", "É"]
