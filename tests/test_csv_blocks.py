"""CSV read from blocks: what the reader of whole files gives, wherever the blocks are cut."""

import os
import random
import tempfile

import pytest

from snippetry.sources.corpus import read_csv
from snippetry.sources.csv_blocks import read_csv_blocks
from snippetry.sources.sinks import write_csv

DDL = "snippet_id long, code string, label string, task_name string"
SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def blocks(spark):
    kept = {c: spark.conf.get(c) for c in SIZES}

    def cut(size):
        for c in SIZES:
            spark.conf.set(c, str(size))

    yield cut
    for c, v in kept.items():
        spark.conf.set(c, v)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def cells():
    """Breaks, doubled quotes, separators and quotes next to breaks, long cells over many blocks, repeated rows."""
    rng = random.Random(3)
    made = [(i, "".join(rng.choice(["a", ",", '"', "\n", "\r\n", '""', " ", "ß", "\\"]) for _ in range(rng.randint(1, 60))), "l", "t") for i in range(60)]
    made += [(100, '"\n' * 300, "l", "t"), (101, "\n" * 500 + "x", "l", "t"), (102, "NA", "None", "t"), (103, "x", "l", "t"), (103, "x", "l", "t")]
    return made


@pytest.mark.parametrize("size", [40, 97, 700, 1 << 20])
def test_equal_to_whole_files(spark, blocks, cells, size):
    path = tempfile.mkdtemp(prefix="snippetry-blocks-") + "/csv"
    write_csv(spark.createDataFrame(cells, DDL).coalesce(2), path)
    blocks(1 << 27)
    whole = rows_of(read_csv(spark, path).fillna("<null>"))
    expected = sorted((i, "<null>" if c == "NA" else c, "<null>" if lab == "None" else lab, t) for i, c, lab, t in cells)
    assert whole == expected
    blocks(size)
    assert rows_of(read_csv_blocks(spark, path).fillna("<null>")) == expected


def test_shuffled_blocks(spark, blocks, cells, monkeypatch):
    """More blocks than are broadcast."""
    path = tempfile.mkdtemp(prefix="snippetry-blocks-") + "/csv"
    write_csv(spark.createDataFrame(cells, DDL).coalesce(1), path)
    blocks(200)
    monkeypatch.setattr("snippetry.sources.csv_blocks.BROADCAST_ROWS", 3)
    assert len(rows_of(read_csv_blocks(spark, path).fillna("<null>"))) == len(cells)
    assert {r["snippet_id"]: r["code"] for r in read_csv_blocks(spark, path).collect()}[101] == cells[61][1]


def test_defined_cases(spark, blocks):
    root = tempfile.mkdtemp(prefix="snippetry-blocks-")

    def file(name, text):
        os.makedirs(f"{root}/{name}", exist_ok=True)
        with open(f"{root}/{name}/f.csv", "w", newline="", encoding="utf-8") as f:
            f.write(text)
        return f"{root}/{name}"

    blocks(30)
    head = "snippet_id,code,label,task_name"
    crlf = file("crlf", f'{head}\r\n1,"a\r\nb",l,t\r\n\r\n2,c,l,t\r\n')
    assert rows_of(read_csv_blocks(spark, crlf)) == [(1, "a\r\nb", "l", "t"), (2, "c", "l", "t")]
    assert rows_of(read_csv_blocks(spark, file("empty", ""))) == []
    assert rows_of(read_csv_blocks(spark, file("header", head))) == []
    unended = file("unended", f'{head}\n1,a,l,t\n2,b,l,t')
    assert [r[0] for r in rows_of(read_csv_blocks(spark, unended))] == [1, 2]
    with pytest.raises(Exception, match="other columns"):
        read_csv_blocks(spark, file("other", "id,code,label,task_name\n1,a,l,t\n")).collect()
    late = read_csv_blocks(spark, file("late", f"{head}\n1,a,l,t\n"))
    assert late.count() == 1
