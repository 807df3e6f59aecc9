"""Byte-range CSV against the multi-line reader."""
import os
import random
import tempfile

import pytest

from lapsewise.sources.csv_ranges import CLOSING, OPEN, REST, WHOLE, assemble, read_quoted_csv, records

PLAIN = 'id,text,note\n1,"a, ""b""\n\nc",x\n2,,"\n"\n\n3,"""",""\n4,é😀,"x\n""\n"\n5,last,"no break at the end"'


@pytest.fixture
def ranges(spark):
    """Sets the size of a range."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def put(size):
        for n, v in zip(names, (size, 0, 1), strict=True):
            spark.conf.set(n, str(v))
    yield put
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def write(text):
    path = os.path.join(tempfile.mkdtemp(), "t.csv")
    with open(path, "wb") as f:
        f.write(text.encode())
    return path


def whole(spark, path):
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return read.columns, sorted(map(tuple, read.collect()), key=str)


def in_ranges(spark, path):
    read = read_quoted_csv(spark, path)
    return read.columns, sorted(map(tuple, read.collect()), key=str)


@pytest.mark.parametrize("text", [PLAIN, PLAIN + "\n", PLAIN.replace("\n", "\r\n"), "id,text,note\n"])
def test_ranges_give_the_rows_of_the_multi_line_reader(spark, ranges, text):
    path = write(text)
    ranges(1 << 20)
    expected = whole(spark, path)
    for size in (1 << 20, 40, 11, 3):
        ranges(size)
        assert in_ranges(spark, path) == expected, size


def test_random_files(spark, ranges):
    rng = random.Random(4)
    say = lambda: "".join(rng.choice(['a', ' ', '""', '\n', ',', 'ß', '\n\n']) for _ in range(rng.randrange(9)))
    lines = [f'{i},"{say()}","{say()}"' if rng.random() < 0.7 else f"{i},plain," for i in range(300)]
    path = write("id,text,note\n" + "\n".join(lines) + "\n")
    ranges(1 << 20)
    expected = whole(spark, path)
    assert len(expected[1]) == 300
    for size in (700, 97):
        ranges(size)
        assert in_ranges(spark, path) == expected
        assert records(spark, path).rdd.getNumPartitions() > 3


def test_every_offset_of_a_break():
    """Wherever a file is cut into ranges at line starts, the pieces make the same records."""
    lines = PLAIN.split("\n")
    expected = [r[4] for r in assemble(("f", 0, False, x) for x in lines)]
    for a in range(1, len(lines)):
        for b in range(a, len(lines)):
            starts, odd = [], False
            for x in lines:
                starts.append(odd)
                odd ^= x.count('"') % 2 == 1
            rows = list(assemble(("f", 0 if i < a else 1 if i < b else 2, starts[0 if i < a else a if i < b else b], x)
                                 for i, x in enumerate(lines)))
            got, held = [], None
            for _, _, kind, _, text in rows:
                if kind == WHOLE:
                    got.append(text)
                elif kind == OPEN:
                    held = text
                else:
                    held += "\n" + text
                    if kind == CLOSING:
                        got.append(held)
                        held = None
                    else:
                        assert kind == REST
            assert held is None and got == expected


def test_an_open_value_at_the_end(spark, ranges):
    path = write('id,text\n1,a\n2,"never closed\n3,b\n')
    ranges(10)
    columns, rows = in_ranges(spark, path)
    assert columns == ["id", "text"] and ("1", "a") in rows and len(rows) == 2
