import csv
import io
import random
from contextlib import contextmanager

import pytest

from tillwise.fixed_values import NULL_TOKENS
from tillwise.sources.csv_files import BAD_HEADER, BAD_LINE, OPEN_QUOTE, load_data, write_csv


@contextmanager
def splits_of(spark, size):
    """Files are cut into splits of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key in keys:
            spark.conf.set(key, str(size))
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def by_python(text):
    """Rows as Python's csv reads them, with short ones filled up and blank lines left out."""
    rows = [row for row in csv.reader(io.StringIO(text, newline="")) if row]
    width = len(rows[0])
    return sorted(
        (tuple(None if cell in NULL_TOKENS else cell for cell in row + [""] * (width - len(row))) for row in rows[1:]), key=repr
    )


def by_spark(spark, path, **options):
    return sorted((tuple(row) for row in load_data(spark, str(path), **options).collect()), key=repr)


def messy(lines, end="\n", seed=4):
    """Every kind of cell: line breaks, doubled quotes, commas, quotes inside unquoted cells, short lines, blank lines."""
    rng = random.Random(seed)
    kinds = [
        lambda k: f"plain {k}", lambda k: '""', lambda k: "", lambda k: f'"a, {k}"', lambda k: f'"say ""{k}"""', lambda k: '""""',
        lambda k: f'"{k}\nline two\nline ""three"""', lambda k: '"\n"', lambda k: '"\n\n,\n"",""\n"', lambda k: f'{k}" pipe',
        lambda k: "ü ∑ " * 9, lambda k: '"""\n"""', lambda k: '"\n' + "long " * 60 + '\n"', lambda k: 'x"y"z', lambda k: '"tail\n"',
    ]
    out = ["Date,Order ID,note"]
    for k in range(lines):
        cells = [f"2026-01-{k % 28 + 1:02d}", rng.choice(kinds)(k), rng.choice(kinds)(k)]
        out.append(",".join(cells[: rng.choice([3, 3, 3, 2])]))
        if k % 17 == 0:
            out.append("")
    return end.join(out) + end


@pytest.mark.parametrize("size, end", [(150, "\n"), (1 << 27, "\n"), (900, "\r\n")])
def test_line_breaks_in_splittable_files(spark, tmp_path, size, end):
    text = messy(120, end)
    (tmp_path / "in.csv").write_bytes(text.encode())
    with splits_of(spark, size):
        found = by_spark(spark, tmp_path / "in.csv")
        assert found == by_python(text) and len(found) == 120
        assert by_spark(spark, tmp_path / "in.csv", line_breaks_in_cells=True) == found


def test_a_cell_over_many_splits(spark, tmp_path):
    text = 'a,b\n1,"' + "\n".join(f'row {k}, ""{k}""' for k in range(120)) + '"\n2,x\n3,"y\ny"\n'
    (tmp_path / "in.csv").write_text(text)
    with splits_of(spark, 150):
        assert by_spark(spark, tmp_path / "in.csv") == by_python(text)


def test_folder_of_files_with_and_without_breaks(spark, tmp_path):
    texts = [messy(60, seed=k) for k in range(3)] + ["Date,Order ID,note\n" + "".join(f"2026-02-01,{k},n\n" for k in range(50))]
    for k, text in enumerate(texts):
        (tmp_path / f"part {k}%[x].csv").write_bytes(text.encode())
    with splits_of(spark, 2000):
        assert by_spark(spark, tmp_path) == sorted(sum(map(by_python, texts), []), key=repr)


def test_headers(spark, tmp_path):
    (tmp_path / "broken.csv").write_text('"Order\nID",note\n1,"a\nb"\n')
    found = load_data(spark, str(tmp_path / "broken.csv"))
    assert found.columns == ["Order\nID", "note"] and [tuple(row) for row in found.collect()] == [("1", "a\nb")]
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text('a,b\n1,"x\ny"\n')
    (folder / "b.csv").write_text('b,a\n1,"x\ny"\n')
    with pytest.raises(Exception, match=BAD_HEADER):
        load_data(spark, str(folder)).collect()
    (tmp_path / "blank.csv").write_text('\n\na,b\n\n1,"x\ny"\n   \n')
    assert by_spark(spark, tmp_path / "blank.csv") == [("1", "x\ny")]
    (tmp_path / "none.csv").write_text("a,b\n")
    assert by_spark(spark, tmp_path / "none.csv") == by_spark(spark, tmp_path / "none.csv", line_breaks_in_cells=True) == []


def test_lines_that_never_fit(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n' + "3,z\n" * 100)
    with pytest.raises(ValueError, match=OPEN_QUOTE):
        load_data(spark, str(tmp_path / "open.csv"))
    (tmp_path / "long.csv").write_text('a,b\n1,"x\ny"\n1,"p\nq",3\n')
    with pytest.raises(Exception, match=BAD_LINE):
        load_data(spark, str(tmp_path / "long.csv")).collect()


def test_very_long_cells_on_short_lines(spark, tmp_path):
    cell = "w w\n" * 250_000
    (tmp_path / "big.csv").write_text(f'a,b,c\n4,"{cell}"\n5,"{cell.replace(chr(10), " ")}"\n6,{"z" * 1_000_000}\n')
    found = by_spark(spark, tmp_path / "big.csv")
    assert [(r[0], len(r[1]), r[2]) for r in found] == [("4", 1_000_000, None), ("5", 1_000_000, None), ("6", 1_000_000, None)]


def test_written_cells_come_back_as_they_are(spark, tmp_path):
    cells = [" a ", "b\n", "\n\n", "\t", 'q"', "\r\nx", ", ", "x\r"]
    write_csv(spark.createDataFrame([(str(k), cell) for k, cell in enumerate(cells)], "a string, b string"), str(tmp_path / "out"))
    assert [row[1] for row in by_spark(spark, tmp_path / "out")] == cells
