"""CSV in splits equals the file read as a whole, wherever the splits fall."""

import random

import pytest

from leadspark.functions import fixed as V
from leadspark.sources import files, records


def whole(text):
    """Records of a file by one pass over its characters."""
    rows, row, cell, quoted, k = [], [], "", False, 0
    text = text.removeprefix("﻿")
    while k < len(text):
        ch = text[k]
        if quoted:
            if ch == '"' and text[k + 1 : k + 2] == '"':
                cell, k = cell + '"', k + 1
            elif ch == '"':
                quoted = False
            else:
                cell += ch
        elif ch == '"':
            quoted = True
        elif ch == ",":
            row, cell = [*row, cell], ""
        elif ch == "\n":
            rows, row, cell = [*rows, [*row, cell]], [], ""
        elif ch != "\r":
            cell += ch
        k += 1
    if cell or row:
        rows.append([*row, cell])
    return [[c.replace("\r\n", "\n") for c in r] for r in rows if any(r)]


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set(k, v) for k, v in zip(old, (str(size), "0"))]
    for k, v in old.items():
        spark.conf.set(k, v)


TOKENS = ['"', '""', ",", "\n", "\r\n", "a", "word ", "é", "日本", '"quoted, text"', '"two\r\nlines"', "\n\n", '"\n\n\n"', "\r", "x" * 30]


@pytest.mark.parametrize("size", [60, 500])
def test_splits_equal_the_whole_file(spark, tmp_path, tiny_splits, size):
    rng = random.Random(size)
    texts = {f"f{k}.csv": "".join(rng.choices(TOKENS, k=rng.randint(0, 90))) for k in range(6)}
    # a file that ends inside quotes loses its last line break, so no such ending here
    texts = {name: text.rstrip("\r\n") + ("\n" if text.count('"') % 2 == 0 else "") for name, text in texts.items()}
    texts["f3.csv"] = "﻿" + texts["f3.csv"]
    texts["f5.csv"] = '"' + "inside\n" * 60 + '",end\nnext,row\n'
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    tiny_splits(size)
    rows = records.records(spark, f"{tmp_path}/*.csv").collect()
    for name, text in texts.items():
        mine = sorted((r for r in rows if r.file.endswith("/" + name)), key=lambda r: (r.block, r.seq))
        assert [list(r.cells) for r in mine] == whole(text), name
        assert not mine or mine[0].first


def test_a_file_is_read_by_many_tasks(spark, tmp_path, tiny_splits):
    line = '"{}","a ""b""\r\nc, {}",,yes\r\n'
    (tmp_path / "20260801-142726_town_gym.csv").write_bytes(("﻿place_id,name,phone,reachable\r\n" + "".join(line.format(k, k) for k in range(3000))).encode())
    tiny_splits(4000)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    rows = files.read_csv_text(spark, f"{tmp_path}/*.csv", V.ENRICHED_COLUMNS, parts=True).collect()
    assert {(r.place_id, r.name, r.reachable, r.address) for r in rows} == {(str(k), f'a "b"\nc, {k}', "yes", "") for k in range(3000)}
    ordered = sorted(rows, key=lambda r: (r.block, r.seq))
    assert [int(r.place_id) for r in ordered] == list(range(3000)) and {r.file for r in rows} == {"20260801-142726_town_gym.csv"}


def test_no_header_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"")
    (tmp_path / "b.csv").write_bytes(b"\n\n,,\n")
    (tmp_path / "c.csv").write_bytes(b"name,phone\nx,y\n")
    (tmp_path / "d.csv").write_bytes(b'\n\n"place_id",name\np1\np2,n,more,cells\n,\n')
    got = files.read_csv_text(spark, f"{tmp_path}/*.csv", ["place_id", "name", "phone"]).collect()
    assert sorted((r.place_id, r.name, r.phone, r.file) for r in got) == [("p1", "", "", "d.csv"), ("p2", "n", "", "d.csv")]
