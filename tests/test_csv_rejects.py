import os
import tempfile

import pytest
from evoselect.sources.csv import read_feature_csv, read_feature_csv_lenient


@pytest.fixture(scope="module")
def folder():
    d = tempfile.mkdtemp(prefix="csv-rejects-")
    for name, lines in (("a.csv", ["1,2,3", "1,x,3", "1,2"]), ("b.csv", ["", " 4 , 5e1,-6", "7,,NaN", "1,2,3,4", "1,2,3"])):
        with open(os.path.join(d, name), "w") as f:
            f.write("\n".join(lines) + "\n")
    return d


def test_rejects_say_what_and_where(spark, folder):
    rows, rejects = read_feature_csv_lenient(spark, folder, 3)
    got = sorted(((os.path.basename(r["file"]), r["line"], r["row_idx"], r["field"], r["reason"], r["value"])
                  for r in rejects.collect()), key=str)
    assert got == sorted([("a.csv", 2, 1, 2, "number", "x"), ("a.csv", 3, 2, None, "fields", "2"),
                          ("b.csv", 1, 3, None, "fields", "1"), ("b.csv", 3, 5, 2, "number", ""),
                          ("b.csv", 4, 6, None, "fields", "4")], key=str)
    kept = {r["row_idx"]: r["features"] for r in rows.collect()}
    assert sorted(kept) == list(range(8))            # every line, so that labels still fit
    assert kept[0] == [1, 2, 3] and kept[1] == [1, None, 3] and kept[2] is None and kept[4] == [4, 50, -6]
    assert kept[5][:2] == [7, None] and kept[5][2] != kept[5][2]


def test_strict_reading_still_fails(spark, folder):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_feature_csv(spark, folder).collect()


def test_no_lines(spark):
    d = tempfile.mkdtemp(prefix="csv-empty-")
    open(os.path.join(d, "a.csv"), "w").close()
    rows, rejects = read_feature_csv_lenient(spark, d, 3)
    assert rows.collect() == [] and rejects.collect() == []
