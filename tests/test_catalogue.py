"""Sheets of many layouts in one scan against reading every sheet by its own layout."""

import pytest

from stubble.sources.sheets import LAYOUT, Sheet, read_catalogue, read_sheet
from tests.compare import plan_of

COLUMNS = {"Sample": "string", "Mass": "double", "Strip": "int", "Year of harvest": "int"}
# key, header, first, last, separator, missing, places, titles, kinds
LAYOUTS = [
    ("1999", 1, None, None, ",", ["na", "-99999"], {}, {"Sample": "Barcode", "Mass": "Mass (g)", "Strip": "Strip"}, {}),
    ("2000", 3, 5, 6, "|", ["-1"], {"Sample": 3, "Mass": 1}, {"Strip": "Strip...4"}, {"Strip": "int", "Mass": "double"}),
    ("2001", None, None, None, "\t", None, {"Mass": 2, "Sample": 1, "Year of harvest": 3}, {}, {"Mass": "int"}),
    ("2002", 1, None, None, ",", [], {"Sample": 1}, {}, {}),
]
FILES = {
    "sheet 1999.csv": '﻿Barcode,Strip,Mass (g)\na1,3,1.5\n"a,2",x,na\n,,\n a3 ,4,-99999\n',
    "sheet 1999 b.csv": "Mass (g),Strip,Barcode,more\n7,1,b1,\n",
    "old 2000.txt": "title||\n|\nMass|odd|Sample|Strip|Strip\n1|2|3|4|5\n2.5|o|s1|9|8\n-1|o|s2|9.5|8\n3|o|s3|1|1\n",
    "2001.tsv": "t1\t5\t2001\nt2\t5.5\t\nt3\t\tx\n",
    "2002.csv": "Barcode\n",
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in FILES.items():
        (tmp_path / "in" / name).write_text(text, encoding="utf-8")
    return tmp_path / "in"


def read(spark, folder, layouts=LAYOUTS, columns=COLUMNS):
    return read_catalogue(spark, str(folder), spark.createDataFrame(layouts, LAYOUT), columns, r"/[^/]*?(\d{4})[^/]*$", "Year", 6)


def test_positions_titles_sentinels_and_kinds_are_those_of_the_sheet(spark, folder):
    got = sorted(map(tuple, read(spark, folder).collect()), key=str)
    assert got == sorted(
        [
            (1999, "a1", 1.5, 3, None),
            (1999, "a,2", None, None, None),
            (1999, " a3 ", None, 4, None),
            (1999, "b1", 7.0, 1, None),
            (2000, "s1", 2.5, 9, None),
            (2000, "s2", None, None, None),
            (2001, "t1", 5.0, None, 2001),
            (2001, "t2", None, None, None),
            (2001, "t3", None, None, None),
        ],
        key=str,
    )


def test_equals_the_reader_of_one_layout(spark, folder):
    spec = Sheet(header=1, types=["string", "int", "double"], missing=["na", "-99999"])
    one = read_sheet(spark, str(folder / "sheet 1999.csv"), spec).select("Barcode", "Mass (g)", "Strip")
    many = read(spark, folder / "sheet 1999.csv", LAYOUTS[:1]).select("Sample", "Mass", "Strip")
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)


def test_layouts_are_no_part_of_the_plan(spark, folder):
    more = [(str(y), 1, None, None, ",", [], {"Sample": 1}, {}, {}) for y in range(3000, 3400)]
    small, large = (plan_of(read(spark, folder, LAYOUTS + extra)) for extra in ([], more))
    assert abs(len(small) - len(large)) < 200
    assert large.count("FileScan") == small.count("FileScan")


def test_what_does_not_fit_raises(spark, folder):
    with pytest.raises(ValueError, match="without a layout"):
        read(spark, folder, LAYOUTS[1:])
    with pytest.raises(ValueError, match="more than one layout"):
        read(spark, folder, [*LAYOUTS, LAYOUTS[0]])
    wrong = (*LAYOUTS[3][:7], {"Mass": "Weight"}, {})
    with pytest.raises(ValueError, match="Weight"):
        read(spark, folder, [*LAYOUTS[:3], wrong])
    seps = [(f"9{i}", 1, None, None, c, [], {}, {}, {}) for i, c in enumerate(",;|:~^!#@")]
    with pytest.raises(ValueError, match="separators"):
        read(spark, folder, seps)


def test_day_numbers(spark, tmp_path):
    (tmp_path / "s 1999.csv").write_text("id,day\na,36525.4\nb,x\n")
    layout = ("1999", 1, None, None, ",", [], {}, {"Sample": "id", "Day": "day"}, {"Day": "serial"})
    got = read(spark, tmp_path, [layout], {"Sample": "string", "Day": "date"}).collect()
    assert {r["Sample"]: str(r["Day"]) for r in got} == {"a": "2000-01-02", "b": "None"}
