"""Scalar expressions on edge rows."""

import math

from pyspark.sql import functions as F

from stubble.functions import bits, measures, naming, text


def one(spark, schema, row, *exprs):
    return tuple(spark.createDataFrame([row], schema).select(*exprs).first())


def test_guarded_ratios(spark):
    rows = [(4.0, 2.0), (4.0, 0.0), (4.0, -1.0), (None, 2.0), (4.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = df.select(measures.guarded_ratio("a", "b"), measures.moisture_share("b", "a")).collect()
    assert [r[0] for r in got] == [2.0, None, None, None, None]
    assert [r[1] for r in got] == [-1.0, None, None, None, None]


def test_harvest_index_follows_float_division(spark):
    rows = [(2.0, 2.0), (0.0, 0.0), (3.0, -3.0), (-3.0, 3.0), (1.0, None)]
    df = spark.createDataFrame(rows, "g double, r double")
    got = [r[0] for r in df.select(measures.harvest_index("g", "r")).collect()]
    assert got == [0.5, None, math.inf, -math.inf, None]


def test_area_allocation(spark):
    rows = [(None, None), (1.0, None), (1.0, 2.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "b double, g double")
    grain, biomass = measures.allocate_area("b", "g", F.lit(2.4384))
    got = [tuple(r) for r in df.select(grain, biomass).collect()]
    assert got == [(None, None), (0.0, 2.4384), (0.0, 2.4384), (2.4384, 0.0)]


def test_masks_and_reconciling(spark):
    df = spark.createDataFrame([(0.0, 101.0, 5.0, None)], "a double, b double, c double, d double")
    got = df.select(
        measures.within("a", 0, 100),
        measures.within("b", 0, 100),
        measures.within("c", 0, 5),
        measures.zero_to_null("a"),
        measures.prefer("d", "c"),
        measures.mean_of_present("c", "b"),
        measures.mean_of_present("d", "b"),
        measures.positive("a"),
    ).first()
    assert tuple(got) == (None, None, 5.0, None, 5.0, 53.0, 101.0, None)


def test_half_even(spark):
    got = spark.range(1).select(measures.half_even(F.lit(6.25)), measures.half_even(F.lit(6.35))).first()
    assert tuple(got) == (6.2, 6.4)


def test_sample_ids_and_serials(spark):
    rows = [(2009, 7, "x"), (2010, 7, "x"), (2009, None, "x")]
    df = spark.createDataFrame(rows, "y int, p int, s string")
    assert [r[0] for r in df.select(measures.sample_id("y", "p", "s")).collect()] == ["2009_7", "x", None]
    dates = spark.range(1).select(measures.year_of_serial(F.lit(42005.9)), measures.date_of_serial(F.lit(0)))
    year, day = dates.first()
    assert (year, day.isoformat()) == (2015, "1900-01-01")


def test_text_functions(spark):
    row = ("CW_8_23-H_RES_RES", None)
    got = one(
        spark,
        "s string, n string",
        row,
        text.remove_first("s", "_RES"),
        text.replace_first("s", "CW", "D"),
        text.paste("n", "s", sep="-"),
        text.concat_or_null("n", "s"),
        text.short_year(F.lit(2007)),
    )
    assert got == ("CW_8_23-H_RES", "D_8_23-H_RES_RES", "NA-CW_8_23-H_RES_RES", None, "07")
    pieces = text.split_pieces(F.lit("a_b"), "_", ["x", "y", "z"])
    assert one(spark, "s string", ("",), *pieces.values()) == ("a", "b", None)
    surplus = text.split_pieces(F.lit("a|b|c"), "|", ["x"])
    assert one(spark, "s string", ("",), *surplus.values()) == ("a",)


def test_numbers_in_text(spark):
    rows = [("1.5",), ("lost",), (None,), ("NA",), ("-99999",), (" ",)]
    df = spark.createDataFrame(rows, "s string")
    cell = text.null_tokens("s", ["NA", -99999])
    got = [tuple(r) for r in df.select(text.number_in(cell), text.note_in(cell)).collect()]
    assert got == [(1.5, None), (None, "lost")] + [(None, None)] * 4
    notes = text.append_notes(("A note", F.lit("x"), " "), ("B note", F.lit(None).cast("string"), ""))
    assert one(spark, "s string", ("",), notes) == ("A note: x ",)


def test_bits(spark):
    got = one(
        spark,
        "b string, n string",
        ("000010", None),
        bits.set_bit("b", bits.OBSERVATION),
        bits.set_bit("n", bits.POINT),
        bits.set_bit(bits.set_bit("b", "000011"), "000100"),
        bits.any_bit("b"),
        bits.any_bit("n"),
        bits.append_phrase("n", F.lit("why")),
        bits.append_phrase(F.lit("a"), F.lit("b")),
        bits.append_phrase("n", "n"),
        bits.number_text(F.lit(None)),
    )
    assert got == ("000110", "000010", "000111", True, False, "why", "a; b", None, "nan")


def test_naming():
    assert naming.level_of("GrainCarbon_P2") == 2
    assert naming.level_of("GrainCarbon_P2_qcResult") == 2
    assert naming.level_of("GrainCarbon") is None
    assert naming.base_of("GrainCarbon_P2_qcPhrase") == "GrainCarbon"
    columns = ["ID2", "A_P1", "A_P1_qcApplied", "B"]
    assert naming.metric_columns(columns, ["ID2"]) == ["A_P1", "B"]
