import pytest
from pyspark.sql import functions as F

from quirefold.functions import document as doc
from quirefold.functions import scalars as sc

NUMBERS = {"1234": 1234, "1,234,567": 1234567, "1234,56": 1234.56, "1,234.56": 1234.56, "1.234,56": 1234.56, "45.3%": 45.3, "-123": -123, "(456)": -456, "1.5 million": 1.5e6, "2.3 billion": 2.3e9, "5k": 5000, "$1,234.56": 1234.56, "€500": 500, "4102m": None, "": None, "  ": None, "words": None, "1_000": None, "1d": None, "inf": None, "3 bln": 3e9}
DATES = {"2023-01-15": "2023-01-15", "2023/1/15": "2023-01-15", "15/01/2023": "2023-01-15", "January 15, 2023": "2023-01-15", "15 January 2023": "2023-01-15", "15 Sept 2023": "2023-09-15", "2023": "2023-01-01", "founded 475 BC": "475 BC", "": None, "soon": None, "13/14/2023": "2023-14-13", "01/25/2023": "2023-01-25"}


def evaluate(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["out"] for r in df.select("k", expression.alias("out")).orderBy("k").collect()]


def test_numbers(spark):
    assert evaluate(spark, [*NUMBERS, None], sc.parse_number("v")) == [*NUMBERS.values(), None]
    assert [doc.number(x) for x in NUMBERS] == list(NUMBERS.values())


def test_dates(spark):
    want = {k: v for k, v in DATES.items() if k != "13/14/2023"}
    assert evaluate(spark, list(want), sc.normalize_date("v")) == list(want.values())


@pytest.mark.parametrize(("value", "source", "target", "want"), [(1.0, "km", "m", 1000.0), (1.0, "miles", "km", 1.609344), (100.0, "hectares", "km2", 1.0), (1.0, "square miles", "km2", 2.58999), (1.0, "kg", "g", 1000.0), (1.0, "kg", "km", None), (7.0, "odd", "odd", 7.0)])
def test_units(spark, value, source, target, want):
    got = spark.range(1).select(sc.normalize_unit(F.lit(value), F.lit(source), F.lit(target)).alias("x")).first()["x"]
    assert got == (want if want is None else pytest.approx(want))


def test_labels(spark):
    labels = ["Maximum depth: Blue Basin (m)", "Maximum depth (m)", "Maximum depth", "(m)"]
    assert evaluate(spark, labels, sc.field_id("v")) == ["maximum_depth"] * 3 + ["number"] == [doc.field_of(x) for x in labels]
    units = ["Area (sq km)", "Area (sq mile)", "Height in metres", "Founded (BC)", "People", "Length (m)", "Speed (km/h)"]
    assert evaluate(spark, units, sc.unit_of(F.col("v"))) == ["sq km", "sq miles", "m", "year_bc", "", "m", "km/h"] == [doc.unit_in(x) for x in units]
    assert evaluate(spark, ["Peak: Mount A (m)", "Peak", "Share: 12.5 percent"], sc.subject_of(F.col("v"))) == ["Mount A", "", ""]
    assert evaluate(spark, ["  The  Base. ", "A,B;:"], sc.entity_name("v")) == ["The Base", "A,B"]


def test_card_values(spark):
    df = spark.createDataFrame([("15", "Visitors (million)"), ("475", "Founded (BC)"), ("<12", "Days")], "raw string, label string")
    assert [r[0] for r in df.select(sc.card_value(F.col("raw"), F.col("label"))).collect()] == [15e6, -475.0, 12.0]


def test_sentences_and_pages(spark):
    text = "[Page 3]\nOne here. Two there!\n\nThree\n[Page 4]\nFour?"
    assert evaluate(spark, [text], sc.sentences("v")) == [["One here.", "Two there!", "Three", "Four?"]]
    assert evaluate(spark, [text], sc.page_at(F.col("v"), F.lit(20))) == [3]
    assert evaluate(spark, [text], sc.page_at(F.col("v"), F.lit(2))) == [None]


def test_json_span(spark):
    assert evaluate(spark, ['```json\n{"a":1}\n```', 'so: {"b":[2]} ok', "none", None], sc.json_span(F.col("v"))) == ['{"a":1}', '{"b":[2]}', None, None]


def test_terciles_and_confidence(spark):
    assert evaluate(spark, [1, 3, 4, 9, 20], sc.tercile(F.col("v"), F.lit(9)), "int") == [0, 0, 1, 2, 2]
    assert evaluate(spark, [None, -1.0, 0.3, 7.0], sc.bounded_confidence(F.col("v")), "double") == [0.5, 0.0, 0.3, 1.0]


def test_extracted_values_and_canonical_fields(spark):
    rows = [("15 million visitors", "number", "15", "", ""), ("built in 475 BC", "date", None, "", ""), ("about 4102 m deep", "number", None, "m", "m"), ("12 km", "number", None, "km", "m"), ("15 January 2023", "date", None, "", ""), ("no figure", "number", "7", "", ""), ("plain", "text", None, "", "")]
    df = spark.createDataFrame(rows, "raw string, kind string, provided string, unit string, target string")
    got = [r[0] for r in df.select(sc.extracted_value(*(F.col(c) for c in df.columns))).collect()]
    assert got == ["15000000", "475 BC", "4102", "12000", "2023-01-15", "7", "plain"]
    names = spark.createDataFrame([("Length & Width (m)",), ("  Total  area ",)], "n string")
    assert [r[0] for r in names.select(sc.canonical_field("n", {"total_area": "area"})).collect()] == ["length_and_width_m", "area"]
