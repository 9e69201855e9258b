import itertools
import math

import pytest

from quillspark.operators import units as U


@pytest.mark.parametrize("text, field, kind, value", [
    ("1.519,00 milliers d'euros", "amount", "currency:EUR", 1519000), ("€0.00834m", "amount", "currency:EUR", 8340), ("$5'724k", "amount", "currency:USD", 5724000),
    ("2.501E+7 EUR", "amount", "currency:EUR", 25010000), ("8 MMAD", "amount", "currency:MAD", 8e6), ("12 min", "duration", "day", 12 / 1440), ("9 years and 3 months", "duration", "month", 111),
    ("2 y 4 m", "duration", "month", 28), ("3 h 30 m", "duration", "day", 3.5 / 24), ("3 km 200 m", "measure", "length", 3200), ("12 m2", "measure", "area", 12), ("12.5 m³", "measure", "volume", 12.5),
    ("fourteen litres", "measure", "volume", 0.014), ("5 MPa", "measure", "pressure", 5e6), ("-40 °F", "measure", "temperature", 233.15), ("9 ‰", "rate", "ratio", 0.009), ("5 in", "measure", "length", 0.127),
    ("1 in²", "measure", "area", 0.0254**2), ("5 m", "measure", "length", 5), ("3 quarters", "duration", "month", 9), ("2 GWh", "measure", "energy", 7.2e12),
])
def test_quantities(text, field, kind, value):
    got = U.parse_quantity(text, field)
    assert got and got[0] == kind and math.isclose(got[1], value, rel_tol=1e-6)


@pytest.mark.parametrize("text", [None, "", "  ", "soon", "12", "12 bananas", "ref DOC-12-3", "x" * 5000])
def test_no_quantity(text):
    assert U.parse_quantity(text, "measure") is None


@pytest.mark.parametrize("text, value", [("1,250,000", 1250000), ("1.250,50", 1250.5), ("1 250,50", 1250.5), ("0,014", 0.014), ("1,519", 1519), ("2.0890", 2.089), ("12'345.6", 12345.6), ("1e3", 1000)])
def test_numbers(text, value):
    assert U.parse_number(text) == value


def test_notes_name_units():
    assert U.unit_in("(figures in kEUR)", "amount") == "kEUR" and U.unit_in("montants en millions d'euros", "amount") == "millions d'euros" and U.unit_in("hello", "amount") is None and U.unit_in(None) is None


def test_table_with_clashing_names(spark):
    df = spark.createDataFrame([("12", "[unit: m]", "a", 1), (None, None, "b", 2), ("5 kg", None, "c", 3)], "raw string, note string, kind string, q_text int")
    out = {r.q_text: (r.kind, r.value) for r in U.with_quantity(df, "raw", "measure", "note").collect()}
    assert out == {1: ("length", 12.0), 2: (None, None), 3: ("mass", 5.0)}
    assert U.with_quantity(df.where("false"), "raw", "measure").count() == 0


def test_pairs_against_brute_force(spark):
    import random

    r = random.Random(5)
    items = [("s", f"i{k:03d}", r.choice(["mass", "temperature"]), r.choice([0.0, 1.0, -1.0, 300.0]) * (1 + r.random() * 0.02)) for k in range(150)]
    df = spark.createDataFrame([*items, ("s", "n", None, None), *items[:5]], "scope string, item string, kind string, value double")
    got = {(x.left_key, x.right_key) for x in U.agreeing_pairs(df).collect()}

    def near(a, b):
        return a[2] == b[2] and (abs(a[3] - b[3]) <= 0.5 if a[2] == "temperature" else abs(a[3] - b[3]) <= 0.005 * max(abs(a[3]), abs(b[3])))

    want = {(a[1], b[1]) for a, b in itertools.combinations(items, 2) if near(a, b)}
    # temperatures on either side of zero kelvin don't occur
    assert got == want


def test_unit_notes(spark):
    df = spark.createDataFrame([("e", "Penalty: 112 000 (figures in MAD) and 5 [unit: kg]"), ("f", None)], "evidence_id string, content string")
    assert {(r.number, r.note) for r in U.unit_notes(df, "evidence_id", "content").collect()} == {("112 000", "figures in MAD"), ("5", "unit: kg")}
