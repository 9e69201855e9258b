import random
import re

from pyspark.sql import functions as F

from quillspark.functions import extract as X
from quillspark.functions import text as T

ODD = [None, "", "  ", "Ab  C d", "🚚📦 livré ✅", "résiliation 12", "a\n\n b \n \nc"]


def col(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.select(make(F.col("t")).alias("x"), "i").orderBy("i").collect()]


def test_normalised_and_trigrams(spark):
    assert col(spark, ODD, T.normalized) == [None, "", "", "ab c d", "🚚📦 livré ✅", "résiliation 12", "a b c"]
    grams = col(spark, ["ab", "abab", "🚚📦x", None, ""], T.trigrams)
    assert grams == [["ab"], ["aba", "bab"], ["🚚📦x"], None, []]


def test_tokens_split_at_accents(spark):
    assert col(spark, ["Résiliation 12-A"], T.tokens) == [["r", "siliation", "12", "a"]]
    assert col(spark, ["(Not, yet!) --"], T.clause_tokens) == [["not", "yet", "--"]]


def test_paragraphs_and_sentences(spark):
    assert col(spark, ODD, T.paragraphs)[-1] == ["a", "b", "c"]
    assert col(spark, [None, "  "], T.paragraphs) == [None, ["  "]]
    assert col(spark, ["One. Two; three\nfour"], T.sentences) == [["One.", "Two;", "three", "four"]]


def test_section_hints(spark):
    texts = ["# Payment terms\nx", "ARTICLE", "Article 4 due", "Short title\nbody", "no: colon\nbody", "plain", None, ""]
    assert col(spark, texts, T.section_hint) == ["Payment terms", "ARTICLE", "Article 4 due", "Short title", None, None, None, None]


def test_category_precedence(spark):
    assert col(spark, ["Liability cap on termination", "notice", "pay 12 eur", "on 2026-01-02", "hello"], T.category) == ["liability", "termination", "payment", "effective_date", "general"]


def test_fields(spark):
    text = "Livraison prévue le 2026-03-25. Révision REF-ABC123.\nMontant: EUR 1 250,50 et $99.99. Date alternative 25/03/2026."
    f = col(spark, [text], X.fields)[0]
    assert {"2026-03-25", "25/03/2026"} <= set(f.dates) and {"1250.50", "99.99"} <= set(f.amounts) and "REF-ABC123" in f.reference_codes


def test_amount_quirks(spark):
    assert col(spark, ["1200 EUR", "2026-03-25", "1,250,000 USD", None], X.amounts) == [["0", "120"], ["202", "25", "3", "6"], [], None]
    assert col(spark, ["reference document review idea"], X.codes) == [["DOCUMENT", "IDEA", "REFERENCE", "REVIEW"]]


def test_references_as_python_finds_them(spark):
    texts = ["ref ABC-1, refusé, référence: X9", "version 2.1 revision#7", "", None]
    pattern = re.compile(X.REFERENCE.replace("(?i)", ""), re.I)
    want = [[m[0].strip() for m in pattern.finditer(t)] if t is not None else None for t in texts]
    got = col(spark, texts, lambda c: X.references(c)["raw"])
    assert got == want


def test_facts_rules(spark):
    texts = ["The invoice of 1200 EUR is due", "Liability is capped at 50,000 EUR", "Either party may terminate", "The supplier must deliver", None, "  ", "2 days, 2  days; notice within 2 DAYS"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: {(f.field_type, f.category) for f in r.facts} for r in X.with_facts(rows, "t").collect()}
    assert ("amount", "payment") in got[0] and ("amount", "liability") in got[1]
    assert got[2] == {("termination_clause", "termination")} and got[3] == {("clause_text", "general")} and not got[4] and not got[5]
    assert got[6] == {("duration", "termination")} and [len(r.facts) for r in X.with_facts(rows.where("i = 6"), "t").collect()] == [1]
    wanted = {r.i: [f.field_type for f in r.facts] for r in X.with_facts(rows, "t", wanted="termination").collect()}
    assert wanted[0] == ["amount"] and wanted[2] == ["termination_clause"] and wanted[3] == ["clause_text"]


def test_facts_keep_other_columns(spark):
    df = spark.createDataFrame([("x", "pay 12 eur", 1), (None, None, 2)], "facts string, t string, c0 int")
    out = X.with_facts(df, "t")
    assert out.columns == ["t", "c0", "facts"] and {r.c0: len(r.facts) for r in out.collect()} == {1: 1, 2: 0}


def test_facts_of_any_text(spark):
    r = random.Random(4)
    parts = ["12", "3.5", " EUR", "€ ", "2024-01-02", " 3 mai 2020", "ref ", "A1", "RÉFÉRENCE: X", "\n", ". ", "; ", "days", " notice", " court", "cap ", "NDA", "shall ", "é", "\u00a0", " 14 jours"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(200)]
    rows = X.with_facts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t").collect()
    flat = lambda t: " ".join(t.lower().split())
    for row in rows:
        keys = [(f.field_type, f.normalized_value, f.category) for f in row.facts]
        assert len(keys) == len(set(keys)) and all(f.raw_value and f.raw_value in row.t for f in row.facts)
        assert all(f.normalized_value == flat(f.raw_value) for f in row.facts if f.field_type != "amount")
        order = [X.TYPES.index(k[0]) for k in keys]
        assert order == sorted(order) and ("clause_text" not in [k[0] for k in keys] or len(keys) == 1)
    assert sum(len(r.facts) for r in rows) > 200
