from pyspark.sql import functions as F

from quillspark.llm import scans

COUNTS = {"the": 900, "invoice": 300, "contract": 200, "each": 500, "pump": 100, "records": 80, "cross": 60, "border": 60, "cross-border": 50, "delivery": 90, "is": 400, "late": 100, "under": 120, "clause": 150, "company": 40}


def test_misread_words():
    w = scans.Words(COUNTS)
    assert w.repaired("invoicc") == "invoice" and w.repaired("Cach") == "Each" and w.repaired("cach") == "each" and w.repaired("c0mpany,") == "company,"
    assert w.repaired("3O84") == "3084" and w.repaired("l37") == "137" and w.repaired("REF-CRW6BNY") is None and w.repaired("invoice") is None and w.repaired("12l") is None


def test_divided_words():
    w = scans.Words(COUNTS)
    assert w.divided("con", "tract") and not w.divided("cross", "border") and not w.divided("DOC", "12345") and not w.divided("Lentz", "Maier")


def test_page_numbers():
    values = {"- 3 -": 3, "Page 4 of 12": 4, "Paqe l of 6": 1, "[17]": 17, "iv": 4, "2/9": 2, "p. 8": 8, "P age l9 of l9": 19}
    assert {k: scans.page_value(k)[0] for k in values} == values
    assert scans.page_value("clause 4") is None and scans.page_value("mild") is None and scans.page_value("") is None


def documents(spark):
    el = lambda i, c, label="text": (i, label, c)
    pages = [
        [el(0, "Nordwerk Ltd – notice REF-12"), el(1, "The invoicc records each con-"), el(2, "1")],
        [el(0, "Nordwerk Ltd – notlce REF-12"), el(1, "tract. Each pump is late under\nthe clause."), el(2, "Lot\n4\nItem\n7"), el(3, None), el(4, "2")],
        [el(0, "Nordwerk Ltd – notice REF-12"), el(1, "The delivery is late."), el(2, "3")],
    ]
    md = "\n\n".join(c for p in pages for _, _, c in p if c is not None)
    rows = [("a", md, pages), ("a", md, pages), ("b", None, None), ("c", "", []), ("d", "Each pump is late.\n\n- 1 -", None)]
    return spark.createDataFrame(rows, "id string, md_results string, layout_details array<array<struct<index:int,label:string,content:string>>>")


def test_noisy_lines(spark):
    got = {tuple(r) for r in scans.noisy_lines(documents(spark), COUNTS).distinct().collect()}
    want = {("l:a:p1:e0", "header", 1), ("l:a:p2:e0", "header", 1), ("l:a:p3:e0", "header", 1), ("l:a:p1:e2", "page_no", 1), ("l:a:p2:e4", "page_no", 1), ("l:a:p3:e2", "page_no", 1), ("l:a:p1:e1", "misread", 1), ("l:a:p1:e1", "hyphen", 1)}
    assert {x for x in got if x[0].startswith("l:")} == want
    assert ("m:a", "hyphen", 3) in got and ("m:a", "page_no", 5) in got and ("m:d", "page_no", 3) in got
    assert scans.noisy_lines(documents(spark).where("false"), COUNTS).count() == 0


def test_repaired(spark):
    texts = {r.item_key: r.repaired for r in scans.repaired_texts(documents(spark), COUNTS).collect()}
    assert texts["m:a"].split("\n\n")[0] == "The invoice records each contract. Each pump is late under the clause."
    assert "Nordwerk" not in texts["m:a"] and texts["m:d"] == "Each pump is late." and texts["m:c"] == "" and "m:b" not in texts


def test_vocabulary_counts_all(spark):
    df = spark.createDataFrame([("The pump con-\ntract the pump",), ("the cross-border pump",), (None,)], "t string")
    assert scans.vocabulary(df, "t", 3) == {"the": 3, "pump": 3}
    assert scans.vocabulary(df.where(F.lit(False)), "t") == {}


def test_exact_counts_decide(spark):
    """In 20 million words, what is rare is neither read as unknown nor lost as a true word."""
    counts = spark.createDataFrame([("the", 20_000_000), ("invoice", 14), ("invoicc", 13), ("contract", 8), ("dredger", 1), ("dre-dger", 2)], "word string, n long")
    text = "The invoicc of each contracf is late under the con-\ntract of the dre-\ndger."
    df = spark.createDataFrame([("a", text, None)], "id string, md_results string, layout_details array<array<struct<index:int,label:string,content:string>>>")
    found = {tuple(r) for r in scans.noisy_lines(df, counts).collect()}
    assert found == {("m:a", "misread", 1), ("m:a", "hyphen", 1)}
    assert scans.repaired_texts(df, counts).first().repaired == "The invoicc of each contract is late under the contract of the dre-dger."


def test_answers_equal_a_dictionary(spark):
    counts = COUNTS | {"contracf": 2, "invoicc": 3, "cach": 30, "ill": 5, "pumq": 4, "deliverv": 1}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    words = ["invoicc", "contracf", "cach", "c0mpany", "c0mpanv", "pumq", "deliverv", "rccords", "clausc", "recorcls", "ill", "oil", "border", "uncler", "zzz"]
    pairs = [(a, b) for a in ("con", "cross", "inv", "Lentz", "each", "pump", "rcc") for b in ("tract", "border", "oicc", "is", "late", "ords")]
    asked, plain = scans.Asked(), scans.Words(counts)
    for w in words:
        asked.true_word(w)
    for a, b in pairs:
        asked.divided(a, b)
    got = scans.answers(spark.createDataFrame([(x,) for x in asked.new], "ask string"), table)
    assert {w: got.true_word(w) for w in words} == {w: plain.true_word(w) for w in words} and got.true_word("c0mpanv") is None
    assert {p: got.divided(*p) for p in pairs} == {p: plain.divided(*p) for p in pairs}
    assert got.known("ill") and not got.known("oil")


def test_layout_elements_are_repaired(spark):
    df = documents(spark)
    df = df.unionByName(df.where("id = 'a'").limit(1).withColumn("id", F.lit("e")).withColumn("md_results", F.lit(None).cast("string")))
    rows = {r.item_key: (r.original, r.repaired) for r in scans.repaired_texts(df, COUNTS).collect()}
    for i in "ae":
        assert rows[f"l:{i}:p1:e1"] == ("The invoicc records each con-", "The invoice records each contract.")
        assert rows[f"l:{i}:p2:e1"][1] == "Each pump is late under the clause." and rows[f"l:{i}:p3:e1"][1] == "The delivery is late."
        assert rows[f"l:{i}:p2:e0"][1] == rows[f"l:{i}:p3:e2"][1] == "" and f"l:{i}:p2:e3" not in rows
    assert "m:e" not in rows and "m:a" in rows
