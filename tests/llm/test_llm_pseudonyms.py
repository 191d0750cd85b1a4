import re

from pyspark.sql import functions as F

from reviewlake.llm import pseudonyms, queries

CARD, OTHER = "4845168114407329", "4929348385146306"
IBAN = "DE89370400440532013000"


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (d > "4") for i, d in enumerate(reversed(digits))) % 10 == 0


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return [(r.text, list(r.private)) for r in pseudonyms.pseudonymized(docs).orderBy("doc_id").collect()]


def test_formats_and_validity(spark):
    values = ["jo.12@mail3.example.com", "+1 (743) 555-3824", CARD, "4845 1681 1440 7329", "097-21-1120", "161.17.88.162",
              "2001-02-28", "28/02/2001", "28.02.2001", "12/25/1999", IBAN, "DE89 3704 0044 0532 0130 00"]
    kinds = ["email", "phone", "card", "card", "ssn", "ip", "date", "date", "date", "date", "iban", "iban"]
    rows = run(spark, [f"see {v}, and {v}." for v in values])
    got = []
    for (text, private), value, kind in zip(rows, values, kinds):
        assert private == [kind, kind], value
        match = re.fullmatch(r"see (.+), and (.+)\.", text)
        assert match[1] == match[2] != value
        got.append(match[1])
        if kind != "ip":
            shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", s)))
            assert shape(match[1]) == shape(value)
    assert luhn(got[2]) and got[3].replace(" ", "") == got[2]
    assert all(0 <= int(o) <= 255 for o in got[5].split("."))
    assert got[7].split("/")[::-1] == got[6].split("-") == got[8].split(".")[::-1]
    assert got[10] == got[11].replace(" ", "") and got[10][:2] == "DE"
    number = "".join(str(int(c, 36)) for c in got[10][4:] + got[10][:4])
    assert int(number) % 97 == 1


def test_invalid_values_stay(spark):
    texts = ["4845168114407328 is no card", "000-12-3456 and 666-12-3456", "999.1.1.1 or 1.2.3", "2001-02-30", "DE88370400440532013000",
             "call 555-3824", "a@b", "x = 12345678901234567890123", "0000000000000000"]
    assert run(spark, texts) == [(t, []) for t in texts]


def test_neighbours_are_both_found(spark):
    (text, private), = run(spark, [f"7536784127813051 {CARD} {OTHER}"])
    assert private == ["card", "card"] and text.startswith("7536784127813051 ") and CARD not in text


def test_numbers_are_permuted(spark):
    """The Feistel network is a permutation of its whole range."""
    n = spark.range(60).select(pseudonyms.permuted_number(F.col("id"), F.lit("k"), (6, 10)).alias("p"))
    assert sorted(r.p for r in n.collect()) == list(range(60))
    days = spark.range(73049).select(pseudonyms.permuted_number(F.col("id"), F.lit("k"), pseudonyms._DAYS).alias("p"))
    assert days.distinct().count() == 73049
    text = spark.range(1000).select(pseudonyms.permuted_text(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("k")).alias("p"))
    assert text.distinct().count() == 1000
    other = spark.range(1000).select(pseudonyms.permuted_text(F.lpad(F.col("id").cast("string"), 3, "0"), F.lit("l")).alias("p"))
    assert [r.p for r in other.collect()] != [r.p for r in text.collect()]


def test_query(spark, sf_dir, documents):
    rows = queries.QUERIES["op4_pseudonyms"](spark, sf_dir).collect()
    texts, linked = {d[0]: d[1] for d in documents}, {}
    find = re.compile(r"[\w.]+@[\w.]+\w|\+\d \(\d+\) \d+-\d+|(?<!\d)\d{16}(?!\d)|(?<![\d.])\d+\.\d+\.\d+\.\d+")
    assert len(rows) == len(texts) and any(r.n_private for r in rows)
    for r in rows:
        old, new = find.findall(texts[r.doc_id]), find.findall(r.text)
        assert len(old) == len(new) and find.sub("", r.text) == find.sub("", texts[r.doc_id])
        private = [v for v in old if not re.fullmatch(r"\d{16}", v) or luhn(v)]
        assert r.n_private == len(private)
        for a, b in zip(old, new):
            assert (a != b) == (a in private)
            assert linked.setdefault(a, b) == b


def test_edge_rows(edge, nothing):
    rows = pseudonyms.pseudonymized(edge).collect()
    assert sorted(map(str, (r.text for r in rows))) == sorted(str(r.text) for r in edge.collect())
    assert all(list(r.private) == [] for r in rows) and rows[0].ids == "y"
    assert pseudonyms.pseudonymized(nothing).count() == 0
