"""Cleaning, segmentation and chunking: one case for each rule that is easy to get wrong."""


import pytest

from lexmill.operators import chunks as K
from lexmill.operators import pages as P
from lexmill.operators import quality as A
from lexmill.operators import segments as S
from lexmill.operators.retrieval import select_diverse

BOOKS = "file string, title string, kind string, include boolean, position int"


@pytest.fixture
def books(spark):
    return spark.createDataFrame([("b", "Book", "constitution", True, 0), ("c", "Notes", "commentary", True, 1), ("d", "Out", "commentary", False, 2)], BOOKS)


def pages(spark, *texts, book="b"):
    return spark.createDataFrame([(book, i + 1, t) for i, t in enumerate(texts)], "book_file string, pdf_page int, text string")


def test_clean_page_order_of_tests(spark):
    header = "THE CONSTITUTION OF INDIA (Part V.—The Union) 43"
    same = [f"{header}\nSame footer here {i}\n\nBody line {'x' * i}\n17\nmore\nmore\n{'abcd'[i] * 4}\n0\n{i + 5}" for i in range(4)]
    got = {r["pdf_page"]: r for r in P.clean_pages(pages(spark, *same)).collect()}
    assert got[1]["header_part"] == "Part V — The Union" and got[1]["printed_page"] == 5
    assert got[1]["text"] == "Body line\n17\nmore\nmore\naaaa"


def test_repeat_threshold_counts_all_pages(spark):
    rows = P.repeating_lines(pages(spark, *(["Footer 1\nabc"] * 3 + [None] * 9))).collect()
    assert [(r["key"], r["n_pages"]) for r in rows] == [("footer", 3)]
    assert P.repeating_lines(pages(spark, *(["Footer 1"] * 3 + ["z"] * 11))).count() == 0


def test_page_filter(spark):
    df = P.page_filter(spark.createDataFrame([("b", 1, "a" * 39), ("b", 2, "a" * 40), ("b", 3, "क" * 100 + "a" * 50)], "book_file string, pdf_page int, text string"))
    assert [r["kept"] for r in df.orderBy("pdf_page").collect()] == [False, True, False]


def clean(spark, *rows):
    return spark.createDataFrame([(b, p, pr, h, t) for b, p, pr, h, t in rows], "book_file string, pdf_page int, printed_page int, header_part string, text string")


def test_segmentation_carries_labels(spark, books):
    df = clean(
        spark,
        ("b", 1, 11, None, "preface text\nPART III"),
        ("b", 2, 12, None, "FUNDAMENTAL RIGHTS\nCHAPTER I. general things\n21. Life and liberty.—No person shall\n(1) be deprived"),
        ("b", 3, 13, "Part IV — Other", "continued text\n22. Arrest.—Something\nFIRST SCHEDULE of things\nrow"),
        ("b", 4, 14, None, "CONTENTS\n1. Name of it\n2. Second name\n3. Third name"),
        ("b", 5, 15, None, "after contents\nPART V Of Courts\n30. Next thing.—text"),
        ("c", 1, None, None, "PART I\n1. Not a marker.—text"),
        ("c", 2, None, None, "second page"),
    )
    got = [tuple(r) for r in S.segment(df, books).orderBy("book_file", "seg").select("book_file", "pdf_page", "part", "chapter", "article", "section_type", "text").collect()]
    assert got == [
        ("b", 1, None, None, None, "text", "preface text"),
        ("b", 2, "Part III — Fundamental Rights", "Chapter I — General Things", "21", "article", "21. Life and liberty.—No person shall\n(1) be deprived\ncontinued text"),
        ("b", 3, "Part IV — Other", "Chapter I — General Things", "22", "article", "22. Arrest.—Something"),
        ("b", 3, "First Schedule", None, None, "schedule", "FIRST SCHEDULE of things\nrow"),
        ("b", 4, "Part IV — Other", "Chapter I — General Things", None, "toc", "CONTENTS\n1. Name of it\n2. Second name\n3. Third name"),
        ("b", 4, "Part IV — Other", "Chapter I — General Things", None, "text", "after contents"),
        ("b", 5, "Part V — Of Courts", None, "30", "article", "30. Next thing.—text"),
        ("c", 1, None, None, None, "text", "PART I\n1. Not a marker.—text\nsecond page"),
    ]


def test_packing(spark):
    """Worked cases: filling up to 800 exactly, handing on after the first sentence end, pieces alone, windows."""
    from pyspark.sql import functions as F

    a, b, c = "a" * 400, "b" * 399, "c" * 400
    end = "x" * 700 + " first. Second. third"
    long = "".join(chr(97 + i % 26) for i in range(3000))
    cases = [
        ([a, b], [f"{a} {b}"]),
        ([a, c], [a, c]),
        ([" ", a, "\t", "", b, "d"], [f"{a} {b}", "d"]),
        ([end, "y" * 100], [end, "Second. third " + "y" * 100]),
        (["z" * 640 + ". " + "w" * 150, "v" * 300], ["z" * 640 + ". " + "w" * 150, "v" * 300]),
        (["q" * 790 + ".  ", "r" * 20], ["q" * 790 + ".", "r" * 20]),
        (["s" * 1800, "t"], ["s" * 1800, "t"]),
        ([long], [long[:800], long[650:1450], long[1300:]]),
        (["u" * 1801], ["u" * 800, "u" * 1151]),
        ([], []),
        (["  "], []),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p array<string>")
    got = {r["i"]: r["c"] for r in df.select("i", K.pack(F.col("p")).alias("c")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, i


def test_pieces_at_clauses_and_sentences(spark):
    from pyspark.sql import functions as F

    text = "x" * 100 + "\n(1) one " + "y" * 100 + "\n(a) two. Three; Four" + "z. Z" * 250
    got = spark.createDataFrame([(text,), ("short\ntext",)], "t string").select(K.pieces(F.col("t"))).collect()
    assert got[0][0][0] == "x" * 100 and got[0][0][1].startswith("(1) one") and got[0][0][2] == "(a) two." and got[0][0][3] == "Three;"
    assert got[1][0] == ["short\ntext"]


def test_build_dedupes_within_a_book_and_numbers(spark, books):
    body = "Some words of a page that are long enough to be kept by the filter, and then some more words to be quite sure of it. " * 2
    rows = [("b", 1, body + "one"), ("b", 2, body + "one"), ("c", 1, body + "one"), ("d", 1, body)]
    df = spark.createDataFrame(rows, "book_file string, pdf_page int, text string")
    got = K.build_chunks(df, books).orderBy("id").collect()
    assert [(r["id"], r["book_file"]) for r in got] == [(0, "b"), (1, "c")]
    assert got[0]["search_text"].startswith("Book\nSome words")


def test_number_chunks_is_dense(spark, books):
    df = spark.createDataFrame([("c", 5), ("b", 9), ("b", 2), ("c", 1)], "book_file string, k int")
    assert [tuple(r) for r in K.number_chunks(df, books, ["k"], 10).orderBy("id").select("id", "book_file", "k").collect()] == [(10, "b", 2), (11, "b", 9), (12, "c", 1), (13, "c", 5)]


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, article_numbers array<string>, section_type string")


def test_quality_and_keys(spark):
    df = chunk_rows(spark, [(0, "a" * 200, ["21"], "article"), (1, "short", [], "text"), (2, "short", [], "toc"), (3, "b" * 150, ["21", "32"], "article")])
    r = A.quality_report(df).first()
    assert (r["n_chunks"], r["n_junk"], r["tagged_pct"]) == (4, 1, 50.0)
    with pytest.raises(ValueError):
        A.require_quality(df)
    A.require_quality(df, 0.3)
    assert {r["article"]: r["ids"] for r in A.article_index(df).collect()} == {"21": [0, 3], "32": [3]}
    assert {r["article"]: r["status"] for r in A.key_check(df).collect()} == {"21": "OK", "32": "OK", "21A": "MISSING", "14": "MISSING", "368": "MISSING"}
    empty = df.limit(0)
    assert A.quality_report(empty).first()["n_chunks"] == 0
    A.require_quality(empty)


def test_selection_rules(spark):
    text = lambda *w: [ord(c) for c in w]
    rows = {  # chunk: (pinned, section_type, n_chars, words), in order
        0: [(1, True, "article", 100, text("a", "b")), (2, True, "article", 100, text("a", "b")), (3, False, "text", 100, text("a", "b")), (4, False, "text", 99999, text("z")), (5, False, "text", 10, text("c")), (6, False, "toc", 10, text("d")), (7, False, "text", 10, text("e")), (1, False, "article", 100, text("a", "b"))],
        1: [(i, False, "text", 1, [i]) for i in range(20)],
        2: [(i, True, "text", 1, text("q")) for i in range(9)],
    }
    pins = [(q, r[0], k) for q, rs in rows.items() for k, r in enumerate(rs) if r[1]]
    ranked = [(q, r[0], 0.5, k) for q, rs in rows.items() for k, r in enumerate(rs) if not r[1]]
    words = {(q, r[0]): (100 * q + r[0], r[4], r[2], r[3]) for q, rs in rows.items() for r in rs}
    pins = spark.createDataFrame([(q, 100 * q + c, k) for q, c, k in pins], "query_id long, chunk_id long, place int")
    ranked = spark.createDataFrame([(q, 100 * q + c, s, k) for q, c, s, k in ranked], "query_id long, chunk_id long, score double, rank int")
    found = select_diverse(pins, ranked, spark.createDataFrame(list(words.values()), "chunk_id long, text_set array<long>, section_type string, n_chars int"))
    got = {q: [r["chunk_id"] % 100 for r in sorted(found.where(f"query_id = {q}").collect(), key=lambda r: r["n"])] for q in rows}
    assert got == {0: [1, 2, 5, 7], 1: list(range(7)), 2: list(range(9))}
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and found.where("pinned").count() == 11
