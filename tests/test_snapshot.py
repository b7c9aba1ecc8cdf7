"""Published builds: the latest counts, broken and bad ones are not seen, reports come from the write."""

import pytest
from pyspark.sql import functions as F

from lexmill import schemas
from lexmill.operators import quality as A
from lexmill.sources import io, snapshot


def build(spark, n, junk=0):
    text = "The harbour master shall post the order for one day. " * 4
    rows = [(i, f"b{i % 2}", "Book", 1, None, "Part I", None, [str(i % 3)], "T", [], "article", text if i >= junk else "x", "y") for i in range(n)]
    pages = spark.createDataFrame([(f"b{i % 2}", i, i % 5 != 0) for i in range(2 * n)], "book_file string, pdf_page int, kept boolean")
    return spark.createDataFrame(rows, schemas.CHUNK), pages


def test_readers_see_whole_builds_only(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "corpus")
    with pytest.raises(FileNotFoundError):
        snapshot.current(spark, root)
    chunks, pages = build(spark, 10)
    first = snapshot.publish(chunks, pages, root, "model", 8)
    assert first["version"] == 1 and first["quality"] == A.quality_report(chunks).first().asDict()
    assert {b["file"]: (b["pages"], b["pages_dropped"], b["chunks"]) for b in first["books"]} == {"b0": (10, 2, 5), "b1": (10, 2, 5)}
    more, pages = build(spark, 20)
    with monkeypatch.context() as m:
        m.setattr(io, "write_article_index", lambda *a: (_ for _ in ()).throw(RuntimeError("power cut")))
        with pytest.raises(RuntimeError):
            snapshot.publish(more, pages, root)
    with pytest.raises(ValueError, match="look like headers or junk"):
        snapshot.publish(build(spark, 10, junk=3)[0], pages, root)
    assert snapshot.current(spark, root) == first and snapshot.chunks_of(spark, root).count() == 10
    second = snapshot.publish(more, pages, root)
    assert second["version"] == 2 and second["embedding_model"] is None and snapshot.chunks_of(spark, root).count() == 20
    assert snapshot.articles_of(spark, root).where("article = '1'").agg(F.count("*")).first()[0] == 7
