"""The overlay views keep the whole texts of the tables they are laid over."""

from lexmill.plans import registry


def test_turns_are_whole(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(200)) + "\nand a last line"
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t} {long} end") for c in range(16) for t in range(4)] + [(16, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    text = {c * 1000 + t: x for c, t, _, x in rows}
    asked = {r["query_id"]: r["question"] for r in registry.view(spark, str(tmp_path), "questions_view").collect()}
    assert {k for k in asked if k >= 0} == {c * 1000 + t for c, t, role, _ in rows if role == "user"}
    assert all(q.endswith(text[k] or "") for k, q in asked.items() if k >= 0) and "hello!" in asked.values()
    answers = registry.view(spark, str(tmp_path), "answers_view").collect()
    assert {r["query_id"] for r in answers} == {c * 1000 + t for c, t, role, _ in rows if role == "assistant"}
    assert all(f'"{text[r["query_id"]]}' in r["answer"] and r["context"] == text[r["query_id"]] for r in answers)
