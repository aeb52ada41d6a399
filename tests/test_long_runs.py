"""Runs of pieces longer than a task's stack."""

from folioflow.operators import quality

PIECES = "b c d f g h j k l m".split()


def long_run(n: int) -> str:
    return " ".join(PIECES[i % len(PIECES)] for i in range(n))


def test_a_long_run_of_pieces_does_not_exhaust_the_stack(spark):
    """Each piece took the pattern a few calls deeper: the error ended the executor, and Spark with it."""
    run = long_run(50_000)
    docs = spark.createDataFrame([(1, f"intro {run} fin"), (2, "b c"), (3, "x de b c d. b c d"), (4, f"{run}\n{run}")], "doc_id long, text string")
    found = {(r["doc_id"], r["start"], r["end"], r["excerpt"]) for r in quality.ocr_runs(docs, "doc_id").collect()}
    assert found == {(1, 6, 6 + len(run), run), (3, 12, 17, "b c d"), (4, 0, 2 * len(run) + 1, f"{run}\n{run}")}
