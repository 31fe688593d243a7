import os

from logtide.llm.common import clear_stages, drop_rows, mark_by_ids, pick, shared_root, stage


def test_stages_are_kept_apart_and_cleared(spark):
    table = stage(spark.range(5).toDF("x"), "t")
    root = f"{shared_root(spark)}/logtide/{spark.sparkContext.applicationId}".removeprefix("file:")
    assert table.count() == 5 and any(d.startswith("t-") for d in os.listdir(root))
    clear_stages(spark)
    assert not os.path.exists(root)


def test_pick_takes_exact_case_and_first(spark):
    df = spark.range(1).selectExpr("1 AS a", "2 AS b", "3 AS c").toDF("text", "Text", "text")
    assert pick(df, "text").first()[0] == 1


def test_drop_rows_is_exact_and_null_safe(spark):
    docs = spark.createDataFrame([(i if i else None, f"t{i}", "x") for i in range(3000)] + [(7, "again", "y")], "doc_id long, text string, Text string")
    gone = spark.createDataFrame([(i,) for i in range(1, 3000, 3)] + [(None,)], "doc_id long")
    out = drop_rows(docs, gone)
    assert out.columns == docs.columns
    assert sorted(r[0] for r in out.collect()) == [i for i in range(1, 3000) if i % 3 != 1]
    assert drop_rows(docs, gone.limit(0)).count() == 3001


def test_marks_lose_none_however_many_ids(spark):
    """More ids than the bitmap serves let more other rows through."""
    rows, ids = spark.range(6000).toDF("doc_id"), spark.range(0, 6000, 2).toDF("doc_id")
    for bits, most in ((27, 3300), (12, 6000)):
        marked = mark_by_ids(rows, ids, max_bits=bits)
        got = [r["doc_id"] for r in marked.filter("__maybe").collect()]
        assert marked.count() == 6000 and set(range(0, 6000, 2)) <= set(got) and len(got) <= most
    assert mark_by_ids(rows, ids.limit(0)).filter("__maybe").count() == 0
