import corpus_pipeline


def test_each_group_gives_one_row_whatever_the_ids(spark):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(60))

    docs = spark.createDataFrame(
        [(None, ""), (None, text("a")), (None, text("a") + " more"), (1, text("a")), (None, text("b")), (None, text("b")),
         (2, text("a")), (2, text("c")), (3, text("d")), (3, text("d")), (4, text("c")), (None, None), (5, ""), (5, "")],
        "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    want = [(None, ""), (1, text("a")), (None, text("b")), (2, text("c")), (3, text("d")), (None, None), (5, ""), (5, "")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
