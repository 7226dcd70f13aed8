"""Tables that repeat whole rows."""

from ledgerlens.llm import quality_classifier


def test_rows_that_repeat_reach_the_driver_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k, ("good river " if k % 2 else "BAD CLICK ") * (20 + k)) for k in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, quality int")
    found, collect = [], type(docs).collect

    def counted(df):
        found.append(collect(df))
        return found[-1]

    monkeypatch.setattr(type(docs), "collect", counted)
    model = quality_classifier.fit(docs, labels)
    n = max(map(len, found))
    found.clear()
    assert quality_classifier.fit(docs.unionByName(docs).unionByName(docs), labels) == model
    assert max(map(len, found)) == n
