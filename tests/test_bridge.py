from pyspark.sql import functions as F

from trialweave.plans import bridge

LONG = "Alpha 12 beta. Abcdefghij Alpha Alpha 7 x 12 Gamma!\n\nDelta  Delta 3."


def annotated(spark, tmp_path, docs):
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    return {r.file: r.ann_text for r in bridge.documents(spark, str(tmp_path)).collect()}


def test_annotations_are_made_in_batches(spark, tmp_path):
    """no nested lambdas over the words of a text."""
    got = annotated(spark, tmp_path, [(1, LONG, "en"), (2, None, "en"), (3, "a b", "fr"), (4, "Aa Bb", None), (5, "Aa", None)])
    assert sorted(got) == ["D1_inc", "D4"] and got["D4"] == "\n"
    plan = bridge.documents(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    text = spark.createDataFrame([(LONG,)], "t string").select(F.regexp_replace("t", "([.!?]) ", "$1\n")).first()[0]
    mentions = [line.split("\t") for line in got["D1_inc"].split("\n") if line.startswith("T")]
    assert [m[0] for m in mentions] == [f"T{i + 1}" for i in range(len(mentions))]
    # A word that repeats the one before it is no mention, and two-letter ones take the next word along.
    assert [m[2] for m in mentions] == ["Alpha", "12 beta.", "Abcdefghij", "Alpha", "7", "12 Gamma!", "Gamma", "Delta", "Delta", "3"]
    for _, meta, words in mentions:
        spans = [part.split(" ")[-2:] for part in meta.split(";")]
        assert " ".join(text[int(s) : int(e)] for s, e in spans) == words
