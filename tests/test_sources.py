import json

import pytest
from pyspark.sql import functions as F

from trialweave.session import scratch_path, shared_dir
from trialweave.sources import corpus, datasets, studies

SENTENCE = (
    "sentence_id bigint, studyNCTid string, criteria_type string, text string, "
    "entities array<struct<entity_group:string,word:string,start:int,end:int,confidence_score:double>>"
)


def test_studies_csv(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text(
        'StudyNCTid,Other,EligibilityCriteria\nN1,x,"Inclusion Criteria:\n\n* says ""hi"", ok"\nN2,y,\nN1,z,"* é"\n', encoding="utf-8"
    )
    got = rows(studies.read_studies(spark, str(tmp_path / "a.csv")), "study_row")
    assert [r[1:] for r in got] == [("N1", 'Inclusion Criteria:\n\n* says "hi", ok'), ("N2", None), ("N1", "* é")]
    (tmp_path / "b.csv").write_text("StudyNCTid,Text\nN1,x\n")
    assert studies.read_studies(spark, str(tmp_path / "b.csv")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        studies.read_studies(spark, str(tmp_path / "none.csv"))


def test_study_rows_follow_the_files(spark, tmp_path, rows):
    """The largest file is packed first by Spark; numbers follow the paths."""
    sizes = {"a": 2, "b": 5000, "c": 50}
    for name, n in sizes.items():
        body = "".join(f'{name}{i},"* {i}\n* x"\n' for i in range(n))
        (tmp_path / f"{name}.csv").write_text("StudyNCTid,EligibilityCriteria\n" + body)
    got = rows(studies.read_studies(spark, str(tmp_path)).select("study_row", "StudyNCTid"), "study_row")
    assert got == list(enumerate(f"{name}{i}" for name, n in sizes.items() for i in range(n)))


def test_corpus_folder_partitioned_by_key(spark, tmp_path, rows):
    df = spark.createDataFrame([("N1_inc", "a\nb"), ("N2", "c")], "file string, text string")
    df.write.partitionBy("file").text(str(tmp_path / "p"))
    assert rows(corpus.read_corpus(spark, str(tmp_path / "p")), "file") == [("N1_inc", "a\nb\n"), ("N2", "c\n")]


def test_corpus_folder(spark, tmp_path, rows):
    (tmp_path / "N1_inc.txt").write_bytes("a é\r\nb\rc".encode())
    (tmp_path / "N2_exc.txt").write_text("alone\n")
    (tmp_path / "N1_inc.ann").write_text("T1\tDrug 0 1\ta\n\n  R1\tAND Arg1:T1 Arg2:T1\t\n")
    assert rows(corpus.read_corpus(spark, str(tmp_path)), "file") == [("N1_inc", "a é\nb\nc"), ("N2_exc", "alone\n")]
    assert rows(corpus.read_annotations(spark, str(tmp_path)), "ann_line") == [
        ("N1_inc", 0, "T1\tDrug 0 1\ta"),
        ("N1_inc", 2, "R1\tAND Arg1:T1 Arg2:T1"),
    ]


def test_jsonl_and_csv_round_trip(spark, tmp_path):
    data = [
        (0, "N1", "inclusion", 'two\nlines, "quoted"', [("Drug", "two", 0, 3, 0.5), ("Value", "l", 4, 5, 1.0)]),
        (1, None, None, "plain", []),
    ]
    df = spark.createDataFrame(data, SENTENCE)
    datasets.write_jsonl(df, str(tmp_path / "j"))
    lines = [json.loads(x) for p in (tmp_path / "j").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(lines[0]) == ["criteria_type", "entities", "sentence_id", "studyNCTid", "text"]
    back = studies.read_sentences(spark, str(tmp_path / "j"), "json").select(df.columns)
    assert sorted(back.collect()) == sorted(df.collect())
    datasets.write_csv(df, str(tmp_path / "c"))
    again = studies.read_sentences(spark, str(tmp_path / "c")).select(df.columns)
    assert sorted(again.collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        datasets.write_csv(df, str(tmp_path / "c"))


def test_csv_entity_literals_with_single_quotes(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "nct_id,text,entities\nN1,ab,\"[{'entity_group': 'Drug', 'word': 'ab', 'start': 0, 'end': 2, 'confidence_score': 0.5}]\"\n"
    )
    r = studies.read_sentences(spark, str(tmp_path / "s.csv")).first()
    assert r.studyNCTid == "N1" and tuple(r.entities[0]) == ("Drug", "ab", 0, 2, 0.5)


def entity(word, score=0.5):
    return {"entity_group": "Drug", "word": word, "start": 0, "end": 2, "confidence_score": score}


@pytest.mark.parametrize("word", ["a\xa0b", "it's", 'say "x"', "None", "True story", "a\\x41", "tab\t", "\u2028", "both ' and \""])
def test_python_literals_keep_their_values(spark, word):
    cells = [(repr([entity(word)]),), (json.dumps([entity(word)]),)]
    df = spark.createDataFrame(cells, "c string").select(studies.parse_entities(F.col("c")).alias("e"))
    assert [r.e[0].word for r in df.collect()] == [word, word]


def test_empty_and_broken_entity_cells(spark):
    parse = lambda *cells: [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(studies.parse_entities(F.col("c"))).collect()]
    assert parse(repr([entity("a", None)]))[0][0].confidence_score is None
    assert parse("", None, "[]") == [None, None, []]
    for broken in ("[{'word': }]", "not a list", "[{'word': 'a'"):
        with pytest.raises(Exception, match="(?i)entities|malformed"):
            parse(broken)


def test_splits_prune_to_their_folder(spark, tmp_path):
    df = spark.createDataFrame([(i, "x", s) for i, s in enumerate(["train"] * 8 + ["test", "validation"])], "k int, label string, split string")
    path = str(tmp_path / "d")
    datasets.write_splits(df, path)
    one = datasets.read_split(spark, path, "test")
    assert one.count() == 1 and "labels" in one.columns and datasets.read_split(spark, path).count() == 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    with pytest.raises(ValueError):
        datasets.read_split(spark, path, "dev")


def test_label_map(spark, tmp_path, rows):
    path = str(tmp_path / "m")
    table = [(0, "O"), (1, "B-Non-query-able"), (2, "I-Non-query-able")]
    datasets.write_label_map(spark.createDataFrame(table, "id int, label string"), path)
    assert rows(datasets.read_label_map(spark, path), "id") == table
    text = json.loads(next((tmp_path / "m").glob("part-*")).read_text())
    assert text["id2label"]["1"] == "B-Non-query-able" and text["label2id"]["I-Non-query-able"] == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        datasets.read_label_map(spark, str(tmp_path / "none"))


class Cluster:
    """A session as a cluster presents it."""

    def __init__(self, conf, master="yarn"):
        self.conf, self.sparkContext, self.master, self.current = conf, self, master, None

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, path):
        self.current = path


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)
    named = Cluster({"spark.checkpoint.dir": "s3://bucket/cp"})
    assert scratch_path(named, "x").startswith("s3://bucket/cp/x-") and named.current == "s3://bucket/cp"
    with pytest.raises(RuntimeError):
        shared_dir(Cluster({}))
