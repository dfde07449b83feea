"""Readers of delimited exports, and writers whose files they read back."""

import datetime as dt

from cyclora.sources import readers as R
from cyclora.sources import writers as W

DAY = dt.date(2014, 3, 10)


def put(tmp_path, name, *lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_raw_posts(spark, tmp_path):
    path = put(tmp_path, "20140310-01.txt", "x\tid\tdate\tx\tx\tx\tuser\ttext", "-\t7\t2014-03-10\t-\t-\t-\tjan\tmore\tover 3 weken", "-\t8\t2014-03-11\t-\t-\t-\tpiet\tRT hallo", "-\t9\tno date\t-\t-\t-\tx\ty", "short")
    assert [tuple(r) for r in R.raw_texts(spark, path).orderBy("id").collect()] == [("7", DAY, "jan", "over 3 weken"), ("8", DAY + dt.timedelta(days=1), "piet", "RT hallo")]
    assert [r["id"] for r in R.raw_texts(spark, path, retweets=False).collect()] == ["7"]
    assert {r["day"] for r in R.day_files(spark, path).collect()} == {"20140310-01"}
    assert {r["day"] for r in R.day_files(spark, path, hourly=True).collect()} == {"20140310-"}


def test_model_posts_in_three_layouts(spark, tmp_path):
    wide = ["0", "11", "2", "3", "an", "5", "6", "2014-03-10", "8", "9", "een tekst", "2014-03-14 2014-03-15", "a|b", "komende vrijdag"]
    dated = ["12", "bo", "2014-03-10", "t", "2014-03-14", "c1|c2", "e1 | e2", "de,LID | hond,N", "over 4 dagen", "breda, --"]
    phrased = ["13", "cy", "2014-03-10", "t", "overmorgen", "2014-03-12", "c", "--", "hond,N"]
    dropped = [*wide[:13], "12/5"]
    path = put(tmp_path, "model.txt", *["\t".join(x) for x in (wide, dated, phrased, dropped)], "only\tthree\tcells")
    got = {r["id"]: r for r in R.model_texts(spark, path).collect()}
    assert set(got) == {"11", "12", "13"}
    assert got["11"]["refdates"] == [dt.date(2014, 3, 14), dt.date(2014, 3, 15)] and got["11"]["chunks"] == ["a", "b"] and got["11"]["entities"] == []
    assert got["12"]["entities"] == ["e1", "e2"] and got["12"]["cities"] == ["breda"] and [tuple(t) for t in got["12"]["postags"]] == [("de", "LID"), ("hond", "N")]
    assert got["13"]["phrase"] == "overmorgen" and got["13"]["refdates"] == [dt.date(2014, 3, 12)] and got["13"]["entities"] == []


def test_model_posts_round_trip(spark, tmp_path):
    schema = "id string, user string, date date, text string, refdates array<date>, chunks array<string>, entities array<string>, postags array<struct<word:string,tag:string>>, phrase string, cities array<string>"
    row = ("1", "jan", DAY, "een tekst", [DAY], ["a b", "c"], ["e"], [("w", "N")], "morgen", ["breda"])
    W.model_texts(spark.createDataFrame([row], schema), str(tmp_path / "m"))
    back = R.model_texts(spark, str(tmp_path / "m")).select("id", "user", "date", "text", "refdates", "chunks", "entities", "postags", "phrase", "cities").first()
    assert tuple(back)[:7] == row[:7] and back["phrase"] == "morgen" and back["cities"] == ["breda"] and tuple(back["postags"][0]) == ("w", "N")
    W.date_texts(spark.createDataFrame([row], schema), str(tmp_path / "d"))
    W.date_texts(spark.createDataFrame([row], schema), str(tmp_path / "d"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "d")).collect()] == ["1\tjan\t2014-03-10\teen tekst\t2014-03-10\ta b|c\tmorgen"] * 2


def test_event_lines_round_trip(spark, tmp_path):
    schema = "date date, score double, terms array<string>, text_ids array<string>, texts array<string>, lemmas array<string>"
    rows = [(DAY, 9.1, ["a", "b c"], ["1", "2"], ["x", "y\tz"], ["l"]), (DAY, 10.2, ["d"], ["3"], ["w"], [])]
    events = spark.createDataFrame(rows, schema)
    W.event_lines(events, str(tmp_path / "e"))
    got = R.event_lines(spark, str(tmp_path / "e")).collect()
    assert sorted((r["score"], r["terms"], r["text_ids"], r["texts"]) for r in got) == [(9.1, ["a", "b c"], ["1", "2"], ["x", "y z"]), (10.2, ["d"], ["3"], ["w"])]
    W.lemma_lines(events, str(tmp_path / "l"))
    assert sorted(r["lemmas"] for r in R.event_lines(spark, str(tmp_path / "l")).collect()) == [[], ["l"]]
    W.term_scores(events, str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["a\t9.1", "d\t10.2"]
    W.event_blocks(events.selectExpr("*", "if(score > 10, 0.2, 0.5) as ratio"), str(tmp_path / "b"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "b")).collect()] == ["", "2014-03-10\t9.1\ta, b c", "x", "y\tz"]
    W.posts_by_day(events, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("date = '2014-03-10'").count() == 2


def test_periodics_report(spark, tmp_path):
    days = [dt.date(y, 5, 5) for y in (2010, 2011, 2012)]
    found = spark.createDataFrame([("t", "<e,5,v,5,v,v>", 1.0, 1.0, 1.0, 1, days)], "term string, pattern string, score double, coverage double, consistency double, step int, dates array<date>")
    W.periodics(found, str(tmp_path / "c"))
    r = R.periodic_report(spark, str(tmp_path / "c")).first()
    assert (r["pattern"], r["score"], r["terms"], r["dates"]) == ("<e,5,v,5,v,v>", 1.0, ["t"], days)
    gaps = spark.createDataFrame([("t", 12.5, days, [365, 366])], "term string, score double, dates array<date>, intervals array<int>")
    W.periodics(gaps, str(tmp_path / "s"), calendar=False)
    r = R.periodic_report(spark, str(tmp_path / "s")).first()
    assert (r["pattern"], r["score"], r["terms"], r["dates"]) == (None, 12.5, ["t"], days)
    W.predictions(found, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1


def test_predictions_as_lines(spark, tmp_path):
    schema = "terms array<string>, pattern string, first date, date date, step int, score double, coverage double, consistency double"
    W.prediction_lines(spark.createDataFrame([(["b", "a c"], "<e,5,v,5,v,v>", DAY, DAY + dt.timedelta(days=300), 1, 0.5, 0.25, 1.0)], schema), str(tmp_path / "p"))
    assert [tuple(r) for r in R.predictions(spark, str(tmp_path / "p")).collect()] == [(["a c", "b"], "<e,5,v,5,v,v>", DAY + dt.timedelta(days=300), 0.5, 0.25, 1.0)]
    path = put(tmp_path, "stdev.txt", "a\t7-7\t[datetime.datetime(2014, 3, 3, 0, 0), datetime.datetime(2014, 3, 10, 0, 0), 7, 2.5]", "no prediction")
    assert [tuple(r) for r in R.predictions(spark, path).collect()] == [(["a"], "7-7", DAY, 2.5, None, None)]


def test_posts_of_days(spark, tmp_path):
    put(tmp_path, "20140310-00.txt", "1\tjan\t2014-03-10\teen tekst\t2014-03-14\tc\te\tde,LID\tvrijdag\tbreda")
    put(tmp_path, "20140310-01.txt", "2\tbo\t2014-03-10\tt\t2014-03-15", "short")
    got = R.day_posts(spark, str(tmp_path), hourly=True).orderBy("id").collect()
    assert [(r["day"], r["id"], r["text"]) for r in got] == [("20140310-", "1", "een tekst"), ("20140310-", "2", "t")]


def test_small_readers(spark, tmp_path):
    path = put(tmp_path, "3_grams.txt", "de rode hond\t1\t4\t0.25")
    assert tuple(R.ngram_commonness(spark, path).first()) == ("de rode hond", 1, 4, 0.25)
    path = put(tmp_path, "wiki.json", '{"text": "x", "annotations": [{"surface_form": "A"}]}', '{"text": "y"}')
    assert [(r["text"], r["anchors"]) for r in R.wiki_pages(spark, path).orderBy("text").collect()] == [("x", ["A"]), ("y", [])]
    (tmp_path / "cities.txt").write_bytes("Breda\n ’s-Hé \n\nbreda\n".replace("’", "'").encode("iso-8859-1"))
    assert sorted(r["name"] for r in R.names(spark, str(tmp_path / "cities.txt"), "iso-8859-1").collect()) == ["'s-hé", "breda"]
    tag = '<TIMEX3 type="DATE" value="2014-03-12">x</TIMEX3>'
    path = put(tmp_path, "tagged_20140310.txt", "0\tnot yet", "#tweet_id\ttext", f"1\tin {tag}", "one column", '<TIMEX3 tid="t1">2</TIMEX3>\tplain', "</TimeML>", "3\ttoo late")
    assert [tuple(r) for r in R.tagged_posts(spark, path).collect()] == [(DAY, "1", f"in {tag}"), (DAY, "2", "plain")]
    path = put(tmp_path, "judged.tsv", "terms\tassessment\tscore", "a, b\t1.0\t0.5", "c\t0\tx")
    got = R.assessments(spark, path, {"terms": 0, "assessment": 1, "score": 2}).collect()
    assert [(r["terms"], r["correct"], r["score"]) for r in got] == [(["a", "b"], 1, 0.5), (["c"], 0, None)]
    path = put(tmp_path, "gold.tsv", "1\ttext\ta, #b, c", "2\ttext\tx")
    assert {r["id"]: r["entities"] for r in R.entity_file(spark, path, 0, 2, ",", "x").collect()} == {"1": ["a", "c"], "2": []}
    path = put(tmp_path, "tags.tsv", "1\tmorgen,2014-03-11", "2")
    assert [tuple(r) for r in R.time_tags(spark, path).collect()] == [("1", "morgen")]
    path = put(tmp_path, "wide.tsv", "\t".join(["x"] * 12 + ["a b|c"]), "x\ty")
    assert [r["chunk"] for r in R.wide_chunks(spark, path).collect()] == ["a b", "c"]
    path = put(tmp_path, "gaps.tsv", "t\t-\t7, 7, 14", "u\t-\t3")
    assert [(r["term"], r["intervals"]) for r in R.interval_file(spark, path).collect()] == [("t", [7, 7, 14])]


def test_small_writers(spark, tmp_path):
    members = spark.createDataFrame([(1, 5, DAY, ["a", "b"]), (1, 6, DAY + dt.timedelta(days=9), ["c"])], "grp int, id int, date date, entities array<string>")
    W.clusters(members, str(tmp_path / "g"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "g")).collect()] == ["5|2014-03-10|a, b\t6|2014-03-19|c"]
    index = spark.createDataFrame([("hond", [(DAY, 3), (DAY, 4)])], "term string, postings array<struct<date:date,id:int>>")
    W.inverted_index(index, str(tmp_path / "i"))
    assert spark.read.text(str(tmp_path / "i")).first()[0] == "hond\t2014-03-10,3|2014-03-10,4"
    W.ngrams(spark.createDataFrame([("a b", 2, 1)], "ngram string, n int, k int"), str(tmp_path / "n"))
    assert (tmp_path / "n" / "n=2").is_dir()
    W.chunks(spark.createDataFrame([("a",)], "chunk string"), str(tmp_path / "k"))
    W.report(spark.createDataFrame([("a", 1)], "x string, y int"), str(tmp_path / "r"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "r")).columns == ["x", "y"]
    W.allocation(spark.createDataFrame([(1, 2)], "id int, set int"), str(tmp_path / "a"))
    assert (tmp_path / "a" / "set=2").is_dir()
    W.token_labels(spark.createDataFrame([(["de", "hond"], ["O", "B-ORG"])], "tokens array<string>, labels array<string>"), str(tmp_path / "o"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "o")).collect()] == ["de O", "hond B-ORG", ""]


def test_surveys(spark, tmp_path):
    path = put(tmp_path, "export.csv", "h", "h", ",".join(["m"] * 11 + ["0", "1", "2", "free text", "", "3", "1"]))
    got = [(r["pos"], r["vote"]) for r in R.survey_export(spark, path).collect()]
    assert got == [(0, "2"), (1, ""), (2, "3")]
    path = put(tmp_path, "survey.txt", "intro", "[[Question:MC:SingleAnswer]]", "<b>een</b> en <b>twee</b>", "[[Question:MC]]", "<b>drie</b>")
    assert [r["parts"] for r in R.survey_questions(spark, path).orderBy("pos").collect()] == [["een", "twee"], ["drie"]]
