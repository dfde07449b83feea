"""Column functions over texts, names and markup."""

import datetime as dt
import itertools

from pyspark.sql import functions as F

from cyclora.functions import linking as L
from cyclora.functions import markup as M
from cyclora.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'date' if isinstance(v, dt.date) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="Naar #Feest met @Jan_1, zie http://a.b/c?d=1 (z'n één)!") == ["naar", "#feest", "met", "@jan_1", ",", "zie", "http://a.b/c?d=1", "(", "z'n", "één", ")", "!"]
    assert one(spark, T.tokens(F.col("t")), t=None) == [] == one(spark, T.tokens(F.col("t")), t="")
    assert one(spark, T.hashtags(T.tokens(F.col("t"))), t="#A # b #c") == ["#a", "#c"]


def test_ngrams(spark):
    for n in range(8):
        words = [f"w{k}" for k in range(n)]
        want = [" ".join(words[i : i + k]) for k in range(1, 6) for i in range(n - k + 1)]
        assert sorted(one(spark, T.ngrams(F.col("w")), w=words)) == sorted(want)


def test_linkable(spark):
    ok = {"ga": False, "gast": True, "ga mee": True, "~x": False, "2nd": False, "2 x": True, "huis": True}
    rows = spark.createDataFrame([(k,) for k in ok], "g string").select("g", T.linkable(F.col("g")).alias("x")).collect()
    assert {r["g"]: r["x"] for r in rows} == ok


def test_masks_and_filters(spark):
    assert one(spark, T.mask_urls(F.col("t")), t=" kijk  http://x https://y\tnu ") == "kijk URL URL nu"
    assert one(spark, T.is_retweet(F.col("t")), t="RT @a: x") and not one(spark, T.is_retweet(F.col("t")), t="rt START") and not one(spark, T.is_retweet(F.col("t")), t=None)
    assert one(spark, T.type_token_ratio(F.col("t")), t="De de hond DE") == 0.5
    assert one(spark, T.type_token_ratio(F.col("t")), t=" ") is None


def test_chunks_are_cleaned(spark):
    got = one(spark, T.clean_chunks(F.col("t")), t="Feest!!!  op 5 mei met @jan bij http://x.y/z  en zo. #12maart a,b")
    assert got == ["feest op", "met", "bij", "en zo", "a,b"]


def test_wiki_forms(spark):
    assert one(spark, T.wiki_text(F.col("t")), t='De "Hond" (dier), zie: hier.') == "de hond dier , zie : hier ."
    assert one(spark, T.wiki_anchor(F.col("t")), t=' St. {"A"}:b, ') == "st {a}b"


def test_overlap_is_resolved(spark):
    entities = [("koningsdag", 0.5), ("koningsdag utrecht", 0.5), ("#utrecht", 0.9), ("den_haag", 0.1), ("haag", 0.05), ("vrijmarkt", 0.05)]
    rows = spark.createDataFrame([(entities,), ([],)], "e array<struct<term:string,score:double>>").select(F.transform(T.resolve_overlap(F.col("e")), lambda e: e["term"]).alias("x")).collect()
    assert rows[0]["x"] == ["#utrecht", "koningsdag", "den_haag", "vrijmarkt"] and rows[1]["x"] == []
    for permuted in itertools.islice(itertools.permutations(entities), 0, 720, 97):
        again = spark.createDataFrame([(list(permuted),)], "e array<struct<term:string,score:double>>").select(F.transform(T.resolve_overlap(F.col("e")), lambda e: e["term"]).alias("x")).first()
        assert again["x"] == rows[0]["x"]


def test_names_are_whole_words_and_longest_first(spark):
    pattern = L.gazetteer(["Den Haag", "Haag", "ee (f.)", " ", "Utrecht"])
    chunks = ["van den haag naar Utrecht", "utrechts plein in haag", "ee (f.) x"]
    assert one(spark, L.names_in(F.col("c"), pattern), c=chunks) == ["den haag", "utrecht", "haag", "ee (f.)"]
    assert one(spark, L.cut_names(F.col("c"), pattern), c=chunks) == ["van", "naar", "utrechts plein in", "x"]
    assert one(spark, L.names_in(F.col("c"), L.gazetteer([])), c=chunks) == []


def test_taggers_are_plugged_in(spark):
    tagger = lambda texts: [[(w, "WW(x)" if w == "loopt" else "ADJ(y)" if w == "mooi" else "LID(z)") for w in t.split()] for t in texts]
    rows = spark.createDataFrame([("de hond loopt mooi",), (None,)], "t string")
    got = rows.select(L.content_words(L.tagged(F.col("t"), tagger)).alias("a"), L.content_words(L.tagged(F.col("t"), tagger), True).alias("b"), F.size(L.tagged(F.col("t"))).alias("n")).collect()
    assert [w["word"] for w in got[0]["a"]] == ["loopt", "mooi"] and [w["word"] for w in got[0]["b"]] == ["loopt"]
    assert got[0]["n"] == 4 and got[1]["a"] == [] and got[1]["n"] == 0
    assert one(spark, L.lemmas(F.col("t"), lambda ws: [w[:3] for w in ws]), t=["mooie honden", "straat"]) == ["moo", "hon", "str"]
    assert one(spark, L.lemmas(F.col("t")), t=["mooie honden", "straat"]) == ["mooie", "honden", "straat"]


def test_time_tags(spark):
    text = 'a <TIMEX3 tid="1" type="DATE" value="2014-03-12">x</TIMEX3> <TIMEX3 type="DATE" value="2014-03-01">y</TIMEX3> <TIMEX3 type="TIME" value="2014-03-12TEV">z</TIMEX3> <TIMEX3 type="SET" value="2014-W10">s</TIMEX3> <TIMEX3 type="DATE" value="2015-01-01">morgen</TIMEX3> <TIMEX3 type="DATE" value="P1D">q</TIMEX3>'
    got = lambda lax: [t["phrase"] for t in one(spark, M.future_timexes(M.timexes(F.col("t")), F.col("d"), lax), t=text, d=dt.date(2014, 3, 10))]
    assert got(False) == ["x", "z"] and got(True) == ["x", "z", "s"]
    assert one(spark, M.timexes(F.col("t")), t=None) == []


def test_labels_of_tokens(spark):
    tokens, entities = "ik zie de rode hond en de rode hond hier".split(), ["rode hond", "hier", "hond"]
    assert one(spark, M.labelled(F.col("t"), F.col("e")), t=tokens, e=entities) == ["O", "O", "O", "B-ORG", "B-ORG", "O", "O", "B-ORG", "B-ORG", "B-ORG"]
    assert one(spark, M.labelled(F.col("t"), F.col("e")), t=tokens, e=["rode hond"])[3:5] == ["B-ORG", "I-ORG"]
    assert one(spark, M.bold(F.col("h")), h="<b>Een</b> x <B>twee<br />") == ["Een", "twee"]


def test_phrases_meet(spark):
    rows = spark.createDataFrame([("rode hond", "hond zwart", "een hond zwart en rode hond"), ("a b", "ab", "ab a b"), ("x", "y", "x")], "a string, b string, t string")
    got = rows.select(T.shares_word(F.col("a"), F.col("b")), T.positions_before(F.col("t"), F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, None)]
