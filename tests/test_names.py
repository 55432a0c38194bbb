from pyspark.sql import functions as F

from quarryline.functions import text as T
from quarryline.operators import fusion, names

NAMES = ["flask.app.Flask", "flask.app.Flask.add_url_rule", "app", "a_b", "x.a_bc", "_", "", "..", "Router.add_url", "de_doc_1", "de_doc_12", "src1.de_doc_1"]
ASKED = ["how does Flask.add_url_rule work in flask", "what is a_b", "add_url de_doc_1 and src1", "_ alone", "plain words", "x.a_bc", "no_such_name", "the of and", ""]


def test_indexes_give_the_scores_of_all_pairs(spark):
    rows = spark.createDataFrame(list(enumerate(NAMES)), "id long, name string")
    asked = fusion.query_features(spark.createDataFrame(list(enumerate(ASKED)), "qid long, query string"))
    pairs = asked.crossJoin(rows)
    for got, score in (
        (names.identifier_scores(asked, rows), T.identifier_score(F.col("identifiers"), F.col("name"))),
        (names.name_scores(asked, rows), T.name_score(F.col("tokens"), T.name_tokens(F.col("name")))),
        (names.entity_scores(asked, rows), T.entity_score(F.col("tokens"), F.col("name"))),
    ):
        want = {(r.qid, r.id, round(r.score, 9)) for r in pairs.select("qid", "id", score.alias("score")).where("score > 0").collect()}
        assert want and {(r.qid, r.id, round(r.score, 9)) for r in got.collect()} == want
