import base64
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from versetime.llm.language import identify, train
from versetime.llm.queries import LANGUAGES

SF = "/root/testdata/sf0.01"
FOREIGN = {
    "it": "La biblioteca della città conserva molti libri antichi e gli studenti vengono qui ogni giorno per leggere e scrivere le loro ricerche.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są oni obdarzeni rozumem i sumieniem.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "junk": base64.b64encode(random.Random(1).randbytes(200)).decode(),
}
NEAR = "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros."


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_foreign_and_junk_texts_go_and_clean_ones_stay(spark, docs):
    added = spark.createDataFrame([(-1 - k, t, "en", "src1") for k, t in enumerate(FOREIGN.values())], "doc_id long, text string, lang string, source string")
    rows = docs.select("doc_id", "text", "lang", "source").unionByName(added)
    kept = {r.doc_id for r in P.language_id(spark, rows, SF).select("doc_id").collect()}
    assert not any(k < 0 for k in kept)
    clean = {r.doc_id for r in docs.where(F.col("lang").isin(LANGUAGES) & (F.length("text") > 60)).collect()}
    assert len(clean - kept) <= 0.005 * len(clean)


def test_foreign_declarations_and_suffixes_count_for_unknown(spark, docs):
    own = docs.select("doc_id", "text", F.col("lang").alias("declared"), F.lit("a.example.org").alias("host"))
    odd = [(-1, NEAR, None, "x.example.com"), (-2, NEAR, "pt", "x.example.com"), (-3, NEAR, None, "x.example.pt"), (-4, docs.where("lang = 'en' and length(text) > 200").first().text, "pt", "x.example.pt")]
    rows = own.unionByName(spark.createDataFrame(odd, own.schema))
    found = identify(rows, train(docs, LANGUAGES), text=F.col("text"), declared=F.col("declared"), host=F.col("host"), keep=["doc_id"])
    by = {r.doc_id: r for r in found.where("doc_id < 0").collect()}
    score = lambda r: r.posterior if r.language == "und" else -r.posterior
    assert score(by[-2]) >= score(by[-1]) and score(by[-3]) >= score(by[-1]) and by[-3].suffix_language == "pt"
    assert not by[-2].accepted and by[-4].accepted and by[-4].language == "en"
