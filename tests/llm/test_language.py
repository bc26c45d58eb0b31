from pyspark.sql import functions as F

from versetime.llm.language import identify, train
from versetime.llm.queries import LANGUAGES, op6_language_id

SF = "/root/testdata/sf0.01"


def found(rows, model, **more):
    return identify(rows, model, text=F.col("text"), declared=more.get("declared", F.lit(None).cast("string")), host=more.get("host", F.lit(None).cast("string")), keep=["doc_id", "lang"])


def test_held_out_accuracy_by_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang").isin(LANGUAGES))
    held = F.pmod(F.xxhash64("text"), F.lit(3)) == 0
    rows = found(docs.where(held & (F.length("text") > 60)), train(docs.where(~held), LANGUAGES)).collect()
    assert len(rows) > 100 and sum(r.language == r.lang for r in rows) >= 0.93 * len(rows)


def test_evidence_decides_where_texts_do_not(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs, LANGUAGES)
    own = docs.where("lang in ('en', 'de') and length(text) > 100").select("doc_id", "text", "lang", F.concat("lang", F.lit(".example.org")).alias("host"))
    short = spark.createDataFrame([(-1, "ok", "?", "de.example.org"), (-2, "ok", "?", "en.example.org"), (-3, "ok", "?", "x.example.es")], own.schema)
    by = {r.doc_id: r for r in found(own.unionByName(short), model, host=F.col("host"), declared=F.when(F.col("doc_id") > 0, F.col("lang"))).collect()}
    assert (by[-1].language, by[-2].language) == ("de", "en") and by[-3].suffix_language == "es"


def test_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs, LANGUAGES)
    df = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34 !", None), (4, "x " * 400_000, "xx"), (None, "the house of the people", None), (5, "a", "de"), (5, "a", "de")], "doc_id long, text string, lang string")
    rows = found(df.withColumns({"language": F.lit(1), "posterior": F.lit("p")}), model, declared=F.col("lang")).collect()
    assert len(rows) == 7 and {r.doc_id for r in rows if not r.accepted} >= {1, 2, 3}
    assert all((r.language, r.posterior) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 3))
    assert found(df.limit(0), model).count() == 0
    assert found(df, train(docs.limit(0), LANGUAGES)).count() == 7


def test_query_covers_all_pages(spark):
    rows = op6_language_id(spark, SF).collect()
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert len(rows) == pages and sum(r.accepted for r in rows) > 0.8 * pages
