"""The pipeline's stages against plain versions of what they have to keep."""

from collections import Counter

import corpus_pipeline
from latticework.llm import language, mixing, neardup, secrets
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("size", F.lit("own")).withColumn("score", F.lit(1)).cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near duplicates", "secrets", "mixing", "packing"]

    known = stages["language"](spark, docs, DATA)
    told = language.predict(docs.drop("score"), language.fit(docs))
    want = {r["doc_id"] for r in told.collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    assert known.columns == docs.columns and {r["doc_id"] for r in known.collect()} == want

    unique = stages["near duplicates"](spark, docs, DATA)
    kept = {r["doc_id"] for r in neardup.near_duplicates(docs).collect() if r["kept"]}
    assert unique.columns == docs.columns and Counter(r["doc_id"] for r in unique.collect()) == Counter(kept)

    clean = stages["secrets"](spark, docs, DATA)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"]) and not [s for s in secrets.find(r["text"]) if s[0] in ("access", "hex")]

    mix = stages["mixing"](spark, docs, DATA)
    times = Counter(r["doc_id"] for r in mix.collect())
    rows = mixing.takes(docs.drop("size")).collect()
    assert mix.columns == docs.columns
    assert {r["doc_id"]: (2 * r["taken"] + r["size"]) // (2 * r["size"]) for r in rows if r["size"] and 2 * r["taken"] >= r["size"]} == dict(times)

    packed = stages["packing"](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_whole_run_and_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "word one two three four", "en", "a", 23), (3, "word one two three four", "en", "a", 23), (4, "und das ist ein text " * 50, "de", None, 1050)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {3, 4} and got


def test_stages_on_an_empty_table_and_clashing_names(spark):
    """Each stage keeps the columns that it gets, whatever they are called, and an empty table gives an empty one."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    for i, name in enumerate(("__row", "__key", "__own", "__position", "__times", "row", "key", "taken", "positions", "lang_pred", "found")):
        docs = docs.withColumn(name, F.lit(i))
    docs = docs.cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns and all(r["__row"] == 0 and r["__own"] == 2 and r["taken"] == 7 for r in got.collect()), name
        assert stage(spark, docs.limit(0), DATA).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DATA).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() >= 60
