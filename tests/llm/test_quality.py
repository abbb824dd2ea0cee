import re
from collections import Counter

import duckdb

from ductwise.llm import quality, queries


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = list(zip(words, words[1:], words[2:]))
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_as_brute_force(documents, odd, none):
    for docs in (documents, odd):
        got = sorted((r["doc_id"], *(r[c] for c in quality.STATS)) for r in quality.judged(docs, sample_rows=20).select("doc_id", *quality.STATS).collect())
        assert got == sorted((r["doc_id"], *plain(r["text"])) for r in docs.collect())
    assert quality.judged(none).collect() == []


def test_same_as_sql(spark, documents):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op8_quality"]).df().sort_values("doc_id").values.tolist()
    got = queries.op8_quality(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", *quality.STATS, "base_failed", "kept"]
    assert got.orderBy("doc_id").toPandas().values.tolist() == want


def test_order_does_not_matter_and_clashes(spark, odd, documents):
    from pyspark.sql import functions as F

    one = quality.judged(documents, quality.RULES).select("doc_id", "kept").collect()
    two = quality.judged(documents, quality.RULES[::-1], sample_rows=1).select("doc_id", "kept").collect()
    assert sorted(one) == sorted(two)
    out = quality.judged(odd.withColumn("kept", F.lit("x")).withColumn("words", F.lit(1)))
    assert {r["kept"] for r in out.collect()} == {False}
    kept = quality.keep_good(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in one if r["kept"])


def test_clean_documents_stay(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality.judged(documents).join(labels, "doc_id").where("n_words >= 50").select("quality", "kept").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(good) >= 0.97 * len(good)


def test_plan_has_no_python(documents):
    plan = quality.judged(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
