import duckdb
import pytest

import corpus_pipeline
from ductwise.llm import packing, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, rows in, rows out) of every stage, each written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_and_order(stages):
    assert [s[0] for s in stages] == ["toxicity", "quality_rules", "line_dedup", "near_dedup", "packing"]
    assert all(after.columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, after in stages[:-1])


def test_toxicity(spark, stages):
    _, before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = {r["doc_id"]: r["is_toxic"] for r in toxicity.score(before, toxicity.fit(before, labels, toxicity.CATEGORIES)).collect()}
    assert ids(after) == sorted(d for d, bad in verdict.items() if not bad)


def test_quality_is_the_sql(stages):
    _, before, after = stages[1]
    con, frame = duckdb.connect(), before.toPandas()
    con.register("documents", frame)
    assert ids(after) == sorted(con.sql(f"select doc_id from ({queries.ORACLE_SQL['op8_quality']}) where kept").df()["doc_id"].tolist())


def test_no_passage_of_fifty_words_is_left(stages):
    _, before, after = stages[2]
    assert ids(before) == ids(after)
    rows, seen = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in after.collect()), {}
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    for d, text, n in rows:
        assert n == len(text)
        words, left = text.split(), iter(old[d].split())
        assert all(w in left for w in words)  # what stays is in the old order
        for i in range(len(words) - 49):
            assert seen.setdefault(tuple(words[i : i + 50]), d) == d


def test_near_copies(stages):
    """The first of each group stays, groups being what links of a Jaccard similarity of 0.8 over five-word shingles connect."""
    _, before, after = stages[3]
    rows = [(r["doc_id"], set(simhash.shingle_set(r["text"]).tolist())) for r in before.orderBy("doc_id").collect()]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x == y or len(x & y) >= 0.8 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert {d for d in root if find(d) == d} == set(ids(after))


def test_packing(stages):
    _, before, after = stages[4]
    rows = after.collect()
    assert {r["doc_id"] for r in rows} == set(ids(before))
    bins, counts = {}, {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        counts[r["length"]] = counts.get(r["length"], 0) + 1
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert len(bins) == packing.lower_bound(counts, 2048)


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.drop("sequence_id", "offset").collect())) == sorted(map(tuple, stages[-1][2].drop("sequence_id", "offset").collect()))
