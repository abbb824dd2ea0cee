import json

from pyspark.sql import functions as F

from ductwise.operators import validate
from ductwise.plans import connect
from ductwise.streaming import journal

CONSUMERS = [("c1", 10.0, 40.0, 3.0), ("c2", 60.0, -30.0, 50.0), ("c3", 900.0, 2000.0, 5.0), ("c4", 95.0, 20.0, 30000.0)]
NETWORK = [("s1", 0.0, 0.0, 100.0, 0.0), ("s2", 100.0, 0.0, 100.0, 300.0)]


def plan(spark):
    consumers = spark.createDataFrame(CONSUMERS, "fid string, x double, y double, flow double")
    network = spark.createDataFrame(NETWORK, "fid string, ax double, ay double, bx double, by double")
    return consumers, connect.separate_variant(consumers, network)


def rules(consumers, v, **new):
    t = v | new
    return sorted({r["rule"] for r in validate.findings(t["segments"], t["chambers"], consumers, t["ties"], t["summaries"]).collect()})


def test_separate_plan_keeps_the_rules(spark):
    consumers, v = plan(spark)
    s = {r["start_node"]: r for r in v["segments"].collect()}
    assert (s["c1"]["length"], s["c1"]["dn"], s["c1"]["cost"]) == (40.0, 50, 40 * 74023)
    assert (s["c2"]["length"], s["c2"]["dn"]) == (30.0, 150)
    assert v["summaries"].first()["unconnected"] == ["c3", "c4"]
    assert rules(consumers, v) == []


def test_each_corruption_breaks_its_rule(spark):
    consumers, v = plan(spark)
    s, c, m = v["segments"], v["chambers"], v["summaries"]
    hit = F.col("start_node") == "c1"
    change = lambda col, to: s.withColumn(col, F.when(hit, to).otherwise(F.col(col)))
    assert "R-LEN" in rules(consumers, v, segments=change("length", F.col("length") + 1))
    assert rules(consumers, v, segments=change("cost", F.col("cost") + 5)) == ["R-COST", "R-SUM"]
    assert "R-NET-8" in rules(consumers, v, segments=change("flow", F.col("flow") + 0.2))
    assert "R-NET-9" in rules(consumers, v, segments=s.withColumn("dn", F.lit(50)))
    assert "R-NET-1" in rules(consumers, v, segments=change("end_node", F.lit("nowhere")))
    assert "R-TIE-3" in rules(consumers, v, chambers=c.withColumn("cost", F.lit(1)))
    assert "R-NET-1" in rules(consumers, v, summaries=m.withColumn("unconnected", F.array(F.lit("c4"))))
    assert rules(consumers, v, summaries=m.withColumn("score", F.col("score") + 1)) == ["R-SCORE"]
    assert rules(consumers, v, summaries=m.withColumn("rank", F.lit(2))) == ["R-RANK"]
    assert "OUT-ID" in rules(consumers, v, segments=s.unionByName(s))
    bent = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10.0, 40.0), (10.0, 60.0), (10.0, 40.0), (10.0, 0.0))])
    assert "R-TURN" in rules(consumers, v, segments=change("line", bent))
    across = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, -10.0), (100.0, -10.0))])
    assert "R-NET-7" in rules(consumers, v, segments=change("line", across))


def test_obstacles(spark):
    consumers, v = plan(spark)
    near = spark.createDataFrame([("park", 1.0, 10.5, 20.0), ("pond", 1.0, 12.0, 20.0)], "fid string, min_distance double, x double, y double")
    assert [r["message"] for r in validate.near_obstacles(v["segments"], near).collect()] == ["too close to park"]


def test_journal_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"seq": i, "at": f"2024-01-01T00:{i:02d}:00Z", "event": "leg" if i % 2 else "best", "run_id": "r", "payload": "{}"} for i in range(20)]
    (source / "a.json").write_text("\n".join(map(json.dumps, rows + rows[:3])))
    run = journal.counts(journal.once(journal.stream(spark, str(source)))).writeStream.format("memory").queryName("journal").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
    run.trigger(availableNow=True).start().awaitTermination(60)
    batch = spark.read.schema(journal.SCHEMA).json(str(source))
    assert journal.after(batch, 16).count() == 3
    assert sum(r["n"] for r in journal.counts(journal.once(batch)).collect()) == 20
    assert all(r["n"] == 5 for r in spark.table("journal").collect())
