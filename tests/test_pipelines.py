"""Files in, written tables out, one answer back."""

import json

from tidemark.plans import inputs, pipelines


def test_logs_to_answer(spark, sf_dir, tmp_path):
    http, ftp, out = str(tmp_path / "http"), str(tmp_path / "ftp"), str(tmp_path / "out")
    inputs.http_lines(spark, sf_dir).select("line").write.text(http)
    inputs.ftp_lines(spark, sf_dir).select("line").write.text(ftp)
    pipelines.preprocess(spark, http, ftp, out, inputs.SITE, rate=3, gap=21600)
    stats = spark.read.parquet(f"{out}/stats")
    assert stats.count() > 0 and set(stats.columns) >= {"month", "keywords", "views", "downloads"}
    before = stats.count()
    pipelines.preprocess(spark, http, ftp, out, inputs.SITE, months=["2024-01"], rate=3, gap=21600)
    assert spark.read.parquet(f"{out}/stats").count() == before

    meta, onto = tmp_path / "meta.json", tmp_path / "onto.csv"
    record = dict(longName="l", keywordStr="sea ice,ocean winds", termStr="salinity", topicStr="ocean", variableStr="gravity")
    meta.write_text("\n".join(
        json.dumps(dict(record, shortName=f"DS_{i}", keywordStr=k, abstractStr=a))
        for i, (k, a) in enumerate([("sea ice,ocean winds", "ice%20cover"), ("sea ice", "winds"), ("ocean winds,gravity field", "gravity")])
    ))
    onto.write_text("Ice,SubClassOf,Sea Ice\n")
    pipelines.mine(spark, out, str(meta), str(onto), inputs.SITE, min_sessions=1, min_users=1)
    models = {r["model"] for r in spark.read.parquet(f"{out}/term_pairs").select("model").distinct().collect()}
    assert {"userHistory", "userClicking", "GCMDMetadata"} >= models >= {"userHistory"}
    asked = spark.createDataFrame([("sea ice",)], "input string")
    hits = [json.loads(r["record"]) for r in pipelines.answer(spark, out, asked).orderBy("rank").collect()]
    assert {"DS_0", "DS_1"} <= {h["Short Name"] for h in hits}
