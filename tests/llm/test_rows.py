"""Rows keep their numbers whatever the number of tasks that read them."""

from pyspark.sql import functions as F

from tidemark.llm import mixing, quality, rows

PARALLEL = "spark.sql.leafNodeDefaultParallelism"
CLASHES = "_row string, _copies int, _copy string, row string, _path string, _place int, _number string, __row int"


def written(spark, docs, path):
    extra = [F.lit(None if kind == "int" else "x").cast(kind).alias(name) for name, kind in (c.split() for c in CLASHES.split(", "))]
    docs.select("*", *extra).repartition(9).write.parquet(path)
    return path


def with_tasks(spark, tasks, path, act):
    """`act` on the table read in `tasks` tasks."""
    before = {k: spark.conf.get(k, None) for k in (PARALLEL, "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set(PARALLEL, str(tasks))
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        return act(spark.read.parquet(path))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_numbers_do_not_follow_the_tasks(spark, sf_dir, tmp_path):
    path = written(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path / "docs"))
    few, many = (
        with_tasks(spark, n, path, lambda t: {tuple(r) for r in rows.with_row_number(t, "number").select("doc_id", "number").collect()})
        for n in (2, 12)
    )
    assert few == many and len({n for _, n in few}) == len(few)


def test_stages_judge_and_copy_the_row_they_mean(spark, sf_dir, tmp_path):
    """The verdicts are made under one layout, the texts read under another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = written(spark, docs, str(tmp_path / "docs"))
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    kept = {r["doc_id"] for r in quality.judged(docs, trusted).where("kept").select("doc_id").collect()}
    frames = with_tasks(spark, 2, path, lambda t: (quality.kept_documents(t, trusted), mixing.mixed_documents(t)))
    got = with_tasks(spark, 12, path, lambda _: [f.collect() for f in frames])
    assert {r["doc_id"] for r in got[0]} == kept and len(got[0]) == len(kept)
    assert {r["_row"] for r in got[0]} == {"x"} and frames[0].columns == spark.read.parquet(path).columns
    copies = {r["doc_id"]: r["n"] for r in mixing.mixed(docs).select("doc_id", F.greatest("copies", (F.col("size") == 0).cast("int")).alias("n")).collect()}
    found = {}
    for r in got[1]:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    assert found == {d: n for d, n in copies.items() if n}


def test_tables_that_are_not_files_and_empty_ones(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", "mine"), (1, "a b", "en", "s", "mine"), (None, None, None, None, "mine")],
                                 "doc_id bigint, text string, lang string, source string, _row string")
    trusted = spark.createDataFrame([(1,)], "doc_id bigint")
    assert sorted(r["_row"] for r in quality.kept_documents(docs, trusted).collect()) == ["mine"] * 3
    assert quality.kept_documents(docs.where("false"), trusted).collect() == []
    assert mixing.mixed_documents(docs.where("false")).collect() == []
    assert {r["_row"] for r in mixing.mixed_documents(docs).collect()} == {"mine"}
