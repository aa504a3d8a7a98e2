"""Steps whose few bytes become much work are dealt over as many tasks as a shuffle has, whatever their size; results stay the same."""

from pyspark.sql import functions as F

from leadlake.functions import text as tx
from leadlake.operators import suffixes as sx
from leadlake.plans import search as se
from leadlake.session import work_folder
from leadlake.sources.sinks import read_postings, write_postings
from leadlake.streaming import upkeep as up


def in_one_task(spark, rows, schema):
    return spark.createDataFrame(rows, schema).coalesce(1)


def held(df):
    """The number of tasks that have rows."""
    return len({r.p for r in df.select(F.spark_partition_id().alias("p")).collect()})


def test_a_log_is_parsed_in_all_tasks(spark):
    log = [(i % 90, f"blue ring {i}") for i in range(200)] + [(None, "blue ring"), (3, None), (3, None)]
    parsed = se.parse_log(in_one_task(spark, log, "query_id long, query_text string"))
    assert held(parsed) == 4 and parsed.count() == len(log)


def test_pieces_are_sent_from_all_tasks(spark):
    names = in_one_task(spark, [(1, f"name {i}") for i in range(50)], "scope bigint, text string")
    pieces = in_one_task(spark, [(1, f"e {i}") for i in range(50)] * 2, "scope bigint, piece string")
    table = sx.suffix_table(names.withColumn("value", F.col("text")), False)
    sent = sx._sent(table, pieces)
    assert held(sent) == 4
    assert {r.piece for r in sx.containing(names, pieces).collect()} == {f"e {i}" for i in range(50)}


def test_stored_postings_are_written_by_all_tasks(spark):
    path = work_folder(spark, "postings")
    rows = [("hot", i) for i in range(200)]
    write_postings(in_one_task(spark, rows, "token string, lead_id long"), path, buckets=1, splits=8)
    found = read_postings(spark, path, ["hot"], buckets=1)
    assert len(found.inputFiles()) > 1 and sorted(map(tuple, found.collect())) == rows


def test_a_bucket_of_the_base_is_split(spark, sample):
    folder = work_folder(spark, "upkeep-split")
    many = sample.crossJoin(spark.range(20).withColumnRenamed("id", "nth")).withColumn("id", F.col("nth") * 100 + F.col("id")).drop("nth")
    many.select("*", F.lit("create").alias("op"), F.lit(1).alias("seq")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
    up.keep_index(stream, f"{folder}/index", f"{folder}/checkpoint", once=True).awaitTermination()
    before = sorted(map(tuple, up.read_index(spark, f"{folder}/index").collect()))
    up.compact_index(spark, f"{folder}/index", 1)
    assert len(spark.read.parquet(f"{folder}/index/base").inputFiles()) > 1
    assert sorted(map(tuple, up.read_index(spark, f"{folder}/index").collect())) == before


def test_cleaned_words_are_those_of_the_text(spark):
    texts = [("Água & ring-a_1 the x", "Zé the BIG\x1cbox"), ("", ""), (None, None), ("ſK ǅ ½ 漢字", "a\u0085bb\tcc")]
    cleaned = tx.clean_index_text(F.col("a"))
    plain = tx.tokenize(F.concat_ws(" ", cleaned, F.col("b")))
    rows = spark.createDataFrame(texts, "a string, b string").select(tx.tokenize_cleaned(cleaned, F.concat_ws(" ", "b")).alias("x"), plain.alias("y"))
    assert all(r.x == r.y for r in rows.collect()) and any(r.x for r in rows.collect())
