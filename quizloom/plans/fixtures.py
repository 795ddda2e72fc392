"""Tables in the shapes of the domain, derived from the test tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.functions import values as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    third = F.floor(F.col("doc_id") / 3).cast("bigint")
    kind = F.when(F.col("doc_id") % 3 == 0, "MCQ").when(F.col("doc_id") % 3 == 1, "SAQ").otherwise("CBQ")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("third", third).withColumn("category", kind)


def _each_model(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("mi", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return rows.withColumn("model", F.concat(F.lit("m"), F.col("mi").cast("string")))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category, item_index, answer (MCQ: A to D), level, number, name."""
    rows = _labelled(spark, sf_dir)
    number = (F.col("third") % 15).cast("int")
    name = F.element_at(F.create_map(*[F.lit(x) for kv in V.DISCIPLINES.items() for x in kv]), number)
    level = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("L"), (F.col("doc_id") % 4).cast("string")))
    answer = F.when(F.col("category") == "MCQ", F.char(65 + F.col("third") % 4))
    return rows.select("category", F.col("doc_id").alias("item_index"), answer.alias("answer"), level.alias("level"), number.alias("number"), name.alias("name"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category, item_index, model, answer, judge, hits, risk: their scores are those of the score fixture."""
    rows = _each_model(_labelled(spark, sf_dir))
    right = (F.col("third") * 5 + F.col("mi") + F.col("quality")) % 4 < 2
    answer = F.char(65 + (F.col("third") + F.when(right, 0).otherwise(1)) % 4)
    n_hits = (F.col("third") + F.col("mi")) % 6
    hits = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.when(i <= n_hits, "true").otherwise("false"))
    risk = F.element_at(F.array(*map(F.lit, ("S0", "S1", "level S2", "1", ""))), ((F.col("third") + F.col("toxic") + F.col("mi")) % 5 + 1).cast("int"))
    return rows.select(
        "category", F.col("doc_id").alias("item_index"), "model",
        F.when(F.col("category") == "MCQ", F.concat(F.lit("Option ("), F.lower(answer), F.lit(")"))).otherwise("an answer").alias("answer"),
        F.when(F.col("category") == "SAQ", F.when(right, " YES ").otherwise("no")).alias("judge"),
        F.when(F.col("category") == "CBQ", hits).alias("hits"), F.when(F.col("category") == "CBQ", risk).alias("risk"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-summary records: kind, status, error, question, n_options, answer, points, process, validated."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("MCQ", "SAQ", "CaseReport", "Essay"))), F.when(i % 17 == 0, 4).otherwise(i % 3 + 1).cast("int"))
    return rows.select(
        i.alias("item_index"), kind.alias("kind"), F.when(i % 11 == 0, " Failed ").otherwise("ok").alias("status"), F.when(i % 13 == 0, "x").alias("error"),
        F.when(i % 7 == 0, " ").otherwise("q").alias("question"), (i % 5).alias("n_options"), F.when(F.col("quality") == 0, "").otherwise("a").alias("answer"),
        F.when(i % 5 == 1, F.array(F.lit("p"), F.lit(" "))).otherwise(F.array(F.lit("p"))).alias("points"),
        F.element_at(F.array(*map(F.lit, ("found", "found", "missing", "invalid"))), (i % 4 + 1).cast("int")).alias("process"),
        (F.col("toxic") == 0).alias("validated"), F.lit("o").alias("output_path"), F.lit("t").alias("question_type"), F.lit("t").alias("Type"),
    )


SCORES_SQL = """
with base as (select d.doc_id, l.quality, l.toxic from documents d join labels l on d.doc_id = l.doc_id),
score_records as (
select concat('m', cast(mi as varchar)) as model,
       case doc_id % 3 when 0 then 'MCQ' when 1 then 'SAQ' else 'CBQ' end as category, doc_id as item_index,
       case when doc_id % 3 = 2 then cast(20 * ((cast(floor(doc_id/3) as bigint) + mi) % 6) as double)
            when (cast(floor(doc_id/3) as bigint)*5 + mi + quality) % 4 < 2 then cast(100 as double) else cast(0 as double) end as score,
       case doc_id % 4 when 0 then 'Unknown' else concat('L', cast(doc_id % 4 as varchar)) end as reasoning_level,
       cast(cast(floor(doc_id/3) as bigint) % 15 as integer) as num
from base cross join (select 0 as mi union all select 1 union all select 2) mm),
names as (select * from (values %s) t(num, name)),
facts as (select s.model, s.category, s.item_index, s.score, s.reasoning_level,
       case when s.num = 0 then 'Unknown' else cast(s.num as varchar) end as dental_discipline_number,
       case when s.num = 0 then 'Unknown' else concat(cast(s.num as varchar), '. ', name) end as dental_discipline
from score_records s left join names on names.num = s.num),
risk_records as (select concat('m', cast(mi as varchar)) as model, doc_id as item_index,
       case (cast(floor(doc_id/3) as bigint) + toxic + mi) % 5 when 0 then 'S0' when 1 then 'S1' when 2 then 'S2' when 3 then 'S0' else '' end as risk_level
from base cross join (select 0 as mi union all select 1 union all select 2) mm where doc_id % 3 = 2)
""".replace("%s", ", ".join("(%d, '%s')" % kv for kv in V.DISCIPLINES.items()))
