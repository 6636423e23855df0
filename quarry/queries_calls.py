"""Queries of model calls, streams and table functions, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import inference, reports, runner
from quarry.queries import _FIRST as FIRST
from quarry.queries import _WINDOWS as WINDOWS
from quarry.queries import query, table
from quarry.sources import folders
from quarry.sources.files import shared_folder
from quarry.sql import table_functions
from quarry.streaming.chain import PROVIDER, chain_stream


def _measuring_model():
    def model(texts: list[str]) -> list[dict]:
        return [{"n": len(t), "words": len(t.split(" "))} for t in texts]

    return model


@query("select doc_id, length(text) as n, len(string_split(text, ' ')) as words, true as within from documents")
def batch_inference(spark, sf_dir):
    """A model of the worker over every document, in batches of 50,000 padded tokens."""
    model = inference.Model(_measuring_model, budget=50_000)
    found = inference.infer(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    number = lambda path: F.get_json_object("answer", path).cast("long")
    return found.select("doc_id", number("$.n").alias("n"), number("$.words").alias("words"), ((F.col("batch_tokens") <= 50_000) | (F.col("batch_rows") == 1)).alias("within"))


async def _lengths(text: str) -> dict:
    if len(text) % 7 == 0:
        raise ValueError("seven")
    return {"n": len(text)}


@query("""select doc_id, case when length(text) % 7 <> 0 then length(text) end as n, case when length(text) % 7 = 0 then 'ValueError' end as error_type from documents""")
def rate_limited_calls(spark, sf_dir):
    """Awaitable calls by two tasks that share a limit of requests and tokens."""
    limit = inference.Limit(requests=5000, tokens=50_000_000, period=1.0)
    found = inference.limited(table(spark, sf_dir, "documents").select("doc_id", "text"), _lengths, limit, tasks=2)
    return found.select("doc_id", F.get_json_object("answer", "$.n").cast("long").alias("n"), "error_type")


_DIGESTED = """select conv_id, turn as idx, case when role <> 'system' then sha256('[{"b":' || (length(text) % 3) || ',"r":"' || role || '"},{"b":' || (length(text) % 5) || '}]') end as digest from conversations"""


@query(f"""with counted as (select conv_id, idx, count(*) filter (where is_first) as added from ({FIRST}) group by conv_id, idx)
select conv_id, idx::int as idx, digest, last_value(digest ignore nulls) over (partition by conv_id order by idx rows between unbounded preceding and 1 preceding) as previous_digest,
case when digest is null then 0 else 2 end as rows_returned, coalesce(added, 0)::int as rows_added from ({_DIGESTED}) left join counted using (conv_id, idx)""")
def stream_digest_chain(spark, sf_dir):
    """Every turn as a chunk's result on a stream, its state a conversation's; the rows are read again from the stream's sink."""
    schema = table(spark, sf_dir, "conversations").schema
    # a pattern, as a stream reads a table that is one file by pattern only
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque[t]")
    rows = F.format_string('[{"r": "%s", "b": %d}, {"b": %d}]', "role", F.length("text") % 3, F.length("text") % 5)
    results = turns.select("conv_id", F.col("turn").cast("int").alias("idx"), F.when(F.col("role") != "system", rows).alias("rows"), F.timestamp_seconds(F.col("turn") + 86_400).alias("ts"))
    folder, before = shared_folder(spark), spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        writer = chain_stream(results, "conv_id").writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER[0], before)
    return spark.read.parquet(f"{folder}/rows").select("conv_id", "idx", "digest", "previous_digest", "rows_returned", "rows_added")


@query(f"select doc_id, cast(start / 900 as int) as idx, start, sha256(chunk) as chunk_sha256 from ({WINDOWS})")
def chunk_text_function(spark, sf_dir):
    """The chunker as a table function in SQL."""
    table_functions.register(spark)
    table(spark, sf_dir, "documents").select("doc_id", "text").createOrReplaceTempView("quarry_documents")
    return spark.sql("select doc_id, idx, start, sha2(chunk, 256) as chunk_sha256 from chunk_text(table(quarry_documents), 'text', 1000, 100)")


@query("""select user_id, cast(st // 4 as int) as idx, '[' || string_agg('{"e": ' || event_id || ', "t": "' || event_type || '"}', ', ' order by pos) || ']' as chunk
from (select *, unnest(range(0, greatest(n - 1, 1), 4)) as st from (select *, row_number() over (partition by user_id order by event_id) - 1 as pos, count(*) over (partition by user_id) as n from events))
where pos between st and st + 4 group by 1, 2, st""")
def chunk_rows_function(spark, sf_dir):
    """Windows over the ordered rows of a partition, as a table function with a table argument."""
    table_functions.register(spark)
    table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("e"), F.col("event_type").alias("t")).createOrReplaceTempView("quarry_events")
    return spark.sql("select user_id, idx, chunk from chunk_rows(table(quarry_events) partition by (user_id) order by (e), 5, 1, 'user_id')")


@query("""select page_id, 0 as idx, length(html) - length(sec) as start, cast(length(html) as bigint) as "end", sha256(sec) as chunk_sha256
from (select page_id, html, regexp_extract(html, '<h[1-6][^>]*>.*', 0, 'is') as sec from pages)""")
def chunk_sections_function(spark, sf_dir):
    table_functions.register(spark)
    table(spark, sf_dir, "pages").select("page_id", "html").createOrReplaceTempView("quarry_pages")
    return spark.sql("select page_id, idx, start, `end`, sha2(chunk, 256) as chunk_sha256 from chunk_sections(table(quarry_pages), 'html', 1000)")


def _word_counts(text: str) -> list[dict]:
    if len(text) % 11 == 0:
        raise ValueError("eleven")
    return [{"w": len(text.split(" ")), "n": len(text)}, {"n": 0.0}]


@query("""select doc_id, pos, case pos when 0 then '{"n":' || length(text) || ',"w":' || len(string_split(text, ' ')) || '}' else '{"n":0.0}' end as found, null as error from documents, (select unnest([0, 1]) as pos) where length(text) % 11 <> 0
union all select doc_id, null, null, 'ValueError: eleven' from documents where length(text) % 11 = 0""")
def extract_rows_function(spark, sf_dir):
    """An extractor as a table function: a row for each row found, one with the error for a text that fails."""
    table_functions.register(spark, word_counts=_word_counts)
    table(spark, sf_dir, "documents").select("doc_id", "text").createOrReplaceTempView("quarry_documents")
    return spark.sql("select doc_id, pos, found, error from word_counts(table(quarry_documents), 'text')")


_RUNS = "select *, concat('engine', cast(o_orderkey % 3 as varchar(1))) as engine, case when o_orderkey % 10 <> 0 then o_orderpriority end as document_class, (o_orderkey % 8) / 8.0 as f1, o_orderkey % 100 as latency_ms from orders"


@query(f"""select engine, document_class, grouping_id(engine, document_class) as level, count(*) as documents, round(avg(f1), 9) as f1, count(*) as timed from ({_RUNS}) group by cube (engine, document_class)""")
def report_cube(spark, sf_dir):
    """Scores of two runs, each a cube of its own, merged to one report."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("quarry_orders")
    scores = spark.sql(_RUNS.replace("from orders", "from quarry_orders").replace("varchar(1)", "string")).withColumn("f1", F.col("f1").cast("double"))
    runs = [reports.cube(scores.where(F.col("o_orderkey") % 2 == k), metrics=["f1"]) for k in (0, 1)]
    rows = reports.shown(reports.merged(runs))
    return rows.select("engine", "document_class", "level", "documents", F.round("f1", 9).alias("f1"), "timed")


@query("""select concat('e', cast(s_suppkey % 3 as varchar)) as engine, cast(s_suppkey as varchar) as document, case when s_suppkey % 5 = 0 then 0.5 else 1.0 end::double as field_accuracy,
case when s_suppkey % 4 = 0 then 1.0 / 3 else 0.0 end::double as hallucination_rate, case when s_suppkey % 2 = 0 then 1.0 else 0.5 end::double as type_correctness from supplier where s_suppkey % 3 <> 1""")
def evaluation_folder(spark, sf_dir):
    """Predictions and gold of every supplier written as a folder, and those of two engines of three read and scored: the filter keeps the rest unopened."""
    folders.register(spark)
    folder = shared_folder(spark)
    row = lambda *more: F.to_json(F.struct(F.col("s_name").alias("name"), *more))
    nation = (F.col("s_nationkey") + F.when(F.col("s_suppkey") % 5 == 0, 1).otherwise(0)).alias("nation")
    made = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("e"), (F.col("s_suppkey") % 3).cast("string")).alias("engine"), F.col("s_suppkey").cast("string").alias("name"),
        row(nation, F.when(F.col("s_suppkey") % 4 == 0, "made up").alias("more")).alias("predicted"), row(F.col("s_nationkey").alias("nation")).alias("gold"),
        F.when(F.col("s_suppkey") % 2 == 0, '{"properties": {"name": {"type": "string"}, "nation": {"type": "integer"}}}').otherwise('{"properties": {"name": {"type": "string"}, "nation": {"type": "string"}}}').alias("schema"))
    made.write.format("extraction_evaluation").mode("append").save(folder)
    pairs = spark.read.format("extraction_evaluation").load(folder).where(F.col("engine").isin("e0", "e2"))
    return runner.score_pairs(pairs).select("engine", "document", "field_accuracy", "hallucination_rate", "type_correctness")
