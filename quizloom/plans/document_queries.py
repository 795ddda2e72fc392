"""Queries of conversion, metadata and token counts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizloom.functions import values as V
from quizloom.operators import build, convert, keywords, passes, scoring, table_functions, tasks, token_counts
from quizloom.operators.completions import Completions
from quizloom.plans.fixtures import table
from quizloom.plans.model_queries import digit, make
from quizloom.sources import document_files, records, sinks
from quizloom.sources.scratch import new_dir, store
from quizloom.streaming import buffer

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_LI = "len(regexp_extract_all(html, '<li>'))"


@query(f"""select concat(page_id, '.html') as path, case when contains(html, '</html>') then 'convert_with_pandoc' else 'convert_html_with_fallback' end as tool,
case when contains(html, '</html>') then 'convert_with_pandoc' else 'convert_with_pandoc,convert_html_with_fallback' end as tried, 'completed' as status,
case when contains(html, '</html>') then {_LI} else 0 end as items, 1 as headings from pages""")
def convert_pages(spark, sf):
    """Pages that aren't whole go to the plain converter."""
    pages = table(spark, sf, "pages").select(F.concat("page_id", F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    lines = lambda head: F.regexp_count("text", F.lit(rf"(?m)^{head} "))
    got = convert.convert(pages)
    return got.select("path", "tool", F.array_join("tried", ",").alias("tried"), "status", lines("-").alias("items"), lines("#").alias("headings"))


_TEXT = r"regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
_XML = "replace(replace({}, '&', '&amp;'), '<', '&lt;')"


@query(rf"""with c as (select conv_id, turn, (conv_id + turn) % 6 as kind, {_TEXT} as t from conversations where regexp_matches(text, '\S'))
select concat(conv_id, '-', turn, case kind when 0 then '.csv' when 1 then '.xml' when 2 then '.TXT' when 3 then '.docx' when 4 then '.pdf' else '.zip' end) as path,
case kind when 0 then 'convert_tabular_document' when 1 then 'convert_xml_document' when 4 then 'deepseek_ocr2_to_markdown' when 5 then null else 'convert_with_pandoc' end as tool,
case when kind = 0 then '## ' || conv_id || '-' || turn || chr(10) || chr(10) || case when turn = 0 then '(No rows found)' else '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || conv_id || ' |  |' end
  when kind = 1 and conv_id % 3 = 0 then '# ' || conv_id || '-' || turn || chr(10) || chr(10) || '## a' || chr(10) || chr(10) || t || ' z' || chr(10) || chr(10) || '## b' || chr(10) || chr(10) || t when kind = 2 then t end as text,
case when kind = 1 and conv_id % 3 = 1 then 'a document type isn''t read' when kind = 3 then 'no converter for .docx' when kind = 4 then 'No converter for tool: deepseek_ocr2_to_markdown' when kind = 5 then 'Unsupported file suffix: `.zip`'
  when kind = 1 and conv_id % 3 = 2 then 'no element found' end as error from c""")
def convert_documents(spark, sf):
    """Turns as files of several formats, some of them broken."""
    rows = table(spark, sf, "conversations").where(F.col("text").rlike(r"\S")).withColumn("kind", (F.col("conv_id") + F.col("turn")) % 6)
    plain = F.regexp_replace(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), r"\s+", " ")
    escaped = F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    whole = F.concat(F.lit("<a><b>"), escaped, F.lit("</b> z<c/></a>"))
    xml = F.when(F.col("conv_id") % 3 == 0, whole).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("<!DOCTYPE a>"), whole)).otherwise("<a>")
    table_ = F.concat(F.lit("a,b\n"), F.when(F.col("turn") > 0, F.concat("conv_id", F.lit("\n"))).otherwise(""))
    end = F.element_at(F.array(*map(F.lit, (".csv", ".xml", ".TXT", ".docx", ".pdf", ".zip"))), (F.col("kind") + 1).cast("int"))
    content = F.when(F.col("kind") == 0, table_).when(F.col("kind") == 1, xml).otherwise(plain)
    files = rows.select(F.concat_ws("-", "conv_id", F.concat("turn", end)).alias("path"), F.encode(content, "UTF-8").alias("content"))
    return convert.convert(files).select("path", "tool", "text", F.regexp_replace("error", ": line.*", "").alias("error"))


_D = [digit("p", i) for i in range(3)]
_STEM = "concat('d', doc_id)"
_PHRASES = " ".join("when " + " or ".join(f"contains(lower(substr(text, 1, 12000)), '{k}')" for k in ks) + f" then '{n}'" for n, ks in V.TYPE_PHRASES)
_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query(rf"""with t as (select doc_id, coalesce(source, '') as source, coalesce(text, '') as text from documents),
d as (select *, concat('/in/', source, '/', {_STEM}, '.txt') as path, {_WORDS} as w from t),
p as (select *, concat('META ', path, ' ', case when len(w) <= 4096 then text else array_to_string(w[1:4096], ' ') end) as p from d),
k as (select *, {_D[0]} as d0, {_D[1]} as d1, {_D[2]} as d2 from p)
select path as source_path, concat('/out/', source, '/', {_STEM}, '.mmd') as markdown_path, '.txt' as suffix, 'convert_with_pandoc' as conversion_tool, len(w) as markdown_token_estimate,
case when d0 < 5 then {_STEM} else ' n' || d1 end as name, '' as date, '' as authors,
case when d0 < 5 then '{V.NO_DESCRIPTION}' else '' end as description,
case when d0 < 5 then case {_PHRASES} else '' end else list_extract(['MCQ', 'SAQ', 'CaseReport', 'other'], d2 % 4 + 1) end as type,
case when d0 < 3 then 'Metadata extraction returned invalid JSON: sorry, case ' || d1 when d0 = 3 then 'Metadata extraction did not return JSON: [1]'
  when d0 = 4 then 'Metadata extraction returned invalid JSON: {{"error": "no"}}' end as warning from k""")
def metadata_rows(spark, sf):
    """The metadata records of all documents."""
    path = F.concat(F.lit("/in/"), F.coalesce("source", F.lit("")), F.lit("/d"), "doc_id", F.lit(".txt"))
    docs = table(spark, sf, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    told = passes.describe(docs, "META {path} {text}", "m", make)
    converted = docs.select("path", F.lit(".txt").alias("suffix"), F.lit("convert_with_pandoc").alias("tool"), "text")
    rows = convert.metadata_rows(converted, told, "/in", "/out")
    names = {"Name": "name", "Date": "date", "Authors": "authors", "Brief Description": "description", "Type": "type", "Metadata Warning": "warning"}
    return rows.withColumnsRenamed(names)


@query(r"""select item_id, case when n = '' then 'benchmark.json' when ends_with(n, '.json') then n else n || '.json' end as name
from (select item_id, trim(case item_id % 4 when 0 then '  ' when 1 then ' b' || item_id when 2 then 'c.json ' end) as m, coalesce(m, '') as n from benchmark) z""")
def benchmark_names(spark, sf):
    kind = F.col("item_id") % 4
    name = F.when(kind == 0, "  ").when(kind == 1, F.concat(F.lit(" b"), "item_id")).when(kind == 2, "c.json ")
    return table(spark, sf, "benchmark").select("item_id", records.benchmark_filename(name).alias("name"))


@query("""select conv_id * 100 + turn as id, 'b' as source_path, cast(turn as varchar) as n from conversations where turn % 3 = 0
union all select conv_id * 100 + turn, 'a', 'plain' from conversations where turn % 3 = 2""")
def resume_duplicates(spark, sf):
    """Of a member that occurs twice the last one stands; records that are null have no rows."""
    kind = F.col("turn") % 3
    twice = F.concat(F.lit('{"records": {"b": {"n": "old"}, "a": {"n": 1}, "b": {"n": "'), "turn", F.lit('"}, "a": 5}}'))
    body = F.when(kind == 0, twice).when(kind == 1, '{"records": null, "a": {"n": "x"}}').otherwise('{"a": {"n": "plain"}}')
    rows = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), body.alias("payload"))
    found = records.resume_index(rows, "id", "payload")
    return found.select("id", "source_path", F.get_json_object("record", "$.n").alias("n"))


@query("""select conv_id, turn, case turn % 4 when 1 then '' when 3 then '' else chr(cast(65 + (conv_id + turn) % 26 as integer)) end as letter from conversations""")
def response_letters(spark, sf):
    """Letters of responses as they are stored, one for each turn: an object with the answer, a failed one, the plain answer, or none."""
    letter = F.char(97 + (F.col("conv_id") + F.col("turn")) % 26)
    answer = F.concat(F.lit("Option ("), letter, F.lit(")"))
    told = lambda status: F.to_json(F.struct(F.lit(status).alias("status"), answer.alias("answer"), F.col("text").alias("raw")))
    kind = F.col("turn") % 4
    response = F.when(kind == 0, told("ok")).when(kind == 1, told("failed")).when(kind == 2, F.concat(F.lit(" "), letter, F.lit(". "), letter))
    return table(spark, sf, "conversations").select("conv_id", "turn", scoring.response_letter(response).alias("letter"))


@query("""with i as (select item_id, item_id % 8 as k from benchmark)
select item_id, case k when 0 then 'not_json_object' when 1 then 'not_json_object' when 2 then 'failed_record' when 3 then 'passed' when 4 then 'incomplete_mcq' when 5 then 'incomplete_saq' when 6 then 'passed' else 'unsupported_type:essay' end as reason from i""")
def json_records(spark, sf):
    """Why records of a run summary, told as JSON, are kept or not."""
    rows = table(spark, sf, "benchmark").select("item_id", F.to_json(F.array("text")).alias("listed"))
    text = F.substring("listed", F.lit(2), F.length("listed") - 2)
    shapes = (
        ("listed", "listed"), (None, "broken"), ("SAQ", '{"status": " Failed", "question": T, "answer": "a"}'), ("MCQ", '{"question": T, "options": {"A": "x", "B": "y"}, "answer": "A"}'),
        ("MCQ", '{"question": T, "options": {}, "answer": "A"}'), ("SAQ", '{"question": T, "answer": 5}'), ("MCQ", '{"question_type": "SAQ", "question": T, "answer": "a"}'), ("x", '{"Type": "essay"}'),
    )
    item = F.element_at(F.array(*[F.col("listed") if s == "listed" else F.replace(F.lit(s), F.lit("T"), text) if s[0] == "{" and "essay" not in s else F.lit(s) for _, s in shapes]), (F.col("item_id") % 8 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in shapes]), (F.col("item_id") % 8 + 1).cast("int"))
    found = build.json_records(rows.select("item_id", kind.alias("category"), item.alias("item")), "item_id")
    return found.select("item_id", build.reason(found).alias("reason"))


@query("select d.doc_id, case when l.doc_id is null then 'new' else 'cached ' || l.quality end as result from documents d left join labels l on l.doc_id = d.doc_id")
def cached_results(spark, sf):
    """Records with a result of an earlier run take it; the others are worked on."""
    cached = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("cached "), "quality").alias("result"))
    work = lambda rows: rows.withColumn("result", F.lit("new"))
    return tasks.with_cached(table(spark, sf, "documents").select("doc_id"), cached, "doc_id", work)


def counting():
    """A client that counts characters."""
    return lambda text, model: ("", len(text), 0)


@query("""select sha256(line) as digest, cast(length(line) as integer) as n from (select distinct unnest(string_split(coalesce(text, ''), chr(10))) as line from documents) z""")
def line_counts(spark, sf):
    """The count of every distinct line of the documents; the second run finds all counts in the log."""
    lines = table(spark, sf, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))
    log = Completions(counting, new_dir(spark, "log"))
    token_counts.counted(lines, "m", log)
    return token_counts.counted(lines, "m", Completions(counting, log.path))


@query()
def pack_counted(spark, sf):
    """Chunks of all documents, packed by the counts of a client."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return token_counts.pack_counted(docs, "doc_id", 3000, 300, "m", Completions(counting, new_dir(spark, "log")))


_KEYS = "select distinct w from (select unnest(regexp_split_to_array(lower(text), '[^a-zäöüßéèêçàñóíúá]+')) as w from documents) z where length(w) >= 13"


@query(f"""with k as ({_KEYS}), h as (select doc_id, min_by(w, md5(w)) as word from documents, k where contains(lower(text), w) group by doc_id)
select d.doc_id, coalesce(h.word, '-') as word from documents d left join h on h.doc_id = d.doc_id""")
def keyword_lookup(spark, sf):
    """The first of all long words of the corpus, in order of their MD5, that each document holds."""
    docs = table(spark, sf, "documents")
    words = docs.select(F.explode(F.split(F.lower("text"), "[^a-zäöüßéèêçàñóíúá]+")).alias("keyword")).where(F.length("keyword") >= 13).distinct()
    listed = store(words.select("keyword", F.col("keyword").alias("value"), F.md5("keyword").alias("priority")), "long-words")
    return keywords.first_keyword(docs, "text", listed, "word", "-").select("doc_id", "word")


@query("select doc_id, number from (select doc_id, case " + " ".join("when " + " or ".join(f"contains(lower(text), '{k}')" for k in ks) + f" then '{n}'" for n, ks in V.DISCIPLINE_KEYWORDS) + " else '0' end as number from documents) z")
def keyword_disciplines(spark, sf):
    """The discipline's number by the table of its keywords, in place of a chain of cases."""
    listed = keywords.keyword_table(spark, V.DISCIPLINE_KEYWORDS)
    return keywords.first_keyword(table(spark, sf, "documents"), "text", listed, "number", "0").select("doc_id", "number")


def word_chunks(spark, sf):
    """The windows of all documents by a table function in SQL."""
    table_functions.register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("_chunk_documents")
    return spark.sql(
        "select doc_id, c.chunk_index, c.token_start, c.token_end, md5(c.text) as text_md5 from _chunk_documents, lateral word_chunks(text, 512, 96) c"
    )


QUERIES["word_chunks"] = word_chunks


@query("select concat(source, '/', doc_id, '.md') as path, md5(coalesce(text, '')) as text_md5 from documents")
def document_files_round_trip(spark, sf):
    """All documents as one file each, read again by the same data source."""
    document_files.register(spark)
    root = new_dir(spark, "files")
    rows = table(spark, sf, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), "text")
    rows.write.format("document_files").mode("append").save(root)
    return spark.read.format("document_files").option("suffixes", ".md").load(root).select("path", F.md5("text").alias("text_md5"))


@query("select md5(url) as item_id, url as source_path, 'completed' as status from pages where page_id % 10 <> 3")
def buffer_follow(spark, sf):
    """Every page enqueued twice, before and while the stream runs, is worked on once; the stream ends by its producer's mark.

    Pages of one url are items of their own, told apart by their Markdown's path.
    """
    root = new_dir(spark, "follow")
    pages = table(spark, sf, "pages")
    rows = pages.select(F.col("url").alias("source_path"), F.concat("page_id", F.lit(".mmd")).alias("markdown_path"), F.concat("page_id", F.lit(".json")).alias("metadata_path"), F.lit("MCQ").alias("Type"))
    sinks.enqueue(rows, f"{root}/new")

    def process(items):
        bad = F.col("markdown_path").rlike(r"3\.mmd$")
        return items.withColumn("status", F.when(bad, "failed").otherwise("completed")).withColumn("error", F.when(bad, "no text"))

    key = ["item_id", "markdown_path"]
    work = lambda **more: buffer.follow(buffer.once(buffer.queue(spark, f"{root}/new"), key), process, f"{root}/done", f"{root}/failed", f"{root}/checkpoint", key, poll=0.5, **more)
    work(idle=0.0)
    sinks.enqueue(rows, f"{root}/new")
    spark.range(1).write.parquet(f"{root}/mark")
    work(done_mark=f"{root}/mark")
    return spark.read.parquet(f"{root}/done").select("item_id", "source_path", "status")
