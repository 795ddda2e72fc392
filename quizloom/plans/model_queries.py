"""Queries of the model passes, with a client whose replies follow from the prompt's MD5, so that SQL can tell them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from quizloom.functions import payloads, replies
from quizloom.functions import values as V
from quizloom.operators import passes, questions
from quizloom.operators.completions import Completions, usage
from quizloom.plans.fixtures import table
from quizloom.sources.scratch import new_dir, store


def digits(prompt: str) -> list[int]:
    return [int(c, 16) for c in hashlib.md5(prompt.encode()).hexdigest()]


def client(prompt: str, model: str) -> str:
    """A stand-in for a model.  The prompt's first word tells what is asked for."""
    d, kind = digits(prompt), prompt.split(" ", 1)[0]
    if kind == "JUDGE":
        return f'```json\n{{"score": {d[1] % 2}, "reason": "r{d[2]}"}}\n```' if d[0] < 12 else "unsure"
    if kind == "RISK":
        return ('{"risk_level": "S1", "rationale": "a"}', "it is level S2", '{"level": 3, "reason": "b"}', "no idea")[d[0] % 4]
    if kind == "ITEMS":
        item = {"from": "f", "question": f"q{d[1]}", "options": {"A": "x", "B": "y"}, "answer": "AB"[d[2] % 2], "reason": "w"}
        broken = {"from": "f", "question": f"Q{d[3]} ", "options": {"A": "x", "B": "y"}, "answer": "C"}
        return json.dumps([item, broken]) if d[0] < 14 else "nothing"
    if kind == "REPAIR":
        return json.dumps({"from": "f", "question": f"m{d[1]}", "options": {"A": "x", "B": "y"}, "answer": "B"}) if d[0] % 2 else "{}"
    if kind == "TAGS":
        return (f"{d[1] % 14 + 1}\nL{d[2] % 3 + 1}", "nothing said")[d[0] % 2]
    if kind == "STRUCTURE":
        sections = [{"section_title": f" t{d[1]} ", "recommended_for_extraction": (1, 0, "1", True)[d[2] % 4]}, 7]
        return json.dumps({"chunk_summary": f"s{d[3]}", "recommended_section_titles": [" a ", "", 5], "sections": sections}) if d[0] % 4 else "[1]"
    if kind in ("CASE", "AGAIN"):
        return broken_case(d[1]) if d[0] < 3 else case_text(d[0], d[1])
    if kind == "META":
        if d[0] < 3:
            return f"sorry, case {d[1]}"
        told = {"Name": f" n{d[1]}", "Date": None, "Authors": 0, "Type": ("Exam", "saq ", "case_report", "other")[d[2] % 4]}
        return "[1]" if d[0] == 3 else json.dumps({"error": "no"} if d[0] == 4 else told)
    if kind == "SELECT":
        return f'{{"selected_index": {d[0] % 3}}}' if d[1] % 4 else "the first"
    if kind == "VALIDATE":
        return json.dumps({c: {"score": 1 if d[i] % 4 else 0, "reasoning": "z"} for i, c in enumerate(replies.CRITERIA)})
    return f"taking ({'ABCD'[d[0] % 4]})"


def case_text(a: int, b: int) -> str:
    points = ", ".join(f'{{"content": "c{k}", "location": "l", "explanation": "e"}}' for k in range(5))
    return f'{{"seed_question": {{"question": "q{a}-{b}", "location": "l", "explanation": "e"}}, "key_points": [{points}]}}'


def broken_case(b: int) -> str:
    """A reply that is no case: too few points, a point without a text, a seed of another type, or no object."""
    whole = case_text(1, b)
    return (whole.replace(', {"content": "c4", "location": "l", "explanation": "e"}', ""), whole.replace('"c2"', "2"), '{"seed_question": "q"}', "[1]")[b % 4]


def make():
    return client


def counted(prompt: str, model: str) -> tuple[str, int, int]:
    """The stand-in's reply, with the characters of prompt and reply as tokens."""
    reply = client(prompt, model)
    return reply, len(prompt), len(reply)


def make_counted():
    return counted


def digit(prompt: str, n: int) -> str:
    """SQL for a digit of the prompt's MD5."""
    return f"(strpos('0123456789abcdef', substr(md5({prompt}), {n + 1}, 1)) - 1)"


PROMPTS = {
    "MCQ": "Q {question}\n{options}", "SAQ": "S {question}", "CBQ": "C {question}",
    "judge_SAQ": "JUDGE {question} | {answer} | {model_answer}", "judge_CBQ": "JUDGE {question} | {points} | {model_answer}",
}
ITEMS_SQL = """with i as (select item_id as item_index, text as question, case item_id % 3 when 0 then 'MCQ' when 1 then 'SAQ' else 'CBQ' end as category from benchmark),
e as (select *, case category when 'MCQ' then 'Q ' || question || chr(10) || 'A. x' || chr(10) || 'B. y' when 'SAQ' then 'S ' || question else 'C ' || question end as p from i, (values ('m0'), ('m1')) t(model)),
a as (select *, 'taking (' || substr('ABCD', {} % 4 + 1, 1) || ')' as said from e),
j as (select *, 'JUDGE ' || question || case category when 'SAQ' then ' | gold | ' else ' | 1. k | ' end || said as jp from a)
""".format(digit("p", 0))


def _items(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("item_index"), F.col("text").alias("question"))
    kind = F.when(F.col("item_index") % 3 == 0, "MCQ").when(F.col("item_index") % 3 == 1, "SAQ").otherwise("CBQ")
    return rows.select(kind.alias("category"), "*", F.lit("A. x\nB. y").alias("options"), F.lit("gold").alias("answer"), F.lit("1. k").alias("points"))


def evaluate_items(spark, sf):
    got = passes.evaluate(_items(spark, sf), ["m0", "m1"], "judge", PROMPTS, make)
    return got.select("category", "item_index", "model", "answer", "judge.score", "judge.reason", "status")


def judge_risks(spark, sf):
    answers = _items(spark, sf).where("category = 'CBQ'").withColumn("model", F.explode(F.array(F.lit("m0"), F.lit("m1")))).withColumn("answer", F.concat("model", F.lit(" says")))
    return passes.judge_risks(answers, "judge", "RISK {question} | {points} | {answer}", make).drop("tagged_at")


def _chunks(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("chunk_index"), "text")


GENERATE = {"generate": "ITEMS {text}", "repair": "REPAIR {item} {text}"}
CASES = {"generate": "CASE {text}", "validate": "VALIDATE {case}", "refine": "AGAIN {case} {why}", "select": "SELECT {candidates}"}


def generate_items(spark, sf):
    good, _ = passes.generate(_chunks(spark, sf), "conv_id", "MCQ", GENERATE, "m", make)
    return good.select("conv_id", "chunk_index", "nth", "repaired", "fields.question", "fields.answer")


def generate_failures(spark, sf):
    return passes.generate(_chunks(spark, sf), "conv_id", "MCQ", GENERATE, "m", make)[1]


def tag_items(spark, sf):
    rows = table(spark, sf, "benchmark").select("item_id", "text")
    tagged = passes.tag(rows, "TAGS {text}", "m", make)
    return tagged.select("item_id", "tags.number", "tags.name", "tags.level")


def structure_reports(spark, sf):
    rows = passes.analyse(_chunks(spark, sf), "STRUCTURE {text}", "m", make)
    first = F.get("structure.sections", F.lit(0))
    return rows.select(
        "conv_id", "chunk_index", "structure.chunk_summary", F.array_join("structure.recommended_section_titles", "|").alias("titles"), F.size("structure.sections").alias("n_sections"),
        first["section_title"].alias("title"), first["section_type"].alias("type"), first["recommended_for_extraction"].alias("recommended"),
    )


def best_cases(spark, sf):
    rows, _ = passes.cases(_chunks(spark, sf), "conv_id", CASES, "m", make)
    seed = F.get_json_object("case", "$.seed_question.question")
    return rows.select("conv_id", "chunk_index", seed.alias("question"), "rounds", "validation.overall_passed", "validation.total_score")


def failed_cases(spark, sf):
    return passes.cases(_chunks(spark, sf), "conv_id", CASES, "m", make)[1]


def tag_cases(spark, sf):
    """Every turn as the seed question of a case."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.struct(F.col("text").alias("question")).alias("seed_question"))).alias("case"))
    return passes.tag_cases(rows, "TAGS {question}", "m", make).select("conv_id", "turn", "tags.number", "tags.name", "tags.level")


def evaluate_resumed(spark, sf):
    """A run over the items whose text has an even length, and one over all items that takes what the first one left."""
    rows = _items(spark, sf)
    first = store(passes.evaluate(rows.where(F.length("question") % 2 == 0), ["m0", "m1"], "judge", PROMPTS, make), "first-run")
    got = passes.evaluate(rows, ["m0", "m1"], "judge", PROMPTS, make, existing=first)
    return got.select("category", "item_index", "model", "answer", "judge.score", "judge.reason", "status")


def call_usage(spark, sf):
    """Calls and tokens of two runs over all items with one log: the second finds all it needs there."""
    log = Completions(make_counted, new_dir(spark, "log"))
    for _ in range(2):
        passes.evaluate(_items(spark, sf), ["m0", "m1"], "judge", PROMPTS, log)
    return usage(log.log(spark))


def call_payloads(spark, sf):
    """The request for each item in both dialects."""
    rows = table(spark, sf, "benchmark").select("item_id", "text")
    model, text, system = F.lit("m"), F.col("text"), F.when(F.col("item_id") % 2 == 0, "Return valid JSON only.")
    images = F.when(F.col("item_id") % 3 == 0, F.array(F.concat(F.lit("data:image/png;base64,"), F.col("item_id"))))
    chat = payloads.payload(model, text, system=system, images=images, json_output=True, max_tokens=9, temperature=0.5, extra={"top_k": 3, "temperature": 1})
    other = payloads.payload(model, text, payloads.RESPONSES, system=system, max_tokens=9, reasoning_effort="low", extra={"store": False})
    canonical = lambda c: F.to_json(F.parse_json(c))  # noqa: E731  members in order of their names
    return rows.select("item_id", canonical(chat).alias("chat"), canonical(other).alias("responses"))


def _bodies(spark, sf):
    """Reply bodies of every shape: by turn % 5 a choice, listed output, a text, no choices, and no JSON."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    part = lambda kind: F.struct(F.lit(kind).alias("type"), F.col("text").alias("text"))
    used = F.struct(F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"))
    message = F.struct(F.struct(F.when(F.col("role") == "user", F.col("text")).alias("content"), F.col("role").alias("text")).alias("message"))
    chat = F.to_json(F.struct(F.array(message).alias("choices"), used.alias("usage")))
    thought = F.struct(F.lit("reasoning").alias("type"), F.array(part("output_text")).alias("content"))
    said = F.struct(F.lit("message").alias("type"), F.array(F.struct(F.lit("output_text").alias("type"), F.lit("").alias("text")), part("image"), part("output_text")).alias("content"))
    listed = F.to_json(F.struct(F.array(thought, said).alias("output"), F.struct(F.length("text").alias("input_tokens"), F.col("turn").alias("output_tokens")).alias("usage")))
    plain = F.to_json(F.struct(F.col("text").alias("output")))
    kind = F.col("turn") % 5
    body = F.when(kind == 0, chat).when(kind == 1, listed).when(kind == 2, plain).when(kind == 3, F.lit('{"choices":[]}')).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", body.alias("body"))


def reply_bodies(spark, sf):
    rows = _bodies(spark, sf)
    return rows.select("conv_id", "turn", payloads.reply_text(F.col("body")).alias("text"), payloads.usage(F.col("body")).alias("u")).select("conv_id", "turn", "text", "u.*")


#: Members of an item by item_id % 16; T stands for the text as JSON.
WRONG = (
    '"from": "f", "question": T, "options": {"A": "x", "B": T}, "answer": " B "', '"from": 5, "question": T, "answer": "A"', '"from": "f", "question": true, "answer": "A"',
    '"from": "f", "question": T, "options": {"A": 1, "B": 2}, "answer": "A"', '"from": "f", "question": T, "options": ["A", "B"], "answer": "A"',
    '"from": "f", "question": T, "options": "A. x", "answer": "A"', '"from": "f", "question": T, "options": {"A": "x", "B": "y"}, "answer": "A", "reason": 5',
    '"from": "f", "question": T, "options": {"A": "x", "B": "y", "C": " "}, "answer": "A", "reason": T', '"from": "f", "question": T, "options": {"A": "x", "B": "y", "C": " "}, "answer": "C"',
    '"from": "f", "question": T, "options": null, "answer": T, "reason": null', '"from": "f", "question": T, "options": {}, "answer": "A"', '"from": "f", "question": T, "answer": ["A"]',
    '"from": "f", "question": T, "answer": " "', '"from": "f", "question": T, "options": {"A": "x", "": "y"}, "answer": "A"', '"from": " ", "question": T, "answer": "A"',
    '"question": T, "from": "f", "answer": "a", "reason": {"a": 1}',
)


def item_problems(spark, sf):
    """What is wrong with items whose members have wrong types, as multiple-choice and as short-answer items."""
    rows = table(spark, sf, "benchmark").select("item_id", "text")
    shape = F.element_at(F.array(*map(F.lit, WRONG)), (F.col("item_id") % len(WRONG) + 1).cast("int"))
    listed = F.to_json(F.array("text"))
    quoted = F.substring(listed, F.lit(2), F.length(listed) - 2)
    item = F.concat(F.lit("{"), F.replace(shape, F.lit("T"), quoted), F.lit("}"))
    return rows.select("item_id", questions.item_problem(item, "MCQ").alias("choice"), questions.item_problem(item, "SAQ").alias("short_answer"))


_RISK = digit("p", 0) + " % 4"
_JSON_SQL = "from conversations"
QUERIES = {f.__name__: f for f in (evaluate_items, judge_risks, generate_items, generate_failures, tag_items, structure_reports, best_cases, failed_cases, tag_cases, evaluate_resumed, call_usage, call_payloads, reply_bodies, item_problems)}
ORACLES = {
    "evaluate_items": ITEMS_SQL
    + f"""select category, item_index, model, case category when 'MCQ' then substr('ABCD', {digit('p', 0)} % 4 + 1, 1) else said end as answer,
case when category = 'MCQ' then null when {digit('jp', 0)} < 12 then cast({digit('jp', 1)} % 2 as varchar) else '0' end as score,
case when category = 'MCQ' then null when {digit('jp', 0)} < 12 then 'r' || {digit('jp', 2)} else 'Judge did not return JSON: unsure' end as reason, 'ok' as status from j""",
    "judge_risks": f"""with c as (select item_id as item_index, model, 'RISK ' || text || ' | 1. k | ' || model || ' says' as p from benchmark, (values ('m0'), ('m1')) t(model) where item_id % 3 = 2)
select item_index, model, case {_RISK} when 0 then 'S1' when 3 then '' else 'S2' end as risk_level, case {_RISK} when 0 then 'a' when 1 then 'it is level S2' when 2 then 'b' else 'no idea' end as reason,
case {_RISK} when 3 then 'failed' else 'completed' end as status, case {_RISK} when 3 then 'Invalid risk level from judge: no idea' end as error, 'judge' as judge_config from c""",
    "generate_failures": f"select conv_id, turn as chunk_index, 'no JSON list' as error from conversations where {digit(chr(39) + 'ITEMS ' + chr(39) + ' || text', 0)} >= 14",
    "structure_reports": f"""with c as (select conv_id, turn as chunk_index, 'STRUCTURE ' || text as p from conversations), d as (select *, {digit('p', 0)} % 4 <> 0 as ok from c)
select conv_id, chunk_index, case when ok then 's' || {digit('p', 3)} else '' end as chunk_summary, case when ok then 'a|5' else '' end as titles, case when ok then 1 else 0 end as n_sections,
case when ok then 't' || {digit('p', 1)} end as title, case when ok then 'other' end as type, case when ok then case when {digit('p', 2)} % 4 in (0, 3) then 1 else 0 end end as recommended from d""",
}
ORACLES["evaluate_resumed"] = ORACLES["evaluate_items"]
_REPLY = '```json\n{"score": 1, "reason": "r"}\n```'
_REPLY_LENGTH = f"case when {digit('jp', 0)} < 12 then {len(_REPLY)} + length(cast({digit('jp', 2)} as varchar)) else 6 end"
ORACLES["call_usage"] = ITEMS_SQL + f""", calls as (select distinct model, p as prompt, 10 as came from a
  union select distinct 'judge', jp, {_REPLY_LENGTH} from j where category <> 'MCQ')
select model, count(*) as calls, 0 as failed, cast(sum(length(prompt)) as bigint) as input_tokens, cast(sum(came) as bigint) as output_tokens from calls group by model"""
ORACLES["call_payloads"] = """select item_id,
'{"max_completion_tokens":9,"max_tokens":9,"messages":[' || case when item_id % 2 = 0 then '{"content":"Return valid JSON only.","role":"system"},' else '' end
  || '{"content":[{"text":' || to_json(text) || ',"type":"text"}' || case when item_id % 3 = 0 then ',{"image_url":{"url":"data:image/png;base64,' || item_id || '"},"type":"image_url"}' else '' end
  || '],"role":"user"}],"model":"m","response_format":{"type":"json_object"},"temperature":1,"top_k":3}' as chat,
'{"input":' || to_json(text) || case when item_id % 2 = 0 then ',"instructions":"Return valid JSON only."' else '' end
  || ',"max_output_tokens":9,"model":"m","reasoning":{"effort":"low"},"store":false}' as responses from benchmark"""
ORACLES["reply_bodies"] = """select conv_id, turn, case turn % 5 when 0 then case when role = 'user' and text <> '' then text else role end when 1 then text when 2 then text
  when 3 then 'Error: No choices in response. Raw: {"choices":[]}' end as text,
case when turn % 5 < 2 then length(text) else 0 end as input_tokens, case when turn % 5 < 2 then turn else 0 end as output_tokens from conversations"""
_SHAPES = ", ".join("'" + x.replace("'", "''") + "'" for x in WRONG)
ORACLES["item_problems"] = rf"""with i as (select item_id, cast('{{' || replace(list_extract([{_SHAPES}], item_id % {len(WRONG)} + 1), 'T', to_json(text)) || '}}' as json) as j from benchmark),
t as (select item_id, j, [n for n in ['from', 'question', 'answer'] if not coalesce(json_type(j, '$.' || n) = 'VARCHAR' and regexp_matches(json_extract_string(j, '$.' || n), '\S'), false)] as blank,
  coalesce(json_type(j, '$.options'), 'NULL') as o, coalesce(json_type(j, '$.reason'), 'NULL') in ('NULL', 'VARCHAR') as reason from i),
f as (select *, case when o = 'OBJECT' then [k for k in [x for x in json_keys(j, '$.options') if regexp_matches(x, '\S')] if json_type(j, '$.options."' || k || '"') = 'VARCHAR'
  and regexp_matches(json_extract_string(j, '$.options."' || k || '"'), '\S')] else [] end as full_keys from t)
select item_id, case when len(blank) > 0 then blank[1] when o <> 'NULL' and len(full_keys) < 2 then 'options'
  when o <> 'NULL' and not list_contains(full_keys, trim(json_extract_string(j, '$.answer'))) then 'answer_key' when not reason then 'reason' else 'ok' end as choice,
case when len(blank) > 0 then blank[1] when list_contains(json_keys(j), 'options') then 'options_present' when not reason then 'reason' else 'ok' end as short_answer from f"""
ORACLES["generate_items"] = f"""with c as (select conv_id, turn, text, 'ITEMS ' || text as p from conversations),
g as (select *, 'REPAIR {{"answer":"C","from":"f","options":{{"A":"x","B":"y"}},"question":"Q' || {digit('p', 3)} || ' "}} ' || text as rp from c where {digit('p', 0)} < 14),
i as (select conv_id, turn as chunk_index, 0 as nth, false as repaired, 'q' || {digit('p', 1)} as question, substr('AB', {digit('p', 2)} % 2 + 1, 1) as answer from g
  union all select conv_id, turn, 1, true, 'm' || {digit('rp', 1)}, 'B' from g where {digit('rp', 0)} % 2 = 1)
select * from i qualify row_number() over (partition by conv_id, question order by chunk_index, nth) = 1"""


def _groups(text: str, groups, otherwise: str) -> str:
    """SQL for the first group of keywords with one in the text."""
    when = " ".join("when " + " or ".join(f"contains(lower({text}), '{k}')" for k in words) + f" then {name!r}" for name, words in groups)
    return f"case {when} else {otherwise} end"


def _tags_sql(keys: str, rows: str, context: str) -> str:
    names = ", ".join(f"({n}, '{x}')" for n, x in V.DISCIPLINES.items())
    return f"""with p as ({rows}),
t as (select *, {digit('p', 0)} % 2 = 0 as said, {digit('p', 1)} % 14 + 1 as told, 'L' || ({digit('p', 2)} % 3 + 1) as level from p),
f as (select {keys}, cast(case when said then told else {_groups(context, V.DISCIPLINE_KEYWORDS, "0")} end as integer) as number,
  case when said then level else {_groups(context, V.LEVEL_KEYWORDS, "'L1'")} end as level from t)
select {keys}, number, coalesce(name, '') as name, level from f left join (values {names}) d(n, name) on n = number"""


ORACLES["tag_items"] = _tags_sql("item_id", "select item_id, 'TAGS ' || text as p from benchmark", "p")
ORACLES["tag_cases"] = _tags_sql("conv_id, turn", r"select conv_id, turn, 'TAGS ' || regexp_replace(text, '^\s+|\s+$', '', 'g') as p from conversations", "p || chr(10) || '[]'")

_POINTS = case_text(0, 0).split('"key_points": ')[1][:-1]
_SORTED = "[" + ",".join(f'{{"content":"c{k}","explanation":"e","location":"l"}}' for k in range(5)) + "]"


def _case_sql(prompt: str) -> str:
    return f"""'{{"seed_question": {{"question": "q' || {digit(prompt, 0)} || '-' || {digit(prompt, 1)} || '", "location": "l", "explanation": "e"}}, "key_points": {_POINTS}}}'"""


def _score(i: int) -> str:
    return f"case when {digit('vp', i)} % 4 <> 0 then 1 else 0 end"


_SCORES = [f"s{i}" for i in range(3)]
_WHY = " || ".join(f"""'{"," if i else "{"}"{c}":{{"score":' || s{i} || ',"reasoning":"z"}}'""" for i, c in enumerate(replies.CRITERIA)) + " || ',\"overall_passed\":0,\"total_score\":' || (s0 + s1 + s2) || '}'"
_PASSED = "{" + ",".join(f'"{c}":{{"score":1,"reasoning":"z"}}' for c in replies.CRITERIA) + ',"overall_passed":1,"total_score":3}'
_CANDIDATES = f"""with recursive r as (select conv_id, turn, 0 as round, {_case_sql('p')} as c, false as over from (select conv_id, turn, 'CASE ' || text as p from conversations) z where {digit('p', 0)} >= 3
  union all select conv_id, turn, round + 1, case when {digit('ap', 0)} < 3 then c else {_case_sql('ap')} end, {digit('ap', 0)} < 3
  from (select *, 'AGAIN ' || c || ' ' || {_WHY} as ap from (select *, {", ".join(f"{_score(i)} as s{i}" for i in range(3))} from (select *, 'VALIDATE ' || c as vp from r) x) y
    where s0 + s1 + s2 < 3 and not over and round < 3) w),
k as (select *, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from (select *, 'VALIDATE ' || c as vp from r) x
  where not over and {_score(0)} + {_score(1)} + {_score(2)} = 3)"""
ORACLES["best_cases"] = _CANDIDATES + f""",
l as (select conv_id, any_value(n) as n, 'SELECT [' || string_agg('{{"index":' || i || ',"seed_question":{{"explanation":"e","location":"l","question":"' || json_extract_string(c, '$.seed_question.question')
  || '"}},"key_points":{_SORTED},"validation":{_PASSED}}}', ',' order by i) || ']' as sp from k group by conv_id),
s as (select conv_id, case when n > 1 and {digit('sp', 1)} % 4 <> 0 and {digit('sp', 0)} % 3 < n then {digit('sp', 0)} % 3 else 0 end as pick from l)
select k.conv_id, turn as chunk_index, json_extract_string(c, '$.seed_question.question') as question, round as rounds, 1 as overall_passed, 3 as total_score from k join s on s.conv_id = k.conv_id and i = pick"""
ORACLES["failed_cases"] = _CANDIDATES + " select distinct conv_id, 'No valid Case Report candidate could be generated.' as error from conversations where conv_id not in (select conv_id from k)"
