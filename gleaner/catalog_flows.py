"""Queries of readers, plans, generation, judges, state and sinks, with their SQL twins. Models are deterministic stand-ins
whose replies SQL can compute too; files are written to and read from the shared folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.replies import extract_json, validate_trajectory
from gleaner.operators import embedding, judge, render, report, scoring
from gleaner.operators.model import as_samples, document_samples, message_samples
from gleaner.operators.state import State
from gleaner.plans import generate, planners
from gleaner.session import shared_folder, table
from gleaner.sources import readers
from gleaner.functions import text as T

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def literal(rows: list[tuple], names: str) -> str:
    """SELECT of rows, by which expectations worked out by hand stand in SQL."""
    cell = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else f"{v!r}::double" if isinstance(v, float) else repr(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


_MSG = """with m as (select id, messages, tools, generate_subscripts(messages, 1) k from (
  select *, row_number() over (partition by id order by created_at desc, total_score desc nulls last) rn from samples where messages is not null and id is not null) where rn = 1)
"""
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
_NORM = r"regexp_replace(regexp_replace({0}, '[\x{{0}}-\x{{8}}\x{{b}}-\x{{1f}}\x{{7f}}-\x{{9f}}\p{{Cf}}]', '', 'g'), '^" + _SPACE.replace("{", "{{").replace("}", "}}") + "+|" + _SPACE.replace("{", "{{").replace("}", "}}") + r"+$', '', 'g')"


def _written(df: DataFrame, ending: str = "jsonl", files: int | None = None) -> str:
    """df as JSON lines in a folder of its own, in its order."""
    folder = f"{shared_folder(df.sparkSession, 'rows')}/data.{ending}"
    (df.coalesce(1) if files == 1 else df).select(F.to_json(F.struct("*")).alias("value")).write.text(folder)
    return folder


# Readers ---------------------------------------------------------------------------------------------------------
@query(f"select cast(doc_id as varchar) id, {_NORM.format('text')} content, row_number() over (order by doc_id) - 1 pos from documents qualify content <> ''")
def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """All documents through JSON lines of several files; numbers follow the files."""
    docs = table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "doc_id").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").drop("doc_id")
    return readers.load_documents(spark, _written(docs)).select("id", F.col("text").alias("content"), "pos")


@query("select cast(n_nationkey as varchar) id, n_name as text, row_number() over (order by n_nationkey) - 1 pos from nation")
def read_json_list(spark, root):
    """A JSON file that is one list, keys renamed by a field map."""
    rows = table(spark, root, "nation").orderBy("n_nationkey").select(F.struct(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name")).alias("r"))
    folder = f"{shared_folder(spark, 'rows')}/nations.json"
    rows.coalesce(1).agg(F.to_json(F.sort_array(F.collect_list("r"))).alias("value")).withColumn("value", F.to_json(F.array_sort(F.from_json("value", "array<struct<key:string,name:string>>"), lambda a, b: (a["key"].cast("int") - b["key"].cast("int"))))).write.text(folder)
    return readers.read_json_rows(spark, folder, {"key": "id", "name": "text"}).select("id", "text", "pos")


@query("select cast(doc_id as varchar) id, text content, coalesce(source, '') origin from documents where text <> '' or source <> ''")
def field_map_rename(spark, root):
    """Foreign names of fields mapped to own ones on reading."""
    docs = table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("text").alias("body"), F.col("source").alias("from"))
    rows = readers.read_json_rows(spark, _written(docs), {"key": "id", "body": "content", "from": "instruction"})
    return rows.select("id", "content", F.coalesce("instruction", F.lit("")).alias("origin")).filter("content <> '' or origin <> ''")


@query("with n as (select doc_id, row_number() over (order by doc_id) - 1 line from documents) select line, 'question ' || doc_id instruction, 'answer ' || doc_id as output from n where line % 3 <> 1")
def read_seeds(spark, root):
    """Every third line is blank: it is no seed, but counts in the numbers of lines."""
    rows = table(spark, root, "documents").orderBy("doc_id").select("doc_id", (F.row_number().over(_by("doc_id")) - 1).alias("line"))
    text = F.when(F.col("line") % 3 == 1, "  ").otherwise(F.to_json(F.struct(F.concat(F.lit("question "), "doc_id").alias("prompt"), F.concat(F.lit("answer "), "doc_id").alias("response"))))
    folder = f"{shared_folder(spark, 'rows')}/seeds.jsonl"
    rows.orderBy("line").coalesce(1).select(text.alias("value")).write.text(folder)
    return readers.load_seeds(spark, folder).select(F.substring_index("id", ":", -1).cast("long").alias("line"), "instruction", "output")


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


def _adapter(fmt: str, role: str, tools: str, content: str = "messages[k].content"):
    sql = _MSG + f"select id, {tools} tools, cast(k - 1 as integer) turn, {role} role, {content} content from m"

    def run(spark, root):
        df = message_samples(spark, root)
        out = df.select("id", "messages", "tools") if fmt == "flat" else render.render(df, fmt)
        back = readers.to_samples(readers.read_json_rows(spark, _written(out)), fmt)
        return back.select("id", "tools", F.posexplode("messages").alias("turn", "m")).select("id", "tools", "turn", "m.role", "m.content")

    run.__name__ = f"adapter_{fmt}"
    query(sql)(run)


_SAID = "case when messages[k].role in ('user', 'assistant', 'system') then messages[k].role else 'user' end"
_adapter("chatml", "messages[k].role", "cast(null as varchar)")
_adapter("openai", "messages[k].role", "tools")
_adapter("flat", "messages[k].role", "tools")
_adapter("sharegpt", _SAID, "cast(null as varchar)", "coalesce(messages[k].content, '')")


@query("select cast(doc_id as varchar) id, coalesce(source, '') || ':' || coalesce(lang, '') instruction, coalesce(text, '') as output, 'file' origin, 0 n_problems from documents")
def adapter_alpaca(spark, root):
    """Documents rendered as alpaca rows and opened again, with the rules they break."""
    back = readers.open_file(spark, _written(render.alpaca(document_samples(spark, root))), "alpaca")
    return back.select("id", "instruction", "output", F.col("lineage")["input"].alias("origin"), F.size("problems").alias("n_problems"))


_META = [("object", '{"id": "a", "output": "x", "metadata": {"lineage": {"k": "v"}}}', ""), ("none", '{"id": "b", "output": "x"}', ""), ("list", '{"id": "c", "output": "x", "metadata": []}', "C4"), ("lineage", '{"id": "d", "output": "x", "metadata": {"lineage": 3}}', "C4"), ("both", '{"id": "e", "output": "x", "messages": [{"role": "user", "content": "y"}]}', ""), ("text", '{"id": "f", "output": "x", "metadata": "m"}', "C4")]


@query(literal([(json.loads(t)["id"], p) for _, t, p in _META], "id, problems"))
def metadata_rules(spark, root):
    """Rule C4 on what a file holds."""
    folder = f"{shared_folder(spark, 'rows')}/meta.jsonl"
    spark.createDataFrame([(t,) for _, t, _ in _META], "value string").coalesce(1).write.text(folder)
    return readers.open_file(spark, folder).select("id", F.array_join("problems", ",").alias("problems"))


@query(literal([(0, "a", 0.5, "k"), (1, "b", 0.0, None), (2, "c", 0.25, None), (3, "d", 0.25, None)], "pos, topic, weight, knowledge"))
def topic_weights(spark, root):
    return readers.load_topics(spark, [{"topic": "a", "weight": 2, "knowledge": "k"}, {"topic": "b", "weight": -1}, {"topic": "c"}, {"topic": "d", "weight": 1.0}])


@query(literal([("none", "ValueError"), ("nameless", "ValueError"), ("good", "1")], "tools, result"))
def tool_checks(spark, root):
    cases = {"none": [], "nameless": [{"function": {"parameters": {}}}], "good": [{"function": {"name": "f", "parameters": {}}}]}

    def result(tools):
        try:
            return str(len(readers.load_tools(tools)))
        except ValueError:
            return "ValueError"

    return spark.createDataFrame([(k, result(t)) for k, t in cases.items()], "tools string, result string")


# Plans and generation --------------------------------------------------------------------------------------------
_TOPICS, _LEVELS = ["physics", "history", "music"], ["easy", "hard"]
_TOPIC_SQL = """with n as (select unnest(range(600)) pos), p as (select pos, ['physics','history','music'][pos % 3 + 1] topic, ['easy','hard'][pos % 2 + 1] difficulty from n),
q as (select *, 'Reason step by step. Topic: ' || topic || chr(10) || 'Slots: {"difficulty": "' || difficulty || '"} Return JSON: {"instruction": "...", "output": "..."}' prompt from p)
"""


@query(_TOPIC_SQL + "select pos, substr(sha256('topic|deep_thinking|' || topic || '|difficulty=' || difficulty || '|' || pos), 1, 16) id from q")
def plan_deep(spark, root):
    return planners.PLANNERS["deep_thinking"](spark, _TOPICS, {"difficulty": _LEVELS}, 600).select("pos", "id")


@query(_TOPIC_SQL + "select pos, 'task ' || substr(sha256(prompt), 1, 8) instruction, 'answer ' || substr(sha256(prompt), 9, 32) as output, 'because ' || substr(sha256(prompt), 41, 8) reasoning, cast(null as varchar) drop_code from q")
def exec_deep(spark, root):
    specs = planners.PLANNERS["deep_thinking"](spark, _TOPICS, {"difficulty": _LEVELS}, 600)
    done = generate.execute_strategy(specs, "deep_thinking")
    return generate.collect_samples(done, "deep_thinking", require_reasoning=True).select("pos", "instruction", "output", "reasoning", "drop_code")


@query(_TOPIC_SQL.replace("Reason step by step. ", "") + "select pos, 'task ' || substr(sha256(prompt), 1, 8) instruction, '' reasoning from q")
def exec_topic(spark, root):
    done = generate.execute_strategy(planners.topic_plan(spark, _TOPICS, {"difficulty": _LEVELS}, 600), "topic_driven")
    return generate.collect_samples(done, "topic_driven").select("pos", "instruction", "reasoning")


@query("select unnest(range(40)) pos, 'empty_instruction' drop_code")
def exec_tool(spark, root):
    """The stand-in gives no dialogue, so there is none to check."""
    return generate.collect_samples(generate.execute_strategy(planners.tool_plan(spark, _TOPICS, 40), "tool_call"), "tool_call").select("pos", "drop_code")


_SEEDS = [{"id": f"s{i}", "instruction": f"question {i}", "output": f"answer {i}"} for i in range(5)]
_SHORTEN = [{"name": "shorten", "prompt": "make it {value}", "values": ["short", "tiny"]}]
_DRAWN = [(n, op, drawn[0], drawn[1] if op == "crossover" else None) for n, (op, drawn) in enumerate(planners.seed_draws(200, 5, 0.3, 0.3, [2], 42))]
_SEED_SQL = f"""with d as ({literal(_DRAWN, "n, op, i, j")}), s as (select *, substr(sha256('seed|s' || i || '|' || op || '|' || n), 1, 16) id from d),
e as (select *, 'Example 1:' || chr(10) || 'instruction: question ' || i || chr(10) || 'output: answer ' || i || case when j is not null then chr(10) || chr(10) || 'Example 2:' || chr(10) || 'instruction: question ' || j || chr(10) || 'output: answer ' || j else '' end
  || chr(10) || chr(10) || 'Task: ' || case when op = 'crossover' then 'Merge what example 1 asks with how example 2 answers into a new sample.' else 'Write another sample that could stand among the examples.' end
  || case when op = 'mutate' then chr(10) || 'Requirement: make it ' || ['short', 'tiny'][cast(('0x' || right(id, 1)) as integer) % 2 + 1] else '' end || chr(10) || 'Return JSON: {{"instruction": "...", "output": "..."}}' prompt from s)
"""


@query(_SEED_SQL + "select n pos, id, op, 's' || i seed_id, case when j is not null then 's' || j end seed_id_b, case when op = 'mutate' then 'shorten' end mutation from s")
def plan_seed(spark, root):
    """The draws follow the standard generator; ids and lineage are SQL's."""
    plan = planners.seed_plan(spark, _SEEDS, 200, 0.3, 0.3, _SHORTEN, seed=42)
    return plan.select("pos", "id", *[F.col("lineage")[k].alias(n) for k, n in (("operator", "op"), ("seed_id", "seed_id"), ("seed_id_b", "seed_id_b"), ("mutation", "mutation"))])


@query(_SEED_SQL + "select n pos, 'task ' || substr(sha256(prompt), 1, 8) instruction, 'answer ' || substr(sha256(prompt), 9, 32) as output from e")
def exec_seed(spark, root):
    """Examples, tasks and mutations with their values in the prompt."""
    done = generate.execute_strategy(planners.seed_plan(spark, _SEEDS, 200, 0.3, 0.3, _SHORTEN, seed=42), "seed_driven")
    return generate.collect_samples(done, "seed_driven").select("pos", "instruction", "output")


def _evolution() -> str:
    import random

    drawn = planners.evolution_draws(40, 0.7, 4, random.Random(7 + 3))
    rows = [(i, planners.DEPTH[at] if at is not None else None, stays) for i, (at, stays) in enumerate(drawn)]
    breadth = planners.BREADTH["prompt"]
    return f"""with d as ({literal(rows, "i, depth, stays")}), w as (select *, (case when depth is null then 0 else 1 end) + 1 + (case when stays then 1 else 0 end) slots from d),
s as (select *, coalesce(sum(slots) over (order by i rows between unbounded preceding and 1 preceding), 0) start from w),
t as (select i, start slot, depth mutation, depth prompt from s where depth is not null union all select i, start + case when depth is null then 0 else 1 end, 'breadth', '{breadth}' from s),
u as (select *, substr(sha256('evol|s' || i || '|r1|' || cast(slot as bigint)), 1, 16) id, 'Instruction to evolve: a question of some length ' || i || chr(10) || 'By [' || mutation || ']: ' || prompt || chr(10) || 'Return JSON: {{"instruction": "..."}}' asked from t)
"""


_FORTY = [{"id": f"s{i}", "instruction": f"a question of some length {i}"} for i in range(40)]


@query(_evolution() + "select row_number() over (order by i, slot) - 1 pos, id, 's' || i seed_id, mutation from u")
def plan_evol_first(spark, root):
    """The first round; its slots are numbered by a running sum in SQL."""
    plan = planners.evol_plan(spark, _FORTY, 40, rounds=1, seed=3)
    return plan.select("pos", "id", F.col("lineage")["seed_id"].alias("seed_id"), F.col("lineage")["mutation"].alias("mutation"))


@query(_evolution() + """, v as (select *, 'task ' || substr(sha256(asked), 1, 8) instruction from u)
select row_number() over (order by i, slot) - 1 pos, instruction, case when length(instruction) * 1.0 / length('a question of some length ' || i) between 0.48 and 5 then 'answer ' || substr(sha256(instruction), 9, 32) else '' end as output,
  case when length(instruction) * 1.0 / length('a question of some length ' || i) between 0.48 and 5 then null else 'ratio_bounds' end drop_code, '["a question of some length ' || i || '","' || instruction || '"]' chain from v""")
def exec_evol(spark, root):
    """Evolved instructions and, within the bounds of length, the second call that answers them."""
    ratio = (0.48, 5.0)
    done = generate.execute_strategy(planners.evol_plan(spark, _FORTY, 40, rounds=1, seed=3), "evol_instruct", ratio=ratio)
    out = generate.collect_samples(done, "evol_instruct", ratio=ratio)
    return out.select("pos", "instruction", "output", "drop_code", F.col("lineage")["evolution_chain"].alias("chain"))


def _docs(spark, root):
    return table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("pos"))


_WHOLE = """with d as (select doc_id, text, length(text) n, regexp_replace(text, '^""" + _SPACE + "+|" + _SPACE + """+$', '', 'g') chunk from documents where text is not null),
k as (select *, row_number() over (order by doc_id) - 1 pos from d where chunk <> ''), q as (select *, 'Source text:' || chr(10) || chunk || ' Return JSON: {"instruction": "...", "output": "..."}' prompt from k where pos < 400)
"""


@query(_WHOLE + "select pos, substr(sha256('docqa|' || doc_id || '|0|' || n), 1, 16) id from q")
def plan_document_whole(spark, root):
    """Whole texts as chunks; the budget of 400 is the plan's."""
    return planners.document_plan(_docs(spark, root), 400).select("pos", "id")


@query(_WHOLE + "select pos, 'task ' || substr(sha256(prompt), 1, 8) instruction, chunk source_text from q")
def exec_document(spark, root):
    done = generate.execute_strategy(planners.document_plan(_docs(spark, root), 400), "document_qa")
    return generate.collect_samples(done, "document_qa").select("pos", "instruction", F.col("lineage")["source_text"].alias("source_text"))


_PIECES = r"""with p as (select doc_id, unnest(regexp_split_to_array(text, '\n""" + _SPACE + r"""*\n')) para, unnest(range(len(regexp_split_to_array(text, '\n""" + _SPACE + r"""*\n')))) k from documents where text is not null),
o as (select *, length(para) size, coalesce(sum(length(para) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) place from p),
c as (select doc_id, k, place + step b, least(place + step + 1500, place + size) e from (select *, unnest(range(0, greatest(size, 1), 1500)) step from o where size > 0)),
g as (select *, sum(case when e - b >= 200 or f = 1 then 1 else 0 end) over (partition by doc_id order by k, b) piece from (select *, row_number() over (partition by doc_id order by k, b) f from c)),
r as (select doc_id, piece, min(b) b, arg_max(e, (k, b)) e from g group by all)
select doc_id, cast(b as integer) "start", cast(e as integer) "end" from r where e - b >= 30"""


@query(_PIECES)
def structure_chunk_ranges(spark, root):
    from gleaner.functions.chunking import structure_chunks

    return table(spark, root, "documents").select("doc_id", F.inline(structure_chunks(F.col("text"))))


@query(_PIECES.rsplit("select doc_id, cast", 1)[0] + """, q as (select r.doc_id, b, e from r join documents using (doc_id) where e - b >= 30 and regexp_replace(substr(text, cast(b + 1 as bigint), cast(e - b as bigint)), '^""" + _SPACE + "+|" + _SPACE + """+$', '', 'g') <> ''),
n as (select *, row_number() over (order by doc_id, b) - 1 pos from q) select pos, substr(sha256('docqa|' || doc_id || '|' || cast(b as bigint) || '|' || cast(e as bigint)), 1, 16) id from n where pos < 500""")
def plan_document_qa(spark, root):
    """Structure chunks in document order; the budget of 500 is the plan's."""
    return planners.document_plan(_docs(spark, root), 500, "structure").select("pos", "id")


_TURNS = r"""with t as (select doc_id, text, list_filter(regexp_extract_all(text, '(?s)[^。！？.!?\n]*[。！？.!?\n]|[^。！？.!?\n]+$'), lambda x: regexp_replace(x, '""" + _SPACE + r"""', '', 'g') <> '') ss from documents where text is not null),
x as (select doc_id, unnest(ss) x, unnest(range(len(ss))) k, len(ss) many, length(text) size from t where len(ss) > 1),
bytes_ as (select doc_id, k, length(x) n, unnest(range(1, strlen(x) + 1)) p, hex(encode(x)) h from x),
bag as (select doc_id, k, (cast('0x' || substr(h, 2 * p - 1, 2) as integer) * 7 + n) % 32 cell, count(*) c from bytes_ group by all),
nrm as (select doc_id, k, sqrt(sum(c * c)) z from bag group by all), vec as (select bag.doc_id, bag.k, cell, round(c / z, 6) v from bag join nrm using (doc_id, k)),
len_ as (select doc_id, k, sqrt(sum(v * v)) z from vec group by all),
cs as (select a.doc_id, b.k, sum(a.v * b.v) dot from vec a join vec b on a.doc_id = b.doc_id and b.k = a.k + 1 and a.cell = b.cell group by all),
edge as (select x.doc_id, x.k, sum(length(x.x)) over (partition by x.doc_id order by x.k rows between unbounded preceding and 1 preceding) place, x.size from x),
cuts as (select e.doc_id, e.place from edge e join len_ a on a.doc_id = e.doc_id and a.k = e.k - 1 join len_ b on b.doc_id = e.doc_id and b.k = e.k left join cs on cs.doc_id = e.doc_id and cs.k = e.k where coalesce(dot, 0) / (a.z * b.z) < 0.8),
every as (select doc_id, place from cuts union select distinct doc_id, 0 from x union select distinct doc_id, size from x),
rng as (select doc_id, place b, lead(place) over (partition by doc_id order by place) e from every)
select doc_id, cast(b as integer) "start", cast(e as integer) "end" from rng where e > b union all select doc_id, 0, length(text) from t where len(ss) < 2"""


@query(_TURNS.replace("\\n", "\n"))
def semantic_chunk_turns(spark, root):
    """Chunks cut only where neighbouring sentences' vectors turn, the stand-in vectors worked out in SQL."""
    from gleaner.functions.chunking import semantic_chunks

    return table(spark, root, "documents").filter("text is not null").select("doc_id", F.inline(semantic_chunks(F.col("text"), 0.8, 1 << 30)))


_BT = _NORM.format("text")


@query(f"""with d as (select doc_id, {_BT} t from documents), k as (select *, row_number() over (order by doc_id) - 1 pos from d where length(t) between 50 and 4000),
q as (select *, 'task ' || substr(sha256('Write the instruction that this text answers:' || chr(10) || t || ' Return JSON: {{"instruction": "...", "output": "..."}}'), 1, 8) instruction from k)
select substr(sha256('bt|' || doc_id || '|' || pos || '|' || length(t)), 1, 16) id, instruction, cast(null as varchar) drop_code from q""")
def generated_samples(spark, root):
    """All documents through a backtranslation plan, the stand-in model and the sample filters."""
    specs = planners.backtranslation_plan(_docs(spark, root), None)
    done = generate.execute_strategy(specs, "instruction_backtranslation")
    return generate.collect_samples(done, "instruction_backtranslation").select("id", "instruction", "drop_code")


@query(literal([("a", 6), ("b", 1), ("c", 1)], "strategy, n"))
def preview_split(spark, root):
    return spark.createDataFrame(planners.preview([("a", 90), ("b", 9), ("c", 1)], 8), "strategy string, n long")


@query("select pos * 2 pos, 'topic_driven' strategy from (select unnest(range(6)) pos) union all select pos * 2 + 1, 'tool_call' from (select unnest(range(3)) pos)")
def merged_strategies(spark, root):
    """Samples of two strategies by turns."""
    from gleaner.flow import _merged

    parts = [planners.topic_plan(spark, _TOPICS, {}, 6), planners.tool_plan(spark, _TOPICS, 3)]
    return _merged([p.select("pos", "strategy") for p in parts])


_REPLIES = [("plain", '{"b": 1, "a": "x"}', '{"a": "x", "b": 1}'), ("fence", '```json\n{"a": [1, 2]}\n```', '{"a": [1, 2]}'), ("talk", 'Here: {"a": {"b": 2}} and {"c": 3}', '{"a": {"b": 2}}'), ("broken", '{"a": 1', None), ("list", '[{"a": 1}]', '{"a": 1}'), ("none", "no object", None), ("second", '{no} {"a": 1}', '{"a": 1}'), ("null", None, None)]


@query(literal([(k, want) for k, _, want in _REPLIES], "kind, object"))
def reply_cases(spark, root):
    return spark.createDataFrame([(k, r) for k, r, _ in _REPLIES], "kind string, reply string").select("kind", extract_json(F.col("reply")).alias("object"))


def _call(i="1", name="f", arguments="{}"):
    return {"role": "assistant", "tool_calls": [{"id": i, "function": {"name": name, "arguments": arguments}}]}


_RESULT, _SAYS = {"role": "tool", "tool_call_id": "1", "content": "r"}, {"role": "assistant", "content": "done"}
_TRAJECTORIES = [
    ("whole", [_call(), _RESULT, _SAYS], None), ("no result", [_call(), _SAYS], "broken_chain:no_result"), ("open end", [_call()], "broken_chain:no_result"), ("orphan", [_RESULT], "broken_chain:orphan_result"),
    ("no id", [_call("")], "missing_call_id"), ("twice", [_call(), _RESULT, _call()], "duplicate_call_id"), ("unknown", [_call(name="g")], "unknown_function:g"), ("arguments", [_call(arguments="{")], "invalid_arguments_json"), ("no tools", [_SAYS], None),
]


@query(literal([(k, want) for k, _, want in _TRAJECTORIES], "kind, problem"))
def trajectory_cases(spark, root):
    df = spark.createDataFrame([(k, json.dumps(m)) for k, m, _ in _TRAJECTORIES], "kind string, messages string")
    return df.select("kind", validate_trajectory(F.col("messages"), F.lit('[{"function": {"name": "f"}}]')).alias("problem"))


@query(literal([(1, 1.0, 0.8333), (2, 1.5, 0.75), (3, None, 0.0), (4, None, 0.0)], "id, nll, quality"))
def prompt_logprobs(spark, root):
    payloads = [(1, '{"choices":[{"logprobs":{"prompt_logprobs":[null,{"123":-0.5},{"7":-1.5}]}}]}'), (2, '{"choices":[{"logprobs":{"token_logprobs":[-2.0,null,-1.0]}}]}'), (3, "broken"), (4, '{"choices":[]}')]
    df = spark.createDataFrame(payloads, "id int, payload string").withColumn("lp", T.parse_prompt_logprobs(F.col("payload")))
    return df.select("id", T.mean_token_nll(F.col("lp")).alias("nll"), T.nll_quality(T.mean_token_nll(F.col("lp"))).alias("quality"))


_REFERS = [("根据上文回答", True), ("As Mentioned Above, why?", True), ("based on the text, list", True), ("base the text on this", False), ("", False), (None, False)]


@query(literal([(i, want) for i, (_, want) in enumerate(_REFERS)], "i, refers"))
def context_references(spark, root):
    return spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_REFERS)], "i int, t string").select("i", T.context_reference(F.col("t")).alias("refers"))


_LINES = ['{"output": "x"}', '{"id": "own", "output": "y"}', "", '{"output": "z", "metadata": {"id": "meta"}}', '{"output": "x"}']


def _made(line: str, pos: int) -> str:
    import hashlib

    return f"file:flat:{hashlib.sha256(line.encode()).hexdigest()[:16]}:{pos}"


@query(literal([(0, _made(_LINES[0], 0)), (1, "own"), (3, "meta"), (4, _made(_LINES[4], 4))], "pos, id"))
def row_ids(spark, root):
    """Ids of rows: their own, that of their metadata, else made of content and place."""
    folder = f"{shared_folder(spark, 'rows')}/ids.jsonl"
    spark.createDataFrame([(x,) for x in _LINES], "value string").coalesce(1).write.text(folder)
    return readers.to_samples(readers.read_json_rows(spark, folder)).select("pos", "id")


@query(f"with t as (select doc_id, regexp_replace(regexp_replace(text, '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g') x from documents where text is not null) select doc_id, cast(len(list_distinct(list_transform(range(1, greatest(length(x) - 1, 1)), lambda i: substr(x, i, 3)))) as integer) n from t")
def shingle_counts(spark, root):
    """Distinct character 3-grams of collapsed texts."""
    return table(spark, root, "documents").filter("text is not null").select("doc_id", F.size(T.shingles(F.col("text"))).alias("n"))


@query("""with ch as (select doc_id, text, unnest(range(1, length(text) + 1)) i from documents where text <> ''), cc as (select doc_id, i, substr(text, i, 1) c from ch),
cr as (select doc_id, c, i - row_number() over (partition by doc_id, c order by i) g from cc), rl as (select doc_id, max(n) run from (select doc_id, c, g, count(*) n from cr group by all) group by 1)
select d.doc_id, round(coalesce(run, 0) * 1.0 / greatest(length(text), 1), 6) share from documents d left join rl using (doc_id) where text is not null""")
def longest_runs(spark, root):
    """Longest run of one character, by islands in SQL."""
    return table(spark, root, "documents").filter("text is not null").select("doc_id", F.round(T.longest_run_ratio(F.col("text")), 6).alias("share"))


@query("select cast(doc_id as varchar) id, coalesce(text, '') as output from documents where coalesce(text, '') <> '' or coalesce(source, '') <> ''")
def read_state(spark, root):
    """A state's rows opened again as an input: the rendered text, the payload where there is none."""
    docs = document_samples(spark, root).withColumn("instruction", F.regexp_replace("instruction", ":[^:]*$", ""))
    state = State(spark, shared_folder(spark, "state"))
    text = F.when(F.col("pos") % 2 == 0, render.rendered(docs, "alpaca"))
    state.add("samples", docs.select("id", "strategy", render.payload(docs).alias("payload"), text.alias("rendered"), F.lit(1.0).alias("total_score"), F.current_timestamp().alias("created_at")))
    return readers.to_samples(readers.read_state_rows(spark, state.root)).select("id", "output")


# Judges ----------------------------------------------------------------------------------------------------------
_DIMS = [scoring.Dimension("quality", 10.0, "how good"), scoring.Dimension("safety", 5.0)]
_JUDGED = """with p as (select doc_id, sha256('Rate this sample, 1 for worst, in each of: quality (1..10, how good); safety (1..5, safety)' || chr(10) || chr(10) || 'instruction: ' || coalesce(source, '') || ':' || coalesce(lang, '') || chr(10) || 'output: ' || coalesce(text, '')
  || chr(10) || chr(10) || 'Form of the answer: {"scores": {"dimension": number}}') h from documents),
s as (select doc_id, case when doc_id % 4 = 0 then 2.0 else 1 + cast('0x' || substr(h, 1, 2) as integer) % 10 end quality, case when doc_id % 4 = 0 then null else 1 + cast('0x' || substr(h, 3, 2) as integer) % 5 end safety from p)
"""


def _judge_rows(spark, root, **more):
    """The model's scores of all documents; every fourth was scored before."""
    docs = document_samples(spark, root)
    cache = docs.filter("pos % 4 = 0").select("id", F.lit("llm").alias("endpoint"), F.lit('{"quality": 2.0}').alias("scores"))
    return docs, scoring.judge_scores(docs, _DIMS, cache=cache, **more)


@query(_JUDGED + "select cast(doc_id as varchar) sample_id, cast(quality as double) quality, cast(safety as double) safety from s")
def llm_judge(spark, root):
    """Prompt, reply, clamped scores and the cache in front of the model."""
    rows = _judge_rows(spark, root)[1]
    return rows.select("sample_id", F.col("scores")["quality"].alias("quality"), F.col("scores")["safety"].alias("safety"))


@query(_JUDGED + "select cast(doc_id as varchar) id, round(cast(quality + coalesce(safety, 0) as double), 6) total, case when quality + coalesce(safety, 0) < 6 then 'min_total' end drop_code, 'llm' score_source from s")
def llm_judge_total(spark, root):
    docs, rows = _judge_rows(spark, root)
    out = judge.judged(docs, scoring.long_scores(rows), {d.name: d.most for d in _DIMS}, min_total=6.0)
    return out.select("id", F.round("total", 6).alias("total"), "drop_code", "score_source")


def _third(p: float):
    return lambda: lambda line: (len(line) % 7) / 7


_LOCAL = "with t as (select doc_id, coalesce(source, '') || ':' || coalesce(lang, '') || chr(10) || coalesce(text, '') core from documents), p as (select doc_id, core, (length(core) % 7) / 7.0::double p from t)\n"


@query(_LOCAL + """select cast(doc_id as varchar) sample_id, dim, value from (select doc_id, 'coherence' dim, round(0.5 * p + 0.5 * least(length(core) / 200.0::double, 1.0), 4) value from p
union all select doc_id, 'fluency', round(p, 4) from p union all select doc_id, 'diversity', 0.5 from p)""")
def fasttext_scores(spark, root):
    """The local scorer over a stand-in for the classifier; an unknown dimension is neutral."""
    return scoring.fasttext_scores(document_samples(spark, root), _third(0.5), ["coherence", "fluency", "diversity"]).select("sample_id", "dim", "value")


@query(_LOCAL + "select cast(doc_id as varchar) id, round(round(p, 4) * 10 * 0.5, 3) total, cast(null as varchar) drop_code, 'fasttext' score_source from p")
def local_judge(spark, root):
    """Local scorers without any remote judge: no gate on judges applies."""
    docs = document_samples(spark, root)
    local = scoring.fasttext_scores(docs, _third(0.5), ["fluency"], weight=0.5)
    out = judge.judged(docs, None, {"fluency": 10.0}, min_judges=2, local=local, labels=["fasttext"])
    return out.select("id", F.round("total", 3).alias("total"), "drop_code", "score_source")


def _complete(mode: str):
    def factory():
        def ask(body: dict) -> dict:
            if len(body["prompt"]) % 11 == 0:
                raise TimeoutError("no answer")
            logs = [-(len(body["prompt"]) % 5), None, -(body["max_tokens"] % 4)]
            return {"choices": [{"logprobs": {"prompt_logprobs": [None if x is None else {"t": x} for x in logs]} if mode == "teacher_forced" else {"token_logprobs": logs}}]}

        return ask

    return factory


_CUT = _LOCAL.rsplit(", p as", 1)[0] + ", c as (select doc_id, substr(core, 1, 4000) x from t), k as (select doc_id, x, greatest(16, cast(floor(length(x) * 0.5) as bigint)) place from c),\n"
_ASKED = {
    "continuation": _CUT + "q as (select doc_id, least(place, length(x)) n, least(256, greatest(8, greatest(length(x) - place, 0) // 2 + 8)) m from k)\n",
    "teacher_forced": _CUT + "q as (select doc_id, length(x) n, 1 m from k)\n",
}


def _perplexity(mode: str):
    def run(spark, root):
        scores, failed = scoring.perplexity(document_samples(spark, root), _complete(mode), mode, ["natural"])
        return scores.select("sample_id", "value", F.lit(None).cast("string").alias("reason")).unionByName(failed.select("sample_id", F.lit(None).cast("double").alias("value"), "reason"))

    run.__name__ = f"perplexity_{mode}"
    query(_ASKED[mode] + "select cast(doc_id as varchar) sample_id, case when n % 11 = 0 then null else round(1 - (n % 5 + m % 4) / 2.0 / 6.0::double, 4) end value, case when n % 11 = 0 then 'scorer_error:TimeoutError' end reason from q")(run)


for _mode in _ASKED:
    _perplexity(_mode)


# State, caches and sinks -----------------------------------------------------------------------------------------
@query("select cast(doc_id as varchar) id from documents where doc_id % 3 <> 0 and doc_id % 5 <> 0")
def terminal_anti_join(spark, root):
    """Specs left after what the state has committed or dropped."""
    state, docs = State(spark, shared_folder(spark, "state")), _docs(spark, root).select("id", "pos")
    state.add("samples", docs.filter("pos % 3 = 0").select("id", F.lit("s").alias("strategy"), F.lit("{}").alias("payload"), F.lit(None).cast("string").alias("rendered"), F.lit(1.0).alias("total_score"), F.current_timestamp().alias("created_at")))
    state.add("dropped", docs.filter("pos % 5 = 0").select("id", F.lit("s").alias("strategy"), F.lit("length").alias("stage"), F.lit("output_len").alias("reason")))
    return state.open_specs(docs).select("id")


@query("select cast(doc_id as varchar) id from documents where doc_id % 3 = 0 or doc_id % 5 = 0")
def state_union(spark, root):
    state, docs = State(spark, shared_folder(spark, "state")), _docs(spark, root).select("id", "pos")
    state.add("samples", docs.filter("pos % 3 = 0").select("id", F.lit("s").alias("strategy"), F.lit("{}").alias("payload"), F.lit(None).cast("string").alias("rendered"), F.lit(1.0).alias("total_score"), F.current_timestamp().alias("created_at")))
    state.add("dropped", docs.filter("pos % 5 = 0").select("id", F.lit("s").alias("strategy"), F.lit("length").alias("stage"), F.lit("output_len").alias("reason")))
    return state.terminal()


@query("select cast(doc_id as varchar) id, 'document' strategy, coalesce(source, '') || ':' || coalesce(lang, '') instruction, coalesce(text, '') as output, cast(doc_id % 7 as double) total_score from documents")
def state_export(spark, root):
    """Samples through the state's payload into the columnar export."""
    docs = document_samples(spark, root).filter("pos is not null")
    state, folder = State(spark, shared_folder(spark, "state")), shared_folder(spark, "export")
    rows = docs.select("id", "strategy", render.payload(docs).alias("payload"), render.rendered(docs, "alpaca").alias("rendered"), (F.col("pos") % 7).cast("double").alias("total_score"), F.current_timestamp().alias("created_at"))
    state.add("samples", rows)
    render.write_export(render.export_rows(state.read("samples")), f"{folder}/samples.parquet")
    return spark.read.parquet(f"{folder}/samples.parquet").select("id", "strategy", "instruction", "output", "total_score")


@query("select cast(doc_id as varchar) id, case when doc_id % 2 = 0 then 'rendered ' || doc_id else 'payload ' || doc_id end as value from documents")
def state_lines(spark, root):
    """The rendered text of the state's rows, the payload where there is none, as lines."""
    docs = _docs(spark, root)
    state, folder = State(spark, shared_folder(spark, "state")), shared_folder(spark, "lines")
    state.add("samples", docs.select("id", F.lit("s").alias("strategy"), F.concat(F.lit("payload "), "id").alias("payload"), F.when(F.col("pos") % 2 == 0, F.concat(F.lit("rendered "), "id")).alias("rendered"), F.lit(1.0).alias("total_score"), F.current_timestamp().alias("created_at")))
    render.write_lines(state.read("samples"), folder)
    return spark.read.text(folder).select(F.substring_index("value", " ", -1).alias("id"), "value")


@query("""with w as (select text_hash, model, bool_or(vec is not null) cached from text_vectors group by all) select text_hash, model, case when cached then 'cached' else 'new' end origin from w""")
def cache_lookaside(spark, root):
    """Answers by content: the cached ones reused, the missing ones computed once."""
    vectors = table(spark, root, "text_vectors").select("text_hash", "model", "vec")
    cache = vectors.filter("vec is not null").select("text_hash", "model", F.lit("cached").alias("origin")).distinct()
    found, _ = generate.look_up(vectors.select("text_hash", "model").distinct(), cache, lambda missing: missing.withColumn("origin", F.lit("new")), ["text_hash", "model"])
    return found


@query("with d as (select distinct text from documents where text is not null) select sha256(text) h, case when length(text) % 2 = 0 then -1.0 else cast(length(text) as double) end first from d")
def embedding_cache(spark, root):
    """Texts embedded once by content; those of even length were embedded before."""
    texts = table(spark, root, "documents").filter("text is not null").select(F.sha2("text", 256).alias("h"), "text").distinct()
    cache = texts.filter(F.length("text") % 2 == 0).select(F.col("h").alias("text_hash"), F.lit("m").alias("model"), F.array(F.lit(-1.0)).alias("vec"))
    other = cache.withColumn("model", F.lit("other")).withColumn("vec", F.array(F.lit(-2.0)))
    vectors = embedding.embedder(lambda: lambda ts: [[float(len(t))] for t in ts], "m", 32, cache.unionByName(other))
    return vectors(texts).select("h", F.col("vec")[0].alias("first"))


_LAYOUTS = [("x/out", {}, "x/out/state", None, "x/out/samples.parquet"), ("x/out/", {"export_format": "jsonl", "table": "t"}, "x/out/state", None, "x/out/t.jsonl"), ("x/o.jsonl", {}, None, "x/o.jsonl", None), ("x/o", {"type": "jsonl"}, None, "x/o", None), ("x/o", {"export_format": None, "table": "u"}, "x/o/state", None, None)]


@query(literal([(i, *want) for i, (_, _, *want) in enumerate(_LAYOUTS)], "i, state, lines, export"))
def output_layout(spark, root):
    rows = [(i, *[render.layout(path, storage)[k] for k in ("state", "lines", "export")]) for i, (path, storage, *_) in enumerate(_LAYOUTS)]
    return spark.createDataFrame(rows, "i int, state string, lines string, export string")


@query(literal([("llm_calls=3 retried=1 embed_calls=2 cache_hits=5",), ("3 in, 2 out\n  length output_len: 1\nscored=2 mean=9.0 [5-10: 1, 10-15: 1]\nllm_calls=0 retried=0 embed_calls=0 cache_hits=0",)], "line"))
def report_lines(spark, root):
    lines = [report.cost(3, 1, 2, 5), report.text_report([("kept", "", 2), ("length", "output_len", 1)], [(5, 1, 6.0), (10, 1, 12.0)], report.cost())]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("""with s as (select cast(doc_id as varchar) id, doc_id pos, coalesce(source, '') || ':' || coalesce(lang, '') || chr(10) || coalesce(text, '') core from documents)
select id, case when row_number() over (partition by sha256(core) order by pos, id) > 1 then 'duplicate' end drop_code from s""")
def streaming_exact_dedup(spark, root):
    """Documents as a stream; the result equals exact_dedup when files arrive in order. Every call has folders of its own."""
    from gleaner.streaming.flows import stream_dedup

    base = shared_folder(spark, "stream")
    source = table(spark, root, "documents")
    source.repartitionByRange(2, "doc_id").write.parquet(f"{base}/in")
    raw = spark.readStream.schema(source.schema).parquet(f"{base}/in")
    named = F.concat(F.coalesce("source", F.lit("")), F.lit(":"), F.coalesce("lang", F.lit("")))
    samples = as_samples(raw, id=F.col("doc_id"), strategy=F.lit("document"), instruction=named, output=F.coalesce("text", F.lit("")), pos=F.col("doc_id"))
    keep = lambda df, n: df.select("id", "drop_code").write.mode("overwrite").parquet(f"{base}/out/batch_id={n}")
    stream_dedup(samples, State(spark, f"{base}/state"), f"{base}/checkpoint", keep).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id", F.regexp_replace("drop_code", r"\(resume\)", "").alias("drop_code"))
