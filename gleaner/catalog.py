"""Every query of the core library by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner import catalog_flows
from gleaner.functions.chunking import semantic_chunks
from gleaner.functions.replies import extract_json, validate_trajectory
from gleaner.operators import judge, render, report, stages
from gleaner.operators.model import core_text, document_samples, message_samples, validated
from gleaner.operators.state import latest
from gleaner.plans import planners
from gleaner.session import shared_folder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Documents as flat samples, and message-form samples, in the oracle's SQL.
_DOC = """with s as (select cast(doc_id as varchar) id, doc_id pos, coalesce(source, '') || ':' || coalesce(lang, '') instruction,
  coalesce(text, '') output, coalesce(source, '') || ':' || coalesce(lang, '') || chr(10) || coalesce(text, '') core from documents)
"""
_MSG = """with m as (select id, strategy, messages, tools, reasoning from (
  select *, row_number() over (partition by id order by created_at desc, total_score desc nulls last) rn from samples where messages is not null and id is not null) where rn = 1)
"""
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(_DOC + "select id, case when id = '' then 1 else 0 end + case when (instruction <> '' or output <> '') then 0 else 1 end n_problems from s")
def ingest_validate(spark, root):
    return validated(document_samples(spark, root)).select("id", F.size("problems").alias("n_problems"))


@query("select doc_id, substr(sha256('doc|' || coalesce(source, 'None') || '|' || cast(doc_id as varchar)), 1, 16) derived from documents")
def derive_id(spark, root):
    return table(spark, root, "documents").select("doc_id", T.derive_id(F.lit("doc"), F.col("source"), F.col("doc_id")).alias("derived"))


@query(_DOC + "select id, sha256(core) fingerprint from s")
def fingerprint(spark, root):
    df = document_samples(spark, root)
    return df.select("id", T.fingerprint(core_text(df)).alias("fingerprint"))


@query(_MSG + "select id, sha256(array_to_string(list_transform(messages, lambda x: coalesce(x.role, 'None') || ':' || coalesce(x.content, 'None')), chr(10))) fingerprint from m")
def fingerprint_messages(spark, root):
    df = message_samples(spark, root)
    return df.select("id", T.fingerprint(core_text(df)).alias("fingerprint"))


@query(_DOC + """, g as (select id, case when length(instruction) not between 5 and 4000 then 'instruction_len' when length(output) not between 200 and 3000 then 'output_len' end drop_code,
  case when length(instruction) not between 5 and 4000 then length(instruction) when length(output) not between 200 and 3000 then length(output) end v from s)
select id, drop_code, cast(v as double) drop_value from g""")
def length_gate_flat(spark, root):
    return stages.length_gate(output=(200, 3000))(document_samples(spark, root)).select("id", "drop_code", "drop_value")


@query(_MSG + """, l as (select id, coalesce(length(list_filter(messages, lambda x: x.role in ('user', 'human'))[1].content), 0) i,
  coalesce(list_sum(list_transform(messages, lambda x: coalesce(length(x.content), 0))), 0) o from m)
select id, case when i not between 5 and 4000 then 'instruction_len' when o not between 10 and 600 then 'output_len' end drop_code,
  cast(case when i not between 5 and 4000 then i when o not between 10 and 600 then o end as double) drop_value from l""")
def length_gate_messages(spark, root):
    return stages.length_gate(output=(10, 600))(message_samples(spark, root)).select("id", "drop_code", "drop_value")


@query(_DOC + """, f as (select id, row_number() over (partition by sha256(core) order by pos, id) rn, first_value(id) over (partition by sha256(core) order by pos, id) lead from s)
select id, case when rn > 1 then 'duplicate' end drop_code, case when rn > 1 then lead end drop_by from f""")
def exact_dedup(spark, root):
    return stages.exact_dedup()(document_samples(spark, root)).select("id", "drop_code", "drop_by")


@query(_DOC + """, h as (select distinct sha256(core) f from s where pos % 2 = 0),
n as (select id, sha256(core) f, row_number() over (partition by sha256(core) order by pos, id) rn from s where pos % 2 = 1)
select n.id, case when rn > 1 then 'duplicate' when h.f is not null then 'duplicate(resume)' end drop_code from n left join h on n.f = h.f""")
def exact_dedup_resume(spark, root):
    """Even documents are the accepted history, odd ones arrive: two runs over one table, every row in one of them."""
    df = document_samples(spark, root)
    old = df.filter("pos % 2 = 0")
    return stages.exact_dedup(old.select(T.fingerprint(core_text(old)).alias("hash")))(df.filter("pos % 2 = 1")).select("id", "drop_code")


_CLASS = r"[\p{L}\p{N}\s\x{1c}-\x{1f}\x{85}\p{Z}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"
_STATS = _DOC + f""", w as (select id, core, regexp_extract_all(core, '([\\p{{L}}\\p{{N}}_]+)', 1) words, list_distinct(list_transform(range(1, greatest(length(core) - 1, 1)), lambda i: substr(core, i, 3))) grams from s)
select id, round(length(regexp_replace(core, '{_CLASS}', '', 'g')) / length(core), 6) special_char_ratio,
  round(case when len(words) = 0 then 0.0 else 1 - (select count(*) from (select x from (select unnest(words) x) group by x having count(*) = 1)) * 1.0 / len(words) end, 6) word_repetition,
  round(case when length(core) < 3 then 1.0 else len(grams) * 1.0 / (length(core) - 2) end, 6) ngram_diversity from w"""


@query(_STATS)
def stats_features(spark, root):
    df = document_samples(spark, root)
    found = stages.text_statistics(core_text(df))
    return df.select("id", *[F.round(found[k], 6).alias(k) for k in ("special_char_ratio", "word_repetition", "ngram_diversity")])



_RUNS = """, ch as (select id, unnest(range(1, length(core) + 1)) i, core from s), cc as (select id, i, substr(core, i, 1) c from ch),
 cr as (select id, c, i - row_number() over (partition by id, c order by i) g from cc), rl as (select id, max(n) run from (select id, c, g, count(*) n from cr group by all) group by id),
"""
_GATE = """ st as (select f.id, f.special_char_ratio sp, coalesce(rl.run, 0) * 1.0 / greatest(f.size, 1) ru, f.word_repetition wo, f.ngram_diversity di from f left join rl using (id)),
 gt as (select id, case when sp > 0.3 then 'special_char_ratio' when ru > 0.5 then 'char_repetition' when wo > 0.5 then 'word_repetition' when di < 0.2 then 'ngram_diversity' end code,
  round(case when sp > 0.3 then sp when ru > 0.5 then ru when wo > 0.5 then wo when di < 0.2 then di end, 4) v from st)
"""
#: The statistics unrounded, for the gates; an empty text has no special characters.
_FEATURES = f""" fw as (select id, core, regexp_extract_all(core, '([\\p{{L}}\\p{{N}}_]+)', 1) words, list_distinct(list_transform(range(1, greatest(length(core) - 1, 1)), lambda i: substr(core, i, 3))) grams from s),
 f as (select id, length(core) size, length(regexp_replace(core, '{_CLASS}', '', 'g')) / length(core) special_char_ratio,
  case when len(words) = 0 then 0.0 else 1 - (select count(*) from (select x from (select unnest(words) x) group by x having count(*) = 1)) * 1.0 / len(words) end word_repetition,
  case when length(core) < 3 then 1.0 else len(grams) * 1.0 / (length(core) - 2) end ngram_diversity from fw),
"""


@query(_DOC + _RUNS + _FEATURES + _GATE + "select id, code drop_code, v drop_value from gt")
def stats_gate(spark, root):
    """The longest run by islands of equal characters in SQL."""
    return stages.stats_gate()(document_samples(spark, root)).select("id", "drop_code", "drop_value")


def _first_wins_sql(nodes: str, pairs: str, rounds: int = 12) -> str:
    """CTEs that keep the earliest: kept(n), from tables nodes(n) and pairs(a earlier, b) of close ones. Round after round a
    node is kept if all its earlier neighbours are dropped, and dropped if one is kept; what is open after the last round
    is in neither, so too few rounds would show."""
    out = [f"k0 as (select n from {nodes} where n not in (select b from {pairs}))", "d0 as (select n from k0 where false)"]
    for i in range(1, rounds + 1):
        out.append(f"d{i} as (select n from d{i - 1} union select b from {pairs} where a in (select n from k{i - 1}))")
        out.append(f"k{i} as (select n from k{i - 1} union select n from {nodes} where n not in (select n from d{i}) and n not in (select b from {pairs} where a not in (select n from d{i})))")
    return ", ".join([*out, f"kept as (select n from k{rounds}), gone as (select n from d{rounds})"])


#: Word shingles of the rows of table o(id, pos, core), the earliest of each set standing for all, and the close ones.
_NEAR = r""" mw as (select id, pos, regexp_extract_all(lower(core), '([\p{L}\p{N}_]+)', 1) w from o),
 mg as (select id, pos, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], chr(31))))) g from mw),
 ml as (select id, pos, g, first_value(id) over (partition by g order by pos, id) lead from mg), nodes as (select pos n, id, len(g) size, g from ml where id = lead),
 sh as (select n, size, unnest(g) x from nodes), pairs as (select a.n a, b.n b from sh a join sh b on a.x = b.x and a.n < b.n group by a.n, b.n, a.size, b.size having count(*) >= 0.8 * (a.size + b.size - count(*))),
"""
_NEAR_MARKS = """, mby as (select l.id, coalesce(arg_min(k.id, p.a), case when l.id <> l.lead then l.lead end) by_ from ml l join nodes m on m.id = l.lead left join pairs p on p.b = m.n and p.a in (select n from kept) left join nodes k on k.n = p.a group by l.id, l.lead)
"""


@query(_DOC + ", o as (select id, pos, core from s)," + _NEAR + _first_wins_sql("nodes", "pairs") + _NEAR_MARKS + "select s.id, case when mby.by_ is not null then 'near_dup' end drop_code, mby.by_ drop_by from s left join mby on mby.id = s.id")
def minhash_dedup(spark, root):
    """All pairs of shingle sets in SQL by an inverted index, and the earliest kept."""
    return stages.minhash_dedup()(document_samples(spark, root)).select("id", "drop_code", "drop_by")


@query("with nodes as (select vec_id n from embeddings), pairs as (select a.vec_id a, b.vec_id b from embeddings a join embeddings b on a.vec_id < b.vec_id where list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.4), "
       + _first_wins_sql("nodes", "pairs") + " select n id, n in (select n from kept) kept, (select min(a) from pairs where b = nodes.n and a in (select n from kept)) \"by\" from nodes")
def semantic_dedup_040(spark, root):
    return stages.semantic_kept(_vectors(spark, root), 0.40)


@query(_DOC + """, g as (select *, case when length(instruction) not between 5 and 4000 then 'instruction_len' when length(output) not between 200 and 8000 then 'output_len' end a from s),
h as (select *, case when a is null then row_number() over (partition by a is null, sha256(core) order by pos, id) end rn, first_value(id) over (partition by a is null, sha256(core) order by pos, id) lead from g)""" + _RUNS + _FEATURES + _GATE
       + """, o as (select h.id, h.pos, h.core from h join gt on gt.id = h.id where h.a is null and h.rn = 1 and gt.code is null),""" + _NEAR + _first_wins_sql("nodes", "pairs") + _NEAR_MARKS
       + """select h.id, case when a is not null then 'length' when rn > 1 then 'exact_dedup' when gt.code is not null then 'stats' when mby.by_ is not null then 'minhash_dedup' end drop_stage,
  case when a is not null then a when rn > 1 then 'duplicate' when gt.code is not null then gt.code when mby.by_ is not null then 'near_dup' end drop_code,
  case when a is not null then null when rn > 1 then lead when gt.code is not null then null else mby.by_ end drop_by from h join gt on gt.id = h.id left join mby on mby.id = h.id""")
def full_clean_flow(spark, root):
    flow = stages.pipeline(stages.length_gate(output=(200, 8000)), stages.exact_dedup(), stages.stats_gate(), stages.minhash_dedup())
    return flow(document_samples(spark, root)).select("id", "drop_stage", "drop_code", "drop_by")


@query(r"select doc_id, regexp_replace(regexp_replace(text, '[\x{0}-\x{8}\x{b}-\x{1f}\x{7f}-\x{9f}\p{Cf}]', '', 'g'), '^" + _SPACE + "+|" + _SPACE + r"+$', '', 'g') normalized from documents")
def normalize_text(spark, root):
    return table(spark, root, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))



@query(_MSG + """select id, cast(generate_subscripts(messages, 1) - 1 as integer) turn, unnest(list_transform(messages, lambda x: case x.role when 'user' then 'human' when 'assistant' then 'gpt' when 'system' then 'system' else 'user' end)) speaker,
  unnest(list_transform(messages, lambda x: coalesce(x.content, ''))) value from m""")
def render_sharegpt(spark, root):
    out = render.sharegpt(message_samples(spark, root))
    return out.select("metadata.id", F.posexplode("conversations").alias("turn", "c")).select("id", "turn", F.col("c.from").alias("speaker"), "c.value")


@query(_MSG + "select id, tools, cast(generate_subscripts(messages, 1) - 1 as integer) turn, unnest(list_transform(messages, lambda x: x.role)) role, unnest(list_transform(messages, lambda x: x.content)) content from m")
def render_openai(spark, root):
    out = render.openai(message_samples(spark, root))
    return out.select("metadata.id", "tools", F.posexplode("messages").alias("turn", "m")).select("id", "tools", "turn", "m.role", "m.content")


_FLAT = "select id, any_value(strategy) strategy, any_value(instruction) instruction, any_value(output) output, any_value(reasoning) reasoning from samples where messages is null and id is not null group by id"


def _flat(spark, root):
    rows = table(spark, root, "samples").filter("messages is null and id is not null").groupBy("id")
    rows = rows.agg(F.first(F.struct("strategy", "instruction", "output", "reasoning")).alias("s")).select("id", "s.*")
    from gleaner.operators.model import as_samples

    return as_samples(rows, **{c: F.col(c) for c in ("id", "strategy", "instruction", "output", "reasoning")})


_THINK = "case when coalesce(reasoning, '') <> '' then '<think>' || chr(10) || reasoning || chr(10) || '</think>' || chr(10) || chr(10) || coalesce(output, '') else coalesce(output, '') end"


@query(f"select id, strategy, coalesce(instruction, '') instruction, {_THINK} output from ({_FLAT})")
def render_alpaca(spark, root):
    return render.alpaca(_flat(spark, root), thinking=True).select("metadata.id", "metadata.strategy", "instruction", "output")


@query(f"select id, 'user' role, instruction content from ({_FLAT}) where coalesce(instruction, '') <> '' union all select id, 'assistant', {_THINK} from ({_FLAT})")
def render_chatml(spark, root):
    return render.chatml(_flat(spark, root), thinking=True).select("metadata.id", F.explode("messages").alias("m")).select("id", "m.role", "m.content")



def _vectors(spark, root):
    return table(spark, root, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("at"), F.col("embedding").alias("vec"))


@query("select b.vec_id id, a.vec_id other, round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6) cosine from embeddings a join embeddings b on a.vec_id < b.vec_id where list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])) >= 0.4")
def semantic_pairs_040(spark, root):
    return stages.cosine_pairs(_vectors(spark, root), 0.40).withColumn("cosine", F.round("cosine", 6))



def _plane_sql() -> str:
    # The same normals as numbers; rounding of sums does not reach signs in these tables.
    bits = " || ".join(f"case when list_dot_product(v, [{', '.join(map(repr, p))}]) >= 0 then '0' else '1' end" for p in stages.hyperplanes(64))
    return f"""with v as (select vec_id id, cast(embedding as double[]) v from embeddings), b as (select id, v, {bits} bucket from v),
a as (select bucket, min(id) anchor, arg_min(v, id) av from b group by bucket)
select b.id, b.bucket, a.anchor, not (b.id <> a.anchor and list_cosine_similarity(b.v, a.av) >= 0.3) kept from b join a on a.bucket = b.bucket"""


@query(_plane_sql())
def cluster_dedup(spark, root):
    return stages.cluster_kept(_vectors(spark, root), threshold=0.3)


#: Judge scores made from documents: two judges and a third that is missing for every fifth document.
_SCORES = """with sc as (
  select doc_id, 'a' endpoint, 'quality' dim, cast((doc_id * 7) % 10 + 1 as double) v from documents union all
  select doc_id, 'b', 'quality', (doc_id * 3) % 10 + 1.0 from documents union all
  select doc_id, 'c', 'quality', (doc_id * 11) % 10 + 1.0 from documents where doc_id % 5 <> 0 union all
  select doc_id, 'a', 'safety', (doc_id * 13) % 10 + 1.0 from documents where doc_id % 3 <> 0)
"""


def _scores(spark, root):
    d = table(spark, root, "documents").select("doc_id")
    made = [("a", "quality", 7, None), ("b", "quality", 3, None), ("c", "quality", 11, 5), ("a", "safety", 13, 3)]
    parts = F.array(*[F.struct(F.lit(e).alias("endpoint"), F.lit(dim).alias("dim"), F.when(F.lit(skip is None) | (F.col("doc_id") % (skip or 1) != 0), (F.col("doc_id") * k % 10 + 1).cast("double")).alias("value")) for e, dim, k, skip in made])
    return d.select(F.col("doc_id").alias("sample_id"), F.inline(parts)).filter("value is not null")


def _aggregate(how: str, fn: str):
    def run(spark, root):
        return judge.per_dimension(_scores(spark, root), how).select("sample_id", "dim", F.round("value", 6).alias("value"), "judges")

    run.__name__ = f"judge_{how}"
    query(_SCORES + f"select doc_id sample_id, dim, round({fn}(v), 6) value, count(*) judges from sc group by all")(run)


for _how, _fn in (("mean", "avg"), ("min", "min"), ("max", "max"), ("median", "median")):
    _aggregate(_how, _fn)

_GATES = _SCORES + """, d as (select doc_id, dim, avg(v) value, case when count(*) > 1 then max(v) - min(v) end spread from sc group by all),
t as (select doc_id, sum(value) total, max(spread) spread from d group by 1), n as (select doc_id, count(distinct endpoint) success from sc group by 1),
r as (select x.doc_id, case when coalesce(n.success, 0) < 3 then 'insufficient_judges' when t.spread > 7 then 'judge_disagreement' when coalesce(t.total, 0) < 8 then 'min_total' end drop_code, round(coalesce(t.total, 0), 6) total
  from documents x left join t on t.doc_id = x.doc_id left join n on n.doc_id = x.doc_id)
"""


def _gated(spark, root, **more):
    samples = table(spark, root, "documents").select(F.col("doc_id").alias("id"))
    return judge.judged(samples, _scores(spark, root), {"quality": 10.0, "safety": 10.0}, min_judges=3, max_disagreement=7.0, min_total=8.0, **more)


@query(_GATES + "select doc_id id, total, drop_code from r")
def judge_gates(spark, root):
    return _gated(spark, root).select("id", F.round("total", 6).alias("total"), "drop_code")


@query(_GATES + """, l as (select doc_id, 'safety' dim, (doc_id % 11) / 10.0 * 10 * 0.5 v from documents)
select x.doc_id id, round(t.total + case when exists (select 1 from d where d.doc_id = x.doc_id and d.dim = 'safety') then 0 else l.v end, 6) total from documents x join t on t.doc_id = x.doc_id join l on l.doc_id = x.doc_id""")
def local_scorer_fill(spark, root):
    local = table(spark, root, "documents").select(
        F.col("doc_id").alias("sample_id"), F.lit("ppl").alias("source"), F.lit(1).alias("priority"), F.lit(0.5).alias("weight"), F.lit("safety").alias("dim"), (F.col("doc_id") % 11 / 10.0).alias("value")
    )
    return _gated(spark, root, local=local).select("id", F.round("total", 6).alias("total"))


@query("""with t as (select case when total_score >= 20 then 20 when total_score >= 15 then 15 when total_score >= 10 then 10 when total_score >= 5 then 5 else 0 end bucket, total_score from samples where total_score > 0 and cast(total_score as varchar) <> 'nan')
select cast(bucket as integer) bucket, count(*) n, round(avg(total_score), 1) mean from t group by 1""")
def score_distribution(spark, root):
    return report.score_distribution(table(spark, root, "samples"), "total_score")


def _cleaned(spark, root):
    return stages.pipeline(stages.length_gate(output=(200, 8000)), stages.exact_dedup())(document_samples(spark, root))


_CLEAN = _DOC + """, g as (select *, case when length(instruction) not between 5 and 4000 then 'instruction_len' when length(output) not between 200 and 8000 then 'output_len' end a from s),
h as (select *, case when a is null then row_number() over (partition by a is null, sha256(core) order by pos, id) end rn from g),
r as (select id, case when a is not null then 'length' when rn > 1 then 'exact_dedup' end stage, case when a is not null then a when rn > 1 then 'duplicate' end code from h)
"""


@query(_CLEAN + "select coalesce(stage, 'kept') stage, coalesce(code, '') reason, count(*) n from r group by all")
def drop_waterfall(spark, root):
    return report.waterfall(_cleaned(spark, root))


@query(_CLEAN + "select count(*) - count(stage) produced, count(stage) dropped, count(*) total_in from r")
def run_summary(spark, root):
    return report.summary(_cleaned(spark, root))



_TOPICS, _LEVELS, _STYLES = ["physics", "history", "music", "law", "cooking"], ["easy", "medium", "hard"], ["short", "long"]


@query("""with n as (select unnest(range(1000)) pos), p as (select pos, ['physics','history','music','law','cooking'][pos % 5 + 1] topic, pos % 6 c from n),
q as (select *, ['easy','medium','hard'][c // 2 + 1] difficulty, ['short','long'][c % 2 + 1] style from p)
select pos, topic, substr(sha256('topic|topic_driven|' || topic || '|difficulty=' || difficulty || '|style=' || style || '|' || pos), 1, 16) id from q""")
def plan_topic(spark, root):
    specs = planners.topic_plan(spark, _TOPICS, {"difficulty": _LEVELS, "style": _STYLES}, 1000)
    return specs.select("pos", F.get_json_object("payload", "$.topic").alias("topic"), "id")


@query("with n as (select unnest(range(500)) pos) select pos, substr(sha256('tool|' || ['physics','history','music','law','cooking'][pos % 5 + 1] || '|' || pos), 1, 16) id from n")
def plan_tool(spark, root):
    return planners.tool_plan(spark, _TOPICS, 500).select("pos", "id")


@query("""with s(i, name, count, weight) as (values (0, 'topic_driven', null, 2.0), (1, 'seed_driven', 100, 1.0), (2, 'document_qa', null, 1.0), (3, 'tool_call', null, 0.5)),
f as (select *, floor(900 * weight / sum(weight) over ()) share, row_number() over (order by weight desc, i) h from s where count is null)
select name strategy, cast(coalesce(s.count, f.share + case when h = 1 then 900 - (select sum(share) from f) else 0 end) as bigint) n from s left join f using (name)""")
def allocate(spark, root):
    strategies = [{"type": "topic_driven", "weight": 2.0}, {"type": "seed_driven", "count": 100}, {"type": "document_qa"}, {"type": "tool_call", "weight": 0.5}]
    return spark.createDataFrame(planners.allocate(strategies, 1000), "strategy string, n long")


_SEEDS = [{"id": f"s{i}", "instruction": f"question {i}", "output": f"answer {i}"} for i in range(5)]



@query()
def plan_evol(spark, root):
    return planners.evol_plan(spark, _SEEDS, 20, seed=42)


def _docs(spark, root):
    return table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("doc_id").alias("pos"))



_BT = r"""with d as (select doc_id, length(regexp_replace(regexp_replace(text, '[\x{0}-\x{8}\x{b}-\x{1f}\x{7f}-\x{9f}\p{Cf}]', '', 'g'), '^""" + _SPACE + "+|" + _SPACE + r"""+$', '', 'g')) n from documents),
k as (select doc_id, n, row_number() over (order by doc_id) - 1 pos from d where n between 50 and 4000 order by doc_id limit 500)
select pos, substr(sha256('bt|' || doc_id || '|' || pos || '|' || n), 1, 16) id from k"""


@query(_BT)
def plan_backtranslation(spark, root):
    return planners.backtranslation_plan(_docs(spark, root), 500).select("pos", "id")



@query()
def semantic_chunk_ranges(spark, root):
    return table(spark, root, "documents").filter("text is not null").select("doc_id", F.inline(semantic_chunks(F.col("text"))))


@query()
def reply_objects(spark, root):
    """The first JSON object of every document's text, as if it were a reply."""
    return table(spark, root, "documents").select("doc_id", extract_json(F.col("text")).alias("object"))


@query(_MSG + "select id, case when len(list_filter(messages, lambda x: x.role = 'tool')) > 0 then 'broken_chain:orphan_result' end problem from m")
def trajectories(spark, root):
    """The tables hold no tool calls, so a tool's turn answers none."""
    df = message_samples(spark, root)
    return df.select("id", validate_trajectory(F.to_json("messages"), F.coalesce("tools", F.lit("[]"))).alias("problem"))


@query("""select doc_id, case when n_chars is null then 0.0 else round(greatest(0.0, least(1.0, 1 - (n_chars % 900) / 100.0 / 6.0)), 4) end quality from documents""")
def ppl_quality(spark, root):
    return table(spark, root, "documents").select("doc_id", T.nll_quality(F.col("n_chars") % 900 / 100.0).alias("quality"))







@query("select 'documents' as name, count(*) n from documents union all select 'samples', count(*) from samples union all select 'fingerprints', count(*) from fingerprints")
def store_stats(spark, root):
    return report.store_stats({t: table(spark, root, t) for t in ("documents", "samples", "fingerprints")})


@query(_DOC + "select id, case when row_number() over (partition by sha256(core) order by pos, id) > 1 then 'duplicate' end drop_code from s")
def export_round_trip(spark, root):
    """Rows written to and read from the columnar export."""
    folder = shared_folder(spark, "export")
    render.write_export(stages.exact_dedup()(document_samples(spark, root)).select("id", "drop_code"), folder)
    return spark.read.parquet(folder)


@query("""select id, case when cast(total_score as varchar) <> 'nan' then total_score end total_score, coalesce(cast(total_score as varchar) = 'nan', false) no_number from (select id, total_score, row_number() over (partition by id order by created_at desc, total_score desc nulls last) rn from samples where id is not null) where rn = 1""")
def state_latest(spark, root):
    """The last row of every id; a score that is no number is told apart from a missing one. In SQL it is
    told by its text, since the file's statistics, which leave NaN out, fold comparisons of numbers."""
    rows = table(spark, root, "samples").filter("id is not null").select("id", "total_score", F.col("created_at").alias("at"))
    last = latest(rows, ("id",), order="at")
    return last.select("id", F.when(~F.isnan("total_score"), F.col("total_score")).alias("total_score"), F.coalesce(F.isnan("total_score"), F.lit(False)).alias("no_number"))


QUERIES |= catalog_flows.QUERIES
ORACLE_SQL |= catalog_flows.ORACLE_SQL
