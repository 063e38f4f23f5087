"""Queries of routing, traces and serving semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantaloom.operators import agent, serving
from vantaloom.plans.registry import query
from vantaloom.sources.runtime import table

S = SparkSession


@query(f"""select conv_id, turn, case when conv_id % 2 = 0 and regexp_matches(lower(q), '{agent.WRITE_INTENT}') then 'write_code' when conv_id % 3 = 0 and regexp_matches(lower(q), '{agent.RUN_INTENT}') then 'run_python' else 'search' end as route
    from (select conv_id, turn, case turn % 4 when 0 then 'Write a function: ' when 1 then 'please run this ' || role || ' script ' when 2 then 'Compute it' || chr(10) || 'in python ' else '' end || coalesce(text, '') q from conversations)""")
def route(spark: S, d: str) -> DataFrame:
    lead = F.when(F.col("turn") % 4 == 0, F.lit("Write a function: ")).when(F.col("turn") % 4 == 1, F.concat(F.lit("please run this "), "role", F.lit(" script "))).when(F.col("turn") % 4 == 2, F.lit("Compute it\nin python ")).otherwise(F.lit(""))
    q = F.concat(lead, F.coalesce("text", F.lit("")))
    return table(spark, d, "conversations").select("conv_id", "turn", agent.route(q, F.col("conv_id") % 2 == 0, F.col("conv_id") % 3 == 0).alias("route"))


@query("""select conv_id, turn, array_to_string(list_concat(['search'], case when turn % 2 = 0 then ['search_code'] else [] end, case when conv_id % 3 = 0 then ['run_python', 'run_file'] else [] end, case when conv_id % 2 = 0 then ['read_file', 'write_file', 'edit_file'] else [] end), ',') tools from conversations""")
def tool_list(spark: S, d: str) -> DataFrame:
    names = agent.tools(F.col("turn") % 2 == 0, F.col("conv_id") % 3 == 0, F.col("conv_id") % 2 == 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(names, ",").alias("tools"))


@query("""select event_id, case when event_id % 7 = 0 then '[run failed ' || event_type || ']' || chr(10) || props when event_id % 3 = 0 then 'check passed' || chr(10) || props when event_id % 3 = 1 then '[check failed AssertionError: ' || event_type || ']' || chr(10) || props else props || chr(10) || '[stderr]' || chr(10) || event_type end as output from events""")
def run_output(spark: S, d: str) -> DataFrame:
    """What a model is told of a run: failure, the check's outcome, output and errors."""
    i, e = F.col("event_id"), table(spark, d, "events")
    text = agent.format_run(F.col("props"), F.when((i % 3 == 2) & (i % 7 != 0), F.col("event_type")).otherwise(F.lit("")), F.when(i % 7 == 0, F.col("event_type")).otherwise(F.lit("")), i % 3 != 2, i % 3 == 0, F.concat(F.lit("AssertionError: "), "event_type"))
    return e.select("event_id", text.alias("output"))


@query("""with t as (select conv_id, count(*) filter (role = 'assistant') n_steps, count(*) filter (role = 'assistant' and turn % 4 <> 3) n_tools, coalesce(sum(case when role = 'assistant' then length(text) / 1000 end), 0.0) llm_lat,
    coalesce(sum(case when role = 'assistant' and turn % 4 <> 3 then 0.5::double end), 0.0) tool_lat, coalesce(sum(case when role = 'assistant' then length(text) end), 0) prompt, coalesce(sum(case when role = 'assistant' and turn % 3 <> 0 then turn end), 0) completion,
    coalesce(sum(case when role = 'assistant' and turn % 4 <> 3 then length(text) end), 0) chars from conversations group by conv_id)
    select conv_id, n_steps, n_tools, round(llm_lat, 6) llm_lat, round(tool_lat, 6) tool_lat, prompt::bigint prompt, completion::bigint completion, 0::bigint cached, (chars + case when conv_id % 2 = 0 then 10 else 0 end)::bigint chars, case when conv_id % 5 = 0 then 0.0::double else 1.5::double end total_lat from t""")
def trace_cost(spark: S, d: str) -> DataFrame:
    """Assistant turns as an agent's steps, some fields missing."""
    c = table(spark, d, "conversations")
    n = F.length("text")
    tool = F.struct(F.lit("search").alias("name"), F.lit(0.5).alias("lat"), n.alias("chars"))
    own = F.struct((n / 1000).alias("llm_lat"), n.alias("prompt"), F.when(F.col("turn") % 3 != 0, F.col("turn")).alias("completion"), F.lit(None).cast("int").alias("cached"), F.when(F.col("turn") % 4 != 3, F.array(tool)).alias("tools"))
    traces = c.groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "assistant", own)).alias("steps"))
    traces = traces.withColumn("prefetch", F.when(F.col("conv_id") % 2 == 0, F.struct(F.lit(0.1).alias("lat"), F.lit(10).alias("chars")))).withColumn("total_lat", F.when(F.col("conv_id") % 5 != 0, F.lit(1.5)))
    return agent.trace_costs(traces)


@query("""with q as (select conv_id, turn, case when turn % 5 = 0 then '' else text end query, case when turn % 2 = 0 then text else null end question from conversations), e as (select conv_id, turn, coalesce(nullif(query, ''), nullif(question, ''), '') t from q)
    select conv_id, turn, sha1(t) digest, case when t = '' or octet_length(encode(t)) > 2000 then 400 else 200 end status from e""")
def request_validation(spark: S, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    v = serving.validate(F.when(F.col("turn") % 5 == 0, F.lit("")).otherwise(F.col("text")), F.when(F.col("turn") % 2 == 0, F.col("text")))
    return c.select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", F.sha1(F.col("v.query").cast("binary")).alias("digest"), F.col("v.status").alias("status"))


@query("select event_id, case when event_id % 10 = 0 then 400 when event_id < 50 then 503 when event_type = 'error' then 500 else 200 end status from events")
def chat_status(spark: S, d: str) -> DataFrame:
    e = table(spark, d, "events")
    question = F.when(F.col("event_id") % 10 == 0, F.lit("  ")).otherwise(F.col("props"))
    return e.select("event_id", serving.chat_status(question, F.col("event_id") >= 50, F.col("event_type") == "error").alias("status"))


_QUOTAS = {"en": 4, "de": 3, "fr": 3}


@query("""with p as (select doc_id id, lang category, row_number() over (partition by lang order by sha1('7:' || doc_id), doc_id) pick, case lang when 'en' then 4 when 'de' then 3 when 'fr' then 3 end quota, case lang when 'en' then 0 when 'de' then 1 when 'fr' then 2 end place from documents)
    select id, category, pick, place from p where pick <= quota""")
def suggest_stratified(spark: S, d: str) -> DataFrame:
    pool = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"))
    return serving.suggestions(pool, 7, _QUOTAS)


def request_log(spark: S, d: str) -> DataFrame:
    """Events as a request log: seconds, user, question key, and a call's duration."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").select("event_id", at.alias("at"), "user_id", F.concat_ws("|", "event_type", "props").alias("question"), (F.col("value") * 60).alias("duration"))


_LOG = "log as (select event_id, epoch_us(ts) / 1e6 as sec, user_id, event_type || '|' || props question, value * 60 as duration from events)"


def _ordered(key: str) -> str:
    return f"o as (select *, {key} k, row_number() over (partition by {key} order by sec, event_id) n from log)"


@query(f"""with recursive {_LOG}, {_ordered('question')}, f as (select k, n, event_id, sec, false hit, sec w from o where n = 1 union all
    select o.k, o.n, o.event_id, o.sec, o.sec < f.w + 86400, case when o.sec < f.w + 86400 then f.w else o.sec end from f join o on o.k = f.k and o.n = f.n + 1) select event_id, hit, round(w, 6) written_at from f""")
def cache_ttl(spark: S, d: str) -> DataFrame:
    """A cache over the event log; entries live a day from their write."""
    return serving.cache_replay(request_log(spark, d), "question", "at", 86_400).select("event_id", "hit", F.round("written_at", 6).alias("written_at"))


@query(f"""with recursive {_LOG}, {_ordered('user_id')}, f as (select k, n, event_id, sec s, 1 c from o where n = 1 union all
    select o.k, o.n, o.event_id, case when o.sec < f.s + 3600 then f.s else o.sec end, case when o.sec < f.s + 3600 then f.c + 1 else 1 end from f join o on o.k = f.k and o.n = f.n + 1) select event_id, c::bigint n_in_window, c <= 2 allowed from f""")
def rate_limit(spark: S, d: str) -> DataFrame:
    """Two requests an hour for each user, counted from the first of a window."""
    return serving.rate_replay(request_log(spark, d), "user_id", "at", 2, 3600).select("event_id", "n_in_window", "allowed")


@query(f"""with recursive {_LOG}, {_ordered('question')}, f as (select k, n, event_id, false shared, sec + duration e from o where n = 1 union all
    select o.k, o.n, o.event_id, o.sec < f.e, case when o.sec < f.e then f.e else o.sec + o.duration end from f join o on o.k = f.k and o.n = f.n + 1) select event_id, shared, round(e, 2) answered_at from f""")
def single_flight(spark: S, d: str) -> DataFrame:
    """Requests of a question share the call in flight; a call takes 60 times the event's value in seconds."""
    return serving.single_flight(request_log(spark, d), "question", "at", "duration").select("event_id", "shared", F.round("answered_at", 2).alias("answered_at"))
