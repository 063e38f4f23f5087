"""Queries of metrics, evaluation-set checks, paired statistics, judging and generation scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantaloom.functions import text as tx
from vantaloom.operators import code, fused, fusion, integrity, judging, metrics, paired
from vantaloom.plans import data
from vantaloom.plans.registry import query
from vantaloom.plans.retrieval import GRID_SQL, _pack_sql, strategies_of
from vantaloom.sources import corpus
from vantaloom.sources.runtime import scratch, small_side, stage, table

S = SparkSession


def top_ranking(spark: S, d: str, depth: int = 10) -> DataFrame:
    """(query_id, rank, chunk_id) of the best chunks by the fused score, from candidates."""
    score = fusion.rrf("r_cosine", "r_bm25")
    found = fusion.fuse(data.candidates(spark, d, [(score, depth)]), score, depth)
    return small_side(stage(found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id"), "top-ranking"))


def ranking_to_gold(spark: S, d: str, found: DataFrame, least: int = 10) -> DataFrame:
    """(query_id, rank, chunk_id): of each question the first ``least`` chunks at least, and all up to the first one with each of its gold strings that occurs."""
    ranked = [fused.ranked_until(part, fusion.rrf("r_cosine", "r_bm25"), found, ["query_id", "gold"], least) for part in data.parts(spark, d)]
    return small_side(reduce(DataFrame.unionByName, ranked))


def found_gold(spark: S, d: str) -> DataFrame:
    return metrics.occurrences(data.chunks(spark, d), data.gold(spark, d))


_HITS = f"""{data.FUSED}, {data.GOLD}, hits as (select g.query_id, g.gold, min(case when contains(text, gold) then rank end) first_at from gold g join fused f on f.query_id = g.query_id group by g.query_id, g.gold),
    done as (select query_id, case when count(first_at) = count(*) then max(first_at) end done from hits group by query_id)"""


def _hits(spark: S, d: str, depth: int | None = 10) -> DataFrame:
    """First ranks of the gold strings, null beyond ``depth``; without a depth wherever they are."""
    found = found_gold(spark, d) if depth else stage(found_gold(spark, d), "gold-found")
    ranking = top_ranking(spark, d, depth) if depth else ranking_to_gold(spark, d, found)
    return metrics.gold_hits(ranking, data.gold(spark, d), found)


@query(f"""with {_HITS} select count(*) n_queries, {', '.join(f"round(avg(case when done <= {k} then 1.0::double else 0.0::double end), 6) recall_{k}" for k in (1, 3, 5, 10))}, round(avg(coalesce(1.0::double / done, 0.0::double)), 6) mrr from done""")
def recall_and_mrr(spark: S, d: str) -> DataFrame:
    return metrics.recall_and_mrr(metrics.completion(_hits(spark, d, None)))


@query(f"with {_HITS} select query_id, {', '.join(f'coalesce(done <= {k}, false) hit_{k}' for k in (1, 3, 5, 10))} from done")
def hit_matrix(spark: S, d: str) -> DataFrame:
    return metrics.hit_matrix(metrics.completion(_hits(spark, d)))


@query(f"""with {_HITS}, r as (select query_id, coalesce(string_agg(case when first_at is null or first_at > 10 then gold end, '|' order by gold), '') missing, coalesce(string_agg(case when first_at <= 10 then gold || '@' || first_at end, '|' order by gold || '@' || first_at), '') as found
    from hits group by query_id) select * from r where missing <> ''""")
def miss_report(spark: S, d: str) -> DataFrame:
    return metrics.miss_report(_hits(spark, d), 10)


@query(f"""with {data.FUSED}, {data.GOLD}, rel as (select f.query_id, chunk_id, rank, count(*) filter (contains(text, gold)) rel from fused f join gold g on g.query_id = f.query_id group by all),
    best as (select *, row_number() over (partition by query_id order by rel desc) ideal from rel),
    sums as (select query_id, sum(case when rank <= 10 then rel / log2(rank + 1) else 0 end) dcg, sum(case when ideal <= 10 then rel / log2(ideal + 1) else 0 end) idcg from best group by query_id)
    select query_id, round(case when idcg > 0 then dcg / idcg else 0.0 end, 6) ndcg from sums""")
def ndcg(spark: S, d: str) -> DataFrame:
    found = found_gold(spark, d)
    rel = metrics.relevance(top_ranking(spark, d), found)
    return metrics.ndcg(rel, metrics.gains(found), data.questions(spark, d).join(data.gold(spark, d), "query_id", "left_semi"))


_CEILING = f"""{data.CHUNKS}, {data.QUESTIONS}, {data.GOLD}, g as (select query_id, gold, row_number() over (partition by query_id order by gold) - 1 i from gold),
    masks as (select distinct query_id, m from (select query_id, chunk_id, sum(1 << i)::int m from g join chunks on contains(text, gold) group by all)), want as (select query_id, ((1 << count(*)) - 1)::int want from g group by query_id),
    cover as (select w.query_id, (select min(k) from (select 1 k from masks a where a.query_id = w.query_id and a.m = want union all select 2 from masks a join masks b on a.query_id = b.query_id where a.query_id = w.query_id and a.m | b.m = want
        union all select 3 from masks a join masks b on a.query_id = b.query_id join masks c on a.query_id = c.query_id where a.query_id = w.query_id and a.m | b.m | c.m = want)) best from want w)"""


@query(f"with {_CEILING} select query_id, coalesce(best <= 1, false) coverable_1, coalesce(best <= 2, false) coverable_2 from cover")
def ceiling(spark: S, d: str) -> DataFrame:
    units, gold = data.chunks(spark, d).select(F.col("chunk_id").alias("unit_id"), "text"), data.gold(spark, d)
    return metrics.coverable(units, gold, 1).withColumnRenamed("coverable", "coverable_1").join(metrics.coverable(units, gold, 2).withColumnRenamed("coverable", "coverable_2"), "query_id")


_PARENTS = f"""{_HITS}, {data.PASSAGES}, ptexts as (select distinct parent, parent_text as text from passages), pfirst as (select query_id, parent, min(rank) r from fused join passages using (chunk_id) group by all),
    ppos as (select query_id, parent, row_number() over (partition by query_id order by r) as rank from pfirst), pfound as (select query_id, gold, parent from gold join ptexts on contains(text, gold)),
    phits as (select g.query_id, g.gold, min(rank) first_at from gold g left join (select f.*, rank from pfound f join ppos p on p.query_id = f.query_id and p.parent = f.parent) x on x.query_id = g.query_id and x.gold = g.gold group by all),
    pdone as (select query_id, case when count(first_at) = count(*) then max(first_at) end done from phits group by query_id),
    prel as (select p.query_id, rank, count(gold) rel from ppos p left join pfound f on f.query_id = p.query_id and f.parent = p.parent group by p.query_id, p.parent, rank),
    pbest as (select *, row_number() over (partition by query_id order by rel desc) ideal from prel),
    pgain as (select query_id, {', '.join(f"sum(case when rank <= {k} then rel / log2(rank + 1) else 0 end) dcg_{k}, sum(case when ideal <= {k} then rel / log2(ideal + 1) else 0 end) idcg_{k}" for k in (5, 10))} from pbest group by query_id),
    pndcg as (select {', '.join(f"round(avg(round(case when idcg_{k} > 0 then dcg_{k} / idcg_{k} else 0.0 end, 6)), 6) ndcg_{k}" for k in (5, 10))} from pgain),
    context as (select query_id, rank, text from ppos join ptexts using (parent) where rank <= 10), {_pack_sql('context', 'query_id', 'text', 8000)},
    bhits as (select g.query_id, g.gold, min(rank) first_at from gold g left join packed p on p.query_id = g.query_id and contains(p.text, g.gold) group by all),
    bdone as (select query_id, case when count(first_at) = count(*) then max(first_at) end done from bhits group by query_id),
    pmasks as (select distinct query_id, m from (select g.query_id, parent, sum(1 << i)::int m from (select query_id, gold, row_number() over (partition by query_id order by gold) - 1 i from gold) g join pfound f on f.query_id = g.query_id and f.gold = g.gold group by all)),
    pwant as (select query_id, ((1 << count(*)) - 1)::int want from gold group by query_id),
    pcover as (select w.query_id, (select min(k) from (select 1 k from pmasks a where a.query_id = w.query_id and a.m = want union all select 2 from pmasks a join pmasks b on a.query_id = b.query_id where a.query_id = w.query_id and a.m | b.m = want
        union all select 3 from pmasks a join pmasks b on a.query_id = b.query_id join pmasks c on a.query_id = c.query_id where a.query_id = w.query_id and a.m | b.m | c.m = want)) best from pwant w),
    ks as (select unnest([1, 3, 5, 10])::int k), sizes as (select query_id, k, sum(length(text)) chars from context, ks where rank <= k group by all),
    rates as (select ks.k, count(*) n_queries, {', '.join(f"round(avg(case when {t}.{c} <= ks.k then 1.0::double else 0.0::double end), 6) {n}" for t, c, n in (('c', 'done', 'chunk_recall'), ('p', 'done', 'parent_recall'), ('b', 'done', 'budget_recall'), ('v', 'best', 'ceiling')))},
        round(avg(coalesce(chars, 0)), 6) mean_chars from done c join pdone p using (query_id) join bdone b using (query_id) join pcover v using (query_id), ks left join sizes s on s.query_id = c.query_id and s.k = ks.k group by ks.k)"""


@query(f"""with {_PARENTS} select rates.*, round(case when ceiling > 0 then parent_recall / ceiling else 0.0 end, 6) attainment, (select round(avg(coalesce(1.0::double / done, 0.0::double)), 6) from pdone) mrr, ndcg_5, ndcg_10, z.*
    from rates, pndcg, (select count(*) filter (chars > 8000) n_truncated, median(chars)::double median_chars, round(quantile_cont(chars, 0.95), 6) p95_chars, max(chars)::bigint max_chars from sizes where k = 10) z""")
def parent_report(spark: S, d: str) -> DataFrame:
    """Passages of four chunks as parents, for every k: recall, budget, ceiling and attainment, MRR, nDCG and context sizes."""
    gold = data.gold(spark, d)
    found = stage(found_gold(spark, d), "gold-found")
    passages = stage(data.parents(spark, d), "passages")
    texts = stage(passages.select("parent", "text").distinct(), "parents")
    enough, least = texts.limit(10).count(), 160
    while True:  # four chunks are a passage, but equal passages are one, so it is seen whether the first ten are there
        ranking = ranking_to_gold(spark, d, found, least)
        first = passages.select("chunk_id", "parent").join(ranking, "chunk_id").groupBy("query_id", "parent").agg((-F.min("rank")).alias("up"), F.min("chunk_id").alias("tie"))
        first = stage(first, "first-chunks")
        if first.groupBy("query_id").count().where(F.col("count") < enough).isEmpty():
            break
        least *= 8
    placed = fusion.rank_within(first, "query_id", "up", "tie", "rank", common=None).select("query_id", "parent", "rank")
    done = metrics.completion(metrics.gold_hits(ranking, gold, found))
    return metrics.parent_report(done, placed, texts, gold)


_WHOLE = "(^|[^A-Za-z0-9_])' || gold || '([^A-Za-z0-9_]|$)"


@query(f"""with {data.FUSED}, {data.GOLD}, found as (select g.query_id, gold, chunk_id, rank from gold g join fused f on f.query_id = g.query_id and contains(text, gold) and regexp_matches(text, '{_WHOLE}')),
    hits as (select g.query_id, g.gold, min(rank) first_at from gold g left join (select * from found where rank <= 10) f on f.query_id = g.query_id and f.gold = g.gold group by all),
    done as (select query_id, case when count(first_at) = count(*) then max(first_at) end done from hits group by query_id),
    rel as (select query_id, chunk_id, rank, count(*) rel from found group by all), best as (select *, row_number() over (partition by query_id order by rel desc) ideal from rel),
    gain as (select query_id, {', '.join(f"sum(case when rank <= {k} then rel / log2(rank + 1) else 0 end) / sum(case when ideal <= {k} then rel / log2(ideal + 1) else 0 end) ndcg_{k}" for k in (5, 10))} from best group by query_id)
    select count(*) n_queries, {', '.join(f"round(avg(case when done <= {k} then 1.0::double else 0.0::double end), 6) recall_{k}" for k in (1, 3, 5, 10))}, round(avg(coalesce(1.0::double / done, 0.0::double)), 6) mrr,
        {', '.join(f"round(avg(round(coalesce(ndcg_{k}, 0.0), 6)), 6) ndcg_{k}" for k in (5, 10))} from done left join gain using (query_id)""")
def code_recall(spark: S, d: str) -> DataFrame:
    """The metrics of code search: gold strings count as whole identifiers, among the first ten chunks."""
    gold = data.gold(spark, d)
    whole = stage(metrics.occurrences(data.chunks(spark, d), gold, whole=True), "whole-found")
    return metrics.code_report(top_ranking(spark, d), gold, whole)


_FIRST = f"""{GRID_SQL}, {data.GOLD}, target as (select query_id, min(gold) gold from gold group by query_id), tiers as (select distinct strategy, depth, query_id, gold, case when query_id % 2 = 0 then 'A' else 'B' end tier from long join target using (query_id)),
    hit as (select strategy, g.query_id, min(rank) as rank from strategy_grid g join target t on t.query_id = g.query_id join chunks c on c.chunk_id = g.chunk_id where contains(text, gold) group by all),
    first as (select t.strategy, depth, tier, t.query_id, coalesce(rank, depth + 1) as rank from tiers t left join hit h on h.strategy = t.strategy and h.query_id = t.query_id)"""


def first_ranks(spark: S, d: str, only: tuple[str, ...] = ()) -> DataFrame:
    """(strategy, depth, tier, query_id, rank): the first candidate with a question's least gold string, or depth + 1; of all strategies, or some by name."""
    chosen = [s for s in fusion.strategies() if not only or s.name in only]
    target = data.gold(spark, d).groupBy("query_id").agg(F.min("gold").alias("gold"))
    listed = stage(strategies_of(spark, d, chosen), "strategies")
    texts = data.chunks(spark, d).select("chunk_id", "text").join(small_side(listed.select("chunk_id").distinct()), "chunk_id", "left_semi")
    grid = listed.join(metrics.occurrences(texts, target), ["query_id", "chunk_id"])  # texts that no strategy lists are not searched
    names = spark.createDataFrame([(s.name, s.depth) for s in chosen], "strategy string, depth int")
    every = target.select("query_id").crossJoin(F.broadcast(names))
    hit = grid.groupBy("strategy", "query_id").agg(F.min("rank").alias("rank"))
    found = every.join(hit, ["strategy", "query_id"], "left")
    return found.select("strategy", "depth", F.when(F.col("query_id") % 2 == 0, "A").otherwise("B").alias("tier"), "query_id", F.coalesce("rank", F.col("depth") + 1).cast("long").alias("rank"))


@query(f"with {_FIRST} select strategy, query_id, rank from first")
def gold_first_rank(spark: S, d: str) -> DataFrame:
    return first_ranks(spark, d).select("strategy", "query_id", "rank")


@query(f"""with {_FIRST} select strategy, tier, count(*) n, {', '.join(f"round(avg(case when rank <= {k} then 1.0::double else 0.0::double end), 6) recall_{k}" for k in (1, 3, 5, 10))},
    round(avg(case when rank <= depth then 1.0::double / rank else 0.0::double end), 6) mrr, round(avg((rank <= depth)::int), 6) coverage from first group by strategy, tier""")
def ablation_grid(spark: S, d: str) -> DataFrame:
    return metrics.grid_metrics(first_ranks(spark, d), ["strategy", "tier"], F.col("depth"))


_CHECK = f"""{data.CHUNKS}, {data.QUESTIONS}, {data.GOLD}, found as (select query_id, gold, doc, chunk_id from gold join chunks on contains(text, gold)),
    per as (select g.query_id, g.gold, count(chunk_id) n from gold g left join found f on f.query_id = g.query_id and f.gold = g.gold group by all), size as (select query_id, count(*) k, min(n) least_chunks, max(n) most_chunks from per group by query_id),
    leak as (select q.query_id, count(*) n from questions q join gold g on g.query_id = q.query_id and contains(q, gold) group by q.query_id),
    docs as (select query_id, count(*) n from (select query_id, doc, count(distinct gold) got from found group by all) join size using (query_id) where got = k group by query_id),
    singles as (select query_id, count(*) n from (select query_id, chunk_id, count(distinct gold) got from found group by all) join size using (query_id) where got = k group by query_id),
    checked as (select s.query_id, least_chunks, most_chunks, coalesce(leak.n, 0) leaks, coalesce(docs.n, 0) answer_docs, coalesce(singles.n, 0) single_chunks from size s left join leak using (query_id) left join docs using (query_id) left join singles using (query_id)),
    judged as (select *, array_to_string(list_filter([case when least_chunks = 0 then 'unsolvable' end, case when least_chunks > 0 and answer_docs <> 1 then 'multi_doc' end, case when leaks > 0 then 'leak' end, case when least_chunks > 0 and single_chunks = 0 then 'recall1_zero' end], lambda x: x is not null), '+') s from checked)"""


def _checked(spark: S, d: str) -> DataFrame:
    c = data.chunks(spark, d).select("doc", "chunk_id", "text")
    return integrity.gold_check(data.questions(spark, d), data.gold(spark, d), c)


@query(f"with {_CHECK} select query_id, least_chunks, most_chunks, leaks, answer_docs, single_chunks, case when s = '' then 'clean' else s end severity from judged")
def gold_check(spark: S, d: str) -> DataFrame:
    return _checked(spark, d)


@query(f"with {_CHECK} select finding, count(*) n_questions from (select unnest(string_split(case when s = '' then 'clean' else s end, '+')) finding from judged) group by finding")
def gold_severity(spark: S, d: str) -> DataFrame:
    return integrity.severity_report(_checked(spark, d))


@query(f"""with {data.CHUNKS}, {data.QUESTIONS}, {data.GOLD}, found as (select query_id, gold, doc, chunk_id from gold join chunks on contains(text, gold) and regexp_matches(text, '(^|[^A-Za-z0-9_])' || gold || '([^A-Za-z0-9_]|$)'))
    select g.query_id, count(distinct g.gold) - count(distinct f.gold) missing, (select count(*) from questions q join gold h on h.query_id = q.query_id and contains(lower(q), lower(h.gold)) where q.query_id = g.query_id) leaks, count(distinct doc) n_files, count(chunk_id) n_chunks, count(distinct doc) > 6 warn
    from gold g left join found f on f.query_id = g.query_id and f.gold = g.gold group by g.query_id""")
def code_gold_check(spark: S, d: str) -> DataFrame:
    return integrity.code_gold_check(data.questions(spark, d), data.gold(spark, d), data.chunks(spark, d).select("doc", "chunk_id", "text"))


@query("""with a as (select vec_id, embedding::double[] e from embeddings where vec_id in (select item_id from benchmark)), p as (select x.vec_id a, y.vec_id b, round(list_dot_product(x.e, y.e), 6) similarity from a x join a y on x.vec_id < y.vec_id),
    r as (select *, row_number() over (order by similarity desc, a, b) n from p) select a, b, similarity, similarity >= 0.8 alarm from r where n <= 3""")
def query_discriminability(spark: S, d: str) -> DataFrame:
    """The three nearest pairs of questions."""
    from vantaloom.operators.dense import similar_queries

    return similar_queries(data.question_vectors(spark, d)).orderBy(F.desc("similarity"), "a", "b").limit(3)


@query("select l.doc_id query_id, 'left' side from labels l where l.doc_id not in (select doc_id from documents) union all select doc_id, 'right' from documents where doc_id not in (select doc_id from labels)")
def arm_key_equality(spark: S, d: str) -> DataFrame:
    return integrity.key_equality(table(spark, d, "labels").select(F.col("doc_id").alias("query_id")), table(spark, d, "documents").select(F.col("doc_id").alias("query_id")), "query_id")


def arm_pairs(spark: S, d: str) -> DataFrame:
    """Each question's first rank under fusion (natural arm) and vectors alone (abstract arm), at depth 20."""
    first = stage(first_ranks(spark, d, ("s1_rrf_20", "s2_vector_20")), "arms")
    arm = lambda s, n: first.where(F.col("strategy") == s).select(F.col("query_id").alias("id"), F.col("tier").alias("grp"), F.col("rank").alias(n))
    return arm("s1_rrf_20", "natural_rank").join(arm("s2_vector_20", "abstract_rank"), ["id", "grp"])


_ARMS = f"""{_FIRST}, arms as (select a.query_id id, a.tier grp, a.rank x, b.rank y from first a join first b on a.query_id = b.query_id where a.strategy = 's1_rrf_20' and b.strategy = 's2_vector_20'),
    both_groups as (select *, grp arm_group from arms union all select *, 'total' from arms)"""
_MCNEMAR = "case when b + c = 0 then 1.0 else round(least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) + (b + c) * ln(0.5))))), 8) end"


@query(f"""with {_ARMS}, t as (select arm_group, k, count(*) n, round(avg((x <= k)::int), 6) "natural", round(avg((y <= k)::int), 6) abstract, count(*) filter (x <= k and y > k) b, count(*) filter (x > k and y <= k) c from both_groups, unnest([1, 3, 5, 10]) u(k) group by all)
    select *, round((b - c) / n, 6) delta, {_MCNEMAR} mcnemar_p from t""")
def paired_2x2(spark: S, d: str) -> DataFrame:
    return paired.paired_table(arm_pairs(spark, d))


@query(f"with v as (select doc_id, doc_id % 12 b, n_chars % 9 c from documents) select doc_id, {_MCNEMAR} p from v")
def mcnemar(spark: S, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", paired.mcnemar_p(F.col("doc_id") % 12, F.col("n_chars") % 9).alias("p"))


@query(f"with v as (select b, 0 c from range(1, 11) t(b)) select b, {_MCNEMAR} p, {_MCNEMAR} < 0.05 significant from v")
def power_table(spark: S, d: str) -> DataFrame:
    return paired.power_table(10, spark)


@query(f"""with {_ARMS} select arm_group, count(*) n, round(avg(case when x <= 20 then 1.0::double / x else 0.0::double end), 6) mrr_original, round(avg(case when y <= 20 then 1.0::double / y else 0.0::double end), 6) mrr_paraphrase, count(*) filter (x <= 1) original_at_1, count(*) filter (y <= 1) paraphrase_at_1,
    count(*) filter (x <= 10) original_at_10, count(*) filter (y <= 10) paraphrase_at_10, count(*) filter (x <= 20 and y > 20) dropped, count(*) filter (y > x) worsened from both_groups group by arm_group""")
def rank_change(spark: S, d: str) -> DataFrame:
    return paired.rank_change(arm_pairs(spark, d))


@query(f"""with {_ARMS}, rows as (select arm_group, list((x <= 10)::int - (y <= 10)::int order by id) ds from both_groups group by arm_group),
    draws as (select arm_group, draw, list_sum(list_transform(range(0, len(ds)), lambda i: ds[(('0x' || sha1(draw || ':' || i)[1:8])::ubigint % len(ds))::bigint + 1])) / len(ds) m from rows, range(0, 200) t(draw))
    select arm_group, round(quantile_cont(m, 0.025), 6) ci_low, round(quantile_cont(m, 0.975), 6) ci_high from draws group by arm_group""")
def bootstrap_hashed(spark: S, d: str) -> DataFrame:
    return paired.hashed_bootstrap(arm_pairs(spark, d), 10)


@query()
def bootstrap_ci(spark: S, d: str) -> DataFrame:
    return paired.recall_intervals(arm_pairs(spark, d))


@query()
def wilcoxon_mrr(spark: S, d: str) -> DataFrame:
    return paired.mrr_pairs(arm_pairs(spark, d))


@query()
def strategy_pairing(spark: S, d: str) -> DataFrame:
    return paired.strategy_pairing(first_ranks(spark, d).select("strategy", "query_id", "rank"), "s1_rrf_20")


@query("""with c as (select conv_id, turn, list_distinct(list_filter(list_transform(string_split(coalesce(text, ''), '.'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')) u,
        list_filter(list_transform(string_split(coalesce(text, ''), '.'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') l from conversations),
    o as (select conv_id, turn, len(u) n, greatest(len(u) - (turn % 3 = 2)::int, 0) v, list_filter(list_transform(l, lambda x, i: case when list_position(l, x) = i then x end), lambda x: x is not null) cs from c),
    a as (select conv_id, n, v, len(list_filter(cs[1:v], lambda x: length(x) % 2 = 0)) yes from o)
    select conv_id, count(*) n_answers, sum(case when n = 0 then 0 else v - yes end)::bigint n_unsupported, round(avg(case when n = 0 then 1.0::double when v = 0 then 0.0::double else yes / v end), 6) mean_faithfulness, sum((n <> v)::int)::bigint n_mismatch
    from a group by conv_id""")
def faithfulness(spark: S, d: str) -> DataFrame:
    """Sentences of a conversation's turns as claims; those of even length count as supported; the verdict of some turns' last claim is missing."""
    claims = F.split(F.coalesce("text", F.lit("")), r"\.", -1)
    rows = table(spark, d, "conversations").select("conv_id", "turn", judging.clean_claims(claims).alias("claims"))
    judged = F.greatest(F.size("claims") - (F.col("turn") % 3 == 2).cast("int"), F.lit(0))
    scored = judging.faithfulness(rows.withColumn("supported", F.transform(F.slice("claims", F.lit(1), judged), lambda c: F.length(c) % 2 == 0)))
    return judging.faithfulness_summary(scored, "conv_id")


@query("""with l as (select doc_id, source, string_split(coalesce(text, ''), chr(10)) ls from documents),
    r as (select doc_id, source, len(ls) n, len(list_filter(ls[1:len(ls) - (doc_id % 3 = 2)::int], lambda x: length(x) > 80)) hit from l)
    select source, count(*) n_answers, round(avg(hit / n), 6) mean_accuracy, sum(hit)::bigint n_stated, sum(n)::bigint n_facts, sum((doc_id % 3 = 2)::int)::bigint n_mismatch from r group by source""")
def correctness(spark: S, d: str) -> DataFrame:
    """Lines of a document as facts; long ones count as stated; some documents' last fact has no verdict."""
    rows = table(spark, d, "documents").select("doc_id", "source", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("facts"))
    judged = F.size("facts") - (F.col("doc_id") % 3 == 2).cast("int")
    scored = judging.correctness(rows.withColumn("stated", F.transform(F.slice("facts", F.lit(1), judged), lambda x: F.length(x) > 80)))
    return judging.correctness_summary(scored, "source")


@query("""with v as (select doc_id, case when doc_id % 4 = 0 then [] else string_split(coalesce(text, ''), chr(10)) end claims from documents)
    select doc_id, len(claims)::int n_verdicts, len(list_filter(claims, lambda x: length(x) % 2 = 0))::int n_supported, sha1(array_to_string(claims, chr(10))) digest from v""")
def judge_json(spark: S, d: str) -> DataFrame:
    """A judge that answers in JSON with a verdict a line, and for every fourth document with the bare text."""
    text = F.coalesce("text", F.lit(""))
    verdicts = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("claim"), (F.length(x) % 2 == 0).alias("supported")))
    raw = F.when(F.col("doc_id") % 4 == 0, text).otherwise(F.to_json(F.struct(verdicts.alias("verdicts"))))
    parsed = table(spark, d, "documents").select("doc_id", judging.parse_verdicts(raw).alias("v"))
    return parsed.select("doc_id", F.size("v").alias("n_verdicts"), F.size(F.filter("v", lambda x: x["supported"])).alias("n_supported"), F.sha1(F.array_join("v.claim", "\n").cast("binary")).alias("digest"))


@query("""select count(*) n_tasks, count(*) filter (quality = 1) parsed, sum(doc_id % 4)::bigint facts_hit, sum(doc_id % 4 + 1)::bigint facts_all, round(sum(doc_id % 4) / sum(doc_id % 4 + 1), 6) fact_ratio, count(*) filter (doc_id % 2 = 0) n_runnable,
    round(count(*) filter (doc_id % 2 = 0 and toxic = 0) / count(*) filter (doc_id % 2 = 0), 6) pass_at_1, count(*) filter (doc_id % 2 = 0 and doc_id % 5 = 0) timeouts,
    round(count(*) filter (doc_id % 2 = 0 and toxic = 1 and doc_id % 5 <> 0 and quality = 1) / nullif(count(*) filter (doc_id % 2 = 0 and toxic = 1 and doc_id % 5 <> 0), 0), 6) fix_rate from labels""")
def codegen_summary(spark: S, d: str) -> DataFrame:
    """Labels stand for the outcomes of generated programs."""
    i = F.col("doc_id")
    rows = table(spark, d, "labels").select((F.col("quality") == 1).alias("parses"), (i % 4).alias("facts_hit"), (i % 4 + 1).alias("facts_all"), (i % 2 == 0).alias("runnable"), (F.col("toxic") == 0).alias("run_ok"), (i % 5 == 0).alias("timed_out"), (F.col("quality") == 1).alias("fixed"))
    return code.generation_summary(rows)


@query("""with k as (select doc_id, source, sha1(regexp_replace(coalesce(text, ''), ':[0-9]+-[0-9]+', '', 'g')) as key, coalesce(text, '') as text from documents) select doc_id, 'about ' || text[1:20] description from k""")
def docstring_synthesis(spark: S, d: str) -> DataFrame:
    """A provider that quotes the first characters describes each distinct text once."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    described, _ = judging.synthesize(docs, None, lambda texts: ["about " + t[:20] for t in texts])
    return described.select("doc_id", "description")


_KEY = "sha1(regexp_replace(coalesce(text, ''), ':[0-9]+-[0-9]+', '', 'g'))"


@query(f"""with k as (select doc_id, lang, {_KEY} as key, coalesce(text, '') as text from documents), known as (select distinct key from k where lang = 'en'), missing as (select distinct key, text[1:{judging.SYNTH_CHARS}] cut from k where key not in (select key from known)),
    batched as (select key, cut, key[1:3] p, (row_number() over (partition by key[1:3] order by key) - 1) // {judging.BATCH} b from missing), failed as (select p, b from batched group by all having bool_or(starts_with(cut, 'T') or cut = ''))
    select doc_id, case when k.key in (select key from known) then 'cached ' || k.key[1:8] when f.p is not null then '' else 'about ' || text[1:20] end description,
        case when k.key in (select key from known) then 'cached ' || k.key[1:8] when f.p is not null then 'later ' || text[1:20] else 'about ' || text[1:20] end again
    from k left join batched using (key) left join failed f on f.p = batched.p and f.b = batched.b""")
def docstring_cache(spark: S, d: str) -> DataFrame:
    """A cache of the English documents and a provider that fails for some batches; the next build asks again for these alone."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    path = scratch(spark, "cache")
    known = docs.where("lang = 'en'").select(tx.chunk_key(F.col("text")).alias("key")).distinct()
    corpus.append_cache(known.select("key", F.concat(F.lit("cached "), F.substring("key", 1, 8)).alias("description")), path)

    def unsure(texts: list[str]) -> list[str]:
        if any(t.startswith("T") or not t for t in texts):
            raise ConnectionError("no answer")
        return ["about " + t[:20] for t in texts]

    first, fresh = judging.synthesize(docs.drop("lang"), corpus.read_cache(spark, path), unsure)
    first, fresh = stage(first, "first"), stage(fresh, "fresh")  # both read the cache, so before it grows
    corpus.append_cache(fresh, path)
    second, _ = judging.synthesize(docs.select("doc_id", "text"), corpus.read_cache(spark, path), lambda texts: ["later " + t[:20] for t in texts])
    return first.select("doc_id", "description").join(second.select("doc_id", F.col("description").alias("again")), "doc_id")
