"""Queries of lexical and dense retrieval, fusion, reranking and context assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantaloom.functions import text as tx
from vantaloom.operators import context, dense, fused, fusion, lexical, metrics, postings, ranking
from vantaloom.plans import data
from vantaloom.plans.registry import query
from vantaloom.sources.runtime import scratch, small_side, stage, table

S = SparkSession


@query(f"select doc_id, len(t)::bigint n_tokens, sha1(array_to_string(t, ' ')) digest from (select doc_id, {data.TOKENS.format('coalesce(text, $$$$)')} t from documents)")
def tokenize_documents(spark: S, d: str) -> DataFrame:
    t = tx.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.sha1(F.array_join(t, " ").cast("binary")).alias("digest"))


@query("""
    with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+') words from documents),
    p as (select doc_id, regexp_extract_all(regexp_replace(words[i], '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') parts from w, unnest(range(1, len(words) + 1)) t(i)),
    n as (select doc_id, sum(case when len(parts) > 1 then 1 + len(parts) else 1 end)::bigint n_split from p group by doc_id),
    c as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[一-鿿]')) cjk from documents)
    select doc_id, (len(words) + cjk)::bigint n_cased, (coalesce(n_split, 0) + cjk)::bigint n_split from w join c using (doc_id) left join n using (doc_id)""")
def tokenize_variants(spark: S, d: str) -> DataFrame:
    """Cased and part-splitting tokenizers."""
    own = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return own.select("doc_id", F.size(tx.tokens_cased(F.col("text"))).cast("long").alias("n_cased"), F.size(tx.tokens_with_parts(F.col("text"))).cast("long").alias("n_split"))


@query(f"with {data.INDEX} select term, df from frequency")
def bm25_document_frequency(spark: S, d: str) -> DataFrame:
    return data.index(spark, d).df


@query(f"with {data.INDEX} select n_docs, round(avgdl, 6) avgdl, (select count(*) from frequency) n_terms, (select count(*) from postings) n_postings from totals")
def bm25_index_stats(spark: S, d: str) -> DataFrame:
    i = data.index(spark, d)
    return i.totals.select("n_docs", F.round("avgdl", 6).alias("avgdl")).crossJoin(i.postings.agg(F.countDistinct("term").alias("n_terms"), F.count("*").alias("n_postings")))


@query(f"with {data.INDEX} select query_id, term, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 6) idf from terms join frequency using (term), totals")
def bm25_idf(spark: S, d: str) -> DataFrame:
    i = data.index(spark, d)
    terms = lexical.query_terms(data.questions(spark, d)).join(i.df, "term").crossJoin(F.broadcast(i.totals))
    return terms.select("query_id", "term", F.round(lexical.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query(f"with {data.BM25}, r as (select query_id, chunk_id, round(bm25, 6) bm25, row_number() over (partition by query_id order by round(bm25, 6) desc, chunk_id) as rank from matches) select * from r where rank <= 10")
def bm25_topk(spark: S, d: str) -> DataFrame:
    return lexical.best_matches(data.index(spark, d), lexical.query_terms(data.questions(spark, d)), 10).withColumn("rank", F.col("rank").cast("long"))


_TOP10 = "r as (select query_id, chunk_id, round(bm25, 6) bm25, row_number() over (partition by query_id order by round(bm25, 6) desc, chunk_id) as rank from matches) select * from r where rank <= 10"


@query(f"with {data.BM25}, {_TOP10}")
def bm25_blocks(spark: S, d: str) -> DataFrame:
    """The best matches by a persistent index, of which only blocks that can matter are opened."""
    index = postings.Postings(spark, scratch(spark, "postings"))
    index.apply(data.chunks(spark, d))
    return _searched(index, data.questions(spark, d))


def _searched(index: postings.Postings, questions: DataFrame) -> DataFrame:
    return index.search(lexical.query_terms(questions))[0].withColumn("rank", F.col("rank").cast("long"))


def _maintained(spark: S, d: str) -> postings.Postings:
    """An index that first held other versions of a third of the chunks, and as many that are deleted since; the second generation gets all chunks as they are."""
    index, now = postings.Postings(spark, scratch(spark, "postings")), data.chunks(spark, d).select("chunk_id", "text")
    past = F.when(F.col("chunk_id") % 3 == 0, F.concat(F.lit("an older version "), F.reverse("text"))).otherwise(F.col("text"))
    extra = now.where("chunk_id % 3 = 1").select((-1 - F.col("chunk_id")).alias("chunk_id"), "text")
    index.apply(now.withColumn("text", past).unionByName(extra))
    index.apply(now, deleted=extra)
    return index


@query(f"with {data.INDEX} select term, df, n_docs, round(avgdl, 6) avgdl from frequency, totals")
def index_generations(spark: S, d: str) -> DataFrame:
    """Frequencies and totals after edits and deletions are those of an index built anew."""
    index = _maintained(spark, d)
    totals = index.totals.select("n_docs", F.round("avgdl", 6).alias("avgdl"))
    return index.frequency.crossJoin(F.broadcast(totals))  # one row


@query(f"with {data.BM25}, {_TOP10}")
def bm25_generations(spark: S, d: str) -> DataFrame:
    """The best matches over two generations."""
    return _searched(_maintained(spark, d), data.questions(spark, d))


@query(f"with {data.BM25}, {_TOP10}")
def bm25_merged(spark: S, d: str) -> DataFrame:
    """The best matches after the generations were merged."""
    index = _maintained(spark, d)
    index.merge()
    return _searched(index, data.questions(spark, d))


@query(f"""with {data.BM25}, r as (select query_id, chunk_id, row_number() over (partition by query_id order by round(bm25, 6) desc, chunk_id) as rank from matches), best as (select r.query_id, string_agg(text, chr(10) || chr(10) order by rank) context from r join chunks using (chunk_id) where rank <= 3 group by r.query_id)
    select query_id, sha1('{context.NO_CODE_INDEX}') before, sha1(coalesce(context, '')) digest from questions left join best using (query_id)""")
def index_contexts(spark: S, d: str) -> DataFrame:
    """Contexts of the three best chunks by an index that is first absent, then made."""
    index, asked, own = postings.Postings(spark, scratch(spark, "postings")), data.questions(spark, d), data.chunks(spark, d).select("chunk_id", "text")

    def answers() -> DataFrame:
        if not index.exists:
            return context.or_message(asked, None)
        top = small_side(stage(index.search(lexical.query_terms(asked), 3)[0], "nearest")).join(own, "chunk_id")  # texts stay where they are
        return context.or_message(asked, context.join_context(top, ["query_id"]))

    before = answers().select("query_id", F.sha1(F.col("context").cast("binary")).alias("before"))
    index.apply(own)
    return before.join(answers().select("query_id", F.sha1(F.col("context").cast("binary")).alias("digest")), "query_id")


@query(f"""with {data.INDEX}, shared as (select query_id, chunk_id, count(*) k from postings join terms using (term) group by query_id, chunk_id),
    best as (select query_id, chunk_id, row_number() over (partition by query_id order by k desc, chunk_id) n from shared),
    target as (select distinct query_id, term from best join postings using (chunk_id) where n = 1),
    own as (select distinct query_id, term, df, ln((n_docs - df + 0.5) / (df + 0.5) + 1) idf from terms join frequency using (term), totals)
    select query_id, round(coalesce(sum(case when t.term is not null then idf else 0.0 end) / nullif(sum(idf), 0), 0.0), 6) overlap, count(*) filter (t.term is not null and df <= 10) rare_shared
    from own left join target t using (query_id, term) group by query_id""")
def idf_overlap(spark: S, d: str) -> DataFrame:
    """Each question against the chunk that shares most distinct terms with it."""
    i, q = data.index(spark, d), data.questions(spark, d)
    return lexical.idf_overlap(i, q, _nearest(spark, d, i, q))


@query(f"""with {data.INDEX}, shared as (select query_id, chunk_id, count(*) k from postings join terms using (term) group by query_id, chunk_id),
    best as (select query_id, text from (select query_id, chunk_id, row_number() over (partition by query_id order by k desc, chunk_id) n from shared) join chunks using (chunk_id) where n = 1),
    files as (select term, count(distinct doc) df from postings join chunks using (chunk_id) group by term),
    own as (select query_id, text, unnest(list_distinct({data.TOKENS.format("text")})) term from best)
    select query_id, term, df, case when regexp_full_match(term, '[a-z]+') and regexp_matches(text, '(^|[^A-Za-z0-9_])' || term || '([^A-Za-z0-9_]|$)') then 'natural' else 'identifier' end kind
    from own join files using (term) where df <= 3 and length(term) >= 3 and term not in ({', '.join(repr(w) for w in tx.CODE_STOP_WORDS)})""")
def rare_terms(spark: S, d: str) -> DataFrame:
    """The rare terms of the chunk that each question shares most terms with."""
    i, q = data.index(spark, d), data.questions(spark, d)
    return lexical.rare_terms(_nearest(spark, d, i, q), lexical.file_frequency(data.chunks(spark, d)))


def _nearest(spark: S, d: str, index: lexical.Index, questions: DataFrame) -> DataFrame:
    """Each question's chunk with the most of its distinct terms, ties by id."""
    best = lexical.best_matches(index, lexical.query_terms(questions), 1, shared=True)
    return data.chunks(spark, d).join(small_side(stage(best.select("query_id", "chunk_id"), "nearest")), "chunk_id")


_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) > 2 and not list_contains([" + ", ".join(repr(w) for w in tx.STOP_WORDS) + "], x)))"


@query(f"""with p as (select doc_id, {_CONTENT.format('b.text')} a, {_CONTENT.format('coalesce(d.text, $$$$)')} b from documents d join (select text, row_number() over (order by item_id) - 1 place, count(*) over () n from benchmark) b on d.doc_id % n = place)
    select doc_id, round(coalesce(len(list_intersect(a, b))::double / nullif(len(list_distinct(list_concat(a, b))), 0), 0.0), 6) jaccard, round(coalesce(len(list_intersect(a, b))::double / nullif(len(b), 0), 0.0), 6) coverage,
        (len(b) - len(list_intersect(a, b)))::bigint n_avoided from p""")
def description_distance(spark: S, d: str) -> DataFrame:
    """Every document as the description of one question; the questions, by id, take the documents in turn."""
    q = data.questions(spark, d)
    ids = q.select("query_id").distinct().withColumns({"all": F.lit(0), "above": -F.col("query_id")})
    places = ranking.rank_within(ids, "all", "above", "query_id", "place", start=0, common=None).select("query_id", "place")
    turn = F.pmod(F.col("doc_id"), F.lit(max(places.count(), 1)))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("description"), turn.alias("place"))
    return lexical.description_distance(docs.join(places.join(q, "query_id"), "place")).select("doc_id", "jaccard", "coverage", "n_avoided")


@query(f"with {data.SCORES}, r as (select query_id, chunk_id, cosine, row_number() over (partition by query_id order by cosine desc, chunk_id) as rank from cosines) select query_id, chunk_id, round(cosine, 6) cosine, rank from r where rank <= 10")
def dense_topk(spark: S, d: str) -> DataFrame:
    found = dense.dense_top_k(dense.score_matrix(data.vectors(spark, d), data.question_vectors(spark, d)), 10)
    return found.select("query_id", "chunk_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query("""select a.vec_id a, b.vec_id b, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) similarity, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) >= 0.8 alarm
    from embeddings a join embeddings b on a.vec_id < b.vec_id where a.vec_id in (select item_id from benchmark) and b.vec_id in (select item_id from benchmark)""")
def dense_pairs(spark: S, d: str) -> DataFrame:
    return dense.similar_queries(data.question_vectors(spark, d))


@query(f"""with t as (select doc_id, list_transform({data.TOKENS.format('coalesce(text, $$$$)')}, lambda x: ('0x' || sha1(x)[1:8])::ubigint % 64) slots from documents),
    c as (select doc_id, list_transform(range(0, 64), lambda i: len(list_filter(slots, lambda s: s = i))::double) counts from t)
    select doc_id, round(case when list_dot_product(counts, counts) > 0 then list_dot_product(counts, list_transform(range(0, 64), lambda i: (i + 1)::double)) / sqrt(list_dot_product(counts, counts)) else 0.0 end, 6) projection from c""")
def hash_embedding(spark: S, d: str) -> DataFrame:
    """The model-free embedder, seen through one projection of each vector."""
    v = dense.hash_embedding(F.col("text"))
    weights = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.explode(F.array(v)).alias("v")).select("doc_id", F.round(dense.dot(F.col("v"), weights), 6).alias("projection"))


@query(f"with {data.FUSED} select query_id, rank, chunk_id, fused from fused where rank <= 20")
def rrf_hybrid(spark: S, d: str) -> DataFrame:
    return _top(_fused(spark, d, fusion.rrf("r_cosine", "r_bm25"), 20))


def _fused(spark: S, d: str, score: Column, depth: int, lighter: bool = False) -> DataFrame:
    return fusion.fuse(data.candidates(spark, d, [(score, depth)], lighter), score, depth)


def _top(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "fused")


def _fusion_sql(score: str, depth: int) -> str:
    return f"""with {data.RANKED}, f as (select query_id, chunk_id, round({score}, 10) fused from ranked),
        r as (select query_id, row_number() over (partition by query_id order by fused desc, chunk_id) as rank, chunk_id, fused from f) select * from r where rank <= {depth}"""


_WEIGHTED = "0.85::double / (60 + r_cosine + 1) + 0.15::double / (60 + r_bm25 + 1)"
_MIN_RANK = "-(least(r_cosine, r_bm25) + 1e-3::double * greatest(r_cosine, r_bm25))"


@query(_fusion_sql(_WEIGHTED, 20))
def rrf_weighted(spark: S, d: str) -> DataFrame:
    return _top(_fused(spark, d, fusion.rrf("r_cosine", "r_bm25", weights=(0.85, 0.15)), 20))


@query(_fusion_sql(_MIN_RANK, 20))
def min_rank_fusion(spark: S, d: str) -> DataFrame:
    return _top(_fused(spark, d, fusion.min_rank("r_cosine", "r_bm25"), 20))


@query(f"""with {data.RANKED}, f as (select k, query_id, chunk_id, round(1.0::double / (k + r_cosine + 1) + 1.0::double / (k + r_bm25 + 1), 10) fused from ranked, unnest([5, 10, 20, 30, 60, 100, 200]) t(k)),
    r as (select k, query_id, row_number() over (partition by k, query_id order by fused desc, chunk_id) as rank, chunk_id, fused from f) select * from r where rank <= 10""")
def rrf_k_sweep(spark: S, d: str) -> DataFrame:
    chosen = [(fusion.rrf("r_cosine", "r_bm25", k=k), 10) for k in fusion.SWEEP]
    return fusion.k_sweep(data.candidates(spark, d, chosen)).select("k", "query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "fused")


@query("""with l as (select doc_id group_id, string_split(coalesce(text, ''), ' ') items from documents union all select doc_id, list_reverse(string_split(coalesce(text, ''), ' ')) from documents),
    p as (select group_id, unnest(items) item, unnest(range(1, len(items) + 1)) i from l) select group_id, item, round(sum(1.0::double / (60 + i)), 10) score from p group by all""")
def rrf_lists(spark: S, d: str) -> DataFrame:
    """Two rankings of each document's words, as they stand and backwards, fused."""
    words = F.split(F.coalesce("text", F.lit("")), " ", -1)
    return fusion.rrf_rankings(table(spark, d, "documents").select(F.col("doc_id").alias("group_id"), F.array(words, F.reverse(words)).alias("rankings")))


_STRATEGIES = {"s1_rrf_20": (data.RRF, 20), "s2_vector_20": ("-r_cosine::double", 20), "s3_weighted_20": (f"round({_WEIGHTED}, 10)", 20), "s4_rrf_40": (data.RRF, 40), "s5_min_rank_20": (f"round({_MIN_RANK}, 10)", 20), "s6_vector_40": ("-r_cosine::double", 40)}
GRID_SQL = f"{data.RANKED}, long as (" + " union all ".join(f"select '{n}' strategy, {depth} depth, query_id, chunk_id, {score} fused from ranked" for n, (score, depth) in _STRATEGIES.items()) + """),
    strategy_grid as (select * from (select strategy, depth, query_id, chunk_id, row_number() over (partition by strategy, query_id order by fused desc, chunk_id) as rank from long) where rank <= depth)"""


@query(f"with {GRID_SQL} select strategy, query_id, rank, chunk_id from strategy_grid")
def strategy_grid(spark: S, d: str) -> DataFrame:
    return strategies_of(spark, d).withColumn("rank", F.col("rank").cast("long"))


def strategies_of(spark: S, d: str, chosen: list[fusion.Strategy] | None = None) -> DataFrame:
    own = chosen or fusion.strategies()
    return fusion.strategy_grid(data.candidates(spark, d, [(s.score, s.depth) for s in own]), own)


_DOWN = f"""{data.SCORES}, down as (select query_id, chunk_id, is_overview, symbol, text, round(case when is_overview then bm25 * 0.3::double else bm25 end, 8) bm25, round(case when is_overview then cosine * 0.3::double else cosine end, 8) cosine from scores),
    ranked as (select *, row_number() over (partition by query_id order by cosine desc, chunk_id) - 1 r_cosine, row_number() over (partition by query_id order by bm25 desc, chunk_id) - 1 r_bm25 from down),
    fused as (select *, {data.RRF} fused from ranked)"""


@query(f"with {_DOWN}, r as (select query_id, row_number() over (partition by query_id order by fused desc, chunk_id) as rank, chunk_id, fused from fused) select * from r where rank <= 20")
def overview_downweight(spark: S, d: str) -> DataFrame:
    return _top(_fused(spark, d, fusion.rrf("r_cosine", "r_bm25"), 20, lighter=True))


_DEDUP = f"""{_DOWN}, one as (select *, row_number() over (partition by query_id, symbol order by fused desc, chunk_id) n from fused),
    recalled as (select * from (select *, row_number() over (partition by query_id order by fused desc, chunk_id) as rank from one where n = 1) where rank <= 20)"""


@query(f"with {_DEDUP} select query_id, rank, chunk_id, symbol, fused from recalled")
def symbol_dedup_topn(spark: S, d: str) -> DataFrame:
    return _symbols(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "symbol", "fused")


def _symbols(spark: S, d: str, top: int = 20, parts: list[fused.Part] | None = None) -> DataFrame:
    """The best part of the best symbols, by candidates of a depth at which no other part can be among them."""
    score, symbols = fusion.rrf("r_cosine", "r_bm25"), data.chunks(spark, d).select("chunk_id", "is_overview", "symbol")
    found = []
    for part in parts or data.parts(spark, d, lighter=True):
        depth = fused.enough(part, [(score, top)])
        while True:
            known = fused.candidates(part, depth).withColumn("fused", F.round(score, 10)).join(symbols, "chunk_id")
            best = stage(fusion.best_per_symbol(known, top), "symbols")
            least = F.round(fusion.rrf("d", "d"), 10)
            done = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("fused").alias("worst")).withColumn("d", F.lit(depth))
            if depth >= part.n_chunks or done.where((F.col("n") == top) & (F.col("worst") > least)).count() == len(part.ids):
                break
            depth *= 4
        found.append(best)
    return reduce(DataFrame.unionByName, found)


_SCORER = "round(coalesce(len(list_filter(list_distinct({q}), lambda x: list_contains({t}, x)))::double / nullif(len(list_distinct({q})), 0), 0.0), 6)"
_RERANK = f"""{_DEDUP}, rescored as (select r.query_id, chunk_id, r.is_overview, {_SCORER.format(q=data.TOKENS.format("q"), t=data.TOKENS.format("r.text[1:768]"))} score from recalled r join questions using (query_id)),
    final as (select query_id, chunk_id, round(case when is_overview then score * 0.3::double else score end, 6) rerank_score from rescored)"""


@query(f"with {_RERANK}, r as (select query_id, row_number() over (partition by query_id order by rerank_score desc, chunk_id) as rank, chunk_id, rerank_score from final) select * from r where rank <= 5")
def code_search(spark: S, d: str) -> DataFrame:
    """Two-stage code search: weighted-down fusion, one part a symbol, rerank of cut texts, weight again."""
    return code_hits(spark, d).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "rerank_score")


def code_hits(spark: S, d: str) -> DataFrame:
    recalled = _symbols(spark, d).drop("rank").join(data.questions(spark, d), "query_id").join(data.chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    scored = recalled.withColumn("rerank_score", fusion.overlap_score(F.col("q"), F.substring("text", 1, fusion.RERANK_CHARS)))
    final = scored.withColumn("rerank_score", F.round(fusion.downweight(F.col("rerank_score"), F.col("is_overview")), 6))
    return fusion.top_k(final, "query_id", 5, [F.desc("rerank_score"), F.asc("chunk_id")])


def recalled(spark: S, d: str, depth: int = 20) -> DataFrame:
    """Question, text and file of the fused candidates."""
    found = _fused(spark, d, fusion.rrf("r_cosine", "r_bm25"), depth).select("query_id", "chunk_id")
    return found.join(data.questions(spark, d), "query_id").join(data.chunks(spark, d).select("chunk_id", "text", "doc"), "chunk_id")


_CANDIDATES = f"""{data.FUSED}, candidates as (select f.query_id, chunk_id, q, text, doc from fused f join questions using (query_id) where rank <= 20),
    reranked as (select query_id, chunk_id, text, doc, score rerank_score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (select *, {_SCORER.format(q=data.TOKENS.format("q"), t=data.TOKENS.format("text"))} score from candidates))"""


@query(f"with {_CANDIDATES} select query_id, rank, chunk_id, rerank_score from reranked where rank <= 5")
def rerank_topk(spark: S, d: str) -> DataFrame:
    return fusion.rerank(recalled(spark, d)).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "rerank_score")


@query(f"""with {data.BM25}, top as (select * from (select query_id, chunk_id, row_number() over (partition by query_id order by round(bm25, 8) desc, chunk_id) n from matches) where n <= 20),
    c as (select t.query_id, chunk_id, {_SCORER.format(q=data.TOKENS.format("q"), t=data.TOKENS.format("text"))} rerank_score from top t join questions using (query_id) join chunks using (chunk_id)),
    r as (select query_id, row_number() over (partition by query_id order by rerank_score desc, chunk_id) as rank, chunk_id, rerank_score from c) select * from r where rank <= 5""")
def rerank_bm25_recall(spark: S, d: str) -> DataFrame:
    """Rerank over another recall source: BM25 alone."""
    top = lexical.best_matches(data.index(spark, d), lexical.query_terms(data.questions(spark, d)), 20, digits=8).select("query_id", "chunk_id")
    cand = small_side(stage(top, "recalled")).join(data.questions(spark, d), "query_id").join(data.chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    return fusion.rerank(cand).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "rerank_score")


@query(f"with {_CANDIDATES} select g.query_id, g.chunk_id, coalesce((20 - r.rank + 1)::double, '-infinity'::double) row_score from grid g left join reranked r on r.query_id = g.query_id and r.chunk_id = g.chunk_id")
def rerank_row(spark: S, d: str) -> DataFrame:
    grid = data.chunks(spark, d).select("chunk_id").crossJoin(small_side(data.questions(spark, d).select("query_id")))
    return fusion.rerank_row(grid, fusion.rerank(recalled(spark, d), top=20)).select("query_id", "chunk_id", "row_score")


@query(f"""with {_DEDUP}, {data.GOLD}, target as (select query_id, min(gold) gold from gold group by query_id),
    ranks as (select r.query_id, chunk_id, r_cosine + 1 v, r_bm25 + 1 b, row_number() over (partition by r.query_id order by fused desc, chunk_id) f, contains(text, gold) hit from fused r join target t on t.query_id = r.query_id),
    first as (select query_id, min(case when hit then v end) rank_vector, min(case when hit then b end) rank_bm25, min(case when hit then f end) rank_fused from ranks group by query_id),
    ded as (select r.query_id, min(case when contains(text, gold) then rank end) rank_dedup from recalled r join target t on t.query_id = r.query_id group by r.query_id)
    select query_id, rank_vector, rank_bm25, rank_fused, rank_dedup, coalesce(rank_fused <= 20, false) recalled from first left join ded using (query_id)""")
def stage_diagnosis(spark: S, d: str) -> DataFrame:
    """Where the first chunk with a question's least gold string stands after each stage."""
    target = data.gold(spark, d).groupBy("query_id").agg(F.min("gold").alias("gold"))
    found = stage(metrics.occurrences(data.chunks(spark, d), target).select("query_id", "chunk_id"), "found")
    parts = data.parts(spark, d, lighter=True)
    first = target.select("query_id").where(F.lit(parts[0].n_chunks > 0))
    for score, name in ((-F.col("r_cosine").cast("double"), "rank_vector"), (-F.col("r_bm25").cast("double"), "rank_bm25"), (fusion.rrf("r_cosine", "r_bm25"), "rank_fused")):
        ranks = reduce(DataFrame.unionByName, [fused.ranked_until(part, score, found, ["query_id"], 20) for part in parts])
        first = first.join(found.join(small_side(ranks), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias(name)), "query_id", "left")
    ded = found.join(small_side(_symbols(spark, d, parts=parts)), ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").cast("long").alias("rank_dedup"))
    return first.join(ded, "query_id", "left").withColumn("recalled", F.coalesce(F.col("rank_fused") <= 20, F.lit(False)))


@query(f"""with {_CANDIDATES}, {data.PASSAGES}, top as (select * from reranked join passages using (chunk_id) where rank <= 10), firsts as (select query_id, parent, min(rank) r from top group by all)
    select query_id, parent, row_number() over (partition by query_id order by r) as rank from firsts""")
def parent_expand(spark: S, d: str) -> DataFrame:
    """Passages of the reranked chunks (named by the hash of their text), in the order of their first chunk."""
    top = fusion.rerank(recalled(spark, d), top=10).drop("text").join(data.parents(spark, d), "chunk_id")
    return context.expand_parents(top).select("query_id", "parent", F.col("rank").cast("long").alias("rank"))


_MARK = context.CUT_MARK.replace("\n", "' || chr(10) || '")


def _pack_sql(source: str, keys: str, text: str, most: int) -> str:
    n = len(context.CUT_MARK)
    return f"""cum as (select *, sum(length({text})) over (partition by {keys} order by rank) c from {source}),
        room as (select *, {most} - (c - length({text})) room from cum), cuts as (select {keys}, min(rank) cut_at from room where c > {most} and room >= 0 group by all),
        packed as (select room.* exclude ({text}), case when c <= {most} then {text} when room > {n} then {text}[1:room - {n}] || '{_MARK}' else {text}[1:room] end {text}, c > {most} truncated from room left join cuts using ({keys}) where room >= 0 and (cut_at is null or rank <= cut_at))"""


@query(f"with {_CANDIDATES}, {_pack_sql('reranked', 'query_id', 'text', 8000)} select query_id, rank, chunk_id, length(text)::bigint n_chars, sha1(text) digest, truncated from packed")
def pack_budget(spark: S, d: str) -> DataFrame:
    packed = context.pack_budget(fusion.rerank(recalled(spark, d), top=20), 8000, ["query_id"])
    return packed.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.length("text").cast("long").alias("n_chars"), F.sha1(F.col("text").cast("binary")).alias("digest"), "truncated")


@query(f"""with {_CANDIDATES}, {data.PASSAGES}, top as (select query_id, rank, '{tx.SOURCE_MARK}' || doc || ']' || chr(10) || parent_text as text from reranked join passages using (chunk_id) where rank <= 5),
    firsts as (select query_id, text, min(rank) as rank from top group by all), {_pack_sql('firsts', 'query_id', 'text', 8000)}
    select query_id, count(*) n_items, sha1(string_agg(text, chr(10) || chr(10) order by rank)) digest from packed group by query_id""")
def search_context(spark: S, d: str) -> DataFrame:
    """The whole document search: recall, rerank, parents once each, headers, budget, one context."""
    top = fusion.rerank(recalled(spark, d), top=5).drop("text").join(data.parents(spark, d).drop("parent"), "chunk_id").withColumn("parent", context.with_header(F.col("doc"), F.col("text")))
    once = context.expand_parents(top.drop("text")).select("query_id", "rank", F.col("parent").alias("text"))
    joined = context.join_context(context.pack_budget(once, 8000, ["query_id"]), ["query_id"])
    return joined.select("query_id", "n_items", F.sha1(F.col("context").cast("binary")).alias("digest"))


@query(f"""with {_RERANK}, r as (select query_id, row_number() over (partition by query_id order by rerank_score desc, chunk_id) as rank, chunk_id from final), top as (select query_id, rank, text from r join chunks using (chunk_id) where rank <= 5),
    {_pack_sql('top', 'query_id', 'text', 12000)} select query_id, count(*) n_items, sha1(string_agg(text, chr(10) || chr(10) order by rank)) digest from packed group by query_id""")
def code_context(spark: S, d: str) -> DataFrame:
    """The code search's passages in a budget of 12000 characters, one context a question."""
    top = code_hits(spark, d).select("query_id", "rank", "text")
    joined = context.join_context(context.pack_budget(top, 12_000, ["query_id"]), ["query_id"])
    return joined.select("query_id", "n_items", F.sha1(F.col("context").cast("binary")).alias("digest"))
