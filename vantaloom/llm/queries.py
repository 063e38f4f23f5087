"""The queries of the ten operators over their whole tables, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vantaloom.llm import alignment, bpe, embedding_dedup, hard_negatives, ngram_join, packing, quality, secrets, telephony, token_archive, toxicity, url_filter, warc
from vantaloom.sources.runtime import stage, table

# The rules of the url query.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), with_ids=False)


def op5_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = token_archive.write_archive(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return token_archive.global_starts(token_archive.read_archive(archive), archive)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.media_features(telephony.store_media(table(spark, sf_dir, "documents")))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # The base rules are scanned first; the others come later, and the ledger leaves the base rules' pairs out.
    _, ledger = secrets.scan_documents(docs, rules=secrets.BASE)
    return secrets.scan_documents(docs, ledger=ledger)[0]


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(scored["doc_id"]).alias("held_out"), "score", "predicted", "n_segments", "segments")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = stage(quality.measure(table(spark, sf_dir, "documents"), "text", ["doc_id", "lang"]), "measures")
    certified = stage(quality.certify(measured, table(spark, sf_dir, "labels")), "cutoffs")
    return quality.judge(measured, certified).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.of_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filter, op2_embedding_dedup, op3_ngram_jaccard, op4_packing, op5_token_archive, op6_bpe, op7_telephony, op8_secrets, op9_toxicity, op10_warc, op11_quality_rules, op12_token_alignment, op13_hard_negatives)
}


def _url_sql() -> str:
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    ordered = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"when {fits(h, p)} then '{v}'" for v, h, p in ordered)
    return f"""
        with cut as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
        host as (select page_id, rest, regexp_extract(rest, '(?s)^([^/?#]*)', 1) own from cut),
        parts as (select page_id, translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
            regexp_extract(substr(rest, length(own) + 1), '(?s)^([^?#]*)', 1) path from host)
        select page_id, coalesce(host, '') host, coalesce(path, '') path, case {rule} end as rule, case {verdict} else 'allow' end as verdict from parts"""


def _secret_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts, kinds = [], []
    for n, rule in enumerate(secrets.RULES):
        parts.append(f"""
            select blob, {n} as rule_no, i, gaps, sizes, kept from (select blob, list_transform(string_split_regex(text, {q(rule.pattern)}), lambda x: length(x)) gaps,
                list_transform(regexp_extract_all(text, {q(rule.pattern)}), lambda x: length(x)) sizes,
                list_transform(regexp_extract_all(text, {q(rule.pattern)}, {rule.group}), lambda x: length(x)) kept from blobs), unnest(range(1, len(sizes) + 1)) t(i)
            where kept[i] >= {rule.least}""")
        kinds.append(q(rule.kind))
    names = f"[{', '.join(kinds)}]"
    return f"""
        with docs as (select doc_id, coalesce(text, '') as text, sha256(coalesce(text, '')) as blob from documents),
        blobs as (select blob, any_value(text) as text from docs group by blob),
        found as ({' union all '.join(parts)}),
        spans as (select blob, rule_no, list_sum(gaps[1:i]) + coalesce(list_sum(sizes[1:i - 1]), 0) as s, sizes[i] as n from found),
        rows as (select blob, rule_no, s, {names}[rule_no + 1] || ':' || cast(s as bigint) || ':' || cast(s + n as bigint) as word from spans),
        per_blob as (select blob, count(*) filter (rule_no = 0) n_assign, count(*) filter (rule_no = 1) n_access, count(*) filter (rule_no = 2) n_hex,
            coalesce(string_agg(word, ',' order by s, rule_no) filter (rule_no < {len(secrets.BASE)}), '') base, string_agg(word, ',' order by s, rule_no) spans from rows group by blob)
        select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex,
            sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from docs left join per_blob using (blob)"""


WARC_SQL = """
    with p as (select page_id, coalesce(html, '') as html from pages),
    d as (select page_id, octet_length(encode(html)) as n, sha1(html) as digest from p),
    w as (select *, case when n >= 1000 then max(page_id) over (partition by digest, n >= 1000) else page_id end as winner from d)
    select page_id, n::bigint payload_bytes, digest as payload_digest, case when winner = page_id then 'response' else 'revisit' end record_type,
        case when winner <> page_id then winner end refers_to from w"""

COSINE_SQL = """
    with recursive v as (select vec_id, cast(embedding as double[]) e from embeddings where embedding is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    unit as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) u from v),
    links as (select a.vec_id x, b.vec_id y from unit a join unit b on a.vec_id <> b.vec_id and list_dot_product(a.u, b.u) >= 0.9),
    reach(x, y) as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
    least as (select x, min(y) m from reach group by x)
    select vec_id, (select count(*) from links where x = vec_id)::bigint n_links, least(vec_id, coalesce(m, vec_id)) component_id,
        least(vec_id, coalesce(m, vec_id)) = vec_id as kept from embeddings left join least on x = vec_id"""

JACCARD_SQL = """
    with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') words from documents),
    sets as (select doc_id, list_distinct(case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) when len(words) > 0 then [array_to_string(words, ' ')] else [] end) s from w),
    grams as (select doc_id, len(s) n, hash(g) g from (select doc_id, s, unnest(s) g from sets)),
    overlap as (select a.doc_id x, b.doc_id y, a.n nx, b.n ny, count(*) i from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by all),
    links as (select x, y from overlap where 100 * i >= 80 * (nx + ny - i)),
    reach(x, y) as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
    first as (select x, min(y) m from reach group by x)
    select doc_id, len(s)::bigint n_shingles, least(doc_id, coalesce(m, doc_id)) component_id from sets left join first on x = doc_id"""

SQL: dict[str, str] = {"op3_ngram_jaccard": JACCARD_SQL, "op1_url_filter": _url_sql(), "op2_embedding_dedup": COSINE_SQL, "op8_secrets": _secret_sql(), "op10_warc": WARC_SQL, "op11_quality_rules": quality.oracle(), "op13_hard_negatives": hard_negatives.ORACLE}
