"""Queries of chunking, text functions and Python sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vantaloom.functions import text as tx
from vantaloom.operators import chunking, code, integrity
from vantaloom.plans.registry import query
from vantaloom.sources.runtime import table

S = SparkSession
_LF = "chr(10)"


@query("""with p as (select doc_id, i as start, text[i + 1:i + 500] chunk from documents, unnest(case when length(text) > 0 then range(0, length(text), 450) else [] end) t(i))
    select doc_id, row_number() over (partition by doc_id order by start) - 1 ord, start, length(chunk)::bigint n_chars, sha1(chunk) digest from p where regexp_matches(chunk, '\\S')""")
def chunk_fixed(spark: S, d: str) -> DataFrame:
    found = chunking.explode_chunks(table(spark, d, "documents").select("doc_id", "text"), chunking.fixed_chunks(F.col("text")))
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), F.col("chunk.start").cast("long").alias("start"), F.length("chunk.text").cast("long").alias("n_chars"), _sha(F.col("chunk.text")))


def _sha(c: Column, name: str = "digest") -> Column:
    return F.sha1(c.cast("binary")).alias(name)


def _markdown(spark: S, d: str) -> DataFrame:
    """Documents as Markdown: a title, every sentence line a section, some third-level headings and fences."""
    text = F.coalesce("text", F.lit(""))
    for a, b in ((".\n", ".\n## "), (", the", "\n### the"), (" of ", "\n```\nof ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), text).alias("text"))


_MD = f"""md as (select doc_id, '# ' || source || {_LF} || replace(replace(replace(coalesce(text, ''), '.' || {_LF}, '.' || {_LF} || '## '), ', the', {_LF} || '### the'), ' of ', {_LF} || '```' || {_LF} || 'of ') as text from documents),
    ls as (select doc_id, string_split(text, {_LF}) ls from md), lines as (select doc_id, i, ls[i] line, starts_with(trim(ls[i]), '```') fence from ls, unnest(range(1, len(ls) + 1)) t(i)),
    fenced as (select *, coalesce(sum(fence::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) % 2 = 1 inside from lines)"""


def _sections(level: int, source: str = "fenced", name: str = "sections") -> str:
    return f"""{name}_cut as (select *, not fence and not inside and regexp_matches(line, '^#{{1,{level}}}\\s') cut from {source}),
    {name} as (select *, sum(cut::int) over (partition by doc_id order by i) sec from {name}_cut)"""


def _packed(source: str, keys: str, most: int = 1000) -> str:
    """Chunks of sections: rows (keys, sec, heading) with stripped lines in order, folded by a recursive query."""
    return f"""heads as (select {keys}, sec, max(case when cut then line end) heading from {source} group by all),
    body as (select {keys}, sec, i, trim(line) line from {source} where not cut and trim(line) <> ''),
    numbered as (select b.*, row_number() over (partition by {keys}, sec order by i) n, case when heading is null then 0 else length(heading) + 1 end p from body b join heads using ({keys}, sec)),
    fold as (select {keys}, sec, n, length(line) cur, 0 part from numbered where n = 1 union all
        select {', '.join('x.' + k.strip() for k in keys.split(','))}, x.sec, x.n, case when p + f.cur + length(line) + 1 > {most} then length(line) else f.cur + 1 + length(line) end, case when p + f.cur + length(line) + 1 > {most} then part + 1 else part end
        from fold f join numbered x on {' and '.join(f'x.{k.strip()} = f.{k.strip()}' for k in keys.split(','))} and x.sec = f.sec and x.n = f.n + 1),
    parts as (select {keys}, sec, part, trim(case when any_value(heading) is null then '' else any_value(heading) || {_LF} end || string_agg(line, {_LF} order by n)) chunk from fold join numbered using ({keys}, sec, n) join heads using ({keys}, sec) group by {keys}, sec, part
        union all select {keys}, sec, 0, trim(heading) from heads h where heading is not null and trim(heading) <> '' and not exists (select 1 from body b where {' and '.join(f'b.{k.strip()} = h.{k.strip()}' for k in keys.split(','))} and b.sec = h.sec))"""


@query(f"with recursive {_MD}, {_sections(6)}, {_packed('sections', 'doc_id')} select doc_id, row_number() over (partition by doc_id order by sec, part) - 1 ord, length(chunk)::bigint n_chars, sha1(chunk) digest from parts")
def chunk_markdown(spark: S, d: str) -> DataFrame:
    found = chunking.explode_chunks(_markdown(spark, d), chunking.markdown_chunks(F.col("text")))
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), F.length("chunk").cast("long").alias("n_chars"), _sha(F.col("chunk")))


_PARENT = f"""{_MD}, {_sections(2, name='coarse')}, outers as (select doc_id, sec psec, max(case when cut then line end) phead, trim(string_agg(line, {_LF} order by i)) parent, string_agg(case when not cut then line end, {_LF} order by i) pbody from coarse group by all),
    inner_lines as (select o.doc_id, sec psec, i, line, fence, coalesce(sum(fence::int) over (partition by o.doc_id, sec order by i rows between unbounded preceding and 1 preceding), 0) % 2 = 1 inside from coarse o where not cut),
    inner_cut as (select *, not fence and not inside and regexp_matches(line, '^#{{1,6}}\\s') cut from inner_lines), sections as (select *, sum(cut::int) over (partition by doc_id, psec order by i) sec from inner_cut),
    heads as (select s.doc_id, psec, sec, case when sec = 0 then any_value(phead) else max(case when cut then line end) end heading from sections s join outers using (doc_id, psec) group by s.doc_id, psec, sec),
    body as (select doc_id, psec, sec, i, trim(line) line from sections where not cut and trim(line) <> ''),
    numbered as (select b.*, row_number() over (partition by doc_id, psec, sec order by i) n, case when heading is null then 0 else length(heading) + 1 end p from body b join heads using (doc_id, psec, sec)),
    fold as (select doc_id, psec, sec, n, length(line) cur, 0 part from numbered where n = 1 union all
        select x.doc_id, x.psec, x.sec, x.n, case when p + f.cur + length(line) + 1 > 1000 then length(line) else f.cur + 1 + length(line) end, case when p + f.cur + length(line) + 1 > 1000 then part + 1 else part end
        from fold f join numbered x on x.doc_id = f.doc_id and x.psec = f.psec and x.sec = f.sec and x.n = f.n + 1),
    parts as (select doc_id, psec, sec, part, trim(case when any_value(heading) is null then '' else any_value(heading) || {_LF} end || string_agg(line, {_LF} order by n)) chunk from fold join numbered using (doc_id, psec, sec, n) join heads using (doc_id, psec, sec) group by doc_id, psec, sec, part
        union all select doc_id, psec, sec, 0, trim(heading) from heads h where heading is not null and trim(heading) <> '' and not exists (select 1 from body b where b.doc_id = h.doc_id and b.psec = h.psec and b.sec = h.sec)
        union all select doc_id, psec, 0, 0, trim(phead) from outers o where phead is not null and pbody is null)"""


@query(f"with recursive {_PARENT} select doc_id, row_number() over (partition by doc_id order by psec, sec, part) - 1 ord, sha1(chunk) digest, sha1(parent) parent_digest from parts join outers using (doc_id, psec)")
def chunk_parent(spark: S, d: str) -> DataFrame:
    found = chunking.explode_chunks(_markdown(spark, d), chunking.parent_chunks(F.col("text")))
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), _sha(F.col("chunk.chunk")), _sha(F.col("chunk.parent"), "parent_digest"))


@query("""with l as (select doc_id, line, count(*) n from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line from documents) group by all) select doc_id, count(*) n_lines, sum(n)::bigint n_all from l group by doc_id""")
def chunk_parity(spark: S, d: str) -> DataFrame:
    """Two ways to cut lines agree: parity leaves nothing, so every document has all its distinct lines."""
    from vantaloom.operators.integrity import parity

    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one = docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    two = docs.select("doc_id", F.explode(F.split(F.concat("text", F.lit("\n")), "\n", -1)).alias("line"), F.length("text").alias("n"))
    two = two.groupBy("doc_id", "line").agg(F.count("*").alias("k")).select("doc_id", "line", F.explode(F.sequence(F.lit(1), F.col("k").cast("int") - F.when(F.col("line") == "", 1).otherwise(0))).alias("x")).where("x > 0 and k - if(line = '', 1, 0) > 0").select("doc_id", "line")
    off = parity(one, two).groupBy("doc_id").agg(F.sum("n").alias("off"))
    return one.groupBy("doc_id").agg(F.countDistinct("line").alias("n_lines"), F.count("*").alias("n_all")).join(off, "doc_id", "left").select("doc_id", "n_lines", (F.col("n_all") - F.coalesce("off", F.lit(0))).alias("n_all"))


@query(f"""with a as (with recursive {_MD}, {_sections(6)}, {_packed('sections', 'doc_id')} select doc_id, sha1(chunk) digest, count(*) n from parts group by all), b as (with recursive {_PARENT} select doc_id, sha1(chunk) digest, count(*) n from parts group by all)
    select doc_id, coalesce(sum(a.n), 0)::bigint n_markdown, coalesce(sum(b.n), 0)::bigint n_parent, sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0))::bigint only_markdown, sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0))::bigint only_parent from a full join b using (doc_id, digest) group by doc_id""")
def chunker_parity(spark: S, d: str) -> DataFrame:
    """The chunker with parents against the one without: only a heading directly above a finer one is a chunk for the latter alone."""
    docs = _markdown(spark, d)
    one = chunking.explode_chunks(docs, chunking.markdown_chunks(F.col("text"))).select("doc_id", _sha(F.col("chunk")))
    two = chunking.explode_chunks(docs, chunking.parent_chunks(F.col("text"))).select("doc_id", _sha(F.col("chunk.chunk")))
    off = integrity.parity(one, two).select("doc_id", "side", "n").withColumns({"a": F.lit(0), "b": F.lit(0)})
    sizes = [f.select("doc_id", F.lit("all").alias("side"), F.lit(0).cast("long").alias("n"), F.lit(x).alias("a"), F.lit(1 - x).alias("b")) for f, x in ((one, 1), (two, 0))]
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0))
    return off.unionByName(sizes[0]).unionByName(sizes[1]).groupBy("doc_id").agg(F.sum("a").alias("n_markdown"), F.sum("b").alias("n_parent"), side("left").alias("only_markdown"), side("right").alias("only_parent"))


_COUNT = "len(regexp_extract_all({0}, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'))"


@query(f"""with recursive src as (select doc_id, '[source d' || doc_id || '.py:1-9 | function f]' || {_LF} || replace(coalesce(text, ''), ', ', {_LF}) as text from documents),
    ls as (select doc_id, text, string_split(text, {_LF}) ls, {_COUNT.format('text')} total from src), small as (select * from ls where total <= 460), big as (select *, 460 - {_COUNT.format('ls[1]')} - 7 room from ls where total > 460),
    lines as (select doc_id, i - 1 n, ls[i] line, {_COUNT.format('ls[i]')} + 1 cost, case when room <= 0 then 460 else room end budget from big, unnest(range(2, len(ls) + 1)) t(i)),
    fold as (select doc_id, n, cost used, 1 part from lines where n = 1 union all select x.doc_id, x.n, case when used + cost > budget then cost else used + cost end, case when used + cost > budget then part + 1 else part end from fold f join lines x on x.doc_id = f.doc_id and x.n = f.n + 1),
    parts as (select doc_id, part, string_agg(line, {_LF} order by n) body from fold join lines using (doc_id, n) group by doc_id, part), sizes as (select doc_id, max(part) k from parts group by doc_id)
    select doc_id, (part - 1)::bigint ord, sha1(ls[1] || ' [part ' || part || '/' || k || ']' || {_LF} || body) digest from parts join sizes using (doc_id) join big using (doc_id) union all select doc_id, 0, sha1(text) from small""")
def split_long(spark: S, d: str) -> DataFrame:
    header = F.concat(F.lit("[source d"), F.col("doc_id").cast("string"), F.lit(".py:1-9 | function f]\n"))
    docs = table(spark, d, "documents").select("doc_id", F.concat(header, F.replace(F.coalesce("text", F.lit("")), F.lit(", "), F.lit("\n"))).alias("text"))
    return chunking.explode_chunks(docs, chunking.split_long(F.col("text"))).select("doc_id", F.col("ord").cast("long").alias("ord"), _sha(F.col("chunk")))


@query(f"""select doc_id, case when lang = 'de' then sha1(t) when instr(t, {_LF}) > 0 then sha1(t[1:instr(t, {_LF}) - 1] || {_LF} || '# ' || source || {_LF} || t[instr(t, {_LF}) + 1:]) else sha1(t || {_LF} || '# ' || source || {_LF}) end digest
    from (select doc_id, lang, source, coalesce(text, '') t from documents)""")
def inject_desc(spark: S, d: str) -> DataFrame:
    description = F.when(F.col("lang") == "de", F.lit("")).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", _sha(chunking.inject(F.coalesce("text", F.lit("")), description)))


@query("select doc_id, sha1(regexp_replace('x.py:' || doc_id || '-' || n_chars || ' ' || coalesce(text, ''), ':[0-9]+-[0-9]+', '', 'g')) as key from documents")
def chunk_key(spark: S, d: str) -> DataFrame:
    text = F.concat(F.lit("x.py:"), F.col("doc_id").cast("string"), F.lit("-"), F.col("n_chars").cast("string"), F.lit(" "), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", tx.chunk_key(text).alias("key"))


@query("select doc_id, '[source ' || source || ':1-2 | function f]' as key from documents")
def symbol_key(spark: S, d: str) -> DataFrame:
    part = F.concat(F.lit("[source "), F.col("source"), F.lit(":1-2 | function f] [part "), (F.col("doc_id") % 7 + 1).cast("string"), F.lit("/9]\n"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", tx.symbol_key(part).alias("key"))


@query("""select doc_id, s.symbol, regexp_matches(coalesce(text, ''), '(^|[^A-Za-z0-9_])' || s.symbol || '([^A-Za-z0-9_]|$)') hit from documents, (values ('the'), ('token'), ('an'), ('des')) s(symbol)""")
def symbol_match(spark: S, d: str) -> DataFrame:
    symbols = F.explode(F.array(*[F.lit(w) for w in ("the", "token", "an", "des")])).alias("symbol")
    return table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), symbols).select("doc_id", "symbol", tx.has_symbol(F.col("text"), F.col("symbol")).alias("hit"))


@query("""with t as (select doc_id, coalesce(text, '') as text from documents) select doc_id, case when contains(text, 'the') then sha1(text[1:instr(text, 'the') - 1] || 'THE' || text[instr(text, 'the') + 3:]) end digest,
    case when contains(text, 'the') then (len(string_split(text, 'the')) - 2)::int end remaining from t""")
def edit_first(spark: S, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    edited = docs.select("doc_id", tx.edit_first(F.col("text"), F.lit("the"), F.lit("THE")).alias("e"))
    return edited.select("doc_id", _sha(F.col("e.text")), F.col("e.remaining").alias("remaining"))


@query(f"""with t as (select doc_id, text, case when doc_id % 3 = 0 then 'See:' || {_LF} || '```python' || {_LF} || text || {_LF} || '```' else text end answer from (select doc_id, coalesce(text, '') as text from documents)) select doc_id, sha1(case when doc_id % 3 = 0 then trim(text, ' ' || {_LF} || chr(9) || chr(13)) else text end) digest from t""")
def extract_code(spark: S, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    answer = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("See:\n```python\n"), text, F.lit("\n```"))).otherwise(text)
    return table(spark, d, "documents").select("doc_id", _sha(tx.extract_code(answer)))


@query(f"""select doc_id, sha1('{tx.PROMPT_HEAD}' || '{tx.SOURCE_MARK}' || source || ']' || {_LF} || coalesce(text, '') || {_LF} || {_LF} || '{tx.SOURCE_MARK}' || lang || ']' || {_LF} || 'x' || '{tx.PROMPT_QUESTION}' || source || {_LF}) digest from documents""")
def build_prompt(spark: S, d: str) -> DataFrame:
    prompt = tx.build_prompt(F.array("source", "lang"), F.array(F.coalesce("text", F.lit("")), F.lit("x")), F.col("source"))
    return table(spark, d, "documents").select("doc_id", _sha(prompt))


_INLINE = [(" in ", "\n- in **it** "), (" to ", "\n* *to* "), (" and ", "\n12. `and` & "), (" is ", " [is](u?a=1&b=2) "), (" de ", "\n+ <de> ")]


def _escape_sql(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _inline_sql(text: str) -> str:
    out = _escape_sql(text)
    for pattern, into in (("`([^`]+)`", r"<code>\1</code>"), (r"\*\*([^*]+)\*\*", r"<strong>\1</strong>"), (r"\*([^*]+)\*", r"<em>\1</em>"), (r"\[([^\]]+)\]\(([^)]+)\)", r'<a href="\2" target="_blank" rel="noopener">\1</a>')):
        out = f"regexp_replace({out}, '{pattern}', '{into}', 'g')"
    return out


def _marked_sql() -> str:
    out = "text"
    for a, b in _INLINE:
        out = f"replace({out}, '{a}', '" + b.replace("\n", f"' || {_LF} || '") + "')"
    return out


@query(f"""with {_MD}, hl as (select doc_id, string_split({_marked_sql()}, {_LF}) ls from md), hlines as (select doc_id, i, ls[i] line, regexp_matches(ls[i], '{tx.MD_FENCE}') fence from hl, unnest(range(1, len(ls) + 1)) t(i)),
    hcount as (select *, coalesce(sum(fence::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) n from hlines),
    hkind as (select *, case when fence and n % 2 = 1 then 'close' when fence then 'open' when n % 2 = 1 then 'code' when regexp_matches(line, '{tx.MD_BLANK}') then 'blank' when regexp_matches(line, '{tx.MD_HEADING}') then 'h'
        when regexp_matches(line, '{tx.MD_BULLET}') then 'ul' when regexp_matches(line, '{tx.MD_NUMBER}') then 'ol' else 'p' end kind from hcount),
    hblock as (select *, sum((kind not in ('ul', 'ol'))::int) over (partition by doc_id order by i) block from hkind),
    hcode as (select doc_id, n, string_agg(line, {_LF} order by i) code from hkind where kind = 'code' group by doc_id, n),
    hseen as (select *, row_number() over (partition by doc_id, block, kind order by i) nth, lead(block) over (partition by doc_id order by i) is distinct from block ends, bool_or(kind = 'ul') over (partition by doc_id, block) uls, bool_or(kind = 'ol') over (partition by doc_id, block) ols from hblock),
    hrows as (select s.doc_id, i, case kind when 'open' then '<pre><code class="lang-' || regexp_extract(line, '{tx.MD_FENCE}', 1) || '">' || coalesce({_escape_sql('code')}, '') || '</code></pre>'
        when 'h' then '<h' || length(regexp_extract(line, '{tx.MD_HEADING}', 1)) || '>' || {_inline_sql(f"regexp_extract(line, '{tx.MD_HEADING}', 2)")} || '</h' || length(regexp_extract(line, '{tx.MD_HEADING}', 1)) || '>'
        when 'ul' then case when nth = 1 then '<ul>' else '' end || '<li>' || {_inline_sql(f"regexp_extract(line, '{tx.MD_BULLET}', 1)")} || '</li>' when 'ol' then case when nth = 1 then '<ol>' else '' end || '<li>' || {_inline_sql(f"regexp_extract(line, '{tx.MD_NUMBER}', 1)")} || '</li>'
        when 'p' then '<p>' || {_inline_sql('line')} || '</p>' else '' end || case when ends and uls then '</ul>' else '' end || case when ends and ols then '</ol>' else '' end html from hseen s left join hcode c on c.doc_id = s.doc_id and c.n = s.n + 1)
    select doc_id, sha1(string_agg(html, '' order by i)) digest from hrows group by doc_id""")
def render_markdown(spark: S, d: str) -> DataFrame:
    """Documents as Markdown with headings, fences, lists of three marks, and inline code, bold, italic and links."""
    text = F.col("text")
    for a, b in _INLINE:
        text = F.replace(text, F.lit(a), F.lit(b))
    return _markdown(spark, d).select("doc_id", _sha(tx.render_markdown(text)))


def python_sources(spark: S, d: str) -> DataFrame:
    """A small Python source for every document, made from its id, source and length."""
    n = F.col("n_chars").cast("string")
    parts = ['"""Module of ', F.col("source"), '."""\nimport os\nfrom math import sqrt, ceil\n\nLIMIT = ', n, "\n\n\n@register\nclass Box", F.col("doc_id").cast("string"), ':\n    """A box."""\n\n    size: int = ', n, "\n\n    @property\n    def area(self):\n        return sqrt(self.size) + LIMIT\n\n\ndef make(value, *, limit=LIMIT):\n    if value < limit:\n        return dict(value=value, limit=", n, ")\n    return {'value': ceil(value)}\n"]
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    broken = F.when(F.col("doc_id") % 11 == 0, F.concat(text, F.lit("def broken(:\n"))).otherwise(text)
    return table(spark, d, "documents").select(F.concat(F.lit("src/"), "source", F.lit("/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), broken.alias("text"))


_PATH = "'src/' || source || '/m' || doc_id || '.py'"
_SYMBOLS = {
    "module": "':1 | module overview]' || LF || 'Module of ' || source || '.'",
    "constant": "':5-5 | constant LIMIT]' || LF || 'LIMIT = ' || n_chars",
    "class": f"':8-16 | class Box' || doc_id || ']' || LF || '@register' || LF || 'A box.' || LF || '{code.FIELDS_MARK}' || LF || '    size: int = ' || n_chars || LF || '{code.METHODS_MARK}' || LF || '    def area(self):'",
    "method": "':14-16 | method Box' || doc_id || '.area]' || LF || '@property' || LF || 'def area(self):' || LF || '        return sqrt(self.size) + LIMIT'",
    "function": "':19-22 | function make]' || LF || 'def make(value, *, limit=LIMIT):' || LF || '    if value < limit:' || LF || '        return dict(value=value, limit=' || n_chars || ')' || LF || '    return {''value'': ceil(value)}'",
}
_SOURCE = '''\'"""Module of ' || source || '."""' || LF || 'import os' || LF || 'from math import sqrt, ceil' || LF || LF || 'LIMIT = ' || n_chars || LF || LF || LF || '@register' || LF || 'class Box' || doc_id || ':' || LF || '    """A box."""' || LF || LF || '    size: int = ' || n_chars || LF || LF || '    @property' || LF || '    def area(self):' || LF || '        return sqrt(self.size) + LIMIT' || LF || LF || LF ||
    'def make(value, *, limit=LIMIT):' || LF || '    if value < limit:' || LF || '        return dict(value=value, limit=' || n_chars || ')' || LF || '    return {''value'': ceil(value)}' || LF || 'def broken(:' || LF'''
_TEXTS = "case k.kind " + " ".join(f"when '{k}' then {t}" for k, t in _SYMBOLS.items()) + " end"


@query(f"""select {_PATH} as path, k.ord::int ord, k.kind, replace(k.qualname, 'Box', 'Box' || doc_id) qualname, k.a::int start_line, k.b::int end_line, k.ord = 0 is_overview, sha1('[source ' || {_PATH} || {_TEXTS}) digest from documents,
    (values (0, 'module', '', 1, 1), (1, 'constant', 'LIMIT', 5, 5), (2, 'class', 'Box', 8, 16), (3, 'method', 'Box.area', 14, 16), (4, 'function', 'make', 19, 22)) k(ord, kind, qualname, a, b) where doc_id % 11 <> 0
    union all select {_PATH}, 0, 'whole-file', '', 1, 23, false, sha1('[source ' || {_PATH} || ':1 | whole-file (parse failed)]' || LF || {_SOURCE}) from documents where doc_id % 11 = 0""".replace("LF ", f"{_LF} ").replace("LF)", f"{_LF})"))
def chunk_python(spark: S, d: str) -> DataFrame:
    return code.python_chunks(python_sources(spark, d)).withColumn("digest", _sha(F.col("text"))).drop("text")


@query("select 'src/' || source || '/m' || doc_id || '.py' as path, 'method' kind, 'Box' || doc_id || '.area' qualname, 14 start_line from documents where doc_id % 11 <> 0")
def find_symbol(spark: S, d: str) -> DataFrame:
    return code.find_symbol(code.python_chunks(python_sources(spark, d)), "area").drop("text")


FACTS = [
    {"desc": "imports sqrt and ceil", "checks": [{"kind": "import", "module": "math", "names": ["sqrt", "ceil"]}, {"kind": "imports", "names": ["os"]}]},
    {"desc": "calls ceil, not floor", "checks": [{"kind": "call", "name": "ceil"}, {"kind": "name", "name": "floor", "not": True}]},
    {"desc": "limit is a keyword", "checks": [{"kind": "kwarg", "name": "limit"}, {"kind": "pair", "key": "value"}]},
    {"desc": "registered box with a size", "checks": [{"kind": "func", "name": "make", "args": ["value", "limit"]}, {"kind": "field", "class": "Box", "names": ["size"]}]},
    {"desc": "compares value with limit", "checks": [{"kind": "compare", "left": "value", "right": "limit"}, {"kind": "pow2_buggy", "not": True}]},
    {"desc": "assigns LIMIT", "checks": [{"kind": "assign", "target": "LIMIT"}]},
    {"desc": "limit is 416", "checks": [{"kind": "kwarg", "name": "limit", "value": 416}]},
]


@query("""select 'src/' || source || '/m' || doc_id || '.py' task_id, doc_id % 11 <> 0 parses, f.fact, doc_id % 11 <> 0 and coalesce(f.ok, n_chars = 416) as ok from documents, (values ('imports sqrt and ceil', true), ('calls ceil, not floor', true),
    ('limit is a keyword', true), ('registered box with a size', false), ('compares value with limit', true), ('assigns LIMIT', true), ('limit is 416', null)) f(fact, ok)""")
def code_facts(spark: S, d: str) -> DataFrame:
    """Facts about every generated source; the classes are named Box and a number, so the fourth never holds."""
    return code.fact_table(python_sources(spark, d), FACTS, "path", "text")
