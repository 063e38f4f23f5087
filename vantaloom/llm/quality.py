"""Quality rules whose cutoffs are certified on labelled holdouts, in DataFrame functions alone.

``measure`` counts a text's words, symbols, repeated lines and repeated word windows. A
rule turns them into an integer score and has an order of cutoffs, from lenient to
strict; it rejects scores over its cutoff. ``certify`` chooses the cutoffs for each
stratum (a language, say) from labelled documents: distinct texts are dealt by their
hash to a design half and a holdout half. The design half leaves out cutoffs unless
they reject ``LIFT`` times the share of bad documents that they reject of good ones. Those left are tested on the
holdout half, each against the hypothesis that it rejects more than its allowed share
of good documents, with the exact binomial tail; a rule's cutoffs are tested in their
fixed order up to the first that fails, and the level is divided by the number of such
orders in all strata. So with probability 1 - ``delta`` no stratum loses more than
``alpha`` of its good documents (of those that pass the base rules) to all its rules
together: each rule has an equal part of ``alpha``. A stratum with too few labels gets no
cutoff, and keeps what the base rules keep.

Cases: a null text counts as empty, has zeros throughout, fails the base rules and is not kept. Texts are
measured whole; what is held at once are the words and window hashes of one text. Windows
are told apart by 64-bit hashes. A null stratum is the stratum ''. Labels without an
id or a value are left out; a text labelled both ways counts as bad, and copies of
a text count once, as a binomial needs independent draws. Rows that repeat get
the same results. An empty table, or one without labels, gives an empty result, or one
with base rules alone. Columns named as ours, in any case, are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantaloom.sources.runtime import small_side

SPACES = " \t\n\x0b\x0c\r"
GAP, WORD_CHAR, SYMBOLS = "[ \\t-\\r]+", "[^ \\t-\\r]", "[#*$%&|<>]+"
WINDOW, LEAST_WORDS, MOST_REPEATED = 3, 50, 50  # fixed values: words a window, words a text, per cent of repeated words
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
ALPHA, DELTA = 0.05, 0.05
LIFT = 3  # a cutoff must reject so many times the share of bad documents that it rejects of good ones


@dataclass(frozen=True)
class Rule:
    """An integer ``score`` (SQL over the measures) and cutoffs from lenient to strict, falling; scores over a cutoff are rejected."""

    name: str
    score: str
    cutoffs: tuple[int, ...]


RULES = (
    Rule("symbols", "1000 * n_symbols div greatest(n_words, 1)", (1000, 700, 500, 350, 250, 150, 100, 50)),
    Rule("dup_lines", "1000 * n_dup_lines div greatest(n_lines, 1)", (700, 500, 300, 200, 100)),
    Rule("repeats", "1000 * n_repeat_words div greatest(n_words, 1)", (450, 400, 300, 200, 100)),
    Rule("long_words", "100 * word_chars div greatest(n_words, 1)", (2000, 1500, 1200, 1000)),
    Rule("short_words", "-(100 * word_chars div greatest(n_words, 1))", (-200, -250, -300)),
)


def _covered(starts: Column) -> Column:
    """How many words windows at these starts, in order, cover together."""
    steps = F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda p, q: F.coalesce(F.least(q - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0), lambda n, step: n + step)


def measure(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default), the measures as longs, ``text_key`` (MD5 of the text) and ``base_failed``."""
    ours = {*MEASURES, "text_key", "base_failed"}
    kept = [f"`{c}`" for c in (docs.columns if keep is None else keep) if c.lower() not in ours]
    text = F.coalesce(docs[text_col], F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    # Each step refers to the one before more than once, so that Catalyst keeps them apart and a text is split once.
    words = docs.select(*kept, text.alias("__text"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP, -1)).alias("__words"))
    lines = F.filter(F.split("__text", "\n", -1), lambda line: line.rlike(WORD_CHAR))
    counted = words.select(
        *kept,
        F.md5(F.col("__text").cast("binary")).alias("text_key"),
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__hashes"),
    )
    h, n = F.col("__hashes"), F.size("__hashes")
    both = lambda a, b: F.xxhash64(a, b)
    pairs = F.zip_with(h, F.slice(h, 2, n), both)
    own = [*kept, "text_key", "n_words", "word_chars", "n_symbols"]
    # Past the last whole window the shifted arrays have ended.
    windows = F.slice(F.zip_with(pairs, F.slice(h, WINDOW, n), both), 1, F.greatest(n - WINDOW + 1, F.lit(0)))
    counted = counted.select(*own, "__lines", windows.alias("__windows"))
    # Only a text with a window twice has its windows sorted.
    sorts = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    nothing = F.array().cast("array<struct<h:bigint,at:int>>")
    counted = counted.select(
        *own,
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), sorts).otherwise(nothing).alias("__sorted"),
    )
    own += ["n_dup_lines", "n_lines"]
    s = F.col("__sorted")
    after = F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.struct(a.alias("a"), a["h"].eqNullSafe(b["h"]).alias("same")))
    twice = F.zip_with(after, F.concat(F.array(F.lit(None).cast("struct<h:bigint,at:int>")), s), lambda x, p: F.when(x["same"] | x["a"]["h"].eqNullSafe(p["h"]), x["a"]["at"]))
    counted = counted.select(*own, F.sort_array(F.filter(twice, lambda at: at.isNotNull())).alias("__starts"))
    counted = counted.select(*own, _covered(F.col("__starts")).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.select(*kept, "text_key", *MEASURES, failed.alias("base_failed"))


def log_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) of a binomial X of n draws with probability p; 0 where k is no less than expected, which certifies nothing."""

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + log(p / (1 - p))
        return F.struct(term.alias("term"), (F.greatest(acc["total"], term) + F.log1p(F.exp(-F.abs(acc["total"] - term)))).alias("total"))

    first = n.cast("double") * log(1 - p)
    summed = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), F.struct(first.alias("term"), first.alias("total")), step, lambda acc: acc["total"])
    return F.when(k >= n * p, 0.0).when(k == 0, first).otherwise(summed)


def certify(measured: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", label: str = "quality", rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """A row for each stratum, rule and useful cutoff: its holdout counts, ``log_p`` and whether it is certified.

    ``measured`` is what ``measure`` gives, with the id and the stratum kept. Columns: stratum, rule (its number), place, cutoff,
    n_good and n_rejected (good documents of the holdout, and those rejected), log_p, certified.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).alias("__label"))
    scores = F.array(*[F.struct(F.expr(r.score).cast("long").alias("score"), F.array(*[F.lit(c).cast("long") for c in r.cutoffs]).alias("cutoffs")) for r in rules])
    cases = measured.where(~F.col("base_failed")).join(known, id_col).withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    # Equal texts have equal scores; any of them will do.
    cases = cases.groupBy("stratum", "text_key").agg(F.min("__label").alias("label"), F.max(scores).alias("scores"))
    holdout, good = F.substring("text_key", 1, 1) >= "8", F.col("label") == 1
    long = cases.select("stratum", holdout.alias("holdout"), good.alias("good"), F.posexplode("scores").alias("rule", "s")).select("stratum", "holdout", "good", "rule", "s.score", F.posexplode("s.cutoffs").alias("place", "cutoff"))
    over = F.col("score") > F.col("cutoff")
    counts = long.groupBy("stratum", "rule", "place", "cutoff").agg(
        F.count_if(F.col("holdout") & F.col("good")).alias("n_good"),
        F.count_if(F.col("holdout") & F.col("good") & over).alias("n_rejected"),
        F.count_if(~F.col("holdout") & F.col("good")).alias("d_good"),
        F.count_if(~F.col("holdout") & F.col("good") & over).alias("d_good_over"),
        F.count_if(~F.col("holdout") & ~F.col("good")).alias("d_bad"),
        F.count_if(~F.col("holdout") & ~F.col("good") & over).alias("d_bad_over"),
    )
    useful = counts.where(F.col("d_bad_over") * F.col("d_good") > LIFT * F.col("d_good_over") * F.col("d_bad"))
    orders = useful.select("stratum", "rule").distinct().agg(F.count("*").alias("orders"))
    tested = useful.withColumn("log_p", log_tail(F.col("n_rejected"), F.col("n_good"), alpha / len(rules))).crossJoin(F.broadcast(orders))  # one row
    so_far = Window.partitionBy("stratum", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    passed = F.max("log_p").over(so_far) <= log(delta) - F.log("orders")
    return tested.select("stratum", "rule", "place", "cutoff", "n_good", "n_rejected", "log_p", passed.alias("certified"))


def judge(measured: DataFrame, certified: DataFrame, stratum: str = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measured`` with ``failed_rules`` (names, joined by commas) and ``kept``."""
    strictest = certified.where("certified").groupBy(F.col("stratum").alias("__stratum"), "rule").agg(F.min("cutoff").alias("cutoff"))
    chosen = strictest.groupBy("__stratum").agg(F.array_sort(F.collect_list(F.struct("rule", "cutoff"))).alias("__cutoffs"))
    scores = F.array(*[F.expr(r.score).cast("long") for r in rules])
    names = F.array(*[F.lit(r.name) for r in rules])
    mine = [c for c in measured.columns if c.lower() not in ("failed_rules", "kept")]
    joined = measured.join(small_side(chosen), F.coalesce(F.col(stratum).cast("string"), F.lit("")) == F.col("__stratum"), "left").withColumn("__scores", scores)
    over = F.filter(F.coalesce("__cutoffs", F.array().cast("array<struct<rule:int,cutoff:bigint>>")), lambda c: F.get("__scores", c["rule"]) > c["cutoff"])
    failed = F.array_join(F.transform(over, lambda c: F.get(names, c["rule"])), ",")
    return joined.select(*[f"`{c}`" for c in mine], failed.alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def keep_good(docs: DataFrame, certified: DataFrame, text_col: str = "text", stratum: str = "lang", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that are kept, with their own columns alone."""
    packed = docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__doc"), F.col(stratum).alias("__of"))
    return judge(measure(packed, "__doc", ["__row", "__of"]), certified, "__of", rules).where("kept").select("__row.*")


def oracle(rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> str:
    """DuckDB SQL for the query: measures by unnested windows, the binomial tail by the gamma function."""
    score = lambda r: r.score.replace(" div ", " // ")
    p = alpha / len(rules)
    cases = reduce(lambda a, b: f"{a} union all {b}", [f"select stratum, holdout, good, {n} as rule, {score(r)} as score, unnest({list(r.cutoffs)}) as cutoff from cases" for n, r in enumerate(rules)])
    tail = f"(select ln(sum(exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({p!r}::double) + (n_good - i) * ln(1 - {p!r}::double)))) from unnest(range(0, n_rejected + 1)) t(i))"
    fails = " or ".join(f"coalesce({score(r)} > c{n}, false)" for n, r in enumerate(rules))
    cutoffs = ", ".join(f"min(cutoff) filter (rule = {n}) as c{n}" for n in range(len(rules)))
    return f"""
        with d as (select row_number() over () as rid, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as body from documents),
        w as (select *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') as words,
            list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines from d),
        grams as (select rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as gram from w, unnest(range(1, len(words) - 1)) t(i)),
        twice as (select rid, i from (select rid, i, count(*) over (partition by rid, gram) as n from grams) where n > 1),
        covered as (select rid, count(distinct i + k) as n from twice, (values (0), (1), (2)) s(k) group by rid),
        m as (select rid, doc_id, stratum, md5(body) as text_key, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
            (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
            len(lines)::bigint as n_lines, coalesce(covered.n, 0)::bigint as n_repeat_words from w left join covered using (rid)),
        b as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from m),
        known as (select doc_id, min(quality) as quality from labels where doc_id is not null and quality is not null group by doc_id),
        cases as (select stratum, text_key >= '8' as holdout, min(quality) = 1 as good, {", ".join(f"max({c}) as {c}" for c in MEASURES)}
            from b join known using (doc_id) where not base_failed group by stratum, text_key),
        long as ({cases}),
        counts as (select stratum, rule, cutoff, count(*) filter (holdout and good) as n_good, count(*) filter (holdout and good and score > cutoff) as n_rejected,
            count(*) filter (not holdout and good) as d_good, count(*) filter (not holdout and good and score > cutoff) as d_good_over,
            count(*) filter (not holdout and not good) as d_bad, count(*) filter (not holdout and not good and score > cutoff) as d_bad_over from long group by all),
        useful as (select * from counts where d_bad_over * d_good > {LIFT} * d_good_over * d_bad),
        tested as (select *, case when n_rejected >= n_good * {p!r} then 0.0 else {tail} end as log_p, (select count(*) from (select distinct stratum, rule from useful)) as orders from useful),
        passed as (select stratum, rule, cutoff, max(log_p) over (partition by stratum, rule order by cutoff desc) <= ln({delta!r}::double / orders) as certified from tested),
        chosen as (select stratum, {cutoffs} from passed where certified group by stratum)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({fails}) as kept from b left join chosen using (stratum)"""
