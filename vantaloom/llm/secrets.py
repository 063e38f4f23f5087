"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every version of a text is addressed by its SHA-256. A ledger row says that a rule,
in one version, has scanned one blob, and holds the spans it found; a scan takes only
the pairs of blob and rule version that the ledger lacks, each blob once however
many paths or versions hold it, and joins findings back to all of them. A ledger row is
kept for clean blobs as well, and seen pairs are left out by their hashes, before any text moves. Only texts
with a rule's hint in them move, and are combined before the shuffle, so a text with many copies moves once a task;
the join back is an equi-join on the blob, which Spark splits where a blob is frequent.

A rule's matches are leftmost and do not overlap; spans count code points, the end
is exclusive. ``split`` by the pattern gives the gaps between the matches that
``regexp_extract_all`` gives, so running lengths give the places, without Python.

Cases: a null text is the empty blob, without findings. Texts of any length are
scanned whole, in time linear in their length and their number of matches. A ledger may hold rows twice. Rows that repeat get the same findings. Spans of different rules may
overlap and all stay. An empty table gives an empty result. Columns named ``blob`` or
``spans`` are never read as ours: ``with_findings`` leaves them out unless they are asked
for, and ``redact`` keeps every column as it was.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantaloom.sources.runtime import small_side, stage

SPANS = "array<struct<start:int,end:int,rule:int>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 40),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 15),
)
RULES = BASE + MORE
# What a text must contain for a pattern to match, by pattern: a rule whose pattern is not here, as a new version's may be, is tried as it is.
HINTS = {
    BASE[0].pattern: r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    BASE[1].pattern: r"AKIA",
    MORE[0].pattern: r"PRIVATE KEY-----",
    MORE[1].pattern: r"eyJ",
    MORE[2].pattern: r"gh[pousr]_",
    MORE[3].pattern: r"xox[abprs]-",
}
CHUNK = 32  # matches whose spans are made by one fold
_PIECES = "array<struct<gap:int,size:int,kept:int>>"


def _pattern(rule: Rule) -> str:
    """The pattern that is run: of runs of hexadecimal digits only those long enough, as shorter ones are dropped."""
    return f"[0-9a-f]{{{rule.least},}}" if rule.pattern == BASE[2].pattern else rule.pattern


def _hint(rule: Rule) -> str:
    return HINTS.get(rule.pattern, _pattern(rule))


def _pieces(text: Column, rule: Rule) -> Column:
    """The gap before each match, its length, and that of its group; a last gap has no match."""
    pattern = F.lit(_pattern(rule))
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    found = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), sizes.alias("size"), kept.alias("kept"))
    return F.when(text.rlike(_hint(rule)), found).otherwise(F.array().cast(_PIECES))


def _spans(pieces: str, rule: Rule, number: int) -> Column:
    """Spans of one rule, in order of their start.

    A fold that appends copies what it has at every step, so pieces are folded in chunks, each from where it starts.
    ``pieces`` is a column's name: as an expression it would be made anew for every chunk.
    """
    column = F.col(pieces)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(column) - 1) / CHUNK).cast("int")), lambda c: F.slice(column, c * CHUNK + 1, F.lit(CHUNK)))
    length = lambda p: p["gap"] + F.coalesce(p["size"], F.lit(0))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + length(p)))
    none = F.array().cast("array<int>")
    starts = F.aggregate(totals, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, t: F.struct((acc["at"] + t).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        span = F.struct(start.alias("start"), (start + p["size"]).alias("end"), F.lit(number).alias("rule"))
        return F.struct((acc["at"] + length(p)).alias("at"), F.when(p["kept"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    fold = lambda c, at: F.aggregate(c, F.struct(at.alias("at"), F.array().cast(SPANS).alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(column) > 0, F.flatten(F.zip_with(chunks, starts, fold))).otherwise(F.array().cast(SPANS))


def scan(versions: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows for the pairs of blob and rule version that ``ledger`` lacks.

    Columns: blob, rule_version, spans. Append them to the ledger. A text that none of the rules' hints is
    in is recorded as clean by its hash, and does not move.
    """
    text = F.coalesce(versions[text_col], F.lit(""))
    likely = reduce(or_, [text.rlike(_hint(r)) for r in rules], F.lit(False))
    addressed = versions.select(F.sha2(text, 256).alias("blob"), F.when(likely, text).otherwise(F.lit("")).alias("text"))
    if ledger is None:
        blobs = addressed.dropDuplicates(["blob"]).withColumn("seen", F.array().cast("array<string>"))
    else:
        # What is left to scan is found from hashes alone; where it is little, no other text is moved.
        keys = F.array(*[F.lit(r.key) for r in rules])
        seen = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        left = addressed.select("blob").distinct().join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>"))).where(F.size(F.array_except(keys, "seen")) > 0)
        left = stage(left, "secrets-left")
        few = small_side(left)
        blobs = addressed.join(few, "blob").dropDuplicates(["blob"]) if few is not left else addressed.dropDuplicates(["blob"]).join(left, "blob")
    unseen = [~F.array_contains("seen", r.key) for r in rules]
    pieces = blobs.select("blob", "seen", *[F.when(new, _pieces(F.col("text"), r)).alias(f"p{n}") for n, (r, new) in enumerate(zip(rules, unseen, strict=True))])
    rows = [F.struct(F.lit(r.key).alias("rule_version"), F.when(new, _spans(f"p{n}", r, n)).alias("spans")) for n, (r, new) in enumerate(zip(rules, unseen, strict=True))]
    return pieces.select("blob", F.explode(F.array(*rows)).alias("row")).select("blob", "row.*").where("spans is not null")


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Blobs with at least one span: all spans of the rules' present versions, by start, then rule."""
    places = F.array(*[F.lit(r.key) for r in rules])
    # A ledger may come from a scan with other rules or another order of them: a rule's number is its place now.
    own = ledger.withColumn("__rule", (F.array_position(places, F.col("rule_version")) - 1).cast("int")).where((F.size("spans") > 0) & (F.col("__rule") >= 0))
    own = own.withColumn("spans", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("__rule").alias("rule"), s["end"].alias("end"))))
    found = own.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("__all"))
    # A ledger that was appended twice, by a job that was tried again, holds spans twice: side by side, once sorted.
    before = F.concat(F.array(F.lit(None).cast("struct<start:int,rule:int,end:int>")), "__all")
    once = F.zip_with("__all", before, lambda s, b: F.when(s.isNotNull() & ~s.eqNullSafe(b), F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rule"].alias("rule"))))
    return found.select("blob", F.filter(once, lambda s: s.isNotNull()).alias("spans"))


def with_findings(versions: DataFrame, found: DataFrame, text_col: str = "text", *keep: str) -> DataFrame:
    """Every version with its blob's spans (an empty array where there are none)."""
    columns = keep or [c for c in versions.columns if c not in ("blob", "spans")]
    own = versions.select(*columns, F.sha2(F.coalesce(versions[text_col], F.lit("")), 256).alias("blob"))
    return own.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    count = lambda n: F.size(F.filter("spans", lambda s: s["rule"] == n)).cast("long")
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    return found.select(F.col(id_col), *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE)], F.sha2(written(base, rules), 256).alias("base_sha256"), written(F.col("spans"), rules).alias("spans"))


def scan_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Digest of every document, and the new ledger rows (staged)."""
    fresh = stage(scan(docs, text_col, rules, ledger), "secrets")
    whole = fresh if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(fresh)
    # Staged, the findings come to the join without a partitioning of their own, and Spark can split a frequent blob.
    found = stage(findings(whole, rules), "findings")
    return digest(with_findings(docs, found, text_col, id_col), id_col, rules), fresh


def redact(docs: DataFrame, found: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping spans become one."""
    # All columns travel under names of ours, so that none of theirs can be one of those.
    own = docs.select(*[docs[f"`{c}`"].alias(f"__c{n}") for n, c in enumerate(docs.columns)], F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("__blob"))
    own = own.join(found.select(F.col("blob").alias("__found"), F.col("spans").alias("__spans")), F.col("__blob") == F.col("__found"), "left")
    place = [c.lower() for c in docs.columns].index(text_col.lower())
    clean = F.when(F.col("__spans").isNotNull(), _masked(F.col(f"__c{place}"), "__spans", mark)).otherwise(F.col(f"__c{place}"))
    return own.select(*[(clean if n == place else F.col(f"__c{n}")).alias(c) for n, c in enumerate(docs.columns)])


def _masked(text: Column, spans: str, mark: str) -> Column:
    """A text with its sorted spans replaced.

    As in ``_spans``, a fold would copy the whole text for every span; so spans go in chunks, each with the
    window of the text from the furthest end before it to its own, and the windows are joined.
    """
    column = F.col(spans)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(column) - 1) / CHUNK).cast("int")), lambda c: F.slice(column, c * CHUNK + 1, F.lit(CHUNK)))
    furthest = lambda c: F.array_max(F.transform(c, lambda s: s["end"]))
    none = F.array().cast("array<struct<start:int,end:int>>")
    windows = F.aggregate(
        F.transform(chunks, furthest),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, end: F.struct(F.greatest(acc["at"], end).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), F.greatest(acc["at"], end).alias("end")))).alias("out")),
        lambda acc: acc["out"],
    )
    cut = F.transform(windows, lambda w: F.struct(w["start"].alias("start"), text.substr(w["start"] + 1, w["end"] - w["start"]).alias("text")))

    def masked(chunk: Column, window: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            gap = F.concat(window["text"].substr(acc["at"] - window["start"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit(mark))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(chunk, F.struct(window["start"].alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    return F.concat(F.array_join(F.zip_with(chunks, cut, masked), ""), text.substr(furthest(column) + 1, F.length(text)))
