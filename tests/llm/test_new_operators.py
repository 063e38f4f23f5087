"""Quality rules, token alignment and hard negatives against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vantaloom.llm import alignment, hard_negatives, quality, queries

# --- 11

SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACES:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def measured(text):
    w = words_of(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines)


TEXTS = [None, "", " \t\n", "one", "a b", "a b c", "a b c a b c", "x x x x x", "a\nb\na\nb \n\n\na", "ü 日本 🎉 # * $\x0b%&|<> \x85\xa0 z", "p q r " * 30, "l\r\nl\r\nl\n", "the end " * 3000 + "tail"]


def test_measures(spark):
    rng = random.Random(5)
    texts = TEXTS + [rng.choice(["", " "]).join(rng.choice(["a", "b", "c", " ", "\n", "d#"]) for _ in range(rng.randrange(200))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, texts[3], "x", "y")], "doc_id long, text string, N_WORDS string, kept string")
    got = quality.measure(docs).collect()
    assert sorted((r["doc_id"], *(r[c] for c in quality.MEASURES), r["base_failed"], r["kept"]) for r in got) == sorted(
        (i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0], "y") for i, m in [(i, measured(t)) for i, t in enumerate(texts)] + [(3, measured(texts[3]))]
    )
    assert quality.measure(docs.where("false")).count() == 0


def test_binomial_tail(spark):
    cases = [(k, n) for n in (1, 10, 500, 3000) for k in (0, 1, 2, 7, 29) if k <= n]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality.log_tail(F.col("k"), F.col("n"), 0.01).alias("log_p")).collect()
    for k, n, log_p in got:
        exact = sum(math.comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))
        assert log_p == 0.0 if k >= n * 0.01 else math.isclose(log_p, math.log(exact), rel_tol=1e-9)


def certified_by_hand(docs, labels, alpha, delta):
    """Plain loops: {stratum: {rule: cutoff}}."""
    label = {}
    for i, q in labels:
        if i is not None and q is not None:
            label[i] = min(q, label.get(i, q))
    cases = {}
    for i, text, lang in docs:
        m = measured(text)
        if i in label and m[0] >= 50 and 100 * m[4] <= 50 * m[0]:
            key = lang or "", hashlib.md5((text or "").encode()).hexdigest()
            cases[key] = min(label[i], cases.get(key, (1,))[0]), dict(zip(quality.MEASURES, m, strict=True))
    scores = lambda m: [1000 * m["n_symbols"] // m["n_words"], 1000 * m["n_dup_lines"] // m["n_lines"], 1000 * m["n_repeat_words"] // m["n_words"], 100 * m["word_chars"] // m["n_words"], -(100 * m["word_chars"] // m["n_words"])]
    orders = defaultdict(list)
    for stratum in {s for s, _ in cases}:
        own = [(h >= "8", q == 1, scores(m)) for (s, h), (q, m) in cases.items() if s == stratum]
        for n, rule in enumerate(quality.RULES):
            for cutoff in rule.cutoffs:
                count = lambda holdout, good, over, n=n, c=cutoff: sum(x[0] == holdout and x[1] == good and (not over or x[2][n] > c) for x in own)
                if count(False, False, True) * count(False, True, False) > quality.LIFT * count(False, True, True) * count(False, False, False):
                    k, size, p = count(True, True, True), count(True, True, False), alpha / len(quality.RULES)
                    orders[stratum, n].append((cutoff, sum(math.comb(size, i) * p**i * (1 - p) ** (size - i) for i in range(k + 1)) if k < size * p else 1.0))
    out = defaultdict(dict)
    for (stratum, n), tests in orders.items():
        for cutoff, p in tests:
            if p > delta / len(orders):
                break
            out[stratum][n] = cutoff
    return out


def test_cutoffs_are_certified_per_stratum(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    docs, labels = [], []
    for i in range(1600):
        bad = rng.random() < 0.25
        words = [word() + ("###" if bad and rng.random() < 0.8 else "*" if rng.random() < 0.001 else "") for _ in range(60)]
        lang = rng.choice(["en", "en", "de", None])
        text = " ".join(words) if i % 50 else docs[0][1] if docs else " ".join(words)
        docs.append((i, text, lang))
        labels.append((i, 0 if bad else 1))
    labels += [(None, 1), (3, None), (5, 0), (999_999, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    m = quality.measure(d)
    table = quality.certify(m, lab, alpha=0.2)
    want = certified_by_hand(docs, labels, 0.2, quality.DELTA)
    got = defaultdict(dict)
    for r in table.where("certified").groupBy("stratum", "rule").agg(F.min("cutoff").alias("c")).collect():
        got[r["stratum"]][r["rule"]] = r["c"]
    assert got == want and want["en"][0] == 50 and set(want) <= {"en", "de", ""}
    kept = {r["doc_id"] for r in quality.keep_good(d.withColumn("__row", F.lit(1)).withColumn("KEPT", F.lit(2)), table).collect()}
    judged = {r["doc_id"]: r for r in quality.judge(m, table).collect()}
    assert kept == {i for i, r in judged.items() if r["kept"]} and any(r["failed_rules"] == "symbols" for r in judged.values())
    lost = [i for i, q in labels[:1600] if q == 1 and i != 5 and not judged[i]["kept"]]
    assert len(lost) < 0.2 * 1600
    # Without labels, the base rules alone decide.
    assert quality.judge(m, quality.certify(m, lab.where("false"))).where("kept = base_failed").count() == 0


# --- 12


def aligned(texts):
    """Plain loops over every document."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    table = alignment.SideA(a_path).table
    out, counts = [], Counter()
    for text in texts:
        if not text:
            out.append(None)
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        sa = [table[i] for i in ia]
        sb = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(sa) != b" " + text.encode() or b"".join(sb) != b" " + text.encode():
            out.append(None)
            continue
        ends = lambda parts: np.cumsum([len(x) for x in parts]).tolist()
        cuts = sorted(set(ends(sa)) & set(ends(sb)))
        groups = [([], []) for _ in cuts]
        for side, (ids, at) in enumerate(((ia, ends(sa)), (ib, ends(sb)))):
            for i, e in zip(ids, at, strict=True):
                groups[next(n for n, c in enumerate(cuts) if c >= e)][side].append(i)
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        counts.update(set(links))
        out.append((len(ia), len(ib), groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    rows = []
    for o in out:
        if o is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            line = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in o[2])
            rows.append((o[0], o[1], len(o[2]), len(o[3]), sum(counts[p] == best[p[0]] for p in o[3]), sum(counts[p] for p in o[3]), hashlib.sha256(line.encode()).hexdigest()))
    return rows


HARD = [None, "", " ", "plain words here", "▁ is not a space", "<|endoftext|> <s> </s> <unk>", "日本語 🎉‍👩 é é", "  two   spaces \n\t\r\n", "=" * 700, "ababab" * 300, "\x00 nul", "plain words here", "x" * 4000, "naïve “quotes” — 0123456789 3.14"]


@pytest.mark.parametrize(("size", "hot"), [(1 << 15, 1 << 20), (16, 40), (7, 0)])
def test_alignment(spark, monkeypatch, size, hot):
    monkeypatch.setattr(alignment, "SLICE", size)
    monkeypatch.setattr(alignment, "HELD", 50)
    rng = random.Random(1)
    texts = HARD + [" ".join(rng.choice(["tokenization", "the", "naïve", "0x3f", "ß", "\n", "ing"]) for _ in range(rng.randrange(40))) for _ in range(20)]
    ids = [None if i == 3 else i for i in range(len(texts))]
    rows = [(i, t, "x", "y") for i, t in zip(ids, texts, strict=True)] + [(4, texts[4], "x", "y"), (7, texts[7], "x", "y"), (7, texts[8], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slice string, PAIRS string")
    got = alignment.align(docs, queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model"), hot=hot)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(r[0], *w) for r, w in zip(rows, aligned([r[1] for r in rows]), strict=True)]
    assert sorted(((r["doc_id"], *(r[c] for c in names)) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert alignment.align(docs.where("false"), queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")).count() == 0


def test_groups_of_many_tokens():
    digits = alignment._digits(5000), alignment._digits(5000)
    flow = alignment.Sweep(5000, digits)
    # 150 tokens of 3 bytes against 90 of 5 bytes would meet at every 15th byte; shifted ends meet only at the last one.
    a, b = np.arange(150) % 7, np.arange(100) % 3
    sizes_a, sizes_b = np.full(150, 4), np.array([1, *[6] * 98, 11])
    flow.take([(a, sizes_a), (b, sizes_b)])
    pairs, times = flow.distinct()
    ends = np.cumsum(sizes_a), np.cumsum(sizes_b)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    want = Counter(int(x) * 5000 + int(y) for x, ex in zip(a, ends[0], strict=True) for y, ey in zip(b, ends[1], strict=True) if np.searchsorted(cuts, ex) == np.searchsorted(cuts, ey))
    assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == dict(want) and flow.links == sum(want.values()) and flow.groups == len(cuts) == 1


# --- 13


def mined(rows, n_pos=5, n_neg=5):
    whole = [(i, lab, [float(math.floor(256 * x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, lab, list(v)) for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in whole}]
    out = set()
    for i, lab, v in whole:
        if i % 10:
            continue
        scored = sorted((-int(np.dot(v, w)), j, other) for j, other, w in whole if j != i and len(w) == len(v))
        for ps, p in [(-s, j) for s, j, other in scored if other == lab][:n_pos]:
            for rank, (ns, n) in enumerate([(-s, j) for s, j, other in scored if other != lab and 80 * ps <= 100 * -s <= 100 * ps][:n_neg], 1):
                out.add((i, p, rank, n, ps, ns))
    return sorted(out)


@pytest.mark.parametrize(("block", "shift"), [(1024, 0.0), (16, 0.0), (8, 0.4), (16, -0.5)])
def test_hard_negatives(spark, block, shift):
    rng = np.random.default_rng(int(block + 10 * shift))
    centres = rng.normal(size=(4, 6))
    rows = [(i, int(i % 5), [float(x) for x in (centres[i % 4] + 0.3 * rng.normal(size=6) + shift)]) for i in range(400)]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(30)] + [(2000, 1, None), (None, 1, rows[1][2]), (2010, None, rows[1][2]), (2020, 2, [None] + rows[1][2][1:]), (2030, 2, [float("nan")] + rows[1][2][1:]), (2040, 2, [float("inf")] * 6)]
    rows += [(2050, 1, []), (2051, 1, []), (2052, 2, []), (2060, 3, [1.0, 2.0]), (2061, 3, [1.0, 1.0]), (2062, 1, [1.0, 1.0]), (2070, 1, [0.0] * 6), rows[10], rows[11], (20, 3, rows[21][2]), (3000, 4, [1e30] * 3)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, label int, embedding array<double>, v string, SCORE double")
    got = hard_negatives.mine(hard_negatives.prepare(df), F.col("id") % 10 == 0, block=block, anchor_block=block // 4)
    assert sorted(map(tuple, got.collect())) == mined(rows)
    assert hard_negatives.mine(hard_negatives.prepare(df.where("false")), F.col("id") % 10 == 0).count() == 0


def test_pivots_rule_out_blocks(spark):
    """On clusters far apart, most pairs of blocks are dropped before their vectors are multiplied."""
    rng = np.random.default_rng(2)
    centres = 20 * rng.normal(size=(16, 8))
    rows = [(i, int(i % 3), [float(x) for x in centres[i % 16] + 0.1 * rng.normal(size=8)]) for i in range(1600)]
    df = hard_negatives.prepare(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    model = hard_negatives.fit(df)
    pivoted = hard_negatives._pivoted(df, model, False).cache()
    anchors = hard_negatives._pivoted(df.where("id % 100 = 0"), model, True).withColumns({"hash": F.xxhash64("v"), "number": F.col("id")})
    floors = hard_negatives._seed_bounds(anchors, pivoted, 5)
    asked = hard_negatives._asked(anchors.join(floors, ["id", "label", "hash"]).withColumn("low", F.col("floor")).withColumn("high", F.lit(float("inf"))), model, 1)
    packed = hard_negatives.blocks(pivoted, 25)
    met = hard_negatives._meet(asked, packed, 4, F.lit(True)).count()
    assert 0 < met < 0.5 * asked.count() * packed.count()
    assert sorted(map(tuple, hard_negatives.mine(df, F.col("id") % 10 == 0, block=25, anchor_block=4).collect())) == mined(rows)


def test_the_driver_gets_a_thin_sample_and_no_blocks(spark):
    """A sorted limit sends its rows from every task, and a broadcast its whole side, through the driver."""
    rows = hard_negatives.prepare(spark.range(6000).selectExpr("id vec_id", "id % 3 label", "array(id / 7D, id % 11D) embedding"))
    order = F.xxhash64("id", "v")
    near = hard_negatives._least_hashes(rows, 50)
    assert 50 <= near.count() < 600
    assert near.orderBy(order).limit(50).collect() == rows.orderBy(order).limit(50).collect()
    assert hard_negatives._least_hashes(rows.where("id < 9"), 50).count() == 9
    box = spark.createDataFrame([(2, [0.0], [1.0], 1.0, b"1", b"1")], "dim int, lo array<double>, hi array<double>, reach double, ids binary, labels binary")
    met = hard_negatives._meet(box, box, 2, F.lit(True))
    assert met.count() == 1 and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
