"""Text functions and chunkers on the fixtures whose results are derived by hand."""

import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vantaloom.functions import text as tx
from vantaloom.operators import chunking


def one(spark, expr, **cols):
    """The value of an expression over one row of strings."""
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


def test_tokens(spark):
    assert one(spark, tx.tokens(F.col("t")), t="AdamW 512 解耦 v2") == ["adamw", "512", "v2", "解", "耦"]
    assert one(spark, tx.tokens(F.col("t")), t=None) == []
    assert one(spark, tx.tokens_with_parts(F.col("t")), t="camelCase plain") == ["camelcase", "camel", "case", "plain"]
    assert one(spark, tx.tokens_cased(F.col("t")), t="AdamW b") == ["AdamW", "b"]


@pytest.mark.parametrize(("text", "hit"), [("BarFoo", False), ("_Foo", False), ("Foo_x", False), ("x.Foo(", True), ("Foo", True), ("a Foo.b", True)])
def test_has_symbol(spark, text, hit):
    assert one(spark, tx.has_symbol(F.col("t"), F.col("s")), t=text, s="Foo") is hit


def test_symbol_with_special_characters(spark):
    assert one(spark, tx.has_symbol(F.col("t"), F.col("s")), t="call a+b(, c)", s="a+b(") is True


def test_keys(spark):
    assert one(spark, tx.symbol_key(F.col("t")), t="[source a.py:1-2 | function f] [part 2/3]\nbody") == "[source a.py:1-2 | function f]"
    a, b = ("[source a.py:12-73 | f]\nx[1:2]", "[source a.py:13-74 | f]\nx[1:2]")
    assert one(spark, tx.chunk_key(F.col("t")), t=a) == one(spark, tx.chunk_key(F.col("t")), t=b)
    assert one(spark, tx.chunk_key(F.col("t")), t="a:1-2") == hashlib.sha1(b"a").hexdigest()


def test_strip_takes_all_white_space(spark):
    spaces = "".join(map(chr, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000]))
    assert one(spark, tx.strip(F.col("t")), t=f"{spaces}a b{spaces}") == "a b"


def test_extract_code(spark):
    assert one(spark, tx.extract_code(F.col("t")), t="See\n```python\nx = 1\n```\nand\n```python\ny\n```") == "x = 1"
    assert one(spark, tx.extract_code(F.col("t")), t=" x ") == " x "


def test_edit_first(spark):
    got = one(spark, tx.edit_first(F.col("t"), F.lit("ab"), F.lit("X")), t="1ab2ab3ab")
    assert (got["text"], got["remaining"]) == ("1X2ab3ab", 2)
    assert one(spark, tx.edit_first(F.col("t"), F.lit(""), F.lit("X")), t="a") is None
    assert one(spark, tx.edit_first(F.col("t"), F.lit("z"), F.lit("X")), t="a") is None


def test_markdown_to_html(spark):
    text = "# T `c`\n\n- **a**\n- *b*\n1. n\n```py\n<x>\n```\n[l](u) & p"
    want = '<h1>T <code>c</code></h1><ul><li><strong>a</strong></li><li><em>b</em></li><ol><li>n</li></ul></ol><pre><code class="lang-py">&lt;x&gt;</code></pre><p><a href="u" target="_blank" rel="noopener">l</a> &amp; p</p>'
    assert one(spark, tx.render_markdown(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("", ""),
        (" \u3000\t", ""),
        ("1. a\n- b\n2. c\n\n- d", "<ol><li>a</li><ul><li>b</li><li>c</li></ul></ol><ul><li>d</li></ul>"),
        ("- a\n- b", "<ul><li>a</li><li>b</li></ul>"),
        ("```\n- a", '<pre><code class="lang-">- a</code></pre>'),
        ("```x\n```", '<pre><code class="lang-x"></code></pre>'),
        ("# a\r\n#b", "<p># a\r</p><p>#b</p>"),
        ("#\u00a0a", "<h1>a</h1>"),
    ],
)
def test_markdown_lists_fences_and_line_ends(spark, text, want):
    assert one(spark, tx.render_markdown(F.col("t")), t=text) == want


def test_fixed_chunks(spark):
    got = one(spark, chunking.fixed_chunks(F.col("t")), t="a" * 1000)
    assert [(c["start"], len(c["text"])) for c in got] == [(0, 500), (450, 500), (900, 100)]
    assert one(spark, chunking.fixed_chunks(F.col("t")), t="") == []
    assert one(spark, chunking.fixed_chunks(F.col("t"), 4, 1), t="a      b") == [(0, "a   "), (6, " b")]
    with pytest.raises(ValueError):
        chunking.fixed_chunks(F.col("t"), 5, 5)


def test_sections_keep_fences_whole(spark):
    text = "# A\nx\n```\n# not heading\n```\n## B\ny"
    got = one(spark, chunking.heading_sections(F.col("t")), t=text)
    assert [(s["heading"], len(s["body"])) for s in got] == [("# A", 4), ("## B", 1)]


@pytest.mark.parametrize(("text", "want"), [("## A\n\n## B\nz", ["## A", "## B\nz"]), ("## A\n### B\nz", ["## A", "### B\nz"]), ("plain", ["plain"]), ("", []), ("####### no\nx", ["####### no\nx"])])
def test_markdown_chunks(spark, text, want):
    assert one(spark, chunking.markdown_chunks(F.col("t")), t=text) == want


def test_parent_chunks(spark):
    got = one(spark, chunking.parent_chunks(F.col("t")), t="## A\n### B\nz")
    assert [c["chunk"] for c in got] == ["### B\nz"]
    got = one(spark, chunking.parent_chunks(F.col("t")), t="## A\nintro\n### B\nz\n## C\nq")
    assert [(c["parent"], c["chunk"]) for c in got] == [("## A\nintro\n### B\nz", "## A\nintro"), ("## A\nintro\n### B\nz", "### B\nz"), ("## C\nq", "## C\nq")]


def test_long_lines_are_not_split_and_prefix_repeats(spark):
    got = one(spark, chunking.markdown_chunks(F.col("t"), 20), t="# H\n" + "a" * 30 + "\nbb\ncc\n" + "d" * 14)
    assert got == ["# H\n" + "a" * 30, "# H\nbb\ncc", "# H\n" + "d" * 14]


def test_split_long(spark):
    text = "[source a]\n" + "\n".join(f"x = {i}" for i in range(10))
    got = one(spark, chunking.split_long(F.col("t"), 25), t=text)
    assert got[0].startswith("[source a] [part 1/") and len(got) > 1
    assert [line for p in got for line in p.split("\n")[1:]] == text.split("\n")[1:]
    assert one(spark, chunking.split_long(F.col("t"), 1000), t=text) == [text]
    assert one(spark, chunking.split_long(F.col("t"), 1000), t="") == [""]


def test_inject(spark):
    assert one(spark, chunking.inject(F.col("t"), F.lit("d")), t="head\nbody") == "head\n# d\nbody"
    assert one(spark, chunking.inject(F.col("t"), F.lit("")), t="head\nbody") == "head\nbody"


def greedy(heading, body, most):
    """A plain restatement of how a section is packed."""
    lines = [x.strip() for x in body if x.strip()]
    prefix = heading + "\n" if heading else ""
    out, cur = [], ""
    for line in lines:
        if cur and len(prefix) + len(cur) + len(line) + 1 > most:
            out.append(prefix + cur)
            cur = line
        else:
            cur = f"{cur}\n{line}" if cur else line
    return [x.strip() for x in [*out, *([prefix + cur] if cur else [])]] or ([heading.strip()] if heading.strip() else [])


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(body=st.lists(st.text(alphabet="ab \t", max_size=12), max_size=12), heading=st.sampled_from(["", "# H"]), most=st.integers(5, 40))
def test_section_chunks_like_a_plain_loop(spark, body, heading, most):
    df = spark.createDataFrame([((heading, body),)], "s struct<heading:string,body:array<string>>")
    assert df.select(chunking.section_chunks(F.col("s"), most).alias("x")).first()[0] == greedy(heading, body, most)
