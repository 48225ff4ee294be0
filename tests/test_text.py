import decimal
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seekmill.functions import text as tx
from seekmill.functions.segment import segment, segmenter
from seekmill.functions.snippet import snippet


def each(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", column(F.col("v")).alias("out")).orderBy("i").collect()
    return [r["out"] for r in rows]


def test_html(spark):
    assert each(spark, ["a&nbsp;b", "&amp;lt;", "&#65;x", "&#8211;&#8212;&#8230;", "&x;", "a & b", "&#1 no end", "&quot;&apos;&gt;"], tx.html_decode) == ["a b", "&lt;", "x", "--.", "&x;", "a & b", "&#1 no end", "\"'>"]
    assert each(spark, ["a<b c<d>e>f<g", "<script>x</script>", ">", ""], tx.html_strip) == ["aef", "x", "", ""]
    assert each(spark, ["&lt;b&gt;t", "a &lt; b &gt; c", None], tx.clean_html) == ["t", "a  c", None]


def test_tokens(spark):
    assert each(spark, ["Don't x2 3.14, déjà 增长!", "", None], tx.tokenize) == [["Don", "'", "t", "x2", "3.14", ",", "d", "é", "j", "à", "增", "长", "!"], [], []]
    assert each(spark, ["déjà vu-2"], lambda c: tx.tokenize(c, "word")) == [["déjà", "vu", "2"]]
    assert each(spark, ["don't DÉJÀ 9x"], tx.english_words) == [["don", "t", "d", "j", "x"]]
    assert each(spark, ["，", "GDP", "增", "㐀", "é", "7"], tx.is_cn_token) == [False, True, True, True, False, True]
    assert each(spark, ["aé增", ""], tx.characters) == [["a", "é", "增"], []]


def test_small_functions(spark):
    assert each(spark, ["  The ÀB\t", ""], tx.normalize_key) == ["the Àb", ""]
    assert each(spark, ["ab", "abc", "abcde", "abcdef"], tx.max_distance) == [1, 2, 2, 3]
    assert each(spark, ["ÀéThe", "no", None], lambda c: tx.keyword_position(c, F.lit("THE"))) == [4, None, None]
    assert each(spark, ["a<b>&'\""], tx.escape_html) == ["a&lt;b&gt;&amp;&#39;&quot;"]
    assert each(spark, ["GDP增长 gdp x1"], tx.highlight_words) == [["gdp", "x1", "增", "长"]]
    assert each(spark, ["The <cat>"], lambda c: tx.highlight(c, ["the", "cat"])) == ["<em>The</em> &lt;<em>cat</em>&gt;"]
    assert each(spark, [""], lambda c: tx.first_filled(c, F.lit(None).cast("string"), F.lit("z"))) == ["z"]
    row = spark.sql("select 5L a, 6L b").select(tx.hamming(F.col("a"), F.col("b")).alias("d")).first()
    assert row["d"] == 2


def test_snippet_sizes():
    assert snippet("x" * 300, ["x"]) == "x" * 300
    assert snippet(None, []) == ""
    assert snippet("x" * 301, ["q"]) == "x" * 300 + "..."
    assert snippet("x" * 250 + ", " + "y" * 200, ["q"]) == "x" * 250 + ",..."


def test_snippet_windows():
    text = "a" * 150 + " KEY " + "b" * 400
    got = snippet(text, ["key"])
    assert got.startswith("...") and got.endswith("...") and "KEY" in got
    assert len(got.encode()) <= 306
    early = snippet("key. " + "c" * 400, ["key"])
    assert early.startswith("key") and early.endswith("...")
    late = snippet("d" * 400 + "。尾key", ["key"])
    assert late.startswith("...") and late.endswith("key")
    chinese = snippet("汉" * 200 + "词。" + "字" * 200, ["词"])
    assert "词" in chinese
    tail = snippet("汉" * 40 + "key" + "字" * 50 + "。" + "后" * 100, ["key"])
    assert tail.endswith("。...")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=500), st.lists(st.text(min_size=1, max_size=4), max_size=3))
def test_snippet_is_text_of_bounded_size(text, words):
    out = snippet(text, words)
    assert out.encode() and len(out.encode()) <= max(300, 309) or not text


def test_segment(spark):
    freq = {"经济": 10, "增长": 8, "经": 1, "增": 1}
    import math

    logs = {w: math.log(f / 20) for w, f in freq.items()}
    assert segment("GDP经济增长x", logs, 2) == ["GDP", "经济", "增长", "x"]
    assert segment("", logs, 2) == []
    assert each(spark, ["经济增", None], segmenter(freq)) == [["经济", "增"], []]


@pytest.mark.parametrize("n", [0, 3])
def test_empty_frames(spark, n):
    df = spark.createDataFrame([("", None)] * n, "v string, w string")
    assert df.select(tx.tokenize(F.col("v")), tx.tokenize(F.col("w"))).count() == n


def test_marked_words_are_taken_literally(spark):
    df = spark.createDataFrame([("c++ (c) C++ ccc",)], "t string")
    assert df.select(tx.highlight(F.col("t"), ["c++", "", "("]).alias("x")).first()["x"] == "<em>c++</em> <em>(</em>c) <em>C++</em> ccc"
    assert df.select(tx.highlight(F.col("t"), [""]).alias("x")).first()["x"] == "c++ (c) C++ ccc"


def test_snippets_lead_by_a_third_of_their_size():
    text = "x" * 400 + " word " + "y" * 400
    assert snippet(text, ["word"], 90) == "..." + text[401 - 30 : 401 + 60] + "..."


def test_four_digits_are_exact(spark):
    r = random.Random(1)
    halves = [k / 10000 + 0.00005 for k in range(400)]
    xs = [0.0, -0.0, 0.5, 0.03125, 0.00015, 1e-300, -0.00004, 1 / 3, -1.0, 123456.78905, *halves, *(math.nextafter(h, r.choice([0, 9])) for h in halves), *(r.randrange(1 << 20) / (1 << r.randrange(25)) for _ in range(500))]
    got = [x[0] for x in spark.createDataFrame([(x,) for x in xs], "x double").select(tx.four_digits(F.col("x"))).collect()]
    place = decimal.Decimal("0.0001")
    want = [("-" if x < 0 else "") + str(decimal.Decimal(abs(x)).quantize(place, decimal.ROUND_HALF_UP, decimal.Context(prec=60))) for x in xs]
    assert got == want
    odd = spark.createDataFrame([(None,), (float("nan"),), (2.0**40,)], "x double").select(tx.four_digits(F.col("x"))).collect()
    assert [x[0] for x in odd] == [None, "NaN", "1099511627776.0000"]


def test_snippets_as_expressions(spark):
    r = random.Random(5)
    parts = ["word ", "é", "漢字", "。", "\n", ". ", "! ", "? ", ",", "𝔸", "x" * 40, "Key", "sentence end. ", "，", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 160))) for _ in range(300)] + [None, "", "a" * 300, "a" * 301, "é" * 151, "漢" * 200, "x" * 500 + "key", "key" + "x" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for keys, size in ((["key", "none"], 300), (["字", ""], 60), ([], 300), (["KEY"], 7)):
        from seekmill.functions.snippet import snippet_column

        got = [x["s"] for x in df.select("i", snippet_column(F.col("t"), keys, size).alias("s")).orderBy("i").collect()]
        assert got == [snippet(t, keys, size) for t in texts]
