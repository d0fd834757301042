from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import answers, fields, html, strings, templates, urls
from shelfspark.operators.models import apply_text_model, summarize_title


def evaluate(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_clean_price(spark):
    cases = {"": None, None: None, "$1,234.50": 1234.5, " 7 ": 7.0, "1_000": 1000.0, "abc": None, "1d": None, "inf": None, ".5": 0.5, "-2e3": -2000.0}
    assert evaluate(spark, fields.clean_price, list(cases)) == list(cases.values())


def test_price_or_zero(spark):
    assert evaluate(spark, fields.price_or_zero, ["", "  ", "3.5", "x"]) == [0.0, 0.0, 3.5, None]


def test_price_error(spark):
    got = evaluate(spark, lambda c: fields.price_error(c, "price"), ["", None, "3", "x"])
    assert got == [None, None, None, "bad price: x"]


def test_lists(spark):
    raw = ["", "[]", '["a", "b"]', "[a,,b]", "a"]
    assert evaluate(spark, fields.list_split_raw, raw) == [r.strip("[]").split(",") for r in raw]
    assert evaluate(spark, fields.list_parse_clean, [*raw, None]) == [[], [], ["a", "b"], ["a", "", "b"], ["a"], []]


class VisibleStrings(HTMLParser):
    """Independent reading of a page with the standard library's tokenizer."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, [""]

    def cut(self, *_):
        self.parts.append("")

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template")
        self.cut()

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template")
        self.cut()

    handle_comment = handle_decl = handle_pi = cut

    def handle_data(self, data):
        if not self.hidden:
            self.parts[-1] += data


def visible(page):
    parser = VisibleStrings()
    parser.feed(page)
    parser.close()
    return "\n".join(s for s in (p.strip() for p in parser.parts) if s)


def test_html_text_agrees_with_a_tokenizer_on_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for row in pages.select("html", html.html_to_text(F.col("html")).alias("t")).collect():
        assert row["t"] == visible(row["html"])


def test_html_text_cases(spark):
    page = "<p title='a>b'>x &lt; y &#233; &#xE9; &nope; &amp;lt;<!-- <b>no</b> --> tail</p><script>var a='</p>';</script>\n <b> l\n m</b>"
    assert evaluate(spark, html.html_to_text, [page]) == ["x < y é é &nope; &lt;\ntail\nl\n m"]
    assert evaluate(spark, html.html_title, ["<title> A\n &amp;  b </title>", "none"]) == ["A & b", ""]


def test_links(spark):
    page = '<a href="/x/p/1">1</a><a class="c" href="/y">2</a><a href="http://z/p/2">3</a><!-- <a href="/p/3"> -->'
    assert evaluate(spark, html.links, [page]) == [["/x/p/1"]]


@pytest.mark.parametrize(
    "page, found",
    [
        ("<a href=/p/1>x</a>", ["/p/1"]),
        ('<a title="a>b" href="/p/4">x</a>', ["/p/4"]),
        ("<a data-x=\"href='/p/9'\" href='/p/2'>x</a>", ["/p/2"]),
        ("<A\nHREF = '/p/3' href=/p/33>x</A>", ["/p/3"]),
        ("<script>document.write('<a href=\"/p/5\">')</script><a href=/p/6/>x</a>", ["/p/6/"]),
        ('<textarea><a href="/p/7"></textarea><noscript><a href="/p/8"></noscript>', []),
        ('<a href="/p/1?a=1&copy=2&amp;b=3">x</a>', ["/p/1?a=1&copy=2&b=3"]),
        ("<a href='&#47;p&sol;&#x2f;p/1'>x</a>", ["/p&sol;/p/1"]),
        ("<a don't href=/p/10>x</a><abbr href=/p/11><a/href=/p/12>", ["/p/10", "/p/12"]),
        ("<a href=/p/13", []),
        ('<!-- <script> --><a href="/p/14">x</a><!-- </script> -->', ["/p/14"]),
    ],
)
def test_links_in_any_markup(spark, page, found):
    assert evaluate(spark, lambda c: html.links(c, "/p"), [page]) == [found]


def test_references_without_semicolon(spark):
    page = "<p>&copy 2020 &copyright &amp &eacute; &Eacutexy &#233 &#xE9 &#150; &nope &ampx</p><p title=\"x>y\">it's <b>so</b></p>"
    assert evaluate(spark, html.html_to_text, [page]) == ["© 2020 ©right & é Éxy é é – &nope &x\nit's\nso"]


def test_long_pages_are_read_whole(spark):
    tail = "<a href=/p/77>end</a>"
    page = "<p class=\"x y\" id=z>word</p>" * 60_000 + "<script>" + "if (a < b && c > d) {}" * 60_000 + "</script>" + tail
    assert evaluate(spark, html.links, [page]) == [["/p/77"]]
    assert evaluate(spark, html.html_to_text, [page])[0].endswith("word\nend")


def test_urls(spark):
    good = ["https://a.example/p/1", "http://a.example:8080/x/y/p/0042", "https://a.example/p/p/7", "https://a.example//p/99", "https://a.example/p/12?size=3"]
    bad = ["https://a.example/p/", "https://a.example/p/12/", "https://a.example/p/12a", "https://a.example/?u=/p/12", "https://p.example/12", "", None]
    assert evaluate(spark, urls.is_product_url, good + bad) == [True] * len(good) + [False] * len(bad)
    assert evaluate(spark, urls.site_name, ["https://www.a.com:80/x", "http://b.www.c.com/", "oops", None]) == ["a.com:80", "b.c.com", "", ""]
    assert evaluate(spark, urls.is_yes, [" SÍ\n", "si", "No", None]) == [True, True, False, False]


def test_json(spark):
    cases = {
        '{"k": 1}': '{"k": 1}',
        "Sure: {'k': 'é'} bye": '{"k": "é"}',
        "{k: 3}": '{"k": 3}',
        "{ñu: 'a'}": '{"ñu": "a"}',
        "none": None,
        '{"a":1} {"b":2}': None,
        '{"u":"https://x"}': '{"u":"https://x"}',
        "{'u': 'https://x'}": None,
        None: None,
    }
    assert evaluate(spark, answers.parse_json, list(cases)) == list(cases.values())


def test_analyzers(spark):
    text = "Don't STOP: John.Doe@x.com 3.5kg 1,234.50 Straße Été 日本 foo_bar a.b.c"
    assert evaluate(spark, strings.analyze, [text, None]) == [
        ["don't", "stop", "john.doe", "x.com", "3.5kg", "1,234.50", "strasse", "ete", "日", "本", "foo_bar", "a.b.c"],
        [],
    ]
    assert evaluate(spark, strings.letter_tokens, ["Ab1c d-É"]) == [["ab", "c", "d", "é"]]
    assert evaluate(spark, strings.edge_ngrams, ["Red 2b"]) == [["r", "re", "red", "2", "2b"]]
    assert evaluate(spark, strings.edge_ngrams, ["x" * 25]) == [["x" * n for n in range(1, 21)]]


def test_templates(spark):
    got = evaluate(spark, lambda c: templates.rerank_text(F.lit("T"), c, F.lit(None)), ["d", None])
    assert got == ["Title: T\nDescription: d\nSummary:", "Title: T\nDescription: \nSummary:"]
    assert evaluate(spark, lambda c: templates.page_record(c, F.lit("body")), ["u"]) == ["\n\nURL: u\nContent:\nbody\n" + "-" * 80]


@pytest.mark.parametrize(
    "title, summary",
    [("Acme, steel garden rake  long handle | Tools", "steel garden rake long handle"), ("Oat flour 750 g organic", "Oat flour"), ("Tent - four seasons", "Tent"), ("Wool sock size 42", "Wool sock"), ("One", "One"), (None, None)],
)
def test_summarize_title(spark, title, summary):
    assert evaluate(spark, summarize_title, [title]) == [summary]


def test_text_model_marks_only_the_bad_row(spark):
    def factory():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return [t.upper() for t in texts]

        return model

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "c")], "i int, t string").coalesce(1)
    rows = apply_text_model(df, "t", "o", factory).orderBy("i").collect()
    assert [r["o"] for r in rows] == ["A", None, None, "C"]
    assert [r["o_error"] for r in rows] == [None, "ValueError: no", None, None]


def test_hidden_html(spark):
    pages = [
        "<p>a</p><!-- old <script> tag --><p>b</p><p>c</p>",
        "<p>a</p><!-- <style> --><p>b</p><style><!-- x</style><p>c</p>",
        "<p>a</p><script>if (x) '<!--'</script><p>b</p>",
    ]
    assert evaluate(spark, html.html_to_text, pages) == ["a\nb\nc", "a\nb\nc", "a\nb"]
    heads = ["<head><!-- <title>old</title> --><title>new</title></head>", "<svg><title>icon</title></svg><title>page</title>"]
    assert evaluate(spark, html.html_title, heads) == ["new", "page"]
