"""Scalar columns: hand-computed rows and differential checks against the standard library."""

import html.parser
import re
from email.utils import parseaddr
from urllib.parse import urljoin, urlparse

from hypothesis import strategies as st
from hypothesis import given, settings
from pyspark.sql import functions as F

from exposight.functions import fixed_values as fv
from exposight.functions import html as h
from exposight.functions import people, sender, urls
from exposight.functions import text as tx

SUBJECT = (
    "first_name string, middle_names array<string>, last_name string, email string, "
    "usernames array<string>, locations array<string>, numbers array<string>"
)
ANA = ("Ana", ["Bea", "Cleo", "Dora"], "Testwell", "ana.testwell@mail.example.com", ["atestwell42"], ["Northport"], ["01632 960123"])


class TextReader(html.parser.HTMLParser):
    dropped = {"script", "style", "noscript", "svg", "iframe"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.nodes, self.now = 0, [], ""

    def cut(self):
        if self.now.strip():
            self.nodes.append(self.now.strip())
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.cut()
        self.depth += tag in self.dropped

    def handle_endtag(self, tag):
        self.cut()
        self.depth -= tag in self.dropped and self.depth > 0

    def handle_comment(self, data):
        self.cut()

    def handle_decl(self, decl):
        self.cut()

    def handle_data(self, data):
        self.now += "" if self.depth else data


def read_text(page):
    reader = TextReader()
    reader.feed(page)
    reader.close()
    reader.cut()
    return " ".join(reader.nodes)


def test_page_text_equals_the_standard_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("html", h.visible_text(h.drop_elements(F.col("html"))).alias("t")).collect()
    assert len(rows) == 250
    assert [r for r in rows if read_text(r["html"]) != r["t"]] == []


def test_page_text_edges(one):
    cases = {
        "<p>a</p><script>x<b></script>b": "a b",
        "a<!-- <p>no</p> - -->b<STYLE>q</STYLE >c": "a b c",
        "x &amp;amp; y &lt;b&gt; &#8364;&#x41;&nbsp;": "x &amp; y <b> €A",
        "<svg><text>no</text></svg><iframe src=q>no</iframe>yes": "yes",
        "<!-- <script> -->kept<!-- </script> -->": "kept",
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "": "",
    }
    got = one([(c,) for c in cases], "p string", h.visible_text(h.drop_elements(F.col("p"))))
    assert [g[0] for g in got] == list(cases.values())


def test_meta_title_images_links(one):
    page = (
        "<title> T <b>x</b></title><meta content='k1, k2' name=\"keywords\"><meta name=description content='A &amp; B'>"
        "<meta name='Description' content='no'><img src=a.png><img alt=none><!-- <img src=no.png> -->"
        "<a href='mailto:a@b.example.com?x=1'>contact</a><a HREF=/p>Con<b>tact</b> privacy</a><a name=q>no</a>"
        "<a href='https://netflix.com/t'>film</a>"
    )
    m = F.col("m")
    links = h.classified_links(m, urls.base_parts(F.lit("https://h.example.com/d/x")))
    strict = h.classified_links(m, urls.base_parts(F.lit("https://h.example.com/d/x")), social_mode="host_suffix")
    (row,) = one(
        [(page,)], "p string",
        *[c for c in (
            h.title(h.drop_elements(F.col("p"))), h.meta_content(h.drop_elements(F.col("p")), "description"),
            h.meta_content(h.drop_elements(F.col("p")), "keywords"), h.meta_content(h.drop_elements(F.col("p")), "none"),
            h.image_sources(h.drop_elements(F.col("p"))),
        )],
    )
    assert row == ("Tx", "A & B", "k1, k2", "", ["a.png"])
    (row,) = one([(page,)], "m string", F.transform(links, lambda x: F.concat_ws("|", x["url"], x["is_mail"].cast("string"), x["is_contact"].cast("string"), x["is_privacy"].cast("string"), x["is_social"].cast("string"))), F.transform(strict, lambda x: x["is_social"]))
    assert row[0] == [
        "mailto:a@b.example.com?x=1|true|false|false|false",
        "https://h.example.com/p|false|true|true|false",
        "https://netflix.com/t|false|false|false|true",
    ]
    assert row[1] == [False, False, False]


def test_mail_markup(one):
    cases = {
        "<p>Free &amp; easy</p><p>Ends</p>": "Free & easy Ends",
        "Write to <a.b@c.example.com>": "Write to a.b@c.example.com",
        " no markup ": " no markup ",
        "a <b> c</b>": "a   c",
        "x<script>y()</script>z": "x z",
    }
    got = one([(c,) for c in cases], "p string", h.strip_mail_markup(F.col("p")))
    assert [g[0] for g in got] == list(cases.values())


BASES = ["http://h.example.com/a/b/c?x=1#f", "https://h.example.com", "https://h.example.com/d/"]
HREFS = (
    "|g|./g|g/|/g|//x.example.com|//x.example.com/p?q|?y|g?y|#s|g#s|g?y#s|../g|../../g|../../../g|.|./|..|../|/./g|/../g|g.|..g|"
    "./../g|./g/.|g/./h|g/../h|mailto:a@b.c|https://Z.example.com/a/../b|HTTPS://q.example.com/x?|javascript:void(0)|a//b|/a//b|g?|g#| /lead"
).split("|")


def test_resolve_equals_urljoin(one):
    rows = [(b, x) for b in BASES for x in HREFS]
    got = one(rows, "b string, h string", urls.resolve(F.col("b"), F.col("h")))
    assert [(r, g[0]) for r, g in zip(rows, got) if g[0] != urljoin(*r)] == []


def test_canonical_and_domain(one):
    cases = ["HTTPS://A.example.com:8080/p/q;x=1?y#z", "http://u:p@h.example.com", "https://h.example.com/a;b/c?d", "nohost/path"]
    got = one([(c,) for c in cases], "u string", urls.canonical(F.col("u")), urls.domain(F.col("u")))
    for case, (canonical, domain) in zip(cases, got):
        p = urlparse(case)
        assert canonical == f"{p.scheme}://{p.netloc}{p.path}" and domain == p.netloc
    # Canonical addresses stay as they are (one without a scheme is no address to begin with).
    addresses = [g for g in got if not g[0].startswith("://")]
    again = one([(g[0],) for g in addresses], "u string", urls.canonical(F.col("u")))
    assert [g[0] for g in addresses] == [a[0] for a in again]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab.@ +-_é0159()\n  \x1c", max_size=40), min_size=30, max_size=30))
def test_patterns_equal_python(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = rows.select(
        tx.emails_in(F.col("t")), tx.phones_in(F.col("t")), tx.strip(F.col("t")), tx.collapse_spaces(F.col("t")),
        tx.digits_only(F.col("t")), tx.words(F.col("t")),
    ).collect()
    email, phone = re.compile(fv.EMAIL_PATTERN[4:]), re.compile(fv.PHONE_PATTERN[4:])
    for t, g in zip(texts, got):
        assert tuple(g) == (
            email.findall(t), phone.findall(t), t.strip(), re.sub(r"\s+", " ", t), re.sub(r"\D", "", t),
            re.findall(r"(?u)\b\w\w+\b", t.lower()),
        )


def test_html_constructs(one):
    page = (
        '<title a="1>2">T</title><meta name="description" content="A > B"><img alt="a>b src=q" src="z.png">'
        "<a title='x>y' href=\"/contact\">Contact</a><p title=it's>ok</p><ruby>k<rt>hid</ruby>r<template>tt</template>"
        '<svg a="/"/>after<script>var q=1'
    )
    markup = h.drop_elements(F.col("p"))
    (row,) = one(
        [(page,)], "p string", h.title(markup), h.meta_content(markup, "description"), h.image_sources(markup),
        F.transform(h.anchors(markup), lambda a: a["href"]), h.visible_text(markup),
    )
    assert row == ("T", "A > B", ["z.png"], ["/contact"], "T Contact ok k r after")


def test_sender_equals_strict_parseaddr(one):
    cases = [
        "Deals Team <promo@shop.example.com>", '"Doe, Jane" <jane@corp.example.org>', "no-reply@n.example.net",
        "<alerts@s.example.com>", "Odd <a@b@c.example.com>", "", "Doe, Jane <j@x.example.com>",
        "Jane (Sales) <j@x.com>", r'"A \"B\" C" <j@x.com>', '"Doe" Jane <j@x.com>', "Team <noat>", "noat", "(c) Jane <j@x.com>",
        '"A (x)" <a@b.com>', "J. Doe <a@b.com>", "Two  Words <a@b.com>", "j@x.com (Jane)", "Jane <j@x.com> trailing",
    ]
    address = sender.sender_address(F.col("s"))
    got = one([(c,) for c in cases], "s string", sender.sender_name(F.col("s")), address, sender.address_user(address), sender.address_domain(address))
    for case, (name, addr, user, domain) in zip(cases, got):
        want = ("", "") if case.count("@") > 1 else parseaddr(case)
        assert (name, addr) == want
        assert (user, domain) == (want[1].partition("@")[0], want[1].partition("@")[2])


def test_names_terms_and_confidence(one):
    names = people.search_names(F.col("first_name"), F.col("middle_names"), F.col("last_name"))
    queries = ['"ana.testwell@mail.example.com" leak', '"01632 960123"', '"ATESTWELL42" site:x.com', '"Ana Testwell" "Northport"', '"Ana Testwell"', "else"]
    (row,) = one(
        [ANA], SUBJECT, names, F.size(people.matching_names(F.col("first_name"), F.col("middle_names"), F.col("last_name"))),
        people.identity_terms_of(), people.queries_of(), F.array(*[people.query_confidence(F.lit(q)) for q in queries]),
    )
    assert len(row[0]) == 8 and row[0] == sorted(row[0]) and row[1] == 5
    assert [t["entity_type"] for t in row[2]] == ["email", "username"] + ["name"] * 5 + ["location", "phone"]
    assert row[3][:4] == ['"ana.testwell@mail.example.com"'] + [f'"ana.testwell@mail.example.com" {w}' for w in ("leak", "breach", "password")]
    assert len(row[3]) == 4 + 3 + 23 + 8 * 4
    assert row[4] == [1.0, 1.0, 0.9, 0.6, 0.2, 0.0]


def test_missing_names_and_digitless_numbers(one):
    empty = (None, [], None, None, [], [""], ["n/a"])
    (row,) = one([empty], SUBJECT, people.identity_terms_of(), people.queries_of())
    assert row == ([], ['"n/a"', '"n/a" leak', '"n/a" pastebin'])


def test_display_columns(one):
    (row,) = one(
        [("email", "a@b.example.com", 1.0, None), ], "t string, v string, c double, n string",
        tx.finding_line(F.col("t"), F.col("v"), F.col("c")), tx.finding_line(F.lit("a type longer than 15"), F.col("v"), F.lit(0.8)),
        tx.or_unknown(F.col("n")), tx.preview(F.lit("x" * 2000)), tx.preview(F.col("n")),
    )
    assert row == ("email          a@b.example.com (1.00)", "a type longer than 15a@b.example.com (0.80)", "Unknown", "x" * 1000, "")


def test_query_confidence_by_any_middle_names(spark):
    names = "first_name string, middle_names array<string>, last_name string"
    row = ["Ana", ["Max (jr.)", "Bea"], "Testwell"]
    empty = F.array().cast("array<string>")
    rest = {"email": F.lit(None).cast("string"), "usernames": empty, "locations": F.array(F.lit("Port 1")), "numbers": empty}
    cases = {
        '"ana testwell"': 0.2, '"Ana Max (jr.) Testwell" "port 1"': 0.6, '"Ana Max (Jr.) Bea Testwell"': 0.2,
        '"Ana Bea Max (jr.) Testwell"': 0.0, '"Ana Max jr Testwell"': 0.0, '"Testwell Ana"': 0.0,
    }
    rate = lambda rows: [
        tuple(r)[0] for r in
        rows.withColumns(rest).select(F.array(*[people.query_confidence(F.lit(q)) for q in cases]).alias("c")).collect()
    ]
    assert rate(spark.createDataFrame([row], names)) == [list(cases.values())]
    nameless = spark.createDataFrame([(None, ["Bea"], None), (None, [], None), (None, ["Bea"], "Testwell")], names)
    assert rate(nameless) == [[0.0, 0.0, 0.2, 0.2, 0.0, 0.0], [0.0] * 6, [0.2, 0.6, 0.2, 0.2, 0.2, 0.2]]
