"""Exact values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from leadlake import fixed_values as fv
from leadlake.functions import contact as ct
from leadlake.functions import html as h
from leadlake.functions import text as tx
from leadlake.functions.validation import validate_lead
from leadlake.operators.preferences import weights_valid


def run(spark, fn, values, kind="string"):
    """Apply a one-argument function to each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def check(spark, fn, cases, kind="string"):
    assert run(spark, fn, [c[0] for c in cases], kind) == [c[1] for c in cases]


def test_cleaning(spark):
    check(spark, tx.clean_index_text, [("Solar&Wind [Q3]", "solar wind q3"), ("far    apart  words", "far apart words"), ("Ação—é_1", "ação é_1"), ("", ""), (None, "")])
    check(spark, tx.clean_query_text, [("Wind-Farm? %&*", "wind-farm"), ('say "Big  Deal"!', 'say "big deal"')])
    check(spark, tx.clean_scrape_text, [("  Green   Roof  ", "green roof"), ("Roof*=+Tile", "roof tile"), ("a, (b). c-d!", "a, (b). c-d"), (None, "")])
    check(spark, tx.squeeze_spaces, [(" a\t\n b c ", "a b c"), (None, "")])


def test_tokens(spark):
    check(spark, tx.tokenize, [("the tide of a harbour", ["harbour", "tide"]), ("tide tides tide", ["tide", "tides"]), ("", [])])


def test_keywords(spark):
    text = "our crew wrote Python for NASA in an H2O lab, then some React"
    check(spark, tx.keyword_candidates, [(text, ["h2o", "nasa", "python", "react"]), ("", [])])
    check(spark, tx.description_keywords, [("gps2 b2 a-4x4 x 24x7", ["24x7", "4x4", "gps2"])])
    many = " ".join(f"word{i:02d}" for i in range(20))
    assert run(spark, tx.description_keywords, [many]) == [[f"word{i:02d}" for i in range(10)]]


def test_frequent_words(spark):
    text = "Solar wind solar energy wind turbine https energy solar the company blade"
    expected = ["solar", "wind", "energy", "turbine", "blade"]
    check(spark, tx.frequent_words, [(text, expected), ("short", []), (None, [])])


def test_parse_query(spark):
    def parts(q):
        return F.struct(F.array_join(q["terms"], " "), F.array_join(q["phrases"], "|"), q["industry"], q["location"], q["company_size"])

    got = run(spark, lambda x: parts(tx.parse_query(x)), ["startup technology", 'firm "tidal power" software', "startup tech são paulo", "", None, "sao paulonia bank-like rio", 'the "" x'])
    assert [tuple(r) for r in got] == [
        ("startup technology", "", "Tecnologia", None, "1-10"),
        ("firm software", "tidal power", "Tecnologia", None, None),
        ("paulo startup são tech", "", "Tecnologia", "São Paulo", "1-10"),
        ("", "", None, None, None),
        ("", "", None, None, None),
        ("bank-like paulonia rio sao", "", "Financeiro", "Rio de Janeiro", None),
        ("", "", None, None, None),
    ]


def test_highlight(spark):
    def mark(x):
        return tx.highlight(x, F.array(F.lit("software"), F.lit("tech")), F.array(F.lit("saúde geral")))

    check(spark, mark, [
        ("TechMaré SOFTWARE tech", "<mark>tech</mark>Maré <mark>software</mark> <mark>tech</mark>"),
        ("A Saúde Geral", "A <mark>saúde geral</mark>"), ("nothing", None), ("", None), (None, None),
    ])


def test_query_expansion(spark):
    got = run(spark, tx.expand_query, ["tech software", "x", None, "adv rio"])
    assert got[0] == ["tech software tecnologia", "tech software desenvolvimento", "tech software startup"]
    assert got[1] == [] and got[2] == []
    assert got[3] == ["adv rio advogado", "adv rio escritório jurídico", "adv rio advocacia", "adv rio centro", "adv rio zona sul"]


def test_request_hash(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None)], "t string, n int")
    a, b, c = [r[0] for r in df.select(tx.request_hash(F.col("t"), F.col("n"))).collect()]
    assert a == b != c and len(a) == 32


def test_email(spark):
    check(spark, ct.extract_email, [("write to crew@harbour.com, or to dock@pier.org", "crew@harbour.com"), ("noreply@harbour.com only", None), ("call instead", None), ("x Test@a.com; REAL@Shop.com.br", "real@shop.com.br"), (None, None)])
    check(spark, lambda x: ct.extract_email(x, fv.EMAIL_SKIP_WORDS_STRICT), [("admin@a.com b@c.org", "b@c.org")])
    check(spark, ct.is_business_email, [("crew@harbour.com", True), ("ivo@gmail.com", False), ("cais@porto.com.br", True), ("ivo@yahoo.com", False), ("", False), (None, False)])
    check(spark, ct.is_valid_business_email, [("a@b.co", True), ("a@b", False), ("a@GMAIL.com", False), (None, False)])


def test_phone(spark):
    check(spark, ct.extract_phone_br, [("(48) 98811-2233", "(48) 98811-2233"), ("48 98765-1020", "48 98765-1020"), ("+55 27 96543-2109", "+55 27 96543-2109"), ("tel  98123-4567", "98123-4567"), ("write instead", None)])
    check(spark, ct.extract_phone, [("call (48)  3221-7788 now", "(48)  3221-7788"), ("98123-4567", None)])
    check(spark, ct.normalize_phone, [("(11) 98811-2233", "+5511988112233"), ("21 3221 7788", "+552132217788"), ("+55 71 9", "+55719"), ("(71) 98811-2233", "(71) 98811-2233"), ("", None), (None, None)])


def test_urls(spark):
    check(spark, ct.url_domain, [("https://harbour.com/map", "harbour.com"), ("http://cais.porto.com.br", "cais.porto.com.br"), ("harbour", None), ("", None), ("HTTP://A.com:80?x#y", "a.com:80")])
    check(spark, ct.url_domain_bare, [("https://www.a.com", "a.com"), (None, None)])
    check(spark, ct.is_valid_url, [("https://harbour.com", True), ("http://porto.com.br", True), ("no-address", False), ("", False)])
    check(spark, ct.is_company_site, [("https://harbour.com", True), ("https://google.com", False), ("https://facebook.com", False), ("no-address", False)])
    check(spark, ct.is_company_result_link, [("https://a.io", False), ("https://a.com.br/x", True), ("//amazon.com", False), ("x", False)])
    check(spark, ct.is_business_website, [("ftp://a.com", False), ("https://a.com", True), ("https://x.youtube.com", False), (None, False)])
    check(spark, ct.unwrap_redirect, [("//d.com/l/?uddg=https%253A%252F%252Fa.com%252Fx%252By&rut=1", "https://a.com/x+y"), ("/l/?uddg=http%3A%2F%2Fb.com", "http://b.com"), ("https://plain.com", "https://plain.com")])


def test_company_names(spark):
    check(spark, ct.normalize_company, [("Porto Azul LTDA.", "porto azul"), ("Harbour Inc", "harbour"), ("Cais SA", "cais"), ("Casa Lláme", "casa lláme"), ("Messages Corp of Me", "messages of"), (None, "")])
    check(spark, ct.clean_company, [("  Foo   LLC  Bar ", "Foo Bar"), ("Sá Corp.", "Sá")])
    pairs = spark.createDataFrame([("Harbour", "Lighthouse"), ("Porto", "Porto"), ("", "x"), ("a b c d", "a b c e")], "a string, b string")
    got = [r[0] for r in pairs.select(ct.company_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [0.0, 1.0, 0.0, 0.6]


def test_locations(spark):
    check(spark, ct.extract_location_br, [("Recife, PE", "Recife, PE"), ("Salvador", "Salvador"), ("Escritório em BA", "BA"), ("nowhere", None), ("em curitiba  pr", "Curitiba, PR"), (None, None)])
    check(spark, ct.extract_location_page, [("x Belo Campo, MG y", "Belo Campo, MG"), ("Rua do Cais, 31, Olinda", "Olinda"), ("Av. Marinha, 8, Natal", "Natal"), ("em Recife hoje", "Recife"), ("nada", None)])


def test_numbers(spark):
    check(spark, ct.headcount, [("3,450 employees", "3450+"), ("a crew of 28 people", "28+"), ("employees many", None)])
    check(spark, ct.rating_number, [("3.7 stars", 3.7), ("none", None)])
    check(spark, ct.first_number, [("51-200", 51), ("R$ 5M", 5), ("n/a", None), (None, None)])


def test_completeness(spark):
    full = {n: F.lit("x") for n in ("company", "email", "phone", "website", "industry", "location", "description")}
    row = spark.range(1).select(ct.completeness(full), ct.completeness({"company": F.lit("Company")}), ct.completeness({**full, "contact": F.lit("c")})).first()
    assert row[0] == pytest.approx(0.95) and row[1] == 0.3 and row[2] == pytest.approx(1.0)


def test_format_and_enhance(spark):
    raw = {"company": "  PORTO AZUL LTDA ", "email": "CREW@HARBOUR.COM", "phone": "(11) 98811-2233", "website": "https://harbour.com", "description": "  Boats for rent by the hour "}
    out = ct.format_record({k: F.lit(v) for k, v in raw.items()})
    row = spark.range(1).select(*[c.alias(n) for n, c in out.items()]).first()
    assert (row["company"], row["email"], row["description"]) == ("porto azul ltda", "crew@harbour.com", "boats for rent by the hour")
    assert row["data_quality_score"] == pytest.approx(0.8)
    better = ct.enhance_record({k: F.lit(v) for k, v in raw.items()})
    row = spark.range(1).select(*[c.alias(n) for n, c in better.items()]).first()
    assert (row["company"], row["phone"]) == ("PORTO AZUL", "+5511988112233")


def test_weight_rules(spark):
    good = {"industry_match": 0.25, "location_proximity": 0.15, "company_size": 0.1, "text_relevance": 0.4, "data_quality": 0.1}
    too_much = {"industry_match": 0.5, "location_proximity": 0.5, "company_size": 0.5, "text_relevance": 0.4, "data_quality": 0.1}
    outside = {"industry_match": 1.5, "location_proximity": 0.0, "data_quality": -0.5}
    check(spark, weights_valid, [(good, True), (too_much, False), (outside, False), ({}, False), (None, True)], "map<string,double>")


def test_validation(spark):
    rows = [
        ("Acme Ltda", "a@acme.com.br", "(11) 99999-9999", "https://acme.com.br", "São Paulo, SP"),
        ("test", "x@gmail.com", "123", "ftp://x.com", "X"),
        (None, None, None, None, None),
        ("A" * 101, "admin@a.com", "00 1234-56789", "facebook.com", "Pacific"),
        ("Ok", "bad mail", "1" * 16, "https:///nohost", "Interior"),
    ]
    df = spark.createDataFrame(rows, "company string, email string, phone string, website string, location string")
    fields = {c: F.col(c) for c in df.columns}
    got = [r["v"] for r in df.select(validate_lead(fields).alias("v")).collect()]
    assert got[0]["is_valid"] and got[0]["confidence_score"] == pytest.approx(1.0) and got[0]["issues"] == []
    assert got[0]["enhanced"]["area_code"] == "11" and got[0]["enhanced"]["secure_website"] == "true"
    assert got[1]["issues"] == ["Company name appears to be placeholder", "Personal email domain detected", "Phone number too short", "Invalid URL scheme", "Location too short"]
    assert got[1]["confidence_score"] == pytest.approx(0.1 * 0.3 + 0.3 * 0.25) and not got[1]["is_valid"]
    assert got[2]["issues"] == ["Missing company name"]
    assert got[2]["suggestions"][-1].startswith("Lead has no contact information") and len(got[2]["suggestions"]) == 2
    assert got[3]["issues"] == ["Company name unusually long", "Email appears to be system/admin email", "Invalid Brazilian area code: 00", "Missing URL scheme (http/https)"]
    # "AC" inside "PACIFIC" counts as a state.
    assert got[3]["confidence_score"] == pytest.approx(0.5 * 0.3 + 0.2 * 0.25 + 1.0 * 0.2 + 0.8 * 0.1)
    assert "Missing domain in URL" in got[4]["issues"] and "Phone number too long" in got[4]["issues"]


def test_html_references(spark):
    check(spark, lambda x: h.unescape(h.decode_references(x)), [
        ("a &amp; b &eacute;&#233;&#xE9; &copy; &unknown; &", "a & b ééé © &unknown; &"),
        ("&amp;lt; &lt;b&gt; &#60;i&#62; &#38;amp;", "&lt; <b> <i> &amp;"), ("&#128512;", "\U0001F600"), ("plain", "plain"), (None, None),
    ])


def test_html_text(spark):
    page = '<!DOCTYPE html><style>p{}</style><!-- <p>no</p> --><script>var a="</p>";</script><p title="a>b">One</p><p>Two 1 < 2</p>'
    check(spark, lambda x: h.text_of(h.without_hidden(x)), [(page, "OneTwo 1 < 2")])


def test_links(spark):
    base = F.lit("https://www.a.com/dir/page.html?q=1#x")
    check(spark, lambda x: h.resolve_url(base, x), [
        ("/contact", "https://www.a.com/contact"), ("sub/x", "https://www.a.com/dir/sub/x"), ("../up", "https://www.a.com/up"),
        ("//b.com/x", "https://b.com/x"), ("http://c.com", "http://c.com"), ("?z=2", "https://www.a.com/dir/page.html?z=2"),
        ("#top", "https://www.a.com/dir/page.html?q=1#top"), ("", "https://www.a.com/dir/page.html?q=1#x"),
    ])
