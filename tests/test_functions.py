import datetime

from pyspark.sql import functions as F

from perusal import config
from perusal.functions import dates, markup, text
from perusal.operators import render
from perusal.plans.tracker import Tracker


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_identifiers(spark):
    r = one(
        spark, bare=text.bare_id(F.lit("arXiv:2501.00042 ")), doi=text.preprint_doi(F.lit("arXiv:2501.00042")), url=text.preprint_url(F.lit("arXiv:2501.00042")), seen=text.bare_id_in_url(F.lit("http://arxiv.org/abs/2501.00042v3")),
        none=text.bare_id_in_url(F.lit("https://arxiv.org/pdf/2501.00042")), res=text.without_resolver(F.lit("https://dx.doi.org/10.1/x")), link=text.doi_url(F.lit("10.1/x")),
    )
    assert tuple(r) == ("2501.00042", "10.48550/arXiv.2501.00042", "https://arxiv.org/abs/2501.00042", "2501.00042", None, "10.1/x", "https://doi.org/10.1/x")


def test_clean_markup_decodes_after_tags_go(spark):
    raw = "<jats:p>A &lt;b&gt;bold&lt;/b&gt;\n claim</jats:p><jats:p>x&nbsp;&amp;lt; y</jats:p>"
    assert one(spark, t=markup.call("clean_jats", F.lit(raw))).t == "A <b>bold</b> claim x &lt; y"
    assert one(spark, t=markup.call("clean_jats", F.lit(None).cast("string"))).t == ""
    assert markup.KINDS["clean_jats"][0](raw) == "A <b>bold</b> claim x &lt; y"
    assert markup.KINDS["clean_jats"][0]("&alpha;-H&#8322;O &#x2013; 5&deg; caf&eacute; a &le; b &notanentity") == "α-H₂O – 5° café a ≤ b ¬anentity"


def test_non_articles(spark):
    cases = {("10.1021/ctv021i005", "t"): True, ("10.1/x", " Erratum: a"): True, ("10.1/x", "ERRATUM"): True, ("10.1/x", "Erratums"): False, ("10.1/x", "An erratum"): False}
    for (doi, title), want in cases.items():
        assert one(spark, n=text.non_article(F.lit(doi), F.lit(title))).n is want


def test_dates(spark):
    for raw, want in {"March 26, 2026": "2026-03-26", "(Web) : Mar 6, 2026": "2026-03-06", "March 26,2026": "2026-03-26", "Mar 26,2026": "2026-03-26", "2026-3-6": "2026-03-06", "sometime": "sometime", "": ""}.items():
        assert one(spark, d=dates.normal_date(F.lit(raw))).d == want
    for parts, want in {(2026, 4, 5): "2026-04-05", (2026, 4): "2026-4", (2026,): "2026", (): ""}.items():
        a = F.array(*map(F.lit, parts)) if parts else F.array().cast("array<int>")
        assert one(spark, d=dates.from_parts(a)).d == want
    days = one(spark, d=dates.month_days(F.lit(2024), F.lit(2))).d
    assert len(days) == 29 and days[-1] == datetime.date(2024, 2, 29)
    today = datetime.date(2026, 5, 9)
    assert dates.parse_month("1949.10", today) == (2026, 5) and dates.parse_month("2025.02", today) == (2025, 2)
    assert one(spark, y=dates.group_year(F.lit("/loi/x/group/d2020.y2025"), today)).y == 2025 and one(spark, y=dates.group_year(F.lit("/loi/x"), today)).y == 2026


def test_quoting(spark):
    q = one(spark, q=text.quoted(F.lit("a <b> & 'c'\n\"[[d]]\""))).q
    assert q == "\n> a &lt;b&gt; &amp; &#39;c&#39;\n> &#34;$[[d]]$&#34;"
    assert one(spark, q=text.quoted(F.lit(""))).q == "\n> "


def test_query_string(spark):
    assert one(spark, q=text.query_string({"a b": "x+y", "c": F.lit("d e&f")})).q == "a+b=x+y&c=d+e%26f"


def test_config(tmp_path):
    assert len(config.categories()) == 6 and config.categories()["chem-ph"]["terms-1-term"] == "physics.chem-ph"
    assert config.search_parameters(config.categories()["hep-ex"], "2026-01-01", "2026-01-02")["date-to_date"] == "2026-01-02"
    f = tmp_path / "c.toml"
    f.write_text('[journals.j]\nname = "J"\nissn = "1"\nslug = "j"\n')
    assert list(config.journals(str(f))) == ["j"] and list(config.journals(str(tmp_path / "no"))) == ["jctc", "jcp"]
    try:
        config.pick(config.journals(), "nope", "Journal")
    except RuntimeError as e:
        assert "jctc" in str(e)
    else:
        raise AssertionError


def test_output_roots_and_paths(spark):
    for provider, code, want in [("aip", "", "aip"), ("", "jctcce", "acs"), (None, None, "journals"), ("aip", "x", "aip")]:
        assert Tracker(spark, "/in", "/r", datetime.date(2026, 5, 9))._root({"provider": provider, "acs_code": code}) == f"/r/{want}"
    df = spark.sql("SELECT 'hep-ex' AS category, date'2026-04-03' AS day")
    for layout, want in {"category/year/month/day": "2026/04/03.md", "year/month/day/category": "2026/04/03/hep-ex/03.md", "year/month/category/day": "2026/04/hep-ex/03/03.md", "other": "2026/04/03.md"}.items():
        assert df.select(render.day_path("/r", layout)).first()[0] == f"/r/arxiv/hep-ex/{want}"


def test_registered_parsers(spark):
    markup.register(spark)
    got = spark.sql("""SELECT inline(extract_links('<p><a href="/a">x <b>y</b></a><a>z'))""").collect()
    assert [tuple(r) for r in got] == [("/a", "x y"), ("", "z")]
    assert spark.sql("SELECT html_unescape('&eacute;&amp;')").first()[0] == "é&"
    assert spark.sql("SELECT clean_aip_abstract('<section><h2>Abstract</h2><p>We &amp; you</p><div class=\"title\">Other</div></section>')").first()[0] == "We & you Other"
