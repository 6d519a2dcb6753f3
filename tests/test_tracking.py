import datetime
import json

import pytest
from pyspark.sql import functions as F

from perusal import schemas
from perusal.operators import discover, match, records, render, resolve
from perusal.plans import incremental
from perusal.plans.tracker import Tracker
from perusal.sources import landed, sinks
from perusal.streaming import feed

DAY, TODAY = datetime.date(2026, 4, 3), datetime.date(2026, 5, 9)


def item(n, extra="", title="A <i>title</i>", abstract="Line one\nline <b>two</b>"):
    return f"""<li class="arxiv-result"><div><p class="list-title is-inline-block"><a href="https://arxiv.org/abs/{n}">arXiv:{n}</a></p>
<div class="tags"><span class="tag is-small is-link">quant-ph</span><span class="tag is-small is-grey">hep-th</span></div>
<p class="title is-5"> {title} </p><p class="authors"><span>Authors:</span><a href="#">Ada L</a>, <a href="#">Bo M</a></p>
<p class="abstract"><span class="abstract-full">{abstract}</span></p>{extra}</div>"""


EXTRA = """<div class="tag is-light is-size-7">doi<br></div><div class="is-inline-block"><span class="tag is-light is-size-7"><a href="https://doi.org/10.1103/abc">10.1103/abc</a></span></div>
<p class="comments"><span>Comments:</span> 12 pages</p><p class="comments"><span>Journal ref:</span> Phys. <i>Rev.</i> X 1</p>"""


def preprint_raw(spark, *items, day=DAY, category="quant-ph"):
    return spark.createDataFrame([(category, day, "<ol>" + "".join(items) + "</ol>")], schemas.RAW_PREPRINT)


def test_preprint_fields(spark):
    raw = preprint_raw(spark, item("2604.00001", EXTRA), '<li class="arxiv-result"><p class="title">none</p>', item("2604.00002", abstract=""), item("2604.00001", title="Again"))
    got = {r.arxiv_id: r for r in records.preprints(raw).collect()}
    a = got["arXiv:2604.00001"]
    assert len(got) == 2 and a.pos == 0 and a.title == "Again" and a.external_doi == "" and a.authors == ["Ada L", "Bo M"]  # first place, last values
    b = records.preprints(preprint_raw(spark, item("2604.00001", EXTRA))).first()
    assert (b.title, b.external_doi, b.external_doi_url, b.comments, b.journal_ref) == ("A title", "10.1103/abc", "https://doi.org/10.1103/abc", "12 pages", "Phys. Rev. X 1")
    assert b.subjects == ["quant-ph", "hep-th"] and b.abstract == "Line one\nline two"


def test_cap(spark):
    rows = spark.range(10).withColumn("k", F.col("id") % 2)
    assert {r.id for r in records.capped(rows, ["k"], ["id"], 2).collect()} == {0, 1, 2, 3}


def registry(spark, *pages, issn="0021-9606", year=2026):
    rows = [(issn, year, i, json.dumps({"message": {"items": items, "next-cursor": cursor}}) if items is not None else "not json") for i, (items, cursor) in enumerate(pages)]
    return spark.createDataFrame(rows, schemas.RAW_REGISTRY)


def work(doi, volume="164", issue="16", page="5-9", title="T", **more):
    return {"DOI": doi, "title": [title], "volume": volume, "issue": issue, "page": page} | more


def test_registry_pages_and_articles(spark):
    raw = registry(
        spark, ([work("10.1/b", page="20-25"), work("10.1021/ctv021i005"), work("10.1/e", title=" erratum: x")], "c1"),
        ([work("10.1/a", page="3-4", author=[{"given": "Ada", "family": "L"}, {"family": "Solo"}, {"name": "Org"}], abstract="<jats:p>x &lt;y&gt;</jats:p>", **{"published-print": {"date-parts": [[2026, 4]]}, "published-online": {"date-parts": [[2026, 1, 2]]}})], "c1"),
        ([work("10.1/late")], "c2"), (None, ""),
    )
    got = [r for r in records.registry_articles(raw).orderBy("pos").collect()]
    assert [(r.doi, r.pos) for r in got] == [("10.1/a", 1), ("10.1/b", 2)]  # a repeated cursor ends the pages; order of start page
    assert got[0].authors == ["Ada L", "Solo"] and got[0].abstract == "x <y>" and got[0].date == "2026-4" and got[1].authors == []
    empty = registry(spark, ([], "c"), ([work("10.1/x")], "d"))
    assert records.registry_articles(empty).count() == 0


def test_start_page(spark):
    rows = {"12-15": 12, "A12": 0, "7–9": 0, "": 0, None: 0, " 8 -9": 8}
    df = spark.createDataFrame([(k,) for k in rows], "p string").select("p", records.start_page(F.col("p")).alias("s"))
    assert {r.p: r.s for r in df.collect()} == rows


AIP = """<div class="al-article-items"><h5 class="item-title"><a href="/aip/jcp/article/164/16/164101/1/Some">Some <i>X</i></a></h5>
<div class="al-authors-list"><span class="wi-fullname"><a>Ada L</a></span><span class="wi-fullname"> </span></div><span class="ww-citation-primary"><em>J. Chem. Phys.</em> 164, 164101 (2026)</span>
<div class="citation-label"><a href="https://doi.org/10.1063/5.1">https://doi.org/10.1063/5.1</a></div><div class="issue-featured-image"><img data-src="/i.png"></div><a class="js-show-abstract" data-articleid="77">Abstract</a></div>
<div class="al-article-items"><h5 class="item-title"><a href="/aip/jcp/article/164/16/164102/2/Other">Other</a></h5><a data-doi=" 10.1063/5.2 ">pdf</a></div>
<div class="al-article-items"><h5 class="item-title"><a href="/x">No doi</a></h5></div><div class="al-article-items"><h5 class="item-title"><a href="/x">Erratum: y</a></h5><a data-doi="10.1063/5.3"></a></div>"""


def aip(spark, html=AIP, url="https://pubs.aip.org/aip/jcp/issue/164/16"):
    return spark.createDataFrame([("jcp", "164", "16", url, html)], schemas.RAW_AIP_TOC)


def test_aip_contents_and_abstracts(spark):
    got = {r.doi: r for r in records.aip_articles(aip(spark)).collect()}
    a, b = got["10.1063/5.1"], got["10.1063/5.2"]
    assert set(got) == {"10.1063/5.1", "10.1063/5.2"} and a.title == "Some X" and a.authors == ["Ada L"] and a.article_id == "77"
    assert (a.item_volume, a.item_issue, a.pages, a.date, a.toc_image_url) == ("164", "16", "164101", "2026", "/i.png") and (b.item_volume, b.item_issue, b.pages, b.date) == ("164", "16", "164102", "")
    assert records.aip_articles(aip(spark, "<p>Just a moment")).count() == 0
    other = aip(spark, AIP.replace("Some", "Shape"), "https://pubs.aip.org/jcp/issue/164/16").union(aip(spark))
    assert {r.title for r in records.aip_articles(other).collect()} == {"Some X", "Other"}
    body = lambda ok, h: json.dumps({"Success": ok, "Html": h})
    rows = [("77", 0, 200, body(False, "no")), ("77", 1, 200, body(True, "")), ("77", 2, 403, body(True, "no")), ("77", 3, 200, body(True, "<h2>Abstract</h2><p>We  show</p>")), ("77", 4, 200, body(True, "later"))]
    assert [tuple(r) for r in records.aip_abstracts(spark.createDataFrame(rows, schemas.RAW_AIP_ABSTRACT)).collect()] == [("77", "We show")]


ACS = """<div class="issue-item clearfix"><h3 class="issue-item_title"><a href="/doi/10.1021/acs.jctc.1">First one</a></h3><span class="hlFld-ContribAuthor"><given-names>Ada</given-names> <surname>L</surname></span>
<span class="hlFld-Abstract">An abstract</span><div class="issue-item_img"><img class="lazy" data-src="/cms/a.gif"></div>
<div class="issue-item_info"><span class="issue-item_vol-num">22</span>, 7, 3001–3010 (Article) Publication Date (Web): March 26, 2026</div></div>
<div class="issue-item clearfix"><h4 class="issue-item_title"><a href="/doi/10.1021/acs.jctc.2">Second</a></h4><div class="issue-item_info">No. 9, Print: soon</div></div>
<div class="issue-item clearfix"><h3 class="issue-item_title"><a href="/doi/10.1021/x">Masthead</a></h3><p>Editorial Masthead</p></div><div class="issue-item clearfix"><h3 class="issue-item_title"><a href="/doi/10.9/x">No</a></h3></div>"""


def test_acs_contents(spark):
    raw = spark.createDataFrame([("jctcce", "22", "7", ACS)], schemas.RAW_ACS_TOC)
    a, b = records.acs_articles(raw).orderBy("pos").collect()
    assert (a.doi, a.title, a.authors, a.abstract, a.toc_image_url) == ("10.1021/acs.jctc.1", "First one", ["Ada L"], "An abstract", "https://pubs.acs.org/cms/a.gif")
    assert (a.item_volume, a.item_issue, a.pages, a.date) == ("22", "7", "3001–3010", "2026-03-26") and (b.item_volume, b.item_issue, b.date, b.authors) == ("", "9", "soon", [])


def test_challenges_are_told_by_their_own_marks(spark):
    acs = lambda html: records.acs_articles(spark.createDataFrame([("jctcce", "22", "7", html)], schemas.RAW_ACS_TOC)).count()
    assert acs(ACS + "<p>Cloudflare cf-chl</p>") == 2 and acs(ACS + "x" * 6000 + "Just a moment") == 0
    assert records.aip_articles(aip(spark, "<p>cf-chl</p>" + AIP)).count() == 0 and records.aip_articles(aip(spark, AIP + "x" * 6000 + "Cloudflare")).count() == 2
    assert records.preprints(preprint_raw(spark, "<h1>Just a moment: Cloudflare</h1>", item("2604.00001"))).count() == 1


def test_registry_abstracts_decode_every_entity(spark):
    raw = registry(spark, ([work("10.1/a", abstract="<jats:p>&alpha;-H&#8322;O &#x2013; 5&deg; caf&eacute; a &le; b &amp;lt;</jats:p>")], ""))
    assert records.registry_articles(raw).first().abstract == "α-H₂O – 5° café a ≤ b &lt;"


def lists(spark, groups=True):
    landing = '<a href="/toc/jctcce/22/8">n</a><a href="/toc/jctcce/0/0">asap</a><a href="/toc/jctcce/22/9">m</a>' + ('<a href="/loi/jctcce/group/d2020.y2026">g</a><a href="/loi/jctcce/group/d2020.y2025">g</a><a href="/loi/jctcce/group/d2020.y2025">g</a>' if groups else "")
    rows = [("jctcce", "/loi/jctcce", True, landing), ("jctcce", "/loi/jctcce/group/d2020.y2025", False, '<a href="/toc/jctcce/21/1">a</a><a href="https://pubs.acs.org/toc/jctcce/21/2">b</a>'), ("jctcce", "/loi/jctcce/group/d2020.y2026", False, '<a href="/toc/jctcce/22/8?x">dup</a>')]
    return spark.createDataFrame(rows, schemas.RAW_ACS_LIST)


def test_discovery(spark):
    get = lambda **k: [tuple(r) for r in discover.acs_issues(lists(spark), "jctcce", TODAY, **k).collect()]
    assert get() == [(22, 9, "/toc/jctcce/22/9"), (22, 8, "/toc/jctcce/22/8"), (21, 1, "/toc/jctcce/21/1")]
    assert [r[:2] for r in get(from_year=2026)] == [(22, 9), (22, 8)] and get(from_year=2027) == []
    assert discover.acs_issues(lists(spark, False), "jctcce", TODAY).count() == 0
    assert tuple(discover.acs_latest(lists(spark), "jctcce").first()) == (22, 8, "/toc/jctcce/22/8")
    raw = registry(spark, ([work("10.1/a"), work("10.1/b", issue="S1"), work("10.1/c", volume=None), work("10.1/d", issue="2")], "")).union(registry(spark, ([work("10.1/z", issue="2")], ""), year=2025))
    got = [tuple(r) for r in discover.registry_issues(records.registry_items(raw), "0021-9606", TODAY).collect()]
    assert got == [(2026, 164, 16), (2025, 164, 2)]
    assert [tuple(r) for r in discover.registry_issues(records.registry_items(raw), "0021-9606", TODAY, 2026).collect()] == [(2026, 164, 16), (2026, 164, 2)]


def library(spark, *rows):
    return match.library_keys(spark.createDataFrame([(k, p, (d, u)) for k, p, d, u in rows], schemas.RAW_LIBRARY))


def test_library_and_layers(spark):
    lib = library(spark, ("A", None, "10.48550/arXiv.1.1", ""), ("B", "", "10.1/pub", None), ("C", None, "", "https://arxiv.org/abs/3.3v2"), ("D", "A", "10.1/child", ""), ("E", None, "", ""), ("F", None, "10.1/pub", ""))
    assert {(r.kind, r.value): r.item_key for r in lib.collect()} == {("doi", "10.48550/arXiv.1.1"): "A", ("doi", "10.1/pub"): "F", ("arxiv", "3.3"): "C"}
    df = spark.createDataFrame([("arXiv:1.1", ""), ("arXiv:2.2", "10.1/pub"), ("arXiv:3.3", ""), ("arXiv:4.4", "10.1/child"), ("arXiv:5.5", "")], "arxiv_id string, external_doi string")
    got = {r.arxiv_id: r.collected for r in match.preprints_collected(df, lib).collect()}
    assert got == {"arXiv:1.1": True, "arXiv:2.2": True, "arXiv:3.3": True, "arXiv:4.4": False, "arXiv:5.5": False}
    assert not any(r.collected for r in match.preprints_collected(df, lib.limit(0)).collect())
    plan = match.preprints_collected(df, lib)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    dois = spark.createDataFrame([("10.1/PUB",), ("10.1/pub",), ("",)], "doi string")
    assert [r.collected for r in match.articles_collected(dois, lib).orderBy("doi").collect()] == [False, False, True]
    assert [r.collected for r in match.articles_collected(dois, lib, ignore_case=True).orderBy("doi").collect()] == [False, True, True]


def paper(spark, *rows):
    return spark.createDataFrame([("quant-ph", DAY, p, i, t, a, ab, c) for p, (i, t, a, ab, c) in enumerate(rows)], "category string, day date, pos int, arxiv_id string, title string, authors array<string>, abstract string, collected boolean")


def test_day_report_bytes(spark):
    rows = paper(spark, ("arXiv:1.1", "T", ["A", "B"], "x\n[[y]]", True), ("arXiv:2.2", "U", [], "", False))
    news = rows.filter("arxiv_id = 'arXiv:2.2'")
    want = "# 2026-04-03 preprint by arxiv_tools\n\n\n---\ntags:\n  - #quant-ph-2026-04-03\n---\n\n\n```dataview\nTASK\nfrom #quant-ph-2026-04-03\n\nWHERE completed\n\n```\n\n## collected\n\n"
    want += "\n### arXiv:1.1\n\nLinks:\n\n- [ ] [arXiv:1.1](https://arxiv.org/abs/1.1)\n\nTitle:  T\n\nAuthors:  A, B\n\nAbstract:\n> [!quote]- Abstract\n\n> x\n> $[[y]]$\n\n\n## not collected\n\n"
    want += "\n### arXiv:2.2\n\nLinks:\n\n- [ ] [arXiv:2.2](https://arxiv.org/abs/2.2)\n\nTitle:  U\n\nAuthors:  \n\nAbstract:\n> [!quote]- Abstract\n\n> \n\n"
    assert render.day_reports(rows).first().md == want
    md = render.day_reports(rows, news)
    assert md.first().md == want + "\n## update\n\n\n- [ ] [[#arXiv:2.2]]\n"
    back = match.report_entries(md).orderBy("pos").collect()
    assert [(r.arxiv_id, r.title, r.authors, r.abstract) for r in back] == [("arXiv:1.1", "T", ["A", "B"], "x\n $[[y]]$"), ("arXiv:2.2", "U", ["Abstract:"], "")] or back[0].arxiv_id == "arXiv:1.1"


def test_issue_report_bytes(spark):
    rows = spark.createDataFrame([("jcp", "J", 2026, "1", "2", 0, "10.1/a", "T", ["A"], "", "", "", False), ("jcp", "J", 2026, "1", "2", 1, "10.1/b", "U", ["B"], "z", "2026-01-01", "http://i", True)], "slug string, journal_name string, year int, volume string, issue string, pos int, doi string, title string, authors array<string>, abstract string, date string, toc_image_url string, collected boolean")
    md = render.issue_reports(rows).first().md
    assert md.startswith("# J Vol. 1, Iss. 2 — 2026\n\n---\ntags:\n  - #jcp-v1-i2\n---\n\n```dataview\nTASK\nfrom #jcp-v1-i2\n\nWHERE completed\n\n```\n\n## collected\n\n\n### 10.1/b\n")
    assert "Title:  U\n\n\n![|700](http://i)\n\nAuthors:  B\n\n\nAbstract:\n> [!quote]- Abstract\n\n> z\n\n\n## not collected" in md and md.endswith("Title:  T\n\n\nAuthors:  A\n\n")


def test_report_ids(spark):
    ok = "## collected\n### arXiv:1.1\n## not collected\n###  arXiv:2.2\n- [x] [[#arXiv:3.3]]\n- [ ] [[#arXiv:4.4]]"
    rows = spark.createDataFrame([("a", ok), ("b", "## collected\n### arXiv:1.1"), ("c", ok.replace("arXiv:", "10."))], "path string, md string")
    got = {r.path: (r.ids, r.ok) for r in match.report_ids(rows).collect()}
    assert got["a"] == (["arXiv:1.1", "arXiv:2.2", "arXiv:3.3"], True) and got["b"] == (None, False)
    assert {r.path: r.ids for r in match.report_ids(rows, "doi").collect()}["c"] == ["10.1.1", "10.2.2", "10.3.3"]


def test_prefer_and_fill(spark):
    mk = lambda *r: spark.createDataFrame(r, "k int, pos int, doi string, abstract string")
    got = resolve.prefer([mk((1, 0, "a", "")), mk((1, 0, "b", ""), (2, 0, "c", "")), mk((2, 1, "d", ""), (3, 0, "e", ""))], ["k"])
    assert {(r.k, r.doi) for r in got.collect()} == {(1, "a"), (2, "c"), (3, "e")}
    filled = resolve.fill_abstracts(mk((1, 0, "a", ""), (1, 1, "b", "own"), (1, 2, "c", "")), mk((0, 5, "a", "late"), (0, 2, "a", "first"), (0, 1, "a", ""), (0, 0, "b", "other"), (0, 0, "z", "no")))
    assert {r.doi: r.abstract for r in filled.collect()} == {"a": "first", "b": "own", "c": ""}
    dated = spark.createDataFrame([("1", 0, ""), ("1", 1, "soon"), ("1", 2, "2024-3"), ("1", 3, "2020"), ("2", 0, "x")], "issue string, pos int, date string")
    assert {r.issue: r.year for r in resolve.issue_year(dated, ["issue"], TODAY).collect()} == {"1": 2024, "2": 2026}


@pytest.mark.parametrize(
    ("processed", "valid", "found", "backfill", "want"),
    [
        ([(164, 16)], [], [(164, 16)], False, [(164, 16)]), ([(163, 24), (164, 16)], [(164, 16)], [(164, 16)], False, [(163, 24)]), ([(164, 16)], [(164, 16)], [(164, 16)], False, []),
        ([(164, 15)], [(164, 15)], [(164, 16), (164, 15)], False, [(164, 16)]), ([], [], [(1, 1), (1, 2), (2, 1)], True, [(1, 1), (1, 2), (2, 1)]), ([(164, 16)], [(164, 16)], [], False, []),
    ],
)
def test_plan_algebra(spark, processed, valid, found, backfill, want):
    mk = lambda rows: spark.createDataFrame([("j", *r) for r in rows], schemas.PROCESSED)
    chosen = incremental.candidates(mk(found), backfill, ["volume", "issue"])
    again, new = incremental.rebuild(mk(processed), mk(valid)), incremental.todo(chosen, mk(processed))
    assert sorted((r.volume, r.issue) for r in again.union(new.select(again.columns)).collect()) == want
    assert {(r.volume, r.issue) for r in incremental.next_state(mk(processed), new).collect()} == set(processed) | {w for w in want if w not in processed}


def land(spark, root, **tables):
    for name, df in tables.items():
        df.write.mode("append").parquet(f"{root}/{name}")


def test_end_to_end(spark, tmp_path):
    src, out = f"{tmp_path}/landed", f"{tmp_path}/out"
    land(spark, src, raw_arxiv=preprint_raw(spark, item("2604.00001"), item("2604.00002")), raw_library=spark.createDataFrame([("A", None, ("10.48550/arXiv.2604.00001", ""))], schemas.RAW_LIBRARY))
    land(spark, src, raw_aip_toc=aip(spark), raw_aip_abstract=spark.createDataFrame([("77", 0, 200, json.dumps({"Success": True, "Html": "<p>Side</p>"}))], schemas.RAW_AIP_ABSTRACT), raw_crossref=registry(spark, ([work("10.1063/5.2", abstract="Filled"), work("10.1063/5.9"), work("10.1063/7", issue="15")], "")))
    t = Tracker(spark, src, out, TODAY)
    assert sinks.write_reports(t.daily_report(["quant-ph"], ["2026.04"])) == 1
    path = tmp_path / "out/arxiv/quant-ph/2026/04/03.md"
    first = path.read_text()
    assert "## update" not in first and first.index("2604.00001") < first.index("## not collected") < first.index("2604.00002")
    sinks.write_reports(t.daily_report(["quant-ph"], ["2026.04"]))
    assert path.read_text() == first
    land(spark, src, raw_arxiv=preprint_raw(spark, item("2604.00003")))
    sinks.write_reports(t.daily_report(["quant-ph"], ["2026.04"]))
    assert path.read_text().endswith("## update\n\n\n- [ ] [[#arXiv:2604.00003]]\n")
    with pytest.raises(RuntimeError):
        t.daily_report(["quant-ph", " hep-ex"], ["2026.04"])
    # an issue: the publisher's page with abstracts of the side table and the registry, never the registry's extra articles
    md = t.issue_report("jcp", "164", "16").first().md
    assert "> Side" in md and "> Filled" in md and "10.1063/5.9" not in md
    assert "10.1063/7" in t.issue_report("jcp", "164", "15", 2026).first().md and t.issue_report("jcp", "1", "1").count() == 0
    # latest only, then all; a broken report is built again
    assert t.run_auto("jcp") == 1 and t.run_auto("jcp") == 0 and t.run_auto("jcp", backfill=True) == 1
    assert {(r.volume, r.issue) for r in landed.state(spark, t.state_path()).collect()} == {(164, 16), (164, 15)}
    (tmp_path / "out/aip/jcp/164/15.md").write_text("broken")
    assert t.run_auto("jcp") == 1 and "10.1063/7" in (tmp_path / "out/aip/jcp/164/15.md").read_text()
    text = sinks.state_as_json(landed.state(spark, t.state_path())).first().json
    assert json.loads(text) == {"jcp": {"processed": [[164, 15], [164, 16]]}}
    (tmp_path / "s.json").write_text(text)
    assert landed.state_json(spark, f"{tmp_path}/s.json").count() == 2


def test_backfill_goes_on_after_a_failed_write(spark, tmp_path, monkeypatch):
    src, out = f"{tmp_path}/landed", f"{tmp_path}/out"
    land(spark, src, raw_crossref=registry(spark, ([work(f"10.1063/{i}", issue=str(i)) for i in range(1, 6)], "")))
    t = Tracker(spark, src, out, TODAY)
    t.BATCH, write, calls = 2, sinks.write_reports, []

    def failing(df):
        calls.append(1)
        if len(calls) == 2:
            write(df.limit(1))
            raise OSError("full")
        return write(df)

    monkeypatch.setattr(sinks, "write_reports", failing)
    done = lambda: sorted(r.issue for r in landed.state(spark, t.state_path()).collect())
    with pytest.raises(OSError):
        t.run_auto("jcp", backfill=True)
    assert done() == [1, 2] and not list((tmp_path / "out").glob(".batch-*"))
    (tmp_path / "out/state/version-7").mkdir()  # a version that a crash left unfinished doesn't count
    assert done() == [1, 2]
    assert t.run_auto("jcp", backfill=True) == 3 and done() == [1, 2, 3, 4, 5] and t.run_auto("jcp", backfill=True) == 0
    assert sorted(p.name for p in (tmp_path / "out/aip/jcp/164").glob("*.md")) == [f"{i}.md" for i in range(1, 6)]


def test_search_requests_and_cap(spark, tmp_path, caplog):
    t = Tracker(spark, f"{tmp_path}/landed", f"{tmp_path}/out", TODAY)
    rows = t.search_requests(["quant-ph", "chem-ph"], ["2026.04"]).orderBy("day", "category").collect()
    assert len(rows) == 60 and rows[1].url.startswith("https://arxiv.org/search/advanced?advanced=&terms-0-term=") and "date-from_date=2026-04-01&date-to_date=2026-04-02" in rows[1].url and "classification-physics_archives=quant-ph" in rows[1].url
    land(spark, f"{tmp_path}/landed", raw_arxiv=preprint_raw(spark, item("2604.00001"), item("2604.00002")))
    with caplog.at_level("WARNING"):
        md = t.daily_report(["quant-ph"], ["2026.04"], cap=1).first().md
    assert "2604.00001" in md and "2604.00002" not in md and "2 preprints" in caplog.text


def test_streaming_matches_batch(spark, tmp_path):
    src, out = f"{tmp_path}/landed", f"{tmp_path}/out"
    land(spark, src, raw_arxiv=preprint_raw(spark, item("2604.00001")))
    t = Tracker(spark, src, out, TODAY)
    feed.track(spark, t, f"{tmp_path}/checkpoint")
    path = tmp_path / "out/arxiv/quant-ph/2026/04/03.md"
    assert "2604.00001" in path.read_text()
    land(spark, src, raw_arxiv=preprint_raw(spark, item("2604.00002")))
    feed.track(spark, t, f"{tmp_path}/checkpoint")
    assert path.read_text().endswith("- [ ] [[#arXiv:2604.00002]]\n")


def test_unknown_journal(spark, tmp_path):
    with pytest.raises(RuntimeError, match="jctc"):
        Tracker(spark, str(tmp_path), str(tmp_path), TODAY).issue_report("nope", "1", "1")
