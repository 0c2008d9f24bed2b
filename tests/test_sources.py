import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.operators import merge as M
from vellum.sources import archives, listing, patent_xml, titles
from vellum.streaming import ingest

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'
XML = HEAD + """<business:PatentDocumentAndRelated xmlns:business="urn:b" xmlns:base="urn:c" country="CN" docNumber="{n}" kind="{kind}" datePublication="20231003" status="C" lang="zh" file="f.XML">
 <business:BibliographicData>
  <business:PublicationReference><base:DocumentID><base:WIPOST3Code>CN</base:WIPOST3Code><base:DocNumber>P{n}</base:DocNumber><base:Date>20231002</base:Date></base:DocumentID></business:PublicationReference>
  <business:RelatedDocuments><business:RelatedPublicationDoc><base:DocumentID><base:Date>bad</base:Date></base:DocumentID></business:RelatedPublicationDoc><business:RelatedPublicationDoc><base:DocumentID><base:Date>20170111</base:Date></base:DocumentID></business:RelatedPublicationDoc></business:RelatedDocuments>
  <business:ApplicationReference applType="10"><base:DocumentID><base:WIPOST3Code>CN</base:WIPOST3Code><base:DocNumber>2015</base:DocNumber><base:Date>20150102</base:Date></base:DocumentID></business:ApplicationReference>
  <business:PriorityDetails>
   <business:Priority kind="international" dataFormat="original" sourceDB="office" sequence="1"><base:WIPOST3Code>JP</base:WIPOST3Code><base:DocNumber>10-1</base:DocNumber><base:Date>20140810</base:Date></business:Priority>
   <business:Priority kind="national"/>
  </business:PriorityDetails>
  <business:ClassificationIPCRDetails><business:ClassificationIPCR><base:Text>H01M  10/05(2010.01)I</base:Text></business:ClassificationIPCR><business:ClassificationIPCR><base:Text>B60K 1/00 (2006.01)</base:Text></business:ClassificationIPCR></business:ClassificationIPCRDetails>
  <business:InventionTitle> 电池 </business:InventionTitle>
  <business:Parties>
   <business:ApplicantDetails>
    <business:Applicant><base:AddressBook><base:Name>甲公司</base:Name><base:Address><base:Text>路1号</base:Text><base:Province>广东</base:Province><base:WIPOST3Code>CN</base:WIPOST3Code></base:Address></base:AddressBook></business:Applicant>
    <business:Applicant><base:AddressBook><base:Name>乙公司</base:Name></base:AddressBook></business:Applicant>
    <business:Applicant>丙公司</business:Applicant>
   </business:ApplicantDetails>
   <business:InventorDetails><business:Inventor><base:AddressBook><base:Name>张三</base:Name></base:AddressBook></business:Inventor></business:InventorDetails>
   <business:AgentDetails>
    <business:Agent><base:AddressBook><base:Name>李四</base:Name></base:AddressBook><base:Agency><base:AddressBook><base:OrganizationName>代理 12</base:OrganizationName></base:AddressBook></base:Agency></business:Agent>
    <business:Agent><base:AddressBook><base:Name>王五</base:Name></base:AddressBook></business:Agent>
   </business:AgentDetails>
  </business:Parties>
  <business:AssigneeDetails><business:Assignee><base:AddressBook><base:Name>甲公司</base:Name></base:AddressBook></business:Assignee></business:AssigneeDetails>
  <business:ExaminerDetails><business:Examiner><base:Name>审查</base:Name></business:Examiner><business:Examiner>二审</business:Examiner></business:ExaminerDetails>
  <business:ReferencesCited><business:Citation><business:ApplicationCitation><business:PublicationReference><base:DocumentID><base:WIPOST3Code>TW</base:WIPOST3Code><base:DocNumber>9</base:DocNumber><base:Kind>A1</base:Kind><base:Date>20131009</base:Date></base:DocumentID></business:PublicationReference></business:ApplicationCitation></business:Citation><business:Citation/></business:ReferencesCited>
 </business:BibliographicData>
 <business:Abstract><base:Paragraphs>摘要 x &lt; 5 &amp; y</base:Paragraphs><business:AbstractFigure><business:Figure><base:Image file="abs.JPG"/></business:Figure></business:AbstractFigure></business:Abstract>
 <business:Description>
  <business:TechnicalField title="t"><base:Paragraphs num="0001">领域H<base:sub>2</base:sub>O。</base:Paragraphs></business:TechnicalField>
  <business:BackgroundArt><business:Part><base:Paragraphs>见CN102030405A和公开号：CN201510145456.1。</base:Paragraphs></business:Part><base:Paragraphs><base:b>粗</base:b><base:b>体</base:b></base:Paragraphs></business:BackgroundArt>
  <business:Disclosure><base:Paragraphs>发明内容</base:Paragraphs><base:Paragraphs>本发明所要解决的技术问题是电池。</base:Paragraphs><base:Paragraphs>采用如下技术方案：甲。</base:Paragraphs><base:Paragraphs>乙，专利号 20201234567。</base:Paragraphs><base:Paragraphs>有益效果：好。</base:Paragraphs></business:Disclosure>
  <business:DrawingsDescription><base:Paragraphs>图1<base:Image file="none.png"/></base:Paragraphs></business:DrawingsDescription>
  <business:InventionMode><base:Paragraphs>如式<base:Image id="1" file="form.webp"/><base:Image file="two.tif"/></base:Paragraphs><base:Paragraphs>又<base:Image file="form.webp"/><base:Image file="x.txt"/></base:Paragraphs></business:InventionMode>
 </business:Description>
 <business:Claims><business:Claim num="1"><business:ClaimText>一种电池。</business:ClaimText><business:ClaimText>其特征在于甲。</business:ClaimText></business:Claim><business:Claim/><business:Claim><business:ClaimText>根据权利要求1所述的电池。</business:ClaimText></business:Claim></business:Claims>
 <business:Drawings><business:Figure num="0001" figureLabels="图1"><base:Image file="1.TIF"/></business:Figure><business:Figure num="0002"><base:Image file="2.PNG"/></business:Figure><business:Figure><base:Image file="3.txt"/></business:Figure></business:Drawings>
</business:PatentDocumentAndRelated>"""
OLD = """<patent-document kind="B"><bibliographic-data>
 <invention-title>Old patent</invention-title>
 <publication-reference><document-id><doc-number>CN77B</doc-number><date>20240203</date></document-id></publication-reference>
 <application-reference><document-id><doc-number>CN2099</doc-number><date>20230115</date></document-id></application-reference>
 <parties><applicants><applicant>Old applicant</applicant><applicant><name>Second</name></applicant></applicants><inventors><inventor>Old inventor</inventor></inventors><agents><agent>Old agent</agent></agents></parties>
 <classification-ipc><main-classification>H04L 12/58</main-classification></classification-ipc>
 <abstract>Old abstract</abstract>
</bibliographic-data><agency>Old agency</agency><claims>Old claim</claims></patent-document>"""


@pytest.fixture
def batch(tmp_path):
    with zipfile.ZipFile(tmp_path / "A.ZIP".lower(), "w") as z:
        z.writestr("d/1.XML", XML.format(n="100", kind="B"))
        z.writestr("d/2.xml", XML.format(n="200", kind="U"))
        z.writestr("d/3.xml", "no xml")
        z.writestr("d/x.jpg", b"x")
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    return str(tmp_path)


def test_archives_and_patents(spark, batch):
    rows = archives.entries(spark, batch)
    assert sorted((r.zip_name, r.processed, r.skipped) for r in archives.counts(rows).collect()) == [("a.zip", 3, 0), ("bad.zip", 0, 1)]
    found = {r.doc_number: r for r in patent_xml.parsed(rows.where("error is null"), keep=("zip_name",)).collect()}
    assert set(found) == {"100", "200"}
    b = found["100"]
    assert (b.title, b.kind, b.pub_date, b.grant_date, b.app_date, b.zip_name) == ("电池", "B", "2017-01-11", "2023-10-03", "2015-01-02", "a.zip")
    assert (found["200"].pub_date, found["200"].grant_date) == (None, "2023-10-03")
    children = patent_xml.child_table(patent_xml.parsed(rows.where("error is null")), "applicants")
    assert children.count() == 6 and children.columns[:2] == ["patent_id", "name"]


def test_archives_within_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("1.xml", "<a/>")
    with zipfile.ZipFile(tmp_path / "OUTER.ZIP", "w") as z:
        z.writestr("in/INNER.ZIP", inner.getvalue())
        z.writestr("bad.zip", b"nothing")
        z.writestr("2.xml", "<b/>")
    (tmp_path / "3.xml.gz").write_bytes(gzip.compress(b"<c/>"))
    (tmp_path / "packed.zip.gz").write_bytes(gzip.compress(inner.getvalue()))
    (tmp_path / "broken.gz").write_bytes(b"no gzip")
    rows = archives.entries(spark, str(tmp_path)).collect()
    assert sorted((r.zip_name, str(r.entry_name), r.content and bytes(r.content)) for r in rows if not r.error) == [("3.xml.gz", "3.xml", b"<c/>"), ("INNER.ZIP", "1.xml", b"<a/>"), ("OUTER.ZIP", "2.xml", b"<b/>"), ("packed.zip", "1.xml", b"<a/>")]
    assert sorted(r.zip_name for r in rows if r.error) == ["bad.zip"]


def test_parsed_patents_are_scanned(spark, tmp_path):
    found = patent_xml.parsed(spark.createDataFrame([(XML.format(n="100", kind="B"),)], "content string"))
    found.write.json(str(tmp_path / "parsed"))
    again = patent_xml.scan(spark, str(tmp_path / "parsed"))
    assert again.dtypes == found.dtypes and again.first().claims == found.first().claims


def parse(spark, *documents, **options):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(documents)], "i int, content string")
    return {r.i: r for r in patent_xml.parsed(rows, keep=("i",), **options).collect()}


def test_every_field_of_a_patent(spark):
    b = parse(spark, XML.format(n="100", kind="B"))[0]
    assert (b.doc_number, b.pub_number, b.grant_number, b.app_number, b.app_country, b.app_type, b.pub_country, b.status, b.lang, b.source_file) == ("100", "P100", "P100", "2015", "CN", "10", "CN", "C", "zh", "f.XML")
    assert (b.abstract, b.abstract_figure) == ("摘要 x < 5 & y", "abs.JPG")
    assert [tuple(a)[:4] for a in b.applicants] == [("甲公司", "路1号", "广东", None), ("乙公司", None, None, None), ("丙公司", None, None, None)]
    assert b.applicants[0].country == "CN" and b.applicant == "甲公司; 乙公司; 丙公司"
    assert (b.inventors, b.inventor, [a.name for a in b.assignees], b.examiners) == (["张三"], "张三", ["甲公司"], ["审查", "二审"])
    assert [tuple(a) for a in b.agents] == [("代理 12", "李四"), (None, "王五")] and (b.agent, b.agency) == ("李四; 王五", "代理 12")
    assert [tuple(c) for c in b.citations] == [("TW", "9", "A1", "2013-10-09")]
    assert [tuple(p) for p in b.priorities] == [("JP", "10-1", "2014-08-10", "international", "original", "office", "1")]
    assert [tuple(c) for c in b.ipc] == [("H01M  10/05(2010.01)I", "H01M10/05I"), ("B60K 1/00 (2006.01)", "B60K1/00")]
    assert [tuple(c) for c in b.claims] == [("1", 1, "一种电池。\n其特征在于甲。", True), ("0003", 2, "根据权利要求1所述的电池。", False)]
    assert (b.claims_text, b.claim_count, b.independent_claim_count) == ("一种电池。 其特征在于甲。\n根据权利要求1所述的电池。", 2, 1)
    assert (b.technical_field, b.background_art) == ("领域HO。", "见CN102030405A和公开号：CN201510145456.1。\n粗 体")
    assert b.technical_problem == "本发明所要解决的技术问题是电池。"
    assert b.technical_solution == "采用如下技术方案：甲。\n乙，专利号 20201234567。" and b.beneficial_effect == "有益效果：好。"
    assert b.embodiment == "如式\n[[PATENT_IMAGE:form.webp]]\n[[PATENT_IMAGE:two.tif]]\n又\n[[PATENT_IMAGE:form.webp]]"
    assert b.drawings_description == "图1\n[[PATENT_IMAGE:none.png]]" and b.description.startswith(b.technical_field + "\n\n" + b.background_art)
    assert b.referenced_documents == ["CN201510145456.1", "CN102030405", "20201234567"]
    assert [tuple(r) for r in b.image_references] == [("1.TIF", "drawing", "图1", None), ("2.PNG", "drawing", "0002", None), ("form.webp", "inline", None, "InventionMode"), ("two.tif", "inline", None, "InventionMode")]
    assert b.image_files == ["1.TIF", "2.PNG", "form.webp", "two.tif"]


def test_dates_by_kind(spark):
    plain = '<PatentDocumentAndRelated kind="{}" docNumber="N1"><BibliographicData><PublicationReference><DocumentID><DocNumber>N1</DocNumber><Date>20240102</Date></DocumentID></PublicationReference></BibliographicData></PatentDocumentAndRelated>'
    got = parse(spark, *[plain.format(k) for k in "ABU"], XML.format(n="1", kind="A"))
    assert [(r.pub_date, r.grant_number, r.grant_date) for _, r in sorted(got.items())] == [("2024-01-02", None, None), (None, "N1", "2024-01-02"), (None, "N1", "2024-01-02"), ("2023-10-02", None, None)]
    rows = spark.createDataFrame([(plain.format(""), "utility_model"), (plain.format(""), "invention_application")], "content string, asked string")
    assert sorted(str((r.pub_date, r.grant_date)) for r in patent_xml.parsed(rows, patent_type="asked").collect()) == ["('2024-01-02', None)", "(None, '2024-01-02')"]


def test_the_older_vocabulary(spark):
    o = parse(spark, OLD)[0]
    assert (o.doc_number, o.title, o.abstract, o.claims_text, o.applicant, o.inventor, o.agent, o.agency) == ("CN77B", "Old patent", "Old abstract", "Old claim", "Old applicant; Second", "Old inventor", "Old agent", "Old agency")
    assert (o.app_number, o.app_date, o.pub_date, o.grant_number, o.grant_date) == ("CN2099", "2023-01-15", None, "CN77B", "2024-02-03")
    assert [tuple(c) for c in o.ipc] == [("H04L 12/58", "H04L12/58")] and [tuple(a) for a in o.agents] == [("Old agency", "Old agent")]
    flat = "<cn-utility-model><title>Flat</title><publication-number>U9</publication-number><agent>A1; A2</agent><agency>B1</agency><ipc>A01B 1/00</ipc><ipc>A01B 0/00</ipc><claim>one</claim><claim>two</claim></cn-utility-model>"
    f = parse(spark, flat)[0]
    assert (f.doc_number, f.title, f.claims_text, [tuple(a) for a in f.agents], [c.ipc_code for c in f.ipc]) == ("U9", "Flat", "one two", [("B1", "A1"), (None, "A2")], ["A01B 1/00", "A01B 0/00"])


def test_documents_that_give_no_row(spark):
    assert parse(spark, "no xml", "", None, "<other docNumber='1'/>", "<PatentDocumentAndRelated kind='B'/>", "<PatentDocumentAndRelated docNumber='1'>") == {}


def test_listing(spark, batch):
    assert {r.name for r in listing.files(spark, batch, "*.zip").collect()} == {"a.zip", "bad.zip"}
    names = ["S.zip", "S.z02", "S.z01", "lone.zip", "g.gz", "m.merged.zip", "q.z01", "n.txt"]
    groups = {r.base: (r.kind, r.parts) for r in listing.archive_groups(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert groups["S"] == ("split", ["S.z01", "S.z02", "S.zip"]) and groups["lone"][0] == "zip" and "q" not in groups and "m.merged" not in groups
    remote = spark.createDataFrame([("a.zip", 10), ("b.z01", 10), ("c.xml", 10), ("d.txt", 1)], "name string, size long")
    local = spark.createDataFrame([("a.zip", 10), ("b.z01", 4)], "name string, size long")
    assert {r.name: (r.state, r.done) for r in listing.download_plan(remote, local).collect()} == {"a.zip": ("skipped", 10), "b.z01": ("partial", 4), "c.xml": ("pending", 0)}


def test_titles(spark, tmp_path):
    (tmp_path / "ipc.txt").write_text("H01B0001000000\tConductors\r\n\nH\tELECTRICITY\nH01\t\n()\tx\n")
    rows = titles.two_columns(titles.lines(spark, str(tmp_path)))
    assert sorted((r.code_norm, r.level, r.title_en) for r in rows.where("error is null").collect()) == [("()", 0, "x"), ("H", 0, "ELECTRICITY"), ("H01B1/00", 3, "Conductors")]
    cpc = spark.createDataFrame([("f", 1, "H01B1/02\t1\tOf metal"), ("f", 2, "H\t\tELECTRICITY"), ("f", 3, "A01B0000020000\t\tx")], "file string, line_no int, line string")
    parsed = titles.three_columns(cpc)
    assert sorted((str(r.code_norm), r.level, r.error) for r in parsed.collect()) == [("H", 0, None), ("H01B1/02", 1, None), ("None", 0, "f:3: invalid code")]
    with pytest.raises(Exception, match="f:3: invalid code"):
        titles.checked(parsed).collect()
    with zipfile.ZipFile(tmp_path / "more.zip", "w") as z:
        z.writestr("sub/cpc.txt", "G\tPHYSICS\r\n")
    assert {r.title_en for r in titles.two_columns(titles.lines(spark, str(tmp_path))).collect()} >= {"PHYSICS", "ELECTRICITY"}


def test_stream_merges_each_file_once(spark, tmp_path):
    folder, root, state = tmp_path / "in", str(tmp_path / "out"), {}
    folder.mkdir()

    def merge(batch, number):
        old = M.read_version(spark, state["path"]) if state else batch.where("false")
        state["path"] = M.write_version(M.upserted(old, M.last_of_each(batch, ["doc_number", "kind"], F.col("ts")).drop("first_position").select(*batch.columns), ["doc_number", "kind"], ["title", "ts"]).drop("is_new"), root)

    put = lambda name, *rows: (folder / name).write_text("\n".join(json.dumps(dict(zip(("doc_number", "kind", "title", "ts"), r))) for r in rows))
    put("1.json", ("1", "A", "one", "2024-01-01T00:00:00"), ("1", "A", "newer", "2024-01-02T00:00:00"))
    for _ in range(2):
        ingest.merged(ingest.new_files(spark, str(folder)), merge, str(tmp_path / "state")).awaitTermination()
    put("2.json", ("1", "A", "last", "2024-01-03T00:00:00"), ("2", "B", "two", "2024-01-01T00:00:00"))
    ingest.merged(ingest.new_files(spark, str(folder)), merge, str(tmp_path / "state")).awaitTermination()
    assert sorted((r.doc_number, r.title) for r in M.read_version(spark, state["path"]).collect()) == [("1", "last"), ("2", "two")]


def test_stream_windows_and_repeats(spark, tmp_path):
    (tmp_path / "1.json").write_text("\n".join(json.dumps({"doc_number": n, "kind": "A", "title": "t", "ts": t}) for n, t in (("1", "2024-01-01T00:10:00"), ("1", "2024-01-01T00:20:00"), ("2", "2024-01-01T01:10:00"))))
    records = ingest.new_files(spark, str(tmp_path))
    for i, (df, mode) in enumerate(((ingest.distinct_arrivals(records, ["doc_number"], "ts"), "append"), (ingest.arrivals_by_window(records, "ts"), "update"))):
        q = df.writeStream.format("memory").queryName(f"seen{i}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("seen0").count() == 2
    assert sorted(r.rows for r in spark.table("seen1").collect()) == [1, 2]


def test_texts_of_elements_without_their_own(spark):
    contents = ["x", "<b>y</b> z", '<b id="5">y</b><c/>', '<b id="5" k="6"/><c n="7"><d>w</d></c>', '<b id="5">\n <d>w</d></b>', "", "<b></b>", '<Image file="a.tif"/>']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, c string")
    assert [r.t for r in df.select("i", patent_xml.plain(F.col("c")).alias("t")).orderBy("i").collect()] == ["x", "z", "y", "5 6 7 w", "5 w", None, None, "a.tif"]


def test_the_root_is_behind_comments(spark):
    xml = '<?xml version="1.0"?><!-- <Other> --><!DOCTYPE x [<!ENTITY a "<b>">]><patent-document kind="A"><bibliographic-data><publication-reference><document-id><doc-number>7</doc-number></document-id></publication-reference></bibliographic-data></patent-document>'
    found = patent_xml.parsed(spark.createDataFrame([(xml,), (xml.replace("patent-document", "Other"),)], "content string"))
    assert [r.doc_number for r in found.collect()] == ["7"]
