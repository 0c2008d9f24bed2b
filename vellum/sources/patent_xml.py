"""Patent XML as typed records, parsed by Spark's own reader.

Two vocabularies are read: the one in use (``BibliographicData``, ``DocumentID``) and an older one in lower case with
hyphens (``bibliographic-data``, ``document-id``). Where both could give a value, the one in use goes first.

Elements with mixed content come out of the reader as text with tags, so their paragraphs, images and plain text are
taken by regular expressions in the order of the document, whatever lies between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import codes
from vellum.functions import text as T
from vellum.functions.patent_text import disclosure_parts, image_marker

#: Names of the root element of a patent document.
ROOTS = ("PatentDocumentAndRelated", "cn-patent-document", "patent-document", "cn-utility-model", "utility-model-document")
#: Title of a patent that has none.
UNTITLED = "未知标题"

_ID = "array<struct<WIPOST3Code:string,DocNumber:string,Kind:string,Date:string>>"
_REFERENCES = f"array<struct<_applType:string,DocumentID:{_ID}>>"
_PERSON = "struct<_VALUE:string,name:string,AddressBook:struct<Name:string,Address:struct<Text:string,Province:string,City:string,County:string,PostCode:string,WIPOST3Code:string>>>"
_AGENT = "struct<_VALUE:string,AddressBook:struct<Name:string>,Agency:struct<AddressBook:struct<OrganizationName:string>>>"
_PRIORITY = "array<struct<_kind:string,_dataFormat:string,_sourceDB:string,_sequence:string,WIPOST3Code:string,DocNumber:string,Date:string>>"
_IPC = "array<struct<_VALUE:string,_code:string,Text:string,`main-classification`:string,classification:string>>"
_FIGURE = "Figure:array<struct<_figureLabels:string,_num:string,Image:array<struct<_file:string>>>>"
SCHEMA = f"""
_country string, _docNumber string, _kind string, _datePublication string, _status string, _lang string, _file string, `_doc-number` string, `_date-publ` string,
BibliographicData struct<
  PublicationReference:{_REFERENCES}, ApplicationReference:{_REFERENCES}, GrantReference:{_REFERENCES},
  RelatedDocuments:struct<RelatedPublicationDoc:array<struct<DocumentID:{_ID}>>>,
  PriorityDetails:struct<Priority:{_PRIORITY}>,
  ClassificationIPCRDetails:struct<ClassificationIPCR:{_IPC}>,
  InventionTitle:array<string>,
  Parties:struct<ApplicantDetails:struct<Applicant:array<{_PERSON}>>, InventorDetails:struct<Inventor:array<{_PERSON}>>, AgentDetails:struct<Agent:array<{_AGENT}>>>,
  AssigneeDetails:struct<Assignee:array<{_PERSON}>>,
  ExaminerDetails:struct<Examiner:array<struct<_VALUE:string,Name:string>>>,
  ReferencesCited:struct<Citation:array<struct<ApplicationCitation:struct<PublicationReference:array<struct<DocumentID:{_ID}>>>>>>>,
Abstract struct<Paragraphs:array<string>, AbstractFigure:struct<{_FIGURE}>>,
Description map<string,string>,
Claims struct<Claim:array<struct<_num:string,ClaimText:array<string>>>>,
Drawings struct<{_FIGURE}>
"""

_OLD_ID = "struct<`document-id`:struct<`doc-number`:string,date:string,WIPOST3Code:string,Kind:string,Date_:string>>"
OLD_SCHEMA = f"""
`bibliographic-data` struct<
  `publication-reference`:{_OLD_ID}, `application-reference`:{_OLD_ID}, `grant-reference`:{_OLD_ID},
  `related-documents`:struct<`related-publication-doc`:array<{_OLD_ID}>>,
  `priority-details`:struct<priority:{_PRIORITY}>,
  `classifications-ipcr`:struct<`classification-ipcr`:{_IPC}>, `classification-ipc`:struct<`main-classification`:array<string>>,
  `invention-title`:string, abstract:string, applicant:array<string>, inventor:array<string>,
  parties:struct<applicants:struct<applicant:array<string>>, inventors:struct<inventor:array<string>>, agents:struct<agent:array<string>>>,
  agents:struct<agent:array<struct<agency:string>>>,
  `references-cited`:struct<citation:array<struct<`application-citation`:struct<`publication-reference`:{_OLD_ID}>>>>>,
`related-documents` struct<`related-publication-doc`:array<{_OLD_ID}>>,
`invention-title` string, title string, abstract string, claims string, claim array<string>,
applicant array<string>, inventor array<string>, agent array<string>, agency array<string>, `ipc-codes` array<string>, ipc array<string>,
`application-number` string, `application-date` string, `publication-number` string, `publication-date` string, `grant-number` string, `grant-date` string
"""
#: An element that only the older vocabulary has.
_OLD = r"<(?:bibliographic-data|related-documents|invention-title|title|abstract|claims?|applicant|inventor|agent|agency|ipc|ipc-codes|(?:application|publication|grant)-(?:number|date))[\s>]"
_OPTIONS = {"attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE"}

_TAG = r"(?s)<[^>]*>"
#: A tag with attributes and a text behind it, and an attribute within a tag.
_WITH_TEXT, _ATTRIBUTE = r"(?s)<([A-Za-z][\w.-]*)\s[^<>]*>(?=\s*[^<\s])", r"(?s)\s[\w:.-]+=\"([^\"<>]*)\"(?=[^<>]*>)"
_ELEMENT = r"(?s)<([A-Za-z][\w.-]*)\b[^>]*?(?:/>|>.*?</\1>)"
_PARAGRAPH = r"(?s)<(Paragraphs?)\b[^>]*?(?:/>|>(.*?)</\1>)"
_IMAGE = r"(?s)<Image\b[^>]*?\bfile=\"([^\"]*)\""
#: Stands for a "<" of the text while tags are text too.
_LESS = "\ue000"


def plain(content: Column) -> Column:
    """Text of an element's content: its own, or, if it has none, that of all elements in it, parted by spaces; null if there is none.

    An element within that has no text of its own before its first child gives the values of its attributes too.
    """
    own = F.array_join(F.transform(F.split(content, _ELEMENT), lambda x: T.trimmed(F.regexp_replace(x, _TAG, ""))), "")
    # attributes of tags with a text behind them go, the values of the others become texts
    told = F.regexp_replace(F.regexp_replace(content, _WITH_TEXT, "<$1>"), _ATTRIBUTE, ">$1<")
    inner = F.array_join(F.array_remove(F.transform(F.split(told, _TAG), T.trimmed), ""), " ")
    # most contents have no tags
    text = F.when(content.contains("<"), F.coalesce(_some(own), inner)).otherwise(T.trimmed(content))
    return _some(F.replace(text, F.lit(_LESS), F.lit("<")))


def _some(text: Column) -> Column:
    """Null in place of an empty text, which is made once also within lists."""
    return F.get(F.array_remove(F.array(text), ""), F.lit(0))


def joined(contents: Column, separator: str = " ") -> Column:
    """Texts of several elements' contents in one; null if there is none."""
    return T.non_empty(F.array_join(F.array_compact(F.transform(contents, plain)), separator))


def image_files(content: Column) -> Column:
    """Files of the images in an element's content, in order."""
    return F.filter(F.regexp_extract_all(content, F.lit(_IMAGE), 1), T.is_image)


def paragraphs(section: Column) -> Column:
    """Texts of all paragraphs in a section, with a marker for each image; empty ones are left out."""

    def written(content: Column) -> Column:
        files = image_files(content)
        with_images = F.array_join(F.concat(F.array_compact(F.array(plain(F.regexp_replace(content, _TAG, "")))), F.transform(files, image_marker)), "\n")
        return F.when(F.size(files) > 0, with_images).otherwise(plain(content))

    found = F.transform(F.regexp_extract_all(F.coalesce(section, F.lit("")), F.lit(_PARAGRAPH), 2), written)
    return F.filter(found, lambda p: T.non_empty(p).isNotNull())


def _person(node: Column) -> Column:
    address = node["AddressBook"]["Address"]
    name = plain(node["AddressBook"]["Name"])
    parts = (("address", "Text"), ("province", "Province"), ("city", "City"), ("county", "County"), ("postcode", "PostCode"), ("country", "WIPOST3Code"))
    return F.struct(F.coalesce(name, plain(node["_VALUE"]), plain(node["name"])).alias("name"), *[F.when(name.isNotNull(), plain(address[x])).alias(n) for n, x in parts])


def _named(name: Column) -> Column:
    return F.struct(plain(name).alias("name"), *[F.lit(None).cast("string").alias(n) for n in ("address", "province", "city", "county", "postcode", "country")])


def _filled(values: Column) -> Column:
    """Null in place of an empty list."""
    return F.when(F.size(values) > 0, values)


def _people(nodes: Column, *old: Column) -> Column:
    """Persons of the nodes, or of the first old list that has any; those without a name go."""
    lists = [F.transform(nodes, _person), *[F.transform(o, _named) for o in old]]
    return F.coalesce(*[_filled(F.filter(x, lambda p: p["name"].isNotNull())) for x in lists], F.array())


def _agents(nodes: Column, old: Column, agent: Column, agency: Column) -> Column:
    """Pairs of agency and agent; a name that a pair lacks comes from the flat lists by its place."""
    pair = lambda agency, agent: F.struct(agency.alias("agency"), agent.alias("agent"))
    given = F.transform(nodes, lambda a: pair(plain(a["Agency"]["AddressBook"]["OrganizationName"]), plain(a["AddressBook"]["Name"])).alias("p"))
    alone = F.transform(nodes, lambda a: plain(a["_VALUE"]))
    given = F.zip_with(given, alone, lambda p, v: F.when(p["agency"].isNotNull() | p["agent"].isNotNull(), p).otherwise(pair(F.lit(None).cast("string"), v)))
    made = F.coalesce(_filled(given), F.transform(old, lambda a: pair(F.lit(None).cast("string"), plain(a))), F.array().cast("array<struct<agency:string,agent:string>>"))
    made = F.filter(made, lambda p: p["agency"].isNotNull() | p["agent"].isNotNull())
    names, agencies = (F.coalesce(T.split_values(x), F.array().cast("array<string>")) for x in (agent, agency))
    merged = F.transform(made, lambda p, i: pair(F.coalesce(p["agency"], F.get(agencies, i)), F.coalesce(p["agent"], F.get(names, i))))
    return F.when(F.size(made) > 0, merged).otherwise(F.zip_with(agencies, names, pair))


def _claims(nodes: Column) -> Column:
    """(num, claim_num, claim_text, is_independent): a claim's own number, or its place in four digits, and its place among those with a text."""
    texts = F.transform(nodes, lambda c, i: F.struct(F.coalesce(plain(c["_num"]), F.lpad((i + 1).cast("string"), 4, "0")).alias("num"), joined(c["ClaimText"], "\n").alias("text")))
    kept = F.filter(F.coalesce(texts, F.array().cast("array<struct<num:string,text:string>>")), lambda c: c["text"].isNotNull())
    return F.transform(kept, lambda c, i: F.struct(c["num"].alias("num"), (i + 1).alias("claim_num"), c["text"].alias("claim_text"), T.independent_claim(c["text"]).alias("is_independent")))


def _first_file(figure: Column) -> Column:
    return F.get(F.filter(F.transform(figure["Image"], lambda i: i["_file"]), T.is_image), F.lit(0))


def _images(drawings: Column, description: Column) -> Column:
    """(file_name, image_role, figure_label, source_section): the first image of each drawing, then those within the text; each once."""
    made = lambda file, role, label, section: F.struct(file.alias("file_name"), F.lit(role).alias("image_role"), label.alias("figure_label"), section.alias("source_section"))
    none = F.lit(None).cast("string")
    drawn = F.filter(F.transform(drawings, lambda f: made(_first_file(f), "drawing", F.coalesce(plain(f["_figureLabels"]), plain(f["_num"])), none)), lambda r: r["file_name"].isNotNull())
    inline = F.flatten(F.transform(F.filter(F.map_entries(description), lambda e: e["key"] != "DrawingsDescription"), lambda e: F.transform(image_files(e["value"]), lambda f: made(f, "inline", none, e["key"]))))
    empty = F.array().cast("array<struct<file_name:string,image_role:string,figure_label:string,source_section:string>>")
    found = F.concat(F.coalesce(drawn, empty), F.coalesce(inline, empty))
    same = lambda a, b: (a["file_name"] == b["file_name"]) & (a["image_role"] == b["image_role"]) & a["source_section"].eqNullSafe(b["source_section"])
    return F.aggregate(found, empty, lambda out, r: F.when(F.exists(out, lambda x: same(x, r)), out).otherwise(F.concat(out, F.array(r))))


def _dated(id: Column) -> Column:
    return T.iso_date(id["Date"])


def parsed(entries: DataFrame, content: str = "content", keep: tuple[str, ...] = (), patent_type: str | None = None) -> DataFrame:
    """A record for each XML document; documents without a number, with another root, or that are no XML, give no row.

    ``patent_type`` names a column with the type that an import was asked for; it stands in where a document has no kind.
    """
    xml = F.col(content).cast("string")
    bare = F.replace(F.regexp_replace(xml, r"(</?)[A-Za-z_][\w.-]*:", "$1"), F.lit("&lt;"), F.lit(_LESS))
    # the first tag that is not within a comment, a declaration or an instruction
    head = F.regexp_replace(F.substring(xml, 1, 1 << 16), r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>", "")
    root = F.regexp_extract(head, r"<(?:[A-Za-z_][\w.-]*:)?([A-Za-z][\w.-]*)[\s/>]", 1)
    asked = F.col(patent_type) if patent_type else F.lit(None).cast("string")
    rows = entries.select(*keep, asked.alias("asked"), xml.alias("raw_xml"), bare.alias("bare"), root.isin(*ROOTS).alias("is_patent"))
    # as a generator's columns the trees are made once a row, and where rows are dealt out to: filters on them stay behind it
    trees = F.struct(F.from_xml("bare", SCHEMA, _OPTIONS).alias("x"), F.from_xml(F.when(F.col("bare").rlike(_OLD), F.col("bare")), OLD_SCHEMA, _OPTIONS).alias("o"))
    rows = rows.select(*keep, "asked", "raw_xml", F.inline(F.when(F.col("is_patent"), F.array(trees))))
    x, o = F.col("x"), F.col("o")
    b, ob = x["BibliographicData"], o["bibliographic-data"]
    first = lambda nodes: F.get(nodes, F.lit(0))
    ids = {name: first(first(b[name])["DocumentID"]) for name in ("PublicationReference", "ApplicationReference", "GrantReference")}
    old = {name: ob[name]["document-id"] for name in ("publication-reference", "application-reference", "grant-reference")}
    pub, app, grant = ids["PublicationReference"], ids["ApplicationReference"], ids["GrantReference"]
    old_pub, old_app, old_grant = old.values()
    old_date = lambda id: F.coalesce(T.iso_date(id["Date_"]), T.iso_date(id["date"]))
    either = lambda *values: F.coalesce(*[plain(v) for v in values])

    number = either(x["_docNumber"], pub["DocNumber"], x["_doc-number"], old_pub["doc-number"], old_app["doc-number"], o["publication-number"], o["application-number"])
    kind = plain(x["_kind"])
    is_application, is_model = (kind == "A") | F.coalesce(F.col("asked") == "invention_application", F.lit(False)), (kind == "U") | F.coalesce(F.col("asked") == "utility_model", F.lit(False))
    is_application, is_model = (F.coalesce(c, F.lit(False)) for c in (is_application, is_model))
    pub_number = either(pub["DocNumber"], old_pub["doc-number"], o["publication-number"])
    reference_date = F.coalesce(_dated(pub), old_date(old_pub), T.iso_date(o["publication-date"]))
    related = F.coalesce(b["RelatedDocuments"]["RelatedPublicationDoc"])
    related_date = F.get(F.array_compact(F.transform(related, lambda d: _dated(first(d["DocumentID"])))), F.lit(0))
    old_related = F.coalesce(ob["related-documents"]["related-publication-doc"], o["related-documents"]["related-publication-doc"])
    related_date = F.coalesce(related_date, F.get(F.array_compact(F.transform(old_related, lambda d: old_date(d["document-id"]))), F.lit(0)))
    granted = F.coalesce(_dated(grant), old_date(old_grant), T.iso_date(o["grant-date"]), T.iso_date(x["_date-publ"]), T.iso_date(x["_datePublication"]), reference_date)

    parties, old_parties = b["Parties"], ob["parties"]
    applicants = _people(parties["ApplicantDetails"]["Applicant"], old_parties["applicants"]["applicant"], ob["applicant"], o["applicant"])
    inventors = F.transform(_people(parties["InventorDetails"]["Inventor"], old_parties["inventors"]["inventor"], ob["inventor"], o["inventor"]), lambda p: p["name"])
    agent_nodes, old_agents = parties["AgentDetails"]["Agent"], old_parties["agents"]["agent"]
    agency = F.coalesce(T.non_empty(F.array_join(F.array_compact(F.transform(agent_nodes, lambda a: plain(a["Agency"]["AddressBook"]["OrganizationName"]))), "; ")), joined(F.transform(ob["agents"]["agent"], lambda a: a["agency"])), joined(o["agency"]))
    agent = F.coalesce(T.non_empty(F.array_join(F.array_compact(F.transform(agent_nodes, lambda a: plain(a["AddressBook"]["Name"]))), "; ")), joined(old_agents), joined(o["agent"]))
    ipc_text = lambda c: T.trimmed(F.coalesce(*[T.non_empty(c[n]) for n in ("Text", "_VALUE", "_code", "main-classification", "classification")]))
    ipc_lists = [F.transform(n, ipc_text) for n in (b["ClassificationIPCRDetails"]["ClassificationIPCR"], ob["classifications-ipcr"]["classification-ipcr"])]
    ipc_lists += [F.transform(n, plain) for n in (o["ipc-codes"], o["ipc"], ob["classification-ipc"]["main-classification"])]
    ipc = F.coalesce(*[_filled(F.filter(n, lambda c: T.non_empty(c).isNotNull())) for n in ipc_lists], F.array().cast("array<string>"))
    cited = F.transform(b["ReferencesCited"]["Citation"], lambda c: first(first(c["ApplicationCitation"]["PublicationReference"])["DocumentID"]))
    citation = lambda country, n, kind, date: F.struct(plain(country).alias("country"), plain(n).alias("doc_number"), plain(kind).alias("kind"), date.alias("pub_date"))
    citations = F.transform(F.filter(cited, lambda d: d.isNotNull()), lambda d: citation(d["WIPOST3Code"], d["DocNumber"], d["Kind"], _dated(d)))
    old_cited = F.filter(F.transform(ob["references-cited"]["citation"], lambda c: c["application-citation"]["publication-reference"]["document-id"]), lambda d: d.isNotNull())
    old_citations = F.transform(old_cited, lambda d: citation(d["WIPOST3Code"], d["doc-number"], d["Kind"], T.iso_date(d["Date_"])))
    priorities = F.transform(F.coalesce(b["PriorityDetails"]["Priority"], ob["priority-details"]["priority"]), lambda p: F.struct(
        plain(p["WIPOST3Code"]).alias("country"), plain(p["DocNumber"]).alias("doc_number"), T.iso_date(p["Date"]).alias("date"), plain(p["_kind"]).alias("kind"),
        plain(p["_dataFormat"]).alias("data_format"), plain(p["_sourceDB"]).alias("source_db"), plain(p["_sequence"]).alias("sequence")))
    priorities = F.filter(priorities, lambda p: p["country"].isNotNull() | p["doc_number"].isNotNull() | p["date"].isNotNull())
    claim_texts = T.non_empty(F.array_join(F.array_compact(F.transform(x["Claims"]["Claim"], lambda c: joined(c["ClaimText"]))), "\n"))
    examiners = F.array_compact(F.transform(b["ExaminerDetails"]["Examiner"], lambda e: F.coalesce(plain(e["Name"]), plain(e["_VALUE"]))))
    none = lambda kind: F.array().cast(kind)

    rows = rows.select(
        *keep,
        "raw_xml",
        number.alias("doc_number"),
        kind.alias("kind"),
        F.coalesce(joined(b["InventionTitle"]), plain(ob["invention-title"]), plain(o["invention-title"]), plain(o["title"]), F.lit(UNTITLED)).alias("title"),
        F.coalesce(joined(x["Abstract"]["Paragraphs"]), plain(o["abstract"]), plain(ob["abstract"])).alias("abstract"),
        plain(first(first(x["Abstract"]["AbstractFigure"]["Figure"])["Image"])["_file"]).alias("abstract_figure"),
        F.coalesce(plain(pub["WIPOST3Code"]), plain(x["_country"])).alias("pub_country"), plain(x["_status"]).alias("status"), plain(x["_lang"]).alias("lang"), plain(x["_file"]).alias("source_file"),
        either(app["DocNumber"], old_app["doc-number"], o["application-number"]).alias("app_number"),
        F.coalesce(_dated(app), old_date(old_app), T.iso_date(o["application-date"])).alias("app_date"),
        plain(app["WIPOST3Code"]).alias("app_country"), plain(first(b["ApplicationReference"])["_applType"]).alias("app_type"),
        pub_number.alias("pub_number"),
        # an application is published by its own reference, an invention by that of its application, a utility model never
        F.when(is_application, reference_date).when(~is_model, related_date).alias("pub_date"),
        F.when(~is_application, F.coalesce(either(grant["DocNumber"], old_grant["doc-number"], o["grant-number"]), pub_number, number)).alias("grant_number"),
        F.when(~is_application, granted).alias("grant_date"),
        F.transform(ipc, lambda c: F.struct(c.alias("ipc_code"), codes.normalized_or_compact(c).alias("code_norm"))).alias("ipc"),
        applicants.alias("applicants"), F.nullif(F.array_join(F.transform(applicants, lambda p: p["name"]), "; "), F.lit("")).alias("applicant"),
        _people(b["AssigneeDetails"]["Assignee"]).alias("assignees"),
        inventors.alias("inventors"), F.nullif(F.array_join(inventors, "; "), F.lit("")).alias("inventor"),
        _agents(agent_nodes, old_agents, agent, agency).alias("agents"), agent.alias("agent"), agency.alias("agency"),
        F.coalesce(examiners, none("array<string>")).alias("examiners"),
        F.coalesce(_filled(citations), old_citations, none("array<struct<country:string,doc_number:string,kind:string,pub_date:string>>")).alias("citations"),
        _filled(priorities).alias("priorities"),
        _claims(x["Claims"]["Claim"]).alias("claims"), F.coalesce(claim_texts, plain(o["claims"]), joined(o["claim"])).alias("claims_text"),
        x["Description"].alias("description"), x["Drawings"]["Figure"].alias("figures"),
    )
    rows = rows.where("doc_number is not null")
    count = lambda c: F.nullif(c, F.lit(0))
    section = lambda *names: F.coalesce(*[T.non_empty(F.array_join(paragraphs(F.col("description")[n]), "\n")) for n in names])
    rows = rows.withColumns({
        "technical_field": section("TechnicalField"), "background_art": section("BackgroundArt"), "disclosed": paragraphs(F.col("description")["Disclosure"]),
        "drawings_description": section("DrawingsDescription"), "embodiment": section("InventionMode", "ModeForInvention"), "image_references": _images(F.col("figures"), F.col("description")),
    })
    problem, solution, effect = disclosure_parts(F.col("disclosed"))
    rows = rows.withColumns({"disclosure": T.non_empty(F.array_join("disclosed", "\n")), "technical_problem": problem, "technical_solution": solution, "beneficial_effect": effect})
    return rows.withColumns({
        "description": T.non_empty(F.concat_ws("\n\n", "technical_field", "background_art", "disclosure", "drawings_description", "embodiment")),
        "image_files": F.array_distinct(F.filter(F.transform("image_references", lambda r: T.trimmed(r["file_name"])), lambda f: f != "")),
        "claim_count": count(F.size("claims")),
        "independent_claim_count": count(F.size(F.filter("claims", lambda c: c["is_independent"]))),
        "referenced_documents": T.cited_documents(F.col("background_art"), F.col("disclosure")),
        "id": F.sha2(F.concat_ws("\0", "doc_number", F.coalesce("kind", F.lit(""))), 256),
    }).drop("disclosed", "figures")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Records that were written as JSON, a record a line, with the types that ``parsed`` gives."""
    none = spark.createDataFrame([], "content string")
    return spark.read.schema(parsed(none).schema).json(path)


def child_table(patents: DataFrame, column: str) -> DataFrame:
    """A nested list of the records as a table of its own, keyed by ``patent_id``."""
    rows = patents.select(F.col("id").alias("patent_id"), F.explode(column).alias("child"))
    kind = rows.schema["child"].dataType.typeName()
    return rows.select("patent_id", "child.*" if kind == "struct" else F.col("child").alias("name")).dropDuplicates()
