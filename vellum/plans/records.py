"""Queries of sources and writes: documents, lists of files and titles, checks, images and their assets, deletes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import image_features as IF
from vellum.operators import image_match as MT
from vellum.operators import images as IM
from vellum.operators import integrity as I
from vellum.operators import vectors as V
from vellum.operators import writes as W
from vellum.plans.tables import coded, dealt, table
from vellum.sources import listing, patent_xml, titles


def xml_parse(spark, sf_dir):
    """A document for each part, in the vocabulary in use or the older one, parsed back into its fields."""
    p, k = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey"), F.col("p_partkey")
    s = lambda *x: F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in x])
    key, name, kind = k.cast("string"), F.col("p_name"), F.element_at(F.array(*map(F.lit, "ABU")), (k % 3 + 1).cast("int"))
    new = s(
        '<?xml version="1.0"?><b:PatentDocumentAndRelated xmlns:b="urn:b" docNumber="N', key, '" kind="', kind, '" country="CN" datePublication="20240105"><b:BibliographicData>',
        "<b:PublicationReference><b:DocumentID><b:DocNumber>P", key, "</b:DocNumber><b:Date>20240102</b:Date></b:DocumentID></b:PublicationReference>",
        "<b:RelatedDocuments><b:RelatedPublicationDoc><b:DocumentID><b:Date>20230102</b:Date></b:DocumentID></b:RelatedPublicationDoc></b:RelatedDocuments>",
        "<b:InventionTitle> ", name, " </b:InventionTitle><b:Parties><b:ApplicantDetails><b:Applicant><b:AddressBook><b:Name>", F.col("p_brand"), "</b:Name></b:AddressBook></b:Applicant><b:Applicant>", F.col("p_type"), "</b:Applicant></b:ApplicantDetails></b:Parties>",
        "</b:BibliographicData><b:Description><b:InventionMode><b:Paragraphs>", name, '<b:Image file="', key, '.tif"/></b:Paragraphs><b:Paragraphs>x &lt; ', key, "</b:Paragraphs></b:InventionMode></b:Description>",
        "<b:Claims><b:Claim><b:ClaimText>一种", name, "</b:ClaimText></b:Claim><b:Claim><b:ClaimText>根据权利要求1所述</b:ClaimText></b:Claim></b:Claims></b:PatentDocumentAndRelated>",
    )
    old = s("<patent-document kind='", kind, "'><bibliographic-data><invention-title>", name, "</invention-title><publication-reference><document-id><doc-number>N", key, "</doc-number><date>20240102</date></document-id></publication-reference><applicant>", F.col("p_brand"), "</applicant></bibliographic-data><claim>c", key, "</claim></patent-document>")
    rows = p.select("p_partkey", F.when(k % 5 == 4, old).otherwise(new).alias("content"))
    found = patent_xml.parsed(rows, keep=("p_partkey",))
    return found.select("p_partkey", "doc_number", "kind", "title", "pub_date", "grant_number", "grant_date", "applicant", "embodiment", "claims_text", "claim_count", "independent_claim_count", F.array_join("image_files", ",").alias("images"))


def xml_parties(spark, sf_dir):
    """A document for each part, parsed back into its parties, priorities, citations, abstract and sections."""
    p, k = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey"), F.col("p_partkey")
    s = lambda *x: F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in x])
    key, size = k.cast("string"), F.col("p_size").cast("string")
    content = s(
        '<b:PatentDocumentAndRelated xmlns:b="urn:b" docNumber="N', key, '" kind="A" status="C" lang="zh" country="CN" file="', key, '.XML"><b:BibliographicData>',
        '<b:ApplicationReference applType="10"><b:DocumentID><b:WIPOST3Code>CN</b:WIPOST3Code><b:DocNumber>A', key, "</b:DocNumber><b:Date>20200102</b:Date></b:DocumentID></b:ApplicationReference>",
        F.when(k % 2 == 0, s('<b:PriorityDetails><b:Priority kind="national" sequence="1"><b:WIPOST3Code>JP</b:WIPOST3Code><b:DocNumber>', key, "-1</b:DocNumber><b:Date>20190303</b:Date></b:Priority><b:Priority/></b:PriorityDetails>")).otherwise(""),
        "<b:Parties><b:InventorDetails><b:Inventor><b:AddressBook><b:Name>", F.col("p_brand"), "</b:Name></b:AddressBook></b:Inventor><b:Inventor>", F.col("p_type"), "</b:Inventor></b:InventorDetails>",
        "<b:AgentDetails><b:Agent><b:AddressBook><b:Name>L", key, "</b:Name></b:AddressBook>", F.when(k % 3 > 0, s("<b:Agency><b:AddressBook><b:OrganizationName>Agency ", size, "</b:OrganizationName></b:AddressBook></b:Agency>")).otherwise(""), "</b:Agent></b:AgentDetails></b:Parties>",
        "<b:AssigneeDetails><b:Assignee><b:AddressBook><b:Name>", F.col("p_type"), "</b:Name></b:AddressBook></b:Assignee></b:AssigneeDetails><b:ExaminerDetails><b:Examiner><b:Name>E", size, "</b:Name></b:Examiner><b:Examiner>second</b:Examiner></b:ExaminerDetails>",
        F.when(k % 4 == 1, s("<b:ReferencesCited><b:Citation><b:ApplicationCitation><b:PublicationReference><b:DocumentID><b:WIPOST3Code>TW</b:WIPOST3Code><b:DocNumber>", key, "</b:DocNumber><b:Kind>A1</b:Kind><b:Date>20131009</b:Date></b:DocumentID></b:PublicationReference></b:ApplicationCitation></b:Citation><b:Citation/></b:ReferencesCited>")).otherwise(""),
        "</b:BibliographicData><b:Abstract><b:Paragraphs>", F.col("p_name"), " &lt; ", key, '</b:Paragraphs><b:AbstractFigure><b:Figure><b:Image file="abs', key, '.JPG"/></b:Figure></b:AbstractFigure></b:Abstract>',
        "<b:Description><b:TechnicalField><b:Paragraphs>of ", F.col("p_name"), '</b:Paragraphs></b:TechnicalField><b:BackgroundArt><b:Part><b:Paragraphs>one</b:Paragraphs></b:Part><b:Paragraphs><b:u k="v">', size, '</b:u><b:u k="w"/></b:Paragraphs></b:BackgroundArt></b:Description></b:PatentDocumentAndRelated>',
    )
    found = patent_xml.parsed(p.select("p_partkey", content.alias("content")), keep=("p_partkey",))
    listed = lambda column, *fields: F.array_join(F.transform(column, lambda x: F.concat_ws(" ", *[x[f] for f in fields])), "; ").alias(column)
    return found.select(
        "p_partkey", "abstract", "abstract_figure", "app_number", "app_date", "app_country", "app_type", "status", "lang", "source_file", "pub_country", "inventor", "technical_field", "background_art",
        listed("agents", "agency", "agent"), listed("assignees", "name"), listed("citations", "country", "doc_number", "kind", "pub_date"), listed("priorities", "country", "doc_number", "date", "kind", "sequence"), F.array_join("examiners", ",").alias("examiners"),
    )


def title_lists(spark, sf_dir):
    """Lines of title lists in both layouts; invalid codes are told with their line."""
    rows = coded(spark, sf_dir).select(F.lit("list.txt").alias("file"), F.col("o_orderkey").cast("int").alias("line_no"), F.col("raw_code"), F.col("o_orderpriority"))
    code = F.when(F.col("line_no") % 50 == 7, "A01B0000020000").when(F.col("line_no") % 50 == 8, " ").otherwise(F.col("raw_code"))
    two = titles.two_columns(rows.select("file", "line_no", F.concat(code, F.lit("\t "), "o_orderpriority").alias("line")))
    three = titles.three_columns(rows.select("file", "line_no", F.concat(code, F.lit("\t"), F.when(F.col("line_no") % 2 == 0, "9").otherwise(""), F.lit("\t"), "o_orderpriority").alias("line")))
    return two.unionByName(three).groupBy("level", "error").agg(F.count("*").alias("rows"), F.min("title_en").alias("first_title"))


def download_plan(spark, sf_dir):
    """What is to be fetched of the parts' files, and how many bytes of it are there."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.concat("p_partkey", F.element_at(F.array(*map(F.lit, (".zip", ".z01", ".XML", ".txt"))), (k % 4 + 1).cast("int")))
    remote = p.select(name.alias("name"), (k * 10).alias("size"))
    local = p.where(k % 3 > 0).select(name.alias("name"), (k * F.when(k % 3 == 1, 10).otherwise(4)).alias("size"))
    return listing.download_plan(remote, local)


def archive_groups(spark, sf_dir):
    """Archives of one base name: split ones with their parts in order, single ones, and what cannot be opened."""
    items = table(spark, sf_dir, "lineitem")
    part = F.col("l_linenumber") - 1
    ending = F.when(part == 0, F.when(F.col("l_orderkey") % 7 == 0, ".gz").otherwise(".zip")).otherwise(F.concat(F.lit(".z0"), part))
    names = items.select(F.concat(F.lit("b"), "l_orderkey", ending).alias("name")).distinct()
    return listing.archive_groups(names).select("base", "kind", F.array_join("parts", ",").alias("parts"))


def split_parts(spark, sf_dir):
    """Parts of split archives that are missing, empty or of unequal size."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("base"), (F.col("l_linenumber") - 1).alias("part"), F.when(F.col("l_orderkey") % 3 == 0, 9).otherwise(F.col("l_quantity").cast("long")).alias("size"))
    return I.split_failures(items.where("base % 11 > 0 or part > 0"))


def manifest_lines(spark, sf_dir):
    """Lines of manifests, and manifests without a line that says anything."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 40).cast("string").alias("manifest"))
    k = F.col("doc_id")
    lines = d.select("manifest", F.when(k % 40 < 3, F.lit("no checksum here")).when(k % 2 == 0, F.concat(F.lit("a,b\\F"), k, F.lit(".ZIP,"), F.lower(F.hex(k)))).otherwise(F.concat(F.lit("x/F"), k, F.lit(".zip, "), F.hex(k), F.lit(" "))).alias("value"))
    named = I.manifest_rows(lines).select("name", "expected", F.lit(None).cast("string").alias("reason"))
    return named.unionByName(I.empty_manifests(lines).select(F.col("file").alias("name"), F.lit(None).cast("string").alias("expected"), "reason"))


def no_manifest(spark, sf_dir):
    """Folders without a manifest: empty ones, those without an archive, and archives that do not open."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("folder"), "n_nationkey")
    c = table(spark, sf_dir, "customer").where("c_nationkey % 5 > 0")
    ending = F.when((F.col("c_nationkey") % 5 == 1) | (F.col("c_custkey") % 2 == 0), ".txt").otherwise(".ZIP")
    files = c.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("folder", F.concat("c_name", ending).alias("name"), (F.col("c_custkey") % 7 > 0).alias("opens"))
    return I.without_manifest(files, nations)


def image_assets(spark, sf_dir):
    """Images through the ids of their assets, after new images were merged in; images without an asset are left out."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    shape = lambda digest, width: (F.col("p_name").alias("oss_key"), digest.alias("content_hash"), F.lit(None).cast("string").alias("perceptual_hash"), F.lit("image/jpeg").alias("content_type"), F.col("p_size").alias("size"), width.alias("width"), F.lit(1).alias("height"))
    old = p.where(k <= 400).groupBy("p_name").agg(F.min("p_size").alias("p_size"), F.min(k).alias("p_partkey")).select(*shape(F.lit("old"), F.lit(5)), F.col("p_partkey").cast("string").alias("id"))
    new = p.where(k > 300).select(*shape(F.when(k % 2 == 0, F.concat(F.lit("h"), k)).otherwise(""), (k % 3).cast("int")), F.concat(F.lit("n"), k).alias("id"), k.alias("at"))
    assets = W.upserted_assets(old, new, F.col("at")).drop("at", "first_position")
    assets = assets.select("oss_key", "content_hash", "width", "id")
    images = p.select(k.cast("string").alias("patent_id"), F.when(k % 10 > 0, F.col("p_name")).otherwise("gone").alias("oss_key"), (k % 4 == 0).alias("is_abstract"), F.when(k % 3 == 0, "inline").otherwise("").alias("image_role"), F.when(k % 2 == 0, 90).alias("display_rotation"))
    return W.image_rows(images, assets).join(assets.select(F.col("id").alias("asset_id"), "content_hash", "width"), "asset_id").select("patent_id", "asset_id", "image_role", "display_rotation", "content_hash", "width")


def delete_batch(spark, sf_dir):
    """Rows of every table that are left when one batch is deleted with its patents, their children and its log."""
    orders, items, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "customer")
    tables = {
        "patent": orders.select(F.col("o_orderkey").cast("string").alias("id"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("batch_id")),
        "patent_claim": items.select(F.col("l_orderkey").cast("string").alias("patent_id"), F.col("l_linenumber").alias("claim_num")),
        "patent_ipc": items.where("l_linenumber = 1").select(F.col("l_orderkey").cast("string").alias("patent_id"), F.col("l_returnflag").alias("ipc_code")),
        "sync_batches": orders.select(F.col("o_orderpriority").alias("batch_code")).distinct(),
        "sync_logs": orders.select("o_orderkey", F.col("o_orderpriority").alias("batch_code")),
        "image_asset": customers.select("c_custkey"),
    }
    left, deleted = W.without_batch(tables, "1-URGENT")
    out = deleted.select(F.lit("deleted").alias("name"), F.col("deleted").alias("rows"))
    for name, rows in left.items():
        out = out.unionByName(rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows"))
    return out


def image_likeness(spark, sf_dir):
    """Neighbouring pictures' likeness by difference hash, by pixels and by structure."""
    p = dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), "k")
    pixel = lambda n, move, most: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: ((i * 37 + F.floor(i / 5) * (F.col("k") + move) * 11) % most).cast("int"))
    black = lambda move: F.transform(pixel(64, move, 256), lambda v: F.when(v > 100, 255).otherwise(0))
    # pixels are columns of their own, so that no expression makes them anew for each place it looks at
    p = p.select("k", pixel(272, 0, 256).alias("a"), pixel(272, 1, 256).alias("b"), black(0).alias("x"), black(1).alias("y"))
    hashed = p.select("k", IF.dhash(F.col("a")).alias("a"), IF.dhash(F.col("b")).alias("b"), "x", "y")
    x, y = F.col("x"), F.col("y")
    return hashed.select("k", IF.bit_distance(F.col("a"), F.col("b")).alias("distance"), F.round(IF.agreement(x, y), 6).alias("agreement"), F.round(IF.structure(x, y), 6).alias("structure"))


def pictures(spark, sf_dir):
    """Pictures of patents, one for each part: a figure of boxes, a drawing with it turned, a fainter one, another figure, and for some an equal one."""
    shapes = dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("patent"), "p_size"), "patent")

    def drawn(source):
        import numpy as np
        import pandas as pd

        y, x = np.mgrid[0:48, 0:64]
        y, x = y[:, :1], x[:1]
        for rows in source:
            for at in range(0, len(rows), 256):
                patents, sizes = (rows[c].to_numpy()[at : at + 256, None, None] for c in ("patent", "p_size"))
                boxes = lambda k: ((x // (3 + k % 5) + y // (4 + k % 7)) % (2 + k % 3) == 0) & (x > 5 + k % 9) & (y > 4) & (x + y < 70 + sizes % 30)
                some, others, out = boxes(patents), boxes(patents * 7 + 3), []
                made = {"figure": np.where(some, 20, 255), "turned": np.where(some, 20, 255), "faint": np.where(some, 120, 250), "other": np.where(others, 60, 255), "same": np.where(some, 20, 255)}
                for place, (name, pictures) in enumerate(made.items()):
                    for patent, picture in zip(patents.ravel(), pictures.astype(np.uint8)):
                        if (name != "same" or patent % 5 == 0) and (name != "turned" or patent % 3 > 0):
                            picture = np.rot90(picture, patent % 4) if name == "turned" else picture
                            out.append((patent, place, f"{name}.TIF", name == "figure", name if name != "same" else "figure", picture.shape[1], picture.shape[0], picture.tobytes()))
                yield pd.DataFrame(out, columns=["patent", "place", "file_name", "is_abstract", "content_hash", "width", "height", "pixels"])

    return shapes.mapInPandas(drawn, "patent long, place int, file_name string, is_abstract boolean, content_hash string, width int, height int, pixels binary")


def image_matches(spark, sf_dir):
    """The drawing that each figure of an abstract is shown as, how it is turned, and how alike both are."""
    images = pictures(spark, sf_dir)
    shown = MT.with_canonical(images.drop("pixels"), MT.matches(images))
    return shown.select("patent", "file_name", "canonical_file_name", "display_rotation", "match_method", F.round("match_score", 9).alias("match_score"))


def image_order(spark, sf_dir):
    """Places of a patent's images in the order in which they are shown."""
    k = F.col("p_partkey")
    images = table(spark, sf_dir, "part").select(F.col("p_size").alias("patent"), (k % 7 == 0).alias("is_abstract"), F.element_at(F.array(*map(F.lit, ("drawing", "inline", "abstract", "other"))), (k % 4 + 1).cast("int")).alias("image_role"), k.cast("string").alias("file_name"))
    by = Window.partitionBy("patent").orderBy(*IM.shown_order(F.col("is_abstract"), F.col("image_role"), F.col("file_name")))
    return images.select("patent", "file_name", F.row_number().over(by).alias("place"))


def semantic_search(spark, sf_dir):
    """Dictionary entries whose vectors are most alike a query, of one type and section."""
    vectors = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    embeddings = vectors.select(F.when(k % 3 > 0, "ipc").otherwise("cpc").alias("type"), k.alias("code_norm"), F.lit("1").alias("version"), "embedding")
    dictionary = vectors.select(k.alias("code_norm"), F.lit("1").alias("version"), F.when(k % 2 == 0, "A").otherwise("B").alias("section"), F.concat(F.lit("title "), k).alias("title_en"))
    query = [1.0 if i % 4 else -0.25 for i in range(64)]
    found = V.semantic_search(embeddings, dictionary, query, 12, section="A", type="ipc")
    return found.select("code_norm", "title_en", F.round("similarity", 6).alias("similarity"))


def identifiers(spark, sf_dir):
    """Which texts have the shape of a UUID."""
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    digest = F.md5(k.cast("string"))
    made = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12))
    return orders.select("o_orderkey", T.is_uuid(F.when(k % 3 == 0, F.upper(made)).when(k % 3 == 1, made).otherwise(F.concat(made, F.lit("0")))).alias("is_uuid"))


QUERIES = {f.__name__: f for f in (xml_parse, xml_parties, title_lists, download_plan, archive_groups, split_parts, manifest_lines, no_manifest, image_assets, delete_batch, image_likeness, image_matches, image_order, semantic_search, identifiers)}

_CODE = "case when o_orderkey % 50 = 7 then 'A01B0000020000' when o_orderkey % 50 = 8 then ' ' else 'x' end"
_COS = "list_dot_product(v, q) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(q, q))"
_PIXEL = "list_transform(range({n}), lambda i: (i * 37 + i // 5 * (p_partkey + {move}) * 11) % 256)"
_BLACK = "list_transform({0}, lambda v: case when v > 100 then 255 else 0 end)"

ORACLE_SQL = {
    "xml_parse": """select p_partkey, concat('N', p_partkey) as doc_number, substr('ABU', cast(p_partkey % 3 + 1 as int), 1) as kind, p_name as title,
case p_partkey % 3 when 0 then '2024-01-02' when 1 then case when p_partkey % 5 < 4 then '2023-01-02' end end as pub_date,
case when p_partkey % 3 > 0 then concat(case when p_partkey % 5 = 4 then 'N' else 'P' end, p_partkey) end as grant_number,
case when p_partkey % 3 > 0 then case when p_partkey % 5 = 4 then '2024-01-02' else '2024-01-05' end end as grant_date,
case when p_partkey % 5 = 4 then p_brand else concat(p_brand, '; ', p_type) end as applicant,
case when p_partkey % 5 < 4 then concat(p_name, chr(10), '[[PATENT_IMAGE:', p_partkey, '.tif]]', chr(10), 'x < ', p_partkey) end as embodiment,
case when p_partkey % 5 = 4 then concat('c', p_partkey) else concat('一种', p_name, chr(10), '根据权利要求1所述') end as claims_text,
case when p_partkey % 5 < 4 then 2 end as claim_count, case when p_partkey % 5 < 4 then 1 end as independent_claim_count,
case when p_partkey % 5 < 4 then concat(p_partkey, '.tif') else '' end as images from part""",
    "xml_parties": """select p_partkey, concat(p_name, ' < ', p_partkey) as abstract, concat('abs', p_partkey, '.JPG') as abstract_figure, concat('A', p_partkey) as app_number, '2020-01-02' as app_date, 'CN' as app_country, '10' as app_type, 'C' as status, 'zh' as lang, concat(p_partkey, '.XML') as source_file, 'CN' as pub_country,
concat(p_brand, '; ', p_type) as inventor, concat('of ', p_name) as technical_field, concat('one', chr(10), p_size, ' w') as background_art, concat(case when p_partkey % 3 > 0 then concat('Agency ', p_size, ' ') else '' end, 'L', p_partkey) as agents, p_type as assignees,
case when p_partkey % 4 = 1 then concat('TW ', p_partkey, ' A1 2013-10-09') else '' end as citations, case when p_partkey % 2 = 0 then concat('JP ', p_partkey, '-1 2019-03-03 national 1') end as priorities, concat('E', p_size, ',second') as examiners from part""",
    "title_lists": f"""with l as (select o_orderkey as k, {_CODE} as code, o_orderkey % 5 as level, o_orderkey % 4 * 2 as sub, o_orderpriority as title from orders where o_orderkey % 50 <> 8),
r as (select *, case when code = 'A01B0000020000' then 0 when level = 0 then 0 when level < 3 then level when sub = 0 then 3 else 4 end as own, case when code = 'A01B0000020000' then concat('list.txt:', k, ': invalid code') end as error from l),
u as (select own as level, error, title from r union all select case when k % 2 = 0 then 9 else own end, error, title from r)
select cast(level as int) as level, error, count(*) as "rows", min(title) as first_title from u group by 1, 2""",
    "download_plan": "with f as (select concat(p_partkey, list_extract(['.zip', '.z01', '.XML', '.txt'], cast(p_partkey % 4 + 1 as int))) as name, p_partkey as k from part where p_partkey % 4 < 3) select name, k * 10 as size, case k % 3 when 0 then 'pending' when 1 then 'skipped' else 'partial' end as state, case k % 3 when 0 then 0 when 1 then k * 10 else k * 4 end as done from f",
    "archive_groups": """with n as (select distinct l_orderkey as k, l_linenumber as i from lineitem), g as (select k, count(*) filter (i = 1) as main, count(*) filter (i > 1) as parts, string_agg(concat('b', k, '.z0', i - 1), ',' order by i) filter (i > 1) as names from n group by k)
select concat('b', k) as base, case when k % 7 = 0 then 'gzip' when parts > 0 then 'split' else 'zip' end as kind, case when k % 7 = 0 then concat('b', k, '.gz') else concat(case when parts > 0 then concat(names, ',') else '' end, 'b', k, '.zip') end as parts from g where main > 0""",
    "split_parts": """with p as (select l_orderkey as base, l_linenumber - 1 as part, case when l_orderkey % 3 = 0 then 9 else cast(l_quantity as bigint) end as size from lineitem where l_orderkey % 11 > 0 or l_linenumber > 1),
g as (select base, count(*) filter (part = 0) as mains, count(*) filter (part > 0) as n, count(distinct case when part > 0 then part end) as d, max(case when part > 0 then part end) as last, min(size) as least, min(case when part > 0 then size end) as low, max(case when part > 0 then size end) as high from p group by base),
r as (select base, case when mains = 0 then 'no main file' when n > 0 and (last <> n or d <> n) then 'parts not in sequence' when least = 0 then 'empty part' when low <> high then 'parts of unequal size' end as reason from g) select * from r where reason is not null""",
    "manifest_lines": "select concat('F', doc_id, case when doc_id % 2 = 0 then '.ZIP' else '.zip' end) as name, lpad(printf('%X', doc_id), 8, '0') as expected, cast(null as varchar) as reason from documents where doc_id % 40 >= 3 union all select distinct cast(doc_id % 40 as varchar), null, 'no entries' from documents where doc_id % 40 < 3",
    "no_manifest": """with f as (select n_name as folder, concat(c_name, case when c_nationkey % 5 = 1 or c_custkey % 2 = 0 then '.txt' else '.ZIP' end) as name, c_custkey % 7 > 0 as opens from customer join nation on c_nationkey = n_nationkey where c_nationkey % 5 > 0),
g as (select n_name as folder, count(name) as files, count(*) filter (name like '%.ZIP') as archives from nation left join f on folder = n_name group by n_name)
select folder, folder as file, case when files = 0 then 'empty folder' else 'no archive' end as reason from g where files = 0 or archives = 0 union all select folder, name, 'damaged' from f where name like '%.ZIP' and not opens""",
    "image_assets": """with o as (select p_name as oss_key, 'old' as content_hash, 5 as width, cast(min(p_partkey) as varchar) as id from part where p_partkey <= 400 group by p_name),
n as (select p_name as oss_key, case when p_partkey % 2 = 0 then concat('h', p_partkey) else concat('legacy:', p_name) end as content_hash, nullif(p_partkey % 3, 0) as width, concat('n', p_partkey) as id from (select *, row_number() over (partition by p_name order by p_partkey) as rn from part where p_partkey > 300) where rn = 1),
a as (select coalesce(o.oss_key, n.oss_key) as oss_key, case when n.id is null then o.content_hash else n.content_hash end as content_hash, case when n.id is null then o.width else n.width end as width, coalesce(o.id, n.id) as id from o full join n on o.oss_key = n.oss_key)
select cast(p_partkey as varchar) as patent_id, id as asset_id, case when p_partkey % 3 = 0 then 'inline' when p_partkey % 4 = 0 then 'abstract' else 'drawing' end as image_role, case when p_partkey % 2 = 0 then 90 else 0 end as display_rotation, content_hash, cast(width as int) as width from part join a on oss_key = p_name where p_partkey % 10 > 0""",
    "delete_batch": """select 'deleted' as name, (select count(*) from orders where o_orderpriority = '1-URGENT') as "rows" union all select 'patent', (select count(*) from orders where o_orderpriority <> '1-URGENT')
union all select 'patent_claim', (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderpriority = '1-URGENT')) union all select 'patent_ipc', (select count(*) from lineitem where l_linenumber = 1 and l_orderkey not in (select o_orderkey from orders where o_orderpriority = '1-URGENT'))
union all select 'sync_batches', (select count(distinct o_orderpriority) from orders where o_orderpriority <> '1-URGENT') union all select 'sync_logs', (select count(*) from orders where o_orderpriority <> '1-URGENT') union all select 'image_asset', (select count(*) from customer)""",
    "image_likeness": f"""with p as (select p_partkey as k, {_PIXEL.format(n=272, move=0)} as a, {_PIXEL.format(n=272, move=1)} as b, {_BLACK.format(_PIXEL.format(n=64, move=0))} as x, {_BLACK.format(_PIXEL.format(n=64, move=1))} as y from part),
m as (select *, list_avg(x) as mx, list_avg(y) as my from p),
v as (select *, list_sum(list_transform(x, lambda t: (t - mx) * (t - mx))) / 63 as vx, list_sum(list_transform(y, lambda t: (t - my) * (t - my))) / 63 as vy, list_sum(list_transform(range(64), lambda i: (x[i + 1] - mx) * (y[i + 1] - my))) / 63 as c from m)
select k, cast(list_sum(list_transform(range(256), lambda i: case when (a[i // 16 * 17 + i % 16 + 1] > a[i // 16 * 17 + i % 16 + 2]) = (b[i // 16 * 17 + i % 16 + 1] > b[i // 16 * 17 + i % 16 + 2]) then 0 else 1 end)) as int) as distance, round(list_sum(list_transform(range(64), lambda i: case when x[i + 1] = y[i + 1] then 1 else 0 end)) / 64.0, 6) as agreement, round((2 * mx * my + 6.5025) * (2 * c + 58.5225) / ((mx * mx + my * my + 6.5025) * (vx + vy + 58.5225)), 6) as structure from v""",
    "image_order": "select p_size as patent, cast(p_partkey as varchar) as file_name, cast(row_number() over (partition by p_size order by p_partkey % 7 = 0 desc, case p_partkey % 4 when 0 then 0 when 1 then 1 else 2 end, cast(p_partkey as varchar)) as int) as place from part",
    "semantic_search": f"with r as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v, list_transform(range(64), lambda i: case when i % 4 > 0 then 1.0 else -0.25 end) as q from embeddings where vec_id % 3 > 0 and vec_id % 2 = 0) select vec_id as code_norm, concat('title ', vec_id) as title_en, round({_COS}, 6) as similarity from r order by {_COS} desc, vec_id limit 12",
    "identifiers": "select o_orderkey, o_orderkey % 3 < 2 as is_uuid from orders",
}
