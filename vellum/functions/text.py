"""Scalar functions over texts, dates, names and numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def non_empty(text: Column) -> Column:
    """Null in place of an empty text."""
    return F.nullif(text, F.lit(""))


def iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` of a text with eight digits, else null; the calendar is not looked at."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits) == 8, F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)))


def checked_date(text: Column) -> Column:
    """A date of the calendar, or null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.try_to_date(text, "yyyy-MM-dd"))


#: Names of document kinds, long and short.
KINDS = {"A": ("发明申请", "申请"), "B": ("发明授权", "发明"), "U": ("实用新型", "实用")}


def kind_label(kind: Column, short: bool = False) -> Column:
    """Name of a document kind; kinds without a name stand for themselves, ``-`` for none."""
    out = F.coalesce(non_empty(kind), F.lit("-"))
    for k, names in KINDS.items():
        out = F.when(kind == k, names[short]).otherwise(out)
    return out


def display_date(kind: Column, published: Column, granted: Column) -> Column:
    """The date to show: of publication for applications, of the grant for all others."""
    return F.when(kind == "A", published).otherwise(granted)


def default_kind(kind: Column, patent_type: Column) -> Column:
    """The kind, or the one that the type of patent has."""
    return F.coalesce(non_empty(kind), F.when(patent_type == "invention", "B").when(patent_type == "application", "A").otherwise("U"))


#: How codes of batches of a type begin; of all other types with the last.
BATCH_PREFIXES = {"invention": "CN-PA-TXTS-10-B", "invention_application": "CN-PA-TXTS-10-A"}
OTHER_BATCHES = "CN-PA-TXTS-20-U"


def batch_code(data_type: Column, folder: Column) -> Column:
    """A batch's code from its type and folder: the folder's date, marked if raw data, or else its name."""
    name = F.coalesce(F.try_element_at(F.filter(F.split(folder, "/"), lambda x: x != ""), F.lit(-1)), F.lit(""))
    date = F.regexp_extract(name, r"(?i)^([0-9]{8})(rawdata)?\z", 1)
    raw = F.when(F.lower(name).endswith("rawdata"), "-Raw").otherwise("")
    prefix = F.lit(OTHER_BATCHES)
    for kind, own in BATCH_PREFIXES.items():
        prefix = F.when(data_type == kind, own).otherwise(prefix)
    return F.concat(prefix, F.lit("-"), F.when(date != "", F.concat(date, raw)).otherwise(name))


def object_key(batch: Column, document: Column, file_name: Column) -> Column:
    """Place of a file in an object store."""
    safe = lambda c: F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")
    return F.concat_ws("/", F.lit("patents"), safe(batch), safe(document), safe(file_name))


def image_key(path: Column) -> Column:
    """File name in lower case, behind the last slash of either kind."""
    return F.lower(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1))


def content_type(file_name: Column) -> Column:
    """Content type of an image by its extension."""
    # fixed values
    kinds = {"png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "jp2": "image/jp2", "j2k": "image/jp2"}
    extension = F.lower(F.regexp_extract(file_name, r"\.([A-Za-z0-9]+)\z", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), extension), F.lit("image/jpeg"))


def is_image(file_name: Column) -> Column:
    return F.lower(file_name).rlike(r"\.(jpe?g|png|gif|bmp|webp|tiff?|jp2|j2k|svg)\z")


def is_patent_xml(file_name: Column) -> Column:
    """An XML file that is no schema or document type."""
    lower = F.lower(file_name)
    return lower.endswith(".xml") & ~lower.rlike("dtd|xsd|schema")


def is_download(file_name: Column) -> Column:
    """A file that a batch is made of."""
    return F.lower(file_name).rlike(r"\.(zip|gz|xml|z\d+)\z")


def crc_text(content: Column) -> Column:
    """CRC-32 as eight upper-case hexadecimal digits."""
    return F.lpad(F.hex(F.crc32(content)), 8, "0")


def independent_claim(text: Column) -> Column:
    """Whether a claim refers to no other claim."""
    return ~text.rlike(r"(?U)(?:如|根据)权利要求\s*\d+")


#: Words before a document's number, and the forms of numbers.
_NUMBER_OF = r"(?U)(?:申请号|专利号|公开号|公告号)\s*[：:]?\s*"
CITED = (_NUMBER_OF + r"(CN[0-9]{6,}[.0-9]*)", _NUMBER_OF + r"([0-9]{8,}[.0-9]*)", r"(?<![A-Za-z0-9_])(CN[0-9]{8,}[.0-9]*)")


def cited_documents(*texts: Column) -> Column:
    """Numbers of patent documents in texts, each once: text by text, those behind a word for a number first, kind letters left off."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1) for text in texts for pattern in CITED]
    return F.array_distinct(F.concat(*found))


def joined_names(names: Column) -> Column:
    """Names joined by semicolons, ``-`` if there are none."""
    return F.when(F.size(F.coalesce(names, F.array())) > 0, F.array_join(names, "; ")).otherwise("-")


def split_values(text: Column) -> Column:
    """Values parted by semicolons, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ";"), trimmed), lambda x: x != "")


def size_text(n: Column, largest: str = "GB") -> Column:
    """Bytes in words: KB and MB with one decimal, GB with two; no unit above ``largest`` is used."""
    units = [("KB", "%.1f KB"), ("MB", "%.1f MB"), ("GB", "%.2f GB")]
    units = units[: [unit for unit, _ in units].index(largest) + 1]
    out = F.format_string(units[-1][1], n / 1024 ** len(units))
    for power in range(len(units) - 1, 0, -1):
        out = F.when(n < 1024 ** (power + 1), F.format_string(units[power - 1][1], n / 1024**power)).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def file_size_text(n: Column) -> Column:
    """Bytes with two decimals in the largest unit, GB at most, that leaves one or more."""
    out = F.format_string("%.2f B", n.cast("double"))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = F.when(n >= 1024**power, F.format_string(f"%.2f {unit}", n / 1024**power)).otherwise(out)
    return out


def speed_text(n: Column) -> Column:
    return F.concat(size_text(n), F.lit("/s"))


def _whole(x: Column) -> Column:
    """Rounded to a whole number, halves upward, as text."""
    return F.floor(x + 0.5).cast("string")


def duration_text(seconds: Column) -> Column:
    """Seconds in words, in two units at most; null for a negative time."""
    minutes, rest = F.floor(seconds / 60).cast("string"), F.floor(seconds % 60 + 0.5)
    hours, left = F.floor(seconds / 3600).cast("string"), F.floor(seconds % 3600 / 60 + 0.5)
    two = lambda a, ua, b, ub: F.when(b > 0, F.concat(a, F.lit(ua + " "), b.cast("string"), F.lit(ub))).otherwise(F.concat(a, F.lit(ua)))
    return F.when(seconds < 0, None).when(seconds < 1, "< 1s").when(seconds < 60, F.concat(_whole(seconds), F.lit("s"))).when(seconds < 3600, two(minutes, "m", rest, "s")).otherwise(two(hours, "h", left, "m"))


def transfer_text(done: Column, total: Column, largest: str = "GB") -> Column:
    """What is done of a total, with the share; without a total only what is done. No unit above ``largest`` is used."""
    share = F.least(F.floor(done / total * 100 + 0.5), F.lit(100)).cast("string")
    return F.when(total <= 0, size_text(done, largest)).otherwise(F.concat(size_text(done, largest), F.lit(" / "), size_text(total, largest), F.lit(" ("), share, F.lit("%)")))


#: Percentage at which a state begins, and states that go on within their step.
STARTS = {"downloaded": 33, "processing": 33, "processed": 66, "importing": 66}
GOING_ON = ("downloading", "processing", "importing")


def _begun(status: Column) -> Column:
    base = F.lit(0)
    for state, at in STARTS.items():
        base = F.when(status == state, at).otherwise(base)
    return base


def _of_step(status: Column, done_files: Column, files: Column, done_patents: Column, patents: Column) -> Column:
    by_patents = (status == "importing") & (patents > 0)
    share = F.when(by_patents, done_patents / F.greatest(patents, F.lit(1)) * 25).when(files > 0, done_files / F.greatest(files, F.lit(1)) * 25).otherwise(0.0)
    return F.when(status.isin(*GOING_ON) & ((files > 0) | (patents > 0)), share).otherwise(0.0)


def progress(status: Column, done_files: Column, files: Column, done_patents: Column, patents: Column) -> Column:
    """Percentage of a batch: where its state begins, and, while a step goes on, up to 25 for the step's share done. Missing numbers count as none."""
    numbers = [F.coalesce(c, F.lit(0)) for c in (done_files, files, done_patents, patents)]
    share = F.least(_of_step(status, *numbers), F.lit(25.0))
    return F.when(status == "completed", 100).otherwise(F.floor(_begun(status) + share + 0.5)).cast("int")


def shown_progress(status: Column, done_files: Column, files: Column, done_patents: Column, patents: Column) -> Column:
    """The percentage as it is shown beside a batch: not rounded, and 99 at most before the end."""
    numbers = [F.coalesce(c, F.lit(0)) for c in (done_files, files, done_patents, patents)]
    return F.when(status == "completed", 100.0).otherwise(F.least(_begun(status) + _of_step(status, *numbers), F.lit(99.0)))


def compact_line(text: Column) -> Column:
    """White space of any kind as one space, none at the ends; null if nothing is left."""
    return non_empty(trimmed(F.regexp_replace(text, r"(?U)\s+", " ")))


def embedding_document(entry: dict[str, Column], kind: str, label: Column, locale: str = "mixed") -> Column:
    """Text of a classification entry that is to be embedded, a line for each of its parts.

    ``entry`` has code, code_norm, version, title_zh, title_en, section, class_code, subclass, main_group and subgroup;
    ``locale`` leaves out the titles of another language (zh, en), or none (mixed).
    """
    # fixed values: the names of the lines and of the parts
    line = lambda name, value: F.concat(F.lit(f"{name}："), value)
    shown = lambda name, part: F.when(non_empty(entry[part]).isNotNull(), F.concat(F.lit(f"{name}="), entry[part]))
    none = F.lit(None).cast("string")
    titles = [line("中文标题", compact_line(entry["title_zh"])) if locale != "en" else none, line("英文标题", compact_line(entry["title_en"])) if locale != "zh" else none]
    parts = F.concat_ws(" ", *[shown(n, p) for n, p in (("section", "section"), ("class", "class_code"), ("subclass", "subclass"), ("main_group", "main_group"), ("subgroup", "subgroup"))])
    return F.concat_ws("\n", F.lit(f"分类类型：{kind.upper()}"), line("分类号", entry["code"]), line("规范分类号", entry["code_norm"]), line("版本", entry["version"]), line("层级", label), *titles, line("结构字段", non_empty(parts)))


#: Log messages of older versions, and what they say now.
MESSAGES = [
    (r"^Start processing step\z", "开始处理步骤"),
    (r"^Extract outer archive package: ([0-9]+) file\(s\)\z", "解压外层压缩包：$1 个文件"),
    (r"^(.+\.ZIP): parsed ([0-9]+) XML, raw patents ([0-9]+), filtered patents ([0-9]+), referenced image files ([0-9]+)\z", "$1：已解析 $2 个 XML，原始专利 $3 条，筛选后 $4 条，引用附图文件 $5 个"),
    (r"^(.+\.ZIP): parsed ([0-9]+) XML, processed ([0-9]+) referenced image\(s\), uploaded ([0-9]+), skipped ([0-9]+), failed ([0-9]+), total patents ([0-9]+)\z", "$1：已解析 $2 个 XML，处理引用附图 $3 张，上传 $4 张，跳过 $5 张，失败 $6 张，累计专利 $7 条"),
    (r"^(.+\.ZIP): parsed ([0-9]+) XML, filtered patents ([0-9]+), skipped image upload, total patents ([0-9]+)\z", "$1：已解析 $2 个 XML，筛选后专利 $3 条，已跳过附图上传，累计专利 $4 条"),
    (r"^Processing completed: patents=([0-9]+), uploadedImages=([0-9]+), skippedImages=([0-9]+), filteredOut=([0-9]+)\z", "处理完成：$1 条专利，上传附图 $2 张，跳过附图 $3 张，过滤掉 $4 条不符合条件的专利"),
]
#: Messages whose words were lost, and what the numbers behind the archive's name say.
UPLOADS = ": 附图上传进度 {}/{}，上传 {}，跳过 {}，失败 {}"
FILTERED = "：已解析 {} 个 XML，原始专利 {} 条，筛选后 {} 条，引用附图文件 {} 个"
HANDLED = "：已解析 {} 个 XML，处理引用附图 {} 张，上传 {} 张，跳过 {} 张，失败 {} 张，累计专利 {} 条"
INNER = (r"^.*ZIP:(?U)\s*([^\s]+\.ZIP)\z", "开始处理内层 ZIP：$1")
#: Beginnings and parts of messages in a wrong encoding, and what they say.
BEGINNINGS = [("澶勭悊澶辫触:", "处理失败："), ("瀵煎叆澶辫触:", "导入失败："), ("婢跺嫮鎮婃径杈\ue0a5Е:", "处理失败：")]
PARTS = [("涓撳埄闄勫浘涓婁紶澶辫触", "专利附图上传失败"), ("You did not provide the number of bytes specified by the Content-Length HTTP header.", "对象存储上传失败：请求体长度与 Content-Length 不一致")]


def log_message(message: Column) -> Column:
    """Log messages of older versions in today's wording; all others as they are."""
    out = message
    for old, new in BEGINNINGS:
        out = F.when(out.startswith(old), F.concat(F.lit(new), F.substring(out, len(old) + 1, 1 << 30))).otherwise(out)
    for old, new in PARTS:  # the first only
        out = F.when(F.instr(out, old) > 0, F.concat(F.substring_index(out, old, 1), F.lit(new), F.substring(out, F.instr(out, old) + len(old), F.lit(1 << 30)))).otherwise(out)
    out = F.when(message.rlike(INNER[0]) & ~message.startswith("开始"), F.regexp_replace(message, *INNER)).otherwise(out)
    archive = F.regexp_extract(message, r"^(.+?\.ZIP)", 1)
    numbers = F.regexp_extract_all(F.substring(message, F.instr(message, ".ZIP") + 4, F.lit(1 << 30)), F.lit("[0-9]+"), 0)
    say = lambda words, n: F.concat(archive, F.format_string(words.replace("{}", "%s"), *[F.get(numbers, F.lit(i)) for i in range(n)]))
    xml, lost = message.contains("XML"), message.contains("????")
    is_archive = archive != ""
    out = F.when(is_archive & xml & lost & (F.size(numbers) >= 6), say(HANDLED, 6)).otherwise(out)
    out = F.when(is_archive & xml & lost & (F.size(numbers) == 4), say(FILTERED, 4)).otherwise(out)
    out = F.when(is_archive & message.contains("/") & ~xml & (F.size(numbers) >= 5), say(UPLOADS, 5)).otherwise(out)
    for pattern, wording in reversed(MESSAGES):
        out = F.when(message.rlike(pattern), F.regexp_replace(message, pattern, wording)).otherwise(out)
    return out


def is_uuid(text: Column) -> Column:
    """Whether a text has the shape of a UUID, whatever the case."""
    return text.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z")
