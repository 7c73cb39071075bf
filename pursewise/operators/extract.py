"""Extraction jobs over captured responses (X-1 .. X-12), all JVM-side.

A table of responses goes in; rows, headers, options and receipt lines come out through
``regexp_extract_all`` + ``posexplode`` + higher-order functions, so every response is
parsed inside whole-stage code on the executor that read it, with no Python per row.
Pages whose rows the patterns cannot read (nested tables, unclosed rows or cells, elements
nested in a cell, comments, scripts) are told apart in the plan (``needs_parser``), and only
these go to a small parser helper, in Arrow batches of the same pass over the table.
"""

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from pursewise.functions.htmlrows import HEADER_CLASS, ROW_CLASS_PART, parse_page
from pursewise.functions.text import clean_text, decode_entities, digit_runs, strip_blank
from pursewise.session import ship_package

# The markers of a dataset page, the ids of the form selects, the query
# option indexes (expenditures, treasury receipts) and the receipts XML elements.
NO_RECORD_TEXT = "There is no record with given values"
SELECT_QUERY = "ddlQuery"
SELECT_TREASURY = "cmbHOD"
SELECT_DEPARTMENT = "cmbDpt"
SELECT_TREASURY_CODE = "ddlTreaCode"
SELECT_DDO = "ddlDDOCode"
QUERY_INDEX_EXPENDITURES = 9
QUERY_INDEX_TREASURY_RECEIPTS = 1
XML_MAJOR_DETAIL = "ReceiptMajorDetail"
XML_MAJOR = "Major"
XML_SUB_MINOR_DETAIL = "ReceiptSubMinorDetail"

_TABLE = r"(?is)<table\b.*?</table>"
# Attribute values may be double-quoted, single-quoted or bare.
_ROW = (r"(?is)<tr\b[^>]*?\bclass\s*=\s*(?:\"[^\"]*" + ROW_CLASS_PART + r"[^\"]*\"|'[^']*"
        + ROW_CLASS_PART + r"[^']*'|[^\s>\"']*" + ROW_CLASS_PART + r"[^\s>\"']*)[^>]*>(.*?)</tr>")
_HEADER_ROW = (r"(?is)<tr\b[^>]*?\bclass\s*=\s*(?:\"" + HEADER_CLASS + r"\"|'" + HEADER_CLASS
               + r"'|" + HEADER_CLASS + r"(?=[\s>]))[^>]*>(.*?)</tr>")
_CELL = r"(?is)<td\b[^>]*>(.*?)</td>"
# Void tags (<br>, <img>, ...) and removed child elements are replaced by one separator
# character: inside a child element it goes with the element, outside it splits text
# nodes as the markup did. None of the patterns below repeats a group, so the regex engine never recurses
# per tag or per character: a cell of any length or tag count is safe.
_SEP = "\u0001"
_VOID = r"(?i)<(?:br|img|hr|wbr|input|meta|col|area)\b[^>]*+>"
# A child element with no element inside it; removed once per nesting depth.
_LEAF_ELEMENT = r"(?is)<([a-z][a-z0-9]*)\b[^>]*+>[^<]*+</\1\s*+>"
# The first run of text at the start or after a tag or a void separator.
_FIRST_TEXT = r"(?s)(?:^|[>\u0001])([^<\u0001]+)"
_TEXT_NODE = r"(?s)>([^<]+)<"


def tables_of(body: Column) -> Column:
    """The ``<table>`` blocks of a page (rows outside a table do not count)."""
    return F.regexp_extract_all(body, F.lit(_TABLE), 0)


def data_rows(body: Column) -> Column:
    """X-1: inner HTML of every ``tr`` whose class contains ``pope``, in page order."""
    return F.flatten(F.transform(tables_of(body),
                                 lambda t: F.regexp_extract_all(t, F.lit(_ROW), 1)))


def _bare(cell_html: Column) -> Column:
    """A cell without its child elements; a removed one still ends the text node before it, so it
    becomes a separator. A ``<`` that is left is markup these patterns cannot read."""
    return F.regexp_replace(F.regexp_replace(cell_html, _VOID, _SEP), _LEAF_ELEMENT, _SEP)


def cell_texts(cells: Column) -> Column:
    """X-2 for the cells of a row: the first direct text node of each, ``' '`` when it has none, and
    null when the cell holds markup these patterns cannot read (elements inside elements, a stray ``<``).

    Child elements are removed first, so ``<b>x</b> tail`` gives `` tail`` and ``a<br>b``
    gives ``a``; entities are decoded last. Each step goes over the array, so that the patterns
    run once a cell however often the next step names what they gave.
    """
    # Most cells are plain text: the patterns only run on cells that hold markup.
    bared = F.transform(cells, lambda c: F.struct(c.alias("html"), F.when(c.contains("<"), _bare(c)).alias("bare")))
    texts = F.transform(bared, lambda c: F.when(c["bare"].isNull(), c["html"]).when(
        ~c["bare"].contains("<"), F.regexp_extract(c["bare"], _FIRST_TEXT, 1)))
    return F.transform(texts, lambda t: F.when(t == "", F.lit(" ")).otherwise(decode_entities(t)))


def row_cells(row_html: Column) -> Column:
    """Cells of one row, each by the X-2 rule (every ``td`` gives one, so rows align)."""
    return cell_texts(F.regexp_extract_all(row_html, F.lit(_CELL), 1))


# A page in which each table, row and cell has its end tag and none holds its like. Groups are only
# repeated possessively, which the regex engine does in a loop; the next tag decides, so no way is missed.
_OTHER = r"(?:[^<]++|<(?!/?t(?:able|r|d)\b))*+"
_PAIRED_CELL = rf"<td\b{_OTHER}</td\b{_OTHER}"
_PAIRED_ROW = rf"<tr\b{_OTHER}(?:{_PAIRED_CELL})*+</tr\b{_OTHER}"
_PAIRED_TABLE = rf"<table\b{_OTHER}(?:{_PAIRED_CELL}|{_PAIRED_ROW})*+</table\b{_OTHER}"
_PAIRED = rf"(?i)\A{_OTHER}(?:{_PAIRED_CELL}|{_PAIRED_ROW}|{_PAIRED_TABLE})*+\z"
# What hides markup, or a reference without its ``;``. It is looked for at three characters only.
_HIDING = (r"(?i)(?=[<=&])(?:<(?:!--|!\[|(?:script|style|textarea|title|th|xmp)\b)|=\s*+(?:\"[^\"<>]*+>|'[^'<>]*+>)"
           r"|&[A-Za-z][A-Za-z0-9]*+(?!;))")


def needs_parser(body: Column) -> Column:
    """Pages with data or heading rows whose markup is not simply nested (a start or end tag of
    a table, row or cell is missing, or one holds its like), hides markup in comments, scripts
    or attribute values, or names an entity without its ``;``."""
    marked = body.contains(ROW_CLASS_PART) | body.contains(HEADER_CLASS)
    return F.coalesce(marked & (~body.rlike(_PAIRED) | body.rlike(_HIDING)), F.lit(False))


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _parsed_pages(body: pd.Series) -> pd.Series:
    """One reading of each page: its headings, then its rows."""
    return body.map(lambda b: None if b is None else parse_page(b))


def with_cells(responses: DataFrame, body: str = "body", name: str = "_cells", head: str | None = None) -> DataFrame:
    """X-1 + X-2: ``responses`` with the cells of all data rows (array of arrays), page order;
    with ``head``, a column of that name for the page's headings (X-3).

    The patterns read every page; the parser gets only the body of those that need it
    (null for all others, so nothing else is sent to Python). Headings and rows of a page come
    from the same reading.
    """
    ship_package(responses.sparkSession)
    b = F.col(body)
    native = F.transform(data_rows(b), lambda r: row_cells(r))
    # a generator of one row: both are computed once a page, whatever reads them
    both = F.struct(native.alias("_native"), needs_parser(b).alias("_odd"))
    out = responses.select("*", F.inline(F.array(both)))
    out = out.withColumn("_odd", F.col("_odd") | F.coalesce(
        F.exists("_native", lambda r: F.exists(r, lambda c: c.isNull())), F.lit(False)))
    out = out.withColumn("_parsed", _parsed_pages(F.when(F.col("_odd"), b)))
    empty = F.array().cast("array<array<string>>")
    parsed = F.slice("_parsed", 2, F.greatest(F.size("_parsed") - 1, F.lit(0)))
    if head:
        out = out.withColumn(head, F.when(F.col("_odd"), F.get("_parsed", F.lit(0))).otherwise(header_cells(b)))
    return out.withColumn(name, F.coalesce(F.when(F.col("_odd"), parsed).otherwise(F.col("_native")), empty)
                          ).drop("_native", "_odd", "_parsed")


def header_cells(body: Column) -> Column:
    """X-3: every text node inside the cells of the heading rows (class exactly
    ``popupheadingeKosh``), in order, entities decoded; of pages in simply nested markup."""
    rows = F.flatten(F.transform(tables_of(body),
                                 lambda t: F.regexp_extract_all(t, F.lit(_HEADER_ROW), 1)))
    cells = F.flatten(F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(_CELL), 1)))
    texts = F.flatten(F.transform(cells, lambda c: F.regexp_extract_all(
        F.concat(F.lit(">"), c, F.lit("<")), F.lit(_TEXT_NODE), 1)))
    return F.transform(texts, decode_entities)


def extract_rows(responses: DataFrame, keys: Sequence[str] = ("treasury_id", "ddo_code", "from_date", "to_date"),
                 body: str = "body") -> DataFrame:
    """X-1 + X-2: ``(keys..., pos, cells array<string>)``, one row per data row.

    To name the cells by their headings use ``extract_records`` (no join needed).
    """
    rows = with_cells(responses.select(*keys, F.col(body).alias("body")))
    return rows.select(*keys, F.posexplode("_cells").alias("pos", "cells")).select(
        *keys, F.col("pos").cast("int").alias("pos"), "cells")


def extract_header(responses: DataFrame, keys: Sequence[str] = ("treasury_id", "ddo_code", "from_date", "to_date"),
                   body: str = "body") -> DataFrame:
    """X-3: ``(keys..., header array<string>)`` for pages with a heading row."""
    ship_package(responses.sparkSession)
    b = F.col(body)
    pages = responses.select(*keys, header_cells(b).alias("_native"), F.when(needs_parser(b), b).alias("_odd"))
    pages = pages.withColumn("_parsed", _parsed_pages("_odd"))
    h = F.when(F.col("_odd").isNotNull(), F.get("_parsed", F.lit(0))).otherwise(F.col("_native"))
    return pages.select(*keys, h.alias("header")).filter(F.size("header") > 0)


def extract_records(responses: DataFrame, keys: Sequence[str] = ("treasury_id", "ddo_code", "from_date", "to_date"),
                    body: str = "body") -> DataFrame:
    """X-1 + X-3: ``(keys..., pos, record array<struct<heading, cell>>)``.

    The page's headings are read once per response and zipped with each of its rows in
    the same task, so naming the cells needs no join. ``arrays_zip`` keeps rows whose cell
    count differs from the heading count (the missing side is null) and allows repeated
    headings.
    """
    pages = with_cells(responses.select(*keys, F.col(body).alias("body")), head="_h")
    rows = pages.select(*keys, "_h", F.posexplode("_cells").alias("pos", "_row"))
    return rows.select(*keys, F.col("pos").cast("int").alias("pos"),
                       F.arrays_zip(F.col("_h").alias("heading"), F.col("_row").alias("cell")).alias("record"))


def classify(responses: DataFrame, body: str = "body", status: str = "status") -> DataFrame:
    """X-4: ``dataset`` (rows), ``not_available`` (the no-record text), ``unparsed`` (a row
    marker on the page but no row found), ``empty``; responses that failed (status >= 400)
    are ``failed``.

    The rows are those of ``with_cells``, found in the same way (by the parser on the same pages);
    what their cells say is not worked out.
    """
    ship_package(responses.sparkSession)
    b = F.col(body)
    # one flag a row: whether a cell of it holds markup the patterns cannot read
    flags = F.transform(data_rows(b), lambda r: F.exists(
        F.regexp_extract_all(r, F.lit(_CELL), 1), lambda c: c.contains("<") & _bare(c).contains("<")))
    both = F.struct(F.coalesce(flags, F.array().cast("array<boolean>")).alias("_rows"), needs_parser(b).alias("_odd"))
    out = responses.select("*", F.inline(F.array(both)))  # computed once a page
    out = out.withColumn("_odd", F.col("_odd") | F.exists("_rows", lambda f: f))
    out = out.withColumn("_parsed", _parsed_pages(F.when(F.col("_odd"), b)))
    n_rows = F.when(F.col("_odd"), F.size("_parsed") - 1).otherwise(F.size("_rows"))
    has = lambda text: F.coalesce(b.contains(text), F.lit(False))
    kind = (F.when(F.col(status) >= 400, F.lit("failed"))
            .when(n_rows > 0, F.lit("dataset"))
            .when(has(NO_RECORD_TEXT), F.lit("not_available"))
            .when(has(ROW_CLASS_PART), F.lit("unparsed"))
            .otherwise(F.lit("empty")))
    return out.withColumn("response_status", kind).drop("_rows", "_odd", "_parsed")


def counters(classified: DataFrame, treasuries: DataFrame, key: str = "treasury_id",
             treasury_key: str = "treasury_id") -> DataFrame:
    """X-5: per treasury, datasets and not-available pages; 0 for treasuries with neither.

    Counting is a partial aggregate per task, so a hot treasury costs one row per task.
    """
    st = F.col("response_status")
    counts = classified.groupBy(F.col(key).alias(treasury_key)).agg(
        F.count_if(st == "dataset").alias("dataset_count"),
        F.count_if(st == "not_available").alias("dataset_not_avail_count"))
    out = treasuries.select(treasury_key).distinct().join(counts, treasury_key, "left")
    return out.select(treasury_key,
                      F.coalesce("dataset_count", F.lit(0)).cast("long").alias("dataset_count"),
                      F.coalesce("dataset_not_avail_count", F.lit(0)).cast("long")
                      .alias("dataset_not_avail_count"))


def failures(responses: DataFrame, status: str = "status") -> DataFrame:
    """X-11: responses that failed with an HTTP error (non-2xx/3xx)."""
    return responses.filter(F.col(status) >= 400)


def failure_counts(responses: DataFrame, key: str = "treasury_id", status: str = "status") -> DataFrame:
    """X-11: failed responses per treasury."""
    return failures(responses, status).groupBy(key).agg(F.count(F.lit(1)).alias("failed_count"))


# What hides markup on a form page: comments and elements that hold text only.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b[^>]*+>.*?(?:</\1\s*+>|\z)"
_GROUP = r"(?is)<optgroup\b[^>]*+>.*?(?:</optgroup\s*+>|\z)"
# Rest of a start tag: an attribute value in quotes may hold a ``>``. The group is repeated once
# for each attribute at most.
_TAG_REST = r"(?s)^((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>(.*)$"
_ATTRIBUTE = r"(?s)[^\s\"'>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?"


def _select_block(body: Column, select_id: str) -> Column:
    """What stands in a select: up to its end tag, the next select or the end of the page."""
    shown = F.when(body.rlike(_HIDDEN), F.regexp_replace(body, _HIDDEN, _SEP)).otherwise(body)
    ident = r"(?-i:\"" + select_id + r"\"|'" + select_id + r"'|" + select_id + r"(?=[\s>]))"
    block = F.regexp_extract(shown, r"(?is)<select\b[^>]*?(?<![\w-])id\s*=\s*" + ident
                             + r"[^>]*+>(.*?)(?:</?select\b|\z)", 1)
    return F.regexp_replace(block, _GROUP, "</option>")  # options of a group are no children of the select


def _attribute(rest: Column, name: str) -> Column:
    """Value of a tag's first attribute ``name``, without its quotes; null without one."""
    own = F.filter(F.regexp_extract_all(rest, F.lit(_ATTRIBUTE), 0), lambda a: a.rlike(f"(?is)^{name}\\s*+="))
    value = F.regexp_extract(F.get(own, F.lit(0)), r"(?s)=\s*+(.*)$", 1)
    return F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2")


def options(forms: DataFrame, select_id: str, skip_placeholder: bool,
            keys: Sequence[str] = (), body: str = "body") -> DataFrame:
    """X-6: ``(keys..., position, value, text)`` for every option of a select by id.

    Position 0 is the placeholder for treasuries and DDOs (dropped with
    ``skip_placeholder``); for departments it is kept. Text is cleaned (E-9).

    HTML lets an option go without its end tag, and a select on a page cut off too. The tags are
    scanned by cutting the select's content where an option starts, so an option lasts to its end
    tag, the next option or the end of the select, whichever comes first, in one pass over the
    text (a fold would copy the options found so far for each one). Options in comments or in a
    group are left out. An option without ``value`` has a null one, one without text the empty text.
    """
    block = _select_block(F.col(body), select_id)
    pieces = F.split(block, r"(?i)<option(?=[\s>/])")
    pieces = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    # attributes and content; a tag with an unpaired quote ends at its first ``>``
    cut = F.transform(pieces, lambda p: F.struct(
        F.coalesce(F.nullif(F.regexp_extract(p, _TAG_REST, 1), F.lit("")), F.regexp_extract(p, r"(?s)^([^>]*+)>", 1)).alias("rest"),
        F.regexp_extract(F.when(p.rlike(_TAG_REST), F.regexp_extract(p, _TAG_REST, 2))
                         .otherwise(F.regexp_extract(p, r"(?s)^[^>]*+>(.*)$", 1)), r"(?is)^(.*?)(?:</option\b|\z)", 1).alias("inner")))
    rows = forms.select(*keys, F.posexplode(cut).alias("position", "_opt"))
    if skip_placeholder:
        rows = rows.filter(F.col("position") > 0)
    # the first text node inside the option, at any depth (``.//text()``, first)
    text = F.regexp_extract(F.col("_opt.inner"), _FIRST_TEXT, 1)
    return rows.select(*keys, F.col("position").cast("int").alias("position"),
                       decode_entities(_attribute(F.col("_opt.rest"), "value")).alias("value"),
                       clean_text(decode_entities(text)).alias("text"))


def query_option(forms: DataFrame, index: int, select_id: str = SELECT_QUERY,
                 keys: Sequence[str] = ()) -> DataFrame:
    """X-7: the query offered at a fixed index (9 for expenditures, 1 for receipts)."""
    o = options(forms, select_id, skip_placeholder=False, keys=keys)
    return o.filter(F.col("position") == index).select(
        *keys, F.col("value").alias("query_id"), F.col("text").alias("query_name"))


def ddo_list(forms: DataFrame, key: str = "treasury_code") -> DataFrame:
    """X-8: (treasury_code, code, name) for every DDO of a treasury's form."""
    o = options(forms, SELECT_DDO, skip_placeholder=True, keys=(key,))
    return o.select(key, F.col("value").alias("ddo_code"), F.col("text").alias("ddo_name"))


_PREFIX = r"(?:[A-Za-z_][\w.-]*:)?"


def _elements(text: Column, name: str) -> Column:
    """Inner text of every ``name`` element, any namespace prefix. Patterns instead of an
    XML parser: a malformed or truncated response (an error page in place of XML) then
    gives no elements instead of failing the job."""
    return F.regexp_extract_all(
        text, F.lit(r"(?s)<" + _PREFIX + name + r"\b[^>]*+>(.*?)</" + _PREFIX + name + r"\s*>"), 1)


_XML_HIDING = r"(?s)<!--.*?(?:-->|\z)|<!\[CDATA\[.*?(?:\]\]>|\z)"


def plain_xml(body: Column) -> Column:
    """``body`` with each CDATA section as escaped text and each comment empty (it still parts
    the text before from the text after), so that the element patterns read neither as markup."""
    def shown(hiding):
        text = F.regexp_extract(hiding, r"(?s)^<!\[CDATA\[(.*?)(?:\]\]>|\z)", 1)
        for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(char), F.lit(name))
        return F.when(hiding.startswith("<![CDATA["), text).otherwise(F.lit("<!---->"))

    parts = F.split(body, _XML_HIDING)
    hidden = F.transform(F.regexp_extract_all(body, F.lit(_XML_HIDING), 0), shown)
    full = F.array_join(F.flatten(F.zip_with(parts, hidden, lambda p, h: F.array(p, F.coalesce(h, F.lit(""))))), "")
    return F.when(body.contains("<!"), full).otherwise(body)


def _texts(xml: Column) -> Column:
    """The text nodes of some XML, entities decoded."""
    return F.transform(F.regexp_extract_all(F.concat(F.lit(">"), xml, F.lit("<")), F.lit(_TEXT_NODE), 1), decode_entities)


def _majors(body: Column) -> Column:
    """Text nodes of each ``ReceiptMajorDetail/Major``, entities decoded. Responses that do not
    name the element (those of the receipts, which are the bulk) are not searched for it."""
    body = F.when(body.contains(XML_MAJOR_DETAIL), body)
    majors = F.flatten(F.transform(_elements(plain_xml(body), XML_MAJOR_DETAIL), lambda d: _elements(d, XML_MAJOR)))
    return F.transform(majors, _texts)


def major_codes(responses: DataFrame, keys: Sequence[str] = ("public_head_bool", "date"),
                body: str = "body") -> DataFrame:
    """X-9: every run of digits in each ``ReceiptMajorDetail/Major``, namespaces ignored."""
    majors = F.flatten(_majors(F.col(body)))
    return (responses.select(*keys, F.explode(majors).alias("_m"))
            .select(*keys, F.explode(digit_runs(F.col("_m")))
                    .alias("major_code")))


def receipt_rows(responses: DataFrame, keys: Sequence[str] = ("public_head_bool", "date"),
                 body: str = "body", date: str = "date") -> DataFrame:
    """X-10: per ``ReceiptSubMinorDetail``, its non-blank text lines in order with the
    request date put second: ``(keys..., pos, cols array<string>)``."""
    elems = _elements(plain_xml(F.col(body)), XML_SUB_MINOR_DETAIL)
    rows = responses.select(*keys, F.col(date).alias("_date"), F.posexplode(elems).alias("pos", "_e"))
    lines = F.flatten(F.transform(_texts(F.col("_e")), lambda t: F.regexp_extract_all(t, F.lit("([^\n]+)"), 1)))
    lines = F.filter(lines, lambda x: strip_blank(x) != F.lit(""))
    # Python's list.insert(1, date): second place, or last when there is at most one line
    # (array_insert would pad an empty list with a null first).
    cols = F.concat(F.slice(lines, 1, 1), F.array(F.col("_date")), F.slice(lines, 2, F.size(lines)))
    return rows.select(*keys, F.col("pos").cast("int").alias("pos"), cols.alias("cols"))


def receipt_rejects(responses: DataFrame, keys: Sequence[str] = ("public_head_bool", "date"), body: str = "body") -> DataFrame:
    """``(keys..., reason)`` of the responses that are no receipts XML: ``empty`` (no text),
    ``malformed`` (Spark's XML reader calls it corrupt, as an error page or a response cut off
    is) or ``no_receipts`` (XML without a major or a receipt).

    A malformed response still gives the elements that are whole in it, as the reference's
    recovering parser does, so it may have rows as well as a reject.
    """
    reader = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "ignoreNamespace": "true"}
    b = F.col(body)
    read = F.from_xml(b, f"{XML_MAJOR_DETAIL} array<string>, {XML_SUB_MINOR_DETAIL} array<string>, corrupt string", reader)
    out = responses.select(*keys, b.alias("_b"), read.alias("_x"))
    reason = (F.when(F.coalesce(strip_blank(F.col("_b")) == "", F.lit(True)), "empty")
              .when(F.col("_x.corrupt").isNotNull(), "malformed")
              .when(F.col(f"_x.{XML_MAJOR_DETAIL}").isNull() & F.col(f"_x.{XML_SUB_MINOR_DETAIL}").isNull(), "no_receipts"))
    return out.select(*keys, reason.alias("reason")).where("reason is not null")


def split_head(df: DataFrame, col: str = "head") -> DataFrame:
    """X-12: ``Maj-Smj-Min-Smn [Sub Minor Head]`` into major, sub_major, minor, sub_minor,
    sub_minor_desc (major_desc is not in the text; join it from the major list)."""
    pat = r"^\s*([^-]*)-([^-]*)-([^-]*)-([^\[]*?)\s*\[(.*)\]\s*$"
    c = F.col(col)
    return df.select(
        "*",
        F.regexp_extract(c, pat, 1).alias("major"), F.regexp_extract(c, pat, 2).alias("sub_major"),
        F.regexp_extract(c, pat, 3).alias("minor"), F.regexp_extract(c, pat, 4).alias("sub_minor"),
        F.regexp_extract(c, pat, 5).alias("sub_minor_desc"))


def major_list(responses: DataFrame, body: str = "body") -> DataFrame:
    """The (major, major_desc) pairs a receipts response lists as ``code-desc``."""
    m = responses.select(F.explode(F.transform(_majors(F.col(body)), lambda t: F.array_join(t, ""))).alias("_m"))
    return m.select(F.regexp_extract("_m", r"^\s*([^-]*?)\s*-", 1).alias("major"),
                    F.regexp_extract("_m", r"^[^-]*-\s*(.*?)\s*$", 1).alias("major_desc")).distinct()


def with_major_desc(split_rows: DataFrame, majors: DataFrame) -> DataFrame:
    """X-12: the description of each row's major, which the head text lacks, from the
    major list. A left join: a major missing from the list keeps its row with a null.
    The list is one row per major code (a dimension), planned by size."""
    return split_rows.join(majors, "major", "left")
