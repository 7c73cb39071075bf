"""Extraction rules on hand-made captured responses (the round trips run in test_oracles)."""

from pyspark.sql import functions as F

from pursewise.functions.text import clean_text
from pursewise.operators import extract as EX


def _page(cells_html):
    rows = "".join(f'<tr class="pope x"><td>{c}</td></tr>' for c in cells_html)
    return ('<html><table><tr class="popupheadingeKosh"><td>Name <b>A&amp;B</b></td><td>V</td></tr>'
            + rows + '<tr class="other"><td>skip</td></tr></table>'
            + '<tr class="pope"><td>outside a table</td></tr></html>')


CASES = {
    "<b>x</b> tail": " tail",
    "plain": "plain",
    "": " ",
    "a<br>b": "a",
    "<b><i>x</i></b>y": "y",
    "<b>x</b>": " ",
    " <b>x</b>": " ",
    "R&amp;D &lt;1&gt;": "R&D <1>",
    "&amp;lt;": "&lt;",
    "<b>x<br>y</b> tail": " tail",
    "<a>z<b><c><d>x</d></c></b></a>t": "t",
    "a<br/>b": "a",
    "1<b></b>&amp;": "1",
    "<i></i>x<b>y</b>z": "x",
}


def test_cell_text_rule(spark):
    df = spark.createDataFrame([("k", _page(list(CASES)))], "key string, body string")
    rows = EX.extract_rows(df, keys=("key",)).orderBy("pos").collect()
    assert [r["cells"][0] for r in rows] == list(CASES.values())


def test_parser_agrees_with_the_patterns():
    from pursewise.functions.htmlrows import parse_rows

    assert [r[0] for r in parse_rows(_page(list(CASES)))] == list(CASES.values())


ODD_PAGES = {
    "nested table": ('<table><tr class="pope"><td>a<table><tr class="pope"><td>in</td></tr></table></td><td>b</td></tr>'
                     '<tr class="pope"><td>c</td></tr></table>', [["a", "b"], ["in"], ["c"]]),
    "unclosed": ('<table><tr class="popeven"><td>a<td>b<tr class="popeodd"><td>c<td></table>', [["a", "b"], ["c", " "]]),
    "cut off": ("<table><tr class='pope'><td>x", [["x"]]),
    "deep": ("<table><tr class='pope'><td>" + "<i>" * 9 + "o1" + "</i>" * 9 + " tail</td></tr></table>", [[" tail"]]),
    "comment": ("<table><!-- <tr class='pope'><td>no</td></tr> --><tr class='pope'><td>y</td></tr></table>", [["y"]]),
    "script": ("<table><tr class='pope'><td>y</td></tr></table><script>'<table><tr class=\"pope\"><td>no'</script>", [["y"]]),
    "attribute": ("<table><tr title='a>b' class='pope'><td title=\"x>y\">y</td></tr></table>", [["y"]]),
    "section": ("<table><tbody><tr class='pope'><td>1</td><th>h</th></tr></tbody></table>", [["1"]]),
    "less than": ("<table><tr class='pope'><td>a < b</td></tr></table>", [["a < b"]]),
}


def test_odd_markup_loses_no_row(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in ODD_PAGES.items()], "key string, body string")
    got = {}
    for r in EX.extract_rows(df, keys=("key",)).orderBy("pos").collect():
        got.setdefault(r["key"], []).append(r["cells"])
    assert got == {k: v[1] for k, v in ODD_PAGES.items()}


def test_every_reference_is_decoded_once(spark):
    from html import unescape

    from pursewise.functions.text import decode_entities

    texts = ["&#8377; 5", "A&#38;B", "&rsquo;x", "&amp;lt;", "&#x20B9;&#X20b9;", "&nosuch; &", "&#0;&#xD800;&#1114112;&#99999999999;",
             "&#128;&#x99;", "&AMP; &Aacute;&NotEqualTilde;", "&#65 &#65;", "no reference", "", "&lt;b&gt;&quot;&apos;&nbsp;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(decode_entities("t")).collect()]
    assert got == [unescape(t) for t in texts]


def test_header_is_every_text_node(spark):
    df = spark.createDataFrame([("k", _page(["x"]))], "key string, body string")
    h = EX.extract_header(df, keys=("key",)).first()["header"]
    assert h == ["Name ", "A&B", "V"]


def test_classify(spark):
    df = spark.createDataFrame([
        (1, 200, _page(["x"])), (2, 200, f"<p>{EX.NO_RECORD_TEXT}</p>"), (3, 200, "<html></html>"),
        (4, 500, _page(["x"])), (5, 200, '<div class="popeven">moved</div>')], "id int, status int, body string")
    got = {r["id"]: r["response_status"] for r in EX.classify(df).collect()}
    assert got == {1: "dataset", 2: "not_available", 3: "empty", 4: "failed", 5: "unparsed"}


def test_options_and_clean_text(spark):
    body = ('<select id="cmbHOD"><option value="0">--Select--</option>'
            '<option value="T01" selected>  North \n  Treasury\tOne </option></select>')
    df = spark.createDataFrame([(body,)], "body string")
    got = [tuple(r) for r in EX.options(df, "cmbHOD", skip_placeholder=True).collect()]
    assert got == [(1, "T01", "North Treasury\tOne")]
    kept = EX.options(df, "cmbHOD", skip_placeholder=False).count()
    assert kept == 2
    t = spark.createDataFrame([("  a  b\tc \n",)], "s string").select(clean_text("s")).first()[0]
    assert t == "a b\tc"


FORMS = {
    "no end tags": ('<select id="q"><option value=a>A<option value=b>B\n<option value="c">C</select><option value=z>z', [("a", "A"), ("b", "B"), ("c", "C")]),
    "half closed": ("<select id='q'><option value='a'>A</option><option value='b'>B<option value='c'>C</select>", [("a", "A"), ("b", "B"), ("c", "C")]),
    "cut off": ('<select id="q"><option value="a">A</option><option value="b">B', [("a", "A"), ("b", "B")]),
    "next select": ('<select id="q"><option value="a">A<select id="r"><option value="b">B</select>', [("a", "A")]),
    "comments": ('<!-- <select id="q"><option value="x">X</select> --><select id="q"><!-- <option value="y">Y</option> -->'
                 '<option value="a">A<!-- n --> tail</select>', [("a", "A")]),
    "groups": ('<select id="q"><option value="a">A<optgroup label="g"><option value="x">X</optgroup><option value="b">B</select>',
               [("a", "A"), ("b", "B")]),
    "attributes": ("<select data-id='q'><option value=x>x</select><select class=s id=q><option title='x > y' data-value=1 VALUE = 'a \"1\"' selected>A"
                   "<option>none<option value>bare<option value=''></option></select>",
                   [('a "1"', "A"), (None, "none"), (None, "bare"), ("", "")]),
    "markup in text": ('<select id="q"><option value="a&amp;b"><b>A</b>tail<option value="b">\n  R &amp;  D &lt;1&gt; </select>',
                       [("a&b", "A"), ("b", "R & D <1>")]),
    "other case of the id": ('<select id="Q"><option value="a">A</select>', []),
    "stray quote": ('<select id="q"><option value="a>A</option></select>', [(None, "A")]),
    "no options": ('<select id="q"></select>', []),
    "nothing": ("", []),
}


def test_options_of_odd_forms(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in FORMS.items()] + [("null", None)], "key string, body string")
    got = {k: [] for k in FORMS}
    for r in EX.options(df, "q", skip_placeholder=False, keys=("key",)).orderBy("key", "position").collect():
        assert r["position"] == len(got[r["key"]])
        got[r["key"]].append((r["value"], r["text"]))
    assert got == {k: v[1] for k, v in FORMS.items()}


def test_a_form_of_many_options(spark):
    body = '<select id="q">' + "".join(f"<option value={i}>n {i}" for i in range(30_000)) + "</select>"
    df = spark.createDataFrame([(body,)], "body string")
    got = EX.options(df, "q", skip_placeholder=True).agg(F.count("*"), F.max(F.col("value").cast("int")), F.max("position")).first()
    assert tuple(got) == (29_999, 29_999, 29_999)


ODD_HEADINGS = {
    "unclosed": '<table><tr class="popupheadingeKosh"><td>H1<td>H2<tr class="popeven"><td>x<td>y</table>',
    "layout table": ('<table><tr><td>menu</td><td><table><tr class="popupheadingeKosh"><td>H1</td><td>H2</td></tr>'
                     '<tr class="popeven"><td>x</td><td>y</td></tr></table></td></tr></table>'),
    "nested in a heading": ('<table><tr class="popupheadingeKosh"><td>H1<table><tr><td></td></tr></table></td><td>H2</td></tr>'
                            '<tr class="popeven"><td>x</td><td>y</td></tr></table>'),
    "nested in a row": ('<table><tr class="popupheadingeKosh"><td>H1</td><td>H2</td></tr><tr class="popeven"><td>x<table><tr>'
                        '<td>in</td></tr></table></td><td>y</td></tr></table>'),
    "no rows": '<table><tr class="popupheadingeKosh"><th>no</th><td>H1<td>H2</table>',
    "comment": ('<table><!-- <tr class="popupheadingeKosh"><td>no</td></tr> --><tr class="popupheadingeKosh"><td>H1</td><td>H2</td></tr>'
                '<tr class="popeven"><td>x</td><td>y</td></tr></table>'),
    "another class too": ('<table><tr class="popupheadingeKosh x"><td>no</td></tr><tr class="popupheadingeKosh"><td>H1<td>H2</tr>'
                          '<tr class="popeven"><td>x<td>y</tr></table>'),
}


def test_headings_of_odd_pages(spark):
    df = spark.createDataFrame(list(ODD_HEADINGS.items()), "key string, body string")
    got = {r["key"]: r["header"] for r in EX.extract_header(df, keys=("key",)).collect()}
    assert got == {k: ["H1", "H2"] for k in ODD_HEADINGS}
    named = {r["key"]: [tuple(x) for x in r["record"]] for r in EX.extract_records(df, keys=("key",)).where("pos = 0").collect()}
    assert named == {k: [("H1", "x"), ("H2", "y")] for k in ODD_HEADINGS if k != "no rows"}


def test_headings_and_rows_from_one_reading():
    from pursewise.functions.htmlrows import parse_page

    assert parse_page(_page(["x"])) == [["Name ", "A&B", "V"], ["x"]]
    nested = '<table><tr class="popupheadingeKosh"><td>a<table><tr><td>b</td></tr></table>c</td></tr></table>'
    assert parse_page(nested) == [["a", "b", "c"]]


def test_cdata_comments_and_rejects(spark):
    rows = {
        "cdata": ('<r><a:ReceiptMajorDetail xmlns:a="u"><a:Major><![CDATA[0020-A & B ]]>&lt;c></a:Major></a:ReceiptMajorDetail>'
                  '<ReceiptSubMinorDetail><H><![CDATA[0020-1-2-3 [x < y & z]]]></H><T>1.5</T></ReceiptSubMinorDetail></r>',
                  ["0020"], [["0020-1-2-3 [x < y & z]", "d", "1.5"]], None),
        "comments": ('<?xml version="1.0"?><r><!-- <ReceiptMajorDetail><Major>1</Major></ReceiptMajorDetail> --><ReceiptMajorDetail>'
                     '<Major>00<!-- 5 -->21</Major></ReceiptMajorDetail><!--<ReceiptSubMinorDetail><H>a</H></ReceiptSubMinorDetail>-->'
                     '<ReceiptSubMinorDetail><H>h<!-- x --></H>\n\n<T>1</T></ReceiptSubMinorDetail></r>', ["00", "21"], [["h", "d", "1"]], None),
        "comment in cdata": ('<r><ReceiptSubMinorDetail><H><![CDATA[<!-- kept -->]]></H><!-- <![CDATA[gone]]> --><T>2</T></ReceiptSubMinorDetail></r>',
                             [], [["<!-- kept -->", "d", "2"]], None),
        "lines": ("<r><ReceiptSubMinorDetail><H>a&#10;b\n c</H></ReceiptSubMinorDetail></r>", [], [["a", "d", "b", " c"]], None),
        "none": ("<r><ReceiptSubMinorDetail/></r>", [], [], None),
        "error page": ("<html><body>Server Error<br></body>", [], [], "malformed"),
        "another page": ("<html><body>moved</body></html>", [], [], "no_receipts"),
        "cut off": ("<r><ReceiptMajorDetail><Major>0020-x</Major></ReceiptMajorDetail><Rec", ["0020"], [], "malformed"),
        "open comment": ("<r><ReceiptMajorDetail><Major>7</Major></ReceiptMajorDetail><!-- <ReceiptMajorDetail><Major>8</Major></ReceiptMajorDetail>",
                         ["7"], [], "malformed"),
        "blank": (" \n", [], [], "empty"), "null": (None, [], [], "empty"),
    }
    df = spark.createDataFrame([(k, "d", v[0]) for k, v in rows.items()], "key string, date string, body string")
    majors, details = {k: [] for k in rows}, {k: [] for k in rows}
    for r in EX.major_codes(df, ("key",)).collect():
        majors[r["key"]].append(r["major_code"])
    for r in EX.receipt_rows(df, ("key",)).orderBy("pos").collect():
        details[r["key"]].append(r["cols"])
    assert majors == {k: v[1] for k, v in rows.items()}
    assert details == {k: v[2] for k, v in rows.items()}
    assert {r["key"]: r["reason"] for r in EX.receipt_rejects(df, ("key",)).collect()} == {k: v[3] for k, v in rows.items() if v[3]}
    assert {r["major"]: r["major_desc"] for r in EX.major_list(df).where("major = '0020'").collect()} in ({"0020": "A & B <c>"}, {"0020": "x"})


def test_xml_rows_and_majors(spark):
    xml = ('<?xml version="1.0"?><r xmlns="http://tempuri.org/">'
           '<ReceiptMajorDetail><Major>0020-Misc 7</Major></ReceiptMajorDetail>\n'
           '<ReceiptSubMinorDetail>\n  <H>0020-00-101-01 [Tax &amp; Duty]</H>\n   \n'
           '  <T>12.50</T></ReceiptSubMinorDetail>'
           '<ReceiptSubMinorDetail><H>0021-00-1-02 [x]\nsecond line</H><T>1</T></ReceiptSubMinorDetail></r>')
    df = spark.createDataFrame([("0", "01/04/2019", xml)], "public_head_bool string, date string, body string")
    majors = [r["major_code"] for r in EX.major_codes(df).collect()]
    assert majors == ["0020", "7"]
    rows = [r["cols"] for r in EX.receipt_rows(df).orderBy("pos").collect()]
    assert rows[0] == ["0020-00-101-01 [Tax & Duty]", "01/04/2019", "12.50"]
    assert rows[1] == ["0021-00-1-02 [x]", "01/04/2019", "second line", "1"]
    split = EX.split_head(spark.createDataFrame([(rows[0][0],)], "head string")).first()
    assert (split["major"], split["sub_major"], split["minor"], split["sub_minor"],
            split["sub_minor_desc"]) == ("0020", "00", "101", "01", "Tax & Duty")


def test_unquoted_and_single_quoted_attributes(spark):
    body = ("<table><tr class=popupheadingeKosh><td>H</td></tr>"
            "<tr class=popeven><td>a</td></tr><tr class='x popeodd'><td>b</td></tr>"
            "<tr class=popup><td>no</td></tr></table>"
            "<select id=cmbDpt><option value=D01>One</option><option value='D02'>Two</option></select>")
    df = spark.createDataFrame([("k", body)], "key string, body string")
    rows = [r["cells"] for r in EX.extract_rows(df, keys=("key",)).orderBy("pos").collect()]
    assert rows == [["a"], ["b"]]
    assert EX.extract_header(df, keys=("key",)).first()["header"] == ["H"]
    opts = [(r["position"], r["value"], r["text"]) for r in
            EX.options(df, "cmbDpt", skip_placeholder=False).orderBy("position").collect()]
    assert opts == [(0, "D01", "One"), (1, "D02", "Two")]


def test_major_desc_joined_from_major_list(spark):
    xml = ('<r xmlns="urn:x"><ReceiptMajorDetail><Major>0020 - Stamps and Registration</Major></ReceiptMajorDetail>'
           '<ReceiptMajorDetail><Major>0021-Taxes</Major></ReceiptMajorDetail>'
           '<ReceiptSubMinorDetail><H>0020-00-101-01 [Court fees]</H><T>5</T></ReceiptSubMinorDetail>'
           '<ReceiptSubMinorDetail><H>0039-00-1-02 [x]</H><T>1</T></ReceiptSubMinorDetail></r>')
    df = spark.createDataFrame([("0", "01/04/2019", xml)], "public_head_bool string, date string, body string")
    rows = EX.receipt_rows(df).select(F.col("cols")[0].alias("head"))
    out = EX.with_major_desc(EX.split_head(rows), EX.major_list(df))
    got = sorted((r["major"], r["major_desc"]) for r in out.collect())
    assert got == [("0020", "Stamps and Registration"), ("0039", None)]


def test_long_cells_do_not_overflow_the_regex_stack(spark):
    big = "x" * 100000
    body = f'<table><tr class="pope"><td><b>{big}</b> tail</td><td>a<br>{big}</td><td>{big}</td></tr></table>'
    df = spark.createDataFrame([("k", body)], "key string, body string")
    cells = EX.extract_rows(df, keys=("key",)).first()["cells"]
    assert [len(c) for c in cells] == [5, 1, 100000]


def test_malformed_responses_do_not_fail_the_job(spark):
    df = spark.createDataFrame(
        [("0", "01/04/2019", "<html><body>Server Error</body>"),
         ("0", "02/04/2019", "<r><ReceiptMajorDetail><Major>0020-x</Major></ReceiptMajorDetail>"),
         ("0", "03/04/2019", None)],
        "public_head_bool string, date string, body string")
    assert [r["major_code"] for r in EX.major_codes(df).collect()] == ["0020"]
    assert EX.receipt_rows(df).count() == 0
    pages = spark.createDataFrame([("k", "<table><tr class='pope'><td>x", 200), ("j", None, 200)],
                                  "key string, body string, status int")
    assert [r["cells"] for r in EX.extract_rows(pages, keys=("key",)).collect()] == [["x"]]
    assert {r["key"]: r["response_status"] for r in EX.classify(pages).collect()} == {"k": "dataset", "j": "empty"}


def test_many_tags_in_a_cell_do_not_overflow_the_regex_stack(spark):
    brs = "<br>" * 20000
    body = f'<table><tr class="pope"><td>{brs}t</td><td><b>x{brs}y</b> tail</td></tr></table>'
    df = spark.createDataFrame([("k", body)], "key string, body string")
    assert EX.extract_rows(df, keys=("key",)).first()["cells"] == ["t", " tail"]


def test_receipt_responses_are_not_searched_for_majors(spark):
    from pursewise.operators.extract import major_list

    major = "<A><x:ReceiptMajorDetail><Major><![CDATA[01-a]]></Major></x:ReceiptMajorDetail></A>"
    rows = spark.createDataFrame([(major,), ("<A><ReceiptSubMinorDetail><!-- -->1</ReceiptSubMinorDetail></A>",), (None,)], "body string")
    out = major_list(rows)
    assert [tuple(r) for r in out.collect()] == [("01", "a")]
    assert "Contains" in out._jdf.queryExecution().optimizedPlan().toString()


def test_paired_tags_are_told_as_by_cutting_out_pairs(spark):
    import random
    import re

    def paired(page):  # cells first, then rows, then tables
        shape = "".join(re.findall(r"(?i)</?t(?:able|r|d)\b", page)).lower()
        for pair in ("<td</td", "<tr</tr", "<table</table"):
            shape = shape.replace(pair, "")
        return shape == ""

    rnd = random.Random(7)
    some = ["<table>", "</table>", "<tr class='pope'>", "</tr>", "<td>", "</td>", "<TD>x</tD >", "<tr><td></td><td>1</td></tr>",
            "<table border=1><tr></tr></table>", "<b>", "</b>", "<tdx>", "</track>", " a < b ", "x", "\n", "<", "<t", "</"]
    pages = ["pope" + "".join(rnd.choices(some, k=rnd.randint(0, 9))) for _ in range(4000)]
    got = spark.createDataFrame([(p,) for p in pages], "body string").select("body", EX.needs_parser(F.col("body"))).collect()
    assert {r[0]: r[1] for r in got} == {p: not paired(p) for p in pages}
    assert 100 < sum(r[1] for r in got) < len(pages) - 100
    large = spark.createDataFrame([("<table>" + "<tr class='pope'><td>1</td><td><b>2</b></td></tr>\n" * 20_000 + "</table>",)], "body string")
    assert not large.select(EX.needs_parser(F.col("body"))).first()[0]


def test_status_goes_by_the_rows_without_their_texts(spark):
    pages = [_page(list(CASES)), *(p for p, _ in ODD_PAGES.values()), None, "", "<p>pope</p>", EX.NO_RECORD_TEXT, "<table></table>",
             "<table><tr data-x='class=\"pope\"'><td><i><b>1</b></i></td></tr></table>"]
    df = spark.createDataFrame([(i, 200, p) for i, p in enumerate(pages)], "n int, status int, body string")
    found = {r["n"]: r["rows"] for r in EX.with_cells(df).select("n", F.size("_cells").alias("rows")).collect()}
    status = {r["n"]: r["response_status"] for r in EX.classify(df).collect()}
    assert {n for n, s in status.items() if s == "dataset"} == {n for n, rows in found.items() if rows > 0}
    assert EX.classify(df).columns == ["n", "status", "body", "response_status"]
    plan = EX.classify(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "(?:^|[>" not in plan and "from_json" not in plan
