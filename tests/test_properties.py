"""Property tests: JVM-side expressions against their plain-Python definitions.

Each hypothesis example is a batch of generated values evaluated in one Spark job.
"""

import json
import re
from urllib.parse import quote_plus

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pursewise.functions.htmlrows import parse_rows
from pursewise.functions.text import clean_text, file_part, url_encode
from pursewise.operators import extract as EX
from pursewise.operators.tree import tree_json_fragments

TEXT = st.text(alphabet=st.sampled_from(list("ab Z09,/-_.*~&%+\t\n\r#")), max_size=30)
BATCH = st.lists(TEXT, min_size=1, max_size=40)
SETTINGS = settings(max_examples=int(__import__("os").environ.get("PW_EXAMPLES", "6")), deadline=None)


def _eval(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def _cleaned(text: str, clean: str) -> bool:
    """Ends bare, no two blanks in a row, the same words, single blanks as they were."""
    bare = clean == clean.strip() and not re.search(r"\s\s", clean)
    return bare and clean.split() == text.split() and all(x in text for x in re.findall(r"\S[\t\n\r]\S", clean))


@SETTINGS
@given(BATCH)
def test_clean_text_properties(spark, values):
    assert all(_cleaned(v, c) for v, c in zip(values, _eval(spark, values, clean_text)))


def test_clean_text_examples(spark):
    cases = {" a": "a", "a\tb": "a\tb", "a \t b": "a b", "\n\n": "", "a\n\nb c ": "a b c", "": ""}
    assert _eval(spark, list(cases), clean_text) == list(cases.values())


@SETTINGS
@given(BATCH)
def test_file_part_properties(spark, values):
    for v, got in zip(values, _eval(spark, values, file_part)):
        kept = [c for c in v if c != ","]
        assert len(got) == len(kept) and not set(got) & set(", /")
        assert all(g == "_" if k in " /" else g == k for g, k in zip(got, kept))


@SETTINGS
@given(BATCH)
def test_url_encode_matches_quote_plus(spark, values):
    assert _eval(spark, values, url_encode) == [quote_plus(v) for v in values]


WORD = st.text(alphabet=st.sampled_from(list("xyz 12")), min_size=0, max_size=4)
CELL = st.recursive(
    st.one_of(WORD, st.sampled_from(["&amp;", "&lt;", "<br>", ""])),
    lambda inner: st.one_of(
        st.tuples(st.sampled_from(["b", "i", "span"]), inner).map(lambda t: f"<{t[0]}>{t[1]}</{t[0]}>"),
        st.tuples(inner, inner).map(lambda t: t[0] + t[1])),
    max_leaves=6)


@SETTINGS
@given(st.lists(st.lists(CELL, min_size=1, max_size=4), min_size=1, max_size=10))
def test_cell_rule_matches_stdlib_parser(spark, rows):
    body = "<table>" + "".join(
        '<tr class="pope">' + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    df = spark.createDataFrame([("k", body)], "key string, body string")
    got = [r["cells"] for r in EX.extract_rows(df, keys=("key",)).orderBy("pos").collect()]
    assert got == parse_rows(body)


LABEL = st.sampled_from(["a", "b", "c", "a b", 'q"', ""])


@SETTINGS
@given(st.lists(st.tuples(LABEL, LABEL, LABEL), min_size=1, max_size=25))
def test_tree_document_matches_nested_dict(spark, paths):
    df = spark.createDataFrame(paths, "l1 string, l2 string, l3 string")
    frags = tree_json_fragments(df).orderBy("path").collect()
    want = {}
    for p in paths:
        cur = want
        for x in p:
            cur = cur.setdefault(x, {})
    assert json.loads("{" + "".join(f["fragment"] for f in frags) + "}") == want


DAY0 = __import__("datetime").date(2019, 11, 1)
FACT = st.tuples(st.sampled_from(["A", "B", "C"]), st.integers(0, 480), st.integers(-50, 500))


def _brute_series(facts, start, end, grain):
    import datetime as dt
    from collections import defaultdict

    def key(d):
        return d - dt.timedelta(days=(d.weekday() + 1) % 7) if grain == "week" else d.replace(day=1)

    def step(d):
        if grain == "week":
            return d + dt.timedelta(days=7)
        return (d.replace(day=28) + dt.timedelta(days=4)).replace(day=1)

    slots, s = [], key(start)
    while s <= key(end):
        slots.append(s)
        s = step(s)
    sums = defaultdict(int)
    for dist, day, amt in facts:
        d = DAY0 + dt.timedelta(days=day)
        if start <= d <= end:
            sums[(dist, key(d))] += amt
    dists = sorted({k[0] for k in sums})
    label = (lambda s: int(min(s + dt.timedelta(days=6), end).strftime("%U"))) if grain == "week" \
        else (lambda s: s.month)
    return sorted((d, i, s, label(s), float(sums.get((d, s), 0))) for d in dists for i, s in enumerate(slots))


@SETTINGS
@given(st.lists(FACT, min_size=0, max_size=60), st.integers(0, 480), st.integers(0, 120),
       st.sampled_from(["week", "month"]))
def test_series_matches_brute_force(spark, facts, first, span, grain):
    import datetime as dt
    from decimal import Decimal

    from pursewise.operators.facts import FactSpec, series

    start = DAY0 + dt.timedelta(days=first)
    end = start + dt.timedelta(days=span)
    rows = [(d, DAY0 + dt.timedelta(days=day), Decimal(a)) for d, day, a in facts]
    df = spark.createDataFrame(rows, "district string, transdate date, gross decimal(18,2)")
    spec = FactSpec("transdate", ("gross",), ("district",))
    got = sorted(tuple(r) for r in series(df, spec, grain, start, end).collect())
    assert got == _brute_series(facts, start, end, grain)


CODE = st.text(alphabet=st.sampled_from(list("0123a")), min_size=0, max_size=4)


@SETTINGS
@given(st.lists(CODE, min_size=1, max_size=30), st.lists(CODE, min_size=1, max_size=4),
       st.lists(st.integers(0, 40), min_size=0, max_size=3))
def test_in_filter_matches_model(spark, codes, quoted, bare):
    from decimal import Decimal, InvalidOperation

    from pursewise.operators.filters import apply_filters

    def as_number(v):
        try:
            return Decimal(v)
        except InvalidOperation:
            return None

    text = ", ".join([f"'{q}'" for q in quoted] + [str(b) for b in bare])
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, code string")
    got = sorted(r["i"] for r in apply_filters(df, {"filters": {"code": text}}).collect())
    want = sorted(i for i, c in enumerate(codes)
                  if c in quoted or (as_number(c) is not None and as_number(c) in {Decimal(b) for b in bare}))
    assert got == want


NLABEL = st.one_of(st.none(), st.sampled_from(["a", "b", "a b", ""]))


@SETTINGS
@given(st.lists(st.tuples(NLABEL, NLABEL, NLABEL), min_size=1, max_size=30))
def test_tree_edges_match_brute_force(spark, rows):
    from pursewise.operators.tree import PATH_SEP, tree_edges

    df = spark.createDataFrame(rows, "l1 string, l2 string, l3 string")
    got = {(e["level"], e["parent_path"], e["label"]) for e in tree_edges(df).collect()}
    want = set()
    for r in rows:
        labels = ["" if x is None else x for x in r]
        for i in range(3):
            want.add((i + 1, PATH_SEP.join(labels[:i]), labels[i]))
    assert got == want


@SETTINGS
@given(st.lists(FACT, min_size=0, max_size=60), st.integers(0, 480), st.integers(0, 400),
       st.sampled_from(["week", "month"]))
def test_period_sums_match_brute_force(spark, facts, first, span, grain):
    import datetime as dt
    from collections import defaultdict
    from decimal import Decimal

    from pursewise.operators.facts import period_sums

    start = DAY0 + dt.timedelta(days=first)
    end = start + dt.timedelta(days=span)
    rows = [(d, DAY0 + dt.timedelta(days=day), Decimal(a)) for d, day, a in facts]
    df = spark.createDataFrame(rows, "district string, transdate date, gross decimal(18,2)")
    got = sorted(tuple(r) for r in period_sums(df, "transdate", ["gross"], grain, start, end,
                                               by=("district",)).collect())
    sums = defaultdict(int)
    for d, day, a in facts:
        x = DAY0 + dt.timedelta(days=day)
        if start <= x <= end:
            sums[(d, int(x.strftime("%U")) if grain == "week" else x.month)] += a
    assert got == sorted((d, p, float(v)) for (d, p), v in sums.items())


def _header_texts(html):
    """Every text node inside the td cells of rows with class exactly popupheadingeKosh."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.in_row, self.td = [], False, 0

        def handle_starttag(self, tag, attrs):
            if tag == "tr":
                self.in_row = dict(attrs).get("class") == "popupheadingeKosh"
            elif tag == "td" and self.in_row:
                self.td += 1

        def handle_endtag(self, tag):
            if tag == "td" and self.td:
                self.td -= 1
            elif tag == "tr":
                self.in_row = False

        def handle_data(self, data):
            if self.in_row and self.td:
                self.out.append(data)

    p = P()
    p.feed(html)
    p.close()
    return p.out


HCELL = st.recursive(
    st.one_of(st.text(alphabet=st.sampled_from(list("Ab 1")), min_size=1, max_size=4),
              st.sampled_from(["&amp;", "<br>"])),
    lambda inner: st.one_of(
        st.tuples(st.sampled_from(["b", "span"]), inner).map(lambda t: f"<{t[0]}>{t[1]}</{t[0]}>"),
        st.tuples(inner, inner).map(lambda t: t[0] + t[1])),
    max_leaves=5)


@SETTINGS
@given(st.lists(HCELL, min_size=1, max_size=5))
def test_header_text_nodes_match_parser(spark, cells):
    body = ('<table><tr class="popupheadingeKosh">' + "".join(f"<td>{c}</td>" for c in cells)
            + '</tr><tr class="pope"><td>x</td></tr></table>')
    df = spark.createDataFrame([("k", body)], "key string, body string")
    got = EX.extract_header(df, keys=("key",)).collect()
    got = got[0]["header"] if got else []
    assert got == _header_texts(body)


XTEXT = st.text(alphabet=st.sampled_from(list("Ab1 \n\t-[]")), min_size=0, max_size=8).map(
    lambda t: t.replace("&", "&amp;"))
XCHILD = st.tuples(st.sampled_from(["H", "T", "X"]), XTEXT).map(lambda t: f"<{t[0]}>{t[1]}</{t[0]}>")
XELEM = st.lists(st.one_of(XCHILD, XTEXT), min_size=0, max_size=4).map("".join)


@SETTINGS
@given(st.lists(XELEM, min_size=1, max_size=6))
def test_receipt_rows_match_etree(spark, elems):
    import xml.etree.ElementTree as ET

    body = ('<r xmlns="urn:x">' + "".join(f"<ReceiptSubMinorDetail>{e}</ReceiptSubMinorDetail>" for e in elems)
            + "</r>")
    texts = ["".join(el.itertext()) for el in ET.fromstring(body).iter("{urn:x}ReceiptSubMinorDetail")]
    df = spark.createDataFrame([("0", "01/04/2019", body)], "public_head_bool string, date string, body string")
    got = [r["cols"] for r in EX.receipt_rows(df).orderBy("pos").collect()]
    assert len(got) == len(texts)
    for cols, text in zip(got, texts):
        at = min(1, len(cols) - 1)  # the date is second, or alone
        assert cols[at] == "01/04/2019"
        lines = cols[:at] + cols[at + 1:]
        assert all(x.strip() and "\n" not in x for x in lines)
        assert "".join("".join(lines).split()) == "".join(text.split())


def _option_model(html, select_id):
    """(position, value, first text node) of every option of the select."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.in_sel, self.cur = [], False, None

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if tag == "select":
                self.in_sel = a.get("id") == select_id
            elif tag == "option" and self.in_sel:
                self.cur = [len(self.out), a.get("value") or "", None]
                self.out.append(self.cur)

        def handle_endtag(self, tag):
            if tag == "option":
                self.cur = None
            elif tag == "select":
                self.in_sel = False

        def handle_data(self, data):
            if self.cur is not None and self.cur[2] is None:
                self.cur[2] = data

    p = P()
    p.feed(html)
    p.close()
    return [(i, v, t or "") for i, v, t in p.out]


OTEXT = st.text(alphabet=st.sampled_from(list("Ab1 \n")), min_size=1, max_size=8)
OPTION = st.tuples(st.text(alphabet=st.sampled_from(list("T01")), max_size=3), OTEXT,
                   st.booleans()).map(
    lambda t: f'<option value="{t[0]}">' + (f"<b>{t[1]}</b>x" if t[2] else t[1]) + "</option>")


@SETTINGS
@given(st.lists(OPTION, min_size=1, max_size=8))
def test_options_match_parser(spark, opts):
    body = '<form><select id="other"><option value="z">no</option></select><select id="cmbHOD">' + \
        "".join(opts) + "</select></form>"
    df = spark.createDataFrame([(body,)], "body string")
    got = [tuple(r) for r in EX.options(df, "cmbHOD", skip_placeholder=False).orderBy("position").collect()]
    want = _option_model(body, "cmbHOD")
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(_cleaned(w[2], g[2]) for g, w in zip(got, want))


PAGE_PART = st.sampled_from([
    '<table><tr class="popeven"><td>x</td></tr></table>', '<table><tr class="other"><td>y</td></tr></table>',
    '<tr class="pope"><td>outside</td></tr>', "<p>There is no record with given values</p>", "<p>text</p>",
    '<table><tr class="popupheadingeKosh"><td>H</td></tr></table>'])


def _classify_model(body, status):
    from html.parser import HTMLParser

    class P(HTMLParser):
        def __init__(self):
            super().__init__()
            self.tables, self.rows = 0, 0

        def handle_starttag(self, tag, attrs):
            if tag == "table":
                self.tables += 1
            elif tag == "tr" and self.tables and "pope" in (dict(attrs).get("class") or ""):
                self.rows += 1

        def handle_endtag(self, tag):
            if tag == "table":
                self.tables -= 1

    if status >= 400:
        return "failed"
    p = P()
    p.feed(body)
    if p.rows:
        return "dataset"
    if EX.NO_RECORD_TEXT in body:
        return "not_available"
    return "unparsed" if "pope" in body else "empty"


@SETTINGS
@given(st.lists(st.tuples(st.lists(PAGE_PART, max_size=4).map("".join), st.sampled_from([200, 404, 500])),
                min_size=1, max_size=20))
def test_classify_matches_model(spark, pages):
    df = spark.createDataFrame([(i, b, s) for i, (b, s) in enumerate(pages)], "i int, body string, status int")
    got = [r["response_status"] for r in EX.classify(df).orderBy("i").collect()]
    assert got == [_classify_model(b, s) for b, s in pages]


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["T1", "T2", "T3"]), st.integers(1, 4), st.sampled_from(list("abcde"))),
                min_size=1, max_size=40))
def test_latest_snapshot_matches_model(spark, rows):
    from pursewise.sources.io import latest_snapshot

    df = spark.createDataFrame(rows, "treasury_code string, snap int, ddo string")
    got = sorted(tuple(r) for r in latest_snapshot(df, "treasury_code", "snap").collect())
    newest = {}
    for t, s, _ in rows:
        newest[t] = max(newest.get(t, s), s)
    assert got == sorted(r for r in rows if r[1] == newest[r[0]])


JTEXT = st.one_of(st.none(), st.text(alphabet=st.sampled_from(list('a"\\\n\t/é€ {}[],:')), max_size=6))


@SETTINGS
@given(st.lists(st.tuples(JTEXT, st.integers(-10**6, 10**6)), min_size=0, max_size=15))
def test_columnar_document_escapes_any_text(spark, rows):
    from pursewise.operators.shaping import columnar_json_fragments

    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "id int, s string, n bigint")
    frags = columnar_json_fragments(df, ["s", "n"], "id").orderBy("s1", "s2", "s3", "pos").collect()
    doc = json.loads("".join(f["fragment"] for f in frags))
    assert doc == {"records": {"s": [s for s, _ in rows], "n": [n for _, n in rows]}, "count": len(rows)}


WLABEL = st.text(alphabet=st.sampled_from(list('a"\\\né{}:,')), max_size=3)


@SETTINGS
@given(st.lists(st.tuples(WLABEL, WLABEL), min_size=1, max_size=20))
def test_tree_document_escapes_any_label(spark, paths):
    df = spark.createDataFrame(paths, "l1 string, l2 string")
    frags = tree_json_fragments(df).orderBy("path").collect()
    want = {}
    for a, b in paths:
        want.setdefault(a, {}).setdefault(b, {})
    assert json.loads("{" + "".join(f["fragment"] for f in frags) + "}") == want


PART = st.text(alphabet=st.sampled_from(list("0123AbZ")), min_size=1, max_size=4)
DESC = st.text(alphabet=st.sampled_from(list("ab -&[]Z")), min_size=0, max_size=8)


@SETTINGS
@given(st.lists(st.tuples(PART, PART, PART, PART, DESC), min_size=1, max_size=20))
def test_split_head_round_trip(spark, heads):
    rows = [(f"{a}-{b}-{c}-{d} [{e}]",) for a, b, c, d, e in heads]
    out = EX.split_head(spark.createDataFrame(rows, "head string")).collect()
    got = sorted((r["major"], r["sub_major"], r["minor"], r["sub_minor"], r["sub_minor_desc"]) for r in out)
    assert got == sorted(heads)


NAME = st.text(alphabet=st.sampled_from(list("Ab ,/-_1")), min_size=1, max_size=10)


@SETTINGS
@given(st.lists(st.tuples(NAME, st.text(alphabet=st.sampled_from(list("0179")), min_size=1, max_size=4)),
                min_size=1, max_size=20))
def test_dataset_path_matches_rule(spark, plans):
    from pursewise.plans.requests import dataset_path

    df = spark.createDataFrame([(i, t, d, "20190401", "20190430") for i, (t, d) in enumerate(plans)],
                               "i int, treasury_name string, ddo_code string, start string, end string")
    got = [r["path"] for r in dataset_path(df, "treasury_expenditures").orderBy("i").collect()]
    head, tail = "expenditures/treasury_expenditures_", "_20190401-20190430.csv"
    for (t, d), path in zip(plans, got):
        assert path.startswith(head) and path.endswith(f"_{d}{tail}")
        name = path[len(head):-len(f"_{d}{tail}")]
        kept = t.replace(",", "")
        assert len(name) == len(kept) and not set(name) & set(", /")
        assert all(n == k or (n == "_" and k in " /") for n, k in zip(name, kept))
