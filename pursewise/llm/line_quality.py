"""Quality rules with cross-document line frequency (operator 9), built-in functions only.

Base counts come from the text alone. The method: lines are normalised (A-Z lower-cased,
digits to 0, blanks to one space) and hashed; for each host (``source``) the distinct
documents (distinct texts) that hold a line are counted; a line above the host's limit is
removed from all its documents, and a document left with too small a share of its words is
rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursewise.llm.common import BLANKS, LOWER, UPPER, bound, stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A line is boilerplate of a host when more distinct documents of the host hold it. The limit is
#: a number and no share, so that a line's lot does not depend on what else the host holds.
MAX_LINE_DOCS = 10
#: Documents that keep a smaller percentage of their words are rejected.
MIN_KEPT_PERCENT = 30


def _tail(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(
        F.array().cast("array<string>"))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more; n log n in the number of windows."""
    def adjacent(s):  # equal neighbours in hash order
        return F.zip_with(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), _tail(s),
                          lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))
                          .otherwise(F.array().cast("array<int>")))

    def spans(pos):  # each window covers WINDOW words, or up to the next repeated window
        return F.aggregate(F.zip_with(pos, _tail(pos), lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW)))),
                           F.lit(0).cast("long"), lambda acc, x: acc + x)

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    full = bound(placed, lambda s: bound(F.sort_array(F.array_distinct(F.flatten(adjacent(s)))), spans))
    # most texts repeat no window: a sort of plain longs tells, without the structs
    repeats = bound(F.sort_array(hashes), lambda s: F.exists(
        F.zip_with(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), _tail(s), lambda a, b: a == b),
        lambda same: same))
    return F.when(repeats, full).otherwise(F.lit(0).cast("long"))


def _repeat_words(w: Column) -> Column:
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW),
                         lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    return F.when(n <= WINDOW, F.lit(0).cast("long")).otherwise(bound(hashes, _covered))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)


def _word_counts(text: Column) -> Column:
    """(n_words, n_repeat_words) of a text, its words split once."""
    return bound(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                                  _repeat_words(w).alias("n_repeat_words")))


def base_counts(text: Column) -> list[Column]:
    """Columns of the rules that one text decides (``words``: a struct of two counts)."""
    text = F.coalesce(text, F.lit(""))
    dup = bound(_lines(text), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))
    return [
        _word_counts(text).alias("words"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        dup.alias("n_dup_lines"),
    ]


def _normal(line: Column) -> Column:
    plain = F.translate(line, UPPER + "123456789", LOWER + "000000000")
    return F.regexp_replace(F.btrim(plain, F.lit(BLANKS)), r"[\x20\x09-\x0D]+", " ")


def _line_hashes(text: Column) -> Column:
    """Each line with a word as (line: hash of its normal form, words: their number, at: its
    position among all lines of the text)."""
    def hashed(n, i):  # words of a normal form are one blank apart
        words = F.when(n == "", F.lit(0)).otherwise(F.regexp_count(n, F.lit(" ")) + 1)
        return F.struct(F.xxhash64(n).alias("line"), words.alias("words"), i.alias("at"))
    normal = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _normal)
    return F.filter(F.transform(normal, hashed), lambda l: l["words"] > 0)


def _without(text: Column, gone: Column) -> Column:
    """``text`` without the lines at the positions ``gone`` (sorted); linear in the lines."""
    def runs(lines):  # the lines between one position and the next
        return F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(lines))),
                                    lambda a, b: F.slice(lines, a + 2, b - a - 1)))
    return F.array_join(bound(F.split(text, "\n"), runs), "\n")


def boilerplate_words(rows: DataFrame) -> DataFrame:
    """(d, h, t, removed, gone): words in the lines that are boilerplate of the host and the
    sorted positions of these lines, by document that has any.

    ``rows``: doc_id, source, text_hash, has_text, lines (``_line_hashes``), as a stored table.
    Documents of a host count once per distinct text. The counts are pre-aggregated in the
    map tasks; only lines above the limit meet the documents again.
    """
    rows = rows.where("has_text").select("doc_id", F.col("source").alias("host"), "text_hash", "lines")
    lines = rows.select("doc_id", "host", "text_hash", F.explode("lines").alias("l")).select(
        "doc_id", "host", "text_hash", "l.at", "l.line", "l.words")
    above = (lines.select("host", "line", "text_hash").distinct()
             .groupBy(F.col("host").alias("h"), F.col("line").alias("l")).agg(F.count(F.lit(1)).alias("n_docs"))
             .where(F.col("n_docs") > MAX_LINE_DOCS).drop("n_docs"))
    hit = lines.join(above, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
    # repeated rows share their key and line number, and count once
    hit = hit.groupBy("doc_id", "host", "text_hash", "at").agg(F.max("words").alias("words"))
    return (hit.groupBy(F.col("doc_id").alias("d"), F.col("host").alias("h"), F.col("text_hash").alias("t"))
            .agg(F.sum("words").alias("removed"), F.sort_array(F.collect_list("at")).alias("gone")))


def _failed(n: Column, repeat: Column) -> Column:
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


def quality(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept.

    ``base_failed``: under 10 words, or more than 20 % of the words in repeated 5-word
    windows. ``kept``: not base_failed, and at least 30 % of the words are left when the
    host's boilerplate lines are removed. A null text has no words and fails; a null source
    is a host of its own; null ids, repeated rows (a row each) and an empty table pass
    through; other columns are ignored. The texts are read once.
    """
    base = stored(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"),
                              F.col("text").isNotNull().alias("has_text"), *base_counts(F.col("text")),
                              _line_hashes(F.col("text")).alias("lines")), "quality-base")
    out = base.drop("lines").join(boilerplate_words(base), (F.col("text_hash") == F.col("t"))
                                  & F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("h")), "left")
    n, removed = F.col("words.n_words"), F.coalesce(F.col("removed"), F.lit(0)).cast("long")
    failed = _failed(n, F.col("words.n_repeat_words"))
    return out.select("doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "words.n_repeat_words",
                      failed.alias("base_failed"), removed.alias("n_removed_words"),
                      (~failed & (100 * (n - removed) >= MIN_KEPT_PERCENT * n)).alias("kept"))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, without their host's boilerplate lines.

    They have their own columns, whatever their names (they travel as one value). A text that loses lines is its other
    lines, blank ones too, joined again; an ``n_chars`` column then holds its new length.
    """
    key = F.xxhash64("text")
    lines = stored(docs.select("doc_id", "source", key.alias("text_hash"), F.col("text").isNotNull().alias("has_text"),
                               _line_hashes(F.col("text")).alias("lines")), "quality-lines")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("hash"),
                       _word_counts(F.coalesce(F.col("text"), F.lit(""))).alias("counts"))
    n, hit = F.col("counts.n_words"), F.col("gone").isNotNull()
    rows = rows.where(~_failed(n, F.col("counts.n_repeat_words")))
    on = (F.col("hash") == F.col("t")) & F.col("doc.doc_id").eqNullSafe(F.col("d")) & F.col("doc.source").eqNullSafe(F.col("h"))
    out = rows.join(boilerplate_words(lines), on, "left").where(~hit | (100 * (n - F.col("removed")) >= MIN_KEPT_PERCENT * n))
    text = F.when(hit, _without(F.col("doc.text"), F.col("gone"))).otherwise(F.col("doc.text"))
    out = out.select("doc", hit.alias("hit"), text.alias("left"))
    own = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": F.col("left")}
    if "n_chars" in own:
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(F.col("hit"), F.length("left").cast(kind)).otherwise(own["n_chars"])
    return out.select(*[v.alias(c) for c, v in own.items()])


#: The same rows in DuckDB SQL.
ORACLE = rf"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as txt, text from documents),
w as (select rid, regexp_extract_all(txt, '[^\x20\x09-\x0D]+') as ws from d),
win as (select rid, i, list_slice(ws, i, i + 4) as k
        from (select rid, ws, unnest(generate_series(1, len(ws) - 4)) as i from w where len(ws) >= 5)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as c from win) where c > 1),
cov as (select rid, count(distinct p) as n from (select rid, unnest(generate_series(i, i + 4)) as p from rep) group by rid),
l as (select rid, source, text, line from (select rid, source, text, unnest(string_split(text, chr(10))) as line from d)
      where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select rid, count(*) - count(distinct line) as n from l group by rid),
norm as (select rid, source, text, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words,
         regexp_replace(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[0-9]', '0', 'g'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') as line from l),
freq as (select source, line, count(distinct text) as n from norm group by source, line),
bad as (select source, line from freq where n > {MAX_LINE_DOCS}),
gone as (select rid, sum(words) as n from norm join bad on norm.line = bad.line
         and norm.source is not distinct from bad.source group by rid),
m as (select d.doc_id, len(w.ws)::bigint as n_words,
        length(regexp_replace(txt, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        (length(txt) - length(regexp_replace(txt, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
        coalesce(gone.n, 0)::bigint as n_removed_words
      from d join w using (rid) left join dup using (rid) left join cov using (rid) left join gone using (rid)),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from m)
select *, not base_failed and 100 * (n_words - n_removed_words) >= {MIN_KEPT_PERCENT} * n_words as kept from f
"""
