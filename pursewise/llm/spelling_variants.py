"""Spelling variants by asymmetric q-chunks (operator 13), built-in functions only.

Two words are near when one inserted, deleted or replaced code point makes them equal. Of such
a pair the longer word (of equal ones the later in code-point order) contributes two disjoint
chunks of half its length, its first and its last code points; the other contributes its
positional grams of that size. One edit spares one of the two chunks, and moves it by one
position at most, so the pair meets in a join on (gram, position, length) with each chunk sent
for either shift. What meets is verified by edit distance.

Words and their numbers are aggregated before they are shuffled. A chunk that many words share
(a common ending, say) would make all its words meet: where the pairs of a chunk number more
than ``CROWDED``, the rest of the word is cut into two chunks again, one of which the edit spares
as well, and the words meet on both chunks, level by level until the rest is a code point or two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pursewise.llm.common import ascii_lower, stored

#: Letters of a word: A-Z, a-z and the code points 00C0 to 00FF.
LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, FORM_TIMES = 6, 5, 5
#: One run in so many (by hash) loses a code point in the registered query.
SLIP = 199
#: Pairs of one chunk above which its words meet on more chunks; levels of chunks at most.
CROWDED, LEVELS = 10_000, 4


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run) of every run of MIN_LENGTH letters or more in ``docs``, A-Z lower-cased."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"))
    plain = F.octet_length("run") == F.length("run")  # no letter that lower() would change too
    return found.where(F.length("run") >= MIN_LENGTH).select(
        "doc_id", F.when(plain, F.lower("run")).otherwise(ascii_lower("run")).alias("run"))


def slipped(found: DataFrame) -> DataFrame:
    """``found`` (doc_id, run) with one code point missing where SLIP divides the crc32 of
    ``<doc_id>:<run>``; runs of a null doc_id stay whole."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select("doc_id", F.when(h % SLIP == 0, cut).otherwise(F.col("run")).alias("run"))


def vocabulary(found: DataFrame) -> DataFrame:
    """(word, n) of the runs with MIN_LENGTH code points and MIN_COUNT occurrences."""
    return (found.where(F.length("run") >= MIN_LENGTH).groupBy(F.col("run").alias("word"))
            .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT))


# ------------------------------------------------------------------ pairs

def _ends(rest: Column, size: Column) -> Column:
    """The two ends of ``rest``: (side, chunk, what is left of it)."""
    n = F.length(rest)
    return F.array(
        F.struct(F.lit(0).alias("side"), F.substring(rest, F.lit(1), size).alias("gram"),
                 F.substring(rest, size + 1, n).alias("rest")),
        F.struct(F.lit(1).alias("side"), F.substring(rest, n - size + 1, size).alias("gram"),
                 F.substring(rest, F.lit(1), n - size).alias("rest")))


def _chunks(words: DataFrame) -> DataFrame:
    """Rows of the chunk side: (word, size, other, path, rest), ``other`` the partner's length.

    The two chunks are disjoint: each has half of the word's code points. A chunk at the end lies
    at the partner's end, that is at its own position or one before.
    """
    half = F.floor(F.length("word") / 2).cast("int")
    rows = words.select("word", F.length("word").alias("size"), F.explode(_ends(F.col("word"), half)).alias("e"))
    rows = rows.select("word", "size", F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("other"), "e")
    return rows.select("word", "size", "other", F.concat(F.col("e.side").cast("string"), F.col("e.gram")).alias("path"), "e.rest")


def _grams(words: DataFrame) -> DataFrame:
    """Rows of the gram side: the positional grams that a chunk of a word as long or one longer
    can equal within a shift of one, those at either end."""
    rows = words.select("word", F.length("word").alias("other")).select(
        "word", "other", F.explode(F.array(F.col("other"), F.col("other") + 1)).alias("size"))
    rows = rows.select("word", "size", "other", F.explode(_ends(F.col("word"), F.floor(F.col("size") / 2).cast("int"))).alias("e"))
    return rows.select("word", "size", "other", F.concat(F.col("e.side").cast("string"), F.col("e.gram")).alias("path"), "e.rest")


def _deeper(rows: DataFrame, longer: Column) -> DataFrame:
    """The rows with one chunk more in their path; ``longer``: length of the chunk side's rest."""
    size = F.floor(longer / 2).cast("int")
    rows = rows.select("word", "size", "other", "path", F.explode(_ends(F.col("rest"), size)).alias("e"))
    return rows.select("word", "size", "other", F.concat("path", F.lit("|"), F.col("e.side").cast("string"), F.col("e.gram")).alias("path"),
                       "e.rest")


def near_pairs(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs (a, b) of ``words`` (a stored table with a column ``word``, distinct) that differ by
    one edit, each once."""
    key = ["size", "other", "path"]
    chunks, grams = _chunks(words), _grams(words)
    out = None
    for level in range(LEVELS):
        counts = chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).join(
            grams.groupBy(*key).agg(F.count(F.lit(1)).alias("g")), key)
        counts = stored(counts, "spelling-counts")
        last = level == LEVELS - 1
        few = counts.where(F.lit(last) | (F.col("c") * F.col("g") <= crowded)).select(*key)
        a = chunks.join(few, key).select(*key, F.col("word").alias("a"))
        b = grams.join(few, key).select(*key, F.col("word").alias("b"))
        # of two words as long as each other, the later one in code-point order sends the chunks
        met = a.join(b, key).where((F.length("a") > F.length("b")) | (F.col("a") > F.col("b")))
        met = met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b")
        out = met if out is None else out.unionByName(met)
        many = counts.where(F.col("c") * F.col("g") > crowded).select(*key)
        if last or many.isEmpty():
            break
        # rests of the partner's words are as long, or one shorter
        chunks = stored(_deeper(chunks.join(many, key, "left_semi"), F.length("rest")), "spelling-chunks")
        grams = stored(_deeper(grams.join(many, key, "left_semi"), F.length("rest") + F.col("size") - F.col("other")), "spelling-grams")
    return out.distinct()


# ------------------------------------------------------------------ groups

def variants(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Per row of ``words`` (word, n): word, form, root, n, n_near, form_n.

    ``form`` is the near word of the largest n (ties: the smallest in code-point order) where
    that n is at least FORM_TIMES the word's, else null. ``root``: where the forms lead, the
    word itself without one. A null word or count is left out; a word given twice counts as one
    with the sum. An empty table gives no rows. Forms at least multiply n, so a chain is shorter
    than 28 words, and five doublings of the pointers reach its end.
    """
    words = stored(words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")),
                   "spelling-words")
    pairs = stored(near_pairs(words.select("word"), crowded), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    best = (both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")))
    out = words.join(best, "word", "left")
    formed = -F.col("best.less") >= FORM_TIMES * F.col("n")
    out = stored(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                            F.when(formed, F.col("best.near")).alias("form"),
                            F.when(formed, -F.col("best.less")).cast("long").alias("form_n")), "spelling-forms")
    jump = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(5):
        on = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jump = stored(jump.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-jump")
    return out.join(jump, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame) -> DataFrame:
    """The variants of the words in ``docs`` (doc_id, text), as the documents write them.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of 6 code points
    and 5 occurrences at least. Null and empty texts have none; a repeated row counts again; other
    columns are ignored; texts of any length are read whole. Columns as in ``variants``.
    """
    return variants(vocabulary(runs(docs)))


def slipped_groups(docs: DataFrame) -> DataFrame:
    """``spelling_groups`` after ``slipped``: some runs lose a code point by their hash."""
    return variants(vocabulary(slipped(runs(docs))))
