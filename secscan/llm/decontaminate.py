"""Benchmark decontamination by template canonicalisation.

Words lose surrounding punctuation and case; numbers, quantities, names and units become typed placeholders.  Windows
of the canonical words of benchmark items are hashed and hash-joined with all windows of all documents.  What matched
is then compared word by word, and put together by alignment (a document's text, an item, and their shift):

* a window whose placeholders all have the item's own values is verbatim and counts;
* a window with other values counts if it lies in a stretch of ``least`` consecutive matched windows of its alignment
  (all windows of an item that has fewer) in which values are renamed one to one within each type.

So a question is found verbatim, with other numbers and names throughout, or with some edited here and there; texts
that merely share a pattern with unrelated values are not.

There are two canonical forms, each matched by itself.  In the strict one a name is a capitalised word inside a sentence
and a number starts with a digit; in the loose one every capitalised word is a name, also one that opens a sentence, and
number words of English up to 'ninety-nine' written as one word, and the larger units, are numbers.  A pair found in the
strict form is reported as that form counts it; the loose one adds the pairs that only it finds.

Documents that hold fewer windows than an item needs are left out before windows are matched with items, so a window
that many items share costs a row per document, not per document and item.

Defined results: null and empty texts on either side match nothing; an item with fewer words than a window is matched
as a whole; items with the same template and the same words are one item, the one with the smallest id; windows
repeated within an item count once; rows with the same doc_id are judged each by its own text, and of a doc_id's rows
the one with the most windows is reported; rows without doc_id are judged and cleaned, but not reported; an empty
table on either side gives no rows; a very long text is one row of words, its windows are rows; other columns are
not read, whatever their names, and ``clean_documents`` returns them unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from secscan.llm.common import words, written

WINDOW = 8
#: windows of an item that must be found: six in a row are 13 words
LEAST = 6
EDGE = ".,;:!?\"'()[]{}<>|*#$%&/\\~^_=+`-…“”‘’«»¿¡"
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "sec", "min", "h", "hour", "hours", "minute", "minutes",
         "second", "seconds", "day", "days", "week", "weeks", "month", "months", "year", "years", "meter", "meters",
         "metre", "metres", "kilometer", "kilometers", "mile", "miles", "foot", "feet", "inch", "inches", "gram", "grams",
         "kilogram", "kilograms", "pound", "pounds", "ounce", "ounces", "liter", "liters", "litre", "litres", "gallon",
         "gallons", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees", "mph", "kmh")
_ONES = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
NUMBERS = ("zero", *_ONES, "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
           *_TENS, *(f"{t}-{o}" for t in _TENS for o in _ONES), "dozen", "hundred", "thousand", "million", "billion")
#: the column of each form's words; a pair found in the first is not looked for in the next
FORMS = ("_canon", "_loose")


def canonical(text: Column, text_name: str = "_raw") -> dict[str, str]:
    """SQL of four arrays over the words in column ``text_name``: bare words, lower-cased ones, both canonical forms."""
    edge = EDGE.replace("\\", "\\\\").replace("'", "\\'")
    units = ", ".join(f"'{u}'" for u in UNITS)
    numbers = ", ".join(f"'{n}'" for n in NUMBERS)
    return {
        "_bare": f"transform({text_name}, w -> btrim(w, '{edge}'))",
        "_low": "transform(_bare, w -> lower(w))",
        "_canon": f"""transform(_low, (l, i) -> CASE
            WHEN l = '' THEN ''
            WHEN left(l, 1) BETWEEN '0' AND '9' THEN CASE WHEN l rlike '^[0-9][0-9.,]*$' THEN '<num>' ELSE '<qty>' END
            WHEN left(l, 1) != left(get(_bare, i), 1) AND substr(l, 2, 1) = substr(get(_bare, i), 2, 1) AND i > 0
                 AND right(get({text_name}, i - 1), 1) NOT IN ('.', '!', '?', ':') THEN '<name>'
            WHEN l IN ({units}) THEN '<unit>'
            ELSE l END)""",
        "_loose": f"""transform(_canon, (c, i) -> CASE
            WHEN get(_low, i) IN ({numbers}) THEN '<num>'
            WHEN left(c, 1) != '<' AND left(c, 1) != left(get(_bare, i), 1) AND substr(c, 2, 1) = substr(get(_bare, i), 2, 1)
                 THEN '<name>'
            ELSE c END)""",
    }


def with_canonical(df: DataFrame, text: str = "text") -> DataFrame:
    out = df.withColumn("_raw", words(F.col(text)))
    for name, sql in canonical(F.col(text)).items():
        out = out.withColumn(name, F.expr(sql))
    return out


def _window(i: str, n: int, form: int) -> str:
    """Hash of the window of n words from place ``i`` (SQL), n known beforehand; the form is hashed too."""
    parts = ", ".join(f"get({FORMS[form]}, {i} + {j})" for j in range(n))
    return f"xxhash64({n + 100 * form}, {parts})"


def _fixed_windows(n: int, form: int = 0) -> str:
    """Hashes of all windows of n canonical words (SQL)."""
    return (f"CASE WHEN size(_canon) < {n} THEN CAST(array() AS array<bigint>) ELSE"
            f" transform(sequence(0, size(_canon) - {n}), i -> {_window('i', n, form)}) END")


def index(benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(h, item_id, form, ipos, rank, size, item_windows, need, iwords, ilow): the items' windows with their words.

    Items of equal words are one; windows repeated within an item and form count once; ``rank`` numbers the rest.
    """
    items = with_canonical(benchmark.select("item_id", "text").filter("text IS NOT NULL")).filter("size(_canon) > 0")
    items = items.groupBy(F.xxhash64("_canon", "_low").alias("_same"), "_canon", "_low").agg(F.min_by(
        F.struct("item_id", "_loose"), "item_id").alias("_i")).select("_i.item_id", "_low", "_canon", "_i._loose")
    items = items.withColumn("size", F.least(F.lit(window), F.size("_canon")))
    hashes = F.array(*[F.expr("CASE " + " ".join(
        f"WHEN size = {n} THEN {_fixed_windows(n, form)}" for n in range(1, window + 1)) + " END") for form in range(len(FORMS))])
    w = items.select("*", F.posexplode(hashes).alias("form", "_h")).select("*", F.posexplode("_h").alias("ipos", "h"))
    w = w.select("h", "item_id", "form", "size", "ipos", F.expr(f"slice(CASE form {' '.join(f'WHEN {k} THEN {c}' for k, c in enumerate(FORMS))} END, ipos + 1, size)").alias("iwords"),
                 F.expr("slice(_low, ipos + 1, size)").alias("ilow"))
    w = w.groupBy("item_id", "form", "h", "size").agg(F.min_by(F.struct("ipos", "iwords", "ilow"), "ipos").alias("_w")).select("item_id", "form", "h", "size", "_w.*")
    own = Window.partitionBy("item_id", "form")
    w = w.withColumn("rank", F.row_number().over(own.orderBy("ipos")) - 1).withColumn("item_windows", F.count(F.lit(1)).over(own))
    return written(w.withColumn("need", F.least(F.lit(least), "item_windows").cast("int")), "benchmark-windows")


def hits(docs: DataFrame, windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, _row, pos, h, need) for every document window that is some item's window; need is the least that an
    item with this window asks for.  ``_row`` tells rows with the same doc_id apart by their text.

    Only the hashes meet the index; its table on disk has a known size, from which Spark broadcasts it or shuffles.
    """
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect()) or [window]  # at most window values
    short = windows.groupBy("h").agg(F.min("need").alias("need"))
    d = with_canonical(docs.select("doc_id", "text").filter("text IS NOT NULL").withColumn("_row", F.xxhash64("text")))
    # one row per place first: hashes of its windows are then generated code, not a function run per array element;
    # outer, as a filter on the array's size would compute the words twice
    place = d.select("doc_id", "_row", *FORMS, F.explode_outer(F.expr(
        f"CASE WHEN size(_canon) >= {sizes[0]} THEN sequence(0, size(_canon) - {sizes[0]}) END")).alias("pos"))
    hashes = F.array(*[F.expr(f"CASE WHEN pos + {n} <= size(_canon) THEN {_window('pos', n, form)} END")
                       for n in sizes for form in range(len(FORMS))])
    flat = place.select("doc_id", "_row", "pos", F.explode_outer(hashes).alias("h"))
    return flat.join(written(short, "benchmark-hashes"), "h").select("doc_id", "_row", "pos", "h", "need")


_SLOTS = ("'<num>'", "'<qty>'", "'<name>'", "'<unit>'")


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(doc_id, _row, item_id, form, shift, rank, need, item_windows, verbatim, slots): document windows that are an
    item's window word by word; slots are its placeholders (type, the item's value, the document's)."""
    windows = index(benchmark, window, least)
    found = written(hits(docs, windows, window), "benchmark-hits")
    # equal also where doc_id is null
    row = [F.col("doc_id").eqNullSafe(F.col("_d")), F.col("_row") == F.col("_r")]
    enough = found.groupBy("doc_id", "_row").agg(F.countDistinct("h").alias("_n"), F.min("need").alias("_need"), F.sort_array(F.collect_set("pos")).alias("_at"))
    enough = written(enough.filter("_n >= _need").select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), "_at"), "benchmark-rows")
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").withColumn("_row", F.xxhash64("text")).join(enough, row)
    texts = with_canonical(texts.dropDuplicates(["doc_id", "_row"]))
    forms = ", ".join(f"slice({c}, p + 1, {window})" for c in FORMS)
    at = texts.select("doc_id", "_row", F.explode(F.expr(f"transform(_at, p -> named_struct('pos', p, 'dlow', slice(_low, p + 1, {window}), 'dforms', array({forms})))")).alias("_p"))
    at = written(at.select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r"), F.col("_p.pos").alias("_pos"), "_p.dlow", "_p.dforms"), "benchmark-places")
    both = found.drop("need").join(at, [*row, F.col("pos") == F.col("_pos")]).join(windows, "h")
    both = both.filter("slice(get(dforms, form), 1, size) = iwords")
    slots = F.expr(f"""transform(filter(sequence(0, size - 1), i -> get(iwords, i) IN ({', '.join(_SLOTS)})),
        i -> named_struct('t', get(iwords, i), 'x', get(ilow, i), 'y', get(dlow, i)))""")
    both = both.withColumn("slots", slots).withColumn("verbatim", F.expr("forall(slots, p -> p.x = p.y)"))
    return both.select("doc_id", "_row", "item_id", "form", (F.col("pos") - F.col("ipos")).alias("shift"), "rank", "need", "item_windows", "verbatim", "slots")


def leaking_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(doc_id, _row, item_id, n_windows, item_windows, kind) per row of ``docs`` and item, kind 2 verbatim or 1 renamed."""
    line = ["doc_id", "_row", "item_id", "form", "need", "item_windows", "shift"]
    lines = matched(docs, benchmark, window, least).groupBy(*line).agg(F.sort_array(F.collect_set(F.struct("rank", "verbatim", "slots"))).alias("w"))
    # places where a stretch of ``need`` consecutive windows starts that renames one to one
    fine = F.expr("""filter(sequence(0, size(w) - need), k -> get(w, k + need - 1).rank - get(w, k).rank = need - 1 AND
        size(array_distinct(flatten(transform(slice(w, k + 1, need), v -> v.slots)))) = size(array_distinct(flatten(transform(slice(w, k + 1, need),
            v -> transform(v.slots, p -> named_struct('t', p.t, 'x', p.x)))))) AND
        size(array_distinct(flatten(transform(slice(w, k + 1, need), v -> v.slots)))) = size(array_distinct(flatten(transform(slice(w, k + 1, need),
            v -> transform(v.slots, p -> named_struct('t', p.t, 'y', p.y)))))))""")
    lines = lines.withColumn("_s", F.when(F.expr("size(w) >= need"), fine).otherwise(F.array().cast("array<int>")))
    counted = F.expr("filter(w, (v, i) -> v.verbatim OR exists(_s, k -> k <= i AND i < k + need))")
    each = lines.select(*line, F.explode(counted).alias("v")).groupBy("doc_id", "_row", "item_id", "form").agg(
        F.countDistinct("v.rank").alias("n_windows"), F.countDistinct(F.expr("CASE WHEN v.verbatim THEN v.rank END")).alias("_same"),
        F.first("need").alias("need"), F.first("item_windows").alias("item_windows")).filter("n_windows >= need")
    kind = F.expr("CASE WHEN _same >= need THEN 2 ELSE 1 END")
    return each.withColumn("kind", kind).groupBy("doc_id", "_row", "item_id").agg(
        F.min_by(F.struct("n_windows", "item_windows", "kind"), "form").alias("_f")).select("doc_id", "_row", "item_id", "_f.*")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """One row per document and item: doc_id, item_id, n_windows found, item_windows, kind.

    Windows are counted in the first form that finds enough of them.  kind is 'verbatim' if enough windows keep all
    values, else 'renamed'."""
    rows = leaking_rows(docs.filter("doc_id IS NOT NULL"), benchmark, window, least)
    return rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "kind", "item_windows")).alias("_f")).select(
        "doc_id", "item_id", "_f.n_windows", "_f.item_windows", F.when(F.col("_f.kind") == 2, "verbatim").otherwise("renamed").alias("kind"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without a leak, all their columns unchanged."""
    bad = written(leaking_rows(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r")).distinct(), "leaking-rows")
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_r")), "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns])
