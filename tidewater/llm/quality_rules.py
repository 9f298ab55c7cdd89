"""Quality rules in DataFrame functions: base counts, then thresholds that adapt to language and source.

Quantile sketches (percentile_approx, whose partial summaries merge before the shuffle) give each language and source
the quartiles of four measures; a document is kept if each measure lies within `spread` interquartile ranges of them.
A floor on the range keeps groups of near-equal documents from rejecting ordinary ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, stored

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Interquartile ranges beyond a quartile at which a document goes, and the least range of each measure.
SPREAD = 6.0
FLOORS = {"word_length": 0.75, "symbol_rate": 0.05, "dup_line_rate": 0.02, "repeat_rate": 0.02}
#: Only short and long mean words are both odd; of the others just the high side is.
TWO_SIDED = ("word_length",)
ACCURACY = 10_000

_LOW = (1 << 24) - 1


def _any_blank() -> str:
    return "[ \\t-\\r]+"


def _repeats(h: Column, sorted_positions: Column) -> Column:
    """Positions of windows that occur twice or more; -2 marks a clash of shortened hashes, -1 the rest."""
    top = F.lit(~_LOW)

    def code(x: Column, i: Column) -> Column:
        at, out = (x.bitwiseAND(F.lit(_LOW))).cast("int"), F.lit(-1)
        for n in (F.get(sorted_positions, i - 1), F.get(sorted_positions, i + 1)):
            same = n.bitwiseAND(top) == x.bitwiseAND(top)
            equal = F.get(h, at) == F.get(h, n.bitwiseAND(F.lit(_LOW)).cast("int"))
            out = F.when(same & ~equal, F.lit(-2)).when(same, at).otherwise(out)
        return out

    return F.transform(sorted_positions, code)


def _repeats_exactly(h: Column) -> Column:
    """The same by sorting whole hashes with their positions; for texts with clashes or over 2^24 windows."""
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.transform(pairs, lambda p, i: F.when((F.get(pairs, i - 1)["x"] == p["x"]) | (F.get(pairs, i + 1)["x"] == p["x"]), p["i"]).otherwise(F.lit(-1)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of every whole text; null counts as empty.

    Windows are told apart by their 64-bit XXH64.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    d = d.select(
        "doc_id", "lang", "source",
        F.filter(F.split(F.btrim("text", F.lit(BLANKS)), _any_blank()), lambda x: x != "").alias("w"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    d = d.withColumns({
        "n_words": F.size("w").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "h": F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")),
    }).drop("w", "lines")
    d = d.withColumn("p", F.when((F.size("h") > 1) & (F.size("h") <= _LOW), F.sort_array(F.transform("h", lambda x, i: x.bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long"))))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("r", _repeats(F.col("h"), F.col("p")))
    d = d.withColumn("q", F.sort_array(F.filter(F.when(F.array_contains("r", -2) | (F.size("h") > _LOW), _repeats_exactly(F.col("h"))).otherwise(F.col("r")), lambda x: x >= 0)))
    covered = F.transform("q", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("q", i + 1) - x, F.lit(WINDOW))))
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"))


def _measures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"word_length": F.col("word_chars") / n, "symbol_rate": F.col("n_symbols") / n, "dup_line_rate": F.col("n_dup_lines") / n, "repeat_rate": F.col("n_repeat_words") / n}


def thresholds(counts: DataFrame) -> DataFrame:
    """(lang, source, low_*, high_*): one row per language and source, nulls a value of their own."""
    sketches = counts.groupBy("lang", "source").agg(*[F.percentile_approx(x, [0.25, 0.75], ACCURACY).alias(name) for name, x in _measures().items()])
    limits = []
    for name, floor in FLOORS.items():
        reach = SPREAD * F.greatest(F.col(name)[1] - F.col(name)[0], F.lit(floor))
        limits.append((F.col(name)[1] + reach).alias(f"high_{name}"))
        if name in TWO_SIDED:
            limits.append((F.col(name)[0] - reach).alias(f"low_{name}"))
    return sketches.select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), *limits)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """measured() of every row with base_failed and kept.

    Empty, null and short texts fail the base. Repeated rows and ids each have their own result; columns of other names
    are ignored; an empty table gives an empty result. The limits are a row per language and source, stored first, so
    that Spark knows their size and broadcasts them only if it is small.
    """
    counts = stored(measured(docs, id_col, text_col, lang_col, source_col), "counts")
    limits = stored(thresholds(counts), "limits")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = F.lit(True)
    for name, x in _measures().items():
        verdict &= x <= F.col(f"high_{name}")
        if name in TWO_SIDED:
            verdict &= x >= F.col(f"low_{name}")
    joined = counts.join(limits, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & verdict).alias("kept"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The sketches are exact below their accuracy, so exact quartiles give the same verdicts on tables of that size.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, unnest(generate_series(1, len(w) - 4)) AS i, w FROM w WHERE len(w) >= 5),
g2 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i:i + 4], ' ')) AS n FROM g),
r AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM g2, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE n > 1 GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dl AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
c AS (SELECT d.rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d JOIN w USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN r USING (rid)),
m AS (SELECT *, word_chars / greatest(n_words, 1) AS a, n_symbols / greatest(n_words, 1) AS b, n_dup_lines / greatest(n_words, 1) AS e, n_repeat_words / greatest(n_words, 1) AS f FROM c),
q AS (SELECT lang, source, greatest(1, CAST(ceil(count(*) * 0.25) AS BIGINT)) AS lo, greatest(1, CAST(ceil(count(*) * 0.75) AS BIGINT)) AS hi,
        list_sort(list(a)) AS la, list_sort(list(b)) AS lb, list_sort(list(e)) AS le, list_sort(list(f)) AS lf FROM m GROUP BY ALL),
k AS (SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        a <= la[hi] + 6 * greatest(la[hi] - la[lo], 0.75) AND a >= la[lo] - 6 * greatest(la[hi] - la[lo], 0.75) AND b <= lb[hi] + 6 * greatest(lb[hi] - lb[lo], 0.05)
        AND e <= le[hi] + 6 * greatest(le[hi] - le[lo], 0.02) AND f <= lf[hi] + 6 * greatest(lf[hi] - lf[lo], 0.02) AS verdict
      FROM m JOIN q ON m.lang IS NOT DISTINCT FROM q.lang AND m.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND verdict AS kept FROM k
"""
