"""Quality rules whose thresholds follow the data: mergeable quantile sketches per language and source.

A document fails the base rules by fixed limits (too few words, too much inner repetition). Beyond these, three
measures (symbols a word, share of repeated lines, mean word length) are held against fences that come from sketches
alone. Each measure, and the numbers of words and lines, is sketched: a value falls in a logarithmic bucket (relative
error 1 %), and a sketch is the count per bucket, so merging sketches is adding counts, exact in any order. Sketches of
a (language, source) merge into those of the language and of all rows.

A fence is a quartile moved out by `REACH` spreads. The spread is the distance of the quartiles or, where these are
equal (most texts have no symbols and no repeated line), the least step that the measure takes in the group's median
document: one symbol in its number of words, one line in its number of lines. For documents shorter than the median one
the distance is widened by the square root of how much shorter they are, as a mean of fewer words or lines scatters
more. Quartiles, spreads and medians of a group of n rows are drawn towards its language's with weight
`PRIOR_ROWS` / (n + `PRIOR_ROWS`), and a language's likewise towards those of all rows: small groups lean on their
parents without a switch. The fences are joined to the rows.

Defined cases: null or empty text has no words and fails; a null lang or source is a group of its own; rows
that repeat are counted and judged each; very long texts are counted whole; columns besides doc_id, text, lang and
source are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .bytesets import blocks
from .storage import keep
from .textstats import counts

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
GAMMA = 1.02
#: Spreads between a quartile and its fence: Tukey's outer fences.
REACH = 3.0
#: How many rows' weight a parent's quantiles have in a group's.
PRIOR_ROWS = 100.0
MEASURES = ("symbols", "dup_lines", "word_length")
#: What is sketched: the measures, and the sizes that give their least steps.
SKETCHED = (*MEASURES, "n_words", "n_lines")
#: The size whose reciprocal is a measure's least step, and by which short documents are told.
SIZE_OF = {"symbols": "n_words", "dup_lines": "n_lines", "word_length": "n_words"}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            c = counts(block)
            own = [batch.column(i).slice(block.first, block.n) for i in (0, 2, 3)]
            yield pa.record_batch([*own, *[pa.array(c[k].astype("int64")) for k in _COUNTS]], ["doc_id", "lang", "source", *_COUNTS])


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row."""
    typed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))
    return typed.mapInArrow(_count, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def _measures(rows: DataFrame) -> DataFrame:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return rows.withColumns({"symbols": F.col("n_symbols") / words, "dup_lines": F.col("n_dup_lines") / lines, "word_length": F.col("word_chars") / words})


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the sketch of each group, over rows with words."""
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in SKETCHED]))
    long = rows.where("n_words > 0").select("lang", "source", named.alias("m")).select("lang", "source", "m.*")
    bucket = F.when(F.col("value") <= 0, -(2**30)).otherwise(F.ceil(F.log("value") / F.log(F.lit(GAMMA)))).cast("int")
    return long.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, *group: str) -> DataFrame:
    return sketches.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n"))


QUANTILES = {"lo": 0.25, "mid": 0.5, "hi": 0.75}


def quantiles(sketches: DataFrame, *group: str) -> DataFrame:
    """Per group one row: rows sketched, and `<measure>_lo`, `_mid`, `_hi` (quartiles) of everything sketched."""
    by = Window.partitionBy(*group, "measure")
    ranked = sketches.withColumn("upto", F.sum("n").over(by.orderBy("bucket"))).withColumn("all", F.sum("n").over(by))
    value = F.when(F.col("bucket") == -(2**30), 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), value))
    found = ranked.groupBy(*group, "measure").agg(*[at(q).alias(side) for side, q in QUANTILES.items()], F.max("all").alias("rows"))
    pick = lambda m, side: F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}")
    return found.groupBy(*group).agg(F.max("rows").alias("rows"), *[pick(m, side) for m in SKETCHED for side in QUANTILES])


NAMES = [f"{m}_{side}" for m in SKETCHED for side in QUANTILES]


def drawn(own: Column, parent: Column, rows: Column) -> Column:
    """A group's quantile, drawn towards its parent's."""
    return (rows * own + PRIOR_ROWS * parent) / (rows + PRIOR_ROWS)


def fences(sketches: DataFrame) -> DataFrame:
    """(lang, source, NAMES): the quantiles that apply to each group."""
    # one row: those of all rows together
    whole = quantiles(merged(sketches.withColumn("every", F.lit(1)), "every"), "every").first()
    of_lang = quantiles(merged(sketches, "lang"), "lang")
    of_lang = of_lang.select("lang", *[drawn(F.col(c), F.lit(whole and whole[c]), F.col("rows")).alias(c) for c in NAMES])
    given = quantiles(sketches, "lang", "source").alias("s").join(of_lang.alias("l"), "lang")
    return given.select("lang", "source", *[drawn(F.col(f"s.{c}"), F.col(f"l.{c}"), F.col("s.rows")).alias(c) for c in NAMES])


def distance(measure: str) -> Column:
    """How far from its quartile a row's fence lies."""
    size = SIZE_OF[measure]
    spread = F.greatest(F.col(f"{measure}_hi") - F.col(f"{measure}_lo"), 1 / F.greatest(F.col(f"{size}_mid"), F.lit(1.0)))
    shorter = F.greatest(F.col(f"{size}_mid") / F.greatest(F.col(size), F.lit(1)), F.lit(1.0))
    return REACH * spread * F.sqrt(shorter)


def adaptive_rules(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, the fences that applied and `kept` for every row of `docs`."""
    rows = keep(text_counts(docs).withColumns({c: F.coalesce(c, F.lit("\u0000")) for c in ("lang", "source")}), "counts")
    limits = fences(keep(sketch(_measures(rows)), "sketches"))
    joined = _measures(rows).join(limits, ["lang", "source"], "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    joined = joined.withColumns({
        "symbols_high": F.col("symbols_hi") + distance("symbols"), "dup_lines_high": F.col("dup_lines_hi") + distance("dup_lines"),
        "word_length_low": F.col("word_length_lo") - distance("word_length"), "word_length_high": F.col("word_length_hi") + distance("word_length"),
    })
    within = (F.col("symbols") <= F.col("symbols_high")) & (F.col("dup_lines") <= F.col("dup_lines_high")) & F.col("word_length").between(F.col("word_length_low"), F.col("word_length_high"))
    out = joined.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(within, F.lit(True)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[F.round(c, 6).alias(c) for c in ("symbols_high", "dup_lines_high", "word_length_low", "word_length_high")])
