"""Document fingerprints: a Merkle tree over the sections, paragraphs and pieces of a text, in SQL functions only.

Leaves are pieces of a paragraph: a sentence, or each `piece_words` words of a longer one. A paragraph (line)
hashes its leaves, a section hashes its paragraphs, the root hashes the sections and the text. A section ends
after a paragraph whose own digest is divisible by `section_mod`, so an edit moves no later border. The
fingerprint, in hex, is

    root/section:paragraph.leaf.leaf,paragraph.leaf;section:...

Equal roots prove equal texts. Where roots differ, `edits` walks down: sections that the other text has not, in these
the paragraphs, in these the leaves.

Defined cases: a null text is empty, and the tree of an empty text has one section, paragraph and leaf; rows that
repeat a doc_id come in the order of their texts, a null doc_id is the smallest; very long texts are one row like
others; columns besides doc_id and text are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

_HEX = 8
_LEAST = -(2**63)


def _digest(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, _HEX)


def _bound(value: Column, use) -> Column:
    """`use` of a value that is worked out once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sections(text: Column, piece_words: int = 8, section_mod: int = 4) -> Column:
    """The written-out branches of the tree: one string per section."""
    w = piece_words - 1
    border = rf"((?:\S+\s+){{0,{w}}}?\S*[.!?](?=\s)|(?:\S+\s+){{{w}}}\S+(?=\s))"
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    branches = F.transform(lines, lambda line: F.transform(F.split(F.regexp_replace(line, border, "$1\u0001"), "\u0001", -1), _digest))
    paragraphs = F.transform(branches, lambda leaf: F.concat(_digest(F.array_join(leaf, "")), F.lit("."), F.array_join(leaf, ".")))
    # Paragraphs are joined by ';' where a section ends and by ',' elsewhere, then split at ';'.
    ended = F.transform(paragraphs, lambda p: F.concat(p, F.when(F.conv(F.substring(p, 1, 6), 16, 10).cast("int") % section_mod == 0, ";").otherwise(",")))
    body = F.regexp_replace(F.array_join(ended, ""), "[;,]$", "")
    return F.transform(F.split(body, ";"), lambda s: F.concat(_digest(s), F.lit(":"), s))


def seal(text: Column, branches: Column) -> Column:
    """The fingerprint of a text and its `sections`."""
    heads = F.array_join(F.transform(branches, lambda s: F.substring(s, 1, _HEX)), "")
    root = F.sha2(F.concat(F.sha2(F.coalesce(text, F.lit("")), 256), heads), 256)
    return F.concat(root, F.lit("/"), F.array_join(branches, ";"))


def fingerprint(text: Column, piece_words: int = 8, section_mod: int = 4) -> Column:
    return _bound(sections(text, piece_words, section_mod), lambda branches: seal(text, branches))


def leaves(print_: Column) -> Column:
    """The leaf digests of a fingerprint, in order."""
    body = F.regexp_replace(F.substring_index(print_, "/", -1), "[0-9a-f]+:", "")
    paragraphs = F.split(F.translate(body, ";", ","), ",")
    return F.flatten(F.transform(paragraphs, lambda p: F.split(F.substring(p, _HEX + 2, 1 << 30), r"\.")))


def likeness(a: Column, b: Column, leaves_a: Column, leaves_b: Column) -> Column:
    """1 where the roots are equal, else the share of distinct leaves that both have (Jaccard), to 6 places.

    Texts that differ only in how often or in what order leaves come stay below 1 by one leaf of all of theirs.
    """
    same = F.substring_index(a, "/", 1) == F.substring_index(b, "/", 1)
    share = F.size(F.array_intersect(leaves_a, leaves_b)) / F.size(F.array_union(leaves_a, leaves_b))
    below = 1 - 1 / (1.0 + F.size(leaves_a) + F.size(leaves_b))
    return F.when(same, F.lit(1.0)).otherwise(F.round(F.least(share, below), 6))


def _numbered(parts: Column) -> Column:
    return F.transform(parts, lambda p, i: F.struct(i.alias("i"), p.alias("p")))


def edits(a: Column, b: Column) -> Column:
    """Where fingerprint `a` differs from `b`: array of struct(section, paragraph, leaf), places from 0 in the text of `a`.

    Branches whose digest the other tree has at that level are not entered. A paragraph whose leaves are all known is
    one whose leaves were moved, repeated or lost: it is named with leaf -1. Insertions into `b` are found by `edits(b, a)`.
    """
    body = lambda x: F.split(F.substring_index(x, "/", -1), ";")
    paragraphs = lambda s: F.split(F.substring_index(s, ":", -1), ",")
    leaf_digests = lambda p: F.split(F.substring(p, _HEX + 2, 1 << 30), r"\.")

    def in_sections(v: Column) -> Column:
        changed = F.filter(_numbered(v["mine"]), lambda s: ~F.array_contains(v["theirs"], s["p"]))
        own = F.transform(changed, lambda s: F.transform(_numbered(paragraphs(s["p"])), lambda q: F.struct(s["i"].alias("section"), q["i"].alias("paragraph"), q["p"].alias("p"))))
        others = F.transform(F.array_except(v["theirs"], v["mine"]), paragraphs)
        return _bound(F.struct(F.flatten(own).alias("mine"), F.flatten(others).alias("theirs")), in_lines)

    def in_lines(v: Column) -> Column:
        lines = F.filter(v["mine"], lambda q: ~F.array_contains(v["theirs"], q["p"]))
        known = F.flatten(F.transform(F.array_except(v["theirs"], F.transform(v["mine"], lambda q: q["p"])), leaf_digests))
        return _bound(known, lambda k: F.flatten(F.transform(lines, lambda q: of_line(q, k))))

    def of_line(q: Column, known: Column) -> Column:
        place = lambda leaf: F.struct(q["section"].alias("section"), q["paragraph"].alias("paragraph"), leaf.alias("leaf"))
        new = F.filter(_numbered(leaf_digests(q["p"])), lambda x: ~F.array_contains(known, x["p"]))
        return _bound(new, lambda n: F.when(F.size(n) > 0, F.transform(n, lambda x: place(x["i"]))).otherwise(F.array(place(F.lit(-1)))))

    return _bound(F.struct(body(a).alias("mine"), body(b).alias("theirs")), in_sections)


def with_next(rows: DataFrame, made: dict[str, Column], wanted: list[str], wide: int | None = None, most: int = 64) -> DataFrame:
    """`rows` (doc_id, text) with the columns `made` of a row, and `next`: those of `wanted` in the next row.

    The order is descending doc_id; after the last comes the first. Rows are shuffled once, to ranges of doc_id whose
    borders come from a quantile sketch of that column, in three levels of `wide` (which follows the number of rows, up
    to `most`: 262,144 ranges), so a row is compared with few borders. Within a range the next row is a window's lead.
    The first row of each range also goes, as a row more, to the end of the range before it, where it is the last row's
    lead; so texts are never broadcast, only the ranges' numbers (16 bytes a range). Rows that repeat a doc_id are ordered by text, and a null doc_id is the smallest.
    """
    count = rows.count()
    wide = wide or max(1, min(most, round((count / 2000) ** (1 / 3))))
    ranges = wide**3
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    borders = rows.agg(F.percentile_approx("doc_id", shares, min(1_000_000, max(10_000, 100 * ranges))).alias("q")).first()["q"] or [0] * len(shares)
    # one literal of text, cast to numbers: the plan stays small whatever the number of borders
    table = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<bigint>")

    def above(step: int, base: Column) -> Column:
        """How many of the `wide` - 1 borders at base + step, base + 2 * step, ... lie below a row."""
        at = F.transform(F.sequence(F.lit(1), F.lit(wide - 1)), lambda i: F.element_at(table, (base + i * step).cast("int"))) if wide > 1 else F.array().cast("array<bigint>")
        return F.coalesce(F.size(F.filter(at, lambda v: v < F.col("doc_id"))), F.lit(0))

    placed = rows.withColumn("_range", F.lit(0))
    for step in (wide * wide, wide, 1):
        placed = placed.withColumn("_range", F.col("_range") + above(step, F.col("_range")) * step)
    placed = placed.withColumn("_range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_range")))
    # One row per range, in a single task: its top doc_id and the range that comes before it.
    tops = placed.groupBy("_range").agg(F.max(F.coalesce("doc_id", F.lit(_LEAST))).alias("_top"))
    line = Window.partitionBy(F.lit(0)).orderBy(F.col("_range").desc())
    tops = tops.withColumn("_before", F.coalesce(F.lag("_range").over(line), F.min("_range").over(Window.partitionBy(F.lit(0)))))
    heads = placed.join(F.broadcast(tops), "_range").where(F.coalesce("doc_id", F.lit(_LEAST)) == F.col("_top"))
    heads = heads.groupBy("_before").agg(F.min("text").alias("text")).select(F.col("_before").alias("_range"), "text", F.lit(1).alias("_head"))
    both = placed.withColumn("_head", F.lit(0)).unionByName(heads, allowMissingColumns=True)
    order = Window.partitionBy("_range").orderBy("_head", F.col("doc_id").desc_nulls_last(), "text")
    return both.withColumns(made).withColumn("next", F.lead(F.struct(*wanted)).over(order)).where("_head = 0").drop("_range", "_head")


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, which ends in the start of the next document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = {"fingerprint": fingerprint(F.col("text"))}
    rows = with_next(rows, made, ["text", "fingerprint"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 3).cast("int"))
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("_cut"))
    rows = rows.withColumn("_edited", F.concat(kept, F.substring(F.col("next.text"), F.lit(1), F.col("_cut"))))
    rows = rows.select("doc_id", "n_chars", "fingerprint", F.col("next.fingerprint").alias("_nextprint"), "_edited", sections(F.col("_edited")).alias("_s"))
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256)).withColumn("edited_fingerprint", seal(F.col("_edited"), F.col("_s"))).drop("_s", "_edited")
    for name, of in (("_a", "fingerprint"), ("_b", "edited_fingerprint"), ("_c", "_nextprint")):
        rows = rows.withColumn(name, leaves(F.col(of)))
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), a, b).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_nextprint"), a, c).alias("near_next"),
        edits(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edits"),
    )
