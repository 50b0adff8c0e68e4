"""Tab-separated text formats: BED, GFF3, PAF and VCF, parsed and written as column expressions.

A ``parse_*`` function takes lines (``value string``) and gives typed rows; a ``*_lines`` function does
the reverse. Both stay in generated code, so a reader is a text scan and one projection. Coordinates
are 0-based and half-open; qualifiers are ``array<struct<key string, value string>>``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Readable names of abbreviated tags.
TAG_NAMES = {"dp": "depth", "ln": "length", "kc": "kmer count"}
QUALIFIERS = "array<struct<key:string,value:string>>"


def empty() -> Column:
    return F.array().cast(QUALIFIERS)


def pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def optional(key: str, value: Column) -> Column:
    """A qualifier list of one entry, or none where the value is null."""
    return F.when(value.isNotNull(), F.array(pair(F.lit(key), value))).otherwise(empty())


def get(qualifiers: Column, *keys: str) -> Column:
    """The first value under the first of the keys that is present."""

    def first(key: str) -> Column:
        return F.get(F.filter(qualifiers, lambda q: q.key == key), F.lit(0)).value

    return F.coalesce(*map(first, keys))


def rows(lines: DataFrame, least: int) -> DataFrame:
    """``p``, the columns of each line; blank lines, comments and lines of fewer than ``least`` columns go."""
    v = F.regexp_replace("value", "\r$", "")
    d = lines.select(v.alias("value")).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    return d.select(F.split("value", "\t").alias("p")).where(F.size("p") >= least)


def at(i: int) -> Column:
    """Column i of a line, from 0; null beyond the end."""
    return F.get(F.col("p"), F.lit(i))


def known(i: int) -> Column:
    """Column i, null for a dot."""
    return F.when(at(i) != ".", at(i))


def strand_of(c: Column) -> Column:
    return F.when(c == "+", 1).when(c == "-", -1).otherwise(0)


def strand_text(c: Column) -> Column:
    return F.when(c == 1, "+").when(c == -1, "-").otherwise(".")


def tags(parts: Column) -> Column:
    """``TAG:TYPE:VALUE`` entries as qualifiers; malformed ones, and numbers that are none, are skipped."""
    split = F.transform(F.filter(parts, lambda t: F.length(t) >= 5), lambda t: F.split(t, ":", 3))
    number = lambda s: F.get(s, F.lit(1)).isin("i", "f")
    good = F.filter(split, lambda s: (F.size(s) == 3) & (~number(s) | F.get(s, F.lit(2)).try_cast("double").isNotNull()))
    name = lambda k: F.coalesce(*(F.when(F.lower(k) == a, b) for a, b in TAG_NAMES.items()), k)
    return F.transform(good, lambda s: pair(name(F.get(s, F.lit(0))), F.get(s, F.lit(2))))


# ---------------------------------------------------------------- BED


def parse_bed(lines: DataFrame) -> DataFrame:
    """``seq_id, start, end, strand, key, score, blocks``; a score of 0 is null."""
    return rows(lines, 3).select(
        at(0).alias("seq_id"), at(1).cast("long").alias("start"), at(2).cast("long").alias("end"), strand_of(at(5)).alias("strand"), known(3).alias("key"),
        F.when(known(4).try_cast("double") != 0, known(4).try_cast("double")).alias("score"), F.when(F.size("p") > 9, F.slice("p", 10, F.size("p"))).alias("blocks"),
    )


def bed_lines(features: DataFrame) -> DataFrame:
    """Six columns; the name is the qualifier Name, ID or gene, or else the key."""
    q = get(F.col("qualifiers"), "Name", "ID", "gene") if "qualifiers" in features.columns else F.lit(None).cast("string")
    score = F.coalesce(F.col("score"), F.lit(0.0)) if "score" in features.columns else F.lit(0.0)
    return features.select(F.concat_ws("\t", "seq_id", "start", "end", F.coalesce(q, "key", F.lit(".")), number_text(score), strand_text(F.col("strand"))).alias("value"))


def number_text(c: Column) -> Column:
    """A number without a fraction as an integer."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


# ---------------------------------------------------------------- GFF3


def percent_decoded(c: Column) -> Column:
    """Decodes %XX; a plus stays; text that cannot be decoded stays as it is."""
    return F.when(F.contains(c, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)).otherwise(c)


def attributes(c: Column) -> Column:
    """``key=value;`` lists as qualifiers, values decoded."""
    item = lambda x: pair(F.split_part(x, F.lit("="), F.lit(1)), percent_decoded(F.regexp_replace(x, "^[^=]*=?", "")))
    q = F.transform(F.filter(F.split(c, ";"), lambda x: F.length(x) > 0), item)
    return F.when(F.contains(c, F.lit("=")), F.filter(q, lambda x: x.key != "")).otherwise(empty())


def parse_gff3(lines: DataFrame) -> DataFrame:
    """``seq_id, tool, key, start, end, score, strand, phase, qualifiers``; starts become 0-based."""
    return rows(lines, 9).select(
        at(0).alias("seq_id"), known(1).alias("tool"), at(2).alias("key"), (at(3).cast("long") - 1).alias("start"), at(4).cast("long").alias("end"),
        known(5).cast("double").alias("score"), strand_of(at(6)).alias("strand"), known(7).cast("int").alias("phase"), attributes(at(8)).alias("qualifiers"),
    )


def escaped(c: Column) -> Column:
    for a, b in (("%", "%25"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), ("\t", "%09"), ("\n", "%0A")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


GFF3_HEADER = "##gff-version 3"


def gff3_lines(features: DataFrame) -> DataFrame:
    """Nine columns; ``; = &``, percent signs, tabs and line ends in values are escaped."""
    some = lambda c, kind="string": F.col(c).cast(kind) if c in features.columns else F.lit(None).cast(kind)
    quals = F.array_join(F.transform("qualifiers", lambda q: F.concat(q.key, F.lit("="), escaped(F.coalesce(q.value, F.lit(""))))), ";")
    dot = lambda c: F.coalesce(c, F.lit("."))
    return features.select(
        F.concat_ws("\t", "seq_id", dot(some("tool")), dot(F.col("key")), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), dot(number_text(some("score", "double"))),
                    strand_text(F.col("strand")), dot(some("phase")), F.when(F.length(quals) > 0, quals).otherwise(".")).alias("value")
    )


def sequence_regions(seqs: DataFrame) -> DataFrame:
    """The ``##sequence-region`` lines of ``seq_id, seq``."""
    return seqs.select(F.concat_ws(" ", F.lit("##sequence-region"), "seq_id", F.lit("1"), F.length("seq")).alias("value"))


# ---------------------------------------------------------------- PAF


def parse_paf(lines: DataFrame) -> DataFrame:
    """Alignments with cigar (tag cg), score (tag AS) and the other tags as qualifiers; strand is the target's against the query."""
    d = rows(lines, 12).withColumn("q", tags(F.slice("p", 13, F.size("p"))))
    n = lambda i, name: at(i).cast("long").alias(name)
    return d.select(
        at(0).alias("query"), n(1, "q_len"), n(2, "q_start"), n(3, "q_end"), strand_of(at(4)).alias("strand"), at(5).alias("target"), n(6, "t_len"), n(7, "t_start"), n(8, "t_end"),
        n(9, "matches"), n(10, "aln_len"), n(11, "quality"), get(F.col("q"), "AS").try_cast("double").alias("score"), get(F.col("q"), "cg").alias("cigar"),
        F.filter("q", lambda x: ~x.key.isin("AS", "cg")).alias("qualifiers"),
    )


def paf_lines(a: DataFrame) -> DataFrame:
    """Twelve columns and tags: AS:i for whole scores, else AS:f with four digits; cg; other qualifiers as text."""
    has = lambda c: c in a.columns
    score = F.col("score").cast("double") if has("score") else F.lit(None).cast("double")
    tag = [F.when(score == F.floor(score), F.concat(F.lit("AS:i:"), score.cast("long"))).otherwise(F.concat(F.lit("AS:f:"), F.format_string("%.4f", score)))]
    tag = [F.when(score.isNotNull(), tag[0])]
    if has("cigar"):
        tag.append(F.when(F.length("cigar") > 0, F.concat(F.lit("cg:Z:"), "cigar")))
    if has("qualifiers"):
        tag.append(F.when(F.size("qualifiers") > 0, F.array_join(F.transform("qualifiers", lambda q: F.concat(q.key, F.lit(":Z:"), q.value)), "\t")))
    quality = F.col("quality") if has("quality") else F.lit(255)
    return a.select(F.concat_ws("\t", "query", "q_len", "q_start", "q_end", F.when(F.col("strand") == -1, "-").otherwise("+"), "target", "t_len", "t_start", "t_end", "matches", "aln_len", quality, *tag).alias("value"))


# ---------------------------------------------------------------- VCF

VCF_HEADER = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"


def parse_vcf(lines: DataFrame, split_alternatives: bool = False) -> DataFrame:
    """``seq_id, start, end, ref, alt, quality, filter, qualifiers``; a flag in INFO has the value ``true``.

    Several alternatives stay one text, or become a row each with ``split_alternatives``.
    """
    item = lambda x: pair(F.split_part(x, F.lit("="), F.lit(1)), F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("true"))
    start = at(1).cast("long") - 1
    d = rows(lines, 8).select(
        at(0).alias("seq_id"), start.alias("start"), (start + F.length(at(3))).alias("end"), at(3).alias("ref"), at(4).alias("alt"), known(5).cast("double").alias("quality"),
        known(6).alias("filter"), F.coalesce(F.transform(F.split(known(7), ";"), item), empty()).alias("qualifiers"),
    )
    return d.withColumn("alt", F.explode(F.split("alt", ","))) if split_alternatives else d


def vcf_lines(v: DataFrame) -> DataFrame:
    """Eight columns without header; INFO is rebuilt from the qualifiers."""
    some = lambda c, kind="string": F.col(c).cast(kind) if c in v.columns else F.lit(None).cast(kind)
    dot = lambda c: F.coalesce(c, F.lit("."))
    item = lambda q: F.when(q.value == "true", q.key).otherwise(F.concat(q.key, F.lit("="), q.value))
    info = F.array_join(F.transform("qualifiers", item), ";") if "qualifiers" in v.columns else F.lit("")
    quality = some("quality", "double")
    return v.select(
        F.concat_ws("\t", "seq_id", F.col("start") + 1, F.lit("."), "ref", "alt", dot(F.when(quality.isNotNull(), F.format_string("%.2f", quality))), dot(some("filter")), F.when(F.length(info) > 0, info).otherwise(".")).alias("value")
    )


# ---------------------------------------------------------------- files


def with_header(lines: DataFrame, header: str) -> DataFrame:
    """Every partition, and so every written file, begins with the header."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("value", pa.string())])
        yield pa.RecordBatch.from_pydict({"value": [header]}, kind)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string())], schema=kind)

    return lines.select("value").mapInArrow(run, "value string")


def write_lines(lines: DataFrame, path: str, header: str | None = None, compression: str | None = None, mode: str = "error") -> None:
    """Writes one text file a partition; each is valid by itself."""
    d = lines if header is None else with_header(lines, header)
    d.write.mode(mode).text(path, compression=compression)
