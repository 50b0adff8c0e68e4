"""Features on sequences: ``seq_id, feature_id, start, end, strand, key``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.functions.sequences import reverse_complement as complement_of
from strandframe.functions.sequences import slice_of


def extract(features: DataFrame, seqs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The sequence of each feature, reverse-complemented on strand -1; the key filter comes before the join."""
    f = features if keys is None else features.where(F.col("key").isin(*keys))
    return f.join(seqs.select("seq_id", "seq"), "seq_id").select("seq_id", "feature_id", "key", slice_of(F.col("seq"), F.col("start"), F.col("end"), F.col("strand")).alias("seq"))


def feature_key(name: Column, known: dict[str, str]) -> Column:
    """The key that a name stands for; misc_feature for unknown names."""
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), F.lit("misc_feature"))


def qualifier_values(qualifiers: Column, key: str) -> Column:
    """All values under a key, in order."""
    return F.transform(F.filter(qualifiers, lambda x: x.key == key), lambda x: x.value)


def add_qualifier(qualifiers: Column, key: str, value: Column) -> Column:
    return F.concat(qualifiers, F.array(F.struct(F.lit(key).alias("key"), value.alias("value"))))


def set_qualifier(qualifiers: Column, key: str, value: Column) -> Column:
    """The first value under the key replaced; added at the end if there is none."""
    at = F.array_position(F.transform(qualifiers, lambda x: x.key), F.lit(key))
    changed = F.transform(qualifiers, lambda x, i: F.struct(x.key.alias("key"), F.when(i + 1 == at, value).otherwise(x.value).alias("value")))
    return F.when(at > 0, changed).otherwise(add_qualifier(qualifiers, key, value))


def qualifier_map(qualifiers: Column) -> Column:
    """Keys with their last values."""
    last = F.filter(qualifiers, lambda x, i: ~F.exists(F.slice(qualifiers, i + 2, F.size(qualifiers)), lambda y: y.key == x.key))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x.key, x.value)))


def slice_records(seqs: DataFrame, features: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Records cut to [start, end), with the features that overlap it, clipped and shifted; empty ones go."""
    cut = F.substring("seq", start + 1, max(0, end - start))
    return seqs.withColumn("seq", cut), slice_record(features, start, end).where("start < end")


def delete_from_records(seqs: DataFrame, features: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Records without [start, end), and their features after it."""
    rest = F.concat(F.substring("seq", 1, start), F.expr(f"substring(seq, {end + 1})"))
    return seqs.withColumn("seq", rest), delete_region(features, start, end)


def reverse_complement_records(seqs: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records from their other strand, with their features."""
    return seqs.withColumn("seq", complement_of(F.col("seq"))), reverse_complement(features, seqs)


def assembly_graph(contigs: DataFrame, links: DataFrame, attributes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges ``u, v`` and their attributes from links; a node ``id, length`` and a value (the first) of each named qualifier for every contig."""
    values = [F.get(qualifier_values(F.col("qualifiers"), k), F.lit(0)).alias(k) for k in attributes or ()]
    nodes = contigs.select(F.col("seq_id").alias("id"), F.length("seq").alias("length"), *values)
    return links.dropDuplicates(), nodes


def slice_record(features: DataFrame, start: int, end: int) -> DataFrame:
    """Features that overlap [start, end), clipped and shifted."""
    f = features.where((F.col("start") < end) & (F.col("end") > start))
    return f.withColumns({"start": F.greatest(F.col("start") - start, F.lit(0)), "end": F.least(F.col("end"), F.lit(end)) - start})


def delete_region(features: DataFrame, start: int, end: int) -> DataFrame:
    """Features after [start, end) is cut out: those inside go, others shrink or shift."""
    s, e, n = F.col("start"), F.col("end"), end - start
    f = features.where(~((s >= start) & (e <= end)))
    return f.withColumns({"start": F.when(s >= end, s - n).when(s > start, F.lit(start)).otherwise(s), "end": F.when(e <= start, e).when(e <= end, F.lit(start)).otherwise(e - n)})


def shift(features: DataFrame, by: int) -> DataFrame:
    return features.withColumns({"start": F.col("start") + by, "end": F.col("end") + by})


def reverse_complement(features: DataFrame, seqs: DataFrame) -> DataFrame:
    n = seqs.select("seq_id", F.length("seq").alias("_n"))
    return features.join(n, "seq_id").withColumns({"start": F.col("_n") - F.col("end"), "end": F.col("_n") - F.col("start"), "strand": -F.col("strand")}).drop("_n")


def add_features(seqs: DataFrame, features: DataFrame) -> DataFrame:
    """Features whose record exists."""
    return features.join(seqs.select("seq_id"), "seq_id", "left_semi")


def pivot_features(seqs: DataFrame, features: DataFrame, pivot: str = "source") -> DataFrame:
    """Features whose first value under the qualifier ``pivot`` names a record, with that record as ``seq_id``; others go."""
    q = F.get(F.filter("qualifiers", lambda x: x.key == pivot), F.lit(0)).value
    return features.withColumn("seq_id", q).join(seqs.select(F.col("seq_id").cast("string").alias("seq_id")).distinct(), "seq_id", "left_semi")


def concat_records(seqs: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Joins the parts of each group end to end: ``grp, part, seq_id, seq`` to ``grp, seq`` and shifted features.

    Features of one key and strand that touch at a boundary of parts fuse; the fused one has the id, qualifiers and
    other columns of its first piece. One group becomes one sequence, so a group must fit a row, as any sequence must.
    """
    w = Window.partitionBy("grp").orderBy("part")
    off = seqs.select("grp", "part", "seq_id", F.coalesce(F.sum(F.length("seq")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    out = seqs.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seq"))), lambda x: x.seq), "").alias("seq"))
    own = [c for c in features.columns if c not in ("seq_id", "start", "end", "strand", "key")]
    f = features.join(off, "seq_id").select("grp", "key", "strand", (F.col("start") + F.col("_off")).alias("start"), (F.col("end") + F.col("_off")).alias("end"), "_off", *own)
    order = Window.partitionBy("grp", "key", "strand").orderBy("start", "end")
    joins = (F.col("start") == F.lag("end").over(order)) & (F.col("start") == F.col("_off")) & (F.col("_off") > 0)
    f = f.withColumn("_new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = [F.min_by(c, F.struct("start", "end")).alias(c) for c in own]
    return out, f.groupBy("grp", "key", "strand", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *first).drop("_run")


def insert_sequence(seqs: DataFrame, features: DataFrame, at: int, text: str, replaced: int = 0) -> tuple[DataFrame, DataFrame]:
    """Puts ``text`` at a position, over ``replaced`` symbols: later features shift, those that span the place grow, those inside it go."""
    n, end = len(text), at + replaced
    s = seqs.withColumn("seq", F.concat(F.substring("seq", 1, at), F.lit(text), F.expr(f"substring(seq, {end + 1})")))
    f = features if replaced == 0 else delete_region(features, at, end)
    a, b = F.col("start"), F.col("end")
    return s, f.withColumns({"start": F.when(a >= at, a + n).otherwise(a), "end": F.when(b > at, b + n).otherwise(b)})


def shred(seqs: DataFrame, features: DataFrame, breaks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cuts records at ``seq_id, at``: pieces ``seq_id, piece, start, end, seq`` and the features of each piece, clipped and shifted."""
    cuts = breaks.select("seq_id", "at").unionByName(seqs.select("seq_id", F.lit(0).alias("at"))).distinct()
    d = cuts.join(seqs.select("seq_id", "seq"), "seq_id").where((F.col("at") >= 0) & ((F.col("at") < F.length("seq")) | (F.col("at") == 0)))
    w = Window.partitionBy("seq_id").orderBy("at")
    d = d.select("seq_id", (F.row_number().over(w) - 1).alias("piece"), F.col("at").cast("long").alias("start"), F.coalesce(F.lead("at").over(w), F.length("seq")).cast("long").alias("end"), "seq")
    pieces = d.withColumn("seq", F.expr("substring(seq, cast(start + 1 as int), cast(end - start as int))"))
    p = pieces.select("seq_id", "piece", F.col("start").alias("_s"), F.col("end").alias("_e"))
    f = features.join(p, "seq_id").where((F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")))
    return pieces, f.withColumns({"start": F.greatest(F.col("start") - F.col("_s"), F.lit(0)), "end": F.least(F.col("end"), F.col("_e")) - F.col("_s")}).drop("_s", "_e")
