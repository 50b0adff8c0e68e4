"""More operators bound to the driver's tables, each beside its SQL: alphabets, records, variants, weighted graphs, greedy covers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import sequences as S
from strandframe.operators import alignments as A
from strandframe.operators import features as FT
from strandframe.operators import graph as G
from strandframe.operators import intervals as I
from strandframe.operators import motifs as M
from strandframe.operators import sketch as K
from strandframe.operators import variation as V
from strandframe.plans.bindings import _HITS, AL, ED, FE, IV, RC, SEQ, _regional, _weight_sql, al, fe, iv, multi, query, seqs, table
from strandframe.plans.session import shared_dir
from strandframe.sources import generators

# ---------------------------------------------------------------- alphabets

AMINO_SEQ = "aa AS (SELECT doc_id AS seq_id, translate(upper(regexp_replace(coalesce(text, ''), '[^ACDEFGHIKLMNPQRSTVWYXBZJUOacdefghiklmnpqrstvwyxbzjuo]', '', 'g')), 'XBZJUO', 'ADELCK') AS seq FROM documents)"


def aminos(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), S.clean(F.coalesce("text", F.lit("")), "AMINO").alias("seq"))


@query("sq11_convert", f"""WITH {SEQ}, {AMINO_SEQ} SELECT seq_id, translate(seqs.seq, 'T', 'U') AS rna, seqs.seq AS dna, translate(aa.seq, 'VIMTYWDNQR', 'LLLSFFEEEK') AS reduced FROM seqs JOIN aa USING (seq_id)""")
def _sq11(spark, d):
    rna = S.convert(F.col("seq"), "DNA", "RNA")
    both = seqs(spark, d).select("seq_id", rna.alias("rna"), S.convert(rna, "RNA", "DNA").alias("dna"))
    return both.join(aminos(spark, d).select("seq_id", S.convert(F.col("seq"), "AMINO", "MURPHY_10").alias("reduced")), "seq_id")


_each = [f"(length(seq) - length(replace(seq, '{c}', ''))) * {v}::DOUBLE" for c, v in zip(S.AMINO, S.HYDROPATHY)]


@query("sq10_hydropathy", f"""WITH {AMINO_SEQ} SELECT seq_id, round(CASE WHEN seq = '' THEN 0.0 ELSE ({' + '.join(_each)}) / length(seq) END, 6) AS hydropathy FROM aa""")
def _sq10(spark, d):
    return aminos(spark, d).select("seq_id", F.round(S.hydropathy(F.col("seq")), 6).alias("hydropathy"))


@query("sq17_random")
def _sq17(spark, d):
    return generators.sequences(spark, 200, (20, 60), seed=7, weights=[1, 2, 3, 4])


# ---------------------------------------------------------------- pairs of intervals

PAIR = """pr AS (SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS row_id, l_partkey AS s1, l_partkey + l_quantity::BIGINT AS e1, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS t1,
 l_partkey + l_linenumber * 9 - 10 AS s2, l_partkey + l_linenumber * 14 - 10 AS e2, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS t2 FROM lineitem)"""


def _pairs(spark, d) -> DataFrame:
    x = iv(spark, d).join(table(spark, d, "lineitem").select("l_linenumber", (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("row_id")), "row_id")
    n = F.col("l_linenumber")
    return x.select("row_id", F.col("start").alias("s1"), F.col("end").alias("e1"), F.col("strand").alias("t1"), (F.col("start") + n * 9 - 10).alias("s2"), (F.col("start") + n * 14 - 10).alias("e2"), F.when(F.col("flag") == "R", -1).otherwise(1).alias("t2"))


@query("iv01_overlap", f"WITH {PAIR} SELECT row_id, greatest(least(e1, e2) - greatest(s1, s2), 0)::BIGINT AS bases FROM pr")
def _iv01(spark, d):
    return _pairs(spark, d).select("row_id", I.overlap(*map(F.col, ("s1", "e1", "s2", "e2"))).cast("long").alias("bases"))


@query("iv02_contains", f"WITH {PAIR} SELECT row_id, s1 <= s2 AND e2 <= e1 AS whole, s1 <= s2 AND s2 < e1 AS point FROM pr")
def _iv02(spark, d):
    s1, e1, s2, e2 = map(F.col, ("s1", "e1", "s2", "e2"))
    return _pairs(spark, d).select("row_id", I.contains(s1, e1, s2, e2).alias("whole"), I.contains(s1, e1, s2).alias("point"))


@query("iv03_hull", f"""WITH {PAIR} SELECT row_id, least(s1, s2)::BIGINT AS "start", greatest(e1, e2)::BIGINT AS "end", CASE WHEN t1 = t2 THEN t1 ELSE 0 END::INT AS strand FROM pr""")
def _iv03(spark, d):
    x = _pairs(spark, d).select("row_id", I.hull(*map(F.col, ("s1", "e1", "t1", "s2", "e2", "t2"))).alias("h"))
    return x.select("row_id", F.col("h.start").cast("long").alias("start"), F.col("h.end").cast("long").alias("end"), F.col("h.strand").cast("int").alias("strand"))


@query("iv04_intersection", f"""WITH {PAIR} SELECT row_id, greatest(s1, s2)::BIGINT AS "start", greatest(s1, s2, least(e1, e2))::BIGINT AS "end", t1::INT AS strand FROM pr""")
def _iv04(spark, d):
    x = _pairs(spark, d).select("row_id", I.intersection(*map(F.col, ("s1", "e1", "t1", "s2", "e2"))).alias("h"))
    return x.select("row_id", F.col("h.start").cast("long").alias("start"), F.col("h.end").cast("long").alias("end"), F.col("h.strand").cast("int").alias("strand"))


_COVER = f"""WITH RECURSIVE {IV}, o AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY "start", "end", row_id) AS rn FROM iv),
r AS (SELECT contig, rn, row_id, "end" AS last, true AS kept, "end" - "start" AS own FROM o WHERE rn = 1
 UNION ALL SELECT o.contig, o.rn, o.row_id, CASE WHEN greatest(r.last - o."start", 0) <= 0.1::DOUBLE * (o."end" - o."start") THEN o."end" ELSE r.last END,
 greatest(r.last - o."start", 0) <= 0.1::DOUBLE * (o."end" - o."start"), o."end" - o."start" - greatest(r.last - o."start", 0) FROM r JOIN o ON o.contig = r.contig AND o.rn = r.rn + 1)
"""


@query("iv22_cover_linear", _COVER + """SELECT iv.contig, row_id, iv."start", iv."end", iv.strand::INT AS strand FROM r JOIN iv USING (contig, row_id) WHERE kept""")
def _iv22(spark, d):
    return I.cover_linear(iv(spark, d))


@query("iv22_cover_enough", _COVER + """SELECT contig, count(*) AS n, sum(own)::BIGINT AS bases FROM r WHERE kept GROUP BY contig HAVING sum(own) >= 0.75::DOUBLE * 2400""")
def _iv22b(spark, d):
    lengths = iv(spark, d).select("contig").distinct().withColumn("length", F.lit(2400).cast("long"))
    kept = I.cover_linear(iv(spark, d), lengths=lengths, min_coverage=0.75)
    merged = I.merge(kept).groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    return kept.groupBy("contig").agg(F.count("*").alias("n")).join(merged, "contig")


# ---------------------------------------------------------------- alignments

_KEPT = "list_filter(r.kept, lambda x: least(x.e, o.t_end) - greatest(x.s, o.t_start) > 0.1::DOUBLE * o.aln_len)"


@query("al16_cull_overlaps", f"""WITH RECURSIVE {AL}, o AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, row_id) AS rn FROM al),
r AS (SELECT target, rn, row_id, true AS ok, [{{'s': t_start, 'e': t_end}}] AS kept FROM o WHERE rn = 1
 UNION ALL SELECT o.target, o.rn, o.row_id, len({_KEPT}) = 0, CASE WHEN len({_KEPT}) = 0 THEN list_append(r.kept, {{'s': o.t_start, 'e': o.t_end}}) ELSE r.kept END FROM r JOIN o ON o.target = r.target AND o.rn = r.rn + 1)
SELECT target, row_id FROM r WHERE ok""")
def _al16(spark, d):
    return A.cull_overlaps(al(spark, d)).select("target", "row_id")


@query("al19_shift_reverse", f"WITH {AL} SELECT row_id, (30000 - t_end - 5)::BIGINT AS t_start, (30000 - t_start - 5)::BIGINT AS t_end, (-strand)::INT AS strand FROM al")
def _al19(spark, d):
    return A.reverse_complement(A.shift(al(spark, d), 5), F.col("t_len")).select("row_id", F.col("t_start").cast("long").alias("t_start"), F.col("t_end").cast("long").alias("t_end"), "strand")


READS = r"""reads AS (SELECT seq_id * 12 + r AS row_id, seq_id % 40 AS contig, ((seq_id * 7 + r) % 30)::BIGINT AS t_start, r % 3 AS q_start, CASE WHEN r % 2 = 0 THEN 1 ELSE -1 END AS strand,
 (3 + seq_id % 4) || 'M1X' || (1 + r % 2) || 'I2=' || (1 + r % 3) || 'D3M1N2=2S' AS cigar, seq AS q_seq FROM seqs, (SELECT unnest(generate_series(0, 11)) AS r) WHERE length(seq) >= 100),
ops AS (SELECT row_id, i - 1 AS idx, right(p, 1) AS op, regexp_extract(p, '^\d+')::INT AS n FROM (SELECT row_id, generate_subscripts(x, 1) AS i, unnest(x) AS p FROM (SELECT row_id, regexp_extract_all(cigar, '\d+[MIDNSHP=XB]') AS x FROM reads))),
run AS (SELECT reads.*, idx, op, n, coalesce(sum(CASE WHEN op IN ('M','I','S','=','X') THEN n ELSE 0 END) OVER w, 0)::BIGINT AS qo, coalesce(sum(CASE WHEN op IN ('M','D','N','=','X') THEN n ELSE 0 END) OVER w, 0)::BIGINT AS t_o
 FROM ops JOIN reads USING (row_id) WINDOW w AS (PARTITION BY row_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
va AS (SELECT row_id, run.contig, t_start + t_o AS "start", t_start + t_o + CASE WHEN op = 'I' THEN 0 ELSE n END AS "end", strand, CASE WHEN op = 'I' THEN '' ELSE substr(t.seq, (t_start + t_o + 1)::BIGINT, n) END AS ref,
 CASE WHEN op = 'D' THEN '' ELSE substr(q_seq, (q_start + qo + 1)::BIGINT, n) END AS alt FROM run JOIN seqs t ON t.seq_id = run.contig AND length(t.seq) >= 100 WHERE op IN ('X', 'I', 'D'))"""


def reads(spark, d) -> DataFrame:
    i, r = F.col("seq_id"), F.col("r")
    text = lambda *xs: F.concat(*(x.cast("string") if isinstance(x, F.Column) else F.lit(x) for x in xs))
    x = seqs(spark, d).where(F.length("seq") >= 100).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(11))))
    cigar = text(3 + i % 4, "M1X", 1 + r % 2, "I2=", 1 + r % 3, "D3M1N2=2S")
    return x.select((i * 12 + r).alias("row_id"), (i % 40).alias("contig"), ((i * 7 + r) % 30).alias("t_start"), (r % 3).alias("q_start"), F.when(r % 2 == 0, 1).otherwise(-1).alias("strand"), cigar.alias("cigar"), F.col("seq").alias("q_seq"))


def _targets(spark, d) -> DataFrame:
    return seqs(spark, d).where("length(seq) >= 100 and seq_id < 40").select(F.col("seq_id").alias("contig"), "seq")


def _called(spark, d) -> DataFrame:
    v = V.variants(reads(spark, d).join(F.broadcast(_targets(spark, d).withColumnRenamed("seq", "t_seq")), "contig"))
    return v.select("row_id", "contig", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand", "ref", "alt")


@query("vr01_variants", f"""WITH {SEQ}, {READS} SELECT row_id, contig, "start", "end"::BIGINT AS "end", strand::INT AS strand, ref, alt FROM va""")
def _vr01(spark, d):
    return _called(spark, d)


@query("vr02_pileup", f"""WITH {SEQ}, {READS}, e AS (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM run WHERE op IN ('M', '=', 'X', 'D', 'N')),
p AS (SELECT contig, t_start + t_o + k AS pos, CASE WHEN op IN ('D', 'N') THEN '' WHEN strand = -1 THEN translate(substr(q_seq, (q_start + qo + k + 1)::BIGINT, 1), 'TCAG', 'AGTC') ELSE substr(q_seq, (q_start + qo + k + 1)::BIGINT, 1) END AS allele FROM e),
c AS (SELECT contig, pos, allele, count(*) AS n FROM p GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY contig, pos) AS depth FROM c)
SELECT contig, pos::BIGINT AS "start", (pos + 1)::BIGINT AS "end", substr(t.seq, (pos + 1)::BIGINT, 1) AS ref, allele AS alt, n, depth::BIGINT AS depth FROM x JOIN seqs t ON t.seq_id = x.contig AND length(t.seq) >= 100
WHERE depth >= 10 AND n / depth >= 0.2 AND allele <> substr(t.seq, (pos + 1)::BIGINT, 1)""")
def _vr02(spark, d):
    return V.call_pileup(reads(spark, d), _targets(spark, d))


@query("vr03_kinds", f"""WITH {SEQ}, {READS} SELECT length(ref) = 1 AND length(alt) = 1 AS is_snp, length(ref) <> length(alt) AS is_indel, (length(alt) - length(ref))::INT AS change, count(*) AS n FROM va GROUP BY ALL""")
def _vr03(spark, d):
    r, a = F.col("ref"), F.col("alt")
    return _called(spark, d).groupBy(V.is_snp(r, a).alias("is_snp"), V.is_indel(r, a).alias("is_indel"), V.length_change(r, a).alias("change")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- graphs

@query("gr03_paths", """WITH e AS (SELECT DISTINCT n_nationkey::BIGINT AS u, ((n_nationkey * 3 + 1) % 25)::BIGINT AS v FROM nation) SELECT array_to_string([b.v, a.v, a.u], '>') AS path FROM e a JOIN e b ON a.v = b.u""")
def _gr03(spark, d):
    e = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("u"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("long").alias("v")).distinct()
    back = G.reverse_edges(e)
    first, second = back.select(F.array("u", "v").alias("p"), F.col("v").alias("at")), back.select(F.array("u", "v").alias("q"), F.col("u").alias("at"))
    return first.join(second, "at").select(F.array_join(G.join_paths(F.col("p"), F.col("q")).cast("array<string>"), ">").alias("path"))


LINKS = "ln AS (SELECT o_custkey AS u, 1000000000 + l_suppkey AS v, l_discount AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


@query("gr04_penalty", f"WITH {LINKS} SELECT u, v, round(min(CASE WHEN x <= 1e-9 THEN 1e12 ELSE 1 / x END), 6)::DOUBLE AS w FROM ln GROUP BY u, v")
def _gr04p(spark, d):
    e = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("u"), (F.col("l_suppkey") + 1000000000).alias("v"), F.col("l_discount").alias("x"))
    return G.weighted(e, "x", invert=True).withColumn("w", F.round("w", 6))


for _name, _value, _reduce in (("from", "a", "min"), ("to", "b", "min"), ("sum", "a + b", "sum"), ("mean", "(a + b) * 0.5", "min"), ("max", "greatest(a, b)", "max")):
    def _gr04n(spark, d, how=_name):
        nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
        return G.node_weighted(multi(spark, d), nodes, "c_acctbal", how).withColumn("w", F.round("w", 4))

    query(f"gr04_nodes_{_name}", f"""WITH {ED}, x AS (SELECT u, v, coalesce(c1.c_acctbal, 1.0)::DOUBLE AS a, coalesce(c2.c_acctbal, 1.0)::DOUBLE AS b FROM m LEFT JOIN customer c1 ON c1.c_custkey = u LEFT JOIN customer c2 ON c2.c_custkey = v)
SELECT u, v, round({_reduce}(CASE WHEN {_value} <= 1e-9 THEN 1e12 ELSE {_value} END), 4)::DOUBLE AS w FROM x GROUP BY u, v""")(_gr04n)


_DENSE = """g AS (SELECT DISTINCT u, v, 1.0::DOUBLE AS w FROM (SELECT n_nationkey::BIGINT AS u, ((n_nationkey * 3 + 1) % 25)::BIGINT AS v FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 2 + 5) % 25 FROM nation) WHERE u <> v)"""


def _dense_graph(spark, d) -> DataFrame:
    n = F.col("n_nationkey").cast("long")
    parts = [table(spark, d, "nation").select(n.alias("u"), x.cast("long").alias("v")) for x in ((n * 3 + 1) % 25, (n + 7) % 25, (n * 2 + 5) % 25)]
    return parts[0].union(parts[1]).union(parts[2]).where("u <> v").distinct().withColumn("w", F.lit(1.0))


@query("gr06_bfs", f"""WITH RECURSIVE {_DENSE}, p AS (SELECT 0::BIGINT AS id, 0 AS level UNION SELECT g.v, p.level + 1 FROM p JOIN g ON g.u = p.id WHERE p.level < 12), l AS (SELECT id, min(level)::INT AS level FROM p GROUP BY id)
SELECT l.id, l.level, coalesce(min(f.id), -1) AS prev FROM l LEFT JOIN g ON g.v = l.id LEFT JOIN l f ON f.id = g.u AND f.level = l.level - 1 GROUP BY l.id, l.level""")
def _gr06(spark, d):
    return G.bfs(_dense_graph(spark, d), 0).fillna(-1, ["prev"])


@query("gr06_dfs")
def _gr06d(spark, d):
    return G.dfs_order(_dense_graph(spark, d), 0)


@query("gr07_simple_paths_dense", f"""WITH RECURSIVE {_DENSE}, p AS (SELECT [0::BIGINT] AS path, 0.0::DOUBLE AS cost UNION ALL SELECT list_append(path, g.v), cost + g.w FROM p JOIN g ON g.u = path[-1] WHERE NOT list_contains(path, g.v) AND path[-1] <> 13 AND len(path) <= 6)
SELECT array_to_string(path, '>') AS path, cost FROM p WHERE path[-1] = 13""")
def _gr07(spark, d):
    return G.simple_paths(_dense_graph(spark, d), 0, 13, 6).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "cost")


@query("gr09_set_cover", """WITH RECURSIVE s AS (SELECT DISTINCT p_brand AS set_id, p_partkey % 150 AS element FROM part),
r AS (SELECT 0 AS step, [m.e] AS had, NULL::VARCHAR AS set_id, 0::BIGINT AS gain, (SELECT list(DISTINCT element) FROM s) AS rest FROM (SELECT '' AS e) m
 UNION ALL SELECT step + 1, had, x.set_id, x.gain, list_filter(rest, lambda k: NOT list_contains(x.own, k)) FROM (SELECT r.step, r.had, r.rest, (SELECT max_by({'set_id': b.set_id, 'gain': b.n, 'own': b.own}, (b.n, -b.place)) FROM
  (SELECT set_id, row_number() OVER (ORDER BY set_id) AS place, len(list_intersect(l, r.rest)) AS n, l AS own FROM (SELECT set_id, list(element) AS l FROM s GROUP BY set_id)) b) AS x FROM r WHERE len(r.rest) > 0))
SELECT set_id, gain, (step - 1)::BIGINT AS step FROM r WHERE step > 0""")
def _gr09(spark, d):
    return G.set_cover(table(spark, d, "part").select(F.col("p_brand").alias("set_id"), (F.col("p_partkey") % 150).alias("element")))


# ---------------------------------------------------------------- records and features

def _with_features(parts) -> DataFrame:
    s, f = parts
    return s.select("seq_id", "seq").join(f.select("seq_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("strand").cast("int").alias("strand")), "seq_id", "left").fillna(-1, ["start", "end"]).fillna(0, ["strand"])


@query("ft07_slice_record", f"""WITH {SEQ}, {FE} SELECT s.seq_id, substr(s.seq, 21, 30) AS seq, CASE WHEN f.strand IS NULL THEN -1 ELSE greatest(f."start" - 20, 0) END::BIGINT AS "start", CASE WHEN f.strand IS NULL THEN -1 ELSE least(f."end", 50) - 20 END::BIGINT AS "end", coalesce(f.strand, 0)::INT AS strand
FROM seqs s LEFT JOIN (SELECT * FROM fe WHERE "start" < 50 AND "end" > 20) f USING (seq_id)""")
def _ft07(spark, d):
    return _with_features(FT.slice_records(seqs(spark, d), fe(spark, d), 20, 50))


@query("ft09_delete_record", f"""WITH {SEQ}, {FE} SELECT s.seq_id, substr(s.seq, 1, 20) || substr(s.seq, 31) AS seq, CASE WHEN f."start" >= 30 THEN f."start" - 10 WHEN f."start" > 20 THEN 20 ELSE f."start" END::BIGINT AS "start",
CASE WHEN f."end" <= 20 THEN f."end" WHEN f."end" <= 30 THEN 20 ELSE f."end" - 10 END::BIGINT AS "end", f.strand::INT AS strand FROM seqs s LEFT JOIN (SELECT * FROM fe WHERE NOT ("start" >= 20 AND "end" <= 30)) f USING (seq_id)""")
def _ft09(spark, d):
    return _with_features(FT.delete_from_records(seqs(spark, d), fe(spark, d), 20, 30))


@query("ft11_reverse_record", f"""WITH {SEQ}, {FE} SELECT seq_id, {RC.format('seq')} AS seq, (length(seq) - "end")::BIGINT AS "start", (length(seq) - "start")::BIGINT AS "end", (-strand)::INT AS strand FROM seqs JOIN fe USING (seq_id)""")
def _ft11(spark, d):
    return _with_features(FT.reverse_complement_records(seqs(spark, d), fe(spark, d)))


@query("ft10_insert_features", f"""WITH {SEQ}, {FE} SELECT seq_id, substr(seq, 1, 20) || 'GATTACA' || substr(seq, 21) AS seq, CASE WHEN "start" >= 20 THEN "start" + 7 ELSE "start" END::BIGINT AS "start", CASE WHEN "end" > 20 THEN "end" + 7 ELSE "end" END::BIGINT AS "end", strand::INT AS strand FROM seqs JOIN fe USING (seq_id)""")
def _ft10(spark, d):
    return _with_features(FT.insert_sequence(seqs(spark, d), fe(spark, d), 20, "GATTACA"))


QUALIFIED = "qu AS (SELECT doc_id AS seq_id, coalesce(lang, '-') AS a, coalesce(source, '-') AS b, 'v' || doc_id % 3 AS c FROM documents)"


@query("ft01_qualifiers", f"WITH {QUALIFIED} SELECT seq_id, a || ',' || c AS every, 'new' || ',' || c AS replaced, b || ',' || 'more' AS added, c AS last FROM qu")
def _ft01(spark, d):
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    q = F.array(pair("lang", F.coalesce("lang", F.lit("-"))), pair("source", F.coalesce("source", F.lit("-"))), pair("lang", F.concat(F.lit("v"), (F.col("doc_id") % 3).cast("string"))))
    x = table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), q.alias("q"))
    values = lambda c, k: F.array_join(FT.qualifier_values(c, k), ",")
    c = F.col("q")
    return x.select("seq_id", values(c, "lang").alias("every"), values(FT.set_qualifier(c, "lang", F.lit("new")), "lang").alias("replaced"), values(FT.add_qualifier(c, "source", F.lit("more")), "source").alias("added"), FT.qualifier_map(c)["lang"].alias("last"))


@query("ft02_feature_key", "SELECT doc_id AS seq_id, CASE lang WHEN 'en' THEN 'CDS' WHEN 'de' THEN 'gene' ELSE 'misc_feature' END AS key FROM documents")
def _ft02(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), FT.feature_key(F.col("lang"), {"en": "CDS", "de": "gene"}).alias("key"))


@query("ft14_assembly_graph", f"""WITH {SEQ} SELECT seq_id AS id, length(seq)::INT AS length, 'v' || seq_id % 5 AS depth, count(l.v) AS links FROM seqs LEFT JOIN (SELECT DISTINCT doc_id AS u, (doc_id * 3 + 1) % 500 AS v FROM documents) l ON l.u = seq_id GROUP BY seq_id, seq""")
def _ft14(spark, d):
    i = F.col("seq_id")
    q = F.array(F.struct(F.lit("depth").alias("key"), F.concat(F.lit("v"), (i % 5).cast("string")).alias("value")))
    links = seqs(spark, d).select(i.alias("u"), ((i * 3 + 1) % 500).alias("v"))
    edges, nodes = FT.assembly_graph(seqs(spark, d).withColumn("qualifiers", q), links.union(links), ["depth"])
    return nodes.join(edges.groupBy(F.col("u").alias("id")).agg(F.count("v").alias("links")), "id", "left").fillna(0, ["links"])


_BOXES = M.sigma70()


def _box_sql(m: M.Motif) -> str:
    part = """SELECT seq_id, i - 1 AS "start", i - 1 + {w} AS "end", {t} AS strand, '{n}' AS key, {s} AS score FROM (SELECT seq_id, seq, unnest(generate_series(1, length(seq) - {k})) AS i FROM seqs)"""
    return " UNION ALL ".join(part.format(w=m.width, t=t, n=m.name, k=m.width - 1, s=_weight_sql(x)) for t, x in ((1, m), (-1, m.reverse_complement())))


@query("mt07_sigma70_features", f"""WITH {SEQ}, h AS ({' UNION ALL '.join(map(_box_sql, _BOXES))}) SELECT seq_id, "start"::INT AS "start", "end"::INT AS "end", strand::INT AS strand, key, round(score, 6)::DOUBLE AS score FROM h WHERE score >= 6.0""")
def _mt07(spark, d):
    return M.hits_to_features(M.scan(seqs(spark, d), _BOXES, 6.0), _BOXES).withColumn("score", F.round("score", 6))


@query("km05_index", f"WITH {_HITS} SELECT query, target, q_pos::INT AS q_pos, t_pos::INT AS t_pos FROM hits")
def _km05(spark, d):
    path = K.store_index(K.dense(seqs(spark, d), 14), f"{shared_dir(spark)}/strandframe/seeds-{uuid.uuid4().hex}")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("seq_id"), S.clean(F.coalesce("text", F.lit(""))).alias("seq"))
    return K.look_up(spark, path, K.dense(q, 14))
