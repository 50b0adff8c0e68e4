"""The operators bound to the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import sequences as S
from strandframe.operators import alignments as A
from strandframe.operators import features as FT
from strandframe.operators import graph as G
from strandframe.operators import intervals as I
from strandframe.operators import motifs as M
from strandframe.operators import sketch as K

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- sequences

SEQ = "seqs AS (SELECT doc_id AS seq_id, translate(upper(regexp_replace(coalesce(text, ''), '[^ACGTUNacgtun]', '', 'g')), 'NU', 'AT') AS seq FROM documents)"
RC = "reverse(translate({0}, 'TCAG', 'AGTC'))"
CODON = f"substr('{S.CODE}', (instr('TCAG', substr({{0}}, 1, 1)) - 1)::INT * 16 + (instr('TCAG', substr({{0}}, 2, 1)) - 1)::INT * 4 + instr('TCAG', substr({{0}}, 3, 1))::INT, 1)"
STARTS, STOPS = (str(x) for x in (S.STARTS, S.STOPS))


def seqs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), S.clean(F.coalesce("text", F.lit(""))).alias("seq"))


def on_seqs(name: str, cols, sql: str):
    @query(name, f"WITH {SEQ} SELECT seq_id, {sql} FROM seqs")
    def run(spark, d):
        return seqs(spark, d).select("seq_id", *(c.alias(k) for k, c in cols(F.col("seq")).items()))


_count = lambda x: f"(length(seq) - length(replace(seq, '{x}', '')))"
on_seqs("sq01_encode", lambda _s: {"seq": _s}, "seq")
on_seqs("sq04_reverse_complement", lambda _s: {"rc": S.reverse_complement(_s)}, RC.format("seq") + " AS rc")
on_seqs("sq05_slice", lambda _s: {"fwd": S.slice_of(_s, F.lit(5), F.lit(25), F.lit(1)), "rev": S.slice_of(_s, F.lit(5), F.lit(25), F.lit(-1))}, f"substr(seq, 6, 20) AS fwd, {RC.format('substr(seq, 6, 20)')} AS rev")
on_seqs("sq06_contains", lambda _s: {"has": F.contains(_s, F.lit("GATTACA")), "at": F.instr(_s, F.lit("GATT"))}, "contains(seq, 'GATTACA') AS has, instr(seq, 'GATT')::INT AS at")
on_seqs("sq07_basic", lambda _s: {"n": F.length(_s), "rev": F.reverse(_s), "twice": F.length(F.concat(_s, F.repeat(_s, 2))), "lt": _s < "G"}, "length(seq)::INT AS n, reverse(seq) AS rev, length(seq || repeat(seq, 2))::INT AS twice, seq < 'G' AS lt")
on_seqs("sq09_entropy", lambda _s: {"entropy": F.round(S.entropy(_s), 6)}, "round(CASE WHEN seq = '' THEN 0.0 ELSE " + " + ".join(f"CASE WHEN {_count(x)} > 0 THEN -({_count(x)} / length(seq)::DOUBLE) * log2({_count(x)} / length(seq)::DOUBLE) ELSE 0.0 END" for x in "TCAG") + " END, 6) AS entropy")
on_seqs("sq10_gc", lambda _s: {"gc": F.round(S.gc(_s), 6)}, f"round(CASE WHEN seq = '' THEN 0.0 ELSE ({_count('G')} + {_count('C')}) / length(seq)::DOUBLE END, 6) AS gc")
on_seqs("sq11_to_rna", lambda _s: {"rna": F.translate(_s, "T", "U")}, "translate(seq, 'T', 'U') AS rna")
on_seqs("sq13_translate", lambda _s: {"protein": S.translate(_s), "to_stop": S.translate(_s, 0, True), "frame2": F.length(S.translate(_s, 2))},
        f"array_to_string(list_transform(generate_series(1, length(seq) - 2, 3), lambda i: {CODON.format('substr(seq, i, 3)')}), '') AS protein, split_part(array_to_string(list_transform(generate_series(1, length(seq) - 2, 3), lambda i: {CODON.format('substr(seq, i, 3)')}), ''), '*', 1) AS to_stop, (greatest(length(seq) - 2, 0) // 3)::INT AS frame2")
on_seqs("sq14_codon_positions", lambda _s: {"n_starts": F.size(S.codon_positions(_s, S.STARTS)), "n_stops": F.size(S.codon_positions(_s, S.STOPS)), "first_start": F.get(S.codon_positions(_s, S.STARTS), F.lit(0))},
        f"len(list_filter(generate_series(1, length(seq) - 2), lambda i: substr(seq, i, 3) IN {STARTS}))::INT AS n_starts, len(list_filter(generate_series(1, length(seq) - 2), lambda i: substr(seq, i, 3) IN {STOPS}))::INT AS n_stops, (list_filter(generate_series(1, length(seq) - 2), lambda i: substr(seq, i, 3) IN {STARTS})[1] - 1)::INT AS first_start")
on_seqs("sq16_complete_cds", lambda _s: {"cds": S.is_complete_cds(_s)}, f"length(seq) >= 6 AND length(seq) % 3 = 0 AND substr(seq, 1, 3) IN {STARTS} AND substr(seq, length(seq) - 2, 3) IN {STOPS} AS cds")


@query("sq03_detect", """
WITH u AS (SELECT doc_id AS seq_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS t FROM documents),
c AS (SELECT seq_id, unnest([{'c': length(regexp_replace(t, '[^TCAG]', '', 'g')), 'v': length(regexp_replace(t, '[^TCAGNU]', '', 'g')), 'p': 0, 'n': 'DNA'},
 {'c': length(regexp_replace(t, '[^UCAG]', '', 'g')), 'v': length(regexp_replace(t, '[^UCAGNT]', '', 'g')), 'p': -1, 'n': 'RNA'},
 {'c': length(regexp_replace(t, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')), 'v': length(regexp_replace(t, '[^ACDEFGHIKLMNPQRSTVWYXBZJUO]', '', 'g')), 'p': -2, 'n': 'AMINO'},
 {'c': length(regexp_replace(t, '[^LCAGSPFEKH]', '', 'g')), 'v': length(regexp_replace(t, '[^LCAGSPFEKH]', '', 'g')), 'p': -3, 'n': 'MURPHY_10'}]) AS x FROM u)
SELECT seq_id, max_by(x.n, (x.c, x.v, x.p)) AS alphabet FROM c GROUP BY seq_id""")  # fmt: skip
def _detect(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), S.detect(F.coalesce("text", F.lit(""))).alias("alphabet"))


@query("sq15_orfs", f"""
WITH {SEQ}, sides AS (SELECT seq_id, 1 AS strand, seq FROM seqs UNION ALL SELECT seq_id, -1, {RC.format('seq')} FROM seqs),
p AS (SELECT seq_id, strand, i - 1 AS pos, (i - 1) % 3 AS frame, substr(seq, i, 3) AS c FROM (SELECT seq_id, strand, seq, unnest(generate_series(1, length(seq) - 2)) AS i FROM sides)),
s AS (SELECT *, min(CASE WHEN c IN {STOPS} THEN pos END) OVER (PARTITION BY seq_id, strand, frame ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM p)
SELECT seq_id, strand::INT AS strand, pos::INT AS "start", (stop + 3)::INT AS "end" FROM s WHERE c IN {STARTS} AND stop IS NOT NULL AND stop + 3 - pos >= 30""")  # fmt: skip
def _orfs(spark, d):
    from strandframe.operators.orfs import find_orfs

    return find_orfs(seqs(spark, d), min_length=30)


@query("sq19_dedupe", f"WITH {SEQ} SELECT seq, min(seq_id) AS seq_id, count(*) AS n FROM seqs GROUP BY seq")
def _dedupe(spark, d):
    return seqs(spark, d).groupBy("seq").agg(F.min("seq_id").alias("seq_id"), F.count("*").alias("n"))


# ---------------------------------------------------------------- intervals

IV = """iv AS (SELECT l_suppkey AS contig, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS row_id, l_partkey AS "start", l_partkey + l_quantity::BIGINT AS "end", CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS strand, l_returnflag AS flag FROM lineitem),
a AS (SELECT * FROM iv WHERE strand = 1), b AS (SELECT * FROM iv WHERE strand = -1)"""
NARROW = """nv AS (SELECT contig, row_id, "start", "start" + 1 + row_id % 3 AS "end", strand FROM iv)"""


def _merge_sql(src: str, by: str = "contig", tol: int = 0) -> str:
    return f"""SELECT {by}, min("start") AS "start", max("end") AS "end", CASE WHEN min(strand) = max(strand) THEN min(strand) ELSE 0 END AS strand, count(*) AS n FROM (
 SELECT *, max(CASE WHEN cut = 1 THEN "start" END) OVER (PARTITION BY {by} ORDER BY "start", "end" RANGE UNBOUNDED PRECEDING) AS blk FROM (
 SELECT *, CASE WHEN pm IS NULL OR "start" > pm + {tol} THEN 1 ELSE 0 END AS cut FROM (
 SELECT *, max("end") OVER (PARTITION BY {by} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {src}))) GROUP BY {by}, blk"""


def row_id():
    """A unique id of a line item."""
    return ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")


def iv(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("contig"), row_id().alias("row_id"), F.col("l_partkey").alias("start"),
        (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"), F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("strand"), F.col("l_returnflag").alias("flag"),
    )


def narrow(spark, d) -> DataFrame:
    return iv(spark, d).drop("flag").withColumn("end", F.col("start") + 1 + F.col("row_id") % 3)


def ab(spark, d) -> tuple[DataFrame, DataFrame]:
    x = iv(spark, d)
    return x.where("strand = 1"), x.where("strand = -1")


def _mi(x: DataFrame) -> DataFrame:
    return x.select("contig", "start", "end", F.col("strand").cast("int").alias("strand"), "n")


@query("iv09_range_query", f'WITH {IV} SELECT contig, row_id, "start", "end" FROM iv WHERE "start" < 60 AND "end" > 40')
def _q(spark, d):
    return I.query(iv(spark, d), 40, 60).select("contig", "row_id", "start", "end")


_OVER = 'SELECT a.contig, a.row_id AS a_id, b.row_id AS b_id, greatest(a."start", b."start") AS s, least(a."end", b."end") AS e, a.strand FROM {0} a JOIN {1} b ON a.contig = b.contig AND a."start" < b."end" AND b."start" < a."end"'


@query("iv10_intersect", f"WITH {IV}, j AS ({_OVER.format('a', 'b')}) SELECT contig, a_id, count(*) AS pairs, sum(e - s)::BIGINT AS bases, min(s) AS first, max(e) AS last FROM j GROUP BY contig, a_id")
def _intersect(spark, d):
    j = I.overlap_join(*ab(spark, d))
    return j.groupBy("contig", "a_id").agg(F.count("*").alias("pairs"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.min("start").alias("first"), F.max("end").alias("last"))


@query("iv11_subtract", f"""
WITH {IV}, {NARROW}, x AS (SELECT * FROM nv WHERE strand = 1), y AS (SELECT * FROM nv WHERE strand = -1), m AS ({_merge_sql('y')}),
c AS (SELECT x.contig, x.row_id, x."start" AS xs, x.strand, greatest(x."start", m."start") AS cs, least(x."end", m."end") AS ce FROM x JOIN m ON x.contig = m.contig AND x."start" < m."end" AND m."start" < x."end"
 UNION ALL SELECT contig, row_id, "start", strand, "end", "end" FROM x),
g AS (SELECT contig, row_id, strand, coalesce(lag(ce) OVER (PARTITION BY contig, row_id ORDER BY cs, ce), xs) AS s, cs AS e FROM c)
SELECT contig, row_id, s AS "start", e AS "end", strand::INT AS strand FROM g WHERE s < e""")  # fmt: skip
def _subtract(spark, d):
    x = narrow(spark, d)
    return I.subtract(x.where("strand = 1"), x.where("strand = -1"))


@query("iv12_merge", f"WITH {IV}, {NARROW}, m AS ({_merge_sql('nv', tol=2)}) SELECT contig, \"start\", \"end\", strand::INT AS strand, n FROM m")
def _merge(spark, d):
    return _mi(I.merge(narrow(spark, d), 2))


@query("iv13_coverage", f'WITH {IV}, {NARROW}, m AS ({_merge_sql("nv")}) SELECT contig, sum("end" - "start")::BIGINT AS bases FROM m GROUP BY contig')
def _coverage(spark, d):
    return I.coverage(narrow(spark, d))


@query("iv14_complement", f"""
WITH {IV}, {NARROW}, m AS ({_merge_sql('nv')}), l AS (SELECT contig, max("end") + 7 AS n FROM nv GROUP BY contig),
u AS (SELECT contig, "start", "end" FROM m UNION ALL SELECT contig, n, n FROM l),
g AS (SELECT contig, lag("end", 1, 0) OVER (PARTITION BY contig ORDER BY "start", "end") AS s, "start" AS e FROM u)
SELECT contig, s AS "start", e AS "end" FROM g WHERE s < e""")  # fmt: skip
def _complement(spark, d):
    x = narrow(spark, d)
    return I.complement(x, x.groupBy("contig").agg((F.max("end") + 7).alias("length"))).drop("strand")


@query("iv15_jaccard", f"""
WITH {IV}, {NARROW}, x AS ({_merge_sql('(SELECT * FROM nv WHERE strand = 1)')}), y AS ({_merge_sql('(SELECT * FROM nv WHERE strand = -1)')}),
i AS (SELECT x.contig, sum(least(x."end", y."end") - greatest(x."start", y."start")) AS i FROM x JOIN y ON x.contig = y.contig AND x."start" < y."end" AND y."start" < x."end" GROUP BY x.contig),
p AS (SELECT contig, sum("end" - "start") AS n FROM x GROUP BY contig), q AS (SELECT contig, sum("end" - "start") AS n FROM y GROUP BY contig)
SELECT contig, round(coalesce(i.i, 0) / (coalesce(p.n, 0) + coalesce(q.n, 0) - coalesce(i.i, 0))::DOUBLE, 6) AS jaccard FROM p FULL JOIN q USING (contig) LEFT JOIN i USING (contig)""")  # fmt: skip
def _jaccard(spark, d):
    x = narrow(spark, d)
    return I.jaccard(x.where("strand = 1"), x.where("strand = -1")).withColumn("jaccard", F.round("jaccard", 6))


@query("iv16_span", f'WITH {IV} SELECT contig, max("end") - min("start") AS span FROM iv GROUP BY contig')
def _span(spark, d):
    return iv(spark, d).groupBy("contig").agg((F.max("end") - F.min("start")).alias("span"))


@query("iv17_tile", f'WITH {IV} SELECT contig, row_id, s AS "start", s + 10 AS "end" FROM (SELECT contig, row_id, unnest(generate_series("start", "end" - 10, 5)) AS s FROM iv)')
def _tile(spark, d):
    return I.tile(iv(spark, d), 10, 5).select("contig", "row_id", "start", "end")


@query("iv18_flank", f"""
WITH {IV}, f AS (SELECT contig, row_id, strand, 'upstream' AS side, CASE WHEN strand = -1 THEN "end" ELSE "start" - 20 END AS s, CASE WHEN strand = -1 THEN "end" + 20 ELSE "start" END AS e FROM iv
 UNION ALL SELECT contig, row_id, strand, 'downstream', CASE WHEN strand = -1 THEN "start" - 15 ELSE "end" END, CASE WHEN strand = -1 THEN "start" ELSE "end" + 15 END FROM iv)
SELECT contig, row_id, side, greatest(s, 0) AS "start", e AS "end", strand::INT AS strand FROM f WHERE greatest(s, 0) < e""")  # fmt: skip
def _flank(spark, d):
    return I.flank(iv(spark, d), 20, 15)


@query("iv19_promoters", f"""WITH {IV} SELECT contig, row_id, greatest(CASE WHEN strand = -1 THEN "end" - 10 ELSE "start" - 50 END, 0) AS "start", CASE WHEN strand = -1 THEN "end" + 50 ELSE "start" + 10 END AS "end", strand::INT AS strand FROM iv""")
def _promoters(spark, d):
    return I.promoters(iv(spark, d), 50, 10)


@query("iv20_pad", f"""WITH {IV} SELECT contig, row_id, greatest(CASE WHEN strand = -1 THEN "start" - 3 ELSE "start" - 8 END, 0) AS "start", CASE WHEN strand = -1 THEN "end" + 8 ELSE "end" + 3 END AS "end", strand::INT AS strand FROM iv""")
def _pad(spark, d):
    return I.pad(iv(spark, d), 8, 3)


@query("iv05_reverse_complement", f"""WITH {IV} SELECT contig, row_id, 100000 - "end" AS "start", 100000 - "start" AS "end", (-strand)::INT AS strand FROM iv""")
def _rc(spark, d):
    return I.reverse_complement(iv(spark, d), F.lit(100000))


@query("iv21_centers", f"""WITH {IV} SELECT contig, row_id, ("start" + "end") / 2.0::DOUBLE AS center, "end" - "start" AS length FROM iv""")
def _centers(spark, d):
    return iv(spark, d).select("contig", "row_id", ((F.col("start") + F.col("end")) / 2.0).alias("center"), (F.col("end") - F.col("start")).alias("length"))


_REL = """CASE WHEN e2 <= s1 THEN CASE WHEN t1 = -1 THEN 'downstream' ELSE 'upstream' END WHEN s2 >= e1 THEN CASE WHEN t1 = -1 THEN 'upstream' ELSE 'downstream' END
 WHEN s2 >= s1 AND e2 <= e1 THEN 'inside' WHEN s2 < s1 AND e2 > e1 THEN 'overlapping' WHEN s2 < s1 THEN CASE WHEN t1 = -1 THEN 'overlapping_end' ELSE 'overlapping_start' END ELSE CASE WHEN t1 = -1 THEN 'overlapping_start' ELSE 'overlapping_end' END END"""


@query("iv06_relate", f"""WITH {IV}, p AS (SELECT contig, row_id, "start" AS s1, "end" AS e1, strand AS t1, lead("start") OVER w AS s2, lead("end") OVER w AS e2 FROM iv WINDOW w AS (PARTITION BY contig ORDER BY row_id))
SELECT contig, row_id, {_REL} AS relation, greatest(0, least(e1, e2) - greatest(s1, s2)) AS overlap, least(s1, s2) AS hull_start, greatest(e1, e2) AS hull_end FROM p WHERE s2 IS NOT NULL""")  # fmt: skip
def _relate(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("contig").orderBy("row_id")
    p = iv(spark, d).select("contig", "row_id", F.col("start").alias("s1"), F.col("end").alias("e1"), F.col("strand").alias("t1"), F.lead("start").over(w).alias("s2"), F.lead("end").over(w).alias("e2")).where("s2 is not null")
    c = [F.col(x) for x in ("s1", "e1", "t1", "s2", "e2")]
    return p.select("contig", "row_id", I.relate(*c).alias("relation"), F.greatest(F.lit(0), F.least("e1", "e2") - F.greatest("s1", "s2")).alias("overlap"), F.least("s1", "s2").alias("hull_start"), F.greatest("e1", "e2").alias("hull_end"))


@query("flagship_overlap_coverage", f"""
WITH {IV}, j AS ({_OVER.format('a', 'b')}), r AS (SELECT contig, s AS "start", e AS "end", strand FROM j), m AS ({_merge_sql('r')})
SELECT contig, count(*) AS blocks, sum("end" - "start")::BIGINT AS bases, sum(n)::BIGINT AS pairs FROM m GROUP BY contig""")  # fmt: skip
def _flagship(spark, d):
    m = I.merge(I.overlap_join(*ab(spark, d)))
    return m.groupBy("contig").agg(F.count("*").alias("blocks"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.sum("n").alias("pairs"))


# ---------------------------------------------------------------- k-mers

CANON = "least(translate({0}, 'TCAG', '0123'), reverse(translate({0}, 'TCAG', '2301')))"


def _dense(k: int) -> str:
    return f"{SEQ}, dense AS (SELECT seq_id, i - 1 AS pos, {CANON.format(f'substr(seq, i, {k})')} AS hash FROM (SELECT seq_id, seq, unnest(generate_series(1, length(seq) - {k - 1})) AS i FROM seqs))"


@query("km02_dense", f"WITH {_dense(7)} SELECT seq_id, pos::INT AS pos, hash FROM dense")
def _km02(spark, d):
    return K.dense(seqs(spark, d), 7)


@query("km03_minimizers", f"""WITH {_dense(15)}, w AS (SELECT seq_id, min({{'hash': hash, 'pos': pos}}) OVER f AS m, count(*) OVER f AS n FROM dense WINDOW f AS (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT DISTINCT seq_id, (m.pos)::INT AS pos, m.hash AS hash FROM w WHERE n = 10""")
def _km03(spark, d):
    return K.minimizers(seqs(spark, d), 15, 10)


@query("km04_syncmers", f"""WITH {SEQ}, k AS (SELECT seq_id, i - 1 AS pos, substr(seq, i, 8) AS kmer FROM (SELECT seq_id, seq, unnest(generate_series(1, length(seq) - 7)) AS i FROM seqs)),
s AS (SELECT seq_id, pos, kmer, list_transform(generate_series(1, 5), lambda j: {CANON.format('substr(kmer, j, 4)')}) AS h FROM k)
SELECT seq_id, pos::INT AS pos, {CANON.format('kmer')} AS hash FROM s WHERE list_position(h, list_min(h)) - 1 = 2""")  # fmt: skip
def _km04(spark, d):
    return K.syncmers(seqs(spark, d), 8, 4, 2)


@query("km10_kmer_counts", f"WITH {_dense(5)} SELECT hash, count(*) AS n FROM dense GROUP BY hash")
def _km10(spark, d):
    return K.kmer_counts(seqs(spark, d), 5)


_MH = f"{_dense(16)}, mh AS (SELECT seq_id, hash FROM (SELECT seq_id, hash, row_number() OVER (PARTITION BY seq_id ORDER BY hash) AS r FROM (SELECT DISTINCT seq_id, hash FROM dense)) WHERE r <= 64)"


@query("km07_minhash", f"WITH {_MH} SELECT seq_id, hash FROM mh")
def _km07(spark, d):
    return K.minhash(seqs(spark, d), 16, 64)


@query("km09_all_vs_all", f"""WITH {_MH}, n AS (SELECT seq_id, count(*) AS n FROM mh GROUP BY seq_id), m AS (SELECT x.seq_id AS a_id, y.seq_id AS b_id, count(*) AS m FROM mh x JOIN mh y ON x.hash = y.hash GROUP BY 1, 2)
SELECT a_id, b_id, round(m / (p.n + q.n - m)::DOUBLE, 6) AS jaccard FROM m JOIN n p ON p.seq_id = a_id JOIN n q ON q.seq_id = b_id""")  # fmt: skip
def _km09(spark, d):
    # 16 digits in base 4 fit in a long, which is half as wide
    s = K.minhash(seqs(spark, d), 16, 64).withColumn("hash", F.conv("hash", 4, 10).cast("long"))
    return K.sketch_jaccard(s, s).withColumn("jaccard", F.round("jaccard", 6))


BQ = "bq AS (SELECT item_id AS seq_id, translate(upper(regexp_replace(coalesce(text, ''), '[^ACGTUNacgtun]', '', 'g')), 'NU', 'AT') AS seq FROM benchmark), qd AS (SELECT seq_id, i - 1 AS pos, {0} AS hash FROM (SELECT seq_id, seq, unnest(generate_series(1, length(seq) - 13)) AS i FROM bq))".format(CANON.format("substr(seq, i, 14)"))
_HITS = f"{_dense(14)}, {BQ}, hits AS (SELECT q.seq_id AS query, t.seq_id AS target, q.pos AS q_pos, t.pos AS t_pos FROM qd q JOIN dense t ON q.hash = t.hash)"


def _hits(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("seq_id"), S.clean(F.coalesce("text", F.lit(""))).alias("seq"))
    return K.seed_hits(K.dense(q, 14), K.dense(seqs(spark, d), 14))


@query("km06_seed_hits", f"WITH {_HITS} SELECT query, target, q_pos::INT AS q_pos, t_pos::INT AS t_pos FROM hits")
def _km06(spark, d):
    return _hits(spark, d)


@query("al03_seed_chains", f"""WITH {_HITS}, l AS (SELECT *, q_pos - lag(q_pos) OVER w AS dq, t_pos - lag(t_pos) OVER w AS dt FROM hits WINDOW w AS (PARTITION BY query, target ORDER BY q_pos, t_pos)),
c AS (SELECT *, sum(CASE WHEN dq IS NULL OR dq > 500 OR abs(dt - dq) > 100 OR dt < -100 THEN 1 ELSE 0 END) OVER (PARTITION BY query, target ORDER BY q_pos, t_pos ROWS UNBOUNDED PRECEDING) AS ch FROM l)
SELECT query, target, min(q_pos)::INT AS q_start, max(q_pos)::INT AS q_end, min(t_pos)::INT AS t_start, max(t_pos)::INT AS t_end, count(*) AS n FROM c GROUP BY query, target, ch HAVING count(*) >= 2""")  # fmt: skip
def _al03(spark, d):
    return K.chain_seeds(_hits(spark, d))


# ---------------------------------------------------------------- alignments

AL = """al AS (SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS row_id, l_orderkey AS query, l_suppkey AS target, l_extendedprice AS score, l_linenumber * 100 AS q_start, l_linenumber * 100 + l_quantity::BIGINT AS q_end, 1000 AS q_len,
 l_partkey AS t_start, l_partkey + l_quantity::BIGINT AS t_end, 30000 AS t_len, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS strand, (l_quantity * (1 - l_discount))::BIGINT AS matches, l_quantity::BIGINT AS aln_len FROM lineitem)"""


def al(spark, d) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    return table(spark, d, "lineitem").select(
        row_id().alias("row_id"), F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("target"), F.col("l_extendedprice").alias("score"),
        (F.col("l_linenumber") * 100).alias("q_start"), (F.col("l_linenumber") * 100 + q).alias("q_end"), F.lit(1000).alias("q_len"), F.col("l_partkey").alias("t_start"), (F.col("l_partkey") + q).alias("t_end"), F.lit(30000).alias("t_len"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("strand"), F.rint(F.col("l_quantity") * (1 - F.col("l_discount"))).cast("long").alias("matches"), q.alias("aln_len"),
    )


@query("al09_rates", f"WITH {AL} SELECT row_id, round((q_end - q_start) / q_len::DOUBLE, 6) AS q_cov, round((t_end - t_start) / t_len::DOUBLE, 6) AS t_cov FROM al")
def _al09(spark, d):
    return A.rates(al(spark, d)).select("row_id", F.round("q_cov", 6).alias("q_cov"), F.round("t_cov", 6).alias("t_cov"))


@query("al10_swap_sides", f"WITH {AL} SELECT row_id, target AS query, query AS target, t_start AS q_start, q_start::BIGINT AS t_start FROM al")
def _al10(spark, d):
    return A.swap_sides(al(spark, d)).select("row_id", "query", "target", "q_start", F.col("t_start").cast("long").alias("t_start"))


@query("al11_filter_sides", f"WITH {AL} SELECT row_id FROM al WHERE target IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND query NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _al11(spark, d):
    t = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("target"))
    q = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("query"))
    return A.filter_sides(A.filter_sides(al(spark, d), targets=t), queries=q, anti=True).select("row_id")


@query("al12_best", f"WITH {AL} SELECT query, row_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, row_id) AS r FROM al) WHERE r = 1")
def _al12(spark, d):
    return A.best(al(spark, d)).select("query", "row_id", "score")


@query("al14_group", f"WITH {AL} SELECT target, count(*) AS n, count(DISTINCT query) AS queries, round(max(score), 2) AS top FROM al GROUP BY target")
def _al14(spark, d):
    return al(spark, d).groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("query").alias("queries"), F.round(F.max("score"), 2).alias("top"))


@query("al15_merge_overlaps", f"""WITH {AL}, x AS (SELECT target AS contig, t_start AS "start", t_end AS "end", strand FROM al), m AS ({_merge_sql('x', tol=5)}) SELECT contig, "start", "end", strand::INT AS strand, n FROM m""")
def _al15(spark, d):
    return _mi(A.merge_overlaps(al(spark, d), 5))


@query("al17_chain")
def _al17(spark, d):
    return A.chain(al(spark, d))


@query("al18_dovetails", f"""WITH {AL} SELECT target, count(DISTINCT CASE WHEN t_start <= 10 THEN (query, strand) END) AS n_starts, count(DISTINCT CASE WHEN t_end >= 1990 THEN (query, strand) END) AS n_ends FROM al WHERE t_start <= 10 OR t_end >= 1990 GROUP BY target""")
def _al18(spark, d):
    return A.dovetails(al(spark, d).withColumn("t_len", F.lit(2000)), 10).select("target", F.size("starts").cast("long").alias("n_starts"), F.size("ends").cast("long").alias("n_ends"))


# ---------------------------------------------------------------- graph

ED = "e AS (SELECT DISTINCT o_custkey AS u, 1000000000 + l_suppkey AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey), m AS (SELECT o_custkey AS u, 1000000000 + l_suppkey AS v, l_quantity AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def multi(spark, d) -> DataFrame:
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("u"), (F.col("l_suppkey") + 1000000000).alias("v"), F.col("l_quantity").alias("q"))


@query("gr01_build", f"WITH {ED} SELECT id, count(*) AS degree FROM (SELECT u AS id FROM e UNION ALL SELECT v FROM e) GROUP BY id")
def _gr01(spark, d):
    e, n = G.build(multi(spark, d).select("u", "v"))
    deg = e.select(F.col("u").alias("id")).union(e.select("v")).groupBy("id").agg(F.count("*").alias("degree"))
    return n.join(deg, "id")


@query("gr02_subgraph", f"WITH {ED} SELECT u, v FROM e WHERE u IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND v IN (SELECT 1000000000 + s_suppkey FROM supplier WHERE s_acctbal > 0)")
def _gr02(spark, d):
    e, n = G.build(multi(spark, d).select("u", "v"))
    keep = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")).union(table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey") + 1000000000))
    return G.subgraph(e, n, keep)[0]


for _agg in ("min", "max", "sum", "mean"):
    def _gr04(spark, d, agg=_agg):
        return G.weighted(multi(spark, d), "q", reduce=agg).withColumn("w", F.round("w", 6))

    query(f"gr04_weights_{_agg}", f"WITH {ED} SELECT u, v, round({'avg' if _agg == 'mean' else _agg}(q), 6)::DOUBLE AS w FROM m GROUP BY u, v")(_gr04)


def _regional(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    a = n.select((F.col("n_nationkey") + 0).cast("long").alias("u"), (F.col("n_regionkey") + 100).cast("long").alias("v"), (F.col("n_nationkey") % 7 + 1.0).alias("w"))
    b = n.select((F.col("n_regionkey") + 100).cast("long").alias("u"), F.col("n_nationkey").cast("long").alias("v"), (F.col("n_nationkey") % 5 + 1.0).alias("w"))
    c = n.select(F.col("n_nationkey").cast("long").alias("u"), ((F.col("n_nationkey") * 3 + 1) % 25).cast("long").alias("v"), F.lit(2.5).alias("w"))
    return a.union(b).union(c).groupBy("u", "v").agg(F.min("w").alias("w"))


NG = "g AS (SELECT u, v, min(w) AS w FROM (SELECT n_nationkey::BIGINT AS u, (n_regionkey + 100)::BIGINT AS v, (n_nationkey % 7 + 1.0)::DOUBLE AS w FROM nation UNION ALL SELECT n_regionkey + 100, n_nationkey, n_nationkey % 5 + 1.0 FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 3 + 1) % 25, 2.5 FROM nation) GROUP BY u, v)"


@query("gr05_shortest_paths", f"""WITH RECURSIVE {NG}, p AS (SELECT 0::BIGINT AS id, 0.0::DOUBLE AS cost UNION SELECT g.v, p.cost + g.w FROM p JOIN g ON g.u = p.id WHERE p.cost + g.w <= 30) SELECT id, round(min(cost), 6) AS cost FROM p GROUP BY id""")
def _gr05(spark, d):
    return G.shortest_paths(_regional(spark, d), 0).select("id", F.round("cost", 6).alias("cost"))


@query("gr06_bfs_levels", f"""WITH RECURSIVE {NG}, p AS (SELECT 0::BIGINT AS id, 0 AS level UNION SELECT g.v, p.level + 1 FROM p JOIN g ON g.u = p.id WHERE p.level < 30) SELECT id, min(level)::INT AS level FROM p GROUP BY id""")
def _gr06(spark, d):
    return G.bfs_levels(_regional(spark, d), 0)


@query("gr07_simple_paths", f"""WITH RECURSIVE {NG}, p AS (SELECT [0::BIGINT] AS path, 0.0::DOUBLE AS cost UNION ALL SELECT list_append(path, g.v), cost + g.w FROM p JOIN g ON g.u = path[-1] WHERE NOT list_contains(path, g.v) AND path[-1] <> 103 AND len(path) <= 4)
SELECT array_to_string(path, '>') AS path, round(cost, 6) AS cost FROM p WHERE path[-1] = 103""")
def _gr07(spark, d):
    return G.simple_paths(_regional(spark, d), 0, 103, 4).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.round("cost", 6).alias("cost"))


@query("gr08_components", """WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey * 1000 + CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 2 END AS u, s_nationkey * 1000 + 900 AS v FROM customer JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal > c_acctbal),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT DISTINCT u AS node, u AS root FROM b UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node)
SELECT node, min(root) AS component FROM r GROUP BY node""")
def _gr08(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    e = c.join(s, (F.col("c_nationkey") == F.col("s_nationkey")) & (F.col("s_acctbal") > F.col("c_acctbal")))
    return G.clusters(e.select((F.col("c_nationkey") * 1000 + F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(2)).alias("u"), (F.col("s_nationkey") * 1000 + 900).alias("v")).distinct())


@query("gr10_otsu", """WITH h AS (SELECT least(floor(l_discount * 10 * 256), 255)::INT AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), c AS (SELECT b, sum(n) OVER (ORDER BY b) AS w0, sum(n * b) OVER (ORDER BY b) AS s0, sum(n) OVER () AS n, sum(n * b) OVER () AS s FROM h),
v AS (SELECT b, round(CASE WHEN n > w0 THEN w0 * (n - w0) * pow(s0 / w0 - (s - s0) / (n - w0), 2) ELSE -1 END, 3) AS v FROM c) SELECT ((SELECT b FROM v ORDER BY v DESC, b LIMIT 1) + 1) / 256.0::DOUBLE AS threshold""")
def _gr10(spark, d):
    return G.otsu(table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("value")))


# ---------------------------------------------------------------- features, motifs, variants

FE = "fe AS (SELECT doc_id AS seq_id, doc_id AS feature_id, 10 AS \"start\", 10 + 3 * (1 + doc_id % 20) AS \"end\", CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END AS strand, CASE WHEN doc_id % 3 = 0 THEN 'gene' ELSE 'CDS' END AS key FROM documents)"


def fe(spark, d) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(i.alias("seq_id"), i.alias("feature_id"), F.lit(10).alias("start"), (3 * (1 + i % 20) + 10).alias("end"), F.when(i % 2 == 0, 1).otherwise(-1).alias("strand"), F.when(i % 3 == 0, "gene").otherwise("CDS").alias("key"))


@query("ft05_extract", f"""WITH {SEQ}, {FE} SELECT seq_id, feature_id, key, CASE WHEN strand = -1 THEN {RC.format('substr(seq, "start" + 1, "end" - "start")')} ELSE substr(seq, "start" + 1, "end" - "start") END AS seq FROM fe JOIN seqs USING (seq_id) WHERE key = 'CDS'""")
def _ft05(spark, d):
    return FT.extract(fe(spark, d), seqs(spark, d), ["CDS"])


@query("ft07_slice", f"""WITH {FE} SELECT feature_id, greatest("start" - 20, 0)::BIGINT AS "start", least("end", 50) - 20 AS "end" FROM fe WHERE "start" < 50 AND "end" > 20""")
def _ft07(spark, d):
    return FT.slice_record(fe(spark, d), 20, 50).select("feature_id", F.col("start").cast("long").alias("start"), "end")


@query("ft09_delete", f"""WITH {FE} SELECT feature_id, CASE WHEN "start" >= 30 THEN "start" - 10 WHEN "start" > 20 THEN 20 ELSE "start" END::BIGINT AS "start", CASE WHEN "end" <= 20 THEN "end" WHEN "end" <= 30 THEN 20 ELSE "end" - 10 END::BIGINT AS "end" FROM fe WHERE NOT ("start" >= 20 AND "end" <= 30)""")
def _ft09(spark, d):
    return FT.delete_region(fe(spark, d), 20, 30).select("feature_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("ft11_reverse_complement", f"""WITH {SEQ}, {FE} SELECT feature_id, length(seq) - "end" AS "start", (length(seq) - "start")::BIGINT AS "end", (-strand)::INT AS strand FROM fe JOIN seqs USING (seq_id)""")
def _ft11(spark, d):
    return FT.reverse_complement(fe(spark, d), seqs(spark, d)).select("feature_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "strand")


@query("ft15_assembly_stats", f"WITH {SEQ} SELECT count(*) AS contigs, sum(length(seq))::BIGINT AS bases, max(length(seq))::INT AS longest FROM seqs")
def _ft15(spark, d):
    return seqs(spark, d).agg(F.count("*").alias("contigs"), F.sum(F.length("seq")).alias("bases"), F.max(F.length("seq")).alias("longest"))


@query("mt01_background", f"WITH {SEQ} SELECT symbol, sum(length(seq) - length(replace(seq, symbol, '')))::BIGINT AS n FROM seqs, (SELECT unnest(['T', 'C', 'A', 'G']) AS symbol) GROUP BY symbol")
def _mt01(spark, d):
    return M.background(seqs(spark, d)).withColumn("n", F.col("n").cast("long"))


_MOTIF = M.Motif.from_counts("box", [[8, 1, 1, 9, 1, 8], [1, 1, 1, 1, 1, 1], [1, 8, 1, 1, 8, 1], [1, 1, 8, 1, 1, 1]])


def _weight_sql(m: M.Motif) -> str:
    return " + ".join(f"CASE substr(seq, i + {k}, 1) " + " ".join(f"WHEN '{c}' THEN {m.weights[r, k]!r}" for r, c in enumerate("TCAG")).replace("np.float64(", "").replace(")", "") + " END" for k in range(m.width))


@query("mt06_scan", f"""WITH {SEQ}, p AS (SELECT seq_id, seq, unnest(generate_series(1, length(seq) - 5)) AS i FROM seqs), s AS (SELECT seq_id, i - 1 AS pos, 1 AS strand, {_weight_sql(_MOTIF)} AS score FROM p UNION ALL SELECT seq_id, i - 1, -1, {_weight_sql(_MOTIF.reverse_complement())} FROM p)
SELECT seq_id, pos::INT AS pos, strand::INT AS strand, round(score, 6)::DOUBLE AS score FROM s WHERE score >= 4.0""")  # fmt: skip
def _mt06(spark, d):
    return M.scan(seqs(spark, d), [_MOTIF], 4.0).select("seq_id", "pos", "strand", F.round("score", 6).alias("score"))


CG = "cg AS (SELECT doc_id AS row_id, (1 + doc_id % 7) || '=' || (1 + doc_id % 3) || 'X' || (1 + doc_id % 2) || 'I' || (2 + doc_id % 5) || '=' || (1 + doc_id % 4) || 'D3=' AS cigar FROM documents)"


@query("al07_cigar", f"""WITH {CG}, o AS (SELECT row_id, generate_subscripts(x, 1) AS i, unnest(x) AS p FROM (SELECT row_id, regexp_extract_all(cigar, '\\d+[MIDNSHP=XB]') AS x FROM cg)),
k AS (SELECT row_id, i - 1 AS idx, right(p, 1) AS op, regexp_extract(p, '^\\d+')::INT AS n FROM o)
SELECT row_id, idx::INT AS idx, op, n, coalesce(sum(CASE WHEN op IN ('M','I','S','=','X') THEN n ELSE 0 END) OVER w, 0)::INT AS q_off, coalesce(sum(CASE WHEN op IN ('M','D','N','=','X') THEN n ELSE 0 END) OVER w, 0)::INT AS t_off FROM k WINDOW w AS (PARTITION BY row_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")  # fmt: skip
def _al07(spark, d):
    i = F.col("doc_id")
    c = F.concat((1 + i % 7).cast("string"), F.lit("="), (1 + i % 3).cast("string"), F.lit("X"), (1 + i % 2).cast("string"), F.lit("I"), (2 + i % 5).cast("string"), F.lit("="), (1 + i % 4).cast("string"), F.lit("D3="))
    return A.cigar_ops(table(spark, d, "documents").select(i.alias("row_id"), c.alias("cigar"))).select("row_id", "idx", "op", "n", "q_off", "t_off")
