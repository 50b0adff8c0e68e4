"""Formats, packing, alignment and event windows bound to the driver's tables, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import packing as P
from strandframe.operators import discovery
from strandframe.operators import features as FT
from strandframe.operators import pairwise as W
from strandframe.plans.bindings import AL, IV, SEQ, al, iv, query, seqs, table
from strandframe.plans.session import shared_dir
from strandframe.sources import records as R
from strandframe.sources import tabular as T
from strandframe.streaming import windows


def through_file(lines: DataFrame, header: str | None = None) -> str:
    """Writes lines to the shared folder; the path."""
    path = f"{shared_dir(lines.sparkSession)}/strandframe/text-{uuid.uuid4().hex}"
    T.write_lines(lines, path, header)
    return path


def named(d: DataFrame) -> DataFrame:
    return d.withColumn("seq_id", F.concat(F.lit("s"), F.col("seq_id")))


@query("io06_fasta", f"WITH {SEQ} SELECT 's' || seq_id AS seq_id, 'n ' || length(seq) AS description, seq FROM seqs")
def _fasta(spark, d):
    s = named(seqs(spark, d)).withColumn("description", F.concat(F.lit("n "), F.length("seq")))
    return R.read_fasta(spark, through_file(R.fasta_lines(s, 60)))


@query("io08_fastq", f"WITH {SEQ} SELECT 's' || seq_id AS seq_id, seq, repeat('@', length(seq)) AS quality FROM seqs")
def _fastq(spark, d):
    s = named(seqs(spark, d)).withColumn("quality", F.expr("repeat('@', length(seq))"))
    return R.read_fastq(spark, through_file(R.fastq_lines(s))).select("seq_id", "seq", "quality")


@query("io09_gfa", f"WITH {SEQ}, n AS (SELECT o_custkey::VARCHAR AS u, count(*) AS links FROM orders GROUP BY 1) SELECT seq_id::VARCHAR AS seq_id, seq, coalesce(links, 0) AS links FROM seqs LEFT JOIN n ON u = seq_id::VARCHAR")
def _gfa(spark, d):
    links = table(spark, d, "orders").select(F.col("o_custkey").alias("u"), F.lit(1).alias("u_strand"), F.col("o_orderkey").alias("v"), F.lit(-1).alias("v_strand"))
    s, k = R.read_gfa(spark, through_file(R.gfa_lines(seqs(spark, d), links)))
    return s.join(k.groupBy("u").agg(F.count("*").alias("links")), F.col("u") == F.col("seq_id"), "left").select("seq_id", "seq", F.coalesce("links", F.lit(0)).alias("links"))


@query("io21_genbank", f"WITH {SEQ} SELECT 's' || seq_id AS seq_id, seq, 1 AS n_features, length(seq)::BIGINT AS hull FROM seqs")
def _genbank(spark, d):
    q = F.array(T.pair(F.lit("gene"), F.lit("x y")))
    f = F.array(F.struct(F.lit("gene").alias("key"), F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("end"), F.lit(-1).alias("strand"), q.alias("qualifiers")))
    s = named(seqs(spark, d)).select("seq_id", F.lit("d").alias("description"), F.lit("o").alias("organism"), F.lit("linear").alias("topology"), "seq", T.empty().alias("qualifiers"), f.alias("features"))
    got = R.read_flat(spark, through_file(R.flat_lines(s)))
    return got.select("seq_id", "seq", F.size("features").alias("n_features"), F.get("features", F.lit(0)).end.alias("hull"))


@query("io12_bed", f"""WITH {IV} SELECT contig::VARCHAR AS seq_id, "start", "end", strand::INT AS strand, row_id::VARCHAR AS key FROM iv""")
def _bed(spark, d):
    f = iv(spark, d).select(F.col("contig").alias("seq_id"), "start", "end", "strand", F.col("row_id").cast("string").alias("key"))
    return T.parse_bed(T.bed_lines(f)).select("seq_id", "start", "end", "strand", "key")


@query("io14_gff3", f"""WITH {IV} SELECT contig::VARCHAR AS seq_id, "start", "end", strand::INT AS strand, 'a;b=c&d+e ' || row_id AS note FROM iv""")
def _gff3(spark, d):
    q = F.array(T.pair(F.lit("Note"), F.concat(F.lit("a;b=c&d+e "), F.col("row_id"))))
    f = iv(spark, d).select(F.col("contig").alias("seq_id"), "start", "end", "strand", F.lit("gene").alias("key"), q.alias("qualifiers"))
    return T.parse_gff3(spark.read.text(through_file(T.gff3_lines(f), T.GFF3_HEADER))).select("seq_id", "start", "end", "strand", T.get(F.col("qualifiers"), "Note").alias("note"))


@query("io16_paf", f"WITH {AL} SELECT query::VARCHAR AS query, target::VARCHAR AS target, q_start::BIGINT AS q_start, t_end::BIGINT AS t_end, strand::INT AS strand, row_id::VARCHAR || 'M' AS cigar FROM al")
def _paf(spark, d):
    a = al(spark, d)
    a = a.select("query", "target", "q_len", "q_start", "q_end", "strand", "t_len", "t_start", "t_end", F.lit(1).alias("matches"), F.lit(2).alias("aln_len"), "score", F.concat("row_id", F.lit("M")).alias("cigar"))
    return T.parse_paf(T.paf_lines(a)).select("query", "target", "q_start", "t_end", "strand", "cigar")


@query("io19_vcf", """SELECT o_custkey::VARCHAR AS seq_id, o_orderkey AS "start", o_orderkey + 2 AS "end", unnest(['A', 'T']) AS alt, o_orderpriority AS pri FROM orders""")
def _vcf(spark, d):
    q = F.array(T.pair(F.lit("PRI"), F.col("o_orderpriority")), T.pair(F.lit("DB"), F.lit("true")))
    v = table(spark, d, "orders").select(F.col("o_custkey").alias("seq_id"), F.col("o_orderkey").alias("start"), F.lit("AC").alias("ref"), F.lit("A,T").alias("alt"), q.alias("qualifiers"))
    return T.parse_vcf(T.vcf_lines(v), split_alternatives=True).select("seq_id", "start", "end", "alt", T.get(F.col("qualifiers"), "PRI").alias("pri"))


@query("sq08_content_id")
def _content_id(spark, d):
    return seqs(spark, d).select("seq_id", P.content_id(F.col("seq")).alias("content_id"))


@query("sq12_packed", f"WITH {SEQ} SELECT seq_id, seq, ((length(seq) + 3) // 4)::INT AS n_bytes FROM seqs")
def _packed(spark, d):
    s = seqs(spark, d).withColumns({"p": P.pack(F.col("seq")), "n": F.length("seq")})
    return s.select("seq_id", P.unpack(F.col("p"), F.col("n")).alias("seq"), F.octet_length("p").alias("n_bytes"))


@query("al04_global_alignment")
def _global(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("t_seq"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("q_seq"), F.col("s_nationkey").alias("n_nationkey"))
    return W.align(s.join(F.broadcast(n), "n_nationkey"), "global")


@query("al05_local_alignment")
def _local(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("t_seq"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("q_seq"), F.col("c_nationkey").alias("n_nationkey"))
    return W.align(c.join(F.broadcast(n), "n_nationkey"), "local")


@query("ft10_insert", f"WITH {SEQ} SELECT seq_id, substr(seq, 1, 5) || 'TTT' || substr(seq, 8) AS seq FROM seqs")
def _insert(spark, d):
    none = spark.createDataFrame([], "seq_id long, start long, end long, strand int, key string")
    return FT.insert_sequence(seqs(spark, d), none, 5, "TTT", 2)[0]


@query("ft12_shred", f"""WITH {SEQ}, c AS (SELECT seq_id, seq, unnest([0, 10, 50, 200]) AS a FROM seqs), k AS (SELECT * FROM c WHERE a < length(seq) OR a = 0)
SELECT seq_id, (row_number() OVER w - 1)::INT AS piece, a::BIGINT AS "start", coalesce(lead(a) OVER w, length(seq))::BIGINT AS "end", substr(seq, a + 1, coalesce(lead(a) OVER w, length(seq)) - a) AS seq FROM k WINDOW w AS (PARTITION BY seq_id ORDER BY a)""")
def _shred(spark, d):
    s = seqs(spark, d)
    none = spark.createDataFrame([], "seq_id long, start long, end long, strand int, key string")
    return FT.shred(s, none, s.select("seq_id", F.explode(F.array(*map(F.lit, (10, 50, 200)))).alias("at")))[0]


_ISO = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _iso(d: DataFrame, *cols: str) -> DataFrame:
    return d.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


@query("st01_tumbling", f"SELECT {_ISO.format('''date_trunc('hour', ts)''')} AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def _tumbling(spark, d):
    return _iso(windows.tumbling(table(spark, d, "events")), "window_start").withColumn("total", F.round("total", 4))


@query("st02_sliding", f"""SELECT {_ISO.format('s')} AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS s, event_type, value FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE ts IS NOT NULL) GROUP BY 1, 2""")
def _sliding(spark, d):
    return _iso(windows.sliding(table(spark, d, "events")), "window_start").withColumn("total", F.round("total", 4))


@query("st03_sessions", f"""SELECT user_id, {_ISO.format('min(ts)')} AS session_start, {_ISO.format('max(ts) + INTERVAL 30 MINUTE')} AS session_end, count(*) AS n
FROM (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, k""")
def _sessions(spark, d):
    return _iso(windows.sessions(table(spark, d, "events")), "session_start", "session_end")


@query("mt08_enriched_kmers")
def _enriched(spark, d):
    return discovery.enriched(seqs(spark, d), 6)
