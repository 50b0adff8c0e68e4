import gzip
import zipfile

import numpy as np
import pytest

from strandframe.sources import formats as X
from strandframe.sources import records as R
from strandframe.sources import tabular as T


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(gzip.compress(text.encode()) if name.endswith("gz") else text.encode())
    return str(p)


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fna.gz", ">s1 first one\nACGT\r\nAC GT\n\n>s2\nTT\n>s3 none\n")
    got = {r.seq_id: (r.description, r.seq) for r in X.read_genomic(spark, p).collect()}
    assert got == {"s1": ("first one", "ACGTACGT"), "s2": ("", "TT"), "s3": ("none", "")}
    out = str(tmp_path / "out")
    T.write_lines(R.fasta_lines(X.read_genomic(spark, p), 3), out)
    assert {r.seq_id: (r.description, r.seq) for r in R.read_fasta(spark, out).collect()} == got
    assert R.fasta_lines(spark.createDataFrame([("x", "ACGTAC")], "seq_id string, seq string"), 3).first().value == ">x\nACG\nTAC"


def test_fastq_across_blocks(spark, tmp_path):
    want = {f"r{k}": ("AC" * (k % 5 + 1), "@+" * (k % 5 + 1)) for k in range(400)}
    p = put(tmp_path, "a.fastq", "".join(f"@{k} d\n{s}\n+\n{q}\n" for k, (s, q) in want.items()) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        d = X.read_genomic(spark, p)
        assert {r.seq_id: (r.seq, r.quality) for r in d.collect()} == want
        out = str(tmp_path / "out")
        T.write_lines(R.fastq_lines(d), out)
        assert R.read_fastq(spark, out).count() == 400
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for bad in ("r1\nA\n+\nI\n", "@r1\nAC\n+\nI\n"):
        with pytest.raises(Exception, match="FASTQ record"):
            R.read_fastq(spark, put(tmp_path, "bad.fq", bad)).collect()


def test_gfa(spark, tmp_path):
    s, k = X.read_genomic(spark, put(tmp_path, "g.gfa", "H\tVN:Z:1.0\nS\ta\tACGT\tLN:i:4\tdp:f:2.5\nS\tb\t*\nL\ta\t+\tb\t-\t3M\nL\tb\t+\ta\t+\n"))
    assert {r.seq_id: (r.seq, [tuple(q) for q in r.qualifiers]) for r in s.collect()} == {"a": ("ACGT", [("length", "4"), ("depth", "2.5")]), "b": ("", [])}
    assert sorted(tuple(r)[:5] for r in k.collect()) == [("a", 1, "b", -1, "3M"), ("b", 1, "a", 1, "0M")]
    s2, k2 = R.parse_gfa(R.gfa_lines(s, k))
    assert s2.count() == 2 and sorted(tuple(r)[:5] for r in k2.collect()) == sorted(tuple(r)[:5] for r in k.collect())


def test_bed(spark):
    d = T.parse_bed(lines(spark, "# c", "", "c1\t5\t9\tx\t0\t-", "c1\t1\t4", "c2\t0\t3\ty\t7\t+\t0\t3\t0\t1\t3\t0", "broken"))
    assert [tuple(r)[:6] for r in d.collect()] == [("c1", 5, 9, -1, "x", None), ("c1", 1, 4, 0, None, None), ("c2", 0, 3, 1, "y", 7.0)]
    assert [r.blocks for r in d.collect()][2] == ["1", "3", "0"]
    assert [r.value for r in T.bed_lines(d).collect()][:2] == ["c1\t5\t9\tx\t0\t-", "c1\t1\t4\t.\t0\t."]


def test_gff3_round_trip(spark, tmp_path):
    text = "##gff-version 3\nc1\tp\tgene\t11\t20\t.\t-\t.\tID=g%3B1;Note=a+b%20c;flag\nc1\t.\tCDS\t1\t3\t2.5\t+\t0\t.\n##FASTA\n>c1\nACGT\n"
    d = X.read_genomic(spark, put(tmp_path, "a.gff", text))
    a, b = sorted(d.collect(), key=lambda r: -r.start)
    assert (a.start, a.end, a.strand, a.tool, a.score, [tuple(q) for q in a.qualifiers]) == (10, 20, -1, "p", None, [("ID", "g;1"), ("Note", "a+b c"), ("flag", "")])
    assert (b.start, b.tool, b.score, b.phase, b.qualifiers) == (0, None, 2.5, 0, [])
    out = str(tmp_path / "out")
    T.write_lines(T.gff3_lines(d), out, T.GFF3_HEADER)
    assert sorted(map(str, T.parse_gff3(spark.read.text(out)).collect())) == sorted(map(str, d.collect()))


def test_paf_round_trip(spark):
    d = T.parse_paf(lines(spark, "q\t9\t0\t9\t-\tt\t99\t5\t14\t8\t9\t60\tAS:i:12\tcg:Z:9M\tNM:i:1\tbad\tde:f:x", "q\t9\t0\t9\t+\tt\t99\t5\t14\t8\t9\t60"))
    a, b = d.collect()
    assert (a.strand, a.score, a.cigar, [tuple(q) for q in a.qualifiers], b.score, b.cigar) == (-1, 12.0, "9M", [("NM", "1")], None, None)
    assert T.paf_lines(d).first().value.endswith("60\tAS:i:12\tcg:Z:9M\tNM:Z:1")
    again = T.parse_paf(T.paf_lines(d)).collect()
    assert again == [a, b]


def test_vcf(spark, tmp_path):
    d = T.parse_vcf(lines(spark, "##fileformat=VCFv4.2", "#CHROM\tPOS", "c\t5\t.\tAC\tA,T\t30\tPASS\tDP=3;DB", "c\t9\t.\tG\tT\t.\t.\t."))
    a, b = d.collect()
    assert (a.start, a.end, a.alt, a.quality, a.filter, [tuple(q) for q in a.qualifiers]) == (4, 6, "A,T", 30.0, "PASS", [("DP", "3"), ("DB", "true")])
    assert (b.quality, b.filter, b.qualifiers) == (None, None, [])
    assert [r.value for r in T.vcf_lines(d).collect()] == ["c\t5\t.\tAC\tA,T\t30.00\tPASS\tDP=3;DB", "c\t9\t.\tG\tT\t.\t.\t."]
    T.write_lines(T.vcf_lines(d), str(tmp_path / "v"), T.VCF_HEADER)
    assert sorted(r.alt for r in T.parse_vcf(spark.read.text(str(tmp_path / "v")), True).collect()) == ["A", "T", "T"]


def test_flat_files(spark, tmp_path):
    rows = [
        ("c1", "a plasmid of many words " * 6, "Some organism", "circular", "ACGT" * 40, [("strain", "K")], [("gene", 2, 50, -1, [("gene", "ab\"c"), ("pseudo", "true"), ("translation", "M" * 130)]), ("CDS", 60, 90, 1, [])]),
        ("c2", "", "", "linear", "", [], []),
    ]
    d = spark.createDataFrame(rows, R.RECORD)
    want = {r.seq_id: r for r in d.collect()}
    for embl, name in ((False, "gb"), (True, "embl")):
        out = str(tmp_path / name)
        T.write_lines(R.flat_lines(d, embl), out)
        got = {r.seq_id: r for r in R.read_flat(spark, out).collect()}
        for k, r in want.items():
            g = got[k]
            assert (g.seq, g.topology, g.organism, [tuple(q) for q in g.qualifiers]) == (r.seq, r.topology, r.organism, [tuple(q) for q in r.qualifiers]), name
            assert [(f.key, f.start, f.end, f.strand, [tuple(q) for q in f.qualifiers]) for f in g.features] == [(f.key, f.start, f.end, f.strand, [tuple(q) for q in f.qualifiers]) for f in r.features]
    assert R.features_of(d).count() == 2
    assert R.location("join(complement(5..9),20..30)") == (4, 30, -1) and R.location("<1..>8") == (0, 8, 1) and R.location("J00194.1:100..202") == (99, 202, 1)


def test_motif_files(spark, tmp_path):
    meme = "MEME version 4\n\nALPHABET= ACGT\n\nMOTIF m1 alt\nletter-probability matrix: alength= 4 w= 2 nsites= 10 E= 0\n 0.7 0.1 0.1 0.1\n 0 0 0 1\n\nMOTIF m2\nletter-probability matrix: alength= 4\n 0.25 0.25 0.25 0.25\n"
    a, b = X.read_genomic(spark, put(tmp_path, "m.meme", meme))
    assert (a.name, a.width, b.name, b.width) == ("m1", 2, "m2", 1) and "TCAG"[int(np.argmax(a.weights[:, 0]))] == "A" and "TCAG"[int(np.argmax(a.weights[:, 1]))] == "T"
    (t,) = X.read_genomic(spark, put(tmp_path, "m.transfac", "ID  x1\nP0  A C G T\n01  9 0 0 1 A\n02  0 0 9 1 G\nXX\n//\n"))
    assert t.name == "x1" and ["TCAG"[k] for k in np.argmax(t.weights, 0)] == ["A", "G"]


def test_choice_of_format(spark, tmp_path):
    assert [X.infer(p) for p in ("/x/a.fna.gz", "a.GBFF", "b.txt", "fasta", "d/*.bed.bz2")] == ["fasta", "genbank", None, None, "bed"]
    heads = {">a": "fasta", "@r": "fastq", "LOCUS  x": "genbank", "ID   x;": "embl", "##gff-version 3": "gff3", "##fileformat=VCFv4.2": "vcf", "S\ta\tAC": "gfa", "c\t1\t2": "bed", "MEME version": "meme", "?": None}
    assert {k: X.sniff(k) for k in heads} == heads
    assert X.read_genomic(spark, put(tmp_path, "noname", "c\t1\t2\n")).count() == 1
    with pytest.raises(ValueError, match="unknown format"):
        X.read_genomic(spark, put(tmp_path, "other", "???\n"))


def test_package_and_assembly(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("d/a.fna", ">a\nAC\n")
        z.writestr("README", "x")
    assert [(r.member, r.text) for r in X.read_package(spark, str(tmp_path / "p.zip")).collect()] == [("d/a.fna", ">a\nAC\n")]
    fa = put(tmp_path, "asm.fasta", ">a topology=circular\nACGT\n>b\nAC\n")
    seqs, feats, links = X.load_assembly(spark, fa, put(tmp_path, "f.bed", "a\t0\t2\tg\nz\t0\t2\tg\n"))
    assert seqs.count() == 2 and [r.seq_id for r in feats.collect()] == ["a"] and [(r.u, r.v) for r in links.collect()] == [("a", "a")]


def test_flat_files_keep_empty_spans_and_long_sequences(spark):
    assert R.location("complement(1..0)") == (0, 0, -1) and R.location("11..10") == (10, 10, 1)
    f = [{"key": "gene", "start": 0, "end": 0, "strand": -1, "qualifiers": []}]
    for embl in (False, True):
        got = R.parse_flat(R.flat_text({"seq_id": "a", "seq": "", "features": f}, embl))
        assert got["seq"] == "" and [(x["start"], x["end"], x["strand"]) for x in got["features"]] == [(0, 0, -1)]
    assert R.parse_flat("LOCUS       a\nORIGIN\n 99999961 acgt\n100000021 ttaa\n//")["seq"] == "ACGTTTAA"
