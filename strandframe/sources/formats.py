"""One reader for all formats: by name, by suffix or by the first bytes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators.motifs import Motif
from strandframe.sources import records as R
from strandframe.sources import tabular as T

#: Suffixes of formats and of compressed files, and the order of bases in motif files.
SUFFIXES = {
    "bed": "bed", "embl": "embl", "fa": "fasta", "faa": "fasta", "fas": "fasta", "fasta": "fasta", "ffn": "fasta", "fna": "fasta", "fastq": "fastq", "fq": "fastq", "gb": "genbank", "gbff": "genbank",
    "gbk": "genbank", "gfa": "gfa", "gff": "gff3", "gff3": "gff3", "meme": "meme", "paf": "paf", "transfac": "transfac", "vcf": "vcf",
}
COMPRESSED = ("gz", "bz2", "zst", "xz")
BASES = "ACGT"
HEAD = 1024

_READERS: dict[str, Callable[[SparkSession, str], object]] = {}


def register(fmt: str, reader: Callable[[SparkSession, str], object]) -> None:
    """Adds or replaces the reader of a format."""
    _READERS[fmt] = reader


def infer(path: str) -> str | None:
    """The format that a path's suffix names, under any suffix of compression."""
    parts = path.rstrip("/*").rsplit("/", 1)[-1].lower().split(".")
    if len(parts) > 1 and parts[-1] in COMPRESSED:
        parts.pop()
    return SUFFIXES.get(parts[-1]) if len(parts) > 1 else None


def sniff(head: str) -> str | None:
    """The format of text by its first kilobyte; the first rule that fits wins."""
    head = head[:HEAD]
    first = head.split("\n", 1)[0].rstrip("\r")
    cols = first.split("\t")
    rules = (
        ("fasta", head.startswith(">")), ("fastq", head.startswith("@")), ("genbank", head.startswith("LOCUS")), ("embl", head.startswith("ID   ")), ("gff3", head.startswith("##gff")),
        ("vcf", head.startswith("##fileformat=VCF")), ("meme", head.startswith("MEME")), ("gfa", cols[0] in ("H", "S", "L", "P") and len(cols) > 1),
        ("paf", len(cols) >= 12 and cols[4] in ("+", "-")), ("gff3", len(cols) == 9 and cols[3].isdigit()), ("bed", len(cols) >= 3 and cols[1].isdigit() and cols[2].isdigit()),
        ("transfac", any(x[:2] in ("P0", "PO") for x in head.split("\n"))),
    )
    return next((name for name, ok in rules if ok), None)


def read_genomic(spark: SparkSession, path: str, fmt: str | None = None):
    """A DataFrame of records or features (GFA: segments and links; motif files: a list of motifs)."""
    fmt = fmt or infer(path)
    if fmt is None:
        first = spark.read.text(path).limit(20).toArrow().column(0).to_pylist()
        fmt = sniff("\n".join(first))
    if fmt not in _READERS:
        raise ValueError(f"unknown format of {path}: {fmt}")
    return _READERS[fmt](spark, path)


# ---------------------------------------------------------------- motif files: small, parsed on the driver


def _numbers(line: str) -> list[float] | None:
    try:
        return [float(x) for x in line.split()]
    except ValueError:
        return None


def parse_meme(text: str) -> list[Motif]:
    """Motifs of letter-probability matrices in the order of the alphabet line; a matrix without a site count has 20 sites."""
    out, name, order, rows, sites = [], "", BASES, None, 20.0
    for line in [*text.split("\n"), "MOTIF"]:
        s = line.strip()
        if s.startswith("ALPHABET="):
            order = s.split("=", 1)[1].strip() or BASES
        elif s.startswith("MOTIF"):
            if rows:
                out.append(_motif(name, np.array(rows) * sites, order))
            name, rows = " ".join(s.split()[1:2]), None
        elif s.startswith("letter-probability matrix"):
            rows, words = [], s.replace("=", "= ").split()
            sites = next((float(b) for a, b in zip(words, words[1:], strict=False) if a == "nsites="), 20.0)
        elif rows is not None and s:
            got = _numbers(s)
            if got and len(got) == len(order):
                rows.append(got)
    return out


def parse_transfac(text: str) -> list[Motif]:
    """Motifs of count matrices between a P0 line, which names the order of bases, and ``//``."""
    out, name, order, rows = [], "", BASES, []
    for line in [*text.split("\n"), "//"]:
        p = line.split()
        if not p:
            continue
        if p[0] in ("ID", "NA") and len(p) > 1:
            name = name or p[1]
        elif p[0] in ("P0", "PO"):
            order = "".join(p[1:5]).upper()
        elif p[0].isdigit() and len(p) >= 5:
            rows.append([float(x) for x in p[1:5]])
        elif p[0] == "//":
            if rows:
                out.append(_motif(name, np.array(rows), order))
            name, order, rows = "", BASES, []
    return out


def _motif(name: str, counts: np.ndarray, order: str) -> Motif:
    at = [order.replace("U", "T").index(x) for x in "TCAG"]
    return Motif.from_counts(name, counts[:, at].T)


def read_motifs(spark: SparkSession, path: str, parse: Callable[[str], list[Motif]]) -> list[Motif]:
    """Motifs of all files under a path; a motif file is a few kilobytes, so the driver parses it."""
    return [m for r in spark.read.text(path, wholetext=True).toArrow().column(0).to_pylist() for m in parse(r)]


# ---------------------------------------------------------------- packages and assemblies


def read_package(spark: SparkSession, path: str, member: str = r"\.(fna|faa|gbff|gff)$") -> DataFrame:
    """``path, member, text`` of the members of zip archives whose name matches; one archive is one task's work."""
    import pyarrow as pa

    def run(batches):
        import io
        import re
        import zipfile

        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in sorted(z.namelist()):
                        if re.search(member, n):
                            yield pa.RecordBatch.from_pydict({"path": [p], "member": [n], "text": [z.read(n).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, text string")


def load_assembly(spark: SparkSession, path: str, overlay: str | None = None, fmt: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sequences, features and links of an assembly; an overlay (BED or GFF3) adds features of known sequences; ``topology=circular`` in a description makes a link to itself."""
    fmt, got = fmt or infer(path), read_genomic(spark, path, fmt)
    cols = "seq_id string, key string, start long, end long, strand int"
    links = got[1].select("u", "u_strand", "v", "v_strand") if fmt == "gfa" else None
    seqs = got[0] if fmt == "gfa" else got
    names = cols.replace(" string", "").replace(" long", "").replace(" int", "").split(", ")
    feats = R.features_of(got).select(*names) if fmt in ("genbank", "embl") else spark.createDataFrame([], cols)
    if overlay is not None:
        feats = feats.unionByName(read_genomic(spark, overlay).select(*names).join(seqs.select("seq_id"), "seq_id", "left_semi"))
    if links is None:
        round_ = F.col("topology") == "circular" if "topology" in seqs.columns else F.contains("description", F.lit("topology=circular"))
        links = seqs.where(round_).select(F.col("seq_id").alias("u"), F.lit(1).alias("u_strand"), F.col("seq_id").alias("v"), F.lit(1).alias("v_strand"))
    return seqs, feats, links


for _name, _parse in (("bed", T.parse_bed), ("gff3", T.parse_gff3), ("paf", T.parse_paf), ("vcf", T.parse_vcf)):
    register(_name, lambda spark, path, parse=_parse: parse(spark.read.text(path)))
for _name, _read in (("fasta", R.read_fasta), ("fastq", R.read_fastq), ("gfa", R.read_gfa), ("genbank", R.read_flat), ("embl", R.read_flat)):
    register(_name, _read)
register("meme", lambda spark, path: read_motifs(spark, path, parse_meme))
register("transfac", lambda spark, path: read_motifs(spark, path, parse_transfac))
