"""Sequence formats: FASTA, FASTQ, GFA, GenBank and EMBL.

Formats with a record mark are split at it by the text scan itself, so a file is read by many tasks.
A record becomes ``seq_id, description, seq`` (and more); features are rows of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.sources.tabular import strand_of, strand_text, tags

# ---------------------------------------------------------------- FASTA


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``seq_id, description, seq``; line ends and blanks inside sequences go."""
    d = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("v")).where(F.trim("v") != "")
    head = F.regexp_replace(F.split_part("v", F.lit("\n"), F.lit(1)), "\r$", "")
    body = F.when(F.contains("v", F.lit("\n")), F.regexp_replace(F.expr("substring(v, instr(v, '\n') + 1)"), r"\s", "")).otherwise("")
    return d.select(F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("description"), body.alias("seq"))


def wrapped(seq: Column, width: int) -> Column:
    """Lines of at most ``width`` symbols; one line for width 0."""
    return seq if width < 1 else F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def fasta_lines(seqs: DataFrame, width: int = 0) -> DataFrame:
    d = F.col("description") if "description" in seqs.columns else F.lit("")
    head = F.concat(F.lit(">"), "seq_id", F.when(F.length(d) > 0, F.concat(F.lit(" "), d)).otherwise(""))
    return seqs.select(F.concat(head, F.lit("\n"), wrapped(F.col("seq"), width)).alias("value"))


# ---------------------------------------------------------------- FASTQ


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value``: lines with their number in the file, from 0.

    A scan reads the lines of a block in order, so a line's number is its place in the block after the
    lines of all earlier blocks; only one count for each block is summed.
    """
    d = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"))
    blocks = d.groupBy("file", "block").agg(F.min("m").alias("m0"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("file", "block", "m0", before.alias("before"))
    return d.join(blocks, ["file", "block"]).select("file", (F.col("before") + F.col("m") - F.col("m0")).alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``seq_id, description, seq, quality`` of strict four-line records; a record that does not start with ``@`` is an error."""
    d = numbered_lines(spark, path).select("file", F.floor(F.col("line") / 4).alias("r"), (F.col("line") % 4).alias("k"), "value")
    g = d.groupBy("file", "r").agg(*(F.max(F.when(F.col("k") == k, F.col("value"))).alias(c) for k, c in enumerate("hspq"))).where((F.col("h") != "") | (F.col("s") != ""))
    head = F.when(F.startswith("h", F.lit("@")), F.substring("h", 2, 1 << 30)).otherwise(F.raise_error(F.concat(F.lit("not a FASTQ record: "), "h")))
    whole = F.when(F.length("s") == F.length("q"), F.col("q")).otherwise(F.raise_error(F.concat(F.lit("truncated FASTQ record: "), "h")))
    return g.select(F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"), F.regexp_extract(head, r"^\S*\s+(.*)$", 1).alias("description"), F.col("s").alias("seq"), whole.alias("quality"))


def fastq_lines(seqs: DataFrame) -> DataFrame:
    d = F.col("description") if "description" in seqs.columns else F.lit("")
    return seqs.select(F.concat(F.lit("@"), "seq_id", F.when(F.length(d) > 0, F.concat(F.lit(" "), d)).otherwise(""), F.lit("\n"), "seq", F.lit("\n+\n"), "quality").alias("value"))


# ---------------------------------------------------------------- GFA


def parse_gfa(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments ``seq_id, seq, qualifiers`` and links ``u, u_strand, v, v_strand, cigar, qualifiers``; a sequence ``*`` is empty, other lines are skipped."""
    d = lines.select(F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    s = d.where((at(0) == "S") & (F.size("p") >= 3)).select(at(1).alias("seq_id"), F.when(at(2) == "*", "").otherwise(at(2)).alias("seq"), tags(F.slice("p", 4, F.size("p"))).alias("qualifiers"))
    k = d.where((at(0) == "L") & (F.size("p") >= 5)).select(
        at(1).alias("u"), strand_of(at(2)).alias("u_strand"), at(3).alias("v"), strand_of(at(4)).alias("v_strand"), F.coalesce(at(5), F.lit("0M")).alias("cigar"), tags(F.slice("p", 7, F.size("p"))).alias("qualifiers")
    )
    return s, k


def read_gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_gfa(spark.read.text(path))


def gfa_lines(seqs: DataFrame, links: DataFrame) -> DataFrame:
    cigar = F.coalesce("cigar", F.lit("0M")) if "cigar" in links.columns else F.lit("0M")
    s = seqs.select(F.concat_ws("\t", F.lit("S"), "seq_id", F.when(F.length("seq") > 0, F.col("seq")).otherwise("*")).alias("value"))
    return s.unionByName(links.select(F.concat_ws("\t", F.lit("L"), "u", strand_text(F.col("u_strand")), "v", strand_text(F.col("v_strand")), cigar).alias("value")))


# ---------------------------------------------------------------- GenBank and EMBL

_QUAL = "array<struct<key:string,value:string>>"
RECORD = f"seq_id string, description string, organism string, topology string, seq string, qualifiers {_QUAL}, features array<struct<key:string,start:long,end:long,strand:int,qualifiers:{_QUAL}>>"
_NUMBER = re.compile(r"\d+")


def location(text: str) -> tuple[int, int, int]:
    """The hull of a location, 0-based and half-open, and -1 if any part is a complement; a lone ``n+1..n`` is the empty span at n."""
    own = [int(x) for x in _NUMBER.findall(re.sub(r"[^,(]*:", "", text))]
    if len(own) == 2 and own[1] == own[0] - 1 and ".." in text:
        return own[1], own[1], -1 if "complement" in text else 1
    return (min(own) - 1, max(own), -1 if "complement" in text else 1) if own else (0, 0, 1)


def _table(lines: list[str]) -> list[dict]:
    """Features of a table: the key from column 5, location and qualifiers from column 21."""
    out: list[dict] = []
    for line in lines:
        key, rest = line[5:21].strip(), line[21:].rstrip()
        if key:
            out.append({"key": key, "at": rest.strip(), "q": []})
        elif out and rest.startswith("/") and not _open(out[-1]["q"]):
            k, _, v = rest[1:].partition("=")
            out[-1]["q"].append([k, v])
        elif out and out[-1]["q"]:
            q = out[-1]["q"][-1]
            q[1] += ("" if q[0] == "translation" else " ") + rest.strip()
        elif out:
            out[-1]["at"] += rest.strip()
    for f in out:
        f["q"] = [(k, v[1:-1].replace('""', '"') if len(v) > 1 and v[0] == v[-1] == '"' else v or "true") for k, v in f["q"]]
    return out


def _open(quals: list) -> bool:
    """Whether the last qualifier's quotation is not closed yet."""
    return bool(quals) and quals[-1][1].startswith('"') and quals[-1][1].count('"') % 2 == 1


def parse_flat(text: str) -> dict | None:
    """One GenBank or EMBL record as a dictionary of :data:`RECORD`; None for blank text."""
    if not text.strip():
        return None
    r = {"seq_id": "", "description": "", "organism": "", "topology": "linear", "seq": "", "qualifiers": [], "features": []}
    feats, seq, where = [], [], ""
    for line in text.replace("\r", "").split("\n"):
        mark = line[:12].strip() if line[:1].strip() else ""
        code = line[:2]
        if where == "seq" and (not mark or mark[0].isdigit()):  # from 100,000,000 on, numbers fill the margin
            seq.append(re.sub(r"[^A-Za-z*-]", "", line))
        elif mark == "LOCUS":
            r["seq_id"], where = (line.split() + ["", ""])[1], ""
            r["topology"] = "circular" if " circular" in line else "linear"
        elif code == "ID" and line[2:5] == "   ":
            r["seq_id"] = re.split(r"[;\s]", line[5:].strip())[0]
            r["topology"] = "circular" if "circular" in line else "linear"
        elif mark in ("DEFINITION", "SOURCE") or (code in ("DE", "OS") and line[2:5] == "   "):
            where = "description" if mark == "DEFINITION" or code == "DE" else "organism"
            r[where] = (r[where] + " " + line[5 if line[2:5] == "   " else 12 :].strip()).strip()
        elif mark == "FEATURES":
            where = "features"
        elif mark == "ORIGIN" or code == "SQ":
            where = "seq"
        elif code == "FT" or (where == "features" and not mark):
            feats.append("  " + line[2:])
        elif where in ("description", "organism") and not mark and not line.lstrip().startswith("ORGANISM") and where == "description":
            r[where] += " " + line.strip()
        else:
            where = ""
    r["seq"] = "".join(seq).upper()
    for f in _table(feats):
        quals = [{"key": k, "value": v} for k, v in f["q"]]
        if f["key"] == "source":
            r["qualifiers"] += quals
            continue
        s, e, strand = location(f["at"])
        r["features"].append({"key": f["key"], "start": s, "end": e, "strand": strand, "qualifiers": quals})
    return r


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """GenBank or EMBL records with their features nested; records end at ``//``."""
    import pyarrow as pa

    schema = RECORD
    kind = spark.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for v in b.column(0).to_pylist():
                r = parse_flat(v)
                if r is not None:
                    yield pa.RecordBatch.from_pylist([r], schema=kind)

    d = spark.read.text(path, lineSep="\n//").select(F.regexp_replace("value", r"^//", "").alias("value"))
    return d.mapInArrow(run, schema)


def features_of(records: DataFrame) -> DataFrame:
    """Nested features as rows: ``seq_id, feature_id, key, start, end, strand, qualifiers``."""
    d = records.select("seq_id", F.posexplode("features").alias("feature_id", "f"))
    return d.select("seq_id", F.col("feature_id").cast("long"), "f.key", "f.start", "f.end", "f.strand", "f.qualifiers")


#: Widths of the flat file formats, and a date that stands for none.
LINE, BLOCK, WRAP, DATE = 60, 10, 80, "01-JAN-1980"


def _wrap(prefix: str, text: str) -> list[str]:
    n = WRAP - len(prefix)
    return [prefix + text[i : i + n] for i in range(0, max(1, len(text)), n)]


def flat_text(r: dict, embl: bool = False) -> str:
    """One record as GenBank or EMBL text, hard-wrapped at 80 columns."""
    pre, seq, shape = ("FT" if embl else "  "), r["seq"].lower(), r.get("topology") or "linear"
    if embl:
        out = [f"ID   {r['seq_id']}; SV 1; {shape}; genomic DNA; STD; PRO; {len(seq)} BP.", "XX", *_wrap("DE   ", r.get("description") or ""), *_wrap("OS   ", r.get("organism") or ""), "XX", "FH   Key             Location/Qualifiers", "FH"]
    else:
        out = [f"LOCUS       {r['seq_id']:<16} {len(seq):>11} bp    DNA     {shape:<8} BCT {DATE}", *_wrap("DEFINITION  ", r.get("description") or ""), *_wrap("SOURCE      ", r.get("organism") or ""), "FEATURES             Location/Qualifiers"]
    feats = [dict(f) for f in r.get("features") or []]
    if r.get("qualifiers"):
        feats.insert(0, {"key": "source", "start": 0, "end": len(seq), "strand": 1, "qualifiers": r["qualifiers"]})
    for f in feats:
        span = f"{f['start'] + 1}..{f['end']}"
        out.append(f"{pre}   {f['key']:<16}" + (f"complement({span})" if f["strand"] == -1 else span))
        for q in f["qualifiers"] or []:
            body = "/" + q["key"] + ("" if q["value"] == "true" else '="' + (q["value"] or "").replace('"', '""') + '"')
            out += _wrap(f"{pre}{'':19}", body)
    out.append(f"SQ   Sequence {len(seq)} BP;" if embl else "ORIGIN")
    for i in range(0, len(seq), LINE):
        blocks = " ".join(seq[j : j + BLOCK] for j in range(i, min(i + LINE, len(seq)), BLOCK))
        out.append(f"     {blocks:<66}{min(i + LINE, len(seq)):>9}" if embl else f"{i + 1:>9} {blocks}")
    return "\n".join([*out, "//"])


def flat_lines(records: DataFrame, embl: bool = False) -> DataFrame:
    """Records of :data:`RECORD` as text, one row each."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"value": pa.array([flat_text(r, embl) for r in b.to_pylist()], pa.string())})

    return records.mapInArrow(run, "value string")
