"""Sequence expressions over text columns of nucleotides and amino acids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols of the standard alphabets, their aliases and complements.
DNA, RNA, AMINO = "TCAG", "UCAG", "ACDEFGHIKLMNPQRSTVWY"
MURPHY_10 = "LCAGSPFEKH"
ALIASES = {"DNA": ("NU", "AT"), "RNA": ("NT", "AU"), "AMINO": ("XBZJUO", "ADELCK")}
COMPLEMENT = {"DNA": ("TCAG", "AGTC"), "RNA": ("UCAG", "AGUC")}
#: Amino acids and the symbols that stand for their groups in the reduced alphabet.
GROUPS_OF_10 = {"V": "L", "I": "L", "M": "L", "T": "S", "Y": "F", "W": "F", "D": "E", "N": "E", "Q": "E", "R": "K"}
#: The bacterial code in TCAG order and its start codons.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STARTS = ("ATG", "GTG", "TTG", "ATT", "ATC", "ATA")
#: Hydropathy of the twenty amino acids in the order of AMINO.
HYDROPATHY = (1.8, 2.5, -3.5, -3.5, 2.8, -0.4, -3.2, 4.5, -3.9, 3.8, 1.9, -3.5, -1.6, -3.5, -4.5, -0.8, -0.7, 4.2, -0.9, -1.3)

SYMBOLS = {"DNA": DNA, "RNA": RNA, "AMINO": AMINO, "MURPHY_10": MURPHY_10}
CODONS = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate(DNA) for j, b in enumerate(DNA) for k, c in enumerate(DNA)}
STOPS = tuple(k for k, v in CODONS.items() if v == "*")


def clean(text: Column, alphabet: str = "DNA") -> Column:
    """Symbols of the alphabet in upper case, aliases resolved, everything else deleted."""
    symbols = {"DNA": DNA, "RNA": RNA, "AMINO": AMINO}[alphabet]
    source, target = ALIASES[alphabet]
    keep = symbols + source
    return F.translate(F.upper(F.regexp_replace(text, f"[^{keep}{keep.lower()}]", "")), source, target)


def convert(seq: Column, source: str, target: str) -> Column:
    """A sequence of one alphabet in another: DNA and RNA both ways, AMINO to MURPHY_10 and back.

    The groups of the reduced alphabet keep their symbol on the way back. Symbols outside of the source alphabet raise an error; null gives null.
    """
    tables = {("DNA", "RNA"): {"T": "U"}, ("RNA", "DNA"): {"U": "T"}, ("AMINO", "MURPHY_10"): GROUPS_OF_10, ("MURPHY_10", "AMINO"): {}}
    if (source, target) not in tables:
        raise ValueError(f"no conversion from {source} to {target}")
    table = tables[source, target]
    bad = seq.rlike(f"[^{SYMBOLS[source]}]")
    done = F.translate(seq, "".join(table), "".join(table.values())) if table else seq
    return F.when(bad, F.raise_error(F.concat(F.lit(f"not all symbols are {source}: "), seq)).cast("string")).otherwise(done)


def count_of(seq: Column, symbol: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(symbol), F.lit("")))


def detect(text: Column) -> Column:
    """The alphabet with the most canonical and then the most valid symbols; ties: DNA, RNA, AMINO, MURPHY_10."""
    up = F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))
    valid = lambda s: F.length(F.regexp_replace(up, f"[^{s}]", ""))
    ranked = [F.struct(valid(s).alias("c"), valid(s + ALIASES.get(n, ("", ""))[0]).alias("v"), F.lit(-k).alias("p"), F.lit(n).alias("n")) for k, (n, s) in enumerate(SYMBOLS.items())]
    return F.greatest(*ranked).n


def reverse_complement(seq: Column, alphabet: str = "DNA") -> Column:
    return F.reverse(F.translate(seq, *COMPLEMENT[alphabet])) if alphabet in COMPLEMENT else seq


def slice_of(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """Half-open slice from 0; the reverse complement of it on strand -1."""
    part = F.substring(seq, start + 1, F.greatest(end - start, F.lit(0)))
    return F.when(strand == -1, reverse_complement(part)).otherwise(part)


def entropy(seq: Column, symbols: str = DNA) -> Column:
    """Shannon entropy in bits; 0 for empty."""
    n = F.length(seq).cast("double")
    terms = [F.when(count_of(seq, s) > 0, -(count_of(seq, s) / n) * F.log2(count_of(seq, s) / n)).otherwise(0.0) for s in symbols]
    return F.when(n > 0, sum(terms[1:], terms[0])).otherwise(0.0)


def property_score(seq: Column, values: dict[str, float], mean: bool = True) -> Column:
    """Sum or mean of per-symbol values; unmapped symbols do not count."""
    total = sum((count_of(seq, s) * v for s, v in values.items()), F.lit(0.0))
    n = sum((count_of(seq, s) for s in values), F.lit(0))
    return F.when(n > 0, total / n).otherwise(0.0) if mean else total


def hydropathy(seq: Column, mean: bool = True) -> Column:
    """Mean (or sum) of the hydropathy of amino acids; other symbols do not count, none give 0."""
    return property_score(seq, dict(zip(AMINO, HYDROPATHY)), mean)


def gc(seq: Column) -> Column:
    n = F.length(seq)
    return F.when(n > 0, (count_of(seq, "G") + count_of(seq, "C")) / n).otherwise(0.0)


def codon_table() -> Column:
    return F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])


def positions(n: Column, step: int = 1, start: int = 0) -> Column:
    """0-based starts up to n, empty when there are none."""
    return F.when(n > start, F.sequence(F.lit(start), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def codons(seq: Column, frame: int = 0) -> Column:
    return F.transform(positions(F.length(seq) - 2, 3, frame), lambda i: F.substring(seq, i + 1, F.lit(3)))


def translate(seq: Column, frame: int = 0, to_stop: bool = False) -> Column:
    """Amino acids of a frame; trailing bases are ignored, stops are ``*``."""
    table = "".join(CODE)
    index = lambda c, p: F.instr(F.lit(DNA), F.substring(c, F.lit(p), F.lit(1))) - 1
    protein = F.array_join(F.transform(codons(seq, frame), lambda c: F.substring(F.lit(table), index(c, 1) * 16 + index(c, 2) * 4 + index(c, 3) + 1, F.lit(1))), "")
    return F.split_part(protein, F.lit("*"), F.lit(1)) if to_stop else protein


def codon_positions(seq: Column, which: tuple[str, ...]) -> Column:
    return F.filter(positions(F.length(seq) - 2), lambda i: F.substring(seq, i + 1, F.lit(3)).isin(*which))


def is_complete_cds(seq: Column) -> Column:
    n = F.length(seq)
    return (n >= 6) & (n % 3 == 0) & F.substring(seq, 1, 3).isin(*STARTS) & F.substring(seq, n - 2, F.lit(3)).isin(*STOPS)


def kmers(seq: Column, k: int, chunk: int = 256) -> Column:
    """All k-mers in order.

    A substring of a long string costs its position, so the sequence is first cut into chunks
    that overlap by k - 1, and k-mers are cut from those.
    """
    n = F.length(seq) - (k - 1)

    def cut(c: Column) -> Column:
        part = F.array(F.substring(seq, c + 1, F.lit(chunk + k - 1)))
        return F.flatten(F.transform(part, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - (k - 1)), lambda i: F.substring(p, i, F.lit(k)))))

    return F.flatten(F.transform(positions(n, chunk), cut))


def canonical(kmer: Column) -> Column:
    """The smaller packed code of a k-mer and its reverse complement, as digits 0 to 3 of T, C, A, G."""
    return F.least(F.translate(kmer, "TCAG", "0123"), F.reverse(F.translate(kmer, "TCAG", "2301")))
