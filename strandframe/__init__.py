"""strandframe: a DataFrame-first analytics engine for sequences, intervals, alignments and graphs."""

__version__ = "0.1.0"
