"""Sequencing reads as Spark plans: labelled strings, interval operations, pattern matching, FASTQ in and out."""

from .errors import ExpressionError, FastqError, ReadNameError, StrandError
from .functions.selector import sel
from .functions.template import template
from .names import attr, label, tr
from .operators.patterns import (
    Count,
    Exact,
    ExactPrefix,
    ExactSearch,
    ExactSuffix,
    Frac,
    GlobalAln,
    Hamming,
    HammingPrefix,
    HammingSearch,
    HammingSuffix,
    LocalAln,
    MatchType,
    Patterns,
    PrefixAln,
    SuffixAln,
)
from .reads import End, Reads, left_end, right_end, run, run_with_threads
from .record import Read, Strand

__all__ = [
    "Count", "End", "Exact", "ExactPrefix", "ExactSearch", "ExactSuffix", "ExpressionError", "FastqError", "Frac", "GlobalAln", "Hamming",
    "HammingPrefix", "HammingSearch", "HammingSuffix", "LocalAln", "MatchType", "Patterns", "PrefixAln", "Read", "ReadNameError", "Reads",
    "Strand", "StrandError", "SuffixAln", "attr", "label", "left_end", "right_end", "run", "run_with_threads", "sel", "template", "tr",
]
