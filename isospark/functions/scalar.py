"""Scalar column functions: parsing, normalising, small sequence and interval predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# strands and ends


def start_site(start, end, strand, unstranded: str = "plain") -> Column:
    """The transcription start of an interval: the end on ``-``.  ``unstranded`` says what others give:
    'plain' (the start), 'swap' (the end) or 'null'."""
    s, e, d = _c(start), _c(end), _c(strand)
    return F.when(d == "+", s).when(d == "-", e).otherwise({"plain": s, "swap": e, "null": F.lit(None)}[unstranded])


def end_site(start, end, strand, unstranded: str = "plain") -> Column:
    s, e, d = _c(start), _c(end), _c(strand)
    return F.when(d == "+", e).when(d == "-", s).otherwise({"plain": e, "swap": s, "null": F.lit(None)}[unstranded])


def clean_strand(strand) -> Column:
    return F.when(_c(strand).isin("+", "-"), _c(strand)).otherwise(F.lit("."))


def contig_name(contig, mode: str = "keep") -> Column:
    """Contig names with or without the ``chr`` prefix."""
    c = _c(contig)
    if mode == "add":
        return F.when(c.startswith("chr"), c).otherwise(F.concat(F.lit("chr"), c))
    if mode == "strip":
        return F.when(c.startswith("chr"), F.substring(c, 4, 1 << 30)).otherwise(c)
    return c


# attributes


def _given(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once; functions of array elements would compute it again for each element."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _last_of_each(pairs: Column) -> Column:
    """A map of (k, v) entries; of repeated keys the last stays."""
    last = lambda ps, keys: F.filter(ps, lambda p, i: F.array_position(F.slice(keys, i + 2, F.size(ps)), p["k"]) == 0)
    return _given(pairs, lambda ps: _given(F.transform(ps, lambda p: p["k"]), lambda keys: F.map_from_entries(last(ps, keys))))


def gff3_attributes(info) -> Column:
    """``k=v;k=v`` as a map; pieces without ``=`` are dropped, of repeated keys the last stays."""
    pairs = F.filter(F.transform(F.split(_c(info), ";"), lambda p: F.trim(p)), lambda p: p.contains("="))
    return _last_of_each(F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("v"))))


def gtf_attributes(info) -> Column:
    """``k "v"; k "v";`` and ``k v;`` as a map; of repeated keys the last stays."""
    pieces = F.regexp_extract_all(_c(info), F.lit(r'([^\s;"]+\s+(?:"[^"]*"|[^\s;"]+))'), F.lit(1))
    return _last_of_each(F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, r"^(\S+)", 1).alias("k"), F.regexp_replace(F.regexp_extract(p, r"^\S+\s+(.*)$", 1), '"', "").alias("v"))))


def attributes(info) -> Column:
    """Attributes of either kind: GTF where the text begins with a key and a blank, else GFF3."""
    return F.when(_c(info).rlike(r'^\s*[^\s;="]+\s+[^\s=]'), gtf_attributes(info)).otherwise(gff3_attributes(info))


def gtf_attribute(info, key: str) -> Column:
    """The value of ``key "value"``; null if it is not there."""
    v = F.regexp_extract(_c(info), rf'(?:^|[;\t])\s*{re.escape(key)}\s+"([^"]*)"', 1)
    return F.when(_c(info).rlike(rf'(?:^|[;\t])\s*{re.escape(key)}\s+"'), v)


def strip_version(name) -> Column:
    return F.regexp_replace(_c(name), r"\.\d+$", "")


def valid_id(name) -> Column:
    """Not null, empty, ``.``, NA or NAN."""
    n = _c(name)
    return n.isNotNull() & ~F.upper(F.trim(n)).isin("", ".", "NA", "NAN")


# numbers


def tolerant_int(text) -> Column:
    """Integers with commas, blanks or a decimal part; null for anything else."""
    t = F.regexp_replace(_c(text), "[,\\s ]", "")
    return F.when(F.lower(t).isin("", "nan", "na", "none", "inf", "-inf"), F.lit(None)).otherwise(t.try_cast("double").try_cast("long"))


def tolerant_double(text) -> Column:
    t = F.regexp_replace(_c(text), "[,\\s ]", "")
    return F.when(F.lower(t).isin("", "nan", "na", "none"), F.lit(None)).otherwise(t.try_cast("double"))


def number_text(x) -> Column:
    """Six decimals at most and no trailing zeros; integers without a point."""
    t = F.format_string("%.6f", _c(x).cast("double"))
    return F.when(_c(x).isNotNull(), F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", ""))


# booleans: what unknown words and nulls become differs by table


def bool_or_false(text) -> Column:
    return F.coalesce(F.lower(F.trim(_c(text))).isin("true", "t", "1", "yes", "y"), F.lit(False))


def bool_or_null(text) -> Column:
    t = F.lower(F.trim(_c(text)))
    return F.when(t.isin("true", "t", "1", "yes", "y"), True).when(t.isin("false", "f", "0", "no", "n"), False)


def bool_exact(text) -> Column:
    """Only true and false count."""
    t = F.lower(F.trim(_c(text)))
    return F.when(t == "true", True).when(t == "false", False)


def bool_missing_false(text) -> Column:
    """As ``bool_or_null``, but words for a missing value are false."""
    t = F.lower(F.trim(_c(text)))
    return F.when(t.isin("true", "t", "1", "yes", "y"), True).when(t.isin("false", "f", "0", "no", "n", "na", "nan", "none", "", "????"), False)


def coding_class(text) -> Column:
    """coding or non_coding; words that begin with ``non`` first."""
    t = F.lower(F.trim(_c(text)))
    return F.when(t.startswith("non"), "non_coding").when(t.contains("coding") | t.isin("true", "1", "yes"), "coding").when(t.isin("false", "0", "no"), "non_coding")


def category(text) -> Column:
    return F.regexp_replace(F.lower(F.trim(_c(text))), r"[-\s]+", "_")


#: Short names of the structural categories, in the order in which tables list them.
CATEGORY_CODES = (
    ("full_splice_match", "FSM"), ("incomplete_splice_match", "ISM"), ("novel_in_catalog", "NIC"), ("novel_not_in_catalog", "NNC"),
    ("fusion", "FUS"), ("antisense", "AS"), ("genic", "GENIC"), ("genic_intron", "GENIC_INTRON"),
)
CATEGORY_ORDER = (*[c for _, c in CATEGORY_CODES], "ALL")


def category_code(text) -> Column:
    """The short name of a structural category; other names upper-cased."""
    c = category(text)
    out = F.upper(c)
    for name, code in CATEGORY_CODES:
        out = F.when(c == name, code).otherwise(out)
    return out


def category_rank(code) -> Column:
    """A place in the preferred order of categories, 999 for others."""
    at = F.array_position(F.lit(list(CATEGORY_ORDER)), _c(code).cast("string"))
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(999).cast("int")


def transcript_class(text) -> Column:
    """A viral transcript's class from its description: the first that fits, in this order; else 'other'."""
    x = _c(text)
    low = F.lower(x)
    return (
        F.when(low.rlike("asrna|antisens|antisense"), "antisense")
        .when(low.contains("intergenic") & low.contains("nc") & low.contains("ori"), "ncRNA")
        .when(x.contains("AT"), "TES isoform")
        .when(x.contains("5'"), "TSS isoform")
        .when(low.contains("spliced"), "spliced")
        .when(low.contains("polycistronic") | (low.contains("complex") & low.contains("canonic")), "polycistronic")
        .when(low.contains("monocistronic") | low.contains("canonic"), "canonic")
        .when(low.rlike(r"non-coding|\bnc\b"), "ncRNA")
        .when(x.isNotNull(), "other")
    )


def is_full_match(text) -> Column:
    return category(text).isin("full_splice_match", "fsm")


def is_incomplete_match(text) -> Column:
    return category(text).isin("incomplete_splice_match", "ism")


def canonical_site(site) -> Column:
    return F.upper(F.trim(_c(site))).isin("GTAG", "GCAG", "ATAC")


def junction_key(contig, strand, start, end) -> Column:
    return F.concat_ws("|", *[_c(x).cast("string") for x in (contig, strand, start, end)])


#: Annotation programs by a word in a path, in the order they are tried.
ANNOTATORS = (("bambu", "bambu"), ("flair", "FLAIR"), ("isoquant", "IsoQuant"), ("stringtie", "StringTie"), ("talon", "TALON"))


def annotator_of(path, default: str = "unknown") -> Column:
    p = F.lower(_c(path))
    out = None
    for word, name in ANNOTATORS:
        out = F.when(p.contains(word), name) if out is None else out.when(p.contains(word), name)
    return out.otherwise(F.lit(default))


def annotator_in(path, names, dialect: str = "name") -> Column:
    """The first of ``names`` that a path tells, in any case; null if none does.

    ``name``: a whole part of the file's name between ``-``, ``_`` and ``.``, else a folder; ``folder``: what a
    part of the path is or begins with, before ``-`` or ``_``; ``token``: a whole part between ``/``, ``-`` and ``_``,
    else anywhere in the file's name.
    """
    whole, file = _c(path), F.substring_index(_c(path), "/", -1)
    first = lambda test: F.coalesce(*[F.when(test(n), F.lit(n)) for n in names])
    has = lambda c, before, n, after: c.rlike(f"(?i)(^|{before}){re.escape(n)}($|{after})")
    if dialect == "name":
        return F.coalesce(first(lambda n: has(file, "[-_.]", n, "[-_.]")), first(lambda n: has(whole, "/", n, "/")))
    if dialect == "folder":
        return first(lambda n: has(whole, "/", n, "[/_-]"))
    return F.coalesce(first(lambda n: has(whole, "[/_-]", n, "[/_-]")), first(lambda n: F.lower(file).contains(n.lower())))


def clean_annotator(name) -> Column:
    """An annotator's name in a table of matches, without its endings and variants."""
    # Names as tables of matches spell them.
    n = F.regexp_replace(F.regexp_replace(_c(name), r"\.gff3_match$", ""), "_match$", "")
    return F.when(n.startswith("FLAIR_"), "FLAIR").when(n.isin("bambu", "Bambu"), "BAMBU").otherwise(n)


def file_stem(path) -> Column:
    """The file's name without directories and suffixes, other characters than word ones as ``_``."""
    name = F.regexp_replace(F.substring_index(_c(path), "/", -1), r"(?i)\.(gz)$", "")
    # ``\w`` is A-Z, a-z, 0-9 and _ here, and much quicker than these as ranges.
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"[^\w.-]+", "_")


# exons and introns


def exons_from_text(text, sort: bool = True, swap: bool = True, tolerant: bool = False) -> Column:
    """``s-e;s-e`` as an array of (s, e), sorted and each turned if asked; pieces that are no pair of numbers are dropped.

    ``tolerant`` reads numbers as ``tolerant_int`` does, so a comma is part of one and does not end a piece.
    """
    if tolerant:
        split = F.filter(F.split(F.coalesce(_c(text), F.lit("")), ";"), lambda p: p.contains("-"))
        pair = F.transform(split, lambda p: F.struct(tolerant_int(F.substring_index(p, "-", 1)).cast("long").alias("s"), tolerant_int(F.regexp_replace(p, "^[^-]*-", "")).cast("long").alias("e")))
        pair = F.filter(pair, lambda x: x["s"].isNotNull() & x["e"].isNotNull())
        if swap:
            pair = F.transform(pair, lambda x: F.struct(F.least(x["s"], x["e"]).alias("s"), F.greatest(x["s"], x["e"]).alias("e")))
        return F.array_sort(pair) if sort else pair
    parts = F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"[;,]"), lambda p: p.rlike(r"^\s*\d+\s*-\s*\d+\s*$"))
    pair = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "-", 1)).cast("long").alias("s"), F.trim(F.substring_index(p, "-", -1)).cast("long").alias("e")))
    if swap:
        pair = F.transform(pair, lambda x: F.struct(F.least(x["s"], x["e"]).alias("s"), F.greatest(x["s"], x["e"]).alias("e")))
    return F.array_sort(pair) if sort else pair


def exons_text(exons) -> Column:
    """Exons as ``s-e;s-e``; ``.`` for none."""
    e = _c(exons)
    t = F.array_join(F.transform(e, lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ";")
    return F.when(F.size(e) > 0, t).otherwise(F.lit("."))


def normal_exons(exons) -> Column:
    return F.array_sort(F.array_distinct(_c(exons)))


def introns_of(exons, only_real: bool = True) -> Column:
    """The gaps between neighbouring exons, as (s, e); with ``only_real``, without empty ones."""
    e = _c(exons)
    gaps = F.zip_with(F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0))), F.slice(e, 2, F.greatest(F.size(e), F.lit(1))), lambda a, b: F.struct((a["e"] + 1).alias("s"), (b["s"] - 1).alias("e")))
    return F.filter(gaps, lambda g: g["s"] <= g["e"]) if only_real else gaps


def inner_boundaries(exons) -> Column:
    """All exon ends between the first start and the last end, in the given order."""
    e = _c(exons)
    flat = F.flatten(F.transform(e, lambda x: F.array(x["s"], x["e"])))
    return F.slice(flat, 2, F.greatest(F.size(flat) - 2, F.lit(0)))


def within(a, b, window: int) -> Column:
    return F.abs(_c(a) - _c(b)) <= window


def chains_within(a, b, window: int) -> Column:
    """Two arrays of (s, e) of equal length whose ends all lie within ``window``."""
    x, y = _c(a), _c(b)
    near = F.forall(F.zip_with(x, y, lambda p, q: (F.abs(p["s"] - q["s"]) <= window) & (F.abs(p["e"] - q["e"]) <= window)), lambda t: t)
    return F.when(F.size(x) == F.size(y), near).otherwise(False)


def positions_within(a, b, window: int) -> Column:
    """Two arrays of positions of equal length, each within ``window`` of its partner."""
    x, y = _c(a), _c(b)
    return F.when(F.size(x) == F.size(y), F.forall(F.zip_with(x, y, lambda p, q: F.abs(p - q) <= window), lambda t: t)).otherwise(False)


# sequences


def complement(seq) -> Column:
    return F.translate(_c(seq), "ACGTacgt", "TGCAtgca")


#: Splice sites (donor, acceptor), the consensus they stand for and the strand.
CONSENSUS = (
    ("gt", "ag", "GT/AG", "+"),
    ("gc", "ag", "GC/AG", "+"),
    ("at", "ac", "AT/AC", "+"),
    ("ct", "ac", "GT/AG", "-"),
    ("ct", "gc", "GC/AG", "-"),
    ("gt", "at", "AT/AC", "-"),
)


def splice_consensus(left2, right2) -> tuple[Column, Column]:
    """Consensus and strand of an intron by its outer bases; null and ``.`` for no known pair."""
    pair = F.lower(F.concat(_c(left2), F.lit("/"), _c(right2)))
    name = strand = None
    for a, b, c, s in CONSENSUS:
        hit = pair == f"{a}/{b}"
        name, strand = (F.when(hit, c), F.when(hit, s)) if name is None else (name.when(hit, c), strand.when(hit, s))
    return name, strand.otherwise(F.lit("."))


def centre_score(left, right, half: int, match: float = 2.0, mismatch: float = -3.0) -> Column:
    """Best ungapped score of two windows of ``2 * half`` bases that touches their centre: the best
    stretch to the right of it plus the best to the left, neither below 0."""
    a, b = _c(left), _c(right)
    hit = F.transform(F.sequence(F.lit(1), F.lit(2 * half)), lambda i: F.when(F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)), F.lit(float(match))).otherwise(float(mismatch)))

    def best(scores: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("top"))
        return F.aggregate(scores, zero, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.greatest(s["top"], s["sum"] + x).alias("top")), lambda s: s["top"])

    return best(F.slice(hit, half + 1, half)) + best(F.reverse(F.slice(hit, 1, half)))


def poisson_tail(count, mean) -> Column:
    """P(X > count) of a Poisson variable, by its terms.

    With a count above the mean the terms above it are summed, so that small tails keep their
    digits; below, one minus the terms up to it.  Either way terms are followed away from the mean
    until they no longer matter, which takes some nine square roots of the mean.  A count below 0
    gives 1, a mean of 0 gives 0, a null of either gives null.
    """
    k, m = F.floor(_c(count)).cast("long"), _c(mean).cast("double")
    mean_of = F.greatest(m, F.lit(1e-300))  # branches below may be computed for means that they are not for
    up = k + 1 >= m
    at = F.greatest(F.when(up, k + 1).otherwise(k), F.lit(0))
    steps = F.sequence(F.lit(1).cast("long"), F.ceil(F.sqrt(80 * mean_of) + 60).cast("long"))
    first = F.exp(_log_poisson(at, mean_of))
    ratio = lambda j: F.when(up, mean_of / (at + j)).otherwise(F.greatest(at - j + 1, F.lit(0)) / mean_of)
    total = F.aggregate(
        steps,
        F.struct(first.alias("t"), first.alias("s")),
        lambda a, j: F.struct((a["t"] * ratio(j)).alias("t"), (a["s"] + a["t"] * ratio(j)).alias("s")),
        lambda a: F.least(a["s"], F.lit(1.0)),
    )
    return F.when(m.isNull() | k.isNull(), F.lit(None)).when(m <= 0, F.lit(0.0)).when(k < 0, F.lit(1.0)).when(up, total).otherwise(1 - total)


def _log_poisson(n, m) -> Column:
    """The logarithm of the Poisson probability of ``n`` at mean ``m``.

    For large ``n`` its big parts, which nearly cancel, are taken together.
    """
    x = F.greatest(n, F.lit(1)).cast("double")
    small = -m + x * F.log(m) - F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(20)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    far = x - m - x * F.log1p((x - m) / m) - 0.5 * F.log(2 * F.pi() * x) - series
    return F.when(n <= 0, -m).when(n <= 20, small).otherwise(far)


def support_count(score, exon_scores, mode: str = "max") -> Column:
    """A transcript's support: its score, else its exons' by ``mode`` (max, mean, sum, first), else 1."""
    known = F.filter(_c(exon_scores), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    chosen = {"max": F.array_max(known), "mean": F.try_divide(total, F.size(known)), "sum": F.when(F.size(known) > 0, total), "first": F.get(known, F.lit(0))}[mode]
    return F.coalesce(_c(score), chosen, F.lit(1.0))


def inner_signature(exons) -> Column:
    """Ends of the exons but for the outer two, empty for a single exon: what transcripts that differ at
    their ends alone share."""
    return F.when(F.size(_c(exons)) > 1, inner_boundaries(exons)).otherwise(F.array().cast("array<long>"))


def default_tag(path) -> Column:
    """TSS or TES by a file's name; null for neither."""
    n = F.upper(F.substring_index(_c(path), "/", -1))
    return F.when(n.contains("TSS"), "TSS").when(n.contains("TES"), "TES")


def run_names(path) -> Column:
    """(cell line, chemistry, annotator) of a file name such as ``cell_chemistry_annotator.txt``; null for other names."""
    n = F.regexp_replace(F.substring_index(_c(path), "/", -1), r"\.[A-Za-z]+$", "")
    part = lambda k: F.nullif(F.regexp_extract(n, r"^([^_]+)_([^_]+)_([^_]+)$", k), F.lit(""))
    return F.struct(part(1).alias("cell_line"), part(2).alias("chemistry"), part(3).alias("annotator"))
