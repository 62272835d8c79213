"""Column expressions over alleles and coordinates; no user-defined functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: amino acids of the standard code by 16 * b0 + 4 * b1 + b2 with A 0, C 1, G 2, T 3.
CODONS = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVV*Y*YSSSS*CWCLFLF"


def last_fit(n: Column, test) -> Column:
    """The largest k in 0..n for which test(k) holds; test(0) must."""
    return F.array_max(F.filter(F.sequence(F.lit(0), n), test))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_variant(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(pos, ref, alt): common suffix, then common prefix trimmed while both alleles together keep a base to lose."""

    def fit(r: Column, a: Column, side) -> Column:
        whole = F.length(r) + F.length(a)
        return last_fit(F.least(F.length(r), F.length(a)), lambda k: (side(r, k) == side(a, k)) & ((k == 0) | (whole - 2 * (k - 1) > 2)))

    def cut(s: Column) -> Column:
        rest = F.struct(F.substr(ref, F.lit(1), F.length(ref) - s).alias("r"), F.substr(alt, F.lit(1), F.length(alt) - s).alias("a"))
        return let(rest, lambda x: let(fit(x["r"], x["a"], F.left), lambda p: F.struct((pos + p).cast("long").alias("pos"), F.substr(x["r"], p + 1, F.length(x["r"])).alias("ref"), F.substr(x["a"], p + 1, F.length(x["a"])).alias("alt"))))

    # nothing to trim: no base to lose, or other bases at both ends
    done = (F.length(ref) + F.length(alt) <= 2) | ((F.left(ref, F.lit(1)) != F.left(alt, F.lit(1))) & (F.right(ref, F.lit(1)) != F.right(alt, F.lit(1))))
    same = F.struct(pos.cast("long").alias("pos"), ref.alias("ref"), alt.alias("alt"))
    return F.when(ref.isNotNull() & alt.isNotNull() & pos.isNotNull(), F.when(done, same).otherwise(let(fit(ref, alt, F.right), cut)))


def changed(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(s, e, ref, alt): common prefix off, then common suffix; an insertion has e = s - 1."""

    def cut(p: Column) -> Column:
        rest = F.struct(F.substr(ref, p + 1, F.length(ref)).alias("r"), F.substr(alt, p + 1, F.length(alt)).alias("a"))
        return let(rest, lambda x: let(last_fit(F.least(F.length(x["r"]), F.length(x["a"])), lambda k: F.right(x["r"], k) == F.right(x["a"], k)), lambda q: done(p, x, q)))

    def done(p: Column, x: Column, q: Column) -> Column:
        n = F.length(x["r"]) - q
        return F.struct((pos + p).cast("long").alias("s"), (pos + p + n - 1).cast("long").alias("e"), F.substr(x["r"], F.lit(1), n).alias("ref"), F.substr(x["a"], F.lit(1), F.length(x["a"]) - q).alias("alt"))

    return let(last_fit(F.least(F.length(ref), F.length(alt)), lambda k: F.left(ref, k) == F.left(alt, k)), cut)


def hgvs_genomic(chrom: Column, s: Column, e: Column, ref: Column, alt: Column) -> Column:
    """The g. name of a trimmed change."""
    at, till = s.cast("string"), e.cast("string")
    span = F.when(s == e, at).otherwise(F.concat(at, F.lit("_"), till))
    what = (
        F.when(ref == "", F.concat(till, F.lit("_"), at, F.lit("ins"), alt))
        .when(alt == "", F.concat(span, F.lit("del")))
        .when((F.length(ref) == 1) & (F.length(alt) == 1), F.concat(at, ref, F.lit(">"), alt))
        .when((F.length(ref) == F.length(alt)) & (ref == revcomp(alt)), F.concat(span, F.lit("inv")))
        .otherwise(F.concat(span, F.lit("delins"), alt))
    )
    return F.concat(chrom, F.lit(":g."), what)


def info_value(info: Column, key: str) -> Column:
    """The first value of an INFO key; null if the key is not there. Only whole names match."""
    hit = F.filter(F.split(info, ";"), lambda x: F.startswith(x, F.lit(f"{key}=")))
    return F.when(F.size(hit) > 0, F.substr(F.get(hit, F.lit(0)), F.lit(len(key) + 2)))


def compute_end(pos: Column, ref: Column, info: Column) -> Column:
    """END, else pos + |SVLEN| (pos for insertions), else pos + length(ref) - 1."""
    end = info_value(info, "END").try_cast("long")
    svlen = F.split_part(info_value(info, "SVLEN"), F.lit(","), F.lit(1)).try_cast("long")
    by_length = F.when(F.coalesce(info_value(info, "SVTYPE") == "INS", F.lit(False)), pos).otherwise(pos + F.abs(svlen))
    return F.coalesce(end, F.when(svlen.isNotNull(), by_length), pos + F.greatest(F.length(ref) - 1, F.lit(0))).cast("long")


def sv_type(alt: Column) -> Column:
    """Structural type of an ALT; null for plain sequence. Tags are read in any case."""
    tag = F.upper(F.regexp_extract(alt, r"^<(.*)>$", 1))
    copies = F.regexp_extract(tag, r"^CN(\d+)$", 1).try_cast("int")
    symbolic = (
        F.when(tag == "DEL", "deletion")
        .when(tag.isin("DUP", "DUP:TANDEM"), "tandem_duplication")
        .when(tag == "INV", "inversion")
        .when(tag == "BND", "breakend")
        .when(tag == "INS", "insertion")
        .when(tag == "CNV", "copy_number_variation")
        .when(tag == "STR", "short_tandem_repeat")
        .when(copies < 2, "copy_number_loss")
        .when(copies > 2, "copy_number_gain")
        .when(tag.startswith("CN"), "copy_number_variation")
        .otherwise("unknown")
    )
    return F.when(alt.startswith("<"), symbolic).when(alt.contains("[") | alt.contains("]"), "breakend")


def revcomp(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def amino_acid(codon: Column) -> Column:
    """One letter; X for anything that is not three of ACGT."""
    digit = lambda k: F.position(F.substr(codon, F.lit(k), F.lit(1)), F.lit("ACGT")) - 1
    at = 16 * digit(1) + 4 * digit(2) + digit(3)
    return F.when(codon.rlike("^[ACGT]{3}$"), F.substr(F.lit(CODONS), at + 1, F.lit(1))).otherwise("X")


def codon_class(ref_codon: Column, alt_codon: Column) -> Column:
    a, b = amino_acid(ref_codon), amino_acid(alt_codon)
    return F.when(a == b, "synonymous").when(b == "*", "stop").otherwise("missense")


def chrom_alias(chrom: Column) -> Column:
    """Contig name without a leading `chr`; M becomes MT."""
    bare = F.regexp_replace(chrom, r"^(?i)chr", "")
    return F.when(bare == "M", "MT").otherwise(bare)


def parse_region(region: str) -> tuple[str, int | None, int | None]:
    """`chrom` or `chrom:start-end`, commas allowed; ValueError if it is neither."""
    chrom, colon, span = region.partition(":")
    chrom = chrom[3:] if chrom.lower().startswith("chr") else chrom
    if not colon:
        return chrom, None, None
    start, dash, end = span.replace(",", "").partition("-")
    if not (dash and start.isdigit() and end.isdigit()):
        raise ValueError(f"invalid region {region!r}")
    return chrom, int(start), int(end)


def in_region(region: str, chrom: Column, pos: Column, end_pos: Column) -> Column:
    name, start, end = parse_region(region)
    same = F.regexp_replace(chrom, r"^(?i)chr", "") == name
    return same if start is None else same & (pos <= end) & (end_pos >= start)
