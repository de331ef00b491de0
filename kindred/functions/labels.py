"""Column functions on labels and report fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import genotype as G
from .genotype import MISSING_FACETS

SEX = {"m": "M", "male": "M", "1": "M", "f": "F", "female": "F", "2": "F"}
REGION_ALIASES = {"SAS": "CSA"}
#: Fixed spellings of what counts as a reference call: plain no-calls, and patterns of diplotypes, in lower case.
NO_RESULT = ["no call", "none", "na", "n/a"]
REFERENCE_PATTERNS = [
    r"^reference/reference$",
    r"^\*1/\*1$",
    r"^b \(reference\)/b \(reference\)$",
    r"^rs[0-9]+ reference \([acgt]\)/rs[0-9]+ reference \([acgt]\)$",
]


def population(c: Column) -> Column:
    """Lower case, other characters as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def display(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def sex(c: Column) -> Column:
    """M, F or null."""
    x = F.lower(F.trim(c))
    return F.when(x.isin([k for k, v in SEX.items() if v == "M"]), "M").when(x.isin([k for k, v in SEX.items() if v == "F"]), "F")


def plink_sex(c: Column) -> Column:
    """1, 2, or 0 for unknown."""
    return F.when(sex(c) == "M", 1).when(sex(c) == "F", 2).otherwise(0)


def region(c: Column) -> Column:
    out = c
    for old, new in REGION_ALIASES.items():
        out = F.when(c == old, new).otherwise(out)
    return out


def ancestries(c: Column) -> Column:
    """The distinct labels of a free-text answer, in order, lower case with underscores."""
    parts = F.split(F.trim(c), r"(?i)\s*(?:[;,/|+&]|\band\b)\s*")
    return F.array_distinct(F.filter(F.transform(parts, population), lambda x: x != ""))


def missing_facet(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(MISSING_FACETS)


def missing_facets(facets: Column) -> Column:
    """Names of a map's missing facets, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.map_keys(F.map_filter(facets, lambda k, v: missing_facet(v)))), ",")


def sorted_json(facets: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(facets))))


def report_line(c: Column) -> Column:
    """Without line ends; other control characters but tabs as escapes."""
    line = F.regexp_replace(c, r"[\r\n]+$", "")
    chars = F.transform(F.split(line, ""), lambda x: F.when((F.ascii(x) < 32) & (x != "\t") & (x != ""), F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(x))), 2, "0"))).otherwise(x))
    return F.when(line.rlike(r"[\x00-\x08\x0a-\x1f]"), F.array_join(chars, "")).otherwise(line)


def hla_allele(gene: Column, digits: Column) -> Column:
    """HLA-GENE*NN:NN of a gene and digits, the last two after the colon; 0 for none."""
    n = F.length(digits)
    name = F.concat(F.lit("HLA-"), gene, F.lit("*"), F.substring(digits, F.lit(1), F.greatest(n - 2, F.lit(0))), F.lit(":"), F.right(digits, F.lit(2)))
    return F.when(F.coalesce(digits, F.lit("")).isin("", "0"), "0").otherwise(name)


def strip_score(c: Column) -> Column:
    """A call without a match score in brackets at its end."""
    return F.trim(F.regexp_replace(c, r"\s*\([^()]*\)\s*$", ""))


def possible_calls(calls: Column) -> Column:
    """Distinct non-blank calls of an array in order, joined by "; "."""
    return F.array_join(F.array_distinct(F.filter(F.transform(calls, lambda x: F.trim(strip_score(x))), lambda x: x != "")), "; ")


def reference_like(c: Column) -> Column:
    """Whether a diplotype is the reference on both sides, or a plain no-call; a blank one is neither."""
    x = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+", " ")
    return (x != "") & (x.isin(NO_RESULT) | x.rlike("|".join(REFERENCE_PATTERNS)))


def stable_group_id(*values: Column) -> Column:
    """Twelve hex digits of the SHA-256 of values joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *(F.coalesce(v.cast("string"), F.lit("")) for v in values)), 256), 1, 12)


def safe_id(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "[^A-Za-z0-9._-]+", "_")


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it: inside lambdas Spark finds no common parts."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def raw_allele_tokens(variants: Column) -> Column:
    """``(chrom, pos, ref, alt, gt)`` structs of one sample's sites as tokens ``chrom:pos:ref>alt=GT``, joined by ";".

    A site of several alternates is cut into one token for each that the genotype holds, with the genotype as that
    alternate sees it: 1 for itself, 0 for the reference and other alternates, a dot for what is missing. A genotype of
    nothing but dots gives every alternate, as ``./.``; a blank or reference genotype gives none. Tokens are in order of
    chromosome (numbers, X, Y, MT, then other names), position, reference and alternate, then as text; repeats stay. ``gt`` is the
    genotype alone; ``sample_genotype`` takes it out of a VCF line's columns.
    """

    def tokens(v: Column) -> Column:
        phased, gt = F.contains(v["gt"], F.lit("|")), F.trim(v["gt"])
        alleles = F.when(phased, F.split(gt, r"\|")).otherwise(F.split(gt, "/"))
        alts = F.filter(F.transform(F.split(v["alt"], ","), lambda a: F.trim(a)), lambda a: a != "")
        site = F.struct(alleles.alias("alleles"), alts.alias("alts"), F.when(phased, "|").otherwise("/").alias("sep"))
        none = F.array().cast(TOKENS)
        return F.when((gt == "") | v["gt"].isNull(), none).otherwise(once(site, lambda s: once(held(s), lambda ks: F.when(F.size(ks) > 0, of_alternates(v, s, ks)).otherwise(none))))

    def held(s: Column) -> Column:
        each = F.when(F.size(s["alts"]) > 0, F.sequence(F.lit(1), F.size(s["alts"]))).otherwise(F.array().cast("array<int>"))
        known = F.transform(s["alleles"], lambda a: F.when(a != ".", a.try_cast("int")))  # what can't be cast costs an exception
        return F.when(F.forall(s["alleles"], lambda a: a == "."), each).otherwise(once(known, lambda numbers: F.filter(each, lambda k: F.array_contains(numbers, k))))

    def of_alternates(v: Column, s: Column, ks: Column) -> Column:
        name = G.clean_chrom(v["chrom"])
        place = once(name, lambda n: F.when(n.rlike("^[0-9]{1,9}$"), n.try_cast("int")).when(n == "X", 23).when(n == "Y", 24).when(n.isin("M", "MT"), 25))
        chrom = F.struct(place.alias("rank"), F.regexp_replace(F.trim(v["chrom"]), "(?i)^chr", "").alias("name"), F.concat(v["chrom"], F.lit(":"), v["pos"].cast("string"), F.lit(":"), v["ref"], F.lit(">")).alias("site"))
        return once(chrom, lambda c: F.transform(ks, lambda k: token(v, s, c, F.get(s["alts"], k - 1), k)))

    def token(v: Column, s: Column, c: Column, alt: Column, k: Column) -> Column:
        seen = F.transform(s["alleles"], lambda a: F.when(a == ".", ".").when(a == k.cast("string"), "1").otherwise("0"))
        joined = lambda x: F.reduce(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), F.get(x, F.lit(0)), lambda y, z: F.concat(y, s["sep"], z))
        gt = once(seen, lambda x: F.when(F.forall(x, lambda y: y == "."), "./.").when((F.size(x) == 2) & F.forall(x, lambda y: y == "1"), "1/1").otherwise(joined(x)))
        return F.struct(
            c["rank"].isNull().cast("int").alias("unknown"), F.coalesce(c["rank"], F.lit(0)).alias("rank"), c["name"].alias("name"), F.coalesce(v["pos"].cast("long"), F.lit(0)).alias("pos"),
            v["ref"].alias("ref"), alt.alias("alt"), F.concat(c["site"], alt, F.lit("="), gt).alias("token"),
        )

    return F.array_join(F.transform(F.array_sort(F.flatten(F.transform(variants, tokens))), lambda t: t["token"]), ";")


TOKENS = "array<struct<unknown:int,rank:int,name:string,pos:long,ref:string,alt:string,token:string>>"


def sample_genotype(keys: Column, values: Column) -> Column:
    """The genotype among a VCF sample's colon-joined values: under the key GT, or the first where there is none."""
    names, found = F.split(keys, ":"), F.split(values, ":")
    at = F.array_position(names, "GT").cast("int")
    own = F.get(found, at - 1)
    return F.trim(F.coalesce(F.when((at > 0) & own.isNotNull(), own), F.get(found, F.lit(0)), F.lit("")))
