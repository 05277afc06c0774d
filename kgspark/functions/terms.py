"""Names of predicates and categories, the fixed vocabularies, fingerprints, and the tests of attribute constraints."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "biolink:"

#: Predicates that the Biolink Model 4.3.7 marks as symmetric, without their prefix.
SYMMETRIC = frozenset({
    "associated_with", "binds", "chemically_similar_to", "close_match", "coexists_with", "coexpressed_with", "colocalizes_with",
    "correlated_with", "directly_physically_interacts_with", "exact_match", "gene_fusion_with", "genetic_association",
    "genetic_neighborhood_of", "genetically_associated_with", "genetically_interacts_with", "homologous_to",
    "in_cell_population_with", "in_complex_with", "in_linkage_disequilibrium_with", "in_pathway_with",
    "indirectly_physically_interacts_with", "interacts_with", "negatively_correlated_with", "occurs_together_in_literature_with",
    "opposite_of", "orthologous_to", "overlaps", "paralogous_to", "pharmacologically_interacts_with", "physically_interacts_with",
    "positively_correlated_with", "related_condition", "related_to", "related_to_at_concept_level", "related_to_at_instance_level",
    "same_as", "similar_to", "temporally_related_to", "xenologous_to",
})
#: Qualifiers that constraints may name, as keys of an edge's qualifiers.
QUALIFIERS = ("qualified_predicate", "object_aspect_qualifier", "object_direction_qualifier", "subject_aspect_qualifier", "subject_direction_qualifier", "causal_mechanism_qualifier", "species_context_qualifier", "disease_context_qualifier", "frequency_qualifier")
#: Predicates that build hierarchies.
HIERARCHY = ("subclass_of", "rdfs:subClassOf")


def bare(term: str) -> str:
    """A term without the model's prefix."""
    return term.removeprefix(PREFIX)


def full(term: str) -> str:
    """A term with the model's prefix, unless it has a prefix of its own."""
    return term if ":" in term else PREFIX + term


def bare_column(c: Column) -> Column:
    return F.regexp_replace(c, f"^{PREFIX}", "")


def full_column(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(":")), c).otherwise(F.concat(F.lit(PREFIX), c))


def stable_hash(*columns: Column) -> Column:
    """64 bits that are the same on every machine and run."""
    return F.xxhash64(*columns)


def encoded(fields: Column) -> Column:
    """A record's fields (map or struct) as JSON text, in the order in which they stand."""
    return F.to_json(fields)


def decoded(text: Column) -> Column:
    """The fields of a record's JSON text, each as text; null where it is no object."""
    return F.from_json(text, "map<string,string>")


def readable_bytes(n: float) -> str:
    """1536 as 1.5 KB."""
    units = ["B", "KB", "MB", "GB", "TB"]
    power = min(len(units) - 1, max(0, int(math.log(max(abs(n), 1), 1024))))
    return f"{n / 1024**power:.1f} {units[power]}"


def is_curie(term: str) -> bool:
    return ":" in term and not term.startswith(PREFIX)


def one_of(c: Column, values: Iterable[str] | None) -> Column:
    """c is among the values; no values, no constraint."""
    chosen = [bare(v) for v in values] if values else []
    return c.isin(chosen) if chosen else F.lit(True)


def is_symmetric(predicate: Column) -> Column:
    return predicate.isin(sorted(SYMMETRIC))


def qualifier_fingerprint(qualifiers: Column) -> Column:
    """The first ten digits of the SHA-1 of the sorted qualifier entries as JSON; '' without any.

    Equal to a digest of canonical JSON for ASCII strings; other strings are distinct just as well, but digest differently.
    """
    named = F.map_filter(qualifiers, lambda k, v: F.contains(k, F.lit("qualifier")) | (k == "qualified_predicate"))
    entries = F.array_sort(F.map_entries(named))
    json = F.to_json(F.map_from_entries(entries))
    return F.when(qualifiers.isNull() | (F.size(named) == 0), "").otherwise(F.substring(F.sha1(json.cast("binary")), 1, 10))


def name_class(curie: Column, categories: Column) -> Column:
    """The group in which reports show a node: by category, else by the id's prefix."""
    out = F.lit("other")
    by_prefix = {"clinical": ["UMLS", "NCIT", "MESH"], "anatomy": ["UBERON"], "trait": ["EFO"], "phenotype": ["HP"], "disease": ["MONDO", "DOID", "OMIM", "Orphanet"]}
    by_category = {"chemical": ["ChemicalEntity", "SmallMolecule", "Drug"], "anatomy": ["AnatomicalEntity", "GrossAnatomicalStructure", "Cell"], "gene": ["Gene", "Protein", "GeneOrGeneProduct"], "phenotype": ["PhenotypicFeature"], "disease": ["Disease"]}
    for group, prefixes in by_prefix.items():
        out = F.when(F.split_part(curie, F.lit(":"), F.lit(1)).isin(prefixes), group).otherwise(out)
    for group, names in by_category.items():
        out = F.when(F.coalesce(F.arrays_overlap(categories, F.array(*map(F.lit, names))), F.lit(False)), group).otherwise(out)
    return out


def java_pattern(text: str) -> str | None:
    """The search pattern of a 'matches' constraint, /pattern/i or bare; None if it does not compile."""
    slashed = re.fullmatch(r"/(.*)/([a-z]*)", text, re.S)
    body, flags = (slashed[1], slashed[2]) if slashed else (text, "")
    try:
        re.compile(body)
    except re.error:
        return None
    return f"(?i){body}" if "i" in flags else body


def attribute_test(single: Column, several: Column | None, operator: str, value: object, negated: bool = False) -> Column:
    """Whether an attribute satisfies a constraint.

    single: the attribute as a string (null if missing); several: its elements where it is a list. A missing attribute and an unknown
    operator satisfy nothing, which `not` turns into true.
    """
    listed = F.lit(False) if several is None else several.isNotNull()
    elements = F.array().cast("array<string>") if several is None else F.coalesce(several, F.array().cast("array<string>"))
    if operator in ("==", "==="):
        test = F.when(listed, F.array_contains(elements, str(value))).otherwise(single == str(value))
    elif operator in (">", "<"):
        number, limit = single.try_cast("double"), F.lit(str(value)).try_cast("double")
        test = number > limit if operator == ">" else number < limit
    elif operator == "matches":
        pattern = java_pattern(str(value))
        test = F.lit(False) if pattern is None else F.when(listed, F.array_join(elements, " ").rlike(pattern)).otherwise(single.rlike(pattern))
    elif operator == "in":
        test = single.isin([str(v) for v in value]) if isinstance(value, (list, tuple, set, frozenset)) else F.contains(F.lit(str(value)), single)
    else:
        test = F.lit(False)
    known = F.coalesce(test, F.lit(False))
    return ~known if negated else known
