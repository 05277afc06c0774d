"""Widening of a query graph's predicates and qualifier values to what stands below them in a model."""

from __future__ import annotations

import copy
import itertools
import json
from dataclasses import dataclass, field

from kgspark.functions.terms import bare, full

#: A constraint whose values widen to more combinations is left as it is.
MAX_COMBINATIONS = 64


@dataclass
class Expander:
    """Maps of terms (without prefix) to all their descendants, themselves included."""

    predicates: dict[str, frozenset[str]] = field(default_factory=dict)
    qualifier_values: dict[str, frozenset[str]] = field(default_factory=dict)

    @staticmethod
    def from_json(path: str) -> Expander:
        """From a file {"predicates": {term: [descendants]}, "qualifier_values": {...}}."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        read = lambda name: {bare(k): frozenset({bare(k), *map(bare, v)}) for k, v in spec.get(name, {}).items()}
        return Expander(read("predicates"), read("qualifier_values"))

    def predicate(self, term: str) -> list[str]:
        return sorted({bare(term), *map(bare, self.predicates.get(bare(term), ()))})

    def value(self, term: object) -> list:
        return sorted({term, *self.qualifier_values.get(term, ())}) if isinstance(term, str) else [term]


def expand_query_graph(query_graph: dict, expander: Expander) -> dict:
    """A widened copy; a set of qualifiers becomes one set for each combination of their values."""
    out = copy.deepcopy(query_graph)
    for edge in (out.get("edges") or {}).values():
        if edge.get("predicates"):
            edge["predicates"] = sorted({full(d) for p in edge["predicates"] for d in expander.predicate(p)})
        sets = []
        for constraint in edge.get("qualifier_constraints") or []:
            qualifiers = constraint.get("qualifier_set") or []
            choices = [expander.value(q.get("qualifier_value")) for q in qualifiers]
            n = 1
            for c in choices:
                n *= len(c)
            if n > MAX_COMBINATIONS:
                sets.append(constraint)
                continue
            sets += [{**constraint, "qualifier_set": [{**q, "qualifier_value": v} for q, v in zip(qualifiers, values, strict=True)]} for values in itertools.product(*choices)]
        if sets:
            edge["qualifier_constraints"] = sets
    return out
