"""Settings records: one per graph kind, one per search run."""

from __future__ import annotations

from dataclasses import dataclass

# They must equal what the graph stores and run files contain.
UNNAMED = "UnName_Entity"
FREEBASE_NS = "http://rdf.freebase.com/ns/"
WIKIDATA_ENTITY = "http://www.wikidata.org/entity/"
WIKIDATA_DIRECT = "http://www.wikidata.org/prop/direct/"
WIKIDATA_PROP = "http://www.wikidata.org/prop/"
NAME_PREDICATE = "type.object.name"
SAME_AS = "http://www.w3.org/2002/07/owl#sameAs"
RDF_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"

# Whole-word label terms that mark an id, url or media relation.
NOISE_TERMS = (
    "id", "identifier", "code", "url", "username", "handle", "catalog", "index",
    "registry", "authority", "vocabulary", "thesaurus", "api endpoint", "image",
    "logo", "flag image", "coat of arms", "official website",
)


@dataclass(frozen=True)
class GraphKind:
    """How ids, relations and labels look in one family of graphs."""

    name: str
    entity_uri_prefixes: tuple[str, ...]
    entity_id_pattern: str
    default_prefix: str
    property_pattern: str | None
    dropped_relations: tuple[str, ...]
    dropped_prefixes: tuple[str, ...]
    dropped_fragments: tuple[str, ...]
    languages: tuple[str, ...]
    prune_noisy_labels: bool
    name_predicates: tuple[str, ...]
    alias_predicates: tuple[str, ...]


FREEBASE = GraphKind(
    name="freebase",
    entity_uri_prefixes=(FREEBASE_NS,),
    entity_id_pattern=r"^[mg]\.",
    default_prefix="m.",
    property_pattern=None,
    dropped_relations=("type.object.type", "type.object.name"),
    dropped_prefixes=("common.", "freebase."),
    dropped_fragments=("sameAs",),
    languages=("en", ""),
    prune_noisy_labels=False,
    name_predicates=(NAME_PREDICATE,),
    alias_predicates=(SAME_AS,),
)

WIKIDATA = GraphKind(
    name="wikidata",
    entity_uri_prefixes=(WIKIDATA_ENTITY, WIKIDATA_DIRECT, "wd:"),
    entity_id_pattern=r"^Q\d+$",
    default_prefix="Q",
    property_pattern=r"^P\d+$",
    dropped_relations=("P373", "P910"),
    dropped_prefixes=(),
    dropped_fragments=(),
    languages=("en",),
    prune_noisy_labels=True,
    name_predicates=(RDF_LABEL,),
    alias_predicates=(),
)


@dataclass(frozen=True)
class SearchSettings:
    """Widths and limits of one search run.

    ``row_limit`` is the page size of one retrieval (first rows by id);
    ``None`` switches it off.  Only the lists in prompts and reasoning texts are
    cut to it; candidates, answers and node sets are whole.
    """

    relation_width: int = 3
    entity_width: int = 3
    depth: int = 3
    relation_cap: int = 1000
    entity_cap: int = 500
    row_limit: int | None = 1000
    group_sample: int = 10
    semantic_limit: int = 70
    revisit_rounds: int = 5
    seed: str = "7"
