"""The registered queries, each beside the SQL that says the same."""

from quire.plans import checking, covering, exporting, figuring, keeping, laying_out, mapping_concepts, marking_up, merging_topics, reading_contents, registry, segmenting, serving, shaping_documents, texts


def all_plans() -> tuple[dict, dict]:
    """(queries, SQL) by name."""
    return dict(registry.QUERIES), dict(registry.ORACLES)
