"""Column functions behind the DSL's extractors, predicates and transforms."""
