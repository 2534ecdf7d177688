"""All queries of the library by name, and the SQL that checks them."""

from . import annotation, curation, kitchen, matching, merging, records, rules, tagging

_FAMILIES = (matching, curation, tagging, records, rules, annotation, kitchen, merging)
QUERIES = {name: f for family in _FAMILIES for name, f in family.QUERIES.items()}
ORACLES = {name: sql for family in _FAMILIES for name, sql in family.SQLS.items() if sql}
