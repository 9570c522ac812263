"""All registered queries of the library and their SQL."""

from quarry.plans import kept, more, retrieval

FLAGSHIP = retrieval.hybrid_search_topk
#: importing a module registers its queries
MODULES = (retrieval, more, kept)
queries = retrieval.queries
oracle_sql = retrieval.oracle_sql
