from quern.workload import (  # noqa: F401
    feed_queries,
    result_queries,
    retrieval_queries,
    schema_queries,
    store_queries,
    text_queries,
)
from quern.workload.registry import ORACLES, QUERIES  # noqa: F401
