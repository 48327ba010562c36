"""All queries and their SQL."""

from loomspan.plans import further_queries, gene_queries, interval_queries, model_queries, sequence_queries, source_queries, stat_queries, stream_queries, structure_queries, table_queries, track_queries  # noqa: F401
from loomspan.plans.bind import ORACLES, QUERIES  # noqa: F401
