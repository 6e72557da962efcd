"""All queries over the test tables, and the SQL of the same rows."""

from paperloom.plans import answers, citations, cleaning, documents, findings, intervals, laws, ledger, streams, telemetry  # noqa: F401  (they register their queries)
from paperloom.plans.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "a01_telemetry_by_model_role"
