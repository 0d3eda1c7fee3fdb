"""All registered queries."""

from codefacts.catalog import aggregates, documentq, impactq, joins, questionq, refreshq, scalars, sourceq, storeq, streams, tasks  # noqa: F401
from codefacts.catalog.base import SPARK, SQL  # noqa: F401
