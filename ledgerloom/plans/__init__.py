"""Named queries over the domain views, each with the SQL that checks it."""

from ledgerloom.plans import (  # noqa: F401  (importing a module registers its queries)
    aggregates, feeds, filters, joins, mutations, quality, scalars, sinks, sources, streams,
)
from ledgerloom.plans.registry import PLANS  # noqa: F401
