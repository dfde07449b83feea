"""All registered queries and their SQL."""

from cyclora.plans import events_and_text, files, linking_and_groups, periodicity, similarity_and_evaluation, streams  # noqa: F401
from cyclora.plans.registry import QUERIES, SQL  # noqa: F401
