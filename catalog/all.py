"""All registered queries."""

from catalog import cases, labels, matrices, rankings, storage, texts, trees  # noqa: F401
from catalog.views import QUERIES, SQL, with_views  # noqa: F401
