"""Import every catalog module so their queries register."""

from quarry.plans import catalog_answer, catalog_eval, catalog_more, catalog_retrieval  # noqa: F401
