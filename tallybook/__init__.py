"""Catalog analytics on Spark: ingest, audit, clean, measure, model.

Every operator takes DataFrames and returns DataFrames; a `CatalogSpec` says
which columns play which role, so the same operators serve any table of
scored, dated, partly categorised observations credited to a creator.
"""

from tallybook.spec import CatalogSpec, ModelSpec

__all__ = ["CatalogSpec", "ModelSpec"]
