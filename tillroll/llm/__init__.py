"""Training-data operators: deduplication, search, sharding, packing, quality,
mixing and personal data, each a Spark job over a ``documents`` or
``embeddings`` table.  Nothing else in the library imports this subpackage."""
