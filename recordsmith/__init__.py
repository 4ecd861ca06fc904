"""recordsmith: enrichment and governance of large record catalogues on Spark."""
