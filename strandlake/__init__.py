"""strandlake: a Spark-first engine for biological-sequence corpora and the evidence tables built around them."""
