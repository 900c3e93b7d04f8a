"""clipfold: document-curation analytics as Spark DataFrame transforms."""
