"""Readers and parsers of feeds, each as a Spark job over files or over a table of documents."""
