"""Corpus, mixture, preference and evaluation jobs written as Spark DataFrame plans."""
