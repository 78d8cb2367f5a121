"""pathweave: bag-of-path-context features, vocabularies, scoring and evaluation on Spark."""

__version__ = "0.1.0"
