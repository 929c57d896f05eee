"""Document-extraction analytics as Spark jobs: corpora, containers, rules, validation, links."""

__version__ = "0.1.0"
