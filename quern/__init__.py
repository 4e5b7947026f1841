"""quern: a Spark-first engine for facts about source code and text."""

__version__ = "0.1.0"
