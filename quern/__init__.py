"""quern: a Spark-first engine for product-catalogue text analytics and search."""

__version__ = "0.1.0"
