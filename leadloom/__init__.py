"""Site-lead analytics on Spark: operators over URLs, pages, leads and feedback tables."""

__version__ = "0.1.0"
