"""hearsay: community-text analytics as Spark DataFrame operators."""
