"""Query-to-question data curation as Spark DataFrame operators."""
