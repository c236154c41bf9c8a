"""textloom: preparation and analysis of language-model corpora on Spark."""
