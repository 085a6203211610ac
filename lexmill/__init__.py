"""lexmill: curation, controlled editing and evaluation of labelled text corpora on Spark."""
