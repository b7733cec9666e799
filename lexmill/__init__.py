"""lexmill: corpus operators for labelled text in several languages, on Spark."""
